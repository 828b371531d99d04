"""Sources and sinks: seasons, column checks, exports, snapshots, manifests."""

from __future__ import annotations

import json
from functools import reduce
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES = "region nation customer supplier part orders lineitem events".split()


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_seasons(spark: SparkSession, paths: dict[int, str], schema: T.StructType | str | None = None, kind: str = "parquet", **options) -> DataFrame:
    """One source per season, each tagged with its season, as one table."""
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (reader.format(kind).load(p).withColumn("season", F.lit(s)) for s, p in sorted(paths.items())))


def require_columns(df: DataFrame, required: list[str]) -> None:
    """Fails before any work if a column is missing; headers are trimmed, case counts."""
    missing = sorted(set(required) - {c.strip() for c in df.columns})
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def renamed(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The mapped columns under their short names."""
    trimmed = {c.strip(): c for c in df.columns}
    require_columns(df, list(mapping))
    return df.select(*(F.col(f"`{trimmed[a]}`").alias(b) for a, b in mapping.items()))


def is_starter(flag: Column, ip: Column) -> Column:
    return F.coalesce((F.upper(F.trim(flag)) == "YES") & (ip > 0), F.lit(False))


def in_lineup(pa: Column, slot: Column) -> Column:
    return F.coalesce((pa > 0) & slot.isNotNull(), F.lit(False))


def clean_number(x: Column) -> Column:
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def zero_int(x: Column) -> Column:
    """Lineup stats: null and non-numbers are zero."""
    return F.coalesce(x.cast("string").try_cast("double").cast("long"), F.lit(0).cast("long"))


def row_share(df: DataFrame, part: Column, whole: Column | None = None) -> DataFrame:
    """Per season the rows of ``whole`` (default all), those of ``part``, and the share."""
    n = F.count("*") if whole is None else F.count_if(whole)
    return df.groupBy("season").agg(n.alias("n"), F.count_if(part).alias("k")).withColumn("share", F.try_divide("k", "n"))


def guard_share(df: DataFrame, part: Column, whole: Column | None = None, low: float = 0.0, high: float = 1.0) -> None:
    """Fails unless every season's share is above ``low`` and below ``high``."""
    bad = row_share(df, part, whole).where(~F.coalesce((F.col("share") > low) & (F.col("share") < high), F.lit(False))).limit(1).collect()
    if bad:
        raise ValueError(f"season {bad[0].season}: {bad[0].k} of {bad[0].n} rows")


# The shares of rows between which a season's starters (of those who pitched) and lineup rows (of all) must be.
STARTER_SHARE, LINEUP_SHARE = (0.0, 0.35), (0.0, 0.7)


def manifest(df: DataFrame) -> DataFrame:
    """Rows and first and last date by season."""
    return df.groupBy("season").agg(F.count("*").alias("rows"), F.min("d").alias("first"), F.max("d").alias("last"))


def corpus_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("season").agg(F.count("*").alias("rows"), F.count_distinct("gid").alias("games"), F.count_distinct("gid", "t").alias("team_games"))


ROWS_OF_FILE = 1_000_000  # at most, in exports
RANGES = "_ranges"  # of the files of an export; readers of the export pass over names that begin so


def write_seasons(df: DataFrame, path: str, kind: str = "json", rows: int = ROWS_OF_FILE) -> None:
    """One folder a season, in files of at most ``rows`` rows; a large season is written by many tasks."""
    dealt = df.repartitionByRange("season", F.xxhash64(*df.columns))
    dealt.write.mode("overwrite").option("maxRecordsPerFile", rows).partitionBy("season").format(kind).save(path)


def export_nested(df: DataFrame, keys: list[str], path: str, kind: str = "json", rows: int = ROWS_OF_FILE) -> None:
    """One document per scheme and entity, with its sorted array of records, in files of at most ``rows`` documents.

    Documents lie in ranges of scheme and entity, so a large scheme is many tasks' work, and a table beside them names each file's range.
    """
    documents = nested(df, keys)
    dealt = documents.repartitionByRange("scheme", *keys).sortWithinPartitions("scheme", *keys)
    dealt.write.mode("overwrite").option("maxRecordsPerFile", rows).partitionBy("scheme").format(kind).save(path)
    spark = df.sparkSession
    held = spark.read.schema(documents.schema).format(kind).load(path).select("scheme", F.struct(*keys).alias("key"), F.col("_metadata.file_path").alias("file"))
    ranges = held.groupBy("scheme", "file").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("documents"))
    ranges.coalesce(1).write.mode("overwrite").parquet(f"{path}/{RANGES}")


def read_export(spark: SparkSession, path: str, schema: T.StructType, scheme: str, key: tuple, kind: str = "json") -> DataFrame:
    """The documents of an entity in a scheme: only files whose range holds it are read."""
    keys = [f.name for f in schema.fields if f.name not in ("scheme", "combos")]
    at = F.struct(*(F.lit(v).cast(schema[k].dataType).alias(k) for k, v in zip(keys, key)))
    held = spark.read.parquet(f"{path}/{RANGES}").where((F.col("scheme") == scheme) & (F.col("low") <= at) & (F.col("high") >= at))
    files = [r.file for r in held.select("file").collect()]
    if not files:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).option("basePath", path).format(kind).load(files)
    return found.where((F.col("scheme") == scheme) & (F.struct(*keys) == at))


def nested(df: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in (*keys, "scheme")]
    return df.groupBy("scheme", *keys).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("combos"))


class Gate:
    """Shares of rows by season that must lie between two bounds, measured on the rows as a build reads them.

    ``watch`` goes around the build's input; once the build is written, ``check`` fails if a season's share of ``part`` among ``whole``
    (default all rows) was not above ``low`` and below ``high``, or if there was a row of another season. No other pass over the rows is made.
    """

    def __init__(self, seasons: list[int], part: Column, whole: Column | None = None, low: float = 0.0, high: float = 1.0):
        self.seasons, self.part, self.whole, self.low, self.high = list(seasons), part, F.lit(True) if whole is None else whole, low, high
        self.seen = Observation()

    def watch(self, rows: DataFrame) -> DataFrame:
        of = lambda s, c: F.count_if((F.col("season") == s) & c)
        told = [x for s in self.seasons for x in (of(s, self.part).alias(f"part_{s}"), of(s, self.whole).alias(f"whole_{s}"))]
        return rows.observe(self.seen, F.count_if(~F.coalesce(F.col("season").isin(*self.seasons), F.lit(False))).alias("others"), *told)

    def check(self) -> dict[int, tuple[int, int]]:
        """The counts by season, after the build."""
        found = self.seen.get
        counts = {s: (found[f"part_{s}"], found[f"whole_{s}"]) for s in self.seasons}
        for s, (part, whole) in counts.items():
            if not (whole and self.low < part / whole < self.high):
                raise ValueError(f"season {s}: {part} of {whole} rows")
        if found["others"]:
            raise ValueError(f"{found['others']} rows of other seasons")
        return counts


class Snapshots:
    """Published versions of a table: the newest is current, ``keep`` stay, and the one before it can be restored.

    Rows are written to a folder of their own first. Only then a version's pointer file is made, exclusively, under the next free number: of two
    publishers at once one goes on to the number after, and a publisher that fails before it leaves the current version as it was. A pointer holds the
    folder, the version that it shows and the one before, and what the publisher says of it, such as rows and reject reasons. Going back is one more
    pointer, to the version before.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 7):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _numbers(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/pointers")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _pointer(self, number: int) -> dict | None:
        """What a pointer tells; nothing if its publisher failed while making it."""
        fs, p = self._fs(f"{self.path}/pointers/{number:08d}")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8") or "null")
        finally:
            stream.close()

    def _point(self, told: dict) -> int:
        """A new pointer under the next free number; whoever makes it first has it."""
        while True:
            number = (self._numbers() or [0])[-1] + 1
            fs, p = self._fs(f"{self.path}/pointers/{number:08d}")
            fs.mkdirs(p.getParent())
            try:
                stream = fs.create(p, False)
            except Py4JJavaError as error:
                if fs.exists(p):
                    continue
                raise error
            try:
                held = self._shown(number - 1)
                stream.write(json.dumps({"version": number, "before": held["number"] if held else None, **told}).encode())
            finally:
                stream.close()
            return number

    def _shown(self, most: int | None = None) -> dict | None:
        """The newest pointer (up to a number) that tells something, with its number."""
        for number in reversed(self._numbers()):
            if (most is None or number <= most) and (told := self._pointer(number)):
                return {"number": number, **told}
        return None

    def _chain(self) -> list[dict]:
        """The current version and those before it, newest first."""
        out, at = [], self._shown()
        while at and len(out) < self.keep:
            fs, p = self._fs(at["folder"])
            if not fs.exists(p):
                break
            out.append(at)
            at = self._shown(at["before"]) if at["before"] else None
        return out

    def versions(self) -> list[int]:
        """The versions that can be read, the current one last."""
        return [p["version"] for p in reversed(self._chain())]

    def publish(self, df: DataFrame, gates: tuple[Gate, ...] = (), **told) -> int:
        """Writes ``df`` and makes it current; the pointer tells its rows and what else is given. If a gate fails, nothing is published and the rows go."""
        folder, seen = f"{self.path}/data/{uuid4().hex}", Observation()
        df.observe(seen, F.count("*").alias("rows")).write.option("compression", "gzip").json(folder)
        try:
            shares = [g.check() for g in gates]
        except ValueError:
            fs, p = self._fs(folder)
            fs.delete(p, True)
            raise
        number = self._point({"folder": folder, "rows": seen.get["rows"], "shares": [{str(s): c for s, c in x.items()} for x in shares], **told})
        kept = {p["folder"] for p in self._chain()}
        for old in filter(None, (self._pointer(n) for n in self._numbers() if n < number)):
            if old["folder"] not in kept:
                fs, p = self._fs(old["folder"])
                fs.delete(p, True)
        return number

    def about(self) -> dict:
        """What the current version's pointer tells."""
        held = self._shown()
        if not held:
            raise ValueError("nothing is published")
        return {k: v for k, v in held.items() if k not in ("number", "before", "folder")}

    def current(self, schema: T.StructType | str) -> DataFrame:
        held = self._shown()
        if not held:
            raise ValueError("nothing is published")
        return self.spark.read.schema(schema).json(held["folder"])

    def roll_back(self) -> int:
        """Makes the version before the current one current again, by a pointer, and returns it."""
        held = self._chain()
        if len(held) < 2:
            raise ValueError("no version to go back to")
        before = {k: v for k, v in held[1].items() if k != "number"}
        self._point(before)
        return before["version"]
