"""Shared pieces: reading, the scratch folder, tables that cut lineage, and look-ups that hot keys cannot stall."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than this share of the rows is looked up by broadcast; at most 1 / HEAVY_SHARE keys can have it.
HEAVY_SHARE = 1 / 512

#: Stands for a null document id inside the operators, so that such rows sort last and still join.
NO_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a local master gets a temporary folder; on a cluster that is an error, as executors would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths of the tables written inside each open ``temporary`` block.
_OPEN: list[list[str]] = []


def saved_apart(df: DataFrame, name: str) -> DataFrame:
    """``saved``, but the table outlives an open ``temporary`` block."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, read again: no lineage, and nothing lost with an executor."""
    path = new_path(df.sparkSession, name)
    until_end(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def until_end(folder: str) -> None:
    """The folder is deleted at the end of the open ``temporary`` block, if there is one."""
    for made in _OPEN[-1:]:
        made.append(folder)


def drop_saved(df: DataFrame) -> None:
    """Deletes the files of a table of ``saved`` that nothing will read again."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that ``saved`` writes inside are deleted at the end; what is to last is written by ``saved_apart``."""
    _OPEN.append([])
    try:
        yield
    finally:
        for folder in _OPEN.pop():
            delete(spark, folder)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a variation of it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def as_id(column: str | Column = "doc_id") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(NO_ID).cast("long"))


def from_id(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(NO_ID).cast("long"))


def held_out(doc_id: str | Column = "doc_id", folds: int = 5) -> Column:
    """True where crc32 of the id as text leaves 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def spread_lookup(rows: DataFrame, keys: list[str], row: Column, side: DataFrame, weight: str, values: list[str], total: int | None = None) -> DataFrame:
    """``rows`` left-joined with ``side`` (one row per key; ``weight`` counts the key's rows) for ``values``.

    Keys with more than ``HEAVY_SHARE`` of the rows are broadcast, and there can be at most 512 of them; all
    others meet in a shuffle where no key is large. Rows of the heavy keys get a salt from ``row``, so they
    spread over all tasks. ``side`` should be cheap to read twice. ``total`` is the sum of the weights, if it is known.
    """
    if total is None:
        total = side.agg(F.sum(weight)).first()[0] or 0
    limit = max(1, int(total * HEAVY_SHARE))
    heavy = side.where(F.col(weight) > limit).select(*(F.col(k).alias(f"__h_{k}") for k in keys), F.struct(*values).alias("__heavy"))
    light = side.where(F.col(weight) <= limit).select(*(F.col(k).alias(f"__l_{k}") for k in keys), F.lit(0).alias("__l_salt"), F.struct(*values).alias("__light"))
    out = rows
    on = [F.col(k) == F.col(f"__h_{k}") for k in keys]
    out = out.join(F.broadcast(heavy), on, "left")
    out = out.withColumn("__salt", F.when(F.col("__heavy").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.hash(row), F.lit(1 << 20))))
    out = out.join(light, [*(F.col(k) == F.col(f"__l_{k}") for k in keys), F.col("__salt") == F.col("__l_salt")], "left")
    return out.select(*rows.columns, *(F.coalesce(F.col(f"__heavy.{v}"), F.col(f"__light.{v}")).alias(v) for v in values))


def spread_join(rows: DataFrame, key: str, side: DataFrame, weight: str) -> DataFrame:
    """``rows`` joined with ``side`` (one row per key; ``weight`` counts the key's rows), for sides that few rows have a key in.

    Keys with more than ``HEAVY_SHARE`` of the joined rows (at most 512, named in the plan) are joined apart by broadcast, so that rows without a key in ``side`` leave no join.
    """
    limit = max(1, int((side.agg(F.sum(weight)).first()[0] or 0) * HEAVY_SHARE))
    heavy = [r[0] for r in side.where(F.col(weight) > limit).select(key).collect()]
    if not heavy:
        return rows.join(side, key)
    hot = F.col(key).isin(heavy)
    return rows.where(~hot).join(side.where(F.col(weight) <= limit), key).union(rows.where(hot).join(F.broadcast(side.where(F.col(weight) > limit)), key))


def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes on what a task yields, and at its end gives back the memory that it has freed: a worker lives on and serves other stages beside it."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # where the C library has it
            ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches hold about 4 MB, and not 10,000 texts of any length: a task has a batch several times over, in the JVM and in Python."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` with one output batch, or none, per input batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if (out := f(batch)) is not None:
                yield out

    return df.mapInArrow(lambda batches: freed(each(batches)), schema)
