"""WARC archives, index first.

Writers put one gzip member per record into files of the shared folder and return, for each record, file, offset, length,
URL and digest. That index is a table; only files it names count, so a task that runs twice leaves an unread file
and nothing else. Readers take selected index rows sorted by file and offset and merge neighbours into one range read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_id, from_id, new_path, saved, spread_lookup

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, file string, offset long, length long, url string, payload_digest string, record_type string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"

#: Up to so many revisits are sent to all writers (16 bytes each); more meet the pages in a shuffle.
REVISITS_BROADCAST = 500_000


def payload_digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _record(page: int, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, str]:
    digest = payload_digest(hashlib.sha1(payload).digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n", digest


def _parsed(member: bytes) -> tuple:
    raw = zlib.decompress(member, 31)
    at = raw.index(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in raw[:at].decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = raw[at + 4 : at + 4 + int(head["Content-Length"])]
    at = block.index(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in block[:at].decode().split("\r\n")[1:])
    size, digest = int(http["Content-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
    page = int(head["WARC-Record-ID"][10:-1])
    refers_to = int(head["WARC-Refers-To"][10:-1]) if "WARC-Refers-To" in head else None
    payload = None
    if head["WARC-Type"] == "response":
        payload = block[at + 4 :]
        if len(payload) != size or payload_digest(hashlib.sha1(payload).digest()) != digest:
            raise ValueError(f"record of page {page}: its payload does not match its digest")
    url = head.get("WARC-Target-URI")
    return page, url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"), head["WARC-Type"], refers_to, size, digest, payload


def _write(batches: Iterator[pa.RecordBatch], folder: str, level: int) -> Iterator[pa.RecordBatch]:
    out = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if out is None:
            store, path = fs.FileSystem.from_uri(folder)
            store.create_dir(path, recursive=True)
            name, at = f"{path}/{uuid.uuid4().hex}.warc.gz", 0
            out = store.open_output_stream(name, compression=None)
        rows = []
        for page, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4))):
            record, digest = _record(page, url, (html or "").encode("utf-8", "surrogatepass"), refers_to)
            pack = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = pack.compress(record) + pack.flush()
            out.write(member)
            rows.append((page, name.rsplit("/", 1)[1], at, len(member), url, digest, "response" if refers_to is None else "revisit"))
            at += len(member)
        columns = list(zip(*rows))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "file", "offset", "length", "url", "payload_digest", "record_type"])
    if out is not None:
        out.close()


def write_archives(pages: DataFrame, folder: str, min_payload: int = 0, level: int = 3) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html) in ``folder`` and their index, as a saved table.

    Of records with equal payloads of at least ``min_payload`` bytes, those with the smallest page_id are responses and
    the others revisit it. A null html is an empty payload, a null url is left out, a null page_id sorts last and reads
    back as null; repeats of the smallest page_id with the same payload are all responses. Other columns are not read.
    """
    source = pages.select(as_id(F.col("page_id").cast("long")).alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    prints = saved(source.where(F.octet_length("html") >= min_payload).select("page_id", F.unhex(F.sha1(F.col("html").cast("binary"))).alias("digest")), "payloads")
    groups = saved(prints.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "groups")
    revisits = saved(spread_lookup(prints, ["digest"], F.col("page_id"), groups, "n", ["first"]).where("first < page_id").select(F.col("page_id").alias("__page"), F.col("digest").alias("__digest"), F.col("first").alias("refers_to")).distinct(), "revisits")
    few = revisits.count() <= REVISITS_BROADCAST
    digest = F.when(F.octet_length("html") >= min_payload, F.unhex(F.sha1(F.col("html").cast("binary"))))
    linked = source.join(F.broadcast(revisits) if few else revisits, (F.col("page_id") == F.col("__page")) & (digest == F.col("__digest")), "left")
    rows = linked.select("page_id", "url", "html", "refers_to")
    return saved(rows.mapInArrow(lambda batches: _write(batches, folder, level), INDEX), "index")


def _read(batches: Iterator[pa.RecordBatch], folder: str, gap: int, most: int) -> Iterator[pa.RecordBatch]:
    store, path = fs.FileSystem.from_uri(folder)
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    opened: tuple = (None, None)
    for batch in batches:
        wanted = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
        i = 0
        while i < len(wanted):
            file, start, length = wanted[i]
            j, end = i + 1, start + length
            while j < len(wanted) and wanted[j][0] == file and 0 <= wanted[j][1] - end <= gap and wanted[j][1] + wanted[j][2] - start <= most:
                end = wanted[j][1] + wanted[j][2]
                j += 1
            if opened[0] != file:
                opened = (file, store.open_input_file(f"{path}/{file}"))
            data = opened[1].read_at(end - start, start)
            rows = [_parsed(data[o - start : o - start + n]) for _, o, n in wanted[i:j]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
            i = j


def read_records(index: DataFrame, folder: str, gap: int = 64 << 10, most: int = 4 << 20, stretch: int = 16 << 20) -> DataFrame:
    """The records that ``index`` rows name: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    Stretches of ``stretch`` bytes of a file go to one task, sorted, where records at most ``gap`` bytes apart are fetched by one
    read of up to ``most`` bytes (more for a longer record). The payload of a revisit is null; size and digest are
    of the full payload. A response that does not match its digest is an error.
    """
    total = index.agg(F.sum("length")).first()[0] or 0
    part = F.floor(F.col("offset") / stretch)
    # a fixed count: merging partitions by the size of index rows would leave few readers for many bytes
    wanted = index.select("file", "offset", "length").repartition(int(total // stretch) + 1, "file", part).sortWithinPartitions("file", "offset")
    out = wanted.mapInArrow(lambda batches: _read(batches, folder, gap, most), RECORD)
    return out.withColumn("page_id", from_id("page_id")).withColumn("refers_to", from_id("refers_to"))


def archive_folder(spark: SparkSession) -> str:
    return new_path(spark, "warc")
