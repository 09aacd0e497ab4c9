"""Web archives: written by Spark, indexed first, read back by coalesced byte ranges.

Archives are files of WARC 1.1 records, each ending in CR LF CR LF, which is the
line separator of Spark's text writer; its commit protocol covers lost executors
and any Hadoop file system.  The index holds file, offset, length, URL and digest
per record and is a Parquet table.  A read takes any selection of index rows,
sorts it by file and offset in stripes of a file, joins near ranges into one read
and checks every payload against its digest.

Tasks open archives with ``pyarrow.fs``, so archives must lie in a file system it
knows (local or mounted folders, hdfs, s3, gs, abfs).

Defined cases: null html is an empty payload; a null URL leaves its header out;
null ids stay null and are never the kept copy while another has an id; all rows
with the largest id of equal payloads are responses; an empty table gives an empty
archive, index and result.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow import session

CRLF = "\r\n"
END = "\r\n\r\n"
MIN_REVISIT_BYTES = 1000
MAX_GAP = 64 << 10
MAX_RANGE = 8 << 20
STRIPE = 64 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX_SCHEMA = "file string, offset long, length long, record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to long"
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Pages with payload, digest and the page that each repeats (null for responses).

    Only ids and digests are shuffled to find repeats.  The list of repeated
    digests meets the payloads by broadcast if its measured size allows.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    groups = rows.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("kept"))
    repeated = groups.where("n > 1 and kept is not null").select("digest", "kept")
    repeated, seen = session.measure(repeated, "repeats")
    joined = rows.join(session.broadcast_if_small(repeated, seen), "digest", "left")
    again = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return joined.select("page_id", "url", "payload", "digest", "size", F.when(again, F.col("kept")).alias("refers_to"))


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("/", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))).otherwise(F.lit(""))


def write(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """One record per page; a page whose payload stands elsewhere becomes a revisit record."""
    rows = with_revisits(pages, min_bytes)
    revisit = F.col("refers_to").isNotNull()
    # Control characters would end a header line.
    url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    record_id = _uuid(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("digest"))
    refers = F.when(revisit, _uuid(F.col("refers_to").cast("string"), F.col("digest")))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", record_id),
        _header("WARC-Date", F.lit(DATE)),
        _header("WARC-Target-URI", url),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Refers-To", refers),
        _header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _header("X-Page-Id", F.col("page_id")),
        _header("X-Refers-To-Page-Id", F.col("refers_to")),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length(block)),
        F.lit(CRLF),
    )
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", END).text(path)


def _open(path: str) -> io.BufferedReader:
    if path.startswith("file:"):
        filesystem, name = pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    else:
        filesystem, name = pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return io.BufferedReader(filesystem.open_input_file(name), 1 << 20)


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (line.split(b": ", 1) for line in lines.split(b"\r\n")[1:] if b": " in line)
    return {k.decode().lower(): v.decode("utf-8") for k, v in pairs}


def _read_head(stream) -> bytes:
    """Bytes up to and with the next empty line."""
    lines = []
    while line := stream.readline():
        lines.append(line)
        if line == b"\r\n":
            break
    return b"".join(lines)


def _number(text: str | None) -> int | None:
    return int(text) if text is not None else None


def _index_file(path: str) -> Iterator[tuple]:
    with _open(path) as stream:
        offset = 0
        while head := _read_head(stream):
            fields = _fields(head)
            size = int(fields["content-length"])
            http = _fields(_read_head(stream))
            length = len(head) + size + len(END)
            digest = fields["warc-payload-digest"].removeprefix("sha1:")
            yield path, offset, length, fields["warc-type"], _number(fields.get("x-page-id")), fields.get("warc-target-uri"), digest, int(http["content-length"]), _number(fields.get("x-refers-to-page-id"))
            offset += length
            stream.seek(offset)


def _batches(rows: Iterator[tuple], names: list[str], schema: pa.Schema, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    kept, size = [], 0
    for row in rows:
        kept.append(row)
        size += 100 + sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if size > max_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*kept), schema)], names)
            kept, size = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*kept), schema)], names)


INDEX_ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64())])
RECORD_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def build_index(spark: SparkSession, archives: str, index: str) -> DataFrame:
    """Write and return the index of all records below ``archives``; one task per few files, payloads are skipped by seeking."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield from _batches(_index_file(path), INDEX_ARROW.names, INDEX_ARROW)

    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(archives).where("length > 0").select("path")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        files = spark.createDataFrame([], "path string")
    files.repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(run, INDEX_SCHEMA).write.mode("overwrite").parquet(index)
    return spark.read.schema(INDEX_SCHEMA).parquet(index)


def _ranges(rows: Iterator[dict]) -> Iterator[list[dict]]:
    """Runs of sorted index rows that one read covers."""
    run: list[dict] = []
    for row in rows:
        if run:
            stop = run[-1]["offset"] + run[-1]["length"]
            near = row["file"] == run[0]["file"] and row["offset"] - stop <= MAX_GAP
            if not near or row["offset"] + row["length"] - run[0]["offset"] > MAX_RANGE:
                yield run
                run = []
        run.append(row)
    if run:
        yield run


def read(selected: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the selected index rows, their payloads checked against size and digest."""

    def records(rows: Iterator[dict]) -> Iterator[tuple]:
        name, stream = None, None
        for run in _ranges(rows):
            if run[0]["file"] != name:
                if stream:
                    stream.close()
                name = run[0]["file"]
                stream = _open(name)
            begin = run[0]["offset"]
            stream.seek(begin)
            block = stream.read(run[-1]["offset"] + run[-1]["length"] - begin)
            for row in run:
                record = io.BytesIO(block[row["offset"] - begin : row["offset"] - begin + row["length"] - len(END)])
                fields = _fields(_read_head(record))
                http = _fields(_read_head(record))
                payload = record.read()
                size, digest = int(http["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
                if fields["warc-type"] == "response":
                    size, found = len(payload), hashlib.sha1(payload).hexdigest()
                    if found != row["payload_digest"] or size != row["payload_bytes"]:
                        raise ValueError(f"{name} at {row['offset']}: the payload does not fit its digest")
                yield _number(fields.get("x-page-id")), fields.get("warc-target-uri"), size, digest, fields["warc-type"], _number(fields.get("x-refers-to-page-id")), payload if payloads else None
        if stream:
            stream.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        yield from _batches(records(rows), RECORD_ARROW.names, RECORD_ARROW)

    striped = selected.select("file", "offset", "length", "payload_digest", "payload_bytes")
    total = selected.agg(F.sum("length")).first()[0] or 0
    parts = max(selected.sparkSession.sparkContext.defaultParallelism, -(-total // STRIPE))
    striped = striped.repartition(parts, "file", F.floor(F.col("offset") / STRIPE)).sortWithinPartitions("file", "offset")
    return striped.mapInArrow(run, RECORD_SCHEMA)
