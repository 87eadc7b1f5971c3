"""WARC archives: whole-file gzip streams, rewritten with one gzip member per record and an offset index.

``write_archives`` lets Spark's text writer produce monolithic archives: one gzip stream over all records of a file,
as careless crawlers leave them. ``normalise`` inflates each stream once, rewrites every record as a gzip member of
its own and writes the index of (offset, length) beside it. ``read_records`` fetches records by that index alone.

Defined results: null html is an empty payload; a null url or id leaves its header out; control characters in a url
are percent-encoded; rows that repeat the id and payload of the response are responses too; columns besides
``page_id``, ``url``, ``html`` are ignored; an empty table gives empty archives and no records. A payload below
``min_bytes`` is always a response. A damaged stream raises an error that names the file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, scratch_path, stage

END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
# Records per monolithic file: bounds what one task inflates and one index holds.
RECORDS_PER_FILE = 20_000
LEVEL = 3


def duplicates(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Payload digests that occur more than once, with the largest id among them."""
    return (
        pages.where(F.octet_length("_payload") >= min_bytes)
        .groupBy("_digest").agg(F.max("page_id").alias("_keeper"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1 AND _keeper IS NOT NULL").select("_digest", "_keeper")
    )


def _line(name: str, value: Column) -> Column:
    """A header line, absent when the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def records(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """One WARC record (column ``value``) per page, without the empty lines that end it."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("_payload"))
    pages = pages.withColumn("_digest", F.sha1(F.col("_payload").cast("binary")))
    # Written, so that its real size decides whether the join broadcasts it; the payloads then stay where they are.
    twins = stage(duplicates(pages, min_bytes), "warc_twins")
    long = F.octet_length("_payload") >= min_bytes
    joined = pages.join(twins, "_digest", "left").withColumn(
        "_revisit", F.coalesce(long & F.col("_keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_keeper")), F.lit(False))
    )
    size = F.octet_length("_payload").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(END))
    block = F.when(F.col("_revisit"), http).otherwise(F.concat(http, F.col("_payload")))
    url = F.col("url")
    for code in [*range(32), 127]:
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("_revisit"), "revisit").otherwise("response"), F.lit("\r\n"),
        _line("WARC-Record-ID", _urn(F.col("page_id"))), _line("WARC-Target-URI", url), F.lit(f"WARC-Date: {DATE}\r\n"),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        _line("WARC-Refers-To", F.when(F.col("_revisit"), _urn(F.col("_keeper")))),
        F.when(F.col("_revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("_block").cast("string"), F.lit(END),
    )
    return joined.withColumn("_block", block).select(F.concat(head, F.col("_block")).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 1000, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Monolithic archives: files of one gzip stream each, written by the executors to any store that Spark writes."""
    (
        records(pages, min_bytes).write.option("compression", "gzip").option("lineSep", END)
        .option("maxRecordsPerFile", records_per_file).option("zlib.compress.level", "BEST_SPEED").text(path)
    )


def split_records(chunks: Iterator[bytes], name: str) -> Iterator[tuple[dict, bytes]]:
    """(headers, whole record) of a WARC byte stream that arrives in chunks."""
    buffer = bytearray()

    def more() -> bool:
        for chunk in chunks:
            if chunk:
                buffer.extend(chunk)
                return True
        return False

    while True:
        while (at := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if buffer.strip():
                    raise ValueError(f"{name}: record cut off in its header")
                return
        lines = bytes(buffer[:at]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"{name}: no WARC record where one should begin")
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        end = at + 4 + int(head["content-length"])
        while len(buffer) < end + 4:
            if not more():
                raise ValueError(f"{name}: record cut off in its block")
        yield head, bytes(buffer[: end + 4])
        del buffer[: end + 4]


def _inflated(content: bytes, name: str, piece: int = 1 << 18) -> Iterator[bytes]:
    """The content of all gzip members of a file, piece by piece."""
    import zlib

    view, at = memoryview(content), 0
    while at < len(view):
        z = zlib.decompressobj(31)
        while not z.eof:
            if at >= len(view):
                raise ValueError(f"{name}: gzip stream cut off")
            part = view[at : at + piece]
            at += len(part)
            yield z.decompress(part)
        at -= len(z.unused_data)


def _gzip(data: bytes, level: int) -> bytes:
    import zlib

    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def normalise(spark: SparkSession, source: str, target: str, level: int = LEVEL) -> None:
    """Rewrite the archives below ``source``: ``target/kind=archive/shard=*`` and ``target/kind=index/shard=*``.

    A file is one shard and one task's work. Spark's text writer ends each row with ``lineSep``; a NUL byte is also the
    last byte of every gzip member below 16 MiB (the high byte of its length), so the writer supplies that byte and
    the file is the plain concatenation of the members. A longer record is followed by an empty member for the same end.
    """
    empty = _gzip(b"", 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        kinds, shards, offsets, data, held = [], [], [], [], 0

        def batch():
            return pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.string()), pa.array(shards, pa.string()), pa.array(offsets, pa.int64()), pa.array(data, pa.binary())],
                names=["kind", "shard", "offset", "data"],
            )

        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                name, content = path.as_py(), content.as_py()
                shard, offset = name.rsplit("/", 1)[1].split(".", 1)[0], 0
                for head, record in split_records(_inflated(content, name), name):
                    member = _gzip(record, level)
                    line = {"offset": offset, "length": len(member), "id": head.get("warc-record-id"), "type": head.get("warc-type"), "digest": head.get("warc-payload-digest")}
                    body = member if member[-1:] == b"\0" else member + empty
                    kinds += ["archive", "index"]
                    shards += [shard, shard]
                    offsets += [offset, offset]
                    data += [body[:-1], json.dumps(line).encode()]
                    offset += len(body)
                    held += len(body)
                    if held > 8 << 20:
                        yield batch()
                        kinds, shards, offsets, data, held = [], [], [], [], 0
        if kinds:
            yield batch()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path", "content")
    rows = files.mapInArrow(run, "kind string, shard string, offset bigint, data binary").sortWithinPartitions("kind", "shard", "offset")
    rows.select("kind", "shard", F.col("data").cast("string")).write.partitionBy("kind", "shard").option("lineSep", "\0").text(target)


INDEX = "offset bigint, length bigint, id string, type string, digest string"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The sidecar index: shard, offset, length, id, type, digest."""
    lines = spark.read.schema("value string, shard string").option("lineSep", "\0").text(f"{path}/kind=index")
    return lines.select("shard", F.from_json("value", INDEX).alias("e")).select("shard", "e.*")


OUT = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, shard string, offset bigint, length bigint"


def read_records(spark: SparkSession, path: str, index: DataFrame | None = None, payloads: bool = False) -> DataFrame:
    """Records of a normalised archive, each inflated alone from the place its index line names.

    ``index`` may be any part of ``read_index``. Digests of responses are computed from the bytes read and compared
    with their headers. ``payloads`` adds the html.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import zlib

        def number(urn):
            return int(urn[len("<urn:page:"):-1]) if urn else None

        for b in batches:
            for shard, content, places in zip(b.column("shard"), b.column("content"), b.column("places"), strict=True):
                shard, content = shard.as_py(), memoryview(content.as_buffer())
                rows = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "shard", "offset", "length", "html")}
                for place in sorted(places.as_py(), key=lambda p: p["offset"]):
                    at, n = place["offset"], place["length"]
                    head, record = next(split_records(iter([zlib.decompress(content[at : at + n], 31)]), shard))
                    block = record[record.index(b"\r\n\r\n") + 4 : -4]
                    http, _, payload = block.partition(b"\r\n\r\n")
                    said = head["warc-payload-digest"].removeprefix("sha1:")
                    if head["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != said:
                        raise ValueError(f"{shard} at {at}: payload does not match its digest")
                    size = int(http.rsplit(b"Content-Length: ", 1)[1])
                    for k, v in (
                        ("page_id", number(head.get("warc-record-id"))), ("payload_bytes", size), ("payload_digest", said), ("record_type", head["warc-type"]),
                        ("refers_to", number(head.get("warc-refers-to"))), ("url", head.get("warc-target-uri")), ("shard", shard), ("offset", at), ("length", n),
                        ("html", payload.decode() if payloads and head["warc-type"] == "response" else None),
                    ):
                        rows[k].append(v)
                if not payloads:
                    del rows["html"]
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([(k, pa.string() if k in ("payload_digest", "record_type", "url", "shard", "html") else pa.int64()) for k in rows]))

    index = read_index(spark, path) if index is None else index
    # At most the records of one file per shard.
    places = index.groupBy("shard").agg(F.collect_list(F.struct("offset", "length")).alias("places"))
    files = spark.read.format("binaryFile").load(f"{path}/kind=archive")
    files = files.select(F.regexp_extract("path", "shard=([^/]*)/", 1).alias("shard"), "content")
    return files.join(places, "shard").select("shard", "content", "places").mapInArrow(run, OUT + (", html string" if payloads else ""))


def archive_pages(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, normalise them, and read every record back by the index."""
    spark = pages.sparkSession
    raw, clean = scratch_path(spark, "warc_raw"), scratch_path(spark, "warc")
    write_archives(pages, raw, min_bytes)
    normalise(spark, raw, clean)
    if pages.isEmpty():
        return spark.createDataFrame([], OUT)
    return read_records(spark, clean)


__all__ = ["archive_pages", "cut", "duplicates", "normalise", "read_index", "read_records", "records", "split_records", "write_archives"]
