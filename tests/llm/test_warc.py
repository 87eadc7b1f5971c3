import glob
import gzip
import hashlib
import zlib

import pytest
from helpers import PAGES, rows_of

from kgspark.llm.common import scratch_path
from kgspark.llm.warc import archive_pages, normalise, read_index, read_records, split_records, write_archives

BIG, BIGGER = "x" * 1000, "é€" * 700 + "\r\n\r\nWARC/1.1\r\n"


def paths(spark):
    return [scratch_path(spark, n).removeprefix("file://") for n in ("raw", "clean")]


def test_revisits_and_odd_rows(spark):
    rows = [
        (1, "http://a", BIG), (2, "http://b\r\nX: y", BIG), (3, None, BIG), (4, "u", "x" * 999), (5, "u", "x" * 999), (6, "u", None), (7, "u", ""),
        (8, "u", BIGGER), (8, "u", BIGGER), (9, "u", "only"), (None, "u", BIG), (10, "u", "\x00 nul"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], PAGES + ", payload_bytes string")
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = []
    for i, _, h in rows:
        revisit = h == BIG and i != 3
        want.append((i, len((h or "").encode()), sha(h), "revisit" if revisit else "response", 3 if revisit else None))
    assert rows_of(archive_pages(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    assert archive_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_every_record_is_its_own_member(spark):
    raw, clean = paths(spark)
    rows = [(i, f"http://h/{i}", f"<p>{'word ' * (i % 50)}{i}</p>") for i in range(300)]
    write_archives(spark.createDataFrame(rows, PAGES).repartition(3), raw, records_per_file=40)
    before = {}
    for f in glob.glob(f"{raw}/*.gz"):
        data = open(f, "rb").read()
        z = zlib.decompressobj(31)
        text = z.decompress(data)
        assert z.eof and not z.unused_data  # one stream for the whole file
        before[f.rsplit("/", 1)[1].split(".")[0]] = text
    assert len(before) >= 8
    normalise(spark, raw, clean)
    index = read_index(spark, clean).collect()
    assert len(index) == 300 and {r["shard"] for r in index} == set(before)
    for shard, text in before.items():
        [f] = glob.glob(f"{clean}/kind=archive/shard={shard}/*.txt")
        data = open(f, "rb").read()
        assert gzip.decompress(data) == text
        lines = sorted((r["offset"], r["length"]) for r in index if r["shard"] == shard)
        assert [o for o, _ in lines] == [0, *(sum(n for _, n in lines[: k + 1]) for k in range(len(lines) - 1))]
        assert b"".join(zlib.decompress(data[o : o + n], 31) for o, n in lines) == text
    # Part of the index fetches part of the records, with their payloads.
    part = read_records(spark, clean, read_index(spark, clean).where("id IN ('<urn:page:7>', '<urn:page:299>')"), payloads=True)
    assert rows_of(part, "page_id", "html") == [(299, rows[299][2]), (7, rows[7][2])]


def test_long_records_keep_the_file_a_plain_concatenation(spark):
    raw, clean = paths(spark)
    rows = [(1, "u", "a" * (17 << 20)), (2, "u", "b"), (3, "u", "c" * ((16 << 20) + 5))]
    write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), raw)
    normalise(spark, raw, clean)
    got = rows_of(read_records(spark, clean), "page_id", "payload_bytes")
    assert got == [(1, 17 << 20), (2, 1), (3, (16 << 20) + 5)]
    for f in glob.glob(f"{clean}/kind=archive/*/*.txt"):
        assert len(gzip.open(f).read()) > 33 << 20


def test_chunks_and_damage():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    stream = record * 3
    for n in (1, 7, len(stream)):
        found = list(split_records(iter([stream[i : i + n] for i in range(0, len(stream), n)]), "f"))
        assert [r for _, r in found] == [record] * 3
    for bad in (stream[:-6], stream + b"WARC/1.1\r\n", b"junk\r\n\r\n"):
        with pytest.raises(ValueError):
            list(split_records(iter([bad]), "f"))
