"""WARC archives: round trips, what the files look like, and what damage the reader notices."""

import base64
import gzip
import hashlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from boxspark.llm import warc

PAGES = "page_id bigint, url string, html string"


def brute(rows, least=0):
    data = [(i, u, (t or "").encode()) for i, u, t in rows]
    winners = {}
    for n, (i, u, d) in enumerate(data):
        key = (i is None, i or 0, u is None, u or "", n)
        if len(d) >= least and (d not in winners or key < winners[d]):
            winners[d] = key
    out = []
    for n, (i, u, d) in enumerate(data):
        response = len(d) < least or winners[d][-1] == n
        out.append((i, len(d), base64.b32encode(hashlib.sha1(d).digest()).decode(), "response" if response else "revisit", None if response else data[winners[d][-1]][0]))
    return Counter(out)


@pytest.fixture(scope="module")
def rows():
    rows = [(i, f"http://x.example/{i}", f"<p>page {i % 17} é\r\n\r\nWARC/1.1\r\n0\r\n\r\n") for i in range(60)]
    rows += [(100, None, None), (101, "", ""), (None, "http://n", None), (None, None, "only null ids"), (None, None, "only null ids"), (102, "u\r\nX: y", "long é" * 30_000), (103, "u2", "long é" * 30_000)]
    rows += [(104, "b", "same id"), (104, "a", "same id"), (105, "r", "same row")] + [(105, "r", "same row")] * 3 + [(-7, "z", "x" * 500), (106, "z", "x" * 499)]
    return rows


@pytest.mark.parametrize("least, segment, chunk, archive", [(0, 256_000, 8_192, 16_000_000), (0, 301, 64, 20_000), (60, 1_000, 1, 50_000), (10**9, 64, 7, 10**6)])
def test_round_trip(spark, rows, least, segment, chunk, archive):
    few = rows if segment > 300 else [(i, u, t if t is None else t[:2_000]) for i, u, t in rows]
    pages = spark.createDataFrame(few, PAGES).withColumn("digest", F.lit("clash")).withColumn("payload", F.lit(1)).withColumn("_key", F.lit(2)).withColumn("_id", F.lit(3))
    got = warc.round_trip(pages, least_bytes=least, segment_bytes=segment, chunk_bytes=chunk, archive_bytes=archive)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] and dict(got.dtypes)["page_id"] == "bigint"
    assert Counter(tuple(r) for r in got.collect()) == brute(few, least)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_ids_of_text(spark):
    pages = spark.createDataFrame([("a b\r\n: c", None, "x"), ("", None, "x"), ("é", None, "y")], "page_id string, url string, html string")
    assert {(r.page_id, r.refers_to) for r in warc.round_trip(pages).collect()} == {("", None), ("a b\r\n: c", ""), ("é", None)}


@pytest.fixture(scope="module")
def archives(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "out")
    warc.write_archives(spark.createDataFrame(rows, PAGES), path, segment_bytes=50_000, archive_bytes=100_000, compression="none")
    return path


def test_files(spark, rows, archives):
    """Segments of a page lie in several files, payloads come back whole, every record states what the format asks for."""
    files = [p.read_bytes() for p in Path(archives).glob("part-*")]
    held = [list(warc.records(f)) for f in files]
    assert all(f.endswith(b"\r\n\r\n") for f in files if f) and sum(map(len, held)) >= len(rows)
    ids = Counter(f["warc-record-id"] for some in held for f, _ in some)
    assert max(ids.values()) == 1
    page = [(n, f) for n, some in enumerate(held) for f, _ in some if f.get("x-page-id") == "102" and "warc-segment-number" in f]
    assert sorted(int(f["warc-segment-number"]) for _, f in page) == [1, 2, 3, 4, 5] and len({n for n, _ in page}) > 1
    assert sum("warc-segment-total-length" in f for _, f in page) == 1
    for f, block in (x for some in held for x in some):
        assert f["warc-target-uri"] and int(f["content-length"]) == len(block)
        assert f["warc-type"] != "revisit" or (f["warc-profile"] == warc.PROFILE and f["warc-refers-to"] in ids and not block)
    read = warc.read_pages(spark, archives, payloads=True).where("page_id IS NOT NULL").collect()
    wanted = {(i, (t or "").encode()) for i, _, t in rows if i is not None}
    assert {(int(r.page_id), bytes(r.payload)) for r in read} == wanted


def _changed(archives, tmp_path, change):
    for p in Path(archives).glob("part-*"):
        (tmp_path / p.name).write_bytes(change(p.read_bytes()))
    return str(tmp_path)


@pytest.mark.parametrize("old, new, says", [
    (b"WARC-Segment-Number: 3\r\n", b"WARC-Segment-Number: 9\r\n", "segment 4 after 2"),
    (b"WARC-Segment-Total-Length: 2", b"WARC-Segment-Total-Length: 3", "bytes of"),
    (b"<p>page 3", b"<p>page X", "block digest"),
    (b"WARC-Refers-To: <urn:uuid:", b"WARC-Refers-To: <urn:uuid:0", "a revisit of nothing"),
])
def test_damage(spark, archives, tmp_path, old, new, says):
    path = _changed(archives, tmp_path, lambda data: data.replace(old, new))
    found = warc.read_pages(spark, path, strict=False).where("problem IS NOT NULL").select("problem").distinct().collect()
    assert any(says in r.problem for r in found)
    with pytest.raises(Exception, match="damaged archive"):
        warc.read_pages(spark, path).collect()


def test_a_file_that_ends_early(spark, archives, tmp_path):
    path = _changed(archives, tmp_path, lambda data: data[:-20])
    assert any(r.problem.startswith("file: ") for r in warc.read_pages(spark, path, strict=False).where("problem IS NOT NULL").collect())


def test_framing_across_segments():
    data = bytes(range(256)) * 40
    block = warc.HTTP_HEAD + warc.chunked(data, 300)
    for size in (1, 7, 301, len(block)):
        page = warc.Page(True)
        for n, at in enumerate(range(0, len(block), size), 1):
            page.feed(warc.base32(hashlib.sha1(data).digest()), n, len(block) if at + size >= len(block) else None, block[at : at + size], None)
        assert page.found() == (len(data), warc.base32(hashlib.sha1(data).digest()), data, None)
    cut = warc.Page(False)
    cut.feed("", 1, len(block) - 5, block[:-5], None)
    assert cut.found()[-1] == "the framing does not end"


def test_gzip_members():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    assert [b for _, b in warc.records(gzip.compress(record) + gzip.compress(record))] == [b"abcd"] * 2
