"""WARC archives: written from pages with Spark's text writer, read back by segment reassembly.

Writing. A page's block is an HTTP response whose payload travels in chunked transfer framing. A block longer than
``segment_bytes`` is cut into segments: the first is the ``response`` record, the others are ``continuation`` records that name
it as their origin, carry their segment number and, the last one, the total length. Records are dealt over archives one by one,
so a page's segments lie in several files. A record ends with two line ends, which is the line separator given to Spark's text
writer: archives are written by its committer, on any file system that Spark writes to, and a lost task leaves no half file.
Of equal payloads one record is the response; the others are ``revisit`` records, which refer to it and have no payload.

Reading. Every archive is parsed by the lengths that its records state. Records of one origin meet, ordered by segment number;
numbers must run from 1 without a gap and lengths must add up to the total. Then the HTTP head is taken off and the chunked
framing is decoded, segment by segment, with the digest as a running sum. Revisits get what they refer to by its record id.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxspark.llm.common import new_path, stage, with_facts

#: Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
#: A segment's and a chunk's largest size, and about the size of an archive before compression.
SEGMENT_BYTES, CHUNK_BYTES, ARCHIVE_BYTES = 256_000, 8_192, 16_000_000
PAGES = "record_id string, page_id string, payload_bytes long, digest string, payload binary, problem string"
READ = "record_id string, kind string, page_id string, payload_bytes long, digest string, payload binary, problem string, refers_to_id string, segment int, origin_id string, total long, block binary"
SEGMENTS = "_id string, _url string, _key string, _record string, _digest string, _segment int, _segments int, _total long, _block binary, _block_digest string"
ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


class Damaged(ValueError):
    """An archive that does not hold what its records say."""


def base32(data: bytes) -> str:
    return base64.b32encode(data).decode()


def base32_of_hex(digest: Column) -> Column:
    """Base32 of 40 hex digits: eight groups of five hex digits are four letters each."""
    letters = []
    for at in range(1, 41, 5):
        value = F.conv(F.substring(digest, at, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def chunked(payload: bytes, size: int) -> bytes:
    """The payload in chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%X\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def uuid_of(*parts: Column) -> Column:
    """A record id made of what tells the record from all others, so that a task that runs again writes the same one."""
    h = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))))


def _head(fields: list[tuple[str, Column]]) -> Column:
    """A record's head; fields that are null are left out."""
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit("")) for name, value in fields]
    return F.concat(F.lit(f"{VERSION}\r\n"), *lines, F.lit("\r\n"))


def _uri(url: Column) -> Column:
    """A URL fit for a header line: no white space or control characters."""
    return F.coalesce(F.nullif(F.regexp_replace(url, r"[\x00-\x20\x7F]", ""), F.lit("")), F.lit("about:blank"))


def _batches(rows: Iterator[tuple], schema: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``most`` bytes."""
    names, kinds = zip(*(part.split() for part in schema.split(", ")))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, ARROW[kind]) for x, kind in zip(zip(*rows), kinds)], list(names))

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(len(x) for x in row if isinstance(x, bytes))
        if size > most:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def _cut(segment_bytes: int, chunk_bytes: int):
    """Payloads framed and cut into segments (SEGMENTS)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for *known, payload in zip(*(batch.column(c).to_pylist() for c in ("_id", "_url", "_key", "_record")), batch.column("_payload")):
                    data = payload.as_py()
                    block, digest = HTTP_HEAD + chunked(data, chunk_bytes), base32(hashlib.sha1(data).digest())
                    n = -(-len(block) // segment_bytes)
                    for k in range(n):
                        part = block[k * segment_bytes : (k + 1) * segment_bytes]
                        yield *known, digest, k + 1, n, len(block), part, base32(hashlib.sha1(part).digest())

        yield from _batches(rows(), SEGMENTS)

    return run


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least_bytes: int = 0,
    segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, archive_bytes: int = ARCHIVE_BYTES, compression: str = "gzip",
) -> None:
    """Writes a record a row of ``pages`` into archives under ``path``; continuation records follow long ones.

    Of equal payloads of ``least_bytes`` or more the row with the smallest id is the response and the others revisit it; shorter
    ones are all responses. A null text is an empty payload; null ids come after all others, so one is a response only where its
    payload has no other id; of rows that repeat the winning id, one is the response (of the smallest URL, null last). A null or
    empty URL is written as about:blank. An empty table writes an empty archive. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("_payload"))
    rows = rows.withColumn("_key", F.sha2("_payload", 256)).withColumn("_sha1", F.sha1("_payload"))
    size = F.octet_length("_payload")

    # Small rows first: each different (payload, id, URL) with its number, and of each payload that several rows have the winner.
    same = stage(rows.groupBy("_key", "_id", "_url").agg(F.count(F.lit(1)).alias("_n"), F.max(size).alias("_bytes"), F.max("_sha1").alias("_sha1")), "warc-rows")
    winner = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_url").isNull().alias("bare"), F.col("_url").alias("url"), F.col("_n").alias("n")))
    groups = same.where(F.col("_bytes") >= least_bytes).groupBy("_key").agg(F.sum("_n").alias("rows"), F.max("_bytes").alias("bytes"), winner.alias("w")).where("rows > 1")
    groups = stage(groups.select("_key", "rows", "bytes", F.col("w.id").alias("id"), F.col("w.url").alias("url"), F.col("w.n").alias("n")), "warc-groups")
    total = same.agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_bytes")).alias("bytes")).first()
    archives = max(1, -(-int(total["bytes"] or 0) // archive_bytes))
    record = lambda key, i, url: uuid_of(F.lit("response"), key, i, url)
    wins = F.col("_id").eqNullSafe(F.col("_fact.id")) & F.col("_url").eqNullSafe(F.col("_fact.url"))

    # Responses: payloads are framed and cut where they are read, and travel once, to their archive.
    named = rows.withColumn("_record", F.when(size >= least_bytes, record(F.col("_key"), F.col("_id"), F.col("_url"))).otherwise(uuid_of(F.lit("row"), F.col("_key"), F.col("_id"), F.monotonically_increasing_id())))
    segments = named.select(F.col("_id").cast("string").alias("_id"), "_url", "_key", "_record", "_payload").mapInArrow(_cut(segment_bytes, chunk_bytes), SEGMENTS)
    # A payload's fact is there for each of its segments, so that segments of one page go to different archives.
    most = F.ceil((len(HTTP_HEAD) + 5 + F.col("bytes") + 20 * (1 + F.col("bytes") / chunk_bytes)) / segment_bytes).cast("int")
    known = groups.withColumn("id", F.col("id").cast("string")).withColumn("_segment", F.explode(F.sequence(F.lit(1), most)))
    asked = known.agg(F.sum("rows").alias("n")).first()["n"] or 0
    found = with_facts(segments, known, ["_key", "_segment"], "rows", int(asked), F.xxhash64("_record", "_segment"), archives)
    responses = found.where(F.col("_fact").isNull() | wins)
    if not groups.where("n > 1").isEmpty():  # the winning row itself comes several times: its equal records are one
        often = responses.where(F.coalesce(F.col("_fact.n") > 1, F.lit(False)))
        once = often.groupBy("_record", "_segment").agg(*(F.first(c).alias(c) for c in often.columns if c not in ("_record", "_segment"))).select(*often.columns)
        responses = responses.where(~F.coalesce(F.col("_fact.n") > 1, F.lit(False))).unionByName(once)
    first, last, whole = F.col("_segment") == 1, F.col("_segment") == F.col("_segments"), F.col("_segments") == 1
    own = F.when(first, F.col("_record")).otherwise(uuid_of(F.lit("continuation"), F.col("_record"), F.col("_segment")))
    head = _head([
        ("WARC-Type", F.when(first, F.lit("response")).otherwise(F.lit("continuation"))), ("WARC-Record-ID", own), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", _uri(F.col("_url"))),
        ("X-Page-ID", F.url_encode("_id")), ("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), "_digest"))), ("WARC-Block-Digest", F.concat(F.lit("sha1:"), "_block_digest")),
        ("WARC-Segment-Number", F.when(~whole, F.col("_segment"))), ("WARC-Segment-Origin-ID", F.when(~first, F.col("_record"))), ("WARC-Segment-Total-Length", F.when(~whole & last, F.col("_total"))),
        ("Content-Type", F.when(first, F.lit("application/http; msgtype=response"))), ("Content-Length", F.octet_length("_block")),
    ])
    responses = responses.select(F.concat(head.cast("binary"), "_block").alias("record"), own.alias("_own"))

    # Revisits come from the small rows alone.
    asked = with_facts(same, groups, ["_key"], "rows", int(total["n"] or 0), F.xxhash64("_id", "_url")).where("_fact IS NOT NULL")
    turn = asked.withColumn("_turn", F.explode(F.expr(f"filter(sequence(1L, _n), x -> NOT (x = 1 AND {'_id <=> _fact.id AND _url <=> _fact.url'}))")))
    own = uuid_of(F.lit("revisit"), F.col("_key"), F.col("_id"), F.col("_url"), F.col("_turn"))
    head = _head([
        ("WARC-Type", F.lit("revisit")), ("WARC-Record-ID", own), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", _uri(F.col("_url"))), ("X-Page-ID", F.url_encode(F.col("_id").cast("string"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("_sha1")))), ("WARC-Profile", F.lit(PROFILE)),
        ("WARC-Refers-To", record(F.col("_key"), F.col("_fact.id"), F.col("_fact.url"))), ("WARC-Refers-To-Target-URI", _uri(F.col("_fact.url"))), ("WARC-Refers-To-Date", F.lit(DATE)),
        ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", F.lit(0)),
    ])
    revisits = turn.select(head.cast("binary").alias("record"), own.alias("_own"))

    # The text writer takes a value's bytes as they are.
    many = max(1, -(-int(total["n"] or 0) // 500_000))
    dealt = responses.drop("_own").unionByName(revisits.repartition(many, "_own").drop("_own"))
    dealt.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive, plain or in gzip members. Field names are in lower case."""
    with gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content) as f:
        while line := f.readline():
            if line == b"\r\n":
                continue
            if not line.startswith(b"WARC/"):
                raise Damaged(f"not the beginning of a record: {line[:40]!r}")
            fields = {}
            while (line := f.readline()) not in (b"\r\n", b""):
                name, _, value = line.decode(errors="replace").partition(":")
                fields[name.strip().lower()] = value.strip()
            size = int(fields.get("content-length", -1))
            block = f.read(size) if size >= 0 else b""
            if size < 0 or len(block) < size:
                raise Damaged(f"record {fields.get('warc-record-id')} ends early")
            yield fields, block


def _row(f: dict[str, str], block: bytes, keep: bool) -> tuple:
    """What an archive's record says (READ). A record that is whole is decoded at once; segments keep their block."""
    stated = f.get("warc-segment-number")
    digest, kind, own = f.get("warc-block-digest", ""), f.get("warc-type"), f.get("warc-record-id")
    problem = "block digest" if digest.startswith("sha1:") and digest[5:] != base32(hashlib.sha1(block).digest()) else None
    said = f.get("warc-payload-digest", "").removeprefix("sha1:")
    total = int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None
    if kind == "response" and stated is None:
        page = Page(keep)
        page.feed(said, 1, len(block), block, problem)
        return own, kind, f.get("x-page-id"), *page.found(), None, None, None, None, None
    return own, kind, f.get("x-page-id"), None, said, None, problem, f.get("warc-refers-to"), int(stated or 1), f.get("warc-segment-origin-id") or own, total, block if stated else None


def read_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row a record of the archives under ``path`` (READ), payloads of whole responses decoded, and kept if asked for.
    ``problem`` says what is wrong with a record; a row without kind says what is wrong with a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(content: bytes) -> Iterator[tuple]:
            try:
                for f, block in records(content):
                    yield _row(f, block, payloads)
            except (Damaged, OSError, EOFError, ValueError) as e:
                yield None, None, None, None, None, None, f"file: {e}", None, None, None, None, None

        for batch in batches:
            for content in batch.column("content"):
                yield from _batches(rows(content.as_py()), READ)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, READ)


class Page:
    """One origin's segments, fed in order: lengths and numbers are verified, the framing is decoded as it comes."""

    def __init__(self, keep: bool):
        self.digest, self.size, self.kept = hashlib.sha1(), 0, bytearray() if keep else None
        self.segment = self.length = 0
        self.total = self.problem = self.stated = None
        self.rest, self.state, self.left = b"", "head", 0

    def feed(self, digest: str, segment: int, total: int | None, block: bytes, problem: str | None) -> None:
        self.problem = self.problem or problem
        if segment != self.segment + 1:
            self.problem = self.problem or f"segment {segment} after {self.segment}"
        if segment == 1:
            self.stated = digest
        self.segment, self.length, self.total = segment, self.length + len(block), total if total is not None else self.total
        if not self.problem:
            self.decode(block)

    def take(self, data: bytes) -> None:
        self.digest.update(data)
        self.size += len(data)
        if self.kept is not None:
            self.kept += data

    def decode(self, block: bytes) -> None:
        """HTTP head, then per chunk its size, its bytes and a line end, till the chunk of size 0 and its last line."""
        data, at = self.rest + block, 0
        while self.state != "end":
            if self.state == "head":
                found = data.find(b"\r\n\r\n", at)
                if found < 0:
                    break
                self.state = "size" if b"transfer-encoding: chunked" in data[at:found].lower() else "plain"
                at = found + 4
            elif self.state == "plain":
                self.take(data[at:])
                at = len(data)
                break
            elif self.state == "size":
                found = data.find(b"\r\n", at)
                if found < 0:
                    break
                try:
                    self.left = int(data[at:found].split(b";")[0], 16)
                except ValueError:
                    self.problem = self.problem or "chunk size"
                    break
                at, self.state = found + 2, "data" if self.left else "trailer"
            elif self.state == "data":
                some = data[at : at + self.left]
                self.take(some)
                at, self.left = at + len(some), self.left - len(some)
                if self.left:
                    break
                self.state = "line"
            else:  # a line end behind a chunk's bytes, or behind the last chunk
                if len(data) < at + 2:
                    break
                if data[at : at + 2] != b"\r\n":
                    self.problem = self.problem or "chunk end"
                    break
                at, self.state = at + 2, "size" if self.state == "line" else "end"
        self.rest = data[at:]

    def found(self) -> tuple:
        """payload_bytes, digest, payload, problem."""
        digest = base32(self.digest.digest())
        problem = (
            self.problem or (None if self.total is not None else "the last segment is missing") or (None if self.length == self.total else f"{self.length} bytes of {self.total}")
            or (None if self.state in ("end", "plain") and not self.rest else "the framing does not end") or (None if digest == self.stated else "payload digest")
        )
        return self.size, digest, bytes(self.kept) if self.kept is not None else None, problem


def reassembled(segments: DataFrame, payloads: bool = False) -> DataFrame:
    """record_id, page_id, payload_bytes, digest, payload, problem: a row an origin, its segments put together. Without payloads
    a page's size does not matter: one segment is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            page = origin = page_id = None
            for batch in batches:
                columns = (batch.column(c).to_pylist() for c in ("origin_id", "page_id", "digest", "segment", "total", "block", "problem"))
                for now, who, *row in zip(*columns):
                    if page is None or now != origin:
                        if page is not None:
                            yield origin, page_id, *page.found()
                        page, origin, page_id = Page(payloads), now, who
                    page.feed(*row)
            if page is not None:
                yield origin, page_id, *page.found()

        yield from _batches(rows(), PAGES)

    return segments.repartition("origin_id").sortWithinPartitions("origin_id", "segment").mapInArrow(run, PAGES)


def read_pages(spark: SparkSession, path: str, strict: bool = True, payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (page_id of the response), payload, problem: a row a page.

    ``strict`` raises where an archive is damaged; else ``problem`` says what is wrong: a file that ends early (record_type is
    null then), a block's or payload's digest, a gap between segments, a wrong total length, framing that does not end, a
    revisit of nothing. Several records with one page id stay several rows. An empty archive gives no row."""
    found = stage(read_records(spark, path, payloads), "warc-read")  # archives are parsed once
    same = [c.split()[0] for c in PAGES.split(", ")]
    responses = found.where("kind = 'response' AND block IS NULL").select(same).unionByName(reassembled(found.where("block IS NOT NULL"), payloads).select(same))
    responses = stage(responses, "warc-responses")
    whole = responses.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to"), "payload", "problem")
    revisits = found.where("kind = 'revisit'").select("page_id", "digest", F.coalesce("refers_to_id", F.lit("")).alias("record_id"), "problem")
    counts = revisits.groupBy("record_id").agg(F.count(F.lit(1)).alias("rows"))
    facts = responses.select("record_id", "page_id", "payload_bytes", "digest", *(["payload"] if payloads else [])).join(counts, "record_id")
    met = with_facts(revisits, facts, ["record_id"], "rows", revisits.count(), F.xxhash64("page_id"))
    wrong = F.coalesce("problem", F.when(F.col("_fact").isNull(), F.lit("a revisit of nothing")), F.when(F.col("_fact.digest") != F.col("digest"), F.lit("payload digest")))
    again = met.select(
        "page_id", F.col("_fact.payload_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("_fact.page_id").alias("refers_to"),
        (F.col("_fact.payload") if payloads else F.lit(None).cast("binary")).alias("payload"), wrong.alias("problem"),
    )
    files = found.where("kind IS NULL").select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers_to_id").alias("refers_to"), "payload", "problem")
    out = whole.unionByName(again).unionByName(files).withColumns({c: F.url_decode(c) for c in ("page_id", "refers_to")})
    if strict:
        damage = F.raise_error(F.concat(F.lit("damaged archive: page "), F.coalesce("page_id", F.lit("without id")), F.lit(", "), F.col("problem")))
        out = out.withColumn("problem", F.when(F.col("problem").isNotNull(), damage.cast("string")))
    return out


def round_trip(pages: DataFrame, id_col: str = "page_id", path: str | None = None, **how) -> DataFrame:
    """Writes ``pages`` and reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to. Ids have
    the type that they have in ``pages``; a damaged archive raises. A repeated row comes as often as it was."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages, path, id_col, **how)
    kind = pages.schema[id_col].dataType
    read = read_pages(spark, path)
    # The verdict is part of a column that is asked for, so that it is reached.
    return read.select(
        F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", F.when(F.col("problem").isNull(), F.col("record_type")).alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to")
    )
