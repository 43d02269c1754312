"""Content-addressed store of token ids.

Layout of a store (all Parquet): ``chunks`` (digest, ids) holds each different chunk once, ids as little-endian
integers of ``width`` bytes, digest their SHA-256; ``recipes`` (doc_id, start, n_tokens, digests, root, block) has a
row a document in ascending doc_id order, root being the Merkle root of its digests; ``manifest`` (block, first, last,
n_docs, n_tokens, root) has the Merkle root of the document roots of each block of up to ``BLOCK`` neighbours.
Readers hold the recipes against the manifest, documents against their roots and chunks against their digests.

A rolling hash over the last 16 ids cuts a document's ids where its low bits are zero, so copies of a passage fall
into the same chunks wherever they stand.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxspark.llm.common import new_path, running_totals, slices, stage

WINDOW, MASK, LEAST, MOST = 16, 511, 128, 2048
END_ID = 2
#: Bits of the number of documents in a manifest block.
BLOCK_BITS = 12

PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: The letter that byte-level models write for a byte: itself where it is visible, else the next free one from 256 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: b for b in _VISIBLE} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _VISIBLE)}
TRIAL = ("Word", "don't", "it's,", "x'S", "(a)--b2C34", "Größe", "ÉTÉ'll", "ñ'mß", "++", "<|a|>", "A'Re")


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of each byte: 1 an ASCII letter, 2 a visible ASCII mark, 3 the apostrophe, 4 the first byte of a Latin-1 letter, else 0."""
    kinds = np.zeros(256, np.uint8)
    kinds[33:127] = 2
    kinds[[*range(48, 58)]] = 0
    kinds[[*range(65, 91), *range(97, 123)]] = 1
    kinds[ord("'")], kinds[0xC3] = 3, 4
    return kinds


def spaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with spaces between letters and marks, where the spaces go): the pre-tokenizer splits there anyway, so
    words come without their punctuation and fewer of them are different. What follows an apostrophe stays with it."""
    kinds = _kinds()[data]
    letter = kinds == 1
    after = letter.copy()  # a letter ends here
    latin = np.flatnonzero(kinds[:-1] == 4) + 1
    after[latin[(data[latin] >= 0x80) & (data[latin] != 0x97) & (data[latin] != 0xB7)]] = True
    before = letter | (kinds == 4)  # a letter may begin here: × and ÷, which begin alike, are left as they are
    times = np.flatnonzero(kinds == 4)
    second = data[np.minimum(times + 1, len(data) - 1)]
    before[times[(second == 0x97) | (second == 0xB7)]] = False
    mark = kinds == 2
    at = np.flatnonzero((after[:-1] & (mark[1:] | (kinds[1:] == 3))) | (mark[:-1] & before[1:])) + 1
    return np.insert(data, at, 32), at


class WordTokenizer(dict):
    """Ids of whole texts by a ``tokenizers`` file whose pre-tokenizer never joins words across white space.

    A mapping from words to their ids (as bytes) that asks the tokenizer for a word when it first meets it. At
    ``remember`` words it becomes the older generation, from which words that are met again come back."""

    def __init__(self, path: str, remember: int = 600_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.remember, self.older = Tokenizer.from_file(path), remember, {}
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE).search
        self.by_piece = self.tokenizer.model.tokenize
        # The model is asked directly only where a trial shows that this file splits words as ``pieces`` does.
        self.plain = not any(a.isalpha() for a in added) and all(
            [t.id for p in self.pieces(word) for t in self.by_piece(p)] == self.whole(word) == self.whole(word.lower()) for word in TRIAL
        )

    def whole(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def pieces(self, text: str) -> list[str] | None:
        """What the tokenizer's normalizer and pre-tokenizer make of a plain word, or None where that is theirs to say.

        In words of visible ASCII and Latin-1 letters only, lower-casing is all that normalizing does."""
        if not PLAIN.fullmatch(text):
            return None
        if text.isalpha():
            split = [text.lower()]
        elif self.special(text):
            return None
        else:
            split = SPLIT.findall(text.lower())
        return split if text.isascii() else [p.encode().decode("latin-1").translate(BYTE_LETTERS) for p in split]

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            text = word.decode()
            split = self.pieces(text) if self.plain else None
            found = self.whole(text) if split is None else [t.id for p in split for t in self.by_piece(p)]
            ids = array("I", found).tobytes()
        self[word] = ids
        return ids

    def words(self, texts: list[str | None]) -> Iterator[list[bytes]]:
        """The words of each text, as bytes. Where words are plain one case makes fewer of them, and punctuation is
        split off; a text with a special token in any case keeps its own."""
        raw = [(t or "").encode() for t in texts]
        if not self.plain:
            yield from (r.split() for r in raw)
            return
        own = [r if self.special(t or "") else None for r, t in zip(raw, texts)]
        joined = b"".join(b"\n" if keep is not None else r.lower() + b"\n" for r, keep in zip(raw, own))
        ends = np.cumsum(np.fromiter((1 if keep is not None else len(r) + 1 for r, keep in zip(raw, own)), np.int64, len(raw)))
        data, at = spaced(np.frombuffer(joined, np.uint8))
        data, start = data.tobytes(), 0
        for keep, end in zip(own, (ends + np.searchsorted(at, ends)).tolist()):
            yield data[start:end].split() if keep is None else keep.split()
            start = end

    def encode(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts, each closed by ``end_id``, and where each text's ids end."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self) > self.remember:
            self.older = dict(self)
            self.clear()
        ids_of, close = self.__getitem__, array("I", [end_id]).tobytes()
        rows = [b"".join([*map(ids_of, words), close]) for words in self.words(texts)]
        ends = np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows))) // 4
        return np.frombuffer(b"".join(rows), np.uint32), ends


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def cuts(ids: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one document, its length last."""
    n = len(ids)
    if n <= LEAST:
        return np.array([n] if n else [], np.int64)
    return _close(np.flatnonzero(_rolling(ids)[WINDOW - 1 :] & MASK == 0) + WINDOW, n)


def _rolling(ids: np.ndarray) -> np.ndarray:
    """At each place a hash of the ids of the window that ends there."""
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        m, width = np.uint64(0xD6E8FEB86659FD93), 1
        while width < WINDOW:
            more = h.copy()
            more[width:] += h[:-width] * m
            h, m, width = more, m * m, width * 2
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
    return h >> np.uint64(40)


def _close(wanted: np.ndarray, n: int) -> np.ndarray:
    """Chunk ends out of wanted ones: no chunk under LEAST but the last, none over MOST."""
    out, last = [], 0
    for end in [*wanted.tolist(), n]:
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end - last >= LEAST and end < n:
            out.append(end)
            last = end
    if last < n:
        out.append(n)
    return np.array(out, np.int64)


def merkle(digests: list[bytes]) -> bytes:
    """SHA-256 tree over digests; an odd last one rises as it is; none: the digest of nothing."""
    level = list(digests) or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def write_store(
    docs: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, width: int = 2
) -> None:
    """Encode every text and write a store to ``path``.

    A null or empty text is its end id alone. Null ids come first in the order; rows that repeat an id are separate
    documents, in the order of their lengths and roots. An empty table gives a store without rows. Ids must fit
    ``width`` bytes (2 or 4). Other columns are not read.
    """
    kind = {2: "<u2", 4: "<u4"}[width]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = tokenizer(tokenizer_path)
        for part, texts in slices(batches, "_text"):
            ids, ends = by.encode(texts, end_id)
            if len(ids) and int(ids.max()) >= 1 << 8 * width:
                raise ValueError(f"id {int(ids.max())} does not fit {width} bytes")
            low = _rolling(ids) & np.uint64(MASK)
            wanted, raw = np.flatnonzero(low == 0) + 1, ids.astype(kind).tobytes()
            digests, chunks, start = [], [], 0
            for end in ends.tolist():
                lo, hi = np.searchsorted(wanted, (start + WINDOW, end))
                own, at = _close(wanted[lo:hi] - start, end - start), start
                pieces = []
                for stop in (own + start).tolist():
                    pieces.append(raw[at * width : stop * width])
                    at = stop
                chunks.append(pieces)
                digests.append([hashlib.sha256(p).digest() for p in pieces])
                start = end
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array([merkle(d) for d in digests], pa.binary()), pa.array(digests, pa.list_(pa.binary())), pa.array(chunks, pa.list_(pa.binary()))],
                ["doc_id", "n_tokens", "root", "digests", "chunks"],
            )

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("root", T.BinaryType()), T.StructField("digests", T.ArrayType(T.BinaryType())), T.StructField("chunks", T.ArrayType(T.BinaryType()))])
    encoded = stage(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(encode, schema), "token-chunks")
    out = lambda df, name: df.write.option("compression", "zstd").parquet(f"{path}/{name}")

    pairs = encoded.select(F.explode(F.arrays_zip("digests", "chunks")).alias("c")).select(F.col("c.digests").alias("digest"), F.col("c.chunks").alias("ids"))
    out(pairs.groupBy("digest").agg(F.first("ids").alias("ids")), "chunks")

    order = ["doc_id", "n_tokens", "root"]
    placed = running_totals(encoded.drop("chunks"), order, "n_tokens", "token-recipes").withColumnRenamed("before", "start")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    recipes = placed.select("doc_id", "start", "n_tokens", "digests", "root").repartitionByRange(n, "start").sortWithinPartitions("start")
    # Rows are numbered in a task from a multiple of every block size on, so blocks never cross files.
    out(recipes.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)), "recipes")
    out(_blocks(docs.sparkSession.read.parquet(f"{path}/recipes")), "manifest")


def _blocks(recipes: DataFrame) -> DataFrame:
    """A manifest of ``recipes``: at most 2 ** BLOCK_BITS rows meet in a block, without their digests."""

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = [merkle(r) for r in batch.column("root").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("root"), "root", pa.array(tops, pa.binary()))

    parts = recipes.groupBy("block").agg(
        F.min("start").alias("first"), F.max("start").alias("last"), F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"),
        F.transform(F.array_sort(F.collect_list(F.struct("start", "root"))), lambda r: r["root"]).alias("root"),
    )
    return parts.mapInArrow(roots, "block bigint, first bigint, last bigint, n_docs bigint, n_tokens bigint, root binary")


def check_manifest(spark: SparkSession, path: str) -> None:
    """An error if a recipe of the store is missing, added or other than when its manifest was written."""
    found, written = _blocks(spark.read.parquet(f"{path}/recipes")), spark.read.parquet(f"{path}/manifest")
    wrong = found.exceptAll(written).select("block").unionByName(written.exceptAll(found).select("block")).limit(1).collect()
    if wrong:
        raise ValueError(f"recipes of block {wrong[0]['block']} are not those of the manifest")


@lru_cache(maxsize=1)
def _shifts() -> list[int]:
    """x^(8n) modulo the CRC-32 polynomial, bit-reversed, for n up to the bytes of the longest chunk."""
    out = [1 << 31]
    for _ in range(MOST * 4):
        v = out[-1]
        for _ in range(8):
            v = v >> 1 ^ (0xEDB88320 if v & 1 else 0)
        out.append(v)
    return out


def joined_crc(first: int, second: int, length: int) -> int:
    """CRC-32 of two byte strings put together, from theirs and the length of the second."""
    a, b, product = _shifts()[length], first, 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            product ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return product ^ second


def read_summaries(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read from the files of a store.

    Recipes are held against the manifest. Chunks are read and their digests recomputed; each document's chunks are put
    together by its recipe and its Merkle root is compared. A difference or a missing row is an error. The CRC is of the ids as little-endian unsigned
    32-bit integers; those of the chunks are joined, so ids do not travel."""
    kind = {2: "<u2", 4: "<u4"}[width]

    def inspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, n, crc = batch.column("digest").to_pylist(), [], []
            for digest, raw in zip(digests, batch.column("ids").to_pylist()):
                if hashlib.sha256(raw).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
                ids = np.frombuffer(raw, kind)
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int32()), pa.array(crc, pa.int64())], ["digest", "n", "crc"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for total, root, chunks in zip(batch.column("n_tokens").to_pylist(), batch.column("root").to_pylist(), batch.column("chunks").to_pylist()):
                if any(c["n"] is None for c in chunks) or sum(c["n"] for c in chunks) != total or merkle([c["digest"] for c in chunks]) != root:
                    raise ValueError("a document can't be rebuilt from its chunks")
                crc = 0
                for c in chunks:
                    crc = joined_crc(crc, c["crc"], 4 * c["n"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    check_manifest(spark, path)
    chunks = spark.read.parquet(f"{path}/chunks").mapInArrow(inspect, "digest binary, n int, crc bigint")
    recipes = spark.read.parquet(f"{path}/recipes")
    steps = recipes.select("doc_id", "start", "n_tokens", "root", F.posexplode("digests").alias("place", "digest"))
    whole = (
        steps.join(chunks, "digest", "left").groupBy("start", "doc_id", "n_tokens", "root")
        .agg(F.array_sort(F.collect_list(F.struct("place", "digest", "n", "crc"))).alias("chunks"))
    )
    schema = T.StructType([recipes.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    return whole.mapInArrow(combine, schema)


def read_documents(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, start, ids (array of int): the documents themselves, rebuilt from recipes and chunks, which are checked
    as ``read_summaries`` does."""
    kind = {2: "<u2", 4: "<u4"}[width]

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = []
            for total, root, chunks in zip(*(batch.column(c).to_pylist() for c in ("n_tokens", "root", "chunks"))):
                raw = [c["ids"] for c in chunks]
                if None in raw or sum(map(len, raw)) != total * width or merkle([hashlib.sha256(r).digest() for r in raw]) != root:
                    raise ValueError("a document can't be rebuilt from its chunks")
                whole.append(np.frombuffer(b"".join(raw), kind).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(whole, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    check_manifest(spark, path)
    recipes = spark.read.parquet(f"{path}/recipes")
    steps = recipes.select("doc_id", "start", "n_tokens", "root", F.posexplode("digests").alias("place", "digest"))
    whole = (
        steps.join(spark.read.parquet(f"{path}/chunks"), "digest", "left").groupBy("start", "doc_id", "n_tokens", "root")
        .agg(F.array_sort(F.collect_list(F.struct("place", "ids"))).alias("chunks"))
    )
    schema = T.StructType([recipes.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return whole.mapInArrow(ids, schema)


def store_summaries(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write a store into the shared folder and return what its files say of each document."""
    spark = docs.sparkSession
    path = new_path(spark, "token-store")
    write_store(docs, tokenizer_path, path)
    return read_summaries(spark, path)
