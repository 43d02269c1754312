"""Ranked lexical search with hashed max-sketches: the best documents of every query, exactly.

A document's term impacts fold into a sketch: each term is hashed to one of ``width`` coordinates, which keeps the largest impact
that falls there. A batch of queries looks its terms' coordinates up in a block of sketches at once; the weighted sum is never
less than the score, since a coordinate is never less than the impact of a term in it. Each query then goes through the block's
documents by falling bound and scores them exactly, until a bound is below its ``most``-th best score so far.

Documents stay where they are read: tasks keep only each query's best so far, and those meet in two ranking steps. Queries
come in batches of bounded size; each batch is one pass for its terms' frequencies and one for the search.
"""

from __future__ import annotations

import math
import zlib
from bisect import insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxspark.llm.common import running_totals, slices, stage

#: Bytes of terms: digits, A-Z in lower case, a-z and all bytes of other characters; the rest stands between terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WIDTH = 2048
#: A batch has this many query terms, or queries of which each counts as LEAST_COST terms at least.
BATCH_TERMS, LEAST_COST = 20_000, 20
#: Bytes of text in a block of sketches, and cells of its table of exact impacts.
BLOCK_BYTES, BLOCK_CELLS = 6_000_000, 8_000_000


def terms(text: bytes | None, piece: int = 4_000_000) -> Iterator[list[bytes]]:
    """All terms of a text, in lists; long texts are split piece by piece, at a space."""
    data, at = (text or b"").translate(TERM_BYTES), 0
    while at < len(data):
        end = data.find(b" ", at + piece)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def term_counts(text: bytes | None) -> Counter:
    counts: Counter = Counter()
    for some in terms(text):
        counts.update(some)
    return counts


class Coordinates(dict):
    """The coordinate of each term, remembered for the terms met of late."""

    def __init__(self, width: int, remember: int = 500_000):
        super().__init__()
        self.width, self.remember = width, remember

    def __missing__(self, term: bytes) -> int:
        if len(self) >= self.remember:
            self.clear()
        at = self[term] = zlib.crc32(term) % self.width
        return at


class Statistics:
    """What scores need of the corpus: N, L, and the weights of a batch's terms."""

    def __init__(self, n_docs: int, n_terms: int, df: dict[bytes, int]):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items() if n}

    def length_factor(self, n: int) -> int:
        return 10 + 90 * n * self.n_docs // self.n_terms


def impact(tf, m):
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def sketches(counts: list[Counter], factors: list[int], coordinates: Coordinates) -> np.ndarray:
    """A row a document: the largest impact at each coordinate."""
    sizes = [len(c) for c in counts]
    folded = np.zeros((len(counts), coordinates.width), np.int32)
    tf = np.fromiter(chain.from_iterable(c.values() for c in counts), np.int64, sum(sizes))
    at = np.fromiter(chain.from_iterable(map(coordinates.__getitem__, c) for c in counts), np.int64, sum(sizes))
    row = np.repeat(np.arange(len(counts)), sizes)
    np.maximum.at(folded.reshape(-1), row * coordinates.width + at, impact(tf, np.repeat(np.array(factors, np.int64), sizes)).astype(np.int32))
    return folded


class Search:
    """One task's search for a batch of queries, fed block by block."""

    def __init__(self, queries: list[tuple[int, list[bytes]]], known: Statistics, most: int, width: int):
        self.known, self.most, self.coordinates = known, most, Coordinates(width)
        self.numbers = [number for number, _ in queries]
        weighted = [[t for t in dict.fromkeys(terms) if t in known.weights] for _, terms in queries]  # what no document holds adds nothing
        self.place = {t: i for i, t in enumerate(sorted({t for terms in weighted for t in terms}))}
        self.vocabulary = frozenset(self.place)
        self.weighted = [(np.array([self.place[t] for t in terms], np.int64), np.array([known.weights[t] for t in terms], np.int64)) for terms in weighted]
        used = sorted({self.coordinates[t] for t in self.vocabulary})
        at = {c: i for i, c in enumerate(used)}
        self.used, self.lookup = np.array(used, np.int64), np.zeros((len(used), len(queries)))
        for q, terms in enumerate(weighted):
            for t in terms:
                self.lookup[at[self.coordinates[t]], q] += known.weights[t]
        #: Documents of a block, so that its exact impacts fit.
        self.rows = max(64, BLOCK_CELLS // max(1, len(self.place)))
        #: Each query's best so far, as (-score, no id, id), best first.
        self.best: list[list[tuple]] = [[] for _ in queries]
        self.scored = 0

    def feed(self, ids: list, texts: list[bytes | None]) -> None:
        holders = defaultdict(list)
        for i, text in zip(ids, texts):
            holders[text].append((i is None, 0 if i is None else i))
        # Of equal texts the least ids come first, so no more than ``most`` of them can be among the best.
        found = [(text, [(none, None if none else i) for none, i in sorted(who)[: self.most]]) for text, who in holders.items()]
        if len(self.used):
            for at in range(0, len(found), self.rows):
                self._block(found[at : at + self.rows])

    def _block(self, found: list[tuple[bytes | None, list[tuple]]]) -> None:
        counts, who = [], []
        for text, ids in found:
            if c := term_counts(text):
                counts.append(c)
                who.append(ids)
        factors = [self.known.length_factor(c.total()) for c in counts]
        folded = sketches(counts, factors, self.coordinates)
        # Sums of whole numbers below 2^53 are exact in doubles, so these are true upper bounds.
        bounds = np.concatenate([np.zeros((0, len(self.numbers)))] + [folded[at : at + 256, self.used].astype(float) @ self.lookup for at in range(0, len(counts), 256)])
        exact = np.zeros((len(counts), len(self.place)), np.int32)
        for d, (c, m) in enumerate(zip(counts, factors)):
            if held := list(self.vocabulary.intersection(c)):
                exact[d, [self.place[t] for t in held]] = [impact(c[t], m) for t in held]
        for q, (places, weights) in enumerate(self.weighted):
            best, bound = self.best[q], bounds[:, q]
            least = -best[-1][0] if len(best) == self.most else 1
            at = np.flatnonzero(bound >= least)
            at = at[np.argsort(-bound[at], kind="stable")]
            start, size = 0, 2 * self.most
            while start < len(at) and (len(best) < self.most or bound[at[start]] >= -best[-1][0]):
                some = at[start : start + size]
                scores = exact[np.ix_(some, places)].astype(np.int64) @ weights
                self.scored += len(some)
                for k in np.flatnonzero(scores >= (-best[-1][0] if len(best) == self.most else 1)).tolist():
                    for ids in who[some[k]]:
                        entry = (-int(scores[k]), *ids)
                        if len(best) == self.most and not _before(entry, best[-1]):
                            break
                        insort(best, entry, key=lambda e: (e[0], e[1], 0 if e[1] else e[2]))
                        del best[self.most :]
                start, size = start + size, 2 * size

    def results(self) -> Iterator[tuple]:
        for number, best in zip(self.numbers, self.best):
            for score, _, i in best:
                yield number, i, -score


def _before(one: tuple, other: tuple) -> bool:
    return one[:2] < other[:2] or (one[:2] == other[:2] and not one[1] and one[2] < other[2])


def statistics(texts: DataFrame, vocabulary: frozenset) -> Statistics:
    """One pass: documents with a term, all terms, and the documents that hold each term of the vocabulary. A task sends one
    row a term of the batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_terms = 0
        df: Counter = Counter()
        for _, part in slices(batches, "_text"):
            for text in part:
                n, held = 0, frozenset()
                for some in terms(text):
                    n, held = n + len(some), vocabulary.intersection(some) | held
                n_docs, n_terms = n_docs + (n > 0), n_terms + n
                df.update(held)
        rows = [(None, n_docs, n_terms), *((t, n, 0) for t, n in df.items())]
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64()))], ["term", "n_docs", "n_terms"])

    counted = texts.select("_text").mapInArrow(count, "term binary, n_docs bigint, n_terms bigint")
    rows = counted.groupBy("term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_terms").alias("n_terms")).collect()  # at most a batch's terms
    all_ = next((r for r in rows if r["term"] is None), None)
    return Statistics(all_["n_docs"] if all_ else 0, all_["n_terms"] if all_ else 0, {bytes(r["term"]): r["n_docs"] for r in rows if r["term"] is not None})


def _best(found: DataFrame, most: int) -> DataFrame:
    """Each query's best rows with their rank, in two steps: a query's rows of many tasks first meet in salted groups."""
    order = [F.desc("score"), F.asc_nulls_last("_id")]
    some = found.withColumn("_salt", F.pmod(F.xxhash64("_id", "score"), F.lit(64))).withColumn("_nth", F.row_number().over(Window.partitionBy("_item", "_salt").orderBy(*order)))
    return some.where(F.col("_nth") <= most).withColumn("rank", F.row_number().over(Window.partitionBy("_item").orderBy(*order))).where(F.col("rank") <= most).drop("_salt", "_nth")


def search(
    docs: DataFrame, items: DataFrame, most: int = 10, width: int = WIDTH, batch_terms: int = BATCH_TERMS,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """item id, rank, document id, score: the ``most`` best documents of each row of ``items`` with a score above 0, equal scores
    by ascending id.

    A null text has no term: such a document is never found, such an item finds nothing. Rows that repeat an id, of documents or
    items, are documents and items of their own; null ids come last among equal scores. Empty tables give no row. Texts are read
    whole; other columns are not read. Equal texts of a block are folded and scored once for all who hold them, so groups of
    copies cost no more than their ids.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    cost = F.greatest(F.lit(LEAST_COST), F.octet_length("_text") / 2).cast("long")
    numbered = running_totals(
        items.select(F.col(item_col).alias("_key"), F.coalesce(F.col(item_text_col), F.lit("")).cast("binary").alias("_text")).withColumn("cost", cost), ["_key", "_text"], "cost", "search-items"
    ).withColumn("_batch", F.floor(F.col("before") / batch_terms)).withColumn("_item", F.monotonically_increasing_id())
    numbered = stage(numbered.select("_item", "_key", "_text", "_batch"), "search-numbered")
    id_type = texts.schema["_id"].dataType
    schema = f"_item bigint, _id {id_type.simpleString()}, score bigint"
    parts = []
    for batch in sorted(r["_batch"] for r in numbered.select("_batch").distinct().collect()):
        # One batch of queries at a time is on the driver: batch_terms terms, or one query that has more.
        queries = [(r["_item"], list(term_counts(bytes(r["_text"])))) for r in numbered.where(F.col("_batch") == batch).select("_item", "_text").collect()]
        known = statistics(texts, frozenset(t for _, ts in queries for t in ts))
        if not known.n_terms:
            continue
        found = texts.mapInArrow(_searcher(queries, known, most, width), schema)
        parts.append(stage(_best(found, most), "search-batch"))
    if not parts:
        parts = [spark.createDataFrame([], f"{schema}, rank int")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    keys = numbered.select("_item", "_key")
    return out.join(keys, "_item").select(F.col("_key").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("_id").alias(id_col), "score")


def _searcher(queries: list[tuple[int, list[bytes]]], known: Statistics, most: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, names = Search(queries, known, most, width), ["_item", "_id", "score"]
        id_type = None
        for part, texts in slices(batches, "_text", BLOCK_BYTES):
            id_type = part.schema.field("_id").type
            task.feed(part.column("_id").to_pylist(), texts)
        if id_type is not None and (rows := list(task.results())):
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int64(), id_type, pa.int64()))], names)

    return run
