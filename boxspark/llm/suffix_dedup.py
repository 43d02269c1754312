"""Substring de-duplication with enhanced suffix arrays over anchored suffixes.

A byte goes when a string of ``length`` bytes that covers it also starts anywhere else, in the same text or another.

Every window of ``length`` bytes has an anchor: the ``gram``-byte string in it with the least hash, the leftmost of
equal ones. Equal windows have equal anchors at equal offsets, so windows can be judged anchor by anchor. Consecutive
windows with the same anchor form a run; the run's text is all that its windows hold.

1. Runs are dealt by the anchor's hash. An anchor that occurs once cannot repeat. Runs whose whole text occurs again
   are repeats as they stand: they agree in two 64-bit hashes, of the anchor and of all their bytes. What remains are anchors with several different texts: only of these, text travels.
2. For such an anchor the suffixes that start at it are sorted, with the lengths of neighbours' common prefixes: an
   enhanced suffix array. A stack scan gives the tree of common-prefix intervals; in each interval, members are split
   by what stands to the left of the anchor, and where that is diverse the members that agree far enough form a
   maximal repeat, with all its occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxspark.llm.common import slices, stage

#: Most windows of one text that are hashed at a time; longer texts go piece by piece.
PIECE = 1 << 21
_BITS = 22
_U = np.uint64
_ODD = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _ODD, np.uint64), np.full(n, pow(_ODD, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def runs(text: bytes, length: int, gram: int) -> np.ndarray:
    """One row a run: anchor hash, text hash, first byte, bytes, offset of the anchor."""
    out = [np.zeros((0, 5), np.int64)]
    for at in range(0, max(0, len(text) - length + 1), PIECE):
        out.append(_piece(np.frombuffer(text[at : at + PIECE + length - 1], np.uint8), length, gram, at))
    return np.concatenate(out)


def _piece(data: np.ndarray, length: int, gram: int, base: int) -> np.ndarray:
    # A string's hash is a power series of its 8-byte windows, each mixed, so that no pattern of bytes cancels out.
    n, eight = len(data) - 7, 8
    up, down = _powers(1 << max(17, n.bit_length()))
    inside = gram - eight + 1
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mix(np.ndarray((n,), "<u8", data.tobytes(), strides=(1,))) * up[:n], out=sums[1:])
        grams = _mix((sums[inside:] - sums[:-inside]) * down[: n - inside + 1])
        # Hash above, place below: the least is the least hash and, of equal ones, the leftmost.
        least = grams >> _U(_BITS) << _U(_BITS) | np.arange(len(grams), dtype=np.uint64)
        width, size = length - gram + 1, 1
        windows = len(grams) - width + 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[:windows], least[width - size : width - size + windows])
        anchors = (least & _U((1 << _BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(anchors, prepend=-1))
        last = np.append(first[1:], windows) - 1
        where, end = anchors[first], last + length
        offset = where - first
        texts = _mix((sums[end - eight + 1] - sums[first]) * down[first] + offset.astype(np.uint64) * _U(0x2545F4914F6CDD1D) + (end - first).astype(np.uint64))
    return np.column_stack([grams[where].view(np.int64), texts.view(np.int64), first + base, end - first, offset])


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of the common-prefix intervals of a suffix array, inner ones first, by a stack scan.
    lcp[i] is what suffixes i - 1 and i have in common; lcp[0] is not used."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        depth = lcp[i] if i < len(lcp) else 0
        first = i - 1
        while stack and stack[-1][0] > depth:
            inner, first = stack.pop()
            yield inner, first, i - 1
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def repeats(texts: list[bytes], offsets: list[int], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats through one anchor: (bytes left of the anchor, bytes from it on, texts), at least ``length``
    bytes together. Texts are different or stand for one occurrence each; offsets are where the anchor starts."""
    right = [t[o:] for t, o in zip(texts, offsets)]
    left = [t[:o][::-1] for t, o in zip(texts, offsets)]
    order = sorted(range(len(texts)), key=right.__getitem__)
    lcp = [0] + [_common(right[a], right[b]) for a, b in zip(order, order[1:])]
    rank = {k: i for i, k in enumerate(sorted(range(len(texts)), key=left.__getitem__))} if len(texts) > 2 else {0: 0, 1: 1}
    for depth, first, last in intervals(lcp):
        members = sorted(order[first : last + 1], key=rank.__getitem__)
        need = max(0, length - depth)
        if not need:
            yield 0, depth, members
        shared = [0] + [_common(left[a], left[b]) for a, b in zip(members, members[1:])]
        # Where what stands to the left is diverse the group splits; each deeper agreement is a longer repeat.
        for extension, a, b in intervals(shared):
            if extension >= need:
                yield extension, depth, members[a : b + 1]


def _spans(rows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(rows):
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs sorted by anchor and text: those whose text occurs again (whole), and one run of each different text
    of an anchor that has several (cut). Only a row of the group before is held back, however large a group is."""
    names = ["anchor", "words", "row", "start", "bytes", "offset"]
    held: list[np.ndarray] | None = None  # the last row, whose next row isn't known yet
    before = None  # (anchor, words) of the row before it
    waiting: list[np.ndarray] | None = None  # the first text's run of the current anchor, not yet known to be cut

    def judge(rows: list[np.ndarray], after: tuple | None) -> pa.RecordBatch | None:
        nonlocal before, waiting
        anchor, words = rows[0], rows[1]
        n = len(anchor)
        if not n:
            return None
        pa_, pw = np.empty(n, np.int64), np.empty(n, np.int64)
        pa_[1:], pw[1:] = anchor[:-1], words[:-1]
        first = before is None
        pa_[0], pw[0] = (anchor[0] ^ 1, 0) if first else before
        same = (anchor == pa_) & (words == pw)
        follows = np.zeros(n, bool)
        follows[:-1] = same[1:]
        follows[-1] = after is not None and after == (anchor[-1], words[-1])
        opens = anchor != pa_
        whole = np.flatnonzero(same | follows)
        new = np.flatnonzero(~same)
        later = new[~opens[new]]  # texts of an anchor that had another text before: cut, and so is that first text
        firsts = np.flatnonzero(opens)
        owner = np.searchsorted(firsts, later, side="right") - 1
        cut_first = firsts[np.unique(owner[owner >= 0])]
        parts = [[c[whole] for c in rows], [c[np.union1d(later, cut_first)] for c in rows]]
        if waiting is not None and (owner < 0).any():
            parts.append(waiting)
            waiting = None
        if len(firsts):
            k = firsts[-1]
            waiting = None if k in cut_first else [c[k : k + 1] for c in rows]
        before = (anchor[-1], words[-1])
        kinds = np.concatenate([np.full(len(p[0]), int(i > 0), np.int32) for i, p in enumerate(parts)])
        columns = [np.concatenate(c) for c in zip(*parts)]
        if not len(kinds):
            return None
        return pa.RecordBatch.from_arrays([pa.array(columns[i]) for i in (2, 0)] + [pa.array(columns[i].astype(np.int32)) for i in (3, 4, 5)] + [pa.array(kinds)], ["row", "anchor", "start", "bytes", "offset", "cut"])

    for batch in batches:
        if not batch.num_rows:
            continue
        new = [batch.column(c).to_numpy().astype(np.int64) for c in names]
        rows = new if held is None else [np.concatenate([a, b]) for a, b in zip(held, new)]
        held = [c[-1:] for c in rows]
        found = judge([c[:-1] for c in rows], (rows[0][-1], rows[1][-1]))
        if found is not None:
            yield found
    if held is not None:
        found = judge(held, None)
        if found is not None:
            yield found


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = 32) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): the rows of ``docs`` as _id, _text, row, and for those with repeats row, spans.

    Rows are numbered and staged, so each has its own spans, however many share its id and text."""
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    texts = stage(texts.withColumn("row", F.monotonically_increasing_id()), "repeat-texts")

    def all_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in slices(batches, "_text"):
            found = [runs(t.encode(), length, gram) for t in own]
            sizes, flat = np.fromiter(map(len, found), np.int64, len(found)), np.concatenate(found)
            row = np.repeat(part.column("row").to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy()), pa.array(row), *(pa.array(flat[:, i].astype(np.int32)) for i in (2, 3, 4))],
                ["anchor", "words", "row", "start", "bytes", "offset"],
            )

    found = texts.select("_text", "row").mapInArrow(all_runs, "anchor bigint, words bigint, row bigint, start int, bytes int, offset int")
    judged = found.repartition("anchor").sortWithinPartitions("anchor", "words").mapInArrow(
        _classify, "row bigint, anchor bigint, start int, bytes int, offset int, cut int"
    )
    whole = F.struct("start", (F.col("start") + F.col("bytes")).alias("end"))
    piece = F.struct("anchor", "start", "bytes", "offset")
    judged = stage(
        judged.groupBy("row").agg(F.collect_list(F.when(F.col("cut") == 0, whole)).alias("spans"), F.collect_list(F.when(F.col("cut") == 1, piece)).alias("pieces")), "repeat-runs"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in slices(batches, "_text"):
            out: list[list] = [[], [], [], [], []]
            for text, row, pieces in zip(own, *(part.column(c).to_pylist() for c in ("row", "pieces"))):
                raw = text.encode()
                for p in pieces:
                    for column, value in zip(out, (p["anchor"], row, p["start"], p["offset"], raw[p["start"] : p["start"] + p["bytes"]])):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["anchor", "row", "start", "offset", "bytes"])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of one anchor

        def judge() -> list[tuple]:
            # All repeats of an occurrence through one anchor hold the anchor, so together they are one span: a row an
            # occurrence comes out, however many intervals nest.
            left, right = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64)
            for before, after, members in repeats([r[4] for r in held], [r[3] for r in held], length):
                left[members], right[members] = np.maximum(left[members], before), np.maximum(right[members], after)
            out = []
            for k in np.flatnonzero(right).tolist():
                _, row, start, offset, _ = held[k]
                out.append((row, start + offset - int(left[k]), start + offset + int(right[k])))
            return out

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["row", "start", "end"])

        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    found += judge() if len(held) > 1 else []
                    held = []
                held.append(row)
            if found:
                yield batch_of(found)
        if len(held) > 1 and (found := judge()):
            yield batch_of(found)

    with_pieces = judged.where(F.size("pieces") > 0).select("row", "pieces")
    pieces = texts.join(with_pieces, "row").select("_id", "_text", "row", "pieces").mapInArrow(cut, "anchor bigint, row bigint, start int, offset int, bytes binary")
    more = pieces.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(group, "row bigint, start int, end int")
    more = more.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = judged.where(F.size("spans") > 0).select("row", "spans").unionByName(more).groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return texts, spans


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = 32) -> DataFrame:
    """One row a row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed runs in bytes), kept
    (the bytes that stay; a cut may split a character).

    Texts are UTF-8 bytes, null is empty. A row whose text is shorter than ``length`` keeps all of it. Rows that
    repeat a text lose it whole if it is that long, whatever their ids. Spans that touch or overlap are one. Null ids
    and repeated rows are ordinary rows; an empty table gives an empty result; other columns are not read.
    """
    texts, spans = repeated_spans(docs, id_col, text_col, length, gram)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in slices(batches, "_text"):
            out: list[list] = [[], [], [], [], [], []]
            for text, found in zip(own, part.column("spans").to_pylist()):
                raw = text.encode()
                gone = _spans([(s["start"], s["end"]) for s in found or ()])
                kept, at = [], 0
                for start, end in gone:
                    kept.append(raw[at:start])
                    at = end
                rest = b"".join([*kept, raw[at:]])
                row = (len(raw), len(raw) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), [{"start": a, "end": b} for a, b in gone], rest)
                for column, value in zip(out, row):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("_id"), *(pa.array(c, k) for c, k in zip(out, kinds))], schema.names)

    longs = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), *longs, T.StructField("kept_sha256", T.StringType()), T.StructField("spans", _SPAN), T.StructField("kept", T.BinaryType())])
    return texts.join(spans, "row", "left").select("_id", "_text", "row", "spans").mapInArrow(remove, schema).withColumnRenamed("_id", id_col)
