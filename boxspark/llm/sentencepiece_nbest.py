"""SentencePiece encoding and decoding with N-best segmentation.

The lattice of a text has a node between any two characters and an edge for each piece of the model that spans them;
a character that no piece covers has one edge, worth ``UNKNOWN_BELOW`` less than the worst piece, that becomes byte
pieces. The score of a path is the sum of its pieces' log-probabilities (see ``log_probabilities``). A forward Viterbi
pass gives each node the best score from the start; these are exact heuristics, so a backward A-star search from the
end pops complete paths best first.

Space marks start a segment that no piece crosses, and so do line breaks, so a text's lattice is a chain of its
segments' lattices. Viterbi runs over all different segments of a slice at once; the search runs in the few segments
of a text whose second-best path is nearest, which is where its N best paths can differ. Scores are multiples of
2 ** -20, so sums are exact and equal scores are equal in whatever order they are added.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from array import array
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxspark.llm.common import slices

MARK = "▁"
UNKNOWN_BELOW = 10.0
#: Shift of the Zipf-Mandelbrot law that turns merge ranks into probabilities.
RANK_SHIFT = 100.0
#: Longer segments are walked character by character and are not remembered.
LONG = 128
SEGMENT = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def log_probabilities(scores: np.ndarray) -> np.ndarray:
    """Log-probabilities of pieces, as multiples of 2 ** -20.

    A unigram model's scores are log-probabilities. Those of a BPE model are whole numbers, minus the rank of the merge,
    whose sums mean nothing: a piece of rank r gets the Zipf-Mandelbrot probability in proportion to
    1 / (r + RANK_SHIFT). Nothing is learned from texts."""
    if (scores == np.rint(scores)).all() and scores.max(initial=0) <= 0:
        odds = 1 / (RANK_SHIFT - scores)
        scores = np.log(odds / odds.sum())
    return np.rint(scores * 2.0**20) / 2.0**20


class Model:
    """Pieces of a SentencePiece model and the best paths of segments seen lately: at most ``remember``, and what they
    hold together at most ``remember_ids`` pieces, beside the slice at hand."""

    def __init__(self, path: str, remember: int = 120_000, remember_ids: int = 2_000_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.remember, self.remember_ids = remember, remember_ids
        self.bytes = [0] * 256
        self.pieces: dict[str, tuple[int, float]] = {}
        self.surface: list[bytes] = []
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.surface.append(b"")
            else:
                self.pieces[piece] = (i, float(sp.get_score(i)))
                self.surface.append(piece.replace(MARK, " ").encode())
        worth = log_probabilities(np.array([s for _, s in self.pieces.values()]))
        self.pieces = {p: (i, float(s)) for (p, (i, _)), s in zip(self.pieces.items(), worth)}
        # A piece that crosses the start of a segment would break the chain.
        if any("\n" in p or MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("this model has pieces across segments")
        self.unknown = min(s for _, s in self.pieces.values()) - UNKNOWN_BELOW
        self.longest = max(map(len, self.pieces))
        self._tabulate()
        self.forget()

    def _tabulate(self) -> None:
        """An open-addressing table from the hash of each prefix of a piece to its piece (-1: none)."""
        names = {p[:k]: -1 for p in self.pieces for k in range(1, len(p))} | {p: i for p, (i, _) in self.pieces.items()}
        self.begins = {p: self.pieces.get(p) for p in names}  # every beginning of a piece, and what it is itself
        self.bits = 18
        self.slots, self.found = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -2, np.int32)
        for name, i in names.items():
            h = 0
            for c in name:
                h = (h * _BASE + ord(c) + 1) & (2**64 - 1)
            at = self._place(h)
            while self.found[at] != -2:
                if int(self.slots[at]) == h:
                    raise ValueError("two pieces share a hash")
                at = (at + 1) & ((1 << self.bits) - 1)
            self.slots[at], self.found[at] = h, i
        self.scores = np.zeros(len(self.surface))
        for i, s in self.pieces.values():
            self.scores[i] = s
        self.scores[0] = self.unknown  # id 0 stands for a character without a piece
        self.widths = np.array([len(x.decode("utf-8", "replace")) for x in self.surface])
        self.widths[0] = 1
        self.width_of = self.widths.tolist()

    def _place(self, h):
        if isinstance(h, int):
            return ((h ^ h >> 29) * 0xBF58476D1CE4E5B9 & (2**64 - 1)) >> (64 - self.bits)
        return (((h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)) >> _U(64 - self.bits)).astype(np.int64)

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """-2: no piece starts so; -1: some longer piece does; else the piece."""
        out = np.full(len(hashes), -2, np.int32)
        at, todo = self._place(hashes), np.arange(len(hashes))
        while len(todo):
            found = self.found[at]
            hit = (self.slots[at] == hashes[todo]) & (found != -2)
            out[todo[hit]] = found[hit]
            go = ~hit & (found != -2)
            todo, at = todo[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.ends, self.best, self.gap = np.zeros(1 << 14, np.int64), np.zeros(1 << 14), np.zeros(1 << 14)

    def edges(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts of the segments' nodes, first node, last node, place of the last node in its segment, piece)."""
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        char_starts = np.cumsum(lengths) - lengths
        room = np.repeat(char_starts + lengths, lengths) - np.arange(len(codes))  # characters left in the segment
        which = np.repeat(np.arange(len(segments)), lengths)
        at, h, out = np.arange(len(codes)), np.zeros(len(codes), np.uint64), []
        with np.errstate(over="ignore"):
            for size in range(1, self.longest + 1):
                ok = room[at] >= size
                at, h = at[ok], h[ok]
                if not len(at):
                    break
                h = h * _U(_BASE) + codes[at + size - 1] + _U(1)
                piece = self.look_up(h)
                if size == 1:
                    none = np.flatnonzero(piece < 0)
                    out.append((at[none], np.full(len(none), 1), np.zeros(len(none), np.int32)))
                hit = piece >= 0
                out.append((at[hit], np.full(int(hit.sum()), size), piece[hit]))
                alive = piece != -2
                at, h = at[alive], h[alive]
        start, size, piece = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        first = start + which[start]  # a segment of n characters has n + 1 nodes
        return char_starts + np.arange(len(segments)), first, first + size, start + size - char_starts[which[start]], piece.astype(np.int32)

    def learn(self, segments: list[str]) -> None:
        """Best path, its score and how far the second-best is below, of each segment."""
        for own, how in (([s for s in segments if len(s) <= LONG], self._together), ([s for s in segments if len(s) > LONG], self._one_by_one)):
            if own:
                self._remember(own, *how(own))

    def _one_by_one(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids, best, gap = [], [], []
        for segment in segments:
            one, two, piece = self.walk(segment)
            path, at = [], len(segment)
            while at:
                path.append(piece[at])
                at -= self.width_of[piece[at]]
            ids.append(self.expand(segment, path[::-1]))
            best.append(one[-1])
            gap.append(one[-1] - two[-1])
        return np.concatenate([np.array(x, np.int32) for x in ids]), np.array(list(map(len, ids))), np.array(best), np.array(gap)

    def _together(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all, number of each's ids, best score, gap): forward Viterbi over all at once."""
        nodes, first, last, place, piece = self.edges(segments)
        n_nodes = int(nodes[-1]) + len(segments[-1]) + 1
        one, two = np.full(n_nodes, -np.inf), np.full(n_nodes, -np.inf)
        back = np.zeros(n_nodes, np.int64)
        one[nodes] = 0.0
        order = np.lexsort((piece, last, place))
        first, last, place, piece = first[order], last[order], place[order], piece[order]
        steps = np.searchsorted(place, np.arange(1, int(place.max()) + 2))
        worth = self.scores[piece]
        for lo, hi in zip(steps[:-1].tolist(), steps[1:].tolist()):
            ends, begin, score = last[lo:hi], first[lo:hi], worth[lo:hi]
            groups = np.flatnonzero(np.diff(ends, prepend=-1))
            a, b = one[begin] + score, two[begin] + score
            top = np.maximum.reduceat(a, groups)
            sizes = np.diff(groups, append=hi - lo)
            is_top = np.flatnonzero(a == np.repeat(top, sizes))
            group_of = np.repeat(np.arange(len(groups)), sizes)
            chosen = is_top[np.flatnonzero(np.diff(group_of[is_top], prepend=-1))]  # of equals the smallest piece
            a[chosen] = -np.inf
            at = ends[groups]
            one[at], two[at], back[at] = top, np.maximum.reduceat(np.maximum(a, b), groups), chosen + lo
        final = nodes + np.fromiter(map(len, segments), np.int64, len(segments))
        place_of, alive = final.copy(), np.arange(len(segments))
        rows, ids = [], []
        while len(alive):
            edge = back[place_of[alive]]
            rows.append(alive)
            ids.append(piece[edge])
            place_of[alive] = first[edge]
            alive = alive[place_of[alive] > nodes[alive]]
        rows, ids = np.concatenate(rows)[::-1], np.concatenate(ids)[::-1]
        ids = ids[order := np.argsort(rows, kind="stable")]
        counts = np.bincount(rows, minlength=len(segments))
        blank = np.flatnonzero(ids == 0)
        if len(blank):  # byte pieces in place of characters without a piece
            owner = rows[order]
            parts, at = [], 0
            extra = np.zeros(len(segments), np.int64)
            starts = np.cumsum(counts) - counts
            for k in blank.tolist():
                own, path = segments[owner[k]], ids[starts[owner[k]] : k]
                offset = int(self.widths[path].sum())
                raw = own[offset].encode("utf-8", "replace")
                parts += [ids[at:k], np.array([self.bytes[x] for x in raw], np.int32)]
                at, extra[owner[k]] = k + 1, extra[owner[k]] + len(raw) - 1
            ids, counts = np.concatenate([*parts, ids[at:]]), counts + extra
        return ids, counts, one[final], one[final] - two[final]

    def _remember(self, segments: list[str], ids: np.ndarray, counts: np.ndarray, best: np.ndarray, gap: np.ndarray) -> None:
        n, more = len(self.known), len(ids)
        while self.used + more > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(segments) + 1 > len(self.ends):
            self.ends, self.best, self.gap = (np.concatenate([x, np.zeros_like(x)]) for x in (self.ends, self.best, self.gap))
        self.ids[self.used : self.used + more] = ids
        self.ends[n + 1 : n + 1 + len(segments)] = self.used + np.cumsum(counts)
        self.best[n : n + len(segments)] = best
        self.gap[n : n + len(segments)] = gap
        self.used += more
        self.known.update(zip(segments, range(n, n + len(segments))))

    def walk(self, segment: str, into: list | None = None) -> tuple[array, array, array]:
        """(best score from the start, the next best one, piece that ends there) of each node of one segment: the same
        Viterbi pass as ``_together``, of equal scores the smallest piece, in memory of a few numbers a character.
        ``into`` is given the edges into each node, (where it begins, piece, score)."""
        size, low, unknown = len(segment), -np.inf, (0, self.unknown)
        one, two, piece = array("d", [low]) * (size + 1), array("d", [low]) * (size + 1), array("i", [0]) * (size + 1)
        one[0], begins = 0.0, self.begins
        for i in range(size):
            here, near = one[i], two[i]
            for j in range(i + 1, min(size, i + self.longest) + 1):
                part = segment[i:j]
                known = part in begins
                found = begins[part] if known else None
                if found is None and j == i + 1:
                    found = unknown
                if found:
                    p, worth = found
                    if into is not None:
                        into[j].append((i, p, worth))
                    a = here + worth
                    if a > one[j] or (a == one[j] and p < piece[j]):
                        two[j], one[j], piece[j] = max(one[j], two[j], near + worth), a, p
                    elif a > two[j]:
                        two[j] = a
                if not known:
                    break
        return one, two, piece

    def segment_paths(self, segment: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best paths of one segment's lattice, (score, ids), best first; of equal scores the first is that of
        ``walk``, the others come as the search meets them.

        Backward A-star: what stands behind a node is known, what stands before it is bounded exactly by the best score
        from the start. An open entry stands for at least one path of just its cost, so entries that cost more than the
        n cheapest met so far are not opened. Entries hold a link to the one behind them, not their pieces."""
        size, unknown, pieces = len(segment), (0, self.unknown), self.pieces
        into: list[list] | None = [[] for _ in range(size + 1)] if size <= LONG else None  # a long lattice is not kept
        best = self.walk(segment, into)[0]
        known: dict[int, list[tuple[float, int, int]]] = {}

        def options(node: int) -> list[tuple[float, int, int]]:
            """(how much more than the best it costs, piece, where it begins) of the edges into a node."""
            if into is None:
                begins = range(max(0, node - self.longest), node)
                edges = [(i, *one) for i in begins if (one := pieces.get(segment[i:node]) or (unknown if i == node - 1 else None))]
            else:
                edges = into[node]
            top = best[node]
            found = sorted([(top - best[i] - worth, p, i) for i, p, worth in edges])
            # Costs only grow along a path and the limit only falls, so what is over it now stays over it.
            known[node] = found = [found[0], *(x for x in found[1:] if len(limits) < n or x[0] < limits[-1])]
            return found

        behind_of, piece_of = array("q", [-1]), array("i", [-1])
        heap, limits, out = [(0.0, 0, size, 0)], [0.0], []  # costs over the best path's
        while heap and len(out) < n:
            cost, _, node, entry = heapq.heappop(heap)
            while node:  # of equal costs the entry opened last goes on, so this is what would come off the heap next
                first, *others = known.get(node) or options(node)
                for more, p, i in others:
                    if len(limits) >= n:
                        if cost + more >= limits[-1]:
                            break
                        limits.pop()
                    insort(limits, cost + more)
                    behind_of.append(entry)
                    piece_of.append(p)
                    heapq.heappush(heap, (cost + more, 1 - len(piece_of), i, len(piece_of) - 1))
                behind_of.append(entry)
                piece_of.append(first[1])
                node, entry = first[2], len(piece_of) - 1
            path = []
            while entry:
                path.append(piece_of[entry])
                entry = behind_of[entry]
            out.append((best[size] - cost, self.expand(segment, path)))
        return out

    def expand(self, segment: str, path: list[int]) -> tuple[int, ...]:
        """The ids of a path: bytes in place of a character without a piece."""
        out, at = [], 0
        for p in path:
            if p:
                out.append(p)
                at += self.width_of[p]
            else:
                out += [self.bytes[x] for x in segment[at].encode("utf-8", "replace")]
                at += 1
        return tuple(out)

    def encode(self, texts: list[str | None], n_best: int) -> Iterator[tuple[np.ndarray, list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]]]:
        """For each text the ids of its best path and its n best paths as (score, [(from, to, ids)]): ids that take
        the place of the best path's ids from..to."""
        split = [SEGMENT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        flat = [s for x in split for s in x]
        if len(self.known) > self.remember or self.used > self.remember_ids:
            self.forget()
        if new := [s for s in dict.fromkeys(flat) if s not in self.known]:
            self.learn(new)
        which = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        starts, sizes = self.ends[which], self.ends[which + 1] - self.ends[which]
        offsets = np.cumsum(sizes)
        total = int(offsets[-1]) if len(offsets) else 0
        ids = self.ids[np.repeat(starts - (offsets - sizes), sizes) + np.arange(total)]
        gaps, best = self.gap[which], self.best[which]
        at = 0
        for own in split:
            end = at + len(own)
            first = int(offsets[at - 1]) if at else 0
            last = int(offsets[end - 1]) if end else 0
            paths = [(float(best[at:end].sum()), [])]
            if n_best > 1 and own:
                paths = self._paths(own, gaps[at:end], offsets[at:end] - first, sizes[at:end], paths[0][0], n_best)
            yield ids[first:last], paths
            at = end

    def _paths(self, own: list[str], gaps: np.ndarray, ends: np.ndarray, sizes: np.ndarray, top: float, n: int) -> list:
        """Each of the n best paths of the chain differs from the best one only in the n - 1 segments with the nearest
        second-best paths (equal ones: the first): otherwise these alone would already make n that are no worse."""
        open_ = np.flatnonzero(np.isfinite(gaps))
        if len(open_) > n - 1:
            limit = np.partition(gaps[open_], n - 2)[n - 2]
            open_ = open_[gaps[open_] <= limit]
            open_ = open_[np.argsort(gaps[open_], kind="stable")[: n - 1]]
        places = sorted(open_.tolist())
        choices = [self._cached(own[p], n) if len(own[p]) <= LONG else self.segment_paths(own[p], n) for p in places]
        heap, out, seen = [(0.0, (0,) * len(places))], [], set()
        while heap and len(out) < n:
            cost, ranks = heapq.heappop(heap)  # ranks from the last segment to the first
            changes = []
            for p, options, r in zip(places, choices, ranks[::-1]):
                if r:
                    changes.append((int(ends[p] - sizes[p]), int(ends[p]), options[r][1]))
            out.append((top - cost, changes))
            for k in range(len(ranks)):
                more = (*ranks[:k], ranks[k] + 1, *ranks[k + 1 :])
                options = choices[len(ranks) - 1 - k]
                if more[k] < len(options) and more not in seen:
                    seen.add(more)
                    heapq.heappush(heap, (sum(c[0][0] - c[r][0] for c, r in zip(choices, more[::-1])), more))
        return out

    @lru_cache(maxsize=20_000)  # noqa: B019  one model lives as long as its worker
    def _cached(self, segment: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        return self.segment_paths(segment, n)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")[1:]


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


_PATH = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", n_best: int = 4) -> DataFrame:
    """One row a row of ``docs``: id and ``paths``, an array of (score, ids) of the n best segmentations, best first.

    A null or empty text has one path without ids and score 0; a text with fewer than n paths has fewer. Equal scores
    come in an order that the search defines, the same in every run. Memory and time grow with a text, also with one
    that has no space. White space is kept; U+2581 in a text reads as a space, as in the model. Repeated rows each get a row, other columns are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for part, texts in slices(batches, "_text"):
            out = []
            for ids, paths in m.encode(texts, n_best):
                out.append([{"score": score, "ids": changed(ids, changes).tolist()} for score, changes in paths])
            kind = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(out, kind)], ["_id", "paths"])

    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("paths", T.ArrayType(_PATH))])
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(rows, schema).withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows of ids. Null or no ids: the empty text; ids outside the model are an error."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for batch in batches:
            texts = [m.decode(ids) if ids else "" for ids in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(texts, pa.string())], ["_id", "text"])

    schema = T.StructType([T.StructField("_id", encoded.schema[id_col].dataType), T.StructField("text", T.StringType())])
    return encoded.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids")).mapInArrow(rows, schema).withColumnRenamed("_id", id_col)


def changed(ids: np.ndarray, changes: list[tuple[int, int, tuple[int, ...]]]) -> np.ndarray:
    parts, at = [], 0
    for start, end, other in changes:
        parts += [ids[at:start], np.array(other, np.int32)]
        at = end
    return np.concatenate([*parts, ids[at:]]) if changes else ids


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", n_best: int = 4) -> DataFrame:
    """What ``encode`` gives, as digests made in the same tasks, with the decoded best path held against the text.

    id, n_pieces, score (of the best path), n_paths, last_score (of the last path), ids_crc32 (of the best ids as
    little-endian unsigned 32-bit integers), paths_sha256 (of every path's score and changes to the best),
    round_trip (decoding gives the text back, U+2581 as a space).
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for part, texts in slices(batches, "_text"):
            out: list[list] = [[], [], [], [], [], [], []]
            for text, (ids, paths) in zip(texts, m.encode(texts, n_best)):
                same = m.decode(ids.tolist()) == (text or "").replace(MARK, " ")
                row = (len(ids), paths[0][0], len(paths), paths[-1][0], zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(repr(paths).encode()).hexdigest(), same)
                for column, value in zip(out, row):
                    column.append(value)
            kinds = (pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column("_id"), *(pa.array(c, k) for c, k in zip(out, kinds))], schema.names)

    kinds = {"n_pieces": T.LongType(), "score": T.DoubleType(), "n_paths": T.IntegerType(), "last_score": T.DoubleType(), "ids_crc32": T.LongType(), "paths_sha256": T.StringType(), "round_trip": T.BooleanType()}
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), *(T.StructField(k, v) for k, v in kinds.items())])
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(rows, schema).withColumnRenamed("_id", id_col)
