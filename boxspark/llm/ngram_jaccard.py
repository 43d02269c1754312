"""N-gram Jaccard join with count-vector R-trees.

A document is the set of its distinct word n-grams. Grams are hashed to groups; the counts of a set in the groups are a
point. Larger sets have more groups (powers of two up to ``GROUPS``, so a point folds onto fewer by adding): with too few,
counts of any two long texts are alike and all of them would be tied. The overlap of two sets is at most the sum over the groups of the smaller count, and for two boxes
of points at most the sum of the smaller upper bounds, so an R-tree of points passes over pairs of nodes, then pairs
of points, that cannot reach the overlap that the similarity needs. What survives is verified on the sets.

Trees are built where linked documents are certain to meet. First over the points of the documents that share a gram
of their prefix (see ``prefix``): pairs that survive there are ties. Then over the points of the ties' components, cut
into tiles of bounded size, where what survives is verified; each pair of tiles of a component is one small join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxspark.llm.common import running_totals, slices, stage
from boxspark.llm.components import components

GROUPS = 4_096
LEAST_GROUPS = 32
#: Counts that are compared, or held in trees of one search, at a time; where more would be, sets fold onto fewer groups.
CELLS = 8_000_000
#: A stored count of MANY stands for that or more; as a bound it is read as without limit.
MANY = 255
#: About so many sets with a prefix gram in common are searched together, so that they fit a task. A gram's sets are dealt to
#: blocks of half that many; each pair of blocks is one search.
MOST_SEARCHED = 20_000
#: Entries of a leaf and of an inner node of the R-tree.
FAN_OUT = 32
_U = np.uint64
_ODD = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


@lru_cache(maxsize=1)
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """A random 64-bit value of every byte at each of 64 places, upper-case letters as lower-case, and which bytes are
    white space."""
    values = np.random.default_rng(5).integers(0, 2**64, (256, 64), dtype=np.uint64)
    values[65:91] = values[97:123]
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    return values.reshape(-1), space


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, where each text's words end).

    A word's hash is the sum of random values of its bytes at their places, each stretch of 64 places with a random
    factor of its own: no place is a power of another, so no pattern of bytes makes different words alike."""
    raw = [(t or "").encode() for t in texts]
    lengths = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    values, space = _bytes()
    is_space = space[data]
    edges = np.flatnonzero(is_space[1:] != is_space[:-1]) + 1
    if len(data) and not is_space[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    sizes = ends - starts
    letters = data[~is_space]
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(letters), dtype=np.int32) - np.repeat(first.astype(np.int32), sizes)
    terms = values[(letters.astype(np.int32) << 6) + (place & 63)]
    if len(sizes) and int(sizes.max()) > 64:
        with np.errstate(over="ignore"):
            terms = terms * (_mix((place >> 6).astype(np.uint64) * _U(_ODD)) | _U(1))
    hashes = _mix(np.add.reduceat(terms, first)) if len(first) else np.zeros(0, np.uint64)
    return hashes, np.searchsorted(starts, np.cumsum(lengths))


def gram_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Each text's set of distinct n-grams as sorted 64-bit hashes. Fewer than n words: the whole sequence as one."""
    words, ends = word_hashes(texts)
    with np.errstate(over="ignore"):
        grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for i in range(n):
            grams = grams * _U(0x2545F4914F6CDD1D) + words[i : i + len(grams)]
        grams = _mix(grams + _U(n))
        out, start = [], 0
        for end in ends.tolist():
            if end - start >= n:
                out.append(np.unique(grams[start : end - n + 1]))
            elif end > start:
                h = np.uint64(0)
                for w in words[start:end]:
                    h = h * _U(0x2545F4914F6CDD1D) + w
                out.append(_mix(np.array([h + _U(end - start)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
            start = end
    return out


def needed(a: int | np.ndarray, b: int | np.ndarray, percent: int):
    """Least overlap of sets of a and b grams whose Jaccard similarity is percent / 100 or more."""
    return -(-percent * (a + b) // (100 + percent))


def prefix(grams: np.ndarray, percent: int, common: np.ndarray) -> np.ndarray:
    """Grams of which two linked sets share at least one: the first n - ceil(n * percent / 100) + 1 in an order that
    is the same for every set. The order puts grams of ``common`` (known to be frequent) last, which only saves work."""
    n = len(grams)
    keep = n + 1 - -(-percent * n // 100)
    if len(common) and n:
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        often = common[at] == grams
        if often.any():
            grams = np.concatenate([grams[~often], grams[often]])
    return grams[:keep]


def n_groups(size: int) -> int:
    """About eight grams a group, up to sixteen of long texts: fewer would carry more bytes, more would let random counts hide
    a difference. Twice the grams have at most twice the groups."""
    small = min(256, max(LEAST_GROUPS, 1 << max(0, size // 8).bit_length()))
    return min(GROUPS, max(small, 1 << (size // 16).bit_length()))


def held_groups(groups: int, sets: int) -> int:
    """At most ``groups``, fewer where counts of ``sets`` sets would take too much memory."""
    while groups > LEAST_GROUPS and groups * sets > CELLS:
        groups //= 2
    return groups


def point(grams: np.ndarray, groups: int) -> np.ndarray:
    """How many grams of a set each group has."""
    return np.bincount((grams >> _U(8) & _U(groups - 1)).astype(np.int64), minlength=groups)


def folded(points: np.ndarray, groups: int) -> np.ndarray:
    return points.reshape(len(points), -1, groups).sum(axis=1, dtype=np.int32)


def unpacked(packed: np.ndarray, own: np.ndarray, groups: int) -> np.ndarray:
    """Packed points of ``own`` groups each, folded onto ``groups`` or fewer."""
    out = np.empty((len(packed), groups), np.int32)
    for n in np.unique(own).tolist():
        rows = np.flatnonzero(own == n)
        raw = np.frombuffer(b"".join(packed[rows].tolist()), np.uint8).reshape(-1, n)
        out[rows] = folded(np.where(raw == MANY, np.int32(1 << 20), raw.astype(np.int32)), groups)
    return out


def _sets(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """_id, text_key (a hash of the text), n_shingles, h1, h2 (a 128-bit hash of the set), its point and, on one row a
    slice, grams that several texts share."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "_text"):
            sets = gram_sets(texts, n)
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            with np.errstate(over="ignore"):
                ends = np.cumsum(sizes)
                both = []
                for salt in (1, 2):
                    sums = np.concatenate([[_U(0)], np.cumsum(_mix(flat * _U(_ODD) + _U(salt)), dtype=np.uint64)])
                    both.append(_mix(sums[ends] - sums[ends - sizes]).view(np.int64))
            seen, times = np.unique(flat, return_counts=True)
            often = seen[times >= 3].view(np.int64)
            shared = pa.array([often.tolist() if i == 0 else None for i in range(len(sets))], pa.list_(pa.int64()))
            points = pa.array([np.minimum(point(x, n_groups(len(x))), MANY).astype(np.uint8).tobytes() for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("text_key"), pa.array(sizes), pa.array(both[0]), pa.array(both[1]), points, shared], schema.names)

    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("text_key", "n_shingles", "h1", "h2")), T.StructField("point", T.BinaryType()), T.StructField("shared", T.ArrayType(T.LongType()))])
    return _keyed(docs, id_col, text_col).mapInArrow(rows, schema)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(F.col(text_col)).alias("text_key"))


def _ties(docs: DataFrame, text_col: str, n: int, percent: int, common) -> DataFrame:
    """(gram, set): a row for each prefix gram of each text's set, sets by h1; copies within a task once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = common.value, set()
        for _, texts in slices(batches, "_text"):
            grams, ids, sizes = [], [], []
            for s in gram_sets(texts, n):
                if not len(s):
                    continue
                with np.errstate(over="ignore"):
                    h1 = int(_mix(np.add.reduce(_mix(s * _U(_ODD) + _U(1)), dtype=np.uint64, keepdims=True)).view(np.int64)[0])
                if h1 in seen:
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(h1)
                grams.append(prefix(s, percent, often))
                ids.append(h1)
                sizes.append(len(grams[-1]))
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), sizes))], ["gram", "set"])

    return docs.select(F.col(text_col).alias("_text")).mapInArrow(rows, "gram bigint, set bigint")


def _search(percent: int):
    """Ties (src, dst) of sets with a prefix gram in common whose points allow the overlap they need. Rows come sorted
    by gram; a short run of a gram is compared at every distance at once, a longer one through an R-tree."""

    def few(gram, sets, sizes, groups, points) -> list[np.ndarray]:
        out = []
        for lag in range(1, 16):
            same = np.flatnonzero((gram[lag:] == gram[:-lag]) & (sets[lag:] != sets[:-lag]))
            least = np.minimum(sizes[same], sizes[same + lag])
            same = same[needed(sizes[same], sizes[same + lag], percent) <= least]
            level = np.minimum(groups[same], groups[same + lag])
            for g in np.unique(level):
                all_ = same[level == g]
                for start in range(0, len(all_), max(1, CELLS // 2 // int(g))):
                    at = all_[start : start + max(1, CELLS // 2 // int(g))]
                    bound = np.minimum(unpacked(points[at], groups[at], g), unpacked(points[at + lag], groups[at + lag], g)).sum(axis=1)
                    ok = at[bound >= needed(sizes[at], sizes[at + lag], percent)]
                    out.append(np.column_stack([sets[ok], sets[ok + lag]]))
        return out

    def many(sets, sizes, groups, points) -> np.ndarray:
        parent = np.arange(len(sets))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        # Of sets that can be similar the larger has at most 200 / percent as many groups as the smaller.
        levels = np.unique(groups)
        for g in levels:
            own = np.flatnonzero(groups == g)
            others = [np.flatnonzero(groups == more) for more in levels[(levels > g) & (levels * percent <= g * 200)]]
            held = held_groups(int(g), len(own) + sum(map(len, others)))
            tree = RTree(unpacked(points[own], groups[own], held), sizes[own])
            found = [(own, tree, own, tree, True)]
            for other in others:
                found.append((own, tree, other, RTree(unpacked(points[other], groups[other], held), sizes[other]), False))
            for rows_a, a, rows_b, b, same in found:
                for i, j in pairs(a, b, percent, same):
                    for x, y in zip(rows_a[a.order[i]].tolist(), rows_b[b.order[j]].tolist()):
                        p, q = root(x), root(y)
                        if p != q:
                            parent[max(p, q)] = min(p, q)
        tops = np.array([root(x) for x in range(len(sets))])
        tied = np.flatnonzero(tops != np.arange(len(sets)))
        return np.column_stack([sets[tied], sets[tops[tied]]])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last gram's rows so far

        def tie(gram, *rest) -> list[np.ndarray]:
            starts = np.flatnonzero(np.diff(gram, prepend=gram[0] - 1))
            lengths = np.diff(starts, append=len(gram))
            short = np.repeat(lengths <= 16, lengths)
            out = few(gram[short], *(x[short] for x in rest))
            for lo, n in zip(starts[lengths > 16].tolist(), lengths[lengths > 16].tolist()):
                out.append(many(*(x[lo : lo + n] for x in rest)))
            return out

        def batch_of(found: list[np.ndarray]) -> pa.RecordBatch:
            both = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["src", "dst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            packed = batch.column("point").to_numpy(zero_copy_only=False)
            new = [batch.column(c).to_numpy() for c in ("gram", "set", "n_shingles")]
            new += [np.fromiter(map(len, packed), np.int64, len(packed)), packed]
            found = []
            now = new if held is None else [np.concatenate([a, b]) for a, b in zip(held, new)]
            held = None
            if len(now[0]):
                last = int(np.flatnonzero(now[0] == now[0][-1])[0])
                if last:
                    found += tie(*(x[:last] for x in now))
                held = [x[last:] for x in now]
            if found:
                yield batch_of(found)
        if held is not None and len(held[0]) > 1:
            yield batch_of(tie(*held))

    return rows


class RTree:
    """Points packed by sort-tile order into leaves and nodes that keep upper bounds of counts and least set sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        spread = np.argsort(-points[:: max(1, len(points) // 2000)].var(axis=0), kind="stable")[:3]
        order = np.argsort(sizes, kind="stable")
        for level, axis in enumerate(spread):
            run = max(FAN_OUT, int(len(order) ** ((3 - level) / 4)))
            order = np.concatenate([part[np.argsort(points[part, axis], kind="stable")] for part in np.split(order, range(run, len(order), run))])
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        self.levels = []  # from the leaves up: (upper bounds, least size, entries' starts)
        top, least = self.points, self.sizes
        while len(top) > 1 or not self.levels:
            starts = np.arange(0, len(top), FAN_OUT)
            top, least = np.maximum.reduceat(top, starts), np.minimum.reduceat(least, starts)
            self.levels.append((top, least))


def pairs(a: RTree, b: RTree, percent: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in each tree's order) of points whose summed minima reach the overlap that they need."""

    def entries(tree: RTree, level: int, node: int, open_it: bool) -> tuple[int, int, np.ndarray, np.ndarray]:
        """(level, first entry, bounds, least sizes) of a node's entries, or of the node itself."""
        level, first, n = (level - 1, node * FAN_OUT, FAN_OUT) if open_it else (level, node, 1)
        top, least = (tree.points, tree.sizes) if level == 0 else tree.levels[level - 1]
        return level, first, top[first : first + n], least[first : first + n]

    work = [(len(a.levels), 0, len(b.levels), 0)]  # level 0: a point
    while work:
        level_a, node_a, level_b, node_b = work.pop()
        la, oa, ta, sa = entries(a, level_a, node_a, level_a >= level_b)
        lb, ob, tb, sb = entries(b, level_b, node_b, level_b >= level_a)
        bound = np.minimum(ta[:, None, :], tb[None, :, :]).sum(axis=2, dtype=np.int64)
        i, j = np.nonzero(bound >= needed(sa[:, None], sb[None, :], percent))
        i, j = i + oa, j + ob
        if la or lb:
            keep = i <= j if same and la == lb else slice(None)
            work += [(la, x, lb, y) for x, y in zip(i[keep].tolist(), j[keep].tolist())]
        else:
            keep = i < j if same else slice(None)
            if len(i[keep]):
                yield i[keep], j[keep]


def overlaps(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (x[k], y[k]) of positions of ``sets``.

    A few pairs are looked up one by one; many pairs of few sets share one table of which set holds which gram."""
    left, right = np.unique(x), np.unique(y)
    if len(x) <= 4 * (len(left) + len(right)):
        out = np.empty(len(x), np.int64)
        for k, (i, j) in enumerate(zip(x.tolist(), y.tolist())):
            a, b = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            out[k] = np.count_nonzero(b[at] == a)
        return out
    both = np.union1d(left, right)
    sizes = np.array([len(sets[k]) for k in both.tolist()])
    grams, where = np.unique(np.concatenate([sets[k] for k in both.tolist()]), return_inverse=True)
    table = np.zeros((len(both), len(grams)), np.float32)
    table[np.repeat(np.arange(len(both)), sizes), where] = 1
    counts = table[np.searchsorted(both, left)] @ table[np.searchsorted(both, right)].T
    return np.rint(counts[np.searchsorted(left, x), np.searchsorted(right, y)]).astype(np.int64)


def linked(sets: list[np.ndarray], copies: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(links that connect all linked sets of ``left`` x ``right``, how many documents each set links with). Positions;
    the same array for a join with itself. Every surviving pair is verified, none is put out: the first are enough to
    connect, of the others only the number counts."""
    parent = np.arange(len(sets))

    def roots(at: np.ndarray) -> np.ndarray:
        up = parent[at]
        while (up != (more := parent[up])).any():
            up = more
        parent[at] = up
        return up

    def tree(which: np.ndarray) -> RTree:
        points = np.zeros((len(which), groups), np.int32)
        for row, k in enumerate(which.tolist()):
            points[row] = point(sets[k], groups)
        return RTree(points, sizes[which])

    same = left is right
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    groups = held_groups(n_groups(int(sizes[np.concatenate([left, right])].max())), len(left) + len(right))
    ta = tree(left)
    tb = ta if same else tree(right)
    out, links = [], np.zeros(len(sets), np.int64)
    for i, j in pairs(ta, tb, percent, same):
        x, y = left[ta.order[i]], right[tb.order[j]]
        ok = overlaps(sets, x, y) >= needed(sizes[x], sizes[y], percent)
        x, y = x[ok], y[ok]
        np.add.at(links, x, copies[y])
        np.add.at(links, y, copies[x])
        new = roots(x) != roots(y)
        for p, q in zip(x[new].tolist(), y[new].tolist()):
            a, b = (int(r) for r in roots(np.array([p, q])))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((p, q))
    return out, links


def _classes(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, tile: int, most_common: int, most_searched: int) -> DataFrame:
    """_id, text_key, n_shingles, component_id, n_links: one row a row of ``docs``."""
    spark = docs.sparkSession
    found = stage(_sets(docs, id_col, text_col, n), "jaccard-sets")
    shared = found.select(F.explode("shared").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("times"))
    rows = shared.orderBy(F.desc("times"), "gram").limit(most_common).select("gram").toArrow()
    common = spark.sparkContext.broadcast(np.sort(rows.column(0).to_numpy().view(np.uint64)))
    alike = ["n_shingles", "h1", "h2"]  # equal sets are one set, whose text is that of its smallest id (null last)
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), "text_key")).alias("first")
    reps = found.where("n_shingles > 0").groupBy(*alike).agg(first, F.first("point").alias("point"), F.count(F.lit(1)).alias("copies"))
    key = F.concat(F.lpad(F.hex("h1"), 16, "0"), F.lpad(F.hex("h2"), 16, "0"))
    reps = stage(reps.select(*alike, key.alias("set"), "first.id", "first.text_key", "point", "copies"), "jaccard-reps")

    # Both uses of the ties read this one shuffle: neither filters nor drops a column before it.
    ties = _ties(docs, text_col, n, percent, common).where("gram IS NOT NULL AND set IS NOT NULL").repartition("gram")
    met = ties.groupBy("gram").agg(F.min("set").alias("_near"), F.max("set").alias("_far"), F.count(F.lit(1)).alias("_rows")).where("_near < _far").select("gram", "_rows")
    points = reps.select(F.col("h1").alias("set"), "n_shingles", "point")
    # A block meets each other block of its gram; a gram of one block is one group.
    blocks = F.expr(f"CASE WHEN _rows > {most_searched} THEN int(ceil(_rows * 2D / {most_searched})) ELSE 1 END")
    own = F.pmod(F.xxhash64("set", F.lit("block")), F.col("_blocks")).cast("int")
    others = F.expr("CASE WHEN _blocks = 1 THEN array(0) ELSE filter(sequence(0, _blocks - 1), o -> o <> _own) END")
    group = F.when(F.col("_blocks") == 1, F.col("gram")).otherwise(F.xxhash64("gram", F.least("_own", "_other"), F.greatest("_own", "_other")))
    once = ties.join(met, "gram").dropDuplicates(["gram", "set"])  # copies in several tasks; dealt by gram already
    dealt = once.withColumn("_blocks", blocks).withColumn("_own", own).withColumn("_other", F.explode(others)).select(group.alias("gram"), "set")
    meetings = dealt.join(points, "set").select("gram", "set", "n_shingles", "point")
    pairs_found = meetings.repartition("gram").sortWithinPartitions("gram").mapInArrow(_search(percent), "src bigint, dst bigint")
    tied = components(pairs_found, "jaccard-ties")

    near = reps.join(tied, reps["h1"] == tied["node"]).select("set", "id", "text_key", "copies", "n_shingles", F.col("component").alias("tied"))
    near = running_totals(near, ["tied", "n_shingles", "set"], "n_shingles", "jaccard-near")
    spans = near.groupBy("tied").agg(F.min("before").alias("_first"), F.count(F.lit(1)).alias("_sets")).where("_sets > 1")
    near = stage(
        near.join(spans, "tied").select("set", "id", "text_key", "copies", "tied", "n_shingles", F.expr(f"int((before - _first) div {tile})").alias("tile")), "jaccard-tiles"
    )
    ranges = near.groupBy("tied", "tile").agg(F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi"))
    other = ranges.select(F.col("tied").alias("t2"), F.col("tile").alias("tile2"), F.col("lo").alias("lo2"))
    tile_pairs = ranges.join(other, (F.col("tied") == F.col("t2")) & (F.col("tile") <= F.col("tile2")) & (F.col("lo2") * percent <= F.col("hi") * 100)).select("tied", "tile", "tile2")
    sides = tile_pairs.select("tied", "tile", F.col("tile").alias("i"), F.col("tile2").alias("j")).unionByName(
        tile_pairs.where("tile < tile2").select("tied", F.col("tile2").alias("tile"), F.col("tile").alias("i"), F.col("tile2").alias("j"))
    )

    # Small components share a group; a pair of tiles of a large one is a group of its own. All this is settled on
    # rows without texts, so sets move once.
    total = near.agg(F.sum("n_shingles")).first()[0] or 0
    bins = max(1, int(total // tile) * 2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    group = F.when(F.col("j") > 0, F.xxhash64("tied", "i", "j")).otherwise(F.pmod(F.xxhash64("tied"), F.lit(bins)))
    own = ["set", "id", "text_key", "copies", "tied", "tile"]
    near = near.join(sides, ["tied", "tile"]).groupBy(*own).agg(F.collect_list(F.struct("i", "j", group.alias("bin"))).alias("places"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "_text"):
            packed = pa.array([s.tobytes() for s in gram_sets(texts, n)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in schema.names[:-1]), packed], schema.names)

    # A set's text is found by its id and key. The hint keeps one plan at every size: ``near`` grows with the corpus.
    texts, hinted = _keyed(docs, id_col, text_col), near.hint("merge")
    schema = T.StructType([*(near.schema[c] for c in ("set", "copies", "tied", "tile", "places")), T.StructField("grams", T.BinaryType())])
    sets = texts.join(hinted, (texts["text_key"] == near["text_key"]) & texts["_id"].eqNullSafe(near["id"])).select(*schema.names[:-1], "_text").mapInArrow(grams, schema)
    work = sets.select("set", "copies", "tied", "tile", "grams", F.explode("places").alias("p")).select("set", "copies", "tied", "tile", "grams", "p.i", "p.j", "p.bin")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for (_, i, j), rows in pdf.groupby(["tied", "i", "j"], sort=False):
            rows = rows.drop_duplicates("set")  # rows that repeat an id and its text
            own, at, names = [np.frombuffer(g, np.uint64) for g in rows["grams"]], rows["tile"].to_numpy(), rows["set"].tolist()
            left = np.flatnonzero(at == i)
            right = left if i == j else np.flatnonzero(at == j)
            if len(left) and len(right) and len(rows) > 1:
                edges, links = linked(own, rows["copies"].to_numpy(), left, right, percent)
                out += [(names[x], names[y], 0) for x, y in edges]
                out += [(names[x], None, int(links[x])) for x in np.flatnonzero(links).tolist()]
        return pd.DataFrame(out, columns=["src", "dst", "n"])

    links = stage(work.groupBy("bin").applyInPandas(link, "src string, dst string, n bigint"), "jaccard-links")
    groups = components(links.where("dst IS NOT NULL"), "jaccard-links")
    ids = groups.join(reps.select("set", "id"), groups["node"] == F.col("set")).groupBy("component").agg(F.min("id").alias("component_id"))
    n_links = links.where("dst IS NULL").groupBy("src").agg(F.sum("n").alias("n_links"))
    of_sets = groups.join(ids, "component").join(n_links, F.col("node") == F.col("src")).select("node", "component_id", "n_links")
    where = reps.join(of_sets, F.col("set") == F.col("node"), "left").select(
        *(F.col(c).alias(f"_{c}") for c in alike), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        (F.coalesce("n_links", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links"),
    )
    return (
        found.join(where, (F.col("n_shingles") == F.col("_n_shingles")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
        .select("_id", "text_key", "n_shingles", F.coalesce("component_id", "_id").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    )


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80,
    tile: int = 500_000, most_common: int = 500_000, most_searched: int = MOST_SEARCHED,
) -> DataFrame:
    """One row a row of ``docs``: id, n_shingles, component_id, n_links.

    Words are runs of anything but ASCII white space, A-Z as a-z. Sets link when 100 * intersection is at least
    ``percent`` * union; component_id is the smallest id reachable over links, n_links the number of other rows that a
    row links with, rows of an equal set included. Texts of fewer than n words are one gram; null texts and texts
    without words have the empty set, link with nothing and are their own component. Rows that repeat a text or an id
    are rows like others. A null id is never the smallest: its row has the component of what it links with, null where
    nothing there has an id. Whole texts and all links count; other columns are not read. Grams are 64-bit hashes, sets
    128-bit ones; words are hashed so that no pattern of bytes makes them collide.

    ``tile``: grams of the sets that one small join holds of either side. ``most_common``: how many frequent grams the
    prefix order knows (8 bytes each, sent to every executor); a bound on that saves less work but loses no link, nor
    does ``most_searched``.
    """
    found = _classes(docs, id_col, text_col, n, percent, tile, most_common, most_searched)
    return found.select(F.col("_id").alias(id_col), "n_shingles", "component_id", "n_links")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, tile: int = 500_000, most_common: int = 500_000) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, all columns as they are. Texts without words stay;
    rows that repeat such an id and its text stay with it; a null id stays where its component has no other."""
    found = _classes(docs, id_col, text_col, n, percent, tile, most_common, MOST_SEARCHED)
    # One plan at every size: what stays grows with the corpus.
    least = found.where(F.col("_id").eqNullSafe(F.col("component_id"))).select(F.col("_id").alias("_stays"), F.col("text_key").alias("_key")).distinct().hint("merge")
    return docs.join(least, docs[id_col].eqNullSafe(least["_stays"]) & (F.xxhash64(docs[text_col]) == least["_key"]), "left_semi")
