"""Mixing sources to target weights, with DataFrame functions only.

The words of each source form one stream, packed into blocks of ``block_words`` words. Every slot of an output shard
draws its source, with the sources' expected slots as weights, so a shard's counts are multinomial. What is drawn beyond
a source's expected slots, in its last shards, goes to the sources that were drawn too seldom, so that the whole mix
meets its targets. Slot j of a source takes block ``permutation(j mod n)`` of its n blocks, with another pseudorandom
permutation on each pass, and slots meet blocks by index. So all blocks of a source are taken once before any is taken
twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxspark.llm.common import WORD, running_totals, stage

#: Weights of sources in code-point order, repeated; a source is repeated at most this often.
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: A document of more than one part in LONG of its source's words is long: a source has fewer than LONG of them.
LONG = 10_000
#: Rows of a table of sources (a few numbers each) that are sent to every executor; more are joined by shuffling.
MOST_SENT = 100_000


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), size.alias("size"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """One row a source: _source, source_size, target (double).

    Sources in code-point order, null last, get the weights in turn and share the sum of all sizes. A target stops at
    ``most_repeats`` times its source's size and the excess goes to the others by weight, until none is above. Each
    round is one aggregate over the sources; rounds end when no further source is full.
    """
    sources = sizes.groupBy("_source").agg(F.sum("size").alias("source_size")).withColumn("_last", F.col("_source").isNull().cast("int")).withColumn("_one", F.lit(1).cast("long"))
    ranked = running_totals(sources, ["_last", "_source"], "_one", "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("before") % len(weights) + 1).cast("int"))
    ranked = stage(ranked.select("_source", "source_size", F.col("before").alias("_rank"), weight.alias("_weight")), "mix-targets")
    most = F.col("source_size") * F.lit(float(most_repeats))
    level, full_before = 0.0, -1
    while True:  # the level only rises, so each round adds a full source or ends
        full = F.col("_weight") * F.lit(level) > most
        row = ranked.agg(
            F.sum("source_size").alias("all"), F.sum(full.cast("long")).alias("n"),
            F.sum(F.when(full, most)).alias("held"), F.sum(F.when(~full, F.col("_weight"))).alias("weights"),
        ).first()
        if row["all"] is None or not row["weights"] or (row["n"] == full_before):
            break
        full_before = row["n"]
        level = (row["all"] - (row["held"] or 0.0)) / row["weights"]
    return ranked.withColumn("target", F.least(F.col("_weight") * F.lit(level), most))


def permuted(at: Column, n: Column, key: list[Column], rounds: int = 12) -> Column:
    """Swap-or-not shuffle of 0..n-1: a bijection for any n, made of rounds that each swap ``x`` with ``k - x`` or not."""

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit("k"), *key, r), n) - x, n)
        swap = F.xxhash64(F.lit("b"), *key, r, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), at, step)


def _picked(points: DataFrame, at: str, intervals: DataFrame, total: int, cells: int) -> DataFrame:
    """``points`` with ``_rank`` and ``_lo`` of the interval [_lo, _hi) of 0..total-1 that ``at`` falls into. Both meet
    in cells of equal width, so a point sees few intervals."""
    cell = max(1, -(-total // cells))
    grid = intervals.where("_hi > _lo").select("_rank", "_lo", "_hi", F.explode(F.expr(f"sequence(_lo div {cell}, (_hi - 1) div {cell})")).alias("_cell"))
    return points.withColumn("_cell", F.expr(f"{at} div {cell}")).join(grid, "_cell").where(f"{at} >= _lo AND {at} < _hi").drop("_cell", "_hi")


def _slots(aims: DataFrame, n_slots: int, shard_slots: int, n_sources: int, seed: int) -> DataFrame:
    """(_rank, shard, _slot): each slot of the mix, numbered from 0 within its source."""
    spark = aims.sparkSession
    per_task = 500_000
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-n_slots // per_task))
    n_shards = max(1, round(n_slots / shard_slots))
    length, cells = -(-n_slots // n_shards), max(256, n_sources)
    total = aims.agg(F.max("_hi")).first()[0]
    draws = spark.range(0, n_slots, 1, parts).select(
        F.expr(f"id div {length}").alias("shard"), F.pmod(F.xxhash64(F.lit("draw"), F.lit(seed), "id"), F.lit(total)).alias("_u")
    )
    counts = _picked(draws, "_u", aims.select("_rank", "_lo", "_hi"), total, cells).groupBy("_rank", "shard").agg(F.count(F.lit(1)).alias("n"))
    counts = running_totals(counts, ["_rank", "shard"], "n", "mix-counts")
    drawn = stage(counts.groupBy("_rank").agg(F.sum("n").alias("_drawn"), F.min("before").alias("_before")), "mix-drawn")
    wanted = aims.select("_rank", "_expected").join(drawn, "_rank", "left").na.fill(0, ["_drawn", "_before"])
    counts = stage(
        counts.join(wanted, "_rank").withColumn("_first", F.col("before") - F.col("_before"))
        .withColumn("_keep", F.greatest(F.lit(0), F.least("n", F.col("_expected") - F.col("_first"))).cast("long"))
        .select("_rank", "shard", "_first", "_keep", (F.col("n") - F.col("_keep")).alias("_over")), "mix-kept",
    )
    # Rows are few and become many: they are dealt by number of tasks, which is not lowered for their small size.
    dealt = counts.where("_keep > 0").repartition(parts, "_rank", "shard")
    slots = dealt.select("_rank", "shard", F.explode(F.expr("sequence(_first, _first + _keep - 1)")).alias("_slot"))
    over = counts.agg(F.sum("_over")).first()[0] or 0
    if over:
        short = wanted.withColumn("_short", F.greatest(F.lit(0), F.col("_expected") - F.col("_drawn")).cast("long"))
        short = stage(running_totals(short, ["_rank"], "_short", "mix-short").select("_rank", "_drawn", F.col("before").alias("_lo"), (F.col("before") + F.col("_short")).alias("_hi")), "mix-gaps")
        given = running_totals(counts.where("_over > 0").select("_rank", "shard", "_over"), ["_rank", "shard"], "_over", "mix-over")
        given = given.repartition(parts, "_rank", "shard").select("shard", F.explode(F.expr("sequence(before, before + _over - 1)")).alias("_q"))
        given = _picked(given, "_q", short, over, cells).join(short.select("_rank", "_drawn"), "_rank")
        slots = slots.unionByName(given.select("_rank", "shard", (F.col("_drawn") + F.col("_q") - F.col("_lo")).alias("_slot")))
    return slots


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17,
    block_words: int = 64, shard_slots: int = 4096, weights: tuple = WEIGHTS, most_repeats: int = MOST_REPEATS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, slots, pieces).

    documents: id, size, source_size, target, taken, source_rank (the source's place), one row a row of ``docs``. slots: the mix itself, one row a slot
    of an output shard: shard, _source, pass, block. pieces: which words of which document a block holds: _source,
    block, _id, from_word, words.

    A null text has size 0; rows of size 0 have taken 0; a null source is a source of its own, in the last place;
    null and repeated ids are ordinary rows. Without any word all targets and takes are 0. No row is taken more than
    ``most_repeats`` times. The same rows, seed and settings give the same mix. Other columns are not read.
    """
    sizes = stage(sized(docs, id_col, text_col, source_col), "mix-sizes")
    n_docs = sizes.count()
    buckets = max(64, -(-n_docs // 50_000))
    aims = targets(sizes, weights, most_repeats)

    # Where each document starts in its source's stream: documents of a source are dealt to buckets by a hash of the
    # id, buckets sum alone, and one row a bucket is enough to place the buckets behind one another.
    bucketed = sizes.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(buckets)).cast("int"))
    starts = bucketed.groupBy("_source", "_bucket").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_source", "_bucket").orderBy("_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        bucketed.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
        .select("_id", "_source", "size", (F.col("_inside") + F.col("_offset")).alias("_start"))
    )
    end = F.col("_start") + F.col("size")
    first, last = F.expr(f"_start div {block_words}"), F.expr(f"(_start + size - 1) div {block_words}")
    pieces = (
        placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
        .withColumn("from_word", F.greatest(F.col("block") * block_words, F.col("_start")) - F.col("_start"))
        .withColumn("words", F.least((F.col("block") + 1) * block_words, end) - F.col("_start") - F.col("from_word"))
    )

    # Expected slots of each source, in its own blocks. Shares are whole numbers of 1 / 2 ** 20 slots and are rounded
    # along their running total, so the expected slots add up and none is off by more than one.
    blocks = F.expr(f"(source_size + {block_words - 1}) div {block_words}")
    share = F.when(F.col("source_size") > 0, F.col("target") * F.col("_blocks") / F.col("source_size")).otherwise(0.0)
    aims = aims.withColumn("_blocks", blocks).withColumn("_share", F.round(share * F.lit(float(1 << 20))).cast("long"))
    aims = running_totals(aims, ["_rank"], "_share", "mix-shares").withColumn("_lo", F.col("before")).withColumn("_hi", F.col("before") + F.col("_share"))
    aims = stage(aims.withColumn("_expected", F.shiftright("_hi", 20) - F.shiftright("_lo", 20)).drop("before"), "mix-aims")
    sums = aims.agg(F.sum("_expected"), F.count(F.lit(1))).first()
    n_slots, n_sources = sums[0] or 0, sums[1]
    if n_slots:
        slots = _slots(aims, n_slots, shard_slots, n_sources, seed)
    else:
        slots = aims.select("_rank", F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("_slot")).limit(0)
    slots = (
        slots.join(aims.select("_rank", "_source", "_blocks"), "_rank")
        .where(F.col("_slot") < F.col("_blocks") * most_repeats)
        .withColumn("pass", F.expr("_slot div _blocks"))
        .withColumn("block", permuted(F.expr("_slot % _blocks"), F.col("_blocks"), [F.lit(seed), F.col("_rank"), F.col("pass")]))
        .select("shard", "_source", "pass", "block")
    )

    times = slots.groupBy("_source", "block").agg(F.count(F.lit(1)).alias("_times")).select(F.col("_source").alias("_s"), F.col("block").alias("_k"), "_times")
    took = (
        pieces.join(times, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_k")), "left")
        .groupBy("_id", "_source", "size", "_start")
        .agg(F.sum(F.col("words") * F.coalesce("_times", F.lit(0))).alias("taken"))
        .select("_id", "_source", "size", "taken")
    )
    empty = sizes.where("size = 0").select("_id", "_source", "size", F.lit(0).cast("long").alias("taken"))
    named = aims.select(F.col("_source").alias("_s"), "source_size", "target", F.col("_rank").alias("source_rank"))
    documents = (
        took.unionByName(empty)
        .join(F.broadcast(named) if n_sources <= MOST_SENT else named, F.col("_source").eqNullSafe(F.col("_s")))
        .select(F.col("_id").alias(id_col), "size", "source_size", "target", "taken", "source_rank")
    )
    return documents, slots, pieces.select("_source", "block", "_id", "from_word", "words")


def _copies(documents: DataFrame, most: int, seed: int, name: str) -> DataFrame:
    """``documents`` (_key, _rank, _size, _share) with ``_times``: shares as whole copies, rounded along their running
    total by source and size. In a source any run of sizes has its copies to one, so the words of copies and shares
    differ by at most about its longest document."""
    fixed = F.round(F.least(F.col("_share"), F.lit(float(most))) * F.lit(float(1 << 20))).cast("long")
    placed = running_totals(
        documents.withColumn("_fixed", fixed).withColumn("_order", F.xxhash64(F.lit("round"), F.lit(seed), "_key")), ["_rank", "_size", "_order", "_key"], "_fixed", name
    )
    half = 1 << 19
    return placed.withColumn("_times", F.shiftright(F.col("before") + F.col("_fixed") + half, 20) - F.shiftright(F.col("before") + half, 20))


def _paid(long_: DataFrame, most: int, seed: int) -> DataFrame:
    """_rank, _owed, copies (array of _key, _times) of each source's long documents, at most LONG of them: from the longest to
    the shortest, each is copied as often as pays the words that are owed so far, so each shorter one pays what rounding left."""
    order = F.struct((-F.col("_size")).alias("less"), F.xxhash64(F.lit("round"), F.lit(seed), "_key").alias("o"), "_key", F.col("_taken").cast("long").alias("taken"))
    start = F.struct(F.lit(0).cast("long").alias("owed"), F.array().cast(f"array<struct<_key:{long_.schema['_key'].dataType.simpleString()},_times:bigint>>").alias("copies"))

    def pay(acc: Column, d: Column) -> Column:
        owed, size = acc["owed"] + d["taken"], -d["less"]
        times = F.greatest(F.lit(0), F.least(F.lit(most), F.floor((2 * owed + size) / (2 * size)))).cast("long")
        return F.struct((owed - times * size).alias("owed"), F.array_append(acc["copies"], F.struct(d["_key"].alias("_key"), times.alias("_times"))).alias("copies"))

    each = long_.groupBy("_rank").agg(F.array_sort(F.collect_list(order)).alias("docs"))
    return each.select("_rank", F.aggregate("docs", start, pay).alias("paid")).select("_rank", F.col("paid.owed").alias("_owed"), F.col("paid.copies").alias("copies"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes its words, in whole takes; not taken: left out.

    A source's documents of more than a ten-thousandth of its words, fewer than 10,000, pay the words taken one after the other,
    from long to short. What is still owed then is made up by the shares of the shorter ones, which are rounded along running
    totals. So each source's words in the result are its taken words up to about its shortest document, or a ten-thousandth of
    its words where it has shorter ones. Rows that repeat an id (null is an id here) have one share and are repeated alike.
    Texts without words are left out; a null source is a source. Columns of ``docs`` keep their names and values; an empty
    table gives an empty one.
    """
    documents, _, _ = mix(docs, id_col, text_col, source_col, seed, **how)
    most = how.get("most_repeats", MOST_REPEATS)
    each = documents.where("size > 0").groupBy(F.col(id_col).alias("_key")).agg(
        F.min("source_rank").alias("_rank"), F.sum("size").alias("_size"), F.sum("taken").alias("_taken"), F.max("source_size").alias("_words")
    )
    each = stage(each.withColumn("_share", F.col("_taken") / F.col("_size")).withColumn("_long", F.col("_size") * LONG > F.col("_words")), "mix-shares-of-documents")
    paid = stage(_paid(each.where("_long"), most, seed), "mix-long")
    short = each.where("NOT _long")
    made_up = short.groupBy("_rank").agg(F.sum("_taken").alias("_short")).join(paid.select("_rank", "_owed"), "_rank", "left")
    factor = F.greatest(F.lit(0.0), 1 + F.try_divide(F.coalesce(F.col("_owed"), F.lit(0)), F.col("_short")))
    made_up = stage(made_up.select("_rank", F.coalesce(factor, F.lit(1.0)).alias("_factor")), "mix-factors")
    short = short.join(F.broadcast(made_up) if made_up.count() <= MOST_SENT else made_up, "_rank").withColumn("_share", F.col("_share") * F.col("_factor")).drop("_factor")
    times = paid.select(F.inline("copies")).unionByName(_copies(short, most, seed, "mix-short-documents").select("_key", "_times"))
    times = stage(times.where("_times > 0").select(F.col("_key").alias("_mixed"), F.col("_times").cast("int").alias("_times")), "mix-copies")
    joined = docs.join(times.hint("merge"), docs[id_col].eqNullSafe(times["_mixed"]))  # one plan at every size: both sides grow
    copy = "_".join([*docs.columns, "copy"])  # no column of docs has this name
    repeated = joined.select(*(docs[c] for c in docs.columns), F.explode(F.sequence(F.lit(1), times["_times"])).alias(copy))
    return repeated.drop(copy)
