"""Secret scans with corpus-wide ownership frequency, with DataFrame functions only.

Base spans come from three patterns. Further candidates are long tokens that mix letters and digits. Every candidate
value is hashed, and the hashes are counted over the whole corpus by distinct repositories and owners: a value that
many owners or many repositories hold is a widely copied example, one that few of both hold and that looks random is
live-looking. The method adds spans of live-looking candidates that no base span covers, under the kind ``owned``; base spans stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxspark.llm.common import stage

#: Kinds in the order that breaks ties between spans with the same start.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A maximal run that is long enough is the match of the contract that is kept: shorter runs are whole matches too.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LONG = r"[A-Za-z0-9+/_-]{20,}"
LEAST_VALUE = 6
#: A value that this many owners, or this many repositories, hold is a widely copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 5, 10


def _matches(text: Column, pattern: str, kind: str) -> Column:
    """Array of (kind, place, gap, size, value) of leftmost matches that do not overlap: the code points between a match
    and the one before it, and its own. Nothing is summed here, so the work is in proportion to the matches; only texts
    with a match are split."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else found
    steps = F.arrays_zip(found.alias("m"), F.slice(between, F.lit(1), F.size(found)).alias("between"), values.alias("v"))

    def one(x: Column, i: Column) -> Column:
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("place"), F.length(x["between"]).alias("gap"), F.length(x["m"]).alias("size"), x["v"].alias("value"))

    return F.when(text.rlike(pattern), F.transform(steps, one)).otherwise(F.array().cast("array<struct<kind:int,place:int,gap:int,size:int,value:string>>"))


def _spans(found: DataFrame) -> DataFrame:
    """One row a span: _row, _repository, _owner, span (start, end, kind, value). Places are running sums within a row
    and kind. Long tokens stay only where they look random and no base span overlaps them, which running extremes over
    the row's spans tell: the furthest end of the base spans that start no later, and the next start after it."""
    each = found.where(F.size("matches") > 0).select("_row", "_repository", "_owner", F.explode("matches").alias("m")).select("_row", "_repository", "_owner", "m.*")
    in_order = Window.partitionBy("_row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.repartition("_row").withColumn("end", F.sum(F.col("gap") + F.col("size")).over(in_order).cast("int"))
    each = each.withColumn("start", F.col("end") - F.col("size"))
    assign, long_ = (F.col("kind") == KINDS.index(k) for k in ("assign", "owned"))
    each = each.where((~assign | (F.length("value") >= LEAST_VALUE)) & (~long_ | looks_random(F.col("value"))))
    row = Window.partitionBy("_row")
    reached = F.max(F.when(~long_, F.col("end"))).over(row.orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.min(F.when(~long_, F.col("start"))).over(row.orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    each = each.withColumn("_reached", reached).withColumn("_ahead", ahead)
    covered = (F.coalesce("_reached", F.lit(0)) > F.col("start")) | (F.coalesce(F.col("_ahead") < F.col("end"), F.lit(False)))
    return each.where(~long_ | ~covered).select("_row", "_repository", "_owner", F.struct("start", "end", "kind", "value").alias("span"))


def _joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined, by start and then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.concat_ws(",", F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def looks_random(value: Column) -> Column:
    """Letters and digits, at least ten different characters, and no run of one character through half of it."""
    different = F.size(F.array_distinct(F.filter(F.split(value, ""), lambda c: c != "")))
    return value.rlike("[A-Za-z]") & value.rlike("[0-9]") & (different >= 10) & (different * 4 >= F.least(F.length(value), F.lit(40)))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: Column | str = "doc_id", owner: Column | str = "source",
    example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES,
) -> tuple[DataFrame, DataFrame]:
    """(documents, values).

    documents: id, base and added (arrays of start, end, kind, value), examples and live (how many of the document's
    candidate values are widely copied, or held by few and random-looking). values: value_hash, repositories, owners,
    copied. A value is widely copied when ``example_owners`` or more owners or ``example_repositories`` or more
    repositories hold it; it can be live only when both counts stay below.

    Null texts are empty and have no span; a null owner or repository is one of its own; null and repeated ids are
    ordinary rows (a repository is counted once a value). Rows whose texts have no candidate are kept with empty
    arrays. An empty table gives empty results. Whole texts count, in time in proportion to their matches; other columns
    are not read.
    """
    repository = F.col(repository) if isinstance(repository, str) else repository
    owner = F.col(owner) if isinstance(owner, str) else owner
    rows = docs.select(
        F.col(id_col).alias("_id"), repository.cast("string").alias("_repository"), owner.cast("string").alias("_owner"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")
    )
    matches = F.concat(*(_matches(F.col("_text"), p, k) for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX, LONG))))
    found = stage(rows.select("_id", "_repository", "_owner", matches.alias("matches")).withColumn("_row", F.monotonically_increasing_id()), "secret-matches")
    candidates = stage(_spans(found), "secret-spans").withColumn("value_hash", F.sha2(F.col("span.value").cast("binary"), 256))

    # One row a candidate, its value only as a hash. Counting goes (value, owner, repository), then (value, owner) and
    # (value, repository), then value: each step combines before it shuffles, so a value in a third of all rows stays
    # small. Nulls are counted as a repository or an owner of their own.
    held = stage(candidates.groupBy("value_hash", "_owner", "_repository").agg(F.count(F.lit(1)).alias("_rows")), "secret-held")
    by_owner = held.groupBy("value_hash", "_owner").agg(F.sum("_rows").alias("_rows")).groupBy("value_hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("_rows").alias("_rows"))
    by_repository = held.select("value_hash", "_repository").distinct().groupBy("value_hash").agg(F.count(F.lit(1)).alias("repositories"))
    copied = (F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories)
    values = stage(by_owner.join(by_repository, "value_hash").select("value_hash", "repositories", "owners", copied.alias("copied"), "_rows"), "secret-values")
    # A hot value's rows would all meet its one count: counts of values in many rows are repeated over salts.
    salts = 16
    hot = F.col("_rows") > 1_000
    spread = values.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(-1)))))
    often = values.where(hot).select("value_hash", F.lit(True).alias("_hot"))
    judged = (
        candidates.join(often, "value_hash", "left")
        .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int")).otherwise(F.lit(-1)))
        .join(spread, ["value_hash", "_salt"])
    )
    live = ~F.col("copied") & looks_random(F.col("span.value"))
    is_long = F.col("span.kind") == KINDS.index("owned")
    per_row = judged.groupBy("_row").agg(
        F.sum(F.col("copied").cast("long")).alias("examples"), F.sum(live.cast("long")).alias("live"),
        F.collect_list(F.when(~is_long, F.col("span"))).alias("base"), F.collect_list(F.when(live & is_long, F.col("span"))).alias("added"),
    )
    none = F.array().cast("array<struct<start:int,end:int,kind:int,value:string>>")
    documents = found.select("_row", "_id").join(per_row, "_row", "left").select(
        F.col("_id").alias(id_col), F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"),
        F.coalesce("examples", F.lit(0).cast("long")).alias("examples"), F.coalesce("live", F.lit(0).cast("long")).alias("live"),
    )
    return documents, values.drop("_rows")


def digests(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans, n_added, n_examples, n_live of ``scan``."""
    documents, _ = scan(docs, id_col, **how)
    return documents.select(
        id_col, *(_count(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"), F.col("examples").alias("n_examples"), F.col("live").alias("n_live"),
    )
