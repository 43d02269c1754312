"""Helpers shared by the corpus operators: staged tables, ranges and Arrow slices."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxspark.sources.staged import new_path, shared_dir, stage  # noqa: F401

#: ASCII white space, as the contracts name it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_held_out_fold(id_col: Column | str) -> Column:
    """crc32 of the id as text, mod 5, is 0. A null id counts as held out, so nothing is learned from it."""
    id_col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def running_totals(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over all rows that come earlier by ``order``.

    Rows are dealt by ranges of ``order`` and staged with the number of their range, each range sums alone, and only
    one row a range meets in one place. No window spans the whole table."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = stage(
        df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), f"{name}-ranges"
    )
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))  # at most n rows
    each = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_range", F.coalesce(F.sum("_sum").over(each), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.join(F.broadcast(offsets), "_range")
        .withColumn("before", F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col("_offset"))
        .drop("_range", "_offset")
    )


def slices(batches: Iterator, text: str, most: int = 600_000) -> Iterator[tuple]:
    """(rows, texts) of Arrow batches, cut so that one slice holds about ``most`` bytes of text or one row."""
    for batch in batches:
        sizes = batch.column(text).nbytes
        step = max(1, batch.num_rows * most // max(sizes, 1))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, part.column(text).to_pylist()


def with_facts(rows: DataFrame, facts: DataFrame, on: list[str], weight: str, total: int, spread: Column, partitions: int | None = None) -> DataFrame:
    """``rows`` with ``_fact``, a struct of the other columns of ``facts``, which has one row a key ``on``; null where it has none.

    ``weight`` says how many rows may ask for a key, and all weights add up to ``total`` at most. The at most 1,000
    facts of a thousandth of ``total`` or more are broadcast; rows that they answer are dealt by ``spread`` in the
    shuffled join of all others, so that no key fills a task. ``partitions``: in how many parts that join deals the rows. Keys must not be null."""
    fact = F.struct(*(c for c in facts.columns if c not in on))
    hot = facts.where(F.col(weight) * F.lit(1000) >= F.lit(max(total, 1))).select(*on, fact.alias("_hot"))
    cold = facts.select(*on, F.lit(0).cast("long").alias("_turn"), fact.alias("_cold"))
    turn = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(spread, F.lit(1 << 20))).cast("long")
    found = rows.join(F.broadcast(hot), on, "left").withColumn("_turn", turn)
    found = (found.repartition(partitions, *on, "_turn") if partitions else found).join(cold, [*on, "_turn"], "left")
    return found.withColumn("_fact", F.coalesce("_hot", "_cold")).drop("_hot", "_cold", "_turn")
