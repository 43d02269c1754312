"""Dataset statistics, splits and subsets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxspark.sources.staged import stage


def dataset_stats(labels: DataFrame, images: DataFrame) -> DataFrame:
    """One row: images, boxes, mean, least and most of w and h, mean area."""
    area = F.col("w") * F.col("h")
    boxes = labels.agg(
        F.count(F.lit(1)).alias("n_boxes"), F.avg("w").alias("mean_w"), F.avg("h").alias("mean_h"), F.avg(area).alias("mean_area"),
        F.min("w").alias("min_w"), F.max("w").alias("max_w"), F.min("h").alias("min_h"), F.max("h").alias("max_h"),
    )
    return boxes.crossJoin(images.agg(F.count(F.lit(1)).alias("n_images")))  # one row by one row


def images_per_split(images: DataFrame) -> DataFrame:
    """split, n_images; images without a split are those of a null one."""
    return images.groupBy("split").agg(F.count(F.lit(1)).alias("n_images"))


def class_distribution(labels: DataFrame, classes: DataFrame) -> DataFrame:
    n = labels.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(classes).join(n, "class_id", "left").select("class_id", "name", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def imbalance_ratio(distribution: DataFrame) -> DataFrame:
    return distribution.agg((F.max("n") / F.coalesce(F.min(F.when(F.col("n") > 0, F.col("n"))), F.lit(1))).alias("imbalance"))


def rolled_up(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """(outer, inner, n) with totals by outer and over all, totals marked by level."""
    return rows.rollup(outer, inner).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


def order_statistics(values: DataFrame, column: str, ranks: list[int], bins: int = 1000) -> list[float]:
    """The values at some ranks (from 0, rising), exactly, without a sort: each round counts the bins of the ranges that hold a
    rank and goes on in the bins that do, until a bin's values are one. A round is one aggregate that combines before it
    shuffles and returns at most ``bins`` rows a rank; a range shrinks to a bin's own least and largest value, which differ in
    bin the next time, so a handful of rounds find any double."""
    v = values.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    lo, hi, n = v.agg(F.min("v"), F.max("v"), F.count(F.lit(1))).first()
    found: dict[int, float] = {}
    ranges = {(lo, hi): (0, n)} if n else {}  # (least, largest) -> (rows before, rows)
    while ranges:
        wide = {}
        for (a, b), (before, size) in ranges.items():
            held = [r for r in ranks if before <= r < before + size]
            if held and a == b:
                found |= dict.fromkeys(held, a)
            elif held:
                wide[a, b] = before
        if not wide:
            break
        at = F.lit(None).cast("int")
        place = F.lit(None).cast("int")
        for k, (a, b) in enumerate(wide):
            inside, half = F.col("v").between(a, b), 1.0 if math.isfinite(b - a) else 0.5  # ranges are apart
            share = (F.col("v") * half - a * half) / F.lit(b * half - a * half)
            at = F.when(inside, F.lit(k)).otherwise(at)
            place = F.when(inside, F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")).otherwise(place)
        rows = v.select("v", at.alias("_at"), place.alias("_bin")).where("_at IS NOT NULL").groupBy("_at", "_bin").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count(F.lit(1)).alias("n")).collect()
        ranges = {}
        for k, before in enumerate(wide.values()):
            for r in sorted((r for r in rows if r["_at"] == k), key=lambda r: r["_bin"]):
                ranges[r["a"], r["b"]] = (before, r["n"])
                before += r["n"]
    return [found[r] for r in ranks] if n else []


def percentiles(values: DataFrame, column: str, points: list[float]) -> DataFrame:
    """One row, an array: linear-interpolated percentiles of the values that are not null or NaN (null, without any). The
    values are made once and staged, eight bytes a row at most."""
    v = F.col(column).cast("double")
    values = stage(values.where(v.isNotNull() & ~F.isnan(v)).select(v.alias(column)), "percentiles")  # every round reads this, not what made it
    n = values.count()
    places = [p * (n - 1) for p in points]
    ranks = sorted({r for at in places for r in (int(at), min(int(at) + 1, n - 1))}) if n else []
    known = dict(zip(ranks, order_statistics(values, column, ranks)))
    cuts = [known[int(at)] if at == int(at) else (int(at) + 1 - at) * known[int(at)] + (at - int(at)) * known[int(at) + 1] for at in places] if n else None
    return values.sparkSession.createDataFrame([(cuts,)], "cuts array<double>")


def class_ids(names: DataFrame, name_col: str) -> DataFrame:
    """Distinct names in order with ids from 0."""
    order = Window.orderBy("name")  # one row a name
    return names.select(F.col(name_col).alias("name")).where("name IS NOT NULL").distinct().withColumn("class_id", F.row_number().over(order).cast("bigint") - 1)


def _key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")).cast("binary"))


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts' texts only."""
    digest = F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def split_dataset(images: DataFrame, train: float = 0.7, val: float = 0.2, seed: int = 42, id_col: str = "image_id") -> DataFrame:
    """image_id, split with exact sizes int(n * train), int(n * val) and the rest, in the order of a seeded hash.

    No global sort: hash prefixes are counted, the prefixes that hold the two cuts are found, and only rows of those
    are ranked. Rows with a null id have no place and are left out."""
    rows = images.where(F.col(id_col).isNotNull()).select(F.col(id_col), _key(id_col, seed).alias("_k"), F.conv(F.substring(_key(id_col, seed), 1, 4), 16, 10).cast("int").alias("_p"))
    sizes = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # at most 65,536 rows
    upto = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_n").over(Window.partitionBy())
    cuts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).withColumn("_a", F.floor(total * train)).withColumn("_b", F.floor(total * train).cast("bigint") + F.floor(total * val))
    placed = rows.join(F.broadcast(cuts), "_p")
    whole = lambda cut: F.col("_before") + F.col("_n") <= F.col(cut)
    inside = lambda cut: (F.col("_before") < F.col(cut)) & ~whole(cut)
    cut_here = inside("_a") | inside("_b")
    sure = placed.where(~cut_here).select(id_col, F.when(whole("_a"), "train").when(whole("_b"), "val").otherwise("test").alias("split"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_p").orderBy("_k", id_col))
    ranked = placed.where(cut_here).withColumn("_rank", rank).select(id_col, F.when(F.col("_rank") <= F.col("_a"), "train").when(F.col("_rank") <= F.col("_b"), "val").otherwise("test").alias("split"))
    return sure.unionByName(ranked)


def subset(images: DataFrame, fraction: float, seed: int = 42, id_col: str = "image_id") -> DataFrame:
    """A fraction of the images, the same on every run."""
    return images.where(hash_unit(F.col(id_col), F.lit(seed)) < fraction)
