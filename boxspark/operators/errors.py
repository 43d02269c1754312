"""Error attribution, hard-example mining and the plans made from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxspark.functions.geometry import area_ratio, box, hardness, oversample_ratio, variant_count


def attributed(outcomes: DataFrame, gt: DataFrame, features: DataFrame, blur_below: float = 100.0, small_below: float = 0.01, side: int = 640) -> DataFrame:
    """FP and FN rows of ``outcomes`` with a reason, from image features (image_id, lap_var; no row: image missing)."""
    area = gt.select("image_id", "box_idx", (box().area / F.lit(side * side)).alias("_ratio"))
    rows = outcomes.where(F.col("outcome").isin("FP", "FN")).join(features, "image_id", "left").join(area, ["image_id", "box_idx"], "left")
    blurred, there = F.col("lap_var") < blur_below, F.col("lap_var").isNotNull()
    reason = F.when(F.col("outcome") == "FP", F.when(blurred, "blur").otherwise("background")).otherwise(
        F.when(~there, "missing").when(F.col("_ratio") < small_below, "small_target").when(blurred, "blur").otherwise("missing")
    )
    return rows.select("image_id", F.col("outcome").alias("error_type"), "class_id", "pred_idx", "box_idx", "conf", reason.alias("reason"))


def error_summary(outcomes: DataFrame) -> DataFrame:
    """One row: fp, fn, correct, precision, recall."""
    sums = outcomes.agg(*(F.coalesce(F.sum((F.col("outcome") == k).cast("bigint")), F.lit(0)).cast("bigint").alias(v) for k, v in (("FP", "fp"), ("FN", "fn"), ("correct", "correct"))))
    p = F.when(F.col("correct") + F.col("fp") > 0, F.col("correct") / (F.col("correct") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("correct") + F.col("fn") > 0, F.col("correct") / (F.col("correct") + F.col("fn"))).otherwise(0.0)
    return sums.withColumn("precision", p).withColumn("recall", r)


def reason_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy("error_type", "reason").agg(F.count(F.lit(1)).alias("n"))


def recommendations(errors: DataFrame) -> DataFrame:
    """code, one row each: sides whose share of a reason passes its limit; else balanced, or good without errors."""
    n = lambda kind, reason=None: F.sum(((F.col("error_type") == kind) & (F.col("reason") == reason if reason else F.lit(True))).cast("bigint"))
    row = errors.agg(n("FP").alias("fp"), n("FN").alias("fn"), n("FP", "blur").alias("bf"), n("FP", "background").alias("gf"), n("FN", "small_target").alias("sn"), n("FN", "blur").alias("bn")).na.fill(0)
    codes = F.array_compact(F.array(
        F.when(F.col("bf") > 0.2 * F.col("fp"), "blur_fp"), F.when(F.col("gf") > 0.3 * F.col("fp"), "background_fp"),
        F.when(F.col("sn") > 0.3 * F.col("fn"), "small_fn"), F.when(F.col("bn") > 0.2 * F.col("fn"), "blur_fn"),
    ))
    none = F.when(F.col("fp") + F.col("fn") == 0, F.array(F.lit("good"))).otherwise(F.array(F.lit("balanced")))
    return row.select(F.explode(F.when(F.size(codes) > 0, codes).otherwise(none)).alias("code"))


def class_recommendations(per_class: DataFrame, least: float = 0.5) -> DataFrame:
    """class_id, code for classes of low precision (false_alarm) or recall (miss)."""
    low = lambda c, code: per_class.where(F.col(c) < least).select("class_id", F.lit(code).alias("code"))
    return low("precision", "false_alarm").unionByName(low("recall", "miss"))


def first_of_each(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each key."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("rank", at).where(F.col("rank") <= n)


def small_cases(gt: DataFrame, pred: DataFrame, images: DataFrame, small_below: float = 0.01) -> DataFrame:
    """image_id, source, idx, class_id, conf of boxes of either source that are small in their image."""
    both = gt.select("image_id", F.lit("gt").alias("source"), F.col("box_idx").alias("idx"), "class_id", "x1", "y1", "x2", "y2", F.lit(0.0).alias("conf")).unionByName(
        pred.select("image_id", F.lit("pred").alias("source"), F.col("pred_idx").alias("idx"), "class_id", "x1", "y1", "x2", "y2", "conf")
    )
    sized = both.join(images.select("image_id", "width", "height"), "image_id")
    return sized.where(area_ratio(box(), F.col("width"), F.col("height")) < small_below).select("image_id", "source", "idx", "class_id", "conf")


def hard_cases(outcomes: DataFrame, small: DataFrame, conf_above: float = 0.0) -> DataFrame:
    """image_id, error_type, class_id, conf, score of false alarms, misses and small boxes."""
    wrong = outcomes.where(F.col("outcome").isin("FP", "FN")).select("image_id", F.col("outcome").alias("error_type"), "class_id", "conf")
    rows = wrong.unionByName(small.select("image_id", F.lit("small").alias("error_type"), "class_id", "conf"))
    return rows.where((F.col("error_type") != "FP") | (F.col("conf") >= conf_above)).withColumn("score", hardness(F.col("error_type"), F.col("conf"), F.lit(0.0)))


def hard_report(cases: DataFrame) -> DataFrame:
    """error_type, n, avg_score of the three types, absent ones as zeros."""
    spine = cases.sparkSession.createDataFrame([("FP",), ("FN",), ("small",)], "error_type string")
    found = cases.groupBy("error_type").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("avg_score"))
    return spine.join(F.broadcast(found), "error_type", "left").select("error_type", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), F.coalesce("avg_score", F.lit(0.0)).alias("avg_score"))


def class_weights(cases: DataFrame, classes: DataFrame) -> DataFrame:
    """class_id, weight: the largest class count over the class's own; a class without cases gets the largest count."""
    n = cases.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    rows = classes.select("class_id").join(n, "class_id", "left")
    most = F.max("n").over(Window.partitionBy())  # one row a class
    return rows.select("class_id", F.when(F.col("n") > 0, most / F.col("n")).otherwise(F.coalesce(most, F.lit(0)).cast("double")).alias("weight"))


_VARIANTS = {
    "FP": [("blur", True), ("bright_7", False), ("bright_13", False), ("noise", False)],
    "FN": [("scale_8", False), ("scale_12", False), ("bright_7", False), ("bright_13", False), ("noise", False)],
    "small": [("scaleup_12", False), ("scaleup_15", False), ("blur", True), ("noise", False)],
}


def variant_plan(cases: DataFrame, features: DataFrame, blur_below: float = 100.0, most: int = 4) -> DataFrame:
    """image_id, error_type, variant: the first variants of each kind, as many as the hardest case calls for. The
    blurred variant is for images that are blurred already."""
    blurred = F.coalesce(F.col("lap_var") < blur_below, F.lit(False))
    sight = features.groupBy("image_id").agg(F.min(blurred).alias("_least"), F.max(blurred).alias("_most"))  # rows of an image may differ
    hardest = cases.groupBy("image_id", "error_type").agg(F.max("score").alias("score"))
    count = variant_count(F.col("score"), most)
    rows = hardest.where(count > 0).join(sight.hint("shuffle_hash"), "image_id", "left")

    def variants(blurred: Column) -> Column:
        arrays = F.lit(None).cast("array<string>")
        for kind, names in _VARIANTS.items():
            options = F.array_compact(F.array(*(F.when(blurred, v) if only else F.lit(v) for v, only in names)))
            arrays = F.when(F.col("error_type") == kind, options).otherwise(arrays)
        return F.slice(arrays, 1, count)

    return rows.select("image_id", "error_type", F.explode(F.array_union(*(variants(F.coalesce(c, F.lit(False))) for c in ("_least", "_most")))).alias("variant"))


def oversampled(cases: DataFrame, most: int = 5) -> DataFrame:
    """image_id, copies: how often the hardest case of an image lets it appear."""
    return cases.groupBy("image_id").agg(F.max(oversample_ratio(F.col("score"), most)).cast("bigint").alias("copies"))


def ranked(cases: DataFrame) -> DataFrame:
    return cases.groupBy("image_id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n"))


def strategies(cases: DataFrame, most: int = 5) -> DataFrame:
    """image_id, copies, score, n: ``oversampled`` and ``ranked`` of each image from one grouping of its cases."""
    found = cases.groupBy("image_id").agg(F.max(oversample_ratio(F.col("score"), most)).cast("bigint").alias("copies"), F.max("score").alias("score"), F.count(F.lit(1)).alias("n"))
    return found.where("image_id IS NOT NULL")


def merged_images(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Images of either set once, with ``source`` base before extra."""
    rows = base.select("image_id", F.lit(0).alias("p")).unionByName(extra.select("image_id", F.lit(1).alias("p")))
    return rows.groupBy("image_id").agg(F.min("p").alias("p")).select("image_id", F.when(F.col("p") == 0, "base").otherwise("extra").alias("source"))


def minority_copies(gt: DataFrame, ratio: float = 0.5) -> DataFrame:
    """image_id, copies of images that hold a class with under ``ratio`` of the largest class's boxes: enough copies
    to reach that ratio (a definition of this library)."""
    n = gt.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    most = F.max("n").over(Window.partitionBy())  # one row a class
    rare = n.withColumn("goal", most * ratio).where(F.col("n") < F.col("goal")).select("class_id", F.ceil(F.col("goal") / F.col("n")).cast("bigint").alias("copies"))
    return gt.join(F.broadcast(rare), "class_id").groupBy("image_id").agg(F.max("copies").alias("copies"))
