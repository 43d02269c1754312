"""Evaluation: precision, recall, F1, curves, average precision, confusion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxspark.operators.match import greedy_match, level_counts, matches_by_threshold, outcomes
from boxspark.sources.staged import stage

LEVELS = [round(0.5 + 0.05 * i, 2) for i in range(10)]
THRESHOLDS = [0.01 + i * (0.98 / 99) for i in range(100)]


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def counts_by_class(pred: DataFrame, gt: DataFrame, classes: DataFrame, **how) -> DataFrame:
    """class_id, name, tp, fp, fn of every class, zeros included."""
    found = outcomes(pred, gt, near=False, **how).groupBy("class_id").agg(
        *(F.sum((F.col("outcome") == k).cast("bigint")).alias(v) for k, v in (("correct", "tp"), ("FP", "fp"), ("FN", "fn")))
    )
    zero = F.lit(0).cast("bigint")
    return F.broadcast(classes).join(found, "class_id", "left").select("class_id", "name", *(F.coalesce(c, zero).alias(c) for c in ("tp", "fp", "fn")))


def with_rates(counts: DataFrame) -> DataFrame:
    tp, p = F.col("tp").cast("double"), F.col("precision")
    rated = counts.withColumn("precision", ratio(tp, F.col("tp") + F.col("fp"))).withColumn("recall", ratio(tp, F.col("tp") + F.col("fn")))
    return rated.withColumn("f1", f1(p, F.col("recall")))


def per_class_metrics(pred: DataFrame, gt: DataFrame, classes: DataFrame, **how) -> DataFrame:
    return with_rates(counts_by_class(pred, gt, classes, **how))


def overall_metrics(per_class: DataFrame, n_images: DataFrame) -> DataFrame:
    """One row of micro totals and the true number of images (a one-row table)."""
    zero = F.lit(0).cast("bigint")
    total = per_class.agg(*(F.coalesce(F.sum(c), zero).alias(c) for c in ("tp", "fp", "fn")))
    return with_rates(total).crossJoin(n_images)


def confusion(pred: DataFrame, gt: DataFrame, conf_t: float = 0.25, iou_t: float = 0.5) -> DataFrame:
    """pred_class, gt_class (-1: background), n. Predictions in the order they come; misses do not enter."""
    rows = outcomes(pred, gt, iou_t, conf_t, "index", near=False).where(F.col("outcome") != "FN")
    return rows.groupBy(F.col("class_id").alias("pred_class"), F.when(F.col("outcome") == "correct", F.col("class_id")).otherwise(-1).alias("gt_class")).agg(F.count(F.lit(1)).alias("n"))


def threshold_bins(pred: DataFrame, thresholds: list[float]) -> DataFrame:
    """pred with ``bin``: how many of the rising ``thresholds`` its confidence reaches."""
    reached = F.size(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= F.col("conf")))
    return pred.withColumn("bin", reached)


def pr_curve(pred: DataFrame, gt: DataFrame, thresholds: list[float] | None = None, iou_t: float = 0.5) -> DataFrame:
    """k, threshold, tp, fp, fn, precision, recall, f1 at each threshold.

    A match depends only on predictions of higher confidence, so one matching serves all thresholds: predictions are
    counted by bins and the at most len(thresholds) bins are summed from above."""
    thresholds = thresholds or THRESHOLDS
    found = greedy_match(pred, gt, iou_t).select("image_id", "pred_idx", F.lit(1).alias("hit"))
    binned = threshold_bins(pred, thresholds).join(found, ["image_id", "pred_idx"], "left").groupBy("bin").agg(
        F.sum(F.coalesce("hit", F.lit(0)).cast("bigint")).alias("tp"), F.count(F.lit(1)).alias("n")
    )
    spark = pred.sparkSession
    grid = spark.createDataFrame([(i, t) for i, t in enumerate(thresholds)], "k int, threshold double")
    total = gt.agg(F.count(F.lit(1)).alias("boxes"))
    from_here = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)  # one row a threshold
    rows = grid.join(F.broadcast(binned), F.col("bin") == F.col("k") + 1, "left")
    rows = rows.select("k", "threshold", F.sum(F.coalesce("tp", F.lit(0))).over(from_here).alias("tp"), F.sum(F.coalesce("n", F.lit(0))).over(from_here).alias("n"))
    rows = rows.crossJoin(F.broadcast(total)).select("k", "threshold", "tp", (F.col("n") - F.col("tp")).alias("fp"), (F.col("boxes") - F.col("tp")).alias("fn"))
    return with_rates(rows)


def list_order_curve(pred: DataFrame, gt: DataFrame, thresholds: list[float] | None = None, iou_t: float = 0.5) -> DataFrame:
    """``pr_curve`` with predictions of an image taken in the order of its list instead of by confidence: a threshold then
    changes who is first, so every threshold has its own matching."""
    thresholds = thresholds or THRESHOLDS
    tp = matches_by_threshold(pred, gt, thresholds, iou_t)
    bins = threshold_bins(pred, thresholds).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    grid = pred.sparkSession.createDataFrame([(i, t) for i, t in enumerate(thresholds)], "k int, threshold double")
    # One row a threshold on either side.
    made = grid.join(F.broadcast(bins), F.col("bin") > F.col("k"), "left").groupBy("k", "threshold").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"))
    rows = made.join(F.broadcast(tp), "k", "left").withColumn("tp", F.coalesce("tp", F.lit(0)).cast("bigint")).crossJoin(F.broadcast(gt.agg(F.count(F.lit(1)).alias("boxes"))))
    return with_rates(rows.select("k", "threshold", "tp", (F.col("n") - F.col("tp")).alias("fp"), (F.col("boxes") - F.col("tp")).alias("fn")))


def optimal_threshold(curve: DataFrame) -> DataFrame:
    """One row: the lowest threshold of the largest F1 (0.5 when all are 0) with its precision and recall, and
    reported_* from the first point within 0.01 of it."""
    best = curve.orderBy(F.desc("f1"), "k").limit(1).select(
        F.when(F.col("f1") > 0, F.col("threshold")).otherwise(0.5).alias("best"), F.col("f1").alias("best_f1"), F.col("precision").alias("p"), F.col("recall").alias("r")
    )
    near = curve.crossJoin(F.broadcast(best)).where(F.abs(F.col("threshold") - F.col("best")) < 0.01).orderBy("k").limit(1)
    return near.select(F.col("best").alias("threshold"), F.col("best_f1").alias("f1"), F.col("p").alias("precision"), F.col("r").alias("recall"), F.col("precision").alias("reported_precision"), F.col("recall").alias("reported_recall"))


def auc_pr(curve: DataFrame) -> DataFrame:
    """Area under precision over recall by the trapezoid rule, points by recall, ties in threshold order."""
    order = Window.orderBy("recall", "k")  # one row a threshold
    step = (F.lead("recall").over(order) - F.col("recall")) * (F.lead("precision").over(order) + F.col("precision")) / 2
    return curve.select(step.alias("s")).agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("auc"))


def carried(rows: DataFrame, keys: list[str], by: str, falling: bool, columns: dict[str, Callable], bins: int = 4096) -> DataFrame:
    """``rows`` with each of ``columns`` replaced by its running sum or maximum over the rows of equal keys up to it, by
    ``by``. ``by`` is cut into steps of 1 / ``bins``: a step runs alone, and one row a step carries what lies before it."""
    order = F.desc if falling else F.asc
    stepped = rows.withColumn("_step", F.floor(F.col(by) * bins))
    each = stepped.groupBy(*keys, "_step").agg(*(f(c).alias(c) for c, f in columns.items()))
    before = Window.partitionBy(*keys).orderBy(order("_step")).rowsBetween(Window.unboundedPreceding, -1)
    each = each.select(*keys, "_step", *(f(c).over(before).alias(f"_before_{c}") for c, f in columns.items()))
    inside = Window.partitionBy(*keys, "_step").orderBy(order(by)).rowsBetween(Window.unboundedPreceding, 0)
    run = stepped.withColumns({c: f(c).over(inside) for c, f in columns.items()}).join(each, [*keys, "_step"])
    both = {F.sum: lambda a, b: a + F.coalesce(b, F.lit(0)), F.max: lambda a, b: F.greatest(a, b)}
    return run.withColumns({c: both[f](F.col(c), F.col(f"_before_{c}")) for c, f in columns.items()}).drop("_step", *(f"_before_{c}" for c in columns))


def average_precision(pred: DataFrame, gt: DataFrame, levels: list[float] | None = None) -> DataFrame:
    """class_id, level, ap: 101-point interpolated average precision of every class that has a box.

    Predictions are counted by class and confidence first, with matches at all levels, so equal confidences enter together; the
    counts are staged. Running sums and maxima are taken in bins of confidence and carried from bin to bin (``carried``), so a
    class is not one task's."""
    levels = levels or LEVELS
    counts = stage(level_counts(pred, gt, levels), "average-precision")
    return _precision(counts, gt.groupBy("class_id").agg(F.count(F.lit(1)).alias("boxes")), levels)


def _precision(counts: DataFrame, boxes: DataFrame, levels: list[float]) -> DataFrame:
    """``average_precision`` from ``level_counts`` and the number of ``boxes`` of each class."""
    at = F.explode(F.arrays_zip(F.array(*map(F.lit, levels)).alias("level"), F.col("tp").alias("tp"))).alias("at")
    points = counts.select("class_id", "conf", "n", at).select("class_id", "at.level", "conf", "n", "at.tp").join(F.broadcast(boxes), "class_id")
    points = carried(points, ["class_id", "level"], "conf", True, {"n": F.sum, "tp": F.sum}).withColumn("best", F.col("tp") / F.col("n"))
    envelope = carried(points, ["class_id", "level"], "conf", False, {"best": F.max})
    # A recall point k / 100 takes the envelope of the first point at or past it: points share out 0..100 among them.
    reach = F.expr("(tp * 100) div boxes")
    shares = envelope.groupBy("class_id", "level", "tp", "boxes").agg(F.max("best").alias("best"))
    shares = shares.withColumn("_reach", reach).withColumn("_from", F.coalesce(F.lag(reach).over(Window.partitionBy("class_id", "level").orderBy("tp")), F.lit(-1).cast("bigint")))
    ap = shares.groupBy("class_id", "level").agg((F.sum(F.col("best") * (F.col("_reach") - F.col("_from"))) / 101).alias("ap"))
    spine = boxes.select("class_id", F.explode(F.array(*map(F.lit, levels))).alias("level"))
    return spine.join(ap, ["class_id", "level"], "left").select("class_id", "level", F.coalesce("ap", F.lit(0.0)).alias("ap"))


def mean_average_precision(ap: DataFrame, weights: tuple[float, float] = (0.1, 0.9)) -> DataFrame:
    """map50, map50_95 and fitness, their weighted sum."""
    row = ap.agg(F.avg(F.when(F.col("level") == 0.5, F.col("ap"))).alias("map50"), F.avg("ap").alias("map50_95"))
    return row.withColumn("fitness", weights[0] * F.col("map50") + weights[1] * F.col("map50_95"))


def class_rates(pred: DataFrame, gt: DataFrame, iou_t: float = 0.5) -> DataFrame:
    """class_id, p, r of the classes that have a box: precision and recall, 0 without a prediction."""
    hits = greedy_match(pred, gt, iou_t).groupBy("class_id").agg(F.count(F.lit(1)).alias("tp"))
    made = pred.groupBy("class_id").agg(F.count(F.lit(1)).alias("made"))
    rows = gt.groupBy("class_id").agg(F.count(F.lit(1)).alias("boxes")).join(made, "class_id", "left").join(hits, "class_id", "left")
    return rows.select("class_id", F.coalesce(F.col("tp") / F.col("made"), F.lit(0.0)).alias("p"), F.coalesce(F.col("tp") / F.col("boxes"), F.lit(0.0)).alias("r"))


def compare_models(pred: DataFrame, gt: DataFrame, levels: list[float] | None = None, weights: tuple[float, float] = (0.1, 0.9)) -> DataFrame:
    """model, map50, map50_95, mean_precision, mean_recall, fitness of the predictions of every ``model``.

    All models go through one matching (``level_counts``), one shuffle of either side, and boxes are not repeated in it. A model
    without any prediction is not there. Null models are one model."""
    levels = levels or LEVELS
    taken = levels if 0.5 in levels else [*levels, 0.5]
    own = F.struct("model", "class_id").alias("class_id")
    counts = stage(level_counts(pred, gt, taken), "compare-models").select(own, "conf", "n", "tp")
    made = stage(pred.groupBy("model", "class_id").agg(F.count(F.lit(1)).alias("made")), "compare-models-made")  # a row a model and class
    boxes = gt.groupBy("class_id").agg(F.count(F.lit(1)).alias("boxes")).crossJoin(F.broadcast(made.select("model").distinct())).select(own, "boxes")
    ap = _precision(counts.withColumn("tp", F.slice("tp", 1, len(levels))), boxes, levels).groupBy("class_id.model").agg(
        F.avg(F.when(F.col("level") == 0.5, F.col("ap"))).alias("map50"), F.avg("ap").alias("map50_95")
    )
    hits = counts.where("conf >= 0").groupBy("class_id").agg(F.sum(F.col("tp")[taken.index(0.5)]).alias("tp"))
    rates = boxes.join(made.select(own, "made"), "class_id", "left").join(hits, "class_id", "left").groupBy("class_id.model").agg(
        F.avg(F.coalesce(F.col("tp") / F.col("made"), F.lit(0.0))).alias("mean_precision"), F.avg(F.coalesce(F.col("tp") / F.col("boxes"), F.lit(0.0))).alias("mean_recall")
    ).withColumnRenamed("model", "_model")
    rows = ap.join(rates, F.col("model").eqNullSafe(F.col("_model")))
    return rows.select("model", "map50", "map50_95", "mean_precision", "mean_recall", (weights[0] * F.col("map50") + weights[1] * F.col("map50_95")).alias("fitness"))


def select_best(metrics: DataFrame, metric: str, order: str) -> DataFrame:
    """The row with the largest ``metric``, of equal ones the first by ``order``."""
    return metrics.orderBy(F.desc_nulls_last(metric), order).limit(1)


def detection_counts(pred: DataFrame, images: DataFrame) -> DataFrame:
    """image_id, detections of every image, those without any included."""
    n = pred.groupBy("image_id").agg(F.count(F.lit(1)).alias("detections"))
    return images.select("image_id").join(n, "image_id", "left").select("image_id", F.coalesce("detections", F.lit(0).cast("bigint")).alias("detections"))
