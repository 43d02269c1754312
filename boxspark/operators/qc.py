"""Label quality checks and fixes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxspark.functions.geometry import box, iou, may_reach_iou
from boxspark.operators.stats import percentiles

#: Boxes of an image up to which each meets each.
CROWD = 64


def close_pairs(a: DataFrame, b: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Pairs of a box of ``a`` (corners a_x1 ...) and one of ``b`` (b_x1 ...) with equal ``keys`` that widths and left edges allow
    an IoU of ``threshold``. Each pair comes once.

    Boxes that reach it differ in width by a factor of the threshold at most, and their left edges by what the wider one may
    keep for itself. Widths are cut into bands and left edges, band by band, into cells: a box of ``a`` has one cell, one of
    ``b`` is in the one to four cells that its partners may have. Band and cell are join keys, so an image of very many boxes is
    dealt over many tasks. Boxes without width reach nothing."""
    base = max(threshold**-4, 2.0)
    spare = max(1 - threshold, 0.01)
    band = lambda w: F.floor(F.log(w) / F.lit(math.log(base)))
    cell = lambda x, k: F.floor(x / (F.pow(F.lit(base), k + 1) * F.lit(4 * spare)))
    aw, bw, little = F.col("a_x2") - F.col("a_x1"), F.col("b_x2") - F.col("b_x1"), 1e-9
    left = a.where(aw > 0).withColumn("_band", band(aw)).withColumn("_cell", cell(F.col("a_x1"), F.col("_band")))
    right = b.where(bw > 0).withColumn("_band", F.explode(F.sequence(band(bw * (threshold - little)), band(bw * (1 / threshold + little)))))
    reach = F.least(F.greatest(F.pow(F.lit(base), F.col("_band") + 1), bw), bw * (1 / threshold + little)) * (1 - threshold + little)
    right = right.withColumn("_cell", F.explode(F.sequence(cell(F.col("b_x1") - reach, F.col("_band")), cell(F.col("b_x1") + reach, F.col("_band")))))
    return left.join(right, [*keys, "_band", "_cell"]).drop("_band", "_cell")


def duplicate_pairs(gt: DataFrame, threshold: float = 0.8) -> DataFrame:
    """image_id, i, j, iou of boxes i < j of an image, of any class, whose IoU is ``threshold`` or more.

    Of an image of at most ``CROWD`` boxes each box looks at those after it, in one pass over boxes that lie by image, without a
    join. Boxes of larger images meet in a self join on image, bands and cells (``close_pairs``)."""
    cols = ("x1", "y1", "x2", "y2")
    order = Window.partitionBy("image_id").orderBy("box_idx")  # of both windows, so boxes are sorted once
    whole, later = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), order.rowsBetween(1, CROWD - 1)
    other = F.struct(F.col("box_idx").alias("j"), *(F.col(c).alias(f"b_{c}") for c in cols))
    named = lambda at, p: (F.col("box_idx").alias(at), *(F.col(c).alias(f"{p}_{c}") for c in cols))
    boxes = gt.where("image_id IS NOT NULL AND box_idx IS NOT NULL").select("image_id", "box_idx", *cols)
    counted = boxes.withColumn("_n", F.count(F.lit(1)).over(whole))
    few = counted.withColumn("_later", F.collect_list(other).over(later)).where(F.col("_n") <= CROWD)
    crowds = counted.where(F.col("_n") > CROWD).repartition("image_id", "box_idx")  # dealt once for both sides
    a, b = crowds.select("image_id", *named("i", "a")), crowds.select("image_id", *named("j", "b"))
    columns = ["image_id", "i", "j", *(f"{p}_{c}" for p in "ab" for c in cols)]
    pairs = few.select("image_id", *named("i", "a"), F.inline("_later")).select(columns).unionByName(close_pairs(a, b, ["image_id"], threshold).select(columns))
    near = pairs.where((F.col("i") < F.col("j")) & may_reach_iou(box("a_"), box("b_"), threshold))
    return near.withColumn("iou", iou(box("a_"), box("b_"))).where(F.col("iou") >= threshold).select("image_id", "i", "j", "iou")


def duplicate_boxes(pairs: DataFrame) -> DataFrame:
    return pairs.select("image_id", F.explode(F.array("i", "j")).alias("box_idx")).distinct()


def with_size(gt: DataFrame, images: DataFrame) -> DataFrame:
    return gt.join(images.select("image_id", "width", "height"), "image_id")


def tiny_boxes(sized: DataFrame, pairs: DataFrame, least_pixels: int = 100, least_ratio: float = 0.001) -> DataFrame:
    """Boxes under either limit that are in no duplicate pair."""
    area = box().area
    small = sized.where((area < least_pixels) | (area / (F.col("width") * F.col("height")) < least_ratio))
    return small.join(duplicate_boxes(pairs), ["image_id", "box_idx"], "left_anti").select("image_id", "box_idx", area.alias("area"))


def occlusion_candidates(gt: DataFrame, pairs: DataFrame, tiny: DataFrame) -> DataFrame:
    """Boxes whose pixels are looked at for occlusion: those in no duplicate pair and not tiny."""
    gone = duplicate_boxes(pairs).unionByName(tiny.select("image_id", "box_idx"))
    return gt.join(gone, ["image_id", "box_idx"], "left_anti")


def oversized_boxes(sized: DataFrame, most_ratio: float = 0.9) -> DataFrame:
    ratio = box().area / (F.col("width") * F.col("height"))
    return sized.where(ratio > most_ratio).select("image_id", "box_idx", box().area.alias("area"))


def out_of_bounds(sized: DataFrame, eps: float = 0.0) -> DataFrame:
    """Boxes with a corner outside the image or without width or height (a definition of this library)."""
    b = box()
    bad = (b.x1 < -eps) | (b.y1 < -eps) | (b.x2 > F.col("width") + eps) | (b.y2 > F.col("height") + eps) | (b.width <= 0) | (b.height <= 0)
    return sized.where(bad)


def fixed(gt: DataFrame, pairs: DataFrame, tiny: DataFrame, keep: str = "none") -> DataFrame:
    """Boxes that stay, numbered anew in their old order: duplicates go (both, or with keep="first" only the later),
    and so do tiny boxes."""
    gone = duplicate_boxes(pairs) if keep == "none" else pairs.select("image_id", F.col("j").alias("box_idx")).distinct()
    left = gt.join(gone.unionByName(tiny.select("image_id", "box_idx")), ["image_id", "box_idx"], "left_anti")
    return reindexed(left)


def reindexed(boxes: DataFrame) -> DataFrame:
    order = Window.partitionBy("image_id").orderBy("box_idx")
    return boxes.withColumn("new_idx", F.row_number().over(order).cast("bigint") - 1)


def issues(gt: DataFrame, images: DataFrame, flat: DataFrame | None = None) -> DataFrame:
    """image_id, issue, i, j, value: one row a finding. ``flat`` (image_id, box_idx, variance) are boxes whose pixels hardly
    differ: those in no duplicate pair and not tiny are occluded."""
    sized, pairs = with_size(gt, images), duplicate_pairs(gt)
    tiny, big = tiny_boxes(sized, pairs), oversized_boxes(sized)
    none = F.lit(None).cast("bigint")
    found = (
        pairs.select("image_id", F.lit("duplicate").alias("issue"), "i", "j", F.col("iou").alias("value"))
        .unionByName(tiny.select("image_id", F.lit("tiny").alias("issue"), F.col("box_idx").alias("i"), none.alias("j"), F.col("area").cast("double").alias("value")))
        .unionByName(big.select("image_id", F.lit("oversized").alias("issue"), F.col("box_idx").alias("i"), none.alias("j"), F.col("area").cast("double").alias("value")))
    )
    if flat is None:
        return found
    hidden = occlusion_candidates(flat, pairs, tiny)
    return found.unionByName(hidden.select("image_id", F.lit("occluded").alias("issue"), F.col("box_idx").alias("i"), none.alias("j"), F.col("variance").alias("value")))


def summary(gt: DataFrame, images: DataFrame, flat: DataFrame | None = None) -> DataFrame:
    """One row: boxes, duplicate pairs, tiny, oversized and, with ``flat``, occluded, images with a finding, all findings."""
    kinds = ("duplicate", "tiny", "oversized") + (() if flat is None else ("occluded",))
    per_image = issues(gt, images, flat).groupBy("image_id").agg(*(F.sum((F.col("issue") == k).cast("bigint")).alias(k) for k in kinds))
    total = per_image.agg(*(F.coalesce(F.sum(k), F.lit(0)).cast("bigint").alias(k) for k in kinds), F.count(F.lit(1)).alias("images_with_issues"))
    boxes = gt.agg(F.count(F.lit(1)).alias("n_boxes"))
    return total.crossJoin(boxes).withColumn("total_issues", sum((F.col(k) for k in kinds), F.lit(0)).cast("bigint"))  # one row by one row


def duplicate_contents(content: DataFrame, id_col: str, bytes_col: str) -> DataFrame:
    """digest, n, first id of contents that several images share (a definition of this library)."""
    digest = F.sha2(F.col(bytes_col), 256)
    return content.groupBy(digest.alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id")).where("n > 1")


def resolution_anomalies(images: DataFrame, least_side: int = 32, k: float = 1.5) -> DataFrame:
    """Images with a short side or an area outside k interquartile ranges (a definition of this library)."""
    area = (F.col("width") * F.col("height")).cast("double")
    q = percentiles(images.select(area.alias("area")), "area", [0.25, 0.75]).withColumnRenamed("cuts", "q")
    span = F.col("q")[1] - F.col("q")[0]
    odd = (F.least("width", "height") < least_side) | (area < F.col("q")[0] - k * span) | (area > F.col("q")[1] + k * span)
    return images.crossJoin(F.broadcast(q)).where(odd).drop("q")  # one row of quartiles


def verified(boxes: DataFrame, images: DataFrame, least: float = 0.9) -> DataFrame:
    """image_id, kept, original of every image, counting boxes of confidence ``least`` or more."""
    counts = boxes.groupBy("image_id").agg(F.sum((F.coalesce("conf", F.lit(1.0)) >= least).cast("bigint")).alias("kept"), F.count(F.lit(1)).alias("original"))
    zero = F.lit(0).cast("bigint")
    return images.select("image_id").join(counts, "image_id", "left").select("image_id", F.coalesce("kept", zero).alias("kept"), F.coalesce("original", zero).alias("original"))
