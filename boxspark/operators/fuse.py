"""Fusing boxes of several views, and suppressing overlapping ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxspark.functions.geometry import box, iou, unproject


CORNERS = ("x1", "y1", "x2", "y2")
#: Cells of a table of groups by members that is worked on at a time.
CELLS = 1_000_000


def _joined(boxes: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """The cluster of each box of padded groups (groups, members, 4): a box joins the first cluster that has an earlier member
    of enough overlap, else it opens one. All groups take a step together, a step a place."""
    groups, most = boxes.shape[:2]
    area = (boxes[:, :, 2] - boxes[:, :, 0]) * (boxes[:, :, 3] - boxes[:, :, 1])
    cluster, opened = np.full((groups, most), -1, np.int64), np.zeros(groups, np.int64)
    for k in range(most):
        earlier, own = boxes[:, :k], boxes[:, k, None]
        wide, high = (np.maximum(np.minimum(earlier[:, :, c + 2], own[:, :, c + 2]) - np.maximum(earlier[:, :, c], own[:, :, c]), 0) for c in (0, 1))
        inter = wide * high
        union = area[:, :k] + area[:, k, None] - inter
        near = np.divide(inter, union, out=np.zeros_like(inter), where=union > 0) >= threshold
        first = np.where(near, cluster[:, :k], most).min(axis=1, initial=most)
        cluster[:, k] = np.where(first < most, first, opened)
        opened += (first == most) & (sizes > k)
    return cluster


def fuse_groups(boxes: np.ndarray, scores: np.ndarray, sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """(group, cluster, score, corners, members) of the clusters of many groups, given one after the other, boxes by falling
    score. Coordinates are score-weighted means (plain ones where all scores are 0), the score is sum(s^2) / sum(s). Groups of
    about one size are worked on together, so padding costs little."""
    starts = np.cumsum(sizes) - sizes
    cluster = np.zeros(len(boxes), np.int64)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    at = 0
    while at < len(order):
        least = int(sizes[order[at]])
        to = int(np.searchsorted(sizes[order], 2 * least, "left"))
        to = min(to, at + max(1, CELLS // (2 * least)))
        some = order[at:to]
        place = np.arange(int(sizes[some].max()))
        held = place[None] < sizes[some][:, None]
        rows = np.where(held, starts[some][:, None] + place[None], 0)
        padded = np.where(held[:, :, None], boxes[rows], 0.0)
        cluster[rows[held]] = _joined(padded, sizes[some], threshold)[held]
        at = to
    group = np.repeat(np.arange(len(sizes)), sizes)
    _, first, one = np.unique(group * (int(sizes.max(initial=0)) + 1) + cluster, return_index=True, return_inverse=True)
    total, squares, members = np.bincount(one, scores), np.bincount(one, scores * scores), np.bincount(one)
    some = total > 0
    weights = np.where(some[one], scores, 1.0)
    corners = [np.bincount(one, boxes[:, c] * weights) / np.where(some, total, members) for c in range(4)]
    return group[first], cluster[first], np.where(some, squares / np.where(some, total, 1), 0.0), corners, members


def ranks(values: pa.Array) -> np.ndarray:
    """Numbers in the order of the values, equal ones alike, null first."""
    coded = values.dictionary_encode()
    place = np.empty(len(coded.dictionary), np.int64)
    place[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(place))
    found = coded.indices.to_numpy(zero_copy_only=False)
    return np.where(np.isnan(found), -1, place[np.nan_to_num(found, nan=0).astype(np.int64)]) if coded.indices.null_count else place[found]


def wbf(dets: DataFrame, threshold: float = 0.5) -> DataFrame:
    """image_id, class_id, fused_idx, score, x1, y1, x2, y2, members of detections (image_id, class_id, det_idx, score,
    corners). A group is one image's views of one class. A window that only counts an image's detections brings them to one
    place, one image after the other; detections that come so already (views of boxes that were made by image) are neither
    shuffled, sorted nor aggregated again. The groups of a batch's whole images are put in order and fused together."""
    rows = dets.select("image_id", "class_id", "det_idx", *(F.col(c).cast("double").alias(c) for c in ("score", *CORNERS)))
    rows = rows.withColumn("_image_n", F.count(F.lit(1)).over(Window.partitionBy("image_id")))

    def fused(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes_at, at = batch.column("_image_n").to_numpy().tolist(), 0
        image = np.zeros(batch.num_rows, np.int64)
        while at < batch.num_rows:  # the place of an image's first row stands for it
            image[at : at + sizes_at[at]] = at
            at += sizes_at[at]
        of_class, det = (ranks(batch.column(c)) for c in ("class_id", "det_idx"))
        score = batch.column("score").to_numpy(zero_copy_only=False)
        order = np.lexsort((det, -score, of_class, image))
        image, of_class = image[order], of_class[order]
        first = np.flatnonzero(np.concatenate([[True], (image[1:] != image[:-1]) | (of_class[1:] != of_class[:-1])]))
        sizes = np.diff(first, append=len(order))
        boxes = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in CORNERS])[order]
        group, cluster, score, corners, members = fuse_groups(boxes, score[order], sizes, threshold)
        own = [batch.column(c).take(pa.array(order[first[group]])) for c in ("image_id", "class_id")]
        made = [pa.array(cluster, pa.int32()), pa.array(score), *(pa.array(c) for c in corners), pa.array(members, pa.int32())]
        return pa.RecordBatch.from_arrays([*own, *made], ["image_id", "class_id", "fused_idx", "score", *CORNERS, "members"])

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows so far of images that have not come whole
        missing = 0
        for batch in batches:
            n, at = batch.column("_image_n").to_numpy(), missing
            whole = 0 if missing > batch.num_rows else missing
            while at < batch.num_rows:
                at += int(n[at])
                if at <= batch.num_rows:
                    whole = at
            missing = at - batch.num_rows
            if whole:
                yield fused(pa.concat_batches([*held, batch.slice(0, whole)]))
                held = []
            if whole < batch.num_rows:
                held.append(batch.slice(whole))

    doubles = [T.StructField(c, T.DoubleType()) for c in ("score", *CORNERS)]
    schema = T.StructType([dets.schema["image_id"], dets.schema["class_id"], T.StructField("fused_idx", T.IntegerType()), *doubles, T.StructField("members", T.IntegerType())])
    return rows.mapInArrow(fuse, schema)


def back_projected(views: DataFrame, images: DataFrame) -> DataFrame:
    """Detections of views (corners, scale, flipped) with their corners on the image. The few images of a task are hashed, so
    the many views need no sort to find theirs."""
    sized = views.join(images.select("image_id", F.col("width").alias("_width")).hint("shuffle_hash"), "image_id")
    b = unproject(box(), F.col("scale"), F.col("flipped"), F.col("_width"))
    return sized.withColumns({"x1": b.x1, "y1": b.y1, "x2": b.x2, "y2": b.y2}).drop("_width")


def tta_fuse(views: DataFrame, images: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Detections of scaled and mirrored views, on the image and fused."""
    return wbf(back_projected(views, images).select("image_id", "class_id", "det_idx", "score", *CORNERS), threshold)


def nms(pred: DataFrame, iou_t: float = 0.5) -> DataFrame:
    """Rows of ``pred`` that no better kept box of their image and class overlaps by more than ``iou_t``."""
    item = F.struct((-F.col("conf")).alias("c"), F.col("pred_idx").cast("bigint").alias("pred_idx"), *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")))
    groups = pred.groupBy("image_id", "class_id").agg(F.array_sort(F.collect_list(item)).alias("boxes"))
    start = F.array().cast("array<struct<c:double,pred_idx:bigint,x1:double,y1:double,x2:double,y2:double>>")

    def step(kept: Column, b: Column) -> Column:
        return F.when(F.exists(kept, lambda k: iou(box(of=k), box(of=b)) > iou_t), kept).otherwise(F.array_append(kept, b))

    kept = groups.select("image_id", "class_id", F.explode(F.aggregate("boxes", start, step)).alias("b"))
    return kept.select("image_id", "class_id", "b.pred_idx", (-F.col("b.c")).alias("conf"), "b.x1", "b.y1", "b.x2", "b.y2")


def top_detections(pred: DataFrame, most: int = 300) -> DataFrame:
    order = Window.partitionBy("image_id").orderBy(F.desc("conf"), "pred_idx")
    return pred.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
