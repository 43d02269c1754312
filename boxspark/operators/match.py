"""Matching predictions to ground truth, one to one and greedily, per image and class.

Predictions and boxes of an image meet once: either side is collected by image in one shuffle, and the join of the two needs no
other. Images are then matched a batch at a time by rounds over all their edges (``greedy``), at one or several IoU levels, and
the same row gives matches, near misses, false positives and misses.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxspark.functions.geometry import box, iou

CORNERS = ("x1", "y1", "x2", "y2")
#: Pairs of a prediction and a box that are looked at together.
PAIRS = 2_000_000
_FOUND = T.ArrayType(T.StructType([
    T.StructField("box", T.ArrayType(T.IntegerType())), T.StructField("iou", T.ArrayType(T.DoubleType())), T.StructField("tp", T.ArrayType(T.BooleanType())), T.StructField("missed", T.ArrayType(T.IntegerType()))
]))


def candidate_edges(pred: DataFrame, gt: DataFrame, least_iou: float = 0.0) -> DataFrame:
    """image_id, class_id, pred_idx, box_idx, conf, iou of every prediction and box of the same image and class whose
    IoU is above 0 and not under ``least_iou``. One shuffle of either side on (image_id, class_id)."""
    p = pred.select("image_id", "class_id", "pred_idx", "conf", *(F.col(c).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2")))
    g = gt.select("image_id", "class_id", "box_idx", "x1", "y1", "x2", "y2")
    found = p.join(g, ["image_id", "class_id"]).withColumn("iou", iou(box("p_"), box()))
    return found.where((F.col("iou") > 0) & (F.col("iou") >= least_iou)).select("image_id", "class_id", "pred_idx", "box_idx", "conf", "iou")


def greedy(pred: np.ndarray, of: np.ndarray, ious: np.ndarray, n_pred: int, n_box: int, iou_t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(box, iou, match) of each prediction, in their order: it takes its best box that is still free; under ``iou_t`` it is
    merely off its place and the box stays free. box is -1 where no edge is left. Edges come by prediction, best box first.

    The sequence is taken in rounds: an edge is final when it is its prediction's best and no earlier undecided prediction
    could take the box. The first undecided prediction always has one, and predictions apart decide together."""
    box_of, iou_of = np.full(n_pred, -1, np.int64), np.zeros(n_pred)
    taker = np.full(n_box, n_pred, np.int64)
    first_wish = np.full(n_box, n_pred, np.int64)
    while len(pred):
        strong = ious >= iou_t
        first_wish[of] = n_pred
        np.minimum.at(first_wish, of[strong], pred[strong])
        best = np.concatenate([[True], pred[1:] != pred[:-1]])
        final = best & (pred <= first_wish[of])
        box_of[pred[final]], iou_of[pred[final]] = of[final], ious[final]
        taker[of[final & strong]] = pred[final & strong]
        # A box that a later prediction has taken was still free for an earlier one, which is merely near to it.
        left = (box_of[pred] < 0) & (taker[of] > pred)
        pred, of, ious = pred[left], of[left], ious[left]
    return box_of, iou_of, (box_of >= 0) & (iou_of >= iou_t)


def _edges(p_key: np.ndarray, p: np.ndarray, g_key: np.ndarray, g: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prediction, box, iou) of pairs of one key whose IoU is above 0 and not under ``least``: by prediction, best box first."""
    order = np.argsort(g_key, kind="stable")
    start = np.searchsorted(g_key[order], p_key, "left")
    counts = np.searchsorted(g_key[order], p_key, "right") - start
    ends = np.cumsum(counts)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    at = 0
    while at < len(p):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        n = counts[at:to]
        i = np.repeat(np.arange(at, to), n)
        j = order[np.repeat(start[at:to] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        a, b = p[i].T, g[j].T
        wide, high = (np.maximum(np.minimum(a[k + 2], b[k + 2]) - np.maximum(a[k], b[k]), 0) for k in (0, 1))
        inter = wide * high
        union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
        found = np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)
        keep = (found > 0) & (found >= least)
        out.append((i[keep], j[keep], found[keep]))
        at = to
    i, j, found = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((j, -found, i))
    return i[order], j[order], found[order]


def _flat(column: pa.ListArray) -> np.ndarray:
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)


def _sizes(column: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(values: pa.Array, n: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), values)


def _batch_edges(sides: tuple, least: float, models: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(predictions an image, boxes an image, edges) of a batch of images, given by class names and corners of either side.
    Predictions and boxes are counted through the batch. ``models``, a number a prediction: each model has the boxes for itself,
    those of model m are counted from m times the number of boxes."""
    p_class, px1, py1, px2, py2, g_class, gx1, gy1, gx2, gy2 = sides
    n_p, n_g = _sizes(p_class), _sizes(g_class)
    names = pa.concat_arrays([p_class.flatten(), g_class.flatten()]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    images = np.concatenate([np.repeat(np.arange(len(n_p)), n_p), np.repeat(np.arange(len(n_g)), n_g)])
    keys = np.where(names < 0, -1 - np.arange(len(names)), images * (len(names) + 1) + names)  # a null class meets nothing
    p, g = np.column_stack([_flat(c) for c in (px1, py1, px2, py2)]), np.column_stack([_flat(c) for c in (gx1, gy1, gx2, gy2)])
    total = int(n_p.sum())
    p_keys, g_keys = keys[:total], keys[total:]
    if models is not None and len(models):
        apart = (len(n_p) + 1) * (len(names) + 1)
        p_keys = np.where(p_keys < 0, p_keys, p_keys + models * apart)
        each = np.arange(models.max() + 1)
        g_keys, g = np.where(g_keys < 0, g_keys, g_keys + each[:, None] * apart).ravel(), np.tile(g, (len(each), 1))
    return n_p, n_g, _edges(p_keys, p, g_keys, g, least)


def _matcher(levels: list[float], near: bool) -> Callable:
    """Arrays of an image's predictions and boxes (in order) to what ``greedy`` finds at each level (_FOUND). Places are
    counted from 0 within the image."""

    def match(
        p_class: pa.Array, px1: pa.Array, py1: pa.Array, px2: pa.Array, py2: pa.Array, g_class: pa.Array, gx1: pa.Array, gy1: pa.Array, gx2: pa.Array, gy2: pa.Array
    ) -> pa.Array:
        n_p, n_g, (i, j, found) = _batch_edges((p_class, px1, py1, px2, py2, g_class, gx1, gy1, gx2, gy2), 0.0 if near else min(levels))
        first_g = np.repeat(np.cumsum(n_g) - n_g, n_p)
        total_p, total_g = int(n_p.sum()), int(n_g.sum())
        parts = []
        for level in levels:
            keep = slice(None) if near else found >= level
            of, ious, tp = greedy(i[keep], j[keep], found[keep], total_p, total_g, level)
            missed = np.ones(total_g, bool)
            missed[of[tp]] = False
            places = np.arange(total_g) - np.repeat(np.cumsum(n_g) - n_g, n_g)
            left = np.bincount(np.repeat(np.arange(len(n_g)), n_g)[missed], minlength=len(n_g))
            parts.append(pa.StructArray.from_arrays([
                _lists(pa.array(np.where(of >= 0, of - first_g, -1), pa.int32()), n_p), _lists(pa.array(ious), n_p), _lists(pa.array(tp), n_p), _lists(pa.array(places[missed], pa.int32()), left)
            ], ["box", "iou", "tp", "missed"]))
        # Levels of an image stand next to each other.
        by_image = pa.concat_arrays(parts).take(pa.array(np.arange(len(levels) * len(n_p)).reshape(len(levels), -1).T.ravel()))
        return _lists(by_image, np.full(len(n_p), len(levels)))

    return match


def matches_by_threshold(pred: DataFrame, gt: DataFrame, thresholds: list[float], iou_t: float = 0.5) -> DataFrame:
    """k, tp: matches of the predictions that reach each threshold, taken in the order of the list (pred_idx), not by
    confidence. Each threshold is a matching of its own, since what is left out changes what is free; the edges of an image
    are found once for all."""

    def count(
        conf: pa.Array, p_class: pa.Array, px1: pa.Array, py1: pa.Array, px2: pa.Array, py2: pa.Array, g_class: pa.Array, gx1: pa.Array, gy1: pa.Array, gx2: pa.Array, gy2: pa.Array
    ) -> pa.Array:
        n_p, n_g, (i, j, found) = _batch_edges((p_class, px1, py1, px2, py2, g_class, gx1, gy1, gx2, gy2), iou_t)
        reached, image = _flat(conf)[i], np.repeat(np.arange(len(n_p)), n_p)
        counts = np.zeros((len(n_p), len(thresholds)), np.int64)
        for k, t in enumerate(thresholds):
            keep = reached >= t
            _, _, tp = greedy(i[keep], j[keep], found[keep], int(n_p.sum()), int(n_g.sum()), iou_t)
            counts[:, k] = np.bincount(image[tp], minlength=len(n_p))
        return _lists(pa.array(counts.ravel()), np.full(len(n_p), len(thresholds)))

    joined = _sides(pred, gt, min(thresholds), "index")
    tp = joined.select(F.posexplode(F.arrow_udf(count, T.ArrayType(T.LongType()))("preds.conf", *_SIDES)).alias("k", "tp"))
    return tp.groupBy("k").agg(F.sum("tp").alias("tp"))


_SIDES = [f"{side}.{c}" for side in ("preds", "boxes") for c in ("name", *CORNERS)]


def _sides(pred: DataFrame, gt: DataFrame, conf_t: float, order: str) -> DataFrame:
    """image_id, preds, boxes (arrays in order): a row an image that has a prediction, of any confidence. One shuffle of
    either side on image_id."""

    def name(df: DataFrame) -> Column:
        return F.to_json("class_id") if isinstance(df.schema["class_id"].dataType, T.StructType) else F.col("class_id").cast("string")

    corners = [F.col(c).cast("double").alias(c) for c in CORNERS]
    first = -F.col("conf") if order == "conf" else F.lit(0.0)
    one = F.struct(first.alias("c"), "pred_idx", "conf", "class_id", name(pred).alias("name"), *corners, *(["model"] if "model" in pred.columns else []))
    p = pred.groupBy("image_id").agg(F.array_sort(F.collect_list(F.when(F.col("conf") >= conf_t, one))).alias("preds"))
    g = gt.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("box_idx", "class_id", name(gt).alias("name"), *corners))).alias("boxes"))
    return p.join(g, "image_id", "left")


def _by_image(pred: DataFrame, gt: DataFrame, levels: list[float], conf_t: float, order: str, near: bool) -> DataFrame:
    """``_sides`` with found, a struct a level (_FOUND)."""
    return _sides(pred, gt, conf_t, order).withColumn("found", F.arrow_udf(_matcher(levels, near), _FOUND)(*_SIDES))


def greedy_match(pred: DataFrame, gt: DataFrame, iou_t: float = 0.5, conf_t: float = 0.0, order: str = "conf", near: bool = False) -> DataFrame:
    """image_id, class_id, pred_idx, box_idx, iou, tp: each prediction takes its best box that is still free.

    Predictions under ``conf_t`` do not take part. ``order`` is "conf" (falling, ties by pred_idx) or "index".
    ``near`` also gives predictions whose best free box is closer than 0 but under ``iou_t`` (tp false, the box stays
    free); without it edges under ``iou_t`` never enter. Null coordinates or confidences match nothing.
    """
    if iou_t <= 0:
        raise ValueError("iou_t must be above 0")
    found = _by_image(pred, gt, [iou_t], conf_t, order, near).withColumn("f", F.col("found")[0])
    each = found.select("image_id", "boxes", F.explode(F.arrays_zip("preds", F.col("f.box").alias("box"), F.col("f.iou").alias("iou"), F.col("f.tp").alias("tp"))).alias("m")).where("m.box >= 0")
    return each.select("image_id", "m.preds.class_id", F.col("m.preds.pred_idx").cast("bigint").alias("pred_idx"), F.get("boxes", F.col("m.box"))["box_idx"].cast("bigint").alias("box_idx"), "m.iou", "m.tp")


def match_levels(pred: DataFrame, gt: DataFrame, levels: list[float]) -> DataFrame:
    """level, image_id, class_id, pred_idx, box_idx: matches at several IoU levels from one pass over the edges."""
    found = _by_image(pred.where("conf IS NOT NULL"), gt, levels, float("-inf"), "conf", False)
    each = found.select("image_id", "preds", "boxes", F.explode(F.arrays_zip(F.array(*map(F.lit, levels)).alias("level"), F.col("found").alias("f"))).alias("x"))
    each = each.select("image_id", "boxes", "x.level", F.explode(F.arrays_zip("preds", F.col("x.f.box").alias("box"))).alias("m")).where("m.box >= 0")
    return each.select("level", "image_id", "m.preds.class_id", F.col("m.preds.pred_idx").cast("bigint").alias("pred_idx"), F.get("boxes", F.col("m.box"))["box_idx"].cast("bigint").alias("box_idx"))


def level_counts(pred: DataFrame, gt: DataFrame, levels: list[float]) -> DataFrame:
    """class_id, conf, n, tp: predictions and, an array in the order of ``levels``, matches of each class and confidence. With a
    column ``model`` in ``pred``, counts are by model too: all models of an image are matched together, each with all its boxes.
    A prediction's matches travel as one number, a bit a level; rows by level are made of counts only."""

    def hits(*columns: pa.Array) -> pa.Array:
        model, sides = (columns[0], columns[1:]) if len(columns) > 2 + 2 * len(CORNERS) else (None, columns)
        models = None
        if model is not None:
            codes = model.flatten().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            models = codes + 1
        n_p, n_g, (i, j, found) = _batch_edges(sides, min(levels), models)
        n_box = int(n_g.sum()) * (1 if models is None or not len(models) else int(models.max()) + 1)
        bits = np.zeros(int(n_p.sum()), np.int64)
        for k, level in enumerate(levels):
            keep = found >= level
            bits |= greedy(i[keep], j[keep], found[keep], len(bits), n_box, level)[2].astype(np.int64) << k
        return _lists(pa.array(bits), n_p)

    by = ["model"] if "model" in pred.columns else []
    sides = _sides(pred.where("conf IS NOT NULL"), gt, float("-inf"), "conf")
    names = [F.transform("preds", lambda p: p["model"].cast("string"))] if by else []
    found = sides.select("preds", F.arrow_udf(hits, T.ArrayType(T.LongType()))(*names, *_SIDES).alias("hits"))
    each = found.select(F.explode(F.arrays_zip("preds", "hits")).alias("m")).select(*(f"m.preds.{c}" for c in (*by, "class_id", "conf")), "m.hits")
    tp = [F.sum(F.shiftright("hits", k).bitwiseAND(F.lit(1))) for k in range(len(levels))]
    return each.groupBy(*by, "class_id", "conf").agg(F.count(F.lit(1)).alias("n"), F.array(*tp).alias("tp"))


def unmatched_boxes(gt: DataFrame, matches: DataFrame) -> DataFrame:
    return gt.join(matches.where("tp").select("image_id", "box_idx"), ["image_id", "box_idx"], "left_anti")


def outcomes(pred: DataFrame, gt: DataFrame, iou_t: float = 0.5, conf_t: float = 0.25, order: str = "conf", near: bool = True) -> DataFrame:
    """image_id, outcome, class_id, pred_idx, box_idx, conf, iou: one row a prediction (correct, loc, FP) and one a
    box that no prediction found (FN), the latter only in images with a prediction row. All of an image's rows come out of
    its one matching."""
    if iou_t <= 0:
        raise ValueError("iou_t must be above 0")
    found = _by_image(pred, gt, [iou_t], conf_t, order, near).withColumn("f", F.col("found")[0])
    none = F.lit(None).cast("bigint")

    def predicted(m: Column) -> Column:
        outcome = F.when(m["tp"], "correct").when(m["box"] >= 0, "loc").otherwise("FP")
        own = F.when(m["tp"], F.get("boxes", m["box"])["box_idx"].cast("bigint"))
        return F.struct(outcome.alias("outcome"), m["preds"]["class_id"].alias("class_id"), m["preds"]["pred_idx"].cast("bigint").alias("pred_idx"), own.alias("box_idx"), m["preds"]["conf"].cast("double").alias("conf"), m["iou"].alias("iou"))

    def missing(at: Column) -> Column:
        b = F.get("boxes", at)
        return F.struct(F.lit("FN").alias("outcome"), b["class_id"].alias("class_id"), none.alias("pred_idx"), b["box_idx"].cast("bigint").alias("box_idx"), F.lit(0.0).alias("conf"), F.lit(0.0).alias("iou"))

    pairs = F.arrays_zip("preds", F.col("f.box").alias("box"), F.col("f.iou").alias("iou"), F.col("f.tp").alias("tp"))
    return found.select("image_id", F.inline(F.concat(F.transform(pairs, predicted), F.transform("f.missed", missing))))
