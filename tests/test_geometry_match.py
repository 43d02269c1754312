"""Geometry and matching against tiny cases and a brute-force matcher."""

import random

import pytest
from pyspark.sql import functions as F

from boxspark.functions import geometry as g
from boxspark.operators import match


def _iou(a, b):
    w = max(0, min(a[2], b[2]) - max(a[0], b[0]))
    h = max(0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def test_iou_of_pixel_boxes(spark):
    rows = [((2, 1, 9, 7), (11, 1, 14, 7), 0.0), ((2, 1, 9, 7), (2, 1, 9, 7), 1.0), ((0, 0, 8, 4), (6, 1, 12, 5), 6 / 50), ((0, 0, 8, 4), (8, 0, 9, 4), 0.0), ((4, 2, 4, 2), (4, 2, 4, 2), 0.0)]
    df = spark.createDataFrame([(*a, *b, v) for a, b, v in rows], "a_x1 int, a_y1 int, a_x2 int, a_y2 int, b_x1 int, b_y1 int, b_x2 int, b_y2 int, v double")
    for r in df.select(g.iou(g.box("a_"), g.box("b_")).alias("iou"), "v", g.iou_distance(g.box("a_"), g.box("b_")).alias("d")).collect():
        assert r.iou == pytest.approx(r.v) and r.d == pytest.approx(1 - r.v)


def test_hardness_and_steps(spark):
    cases = [("FP", 0.75, 0.4, 0.25), ("FP", 0.125, 0.0, 0.875), ("FN", 0.6, 0.4375, 0.5625), ("FN", 0.0, 0.0, 1.0), ("FN", 0.2, 1.0, 0.0), ("small", 0.9, 0.9, 0.8), ("odd", 0.9, 0.9, 0.5)]
    df = spark.createDataFrame(cases, "t string, c double, i double, v double")
    for r in df.select(g.hardness(F.col("t"), F.col("c"), F.col("i")).alias("s"), "v").collect():
        assert r.s == pytest.approx(r.v)
    steps = spark.createDataFrame([(0.0, 1, 0), (0.49, 1, 0), (0.5, 1, 2), (0.51, 2, 2), (0.69, 2, 2), (0.7, 3, 3), (0.89, 3, 3), (0.9, 5, 4), (0.99, 5, 4)], "s double, o int, v int")
    for r in steps.select(g.oversample_ratio(F.col("s")).alias("a"), g.variant_count(F.col("s")).alias("b"), "o", "v").collect():
        assert (r.a, r.b) == (r.o, r.v)


def _brute(pred, gt, t, order, near):
    out, used = {}, set()
    for p in sorted(pred, key=(lambda p: (-p[3], p[1])) if order == "conf" else (lambda p: p[1])):
        best, at = 0.0, None
        for b in gt:
            if b[2] == p[2] and b[1] not in used:
                v = _iou(p[4:], b[3:])
                if v > best:
                    best, at = v, b[1]
        if best >= t:
            used.add(at)
            out[p[1]] = (at, True)
        elif near and best > 0:
            out[p[1]] = (None, False)
    return out


@pytest.mark.parametrize("order", ["conf", "index"])
@pytest.mark.parametrize("near", [False, True])
def test_greedy_match_equals_brute_force(spark, order, near):
    rng = random.Random(7)
    pred, gt = [], []
    for image in range(60):
        for k in range(rng.randint(0, 6)):
            x, y = rng.randint(0, 12), rng.randint(0, 12)
            gt.append((image, k, rng.randint(0, 1), x, y, x + rng.randint(2, 8), y + rng.randint(2, 8)))
        for k in range(rng.randint(0, 7)):
            x, y = rng.randint(0, 12), rng.randint(0, 12)
            pred.append((image, k, rng.randint(0, 1), rng.choice([0.2, 0.5, 0.5, 0.9]), x, y, x + rng.randint(2, 8), y + rng.randint(2, 8)))
    box = "x1 int, y1 int, x2 int, y2 int"
    p = spark.createDataFrame(pred, f"image_id int, pred_idx int, class_id int, conf double, {box}")
    b = spark.createDataFrame(gt, f"image_id int, box_idx int, class_id int, {box}")
    got = {(r.image_id, r.pred_idx): (r.box_idx if r.tp else None, r.tp) for r in match.greedy_match(p, b, 0.4, 0.0, order, near).collect()}
    want = {}
    for image in range(60):
        for k, v in _brute([x for x in pred if x[0] == image], [x for x in gt if x[0] == image], 0.4, order, near).items():
            want[image, k] = v
    assert got == want


def test_outcomes_add_up_and_empty(spark):
    box = "x1 int, y1 int, x2 int, y2 int"
    p = spark.createDataFrame([("u", 0, 2, 0.6, 4, 4, 24, 14), ("u", 1, 1, 0.7, 4, 4, 24, 14), ("v", 0, 2, 0.3, 40, 8, 44, 18), ("v", 1, 2, 0.1, 0, 0, 9, 9)], f"image_id string, pred_idx int, class_id int, conf double, {box}")
    b = spark.createDataFrame([("u", 0, 2, 5, 4, 25, 14), ("v", 0, 3, 0, 0, 9, 9), ("w", 0, 2, 0, 0, 5, 5)], f"image_id string, box_idx int, class_id int, {box}")
    got = sorted((r.image_id, r.outcome, r.class_id) for r in match.outcomes(p, b, near=False).collect())
    assert got == [("u", "FP", 1), ("u", "correct", 2), ("v", "FN", 3), ("v", "FP", 2)]
    assert match.outcomes(p.limit(0), b.limit(0)).count() == 0
    with pytest.raises(ValueError):
        match.greedy_match(p, b, 0.0)
