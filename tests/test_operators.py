"""Fusion, anchors, splits, responses and tuning on small inputs."""

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxspark.jobs import fixtures
from boxspark.operators import anchors, convert, errors, evaluate, fuse, match, qc, responses, stats, tuning
from boxspark.operators.convert import merged_vocabulary

DETS = "image_id int, class_id int, det_idx int, score double, x1 double, y1 double, x2 double, y2 double"


def test_wbf_equals_brute_force(spark):
    rng, dets = random.Random(5), []
    for image in range(25):
        for k in range(rng.randint(0, 14)):
            x, y = rng.randint(0, 5) / 32, rng.randint(0, 5) / 32
            dets.append((image, rng.randint(0, 1), k, rng.choice([0.25, 0.5, 0.75, 1.0]), x, y, x + rng.randint(4, 8) / 32, y + rng.randint(4, 8) / 32))

    def iou(a, b):
        w, h = max(0, min(a[6], b[6]) - max(a[4], b[4])), max(0, min(a[7], b[7]) - max(a[5], b[5]))
        union = (a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - w * h
        return w * h / union if union > 0 else 0.0

    want = []
    for key in sorted({d[:2] for d in dets}):
        clusters = []
        for d in sorted((d for d in dets if d[:2] == key), key=lambda d: (-d[3], d[2])):
            own = next((c for c in clusters if max(iou(d, m) for m in c) >= 0.5), None)
            clusters.append([d]) if own is None else own.append(d)
        for c in clusters:
            total = sum(d[3] for d in c)
            want.append((*key, len(c), sum(d[3] ** 2 for d in c) / total, *(sum(d[3] * d[i] for d in c) / total for i in range(4, 8))))
    got = [(r.image_id, r.class_id, r.members, r.score, r.x1, r.y1, r.x2, r.y2) for r in fuse.wbf(spark.createDataFrame(dets, DETS)).collect()]
    rounded = lambda rows: sorted(tuple(round(x, 9) for x in r) for r in rows)
    assert rounded(got) == rounded(want) and any(w[2] > 2 for w in want)
    assert fuse.wbf(spark.createDataFrame([], DETS)).count() == 0


def test_nms_equals_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for image in range(20):
        for k in range(rng.randint(0, 9)):
            x, y = rng.randint(0, 9), rng.randint(0, 9)
            rows.append((image, k, 0, rng.choice([0.1, 0.5, 0.9]), x, y, x + rng.randint(2, 9), y + rng.randint(2, 9)))
    df = spark.createDataFrame(rows, "image_id int, pred_idx int, class_id int, conf double, x1 int, y1 int, x2 int, y2 int")

    def iou(a, b):
        w, h = max(0, min(a[6], b[6]) - max(a[4], b[4])), max(0, min(a[7], b[7]) - max(a[5], b[5]))
        return w * h / ((a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - w * h)

    want = set()
    for image in range(20):
        kept = []
        for p in sorted((r for r in rows if r[0] == image), key=lambda r: (-r[3], r[1])):
            if all(iou(p, k) <= 0.4 for k in kept):
                kept.append(p)
        want |= {(k[0], k[1]) for k in kept}
    assert {(r.image_id, r.pred_idx) for r in fuse.nms(df, 0.4).collect()} == want


def test_kmeans_and_silhouette(spark):
    rng = np.random.default_rng(42)
    blobs = [(c + rng.normal(0, 0.01), c + rng.normal(0, 0.01), 0.1, 0.1) for c in (0.2, 0.5, 0.8) for _ in range(10)]
    df = spark.createDataFrame([tuple(map(float, b)) for b in blobs], "cx double, cy double, w double, h double")
    found, avg = anchors.kmeans(df, 3, 20)
    assert len(found) == 3 and 0 <= avg <= 1
    assert anchors.silhouette(df, found[:1]) == 1.0
    assert len(anchors.kmeans(df.limit(2), 5, 5)[0]) == 2
    assert anchors.kmeans(df.limit(0), 5, 5) == ([], 0.0)
    assert {r.scale for r in anchors.scale_assignment(df.limit(1)).collect()} == {"P3", "P4", "P5"}


def test_split_sizes_are_exact(spark):
    for n in (0, 1, 7, 103):
        rows = stats.split_dataset(spark.range(n).withColumnRenamed("id", "image_id")).collect()
        sizes = {s: sum(r.split == s for r in rows) for s in ("train", "val", "test")}
        assert sizes == {"train": int(n * 0.7), "val": int(n * 0.2), "test": n - int(n * 0.7) - int(n * 0.2)}


def test_responses(spark):
    texts = [(1, '```json\n{"annotations": [{"class_id": 1, "bbox": [0.1, 0.2, 0.3, 0.4], "confidence": 0.9}]}\n```'), (2, 'see {"annotations": [{"class": "dog", "coordinates": [1, 2, 3, 4]}, {"bbox": [1]}]} ok'), (3, "none"), (4, None), (5, '```\n{"annotations": []}\n```')]
    parsed = responses.parsed(spark.createDataFrame(texts, "image_id int, content string"))
    assert {r.image_id: r.ok for r in parsed.collect()} == {1: True, 2: True, 3: False, 4: False, 5: True}
    classes = spark.createDataFrame([(7, "dog")], "class_id bigint, name string")
    got = [(r.image_id, r.ann_idx, r.class_id, r.cx, r.conf) for r in responses.annotations(parsed, classes).orderBy("image_id").collect()]
    assert got == [(1, 0, 1, 0.1, 0.9), (2, 0, 7, 1.0, 1.0)]


def test_tuning_ignores_text(spark):
    rows = spark.createDataFrame([(1, "0.1", "x", "1.0"), (2, "0.2", "2", "2.0"), (3, "0.3", None, "3.0")], "row int, a string, b string, fitness string")
    assert [(r.name, r.importance) for r in tuning.parameter_importance(rows, ["a", "b"], "fitness", "row").collect()] == [("a", 1.0)]
    s = {r.name: r for r in tuning.metric_summary(rows, ["a", "b"], "row").collect()}
    assert s["b"].n == 1 and s["b"].std == 0.0
    assert [r.row for r in tuning.top_runs(rows, "fitness", "row", 2).orderBy("rank").collect()] == [3, 2]


def test_vocabulary_keeps_old_ids(spark):
    old = spark.createDataFrame([(0, "a"), (2, "b")], "class_id bigint, name string")
    new = spark.createDataFrame([(0, "b"), (1, "c")], "class_id bigint, name string")
    assert sorted((r.class_id, r.name) for r in merged_vocabulary(old, new).collect()) == [(0, "a"), (2, "b"), (3, "b"), (4, "c")]


def test_recommendations_without_errors(spark):
    empty = spark.createDataFrame([], "error_type string, reason string")
    assert [r.code for r in errors.recommendations(empty).collect()] == ["good"]


def test_scoring_hook_loads_a_model_once_a_task(spark):
    from boxspark.operators import pixels

    def model():
        factor = 2  # what a real model would load
        return lambda frame: frame.assign(score=frame["id"] * factor)

    rows = pixels.scored(spark.range(10, numPartitions=2), model, "id bigint, score bigint").collect()
    assert sorted((r.id, r.score) for r in rows) == [(i, 2 * i) for i in range(10)]


def test_tuning_of_each_run(spark):
    rows = spark.createDataFrame([(r, k, str(k * r), " " if r == 2 and k == 1 else str(-k), str(float(k if r < 3 else -k))) for r in (1, 2, 3) for k in range(1, 5)], "run int, row int, a string, b string, fitness string")
    got = {(r.run, r.name): r.importance for r in tuning.parameter_importance(rows, ["a", "b"], "fitness", "row", by=("run",)).collect()}
    assert got == {(1, "a"): 1.0, (1, "b"): -1.0, (2, "a"): 1.0, (3, "a"): -1.0, (3, "b"): 1.0}
    best = sorted((r.run, r["rank"], r.row) for r in tuning.top_runs(rows, "fitness", "row", 2, by=("run",)).collect())
    assert best == [(1, 1, 4), (1, 2, 3), (2, 1, 4), (2, 2, 3), (3, 1, 1), (3, 2, 2)]
    ends = sorted((r.run, r.last_id, r.last_fitness, r.best_id, r.best_fitness) for r in tuning.last_and_best(rows, "fitness", "row", by=("run",)).collect())
    assert ends == [(1, 4, 4.0, 4, 4.0), (2, 4, 4.0, 4, 4.0), (3, 4, -4.0, 1, -1.0)]


def _apart(a, b):
    """IoU distances, by definition: corners and areas box by box."""
    out = np.ones((len(a), len(b)))
    for i, (ax, ay, aw, ah) in enumerate(a):
        x = np.clip(np.minimum(ax + aw / 2, b[:, 0] + b[:, 2] / 2) - np.maximum(ax - aw / 2, b[:, 0] - b[:, 2] / 2), 0, None)
        y = np.clip(np.minimum(ay + ah / 2, b[:, 1] + b[:, 3] / 2) - np.maximum(ay - ah / 2, b[:, 1] - b[:, 3] / 2), 0, None)
        union = aw * ah + b[:, 2] * b[:, 3] - x * y
        out[i] = 1 - np.where(union > 0, x * y / np.where(union > 0, union, 1), 0)
    return out


def _kmeans_by_hand(boxes, start, again, rounds=300, shift=1e-6):
    now = np.array(start)
    for turn in range(rounds):
        own, last = _apart(boxes, now).argmin(axis=1), now
        fresh = iter(again(sum(not (own == c).any() for c in range(len(now))), turn))
        now = np.array([boxes[own == c].mean(axis=0) if (own == c).any() else next(fresh) for c in range(len(now))])
        if np.sqrt(((now - last) ** 2).sum(axis=1)).max() < shift:
            break
    return now, float(np.mean([1 - _apart(boxes[i : i + 1], now[own[i] : own[i] + 1])[0, 0] for i in range(len(boxes))]))


def _silhouette_by_hand(boxes, own):
    apart, total = _apart(boxes, boxes), 0.0
    for i in range(len(boxes)):
        same = (own == own[i]) & (np.arange(len(boxes)) != i)
        if same.any():
            a, b = apart[i][same].mean(), min((apart[i][own == c].mean() for c in set(own.tolist()) - {own[i]}), default=0.0)
            total += (b - a) / (a + b) if a + b > 0 else 0.0
    return total / len(boxes)


def test_choice_of_k_against_brute_force(spark):
    """500 boxes, all k at once, in small blocks: every k's centroids, fit and silhouette, and the k that wins."""
    rng = np.random.default_rng(4)
    boxes = np.array([(*rng.uniform(0.2, 0.8, 2), *rng.choice([0.05, 0.1, 0.3, 0.5], 2) * rng.uniform(0.9, 1.1, 2)) for _ in range(480)] + [(0.4, 0.4, 0.2, 0.2)] * 20)
    df = spark.createDataFrame([tuple(map(float, b)) for b in boxes], "cx double, cy double, w double, h double").repartition(5)
    found = anchors.kmeans_of(df, [2, 3, 5, 7])
    scores = anchors.silhouettes(df, {k: c for k, (c, _) in found.items()}, block=60)
    want = {}
    for k in found:
        centroids, fit = _kmeans_by_hand(boxes, anchors.first_centroids(df, k), lambda n, turn, k=k: anchors.first_centroids(df, n, f"42|{k}|{turn}") if n else [])
        assert np.abs(centroids - np.array(found[k][0])).max() < 1e-9 and found[k][1] == pytest.approx(fit, abs=1e-9)
        want[k] = _silhouette_by_hand(boxes, _apart(boxes, centroids).argmin(axis=1))
        assert scores[k] == pytest.approx(want[k], abs=1e-9)
    k, centroids, score = anchors.choose_k(df, 2, 4)
    best = max((2, 3), key=lambda k: 0.7 * want[k] + 0.3 * found[k][1])
    assert k in (2, 3, 4) and (k == 4 or k == best) and len(centroids) == k and score >= 0.7 * want[best] + 0.3 * found[best][1] - 1e-9


def test_an_empty_cluster_starts_again(spark, monkeypatch):
    """A centroid that no box is nearest to is drawn anew from the boxes, by the hash of its round."""
    boxes = np.array([(0.1 * i, 0.5, 0.08, 0.1) for i in range(1, 9)])
    df = spark.createDataFrame([tuple(map(float, b)) for b in boxes], "cx double, cy double, w double, h double")
    first, far = anchors.first_centroids, (5.0, 5.0, 0.01, 0.01)
    monkeypatch.setattr(anchors, "first_centroids", lambda labels, k, seed=42: [tuple(boxes[0]), far, tuple(boxes[7])][:k] if seed == 42 else first(labels, k, seed))
    found, fit = anchors.kmeans(df, 3)
    want, score = _kmeans_by_hand(boxes, [boxes[0], np.array(far), boxes[7]], lambda n, turn: first(df, n, f"42|3|{turn}") if n else [])
    assert np.abs(np.array(found) - want).max() < 1e-9 and fit == pytest.approx(score) and max(c[0] for c in found) < 1


def test_silhouette_scores_all_boxes(spark):
    """Against the definition, box by box; a box that half of the rows hold counts as often as it occurs."""
    rng = np.random.default_rng(9)
    boxes = [tuple(float(x) for x in rng.uniform(0.1, 0.6, 4)) for _ in range(700)] + [(0.3, 0.3, 0.2, 0.2)] * 700 + [(0.5, 0.5, 0.0, 0.0)] * 3
    df, centroids = spark.createDataFrame(boxes, "cx double, cy double, w double, h double"), [boxes[0], boxes[1], boxes[2], (0.9, 0.9, 0.01, 0.01)]
    own = np.array([r.anchor for r in anchors.nearest_anchor(df, centroids).select("anchor", *("cx", "cy", "w", "h")).collect()])
    order = [(r.cx, r.cy, r.w, r.h) for r in df.collect()]
    assert order == boxes
    apart = _apart(np.array(boxes), np.array(boxes))
    total = 0.0
    for i in range(len(boxes)):
        same = (own == own[i]) & (np.arange(len(boxes)) != i)
        if same.any():
            a, b = apart[i][same].mean(), min((apart[i][own == c].mean() for c in set(own) - {own[i]}), default=0.0)
            total += (b - a) / (a + b) if a + b > 0 else 0.0
    for block in (100, 2_048):
        assert anchors.silhouette(df, centroids, block=block) == pytest.approx(total / len(boxes), abs=1e-9)
    assert anchors.silhouette(df.limit(0), centroids) == 0.0 and anchors.silhouette(df.limit(1), centroids[:1]) == 1.0


def test_validation_of_each_scale(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([tuple(float(x) for x in rng.uniform(0.1, 0.6, 4)) for _ in range(200)], "cx double, cy double, w double, h double")
    own = {"P3": [(0.3, 0.3, 0.1, 0.1)], "P4": [(0.5, 0.5, 0.2, 0.3), (0.5, 0.4, 0.4, 0.2)], "P5": []}
    got = {r.scale: (r.mean_best_iou, r.n) for r in anchors.scale_validation(df, own).collect()}
    b = np.array([tuple(r) for r in df.collect()])
    area = b[:, 2] * b[:, 3]
    cuts = np.quantile(area, anchors.CUTS)
    assert set(got) == {"all", "P3", "P4"}
    for name, keep, a in (("all", area >= 0, own["P3"] + own["P4"]), ("P3", area <= cuts[1], own["P3"]), ("P4", (area >= cuts[1]) & (area <= cuts[2]), own["P4"])):
        assert got[name] == (pytest.approx((1 - _apart(b[keep], np.array(a))).max(axis=1).mean()), keep.sum())


def test_occlusion_is_asked_of_plain_boxes_only(spark):
    gt = spark.createDataFrame([(1, k) for k in range(5)], "image_id int, box_idx int")
    pairs = spark.createDataFrame([(1, 0, 2, 0.9)], "image_id int, i int, j int, iou double")
    tiny = spark.createDataFrame([(1, 4, 3.0)], "image_id int, box_idx int, area double")
    assert sorted(r.box_idx for r in qc.occlusion_candidates(gt, pairs, tiny).collect()) == [1, 3]


def test_models_are_compared_on_their_own_predictions(spark):
    box = "x1 int, y1 int, x2 int, y2 int"
    gt = spark.createDataFrame([(i, 0, i % 2, 0, 0, 10, 10) for i in range(4)], f"image_id int, box_idx int, class_id int, {box}")
    made = [("good", i, 0, i % 2, 0.9, 0, 0, 10, 10) for i in range(4)] + [("half", i, 0, 0, 0.8, 0, 0, 10, 10) for i in range(4)]
    pred = spark.createDataFrame(made, f"model string, image_id int, pred_idx int, class_id int, conf double, {box}")
    got = {r.model: (round(r.map50, 6), round(r.mean_precision, 6), round(r.mean_recall, 6), round(r.fitness, 6)) for r in evaluate.compare_models(pred, gt).collect()}
    alone = evaluate.mean_average_precision(evaluate.average_precision(pred.where("model = 'half'").drop("model"), gt)).first()
    assert got["good"] == (1.0, 1.0, 1.0, 1.0) and got["half"] == (round(alone.map50, 6), 0.25, 0.5, round(alone.fitness, 6))


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 0.97, 1.0])
def test_duplicate_pairs_of_a_crowded_image(spark, threshold):
    """Every pair of a crowded image once, whatever its band and cell, and no pair in one task of the join alone."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(500):
        w, h = float(rng.choice([0.5, 3, 17, 60, 200]) * rng.uniform(0.8, 1.2)), float(rng.choice([2, 40]) * rng.uniform(0.8, 1.2))
        x, y = (float(v) for v in rng.uniform(-50, 400, 2) // rng.choice([1, 40]))
        rows.append((int(rng.integers(0, 2)), k, x, y, x + w, y + h))
    rows += [(0, 1000 + k, *r[2:]) for k, r in enumerate(rows[:60])] + [(1, 2000, 5.0, 5.0, 5.0, 9.0), (1, 2001, 5.0, 5.0, 5.0, 9.0), (1, 2002, None, 5.0, 6.0, 9.0)]
    df = spark.createDataFrame(rows, "image_id int, box_idx int, x1 double, y1 double, x2 double, y2 double")
    want = set()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1] and None not in a + b:
                inter = max(min(a[4], b[4]) - max(a[2], b[2]), 0) * max(min(a[5], b[5]) - max(a[3], b[3]), 0)
                union = (a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - inter
                if union > 0 and inter / union >= threshold:
                    want.add((a[0], a[1], b[1]))
    got = [(r.image_id, r.i, r.j) for r in qc.duplicate_pairs(df, threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_box_variances_against_crops():
    from boxspark.operators import pixels

    rng = np.random.default_rng(7)
    a = rng.integers(0, 256, (37, 53)).astype(np.uint8)
    a[5:20, 10:30] = 77
    boxes = np.concatenate([rng.uniform(-20, 70, (300, 4)), [(10, 5, 30, 20), (0, 0, 53, 37), (-9, -9, -1, -1), (60, 0, 70, 5), (3, 3, 3, 9), (1e12, 0, 2e12, 5), (np.nan, 0, 5, 5)]])
    got = pixels.box_variances(a, boxes)
    for (x1, y1, x2, y2), v in zip(boxes[:-1], got):
        part = a[max(0, int(y1)) : max(0, min(37, int(y2))), max(0, int(x1)) : max(0, min(53, int(x2)))]
        assert v == pytest.approx(part.astype(float).var(), abs=1e-9) if part.size else np.isnan(v)
    assert got[300] == 0.0


def test_a_variance_at_the_limit_falls_where_sql_puts_it(spark):
    """Exactly 500, and a hair less when it is added up in doubles: SQL keeps the box."""
    from boxspark.operators import pixels

    values = np.array([[141, 161], [121, 101]])
    assert pixels.box_variances(values, [(0, 0, 2, 2)])[0] == 500.0 > pixels.running_variance(values)
    rows = [(1, 2, 2, bytes(values.astype(np.uint8).ravel().tolist()), [(0, 0.0, 0.0, 2.0, 2.0), (1, 0.0, 0.0, 1.0, 2.0), (2, 0.0, -5.0, 1.0, 1.0)])]
    df = spark.createDataFrame(rows, "image_id bigint, width int, height int, pixels binary, boxes array<struct<box_idx: bigint, x1: double, y1: double, x2: double, y2: double>>")
    got = {r.box_idx: r.variance for r in pixels.occluded(df, 500.0).collect()}
    assert got == {0: pytest.approx(500.0), 1: 100.0, 2: 0.0}
    assert 1 not in {r.box_idx for r in pixels.occluded(df, 100.0).collect()}


def test_a_box_taken_later_was_free_for_an_earlier_near_miss():
    """Prediction 0 is near boxes 0 and 1; a later one takes box 1, an earlier wish takes box 0 first."""
    pred, of, ious = np.array([0, 1, 1, 2]), np.array([0, 0, 1, 1]), np.array([0.9, 0.8, 0.2, 0.9])
    box_of, iou_of, tp = match.greedy(pred, of, ious, 3, 2, 0.5)
    assert box_of.tolist() == [0, 1, 1] and tp.tolist() == [True, False, True] and iou_of.tolist() == [0.9, 0.2, 0.9]


def test_percentiles_are_exact(spark):
    """Against a sort: ties, huge and tiny values next to each other, neighbouring doubles, one value, none."""
    rng = np.random.default_rng(11)
    columns = [
        rng.normal(0, 1, 1000).tolist(), [5.0] * 700 + [1.7e308, -1.7e308, 5e-324, 1e-323, 0.0], [1.0, float(np.nextafter(1, 2)), float(np.nextafter(1, 0))] * 50, [3.5], [1.0, 2.0],
        rng.integers(0, 4, 500).astype(float).tolist() + [None, float("nan")],
    ]
    points = [0.0, 0.25, 0.4, 0.5, 0.8, 0.999, 1.0]
    for values in columns:
        df = spark.createDataFrame([(v,) for v in values], "x double")
        plain = [v for v in values if v is not None and v == v]
        assert stats.percentiles(df, "x", points).first()["cuts"] == pytest.approx(np.quantile(plain, points).tolist(), rel=1e-12)
    assert stats.percentiles(spark.createDataFrame([], "x double"), "x", points).first()["cuts"] is None


def test_list_order_curve_against_a_loop(spark):
    rng = np.random.default_rng(13)
    gt = [(i, k, int(rng.integers(0, 2)), *map(float, b)) for i in range(12) for k, b in enumerate(rng.integers(0, 12, (6, 2)))]
    pred = [(i, k, int(rng.integers(0, 2)), round(float(rng.random()), 2), *map(float, b)) for i in range(12) for k, b in enumerate(rng.integers(0, 12, (8, 2)))]
    g = spark.createDataFrame([(i, k, c, x, y, x + 10, y + 10) for i, k, c, x, y in gt], "image_id int, box_idx int, class_id int, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([(i, k, c, s, x, y, x + 10, y + 10) for i, k, c, s, x, y in pred], "image_id int, pred_idx int, class_id int, conf double, x1 double, y1 double, x2 double, y2 double")
    thresholds = [0.0, 0.3, 0.6, 0.95, 1.0]
    got = {r.k: (r.tp, r.fp, r.fn) for r in evaluate.list_order_curve(p, g, thresholds, 0.4).collect()}
    for k, t in enumerate(thresholds):
        tp, made = 0, [q for q in pred if q[3] >= t]
        taken = set()
        for i, _, c, _, x, y in made:
            best, own = 0.0, None
            for b in gt:
                if b[0] == i and b[2] == c and b[:2] not in taken:
                    inter = max(0, 10 - abs(x - b[3])) * max(0, 10 - abs(y - b[4]))
                    if inter / (200 - inter) > best:
                        best, own = inter / (200 - inter), b[:2]
            if best >= 0.4:
                tp += 1
                taken.add(own)
        assert got[k] == (tp, len(made) - tp, len(gt) - tp)


def test_running_values_are_carried_over_steps(spark):
    rng = np.random.default_rng(17)
    rows = [(int(k), float(c), int(n), float(b)) for k, c, n, b in zip(rng.integers(0, 3, 200), rng.permutation(200) / 150 - 0.2, rng.integers(0, 9, 200), rng.random(200))]
    df = spark.createDataFrame(rows, "k int, conf double, n bigint, best double")
    for bins in (1, 7, 4096):
        down = {(r.k, r.conf): r.n for r in evaluate.carried(df, ["k"], "conf", True, {"n": F.sum}, bins).collect()}
        up = {(r.k, r.conf): r.best for r in evaluate.carried(df, ["k"], "conf", False, {"best": F.max}, bins).collect()}
        assert down == {(k, c): sum(m for o, d, m, _ in rows if o == k and d >= c) for k, c, _, _ in rows}
        assert up == {(k, c): max(x for o, d, _, x in rows if o == k and d <= c) for k, c, _, _ in rows}


def test_fusion_does_not_depend_on_how_groups_are_taken_together(monkeypatch):
    rng = np.random.default_rng(19)
    sizes = np.array([0, 3, 40, 1, 0, 7, 7, 90, 2])
    low = rng.integers(0, 12, (sizes.sum(), 2)).astype(float)
    boxes, scores = np.concatenate([low, low + rng.integers(1, 8, low.shape)], axis=1), rng.random(len(low))
    scores[:3] = 0.0
    whole = fuse.fuse_groups(boxes, scores, sizes, 0.4)
    monkeypatch.setattr(fuse, "CELLS", 5)
    apart = fuse.fuse_groups(boxes, scores, sizes, 0.4)
    assert all(np.array_equal(a, b) for a, b in zip(whole, apart)) and whole[4].sum() == sizes.sum() and (np.diff(whole[0]) >= 0).all()


def test_percentiles_make_their_values_once(spark):
    """However many rounds they take: what a round reads is staged."""
    seen = spark.sparkContext.accumulator(0)

    def made(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    df = spark.range(5_000).selectExpr("id * id * 1.0D AS x").mapInPandas(made, "x double")
    cuts = stats.percentiles(df, "x", [0.0, 0.4, 1.0]).first()["cuts"]
    assert cuts == pytest.approx(np.quantile(np.arange(5_000.0) ** 2, [0.0, 0.4, 1.0]).tolist()) and seen.value == 5_000


def test_lloyd_rounds_shuffle_nothing(spark):
    """Thirty rounds shuffle as little as two: a round is one stage, whose sums are a row a task and cluster."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([tuple(map(float, rng.uniform(0.2, 0.6, 4))) for _ in range(2_000)], "cx double, cy double, w double, h double")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    marks = [written()]
    for rounds in (2, 30):
        anchors.kmeans_of(df, [3, 5], rounds, shift=0.0)
        marks.append(written())
    assert marks[2] - marks[1] <= 1.2 * (marks[1] - marks[0])


def test_silhouettes_do_not_copy_boxes_for_their_pairs(spark):
    """Fifty tiles shuffle about as much as one: the right side is read again, not dealt a copy a pair."""
    rng = np.random.default_rng(3)
    boxes = [tuple(map(float, rng.uniform(0.1, 0.6, 4))) for _ in range(1_000)]
    df = spark.createDataFrame(boxes, "cx double, cy double, w double, h double")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    marks, found = [written()], []
    for block in (1_000, 20):
        found.append(anchors.silhouette(df, boxes[:4], block=block))
        marks.append(written())
    assert found[0] == pytest.approx(found[1], abs=1e-9) and 0 < marks[2] - marks[1] < 4 * (marks[1] - marks[0])


def test_silhouettes_of_pairs_of_tiles_taken_once(spark, monkeypatch):
    """A pair of tiles that gives the sums of both, or one side after the other; clusters of several k together or not."""
    rng = np.random.default_rng(21)
    boxes = [tuple(map(float, (*rng.uniform(0.2, 0.8, 2), *rng.uniform(0.05, 0.4, 2)))) for _ in range(390)] + [(0.4, 0.4, 0.2, 0.2)] * 10
    df = spark.createDataFrame(boxes, "cx double, cy double, w double, h double")
    found = {2: boxes[:2], 3: boxes[2:5], 6: boxes[5:11]}
    want = {k: _silhouette_by_hand(np.array(boxes), _apart(np.array(boxes), np.array(c)).argmin(axis=1)) for k, c in found.items()}
    for both in (0, 100):
        monkeypatch.setattr(anchors, "BOTH", both)
        for parts, block in ((10, 37), (3, 37), (10, 1_000)):
            monkeypatch.setattr(anchors, "PARTS", parts)
            assert anchors.silhouettes(df, found, block) == pytest.approx(want, abs=1e-9)
        assert anchors.silhouette(df, found[6], 50) == pytest.approx(want[6], abs=1e-9)


def test_runs_of_near_boxes_are_passed_over():
    """Boxes in the order of ``_places``: of all pairs of runs not many more meet than of all pairs of boxes."""
    rng = np.random.default_rng(13)
    boxes = np.concatenate([rng.uniform(0.1, 0.9, (2, 40_000)), rng.uniform(0.01, 0.4, (2, 40_000))])
    low, high = boxes[:2] - boxes[2:] / 2, boxes[:2] + boxes[2:] / 2
    one, other = rng.integers(0, boxes.shape[1], (2, 200_000))
    share = ((low[:, one] < high[:, other]) & (low[:, other] < high[:, one])).all(axis=0).mean()
    order, starts = np.argsort(anchors._places(boxes), kind="stable"), np.arange(0, boxes.shape[1], 200)
    least, most = np.minimum.reduceat(low[:, order], starts, axis=1), np.maximum.reduceat(high[:, order], starts, axis=1)
    assert ((least[:, :, None] < most[:, None]) & (least[:, None] < most[:, :, None])).all(axis=0).mean() < 3 * share


def test_overlaps_of_runs_are_those_of_their_boxes():
    """Bit by bit, with runs inside, beside and across each other, boxes without an area, turned and missing ones."""
    rng = np.random.default_rng(14)
    parts = [np.column_stack([rng.uniform(a, a + s, (90, 2)), rng.uniform(w, 1.2 * w, (90, 2))]) for a, s, w in [(0.1, 0.05, 0.1), (0.1, 0.05, 0.5), (0.3, 0.5, 0.2), (0.5, 0.01, 0.01), (0.0, 1.0, 0.9)]]
    odd = [np.array([(0.5, 0.5, 0.0, 0.0), (0.5, 0.5, 0.1, 0.0), (0.5, 0.5, -0.2, 0.1), (0.5, 0.5, 0.3, 0.3)]), np.array([(np.nan, 0.5, 0.1, 0.1), (0.2, 0.2, 0.4, 0.4), (0.8, 0.8, 0.1, 0.1)])]
    boxes = [*parts, *odd]
    held = np.empty((3, 100 * 100))
    for a, b in itertools.product(boxes, repeat=2):
        one, other = anchors._Leaves(anchors._corners(a), 100), anchors._Leaves(anchors._corners(b), 100)
        want = anchors._meet(anchors._corners(a), anchors._corners(b))
        assert np.array_equal(anchors._meet_runs(one, 0, other, 0, held), want, equal_nan=True)
        if not np.isnan(want).any():
            assert len(one.meeting(other)[0]) or not want.any()


def plan_of(df):
    """The plan as text, before adaptive execution adds to it."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_fixture_rows_are_sorted_and_shuffled_once(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    for made in (fixtures.ground_truth, fixtures.predictions):
        plan = plan_of(made(spark, "/root/testdata/sf0.001"))
        assert plan.count("Sort [") == 1 and plan.count("Exchange ") == 1 and "l_shipdate" not in plan


def test_image_differences_group_once_and_keep_null_ids(spark):
    images = spark.createDataFrame([(1,), (2,), (2,), (None,)], "image_id bigint")
    labels = spark.createDataFrame([(2,), (3,), (3,), (None,)], "image_id bigint")
    found = convert.image_differences(labels, images)
    rows = sorted((r.image_id or 0, r.issue) for r in found.collect())
    assert rows == [(0, "label_file_missing"), (0, "no_image_found"), (1, "label_file_missing"), (3, "no_image_found")]
    assert "Join" not in plan_of(found)


def test_views_find_their_images_without_a_sort(spark):
    views = spark.createDataFrame([(1, 0, 7, 0.5, 2.0, True, 10.0, 20.0, 30.0, 40.0), (1, 0, 8, 0.5, 2.0, False, 10.0, 20.0, 30.0, 40.0)], "image_id bigint, class_id bigint, det_idx bigint, score double, scale double, flipped boolean, x1 double, y1 double, x2 double, y2 double")
    images = spark.createDataFrame([(1, 100)], "image_id bigint, width bigint")
    found = fuse.back_projected(views, images)
    assert {r.det_idx: (r.x1, r.y1, r.x2, r.y2) for r in found.collect()} == {7: (85.0, 10.0, 95.0, 20.0), 8: (5.0, 10.0, 15.0, 20.0)}
    assert "Sort [" not in plan_of(found)


@pytest.mark.parametrize("crowd", [1, 5, 64])
def test_duplicate_pairs_are_those_of_brute_force_for_little_and_crowded_images(spark, monkeypatch, crowd):
    monkeypatch.setattr(qc, "CROWD", crowd)
    boxes = [(image, k, 10 * (k % 3), 5, 10 * (k % 3) + 50 + k % 2, 60) for image, n in ((1, 4), (2, 5), (3, 9), (4, 1)) for k in range(n)]
    gt = spark.createDataFrame(boxes, "image_id bigint, box_idx bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint")

    def overlap(a, b):
        inter = max(min(a[4], b[4]) - max(a[2], b[2]), 0) * max(min(a[5], b[5]) - max(a[3], b[3]), 0)
        return inter / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - inter)

    want = sorted((a[0], a[1], b[1]) for a in boxes for b in boxes if a[0] == b[0] and a[1] < b[1] and overlap(a, b) >= 0.8)
    found = qc.duplicate_pairs(gt)
    assert sorted((r.image_id, r.i, r.j) for r in found.collect()) == want and want


def test_strategies_are_the_join_of_both_and_group_once(spark):
    cases = spark.createDataFrame([(1, 0.2), (1, 0.8), (2, 0.95), (None, 0.6)], "image_id bigint, score double")
    found = errors.strategies(cases)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, errors.oversampled(cases).join(errors.ranked(cases), "image_id").collect()))
    assert "Join" not in plan_of(found)


def test_variant_plan_of_images_with_several_feature_rows(spark):
    cases = spark.createDataFrame([(1, "FP", 0.95), (1, "FP", 0.1), (2, "FN", 0.6), (3, "small", 0.8)], "image_id bigint, error_type string, score double")
    features = spark.createDataFrame([(1, 50.0), (1, 150.0), (2, None)], "image_id bigint, lap_var double")
    found = errors.variant_plan(cases, features)
    rows = [tuple(r) for r in found.collect()]
    want = {(1, "FP"): ["blur", "bright_13", "bright_7", "noise"], (2, "FN"): ["scale_12", "scale_8"], (3, "small"): ["noise", "scaleup_12", "scaleup_15"]}
    assert sorted(rows) == sorted((*k, v) for k, own in want.items() for v in own)
    assert not any("variant#" in line for line in plan_of(found).splitlines() if "keys=[" in line)  # nothing is grouped by variant


def test_level_counts_take_all_models_of_an_image_at_once(spark):
    pred = spark.createDataFrame([("a", 1, 0, 0, 0.9, 0, 0, 10, 10), ("b", 1, 1, 0, 0.8, 0, 0, 10, 10), (None, 1, 2, 0, 0.7, 0, 0, 10, 6), ("a", 1, 3, 0, 0.6, 0, 0, 10, 10), ("a", 2, 4, None, 0.9, 0, 0, 10, 10)], "model string, image_id bigint, pred_idx bigint, class_id bigint, conf double, x1 bigint, y1 bigint, x2 bigint, y2 bigint")
    gt = spark.createDataFrame([(1, 0, 0, 0, 0, 10, 10), (2, 0, None, 0, 0, 10, 10)], "image_id bigint, box_idx bigint, class_id bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint")
    found = {(r.model, r.class_id, r.conf): (r.n, r.tp) for r in match.level_counts(pred, gt, [0.5, 0.75]).collect()}
    assert found == {("a", 0, 0.9): (1, [1, 1]), ("b", 0, 0.8): (1, [1, 1]), (None, 0, 0.7): (1, [1, 0]), ("a", 0, 0.6): (1, [0, 0]), ("a", None, 0.9): (1, [0, 0])}


def test_fusion_of_images_cut_by_batches(spark):
    """Images that come in several batches, null ones too, are fused as they are in one; nothing is aggregated on the way."""
    rows = [(i % 7 if i % 7 else None, i % 3, i, (i * 37 % 11) / 10.0, float(i % 5), 0.0, 10.0 + i % 5, 10.0 + i % 4) for i in range(120)]
    dets = spark.createDataFrame(rows, "image_id bigint, class_id bigint, det_idx bigint, score double, x1 double, y1 double, x2 double, y2 double")
    whole = sorted(map(repr, fuse.wbf(dets).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = fuse.wbf(dets)
        assert sorted(map(repr, got.collect())) == whole and sum(r.members for r in got.collect()) == 120
        assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
