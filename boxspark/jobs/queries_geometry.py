"""Queries of geometry, joins and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxspark.functions import geometry as g
from boxspark.jobs import fixtures as fx
from boxspark.jobs.fixtures import sql_iou, sql_match, with_sql
from boxspark.jobs.registry import query
from boxspark.operators import convert, fuse, match, pixels, qc

CORNERS = ("x1", "y1", "x2", "y2")


def _corners(b: g.Box) -> list:
    return [getattr(b, c).alias(c) for c in CORNERS]


@query(with_sql("SELECT image_id, box_idx, cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2 FROM lab"))
def g1_cxcywh_to_xyxy(spark, d):
    return fx.labels(spark, d).select("image_id", "box_idx", *_corners(g.from_cxcywh(*map(F.col, ("cx", "cy", "w", "h")))))


@query(with_sql("SELECT image_id, box_idx, (cx - w / 2) * width AS x1, (cy - h / 2) * height AS y1, (cx + w / 2) * width AS x2, (cy + h / 2) * height AS y2 FROM lab JOIN images USING (image_id)"))
def g2_to_pixels(spark, d):
    rows = fx.labels(spark, d).join(fx.images(spark, d), "image_id")
    return rows.select("image_id", "box_idx", *_corners(g.scaled(g.from_cxcywh(*map(F.col, ("cx", "cy", "w", "h"))), F.col("width"), F.col("height"))))


@query(with_sql("SELECT image_id, pred_idx, (x1 + x2) / 2.0::DOUBLE / width AS cx, (y1 + y2) / 2.0::DOUBLE / height AS cy, (x2 - x1) / width AS w, (y2 - y1) / height AS h FROM pred JOIN images USING (image_id)"))
def g3_xyxy_to_cxcywh(spark, d):
    rows = fx.predictions(spark, d).join(fx.images(spark, d), "image_id")
    return rows.select("image_id", "pred_idx", *(c.alias(n) for c, n in zip(g.to_cxcywh(g.box(), F.col("width"), F.col("height"), int_pixels=True), ("cx", "cy", "w", "h"))))


@query(with_sql("SELECT image_id, box_idx, class_id, (x1 + x2) / 2.0::DOUBLE / width AS cx, (y1 + y2) / 2.0::DOUBLE / height AS cy, (x2 - x1) / width AS w, (y2 - y1) / height AS h FROM gt JOIN images USING (image_id)"))
def g4_voc_to_normalised(spark, d):
    return fx.labels(spark, d)


def _coco(spark, d):
    return fx.ground_truth(spark, d).select("image_id", F.col("box_idx").alias("ann_id"), (F.col("class_id") + 1).alias("category_id"), F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).cast("array<double>").alias("bbox"))


_COCO = "SELECT g.image_id, box_idx AS ann_id, class_id, (x1 + (x2 - x1) / 2.0::DOUBLE) / width AS cx, (y1 + (y2 - y1) / 2.0::DOUBLE) / height AS cy, (x2 - x1) / width AS w, (y2 - y1) / height AS h FROM gt g JOIN images i ON g.image_id = i.image_id"


@query(with_sql(_COCO))
def g5_coco_to_normalised(spark, d):
    return convert.coco_labels(_coco(spark, d), fx.images(spark, d))


def _pairs(spark, d):
    a = fx.ground_truth(spark, d).select("image_id", F.col("box_idx").alias("i"), *(F.col(c).alias(f"a_{c}") for c in CORNERS))
    b = fx.ground_truth(spark, d).select("image_id", F.col("box_idx").alias("j"), *(F.col(c).alias(f"b_{c}") for c in CORNERS))
    return a.join(b, "image_id").where("i < j")


#: Pairs of an image's boxes out of its list, each later one with each earlier: no join that asks for an order.
_PB = """lists AS (SELECT image_id, list({'box_idx': box_idx, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2} ORDER BY box_idx) AS bs FROM gt GROUP BY image_id),
ahead AS (SELECT image_id, bs, unnest(range(1, len(bs))) AS k FROM lists),
pb AS (SELECT image_id, bs[k] AS a, unnest(bs[k + 1 :]) AS b FROM ahead)"""


@query(with_sql(f"SELECT image_id, a.box_idx AS i, b.box_idx AS j, {sql_iou('a', 'b')} AS iou FROM pb", _PB))
def g6_iou(spark, d):
    return _pairs(spark, d).select("image_id", "i", "j", g.iou(g.box("a_"), g.box("b_")).alias("iou"))


@query(with_sql(f"SELECT image_id, a.box_idx AS i, b.box_idx AS j, 1.0::DOUBLE - {sql_iou('a', 'b')} AS distance FROM pb", _PB))
def g7_iou_distance(spark, d):
    return _pairs(spark, d).select("image_id", "i", "j", g.iou_distance(g.box("a_"), g.box("b_")).alias("distance"))


_INTER = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"


@query(with_sql(f"SELECT image_id, a.box_idx AS i, b.box_idx AS j, CASE WHEN {_INTER} > 0 THEN ({_INTER}) / least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) ELSE 0.0 END AS overlap FROM pb", _PB))
def g8_overlap_of_smaller(spark, d):
    return _pairs(spark, d).select("image_id", "i", "j", g.overlap_of_smaller(g.box("a_"), g.box("b_")).alias("overlap"))


@query(with_sql("SELECT image_id, box_idx, ((x2 - x1) * (y2 - y1)) / (width * height) AS ratio, CASE WHEN ((x2 - x1) * (y2 - y1)) / (width * height) < 0.01 THEN 'small' ELSE 'normal' END AS size_class FROM gt JOIN images USING (image_id)"))
def g9_size_class(spark, d):
    rows = qc.with_size(fx.ground_truth(spark, d), fx.images(spark, d)).withColumn("ratio", g.area_ratio(g.box(), F.col("width"), F.col("height")))
    return rows.select("image_id", "box_idx", "ratio", g.size_class(F.col("ratio")).alias("size_class"))


@query(with_sql("SELECT image_id, pred_idx, conf FROM pred WHERE conf >= 0.25"))
def g10_confidence_filter(spark, d):
    return fx.predictions(spark, d).where(g.confident(F.col("conf"), 0.25)).select("image_id", "pred_idx", "conf")


@query(with_sql("SELECT image_id, box_idx, w, h FROM lab WHERE w * h >= 0.002"))
def g11_min_area_filter(spark, d):
    return fx.labels(spark, d).where(F.col("w") * F.col("h") >= 0.002).select("image_id", "box_idx", "w", "h")


@query(with_sql("SELECT image_id, pred_idx, coalesce(name, 'unknown') AS name, coalesce(name, class_id::VARCHAR) AS name_or_id FROM pred LEFT JOIN (SELECT * FROM classes WHERE class_id < 3) USING (class_id)"))
def g12_class_name(spark, d):
    names = F.broadcast(fx.classes(spark).where("class_id < 3"))
    return fx.predictions(spark, d).join(names, "class_id", "left").select("image_id", "pred_idx", F.coalesce("name", F.lit("unknown")).alias("name"), F.coalesce("name", F.col("class_id").cast("string")).alias("name_or_id"))


_BACK = "CASE WHEN flipped THEN (CAST(trunc(width * scale) AS INT) - {a}) / scale ELSE {b} / scale END"


@query(with_sql(f"SELECT image_id, det_idx, {_BACK.format(a='x2', b='x1')} AS x1, y1 / scale AS y1, {_BACK.format(a='x1', b='x2')} AS x2, y2 / scale AS y2 FROM views JOIN images USING (image_id)"))
def g13_tta_back_projection(spark, d):
    return fuse.back_projected(fx.views(spark, d), fx.images(spark, d)).select("image_id", "det_idx", *fuse.CORNERS)


@query(with_sql("SELECT image_id, pred_idx, " + ", ".join(f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {c} / {s})) AS {c}" for c, s in (("x1", "width"), ("y1", "height"), ("x2", "width"), ("y2", "height"))) + " FROM pred JOIN images USING (image_id)"))
def g14_clip(spark, d):
    rows = fx.predictions(spark, d).join(fx.images(spark, d), "image_id")
    sides = {"x1": "width", "y1": "height", "x2": "width", "y2": "height"}
    return rows.select("image_id", "pred_idx", *(g.clipped(F.col(c) / F.col(s)).alias(c) for c, s in sides.items()))


_KIND = "CASE pred_idx % 4 WHEN 0 THEN 'FP' WHEN 1 THEN 'FN' WHEN 2 THEN 'small' ELSE 'other' END"
_HARD = f"CASE {_KIND} WHEN 'FP' THEN 1.0 - conf WHEN 'FN' THEN CASE WHEN conf < 1 THEN 1.0 - conf ELSE 0.0 END WHEN 'small' THEN 0.8 ELSE 0.5 END::DOUBLE"


def _scored(spark, d):
    return fx.predictions(spark, d).withColumn("kind", F.expr(_KIND)).withColumn("score", g.hardness(F.col("kind"), F.col("conf"), F.col("conf")))


@query(with_sql(f"SELECT image_id, pred_idx, {_KIND} AS kind, {_HARD} AS score FROM pred"))
def g15_hardness(spark, d):
    return _scored(spark, d).select("image_id", "pred_idx", "kind", "score")


@query(with_sql("SELECT image_id, pred_idx, CASE WHEN score <= 0.5 THEN 1 WHEN score < 0.7 THEN 2 WHEN score < 0.9 THEN 3 ELSE 5 END AS copies FROM s", f"s AS (SELECT *, {_HARD} AS score FROM pred)"))
def g16_oversample_ratio(spark, d):
    return _scored(spark, d).select("image_id", "pred_idx", g.oversample_ratio(F.col("score")).alias("copies"))


@query(with_sql("SELECT image_id, pred_idx, CASE WHEN score < 0.5 THEN 0 WHEN score < 0.7 THEN 2 WHEN score < 0.9 THEN 3 ELSE 4 END AS variants FROM s", f"s AS (SELECT *, {_HARD} AS score FROM pred)"))
def g17_variant_count(spark, d):
    return _scored(spark, d).select("image_id", "pred_idx", g.variant_count(F.col("score")).alias("variants"))


@query(with_sql("SELECT image_id, box_idx, 0 AS class_id FROM gt"))
def g18_single_class(spark, d):
    return fx.ground_truth(spark, d).withColumn("class_id", F.lit(0)).select("image_id", "box_idx", "class_id")


_DUP = f"{_PB}, dup AS (SELECT image_id, a.box_idx AS i, b.box_idx AS j, {sql_iou('a', 'b')} AS iou FROM pb WHERE {sql_iou('a', 'b')} >= 0.8), dupbox AS (SELECT image_id, i AS box_idx FROM dup UNION SELECT image_id, j FROM dup)"
_TINY = _DUP + ", sized AS (SELECT g.*, width, height, (x2 - x1) * (y2 - y1) AS area FROM gt g JOIN images USING (image_id)), tiny AS (SELECT image_id, box_idx, area FROM sized s WHERE (area < 100 OR area / (width * height) < 0.001) AND NOT EXISTS (SELECT 1 FROM dupbox b WHERE b.image_id = s.image_id AND b.box_idx = s.box_idx)), big AS (SELECT image_id, box_idx, area FROM sized WHERE area / (width * height) > 0.9)"


def _qc(spark, d):
    gt, images = fx.ground_truth(spark, d), fx.images(spark, d)
    sized, pairs = qc.with_size(gt, images), qc.duplicate_pairs(gt)
    return gt, images, sized, pairs, qc.tiny_boxes(sized, pairs)


@query(with_sql("SELECT * FROM dup", _DUP))
def j1_duplicate_pairs(spark, d):
    return qc.duplicate_pairs(fx.ground_truth(spark, d))


@query(with_sql("SELECT image_id, class_id, pred_idx, box_idx, conf, iou FROM mraw WHERE iou > 0", sql_match(0.0, 0.5, prefix="m").split("medges AS")[0].rstrip().rstrip(",")))
def j2_candidate_edges(spark, d):
    return match.candidate_edges(fx.predictions(spark, d), fx.ground_truth(spark, d))


@query(with_sql("SELECT image_id, class_id, pred_idx, box_idx, iou, tp FROM mfound", sql_match(0.25, 0.5, prefix="m"), recursive=True))
def j3_greedy_match(spark, d):
    return match.greedy_match(fx.predictions(spark, d), fx.ground_truth(spark, d), 0.5, 0.25)


@query(with_sql(_COCO))
def j4_coco_join(spark, d):
    return convert.coco_labels(_coco(spark, d), fx.images(spark, d))


@query(with_sql(_COCO + " WHERE g.image_id % 10 < 9"))
def j5_image_exists(spark, d):
    return convert.coco_labels(_coco(spark, d), fx.images(spark, d), fx.images(spark, d).where("image_id % 10 < 9"))


@query(with_sql("SELECT image_id, box_idx, class_id FROM gt WHERE class_id < 3"))
def j6_known_classes(spark, d):
    objects = fx.ground_truth(spark, d).select("image_id", "box_idx", F.concat(F.lit("c"), F.col("class_id").cast("string")).alias("name"))
    return convert.known_classes(objects, fx.classes(spark).where("class_id < 3")).select("image_id", "box_idx", "class_id")


@query(with_sql("SELECT image_id, count(g.box_idx) AS n_labels FROM images LEFT JOIN gt g USING (image_id) GROUP BY image_id"))
def j7_images_without_labels(spark, d):
    return convert.with_labels(fx.images(spark, d), fx.ground_truth(spark, d))


@query(with_sql("SELECT image_id, box_idx, class_id FROM gt g WHERE NOT EXISTS (SELECT 1 FROM tiny t WHERE t.image_id = g.image_id AND t.box_idx = g.box_idx)", _TINY))
def j8_anti_join_delete(spark, d):
    gt, _, _, _, tiny = _qc(spark, d)
    return gt.join(tiny.select("image_id", "box_idx"), ["image_id", "box_idx"], "left_anti").select("image_id", "box_idx", "class_id")


@query(with_sql("SELECT image_id, box_idx, class_id FROM gt g WHERE NOT EXISTS (SELECT 1 FROM mfound f WHERE f.image_id = g.image_id AND f.box_idx = g.box_idx)", sql_match(0.25, 0.5, prefix="m"), recursive=True))
def j9_unmatched_boxes(spark, d):
    gt = fx.ground_truth(spark, d)
    return match.unmatched_boxes(gt, match.greedy_match(fx.predictions(spark, d), gt, 0.5, 0.25)).select("image_id", "box_idx", "class_id")


_BIN = "len([i FOR i IN range(100) IF 0.01::DOUBLE + i * (0.98::DOUBLE / 99) <= conf])"


@query(with_sql(f"SELECT {_BIN}::INT AS bin, count(*) AS n FROM pred GROUP BY 1"))
def j11_threshold_grid(spark, d):
    from boxspark.operators.evaluate import THRESHOLDS, threshold_bins

    return threshold_bins(fx.predictions(spark, d), THRESHOLDS).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query(with_sql("SELECT image_id, box_idx, class_id + 4 AS class_id FROM gt WHERE class_id < 2"))
def j12_vocabulary_merge(spark, d):
    new = spark.createDataFrame([(0, "c1"), (1, "extra")], "class_id bigint, name string")
    return convert.relabelled(fx.ground_truth(spark, d), convert.merged_vocabulary(fx.classes(spark), new), "new").select("image_id", "box_idx", "class_id")


@query(with_sql("SELECT image_id, i, j, iou FROM dup", _DUP))
def c1_duplicate_boxes(spark, d):
    return qc.issues(fx.ground_truth(spark, d), fx.images(spark, d)).where("issue = 'duplicate'").select("image_id", "i", "j", F.col("value").alias("iou"))


@query(with_sql("SELECT * FROM tiny", _TINY))
def c2_tiny_boxes(spark, d):
    return _qc(spark, d)[4]


@query(with_sql("SELECT * FROM big", _TINY))
def c3_oversized_boxes(spark, d):
    return qc.oversized_boxes(_qc(spark, d)[2])


@query(with_sql("SELECT image_id, box_idx, row_number() OVER (PARTITION BY image_id ORDER BY box_idx) - 1 AS new_idx FROM gt g WHERE NOT EXISTS (SELECT 1 FROM (SELECT image_id, box_idx FROM dupbox UNION SELECT image_id, box_idx FROM tiny) x WHERE x.image_id = g.image_id AND x.box_idx = g.box_idx)", _TINY))
def c5_auto_fix(spark, d):
    gt, _, _, pairs, tiny = _qc(spark, d)
    return qc.fixed(gt, pairs, tiny).select("image_id", "box_idx", "new_idx")


_ISSUES = _TINY + ", issues AS (SELECT image_id, 'duplicate' AS issue, i, j, iou AS value FROM dup UNION ALL SELECT image_id, 'tiny', box_idx, -1, area::DOUBLE FROM tiny UNION ALL SELECT image_id, 'oversized', box_idx, -1, area::DOUBLE FROM big)"


@query(with_sql("SELECT * FROM issues", _ISSUES))
def c6_issue_tables(spark, d):
    return qc.issues(fx.ground_truth(spark, d), fx.images(spark, d)).withColumn("j", F.coalesce("j", F.lit(-1)))


@query(with_sql("SELECT image_id, pred_idx FROM pred JOIN images USING (image_id) WHERE x1 < 0 OR y1 < 0 OR x2 > width OR y2 > height OR x2 <= x1 OR y2 <= y1"))
def c7_out_of_bounds(spark, d):
    return qc.out_of_bounds(qc.with_size(fx.predictions(spark, d), fx.images(spark, d))).select("image_id", "pred_idx")


@query("WITH i AS (SELECT s_suppkey AS image_id, 20 + (s_suppkey * 37) % 600 AS width, 20 + (s_suppkey * 91) % 400 + CASE WHEN s_suppkey % 50 = 0 THEN 5000 ELSE 0 END AS height FROM supplier), q AS (SELECT quantile_cont((width * height)::DOUBLE, 0.25) AS a, quantile_cont((width * height)::DOUBLE, 0.75) AS b FROM i) SELECT image_id FROM i, q WHERE least(width, height) < 32 OR width * height < a - 1.5 * (b - a) OR width * height > b + 1.5 * (b - a)")
def c9_resolution_anomalies(spark, d):
    images = fx.table(spark, d, "supplier").selectExpr("s_suppkey AS image_id", "20 + (s_suppkey * 37) % 600 AS width", "20 + (s_suppkey * 91) % 400 + CASE WHEN s_suppkey % 50 = 0 THEN 5000 ELSE 0 END AS height")
    return qc.resolution_anomalies(images).select("image_id")


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def c10_duplicate_contents(spark, d):
    rows = fx.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("content"))
    return qc.duplicate_contents(rows, "doc_id", "content")


@query(with_sql("SELECT image_id, count(*) FILTER (conf >= 0.9) AS kept, count(pred_idx) AS original FROM images LEFT JOIN pred USING (image_id) GROUP BY 1"))
def c11_auto_verify(spark, d):
    return qc.verified(fx.predictions(spark, d), fx.images(spark, d))


@query(with_sql("SELECT (SELECT count(*) FROM dup) AS duplicate, (SELECT count(*) FROM tiny) AS tiny, (SELECT count(*) FROM big) AS oversized, (SELECT count(DISTINCT image_id) FROM issues) AS images_with_issues, (SELECT count(*) FROM gt) AS n_boxes, (SELECT count(*) FROM issues) AS total_issues", _ISSUES))
def a4_qc_summary(spark, d):
    return qc.summary(fx.ground_truth(spark, d), fx.images(spark, d))


@query(with_sql("SELECT 'label_file_missing' AS issue, image_id FROM images WHERE image_id NOT IN (SELECT image_id FROM gt) UNION ALL SELECT DISTINCT 'no_image_found', image_id FROM gt WHERE image_id % 7 = 0", "x AS (SELECT 1)").replace("FROM images WHERE image_id NOT IN", "FROM images WHERE image_id % 7 <> 0 AND image_id NOT IN"))
def u5_image_differences(spark, d):
    return convert.image_differences(fx.ground_truth(spark, d), fx.images(spark, d).where("image_id % 7 <> 0"))


@query(with_sql("SELECT image_id, box_idx, row_number() OVER (PARTITION BY image_id ORDER BY box_idx) - 1 AS new_idx FROM gt WHERE box_idx % 3 <> 1"))
def w8_reindex(spark, d):
    return qc.reindexed(fx.ground_truth(spark, d).where("box_idx % 3 <> 1")).select("image_id", "box_idx", "new_idx")


#: Boxes in the pixels of an image of 8 x 8: an eightieth of their place, at least a pixel; some reach beyond the image.
_LITTLE = {"x1": "x1 div 80", "y1": "y1 div 60", "x2": "x1 div 80 + 1 + (x2 - x1) div 40", "y2": "y1 div 60 + 1 + (y2 - y1) div 40"}
_SQL_LITTLE = ", ".join(f"{v.replace(' div ', ' // ')} AS {k}" for k, v in _LITTLE.items())
_FLAT = f"""px AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, greatest(0, least(255, round_even(128 + 256 * embedding[i + 1]::DOUBLE, 0))) AS p FROM embeddings, range(64) r(i)),
little AS (SELECT image_id, box_idx, {_SQL_LITTLE} FROM gt),
flat AS (SELECT image_id, box_idx, round(var_pop(p), 6) AS variance FROM little JOIN px ON vec_id = image_id AND x >= greatest(x1, 0) AND x < x2 AND y >= greatest(y1, 0) AND y < y2 GROUP BY ALL HAVING var_pop(p) < 500)"""


def _flat(spark, d):
    """Boxes of images that have a vector, with little variance in its pixels."""
    image = pixels.vector_images(fx.table(spark, d, "embeddings"))
    own = fx.ground_truth(spark, d).groupBy("image_id").agg(F.collect_list(F.struct("box_idx", *(F.expr(v).alias(k) for k, v in _LITTLE.items()))).alias("boxes"))
    return pixels.occluded(image.join(own, "image_id"), 500.0).withColumn("variance", F.round("variance", 6))


@query(with_sql("SELECT image_id, box_idx, variance FROM flat", _FLAT))
def i2_box_variance(spark, d):
    return _flat(spark, d)


_SEEN = _ISSUES + f", {_FLAT}, hidden AS (SELECT f.* FROM flat f WHERE NOT EXISTS (SELECT 1 FROM dup WHERE dup.image_id = f.image_id AND f.box_idx IN (dup.i, dup.j)) AND NOT EXISTS (SELECT 1 FROM tiny t WHERE t.image_id = f.image_id AND t.box_idx = f.box_idx)), seen AS (SELECT * FROM issues UNION ALL SELECT image_id, 'occluded', box_idx, -1, variance FROM hidden)"


@query(with_sql("SELECT * FROM seen", _SEEN))
def c4_issues_with_occlusion(spark, d):
    return qc.issues(fx.ground_truth(spark, d), fx.images(spark, d), _flat(spark, d)).withColumn("j", F.coalesce("j", F.lit(-1)))


@query(with_sql("SELECT (SELECT count(*) FROM dup) AS duplicate, (SELECT count(*) FROM tiny) AS tiny, (SELECT count(*) FROM big) AS oversized, (SELECT count(*) FROM hidden) AS occluded, (SELECT count(DISTINCT image_id) FROM seen) AS images_with_issues, (SELECT count(*) FROM gt) AS n_boxes, (SELECT count(*) FROM seen) AS total_issues", _SEEN))
def a4_summary_with_occlusion(spark, d):
    return qc.summary(fx.ground_truth(spark, d), fx.images(spark, d), _flat(spark, d))
