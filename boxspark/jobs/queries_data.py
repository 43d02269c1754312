"""Queries of statistics, splits, responses, anchors, augmentation, pixels and tuning."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxspark.jobs import fixtures as fx
from boxspark.jobs.fixtures import ANCHORS, with_sql
from boxspark.jobs.registry import query
from boxspark.operators import anchors, augment, pixels, responses, stats, tuning
from boxspark.sources.annotations import exploded_predictions
from boxspark.sources.staged import stage


@query(with_sql("SELECT image_id, pred_idx::INT AS pred_idx, (CASE WHEN pred_idx % 2 = 0 THEN class_id ELSE 0 END)::INT AS class_id, conf, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2 FROM pred"))
def s9_read_predictions(spark, d):
    five = F.array(*(F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2", "conf")))
    one = F.when(F.col("pred_idx") % 2 == 0, F.array_append(five, F.col("class_id").cast("double"))).otherwise(five)
    boxes = F.transform(F.array_sort(F.collect_list(F.struct("pred_idx", one.alias("b")))), lambda x: x["b"])
    return exploded_predictions(fx.predictions(spark, d).groupBy(F.col("image_id").alias("image")).agg(boxes.alias("boxes")))


@query(with_sql("SELECT (SELECT count(*) FROM images) AS n_images, count(*) AS n_boxes, round(avg(w), 9) AS mean_w, round(avg(h), 9) AS mean_h, round(avg(w * h), 9) AS mean_area, min(w) AS min_w, max(w) AS max_w, min(h) AS min_h, max(h) AS max_h FROM lab"))
def a1_dataset_stats(spark, d):
    row = stats.dataset_stats(fx.labels(spark, d), fx.images(spark, d))
    return row.select("n_images", "n_boxes", *(F.round(c, 9).alias(c) for c in ("mean_w", "mean_h", "mean_area")), "min_w", "max_w", "min_h", "max_h")


_DIST = "dist AS (SELECT c.class_id, c.name, count(g.class_id) AS n FROM classes c LEFT JOIN (SELECT class_id FROM gt WHERE class_id <> 3) g USING (class_id) GROUP BY 1, 2)"


def _dist(spark, d):
    return stats.class_distribution(fx.ground_truth(spark, d).where("class_id <> 3"), fx.classes(spark))


@query(with_sql("SELECT * FROM dist", _DIST))
def a2_class_distribution(spark, d):
    return _dist(spark, d)


@query(with_sql("SELECT max(n)::DOUBLE / coalesce(min(n) FILTER (n > 0), 1) AS imbalance FROM dist", _DIST))
def a3_imbalance_ratio(spark, d):
    return stats.imbalance_ratio(_dist(spark, d))


@query(with_sql("SELECT coalesce(height, -1) AS height, coalesce(class_id, -1) AS class_id, count(*) AS n, grouping(height, class_id)::INT AS level FROM gt JOIN images USING (image_id) GROUP BY ROLLUP (height, class_id)"))
def a5_rollup(spark, d):
    return stats.rolled_up(fx.ground_truth(spark, d).join(fx.images(spark, d), "image_id"), "height", "class_id").na.fill(-1, ["height", "class_id"])


@query(with_sql("SELECT count(*) FILTER (kept > 0) AS with_boxes, count(*) FILTER (kept = 0) AS without_boxes FROM (SELECT image_id, count(*) FILTER (conf >= 0.9) AS kept FROM images LEFT JOIN pred USING (image_id) GROUP BY 1)"))
def a8_verify_summary(spark, d):
    from boxspark.operators.qc import verified

    rows = verified(fx.predictions(spark, d), fx.images(spark, d))
    return rows.agg(F.sum((F.col("kept") > 0).cast("bigint")).alias("with_boxes"), F.sum((F.col("kept") == 0).cast("bigint")).alias("without_boxes"))


_HIST = "hist AS (SELECT l_suppkey AS run, l_discount AS lr0, CASE WHEN l_linenumber = 7 AND l_suppkey % 2 = 0 THEN NULL ELSE l_tax END AS momentum, l_quantity AS box, l_extendedprice / 100000.0::DOUBLE AS fitness, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS row FROM lineitem)"


@query(f"WITH {_HIST}, u AS (SELECT 'lr0' AS name, lr0 AS value FROM hist UNION ALL SELECT 'momentum', momentum FROM hist UNION ALL SELECT 'fitness', fitness FROM hist) SELECT name, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(stddev_samp(value), 6) AS std, count(value) AS n FROM u GROUP BY 1")
def a9_metric_summary(spark, d):
    rows = tuning.metric_summary(fx.history(spark, d), ["lr0", "momentum", "fitness"], "row")
    return rows.select("name", F.round("mean", 6).alias("mean"), "least", "most", F.round("std", 6).alias("std"), "n")


@query(f"WITH {_HIST}, h AS (SELECT * FROM hist WHERE run = 1), u AS (SELECT 'lr0' AS name, lr0 AS value, fitness FROM h UNION ALL SELECT 'momentum', momentum, fitness FROM h UNION ALL SELECT 'box', box, fitness FROM h) SELECT name, round(CASE WHEN stddev_pop(value) > 0 THEN corr(value, fitness) ELSE 0 END, 4) AS importance FROM u GROUP BY 1 HAVING count(value) = count(*)")
def a10_parameter_importance(spark, d):
    return tuning.parameter_importance(fx.history(spark, d).where("run = 1"), ["lr0", "momentum", "box"], "fitness", "row")


@query(with_sql("SELECT round(quantile_cont(w * h, 0.0), 9) AS p0, round(quantile_cont(w * h, 0.4), 9) AS p40, round(quantile_cont(w * h, 0.8), 9) AS p80, round(quantile_cont(w * h, 1.0), 9) AS p100 FROM lab"))
def a11_percentiles(spark, d):
    cuts = stats.percentiles(fx.labels(spark, d).withColumn("area", F.col("w") * F.col("h")), "area", list(anchors.CUTS))
    return cuts.select(*(F.round(F.col("cuts")[i], 9).alias(n) for i, n in enumerate(("p0", "p40", "p80", "p100"))))


@query("SELECT name, row_number() OVER (ORDER BY name) - 1 AS class_id FROM (SELECT DISTINCT p_brand AS name FROM part)")
def a12_class_ids(spark, d):
    return stats.class_ids(fx.table(spark, d, "part"), "p_brand")


@query(with_sql("SELECT image_id % 4 <> 3 AS ok, count(*) AS n FROM (SELECT DISTINCT image_id FROM gt) GROUP BY 1"))
def a13_response_counts(spark, d):
    return responses.parsed(fx.responses(spark, d)).groupBy("ok").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_HIST} SELECT rank::INT AS rank, row, fitness FROM (SELECT *, row_number() OVER (ORDER BY fitness DESC, row) AS rank FROM hist WHERE run = 2) WHERE rank <= 5")
def w3_top_runs(spark, d):
    return tuning.top_runs(fx.history(spark, d).where("run = 2"), "fitness", "row")


@query(f"WITH {_HIST}, h AS (SELECT * FROM hist WHERE run = 2) SELECT max(row) AS last_id, arg_max(fitness, row) AS last_fitness, max(fitness) AS best_fitness, (SELECT row FROM h ORDER BY fitness DESC, row LIMIT 1) AS best_id FROM h")
def w4_best_and_last(spark, d):
    return tuning.last_and_best(fx.history(spark, d).where("run = 2"), "fitness", "row")


@query("SELECT o_orderkey AS image_id, concat(o_orderkey, '.txt') AS name FROM orders WHERE o_orderkey % 3 = 0")
def w6_sorted_images(spark, d):
    rows = fx.images(spark, d).where("image_id % 3 = 0").select("image_id", F.concat(F.col("image_id").cast("string"), F.lit(".txt")).alias("name"))
    return rows.orderBy("name")


@query(f"WITH {_HIST}, u AS (SELECT run, 'lr0' AS name, lr0 AS value, fitness FROM hist UNION ALL SELECT run, 'momentum', momentum, fitness FROM hist UNION ALL SELECT run, 'box', box, fitness FROM hist) SELECT run, name, round(CASE WHEN stddev_pop(value) > 0 THEN corr(value, fitness) ELSE 0 END, 4) AS importance FROM u GROUP BY 1, 2 HAVING count(value) = count(*)")
def a10_parameter_importance_of_runs(spark, d):
    return tuning.parameter_importance(fx.history(spark, d), ["lr0", "momentum", "box"], "fitness", "row", by=("run",))


@query(f"WITH {_HIST} SELECT run, rank::INT AS rank, row, fitness FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY fitness DESC, row) AS rank FROM hist) WHERE rank <= 5")
def w3_top_of_runs(spark, d):
    return tuning.top_runs(fx.history(spark, d), "fitness", "row", by=("run",))


@query(f"WITH {_HIST}, b AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY fitness DESC, row) AS rank FROM hist) SELECT run, max(row) AS last_id, arg_max(fitness, row) AS last_fitness, max(fitness) AS best_fitness, min(row) FILTER (rank = 1) AS best_id FROM b GROUP BY 1")
def w4_best_and_last_of_runs(spark, d):
    return tuning.last_and_best(fx.history(spark, d), "fitness", "row", by=("run",))


@query("SELECT o_orderkey AS image_id, concat(o_orderkey, '.txt') AS name FROM orders")
def w6_all_sorted_images(spark, d):
    return fx.images(spark, d).select("image_id", F.concat(F.col("image_id").cast("string"), F.lit(".txt")).alias("name")).orderBy("name")


_SPLIT = with_sql("SELECT image_id, CASE WHEN r <= floor(n * 0.7) THEN 'train' WHEN r <= floor(n * 0.7) + floor(n * 0.2) THEN 'val' ELSE 'test' END AS split FROM (SELECT image_id, row_number() OVER (ORDER BY md5(concat(image_id, '|42')), image_id) AS r, count(*) OVER () AS n FROM images)")


@query(_SPLIT)
def w7_split_dataset(spark, d):
    return stats.split_dataset(fx.images(spark, d))


@query(f"SELECT split, count(*) AS n_images FROM ({_SPLIT}) GROUP BY 1")
def a1_images_per_split(spark, d):
    return stats.images_per_split(stats.split_dataset(fx.images(spark, d)))


_UNIT = "(('0x' || substr(md5({t}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query(with_sql(f"SELECT image_id FROM images WHERE {_UNIT.format(t="concat_ws('|', image_id, 42)")} < 0.3"))
def w9_subset(spark, d):
    return stats.subset(fx.images(spark, d), 0.3).select("image_id")


@query(with_sql("SELECT image_id, count(*) AS n FROM gt WHERE image_id % 4 <> 3 GROUP BY 1"))
def t1_json_recovery(spark, d):
    rows = responses.parsed(fx.responses(spark, d)).where("ok")
    return rows.select("image_id", F.size("response.annotations").cast("bigint").alias("n"))


@query(with_sql("SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY box_idx)::INT - 1 AS ann_idx, class_id, cx, cy, w, h, (box_idx % 10) / 10.0::DOUBLE AS conf FROM lab WHERE image_id % 4 <> 3 QUALIFY conf >= 0.25"))
def t2_annotation_normalisation(spark, d):
    return responses.annotations(responses.parsed(fx.responses(spark, d)))


@query("SELECT string_agg('- ' || p_brand || ': ' || least_name, chr(10) ORDER BY p_brand) AS prompt FROM (SELECT p_brand, min(p_name) AS least_name FROM part GROUP BY 1)")
def t3_class_prompt(spark, d):
    rows = fx.table(spark, d, "part").groupBy("p_brand").agg(F.min("p_name").alias("description"))
    return responses.class_prompt(rows.select(F.col("p_brand").alias("class_id"), F.col("p_brand").alias("name"), "description"))


@query("SELECT page_id, regexp_extract(url, '([^/]*?)([.][^./]*)?$', 1) AS stem, regexp_extract(url, '^(.*?)([.][^.]*)?$', 1) || '_aug' || (page_id % 3) || regexp_extract(url, '^(.*?)([.][^.]*)?$', 2) AS variant FROM pages")
def t4_path_parts(spark, d):
    return fx.table(spark, d, "pages").select("page_id", responses.stem(F.col("url")).alias("stem"), responses.variant_name(F.col("url"), F.col("page_id") % 3).alias("variant"))


@query(with_sql("SELECT image_id, string_agg(class_id::VARCHAR, ',' ORDER BY box_idx) AS classes FROM gt GROUP BY 1"))
def t5_group_annotations(spark, d):
    order = F.array_sort(F.collect_list(F.struct("box_idx", F.col("class_id").cast("string").alias("c"))))
    return fx.ground_truth(spark, d).groupBy("image_id").agg(F.array_join(F.transform(order, lambda x: x["c"]), ",").alias("classes"))


@query("SELECT page_id, trim(split_part(url, ':', 1)) AS key, CASE WHEN contains(url, ':') THEN trim(substr(url, instr(url, ':') + 1)) END AS value FROM pages")
def t6_split_once(spark, d):
    return fx.table(spark, d, "pages").select("page_id", responses.split_once(F.col("url")).alias("x")).select("page_id", "x.key", "x.value")


def _sql_anchor(i: int, a: tuple) -> str:
    cx, cy, w, h = (f"{v}::DOUBLE" for v in a)
    inter = f"greatest(least(cx + w / 2, {cx} + {w} / 2) - greatest(cx - w / 2, {cx} - {w} / 2), 0) * greatest(least(cy + h / 2, {cy} + {h} / 2) - greatest(cy - h / 2, {cy} - {h} / 2), 0)"
    area = f"((cx + w / 2) - (cx - w / 2)) * ((cy + h / 2) - (cy - h / 2)) + (({cx} + {w} / 2) - ({cx} - {w} / 2)) * (({cy} + {h} / 2) - ({cy} - {h} / 2))"
    return f"CASE WHEN {area} - {inter} > 0 THEN ({inter}) / ({area} - {inter}) ELSE 0 END"


_NEAR = "near0 AS (SELECT *, [" + ", ".join(_sql_anchor(i, a) for i, a in enumerate(ANCHORS)) + "] AS ious FROM lab), nearest AS (SELECT * EXCLUDE (ious), list_max(ious) AS best_iou, list_position(ious, list_max(ious))::INT - 1 AS anchor FROM near0)"


@query(with_sql("SELECT image_id, box_idx, anchor, round(best_iou, 9) AS best_iou FROM nearest", _NEAR))
def j10_nearest_anchor(spark, d):
    return anchors.nearest_anchor(fx.labels(spark, d), ANCHORS).select("image_id", "box_idx", "anchor", F.round("best_iou", 9).alias("best_iou"))


@query(with_sql("SELECT s.scale, count(*) AS n FROM (SELECT w * h AS area FROM lab) l JOIN (SELECT unnest(['P3', 'P4', 'P5']) AS scale, unnest(q[1:3]) AS lo, unnest(q[2:4]) AS hi FROM (SELECT quantile_cont(w * h, [0.0, 0.4, 0.8, 1.0]) AS q FROM lab)) s ON area BETWEEN lo AND hi GROUP BY 1"))
def n1_scale_assignment(spark, d):
    sizes = stage(fx.labels(spark, d).select("w", "h"), "sizes")
    return anchors.scale_assignment(sizes).groupBy("scale").agg(F.count(F.lit(1)).alias("n"))


@query(with_sql("SELECT anchor AS k, count(*) AS n, round(avg(cx), 6) AS cx, round(avg(cy), 6) AS cy, round(avg(w), 6) AS w, round(avg(h), 6) AS h, round(avg(best_iou), 6) AS avg_iou FROM nearest GROUP BY 1", _NEAR))
def n2_lloyd_step(spark, d):
    return anchors.lloyd_step(fx.labels(spark, d), ANCHORS).select("k", "n", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "w", "h", "avg_iou")))


@query()
def n2_kmeans(spark, d):
    labels = fx.labels(spark, d)
    found, score = anchors.kmeans(labels, len(ANCHORS))
    return anchors.validation(labels, found).select(F.lit(round(score, 6)).alias("avg_iou"), F.round("mean_best_iou", 6).alias("mean_best_iou"), "n")


@query()
def n3_silhouette(spark, d):
    value = anchors.silhouette(fx.labels(spark, d), ANCHORS)
    return anchors.validation(fx.labels(spark, d), ANCHORS).select(F.lit(round(value, 6)).alias("silhouette"), "n")


@query()
def n4_choose_k(spark, d):
    labels = fx.labels(spark, d)
    k, found, score = anchors.choose_k(labels)
    return anchors.validation(labels, found).select(F.lit(k).alias("k"), F.lit(round(score, 6)).alias("score"), "n")


@query(with_sql("SELECT round(avg(best_iou), 6) AS mean_best_iou, count(*) AS n FROM nearest", _NEAR))
def n5_anchor_validation(spark, d):
    return anchors.validation(fx.labels(spark, d), ANCHORS).select(F.round("mean_best_iou", 6).alias("mean_best_iou"), "n")


@query()
def n5_scale_validation(spark, d):
    rows = anchors.scale_validation(fx.labels(spark, d), {"P3": ANCHORS[:1], "P4": ANCHORS[1:3], "P5": ANCHORS[3:]})
    return rows.select("scale", F.round("mean_best_iou", 6).alias("mean_best_iou"), "n")


def _chance(what: str) -> str:
    return _UNIT.format(t=f"concat_ws('|', image_id, variant, '{what}', 7)")


_AUG = f"aug0 AS (SELECT l.*, v::INT AS variant FROM lab l, range(3) r(v)), aug1 AS (SELECT *, CASE WHEN variant > 0 AND {_chance('flip')} < 0.25 THEN 1.0::DOUBLE - cx ELSE cx END AS fx FROM aug0), aug2 AS (SELECT *, CASE WHEN variant > 0 AND {_chance('move')} < 0.5 THEN fx + ({_chance('by')} * 2.0 - 1.0) * 0.1::DOUBLE ELSE fx END AS mx FROM aug1)"


@query(with_sql("SELECT image_id, box_idx, variant, round(CASE WHEN variant > 0 THEN greatest(0.0, least(1.0, mx)) ELSE cx END, 9) AS cx, cy FROM aug2", _AUG))
def m1_augment_labels(spark, d):
    return augment.augmented(fx.labels(spark, d)).select("image_id", "box_idx", "variant", F.round("cx", 9).alias("cx"), "cy")


_QUADS = "quads AS (SELECT image_id, bucket || '-' || (pos // 4) AS mosaic_id, pos % 4 AS tile FROM (SELECT image_id, substr(md5(concat_ws('|', image_id, '7')), 1, 2) AS bucket, row_number() OVER (PARTITION BY substr(md5(concat_ws('|', image_id, '7')), 1, 2) ORDER BY md5(image_id::VARCHAR), image_id) - 1 AS pos FROM images))"


@query(with_sql("SELECT mosaic_id, tile::INT AS tile, l.image_id, box_idx, class_id, CASE WHEN tile = 0 THEN cx ELSE (cx + tile % 2) / 2 END AS cx, CASE WHEN tile = 0 THEN cy ELSE (cy + tile // 2) / 2 END AS cy, w, h FROM lab l JOIN quads q ON q.image_id = l.image_id", _QUADS))
def m2_mosaic(spark, d):
    return augment.mosaic(fx.labels(spark, d), fx.images(spark, d))


@query(with_sql("SELECT image_id // 2 AS mix_id, image_id, box_idx, class_id FROM gt WHERE image_id // 2 IN (SELECT image_id // 2 FROM images GROUP BY 1 HAVING count(*) = 2)"))
def m3_mixup(spark, d):
    pairs = fx.images(spark, d).groupBy(F.expr("image_id div 2").alias("mix_id")).agg(F.min("image_id").alias("a"), F.max("image_id").alias("b")).where("a <> b")
    return augment.mixup(fx.ground_truth(spark, d), pairs).select("mix_id", "image_id", "box_idx", "class_id")


_LAP = """WITH px AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) r(i)),
nb AS (SELECT vec_id, y, x, unnest([abs(y - 1), CASE WHEN y = 7 THEN 6 ELSE y + 1 END, y, y]) AS ny, unnest([x, x, abs(x - 1), CASE WHEN x = 7 THEN 6 ELSE x + 1 END]) AS nx FROM px),
s AS (SELECT nb.vec_id, nb.y, nb.x, sum(p.v) AS around FROM nb JOIN px p ON p.vec_id = nb.vec_id AND p.y = nb.ny AND p.x = nb.nx GROUP BY 1, 2, 3)
SELECT s.vec_id, round(var_pop(around - 4 * v), 6) AS lap_var FROM s JOIN px USING (vec_id, y, x) GROUP BY 1"""


@query(_LAP)
def i1_laplacian_variance(spark, d):
    return pixels.vector_features(fx.table(spark, d, "embeddings")).select("vec_id", F.round("lap_var", 6).alias("lap_var"))


_PX = "px AS (SELECT vec_id, [greatest(0, least(255, round_even(128 + 256 * v::DOUBLE, 0))) FOR v IN embedding] AS p FROM embeddings)"
_SUMS = "list_sum(p)::BIGINT AS total, list_sum([p[i] * i FOR i IN range(1, len(p) + 1)])::BIGINT AS weighted"


def _grey_vectors(spark, d):
    return pixels.vector_images(fx.table(spark, d, "embeddings"))


def _sums(images, *keys):
    """Sums that tell images apart: of the pixels, and of the pixels by their place."""
    values = F.transform(F.sequence(F.lit(1), F.length("pixels")), lambda i: F.conv(F.hex(F.substring("pixels", i, F.lit(1))), 16, 10).cast("bigint") * i)
    plain = F.transform(F.sequence(F.lit(1), F.length("pixels")), lambda i: F.conv(F.hex(F.substring("pixels", i, F.lit(1))), 16, 10).cast("bigint"))
    add = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return images.select(*keys, "width", "height", add(plain).alias("total"), add(values).alias("weighted"))


@query(f"""WITH {_PX}, v AS (
SELECT vec_id, 'bright_7' AS variant, [least(255, round_even(x * 0.7::DOUBLE, 0)) FOR x IN p] AS p FROM px
UNION ALL SELECT vec_id, 'bright_13', [least(255, round_even(x * 1.3::DOUBLE, 0)) FOR x IN p] FROM px
UNION ALL SELECT vec_id, 'flip', [p[i // 8 * 8 + 8 - i % 8] FOR i IN range(64)] FROM px WHERE vec_id % 2 = 0)
SELECT vec_id, variant, 8 AS width, 8 AS height, {_SUMS} FROM v""")
def i4_variant_images(spark, d):
    """Pixels of a plan that gives every image two brightnesses and every other one its mirror image."""
    images = _grey_vectors(spark, d)
    plan = images.select("image_id", F.explode(F.when(F.col("image_id") % 2 == 0, F.array(*map(F.lit, ("bright_7", "bright_13", "flip")))).otherwise(F.array(*map(F.lit, ("bright_7", "bright_13"))))).alias("variant"))
    return _sums(pixels.variant_images(images, plan), F.col("image_id").alias("vec_id"), "variant")


@query(f"""WITH {_PX}, v AS (SELECT vec_id, [round_even(least(255, x * 1.2::DOUBLE), 0) FOR x IN [p[r * 16 + c * 2 + 1] FOR r IN range(4) FOR c IN range(4)]] AS p FROM px)
SELECT vec_id, 4 AS width, 4 AS height, {_SUMS} FROM v""".replace("[p[r * 16 + c * 2 + 1] FOR r IN range(4) FOR c IN range(4)]", "[p[i // 4 * 16 + i % 4 * 2 + 1] FOR i IN range(16)]"))
def i3_preprocessed(spark, d):
    """Every image at half its side, brighter by a fifth."""
    made = pixels.preprocessed_images(_grey_vectors(spark, d), 4, 4, brightness=1.2)
    return _sums(made.where("error IS NULL"), F.col("image_id").alias("vec_id"))
