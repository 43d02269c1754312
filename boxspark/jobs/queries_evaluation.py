"""Queries of evaluation, error attribution, hard examples and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxspark.jobs import fixtures as fx
from boxspark.jobs.fixtures import sql_iou, sql_match, sql_outcomes, with_sql
from boxspark.jobs.registry import query
from boxspark.operators import errors, evaluate, fuse, match


#: Places that are missing read -1 in results.
_NONE = "coalesce(pred_idx, -1) AS pred_idx, coalesce(box_idx, -1) AS box_idx"


def _placed(rows):
    return rows.withColumn("pred_idx", F.coalesce("pred_idx", F.lit(-1))).withColumn("box_idx", F.coalesce("box_idx", F.lit(-1)))


def _pg(spark, d):
    return fx.predictions(spark, d), fx.ground_truth(spark, d)


_OUT = sql_outcomes(0.25, 0.5, "conf", True)
_TWO = sql_outcomes(0.25, 0.5, "conf", False)
_IDX = sql_outcomes(0.25, 0.5, "index", False)


@query(with_sql(f"SELECT * REPLACE ({_NONE}) FROM outs", _OUT, True))
def e1_error_outcomes(spark, d):
    return _placed(match.outcomes(*_pg(spark, d)))


_ERR = """, errs AS (SELECT o.image_id, o.outcome AS error_type, o.class_id, o.pred_idx, o.box_idx, o.conf,
  CASE WHEN o.outcome = 'FP' THEN CASE WHEN lap_var < 100 THEN 'blur' ELSE 'background' END
    ELSE CASE WHEN lap_var IS NULL THEN 'missing' WHEN ((g.x2 - g.x1) * (g.y2 - g.y1)) / 409600 < 0.01 THEN 'small_target' WHEN lap_var < 100 THEN 'blur' ELSE 'missing' END END AS reason
  FROM outs o LEFT JOIN feats f ON f.image_id = o.image_id LEFT JOIN gt g ON g.image_id = o.image_id AND g.box_idx = o.box_idx WHERE o.outcome IN ('FP', 'FN'))"""


def _errors(spark, d):
    pred, gt = _pg(spark, d)
    return errors.attributed(match.outcomes(pred, gt), gt, fx.features(spark, d))


@query(with_sql(f"SELECT * REPLACE ({_NONE}) FROM errs", _OUT + _ERR, True))
def e2_error_attribution(spark, d):
    return _placed(_errors(spark, d))


_RATES = "CASE WHEN {a} > 0 THEN {t}::DOUBLE / {a} ELSE 0.0::DOUBLE END"


@query(with_sql("SELECT fp, fn, correct, " + _RATES.format(a="(correct + fp)", t="correct") + " AS precision, " + _RATES.format(a="(correct + fn)", t="correct") + " AS recall FROM (SELECT count(*) FILTER (outcome = 'FP') AS fp, count(*) FILTER (outcome = 'FN') AS fn, count(*) FILTER (outcome = 'correct') AS correct FROM outs)", _OUT, True))
def e3_error_summary(spark, d):
    return errors.error_summary(match.outcomes(*_pg(spark, d)))


@query(with_sql("SELECT code FROM r, (SELECT unnest([CASE WHEN bf > 0.2 * fp THEN 'blur_fp' END, CASE WHEN gf > 0.3 * fp THEN 'background_fp' END, CASE WHEN sn > 0.3 * fn THEN 'small_fn' END, CASE WHEN bn > 0.2 * fn THEN 'blur_fn' END]) AS code FROM r) WHERE code IS NOT NULL", _OUT + _ERR + ", r AS (SELECT count(*) FILTER (error_type = 'FP') AS fp, count(*) FILTER (error_type = 'FN') AS fn, count(*) FILTER (error_type = 'FP' AND reason = 'blur') AS bf, count(*) FILTER (error_type = 'FP' AND reason = 'background') AS gf, count(*) FILTER (error_type = 'FN' AND reason = 'small_target') AS sn, count(*) FILTER (error_type = 'FN' AND reason = 'blur') AS bn FROM errs)", True))
def e4_recommendations(spark, d):
    return errors.recommendations(_errors(spark, d))


@query(with_sql(f"SELECT * REPLACE ({_NONE}) FROM outs", _TWO, True))
def e5_classify_errors(spark, d):
    return _placed(match.outcomes(*_pg(spark, d), near=False))


@query(with_sql("SELECT image_id, class_id, pred_idx, box_idx, iou, tp FROM found", sql_match(0.25, 0.5, "index"), True))
def e6_index_order_match(spark, d):
    return match.greedy_match(*_pg(spark, d), 0.5, 0.25, "index")


@query(with_sql("SELECT class_id AS pred_class, CASE WHEN outcome = 'correct' THEN class_id ELSE -1 END AS gt_class, count(*) AS n FROM outs WHERE outcome <> 'FN' GROUP BY 1, 2", _IDX, True))
def e7_confusion(spark, d):
    return evaluate.confusion(*_pg(spark, d))


_F1 = "CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END"
_CLS = """, cnt AS (SELECT c.class_id, c.name, count(*) FILTER (outcome = 'correct') AS tp, count(*) FILTER (outcome = 'FP') AS fp, count(*) FILTER (outcome = 'FN') AS fn FROM classes c LEFT JOIN outs o ON o.class_id = c.class_id GROUP BY 1, 2),
rates AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0::DOUBLE END AS recall FROM cnt)"""


def _classes(spark, d):
    return evaluate.per_class_metrics(*_pg(spark, d), fx.classes(spark))


@query(with_sql(f"SELECT *, {_F1} AS f1 FROM rates", _TWO + _CLS, True))
def e8_per_class_metrics(spark, d):
    return _classes(spark, d)


@query(with_sql(f"SELECT *, {_F1} AS f1 FROM (SELECT tp, fp, fn, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / (tp + fn) AS recall, (SELECT count(*) FROM images) AS n_images FROM (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM cnt))", _TWO + _CLS, True))
def e9_overall_metrics(spark, d):
    return evaluate.overall_metrics(_classes(spark, d), fx.images(spark, d).agg(F.count(F.lit(1)).alias("n_images")))


@query(with_sql("SELECT class_id, 'false_alarm' AS code FROM rates WHERE precision < 0.7 UNION ALL SELECT class_id, 'miss' FROM rates WHERE recall < 0.7", _TWO + _CLS, True))
def e10_class_recommendations(spark, d):
    return errors.class_recommendations(_classes(spark, d), 0.7)


@query(with_sql(f"SELECT error_type, image_id, {_NONE}, rank FROM (SELECT *, row_number() OVER (PARTITION BY error_type ORDER BY image_id, pred_idx NULLS FIRST, box_idx NULLS FIRST)::INT AS rank FROM errs) WHERE rank <= 10", _OUT + _ERR, True))
def e11_example_lists(spark, d):
    return _placed(errors.first_of_each(_errors(spark, d), "error_type", ["image_id", "pred_idx", "box_idx"], 10)).select("error_type", "image_id", "pred_idx", "box_idx", "rank")


_CURVE = sql_match(0.0, 0.5) + f""", grid AS (SELECT i::INT AS k, 0.01::DOUBLE + i * (0.98::DOUBLE / 99) AS threshold FROM range(100) r(i)),
pts AS (SELECT p.conf, (f.pred_idx IS NOT NULL)::INT AS hit FROM pred p LEFT JOIN found f ON f.image_id = p.image_id AND f.pred_idx = p.pred_idx),
raw_curve AS (SELECT k, threshold, sum(CASE WHEN conf >= threshold THEN hit ELSE 0 END)::BIGINT AS tp, count(*) FILTER (conf >= threshold) AS n FROM grid, pts GROUP BY 1, 2),
c0 AS (SELECT k, threshold, tp, n - tp AS fp, (SELECT count(*) FROM gt) - tp AS fn FROM raw_curve),
c1 AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0::DOUBLE END AS recall FROM c0),
curve AS (SELECT *, {_F1} AS f1 FROM c1)"""


@query(with_sql("SELECT * FROM curve", _CURVE, True))
def e12_pr_curve(spark, d):
    return evaluate.pr_curve(*_pg(spark, d))


_TENTHS = [round(0.1 * k, 1) for k in range(1, 10)]
_LISTED = sql_match(0.0, None, "index", level=True).replace("[0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]", str(_TENTHS)).replace("iou >= level", "conf >= level AND iou >= 0.5").replace("e.iou >= e.level", "e.iou >= 0.5") + f""",
hits AS (SELECT level, count(*) AS tp FROM found WHERE tp GROUP BY 1),
c0 AS (SELECT (row_number() OVER (ORDER BY t.level) - 1)::INT AS k, t.level AS threshold, coalesce(h.tp, 0) AS tp, (SELECT count(*) FROM pred WHERE conf >= t.level) - coalesce(h.tp, 0) AS fp, (SELECT count(*) FROM gt) - coalesce(h.tp, 0) AS fn
       FROM (SELECT unnest({_TENTHS})::DOUBLE AS level) t LEFT JOIN hits h ON h.level = t.level),
c1 AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0::DOUBLE END AS recall FROM c0)"""


@query(with_sql(f"SELECT *, {_F1} AS f1 FROM c1", _LISTED, True))
def e12_list_order_curve(spark, d):
    return evaluate.list_order_curve(*_pg(spark, d), _TENTHS)


@query(with_sql("SELECT b.threshold, b.f1, b.precision, b.recall, n.precision AS reported_precision, n.recall AS reported_recall FROM (SELECT * FROM curve ORDER BY f1 DESC, k LIMIT 1) b, curve n WHERE abs(n.threshold - b.threshold) < 0.01 ORDER BY n.k LIMIT 1", _CURVE, True))
def e13_optimal_threshold(spark, d):
    return evaluate.optimal_threshold(evaluate.pr_curve(*_pg(spark, d)))


@query(with_sql("SELECT round(sum(s), 9) AS auc FROM (SELECT (lead(recall) OVER w - recall) * (lead(precision) OVER w + precision) / 2 AS s FROM curve WINDOW w AS (ORDER BY recall, k))", _CURVE, True))
def e14_auc_pr(spark, d):
    return evaluate.auc_pr(evaluate.pr_curve(*_pg(spark, d))).select(F.round("auc", 9).alias("auc"))


_AP = sql_match(0.0, None, level=True) + """, levels AS (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])::DOUBLE AS level),
nb AS (SELECT class_id, count(*) AS boxes FROM gt GROUP BY 1),
perconf AS (SELECT p.class_id, l.level, p.conf, count(*) AS n, count(f.pred_idx) AS tp FROM pred p CROSS JOIN levels l LEFT JOIN found f ON f.level = l.level AND f.image_id = p.image_id AND f.pred_idx = p.pred_idx GROUP BY 1, 2, 3),
cum AS (SELECT class_id, level, boxes, sum(n) OVER w AS n, sum(tp) OVER w AS tp FROM perconf JOIN nb USING (class_id) WINDOW w AS (PARTITION BY class_id, level ORDER BY conf DESC)),
best AS (SELECT class_id, level, r, coalesce(max(tp / n) FILTER (tp * 100 >= r * boxes), 0) AS p FROM cum, range(101) g(r) GROUP BY 1, 2, 3),
ap AS (SELECT class_id, level, sum(p) / 101 AS ap FROM best GROUP BY 1, 2)"""


def _ap(spark, d, levels=None):
    return evaluate.average_precision(*_pg(spark, d), levels)


@query(with_sql("SELECT class_id, level, round(ap, 6) AS ap FROM ap", _AP, True))
def e15_average_precision(spark, d):
    return _ap(spark, d).select("class_id", "level", F.round("ap", 6).alias("ap"))


@query("WITH m AS (SELECT s_suppkey AS pos, s_suppkey::VARCHAR AS model, round(s_acctbal / 500)::BIGINT AS fitness FROM supplier) SELECT model, fitness FROM m ORDER BY fitness DESC, pos LIMIT 1")
def e16_select_best(spark, d):
    metrics = fx.table(spark, d, "supplier").selectExpr("s_suppkey AS pos", "CAST(s_suppkey AS STRING) AS model", "CAST(round(s_acctbal / 500) AS BIGINT) AS fitness")
    return evaluate.select_best(metrics, "fitness", "pos").select("model", "fitness")


_AP_STRICT = _AP.replace("FROM pred p JOIN gt g ON", "FROM (SELECT * FROM pred WHERE conf >= 0.5) p JOIN gt g ON").replace("FROM pred p CROSS JOIN", "FROM (SELECT * FROM pred WHERE conf >= 0.5) p CROSS JOIN")


def _model_sql(model: str, ap: str, where: str) -> str:
    rates = f"""rates AS (SELECT b.class_id, coalesce(tp / made, 0) AS p, coalesce(tp / boxes, 0) AS r FROM nb b LEFT JOIN (SELECT class_id, count(*) AS made FROM pred WHERE {where} GROUP BY 1) USING (class_id)
      LEFT JOIN (SELECT class_id, count(*) AS tp FROM found WHERE level = 0.5 GROUP BY 1) USING (class_id))"""
    m50, m = "avg(ap) FILTER (level = 0.5)", "avg(ap)"
    return with_sql(
        f"SELECT '{model}' AS model, round({m50}, 6) AS map50, round({m}, 6) AS map50_95, (SELECT round(avg(p), 6) FROM rates) AS mean_precision, (SELECT round(avg(r), 6) FROM rates) AS mean_recall, round(0.1 * {m50} + 0.9 * {m}, 6) AS fitness FROM ap",
        f"{ap}, {rates}", True,
    )


@query(f"SELECT * FROM ({_model_sql('all', _AP, 'true')}) UNION ALL SELECT * FROM ({_model_sql('strict', _AP_STRICT, 'conf >= 0.5')})")
def e17_model_comparison(spark, d):
    """Two models on the same boxes: all predictions, and the sure ones only."""
    pred, gt = _pg(spark, d)
    models = F.explode(F.when(F.col("conf") >= 0.5, F.array(F.lit("all"), F.lit("strict"))).otherwise(F.array(F.lit("all"))))
    rows = evaluate.compare_models(pred.withColumn("model", models), gt)
    return rows.select("model", *(F.round(c, 6).alias(c) for c in ("map50", "map50_95", "mean_precision", "mean_recall", "fitness")))


@query(with_sql("SELECT class_id, round(ap, 6) AS ap50 FROM ap WHERE level = 0.5 AND class_id IN (0, 1)", _AP, True))
def e18_old_class_check(spark, d):
    old = fx.classes(spark).where("class_id < 2").select("class_id")
    return _ap(spark, d, [0.5]).join(F.broadcast(old), "class_id").select("class_id", F.round("ap", 6).alias("ap50"))


@query(with_sql("SELECT image_id, count(pred_idx) AS detections FROM images LEFT JOIN pred USING (image_id) GROUP BY 1"))
def e19_detection_counts(spark, d):
    return evaluate.detection_counts(fx.predictions(spark, d), fx.images(spark, d))


@query(with_sql("SELECT image_id, pred_idx, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, pred_idx)::INT AS rank FROM pred"))
def w1_rank_by_confidence(spark, d):
    return fuse.top_detections(fx.predictions(spark, d), 1 << 30).select("image_id", "pred_idx", "rank")


@query(with_sql("SELECT k, tp, tp + fp AS n FROM curve", _CURVE, True))
def w2_cumulative_counts(spark, d):
    return evaluate.pr_curve(*_pg(spark, d)).select("k", "tp", (F.col("tp") + F.col("fp")).alias("n"))


@query(with_sql("SELECT image_id, pred_idx FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, pred_idx) AS r FROM pred) WHERE r <= 3"))
def w5_top_detections(spark, d):
    return fuse.top_detections(fx.predictions(spark, d), 3).select("image_id", "pred_idx")


_SMALL = ", small AS (SELECT s.image_id, source, idx, class_id, conf FROM (SELECT image_id, 'gt' AS source, box_idx AS idx, class_id, x1, y1, x2, y2, 0.0 AS conf FROM gt UNION ALL SELECT image_id, 'pred', pred_idx, class_id, x1, y1, x2, y2, conf FROM pred) s JOIN images i ON i.image_id = s.image_id WHERE ((x2 - x1) * (y2 - y1)) / (width * height) < 0.01)"
_CASES = _SMALL + ", cases AS (SELECT image_id, outcome AS error_type, class_id, conf::DOUBLE AS conf, CASE WHEN outcome = 'FP' THEN 1.0 - conf ELSE 1.0 END::DOUBLE AS score FROM outs WHERE outcome IN ('FP', 'FN') UNION ALL SELECT image_id, 'small', class_id, conf, 0.8::DOUBLE FROM small)"


def _small(spark, d):
    pred, gt = _pg(spark, d)
    return errors.small_cases(gt, pred, fx.images(spark, d))


def _cases(spark, d):
    return errors.hard_cases(match.outcomes(*_pg(spark, d), near=False), _small(spark, d))


@query(with_sql("SELECT * FROM cases", _TWO + _CASES, True))
def u1_hard_case_union(spark, d):
    return _cases(spark, d)


@query(with_sql("SELECT * FROM small", "x AS (SELECT 1)" + _SMALL))
def u2_small_scan(spark, d):
    return _small(spark, d)


@query(with_sql("SELECT DISTINCT image_id FROM cases", _TWO + _CASES, True))
def u3_distinct_images(spark, d):
    return _cases(spark, d).select("image_id").distinct()


@query(with_sql("SELECT image_id, CASE WHEN image_id % 3 = 0 THEN 'base' ELSE 'extra' END AS source FROM (SELECT image_id FROM images WHERE image_id % 3 = 0 UNION SELECT image_id FROM cases)", _TWO + _CASES, True))
def u4_merged_images(spark, d):
    return errors.merged_images(fx.images(spark, d).where("image_id % 3 = 0"), _cases(spark, d))


@query(with_sql("SELECT error_type, count(*) AS n, round(avg(score), 6) AS avg_score FROM cases GROUP BY 1", _TWO + _CASES, True))
def a6_hard_report(spark, d):
    return errors.hard_report(_cases(spark, d)).select("error_type", "n", F.round("avg_score", 6).alias("avg_score"))


@query(with_sql("SELECT class_id, (max(n) OVER ())::DOUBLE / n AS weight FROM (SELECT class_id, count(*) AS n FROM cases GROUP BY 1)", _TWO + _CASES, True))
def a7_class_weights(spark, d):
    return errors.class_weights(_cases(spark, d), fx.classes(spark))


_PLAN = """, hardest AS (SELECT c.image_id, error_type, max(score) AS score, coalesce(any_value(lap_var) < 100, false) AS blurred FROM cases c LEFT JOIN feats f ON f.image_id = c.image_id GROUP BY 1, 2),
plans AS (SELECT image_id, error_type, CASE WHEN score < 0.5 THEN 0 WHEN score < 0.7 THEN 2 WHEN score < 0.9 THEN 3 ELSE 4 END AS n,
  CASE error_type WHEN 'FP' THEN CASE WHEN blurred THEN ['blur', 'bright_7', 'bright_13', 'noise'] ELSE ['bright_7', 'bright_13', 'noise'] END
    WHEN 'FN' THEN ['scale_8', 'scale_12', 'bright_7', 'bright_13', 'noise'] ELSE CASE WHEN blurred THEN ['scaleup_12', 'scaleup_15', 'blur', 'noise'] ELSE ['scaleup_12', 'scaleup_15', 'noise'] END END AS v FROM hardest)"""


@query(with_sql("SELECT image_id, error_type, unnest(v[1:n]) AS variant FROM plans WHERE n > 0", _TWO + _CASES + _PLAN, True))
def m4_variant_plan(spark, d):
    return errors.variant_plan(_cases(spark, d), fx.features(spark, d))


@query(with_sql("SELECT image_id, max(CASE WHEN score <= 0.5 THEN 1 WHEN score < 0.7 THEN 2 WHEN score < 0.9 THEN 3 ELSE 5 END)::BIGINT AS copies, max(score) AS score, count(*) AS n FROM cases GROUP BY 1", _TWO + _CASES, True))
def m5_strategies(spark, d):
    return errors.strategies(_cases(spark, d))


@query(with_sql("SELECT image_id, max(copies)::BIGINT AS copies FROM g JOIN (SELECT class_id, ceil(goal / n) AS copies FROM (SELECT class_id, count(*) AS n, max(count(*)) OVER () * 0.5 AS goal FROM g GROUP BY 1) WHERE n < goal) USING (class_id) GROUP BY 1", "g AS (SELECT * FROM gt WHERE class_id <> 2 OR image_id % 4 = 0)"))
def m6_minority_copies(spark, d):
    return errors.minority_copies(fx.ground_truth(spark, d).where("class_id <> 2 OR image_id % 4 = 0"))


@query()
def f1_wbf(spark, d):
    rows = fx.predictions(spark, d).where("conf > 0").select("image_id", "class_id", F.col("pred_idx").alias("det_idx"), F.col("conf").alias("score"), "x1", "y1", "x2", "y2")
    return fuse.wbf(rows)


@query()
def f2_tta_fuse(spark, d):
    return fuse.tta_fuse(fx.views(spark, d), fx.images(spark, d))


@query(with_sql("SELECT image_id, class_id, pred_idx, conf, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2 FROM walk WHERE hit", f"""rankd AS (SELECT *, row_number() OVER (PARTITION BY image_id, class_id ORDER BY conf DESC, pred_idx) AS rn FROM pred),
walk AS (SELECT r.image_id, r.class_id, r.pred_idx, r.conf, r.x1, r.y1, r.x2, r.y2, r.rn, true AS hit, [{{'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}}] AS kept FROM rankd r WHERE rn = 1
  UNION ALL SELECT e.image_id, e.class_id, e.pred_idx, e.conf, e.x1, e.y1, e.x2, e.y2, e.rn, len([k FOR k IN w.kept IF {sql_iou('k', 'e')} > 0.5]) = 0,
    CASE WHEN len([k FOR k IN w.kept IF {sql_iou('k', 'e')} > 0.5]) = 0 THEN list_append(w.kept, {{'x1': e.x1, 'y1': e.y1, 'x2': e.x2, 'y2': e.y2}}) ELSE w.kept END
  FROM walk w JOIN rankd e ON e.image_id = w.image_id AND e.class_id = w.class_id AND e.rn = w.rn + 1)""", True))
def f3_nms(spark, d):
    return fuse.nms(fx.predictions(spark, d))
