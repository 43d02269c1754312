"""Detection tables derived from the driver's tables, and the same derivation as SQL.

Coordinates are whole pixels, so an IoU is one division of exact integers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxspark.functions.geometry import box, to_cxcywh

CLASSES = [(0, "c0"), (1, "c1"), (2, "c2"), (3, "c3")]
ANCHORS = [(0.3, 0.3, 0.1, 0.1), (0.5, 0.5, 0.2, 0.3), (0.5, 0.4, 0.4, 0.2), (0.6, 0.6, 0.35, 0.45)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("image_id"), F.lit(640).cast("bigint").alias("width"), F.when(F.col("o_orderkey") % 2 == 0, 640).otherwise(480).cast("bigint").alias("height")
    )


def classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLASSES, "class_id bigint, name string")


def _base(spark: SparkSession, sf_dir: str, made: str) -> DataFrame:
    """Rows of lineitem with ``made``, an array, and first_idx, the place of its first item in its image. Rows are shuffled and
    sorted once, by what the derivation reads: rows alike in all of that give equal items, whichever comes first."""
    order = Window.partitionBy("image_id").orderBy("l_linenumber", "pk", "sk", "l_quantity", "l_extendedprice").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS image_id", "l_linenumber", "l_partkey AS pk", "l_suppkey AS sk", "l_quantity", "l_extendedprice")
    rows = rows.withColumn("first_idx", F.coalesce(F.sum(F.expr(f"size({made})")).over(order), F.lit(0)).cast("bigint")).selectExpr(
        "image_id", "first_idx", f"{made} AS made", "pk", "sk", "CAST(round(l_extendedprice * 100) AS BIGINT) AS ep", "sk % 4 AS class_id",
        "CASE WHEN pk % 97 = 0 THEN 632L ELSE 4 + CAST(l_quantity AS BIGINT) * 5 END AS w", "CASE WHEN pk % 97 = 0 THEN 472L ELSE 4 + (pk % 50) * 5 END AS h",
        "CASE WHEN image_id % 2 = 0 THEN 640L ELSE 480L END AS height",
    )
    return rows.selectExpr("*", "(pk * 7919 + sk * 31) % (640 - w) AS x1", "(pk * 104729 + sk * 17) % (height - h) AS y1")


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _base(spark, sf_dir, "CASE WHEN pk % 12 = 0 THEN array(0L, 1L) ELSE array(0L) END")
    return rows.selectExpr("*", "explode(made) AS copy").selectExpr("image_id", "first_idx + copy AS box_idx", "class_id", "x1 + copy AS x1", "y1", "x1 + copy + w AS x2", "y1 + h AS y2")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _base(spark, sf_dir, "filter(array(CASE WHEN pk % 10 < 8 THEN 0 END, CASE WHEN sk % 6 = 0 THEN 1 END, CASE WHEN pk % 9 = 0 THEN 2 END), k -> k IS NOT NULL)")
    of = """CASE kind
        WHEN 0 THEN named_struct('class_id', CASE WHEN pk % 11 = 0 THEN (class_id + 1) % 4 ELSE class_id END, 'conf', (ep % 9973) / 9973.0D,
            'x1', x1 + ((sk % 7) * w) div 20, 'y1', y1 + ((pk % 5) * h) div 20, 'w', w, 'h', h)
        WHEN 1 THEN named_struct('class_id', (class_id + 2) % 4, 'conf', (ep % 4999) / 9973.0D,
            'x1', (x1 * 3) % 500, 'y1', (y1 * 5) % 400, 'w', w div 2 + 4, 'h', h div 2 + 4)
        ELSE named_struct('class_id', class_id, 'conf', ((ep * 7 + sk) % 9973) / 9973.0D,
            'x1', x1 + ((sk % 5) * w) div 25, 'y1', y1, 'w', w, 'h', h) END AS k"""
    rows = rows.selectExpr("*", "posexplode(made) AS (at, kind)").selectExpr("image_id", "first_idx + at AS pred_idx", of).select("image_id", "pred_idx", "k.*")
    return rows.selectExpr("image_id", "pred_idx", "class_id", "conf", "x1", "y1", "x1 + w AS x2", "y1 + h AS y2")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = ground_truth(spark, sf_dir).join(images(spark, sf_dir), "image_id")
    cx, cy, w, h = to_cxcywh(box(), F.col("width"), F.col("height"))
    return sized.select("image_id", "box_idx", "class_id", cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image features by formula: one image in fifty is missing."""
    return images(spark, sf_dir).where("image_id % 50 <> 0").selectExpr("image_id", "CAST((image_id * 37) % 200 AS DOUBLE) AS lap_var")


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections on scaled and mirrored views."""
    rows = predictions(spark, sf_dir).where("conf >= 0.25").selectExpr("*", "explode(sequence(0, 5)) AS view").where("(image_id + pred_idx + view) % 7 <> 0")
    rows = rows.selectExpr("*", "element_at(array(0.8D, 1.0D, 1.2D), CAST(view div 2 + 1 AS INT)) AS scale", "view % 2 = 1 AS flipped", "(pred_idx * 3 + view) % 5 AS move")
    rows = rows.selectExpr("*", "(x1 + move) * scale AS a1", "(x2 + move) * scale AS a2", "CAST(640 * scale AS INT) AS mirror")
    return rows.selectExpr(
        "image_id", "class_id", "pred_idx * 6 + view AS det_idx", "conf AS score", "scale", "flipped",
        "CASE WHEN flipped THEN mirror - a2 ELSE a1 END AS x1", "y1 * scale AS y1", "CASE WHEN flipped THEN mirror - a1 ELSE a2 END AS x2", "y2 * scale AS y2",
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, content: the labels of each image as an annotation response; fenced, bare, inside prose, or garbage."""
    one = F.struct(F.col("class_id").cast("int").alias("class_id"), F.array("cx", "cy", "w", "h").alias("bbox"), (F.col("box_idx") % 10 / 10.0).alias("confidence"))
    item = F.struct("box_idx", one.alias("a"))
    rows = labels(spark, sf_dir).groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["a"]).alias("annotations"))
    text = F.to_json(F.struct("annotations"))
    kind = F.col("image_id") % 4
    content = F.when(kind == 0, F.concat(F.lit("```json\n"), text, F.lit("\n```"))).when(kind == 1, text).when(kind == 2, F.concat(F.lit("Here it is: "), text, F.lit(" Done."))).otherwise("no boxes here")
    return rows.select("image_id", content.alias("content"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tuning run of supplier 1 or 2: strings, one row a line, some cells blank in the second."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    return table(spark, sf_dir, "lineitem").withColumn("row", F.row_number().over(order).cast("bigint")).selectExpr(
        "l_suppkey AS run", "row", "CAST(l_discount AS STRING) AS lr0", "CASE WHEN l_linenumber = 7 AND l_suppkey % 2 = 0 THEN ' ' ELSE CAST(l_tax AS STRING) END AS momentum",
        "CAST(l_quantity AS STRING) AS box", "CAST(l_extendedprice / 100000.0D AS STRING) AS fitness",
    )


#: The same tables as common table expressions.
SQL = """
images AS MATERIALIZED (SELECT o_orderkey AS image_id, 640::BIGINT AS width, (CASE WHEN o_orderkey % 2 = 0 THEN 640 ELSE 480 END)::BIGINT AS height FROM orders),
classes AS (SELECT * FROM (VALUES (0::BIGINT, 'c0'), (1::BIGINT, 'c1'), (2::BIGINT, 'c2'), (3::BIGINT, 'c3')) t(class_id, name)),
base0 AS MATERIALIZED (SELECT l_orderkey AS image_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS li_idx,
  l_partkey AS pk, l_suppkey AS sk, CAST(round(l_extendedprice * 100) AS BIGINT) AS ep, l_suppkey % 4 AS class_id,
  CASE WHEN l_partkey % 97 = 0 THEN 632 ELSE 4 + CAST(l_quantity AS BIGINT) * 5 END AS w, CASE WHEN l_partkey % 97 = 0 THEN 472 ELSE 4 + (l_partkey % 50) * 5 END AS h,
  CASE WHEN l_orderkey % 2 = 0 THEN 640 ELSE 480 END AS height FROM lineitem),
base AS (SELECT *, (pk * 7919 + sk * 31) % (640 - w) AS x1, (pk * 104729 + sk * 17) % (height - h) AS y1 FROM base0),
gt0 AS (SELECT *, 0 AS copy FROM base UNION ALL SELECT *, 1 AS copy FROM base WHERE pk % 12 = 0),
gt AS MATERIALIZED (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY li_idx, copy) - 1 AS box_idx, class_id, x1 + copy AS x1, y1, x1 + copy + w AS x2, y1 + h AS y2 FROM gt0),
pred0 AS (
  SELECT image_id, li_idx, 0 AS kind, CASE WHEN pk % 11 = 0 THEN (class_id + 1) % 4 ELSE class_id END AS class_id, (ep % 9973) / 9973.0::DOUBLE AS conf, x1 + ((sk % 7) * w) // 20 AS x1, y1 + ((pk % 5) * h) // 20 AS y1, w, h FROM base WHERE pk % 10 < 8
  UNION ALL SELECT image_id, li_idx, 1, (class_id + 2) % 4, (ep % 4999) / 9973.0::DOUBLE, (x1 * 3) % 500, (y1 * 5) % 400, w // 2 + 4, h // 2 + 4 FROM base WHERE sk % 6 = 0
  UNION ALL SELECT image_id, li_idx, 2, class_id, ((ep * 7 + sk) % 9973) / 9973.0::DOUBLE, x1 + ((sk % 5) * w) // 25, y1, w, h FROM base WHERE pk % 9 = 0),
pred AS MATERIALIZED (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY li_idx, kind) - 1 AS pred_idx, class_id, conf, x1, y1, x1 + w AS x2, y1 + h AS y2 FROM pred0),
lab AS (SELECT image_id, box_idx, class_id, (x1 + x2) / 2.0::DOUBLE / width AS cx, (y1 + y2) / 2.0::DOUBLE / height AS cy, (x2 - x1) / width AS w, (y2 - y1) / height AS h FROM gt JOIN images USING (image_id)),
feats AS (SELECT image_id, CAST((image_id * 37) % 200 AS DOUBLE) AS lap_var FROM images WHERE image_id % 50 <> 0),
views0 AS (SELECT *, [0.8::DOUBLE, 1.0::DOUBLE, 1.2::DOUBLE][v // 2 + 1] AS scale, v % 2 = 1 AS flipped, (pred_idx * 3 + v) % 5 AS move FROM pred, range(6) r(v) WHERE conf >= 0.25 AND (image_id + pred_idx + v) % 7 <> 0),
views1 AS (SELECT *, (x1 + move) * scale AS a1, (x2 + move) * scale AS a2, CAST(trunc(640 * scale) AS INT) AS mirror FROM views0),
views AS (SELECT image_id, class_id, pred_idx * 6 + v AS det_idx, conf AS score, scale, flipped, CASE WHEN flipped THEN mirror - a2 ELSE a1 END AS x1, y1 * scale AS y1, CASE WHEN flipped THEN mirror - a1 ELSE a2 END AS x2, y2 * scale AS y2 FROM views1)
"""


def sql_iou(a: str, b: str) -> str:
    inter = f"greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0)"
    union = f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - {inter})"
    return f"(CASE WHEN {union} > 0 THEN ({inter}) / {union} ELSE 0.0 END)"


def with_sql(body: str, more: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{SQL.strip()}{', ' + more if more else ''} {body}"


def sql_match(conf_t: float, iou_t: float | None, order: str = "conf", near: bool = False, prefix: str = "", level: bool = False) -> str:
    """CTEs ``<prefix>edges`` and ``<prefix>found``: greedy matching by one recursive step an edge."""
    least = f"iou >= {iou_t}" if not near else "iou > 0"
    first = "conf DESC, " if order == "conf" else ""
    levels, col, part = ("", "", "") if not level else (", (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])::DOUBLE AS level) l", "level, ", "level, ")
    least = "iou >= level" if level else least
    tp = "e.iou >= e.level" if level else f"e.iou >= {iou_t}"
    same = "f.image_id = e.image_id AND f.class_id = e.class_id" + (" AND f.level = e.level" if level else "")
    ecol = "e.level, " if level else ""
    return f"""
{prefix}raw AS (SELECT p.image_id, p.class_id, p.pred_idx, g.box_idx, p.conf, {sql_iou('p', 'g')} AS iou FROM pred p JOIN gt g ON p.image_id = g.image_id AND p.class_id = g.class_id WHERE p.conf >= {conf_t}),
{prefix}edges AS (SELECT {col}image_id, class_id, pred_idx, box_idx, conf, iou, row_number() OVER (PARTITION BY {part}image_id, class_id ORDER BY {first}pred_idx, iou DESC, box_idx) AS rn FROM {prefix}raw{levels} WHERE iou > 0 AND {least}),
{prefix}fold AS (
  SELECT {ecol}e.image_id, e.class_id, e.rn, e.pred_idx, e.box_idx, e.iou, true AS hit, {tp} AS tp, [e.pred_idx] AS ps, CASE WHEN {tp} THEN [e.box_idx] ELSE [] END AS bs FROM {prefix}edges e WHERE e.rn = 1
  UNION ALL
  SELECT {ecol}e.image_id, e.class_id, e.rn, e.pred_idx, e.box_idx, e.iou, NOT (list_contains(f.ps, e.pred_idx) OR list_contains(f.bs, e.box_idx)), {tp},
    CASE WHEN list_contains(f.ps, e.pred_idx) OR list_contains(f.bs, e.box_idx) THEN f.ps ELSE list_append(f.ps, e.pred_idx) END,
    CASE WHEN list_contains(f.ps, e.pred_idx) OR list_contains(f.bs, e.box_idx) OR NOT ({tp}) THEN f.bs ELSE list_append(f.bs, e.box_idx) END
  FROM {prefix}fold f JOIN {prefix}edges e ON {same} AND e.rn = f.rn + 1),
{prefix}found AS (SELECT {col}image_id, class_id, pred_idx, box_idx, iou, tp FROM {prefix}fold WHERE hit)"""


def sql_outcomes(conf_t: float = 0.25, iou_t: float = 0.5, order: str = "conf", near: bool = True, prefix: str = "") -> str:
    """``sql_match`` and ``<prefix>outs``, as match.outcomes gives."""
    return sql_match(conf_t, iou_t, order, near, prefix) + f""",
{prefix}outs AS (
  SELECT p.image_id, CASE WHEN f.tp THEN 'correct' WHEN f.tp IS NOT NULL THEN 'loc' ELSE 'FP' END AS outcome, p.class_id, p.pred_idx, CASE WHEN f.tp THEN f.box_idx END AS box_idx, p.conf, coalesce(f.iou, 0.0) AS iou
  FROM pred p LEFT JOIN {prefix}found f ON p.image_id = f.image_id AND p.pred_idx = f.pred_idx WHERE p.conf >= {conf_t}
  UNION ALL
  SELECT g.image_id, 'FN', g.class_id, NULL, g.box_idx, 0.0, 0.0 FROM gt g WHERE g.image_id IN (SELECT image_id FROM pred)
    AND NOT EXISTS (SELECT 1 FROM {prefix}found f WHERE f.tp AND f.image_id = g.image_id AND f.box_idx = g.box_idx))"""
