"""COCO and VOC annotations, class tables, images, prediction and tuning files, report sinks."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxspark.sources.labels import stem_of

COCO = (
    "images array<struct<id:bigint,file_name:string,width:int,height:int>>, "
    "annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>>>, categories array<struct<id:bigint,name:string>>"
)
VOC = "filename string, size struct<width:int,height:int>, object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"
PREDICTIONS = "image string, boxes array<array<double>>"


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories). One document is one task: what it explodes to is dealt out again."""
    doc = spark.read.schema(COCO).json(path, multiLine=True)
    images = doc.select(F.explode("images").alias("x")).select(F.col("x.id").alias("image_id"), "x.file_name", "x.width", "x.height")
    annotations = doc.select(F.explode("annotations").alias("x")).select(F.col("x.id").alias("ann_id"), "x.image_id", "x.category_id", "x.bbox")
    n = spark.sparkContext.defaultParallelism
    return images.repartition(n), annotations.repartition(n), doc.select(F.explode("categories").alias("x")).select(F.col("x.id").alias("category_id"), "x.name")


def read_voc(spark: SparkSession, path: str) -> DataFrame:
    """image_id, width, height, box_idx, name, x1..y2; an image without an object has one row of nulls."""
    docs = spark.read.format("xml").option("rowTag", "annotation").schema(VOC).load(path)
    rows = docs.select(stem_of(F.col("filename")).alias("image_id"), "size.width", "size.height", F.posexplode_outer("object").alias("box_idx", "o"))
    return rows.select("image_id", "width", "height", "box_idx", "o.name", F.col("o.bndbox.xmin").alias("x1"), F.col("o.bndbox.ymin").alias("y1"), F.col("o.bndbox.xmax").alias("x2"), F.col("o.bndbox.ymax").alias("y2"))


def class_rows(config: dict) -> list[tuple[int, str, str | None]]:
    """(id, name, description) of a dataset config: names a list or a mapping, descriptions by id, by name or a list."""
    names = config.get("names") or []
    names = [names[k] for k in sorted(names)] if isinstance(names, dict) else list(names)
    about = config.get("class_descriptions") or {}
    if isinstance(about, list):
        about = dict(enumerate(about))
    return [(i, n, about.get(i, about.get(n))) for i, n in enumerate(names)]


def read_class_table(spark: SparkSession, path: str) -> DataFrame:
    import yaml

    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one small file
    return spark.createDataFrame(class_rows(yaml.safe_load(text) or {}), "class_id int, name string, description string")


def write_dataset_config(config: dict, path: str) -> None:
    import yaml

    Path(path).write_text(yaml.safe_dump(config, sort_keys=False, allow_unicode=True))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, image_id, image of every image under a folder, each once, suffixes in any case; undecodable ones have height -1
    (TIFF files where the Java runtime reads none)."""
    files = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).option("pathGlobFilter", "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[pP][nN][gG],[bB][mM][pP],[tT][iI][fF],[tT][iI][fF][fF]}").load(path)
    return files.select(F.col("image.origin").alias("path"), stem_of(F.col("image.origin")).alias("image_id"), "image")


def associate(images: DataFrame, labels: DataFrame) -> DataFrame:
    """images with the labels of the same split and stem; images without stay, with null labels."""
    return images.join(labels, ["split", "image_id"], "left")


def exploded_predictions(nested: DataFrame) -> DataFrame:
    """image_id, pred_idx, class_id (0 when left out), conf and corners of rows of (image, boxes)."""
    rows = nested.select(F.col("image").alias("image_id"), F.posexplode("boxes").alias("pred_idx", "b"))
    return rows.select("image_id", "pred_idx", F.coalesce(F.get("b", F.lit(5)), F.lit(0.0)).cast("int").alias("class_id"), F.get("b", F.lit(4)).alias("conf"), *(F.get("b", F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return exploded_predictions(spark.read.schema(PREDICTIONS).json(path))


def read_tuning_history(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest run's CSV under a folder, as strings, blank cells null, with ``run_row``, their place in it."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.csv")
    newest = files.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_modification_time").alias("t")).agg(F.max_by("p", F.struct("t", "p"))).first()[0]
    if newest is None:
        raise FileNotFoundError(f"no CSV under {path}")
    rows = spark.read.csv(newest, header=True)
    clean = rows.select(*(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.strip()) for c in rows.columns))
    return clean.withColumn("run_row", F.monotonically_increasing_id())


def write_report(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, nested as they are."""
    rows.write.json(path)


def report_text(rows: DataFrame, title: str, most: int = 20) -> str:
    """A title and the first rows, for people."""
    found = rows.limit(most).collect()
    return "\n".join([title, *(", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in found)])
