"""Joins that turn annotations of other formats into labels, and merges of class vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxspark.functions.geometry import from_xywh


def coco_labels(annotations: DataFrame, images: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """image_id, ann_id, class_id (category - 1), cx, cy, w, h; with ``existing``, only of images that are there."""
    if existing is not None:
        annotations = annotations.join(existing.select("image_id"), "image_id", "left_semi")
    joined = annotations.join(images.select("image_id", "width", "height"), "image_id")
    cx, cy, w, h = from_xywh(*(F.col("bbox")[i] for i in range(4)), F.col("width"), F.col("height"))
    return joined.select("image_id", "ann_id", (F.col("category_id") - 1).alias("class_id"), cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"))


def known_classes(objects: DataFrame, classes: DataFrame) -> DataFrame:
    """Objects whose name is a class, with its id."""
    return objects.join(F.broadcast(classes.select("name", "class_id")), "name")


def with_labels(images: DataFrame, labels: DataFrame) -> DataFrame:
    """image_id, n_labels of every image."""
    n = labels.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_labels"))
    return images.select("image_id").join(n, "image_id", "left").select("image_id", F.coalesce("n_labels", F.lit(0).cast("bigint")).alias("n_labels"))


def merged_vocabulary(old: DataFrame, new: DataFrame) -> DataFrame:
    """class_id, name, old_id, source: old classes keep their ids, new ones follow in their order, repeats included."""
    n = old.agg((F.coalesce(F.max("class_id"), F.lit(-1)) + 1).alias("_n"))
    kept = old.select("class_id", "name", F.col("class_id").alias("old_id"), F.lit("old").alias("source"))
    added = new.crossJoin(F.broadcast(n)).select((F.col("class_id") + F.col("_n")).alias("class_id"), "name", F.col("class_id").alias("old_id"), F.lit("new").alias("source"))  # one row
    return kept.unionByName(added)


def relabelled(labels: DataFrame, vocabulary: DataFrame, source: str) -> DataFrame:
    to = vocabulary.where(F.col("source") == source).select(F.col("old_id").alias("class_id"), F.col("class_id").alias("_to"))
    return labels.join(F.broadcast(to), "class_id").drop("class_id").withColumnRenamed("_to", "class_id")


def image_differences(labels: DataFrame, images: DataFrame) -> DataFrame:
    """image_id, issue of images without labels and labels without image. Ids of either side are grouped once, without a join."""
    both = images.select("image_id", F.lit(True).alias("image")).unionByName(labels.select("image_id", F.lit(False).alias("image")))
    sides = both.groupBy("image_id").agg(F.max("image").alias("image"), F.max(~F.col("image")).alias("label"))
    lone = lambda own, other, issue: F.when(F.col(own) & (~F.col(other) | F.col("image_id").isNull()), issue)  # noqa: E731  (a null id equals none)
    return sides.select("image_id", F.explode(F.array_compact(F.array(lone("image", "label", "label_file_missing"), lone("label", "image", "no_image_found")))).alias("issue"))
