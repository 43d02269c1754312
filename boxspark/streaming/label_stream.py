"""Label files that keep arriving: the same parsing and checks on a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxspark.sources.labels import parse_label_lines, stem_of


def stream_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of label files as they appear under ``path``, with their place in their file."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.txt").load(path).select("value", F.col("_metadata.file_path").alias("path"))
    lines = files.select("path", F.posexplode(F.split("value", "\r?\n")).alias("box_idx", "line")).where(F.trim("line") != "")
    return lines.select("path", F.element_at(F.split("path", "/"), -2).alias("split"), stem_of(F.col("path")).alias("image_id"), "box_idx", "line")


def class_counts(lines: DataFrame) -> DataFrame:
    """Running number of boxes a class; write in complete or update mode."""
    labels, _ = parse_label_lines(lines)
    return labels.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
