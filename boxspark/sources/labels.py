"""Label text files: one file an image, one line a box; the line's place in the file is the box's identity."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Names of files beside labels that are not labels.
NOT_LABELS = "dataset|classes|names"


def stem_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, split (folder), image_id (stem), box_idx, line of every line that is not blank, of files that are labels."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select("value", F.col("_metadata.file_path").alias("path"))
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    parts = F.split("path", "/")
    return _lines(files.where(~name.rlike(NOT_LABELS)).select("path", F.element_at(parts, -2).alias("split"), stem_of(F.col("path")).alias("image_id"), "value"))


def _lines(files: DataFrame) -> DataFrame:
    lines = files.select("path", "split", "image_id", F.posexplode(F.split("value", "\r?\n")).alias("box_idx", "line"))
    return lines.where(F.trim("line") != "")


def read_label_table(spark: SparkSession, path: str) -> DataFrame:
    """The lines of what ``write_label_table`` wrote, as ``read_label_lines`` gives them."""
    rows = spark.read.parquet(path)
    return _lines(rows.select(F.concat_ws("/", "split", "image_id").alias("path"), "split", "image_id", F.col("text").alias("value")))


def parse_label_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, rejects). A line is class, four numbers and perhaps a confidence (1.0 without one); lines of fewer
    fields or with text where a number belongs are rejects, with ``_reason``."""
    fields = F.split(F.trim("line"), r"\s+")
    number = lambda i, kind: F.expr(f"try_cast(get(f, {i}) AS {kind})")
    rows = lines.withColumn("f", fields).select(
        "image_id", "split", "box_idx", "line", number(0, "int").alias("class_id"), *(number(i, "double").alias(c) for i, c in enumerate(("cx", "cy", "w", "h"), 1)),
        F.coalesce(number(5, "double"), F.lit(1.0)).alias("conf"), F.size("f").alias("n"),
    )
    missing = F.col("class_id").isNull() | F.col("cx").isNull() | F.col("cy").isNull() | F.col("w").isNull() | F.col("h").isNull()
    reason = F.when(F.col("n") < 5, "too few fields").when(missing, "not a number")
    rows = rows.withColumn("_reason", reason)
    return rows.where("_reason IS NULL").drop("line", "n", "_reason"), rows.where("_reason IS NOT NULL").select("image_id", "split", "box_idx", "line", "_reason")


def label_text(labels: DataFrame, with_conf: bool = False) -> DataFrame:
    """image_id, split (null where labels have none), text: the file of each image, lines in box order."""
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", "cx", "cy", "w", "h")
    if with_conf:
        line = F.concat(line, F.format_string(" %.4f", "conf"))
    split = F.col("split") if "split" in labels.columns else F.lit(None).cast("string")
    lines = F.array_sort(F.collect_list(F.struct("box_idx", line.alias("line"))))
    files = labels.withColumn("split", split).groupBy("image_id", "split").agg(lines.alias("lines"))
    return files.select("image_id", "split", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))


def write_label_table(labels: DataFrame, path: str, with_conf: bool = False) -> None:
    """A Parquet table with a row an image: image_id, split, text. For many images; ``read_label_table`` reads it."""
    label_text(labels, with_conf).write.parquet(path)


def write_label_files(labels: DataFrame, folder: str, with_conf: bool = False) -> None:
    """A file ``{split}/{image_id}.txt`` an image (without a split: in the folder), which ``read_label_lines`` reads.

    Tasks write them, so ``folder`` is one that all executors mount. A file appears under its name only when it is
    whole, and a task that runs again writes the same."""

    def write(rows: Iterator[Row]) -> None:
        for r in rows:
            own = Path(folder, r.split) if r.split is not None else Path(folder)
            own.mkdir(parents=True, exist_ok=True)
            part = own / f".{r.image_id}.{os.getpid()}.part"
            part.write_text(r.text, encoding="utf-8")
            part.replace(own / f"{r.image_id}.txt")

    label_text(labels, with_conf).foreachPartition(write)
