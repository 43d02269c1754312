"""Parsing of annotation responses: fenced, bare or wrapped JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANNOTATION = "struct<class:string,class_id:int,bbox:array<double>,bboxes:array<double>,coordinates:array<double>,confidence:double>"
RESPONSE = f"struct<width:int,height:int,classes:array<string>,annotations:array<{ANNOTATION}>>"


def json_text(content: Column) -> Column:
    """The json fence, else any fence, else from the first brace to the last; null where there is none."""
    got = lambda pattern: F.nullif(F.regexp_extract(content, pattern, 1), F.lit(""))
    return F.coalesce(got(r"(?s)```json\s*(.*?)```"), got(r"(?s)```\s*(.*?)```"), got(r"(?s)(\{.*\})"))


def parsed(responses: DataFrame, content_col: str = "content") -> DataFrame:
    """responses with ``response`` (null where nothing parses) and ``ok``."""
    out = responses.withColumn("response", F.from_json(json_text(F.col(content_col)), RESPONSE))
    return out.withColumn("ok", F.col("response.annotations").isNotNull())


def annotations(parsed_responses: DataFrame, classes: DataFrame | None = None, least: float = 0.25) -> DataFrame:
    """image_id, ann_idx, class_id, cx, cy, w, h, conf of annotations with four numbers and enough confidence. A known
    class name gives the id, else class_id (0 when absent)."""
    rows = parsed_responses.where("ok").select("image_id", F.posexplode("response.annotations").alias("ann_idx", "a"))
    some = lambda c: F.when(F.size(F.col(c)) > 0, F.col(c))
    rows = rows.select("image_id", "ann_idx", F.coalesce(some("a.bbox"), some("a.bboxes"), some("a.coordinates")).alias("b"), F.coalesce("a.confidence", F.lit(1.0)).alias("conf"), F.col("a.class").alias("name"), F.coalesce("a.class_id", F.lit(0)).alias("given"))
    rows = rows.where((F.size("b") == 4) & (F.col("conf") >= least))
    if classes is not None:
        rows = rows.join(F.broadcast(classes.select("name", F.col("class_id").alias("_known"))), "name", "left").withColumn("given", F.coalesce("_known", "given"))
    return rows.select("image_id", "ann_idx", F.col("given").cast("bigint").alias("class_id"), *(F.col("b")[i].alias(c) for i, c in enumerate(("cx", "cy", "w", "h"))), "conf")


def class_prompt(classes: DataFrame) -> DataFrame:
    """One row: a line ``- name: description`` a class, by id."""
    line = F.concat(F.lit("- "), F.col("name"), F.coalesce(F.concat(F.lit(": "), F.col("description")), F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct("class_id", line.alias("line"))))
    return classes.agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("prompt"))


def variant_name(name: Column, i: Column) -> Column:
    """stem_aug<i>.ext"""
    return F.concat(F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.lit("_aug"), i.cast("string"), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def split_once(text: Column, mark: str = ":") -> Column:
    """struct(key, value), both trimmed, of text split at the first mark."""
    parts = F.split(text, mark, 2)
    return F.struct(F.trim(parts[0]).alias("key"), F.trim(F.get(parts, F.lit(1))).alias("value"))
