"""Exact de-duplication by skew-safe combining, with DataFrame functions only.

Texts are equal when they are identical after each run of ASCII white space has become one space. Three steps, each
of which groups by digest, so that fingerprints travel and texts of their own stay where they are read:

1. local: map-side aggregation leaves one row a digest, salt and task;
2. salted: a digest's rows meet in ``salts`` groups, so copies that make up a third of the corpus are spread;
3. global: the at most ``salts`` winners of a digest meet and give the row that stays and the group's size.

Only a text whose digest another row has can be a copy: these, and they alone, are compared as a whole, each with one text
of its digest. Where they differ, a digest stands for several texts: its rows are combined once more by digest *and* whole
content. The answer goes back to every row over (digest, salt), which no hot text can overload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxspark.llm.common import SPACE, stage


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None, digest_bytes: int = 32
) -> DataFrame:
    """One row a row of ``docs``: id, keep_id, group_size, kept, text_sha256. ``salts``: by default one a shuffle
    partition, so that copies of one text can use every task.

    A null text counts as empty and empty texts are one group. The smallest id of a group stays; rows that repeat it
    all count as kept. A null id counts in group_size, is never the smallest, and is kept only if its whole group has
    null ids. An empty table gives an empty result; other columns are not read. ``digest_bytes`` shortens the digest
    that groups rows (tests use it to force collisions), never text_sha256.
    """
    salts = salts or max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    norm = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), norm.alias("_norm")).withColumn("_sha", F.sha2(F.col("_norm").cast("binary"), 256))
    digest = F.unhex(F.substring("_sha", 1, 2 * digest_bytes))
    salt = F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int")
    keyed = rows.select("_id", "_norm", "_sha", digest.alias("_digest"), salt.alias("_salt"))

    own = Window.partitionBy("_digest")
    prints = stage(keyed.drop("_norm"), "exact-prints")
    salted = prints.groupBy("_digest", "_salt").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n"))
    winners = salted.repartition("_digest").withColumns({"keep_id": F.min("_least").over(own), "group_size": F.sum("_n").over(own)})
    winners = stage(winners.select("_digest", "_salt", "keep_id", "group_size"), "exact-winners")
    texts, several = _several(keyed, winners.where("group_size > 1"))
    answer = prints.join(winners, ["_digest", "_salt"])
    if not several.isEmpty():
        answer = answer.join(several, "_digest", "left_anti").select("_id", "_sha", "keep_id", "group_size")
        answer = answer.unionByName(_by_content(texts.join(several, "_digest")))
    return answer.select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_sha").alias("text_sha256")
    )


def _several(keyed: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``keyed`` that may share their digest, staged with their texts, and the digests of ``shared`` (_digest,
    _salt, keep_id: digests of more than one row) that stand for several texts.

    Shared digests set bits of a broadcast map of 2^24 bits, 4 MB at most: texts without a bit stay where they are read, and a
    bit that another digest has set too costs the move of a text. A text of the row that stays goes to each salt once."""
    place = F.xxhash64("_digest").bitwiseAND((1 << 24) - 1)
    places = {"_word": F.shiftright(place, 6), "_bit": place.bitwiseAND(63).cast("int")}
    marks = shared.select("_digest").withColumns(places).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))
    texts = keyed.withColumns(places).join(F.broadcast(marks), "_word").where("(shiftrightunsigned(_bits, _bit) & 1) = 1")
    texts = stage(texts.select(*keyed.columns), "exact-texts")
    first = texts.join(shared, ["_digest", "_salt"]).where("_id <=> keep_id").groupBy("_digest").agg(F.min("_norm").alias("_first"))
    first = stage(shared.select("_digest", "_salt").join(first, "_digest"), "exact-first")
    differ = texts.join(first, ["_digest", "_salt"]).where("_norm <> _first").select("_digest").distinct()
    return texts, stage(differ, "exact-several")


def _by_content(keyed: DataFrame) -> DataFrame:
    """_id, _sha, keep_id, group_size of rows (_id, _norm, _sha, _digest, _salt) whose digest stands for several texts."""
    text = Window.partitionBy("_digest", "_norm")
    salted = keyed.groupBy("_digest", "_salt", "_norm").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n"))
    winners = salted.withColumns({"keep_id": F.min("_least").over(text), "group_size": F.sum("_n").over(text)})
    winners = stage(winners.select("_digest", "_salt", "_norm", "keep_id", "group_size"), "exact-collided")
    return keyed.join(winners, ["_digest", "_salt", "_norm"]).select("_id", "_sha", "keep_id", "group_size")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows that repeat a kept id stay with it; a null text is an
    empty one, a null id stays only where its whole group has null ids; an empty table gives an empty one."""
    kept = exact_groups(docs, id_col, text_col, **how).where("kept").select(F.col(id_col).alias("_kept")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept"]), "left_semi")
