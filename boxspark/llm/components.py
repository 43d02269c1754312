"""Connected components of an edge table, as joins and groupings with staged rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxspark.llm.common import stage


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (src, dst) reaches.

    Large-star and small-star rounds: every node's larger, then smaller neighbours are tied to its least neighbour,
    until all edges point at the least node of their component. Nodes without an edge do not appear; null ends and
    loops are ignored. Each round is staged; the driver sees one count a round.
    """
    edges = stage(
        edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
        .select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct(), f"{name}-edges",
    )
    for _ in range(most_rounds):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        )
        after = stage(small, f"{name}-round")
        check = after.groupBy().agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        was = edges.groupBy().agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        edges = after
        if check == was:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
