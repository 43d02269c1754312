"""Analysis of tuning histories (CSV-like tables of strings)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numeric(history: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    """id, name, value (null where the text is no number) of each row and column."""
    texts = history.select(id_col, *(F.col(c).cast("string").alias(c) for c in columns))
    return texts.unpivot(id_col, columns, "name", "text").select(id_col, "name", F.expr("try_cast(nullif(trim(text), '') AS double)").alias("value"))


def metric_summary(history: DataFrame, metrics: list[str], id_col: str) -> DataFrame:
    """name, mean, least, most, std (sample; 0 for fewer than two)."""
    v = F.col("value")
    return numeric(history, metrics, id_col).groupBy("name").agg(
        F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.count(v).alias("n")
    )


def parameter_importance(history: DataFrame, parameters: list[str], fitness: str, id_col: str, by: tuple[str, ...] = ()) -> DataFrame:
    """name, correlation with fitness of parameters that are numbers in every row; 0 without variance. One grouping
    serves all parameters. With ``by`` columns each of their groups is a history of its own."""
    target = F.expr(f"try_cast({fitness} AS double)").alias("_fitness")
    texts = history.select(*by, target, *(F.col(c).cast("string").alias(c) for c in parameters)).unpivot([*by, "_fitness"], parameters, "name", "text")
    rows = texts.withColumn("value", F.expr("try_cast(nullif(trim(text), '') AS double)"))
    stats = rows.groupBy(*by, "name").agg(F.corr("value", "_fitness").alias("r"), F.count("value").alias("n"), F.count(F.lit(1)).alias("all"), F.stddev_pop("value").alias("s"))
    r = F.when(F.col("s") > 0, F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    return stats.where(F.col("n") == F.col("all")).select(*by, "name", F.round(r, 4).alias("importance"))


def top_runs(history: DataFrame, fitness: str, id_col: str, n: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """The n rows of best fitness, equal ones by id, ranked; of each group of the ``by`` columns, if there are any."""
    rows = history.withColumn("_f", F.expr(f"try_cast({fitness} AS double)")).where("_f IS NOT NULL")
    if by:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_f"), id_col))
        return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).select(*by, F.col("_rank").alias("rank"), id_col, F.col("_f").alias("fitness"))
    best = rows.orderBy(F.desc("_f"), id_col).limit(n)
    packed = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("_f")).alias("o"), F.col(id_col).alias("id")))).alias("a"))  # n rows
    return packed.select(F.posexplode("a").alias("p", "x")).select((F.col("p") + 1).alias("rank"), F.col("x.id").alias(id_col), (-F.col("x.o")).alias("fitness"))


def last_and_best(history: DataFrame, fitness: str, id_col: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The last and the best row of the history, or of each group of the ``by`` columns."""
    f = F.expr(f"try_cast({fitness} AS double)")
    return history.groupBy(*by).agg(F.max(id_col).alias("last_id"), F.max_by(f, F.col(id_col)).alias("last_fitness"), F.max(f).alias("best_fitness"), F.min_by(F.col(id_col), F.struct(-f, F.col(id_col))).alias("best_id"))
