"""Samples by hash of a key and a seed: the same rows whatever the partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def order(key: str, seed: int):
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def stratified(rows: DataFrame, by: str, key: str, target: int, seed: int = 1) -> DataFrame:
    """About target rows, from each stratum its share, one at least. Shares round half to even."""
    size = rows.groupBy(by).agg(F.count("*").alias("n"))
    need = size.crossJoin(F.broadcast(rows.agg(F.count("*").alias("all")))).select(by, F.greatest(F.lit(1), F.bround(F.col("n") / F.col("all") * target, 0).cast("int")).alias("need"))
    # no stratum needs more than target, so each task keeps that many before the shuffle
    x = rows.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(order(key, seed), key))).filter(F.col("rn") <= max(1, target))
    return x.join(need, by).filter(F.col("rn") <= F.col("need")).drop("rn", "need")


def per_stratum(rows: DataFrame, by: str, key: str, n: int, seed: int = 1) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(order(key, seed), key))).filter(F.col("rn") <= n).drop("rn")


def first_n(rows: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    return rows.orderBy(order(key, seed), key).limit(n)


def top(rows: DataFrame, by: str, measure: str, n: int, key: str) -> DataFrame:
    """The n rows of each group with the highest measure; ties by key."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(measure), key))).filter(F.col("rank") <= n)


def average_rank(rows: DataFrame, measure: str, name: str = "rank", by: list[str] | None = None, descending: bool = False) -> DataFrame:
    """Ranks from 1 with ties at their mean; null stays null."""
    by = by or []
    w = Window.partitionBy(*by, F.col(measure).isNull()).orderBy(F.desc(measure) if descending else F.asc(measure))
    same = Window.partitionBy(*by, measure)
    return rows.withColumn(name, F.when(F.col(measure).isNotNull(), F.rank().over(w) + (F.count("*").over(same) - 1) / 2))


def least_rank(rows: DataFrame, measure: str, name: str = "rank") -> DataFrame:
    """Ranks from the highest down with ties at their best; null stays null. Only the distinct values with their counts are ordered together."""
    values = rows.filter(F.col(measure).isNotNull()).groupBy(measure).agg(F.count("*").alias("_n"))
    above = F.sum("_n").over(Window.orderBy(F.desc(measure)).rowsBetween(Window.unboundedPreceding, -1))
    ranks = values.select(measure, (F.coalesce(above, F.lit(0)) + 1).cast("int").alias(name))
    return rows.join(ranks, measure, "left").select(*rows.columns, name)
