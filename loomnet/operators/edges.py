"""Directed evidence edges: from labelled pairs (src, tgt, year, label) to yearly and total edges and matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIGNAL = ("collaboration", "co-mention")


def signal(pairs: DataFrame) -> DataFrame:
    """Pairs whose final label says something; a judge's label goes before the majority's."""
    label = F.coalesce("judge_label", "majority_label") if "judge_label" in pairs.columns else F.col("label")
    return pairs.withColumn("label", label).filter(F.col("label").isin(*SIGNAL))


def yearly(pairs: DataFrame) -> DataFrame:
    collab, co = F.count_if(F.col("label") == SIGNAL[0]), F.count_if(F.col("label") == SIGNAL[1])
    e = pairs.filter(F.col("label").isin(*SIGNAL)).groupBy("src", "tgt", "year").agg(collab.alias("collab_evidence"), co.alias("comention_evidence"))
    return e.withColumn("total_evidence", F.col("collab_evidence") + F.col("comention_evidence")).withColumn("has_collaboration", (F.col("collab_evidence") > 0).cast("int"))


def total(years: DataFrame) -> DataFrame:
    """Sums over years, which years, and how many. Works on yearly edges, which are already few."""
    e = years.groupBy("src", "tgt").agg(F.array_join(F.array_sort(F.collect_set(F.col("year").cast("string"))), ";").alias("years_active"), F.count_distinct("year").alias("n_years"), F.sum("collab_evidence").alias("collab_evidence"), F.sum("comention_evidence").alias("comention_evidence"), F.sum("total_evidence").alias("total_evidence"))
    return e.withColumn("has_collaboration", (F.col("collab_evidence") > 0).cast("int"))


def rated(pairs: DataFrame) -> DataFrame:
    """Counts of each label for a pair of ends, and the rate of collaboration."""
    n = lambda x: F.count_if(F.col("label") == x)
    e = pairs.groupBy("src", "tgt").agg(F.count("*").alias("n_articles"), n("collaboration").alias("n_collab"), n("co-mention").alias("n_comention"), n("wrong").alias("n_wrong"), F.count_if(F.col("label").isNull()).alias("n_uncoded"))
    return e.withColumn("rate", F.round(F.col("n_collab") / F.col("n_articles"), 4)).withColumn("has_edge", (F.col("n_collab") > 0).cast("int"))


def year_summary(pairs: DataFrame) -> DataFrame:
    n = lambda x: F.count_if(F.col("label") == x)
    e = pairs.groupBy("year").agg(F.count("*").alias("total"), F.count("label").alias("coded"), n("collaboration").alias("collaboration"), n("co-mention").alias("comention"), n("wrong").alias("wrong"))
    return e.withColumn("uncoded", F.col("total") - F.col("coded")).withColumn("rate", F.coalesce(F.round(F.try_divide("collaboration", "coded"), 4), F.lit(0.0)))


def cells(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every ordered pair of nodes (ord, node) with 0 or 1; the diagonal is 0."""
    grid = nodes.select(F.col("node").alias("src")).crossJoin(nodes.select(F.col("node").alias("tgt")))
    e = edges.select("src", "tgt", F.lit(1).alias("v")).distinct()
    return grid.join(e, ["src", "tgt"], "left").select("src", "tgt", F.when(F.col("src") == F.col("tgt"), 0).otherwise(F.coalesce("v", F.lit(0))).alias("v"))


def matrix(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adjacency matrix with a column a node, in the order of nodes; the node list is of driver size."""
    order = [r["node"] for r in nodes.orderBy("ord").collect()]
    return cells(edges, nodes).groupBy("src").pivot("tgt", order).agg(F.max("v"))


def unpivoted(wide: DataFrame) -> DataFrame:
    """A matrix as (src, tgt, v)."""
    return wide.unpivot(["src"], [c for c in wide.columns if c != "src"], "tgt", "v")


def either(*tables: DataFrame) -> DataFrame:
    """Cells that are 1 in any of the tables."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("src", "tgt").agg(F.max("v").alias("v"))


def merged(*lists: DataFrame, directed=("funding",), samples: int = 3) -> DataFrame:
    """Edge lists of several methods (src, tgt, type, weight, context, method) as one. Edges of types that aren't directed lose their direction."""
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    keep = F.col("type").isin(*directed)
    out = out.withColumn("a", F.when(keep, F.col("src")).otherwise(F.least("src", "tgt"))).withColumn("b", F.when(keep, F.col("tgt")).otherwise(F.greatest("src", "tgt")))
    return out.groupBy("a", "b", "type").agg(F.sum("weight").alias("weight"), F.array_join(F.slice(F.array_sort(F.collect_set("context")), 1, samples), "|").alias("contexts"), F.array_join(F.array_sort(F.collect_set("method")), "|").alias("methods"), F.when(F.count_distinct("method") == 1, F.min("method")).otherwise("mixed").alias("origin"))


def node_degrees(edges: DataFrame, core: DataFrame) -> DataFrame:
    """Degree of each end of merged edges (a, b, type, weight), by kind of edge, and its tier."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"), "type", "weight")
    d = ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"), F.count_if(F.contains("type", F.lit("fund"))).alias("n_funding"), F.count_if(F.contains("type", F.lit("collab"))).alias("n_collab"))
    return d.join(core.select("node", F.lit("core").alias("tier")), "node", "left").fillna("snowball", ["tier"])


def within(edges: DataFrame, core: DataFrame) -> DataFrame:
    """Edges with both ends in the core: two semi joins."""
    return edges.join(core.select(F.col("node").alias("a")), "a", "left_semi").join(core.select(F.col("node").alias("b")), "b", "left_semi")


def touching(edges: DataFrame, core: DataFrame) -> DataFrame:
    c = core.select("node").distinct()
    hit = edges.join(c.select(F.col("node").alias("a"), F.lit(1).alias("x")), "a", "left").join(c.select(F.col("node").alias("b"), F.lit(1).alias("y")), "b", "left")
    return hit.filter("x = 1 or y = 1").drop("x", "y")


def deduplicated(relations: DataFrame, directed=("funding",)) -> DataFrame:
    """One relation for each pair of lower-case ends and subtype, the first by id."""
    a, b = F.lower("src"), F.lower("tgt")
    keep = F.col("subtype").isin(*directed)
    key = F.struct(F.when(keep, a).otherwise(F.least(a, b)), F.when(keep, b).otherwise(F.greatest(a, b)), F.col("subtype"))
    return relations.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("id"))).filter("rn = 1").drop("rn")
