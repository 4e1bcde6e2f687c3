"""Queries over the network of nations: counts as joins, centralities and permutation tests on small matrices."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomnet.operators import netstats as S
from loomnet.operators import sampling as P

from .evidence_queries import GRAPH, TOTAL, YEARLY, E, T, graph, nodes, pairs, total



def second(s, d):
    return total(s, d).filter("comention_evidence > collab_evidence + 2 and src <> tgt").select("src", "tgt")


SECOND = "second AS (SELECT src, tgt FROM total WHERE comention_evidence > collab_evidence + 2 AND src <> tgt)"


def sparse(s, d):
    return total(s, d).filter("collab_evidence > comention_evidence + 9 and src <> tgt").select("src", "tgt")


SPARSE = "sparse AS (SELECT src, tgt FROM total WHERE collab_evidence > comention_evidence + 9 AND src <> tgt)"


def kinds(s, d):
    return T(s, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("category"))


def small(df, s, d):
    """A network of at most the nation list as a matrix on the driver."""
    order = [r["node"] for r in nodes(s, d).orderBy("ord").collect()]
    return S.dense(df.toPandas(), order)


def yearly_networks(s, d):
    y = E.yearly(pairs(s, d)).filter("collab_evidence > comention_evidence and src <> tgt")
    return y.select(F.col("year").cast("string").alias("network"), "src", "tgt")


def top_actors(s, d):
    y = yearly_networks(s, d).groupBy("network", F.col("src").alias("node")).agg(F.count("*").alias("m"))
    t = P.top(y, "network", "m", 4, "node")
    return t.groupBy("network").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node"))), lambda x: x["node"].cast("string")), ",").alias("top"))


def category_rows(s, d):
    return S.category_means(S.degrees(graph(s, d), nodes(s, d)), kinds(s, d))


def wilcoxon_by_category(s, d):
    """Each category's degrees against all others, with adjusted p: one small group a task."""
    x = S.degrees(graph(s, d), nodes(s, d)).join(kinds(s, d), "node").select("category", "degree").toPandas()
    rows = [(int(c), float(S.wilcoxon(x.degree[x.category == c], x.degree[x.category != c]))) for c in sorted(x.category.unique())]
    return S.benjamini_hochberg(s.createDataFrame(rows, "category int, p double"))


def perms(s: SparkSession, d: str):
    a, b = small(graph(s, d), s, d), small(second(s, d), s, d)
    return S.qap(a, b, s, 15_000)


def broker_rows(s, d):
    c = S.centralities(graph(s, d).withColumn("network", F.lit("all")), nodes(s, d))
    return S.brokers(c.select("node", (F.col("in_degree") + F.col("out_degree")).alias("degree"), "betweenness"))


def category_degrees(g, s, d):
    return S.category_means(S.degrees(g, nodes(s, d)), kinds(s, d)).select("category", "degree")


def pairwise_rows(s, d):
    """Two-sided tests of each two categories' degrees, adjusted."""
    x = S.degrees(graph(s, d), nodes(s, d)).join(kinds(s, d), "node").select("category", "degree").toPandas()
    return S.benjamini_hochberg(s.createDataFrame([(int(a), int(b), p) for a, b, p in S.pairwise(x.degree, x.category)], "a int, b int, p double"))


def report_rows(s, d):
    return S.report([("degrees", S.degrees(graph(s, d), nodes(s, d))), ("dyads", S.dyads(graph(s, d), nodes(s, d))), ("overlap", S.overlap(graph(s, d), sparse(s, d), nodes(s, d)))]).groupBy("section").agg(F.count("*").alias("n"))


QUERIES = {
    "broker_index": broker_rows,
    "rank_preservation": lambda s, d: S.rank_preservation([("graph", category_degrees(graph(s, d), s, d)), ("sparse", category_degrees(sparse(s, d), s, d)), ("second", category_degrees(second(s, d), s, d))]),
    "validation_delta": lambda s, d: S.deltas([("all", S.overlap(graph(s, d), second(s, d), nodes(s, d)), S.overlap(sparse(s, d), second(s, d), nodes(s, d)))]),
    "wilcoxon_pairwise": pairwise_rows,
    "comparison_report": report_rows,
    "missing_nodes": lambda s, d: S.missing(nodes(s, d), graph(s, d).select(F.col("src").alias("node"))),
    "degrees": lambda s, d: S.degrees(graph(s, d), nodes(s, d)),
    "dyad_census": lambda s, d: S.dyads(graph(s, d), nodes(s, d)),
    "transitivity": lambda s, d: S.transitivity(graph(s, d)),
    "triads_coarse": lambda s, d: S.triads(graph(s, d), nodes(s, d)),
    "triad_census": lambda s, d: S.triad_census(graph(s, d), nodes(s, d)),
    "shared_partners": lambda s, d: S.shared_partners(graph(s, d)),
    "geodesics": lambda s, d: S.geodesics(sparse(s, d), nodes(s, d)),
    "edge_overlap": lambda s, d: S.overlap(graph(s, d), sparse(s, d), nodes(s, d)),
    "degree_spearman": lambda s, d: S.degree_correlation(graph(s, d), sparse(s, d), nodes(s, d)),
    "local_clustering": lambda s, d: S.local_clustering(sparse(s, d), nodes(s, d)),
    "cross_ties": lambda s, d: S.cross_ties(graph(s, d), kinds(s, d)),
    "subgroup_density": lambda s, d: S.subgroup_density(graph(s, d), kinds(s, d)),
    "category_means": category_rows,
    "top_actors": top_actors,
    "degree_ranks": lambda s, d: P.least_rank(P.average_rank(S.degrees(graph(s, d), nodes(s, d)), "degree", "mean_rank"), "degree", "best_rank").select("node", "degree", "mean_rank", "best_rank"),
    "two_paths": lambda s, d: S.two_paths(sparse(s, d)).groupBy("src", "tgt").agg(F.count("*").alias("k")),
    "centralities": lambda s, d: S.centralities(yearly_networks(s, d), nodes(s, d)),
    "qap": perms,
    "mrqap": lambda s, d: S.mrqap(small(graph(s, d), s, d), small(sparse(s, d), s, d), s, 15_000).unionByName(S.mrqap(small(graph(s, d), s, d), small(sparse(s, d), s, d), s, 15_000, True)),
    "cug": lambda s, d: S.cug(small(sparse(s, d), s, d), s, 15_000).unionByName(S.cug(small(sparse(s, d), s, d), s, 15_000, "dyads")),
    "reciprocity_random": lambda s, d: S.density_matched(small(graph(s, d), s, d), s, 5_000),
    "reciprocity_relabelled": lambda s, d: S.relabelled(small(graph(s, d), s, d), s),
    "wilcoxon_categories": wilcoxon_by_category,
}
_DEG = """deg AS (SELECT n_nationkey AS node, (SELECT count(*) FROM {g} WHERE tgt = n_nationkey) AS in_degree, (SELECT count(*) FROM {g} WHERE src = n_nationkey) AS out_degree FROM nation)"""
_DY = "dy AS (SELECT least(src, tgt) AS a, greatest(src, tgt) AS b, count(*) AS k FROM graph GROUP BY 1, 2)"
_ENDS = "ends AS (SELECT src AS node, tgt AS other FROM graph UNION ALL SELECT tgt, src FROM graph)"
_KINDS = "kinds AS (SELECT n_nationkey AS node, n_regionkey AS category FROM nation)"
_RANK = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"
_CODES = "CASE x + 4 * y + 16 * z " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in sorted(S._triad_names().items())) + " END"
_MEANS = lambda g: f"(SELECT n_regionkey AS category, avg((SELECT count(*) FROM {g} WHERE tgt = n_nationkey) + (SELECT count(*) FROM {g} WHERE src = n_nationkey)) AS u FROM nation GROUP BY 1)"
_PRESERVED = lambda a, b: f"SELECT '{a}' AS a, '{b}' AS b, round(corr(ru, rv), 6) AS spearman FROM (SELECT {_RANK('u')} AS ru, {_RANK('v')} AS rv FROM (SELECT m.u, w.u AS v FROM {_MEANS(a)} m JOIN {_MEANS(b)} w USING (category)))"
_OVER = lambda g: f"(SELECT 2 * tp / (2 * tp + fp + fn) AS f1, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM (SELECT count(*) FILTER (a AND b) AS tp, count(*) FILTER (a AND NOT b) AS fp, count(*) FILTER (NOT a AND b) AS fn FROM (SELECT (m.n_nationkey, n.n_nationkey) IN (SELECT (src, tgt) FROM {g}) AS a, (m.n_nationkey, n.n_nationkey) IN (SELECT (src, tgt) FROM second) AS b FROM nation m JOIN nation n ON m.n_nationkey <> n.n_nationkey)))"
ORACLE = {
    "triad_census": f"""WITH {GRAPH}, g AS (SELECT x.n_nationkey AS a, y.n_nationkey AS b, CAST((x.n_nationkey, y.n_nationkey) IN (SELECT (src, tgt) FROM graph) AS INTEGER) + 2 * CAST((y.n_nationkey, x.n_nationkey) IN (SELECT (src, tgt) FROM graph) AS INTEGER) AS k FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey),
t AS (SELECT p.k AS x, q.k AS y, r.k AS z FROM g p JOIN g q ON q.a = p.b JOIN g r ON r.a = p.a AND r.b = q.b), c AS (SELECT {_CODES} AS triad, count(*) AS n FROM t GROUP BY 1)
SELECT v.triad, coalesce(n, 0) AS n FROM (VALUES {", ".join(f"('{x}')" for x in sorted(set(S._triad_names().values())))}) AS v(triad) LEFT JOIN c USING (triad)""",
    "rank_preservation": f"WITH {GRAPH}, {SPARSE}, {SECOND} " + " UNION ALL ".join(_PRESERVED(a, b) for a, b in (("graph", "sparse"), ("graph", "second"), ("sparse", "second"))),
    "validation_delta": f"""WITH {GRAPH}, {SPARSE}, {SECOND} SELECT 'all' AS window, round(x.f1, 3) AS raw_f1, round(y.f1, 3) AS valid_f1, round(round(y.f1, 6) - round(x.f1, 6), 3) AS delta_f1, round(x.p, 3) AS raw_precision, round(y.p, 3) AS valid_precision, round(round(y.p, 6) - round(x.p, 6), 3) AS delta_precision, round(x.r, 3) AS raw_recall, round(y.r, 3) AS valid_recall, round(round(y.r, 6) - round(x.r, 6), 3) AS delta_recall FROM {_OVER('graph')} x, {_OVER('sparse')} y""",
    "comparison_report": f"WITH {GRAPH} SELECT '1. degrees' AS section, count(*) AS n FROM nation UNION ALL SELECT '2. dyads', 1 UNION ALL SELECT '3. overlap', 1",
    "missing_nodes": f"WITH {GRAPH} SELECT n_nationkey AS node, CAST(n_nationkey IN (SELECT src FROM graph) AS INTEGER) AS there FROM nation",
    "degrees": f"WITH {GRAPH}, {_DEG.format(g='graph')} SELECT *, in_degree + out_degree AS degree FROM deg",
    "dyad_census": f"""WITH {GRAPH}, {_DY}, c AS (SELECT count(*) FILTER (k = 2) AS mutual, count(*) FILTER (k = 1) AS "asymmetric", (SELECT count(*) FROM nation) AS n FROM dy), e AS (SELECT *, n * (n - 1) // 2 - mutual - "asymmetric" AS nulls FROM c)
SELECT mutual, "asymmetric", nulls, round((2 * mutual + "asymmetric") / (n * (n - 1)), 6) AS density, round((mutual + nulls) / (n * (n - 1) / 2), 6) AS dyadic, round(mutual / (mutual + "asymmetric"), 6) AS nonnull FROM e""",
    "transitivity": f"""WITH {GRAPH}, p AS (SELECT a.src, b.tgt FROM graph a JOIN graph b ON a.tgt = b.src WHERE a.src <> b.tgt) SELECT paths, closed, round(closed / paths, 6) AS transitivity FROM (SELECT count(*) AS paths, count(*) FILTER ((src, tgt) IN (SELECT (src, tgt) FROM graph)) AS closed FROM p)""",
    "triads_coarse": f"""WITH {GRAPH}, {_DY}, grid AS (SELECT x.n_nationkey AS a, y.n_nationkey AS b, coalesce(k, 0) AS k FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey LEFT JOIN dy ON a = x.n_nationkey AND b = y.n_nationkey),
t AS (SELECT [p.k, q.k, r.k] AS ks FROM grid p JOIN grid q ON q.a = p.b JOIN grid r ON r.a = p.a AND r.b = q.b) SELECT len(list_filter(ks, lambda v: v = 2)) || '' || len(list_filter(ks, lambda v: v = 1)) || len(list_filter(ks, lambda v: v = 0)) AS man, count(*) AS n FROM t GROUP BY 1""",
    "shared_partners": f"WITH {GRAPH}, k AS (SELECT e.src, e.tgt, count(b.tgt) AS partners FROM graph e LEFT JOIN graph a ON a.src = e.src LEFT JOIN graph b ON b.src = e.tgt AND b.tgt = a.tgt GROUP BY 1, 2) SELECT partners, count(*) AS n FROM k WHERE partners <= 8 GROUP BY 1",
    "geodesics": f"""WITH RECURSIVE {TOTAL}, {SPARSE}, walk AS (SELECT src, tgt, 1 AS d FROM sparse UNION SELECT w.src, g.tgt, w.d + 1 FROM walk w JOIN sparse g ON g.src = w.tgt WHERE w.d < 24 AND w.src <> g.tgt), best AS (SELECT src, tgt, min(d) AS d FROM walk GROUP BY 1, 2)
SELECT round(avg(d), 6) AS mean, max(d) AS diameter, round(count(*) / ((SELECT count(*) FROM nation) * ((SELECT count(*) FROM nation) - 1)), 6) AS reachable FROM best""",
    "edge_overlap": f"""WITH {GRAPH}, {SPARSE}, c AS (SELECT count(*) FILTER (g AND h) AS tp, count(*) FILTER (g AND NOT h) AS fp, count(*) FILTER (NOT g AND h) AS fn, count(*) FILTER (NOT g AND NOT h) AS tn FROM (SELECT (a.n_nationkey, b.n_nationkey) IN (SELECT (src, tgt) FROM graph) AS g, (a.n_nationkey, b.n_nationkey) IN (SELECT (src, tgt) FROM sparse) AS h FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey))
SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fp + fn), 6) AS jaccard, fp + fn AS hamming, round((tp + tn) / (tp + fp + fn + tn), 6) AS agreement FROM c""",
    "degree_spearman": f"""WITH {GRAPH}, {SPARSE}, {_DEG.format(g='graph')}, deg2 AS (SELECT n_nationkey AS node, (SELECT count(*) FROM sparse WHERE tgt = n_nationkey) AS in2, (SELECT count(*) FROM sparse WHERE src = n_nationkey) AS out2 FROM nation),
r AS (SELECT {_RANK('in_degree')} AS a, {_RANK('in2')} AS b, {_RANK('out_degree')} AS c, {_RANK('out2')} AS e FROM deg JOIN deg2 USING (node)) SELECT round(corr(a, b), 6) AS in_degree, round(corr(c, e), 6) AS out_degree FROM r""",
    "local_clustering": f"""WITH {TOTAL}, {SPARSE}, u AS (SELECT src AS a, tgt AS b FROM sparse UNION SELECT tgt, src FROM sparse), k AS (SELECT a, count(*) AS k FROM u GROUP BY a), t AS (SELECT x.a, count(*) AS t FROM u x JOIN u y ON x.a = y.a AND x.b < y.b JOIN u z ON z.a = x.b AND z.b = y.b GROUP BY x.a)
SELECT n_nationkey AS node, round(CASE WHEN k > 1 THEN 2 * coalesce(t, 0) / (k * (k - 1)) ELSE 0.0 END, 6) AS clustering FROM nation LEFT JOIN k ON k.a = n_nationkey LEFT JOIN t ON t.a = n_nationkey""",
    "cross_ties": f"WITH {GRAPH}, {_ENDS}, {_KINDS}, a AS (SELECT e.node, count(*) AS ties, count(*) FILTER (k.category <> o.category) AS cross FROM ends e JOIN kinds k ON k.node = e.node JOIN kinds o ON o.node = e.other GROUP BY 1) SELECT k.node, coalesce(ties, 0) AS ties, coalesce(\"cross\", 0) AS cross, round(\"cross\" / ties, 6) AS share FROM kinds k LEFT JOIN a USING (node)",
    "subgroup_density": f"WITH {GRAPH}, {_KINDS}, z AS (SELECT category, count(*) AS n FROM kinds GROUP BY 1) SELECT category, n, edges, round(edges / (n * (n - 1)), 6) AS density FROM (SELECT z.category, z.n, (SELECT count(*) FROM graph JOIN kinds a ON a.node = src JOIN kinds b ON b.node = tgt WHERE a.category = z.category AND b.category = z.category) AS edges FROM z)",
    "category_means": f"WITH {GRAPH}, {_DEG.format(g='graph')} SELECT n_regionkey AS category, round(avg(in_degree), 6) AS in_degree, round(avg(out_degree), 6) AS out_degree, round(avg(in_degree + out_degree), 6) AS degree FROM deg JOIN nation ON n_nationkey = node GROUP BY 1",
    "top_actors": f"WITH {YEARLY}, y AS (SELECT CAST(year AS VARCHAR) AS network, src AS node, count(*) AS m FROM yearly WHERE collab_evidence > comention_evidence AND src <> tgt GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY network ORDER BY m DESC, node) AS rank FROM y) SELECT network, string_agg(CAST(node AS VARCHAR), ',' ORDER BY rank) AS top FROM r WHERE rank <= 4 GROUP BY 1",
    "degree_ranks": f"WITH {GRAPH}, {_DEG.format(g='graph')}, t AS (SELECT node, in_degree + out_degree AS degree FROM deg) SELECT node, degree, {_RANK('degree')} AS mean_rank, rank() OVER (ORDER BY degree DESC) AS best_rank FROM t",
    "two_paths": f"WITH {TOTAL}, {SPARSE} SELECT a.src, b.tgt, count(*) AS k FROM sparse a JOIN sparse b ON a.tgt = b.src WHERE a.src <> b.tgt GROUP BY 1, 2",
}
