"""Statistics of directed networks: edges (src, tgt) and nodes (node).

Counts are joins and aggregates. Centralities and permutation tests work on one small matrix
a network or draw, in grouped or mapped pandas functions; draws are spread over tasks and
seeded one by one, so results don't depend on partitions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomnet.operators.sampling import average_rank


def simple(edges: DataFrame) -> DataFrame:
    """Binary edges without loops."""
    return edges.filter("src <> tgt").select("src", "tgt").distinct()


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """In, out and total degree of every node, isolates too: one aggregate over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("tgt").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x")).select("x.*")
    d = ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return nodes.select("node").join(d, "node", "left").fillna(0).withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def dyads(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mutual, asymmetric and null dyads, density, reciprocity over all dyads (null ones count) and over those with a tie."""
    d = edges.groupBy(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")).agg(F.count("*").alias("k"))
    n = nodes.agg(F.count("*").alias("n"))
    c = d.agg(F.count_if(F.col("k") == 2).alias("mutual"), F.count_if(F.col("k") == 1).alias("asymmetric")).crossJoin(n)
    c = c.withColumn("nulls", (F.col("n") * (F.col("n") - 1) / 2).cast("long") - F.col("mutual") - F.col("asymmetric"))
    pairs = F.col("mutual") + F.col("asymmetric") + F.col("nulls")
    return c.select("mutual", "asymmetric", "nulls", F.round(F.try_divide(2 * F.col("mutual") + F.col("asymmetric"), F.col("n") * (F.col("n") - 1)), 6).alias("density"), F.round(F.try_divide(F.col("mutual") + F.col("nulls"), pairs), 6).alias("dyadic"), F.round(F.try_divide(F.col("mutual"), F.col("mutual") + F.col("asymmetric")), 6).alias("nonnull"))


def two_paths(edges: DataFrame) -> DataFrame:
    """(src, mid, tgt) of all ordered two-paths between different ends."""
    a, b = edges.select("src", F.col("tgt").alias("mid")), edges.select(F.col("src").alias("mid"), "tgt")
    return a.join(b, "mid").filter("src <> tgt")


def transitivity(edges: DataFrame) -> DataFrame:
    """Share of two-paths that an edge closes."""
    p = two_paths(edges).groupBy("src", "tgt").agg(F.count("*").alias("k")).join(edges.withColumn("closed", F.lit(1)), ["src", "tgt"], "left")
    return p.agg(F.sum("k").alias("paths"), F.coalesce(F.sum(F.when(F.col("closed") == 1, F.col("k"))), F.lit(0)).alias("closed")).withColumn("transitivity", F.round(F.try_divide("closed", "paths"), 6))


#: Classes of 16 by the codes of arcs a-b, b-c, a-c; built from canonical forms.
def _triad_names() -> dict[int, str]:
    names = {"003": [], "012": [(0, 1)], "102": [(0, 1), (1, 0)], "021D": [(1, 0), (1, 2)], "021U": [(0, 1), (2, 1)], "021C": [(0, 1), (1, 2)], "111D": [(0, 1), (1, 0), (2, 1)], "111U": [(0, 1), (1, 0), (1, 2)], "030T": [(0, 1), (1, 2), (0, 2)], "030C": [(0, 1), (1, 2), (2, 0)], "201": [(0, 1), (1, 0), (1, 2), (2, 1)], "120D": [(1, 0), (1, 2), (0, 2), (2, 0)], "120U": [(0, 1), (2, 1), (0, 2), (2, 0)], "120C": [(0, 1), (1, 2), (0, 2), (2, 0)], "210": [(0, 1), (1, 2), (2, 1), (0, 2), (2, 0)], "300": [(i, j) for i in range(3) for j in range(3) if i != j]}
    from itertools import permutations

    bit = {(0, 1): 1, (1, 0): 2, (1, 2): 4, (2, 1): 8, (0, 2): 16, (2, 0): 32}
    return {sum(bit[(p[i], p[j])] for i, j in arcs): name for name, arcs in names.items() for p in permutations(range(3))}


def triad_census(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """All sixteen classes of triads, those that don't occur with 0. Triads with two ties or more come from pairs of ties that share a node, those with one and none by subtraction, so that work grows with the ties and not with the cube of the nodes."""
    dyads_ = edges.filter("src <> tgt").groupBy(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")).agg((F.max((F.col("src") < F.col("tgt")).cast("int")) + 2 * F.max((F.col("src") > F.col("tgt")).cast("int"))).alias("k"))
    both = dyads_.select(F.col("a").alias("c"), F.col("b").alias("p"), "k").unionByName(dyads_.select(F.col("b").alias("c"), F.col("a").alias("p"), "k"))
    w = both.select("c", "p", F.col("k").alias("kp")).join(both.select("c", F.col("p").alias("q"), F.col("k").alias("kq")), "c").filter("p < q")
    w = w.join(dyads_.select(F.col("a").alias("p"), F.col("b").alias("q"), F.col("k").alias("kpq")), ["p", "q"], "left").fillna(0, ["kpq"])
    # a closed triad has three such pairs: that of its least node counts
    t = w.filter("kpq = 0 or c < p")
    code = F.when(F.col("c") < F.col("p"), F.col("kp") + 4 * F.col("kpq") + 16 * F.col("kq")).when(F.col("c") < F.col("q"), F.col("kp") + 4 * F.col("kq") + 16 * F.col("kpq")).otherwise(F.col("kpq") + 4 * F.col("kq") + 16 * F.col("kp"))
    table = F.create_map(*(F.lit(v) for kv in _triad_names().items() for v in kv))
    many = t.groupBy(F.element_at(table, code.cast("int")).alias("triad")).agg(F.count("*").alias("n"))
    # of a tie's n - 2 third nodes, those tied to neither of its ends
    degree = both.groupBy("c").agg(F.count("*").alias("deg"))
    common = w.filter("kpq > 0").groupBy(F.col("p").alias("a"), F.col("q").alias("b")).agg(F.count("*").alias("common"))
    one = dyads_.join(degree.select(F.col("c").alias("a"), F.col("deg").alias("da")), "a").join(degree.select(F.col("c").alias("b"), F.col("deg").alias("db")), "b").join(common, ["a", "b"], "left").fillna(0, ["common"]).crossJoin(nodes.agg(F.count("*").alias("all")))
    one = one.groupBy(F.when(F.col("k") == 3, "102").otherwise("012").alias("triad")).agg(F.sum(F.col("all") - F.col("da") - F.col("db") + F.col("common")).alias("n"))
    some = many.unionByName(one)
    total = nodes.agg((F.count("*") * (F.count("*") - 1) * (F.count("*") - 2) / 6).cast("long").alias("total"))
    none = total.crossJoin(some.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s"))).select(F.lit("003").alias("triad"), (F.col("total") - F.col("s")).alias("n"))
    every = edges.sparkSession.createDataFrame([(x,) for x in sorted(set(_triad_names().values()))], "triad string")
    return every.join(some.unionByName(none).groupBy("triad").agg(F.sum("n").alias("n")), "triad", "left").fillna(0, ["n"])


def triads(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Census of the triads in classes of mutual, asymmetric and null dyads, those that occur."""
    return triad_census(edges, nodes).groupBy(F.left("triad", F.lit(3)).alias("man")).agg(F.sum("n").alias("n")).filter("n > 0")


def shared_partners(edges: DataFrame, cap: int = 8) -> DataFrame:
    """How many edges have how many common targets of their ends; more than ``cap`` fall outside the table."""
    a, b = edges.select(F.col("src").alias("i"), F.col("tgt").alias("x")), edges.select(F.col("src").alias("j"), F.col("tgt").alias("x"))
    k = a.join(b, "x").filter("i <> j").groupBy("i", "j").agg(F.count("*").alias("k"))
    e = edges.join(k, (edges["src"] == k["i"]) & (edges["tgt"] == k["j"]), "left").select(F.coalesce("k", F.lit(0)).alias("partners"))
    return e.filter(F.col("partners") <= cap).groupBy("partners").agg(F.count("*").alias("n"))


def distances(edges: DataFrame, nodes: DataFrame, most: int | None = None) -> DataFrame:
    """(src, tgt, d) of all reachable pairs: a frontier grows by one join a step until it is empty."""
    from loomnet.operators.iterate import cut

    e = edges.select(F.col("src").alias("mid"), "tgt")
    front = edges.select("src", "tgt").withColumn("d", F.lit(1))
    seen, d = cut(front), 1
    while most is None or d < most:
        d += 1
        front = seen.filter(F.col("d") == d - 1).select("src", F.col("tgt").alias("mid")).join(e, "mid").filter("src <> tgt").select("src", "tgt").distinct().join(seen, ["src", "tgt"], "left_anti").withColumn("d", F.lit(d))
        new = cut(front)
        if new.isEmpty():
            break
        seen = cut(seen.unionByName(new))
    return seen


def geodesics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("n"))
    return distances(edges, nodes).agg(F.round(F.avg("d"), 6).alias("mean"), F.max("d").alias("diameter"), F.count("*").alias("reachable")).crossJoin(n).select("mean", "diameter", F.round(F.col("reachable") / (F.col("n") * (F.col("n") - 1)), 6).alias("reachable"))


def overlap(a: DataFrame, b: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of a against those of b: cells in common, precision, recall, F1, Jaccard, Hamming, agreement."""
    j = a.withColumn("p", F.lit(1)).join(b.withColumn("q", F.lit(1)), ["src", "tgt"], "full_outer").fillna(0)
    c = j.agg(F.count_if((F.col("p") == 1) & (F.col("q") == 1)).alias("tp"), F.count_if((F.col("p") == 1) & (F.col("q") == 0)).alias("fp"), F.count_if((F.col("p") == 0) & (F.col("q") == 1)).alias("fn")).crossJoin(nodes.agg((F.count("*") * (F.count("*") - 1)).alias("cells")))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    r = lambda x: F.round(x, 6)
    c = c.withColumn("tn", F.col("cells") - tp - fp - fn)
    return c.select("tp", "fp", "fn", "tn", r(F.try_divide(tp, tp + fp)).alias("precision"), r(F.try_divide(tp, tp + fn)).alias("recall"), r(F.try_divide(2 * tp, 2 * tp + fp + fn)).alias("f1"), r(F.try_divide(tp, tp + fp + fn)).alias("jaccard"), (fp + fn).alias("hamming"), r((tp + F.col("tn")) / F.col("cells")).alias("agreement"))


def degree_correlation(a: DataFrame, b: DataFrame, nodes: DataFrame) -> DataFrame:
    """Spearman correlation of in and out degrees in two networks: Pearson's of ranks with ties at their mean."""
    x, y = degrees(a, nodes), degrees(b, nodes)
    j = x.select("node", F.col("in_degree").alias("ia"), F.col("out_degree").alias("oa")).join(y.select("node", F.col("in_degree").alias("ib"), F.col("out_degree").alias("ob")), "node")
    for c in ("ia", "oa", "ib", "ob"):
        j = average_rank(j, c, f"r_{c}")
    return j.agg(F.round(F.corr("r_ia", "r_ib"), 6).alias("in_degree"), F.round(F.corr("r_oa", "r_ob"), 6).alias("out_degree"))


def local_clustering(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Share of a node's neighbour pairs that are tied, direction aside; 0 for isolates and single neighbours."""
    u = edges.select(F.explode(F.array(F.struct("src", "tgt"), F.struct(F.col("tgt").alias("src"), F.col("src").alias("tgt")))).alias("e")).select("e.*").distinct()
    k = u.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("k"))
    t = u.alias("a").join(u.alias("b"), F.col("a.src") == F.col("b.src")).filter("a.tgt < b.tgt").select(F.col("a.src").alias("node"), F.col("a.tgt").alias("src"), F.col("b.tgt").alias("tgt")).join(u, ["src", "tgt"], "left_semi").groupBy("node").agg(F.count("*").alias("t"))
    return nodes.select("node").join(k, "node", "left").join(t, "node", "left").select("node", F.round(F.coalesce(F.try_divide(2.0 * F.coalesce("t", F.lit(0)), F.col("k") * (F.col("k") - 1)), F.lit(0.0)), 6).alias("clustering"))


def cross_ties(edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """Ties of each node to nodes of other categories (node, category), and their share."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("tgt").alias("other")), F.struct(F.col("tgt").alias("node"), F.col("src").alias("other")))).alias("e")).select("e.*")
    j = ends.join(kinds, "node").join(kinds.select(F.col("node").alias("other"), F.col("category").alias("c2")), "other")
    a = j.groupBy("node").agg(F.count("*").alias("ties"), F.count_if(F.col("category") != F.col("c2")).alias("cross"))
    return kinds.select("node").join(a, "node", "left").fillna(0).withColumn("share", F.round(F.try_divide("cross", "ties"), 6))


def subgroup_density(edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """Density within each category."""
    size = kinds.groupBy("category").agg(F.count("*").alias("n"))
    e = edges.join(kinds.select(F.col("node").alias("src"), "category"), "src").join(kinds.select(F.col("node").alias("tgt"), F.col("category").alias("c2")), "tgt").filter("category = c2").groupBy("category").agg(F.count("*").alias("edges"))
    return size.join(e, "category", "left").fillna(0, ["edges"]).select("category", "n", "edges", F.round(F.try_divide(F.col("edges"), F.col("n") * (F.col("n") - 1)), 6).alias("density"))


def category_means(metrics: DataFrame, kinds: DataFrame) -> DataFrame:
    """Means of all metrics by category, over nodes that have them all."""
    names = [c for c in metrics.columns if c != "node"]
    return metrics.join(kinds, "node").dropna(subset=names).groupBy("category").agg(*(F.round(F.avg(c), 6).alias(c) for c in names))


# small matrices


def dense(edges: pd.DataFrame, nodes: list) -> np.ndarray:
    at = {v: k for k, v in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for s, t in zip(edges["src"], edges["tgt"]):
        if s in at and t in at and s != t:
            m[at[s], at[t]] = 1
    return m


def shortest(m: np.ndarray) -> np.ndarray:
    n = len(m)
    d = np.where(np.eye(n, dtype=bool), 0, np.inf)
    reach, k = np.eye(n), 0
    while True:
        k += 1
        reach = ((reach @ m) > 0).astype(float)
        new = (reach > 0) & np.isinf(d)
        if not new.any():
            return d
        d[new] = k
        reach = new.astype(float)


def betweenness(m: np.ndarray) -> np.ndarray:
    """Share of shortest paths through each node, over (n - 1)(n - 2)."""
    n = len(m)
    out = np.zeros(n)
    for s in range(n):
        order, pred, sigma, dist = [], [[] for _ in range(n)], np.zeros(n), np.full(n, -1)
        sigma[s], dist[s], queue = 1, 0, [s]
        for v in queue:
            order.append(v)
            for w in np.flatnonzero(m[v]):
                if dist[w] < 0:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    pred[w].append(v)
        delta = np.zeros(n)
        for w in reversed(order):
            for v in pred[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                out[w] += delta[w]
    return out / ((n - 1) * (n - 2)) if n > 2 else out


def closeness(m: np.ndarray) -> np.ndarray:
    """Inverse mean distance from each node to those it reaches; nan where it reaches none."""
    d = shortest(m)
    ok = np.isfinite(d) & (d > 0)
    k, s = ok.sum(1), np.where(ok, d, 0).sum(1)
    return np.divide(k, s, out=np.full(len(m), np.nan), where=s > 0)


def leading(m: np.ndarray, steps: int = 2000) -> np.ndarray:
    """Leading eigenvector scaled to a maximum of 1, by power iteration."""
    x = np.ones(len(m))
    for _ in range(steps):
        y = m @ x + 1e-9 * x
        top = np.abs(y).max()
        if top == 0:
            return y
        y /= top
        if np.abs(y - x).max() < 1e-13:
            break
        x = y
    return y


CENTRALITY = "network string, node long, in_degree int, out_degree int, betweenness double, closeness_in double, closeness_out double, eigenvector double, authority double, hub double"


def centralities(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Centralities of every node of every network (network, src, tgt). A network is one small matrix in one task; networks spread over tasks."""
    order = [r["node"] for r in nodes.orderBy("node").collect()]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = dense(pdf, order)
        out = pd.DataFrame({"network": pdf["network"].iloc[0], "node": order, "in_degree": m.sum(0), "out_degree": m.sum(1), "betweenness": betweenness(m), "closeness_in": closeness(m.T), "closeness_out": closeness(m), "eigenvector": leading(np.maximum(m, m.T)), "authority": leading(m.T @ m), "hub": leading(m @ m.T)})
        return out.astype({"in_degree": "int32", "out_degree": "int32"}).round(9)

    return edges.groupBy("network").applyInPandas(run, CENTRALITY)


def _corr(a: np.ndarray, b: np.ndarray) -> float:
    off = ~np.eye(len(a), dtype=bool)
    x, y = a[off] - a[off].mean(), b[off] - b[off].mean()
    s = math.sqrt((x * x).sum() * (y * y).sum())
    return float((x * y).sum() / s) if s else float("nan")


def _draws(spark, reps: int, stat, schema: str = "rep long, stat double") -> DataFrame:
    """stat(rng) for each repetition, seeded by its number."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"rep": pdf["id"], "stat": [stat(np.random.default_rng([7, int(i)])) for i in pdf["id"]]})

    return spark.range(0, reps, 1, max(1, min(32, reps // 250))).mapInPandas(run, schema)


def qap(a: np.ndarray, b: np.ndarray, spark, reps: int = 1000) -> DataFrame:
    """Correlation of two matrices, and the share of relabellings of b that correlate at least as much."""
    obs = _corr(a, b)

    def stat(rng):
        p = rng.permutation(len(b))
        return _corr(a, b[np.ix_(p, p)])

    return _draws(spark, reps, stat).agg(F.lit(round(obs, 9)).alias("observed"), F.avg((F.col("stat") >= obs - 1e-12).cast("int")).alias("p"), F.count("*").alias("reps"))


def logit(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[np.ndarray, float]:
    """Coefficients with the constant first and McFadden's R2, by iterated least squares."""
    x = np.column_stack([np.ones(len(y)), x])
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        new = np.linalg.solve((x.T * w) @ x + 1e-9 * np.eye(x.shape[1]), x.T @ (w * (x @ b) + y - p))
        if np.abs(new - b).max() < 1e-10:
            b = new
            break
        b = new
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ b, -30, 30))), 1e-12, 1 - 1e-12)
    m = y.mean()
    null = len(y) * (m * math.log(m) + (1 - m) * math.log(1 - m)) if 0 < m < 1 else float("nan")
    return b, 1 - float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum()) / null


def covariates(y: np.ndarray, x: np.ndarray, controlled: bool) -> np.ndarray:
    """The predictor, with two-paths and the reverse tie of y where controlled."""
    cols = [x, y @ y, y.T] if controlled else [x]
    off = ~np.eye(len(y), dtype=bool)
    return np.column_stack([c[off] for c in cols])


def mrqap(y: np.ndarray, x: np.ndarray, spark, reps: int = 500, controlled: bool = False) -> DataFrame:
    """Logistic regression of y's ties on x's, and the share of relabellings of x with a coefficient at least as large."""
    off = ~np.eye(len(y), dtype=bool)
    b, r2 = logit(covariates(y, x, controlled), y[off])

    def stat(rng):
        p = rng.permutation(len(x))
        return float(logit(covariates(y, x[np.ix_(p, p)], controlled), y[off])[0][1])

    return _draws(spark, reps, stat).agg(F.lit(float(b[1])).alias("coef"), F.lit(float(np.exp(b[1]))).alias("odds"), F.lit(r2).alias("r2"), F.avg((F.col("stat") >= float(b[1]) - 1e-12).cast("int")).alias("p"))


def reciprocity(m: np.ndarray) -> float:
    u = np.triu_indices(len(m), 1)
    return float((m[u] == m.T[u]).mean())


def weak_transitivity(m: np.ndarray) -> float:
    p = m @ m
    np.fill_diagonal(p, 0)
    return float((p * m).sum() / p.sum()) if p.sum() else float("nan")


STATS = {"density": lambda m: float(m.sum() / (len(m) * (len(m) - 1))), "reciprocity": reciprocity, "transitivity": weak_transitivity, "mean_distance": lambda m: float((lambda d: d[np.isfinite(d) & (d > 0)].mean())(shortest(m))) if m.any() else float("nan"), "centralization": lambda m: float((m.sum(0).max() - m.sum(0)).sum() / (len(m) - 1) ** 2)}


def random_graph(rng, m: np.ndarray, by: str) -> np.ndarray:
    """A random digraph with the edges of m (by = edges) or its dyads (by = dyads)."""
    n = len(m)
    out = np.zeros((n, n))
    if by == "edges":
        off = np.flatnonzero(~np.eye(n, dtype=bool).ravel())
        out.ravel()[rng.choice(off, int(m.sum()), replace=False)] = 1
        return out
    u, v = np.triu_indices(n, 1)
    both = int(((m[u, v] + m[v, u]) == 2).sum())
    one = int(((m[u, v] + m[v, u]) == 1).sum())
    pick = rng.permutation(len(u))
    a, b = pick[:both], pick[both : both + one]
    out[u[a], v[a]] = out[v[a], u[a]] = 1
    flip = rng.random(one) < 0.5
    out[np.where(flip, u[b], v[b]), np.where(flip, v[b], u[b])] = 1
    return out


def cug(m: np.ndarray, spark, reps: int = 1000, by: str = "edges", names=tuple(STATS)) -> DataFrame:
    """Each statistic against random digraphs: mean, deviation, z, and two-sided p."""
    out = None
    for name in names:
        obs, f = STATS[name](m), STATS[name]
        d = _draws(spark, reps, lambda rng, f=f: f(random_graph(rng, m, by)))
        low, high = F.avg((F.col("stat") <= obs).cast("int")), F.avg((F.col("stat") >= obs).cast("int"))
        one = d.agg(F.lit(name).alias("name"), F.lit(by).alias("given"), F.lit(float(obs)).alias("observed"), F.avg("stat").alias("mean"), F.stddev("stat").alias("sd"), F.try_divide(F.lit(float(obs)) - F.avg("stat"), F.stddev("stat")).alias("z"), F.least(F.lit(1.0), 2 * F.least(low, high)).alias("p"))
        out = one if out is None else out.unionByName(one)
    return out


def density_matched(m: np.ndarray, spark, reps: int = 1000) -> DataFrame:
    """Reciprocity of independent random digraphs of m's density."""
    q = m.sum() / (len(m) * (len(m) - 1))

    def stat(rng):
        x = (rng.random(m.shape) < q).astype(float)
        np.fill_diagonal(x, 0)
        return reciprocity(x)

    return _draws(spark, reps, stat).agg(F.lit(reciprocity(m)).alias("observed"), F.avg("stat").alias("mean"), F.avg((F.col("stat") >= reciprocity(m)).cast("int")).alias("p"))


def relabelled(m: np.ndarray, spark, reps: int = 200) -> DataFrame:
    """Reciprocity under relabelling. It never changes, so p is 1: kept to say so, not as a test."""
    def stat(rng):
        p = rng.permutation(len(m))
        return reciprocity(m[np.ix_(p, p)])

    return _draws(spark, reps, stat).agg(F.lit(reciprocity(m)).alias("observed"), F.min("stat").alias("least"), F.max("stat").alias("most"), F.avg((F.col("stat") >= reciprocity(m) - 1e-12).cast("int")).alias("p"))


def _ranks(x: np.ndarray) -> np.ndarray:
    return pd.Series(x).rank().to_numpy()


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def wilcoxon(x, y, guarded: bool = True) -> float:
    """One-sided p that x is greater, by the normal approximation with ties and continuity; nan where there is nothing to compare."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    both = np.concatenate([x, y])
    if len(x) < (2 if guarded else 1) or len(y) < (2 if guarded else 1) or np.ptp(both) == 0:
        return float("nan")
    n, m = len(x), len(y)
    u = _ranks(both)[:n].sum() - n * (n + 1) / 2
    t = np.unique(both, return_counts=True)[1]
    sd = math.sqrt(n * m / 12 * ((n + m + 1) - (t**3 - t).sum() / ((n + m) * (n + m - 1))))
    return _upper((u - n * m / 2 - 0.5) / sd)


def kruskal(values, groups) -> float:
    """Kruskal-Wallis H with ties corrected."""
    v, g = np.asarray(values, float), np.asarray(groups)
    r, n = _ranks(v), len(v)
    h = 12 / (n * (n + 1)) * sum(r[g == k].sum() ** 2 / (g == k).sum() for k in np.unique(g)) - 3 * (n + 1)
    t = np.unique(v, return_counts=True)[1]
    c = 1 - (t**3 - t).sum() / (n**3 - n)
    return float(h / c) if c else float("nan")


def benjamini_hochberg(tests: DataFrame, p: str = "p") -> DataFrame:
    """Adjusted p values: cumulative minima from the largest down."""
    from pyspark.sql import Window

    w = Window.orderBy(F.desc(p))
    n = tests.filter(F.col(p).isNotNull()).agg(F.count("*").alias("m"))
    r = tests.filter(F.col(p).isNotNull()).crossJoin(n).withColumn("i", F.col("m") + 1 - F.row_number().over(w))
    return r.withColumn("adjusted", F.least(F.lit(1.0), F.min(F.col(p) * F.col("m") / F.col("i")).over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("m", "i")


def mple(m: np.ndarray, category: np.ndarray) -> dict[str, float]:
    """Pseudo-likelihood estimate of edges, mutual and same-category terms: logistic regression on change statistics. An approximation, not a simulated likelihood."""
    off = ~np.eye(len(m), dtype=bool)
    same = (category[:, None] == category[None, :]).astype(float)
    b, r2 = logit(np.column_stack([m.T[off], same[off]]), m[off])
    return {"edges": float(b[0]), "mutual": float(b[1]), "nodematch": float(b[2]), "pseudo_r2": r2}


def brokers(metrics: DataFrame) -> DataFrame:
    """metrics (node, degree, betweenness) with the broker index: betweenness over the share of the highest degree; null for isolates."""
    top = metrics.agg(F.max("degree").alias("top"))
    return metrics.crossJoin(top).withColumn("broker", F.when(F.col("degree") > 0, F.round(F.col("betweenness") / (F.col("degree") / F.col("top")), 4))).drop("top")


def rank_preservation(means: list[tuple[str, DataFrame]]) -> DataFrame:
    """(a, b, spearman) of each two networks' mean degrees by category (category, degree), a category that one lacks counting 0."""
    every = means[0][1].select("category")
    for _, m in means[1:]:
        every = every.unionByName(m.select("category"))
    every, out = every.distinct(), None
    for i, (x, mx) in enumerate(means):
        for y, my in means[i + 1 :]:
            j = every.join(mx.select("category", F.col("degree").alias("u")), "category", "left").join(my.select("category", F.col("degree").alias("v")), "category", "left").fillna(0.0, ["u", "v"])
            r = average_rank(average_rank(j, "u", "ru"), "v", "rv").agg(F.round(F.corr("ru", "rv"), 6).alias("spearman")).select(F.lit(x).alias("a"), F.lit(y).alias("b"), "spearman")
            out = r if out is None else out.unionByName(r)
    return out


def deltas(windows: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """What validation changes in each window (name, raw overlap, validated overlap): F1, precision and recall of both and their differences."""
    out = None
    for name, raw, valid in windows:
        r = raw.select(*(F.round(k, 3).alias(f"raw_{k}") for k in ("f1", "precision", "recall")), *(F.col(k).alias(f"_r{k}") for k in ("f1", "precision", "recall")))
        v = valid.select(*(F.round(k, 3).alias(f"valid_{k}") for k in ("f1", "precision", "recall")), *(F.col(k).alias(f"_v{k}") for k in ("f1", "precision", "recall")))
        row = r.crossJoin(v).select(F.lit(name).alias("window"), *(c for k in ("f1", "precision", "recall") for c in (f"raw_{k}", f"valid_{k}", F.round(F.col(f"_v{k}") - F.col(f"_r{k}"), 3).alias(f"delta_{k}"))))
        out = row if out is None else out.unionByName(row)
    return out


def pairwise(values: np.ndarray, groups: np.ndarray) -> list[tuple]:
    """(a, b, p) of each two groups by a two-sided rank test with continuity and ties; nan where there is nothing to compare."""
    v, g, out = np.asarray(values, float), np.asarray(groups), []
    keys = sorted(set(g.tolist()))
    for i, x in enumerate(keys):
        for y in keys[i + 1 :]:
            a, b = v[g == x], v[g == y]
            both, n, m = np.concatenate([a, b]), len(a), len(b)
            if np.ptp(both) == 0:
                out.append((x, y, float("nan")))
                continue
            u = _ranks(both)[:n].sum() - n * (n + 1) / 2
            t = np.unique(both, return_counts=True)[1]
            sd = math.sqrt(n * m / 12 * ((n + m + 1) - (t**3 - t).sum() / ((n + m) * (n + m - 1))))
            z = abs(u - n * m / 2)
            out.append((x, y, min(1.0, 2 * _upper(max(z - 0.5, 0) / sd))))
    return out


def report(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """(section, line) of all frames, a row as JSON a line; the order of sections is that of parts."""
    out = None
    for k, (name, df) in enumerate(parts):
        x = df.select(F.lit(f"{k + 1}. {name}").alias("section"), F.to_json(F.struct(*df.columns)).alias("line"))
        out = x if out is None else out.unionByName(x)
    return out


def missing(requested: DataFrame, present: DataFrame) -> DataFrame:
    """Nodes that were asked for, and whether they are there."""
    return requested.select("node").distinct().join(present.select("node").distinct().withColumn("there", F.lit(1)), "node", "left").fillna(0, ["there"])
