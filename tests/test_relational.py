"""Every query with SQL against DuckDB on the smallest tables; network statistics on graphs worked out by hand."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from loomnet.functions import dates as D
from loomnet.functions import text as X
from loomnet.functions import urls as U
from loomnet.operators import dedup, edges, netstats
from loomnet.plans import registry


def shown(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
        return "null"
    if isinstance(v, (float, np.floating)):
        return f"{v:.6f}"
    return str(int(v)) if isinstance(v, (bool, int, np.integer)) else str(v)


def table(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(map(shown, r)) for r in df[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(f"{DATA}/sf0.001"):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/sf0.001/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, sf, duck, name):
    assert table(registry.QUERIES[name](spark, sf).toPandas()) == table(duck.execute(registry.ORACLE[name]).df())


@pytest.fixture(scope="module")
def net(spark):
    e = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 3), (0, 2)], "src long, tgt long")
    return e, spark.createDataFrame([(k,) for k in range(5)], "node long")


def test_network_by_hand(spark, net):
    e, n = net
    d = netstats.dyads(e, n).first()
    assert (d.mutual, d.asymmetric, d.nulls, d.density, d.dyadic, d.nonnull) == (1, 3, 6, 0.25, 0.7, 0.25)
    t = netstats.transitivity(e).first()
    assert (t.paths, t.closed) == (4, 2)  # 0-1-2 and 1-0-2 are closed, 0-2-3 and 1-2-3 aren't
    g = netstats.geodesics(e, n).first()
    assert (g["mean"], g.diameter, g.reachable) == (round((1 + 1 + 1 + 1 + 1 + 2 + 2) / 7, 6), 2, 0.35)
    c = {r.triad: r.n for r in netstats.triad_census(e, n).collect()}
    assert sum(c.values()) == 10 and c["120D"] + c["120U"] == 1 and c["021C"] == 2 and c["300"] == 0
    k = {r.node: r.clustering for r in netstats.local_clustering(e, n).collect()}
    assert k == {0: 1.0, 1: 1.0, 2: round(1 / 3, 6), 3: 0.0, 4: 0.0}
    r = {x.node: x for x in netstats.centralities(e.withColumn("network", F.lit("a")), n).collect()}
    assert r[2].betweenness == round(2 / 12, 9) and r[2].in_degree == 2 and r[3].out_degree == 0 and r[0].closeness_out == 0.75


def test_permutations(spark, net):
    e, n = net
    m = netstats.dense(e.toPandas(), list(range(5)))
    q = netstats.qap(m, m, spark, 250).first()
    assert q.observed == 1.0 and 0 < q.p < 0.2
    assert netstats.relabelled(m, spark, 50).first().p == 1.0
    rows = {r.name: r for r in netstats.cug(m, spark, 60, names=("density", "reciprocity")).collect()}
    assert rows["density"].sd == 0 and 0 <= rows["reciprocity"].p <= 1
    assert netstats.random_graph(np.random.default_rng(1), m, "dyads").sum() == m.sum()
    b, r2 = netstats.logit(np.array([[0.0], [0], [1], [1]]), np.array([0.0, 1, 0, 1]))
    assert abs(b).max() < 1e-6 and abs(r2) < 1e-6
    assert 0.02 < netstats.wilcoxon([5, 6, 7], [1, 2, 3]) < 0.05 and np.isnan(netstats.wilcoxon([1], [2, 3]))
    assert abs(netstats.kruskal([1, 2, 3, 4, 5, 6], list("aaabbb")) - 3.857142857) < 1e-6
    assert set(netstats.mple(m, np.array([0, 0, 1, 1, 1]))) == {"edges", "mutual", "nodematch", "pseudo_r2"}
    p = netstats.benjamini_hochberg(spark.createDataFrame([(0.01,), (0.04,), (0.03,), (None,)], "p double"))
    assert sorted(round(r.adjusted, 6) for r in p.collect()) == [0.03, 0.04, 0.04]


def test_greedy_clusters(spark):
    docs = spark.range(1, 8).withColumnRenamed("id", "doc_id")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (1, 4)], "a long, b long")
    got = {r.doc_id: r.master for r in dedup.greedy(pairs, docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 6, 7: 7}
    assert {(r.master, r.n) for r in dedup.mapping(dedup.greedy(pairs, docs)).collect()} == {(1, 2)}


def test_clusters_of_copies_against_brute_force(spark):
    """Groups of copies cost a row each; their pairs and masters are those of plain comparison of all texts."""
    import random

    rng = random.Random(5)
    base = [[rng.choice("abcdefghijklmnop") for _ in range(30)] for _ in range(6)]
    texts = {}
    for i in range(90):
        w = list(base[i % 6])
        if i % 3:  # a third are copies of one text
            for _ in range(rng.choice([0, 1, 2, 6])):
                w[rng.randrange(30)] = rng.choice("xyz")
        else:
            w = list(base[0])
        texts[i] = " ".join(w)
    texts |= {90: "", 91: " , ", 92: None, 93: "one", 94: "One."}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")

    def grams(t):
        w = "".join(c for c in (t or "").lower() if c not in ".,").split()
        return {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()

    sets = {i: grams(t) for i, t in texts.items()}
    like = lambda a, b: bool(sets[a] and sets[b]) and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6
    master = {}
    for i in sorted(sets):
        master[i] = next((m for m in sorted(set(master.values())) if master[m] == m and like(m, i)), i)
    assert {r.doc_id: r.master for r in dedup.clusters(docs, 0.6, 3).collect()} == master
    found = dedup.near_pairs(docs, 0.6, 3).collect()
    cls = {i: i for i in texts} | {r.b: r.a for r in found if r.kind == "member"}
    pairs = {(r.a, r.b) for r in found if r.kind == "pair"}
    want = {(a, b) for a in sets for b in sets if a < b and like(a, b)}
    assert want == {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and (cls[a] == cls[b] or (min(cls[a], cls[b]), max(cls[a], cls[b])) in pairs)}
    assert sum(r.kind == "member" and r.a == 0 for r in found) >= 29
    mapped = dedup.mapping(dedup.clusters(docs, 0.6, 3)).collect()
    assert {(r.master, r.duplicate) for r in mapped} == {(m, i) for i, m in master.items() if i != m}


def test_fuzzy_names_against_every_pair(spark):
    from difflib import SequenceMatcher

    names = ["Green Peace", "Green Piece", "green peace", "Blue", "Bluu", "", None]
    core = ["Green Peace", "Greene Peace", "Blue", "Blues"]
    got = {r.name: (r.core, r.ratio) for r in dedup.fuzzy(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(c,) for c in core], "core string"), 60).collect()}
    want = {}
    for n in names:
        for r, c in [(round(100 * SequenceMatcher(None, n, c).ratio(), 6), c) for c in core] if n is not None else []:
            if r >= 60 and (r, c) > want.get(n, (0, "")):
                want[n] = (r, c)
    assert got == {n: (c, r) for n, (r, c) in want.items()}


def test_text_functions(spark):
    d = spark.createDataFrame([("Příliš Žlutý",)], "t string")
    r = d.select(X.fold("t").alias("a"), X.fold_any("t").alias("b"), X.positions("t", F.lit("l")).alias("p"), F.col("t").rlike(X.inflected("Žlut")).alias("i"), X.edit_ratio(F.lit("abcd"), F.lit("abcx")).alias("e")).first()
    assert (r.a, r.b, r.p, r.i, r.e) == ("Prilis Zluty", "Prilis Zluty", [3, 8], True, 75.0)
    r = spark.range(1).select(X.html_to_text(F.lit("<p>a&amp;lt;b</p><script>x</script>c")).alias("h"), X.prompt_safe(F.lit("a一b, c")).alias("s"), X.readable_name(F.lit("00012_big-news_item.txt")).alias("n"), X.without_header(F.lit("[x]\nbody...")).alias("w"), X.name_stem(F.lit("Arnika")).alias("m")).first()
    assert (r.h, r.s, r.n, r.w, r.m) == ("a<b\n c", "a b, c", "big news item", "body", "arnik") or r.h == "a<b\nc"
    rows = spark.createDataFrame([("partner",), ("xpartner",), ("partnerů",), ("partnerem",)], "t string").filter(F.col("t").rlike(X.ascii_bounded(["partner"]))).collect()
    assert [x.t for x in rows] == ["partner", "partnerů"]
    assert X.declension_root("Zelená domácnostech") == "Zelená domácnost" and X.longest_first(["a", "ABC", "abc"]) == ["ABC", "a"]
    text = "A b. " * 300
    c = spark.createDataFrame([(text,)], "t string").lateralJoin(X.SentenceChunks(F.col("t").outer(), F.lit(400), F.lit(100))).collect()
    assert c[0].start == 0 and all(len(x.chunk) <= 400 for x in c) and all(a.start + len(a.chunk) > b.start for a, b in zip(c, c[1:])) and c[-1].start + len(c[-1].chunk) == len(text)


def test_dates_and_urls(spark):
    one = spark.range(1)
    ld = '<script type="application/ld+json">{"datePublished": "2020-05-06T01:00"}</script>'
    r = one.select(D.parse(F.lit("5. března 2021")).alias("a"), D.parse(F.lit("31.2.2020")).alias("b"), D.full_cascade(F.lit(ld)).alias("c"), D.from_url(F.lit("http://x/2020/3/4/y")).alias("d"), D.only_one(F.lit("on 1. 2. 2020, on 1. 2. 2020"), r"on ([0-9. ]+20[0-9]{2})").alias("e"), D.open_graph(F.lit('<meta property="article:modified_time" content="2021-01-02T">')).alias("f"), D.content(F.lit('<article><p class="date">3.4.2020</p></article>')).alias("g"), D.utc(F.lit("2020-01-01T02:00:00+02:00")).alias("h")).first()
    assert (str(r.a), r.b, r.c.date, r.c.source, r.d, str(r.e), r.f, str(r.g), r.h) == ("2021-03-05", None, "2020-05-06", "json_ld", "2020-03-04", "2020-02-01", "2021-01-02", "2020-04-03", "2020-01-01T00:00:00Z")
    u = F.lit("HTTP://www.Ex.org:80/a/B/?utm_x=1&page=3&sort=d&k_cur=2#f")
    r = one.select(U.host(u).alias("h"), U.canonical(u).alias("c"), U.pagination_depth(u).alias("d"), U.resolved(F.lit("../x"), F.lit("http://e.org/a/b/c")).alias("r"), U.url_key(F.lit("https://www.e.org/a%20b/")).alias("k"), U.in_scope(F.lit("http://sub.e.org/z"), F.array(F.lit("domain:e.org"))).alias("s")).first()
    assert (r.h, r.c, r.d, r.r, r.k, r.s) == ("ex.org:80", "HTTP://www.Ex.org:80/a/B/?page=3&k_cur=2", 3, "http://e.org/a/x", "e.org/a b", True)


def test_edges_add_up(spark, sf):
    t = registry.QUERIES["edges_total"](spark, sf)
    assert t.filter("total_evidence <> collab_evidence + comention_evidence or (has_collaboration = 1) <> (collab_evidence > 0)").count() == 0
    r = edges.deduplicated(spark.createDataFrame([(1, "A", "b", "x"), (2, "B", "a", "x"), (3, "A", "b", "funding"), (4, "b", "A", "funding")], "id int, src string, tgt string, subtype string"))
    assert sorted(x.id for x in r.collect()) == [1, 3, 4]
