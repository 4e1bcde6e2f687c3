"""Queries over the star schema, labels and events: edges, votes, ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomnet.operators import edges as E
from loomnet.operators import ledger as L
from loomnet.operators import votes as V


def T(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def pairs(s, d):
    """Labelled directed pairs: a shipment is evidence from the supplier's nation to the customer's. Small sides are left to AQE, which broadcasts them by size."""
    x = T(s, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_shipdate").join(T(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    x = x.join(T(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(T(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    label = F.when(F.col("l_returnflag") == "R", "collaboration").when(F.col("l_returnflag") == "A", "co-mention").when(F.year("l_shipdate") > 1996, "wrong")
    return x.select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("tgt"), F.year("l_shipdate").alias("year"), label.alias("label"))


PAIRS = """pairs AS (SELECT s_nationkey AS src, c_nationkey AS tgt, CAST(year(l_shipdate) AS INTEGER) AS year, CASE WHEN l_returnflag = 'R' THEN 'collaboration' WHEN l_returnflag = 'A' THEN 'co-mention' WHEN year(l_shipdate) > 1996 THEN 'wrong' END AS label
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey)"""
YEARLY = f"""{PAIRS}, yearly AS (SELECT *, collab_evidence + comention_evidence AS total_evidence, CAST(collab_evidence > 0 AS INTEGER) AS has_collaboration FROM (
SELECT src, tgt, year, count(*) FILTER (label = 'collaboration') AS collab_evidence, count(*) FILTER (label = 'co-mention') AS comention_evidence FROM pairs WHERE label IN ('collaboration', 'co-mention') GROUP BY 1, 2, 3))"""
TOTAL = f"""{YEARLY}, total AS (SELECT *, CAST(collab_evidence > 0 AS INTEGER) AS has_collaboration FROM (SELECT src, tgt, array_to_string(list_sort(list(CAST(year AS VARCHAR))), ';') AS years_active, count(DISTINCT year) AS n_years,
CAST(sum(collab_evidence) AS BIGINT) AS collab_evidence, CAST(sum(comention_evidence) AS BIGINT) AS comention_evidence, CAST(sum(total_evidence) AS BIGINT) AS total_evidence FROM yearly GROUP BY 1, 2))"""


def nodes(s, d):
    return T(s, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_nationkey").alias("ord"))


def total(s, d):
    return E.total(E.yearly(pairs(s, d)))


def graph(s, d):
    """Edges where collaboration outweighs mention."""
    return total(s, d).filter("collab_evidence > comention_evidence and src <> tgt").select("src", "tgt")


GRAPH = f"{TOTAL}, graph AS (SELECT src, tgt FROM total WHERE collab_evidence > comention_evidence AND src <> tgt)"


def ratings(s, d):
    """Four deterministic raters of each labelled document."""
    x = T(s, d, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic").crossJoin(s.createDataFrame([(k, f"m{k}") for k in range(4)], "k int, model string"))
    h = (F.col("id") * 7 + F.col("k") * 13 + F.col("quality") * 3) % 11
    label = F.when(h < 5, "collaboration").when(h < 9, "co-mention").otherwise("wrong")
    status = F.when((F.col("id") + F.col("k")) % 17 == 0, "ERROR").otherwise("coded")
    return x.select("id", "model", status.alias("status"), F.when(status == "coded", label).alias("label"), (F.col("id") % 1000 + 100).alias("prompt_tokens"), (F.col("id") % 90 + F.col("k")).alias("completion_tokens"), F.round((F.col("id") % 1000 + 100) * 0.15 / 1e6, 6).alias("cost_usd"))


RATINGS = """ratings AS (SELECT id, model, status, CASE WHEN status = 'coded' THEN label END AS label, id % 1000 + 100 AS prompt_tokens, id % 90 + k AS completion_tokens, round((id % 1000 + 100) * 0.15 / 1e6, 6) AS cost_usd FROM (
SELECT id, k, 'm' || k AS model, CASE WHEN (id + k) % 17 = 0 THEN 'ERROR' ELSE 'coded' END AS status, CASE WHEN h < 5 THEN 'collaboration' WHEN h < 9 THEN 'co-mention' ELSE 'wrong' END AS label
FROM (SELECT doc_id AS id, k, (doc_id * 7 + k * 13 + quality * 3) % 11 AS h FROM labels, (VALUES (0), (1), (2), (3)) AS r(k)))), coded AS (SELECT * FROM ratings WHERE status = 'coded')"""
VOTES = f"""{RATINGS}, per AS (SELECT id, label, count(*) AS k FROM coded GROUP BY 1, 2), top AS (SELECT id, CAST(sum(k) AS BIGINT) AS n, max(k) AS most FROM per GROUP BY id),
votes AS (SELECT top.id, n AS n_raters, most || '/' || (n - most) AS agreement, CASE WHEN most * 2 > n THEN (SELECT min(label) FROM per WHERE per.id = top.id AND k = most) END AS majority_label FROM top)"""


def judge(s, d):
    return T(s, d, "labels").filter("doc_id % 5 = 0").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "wrong").when(F.col("doc_id") % 2 == 0, "collaboration").alias("judge_label"), F.when(F.col("quality") == 1, "high").otherwise("low").alias("confidence"), F.lit("collaboration").alias("consensus"))


JUDGE = "judge AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'wrong' WHEN doc_id % 2 = 0 THEN 'collaboration' END AS judge_label, CASE WHEN quality = 1 THEN 'high' ELSE 'low' END AS confidence, 'collaboration' AS consensus FROM labels WHERE doc_id % 5 = 0)"


def urls(s, d):
    """The events as a URL ledger: users are orgs, event types statuses."""
    status = F.when(F.col("event_type") == "view", "done").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "excluded").when(F.col("event_type") == "click", "pending").otherwise("in_progress")
    k = F.get_json_object("props", "$.k").cast("int")
    error = F.when(k % 4 == 0, "HTTP 404").when(k % 4 == 1, "HTTP 503 from upstream").when(k % 4 == 2, "read timeout").otherwise("reset by peer")
    reason = F.when(k % 2 == 0, F.concat(F.lit("redirect:"), k.cast("string"))).otherwise("pattern:/login")
    return T(s, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("org_id"), F.concat(F.lit("u"), k.cast("string")).alias("url"), status.alias("status"), F.when(status == "failed", error).alias("error"), F.when(status == "excluded", reason).alias("reason"), F.col("ts").alias("fetched_at"), (k % 3).alias("depth"), (k % 2).alias("refetch"), F.concat(F.lit("h"), F.floor("value").cast("string")).alias("hash"))


URLS = """u0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events), u1 AS (SELECT event_id AS id, user_id AS org_id, 'u' || k AS url, CASE event_type WHEN 'view' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'excluded' WHEN 'click' THEN 'pending' ELSE 'in_progress' END AS status, ts AS fetched_at, k, k % 3 AS depth, k % 2 AS refetch, 'h' || CAST(floor(value) AS BIGINT) AS hash FROM u0),
urls AS (SELECT *, CASE WHEN status = 'failed' THEN CASE k % 4 WHEN 0 THEN 'HTTP 404' WHEN 1 THEN 'HTTP 503 from upstream' WHEN 2 THEN 'read timeout' ELSE 'reset by peer' END END AS error, CASE WHEN status = 'excluded' THEN CASE WHEN k % 2 = 0 THEN 'redirect:' || k ELSE 'pattern:/login' END END AS reason FROM u1)"""
_S = "".join(f", count(*) FILTER (status = '{x}') AS {x}" for x in L.STATUS)
LATEST = f"{URLS}, latest AS (SELECT org_id, url, id, hash, fetched_at FROM urls QUALIFY row_number() OVER (PARTITION BY org_id, url ORDER BY fetched_at DESC, id DESC) = 1)"


def merged_edges(s, d):
    t = total(s, d)
    a = t.select("src", "tgt", F.lit("collaboration").alias("type"), F.col("collab_evidence").alias("weight"), F.concat(F.lit("c"), F.col("n_years").cast("string")).alias("context"), F.lit("text").alias("method"))
    b = t.filter("n_years > 6").select("src", "tgt", F.when(F.col("src") % 2 == 0, "funding").otherwise("collaboration").alias("type"), F.col("comention_evidence").alias("weight"), F.lit("link").alias("context"), F.lit("link").alias("method"))
    return E.merged(a, b)


MERGED = f"""{TOTAL}, lists AS (SELECT src, tgt, 'collaboration' AS type, collab_evidence AS weight, 'c' || n_years AS context, 'text' AS method FROM total UNION ALL SELECT src, tgt, CASE WHEN src % 2 = 0 THEN 'funding' ELSE 'collaboration' END, comention_evidence, 'link', 'link' FROM total WHERE n_years > 6),
merged AS (SELECT CASE WHEN type = 'funding' THEN src ELSE least(src, tgt) END AS a, CASE WHEN type = 'funding' THEN tgt ELSE greatest(src, tgt) END AS b, type, CAST(sum(weight) AS BIGINT) AS weight, array_to_string(list_sort(list_distinct(list(context)))[1:3], '|') AS contexts, array_to_string(list_sort(list_distinct(list(method))), '|') AS methods, CASE WHEN count(DISTINCT method) = 1 THEN min(method) ELSE 'mixed' END AS origin FROM lists GROUP BY 1, 2, 3)"""


def core(s, d):
    return T(s, d, "nation").filter("n_regionkey < 2").select(F.col("n_nationkey").alias("node"))


def matrix(s, d):
    m = E.matrix(graph(s, d), nodes(s, d))
    return m.select("src", *(F.col(f"`{c}`").alias(f"n{c}") for c in m.columns if c != "src"))


def merged_matrix(s, d):
    y = E.yearly(pairs(s, d)).filter("collab_evidence > comention_evidence")
    return E.either(*(E.cells(y.filter(F.col("year") == k), nodes(s, d)) for k in (1996, 1997, 1998))).filter("v = 1")


QUERIES = {
    "edges_yearly": lambda s, d: E.yearly(pairs(s, d)),
    "edges_total": total,
    "edge_rates": lambda s, d: E.rated(pairs(s, d)),
    "year_summary": lambda s, d: E.year_summary(pairs(s, d)),
    "graph_edges": graph,
    "matrix_wide": matrix,
    "matrix_long": lambda s, d: E.unpivoted(matrix(s, d)).withColumn("v", F.col("v").cast("int")),
    "matrix_merge": merged_matrix,
    "merged_edges": merged_edges,
    "merged_degrees": lambda s, d: E.node_degrees(merged_edges(s, d), core(s, d)),
    "core_edges": lambda s, d: E.within(merged_edges(s, d), core(s, d)).select("a", "b", "type", "weight"),
    "extended_edges": lambda s, d: E.touching(merged_edges(s, d), core(s, d)).select("a", "b", "type", "weight"),
    "majority_vote": lambda s, d: V.majority(ratings(s, d)),
    "agreement_dist": lambda s, d: V.distribution(V.majority(ratings(s, d))),
    "label_maps": lambda s, d: V.label_maps(ratings(s, d)).select("id", F.array_join(F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("labels")),
    "fleiss_kappa": lambda s, d: V.kappa(ratings(s, d)),
    "cost_rollup": lambda s, d: V.costs(ratings(s, d)),
    "max_agreement": lambda s, d: V.max_agreement(ratings(s, d)),
    "judge_override": lambda s, d: V.judged(V.majority(ratings(s, d)), judge(s, d)),
    "judge_summary": lambda s, d: V.judge_summary(judge(s, d).filter("judge_label is not null")),
    "rater_todo": lambda s, d: V.todo(T(s, d, "labels").select(F.col("doc_id").alias("id")), ratings(s, d).filter("model = 'm1'")),
    "dataset_check": lambda s, d: V.unique_check(T(s, d, "documents").select(F.col("source").alias("id"), "text")),
    "status_counts": lambda s, d: L.status_counts(urls(s, d)),
    "status_pivot": lambda s, d: L.status_pivot(urls(s, d)),
    "org_stats": lambda s, d: L.org_stats(urls(s, d), urls(s, d).filter("status = 'done'")),
    "global_stats": lambda s, d: L.global_stats(urls(s, d)),
    "last_activity": lambda s, d: L.last_activity(urls(s, d)),
    "fail_classes": lambda s, d: L.failure_classes(urls(s, d)),
    "top_errors": lambda s, d: L.top_errors(urls(s, d)),
    "exclusion_classes": lambda s, d: L.exclusion_classes(urls(s, d)),
    "audit_coverage": lambda s, d: L.coverage(urls(s, d)),
    "latest_snapshot": lambda s, d: L.latest(urls(s, d)),
    "deleted_content": lambda s, d: L.deleted(urls(s, d), urls(s, d).filter("status = 'done'")),
    "unchanged_content": lambda s, d: L.unchanged(urls(s, d)),
    "fail_streaks": lambda s, d: L.streaks(urls(s, d)),
    "claim_next": lambda s, d: L.claims(urls(s, d)),
    "frontier_antijoin": lambda s, d: L.new_urls(urls(s, d).filter("id % 2 = 1").withColumnRenamed("url", "url_key").withColumn("url", F.col("url_key")), urls(s, d).filter("id % 2 = 0").withColumnRenamed("url", "url_key")),
    "requeue": lambda s, d: L.requeued(urls(s, d).withColumn("is_hub", F.col("depth") == 0), "hubs").select("id", "status", "refetch"),
    "finish_urls": lambda s, d: L.finished(urls(s, d), urls(s, d).filter("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, "done").alias("status"), F.lit(None).cast("string").alias("error"), F.lit("new").alias("hash"))).select("id", "status", "error", "hash", "refetch"),
    "flagged_orgs": lambda s, d: L.flagged(urls(s, d), 60),
}
ORACLE = {
    "edges_yearly": f"WITH {YEARLY} SELECT * FROM yearly",
    "edges_total": f"WITH {TOTAL} SELECT * FROM total",
    "edge_rates": f"WITH {PAIRS} SELECT *, round(n_collab / n_articles, 4) AS rate, CAST(n_collab > 0 AS INTEGER) AS has_edge FROM (SELECT src, tgt, count(*) AS n_articles, count(*) FILTER (label = 'collaboration') AS n_collab, count(*) FILTER (label = 'co-mention') AS n_comention, count(*) FILTER (label = 'wrong') AS n_wrong, count(*) FILTER (label IS NULL) AS n_uncoded FROM pairs GROUP BY 1, 2)",
    "year_summary": f"WITH {PAIRS} SELECT *, total - coded AS uncoded, CASE WHEN coded > 0 THEN round(collaboration / coded, 4) ELSE 0 END AS rate FROM (SELECT year, count(*) AS total, count(label) AS coded, count(*) FILTER (label = 'collaboration') AS collaboration, count(*) FILTER (label = 'co-mention') AS comention, count(*) FILTER (label = 'wrong') AS wrong FROM pairs GROUP BY 1)",
    "graph_edges": f"WITH {GRAPH} SELECT * FROM graph",
    "matrix_wide": f"WITH {GRAPH} SELECT n_nationkey AS src, {', '.join(f'CAST(EXISTS (SELECT 1 FROM graph WHERE src = n_nationkey AND tgt = {k}) AS INTEGER) AS n{k}' for k in range(25))} FROM nation",
    "matrix_long": f"WITH {GRAPH} SELECT a.n_nationkey AS src, 'n' || b.n_nationkey AS tgt, CAST(g.src IS NOT NULL AS INTEGER) AS v FROM nation a CROSS JOIN nation b LEFT JOIN graph g ON g.src = a.n_nationkey AND g.tgt = b.n_nationkey",
    "matrix_merge": f"WITH {YEARLY} SELECT src, tgt, 1 AS v FROM yearly WHERE collab_evidence > comention_evidence AND src <> tgt AND year IN (1996, 1997, 1998) GROUP BY 1, 2",
    "merged_edges": f"WITH {MERGED} SELECT * FROM merged",
    "merged_degrees": f"WITH {MERGED} SELECT node, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS strength, count(*) FILTER (type = 'funding') AS n_funding, count(*) FILTER (type = 'collaboration') AS n_collab, CASE WHEN node IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2) THEN 'core' ELSE 'snowball' END AS tier FROM (SELECT unnest([a, b]) AS node, type, weight FROM merged) GROUP BY node",
    "core_edges": f"WITH {MERGED}, core AS (SELECT n_nationkey AS n FROM nation WHERE n_regionkey < 2) SELECT a, b, type, weight FROM merged WHERE a IN (FROM core) AND b IN (FROM core)",
    "extended_edges": f"WITH {MERGED}, core AS (SELECT n_nationkey AS n FROM nation WHERE n_regionkey < 2) SELECT a, b, type, weight FROM merged WHERE a IN (FROM core) OR b IN (FROM core)",
    "majority_vote": f"WITH {VOTES} SELECT * FROM votes",
    "agreement_dist": f"WITH {VOTES} SELECT agreement, count(*) AS n FROM votes GROUP BY 1",
    "label_maps": f"WITH {RATINGS} SELECT id, string_agg(model || '=' || label, ',' ORDER BY model) AS labels FROM coded GROUP BY id",
    "fleiss_kappa": f"""WITH {VOTES}, item AS (SELECT id, sum(k) AS n, sum(k * (k - 1)) AS same FROM per GROUP BY id), whole AS (SELECT * FROM item WHERE n = (SELECT max(n) FROM item)),
o AS (SELECT count(*) AS n_items, avg(same / (n * (n - 1))) AS observed FROM whole), e AS (SELECT sum(k * k) / (sum(k) * sum(k)) AS expected FROM (SELECT label, sum(k) AS k FROM per WHERE id IN (SELECT id FROM whole) GROUP BY label))
SELECT n_items, round(observed, 6) AS observed, round(expected, 6) AS expected, round((observed - expected) / (1 - expected), 6) AS kappa FROM o, e""",
    "cost_rollup": f"WITH {RATINGS} SELECT coalesce(model, 'all') AS model, count(*) FILTER (status = 'coded') AS coded, count(*) FILTER (status = 'ERROR') AS errors, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, round(sum(cost_usd), 4) AS cost_usd FROM ratings GROUP BY ROLLUP (model)",
    "max_agreement": f"WITH {VOTES} SELECT most AS identical, count(*) AS n FROM top GROUP BY 1",
    "judge_override": f"WITH {VOTES}, {JUDGE} SELECT votes.*, judge_label, coalesce(judge_label, majority_label) AS final_label FROM votes LEFT JOIN judge USING (id)",
    "judge_summary": f"WITH {JUDGE} SELECT judge_label, confidence, count(*) AS n, round(avg(CAST(judge_label = consensus AS INTEGER)), 6) AS accuracy FROM judge WHERE judge_label IS NOT NULL GROUP BY 1, 2",
    "rater_todo": f"WITH {RATINGS} SELECT doc_id AS id FROM labels WHERE doc_id NOT IN (SELECT id FROM coded WHERE model = 'm1')",
    "dataset_check": "SELECT count(*) - count(DISTINCT source) AS duplicate_ids, count(*) FILTER (trim(text) = '') AS empty, round(avg(length(text)), 6) AS mean_chars FROM documents",
    "status_counts": f"WITH {URLS} SELECT org_id {_S}, count(*) AS total FROM urls GROUP BY 1",
    "status_pivot": f"WITH {URLS} SELECT org_id {_S} FROM urls GROUP BY 1",
    "org_stats": f"WITH {URLS} SELECT org_id {_S}, count(*) AS total, count(*) FILTER (status = 'done') AS pages, max(fetched_at) AS last_activity FROM urls GROUP BY 1",
    "global_stats": f"WITH {URLS} SELECT status, count(*) AS n FROM urls GROUP BY 1",
    "last_activity": f"WITH {URLS} SELECT org_id, max(fetched_at) AS last_activity FROM urls GROUP BY 1",
    "fail_classes": f"WITH {URLS} SELECT CASE WHEN error LIKE 'HTTP 4%' THEN 'client' WHEN error LIKE 'HTTP 5%' THEN 'server' WHEN error LIKE '%timeout%' THEN 'timeout' ELSE 'other' END AS class, count(*) AS n FROM urls WHERE status = 'failed' GROUP BY 1",
    "top_errors": f"WITH {URLS} SELECT left(error, 40) AS error, count(*) AS n FROM urls WHERE status = 'failed' GROUP BY 1 ORDER BY n DESC, error LIMIT 5",
    "exclusion_classes": f"WITH {URLS} SELECT CASE WHEN reason LIKE 'redirect:%' THEN 'redirect' ELSE reason END AS reason, count(*) AS n FROM urls WHERE status = 'excluded' GROUP BY 1",
    "audit_coverage": f"WITH {URLS} SELECT org_id, count(*) AS discovered, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status IN ('pending', 'in_progress')) AS backlog, count(*) FILTER (status = 'excluded') AS excluded, round(100.0 * count(*) FILTER (status = 'done') / count(*), 2) AS done_pct FROM urls GROUP BY 1",
    "latest_snapshot": f"WITH {LATEST} SELECT * FROM latest",
    "deleted_content": f"WITH {URLS}, good AS (SELECT * FROM urls WHERE status = 'done' QUALIFY row_number() OVER (PARTITION BY org_id, url ORDER BY fetched_at DESC, id DESC) = 1) SELECT org_id, url, id, hash, fetched_at FROM good WHERE (org_id, url) IN (SELECT (org_id, url) FROM urls WHERE status = 'failed')",
    "unchanged_content": f"WITH {URLS} SELECT id, CAST(coalesce(lag(hash) OVER (PARTITION BY org_id, url ORDER BY fetched_at, id) = hash, false) AS INTEGER) AS unchanged FROM urls",
    "fail_streaks": f"""WITH {URLS}, x AS (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY fetched_at, id) - row_number() OVER (PARTITION BY org_id, status = 'failed' ORDER BY fetched_at, id) AS island FROM urls)
SELECT org_id, count(*) AS n, min(fetched_at) AS first, max(fetched_at) AS last, least(30 * count(*), 180) AS pause_s FROM x WHERE status = 'failed' GROUP BY org_id, island HAVING count(*) >= 3""",
    "claim_next": f"WITH {URLS} SELECT org_id, id FROM urls WHERE status = 'pending' QUALIFY row_number() OVER (PARTITION BY org_id ORDER BY refetch, depth, id) = 1",
    "frontier_antijoin": f"WITH {URLS} SELECT org_id, url AS url_key, url, min(id) AS id FROM urls a WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM urls b WHERE b.id % 2 = 0 AND b.org_id = a.org_id AND b.url = a.url) GROUP BY 1, 2, 3",
    "requeue": f"WITH {URLS} SELECT id, CASE WHEN status = 'done' AND depth = 0 OR status IN ('failed', 'in_progress') THEN 'pending' ELSE status END AS status, CAST(status = 'done' AND depth = 0 AS INTEGER) AS refetch FROM urls",
    "finish_urls": f"WITH {URLS} SELECT id, CASE WHEN id % 6 = 0 THEN 'done' ELSE status END AS status, error, CASE WHEN id % 3 = 0 THEN 'new' ELSE hash END AS hash, CASE WHEN id % 6 = 0 THEN 0 ELSE refetch END AS refetch FROM urls",
    "flagged_orgs": f"WITH {URLS} SELECT org_id, count(*) AS n FROM urls GROUP BY 1 HAVING count(*) >= 60",
}
