"""Queries over pages and events: expansion, stores, queues, cooldowns, sessions, imports; prompts and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomnet.functions import text as X
from loomnet.functions import urls as U
from loomnet.operators import crawl as C
from loomnet.operators import ledger as G
from loomnet.operators import links as L
from loomnet.operators import prompts as P
from loomnet.operators import votes as V

from . import evidence_queries as EV
from .page_queries import _CANON, _DEPTH, _LINKS, _SEGS, _host, _key, _path


def T(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def pages(s, d):
    return T(s, d, "pages")


def depths(s, d):
    return pages(s, d).select("page_id", (F.col("page_id") % 4).alias("depth"))


def fetched(s, d):
    """Pages as fetches: every third was fetched before with the same content, every fifth with another."""
    h = F.sha2(F.when(F.col("page_id") % 7 == 0, F.lit("same")).otherwise(F.col("html")), 256)
    k = F.col("page_id")
    return pages(s, d).select(k.alias("id"), U.host("url").alias("org_id"), h.alias("hash"), F.when(k % 3 == 0, h).when(k % 5 == 0, F.lit("other")).alias("old_hash"), F.when(k % 6 != 0, F.lit("p")).alias("old_path"), (k % 5 == 0).cast("int").alias("refetch"))


FETCHED = f"""fetched AS (SELECT page_id AS id, {_host('url')} AS org_id, h AS hash, CASE WHEN page_id % 3 = 0 THEN h WHEN page_id % 5 = 0 THEN 'other' END AS old_hash, CASE WHEN page_id % 6 <> 0 THEN 'p' END AS old_path, CAST(page_id % 5 = 0 AS INTEGER) AS refetch
 FROM (SELECT *, sha256(CASE WHEN page_id % 7 = 0 THEN 'same' ELSE html END) AS h FROM pages))"""


def found(s, d):
    """Links as calls to the first crawler's queue, some of them invalid."""
    x = L.links(pages(s, d)).filter("pos < 6")
    return x.select((F.col("page_id") * 100 + F.col("pos")).alias("id"), F.when(F.col("pos") == 5, "mailto:x").otherwise(F.col("target")).alias("url"), (F.col("page_id") % 5).alias("depth"), F.col("source").alias("parent"), F.when(F.col("pos") == 0, 1).alias("priority"))


_NORMAL = lambda u: f"(lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || regexp_replace(lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), ':(80|443)$', '') || regexp_replace({_path(u)}, '/+$', '') || CASE WHEN regexp_extract({u}, '\\?([^#]*)', 1) <> '' THEN '?' || array_to_string(list_sort(list_filter(string_split(regexp_extract({u}, '\\?([^#]*)', 1), '&'), lambda p: p <> '')), '&') ELSE '' END)"
QUEUE = f"""{_LINKS}, found AS (SELECT page_id * 100 + pos AS id, CASE WHEN pos = 5 THEN 'mailto:x' ELSE target END AS url, page_id % 5 AS depth, source AS parent, CASE WHEN pos = 0 THEN 1 END AS priority FROM links WHERE pos < 6),
n AS (SELECT *, CASE WHEN regexp_matches(url, '(?i)^https?://') THEN {_NORMAL('url')} END AS normal FROM found),
r AS (SELECT *, row_number() OVER (PARTITION BY normal ORDER BY depth > 3, id) AS rn, normal IN (SELECT {_NORMAL('url')} FROM pages) AS old FROM n),
st AS (SELECT *, CASE WHEN normal IS NULL THEN 'skipped_invalid' WHEN old OR rn > 1 THEN 'duplicate' WHEN depth > 3 THEN 'skipped_depth' ELSE 'queued' END AS state FROM r)"""


def queue(s, d):
    return C.queued(found(s, d), pages(s, d).select("url"), 3)


def sessions(s, d):
    k, ts = F.col("event_id"), F.col("ts")
    status = F.when(F.col("event_type").isin("view", "purchase"), "completed").when(F.col("event_type") == "click", "in_progress").when(F.col("event_type") == "signup", "interrupted").otherwise("failed")
    return T(s, d, "events").select(
        k.alias("session_id"), F.when(k % 11 != 0, F.concat(F.lit("org"), (F.col("user_id") % 40).cast("string"))).alias("organization"), status.alias("status"), ts.alias("start_time"),
        F.when(status != "in_progress", ts + F.make_interval(secs=(k % 20000))).alias("end_time"), (k % 500).alias("pages"), (k % 7).alias("errors"),
    )


SESSIONS = """sessions AS (SELECT event_id AS session_id, CASE WHEN event_id % 11 <> 0 THEN 'org' || (user_id % 40) END AS organization, CASE WHEN event_type IN ('view', 'purchase') THEN 'completed' WHEN event_type = 'click' THEN 'in_progress' WHEN event_type = 'signup' THEN 'interrupted' ELSE 'failed' END AS status,
 ts AS start_time, CASE WHEN event_type <> 'click' THEN ts + to_seconds(event_id % 20000) END AS end_time, event_id % 500 AS pages, event_id % 7 AS errors FROM events)"""


def checkpoints(s, d):
    return T(s, d, "events").select((F.col("user_id") % 300).alias("session_id"), F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("value").alias("pages"))


def org_states(s, d):
    """Users as organisations with a state, a cooldown and a seed."""
    e = T(s, d, "events").groupBy(F.col("user_id").alias("org_id")).agg(F.max("ts").alias("last"), F.count("*").alias("n"))
    k = F.col("org_id")
    return e.select("org_id", F.when(k % 3 == 0, "paused").when(k % 3 == 1, "running").otherwise("ready").alias("state"), F.when(k % 2 == 0, F.col("last")).alias("resume_after"), (k % 5 > 0).cast("int").alias("verified"), F.when(k % 4 > 0, F.concat(F.lit("https://o"), k.cast("string"), F.lit(".org"))).otherwise("").alias("seed_url"), "n")


ORGS = """orgs AS (SELECT user_id AS org_id, CASE user_id % 3 WHEN 0 THEN 'paused' WHEN 1 THEN 'running' ELSE 'ready' END AS state, CASE WHEN user_id % 2 = 0 THEN max(ts) END AS resume_after, CAST(user_id % 5 > 0 AS INTEGER) AS verified, CASE WHEN user_id % 4 > 0 THEN 'https://o' || user_id || '.org' ELSE '' END AS seed_url, count(*) AS n FROM events GROUP BY user_id)"""


def candidates(s, d):
    return T(s, d, "events").filter("user_id % 3 < 2").select(F.col("user_id").alias("org_id"), F.concat(F.lit("https://c"), (F.col("event_id") % 9).cast("string"), F.lit(".org")).alias("url"))


def names(s, d):
    return T(s, d, "supplier").select(F.col("s_suppkey").alias("org_id"), F.concat(F.lit("É"), F.col("s_name")).alias("name"))


def urls_status(s, d):
    return L.links(pages(s, d)).select((F.col("page_id") * 100 + F.col("pos")).alias("id"), F.concat("target", F.when(F.col("pos") % 3 == 0, F.concat(F.lit("?page="), (F.col("page_id") * 7).cast("string"))).otherwise("")).alias("url"), F.when(F.col("pos") % 2 == 0, "done").otherwise("failed").alias("status"))


STATUS = f"{_LINKS}, st AS (SELECT page_id * 100 + pos AS id, target || CASE WHEN pos % 3 = 0 THEN '?page=' || (page_id * 7) ELSE '' END AS url, CASE WHEN pos % 2 = 0 THEN 'done' ELSE 'failed' END AS status FROM links)"
_EXC = "coalesce(" + ", ".join(f"CASE WHEN contains(lower(url), '{p}') THEN 'pattern:{p}' END" for p in U.EXCLUDED) + ")"
_TRAP = f"CASE WHEN {_DEPTH} > 100 THEN 'pagination:' || {_DEPTH} END"


def cases(s, d):
    return T(s, d, "labels").join(T(s, d, "documents").select("doc_id", "source", "text", "lang"), "doc_id").select(F.col("doc_id").alias("id"), "source", F.concat(F.lit("to "), "lang").alias("target"), "text")


CASES = "cases AS (SELECT doc_id AS id, source, 'to ' || lang AS target, text FROM labels JOIN documents USING (doc_id))"


def reasoned(s, d):
    return EV.ratings(s, d).withColumn("reasoning", F.when(F.col("id") % 4 > 0, F.concat(F.lit("because\n"), F.col("id").cast("string"), F.lit(" ")))).select("id", "model", "label", "reasoning")


def prompts(s, d):
    x = T(s, d, "documents").select(F.col("doc_id").alias("id"), "source", F.col("lang").alias("target"), (F.col("doc_id") % 10 + 2016).alias("year"), F.lit("an article").alias("article"), F.lit("a; b").alias("keywords"), F.concat(F.when(F.col("doc_id") % 2 == 0, "[✓ head]\n").otherwise(""), F.regexp_replace("text", r"[ \t\n\r\f]+", " ")).alias("text"))
    return P.row_prompts(x, "Is {target} there?").select("id", F.md5("prompt").alias("h"), F.length("prompt").alias("n"))


def datapoints(s, d):
    """Two rows for some ids, the later one of which counts; none for others."""
    x = T(s, d, "labels").filter("doc_id % 3 > 0").select(F.col("doc_id").alias("id"), F.explode(F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("line"))
    return x.withColumn("text", F.concat(F.lit("t"), F.col("line").cast("string"))).withColumn("line", F.col("id") * 10 + F.col("line"))


def articles(s, d):
    return T(s, d, "orders").select(F.year("o_orderdate").alias("year"), (F.col("o_custkey") % 97).alias("article"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).alias("label"))


MODELS = [("a", 0.15, 0.6), ("b", 0.08, 0.3), ("c", 0.05, 0.2)]
MIGRATED = lambda s, d: C.migrated(T(s, d, "supplier").select("s_suppkey", "s_nationkey"), {"doc_id": "string", "flag": "int"}, {"doc_id": F.concat(F.lit("d"), F.col("s_suppkey").cast("string"))})
QUERIES = {
    "frontier_expand": lambda s, d: C.expanded(L.links(pages(s, d)), depths(s, d), 3, "/de/", 2),
    "store_outcomes": lambda s, d: C.stored(fetched(s, d)),
    "page_numbers": lambda s, d: C.numbered(fetched(s, d).select("id", "org_id"), fetched(s, d).filter("id % 4 = 0").groupBy("org_id").agg((F.count("*") * 10).alias("seq"))),
    "queue_rows": lambda s, d: queue(s, d)[0],
    "queue_counters": lambda s, d: queue(s, d)[1],
    "scoped_links": lambda s, d: C.page_links(L.links(pages(s, d)), ["https://m.", "http://www."]),
    "link_dates": lambda s, d: C.with_dates(L.links(pages(s, d)).select("page_id", "target", F.when(F.col("pos") % 2 == 0, "2020-01-01").alias("date"))),
    "saved_pages": lambda s, d: C.saved(pages(s, d)),
    "hashed_names": lambda s, d: pages(s, d).select("page_id", C.hashed_name("url").alias("filename")),
    "file_links": lambda s, d: L.file_links(L.links(pages(s, d)).withColumn("target", F.concat("target", F.when(F.col("pos") % 4 == 0, ".pdf").otherwise("")))).groupBy("page_id").agg(F.count("*").alias("n")),
    "out_of_scope_flags": lambda s, d: C.flagged_scope(urls_status(s, d)),
    "refetch_parts": lambda s, d: C.refetched(urls_status(s, d)).groupBy("part", "why").agg(F.count("*").alias("n")),
    "visited_import": lambda s, d: C.imported(L.links(pages(s, d)).select(U.host("source").alias("org_id"), F.col("target").alias("url"), (F.col("page_id") * 100 + F.col("pos")).alias("id")), pages(s, d).select(U.host("url").alias("org_id"), U.url_key("url").alias("url_key"))),
    "legacy_pages": lambda s, d: C.legacy(pages(s, d).select(F.col("page_id").alias("id"), U.host("url").alias("org_id"), "url", C.hashed_name("url").alias("filename")), _old_links(s, d))[0],
    "legacy_links": lambda s, d: C.legacy(pages(s, d).select(F.col("page_id").alias("id"), U.host("url").alias("org_id"), "url", C.hashed_name("url").alias("filename")), _old_links(s, d))[1],
    "legacy_frontier": lambda s, d: C.legacy(pages(s, d).select(F.col("page_id").alias("id"), U.host("url").alias("org_id"), "url", C.hashed_name("url").alias("filename")), _old_links(s, d))[2],
    "resume_links": lambda s, d: C.resumed_links(L.links(pages(s, d)), pages(s, d)),
    "org_seeds": lambda s, d: C.seeded(names(s, d), T(s, d, "supplier").filter("s_suppkey % 2 = 0").select(F.concat(F.lit("e"), F.upper("s_name")).alias("name"), F.concat(F.lit("https://"), F.col("s_suppkey").cast("string")).alias("url")), X.match_key),
    "seed_fill": lambda s, d: C.filled(org_states(s, d).select("org_id", "seed_url"), candidates(s, d)),
    "cooldowns": lambda s, d: C.cooled(G.streaks(EV.urls(s, d))).select("org_id", "n", "resume_after"),
    "resume_due": lambda s, d: C.due(org_states(s, d), F.lit("2024-01-30 12:00:00").cast("timestamp")).select("org_id", "resume_after"),
    "startable_orgs": lambda s, d: C.startable(org_states(s, d)).select("org_id", "state"),
    "event_tail": lambda s, d: C.tail(T(s, d, "events").select("event_id", "event_type"), 300),
    "log_append": lambda s, d: C.logged(T(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("message")), T(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("message"))).select("id", F.md5("message").alias("h")),
    "field_updates": lambda s, d: C.updated(T(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), T(s, d, "nation").filter("n_nationkey % 3 = 0").select("n_nationkey", F.lit("x").alias("n_name"), F.lit(99).cast("int").alias("n_regionkey")), "n_nationkey", ["n_name"]),
    "schema_migration": MIGRATED,
    "session_list": lambda s, d: C.sessions(sessions(s, d), None, "completed", 50).select("session_id", "organization"),
    "sessions_resumable": lambda s, d: C.resumable(sessions(s, d)).select("session_id", "status"),
    "sessions_deleted": lambda s, d: (lambda t: t[0].agg(F.count("*").alias("sessions")).crossJoin(t[1].agg(F.count("*").alias("checkpoints"))))(C.without(sessions(s, d).filter("session_id < 300"), checkpoints(s, d), sessions(s, d).filter("status = 'failed'"))),
    "session_summaries": lambda s, d: C.summaries(sessions(s, d)),
    "session_stats": lambda s, d: C.session_stats(sessions(s, d)),
    "session_orgs": lambda s, d: C.organizations(sessions(s, d)),
    "last_checkpoints": lambda s, d: C.last_checkpoints(checkpoints(s, d)).select("session_id", "id"),
    "crawler_state": lambda s, d: C.snapshot_state(pages(s, d).select(U.host("url").alias("org_id")), queue(s, d)[0].select(U.host("url").alias("org_id"), F.col("priority").cast("int"), F.col("depth").cast("int"), "url")),
    "row_prompts": prompts,
    "texts_by_id": lambda s, d: P.with_texts(cases(s, d).drop("text"), datapoints(s, d)),
    "judge_messages": lambda s, d: P.judge_messages(cases(s, d), reasoned(s, d)).select("id", F.length("message").alias("n"), F.md5(F.split_part("message", F.lit("<ratings>"), F.lit(2))).alias("h")),
    "judge_ties": lambda s, d: P.ties(V.majority(EV.ratings(s, d)), T(s, d, "labels").filter("doc_id % 5 = 0").select(F.col("doc_id").alias("id"), F.lit("wrong").alias("judge_label"))),
    "judge_calibration": lambda s, d: P.calibration(V.majority(EV.ratings(s, d))).select("id", "agreement", "consensus"),
    "build_stats": lambda s, d: P.build_stats(articles(s, d)),
    "dry_run_cost": lambda s, d: P.dry_run(articles(s, d), s.createDataFrame(MODELS, "model string, price_in double, price_out double")),
    "export_rows": lambda s, d: P.export(articles(s, d), [1995, 1996], True, ["year", "article", "label", "llm_model"]).groupBy("year", "label", "llm_model").agg(F.count("*").alias("n")),
}


def _old_links(s, d):
    return L.links(pages(s, d)).select((F.col("page_id") * 100 + F.col("pos")).alias("id"), U.host("source").alias("org_id"), F.concat("target", F.when(F.col("pos") == 1, ".pdf").otherwise("")).alias("target"))


_OLD = f"{_LINKS}, old AS (SELECT page_id * 100 + pos AS id, {_host('source')} AS org_id, target || CASE WHEN pos = 1 THEN '.pdf' ELSE '' END AS target FROM links)"
_COUNTED = f"{_OLD}, counted AS (SELECT org_id, target, count(*) AS occurrences, min(id) AS first_seen, max(CAST(regexp_matches({_path('target')}, '(?i)\\.(pdf|docx?|xlsx?|pptx?|odt|rtf)$') AS INTEGER)) AS is_file FROM old GROUP BY 1, 2)"
_SLUG = f"CASE WHEN trim(regexp_replace(lower({_path('url')}), '[^a-z0-9]+', '_', 'g'), '_') = '' THEN 'index' ELSE left(trim(regexp_replace(lower({_path('url')}), '[^a-z0-9]+', '_', 'g'), '_'), 80) END"
ORACLE = {
    "frontier_expand": f"""WITH {_LINKS}, raw2 AS (SELECT l.page_id, l.pos, l.source AS parent, {_host('l.source')} AS org_id, l.target AS url, l.page_id % 4 + 1 AS depth FROM links l WHERE link_type = 'internal'),
c AS (SELECT page_id, pos, parent, org_id, depth, {_CANON} AS url FROM raw2), k AS (SELECT *, {_key('url')} AS url_key FROM c QUALIFY row_number() OVER (PARTITION BY org_id, {_key('url')} ORDER BY page_id, pos) = 1),
w AS (SELECT *, coalesce({_EXC}, CASE WHEN contains({_path('url')}, '/de/') THEN 'path:/de/' WHEN {_DEPTH} > 2 THEN 'pagination:' || {_DEPTH} END, CASE WHEN depth > 3 THEN 'max_depth' END) AS reason FROM k)
SELECT org_id, url, url_key, CASE WHEN reason IS NULL THEN 'pending' ELSE 'excluded' END AS status, reason, 'link' AS source, depth, parent FROM w""",
    "store_outcomes": f"""WITH {FETCHED}, o AS (SELECT *, CASE WHEN old_hash = hash AND old_path IS NOT NULL THEN 'unchanged' WHEN row_number() OVER (PARTITION BY org_id, hash ORDER BY id) > 1 THEN 'duplicate_content' WHEN refetch = 1 THEN 'changed' ELSE 'new' END AS outcome FROM fetched)
SELECT id, org_id, outcome, CASE WHEN outcome IN ('changed', 'new') THEN CAST(count(*) FILTER (outcome IN ('changed', 'new')) OVER (PARTITION BY org_id ORDER BY id) AS BIGINT) ELSE 0 END AS seq FROM o""",
    "page_numbers": f"WITH {FETCHED} SELECT id, org_id, coalesce(10 * (SELECT nullif(count(*), 0) FROM fetched g WHERE g.org_id = f.org_id AND g.id % 4 = 0), 0) + row_number() OVER (PARTITION BY org_id ORDER BY id) AS seq FROM fetched f",
    "queue_rows": f"WITH {QUEUE} SELECT coalesce(priority, 3) AS priority, depth, normal AS url, parent FROM st WHERE state = 'queued'",
    "queue_counters": f"WITH {QUEUE} SELECT " + ", ".join(f"count(*) FILTER (state = '{n}') AS {n}" for n in ("queued", "duplicate", "skipped_invalid", "skipped_depth", "skipped_max_pages")) + " FROM st",
    "scoped_links": f"WITH {_LINKS} SELECT page_id, target, CAST(starts_with(target, 'https://m.') OR starts_with(target, 'http://www.') AS INTEGER) AS in_scope, CASE WHEN regexp_matches({_path('target')}, '(?i)\\.(pdf|docx?|xlsx?|pptx?|odt|rtf)$') THEN 0 ELSE 3 END AS priority FROM links WHERE {_EXC.replace('lower(url)', 'lower(target)')} IS NULL",
    "link_dates": f"WITH {_LINKS} SELECT page_id, target, CASE WHEN pos % 2 = 0 THEN '2020-01-01' ELSE 'N/A' END AS date FROM links",
    "saved_pages": f"""WITH h AS (SELECT page_id, url, {_host('url')} AS org, sha256(html) AS hash FROM pages), k AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY org, hash ORDER BY page_id) = 1)
SELECT page_id, org, lpad(CAST(row_number() OVER (PARTITION BY org ORDER BY page_id) AS VARCHAR), 5, '0') || '_' || {_SLUG} || '.html' AS filename, hash FROM k""",
    "hashed_names": "SELECT page_id, left(md5(url), 12) || '.html' AS filename FROM pages",
    "file_links": f"WITH {_LINKS}, f AS (SELECT DISTINCT page_id, target || CASE WHEN pos % 4 = 0 THEN '.pdf' ELSE '' END AS target FROM links) SELECT page_id, count(*) AS n FROM f WHERE regexp_matches({_path('target')}, '(?i)\\.(pdf|docx?|xlsx?|pptx?|odt|rtf)$') GROUP BY page_id",
    "out_of_scope_flags": f"WITH {STATUS} SELECT *, CAST(coalesce({_DEPTH} > 100, false) AND status = 'done' AS INTEGER) AS out_of_scope FROM st",
    "refetch_parts": f"WITH {STATUS}, p AS (SELECT *, coalesce({_EXC}, {_TRAP}) AS reason FROM st) SELECT CASE WHEN status = 'done' AND reason IS NOT NULL THEN 'demoted' WHEN status = 'done' THEN 'pending' ELSE 'left' END AS part, CASE WHEN status = 'done' THEN reason END AS why, count(*) AS n FROM p GROUP BY 1, 2",
    "visited_import": f"WITH {_LINKS}, f AS (SELECT {_host('source')} AS org_id, target AS url, {_key('target')} AS url_key FROM links QUALIFY row_number() OVER (PARTITION BY {_host('source')}, {_key('target')} ORDER BY page_id * 100 + pos) = 1) SELECT org_id, url, url_key, 'pending' AS status, 1 AS refetch FROM f WHERE (org_id, url_key) NOT IN (SELECT ({_host('url')}, {_key('url')}) FROM pages)",
    "legacy_pages": f"SELECT {_host('url')} AS org_id, {_key('url')} AS url_key, arg_min(url, page_id) AS url, arg_min(left(md5(url), 12) || '.html', page_id) AS filename, count(*) AS n FROM pages GROUP BY 1, 2",
    "legacy_links": f"WITH {_COUNTED} SELECT * FROM counted",
    "legacy_frontier": f"WITH {_COUNTED} SELECT org_id, {_key('target')} AS url_key, min(target) AS url FROM counted WHERE is_file = 0 AND {_host('target')} = org_id AND (org_id, {_key('target')}) NOT IN (SELECT ({_host('url')}, {_key('url')}) FROM pages) GROUP BY 1, 2",
    "resume_links": f"WITH {_LINKS}, t AS (SELECT {_host('source')} AS org_id, {_key('target')} AS url_key, min(target) AS url FROM links WHERE link_type = 'internal' GROUP BY 1, 2) SELECT * FROM t WHERE (org_id, url_key) NOT IN (SELECT ({_host('url')}, {_key('url')}) FROM pages)",
    "org_seeds": "SELECT s_suppkey AS org_id, 'É' || s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'https://' || s_suppkey END AS seed_url FROM supplier",
    "seed_fill": f"WITH {ORGS}, c AS (SELECT user_id AS org_id, min('https://c' || (event_id % 9) || '.org') AS candidate FROM events WHERE user_id % 3 < 2 GROUP BY 1) SELECT org_id, CASE WHEN seed_url = '' THEN candidate ELSE seed_url END AS seed_url, CAST(seed_url = '' AND candidate IS NOT NULL AS INTEGER) AS filled FROM orgs LEFT JOIN c USING (org_id)",
    "resume_due": f"WITH {ORGS} SELECT org_id, resume_after FROM orgs WHERE state = 'paused' AND resume_after <= TIMESTAMP '2024-01-30 12:00:00'",
    "startable_orgs": f"WITH {ORGS} SELECT org_id, state FROM orgs WHERE verified = 1 AND seed_url <> '' AND state IN ('new', 'ready', 'paused', 'error')",
    "event_tail": "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 300",
    "log_append": "SELECT n_nationkey AS id, md5(n_name) AS h FROM nation UNION ALL SELECT doc_id, md5(left(text, 300)) FROM documents",
    "field_updates": "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'x' ELSE n_name END AS n_name, n_regionkey FROM nation",
    "schema_migration": "SELECT s_suppkey, s_nationkey, 'd' || s_suppkey AS doc_id, CAST(NULL AS INTEGER) AS flag FROM supplier",
    "session_list": f"WITH {SESSIONS} SELECT session_id, organization FROM sessions WHERE status = 'completed' ORDER BY start_time DESC, session_id DESC LIMIT 50",
    "sessions_resumable": f"WITH {SESSIONS} SELECT session_id, status FROM sessions WHERE status IN ('in_progress', 'interrupted')",
    "sessions_deleted": f"WITH {SESSIONS}, bad AS (SELECT session_id FROM sessions WHERE status = 'failed') SELECT (SELECT count(*) FROM sessions WHERE session_id < 300 AND session_id NOT IN (SELECT * FROM bad)) AS sessions, (SELECT count(*) FROM events WHERE user_id % 300 NOT IN (SELECT * FROM bad)) AS checkpoints",
    "session_summaries": f"""WITH {SESSIONS}, s AS (SELECT *, CAST(floor(epoch(end_time)) - floor(epoch(start_time)) AS BIGINT) AS sec FROM sessions)
SELECT session_id, 'Session: ' || session_id || chr(10) || 'Status: ' || status || chr(10) || 'Organization: ' || coalesce(organization, 'All') || chr(10) || 'Duration: ' || CASE WHEN end_time IS NULL THEN 'In progress' ELSE (sec // 3600) || 'h ' || ((sec % 3600) // 60) || 'm' END || chr(10) || 'Pages: ' || pages || chr(10) || 'Errors: ' || errors AS summary FROM s""",
    "session_stats": f"WITH {SESSIONS} SELECT organization, count(*) AS sessions, count(*) FILTER (status = 'completed') AS completed, CAST(sum(pages) AS BIGINT) AS pages, max(start_time) AS last_scrape, max(start_time) FILTER (status = 'completed') AS last_success FROM sessions GROUP BY 1",
    "session_orgs": f"WITH {SESSIONS} SELECT DISTINCT organization FROM sessions WHERE organization IS NOT NULL",
    "last_checkpoints": "SELECT user_id % 300 AS session_id, arg_max(event_id, (ts, event_id)) AS id FROM events GROUP BY 1",
    "row_prompts": """SELECT id, md5(p) AS h, length(p) AS n FROM (SELECT doc_id AS id, 'Publisher: ' || source || chr(10) || 'Mentioned: ' || lang || chr(10) || 'Year: ' || (doc_id % 10 + 2016) || chr(10) || 'Article: an article' || chr(10) || 'Keywords: a; b' || chr(10) || chr(10) || '<excerpt>' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN rtrim(x, ' ') ELSE trim(x, ' ') END || chr(10) || '</excerpt>' || chr(10) || chr(10) || 'Is ' || lang || ' there?' || chr(10) || chr(10) || 'Answer with one JSON object and nothing else.' AS p
 FROM (SELECT *, regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g') AS x FROM documents))""",
    "texts_by_id": f"WITH {CASES} SELECT id, source, target, CASE WHEN id % 3 = 0 THEN '' WHEN id % 2 = 0 THEN 't2' ELSE 't1' END AS text, CAST(id % 3 = 0 AS INTEGER) AS missing FROM cases",
    "judge_ties": f"WITH {EV.VOTES} SELECT * FROM votes WHERE majority_label IS NULL AND id % 5 <> 0",
    "judge_calibration": f"WITH {EV.VOTES} SELECT id, agreement, majority_label AS consensus FROM votes WHERE agreement IN ('4/0', '3/1') QUALIFY row_number() OVER (PARTITION BY agreement ORDER BY md5(concat_ws(':', CAST(id AS VARCHAR), '42')), id) <= 9",
    "judge_messages": f"""WITH {EV.RATINGS}, {CASES}, r AS (SELECT id, string_agg('Rater ' || i || ' label: ' || upper(coalesce(label, '?')) || chr(10) || 'Rater ' || i || ' reason: ' || reason || chr(10) || chr(10), '' ORDER BY i) AS lines FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY model) AS i, CASE WHEN id % 4 > 0 THEN 'because ' || id ELSE '' END AS reason FROM ratings) GROUP BY id)
SELECT id, length('Publisher: ' || source || chr(10) || 'Mentioned: ' || target || chr(10) || chr(10) || '<excerpt>' || chr(10) || text || chr(10) || '</excerpt>' || chr(10) || chr(10) || '<ratings>' || chr(10) || lines || t) AS n, md5(chr(10) || lines || t) AS h
FROM (SELECT *, '</ratings>' || chr(10) || chr(10) || 'Weigh the ratings and give the final label and your reason as JSON.' AS t FROM cases JOIN r USING (id))""",
    "cooldowns": f"SELECT org_id, n, last + to_seconds(pause_s) AS resume_after FROM ({EV.ORACLE['fail_streaks']})",
    "crawler_state": f"""WITH {QUEUE}, q AS (SELECT {_host('normal')} AS org_id, count(*) AS queued, arg_min(normal, (coalesce(priority, 3), depth, normal)) AS next FROM st WHERE state = 'queued' GROUP BY 1), v AS (SELECT {_host('url')} AS org_id, count(*) AS visited FROM pages GROUP BY 1)
SELECT org_id, '{{"visited":' || coalesce(visited, 0) || ',"queued":' || coalesce(queued, 0) || coalesce(',"next":"' || next || '"', '') || '}}' AS state FROM v FULL JOIN q USING (org_id)""",
    "build_stats": "SELECT coalesce(CAST(y AS VARCHAR), 'ALL') AS year, articles, pairs, round(pairs * (550 * 0.15e0 + 150 * 0.60e0) / 1e6, 6) AS cost, round(pairs * 1.5e0 / 3600, 4) AS hours FROM (SELECT year(o_orderdate) AS y, count(DISTINCT o_custkey % 97) AS articles, count(*) AS pairs FROM orders GROUP BY ROLLUP (y))",
    "dry_run_cost": f"SELECT coalesce(model, 'TOTAL') AS model, round(sum((SELECT count(*) FROM orders) * (pi * 1050e0 + po * 150e0) / 1e6), 6) AS cost FROM (VALUES {', '.join(str(m) for m in MODELS)}) AS v(model, pi, po) GROUP BY ROLLUP (model)",
    "export_rows": "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS label, CAST(NULL AS VARCHAR) AS llm_model, count(*) AS n FROM orders WHERE o_orderkey % 3 > 0 AND year(o_orderdate) IN (1995, 1996) GROUP BY 1, 2",
}
