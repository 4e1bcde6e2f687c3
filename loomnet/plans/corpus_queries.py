"""Queries over documents and orders: duplicates, names, samples, dates, replies, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomnet.functions import dates as D
from loomnet.functions import jsons as J
from loomnet.functions import text as X
from loomnet.operators import dedup as U
from loomnet.operators import sampling as P


def T(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def docs(s, d):
    return T(s, d, "documents")


def names(s, d):
    return T(s, d, "customer").select(F.concat_ws(" ", "c_mktsegment", "c_name").alias("name")).distinct()


def core(s):
    return s.createDataFrame([("BUILDING Customer#000000001",), ("MACHINERY Customer#000000777",), ("AUTOMOBILE Customer#12",)], "core string")


def text_dates(s, d):
    """Order dates written in four forms and read back; impossible ones stay null."""
    o = T(s, d, "orders").select("o_orderkey", "o_orderdate")
    k = F.col("o_orderkey") % 5
    t = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "d.M.yyyy")).when(k == 2, F.date_format("o_orderdate", "d/M/yyyy")).when(k == 3, "31.2.2001").otherwise(F.concat(F.date_format("o_orderdate", "d"), F.lit(" March "), F.date_format("o_orderdate", "yyyy")))
    return o.select("o_orderkey", F.date_format(D.parse(t), "yyyy-MM-dd").alias("day"), D.in_range(F.date_format("o_orderdate", "yyyy-MM-dd"), "1996-01-01", "1997-12-31").cast("int").alias("in_range"), D.year_bucket(F.date_format("o_orderdate", "yyyy-MM-dd"), 1996, 1998).alias("bucket"))


def cascade(s, d):
    """The date cascade over markup and texts made from orders."""
    day, k = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 5
    html = F.when(k == 0, F.concat(F.lit('<meta property="article:published_time" content="2'), F.substring(day, 2, 9), F.lit('">'))).when(k == 1, F.concat(F.lit('<time class="x" datetime="20'), F.substring(day, 3, 8), F.lit('T00:00">'))).otherwise("<p>none</p>")
    text = F.when(k == 2, F.concat(F.lit("on "), F.date_format("o_orderdate", "d. M."), F.lit(" 2015 at"))).when(k == 4, F.concat(F.lit("dne "), F.date_format("o_orderdate", "d"), F.lit(". BŘEZNA 2016."))).otherwise("on 2016-45-13 or so")
    return T(s, d, "orders").select("o_orderkey", D.cascade(html, text).alias("x")).select("o_orderkey", "x.date", "x.source")


def replies(s, d):
    """Model replies made from events, with thinking blocks and prose around the JSON."""
    k = F.get_json_object("props", "$.k").cast("int")
    label = F.when(k % 3 == 0, "collaboration").when(k % 3 == 1, "co-mention").otherwise("unsure")
    body = F.concat(F.lit('{"label": "'), label, F.lit('", "confidence": "high", "reasoning": "k='), k.cast("string"), F.lit('"}'))
    t = F.when(k % 2 == 0, F.concat(F.lit("<think>{no}</think>Sure: "), body, F.lit(" done"))).when(k % 7 == 0, "no json here").otherwise(body)
    return T(s, d, "events").select("event_id", J.reply(t).alias("r")).select("event_id", "r.label", "r.confidence", "r.reasoning")


QUERIES = {
    "exact_dups": lambda s, d: U.exact(docs(s, d)),
    "near_dup_pairs": lambda s, d: U.near_pairs(docs(s, d), 0.85, 5),
    "dup_clusters": lambda s, d: U.clusters(docs(s, d), 0.6, 3),
    "dup_mapping": lambda s, d: U.mapping(U.clusters(docs(s, d), 0.6, 3)),
    "fuzzy_names": lambda s, d: U.fuzzy(names(s, d), core(s)),
    "actor_kinds": lambda s, d: U.validated(names(s, d), core(s)),
    "folded_text": lambda s, d: docs(s, d).select("doc_id", F.md5(X.fold("text")).alias("h"), X.match_key("text").alias("key")),
    "acronyms": lambda s, d: T(s, d, "part").select("p_partkey", X.acronym("p_name").alias("acronym")).filter("acronym is not null"),
    "token_shingles": lambda s, d: docs(s, d).select("doc_id", F.size(X.tokens("text")).alias("n_words"), F.size(X.shingles(X.tokens("text"), 5)).alias("n_shingles")),
    "contexts": lambda s, d: docs(s, d).select("doc_id", X.context("text", F.lit(100), 40).alias("context")),
    "chunks": lambda s, d: docs(s, d).lateralJoin(X.SentenceChunks(F.col("text").outer(), F.lit(3000), F.lit(1000))).select("doc_id", "idx", "start", F.length("chunk").alias("n_chars")),
    "stratified_sample": lambda s, d: P.stratified(docs(s, d).select("doc_id", "lang"), "lang", "doc_id", 100),
    "per_stratum_sample": lambda s, d: P.per_stratum(docs(s, d).select("doc_id", "source"), "source", "doc_id", 9),
    "random_pages": lambda s, d: P.first_n(T(s, d, "pages").select("page_id", "url"), "page_id", 200),
    "date_roundtrip": text_dates,
    "date_cascade": cascade,
    "json_lenient": replies,
    "token_cost": lambda s, d: T(s, d, "events").select("event_id", J.cost(F.col("user_id") * 10000, F.col("user_id") * 1000, (F.col("event_id") % 100) * 1000, F.lit(0.15), F.lit(0.075), F.lit(0.6)).alias("cost")),
}
_TOK = "list_filter(regexp_split_to_array(regexp_replace(lower(text), '[.,;:!?()|*$%&#\"'']', '', 'g'), '[ \\t\\n\\r\\f]+'), lambda w: w <> '')"
_SH = "shs AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' ')) END) AS s FROM (SELECT doc_id, " + _TOK + " AS w FROM documents) WHERE len(w) > 0)"
_PAIRS = "sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM shs), pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, round(count(*) / (any_value(a.n) + any_value(b.n) - count(*)), 6) AS jaccard FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2)"
_CLASSES = f"cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY w) AS class_id FROM (SELECT doc_id, {_TOK} AS w FROM documents) WHERE len(w) > 0)"
_MD = "md5(concat_ws(':', CAST({k} AS VARCHAR), '1'))"
ORACLE = {
    "exact_dups": "SELECT doc_id, source, hash, first, CAST(first = doc_id AS INTEGER) AS kept, source || '-' || left(hash, 12) AS page_id FROM (SELECT *, min(doc_id) OVER (PARTITION BY source, hash) AS first FROM (SELECT doc_id, source, sha256(text) AS hash FROM documents))",
    "near_dup_pairs": f"WITH {_CLASSES}, {_SH.format(k=5).replace('FROM documents)', 'FROM documents JOIN cls USING (doc_id) WHERE doc_id = class_id)')}, {_PAIRS} SELECT *, 'pair' AS kind FROM pairs WHERE jaccard >= 0.85 UNION ALL SELECT class_id, doc_id, 1.0, 'member' FROM cls WHERE doc_id <> class_id",
    "folded_text": "SELECT doc_id, md5(strip_accents(text)) AS h, trim(regexp_replace(lower(strip_accents(text)), '[ \\t\\n\\r\\f]+', ' ', 'g')) AS key FROM documents",
    "acronyms": "SELECT p_partkey, acronym FROM (SELECT p_partkey, array_to_string(list_transform(list_filter(string_split(regexp_replace(strip_accents(p_name), '[^A-Za-z ]', '', 'g'), ' '), lambda w: length(w) >= 3), lambda w: upper(left(w, 1))), '') AS acronym FROM part) WHERE length(acronym) BETWEEN 2 AND 6",
    "token_shingles": f"WITH {_SH.format(k=5)} SELECT doc_id, CAST(len({_TOK}) AS INTEGER) AS n_words, CAST(coalesce((SELECT len(s) FROM shs WHERE shs.doc_id = documents.doc_id), 0) AS INTEGER) AS n_shingles FROM documents",
    "contexts": "SELECT doc_id, '…' || substring(text, 61, least(length(text), 140) - 60) || CASE WHEN length(text) > 140 THEN '…' ELSE '' END AS context FROM documents",
    "stratified_sample": f"WITH n AS (SELECT lang, greatest(1, CAST(round_even(count(*) / (SELECT count(*) FROM documents) * 100, 0) AS INTEGER)) AS need FROM documents GROUP BY 1) SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_MD.format(k='doc_id')}, doc_id) AS rn FROM documents) JOIN n USING (lang) WHERE rn <= need",
    "per_stratum_sample": f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_MD.format(k='doc_id')}, doc_id) AS rn FROM documents) WHERE rn <= 9",
    "random_pages": f"SELECT page_id, url FROM pages ORDER BY {_MD.format(k='page_id')}, page_id LIMIT 200",
    "date_roundtrip": """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN NULL WHEN 4 THEN strftime(make_date(year(o_orderdate), 3, least(day(o_orderdate), 31)), '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
CAST(o_orderdate >= DATE '1996-01-01' AND CAST(o_orderdate AS DATE) <= DATE '1997-12-31' AS INTEGER) AS in_range, CASE WHEN year(o_orderdate) BETWEEN 1996 AND 1998 THEN CAST(year(o_orderdate) AS VARCHAR) ELSE 'other' END AS bucket FROM orders""",
    "date_cascade": """SELECT o_orderkey, CASE k WHEN 0 THEN CASE WHEN meta THEN '2' || substring(day, 2) ELSE '2016-45-13' END WHEN 1 THEN CASE WHEN tm THEN '20' || substring(day, 3) ELSE '2016-45-13' END WHEN 2 THEN '2015-' || substring(day, 6) WHEN 4 THEN '2016-03-' || substring(day, 9) ELSE '2016-45-13' END AS date,
CASE k WHEN 0 THEN CASE WHEN meta THEN 'meta' ELSE 'text_iso' END WHEN 1 THEN CASE WHEN tm THEN 'time' ELSE 'text_iso' END WHEN 2 THEN 'text_num' WHEN 4 THEN 'text_cz' ELSE 'text_iso' END AS source
FROM (SELECT o_orderkey, o_orderkey % 5 AS k, strftime(o_orderdate, '%Y-%m-%d') AS day, regexp_matches('2' || substring(strftime(o_orderdate, '%Y'), 2), '20[0-2][0-9]') AS meta, regexp_matches('20' || substring(strftime(o_orderdate, '%Y'), 3), '20[0-2][0-9]') AS tm FROM orders)""",
    "json_lenient": """SELECT event_id, CASE WHEN ok THEN CASE k % 3 WHEN 0 THEN 'collaboration' ELSE 'co-mention' END END AS label, CASE WHEN ok THEN 'high' END AS confidence, CASE WHEN ok THEN 'k=' || k END AS reasoning
FROM (SELECT event_id, k, k % 3 < 2 AND (k % 2 = 0 OR k % 7 <> 0) AS ok FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))""",
    "token_cost": "SELECT event_id, round(((user_id * 10000 - user_id * 1000) * 0.15e0 + user_id * 1000 * 0.075e0 + (event_id % 100) * 1000 * 0.6e0) / 1e6, 6) AS cost FROM events",
}
