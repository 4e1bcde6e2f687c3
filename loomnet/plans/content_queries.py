"""Queries over pages, suppliers and edges: date filters, extraction, templates, the dictionary of organisations, relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomnet.functions import dates as D
from loomnet.functions import markup as M
from loomnet.functions import text as X
from loomnet.functions import urls as U
from loomnet.operators import content as C
from loomnet.operators import dedup as UD
from loomnet.operators import edges as E
from loomnet.operators import links as L
from loomnet.operators import orgs as O

from . import evidence_queries as EV
from .page_queries import _SIGS, _host, _html


def T(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def pages(s, d):
    return T(s, d, "pages")


def framed(s, d):
    """Pages whose article stands beside a menu, a block of links and a footer, all made from the page itself."""
    body = F.regexp_extract("html", r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)
    head = F.regexp_replace(body, r"<[^>]*>|[^A-Za-z ]", "")
    k = F.col("page_id")
    filler = F.repeat(F.lit("some words of the article that go on "), 8)
    day = F.concat(F.lit("2021-0"), (k % 9 + 1).cast("string"), F.lit("-1"), (k % 10).cast("string"))
    return T(s, d, "pages").select(
        "page_id", "url", F.concat(F.lit("<html><body><div class='top-menu'>menu</div><div class=\"links\"><a href=/a>first link</a><a href=/b>second link</a></div><div class=\""), F.when(k % 2 == 0, "entry-content").otherwise("plain"), F.lit("\"><p class=content>"), filler, head, F.lit("</p>"),
        F.when(k % 3 == 0, F.concat(F.lit("<p class='content'><span class=published><time datetime=\""), day, F.lit("\">x</time></span></p>"))).when(k % 3 == 1, F.concat(F.lit("<p>Published: "), (k % 28 + 1).cast("string"), F.lit(". 5. 2020</p>"))).otherwise(""),
        F.lit("</div><footer class=footer>contact</footer></body></html>")).alias("html"), head.alias("head"),
    )


_HEAD = "regexp_replace(regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1), '<[^>]*>|[^A-Za-z ]', '', 'g')"
_FILL = "repeat('some words of the article that go on ', 8)"
_DAY = "'2021-0' || (page_id % 9 + 1) || '-1' || (page_id % 10)"
_SQUASH = lambda x: f"trim(regexp_replace({x}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"
_ARTICLE = f"{_FILL} || {_HEAD} || CASE page_id % 3 WHEN 0 THEN ' x' WHEN 1 THEN ' Published: ' || (page_id % 28 + 1) || '. 5. 2020' ELSE '' END"


def page_dates(s, d):
    """Files with dates: some without a page, some without a date, some out of range."""
    k = F.col("page_id")
    texts = pages(s, d).select(k.alias("file"), U.host("url").alias("org"))
    dates = pages(s, d).filter("page_id % 7 > 0").select(k.alias("file"), F.when(k % 5 > 0, F.concat((k % 15 + 2010).cast("string"), F.lit("-03-04"))).alias("date"), F.lit("meta").alias("source"))
    return C.dated(texts, dates, "2016-01-01", "2025-12-31")


_DATED = f"""dated AS (SELECT page_id AS file, {_host('url')} AS org, CASE WHEN page_id % 7 > 0 AND page_id % 5 > 0 THEN (page_id % 15 + 2010) || '-03-04' END AS date, CASE WHEN page_id % 7 > 0 THEN 'meta' END AS source,
 CASE WHEN page_id % 7 = 0 THEN 'no_html' WHEN page_id % 5 = 0 THEN 'no_date' WHEN page_id % 15 + 2010 NOT BETWEEN 2016 AND 2025 THEN 'out_of_range: ' || (page_id % 15 + 2010) || '-03-04' END AS reason FROM pages)"""


def rescue(s, d):
    date = F.when(F.col("page_id") % 2 == 0, F.concat((F.col("page_id") % 15 + 2010).cast("string"), F.lit("-03-04")))
    html = F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit(" 2025 "))).otherwise(F.replace("html", F.lit("2025"), F.lit("")))
    return pages(s, d).select("page_id", C.rescued(date, html, "2016-01-01", "2025-12-31").cast("int").alias("kept"))


def years(s, d):
    texts = pages(s, d).select(F.col("page_id").alias("file"))
    return C.by_year(texts, pages(s, d).filter("page_id % 3 > 0").select(F.col("page_id").alias("file"), F.concat(F.lit("p"), "page_id").alias("html_file"), F.concat((F.col("page_id") % 15 + 2010).cast("string"), F.lit("-03-04")).alias("date")))


def synthesized(s, d):
    k = F.col("page_id")
    name = lambda end: F.concat(F.lit("f"), k.cast("string"), F.lit(end)).alias("file")
    p = pages(s, d)
    return C.synthesized(p.select(name(".txt")), p.filter("page_id % 3 = 0").select(name(".html")), p.filter("page_id % 2 = 0").select(name(".htm")))


def site_dates(s, d):
    """The rules of single sites over framed pages."""
    h = F.col("html")
    return framed(s, d).select("page_id", C.FIXES["time_in_content"](h).alias("in_content"), C.FIXES["published"](h).alias("published"), C.FIXES["only_one"](h).alias("only_one"), C.FIXES["iso_only_one"](h).alias("iso_only_one"), M.date_by_context("html").alias("by_context"))


def refiled(fix):
    def run(s, d):
        """One host's pages are filed again by its own rule."""
        p = framed(s, d).select(F.col("page_id").alias("file"), F.when(F.col("page_id") % 4 == 0, "a").otherwise("b").alias("org"), "html")
        return C.refiled(p.select("file", "org", F.lit("2016").alias("year")), p, "a", fix)

    return run


_REFILED = lambda y: f"SELECT page_id AS file, 'b' AS org, '2016' AS year FROM pages WHERE page_id % 4 <> 0 UNION ALL SELECT file, 'a', y FROM (SELECT page_id AS file, {y} AS y FROM pages WHERE page_id % 4 = 0) WHERE y IS NOT NULL"


def orgs(s, d):
    k = F.col("s_suppkey")
    return T(s, d, "supplier").select(k.alias("org_id"), F.when(k % 3 == 0, F.concat(F.lit("Čistý "), "s_name", F.lit(" - a unit"))).when(k % 3 == 1, F.concat(F.lit("Nesehnutí"), k.cast("string"), F.lit("ae"))).otherwise(F.concat(F.lit("Svaz [old] pro Les "), k.cast("string"))).alias("name"), F.concat(F.lit("https://www."), F.when(k % 2 == 0, "host").otherwise("abc"), k.cast("string"), F.lit(".org/x")).alias("seed_url"))


KNOWN = {"Nesehnuti1ae": [("Nesehnut", "ci"), ("NESE", "cs")]}
MANUAL = {"2": [("ŠEVER", "cs"), ("Svaz pro les 2", "ci")]}


def dictionary(s, d):
    return O.patterns(orgs(s, d), KNOWN, MANUAL, noise=("host4",), collisions=("SEVER",))


DICTIONARY = """o AS (SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'cisty ' || lower(s_name) WHEN 1 THEN 'nesehnuti' || s_suppkey || 'ae' ELSE 'svaz pro les ' || s_suppkey END AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'host' ELSE 'abc' END || s_suppkey AS token FROM supplier),
raw AS (SELECT id AS org_id, 100 AS k, name AS text, 'ci' AS mode, 'fullname' AS kind FROM o UNION ALL SELECT id, 200, regexp_replace(name, '[aeiouy]{1,2}$', ''), 'ci', 'stem' FROM o WHERE NOT contains(name, ' ')
 UNION ALL SELECT id, 300, token, 'ci', 'domain' FROM o UNION ALL SELECT * FROM (VALUES (1, 0, 'Nesehnut', 'ci', 'thesis'), (1, 1, 'NESE', 'cs', 'thesis'), (2, 400, 'SEVER', 'cs', 'manual'), (2, 401, 'Svaz pro les 2', 'ci', 'manual'))),
one AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY org_id, lower(text), mode ORDER BY k) = 1),
kept AS (SELECT * FROM one WHERE kind = 'thesis' OR text <> 'host4'),
risk AS (SELECT org_id, CASE WHEN bool_or(upper(text) = 'SEVER' OR mode = 'ci' AND length(text) <= 5 AND NOT contains(text, ' ')) THEN 'HIGH' WHEN bool_or(kind = 'thesis') THEN 'validated' ELSE 'review' END AS risk FROM kept GROUP BY 1)"""


def initials(s, d):
    return T(s, d, "part").select("p_partkey", O.initials(F.concat("p_name", F.lit(", s Ústav"))).alias("a"))


def legal_names(s, d):
    k = F.col("s_suppkey")
    return T(s, d, "supplier").select(k.alias("ord"), F.concat(F.lit("Spolek "), (k % 9).cast("string"), F.lit(" Ochrana"), F.when(k % 2 == 0, F.lit(" z.s.")).when(k % 3 == 0, F.lit(", o.s.")).otherwise("")).alias("name"))


LEGAL = "legal AS (SELECT s_suppkey AS ord, 'Spolek ' || (s_suppkey % 9) || ' Ochrana' AS bare, 'Spolek ' || (s_suppkey % 9) || ' Ochrana' || CASE WHEN s_suppkey % 2 = 0 THEN ' z.s.' WHEN s_suppkey % 3 = 0 THEN ', o.s.' ELSE '' END AS name FROM supplier)"


def relations(s, d):
    return EV.pairs(s, d).groupBy("src", "tgt", "label").agg(F.count("*").alias("weight")).select(F.concat(F.lit("n"), "src").alias("src"), F.concat(F.lit("n"), "tgt").alias("tgt"), F.coalesce("label", F.lit("other")).alias("type"), F.col("weight").cast("long").alias("weight"))


def tiered(s, d):
    kinds = T(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("name"), F.when(F.col("n_nationkey") % 4 == 0, "core").when(F.col("n_nationkey") % 4 == 1, "fuzzy").when(F.col("n_nationkey") % 7 == 2, "short").otherwise("extended").alias("kind"))
    return O.tiered(relations(s, d), kinds)


_CORE = lambda x: f"coalesce(CAST(substr({x}, 2) AS INTEGER) % 4 < 2, false)"
_SHORT = lambda x: f"(CAST(substr({x}, 2) AS INTEGER) % 4 >= 2 AND CAST(substr({x}, 2) AS INTEGER) % 7 = 2)"
TIERED = f"""{EV.PAIRS}, rel AS (SELECT 'n' || src AS src, 'n' || tgt AS tgt, coalesce(label, 'other') AS type, count(*) AS weight FROM pairs GROUP BY 1, 2, 3),
tiered AS (SELECT *, CAST(tier <> 'invalid' AS INTEGER) AS valid FROM (SELECT *, CASE WHEN {_SHORT('src')} OR {_SHORT('tgt')} THEN 'invalid' WHEN {_CORE('src')} AND {_CORE('tgt')} THEN 'core' WHEN {_CORE('src')} OR {_CORE('tgt')} THEN 'extended' ELSE 'snowball' END AS tier FROM rel))"""


def network(s, d):
    e = E.merged(relations(s, d).filter("src <> tgt").withColumn("context", F.lit("c")).withColumn("method", F.lit("m")), directed=("wrong",))
    core = T(s, d, "nation").filter("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("node"))
    return O.network_stats(e, E.node_degrees(e, core))


NETWORK = f"""{EV.PAIRS}, rel AS (SELECT DISTINCT 'n' || src AS src, 'n' || tgt AS tgt, coalesce(label, 'other') AS type FROM pairs WHERE src <> tgt), m AS (SELECT DISTINCT CASE WHEN type = 'wrong' THEN src ELSE least(src, tgt) END AS a, CASE WHEN type = 'wrong' THEN tgt ELSE greatest(src, tgt) END AS b, type FROM rel),
deg AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM m UNION ALL SELECT b FROM m) GROUP BY 1)"""

QUERIES = {
    "date_filter": page_dates,
    "date_filter_report": lambda s, d: C.date_report(page_dates(s, d)),
    "undated_rescue": rescue,
    "split_by_year": years,
    "metadata_synthesis": synthesized,
    "conservative_extract": lambda s, d: C.extracted(pages(s, d)).groupBy("status").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")),
    "main_content": lambda s, d: C.extracted(framed(s, d), "main"),
    "without_furniture": lambda s, d: framed(s, d).select("page_id", M.without_furniture("html").alias("text")),
    "site_dates": site_dates,
    "refile_content": refiled("time_in_content"),
    "refile_published": refiled("published"),
    "refile_only_one": refiled("only_one"),
    "refile_iso": refiled("iso_only_one"),
    "template_analysis": lambda s, d: C.templates(pages(s, d)),
    "cleaned_corpus": lambda s, d: C.cleaned_corpus(pages(s, d), U.host("url"))[1].select("doc_id", "is_duplicate"),
    "page_dates_urls": lambda s, d: pages(s, d).select("page_id", D.from_url(F.concat("url", F.lit("/2021/"), (F.col("page_id") % 12 + 1).cast("string"), F.lit("/7/"))).alias("a"), D.from_url(F.concat(F.lit("https://x.org/n-2020-1-"), (F.col("page_id") % 28 + 1).cast("string"))).alias("b")),
    "page_dates_layers": lambda s, d: layers(s, d),
    "org_dictionary": dictionary,
    "org_initials": initials,
    "name_variations": lambda s, d: O.variations(legal_names(s, d)),
    "name_join": lambda s, d: O.joined_by_name(T(s, d, "nation").select(F.concat(F.lit(" É "), "n_name").alias("name"), "n_nationkey"), T(s, d, "nation").select(F.lower(F.concat(F.lit("e  "), "n_name")).alias("name"), F.col("n_nationkey").alias("id"))).select("n_nationkey", "other"),
    "tie_types": lambda s, d: relations(s, d).select("src", "tgt", "type", O.tie_type(F.when(F.col("type") == "wrong", "funding_ties").when(F.col("type") == "collaboration", "collaboration_ties").otherwise("none")).alias("k")),
    "relation_tiers": tiered,
    "validation_stats": lambda s, d: O.validation_stats(tiered(s, d)),
    "network_stats": network,
    "link_edges": lambda s, d: O.link_edges(EV.total(s, d).select("src", "tgt", F.col("collab_evidence").alias("n")), EV.total(s, d).select(F.col("tgt").alias("org_a"), F.col("src").alias("org_b"), F.col("comention_evidence").alias("weight"))),
    "prompt_safe_text": lambda s, d: T(s, d, "documents").select("doc_id", F.md5(X.prompt_safe(F.concat("text", F.lit(" →☃ ok")))).alias("h")),
    "readable_names": lambda s, d: pages(s, d).select("page_id", X.readable_name(F.concat(U.slug("url", F.col("page_id")), F.lit(".txt"))).alias("name")),
    "stripped_headers": lambda s, d: T(s, d, "documents").select("doc_id", F.md5(X.without_header(F.concat(F.lit("[x ~ y]\n…"), "text"))).alias("h")),
    "file_safe_names": lambda s, d: pages(s, d).select("page_id", U.sanitized("url").alias("name")),
}


def layers(s, d):
    """Pages with a date in linked data, its graph, OpenGraph, a meta tag or the content."""
    k = F.col("page_id")
    day = F.concat(F.lit("2019-0"), (k % 9 + 1).cast("string"), F.lit("-2"), (k % 9).cast("string"))
    html = (
        F.when(k % 5 == 0, F.concat(F.lit('<script type="application/ld+json">{"datePublished": "'), day, F.lit('T10:00"}</script>')))
        .when(k % 5 == 1, F.concat(F.lit('<script type="application/ld+json">{"@graph": [{"a": 1}, {"dateModified": "'), day, F.lit('"}]}</script>')))
        .when(k % 5 == 2, F.concat(F.lit('<meta property="article:published_time" content="'), day, F.lit('T01:02:03Z">')))
        .when(k % 5 == 3, F.concat(F.lit('<meta name="pubdate" content="'), day, F.lit('">')))
        .otherwise(F.concat(F.lit('<article><span class="post-date"> '), (k % 28 + 1).cast("string"), F.lit(". 4. 2018 </span></article>")))
    )
    return pages(s, d).select("page_id", D.full_cascade(html).alias("x")).select("page_id", "x.date", "x.source")


ORACLE = {
    "date_filter": f"WITH {_DATED} SELECT *, CAST(reason IS NULL AS INTEGER) AS kept FROM dated",
    "date_filter_report": f"WITH {_DATED} SELECT org, count(*) AS total, count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason = 'no_html') AS no_html, count(*) FILTER (reason = 'no_date') AS no_date, count(*) FILTER (starts_with(reason, 'out_of_range')) AS out_of_range FROM dated GROUP BY org",
    "undated_rescue": "SELECT page_id, CAST(CASE WHEN page_id % 2 = 0 THEN page_id % 15 + 2010 BETWEEN 2016 AND 2025 ELSE page_id % 3 = 0 END AS INTEGER) AS kept FROM pages",
    "split_by_year": "SELECT page_id AS file, CASE WHEN page_id % 3 > 0 THEN 'p' || page_id END AS html_file, CASE WHEN page_id % 3 = 0 OR page_id % 15 + 2010 NOT BETWEEN 2016 AND 2025 THEN 'other' ELSE CAST(page_id % 15 + 2010 AS VARCHAR) END AS year FROM pages",
    "metadata_synthesis": "SELECT 'f' || page_id || '.txt' AS file, CASE WHEN page_id % 3 = 0 THEN 'f' || page_id || '.html' WHEN page_id % 2 = 0 THEN 'f' || page_id || '.htm' END AS html_file, CASE WHEN page_id % 3 = 0 THEN 'manifest' WHEN page_id % 2 = 0 THEN 'disk' ELSE 'none' END AS found FROM pages",
    "conservative_extract": f"WITH x AS (SELECT {_html(('script', 'style', 'noscript'), True)} AS text FROM pages) SELECT CASE WHEN length(text) > 50 THEN 'ok' ELSE 'too_short' END AS status, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM x GROUP BY 1",
    "main_content": f"SELECT page_id, {_SQUASH('x')} AS text, 'ok' AS status FROM (SELECT page_id, {_ARTICLE} AS x FROM pages)",
    "refile_content": _REFILED("CASE WHEN page_id % 3 = 0 THEN '2021' END"),
    "refile_published": _REFILED("CASE WHEN page_id % 3 = 0 THEN '2021' END"),
    "refile_only_one": _REFILED("CASE WHEN page_id % 3 = 1 THEN '2020' END"),
    "refile_iso": _REFILED("CASE WHEN page_id % 3 = 0 THEN '2021' END"),
    "site_dates": f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN {_DAY} END AS in_content, CASE WHEN page_id % 3 = 0 THEN {_DAY} END AS published, CASE WHEN page_id % 3 = 1 THEN '2020-05-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') END AS only_one, CASE WHEN page_id % 3 = 0 THEN {_DAY} END AS iso_only_one, CASE WHEN page_id % 3 = 1 THEN '2020-05-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') END AS by_context FROM pages",
    "template_analysis": f"""WITH {_SIGS}, seg AS (SELECT page_id, coalesce(list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')[1], '') AS section FROM pages), size AS (SELECT section, count(*) AS n FROM seg GROUP BY 1 HAVING count(*) >= 10),
a AS (SELECT '*' AS scope, sig, count(*) AS df FROM sigs GROUP BY sig HAVING count(*) >= greatest((SELECT floor(count(*) * 0.8) FROM pages), 1) UNION ALL SELECT section, sig, df FROM (SELECT section, sig, count(*) AS df FROM sigs JOIN seg USING (page_id) GROUP BY 1, 2) JOIN size USING (section) WHERE df >= floor(n * 0.8))
SELECT *, CAST({" OR ".join(f"contains(lower(sig), '{w}')" for w in M.SAFE)} AS INTEGER) AS safe FROM a""",
    "page_dates_urls": "SELECT page_id, '2021-' || lpad(CAST(page_id % 12 + 1 AS VARCHAR), 2, '0') || '-07' AS a, '2020-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS b FROM pages",
    "page_dates_layers": "SELECT page_id, CASE WHEN page_id % 5 = 4 THEN '2018-04-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') ELSE '2019-0' || (page_id % 9 + 1) || '-2' || (page_id % 9) END AS date, CASE page_id % 5 WHEN 0 THEN 'json_ld' WHEN 1 THEN 'json_ld' WHEN 2 THEN 'open_graph' WHEN 3 THEN 'meta' ELSE 'content' END AS source FROM pages",
    "org_dictionary": f"WITH {DICTIONARY} SELECT org_id, k AS ord, text, mode, kind, risk FROM kept JOIN risk USING (org_id)",
    "org_initials": f"SELECT p_partkey, CASE WHEN len(w) >= 2 AND length(a) BETWEEN 2 AND 6 THEN a END AS a FROM (SELECT p_partkey, w, array_to_string(list_transform(list_filter(w, lambda x: regexp_matches(x, '^[A-Za-z]')), lambda x: upper(left(x, 1))), '') AS a FROM (SELECT p_partkey, list_filter(regexp_split_to_array(strip_accents(p_name || ', s Ústav'), '[\\s,-]+'), lambda x: x <> '' AND lower(x) NOT IN {O.MINOR}) AS w FROM part))",
    "name_variations": f"WITH {LEGAL}, v AS (SELECT ord, name, unnest(list_distinct([lower(name), CASE WHEN contains(name, ',') THEN lower(bare) || ',' WHEN name <> bare THEN lower(bare) END, 'spolek', CASE WHEN name = bare THEN 'ochrana' END])) AS variation FROM legal) SELECT variation, arg_max(name, ord) AS name FROM v WHERE variation IS NOT NULL GROUP BY 1",
    "name_join": "SELECT n_nationkey, n_nationkey AS other FROM nation",
    "tie_types": f"WITH {TIERED} SELECT src, tgt, type, CASE type WHEN 'wrong' THEN 3 WHEN 'collaboration' THEN 1 ELSE 0 END AS k FROM rel",
    "relation_tiers": f"WITH {TIERED} SELECT * FROM tiered",
    "validation_stats": f"WITH {TIERED} SELECT tier AS name, count(*) AS n, CAST(sum(valid) AS BIGINT) AS valid, 'tier' AS of FROM tiered GROUP BY 1 UNION ALL SELECT type, count(*), CAST(sum(valid) AS BIGINT), 'type' FROM tiered GROUP BY 1",
    "network_stats": f"""WITH {NETWORK}, a AS (SELECT (SELECT count(*) FROM deg) AS n, (SELECT count(*) FROM m) AS e, (SELECT avg(degree) FROM deg) AS md)
SELECT 'nodes' AS name, CAST(n AS DOUBLE) AS value FROM a UNION ALL SELECT 'edges', e FROM a UNION ALL SELECT 'mean_degree', round(md, 6) FROM a UNION ALL SELECT 'density', round(2.0e0 * e / (n * (n - 1)), 6) FROM a
UNION ALL SELECT 'type:' || type, count(*) FROM m GROUP BY type UNION ALL SELECT 'tier:' || CASE WHEN CAST(substr(node, 2) AS INTEGER) % 2 = 0 THEN 'core' ELSE 'snowball' END, count(*) FROM deg GROUP BY 1""",
    "link_edges": f"WITH {EV.TOTAL} SELECT src, tgt, 'direct' AS method, collab_evidence AS weight FROM total UNION ALL SELECT tgt, src, 'shared', comention_evidence FROM total",
    "readable_names": f"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(x || '.txt', '^[0-9]+_', ''), '\\.[a-z]{{2,4}}$', ''), '[_-]+', ' ', 'g')) AS name FROM (SELECT page_id, lpad(CAST(page_id AS VARCHAR), 5, '0') || '_' || CASE WHEN s = '' THEN 'index' ELSE left(s, 80) END AS x FROM (SELECT page_id, trim(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)), '[^a-z0-9]+', '_', 'g'), '_') AS s FROM pages))",
    "stripped_headers": "SELECT doc_id, md5(text) AS h FROM documents",
    "file_safe_names": "SELECT page_id, left(regexp_replace(url, '[<>:\"/\\\\|?*]', '_', 'g'), 200) AS name FROM pages",
    "prompt_safe_text": "SELECT doc_id, md5(regexp_replace(text || ' →☃ ok', '[^\\x{0}-\\x{4FF}\\p{Po}\\p{Pd}\\p{Ps}\\p{Pe}\\p{Zs}]', ' ', 'g')) AS h FROM documents",
    "without_furniture": f"SELECT page_id, {_SQUASH('x')} AS text FROM (SELECT page_id, {_ARTICLE} AS x FROM pages)",
}
