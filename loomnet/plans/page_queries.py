"""Queries over pages: text, links, URLs, templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomnet.functions import text as X
from loomnet.functions import urls as U
from loomnet.operators import links as L


def T(s, d):
    return s.read.parquet(f"{d}/pages.parquet")


def found(s, d):
    return L.links(T(s, d))


def url_parts(s, d):
    u = F.col("url")
    return T(s, d).select("page_id", U.scheme(u).alias("scheme"), U.host(u).alias("host"), U.path(u).alias("path"), U.query(u).alias("query"), U.url_key(u).alias("key"), U.normalize(u).alias("normal"), U.normalize(u, True).alias("normal_https"), U.resource_key(u).alias("resource"), U.path_prefix(u, 1).alias("section"), U.domain_token(u).alias("token"), U.default_scope(u).alias("scope"))


def url_flags(s, d):
    u = F.col("url")
    b = lambda c: c.cast("int")
    return T(s, d).select(
        "page_id", U.canonical(u).alias("canonical"), F.coalesce(U.pagination_depth(u), F.lit(0)).alias("depth"), b(U.is_hub(u)).alias("hub"), U.trap_reason(u, F.lit("/de/"), 2).alias("trap"), U.exclusion_reason(u).alias("excluded"), b(U.is_internal(u, F.lit("example.com"))).alias("internal"), b(U.is_binary_noise(u)).alias("noise"), U.file_extension(u).alias("extension"),
        U.priority(u, ["/en/"], ["/fr/", "/de/"], ["page="]).alias("priority"), U.slug(u, F.col("page_id")).alias("slug"), b(U.in_scope(u, F.array(F.lit("domain:example.com"), F.lit("prefix:m.")))).alias("in_scope"),
    )


def canonical_twins(s, d):
    """Pages whose canonical URL an earlier page has."""
    from pyspark.sql import Window

    c = T(s, d).select("page_id", U.host("url").alias("org"), U.url_key(U.canonical(F.col("url"))).alias("key"))
    w = Window.partitionBy("org", "key").orderBy("page_id")
    return c.withColumn("rn", F.row_number().over(w)).select("page_id", "org", F.when(F.col("rn") > 1, "canonical_duplicate").otherwise("kept").alias("state"))


def direct(s, d):
    pages = T(s, d)
    owners = pages.select(U.host("url").alias("host")).distinct().withColumn("org", F.regexp_replace("host", r"^[^.]*\.", ""))
    # pages here link within their host only; links between hosts come from rewriting targets to the next page's host
    far = L.links(pages).withColumn("target", F.when(F.col("pos") % 3 == 0, F.concat(F.lit("https://"), F.lit("m.ththth.example.net"), U.path("target"))).otherwise(F.col("target")))
    return L.direct(far, owners)


def odd(s, d):
    """Pages whose anchors have other attributes first, single quotes and upper case, and meta tags in any order."""
    html = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("html", r'<a href="([^"]*)"', r"<A class=k rel=x HREF = '$1'")).otherwise(F.col("html"))
    return T(s, d).withColumn("html", F.concat(html, F.lit('<meta content="about '), F.col("page_id").cast("string"), F.lit("\" NAME=Description><META property='og:title' content='t'>")))


QUERIES = {
    "html_text": lambda s, d: T(s, d).select("page_id", X.html_to_text("html").alias("text")),
    "html_body": lambda s, d: T(s, d).select("page_id", X.body_text("html").alias("text")),
    "html_key_text": lambda s, d: T(s, d).select("page_id", F.md5(X.key_text("html")).alias("h")),
    "page_metadata": lambda s, d: L.metadata(T(s, d)),
    "url_parts": url_parts,
    "url_flags": url_flags,
    "canonical_twins": canonical_twins,
    "link_extract": found,
    "link_extract_markup": lambda s, d: L.links(odd(s, d)),
    "page_metadata_markup": lambda s, d: L.metadata(odd(s, d)).select("page_id", "description", "og_title"),
    "link_distinct": lambda s, d: L.distinct_links(found(s, d)),
    "link_collapse": lambda s, d: L.collapsed(found(s, d)),
    "shared_refs": lambda s, d: L.shared(found(s, d)),
    "direct_refs": direct,
    "template_signatures": lambda s, d: L.signatures(T(s, d)),
    "section_templates": lambda s, d: L.section_signatures(T(s, d)),
    "page_type": lambda s, d: T(s, d).select("page_id", U.page_type("url", X.title("html")).alias("kind")),
}
_LOC = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


def _host(u):
    return f"regexp_replace(lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '')"


def _path(u):
    return f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def _query(u):
    return f"regexp_extract({u}, '\\?([^#]*)', 1)"


def _key(u):
    return f"url_decode(regexp_replace(regexp_replace(regexp_replace({u}, '#.*$', ''), '^[A-Za-z]+://(www\\.)?', ''), '/$', ''))"


def _html(drop, lines):
    x = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
    for t in drop:
        x = f"regexp_replace({x}, '(?is)<{t}\\b[^>]*>.*?</{t}[^>]*>', ' ', 'g')"
    if lines:
        x = f"regexp_replace({x}, '(?i)<(br|/p|/div|/li|/h[1-6]|/tr)\\s*/?>', chr(10), 'g')"
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for a, b in X.ENTITIES:
        x = f"replace({x}, '{a}', {chr(39) + b.replace(chr(39), chr(39) * 2) + chr(39)})"
    x = f"regexp_replace({x}, '[ \\t\\x0B\\f\\r]+', ' ', 'g')"
    x = f"regexp_replace(regexp_replace({x}, ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')" if lines else f"regexp_replace({x}, '[ \\n\\r]+', ' ', 'g')"
    return f"regexp_replace(regexp_replace({x}, '^[ \\n]+', ''), '[ \\n]+$', '')"


def _attr(t, name):
    v = f"""regexp_extract({t}, '(?is)[ \\t\\n\\r\\f/]{name}[ \\t\\n\\r\\f]*=[ \\t\\n\\r\\f]*("[^"]*"|''[^'']*''|[^ \\t\\n\\r\\f>"'']+)', 1)"""
    return f"""regexp_replace({v}, '^["'']|["'']$', '', 'g')"""


def _meta(key):
    return f"""{_attr(f"list_filter(regexp_extract_all(html, '(?i)<meta{chr(92)}b[^<>]*>'), lambda t: lower({_attr('t', 'name')}) = '{key}' OR lower({_attr('t', 'property')}) = '{key}')[1]", 'content')}"""


_PARAMS = f"list_filter(string_split({_query('url')}, '&'), lambda p: p <> '')"
_STATE = "list_filter(list_filter(string_split(" + _query("url") + ", '&'), lambda p: p <> ''), lambda p: suffix(lower(split_part(p, '=', 1)), '_cur') OR NOT (lower(split_part(p, '=', 1)) IN ('sort', 'order', 'view', 'ref', 'sid', 'lang', 'print') OR regexp_matches(lower(split_part(p, '=', 1)), '(_sort|_order)$') OR regexp_matches(lower(split_part(p, '=', 1)), '^(utm_|filter)') OR contains(lower(split_part(p, '=', 1)), 'session')))"
_CANON = f"(regexp_replace(url, '[?#].*$', '') || CASE WHEN len({_STATE}) > 0 THEN '?' || array_to_string({_STATE}, '&') ELSE '' END)"
_DEPTH = f"list_max(list_transform(regexp_extract_all({_query('url')}, '(?:^|&)(?:page|p|start|offset)=([0-9]{{1,6}})(?:&|$)', 1), lambda x: CAST(x AS INTEGER)))"
_SEGS = f"list_filter(string_split({_path('url')}, '/'), lambda x: x <> '')"
_NORMAL = f"'://' || regexp_replace(lower({_LOC}), ':(80|443)$', '') || regexp_replace({_path('url')}, '/+$', '') || CASE WHEN len({_PARAMS}) > 0 THEN '?' || array_to_string(list_sort({_PARAMS}), '&') ELSE '' END"
_A = """(?i)<a\\b([^<>]*[ \\t\\n\\r\\f/]href[ \\t\\n\\r\\f]*=[ \\t\\n\\r\\f]*[^<>]*)>([^<]*)"""
_LINKS = f"""raw AS (SELECT page_id, url, pos, {_attr('tag', 'href')} AS href, left(trim(regexp_replace(body, '[ \\t\\n\\r\\f]+', ' ', 'g')), 500) AS anchor FROM (SELECT page_id, url, unnest(range(len(h))) AS pos, unnest(h) AS tag, unnest(x) AS body FROM (SELECT page_id, url, regexp_extract_all(html, '{_A}', 1) AS h, regexp_extract_all(html, '{_A}', 2) AS x FROM PAGES_IN))),
links AS (SELECT page_id, url AS source, target, CASE WHEN {_host('target')} = {_host('url')} THEN 'internal' ELSE 'external' END AS link_type, CAST(pos AS INTEGER) AS pos, anchor FROM (
SELECT *, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || href ELSE regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || regexp_replace({_path('url')}, '[^/]*$', '') || href END AS target FROM raw WHERE href <> ''))"""
_ODD = "odd AS (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN regexp_replace(html, '<a href=\"([^\"]*)\"', '<A class=k rel=x HREF = ''\\1''', 'g') ELSE html END || '<meta content=\"about ' || page_id || '\" NAME=Description><META property=''og:title'' content=''t''>' AS html FROM pages)"
_LINKS, _LINKS_ODD = _LINKS.replace("PAGES_IN", "pages"), _ODD + ", " + _LINKS.replace("PAGES_IN", "odd")

_SIGS = f"""tags AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<[A-Za-z][^<>]*>')) AS t FROM pages),
parts AS (SELECT page_id, url, lower(regexp_extract(t, '^<([A-Za-z][A-Za-z0-9]*)', 1)) AS name, {_attr('t', 'id')} AS id, {_attr('t', 'role')} AS role, list_filter(regexp_split_to_array({_attr('t', 'class')}, '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS classes FROM tags),
sigs AS (SELECT DISTINCT page_id, url, unnest(list_concat(list_concat(CASE WHEN id <> '' THEN ['id:' || id] ELSE [] END, CASE WHEN role <> '' THEN ['role:' || role] ELSE [] END), list_concat(list_transform(classes, lambda k: 'class:' || k), list_transform(classes, lambda k: name || '.' || k)))) AS sig FROM parts)"""
_TYPES = "CASE " + " ".join(f"WHEN regexp_matches(lower(url), '{w}') THEN '{k}'" for w, k in (("news|aktual|presse", "news"), ("about|kontakt|contact", "about"), ("team|staff|people", "people"), ("project|projekt", "project"), ("publication|report", "publication"), ("event|akce", "event"), ("download|files", "download"), ("donate|support", "support")))
_TITLE = "left(trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), 300)"
ORACLE = {
    "html_text": f"SELECT page_id, {_html(('script', 'style', 'noscript'), True)} AS text FROM pages",
    "html_body": f"SELECT page_id, {_html(X.CHROME, False)} AS text FROM pages",
    "html_key_text": f"SELECT page_id, md5(lower(strip_accents({_html(('script', 'style', 'noscript'), False)}))) AS h FROM pages",
    "page_metadata": f"SELECT page_id, {_TITLE} AS title, {_attr("regexp_extract_all(html, '(?i)<html" + chr(92) + "b[^<>]*>')[1]", 'lang')} AS lang, coalesce(list_filter(list_transform(regexp_extract_all(html, '(?i)<meta{chr(92)}b[^<>]*>'), lambda t: {_attr('t', 'charset')}), lambda x: x <> '')[1], '') AS charset, regexp_extract(html, '(?is)<h1{chr(92)}b[^>]*>(.*?)</h1>', 1) AS h1, {_meta('description')} AS description, {_meta('og:title')} AS og_title, {_meta('og:type')} AS og_type FROM pages",
    "url_parts": f"""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, {_host('url')} AS host, {_path('url')} AS path, {_query('url')} AS query, {_key('url')} AS key, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || {_NORMAL} AS normal, 'https' || {_NORMAL} AS normal_https,
lower(regexp_replace(url, '[?#].*$', '')) AS resource, coalesce({_SEGS}[1], '') AS section, CASE WHEN length(split_part({_host('url')}, '.', 1)) >= 3 THEN split_part({_host('url')}, '.', 1) END AS token,
CASE WHEN regexp_replace({_path('url')}, '/+$', '') <> '' THEN 'prefix:' || {_host('url')} || regexp_replace({_path('url')}, '/+$', '') ELSE 'domain:' || {_host('url')} END AS scope FROM pages""",
    "url_flags": f"""SELECT page_id, {_CANON} AS canonical, coalesce({_DEPTH}, 0) AS depth, CAST(regexp_matches({_query('url')}, '(?:^|&)(page|p|start|offset)=[0-9]+') OR len({_SEGS}) <= 2 AS INTEGER) AS hub,
CASE WHEN contains({_path('url')}, '/de/') THEN 'path:/de/' WHEN {_DEPTH} > 2 THEN 'pagination:' || {_DEPTH} END AS trap, {'coalesce(' + ', '.join(f"CASE WHEN contains(lower(url), '{p}') THEN 'pattern:{p}' END" for p in U.EXCLUDED) + ')'} AS excluded,
CAST({_host('url')} = 'example.com' OR suffix({_host('url')}, '.example.com') AS INTEGER) AS internal, CAST(regexp_matches({_path('url')}, '(?i)\\.(css|js|png|jpe?g|gif|svg|ico|woff2?|mp[34]|avi|zip|exe)$') AS INTEGER) AS noise, lower(regexp_extract({_path('url')}, '\\.([A-Za-z0-9]{{1,5}})$', 1)) AS extension,
CASE WHEN contains(lower(url), '/en/') THEN 0 WHEN regexp_matches(lower(url), '/fr/|/de/') THEN 1 WHEN contains(lower(url), 'page=') THEN 2 ELSE 3 END AS priority,
lpad(CAST(page_id AS VARCHAR), 5, '0') || '_' || left(trim(regexp_replace(lower({_path('url')}), '[^a-z0-9]+', '_', 'g'), '_'), 80) AS slug,
CAST({_host('url')} = 'example.com' OR suffix({_host('url')}, '.example.com') OR starts_with({_key('url')}, 'm.') AS INTEGER) AS in_scope FROM pages""",
    "canonical_twins": f"SELECT page_id, org, CASE WHEN row_number() OVER (PARTITION BY org, key ORDER BY page_id) > 1 THEN 'canonical_duplicate' ELSE 'kept' END AS state FROM (SELECT page_id, {_host('url')} AS org, {_key(_CANON)} AS key FROM pages)",
    "link_extract_markup": f"WITH {_LINKS_ODD} SELECT * FROM links",
    "page_metadata_markup": f"WITH {_ODD} SELECT page_id, {_meta('description')} AS description, {_meta('og:title')} AS og_title FROM odd",
    "link_extract": f"WITH {_LINKS} SELECT * FROM links",
    "link_distinct": f"WITH {_LINKS} SELECT page_id, {_key('target')} AS key, arg_min(target, pos) AS target, min(pos) AS pos, count(*) AS n FROM links GROUP BY 1, 2",
    "link_collapse": f"WITH {_LINKS} SELECT {_host('source')} AS org, target, min(source) AS first_source, min(anchor) AS anchor, max(link_type) AS link_type, count(*) AS occurrences, min(page_id) AS first_seen, max(page_id) AS last_seen FROM links GROUP BY 1, 2",
    "shared_refs": f"""WITH {_LINKS}, r AS (SELECT DISTINCT lower({_path('target')}) AS resource, {_host('source')} AS org FROM links)
SELECT org_a, org_b, count(*) AS weight, array_to_string(list_sort(list(resource))[1:5], ',') AS samples FROM (SELECT a.org AS org_a, b.org AS org_b, a.resource FROM r a JOIN r b ON a.resource = b.resource AND a.org < b.org) GROUP BY 1, 2""",
    "direct_refs": f"""WITH {_LINKS}, owners AS (SELECT DISTINCT {_host('url')} AS host, regexp_replace({_host('url')}, '^[^.]*\\.', '') AS org FROM pages),
far AS (SELECT source, CASE WHEN pos % 3 = 0 THEN 'https://m.ththth.example.net' || {_path('target')} ELSE target END AS target FROM links)
SELECT a.org AS src, b.org AS tgt, count(*) AS n FROM far JOIN owners a ON a.host = {_host('source')} JOIN owners b ON b.host = {_host('far.target')} WHERE a.org <> b.org GROUP BY 1, 2""",
    "template_signatures": f"WITH {_SIGS} SELECT sig, count(*) AS df FROM sigs GROUP BY sig HAVING count(*) >= greatest((SELECT floor(count(*) * 0.8) FROM pages), 1)",
    "section_templates": f"""WITH {_SIGS}, size AS (SELECT coalesce({_SEGS}[1], '') AS section, count(*) AS n_pages FROM pages GROUP BY 1 HAVING count(*) >= 10)
SELECT section, sig, df, n_pages FROM (SELECT coalesce({_SEGS}[1], '') AS section, sig, count(*) AS df FROM sigs GROUP BY 1, 2) JOIN size USING (section) WHERE df >= floor(n_pages * 0.8)""",
    "page_type": f"SELECT page_id, {_TYPES} WHEN regexp_matches(lower({_TITLE}), 'news|press') THEN 'news' WHEN regexp_matches(lower({_TITLE}), 'about us|who we are') THEN 'about' WHEN regexp_matches(lower({_TITLE}), 'project') THEN 'project' ELSE 'general' END AS kind FROM pages",
}
