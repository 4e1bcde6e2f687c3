"""Dates in pages and texts as column expressions. Built on try_ functions: bad dates are null, never errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold

MONTHS = {m: k for k, names in enumerate(("ledna leden january", "února únor february", "března březen march", "dubna duben april", "května květen may", "června červen june", "července červenec july", "srpna srpen august", "září september", "října říjen october", "listopadu listopad november", "prosince prosinec december"), 1) for m in names.split()}


def _iso(y, m, d) -> Column:
    return F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))


def _found(c, pattern: str, order: str) -> Column:
    """Year, month and day groups of a pattern as an ISO string, null where it isn't there. Not checked against the calendar."""
    g = {k: F.regexp_extract(c, pattern, order.index(k) + 1) for k in "ymd"}
    return F.when(g["y"] != "", _iso(g["y"], g["m"], g["d"]))


def month_number(c) -> Column:
    table = F.create_map(*(F.lit(x) for kv in MONTHS.items() for x in (kv[0], str(kv[1]))))
    return F.try_element_at(table, F.lower(c))


GENITIVE = ("ledna", "unora", "brezna", "dubna", "kvetna", "cervna", "cervence", "srpna", "zari", "rijna", "listopadu", "prosince")


def _named(c) -> Column:
    """d. month yyyy with a month's folded name; text is folded before it is matched."""
    t = F.lower(fold(c))
    p = rf"\b(\d{{1,2}})\.\s?({'|'.join(GENITIVE)})\s+(20[0-2]\d)\b"
    table = F.create_map(*(F.lit(x) for k, m in enumerate(GENITIVE, 1) for x in (m, str(k))))
    m = F.try_element_at(table, F.regexp_extract(t, p, 2))
    return F.when(m.isNotNull(), _iso(F.regexp_extract(t, p, 3), m, F.regexp_extract(t, p, 1)))


def cascade(html, text) -> Column:
    """struct(date, source): the first of meta tag, time element, named month, d.m.yyyy and ISO in the text. Dates stay strings, and aren't checked against the calendar."""
    iso = r"(20[0-2]\d)-(\d{2})-(\d{2})"
    names = "article:published_time|datePublished|og:published_time|pubdate|date"
    steps = (
        ("meta", _found(F.regexp_extract(html, rf"""(?is)<meta[^>]+(?:property|name)=["'](?:{names})["'][^>]*content=["']([^"']+)""", 1), iso, "ymd")),
        ("time", _found(F.regexp_extract(html, r"""(?is)<time[^>]+datetime=["']([^"']+)""", 1), iso, "ymd")),
        ("text_cz", _named(text)),
        ("text_num", _found(text, r"\b(\d{1,2})\.\s?(\d{1,2})\.\s?(20[0-2]\d)\b", "dmy")),
        ("text_iso", _found(text, iso, "ymd")),
    )
    return F.coalesce(*(F.when(d.isNotNull(), F.struct(d.alias("date"), F.lit(s).alias("source"))) for s, d in steps))


def parse(c) -> Column:
    """A date in ISO, d.m.yyyy, d month yyyy or d/m/yyyy form, checked against the calendar."""
    named = F.regexp_extract(c, r"(?U)^\s*(\d{1,2})\.?\s+(\w+),?\s+(\d{4})", 2)
    return F.coalesce(
        F.try_to_date(F.regexp_extract(c, r"^\s*(\d{4}-\d{1,2}-\d{1,2})", 1), "yyyy-M-d"),
        F.try_to_date(F.regexp_replace(F.regexp_extract(c, r"^\s*(\d{1,2}\. ?\d{1,2}\. ?\d{4})", 1), " ", ""), "d.M.yyyy"),
        F.try_to_date(F.concat_ws("-", F.regexp_extract(c, r"(?U)^\s*(\d{1,2})\.?\s+(\w+),?\s+(\d{4})", 3), month_number(named), F.regexp_extract(c, r"(?U)^\s*(\d{1,2})\.?\s+(\w+),?\s+(\d{4})", 1)), "yyyy-M-d"),
        F.try_to_date(F.regexp_extract(c, r"^\s*(\d{1,2}/\d{1,2}/\d{4})", 1), "d/M/yyyy"),
    )


FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "d.M.yyyy", "d/M/yyyy", "MMMM d, yyyy", "d MMMM yyyy", "yyyy/MM/dd")


def parse_formats(c, formats=FORMATS) -> Column:
    return F.coalesce(*(F.try_to_date(c, f) for f in formats))


def from_url(u) -> Column:
    """Date in a path: /yyyy/m/d/ or yyyy-m-d. A year and month alone give nothing."""
    return F.coalesce(_found(u, r"/(20[0-2]\d)/(\d{1,2})/(\d{1,2})(?:/|$)", "ymd"), _found(u, r"(20[0-2]\d)-(\d{1,2})-(\d{1,2})", "ymd"))


def json_ld(html) -> Column:
    """Date of a linked-data block: published, created, modified; of the object, the first of a list, or the first node of its @graph that has one."""
    raw = F.regexp_extract(html, r'(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>', 1)
    keys = ("datePublished", "dateCreated", "dateModified")
    at = [f"{p}.{k}" for k in keys for p in ("$", "$[0]")]
    graph = F.from_json(F.get_json_object(raw, "$.@graph"), "array<map<string,string>>")
    nodes = F.filter(F.transform(graph, lambda m: F.coalesce(*(F.try_element_at(m, F.lit(k)) for k in keys))), lambda x: x.isNotNull())
    return F.left(F.coalesce(*(F.get_json_object(raw, p) for p in at), F.get(nodes, 0)), F.lit(10))


def open_graph(html) -> Column:
    """article:published_time, else article:modified_time."""
    one = lambda k: F.nullif(F.regexp_extract(html, rf'(?i)<meta[^>]+property="article:{k}_time"[^>]+content="([^"]{{10}})', 1), F.lit(""))
    return F.coalesce(one("published"), one("modified"))


META = ("date", "pubdate", "publishdate", "dc.date", "dc.date.issued", "article.published", "last-modified", "dcterms.created", "publication_date")


def meta(html) -> Column:
    one = lambda k: F.nullif(F.regexp_extract(html, rf'(?i)<meta[^>]+name="{k}"[^>]+content="([^"]+)"', 1), F.lit(""))
    return F.coalesce(*map(one, META))


def single_article(html) -> Column:
    return F.regexp_count(html, F.lit(r"(?i)<article\b")) == 1


def content(html) -> Column:
    """Date in the page itself, where it holds one article: a date-like class first, then any d.m.yyyy after a mark of publication."""
    scoped = F.when(single_article(html), F.regexp_extract(html, r"(?is)<article\b[^>]*>(.*?)</article>", 1)).otherwise(html)
    classed = F.regexp_extract(scoped, r'(?is)class="[^"]*(?:date|time|published)[^"]*"[^>]*>\s*([^<]{6,30})<', 1)
    marked = F.regexp_extract(scoped, r"(?isU)(?:published|publikováno|posted)[^<0-9]{0,40}(\d{1,2}\. ?\d{1,2}\. ?\d{4})", 1)
    return F.coalesce(parse(classed), parse(marked))


def full_cascade(html) -> Column:
    """struct(date, source), checked: linked data, OpenGraph, meta, content."""
    steps = (("json_ld", F.try_to_date(json_ld(html))), ("open_graph", F.try_to_date(open_graph(html))), ("meta", parse(meta(html))), ("content", content(html)))
    return F.coalesce(*(F.when(d.isNotNull(), F.struct(F.date_format(d, "yyyy-MM-dd").alias("date"), F.lit(s).alias("source"))) for s, d in steps))


def only_one(html, pattern: str) -> Column:
    """The date of a pattern's group where all its matches agree."""
    all_ = F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)))
    return F.when(F.size(all_) == 1, parse(all_[0]))


def sitemap_date(c) -> Column:
    return F.try_to_date(F.substring_index(c, "T", 1))


def in_range(c, first: str, last: str) -> Column:
    """Whether the first ten characters are a date in the range; false where they are none."""
    return F.coalesce(F.try_to_date(F.substring(c, 1, 10)).between(F.lit(first).cast("date"), F.lit(last).cast("date")), F.lit(False))


def year_bucket(c, first: int = 2016, last: int = 2025) -> Column:
    y = F.substring(c, 1, 4).try_cast("int")
    return F.when(y.between(first, last), y.cast("string")).otherwise("other")


def utc(c) -> Column:
    """ISO time with offset as UTC with Z; null where it is none."""
    return F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def stale(c, now, days: int = 7) -> Column:
    return F.coalesce(c < now - F.make_interval(days=F.lit(days)), F.lit(True))
