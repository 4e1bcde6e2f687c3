"""URL functions as column expressions."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(u) -> Column:
    return F.col(u) if isinstance(u, str) else u


def bare(u) -> Column:
    """URL without query and fragment."""
    return F.regexp_replace(_c(u), r"[?#].*$", "")


def scheme(u) -> Column:
    return F.lower(F.regexp_extract(_c(u), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def netloc(u) -> Column:
    """Lower-case host with its port."""
    return F.lower(F.regexp_extract(_c(u), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def host(u) -> Column:
    """Lower-case host without www. before it."""
    return F.regexp_replace(netloc(u), r"^www\.", "")


def path(u) -> Column:
    return F.regexp_extract(_c(u), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(u) -> Column:
    return F.regexp_extract(_c(u), r"\?([^#]*)", 1)


def params(u) -> Column:
    return F.filter(F.split(query(u), "&"), lambda p: p != "")


def url_key(u) -> Column:
    """Identity of a URL: no scheme, www., fragment or final slash, percent escapes decoded."""
    x = F.regexp_replace(F.regexp_replace(_c(u), r"#.*$", ""), r"^[A-Za-z]+://(www\.)?", "")
    x = F.regexp_replace(x, r"/$", "")
    return F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)


def normalize(u, force_https: bool = False) -> Column:
    """Lower host, no default port, sorted query, no fragment, no final slash."""
    s = F.lit("https") if force_https else scheme(u)
    h = F.regexp_replace(netloc(u), r":(80|443)$", "")
    q = F.array_join(F.array_sort(params(u)), "&")
    return F.concat(s, F.lit("://"), h, F.regexp_replace(path(u), r"/+$", ""), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


@F.pandas_udf(T.StringType())
def resolved(link: pd.Series, parent: pd.Series) -> pd.Series:
    """link as an absolute URL, seen from its page."""

    def one(a, b):
        try:
            return urljoin(b or "", a) if a is not None else None
        except ValueError:
            return None

    return pd.Series([one(a, b) for a, b in zip(link, parent)])


def resolved_simple(link, parent) -> Column:
    """resolved without leaving the JVM, for absolute, host-relative and page-relative links without dots."""
    a, root = _c(link), F.concat(scheme(parent), F.lit("://"), netloc(parent))
    return F.when(a.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), a).when(F.startswith(a, F.lit("/")), F.concat(root, a)).otherwise(F.concat(root, F.regexp_replace(path(parent), r"[^/]*$", ""), a))


def resource_key(u) -> Column:
    return F.lower(bare(u))


#: Presentation parameters: whole names, then ends, starts and parts of names.
STATE = {"is": ("sort", "order", "view", "ref", "sid", "lang", "print"), "ends": ("_sort", "_order"), "starts": ("utm_", "filter"), "has": ("session",)}


def is_state_param(key, drop=STATE, keep: str = "_cur") -> Column:
    """Whether a parameter only changes how a page is shown. Names that end in keep never do; then whole names count, ends, starts, parts."""
    k = F.lower(key)
    return F.when(F.endswith(k, F.lit(keep)), False).when(k.isin(*drop["is"]), True).when(k.rlike("(" + "|".join(drop["ends"]) + ")$"), True).when(k.rlike("^(" + "|".join(drop["starts"]) + ")"), True).otherwise(k.rlike("|".join(drop["has"])))


def canonical(u, drop=STATE) -> Column:
    """URL without presentation parameters and fragment."""
    q = F.array_join(F.filter(params(u), lambda p: ~is_state_param(F.split_part(p, F.lit("="), F.lit(1)), drop)), "&")
    return F.concat(bare(u), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def pagination_depth(u) -> Column:
    """Highest number below a million among page parameters; null where there is none."""
    n = F.transform(F.regexp_extract_all(query(u), F.lit(r"(?:^|&)(?:page|p|start|offset)=([0-9]{1,6})(?:&|$)"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_max(n)


def path_prefix(u, depth: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(path(u), "/"), lambda s: s != ""), 1, depth), "/")


def segments(u) -> Column:
    return F.size(F.filter(F.split(path(u), "/"), lambda s: s != ""))


def is_hub(u, most: int = 2) -> Column:
    """Listing pages: paginated ones, and those near the root."""
    return query(u).rlike(r"(?:^|&)(page|p|start|offset)=[0-9]+") | (segments(u) <= most)


def trap_reason(u, banned_path=None, cap=100) -> Column:
    """Why a URL is a crawler trap, or null: its path is banned, or its pagination goes beyond the cap."""
    first = F.when(F.contains(path(u), banned_path), F.concat(F.lit("path:"), banned_path)) if banned_path is not None else F.when(F.lit(False), "")
    deep = pagination_depth(u)
    return F.coalesce(first, F.when(deep > cap, F.concat(F.lit("pagination:"), deep.cast("string"))))


EXCLUDED = ("/wp-admin", "/login", "/logout", "/cart", "mailto:", "javascript:", "/feed", "?print=", "?ref=")


def exclusion_reason(u, patterns=EXCLUDED) -> Column:
    """The first of the patterns that the URL holds."""
    return F.coalesce(*(F.when(F.contains(F.lower(_c(u)), F.lit(p)), F.lit(f"pattern:{p}")) for p in patterns))


def is_excluded(u, patterns=EXCLUDED) -> Column:
    return exclusion_reason(u, patterns).isNotNull()


NOISE = r"(?i)\.(css|js|png|jpe?g|gif|svg|ico|woff2?|mp[34]|avi|zip|exe)$"
DOCUMENTS = r"(?i)\.(pdf|docx?|xlsx?|pptx?|odt|rtf)$"


def is_binary_noise(u) -> Column:
    return path(u).rlike(NOISE)


def is_document(u) -> Column:
    return path(u).rlike(DOCUMENTS)


def file_extension(u) -> Column:
    return F.lower(F.regexp_extract(path(u), r"\.([A-Za-z0-9]{1,5})$", 1))


def default_scope(seed) -> Column:
    """Rule for a seed: its prefix where it has a path, else its domain."""
    p = F.regexp_replace(path(seed), "/+$", "")
    return F.when(p != "", F.concat(F.lit("prefix:"), host(seed), p)).otherwise(F.concat(F.lit("domain:"), host(seed)))


def in_scope(u, rules) -> Column:
    """Whether any rule lets a URL in: domain: by host or subdomain, prefix: by the start of its key."""

    def one(r):
        v = F.split_part(r, F.lit(":"), F.lit(2))
        return F.when(F.startswith(r, F.lit("domain:")), (host(u) == v) | F.endswith(host(u), F.concat(F.lit("."), v))).otherwise(F.startswith(url_key(u), v))

    return F.exists(rules, one)


def is_internal(u, domain) -> Column:
    return (host(u) == domain) | F.endswith(host(u), F.concat(F.lit("."), domain))


def priority(u, high, medium, low) -> Column:
    """0, 1 or 2 for the first list with a match, 3 for none."""
    out = None
    for k, ps in enumerate((high, medium, low)):
        hit = F.lower(_c(u)).rlike("|".join(ps))
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return out.otherwise(3)


def page_type(u, heading) -> Column:
    """Kind of a page: by its URL first, then by its title."""
    l, t = F.lower(_c(u)), F.lower(heading)
    out = None
    for words, kind in (("news|aktual|presse", "news"), ("about|kontakt|contact", "about"), ("team|staff|people", "people"), ("project|projekt", "project"), ("publication|report", "publication"), ("event|akce", "event"), ("download|files", "download"), ("donate|support", "support")):
        out = F.when(l.rlike(words), kind) if out is None else out.when(l.rlike(words), kind)
    for words, kind in (("news|press", "news"), ("about us|who we are", "about"), ("project", "project")):
        out = out.when(t.rlike(words), kind)
    return out.otherwise("general")


def slug(u, number) -> Column:
    """File name of a page: number, underscore, slug of the path."""
    s = F.trim(F.regexp_replace(F.lower(path(u)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.concat(F.lpad(number.cast("string"), 5, "0"), F.lit("_"), F.when(s == "", "index").otherwise(F.left(s, F.lit(80))))


def sanitized(c) -> Column:
    return F.left(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1F]', "_"), F.lit(200))


def domain_token(u) -> Column:
    """First label of the host, where it has three letters."""
    t = F.split_part(host(u), F.lit("."), F.lit(1))
    return F.when(F.length(t) >= 3, t)
