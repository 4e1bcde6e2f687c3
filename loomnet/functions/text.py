"""String functions as column expressions; Python only where no built-in says the same.

Patterns that an SQL oracle has to share keep to what RE2 and java.util.regex read alike.
"""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _alphabet() -> tuple[str, str]:
    """Latin letters that decompose to one ASCII letter, and those letters."""
    src, dst = [], []
    for p in range(0xC0, 0x250):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(p)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii():
            src.append(chr(p))
            dst.append(base)
    return "".join(src), "".join(dst)


ACCENTS, PLAIN = _alphabet()


def fold(c) -> Column:
    """Text without diacritics, case kept; stays in whole-stage codegen."""
    return F.translate(c, ACCENTS, PLAIN)


@F.pandas_udf(T.StringType())
def fold_any(s: pd.Series) -> pd.Series:
    """fold for every script: canonical decomposition without nonspacing marks."""
    return s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))


def match_key(c) -> Column:
    """Key for joining names: folded, lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(fold(c)), r"[ \t\n\r\f]+", " "))


ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))


def html_to_text(c, drop: Iterable[str] = ("script", "style", "noscript"), lines: bool = True) -> Column:
    """Plain text of markup: comments and dropped elements go, block ends become line ends, other tags spaces; empty lines between paragraphs fold to one. Entities are replaced in a fixed order, so a doubly escaped one is unescaped twice."""
    x = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    for tag in drop:
        x = F.regexp_replace(x, rf"(?is)<{tag}\b[^>]*>.*?</{tag}[^>]*>", " ")
    if lines:
        x = F.regexp_replace(x, r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr)\s*/?>", "\n")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    for a, b in ENTITIES:
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.regexp_replace(x, r"[ \t\x0B\f\r]+", " ")
    if lines:
        x = F.regexp_replace(F.regexp_replace(x, r" ?\n ?", "\n"), r"\n{3,}", "\n\n")
    else:
        x = F.regexp_replace(x, r"[ \n\r]+", " ")
    return F.regexp_replace(F.regexp_replace(x, r"^[ \n]+", ""), r"[ \n]+$", "")


CHROME = ("script", "style", "noscript", "nav", "header", "footer", "aside")


def body_text(c) -> Column:
    """html_to_text without page chrome, on one line."""
    return html_to_text(c, CHROME, lines=False)


def key_text(c) -> Column:
    """Folded one-line text, for checking patterns against pages."""
    return F.lower(fold(html_to_text(c, lines=False)))


def attribute(tag, name: str) -> Column:
    """Value of an attribute of a tag, in double, single or no quotes; empty where it isn't there."""
    v = F.regexp_extract(tag, rf"""(?is)[ \t\n\r\f/]{name}[ \t\n\r\f]*=[ \t\n\r\f]*("[^"]*"|'[^']*'|[^ \t\n\r\f>"']+)""", 1)
    return F.regexp_replace(v, r"""^["']|["']$""", "")


def tags_of(html, name: str) -> Column:
    """All opening tags of a name, in order."""
    return F.regexp_extract_all(html, F.lit(rf"(?i)<{name}\b[^<>]*>"), F.lit(0))


def meta_content(html, key: str) -> Column:
    """content of the first meta tag whose name or property is key, wherever its attributes stand; null where there is none."""
    own = F.filter(tags_of(html, "meta"), lambda t: (F.lower(attribute(t, "name")) == key) | (F.lower(attribute(t, "property")) == key))
    return attribute(F.get(own, 0), "content")


def title(c) -> Column:
    return F.left(F.trim(F.regexp_extract(c, r"(?is)<title>(.*?)</title>", 1)), F.lit(300))


def element_signatures(c) -> Column:
    """Distinct id:, role:, class: and tag.class signatures of the elements of a page; a class attribute names several classes."""
    tags = F.transform(F.regexp_extract_all(c, F.lit(r"<[A-Za-z][^<>]*>"), F.lit(0)), lambda t: F.struct(F.lower(F.regexp_extract(t, r"^<([A-Za-z][A-Za-z0-9]*)", 1)).alias("name"), attribute(t, "id").alias("id"), attribute(t, "role").alias("role"), F.filter(F.split(attribute(t, "class"), r"[ \t\n\r\f]+"), lambda x: x != "").alias("classes")))
    none = F.array().cast("array<string>")

    def own(t):
        one = lambda kind: F.when(t[kind] != "", F.array(F.concat(F.lit(kind + ":"), t[kind]))).otherwise(none)
        return F.concat(one("id"), one("role"), F.transform(t["classes"], lambda k: F.concat(F.lit("class:"), k)), F.transform(t["classes"], lambda k: F.concat(t["name"], F.lit("."), k)))

    return F.array_distinct(F.flatten(F.transform(tags, own)))


# dictionary patterns


def escaped(term: str) -> str:
    return "".join(x if x.isalnum() or x in " _" or ord(x) > 127 else "\\" + x for x in term)


def longest_first(terms: Iterable[str]) -> list[str]:
    """Terms without case-insensitive repeats, longest first; alternation takes the first that fits."""
    out = {}
    for t in sorted(terms, key=lambda x: (-len(x), x)):
        out.setdefault(t.lower(), t)
    return list(out.values())


def alternation(terms: Iterable[str], short: int = 5) -> str:
    """One pattern for many terms: a word boundary before each, and after those shorter than ``short``."""
    return "|".join(r"\b" + escaped(t) + (r"\b" if len(t) < short else "") for t in longest_first(terms))


def ascii_bounded(terms: Iterable[str]) -> str:
    """Terms between characters that aren't ASCII word characters, the longest that fits."""
    return r"(?<![0-9A-Za-z_])(?:" + "|".join(escaped(t) for t in longest_first(terms)) + r")(?![0-9A-Za-z_])"


def inflected(root: str) -> str:
    """A root with up to three vowels after it, as a whole word, in any case and script."""
    return rf"(?iuU)\b{escaped(root)}[aeiouyáéíóúůýěäöü]{{0,3}}\b"


def stemmed(root: str, most: int = 15) -> str:
    """A root with up to ``most`` letters after it."""
    return rf"(?iuU)\b{escaped(root)}\w{{0,{most}}}"


def declension_root(name: str, endings=("ami", "ech", "ům", "ách", "ou", "em", "a", "e", "i", "o", "u", "y", "á", "é", "í", "ý")) -> str:
    """name with the ending of its last word cut, three letters of it at least kept."""
    head, _, last = name.rpartition(" ")
    for end in endings:
        if last.lower().endswith(end) and len(last) - len(end) >= 3:
            last = last[: -len(end)]
            break
    return f"{head} {last}".strip()


def acronym(c) -> Column:
    """Initials of the words of three letters or more, where that makes two to six."""
    words = F.filter(F.split(F.regexp_replace(fold(c), r"[^A-Za-z ]", ""), " "), lambda w: F.length(w) >= 3)
    a = F.array_join(F.transform(words, lambda w: F.upper(F.left(w, F.lit(1)))), "")
    return F.when(F.length(a).between(2, 6), a)


def name_stem(c) -> Column:
    """A single word without one or two vowels at its end."""
    return F.when(~F.contains(F.lit(c) if isinstance(c, str) else c, F.lit(" ")), F.regexp_replace(F.lower(fold(c)), "[aeiouy]{1,2}$", ""))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def positions(text: pd.Series, term: pd.Series) -> pd.Series:
    """All starts of term in text, overlapping ones too, from 0."""

    def one(t, x):
        out, i = [], t.find(x) if t and x else -1
        while i >= 0:
            out.append(i)
            i = t.find(x, i + 1)
        return out

    return pd.Series([one(t, x) for t, x in zip(text, term)])


def context(text, at, reach: int) -> Column:
    """reach characters to either side of a place (from 0), with marks where the text goes on."""
    t = F.col(text) if isinstance(text, str) else text
    lo, hi = F.greatest(F.lit(0), at - reach), F.least(F.length(t), at + reach)
    return F.concat(F.when(lo > 0, "…").otherwise(""), F.substr(t, lo + 1, hi - lo), F.when(hi < F.length(t), "…").otherwise(""))


def level(distance) -> Column:
    return F.when(distance < 150, "same sentence/paragraph").when(distance < 500, "nearby paragraph").otherwise("distant")


def without_header(c) -> Column:
    """A context without its bracketed first line and the marks at its ends."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s*\[.*\]\s*\n", ""), r"^(…|\.\.\.)|(…|\.\.\.)$", "")


def readable_name(c) -> Column:
    """A file name as words: no number before it, no suffix, spaces for separators."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^[0-9]+_", ""), r"\.[a-z]{2,4}$", ""), r"[_-]+", " "))


def cut_at_marker(text, marker) -> Column:
    """Text up to the first marker, less the white space before it; whole where there is none."""
    at = F.locate(marker, text) if isinstance(marker, str) else F.instr(text, marker)
    return F.when(at > 0, F.regexp_replace(F.substr(F.col(text), F.lit(1), at - 1), r"[ \t\n\r\f]+$", "")).otherwise(F.col(text))


def prompt_safe(c) -> Column:
    """Characters beyond Cyrillic that aren't punctuation or spaces become spaces."""
    return F.regexp_replace(c, r"[^\x{0}-\x{4FF}\p{Po}\p{Pd}\p{Ps}\p{Pe}\p{Zs}]", " ")


def tokens(c) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[.,;:!?()|*$%&#\"']", ""), r"[ \t\n\r\f]+"), lambda w: w != "")


def bound(c, body) -> Column:
    """body(c) with c computed once: a lambda variable isn't inlined where body uses it again and again."""
    return F.element_at(F.transform(F.array(c), body), 1)


def shingles(words, k: int) -> Column:
    """Distinct k-word shingles; fewer words make one shingle, none make none."""

    def body(w):
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(k)), " "))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(many))

    return bound(words, body)


def jaccard(a, b) -> Column:
    """0 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both), F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def edit_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two names from 0 to 100: twice the matching characters over all."""
    return pd.Series([None if x is None or y is None else round(100 * difflib.SequenceMatcher(None, x, y).ratio(), 6) for x, y in zip(a, b)])


@F.udtf(returnType="idx int, start int, chunk string")
class SentenceChunks:
    """Pieces of at most ``size`` characters that end at sentence ends where they can and overlap by ``overlap``."""

    def eval(self, text: str, size: int, overlap: int):
        if not text:
            return
        at, k = 0, 0
        while at < len(text):
            end = min(at + size, len(text))
            if end < len(text):
                stop = max(text.rfind(m, at + overlap + 1, end) for m in (". ", "! ", "? ", ".\n"))
                if stop > 0:
                    end = stop + 1
            yield k, at, text[at:end]
            if end >= len(text):
                return
            at, k = max(at + 1, end - overlap), k + 1


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Bytes of a page as text: the charset it names, else the first of the usual ones that fits, else UTF-8 with replacement."""
    import re

    def one(raw):
        if raw is None:
            return None
        raw = bytes(raw)
        m = re.search(rb"charset=[\"']?([A-Za-z0-9_-]+)|encoding=[\"']([A-Za-z0-9_-]+)", raw[:2048])
        named = [(m.group(1) or m.group(2)).decode()] if m else []
        for enc in (*named, "utf-8", "cp1250", "iso-8859-2"):
            try:
                return raw.decode(enc)
            except (UnicodeDecodeError, LookupError):
                continue
        return raw.decode("utf-8", "replace")

    return content.map(one)
