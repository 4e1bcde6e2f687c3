"""Candidate pairs: targets unnested, mentions near keywords, the best window of each."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomnet.functions import text as X
from loomnet.functions.jsons import pair_id


def unnested(found: DataFrame, empty: str = "(unknown)") -> DataFrame:
    """A row for each target; documents without one have a row that says so."""
    return found.select(pair_id(F.col("source"), F.col("doc_id").cast("string"), F.col("target")).alias("id"), "doc_id", "source", "target") if "target" in found.columns else unnested(
        found.select("doc_id", "source", F.explode(F.when(F.size("targets") > 0, F.col("targets")).otherwise(F.array(F.lit(empty)))).alias("target")), empty
    )


def overlaps(term: str) -> bool:
    return any(term[:k] == term[-k:] for k in range(1, len(term)))


def places(docs: DataFrame, terms: list[str], name: str) -> DataFrame:
    """(doc_id, name, at): every start of every term in the lower-case text, counted from 0, overlapping ones too. Splitting at a term gives its places from the lengths of the parts, JVM-side; only terms that begin as they end can overlap themselves, and are looked for one by one."""
    t = F.lower("text")
    terms = [w.lower() for w in terms]
    plain = [(k, w) for k, w in enumerate(terms) if not overlaps(w)]
    found = None
    for k, w in enumerate(terms):
        if overlaps(w):
            part = docs.select("doc_id", F.lit(k).alias(f"{name}_ord"), F.lit(w).alias(name), F.explode(X.positions(t, F.lit(w))).alias(f"{name}_at"))
            found = part if found is None else found.unionByName(part)
    if not plain:
        return found
    parts = F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(w).alias("term"), F.split(t, X.escaped(w)).alias("parts")) for k, w in plain))
    x = docs.select("doc_id", F.explode(parts).alias("p")).filter(F.size("p.parts") > 1).select("doc_id", F.col("p.ord").alias(f"{name}_ord"), F.col("p.term").alias(name), F.slice("p.parts", F.lit(1), F.size("p.parts") - 1).alias("parts"))
    ends = F.aggregate("parts", F.array().cast("array<int>"), lambda acc, s: F.concat(acc, F.array((F.coalesce(F.try_element_at(acc, F.lit(-1)) + F.length(name), F.lit(0)) + F.length(s)).cast("int"))))
    x = x.select("doc_id", f"{name}_ord", name, F.explode(ends).alias(f"{name}_at"))
    return x if found is None else x.unionByName(found)


def near(docs: DataFrame, orgs: list[str], keywords: list[str], reach: int = 1200) -> DataFrame:
    """(doc_id, org, kw, org_at, kw_at, distance) of all mentions within reach characters of a keyword. A range join on the position: both sides fall in cells of reach characters, and only neighbouring cells of a document meet."""
    a = places(docs, orgs, "org").withColumn("cell", F.floor(F.col("org_at") / reach))
    b = places(docs, keywords, "kw").withColumn("cell", F.explode(F.array(*(F.floor(F.col("kw_at") / reach) + k for k in (-1, 0, 1)))))
    return a.join(b, ["doc_id", "cell"]).withColumn("distance", F.abs(F.col("org_at") - F.col("kw_at"))).filter(F.col("distance") <= reach).drop("cell")


def best(pairs: DataFrame) -> DataFrame:
    """The closest pair of each document, and up to four closest pairs of different terms. Ties go by the order of terms, then places."""
    w = Window.partitionBy("doc_id", "org", "kw").orderBy("distance", "org_ord", "kw_ord", "org_at", "kw_at")
    one = pairs.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    hits = F.array_sort(F.collect_list(F.struct("distance", "org_ord", "kw_ord", "org_at", "kw_at", "org", "kw")))
    top = one.groupBy("doc_id").agg(hits.alias("hits"))
    h = F.col("hits")[0]
    return top.select("doc_id", h["org"].alias("org"), h["kw"].alias("kw"), h["distance"].alias("distance"), X.level(h["distance"]).alias("level"), F.floor((h["org_at"] + h["kw_at"]) / 2).cast("int").alias("anchor"), F.array_join(F.transform(F.slice("hits", 1, 4), lambda x: F.concat(x["org"], F.lit("~"), x["kw"])), ", ").alias("top_hits"), F.greatest(F.size("hits") - 4, F.lit(0)).alias("n_more"))


def with_context(pairs: DataFrame, docs: DataFrame, reach: int = 1000) -> DataFrame:
    j = pairs.join(docs.select("doc_id", "text"), "doc_id")
    head = F.format_string("[%s ~ %s, %d chars, %s]\n", "org", "kw", "distance", "level")
    return j.select("doc_id", "org", "kw", "distance", F.concat(head, X.context("text", F.col("anchor"), reach)).alias("context"))


def found_places(text, terms: list[str]):
    """For each term, what starts() makes its places of: the lengths of the parts before it in the lower-case text, or the places themselves of a term that can overlap itself."""
    t = F.lower(text)
    none = F.array().cast("array<int>")

    def of(w):
        if overlaps(w):
            return X.positions(t, F.lit(w))
        parts = F.split(t, X.escaped(w))
        return F.when(F.instr(t, F.lit(w)) > 0, F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), F.length)).otherwise(none)

    return F.array(*map(of, terms))


def starts(term: str, found) -> np.ndarray:
    """The places of a term, ascending, from found_places()."""
    x = np.asarray(found, np.int64)
    return x if overlaps(term) else np.cumsum(x + len(term)) - len(term)


def nearest(a: np.ndarray, b: np.ndarray, reach: int) -> tuple[int, int, int] | None:
    """(distance, x, y): the closest x of a and y of b, both ascending, within reach; of equal ones the first x, then the first y."""
    if not len(a) or not len(b):
        return None
    at = np.searchsorted(b, a)
    before, after = b[np.maximum(at - 1, 0)], b[np.minimum(at, len(b) - 1)]
    y = np.where(np.abs(a - before) <= np.abs(a - after), before, after)
    d = np.abs(a - y)
    k = int(np.argmin(d))
    return (int(d[k]), int(a[k]), int(y[k])) if d[k] <= reach else None


HIT = "struct<distance:int,a:bigint,b:bigint,org_at:int,kw_at:int,org:string,kw:string>"


def closest(own: dict[str, list[str]], flat: list[str], words: list[str], reach: int):
    """Of (places of flat, places of words, asked): for each asked target the closest pair of each of its names and keywords, in order."""

    @F.pandas_udf(f"array<array<{HIT}>>")
    def run(orgs: pd.Series, kws: pd.Series, asked: pd.Series) -> pd.Series:
        out = []
        for o, w, rows in zip(orgs, kws, asked):
            o = {t: starts(t, p) for t, p in zip(flat, o) if p is not None and len(p)}
            w = {t: starts(t, p) for t, p in zip(words, w) if p is not None and len(p)}
            best, of = {}, []
            for r in rows:
                hits, names, keys = [], own[r["target"]], [] if r["keywords"] is None else list(r["keywords"])
                for x in dict.fromkeys(n for n in names if n in o):
                    for y in dict.fromkeys(k for k in keys if k in w):
                        if (x, y) not in best:
                            best[x, y] = nearest(o[x], w[y], reach)
                        if best[x, y]:
                            d, i, j = best[x, y]
                            hits.append((d, names.index(x) + 1, keys.index(y) + 1, i, j, x, y))
                of.append([dict(zip(("distance", "a", "b", "org_at", "kw_at", "org", "kw"), h)) for h in sorted(hits)])
            out.append(of)
        return pd.Series(out)

    return run


def windows(found: DataFrame, docs: DataFrame, variants: dict[str, list[str]], reach: int = 1200, width: int = 1000) -> DataFrame:
    """(doc_id, target, context, fallback): text around the closest mention of each target and keyword, under a line that says what was found.

    found: (doc_id, target, keywords). variants: the names of each target, a dictionary of driver size; a
    target without any goes by its own name. Of the pairs of places within reach of a document and
    target the closest of each name and keyword count, ties by the order of names, keywords and
    places. Where none are near each other, the window is around the first name, else the first
    keyword that is there, and fallback is 1. All places of a document meet in its row, and its text
    is shuffled once.
    """
    lower = F.transform("keywords", F.lower)
    names = sorted({r["target"] for r in found.select("target").distinct().collect()} | set(variants))
    words = sorted({r["k"].lower() for r in found.select(F.explode("keywords").alias("k")).distinct().collect() if r["k"] is not None})
    asked = found.groupBy("doc_id").agg(F.collect_list(F.struct("target", lower.alias("keywords"))).alias("asked"))
    return windows_of(docs.select("doc_id", "text").join(asked, "doc_id"), names, words, variants, reach, width)


def windows_of(docs: DataFrame, names: list[str], words: list[str], variants: dict[str, list[str]], reach: int = 1200, width: int = 1000) -> DataFrame:
    """windows() of (doc_id, text, asked), asked an array of (target, keywords) in lower case: no row leaves its task. names, words: all targets and keywords that are asked."""
    own = {t: [v.lower() for v in variants.get(t, [t])] for t in names}
    table = F.create_map(*(x for t in names for x in (F.lit(t), F.array(*map(F.lit, own[t])))))
    flat = sorted({v for vs in own.values() for v in vs})
    if flat and words:
        hits = closest(own, flat, words, reach)(found_places("text", flat), found_places("text", words), "asked")
        full = docs.withColumn("hits", hits).select("doc_id", "text", F.explode(F.arrays_zip("asked", "hits")).alias("z"))
        full = full.select("doc_id", "text", "z.asked.target", "z.asked.keywords", F.when(F.size("z.hits") > 0, F.col("z.hits")).alias("hits"))
    else:
        full = docs.select("doc_id", "text", F.explode("asked").alias("z")).select("doc_id", "text", "z.target", "z.keywords", F.lit(None).cast(f"array<{HIT}>").alias("hits"))
    low = F.lower("text")
    first = lambda terms: F.get(F.filter(terms, lambda v: F.instr(low, v) > 0), 0)
    full = full.withColumn("org", first(F.element_at(table, F.col("target")))).withColumn("kw", first(F.col("keywords")))
    h, n = F.col("hits")[0], F.size("hits")
    d = h["distance"]
    near_enough = F.col("hits").isNotNull()
    at = F.when(near_enough, F.floor((h["org_at"] + h["kw_at"]) / 2)).otherwise(F.coalesce(F.instr(low, F.col("org")), F.instr(low, F.col("kw"))) - 1).cast("int")
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    icon = F.when(d < 500, "✓").otherwise("~")
    several = F.array_join(F.transform(F.slice("hits", 1, 4), lambda x: text(quote(x["org"]), "·", quote(x["kw"]), " at ", x["distance"].cast("string"), "ch")), " | ")
    more = F.when(n > 4, text(" (+", (n - 4).cast("string"), " more)")).otherwise("")
    head = (
        F.when(near_enough & (n == 1), text("[", icon, " NGO ", quote(h["org"]), " + keyword ", quote(h["kw"]), " at ", d.cast("string"), " chars — ", X.level(d), "]"))
        .when(near_enough, text("[", icon, " ", n.cast("string"), " hits — NGO ", quote(h["org"]), " + keyword ", quote(h["kw"]), " at ", d.cast("string"), " chars | also: ", several, more, "]"))
        .when(F.col("org").isNotNull() & F.col("kw").isNull(), text("[⚠ Fallback: NGO ", quote(F.col("org")), " found but no keyword nearby]"))
        .when(F.col("org").isNull() & F.col("kw").isNotNull(), text("[⚠ Fallback: keyword ", quote(F.col("kw")), " found but NGO ", quote(F.col("target")), " absent]"))
        .when(F.col("org").isNotNull(), text("[⚠ Fallback: NGO ", quote(F.col("org")), " and keyword ", quote(F.col("kw")), " beyond proximity window]"))
        .otherwise("[⚠ MISSING BOTH: neither NGO nor keyword found — likely boilerplate]")
    )
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"^[ \t\n\r\f]+", ""), r"[ \t\n\r\f]+$", "")
    lo, hi = F.greatest(F.lit(0), at - width), F.least(F.length("text"), at + width)
    body = F.when(at.isNull(), bare(F.left("text", F.lit(1000)))).otherwise(F.concat(F.when(lo > 0, "…").otherwise(""), bare(F.substr("text", lo + 1, hi - lo)), F.when(hi < F.length("text"), "…").otherwise("")))
    return full.select("doc_id", "target", F.concat(head, F.lit("\n\n"), body).alias("context"), (~near_enough).cast("int").alias("fallback"))


def proximate(contexts: DataFrame) -> DataFrame:
    """Contexts of pairs that stand near each other: those whose first line marks a fallback go."""
    return contexts.filter(~F.startswith("context", F.lit("[⚠")))
