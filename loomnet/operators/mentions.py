"""Dictionary mentions, keyword scores and gates over documents (doc_id, source, text)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomnet.functions import text as X


def normal(c) -> Column:
    """Folded lower-case text that patterns are matched against."""
    return F.replace(F.lower(X.fold(c)), F.lit("ß"), F.lit("ss"))


def word_pattern(terms) -> str:
    return r"\b(?:" + "|".join(X.escaped(t) for t in X.longest_first(terms)) + r")\b"


def folded_term(t: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)).replace("ß", "ss").strip()


def counted(docs: DataFrame, terms, name: str = "term", text: Column | None = None) -> DataFrame:
    """(doc_id, term, n_hits) of all terms in one pass: one alternation finds them, whatever their number. A term begins at a word's start; what follows it is free, so that inflected forms count, but for terms under five letters."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all(normal("text") if text is None else text, F.lit(X.alternation(terms)), F.lit(0))).alias(name))
    return found.groupBy("doc_id", name).agg(F.count("*").alias("n_hits"))


def org_hits(docs: DataFrame, orgs: DataFrame) -> DataFrame:
    """(doc_id, org, n_hits, is_self). orgs: (org, term), a dictionary of driver size, and mode where there is one: terms of mode cs match case by case, all others in any case."""
    rows = orgs.withColumn("mode", F.col("mode") if "mode" in orgs.columns else F.lit("ci")).select("org", "term", "mode").collect()
    hits = None
    for mode, text in (("ci", normal("text")), ("cs", X.fold("text"))):
        own = sorted({(folded_term(r["term"]).lower() if mode == "ci" else folded_term(r["term"]), r["org"]) for r in rows if (r["mode"] == "cs") == (mode == "cs")})
        if own:
            part = counted(docs, [t for t, _ in own], text=text).join(docs.sparkSession.createDataFrame(own, "term string, org string"), "term")
            hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        return docs.select("doc_id", "source", F.lit("").alias("org"), F.lit(0).cast("long").alias("n_hits"), F.lit(0).alias("is_self")).drop("source").limit(0)
    hits = hits.groupBy("doc_id", "org").agg(F.sum("n_hits").alias("n_hits"))
    return hits.join(docs.select("doc_id", "source"), "doc_id").select("doc_id", "org", "n_hits", (F.col("org") == F.col("source")).cast("int").alias("is_self"))


def keyword_hits(docs: DataFrame, keywords: DataFrame) -> DataFrame:
    """(doc_id, category, root, n_hits). keywords: (category, root, term, weight)."""
    terms = [r["term"] for r in keywords.select("term").distinct().collect()]
    return counted(docs, terms).join(keywords, "term").groupBy("doc_id", "category", "root").agg(F.sum("n_hits").alias("n_hits"))


def targets(docs: DataFrame, orgs: DataFrame, keywords: DataFrame, category: str = "relation") -> DataFrame:
    """doc_id, source, sorted other organisations and sorted keywords of one category; documents without any have empty arrays.

    Two scans a document, whatever the dictionaries' sizes: one alternation of all organisations' terms,
    as in the index, and one of all keywords, which stand between characters that aren't ASCII word
    characters, the longest that fits. Arrays are built in the row, without a shuffle.
    """
    by: dict = {}
    for r in orgs.collect():
        by.setdefault(folded_term(r["term"]).lower(), set()).add(r["org"])
    words = sorted({r["term"].lower() for r in keywords.filter(F.col("category") == category).collect()})
    none = F.array().cast("array<string>")
    others, kws = none, none
    if by:
        table = F.create_map(*(x for t, o in sorted(by.items()) for x in (F.lit(t), F.array(*map(F.lit, sorted(o))))))
        hits = F.array_distinct(F.regexp_extract_all(normal("text"), F.lit(X.alternation(by)), F.lit(0)))
        others = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(hits, lambda m: F.element_at(table, m))), lambda o: ~o.eqNullSafe(F.col("source")))))
    if words:
        kws = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(X.ascii_bounded(words)), F.lit(0))))
    return docs.select("doc_id", "source", F.coalesce(others, none).alias("targets"), F.coalesce(kws, none).alias("keywords"))


def gate(found: DataFrame) -> DataFrame:
    """Documents that mention another organisation and a keyword."""
    return found.filter((F.size("targets") > 0) & (F.size("keywords") > 0))


def reason() -> Column:
    """Why the gate drops a document, or kept."""
    return F.when(F.size("targets") == 0, "no_org").when(F.size("keywords") == 0, "no_keyword").otherwise("kept")


def keyword_score(docs: DataFrame, keywords: DataFrame, mentions=(), per_mention: int = 5) -> DataFrame:
    """doc_id, mention_count, raw_score, word_count, density: keyword weights and mentions, and the score of a hundred words."""
    t = normal("text")
    weights = {folded_term(r["term"]).lower(): r["weight"] for r in keywords.orderBy("weight").collect()}
    score = F.lit(0)
    if weights:  # one scan for all terms
        table = F.create_map(*(F.lit(x) for kv in sorted(weights.items()) for x in kv))
        score = F.aggregate(F.regexp_extract_all(t, F.lit(word_pattern(weights)), F.lit(0)), F.lit(0), lambda acc, m: acc + F.element_at(table, m))
    named = F.regexp_count(t, F.lit(word_pattern(mentions))) if mentions else F.lit(0)
    words = F.regexp_count("text", F.lit(r"[^ \t\n\r\f]+"))
    base = docs.select("doc_id", "source", named.alias("mention_count"), (score + named * per_mention).cast("long").alias("raw_score"), words.alias("word_count"))
    return base.withColumn("density", F.round(F.coalesce(F.try_divide(F.col("raw_score") * 100.0, F.col("word_count")), F.lit(0.0)), 6))


def score_gate(scored: DataFrame, least_score: float = 8, least_density: float = 0.7, least_mentions: int = 0) -> DataFrame:
    """kept, and why not: all thresholds that fail, with their values."""
    tests = (("score", "raw_score", least_score), ("density", "density", least_density), ("mentions", "mention_count", least_mentions))
    why = F.concat_ws("; ", *(F.when(F.col(c) < m, F.lit(f"{n} below {m:g}")) for n, c, m in tests))
    return scored.withColumn("why", why).withColumn("kept", (F.col("why") == "").cast("int"))


def score_totals(gated: DataFrame) -> DataFrame:
    kept = F.col("kept") == 1
    return gated.agg(F.count_if(kept).alias("n_kept"), F.count_if(~kept).alias("n_excluded"), F.round(F.avg(F.when(kept, F.col("raw_score"))), 6).alias("avg_score"), F.round(F.avg(F.when(kept, F.col("density"))), 6).alias("avg_density"), F.sum(F.when(kept, F.col("mention_count"))).alias("mentions"))


def topic_filter(docs: DataFrame, wanted, unwanted, reach: int = 1000) -> DataFrame:
    """Relevant unless the first characters hold three unwanted words and fewer than two wanted ones. Texts that can't be judged are relevant."""
    head = F.lower(F.left("text", F.lit(reach)))
    n = lambda ws: sum((F.contains(head, F.lit(w)).cast("int") for w in ws), F.lit(0))
    return docs.select("doc_id", n(wanted).alias("n_wanted"), n(unwanted).alias("n_unwanted")).withColumn("relevant", F.coalesce(~((F.col("n_unwanted") >= 3) & (F.col("n_wanted") < 2)), F.lit(True)).cast("int"))


def with_twins(variants: DataFrame) -> DataFrame:
    """Names and their forms without diacritics: (org, variant)."""
    return variants.select("org", F.explode(F.array_distinct(F.array(F.lower("variant"), F.lower(X.fold("variant"))))).alias("variant"))


def mentioning(docs: DataFrame, orgs: DataFrame) -> DataFrame:
    """(org, doc_id, n_docs): for each organisation the documents of others that mention it, a row each, and how many they are."""
    hits = org_hits(docs, orgs).filter("is_self = 0").select("org", "doc_id")
    return hits.join(hits.groupBy("org").agg(F.count("*").alias("n_docs")), "org").select("org", "doc_id", "n_docs")


def cut_boilerplate(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """Text up to the first marker of its source. rules: (source, marker), one a source. changed: whether it was cut."""
    j = docs.join(rules, "source", "left")
    at = F.when(F.col("marker").isNotNull(), F.instr(F.col("text"), F.col("marker"))).otherwise(0)
    clean = F.when(at > 0, F.regexp_replace(F.substr("text", F.lit(1), at - 1), r"[ \t\n\r\f]+$", "")).otherwise(F.col("text"))
    return j.select("doc_id", "source", clean.alias("text"), (at > 0).cast("int").alias("changed"))


def revalidated(found: DataFrame, cleaned: DataFrame, variants: dict[str, list[str]]) -> DataFrame:
    """Targets that the cleaned text still holds in any variant; rows left without any go, rows without a cleaned text stay."""
    table = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in variants.items() for x in kv))
    j = found.join(cleaned.select("doc_id", F.col("text").alias("clean")), "doc_id", "left")
    alive = F.filter("targets", lambda o: F.exists(F.coalesce(F.try_element_at(table, o), F.array(o)), lambda v: F.contains(F.lower("clean"), F.lower(v))))
    return j.withColumn("targets", F.when(F.col("clean").isNull(), F.col("targets")).otherwise(alive)).drop("clean").filter(F.size("targets") > 0)


def index(docs: DataFrame, orgs: DataFrame, keywords: DataFrame, done: DataFrame | None = None, category: str = "relation") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three index tables of documents that done (doc_id) lacks: docs with their gate, doc_orgs, doc_kw."""
    todo = docs if done is None else docs.join(done.select("doc_id"), "doc_id", "left_anti")
    o, k = org_hits(todo, orgs), keyword_hits(todo, keywords)
    n_orgs = o.filter("is_self = 0").groupBy("doc_id").agg(F.count("*").alias("n_other_orgs"))
    n_kw = k.filter(F.col("category") == category).groupBy("doc_id").agg(F.sum("n_hits").alias("n_relation_kw"))
    d = todo.select("doc_id", "source", F.length("text").alias("text_chars"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n_lines")).join(n_orgs, "doc_id", "left").join(n_kw, "doc_id", "left").fillna(0, ["n_other_orgs", "n_relation_kw"])
    return d.withColumn("passes_gate", ((F.col("n_other_orgs") > 0) & (F.col("n_relation_kw") > 0)).cast("int")), o, k


def pattern_check(docs: DataFrame, orgs: DataFrame) -> DataFrame:
    """For each term: share of its owner's documents and of all that hold it, and in how many sources it occurs."""
    total = docs.agg(F.count("*").alias("total"))
    own = docs.groupBy(F.col("source").alias("org")).agg(F.count("*").alias("own"))
    terms = [r["term"] for r in orgs.select("term").distinct().collect()]
    hits = counted(docs, terms).join(docs.select("doc_id", "source"), "doc_id").join(orgs, "term")
    agg = hits.groupBy("term", "org").agg(F.count("*").alias("n_docs"), F.count_if(F.col("org") == F.col("source")).alias("n_own"), F.count_distinct("source").alias("breadth"))
    return agg.join(own, "org", "left").crossJoin(total).select("term", "org", "n_docs", "breadth", F.round(F.coalesce(F.try_divide("n_own", "own"), F.lit(0.0)), 6).alias("self_hit"), F.round(F.col("n_docs") / F.col("total"), 6).alias("share"))
