"""The dictionary of organisations: patterns of names and hosts, name variations, relations between actors and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomnet.functions import text as X
from loomnet.functions import urls as U
from loomnet.operators import dedup

MINOR = ("a", "pro", "na", "v", "ve", "o", "s", "se", "z", "za", "the", "of")


def initials(name) -> Column:
    """Initials of the words that matter, where two to six of at least two words."""
    words = F.filter(F.split(X.fold(name), r"[\s,-]+"), lambda w: (w != "") & ~F.lower(w).isin(*MINOR))
    letters = F.array_join(F.transform(F.filter(words, lambda w: w.rlike("^[A-Za-z]")), lambda w: F.upper(F.left(w, F.lit(1)))), "")
    return F.when((F.size(words) >= 2) & F.length(letters).between(2, 6), letters)


def patterns(orgs: DataFrame, known: dict[str, list[tuple[str, str]]] | None = None, manual: dict[str, list[tuple[str, str]]] | None = None, noise=(), stop=("www", "home", "site"), collisions=("SEVER", "MIR")) -> DataFrame:
    """(org_id, ord, text, mode, kind, risk) of organisations (org_id, name, seed_url).

    In order: patterns validated earlier, by folded name; the folded name without brackets and
    subtitle, from five letters; the stem of a single word; the first label of the host, from four
    letters; forms given by hand. Of equal texts of a mode the first counts; those measured as noise go,
    validated ones excepted. An org is HIGH risk where a pattern is another word or a very short one in
    any case, validated where it was, else review.
    """
    spark, name = orgs.sparkSession, F.col("name")
    full = F.trim(F.regexp_replace(F.regexp_replace(F.lower(X.fold(name)), r"\s*\[.*?\]\s*", " "), r"\s+-\s+.*$", ""))
    stem = F.when(~F.contains(full, F.lit(" ")) & (F.length(full) >= 5), F.regexp_replace(full, "[aeiouy]{1,2}$", ""))
    token = F.lower(X.fold(U.domain_token("seed_url")))
    row = lambda k, text, mode, kind: F.struct(F.lit(k).alias("k"), text.alias("text"), F.lit(mode).alias("mode"), F.lit(kind).alias("kind"))
    made = F.array(row(100, F.when(F.length(full) >= 5, full), "ci", "fullname"), row(200, F.when(~stem.isin(*stop), stem), "ci", "stem"), row(300, F.when((F.length(token) >= 4) & ~token.isin(*stop), token), "ci", "domain"))
    own = orgs.select("org_id", F.explode(made).alias("p")).select("org_id", "p.*")
    key = F.lower(X.fold(name))
    for kind, table, base, by in (("thesis", known, 0, key), ("manual", manual, 400, F.col("org_id").cast("string"))):
        if table:
            fold = lambda t: "".join(X.PLAIN[X.ACCENTS.index(c)] if c in X.ACCENTS else c for c in t)
            rows = [(fold(o).lower() if kind == "thesis" else o, base + k, fold(t).strip(), m) for o, ps in table.items() for k, (t, m) in enumerate(ps)]
            given = spark.createDataFrame(rows, "key string, k int, text string, mode string")
            own = own.unionByName(orgs.select("org_id", by.alias("key")).join(given, "key").select("org_id", "k", "text", "mode", F.lit(kind).alias("kind")))
    own = own.filter("text is not null and text <> ''")
    one = own.groupBy("org_id", F.lower("text").alias("low"), "mode").agg(F.min(F.struct("k", "text", "kind")).alias("r")).select("org_id", "mode", "r.*")
    if noise:
        one = one.filter((F.col("kind") == "thesis") | ~F.col("text").isin(*noise))
    short = (F.col("mode") == "ci") & (F.length("text") <= 5) & ~F.contains("text", F.lit(" "))
    bad = F.upper("text").isin(*collisions) | short
    risk = one.groupBy("org_id").agg(F.max(bad.cast("int")).alias("bad"), F.max((F.col("kind") == "thesis").cast("int")).alias("valid"))
    label = F.when(F.col("bad") == 1, "HIGH").when(F.col("valid") == 1, "validated").otherwise("review")
    return one.join(risk, "org_id").select("org_id", F.col("k").alias("ord"), "text", "mode", "kind", label.alias("risk"))


SUFFIXES = (" z.s.", " o.s.", " z. s.", " o. s.", ", z.s.", ", o.s.")


def variations(names: DataFrame) -> DataFrame:
    """(variation, name): the lower-case name, the name without its legal form, and its first and last word of over four letters. Of names that share a variation the last one counts."""
    n = F.col("name")
    short = F.lit(None).cast("string")
    for s in reversed(SUFFIXES):
        short = F.when(F.endswith(F.lower(n), F.lit(s)), F.trim(F.substr(n, F.lit(1), F.length(n) - len(s)))).otherwise(short)
    words = F.split(F.trim(n), r"\s+")
    far = lambda w: F.when((F.size(words) > 1) & (F.length(w) > 4), F.lower(w))
    made = F.array(F.lower(n), F.lower(short), far(words[0]), far(F.element_at(words, -1)))
    x = names.select("ord", "name", F.explode(F.array_distinct(F.array_compact(made))).alias("variation"))
    return x.groupBy("variation").agg(F.max_by("name", "ord").alias("name"))


def joined_by_name(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a with those of b that have the same name but for case, accents and spaces."""
    return a.withColumn("key", X.match_key(F.col("name"))).join(b.select(X.match_key(F.col("name")).alias("key"), F.col("id").alias("other")), "key").drop("key")


TYPES = {"collaboration_ties": 1, "information_exchange": 2, "funding_ties": 3}


def tie_type(schema) -> Column:
    """Number of a kind of tie, 0 for others."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv)), schema), F.lit(0))


def tiered(relations: DataFrame, kinds: DataFrame) -> DataFrame:
    """relations (src, tgt, type) with the tier that the kinds (name, kind) of their ends give, and whether they are valid."""
    a, b = kinds.select(F.col("name").alias("src"), F.col("kind").alias("ka")), kinds.select(F.col("name").alias("tgt"), F.col("kind").alias("kb"))
    x = relations.join(a, "src", "left").join(b, "tgt", "left")
    t = dedup.tier(F.coalesce("ka", F.lit("extended")), F.coalesce("kb", F.lit("extended")))
    return x.withColumn("tier", t).withColumn("valid", (t != "invalid").cast("int")).drop("ka", "kb")


def validation_stats(tiered_: DataFrame) -> DataFrame:
    """Relations by tier, and by type how many are valid, in one table."""
    by_tier = tiered_.groupBy(F.col("tier").alias("name")).agg(F.count("*").alias("n"), F.sum("valid").alias("valid")).withColumn("of", F.lit("tier"))
    by_type = tiered_.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n"), F.sum("valid").alias("valid")).withColumn("of", F.lit("type"))
    return by_tier.unionByName(by_type)


def network_stats(edges: DataFrame, degrees: DataFrame) -> DataFrame:
    """Nodes, edges, mean degree and density of a merged network, and its edges by type and nodes by tier."""
    n = degrees.agg(F.count("*").alias("nodes"), F.avg("degree").alias("mean"))
    e = edges.agg(F.count("*").alias("edges"))
    all_ = n.crossJoin(e).select(F.explode(F.create_map(F.lit("nodes"), F.col("nodes").cast("double"), F.lit("edges"), F.col("edges").cast("double"), F.lit("mean_degree"), F.round("mean", 6), F.lit("density"), F.round(F.try_divide(2.0 * F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)), 6))).alias("name", "value"))
    types = edges.groupBy(F.concat(F.lit("type:"), "type").alias("name")).agg(F.count("*").cast("double").alias("value"))
    tiers = degrees.groupBy(F.concat(F.lit("tier:"), "tier").alias("name")).agg(F.count("*").cast("double").alias("value"))
    return all_.unionByName(types).unionByName(tiers)


def raw_export(relations: DataFrame, path: str) -> None:
    """One folder of JSON lines a type."""
    relations.write.mode("overwrite").partitionBy("type").json(path)


def link_edges(direct: DataFrame, shared: DataFrame) -> DataFrame:
    """Direct and shared-reference edges in one list."""
    return direct.select("src", "tgt", F.lit("direct").alias("method"), F.col("n").alias("weight")).unionByName(shared.select(F.col("org_a").alias("src"), F.col("org_b").alias("tgt"), F.lit("shared").alias("method"), "weight"))
