"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. The ledger holds the
(blob, rule, rule version) triples that were scanned; only unseen ones are scanned, each blob
once however many paths hold it, and findings join back to all paths. The ledger has no
findings: what scan() found is kept beside it and given back with it, for new paths of old blobs.

Defined results. A null text is no version; an empty one is a blob without findings. Rows
without a doc_id have no path and are left out. Rows that repeat count once; a doc_id with
several texts is a path with several versions. Ledger rows with a null blob, rule or version say
nothing, and findings with one are left out. Extra columns are ignored. Findings carry the
hash of the secret, not the secret. An empty table gives no findings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text

#: (rule, version, pattern). Patterns keep to what RE2 and java.util.regex read alike. A changed pattern needs a new version.
RULES = [
    ("aws_access_key", 1, r"AKIA[0-9A-Z]{16}"),
    ("github_token", 1, r"gh[pousr]_[A-Za-z0-9]{36}"),
    ("google_api_key", 1, r"AIza[0-9A-Za-z_-]{35}"),
    ("slack_token", 1, r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    ("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("password", 1, r"[Pp]assword[=:][^ \t\n\r\x22']{6,}"),
    ("quoted_hex", 2, r"\x22[0-9A-Fa-f]{40}\x22"),
]


def versions_of(docs: DataFrame) -> DataFrame:
    return id_text(docs).filter("text is not null").withColumn("blob", F.sha2("text", 256))


def pending(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """(blob, doc_id, rules): for each blob with unseen pairs, one path that carries it, and the unseen rules."""
    blobs = versions_of(docs).groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    names = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(v).alias("version")) for r, v, _ in rules))
    if ledger is None:
        return blobs.select("blob", "doc_id", names.alias("rules"))
    pairs = blobs.select("blob", "doc_id", F.explode(names).alias("r")).select("blob", "doc_id", "r.rule", "r.version")
    known = ledger.select("blob", "rule", F.col("version").cast("int").alias("version")).dropna().distinct()
    return pairs.join(known, ["blob", "rule", "version"], "left_anti").groupBy("blob", "doc_id").agg(F.collect_list(F.struct("rule", "version")).alias("rules"))


def _finding(rule: str, version: int):
    return lambda m: F.struct(F.lit(rule).alias("rule"), F.lit(version).alias("version"), F.sha2(m, 256).alias("secret"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """Findings by blob of what the ledger lacks, and the ledger's new triples."""
    todo = pending(docs, ledger, rules)
    texts = versions_of(docs).join(todo.hint("shuffle_hash"), ["blob", "doc_id"])
    hits = F.concat(
        *(
            F.when(
                F.array_contains("rules", F.struct(F.lit(r).alias("rule"), F.lit(v).alias("version"))) & F.col("text").rlike(p),
                F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(0)), _finding(r, v)),
            ).otherwise(F.array().cast("array<struct<rule:string,version:int,secret:string>>"))
            for r, v, p in rules
        )
    )
    # counted within one text: repeated rows of the carrier give the same rows, which distinct folds
    once = texts.select("blob", hits.alias("hits")).filter(F.size("hits") > 0)
    each = once.select("blob", "hits", F.explode(F.array_distinct("hits")).alias("h"))
    found = each.select("blob", "h.*", F.size(F.filter("hits", lambda x: x == F.col("h"))).alias("n")).distinct()
    return found, todo.select("blob", F.explode("rules").alias("r")).select("blob", "r.rule", "r.version")


def secret_scan(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES, findings: DataFrame | None = None) -> DataFrame:
    """(doc_id, blob, rule, version, secret, n): findings at every path that holds the blob. findings: those by blob of the earlier scans in the ledger; without them only blobs with unseen rules have rows."""
    paths = versions_of(docs).select("doc_id", "blob").distinct()
    found = scan(docs, ledger, rules)[0]
    if findings is not None:
        now = docs.sparkSession.createDataFrame([(r, v) for r, v, _ in rules], "rule string, version int")  # superseded versions stay behind
        kept = findings.select("blob", "rule", F.col("version").cast("int").alias("version"), "secret", F.col("n").cast("int").alias("n")).dropna()
        found = found.unionByName(kept.join(F.broadcast(now), ["rule", "version"], "left_semi")).distinct()
    return paths.join(found, "blob").select("doc_id", "blob", "rule", "version", "secret", "n")


def _sql() -> str:
    one = " UNION ALL ".join(f"SELECT blob, '{r}' AS rule, {v} AS version, unnest(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}')) AS m FROM blobs" for r, v, p in RULES)
    return f"""
WITH versions AS (SELECT doc_id, text, sha256(text) AS blob FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
blobs AS (SELECT blob, any_value(text) AS text FROM versions GROUP BY blob),
found AS (SELECT blob, rule, version, sha256(m) AS secret, CAST(count(*) AS INTEGER) AS n FROM ({one}) GROUP BY 1, 2, 3, 4)
SELECT doc_id, blob, rule, version, secret, n FROM (SELECT DISTINCT doc_id, blob FROM versions) JOIN found USING (blob)
"""


SQL = _sql()
