"""Cleaning of page corpora: date filters with reasons, fix-ups, content extraction, templates, joins of texts with their pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomnet.functions import dates as D
from loomnet.functions import markup as M
from loomnet.functions import text as X
from loomnet.operators import dedup as U
from loomnet.operators import links as L


def rescued(date: Column, html: Column, first: str, last: str, year: str = "2025") -> Column:
    """Whether a page is kept: its date is in range, or it has none and names the year."""
    return F.when(date.isNotNull(), D.in_range(date, first, last)).otherwise(F.coalesce(F.contains(html, F.lit(year)), F.lit(False)))


def dated(texts: DataFrame, pages: DataFrame, first: str, last: str) -> DataFrame:
    """texts (file, org) with their pages (file, date, source): kept and why not. A text without a page is excluded, one without a date too."""
    p = pages.select("file", "date", "source", F.lit(1).alias("page"))
    x = texts.join(p, "file", "left")
    reason = F.when(F.col("page").isNull(), "no_html").when(F.col("date").isNull(), "no_date").when(~D.in_range("date", first, last), F.concat(F.lit("out_of_range: "), F.col("date")))
    return x.withColumn("reason", reason).withColumn("kept", reason.isNull().cast("int")).drop("page")


def date_report(filtered: DataFrame) -> DataFrame:
    """Counters of dated() by org."""
    r = F.split_part(F.coalesce("reason", F.lit("kept")), F.lit(":"), F.lit(1))
    return filtered.groupBy("org").agg(F.count("*").alias("total"), F.sum("kept").alias("kept"), *(F.count_if(r == k).alias(k) for k in ("no_html", "no_date", "out_of_range")))


def by_year(texts: DataFrame, originals: DataFrame) -> DataFrame:
    """texts in the year of their original page (file, html_file, date); those without one go to other."""
    x = texts.join(originals.select("file", "html_file", "date"), "file", "left")
    return x.withColumn("year", F.when(F.col("html_file").isNull(), "other").otherwise(D.year_bucket("date"))).drop("date")


def synthesized(texts: DataFrame, manifest: DataFrame, on_disk: DataFrame) -> DataFrame:
    """The page of each text by the stem of its file name: from the manifest, else from the files that are there, else none."""
    stem = lambda c: F.regexp_replace(c, r"\.[A-Za-z0-9]+$", "")
    m = manifest.groupBy(stem("file").alias("stem")).agg(F.min("file").alias("listed"))
    d = on_disk.groupBy(stem("file").alias("stem")).agg(F.min("file").alias("there"))
    x = texts.withColumn("stem", stem("file")).join(m, "stem", "left").join(d, "stem", "left")
    return x.select("file", F.coalesce("listed", "there").alias("html_file"), F.when(F.col("listed").isNotNull(), "manifest").when(F.col("there").isNotNull(), "disk").otherwise("none").alias("found"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(filename, url) of a JSON-lines manifest, the last line of a file name counts."""
    m = spark.read.schema("filename string, url string").json(path).withColumn("line", F.monotonically_increasing_id())
    return m.filter("filename is not null").groupBy("filename").agg(F.max_by("url", "line").alias("url"))


def extracted(pages: DataFrame, how: str = "conservative", least: int = 50) -> DataFrame:
    """(page_id, text, status) of pages: conservative keeps all but scripts, main picks the content block. Texts of at most least characters are too short."""
    text = X.html_to_text("html") if how == "conservative" else M.main_content("html")
    x = pages.select("page_id", text.alias("text"))
    return x.withColumn("status", F.when(F.length("text") > least, "ok").when(F.col("text").isNull(), "error").otherwise("too_short"))


def safe(sig) -> Column:
    """Whether an element signature names something that likely holds content."""
    s = F.lower(sig)
    out = F.lit(False)
    for w in M.SAFE:
        out = out | F.contains(s, F.lit(w))
    return out


def templates(pages: DataFrame, share: float = 0.8, least: int = 10) -> DataFrame:
    """(scope, sig, df, safe): signatures of all pages and of sections, in one table."""
    g = L.signatures(pages, share).select(F.lit("*").alias("scope"), "sig", "df")
    s = L.section_signatures(pages, 1, least, share).select(F.col("section").alias("scope"), "sig", "df")
    return g.unionByName(s).withColumn("safe", safe("sig").cast("int"))


def reused(spark: SparkSession, path: str, pages: DataFrame, force: bool = False) -> DataFrame:
    """The templates stored at path; found and stored where there are none yet, or on request."""
    from pyspark.errors import AnalysisException

    if not force:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    templates(pages).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cleaned_corpus(pages: DataFrame, org, threshold: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """The first cleaning as one plan: main texts, near duplicates, and of each group its representative; metadata says of each page what it is a duplicate of."""
    texts = extracted(pages.withColumn("org", org), "main").filter("status = 'ok'").select(F.col("page_id").alias("doc_id"), "text")
    groups = U.clusters(texts, threshold)
    meta = texts.join(groups, "doc_id").select("doc_id", F.length("text").alias("n_chars"), (F.col("master") != F.col("doc_id")).cast("int").alias("is_duplicate"), F.when(F.col("master") != F.col("doc_id"), F.col("master")).alias("duplicate_of"))
    return texts.join(meta.filter("is_duplicate = 0").select("doc_id"), "doc_id", "left_semi"), meta


FIXES = {
    "only_one": lambda html: F.date_format(D.only_one(html, r"\b(\d{1,2}\. ?\d{1,2}\. ?20[0-2]\d)\b"), "yyyy-MM-dd"),
    "time_in_content": lambda html: M.date_in_content(html),
    "published": lambda html: F.coalesce(M.date_published(html), F.date_format(F.try_to_date(D.open_graph(html)), "yyyy-MM-dd")),
    "iso_only_one": lambda html: F.date_format(D.only_one(html, r"(20[0-2]\d-\d{2}-\d{2})"), "yyyy-MM-dd"),
}


def refiled(corpus: DataFrame, pages: DataFrame, org: str, fix: str, first: int = 2016, last: int = 2025) -> DataFrame:
    """corpus (file, org, year) with one org's rows dropped and filed again by the date that a site's own rule finds in its pages (file, org, html); pages without one are out. Written back, only that org's partitions change."""
    again = pages.filter(F.col("org") == org).select("file", "org", FIXES[fix](F.col("html")).alias("date")).filter("date is not null")
    again = again.select("file", "org", D.year_bucket("date", first, last).alias("year")).filter("year <> 'other'")
    return corpus.filter(~F.col("org").eqNullSafe(F.lit(org))).select("file", "org", "year").unionByName(again)


def rewrite_org(corpus: DataFrame, path: str) -> None:
    """Overwrites the partitions that corpus has, and no others."""
    corpus.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("org").parquet(path)
