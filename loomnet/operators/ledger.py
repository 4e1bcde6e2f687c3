"""Status ledgers of crawled URLs: counts, audits, snapshots, streaks, queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATUS = ("pending", "in_progress", "done", "failed", "excluded")


def status_counts(urls: DataFrame, key: str = "org_id") -> DataFrame:
    """A column a status, from conditional sums: no second pass for the pivot's values."""
    return urls.groupBy(key).agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUS), F.count("*").alias("total"))


def status_pivot(urls: DataFrame, key: str = "org_id") -> DataFrame:
    return urls.groupBy(key).pivot("status", list(STATUS)).agg(F.count(F.lit(1))).fillna(0)


def last_activity(urls: DataFrame, key: str = "org_id") -> DataFrame:
    return urls.groupBy(key).agg(F.max("fetched_at").alias("last_activity"))


def org_stats(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """Status counts with pages and last activity; orgs without pages have 0."""
    p = pages.groupBy("org_id").agg(F.count("*").alias("pages"))
    return status_counts(urls).join(p, "org_id", "left").join(last_activity(urls), "org_id", "left").fillna(0, ["pages"])


def global_stats(urls: DataFrame) -> DataFrame:
    return urls.groupBy("status").agg(F.count("*").alias("n"))


def failure_classes(urls: DataFrame) -> DataFrame:
    e = F.col("error")
    kind = F.when(F.startswith(e, F.lit("HTTP 4")), "client").when(F.startswith(e, F.lit("HTTP 5")), "server").when(F.contains(e, F.lit("timeout")), "timeout").otherwise("other")
    return urls.filter("status = 'failed'").groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


def top_errors(urls: DataFrame, n: int = 5, width: int = 40) -> DataFrame:
    return urls.filter("status = 'failed'").groupBy(F.left("error", F.lit(width)).alias("error")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(n)


def exclusion_classes(urls: DataFrame) -> DataFrame:
    r = F.when(F.startswith("reason", F.lit("redirect:")), "redirect").otherwise(F.col("reason"))
    return urls.filter("status = 'excluded'").groupBy(r.alias("reason")).agg(F.count("*").alias("n"))


def coverage(urls: DataFrame) -> DataFrame:
    """Share of URLs done, backlog and excluded of each org, in one aggregate."""
    s = lambda *x: F.count_if(F.col("status").isin(*x))
    return urls.groupBy("org_id").agg(F.count("*").alias("discovered"), s("done").alias("done"), s("pending", "in_progress").alias("backlog"), s("excluded").alias("excluded"), F.round(100.0 * s("done") / F.count("*"), 2).alias("done_pct"))


def latest(snapshots: DataFrame) -> DataFrame:
    """The last snapshot of each URL; ties go to the higher id."""
    return snapshots.groupBy("org_id", "url").agg(F.max_by(F.struct("id", "hash", "fetched_at"), F.struct("fetched_at", "id")).alias("s")).select("org_id", "url", "s.*")


def deleted(urls: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Failed URLs whose content was once kept, with the last of it."""
    return urls.filter("status = 'failed'").select("org_id", "url").distinct().join(latest(snapshots), ["org_id", "url"])


def unchanged(snapshots: DataFrame) -> DataFrame:
    """Whether each snapshot has the content of the one before."""
    w = Window.partitionBy("org_id", "url").orderBy("fetched_at", "id")
    return snapshots.select("id", F.coalesce(F.lag("hash").over(w) == F.col("hash"), F.lit(False)).cast("int").alias("unchanged"))


def streaks(urls: DataFrame, least: int = 3) -> DataFrame:
    """Runs of consecutive failures of an org (gaps and islands), of at least ``least``, with the pause that follows."""
    a, b = Window.partitionBy("org_id").orderBy("fetched_at", "id"), Window.partitionBy("org_id", "bad").orderBy("fetched_at", "id")
    x = urls.withColumn("bad", (F.col("status") == "failed").cast("int")).withColumn("island", F.row_number().over(a) - F.row_number().over(b)).filter("bad = 1")
    g = x.groupBy("org_id", "island").agg(F.count("*").alias("n"), F.min("fetched_at").alias("first"), F.max("fetched_at").alias("last"))
    return g.filter(F.col("n") >= least).select("org_id", "n", "first", "last", F.least(30 * F.col("n"), F.lit(180)).alias("pause_s"))


def claims(urls: DataFrame) -> DataFrame:
    """The next URL of each org: those to fetch again first, then by depth and id."""
    w = Window.partitionBy("org_id").orderBy("refetch", "depth", "id")
    return urls.filter("status = 'pending'").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("org_id", "id")


def new_urls(found: DataFrame, known: DataFrame) -> DataFrame:
    """URLs whose identity (org_id, url_key) is new, the first of each."""
    one = found.groupBy("org_id", "url_key").agg(F.min_by("url", "id").alias("url"), F.min("id").alias("id"))
    return one.join(known.select("org_id", "url_key").distinct(), ["org_id", "url_key"], "left_anti")


def next_status(ok, in_scope, kind_ok, size, least: int = 100):
    """Outcome of a fetch: status and reason, the first test that fails."""
    return F.when(~ok, F.struct(F.lit("failed").alias("status"), F.lit("fetch").alias("reason"))).when(~in_scope, F.struct(F.lit("excluded"), F.lit("out_of_scope"))).when(~kind_ok, F.struct(F.lit("excluded"), F.lit("content_type"))).when(size < least, F.struct(F.lit("excluded"), F.lit("too_short"))).otherwise(F.struct(F.lit("done"), F.lit(None).cast("string")))


def requeued(urls: DataFrame, mode: str = "all") -> DataFrame:
    """Rows to fetch again: done ones, all of them or hubs only; failed and claimed ones become pending."""
    again = (F.col("status") == "done") & (F.lit(mode == "all") | (F.lit(mode == "hubs") & F.col("is_hub")))
    return urls.withColumn("refetch", F.when(again, 1).otherwise(0)).withColumn("status", F.when(again | F.col("status").isin("failed", "in_progress"), "pending").otherwise(F.col("status")))


def finished(urls: DataFrame, updates: DataFrame) -> DataFrame:
    """Partial updates by id: fields that are null in an update stay; done clears refetch."""
    u = updates.select("id", F.col("status").alias("s"), F.col("error").alias("e"), F.col("hash").alias("h"))
    j = urls.join(u, "id", "left")
    return j.withColumn("status", F.coalesce("s", "status")).withColumn("error", F.coalesce("e", "error")).withColumn("hash", F.coalesce("h", "hash")).withColumn("refetch", F.when(F.col("s") == "done", 0).otherwise(F.col("refetch"))).drop("s", "e", "h")


def flagged(pages: DataFrame, least: int = 50_000) -> DataFrame:
    return pages.groupBy("org_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
