"""The crawl as tables: expansion of fetched pages into the frontier, outcomes of stores, queues, cooldowns, sessions and imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomnet.functions import urls as U


def expanded(links: DataFrame, depths: DataFrame, max_depth: int = 3, banned_path: str | None = None, cap: int = 100) -> DataFrame:
    """Frontier rows (org_id, url, url_key, status, reason, source, depth, parent) of the internal links of fetched pages.

    links: (page_id, source, target, link_type, pos); depths: (page_id, depth). Targets are brought to their
    canonical form before they are compared; of those with one identity in an org the first stays. An
    excluded pattern goes before a trap, a trap before the depth.
    """
    x = links.filter("link_type = 'internal'").join(depths.select("page_id", "depth"), "page_id")
    x = x.withColumn("org_id", U.host("source")).withColumn("url", U.canonical(F.col("target"))).withColumn("url_key", U.url_key("url")).withColumn("depth", F.coalesce("depth", F.lit(0)) + 1)
    one = x.groupBy("org_id", "url_key").agg(F.min_by(F.struct("url", "depth", F.col("source").alias("parent")), F.struct("page_id", "pos")).alias("r")).select("org_id", "url_key", "r.*")
    trap = U.trap_reason(F.col("url"), None if banned_path is None else F.lit(banned_path), cap)
    reason = F.coalesce(U.exclusion_reason("url"), trap, F.when(F.col("depth") > max_depth, "max_depth"))
    return one.select("org_id", "url", "url_key", F.when(reason.isNull(), "pending").otherwise("excluded").alias("status"), reason.alias("reason"), F.lit("link").alias("source"), "depth", "parent")


def stored(fetched: DataFrame) -> DataFrame:
    """(id, page_id, outcome) of fetched pages (id, org_id, hash, old_hash, old_path, refetch): unchanged where the content is that of the last fetch, duplicate_content where another page of the org has it already, changed on a fetch again, else new. Only changed and new ones are written; they get the org's next numbers, the others 0."""
    first = Window.partitionBy("org_id", "hash").orderBy("id")
    same = F.col("old_hash").eqNullSafe(F.col("hash")) & F.col("old_path").isNotNull()
    x = fetched.withColumn("same", same).withColumn("rank", F.row_number().over(first))
    x = x.withColumn("outcome", F.when(F.col("same"), "unchanged").when(F.col("rank") > 1, "duplicate_content").when(F.col("refetch") == 1, "changed").otherwise("new"))
    keep = F.col("outcome").isin("changed", "new")
    seq = F.sum(keep.cast("int")).over(Window.partitionBy("org_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    return x.select("id", "org_id", "outcome", F.when(keep, seq).otherwise(0).cast("long").alias("seq"))


def numbered(pages: DataFrame, last: DataFrame) -> DataFrame:
    """pages with the next numbers of their org. last: (org_id, seq), the highest so far."""
    rn = F.row_number().over(Window.partitionBy("org_id").orderBy("id"))
    return pages.join(last.select("org_id", F.col("seq").alias("base")), "org_id", "left").withColumn("seq", (F.coalesce("base", F.lit(0)) + rn).cast("long")).drop("base")


def queued(found: DataFrame, known: DataFrame, max_depth: int, max_pages: int | None = None, visited: int = 0) -> tuple[DataFrame, DataFrame]:
    """The first crawler's queue: rows (priority, depth, url, parent) that go in, and counters of those that don't.

    found: (id, url, depth, parent, priority), in order of id; known: (url) that were visited or queued. An
    invalid URL is skipped first, then a known one, then one too deep, then all once max_pages are visited.
    """
    x = found.withColumn("normal", F.when(U.scheme("url").isin("http", "https"), U.normalize("url")))
    x = x.withColumn("rn", F.row_number().over(Window.partitionBy("normal").orderBy(F.col("depth") > max_depth, "id")))
    k = known.select(U.normalize("url").alias("normal")).distinct().withColumn("old", F.lit(1))
    x = x.join(k, "normal", "left")
    full = F.lit(max_pages is not None and visited >= (max_pages or 0))
    state = F.when(F.col("normal").isNull(), "skipped_invalid").when((F.col("old") == 1) | (F.col("rn") > 1), "duplicate").when(F.col("depth") > max_depth, "skipped_depth").when(full, "skipped_max_pages").otherwise("queued")
    x = x.withColumn("state", state)
    rows = x.filter("state = 'queued'").select(F.coalesce("priority", F.lit(3)).alias("priority"), "depth", F.col("normal").alias("url"), "parent")
    names = ("queued", "duplicate", "skipped_invalid", "skipped_depth", "skipped_max_pages")
    return rows, x.agg(*(F.count_if(F.col("state") == n).alias(n) for n in names))


def page_links(links: DataFrame, seeds: list[str]) -> DataFrame:
    """Links of a page for the first crawler: under a seed's prefix or not, documents at priority 0, what a pattern excludes gone."""
    under = F.lit(False)
    for s in seeds:
        under = under | F.startswith("target", F.lit(s))
    x = links.filter(U.exclusion_reason("target").isNull())
    return x.select("page_id", "target", under.cast("int").alias("in_scope"), F.when(U.is_document("target"), 0).otherwise(3).alias("priority"))


def with_dates(links: DataFrame) -> DataFrame:
    """Link rows with a publication date, N/A where there is none."""
    return links.withColumn("date", F.coalesce("date", F.lit("N/A")))


def saved(pages: DataFrame) -> DataFrame:
    """Manifest rows (page_id, org, filename, hash) of the first page of each content in an org."""
    h, org = F.sha2("html", 256), U.host("url")
    x = pages.select("page_id", "url", org.alias("org"), h.alias("hash"))
    x = x.withColumn("rn", F.row_number().over(Window.partitionBy("org", "hash").orderBy("page_id"))).filter("rn = 1")
    x = x.withColumn("seq", F.row_number().over(Window.partitionBy("org").orderBy("page_id")))
    return x.select("page_id", "org", F.concat(U.slug("url", F.col("seq")), F.lit(".html")).alias("filename"), "hash")


def hashed_name(u) -> Column:
    """File name by the digest of a URL."""
    return F.concat(F.left(F.md5(u), F.lit(12)), F.lit(".html"))


def flagged_scope(urls: DataFrame, cap: int = 100) -> DataFrame:
    """Fetched rows that a trap rule would keep out now are marked, not deleted."""
    return urls.withColumn("out_of_scope", (U.trap_reason(F.col("url"), None, cap).isNotNull() & (F.col("status") == "done")).cast("int"))


def refetched(urls: DataFrame, cap: int = 100) -> DataFrame:
    """Three parts of what is to be fetched again: demoted to excluded for a pattern or trap, pending again, and left as they are."""
    reason = F.coalesce(U.exclusion_reason("url"), U.trap_reason(F.col("url"), None, cap))
    done = F.col("status") == "done"
    return urls.select("*", F.when(done & reason.isNotNull(), "demoted").when(done, "pending").otherwise("left").alias("part"), F.when(done, reason).alias("why"))


def imported(visited: DataFrame, known: DataFrame) -> DataFrame:
    """Visited URLs as pending rows to fetch again; those already known stay as they are."""
    one = visited.withColumn("url_key", U.url_key("url")).groupBy("org_id", "url_key").agg(F.min_by("url", "id").alias("url"))
    return one.join(known.select("org_id", "url_key").distinct(), ["org_id", "url_key"], "left_anti").select("org_id", "url", "url_key", F.lit("pending").alias("status"), F.lit(1).alias("refetch"))


def legacy(manifest: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An older corpus as tables: pages by identity, the first wins; hyperlinks and file links counted by target; and the frontier of internal targets that no page has."""
    pages = manifest.withColumn("url_key", U.url_key("url")).groupBy("org_id", "url_key").agg(F.min_by(F.struct("url", "filename"), "id").alias("r"), F.count("*").alias("n")).select("org_id", "url_key", "r.*", "n")
    counted = links.groupBy("org_id", "target").agg(F.count("*").alias("occurrences"), F.min("id").alias("first_seen"), F.max(U.is_document("target").cast("int")).alias("is_file"))
    todo = counted.filter("is_file = 0").withColumn("url_key", U.url_key("target")).filter(U.host("target") == F.col("org_id"))
    todo = todo.groupBy("org_id", "url_key").agg(F.min("target").alias("url")).join(pages.select("org_id", "url_key"), ["org_id", "url_key"], "left_anti")
    return pages, counted, todo


def seeded(orgs: DataFrame, known: DataFrame, key) -> DataFrame:
    """Organisations with the seed URL that a list has under their folded name. key: how names are folded."""
    k = known.groupBy(key(F.col("name")).alias("key")).agg(F.min("url").alias("seed_url"))
    return orgs.withColumn("key", key(F.col("name"))).join(k, "key", "left").drop("key")


def filled(orgs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Seed URLs set from candidates where they are empty, and nowhere else."""
    c = candidates.groupBy("org_id").agg(F.min("url").alias("candidate"))
    empty = F.coalesce(F.trim("seed_url"), F.lit("")) == ""
    return orgs.join(c, "org_id", "left").withColumn("filled", (empty & F.col("candidate").isNotNull()).cast("int")).withColumn("seed_url", F.when(empty, F.col("candidate")).otherwise(F.col("seed_url"))).drop("candidate")


def cooled(streaks: DataFrame) -> DataFrame:
    """When an org may go on after a run of failures."""
    return streaks.withColumn("resume_after", F.col("last") + F.make_interval(secs=F.col("pause_s")))


def due(orgs: DataFrame, now) -> DataFrame:
    """Paused orgs whose cooldown is over; those paused by hand have no end."""
    return orgs.filter((F.col("state") == "paused") & F.col("resume_after").isNotNull() & (F.col("resume_after") <= now))


def startable(orgs: DataFrame) -> DataFrame:
    return orgs.filter((F.col("verified") == 1) & (F.coalesce("seed_url", F.lit("")) != "") & F.col("state").isin("new", "ready", "paused", "error"))


def tail(events: DataFrame, n: int = 50) -> DataFrame:
    """The last n events by id."""
    return events.orderBy(F.desc("event_id")).limit(n)


def logged(log: DataFrame, more: DataFrame, width: int = 300) -> DataFrame:
    """A log with new entries at its end, their texts cut to a width."""
    return log.unionByName(more.withColumn("message", F.left("message", F.lit(width))))


def updated(table: DataFrame, changes: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """table with the fields of changes that may be set; null ones and others stay."""
    fields = [c for c in changes.columns if c in allowed and c != key]
    j = table.join(changes.select(key, *(F.col(c).alias(f"{c}__new") for c in fields)), key, "left")
    for c in fields:
        j = j.withColumn(c, F.coalesce(f"{c}__new", c)).drop(f"{c}__new")
    return j


def migrated(table: DataFrame, columns: dict[str, str], backfill: dict[str, Column]) -> DataFrame:
    """table with columns it lacks, null, and backfills where a column is null."""
    for name, kind in columns.items():
        if name not in table.columns:
            table = table.withColumn(name, F.lit(None).cast(kind))
    for name, value in backfill.items():
        table = table.withColumn(name, F.coalesce(F.col(name), value))
    return table


# sessions (session_id, organization, status, start_time, end_time, pages, skipped, errors) and checkpoints (session_id, at, ...)


def sessions(table: DataFrame, organization: str | None = None, status: str | None = None, limit: int = 50) -> DataFrame:
    """The latest sessions, of one organisation or status where given; ties by id."""
    if organization is not None:
        table = table.filter(F.col("organization") == organization)
    if status is not None:
        table = table.filter(F.col("status") == status)
    return table.orderBy(F.desc("start_time"), F.desc("session_id")).limit(limit)


def resumable(table: DataFrame) -> DataFrame:
    return table.filter(F.col("status").isin("in_progress", "interrupted"))


def without(table: DataFrame, checkpoints: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the sessions in gone: checkpoints go with them."""
    ids = gone.select("session_id").distinct()
    return table.join(ids, "session_id", "left_anti"), checkpoints.join(ids, "session_id", "left_anti")


def summaries(table: DataFrame) -> DataFrame:
    """(session_id, summary): one line a fact, the duration as hours and minutes."""
    s = F.unix_timestamp("end_time") - F.unix_timestamp("start_time")
    took = F.when(F.col("end_time").isNull(), "In progress").otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("string"), F.lit("m")))
    lines = (("Session: ", F.col("session_id").cast("string")), ("Status: ", F.col("status")), ("Organization: ", F.coalesce("organization", F.lit("All"))), ("Duration: ", took), ("Pages: ", F.col("pages").cast("string")), ("Errors: ", F.col("errors").cast("string")))
    return table.select("session_id", F.concat_ws("\n", *(F.concat(F.lit(k), v) for k, v in lines)).alias("summary"))


def session_stats(table: DataFrame) -> DataFrame:
    """Sessions, completed ones, pages, and the latest start of all and of completed ones, of each organisation."""
    done = F.col("status") == "completed"
    return table.groupBy("organization").agg(F.count("*").alias("sessions"), F.count_if(done).alias("completed"), F.sum("pages").alias("pages"), F.max("start_time").alias("last_scrape"), F.max(F.when(done, F.col("start_time"))).alias("last_success"))


def organizations(table: DataFrame) -> DataFrame:
    return table.select("organization").filter("organization is not null").distinct().orderBy("organization")


def last_checkpoints(checkpoints: DataFrame) -> DataFrame:
    """The last checkpoint of each session; ties by id."""
    return checkpoints.groupBy("session_id").agg(F.max_by(F.struct(*(c for c in checkpoints.columns if c != "session_id")), F.struct("at", "id")).alias("r")).select("session_id", "r.*")


def snapshot_state(visited: DataFrame, queue: DataFrame) -> DataFrame:
    """The first crawler's state of each org as one JSON text: how many are visited, and the queue in order. Queues of one org are bounded by its page limit."""
    v = visited.groupBy("org_id").agg(F.count("*").alias("visited"))
    q = queue.groupBy("org_id").agg(F.array_sort(F.collect_list(F.struct("priority", "depth", "url"))).alias("queue"))
    return v.join(q, "org_id", "full_outer").select("org_id", F.to_json(F.struct(F.coalesce("visited", F.lit(0)).alias("visited"), F.size(F.coalesce("queue", F.array().cast("array<struct<priority:int,depth:int,url:string>>"))).alias("queued"), F.get(F.col("queue"), 0)["url"].alias("next"))).alias("state"))


def resumed_links(links: DataFrame, visited: DataFrame) -> DataFrame:
    """Internal targets of earlier sessions that were never visited, each once."""
    t = links.filter("link_type = 'internal'").select(U.host("source").alias("org_id"), U.url_key("target").alias("url_key"), "target")
    return t.groupBy("org_id", "url_key").agg(F.min("target").alias("url")).join(visited.select(U.host("url").alias("org_id"), U.url_key("url").alias("url_key")).distinct(), ["org_id", "url_key"], "left_anti")
