"""Links and templates of pages (page_id, url, html)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomnet.functions import text as X
from loomnet.functions import urls as U


def links(pages: DataFrame) -> DataFrame:
    """(page_id, source, target, link_type, pos, anchor): anchors as absolute URLs, in order, with the text up to their first inner tag. The tag is matched first and its href then, so that attributes may stand in any order and quotes."""
    p = F.lit(r"(?i)<a\b([^<>]*[ \t\n\r\f/]href[ \t\n\r\f]*=[ \t\n\r\f]*[^<>]*)>([^<]*)")
    both = F.arrays_zip(F.regexp_extract_all("html", p, F.lit(1)).alias("tag"), F.regexp_extract_all("html", p, F.lit(2)).alias("body"))
    a = pages.select("page_id", "url", F.posexplode(both).alias("pos", "a"))
    a = a.select("page_id", "url", "pos", X.attribute(F.col("a.tag"), "href").alias("href"), F.left(F.trim(F.regexp_replace("a.body", r"[ \t\n\r\f]+", " ")), F.lit(500)).alias("anchor")).filter("href <> ''")
    t = a.withColumn("target", U.resolved_simple("href", F.col("url")))
    return t.select("page_id", F.col("url").alias("source"), "target", F.when(U.host("target") == U.host("url"), "internal").otherwise("external").alias("link_type"), "pos", "anchor")


def distinct_links(found: DataFrame) -> DataFrame:
    """One link a page and URL identity, the first."""
    one = found.withColumn("key", U.url_key("target"))
    return one.groupBy("page_id", "key").agg(F.min_by("target", "pos").alias("target"), F.min("pos").cast("int").alias("pos"), F.count("*").alias("n"))


def collapsed(found: DataFrame) -> DataFrame:
    """Links of a host by target: how often, from where first, of which type."""
    return found.withColumn("org", U.host("source")).groupBy("org", "target").agg(F.min("source").alias("first_source"), F.min("anchor").alias("anchor"), F.max("link_type").alias("link_type"), F.count("*").alias("occurrences"), F.min("page_id").alias("first_seen"), F.max("page_id").alias("last_seen"))


def file_links(found: DataFrame) -> DataFrame:
    return found.filter(U.is_document("target")).dropDuplicates(["page_id", "target"])


def shared(found: DataFrame, least: int = 2, samples: int = 5) -> DataFrame:
    """Pairs of hosts that link to the same resources: how many, and the first few. Each resource's hosts pair up once, by a self join on the resource."""
    r = found.select(F.lower(U.path("target")).alias("resource"), U.host("source").alias("org")).distinct()
    many = r.groupBy("resource").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("resource")
    r = r.join(many, "resource", "left_semi")
    p = r.alias("a").join(r.alias("b"), "resource").filter("a.org < b.org").select(F.col("a.org").alias("org_a"), F.col("b.org").alias("org_b"), "resource")
    # the first few of each pair are picked before anything is gathered
    first = p.withColumn("rn", F.row_number().over(Window.partitionBy("org_a", "org_b").orderBy("resource"))).filter(F.col("rn") <= samples)
    first = first.groupBy("org_a", "org_b").agg(F.array_join(F.array_sort(F.collect_list("resource")), ",").alias("samples"))
    return p.groupBy("org_a", "org_b").agg(F.count("*").alias("weight")).join(first, ["org_a", "org_b"])


def direct(found: DataFrame, owners: DataFrame) -> DataFrame:
    """(src, tgt, n): links from hosts to the hosts of other owners. owners: (host, org)."""
    o = owners  # grows with the pages: Spark broadcasts it only where it is small
    a = found.withColumn("host", U.host("source")).join(o, "host").withColumnRenamed("org", "src").drop("host")
    b = a.withColumn("host", U.host("target")).join(o, "host").withColumnRenamed("org", "tgt")
    return b.filter("src <> tgt").groupBy("src", "tgt").agg(F.count("*").alias("n"))


def signatures(pages: DataFrame, share: float = 0.8) -> DataFrame:
    """(sig, df): element signatures that at least share of all pages have."""
    n = pages.agg(F.floor(F.count("*") * share).alias("need"))
    s = pages.select(F.explode(X.element_signatures("html")).alias("sig")).groupBy("sig").agg(F.count("*").alias("df"))
    return s.crossJoin(n).filter(F.col("df") >= F.greatest(F.col("need"), F.lit(1))).select("sig", "df")


def section_signatures(pages: DataFrame, depth: int = 1, least: int = 10, share: float = 0.8) -> DataFrame:
    """signatures within each section, the first path segments, of at least ``least`` pages."""
    p = pages.withColumn("section", U.path_prefix("url", depth))
    size = p.groupBy("section").agg(F.count("*").alias("n_pages")).filter(F.col("n_pages") >= least)
    s = p.select("section", F.explode(X.element_signatures("html")).alias("sig")).groupBy("section", "sig").agg(F.count("*").alias("df"))
    return s.join(size, "section").filter(F.col("df") >= F.floor(F.col("n_pages") * share))


def metadata(pages: DataFrame) -> DataFrame:
    """Title, language, charset, first heading, description and OpenGraph title and type of each page."""
    charset = F.filter(F.transform(X.tags_of("html", "meta"), lambda t: X.attribute(t, "charset")), lambda x: x != "")
    return pages.select(
        "page_id", X.title("html").alias("title"), X.attribute(F.get(X.tags_of("html", "html"), 0), "lang").alias("lang"), F.coalesce(F.get(charset, 0), F.lit("")).alias("charset"), F.regexp_extract("html", r"(?is)<h1\b[^>]*>(.*?)</h1>", 1).alias("h1"),
        X.meta_content("html", "description").alias("description"), X.meta_content("html", "og:title").alias("og_title"), X.meta_content("html", "og:type").alias("og_type"),
    )
