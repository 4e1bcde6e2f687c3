"""Scans: text trees, JSON lines, dictionaries, matrices, sitemaps, pages."""

from __future__ import annotations

import csv
import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomnet.functions import text as X


LOT = 500  # files that a row of a listing names
HELD = 1 << 24  # bytes of texts in a batch


def stored(path: str):
    """The file system of a path and the path in it."""
    import os

    from pyarrow import fs

    local = path.removeprefix("file:") if "://" not in path else path
    return fs.FileSystem.from_uri(local if "://" in local else os.path.abspath(local))


def text_tree(spark: SparkSession, root: str, years: list[str] | None = None, other: bool = False) -> DataFrame:
    """(doc_id, year, org, filename, text) of root/year/org/text/*.txt; folder names become columns. Only four-digit years, and ``other`` on request; named years are picked by path, before anything is read.

    The driver sees the folders of organisations only. Tasks list the files of each and read them by lots, so that
    neither its memory nor the number of tasks grows with the number of files.
    """
    import re

    from pyarrow import fs

    store, top = stored(root)
    below = lambda path: sorted(f.base_name for f in store.get_file_info(fs.FileSelector(path, allow_not_found=path != top)) if f.type == fs.FileType.Directory)
    found = [str(y) for y in years] if years else below(top)
    folders = [(y, o) for y in found if re.fullmatch("[0-9]{4}", y) or (other and y == "other") for o in below(f"{top}/{y}")]

    def listed(batches):
        store, top = stored(root)
        for b in batches:
            for year, org in zip(b["year"].to_pylist(), b["org"].to_pylist()):
                files = store.get_file_info(fs.FileSelector(f"{top}/{year}/{org}/text", allow_not_found=True))
                names = sorted(f.base_name for f in files if f.type == fs.FileType.File and f.base_name.endswith(".txt"))
                lots = [names[k : k + LOT] for k in range(0, len(names), LOT)]
                yield pa.RecordBatch.from_arrays([pa.array([year] * len(lots)), pa.array([org] * len(lots)), pa.array(lots, pa.list_(pa.string()))], names=["year", "org", "names"])

    def read(batches):
        store, top = stored(root)

        def out(year, org, names, texts):
            return pa.RecordBatch.from_arrays([pa.array([year] * len(names)), pa.array([org] * len(names)), pa.array(names, pa.string()), pa.array(texts, pa.binary())], names=["year", "org", "filename", "bytes"])

        for b in batches:
            for year, org, lot in zip(*(b[c].to_pylist() for c in ("year", "org", "names"))):
                names, texts, total = [], [], 0
                for name in lot:
                    with store.open_input_stream(f"{top}/{year}/{org}/text/{name}") as f:
                        texts.append(f.read())
                    names.append(name)
                    total += len(texts[-1])
                    if total >= HELD:
                        yield out(year, org, names, texts)
                        names, texts, total = [], [], 0
                yield out(year, org, names, texts)

    tasks = max(8, 3 * spark.sparkContext.defaultParallelism)
    lots = spark.createDataFrame(folders, "year string, org string").repartition(min(tasks, max(1, len(folders)))).mapInArrow(listed, "year string, org string, names array<string>")
    df = lots.repartition(tasks).mapInArrow(read, "year string, org string, filename string, bytes binary")
    return df.select("year", "org", "filename", F.col("bytes").cast("string").alias("text"), F.concat_ws("/", "year", "org", "filename").alias("doc_id"))


def json_lines(spark: SparkSession, paths, schema: str, mode: str = "drop") -> DataFrame:
    """JSON lines. mode: drop bad lines, keep them in _corrupt_record, or fail."""
    modes = {"drop": "DROPMALFORMED", "keep": "PERMISSIVE", "fail": "FAILFAST"}
    ddl = schema + (", _corrupt_record string" if mode == "keep" else "")
    return spark.read.schema(ddl).option("mode", modes[mode]).json(paths)


def yearly_json(spark: SparkSession, root: str, years, schema: str, coded_only: bool = False) -> DataFrame:
    """One scan over {year}_pairs.jsonl of the years that are there."""
    from pyspark.errors import AnalysisException

    found = []
    for y in years:
        try:
            spark.read.text(f"{root}/{y}_pairs.jsonl").schema  # the path is checked, nothing is read
            found.append(f"{root}/{y}_pairs.jsonl")
        except AnalysisException:
            continue
    df = json_lines(spark, found, schema) if found else spark.createDataFrame([], schema)
    return df.filter("llm_label is not null") if coded_only else df


def variants(spark: SparkSession, path: str, name: str = "name", aliases: str = "aliases") -> DataFrame:
    """(org, variant) of a CSV with aliases between semicolons; the name is a variant too."""
    d = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    v = F.concat(F.array(F.col(name)), F.transform(F.split(F.coalesce(aliases, F.lit("")), ";"), lambda a: F.trim(a)))
    return d.select(F.col(name).alias("org"), F.explode(F.array_distinct(F.filter(v, lambda x: x != ""))).alias("variant"))


ORG_DEFAULTS = {"priority": 3, "url": None, "url_type": "domain", "depth_limit": 5}


def orgs_yaml(spark: SparkSession, path: str, defaults: dict | None = None) -> DataFrame:
    """(name, aliases, priority, url, url_type, depth_limit) of a YAML list of organisations, defaults where a field isn't given. Read as one text by Spark, so that any file system will do."""
    import yaml

    d = ORG_DEFAULTS | (defaults or {})
    text = "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())  # a configuration, of driver size
    rows = [(o["name"], list(dict.fromkeys([o["name"], *(o.get("aliases") or [])])), *(o.get(k, v) for k, v in d.items())) for o in yaml.safe_load(text) or []]
    return spark.createDataFrame(rows, "name string, aliases array<string>, priority int, url string, url_type string, depth_limit int")


def sqlite(spark: SparkSession, path: str, table: str, columns: str, parts: int = 8) -> DataFrame:
    """A table of a SQLite file, opened read-only in tasks, each a range of row ids. columns: their DDL. The file must be where all tasks can open it."""
    import sqlite3

    file = path.removeprefix("file://")

    def connect():
        return sqlite3.connect(f"file:{file}?mode=ro", uri=True)

    names = [f.name for f in T.StructType.fromDDL(columns)]
    quoted = ", ".join('"' + n.replace('"', '""') + '"' for n in names)
    source = '"' + table.replace('"', '""') + '"'
    with connect() as c:
        lo, hi = c.execute(f"SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM {source}").fetchone()
    step = max(1, -(-(hi - lo + 1) // parts))

    def read(batches):
        import pandas as pd

        with connect() as c:
            for b in batches:
                for at in b["id"]:
                    cur = c.execute(f"SELECT {quoted} FROM {source} WHERE rowid BETWEEN ? AND ?", (int(at), int(at) + step - 1))
                    while rows := cur.fetchmany(10_000):
                        yield pd.DataFrame(rows, columns=names)

    return spark.range(lo, hi + 1, step, parts).mapInPandas(read, columns)


def variants_yaml(spark: SparkSession, path: str) -> DataFrame:
    """variants from a YAML list of {name, aliases}."""
    import yaml

    with open(path, encoding="utf-8") as f:
        rows = [(o["name"], a) for o in yaml.safe_load(f) or [] for a in dict.fromkeys([o["name"], *(o.get("aliases") or [])])]
    return spark.createDataFrame(rows, "org string, variant string")


def codes(spark: SparkSession, path: str) -> DataFrame:
    """(ord, node, code): the order of the file gives the axes of matrices. A list of driver size, with or without a byte order mark."""
    with open(path, encoding="utf-8-sig", newline="") as f:
        rows = [(k, r["name"], r["code"]) for k, r in enumerate(csv.DictReader(f))]
    return spark.createDataFrame(rows, "ord int, node string, code string")


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """A matrix CSV, row labels in the first column, as (src, tgt, v)."""
    d = spark.read.option("header", True).csv(path)
    first = d.columns[0]
    return d.unpivot([first], d.columns[1:], "tgt", "v").select(F.col(first).alias("src"), "tgt", F.col("v").cast("int").alias("v"))


def sub_matrix(cells: DataFrame, keep: list[str]) -> DataFrame:
    """Cells between the kept nodes, names compared without case and outer spaces; the diagonal is 0."""
    key = lambda c: F.lower(F.trim(c))
    k = [x.strip().lower() for x in keep]
    return cells.filter(key("src").isin(*k) & key("tgt").isin(*k)).select(key("src").alias("src"), key("tgt").alias("tgt"), F.when(key("src") == key("tgt"), 0).otherwise(F.col("v").try_cast("int")).alias("v"))


def xlsx_matrix(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook as (src, tgt, v). Read with the standard library: a workbook is a zip of XML."""
    import re
    import zipfile
    from xml.etree import ElementTree as ET

    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(path) as z:
        shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)] if "xl/sharedStrings.xml" in z.namelist() else []
        rows = []
        for r in ET.fromstring(z.read("xl/worksheets/sheet1.xml")).iter(f"{{{ns['m']}}}row"):
            cells = {}
            for c in r.findall("m:c", ns):
                col = 0
                for ch in re.match("[A-Z]+", c.get("r")).group():
                    col = col * 26 + ord(ch) - 64
                v, inline = c.find("m:v", ns), c.find("m:is", ns)
                cells[col] = shared[int(v.text)] if c.get("t") == "s" else v.text if v is not None else "".join(t.text or "" for t in inline.iter(f"{{{ns['m']}}}t")) if inline is not None else None
            rows.append(cells)
    head = rows[0]
    long = [(r[1], head[k], r.get(k)) for r in rows[1:] if 1 in r for k in sorted(head) if k > 1]
    return spark.createDataFrame(long, "src string, tgt string, v string")


def pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, html, size) of page files, decoded by the charset that they name."""
    return spark.read.format("binaryFile").load(path).select("path", X.decoded("content").alias("html"), F.col("length").alias("size"))


def links_json(spark: SparkSession, root: str) -> DataFrame:
    """(org, year, url) of links.json files anywhere below root."""
    d = spark.read.schema("external_links array<struct<url:string,text:string>>").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*links.json").json(root)
    p = F.col("_metadata.file_path")
    return d.select(F.regexp_extract(p, r"/([^/]+)/[^/]+/[^/]+$", 1).alias("year"), F.regexp_extract(p, r"/([^/]+)/[^/]+$", 1).alias("org"), F.explode("external_links").alias("l")).select("year", "org", "l.url", "l.text")


def sitemap(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """(loc, lastmod) of url entries; entries without a date stay."""
    d = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    return d if since is None else d.filter(F.col("lastmod").isNull() | (F.coalesce(F.try_to_date(F.substring_index("lastmod", "T", 1)) >= F.lit(since).cast("date"), F.lit(True))))


def sitemap_tree(spark: SparkSession, path: str, where=lambda loc: loc, since: str | None = None, depth: int = 3, most: int = 1000) -> DataFrame:
    """url entries of a sitemap and of all that its index names, level by level, compressed ones too. where: the path of a location. Indexes are read to the driver: at most ``most`` sitemaps of at most depth levels, as crawlers bound them; beyond that it raises."""
    seen, level = {path}, [path]
    for _ in range(depth):
        level = sorted({where(r["loc"].strip()) for r in sitemap_index(spark, level).filter("loc is not null").limit(most + 1).collect()} - seen)
        if not level:
            break
        seen |= set(level)
        if len(seen) > most:
            raise ValueError(f"more than {most} sitemaps")
    else:
        raise ValueError(f"sitemaps nest deeper than {depth}")
    return sitemap(spark, sorted(seen), since)


def sitemap_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "sitemap").schema("loc string").load(path)


def robots_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(F.startswith(F.lower(F.trim("value")), F.lit("sitemap:"))).select(F.trim(F.regexp_replace("value", r"(?i)^\s*sitemap:", "")).alias("url"))


def config_csv(path: str) -> tuple[dict, list[dict]]:
    """A CSV whose first line is #CONFIG and JSON: the configuration and the rows."""
    import json

    with open(path, encoding="utf-8-sig", newline="") as f:
        head, _, rest = f.read().partition("\n")
    return json.loads(next(csv.reader(io.StringIO(head)))[0].removeprefix("#CONFIG")), list(csv.DictReader(io.StringIO(rest)))
