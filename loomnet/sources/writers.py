"""Sinks: text trees, JSON lines with totals, edge and matrix CSV, Parquet, keyed tables."""

from __future__ import annotations

import csv
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomnet.sources.readers import stored


def documents(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").partitionBy("year", "org").parquet(path)


def text_tree(docs: DataFrame, path: str) -> int:
    """One file a document, path/year/org/text/filename; gives how many were written. Files are written in tasks under their final names, so that a task that runs again writes the same."""

    def run(batches):
        import pandas as pd

        store, root = stored(path)
        made = set()
        for b in batches:
            for year, org, name, text in zip(b["year"], b["org"], b["filename"], b["text"]):
                folder = f"{root}/{year}/{org}/text"
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{folder}/{name}") as f:
                    f.write((text or "").encode())
            yield pd.DataFrame({"n": [len(b)]})

    store, root = stored(path)
    store.create_dir(root, recursive=True)  # an empty tree can be read, too
    return docs.select("year", "org", "filename", "text").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def matrix_csv(wide: DataFrame, path: str, label: str = "src") -> None:
    """An adjacency matrix as one CSV file, row labels first under an empty heading; matrices are small."""
    wide.orderBy(label).withColumnRenamed(label, " ").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def upsert(table: str, new: DataFrame, key: list[str], order: str | None = None) -> str:
    """Writes a table at its path with the rows of new in place of those with their keys: the next version beside the last, whose path it gives. Readers of the last one aren't disturbed."""
    spark = new.sparkSession
    old = spark.read.parquet(table)
    version = f"{table.rstrip('/')}.next"
    upserted(old, new.select(*old.columns), key, order).write.mode("overwrite").parquet(version)
    return version


def json_with_totals(kept: DataFrame, path: str, by: str = "org") -> None:
    """Rows as JSON lines, and totals of each group beside them."""
    kept.write.mode("overwrite").json(f"{path}/rows")
    kept.groupBy(by).agg(F.count("*").alias("kept")).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def edges_csv(edges: DataFrame, path: str, order=("src", "tgt")) -> None:
    """One CSV file with a header, in order: for edge lists, which are small."""
    edges.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def flat_csv(rows: DataFrame, fields: list[str], path: str) -> None:
    """One CSV file of some fields, missing ones empty, with a byte order mark for spreadsheets."""
    out = rows.select(*(F.col(f) if f in rows.columns else F.lit(None).cast("string").alias(f) for f in fields))
    out.select(F.col(fields[0]).alias("\ufeff" + fields[0]), *fields[1:]).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def parquet(rows: DataFrame, path: str, drop=("extracted_text",)) -> None:
    rows.drop(*drop).write.mode("overwrite").parquet(path)


def config_csv(rows: list[dict], config: dict, path: str) -> None:
    """A small CSV with its configuration in the first line."""
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f)
        w.writerow(["#CONFIG" + json.dumps(config, ensure_ascii=False)])
        w.writerow(list(rows[0]) if rows else [])
        w.writerows(list(r.values()) for r in rows)


def upserted(table: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """table with the rows of new in place of those with their keys; of several new rows of a key the last by order stays."""
    if order:
        new = new.groupBy(*key).agg(F.max_by(F.struct(*new.columns), order).alias("r")).select("r.*")
    return table.join(new.select(*key), key, "left_anti").unionByName(new)


def quarantined(table: DataFrame, errors: DataFrame) -> DataFrame:
    """(doc_id, error, attempts): attempts add up, the latest error stays."""
    e = errors.groupBy("doc_id").agg(F.max("error").alias("e"), F.count("*").alias("k"))
    return table.join(e, "doc_id", "full_outer").select("doc_id", F.coalesce("e", "error").alias("error"), (F.coalesce("attempts", F.lit(0)) + F.coalesce("k", F.lit(0))).alias("attempts"))


def tree_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, state) of two trees: same, differs, missing, extra."""
    j = a.select("doc_id", F.col("text").alias("x"), F.lit(1).alias("in_a")).join(b.select("doc_id", F.col("text").alias("y"), F.lit(1).alias("in_b")), "doc_id", "full_outer")
    return j.select("doc_id", F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra").when(F.col("x").eqNullSafe(F.col("y")), "same").otherwise("differs").alias("state"))


def snapshot(spark: SparkSession, table: str, to: str, keep: int, stamp: str) -> list[str]:
    """A copy of a table under its stamp; gives the stamps that fall out of the newest ``keep``."""
    spark.read.parquet(table).write.mode("overwrite").parquet(f"{to}/stamp={stamp}")
    have = sorted(str(r["stamp"]) for r in spark.read.option("basePath", to).parquet(to).select(F.col("stamp").cast("string")).distinct().collect())
    return have[:-keep]
