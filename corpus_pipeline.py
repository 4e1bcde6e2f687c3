"""The corpus pipeline: quality, lines, near copies, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read back as the next one's docs. All but the last return the columns of documents; a stage that
changes text sets n_chars where that column is there.

Defined results. Documents that the classifier rejects go. Repeated lines go, and with them the
documents of which only white space is left, unless nothing else was there before. One document of each
group of near copies stays, that with the least doc_id. Spans of benchmark items go, and
documents of which nothing else was left. The last stage returns packed sequences of token ids
with the documents that they come from. Null texts pass the filters as they are and stand in no
sequence; rows without a doc_id pass all stages but the last. An empty table gives no sequences.
Extra columns pass through all stages but the last, whatever they are called.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomnet.llm import decontaminate, line_dedup, neardup, packing, quality
from loomnet.llm.common import drop_written, fresh, mark, shared_dir, table

BLANK = r"^[ \t\n\x0B\f\r]*$"


def _changed(docs: DataFrame, count: str) -> DataFrame:
    """docs without the column count, less the documents that lost something and are blank now; n_chars follows the text."""
    kept = docs.filter((F.col(count) == 0) | F.col("text").isNull() | ~F.col("text").rlike(BLANK))
    if "n_chars" in kept.columns:
        kind = dict(kept.dtypes)["n_chars"]
        kept = kept.withColumn("n_chars", F.when(F.col(count) == 0, F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return kept.drop(count)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    (count,) = fresh(docs, "removed")
    return _changed(line_dedup.line_dedup(docs, count=count), count)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs)


def clean_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    (count,) = fresh(docs, "spans")
    return _changed(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), count=count), count)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality classifier", classify), ("line dedup", dedup_lines), ("MinHash near-dedup", dedup_near), ("benchmark decontamination", clean_leaks), ("best-fit packing", pack)]

#: SQL can't express the classifier nor the packing; tests hold each stage against brute force on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, base = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/loomnet/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        start = mark()
        df = stage(spark, docs, sf_dir)
        df.write.parquet(f"{base}/{k}")
        drop_written(spark, start)  # what the stage has put aside
        docs = spark.read.schema(df.schema).parquet(f"{base}/{k}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
