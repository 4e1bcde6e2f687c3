"""Incremental ingestion: the frontier as a stream of found URLs, failure streaks as keyed state.

Batches go through foreachBatch into tables written by batch number, so that a batch that is
run again after a failure overwrites itself and nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomnet.operators import ledger


def known(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The frontier table, or its part from earlier batches; None where there is none yet."""
    from pyspark.errors import AnalysisException

    try:
        d = spark.read.option("basePath", path).parquet(path)
        return d if before is None else d.filter(F.col("batch") < before)
    except AnalysisException:
        return None


def add_new(spark: SparkSession, path: str):
    """foreachBatch function: appends URLs whose (org_id, url_key) is new, the first of each. Earlier batches are read by partition; a repeated batch replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        old = known(batch.sparkSession, path, number)
        one = batch.groupBy("org_id", "url_key").agg(F.min_by("url", "id").alias("url"), F.min("id").alias("id"))
        new = one if old is None else ledger.new_urls(batch, old)
        new.select("org_id", "url_key", "url", "id").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def run_frontier(found: DataFrame, path: str, checkpoint: str):
    """Starts the stream of found URLs into the frontier; ends when what is there is read."""
    return found.writeStream.foreachBatch(add_new(found.sparkSession, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def link_counts(found: DataFrame) -> DataFrame:
    """Running occurrences of each link, for update mode."""
    return found.groupBy("org_id", "target").agg(F.count("*").alias("occurrences"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"))


STREAK = "org_id long, at timestamp, streak int, pause_s int"


def streaks(results: DataFrame, least: int = 12) -> DataFrame:
    """A row whenever an org reaches ``least`` failures in a row, with the pause that follows. results: (org_id, fetched_at, ok). The state of an org is its current run; it ends with a success, and after an hour without results."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = state.get[0] if state.exists else 0
        out = []
        for pdf in batches:
            for r in pdf.sort_values("fetched_at").itertuples():
                n = 0 if r.ok else n + 1
                if n and n % least == 0:
                    out.append((key[0], r.fetched_at, n, min(30 * n, 180)))
        state.update((n,))
        state.setTimeoutDuration(3_600_000)
        if out:
            yield pd.DataFrame(out, columns=["org_id", "at", "streak", "pause_s"])

    return results.groupBy("org_id").applyInPandasWithState(run, STREAK, "n int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def rated(items: DataFrame, caller, model: str, attempts: int = 3) -> DataFrame:
    """Ratings by any caller(text) -> (label, prompt_tokens, completion_tokens): tried up to ``attempts`` times, failures kept as ERROR rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["id"], pdf["text"]):
                for k in range(attempts):
                    try:
                        label, p, c = caller(text)
                        rows.append((i, model, "coded", label, p, c))
                        break
                    except Exception:  # noqa: BLE001 - whatever a rater raises, the item is tried again and then reported
                        if k == attempts - 1:
                            rows.append((i, model, "ERROR", None, 0, 0))
            yield pd.DataFrame(rows, columns=["id", "model", "status", "label", "prompt_tokens", "completion_tokens"])

    return items.select("id", "text").mapInPandas(run, "id long, model string, status string, label string, prompt_tokens long, completion_tokens long")


def ruled(docs: DataFrame, rules: dict) -> DataFrame:
    """Texts after the rules of their source, in order. rules: source -> list of str -> str functions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf["text"].copy()
            for k, (src, t) in enumerate(zip(pdf["source"], pdf["text"])):
                for f in rules.get(src, ()):
                    t = f(t)
                out.iloc[k] = t
            yield pdf.assign(text=out)

    return docs.select("doc_id", "source", "text").mapInPandas(run, "doc_id long, source string, text string")
