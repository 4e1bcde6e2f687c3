"""Prompts and judge cases from pairs and ratings, and what runs over them would cost."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomnet.functions import text as X


def sections(markdown: str) -> dict[str, str]:
    """Blocks of a prompt file by their ``## NAME`` headings; what stands before the first is left out."""
    out: dict[str, str] = {}
    name = None
    for line in markdown.splitlines():
        m = re.match(r"##\s+([A-Z0-9_ ]+?)\s*$", line)
        if m:
            name = m.group(1).strip().replace(" ", "_")
            out[name] = ""
        elif name is not None:
            out[name] += line + "\n"
    return {k: v.strip() for k, v in out.items()}


ORDER = ("SYSTEM_INTRO", "CODEBOOK", "PRESENCE_CHECK", "EXAMPLES", "JSON_FORMAT")


def system_prompt(parts: dict[str, str], codebook: str | None = None) -> str:
    """Sections in their order with an empty line between; optional ones that are empty are left out."""
    have = parts | ({"CODEBOOK": codebook} if codebook is not None else {})
    return "\n\n".join(have.get(k, "").strip() for k in ORDER if have.get(k, "").strip() or k in ("SYSTEM_INTRO", "CODEBOOK", "JSON_FORMAT"))


def _lines(*rows) -> Column:
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in rows))


def row_prompts(pairs: DataFrame, check: str) -> DataFrame:
    """(id, prompt) of each pair (id, source, target, year, article, keywords, text). check: a question with {target} in it."""
    c = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(""))
    excerpt = X.without_header(F.trim(c("text")))
    ask = F.replace(F.lit(check), F.lit("{target}"), c("target"))
    return pairs.select("id", _lines("Publisher: ", c("source"), "\nMentioned: ", c("target"), "\nYear: ", c("year"), "\nArticle: ", c("article"), "\nKeywords: ", c("keywords"), "\n\n<excerpt>\n", excerpt, "\n</excerpt>\n\n", ask, "\n\nAnswer with one JSON object and nothing else.").alias("prompt"))


def texts_by_id(datapoints: DataFrame) -> DataFrame:
    """(id, text): the last row of each id, by line number."""
    return datapoints.groupBy("id").agg(F.max_by("text", "line").alias("text"))


def with_texts(cases: DataFrame, datapoints: DataFrame) -> DataFrame:
    """Cases with the text of their datapoint, empty where there is none."""
    return cases.join(texts_by_id(datapoints), "id", "left").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("missing", (F.col("text") == "").cast("int"))


def judge_messages(cases: DataFrame, ratings: DataFrame) -> DataFrame:
    """(id, message) of each case (id, source, target, text): the raters' labels and reasons without their names, numbered by name."""
    r = ratings.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("model", "label", "reasoning"))).alias("r"))
    one = lambda x, i: F.concat(F.lit("Rater "), (i + 1).cast("string"), F.lit(" label: "), F.upper(F.coalesce(x["label"], F.lit("?"))), F.lit("\nRater "), (i + 1).cast("string"), F.lit(" reason: "), F.trim(F.replace(F.coalesce(x["reasoning"], F.lit("")), F.lit("\n"), F.lit(" "))), F.lit("\n\n"))
    return cases.join(r, "id").select("id", _lines("Publisher: ", F.col("source"), "\nMentioned: ", F.col("target"), "\n\n<excerpt>\n", X.prompt_safe(F.coalesce("text", F.lit(""))), "\n</excerpt>\n\n<ratings>\n", F.array_join(F.transform("r", one), ""), "</ratings>\n\nWeigh the ratings and give the final label and your reason as JSON.").alias("message"))


def ties(voted: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """Items without a majority that no judge has labelled yet."""
    t = voted.filter("majority_label is null")
    return t if judged is None else t.join(judged.filter("judge_label is not null").select("id"), "id", "left_anti")


def calibration(voted: DataFrame, n: int = 9, seed: int = 42) -> DataFrame:
    """Known cases for the judge: n unanimous and n nearly so, by hash of the id."""
    from loomnet.operators.sampling import per_stratum

    known = voted.filter(F.col("agreement").isin("4/0", "3/1")).withColumn("consensus", F.col("majority_label"))
    return per_stratum(known, "agreement", "id", n, seed)


def build_stats(pairs: DataFrame) -> DataFrame:
    """Articles and pairs of each year and of all, with calls, cost and hours of a run at 550 tokens in and 150 out, 1.5 s a call."""
    n = pairs.rollup("year").agg(F.count_distinct("article").alias("articles"), F.count("*").alias("pairs"))
    return n.select(F.coalesce(F.col("year").cast("string"), F.lit("ALL")).alias("year"), "articles", "pairs", F.round(F.col("pairs") * (550 * 0.15 + 150 * 0.60) / 1e6, 6).alias("cost"), F.round(F.col("pairs") * 1.5 / 3600, 4).alias("hours"))


def dry_run(rows: DataFrame, models: DataFrame, tokens_in: int = 1050, tokens_out: int = 150) -> DataFrame:
    """What each model, and all, would cost over the rows. models: (model, price_in, price_out) a million tokens."""
    n = rows.agg(F.count("*").alias("n"))
    each = models.crossJoin(n).select("model", (F.col("n") * (F.col("price_in") * tokens_in + F.col("price_out") * tokens_out) / 1e6).alias("cost"))
    return each.rollup("model").agg(F.round(F.sum("cost"), 6).alias("cost")).fillna("TOTAL", ["model"])


def export(pairs: DataFrame, years: list[int] | None = None, coded_only: bool = False, fields: list[str] | None = None) -> DataFrame:
    """The rows that an export takes: of some years, coded ones only, some fields."""
    out = pairs if years is None else pairs.filter(F.col("year").isin(*years))
    out = out.filter("label is not null") if coded_only else out
    return out if fields is None else out.select(*(F.col(f) if f in out.columns else F.lit(None).cast("string").alias(f) for f in fields))
