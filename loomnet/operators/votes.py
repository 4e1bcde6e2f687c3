"""Several raters' labels: majority, agreement, judge, kappa, cost. Ratings are (id, model, status, label, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coded(ratings: DataFrame) -> DataFrame:
    return ratings.filter((F.col("status") == "coded") & F.col("label").isNotNull())


def todo(items: DataFrame, ratings: DataFrame) -> DataFrame:
    """Items that a rater hasn't coded; failed ones are tried again."""
    return items.join(coded(ratings).select("id"), "id", "left_anti")


def label_maps(ratings: DataFrame) -> DataFrame:
    """(id, labels): the label of each rater, sorted by rater."""
    return coded(ratings).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "label")))).alias("labels"))


def majority(ratings: DataFrame) -> DataFrame:
    """(id, n_raters, agreement, majority_label): the label of more than half of the raters that coded, else null; agreement is k/(n-k)."""
    per = coded(ratings).groupBy("id", "label").agg(F.count("*").alias("k"))
    top = per.groupBy("id").agg(F.sum("k").alias("n"), F.max("k").alias("most"), F.max_by("label", "k").alias("top"))
    return top.select("id", F.col("n").alias("n_raters"), F.concat(F.col("most").cast("string"), F.lit("/"), (F.col("n") - F.col("most")).cast("string")).alias("agreement"), F.when(F.col("most") * 2 > F.col("n"), F.col("top")).alias("majority_label"))


def distribution(voted: DataFrame) -> DataFrame:
    return voted.groupBy("agreement").agg(F.count("*").alias("n"))


def judged(voted: DataFrame, judge: DataFrame) -> DataFrame:
    """final_label: the judge's where there is one, else the majority's."""
    j = judge.filter("judge_label is not null").select("id", "judge_label")
    return voted.join(j, "id", "left").withColumn("final_label", F.coalesce("judge_label", "majority_label"))


def kappa(ratings: DataFrame) -> DataFrame:
    """Fleiss' kappa over the items that most raters coded: observed and expected agreement and kappa, in one row."""
    per = coded(ratings).groupBy("id", "label").agg(F.count("*").alias("k"))
    item = per.groupBy("id").agg(F.sum("k").alias("n"), F.sum(F.col("k") * (F.col("k") - 1)).alias("same"))
    full = item.agg(F.max("n").alias("full"))
    item = item.crossJoin(F.broadcast(full)).filter("n = full")
    observed = item.agg(F.count("*").alias("n_items"), F.avg(F.try_divide(F.col("same"), F.col("n") * (F.col("n") - 1))).alias("observed"))
    share = per.join(item.select("id"), "id", "left_semi").groupBy("label").agg(F.sum("k").alias("k"))
    expected = share.agg(F.sum(F.col("k") * F.col("k")).alias("sq"), F.sum("k").alias("s")).select((F.col("sq") / (F.col("s") * F.col("s"))).alias("expected"))
    return observed.crossJoin(expected).select("n_items", F.round("observed", 6).alias("observed"), F.round("expected", 6).alias("expected"), F.round(F.try_divide(F.col("observed") - F.col("expected"), 1 - F.col("expected")), 6).alias("kappa"))


def costs(ratings: DataFrame) -> DataFrame:
    """Calls, failures, tokens and cost of each rater, and of all."""
    return ratings.rollup("model").agg(F.count_if(F.col("status") == "coded").alias("coded"), F.count_if(F.col("status") == "ERROR").alias("errors"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.round(F.sum("cost_usd"), 4).alias("cost_usd")).fillna("all", ["model"])


def max_agreement(ratings: DataFrame) -> DataFrame:
    """How many items have how many identical labels at most."""
    per = coded(ratings).groupBy("id", "label").agg(F.count("*").alias("k")).groupBy("id").agg(F.max("k").alias("identical"))
    return per.groupBy("identical").agg(F.count("*").alias("n"))


def judge_summary(judge: DataFrame) -> DataFrame:
    return judge.groupBy("judge_label", "confidence").agg(F.count("*").alias("n"), F.round(F.avg((F.col("judge_label") == F.col("consensus")).cast("int")), 6).alias("accuracy"))


def unique_check(items: DataFrame) -> DataFrame:
    """Repeated ids, empty texts and mean length."""
    return items.agg((F.count("*") - F.count_distinct("id")).alias("duplicate_ids"), F.count_if(F.trim("text") == "").alias("empty"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))
