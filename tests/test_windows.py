"""Windows are found in the rows of documents, against brute force."""

import re

from pyspark.sql import functions as F

from loomnet.operators import pairs as P
from loomnet.plans import registry


def test_closest_pairs_against_every_pair(spark):
    import random

    rng = random.Random(11)
    names, words = {"x": ["aba", "cd"], "y": ["efe"]}, ["gh", "aba"]
    texts = {k: "".join(rng.choice(["aba", "ba", "cd", "EFE", "gh", "é", " ", "z" * 7]) for _ in range(rng.choice([0, 3, 40, 300]))) for k in range(60)} | {60: None, 61: ""}
    asked = F.array(*(F.struct(F.lit(t).alias("target"), F.array(*map(F.lit, words)).alias("keywords")) for t in sorted(names)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("asked", asked)
    own, flat, words = {k: v for k, v in names.items()}, ["aba", "cd", "efe"], ["aba", "gh"]
    got = {r.doc_id: r.h for r in docs.select("doc_id", P.closest(own, flat, words, 9)(P.found_places("text", flat), P.found_places("text", words), "asked").alias("h")).collect()}
    at = lambda t, w: [m.start() for m in re.finditer(f"(?={w})", (t or "").lower())]
    for k, t in texts.items():
        for target, hits in zip(sorted(names), got[k]):
            want = []
            for a, n in enumerate(names[target]):
                for b, w in enumerate(["gh", "aba"]):
                    near = sorted((abs(i - j), i, j) for i in at(t, n) for j in at(t, w) if abs(i - j) <= 9)
                    want += [(near[0][0], a + 1, b + 1, near[0][1], near[0][2], n, w)] if near else []
            assert [tuple(h) for h in hits] == sorted(want)


def test_no_row_of_target_windows_leaves_its_task(spark, sf):
    plan = registry.QUERIES["target_windows"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
