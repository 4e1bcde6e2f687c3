"""A doc_id with several texts in line and near dedup."""

import random

from loomnet.llm import line_dedup, neardup


def test_lines_of_the_other_text_stay(spark):
    d = spark.createDataFrame([(1, "a"), (2, "a"), (2, "z"), (2, "z")], "doc_id long, text string")
    assert sorted(map(tuple, line_dedup.line_dedup(d).collect())) == [(1, "a", 0), (2, "", 1), (2, "z", 0), (2, "z", 0)]


def test_near_copies_of_the_other_text(spark):
    rng = random.Random(4)
    a, z = (" ".join(f"w{rng.randrange(400)}" for _ in range(120)) for _ in range(2))
    d = spark.createDataFrame([(1, a), (2, a), (2, z), (3, z + " end")], "doc_id long, text string")
    assert {r.doc_id: r.group_id for r in neardup.near_copies(d).collect()} == {1: 1, 2: 1, 3: 1}
