"""Pairs and contexts at the reach of the reference, against brute force."""

import re

from loomnet.plans import registry


def starts(t, terms):
    return [(o, w, m.start()) for o, w in enumerate(terms) for m in re.finditer(re.escape(w), t.lower())]


def test_contexts_reach_as_far_as_the_reference(spark, tmp_path):
    texts = {1: "a" * 1500 + "idiot" + "b" * 795 + "tion" + "c" * 1500, 2: "idiot" + "b" * 1196 + "tion", 3: "clown b tion", 4: "scum" + "b" * 1195 + "idiot" + "b" * 1195 + "nden"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, t in texts.items():
        pairs = sorted((abs(a - b), o, k, a, b, x, y) for o, x, a in starts(t, ["idiot", "clown", "scum"]) for k, y, b in starts(t, ["tion", "pathetic", "nden"]) if abs(a - b) <= 1200)
        if pairs:
            d, _, _, a, b, x, y = pairs[0]
            at, level = (a + b) // 2, "same sentence/paragraph" if d < 150 else "nearby paragraph" if d < 500 else "distant"
            lo, hi = max(0, at - 1000), min(len(t), at + 1000)
            want[i] = (x, y, d, f"[{x} ~ {y}, {d} chars, {level}]\n" + "…" * (lo > 0) + t[lo:hi] + "…" * (hi < len(t)))
    got = {r.doc_id: (r.org, r.kw, r.distance, r.context) for r in registry.QUERIES["pair_contexts"](spark, str(tmp_path)).collect()}
    assert set(want) == {1, 3, 4} and got == want
    assert {r.doc_id: r.level for r in registry.QUERIES["best_window"](spark, str(tmp_path)).collect()} == {1: "distant", 3: "same sentence/paragraph", 4: "distant"}
