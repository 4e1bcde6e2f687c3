"""The pipeline on small tables: every stage against brute force over what its predecessor kept, and on awkward tables."""

import re

import __spark_entry__
import corpus_pipeline as P
from loomnet.llm import packing, quality, rans
from test_llm import ODD, awkward, brute_lines, brute_spans, check_packing, empty, norm, shingles

BLANK = re.compile(P.BLANK)


def kept_lines(rows):
    want = brute_lines([(r.doc_id, r.text) for r in rows])
    return sorted((r.doc_id, want[(r.doc_id, r.text)]) for r in rows if want[(r.doc_id, r.text)] == r.text or not BLANK.match(want[(r.doc_id, r.text)]))


def firsts_of_groups(rows):
    sets, group = {r.doc_id: shingles(r.text) for r in rows}, {}

    def root(i):
        while group.get(i, i) != i:
            i = group[i]
        return i

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return sorted((r.doc_id, r.text) for r in rows if root(r.doc_id) == r.doc_id)


def without_leaks(rows, bench):
    items = [(r.item_id, norm(r.text)) for r in bench]
    out = []
    for r in rows:
        at = [m.span() for m in re.finditer(r"[0-9a-z_À-῿Ⰰ-⿿぀-\U0010ffff]+", r.text.lower())]
        text, last = "", 0
        spans = sorted(brute_spans(r.text, items))
        for i, j in spans:
            text += r.text[last : max(last, at[i][0])]
            last = max(last, at[j - 1][1])
        text += r.text[last:]
        if not spans or not BLANK.match(text):
            out.append((r.doc_id, text))
    return sorted(out)


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs, labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    bad = {r.doc_id for r in quality.scores(docs, labels).collect() if r.low_quality >= 0.5 or r.toxicity >= 0.5}
    columns, before = docs.columns, docs.collect()
    wants = [
        lambda rows: sorted((r.doc_id, r.text) for r in rows if r.doc_id not in bad),
        kept_lines,
        firsts_of_groups,
        lambda rows: without_leaks(rows, bench.collect()),
    ]
    for k, (name, stage) in enumerate(P.STAGES):
        df = stage(spark, docs, sf)
        df.write.parquet(f"{tmp_path}/{k}")
        df = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(wants):
            rows = df.collect()
            assert df.columns == columns and 0 < len(rows) <= len(before), name
            assert sorted((r.doc_id, r.text) for r in rows) == wants[k](before), name
            assert all(r.n_chars == len(r.text) for r in rows)
            before = rows
        else:
            check_packing(df.collect(), docs, 2048)
        docs = df


def tables(spark, path, docs, bench, labels):
    for name, df in (("documents", docs), ("benchmark", bench), ("labels", labels)):
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_awkward_tables(spark, sf, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and clashing extra columns, through all stages."""
    base = awkward(spark).filter("doc_id = 2").first().text
    bench = spark.createDataFrame([(1, " ".join(base.split()[20:50])), (None, "x"), (2, None), (3, "")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    d = tables(spark, tmp_path / "odd", awkward(spark), bench, labels)
    rows = P.run(spark, d).collect()
    ids = {i for r in rows for i in r.doc_ids}
    # 2 and 12 are copies of 1; 3 and 4 have no text; the second "a" line of 8 goes
    assert ids == {1, 5, 6, 7, 8, 9, 10, 11}
    coder = rans.Coder(rans.vocabulary_path())
    texts = {}
    for r in sorted(rows, key=lambda r: r.bin_id):
        at = 0
        for i, s, k in zip(r.doc_ids, r.starts, r.lengths):
            texts.setdefault(i, {})[s] = r.tokens[at : at + k]
            at += k
    whole = {i: coder.decode([t for s in sorted(x) for t in x[s]]) for i, x in texts.items()}
    assert whole[1].split() == base.split()[:20] + base.split()[50:] and whole[8] == "a\n\nb\n" and len(whole[11]) == 50_000
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == spark.createDataFrame([], ODD).columns
    assert docs.filter("doc_id = 3 and text is null").count() == 1 and docs.filter("doc_id is null and text is null").count() == 1


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert P.run(spark, tables(spark, tmp_path / "none", empty(spark), *none)).count() == 0
    assert P.run(spark, tables(spark, tmp_path / "bare", awkward(spark), *none)).count() > 0


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= names
    assert [n for n, _ in P.STAGES][2] == "MinHash near-dedup" and packing.OUT
