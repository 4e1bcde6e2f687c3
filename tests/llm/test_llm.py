"""Each operator against brute force, and on awkward tables."""

import collections
import math
import random
import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from loomnet.llm import bm25, chat, decontaminate, line_dedup, neardup, packing, quality, rans, secrets, suffix, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: extra columns whose names operators may use inside
ODD = (DOCS + ", line string, h long, bucket long, rejected string, __key string, __gone string, score double, KEPT int, block int")


def words_of(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def awkward(spark):
    rng = random.Random(5)
    base, long = words_of(rng, 120), words_of(rng, 30_000, 5000)
    rows = [(1, base), (1, base), (2, base), (3, None), (None, base), (None, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "Ä’\U0001f600   x"), (8, "a\n\nb\na\n"), (9, long), (10, "same " * 500), (11, "x" * 50_000), (12, base + " end")]
    return spark.createDataFrame([(i, t, None, "s", None, None, 1, 2, "r", "k", "g", 0.5, 1, 0) for i, t in rows], ODD)


def empty(spark):
    return spark.createDataFrame([], ODD)


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# 1


def brute_repeats(rows, size):
    seen = collections.defaultdict(set)
    for i, w in rows:
        for j in range(len(w) - size + 1):
            seen[tuple(w[j : j + size])].add((i, j))
    at = collections.defaultdict(set)
    for v in seen.values():
        if len(v) > 1:
            for i, j in v:
                at[(i, (i, j) == min(v))].add(j)
    out = set()
    for (i, kept), js in at.items():
        a = None
        for j in sorted(js):
            if a is None or j > z:
                if a is not None:
                    out.add((i, a, z, kept))
                a = j
            z = j + size
        out.add((i, a, z, kept))
    return out


def split(t):
    return [x for x in re.split(r"[ \t\n\r\f\v]+", t or "") if x]


def test_two_stage_sorts_suffixes():
    rng = np.random.default_rng(0)
    for k in range(200):
        t = rng.integers(1, rng.integers(2, 7), rng.integers(1, 50))
        t = np.append(np.repeat(t, rng.integers(1, 5, len(t))) if k % 3 == 0 else t, 0).astype(np.int64)
        assert list(suffix.two_stage(t, len(t) + 2)) == sorted(range(len(t)), key=lambda i: tuple(t[i:]))


def test_common_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(50):
        t = np.append(np.repeat(rng.integers(1, 4, 60), rng.integers(1, 4, 60)), 0).astype(np.int64)
        sa = suffix.two_stage(t, len(t) + 2)
        want = [0] + [next((k for k in range(9) if t[a + k : a + k + 1].tolist() != t[b + k : b + k + 1].tolist()), 9) for a, b in zip(sa[1:], sa[:-1])]
        assert suffix.common_prefixes(t, sa, 9).tolist() == want


@pytest.mark.parametrize("size", [32 << 20, 3000, 0])
def test_suffix_dedup(spark, sf, size):
    """Whether buckets are searched whole, split into windows, or some of each."""
    got = {tuple(r) for r in suffix.repeated_passages(documents(spark, sf), bucket_bytes=size).collect()}
    assert got == brute_repeats([(r.doc_id, split(r.text)) for r in documents(spark, sf).collect()], 50)


def test_suffix_dedup_awkward(spark):
    d = awkward(spark)
    for size in (1 << 20, 0):
        got = {tuple(r) for r in suffix.repeated_passages(d, 8, size).collect()}
        assert got == brute_repeats({(r.doc_id, tuple(split(r.text))) for r in d.collect() if r.doc_id is not None}, 8)
    assert suffix.repeated_passages(empty(spark)).count() == 0


# 2


def shingles(t):
    w = re.findall(r"\w+", (t or "").lower())
    return {(w[j], w[j + 1]) for j in range(len(w) - 1)} or set(w)


def test_near_dedup_recall(spark, sf):
    sets = {r.doc_id: shingles(r.text) for r in documents(spark, sf).collect()}
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])]
    got = {r.doc_id: r for r in neardup.near_copies(documents(spark, sf)).collect()}
    found = sum(a in got and b in got and got[a].group_id == got[b].group_id for a, b in pairs)
    assert pairs and found >= 0.9 * len(pairs)
    assert set(got) <= {x for p in pairs for x in p}
    assert all(r.kept == (r.doc_id == r.group_id) for r in got.values())


def test_near_dedup_awkward(spark):
    got = {r.doc_id: (r.group_id, r.kept) for r in neardup.near_copies(awkward(spark)).collect()}
    assert got == {1: (1, True), 2: (1, False), 12: (1, False)}
    assert neardup.near_copies(empty(spark)).count() == 0
    left = neardup.one_of_each(awkward(spark))
    assert left.columns == awkward(spark).columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 0, 1, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11]


@pytest.mark.parametrize("how", [{"leaf": 16, "held": 16}, {"leaf": 4, "depth": 1, "held": 4}, {"leaf": 4, "depth": 3, "dense": 0.9, "held": 8}, {"leaf": 16}])
def test_large_groups_branch_and_join(spark, how):
    """Nodes of any size go by one rule, and no leaf is larger than it may be."""
    rng = random.Random(3)
    base = [words_of(rng, 80).split() for _ in range(3)]
    rows = []
    for i in range(240):
        w = list(base[i % 3])
        w[rng.randrange(80)] = f"v{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, words_of(rng, 60, 100_000)) for i in range(60)] + rows[:30]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in neardup.near_copies(docs, **how).collect()}
    assert got == {i: i % 3 for i in range(240)}
    signed = docs.distinct().mapInArrow(neardup._sign, "doc_id long, same long, n_words int, sig binary, sig8 binary")
    leaves, _ = neardup.leaves_of(signed, 0.5, 8, 2, how["leaf"], how.get("dense", 0.6), how.get("depth", 10), how.get("held", 1 << 14))
    assert max(r["count"] for r in leaves.groupBy("path").count().collect()) <= max(how["leaf"], how.get("held", 1 << 14))


def halves(rng, n, alike):
    """Pairs of texts with 2 * alike of 4 * alike shingles in common, n of them: Jaccard 0.5 or a little more."""
    rows = []
    for i in range(n):
        both, x, y = ([f"{k}{i}x{j}" for j in range(m)] for k, m in (("b", 2 * alike + 2), ("x", alike), ("y", alike)))
        rows += [(2 * i, " ".join(both + x)), (2 * i + 1, " ".join(both + y))]
    return rows


def test_no_link_at_the_threshold_is_left_out(spark):
    """Tokens alone dismiss some pairs of this kind, and a single tree misses many."""
    rows = halves(random.Random(1), 900, 12)
    sets = {i: shingles(t) for i, t in rows}
    assert all(len(sets[i] & sets[i + 1]) >= 0.5 * len(sets[i] | sets[i + 1]) for i in range(0, 1800, 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for how in ({}, {"trees": 1}):
        assert {r.doc_id: r.group_id for r in neardup.near_copies(docs, **how).collect()} == {i: i - i % 2 for i in range(1800)}


def test_texts_are_shuffled_once(spark, sf, monkeypatch):
    """Texts go to their buckets by one exchange; tokens aren't written again for deeper levels, nor exchanged."""
    plans, seen = {}, []

    def bucketed(df, name, *rest):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return kept[0](df, name, *rest)

    def written(df, name):
        seen.append(name)
        return kept[1](df, name)

    kept = neardup.bucketed, neardup.written
    monkeypatch.setattr(neardup, "bucketed", bucketed)
    monkeypatch.setattr(neardup, "written", written)
    monkeypatch.setattr(neardup, "BUCKET", 64)
    got = {tuple(r) for r in neardup.near_copies(documents(spark, sf), leaf=8).collect()}
    assert plans["texts-apart"].count("Exchange hashpartitioning") == 1
    assert plans["minwise"].count("Exchange") == 0
    assert "next-nodes" in seen and "deep-tokens" not in seen and list(plans) == ["texts-apart", "minwise"]
    monkeypatch.undo()
    assert got == {tuple(r) for r in neardup.near_copies(documents(spark, sf)).collect()}


@pytest.mark.parametrize("at_once", [1, 40, 1 << 19])
def test_parts_give_all_pairs_and_few_others(monkeypatch, at_once):
    """All pairs of different labels that meet the threshold come to their need, whatever the parts; pairs with a few common shingles aren't given at all."""
    monkeypatch.setattr(neardup, "PAIRS", at_once)
    rng = random.Random(at_once)
    sets = []
    for _ in range(12):
        base = rng.sample(range(20_000), rng.randrange(60, 240))
        sets += [set(base) - set(rng.sample(base, k * len(base) // 9)) | set(rng.sample(range(20_000), k * len(base) // 9)) for k in range(4)]
    sets += [{1, 2}, {1, 2, 3}, {5}, {5}]
    n = len(sets)
    label = np.array([k - k % 4 if k % 3 else k for k in range(n)])
    ids, size = np.arange(n) * 7, np.array([len(s) for s in sets])
    order = {t: k for k, t in enumerate(rng.sample(range(20_000), 20_000))}
    shown = [sorted(s, key=order.get)[: int(neardup.kept_of(len(s), 0.5))] for s in sets]
    want = {(7 * i, 7 * j) for i in range(n) for j in range(i + 1, n) if label[i] != label[j] and len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])}
    rows = {}
    for parts in (1, 5, 400):
        need, shared, rows[parts] = {}, collections.Counter(), 0
        for part in range(parts):
            at = [(d, t, k) for d, s in enumerate(shown) for k, t in enumerate(s) if t % parts == part]
            doc, token, place = (np.array(x, dtype) for x, dtype in zip(zip(*at) if at else ((), (), ()), (np.int64, np.uint32, np.uint16)))
            for found in neardup.meeting(ids, size, label, doc, token, place, 0.5, parts):
                for a, b, least, some in zip(*(x.tolist() for x in found)):
                    rows[parts] += 1
                    assert a < b and need.setdefault((a, b), least) == least
                    shared[a, b] += some
        assert want and want <= {p for p in need if shared[p] >= need[p]}
        assert len({p for p in need if shared[p] >= need[p]}) < 4 * len(want)
    assert rows[1] < 4 * len(want) < 0.5 * rows[400]


def test_prints_dismiss_no_link():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 300, 5000):
        for common in (0, n // 3, n // 2, n):
            x, y = (np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for _ in range(2))
            y[:common] = x[:common]
            bits, gaps = neardup.prints(x)
            assert common <= neardup.met_prints(np.unique(y), bits, gaps) <= common + 0.05 * n + 1
            assert len(gaps) <= 1.2 * n + 2


def test_frequencies_come_to_the_driver_compressed(spark):
    texts = ["a b c", "a b d", "a b", "", "e"]
    parts = neardup.frequencies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), len(texts))
    assert sum(map(len, parts.values())) < (1 << neardup.CELLS) // 50
    table = neardup.levels_of(parts)
    sets = dict(neardup._shingle_sets(words.Hasher(), pa.array(texts)))
    cells = collections.Counter(c for x in sets.values() for c in (words.mix(x) >> np.uint64(64 - neardup.CELLS)).tolist())
    assert max(cells.values()) >= 3 and len(table) == 1 << neardup.CELLS
    assert {int(k): int(table[k]) for k in np.flatnonzero(table)} == {k: int(np.log2(1.0 + n) * 12) for k, n in cells.items()}


def test_compare_skips_only_connected_pairs():
    rng = np.random.default_rng(0)
    for _ in range(40):
        base = rng.integers(0, 256, (3, neardup.TOKENS), dtype=np.uint8)
        sig = base[rng.integers(0, 3, 30)].copy()
        noise = rng.random(sig.shape) < rng.choice([0.1, 0.3, 0.5], 30)[:, None]
        sig[noise] = rng.integers(0, 256, noise.sum(), dtype=np.uint8)
        a, b, ok = neardup.compare(np.arange(30), sig, 0.5)
        root = list(range(30))
        same = (sig[:, None] == sig[None]).sum(2)
        for _ in range(30):
            for i in range(30):
                for j in range(30):
                    if same[i, j] >= (0.5 + neardup.MARGIN) * neardup.TOKENS:
                        root[i] = root[j] = min(root[i], root[j])
        assert {(x, y) for x, y, o in zip(a, b, ok) if o} == {(root[j], j) for j in range(30) if root[j] != j}
        near = {(i, j) for i in range(30) for j in range(i + 1, 30) if (0.5 - neardup.MARGIN) * neardup.TOKENS <= same[i, j] and root[i] != root[j]}
        assert {(x, y) for x, y, o in zip(a, b, ok) if not o} == near


# 3


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    train, held = labels.filter("doc_id % 4 <> 0"), labels.filter("doc_id % 4 = 0")
    rows = quality.scores(docs, train).join(held, "doc_id").collect()
    assert np.mean([(r.low_quality >= 0.5) == (r.quality == 0) for r in rows]) > 0.93
    assert np.mean([(r.toxicity >= 0.5) == (r.toxic == 1) for r in rows]) > 0.85


def test_quality_against_a_loop(spark, sf):
    """Scores of the registered operator against the same network, passage by passage and bag by bag."""
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    again = quality.fit(docs.repartition(5), labels.repartition(3))
    got = {r.doc_id: (r.low_quality, r.toxicity, r.rejected) for r in quality.scores(docs, labels).collect()}
    encoder = quality.Encoder()
    for r in docs.limit(60).collect():
        ((bucket, ranges, style, first),) = encoder.bags(pa.array([r.text]))
        x = quality.features(bucket, ranges, style, model.evidence).astype(np.float64)
        assert first[-1] == len(x) == max(1, -(-len(norm_all(r.text)) // quality.PASSAGE))
        want = []
        for net in model.nets:
            p, hs, es = net.p, [], []
            for v in x:
                h = np.tanh(np.clip((v - net.mean) / net.scale, -8, 8) @ p["W"] + p["b"])
                es.append(float(p["w"] @ (np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"]))))))
                hs.append(h)
            a = np.exp(np.array(es) - max(es))
            z = sum(k * h for k, h in zip(a / a.sum(), hs))
            want.append(1 / (1 + math.exp(-float(z @ p["c"] + p["d"][0]))))
        assert np.allclose(got[r.doc_id][:2], want, atol=2e-3) and (max(want) < 0.5 or got[r.doc_id][2] or abs(max(want) - 0.5) < 1e-2)
        assert np.array_equal(model.scores(encoder, pa.array([r.text])), again.scores(encoder, pa.array([r.text])))


def norm_all(t):
    h = words.Hasher()
    data, offs = words.buffers(pa.array([t.lower()]))
    return h.words(data, offs, words.letters(data))[0]


def test_quality_sample_is_bounded_and_fixed(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = documents(spark, sf)
    twice = docs.unionByName(docs.withColumn("text", quality.F.concat("text", quality.F.lit(" other"))))
    a, b = (quality.fit(d, labels) for d in (twice, twice.repartition(7)))
    encoder, text = quality.Encoder(), pa.array([docs.first().text])
    assert np.array_equal(a.scores(encoder, text), b.scores(encoder, text))
    assert not any(quality.fit(docs, labels, class_bytes=10).nets)
    kept = quality.accepted(awkward(spark), labels)
    assert kept.filter("text is null").count() == awkward(spark).filter("text is null").count()


def test_quality_awkward(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    d = awkward(spark)
    out = quality.classify(d, labels, names=("lo", "tox", "bad")).collect()
    assert len(out) == d.count() and all(0 <= r.lo <= 1 and 0 <= r.tox <= 1 for r in out)
    assert quality.scores(empty(spark), labels).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.rejected for r in quality.scores(d, none).collect()} == {False}
    nulls = spark.createDataFrame([(1, None, 1), (None, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.scores(d, nulls).count() == d.count()
    assert quality.accepted(d, labels).columns == d.columns


# 4


def norm(t):
    return re.findall(r"[0-9a-z_À-῿Ⰰ-⿿぀-\U0010ffff]+", (t or "").lower())


def brute_spans(text, items, least=13, short=8, share=0.8, whole=4):
    """{(first word, end word): (words of the shortest item that holds it, item)} of outermost spans over the limits."""
    subs = {}
    for k, w in items:
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                x = tuple(w[i:j])
                subs[x] = min(subs.get(x, (10**9, 0)), (len(w), k))
    w, hit = norm(text), {}
    for i in range(len(w)):
        for j in range(i + 1, len(w) + 1):
            size, k = subs.get(tuple(w[i:j]), (0, 0))
            if not size:
                break
            if (j - i >= least or j - i >= short and j - i >= share * size or j - i == size >= whole):
                hit[i, j] = (size, k)
    return {x: v for x, v in hit.items() if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in hit)}


def leaky(spark, seed, sizes):
    rng = random.Random(seed)
    items = [(k, words_of(rng, n, 30).split()) for k, n in enumerate(sizes)]
    items += [(90, items[-1][1][3:17] + ["tail"] * 4), (91, items[-1][1][5:15])]
    rows = []
    for i in range(60):
        w = words_of(rng, 40, 30).split()
        for _ in range(rng.randrange(3)):
            it = rng.choice(items)[1]
            a = rng.randrange(len(it)) if rng.random() < 0.6 else 0
            w[rng.randrange(40) : 0] = it[a : a + rng.randrange(3, 26)]
        rows.append((i, ", ".join(w).upper()))
    return items, rows, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")


@pytest.mark.parametrize("limits", [{}, {"max_words": 3, "min_words": 2, "max_coverage": 0.5, "least_item": 1}])
def test_decontamination_against_brute_force(spark, limits):
    items, rows, docs, bench = leaky(spark, 1, (2, 5, 6, 9, 14, 20, 25, 25))
    names = dict(zip(("least", "short", "share", "whole"), (limits.get(k, v) for k, v in (("max_words", 13), ("min_words", 8), ("max_coverage", 0.8), ("least_item", 4)))))
    want = {(i, *x, *v) for i, t in rows for x, v in brute_spans(t, items, **names).items()}
    for shard, held in ((300_000, 8), (40, 8), (1, 50), (30, 1)):
        if limits and shard < 300_000:
            break
        out = decontaminate.contaminated(docs, bench, shard_words=shard, shards_held=held, **limits).collect()
        got = set()
        for r in out:
            t = dict(rows)[r.doc_id].encode()
            got.add((r.doc_id, len(norm(t[: r.start_byte].decode())), len(norm(t[: r.end_byte].decode())), round(r.n_words / r.coverage), r.item_id))
        assert got == want and len(out) == len(want)
    cut = collections.Counter(x[0] for x in want)
    for r in decontaminate.decontaminate(docs, bench, shard_words=40, shards_held=2, **limits).collect():
        assert r.n_spans == cut[r.doc_id] and len(r.text) <= len(dict(rows)[r.doc_id])


def test_decontamination_awkward(spark):
    d = awkward(spark)
    base = d.filter("doc_id = 2").first().text
    bench = spark.createDataFrame([(1, " ".join(base.split()[20:50])), (2, ""), (3, None), (None, base), (1, " ".join(base.split()[20:50]))], "item_id long, text string")
    out = decontaminate.decontaminate(d, bench)
    assert out.columns == [*d.columns, "n_spans"] and out.count() == d.count()
    assert {r.doc_id for r in out.filter("n_spans > 0").collect()} == {None, 1, 2, 12}
    assert out.filter("doc_id = 2").first().text.split() == base.split()[:20] + base.split()[50:]
    assert {r.doc_id for r in decontaminate.contaminated(d, bench).collect()} == {1, 2, 12}
    assert decontaminate.contaminated(d, bench.filter("item_id = 99")).count() == 0
    assert decontaminate.decontaminate(empty(spark), bench).count() == 0


# 5


def check_packing(rows, docs, capacity):
    """Every distinct document stands in the sequences once, token for token."""
    coder = rans.Coder(rans.vocabulary_path())
    want = collections.Counter((r.doc_id, tuple(coder.coder.encode_ordinary(r.text))) for r in docs.select("doc_id", "text").distinct().collect() if r.doc_id is not None and r.text)
    pieces = collections.defaultdict(list)
    for r in rows:
        assert r.n_tokens == sum(r.lengths) == len(r.tokens) <= capacity and len(r.doc_ids) == len(r.starts) == len(r.lengths)
        at = 0
        for i, s, k in zip(r.doc_ids, r.starts, r.lengths):
            pieces[i].append((s, tuple(r.tokens[at : at + k])))
            at += k
    for (i, ids), n in want.items():
        for s in range(0, len(ids), capacity):
            pieces[i].remove((s, ids[s : s + capacity]))
    assert not any(pieces.values())
    return sum(len(ids) * n for (_, ids), n in want.items())


def test_packing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs, 512, block_docs=300).collect()
    total = check_packing(rows, docs, 512)
    assert len({r.bin_id for r in rows}) == len(rows) <= math.ceil(total / 512) * 1.02 + 4
    again = packing.pack(docs.repartition(7).unionByName(docs.limit(300)).unionByName(docs.limit(5).withColumn("text", packing.F.lit(None).cast("string"))), 512, block_docs=300)
    assert sorted(map(str, rows)) == sorted(map(str, again.collect()))


def fewest(sizes, capacity):
    """The least number of bins, by trying every way."""

    def place(k, room):
        if k == len(sizes):
            return len(room)
        best = place(k + 1, [*room, capacity - sizes[k]])
        for j in range(len(room)):
            if room[j] >= sizes[k] and room[j] not in room[:j]:
                best = min(best, place(k + 1, [r - sizes[k] * (i == j) for i, r in enumerate(room)]))
        return best

    return place(0, [])


def test_evolution_against_brute_force():
    rng, met = random.Random(4), 0
    for seed in range(40):
        sizes = [rng.randrange(10, 70) for _ in range(8)]
        bins, room = packing._solution(packing.evolve(sizes, 100, [], seed, 6, 20), sizes, 100)
        assert sorted(i for x in bins for i in x) == list(range(8)) and min(room) >= 0
        met += len(bins) == fewest(sizes, 100)
    assert met >= 39


def test_evolution_beats_best_fit_decreasing():
    """On lists where best fit by decreasing size leaves room, crossover finds better ones: no list ends worse, and generations gain over the first population."""
    better = gained = 0
    for seed in range(10):
        rng = random.Random(seed)
        sizes = [rng.randrange(150, 600) for _ in range(150)]
        first, after = (packing.fitness(*packing._solution(packing.evolve(sizes, 1000, [], 1, 6, n), sizes, 1000), 1000) for n in (0, 16))
        bins, room = [], []
        packing.best_fit(sorted(range(150), key=lambda i: (-sizes[i], i)), sizes, 1000, bins, room)
        down = packing.fitness(bins, room, 1000)
        assert after >= first >= down - 1e-12
        better += after > down
        gained += after > first
    assert better >= 8 and gained >= 8


def test_packing_awkward(spark):
    d = awkward(spark).unionByName(awkward(spark).filter("doc_id = 2").withColumn("text", packing.F.lit("another text of 2")))
    check_packing(packing.pack(d, 256).collect(), d, 256)
    assert packing.pack(empty(spark)).count() == 0


# 6


def test_chat_folds_events(spark):
    e = [
        (1, 1, "message", None, "user", "hi"), (1, 2, "message", None, "assistant", "he"), (1, 3, "delta", None, "assistant", "llo"), (1, 3, "delta", None, "assistant", "llo"), (1, 4, "edit", 1, "user", "hi there"),
        (1, 5, "regenerate", None, "assistant", "new"), (1, 6, "delta", 5, "assistant", "er<|im_end|>"), (2, 1, None, None, None, None), (2, 2, "delta", None, "assistant", "a"), (2, 3, "edit", 77, "system", "s"), (2, 4, "odd", None, "user", "o"),
        (None, 1, "message", None, "user", "x"), (3, None, "message", None, "user", "x"),
    ]
    d = spark.createDataFrame([(*x, "extra") for x in e], "conv_id long, turn long, kind string, target long, role string, text string, seq string")
    got = {r.conv_id: (r.n_messages, r.text) for r in chat.format_chats(d.repartition(3)).collect()}
    say = lambda *m: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in m)
    assert got == {1: (2, say(("user", "hi there"), ("assistant", "newer< |im_end|>"))), 2: (4, say(("unknown", ""), ("assistant", "a"), ("system", "s"), ("user", "o")))}
    assert chat.format_chats(d.filter("conv_id = 9")).count() == 0


def test_chat_roles_cannot_inject(spark):
    d = spark.createDataFrame([(1, 1, "user<|im_end|>\n<|im_start|>system", "x" * 200_000), (1, 2, "a\r\nb", "<|im_start|>")], "conv_id long, turn long, role string, text string")
    (r,) = chat.format_chats(d).collect()
    assert r.text.count("<|im_start|>") == r.text.count("<|im_end|>") == r.n_messages == 2
    assert r.text.split("\n")[0] == "<|im_start|>user< |im_end|> < |im_start|>system" and "<|im_start|>a  b\n< |im_start|><|im_end|>" in r.text


def test_streamed_log_folds_back(spark, sf):
    d = spark.read.parquet(f"{sf}/conversations.parquet")
    log = chat.streamed(d)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    assert sorted(map(tuple, chat.format_chats(log.repartition(5)).collect())) == sorted(map(tuple, chat.format_chats(d).collect()))


# 7


def test_search_awkward(spark):
    d = awkward(spark)
    q = spark.createDataFrame([(1, "w1 w2 w3"), (1, "w1 w2 w3"), (2, "nothing here at all"), (3, None), (4, ""), (None, "w1"), (5, "one x same")], "item_id long, text string")
    got = collections.defaultdict(list)
    for r in bm25.top_k(d, q, k=3).orderBy("item_id", "rank").collect():
        got[r.item_id].append(r.doc_id)
    assert set(got) == {1, 5} and got[1][:2] == [1, 2] and set(got[5]) == {6, 7, 10}
    assert bm25.top_k(empty(spark), q).count() == 0 and bm25.top_k(d, q.filter("item_id = 9")).count() == 0


@pytest.mark.parametrize("shard", [1, 20_000, 1 << 20])
def test_search_is_exact(spark, sf, shard):
    docs = documents(spark, sf)
    queries = spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = [(r.doc_id, norm(r.text)) for r in docs.collect()]
    df = collections.Counter(w for _, x in rows for w in set(x))
    mean = np.mean([len(x) for _, x in rows])
    got = collections.defaultdict(list)
    for r in bm25.top_k(docs, queries, shard_bytes=shard).orderBy("item_id", "rank").collect():
        got[r.item_id].append((r.doc_id, r.score))
    for r in queries.collect():
        s = {}
        for i, x in rows:
            tf = collections.Counter(x)
            v = sum(math.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(x) / mean)) for w in set(norm(r.text)) if w in tf)
            if v:
                s[i] = v
        best = sorted(s.items(), key=lambda x: (-round(x[1], 6), x[0]))[:10]
        assert [i for i, _ in best] == [i for i, _ in got[r.item_id]]
        assert np.allclose([v for _, v in best], [v for _, v in got[r.item_id]], rtol=0, atol=1e-6)


# 8


def test_ledger_scans_only_unseen(spark):
    key = "AKIA" + "A" * 16
    d = spark.createDataFrame([(1, f"x {key} y {key}"), (1, f"x {key} y {key}"), (2, f"x {key} y {key}"), (3, "clean"), (4, None), (None, key), (5, ""), (1, "password=hunter22")], "doc_id long, text string")
    found, ledger = secrets.scan(d)
    assert ledger.count() == 4 * len(secrets.RULES)
    rows = {(r.doc_id, r.rule, r.n) for r in secrets.secret_scan(d).collect()}
    assert rows == {(1, "aws_access_key", 2), (2, "aws_access_key", 2), (1, "password", 1)}
    assert secrets.scan(d, ledger)[0].count() == 0 and secrets.pending(d, ledger).count() == 0
    newer = [(r, v + (r == "password"), p) for r, v, p in secrets.RULES]
    again, more = secrets.scan(d, ledger, newer)
    assert {(r.rule, r.version) for r in again.collect()} == {("password", 2)} and more.count() == 4
    grown = d.unionByName(spark.createDataFrame([(9, f"new {key}")], d.schema))
    assert {r.doc_id for r in secrets.secret_scan(grown, ledger).collect()} == {9}
    assert secrets.secret_scan(empty(spark)).count() == 0 and secrets.secret_scan(awkward(spark)).count() == 0


def test_quoted_hex_in_any_case(spark):
    keys = ["0123456789abcdef" * 2 + "01234567", "0123456789ABCDEF" * 2 + "01234567", "0123456789abcDEF" * 2 + "01234567"]
    d = spark.createDataFrame([(i, f'token = "{k}"') for i, k in enumerate(keys)] + [(9, f'"{keys[1]}F"')], "doc_id long, text string")
    assert {(r.doc_id, r.rule, r.version, r.n) for r in secrets.secret_scan(d).collect()} == {(i, "quoted_hex", 2, 1) for i in range(3)}


def test_new_path_of_a_known_blob(spark):
    key = "AKIA" + "A" * 16
    d = spark.createDataFrame([(1, f"x {key}"), (2, "password=hunter22")], "doc_id long, text string")
    findings, ledger = secrets.scan(d)
    grown = d.unionByName(spark.createDataFrame([(7, f"x {key}"), (9, f"new {key}")], d.schema))
    rows = sorted(map(tuple, secrets.secret_scan(grown, ledger, findings=findings.unionByName(findings)).collect()))
    assert [r[0] for r in rows] == [1, 2, 7, 9] and rows == sorted(map(tuple, secrets.secret_scan(grown).collect()))
    newer = [(r, v + (r == "password"), p) for r, v, p in secrets.RULES]
    rows = {(r.doc_id, r.rule, r.version) for r in secrets.secret_scan(grown, ledger, newer, findings).collect()}
    assert rows == {(1, "aws_access_key", 1), (2, "password", 2), (7, "aws_access_key", 1), (9, "aws_access_key", 1)}


def test_ledger_with_nulls(spark):
    key = "AKIA" + "A" * 16
    d = spark.createDataFrame([(1, f"x {key}")], "doc_id long, text string")
    odd = spark.createDataFrame([(None, "aws_access_key", 1), ("b", None, 1), ("b", "jwt", None)], "blob string, rule string, version int")
    gaps = spark.createDataFrame([(None, "aws_access_key", 1, "s", 1), ("b", "aws_access_key", 1, None, 1)], "blob string, rule string, version int, secret string, n int")
    assert [(r.doc_id, r.rule, r.n) for r in secrets.secret_scan(d, odd, findings=gaps).collect()] == [(1, "aws_access_key", 1)]


# 9


def joined(pieces):
    """(doc_id, ids) of the pieces of all blocks, in order."""
    out = []
    for i, start, ids in pieces:
        if start:
            assert out[-1][0] == i and len(out[-1][1]) == start
            out[-1][1].extend(ids)
        else:
            out.append((i, list(ids)))
    return out


def test_rans_round_trip(spark, sf):
    for d in (documents(spark, sf), awkward(spark)):
        blocks, freq = rans.encode(d, block_tokens=5000, every=3)
        coder, got = rans.Coder(rans.vocabulary_path()), []
        for r in sorted(blocks.collect(), key=lambda r: r.block_id):
            assert r.n_tokens == sum(r.lengths) <= 5000
            ids = rans.decode_block(r.asDict(), freq, every=3)
            cut = np.cumsum([0, *r.lengths])
            got += [(i, s, ids[a:b]) for i, s, a, b in zip(r.doc_ids, r.starts, cut, cut[1:])]
        assert sorted((i, coder.decode(x)) for i, x in joined(got)) == sorted((r.doc_id, r.text or "") for r in d.collect() if r.doc_id is not None)
    assert rans.token_blocks(empty(spark)).count() == 0
    bad = blocks.first().asDict()
    bad["words"] = bytes(len(bad["words"]))
    with pytest.raises(ValueError):
        rans.decode_block(bad, freq, every=3)


def test_texts_are_coded_without_a_search_for_special_tokens():
    coder = rans.Coder(rans.vocabulary_path())
    texts = ["", " ", "<|endoftext|>", "l'été  où\n\n x1 22", "Ä’\U0001f600   x", "\u4e2d\u6587 \u0660\u0661", "x" * 5000, "a\n\nb\n"]
    want = [coder.coder.encode_to_numpy(t, disallowed_special=()).astype(coder.kind).tobytes() for t in texts]
    real = coder.coder

    class Ordinary:
        encode_ordinary = staticmethod(real.encode_ordinary)

    coder.coder = Ordinary
    assert [coder.encode(t) for t in texts] == want


def test_blocks_decode_from_their_rows_alone(spark, sf, tmp_path):
    for k, d in enumerate((documents(spark, sf), awkward(spark))):
        rans.token_blocks(d, block_tokens=5000, every=3).write.parquet(f"{tmp_path}/{k}")
        rows = spark.read.parquet(f"{tmp_path}/{k}")
        assert rows.filter("freq is not null").count() == 1 and rows.count() > 2
        coder = rans.Coder(rans.vocabulary_path())
        got = sorted(((r.block_id, n, r.doc_id, r.start, r.tokens) for n, r in enumerate(rans.pieces(rows.coalesce(1)).collect())), key=lambda r: r[:2])
        assert sorted((i, coder.decode(x)) for i, x in joined(r[2:] for r in got)) == sorted((r.doc_id, r.text or "") for r in d.collect() if r.doc_id is not None)


# 10


def brute_lines(rows):
    first, out = {}, {}
    for i, t in sorted({(i, t) for i, t in rows if i is not None and t is not None}):
        for k, x in enumerate(t.split("\n")):
            if x.strip(" \t\n\r\f\v"):
                first.setdefault(x, (i, k))
    for i, t in rows:
        out[(i, t)] = t if i is None or t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if not x.strip(" \t\n\r\f\v") or first[x] == (i, k))
    return out


@pytest.mark.parametrize("how", [{}, {"segment_lines": 40}, {"bits_per_line": 1}, {"segment_lines": 64, "bits_per_line": 1}])
def test_line_dedup(spark, sf, how):
    for d in (documents(spark, sf), awkward(spark)):
        want = brute_lines([(r.doc_id, r.text) for r in d.collect()])
        out = line_dedup.line_dedup(d, count="gone!", **how)
        assert out.columns == [*d.columns, "gone!"]
        rows = out.collect()
        assert sorted(((r.doc_id or 0, r.text or "") for r in rows)) == sorted(((r.doc_id or 0, want[(r.doc_id, r.text)] or "") for r in d.collect()))
    assert line_dedup.line_dedup(empty(spark)).count() == 0


# kernels


def test_word_kernels():
    texts = ["", " a  b\nc ", "x", "é\tü", "   ", "a b c a b c"]
    h = words.Hasher()
    data, offs = words.buffers(pa.array(texts))
    s, e, wo = h.words(data, offs)
    got = [[bytes(data[s[k] : e[k]]).decode() for k in range(wo[i], wo[i + 1])] for i in range(len(texts))]
    assert got == [t.split() for t in texts]
    v = h.ranges(data, s, e)
    assert len(set(v.tolist())) == len({x for t in texts for x in t.split()})
    x = np.random.default_rng(0).integers(0, 9, 200).astype(np.uint64)
    for k in (1, 2, 3, 7, 16):
        g = words.grams(x, k)[: 200 - k + 1]
        assert len(set(g.tolist())) == len({tuple(x[i : i + k]) for i in range(200 - k + 1)})
        at = words.sliding_argmin(x, k)
        assert all(at[i] == i + int(np.argmin(x[i : i + k])) for i in range(200 - k + 1))


HOLDS = """
import re
import numpy as np
import pyarrow as pa
from loomnet.llm import line_dedup, neardup

def mb():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches():
    for k in range(3):
        texts = [f"{k} {i} " + "some words of a text\\n" * 100 for i in range(10_000)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.array(texts), pa.array(np.arange(10_000))], names=["doc_id", "text", "mark"])

before = mb()
for step in (line_dedup._hashed, neardup._named):
    for _ in step(batches()):
        pass
print(mb() - before)
"""


def test_a_worker_gives_memory_back():
    """Workers of an executor live on side by side from step to step, so what is free may not stay with them."""
    root = words.__file__.rsplit("/loomnet/", 1)[0]
    out = subprocess.run([sys.executable, "-c", HOLDS], cwd=root, capture_output=True, text=True, check=True, timeout=120)
    assert float(out.stdout) < 60, out.stdout


def test_lowered_chunks():
    texts = ["ÀB c", None, "", "İ" * 30, "X" * 50, "ẞ x", "É", None]
    for col in (pa.array(texts), pa.array(["z", *texts]).slice(1)):
        for size in (1, 8, 40, 1 << 20):
            got, want = (list(x) for x in (words.lowered_chunks(col, size), words.text_chunks(words.lowered(col), size)))
            assert [(a, b, bytes(c), d.tolist()) for a, b, c, d in got] == [(a, b, bytes(c), d.tolist()) for a, b, c, d in want]
