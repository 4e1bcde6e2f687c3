"""Suffix-array dedup: passages of ``min_words`` words or more that occur more than once.

Words are runs of bytes other than ASCII white space, compared byte for byte.

1. Every window of ``min_words`` words has a governing anchor: the first of its
   ``GRAM``-word sequences with the least hash. Equal windows have equal anchors at equal
   distances, so they meet in one bucket, and two that start at different places have
   anchors at different places. Consecutive windows with the anchor at one place form a run,
   which thus holds no window twice; it is kept as its place, its anchor's hash and a hash of
   its content, from the first word of its first window to the last of its last.
2. Runs are grouped by content, with partial aggregation, so that a passage with a million
   copies is one row. Buckets of one content that occurs once hold no repeat and end here.
3. Each remaining content is fetched once, from its first occurrence, and sent to its bucket.
   There a generalised suffix array over the bucket's contents is built by two-stage sorting:
   suffixes smaller than their successors are sorted directly, the others are induced by
   scanning buckets in order. Lengths of adjacent common prefixes, up to ``min_words``, then
   give the classes of equal windows, and the first occurrence of each class.
   Where many contents differ but share their anchor, as around boilerplate, a bucket may pass
   ``bucket_bytes``: it is split into its windows, which fold by a 128-bit hash, with partial
   aggregation, so that no task holds such a bucket.
4. The windows found go back to all occurrences of their content, and are merged to spans.

Defined results. A null or short text has no windows. Rows without a doc_id are left out.
Rows that repeat a doc_id with the same text are one document. A passage that occurs twice in
one document is a repeat too; of windows that overlap themselves, the first is kept. The
first occurrence is the least (doc_id, place). Extra columns are ignored. An empty table gives
no spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import id_text, written

GRAM = 16
RUNS = "bucket long, content long, doc_id long, place int, n int, first_byte int, end_byte int"
SPANS = "doc_id long, start_word int, end_word int, kept boolean"
END = np.uint64(0)


def _runs(min_words: int):
    gram = min(GRAM, min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = words.Hasher()
        for b in words.seen(batches):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for lo, _, data, offs in words.text_chunks(b.column(1)):
                s, e, wo = hasher.words(data, offs)
                if len(s) < min_words:
                    continue
                h = hasher.ranges(data, s, e)
                grams = words.grams(h, gram)
                anchor = words.sliding_argmin(grams, min_words - gram + 1)
                row = np.repeat(np.arange(len(offs) - 1), np.diff(wo))
                at = np.flatnonzero(np.arange(len(h)) + min_words <= wo[row + 1])
                if not len(at):
                    continue
                g, r = anchor[at], row[at]
                new = np.ones(len(at), bool)
                new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
                start = np.flatnonzero(new)
                size = np.diff(np.append(start, len(at)))
                w = at[start]
                last = w + size + min_words - 2
                pref = np.zeros(len(h) + 1, np.uint64)
                hasher.grow(len(h))
                np.cumsum(h * hasher.pw[: len(h)], out=pref[1:])
                content = words.mix((pref[last + 1] - pref[w]) * hasher.inv[w] + size.astype(np.uint64))
                rr = r[start]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[g[start]].view(np.int64)), pa.array(content.view(np.int64)), pa.array(ids[lo + rr], pa.int64()), *(pa.array(x.astype(np.int32)) for x in (w - wo[rr], size, s[w] - offs[rr], e[last] - offs[rr]))],
                    names=["bucket", "content", "doc_id", "place", "n", "first_byte", "end_byte"],
                )

    return run


def _slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a text and its runs become rows of a run and its bytes."""
    for b in batches:
        out, size = [], 0
        for text, runs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            raw = text.encode()
            for x in runs:
                out.append((x["bucket"], x["content"], x["doc_id"], x["place"], x["n"], x["copies"], raw[x["first_byte"] : x["end_byte"]]))
                size += x["end_byte"] - x["first_byte"]
            if size > 8 << 20:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)


def _batch(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["bucket", "content", "doc_id", "place", "n", "copies", "raw"])


def two_stage(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of t, whose last value is less than all others, in order of the first depth values at least.

    Values are ranks from 0. Suffixes smaller than their successors (the last counts as such)
    are sorted directly; each other suffix follows its successor's order within its bucket, so
    one scan over the buckets places them all. Buckets are scanned in groups within which no
    suffix waits for another's place.
    """
    n = len(t)
    # is the suffix smaller than its successor? decided by the next value that differs
    change = np.flatnonzero(t[1:] != t[:-1])
    small = np.ones(n, bool)
    if len(change):
        nxt = np.searchsorted(change, np.arange(n - 1))
        tail = nxt >= len(change)
        at = change[np.minimum(nxt, len(change) - 1)]
        small[: n - 1] = np.where(tail, False, t[at] < t[at + 1])
    # 1. direct: by blocks of values from the front, ties only
    own = np.flatnonzero(small)
    bits = max(1, int(t.max()).bit_length())
    per = max(1, 63 // bits)
    pad = np.concatenate([t, np.zeros(depth + per, t.dtype)]).astype(np.int64)

    def key(at: np.ndarray, skip: int) -> np.ndarray:
        k = np.zeros(len(at), np.int64)
        for j in range(per):
            k = (k << bits) | pad[np.minimum(at + skip + j, len(pad) - 1)]
        return k

    k = key(own, 0)
    order = np.argsort(k, kind="stable")
    own, k = own[order], k[order]
    group = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])]) if len(own) else np.zeros(0, np.int64)
    skip = per
    while skip < depth and len(own):
        same = np.zeros(len(own), bool)
        same[1:] = group[1:] == group[:-1]
        same[:-1] |= same[1:].copy()
        at = np.flatnonzero(same)
        if not len(at):
            break
        k = key(own[at], skip)
        order = np.lexsort((k, group[at]))
        own[at], k = own[at][order], k[order]
        differs = np.zeros(len(own), bool)
        differs[1:] = group[1:] != group[:-1]
        inner = np.zeros(len(at), bool)
        inner[1:] = k[1:] != k[:-1]
        differs[at[inner]] = True
        group = np.cumsum(differs)
        skip += per
    # 2. induced: in each bucket the others come first, by the order of their successors
    big = np.flatnonzero(~small)
    size = np.bincount(t, minlength=int(t.max()) + 2)
    begin = np.cumsum(size) - size
    bigs = np.bincount(t[big], minlength=len(size))
    rank = np.full(n + 1, -1, np.int64)
    sa = np.empty(n, np.int64)
    place = begin[t[own]] + bigs[t[own]]
    first = np.concatenate([[0], np.flatnonzero(t[own][1:] != t[own][:-1]) + 1]) if len(own) else np.zeros(0, np.int64)
    place += np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    sa[place], rank[own] = own, place
    if len(big):
        # how many equal values follow before the suffix falls: those wait for each other, in that order
        nxt = np.searchsorted(change, big)
        level = change[np.minimum(nxt, len(change) - 1)] - big
        order = np.lexsort((level, t[big]))
        big, level = big[order], level[order]
        bucket = t[big]
        heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.append(heads[1:], len(big))
        # the highest bucket that a bucket's suffixes fall to
        low = np.where(level == 0, t[np.minimum(big + 1, n - 1)], -1)
        need = np.maximum.reduceat(low, heads)
        values = bucket[heads]
        i = 0
        while i < len(heads):
            j = i + 1
            while j < len(heads) and need[j] < values[i]:
                j += 1
            a, b = heads[i], ends[j - 1]
            lv = level[a:b]
            for step in range(int(lv.max()) + 1):
                at = np.arange(a, b) if not lv.any() else a + np.flatnonzero(lv == step)
                if len(at):
                    o = np.lexsort((rank[big[at] + 1], bucket[at]))
                    p, v = big[at][o], bucket[at][o]
                    f = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
                    run = np.diff(np.append(f, len(v)))
                    pos = begin[v] + np.arange(len(v)) - np.repeat(f, run)
                    begin[v[f]] += run
                    sa[pos], rank[p] = p, pos
            i = j
    return sa


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """How many values each suffix shares with the one before it in sa, up to most. Found by hashes of blocks of halving size; those of length most are confirmed value by value."""
    n, width, q = len(t), 1, 0xD6E8FEB86659FD93
    blocks = [(1, words.mix(t.astype(np.uint64) + np.uint64(1)))]
    while width * 2 <= most:
        cur = blocks[-1][1]
        nxt = cur.copy()
        if n > width:
            nxt[:-width] += cur[width:] * words.U(pow(q, width, 1 << 64))
        width *= 2
        blocks.append((width, nxt))
    out = np.zeros(len(sa), np.int64)
    a, b, size = sa[1:], sa[:-1], np.zeros(max(len(sa) - 1, 0), np.int64)
    far = np.maximum(a, b)
    for width, h in reversed(blocks):
        at = np.flatnonzero(far + size + width <= n)
        at = at[h[a[at] + size[at]] == h[b[at] + size[at]]]
        size[at] += width
    out[1:] = np.minimum(size, most)
    at = np.flatnonzero(out == most)
    a, b = sa[at], sa[at - 1]
    for lo in range(0, len(at), 1 << 18):
        x, y = a[lo : lo + (1 << 18)], b[lo : lo + (1 << 18)]
        same = np.ones(len(x), bool)
        for k in range(most):
            same &= t[x + k] == t[y + k]
        out[at[lo : lo + (1 << 18)][~same]] = 0
    return out


def _right(hasher: words.Hasher, rows: dict, min_words: int):
    """Word hashes of contents, their offsets by row, offsets of bytes, and the rows that are their content, each once: a row of another text of the same doc_id isn't, and repeated rows give a content twice."""
    data, offs = words.buffers(pa.array(rows["raw"], pa.binary()))
    s, e, wo = hasher.words(data, offs)
    h = hasher.ranges(data, s, e)
    pref = np.zeros(len(h) + 1, np.uint64)
    hasher.grow(len(h))
    np.cumsum(h * hasher.pw[: len(h)], out=pref[1:])
    size = np.asarray(rows["n"], np.int64)
    content = words.mix((pref[wo[1:]] - pref[wo[:-1]]) * hasher.inv[np.minimum(wo[:-1], len(h))] + size.astype(np.uint64)).view(np.int64)
    right = np.flatnonzero((content == np.asarray(rows["content"], np.int64)) & (np.diff(wo) == size + min_words - 1))
    return h, wo, offs, right[np.unique(content[right], return_index=True)[1]]


def _windows(min_words: int):
    """Rows of contents become rows of their windows: 128 bits of hash, content and place in it, document and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = words.Hasher()
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                rows = {k: v for k, v in zip(b.schema.names, (c.to_pylist() for c in b.slice(lo, 2000).columns))}
                h, wo, _, right = _right(hasher, rows, min_words)
                n = np.asarray(rows["n"], np.int64)[right]
                row = np.repeat(right, n)
                off = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                at = wo[row] + off
                one, two = words.grams(h, min_words), words.grams(words.mix(h + np.uint64(0x9E3779B97F4A7C15)), min_words)
                take = lambda k: np.asarray(rows[k], np.int64)[row]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (one[at].view(np.int64), two[at].view(np.int64), take("content"), off.astype(np.int32), take("doc_id"), (take("place") + off).astype(np.int32), take("copies"))], names=["w1", "w2", "content", "off", "doc_id", "at", "copies"])

    return run


def _split(sliced: DataFrame, min_words: int) -> DataFrame:
    """(content, off, len, is_first) of the windows of contents that occur again, by folding windows."""
    every = written(sliced.mapInArrow(_windows(min_words), "w1 long, w2 long, content long, off int, doc_id long, at int, copies long"), "suffix-windows")
    again = every.groupBy("w1", "w2").agg(F.sum("copies").alias("total"), F.min(F.struct("doc_id", "at")).alias("first")).filter("total > 1").select("w1", "w2", "first")
    return every.join(again, ["w1", "w2"]).select("content", "off", F.lit(1).alias("len"), (F.struct("doc_id", "at") == F.col("first")).alias("is_first"))


def _repeats(hasher: words.Hasher, rows: dict, min_words: int):
    """For contents of whole buckets: (content, first window, windows, is first) of windows that occur again."""
    h, wo, offs, right = _right(hasher, rows, min_words)
    size = np.asarray(rows["n"], np.int64)
    if len(right) < len(size):
        return _repeats(hasher, {k: [v[i] for i in right] for k, v in rows.items()}, min_words) if len(right) else ([], [], [], [])
    # one text: the words of each content and a mark of its own after it
    n = len(offs) - 1
    count = np.diff(wo)
    _, code = np.unique(h, return_inverse=True)
    freq = np.bincount(code)
    rank = np.empty(len(freq), np.int64)
    rank[np.argsort(-freq, kind="stable")] = np.arange(len(freq))  # frequent words first: most suffixes are then induced, in few groups
    start = wo[:-1] + np.arange(n)
    t = np.empty(len(h) + n, np.int64)
    row = np.repeat(np.arange(n), count)
    at = np.arange(len(h)) + row
    t[at] = rank[code] + n
    t[start + count] = np.arange(n)[::-1]  # marks are least and differ, the last is 0
    sa = two_stage(t, min_words + 1)
    same = common_prefixes(t, sa, min_words) >= min_words
    group = np.cumsum(~same)
    where = np.searchsorted(start, sa, "right") - 1
    off = sa - start[where]
    n_windows, copies = np.asarray(rows["n"]), np.asarray(rows["copies"])
    ok = off < n_windows[where]
    group, where, off = group[ok], where[ok], off[ok]
    total = np.bincount(group, weights=copies[where])
    hit = total[group] > 1
    group, where, off = group[hit], where[hit], off[hit]
    doc, place = np.asarray(rows["doc_id"])[where], np.asarray(rows["place"])[where] + off
    o = np.lexsort((place, doc, group))
    first = np.zeros(len(o), bool)
    if len(o):
        first[o[np.concatenate([[True], group[o][1:] != group[o][:-1]])]] = True
    o = np.lexsort((off, where))
    where, off, first = where[o], off[o], first[o]
    new = np.ones(len(o), bool)
    new[1:] = (where[1:] != where[:-1]) | (off[1:] != off[:-1] + 1) | (first[1:] != first[:-1])
    k = np.flatnonzero(new)
    return np.asarray(rows["content"], np.int64)[where[k]], off[k].astype(np.int32), np.diff(np.append(k, len(o))).astype(np.int32), first[k]


def _search(min_words: int, limit: int = 6 << 20):
    """Rows come sorted by bucket; whole buckets are gathered to about limit bytes and searched at once."""
    names = ["bucket", "content", "doc_id", "place", "n", "copies", "raw"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = words.Hasher()
        held: dict = {k: [] for k in names}
        size = 0

        def flush():
            content, off, n, first = _repeats(hasher, held, min_words)
            return pa.RecordBatch.from_arrays([pa.array(content, pa.int64()), pa.array(off, pa.int32()), pa.array(n, pa.int32()), pa.array(first, pa.bool_())], names=["content", "off", "len", "is_first"])

        for b in batches:
            for row in zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in names)):
                if size > limit and row[0] != held["bucket"][-1]:
                    yield flush()
                    held, size = {k: [] for k in names}, 0
                for k, v in zip(names, row):
                    held[k].append(v)
                size += len(row[-1])
        if size:
            yield flush()

    return run


def _merge(min_words: int):
    """Rows of (doc_id, kept, sorted starts and lengths of windows): spans of words, joined where they touch or overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, kept, runs in zip(*(c.to_pylist() for c in b.columns)):
                a, z = None, None
                for x in runs:
                    s, e = x["s"], x["s"] + x["n"] + min_words - 1
                    if a is not None and s <= z:
                        z = max(z, e)
                    else:
                        if a is not None:
                            out.append((doc, a, z, kept))
                        a, z = s, e
                out.append((doc, a, z, kept))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.bool_()))], names=["doc_id", "start_word", "end_word", "kept"])

    return run


def repeated_passages(docs: DataFrame, min_words: int = 50, bucket_bytes: int = 32 << 20) -> DataFrame:
    """Spans [start_word, end_word) that occur more than once. kept: made of windows at their first occurrence; the other spans are what dedup removes."""
    base = id_text(docs).filter("text is not null")
    runs = written(base.mapInArrow(_runs(min_words), RUNS), "suffix-runs")
    at = F.struct("doc_id", "place", "n", "first_byte", "end_byte")
    # hot contents fold before the shuffle; distinct places, so that repeated rows count once
    contents = runs.groupBy("content", "bucket").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    contents = contents.select("content", "bucket", "first", F.when(F.col("first") == F.col("last"), 1).otherwise(2).cast("long").alias("copies"))
    buckets = contents.groupBy("bucket").agg(F.sum("copies").alias("total")).filter("total > 1").select("bucket")
    wanted = written(contents.join(buckets, "bucket", "left_semi"), "suffix-contents")
    lists = wanted.groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("bucket", "content", "first.doc_id", "first.place", "first.n", "copies", "first.first_byte", "first.end_byte")).alias("runs"))
    sliced = base.join(lists.hint("shuffle_hash"), "doc_id").select("text", "runs").mapInArrow(_slice, "bucket long, content long, doc_id long, place int, n int, copies long, raw binary")
    width = F.col("first.end_byte") - F.col("first.first_byte")
    large = written(wanted.groupBy("bucket").agg(F.sum(width.cast("long")).alias("bytes")).filter(F.col("bytes") > bucket_bytes).select("bucket"), "large-buckets")
    split = None
    if not large.isEmpty():
        sliced = written(sliced, "suffix-slices")
        split = _split(sliced.join(large, "bucket", "left_semi"), min_words)
        sliced = sliced.join(large, "bucket", "left_anti")
    found = sliced.repartition("bucket").sortWithinPartitions("bucket", "content", "doc_id").mapInArrow(_search(min_words), "content long, off int, len int, is_first boolean")
    found = found if split is None else found.unionByName(split)
    firsts = wanted.select("content", "first")
    hits = runs.join(found, "content").join(firsts, "content")
    own = (F.col("is_first") & (F.col("doc_id") == F.col("first.doc_id")) & (F.col("place") == F.col("first.place"))).alias("kept")
    spans = hits.select("doc_id", own, (F.col("place") + F.col("off")).alias("s"), F.col("len").alias("n"))
    return spans.groupBy("doc_id", "kept").agg(F.array_sort(F.collect_set(F.struct("s", "n"))).alias("runs")).mapInArrow(_merge(min_words), SPANS)
