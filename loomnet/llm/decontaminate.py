"""Benchmark decontamination with a generalised suffix automaton of the test items.

Texts and items are normalised alike: lower case, words are runs of letters and digits. The
automaton holds every word sequence of every item; streaming a text through it gives, at each
word, the longest sequence ending there that some item holds, and by its suffix links the
shorter ones. A span of a text is removed where an item holds it and it has at least
``max_words`` words, or ``min_words`` and at least ``max_coverage`` of that item, or is the whole
item, if that has at least ``least_item`` words. Of spans within one another the outermost counts.

Every such span consists of sequences of ``gram`` words of the items, gram being four or the least
limit below that, so only runs of those are streamed; elsewhere no span can be. That skips work,
not matches. Automata are built in tasks, one for about ``shard_words`` words of items, and
broadcast; a pass over the corpus streams through at most ``shards_held`` of them, and spans of all
are merged, so that results don't depend on the shards. A larger benchmark takes further passes.

Defined results. A null text or item has no words. Items without words, shorter than
``least_item`` and ``min_words``, and an empty benchmark, remove nothing. Rows without a doc_id are
cleaned too, and left out of reports of spans. Repeated rows and items give the same spans once each.
Overlapping spans are cut once. Extra columns pass through. Several items that hold a span are
reported as the shortest, by item_id. Limits are taken as one at least.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .common import fresh, id_text, written

GRAM = 4
SPANS = "doc_id long, item_id long, n_words int, coverage double, start_byte int, end_byte int"
WIDTH = 5  # numbers a span: start byte, end byte, words, words of the item, item


class Limits:
    def __init__(self, max_words: int, min_words: int, max_coverage: float, least_item: int):
        self.max_words, self.min_words, self.max_coverage, self.least_item = max(1, max_words), max(1, min_words), max_coverage, max(1, least_item)
        self.gram = min(GRAM, self.max_words, self.min_words, self.least_item)

    def met(self, m: int, size: int) -> bool:
        """Whether m words that an item of size words holds are to go."""
        return m >= self.max_words or m >= self.min_words and m >= self.max_coverage * size or m == size >= self.least_item


class Automaton:
    """Suffix automaton of many sequences of integers."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.len = [0]
        self.best: list = [None]

    def _state(self, length: int, nxt: dict, link: int) -> int:
        self.next.append(nxt)
        self.len.append(length)
        self.link.append(link)
        self.best.append(None)
        return len(self.len) - 1

    def _step(self, last: int, c: int) -> int:
        nxt, length, link = self.next, self.len, self.link
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q)
        cur = self._state(length[last] + 1, {}, 0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[p] + 1 == length[q] else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        k = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = k
            p = self.link[p]
        self.link[q] = k
        return k

    def add(self, seq: list[int]) -> None:
        last = 0
        for c in seq:
            last = self._step(last, c)

    def label(self, items: list[tuple[int, list[int]]]) -> None:
        """For each state, the shortest item that holds its sequences, as (words, item)."""
        best, link = self.best, self.link
        for item, seq in items:
            v = 0
            for c in seq:
                v = self.next[v][c]
                if best[v] is None or (len(seq), item) < best[v]:
                    best[v] = (len(seq), item)
        for v in sorted(range(1, len(link)), key=self.len.__getitem__, reverse=True):
            if best[v] is not None and link[v] > 0 and (best[link[v]] is None or best[v] < best[link[v]]):
                best[link[v]] = best[v]

    def settle(self, limits: Limits) -> None:
        """For each state, the nearest one by suffix links whose longest sequence meets the limits, or 0."""
        self.near = [0] * len(self.len)
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            u = self.link[v]
            self.near[v] = u if u > 0 and limits.met(self.len[u], self.best[u][0]) else self.near[u] if u > 0 else 0

    def spans(self, seq: list[int], limits: Limits) -> list[tuple[int, int, tuple]]:
        """(start, end, (words, item)) of the outermost spans that meet the limits, from left to right."""
        nxt, link, length, best, met = self.next, self.link, self.len, self.best, limits.met
        out: list = []
        v = n = 0
        for i, c in enumerate(seq, 1):
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            if c not in nxt[v]:
                n = 0
                continue
            v = nxt[v][c]
            n += 1
            u, m = (v, n) if met(n, best[v][0]) else (self.near[v], length[self.near[v]])
            if u:
                while out and out[-1][0] >= i - m:
                    out.pop()
                out.append((i - m, i, best[u]))
        return out


def _hashes(hasher: words.Hasher, col: pa.Array):
    """For each chunk of a column: first row, starts, ends, hashes of words, offsets of words by row, offsets of bytes."""
    for lo, _, data, offs in words.lowered_chunks(col):
        s, e, wo = hasher.words(data, offs, words.letters(data))
        yield lo, s, e, hasher.ranges(data, s, e), wo, offs


class Index:
    """The automaton, its vocabulary by word hash, and the hashes of its sequences of gram words."""

    def __init__(self, items: list[tuple[int, str]], limits: Limits):
        hasher, seqs, order = words.Hasher(), [], sorted(set(items))
        self.limits, k = limits, limits.gram
        for lo, _, _, h, wo, _ in _hashes(hasher, pa.array([t for _, t in order], pa.string())):
            seqs += [(order[lo + i][0], h[wo[i] : wo[i + 1]]) for i in range(len(wo) - 1) if wo[i] < wo[i + 1]]
        every = np.concatenate([h for _, h in seqs]) if seqs else np.zeros(0, np.uint64)
        self.vocab = np.unique(every)
        self.grams = np.unique(np.concatenate([words.grams(h, k)[: len(h) - k + 1] for _, h in seqs if len(h) >= k] or [np.zeros(0, np.uint64)]))
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.grams & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.automaton = Automaton()
        coded = [(i, np.searchsorted(self.vocab, h).tolist()) for i, h in seqs]
        for _, seq in coded:
            self.automaton.add(seq)
        self.automaton.label(coded)
        self.automaton.settle(limits)

    def spans(self, s, e, h, wo) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(row, first word, end word, words, words of the item, item) of each span, for the words of a chunk."""
        k = self.limits.gram
        if len(h) < k or not len(self.grams):
            return
        g = words.grams(h, k)[: len(h) - k + 1]
        at = np.flatnonzero(self.sieve[(g & np.uint64((1 << 20) - 1)).astype(np.int64)])
        x = np.minimum(np.searchsorted(self.grams, g[at]), len(self.grams) - 1)
        at = at[self.grams[x] == g[at]]
        row = np.searchsorted(wo, at, "right") - 1
        ok = at + k <= wo[row + 1]
        at, row = at[ok], row[ok]
        if not len(at):
            return
        new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(row) != 0)]))
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(at)]):
            first, n, i = int(at[a]), b - a + k - 1, int(row[a])
            for start, end, (size, item) in self.automaton.spans(np.searchsorted(self.vocab, h[first : first + n]).tolist(), self.limits):
                yield i, first + start, first + end, end - start, size, item


def indexes(benchmark: DataFrame, limits: Limits, shard_words: int) -> Iterator[bytes]:
    """Pickled automata over the benchmark, one at a time, each built in a task; items fall to shards by hash."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null").distinct()
    total = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    shards = -(-total // shard_words)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in words.seen(batches):
            for shard, item, text in zip(*(c.to_pylist() for c in b.columns)):
                held.setdefault(shard, []).append((item, text))
        for shard, items in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([cloudpickle.dumps(Index(items, limits))], pa.binary())], names=["shard", "index"])

    if shards:
        by = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int").alias("shard")
        built = written(rows.select(by, "item_id", "text").repartition("shard").mapInArrow(build, "shard int, index binary"), "automata")
        for r in built.orderBy("shard").toLocalIterator():
            yield bytes(r["index"])


def _merged(found: np.ndarray) -> np.ndarray:
    """Spans of one text without those within others; equal ones are that of the shortest item."""
    found = found[np.lexsort((found[:, 4], found[:, 3], -found[:, 1], found[:, 0]))]
    out, most = [], -1
    for x in found:
        if x[1] > most:
            out.append(x)
            most = x[1]
    return np.array(out, np.int64).reshape(-1, WIDTH)


def _index(name: str, held) -> Index:
    return words.kept(("automaton", name), lambda: pickle.loads(held.value))


def _spanned(df: DataFrame, text: str, ranges: str, benchmark: DataFrame, limits: Limits, shard_words: int, shards_held: int) -> DataFrame:
    """df, whose binary column ranges is empty, with the spans of each text in it."""
    spark, at, place = df.sparkSession, df.columns.index(text), df.columns.index(ranges)

    def through(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher, automata = words.Hasher(), [_index(name, h) for name, h in held]
            for b in batches:
                more: dict = {}
                for lo, s, e, h, wo, offs in _hashes(hasher, b.column(at)) if b.num_rows else ():
                    for index in automata:
                        for i, first, end, n, size, item in index.spans(s, e, h, wo):
                            more.setdefault(lo + i, []).append((int(s[first] - offs[i]), int(e[end - 1] - offs[i]), n, size, item))
                cols = list(b.columns)
                if more:
                    old = cols[place].to_pylist()
                    cols[place] = pa.array([_merged(np.concatenate([np.frombuffer(x, np.int64).reshape(-1, WIDTH), np.array(more[i], np.int64)])).tobytes() if i in more else x for i, x in enumerate(old)], pa.binary())
                yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

        return run

    lot: list = []
    for raw in indexes(benchmark, limits, shard_words):
        if len(lot) == shards_held:
            df = df.mapInArrow(through(lot), df.schema)
            df, lot = written(df, "spans"), []
        lot.append((hashlib.sha256(raw).hexdigest(), spark.sparkContext.broadcast(raw)))
    return df.mapInArrow(through(lot), df.schema) if lot else df


def contaminated(docs: DataFrame, benchmark: DataFrame, max_words: int = 13, min_words: int = 8, max_coverage: float = 0.8, least_item: int = 4, shard_words: int = 300_000, shards_held: int = 8) -> DataFrame:
    """The spans to remove, with the item that each comes from. Bytes count from the start of the UTF-8 text."""
    df = _spanned(id_text(docs).withColumn("ranges", F.lit(b"")), "text", "ranges", benchmark, Limits(max_words, min_words, max_coverage, least_item), shard_words, shards_held)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.seen(batches):
            lists = [np.frombuffer(x, np.int64).reshape(-1, WIDTH) for x in b.column(2).to_pylist()]
            x = np.concatenate(lists)
            if len(x):
                ids = b.column(0).take(pa.array(np.repeat(np.arange(len(lists)), [len(y) for y in lists])))
                yield pa.RecordBatch.from_arrays([ids, pa.array(x[:, 4]), pa.array(x[:, 2].astype(np.int32)), pa.array(x[:, 2] / x[:, 3]), pa.array(x[:, 0].astype(np.int32)), pa.array(x[:, 1].astype(np.int32))], names=["doc_id", "item_id", "n_words", "coverage", "start_byte", "end_byte"])

    return df.mapInArrow(report, SPANS).distinct()


def _cut(text: str, ranges: np.ndarray) -> str:
    raw, at, parts = text.encode(), 0, []
    for s, e in ranges[:, :2].tolist():
        if s > at:
            parts.append(raw[at:s])
        at = max(at, e)
    parts.append(raw[at:])
    return b"".join(parts).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_words: int = 13, min_words: int = 8, max_coverage: float = 0.8, least_item: int = 4, shard_words: int = 300_000, shards_held: int = 8, count: str | None = "n_spans") -> DataFrame:
    """docs with the spans cut from text; count: a column for how many spans each lost. No shuffle: automata add their ranges to the row, the last step cuts."""
    (ranges,) = fresh(docs, "ranges")
    text = [c.lower() for c in docs.columns].index("text")
    df = _spanned(docs.withColumn(ranges, F.lit(b"")), docs.columns[text], ranges, benchmark, Limits(max_words, min_words, max_coverage, least_item), shard_words, shards_held)
    at = len(docs.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [np.frombuffer(x, np.int64).reshape(-1, WIDTH) for x in b.column(at).to_pylist()]
            cols, names = list(b.columns[:at]), b.schema.names[:at]
            if any(map(len, lists)):
                cols[text] = pa.array([_cut(t, x) if len(x) else t for t, x in zip(cols[text].to_pylist(), lists)], b.schema.field(text).type)
            if count:
                cols.append(pa.array([len(x) for x in lists], pa.int32()))
                names = [*names, count]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.mapInArrow(cut, T.StructType([*docs.schema, *([T.StructField(count, T.IntegerType())] if count else [])]))
