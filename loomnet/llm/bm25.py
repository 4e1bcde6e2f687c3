"""Exact top-k search: BM25 over sharded inverted indexes with block-max WAND pruning.

Every row of the query table is a query; the k best documents of each are found exactly.

1. One pass over the corpus gives the number of documents, their mean length and the document
   frequency of every query term: all shards score with the same, global statistics.
2. Each task indexes its documents in shards of about ``shard_bytes``: postings of the terms
   that queries hold, each with its score, in blocks that lie within aligned ranges of
   ``RANGE`` documents, each with its maximum.
3. A query adds up the block maxima of its terms over the ranges. Ranges are visited in
   order of documents; one whose bound is below the k-th best score so far can't hold a
   result, and the pivot moves on to the next that can. Only there postings are scored. The
   first threshold comes from the ranges of highest bound.
4. The best k of each shard are merged; no document that a shard drops can be among the best.

Score: sum over the distinct terms of the query of ln(1 + (N - df + 0.5) / (df + 0.5)) * tf *
(k1 + 1) / (tf + k1 * (1 - b + b * length / mean length)), rounded to six digits. Ties go to
the lesser doc_id.

Defined results. Null texts aren't documents, empty ones are, of length 0. Rows without a
doc_id or item_id are left out. A document without any term of a query is no result of it, so
a query may have fewer than k results or none. Repeated rows count in the statistics as they
stand; each document comes once in a result, with its best score. Rows of one item_id are
queries of one result. Extra columns are ignored. Empty tables give no results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import id_text

RANGE = 16
SLACK = 2e-6  # scores this close may be equal once rounded


def _hashes(hasher: words.Hasher, col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, their offsets by row) of each chunk."""
    for lo, _, data, offs in words.text_chunks(words.lowered(col)):
        s, e, wo = hasher.words(data, offs, words.letters(data))
        yield lo, hasher.ranges(data, s, e), wo


class Terms:
    """The distinct terms of all queries, found by hash, and the terms of each query."""

    def __init__(self, queries: list[tuple[int, str]]):
        per = []
        for _, h, wo in _hashes(words.Hasher(), pa.array([t for _, t in queries], pa.string())):
            per += [np.unique(h[i:j]) for i, j in zip(wo[:-1], wo[1:])]
        self.vocab = np.unique(np.concatenate(per)) if per else np.zeros(0, np.uint64)
        self.queries = [(q[0], np.searchsorted(self.vocab, h)) for q, h in zip(queries, per)]
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.vocab & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are terms, and their terms."""
        if not len(self.vocab):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.sieve[(h & np.uint64(0xFFFF)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.vocab, h[at]), len(self.vocab) - 1)
        ok = self.vocab[k] == h[at]
        return at[ok], k[ok]


def _statistics(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, hasher = held.value, words.Hasher()
        n = total = 0
        df = np.zeros(len(terms.vocab), np.int64)
        for b in words.seen(batches):
            n += b.num_rows
            for _, h, wo in _hashes(hasher, b.column(1)):
                total += len(h)
                at, k = terms.find(h)
                row = np.searchsorted(wo, at, "right") - 1
                df += np.bincount(np.unique(row * len(df) + k) % max(len(df), 1), minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], some])), pa.array(np.concatenate([[n, total], df[some]]))], names=["term", "n"])

    return run


def _spread(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, stop), one after another."""
    n = stop - start
    return np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


class Shard:
    def __init__(self, doc: np.ndarray, term: np.ndarray, length: np.ndarray, ids: np.ndarray, n_terms: int, idf: np.ndarray, mean: float, k1: float, b: float):
        """doc and term of every word that is a term; length and id of every document."""
        self.ids = ids
        key, tf = np.unique(term.astype(np.int64) * len(ids) + doc, return_counts=True)
        t, self.doc = key // len(ids), key % len(ids)
        self.score = idf[t] * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * length[self.doc] / mean))
        block = t * (len(ids) // RANGE + 1) + self.doc // RANGE
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
        self.post = np.append(first, len(block))
        self.range = self.doc[first] // RANGE
        self.top = np.maximum.reduceat(self.score, first) if len(first) else np.zeros(0)
        self.blocks = np.searchsorted(t[first], np.arange(n_terms + 1))
        self.ranges = len(ids) // RANGE + 1

    def search(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and rounded scores of the k best documents."""
        at = _spread(self.blocks[terms], self.blocks[terms + 1])
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0)
        where, top = self.range[at], self.top[at]
        bound = np.bincount(where, top, self.ranges)
        best_ids, best = np.zeros(0, np.int64), np.zeros(0)

        def visit(chosen: np.ndarray) -> None:
            nonlocal best_ids, best
            go = np.zeros(self.ranges, bool)
            go[chosen] = True
            own = at[go[where]]
            p = _spread(self.post[own], self.post[own + 1])
            score = np.round(np.bincount(self.doc[p], self.score[p], len(self.ids)), 6) if len(p) > len(self.ids) >> 3 else None
            if score is None:
                docs, inverse = np.unique(self.doc[p], return_inverse=True)
                score = np.round(np.bincount(inverse, self.score[p]), 6)
            else:
                docs = np.flatnonzero(score)
                score = score[docs]
            ids, score = np.concatenate([best_ids, self.ids[docs]]), np.concatenate([best, score])
            order = np.lexsort((ids, -score))
            ids, score = ids[order], score[order]
            if len(ids) > 1 and len(np.unique(ids)) < len(ids):  # repeated rows: the best of each
                order = np.sort(np.unique(ids, return_index=True)[1])
                ids, score = ids[order], score[order]
            best_ids, best = ids[:k], score[:k]

        live = np.flatnonzero(bound)
        if len(live) > 8:
            first = live[np.argpartition(-bound[live], 7)[:8]]
            visit(first)
            live = np.setdiff1d(live, first, assume_unique=True)
            while len(live):
                if len(best) == k:
                    live = live[bound[live] >= best[-1] - SLACK]
                if len(live):
                    visit(live[:32])
                    live = live[32:]
        else:
            visit(live)
        return best_ids, best


def _search(held, idf: np.ndarray, mean: float, k: int, k1: float, b: float, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, hasher = held.value, words.Hasher()
        doc, term, length, ids = [], [], [], []
        n = size = 0

        def flush():
            shard = Shard(np.concatenate(doc), np.concatenate(term), np.concatenate(length), np.concatenate(ids), len(terms.vocab), idf, mean, k1, b)
            out = [(q, *shard.search(t, k)) for q, t in terms.queries]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([q for q, *_ in out], np.int64), np.array([len(i) for _, i, _ in out], np.int64))), pa.array(np.concatenate([np.zeros(0, np.int64), *(i for _, i, _ in out)])), pa.array(np.concatenate([np.zeros(0), *(s for *_, s in out)]))], names=["item_id", "doc_id", "score"])

        for batch in words.seen(batches):
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, h, wo in _hashes(hasher, batch.column(1)):
                at, t = terms.find(h)
                doc.append(n + np.searchsorted(wo, at, "right") - 1)
                term.append(t)
                length.append(np.diff(wo))
                ids.append(own[lo : lo + len(wo) - 1])
                n += len(wo) - 1
                size += 6 * len(h)
                if size > shard_bytes:
                    yield flush()
                    doc, term, length, ids = [], [], [], []
                    n = size = 0
        if n:
            yield flush()

    return run


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, shard_bytes: int = 24 << 20, most_queries: int = 20_000) -> DataFrame:
    """(item_id, rank, doc_id, score). Queries are broadcast, most_queries at a time; each lot reads the corpus again."""
    spark = docs.sparkSession
    base = id_text(docs).filter("text is not null")
    rows = [(r["item_id"], r["text"]) for r in queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna().distinct().orderBy("item_id", "text").toLocalIterator()]
    found = None
    for lo in range(0, max(len(rows), 1), most_queries):
        terms = Terms(rows[lo : lo + most_queries])
        held = spark.sparkContext.broadcast(terms)
        stats = {r["term"]: r["n"] for r in base.mapInArrow(_statistics(held), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # one row a query term
        n, total = stats.get(-2, 0), stats.get(-1, 0)
        df = np.array([stats.get(t, 0) for t in range(len(terms.vocab))], float)
        part = base.mapInArrow(_search(held, np.log(1 + (n - df + 0.5) / (df + 0.5)), total / max(n, 1), k, k1, b, shard_bytes), "item_id long, doc_id long, score double")
        found = part if found is None else found.unionByName(part)
    one = found.groupBy("item_id", "doc_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z_\x{C0}-\x{1FFF}\x{2C00}-\x{2FFF}\x{3040}-\x{10FFFF}]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
stats AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM words),
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(size) AS size FROM (SELECT doc_id, unnest(w) AS term, len(w) AS size FROM words) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
query AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[0-9a-z_\x{C0}-\x{1FFF}\x{2C00}-\x{2FFF}\x{3040}-\x{10FFFF}]+')) AS term FROM benchmark),
scored AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score
           FROM query JOIN tf USING (term) JOIN df USING (term), stats GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 10
"""
