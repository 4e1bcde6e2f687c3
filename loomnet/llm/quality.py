"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` words; whole texts count, however long. Every
passage is encoded into word-evidence and style features. A gated attention network learns from
document labels which passages decide, pools their representations with its weights and scores
the pool: one network for low quality, one for toxicity. A document is rejected when either
score is at least one half.

Fitting uses a bounded sample of labelled rows: at most ``per_class`` of each (quality, toxic)
class, by hash of the id, and of each class the first rows that have ``class_bytes`` of text
together, whole texts only. Half of it gives the word evidence (log-odds in standard deviations,
by hashed word), the other half the networks, so that the networks see evidence from documents
other than their own. Scoring reads every document once and shuffles nothing.

Defined results. A null or empty text is one passage without words, and is scored. Rows without
a doc_id are scored too. Labels with a null, or for ids that aren't there, are left out; an id
with several labels has the worst. With fewer than two classes of a label, its score is 0.
Repeated rows get the same scores; of several texts of a labelled id the least is fitted. Extra columns pass through. An empty table gives an empty one.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .common import fresh

PASSAGE = 64
BUCKETS = 1 << 18
HIDDEN = 12
#: Evidence is gathered for whole words and for their first bytes, so that inflected and derived forms share it.
PREFIXES = (4, 5, 6)

# byte classes: 0 lower, 1 upper, 2 digit, 3 white space, 4 plain punctuation, 5 other symbols, 6 beyond ASCII
_CLASS = np.full(256, 5, np.uint8)
_CLASS[128:] = 6
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\f\v", b".,;:'\"!?-()")):
    _CLASS[list(_chars)] = _k


class Encoder:
    """Passages of a column of texts and their features, before evidence is known (words) and after."""

    def __init__(self) -> None:
        self.hasher = words.Hasher()

    def bags(self, col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each chunk: buckets of words (whole, then by prefix), first word of each passage, style features of passages, first passage of each row."""
        for lo, hi, data, offs in words.text_chunks(col):
            low = words.buffers(words.lowered(col.slice(lo, hi - lo)))[0]
            s, e, wo = self.hasher.words(low, offs, words.letters(low))
            pref = self.hasher.prefix(low)
            h = self.hasher.ranges(low, s, e, pref)
            kinds = np.stack([h, *(self.hasher.ranges(low, s, np.minimum(s + k, e), pref) + np.uint64(k) for k in PREFIXES)])
            del pref
            n = np.diff(wo)
            per = np.maximum(1, -(-n // PASSAGE))
            first = np.concatenate([[0], np.cumsum(per)])
            row = np.repeat(np.arange(len(n)), per)
            start = wo[row] + (np.arange(first[-1]) - first[row]) * PASSAGE
            stop = np.minimum(start + PASSAGE, wo[row + 1])
            begin = offs[row].copy()
            later = np.arange(first[-1]) > first[row]
            begin[later] = s[start[later]]
            finish = np.concatenate([begin[1:], [len(data)]])
            yield (kinds % np.uint64(BUCKETS)).astype(np.int32), np.stack([start, stop]), self.style(data, h, s, e, begin, finish, start, stop), first

    def style(self, data, h, s, e, begin, finish, start, stop) -> np.ndarray:
        kind = _CLASS[data]
        size = np.maximum(finish - begin, 1).astype(np.float32)
        share = []
        for k in range(7):
            c = np.zeros(len(data) + 1, np.int32)
            np.cumsum(kind == k, out=c[1:])
            share.append((c[finish] - c[begin]) / size)
        n = np.maximum(stop - start, 1).astype(np.float32)

        def mean(x):
            c = np.zeros(len(x) + 1, np.float64)
            np.cumsum(x, out=c[1:])
            return ((c[stop] - c[start]) / n).astype(np.float32)

        again = np.zeros(len(h), bool)
        near = []
        for lag in (1, 2, 3, 5, 8, 13):
            if len(h) > lag:
                again[lag:] |= h[lag:] == h[:-lag]
            if lag in (1, 13):
                near.append(mean(again))
        length = mean(e - s)
        low, up = share[0], share[1]
        return np.stack([*share, up / np.maximum(low + up, 1e-3), *near, length / 10, np.log1p(stop - start) / 4, np.log1p(size) / 6], axis=1).astype(np.float32)


def _pieces(x: np.ndarray, start: np.ndarray, stop: np.ndarray, op, empty: float) -> np.ndarray:
    """op.reduceat over [start, stop) of consecutive ranges, some of which may be empty."""
    out = np.full(len(start), empty, np.float32)
    full = np.flatnonzero(stop > start)
    if len(full):
        out[full] = op.reduceat(x, start[full])  # ranges are adjacent, so each ends where the next begins
    return out


def features(bucket, ranges, style, evidence) -> np.ndarray:
    start, stop = ranges
    cols = [style]
    n = np.maximum(stop - start, 1)
    for table, own in ((t, x) for t in evidence for x in bucket):
        z = table[own]
        top = _pieces(z, start, stop, np.maximum, 0)
        strong = _pieces(np.maximum(z - 3, 0), start, stop, np.add, 0)
        cols.append(np.stack([top, np.log1p(strong), _pieces(z, start, stop, np.add, 0) / n], axis=1))
    return np.concatenate(cols, axis=1).astype(np.float32)


class Attention:
    """Gated attention over the passages of a bag: h = tanh(Wx), a = softmax(w (tanh(Vh) * sigmoid(Uh))), p = sigmoid(c sum(a h))."""

    def __init__(self, n: int, seed: int = 0):
        r = np.random.default_rng(seed)
        k = HIDDEN
        self.p = {"W": r.normal(0, n**-0.5, (n, k)), "b": np.zeros(k), "V": r.normal(0, k**-0.5, (k, k)), "U": r.normal(0, k**-0.5, (k, k)), "w": r.normal(0, k**-0.5, k), "c": r.normal(0, k**-0.5, k), "d": np.zeros(1)}
        self.p = {x: v.astype(np.float32) for x, v in self.p.items()}
        self.mean, self.scale = np.zeros(n, np.float32), np.ones(n, np.float32)

    def forward(self, x: np.ndarray, first: np.ndarray):
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        e = np.exp(e - np.maximum.reduceat(e, first[:-1])[row])
        a = e / np.add.reduceat(e, first[:-1])[row]
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        return h, t, g, a, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30))), row

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(np.clip((x - self.mean) / self.scale, -8, 8), first)[5]

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = 200, rate: float = 0.03, decay: float = 1e-4) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + np.float32(1e-2)
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)).astype(np.float32)
        m, v = ({k: np.zeros_like(q) for k, q in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            p = self.p
            h, t, g, a, z, out, row = self.forward(x, first)
            dz0 = (out - y) * weight
            d = {"c": z.T @ dz0, "d": np.array([dz0.sum()])}
            dz = dz0[:, None] * p["c"]
            da = (h * dz[row]).sum(1)
            de = a * (da - np.add.reduceat(a * da, first[:-1])[row])
            d["w"] = (t * g).T @ de
            dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
            d["V"], d["U"] = h.T @ dt, h.T @ dg
            dh = (a[:, None] * dz[row] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
            d["W"], d["b"] = x.T @ dh, dh.sum(0)
            for k in p:
                grad = d[k] + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)


class Model:
    """Word evidence and a network for each label; label 0: low quality, label 1: toxic."""

    def __init__(self, texts: list, y: np.ndarray):
        encoder = Encoder()
        chunks = list(encoder.bags(pa.array(texts, pa.string()))) if texts else []
        half = np.arange(len(texts)) % 2 == 0  # texts come in order of hash
        self.evidence = [np.zeros(BUCKETS, np.float32) for _ in range(2)]
        self.nets: list = [None, None]
        docs = [np.unique(bucket[:, ranges[0, first[i]] : ranges[1, first[i + 1] - 1]]) for bucket, ranges, _, first in chunks for i in range(len(first) - 1)]
        for k in range(2):
            if min(y[half, k].sum(), (1 - y[half, k]).sum(), y[~half, k].sum(), (1 - y[~half, k]).sum()) < 1:
                continue
            count = np.zeros((2, BUCKETS))
            for i in np.flatnonzero(half):
                count[y[i, k]][docs[i]] += 1
            a, b = count[1], count[0]
            na, nb = y[half, k].sum(), (1 - y[half, k]).sum()
            # the prior weight of a word follows how common it is in both
            alpha = 0.5 + 2 * (a + b) / (na + nb)
            odds = np.log((a + alpha) / (na + 2 * alpha)) - np.log((b + alpha) / (nb + 2 * alpha))
            self.evidence[k] = (odds / np.sqrt(1 / (a + alpha) + 1 / (b + alpha))).astype(np.float32)
            self.nets[k] = True
        if any(self.nets):
            x = np.concatenate([features(b, r, s, self.evidence) for b, r, s, _ in chunks])
            per = np.concatenate([np.diff(f) for *_, f in chunks])
            use = np.repeat(~half, per)
            first = np.concatenate([[0], np.cumsum(per[~half])])
            for k in range(2):
                if self.nets[k]:
                    self.nets[k] = Attention(x.shape[1])
                    self.nets[k].fit(x[use], first, y[~half, k].astype(np.float32))

    def scores(self, encoder: Encoder, col: pa.Array) -> np.ndarray:
        """(rows, 2) chances of low quality and of toxicity."""
        out = [np.zeros((0, 2))]
        for b, r, s, first in encoder.bags(col):
            x = features(b, r, s, self.evidence) if any(self.nets) else None
            out.append(np.stack([net.score(x, first) if net else np.zeros(len(first) - 1) for net in self.nets], axis=1))
        return np.concatenate(out)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, class_bytes: int = 64 << 20) -> Model:
    clean = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).dropna()
    one = clean.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    h = F.xxhash64("doc_id")
    sample = None
    for q in (0, 1):
        for t in (0, 1):
            part = one.filter((F.col("quality") == q) & (F.col("toxic") == t)).orderBy(h, "doc_id").limit(per_class)
            sample = part if sample is None else sample.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most 4 * per_class ids, whatever the corpus: small enough to broadcast, and to fit in one task
    rows = texts.join(F.broadcast(sample), "doc_id").groupBy(h.alias("h"), "doc_id", "quality", "toxic").agg(F.min("text").alias("text"))
    w = Window.partitionBy("quality", "toxic").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(w)
    rows = rows.withColumn("total", total).filter(F.col("total") <= class_bytes).select("h", "doc_id", "text", "quality", "toxic")
    trained = rows.repartition(1).mapInArrow(_train, "model binary").first()
    return pickle.loads(trained["model"]) if trained else Model([], np.zeros((0, 2), int))


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All sampled rows, in order of hash, become one pickled model."""
    got = [b for b in batches if b.num_rows]
    if got:
        rows = pa.Table.from_batches(got).sort_by([("h", "ascending"), ("doc_id", "ascending")])
        y = np.stack([1 - rows["quality"].to_numpy().astype(int), rows["toxic"].to_numpy().astype(int)], axis=1)
        model = Model(rows["text"].to_pylist(), np.clip(y, 0, 1))
    else:
        model = Model([], np.zeros((0, 2), int))
    yield pa.RecordBatch.from_arrays([pa.array([cloudpickle.dumps(model)], pa.binary())], names=["model"])


def classify(docs: DataFrame, labels: DataFrame, per_class: int = 1500, names=("low_quality", "toxicity", "rejected"), model: Model | None = None) -> DataFrame:
    """docs with both scores, rounded to six digits, and whether the document is rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels, per_class))
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for b in words.seen(batches):
            s = held.value.scores(encoder, b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.round(s[:, 0], 6)), pa.array(np.round(s[:, 1], 6)), pa.array((s >= 0.5).any(1))], names=[*b.schema.names, *names])

    more = [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema, *more]))


def scores(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> DataFrame:
    """(doc_id, low_quality, toxicity, rejected) of every document."""
    return classify(docs.select("doc_id", "text"), labels, per_class).drop("text")


def accepted(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> DataFrame:
    """The documents that aren't rejected, with the columns of docs. Null texts say nothing and stay."""
    names = fresh(docs, "low", "tox", "rejected")
    return classify(docs, labels, per_class, names).filter(~F.col(names[2]) | F.col("text").isNull()).drop(*names)
