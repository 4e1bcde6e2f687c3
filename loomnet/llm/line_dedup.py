"""Line dedup: two Bloom filters by hash range, then exact confirmation of suspected repeats.

1. One pass over the corpus turns every line that isn't blank into its hash, a 128-bit digest of its
   bytes and its place. A task folds the repeats that it sees itself: only the first of equal lines
   goes on to the filters, the others are suspected already, so that a hot line comes to its range
   once a task and not once an occurrence.
2. Hashes fall into ranges of about ``SEGMENT_LINES`` lines, as many as the corpus needs: nothing is
   collected or broadcast, and the filters grow with the cluster. Each range fills a filter of
   hashes seen once and one of hashes seen twice, and lets those pass that the second holds.
3. Only suspects are shuffled on, without text. Equal digests confirm a repeat, so that a false
   positive costs bytes and never a line. The first occurrence, by (doc_id, line number),
   stays; the others are cut from their documents.

Digests are BLAKE2b; two different lines among 10^12 share one with a chance of about 10^-15.

Defined results. A line is what stands between line feeds; lines of nothing but white space
are never repeats. A null text has no lines and stays null. Rows without a doc_id pass
unchanged and take no part. Rows that repeat a doc_id with the same text are one document:
each copy of the row loses the same lines. Different texts of a doc_id are documents of their own,
in order of a hash of the text. Extra columns pass through, whatever they are
called. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .common import fresh, id_text, written

SEGMENT_LINES = 1 << 16
BITS_PER_LINE = 16
HELD = 1 << 19  # lines that a task folds at once
LINES = "h long, d1 long, d2 long, doc_id long, mark long, line_no int, n int"
PLACES = "d1 long, d2 long, doc_id long, mark long, line_no int"

def _lines(hasher: words.Hasher, data: np.ndarray, offs: np.ndarray):
    """Row, number in its row, start and end of every line that isn't blank."""
    nl = np.flatnonzero(data == 10)
    starts = np.concatenate([offs[:-1], nl + 1])
    ends = np.concatenate([nl, offs[1:]])
    starts.sort()
    ends.sort()
    # each row has its line feeds + 1 lines; sorted starts and ends then pair up, empty rows included
    row = np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(nl, offs)) + 1)
    first = np.searchsorted(row, np.arange(len(offs) - 1))
    number = np.arange(len(row)) - first[row]
    dense = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~hasher.ws[data], out=dense[1:])
    full = dense[ends] > dense[starts]
    return row[full], number[full], starts[full], ends[full]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of LINES. n: 0 for a line that stands earlier in this part of the task, 1 for the only one of it there, 2 for the first of several."""
    hasher, held, size = words.Hasher(), [], 0

    def flush():
        h, d, ids, marks, number = (np.concatenate(x) for x in zip(*held))
        _, first, back, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        n = np.zeros(len(h), np.int32)
        n[first] = np.minimum(count, 2)
        d = d.view(np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), np.ascontiguousarray(d[:, 0]), np.ascontiguousarray(d[:, 1]), ids, marks, number, n)], names=["h", "d1", "d2", "doc_id", "mark", "line_no", "n"])

    for b in words.seen(batches):
        ids, marks = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
        for lo, _, data, offs in words.text_chunks(b.column(1)):
            row, number, s, e = _lines(hasher, data, offs)
            if not len(row):
                continue
            raw, digest = data.tobytes(), hashlib.blake2b
            d = np.frombuffer(b"".join([digest(raw[i:j], digest_size=16).digest() for i, j in zip(s.tolist(), e.tolist())]), np.uint64)
            held.append((hasher.ranges(data, s, e), d.reshape(-1, 2), ids[lo + row], marks[lo + row], number.astype(np.int32)))
            size += len(row)
            if size >= HELD:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _twice(h: np.ndarray, several: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes the filter of those seen twice holds, once all have gone through both filters. A hash of two rows has all its bits twice."""
    m = np.uint64(bits - 1)
    a, b = (h & m).astype(np.int64), ((h >> np.uint64(24)) & m).astype(np.int64)
    seen = np.minimum(np.bincount(a, minlength=bits) + np.bincount(b, minlength=bits) - (np.bincount(a[a == b], minlength=bits)), 2).astype(np.uint8)
    seen[a[several]] = 2
    seen[b[several]] = 2
    return (seen[a] == 2) & (seen[b] == 2)


def _suspected(bits: int):
    """Rows come sorted by range. A range holds a line once a task at most, however hot it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out():
            t = pa.Table.from_batches(held)
            t = t.take(np.flatnonzero(_twice(t["h"].to_numpy().view(np.uint64), t["n"].to_numpy() > 1, bits)))
            return [x.select(["d1", "d2", "doc_id", "mark", "line_no"]) for x in t.combine_chunks().to_batches()]

        for b in words.seen(batches):
            seg = b.column(0).to_numpy(zero_copy_only=False)
            cut = np.concatenate([[0], np.flatnonzero(seg[1:] != seg[:-1]) + 1, [len(seg)]])
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if held and held[-1].column(0)[0].as_py() != seg[i]:
                    yield from out()
                    held = []
                held.append(b.slice(i, j - i))
        if held:
            yield from out()

    return run


def repeats(docs: DataFrame, segment_lines: int = SEGMENT_LINES, bits_per_line: int = BITS_PER_LINE) -> DataFrame:
    """(doc_id, mark, line_no), mark being the hash of the text, of every line that stands earlier in the corpus too."""
    base = id_text(docs).filter("text is not null")
    lines = written(base.withColumn("mark", F.xxhash64("text")).mapInArrow(_hashed, LINES), "line-hashes")
    segments = max(1, -(-lines.count() // segment_lines))  # from the files' footers
    bits = 1 << max(6, (segment_lines * bits_per_line - 1).bit_length())
    ranged = lines.filter("n > 0").select(F.pmod(F.xxhash64("h"), F.lit(segments)).alias("seg"), "h", "d1", "d2", "doc_id", "mark", "line_no", "n")
    passed = ranged.repartition("seg").sortWithinPartitions("seg").mapInArrow(_suspected(bits), PLACES)
    suspects = written(passed.unionByName(lines.filter("n = 0").select("d1", "d2", "doc_id", "mark", "line_no")), "line-suspects")
    # partial aggregation folds hot lines before the shuffle; the join back is split by AQE where a line is hot
    at = F.struct("doc_id", "mark", "line_no")
    first = suspects.groupBy("d1", "d2").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    first = first.filter("first != last").select("d1", "d2", "first")
    return suspects.join(first, ["d1", "d2"]).filter(at != F.col("first")).select("doc_id", "mark", "line_no").distinct()


def _cut(schema: T.StructType, text: str, gone: str, count: str):
    names = schema.names
    at, gone_at = names.index(text), names.index(gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.seen(batches):
            texts, lists = b.column(at).to_pylist(), b.column(gone_at).to_pylist()
            n = np.zeros(len(texts), np.int32)
            for i, x in enumerate(lists):
                if x and texts[i] is not None:
                    drop = set(x)
                    texts[i] = "\n".join(t for k, t in enumerate(texts[i].split("\n")) if k not in drop)
                    n[i] = len(drop)
            cols = [pa.array(texts, b.schema.field(at).type) if k == at else c for k, c in enumerate(b.columns) if k != gone_at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n)], names=[*(x for x in names if x != gone), count])

    return run


def line_dedup(docs: DataFrame, count: str = "n_removed", **how) -> DataFrame:
    """docs with repeated lines cut from text, and how many each lost in the column count."""
    key, mark, gone = fresh(docs, "key", "mark", "gone")
    lists = repeats(docs, **how).groupBy(F.col("doc_id").alias(key), F.col("mark").alias(mark)).agg(F.collect_list("line_no").alias(gone))
    joined = docs.join(lists.hint("shuffle_hash"), (docs["doc_id"].cast("long") == F.col(key)) & (F.xxhash64(docs["text"].cast("string")) == F.col(mark)), "left").drop(key, mark)
    out = T.StructType([*(f for f in joined.schema if f.name != gone), T.StructField(count, T.IntegerType())])
    return joined.mapInArrow(_cut(joined.schema, next(c for c in docs.columns if c.lower() == "text"), gone, count), out)
