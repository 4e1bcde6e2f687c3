"""Token-ID output: byte-level BPE ids, coded by a static range asymmetric numeral system.

1. Texts become token ids with a public vocabulary; ids are written once to the shared folder.
2. One table of frequencies over the whole corpus, scaled to 2^``SCALE``, serves all blocks.
   Every id has a frequency of one at least, so that any text can be coded with it.
3. Documents are laid out in blocks of at most ``block_tokens`` tokens; one that doesn't fit goes on
   in the next block of its task, and starts says where in the document a piece begins. A block is coded on its
   own by ``LANES`` interleaved coders, token i by coder i mod LANES, 32 bits at a time into
   one stream. Every ``every`` steps a checkpoint holds the place in the stream and the states
   of all coders, so that the parts between checkpoints decode in parallel. A CRC-32 of the
   ids guards each block.
4. One more row, with block_id -1, has the table of frequencies; blocks name it by table_id, and
   carry their step between checkpoints. With the vocabulary, the rows are all that decoding needs.

Defined results. A null or empty text has no tokens, and is listed in its block with length 0.
Rows without a doc_id are left out. Repeated rows are coded as often as they stand there.
Special tokens in texts are ordinary text. Extra columns are ignored. An empty table gives no
blocks. Which documents share a block follows the files' partitions; decoding doesn't depend on it.
"""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import id_text, written

VOCABULARY = "byte_bpe_50k.tiktoken"
SCALE = 22
LANES = 256
LOW = np.uint64(1 << 31)
OUT = "block_id long, doc_ids array<long>, starts array<int>, lengths array<int>, n_tokens int, lanes int, words binary, states binary, checkpoint_at array<int>, checkpoint_states binary, crc32 long, every int, table_id string"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public vocabulary files are: LOOMNET_TOKENIZERS, or the installed public_tokenizers."""
    return os.path.join(os.environ.get("LOOMNET_TOKENIZERS", "/opt/tokenizers"), name)


PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Coder:
    """Byte-level BPE of a vocabulary file of ranks."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.coder = tiktoken.Encoding("loomnet", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32

    def encode(self, text: str) -> bytes:
        """Ids of a text, as bytes of kind. There are no special tokens; encode_to_numpy would look for them at every character."""
        return np.fromiter(self.coder.encode_ordinary(text), self.kind).tobytes()

    def decode(self, ids) -> str:
        return self.coder.decode(list(map(int, ids)), errors="strict")


def _tokenise(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = words.kept(("coder", path), lambda: Coder(path))
        for b in words.seen(batches):
            out = [coder.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "ids"])

    return run


def _count(kind, vocab: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(vocab, np.int64)
        for b in words.seen(batches):
            for x in b.column(0).to_pylist():
                n += np.bincount(np.frombuffer(x, kind), minlength=vocab) if len(x) > 4 * vocab else 0
            few = b"".join(x for x in b.column(0).to_pylist() if len(x) <= 4 * vocab)
            n += np.bincount(np.frombuffer(few, kind), minlength=vocab)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["id", "n"])

    return run


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2^SCALE, one at least for each id."""
    total, size = int(counts.sum()), len(counts)
    free = (1 << SCALE) - size
    f = np.ones(size, np.int64)
    if total:
        f += (counts.astype(object) * free // total).astype(np.int64)
    f[int(np.argmax(f))] += (1 << SCALE) - int(f.sum())
    return f


def encode_block(ids: np.ndarray, freq: np.ndarray, start: np.ndarray, every: int = 256, lanes: int = LANES):
    """(words, final states, [(words before), ...], states at them) of one block. Coding runs from the last token to the first, so that decoding runs forward."""
    n = len(ids)
    steps = -(-n // lanes)
    x = np.full(lanes, LOW, np.uint64)
    out, marks, held, total = [], [], [], 0
    f_all, s_all = freq[ids].astype(np.uint64), start[ids].astype(np.uint64)
    for step in range(steps - 1, -1, -1):
        lo, hi = step * lanes, min((step + 1) * lanes, n)
        f, s, y = f_all[lo:hi], s_all[lo:hi], x[: hi - lo]
        over = y >= (f << np.uint64(63 - SCALE))
        if over.any():
            w = y[over]
            out.append((w & np.uint64(0xFFFFFFFF)).astype(np.uint32)[::-1])
            total += len(w)
            y = np.where(over, y >> np.uint64(32), y)
        q = y // f
        x[: hi - lo] = (q << np.uint64(SCALE)) + (y - q * f) + s
        if step and step % every == 0:
            marks.append(total)
            held.append(x.copy())
    stream = np.concatenate(out)[::-1] if out else np.zeros(0, np.uint32)
    # places count from the start of the reversed stream
    return stream, x, [total - m for m in marks[::-1]], held[::-1]


def decode_part(stream: np.ndarray, states: np.ndarray, n: int, freq: np.ndarray, start: np.ndarray, symbol: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """n tokens from the given states on, whose words begin at stream[0]."""
    x, at, out = states.copy(), 0, np.empty(n, np.int64)
    mask = np.uint64((1 << SCALE) - 1)
    for lo in range(0, n, lanes):
        hi = min(lo + lanes, n)
        y = x[: hi - lo]
        slot = y & mask
        t = symbol[slot.astype(np.int64)]
        out[lo:hi] = t
        y = freq[t].astype(np.uint64) * (y >> np.uint64(SCALE)) + slot - start[t].astype(np.uint64)
        need = np.flatnonzero(y < LOW)
        if len(need):
            y[need] = (y[need] << np.uint64(32)) | stream[at : at + len(need)].astype(np.uint64)
            at += len(need)
        x[: hi - lo] = y
    return out


def symbols(freq: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(freq), dtype=np.int32), freq)


def table_id(freq: np.ndarray) -> str:
    return hashlib.sha256(freq.astype("<u4").tobytes()).hexdigest()


def table_of(row) -> np.ndarray:
    """Frequencies of a table's row."""
    return np.frombuffer(zlib.decompress(row["freq"]), "<u4").astype(np.int64)


def decode_block(row, freq: np.ndarray, every: int | None = None) -> np.ndarray:
    """Tokens of a block, part by part from its checkpoints, checked against its CRC-32."""
    every = every or row["every"]
    start, symbol, lanes = np.cumsum(freq) - freq, symbols(freq), row["lanes"]
    stream = np.frombuffer(row["words"], np.uint32)
    marks = [0, *row["checkpoint_at"]]
    states = [np.frombuffer(row["states"], np.uint64), *np.frombuffer(row["checkpoint_states"], np.uint64).reshape(-1, lanes)]
    out = []
    for k, (at, s) in enumerate(zip(marks, states)):
        lo = k * every * lanes
        hi = row["n_tokens"] if k == len(marks) - 1 else (k + 1) * every * lanes
        out.append(decode_part(stream[at:], s, hi - lo, freq, start, symbol, lanes))
    ids = np.concatenate(out) if out else np.zeros(0, np.int64)
    if zlib.crc32(ids.astype("<u4").tobytes()) != row["crc32"]:
        raise ValueError(f"block {row['block_id']} is damaged")
    return ids


def _blocks(held, kind, block_tokens: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        freq = held.value
        start = np.cumsum(freq) - freq
        name = table_id(freq)
        task, number, docs, starts, parts, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush():
            ids = np.concatenate(parts)
            stream, states, marks, at = encode_block(ids, freq, start, every)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(task << 32) + number], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([starts], pa.list_(pa.int32())), pa.array([[len(p) for p in parts]], pa.list_(pa.int32())), pa.array([len(ids)], pa.int32()), pa.array([LANES], pa.int32()),
                    pa.array([stream.tobytes()], pa.binary()), pa.array([states.tobytes()], pa.binary()), pa.array([marks], pa.list_(pa.int32())), pa.array([b"".join(x.tobytes() for x in at)], pa.binary()), pa.array([zlib.crc32(ids.astype("<u4").tobytes())], pa.int64()),
                    pa.array([every], pa.int32()), pa.array([name]),
                ],
                names=["block_id", "doc_ids", "starts", "lengths", "n_tokens", "lanes", "words", "states", "checkpoint_at", "checkpoint_states", "crc32", "every", "table_id"],
            )

        for b in words.seen(batches):
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids, at = np.frombuffer(raw, kind), 0
                while True:
                    k = min(len(ids) - at, block_tokens - size)
                    docs.append(doc)
                    starts.append(at)
                    parts.append(ids[at : at + k])
                    size, at = size + k, at + k
                    if size >= block_tokens:
                        yield flush()
                        number, docs, starts, parts, size = number + 1, [], [], [], 0
                    if at >= len(ids):
                        break
        if docs:
            yield flush()

    return run


def encode(docs: DataFrame, path: str | None = None, block_tokens: int = 1 << 17, every: int = 256) -> tuple[DataFrame, np.ndarray]:
    """The blocks, and the frequencies that decode them."""
    path = path or vocabulary_path()
    with open(path, "rb") as f:
        vocab = sum(1 for x in f if x.strip())
    kind = np.uint16 if vocab <= 1 << 16 else np.uint32
    ids = written(id_text(docs).mapInArrow(_tokenise(path), "doc_id long, ids binary"), "token-ids")
    counts = np.zeros(vocab, np.int64)
    for r in ids.select("ids").mapInArrow(_count(kind, vocab), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # one row an id of the vocabulary
        counts[r["id"]] = r["n"]
    freq = frequencies(counts)
    held = docs.sparkSession.sparkContext.broadcast(freq)
    return ids.mapInArrow(_blocks(held, kind, block_tokens, every), OUT), freq


def token_blocks(docs: DataFrame, path: str | None = None, block_tokens: int = 1 << 17, every: int = 256) -> DataFrame:
    """The blocks and, where there are any, the row of their table."""
    blocks, freq = encode(docs, path, block_tokens, every)
    table = docs.sparkSession.createDataFrame([(-1, table_id(freq), bytearray(zlib.compress(freq.astype("<u4").tobytes())))], "block_id long, table_id string, freq binary")
    if id_text(docs).isEmpty():
        table = table.limit(0)
    return blocks.withColumn("freq", F.lit(None).cast("binary")).unionByName(table, allowMissingColumns=True)


def pieces(rows: DataFrame) -> DataFrame:
    """(block_id, doc_id, start, tokens) from the rows of token_blocks(), every block decoded and checked on its own."""
    tables = {r["table_id"]: table_of(r) for r in rows.filter("freq is not null").select("table_id", "freq").collect()}  # one row a corpus
    held = rows.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.seen(batches):
            for r in b.to_pylist():
                ids = decode_block(r, held.value[r["table_id"]]).astype(np.int32)
                at = np.cumsum([0, *r["lengths"]]).astype(np.int32)
                n = len(r["doc_ids"])
                yield pa.RecordBatch.from_arrays([pa.array([r["block_id"]] * n, pa.int64()), pa.array(r["doc_ids"], pa.int64()), pa.array(r["starts"], pa.int32()), pa.ListArray.from_arrays(pa.array(at), pa.array(ids))], names=["block_id", "doc_id", "start", "tokens"])

    return rows.filter("freq is null").drop("freq").mapInArrow(run, "block_id long, doc_id long, start int, tokens array<int>")
