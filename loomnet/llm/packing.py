"""Best-fit packing of documents into training sequences by a grouping genetic algorithm.

Texts become token ids of a public vocabulary, and sequences hold at most ``capacity`` tokens. A
text longer than that is cut into full pieces, each a sequence of its own, and a rest; rests and
shorter texts are packed whole. Documents fall into blocks of about ``block_docs`` by hash, so that
work grows with the corpus and no step sees more than a block. Each block evolves on several
islands at once. A chromosome is a set of whole sequences: crossover injects well-filled sequences
of one parent into the other, drops those that hold an injected document twice, lets displaced
documents take the place of smaller ones where they fill a sequence better, and puts what is left
back by best fit. After each epoch every island's best solution moves to the next island of its
block; in the end the best of all islands stands. Fitness is the mean squared fill. The first
individual is best fit by decreasing size, so that no block ends worse than that.

Tokens are written once without a shuffle; evolution moves sizes only; in the end tokens go to
their block once, where sequences are put together.

Defined results. Null and empty texts have no tokens and stand in no sequence. Rows
without a doc_id are left out. Rows that repeat a doc_id with the same text are packed once;
different texts of a doc_id are documents of their own. Extra columns are ignored. The result
depends on the distinct documents alone, not on their order or partitions. An empty table gives no
sequences.
"""

from __future__ import annotations

import random
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import id_text, written
from .rans import Coder, vocabulary_path

STATE = "block long, island int, ids array<long>, marks array<long>, sizes array<int>, elite array<array<int>>"
STATE_ARROW = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("ids", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("elite", pa.list_(pa.list_(pa.int32())))])
OUT = "bin_id long, doc_ids array<long>, starts array<int>, lengths array<int>, n_tokens int, tokens array<int>"


def best_fit(items, sizes: list[int], capacity: int, bins: list[list[int]], room: list[int]) -> None:
    """Puts each item into the fullest bin that takes it, or a new one; changes bins and room."""
    free = sorted((r, k) for k, r in enumerate(room) if r)
    for i in items:
        s = sizes[i]
        at = bisect_left(free, (s, -1))
        if at < len(free):
            r, k = free.pop(at)
            bins[k].append(i)
        else:
            r, k = capacity, len(bins)
            bins.append([i])
            room.append(r)
        room[k] = r - s
        if r > s:
            insort(free, (r - s, k))


def fitness(bins: list[list[int]], room: list[int], capacity: int) -> float:
    return sum((1 - r / capacity) ** 2 for r in room) / len(bins) if bins else 0.0


def exchange(loose: list[int], sizes: list[int], bins: list[list[int]], room: list[int], most: int = 40) -> list[int]:
    """Loose documents take the place of smaller ones where they fill a sequence better; what is loose then. Looks at the sequences with least room first."""
    free = sorted((sizes[i], i) for i in loose)
    for k in sorted((k for k, r in enumerate(room) if r), key=lambda k: (room[k], k))[:most]:
        best = None
        for at, i in enumerate(bins[k]):
            j = bisect_right(free, (sizes[i] + room[k], 1 << 62)) - 1
            if j >= 0 and free[j][0] > sizes[i] and (best is None or free[j][0] - sizes[i] > best[0]):
                best = (free[j][0] - sizes[i], at, j)
        if best:
            gain, at, j = best
            (_, new), old = free.pop(j), bins[k][at]
            bins[k][at] = new
            room[k] -= gain
            insort(free, (sizes[old], old))
    return [i for _, i in free]


def crossover(a, b, sizes, capacity, rng: random.Random):
    """Well-filled bins of b, whole, into a; bins of a that share a document go, and what they displace is put back by best fit."""
    (abins, aroom), (bbins, broom) = a, b
    pick = sorted(rng.sample(range(len(bbins)), max(1, len(bbins) // 3)), key=broom.__getitem__)[: max(1, len(bbins) // 8)]
    held = {i for k in pick for i in bbins[k]}
    keep = [k for k, x in enumerate(abins) if held.isdisjoint(x)]
    out = [list(bbins[k]) for k in pick] + [list(abins[k]) for k in keep]
    room = [broom[k] for k in pick] + [aroom[k] for k in keep]
    kept = set(keep)
    loose = [i for k, x in enumerate(abins) if k not in kept for i in x if i not in held]
    best_fit(sorted(exchange(loose, sizes, out, room), key=lambda i: (-sizes[i], i)), sizes, capacity, out, room)
    return out, room


def mutate(s, sizes, capacity, rng: random.Random):
    """Empties the least filled bins and a few others, and puts their documents back by best fit."""
    bins, room = s
    order = sorted(range(len(bins)), key=lambda k: (-room[k], k))
    gone = set(order[: max(1, len(bins) // 50)]) | set(rng.sample(range(len(bins)), max(1, len(bins) // 50)))
    out, left = [list(x) for k, x in enumerate(bins) if k not in gone], [r for k, r in enumerate(room) if k not in gone]
    loose = [i for k in sorted(gone) for i in bins[k]]
    rng.shuffle(loose)
    best_fit(sorted(exchange(loose, sizes, out, left), key=lambda i: -sizes[i]), sizes, capacity, out, left)
    return out, left


def _solution(genes: list[int], sizes: list[int], capacity: int):
    bins: list[list[int]] = [[] for _ in range(max(genes, default=-1) + 1)]
    for i, k in enumerate(genes):
        bins[k].append(i)
    return bins, [capacity - sum(sizes[i] for i in x) for x in bins]


def _genes(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, x in enumerate(bins):
        for i in x:
            out[i] = k
    return out


def evolve(sizes: list[int], capacity: int, elite: list[list[int]], seed: int, population: int, generations: int) -> list[int]:
    """The best solution of one island after its generations, as the bin of each item."""
    if not sizes:
        return []
    rng, n = random.Random(seed), len(sizes)
    down = sorted(range(n), key=lambda i: (-sizes[i], i))
    people = [_solution(g, sizes, capacity) for g in elite]
    while len(people) < population:
        order = down if not people else sorted(down, key=lambda i: -sizes[i] * rng.uniform(0.8, 1.0))
        bins, room = [], []
        best_fit(order, sizes, capacity, bins, room)
        people.append((bins, room))
    ranked = sorted(((fitness(*p, capacity), k, p) for k, p in enumerate(people)), key=lambda x: (-x[0], x[1]))
    number = len(ranked)
    for _ in range(generations):
        for _ in range(2):
            a, b = (min(rng.sample(range(len(ranked)), 2)) for _ in range(2))
            child = crossover(ranked[a][2], ranked[b][2], sizes, capacity, rng)
            if rng.random() < 0.5:
                child = mutate(child, sizes, capacity, rng)
            ranked.append((fitness(*child, capacity), number, child))
            number += 1
        ranked.sort(key=lambda x: (-x[0], x[1]))
        del ranked[population:]
    return _genes(ranked[0][2][0], n)


def _rests(sizes: list[int], capacity: int) -> list[int]:
    return [r for s in sizes if (r := s % capacity)]


def _island(capacity: int, population: int, generations: int, epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                genes = evolve(_rests(r["sizes"], capacity), capacity, r["elite"], hash((r["block"], r["island"], epoch)), population, generations)
                rows.append(r | {"elite": [genes]})
            yield pa.RecordBatch.from_pylist(rows, b.schema)

    return run


def _groups(batches) -> Iterator[list[dict]]:
    """Rows come sorted by block: the islands of each."""
    own: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if own and own[0]["block"] != r["block"]:
                yield own
                own = []
            own.append(r)
    if own:
        yield own


def _migrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for own in _groups(batches):
        yield pa.RecordBatch.from_pylist([r | {"elite": r["elite"] + own[k - 1]["elite"] * (len(own) > 1)} for k, r in enumerate(own)], STATE_ARROW)


def _tokenise(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = words.kept(("coder", path), lambda: Coder(path))
        for b in words.seen(batches):
            out = [coder.encode(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) // np.dtype(coder.kind).itemsize for x in out], pa.int32()), pa.array(out, pa.binary())], names=["doc_id", "mark", "n", "ids"])

    return run


def _layout(own: list[dict], capacity: int) -> list[tuple[list, list, list]]:
    """Places in the block's lists, starts and lengths of each sequence of the best island."""
    sizes = own[0]["sizes"]
    rest = [k for k, s in enumerate(sizes) if s % capacity]
    small = _rests(sizes, capacity)
    bins, _ = max((_solution(r["elite"][0], small, capacity) for r in own), key=lambda s: fitness(*s, capacity))
    rows = [([rest[i] for i in x], [sizes[rest[i]] - small[i] for i in x], [small[i] for i in x]) for x in bins]
    return rows + [([k], [at], [capacity]) for k, s in enumerate(sizes) for at in range(0, s - capacity + 1, capacity)]


def _emit(capacity: int, kind, most: int = 1 << 20):
    """Rows come sorted by block and kind: the islands of a block, then its documents with their tokens."""

    def put(own: list[dict], tokens: dict):
        ids, marks, block = own[0]["ids"], own[0]["marks"], own[0]["block"]
        rows = _layout(own, capacity)
        per = max(1, most // capacity)
        for lo in range(0, len(rows), per):
            part = rows[lo : lo + per]
            flat = [np.frombuffer(tokens[ids[k], marks[k]], kind)[a : a + n].astype(np.int32) for x in part for k, a, n in zip(*x)]
            size = [sum(x[2]) for x in part]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(block << 24) + lo + k for k in range(len(part))], pa.int64()), pa.array([[ids[k] for k in x[0]] for x in part], pa.list_(pa.int64())), *(pa.array([x[j] for x in part], pa.list_(pa.int32())) for j in (1, 2)), pa.array(size, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(np.concatenate(flat))),
                ],
                names=["bin_id", "doc_ids", "starts", "lengths", "n_tokens", "tokens"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[dict] = []
        tokens: dict = {}
        for b in words.seen(batches):
            for block, sort, doc, mark, ids, state in zip(*(c.to_pylist() for c in b.columns)):
                if own and own[0]["block"] != block:
                    yield from put(own, tokens)
                    own, tokens = [], {}
                if not sort:
                    own.append(state | {"block": block})
                else:
                    tokens.setdefault((doc, mark), ids)
        if own:
            yield from put(own, tokens)

    return run


def pack(docs: DataFrame, capacity: int = 2048, block_docs: int = 2000, islands: int = 3, epochs: int = 2, population: int = 6, generations: int = 8, path: str | None = None) -> DataFrame:
    """One row a sequence: its documents, the first token and number of tokens of each, and the token ids."""
    path = path or vocabulary_path()
    base = id_text(docs).filter("text is not null").select("doc_id", F.xxhash64("text").alias("mark"), "text")
    tokens = written(base.mapInArrow(_tokenise(path), "doc_id long, mark long, n int, ids binary").filter("n > 0"), "packing-tokens")
    sizes = written(tokens.select("doc_id", "mark", "n").distinct(), "packing-sizes")
    blocks = max(1, round(sizes.count() / block_docs))  # from the files' footers
    block = F.pmod(F.xxhash64("doc_id", "mark"), F.lit(blocks)).alias("block")
    rows = sizes.groupBy(block).agg(F.array_sort(F.collect_list(F.struct("doc_id", "mark", "n"))).alias("x"))
    rows = rows.select("block", F.explode(F.array(*map(F.lit, range(islands)))).alias("island"), F.col("x.doc_id").alias("ids"), F.col("x.mark").alias("marks"), F.col("x.n").alias("sizes"), F.array().cast("array<array<int>>").alias("elite"))
    for epoch in range(epochs):
        if epoch:
            rows = rows.repartition("block").sortWithinPartitions("block", "island").mapInArrow(_migrate, STATE)
        rows = rows.repartition("block", "island").mapInArrow(_island(capacity, population, generations, epoch), STATE)
    # written, so that a lost task of the last step evolves nothing again
    state = written(rows, "packing-islands").select("block", F.lit(0).alias("sort"), F.col("island").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("mark"), F.lit(None).cast("binary").alias("ids"), F.struct("ids", "marks", "sizes", "elite").alias("state"))
    # a partition for about four blocks, however many there are
    parts = tokens.select(block, F.lit(1).alias("sort"), "doc_id", "mark", "ids").unionByName(state, allowMissingColumns=True)
    return parts.repartition(max(1, -(-blocks // 4)), "block").sortWithinPartitions("block", "sort", "doc_id", "mark").mapInArrow(_emit(capacity, words.kept(("kind", path), lambda: Coder(path).kind)), OUT)
