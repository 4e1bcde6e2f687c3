"""Array kernels over UTF-8 buffers: word and line spans, polynomial hashes, n-gram hashes.

Arrow string columns are read in place: bytes and offsets, no Python strings. Words are
maximal runs of bytes other than ASCII white space.
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK = 1 << 20  # bytes of text that arrays are built over at once
_P = 0x9E3779B97F4A7C15 | 1
_PI = pow(_P, -1, 1 << 64)


def byte_table(seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, o, d = col.buffers()
    offs = np.frombuffer(o, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(d, np.uint8) if d is not None and d.size else np.zeros(0, np.uint8)
    data = data[offs[0] : offs[-1]]
    return data, offs - offs[0]


def chunks(offs: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about size bytes, one row at least."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def text_chunks(col: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of each chunk of a string column."""
    data, offs = buffers(col)
    for lo, hi in chunks(offs, size):
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]


class Hasher:
    """Polynomial hashes mod 2^64 of byte ranges, from prefix sums; tables grow as needed."""

    def __init__(self, seed: int = 1):
        self.r = byte_table(seed)
        self.ws = np.zeros(256, bool)
        self.ws[[9, 10, 11, 12, 13, 32]] = True
        self.pw = self.inv = None

    def grow(self, n: int) -> None:
        if self.pw is None or len(self.pw) < n + 1:
            m = max(n + 1, 1 << 16)
            for name, base in (("pw", _P), ("inv", _PI)):
                a = np.full(m, base, np.uint64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=np.uint64))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums that ranges of the same bytes share."""
        self.grow(len(data))
        pref = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.r[data] * self.pw[: len(data)], out=pref[1:])
        return pref

    def ranges(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, pref: np.ndarray | None = None) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.uint64)
        pref = self.prefix(data) if pref is None else pref
        return mix((pref[ends] - pref[starts]) * self.inv[starts])

    def words(self, data: np.ndarray, offs: np.ndarray, non: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words, and for each row the index of its first word (one more at the end). non: where word bytes are, if not wherever white space isn't."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
        non = ~self.ws[data] if non is None else non
        s = non.copy()
        s[1:] &= ~non[:-1]
        cut = offs[(offs > 0) & (offs < n)]
        s[cut] = non[cut]
        e = non.copy()
        e[:-1] &= ~non[1:]
        e[cut - 1] = non[cut - 1]
        starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
        return starts, ends, np.searchsorted(starts, offs)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values from each place on, by doubling; the last k-1 places run over the end and mean nothing."""
    q = 0xD6E8FEB86659FD93
    out, done, cur, width = None, 0, h.copy(), 1
    left = k
    while left:
        if left & 1:
            if out is None:
                out = cur.copy()
            else:
                m = len(h) - done
                if m > 0:
                    out[:m] += cur[done:] * U(pow(q, done, 1 << 64))
            done += width
        left >>= 1
        if left:
            nxt = cur.copy()
            if len(h) > width:
                nxt[:-width] += cur[width:] * U(pow(q, width, 1 << 64))
            cur, width = nxt, width * 2
    return mix(out)


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Place of the first minimum of x[i:i+w] at each i; the last w-1 places look at what is left."""
    at, low, width = np.arange(len(x), dtype=np.int32), x, 1

    def join(shift: int):
        nonlocal at, low
        if len(x) > shift:
            less = low[shift:] < low[:-shift]
            at, old = at.copy(), at
            low, was = low.copy(), low
            np.copyto(at[:-shift], old[shift:], where=less)
            np.copyto(low[:-shift], was[shift:], where=less)

    while width * 2 <= w:
        join(width)
        width *= 2
    if width < w:
        join(w - width)
    return at


_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True


def letters(data: np.ndarray) -> np.ndarray:
    """Where letters and digits are: ASCII ones, the underscore and everything else but U+0080 to U+00BF, U+2000 to U+2BFF and U+3000 to U+303F."""
    non = _ALNUM[data]
    if len(data) and data.max() >= 128:
        for lead, least, most, size in ((0xC2, 0x80, 0xBF, 2), (0xE2, 0x80, 0xAF, 3), (0xE3, 0x80, 0x80, 3)):
            at = np.flatnonzero(data == lead)
            at = at[at + size <= len(data)]
            at = at[(data[at + 1] >= least) & (data[at + 1] <= most)]
            for k in range(size):
                non[at + k] = False
    return non


def lowered(col: pa.Array) -> pa.Array:
    """The column in lower case, every row with as many bytes as before: characters whose lower case has another length stay."""
    col = pc.fill_null(col, "")
    low = pc.utf8_lower(col)
    if pc.all(pc.equal(pc.binary_length(low), pc.binary_length(col))).as_py() is not False:
        return low
    same = pc.equal(pc.binary_length(low), pc.binary_length(col)).to_pylist()
    keep = lambda c: x if len((x := c.lower()).encode()) == len(c.encode()) else c
    return pa.array([a if ok else "".join(map(keep, b)) for a, b, ok in zip(low.to_pylist(), col.to_pylist(), same)], col.type)


def lowered_chunks(col: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As text_chunks(lowered(col)), with no more than a chunk in lower case at a time."""
    for lo, hi in chunks(buffers(col)[1], size):
        yield lo, hi, *buffers(lowered(col.slice(lo, hi - lo)))


def kept(key, make):
    """What make gives, kept in this worker process under key from task to task."""
    own = sys.modules.setdefault("_loomnet_worker", types.ModuleType("_loomnet_worker")).__dict__
    if key not in own:
        own[key] = make()
    return own[key]


def seen(batches) -> Iterator[pa.RecordBatch]:
    """Batches with rows. At their end the worker gives free memory back, since it lives on beside others of its executor."""
    for b in batches:
        if b.num_rows:
            yield b
    b = None
    trim()


def trim() -> None:
    """Gives memory that Arrow and the C library hold for later back to the system, where they can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not of glibc
        pass
