"""Vectorised splitting of Arrow string columns.

Every Python-side operator here reads whole batches of texts and works on the
*distinct* words of a batch: the batch's UTF-8 buffer is cut with numpy, the
pieces are dictionary-encoded by Arrow, and only the dictionary is visited from
Python.  Memory is bounded by ``SLICE_BYTES`` plus the longest single text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Texts are worked on in slices of about this many bytes.
SLICE_BYTES = 6_000_000

_ALPHA = np.zeros(256, bool)
_ALPHA[ord("a"):ord("z") + 1] = _ALPHA[ord("A"):ord("Z") + 1] = True
_ALPHA[128:] = True
#: Letters of ASCII, or any byte of a longer character.
ALPHA = _ALPHA
ALNUM = _ALPHA.copy()
ALNUM[ord("0"):ord("9") + 1] = True
#: Lower-cases ASCII, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a string or binary array; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if large else np.int32
    off = np.frombuffer(col.buffers()[1], kind)[col.offset:col.offset + n + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def as_array(raw: np.ndarray, off: np.ndarray) -> pa.LargeBinaryArray:
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(np.ascontiguousarray(raw))]
    )


def slices(batch: pa.RecordBatch, name: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in row slices whose ``name`` column holds about ``size`` bytes each."""
    _, off = buffers(batch.column(name))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def tidy(fn):
    """The same Arrow function, which at a task's end gives freed memory back: Python workers live on
    from stage to stage."""

    def run(batches):
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        try:
            import ctypes

            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return run


class Coded:
    """Distinct pieces of a batch: ``codes`` of all pieces in order, ``ptr`` (documents + 1)
    into them, and ``pieces``, the distinct ones as bytes."""

    __slots__ = ("codes", "ptr", "pieces")

    def __init__(self, codes: np.ndarray, ptr: np.ndarray, pieces: list[bytes]):
        self.codes, self.ptr, self.pieces = codes, ptr, pieces

    def words(self) -> list[str]:
        return [x.decode("utf-8", "replace") for x in self.pieces]

    @property
    def docs(self) -> np.ndarray:
        """For each piece, the index of its document."""
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def pieces_of(values: pa.LargeBinaryArray) -> list[bytes]:
    """The values as bytes; several times faster than to_pylist()."""
    n = len(values)
    if not n:
        return []
    off = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + n + 1].tolist()
    data = values.buffers()[2]
    raw = data.to_pybytes() if data is not None else b""
    return [raw[i:j] for i, j in zip(off, off[1:])]


def _code(raw: np.ndarray, off: np.ndarray, ptr: np.ndarray) -> Coded:
    if len(off) < 2:
        return Coded(np.zeros(0, np.int64), ptr, [])
    coded = as_array(raw, off).dictionary_encode()
    return Coded(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), ptr, pieces_of(coded.dictionary))


def words(col: pa.Array, member: np.ndarray = ALPHA, lower: bool = True) -> Coded:
    """Maximal runs of ``member`` bytes, lower-cased in ASCII if asked for."""
    raw, off = buffers(col)
    if not len(raw):
        return Coded(np.zeros(0, np.int64), np.zeros(len(off), np.int64), [])
    edges = _edges(raw, off, member)
    starts, ends = edges[0::2], edges[1::2]
    kept = raw[member[raw]]
    if lower:
        kept = LOWER[kept]
    lengths = ends - starts
    ptr = np.searchsorted(starts, off)
    return _code(kept, np.concatenate([[0], np.cumsum(lengths)]), ptr)


class Hashed:
    """Pieces of a batch as 64-bit hashes: ``hashes`` of all pieces in order, and ``ptr`` (documents + 1) into them."""

    __slots__ = ("hashes", "ptr")

    def __init__(self, hashes: np.ndarray, ptr: np.ndarray):
        self.hashes, self.ptr = hashes, ptr

    @property
    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def _edges(raw: np.ndarray, off: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Starts and ends, in turn, of the maximal runs of ``member`` bytes; a document's bound ends a run."""
    inside = np.frombuffer(raw.tobytes().translate(member.tobytes()), bool)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edges = np.concatenate([[0] if inside[0] else [], edges, [len(raw)] if inside[-1] else []]).astype(np.int64)
    bounds = np.unique(off[(off > 0) & (off < len(raw))])
    bounds = np.repeat(bounds[inside[bounds] & inside[bounds - 1]], 2)
    return np.insert(edges, np.searchsorted(edges, bounds), bounds)


_STRETCH, _BASE = 1 << 16, 0x9E3779B97F4A7C55
_M64 = (1 << 64) - 1


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse modulo 2**64, for one stretch of bytes."""
    with np.errstate(over="ignore"):
        return tuple(np.append(np.uint64(1), np.full(_STRETCH - 1, b, np.uint64)).cumprod() for b in (_BASE, pow(_BASE, -1, 1 << 64)))


@cache
def _byte_values(lower: bool) -> np.ndarray:
    v = mix64(np.arange(1, 257, dtype=np.uint64), 31)
    return v[LOWER] if lower else v


def hashed_words(col: pa.Array, member: np.ndarray = ALPHA, lower: bool = True) -> Hashed:
    """Like :func:`words`, but hashes of all words in place of the distinct ones: a polynomial of the bytes modulo
    2**64, from running sums of a stretch of bytes at a time, finally mixed."""
    raw, off = buffers(col)
    if not len(raw):
        return Hashed(np.zeros(0, np.uint64), np.zeros(len(off), np.int64))
    edges = _edges(raw, off, member)
    starts = edges[0::2]
    up, down = _powers()
    value = _byte_values(lower)
    sums = np.empty(len(edges), np.uint64)  # of the bytes before each edge
    run = np.zeros(_STRETCH + 1, np.uint64)
    jump, at = 1, np.searchsorted(edges, np.arange(0, len(raw) + _STRETCH + 1, _STRETCH))
    with np.errstate(over="ignore"):
        for k in range(-(-len(raw) // _STRETCH)):
            part = value[raw[k * _STRETCH:(k + 1) * _STRETCH]]
            part *= up[:len(part)]
            part *= np.uint64(jump)
            run[0] = run[_STRETCH] if k else 0
            np.cumsum(part, out=run[1:len(part) + 1])
            run[1:len(part) + 1] += run[0]
            # An edge at the very end of the texts belongs to the last stretch.
            to = at[k + 1] if (k + 1) * _STRETCH < len(raw) else len(edges)
            sums[at[k]:to] = run[edges[at[k]:to] - k * _STRETCH]
            jump = jump * pow(_BASE, _STRETCH, 1 << 64) & _M64
        h = sums[1::2] - sums[0::2]
        h *= down[starts % _STRETCH]
        back = pow(pow(_BASE, _STRETCH, 1 << 64), -1, 1 << 64)
        scale = np.array([pow(back, k, 1 << 64) for k in range(-(-len(raw) // _STRETCH))], np.uint64)
        h *= scale[starts // _STRETCH]
    return Hashed(mix64(h, 5), np.searchsorted(starts, off))


# Classes of bytes: 0 white space or control, 1 letter, 2 digit, 3 other sign, 4 apostrophe, 5 part of a longer character.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[:33] = 0
_CLASS[ord("a"):ord("z") + 1] = _CLASS[ord("A"):ord("Z") + 1] = 1
_CLASS[ord("0"):ord("9") + 1] = 2
_CLASS[ord("'")] = 4
_CLASS[128:] = 5
_CUT = np.zeros(64, bool)
for _p, _c in ((1, 2), (1, 3), (1, 4), (2, 1), (2, 3), (2, 4), (3, 1), (3, 2)):
    _CUT[_p * 8 + _c] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, 10]] = True


def units(col: pa.Array, whole: tuple[bytes, ...] = ()) -> Coded:
    """Contiguous pieces of the texts, cut only where a byte-level pre-tokeniser of the public
    50k vocabularies always has a boundary: at the documents' starts, before a space or newline
    that follows something other than white space, and between ASCII letters, digits and signs
    (an apostrophe may start a contraction, so nothing is cut after it).  Longer characters that
    might be white space are left uncut.  ``whole``: strings that no cut may divide."""
    raw, off = buffers(col)
    if not len(raw):
        return Coded(np.zeros(0, np.int64), np.zeros(len(off), np.int64), [])
    kind = _CLASS[raw]
    first = np.empty(len(raw), bool)
    first[0] = True
    first[1:] = _CUT[kind[:-1] * np.uint8(8) + kind[1:]]
    space = _SPACE[raw]
    space[1:] &= kind[:-1] > 0
    space[0] = False
    at = np.flatnonzero(space)
    far = at[kind[at - 1] == 5] if len(at) else at
    if len(far):
        p1, p2, p3 = raw[far - 1], raw[np.maximum(far - 2, 0)], raw[np.maximum(far - 3, 0)]
        space[far[((p2 == 0xC2) & ((p1 == 0xA0) | (p1 == 0x85))) | ((p3 >= 0xE1) & (p3 <= 0xE3))]] = False
    first |= space
    if whole:
        data = raw.tobytes()
        for mark in whole:
            i = data.find(mark)
            while i >= 0:
                first[i:i + len(mark) + 1] = False
                i = data.find(mark, i + 1)
    first[off[:-1][off[:-1] < len(raw)]] = True
    at = np.flatnonzero(first)
    return _code(raw, np.append(at, len(raw)), np.searchsorted(at, off))


def ragged_take(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[starts[i] : starts[i] + counts[i]] for each i, one after another."""
    total = int(counts.sum())
    kind = np.int32 if max(total, len(values)) < 2**31 else np.int64
    place = np.repeat((starts - (np.cumsum(counts) - counts)).astype(kind), counts)
    place += np.arange(total, dtype=kind)
    return values[place]


def crc_of_id(doc_id: int) -> int:
    """The unsigned crc32 of a document id written as text."""
    return zlib.crc32(str(doc_id).encode())


def held_out(ids: np.ndarray) -> np.ndarray:
    """Documents never learned from: crc32(doc_id as text) mod 5 is 0.  A null id (None) is held out."""
    return np.fromiter((x is None or crc_of_id(x) % 5 == 0 for x in ids), bool, len(ids))


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finalising mix of splitmix64; wraps silently."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hash_pieces(pieces: list[bytes]) -> np.ndarray:
    """64-bit hashes that are the same in every process."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(x) for x in pieces), np.uint64, len(pieces))
