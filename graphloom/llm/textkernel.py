"""Vectorised text primitives on Arrow string columns.

A column of texts is seen as one byte array with offsets, so words, lines and their
64-bit hashes come out of a few numpy passes instead of a Python loop over words.
Work arrays are bounded: they hold a number for each word, not each byte, and
``slices`` cuts a batch so that one slice holds about ``SLICE`` bytes (or one text).
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK = 1 << 20
SLICE = 2 << 20

U64 = np.uint64
#: Where the two independent hashes of a span start from.
_SEEDS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Spans of more bytes are hashed one by one.
LONG = 64


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry mask that is true inside the given inclusive ranges."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Bytes of a word ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~byte_table((0x20, 0x20), (0x09, 0x0D))
#: Bytes of a word ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: digits, a-z and all of non-ASCII.
ALNUM = byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Consecutive document ranges of about ``limit`` bytes, one document at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, first)``: byte spans of all words, and where each document's words begin."""
    inside = table[data]
    opens, closes = inside.copy(), inside.copy()
    if len(inside):
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        cut = offsets[:-1][offsets[:-1] < offsets[1:]]
        opens[cut] = inside[cut]
        last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        closes[last] = inside[last]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``words``, for the ``\\n``-split lines, empty ones included (a text of n breaks has n + 1)."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    per = np.searchsorted(breaks, offsets)
    return starts, ends, per + np.arange(len(offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9FB21C651E98DF25)
    x = x ^ (x >> U64(29))
    x = x * U64(0xA24BAED4963EE407)
    return x ^ (x >> U64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of every span, by one of two independent seeds.

    Eight bytes at a time are scrambled into the state, so the order of blocks counts and spans
    of up to eight bytes with equal hashes and lengths are equal.  Longer spans may collide:
    where a wrong match would show, ``exact_ids`` or a cryptographic digest decides.
    """
    size = ends - starts
    out = mix(size.astype(U64) ^ U64(_SEEDS[which]))
    if not len(size):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    masks = np.concatenate([(U64(1) << (U64(8) * np.arange(8, dtype=U64))) - U64(1), [U64(2**64 - 1)]])
    at = np.flatnonzero((size > 0) & (size <= LONG))
    for k in range(0, LONG, 8):
        if not len(at):
            break
        left = size[at] - k
        out[at] = mix(out[at] ^ (lanes[starts[at] + k] & masks[np.minimum(left, 8)]))
        at = at[left > 8]
    view = memoryview(padded)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(view[int(starts[i]) : int(ends[i])], _SEEDS[which])
    return out


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the bytes of spans ``a[i]`` and ``b[i]`` are equal; work arrays of about ``BLOCK`` bytes (or one span)."""
    size = ends[a] - starts[a]
    out = size == ends[b] - starts[b]
    todo = np.flatnonzero(out & (size > 0))
    total = np.cumsum(size[todo])
    i = 0
    while i < len(todo):
        j = max(int(np.searchsorted(total, (total[i - 1] if i else 0) + BLOCK, "right")), i + 1)
        part = todo[i:j]
        n = size[part]
        begin = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(begin, n)
        equal = data[np.repeat(starts[a[part]], n) + step] == data[np.repeat(starts[b[part]], n) + step]
        out[part] = np.logical_and.reduceat(equal, begin)
        i = j
    return out


def exact_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray | None = None) -> np.ndarray:
    """Numbers of the spans: two are equal exactly if the bytes of the spans are (``keys``: their ``span_hashes``, if known)."""
    keys = span_hashes(data, starts, ends) if keys is None else keys
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    group = np.cumsum(new) - 1
    head = order[np.flatnonzero(new)][group] if len(keys) else order
    differs = ~same_spans(data, starts, ends, order, head)
    ids = np.empty(len(keys), np.int64)
    ids[order] = group
    if differs.any():  # different spans with one hash: number those groups by their bytes
        raw, known = data.tobytes(), {}
        for i in order[np.isin(group, group[differs])].tolist():
            ids[i] = len(keys) + known.setdefault(raw[int(starts[i]) : int(ends[i])], len(known))
    return ids


def ngram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all ``k`` consecutive entries, built by doubling; empty if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, done, block, size, left = None, 0, hashes, 1, k
    while left:
        if left & 1:
            piece = block[done : done + n]
            out = piece.copy() if out is None else mix(out * U64(0xC6BC279692B5C323) + piece)
            done += size
        left >>= 1
        if left:
            block = mix(block[: len(block) - size] * U64(0x8CB92BA72F3D8DD7) + (block[size:] ^ U64(size)))
            size *= 2
    return mix(out)


def doc_of(first: np.ndarray) -> np.ndarray:
    """The document of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def cover(n: int, starts: np.ndarray, k: int) -> np.ndarray:
    """Which of ``n`` positions lie in a span ``[s, s + k)`` of some start."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + k, n), -1)
    return np.cumsum(edge[:n]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def release() -> None:
    """Give freed memory back to the system; reused Python workers would else keep their peak."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
