"""Vectorised helpers over Arrow string columns, shared by the corpus operators.

Texts stay in their Arrow buffers: words, n-grams and chunks are found and hashed
with numpy over the UTF-8 bytes, in slices of a few megabytes, so that memory does
not follow the size of a batch.  A single text is never cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
_R = 0x9E3779B97F4A7C15 | 1
_R_INVERSE = pow(_R, -1, 1 << 64)

#: Bytes that are upper-case ASCII letters become lower case; all others stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)
_NEXT = np.arange(1, 257, dtype=np.uint64)

#: Word bytes: everything but ASCII blanks (space, tab, newline, VT, FF, CR).
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Word bytes: ASCII letters and digits, and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; spreads every bit of its input."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(seed: int) -> np.uint64:
    return mix(np.array([seed & (2**64 - 1)], dtype=np.uint64))[0]


_STEP = 1 << 10


def _short(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(n: int, base: int = _R) -> np.ndarray:
    """The powers of the base up to n - 1, as products of two short tables."""
    return np.multiply.outer(_short(pow(base, _STEP, 1 << 64), n // _STEP + 1), _short(base, _STEP)).ravel()[:n]


def inverse_powers(at: np.ndarray) -> np.ndarray:
    """The base's inverse to the power of each place."""
    if not len(at):
        return np.zeros(0, dtype=np.uint64)
    far = _short(pow(_R_INVERSE, _STEP, 1 << 64), (int(at.max()) >> 10) + 1)
    return far[at >> 10] * _NEAR[at & (_STEP - 1)]


_NEAR = _short(_R_INVERSE, _STEP)


_LIBC = ctypes.CDLL(None)


def give_back() -> None:
    """Returns freed memory to the system, where the C library can: workers live long, and stages share them."""
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)
    pa.default_memory_pool().release_unused()


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about ``most`` bytes; nulls are empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
    give_back()


def prefix_sums(data: np.ndarray, fold: np.ndarray = SAME) -> np.ndarray:
    """Sums from which ``span_hashes`` takes the hash of any span of the bytes."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    terms = powers(len(data))
    terms *= _NEXT[fold][data]
    np.cumsum(terms, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span [start, end): equal bytes, equal hash."""
    h = (sums[end] - sums[start]) * inverse_powers(start)
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: Longer spans are hashed by a digest: sums modulo 2^64 have known collisions from 1,024 bytes on, whatever the base.
LONG = 64
ONE = np.uint64(0x9E3779B97F4A7C15)


def strong_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray = SAME) -> np.ndarray:
    """The hash of each span's folded bytes, by ``span_hashes`` up to ``LONG`` bytes, else by a digest."""
    hashes = span_hashes(prefix_sums(data, fold), start, end)
    long = np.flatnonzero(end - start > LONG)
    hashes[long] = digests(data, start[long], end[long], fold)
    return hashes


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray = SAME) -> np.ndarray:
    spans = zip(start.tolist(), end.tolist(), strict=True)
    return np.array([int.from_bytes(blake2b(fold[data[a:b]].tobytes(), digest_size=8).digest(), "little") for a, b in spans], dtype=np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, with zeros after the end."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))


def same_bytes(data: np.ndarray, size: np.ndarray, start: np.ndarray, other: np.ndarray, others: np.ndarray | None = None) -> np.ndarray:
    """Whether the ``size`` bytes from each start equal those from the other, of the bytes with the ``eights`` ``others`` if given; eight bytes a step."""
    eight = eights(data)
    second = eight if others is None else others
    same, left = np.ones(len(size), dtype=bool), np.flatnonzero(size > 0)
    at = 0
    while len(left):
        differ = eight[start[left] + at] ^ second[other[left] + at]
        over = np.maximum(0, 8 - (size[left] - at)).astype(np.uint64)
        same[left] &= differ << (np.uint64(8) * over) == 0
        at += 8
        left = left[same[left] & (size[left] > at)]
    return same


def span_classes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray = SAME, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each class, its first span, class of each span): spans are of one class exactly if their folded bytes are equal.

    ``hashes``: their ``strong_hashes``, if they are known.
    """
    data = data if fold is SAME else fold[data]
    hashes, size = strong_hashes(data, start, end) if hashes is None else hashes.copy(), end - start
    while True:
        names, first, kind = np.unique(hashes, return_index=True, return_inverse=True)
        like = first[kind]
        same = size == size[like]
        same &= same_bytes(data, np.where(same, size, 0), start, start[like])
        if same.all():
            return names, first, kind
        hashes[~same] = mix(hashes[~same] + ONE)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive hashes, in about log2(k) steps."""
    out, n = hashes, 1
    while n < k and len(out):
        step = min(n, k - n)
        out = mix(out[: max(0, len(out) - step)] * np.uint64(5) + out[step:] + ONE)
        n += step
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes; no run goes over the end of a text."""
    inside = word[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def text_of(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, at, side="right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, word: np.ndarray, fold: np.ndarray = SAME) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, bounds): the words of text i are those from bounds[i] to bounds[i + 1]."""
    start, end = word_spans(data, offsets, word)
    return strong_hashes(data, start, end, fold), np.searchsorted(start, offsets)


def distinct_in_groups(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (group, value) pairs, by group, then value."""
    order = np.lexsort((value, group))
    group, value = group[order], value[order]
    if not len(group):
        return group, value
    new = np.ones(len(group), dtype=bool)
    new[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
    return group[new], value[new]


def utf8_lengths(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each text."""
    first = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=first[1:])
    return first[offsets[1:]] - first[offsets[:-1]]
