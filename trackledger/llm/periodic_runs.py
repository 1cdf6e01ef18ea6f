"""Runs of words that repeat with a period, and texts without their repetitions.

The words of a text are numbered from 0.  A run is a stretch of them with smallest period
q (words q apart are identical) and at least ``max(LEAST, POWER * q)`` words that no
neighbouring word extends.  ``runs_column`` gives all runs of a text, and the text without
the words that some run contains after that run's first q words.

Most words are ruled out first.  In a run of length n and period q every word lies in a
k-gram that occurs again q words away, for any k up to n - q.  That is least for the
shortest run there may be, so with ``OVERLAP`` words a k-gram, words outside the k-grams
that a text repeats cannot be in a run.  What survives falls into segments, and no run
leaves its segment.

Each segment goes through the divide and conquer of Main and Lorentz: a run lies in one
half, or crosses the middle.  If at least one period of it lies right of the middle, then
the words agree with those q later from the middle on, and before it; the longest such
agreements are found for all q at once by Z-functions, in linear time.  The mirrored case
is the same on the reversed segment.  A stretch that ends with its half may go on, and is
found whole further up.

Null, empty and blank texts have no run and stay without words.  Repeated rows give equal
results.  Everything is decided within a text, so no row meets another; a text of n
surviving words costs about n log n steps and linear memory.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from trackledger.llm import textops as T

LEAST, POWER = 24, 3
#: Words that two periods of a run have in common at least: of all runs, the shortest one of the period at which LEAST and POWER meet.
OVERLAP = min(max(LEAST, POWER * q) - q for q in range(1, LEAST + 1))
SLICE = 1 << 21
RUNS = "struct<n_words:long, runs:array<struct<start:long, length:long, period:long>>, collapsed:string>"


def agreements(pattern: list[int], text: list[int], most: int, own: list[int] | None = None) -> list[int]:
    """How long ``pattern`` agrees with ``text`` from each of the places 0 to most - 1; ``own``: its agreements with itself."""
    out = [0] * most
    left = right = 0
    if own is None:  # the pattern against itself: the places before are known by then
        own = out
        out[0], first = len(text), 1
    else:
        first = 0
    n, m = len(text), len(pattern)
    for i in range(first, min(most, n)):
        k = min(right - i, own[i - left]) if i < right else 0
        while k < m and i + k < n and pattern[k] == text[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return out


def crossing(s: list[int], middle: int) -> list[tuple[int, int, int]]:
    """(start, length, period): stretches of s that go over the middle with one period or more right of it."""
    most = min(len(s) // POWER, len(s) - middle)
    if most < 1:
        return []
    after = s[middle:]
    on = agreements(after, after, most + 1)
    before = s[:middle][::-1]
    own = agreements(before, before, most)
    back = agreements(before, s[: middle + most][::-1], most, own)  # from the place ``most`` after the middle downwards
    found = []
    for p in range(1, most + 1):
        length = back[most - p] + p + on[p]
        if length >= LEAST and length >= POWER * p:
            found.append((middle - back[most - p], length, p))
    return found


def segment_runs(s: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence."""
    least: dict[tuple[int, int], int] = {}
    nodes = [(0, len(s))]
    while nodes:
        a, b = nodes.pop()
        if b - a < LEAST:
            continue
        middle = (a + b) // 2
        nodes += [(a, middle), (middle, b)]
        here = s[a:b]
        found = crossing(here, middle - a)
        found += [(b - a - start - length, length, p) for start, length, p in crossing(here[::-1], b - middle)]
        for start, length, p in found:
            start, end = a + start, a + start + length
            if (start == 0 or s[start - 1] != s[start - 1 + p]) and (end == len(s) or s[end] != s[end - p]):
                least[start, length] = min(p, least.get((start, length), p))  # multiples of a period have the same stretch
    return [(start, length, p) for (start, length), p in least.items()]


def segments(names: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words, each within a text, that lie in k-grams repeated in their text."""
    grams = T.gram_hashes(names, OVERLAP)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = np.flatnonzero(text[: len(grams)] == text[OVERLAP - 1 :]) if len(grams) else np.zeros(0, np.int64)
    keys = T.mix(grams[whole] + text[whole].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(keys, kind="stable")
    equal = keys[order][1:] == keys[order][:-1]
    repeated = np.zeros(len(whole), dtype=bool)
    repeated[order[1:][equal]] = repeated[order[:-1][equal]] = True
    at = whole[repeated]
    change = np.zeros(len(names) + 1, dtype=np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + OVERLAP, -1)
    inside = np.cumsum(change)[:-1] > 0
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | (text[1:] != text[:-1])
    closes[:-1] &= ~inside[1:] | (text[1:] != text[:-1])
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    enough = end - start >= LEAST
    return start[enough], end[enough]


def text_runs(names: np.ndarray, kind: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each text, its runs by start, then period; ``names`` are hashes of the words, ``kind`` exact numbers of them."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(bounds) - 1)]
    for start, end in zip(*segments(names, bounds), strict=True):
        text = int(np.searchsorted(bounds, start, side="right")) - 1
        base = int(start - bounds[text])
        out[text] += [(base + a, n, p) for a, n, p in segment_runs(kind[start:end].tolist())]
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def runs_column(text: Column) -> Column:
    """Each text's number of words, its runs, and its kept words joined by one space, as ``RUNS``."""

    def find(texts: pa.Array) -> pa.Array:
        n_words, sizes, runs, kept = [], [], [], []
        for _, data, offsets in T.slices(texts, SLICE):
            start, end = T.word_spans(data, offsets, T.NOT_BLANK)
            names, _, kind = T.span_classes(data, start, end)
            bounds = np.searchsorted(start, offsets)
            raw = data.tobytes()
            for k, found in enumerate(text_runs(names[kind], kind, bounds)):
                a, b = int(bounds[k]), int(bounds[k + 1])
                stays = np.ones(b - a, dtype=bool)
                for at, n, p in found:
                    stays[at + p : at + n] = False
                n_words.append(b - a), sizes.append(len(found)), runs.extend(found)
                own = np.flatnonzero(stays) + a
                kept.append(b" ".join([raw[i:j] for i, j in zip(start[own].tolist(), end[own].tolist(), strict=True)]).decode())
        figures = np.array(runs, dtype=np.int64).reshape(-1, 3)
        rows = pa.StructArray.from_arrays([pa.array(figures[:, k]) for k in range(3)], ["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), rows)
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), lists, pa.array(kept, pa.string())], ["n_words", "runs", "collapsed"])

    return F.arrow_udf(find, RUNS)(text)


def echoed_column(text: Column, key: Column) -> Column:
    """Texts of which every tenth, by the crc32 of its decimal key, ends in a repeated stretch of its own words.

    With h the crc32 and g = h // 10, texts of n words with h % 10 = 0 keep the words before a = g % n, and from
    there on repeat the p = 1 + (n - a) // (3 + g % 8) words from a.  All other texts, and those without a key, stay.
    """

    def echo(texts: pa.Array, keys: pa.Array) -> pa.Array:
        out = texts.to_pylist()
        for row, name in enumerate(keys.to_pylist()):
            h = zlib.crc32(name.encode()) if name is not None else 1
            if h % 10 or not out[row]:
                continue
            data = np.frombuffer(out[row].encode(), dtype=np.uint8)
            start, end = T.word_spans(data, np.array([0, len(data)]), T.NOT_BLANK)
            n, g = len(start), h // 10
            if not n:
                continue
            a = g % n
            at = np.arange(n)
            at[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
            raw = data.tobytes()
            words = [raw[i:j] for i, j in zip(start.tolist(), end.tolist(), strict=True)]
            out[row] = b" ".join([words[i] for i in at.tolist()]).decode()
        return pa.array(out, pa.string())

    return F.arrow_udf(echo, "string")(text, key.cast("string"))


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, compared exactly; of equals the one that starts first, then of the least period."""
    run = F.get(runs, 0)
    return F.reduce(runs, run, lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
