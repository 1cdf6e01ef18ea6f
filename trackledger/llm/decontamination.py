"""Benchmark decontamination by spaced seeds.

Texts are lower-cased words (runs of ASCII letters, digits and non-ASCII characters).
A seed looks at some positions of a short span and ignores the others; the hashes of all
benchmark spans and of all document spans are joined, seed by seed.  Each hit fixes how an
item and a document would lie on each other, and that alignment is verified: it counts
when, in some window of ``WINDOW`` words (the whole item if shorter), at least
``MATCH`` of the words are equal.  Substituted words are thus tolerated.

The seeds in ``SEEDS`` hit every alignment of 10 to 16 words in which up to a fifth of the
words differ, wherever those lie (checked in the tests), so no overlap is missed.
Items under 10 words must occur unchanged; items without words match nothing.

The benchmark is held in blocks, each broadcast in turn to a pass over the documents.  Items
of the same words are one, and items of over ``PIECE_WORDS`` words are cut into pieces that
share all but one word of a window, so every window lies in a piece.  A block is filled with
whole pieces up to ``BLOCK_WORDS`` words, by sums that are counted before, and never holds
more (nor more than one piece that is larger).  With several blocks, what a pass finds or
keeps is written before the next block is made and the broadcast is given up, so memory is
bounded however large the benchmark is.  Documents are neither shuffled nor cut.

Null and empty texts match nothing.  Rows of one document id count as one document: its best
overlap with an item id is reported once, whatever row it is in.  An item whose id is null
takes part and is reported with a null id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackledger.llm import textops as T
from trackledger.llm.store import written

SEEDS = ((0, 1, 2, 5, 6), (0, 2, 3, 4, 5), (0, 1, 2, 7, 8))
SHORTEST_TOLERANT = 10
WINDOW = 16
MATCH = 0.8
BLOCK_WORDS = 2_000_000
PIECE_WORDS = 1 << 16
_HITS = 22  # bits of the table that screens positions before the exact look-up
_RESULT = "array<struct<item:int, doc_word:int, item_word:int, window:int, matched:int>>"


@dataclass
class Benchmark:
    """One block of items: word hashes one item after the other, and per seed the sorted span hashes."""

    words: np.ndarray
    bounds: np.ndarray
    seeds: list[tuple[tuple[int, ...], np.ndarray, np.ndarray, np.ndarray]]  # seed, hashes, positions, screen
    pieces: list[tuple[int, int, int]] = field(default_factory=list)  # of each piece: its item's two keys, and its first word


def spans(words: np.ndarray, seed: tuple[int, ...]) -> np.ndarray:
    """The seed's hash at every position where it fits."""
    n = max(0, len(words) - seed[-1])
    out = np.full(n, len(seed), dtype=np.uint64)
    for at in seed:
        out = (out ^ words[at : at + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def prepare(words: np.ndarray, bounds: np.ndarray) -> Benchmark:
    sizes = np.diff(bounds)
    shorter = sorted({int(n) for n in sizes if 0 < n < SHORTEST_TOLERANT})
    item = np.repeat(np.arange(len(sizes)), sizes)
    made = []
    for seed, wanted in [(s, sizes >= SHORTEST_TOLERANT) for s in SEEDS] + [(tuple(range(n)), sizes == n) for n in shorter]:
        hashes = spans(words, seed)
        at = np.arange(len(hashes))
        fits = (at + seed[-1] < bounds[item[at] + 1]) & wanted[item[at]]
        order = np.argsort(hashes[fits], kind="stable")
        hashes, at = hashes[fits][order], at[fits][order]
        screen = np.zeros(1 << _HITS, dtype=bool)
        screen[hashes >> np.uint64(64 - _HITS)] = True
        made.append((seed, hashes, at, screen))
    return Benchmark(words, bounds, made)


def alignments(bench: Benchmark, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Distinct (text, item, text position of the item's first word) that some seed hits."""
    found = []
    for seed, hashes, places, screen in bench.seeds:
        here = spans(words, seed)
        at = np.flatnonzero(screen[here >> np.uint64(64 - _HITS)])
        first = np.searchsorted(hashes, here[at], side="left")
        count = np.searchsorted(hashes, here[at], side="right") - first
        at, first, count = at[count > 0], first[count > 0], count[count > 0]
        text = T.text_of(bounds, at)
        fits = at + seed[-1] < bounds[text + 1]
        at, first, count, text = at[fits], first[fits], count[fits], text[fits]
        each = np.repeat(np.arange(len(at)), count)
        place = places[first[each] + np.arange(len(each)) - (np.cumsum(count) - count)[each]]
        item = T.text_of(bench.bounds, place)
        found.append(np.stack([text[each], item, at[each] - (place - bench.bounds[item])], axis=1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def verify(bench: Benchmark, words: np.ndarray, bounds: np.ndarray, text: int, item: int, at: int) -> tuple[int, int, int, int] | None:
    """(word of the text, word of the item, window, equal words) of the best window, if it is good enough."""
    first, last = bench.bounds[item], bench.bounds[item + 1]
    window = int(min(WINDOW, last - first))
    skip = max(0, int(bounds[text] - at))  # words of the item that lie before the text
    upto = min(int(last - first), int(bounds[text + 1] - at))
    if upto - skip < window:
        return None
    equal = bench.words[first + skip : first + upto] == words[at + skip : at + upto]
    sums = np.concatenate([[0], np.cumsum(equal)])
    sums = sums[window:] - sums[:-window]
    best = int(sums.argmax())
    least = window if window < SHORTEST_TOLERANT else int(np.ceil(MATCH * window - 1e-9))
    if sums[best] < least:
        return None
    return int(at + skip + best - bounds[text]), skip + best, window, int(sums[best])


def hashed_items(benchmark: DataFrame, id_column: str = "item_id", text: str = "text") -> DataFrame:
    """(id, words, a, b): the items that have words, with two keys of what they say."""

    def hashed(texts: pa.Array) -> pa.Array:
        parts = []
        for _, data, offsets in T.slices(texts):
            h, b = T.word_hashes(data, offsets, T.ALNUM, T.LOWER)
            parts.append(pa.ListArray.from_arrays(pa.array(b, pa.int32()), pa.array(h.view(np.int64))))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))

    items = benchmark.select(F.col(id_column).alias("id"), F.arrow_udf(hashed, "array<long>")(F.col(text)).alias("words")).where(F.size("words") > 0)
    return items.select("id", "words", F.xxhash64("words").alias("a"), F.xxhash64(F.lit(1), "words").alias("b"))


def blocks(items: DataFrame, most: int = BLOCK_WORDS, piece: int = PIECE_WORDS) -> Iterator[tuple[list, Benchmark]]:
    """The items of ``hashed_items`` as (the least id of each piece's item, prepared block), made one after the other.

    Pieces are dealt by hash into so many fine groups that none is over ``most`` words, or
    holds one piece alone; the groups' sums, a row each, tell which of them fill a block.
    """
    one = items.groupBy("a", "b").agg(F.min("id").alias("id"), F.first("words").alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - WINDOW, F.lit(0)), F.lit(max(1, piece - WINDOW + 1)))
    pieces = one.select("a", "b", "id", "words", F.explode(starts).alias("first")).withColumn("words", F.expr(f"slice(words, first + 1, {piece})"))
    groups = 16 * -(-(pieces.agg(F.sum(F.size("words"))).first()[0] or 0) // most)
    while True:
        at = F.pmod(F.xxhash64("a", "b", "first"), F.lit(max(1, groups)))
        sums = sorted(tuple(r) for r in pieces.groupBy(at.alias("at")).agg(F.sum(F.size("words")).alias("n"), F.count("*").alias("k")).collect())
        if all(n <= most or k == 1 for _, n, k in sums):
            break
        groups *= 2
    bounds, held = [], most + 1
    for g, n, _ in sums:
        if held + n > most:
            bounds.append(g)
            held = 0
        held += n
    for low, high in zip(bounds, [*bounds[1:], groups], strict=False):  # no bounds without items
        block = pieces.where(at.between(low, high - 1)).toArrow().combine_chunks()
        lists = block["words"].combine_chunks()
        cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
        bench = prepare(lists.flatten().to_numpy().view(np.uint64), cuts)
        bench.pieces = list(zip(*(block[c].to_pylist() for c in ("a", "b", "first")), strict=True))
        yield block["id"].to_pylist(), bench


def overlap_column(held: Broadcast, text: str = "text") -> Column:
    """Per text, the verified overlaps with the items of one block, the best window of each alignment."""

    def search(texts: pa.Array) -> pa.Array:
        bench, out = held.value, []
        for _, data, offsets in T.slices(texts):
            words, bounds = T.word_hashes(data, offsets, T.ALNUM, T.LOWER)
            rows: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
            for where, item, at in alignments(bench, words, bounds).tolist():
                if hit := verify(bench, words, bounds, where, item, at):
                    rows[where].append(dict(zip(("item", "doc_word", "item_word", "window", "matched"), (item, *hit), strict=True)))
            out += rows
        kind = pa.struct([(n, pa.int32()) for n in ("item", "doc_word", "item_word", "window", "matched")])
        return pa.array(out, pa.list_(kind))

    return F.arrow_udf(search, _RESULT)(F.col(text))


def overlapping(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", most: int = BLOCK_WORDS, piece: int = PIECE_WORDS) -> DataFrame:
    """(id, item_id, doc_word, item_word, window, matched): the best overlap of each document and item that overlap."""
    spark, out, context = docs.sparkSession, None, docs.sparkSession.sparkContext
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    items = written(hashed_items(benchmark), "items")
    for _, bench in blocks(items, most, piece):
        held = context.broadcast(bench)
        hits = docs.select(F.col(id_column), F.explode(overlap_column(held, text)).alias("_o"))
        names = spark.createDataFrame([(k, *own) for k, own in enumerate(bench.pieces)], "item int, a long, b long, first int")
        hits = hits.select(id_column, "_o.*").join(F.broadcast(names), "item").drop("item")  # one row per piece of a bounded block
        hits = written(hits.withColumn("item_word", F.col("item_word") + F.col("first")).drop("first"), "overlaps")
        held.destroy()
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return spark.createDataFrame([], f"{id_column} {docs.schema[id_column].dataType.simpleString()}, item_id {item_type}, doc_word int, item_word int, window int, matched int")
    best = F.struct(F.col("matched") / F.col("window"), "matched", -F.col("doc_word"), -F.col("item_word"), "window")
    best = out.groupBy(id_column, "a", "b").agg(F.max(best).alias("_b"))
    best = best.join(items.select("a", "b", F.col("id").alias("item_id")).distinct(), ["a", "b"])
    return best.select(id_column, "item_id", (-F.col("_b.col3")).alias("doc_word"), (-F.col("_b.col4")).alias("item_word"), "_b.window", "_b.matched")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", most: int = BLOCK_WORDS) -> DataFrame:
    """The documents that overlap with no item, all columns kept."""
    held = None
    for _, bench in blocks(written(hashed_items(benchmark), "items"), most):
        if held:
            docs = written(docs, "uncontaminated")
            held.destroy()
        held = docs.sparkSession.sparkContext.broadcast(bench)
        docs = docs.where(F.size(overlap_column(held, text)) == 0)
    return docs
