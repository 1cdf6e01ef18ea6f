"""N-gram Jaccard self-join: near-duplicate links and their components.

A document's set holds the hashes of its distinct shingles of ``words`` words.  Two
documents link when ``100 * |A & B| >= percent * |A | B|``; ``WORDS`` and ``PERCENT`` are
those of the op9 query, other callers give their own.

The join is size-aware.  A link between sets of n and m shingles needs an overlap of
``c = ceil(percent * (n + m) / (100 + percent))``.

* Light sets, up to a boundary: every subset of exactly c shingles is enumerated, for
  each c that a partner's size allows; two sets that share such a subset are candidates.
* Heavy sets: the inverted lists of their rarest shingles are scanned.  Of n shingles
  ``n - ceil(percent * n / 100) + 1`` suffice, in one order for all sets, for two linked
  sets to meet in a list.  What is rare is told in two steps.  First by a table of fixed
  size, filled from all sets: how often shingles recur within a batch, summed by hash.  Of
  that order some more are taken than suffice (``SLACK``), enough that linked sets share
  several, and their lists are counted over the table; then those come first whose list
  holds one class only, and these need not be scanned.  The orders decide the length of
  the lists, never the links.
* The boundary is where the subsets to enumerate plus the lengths of the lists to scan
  are fewest, from the real sets and lists.

Copies of one text share one set hash and count as one class from the first step on.
Lists are split by ranges of sizes, of which linked sets have one in common.  Every list is
named by its smallest class, and the classes that share a name form a group.  A group is screened first: each set has a signature of parity bits, about as many
as it has shingles, and two sets differ in at least as many shingles as their signatures in
bits, so groups fall apart where no link is possible.  Overlaps are counted within what is left, by a breadth-first search
that compares the classes not yet reached with those reached.  Groups of more than ``GROUP`` classes are
split by size first (linked sets have the same size range or neighbouring ones), then cut
into blocks that all hold the group's smallest class.  A group of near copies is connected
by that already; what is still apart from a group's largest component is compared with all
of the group, block by block, so the work goes with the classes that are apart.

All decisions are exact (on 64-bit hashes of shingles); no list, group or text is cut.
Null, empty and blank texts have an empty set: they link with nothing.  A repeated
doc_id simply has several rows; rows with a null doc_id take part, but name a component
only if all ids in it are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackledger.llm import textops as T
from trackledger.llm.graph import components
from trackledger.llm.store import Membership, may_hold, may_hold_column, written

WORDS = 3
PERCENT = 90
#: Classes, and shingles of all of them, that are compared in one place; a larger set stands alone in its block.
GROUP, GROUP_SHINGLES = 128, 1 << 19
#: Fewest parity bits of a set, and about how many classes of a group are screened at once; larger groups are screened in blocks, each with each.
LEAST_BITS, SCREENED = 512, 4096
#: Largest size for which subsets may be enumerated at all.
MOST_LIGHT = 40
#: Bits of the table of how common shingles are, 8 MB; a shingle counts if so many sets of a batch have it.
COMMON_BITS, COMMON_FROM = 21, 3
#: So many more shingles are counted, as a share of those in which a set may differ from a linked one.
SLACK = 0.5
_COUNTED = 1 << 21  # shingles counted at once
_ONE = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text, its distinct shingle hashes in order."""
    hashes, bounds = T.word_hashes(data, offsets, T.NOT_BLANK, T.LOWER)
    rolled = np.zeros(max(0, len(hashes) - words + 1), dtype=np.uint64)
    for k in range(words):
        rolled = T.mix(rolled * np.uint64(5) + hashes[k : k + len(rolled)] + _ONE)
    for first, last in zip(bounds[:-1], bounds[1:], strict=True):
        if last - first >= words:
            yield np.unique(rolled[first : last - words + 1])
        elif last > first:
            whole = np.zeros(1, dtype=np.uint64)
            for k in range(first, last):
                whole = T.mix(whole * np.uint64(5) + hashes[k] + _ONE)
            yield T.mix(whole + np.uint64(last - first))
        else:
            yield hashes[:0]


def set_hash(s: np.ndarray) -> np.uint64:
    return T.mix(np.array([T.mix(s).sum(dtype=np.uint64) + np.uint64(len(s))]))[0]


class Plan:
    """Which keys a set gets, at a similarity and a boundary; ``common`` tells how common the shingles of a hash are."""

    def __init__(self, percent: int = PERCENT, boundary: int = 0, common: Broadcast | None = None):
        self.percent, self.boundary, self.common = percent, boundary, common
        self.reach = self.largest_partner(MOST_LIGHT)  # larger sets have no light partner

    def largest_partner(self, n: int) -> int:
        return n * 100 // self.percent

    def smallest_partner(self, n: int) -> int:
        return -(-n * self.percent // 100)

    def overlap(self, n: int, m: int) -> int:
        return -(-self.percent * (n + m) // (100 + self.percent))

    def subset_sizes(self, n: int, boundary: int) -> list[int]:
        """Sizes of the subsets to enumerate for n shingles: pairs whose smaller set is light."""
        sizes: set[int] = set()
        if self.smallest_partner(n) > boundary:
            return []
        for m in range(self.smallest_partner(n), self.largest_partner(n) + 1):
            c = self.overlap(n, m)
            if m and min(n, m) <= boundary and c <= min(n, m) and not c == n == m:
                sizes.add(c)
        return sorted(sizes)

    def enumerated(self, n: int, boundary: int) -> int:
        return sum(comb(n, c) for c in self.subset_sizes(n, boundary))

    def cheapest(self, sizes: dict[int, int], scanned: dict[int, int]) -> int:
        """The boundary of the least cost, for so many sets, and summed lengths of their lists, of each size up to ``reach``."""

        def cost(boundary: int) -> int:
            light = sum(k * self.enumerated(n, boundary) for n, k in sizes.items() if 0 < n <= self.reach)
            return light + sum(k for n, k in scanned.items() if n > boundary)

        return min(range(MOST_LIGHT + 1), key=cost)

    def subset_keys(self, s: np.ndarray) -> np.ndarray:
        n, out = len(s), []
        total = s.sum(dtype=np.uint64)
        for c in self.subset_sizes(n, self.boundary):
            left_out = _left_out(n, n - c)
            out.append(T.mix(total - s[left_out].sum(axis=1, dtype=np.uint64) + np.uint64(c * int(_ONE) % 2**64)))
        return np.concatenate(out) if out else s[:0]

    def _spare(self, n: int) -> int:
        """So many of the counted shingles two sets of n at least share, if linked; it never falls as n grows."""
        least = self.smallest_partner(n)
        return min(least, 1 + int(SLACK * (n - least)))

    def counted(self, s: np.ndarray) -> np.ndarray:
        """The rarest shingles of a set, rarest first, of which it shares ``_spare`` with a linked set."""
        n = len(s)
        if not n or self.overlap(n, n) == n and self.largest_partner(n) == n:
            return s[:0]  # only an equal set could be linked, and that is of the same class
        rank = self.common.value[s >> np.uint64(64 - COMMON_BITS)] if self.common else np.zeros(n)
        return s[np.argsort(rank, kind="stable")[: n - self.smallest_partner(n) + self._spare(n)]]

    def listed(self, s: np.ndarray, shared: np.ndarray | None = None) -> np.ndarray:
        """The shingles under which a set is listed: those with a list of their own come first, and are left out."""
        found = self.counted(s)
        if not len(found):
            return found
        enough = len(found) - self._spare(self.smallest_partner(len(s))) + 1
        if shared is None:
            return found[:enough]
        several = may_hold(shared, found)
        return found[several][: max(0, enough - int((~several).sum()))]


@lru_cache(maxsize=256)
def _left_out(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), dtype=np.int64).reshape(comb(n, k), k)


class _Recurring:
    """How often shingles that several of the sets have occur, by hash; some sets are counted at a time."""

    def __init__(self):
        self.sets, self.held = [], 0
        self.buckets, self.counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]

    def add(self, s: np.ndarray) -> None:
        self.sets.append(s)
        self.held += len(s)
        if self.held >= _COUNTED:
            self.count()

    def count(self) -> None:
        values, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.sets]), return_counts=True)
        often = n >= COMMON_FROM
        self.buckets.append((values[often] >> np.uint64(64 - COMMON_BITS)).astype(np.int32)), self.counts.append(n[often])
        self.sets, self.held = [], 0

    def rows(self) -> pa.Array:
        self.count()
        return pa.StructArray.from_arrays([pa.array(np.concatenate(self.buckets)), pa.array(np.concatenate(self.counts))], ["bucket", "n"])


def _lists(parts: list[np.ndarray]) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]) if parts else np.zeros(1)
    values = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def _sets(texts: pa.Array, words: int) -> Iterator[tuple[np.ndarray, int | None]]:
    """(set, class) of each text; the class of an empty set is None."""
    for _, data, offsets in T.slices(texts):
        for s in shingle_sets(data, offsets, words):
            yield s, int(set_hash(s).view(np.int64)) if len(s) else None


def document_sets(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = WORDS, reach: int = 0) -> DataFrame:
    """(id, n_shingles, class, bits, few, recurring) of each row.

    Equal sets have one class, empty sets a null one.  ``bits`` is the signature, ``few`` has the shingles of sets up to
    ``reach``; ``recurring`` is filled once per batch, with the shingles that recur in it.
    """

    def run(texts: pa.Array) -> pa.Array:
        n, names, bits, few, seen, counted = [], [], [], [], set(), _Recurring()
        for s, name in _sets(texts, words):
            bits.append(signature(s))
            n.append(len(s)), names.append(name), few.append(s if len(s) <= reach else s[:0])
            if name not in seen:
                counted.add(s)
            seen.add(name)
        recurring = counted.rows()
        ends = np.full(len(n) + 1, len(recurring), dtype=np.int32)
        ends[: max(1, len(n))] = 0
        lists = pa.ListArray.from_arrays(pa.array(ends), recurring)
        columns = [pa.array(n, pa.int64()), pa.array(names, pa.int64()), pa.array(bits, pa.binary()), _lists(few), lists]
        return pa.StructArray.from_arrays(columns, ["n_shingles", "class", "bits", "few", "recurring"])

    kind = "n_shingles long, class long, bits binary, few array<long>, recurring array<struct<bucket:int,n:long>>"
    return docs.select(F.col(id_column).alias("_id"), F.arrow_udf(run, kind)(F.col(text)).alias("_set")).select("_id", "_set.*")


def common_shingles(sets: DataFrame) -> Broadcast:
    """How common shingles are, by the first bits of their hash: a table of fixed size."""
    found = sets.select(F.explode("recurring").alias("r")).groupBy("r.bucket").agg(F.sum("r.n").alias("n")).toArrow()  # a row per bucket at most
    table = np.zeros(1 << COMMON_BITS, dtype=np.float32)
    table[found["bucket"].to_numpy()] = found["n"].to_numpy()
    del found
    T.give_back()
    return sets.sparkSession.sparkContext.broadcast(table)


def postings(docs: DataFrame, plan: Plan, shared: Membership | None, text: str = "text", words: int = WORDS) -> DataFrame:
    """(key, class, n): the inverted lists, those to count or, with the shared ones known, those to scan.

    Copies that meet in a batch are listed once.
    """
    table = shared.table if shared else None

    def listed(texts: pa.Array) -> pa.Array:
        names, sizes, keys, seen = [], [], [], set()
        for s, name in _sets(texts, words):
            names.append(name), sizes.append(len(s))
            keys.append(s[:0] if name in seen else plan.listed(s, table.value) if table else plan.counted(s))
            seen.add(name)
        return pa.StructArray.from_arrays([pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), _lists(keys)], ["class", "n", "keys"])

    found = docs.select(F.arrow_udf(listed, "class long, n int, keys array<long>")(F.col(text)).alias("_k"))
    return found.select(F.explode("_k.keys").alias("key"), F.col("_k.class").alias("class"), F.col("_k.n").alias("n"))


def subsets(sets: DataFrame, plan: Plan) -> DataFrame:
    """(key, class, n): the enumerated subsets of light sets and of their partners."""

    def enumerated(few: pa.Array) -> pa.Array:
        bounds = np.concatenate([[0], np.cumsum(few.value_lengths().to_numpy(zero_copy_only=False))])
        values = few.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        return _lists([plan.subset_keys(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])

    small = sets.where(F.size("few") > 0).groupBy("class").agg(F.first("few").alias("few"), F.first("n_shingles").cast("int").alias("n"))
    return small.select(F.explode(F.arrow_udf(enumerated, "array<long>")("few")).alias("key"), "class", "n")


def size_ranges(percent: int) -> Column:
    """The two size ranges that a set of ``n`` shingles is in: sizes of linked sets differ by less than one step, so they have one in common."""
    span = F.floor(F.log("n") / (log(100 / percent) * (1 + 1e-9) if percent < 100 else 1.0))
    return F.array(span, span + 1)


def list_names(listed: DataFrame) -> DataFrame:
    """(key, group, length) of each list of several classes; the smallest class names it."""
    found = listed.groupBy("key").agg(F.min("class").alias("group"), F.max("class").alias("_last"), F.count("*").alias("length"))
    return found.where(F.col("group") != F.col("_last")).drop("_last")


def candidate_groups(docs: DataFrame, sets: DataFrame, percent: int, text: str = "text", words: int = WORDS) -> DataFrame:
    """(class, group, n): classes that share a list or a subset, under its name."""
    plan = Plan(percent, common=common_shingles(sets))
    lists = postings(docs, plan, Membership(list_names(postings(docs, plan, None, text, words)), "key"), text, words)
    lists = written(lists, "postings")
    # A shingle that is common among all sets is so among those of one size range to a much lesser degree.
    lists = lists.withColumn("_range", F.explode(size_ranges(percent))).withColumn("key", F.xxhash64("key", "_range")).drop("_range")
    shared = written(lists.join(list_names(lists), "key").select("class", "group", "n", "length"), "shared")
    small = sets.where((F.col("n_shingles") > 0) & (F.col("n_shingles") <= plan.reach)).groupBy("n_shingles").agg(F.countDistinct("class").alias("k"))
    sizes = {r["n_shingles"]: r["k"] for r in small.collect()}  # one row per size up to the reach
    scanned = {r["n"]: r["k"] for r in shared.where(F.col("n") <= plan.reach).groupBy("n").agg(F.sum("length").alias("k")).collect()}
    plan.boundary = plan.cheapest(sizes, scanned)
    light = subsets(sets.where(F.col("n_shingles") <= plan.largest_partner(plan.boundary)), plan)
    light = light.join(list_names(light), "key").select("class", "group", "n")
    heavy = shared.where(F.col("n") > plan.boundary).select("class", "group", "n")
    return heavy.unionByName(light).distinct()


def signature(s: np.ndarray) -> bytes:
    """For each bucket, whether an odd number of the set's shingles is in it; as many buckets as the next power of two."""
    size = max(LEAST_BITS, 1 << max(0, len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).tobytes()


def _folded(bits: np.ndarray) -> np.ndarray:
    """Signatures of half the length, of the same sets."""
    half = bits.shape[-1] // 2
    return bits[..., :half] ^ bits[..., half:]


def possible_parts(sizes: np.ndarray, signatures: list[bytes], percent: int) -> np.ndarray:
    """Of each set the first set that it may be connected with."""
    part, alive = np.arange(len(sizes)), np.ones(len(sizes), dtype=bool)
    length = np.array([len(x) for x in signatures])
    of_length = {int(n): np.flatnonzero(length == n) for n in np.unique(length)}
    rows = {n: np.frombuffer(b"".join(signatures[k] for k in at), dtype=np.uint64).reshape(len(at), -1) for n, at in of_length.items()}
    shorter = {n: _folded(x) for n, x in rows.items()}
    for first in range(len(sizes)):
        queue = [first] if alive[first] else []
        alive[first] = False
        while queue:
            at = queue.pop()
            own = np.frombuffer(signatures[at], dtype=np.uint64)
            n = len(signatures[at])
            for other, sets in ((n // 2, rows), (n, rows), (n * 2, shorter)):  # sizes of linked sets differ by less than a factor of two
                if other not in sets:
                    continue
                left = np.flatnonzero(alive[of_length[other]])
                both = sizes[of_length[other][left]] + sizes[at]
                most = both - 2 * -(-percent * both // (100 + percent))  # shingles in which linked sets differ
                left = left[np.bitwise_count(sets[other][left] ^ (_folded(own) if other < n else own)).sum(axis=1, dtype=np.int64) <= most]
                hit = of_length[other][left]
                part[hit], alive[hit] = first, False
                queue += hit.tolist()
    return part


def _by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key; rows come sorted by key, and one may go over several batches."""
    held, now = [], None
    for batch in batches:
        keys = batch.column(key).to_numpy()
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for first, last in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if last == first:
                continue
            if held and keys[first] != now:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            now = keys[first]
            held.append(batch.slice(first, last - first))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _screened(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, "group"):
            part = possible_parts(rows["n"].to_numpy().astype(np.int64), rows["bits"].to_pylist(), percent)
            several = np.bincount(part)[part] > 1
            if several.any():
                names = rows["class"].to_numpy()[part]  # rows come by class: a part's smallest, so lists with the same part give it one name
                kept = pa.array(several)
                yield pa.RecordBatch.from_arrays([rows["class"].filter(kept).combine_chunks(), pa.array(names[several]), rows["n"].filter(kept).combine_chunks()], ["class", "group", "n"])

    return run


def screened(candidates: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(class, group, n): the groups, divided where no link between classes is possible."""
    if percent <= 50:  # signatures of linked sets might differ too much in length
        return candidates
    # Larger groups are dealt into blocks, and each two of these are screened together: signatures are much smaller than sets.
    blocks = F.when(F.col("_k") > SCREENED, F.ceil(F.col("_k") / F.lit(SCREENED / 2))).otherwise(1).cast("int")
    sizes = candidates.groupBy("group").agg(F.count("*").alias("_k")).select("group", blocks.alias("_blocks"))
    bits = sets.where(F.col("class").isNotNull()).groupBy("class").agg(F.first("bits").alias("bits"))
    own = _own_block(F.col("_blocks"))
    places = F.transform(_numbers(F.col("_blocks")), lambda j: F.xxhash64("group", F.least(own, j), F.greatest(own, j)))
    rows = candidates.join(sizes, "group").withColumn("group", F.explode(F.when(F.col("_blocks") > 1, places).otherwise(F.array("group"))))
    rows = rows.join(bits, "class").select("group", "class", "n", "bits").repartition("group").sortWithinPartitions("group", "class")
    return rows.mapInArrow(_screened(percent), "class long, group long, n int").distinct()


def class_sets(docs: DataFrame, wanted: Membership, text: str = "text", words: int = WORDS) -> DataFrame:
    """(class, shingles), one row for each class that the filter lets through."""
    table = wanted.table

    def fetch(texts: pa.Array) -> pa.Array:
        names, sets, seen = [], [], {None}
        for s, name in _sets(texts, words):
            hit = name not in seen and may_hold(table.value, np.array([name]).view(np.uint64))[0]
            seen.add(name)
            names.append(name if hit else None)
            sets.append(s if hit else s[:0])
        return pa.StructArray.from_arrays([pa.array(names, pa.int64()), _lists(sets)], ["class", "shingles"])

    found = docs.select(F.arrow_udf(fetch, "class long, shingles array<long>")(F.col(text)).alias("_s"))
    return found.select("_s.*").where(F.col("class").isNotNull()).dropDuplicates(["class"])


def linked_in_group(sizes: np.ndarray, shingles: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """A forest of links that connects exactly what all links among the sets connect.

    ``shingles`` holds the sets one after the other.  Each set that is reached is compared
    with those not reached yet, all at once, by marking its shingles.
    """
    _, code = np.unique(shingles, return_inverse=True)
    mark = np.zeros(int(code.max()) + 1 if len(code) else 0, dtype=np.int32)
    starts = np.cumsum(sizes) - sizes
    left = np.arange(len(sizes))  # not reached
    codes = code
    out, queue = [], []
    while len(left):
        if not queue:
            queue.append(left[0])
            codes, left = codes[sizes[left[0]] :], left[1:]
            continue
        at = queue.pop()
        own = code[starts[at] : starts[at] + sizes[at]]
        mark[own] = 1
        both = np.add.reduceat(mark[codes], np.cumsum(sizes[left]) - sizes[left])
        mark[own] = 0
        hit = 100 * both >= percent * (sizes[left] + sizes[at] - both)
        if hit.any():
            out += [(int(at), int(x)) for x in left[hit]]
            queue += left[hit].tolist()
            codes = codes[np.repeat(~hit, sizes[left])]
            left = left[~hit]
    return out


def _links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, "part"):
            names = rows["class"].to_numpy()
            lists = rows["shingles"].combine_chunks()
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            pairs = linked_in_group(sizes, lists.flatten().to_numpy(), percent)
            if pairs:
                a, b = np.array(pairs).T
                yield pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(names[b])], ["a", "b"])

    return run


def _blocks(classes: Column, shingles: Column, group: int) -> Column:
    """Into how many blocks so many classes with so many shingles in all are cut."""
    return F.greatest(F.ceil(classes / F.lit(group)), F.ceil(shingles / F.lit(GROUP_SHINGLES)), F.lit(1)).cast("int")


def _numbers(count: Column) -> Column:
    """0 to count - 1"""
    return F.filter(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda x: x < count)


def _own_block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("class"), blocks).cast("int")


def _compared(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links within each part of (part, class)."""
    rows = placed.join(sets, "class").select("part", "class", "shingles")
    return rows.repartition("part").sortWithinPartitions("part", "class").mapInArrow(_links(percent), "a long, b long")


def connected(candidates: DataFrame, sets: DataFrame, percent: int = PERCENT, group: int = GROUP) -> DataFrame:
    """(node, component): what the links between the classes of each group connect, as ``components`` gives it."""
    whole = (F.count("*").alias("_k"), F.sum("n").alias("_n"), F.min("class").alias("_least"))
    cut = _blocks(F.col("_k"), F.col("_n"), group)
    sizes = written(candidates.groupBy("group").agg(*whole).withColumn("_blocks", cut), "groups")
    one = candidates.join(sizes.where("_blocks = 1").select("group"), "group").select("class", F.col("group").alias("part"))
    if not sizes.where("_blocks > 1").head(1):
        return components(_compared(one, sets, percent))
    many = candidates.join(sizes.where("_blocks > 1").select("group"), "group").withColumn("_range", F.explode(size_ranges(percent)))
    many = many.select("class", "n", F.xxhash64("group", "_range").alias("group"))
    sizes = many.groupBy("group").agg(*whole).where("_k > 1").withColumn("_blocks", cut)
    many = written(many.join(sizes, "group"), "members")
    blocks = F.when(F.col("class") == F.col("_least"), _numbers(F.col("_blocks"))).otherwise(F.array(_own_block(F.col("_blocks"))))
    placed = many.select("class", "group", F.explode(blocks).alias("_at")).select("class", F.xxhash64("group", "_at").alias("part"))
    first = written(_compared(one.unionByName(placed), sets, percent), "links")
    parts = components(first)
    apart = _still_apart(many.where("_blocks > 1"), parts, group)
    return components(first.unionByName(_compared(apart, sets, percent))) if apart.head(1) else parts


def _still_apart(members: DataFrame, parts: DataFrame, group: int) -> DataFrame:
    """(class, part): parts that hold every pair of a group in different components, but for those within its largest."""
    parts = parts.select(F.col("node").alias("class"), "component")
    labelled = written(members.select("class", "n", "group").join(parts, "class", "left").withColumn("component", F.coalesce("component", "class")), "labelled")
    each = labelled.groupBy("group", "component").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    each = each.groupBy("group").agg(F.max(F.struct("k", "component", "n")).alias("top"), F.sum("k").alias("k"), F.sum("n").alias("n"), F.count("*").alias("c"))
    each = each.where("c > 1").select(
        "group", F.col("top.component").alias("_top"), _blocks(F.col("k") - F.col("top.k"), F.col("n") - F.col("top.n"), group).alias("_rest"), _blocks(F.col("top.k"), F.col("top.n"), group).alias("_most")
    )
    rows = labelled.join(each, "group")
    rest, most = _own_block(F.col("_rest")), _own_block(F.col("_most"))
    name = lambda kind, i, j: F.xxhash64("group", F.lit(kind), i, j)
    within = F.transform(_numbers(F.col("_rest")), lambda j: name(0, F.least(rest, j), F.greatest(rest, j)))
    across = F.transform(_numbers(F.col("_most")), lambda j: name(1, rest, j))
    to_rest = F.transform(_numbers(F.col("_rest")), lambda i: name(1, i, most))
    found = F.when(F.col("component") == F.col("_top"), to_rest).otherwise(F.concat(within, across))
    return written(rows.select("class", F.explode(found).alias("part")), "apart")


def named_components(docs: DataFrame, id_column: str, text: str, percent: int, group: int, words: int) -> DataFrame:
    """(_id, n_shingles, class, first, own) of each row: its component's smallest id, and which class has that id."""
    base = written(document_sets(docs, id_column, text, words, Plan(percent).reach), "sets")
    candidates = written(candidate_groups(docs, base, percent, text, words), "candidates")
    candidates = written(screened(candidates, base, percent), "screened")
    sets = written(class_sets(docs, Membership(candidates, "class"), text, words), "class_sets")
    parts = connected(candidates, sets, percent, group).select(F.col("node").alias("class"), F.col("component").alias("_c"))
    classes = base.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("_id").alias("_least"))
    classes = classes.join(parts, "class", "left").withColumn("_c", F.coalesce("_c", "class"))
    first = classes.groupBy("_c").agg(F.min(F.struct(F.col("_least").isNull().alias("none"), F.col("_least").alias("id"), "class")).alias("_first"))
    named = written(classes.join(first, "_c").select("class", F.col("_first.id").alias("first"), F.col("_first.class").alias("own")), "named")
    return base.select("_id", "n_shingles", "class").join(named, "class", "left")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = PERCENT, group: int = GROUP, words: int = WORDS) -> DataFrame:
    """(id, n_shingles, component_id) of each row: the smallest id reachable by links, itself included."""
    out = named_components(docs, id_column, text, percent, group, words)
    return out.select(F.col("_id").alias(id_column), "n_shingles", F.coalesce("first", "_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = PERCENT, group: int = GROUP, words: int = WORDS) -> DataFrame:
    """One document of each component, the one that names it, with all columns.

    A document is an id and a set: rows that share an id but not the text are decided each on
    its own, a null id counts as the largest.  Rows without words are linked with nothing and
    all stay.  Only documents that may have to go are joined; the others pass a membership
    filter and are never shuffled.
    """
    id_of, class_of, stays, hit, nth = (_free(name, docs.columns) for name in ("_own", "_class", "_stays", "_hit", "_nth"))
    found = named_components(docs, id_column, text, percent, group, words).where(F.col("class").isNotNull())
    is_first = (F.col("class") == F.col("own")) & F.col("_id").eqNullSafe(F.col("first"))
    found = found.groupBy("_id", "class").agg(F.count("*").alias("_rows"), F.max(is_first).alias("_first")).where((F.col("_rows") > 1) | ~F.col("_first"))
    doubtful = written(found.select(F.xxhash64("_id").alias("hash"), F.col("_id").alias(id_of), F.col("class").alias(class_of), F.col("_first").alias(stays)), "doubtful")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    checked = docs.withColumn(hit, may_hold_column(Membership(doubtful, "hash"), F.xxhash64(id_column)))
    unsure = checked.where(F.col(hit)).withColumn(hit, class_column(F.col(text), words))
    unsure = unsure.join(doubtful.drop("hash"), F.col(id_column).eqNullSafe(F.col(id_of)) & (F.col(hit) == F.col(class_of)), "left")
    sure = unsure.where(F.col(stays).isNull()).select(*columns)
    order = Window.partitionBy(id_of, class_of).orderBy(F.xxhash64(*columns))
    firsts = unsure.where(F.col(stays)).withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).select(*columns)
    return checked.where(~F.col(hit)).select(*columns).unionByName(sure).unionByName(firsts)


def class_column(text: Column, words: int = WORDS) -> Column:
    """The class of each text's set; null for texts without words."""
    return F.arrow_udf(lambda texts: pa.array([name for _, name in _sets(texts, words)], pa.int64()), "long")(text)


def _free(name: str, taken: list[str]) -> str:
    """The name, with underscores before it until no column has it."""
    while name in taken:
        name = f"_{name}"
    return name
