"""Exact removal of repeated passages: words in windows that occur earlier, too.

A window is ``WINDOW`` consecutive words of one document.  Its place is (document id, number
of its first word), and a window is late if its word sequence also starts at a smaller
place.  Every word that a late window covers is removed; windows are judged on the input.

Windows meet by super-k-mers.  Each window has a minimiser, the least of its grams of
``GRAM`` words.  Consecutive windows mostly share theirs, and travel as one packed string of
words, about three times the text in all, to the bucket of that minimiser.  Equal windows
have equal minimisers, so a bucket can decide about its windows alone: they are sorted by
hash, neighbours are compared word by word, and all but those of the least place are late.

The order of grams puts rare ones first, by a table of fixed size that is filled from all
texts, so a common line or phrase is no minimiser of the windows around it.  Passages that
are common as a whole are thinned out before they travel: among the texts that a task
handles at once, only the first place of each window goes on, the others are late already.
The order and the thinning decide what travels and where, never the result.

What comes back are ranges of words by row, and only texts with ranges are joined to them.

Ids are whole numbers; a null id is the smallest.  Rows with the same id and different
texts share their places: such windows are late only if they start further on.  Repeated
rows give equal results.  Null, empty and short texts have no window and keep their words.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackledger.llm import textops as T
from trackledger.llm.store import Membership, may_hold_column, small_messages, written

WINDOW = 20
GRAM = 4
#: Bytes of text that a task handles at once.
SLICE = 1 << 20
#: Packed words of a partition of buckets, about; and into how many buckets they are cut.
PART_WORDS, BUCKETS = 1 << 22, 16
#: Bytes of an Arrow batch of packed strings, about.
BATCH = 8 << 20
#: Bits of the table of how common grams are; a gram counts if a slice has it so many times.
COMMON_BITS, COMMON_FROM = 18, 4
_LEAST = np.iinfo(np.int64).min
RANGES = "id long, row long, first int, until int"


def _within(bounds: np.ndarray, size: int) -> np.ndarray:
    """The words from which so many words of the same text follow, itself included."""
    n = np.maximum(0, np.diff(bounds) - size + 1)
    return np.arange(int(n.sum())) + np.repeat(bounds[:-1] - (np.cumsum(n) - n), n)


class Words:
    """The words of some texts: exact numbers and hashes of them, and the grams and windows that start at each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int):
        self.data, self.window = data, window
        self.start, self.end = T.word_spans(data, offsets, T.NOT_BLANK)
        names, _, self.kind = T.span_classes(data, self.start, self.end)
        self.hashes = names[self.kind]
        self.bounds = np.searchsorted(self.start, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the windows at words a and b have equal words."""
        out = np.ones(len(a), dtype=bool)
        for k in range(self.window):
            out &= self.kind[a + k] == self.kind[b + k]
        return out


def late_windows(words: Words, at: np.ndarray, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether each window, at the words ``at`` and with the given place, has an equal one at a smaller place."""
    late = np.zeros(len(at), dtype=bool)
    hashes = T.gram_hashes(words.hashes, words.window)[at]
    left = np.arange(len(at))
    while len(left):
        order = np.argsort(hashes[left], kind="stable")
        ordered = hashes[left][order]
        equal = np.zeros(len(ordered) + 1, dtype=bool)
        equal[1:-1] = ordered[1:] == ordered[:-1]
        several = left[order[equal[1:] | equal[:-1]]]
        several = several[np.lexsort((places[several], ids[several], hashes[several]))]
        opens = np.ones(len(several), dtype=bool)
        opens[1:] = hashes[several[1:]] != hashes[several[:-1]]
        first = several[np.flatnonzero(opens)[np.cumsum(opens) - 1]] if len(several) else several
        same = words.same(at[several], at[first])
        late[several] = same & ((ids[several] != ids[first]) | (places[several] != places[first]))
        left = several[~same]  # equal hashes of unequal windows: once more, apart from the others
        hashes[left] = T.mix(hashes[left] + np.uint64(1))
    return late


def _stretches(at: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, size) of the stretches of consecutive numbers over which the given columns stay the same."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    opens = np.ones(len(at), dtype=bool)
    opens[1:] = at[1:] != at[:-1] + 1
    for column in same:
        opens[1:] |= column[1:] != column[:-1]
    first = np.flatnonzero(opens)
    return first, np.diff(np.append(first, len(at)))


def _ranges(ids: np.ndarray, rows: np.ndarray, first: np.ndarray, until: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(rows), pa.array(first.astype(np.int32)), pa.array(until.astype(np.int32))], ["id", "row", "first", "until"])


# The columns of a packed part, and their types.
_COLUMNS = (("id", "<i8"), ("row", "<i8"), ("first", "<i4"), ("words", "<i4"), ("bytes", "<i4"), ("bucket", "<u1"))


def _pack(columns: dict[str, np.ndarray], text: bytes) -> bytes:
    n = len(columns["id"])
    return zstandard.ZstdCompressor(level=3).compress(struct.pack("<q", n) + b"".join(columns[c].astype(kind).tobytes() for c, kind in _COLUMNS) + text)


def _unpack(raw: bytes) -> tuple[dict[str, np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    (n,), at, columns = struct.unpack_from("<q", raw), 8, {}
    for c, kind in _COLUMNS:
        columns[c] = np.frombuffer(raw, kind, n, at)
        at += columns[c].nbytes
    return columns, raw[at:]


def common_grams(docs: DataFrame, text: str, gram: int) -> tuple[Broadcast, int]:
    """How common grams are, by the first bits of their hash, as a class of size; and the number of words of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << COMMON_BITS) + 1, dtype=np.int64)
        for batch in batches:
            for _, data, offsets in T.slices(batch.column(0), SLICE):
                hashes, bounds = T.word_hashes(data, offsets, T.NOT_BLANK)
                total[-1] += len(hashes)
                values, n = np.unique(T.gram_hashes(hashes, gram)[_within(bounds, gram)], return_counts=True)
                often = n >= COMMON_FROM
                np.add.at(total, (values[often] >> np.uint64(64 - COMMON_BITS)).astype(np.int64), n[often])
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    found = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row per place of the table
    table = np.zeros((1 << COMMON_BITS) + 1, dtype=np.int64)
    table[found["bucket"].to_numpy()] = found["n"].to_numpy()
    classes = np.zeros(1 << COMMON_BITS, dtype=np.uint64)
    filled = table[:-1] > 0
    classes[filled] = np.minimum(63, np.floor(np.log2(table[:-1][filled])) + 1).astype(np.uint64)
    return docs.sparkSession.sparkContext.broadcast(classes), int(table[-1])


def minimisers(words: Words, gram: int, classes: np.ndarray) -> np.ndarray:
    """For each word, the least gram of the window that starts there, rarer grams first."""
    grams = T.gram_hashes(words.hashes, gram)
    order = classes[grams >> np.uint64(64 - COMMON_BITS)] << np.uint64(58) | T.mix(grams) >> np.uint64(6)
    n, width = 1, words.window - gram + 1
    while n < width and len(order):
        step = min(n, width - n)
        order = np.minimum(order[: max(0, len(order) - step)], order[step:])
        n += step
    return order


_ROWS = pa.schema([("part", pa.int32()), ("payload", pa.binary()), ("id", pa.int64()), ("row", pa.int64()), ("first", pa.int32()), ("until", pa.int32())])


def _packed_slice(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, rows: np.ndarray, classes: np.ndarray, parts: int, window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """What travels of some texts: ranges of late windows, and packed super-k-mers of the others by part."""
    words = Words(data, offsets, window)
    at = _within(words.bounds, window)
    if not len(at):
        return
    text = words.text[at]
    place = at - words.bounds[text]
    late = late_windows(words, at, ids[text], place)
    first, size = _stretches(at[late])
    begin = np.flatnonzero(late)[first]
    if len(begin):
        own = np.full(len(begin), T.mix(rows[:1].view(np.uint64))[0] % np.uint64(parts), dtype=np.int32)
        until = place[begin] + size + window - 1
        columns = [own, ids[text[begin]], rows[text[begin]], place[begin].astype(np.int32), until.astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.nulls(len(own), pa.binary()), *map(pa.array, columns[1:])], schema=_ROWS)
    go = np.flatnonzero(~late)
    least = minimisers(words, gram, classes)[at[go]]
    first, size = _stretches(at[go], least)
    begin = go[first]
    name = T.mix(least[first] + np.uint64(1))
    part, bucket = (name % np.uint64(parts)).astype(np.int32), (name >> np.uint64(60)).astype(np.int64) % BUCKETS
    order = np.argsort(part, kind="stable")
    a = at[begin][order]
    n_words = size[order] + window - 1
    begins, ends = words.start[a], words.end[a + n_words - 1]
    columns = {"id": ids[text[begin]][order], "row": rows[text[begin]][order], "first": place[begin][order], "words": n_words, "bytes": ends - begins + 1, "bucket": bucket[order]}
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
    names, payloads, raw = part[order][cuts[:-1]], [], data.tobytes()
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        payloads.append(_pack({c: x[i:j] for c, x in columns.items()}, b"".join([raw[x:y] + b" " for x, y in zip(begins[i:j].tolist(), ends[i:j].tolist(), strict=True)])))
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(payloads, pa.binary()), *(pa.nulls(len(payloads), f.type) for f in list(_ROWS)[2:])], schema=_ROWS)


def _packed(classes: Broadcast, parts: int, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").fill_null(_LEAST).to_numpy()
            rows = batch.column("row").to_numpy()
            for row, data, offsets in T.slices(batch.column("text"), SLICE):
                own = slice(row, row + len(offsets) - 1)
                yield from _packed_slice(data, offsets, ids[own], rows[own], classes.value, parts, window, gram)

    return run


def bucket_ranges(columns: dict[str, np.ndarray], text: bytes, window: int) -> pa.RecordBatch:
    """The ranges of words in late windows, from the packed super-k-mers of a bucket."""
    words = Words(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]), window)
    size = columns["words"].astype(np.int64) - window + 1
    begin = np.cumsum(columns["words"].astype(np.int64)) - columns["words"]
    of = np.repeat(np.arange(len(size)), size)
    each = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    place = columns["first"][of] + each
    late = late_windows(words, begin[of] + each, columns["id"][of], place)
    first, n = _stretches(place[late], of[late])
    kept = np.flatnonzero(late)[first]
    return _ranges(columns["id"][of[kept]], columns["row"][of[kept]], place[kept], place[kept] + n + window - 1)


def _decided(window: int):
    def decide(payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [_unpack(raw) for raw in payloads]
        ends = [np.cumsum(c["bytes"], dtype=np.int64) for c, _ in parts]
        for bucket in range(BUCKETS):
            columns: dict[str, list] = {c: [] for c, _ in _COLUMNS}
            texts = []
            for (own, text), end in zip(parts, ends, strict=True):
                at = np.flatnonzero(own["bucket"] == bucket)
                for c in columns:
                    columns[c].append(own[c][at])
                texts += [text[x:y] for x, y in zip((end[at] - own["bytes"][at]).tolist(), end[at].tolist(), strict=True)]
            if texts:
                yield bucket_ranges({c: np.concatenate(x) for c, x in columns.items()}, b"".join(texts), window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            known = batch.filter(batch.column("payload").is_null())
            if known.num_rows:
                yield pa.RecordBatch.from_arrays([known.column(c) for c in ("id", "row", "first", "until")], ["id", "row", "first", "until"])
            for part, payload in zip(batch.column("part").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if payload is None:
                    continue
                if part != now and held:
                    yield from decide(held)
                    held = []
                now = part
                held.append(payload)
        if held:
            yield from decide(held)

    return run


def late_ranges(docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, row, first, until): ranges of words in late windows; ``row`` is the hash of id and text, a null id the least number."""
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), _row(id_column, text).alias("row"), F.col(f"`{text}`").alias("text"))
    classes, n_words = common_grams(docs, text, gram)
    packed_words = n_words * (2 * window // max(1, window - gram) + 1)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-packed_words // PART_WORDS))
    packed = rows.mapInArrow(_packed(classes, parts, window, gram), "part int, payload binary, id long, row long, first int, until int")
    return packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_decided(window), RANGES)


def _row(id_column: str, text: str) -> Column:
    return F.xxhash64(F.col(f"`{id_column}`").cast("long"), F.col(f"`{text}`"))


def kept_column(text: Column, ranges: Column) -> Column:
    """struct(n_words, n_removed, kept): the words of each text outside its ranges, joined by one space."""

    def keep(texts: pa.Array, lists: pa.Array) -> pa.Array:
        n_words, n_removed, kept = [], [], []
        flat = lists.flatten()
        first, until = flat.field("first").to_numpy(), flat.field("until").to_numpy()
        cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))])
        for row, data, offsets in T.slices(texts, SLICE):
            start, end = T.word_spans(data, offsets, T.NOT_BLANK)
            bounds = np.searchsorted(start, offsets)
            n = np.diff(cuts[row : row + len(offsets)])
            base = np.repeat(bounds[:-1], n)
            change = np.zeros(len(start) + 1, dtype=np.int64)
            a, b = cuts[row], cuts[row + len(offsets) - 1]
            np.add.at(change, base + first[a:b], 1)
            np.add.at(change, base + until[a:b], -1)
            stays = np.cumsum(change)[:-1] == 0
            raw, begins, ends = data.tobytes(), start.tolist(), end.tolist()
            for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = np.flatnonzero(stays[i:j]) + i
                n_words.append(j - i), n_removed.append(j - i - len(own))
                kept.append(b" ".join([raw[begins[k] : ends[k]] for k in own.tolist()]).decode())
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["n_words", "n_removed", "kept"])

    return F.arrow_udf(keep, "n_words long, n_removed long, kept string")(text, ranges)


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, n_words, n_removed, kept) of each row: its words that no late window covers, joined by one space.

    Only texts that may have ranges, by a membership filter, are joined to them; the others are never shuffled.
    """
    with small_messages(docs.sparkSession, BATCH):
        ranges = written(late_ranges(docs, id_column, text, window, gram), "ranges")
    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text}`").alias("_text"), _row(id_column, text).alias("_row"))
    rows = rows.withColumn("_hit", may_hold_column(Membership(ranges.select("row"), "row"), F.col("_row")))
    own = ranges.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("first", "until")).alias("_ranges"))
    none = F.lit(None).cast("array<struct<first:int,until:int>>")
    both = rows.where("_hit").join(own, "_row", "left").select("_id", "_text", "_ranges").unionByName(rows.where("not _hit").select("_id", "_text", none.alias("_ranges")))
    return both.select(F.col("_id").alias(id_column), kept_column(F.col("_text"), F.coalesce("_ranges", F.array().cast("array<struct<first:int,until:int>>"))).alias("_k")).select(id_column, "_k.*")
