"""Document fingerprints from content-defined chunks.

A gear hash rolls over the UTF-8 bytes of a text; its value depends on the last 32 bytes
only, so the same passage has the same cut points wherever it stands.  Chunks are
normalised: a cut before ``NORMAL`` bytes needs more zero bits than one after it, and no
chunk is shorter than ``SHORTEST`` (but for a text's last) or longer than ``LONGEST``.

The fingerprint is the set of chunk digests with their lengths, written in base64 as
sorted 8-byte numbers (48 bits of digest, 16 bits of length).  How much of one document
is in another is the summed length of the chunks that both have, over the first one's.
An inserted or changed passage changes only the chunks that touch it.

Null and empty texts have an empty fingerprint; it is contained in another empty one (1)
and in nothing else (0).  Equal texts have equal fingerprints.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackledger.llm import textops as T
from trackledger.llm.ordering import Parts

SHORTEST = 16
NORMAL = 48
LONGEST = 192
STRICT_BITS = 6
LOOSE_BITS = 4
_GEAR = (T.mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_ROWS = 512  # texts handled at once when documents are paired


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, the gear hash of the 32 bytes up to it."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8, 16):
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
    return h


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of all texts, all texts cut in step."""
    hashes = np.concatenate([gear_hashes(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True) if b > a] or [np.zeros(0, np.uint32)])
    far = len(data) + LONGEST + 1

    def after(bits: int) -> np.ndarray:
        """The first possible cut at each place or later."""
        at = np.where(hashes >> np.uint32(32 - bits) == 0, np.arange(len(hashes)), far)
        return np.concatenate([np.minimum.accumulate(at[::-1])[::-1], [far]])

    strict, loose = after(STRICT_BITS), after(LOOSE_BITS)
    now, end = offsets[:-1][np.diff(offsets) > 0], offsets[1:][np.diff(offsets) > 0]
    starts, ends = [], []
    while len(now):
        early = strict[np.minimum(now + SHORTEST - 1, len(data))]
        late = loose[np.minimum(now + NORMAL - 1, len(data))]
        cut = np.where(early < now + NORMAL - 1, early, np.minimum(late, now + LONGEST - 1)) + 1
        cut = np.minimum(cut, end)
        starts.append(now), ends.append(cut)
        on = cut < end
        now, end = cut[on], end[on]
    return (np.sort(np.concatenate(starts)), np.sort(np.concatenate(ends))) if starts else (offsets[:0], offsets[:0])


def chunk_sets(texts: pa.Array) -> list[np.ndarray]:
    """Per text, its sorted distinct chunks: digest in the upper 48 bits, length in the lower 16."""
    out = []
    for _, data, offsets in T.slices(texts):
        start, end = cuts(data, offsets)
        digests = T.span_hashes(T.prefix_sums(data), start, end)
        chunks = digests & np.uint64(0xFFFFFFFFFFFF0000) | (end - start).astype(np.uint64)
        bounds = np.searchsorted(start, offsets)
        out += [np.unique(chunks[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def packed(chunks: np.ndarray) -> str:
    return base64.b64encode(chunks.astype("<u8").tobytes()).decode()


def unpacked(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), dtype="<u8")


def weight(chunks: np.ndarray) -> int:
    return int((chunks & np.uint64(0xFFFF)).sum())


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The share of a's chunks, by length, that b has too."""
    if not len(a):
        return float(not len(b))
    return weight(np.intersect1d(a, b, assume_unique=True)) / weight(a)


def fingerprint_column(text: Column) -> Column:
    """The fingerprint of each text."""
    return F.arrow_udf(_fingerprints, "string")(text)


def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([packed(x) for x in chunk_sets(texts)], pa.string())


def containment_column(a: Column, b: Column) -> Column:
    """The containment of fingerprint a in fingerprint b."""

    def share(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([containment(unpacked(x or ""), unpacked(y or "")) for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.float64())

    return F.arrow_udf(share, "double")(a, b)


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the row after it in its part; the rows come in order, an edge row last in its part."""
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held: pa.Table | None = None
    for batch in batches:
        for first in range(0, batch.num_rows, _ROWS):
            rows = pa.Table.from_batches([batch.slice(first, _ROWS)])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            held = rows.slice(rows.num_rows - 1)
            texts = rows["text"].to_pylist()
            part, edge = rows["part"].to_numpy(), rows["edge"].to_numpy()
            own = chunk_sets(rows["text"])
            pairs = np.flatnonzero((part[1:] == part[:-1]) & (edge[:-1] == 0)).tolist()
            edited = []
            for i in pairs:
                half = len(texts[i]) // 2
                edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
            changed = chunk_sets(pa.array(edited, pa.string()))
            columns = [
                rows["id"].take(pa.array(pairs, pa.int64())).combine_chunks(),
                pa.array([len(texts[i]) for i in pairs], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                pa.array([packed(own[i]) for i in pairs], pa.string()),
                pa.array([packed(x) for x in changed], pa.string()),
                pa.array([containment(own[i], x) for i, x in zip(pairs, changed, strict=True)], pa.float64()),
                pa.array([containment(own[i], own[i + 1]) for i in pairs], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names)


def edited_fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each document, of its edited text, and how they and the next document's compare.

    The next document is the one after it by descending id (nulls last; equal ids by
    checksum, then hash of the text); after the last comes the first.  The edited text
    replaces the last half of the characters, rounded down, by as many from the start of the
    next one.  The table is dealt into ranges of ids that are sorted and streamed; the first
    row of each range goes to the range before it too, so nothing is sorted in one task.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = rows.select("id")
    parts = Parts(ids, "id")
    firsts = ids.select("id", parts.column(F.col("id")).alias("part")).groupBy("part").agg(F.max("id").alias("first")).collect()
    firsts = sorted(((r["part"], r["first"]) for r in firsts), reverse=True)  # one row per part
    if not firsts:
        return _renamed(rows.sparkSession.createDataFrame([], _schema(rows)), id_column)
    before = [(first, firsts[k - 1][0]) for k, (_, first) in enumerate(firsts)]
    kind = rows.schema["id"].dataType.simpleString()
    known = rows.sparkSession.createDataFrame(before, f"first {kind}, edge_of int").dropDuplicates(["first"])
    rows = rows.join(F.broadcast(known), F.col("id").eqNullSafe(F.col("first")), "left")  # a row per part
    edges = F.col("edge_of")
    places = F.array(F.struct(parts.column(F.col("id")).alias("part"), F.lit(0).alias("edge")), F.struct(edges.alias("part"), F.lit(1).alias("edge")))
    placed = rows.select("id", "text", F.explode(places).alias("_p")).where(F.col("_p.part").isNotNull())
    placed = placed.select("id", "text", "_p.part", "_p.edge")
    placed = placed.repartition(parts.count, "part").sortWithinPartitions(
        "part", "edge", F.col("id").desc_nulls_last(), F.crc32(F.col("text").cast("binary")), F.xxhash64("text")
    )
    return _renamed(placed.mapInArrow(_paired, _schema(rows)), id_column)


def _schema(rows: DataFrame) -> str:
    kind = rows.schema["id"].dataType.simpleString()
    return f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _renamed(rows: DataFrame, id_column: str) -> DataFrame:
    return rows.withColumnRenamed("id", id_column)
