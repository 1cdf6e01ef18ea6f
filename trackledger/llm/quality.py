"""Quality scores from supervised subword embeddings.

Every word, every pair of neighbouring words and every byte 3- and 4-gram within a word
has a learned vector, found by hash; a word that repeats the one before it also has a
feature of its own.  A document is the mean of the vectors of all its features, and a
softmax over two classes reads it.  Vectors and output are trained together by
mini-batch gradient descent in numpy.

For two classes the softmax needs only the difference of the logits, and that is linear
in the mean: scoring therefore looks up one number per feature, the vector's projection
on the difference of the output rows.

Learning takes a bounded sample of labelled rows per class (``MAX_ROWS_PER_CLASS``), and
the output bias is moved back to the class shares of all labels.  Scoring takes every
row and whole texts.  Null, empty and blank texts have no feature: they get the bias
alone.  Repeated rows score alike; labels with a null id or class are ignored, and where
rows of one id disagree the larger class counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackledger.llm import textops as T
from trackledger.llm.toxicity import held_out, sigmoid

#: At most so many labelled documents of each class are learned from, chosen by a hash of their id.
MAX_ROWS_PER_CLASS = 1_500
BITS = 17
DIM = 8
EPOCHS = 8
#: Small samples are gone through more often, until so many batches were learned from.
LEAST_BATCHES = 1_500
BATCH = 16
RATE = 0.5
SAME_AS_LAST = 0  # the bucket of a repeated word
#: A repeated word counts as so many features, as many as a word of usual length has.
REPEAT_WEIGHT = 6


@dataclass
class Model:
    bias: float
    gain: np.ndarray  # of each bucket: its vector's projection on the output's difference


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) arrays of all features of a slice, repeats included."""
    shift = np.uint64(64 - BITS)
    start, end = T.word_spans(data, offsets, T.NOT_BLANK)
    if not len(start):
        return []
    hashes = T.strong_hashes(data, start, end)
    text = T.text_of(offsets, start)
    out = [(text, (hashes >> shift).astype(np.int64))]
    pair = text[1:] == text[:-1]
    both = T.mix(hashes[:-1] * np.uint64(3) + hashes[1:])[pair]
    again = (hashes[1:] == hashes[:-1])[pair]
    out.append((text[1:][pair], (both >> shift).astype(np.int64)))
    repeats = np.repeat(text[1:][pair][again], REPEAT_WEIGHT)
    out.append((repeats, np.full(len(repeats), SAME_AS_LAST)))
    byte = data.astype(np.uint32)
    word = np.repeat(np.arange(len(start)), end - start)  # of each byte that is in a word
    at = np.arange(len(word)) - np.repeat(np.cumsum(end - start) - (end - start), end - start) + start[word]
    left = end[word] - at  # bytes from here to the end of the word
    for n in (3, 4):
        here = at[left >= n]
        gram = byte[here] | byte[here + 1] << np.uint32(8) | byte[here + 2] << np.uint32(16)
        if n == 4:
            gram |= byte[here + 3] << np.uint32(24)
        gram = (gram + np.uint32(n)) * np.uint32(2654435761)
        gram ^= gram >> np.uint32(15)
        gram *= np.uint32(2246822519)
        out.append((text[word[left >= n]], (gram >> np.uint32(32 - BITS)).astype(np.int64)))
    return out


def logits(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    total, count = np.zeros(n), np.zeros(n)
    for text, bucket in features(data, offsets):
        total += np.bincount(text, model.gain[bucket], n)
        count += np.bincount(text, minlength=n)
    return model.bias + total / np.maximum(count, 1)


def feature_counts(column: Column) -> Column:
    """Distinct buckets of each text with their counts."""
    return F.arrow_udf(_feature_counts, "array<struct<bucket:int,n:int>>")(column)


def _feature_counts(texts: pa.Array) -> pa.Array:
    parts = []
    for _, data, offsets in T.slices(texts):
        found = features(data, offsets)
        keys = np.concatenate([(t << BITS) | b for t, b in found]) if found else np.zeros(0, np.int64)
        keys, n = np.unique(keys, return_counts=True)
        bounds = np.searchsorted(keys >> BITS, np.arange(len(offsets)))
        rows = pa.StructArray.from_arrays([pa.array(keys & ((1 << BITS) - 1), pa.int32()), pa.array(n, pa.int32())], ["bucket", "n"])
        parts.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.struct([("bucket", pa.int32()), ("n", pa.int32())])))


def fit_arrays(bucket: np.ndarray, share: np.ndarray, bounds: np.ndarray, label: np.ndarray, prior: float, seed: int = 11) -> Model:
    """Documents are ``bucket[bounds[i]:bounds[i + 1]]``, each feature with its share of the document."""
    rng = np.random.default_rng(seed)
    size = 1 << BITS
    if not len(label) or not 0 < label.mean() < 1:
        return Model(-30.0 if len(label) and label.mean() == 0 else 30.0, np.zeros(size))
    vector = rng.normal(0, 0.1, (size, DIM))
    output = rng.normal(0, 0.1, (DIM, 2))
    bias = np.zeros(2)
    sum_vector, sum_output, sum_bias = np.full(size, 1e-6), np.full((DIM, 2), 1e-6), np.full(2, 1e-6)
    target = np.stack([1 - label, label], axis=1)
    epochs = max(EPOCHS, -(-LEAST_BATCHES * BATCH // len(label)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(label))
        for at in range(0, len(order), BATCH):
            docs = order[at : at + BATCH]
            count = bounds[docs + 1] - bounds[docs]
            doc = np.repeat(np.arange(len(docs)), count)
            place = np.arange(len(doc)) - (np.cumsum(count) - count)[doc] + bounds[docs][doc]
            term, part = bucket[place], share[place]
            rows = vector[term] * part[:, None]
            mean = np.stack([np.bincount(doc, rows[:, d], len(docs)) for d in range(DIM)], axis=1)
            z = mean @ output + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            g = (p / p.sum(axis=1, keepdims=True) - target[docs]) / len(docs)
            back = g @ output.T
            grad = mean.T @ g
            sum_output += grad**2
            output -= rate * grad / np.sqrt(sum_output)
            sum_bias += g.sum(axis=0) ** 2
            bias -= rate * g.sum(axis=0) / np.sqrt(sum_bias)
            touched, local = np.unique(term, return_inverse=True)
            pull = back[doc] * part[:, None]
            grad = np.stack([np.bincount(local, pull[:, d], len(touched)) for d in range(DIM)], axis=1)
            sum_vector[touched] += (grad**2).mean(axis=1)
            vector[touched] -= 0.3 * rate * grad / np.sqrt(sum_vector[touched])[:, None]
    moved = np.log(prior / (1 - prior)) - np.log(label.mean() / (1 - label.mean()))
    return Model(float(bias[1] - bias[0] + moved), vector @ (output[:, 1] - output[:, 0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = MAX_ROWS_PER_CLASS) -> Model:
    """Learns from documents (doc_id, text) and labels (doc_id, ``label`` 0 or 1)."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .where(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max(F.col(label).cast("int")).alias("_y"))
    )
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    first = lambda y: known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    chosen = first(0).unionByName(first(1))
    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    found = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text"))
    table = found.select("_id", "_y", feature_counts(F.col("_text")).alias("f")).toArrow().combine_chunks().sort_by("_id")
    lists = table["f"].combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.struct([("bucket", pa.int32()), ("n", pa.int32())])))
    rows_ = lists.flatten()
    bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
    n = rows_.field("n").to_numpy().astype(float)
    total = np.add.reduceat(np.concatenate([n, [0.0]]), bounds[:-1]) if len(bounds) > 1 else np.zeros(0)
    share = n / np.repeat(total, np.diff(bounds))
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    model = fit_arrays(rows_.field("bucket").to_numpy().astype(np.int64), share, bounds, table["_y"].to_numpy().astype(float), prior)
    del found, table, lists, rows_, n, total, share
    T.give_back()  # the driver goes on for long
    return model


def score_column(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The quality of each text as a column, from 0 to 1."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def quality(texts: pa.Array) -> pa.Array:
        out = [sigmoid(logits(held.value, data, offsets)) for _, data, offsets in T.slices(texts)]
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return quality(F.col(text))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents that score at least the threshold, all columns kept."""
    return docs.where(score_column(docs, model) >= threshold)
