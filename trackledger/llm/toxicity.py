"""Toxicity scores from a factorization machine over hashed terms.

A document is the set of its lower-cased words, and of the first ``PREFIX`` bytes of longer
ones, hashed into ``2**TERM_BITS`` buckets.
The score is ``sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>)``: besides a weight per term
there is a learned vector per term, so a pair such as an insult beside a group mention
counts beyond the two words alone.  Both parts are trained with AdaGrad on mini-batches
in numpy.  Terms are learned that show an association with the label, alone (a G test from
``MIN_ASSOCIATION`` on) or in a pair that tells more by ``MIN_JOINT_ASSOCIATION`` than either
of its terms, as where only one of two words makes a text toxic.  A proximal step drives
weights and vectors to zero unless they earn their place, so that very long clean texts
gather no noise.

Learning takes a bounded sample of labelled rows (``MAX_TRAINING_ROWS``); scoring takes
every row and every word.  Null or empty texts score ``sigmoid(b)``; repeated rows score
alike; labels with a null id or class are ignored, and where rows of one id disagree the
document counts as toxic.  Without any usable label all scores are 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackledger.llm import textops as T

#: At most so many labelled documents are learned from, chosen by a hash of their id.
MAX_TRAINING_ROWS = 8_000
TERM_BITS = 18
PREFIX = 4
FACTORS = 4
EPOCHS = 25
BATCH = 32
RATE = 0.1
L1_WEIGHT = 1e-4
L1_VECTOR = 1e-3
MIN_TRAINING_DOCS = 2
MIN_ASSOCIATION = 10.0
MIN_JOINT_ASSOCIATION = 120.0
#: Pairs are tested of terms in this share of the training documents, of the most frequent ones if there are more.
PAIR_SHARE, PAIR_TERMS = 0.01, 1_024
_PAIRS_AT_ONCE = 128
#: The rarer class counts so many times (as a power of the ratio of the classes).
BALANCE = 0.5


@dataclass
class Model:
    bias: float
    weight: np.ndarray
    vector: np.ndarray  # one row per bucket

    def active(self) -> np.ndarray:
        return (self.weight != 0) | self.vector.any(axis=1)


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, bucket) pairs of a slice of texts, by text."""
    start, end = T.word_spans(data, offsets, T.ALNUM)
    sums, text = T.prefix_sums(data, T.LOWER), T.text_of(offsets, start)
    longer = end - start > PREFIX
    hashes = T.strong_hashes(data, start, end, T.LOWER), T.mix(T.span_hashes(sums, start[longer], start[longer] + PREFIX))
    text = np.concatenate([text, text[longer]])
    pairs = np.unique((text << TERM_BITS) | (np.concatenate(hashes) >> np.uint64(64 - TERM_BITS)).astype(np.int64))
    return pairs >> TERM_BITS, pairs & ((1 << TERM_BITS) - 1)


def logits(model: Model, active: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    text, bucket = terms(data, offsets)
    keep = active[bucket]
    text, bucket = text[keep], bucket[keep]
    out = model.bias + np.bincount(text, model.weight[bucket], n)
    for f in range(model.vector.shape[1]):
        v = model.vector[bucket, f]
        out += 0.5 * (np.bincount(text, v, n) ** 2 - np.bincount(text, v * v, n))
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def association(bucket: np.ndarray, bounds: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The G statistic of each bucket's presence against the label."""
    doc = np.repeat(np.arange(len(label)), np.diff(bounds))
    n = np.bincount(bucket, minlength=1 << TERM_BITS).astype(float)
    return g_statistic(n, np.bincount(bucket, label[doc], 1 << TERM_BITS), float(len(label)), float(label.sum()))


def g_statistic(n: np.ndarray, a: np.ndarray, docs: float, toxic: float) -> np.ndarray:
    """Of what is in n documents, a of them toxic, against the label."""

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    clean = docs - toxic
    g = part(a, n * toxic / docs) + part(n - a, n * clean / docs)
    g += part(toxic - a, (docs - n) * toxic / docs) + part(clean - n + a, (docs - n) * clean / docs)
    return np.where(n >= MIN_TRAINING_DOCS, 2 * g, 0.0)


def joint(bucket: np.ndarray, bounds: np.ndarray, label: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """The buckets of pairs that are associated with the label beyond what their terms are alone."""
    n = np.bincount(bucket, minlength=1 << TERM_BITS)
    chosen = np.flatnonzero(n >= max(MIN_TRAINING_DOCS, PAIR_SHARE * len(label)))
    chosen = chosen[np.argsort(-n[chosen], kind="stable")[:PAIR_TERMS]]
    place = np.full(1 << TERM_BITS, -1)
    place[chosen] = np.arange(len(chosen))
    doc, term = np.repeat(np.arange(len(label)), np.diff(bounds)), place[bucket]
    has = np.zeros((len(label), len(chosen)), dtype=np.float32)
    has[doc[term >= 0], term[term >= 0]] = 1
    toxic, found = has[label > 0], np.zeros(len(chosen), dtype=bool)
    for at in range(0, len(chosen), _PAIRS_AT_ONCE):
        own = slice(at, at + _PAIRS_AT_ONCE)
        g = g_statistic((has[:, own].T @ has).astype(float), (toxic[:, own].T @ toxic).astype(float), float(len(label)), float(label.sum()))
        more = g - np.maximum(alone[chosen[own], None], alone[chosen][None, :]) >= MIN_JOINT_ASSOCIATION
        found[own] |= more.any(axis=1)
        found |= more.any(axis=0)
    return chosen[found]


def fit_arrays(bucket: np.ndarray, bounds: np.ndarray, label: np.ndarray, seed: int = 7) -> Model:
    """The machine for documents whose buckets are ``bucket[bounds[i]:bounds[i + 1]]``."""
    rng = np.random.default_rng(seed)
    size = 1 << TERM_BITS
    weight, vector = np.zeros(size), np.zeros((size, FACTORS))
    if not len(label) or not 0 < label.mean() < 1:
        return Model(-30.0 if not len(label) or label.mean() == 0 else 30.0, weight, vector)
    alone = association(bucket, bounds, label)
    seen = alone >= MIN_ASSOCIATION
    seen[joint(bucket, bounds, label, alone)] = True
    keep = seen[bucket]
    bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
    bucket = bucket[keep]
    vector[seen] = rng.normal(0, 0.02, (int(seen.sum()), FACTORS))
    rarer = float(label.mean() < 0.5)
    ratio = max(label.mean(), 1 - label.mean()) / min(label.mean(), 1 - label.mean())
    importance = np.where(label == rarer, ratio**BALANCE, 1.0)
    bias = float(np.log(label.mean() / (1 - label.mean())))
    sum_w, sum_v, sum_b = np.full(size, 1e-4), np.full(size, 1e-4), 1.0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(label))
        for at in range(0, len(order), BATCH):
            docs = order[at : at + BATCH]
            count = bounds[docs + 1] - bounds[docs]
            doc = np.repeat(np.arange(len(docs)), count)
            start = np.cumsum(count) - count
            term = bucket[np.arange(len(doc)) - start[doc] + bounds[docs][doc]]
            v = vector[term]
            total = np.stack([np.bincount(doc, v[:, f], len(docs)) for f in range(FACTORS)], axis=1)
            square = np.bincount(doc, (v * v).sum(axis=1), len(docs))
            z = bias + np.bincount(doc, weight[term], len(docs)) + 0.5 * ((total**2).sum(axis=1) - square)
            g = importance[docs] * (sigmoid(z) - label[docs]) / len(docs)
            touched, local = np.unique(term, return_inverse=True)
            grad_w = np.bincount(local, g[doc], len(touched))
            pull = g[doc, None] * (total[doc] - v)
            grad_v = np.stack([np.bincount(local, pull[:, f], len(touched)) for f in range(FACTORS)], axis=1)
            sum_w[touched] += grad_w**2
            sum_v[touched] += (grad_v**2).mean(axis=1)
            sum_b += g.sum() ** 2
            bias -= RATE * g.sum() / np.sqrt(sum_b)
            step = RATE / np.sqrt(sum_w[touched])
            w = weight[touched] - step * grad_w
            weight[touched] = np.sign(w) * np.maximum(0, np.abs(w) - step * L1_WEIGHT)
            step = (RATE / np.sqrt(sum_v[touched]))[:, None]
            x = vector[touched] - step * grad_v
            norm = np.sqrt((x**2).sum(axis=1, keepdims=True)) + 1e-12
            vector[touched] = x * np.maximum(0, 1 - step * L1_VECTOR / norm)
    return Model(bias, weight, vector)


def term_array(column: Column) -> Column:
    """The distinct buckets of each text."""
    return F.arrow_udf(_term_array, "array<int>")(column)


def _term_array(texts: pa.Array) -> pa.Array:
    parts = []
    for _, data, offsets in T.slices(texts):
        text, bucket = terms(data, offsets)
        bounds = np.searchsorted(text, np.arange(len(offsets)))
        parts.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(bucket, pa.int32())))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids whose labels are never learned from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, features) -> DataFrame:
    """(y, features) of at most ``rows`` labelled documents outside the held-out fifth, one per id."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .where(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max(F.col(label).cast("int")).alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(rows)
    )
    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    found = texts.join(F.broadcast(chosen), "_id")  # at most ``rows`` rows by the limit above
    found = found.groupBy("_id", "_y").agg(F.min("_text").alias("_text"))
    return found.select("_id", F.col("_y").alias("y"), features(F.col("_text")).alias("features"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = MAX_TRAINING_ROWS) -> Model:
    """Learns from documents (doc_id, text) and labels (doc_id, ``label`` 0 or 1)."""
    table = training_sample(docs, labels, label, rows, term_array).toArrow().combine_chunks().sort_by("_id")
    lists = table["features"].combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
    bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
    model = fit_arrays(lists.flatten().to_numpy().astype(np.int64), bounds, table["y"].to_numpy().astype(float))
    del table, lists
    T.give_back()  # the driver goes on for long
    return model


def score_column(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The toxicity of each text as a column, from 0 to 1."""
    held = docs.sparkSession.sparkContext.broadcast((model, model.active()))

    @F.arrow_udf("double")
    def toxicity(texts: pa.Array) -> pa.Array:
        model, active = held.value
        out = [sigmoid(logits(model, active, data, offsets)) for _, data, offsets in T.slices(texts)]
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return toxicity(F.col(text))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, all columns kept."""
    return docs.where(score_column(docs, model) < threshold)
