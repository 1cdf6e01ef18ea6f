"""Edge cases that every corpus operator must bear, and comparisons with brute force."""

import hashlib
import itertools
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from trackledger.llm import chat, decontamination, fingerprints, huffman, jaccard_join, licenses, piece_sampling, quality, sharding, store, toxicity
from trackledger.llm import textops as T
from trackledger.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
PIECES = str(public_tokenizers.path("piece_bpe_32k.model"))
WORD_BPE = str(public_tokenizers.path("word_bpe_49k.json"))
BYTE_BPE = str(public_tokenizers.path("byte_bpe_50k.json"))


def odd_texts():
    return [None, "", " ", "\n\t", "one", "two words", "a b c d e f g h", LONG, LONG, LONG[:-20] + " other end", "naïve café ▁ 日本語 ①\x00 x", "ÉTÉ été İK", "the the the the the the"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i == 2 else "en", None if i % 4 == 0 else f"s{i % 3}", None) for i, t in enumerate(odd_texts())]
    rows += [rows[4], (None, "null id", None, None, None), (None, "a b c d e f g h", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def wide(odd):
    """Extra columns with the names that operators use themselves."""
    for name in ("score", "shard", "id", "part", "h", "words", "class", "_id", "size", "seq"):
        odd = odd.withColumn(name, F.lit("mine"))
    return odd


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


# 1


def test_shards_are_even_and_keep_the_mixture(spark, wide, empty):
    rows = [(i, f"text {i}", "en", "hot" if i % 3 == 0 else f"s{i % 7}", None) for i in range(2000)]
    got = sharding.interleave(spark.createDataFrame(rows, SCHEMA), 24).toPandas()
    counts = got.groupby("shard").size()
    assert len(counts) == 24 and counts.max() - counts.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    by = got.groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (by.max(axis=1) - by.min(axis=1)).max() <= 2
    again = sharding.interleave(spark.createDataFrame(rows[::-1], SCHEMA), 24).toPandas()
    assert dict(zip(got.doc_id, got.shard)) == dict(zip(again.doc_id, again.shard))
    assert sharding.interleave(empty, 5).count() == 0
    edge = sharding.interleave(wide, 5).collect()
    assert sorted((r["size"], r.text_crc32) for r in edge) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in [r.text for r in wide.collect()])


# 2


def test_samples_are_distinct_exact_and_follow_the_lattice():
    model = piece_sampling.pieces(PIECES)

    def drawn(texts, k, keys=None):
        keys, out = T.mix(np.arange(len(texts), dtype=np.uint64) if keys is None else keys), []
        for row, data, offsets in T.slices(pa.array(texts, pa.string())):
            out += piece_sampling.sample_slice(model, data, offsets, keys[row : row + len(offsets) - 1], k)
        return out

    texts = [t or "" for t in odd_texts()]
    for text, found in zip(texts, drawn(texts, 4), strict=True):
        lists = [tuple(ids.tolist()) for ids, *_ in found]
        assert len(set(lists)) == len(lists) >= 1
        assert all(piece_sampling.decode_ids(model, ids, np.array([0, len(ids)])) == [text] for ids, *_ in found)
        assert all(a[2] >= b[2] for a, b in itertools.pairwise(found))

    def ways(rest):
        if not rest:
            yield ()
        for n in range(1, len(rest) + 1):
            for i in by_bytes.get(rest[:n], ()):
                for tail in ways(rest[n:]):
                    yield (i, *tail)

    by_bytes = defaultdict(list)
    for i, raw in enumerate(model.raw):
        if i > 258:
            by_bytes[raw].append(i)
    every = list(ways(b" there"))
    p = np.exp([sum(model.log_prob[i] for i in w) for w in every])
    p /= p.sum()
    first, both, weighted = Counter(), Counter(), Counter()
    n = 4000
    for found in drawn(["there"] * n, 2):
        first[tuple(found[0][0].tolist())] += 1 / n
        for ids, log_p, _, inclusion in found:
            both[tuple(ids.tolist())] += 1 / n
            weighted[tuple(ids.tolist())] += float(np.exp(-inclusion)) / n
            assert abs(log_p - np.log(p[every.index(tuple(ids.tolist()))])) < 1e-6
    for w, share in zip(every, p, strict=True):
        second = sum(q * share / (1 - q) for v, q in zip(every, p, strict=True) if v != w)
        assert abs(first[w] - share) < 0.03 and abs(both[w] - share - second) < 0.03
        if share > 0.05:
            assert abs(weighted[w] - 1) < 0.05
    few = drawn(["\x00"], 5)[0]
    assert len(few) < 5 and few[-1][3] == 0.0


def test_samples_in_a_table(wide, empty):
    column = piece_sampling.encode_column(F.col("text"), F.col("doc_id"), PIECES, 2)
    rows = wide.select("doc_id", "text", F.explode(column).alias("s")).select("doc_id", "text", "s.*", piece_sampling.decode_column(F.col("s.ids"), PIECES).alias("back"), piece_sampling.ids_crc32(F.col("s.ids")).alias("crc")).collect()
    assert all(r.back == (r.text or "") for r in rows)
    assert all(r.crc == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)
    assert len({(r.sample, r.crc) for r in rows if r.doc_id == 4}) == 2 and sum(r.doc_id == 4 for r in rows) == 4
    assert empty.select(column.alias("s")).collect() == []


# 3 and 4


def labelled(spark, bad, n=600):
    rng = np.random.default_rng(3)
    vocabulary = [f"word{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = rng.choice(vocabulary, rng.integers(5, 60)).tolist()
        label = int(rng.random() < 0.25)
        if label:
            text = bad(rng, text)
        docs.append((i, " ".join(text), "en", "s", None))
        labels.append((i, 1 - label, label))
    labels += [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(docs, labels, score, label, threshold):
    held = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held"), score.alias("s")).join(labels, "doc_id").where(F.col("held") & F.col(label).isNotNull()).collect()
    assert all(0 <= r.s <= 1 for r in held)
    return np.mean([(r.s >= threshold) == bool(r[label]) for r in held])


def test_toxicity_is_learned(spark, wide, empty):
    docs, labels = labelled(spark, lambda rng, t: t + [rng.choice(["vile", "foul", "nasty"])] * 2)
    model = toxicity.fit(docs, labels)
    assert accuracy(docs, labels, toxicity.score_column(docs, model), "toxic", 0.5) > 0.97
    assert toxicity.keep_clean(wide, model).columns == wide.columns
    scores = wide.select(toxicity.score_column(wide, model).alias("s")).collect()
    assert len(scores) == wide.count() and all(0 <= r.s <= 1 for r in scores)
    assert toxicity.keep_clean(empty, model).count() == 0
    none = toxicity.fit(empty, labels.limit(0))
    assert wide.where(toxicity.score_column(wide, none) < 0.5).count() == wide.count()


def test_pairs_count_beyond_their_words():
    rng = np.random.default_rng(5)
    bucket, bounds, label = [], [0], []
    for _ in range(1500):
        a, b = rng.random() < 0.4, rng.random() < 0.4
        own = sorted({*rng.integers(1000, 1400, 8).tolist(), *([1] if a else []), *([2] if b else [])})
        bucket += own
        bounds.append(len(bucket))
        label.append(float(a and b))
    model = toxicity.fit_arrays(np.array(bucket), np.array(bounds), np.array(label))
    linear = model.bias + model.weight[1] + model.weight[2]
    assert float(model.vector[1] @ model.vector[2]) > 0
    assert linear + float(model.vector[1] @ model.vector[2]) > 0 > model.bias + max(model.weight[1], model.weight[2])


def test_scores_equal_a_plain_sum():
    rng = np.random.default_rng(1)
    size = 1 << toxicity.TERM_BITS
    model = toxicity.Model(0.3, rng.normal(0, 0.1, size), rng.normal(0, 0.1, (size, toxicity.FACTORS)))
    texts = ["Abcdef xyz xyz, q", "", "ünïcode wörds here", "abcdef"]
    for _, data, offsets in T.slices(pa.array(texts)):
        text, bucket = toxicity.terms(data, offsets)
        got = toxicity.logits(model, model.active(), data, offsets)
        for i in range(len(texts)):
            own = bucket[text == i]
            plain = model.bias + model.weight[own].sum() + sum(model.vector[a] @ model.vector[b] for a, b in itertools.combinations(own, 2))
            assert abs(plain - got[i]) < 1e-9
        assert len(bucket[text == 0]) == 4  # three words and a prefix


def test_quality_is_learned(spark, wide, empty):
    docs, labels = labelled(spark, lambda rng, t: [f"{w}{rng.choice(['###', '%%%'])}" for w in t] if rng.random() < 0.5 else [t[0]] * len(t))
    model = quality.fit(docs, labels)
    assert accuracy(docs, labels, quality.score_column(docs, model), "quality", 0.3) > 0.93
    assert quality.keep_good(wide, model).columns == wide.columns
    assert quality.keep_good(empty, model).count() == 0
    assert all(0 <= r.s <= 1 for r in wide.select(quality.score_column(wide, model).alias("s")).collect())
    quality.fit(empty, labels.limit(0))


def test_quality_equals_a_plain_mean():
    rng = np.random.default_rng(4)
    model = quality.Model(0.2, rng.normal(0, 1, 1 << quality.BITS))
    texts = ["same same words", "", " \n", "ünï x", LONG]
    for _, data, offsets in T.slices(pa.array(texts)):
        got = quality.logits(model, data, offsets)
        own = [[] for _ in texts]
        for text, bucket in quality.features(data, offsets):
            for t, b in zip(text.tolist(), bucket.tolist(), strict=True):
                own[t].append(model.gain[b])
        for i in range(len(texts)):
            assert abs(got[i] - (0.2 + (np.mean(own[i]) if own[i] else 0))) < 1e-9
        words = [t.split() for t in texts]  # words, neighbours, repeats, and the byte n-grams of each word
        count = [len(w) + max(0, len(w) - 1) + quality.REPEAT_WEIGHT * sum(a == b for a, b in itertools.pairwise(w)) + sum(max(0, len(x.encode()) - n + 1) for x in w for n in (3, 4)) for w in words]
        assert [len(x) for x in own] == count


# 5


def test_seeds_hit_every_tolerated_alignment():
    for n in range(decontamination.SHORTEST_TOLERANT, decontamination.WINDOW + 1):
        least = int(np.ceil(decontamination.MATCH * n - 1e-9))
        for wrong in itertools.combinations(range(n), n - least):
            assert any(all(s + o not in wrong for o in seed) for seed in decontamination.SEEDS for s in range(n - seed[-1]))


def test_overlaps_equal_brute_force(spark, wide, empty):
    rng = np.random.default_rng(9)
    item = [[f"b{rng.integers(0, 50)}" for _ in range(n)] for n in (1, 4, 9, 10, 15, 16, 30, 45)]
    docs = []
    for i in range(200):
        text = [f"b{rng.integers(0, 50)}" for _ in range(rng.integers(0, 80))]
        if i % 2:
            copy = list(item[i % len(item)])
            for k in rng.permutation(len(copy))[: int(len(copy) * rng.random() * 0.4)]:
                copy[k] = "zzz"
            at = int(rng.integers(0, len(text) + 1))
            text[at:at] = copy
        docs.append(text)

    def overlap(text, it):
        w = min(len(it), decontamination.WINDOW)
        need = w if w < decontamination.SHORTEST_TOLERANT else int(np.ceil(decontamination.MATCH * w - 1e-9))
        return any(sum(a == b for a, b in zip(text[i : i + w], it[j : j + w], strict=True)) >= need for i in range(len(text) - w + 1) for j in range(len(it) - w + 1))

    want = {(i, k) for i, t in enumerate(docs) for k, it in enumerate(item) if overlap(t, it)}
    table = spark.createDataFrame([(i, " ".join(t).upper(), None, None, None) for i, t in enumerate(docs)], SCHEMA)
    items = spark.createDataFrame([(k, ", ".join(t)) for k, t in enumerate(item)] + [(98, None), (99, " .")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.overlapping(table, items).collect()} == want
    kept = {r.doc_id for r in decontamination.keep_uncontaminated(table, items).collect()}
    assert kept == set(range(len(docs))) - {i for i, _ in want}
    assert {(r.doc_id, r.item_id) for r in decontamination.overlapping(table, items, most=40).collect()} == want
    assert {r.doc_id for r in decontamination.keep_uncontaminated(table, items, most=40).collect()} == kept
    blocks = list(decontamination.blocks(decontamination.hashed_items(items), most=40))
    assert len(blocks) > 1 and sorted(i for ids, _ in blocks for i in ids) == list(range(len(item)))
    assert decontamination.overlapping(wide, items.limit(0)).count() == 0
    assert decontamination.keep_uncontaminated(wide, items).columns == wide.columns
    assert decontamination.keep_uncontaminated(empty, items).count() == 0


# 6


def test_edited_fingerprints(spark, wide, empty):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"t{rng.integers(0, 9999)}" for _ in range(rng.integers(0, 400))) for _ in range(60)] + ["", "x", "ü" * 7]
    rows = [(i * 3, t, None, None, None) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, text, *_) in enumerate(order):
        other = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        plain = [fingerprints.packed(x) for x in fingerprints.chunk_sets(pa.array([text, edited, other]))]
        assert [got[i].fingerprint, got[i].edited_fingerprint] == plain[:2]
        assert got[i].near_next == fingerprints.containment(fingerprints.unpacked(plain[0]), fingerprints.unpacked(plain[2]))
        if len(text) > 600 and len(other) > 600:
            assert 0.3 < got[i].near_edited < 0.6 and got[i].near_next < 0.1
    assert fingerprints.edited_fingerprints(wide).count() == wide.count()
    assert fingerprints.edited_fingerprints(empty).count() == 0
    one = fingerprints.edited_fingerprints(wide.where("doc_id = 6")).first()
    assert one.near_next == 1.0


def test_chunks_follow_the_content():
    text = LONG.encode()
    shifted = b"inserted " + text
    a, b = fingerprints.chunk_sets(pa.array([text.decode(), shifted.decode()]))
    assert fingerprints.containment(a, b) > 0.95
    data = np.frombuffer(text, np.uint8)
    plain = np.zeros(len(data), np.uint64)
    for i in range(200):
        plain[i] = sum(int(fingerprints._GEAR[data[i - j]]) << j for j in range(min(32, i + 1))) % 2**32
    assert (fingerprints.gear_hashes(data)[:200] == plain[:200].astype(np.uint32)).all()
    start, end = fingerprints.cuts(data, np.array([0, len(data)]))
    assert start[0] == 0 and end[-1] == len(data) and (start[1:] == end[:-1]).all()
    assert (end - start)[:-1].min() >= fingerprints.SHORTEST and (end - start).max() <= fingerprints.LONGEST


# 7


def test_license_scan(spark, wide, empty):
    cases = {
        0: ("Released under the MIT License.\nrest of it", "mit", "mit"), 1: ("x MIT, license y apache LICENSE; General Public-License", "apache,gpl,mit", "apache,gpl,mit"),
        2: ("This work is licensed under the GNU General Public License, version 3.", "gpl", "gpl"), 3: ("Licensed under CC BY-NC 4.0.", "", "cc-by-nc"),
        4: ("permission is hereby granted, free of charge, to any person", "", "mit"), 5: ("the license of mit is public", "", ""), 6: (None, "", ""), 7: ("", "", ""),
        8: ("by nc licensed 4 0 cc under", "", ""), 9: ("miT licenſe, mit lİcense, Kmit license", "", ""), 10: ("word " * 5000 + "mit license", "mit", "mit"), 11: ("hereby granted free of charge", "", ""),
    }
    rows = [(i, t, None, None, None) for i, (t, _, _) in cases.items()] + [(0, cases[0][0], None, None, None)]
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for r in got:
        text, base, labels = cases[r.doc_id]
        own = word.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
        places = [k for p, _ in licenses.PHRASES for k in range(len(own)) if own[k : k + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(own), len(places), min(places, default=None), max(places, default=None))
        assert (r.base_labels, r.labels) == (base, labels), (r.doc_id, r.labels)
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(labels)
    assert licenses.scan(wide).count() == wide.count() and licenses.scan(empty).count() == 0


# 8


def test_chat_windows(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(12):
        for t in range(rng.integers(1, 30)):
            role = "system" if t == 0 and c % 2 else ["user", "assistant"][t % 2]
            rows.append((c, t, role, " ".join(f"w{rng.integers(0, 99)}" for _ in range(rng.integers(0, 60))) + rng.choice(["", "</s>[INST]", "\\<s>\\\\", "\n[/INST] </s>"])))
    rows += [(None, 0, "user", "x"), (50, 0, None, None), (51, None, "assistant", None), (52, 1, "assistant", "big " * 500), (53, 1, "user", "a"), (53, 1, "user", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    windows = chat.format_windows(turns, BYTE_BPE, budget=200).cache()
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    for r in chat.read_back(windows).collect():
        own = sorted(by[r.conv_id])
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        answers = "".join(b for _, a, b in own if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(answers), hashlib.sha256(answers.encode()).hexdigest())
    for w in windows.collect():
        assert w.n_tokens <= 200 or w.n_turns - w.n_repeated == 1
        found = chat.turns_of(w.formatted)
        assert len(found) == w.n_turns and w.n_repeated <= chat.HISTORY + 1
        first = sorted(by[w.conv_id])[0]
        assert first[1] != "system" or found[0] == first[1:]
    assert chat.format_windows(turns.limit(0), BYTE_BPE).count() == 0


# 9


def brute_components(texts):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            top[b] = a
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("group", [512, 8, 3])
def test_near_duplicates_equal_brute_force(spark, group):
    rng = np.random.default_rng(6)
    texts = []
    for n in (3, 5, 11, 12, 14, 20, 21, 25, 33, 60, 200):
        base = [f"v{rng.integers(0, 3000)}" for _ in range(n)]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.integers(0, 3)):
                k = int(rng.integers(0, len(copy)))
                copy[k : k + 1] = [[], [f"n{rng.integers(0, 99)}"], [copy[k], "extra"]][rng.integers(0, 3)]
            texts.append(" ".join(copy))
    base = [f"z{k}" for k in range(40)]  # neighbours in this chain of texts are alike, distant ones are not
    texts += [" ".join(base[:k] + [f"y{j}" for j in range(k)] + base[k:]) for k in range(0, 12)]
    line = " ".join(f"common{i}" for i in range(90))
    texts += [line + " " + " ".join(f"u{rng.integers(0, 9999)}" for _ in range(5)) for _ in range(30)] + ["", None, "One", "one", "a b", "A B"]
    want, sizes = brute_components(texts)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in jaccard_join.near_duplicates(docs, group=group).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    kept = sorted(r.doc_id for r in jaccard_join.keep_one_of_each(docs).collect())
    assert kept == sorted(set(want))


def test_near_duplicates_of_odd_rows(wide, empty):
    got = jaccard_join.near_duplicates(wide).collect()
    assert len(got) == wide.count()
    kept = jaccard_join.keep_one_of_each(wide)
    assert kept.columns == wide.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(4) == 1 and ids.count(None) == 1 and 8 not in ids and 9 not in ids
    assert {0, 1, 2, 3} <= set(ids)  # without words
    assert jaccard_join.near_duplicates(empty).count() == jaccard_join.keep_one_of_each(empty).count() == 0


def test_every_boundary_finds_the_same_links():
    rng = np.random.default_rng(8)
    sets = [np.unique(T.mix(rng.integers(0, 2**62, n).astype(np.uint64))) for n in list(range(1, 45)) * 2]
    sets += [s[:-1] for s in sets if len(s) > 9] + [np.unique(np.concatenate([s[1:], s[:1] + np.uint64(1)])) for s in sets if len(s) > 18]
    linked = set()
    for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2):
        both = len(np.intersect1d(a, b))
        if 100 * both >= 90 * (len(a) + len(b) - both) and jaccard_join.set_hash(a) != jaccard_join.set_hash(b):
            linked.add((i, j))
    assert linked
    for boundary in (0, 9, 19, 22):
        plan = jaccard_join.Plan(90, boundary)
        light = [set(plan.subset_keys(s).tolist()) for s in sets]
        heavy = [set(plan.listed(s).tolist() if len(s) > boundary else ()) for s in sets]
        assert all(light[i] & light[j] or heavy[i] & heavy[j] for i, j in linked)
        shared = np.zeros(1 << (store.FILTER_BITS - 6), dtype=np.uint64)
        for key in rng.permutation(np.unique(np.concatenate(sets)))[::2]:
            bit = key >> np.uint64(64 - store.FILTER_BITS)
            shared[bit >> np.uint64(6)] |= np.uint64(1) << (bit & np.uint64(63))
        ordered = [plan.counted(s) for s in sets]
        for (i, a), (j, b) in itertools.combinations(enumerate(ordered), 2):
            if (i, j) in linked and min(len(sets[i]), len(sets[j])) > boundary:
                enough = [set(x[np.argsort(jaccard_join.may_hold(shared, x), kind="stable")][: len(x) - plan._spare(plan.smallest_partner(len(sets[k]))) + 1].tolist()) for x, k in ((a, i), (b, j))]
                assert enough[0] & enough[1]
                assert set(plan.listed(sets[i], shared).tolist()) == {x for x in enough[0] if jaccard_join.may_hold(shared, np.array([x], np.uint64))[0]}
        assert all(bool(light[i] & light[j]) for i, j in linked if min(len(sets[i]), len(sets[j])) <= boundary)


def test_screening_parts_no_linked_sets():
    rng = np.random.default_rng(13)
    sets = []
    for n in (9, 30, 100, 520, 700, 1030, 3000):
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        for _ in range(25):
            sets.append(np.unique(np.concatenate([base[rng.random(n) > 0.04], rng.integers(0, 2**63, int(rng.integers(0, n // 10 + 1))).astype(np.uint64)])))
    sizes = np.array([len(x) for x in sets])
    part = jaccard_join.possible_parts(sizes, [jaccard_join.signature(x) for x in sets], 90)
    linked = 0
    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 100 * both >= 90 * (sizes[i] + sizes[j] - both):
            linked += 1
            assert part[i] == part[j]
    assert linked > 100 and len(set(part.tolist())) >= 4


def test_boundary_goes_by_the_cost():
    plan = jaccard_join.Plan(90)
    assert plan.cheapest({12: 100}, {12: 100}) < 12  # short lists: nothing to enumerate
    assert plan.cheapest({12: 100}, {12: 10**9}) >= 12  # long ones: subsets


def test_rows_that_share_an_id_are_decided_by_their_text(spark):
    rows = [(1, "a b c d e f", None, None, None), (1, "u v w x y z", None, None, None), (2, "a b c d e f", None, None, None), (2, "A b c d e F", None, None, None), (3, "u v w x y z", None, None, None)]
    kept = jaccard_join.keep_one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, "a b c d e f"), (1, "u v w x y z")]


def test_large_groups_are_compared_in_full(spark):
    """A group of near copies, members that only link over others, and strangers on the same list."""
    rng = np.random.default_rng(12)
    base = [f"g{rng.integers(0, 9999)}" for _ in range(80)]
    texts = [" ".join(base[:k] + [f"e{k}"] + base[k + 1 :]) for k in rng.permutation(60).tolist()]
    twice = list(base)
    twice[20], twice[50] = "q", "r"
    for k in range(10):
        other = list(twice)
        other[5 * k : 5 * k + 3] = ["s", f"t{k}", "u"]
        texts.append(" ".join(other))
    want, _ = brute_components(texts)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs, group=4).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert len(set(want)) > 1


def test_pipeline_keeps_one_of_texts_alike_in_five_word_shingles(spark, tmp_path):
    """The stage against brute force at five words and 0.8, also where three words and 0.9 see no link."""
    import corpus_pipeline

    rng = np.random.default_rng(11)
    line = [f"common{i}" for i in range(60)]
    texts = ["", None, "One", "one", "a b c d e f", "A B c d e f"]
    for n in (5, 9, 24, 60, 150, 400):
        base = [f"v{rng.integers(0, 3000)}" for _ in range(n)]
        for edits in range(8):
            copy = list(base)
            for k in rng.integers(0, n, max(1, n * edits // 200)):
                copy[k] = f"n{rng.integers(0, 99)}"
            texts.append(" ".join(copy))
        texts.append(" ".join(base[: n - n // 8]))
    texts += [" ".join(line + [f"u{rng.integers(0, 9999)}" for _ in range(k)]) for k in range(4, 34)]

    def components_at(n, percent):
        sets = [{tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()) for w in map(words, texts)]
        top = list(range(len(texts)))
        for i, j in itertools.combinations(range(len(texts)), 2):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((top[i], top[j]))
                top = [low if x == high else x for x in top]
        return top

    want = components_at(5, 80)
    assert len(set(want)) < len(set(components_at(3, 90)))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect())
    assert kept == sorted(set(want))


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7), (None, 3)] + [(1000, x) for x in range(1001, 1050)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 200: 100, 150: 100, **{x: 1000 for x in range(1001, 1050)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 10


def test_ids_come_back_as_the_tokenizer_gives_them(spark, wide, empty, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_BPE)
    texts = [t or "" for t in odd_texts()] + ["it's 'test' don't x1y2 !!??. a.b,c ...'s", "a b c", "é ,́x q́", "ΣΑΣ Σ. ΑΣ", "𝟙𝟚 x²", "don’t “quote”", "a'b ''s' 've", "foo\x85bar \x1c y", "end <|endoftext|> here", "<|startoftext|><|endoftext|>x", "<|ENDOFTEXT|> < |endoftext|>"]
    docs = spark.createDataFrame([(len(texts) - i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    path = str(tmp_path / "ids")
    huffman.write_ids(docs, path, WORD_BPE, 2)
    got = {r.id: r for r in huffman.read_ids(spark, path).collect()}
    before = 0
    for i in sorted(got):
        want = tokenizer.encode(texts[len(texts) - i], add_special_tokens=False).ids + [2]
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want, texts[len(texts) - i]
        assert got[i].start == before
        before += len(want)
    huffman.write_ids(wide, path + "-wide", WORD_BPE, 2)
    assert huffman.read_ids(spark, path + "-wide").count() == wide.count()
    huffman.write_ids(empty, path + "-empty", WORD_BPE, 2)
    assert huffman.read_ids(spark, path + "-empty").count() == 0


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    texts = [t or "" for t in odd_texts()] + ["it's x1y2 !!", "<|endoftext|>"]
    encoder, plain = huffman.Encoder(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    assert not encoder.cut and huffman.Encoder(WORD_BPE).cut
    got = [np.frombuffer(raw, "<u4").tolist() for _, data, offsets in T.slices(pa.array(texts)) for raw in encoder.texts(data, offsets, 2)]
    assert got == [plain.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_words_seen_first_are_encoded_together(monkeypatch):
    """Thousands of new words are a few texts for the tokenizer; cuts, capitals, signs, marks and forgetting change no id."""
    from tokenizers import Tokenizer

    encoder = huffman.Encoder(WORD_BPE)
    asked = []

    class Counted:
        def __init__(self, own):
            self.own = own

        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return self.own.encode_batch_fast(texts, **options)

    for name in ("plain", "tokenizer", "words"):
        if hasattr(encoder, name):
            setattr(encoder, name, Counted(getattr(encoder, name)))
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCXYZéèÉßÿÞÀñü"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    texts = [" ".join(w + rng.choice(["", ".", "!!"]) for w in words[at : at + 100]) for at in range(0, 3000, 100)]
    ids = lambda texts, size=1 << 20: [raw for _, data, offsets in T.slices(pa.array(texts), size) for raw in encoder.texts(data, offsets, 2)]
    whole = lambda texts: [np.array([*e.ids, 2], "<u4").tobytes() for e in Tokenizer.from_file(WORD_BPE).encode_batch_fast(texts, add_special_tokens=False)]
    assert ids(texts) == whole(texts) and len(asked) < 30
    signs = [*letters, *" '.,!?#019\n\t×÷\u0301\u0338İςΣ中🙂Ǆœ<>/", "</w>", "'ve", "'s", "<|endoftext|>", " ", " "]
    odd = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    monkeypatch.setattr(huffman, "REMEMBERED", 300)
    encoder.forget()
    assert ids(odd, 1 << 12) == whole(odd)


def test_chunks_of_one_name_are_told_apart(monkeypatch):
    """Longer chunks may share a name with any others; none of them takes the ids of another, when new or when remembered."""
    from tokenizers import Tokenizer

    names = huffman._names
    monkeypatch.setattr(huffman, "_names", lambda data, start, end: np.where(end - start > 8, names(data, np.zeros(1, np.int64), np.array([3]))[0], names(data, start, end)))
    texts = ["abc internationally", "Internationally abc interstellar", "interstellar\0 abc\0 abc", "electromagnetic" * 9, "electromagnetic" * 8 + " abcdefgh abcdefghi"] * 2
    encoder = huffman.Encoder(WORD_BPE)
    got = [raw for _, data, offsets in T.slices(pa.array(texts), 16) for raw in encoder.texts(data, offsets, 2)]
    assert got == [np.array([*e.ids, 2], "<u4").tobytes() for e in Tokenizer.from_file(WORD_BPE).encode_batch_fast(texts, add_special_tokens=False)]


def test_documents_are_coded_together_as_each_alone():
    rng = np.random.default_rng(3)
    ids = (rng.zipf(1.3, 9000) % 3000).astype(np.uint32)
    code = huffman.Code(*(lambda symbols, n: (symbols, huffman.code_lengths(n)))(*np.unique(ids, return_counts=True)))
    bounds = np.array([0, 0, 1, 1, 257, 513, 769, 770, 5000, 9000, 9000])
    payloads, starts, lanes = code.encode_all(ids, bounds)
    each = [code.encode(ids[a:b]) for a, b in itertools.pairwise(bounds)]
    assert payloads == [p for p, _ in each] and lanes.tolist() == [len(c) for _, c in each]
    assert starts.tolist() == np.concatenate([c for _, c in each]).tolist()
    back = code.decode(payloads[1:2] + payloads[3:-1], np.split(starts, np.cumsum(lanes))[1:2] + np.split(starts, np.cumsum(lanes))[3:-2], [[int(n)] for n in np.diff(bounds) if n])
    assert np.concatenate(back).tolist() == ids.tolist()


def test_many_empty_texts_fill_blocks(spark, tmp_path):
    docs = spark.range(200_000).selectExpr("id AS doc_id", "if(id % 50000 = 7, 'some words here', '') AS text")
    huffman.write_ids(docs, str(tmp_path / "ids"), WORD_BPE, 2)
    got = huffman.read_ids(spark, str(tmp_path / "ids")).selectExpr("count(*) AS n", "sum(octet_length(ids) div 4) AS ids", "max(start) AS last").first()
    assert (got.n, got.ids, got.last) == (200_000, 200_000 + 4 * 3, 200_000 + 4 * 3 - 1)


def test_code_is_optimal_within_its_limit_and_decodes():
    rng = np.random.default_rng(7)
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    free, short = huffman.code_lengths(counts, 16), huffman.code_lengths(counts, 4)
    assert (counts * free).sum() == 350 - 1 - 0 or sum(2.0 ** -free) == 1
    assert short.max() == 4 and sum(2.0**-short) <= 1

    def best(limit):
        found = []
        for lengths in itertools.combinations_with_replacement(range(1, limit + 1), 5):
            if sum(2.0**-x for x in lengths) <= 1:
                found.append(sum(a * b for a, b in zip(sorted(counts[:5], reverse=True), lengths, strict=True)))
        return min(found)

    assert (counts[:5] * huffman.code_lengths(counts[:5], 3)).sum() == best(3)
    ids = (rng.zipf(1.3, 5000) % 3000).astype(np.uint32)
    symbols, n = np.unique(ids, return_counts=True)
    code = huffman.Code(symbols, huffman.code_lengths(n))
    parts = np.split(ids, [0, 1, 700, 700 + huffman.LANE, 3000])
    coded = [code.encode(p) for p in parts if len(p)]
    back = code.decode([c[0] for c in coded], [c[1] for c in coded], [[len(p)] for p in parts if len(p)])
    assert np.concatenate(back).tolist() == ids.tolist()
    one = huffman.Code(np.array([7]), huffman.code_lengths(np.array([3])))
    payload, checkpoints = one.encode(np.array([7, 7, 7]))
    assert one.decode([payload], [checkpoints], [[3]])[0].tolist() == [7, 7, 7]


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(0)
    vocabulary = [f"plain{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(400):
        text = rng.choice(vocabulary, 40).tolist()
        toxic, good = int(i % 5 == 0), int(i % 7 != 0)
        text = (text + ["vile", "foul"]) if toxic else text
        text = [w + "###" for w in text] if not good else text
        docs.append((i, " ".join(text), "en", "s", 1))
        labels.append((i, good, toxic))
    docs += [(1000 + i, docs[i][1] + " tail", "en", "s", 1) for i in range(1, 400, 9)]
    item = "the quick brown fox jumps over the lazy dog and then it sleeps for a very long time"
    docs.append((5000, docs[1][1][:60] + " " + item, "en", "s", 1))
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    final = corpus_pipeline.run(spark, str(tmp_path))
    left = {r.doc_id for r in final.collect()}
    assert 5000 not in left and len(left) > 150
    assert not left & {i for i in range(0, 400, 5)} and not left & {i for i in range(0, 400, 7)}
    assert not {i for i in left if i >= 1000}
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])


def test_lists_hold_sets_of_like_size_only(spark):
    """Texts of sizes too different to link meet in no list, although they share all of their shingles."""
    texts = [" ".join(f"w{k}" for k in range(n)) for n in (40, 60, 90, 135, 200)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts + [texts[0] + " more"])], SCHEMA)
    sets = store.written(jaccard_join.document_sets(docs, reach=jaccard_join.Plan(90).reach), "sets")
    names = {r["class"]: r["n_shingles"] for r in sets.collect()}
    found = jaccard_join.candidate_groups(docs, sets, 90).collect()
    assert {names[r["class"]] for r in found} == {38, 39}


def test_groups_of_any_size_are_screened(spark, monkeypatch):
    """Strangers of a group leave it, and near copies stay together, however few are screened at once."""
    rng = np.random.default_rng(31)
    texts = [" ".join(f"v{rng.integers(0, 9999)}" for _ in range(80)) for _ in range(60)]
    texts += [texts[k] + " more" for k in range(9)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    sets = store.written(jaccard_join.document_sets(docs), "sets")
    names = {r["_id"]: r["class"] for r in sets.collect()}
    one = sets.select("class", F.lit(-1).cast("long").alias("group"), F.col("n_shingles").cast("int").alias("n"))
    whole = {tuple(r) for r in jaccard_join.screened(one, sets, 90).collect()}
    assert len(whole) == 18
    monkeypatch.setattr(jaccard_join, "SCREENED", 8)
    assert {tuple(r) for r in jaccard_join.screened(one, sets, 90).collect()} == whole == {(names[k], min(names[i], names[i + 60]), r[2]) for i in range(9) for k in (i, i + 60) for r in whole if r[0] == names[k]}
