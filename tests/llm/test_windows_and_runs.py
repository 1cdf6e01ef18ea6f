"""Passages, alignments and periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackledger.llm import periodic_runs, substring_dedup, token_alignment
from trackledger.llm import queries as Q
from trackledger.llm import textops as T

BLANKS = " \t\n\v\f\r"


def words_of(text):
    out, now = [], ""
    for c in text or "":
        if c in BLANKS:
            out += [now] if now else []
            now = ""
        else:
            now += c
    return out + ([now] if now else [])


def colliding_pair():
    """Two words of 4,096 letters whose sums modulo 2^64 are equal, whatever the base."""
    word = ["a"]
    while len(word) < 4096:
        word += ["b" if c == "a" else "a" for c in word]
    return "".join(word), "".join("b" if c == "a" else "a" for c in word)


# Words and their classes


def test_long_words_with_equal_sums_stay_apart():
    a, b = colliding_pair()
    data = np.frombuffer(f"{a} {b} {a} x".encode(), dtype=np.uint8)
    start, end = T.word_spans(data, np.array([0, len(data)]), T.NOT_BLANK)
    sums = T.span_hashes(T.prefix_sums(data), start, end)
    assert sums[0] == sums[1]
    names, first, kind = T.span_classes(data, start, end)
    assert kind[0] == kind[2] != kind[1] and len(names) == 3


def test_equal_hashes_of_unequal_words_are_told_apart(monkeypatch):
    monkeypatch.setattr(T, "strong_hashes", lambda data, start, end, fold=T.SAME: (end - start).astype(np.uint64))
    data = np.frombuffer(b"ab cd ab abcdefghij abcdefghik cd ef", dtype=np.uint8)
    start, end = T.word_spans(data, np.array([0, len(data)]), T.NOT_BLANK)
    _, _, kind = T.span_classes(data, start, end)
    words = data.tobytes().split()
    assert all((kind[i] == kind[j]) == (words[i] == words[j]) for i in range(7) for j in range(7))


# Passages


def late_by_force(rows, window):
    places = {}
    for name, text in rows:
        words = words_of(text)
        for i in range(len(words) - window + 1):
            places.setdefault(tuple(words[i : i + window]), []).append((name is not None, name or 0, i))
    least = {w: min(p) for w, p in places.items()}
    out = []
    for name, text in rows:
        words = words_of(text)
        gone = set()
        for i in range(len(words) - window + 1):
            if least[tuple(words[i : i + window])] < (name is not None, name or 0, i):
                gone |= set(range(i, i + window))
        out.append((name, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=repr)


def passages(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(30)] + ["é", "日本", "x" * 80, *colliding_pair()]
    shared = [" ".join(rng.choices(vocabulary, k=rng.randint(5, 60))) for _ in range(6)]
    rows = []
    for k in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.5 else "".join(w + rng.choice([" ", "\n", "  ", "\t"]) for w in rng.choices(vocabulary, k=rng.randint(0, 40))) for _ in range(rng.randint(0, 4))]
        rows.append((rng.choice([k, k, k, -k, 7, None]), rng.choice([" ", "\n"]).join(parts)))
    rows += [(100, None), (101, ""), (102, " \n "), (103, "one word"), (7, rows[0][1]), (None, rows[1][1]), (3, "again " * 100), rows[5], rows[5]]
    return rows


@pytest.mark.parametrize("seed,window", [(1, 20), (2, 20), (3, 5)])
def test_late_windows_are_those_of_brute_force(spark, seed, window, monkeypatch):
    rows = passages(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({"id": F.lit(1), "row": F.lit("r"), "n_words": F.lit(2), "kept": F.lit("k"), "_row": F.lit(3)})
    found = substring_dedup.deduplicated(docs, window=window, gram=min(4, window - 1))
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept"]
    assert sorted(map(tuple, found.collect()), key=repr) == late_by_force(rows, window)


def test_a_slice_boundary_changes_nothing(spark, monkeypatch):
    rows = passages(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(substring_dedup, "SLICE", 300)
    monkeypatch.setattr(substring_dedup, "PART_WORDS", 100)
    got = []
    batch = docs.toArrow().to_batches()
    packed = list(substring_dedup._packed(type("B", (), {"value": np.zeros(1 << substring_dedup.COMMON_BITS, np.uint64)}), 7, 20, 4)(_keyed(b) for b in batch))
    by_part: dict = {}
    for b in packed:
        for r in b.to_pylist():
            by_part.setdefault(r["part"], []).append(r)
    for part, own in by_part.items():
        for b in substring_dedup._decided(20)(iter([_rows(own)])):
            got += [(r["id"], r["first"], r["until"]) for r in b.to_pylist()]
    gone = {(i, k) for i, a, b in got for k in range(a, b)}
    ids = {r[0] for r in rows if sum(x[0] == r[0] for x in rows) == 1 and r[0] is not None}
    expected = {r[0]: r[2] for r in late_by_force(rows, 20) if r[0] in ids}
    assert {i: sum(g[0] == i for g in gone) for i in ids} == expected


def _keyed(batch):
    import pyarrow as pa

    rows = [zlib.crc32(repr(r).encode()) for r in batch.to_pylist()]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.int64()), batch.column(1)], ["id", "row", "text"])


def _rows(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("payload", pa.binary()), ("id", pa.int64()), ("row", pa.int64()), ("first", pa.int32()), ("until", pa.int32())]))


def test_no_documents_give_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.deduplicated(empty).count() == 0
    assert empty.select(periodic_runs.runs_column(F.col("text"))).count() == 0
    assert token_alignment.align(empty, Q.tokenizer_file("byte_bpe_50k.json"), Q.tokenizer_file("piece_bpe_32k.model")).count() == 0


# Alignment


def aligned_by_force(texts):
    a_file, b_file = Q.tokenizer_file("byte_bpe_50k.json"), Q.tokenizer_file("piece_bpe_32k.model")
    held = token_alignment.Aligner(a_file, b_file)
    a_bytes, b_bytes = held.transducer.spelled
    out, links = [], []
    for text in texts:
        a, b = (held.a.encode(" " + text, add_special_tokens=False).ids, held.b.encode(text, num_threads=1)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if b"".join(a_bytes[x] for x in a) != whole or b"".join(b_bytes[x] for x in b) != whole:
            out.append((0, 0, None)), links.append([])
            continue
        ends = [np.cumsum([len(s[x]) for x in ids]).tolist() for s, ids in ((a_bytes, a), (b_bytes, b))]
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, own, i, j = [], [], 0, 0
        for end in both:
            k, m = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append(f"{','.join(map(str, a[i:k]))}|{','.join(map(str, b[j:m]))}")
            own.append((a[k - 1], b[m - 1]))
            i, j = k, m
        out.append((len(a), len(b), ";".join(groups))), links.append(own)
    counts: dict = {}
    for own in links:
        for pair in own:
            counts[pair] = counts.get(pair, 0) + 1
    best: dict = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [(n_a, n_b, len(own), len(own), sum(counts[p] == best[p[1]] for p in own), sum(counts[p] for p in own), groups) for (n_a, n_b, groups), own in zip(out, links, strict=True)]


def odd_texts():
    rng = random.Random(5)
    parts = ["hello", "Hello,", "world's", "naïve", "日本語", "🙂", "\n", "\n\n  ", "   ", "\t", " ", " ", "　x", " ", "\u0085 ", "<|endoftext|>", "<s>", "</s>", "<0x41>", "12345", "--", "a.b.c", "\x00", "\x1c ", "Ünïcödé", "᠎ ", "é", "​ "]
    texts = ["".join(p + rng.choice(["", " ", " ", "  "]) for p in rng.choices(parts, k=rng.randint(1, 30))) for _ in range(300)]
    return [*texts, None, "", " ", "  ", "x", " x", "x ", "x  ", "▁", "a▁b c", "a b▁ d", "ab" * 3000, "日本" * 2000, "word " * 3000, *colliding_pair(), texts[0], texts[0]]


def test_alignment_is_that_of_brute_force(spark):
    texts = odd_texts()
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3).withColumns({"groups": F.lit("g"), "pairs": F.lit(0), "n_a": F.lit(1), "_id": F.lit(2)})
    found = token_alignment.align(docs, Q.tokenizer_file("byte_bpe_50k.json"), Q.tokenizer_file("piece_bpe_32k.model"))
    got = [tuple(r)[1:] for r in sorted(found.collect(), key=lambda r: r["doc_id"])]
    assert got == aligned_by_force(texts)


def test_texts_are_cut_only_where_the_files_allow_it():
    a_file, b_file = Q.tokenizer_file("byte_bpe_50k.json"), Q.tokenizer_file("piece_bpe_32k.model")
    held = token_alignment.Aligner(a_file, b_file)
    assert held.cut
    pieces = [held.b.id_to_piece(k) for k in range(held.b.get_piece_size())]
    raw = open(b_file, "rb").read()
    assert token_alignment.b_may_be_cut(raw, pieces) and not token_alignment.b_may_be_cut(raw, [*pieces, "a▁b"])
    whole = token_alignment.Aligner(a_file, b_file)
    whole.cut = False
    texts = [t or "" for t in odd_texts()]
    joined = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    data = np.frombuffer(joined, dtype=np.uint8)
    one, two = list(held.slice(data, offsets)), list(whole.slice(data, offsets))
    assert all(x[0] == y[0] and x[1] == y[1] and (x[2] == y[2]).all() for x, y in zip(one, two, strict=True))


def test_transducer_tells_sequences_that_differ():
    t = token_alignment.Transducer([b"ab", b"c", b"abc"], [b"a", b"bc", b"b", b"d"])
    assert t.groups([0, 1], [0, 1]) == [(2, 2)]
    assert t.groups([2], [0, 2]) is None and t.groups([0], [0, 3]) is None and t.groups([], []) == [] and t.groups([0], [0, 2]) == [(1, 2)]
    assert t.groups([0, 1], [0, 1]) == [(2, 2)]  # remembered moves


def test_every_linked_pair_is_known():
    held = token_alignment.Aligner(Q.tokenizer_file("byte_bpe_50k.json"), Q.tokenizer_file("piece_bpe_32k.model"))
    assert len(held.pairs.codes) < 1_000_000
    a_bytes, b_bytes = held.transducer.spelled
    for code in held.pairs.codes[:: 5001].tolist():
        a, b = a_bytes[code // held.pairs.width], b_bytes[code % held.pairs.width]
        assert a.endswith(b) or b.endswith(a)


# Periodic runs


def runs_by_force(s):
    out = {}
    n = len(s)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(24, 3 * q):
                out.setdefault((i, length), q)
            i = j + 1
    return sorted((a, n, q) for (a, n), q in out.items())


def thue_morse(n):
    return [bin(k).count("1") % 2 for k in range(n)]


def sequences():
    rng = random.Random(6)
    out = [thue_morse(4096), [0] * 200, [0] * 23, [0] * 24, [0, 1] * 40, [0, 1, 2] * 9 + [0], thue_morse(300) * 3, (thue_morse(100) * 4)[3:350]]
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 1500:
        fib.append(fib[-1] + fib[-2])
    out.append(fib[-1])
    for _ in range(150):
        s = []
        while len(s) < rng.randint(10, 400):
            unit = [rng.randint(0, rng.choice([1, 3, 50])) for _ in range(rng.randint(1, 30))]
            s += (unit * rng.randint(1, 12))[: rng.randint(1, 200)]
        out.append(s)
    return out


def test_segments_hold_the_runs_of_brute_force():
    for s in sequences():
        assert sorted(periodic_runs.segment_runs(s)) == runs_by_force(s)


def test_overlap_follows_from_the_shortest_runs():
    assert periodic_runs.OVERLAP == 16


def test_masked_words_join_no_run(spark):
    found = sequences()
    words = [" ".join(f"w{x}" if k % 2 else f"w{x}\n" for k, x in enumerate(s)) for s in found]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(words)], "doc_id long, text string").repartition(2)
    rows = docs.select("doc_id", periodic_runs.runs_column(F.col("text")).alias("r")).select("doc_id", "r.*").orderBy("doc_id").collect()
    for s, r in zip(found, rows, strict=True):
        expected = runs_by_force(s)
        assert [tuple(x) for x in r["runs"]] == sorted(expected, key=lambda x: (x[0], x[2]))
        gone = {i for a, n, q in expected for i in range(a + q, a + n)}
        assert r["n_words"] == len(s) and r["collapsed"] == " ".join(f"w{x}" for i, x in enumerate(s) if i not in gone)


def test_periodic_runs_query_on_a_small_table(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, " ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.choice([0, 3, 40, 300])))) for k in range(120)] + [(120, None), (121, "a " * 90), (122, " \n"), (123, "x" * 100_000), (None, "a " * 30), (121, "a " * 90)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in Q.op13_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    expected, echoed = [], 0
    for name, text in rows:
        s = words_of(text)
        h = zlib.crc32(str(name).encode()) if name is not None else 1
        n, g = len(s), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            s = [s[i] if i < a else s[a + (i - a) % p] for i in range(n)]
            echoed += 1
        runs = sorted(runs_by_force(s), key=lambda x: (x[0], x[2]))
        best = (None,) * 4
        for a, n, q in runs:
            if best[0] is None or n * best[2] > best[1] * q:
                best = (a, n, q, 1000 * n // q)
        gone = {i for a, n, q in runs for i in range(a + q, a + n)}
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        expected.append((name, len(runs), *best, digest("".join(f"{a},{n},{q}\n" for a, n, q in runs)), digest(" ".join(w for i, w in enumerate(s) if i not in gone))))
    assert echoed > 3 and got == sorted(expected, key=repr)


# Terms that only count together


def test_exclusive_terms_are_learned():
    from trackledger.llm import toxicity

    rng = np.random.default_rng(5)
    rows, label = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(sorted({*rng.integers(1000, 3000, 40).tolist(), *([1] if a else []), *([2] if b else [])}))
        label.append(float(a != b))
    bounds = np.cumsum([0, *(len(r) for r in rows[:2000])])
    model = toxicity.fit_arrays(np.array(sum(rows[:2000], [])), bounds, np.array(label[:2000]))
    scores = []
    for own in rows[2000:]:
        v = model.vector[own]
        scores.append(model.bias + model.weight[own].sum() + 0.5 * ((v.sum(axis=0) ** 2) - (v * v).sum(axis=0)).sum())
    y = np.array(label[2000:]) > 0
    good, bad = np.array(scores)[y], np.array(scores)[~y]
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert int(model.active().sum()) < 20


# Words whose sums collide, in the operators that hash words


def test_colliding_words_keep_their_own_ids_and_samples(spark):
    from trackledger.llm import huffman, jaccard_join, piece_sampling

    a, b = colliding_pair()
    texts = [a, b, f"x {a}", f"x {b}", a]
    encoder = huffman.Encoder(Q.tokenizer_file("word_bpe_49k.json"))
    offsets = np.cumsum([0, *(len(t) for t in texts)])
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    got = [np.frombuffer(x, dtype="<u4").tolist() for x in encoder.texts(data, offsets, 2)]
    again = [np.frombuffer(x, dtype="<u4").tolist() for x in encoder.texts(data[offsets[1] : offsets[2]], np.array([0, len(b)]), 2)]
    whole = [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert got == whole and again == [whole[1]]
    model = piece_sampling.pieces(Q.tokenizer_file("piece_bpe_32k.model"))
    drawn = piece_sampling.sample_slice(model, data, offsets, np.arange(len(texts), dtype=np.uint64), 2)
    for text, samples in zip(texts, drawn, strict=True):
        for ids, *_ in samples:
            assert piece_sampling.decode_ids(model, ids, np.array([0, len(ids)])) == [text]
    sets = list(jaccard_join.shingle_sets(data, offsets))
    assert (sets[0] != sets[1]).all() and (sets[0] == sets[4]).all()


def test_colliding_words_match_no_item(spark):
    from trackledger.llm import decontamination

    a, b = colliding_pair()
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    items = spark.createDataFrame([(7, a)], "item_id long, text string")
    assert [tuple(r)[:2] for r in decontamination.overlapping(docs, items).collect()] == [(1, 7)]


# Orders and cuts against plain loops


def test_shard_order_is_that_of_a_plain_sort(spark):
    from trackledger.llm import sharding

    rows = [(i, f"text {i % 50}", "en", "hot" if i % 3 == 0 else f"s{i % 5}", None) for i in range(700)]
    placed = sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6), 24).collect()
    size = {s: sum(r["source"] == s for r in placed) for s in {r["source"] for r in placed}}
    order = sorted(placed, key=lambda r: (r["shard"], r["slot"]))
    bounds = [0]
    for s in range(24):
        own = [r for r in order if r["shard"] == s]
        assert [r["slot"] for r in own] == list(range(len(own)))
        bounds.append(bounds[-1] + len(own))
    assert max(np.diff(bounds)) - min(np.diff(bounds)) <= 1
    for source, n in size.items():  # ranks of a source are spread evenly over the whole order
        at = [k for k, r in enumerate(order) if r["source"] == source]
        assert all(abs((j + 0.5) / n - (k + 0.5) / len(order)) < 2 * len(size) / len(order) + 1 / n for j, k in enumerate(at))


def test_chunks_are_those_of_a_plain_loop():
    from trackledger.llm import fingerprints as P

    rng = np.random.default_rng(11)
    texts = [b"", b"x", rng.integers(0, 255, 5000, dtype=np.uint8).tobytes(), b"a" * 700, ("wörter und mehr " * 60).encode(), rng.integers(97, 102, 900, dtype=np.uint8).tobytes()]
    data, offsets = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
    want = []
    for base, text in zip(offsets.tolist(), texts, strict=False):
        first = 0
        while first < len(text):
            end = first + 1
            while end < len(text):
                h = sum(int(P._GEAR[text[end - 1 - k]]) << k for k in range(min(32, end))) & 0xFFFFFFFF
                size = end - first
                bits = P.STRICT_BITS if size < P.NORMAL else P.LOOSE_BITS
                if size == P.LONGEST or (size >= P.SHORTEST and h >> (32 - bits) == 0):
                    break
                end += 1
            want.append((base + first, base + end))
            first = end
    start, end = P.cuts(data, offsets)
    assert list(zip(start.tolist(), end.tolist(), strict=True)) == want


def test_windows_are_those_of_a_plain_greedy_choice():
    from trackledger.llm import chat

    rng = random.Random(12)
    for _ in range(300):
        budget, history = rng.choice([20, 50]), rng.choice([0, 1, 2, 3])
        turns = [(f"<{k}>", 0, 1, rng.choice([1, 3, 8, 14, 60]), "system" if not k and rng.random() < 0.5 else "user") for k in range(rng.randint(1, 15))]
        windows = chat.Windows(budget, history)
        got = [w for t in turns for w in windows.add(*t)] + list(windows.close())
        size = lambda own: sum(t[3] for t in own)
        system, at, want, before = turns[:1] if turns[0][4] == "system" else [], 0, [], []
        while at < len(turns):
            head = system if want else []
            old = []  # the longest tail of the last window within a quarter of the budget and so many turns
            for t in reversed(before):
                if len(old) == history or size([t, *old]) > budget // 4:
                    break
                old.insert(0, t)
            while old and size([*head, *old, turns[at]]) > budget:
                old.pop(0)
            end = at + 1
            while end < len(turns) and size([*head, *old, *turns[at : end + 1]]) <= budget:
                end += 1
            before = [*old, *turns[at:end]] if want else turns[len(system) : end]
            want.append("".join(t[0] for t in [*head, *old, *turns[at:end]]))
            at = end
        assert [w["formatted"] for w in got] == want


def test_ids_may_be_texts(spark, tmp_path):
    from trackledger.llm import fingerprints, huffman

    docs = spark.createDataFrame([(f"doc-{k:05d}" if k else None, f"text number {k} " * (k % 7)) for k in range(200)], "doc_id string, text string").repartition(4)
    names = sorted(r.doc_id or "" for r in docs.collect())
    huffman.write_ids(docs, str(tmp_path / "ids"), Q.tokenizer_file("word_bpe_49k.json"), 2)
    rows = sorted(huffman.read_ids(spark, str(tmp_path / "ids")).collect(), key=lambda r: r.start)
    assert [r.id or "" for r in rows] == names and spark.read.parquet(str(tmp_path / "ids/blocks")).select("part").distinct().count() > 2
    assert [r.start for r in rows] == np.cumsum([0, *(len(r.ids) // 4 for r in rows)])[:-1].tolist()
    edited = fingerprints.edited_fingerprints(docs).collect()
    assert sorted(r.doc_id or "" for r in edited) == names
    by = {r.doc_id or "": r for r in edited}
    texts = {r.doc_id or "": r.text for r in docs.collect()}
    order = [*sorted((n for n in names if n), reverse=True), ""]
    for name, after in zip(order, [*order[1:], order[0]], strict=True):
        text, half = texts[name], len(texts[name]) // 2
        assert by[name].edited_sha256 == hashlib.sha256((text[: len(text) - half] + texts[after][:half]).encode()).hexdigest()


def test_pipeline_on_an_empty_table_and_with_further_columns(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, class string, part int, _hit int"
    labels = "doc_id long, quality int, toxic int"
    spark.createDataFrame([(0, "some item of ten words or more to be found here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rng = random.Random(3)
    rows = [(k, " ".join(f"w{rng.randint(0, 200)}" for _ in range(30)), "en", "s", 1, "mine", "mine", 7, 9) for k in range(60)]
    rows += [rows[5], (None, "a text without an id, kept as it is", None, None, None, None, None, None, None), (61, None, "en", "s", 0, "mine", "mine", 7, 9), (61, "another text of that id", "en", "s", 0, "mine", "mine", 7, 9)]
    some = [(k, 1, 0) for k in range(60)]
    for name, own, marks in (("empty", [], []), ("full", rows, some)):
        folder = tmp_path / name
        docs = spark.createDataFrame(own, schema)
        docs.write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame(marks, labels).write.parquet(str(folder / "labels.parquet"))
        spark.read.parquet(str(tmp_path / "benchmark.parquet")).write.parquet(str(folder / "benchmark.parquet"))
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(folder))
            out.write.parquet(str(folder / f"stage{n}"))
            if n < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
                docs = spark.read.parquet(str(folder / f"stage{n}"))
        kept = docs.collect()
        assert len(kept) == (0 if not own else 63) and all(r.score in ("mine", None) for r in kept)


def test_benchmark_blocks_are_bounded(spark):
    from trackledger.llm import decontamination as D

    rng = random.Random(21)
    items = [(k, [f"b{rng.randint(0, 60)}" for _ in range(rng.choice([3, 12, 20, 90]))]) for k in range(25)] + [(100, ["long", *[f"b{rng.randint(0, 60)}" for _ in range(400)]])]
    items += [(200 + k, items[3][1]) for k in range(30)] + [(None, items[3][1]), (25, items[0][1])]
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    for most, piece in ((100, 50), (2000, 1 << 16)):
        found = list(D.blocks(D.hashed_items(table), most, piece))
        assert all(len(b.words) <= most or len(b.pieces) == 1 for _, b in found) and (most > 1000 or len(found) > 5)
        assert all((np.diff(b.bounds) <= piece).all() for _, b in found)
        assert sum(len(b.pieces) for _, b in found) == len({(b.pieces[k]) for _, b in found for k in range(len(b.pieces))})
    docs = [(k, " ".join([f"b{rng.randint(0, 60)}" for _ in range(20)] + items[k][1][5:70] + ["end"])) for k in range(0, 26)]
    docs += [(500, " ".join(items[25][1][330:380])), (500, " ".join(items[3][1])), (501, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    plain = sorted(map(tuple, D.overlapping(frame, table).collect()), key=repr)
    assert sorted(map(tuple, D.overlapping(frame, table, most=100, piece=50).collect()), key=repr) == plain
    assert {r[1] for r in plain if r[0] == 500} >= {100, 3, 200, 229, None}
    best = next(r for r in plain if r[:2] == (500, 100))
    assert best[2:4] == (0, 330) and best[4:] == (16, 16)
