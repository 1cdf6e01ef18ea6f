"""Alignment of two tokenizers' tokens over the same bytes.

Tokenizer A is a byte-level BPE file, B a SentencePiece model.  Both encode a text with one
blank before it (B adds that blank itself).  A token stands for bytes: A's entry decoded to
bytes, B's piece in UTF-8 with blanks for U+2581, a byte piece for its byte.  Places where
a token of A and a token of B both end cut the two sequences into groups.

Groups come from a transducer over the dangling suffix: its state is which side leads and by
which bytes.  The side that lags gives the next token; what is left over of the two is the
new state, and an empty rest closes the group.  States are few, since they are suffixes of
tokens, so each (state, next token) is worked out once and remembered.

Work is saved once more where both tokenizer files provably never join characters over the
start of a run of blanks (``b_may_be_cut``, ``a_may_be_cut``): there a text is cut into
chunks, both sides end a token at every cut, and a chunk that recurs is encoded and aligned
once.  Texts of other tokenizers go as one chunk.  If a chunk's tokens do not spell its
bytes (as with a U+2581 in the text), the text is encoded whole, and whether its bytes are
spelled decides.

A link is a pair of tokens that end together; tokens have bytes, so each group has one.  Of two such tokens one is a suffix of the
other, so the pairs that may occur follow from the two vocabularies (``Pairs``); their
counts over the whole table are a list of that length, whatever the number of texts.

Null and empty texts, and texts that a side does not spell, have no tokens: all figures are
0 and the groups are null.  Repeated rows count each.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackledger.llm import textops as T
from trackledger.llm.store import new_path

#: Bytes of a chunk that is remembered at most, and how many chunks a worker remembers.
LONGEST, REMEMBERED = 64, 300_000
#: Bytes of results that a worker keeps at most.
HELD = 1 << 26
SLICE = 1 << 20
_BLANK = "▁"
_WORD = np.zeros(256, dtype=bool)  # bytes after which a blank may start a chunk: no white space, nor the last byte of any
_WORD[0x21:0x7F] = True
_WORD[0x8B:0xC0] = True
_WORD[[0x8E, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False


def byte_alphabet() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, the others follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def a_may_be_cut(settings: dict) -> bool:
    """Whether A splits texts so that no token goes from a character over a blank, and nothing looks back over one.

    That is so for the usual byte-level split: it starts a new piece at each first white space after other characters.
    """
    pre, model = settings.get("pre_tokenizer") or {}, settings["model"]
    return settings.get("normalizer") is None and settings.get("post_processor") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") is True and not pre.get("add_prefix_space") and not model.get("dropout")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a serialized message's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = number() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, raw[at : at + size]
            at += size


def b_may_be_cut(raw: bytes, pieces: list[str]) -> bool:
    """Whether B takes texts as they are and has no piece with a blank after another character, so that merges never go over one."""
    # The fields of the model file's format.
    top = [(n, v) for n, v in _fields(raw) if n in (2, 3)]
    training, normalizer = dict(_fields(b"".join(v for n, v in top if n == 2))), dict(_fields(b"".join(v for n, v in top if n == 3)))
    as_it_is = not normalizer.get(2) and normalizer.get(3, 1) and not normalizer.get(4, 1) and normalizer.get(5, 1)
    bpe = training.get(3) == 2 and not training.get(24)
    return bool(as_it_is and bpe and _BLANK in pieces and not any(_BLANK in p.lstrip(_BLANK) for p in pieces))


class Transducer:
    """Groups of two token sequences that spell the same bytes."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.spelled = (a_bytes, b_bytes)
        self.states: dict[tuple[int, bytes], int] = {(0, b""): 0}
        self.named: list[tuple[int, bytes]] = [(0, b"")]  # (side that leads, its bytes); 0 also is the closed state
        self.moves: list[dict[int, int]] = [{}]
        self.lagging = [0]  # the side that gives the next token

    def move(self, state: int, token: int) -> int:
        """The state after the lagging side's next token; -1 if the bytes differ."""
        (lead, rest), side = self.named[state], self.lagging[state]
        new = self.spelled[side][token]
        if rest.startswith(new):
            key = (lead, rest[len(new) :])
        elif new.startswith(rest):
            key = (side, new[len(rest) :])
        else:
            key = None
        if key is not None and not key[1]:
            key = (0, b"")
        to = -1 if key is None else self.states.setdefault(key, len(self.named))
        if to == len(self.named):
            self.named.append(key)
            self.moves.append({})
            self.lagging.append(1 - key[0])
        self.moves[state][token] = to
        return to

    def groups(self, a: list[int], b: list[int]) -> list[tuple[int, int]] | None:
        """(tokens of A, tokens of B) up to the end of each group; None if the sequences spell different bytes."""
        moves, lagging, out = self.moves, self.lagging, []
        i = j = state = 0
        n, m = len(a), len(b)
        while True:
            if lagging[state]:
                if j == m:
                    return None
                token = b[j]
                j += 1
            else:
                if i == n:
                    return out if not state and j == m else None
                token = a[i]
                i += 1
            to = moves[state].get(token)
            state = self.move(state, token) if to is None else to
            if state <= 0:
                if state:
                    return None
                out.append((i, j))


class Pairs:
    """The pairs of tokens that may end together: one's bytes are a suffix of the other's."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        by_bytes: tuple[dict[bytes, list[int]], ...] = ({}, {})
        for names, spelled in zip(by_bytes, (a_bytes, b_bytes), strict=True):
            for token, raw in enumerate(spelled):
                if raw:
                    names.setdefault(raw, []).append(token)
        self.width = len(b_bytes)
        found = {a * self.width + b for a, raw in enumerate(a_bytes) for k in range(len(raw)) for b in by_bytes[1].get(raw[k:], ())}
        found |= {a * self.width + b for b, raw in enumerate(b_bytes) for k in range(len(raw)) for a in by_bytes[0].get(raw[k:], ())}
        self.codes = np.array(sorted(found), dtype=np.int64)

    def index(self, codes: np.ndarray) -> np.ndarray:
        """The number of each pair a, b, given as ``a * width + b``."""
        return np.searchsorted(self.codes, codes)

    def best(self, counts: np.ndarray) -> np.ndarray:
        """Whether a pair's count is the highest of all pairs with its token of B."""
        b = self.codes % self.width
        most = np.zeros(self.width, dtype=np.int64)
        np.maximum.at(most, b, counts)
        return counts == most[b]


class Aligner:
    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        from tokenizers import Tokenizer

        settings = json.loads(Path(a_file).read_text(encoding="utf-8"))
        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        alphabet = byte_alphabet()
        a_bytes = [b""] * (max(settings["model"]["vocab"].values()) + 1)
        for entry, token in settings["model"]["vocab"].items():
            a_bytes[token] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else b""
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else b"" if self.b.is_control(k) or self.b.is_unknown(k) else p.replace(_BLANK, " ").encode() for k, p in enumerate(pieces)]
        self.blank = [self.b.piece_to_id(_BLANK)]
        self.cut = a_may_be_cut(settings) and b_may_be_cut(Path(b_file).read_bytes(), pieces)
        self.transducer, self.pairs = Transducer(a_bytes, b_bytes), Pairs(a_bytes, b_bytes)
        self.a_names, self.b_names = [str(k) for k in range(len(a_bytes))], [str(k) for k in range(len(b_bytes))]
        self.forget()

    def forget(self) -> None:
        """Empties what is known of chunks; row 0 is of none."""
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.figures = np.zeros((1, 3), np.int64)  # tokens of A, tokens of B, links
        self.starts = np.zeros(1, np.int64)  # of each row's links
        self.links = np.zeros(0, np.int32)
        self.written = [""]

    def align(self, chunks: list[bytes]) -> list[int]:
        """The row of each chunk, which starts with its blank; -1 if a side does not spell it."""
        ours = self.a.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)
        theirs = self.b.encode([c[1:].decode() for c in chunks], num_threads=1) if chunks else []
        a_bytes, an, bn, width, groups = self.transducer.spelled[0].__getitem__, self.a_names, self.b_names, self.pairs.width, self.transducer.groups
        out, figures, codes = [], [], []
        for chunk, enc, b in zip(chunks, ours, theirs, strict=True):
            a = enc.ids
            if len(chunk) == 1:
                b = self.blank  # no text is left to which B would add its blank
            ends = groups(a, b) if b"".join(map(a_bytes, a)) == chunk else None
            if ends is None:
                out.append(-1)
                continue
            i, k, parts = 0, 0, []
            for j, m in ends:
                if j - i == 1 == m - k:
                    parts.append(f"{an[a[i]]}|{bn[b[k]]}")
                else:
                    parts.append(f"{','.join([an[x] for x in a[i:j]])}|{','.join([bn[x] for x in b[k:m]])}")
                codes.append(a[j - 1] * width + b[m - 1])
                i, k = j, m
            out.append(len(self.written))
            self.written.append(";".join(parts))
            self.held += len(self.written[-1]) + 4 * len(ends)
            figures.append((len(a), len(b), len(ends)))
        if figures:
            figures = np.array(figures, dtype=np.int64)
            sizes = figures[:, 2]
            self.starts = np.concatenate([self.starts, len(self.links) + np.cumsum(sizes) - sizes])
            self.figures = np.concatenate([self.figures, figures])
            self.links = np.concatenate([self.links, self.pairs.index(np.array(codes, dtype=np.int64)).astype(np.int32)])
        return out

    def rows_of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The row of each chunk; equal chunks are looked up once."""
        if len(self.written) > REMEMBERED or self.held > HELD:
            self.forget()
        _, first, kind = T.span_classes(data, start, end)
        raw = data.tobytes()
        names = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        rows = np.array([self.known.get(name, -2) for name in names], dtype=np.int64)
        new = np.flatnonzero(rows == -2)
        rows[new] = self.align([names[k] for k in new.tolist()])
        self.known.update((names[k], int(rows[k])) for k in new.tolist() if len(names[k]) <= LONGEST)
        return rows[kind]

    def chunks(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where chunks start; every text starts one."""
        opens = np.zeros(len(data), dtype=bool)
        if self.cut:
            opens[1:] = (data[1:] == 0x20) & _WORD[data[:-1]]
        opens[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(opens)

    def slice(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[tuple[int, int, int], str | None, np.ndarray]]:
        """((tokens of A, tokens of B, links), groups, pairs) of each text."""
        filled = np.flatnonzero(np.diff(offsets))
        lead = offsets[filled]
        data = np.insert(data, lead, 0x20)
        offsets = offsets + np.searchsorted(lead, offsets, side="left")
        start = self.chunks(data, offsets)
        end = np.append(start[1:], len(data))
        rows = self.rows_of(data, start, end) if len(start) else np.zeros(0, np.int64)
        bounds = np.searchsorted(start, offsets)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
        whole = np.unique(text[rows < 0])  # texts of which a chunk is not spelled
        if len(whole):
            found = self.align([data[offsets[t] : offsets[t + 1]].tobytes() for t in whole.tolist()])
            kept = ~np.isin(text, whole)
            text, rows = np.concatenate([text[kept], whole]), np.concatenate([rows[kept], np.maximum(found, 0)])
            order = np.argsort(text, kind="stable")
            text, rows = text[order], rows[order]
            bounds = np.searchsorted(text, np.arange(len(offsets)))
        sizes = self.figures[rows, 2]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        links = self.links[np.repeat(self.starts[rows] - upto[:-1], sizes) + np.arange(int(upto[-1]))]
        figures = [np.bincount(text, self.figures[rows, k], len(offsets) - 1).astype(np.int64).tolist() for k in range(3)]
        names, written = rows.tolist(), self.written.__getitem__
        for t, own in enumerate(zip(*figures, strict=True)):
            a, b = int(bounds[t]), int(bounds[t + 1])
            yield own, ";".join(map(written, names[a:b])) if own[0] else None, links[upto[a] : upto[b]]


@lru_cache(maxsize=1)
def aligner(a_file: str, b_file: str) -> Aligner:
    return Aligner(a_file, b_file)


ALIGNED = "struct<n_a:long, n_b:long, n_links:long, groups:string, pairs:binary>"


def aligned_column(text: Column, a_file: str, b_file: str) -> Column:
    """Each text's figures, its groups as ``a1,a2|b1;a3|b2,b3``, and the numbers of its linked pairs, compressed."""

    def run(texts: pa.Array) -> pa.Array:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        held, packer = aligner(a_file, b_file), zstandard.ZstdCompressor(level=1)
        figures, written, pairs = [], [], []
        for _, data, offsets in T.slices(texts, SLICE):
            for own, groups, links in held.slice(data, offsets):
                figures.append(own), written.append(groups), pairs.append(packer.compress(links.astype("<i4").tobytes()))
        columns = np.array(figures, dtype=np.int64).reshape(-1, 3)
        return pa.StructArray.from_arrays([*(pa.array(columns[:, k]) for k in range(3)), pa.array(written, pa.string()), pa.array(pairs, pa.binary())], ["n_a", "n_b", "n_links", "groups", "pairs"])

    return F.arrow_udf(run, ALIGNED)(text)


def _links(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype="<i4")


def pair_counts(aligned: DataFrame, n_pairs: int) -> np.ndarray:
    """How many links of the whole table hold each pair: a row per pair of the vocabularies at most, first summed in each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_pairs, dtype=np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                np.add.at(total, _links(raw), 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["pair", "n"])

    found = aligned.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(n_pairs, dtype=np.int64)
    counts[found["pair"].to_numpy()] = found["n"].to_numpy()
    return counts


def align(docs: DataFrame, a_file: str, b_file: str, id_column: str = "doc_id", text: str = "text", groups: Column | None = None) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each row.

    ``groups`` is what is kept of the groups, an expression over the column ``groups``; the whole if not given.  Texts
    are encoded once: figures and pairs are written to the shared folder, counted, and read again.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), aligned_column(F.col(f"`{text}`"), a_file, b_file).alias("_a")).select("_id", "_a.*")
    rows = rows.withColumn("groups", F.col("groups") if groups is None else groups)
    path = new_path(spark, "aligned")
    rows.write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    pairs = aligner(a_file, b_file).pairs
    counts = pair_counts(rows, len(pairs.codes))
    held = spark.sparkContext.broadcast((counts, pairs.best(counts)))

    def judge(column: pa.Array) -> pa.Array:
        counts, best = held.value
        links = [_links(raw) for raw in column.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([int(best[x].sum()) for x in links], pa.int64()), pa.array([int(counts[x].sum()) for x in links], pa.int64())], ["n_best", "count_sum"])

    judged = rows.withColumn("_j", F.arrow_udf(judge, "n_best long, count_sum long")("pairs"))
    return judged.select(F.col("_id").alias(id_column), "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "_j.n_best", "_j.count_sum", "groups")
