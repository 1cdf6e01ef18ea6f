"""Token ids as canonical Huffman code, in independent blocks.

``write_ids`` encodes texts with a tokenizer, counts all ids of the table, makes one
length-limited canonical Huffman code from the counts (package-merge), and writes the ids
in ascending order of the document id:

* ``code``: one row per id that occurs, with the length of its code word.  Code words are
  canonical: they follow from the lengths, by (length, id).
* ``blocks``: rows in order of ``part`` and ``block``, each with the bits of some whole
  documents (each from a full byte on), the documents' ids and numbers of ids, ``first``
  (ids before it in its part) and ``checkpoints``: the bit at which every ``LANE``-th id of
  a document starts.

Both are Parquet, so any storage that Spark writes to will do.  A block needs nothing but
the code to be read, and within it decoding may start at any checkpoint: the decoder looks
up ``LIMIT`` bits in one table, all lanes of many blocks in step.

Documents are coded before they are put in order, so only code is shuffled.
Parts are ranges of document ids; their totals, a row per part, give the position of each
document in the whole.  Null ids come first; rows with equal ids are ordered by their
code; a null text is empty and has the end id alone.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackledger.llm import textops as T
from trackledger.llm.ordering import Parts
from trackledger.llm.store import new_path

LIMIT = 18
LANE = 256
BLOCK_IDS = 1 << 16
#: Distinct chunks whose ids a worker remembers.
REMEMBERED = 1_000_000
#: Bytes of text that are cut into chunks at once; larger arrays are mapped anew by the C library each time.
SLICE = 1 << 18
#: Ids that are coded at once; a single document is never cut.
CODED = 1 << 18
#: Words that are encoded as one text.
JOINED = 500
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_WORDY = _LETTER.copy()
_WORDY[48:58] = True
#: Kinds of bytes: blanks, letters and digits, signs, and all others (apostrophes, control characters, other scripts).
_BLANK, _WORD, _SIGN, _OTHER = range(4)
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[0x21:0x80] = _SIGN
_KIND[0x27] = _OTHER
_KIND[_WORDY], _KIND[~T.NOT_BLANK] = _WORD, _BLANK
#: Whether a chunk opens at a byte, by 4 times the kind of the byte before it and its own.
_OPENS = np.zeros(16, dtype=bool)
_OPENS[[4 * a + b for a, b in ((_BLANK, _WORD), (_BLANK, _SIGN), (_BLANK, _OTHER), (_SIGN, _WORD), (_WORD, _SIGN))]] = True
#: Keeps the first bytes of eight, by how many.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: The second bytes of Latin-1 letters; the first is 0xC3.  All are as NFC leaves them.
_LATIN = np.zeros(256, dtype=bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
#: The character that the byte-level step writes for each byte; a blank stays.
_CHARS = np.arange(256, dtype="<u4")
_UNSEEN = np.array([*range(33), *range(127, 161), 173])
_CHARS[_UNSEEN] = 256 + np.arange(len(_UNSEEN))
_CHARS[0x20] = 0x20


# The normaliser and the split for which texts may be cut into chunks.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def may_be_cut(settings: dict) -> bool:
    """Whether a tokenizer file provably never joins characters over the places where chunks are cut.

    Its split keeps letters, single digits and signs apart and drops white space, so no token
    goes over a blank or from an ASCII letter or digit, or a Latin-1 letter, to an ASCII sign
    (an apostrophe may begin a contraction).  Normalising changes none of these characters
    but to lower case.
    """
    normalizer, pre = settings.get("normalizer") or {}, settings.get("pre_tokenizer") or {}
    split, *rest = pre.get("pretokenizers") or [{}]
    return (
        normalizer.get("type") == "Sequence" and normalizer.get("normalizers") == NORMALIZERS
        and pre.get("type") == "Sequence" and split.get("pattern") == {"Regex": SPLIT} and split.get("behavior") == "Removed" and split.get("invert") is True
        and [r.get("type") for r in rest] == ["ByteLevel"] and not rest[0].get("add_prefix_space") and not rest[0].get("use_regex")
        and settings.get("post_processor") is None and not settings["model"].get("dropout")
        and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in settings.get("added_tokens") or [])
    )


def word_ends(settings: dict) -> np.ndarray | None:
    """Which ids end a word, if a tokenizer file that may be cut provably ends every word of ASCII and Latin-1 letters by one, and no other place in it."""
    model = settings["model"]
    suffix, vocab = model.get("end_of_word_suffix") or "", model.get("vocab") or {}
    held = [chr(_CHARS[b]) for b in (*range(97, 123), 0xC3, *range(0x80, 0xC0))]
    if model.get("type") != "BPE" or set(suffix) <= set(held) or any(model.get(k) for k in ("continuing_subword_prefix", "byte_fallback", "ignore_merges", "dropout")):
        return None
    if not all(c in vocab and c + suffix in vocab for c in held):
        return None
    ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
    ends[[i for word, i in vocab.items() if word.endswith(suffix)]] = True
    return ends


def _latin(data: np.ndarray) -> np.ndarray:
    """Where Latin-1 letters of two bytes start."""
    at = np.flatnonzero(data[:-1] == 0xC3)
    return at[_LATIN[data[at + 1]]]


def _names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span, from its bytes by eights; of spans over ``LONG`` bytes, a digest.  Up to eight bytes, spans of one size and name are equal."""
    eights, size = T.eights(data), end - start
    names = T.mix(eights[start] & _FIRST[np.minimum(size, 8)])
    left = np.flatnonzero((size > 8) & (size <= T.LONG))
    at = 8
    while len(left):
        names[left] = T.mix(names[left] * np.uint64(5) + (eights[start[left] + at] & _FIRST[np.minimum(size[left] - at, 8)]) + T.ONE)
        at += 8
        left = left[size[left] > at]
    long = np.flatnonzero(size > T.LONG)
    names[long] = T.digests(data, start[long], end[long])
    return names


def _none_of(kind: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether spans are without bytes of a kind."""
    sums = np.zeros(len(kind) + 1, dtype=np.int64)
    np.cumsum(kind, out=sums[1:])
    return sums[end] == sums[start]


class Grown:
    """An array that grows at its end, with room ahead."""

    def __init__(self, kind: type):
        self.room, self.n = np.zeros(1 << 10, dtype=kind), 0

    def add(self, more: np.ndarray) -> None:
        n = self.n + len(more)
        if n + 8 > len(self.room):
            room = np.zeros(n + n // 2 + 8, dtype=self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : n] = more
        self.n = n

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]

    @property
    def eights(self) -> np.ndarray:
        """The eight bytes from each place on, of an array of bytes."""
        return np.ndarray(self.n + 1, "<u8", self.room, 0, (1,))


class Encoder:
    """Ids of texts as the tokenizer gives them, by way of their distinct chunks where it can be cut.

    Where ``may_be_cut`` holds, texts are cut at blanks and between ASCII words and signs, each
    distinct chunk is encoded once, and the results are put together again.  Texts that hold
    an added token, and all texts of any other tokenizer, are encoded whole.  Words of ASCII
    and Latin-1 letters are encoded many at once where ``word_ends`` tells them apart again:
    the split leaves each whole, and normalising and the byte-level step are done for all.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        settings = json.loads(Path(path).read_text(encoding="utf-8"))
        self.cut = may_be_cut(settings)
        added = [t["content"] for t in settings.get("added_tokens") or []]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))).encode()) if added else None
        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)  # for lower-case ASCII, which normalisation leaves as it is
        self.plain.normalizer = None
        self.ends = word_ends(settings) if self.cut else None
        self.words = Tokenizer.from_file(path)
        self.words.normalizer, self.words.pre_tokenizer = None, CharDelimiterSplit(" ")
        self.forget()

    def whole(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> list[np.ndarray]:
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return [np.array([*e.ids, end_id], dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def texts(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> list[bytes]:
        """The ids of each text and the end id, as little-endian unsigned 32-bit integers."""
        if not self.cut:
            return [ids.astype("<u4").tobytes() for ids in self.whole(data, offsets, end_id)]
        ids, bounds = self.encode(data, offsets, end_id)
        raw = ids.astype("<u4").tobytes()
        out = [raw[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for text in sorted({int(T.text_of(offsets, m.start())) for m in self.added.finditer(data.tobytes())} if self.added else ()):
            out[text] = self.whole(data[offsets[text] : offsets[text + 1]], np.array([0, offsets[text + 1] - offsets[text]]), end_id)[0].astype("<u4").tobytes()
        return out

    def forget(self, n: int = REMEMBERED) -> None:
        """Nothing is remembered; there is room for ``n`` chunks, at most half of the slots."""
        self.slots = np.full(1 << int(2 * max(n, REMEMBERED) - 1).bit_length(), -1, dtype=np.int32)
        self.names, self.starts, self.sizes, self.ids = Grown(np.uint64), Grown(np.int64), Grown(np.int64), Grown(np.uint32)
        self.places, self.lengths, self.spelled = Grown(np.int64), Grown(np.int64), Grown(np.uint8)  # the chunks' lower-case bytes

    def _slot(self, names: np.ndarray) -> np.ndarray:
        return (names & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, names: np.ndarray) -> np.ndarray:
        """The row of a chunk of each hash, or -1."""
        at, found, left = self._slot(names), np.full(len(names), -1, dtype=np.int64), np.arange(len(names))
        while len(left):
            row = self.slots[at[left]]
            left, row = left[row >= 0], row[row >= 0]
            same = self.names.room[row] == names[left]
            found[left[same]] = row[same]
            left = left[~same]
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
        return found

    def remember(self, names: np.ndarray, rows: np.ndarray) -> None:
        at, left = self._slot(names), np.arange(len(names))
        while len(left):
            own = left[self.slots[at[left]] < 0]
            self.slots[at[own]] = rows[own]
            left = left[self.slots[at[left]] != rows[left]]
            at[left] = (at[left] + 1) & (len(self.slots) - 1)

    def chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = _KIND[data]
        latin = _latin(data)
        kind[latin] = kind[latin + 1] = _WORD
        inside = kind != _BLANK
        opens = np.zeros(len(data), dtype=bool)
        opens[1:] = _OPENS[4 * kind[:-1] + kind[1:]]
        at = offsets[:-1][offsets[:-1] < len(data)]
        opens[at] = inside[at]
        closes = inside  # and what follows is blank, or opens another
        closes[:-1] &= opens[1:] | (kind[1:] == _BLANK)
        return np.flatnonzero(opens), np.flatnonzero(closes) + 1

    def joined(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, how many each has) of words of ASCII and Latin-1 letters; none if they cannot be told apart."""
        n, size = len(start), end - start
        to = np.cumsum(size + 1)  # after the blank that ends a word
        each = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        text = np.full(int(to[-1]) if n else 0, 0x20, dtype=np.uint8)
        text[each + np.repeat(to - size - 1, size)] = T.LOWER[data[each + np.repeat(start, size)]]
        upper = np.flatnonzero((text[:-1] == 0xC3) & (text[1:] <= 0x9E)) + 1
        text[upper[text[upper] >= 0x80]] += 0x20
        chars = _CHARS[text].tobytes().decode("utf-32-le")
        bounds = [0, *to[JOINED - 1 : n - 1 : JOINED].tolist(), len(chars)]
        found = self.words.encode_batch_fast([chars[a : b - 1] for a, b in zip(bounds[:-1], bounds[1:], strict=True)] if n else [], add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, dtype=np.uint32) for e in found)])
        last = np.flatnonzero(self.ends[ids])
        return (ids, np.diff(last, prepend=-1)) if len(last) == n else None

    def learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Encodes chunks; the row of each."""
        ascii_only = _none_of(data >= 0x80, start, end)
        words, found = np.zeros(len(start), dtype=bool), None
        if self.ends is not None:
            other = ~_LETTER[data]
            latin = _latin(data)
            other[latin] = other[latin + 1] = False
            words = _none_of(other, start, end)
            found = self.joined(data, start[words], end[words])
            if found is None:
                words[:] = False
        ids, counts = found or (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        ascii_only &= ~words
        order = np.concatenate([np.flatnonzero(words), np.flatnonzero(ascii_only), np.flatnonzero(~words & ~ascii_only)])
        start, end, n, of_ascii = start[order], end[order], len(counts), int(ascii_only.sum())
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(start[n:].tolist(), end[n:].tolist(), strict=True)]
        rest = [e.ids for e in self.plain.encode_batch_fast([w.lower() for w in texts[:of_ascii]], add_special_tokens=False)]
        rest += [e.ids for e in self.tokenizer.encode_batch_fast(texts[of_ascii:], add_special_tokens=False)]
        sizes = np.concatenate([counts, np.array([len(x) for x in rest], dtype=np.int64)])
        rows = np.empty(len(order), dtype=np.int64)
        rows[order] = self.starts.n + np.arange(len(order))
        self.starts.add(self.ids.n + np.cumsum(sizes) - sizes), self.sizes.add(sizes)
        self.ids.add(ids), self.ids.add(np.fromiter(chain.from_iterable(rest), np.uint32, int(sizes[n:].sum())))
        size = end - start
        before = np.cumsum(size) - size
        self.places.add(self.spelled.n + before), self.lengths.add(size)
        self.spelled.add(T.LOWER[data[np.repeat(start - before, size) + np.arange(int(size.sum()))]])
        return rows

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, the end id after each, and their bounds."""
        n = len(offsets) - 1
        start, end = self.chunks(data, offsets)
        lower = T.LOWER[data]
        names = _names(lower, start, end)
        row = self.find(names)
        hit = np.flatnonzero(row >= 0)
        at, size = row[hit], end[hit] - start[hit]
        same = size == self.lengths.all[at]
        long = np.flatnonzero(same & (size > 8))  # up to eight bytes, names and sizes tell all chunks apart
        same[long] = T.same_bytes(lower, size[long], start[hit[long]], self.places.all[at[long]], self.spelled.eights)
        row[hit[~same]] = -1  # another chunk of the same hash
        new = np.flatnonzero(row < 0)
        if len(new):
            known, example, kind = T.span_classes(lower, start[new], end[new], hashes=names[new])
            if self.starts.n + len(known) > REMEMBERED:
                new = np.arange(len(start))
                known, example, kind = T.span_classes(lower, start, end, hashes=names)
                self.forget(len(known))
            first = new[example]
            rows = self.learn(data, start[first], end[first])
            self.names.add(np.zeros(len(rows), np.uint64))
            self.names.all[rows] = known
            true = known == names[first]  # others are never looked for
            self.remember(known[true], rows[true])
            row[new] = rows[kind]
        size = self.sizes.all[row]
        done = np.concatenate([[0], np.cumsum(size)])  # ids before each chunk
        bounds = done[np.searchsorted(start, offsets)] + np.arange(n + 1)
        own = np.ones(int(bounds[-1]), dtype=bool)
        own[bounds[1:] - 1] = False
        out = np.full(len(own), end_id, dtype=np.uint32)
        out[own] = self.ids.all[np.repeat(self.starts.all[row] - done[:-1], size) + np.arange(int(done[-1]))]
        return out, bounds


_ENCODERS: dict[str, Encoder] = {}


def encode_column(text: Column, tokenizer_file: str, end_id: int) -> Column:
    """The ids of each text and the end id, as little-endian unsigned 32-bit integers."""

    def encode(texts: pa.Array) -> pa.Array:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer_file not in _ENCODERS:
            _ENCODERS[tokenizer_file] = Encoder(tokenizer_file)
        out = []
        for _, data, offsets in T.slices(texts, SLICE):
            out += _ENCODERS[tokenizer_file].texts(data, offsets, end_id)
        return pa.array(out, pa.binary())

    return F.arrow_udf(encode, "binary")(F.coalesce(text, F.lit("")))


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The optimal code lengths up to ``limit`` bits for symbols with these counts, all above 0."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, dtype=np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit in {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    levels, packages = [], np.zeros(0, dtype=np.int64)
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        sort = np.argsort(both, kind="stable")
        levels.append(sort < n)
        both = both[sort]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        own = int(is_leaf[:take].sum())
        lengths[order[:own]] += 1
        take = 2 * (take - own)
    return lengths


class Code:
    """A canonical code: symbols by (length, symbol) get consecutive code words."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((symbols, lengths))
        self.symbols, self.lengths = symbols[order].astype(np.int64), lengths[order].astype(np.int64)
        self.limit = int(self.lengths.max()) if len(lengths) else 1
        widths = np.int64(1) << (self.limit - self.lengths)
        left = np.cumsum(widths) - widths  # code words, filled up with zeros to ``limit`` bits
        size = int(self.symbols.max()) + 1 if len(symbols) else 0
        self.word, self.length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.word[self.symbols] = (left >> (self.limit - self.lengths)).astype(np.uint64)
        self.length[self.symbols] = self.lengths
        self.look_up = np.zeros(1 << self.limit, dtype=np.int64)  # index in ``symbols`` for the next ``limit`` bits
        self.look_up[: int(widths.sum())] = np.repeat(np.arange(len(left)), widths)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of the ids, and the bit at which every lane starts."""
        (payload,), starts, _ = self.encode_all(ids, np.array([0, len(ids)]))
        return payload, starts

    def encode_all(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The bits of each document from a full byte on, the bits in it at which its lanes start, and how many lanes each has."""
        length = self.length[ids]
        done = np.concatenate([[0], np.cumsum(length)])  # bits before each id
        sizes = np.diff(bounds)
        size = (np.diff(done[bounds]) + 7) // 8
        place = np.concatenate([[0], np.cumsum(size)])  # the byte at which each document starts
        start = done[:-1] + np.repeat(8 * place[:-1] - done[bounds[:-1]], sizes)
        word, shift = start >> 5, (start & 31).astype(np.uint64)
        value = self.word[ids] << (np.uint64(64) - shift - length.astype(np.uint64))
        n = int(place[-1] >> 2) + 3
        out = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n)
        out += np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        raw = out.astype(">u4").tobytes()
        lanes = -(-sizes // LANE)
        first = np.repeat(bounds[:-1] - LANE * (np.cumsum(lanes) - lanes), lanes) + LANE * np.arange(int(lanes.sum()))
        starts = start[first] - np.repeat(8 * place[:-1], lanes)
        return [raw[a:b] for a, b in zip(place[:-1].tolist(), place[1:].tolist(), strict=True)], starts, lanes

    def decode(self, payloads: list[bytes], checkpoints: list[np.ndarray], doc_sizes: list[list[int]]) -> list[np.ndarray]:
        """The ids of each block, given the sizes of its documents; all lanes of all blocks advance together."""
        padded = [p + b"\0" * (16 - len(p) % 8) for p in payloads]
        base = np.cumsum([0, *(len(p) for p in padded)])[:-1] * 8
        words = np.frombuffer(b"".join(padded) + b"\0" * 8, dtype=">u4").astype(np.uint64)
        at = np.concatenate([c + b for c, b in zip(checkpoints, base, strict=True)])
        docs = np.array([n for own in doc_sizes for n in own], dtype=np.int64)
        lanes = -(-docs // LANE)  # of each document
        place = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        sizes = np.minimum(LANE, np.repeat(docs, lanes) - place * LANE)
        begin = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), dtype=np.uint32)
        lanes = np.argsort(-sizes, kind="stable")
        at, left = at[lanes], sizes[lanes]
        drop = np.uint64(64 - self.limit)
        for step in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -step, side="left"))  # lanes with more than ``step`` ids
            here = at[:live]
            word = here >> 5
            window = (words[word] << np.uint64(32) | words[word + 1]) << (here & 31).astype(np.uint64)
            found = self.look_up[window >> drop]
            out[begin[lanes[:live]] + step] = self.symbols[found]
            at[:live] += self.lengths[found]
        return np.split(out, np.cumsum([sum(own) for own in doc_sizes])[:-1])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, dtype=np.int64)
    for batch in batches:
        n = np.bincount(_ids(batch.column(0)))
        if len(n) > len(total):
            n, total = total, n
        total[: len(n)] += n
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])


def _ids(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4")


_BLOCK = "part int, block int, first long, doc_ids array<{kind}>, doc_sizes array<long>, n_ids long, checkpoints array<long>, payload binary"


def coded_column(ids: Column, code: Code, spark: SparkSession) -> Column:
    """struct(payload, n, checkpoints): each document's ids as whole bytes of code."""
    held = spark.sparkContext.broadcast(code)

    def encode(rows: pa.Array) -> pa.Array:
        payloads, sizes, lanes, checkpoints = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, data, offsets in T.slices(rows, 4 * CODED):
            bounds = offsets // 4
            bits, starts, each = held.value.encode_all(data.view("<u4"), bounds)
            payloads += bits
            sizes.append(np.diff(bounds)), checkpoints.append(starts), lanes.append(each)
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(lanes))]).astype(np.int32)
        starts = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(checkpoints)))
        return pa.StructArray.from_arrays([pa.array(payloads, pa.binary()), pa.array(np.concatenate(sizes)), starts], ["payload", "n", "checkpoints"])

    return F.arrow_udf(encode, "payload binary, n long, checkpoints array<long>")(ids)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Coded documents come in order; a block ends with the document that fills it, or with its part."""
    part, block, first = None, 0, 0
    names: list = []
    sizes: list[int] = []
    payloads: list[bytes] = []
    checkpoints: list[np.ndarray] = []
    filled = total = 0  # bytes and ids

    def closed() -> pa.RecordBatch:
        values = [[part], [block], [first], [names], [sizes], [total], [np.concatenate(checkpoints)], [b"".join(payloads)]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(kind), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], [f.split()[0] for f in _BLOCK.split(", ")])

    for batch in batches:
        kind = batch.schema.field("id").type
        for own, name, payload, n, starts in zip(*(batch.column(c).to_pylist() for c in ("part", "id", "payload", "n", "checkpoints")), strict=True):
            if sizes and (own != part or total >= BLOCK_IDS):
                yield closed()
                block, first = block + 1, first + total
                names, sizes, payloads, checkpoints, filled, total = [], [], [], [], 0, 0
            if own != part:
                part, block, first = own, 0, 0
            names.append(name), sizes.append(n), payloads.append(payload)
            checkpoints.append(np.array(starts, dtype=np.int64) + 8 * filled)
            filled += len(payload)
            total += n
    if sizes:
        yield closed()


def write_ids(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, id_column: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of all documents under ``path``."""
    spark = docs.sparkSession
    kept = new_path(spark, "ids")
    ids = docs.select(F.col(id_column).alias("id"), encode_column(F.col(text), tokenizer_file, end_id).alias("ids"))
    ids.write.option("compression", "zstd").parquet(kept)  # texts are encoded once
    ids = spark.read.schema(ids.schema).parquet(kept)
    counts = ids.select("ids").mapInArrow(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # a row per id of the vocabulary
    symbols, n = counts["id"].to_numpy(), counts["n"].to_numpy()
    order = np.argsort(symbols)
    symbols, n = symbols[order], n[order]
    lengths = code_lengths(n, max(LIMIT, int(len(n)).bit_length()))
    spark.createDataFrame(pa.table({"id": symbols, "length": lengths})).coalesce(1).write.parquet(f"{path}/code")
    code = Code(symbols, lengths)
    parts = Parts(ids, "id")
    coded = ids.select("id", parts.column(F.col("id")).alias("part"), coded_column(F.col("ids"), code, spark).alias("c")).select("id", "part", "c.*")
    rows = coded.repartition(parts.count, "part").sortWithinPartitions("part", "id", "payload")
    kind = ids.schema["id"].dataType.simpleString()
    rows.mapInArrow(_blocks, _BLOCK.format(kind=kind)).write.parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, ids) of each document: its ids as written, and how many ids all documents before it have."""
    table = spark.read.parquet(f"{path}/code").toArrow()
    code = spark.sparkContext.broadcast(Code(table["id"].to_numpy(), table["length"].to_numpy()))
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                rows = batch.slice(at, 16)
                checkpoints = [np.array(x, dtype=np.int64) for x in rows.column("checkpoints").to_pylist()]
                found = code.value.decode(rows.column("payload").to_pylist(), checkpoints, rows.column("doc_sizes").to_pylist())
                for k, ids in enumerate(found):
                    sizes = np.array(rows.column("doc_sizes")[k].as_py(), dtype=np.int64)
                    start = np.cumsum(sizes) - sizes
                    raw = ids.astype("<u4").tobytes()
                    texts = [raw[4 * a : 4 * (a + n)] for a, n in zip(start.tolist(), sizes.tolist(), strict=True)]
                    names = rows.column("doc_ids").slice(k, 1).flatten()
                    part = pa.array(np.full(len(texts), rows.column("part")[k].as_py(), dtype=np.int32))
                    start = pa.array(start + rows.column("first")[k].as_py())
                    yield pa.RecordBatch.from_arrays([names, part, start, pa.array(texts, pa.binary())], ["id", "part", "start", "ids"])

    out = blocks.mapInArrow(read, f"id {kind}, part int, start long, ids binary")
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row per part
    before = np.cumsum([0, *(r["n"] for r in totals)])
    base = spark.createDataFrame([(r["part"], n) for r, n in zip(totals, before.tolist(), strict=False)], "part int, base long")
    return out.join(F.broadcast(base), "part").select("id", (F.col("start") + F.col("base")).alias("start"), "ids")  # a row per part
