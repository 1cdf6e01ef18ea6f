"""SentencePiece encoding with sampled segmentations, and decoding.

The pieces come from a SentencePiece model file; it is never trained here.  A BPE model
has no piece probabilities, so a piece's weight follows its merge rank by Zipf's law,
``1 / (rank + SHIFT)``; characters without a piece of their own are spelled in byte
pieces, each far less likely than any piece.  All ways to cut a text into pieces form a
lattice, and each has a probability.

Of these segmentations ``k`` distinct ones are drawn without replacement by the Gumbel
top-k rule: every segmentation's log-probability is perturbed by its own Gumbel noise,
and the k largest win.  The search is top-down.  The largest perturbed value of the whole
lattice is drawn first and follows one sampled path; what branches off that path, step
by step, has its own largest value, drawn below that of the path.  A heap holds the
branches; each pop is the next largest value overall, is completed into a path, and
leaves its own branches behind.  The value on top of the heap at the end is the threshold
that gives each drawn segmentation its inclusion score ``1 - exp(-exp(log_prob - threshold))``.

All noise comes from a hash of the seed, the row key and the place of the draw: the same
key and text always give the same result, wherever the row is processed.

Pieces never go over the start of a run of blanks, so the lattice of a text is a chain of
the lattices of its chunks; each distinct chunk is built once per slice of rows.

Null and empty texts have one segmentation, without pieces.  Texts with fewer than k
segmentations give all of them.  Repeated rows give equal results, null keys count as one
key.  Decoding inverts any drawn segmentation exactly, also for texts that contain the
blank's piece character themselves.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from trackledger.llm import textops as T

SHIFT = 20.0
BYTE_LOG_PROB = -16.0
SLICE = 1 << 19
#: A draw below the largest possible one by this much can't win with 53-bit noise.
REACH = 42.0
_BLANK = "▁"
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
SAMPLES = "array<struct<sample:int, ids:array<int>, log_prob:double, perturbed:double, log_inclusion:double>>"


class Pieces:
    """The pieces of a model file: their bytes (blanks as 0x20), weights and byte fallbacks."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        self.raw = [b""] * n
        self.byte_id = np.full(256, -1, dtype=np.int32)
        ranked = []
        for i in range(n):
            if special[i]:
                continue
            name = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(name[3:5], 16)] = i
                self.raw[i] = bytes([int(name[3:5], 16)])
            else:
                self.raw[i] = name.replace(_BLANK, " ").encode()
                ranked.append(i)
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces; some texts could not be spelled")
        weight = 1.0 / (np.arange(len(ranked)) + SHIFT)
        self.log_prob = np.full(n, BYTE_LOG_PROB)
        self.log_prob[ranked] = np.log(weight / weight.sum())
        self.lengths = np.array([len(x) for x in self.raw])
        self.blob = np.frombuffer(b"".join(self.raw), dtype=np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.by_length: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]] = []
        ranked = np.array(ranked)
        self.longest = int(max(4, self.lengths[ranked].max()))
        for size in sorted(set(self.lengths[ranked].tolist())):
            ids = ranked[self.lengths[ranked] == size]
            sums = T.prefix_sums(np.concatenate([self.blob[self.starts[i] : self.starts[i] + size] for i in ids]))
            at = np.arange(len(ids)) * size
            hashes = (sums[at + size] - sums[at]) * T.inverse_powers(at)
            order = np.argsort(_bits(hashes), kind="stable")
            bits = _bits(hashes[order])
            first = np.full(1 << _TABLE, -1, dtype=np.int32)
            first[bits[::-1]] = np.arange(len(ids) - 1, -1, -1)  # the first piece in each place of the table
            most = int(np.bincount(bits.astype(np.int64)).max())
            self.by_length.append((size, hashes[order], ids[order], first, most))


_TABLE = 16


def _bits(hashes: np.ndarray) -> np.ndarray:
    return (hashes * _C[0]) >> np.uint64(64 - _TABLE)


@lru_cache(maxsize=2)
def pieces(model_file: str) -> Pieces:
    return Pieces(model_file)


def uniform(key: np.ndarray, *place) -> np.ndarray:
    """Noise in (0, 1) for a key and a place."""
    x = key
    for p, c in zip(place, _C[1:], strict=False):
        x = T.mix(x + np.asarray(p).astype(np.uint64) * c + c)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Lattice:
    """The lattices of chunks that lie one after the other in ``data``; edges are grouped by their start."""

    def __init__(self, model: Pieces, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.model, self.data = model, data
        size = len(data)
        end_of = np.repeat(end, end - start)
        sums = T.prefix_sums(data)
        first = (data & 0xC0) != 0x80
        width = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
        spelled = first.copy()
        found = []  # (starts, length or lengths, pieces), shorter ones first
        at = np.flatnonzero(first)
        down = T.inverse_powers(at)
        for length, hashes, ids, table, most in model.by_length:
            fits = at + length <= end_of[at]
            if not fits.all():
                at, down = at[fits], down[fits]
            if not len(at):
                break
            here = (sums[at + length] - sums[at]) * down
            k = table[_bits(here)]
            maybe = np.flatnonzero(k >= 0)
            k, here, start_of = k[maybe], here[maybe], at[maybe]
            hit = hashes[k] == here
            for more in range(1, most):  # other pieces in the same place
                miss = np.flatnonzero(~hit)
                again = np.minimum(k[miss] + more, len(hashes) - 1)
                same = hashes[again] == here[miss]
                k[miss[same]] = again[same]
                hit[miss[same]] = True
            start_of, k = start_of[hit], k[hit]
            spelled[start_of[width[start_of] == length]] = False
            found.append((start_of, length, ids[k]))
        at = np.flatnonzero(spelled)
        found.insert(0, (at, width[at], -1))  # no other edge from here is as short
        self.count = np.zeros(size, np.int64)
        for start_of, _, _ in found:
            self.count[start_of] += 1
        far = end_of - np.arange(size)
        node = np.flatnonzero(self.count)  # nearest to the chunk's end first, then by place
        node = node[np.argsort(far[node].astype(np.uint16) if far.max(initial=0) < 1 << 16 else far[node], kind="stable")]
        new = np.cumsum(self.count[node]) - self.count[node]
        self.first = np.zeros(size, np.int64)
        self.first[node] = new
        edges = int(self.count.sum())
        self.frm = np.repeat(node, self.count[node])
        self.to, self.name, free = np.zeros(edges, np.int64), np.zeros(edges, np.int64), self.first.copy()
        for start_of, length, names in found:
            place = free[start_of]
            self.to[place], self.name[place] = start_of + length, names
            free[start_of] += 1
        self.last = self.to == end_of[self.frm]
        log_p = np.where(self.name < 0, BYTE_LOG_PROB * (self.to - self.frm), model.log_prob[self.name])
        ahead = np.zeros(size + 1)  # log of the sum over all ways from here to the chunk's end
        far = far[node]
        steps = np.flatnonzero(np.concatenate([[True], far[1:] != far[:-1]])) if len(new) else []
        value = np.empty(len(self.frm))
        for a, b in zip(steps, [*steps[1:], len(new)], strict=True):
            e0, e1 = new[a], new[b] if b < len(new) else len(self.frm)
            value[e0:e1] = log_p[e0:e1] + np.where(self.last[e0:e1], 0.0, ahead[self.to[e0:e1]])
            ahead[self.frm[new[a:b]]] = np.logaddexp.reduceat(value[e0:e1], new[a:b] - e0)
        self.log_p = np.minimum(value - ahead[self.frm], 0.0)
        self.p = np.exp(self.log_p)
        self.upto = np.cumsum(self.p)

    def walk(self, at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled edges from each place to the end of its chunk, and the bounds per place."""
        taken = []
        active, now, step = np.arange(len(at)), at, 0
        count = np.zeros(len(at) + 1, np.int64)
        while len(active):
            first = self.first[now]
            target = self.upto[first] - self.p[first] + uniform(key[active], step)
            edge = first + self.count[now] - 1  # the longest piece comes last and mostly is the likeliest
            back = np.flatnonzero((edge > first) & (target < self.upto[edge - 1]))
            while len(back):
                edge[back] -= 1
                e = edge[back]
                back = back[(e > first[back]) & (target[back] < self.upto[e - 1])]
            taken.append((active, edge))
            on = ~self.last[edge]
            count[active + 1] += 1
            active, now, step = active[on], self.to[edge[on]], step + 1
        bounds = np.cumsum(count)
        edges = np.zeros(int(bounds[-1]), np.int64)
        for step, (active, edge) in enumerate(taken):
            edges[bounds[active] + step] = edge
        return edges, bounds

    def ids(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the edges, and how many each has (a spelled character has one per byte)."""
        out = self.name[edges].astype(np.int32)
        spelled = np.flatnonzero(out < 0)
        count = np.ones(len(edges), np.int64)
        if not len(spelled):
            return out, count
        start, size = self.frm[edges[spelled]], (self.to - self.frm)[edges[spelled]]
        count[spelled] = size
        out = np.repeat(out, count)
        byte = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        out[out < 0] = self.model.byte_id[self.data[byte]]
        return out, count


class Paths:
    """Parts of paths, one after the other: part i holds ``edges[bounds[i]:bounds[i + 1]]`` and starts at ``step[i]``."""

    def __init__(self, lattice: Lattice, edges: np.ndarray, bounds: np.ndarray, step: np.ndarray, before: np.ndarray):
        self.edges, self.bounds, self.step = edges, bounds, step
        self.log_p = lattice.log_p[edges]
        upto = np.concatenate([[0.0], np.cumsum(self.log_p)])
        self.who = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.ahead = upto[:-1] + (before - upto[bounds[:-1]])[self.who]  # log-probability of the path before each edge
        self.total = before + upto[bounds[1:]] - upto[bounds[:-1]]
        with np.errstate(divide="ignore"):
            self.mass = self.ahead + np.log1p(-lattice.p[edges])

    def branches(self, top: np.ndarray, keys: np.ndarray, sample: int, most: int) -> tuple[np.ndarray, ...]:
        """(part, -value, step, mass) of what leaves the paths at each of their steps, drawn below ``top``.

        Of each part the ``most`` largest are kept: no more draws follow, so no other can be one.
        """
        filled = np.flatnonzero(np.diff(self.bounds))
        largest = np.full(len(self.bounds) - 1, -np.inf)
        if len(filled):
            largest[filled] = np.maximum.reduceat(self.mass, self.bounds[:-1][filled])
        at = np.flatnonzero((self.mass > -np.inf) & (self.mass >= largest[self.who] - REACH))
        who = self.who[at]
        step = at - self.bounds[who] + self.step[who]
        noise = np.log(-np.log(uniform(keys[who], sample, step, 1)))
        value = np.logaddexp(-top[who], noise - self.mass[at])
        first = np.flatnonzero(np.diff(who, prepend=-1))
        each = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(who))))
        chosen, open_ = [], value.copy()
        for _ in range(most if len(first) else 0):
            best = np.flatnonzero((open_ == np.minimum.reduceat(open_, first)[each]) & (open_ < np.inf))
            best = best[np.diff(who[best], prepend=-1) > 0]
            chosen.append(best)
            open_[best] = np.inf
        order = np.concatenate(chosen) if chosen else first
        return who[order], value[order], step[order], self.mass[at[order]]


def sample_slice(model: Pieces, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, k: int) -> list[list[tuple]]:
    """For each text, the drawn (ids, log_prob, perturbed, log_inclusion), the largest perturbed value first."""
    n = len(offsets) - 1
    filled = np.flatnonzero(np.diff(offsets))
    lead = offsets[filled]
    data = np.insert(data, lead, 0x20)
    offsets = offsets + np.searchsorted(lead, offsets, side="left")
    out: list[list[tuple]] = [[(np.zeros(0, np.int32), 0.0, 0.0, 0.0)] for _ in range(n)]
    if not len(filled):
        return out
    blank = data == 0x20
    opens = blank.copy()
    opens[1:] &= ~blank[:-1]
    opens[offsets[filled]] = True
    start = np.flatnonzero(opens)
    end = np.concatenate([start[1:], [len(data)]])
    _, example, kind = T.span_classes(data, start, end)
    size = end[example] - start[example]
    place = np.cumsum(size) - size
    own = np.repeat(start[example] - place, size) + np.arange(int(size.sum()))
    lattice = Lattice(model, data[own], place, place + size)
    entry = place[kind]  # where each chunk of the texts enters its lattice
    text = T.text_of(offsets, start)
    bounds = np.searchsorted(start, offsets)
    number = np.arange(len(start)) - bounds[text]
    walk_key = lambda chunks, sample: T.mix(keys[text[chunks]] + np.uint64(sample * int(_C[1]) % 2**64) + number[chunks].astype(np.uint64) * _C[2])
    edges, cut = lattice.walk(entry, walk_key(np.arange(len(start)), 0))
    roots = -np.log(-np.log(uniform(keys, 0, 0, 2)))
    paths: dict[int, list] = {t: [] for t in filled.tolist()}
    heaps: dict[int, list] = {t: [] for t in filled.tolist()}

    def branch(found: Paths, texts: np.ndarray, heads: list[np.ndarray], top: np.ndarray, sample: int) -> None:
        """Takes one new path of each text (a head and a found part), and puts its branches on the text's heap."""
        for t, head, a, b, log_p, value in zip(texts.tolist(), heads, found.bounds[:-1].tolist(), found.bounds[1:].tolist(), found.total.tolist(), top.tolist(), strict=True):
            tail = found.edges[a:b]
            paths[t].append((np.concatenate([head, tail]) if len(head) else tail, log_p, value))
        who, value, step, mass = found.branches(top, keys[texts], sample, k - sample)
        for t, v, at, m in zip(texts[who].tolist(), value.tolist(), step.tolist(), mass.tolist(), strict=True):
            heapq.heappush(heaps[t], (v, len(paths[t]) - 1, at, m, (int(paths[t][-1][0][at]),)))

    none = np.zeros(len(filled), np.int64)
    branch(Paths(lattice, edges, cut[np.append(bounds[filled], len(start))], none, none.astype(float)), filled, [edges[:0]] * len(filled), roots[filled], 0)
    for sample in range(1, k):
        live = [t for t in filled.tolist() if heaps[t]]
        if not live:
            break
        popped = [heapq.heappop(heaps[t]) for t in live]
        steps, key = np.array([x[2] for x in popped]), keys[live]
        draws, others = uniform(key, sample, steps, 3).tolist(), np.log(-np.log(uniform(key, sample, steps, 4))).tolist()
        heads, at, who, values = [], [], [], []
        for t, (value, old, step, mass, taken), draw, other in zip(live, popped, draws, others, strict=True):
            path = paths[t][old][0]
            here = int(lattice.frm[path[step]])
            first = int(lattice.first[here])
            choices = [c for c in range(first, first + int(lattice.count[here])) if c not in taken]
            p = lattice.p[choices]
            upto = list(accumulate(p.tolist()))
            nth = min(bisect_right(upto, draw * upto[-1]), len(choices) - 1)
            pick = choices[nth]
            if len(choices) > 1 and upto[-1] > p[nth]:
                rest = mass - np.log(upto[-1]) + np.log(upto[-1] - p[nth])
                heapq.heappush(heaps[t], (float(np.logaddexp(value, other - rest)), old, step, float(rest), (*taken, pick)))
            where = bounds[t] + int(np.count_nonzero(lattice.last[path[:step]]))  # the chunk of that step
            chunks = np.arange(where + 1, bounds[t + 1])
            enter = entry[chunks]
            if not lattice.last[pick]:
                chunks, enter = np.concatenate([[where], chunks]), np.concatenate([[lattice.to[pick]], enter])
            heads.append(np.append(path[:step], pick))
            at.append(enter), who.append(chunks), values.append(-value)
        counts = np.cumsum([0, *(len(x) for x in who)])
        who = np.concatenate(who)
        edges, cut = lattice.walk(np.concatenate(at), walk_key(who, sample))
        before = np.array([float(lattice.log_p[h].sum()) for h in heads])
        sizes = np.array([len(h) for h in heads])
        branch(Paths(lattice, edges, cut[counts], sizes, before), np.array(live), heads, np.array(values), sample)
    ids, counts = lattice.ids(np.concatenate([path for t in filled.tolist() for path, *_ in paths[t]]))
    upto = np.concatenate([[0], np.cumsum(counts)])
    done = 0
    for t in filled.tolist():
        threshold = -heaps[t][0][0] if heaps[t] else -np.inf
        out[t] = []
        for path, log_p, value in paths[t]:
            own = ids[upto[done] : upto[done + len(path)]]
            done += len(path)
            out[t].append((own, log_p, value, _log_inclusion(log_p - threshold)))
    return out


def _log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x)))"""
    if x < -30:
        return float(x)
    return float(np.log(-np.expm1(-np.exp(x)))) if x < 4 else 0.0


def encode_column(text: Column, key: Column, model_file: str, k: int = 2, seed: int = 1) -> Column:
    """The k drawn segmentations of each text, as ``SAMPLES``."""

    def encode(texts: pa.Array, keys: pa.Array) -> pa.Array:
        model = pieces(model_file)
        hashed = T.mix(keys.to_numpy(zero_copy_only=False).view(np.uint64) + T.seeded(seed))
        counts, ids, sizes, numbers = [], [], [], [[], [], [], []]
        for row, data, offsets in T.slices(texts, SLICE):
            for found in sample_slice(model, data, offsets, hashed[row : row + len(offsets) - 1], k):
                counts.append(len(found))
                for sample, (own, *figures) in enumerate(found, 1):
                    ids.append(own), sizes.append(len(own))
                    for column, x in zip(numbers, (sample, *figures), strict=True):
                        column.append(x)
        lists = pa.ListArray.from_arrays(pa.array(_bounds(sizes)), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
        columns = [pa.array(numbers[0], pa.int32()), lists, *(pa.array(x, pa.float64()) for x in numbers[1:])]
        rows = pa.StructArray.from_arrays(columns, ["sample", "ids", "log_prob", "perturbed", "log_inclusion"])
        return pa.ListArray.from_arrays(pa.array(_bounds(counts)), rows)

    return F.arrow_udf(encode, SAMPLES)(text, F.xxhash64(key))


def _bounds(sizes: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)


def decode_ids(model: Pieces, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
    """The texts whose ids are ``ids[bounds[i]:bounds[i + 1]]``, one at a time."""
    raw = model.raw.__getitem__
    return [b"".join(map(raw, ids[a:b].tolist()))[1:].decode("utf-8", "replace") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def decode_column(ids: Column, model_file: str) -> Column:
    """The text of each list of ids; a null list stays null."""

    def decode(lists: pa.Array) -> pa.Array:
        bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))])
        texts = decode_ids(pieces(model_file), lists.flatten().to_numpy(zero_copy_only=False), bounds)
        return pa.array([x if v else None for x, v in zip(texts, lists.is_valid().to_pylist(), strict=True)], pa.string())

    return F.arrow_udf(decode, "string")(ids)


def ids_crc32(ids: Column) -> Column:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def crc(lists: pa.Array) -> pa.Array:
        import zlib

        values = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))])
        return pa.array([zlib.crc32(values[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.int64())

    return F.arrow_udf(crc, "long")(ids)
