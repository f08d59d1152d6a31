"""Sampled SentencePiece segmentations without replacement, and decoding.

A text's segmentations form a lattice: places between characters, pieces as edges. An edge weighs its piece's probability to a
power; sums over all ways to the end of a unit (a run of space marks and what follows it, which no piece crosses) turn weights into
exact branch probabilities. Gumbel top-k: the k segmentations with the highest perturbed log-probabilities are a sample of k
without replacement. Perturbed A-star search finds them: a subtree's bound is the maximum of its perturbed leaves, drawn as a
truncated Gumbel variable, so the search walks straight to its best leaf, and the branches left aside on the way become new
subtrees with bounds of their own. The (k+1)-th bound is the threshold of the inclusion scores: 1 - exp(-exp(log p - threshold)). Their
logarithms are given too, as the score of a long text is below the smallest double.

Random numbers are hashes of the row's key, the sample's number and the place, so they depend on nothing else.

The model is a published BPE vocabulary: its scores are merge ranks, taken as Zipf's law, p ~ 1 / (rank + 10). Characters without
a piece become their bytes, and so does a literal U+2581, so decoding gives back every text exactly.

Cases: a null text has no segmentation (null); an empty text has one, of the lone space mark. A text with fewer than k segmentations has
all of them, with inclusion score 1. A null key counts as 0. Equal keys with equal texts get equal samples; other columns pass through.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice
from itertools import count as numbers

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import chunks, free_name, mix, released, small_batches, unit

MARK, LITERAL = "▁", "\udfff"
UNITS = re.compile("\n|▁+[^▁\n]*|[^▁\n]+")
SAMPLE = "array<struct<ids:array<int>,log_p:double,perturbed:double,inclusion:double,log_inclusion:double>>"
#: Characters of texts sampled together, and of the distinct units that a lattice may hold before it is begun anew.
CHUNK, KEEP = 1 << 18, 1 << 19
BASE, SEED = 0x9E3779B97F4A7C15, 0xCBF29CE484222325
ROUND, PLACE = 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7


class Pieces:
    """Pieces of a model file by the hash of their characters; ids of bytes."""

    def __init__(self, path: str, power: float):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        own = {p.piece: (i, power * -np.log(10 - p.score)) for i, p in enumerate(model.pieces) if p.type == 1 and MARK not in p.piece.lstrip(MARK)}
        self.byte = np.zeros(256, np.int32)
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte[int(p.piece[3:5], 16)] = i
        self.byte_weight = power * -np.log(10 + len(model.pieces))
        self.longest = max(map(len, own))
        # every beginning of a piece has an entry, so a way that leads to no piece ends early; id -1: no piece itself
        begun = dict.fromkeys(p[:i] for p in own for i in range(1, len(p) + 1))
        h = np.array([self.hash(p) for p in begun], np.uint64)
        self.bits = 20
        order = np.argsort(h)
        self.hashes, self.ids = h[order], np.array([own.get(p, (-1, 0))[0] for p in begun], np.int32)[order]
        self.weight = np.array([own.get(p, (-1, 0.0))[1] for p in begun])[order]
        self.whole = np.append(self.ids >= 0, False)  # the last for what find() doesn't find
        slot = (self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        self.slot = np.searchsorted(slot, np.arange((1 << self.bits) + 1)).astype(np.int32)

    @staticmethod
    def hash(piece: str) -> int:
        h = SEED
        for c in piece:
            h = (h ^ ord(c)) * BASE % 2**64
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of the beginning of a piece with that hash, or -1."""
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        lo, hi = self.slot[at], self.slot[at + 1]
        out = np.full(len(h), -1, np.int64)
        some = np.flatnonzero(lo < hi)
        h, lo, hi = h[some], lo[some], hi[some]
        while len(some):
            good = self.hashes[lo] == h
            out[some[good]] = lo[good]
            lo = lo + 1
            more = np.flatnonzero(~good & (lo < hi))
            some, h, lo, hi = some[more], h[more], lo[more], hi[more]
        return out


@lru_cache(2)
def pieces(path: str, power: float) -> Pieces:
    return Pieces(path, power)


def parted(text: str) -> list[str]:
    """The units of a text."""
    marked = MARK + text.replace(MARK, LITERAL).replace(" ", MARK)
    if MARK + MARK in marked or "\x01" in marked:
        return UNITS.findall(marked)
    return list(filter(None, marked.replace(MARK, "\x01▁").replace("\n", "\x01\n\x01").split("\x01")))


class Lattice:
    """Of distinct units, one after another. A state is a place in a unit; edges of a state lie together, with probabilities. Units that
    texts share are added once and kept for the chunks after."""

    kept: dict[int, Lattice] = {}

    #: Arrays of states, of edges, and of the bytes of spelled characters, by their kinds.
    KINDS = {"start": np.int64, "first": np.int32, "last": np.int32, "done": bool, "src": np.int32, "to": np.int32, "ids": np.int32, "n_ids": np.int16, "log_p": float, "rest": float, "cum": float, "spelled": np.int32}

    def __init__(self, model: Pieces):
        self.model, self.room = model, {k: np.zeros(0, kind) for k, kind in self.KINDS.items()}
        self.empty()

    def empty(self) -> None:
        """Drops all units; the room of their arrays stays."""
        self.at: dict[str, int] = defaultdict(numbers().__next__)
        for name, room in self.room.items():
            setattr(self, name, room[:0])

    @classmethod
    def of(cls, model: Pieces) -> Lattice:
        """The process's lattice."""
        own = cls.kept.get(id(model))
        if own is None:
            own = cls(model)
            cls.kept = {id(model): own}
        elif len(own.first) > KEEP:
            own.empty()
        return own

    def codes(self, units: list[str]) -> np.ndarray:
        """Numbers of the units; new ones are added."""
        known = len(self.at)
        code = np.fromiter(map(self.at.__getitem__, units), np.int64, len(units))
        if len(self.at) > known:
            self.add(list(islice(self.at, known, None)))
        return code

    def add(self, units: list[str]) -> None:
        """Adds the states and edges of units, which have the last numbers."""
        states, edges, spelled = len(self.first), len(self.src), len(self.spelled)
        new = Part(units, self.model)
        new.ids = np.where(new.n_ids > 1, new.ids + spelled, new.ids)
        for name, shift in (("start", states), ("first", edges), ("last", edges), ("done", 0), ("src", states), ("to", states), ("ids", 0), ("n_ids", 0), ("log_p", 0), ("rest", 0), ("cum", 0), ("spelled", 0)):
            old, more, room = getattr(self, name), getattr(new, name), self.room[name]
            size = len(old) + len(more)
            if size > len(room):
                self.room[name] = room = np.empty(size + size // 4, room.dtype)
                room[: len(old)] = old
            room[len(old) : size] = more + shift if shift else more
            setattr(self, name, room[:size])

    def walk(self, state: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Samples a way from each state to the end of its unit: edges of all ways, one after another, and how many each has."""
        count, steps, at, step = np.zeros(len(state), np.int64), [], np.arange(len(state)), 0
        at = at[~self.done[state]]
        state, key = state[at], key[at]
        while len(at):
            u = unit(mix(key + np.uint64(step)))
            edge, last = self.first[state], self.last[state]
            open_ = np.flatnonzero((self.cum[edge] < u) & (edge < last))
            while len(open_):
                edge[open_] += 1
                open_ = open_[(self.cum[edge[open_]] < u[open_]) & (edge[open_] < last[open_])]
            steps.append((at, edge))
            count[at] += 1
            state = self.to[edge]
            live = ~self.done[state]
            at, state, key, step = at[live], state[live], key[live], step + 1
        begin = np.cumsum(count) - count
        out = np.empty(count.sum(), np.int64)
        for k, (own, edge) in enumerate(steps):
            out[begin[own] + k] = edge
        return out, count

    def spell(self, edges: np.ndarray) -> np.ndarray:
        n = self.n_ids[edges].astype(np.int64)
        if not (n > 1).any():
            return self.ids[edges]
        own, inside = np.repeat(edges, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        many = np.repeat(n > 1, n)
        return np.where(many, self.spelled[np.where(many, self.ids[own] + inside, 0)], self.ids[own])


class Part:
    """The states and edges of some units. Edges lie in the order of their states' distance from the end of the unit, so that all that an edge leads to
    is known before it; those of a state by falling size, as long pieces are the likely ones."""

    def __init__(self, units: list[str], model: Pieces):
        code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        lens = np.array([len(u) for u in units], np.int64)
        self.start = np.cumsum(lens + 1) - lens - 1  # state of a unit's begin; its end has a state too
        n = int((lens + 1).sum())
        state = np.arange(len(code), dtype=np.int32) + np.repeat(np.arange(len(units), dtype=np.int32), lens)
        char = np.zeros(n + model.longest, np.uint64)
        char[state] = code
        far = np.zeros(n, np.int32)
        far[state] = np.repeat((self.start + lens).astype(np.int32), lens) - state
        h = np.full(len(state), SEED, np.uint64)
        count, found, place, left, alone = np.zeros(n, np.int32), [], state, far[state], state[:0]
        for size in range(1, model.longest + 1):
            h = (h ^ char[place + (size - 1)]) * np.uint64(BASE)
            piece = model.find(h)
            good = model.whole[piece]
            at = place[good]
            found.append((at, size, piece[good], count[at]))
            count[at] += 1
            if size == 1:  # characters without a piece: their bytes, all in one edge
                alone = place[~good]
                found.append((alone, 1, np.full(len(alone), -1), count[alone]))
                count[alone] += 1
            fits = np.flatnonzero((piece >= 0) & (left > size))
            if not len(fits):
                break
            place, left, h = place[fits], left[fits], h[fits]
        order = np.argsort(far.astype(np.int16) if far.max(initial=0) < 1 << 15 else far, kind="stable")
        sizes = count[order]
        ends = np.cumsum(sizes, dtype=np.int32)
        self.first, self.last = np.empty(n, np.int32), np.empty(n, np.int32)
        self.first[order], self.last[order] = ends - sizes, np.maximum(ends - 1, ends - sizes)
        edges = int(ends[-1]) if n else 0
        self.src = np.repeat(order.astype(np.int32), sizes)
        piece, reach = np.empty(edges, np.int32), np.empty(edges, np.int32)
        for at, size, own, before in found:
            spot = self.last[at] - before
            piece[spot], reach[spot] = own, size
        self.to = self.src + reach
        weight, self.ids = model.weight[piece], model.ids[piece]
        self.n_ids, self.spelled = np.ones(edges, np.int16), np.zeros(0, np.int32)
        if len(alone):  # an edge of one byte has its id, of more bytes the place of their ids
            names, which = np.unique(char[alone], return_inverse=True)
            spelled = [model.byte[list((MARK if x == ord(LITERAL) else chr(int(x))).encode("utf-8", "replace"))] for x in names]
            more = np.array([len(x) for x in spelled], np.int64)
            self.spelled = np.concatenate(spelled)
            begin, spot = (np.cumsum(more) - more)[which], self.last[alone]
            self.n_ids[spot], weight[spot] = more[which], model.byte_weight * more[which]
            self.ids[spot] = np.where(more[which] == 1, self.spelled[begin], begin)
        down = np.zeros(n)
        levels = np.cumsum(np.bincount(far, minlength=1))
        for a, b in zip(levels, levels[1:], strict=False):
            some = order[a:b]
            lo, hi = ends[a - 1], ends[b - 1]
            at = ends[a - 1 : b - 1] - lo
            v = weight[lo:hi] + down[self.to[lo:hi]]
            top = np.maximum.reduceat(v, at)
            down[some] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, sizes[a:b])), at))
        self.log_p = np.minimum(0, weight + down[self.to] - down[self.src])
        p = np.exp(self.log_p)
        # log of the mass of a state's other edges, -inf where there is none; beside a likely edge they are added up, as 1 - p would round them away
        likely = np.flatnonzero(p > 0.6)
        other = p.copy()
        other[likely] = 0
        self.rest = np.log1p(-other)
        with np.errstate(divide="ignore"):
            self.rest[likely] = np.log(np.bincount(self.src, other, n)[self.src[likely]])
        total = np.cumsum(p)
        before = np.concatenate([[0.0], total])[self.first[order]]
        self.cum = total - np.repeat(before, sizes)
        self.done = np.zeros(n, bool)
        self.done[self.start + lens] = True


def truncated(log_p: np.ndarray, u: np.ndarray, top) -> np.ndarray:
    """Gumbel variables around log_p, given that they are below top."""
    with np.errstate(over="ignore", divide="ignore"):
        return np.where(np.isneginf(log_p), -np.inf, log_p - np.log(np.exp(np.minimum(log_p - top, 700)) - np.log(u)))


def included(x: float) -> tuple[float, float]:
    """1 - exp(-exp(x)) and its logarithm."""
    p = float(-np.expm1(-np.exp(min(x, 700.0))))
    return p, float(np.log(p)) if p > 1e-300 else float(x)


def sample(texts: list[str], keys: np.ndarray, model: Pieces, k: int) -> list[list[tuple]]:
    """For each text up to k distinct (ids, log_p, perturbed, inclusion, log_inclusion), the highest perturbed first."""
    units = [parted(t) for t in texts]
    flat = list(chain.from_iterable(units))
    grid = Lattice.of(model)
    code = grid.codes(flat)
    del flat
    n_units = np.array([len(u) for u in units], np.int64)
    base = np.cumsum(n_units) - n_units
    keys = mix(keys)

    def ways(doc: np.ndarray, from_unit: np.ndarray, state: np.ndarray | None, r: int):
        """Edges of the rest of each document from a unit on (from a state in it, if given), their units, edges for each document."""
        n = n_units[doc] - from_unit
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(from_unit, n)
        begin = grid.start[code[np.repeat(base[doc], n) + inside]]
        if state is not None:
            begin[np.cumsum(n) - n] = state
        key = mix(np.repeat(keys[doc] + np.uint64(r * ROUND % 2**64), n) + inside.astype(np.uint64) * np.uint64(PLACE))
        edges, count = grid.walk(begin, key)
        ends = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(n)])]
        return edges, np.repeat(inside, count), np.diff(ends)

    every = np.arange(len(texts))
    edges, of, n = ways(every, np.zeros(len(texts), np.int64), None, 0)
    out: list[list] = [[] for _ in texts]
    heaps: list[list] = [[] for _ in texts]
    roots = -np.log(-np.log(unit(mix(keys + np.uint64(ROUND >> 1)))))
    tops, prefix = roots, [(None, None)] * len(texts)
    docs, r = every, 0
    extra: list = [None] * len(texts)
    while len(docs):
        at = 0
        low = grid.log_p[edges]
        begin = np.cumsum(n) - n
        u = unit(mix(np.repeat(keys[docs] + np.uint64((r + 1) * PLACE % 2**64) - begin.astype(np.uint64), n) + np.arange(len(edges), dtype=np.uint64)))
        total = np.concatenate([[0.0], np.cumsum(low)])
        before = total[:-1] - np.repeat(total[begin], n)
        head = np.array([0.0 if p[0] is None else grid.log_p[p[0]].sum() for p in prefix])
        group = before + np.repeat(head, n) + grid.rest[edges]
        bound = truncated(group, u, np.repeat(tops, n))
        following = []
        for j, d in enumerate(docs):
            a, b = begin[j], begin[j] + n[j]
            own, where = edges[a:b], of[a:b]
            lead, lead_of = prefix[j]
            path = own if lead is None else np.concatenate([lead, own])
            spot = where if lead is None else np.concatenate([lead_of, where])
            shift = 0 if lead is None else len(lead)
            out[d].append([path, head[j] + total[b] - total[a], tops[j]])
            want = k - len(out[d]) + 1
            g = bound[a:b]
            for t in (np.argpartition(-g, want - 1)[:want] if len(g) > want else range(len(g))):
                if g[t] > -np.inf:
                    heapq.heappush(heaps[d], (-g[t], r, shift + int(t), path, spot, (int(own[t]),)))
            if extra[j]:
                heapq.heappush(heaps[d], extra[j])
            if len(out[d]) < k and heaps[d]:
                following.append(d)
        r += 1
        docs, tops, prefix, extra, state, unit_at = [], [], [], [], [], []
        for d in following:
            g, _, t, path, spot, out_of = heapq.heappop(heaps[d])
            s = grid.src[path[t]]
            options = [e for e in range(grid.first[s], grid.last[s] + 1) if e not in out_of]
            p = np.exp(grid.log_p[options])
            draw = unit(mix(keys[d : d + 1] + np.uint64(((r + 7) * ROUND + t) % 2**64)))
            pick = min(int(np.searchsorted(np.cumsum(p), draw[0] * p.sum())), len(options) - 1)
            e, left = options[pick], np.delete(p, pick).sum()
            again = None
            if len(options) > 1 and left > 0:
                lp = np.array([grid.log_p[path[:t]].sum() + np.log(left)])
                b = truncated(lp, unit(mix(keys[d : d + 1] + np.uint64(((r + 9) * PLACE + t) % 2**64))), -g)[0]
                again = (-b, r, t, np.concatenate([path[:t], [e]]), spot[: t + 1], (*out_of, e))
            docs.append(d)
            tops.append(-g)
            prefix.append((np.concatenate([path[:t], [e]]), spot[: t + 1]))
            extra.append(again)
            state.append(grid.to[e])
            unit_at.append(spot[t])
        docs, tops = np.array(docs, np.int64), np.array(tops)
        if len(docs):
            edges, of, n = ways(docs, np.array(unit_at, np.int64), np.array(state, np.int64), r)
    for d, own in enumerate(out):
        limit = -heaps[d][0][0] if heaps[d] else -np.inf
        out[d] = [(grid.spell(path), float(lp), float(g), *included(lp - limit)) for path, lp, g in own]
    return out


def packed(drawn: list[list[tuple]], known: np.ndarray) -> pa.Array:
    """Samples of the texts that are known, as an Arrow array with null for the others."""
    each = list(chain.from_iterable(drawn))
    ends = lambda sizes: np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int32)
    ids = pa.ListArray.from_arrays(ends([len(x[0]) for x in each]), np.concatenate([np.zeros(0, np.int32), *[x[0] for x in each]]).astype(np.int32))
    scores = [pa.array(np.array([x[i] for x in each], float)) for i in (1, 2, 3, 4)]
    sizes = np.zeros(len(known), np.int64)
    sizes[known] = [len(x) for x in drawn]
    return pa.ListArray.from_arrays(pa.array(ends(sizes)), pa.StructArray.from_arrays([ids, *scores], ["ids", "log_p", "perturbed", "inclusion", "log_inclusion"]), mask=pa.array(~known))


def sampled(key: Column, text: Column, path: str, k: int = 2, power: float = 1.5) -> Column:
    """Array of up to k samples of a text: ids, log_p, perturbed, inclusion, log_inclusion."""

    @F.arrow_udf(SAMPLE)
    def draw(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        released()
        model = pieces(path, power)
        for ids, texts in parts:
            seeds, known = ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), texts.is_valid().to_numpy(zero_copy_only=False)
            own, told = [], texts.drop_null().to_pylist()
            for a, b in chunks(told, CHUNK):
                own += sample(told[a:b], seeds[known][a:b], model, k)
            yield packed(own, known)
        # an idle worker, of which there may be more than cores, keeps the model alone
        Lattice.kept.clear()
        released()

    return draw(F.coalesce(key.cast("long"), F.lit(0).cast("long")), text)


@lru_cache(2)
def spellings(path: str) -> pa.Array:
    """The bytes of every id."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return pa.array([bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(MARK, " ").encode() if p.type == 1 else b"" for p in model.pieces], pa.binary())


def decoded(samples: Column, path: str) -> Column:
    """The text of each sample of an array; null for null."""

    @F.arrow_udf("array<string>")
    def decode(rows: pa.Array) -> pa.Array:
        ids = pc.struct_field(rows.flatten(), "ids")
        spelled, sizes = spellings(path).take(ids.flatten()), pc.list_value_length(ids).to_numpy(zero_copy_only=False)
        # bytes of all ids lie one after another, so a text is what stands from its first id to its last, without the first byte
        place = np.frombuffer(spelled.buffers()[1], np.int32) if len(spelled) else np.zeros(1, np.int32)
        ends = place[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
        some = np.diff(ends) > 0
        data = np.delete(np.frombuffer(spelled.buffers()[2] or b"", np.uint8), ends[:-1][some])
        ends = ends - np.concatenate([[0], np.cumsum(some)])
        texts = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
        try:
            texts = texts.cast(pa.string())
        except pa.ArrowInvalid:  # an array not made by sampled() may spell bytes that are no UTF-8
            texts = pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())
        own = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(own)]).astype(np.int32)), texts, mask=rows.is_null())

    return decode(samples)


def with_segmentations(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", into: str = "segmentations", k: int = 2, power: float = 1.5) -> DataFrame:
    small_batches(df.sparkSession)
    return df.withColumn(free_name(df, into), sampled(df[key], df[text], path, k, power))
