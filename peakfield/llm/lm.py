"""Language-model scores: a gated recurrent network with a class-factored softmax, in numpy inside Spark tasks.

Counts come from all training documents: every partition counts its own, and one shuffle adds them up. The most frequent words (the
head; 4096 at least, and more as the root of the number of distinct words grows) have vectors of their own, and classes of 128 by rank. Other words
are known to the network by their spelling class. The output is factored: a softmax over classes, given the state, and in a class a softmax over
its words, given the state too (the head), or their share of the class's count (spelling classes, where the state decides on the class alone). In a
spelling class half a count is added to each word and to one more, which stands for those never seen in training, so a class's words have
probability 1 together. One more input begins a text, and there the state is zero.

The network learns by truncated backpropagation through windows of a fixed number of tokens; the state, not its gradient, crosses windows. Each
training document is learned from once: hashes of its id put it into one of the rounds and, there, to one of the copies of the common weights, which
learns from its texts in the order of another hash, block by block. A copy has about COPY tokens, so copies grow with the corpus, and rounds as the
third root of what the copies of one round would be; neither hangs on partitions, so the same table gives the same scores on any cluster. The copies
of a round are summed up by tokens in Spark, so what is gathered grows with the corpus while the driver gets one set of weights a round.

Scoring carries the state through all windows of a text, so a text of any length has its whole likelihood. Words outside the frequent table
need their counts: those tokens alone are joined with the counts, which may be any number.

Cases: a null or empty text is the end token alone. Rows with a null id are training rows and are scored like others; repeated rows are scored
alike and counted as often as they stand. Without training documents all words are unknown, and the base's V and N are 0 (N counts end tokens). Of
the table only the id and the text are read, so no other column can clash. A very long text is scored in windows of all texts of its batch.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import one_thread, released, slim, small_batches, written

END = b"\n"  # no word holds white space, so this stands for the end of a text
HEAD_CLASSES, PER_CLASS, SPELLINGS = 32, 128, 32
HIDDEN, WINDOW = 16, 16
RATE, STREAMS, LEAST_STREAM = 0.02, 512, 512
#: Tokens that a task holds for training at a time; numbers in one row of summed weights.
BLOCK, PIECE = 1 << 18, 1 << 12
#: Tokens that a copy of the network learns from in a round, about; the least number of rounds; tasks of a round for each core, at most (more copies share them).
COPY, LEAST_ROUNDS, TASKS_A_CORE = 1 << 19, 2, 4
#: Tokens of texts that are scored together.
TOGETHER = 1 << 21
#: Tokens whose exponentials over the classes are taken at a time, so that these stay in a core's cache.
ROWS = 1 << 10
#: States are within 1, so output weights within this keep all exponents below 80.
BOUND = 80 / HIDDEN


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, in UTF-8, and the end."""
    return [*(text or "").encode("utf-8", "replace").lower().split(), END]


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts one after another, without ends, and the number of each text's."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    flat, lens = lists.flatten().cast(pa.binary()), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    held = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(held).as_py():  # a text without words has one empty piece
        lens[pc.equal(pc.binary_length(flat.take(pa.array(np.cumsum(lens) - lens))), 0).to_numpy(zero_copy_only=False)] = 0
        flat = flat.filter(held)
    return flat, lens


def head_classes(distinct: int) -> int:
    """Classes of words with vectors of their own, for that many distinct words."""
    return max(HEAD_CLASSES, math.isqrt(distinct) // 64)


def schedule(total: int) -> tuple[int, int]:
    """Rounds, and copies in each, for that many training tokens."""
    units = -(-total // COPY)
    rounds = max(LEAST_ROUNDS, round(units ** (1 / 3)))
    return rounds, max(1, -(-units // rounds))


def counts(df: DataFrame) -> DataFrame:
    """word, n over the rows of df (text), with the end token."""

    def merged(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        held: list[pa.Table] = []
        for batch in batches:
            own = pc.value_counts(split(batch["text"])[0])
            held += [pa.table({"word": own.field("values"), "n": own.field("counts")}), pa.table({"word": pa.array([END], pa.binary()), "n": pa.array([len(batch)], pa.int64())})]
            if sum(map(len, held)) > 1 << 20:
                held = [merged(held)]
                if len(held[0]) > 500_000:
                    yield from held[0].to_batches()
                    held = []
        if held:
            yield from merged(held).to_batches()
        held.clear()
        released()

    return df.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@lru_cache(1)
def endings() -> np.ndarray:
    """Spelling class of each two last bytes: the last one (256 for none) by the one before."""
    return np.array([[zlib.crc32(bytes([*([a] if a < 256 else []), b])) % SPELLINGS for b in range(256)] for a in range(257)], np.int64)


def spelling(names: list[bytes] | pa.Array) -> np.ndarray:
    """Spelling class of words: a hash of the last two bytes."""
    names = pa.array(names, pa.binary()) if isinstance(names, list) else names
    if not len(names):
        return np.zeros(0, np.int64)
    data, ends = np.frombuffer(names.buffers()[2], np.uint8), np.frombuffer(names.buffers()[1], np.int32)[names.offset : names.offset + len(names) + 1]
    return endings()[np.where(np.diff(ends) > 1, data[ends[1:] - 2], np.int16(256)), data[ends[1:] - 1]]


def spelled(word: str) -> Column:
    """Spelling class of a column of words."""
    return (F.crc32(F.substring(word, -2, 2)) % SPELLINGS).cast("int")


@dataclass
class Model:
    """words: the frequent ones by falling count; n: their counts. Class c < heads has words c * PER_CLASS and on; then come the spelling
    classes. Inputs are the head, the spelling classes and the begin of a text. weights: the network's arrays."""

    words: list[bytes]
    n: np.ndarray
    heads: int
    class_n: np.ndarray  # tokens of each spelling class outside the head
    class_v: np.ndarray  # and its distinct words
    total: int
    distinct: int
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @property
    def base(self) -> int:
        """The input of the first spelling class."""
        return self.heads * PER_CLASS

    @property
    def begin(self) -> int:
        return self.base + SPELLINGS

    @property
    def head(self) -> int:
        return min(self.base, len(self.words))

    @classmethod
    def start(cls, table: pd.DataFrame, class_n: np.ndarray, class_v: np.ndarray, total: int, distinct: int, seed: int = 1) -> Model:
        """Weights that give the unigram distribution whatever the state."""
        m = cls(table["word"].tolist(), table["n"].to_numpy(np.int64), head_classes(distinct), class_n, class_v, total, distinct)
        r = np.random.default_rng(seed)
        own = np.full(m.base, 1e-4)
        own[: m.head] = m.n[: m.head]
        own = own.reshape(-1, PER_CLASS)
        mass = np.concatenate([own.sum(1), class_n + 0.5])
        m.weights = {
            "x": r.normal(0, 0.3, (m.begin + 1, 3 * HIDDEN)).astype(np.float32),
            "h": (r.normal(0, 0.5, (HIDDEN, 3 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32),
            "c": np.zeros((HIDDEN + 1, len(mass)), np.float32),
            "w": np.zeros((m.heads, HIDDEN + 1, PER_CLASS), np.float32),
        }
        m.weights["c"][HIDDEN], m.weights["w"][:, HIDDEN] = np.log(mass / mass.sum()), np.log(own)  # the last row is the bias
        return m

    def codes(self, tokens: pa.Array) -> np.ndarray:
        """Place in the table of frequent words, or -1."""
        if not hasattr(self, "at"):
            self.at = pa.array(self.words, pa.binary())
        return pc.index_in(tokens, value_set=self.at).fill_null(-1).to_numpy()

    def own(self) -> np.ndarray:
        """The network's inputs of the frequent words: head words have their own, others their spelling class."""
        return np.concatenate([np.arange(self.head), self.base + spelling(self.words[self.head :])]).astype(np.int32)

    def classes_of(self, net: np.ndarray) -> np.ndarray:
        return np.where(net < self.base, net // PER_CLASS, self.heads + net - self.base)


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In the place of x."""
    np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.divide(1, x, out=x)


def step(w: dict, a: np.ndarray, h: np.ndarray):
    """One gated step from the input's part a and the state, units by texts: update z, reset r, candidate n."""
    b = w["h"].T @ h
    zr = sigmoid(a[: 2 * HIDDEN] + b[: 2 * HIDDEN])
    z, r, own = zr[:HIDDEN], zr[HIDDEN:], b[2 * HIDDEN :]
    n = r * own
    n += a[2 * HIDDEN :]
    new = h - np.tanh(n, out=n)
    new *= z
    new += n
    return new, z, r, n, own


def exponentials(v: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Turns each row of v (below 88, which BOUND keeps it to) into its exponentials. Where the places at stand in v, their log-probabilities, and each
    row's sum."""
    place = np.arange(0, v.size, v.shape[1])
    place += at
    own = v.reshape(-1)[place]
    total = np.exp(v, out=v) @ np.ones(v.shape[1], v.dtype)
    return place, own - np.log(total), total


def members(m: Model, net: np.ndarray) -> tuple[np.ndarray, list[tuple[slice, list[tuple[int, slice]]]]]:
    """The places of head words in net, by class, and pieces of them of ROWS / 2 at most: each with its classes and their parts of the piece."""
    heads = np.flatnonzero(net < m.base)
    c = net[heads] // PER_CLASS
    order = np.argsort(c.astype(np.int16), kind="stable")
    c, pieces = c[order], []
    for a in range(0, len(c), ROWS // 2):
        own = c[a : a + ROWS // 2]
        first = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist()]
        pieces.append((slice(a, a + len(own)), [(k, slice(*ends)) for k, *ends in zip(own[first].tolist(), first, [*first[1:], len(own)], strict=True)]))
    return heads[order], pieces


def values(h: np.ndarray, w: np.ndarray, classes: list[tuple[int, slice]]) -> np.ndarray:
    """Of the states h: what the softmax of each one's class is taken of."""
    v = np.empty((len(h), PER_CLASS), h.dtype)
    for k, part in classes:
        np.matmul(h[part], w[k], out=v[part])
    return v


def log_output(m: Model, h: np.ndarray, net: np.ndarray) -> np.ndarray:
    """Log-probability of each target's class, and of the word in it where that has a softmax (spelling classes: 0). h: states, with the input of the biases."""
    w, c = m.weights, m.classes_of(net)
    out = np.concatenate([exponentials(h[a : a + ROWS] @ w["c"], c[a : a + ROWS])[1] for a in range(0, len(net), ROWS)])
    order, pieces = members(m, net)
    at = net[order] % PER_CLASS
    for piece, classes in pieces:
        out[order[piece]] += exponentials(values(h.take(order[piece], 0), w["w"], classes), at[piece])[1]
    return out.astype(np.float64)


def likelihood(m: Model, nets: list[np.ndarray], held: int = 8192) -> np.ndarray:
    """Natural log-likelihood of each token sequence's classes and head words. All texts of a batch go forward together, longest first; the
    state goes on from window to window, and the output layer sees what has gathered of all texts at once."""
    order = np.argsort([-len(s) for s in nets], kind="stable")
    lens = np.array([len(nets[i]) for i in order], np.int64)
    out = np.zeros(len(nets))
    if not len(nets):
        return out
    flat, base = np.concatenate([nets[i] for i in order]), np.cumsum(lens) - lens
    h, last = np.zeros((HIDDEN, len(nets)), np.float32), np.full(len(nets), m.begin)
    live = np.searchsorted(-lens, -np.arange(lens[0]), "left").tolist()
    states, targets, size, first = np.ones((held + len(nets), HIDDEN + 1), np.float32), [], 0, 0
    for t, now in enumerate(live):
        h = step(m.weights, m.weights["x"].take(last[:now], 0).T, h[:, :now])[0]
        last = flat[base[:now] + t]
        states[size : size + now, :HIDDEN] = h.T
        targets.append(last)
        size += now
        if size > held or t == len(live) - 1:
            lp = log_output(m, states[:size], np.concatenate(targets))
            out += np.bincount(np.concatenate([np.arange(k) for k in live[first : t + 1]]), lp, len(nets))
            targets, size, first = [], 0, t + 1
    back = np.empty(len(nets))
    back[order] = out
    return back


def gradients(m: Model, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, float]:
    """One window, time by stream: gradients of the mean loss, the state after it, the loss. Of the inputs only the rows that occur have a gradient:
    x is (rows, gradient). A state before the begin of a text is zero, and the begin of a text is no target. Inside, units go before streams, so that
    each unit's numbers stand together."""
    w, (steps, size) = m.weights, x.shape
    kind, flat, y = w["h"].dtype, x.reshape(-1), y.reshape(-1)
    parts = np.ascontiguousarray(w["x"].take(flat, 0).reshape(steps, size, 3 * HIDDEN).transpose(0, 2, 1))
    kept, fresh, hs = [], x == m.begin, np.ones((steps, size, HIDDEN + 1), kind)
    any_fresh, h = fresh.any(1).tolist(), h.T
    for t in range(steps):
        if any_fresh[t]:
            h = np.where(fresh[t], kind.type(0), h)
        new, *gates = step(w, parts[t], h)
        kept.append((h, *gates))
        h = new
        hs[t, :, :HIDDEN] = h.T
    hs, told = hs.reshape(-1, HIDDEN + 1), y != m.begin
    mean = kind.type(1 / max(1, told.sum()))
    scale, c = told * mean, np.where(told, m.classes_of(y), 0)
    loss, every = 0.0, np.empty((steps * size, HIDDEN), kind)
    g = {"c": np.zeros_like(w["c"]), "w": np.zeros_like(w["w"])}

    def share(v: np.ndarray, at: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Turns v into the gradient of the loss by it, times what is returned for each row; adds to the loss."""
        nonlocal loss
        place, lp, total = exponentials(v, at)
        loss -= float(lp @ scale)
        v.reshape(-1)[place] -= total
        return (scale / total)[:, None]

    for a in range(0, steps * size, ROWS):
        part = slice(a, a + ROWS)
        own, v = hs[part], hs[part] @ w["c"]
        by = share(v, c[part], scale[part])
        g["c"] += (own * by).T @ v
        np.multiply(v @ w["c"][:HIDDEN].T, by, out=every[part])
    order, pieces = members(m, y)
    for piece, classes in pieces:
        at = order[piece]
        own = hs.take(at, 0)
        v, back = values(own, w["w"], classes), np.empty((len(at), HIDDEN), kind)
        by = share(v, y[at] % PER_CLASS, scale[at])
        own *= by
        for k, part in classes:
            g["w"][k] += own[part].T @ v[part]
            np.matmul(v[part], w["w"][k, :HIDDEN].T, out=back[part])
        back *= by
        every[at] += back
    every = every.reshape(steps, size, HIDDEN)
    dh, inner, outer = np.zeros((HIDDEN, size), kind), np.empty((3 * HIDDEN, steps, size), kind), np.empty((3 * HIDDEN, steps, size), kind)
    for t in reversed(range(steps)):
        before, z, r, n, own = kept[t]
        dh += every[t].T
        left, dz, dn = 1 - z, before - n, n * n
        dz *= z
        dz *= left
        dz *= dh
        dn = np.subtract(1, dn, out=dn)
        dn *= left
        dn *= dh
        left = np.subtract(1, r, out=left)
        left *= r
        left *= own
        left *= dn
        inner[:HIDDEN, t] = outer[:HIDDEN, t] = dz
        inner[HIDDEN : 2 * HIDDEN, t] = outer[HIDDEN : 2 * HIDDEN, t] = left
        outer[2 * HIDDEN :, t] = dn
        np.multiply(dn, r, out=inner[2 * HIDDEN :, t])
        dh *= z
        dh += w["h"] @ inner[:, t]
        if any_fresh[t]:
            dh[:, fresh[t]] = 0
    g["h"] = sum(k[0] @ inner[:, t].T for t, k in enumerate(kept))
    seen = np.zeros(len(w["x"]), np.int64)
    seen[flat] = 1
    rows = np.flatnonzero(seen)
    seen[rows] = np.arange(len(rows))
    at = seen[flat]
    g["x"] = rows, np.stack([np.bincount(at, v, len(rows)) for v in outer.reshape(3 * HIDDEN, -1)], 1).astype(kind)
    return g, h.T, loss


def train(m: Model, stream: np.ndarray, moments: dict, rate: float = RATE) -> Model:
    """Adam over windows of a stream of inputs, cut into parallel streams of LEAST_STREAM tokens or more. moments: Adam's state, carried from one stream
    to the next; rows of inputs that don't occur keep theirs."""
    batch = max(1, min(STREAMS, len(stream) // LEAST_STREAM))
    steps = (len(stream) - 1) // batch
    x = stream[: batch * steps].reshape(batch, steps).T
    y = stream[1 : batch * steps + 1].reshape(batch, steps).T
    h = np.zeros((batch, HIDDEN), np.float32)
    if not moments:
        moments |= {"i": 0, "first": {k: np.zeros_like(v) for k, v in m.weights.items()}, "second": {k: np.zeros_like(v) for k, v in m.weights.items()}}
    for a in range(0, steps, WINDOW):
        g, h, _ = gradients(m, x[a : a + WINDOW], y[a : a + WINDOW], h)
        moments["i"] += 1
        i = moments["i"]
        pace, last = np.float32(rate / (1 - 0.9**i)), np.float32(1 - 0.99**i)
        for k, d in g.items():
            at, d = d if k == "x" else (slice(None), d)
            first, second, more = moments["first"][k][at], moments["second"][k][at], np.float32(0.1) * d
            first *= np.float32(0.9)
            first += more
            np.multiply(d, d, out=d)
            d *= np.float32(0.01)
            second *= np.float32(0.99)
            second += d
            np.sqrt(np.divide(second, last, out=d), out=d)
            d += np.float32(1e-6)
            np.multiply(first, pace, out=more)
            more /= d
            if k == "x":
                moments["first"][k][at], moments["second"][k][at] = first, second
            m.weights[k][at] -= more
        for k in ("c", "w"):
            own = m.weights[k][..., :HIDDEN, :]
            np.clip(own, -BOUND, BOUND, out=own)
    return m


def summed(learned: DataFrame, parts: int) -> DataFrame:
    """slot, size, data: the means (single precision) of all rows of a slot by their sizes, first of those of some partitions (salt), then of all. A task
    holds one sum for each slot, in double precision."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size: dict[int, float] = {}
        data: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, own, more in zip(batch["slot"], batch["size"], batch["data"], strict=True):
                size[slot] = size.get(slot, 0.0) + own
                data[slot] = data.get(slot, 0.0) + own * np.frombuffer(more, np.float32).astype(np.float64)
        for slot in data:
            yield pd.DataFrame({"slot": [slot], "salt": 0, "size": size[slot], "data": [(data[slot] / size[slot]).astype(np.float32).tobytes()]})

    for by in (("slot", "salt"), ("slot",)):
        learned = learned.repartition(parts, *by).mapInPandas(add, "slot int, salt int, size double, data binary")
    return learned


def encoded(docs: DataFrame, m: Model) -> DataFrame:
    """docs: id, text. Per row: a number of its own, id, n_tokens, n_known and base_score as far as the frequent words go, inside (what these add to the
    network's score), net (the network's inputs), rare (the other words) and round, in which a training text is learned from. It is written by rounds, so
    that each reads its own, and the numbers stay as they are if an executor is lost."""
    shared = docs.sparkSession.sparkContext.broadcast(m)
    norm = m.total + 0.5 * (m.distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        own = shared.value
        inputs, end = np.append(own.own(), np.int32(0)), pa.array([END], pa.binary())
        logs = np.log10((own.n + 0.5) / norm)
        # a frequent word outside the head: its share of its spelling class
        inside = np.zeros(len(own.words))
        if len(own.words) > own.head:
            inside[own.head :] = np.log10((own.n[own.head :] + 0.5) / (own.class_n + 0.5 * (own.class_v + 1))[inputs[own.head : -1] - own.base])
        logs, inside = np.append(logs, 0.0), np.append(inside, 0.0)  # the last for words outside the table
        for batch in batches:
            if not len(batch):
                continue
            flat, lens = split(batch["text"])
            ends = np.cumsum(lens + 1)
            begin, tokens = ends - lens - 1, pa.concat_arrays([flat, end])
            where = np.insert(np.arange(len(flat)), np.cumsum(lens), len(flat))  # of each token, with the ends, in tokens
            code = own.codes(tokens)[where]
            net, at = inputs[code], np.flatnonzero(code < 0)
            rare = tokens.take(pa.array(where[at]))
            net[at] = own.base + spelling(rare)
            total = lambda v: np.add.reduceat(v, begin)  # noqa: B023, E731
            columns = [batch["row"], batch["id"], lens + 1, total((code >= 0).astype(np.int64)), total(logs[code]), total(inside[code])]
            columns += [pa.ListArray.from_arrays(np.append(begin, len(net)).astype(np.int32), net), pa.ListArray.from_arrays(np.searchsorted(at, np.append(begin, len(net))).astype(np.int32), rare)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)
            del flat, tokens, where, code, net, at, rare, columns
        released()

    names = ["row", "id", "n_tokens", "known", "fixed", "inside", "net", "rare"]
    own = docs.select(F.monotonically_increasing_id().alias("row"), "id", "text").mapInArrow(run, "row long, id long, n_tokens long, known long, fixed double, inside double, net array<int>, rare array<binary>")
    own = own.withColumn("round", F.pmod(F.xxhash64("id"), F.lit(schedule(m.total)[0])).cast("int"))
    return written(own, "encoded", by="round")


def averaged(m: Model, inputs: DataFrame, copies: int) -> Model:
    """One round over inputs (id, net): each copy learns from its texts in a fixed order, and the copies are averaged by their tokens. A task takes its
    copies one after another and sends one mean of them, so it holds one copy, one sum and one block, and what is sent follows tasks, not copies."""
    spark = inputs.sparkSession
    shared = spark.sparkContext.broadcast(m)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one_thread()
        released()
        own, total, tokens = shared.value, 0.0, 0
        texts = chain.from_iterable(zip(b["copy"], b["net"], strict=True) for b in batches)
        for _, group in groupby(texts, itemgetter(0)):
            copy = Model(own.words, own.n, own.heads, own.class_n, own.class_v, own.total, own.distinct, {k: v.copy() for k, v in own.weights.items()})
            streams, moments, size, held, begin = [], {}, 0, 0, np.array([copy.begin], np.int32)
            for _, net in group:
                streams += [begin, net]
                size, held = size + len(net), held + len(net)
                if held >= BLOCK:
                    whole = np.concatenate(streams)
                    for a in range(0, len(whole), BLOCK):
                        train(copy, whole[a : a + BLOCK + 1], moments)
                    streams, held = [], 0
            if streams:
                train(copy, np.concatenate(streams), moments)
            total = total + size * np.concatenate([copy.weights[k].ravel() for k in sorted(copy.weights)]).astype(np.float64)
            tokens += size
        if tokens:
            flat, copy, moments, net = (total / tokens).astype(np.float32), None, None, None
            released()
            for slot in range(-(-len(flat) // PIECE)):
                yield pd.DataFrame({"slot": [slot], "salt": TaskContext.get().partitionId() % 64, "size": float(tokens), "data": [flat[slot * PIECE : (slot + 1) * PIECE].tobytes()]})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(copies, max(parts, TASKS_A_CORE * spark.sparkContext.defaultParallelism))
    dealt = inputs.select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(copies)).cast("int").alias("copy"), F.xxhash64("id", F.lit(2)).alias("place"), "id", "net")
    dealt = dealt.repartition(tasks, "copy").sortWithinPartitions("copy", "place", "id", "net").select("copy", "net")
    rows = summed(dealt.mapInPandas(learn, "slot int, salt int, size double, data binary"), parts).collect()
    if rows:
        flat, at = np.concatenate([np.frombuffer(r.data, np.float32) for r in sorted(rows, key=lambda r: r.slot)]), 0
        for k in sorted(m.weights):
            m.weights[k] = flat[at : at + m.weights[k].size].reshape(m.weights[k].shape).copy()
            at += m.weights[k].size
    return m


def most_frequent(all_counts: DataFrame, most: int, slices: int = 4096) -> DataFrame:
    """The rows (word, n) of the most frequent words, at most so many, found by counts of counts before any word is sent. Where a count's words would be too
    many, those with the lowest hashes are taken, in whole slices of the hashes."""
    # counts to three figures and their digits: a few thousand rows at most
    scale = F.pow(10, F.greatest(F.length(F.col("n").cast("string")) - 3, F.lit(0)))
    level, part = (F.floor(F.col("n") / scale) * scale).cast("long"), F.pmod(F.xxhash64("word", F.lit(7)), F.lit(slices))
    held, take = 0, F.lit(False)
    for r in all_counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():
        if held + r.words <= most:
            held, take = held + r.words, F.col("n") >= r.level
            continue
        last = 0
        for p in all_counts.where(level == r.level).groupBy(part.alias("part")).agg(F.count("*").alias("words")).orderBy("part").collect():
            if held + p.words > most:
                break
            held, last = held + p.words, p.part + 1
        take = take | ((level == r.level) & (part < last))
        break
    return all_counts.where(take)


def started(train_docs: DataFrame, frequent: int = 262_144) -> tuple[Model, DataFrame]:
    """The model before training, and the table of all counts (word, n). The frequent words are as many as can be had with whole counts and, of the count
    below them, whole slices of hashes, so their number is bounded before they are collected."""
    spark = train_docs.sparkSession
    small_batches(spark)
    all_counts = written(counts(train_docs), "counts")
    sums = all_counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    table = most_frequent(all_counts, frequent).toPandas().sort_values(["n", "word"], ascending=[False, True], ignore_index=True)
    head = spark.createDataFrame([(w,) for w in table["word"][: head_classes(sums.v) * PER_CLASS]], "word binary")
    per = all_counts.join(F.broadcast(head), "word", "left_anti").groupBy(spelled("word").alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    class_n, class_v = np.zeros(SPELLINGS), np.zeros(SPELLINGS)
    for r in per:
        class_n[r.c], class_v[r.c] = r.n, r.v
    return Model.start(table, class_n, class_v, sums.n, sums.v), all_counts


def trained(m: Model, inputs: DataFrame) -> Model:
    """inputs: id, net, round of the training documents. All rounds together learn from all of them."""
    rounds, copies = schedule(m.total)
    for r in range(rounds):
        m = averaged(m, inputs.where(F.col("round") == r), copies)
    return m


def score(rows: DataFrame, m: Model, all_counts: DataFrame) -> DataFrame:
    """rows: as encoded() gives them. Per row: id, n_tokens, n_known, base_score, score (log10)."""
    shared = rows.sparkSession.sparkContext.broadcast(m)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        one_thread()
        released()

        def out() -> pd.DataFrame:
            """The rows of some batches, whose texts go through the network together."""
            own = pd.concat(held, ignore_index=True)
            return own.drop(columns="net").assign(neural=own["inside"] + likelihood(shared.value, own["net"].tolist()) / np.log(10))

        for part in parts:
            held.append(part)
            size += sum(map(len, part["net"]))
            if size > TOGETHER:
                yield out()
                held, size = [], 0
        if held:
            yield out()
        held.clear()
        released()

    c = F.coalesce("n", F.lit(0))
    sizes = F.array(*[F.lit(float(x)) for x in m.class_n + 0.5 * (m.class_v + 1)])
    share = F.log10((c + F.lit(0.5)) / F.element_at(sizes, F.col("s") + 1))
    norm = F.lit(m.total + 0.5 * (m.distinct + 1))
    rare = rows.select("row", F.explode("rare").alias("word")).join(all_counts, "word", "left").withColumn("s", spelled("word"))
    sums = rare.groupBy("row").agg(F.count_if(c > 0).alias("seen"), F.sum(F.log10((c + 0.5) / norm)).alias("b"), F.sum(share).alias("s"))
    names = "row long, id long, n_tokens long, known long, fixed double, inside double"
    out = rows.drop("rare", "round").mapInPandas(run, f"{names}, neural double").join(sums, "row", "left")
    zero = lambda x: F.coalesce(x, F.lit(0))
    return out.select("id", "n_tokens", (F.col("known") + zero("seen")).alias("n_known"), (F.col("fixed") + zero("b")).alias("base_score"), (F.col("neural") + zero("s")).alias("score"))


def scored(df: DataFrame, is_training, key: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of df. is_training: of the id column, whether a row may be learned from."""
    docs = slim(df, id=key, text=text)
    model, all_counts = started(docs.where(is_training(F.col("id"))), **params)
    rows = encoded(docs, model)
    model = trained(model, rows.where(is_training(F.col("id"))))
    each = score(rows, model, all_counts)
    return each.select("id", (~is_training(F.col("id"))).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
