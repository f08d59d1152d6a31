"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of whole documents of a few million characters, as they arrive in a task; a longer document is a shard of its own. Its words become symbols of the
benchmark's vocabulary. A word outside it can't lie in an occurrence, so runs of such words, and known words in runs shorter
than the shortest phrase, shrink to one mark without loss. Over that text: suffix order by prefix doubling, its BWT
in a wavelet matrix, and the suffix positions of every eighth place and of the start of each run. All phrases are searched
backwards at once; every row found is walked to a sampled place, and the places become removal spans, merged where they touch.

Phrases: ten consecutive words of an item, or all words of a shorter one. Words are lower-cased (A-Z) runs of letters, digits and
non-ASCII characters. Items go to the tasks in blocks of bounded size; a benchmark of several blocks takes one pass for each.

Cases: null and wordless texts have no words and no hits; null and wordless items have no phrases. Items with equal phrases
all count. Repeated document rows are judged alike; repeated item rows count once; a null item id is left out. Documents are never parted
between shards. Empty tables give no rows, or no hits. Other columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, free_name, mix, released, small_batches

#: Fixed by the contract: what a word is made of, after lower-casing A-Z.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WINDOW = 10
RESULT = "n_words long, spans array<struct<start:int,end:int>>, items array<long>"
PRIME = 0x9E3779B97F4A7C15
INVERSE = pow(PRIME, -1, 2**64)


#: Places in one row of a table of powers.
SPAN = 1 << 16


@lru_cache(2)
def _low(base: int) -> np.ndarray:
    out = np.full(SPAN, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, at: np.ndarray) -> np.ndarray:
    """base to the power of each place, from two small tables."""
    high = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(at.max(initial=0)) // SPAN, pow(base, SPAN, 2**64), np.uint64)]))
    return _low(base)[at % SPAN] * high[at // SPAN]


class Words:
    """Hashes of all words of texts, the text of each, and how many each text has."""

    def __init__(self, texts: list[str]):
        joined = "\x00".join(["", *texts, ""])
        code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        code = np.where((code >= 65) & (code <= 90), code + np.uint32(32), code)
        inside = ((code >= 48) & (code <= 57)) | ((code >= 97) & (code <= 122)) | (code >= 128)
        edge = np.diff(inside.astype(np.int8))
        start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((code.astype(np.uint64) + np.uint64(1)) * powers(PRIME, np.arange(len(code), dtype=np.int32)))])
        self.hash = mix((total[end] - total[start]) * powers(INVERSE, start))
        bound = np.cumsum([1, *[len(t) + 1 for t in texts]])
        self.first = np.searchsorted(start, bound)
        self.count = np.diff(self.first)
        self.of = np.repeat(np.arange(len(texts)), self.count)


@dataclass
class Phrases:
    """Distinct phrases of a block of items: symbols (from 1) in rows, right-aligned to width; the items of each phrase."""

    vocabulary: np.ndarray  # sorted hashes; symbol s is vocabulary[s - 1]
    symbols: np.ndarray
    length: np.ndarray
    item_start: np.ndarray
    item: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[int, str | None]], window: int) -> Phrases:
        known = Words([t or "" for _, t in items])
        vocabulary, symbol = np.unique(known.hash, return_inverse=True)
        rows: dict[tuple, set] = {}
        for (name, _), a, b in zip(items, known.first, known.first[1:], strict=False):
            own = symbol[a:b] + 1
            for i in range(max(1, len(own) - window + 1) if len(own) else 0):
                rows.setdefault(tuple(own[i : i + window].tolist()), set()).add(name)
        symbols = np.zeros((len(rows), window), np.int64)
        for k, r in enumerate(rows):
            symbols[k, window - len(r) :] = r
        return cls(vocabulary, symbols, np.array([len(r) for r in rows], np.int64), np.cumsum([0, *[len(v) for v in rows.values()]]), np.array([x for v in rows.values() for x in sorted(v)], np.int64))


class FMIndex:
    """Over symbols where 0 parts runs: starts and ends with 0, and no phrase holds it."""

    def __init__(self, text: np.ndarray, symbols: int, every: int = 8):
        n = len(text)
        order = self.suffixes(text)
        bwt = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.levels = max(1, int(symbols).bit_length())
        self.ones, self.zeros = [], []
        row = bwt
        for level in reversed(range(self.levels)):
            bit = (row >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(n - int(self.ones[-1][-1]))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.bottom = self.down(np.arange(symbols + 1), np.zeros(symbols + 1, np.int64))
        marked = (order % every == 0) | (bwt == 0)
        self.marks = np.concatenate([[0], np.cumsum(marked)]).astype(np.int32)
        self.sample = order[marked]

    @staticmethod
    def suffixes(text: np.ndarray) -> np.ndarray:
        """Prefix doubling; every 0 has its own rank, by place, so that it ends all comparisons."""
        n, part = len(text), text == 0
        rank = np.where(part, np.cumsum(part) - 1, text + part.sum())
        k = 1
        while True:
            after = np.zeros(n, np.int64)
            after[: n - k] = rank[k:] + 1
            after[part] = 0
            key = rank * (rank.max() + 2) + after
            order = np.argsort(key)
            new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1:
                return order
            k *= 2

    def down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where place i ends up below if all bits read are those of c."""
        for level, ones, zeros in zip(reversed(range(self.levels)), self.ones, self.zeros, strict=True):
            up = ones[i]
            i = np.where((c >> level) & 1, zeros + up, i - up)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands in the BWT before i."""
        return self.down(c, i) - self.bottom[c]

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that occur, and the rows [from, to) of the suffixes that they begin."""
        which = np.arange(len(phrases.length))
        last = phrases.symbols[:, -1]
        lo, hi = self.before[last], self.before[last + 1]
        for j in range(2, phrases.symbols.shape[1] + 1):
            some = lo < hi
            which, lo, hi = which[some], lo[some], hi[some]
            c = phrases.symbols[which, -j]
            more = c > 0
            lo = np.where(more, self.before[c] + self.rank(c, lo), lo)
            hi = np.where(more, self.before[c] + self.rank(c, hi), hi)
        some = lo < hi
        return which[some], lo[some], hi[some]

    def locate(self, row: np.ndarray) -> np.ndarray:
        out, at, steps = np.empty(len(row), np.int64), np.arange(len(row)), 0
        while len(row):
            mark = self.marks[row + 1] > self.marks[row]
            out[at[mark]] = self.sample[self.marks[row[mark]]] + steps
            row, at, steps = row[~mark], at[~mark], steps + 1
            c, i = np.zeros(len(row), np.int64), row
            for ones, zeros in zip(self.ones, self.zeros, strict=True):
                up = ones[i]
                bit = ones[i + 1] - up
                c, i = c * 2 + bit, np.where(bit, zeros + up, i - up)
            row = self.before[c] + i - self.bottom[c]
        return out


def occurrences(texts: list[str], phrases: Phrases) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of a shard, and each occurrence: its phrase and the place of its first word among all words."""
    shard = Words(texts)
    none = np.zeros(0, np.int64)
    if not len(phrases.length) or not len(shard.hash):
        return shard, none, none
    symbol = np.searchsorted(phrases.vocabulary, shard.hash)
    symbol = np.where(phrases.vocabulary[np.minimum(symbol, len(phrases.vocabulary) - 1)] == shard.hash, symbol + 1, 0)
    new = np.concatenate([[True], (symbol[1:] == 0) | (symbol[:-1] == 0) | (np.diff(shard.of) != 0)])
    run = np.cumsum(new) - 1
    keep = (symbol > 0) & (np.bincount(run)[run] >= phrases.length.min())
    place = np.flatnonzero(keep)
    if not len(place):
        return shard, none, none
    own = run[place]
    gap = np.concatenate([[1], (np.diff(own) != 0).astype(np.int64)])
    at = np.arange(len(place)) + np.cumsum(gap)
    text = np.zeros(at[-1] + 2, np.int64)
    text[at] = symbol[place]
    back = np.zeros(len(text), np.int64)
    back[at] = place
    index = FMIndex(text, len(phrases.vocabulary))
    which, lo, hi = index.search(phrases)
    n = hi - lo
    rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    return shard, np.repeat(which, n), back[index.locate(rows)]


def judged(texts: list[str], phrases: Phrases) -> pd.DataFrame:
    shard, phrase, place = occurrences(texts, phrases)
    spans: list[list] = [[] for _ in texts]
    items: list[list] = [[] for _ in texts]
    if len(phrase):
        change = np.zeros(len(shard.hash) + 1, np.int64)
        np.add.at(change, place, 1)
        np.add.at(change, place + phrases.length[phrase], -1)
        hit = np.cumsum(change)[:-1] > 0
        doc = shard.of
        begin = np.flatnonzero(hit & np.concatenate([[True], ~hit[:-1] | (np.diff(doc) != 0)]))
        end = np.flatnonzero(hit & np.concatenate([~hit[1:] | (np.diff(doc) != 0), [True]]))
        for a, b in zip(begin, end, strict=True):
            base = shard.first[doc[a]]
            spans[doc[a]].append({"start": int(a - base), "end": int(b + 1 - base)})
        pair = np.unique(np.stack([doc[place], phrase], 1), axis=0)
        n = phrases.item_start[pair[:, 1] + 1] - phrases.item_start[pair[:, 1]]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(phrases.item_start[pair[:, 1]], n)
        for d, x in np.unique(np.stack([np.repeat(pair[:, 0], n), phrases.item[at]], 1), axis=0).tolist():
            items[d].append(x)
    return pd.DataFrame({"n_words": shard.count.astype(np.int64), "spans": spans, "items": items})


def blocks(items: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most limit bytes of text (a longer item alone); each fits the driver and a task."""
    rows = items.select(items[item].cast("long").alias("item"), items[text].alias("text")).where("item is not null and text is not null").distinct()
    own, size = [], 0
    for r in rows.orderBy("item", "text").toLocalIterator():
        if own and size + len(r.text) * 4 > limit:
            yield own
            own, size = [], 0
        own.append((r["item"], r.text))
        size += len(r.text) * 4
    yield own


def judge(phrases, shard_chars: int):
    """The column function for one block: phrases is a broadcast of Phrases."""

    @F.pandas_udf(RESULT)
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        released()
        for part in parts:
            texts = [t or "" for t in part]
            found = [judged(texts[a:b], phrases.value) for a, b in chunks(texts, shard_chars)]
            yield pd.concat(found, ignore_index=True) if found else judged([], phrases.value)
        released()

    # so called, it is computed once, where the plan puts it, however many filters and columns use its result
    return judge.asNondeterministic()


def with_contamination(df: DataFrame, items: DataFrame, text: str = "text", into: str = "contamination", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = 16 << 20, shard_chars: int = 2 << 20) -> DataFrame:
    """df with a struct column: n_words, spans (places of hit words, from and up to, merged) and items (sorted ids)."""
    spark = df.sparkSession
    small_batches(spark)
    names = []
    for block in blocks(items, item, item_text, block_bytes):
        phrases = spark.sparkContext.broadcast(Phrases.of(block, window))
        names.append(free_name(df, into if not names else f"{into}_block"))
        df = df.withColumn(names[-1], judge(phrases, shard_chars)(df[text]))
    if len(names) > 1:
        every = F.struct(
            F.col(names[0])["n_words"].alias("n_words"),
            F.expr(f"sort_array(concat({', '.join(f'`{n}`.spans' for n in names)}))").alias("spans"),
            F.array_sort(F.array_distinct(F.concat(*[F.col(n)["items"] for n in names]))).alias("items"),
        )
        merge = "aggregate({0}.spans, cast(array() as array<struct<start:int,end:int>>), (a, s) -> if(size(a) > 0 and s.start <= a[size(a) - 1].end, concat(slice(a, 1, size(a) - 1), array(struct(a[size(a) - 1].start as start, greatest(a[size(a) - 1].end, s.end) as end))), concat(a, array(s))))"
        df = df.withColumn(names[0], every).drop(*names[1:])
        df = df.withColumn(names[0], F.col(names[0]).withField("spans", F.expr(merge.format(f"`{names[0]}`"))))
    return df


def cut(text: str, spans) -> str:
    place = [m.span() for m in WORD.finditer(text.translate(LOWER))]
    out, last = [], 0
    for s in spans:
        out.append(text[last : place[s["start"]][0]])
        last = place[s["end"] - 1][1]
    return "".join([*out, text[last:]])


def without_spans(text, spans):
    """The text without the hit words and what stands between words of one span; null stays null."""

    @F.pandas_udf("string")
    def clean(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in parts:
            yield pd.Series([t if t is None or s is None or not len(s) else cut(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)
        released()

    return clean(text, spans)
