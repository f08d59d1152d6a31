"""Language identification with bit-sliced Bloom filters of character n-grams.

One array of machine words holds the Bloom filters of all languages: bit l of a slot belongs to the filter of language l.
An n-gram reads k slots; their AND is the mask of all languages that it is typical of: those where its share of all n-grams is at
least a quarter of what it surely is in any other (its count less one standard deviation). However rare it is, and however many there
are, no n-gram of a language is left out for another reason. Popcounts of each bit over the n-grams of a text, corrected for the rate at which a filter of that fill answers
wrongly, are the hits of each language. A language learned from few rows has a filter that holds few of its n-grams, so hits are set against those that a
filter of its size can give: the share of all n-grams that so many of the most frequent ones make in the largest language, times the share of the
language's own that its filter took. FEW more n-grams without a hit keep short texts from small filters. The highest share decides.

Cases: a null text, or one without a letter, is ``und`` with score 0. A text with letters but no hit takes the most common
learned language with score 0. Ties go to the language that sorts first. Empty training data make everything ``und``.
Repeated rows are judged alike; very long texts are judged whole; other columns, whatever their names, pass through untouched.

Filters of all n-grams of a language, typical or not (ratio 0), were tried: they name held-out texts of the tables as well, but of a language learned from
one row only 43 % are then named right, as the other languages' large filters hold most of its n-grams too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import chunks, free_name, mix, released, slim, small_batches, written

SIZES, FEW = (3, 4), 10
RESULT = "lang_pred string, score double, coverage double, n_grams long"


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    out = np.zeros(0x110000, bool)
    out[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of lower-cased texts and the index of each one's text. Runs of non-letters count as one
    space, and each text begins and ends with one, so n-grams know word boundaries but never span two texts."""
    low = [t.lower() for t in texts]
    code = np.frombuffer("\x00".join(["", *low, ""]).encode("utf-32-le", "replace"), np.uint32)
    owner = np.concatenate([[0], np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])]).astype(np.int64)
    letter = _letters()[code]
    keep = letter | np.concatenate([[True], letter[:-1]])
    owner, letter = owner[keep], letter[keep]
    code = np.where(letter, code[keep], 32).astype(np.uint64)
    found, of = [], []
    for n in SIZES:
        if (m := len(code) - n + 1) < 1:
            continue
        h, inside = np.full(m, n, np.uint64), np.ones(m, bool)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + code[j : m + j]
            if 0 < j < n - 1:  # only the first and the last may be the space beside a word
                inside &= letter[j : m + j]
        found.append(mix(h[inside]))
        of.append(owner[1 : m + 1][inside])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(of)


def gram_counts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, gram, n over all rows that have both columns; counted inside each partition before the shuffle."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        released()
        held: dict[str, list] = {}

        def merged(pairs: list) -> tuple[np.ndarray, np.ndarray]:
            g, at = np.unique(np.concatenate([p[0] for p in pairs]), return_inverse=True)
            return g, np.bincount(at, np.concatenate([p[1] for p in pairs]), len(g)).astype(np.int64)

        for part in parts:
            for name, own in part.groupby("lang", sort=False)["text"]:
                texts = own.tolist()
                for a, b in chunks(texts, 1 << 20):
                    held.setdefault(name, []).append(np.unique(grams(texts[a:b])[0], return_counts=True))
                if sum(len(p[0]) for p in held[name]) > 2_000_000:
                    held[name] = [merged(held[name])]
        for name, pairs in held.items():
            g, n = merged(pairs)
            yield pd.DataFrame({"lang": name, "gram": g.view(np.int64), "n": n})
        held.clear()
        released()

    rows = slim(df, text=text, lang=lang).where("text is not null and lang is not null")
    return rows.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class LanguageFilters:
    """langs[l] owns bit l % w of word l // w of every slot, for words of w bits; wrong[l] is the rate of false answers of its filter, and
    covers[l] the share of the n-grams of a new text in that language that it is expected to hold."""

    langs: list[str]
    slots: np.ndarray
    hashes: int
    wrong: np.ndarray
    common: int
    covers: np.ndarray | float = 1.0

    @staticmethod
    def positions(gram: np.ndarray, size: int, hashes: int) -> list[np.ndarray]:
        step = mix(gram ^ np.uint64(0xA5A5A5A5)) | np.uint64(1)
        return [((gram + np.uint64(j) * step) & np.uint64(size - 1)).astype(np.int64) for j in range(hashes)]

    @classmethod
    def fit(cls, df: DataFrame, text: str = "text", lang: str = "lang", ratio: float = 0.25, hashes: int = 4, bits: int = 16) -> LanguageFilters:
        """Counts cover all rows of df, and a filter holds all n-grams with a share of at least ratio of the sure share in any language.
        The filters are filled in Spark, in blocks of slots; the driver gets the blocks, in all about bits bits for each n-gram of the largest language
        and each language, and no n-grams. What covers rests on is one row for each count that occurs in the largest language, the root of its size at most."""
        spark = df.sparkSession
        small_batches(spark)
        n = written(gram_counts(df, text, lang), "grams")
        totals = {r.lang: r.n for r in n.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        langs = sorted(totals)
        if not langs:
            return cls([], np.zeros((1, 1), np.uint64), hashes, np.zeros(0), 0)
        of = lambda values: F.element_at(F.create_map(*[F.lit(x) for k, v in zip(langs, values, strict=True) for x in (k, v)]), F.col("lang"))
        total = of([float(totals[k]) for k in langs])
        each = n.select("gram", of(list(range(len(langs)))).alias("l"), "n", (F.col("n") / total).alias("share"), ((F.col("n") - F.sqrt("n")) / total).alias("sure"))
        per_gram = each.groupBy("gram").agg(F.max("sure").alias("most"), F.collect_list(F.struct("l", "share", "n")).alias("each"))
        kept = written(per_gram.select("gram", "most", F.explode("each").alias("e")).where(F.expr(f"e.share >= {ratio} * most")).select("gram", "e.l", "e.n"), "kept")
        common = max(range(len(langs)), key=lambda i: (totals[langs[i]], -i))
        often = n.where(F.col("lang") == langs[common]).groupBy("n").agg(F.count("*").alias("grams")).orderBy(F.desc("n")).toPandas()
        first = np.concatenate([[0], np.cumsum(often["grams"])])
        mass = np.concatenate([[0], np.cumsum(often["grams"] * often["n"])]) / totals[langs[common]]
        distinct = {r.lang: r.grams for r in n.groupBy("lang").agg(F.count("*").alias("grams")).collect()}
        size, covers = 64, np.ones(len(langs))
        for r in kept.groupBy("l").agg(F.count("*").alias("held"), F.sum("n").alias("n")).collect():
            size = max(size, bits * r.held)
            covers[r.l] = np.interp(distinct[langs[r.l]], first, mass) * r.n / totals[langs[r.l]]
        size = 1 << int(np.ceil(np.log2(size)))
        span = min(size, 1 << 16)
        # words no wider than the languages need, as the filters should stay in the processor's cache
        width = next((w for w in (8, 16, 32) if len(langs) <= w), 64)
        kind = np.dtype(f"uint{width}")

        def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            released()
            for part in parts:
                for at in cls.positions(part["gram"].to_numpy(np.int64).view(np.uint64), size, hashes):
                    yield pd.DataFrame({"word": part["l"] // width, "block": at // span, "slot": at % span, "bit": part["l"] % width})

        def fill(part: pd.DataFrame) -> pd.DataFrame:
            out = np.zeros(span, kind)
            for bit, own in part.groupby("bit")["slot"]:
                out[own.unique()] |= kind.type(1 << bit)
            return pd.DataFrame({"word": part["word"].iloc[:1], "block": part["block"].iloc[:1], "slots": [out.tobytes()]})

        placed = kept.select("gram", "l").mapInPandas(place, "word int, block long, slot int, bit int").distinct()
        slots = np.zeros((-(-len(langs) // width), size), kind)
        for r in placed.groupBy("word", "block").applyInPandas(fill, "word int, block long, slots binary").toLocalIterator():
            slots[r.word, r.block * span : (r.block + 1) * span] = np.frombuffer(r.slots, kind)
        wrong = np.array([np.mean((slots[i // width] & kind.type(1 << (i % width))) != 0) ** hashes for i in range(len(langs))])
        return cls(langs, slots, hashes, wrong, common, covers)

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        count, bits = len(texts), len(self.langs)
        width, kind = self.slots.dtype.itemsize * 8, self.slots.dtype.type
        hits, total = np.zeros((count, bits)), np.zeros(count)
        known = ["" if t is None else t for t in texts]
        for a, b in chunks(known, 1 << 20):
            gram, of = grams(known[a:b])
            total[a:b] = np.bincount(of, minlength=b - a)
            at = self.positions(gram, self.slots.shape[1], self.hashes)
            for w, words in enumerate(self.slots):
                mask = words[at[0]]
                for p in at[1:]:
                    mask &= words[p]
                for i in range(w * width, min(bits, (w + 1) * width)):
                    hits[a:b, i] = np.bincount(of, (mask & kind(1 << (i % width))) != 0, b - a)
        if not bits:
            return pd.DataFrame({"lang_pred": ["und"] * count, "score": 0.0, "coverage": 0.0, "n_grams": total.astype(np.int64)})
        right = np.maximum(0, (hits - total[:, None] * self.wrong) / (1 - np.minimum(self.wrong, 0.99)))
        able = total[:, None] * self.covers
        share = right / (able + FEW)
        best, all_hits = share.argmax(1), share.sum(1)
        best[all_hits == 0] = self.common
        top, able = share[np.arange(count), best], np.broadcast_to(able, right.shape)[np.arange(count), best]
        found = right[np.arange(count), best]
        seen = total > 0
        names = np.array(self.langs, object)[best]
        names[~seen] = "und"
        return pd.DataFrame({"lang_pred": names, "score": np.where(all_hits > 0, top / np.maximum(all_hits, 1e-9), 0.0), "coverage": np.where(seen, np.minimum(1, found / np.maximum(able, 1e-9)), 0.0), "n_grams": total.astype(np.int64)})

    def column(self, spark, text: Column) -> Column:
        """A struct of lang_pred, score, coverage and n_grams for a text column. The filters travel as a broadcast."""
        model = spark.sparkContext.broadcast(self)

        @F.pandas_udf(RESULT)
        def identify(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            released()
            for texts in parts:
                yield model.value.predict([None if t is None else t for t in texts])
            released()

        return identify(text)


def with_language(df: DataFrame, model: LanguageFilters, text: str = "text", into: str = "language") -> DataFrame:
    """df with one more struct column; into gets a longer name if df has that column already."""
    small_batches(df.sparkSession)
    return df.withColumn(free_name(df, into), model.column(df.sparkSession, df[text]))
