"""Near-duplicate classes from ProbMinHash signatures of weighted word shingles.

A shingle's weight is 1 + ln(its count in the text). Every shingle is a Poisson process whose rate is its weight; each arrival
falls into a random register, and a register keeps the shingle that arrives first. Two texts agree in a register with the
probability Jaccard similarity of their weighted shingles. Arrivals later than a text's last filled register can change
nothing, so a process stops there. Bands of registers make buckets; pairs from buckets are verified on the sets of their shingles' 48-bit hashes:
texts are linked if the Jaccard similarity of their shingle sets reaches the threshold. A text that repeats a shingle also has the
bands of its shingles at weight 1, which any other text has anyway, so the chance to miss a link depends on the Jaccard similarity
of the sets alone, whatever the counts. Classes are the connected components of the links.

Copies count once: texts with the same words make one representative, named by a hash of the words, before banding. In a bucket, each representative is first
compared with one leader, the one that shares buckets most often, as what a group of edited copies was made from does; then those that are still in
different classes with another of each bucket, so a group of copies needs a few comparisons for each member. What still shares a bucket across classes then goes through an exact set-similarity join: two
texts of that similarity share one of the rarest fifth of their shingles, which in a group of edited copies are the edits. There each text is first compared with one text of each larger
class that it meets, again and again while that joins classes; only pairs of the classes that stay are then compared in full, so none is left out.

Cases: words are lower-cased (A-Z) and parted by ASCII white space. A text of one to four words is one shingle. A null text, or
one without words, is a class of its own. The class id is the smallest id in the class. Repeated rows (same id, same text)
get the same class; rows with a null id are linked by their text, and are null only where the class has no other id. An id that stands
on several texts has each of them compared, and each row gets its own text's class. Very long texts are taken whole; a task holds one of
them, or some millions of characters, at a time. An empty table gives no rows. Of the table only the id and the text are read, so no column clashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, free_name, mix, released, slim, small_batches, unit, written

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
DOC = np.uint64(16)


def some(df: DataFrame) -> bool:
    """Whether df has a row. One partition is looked at first, and nothing is shuffled, so that the driver has fewer tasks to keep account of."""
    return bool(df.take(1))


def words(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, in UTF-8."""
    return text.encode("utf-8", "replace").lower().split()


def shingles(texts: list[list[bytes]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the text, 48-bit hash and count of every distinct shingle, in the order of both; at most 65,536 texts."""
    lens = np.array([len(t) for t in texts], np.int64)
    code, names = pd.factorize(np.array([w for t in texts for w in t], object))
    own = mix(pd.util.hash_array(np.asarray(names, object), categorize=False))[code] if len(code) else np.zeros(0, np.uint64)
    start = np.concatenate([[0], np.cumsum(lens)])[:-1]
    m = np.where(lens > 0, np.maximum(lens - size + 1, 1), 0)
    of = np.repeat(np.arange(len(texts)), m)
    at = np.arange(m.sum()) - np.repeat(np.concatenate([[0], np.cumsum(m)])[:-1], m) + np.repeat(start, m)
    ends = np.repeat(start + lens, m)
    h = np.zeros(len(at), np.uint64)
    padded = np.concatenate([own, np.zeros(size, np.uint64)])
    for j in range(size):
        h = h * np.uint64(0x100000001B3) + np.where(at + j < ends, padded[at + j], np.uint64(0))
    key = (of.astype(np.uint64) << np.uint64(48)) | (mix(h) >> DOC)
    key, count = np.unique(key, return_counts=True)
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), count


def signatures(of: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """ProbMinHash: the shingle that arrives first in each register of each text. All processes advance by one arrival a round;
    those that have passed their text's last register are over."""
    first, sig = np.full(texts * registers, np.inf), np.zeros(texts * registers, np.uint64)
    time, r = np.zeros(len(of)), 0
    while len(of):
        h = mix(shingle + np.uint64(r * 0x9FB21C651E98DF25 % 2**64))
        time = time - np.log(unit(h)) / weight
        at = of * registers + (mix(h) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, at, time)
        new = first[at] == time
        sig[at[new]] = shingle[new]
        live = time < first.reshape(texts, registers).max(1)[of]
        of, shingle, weight, time, r = of[live], shingle[live], weight[live], time[live], r + 1
    return sig.reshape(texts, registers)


def weights(count: np.ndarray) -> np.ndarray:
    return 1 + np.log(count)


def banded(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band of each text."""
    sig = sig.reshape(len(sig), bands, rows)
    band = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None], len(sig), 0)
    for j in range(rows):
        band = mix(band + sig[:, :, j])
    return band.view(np.int64)


def signed(df: DataFrame, size: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, raw, key (hash of the words; null without words) and hashes of bands (null without words): one for each band, and where shingles
    repeat one more for each band of the signature at weight 1 that differs."""

    def sign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        released()
        for part in parts:
            ids, raws, all_texts = part["id"].to_numpy(object), part["raw"].to_numpy(), ["" if t is None else t for t in part["text"]]
            for a, b in chunks(all_texts):
                for c in range(a, b, 4096):
                    texts = [words(t) for t in all_texts[c : min(b, c + 4096)]]
                    of, h, count = shingles(texts, size)
                    band = list(banded(signatures(of, h, weights(count), len(texts), bands * rows), bands, rows))
                    again = np.unique(of[count > 1])
                    own = np.isin(of, again)
                    plain = signatures(np.searchsorted(again, of[own]), h[own], np.ones(own.sum()), len(again), bands * rows)
                    for i, x in zip(again, banded(plain, bands, rows), strict=True):
                        band[i] = np.union1d(band[i], x)
                    yield pd.DataFrame({"id": pd.array(ids[c : c + len(texts)], "Int64"), "raw": raws[c : c + len(texts)], "key": [hashlib.blake2b(b" ".join(t), digest_size=16).digest() if t else None for t in texts], "bands": [x if t else None for x, t in zip(band, texts, strict=True)]})
        released()

    return df.mapInPandas(sign, "id long, raw long, key binary, bands array<long>")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, True))
    return common / (len(a) + len(b) - common)


def verified(pairs: DataFrame, texts: DataFrame, size: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough; texts: id, text."""

    def verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        released()
        for part in parts:
            good = []
            left, right = part["ta"].tolist(), part["tb"].tolist()
            for lo in range(0, len(part), 512):
                names = {t: k for k, t in enumerate(dict.fromkeys(left[lo : lo + 512] + right[lo : lo + 512]))}
                of, h, _ = shingles([words(t) for t in names], size)
                cut = np.searchsorted(of, np.arange(len(names) + 1))
                side = lambda t: h[cut[names[t]] : cut[names[t] + 1]]  # noqa: B023, E731
                good += [jaccard(side(t), side(u)) >= threshold for t, u in zip(left[lo : lo + 512], right[lo : lo + 512], strict=True)]
            yield part.loc[np.array(good, bool), ["a", "b"]]
        released()

    ta = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInPandas(verify, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of each component of edges (a, b). Labels spread along edges and then jump to the label
    of their label, so a path of n nodes takes about log n rounds; every round is written to the shared folder."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    at = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(at.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = at.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        jump = at.select(F.col("node").alias("new"), F.col("label").alias("far"))
        step = written(step.join(jump, "new").select("node", F.least("new", "far").alias("label"), (F.least("new", "far") != F.col("label")).alias("moved")), "labels")
        at = step.select("node", "label")
        if not some(step.where("moved")):
            return at


def prefixes(docs: DataFrame, size: int, threshold: float) -> DataFrame:
    """id, n, at, h: of every text of docs (id, text) the shingles, ordered by rarity among docs, of which two texts that reach the threshold have one in common:
    the first n - ceil(threshold * n) + 1, without those that no other text has. It is written."""

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        released()
        for part in parts:
            ids, texts = part["id"].to_numpy(), part["text"].tolist()
            for a, b in chunks(texts, 1 << 20):
                for c in range(a, b, 4096):
                    of, h, _ = shingles([words(t) for t in texts[c : min(b, c + 4096)]], size)
                    yield pd.DataFrame({"id": ids[c + of], "n": np.bincount(of)[of] if len(of) else of, "h": h.view(np.int64)})
        released()

    each = written(docs.select("id", "text").mapInPandas(spread, "id long, n long, h long"), "shingles")
    often = each.groupBy("h").agg(F.count("*").alias("seen")).where("seen > 1")
    ordered = each.join(often, "h", "left").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("seen", F.lit(1)).alias("seen"), "h"))).alias("all"))
    first = ordered.select("id", "n", F.posexplode(F.expr(f"slice(all, 1, cast(n - ceil({threshold} * n) + 1 as int))")).alias("at", "x"))
    return written(first.where("x.seen > 1").select("id", "n", "at", "x.h"), "prefixes")


def rare_pairs(rare: DataFrame, threshold: float, whole: bool) -> DataFrame:
    """Pairs (rep, leader) of different classes that can reach the threshold; rare: prefixes with the texts' classes (label). whole: all of them; else for each text
    and each larger class that it meets one text of that class, the one that has the common shingle first. Members of a large class need not ask for the small
    ones, which ask for it."""
    if not whole:
        of = rare.select("id", "label").distinct().groupBy("label").agg(F.count("*").alias("texts"))
        rare = rare.join(of, "label").select("id", "n", "at", "h", F.struct("texts", "label").alias("label"))
    u = rare.alias("u")
    if whole:
        v = rare.alias("v")
    else:
        v = rare.groupBy("h", "label").agg(F.min(F.struct("at", "id", "n")).alias("x")).select("h", "label", "x.at", "x.id", "x.n").alias("v")
    # all that a pair shares comes after its first common shingle in both, so what is left there bounds the overlap
    near = u.join(v, F.expr(f"u.h = v.h and u.label < v.label and least(u.n - u.at, v.n - v.at) * (1 + {threshold}) >= {threshold} * (u.n + v.n) - 1e-6"))
    if whole:
        return near.select(F.col("u.id").alias("rep"), F.col("v.id").alias("leader"))
    return near.groupBy(F.col("u.id").alias("rep"), F.col("v.label").alias("of")).agg(F.min(F.struct(F.greatest("u.at", "v.at").alias("at"), F.col("v.id").alias("leader"))).alias("x")).select("rep", "x.leader")


def near_duplicate_classes(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, star_rounds: int = 3) -> DataFrame:
    """One row for each row of df: id, class_id. At Jaccard similarity s of the shingle sets, a pair shares no bucket with probability
    (1 - s**rows)**bands at most, which is 0.00003 at 0.8 for the defaults."""
    spark = df.sparkSession
    small_batches(spark)
    docs = slim(df, id=key, text=text).select(F.col("id").cast("long").alias("id"), "text", F.xxhash64("text").alias("raw"))
    sig = written(signed(docs, size, bands, rows), "signatures")
    # copies: one representative for each key, counted inside each partition first; its text is read from the row with the smallest id
    row = F.struct(F.col("id").isNull().alias("none"), "id", "raw")
    reps = written(sig.where("key is not null").groupBy("key").agg(F.min(row).alias("row"), F.first("bands").alias("bands")).select("key", F.xxhash64("key").alias("rep"), "row.id", "row.raw", "bands"), "representatives")
    spread = reps.select("rep", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    sized = written(spread.join(shared, "bucket").distinct(), "buckets")
    # how often a text shares a bucket: in a group of edited copies, what they were made from is the nearest to all and has the most
    near = sized.groupBy("rep").agg(F.sum("n").alias("near"))
    members = written(sized.select("rep", "bucket").join(near, "rep"), "members")
    wanted = reps.select("rep", F.col("id").alias("first"), F.col("raw").alias("hash")).join(members.select("rep").distinct(), "rep", "left_semi")
    found = docs.where("text is not null").join(wanted, F.col("id").eqNullSafe(F.col("first")) & (F.col("raw") == F.col("hash")))
    texts = written(found.groupBy(F.col("rep").alias("id")).agg(F.min("text").alias("text")), "texts")
    labels = members.select(F.col("rep").alias("node")).distinct().select("node", F.col("node").alias("label"))
    tested = None
    rare, r, whole = None, 0, False
    while True:
        if rare is None:
            now = members.join(labels, F.col("rep") == F.col("node")).select("bucket", "rep", "near", "label")
            if r:
                mixed = now.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
                now = now.join(mixed, "bucket")
            if r < star_rounds:
                order = F.struct((F.xxhash64("rep", "bucket", F.lit(r)) if r else -F.col("near")).alias("by"), F.col("rep").alias("leader"), F.col("label").alias("of"))
                lead = now.groupBy("bucket").agg(F.min(order).alias("x")).select("bucket", "x.leader", "x.of")
                found = now.join(lead, "bucket").where("label != of").select("rep", "leader")
            else:
                rare = prefixes(texts.join(now.select(F.col("rep").alias("id")).distinct(), "id"), size, threshold)
        if rare is not None:
            # written, as each use in the self-join below would read and join all of it again
            found = rare_pairs(written(rare.join(labels, F.col("id") == F.col("node")).drop("node"), "labelled"), threshold, whole)
        pairs = found.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()
        pairs = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        links = written(verified(pairs, texts, size, threshold), "links") if not r or some(pairs) else None
        if links is not None and some(links):
            on = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_"))  # noqa: B023, E731
            merged = components(links.join(on("a"), "a").join(on("b"), "b").where("a_ != b_").select(F.col("a_").alias("a"), F.col("b_").alias("b")))
            labels = written(labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "classes")
        elif rare is not None and not whole:
            whole = True  # no class of one text each links any more: what is left is compared in full
            continue
        if whole:
            break
        r += 1
    named = written(reps.select("key", "rep", "id").join(labels, F.col("rep") == F.col("node"), "left").select("key", "id", F.coalesce("label", "rep").alias("label")), "named")
    # only classes of several representatives need the smallest id of all
    least = named.groupBy("label").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select("label", "least")
    classes = named.join(least, "label", "left").select("key", F.coalesce("least", "id").alias("class_id"))
    return sig.select("id", "key").join(classes, "key", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """df without the rows whose id is not its class's id. A null id, or an id that stands on several rows, is decided row by row
    in the same way, so repeated rows of a kept id stay repeated."""
    name = free_name(df, "near_id")
    drop = near_duplicate_classes(df, key, text, **params).where("id != class_id").select(F.col("id").alias(name)).distinct()
    return df.join(drop, df[key] == drop[name], "left_anti")
