"""Hard negatives by exact integer inner products, several candidates to a multiplication.

Components are made non-negative by adding a bias. The same component of several candidates goes into separate fields of one wide integer,
each wide enough for a whole inner product of biased vectors, so no field runs over into the next: one multiplication by an anchor's
component, added up over the components, gives all their inner products at once. The fields are then taken apart and the biases' share,
known from the sums of either vector, is subtracted. The wide integers are whole numbers below 2**53 in doubles, so a block of
anchors meets a block of candidates in one exact matrix product; where a single field needs more bits, they are Python integers of any width.

Anchors are a stated share of the rows. Blocks of anchors are joined with blocks of candidates by a key (block of anchors, slice of
candidates), under which a task holds one block of anchors and their best so far while the candidates' blocks stream by; each task returns
the best of its slice, and what the slices found is ranked for each anchor. This is done for the positives, whose scores bound the range
of scores for the negatives, and then for those. Every row is compared with every anchor; nothing is sampled.

Cases: rows with a null id, label or vector, or a null or non-finite entry, take no part; a shorter vector goes on with zeros. Ties go to the
smaller id. Repeated candidates each count; an anchor that is repeated in full is one anchor, one whose id stands on several rows is an anchor for
each of them, and rows with an anchor's own id are no positives of it. Without positives or negatives there are no rows, nor for an empty table. Only the three columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import one_thread, small_batches, written
from ._vectors import integers, stacked

#: Rows in a block of anchors and of candidates, and anchors that are multiplied at a time.
ANCHORS, CANDIDATES, TILE = 4096, 8192, 256
#: Bits of a whole number that a double holds, and fields of an integer where one field needs more.
EXACT, WIDE = 53, 8


class Packing:
    """Fields for inner products of vectors of d components from lo to hi."""

    def __init__(self, d: int, lo: int, hi: int):
        self.d, self.lo = d, lo
        self.bits = max(1, (d * (hi - lo) ** 2).bit_length())
        self.fields = EXACT // self.bits or WIDE
        self.kind = np.float64 if self.bits <= EXACT else object

    def packed(self, x: np.ndarray) -> np.ndarray:
        """Rows of candidates to rows of wide integers, so many candidates to each; the last is filled up with zeros."""
        whole = np.zeros((-(-len(x) // self.fields) * self.fields, self.d), np.int64 if self.kind is np.float64 else object)
        whole[: len(x)] = x.astype(whole.dtype) - self.lo
        weight = np.array([1 << (self.bits * f) for f in range(self.fields)], whole.dtype)
        return (whole.reshape(-1, self.fields, self.d) * weight[:, None]).sum(1).astype(self.kind)

    def scores(self, anchors: np.ndarray, wide: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Inner products of anchors with the candidates that wide holds. sums: of the candidates' components."""
        a = anchors.astype(np.int64 if self.kind is np.float64 else object) - self.lo
        product = a.astype(self.kind) @ wide.T
        if self.kind is np.float64:
            product = product.astype(np.int64)
        out = np.empty((*product.shape, self.fields), product.dtype)
        for f in range(self.fields):
            out[:, :, f] = (product >> (self.bits * f)) & ((1 << self.bits) - 1)
        out = out.reshape(len(a), -1)[:, : len(sums)]
        # (a - lo)(x - lo) = ax - lo a - lo x + lo lo
        return out + self.lo * (anchors.astype(out.dtype).sum(1)[:, None] + sums[None].astype(out.dtype)) - self.d * self.lo * self.lo


def blocks(rows: DataFrame, of: int, d: int) -> DataFrame:
    """no, ids, labels, rows (the anchors' numbers), x: the vectors of some rows (id, label, row, x) as bytes in one row."""

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for a in range(0, len(part), of):
                own = part.iloc[a : a + of]
                yield pd.DataFrame({"ids": [own["id"].to_numpy(np.int64).tobytes()], "labels": [own["label"].to_numpy(np.int64).tobytes()], "rows": [own["row"].to_numpy(np.int64).tobytes()], "x": [stacked(own["x"], d).tobytes()]})

    return rows.select("id", "label", "row", "x").mapInPandas(pack, "ids binary, labels binary, rows binary, x binary")


def matrix(row, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return (*(np.frombuffer(v, np.int64) for v in (row.ids, row.labels, row.rows)), np.frombuffer(row.x, np.int64).reshape(-1, d))


class Best:
    """The best of each group so far: pairs (score, id) by falling score and rising id, at most as many as wanted."""

    def __init__(self, wanted: int):
        self.wanted = wanted
        self.score, self.id, self.of = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        of, score, ids = np.concatenate([self.of, of]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, of))
        of, score, ids = of[order], score[order], ids[order]
        start = np.flatnonzero(np.diff(of, prepend=-1))
        place = np.arange(len(of)) - np.repeat(start, np.diff(np.append(start, len(of))))
        stay = place < self.wanted
        self.of, self.score, self.id = of[stay], score[stay], ids[stay]


def upper(ok: np.ndarray, s: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of s that may be among the wanted highest of their row where ok holds, ties of the last one included."""
    if s.shape[1] > wanted and s.dtype != object:
        low = np.iinfo(np.int64).min
        masked = np.where(ok, s, low)
        bound = np.partition(masked, s.shape[1] - wanted, axis=1)[:, s.shape[1] - wanted]
        ok = ok & (masked >= bound[:, None])
    return np.nonzero(ok)


def searched(anchor_blocks: DataFrame, candidate_blocks: DataFrame, packing: Packing, wanted: int, negatives: bool) -> DataFrame:
    """anchor (its number), place (number of the positive, 0 when these are searched), score, id: the best of each slice of candidates. The anchors'
    blocks have no (number) and, for negatives, the positives' scores as bytes."""
    spark = anchor_blocks.sparkSession
    n, parts = anchor_blocks.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = max(1, -(-parts // max(1, n)))
    names = ["kind", "no", "slice", "ids", "labels", "rows", "x", "bounds"]
    left = anchor_blocks.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).withColumn("kind", F.lit(0)).select(*names)
    right = candidate_blocks.withColumn("slice", F.pmod(F.xxhash64("ids", "x"), F.lit(slices)).cast("int")).withColumn("no", F.explode(F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array().cast("array<int>")))
    right = right.withColumn("kind", F.lit(1)).withColumn("bounds", F.lit(None).cast("binary")).select(*names)
    pairs = left.union(right).repartition(max(parts, n * slices), "no", "slice").sortWithinPartitions("no", "slice", "kind")
    d = packing.d

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one_thread()
        at = best = None

        def out() -> pd.DataFrame:
            return pd.DataFrame({"anchor": rows[best.of // wanted], "place": (best.of % wanted).astype(np.int32), "score": best.score, "id": best.id})

        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.kind == 0:
                    if best is not None and len(best.of):
                        yield out()
                    at = (row.no, row.slice)
                    ids, labels, rows, x = matrix(row, d)
                    bounds = np.frombuffer(row.bounds, np.int64).reshape(len(ids), wanted) if negatives else None
                    best = Best(wanted)
                    continue
                assert at == (row.no, row.slice)
                own_ids, own_labels, _, own = matrix(row, d)
                wide, sums = packing.packed(own), own.astype(object if packing.kind is object else np.int64).sum(1)
                for a in range(0, len(ids), TILE):
                    s = packing.scores(x[a : a + TILE], wide, sums)
                    same = labels[a : a + TILE, None] == own_labels[None]
                    if not negatives:
                        i, j = upper(same & (ids[a : a + TILE, None] != own_ids[None]), s, wanted)
                        best.add((a + i) * wanted, s[i, j].astype(np.int64), own_ids[j])
                        continue
                    for p in range(wanted):
                        b = bounds[a : a + TILE, p, None]
                        ok = ~same & (b > NONE) & (80 * b.astype(s.dtype) <= 100 * s) & (s <= b)
                        i, j = upper(ok, s, wanted)
                        best.add((a + i) * wanted + p, s[i, j].astype(np.int64), own_ids[j])
        if best is not None and len(best.of):
            yield out()

    return pairs.mapInPandas(stream, "anchor long, place int, score long, id long")


#: Bound of a positive that an anchor has not.
NONE = np.iinfo(np.int64).min


def hard_negatives(df: DataFrame, is_anchor, label_of: Column, key: str = "vec_id", vector: str = "embedding", wanted: int = 5) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. is_anchor: of the id column, whether a row is an anchor. label_of: the
    label, in terms of df's columns. A negative's score is 80 to 100 hundredths of its positive's."""
    spark = df.sparkSession
    small_batches(spark)
    own = df.select(F.col(key).alias("id"), F.col(vector).alias("vector"), label_of.alias("label"))
    rows = integers(own.where("id is not null and label is not null"), "id", "vector", "label").withColumn("label", F.col("label").cast("long"))
    rows = written(rows, "vectors")
    size = rows.agg(F.max(F.size("x")).alias("d"), F.min(F.least(F.array_min("x"), F.lit(0))).alias("lo"), F.max(F.greatest(F.array_max("x"), F.lit(0))).alias("hi")).first()
    packing = Packing(max(1, size.d or 0), size.lo or 0, size.hi or 0)
    every = written(blocks(rows.withColumn("row", F.lit(0)), CANDIDATES, packing.d), "candidates")
    anchors = written(rows.where(is_anchor(F.col("id"))).distinct().withColumn("row", F.monotonically_increasing_id()), "anchors")
    number = F.monotonically_increasing_id()
    held = written(blocks(anchors, ANCHORS, packing.d).withColumn("at", number), "anchor-blocks")
    # gapless numbers of the blocks: few rows, one for some thousands of anchors at most
    held = written(held.withColumn("no", (F.row_number().over(Window.orderBy("at")) - 1).cast("int")).withColumn("bounds", F.lit(None).cast("binary")), "numbered")

    by_score = [F.desc("score"), F.asc("id")]
    found = searched(held, every, packing, wanted, False)
    positives = written(found.withColumn("place", F.row_number().over(Window.partitionBy("anchor").orderBy(*by_score)) - 1).where(F.col("place") < wanted), "positives")

    def bounded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples(index=False):
                rows = np.frombuffer(r.rows, np.int64)
                out = np.full((len(rows), wanted), NONE)
                at = {v: i for i, v in enumerate(rows.tolist())}
                for p in r.positives if r.positives is not None else ():
                    out[at[p["anchor"]], p["place"]] = p["score"]
                yield pd.DataFrame({"no": [r.no], "ids": [r.ids], "labels": [r.labels], "rows": [r.rows], "x": [r.x], "bounds": [out.tobytes()]})

    listed = positives.join(anchor_numbers(held), "anchor").groupBy("no").agg(F.collect_list(F.struct("anchor", "place", "score")).alias("positives"))
    ready = held.drop("bounds").join(listed, "no", "left").select("no", "ids", "labels", "rows", "x", "positives")
    ready = written(ready.mapInPandas(bounded, "no int, ids binary, labels binary, rows binary, x binary, bounds binary"), "bounded")
    found = searched(ready, every, packing, wanted, True)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "place").orderBy(*by_score))).where(F.col("rank") <= wanted)
    ranked = ranked.select("anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = positives.join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor").select("anchor", "place", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(named, ["anchor", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def anchor_numbers(held: DataFrame) -> DataFrame:
    """anchor, no: the block of each anchor."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for no, rows in zip(part["no"], part["rows"], strict=True):
                yield pd.DataFrame({"anchor": np.frombuffer(rows, np.int64), "no": np.int32(no)})

    return held.select("no", "rows").mapInPandas(each, "anchor long, no int")
