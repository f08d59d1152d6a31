"""Lines that stand in several documents are dropped from all of them but the one with the largest id.

Every partition puts the hashes of its lines into two Bloom filters: cells of hashes seen once, and cells seen twice. Filters are
merged slot by slot (seen twice: twice on either side, or once on both), so a task holds a few slots and the order of partitions does
not matter. A line that two documents hold has all its cells in the filter of the twice-seen, so only lines that it returns can be
repeats: these alone are shuffled, with their whole keys, for exact counts and the choice of the document that keeps the line.
The filter has 16 cells for each line that may count, 2**30 at most (128 MB for the merged filter, the only thing that is broadcast whole);
in a larger corpus it returns more lines that stand once, which the exact counts then leave alone, so results are the same at every size.

A line's key is the line without ASCII white space at its ends and with A-Z in lower case. Repeats inside one document count once.

Cases: a null or empty text is one empty line. Each row is a document: repeated rows count as often as they stand, and rows with the
largest id all keep the line. A null id is smaller than any other. Very long texts are taken whole, as one row of an Arrow batch. An empty
table gives no rows. Of the table only the id and the text are read, so no column clashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slim, small_batches, written

SPACE = " \t\n\v\f\r"
HASHES, CELLS_PER_LINE, SLOTS = 3, 16, 256
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 30
#: Cells that a task holds before it hands on its filters; bytes of line numbers that may be broadcast.
HELD, BROADCAST = 1 << 22, 64 << 20


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lines of all texts and the number of lines of each."""
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    return lines.flatten(), pc.list_value_length(lines).to_numpy()


def keys(lines: pa.Array, least_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lines that are long enough, and their keys."""
    key = pc.ascii_lower(pc.utf8_trim(lines, SPACE))
    at = np.flatnonzero(pc.greater_equal(pc.utf8_length(key), least_chars).to_numpy(zero_copy_only=False))
    return at, key.take(pa.array(at)).to_numpy(zero_copy_only=False)


def hashes(key: np.ndarray) -> np.ndarray:
    return pd.util.hash_array(key, categorize=False) if len(key) else np.zeros(0, np.uint64)


def cells(h: np.ndarray, size: int) -> np.ndarray:
    """The cells of each hash, one row for each of HASHES."""
    step, last = (h >> np.uint64(32)) | np.uint64(1), np.uint64(size - 1)
    return np.stack([(h + np.uint64(i) * step) & last for i in range(HASHES)]).astype(np.int64)


def packed(at: np.ndarray) -> bytes:
    return zlib.compress(np.diff(at, prepend=0).astype("<u4").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<u4"), dtype=np.int64)


def filters(docs: DataFrame, size: int, least_chars: int) -> DataFrame:
    """slot, bits: the merged filter of the twice-seen, of so many cells in all."""
    width = size // SLOTS

    def seen(held: list[np.ndarray]) -> pd.DataFrame:
        at, n = np.unique(np.concatenate(held), return_counts=True)
        ends, twice = np.searchsorted(at, np.arange(SLOTS + 1) * width), n > 1
        slots = np.flatnonzero(np.diff(ends))
        own = [(at[ends[s] : ends[s + 1]] - s * width, twice[ends[s] : ends[s + 1]]) for s in slots]
        return pd.DataFrame({"slot": slots.astype(np.int32), "once": [packed(a) for a, _ in own], "twice": [packed(a[t]) for a, t in own]})

    def insert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            lines, lens = split(batch.column(0))
            at, key = keys(lines, least_chars)
            h = hashes(key)
            of = np.repeat(np.arange(len(lens)), lens)[at]
            h = h[~pd.DataFrame({"of": of, "h": h}).duplicated().to_numpy()]
            held.append(cells(h, size).ravel())
            n += held[-1].size
            if n > HELD:
                yield pa.RecordBatch.from_pandas(seen(held), preserve_index=False)
                held, n = [], 0
        if n:
            yield pa.RecordBatch.from_pandas(seen(held), preserve_index=False)

    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for part in parts:
            for slot, a, b in zip(part["slot"], part["once"], part["twice"], strict=True):
                once, twice = slots.setdefault(slot, (np.zeros(width, bool), np.zeros(width, bool)))
                at = unpacked(a)
                twice[at[once[at]]] = True
                twice[unpacked(b)] = True
                once[at] = True
        for slot, (_, twice) in slots.items():
            yield pd.DataFrame({"slot": [slot], "bits": [np.packbits(twice, bitorder="little").tobytes()]})

    each = docs.select("text").mapInArrow(insert, "slot int, once binary, twice binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return each.repartition(parts, "slot").mapInPandas(merge, "slot int, bits binary")


def suspects(docs: DataFrame, bits: np.ndarray, size: int, least_chars: int) -> DataFrame:
    """id, raw, key, line (its first place) of every long line of a document that the filter returns, once for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            lines, lens = split(batch.column("text"))
            at, key = keys(lines, least_chars)
            found = np.ones(len(at), bool)
            for c in cells(hashes(key), size):
                found &= (own[c >> 3] >> (c & 7).astype(np.uint8) & 1).astype(bool)
            at, key = at[found], key[found]
            of = np.repeat(np.arange(len(lens)), lens)[at]
            new = ~pd.DataFrame({"of": of, "key": key}).duplicated().to_numpy()
            at, key, of = at[new], key[new], of[new]
            line = at - (np.cumsum(lens) - lens)[of]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(of)), batch.column("raw").take(pa.array(of)), pa.array(key, pa.string()), pa.array(line.astype(np.int32))], ["id", "raw", "key", "line"])

    return docs.mapInArrow(probe, "id long, raw long, key string, line int")


def without_repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text", least_docs: int = 5, least_chars: int = 40) -> DataFrame:
    """id, n_lines, n_dropped and kept (the lines that stay, joined) for each row of df."""
    spark = df.sparkSession
    small_batches(spark)
    docs = slim(df, id=key, text=text).select(F.col("id").cast("long").alias("id"), F.xxhash64("text").alias("raw"), "text")
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    most = docs.agg(F.sum(F.least(lines, F.floor((F.octet_length("text") + 1) / (least_chars + 1))))).first()[0] or 0
    size = min(MOST_CELLS, max(LEAST_CELLS, 1 << (CELLS_PER_LINE * int(most)).bit_length()))
    bits = np.zeros((SLOTS, size // SLOTS // 8), np.uint8)
    for r in written(filters(docs, size, least_chars), "twice-seen").collect():
        bits[r.slot] = np.frombuffer(r.bits, np.uint8)
    found = written(suspects(docs, bits.ravel(), size, least_chars), "suspects")
    repeated = written(found.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("keep")).where(F.col("n") >= least_docs).select("key", "keep"), "repeated")
    lost = found.join(repeated, "key").where(~F.col("id").eqNullSafe(F.col("keep")))
    drops = written(lost.groupBy(F.col("id").alias("i"), F.col("raw").alias("r")).agg(F.sort_array(F.collect_set("line")).alias("lines")), "drops")
    held = drops.agg(F.sum(F.size("lines") * 4 + 64)).first()[0] or 0
    rows = docs.join(F.broadcast(drops) if held <= BROADCAST else drops, F.col("id").eqNullSafe(F.col("i")) & (F.col("raw") == F.col("r")), "left")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip = SPACE.encode()
        for batch in batches:
            lens = split(batch.column("text"))[1].astype(np.int64)
            texts, left = pc.fill_null(batch.column("text"), ""), lens.copy()
            at = np.flatnonzero(batch.column("lines").is_valid().to_numpy(zero_copy_only=False))
            if len(at):
                out = texts.to_pylist()
                for i, first in zip(at.tolist(), batch.column("lines").take(pa.array(at)).to_pylist(), strict=True):
                    own = out[i].split("\n")
                    name = [x.encode().strip(strip).lower() for x in own]
                    gone = {name[j] for j in first}
                    stay = [x for x, k in zip(own, name, strict=True) if k not in gone]
                    left[i], out[i] = len(stay), "\n".join(stay)
                texts = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lens), pa.array(lens - left), texts], ["id", "n_lines", "n_dropped", "kept"])

    return rows.select("id", "text", "lines").mapInArrow(drop, "id long, n_lines long, n_dropped long, kept string")
