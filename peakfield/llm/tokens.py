"""Token ids in flat files of unsigned integers, with 64-bit document offsets.

Documents are range-partitioned by id and sorted, so files in order hold them in ascending id order. Every task encodes its
documents and writes one file of ids; prefix sums of the tasks' totals give each file's base, and a second, small job writes
every file's global offsets. Files are written under another name and then renamed, so that a task that runs again after a lost
executor leaves one whole file. A part has a bounded number of bytes of text, and its ids go to the file as they are made. Readers map files of a local or shared file system into memory.

Files of part p: ids-p.bin (uint16 if the vocabulary allows, else uint32; little-endian), docs-p.bin (int64 document ids),
offsets-p.bin (uint64, one more than documents: the place of each document's first id among all ids, and of the end).

Cases: a null or empty text is the end id alone. A null document id is stored as the lowest int64, sorts first and is read back as
null. Repeated ids stay, ordered by text. An empty table gives no parts. Special tokens' strings in a text are ordinary text. A text
of any length is encoded whole; a task holds one text or a few million characters at a time. Other columns of the table are not read.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain, compress, repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import chunks, slim, small_batches

NO_ID = np.iinfo(np.int64).min
#: A text may be cut before a space with a visible character after it: the pre-tokenizer of byte-level BPE always ends a piece there.
CUT = re.compile(r"(?= \S)")
#: Marks a piece that has no space before it.
BARE = "\x00"
#: Between a letter or digit and these the pre-tokenizer always ends a piece.
TAIL = ".,;:!?"
KEEP = 1_000_000
#: Bytes of text in one part, which is one task's work and one file of ids.
PART_BYTES = 256 << 20


@contextmanager
def placed(uri: str) -> Iterator:
    """A stream to a file that gets its name when it is whole."""
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        yield f
    fs.move(part, path)


def put(uri: str, data: np.ndarray) -> None:
    with placed(uri) as f:
        f.write(data.tobytes())


def mapped(uri: str, dtype: str) -> np.ndarray:
    """The file as an array: a memory map where the file system is local or mounted, else its bytes."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    fs, path = FileSystem.from_uri(uri)
    if isinstance(fs, LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


class Encoder:
    """Ids of whole texts, by the tokenizers library. Pieces that texts share are encoded once and kept, up to a bound."""

    loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.start, self.seen = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def shrink(self) -> None:
        """Forgets the pieces met once only, as most are, or all if that leaves more than half of the bound."""
        keep = np.flatnonzero(self.seen > 1)
        keys, n = list(self.known), np.diff(self.start)[keep]
        ids, seen = self.gathered(keep, n), self.seen[keep]
        self.forget()
        if len(keep) <= KEEP // 2:
            self.add([keys[i] for i in keep.tolist()], ids, n)
            self.seen = seen

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def learn(self, keys: list[str]) -> None:
        """Encodes new pieces. What stands before the punctuation at a word's end is encoded once for all words that differ in that alone."""
        cores = [k.rstrip(TAIL) for k in keys]
        parted = [len(c) < len(k) and c[-1:].isalnum() for k, c in zip(keys, cores, strict=True)]
        whole = dict.fromkeys(k for k, p in zip(keys, parted, strict=True) if not p)
        ended, core = list(compress(keys, parted)), list(compress(cores, parted))
        tail = [BARE + k[len(c) :] for k, c in zip(ended, core, strict=True)]
        whole |= dict.fromkeys(x for x in chain(core, tail) if x not in self.known)
        line = whole.keys() & {"\n"}
        bare = [k for k in whole if k[0] == BARE]
        words = [k for k in whole if k[0] != BARE and k not in line]
        own = [self.apart(words, " "), self.apart([k[1:] for k in bare], ""), self.apart(list(line), "")]
        self.add([*words, *bare, *line], *(np.concatenate(x) for x in zip(*own, strict=True)))
        if ended:
            two = np.fromiter(map(self.known.__getitem__, chain(core, tail)), np.int64, 2 * len(ended)).reshape(2, -1).T.ravel()
            n = self.start[two + 1] - self.start[two]
            self.add(ended, self.gathered(two, n), n.reshape(-1, 2).sum(1))

    def apart(self, names: list[str], space: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of names with that before each, one after another, and how many each has: visible ones as lines of one text, parted again at the line ends."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for a in range(0, len(names), 20_000):
            part = names[a : a + 20_000]
            text = space + f"\n{space}".join(part)
            own = np.array(self.ids_of([text])[0], np.uint32) if text.split() == part else np.zeros(0, np.uint32)
            ends = np.flatnonzero(own == self.line[0])
            if len(self.line) == 1 and len(ends) == len(part) - 1 and len(own):
                ids.append(np.delete(own, ends))
                counts.append(np.diff(np.concatenate([[-1], ends, [len(own)]])) - 1)
            else:
                each = self.ids_of([space + x for x in part])
                ids += [np.array(x, np.uint32) for x in each]
                counts.append(np.array([len(x) for x in each], np.int64))
        return np.concatenate(ids), np.concatenate(counts)

    def add(self, keys: list[str], ids: np.ndarray, n: np.ndarray) -> None:
        self.known.update(zip(keys, range(len(self.known), len(self.known) + len(keys)), strict=True))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(n)])
        self.ids = np.concatenate([self.ids, ids])
        self.seen = np.concatenate([self.seen, np.zeros(len(keys), np.int64)])

    def gathered(self, code: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Ids of known pieces, one after another; n: how many each has."""
        return self.ids[np.arange(n.sum()) + np.repeat(self.start[code] - np.cumsum(n) + n, n)]

    def ids_of(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def keys(text: str) -> list[str]:
        """The pieces of a text: words with a space before them, line ends, and marked ones that have no space."""
        if BARE in text or " ".join(text.split()) != text.replace("\n", " "):  # white space other than single spaces and line ends
            return [p[1:] if p[0] == " " and p[1:] and p[1] != BARE and p != " \n" else BARE + p for p in CUT.split(text) if p]
        out = f"{BARE}{text}".replace("\n", " \n \x00").split(" ")
        return out if out[0] != BARE else out[1:]

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by the end id, and how many each has."""
        pieces = [self.keys(t) for t in texts]
        flat = list(chain.from_iterable(pieces))
        if len(self.known) > KEEP:
            self.shrink()
        code = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        if len(new := np.flatnonzero(code < 0)):
            names = list(map(flat.__getitem__, new.tolist()))
            self.learn(list(dict.fromkeys(names)))
            code[new] = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        self.seen += np.bincount(code, minlength=len(self.seen))
        n = self.start[code + 1] - self.start[code]
        total, ids = np.concatenate([[0], np.cumsum(n)]), self.gathered(code, n)
        ends = total[np.cumsum([len(p) for p in pieces])] if texts else np.zeros(0, np.int64)
        return np.insert(ids, ends, np.uint32(end)), np.diff(np.concatenate([[0], ends])) + 1


def write_tokens(df: DataFrame, uri: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = 0, parts: int | None = None) -> None:
    """Encodes df into files below uri, a folder that driver and executors share."""
    spark = df.sparkSession
    small_batches(spark)
    own = slim(df, id=key, text=text)
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    # the hash parts an id that stands on very many rows; equal ids stay in order of hash, then text
    ordered = own.withColumn("h", F.xxhash64("text")).repartitionByRange(parts, "id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, encoder = TaskContext.get().partitionId(), Encoder.of(tokenizer)
        kind = "<u2" if encoder.vocabulary <= 1 << 16 else "<u4"
        docs, lens = [], []
        first = next(batches, None)
        if first is None:
            return
        with placed(f"{uri}/ids-{p:06d}.bin") as out:
            for batch in chain([first], batches):
                texts = [t or "" for t in batch["text"]]
                docs.append(batch["id"].fillna(NO_ID).to_numpy(np.int64) if batch["id"].dtype != object else np.array([NO_ID if x is None else x for x in batch["id"]], np.int64))
                for a, b in chunks(texts, 4 << 20):
                    found, n = encoder.encode(texts[a:b], end)
                    out.write(found.astype(kind).tobytes())
                    lens.append(n)
        lens = np.concatenate(lens).astype(np.int64) if lens else np.zeros(0, np.int64)
        put(f"{uri}/docs-{p:06d}.bin", np.concatenate(docs))
        put(f"{uri}/lens-{p:06d}.bin", lens)
        yield pd.DataFrame({"part": [p], "tokens": [int(lens.sum())], "width": [int(kind[2])]})

    # one row for each part reaches the driver, whatever the number of documents
    rows = sorted(ordered.mapInPandas(encode, "part int, tokens long, width int").collect())
    bases = np.concatenate([[0], np.cumsum([r.tokens for r in rows])]).tolist()

    def offset(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                lens = mapped(f"{uri}/lens-{r.part:06d}.bin", "<i8")
                put(f"{uri}/offsets-{r.part:06d}.bin", (r.base + np.concatenate([[0], np.cumsum(lens)])).astype("<u8"))
            yield batch

    table = spark.createDataFrame([(r.part, b, r.width) for r, b in zip(rows, bases, strict=False)], "part int, base long, width int")
    table.repartition(max(1, min(len(rows), 64))).mapInPandas(offset, table.schema).write.parquet(f"{uri}/parts")


def read_tokens(spark: SparkSession, uri: str, columns: str = "ids array<long>", of: Callable[[np.ndarray], tuple] = lambda ids: (ids.tolist(),)) -> DataFrame:
    """One row for each document: id, start, n_tokens, and what the function makes of its ids (the ids themselves if none is given)."""
    names = [c.split()[0] for c in columns.split(",")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                ids = mapped(f"{uri}/ids-{r.part:06d}.bin", f"<u{r.width}")
                docs = mapped(f"{uri}/docs-{r.part:06d}.bin", "<i8")
                offsets = mapped(f"{uri}/offsets-{r.part:06d}.bin", "<u8").astype(np.int64)
                for a in range(0, len(docs), 4096):
                    at = offsets[a : a + 4097]
                    found = [of(ids[x - r.base : y - r.base]) for x, y in zip(at, at[1:], strict=False)]
                    out = pd.DataFrame({"id": pd.array(docs[a : a + 4096], "Int64"), "start": at[:-1], "n_tokens": np.diff(at)})
                    out.loc[out["id"] == NO_ID, "id"] = pd.NA
                    yield out.assign(**{n: [f[k] for f in found] for k, n in enumerate(names)})

    parts = spark.read.schema("part int, base long, width int").parquet(f"{uri}/parts")
    return parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").mapInPandas(read, f"id long, start long, n_tokens long, {columns}")


def crc32(ids: np.ndarray) -> tuple:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return (zlib.crc32(ids.astype("<u4").tobytes()),)
