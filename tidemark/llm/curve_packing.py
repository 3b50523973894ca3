"""Packing along a space-filling curve: documents with similar words share sequences, with next to no padding.

1. One pass tokenises every whole text and projects the document's hashed token vector (a +1/-1 vector per
   token id and dimension, averaged over the tokens) to ``DIMS`` numbers; ids, numbers and sizes are written once.
2. The numbers, scaled by the corpus mean and spread, are cut into ``2 ** BITS`` steps; their cell's place on the
   Hilbert curve, an expression, is the sort key, so the ids go through no Python process between their file and the shuffle. Equal keys (copies) are told apart by doc id and a digest, so a large group of
   copies is spread over partitions too.
3. Rows are range-partitioned by key, and each partition lays its ids end to end into sequences of ``length``
   tokens, cutting documents where a sequence is full. Only the last sequence of a partition is padded.

Null text counts as empty: the document is its end id alone. Repeated rows are packed once each, rows with a null doc id
too. A very long text is tokenised alone and cut over as many sequences as it needs. An empty table gives no rows. Columns
other than doc_id and text are not read, whatever their names. The number of
partitions follows from the tokens (``PART_TOKENS`` each).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.bpe_trie import BYTE_LEVEL_PATTERN, UNSTABLE, byte_alphabet
from tidemark.llm.common import shipped, slices, texts_of
from tidemark.sources.scratch import staged

DIMS, BITS = 3, 10
PART_TOKENS = 4_000_000
END_ID = 0
SEED = 77
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
# The split pattern for text without two white-space characters in a row: the same words, no look-ahead.
SINGLE_SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"""


class Ids:
    """Token ids as the vocabulary's library gives them, through the faster rank encoder where both agree."""

    def __init__(self, path: str):
        import json
        import re

        self.path, self._library = path, None
        spec = json.load(open(path, encoding="utf-8"))
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {c: b for b, c in enumerate(byte_alphabet())}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.fast, self.full = (
            tiktoken.Encoding(f"ranks{n}", pat_str=p, mergeable_ranks=ranks, special_tokens=special)
            for n, p in enumerate((SINGLE_SPACED, BYTE_LEVEL_PATTERN))
        )
        self.doubled = re.compile(r"\s\s")

    @property
    def library(self) -> Tokenizer:
        """Loaded when a text asks for it."""
        if self._library is None:
            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def encode(self, text: str) -> np.ndarray:
        if UNSTABLE.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return (self.full if self.doubled.search(text) else self.fast).encode_to_numpy(text, allowed_special="all").astype(np.uint32, copy=False)


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    return Ids(path)


@lru_cache(maxsize=4)
def directions(n: int, dims: int) -> np.ndarray:
    """A +1/-1 vector per token id."""
    return np.random.Generator(np.random.PCG64(SEED)).integers(0, 2, (n, dims)).astype(np.float32) * 2 - 1


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(path)
        table = directions(1 << 16, DIMS)
        for batch in slices(batches):
            every = [np.append(ids.encode(t), np.uint32(END_ID)) for t in texts_of(batch)]
            points = [table[x & 0xFFFF].mean(axis=0, dtype=np.float64).tolist() for x in every]
            narrow = [x.astype("<u2") if x.max() < 1 << 16 else x.astype("<u4") for x in every]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([len(x) for x in every], pa.int64()),
                    pa.array([x.tobytes() for x in narrow], pa.binary()),
                    pa.array(points, pa.list_(pa.float64())),
                ],
                names=["doc_id", "n", "ids", "point"],
            )

    return shipped(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n long, ids binary, point array<double>")


def hilbert_key(cells: list[Column], bits: int) -> Callable[[DataFrame], DataFrame]:
    """Adds ``key``, the place on the Hilbert curve of the cell given by whole numbers below ``2 ** bits``."""
    names = [f"x{d}" for d in range(len(cells))]
    falling = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)])

    def turn(x: Column, bit: Column) -> Column:
        # Where a coordinate's bit is set the lower bits of the first axis flip, else they are exchanged with that
        # axis; this turns each sub-cube so that curve pieces join.
        low, first, out = bit - 1, x["x0"], []
        first = F.when(first.bitwiseAND(bit) != 0, first.bitwiseXOR(low)).otherwise(first)
        for name in names[1:]:
            up, swap = x[name].bitwiseAND(bit) != 0, first.bitwiseXOR(x[name]).bitwiseAND(low)
            out.append(F.when(up, x[name]).otherwise(x[name].bitwiseXOR(swap)).alias(name))
            first = F.when(up, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(swap))
        return F.struct(first.alias("x0"), *out)

    def flip(so_far: Column, bit: Column, last: Column) -> Column:
        return F.when(last.bitwiseAND(bit) != 0, so_far.bitwiseXOR(bit - 1)).otherwise(so_far)

    def add(rows: DataFrame) -> DataFrame:
        start = F.struct(*[c.cast("long").alias(n) for n, c in zip(names, cells)])
        rows = rows.withColumn("_turned", F.aggregate(falling, start, turn))
        for before, name in zip(["", *names], names):
            # Each coordinate by the difference to the one before it.
            rows = rows.withColumn(f"_{name}", F.col(f"_turned.{name}") if not before else F.col(f"_turned.{name}").bitwiseXOR(F.col(f"_{before}")))
        rows = rows.withColumn("_flips", F.aggregate(falling, F.lit(0).cast("long"), lambda f, bit: flip(f, bit, F.col(f"_{names[-1]}"))))
        key = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for name in names:
                place = F.shiftright(F.col(f"_{name}").bitwiseXOR(F.col("_flips")), b).bitwiseAND(F.lit(1).cast("long"))
                key = F.shiftleft(key, 1).bitwiseOR(place)
        return rows.withColumn("key", key).drop("_turned", "_flips", *[f"_{n}" for n in names])

    return add


def with_key(rows: DataFrame) -> DataFrame:
    """Add the curve key; the scale is the corpus mean and spread of each number."""
    stats = rows.select(*[f(F.col("point")[d]).alias(f"{f.__name__}{d}") for d in range(DIMS) for f in (F.avg, F.stddev_pop)]).first()
    cells = []
    for d in range(DIMS):
        mean, spread = float(stats[f"avg{d}"] or 0.0), float(stats[f"stddev_pop{d}"] or 1.0)
        cell = F.floor(((F.col("point")[d] - mean) / spread + 3) / 6 * (1 << BITS))
        cells.append(F.greatest(F.lit(0), F.least(F.lit((1 << BITS) - 1), cell)))
    return hilbert_key(cells, BITS)(rows)


def lay_out(length: int):
    """Fill sequences one after the other with the rows of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence, filled = TaskContext.get().partitionId() << 40, 0
        names = [f.split()[0] for f in PIECES.split(", ")]
        for batch in slices(batches, "ids"):
            out = []
            for doc, n, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids"))):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                start = 0
                while start < n:
                    if filled == length:
                        sequence, filled = sequence + 1, 0
                    size = min(n - start, length - filled)
                    out.append((doc, start, size, zlib.crc32(ids[start : start + size].tobytes()), n, sequence, filled))
                    start, filled = start + size, filled + size
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    return run


def pack(docs: DataFrame, path: str, length: int = 1024) -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` tokens."""
    rows = staged(tokenised(docs, path), "packing")
    total = rows.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // PART_TOKENS))
    order = ["key", F.xxhash64("doc_id", "ids").alias("tie")]
    keyed = with_key(rows).select("doc_id", "n", "ids", *order)
    ranged = keyed.repartitionByRange(parts, "key", "tie").sortWithinPartitions("key", "tie")
    return ranged.select("doc_id", "n", "ids").mapInArrow(lay_out(length), PIECES)


def with_sequences(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """Each piece with its document's columns (for pipelines that go on with text)."""
    return pieces.join(docs, "doc_id")
