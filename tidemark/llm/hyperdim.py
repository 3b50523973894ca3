"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1, drawn from a seed and its code point. The vector of three
letters in a row is the product of the first letter's vector rotated by two places, the second's rotated by one and
the third's; a document's vector is the sum over all its letter triples, and a language's prototype is the sum over
its training documents, each with the same weight. The language whose prototype has the largest cosine is the
answer and the cosine, not below 0, the score. Ties go to the language that sorts first.

Letters are the alphabetic characters in lower case, anything else is one space. Text without a letter, and null,
gets ``und`` with score 0. Training rows without a language are left out; without any training row every
document gets ``und``. Each row is predicted alone, so repeated rows get repeated results; a very long text counts whole.
An empty table gives no rows.

Training is one pass that leaves one vector per task and language; prediction is one pass without a shuffle.
What reaches the driver is one vector per language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shipped, slices, texts_of

DIM = 1024
SEED = 20_240_501
UND = "und"
# Triples whose vectors a task keeps.
KEPT_TRIPLES = 30_000
_LETTER_BITS = 21  # a code point


@lru_cache(maxsize=20_000)
def letter(code: int, dim: int) -> np.ndarray:
    bits = np.random.Generator(np.random.Philox(key=[SEED, code])).integers(0, 2, dim, np.int8)
    return 2 * bits - 1


def triple_vector(triple: int, dim: int) -> np.ndarray:
    mask = (1 << _LETTER_BITS) - 1
    a, b, c = triple >> 2 * _LETTER_BITS, triple >> _LETTER_BITS & mask, triple & mask
    return np.roll(letter(a, dim), 2) * np.roll(letter(b, dim), 1) * letter(c, dim)


class Profiler:
    """Vectors of documents; keeps the vectors of triples it has met."""

    def __init__(self, dim: int):
        self.dim, self.space = dim, ord(" ")
        # Place of each code point's letter class: lower case letter or space. Filled as characters are met.
        self.place: dict[int, int] = {}
        self.rows: dict[int, int] = {}
        self.table = np.zeros((1024, dim), np.int8)

    def letters(self, text: str) -> np.ndarray:
        """Code points of the text, not-letters as spaces, runs of spaces as one, with a space at both ends."""
        lower = text.lower()
        codes = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)
        known, inverse = np.unique(codes, return_inverse=True) if len(codes) < 2000 else self._few(codes)
        kinds = np.array([c if chr(c).isalpha() else self.space for c in known.tolist()], np.int64)
        mapped = np.concatenate([[self.space], kinds[inverse] if len(codes) else kinds, [self.space]])
        blank = mapped == self.space
        return mapped[~(blank & np.concatenate([[False], blank[:-1]]))]

    @staticmethod
    def _few(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seen = np.zeros(int(codes.max()) + 1, bool)
        seen[codes] = True
        known = np.flatnonzero(seen)
        at = np.zeros(len(seen), np.int32)
        at[known] = np.arange(len(known))
        return known, at[codes]

    def triples(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct triples of a text and how often each occurs."""
        x = self.letters(text)
        if len(x) < 3:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.unique(x[:-2] << 2 * _LETTER_BITS | x[1:-1] << _LETTER_BITS | x[2:], return_counts=True)

    def vector(self, text: str) -> np.ndarray | None:
        """Sum of the triples' vectors; None without a letter."""
        found, counts = self.triples(text)
        if not len(found):
            return None
        rows, out = self.rows, np.zeros(self.dim, np.float32)
        if len(rows) > KEPT_TRIPLES:
            rows.clear()
        at = np.empty(len(found), np.int64)
        for n, t in enumerate(found.tolist()):
            r = rows.get(t)
            if r is None:
                r = rows[t] = len(rows)
                if r == len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[r] = triple_vector(t, self.dim)
            at[n] = r
        weights = counts.astype(np.float32)
        for n in range(0, len(at), 4096):
            out += weights[n : n + 4096] @ self.table[at[n : n + 4096]].astype(np.float32)
        return out


def prototypes(labelled: DataFrame, lang: str = "lang", dim: int = DIM) -> dict[str, np.ndarray]:
    """One vector per language of the labelled rows (columns ``text`` and ``lang``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler, sums = Profiler(dim), {}
        for batch in slices(batches):
            for text, name in zip(texts_of(batch), batch.column("lang").to_pylist()):
                v = profiler.vector(text)
                if v is not None and (size := np.linalg.norm(v)) > 0:
                    sums.setdefault(name, np.zeros(dim))
                    sums[name] += v / size
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()])], names=["lang", "v"])

    rows = shipped(labelled).select("text", F.col(f"`{lang}`").cast("string").alias("lang")).where(F.col("lang").isNotNull())
    parts = rows.mapInArrow(run, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    # Whole numbers of a fixed grain add up to the same sum in any order.
    grain = 2.0**40
    summed = parts.groupBy("lang", "i").agg(F.sum(F.round(F.col("x") * grain).cast("decimal(38,0)")).alias("x"))
    vectors = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", F.col("x").cast("double").alias("x")))).alias("v"))
    return {r["lang"]: np.array([e["x"] / grain for e in r["v"]]) for r in vectors.collect()}


def predict(docs: DataFrame, learned: dict[str, np.ndarray], dim: int = DIM) -> DataFrame:
    """All columns of the documents with ``lang_pred`` and ``score``, which replace columns of that name."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = shipped(docs).select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, score double"
    names = sorted(learned)
    table = np.array([learned[n] / np.linalg.norm(learned[n]) for n in names], np.float64).reshape(len(names), dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler = Profiler(dim)
        for batch in slices(batches):
            langs, scores = [], []
            for text in texts_of(batch):
                v = profiler.vector(text) if names else None
                size = 0.0 if v is None else float(np.linalg.norm(v))
                cosines = table @ v / size if size else None
                best = int(np.argmax(cosines)) if size else None
                langs.append(names[best] if size else UND)
                scores.append(min(1.0, max(0.0, float(cosines[best]))) if size else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def held_out(doc_id="doc_id"):
    """One document in five, by its id."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def language_id(docs: DataFrame, dim: int = DIM) -> DataFrame:
    """Learn from the labelled documents that are not held out, predict all."""
    train = docs.where(~F.coalesce(held_out(), F.lit(False))).select("text", "lang")
    return predict(docs, prototypes(train, dim=dim), dim).withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
