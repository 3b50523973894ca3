"""Quality classifier: a generalised additive model with pairwise interactions over measures of the whole text.

**Measures** (``MEASURES``) describe a text's words, characters and repetitions; a text without words has 0 in all of them.
Each is cut into at most ``BINS`` bins at quantiles of the training rows.

**Learning** is cyclic boosting: round after round every measure gets one shallow tree on its bins (at most ``LEAVES``
leaves, Newton steps of the log loss, shrunk by ``STEP``), which is added to that measure's lookup table. When a
share of the training rows set aside sees no lower loss for ``PATIENCE`` rounds, the tables of the best round stay. Then the
``PAIRS`` pairs of measures whose grid of bins explains most of what is left get tables of their own by the same
cycle, with trees that split one measure and then the other.

**Scoring** adds table entries: one search for the bin per measure and document, one lookup per table. The score is the
logistic function of the sum.

The model is fitted in one task on a bounded sample: at most about ``SAMPLE`` labelled ids, taken by a hash of the id, and at
most about as many distinct (measures, label) rows, each weighted by the number of its documents, so copies weigh as
much as they would alone. What the driver gets is the tables. Ids with both labels train with both. Null labels and
labels other than 0 and 1 are left out; without any label the score is 0.5, with one kind of label its smoothed share.

Null text counts as empty. Empty texts are scored like others. Every row is scored by itself, in one pass without a
shuffle, so repeated rows and null ids get their own results. Texts of any length are measured whole. An empty table gives
no rows. Other columns are kept by ``score``; those named ``score`` and ``predicted`` are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shipped, slices, texts_of
from tidemark.llm.hyperdim import held_out
from tidemark.sources.scratch import staged

MEASURES = [
    "log_words", "mean_word", "spread_word", "log_longest", "upper", "digits", "sentence_signs", "other_signs", "symbols", "beyond_ascii", "controls",
    "no_letter_words", "single_words", "distinct_words", "top_word", "same_as_previous", "repeated_triples", "log_line", "repeated_lines", "ratio",
    "entropy", "signs_per_word",
]
BINS, PAIR_BINS = 32, 12
LEAVES = 4
STEP = 0.1
ROUNDS, PATIENCE = 300, 20
PAIRS = 12
HELD = 0.15
SAMPLE = 30_000
RIDGE = 1.0
THRESHOLD = 0.3
GRAIN = 1 << 30

# Kinds of characters.
LOWER, UPPER, LETTER, DIGIT, SPACE, SENTENCE, SIGN, SYMBOL, CONTROL = range(9)


def kind_of(c: str) -> int:
    if c.isspace():
        return SPACE
    if c.isalpha():
        return UPPER if c.isupper() else LOWER if c.islower() else LETTER
    if c.isdigit():
        return DIGIT
    if c in ".!?":
        return SENTENCE
    if c in ",;:'\"()-":
        return SIGN
    return SYMBOL if c.isprintable() else CONTROL


_kinds: list[np.ndarray] = []


def kinds(codes: np.ndarray) -> np.ndarray:
    """Kind of each code point; those beyond the first plane count as letters."""
    if not _kinds:
        _kinds.append(np.array([CONTROL if 0xD800 <= n < 0xE000 else kind_of(chr(n)) for n in range(1 << 16)] + [LETTER], np.uint8))
    return _kinds[0][np.minimum(codes, 1 << 16)]


def repeated(keys: np.ndarray) -> float:
    """Share of entries that are not the first of their value."""
    return 1.0 - len(np.unique(keys)) / len(keys) if len(keys) else 0.0


def measures(text: str, pack: zstandard.ZstdCompressor) -> list[float]:
    """The numbers of ``MEASURES``."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(MEASURES)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds(codes)
    counts = np.bincount(kind, minlength=9).tolist()
    letters, shown = max(1, sum(counts[: LETTER + 1])), max(1, len(codes) - counts[SPACE])
    sizes = np.fromiter(map(len, words), np.int64, n)
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    often = np.bincount(ids)
    pairs = ids[:-1] * n + ids[1:]
    # Letters inside each word: the running count at its end less that at its start.
    inside = kind != SPACE
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    running = np.concatenate([[0], np.cumsum(kind <= LETTER)])
    in_word = running[edges[1::2]] - running[edges[::2]]
    lines = [line for line in text.split("\n") if line.strip()]
    raw = text.encode("utf-8", "surrogatepass")
    share = np.bincount(codes & 0xFFFF) / len(codes)
    share = share[share > 0]
    return [
        float(np.log1p(n)), float(sizes.mean()), float(sizes.std()), float(np.log1p(sizes.max())), counts[UPPER] / letters, counts[DIGIT] / shown,
        counts[SENTENCE] / shown, counts[SIGN] / shown, counts[SYMBOL] / shown, float((codes > 127).mean()), counts[CONTROL] / shown,
        float((in_word == 0).mean()), float((sizes == 1).mean()), float(np.log1p(len(number)) / np.log1p(n)), float(often.max() / n),
        float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0, repeated(pairs[:-1] * n + ids[2:]), float(np.log1p(n / len(lines))),
        1.0 - len(set(lines)) / len(lines), len(pack.compress(raw)) / len(raw), float(-(share * np.log2(share)).sum()),
        (counts[SENTENCE] + counts[SIGN] + counts[SYMBOL]) / n,
    ]


def measured(texts: list[str]) -> np.ndarray:
    pack = zstandard.ZstdCompressor(level=1)
    return np.array([measures(t, pack) for t in texts], np.float64).reshape(len(texts), len(MEASURES))


# --------------------------------------------------------------------------- model


@dataclass
class Additive:
    """Bin edges per measure and lookup tables: one per measure, one per pair (on coarser bins)."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, f], side="right")]
        if self.pairs:
            coarse = bins(x, self.pair_edges)
            for (i, j), table in zip(self.pairs, self.pair_tables):
                total += table[coarse[:, i], coarse[:, j]]
        return logistic(total)

    def dump(self) -> dict:
        """Plain lists, for a row of a table."""
        return {
            "base": float(self.base), "edges": [e.tolist() for e in self.edges], "tables": [t.tolist() for t in self.tables],
            "pair_edges": [e.tolist() for e in self.pair_edges], "pairs": [list(p) for p in self.pairs], "pair_tables": [t.ravel().tolist() for t in self.pair_tables],
        }

    @staticmethod
    def load(d) -> Additive:
        pair_edges = [np.array(e) for e in d["pair_edges"]]
        pairs = [tuple(p) for p in d["pairs"]]
        shaped = [np.array(t).reshape(len(pair_edges[i]) + 1, len(pair_edges[j]) + 1) for (i, j), t in zip(pairs, d["pair_tables"])]
        return Additive(d["base"], [np.array(e) for e in d["edges"]], [np.array(t) for t in d["tables"]], pair_edges, pairs, shaped)


LISTS = "array<array<double>>"
MODEL = f"base double, edges {LISTS}, tables {LISTS}, pair_edges {LISTS}, pairs array<array<int>>, pair_tables {LISTS}"


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)])


def quantile_edges(x: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Distinct inner edges that part the weight into about ``n`` equal shares."""
    order = np.argsort(x, kind="stable")
    reached = np.cumsum(weight[order])
    at = np.searchsorted(reached, reached[-1] * np.arange(1, n) / n)
    found = np.unique(x[order][np.minimum(at, len(x) - 1)])
    return found[found > x.min()]


def gain(g, h):
    return g * g / (h + RIDGE)


def tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Newton value per bin: the range of bins is split where it pays most, until there are ``leaves`` parts."""
    sum_g, sum_h = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    cuts = [0, len(g)]

    def best(lo: int, hi: int) -> tuple[float, int]:
        if hi - lo < 2:
            return 0.0, lo
        mid = np.arange(lo + 1, hi)
        parts = gain(sum_g[mid] - sum_g[lo], sum_h[mid] - sum_h[lo]) + gain(sum_g[hi] - sum_g[mid], sum_h[hi] - sum_h[mid])
        k = int(parts.argmax())
        return float(parts[k] - gain(sum_g[hi] - sum_g[lo], sum_h[hi] - sum_h[lo])), int(mid[k])

    for _ in range(leaves - 1):
        found, cut = max(best(lo, hi) for lo, hi in zip(cuts, cuts[1:]))
        if found <= 1e-9:
            break
        cuts = sorted([*cuts, cut])
    out = np.zeros(len(g))
    for lo, hi in zip(cuts, cuts[1:]):
        out[lo:hi] = (sum_g[hi] - sum_g[lo]) / (sum_h[hi] - sum_h[lo] + RIDGE)
    return out


def split_grid(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that splits the rows of the grid once and each half's columns once."""
    zero = np.zeros((1, g.shape[1]))
    sum_g, sum_h = (np.concatenate([zero, np.cumsum(x, axis=0)]) for x in (g, h))
    best, values = 0.0, np.zeros_like(g)
    whole = gain(g.sum(), h.sum())
    for cut in range(1, len(g)):
        total, parts = 0.0, []
        for a, b in ((sum_g[cut], sum_h[cut]), (sum_g[-1] - sum_g[cut], sum_h[-1] - sum_h[cut])):
            ga, ha = np.cumsum(a)[:-1], np.cumsum(b)[:-1]
            each = gain(ga, ha) + gain(a.sum() - ga, b.sum() - ha)
            k = int(each.argmax())
            total += each[k]
            parts.append((k + 1, ga[k] / (ha[k] + RIDGE), (a.sum() - ga[k]) / (b.sum() - ha[k] + RIDGE)))
        if total - whole > best + 1e-12:
            best = float(total - whole)
            for rows, (k, left, right) in zip((slice(0, cut), slice(cut, None)), parts):
                values[rows, :k], values[rows, k:] = left, right
    return best, values


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The better of splitting one measure first or the other."""
    one, other = split_grid(g, h), split_grid(g.T, h.T)
    return one if one[0] >= other[0] else (other[0], other[1].T)


def log_loss(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    return float((weight * (np.logaddexp(0, z) - y * z)).sum() / weight.sum())


class Cycle:
    """Boosting over a list of terms, each with the cell of every row and a table."""

    def __init__(self, cells: list[np.ndarray], shapes: list[tuple[int, ...]], z: np.ndarray, y: np.ndarray, weight: np.ndarray, held: np.ndarray):
        self.cells, self.shapes, self.z, self.y = cells, shapes, z.copy(), y
        self.weight, self.held = np.where(held, 0.0, weight), np.where(held, weight, 0.0)

    def sums(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        p = logistic(self.z)
        size = int(np.prod(self.shapes[t]))
        g = np.bincount(self.cells[t], self.weight * (self.y - p), size)
        return g.reshape(self.shapes[t]), np.bincount(self.cells[t], self.weight * p * (1 - p), size).reshape(self.shapes[t])

    def run(self, grow) -> tuple[list[np.ndarray], np.ndarray]:
        """Tables and sums after the best round."""
        tables = [np.zeros(s) for s in self.shapes]
        judge = self.held if self.held.sum() > 0 else self.weight
        best, kept, waited = log_loss(self.z, self.y, judge), ([t.copy() for t in tables], self.z.copy()), 0
        for _ in range(ROUNDS):
            for t in range(len(tables)):
                step = STEP * grow(*self.sums(t))
                tables[t] += step
                self.z += step.ravel()[self.cells[t]]
            loss = log_loss(self.z, self.y, judge)
            if loss < best - 1e-6:
                best, kept, waited = loss, ([t.copy() for t in tables], self.z.copy()), 0
            elif (waited := waited + 1) >= PATIENCE:
                break
        return kept


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, held: np.ndarray) -> Additive:
    """Model of the rows; ``held`` marks those that decide when to stop."""
    share = (float((weight * y).sum()) + 1) / (float(weight.sum()) + 2)
    base = float(np.log(share / (1 - share)))
    if not len(x) or y.min() == y.max():
        none = [np.zeros(0)] * len(MEASURES)
        return Additive(base, none, [np.zeros(1)] * len(MEASURES), none, [], [])
    weight = weight / weight.mean()
    edges = [quantile_edges(x[:, f], weight, BINS) for f in range(x.shape[1])]
    cells = list(bins(x, edges).T)
    start = np.full(len(x), base)
    tables, z = Cycle(cells, [(len(e) + 1,) for e in edges], start, y, weight, held).run(tree)
    pair_edges = [quantile_edges(x[:, f], weight, PAIR_BINS) for f in range(x.shape[1])]
    coarse = bins(x, pair_edges)
    every = list(combinations([f for f in range(x.shape[1]) if len(pair_edges[f])], 2))
    shapes = [(len(pair_edges[i]) + 1, len(pair_edges[j]) + 1) for i, j in every]
    grids = Cycle([coarse[:, i] * s[1] + coarse[:, j] for (i, j), s in zip(every, shapes)], shapes, z, y, weight, held)
    found = sorted(((pair_tree(*grids.sums(t))[0], -t) for t in range(len(every))), reverse=True)
    chosen = [-t for strength, t in found[:PAIRS] if strength > 0]
    pair_tables = Cycle([grids.cells[t] for t in chosen], [shapes[t] for t in chosen], z, y, weight, held).run(lambda g, h: pair_tree(g, h)[1])[0]
    return Additive(base, edges, tables, pair_edges, [every[t] for t in chosen], pair_tables)


# --------------------------------------------------------------------------- Spark


def measure_rows(docs: DataFrame) -> DataFrame:
    """Measures of each row's text, with its label (columns text, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat = pa.array(measured(texts_of(batch)).ravel())
            column = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(MEASURES), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([column, batch.column("label")], names=["x", "label"])

    return shipped(docs).select("text", "label").mapInArrow(run, "x array<double>, label int")


def share_of(column, part: float):
    """Rows whose hash lies in the lowest ``part``."""
    return F.pmod(column, F.lit(GRAIN)) < int(part * GRAIN)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """Distinct (measures, label) of sampled labelled documents with their number."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out()).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    known = staged(known, "labels")
    n = known.count()
    known = known.where(share_of(F.xxhash64("doc_id"), min(1.0, sample / max(n, 1))))
    # About ``sample`` ids: the side is counted before it is sent to all tasks.
    side = F.broadcast(known) if known.count() <= 2 * sample else known
    rows = measure_rows(docs.select("doc_id", "text").join(side, "doc_id"))
    rows = staged(rows.groupBy("x", "label").agg(F.count(F.lit(1)).alias("n")), "measures")
    return rows.where(share_of(F.xxhash64("x", "label"), min(1.0, sample / max(rows.count(), 1))))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Additive:
    """Fit on the labelled documents that are not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((tuple(r["x"]), r["label"], r["n"]) for b in batches for r in b.to_pylist())
        x = np.array([r[0] for r in rows], np.float64).reshape(len(rows), len(MEASURES))
        y, weight = (np.array([r[k] for r in rows], np.float64) for k in (1, 2))
        aside = np.random.Generator(np.random.PCG64(len(rows))).random(len(rows)) < HELD
        found = fit(x, y, weight, aside).dump()
        lists = pa.list_(pa.list_(pa.float64()))
        types = {"base": pa.float64(), "pairs": pa.list_(pa.list_(pa.int32()))}
        yield pa.RecordBatch.from_arrays([pa.array([v], types.get(c, lists)) for c, v in found.items()], names=list(found))

    rows = training_rows(docs, labels, label, sample)
    return Additive.load(shipped(rows).coalesce(1).mapInArrow(run, MODEL).first())


def score(docs: DataFrame, model: Additive, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of the documents with ``score`` and ``predicted``, which replace columns of that name."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = shipped(docs).select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = model.score(measured(texts_of(batch)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=[*kept, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = score(docs.select("doc_id", "text"), learn(docs, labels, label, sample))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
