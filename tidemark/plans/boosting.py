"""Boosting that goes on from where it stopped: trees are added to a stored ensemble, none is ever fitted again.

The rows are a staged table of features, label, weight and a ``margin``, the sum of the trees grown so far. Rows of the same
features and label, which no tree can tell apart, are one row with their weights added up and their number. A chunk of trees
(``chunk``, more once many are there) is grown on all rows that are not set aside, each tree on the slopes of the loss at the
margins left by the one before, with second-order leaf values (sum of slopes over sum of curvatures). Up to ``SAMPLE_CELLS``
feature values the rows go to one task, which grows the whole chunk. Larger tables stay spread: their rows are kept as blocks
of bins (``Spread``), and a level of a tree is one job, in which every task sums its own blocks; the driver gets one sum per
node, feature and bin and picks the splits. Bins are cut at quantiles of all these rows either way, so both grow the same trees
but for rounding. After a chunk one pass adds the trees' output to the margin of every row, and the losses after each of these
trees are summed over the rows set aside. The table it writes is all that the next chunk needs; the table before it is deleted.
So lineage never grows beyond a chunk, and a lost executor costs its tasks.

Inside a task features of few bins share one code, so a level takes one sum per code instead of one per feature;
only the smaller child of a split is summed, the other one is what is left of its parent.

``grow`` takes the state and gives a longer one: 32 trees grown to 64 and 128 are the trees of one run of 128.
Without rows set aside nothing can end the growth early: all trees asked for are grown.

Growing and summing trees are Arrow functions, or Python functions on the blocks of a large table; everything else is expressions.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ordered import prefix_scan, running_sum
from tidemark.sources.scratch import remove, scratch_folder, staged
from tidemark.sources.shipping import shipped
from tidemark.sources.tables import load_spec, save_spec

LOGISTIC, ABSOLUTE = "logistic", "absolute"
# Feature values up to which one task grows the trees; the rows of larger tables stay where they are. Nothing is left out.
SAMPLE_CELLS = 1 << 24
# Feature values of a block of a larger table, and trees after which the blocks are written to the shared folder.
BLOCK_CELLS = 1 << 21
WRITTEN = 32
# Tasks whose sums go to the driver as they are.
GATHERED = 16
TASK_ROWS = 100_000
BINS = 64
# Combinations of bins that features sharing a code may have.
PACKED = 2048
UNWATCHED = 8
# Gains whose difference is smaller, as a share of them, are ties.
SAME = 1e-11
# Rows that a scoring task remembers the value of.
KNOWN = 1 << 17


@dataclass(frozen=True)
class Boost:
    """How far to boost: at most ``max_iter`` trees of ``depth``, until ``patience`` trees brought nothing."""

    max_iter: int = 2000
    depth: int = 7
    step: float = 0.1
    patience: int = 50
    seed: int = 42  # nothing is drawn any more; the callers' setting stays valid
    chunk: int = 16  # trees between two passes that write margins and read losses
    ridge: float = 1.0  # added to the curvature of every leaf


CLASSIFY = Boost()
REGRESS = Boost(depth=6, patience=75)


def best_count(losses: list[float], patience: int) -> tuple[int, bool]:
    """Number of trees with the lowest loss up to the point where patience ran out, and whether it did."""
    best = 0
    for n, loss in enumerate(losses):
        if loss < losses[best]:
            best = n
        elif n - best >= patience:
            return best + 1, True
    return best + 1, False


# --------------------------------------------------------------------------- trees


@dataclass(frozen=True)
class Tree:
    """Nodes from the root on: the feature asked (-1 in leaves), values below ``threshold`` go to node ``left``, others
    to the one after it; ``value`` is what a leaf adds, before the step."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    value: list[float]

    def levels(self) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Features and thresholds level by level, the tree filled up to its depth, and the values below; a leaf higher up
        stands for all that is below it."""
        level, layers = [0], []
        while any(self.feature[n] >= 0 for n in level):
            inner = [self.feature[n] >= 0 for n in level]
            asked = np.array([self.feature[n] if i else 0 for n, i in zip(level, inner)])
            wide = np.array([self.threshold[n] if i else np.inf for n, i in zip(level, inner)])
            slim = wide.astype(np.float32)
            layers.append((asked, slim if (slim == wide).all() else wide))
            level = [c for n, i in zip(level, inner) for c in ((self.left[n], self.left[n] + 1) if i else (n, n))]
        return layers, np.array([self.value[n] for n in level])

    def output(self, x: np.ndarray) -> np.ndarray:
        return next(outputs([self.levels()], x))


def outputs(levels: list, x: np.ndarray) -> Iterator[np.ndarray]:
    """Output of every tree, given by its ``levels``, on the rows of ``x``."""
    flat, start = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
    for layers, value in levels:
        node = np.zeros(len(x), np.int64)
        for asked, threshold in layers:
            if len(asked) == 1:
                node += flat.take(start + asked[0]) >= threshold[0]
            else:
                right = flat.take(asked.take(node) + start) >= threshold.take(node)
                node += node
                node += right
        yield value.take(node)


TREE = "no int, feature array<int>, threshold array<double>, left array<int>, value array<double>"


def slopes(kind: str, margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Negative slope and curvature of the loss."""
    if kind == ABSOLUTE:
        return np.sign(y - margin), np.ones(len(y))
    p = 1 / (1 + np.exp(-margin))
    return y - p, p * (1 - p)


def binned(x: np.ndarray, number: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bin of every value, and each feature's distinct inner edges: all values, or quantiles of the rows counted ``number`` times."""
    cells, edges = np.empty(x.shape, np.uint8), []
    for f in range(x.shape[1]):
        found, place = np.unique(x[:, f], return_inverse=True)
        if len(found) > BINS:
            upto = np.cumsum(np.bincount(place, number, len(found)))
            ranks = np.ceil(np.arange(1, BINS) / BINS * (upto[-1] - 1))
            found = np.unique(found[np.searchsorted(upto, ranks, side="right")])
        edges.append(found[found > x[:, f].min()])
        cells[:, f] = np.searchsorted(edges[f], x[:, f], side="right")
    return cells, edges


class Packs:
    """The cells as codes: features that have few combinations of bins share one.

    Sums per node stand in one row per node, the features with equally many bins side by side."""

    def __init__(self, cells: np.ndarray, edges: list[np.ndarray]):
        self.columns = np.ascontiguousarray(cells.T)
        widths = {f: len(inner) + 1 for f, inner in enumerate(edges) if len(inner)}
        # Few rows don't pay for many combinations.
        limit = min(PACKED, max(BINS, len(cells) // 64))
        self.blocks, self.places, self.width = [], {}, 0
        for wide in sorted(set(widths.values())):
            members = [f for f in widths if widths[f] == wide]
            self.blocks.append((wide, self.width, np.array(members)))
            for f in members:
                self.places[f] = self.width
                self.width += wide
        groups: list[list[int]] = []
        for f in sorted(widths, key=lambda f: -widths[f]):
            fits = (p for p in groups if math.prod(widths[q] for q in p) * widths[f] <= limit)
            room = next(fits, None)
            if room is None:
                groups.append([f])
            else:
                room.append(f)
        self.codes = []
        for members in groups:
            code = np.zeros(len(cells), np.uint16)
            for f in members:
                code = code * np.uint16(widths[f]) + self.columns[f]
            self.codes.append((code, members, tuple(widths[f] for f in members)))

    def sums(self, rows: np.ndarray | None, slot: np.ndarray | None, count: int, parts: tuple[np.ndarray, ...]) -> list[np.ndarray]:
        """Sums of ``parts`` per slot, feature and bin, over the given rows or all."""
        out = [np.empty((count, self.width)) for _ in parts]
        picked = parts if rows is None else tuple(p.take(rows) for p in parts)
        for code, members, widths in self.codes:
            size = math.prod(widths)
            place = code if rows is None else code.take(rows) + slot * size
            for sums, part in zip(out, picked):
                joint = np.bincount(place, part, count * size).reshape(count, size)
                for f, own in zip(members, marginals(joint, widths)):
                    sums[:, self.places[f] : self.places[f] + own.shape[1]] = own
        return out


def marginals(joint: np.ndarray, widths: tuple[int, ...]) -> list[np.ndarray]:
    """Sums per row and value of each part of a code, halving the parts, so the whole table is gone through only twice."""
    if len(widths) == 1:
        return [joint]
    half = len(widths) // 2
    both = joint.reshape(len(joint), math.prod(widths[:half]), -1)
    return [*marginals(both.sum(axis=2), widths[:half]), *marginals(both.sum(axis=1), widths[half:])]


def best_splits(packs: Packs, sums: list[np.ndarray], whole_g: np.ndarray, whole_h: np.ndarray, ridge: float, least: float) -> tuple:
    """Of every node the feature (-1: none) and bin of its best split, and the sums of the lower side."""
    nodes = np.arange(len(whole_g))
    best, ask, cut = np.full(len(nodes), 1e-9), np.full(len(nodes), len(packs.columns)), np.zeros(len(nodes), np.int64)
    best_g, best_h = np.zeros(len(nodes)), np.zeros(len(nodes))
    plain = (whole_g**2 / (whole_h + ridge))[:, None, None]
    for wide, start, members in packs.blocks:
        low_g, low_h = (s[:, start : start + wide * len(members)].reshape(len(nodes), -1, wide).cumsum(axis=2)[:, :, :-1] for s in sums)
        high_g, high_h = whole_g[:, None, None] - low_g, whole_h[:, None, None] - low_h
        empty = (low_h <= least) | (high_h <= least)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = low_g**2 / (low_h + ridge) + high_g**2 / (high_h + ridge) - plain
        gain[empty] = -1.0
        gain = gain.reshape(len(nodes), -1)
        # Equal but for rounding: the first bin of the first feature.
        near = SAME * (plain.ravel() + np.maximum(gain.max(axis=1), 0.0))
        k = (gain >= (gain.max(axis=1) - near)[:, None]).argmax(axis=1)
        found, f = gain[nodes, k], members[k // (wide - 1)]
        better = (found > best + near) | ((found > best - near) & (f < ask) & (found > 1e-9))
        for kept_, new in ((best, found), (ask, f), (cut, k % (wide - 1)), (best_g, low_g.reshape(len(nodes), -1)[nodes, k]), (best_h, low_h.reshape(len(nodes), -1)[nodes, k])):
            kept_[better] = new[better]
    ask[ask == len(packs.columns)] = -1
    return ask, cut, best_g, best_h


class Together:
    """All rows in one task, in one order, those of a node side by side."""

    def __init__(self, packs: Packs, g: np.ndarray, h: np.ndarray):
        self.packs, self.parts = packs, (g, h)
        self.order, self.spans = np.arange(len(g)), [(0, len(g))]

    def whole(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Sums of all rows, and of each feature and bin."""
        g, h = self.parts
        return np.array([g.sum()]), np.array([h.sum()]), self.packs.sums(None, None, 1, self.parts)

    def divided(self, nodes: tuple[list[int], ...], parents: list[int], whole_h: np.ndarray, last: bool) -> tuple[list[int], list[np.ndarray]] | None:
        """Divide the rows of the nodes just split. Which child of each is the smaller one, and its sums, unless these are the leaves."""
        (feature, cut, left), order, smaller = nodes, self.order, []
        for n in parents:
            a, b = self.spans[n]
            mine = order[a:b]
            above = self.packs.columns[feature[n]].take(mine) > cut[n]
            high = mine[above]
            middle = b - len(high)
            order[a:middle], order[middle:b] = mine[~above], high
            smaller.append(int(middle - a > b - middle))
            self.spans += [(a, middle), (middle, b)]
        if last:
            return None
        few = [self.spans[left[n] + s] for n, s in zip(parents, smaller)]
        rows = np.concatenate([order[a:b] for a, b in few])
        return smaller, self.packs.sums(rows, np.repeat(np.arange(len(few)), [b - a for a, b in few]), len(few), self.parts)


def split_up(rows: Together | Spread, packs: Packs, edges: list[np.ndarray], depth: int, ridge: float) -> tuple[Tree, list[int]]:
    """Level by level the best split of every node, from sums per node, feature and bin; and the bin each node is cut at."""
    feature, threshold, bins, left, value = [-1], [0.0], [0], [-1], [0.0]
    level = [0]  # nodes that may be split
    whole_g, whole_h, sums = rows.whole()
    least = 1e-9 + 1e-13 * float(whole_h[0])  # what is left of a difference of sums counts as nothing
    value[0] = float(whole_g[0] / (whole_h[0] + ridge))
    for deep in range(depth):
        ask, cut, low_g, low_h = best_splits(packs, sums, whole_g, whole_h, ridge, least)
        split = np.flatnonzero(ask >= 0)
        if not len(split):
            break
        parents, children = [level[k] for k in split.tolist()], []
        for n, k in zip(parents, split.tolist()):
            f = int(ask[k])
            feature[n], threshold[n], bins[n], left[n] = f, float(edges[f][cut[k]]), int(cut[k]), len(feature)
            for child_g, child_h in ((low_g[k], low_h[k]), (whole_g[k] - low_g[k], whole_h[k] - low_h[k])):
                children.append(len(feature))
                feature.append(-1), threshold.append(0.0), bins.append(0), left.append(-1)
                value.append(float(child_g / (child_h + ridge)))
        whole_g, whole_h = (np.stack([low[split], whole[split] - low[split]], axis=1).ravel() for low, whole in ((low_g, whole_g), (low_h, whole_h)))
        level = children
        found = rows.divided((feature, bins, left), parents, whole_h, deep + 1 == depth)
        if found is not None:
            smaller, own = found
            side = 2 * np.arange(len(parents)) + np.array(smaller)
            for n, part in enumerate(own):
                both = np.empty((len(children), packs.width))
                both[side], both[side ^ 1] = part, sums[n][split] - part
                sums[n] = both
    return Tree(feature, threshold, left, value), bins


def one_tree(
    cells: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, ridge: float, packs: Packs | None = None
) -> tuple[Tree, np.ndarray]:
    """The tree on rows that are all here, and each row's output."""
    packs = packs or Packs(cells, edges)
    rows = Together(packs, g, h)
    tree, _ = split_up(rows, packs, edges, depth, ridge)
    out = np.empty(len(g))
    for n, (a, b) in enumerate(rows.spans):
        if tree.feature[n] < 0:
            out[rows.order[a:b]] = tree.value[n]
    return tree, out


def some_trees(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, margin: np.ndarray, kind: str, size: int, boost: Boost, number: np.ndarray | None = None
) -> list[Tree]:
    cells, edges = binned(x, number)
    packs, margin, trees = Packs(cells, edges), margin.copy(), []
    for _ in range(size):
        g, h = slopes(kind, margin, y)
        tree, out = one_tree(cells, edges, weight * g, weight * h, boost.depth, boost.ridge, packs)
        margin += boost.step * out
        trees.append(tree)
    return trees


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of equally long lists as a matrix."""
    if not width:
        return np.zeros((len(column), 0), np.float32)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


# --------------------------------------------------------------------------- large tables


def table_edges(rows: DataFrame, width: int) -> list[np.ndarray]:
    """The edges of ``binned`` for a table (``x``, ``n``): equal values are counted first and ranked by a scan, so no task
    holds all values. The driver gets at most ``BINS`` values per feature."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, number = matrix(batch.column("x"), width), batch.column("n").to_numpy()
            for f in range(width):
                found, place = np.unique(x[:, f], return_inverse=True)
                n = np.bincount(place, number, len(found)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"f": np.full(len(found), f, np.int32), "v": found, "n": n})

    counted = shipped(rows).select("x", "n").mapInArrow(values, "f int, v float, n long").groupBy("f", "v").agg(F.sum("n").alias("n"))
    counts = staged(counted, "bin_values")
    sizes = counts.groupBy("f").agg(
        F.count(F.lit(1)).alias("values"), F.sum("n").alias("total"), F.min("v").alias("least"), F.max(F.isnan("v")).alias("odd")
    )
    # As in ``binned`` a feature with values that are no numbers is not asked.
    sizes = staged(sizes.where(~F.col("odd")), "bin_sizes")
    few = counts.join(F.broadcast(sizes.where(F.col("values") <= BINS)), "f").where(F.col("v") > F.col("least"))
    many = F.broadcast(sizes.where(F.col("values") > BINS))
    upto = prefix_scan(counts.join(many.select("f"), "f", "left_semi"), ["f"], ["v"], {"upto": running_sum(F.col("n"), True)}).join(many, "f")

    def asked(k: Column) -> Column:
        rank = F.ceil(k / F.lit(float(BINS)) * (F.col("total") - 1))
        return (F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto"))

    upto = upto.where(F.exists(F.sequence(F.lit(1), F.lit(BINS - 1)), asked) & (F.col("v") > F.col("least")))
    found: dict[int, list[float]] = {}
    for r in few.select("f", "v").unionByName(upto.select("f", "v")).collect():
        found.setdefault(r["f"], []).append(r["v"])
    return [np.array(sorted(found.get(f, [])), np.float32) for f in range(width)]


def routed(cells: np.ndarray, nodes: tuple[list[int], ...]) -> np.ndarray:
    """Node that every row (a column of ``cells``) ends in."""
    feature, cut, left = (np.array(n) for n in nodes)
    leaf = feature < 0
    # A leaf leads to itself: no bin is above 255.
    asked, cut, left = np.where(leaf, 0, feature) * cells.shape[1], np.where(leaf, 255, cut), np.where(leaf, np.arange(len(leaf)), left)
    flat, row, node = cells.ravel(), np.arange(cells.shape[1]), np.zeros(cells.shape[1], np.int64)
    while not leaf.all() and not leaf.take(node).all():
        node = left.take(node) + (flat.take(asked.take(node) + row) > cut.take(node))
    return node


Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class Spread:
    """Rows (``x``, label, weight, margin) that stay spread over tasks, as blocks: cells (a row per feature), labels, weights, margins.

    A level of a tree is one job: every task finds the nodes of its own rows and sums them, and the sums are added up node by
    node. The next tree starts by adding the last one to the margins. Blocks are kept in memory and on local disk; one that is lost is
    made again from the staged table or what has been written since."""

    def __init__(self, rows: DataFrame, edges: list[np.ndarray], kind: str, step: float, folder: str):
        self.spark, self.edges, self.kind, self.step, self.folder = rows.sparkSession, edges, kind, step, folder
        self.before: RDD | None = None
        self.packs, width = Packs(np.empty((0, len(edges)), np.uint8), edges), len(edges)

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0

            def block() -> pa.RecordBatch:
                table = pa.Table.from_batches(held).combine_chunks()
                x = matrix(table.column("x").combine_chunks(), width)
                cells = np.empty((width, len(x)), np.uint8)
                for f in range(width):
                    cells[f] = np.searchsorted(edges[f], x[:, f], side="right")
                parts = (cells, *(table.column(c).to_numpy() for c in ("label", "weight", "margin")))
                return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], ["cells", "label", "weight", "margin"])

            for batch in batches:
                held, n = [*held, batch], n + batch.num_rows
                if n * width >= BLOCK_CELLS:
                    yield block()
                    held, n = [], 0
            if n:
                yield block()

        def unpacked(r: Row) -> Block:
            numbers = [np.frombuffer(r[c]) for c in ("label", "weight", "margin")]
            return np.frombuffer(r["cells"], np.uint8).reshape(width, len(numbers[0])), *numbers

        written = shipped(rows).select("x", "label", "weight", "margin").mapInArrow(coded, "cells binary, label binary, weight binary, margin binary")
        self.blocks = written.rdd.map(unpacked).persist(StorageLevel.MEMORY_AND_DISK)

    def _sums(self, nodes: tuple[list[int], ...], wanted: list[int]) -> list[np.ndarray]:
        """Sums of the slopes and curvatures of the wanted nodes, by feature and bin, and of all their rows."""
        edges, kind, count, size = self.edges, self.kind, len(wanted), self.packs.width
        slots = np.full(len(nodes[0]), -1)
        slots[wanted] = np.arange(count)

        def part(blocks: Iterator[Block]) -> Iterator[tuple[int, np.ndarray]]:
            total = np.zeros((count, 2 * size + 2))
            for cells, y, weight, margin in blocks:
                g, h = (weight * v for v in slopes(kind, margin, y))
                slot = slots.take(routed(cells, nodes))
                rows = np.flatnonzero(slot >= 0)
                slot = slot.take(rows)
                own = Packs(cells.T, edges).sums(rows, slot, count, (g, h))
                total += np.hstack([*own, *(np.bincount(slot, v.take(rows), count)[:, None] for v in (g, h))])
            return enumerate(total)

        parts = self.blocks.mapPartitions(part)
        if parts.getNumPartitions() > GATHERED:
            # The driver gets one sum per node, not one per node and task.
            parts = parts.reduceByKey(np.add, min(count, parts.getNumPartitions()))
        found = np.zeros((count, 2 * size + 2))
        for slot, sums in parts.collect():
            found[slot] += sums
        return [found[:, :size].copy(), found[:, size : 2 * size].copy(), found[:, -2], found[:, -1]]

    def whole(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        *sums, whole_g, whole_h = self._sums(([-1], [0], [-1]), [0])
        if self.before is not None:
            self.before.unpersist()
            self.before = None
        return whole_g, whole_h, sums

    def divided(self, nodes: tuple[list[int], ...], parents: list[int], whole_h: np.ndarray, last: bool) -> tuple[list[int], list[np.ndarray]] | None:
        """The child of less curvature counts as the smaller one: the numbers of rows are not known here."""
        if last:
            return None
        smaller = [int(low > high) for low, high in whole_h.reshape(-1, 2)]
        return smaller, self._sums(nodes, [nodes[2][n] + s for n, s in zip(parents, smaller)])[:2]

    def trees(self, size: int, depth: int, ridge: float) -> list[Tree]:
        out, path = [], None
        for n in range(1, size + 1):
            tree, cut = split_up(self, self.packs, self.edges, depth, ridge)
            out.append(tree)
            if n < size:
                self._add((tree.feature, cut, tree.left), np.array(tree.value))
                if n % WRITTEN == 0:
                    path = self._write(path)
        self.blocks.unpersist()
        if path is not None:
            remove(self.spark, path)
        return out

    def _add(self, nodes: tuple[list[int], ...], value: np.ndarray) -> None:
        """Add a tree to the margins, when they are next asked for; the blocks before stay until then."""
        step, self.before = self.step, self.blocks
        added = self.before.map(lambda b: (*b[:3], b[3] + step * value.take(routed(b[0], nodes))))
        self.blocks = added.persist(StorageLevel.MEMORY_AND_DISK)

    def _write(self, old: str | None) -> str:
        """Go on from files, so lineage stays short."""
        path = f"{self.folder}/blocks-{uuid.uuid4().hex}"
        self.blocks.saveAsPickleFile(path, 1)
        self.before.unpersist(), self.blocks.unpersist()
        self.blocks, self.before = self.spark.sparkContext.pickleFile(path).persist(StorageLevel.MEMORY_AND_DISK), None
        if old is not None:
            remove(self.spark, old)
        return path


# --------------------------------------------------------------------------- state


@dataclass(frozen=True)
class Grown:
    """A growing ensemble: its trees, the loss of the rows set aside after each of them, and where the margins stand."""

    kind: str
    start: float
    step: float
    width: int
    trees: tuple[Tree, ...]
    losses: tuple[float, ...]
    path: str
    n: int
    held: bool
    edges: tuple[np.ndarray, ...] = ()  # of the bins, once the table has turned out too large for one task

    def spread(self, together: int = 1) -> bool:
        """Whether the rows stay spread; otherwise those of ``together`` ensembles may meet in one task."""
        return self.n * max(1, self.width) > SAMPLE_CELLS // together


def started(rows: DataFrame, label: str, stop: str | None = None, weight: str | None = None, kind: str = LOGISTIC) -> Grown:
    """Stage ``features`` (a vector) and what the loss needs; the first margin is the number that is right on average."""
    spark = rows.sparkSession
    path = scratch_folder(spark, "boosting")
    slim = rows.select(
        vector_to_array("features", "float32").alias("x"), F.col(label).cast("double").alias("label"),
        (F.col(stop) if stop is not None else F.lit(False)).alias("held"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"),
    )
    slim = slim.groupBy("x", "label", "held").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    slim.write.parquet(f"{path}/rows")
    slim = spark.read.parquet(f"{path}/rows")
    fit = ~F.col("held")
    won, total, n, aside, width = slim.agg(
        F.sum(F.when(fit, F.col("weight") * F.col("label"))), F.sum(F.when(fit, F.col("weight"))), F.count_if(fit), F.count_if("held"), F.max(F.size("x"))
    ).first()
    start = float(won / total) if total else 0.0
    if kind == LOGISTIC:
        share = min(max(start, 1e-6), 1 - 1e-6)
        start = math.log(share / (1 - share))
    spread = slim.repartition(max(1, -(-(n + aside) // TASK_ROWS)))
    spread.withColumns({"margin": F.lit(start), "id": F.xxhash64("x", "label")}).write.parquet(f"{path}/margins-0")
    remove(spark, f"{path}/rows")
    return Grown(kind, start, 0.0, width or 0, (), (), path, n, aside > 0)


def chunk_length(done: int, boost: Boost) -> int:
    """Trees between two passes: ``boost.chunk``, and twice as many whenever the trees grown have doubled, from eight chunks on."""
    length = boost.chunk
    while done >= 8 * length:
        length *= 2
    return length


def grow(state: Grown, trees: int, boost: Boost) -> Grown:
    """``trees`` more trees, in chunks that end at multiples of ``chunk_length``; of at least ``UNWATCHED`` times ``boost.chunk``
    where no rows are set aside, so no losses have to be read in between."""
    while trees > 0:
        length = chunk_length(len(state.trees), boost)
        if not state.held:
            length = max(length, boost.chunk * UNWATCHED)
        size = min(trees, length - len(state.trees) % length)
        state, trees = _chunk(state, size, boost), trees - size
    return state


def _chunk(state: Grown, size: int, boost: Boost) -> Grown:
    spark, done = SparkSession.active(), len(state.trees)
    rows = shipped(spark.read.schema(MARGINS).parquet(f"{state.path}/margins-{done}"))
    kind, width, step = state.kind, state.width, boost.step
    fit = rows.where(~F.col("held"))

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=TOGETHER)
        table = table.take(pa.compute.sort_indices(table, [("id", "ascending")])).combine_chunks()
        y, weight, margin, number = (table.column(c).to_numpy() for c in ("label", "weight", "margin", "n"))
        x = matrix(table.column("x").combine_chunks(), width) if len(table) else np.zeros((0, width), np.float32)
        trees = some_trees(x, y, weight, margin, kind, size, boost, number) if len(table) else []
        yield pa.RecordBatch.from_pylist([{"no": n, **asdict(t)} for n, t in enumerate(trees)], schema=PLANTED)

    if state.spread():
        state, trees = _spread_trees(state, fit, size, boost)
    else:
        every = fit.select("id", "x", "label", "weight", "margin", "n").repartition(1)
        found = sorted(every.mapInArrow(plant, TREE).collect(), key=lambda r: r["no"])
        trees = [Tree(*r[1:]) for r in found] or [Tree([-1], [0.0], [-1], [0.0])] * size
    levels = [t.levels() for t in trees]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = batch.column("margin").to_numpy().copy()
            for out in outputs(levels, matrix(batch.column("x"), width)):
                margin += step * out
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(margin))

    def lose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lost, seen = np.zeros(size), 0
        for batch in batches:
            y, number, margin = (batch.column(c).to_numpy() for c in ("label", "n", "margin"))
            lost += losses_after(levels, matrix(batch.column("x"), width), y, number, margin, kind, step)
            seen += int(number.sum())
        yield pa.RecordBatch.from_pydict({"no": np.arange(size, dtype=np.int32), "lost": lost, "n": np.full(size, seen)})

    rows.mapInArrow(add, rows.schema).write.parquet(f"{state.path}/margins-{done + size}")
    losses = ()
    if state.held:
        aside = rows.where("held")
        lost = aside.mapInArrow(lose, "no int, lost double, n long").groupBy("no").agg((F.sum("lost") / F.sum("n")).alias("loss")).collect()
        losses = tuple(r["loss"] for r in sorted(lost, key=lambda r: r["no"]))
    remove(spark, f"{state.path}/margins-{done}")
    return replace(state, step=step, trees=(*state.trees, *trees), losses=(*state.losses, *losses))


def _spread_trees(state: Grown, rows: DataFrame, size: int, boost: Boost) -> tuple[Grown, list[Tree]]:
    """``size`` trees on all ``rows``, which stay spread. Their bins, which no chunk changes, are cut once."""
    if not state.edges:
        state = replace(state, edges=tuple(table_edges(rows, state.width)))
    return state, Spread(rows, list(state.edges), state.kind, boost.step, state.path).trees(size, boost.depth, boost.ridge)


def losses_after(levels: list, x: np.ndarray, y: np.ndarray, number: np.ndarray, margin: np.ndarray, kind: str, step: float) -> np.ndarray:
    """Sum of the rows' losses, each as often as its ``number``, after each of the trees."""
    margin, lost = margin.copy(), []
    for out in outputs(levels, x):
        margin += step * out
        lost.append(float(loss(kind, margin, y) @ number))
    return np.array(lost)


MARGINS = "x array<float>, label double, held boolean, weight double, n long, margin double, id long"
FOLD_MARGINS = "x array<float>, label double, held array<boolean>, weights array<double>, n long, margins array<double>, id long"
TOGETHER = pa.schema([("id", pa.int64()), ("x", pa.list_(pa.float32())), ("label", pa.float64()), ("weight", pa.float64()), ("margin", pa.float64()), ("n", pa.int64())])
PLANTED = pa.schema(
    [("no", pa.int32()), ("feature", pa.list_(pa.int32())), ("threshold", pa.list_(pa.float64())), ("left", pa.list_(pa.int32())), ("value", pa.list_(pa.float64()))]
)
FOLD_PLANTED = pa.schema([("fold", pa.int32()), *PLANTED])


def loss(kind: str, margin: np.ndarray, y: np.ndarray) -> np.ndarray:
    if kind == ABSOLUTE:
        return np.abs(y - margin)
    # log(1 + exp(margin)) - label * margin, without overflow.
    return np.maximum(margin, 0.0) + np.log1p(np.exp(-np.abs(margin))) - y * margin


def boosted(
    rows: DataFrame, label: str, stop: str | None, boost: Boost, weight: str | None = None, kind: str = LOGISTIC, trees: int | None = None
) -> Grown:
    """Grow until patience runs out or all trees are there, and keep the best number. ``trees`` fixes their number."""
    state = started(rows, label, stop, weight, kind)
    if trees is not None or not state.held:
        state = grow(state, trees or boost.max_iter, boost)
    else:
        while len(state.trees) < boost.max_iter and not best_count(list(state.losses), boost.patience)[1]:
            state = grow(state, min(chunk_length(len(state.trees), boost), boost.max_iter - len(state.trees)), boost)
        state = kept(state, best_count(list(state.losses), boost.patience)[0])
    remove(rows.sparkSession, state.path)
    return state


def boosted_folds(
    rows: DataFrame, label: str, weights: list[Column], held: list[Column], boost: Boost, kind: str = LOGISTIC
) -> list[Grown]:
    """One ensemble per fold, all grown together: ``weights`` say what a row counts in training in each fold (0 or null:
    not at all), ``held`` whether it is set aside there.

    The staged table has one row per row with an array of margins, one entry per fold. A chunk reads it once to give
    the rows of all folds to the tasks that grow them side by side (a fold too large for that is grown on rows that stay
    spread, one fold after the other), and once to add the trees of all folds; one aggregate reads the losses of all folds
    and tree counts. A fold whose patience has run out takes no further part."""
    spark, path, folds = rows.sparkSession, scratch_folder(rows.sparkSession, "boosting"), len(weights)
    slim = rows.select(
        vector_to_array("features", "float32").alias("x"), F.col(label).cast("double").alias("label"),
        F.array(*[F.coalesce(w.cast("double"), F.lit(0.0)) for w in weights]).alias("weights"), F.array(*[F.coalesce(h, F.lit(False)) for h in held]).alias("held"),
    )
    sums = F.array(*[F.sum(F.col("weights")[f]) for f in range(folds)])
    slim = slim.groupBy("x", "label", "held").agg(sums.alias("weights"), F.count(F.lit(1)).alias("n"))
    slim.write.parquet(f"{path}/rows")
    slim = spark.read.parquet(f"{path}/rows")
    cells = [F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width")]
    for f in range(folds):
        w = F.col("weights")[f]
        cells += [F.sum(w * F.col("label")).alias(f"won{f}"), F.sum(w).alias(f"total{f}"), F.count_if(w > 0).alias(f"fit{f}"), F.count_if(F.col("held")[f]).alias(f"held{f}")]
    found = slim.agg(*cells).first()
    states = []
    for f in range(folds):
        start = float(found[f"won{f}"] / found[f"total{f}"]) if found[f"total{f}"] else 0.0
        if kind == LOGISTIC:
            share = min(max(start, 1e-6), 1 - 1e-6)
            start = math.log(share / (1 - share))
        states.append(Grown(kind, start, boost.step, found["width"] or 0, (), (), path, found[f"fit{f}"], found[f"held{f}"] > 0))
    spread = slim.repartition(max(1, -(-found["n"] // TASK_ROWS)))
    starts = F.array(*[F.lit(s.start) for s in states])
    spread.withColumns({"margins": starts, "id": F.xxhash64("x", "label")}).write.parquet(f"{path}/margins-0")
    remove(spark, f"{path}/rows")
    done, active = 0, list(range(folds))
    while active and done < boost.max_iter:
        size = min(chunk_length(done, boost), boost.max_iter - done)
        states = _fold_chunk(states, active, done, size, boost)
        done += size
        active = [f for f in active if not (states[f].held and best_count(list(states[f].losses), boost.patience)[1])]
    remove(spark, path)
    return [kept(s, best_count(list(s.losses), boost.patience)[0]) if s.held else s for s in states]


def _fold_chunk(states: list[Grown], active: list[int], done: int, size: int, boost: Boost) -> list[Grown]:
    spark, path = SparkSession.active(), states[0].path
    kind, width, step = states[0].kind, states[0].width, boost.step
    rows = shipped(spark.read.schema(FOLD_MARGINS).parquet(f"{path}/margins-{done}"))
    out, grown, draws = list(states), {f: [Tree([-1], [0.0], [-1], [0.0])] * size for f in active}, []
    for f in active:
        fits, own = F.col("weights")[f] > 0, [F.col("weights")[f].alias("weight"), F.col("margins")[f].alias("margin")]
        if states[f].spread(len(active)):
            out[f], grown[f] = _spread_trees(states[f], rows.where(fits).select("x", "label", *own, "n"), size, boost)
        else:
            draws.append(F.when(fits, F.struct(F.lit(f).alias("fold"), *own)))

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        for f in pa.compute.unique(table.column("fold")).to_pylist():
            mine = table.filter(pa.compute.equal(table.column("fold"), f))
            mine = mine.take(pa.compute.sort_indices(mine, [("id", "ascending")])).combine_chunks()
            y, weight, margin, number = (mine.column(c).to_numpy() for c in ("label", "weight", "margin", "n"))
            trees = some_trees(matrix(mine.column("x").combine_chunks(), width), y, weight, margin, kind, size, boost, number)
            yield pa.RecordBatch.from_pylist([{"fold": f, "no": n, **asdict(t)} for n, t in enumerate(trees)], schema=FOLD_PLANTED)

    if draws:
        every = rows.withColumn("d", F.explode(F.array_compact(F.array(*draws)))).select("d.fold", "id", "x", "label", "d.weight", "d.margin", "n")
        for r in every.repartition(len(draws), "fold").mapInArrow(plant, "fold int, " + TREE).collect():
            grown[r["fold"]] = [*grown[r["fold"]]]
            grown[r["fold"]][r["no"]] = Tree(*r[2:])

    levels = {f: [t.levels() for t in grown[f]] for f in active}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, margins = matrix(batch.column("x"), width), matrix(batch.column("margins"), len(states)).copy()
            for f in active:
                for out in outputs(levels[f], x):
                    margins[:, f] += step * out
            column = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(states), margins.ravel())
            yield batch.set_column(batch.schema.get_field_index("margins"), "margins", column)

    def lose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lost, seen = {f: np.zeros(size) for f in active}, dict.fromkeys(active, 0)
        for batch in batches:
            x, margins, aside = (matrix(batch.column(c), w) for c, w in (("x", width), ("margins", len(states)), ("held", len(states))))
            y, number = (batch.column(c).to_numpy() for c in ("label", "n"))
            for f in active:
                mine = np.flatnonzero(aside[:, f])
                lost[f] += losses_after(levels[f], x[mine], y[mine], number[mine], margins[mine, f], kind, step)
                seen[f] += int(number[mine].sum())
        for f in active:
            yield pa.RecordBatch.from_pydict({"fold": np.full(size, f, np.int32), "no": np.arange(size, dtype=np.int32), "lost": lost[f], "n": np.full(size, seen[f])})

    rows.mapInArrow(add, rows.schema).write.parquet(f"{path}/margins-{done + size}")
    lost: dict[int, list[float]] = {f: [0.0] * size for f in active}
    watched = [f for f in active if states[f].held]
    if watched:
        aside = rows.where(F.exists("held", lambda h: h))
        means = aside.mapInArrow(lose, "fold int, no int, lost double, n long").groupBy("fold", "no").agg(F.sum("lost").alias("lost"), F.sum("n").alias("n"))
        for r in means.collect():
            lost[r["fold"]][r["no"]] = r["lost"] / max(r["n"], 1)
    remove(spark, f"{path}/margins-{done}")
    for f in active:
        seen = tuple(lost[f]) if f in watched else ()
        out[f] = replace(out[f], trees=(*states[f].trees, *grown[f]), losses=(*states[f].losses, *seen))
    return out


def kept(state: Grown, count: int) -> Grown:
    """The first ``count`` trees."""
    return replace(state, trees=state.trees[:count], losses=state.losses[:count])


# --------------------------------------------------------------------------- model


@dataclass
class BoostedModel:
    """Stages that make the feature vector, and the trees on it."""

    coder: PipelineModel | None
    kind: str
    start: float
    step: float
    trees: list[Tree]

    def transform(self, df: DataFrame, out: str) -> DataFrame:
        """Add ``out``: a probability for the log loss, else the value itself."""
        coded = df if self.coder is None else self.coder.transform(df)
        used = sorted({f for t in self.trees for f in t.feature if f >= 0})
        place = {f: n for n, f in enumerate(used)}
        # Only the features that some tree asks for go to the function.
        slim = [replace(t, feature=[place.get(f, -1) for f in t.feature]) for t in self.trees]
        start, step, kind, width = self.start, self.step, self.kind, len(used)
        levels = [t.levels() for t in slim]

        def values(x: np.ndarray) -> np.ndarray:
            total = np.full(len(x), start)
            for out in outputs(levels, x):
                total += step * out
            return 1 / (1 + np.exp(-total)) if kind == LOGISTIC else total

        @F.arrow_udf("double")
        def value(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            # Rows with the same features go through the trees once.
            known: dict[bytes, float] = {}
            for batch in batches:
                x = np.ascontiguousarray(matrix(batch, width))
                if not width:
                    yield pa.array(values(x))
                    continue
                keys = x.view(np.dtype((np.void, x.itemsize * width))).ravel().tolist()
                if len(known) > KNOWN:
                    known.clear()
                new = {k: n for n, k in enumerate(keys) if k not in known}
                known |= zip(new, values(x[list(new.values())]).tolist())
                yield pa.array([known[k] for k in keys], pa.float64())

        every = vector_to_array("features", "float32")
        wanted = F.array(*[every[f] for f in used]) if used else F.array().cast("array<float>")
        return shipped(coded).withColumn(out, value(wanted))

    def write(self, path: str) -> None:
        spark = SparkSession.active()
        if self.coder is not None:
            self.coder.write().overwrite().save(f"{path}/coder")
        rows = [(n, t.feature, t.threshold, t.left, t.value) for n, t in enumerate(self.trees)]
        spark.createDataFrame(rows, TREE).coalesce(1).write.mode("overwrite").parquet(f"{path}/ensemble")
        save_spec(spark, {"kind": self.kind, "start": self.start, "step": self.step, "coder": self.coder is not None}, f"{path}/spec")

    @staticmethod
    def read(spark: SparkSession, path: str) -> BoostedModel:
        spec = load_spec(spark, f"{path}/spec")
        rows = sorted(spark.read.parquet(f"{path}/ensemble").collect(), key=lambda r: r["no"])
        coder = PipelineModel.load(f"{path}/coder") if spec["coder"] else None
        return BoostedModel(coder, spec["kind"], spec["start"], spec["step"], [Tree(*r[1:]) for r in rows])


def model_of(state: Grown, coder: PipelineModel | None = None) -> BoostedModel:
    return BoostedModel(coder, state.kind, state.start, state.step, list(state.trees))
