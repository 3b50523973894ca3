"""Nearest neighbours by vantage-point trees, one per shard.

Rows are dealt to shards by a hash of their id, so no shard depends on how vectors cluster. A task builds a shard's
tree: a node holds a vantage point and the distances of its rows to it, cut at the median; leaves hold up to
``LEAF`` rows. A search keeps each query's k-th best distance ``tau`` so far and skips the side of a node whose
lower bound, by the triangle inequality, times ``factor`` exceeds ``tau``. Factor 1 only skips what cannot hold a
neighbour, so it is exact; a larger factor skips more. Queries go through a tree in blocks, each node handling the
block's remaining queries at once. Per shard and query block the k best come back, and the k best of all shards
are the answer.

Trees are built once and stored with their vectors as one row per shard (at most ``SHARD_ROWS`` rows on average). A task gets
one tree and after it the query blocks to search in it, so it holds one tree and one block; with few shards a tree goes
to several tasks, which share the blocks. Distances come from the original vectors in
double precision, summed component by component.

Vectors that are null, all zero, of another length than most (the smaller of equally common lengths counts) or with
a null or non-finite component take no part, neither do rows without an id. Rows sharing an id are candidates each,
except for queries of that id; a repeated query id is searched once, with its smallest vector. Ties go to the
smaller id. With fewer than k candidates all are returned; an empty table gives no rows.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import shipped
from tidemark.sources.scratch import staged

LEAF = 256
SHARD_ROWS, BLOCK_QUERIES = 8192, 256
RESULT = "query_id long, vec_id long, score double"
# Room for rounding when a bound is compared with a distance.
SLACK = 1e-9
EPS = np.finfo(np.float64).eps


def distances(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row to a point, components added in order."""
    total = np.zeros(len(rows))
    for d in range(rows.shape[1]):
        step = rows[:, d] - point[d]
        total += step * step
    return np.sqrt(total)


def quick(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances of all rows to all points (rows x points), for preselection; ``blur`` bounds the error of their squares."""
    square = (rows * rows).sum(1)[:, None] + (points * points).sum(1)[None, :] - 2 * rows @ points.T
    return np.sqrt(np.maximum(square, 0))


def blur(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Per point, room for the rounding of ``quick`` in squared distances: three sums of as many terms as there are
    dimensions, none above |x|^2 + |q|^2 in total, which cancel when the distance is small."""
    return 4 * EPS * (rows.shape[1] + 4) * ((rows * rows).sum(1).max() + (points * points).sum(1))


class Tree:
    """Rows are reordered so that every node owns a range; ``nodes`` lists (low, high, vantage row, median,
    largest inner, smallest outer, largest outer, inner child, outer child), leaves without children."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, seed: int = 1):
        self.ids, self.rows, self.nodes = ids, rows, []
        rng, order = np.random.default_rng(seed), np.arange(len(ids))
        todo = [(0, len(ids), None, None)]
        while todo:
            low, high, parent, side = todo.pop()
            me = len(self.nodes)
            if parent is not None:
                self.nodes[parent][side] = me
            if high - low <= LEAF:
                self.nodes.append([low, high, -1, 0.0, 0.0, 0.0, 0.0, -1, -1])
                continue
            pick = low + int(rng.integers(high - low))
            order[[low, pick]] = order[[pick, low]]
            rest = order[low + 1 : high]
            far = distances(rows[rest], rows[order[low]])
            sort = np.argsort(far, kind="stable")
            order[low + 1 : high], far = rest[sort], far[sort]
            half = len(far) // 2
            self.nodes.append([low, high, low, float(far[half]), float(far[half - 1]), float(far[half]), float(far[-1]), -1, -1])
            todo += [(low + 1, low + 1 + half, me, 7), (low + 1 + half, high, me, 8)]
        self.ids, self.rows = ids[order], rows[order]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query the candidates kept: at least the k nearest (with ties) when factor is 1."""
        found = [[] for _ in query_ids]
        best = np.full((len(query_ids), k), np.inf)
        room = blur(self.rows, queries) if len(self.ids) else np.zeros(len(query_ids))

        def limit(who: np.ndarray) -> np.ndarray:
            """The k-th best distance so far, with room for its own rounding and that of what it is compared with."""
            tau = best[who].max(axis=1)
            return np.sqrt(tau * tau + 2 * room[who]) * (1 + SLACK) + SLACK

        def offer(low: int, high: int, who: np.ndarray, far: np.ndarray) -> None:
            """Rows low to high with distances far (rows x who)."""
            own = self.ids[low:high, None] == query_ids[who][None, :]
            far = np.where(own, np.inf, far)
            merged = np.concatenate([best[who], far.T], axis=1)
            best[who] = np.partition(merged, k - 1, axis=1)[:, :k]
            near = (far.T <= limit(who)[:, None]) & np.isfinite(far.T)
            for n in np.flatnonzero(near.any(axis=1)):
                found[who[n]].append(low + np.flatnonzero(near[n]))

        todo = [(0, np.arange(len(query_ids)), np.zeros(len(query_ids)))] if len(self.ids) else []
        while todo:
            node, who, bound = todo.pop()
            alive = bound * factor <= limit(who)
            who, bound = who[alive], bound[alive]
            if not len(who):
                continue
            low, high, vantage, median, inner_most, outer_least, outer_most, inner, outer = self.nodes[node]
            if inner < 0:
                offer(low, high, who, quick(self.rows[low:high], queries[who]))
                continue
            # From differences, so that the rounding of ``quick`` does not enter the triangle inequality.
            d = np.sqrt(np.square(queries[who] - self.rows[vantage]).sum(1))
            offer(vantage, vantage + 1, who, d[None, :])
            to_inner = np.maximum(bound, d - inner_most)
            to_outer = np.maximum(bound, np.maximum(outer_least - d, d - outer_most))
            closer = d < median
            # The side a query lies on goes first (last on the stack).
            todo += [(outer, who[closer], to_outer[closer]), (inner, who[~closer], to_inner[~closer])]
            todo += [(inner, who[closer], to_inner[closer]), (outer, who[~closer], to_outer[~closer])]
        out = []
        for n, parts in enumerate(found):
            at = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
            exact = distances(self.rows[at], queries[n])
            order = np.lexsort((self.ids[at], exact))[:k]
            out.append((self.ids[at][order], exact[order]))
        return out


def clean(vectors: DataFrame, vec_id: str, vec: str) -> DataFrame:
    """Columns id, v: the rows that take part."""
    v = F.col(f"`{vec}`").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), v.alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(F.forall("v", lambda x: x.isNotNull())).where(fine)
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common["n"] if common else 0))


def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per shard: its tree. Rows come sorted by shard, so one shard is held at a time."""
    current, parts = None, []

    def tree() -> pa.RecordBatch:
        ids, rows = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((*rows.T[::-1], ids))  # the same tree whatever order the rows came in
        made = pickle.dumps(Tree(ids[order], rows[order]), protocol=5)
        return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([made], pa.binary())], names=["shard", "tree"])

    for batch in batches:
        shard = batch.column("shard").to_numpy()
        ids = batch.column("id").to_numpy()
        rows = np.array(batch.column("v").flatten().to_numpy(), np.float64).reshape(len(ids), -1)
        for s in np.unique(shard).tolist():
            if s != current:
                if parts:
                    yield tree()
                current, parts = s, []
            parts.append((ids[shard == s], rows[shard == s]))
    if parts:
        yield tree()


def look_up(k: int, factor: float):
    """Rows come by place: a shard's tree, then the query blocks that are searched in it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            for n in range(batch.num_rows):
                if batch.column("tree")[n].is_valid:
                    tree = pickle.loads(batch.column("tree")[n].as_py())
                    continue
                ids = np.array(batch.column("ids")[n].as_py(), np.int64)
                rows = np.array(batch.column("flat")[n].as_py(), np.float64).reshape(len(ids), -1)
                found = tree.search(ids, rows, k, factor)
                names = np.concatenate([x for x, _ in found])
                column = [np.repeat(ids, [len(x) for x, _ in found]), names, np.concatenate([y for _, y in found])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in column], names=["query_id", "vec_id", "score"])

    return run


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0, vec_id: str = "vec_id", vec: str = "embedding", shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` its k nearest rows of ``vectors`` with another id."""
    rows = staged(clean(shipped(vectors), vec_id, vec), "vectors")
    total = rows.count()
    shards = max(1, -(-total // shard_rows))
    asked = clean(queries, vec_id, vec)
    if total:  # a query of another length has no distance to the rows
        asked = asked.where(F.size("v") == rows.select(F.size("v")).first()[0])
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).repartition(shards, "shard").sortWithinPartitions("shard")
    trees = staged(dealt.mapInArrow(grow, "shard int, tree binary"), "trees")
    packed = (
        asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        .groupBy("block")
        .agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("rows"))
        .select("block", F.col("rows.id").alias("ids"), F.flatten("rows.v").alias("flat"))
    )
    # Every query block meets every shard once: the stated query set against all rows. Where there are fewer shards than
    # tasks could run, a shard's tree is searched in several places, each for its part of the blocks.
    places = min(blocks, max(1, -(-2 * rows.sparkSession.sparkContext.defaultParallelism // shards)))
    empty = {"tree": F.lit(None).cast("binary"), "ids": F.lit(None).cast("array<bigint>"), "flat": F.lit(None).cast("array<double>"), "block": F.lit(-1)}
    order = ["place", "block", "tree", "ids", "flat"]
    homes = trees.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(places - 1)))).withColumns({c: empty[c] for c in ("ids", "flat", "block")})
    calls = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumns({"part": F.col("block") % places, "tree": empty["tree"]})
    # Shards without rows have no tree, so no place either.
    calls = calls.join(trees.select("shard"), "shard", "left_semi")
    both = homes.unionByName(calls).withColumn("place", F.col("shard") * places + F.col("part")).select(order)
    # Dealt by number, not by hash: every place is a task of its own up to 10,000.
    ranged = both.repartitionByRange(min(shards * places, 10_000), "place").sortWithinPartitions("place", "block")
    found = ranged.mapInArrow(look_up(k, factor), RESULT)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
