"""Near-duplicate join: documents whose sets of word n-grams have a Jaccard similarity of ``SIMILARITY`` or more.

1. One pass over the whole texts gives each row its set of hashed five-word grams: a digest of the set, its size, 32
   band hashes of 7 MinHash values each, and a sketch of the lowest byte of all 224 values. Rows with equal sets
   are copies; one of them, the one with the smallest id, stands for them from here on.
2. Rows are shuffled on band hashes. In each bucket a member picked at random (by hash, per bucket) is the hub, and
   members whose sketch agrees with it in ``AGREE`` of the bytes are tied to it. The others compare their sketches with
   each other, in pairs of blocks, and are tied to a root each. So no pair is written out and no member is lost.
3. Ties connect to clusters (alternating stars). Within a cluster all pairs are verified on the full sets, in blocks:
   members are dealt to blocks by hash, every two blocks meet in one task group, which counts links and keeps a
   spanning set of them. No pair is written out, and a large cluster is spread over many groups.
4. Links connect to classes. A row's class id is the smallest doc id of its class; ``n_links`` counts the other rows
   that are similar to it, copies included.

Band and row counts: two texts of similarity s share a band with probability 1 - (1 - s^7)^32, which is 0.9995 at 0.8.
Pairs of one cluster are all verified, whether they share a band or not.

Words are runs of letters, digits and underscores in lower case. A text of one to four words has one gram, the
whole; signs without a word count as one word; an empty text (or null) has no link and is its own class. Rows without a doc id take no part: class id null, no
links. Repeated rows are copies. Other columns are not read. A very long text is one set like any other; an empty table gives
no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ragged, shipped, slices, texts_of
from tidemark.llm.components import components
from tidemark.sources.scratch import staged

N, SIMILARITY = 5, (4, 5)  # 4/5 as whole numbers, so that the limit itself is met exactly
BANDS, ROWS, AGREE = 32, 7, 0.6
# Grams and members of a block.
BLOCK_GRAMS, BLOCK_MEMBERS = 200_000, 256
# Width of the slices in which gram columns are compared.
COLUMNS = 4096
WORDS = re.compile(r"\w+")

_seeds = np.random.Generator(np.random.PCG64(2024))
FACTORS, SHIFTS = (_seeds.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1) for _ in range(2))
PLACES = _seeds.integers(1, 2**63, max(N, ROWS), dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct gram hashes of each text."""
    code: dict[str, int] = {}
    # Without any word, what is left between the spaces at both ends stands for one.
    split = [WORDS.findall(t.lower()) or list(filter(None, [t.strip()])) for t in texts]
    coded = [np.array([code.setdefault(w, len(code)) for w in words], np.int64) for words in split]
    hashes = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in code], np.uint64)
    out = []
    for words in coded:
        h = hashes[words] if len(words) else np.zeros(0, np.uint64)
        if 0 < len(h) < N:
            grams = mixed((h * PLACES[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
        else:
            grams = np.zeros(max(0, len(h) - N + 1), np.uint64)
            for n in range(N):
                grams += h[n : n + len(grams)] * PLACES[n]
            grams = np.unique(mixed(grams))
        out.append(grams)
    return out


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """One row of MinHash values per (non-empty) set."""
    flat, starts = ragged(sets, np.uint64)
    out = np.empty((len(sets), BANDS * ROWS), np.uint64)
    for n, (a, b) in enumerate(zip(FACTORS, SHIFTS)):
        out[:, n] = np.minimum.reduceat(flat * a + b, starts[:-1])
    return out


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, size=1_000_000):
        sets = gram_sets(texts_of(batch))
        full = [n for n, s in enumerate(sets) if len(s)]
        keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        bands, bytes_ = [None] * len(sets), [None] * len(sets)
        if full:
            values = min_hashes([sets[n] for n in full])
            joined = mixed((values.reshape(-1, BANDS, ROWS) * PLACES[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
            low = mixed(values).astype(np.uint8)
            for row, n in enumerate(full):
                bands[n], bytes_[n] = joined[row].view(np.int64), low[row].tobytes()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("digest"),
                pa.array(keys, pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(bands, pa.list_(pa.int64())),
                pa.array(bytes_, pa.binary()),
            ],
            names=["doc_id", "digest", "node", "n", "bands", "sketch"],
        )


SKETCHES = "doc_id long, digest long, node binary, n long, bands array<long>, sketch binary"


def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties whose two sketches agree."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("x", "y"))
            fine = (x == y).mean(axis=1) >= AGREE
            yield batch.filter(pa.array(fine)).select(["node", "hub"])


def ties(members: DataFrame) -> DataFrame:
    """node, hub: a star around each bucket's hub, and roots among the members that differ from it."""
    sketches = members.select("node", "sketch")
    buckets = members.select("node", F.explode("bands").alias("bucket"))
    hubs = buckets.groupBy("bucket").agg(F.min_by("node", F.xxhash64("node", "bucket")).alias("hub"), F.count("*").alias("size"))
    rows = staged(buckets.join(staged(hubs.where("size > 1").drop("size"), "hubs"), "bucket").where(F.col("node") != F.col("hub")), "buckets")
    pairs = rows.select("node", "hub").distinct()
    pairs = pairs.join(sketches.withColumnRenamed("sketch", "x"), "node").join(sketches.select(F.col("node").alias("hub"), F.col("sketch").alias("y")), "hub")
    tied = staged(pairs.select("node", "hub", "x", "y").mapInArrow(agreeing, "node binary, hub binary"), "ties")
    left = staged(rows.join(tied, ["node", "hub"], "left_anti").select("node", "bucket"), "untied")
    blocks = left.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("blocks"), F.count("*").alias("size"))
    rest = left.join(staged(blocks.where("size > 1").drop("size"), "blocks"), "bucket").join(sketches, "node")
    rest = in_block_pairs(rest, "bucket", ["node", "sketch"])
    return tied.unionByName(rest.mapInArrow(untied, "node binary, hub binary"))


def in_block_pairs(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Rows of each group dealt to ``blocks`` blocks, one copy per pair of blocks (i <= j), the copies of a pair
    together and in order; ``side`` is 1 for the rows of block j."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    rows = rows.select(F.col(group).alias("key"), i.alias("i"), j.alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"), *columns)
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")


def groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[bool, list[tuple]]]:
    """Of rows sorted by pair of blocks: whether both blocks are one, and the values of the pair's rows."""
    key, held = None, []
    for batch in batches:
        for root, i, j, *rest in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", *columns))):
            if (root, i, j) != key:
                if len(held) > 1:
                    yield key[1] == key[2], held
                key, held = (root, i, j), []
            held.append(rest)
    if len(held) > 1:
        yield key[1] == key[2], held


def local_roots(near: np.ndarray) -> np.ndarray:
    """Smallest member of each one's component under a symmetric relation."""
    root = np.arange(len(near))
    while True:
        new = np.array([min(root[i], root[row].min()) if row.any() else root[i] for i, row in enumerate(near)])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def untied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of two blocks of one bucket, each with a root among those it agrees with."""
    nodes, hubs = [], []
    for _, held in groups(batches, ["node", "sketch"]):
        table = np.frombuffer(b"".join(x[1] for x in held), np.uint8).reshape(len(held), -1)
        near = np.stack([(table == row).mean(axis=1) >= AGREE for row in table])
        root = local_roots(near)
        for n in np.flatnonzero(root != np.arange(len(root))):
            nodes.append(held[n][0])
            hubs.append(held[root[n]][0])
        if len(nodes) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(hubs, pa.binary())], names=["node", "hub"])
            nodes, hubs = [], []
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(hubs, pa.binary())], names=["node", "hub"])


def linked(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Which sets are similar: all against all, or, with 0 < split < len, those before it against those from it."""
    flat, starts = ragged(sets, np.uint64)
    grams, column = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(sets)), np.diff(starts))
    a, b = (slice(0, split), slice(split, None)) if 0 < split < len(sets) else (slice(None), slice(None))
    shared = np.zeros((len(sets[a]), len(sets[b])), np.int64)
    # Grams of one set only meet nothing.
    common = np.bincount(column, minlength=len(grams)) > 1
    place = np.cumsum(common) - 1
    keep = common[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, int(common.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [low, low + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[lo:hi], column[lo:hi] - low] = 1
        shared += (part[a] @ part[b].T).astype(np.int64)
    sizes = np.diff(starts)
    union = sizes[a][:, None] + sizes[b][None, :] - shared
    return SIMILARITY[1] * shared >= SIMILARITY[0] * union


def verify_group(nodes: list[bytes], sides: np.ndarray, copies: np.ndarray, texts: list[str], same: bool) -> pa.RecordBatch | None:
    """Links of one pair of blocks: per linked node the number of rows it is linked to and a root of its links."""
    order = np.argsort(sides, kind="stable")
    nodes, copies = [nodes[i] for i in order], copies[order]
    split = int((sides == 0).sum())
    if not same and split in (0, len(nodes)):
        return None
    near = linked(gram_sets([texts[i] for i in order]), 0 if same else split)
    full = np.zeros((len(nodes), len(nodes)), bool)
    if same:
        full |= near
        np.fill_diagonal(full, False)
    else:
        full[:split, split:] = near
        full[split:, :split] = near.T
    hit, root = np.flatnonzero(full.any(axis=1)), local_roots(full)
    if not len(hit):
        return None
    counts = full.astype(np.int64) @ copies
    return pa.RecordBatch.from_arrays(
        [pa.array([nodes[i] for i in hit], pa.binary()), pa.array([nodes[root[i]] for i in hit], pa.binary()), pa.array(counts[hit], pa.int64())], names=["a", "b", "n_links"]
    )


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for same, held in groups(batches, ["node", "side", "copies", "text"]):
        nodes, sides, copies, texts = zip(*held)
        out = verify_group(list(nodes), np.array(sides), np.array(copies, np.int64), list(texts), same)
        if out is not None:
            yield out


def verified(members: DataFrame, clusters: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b, n_links: per node and pair of blocks its root there and the rows linked to it."""
    sizes = clusters.join(members.select(F.col("node"), "n"), "node").groupBy("root").agg(F.sum("n").alias("grams"), F.count("*").alias("nodes"))
    blocks = sizes.select("root", F.greatest(F.ceil(F.col("grams") / BLOCK_GRAMS), F.ceil(F.col("nodes") / BLOCK_MEMBERS), F.lit(1)).cast("int").alias("blocks"))
    rows = members.select("node", "doc_id", "digest", "copies").join(clusters, "node").join(staged(blocks, "blocks"), "root")
    texts = docs.select("doc_id", F.xxhash64("text").alias("digest"), "text")
    rows = texts.join(rows, ["doc_id", "digest"]).dropDuplicates(["node"])
    return in_block_pairs(rows, "root", ["node", "copies", "text"]).mapInArrow(verify, "a binary, b binary, n_links long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links, n_copies (rows with the same set, itself included) and the text's digest, per row."""
    docs = shipped(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = staged(docs.select("doc_id", "text", F.xxhash64("text").alias("digest")).mapInArrow(sketch, SKETCHES), "sketches")
    rows = every.where(F.col("doc_id").isNotNull() & F.col("node").isNotNull())
    first = F.min(F.struct("doc_id", "digest"))
    members = rows.groupBy("node").agg(first.alias("f"), F.count("*").alias("copies"), F.min("n").alias("n"))
    where = rows.select("doc_id", "digest", "node", "bands", "sketch").dropDuplicates(["doc_id", "digest", "node"])
    members = members.select("node", "f.doc_id", "f.digest", "copies", "n").join(where, ["doc_id", "digest", "node"])
    members = staged(members, "members")
    clusters = staged(components(ties(members).toDF("a", "b")), "clusters")
    links = staged(verified(members, clusters, docs), "verified")
    classes = components(links.select("a", "b"))
    named = classes.join(members.select("node", "doc_id"), "node")
    least = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    named = named.join(staged(least, "classes"), "root").select("node", "class_id")
    counts = links.groupBy(F.col("a").alias("node")).agg(F.sum("n_links").alias("others"))
    known = members.select("node", "copies", F.col("doc_id").alias("own")).join(named, "node", "left").join(counts, "node", "left")
    known = staged(known.select("node", "copies", F.coalesce("class_id", "own").alias("class_id"), F.coalesce("others", F.lit(0)).alias("others")), "known")
    part = F.col("doc_id").isNotNull()
    joined = every.select("doc_id", "digest", F.when(part, F.col("node")).alias("node")).join(known, "node", "left")
    return joined.select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce(F.col("others") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
        "digest",
    )
