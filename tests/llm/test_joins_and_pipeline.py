"""Vantage-point trees, the near-duplicate join and the pipeline against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import helpers
from tests.llm.test_text_operators import check_pieces
from tidemark.llm import ngram_join, vptree
from tidemark.llm.components import components

VECTORS = "vec_id long, embedding array<float>, rank string"


def plain_nearest(rows, asked, k=10):
    fine = [(i, np.array(v, np.float64)) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for q, x in fine:
        if q in asked:
            far = sorted((float(vptree.distances(v[None, :], x)[0]), i) for i, v in fine if i != q)[:k]
            out += [(q, n + 1, i, s) for n, (s, i) in enumerate(far)]
    return sorted(out)


def test_nearest_is_exact_at_factor_one(spark):
    rng = np.random.default_rng(5)
    rows = [(n, rng.normal(size=8).astype(np.float32).tolist(), "x") for n in range(700)]
    rows += [(1000 + n, rows[n % 5][1], "tie") for n in range(20)]
    rows += [(2000, None, "x"), (2001, [0.0] * 8, "x"), (2002, [float("nan")] * 8, "x"), (2003, [None] + [1.0] * 7, "x"), (2004, [1.0], "x"), (None, [1.0] * 8, "x")]
    table = spark.createDataFrame(rows, VECTORS)
    asked = table.where((F.col("vec_id") % 50 == 0))
    rows = [r for r in rows if r[0] != 2004]
    got = sorted(map(tuple, vptree.nearest(table, asked, shard_rows=150).collect()))
    assert got == plain_nearest(rows, {i for i, *_ in rows if i is not None and i % 50 == 0})


@pytest.mark.parametrize("dims, scale", [(64, 1.0), (128, 8.0), (384, 10.0)])
def test_nearest_among_hundreds_of_copies(spark, dims, scale):
    """The smallest ids come first, however the rounding of the quick distances falls."""
    rng = np.random.default_rng(dims)
    plain = rng.normal(size=(302, dims))
    plain = (scale * plain / np.linalg.norm(plain, axis=1)[:, None]).astype(np.float32)
    rows = [(n, plain[n % 2 if n < 800 else n % 300 + 2].tolist(), "x") for n in rng.permutation(1000).tolist()]
    table = spark.createDataFrame(rows, VECTORS)
    got = sorted(map(tuple, vptree.nearest(table, table.where(F.col("vec_id") % 50 == 0), shard_rows=400).collect()))
    assert got == plain_nearest(rows, {i for i, *_ in rows if i % 50 == 0})


def test_larger_factor_skips_more_and_keeps_recall(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet")
    asked = table.where("vec_id % 10 = 0")
    exact = {tuple(r) for r in vptree.nearest(table, asked).select("query_id", "vec_id").collect()}
    near = {tuple(r) for r in vptree.nearest(table, asked, factor=1.5).select("query_id", "vec_id").collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_pruning_visits_fewer_rows(monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 6)) * 20
    rows = np.concatenate([c + rng.normal(size=(200, 6)) for c in centres])
    tree, seen = vptree.Tree(np.arange(len(rows)), rows), []
    plain = vptree.quick
    monkeypatch.setattr(vptree, "quick", lambda a, b: seen.append(len(a) * len(b)) or plain(a, b))
    tree.search(np.array([7]), rows[7:8], 10, 1.0)
    exact, seen[:] = sum(seen), []
    tree.search(np.array([7]), rows[7:8], 10, 3.0)
    assert sum(seen) <= exact < len(rows) / 3


def test_nearest_few_and_none(spark):
    one = spark.createDataFrame([(100, [1.0, 2.0], "x"), (100, [1.0, 2.0], "x"), (1, [1.0, 3.0], "x")], VECTORS)
    assert [tuple(r) for r in vptree.nearest(one, one.where("vec_id = 100")).collect()] == [(100, 1, 1, 1.0)]
    none = spark.createDataFrame([], VECTORS)
    assert vptree.nearest(none, none).count() == 0


def near_rows():
    a = helpers.prose(200, 1).split()
    rows = [(500 + n, " ".join(a[:k] + ["swapped"] + a[k + 1 :])) for n, k in enumerate(range(3, 195, 2))]
    rows += [(900 + n, " ".join(a)) for n in range(50)]
    # A chain: each text similar to the next only.
    b = [f"{w}{n}" for n, w in enumerate(helpers.prose(260, 2).split())]
    rows += [(2000 + n, " ".join(b[12 * n : 12 * n + 160])) for n in range(9)]
    rows += [(3000 + n, helpers.prose(90, 100 + n)) for n in range(40)]
    return rows + [(i, t) for i, t, *_ in helpers.odd_documents()]


@pytest.mark.parametrize("members", [256, 7])
def test_near_duplicates(spark, monkeypatch, members):
    """Also with blocks so small that classes span many pairs of blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", members)
    rows = near_rows()
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    links, classes = helpers.near_pairs(rows)
    want = sorted((str(i), c, n) for (i, _), c, n in zip(rows, classes, links))
    assert sorted((str(r.doc_id), r.class_id, r.n_links) for r in got) == [(i, c, n) for i, c, n in want] or sorted(
        ((str(r.doc_id), r.class_id, r.n_links) for r in got), key=str
    ) == sorted(want, key=str)


def test_near_duplicates_of_nothing(spark):
    assert ngram_join.near_duplicates(helpers.documents(spark, [])).count() == 0
    assert [tuple(r)[:4] for r in ngram_join.near_duplicates(helpers.documents(spark, [(None, None, None, None, None)])).collect()] == [(None, None, 0, 1)]


def test_components(spark):
    edges = [(n, n + 1) for n in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (200, 200)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{n: 1 for n in range(1, 41)}, 100: 100, 101: 100}


def test_pipeline(spark, data, tmp_path):
    """Each stage against its rule; the last one's pieces hold the kept documents' ids."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    first = docs.columns
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        path = str(tmp_path / name.replace(" ", "_"))
        stage(spark, docs, data).write.parquet(path)
        docs = spark.read.parquet(path)
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == first
        if name == "n-gram Jaccard join":
            rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
            _, classes = helpers.near_pairs(rows)
            assert {r.doc_id for r in docs.select("doc_id").collect()} == set(classes)
        if name == "secret scans":
            kept = docs.select("doc_id", "text", "lang", "source", "n_chars").collect()
            assert not any(helpers.secrets(r.text) for r in kept) and sizes[-1] == sizes[-2]
    check_pieces(docs.collect(), [tuple(r) for r in kept], 1024)
    whole = corpus_pipeline.run(spark, data)
    assert sorted(map(tuple, whole.drop("sequence_id").collect())) == sorted(map(tuple, docs.drop("sequence_id").collect()))


def test_language_stage_rejects_noise_and_keeps_prose(spark, data):
    import base64
    import random

    random.seed(6)
    noise = []
    for n in range(40):
        size = [60, 150, 700, 2500, 8000][n % 5]
        letters = "".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size))
        noise += [letters, " ".join(letters[k : k + 6] for k in range(0, size, 6)), base64.b64encode(random.randbytes(size)).decode()]
    folder = data.replace("sf0.001", "sf0.01")
    prose = spark.read.parquet(f"{folder}/documents.parquet")
    added = spark.createDataFrame([(10_000_000 + n, t, None, "noise", len(t)) for n, t in enumerate(noise)], prose.schema)
    kept = corpus_pipeline.language_id(spark, prose.unionByName(added), folder)
    assert kept.columns == prose.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert sum(i >= 10_000_000 for i in ids) <= 0.03 * len(noise)
    good = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").join(prose.where(F.length("text") >= 50), "doc_id")
    wanted = {r.doc_id for r in good.select("doc_id").collect()}
    assert len(wanted & ids) >= 0.99 * len(wanted)


def test_pipeline_stages_on_odd_rows(spark, data, tmp_path):
    for rows in (helpers.odd_documents(), []):
        docs = helpers.documents(spark, rows)
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, data).write.parquet(path := str(tmp_path / f"{len(rows)}-{n}"))
            docs = spark.read.parquet(path)
