"""The additive quality model: plain re-computation of measures and scores, held-out accuracy, what training may see."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import helpers
from tidemark.llm import additive_quality as aq

LABELS = "doc_id long, quality int, text string"


def plain_measures(text):
    words = text.split()
    if not words:
        return None
    chars = Counter(text)

    def total(test):
        return sum(n for c, n in chars.items() if test(c))

    letters, shown = max(1, total(str.isalpha)), max(1, total(lambda c: not c.isspace()))
    sizes = [len(w) for w in words]
    mean = sum(sizes) / len(words)
    triples = list(zip(words, words[1:], words[2:]))
    lines = [line for line in text.split("\n") if line.strip()]
    signs = total(lambda c: not c.isalpha() and not c.isdigit() and not c.isspace() and c.isprintable())
    return {
        "log_words": math.log1p(len(words)), "mean_word": mean, "spread_word": math.sqrt(sum((s - mean) ** 2 for s in sizes) / len(words)),
        "log_longest": math.log1p(max(sizes)), "upper": total(str.isupper) / letters, "digits": total(lambda c: c.isdigit() and not c.isalpha()) / shown,
        "sentence_signs": sum(chars[c] for c in ".!?") / shown, "beyond_ascii": total(lambda c: ord(c) > 127) / len(text),
        "no_letter_words": sum(not re.search(r"[^\W\d_]", w) for w in words) / len(words), "single_words": sizes.count(1) / len(words),
        "distinct_words": math.log1p(len(set(words))) / math.log1p(len(words)), "top_word": max(Counter(words).values()) / len(words),
        "same_as_previous": sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words) - 1),
        "repeated_triples": 1 - len(set(triples)) / len(triples) if triples else 0.0, "log_line": math.log1p(len(words) / len(lines)),
        "repeated_lines": 1 - len(set(lines)) / len(lines), "entropy": -sum(n / len(text) * math.log2(n / len(text)) for n in chars.values()),
        "signs_per_word": signs / len(words),
    }


def test_measures_are_the_plain_ones():
    texts = [t for _, t, *_ in helpers.odd_documents() if t and all(ord(c) < 1 << 16 for c in t) and "\x01" not in t and "\x1c" not in t]
    found = aq.measured([*texts, "", " \n"])
    for row, text in zip(found, texts):
        want = plain_measures(text)
        got = dict(zip(aq.MEASURES, row.tolist()))
        assert want is None and not row.any() or {m: got[m] for m in want} == pytest.approx(want), text[:50]
    assert not found[-2:].any()


def plain_score(model, row):
    total = model.base
    for f, (edges, table) in enumerate(zip(model.edges, model.tables)):
        total += table[sum(row[f] >= e for e in edges)]
    for (i, j), table in zip(model.pairs, model.pair_tables):
        total += table[sum(row[i] >= e for e in model.pair_edges[i])][sum(row[j] >= e for e in model.pair_edges[j])]
    return 1 / (1 + math.exp(-total))


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def area(scores, y):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(order))
    ranks[order] = np.arange(1, len(order) + 1)
    ones = y.sum()
    return (ranks[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


@pytest.fixture(scope="module")
def tables(spark, data):
    folder = data.replace("sf0.001", "sf0.01")
    return spark.read.parquet(f"{folder}/documents.parquet").cache(), spark.read.parquet(f"{folder}/labels.parquet").cache()


@pytest.fixture(scope="module")
def model(tables):
    return aq.learn(*tables)


def test_scores_are_plain_sums_and_rank_unseen_documents(tables, model):
    docs, labels = tables
    got = {r.doc_id: r for r in aq.score(docs, model).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    some = sorted(texts)[::25]
    for i, row in zip(some, aq.measured([texts[i] for i in some])):
        assert got[i].score == pytest.approx(plain_score(model, row), abs=1e-9) and got[i].predicted == (got[i].score >= 0.3)
    known = [(got[r.doc_id].score, r.quality) for r in labels.collect() if held(r.doc_id)]
    scores, y = (np.array(x, float) for x in zip(*known))
    assert area(scores, y) >= 0.97 and (scores[y == 1] >= 0.3).mean() >= 0.98


def test_held_out_labels_and_other_columns_change_nothing(tables, model):
    docs, labels = tables
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = aq.learn(docs.withColumns({"lang": F.lit("zz"), "source": F.lit("s"), "label": F.lit(7)}), turned)
    assert again.dump() == model.dump()


def test_odd_rows(spark, model):
    docs = helpers.documents(spark).withColumns({"score": F.lit("clash"), "predicted": F.lit(9), "label": F.lit(3), "x": F.lit(1)})
    out = aq.score(docs, model)
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "label", "x", "score", "predicted"]
    assert len(rows) == len(helpers.odd_documents()) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not (r.text or "").split()}) == 1
    assert aq.score(docs.limit(0), model).count() == 0


def test_few_or_odd_labels(spark):
    docs = helpers.documents(spark)
    ids = [r[0] for r in helpers.odd_documents() if r[0] is not None and not held(r[0])]

    def scores(rows):
        return {r.score for r in aq.quality_scores(docs, spark.createDataFrame(rows, LABELS)).collect()}

    assert scores([]) == {0.5}
    assert scores([(ids[0], None, ""), (ids[1], 7, ""), (None, 1, "")]) == {0.5}
    assert len(scores([(i, 1, "") for i in ids])) == 1
    assert len(scores([(i, n % 2, "") for n, i in enumerate(ids)] + [(ids[0], 1, ""), (ids[1], 0, "")])) >= 1


def test_sample_is_bounded_and_copies_are_weights(spark):
    rows = [(n, helpers.prose(20 + n % 40, n), "en", "s", 0) for n in range(600)]
    docs, labels = helpers.documents(spark, rows + rows[:1] * 50), spark.createDataFrame([(n, n % 2, "") for n in range(600)], LABELS)
    every = aq.training_rows(docs, labels, "quality", 10_000).collect()
    first = 50 if not held(0) else 0
    assert sum(r.n for r in every) == sum(not held(n) for n in range(600)) + first
    assert 30 <= aq.training_rows(docs, labels, "quality", 100).count() <= 200


def test_trees_take_the_best_splits():
    rng = np.random.default_rng(4)
    g, h = rng.normal(size=9), rng.random(9) + 0.1

    def cost(*parts):
        return sum(aq.gain(g[p].sum(), h[p].sum()) for p in parts)

    cut = max(range(1, 9), key=lambda k: cost(slice(0, k), slice(k, 9)))
    found = aq.tree(g, h, leaves=2)
    assert found[:cut] == pytest.approx(g[:cut].sum() / (h[:cut].sum() + aq.RIDGE)) and found[cut:] == pytest.approx(g[cut:].sum() / (h[cut:].sum() + aq.RIDGE))
    grid, curve = rng.normal(size=(4, 5)), rng.random((4, 5)) + 0.1

    def worth(first, columns):
        total = 0.0
        for rows, k in zip((slice(0, first), slice(first, None)), columns):
            total += sum(aq.gain(grid[rows, c].sum(), curve[rows, c].sum()) for c in (slice(0, k), slice(k, None)))
        return total - aq.gain(grid.sum(), curve.sum())

    want = max(worth(f, (a, b)) for f in range(1, 4) for a in range(1, 5) for b in range(1, 5))
    assert aq.split_grid(grid, curve)[0] == pytest.approx(want)


def test_pairs_learn_what_single_measures_cannot():
    """Both-or-neither of two measures: no table of one measure helps."""
    rng = np.random.default_rng(2)
    x = rng.random((3000, len(aq.MEASURES)))
    y = ((x[:, 3] > 0.5) == (x[:, 7] > 0.5)).astype(float)
    held_rows = np.arange(3000) % 7 == 0
    model = aq.fit(x[:2000], y[:2000], np.ones(2000), held_rows[:2000])
    assert (3, 7) in model.pairs and area(model.score(x[2000:]), y[2000:]) > 0.95
    model.pairs, model.pair_tables = [], []
    assert area(model.score(x[2000:]), y[2000:]) < 0.65
