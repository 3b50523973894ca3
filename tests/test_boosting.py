"""Boosting that continues, cross-fitted label means and keyed permutations."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev
from tidemark.plans import boosting, scoring

SMALL = boosting.Boost(depth=3, chunk=4)


@pytest.fixture(scope="module")
def rows(spark):
    """A label that depends on two numbers, one label in six turned round."""
    rng = np.random.default_rng(7)
    x = rng.random((900, 3)).round(2)
    y = ((x[:, 0] + (x[:, 1] > 0.5) > 0.9) ^ (rng.random(900) < 1 / 6)).astype(float)
    table = [(*map(float, r), float(v), n % 4 == 0, 1.0 + n % 3) for n, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(table, "a double, b double, c double, label double, stop boolean, w double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).cache()


def numbers(rows):
    table = rows.collect()
    x = np.array([r.features.toArray() for r in table], np.float32)
    return x, *(np.array([r[c] for r in table], float) for c in ("label", "stop", "w"))


def test_growing_on_is_growing_at_once(rows):
    steps = boosting.started(rows, "label", "stop", "w")
    for more in (8, 8, 16):
        before = steps.trees
        steps = boosting.grow(steps, more, SMALL)
        assert steps.trees[: len(before)] == before
    once = boosting.grow(boosting.started(rows, "label", "stop", "w"), 32, SMALL)
    assert steps.trees == once.trees and steps.losses == pytest.approx(once.losses, abs=1e-12)


def test_losses_are_those_of_the_trees_so_far(rows):
    state = boosting.grow(boosting.started(rows, "label", "stop"), 6, SMALL)
    x, y, held, _ = numbers(rows)
    margin = np.full(len(y), state.start)
    for tree, loss in zip(state.trees, state.losses):
        margin += SMALL.step * tree.output(x)
        p = 1 / (1 + np.exp(-margin))
        want = -(y * np.log(p) + (1 - y) * np.log(1 - p))[held == 1].mean()
        assert loss == pytest.approx(want, abs=1e-9)
    model = boosting.model_of(state)
    got = [r.p for r in model.transform(rows, "p").collect()]
    assert got == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-9)


def test_first_split_and_leaves_are_the_best_ones():
    rng = np.random.default_rng(3)
    x, g, h = rng.random((200, 4)).round(1).astype(np.float32), rng.normal(size=200), rng.random(200) + 0.1
    cells, edges = boosting.binned(x)
    tree, out = boosting.one_tree(cells, edges, g, h, 1, 1.0)

    def worth(mask):
        return sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (mask, ~mask) if m.any())

    best = max(worth(x[:, f] < t) for f in range(4) for t in np.unique(x[:, f])[1:])
    chosen = x[:, tree.feature[0]] < tree.threshold[0]
    assert worth(chosen) == pytest.approx(best)
    want = np.where(chosen, g[chosen].sum() / (h[chosen].sum() + 1), g[~chosen].sum() / (h[~chosen].sum() + 1))
    assert out == pytest.approx(want) and tree.output(x) == pytest.approx(want)


def test_depth_and_values_of_deep_trees():
    rng = np.random.default_rng(5)
    x, g = rng.random((3000, 5)).astype(np.float32), rng.normal(size=3000)
    cells, edges = boosting.binned(x)
    assert cells.max() < boosting.BINS
    tree, out = boosting.one_tree(cells, edges, g, np.ones(3000), 7, 1.0)
    assert tree.output(x) == pytest.approx(out) and len(tree.feature) <= 255
    for value in np.unique(out)[:20]:
        assert value == pytest.approx(g[out == value].sum() / ((out == value).sum() + 1))


def test_patience_ends_the_growth_and_the_best_count_is_kept(rows):
    boost = boosting.Boost(depth=3, patience=12, chunk=4)
    state = boosting.boosted(rows, "label", "stop", boost)
    assert 2 <= len(state.trees) < 200 and int(np.argmin(state.losses)) == len(state.trees) - 1
    fixed = boosting.boosted(rows, "label", None, boost, trees=3)
    assert len(fixed.trees) == 3 and fixed.losses == ()


def test_absolute_error_and_weights(rows):
    state = boosting.boosted(rows.withColumn("y", F.col("a") * 3), "y", "stop", boosting.Boost(depth=3, patience=20), kind=boosting.ABSOLUTE)
    x, *_ = numbers(rows)
    got = np.array([r.p for r in boosting.model_of(state).transform(rows, "p").collect()])
    assert np.abs(got - 3 * x[:, 0]).mean() < 0.15
    # Rows without weight teach nothing.
    odd = rows.withColumns({"y": F.when(F.col("w") == 1, 100.0).otherwise(1.0), "z": F.when(F.col("w") == 1, 0.0).otherwise(1.0)})
    only = boosting.boosted(odd, "y", None, SMALL, "z", boosting.ABSOLUTE, trees=4)
    assert {round(r.p, 6) for r in boosting.model_of(only).transform(rows, "p").collect()} == {1.0}


def test_folds_grown_together_are_the_folds_alone(rows):
    """The same trees and losses as one run per fold; a fold that stops early leaves the others growing."""
    boost = boosting.Boost(depth=3, patience=6, chunk=4, max_iter=60)
    numbered = rows.withColumn("fold", F.pmod(F.xxhash64("a", "b", "c"), F.lit(3)).cast("int")).cache()
    own = [F.col("fold") == f for f in range(3)]
    together = boosting.boosted_folds(numbered, "label", [F.when(~mine, F.col("w")) for mine in own], own, boost)
    for mine, state in zip(own, together):
        alone = boosting.boosted(numbered.withColumn("aside", mine), "label", "aside", boost, "w")
        assert len(state.trees) == len(alone.trees) and state.losses == pytest.approx(alone.losses, abs=1e-9)
        assert [t.feature for t in state.trees] == [t.feature for t in alone.trees] and state.start == pytest.approx(alone.start)
    assert len({len(s.trees) for s in together}) > 1


def test_fold_training_scores_every_row_by_a_model_that_has_not_seen_it(spark, rows):
    frame = rows.drop("features").withColumn("kind", F.when(F.col("a") > 0.5, "high").otherwise("low")).withColumn("n", F.monotonically_increasing_id())
    scored, models = scoring.train_folds(frame, scoring.FeatureRoles(["a", "b", "c"], ["kind"]), "label", ["n"], 3, SMALL.__class__(depth=3, patience=8, chunk=4))
    assert len(models) == 3 and scored.count() == 900
    assert all(r.auc > 0.7 for r in ev.roc_auc(scored, "raw_score", "label", ["fold"]).collect())


def test_a_sample_per_chunk_still_learns(rows, monkeypatch):
    monkeypatch.setattr(boosting, "SAMPLE_CELLS", 900)
    state = boosting.boosted(rows, "label", "stop", boosting.Boost(depth=3, patience=16, chunk=4))
    scored = boosting.model_of(state).transform(rows.where("stop"), "p")
    assert ev.roc_auc(scored, "p", "label").first().auc > 0.75


def test_odd_tables(spark, rows, tmp_path):
    one = rows.withColumn("label", F.lit(1.0))
    assert boosting.model_of(boosting.boosted(one, "label", "stop", SMALL, trees=2)).transform(one, "p").agg(F.min("p")).first()[0] > 0.99
    empty = boosting.boosted(rows.limit(0), "label", None, SMALL, trees=2)
    assert boosting.model_of(empty).transform(rows, "p").select("p").distinct().collect()[0].p < 0.01
    plain = rows.withColumn("features", F.first("features").over(Window.partitionBy("stop")))
    flat = boosting.boosted(plain.where("not stop"), "label", None, SMALL, trees=3)
    assert all(t.feature == [-1] for t in flat.trees)
    model = boosting.model_of(boosting.boosted(rows, "label", None, SMALL, trees=3))
    model.write(str(tmp_path / "m"))
    again = boosting.BoostedModel.read(spark, str(tmp_path / "m"))
    assert again == model


def same_trees(got, want):
    assert [(t.feature, t.threshold, t.left) for t in got.trees] == [(t.feature, t.threshold, t.left) for t in want.trees]
    assert [v for t in got.trees for v in t.value] == pytest.approx([v for t in want.trees for v in t.value], abs=1e-9)
    assert got.start == pytest.approx(want.start) and got.losses == pytest.approx(want.losses, abs=1e-9)


@pytest.mark.parametrize("kind", [boosting.LOGISTIC, boosting.ABSOLUTE])
def test_no_row_is_left_out_of_a_large_table(rows, monkeypatch, kind):
    """A table too large for one task gives the trees that one task grows on all its rows, chunk after chunk."""
    boost = boosting.Boost(depth=4, chunk=8)

    def grown():
        return boosting.grow(boosting.started(rows, "label", "stop", "w", kind), 12, boost)

    want = grown()
    monkeypatch.setattr(boosting, "SAMPLE_CELLS", 300)
    monkeypatch.setattr(boosting, "BLOCK_CELLS", 200)
    monkeypatch.setattr(boosting, "WRITTEN", 3)
    got = grown()
    assert got.spread() and not want.edges
    same_trees(got, want)


def test_bins_of_a_spread_table_are_those_of_all_its_rows(spark, hot):
    rng = np.random.default_rng(13)
    x = np.stack([rng.normal(size=900), rng.integers(0, 64, 900), np.ones(900), rng.integers(-70, 70, 900) / 7, rng.normal(size=900)], axis=1).astype(np.float32)
    x[5, 4] = np.nan
    number = np.where(rng.random(900) < 0.05, 300, 1)
    table = spark.createDataFrame([([float(v) for v in r], int(n)) for r, n in zip(x, number)], "x array<float>, n long").repartition(5)
    _, want = boosting.binned(x, number)
    got = boosting.table_edges(table, 5)
    assert [e.tolist() for e in got] == [e.tolist() for e in want] and [len(e) for e in got[1:3]] == [63, 0] and not len(got[4])


def test_rows_end_in_the_leaves_that_give_their_output():
    rng = np.random.default_rng(6)
    x, g = rng.random((2000, 4)).astype(np.float32), rng.normal(size=2000)
    cells, edges = boosting.binned(x)
    packs = boosting.Packs(cells, edges)
    tree, cut = boosting.split_up(boosting.Together(packs, g, np.ones(2000)), packs, edges, 5, 1.0)
    ends = boosting.routed(np.ascontiguousarray(cells.T), (tree.feature, cut, tree.left))
    assert np.array(tree.value)[ends] == pytest.approx(tree.output(x))
    assert (boosting.routed(cells.T, ([-1], [0], [-1])) == 0).all()


def test_no_row_is_left_out_of_large_folds(rows, monkeypatch):
    """Folds too large for a task, also one of them only, are grown on all their rows."""
    boost = boosting.Boost(depth=3, patience=6, chunk=4, max_iter=12)
    uneven = rows.withColumn("fold", F.when(F.col("a") < 0.6, 0).otherwise(1)).cache()
    own = [F.col("fold") == f for f in range(2)]

    def grown():
        return boosting.boosted_folds(uneven, "label", [F.when(~mine, F.col("w")) for mine in own], own, boost)

    want = grown()
    # One of the two is larger than its half, then both are.
    small, large = sorted(s.n * s.width for s in want)
    for cells in (small + large, 300):
        monkeypatch.setattr(boosting, "SAMPLE_CELLS", cells)
        got = grown()
        assert [s.spread(2) for s in got].count(True) == (2 if cells == 300 else 1)
        for g, w in zip(got, want):
            same_trees(g, w)


def test_equal_rows_are_grown_as_one(spark, rows):
    """Copies are one staged row: the trees are those of rows that weigh as much, the losses those of all copies."""
    thrice = rows.unionByName(rows).unionByName(rows)
    once = boosting.started(rows.withColumn("heavy", F.col("w") * 3), "label", "stop", "heavy")
    copies = boosting.started(thrice, "label", "stop", "w")
    kept = rows.select("a", "b", "c", "label", "stop").distinct().where("not stop").count()
    assert copies.n == once.n == kept and copies.start == pytest.approx(once.start)
    once, copies = (boosting.grow(s, 6, SMALL) for s in (once, copies))
    assert [t.feature for t in copies.trees] == [t.feature for t in once.trees] and copies.losses == pytest.approx(once.losses)
    assert not boosting.best_count(list(copies.losses), 50)[1]


def test_few_passes_for_many_trees():
    """The number of passes grows with the logarithm of the trees; chunks end at multiples of their length."""
    boost, done, passes = boosting.Boost(), 0, 0
    while done < 2000:
        length = boosting.chunk_length(done, boost)
        assert done % length == 0 and length >= boost.chunk and (done == 0 or length <= max(boost.chunk, done // 4))
        done, passes = done + length, passes + 1
    assert passes <= 40


def test_features_that_share_a_code_keep_their_sums():
    rng = np.random.default_rng(9)
    x = np.stack([rng.random(20000), *(rng.integers(0, n, 20000) for n in (2, 3, 1, 8, 2))], axis=1).astype(np.float32)
    cells, edges = boosting.binned(x)
    packs, g = boosting.Packs(cells, edges), rng.normal(size=20000)
    assert len(packs.codes) < 5
    rows, slot = np.arange(1, 20000, 2), np.arange(10000) % 3
    (sums,) = packs.sums(rows, slot, 3, (g,))
    for f, start in packs.places.items():
        for node in range(3):
            mine = rows[slot == node]
            want = np.bincount(cells[mine, f], g[mine], len(edges[f]) + 1)
            assert sums[node, start : start + len(want)] == pytest.approx(want)


def test_bins_count_rows_not_distinct_values():
    x, number = np.arange(200, dtype=np.float32)[:, None], np.where(np.arange(200) < 10, 500, 1)
    cells, edges = boosting.binned(x, number)
    plain, whole = boosting.binned(np.repeat(x, number, axis=0))
    assert (edges[0] == whole[0]).all() and (np.repeat(cells, number, axis=0) == plain).all()


def test_every_round_at_the_bottom_is_trained_on_all_rows(rows, monkeypatch):
    frame = rows.drop("features").withColumns({"id": F.monotonically_increasing_id(), "split": F.when(F.col("stop"), "test").otherwise("train")}).cache()
    pre = scoring.fit_preprocessor(frame, scoring.FeatureRoles(["a", "b", "c"]), "label")

    def rounds():
        model, history = scoring.bottom_percentile_train(frame, pre, "label", "id", rounds=2, boost=boosting.Boost(max_iter=6, depth=3, chunk=4))
        return [(t.feature, t.threshold) for t in model.trees], history

    trees, history = rounds()
    monkeypatch.setattr(boosting, "SAMPLE_CELLS", 300)
    again, found = rounds()
    assert again == trees and len(found) == 2
    assert all(f == pytest.approx(h, abs=1e-9) for f, h in zip(found, history))


# --------------------------------------------------------------------------- label means


@pytest.fixture(scope="module")
def coded(spark):
    """A random column of many levels, a useful one, and random labels that the second decides in part."""
    rng = np.random.default_rng(11)
    table = []
    for n in range(4000):
        useful = int(rng.integers(4))
        table.append((n // 2, f"r{rng.integers(800)}", f"u{useful}", int(rng.random() < 0.2 + 0.2 * useful), 1.0))
    table += [(None, "r1", "u1", 1, 1.0), (5, None, None, 0, None)]
    return spark.createDataFrame(table, "order_id long, noise string, useful string, label int, x double").cache()


ROLES = scoring.FeatureRoles(["x"], ["noise", "useful"])


def plain_means(rows, feature, key_fold):
    """Smoothed means of every row's level without its own fold."""
    out = []
    for n, r in enumerate(rows):
        others = [s for m, s in enumerate(rows) if key_fold[m] != key_fold[n]]
        same = [s.label for s in others if (s[feature] or "unknown") == (r[feature] or "unknown")]
        prior = sum(s.label for s in others) / len(others)
        out.append((sum(same) + 20 * prior) / (len(same) + 20))
    return out


def test_no_row_sees_its_own_label(coded):
    pre = scoring.fit_preprocessor(coded, ROLES, "label", min_count=1, fold_key="order_id")
    ready = pre.apply(coded, F.lit(True)).cache()
    auc = {c: ev.roc_auc(ready, f"{c}_mean", "label").first().auc for c in ("noise", "useful")}
    assert abs(auc["noise"] - 0.5) < 0.04 and auc["useful"] > 0.6
    # Means that include the own label make noise look useful; that is what new rows' means would do here.
    leaky = ev.roc_auc(pre.apply(coded), "noise_mean", "label").first().auc
    assert leaky > 0.65


def test_cross_fitted_means_are_the_plain_ones(spark, coded):
    some = coded.where("order_id < 60 OR order_id IS NULL").cache()
    pre = scoring.fit_preprocessor(some, ROLES, "label", min_count=1, fold_key="order_id", folds=3)
    rows = pre.apply(some, F.lit(True)).withColumn("fold", scoring.fold_of("order_id", 3)).collect()
    for feature in ("noise", "useful"):
        want = plain_means(rows, feature, [r.fold for r in rows])
        assert [r[f"{feature}_mean"] for r in rows] == pytest.approx(want)
    assert len({(r.order_id, r.fold) for r in rows}) == len({r.order_id for r in rows})


def test_new_rows_get_the_stored_means(coded, spark):
    pre = scoring.fit_preprocessor(coded, ROLES, "label", min_count=1, fold_key="order_id")
    alone = scoring.fit_preprocessor(coded, ROLES, "label", min_count=1)
    new = spark.createDataFrame([("u3", "r1", 1.0), ("zzz", "zzz", None)], "useful string, noise string, x double")
    a, b = ([(r.useful_mean, r.noise_mean) for r in p.apply(new).orderBy("useful").collect()] for p in (pre, alone))
    assert a == b and a[0][0] == pytest.approx(pre.prior)


# --------------------------------------------------------------------------- permutations


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 30, 97, 1000])
def test_keyed_ranks_are_a_permutation(spark, n):
    ranks = spark.range(n)
    keys = [[r.to for r in ranks.select(scoring.permuted(F.col("id"), n, key).alias("to")).collect()] for key in (1, 2)]
    assert all(sorted(k) == list(range(n)) for k in keys)
    assert n < 30 or keys[0] != keys[1] and sum(k == i for i, k in enumerate(keys[0])) < n / 4


def test_shuffled_rows_are_the_rows_in_another_order(spark):
    rows = spark.range(333).select("id", (F.col("id") * 3).alias("v"), F.col("id").cast("string").alias("s"))
    out = scoring.shuffled_rows(rows, ["v", "s"], ["id"], 4).collect()
    for d in range(4):
        mine = [r for r in out if r.draw == d]
        assert sorted(r.p_v for r in mine) == [3 * n for n in range(333)] and sorted(r.id for r in mine) == list(range(333))
        assert all(r.p_s == str(r.p_v // 3) for r in mine)


def test_importance_has_an_error(spark, rows):
    pre = scoring.fit_preprocessor(rows, scoring.FeatureRoles(["a", "b", "c"]), "label")
    model = scoring.train_gbt_classifier(rows.withColumn("is_stop", F.col("stop")).drop("features"), pre, "label", boost=SMALL)
    found = {r.feature: r for r in scoring.permutation_importance(model, rows.drop("features"), ["a", "b", "c"], "label", ["a", "b", "c", "w"], draws=4).collect()}
    assert found["a"].importance > 5 * found["a"].standard_error > 0 and found["c"].importance < found["a"].importance / 4
    assert not math.isnan(found["c"].standard_error)


def test_a_scorer_and_its_importances_come_from_all_rows(rows, monkeypatch):
    frame = rows.drop("features").withColumns({"order": F.monotonically_increasing_id(), "kind": F.when(F.col("b") > 0.5, "x").otherwise("y")})
    frame = frame.withColumn("split", F.element_at(F.array(*map(F.lit, ("train", "train", "stop", "calib"))), (F.col("order") % 4 + 1).cast("int"))).cache()

    def trained():
        return scoring.train_scorer(frame, scoring.FeatureRoles(["a", "c"], ["kind"]), "label", boost=boosting.Boost(max_iter=6, depth=3, chunk=4), fold_key="order")

    def importances(s):
        held = s.pre.apply(frame.where("split = 'calib'"))
        found = scoring.permutation_importance(s.trees, held, s.pre.inputs(), "label", ["order"], draws=2).collect()
        return {r.feature: (pytest.approx(r.importance, abs=1e-9), pytest.approx(r.standard_error, abs=1e-9)) for r in found}

    want = trained()
    monkeypatch.setattr(boosting, "SAMPLE_CELLS", 300)
    got = trained()
    assert [(t.feature, t.threshold) for t in got.trees.trees] == [(t.feature, t.threshold) for t in want.trees.trees]
    assert importances(got) == importances(want)


def test_rows_as_they_are_are_scored_once(spark, rows):
    """One copy per feature and draw, and one more: not one more per draw; importances are those of plain means."""
    plain, scored = rows.select("a", "b", "c", "label"), []

    class Counting:
        def transform(self, df, out):
            scored.append(df.count())
            return df.withColumn(out, 0.1 + 0.8 * F.col("a") * F.col("b"))

    found = {r.feature: r for r in scoring.permutation_importance(Counting(), plain, ["a", "b", "c"], "label", ["a", "b", "c", "label"], draws=4).collect()}
    assert scored == [900 * (4 * 3 + 1)]
    moved = scoring.shuffled_rows(plain, ["a", "b", "c"], ["a", "b", "c", "label"], 4).toPandas()

    def loss(a, b):
        p = 0.1 + 0.8 * a * b
        return -(moved.label * np.log(p) + (1 - moved.label) * np.log(1 - p))

    rise = (loss(moved.p_a, moved.b) - loss(moved.a, moved.b)).groupby(moved.draw).mean()
    assert found["a"].importance == pytest.approx(rise.mean()) and found["a"].standard_error == pytest.approx(rise.sem())
    assert found["c"].importance == pytest.approx(0.0, abs=1e-12)


def test_sums_of_shared_codes_are_those_of_each_feature(monkeypatch):
    """The table of a code is gone through twice, not once per feature of it."""
    rng = np.random.default_rng(3)
    widths = (5, 3, 2, 4, 2)
    joint = rng.random((6, 240))
    whole = joint.reshape(6, *widths)
    found = boosting.marginals(joint, widths)
    for n, sums in enumerate(found):
        assert np.allclose(sums, whole.sum(axis=tuple(m + 1 for m in range(5) if m != n)), rtol=1e-12)
    assert [s.shape for s in found] == [(6, w) for w in widths]
    assert boosting.marginals(joint, (240,))[0] is joint
