"""Training, calibration and batch scoring with Spark ML.

Categories become smoothed label means learned on the training rows only, kept as a table and
applied by joins, so no list of levels passes through the driver. Calibration learns from the
distinct scores, which boosted trees keep few.

Boosting (``boosting``) adds trees to what has been grown, reads the loss of every tree count on the rows set aside for
it, and keeps the count after which the loss has not fallen for ``patience`` trees (``Boost``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import confidence_tier, hash_fraction
from tidemark.operators.cleaning import impute_by_role, kept_levels, level_counts, long_form, rare_pool
from tidemark.operators.evaluation import (
    linear_contributions,
    log_loss_of,
    percentile_rank_pct,
    regression_errors,
    roc_auc,
)
from tidemark.operators.ordered import exact_quantiles, position, prefix_scan
from tidemark.operators.splits import cv_no_shuffle, exact_sample, fold_roles, hard_example_reweight, linear_recency_weight
from tidemark.plans import boosting, calls
from tidemark.plans.boosting import CLASSIFY, REGRESS, Boost, BoostedModel
from tidemark.sources.scratch import checked, staged
from tidemark.sources.tables import PREDICTION_SCHEMA, check_columns, conform, load_spec, save_spec

SMOOTHING = 20.0
# Counts per text column that tokens are hashed into.
TEXT_WIDTH = 1 << 12


@dataclass
class FeatureRoles:
    numeric: list[str]
    categorical: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)

    def names(self) -> list[str]:
        return [*self.numeric, *self.categorical, *self.text]


def feature_roles(df: DataFrame, drop: list[str], text: list[str] = ()) -> FeatureRoles:
    """Roles from the schema: strings are categorical unless listed as text."""
    numeric, categorical = [], []
    for name, kind in df.dtypes:
        if name in drop or name in text:
            continue
        (categorical if kind == "string" else numeric).append(name)
    return FeatureRoles(numeric, categorical, [t for t in text if t in df.columns])


def banned_columns(roles: FeatureRoles, banned: list[str]) -> list[str]:
    """Ids, dates and targets found among the features; should be none."""
    return sorted(set(roles.names()) & set(banned))


# The part of the means table that rows outside the training rows get.
NEW_ROWS = -1


def fold_of(key: str, folds: int) -> Column:
    """Fold of a row by its key, so rows of one key share it; null keys are in fold 0."""
    return F.coalesce(F.floor(hash_fraction(F.col(key), "cross_fit") * folds).cast("int"), F.lit(0))


@dataclass
class Preprocessor:
    """Everything learned from training rows that new rows need: kept levels, level means, prior.

    ``means`` has one row per (feature, value, fold): fold -1 for new rows, and one per fold of training rows that
    leaves the labels of that fold out, so no training row sees its own label in its features."""

    roles: FeatureRoles
    levels: DataFrame
    means: DataFrame
    prior: float
    fold_key: str | None = None
    folds: int = 5

    def apply(self, df: DataFrame, training: Column | None = None) -> DataFrame:
        """Pool unseen and rare levels, impute, and replace categories by their label means. Rows for which
        ``training`` holds are those the means were learned on."""
        check_columns(df, self.roles.names(), "model features")
        cats = self.roles.categorical
        df = impute_by_role(df, self.roles.numeric, [*cats, *self.roles.text])
        if not cats:
            return df
        df = rare_pool(df, cats, keep=self.levels)
        own = F.lit(NEW_ROWS)
        if training is not None and self.fold_key is not None:
            own = F.when(training, fold_of(self.fold_key, self.folds)).otherwise(NEW_ROWS)
        df = df.withColumn("__own", own)
        learned, side = checked(self.means, "means")
        for c in cats:
            means = learned.filter(F.col("feature") == c).select(F.col("value").alias("__v"), F.col("fold").alias("__f"), F.col("mean").alias(f"{c}_mean"))
            df = df.join(side(means), (F.col(c) == F.col("__v")) & (F.col("__own") == F.col("__f")), "left").drop("__v", "__f")
            df = df.withColumn(f"{c}_mean", F.coalesce(f"{c}_mean", F.lit(self.prior)))
        return df.drop("__own")

    def inputs(self) -> list[str]:
        return [*self.roles.numeric, *[f"{c}_mean" for c in self.roles.categorical]]


def fit_preprocessor(
    train: DataFrame, roles: FeatureRoles, label: str, min_count: int = 50, fold_key: str | None = None, folds: int = 5
) -> Preprocessor:
    """Learn on the training rows only. With ``fold_key`` the means for training rows are cross-fitted: one aggregate
    per (feature, value, fold), and each fold gets the total less its own part, of the values and of the prior."""
    cats = roles.categorical
    filled = impute_by_role(train, roles.numeric, cats)
    spark = train.sparkSession
    filled = filled.withColumn("__fold", fold_of(fold_key, folds) if fold_key else F.lit(0))
    by_fold = {r["fold"]: (r["won"] or 0.0, r["n"]) for r in filled.groupBy(F.col("__fold").alias("fold")).agg(F.sum(F.col(label).cast("double")).alias("won"), F.count(label).alias("n")).collect()}
    won, n = (float(sum(x[k] for x in by_fold.values())) for k in (0, 1))
    prior = won / n if n else 0.0
    if not cats:
        empty = spark.createDataFrame([], "feature string, value string, fold int, mean double")
        return Preprocessor(roles, empty.select("feature", "value"), empty, prior, fold_key, folds)
    levels = kept_levels(level_counts(filled, cats), min_count)
    pooled = rare_pool(filled, cats, keep=levels)
    parts = long_form(pooled, cats, [label, "__fold"], "string").groupBy("feature", "value", F.col("__fold").alias("fold")).agg(
        F.sum(F.col(label).cast("double")).alias("won"), F.count(label).alias("n")
    )
    parts = staged(parts, "level_folds")
    totals = parts.groupBy("feature", "value").agg(F.sum("won").alias("__won"), F.sum("n").alias("__n"))
    means = totals.select("feature", "value", F.lit(NEW_ROWS).alias("fold"), ((F.col("__won") + SMOOTHING * prior) / (F.col("__n") + SMOOTHING)).alias("mean"))
    if fold_key is not None:
        # Label mean of all other folds; the prior where there is none.
        others = F.lit(prior)
        for f, (w, m) in sorted(by_fold.items()):
            if n > m:
                others = F.when(F.col("fold") == f, F.lit((won - w) / (n - m))).otherwise(others)
        left = (F.col("__won") - F.col("won") + SMOOTHING * others) / (F.col("__n") - F.col("n") + SMOOTHING)
        means = means.unionByName(parts.join(totals, ["feature", "value"]).select("feature", "value", "fold", left.alias("mean")))
    return Preprocessor(roles, levels, means, prior, fold_key, folds)


def text_stages(columns: list[str], width: int = TEXT_WIDTH) -> list:
    """Tokens hashed into a fixed number of counts per text column."""
    stages = []
    for c in columns:
        stages.append(RegexTokenizer(inputCol=c, outputCol=f"{c}_tokens", pattern=r"\W+"))
        stages.append(HashingTF(inputCol=f"{c}_tokens", outputCol=f"{c}_hashed", numFeatures=width))
    return stages


def encode(pre: Preprocessor) -> list:
    """Stages from preprocessed columns to the feature vector."""
    vectors = [f"{c}_hashed" for c in pre.roles.text]
    return [
        *text_stages(pre.roles.text),
        VectorAssembler(inputCols=[*pre.inputs(), *vectors], outputCol="every_feature", handleInvalid="keep"),
        # Token counts no training row has can't split anything: they stay out of the trees' statistics.
        VarianceThresholdSelector(featuresCol="every_feature", outputCol="features"),
    ]


def train_gbt_classifier(
    rows: DataFrame, pre: Preprocessor, label: str, stop: str = "is_stop", weight: str | None = None, boost: Boost = CLASSIFY
) -> BoostedModel:
    """Boosted trees on preprocessed rows; rows marked ``stop`` decide when to stop."""
    coder = Pipeline(stages=encode(pre)).fit(rows)
    return boosting.model_of(boosting.boosted(coder.transform(rows), label, stop, boost, weight), coder)


def raw_score(model: BoostedModel, df: DataFrame) -> DataFrame:
    scored = model.transform(df, "raw_score")
    return scored.drop("every_feature", "features", *[c for c in scored.columns if c.endswith(("_tokens", "_hashed"))])


def isotonic_calibrate(scored: DataFrame, score: str, label: str) -> IsotonicRegressionModel:
    """Monotone map from score to probability, learned on the distinct scores, weighted by their rows."""
    table = scored.groupBy(F.col(score).alias("score")).agg(F.avg(label).alias("rate"), F.count(F.lit(1)).cast("double").alias("weight"))
    # Staged: the fit reads it more than once, and the rows are scored for it.
    return IsotonicRegression(featuresCol="score", labelCol="rate", weightCol="weight", predictionCol="calibrated").fit(staged(table, "calibration"))


def calibrated(model: IsotonicRegressionModel, df: DataFrame, score: str, out: str) -> DataFrame:
    return model.setFeaturesCol(score).setPredictionCol(out).transform(df)


def train_folds(
    rows: DataFrame, roles: FeatureRoles, label: str, order: list[str], folds: int = 3, boost: Boost = CLASSIFY, weight: str | None = None
) -> tuple[DataFrame, list[BoostedModel]]:
    """Contiguous folds in time order (``cv_no_shuffle``): each fold's model learns from the other folds, stops on its own, and
    scores it. All folds are trained together over one staged table. Gives the out-of-fold scores (``fold``, ``raw_score``
    beside the rows' columns) and the models. Categories enter as hashed tokens, which no label is needed for."""
    filled = impute_by_role(rows, roles.numeric, [*roles.categorical, *roles.text])
    pre = Preprocessor(FeatureRoles(roles.numeric, [], [*roles.categorical, *roles.text]), None, None, 0.0)
    dealt = staged(cv_no_shuffle(filled, order, folds), "fold_rows")
    coder = Pipeline(stages=encode(pre)).fit(dealt)
    share = F.col(weight) if weight else F.lit(1.0)
    own = [F.col("fold") == f for f in range(1, folds + 1)]
    grown = boosting.boosted_folds(coder.transform(dealt), label, [F.when(~mine, share) for mine in own], own, boost)
    models = [boosting.model_of(g, coder) for g in grown]
    scored = [raw_score(m, dealt.filter(mine)) for m, mine in zip(models, own)]
    return reduce(DataFrame.unionByName, scored), models


@dataclass
class Scorer:
    """Preprocessing, trees and calibration as one artifact."""

    pre: Preprocessor
    trees: BoostedModel
    isotonic: IsotonicRegressionModel

    def score(self, df: DataFrame, out: str = "success_prob") -> DataFrame:
        raw = raw_score(self.trees, self.pre.apply(df))
        return calibrated(self.isotonic, raw, "raw_score", out)


def train_scorer(
    rows: DataFrame, roles: FeatureRoles, label: str, split: str = "split", boost: Boost = CLASSIFY, fold_key: str | None = None
) -> Scorer:
    """Learn preprocessing on train, trees on train with early stopping on stop, calibration on calib.

    With ``fold_key`` training rows get label means that leave their own fold of keys out."""
    pre = fit_preprocessor(rows.filter(F.col(split) == "train"), roles, label, fold_key=fold_key)
    ready = pre.apply(rows, F.col(split) == "train").withColumn("is_stop", F.col(split) == "stop")
    # Only what trees and calibration read is written.
    ready = staged(ready.select(*dict.fromkeys([*pre.inputs(), *roles.text, label, split, "is_stop"])), "ready")
    trees = train_gbt_classifier(ready.filter(F.col(split).isin("train", "stop")), pre, label, boost=boost)
    calib = raw_score(trees, ready.filter(F.col(split) == "calib"))
    return Scorer(pre, trees, isotonic_calibrate(calib, "raw_score", label))


def save_artifact(scorer: Scorer, path: str, spec: dict) -> None:
    """Folder with models, learned tables and a JSON spec (roles, prior, thresholds, metrics ...)."""
    spark = scorer.pre.means.sparkSession
    scorer.trees.write(f"{path}/trees")
    scorer.isotonic.write().overwrite().save(f"{path}/isotonic")
    scorer.pre.levels.write.mode("overwrite").parquet(f"{path}/levels")
    scorer.pre.means.write.mode("overwrite").parquet(f"{path}/means")
    roles = scorer.pre.roles
    learned = {"numeric": roles.numeric, "categorical": roles.categorical, "text": roles.text, "prior": scorer.pre.prior, "fold_key": scorer.pre.fold_key, "folds": scorer.pre.folds}
    save_spec(spark, {**spec, "preprocess": learned}, f"{path}/spec")


def load_artifact(spark, path: str) -> tuple[Scorer, dict]:
    spec = load_spec(spark, f"{path}/spec")
    p = spec["preprocess"]
    pre = Preprocessor(
        FeatureRoles(p["numeric"], p["categorical"], p["text"]), spark.read.parquet(f"{path}/levels"),
        spark.read.parquet(f"{path}/means"), p["prior"], p["fold_key"], p["folds"],
    )
    return Scorer(pre, BoostedModel.read(spark, f"{path}/trees"), IsotonicRegressionModel.load(f"{path}/isotonic")), spec


REQUIRED = ["order_id", "invoice_id", "transaction_id", "retries", "historical_collected_amount"]


def score_batch(
    scorer: Scorer, rows: DataFrame, run_at: Column, threshold: float = 0.05, random_share: float = 0.1, seed: int = 42
) -> DataFrame:
    """Decision table: cut early below the threshold, and a fixed share of rows flagged at random."""
    check_columns(rows, REQUIRED, "columns needed for the output table")
    scored = scorer.score(exact_sample(rows, "transaction_id", share=random_share, seed=seed))
    out = scored.select(
        "order_id", "invoice_id", "transaction_id", (F.col("success_prob") < threshold).alias("is_cutoff_early"),
        run_at.alias("cutoff_datetime"), F.col("retries").alias("cut_off_at_retry"),
        F.col("historical_collected_amount").alias("current_cltv"), F.col("is_sampled").alias("random_selection"),
    )
    return conform(out, PREDICTION_SCHEMA)


def score_leads(scored: DataFrame, probability: str, percentile: float = 25.0) -> DataFrame:
    """Rank, action and confidence tier of scored leads; the lowest ``percentile`` percent are rejected."""
    cut = exact_quantiles(scored, [], probability, [percentile / 100]).select("q").scalar()
    ranked = percentile_rank_pct(scored, probability)
    action = F.when(F.col(probability) <= cut, "REJECT").otherwise("ACCEPT")
    return ranked.withColumns({"recommended_action": action, "confidence_tier": confidence_tier(F.col("percentile_rank"))})


def hard_label(probability: Column, threshold: float = 0.5) -> Column:
    return (probability >= threshold).cast("int")


def score_summary(ranked: DataFrame, probability: str) -> DataFrame:
    rejected = F.col("recommended_action") == "REJECT"
    return ranked.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(rejected).alias("rejected"), F.count_if(~rejected).alias("accepted"),
        F.max(F.when(rejected, F.col(probability))).alias("rejection_threshold"),
    )


def bottom_percentile_train(
    rows: DataFrame, pre: Preprocessor, label: str, id_column: str, target: float = 25.0, extra: float = 15.0,
    zone: float = 10.0, rounds: int = 3, boost: Boost = CLASSIFY,
) -> tuple[BoostedModel, list[dict]]:
    """Train, look at the lowest ``target`` percent, raise the weights of what went wrong there, repeat.

    Keeps the round with the fewest positives at the bottom, then the best precision. ``rows`` are
    preprocessed and carry ``split`` train or test; test rows stop the training, as in a single hold-out.
    """
    rows = staged(rows.withColumn("is_stop", F.col("split") == "test"), "rows")
    # Weights live in a small side table (id, weight) that each round writes anew and reads back.
    weights = rows.select(id_column).withColumn("weight", F.lit(1.0))
    best, best_key, history = None, None, []
    for n in range(rounds):
        model = train_gbt_classifier(rows.join(weights, id_column), pre, label, weight="weight", boost=boost)
        scored = staged(raw_score(model, rows).select(id_column, "raw_score", label, "is_stop"), "scored")
        test = scored.filter("is_stop")
        cut = exact_quantiles(test, [], "raw_score", [target / 100]).first()["q"]
        low = F.col("raw_score") <= cut
        row = test.agg(
            F.count_if(low & (F.col(label) == 1)).alias("fn"), F.count_if(low & (F.col(label) == 0)).alias("tn")
        ).first()
        auc = roc_auc(test, "raw_score", label).first()["auc"]
        precision = row["tn"] / max(row["tn"] + row["fn"], 1)
        history.append({"iteration": n + 1, "auc": auc, "precision": precision, "fn": row["fn"], "tn": row["tn"]})
        key = (row["fn"], -precision)
        if best_key is None or key < best_key:
            best, best_key = model, key
        if n < rounds - 1:
            train = scored.filter(~F.col("is_stop")).select(id_column, "raw_score", label).join(weights, id_column)
            raised = hard_example_reweight(train, "raw_score", label, "weight", target + extra, target + extra + zone)
            kept = scored.filter("is_stop").select(id_column, F.lit(1.0).alias("weight"))
            weights = raised.select(id_column, "weight").unionByName(kept)
            weights = staged(weights, "weights")
    return best, history


def permuted(rank: Column, n: int, key: int, rounds: int = 6) -> Column:
    """A keyed bijection of the ranks 0 to ``n`` - 1.

    Alternating Feistel rounds on the cells of a grid of about the square root of ``n`` rows and columns; a rank that leaves
    the range is mapped on until it is back. At most one grid row lies outside, so small ranges are back within that
    many steps and large ones, in practice, after one or two."""
    down = max(1, math.isqrt(max(n - 1, 0)) + 1)
    across = max(1, -(-n // down))
    outside = down * across - n

    def turn(x: Column, number: Column) -> Column:
        lower = F.pmod(x.l + F.pmod(F.xxhash64(x.r, number, F.lit(key)), F.lit(down)), F.lit(down))
        right = F.pmod(x.r + F.pmod(F.xxhash64(x.l, number, F.lit(key)), F.lit(across)), F.lit(across))
        even = number % 2 == 0
        return F.struct(F.when(even, lower).otherwise(x.l).alias("l"), F.when(even, x.r).otherwise(right).alias("r"))

    def once(x: Column) -> Column:
        start = F.struct(F.floor(x / across).cast("long").alias("l"), F.pmod(x, F.lit(across)).cast("long").alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, turn, lambda x: x.l * across + x.r)

    first = once(rank.cast("long"))
    if outside == 0:
        return first
    # Every step outside is another of the ``outside`` places, so as many steps always suffice.
    steps = F.sequence(F.lit(1), F.lit(min(outside, 64)))
    return F.aggregate(steps, first, lambda x, _: F.when(x >= n, once(x)).otherwise(x))


def shuffled_rows(rows: DataFrame, features: list[str], order: list[str], draws: int, seed: int = 42) -> DataFrame:
    """Each row once per draw with the features of another row (``p_<feature>``): a permutation of all rows per draw,
    joined on the rank of the row, which is computed once."""
    ranked = staged(prefix_scan(rows, [], order, {"__rank": position()}).withColumn("__rank", F.col("__rank") - 1), "ranked")
    n = ranked.count()
    keys = F.array(*[F.struct(F.lit(d).alias("draw"), permuted(F.col("__rank"), n, seed + d).alias("to")) for d in range(draws)])
    asked = ranked.withColumn("__x", F.explode(keys)).withColumns({"draw": F.col("__x.draw"), "__to": F.col("__x.to")}).drop("__x", "__rank")
    partner = ranked.select(F.col("__rank").alias("__to"), *[F.col(c).alias(f"p_{c}") for c in features])
    return asked.join(partner, "__to").drop("__to")


def permutation_importance(
    model: BoostedModel, rows: DataFrame, features: list[str], label: str, order: list[str], draws: int = 5, seed: int = 42
) -> DataFrame:
    """Mean rise in log loss when one feature is shuffled, and its standard error over the draws; features at or
    below 0 do harm. Every feature gets its own copy of the rows, and all copies of all draws are scored in one pass; the
    rows as they are, which no draw changes, once."""
    df = shuffled_rows(rows, features, order, draws, seed)
    plain = F.struct(F.lit("").alias("shuffled"), *[F.col(c).alias(f"v_{c}") for c in features])
    variants = [F.when(F.col("draw") == 0, plain)]
    for f in features:
        cells = [F.col(f"p_{c}" if c == f else c).alias(f"v_{c}") for c in features]
        variants.append(F.struct(F.lit(f).alias("shuffled"), *cells))
    wide = df.withColumn("__x", F.explode(F.array_compact(F.array(*variants))))
    wide = wide.withColumns({"shuffled": F.col("__x.shuffled"), **{c: F.col(f"__x.v_{c}") for c in features}})
    # A few rows, one per draw and feature.
    losses = staged(raw_score(model, wide).groupBy("draw", "shuffled").agg(log_loss_of(F.col("raw_score"), F.col(label)).alias("loss")), "losses")
    base = losses.filter("shuffled = ''").agg(F.max("loss")).first()[0]
    rises = losses.filter("shuffled <> ''").withColumn("base", F.lit(base).cast("double"))
    out = rises.groupBy(F.col("shuffled").alias("feature")).agg(
        F.avg(F.col("loss") - F.col("base")).alias("importance"),
        (F.coalesce(F.stddev_samp(F.col("loss") - F.col("base")), F.lit(0.0)) / F.sqrt(F.count(F.lit(1)))).alias("standard_error"),
    )
    return out.withColumn("is_toxic", (F.col("importance") <= 0).cast("int"))


def linear_attribution(rows: DataFrame, features: list[str], label: str, id_column: str, seed_iter: int = 30):
    """Contributions of a logistic model and the largest gap between their sum and the raw score."""
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    model = LogisticRegression(labelCol=label, maxIter=seed_iter).fit(assembler.transform(rows))
    weights = dict(zip(features, [float(w) for w in model.coefficients]))
    means = rows.agg(*[F.avg(c).alias(c) for c in features]).first().asDict()
    contributions = linear_contributions(rows, weights, means, id_column)
    base = float(model.intercept) + sum(weights[c] * means[c] for c in features)
    raw = rows.withColumn("__raw", sum((F.col(c) * F.lit(w) for c, w in weights.items()), F.lit(float(model.intercept))))
    sums = contributions.groupBy(id_column).agg(F.sum("contribution").alias("__sum"))
    error = raw.join(sums, id_column).agg(F.max(F.abs(F.col("__sum") + base - F.col("__raw"))).alias("max_error"))
    return contributions, error


# --------------------------------------------------------------------------- daily call forecast


CALL_FEATURES = [
    "day_of_month", "is_billing_day", "is_holiday", "is_near_holiday", "days_since_billing_day", "days_until_billing_day",
    "num_core_txn_14d_ago", "num_casc_txn_14d_ago", "num_core_m0_14d_ago", "num_casc_m0_14d_ago", "rolling_avg_core_txn_3d",
    "rolling_avg_casc_txn_3d", "rolling_avg_core_m0_3d", "rolling_avg_casc_m0_3d", "calls_14d_ago", "rolling_avg_calls_3d",
    "rolling_avg_calls_7d", "rolling_avg_calls_30d", "dow_historical_ratio_14d", "historical_ratio_14d", "weekday", "month_number",
]


SERIES_EFFECT = "series_mean"


def call_features(df: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Day and month as numbers, missing numbers as -1, one vector."""
    df = df.withColumns({"weekday": F.weekday("date"), "month_number": F.month("date")})
    df = df.fillna(-1, CALL_FEATURES)
    return VectorAssembler(inputCols=[*CALL_FEATURES, *extra], outputCol="features").transform(df)


def series_effects(fit: DataFrame) -> Preprocessor:
    """Smoothed mean of the target ratio of every series (column ``series``), learned on ``fit``; its own rows get means
    that leave out their fold of days."""
    return fit_preprocessor(fit, FeatureRoles([], ["series"]), "target_ratio", min_count=1, fold_key="date")


def with_effects(rows: DataFrame, effects: Preprocessor | None, training: Column | None = None) -> DataFrame:
    """The feature vector; with many series also what the series does on average."""
    if effects is None:
        return call_features(rows)
    return call_features(effects.apply(rows, training), [SERIES_EFFECT])


def train_gbt_regressor(
    rows: DataFrame, label: str, weight: str | None = None, stop: str | None = None, boost: Boost = REGRESS, trees: int | None = None
) -> BoostedModel:
    """Boosted trees for the absolute error; with ``stop`` marked rows decide the number of trees, else it is given."""
    return boosting.model_of(boosting.boosted(rows, label, stop, boost, weight, boosting.ABSOLUTE, trees))


def daily_table(items_calls: DataFrame, items: DataFrame, ahead: int = 0, keys: list[str] = ()) -> DataFrame:
    return calls.ratio_target(calls.daily_feature_table(items_calls, items, ahead=ahead, keys=keys), keys=keys)


def walk_forward(clean: DataFrame, folds: int, test: int, val: int, boost: Boost = REGRESS, keys: list[str] = ()) -> tuple[DataFrame, int]:
    """Predictions of every fold's test days and the mean number of trees.

    Folds are cut by date, so all series of a day have one role, and one model per fold learns from all of them. The
    table is written once and each fold reads its part of it.
    """
    parts = staged(fold_roles(clean, ["date"], folds, test, val, by="date" if keys else None), "folds")
    trees, predictions = [], None
    for f in range(1, folds + 1):
        fold = parts.filter(F.col("fold") == f)
        seen = F.col("role") == "train"
        effects = series_effects(fold.filter(seen)) if keys else None
        ready = with_effects(fold, effects, seen)
        fit = ready.filter(F.col("role") != "test").withColumn("is_stop", F.col("role") == "val")
        model = train_gbt_regressor(fit, "target_ratio", "sample_weight", "is_stop", boost)
        trees.append(len(model.trees))
        out = model.transform(ready.filter("role = 'test'"), "prediction").select(
            "fold", *keys, "date", F.col("num_calls").alias("actual_calls"),
            calls.ratio_to_calls(F.col("prediction"), F.col("anchor_7d")).alias("predicted_calls"), F.lit(len(model.trees)).alias("trees"),
        )
        predictions = out if predictions is None else predictions.unionByName(out)
    return staged(predictions, "fold_predictions"), max(1, round(sum(trees) / len(trees)))


@dataclass
class CallForecast:
    folds: DataFrame
    fold_report: DataFrame
    holdout: DataFrame
    future: DataFrame
    trees: int


def series_name(keys: list[str]) -> Column:
    """One text per series; nulls are told apart from empty text."""
    return F.to_json(F.struct(*[F.col(k) for k in keys]), {"ignoreNullFields": "false"}) if keys else F.lit("all")


def daily_forecast(
    call_rows: DataFrame, items: DataFrame, horizon: int = 14, folds: int = 5, test: int = 60, val: int = 30,
    holdout: int = 5, boost: Boost = REGRESS, keys: list[str] = (),
) -> CallForecast:
    """Walk-forward report, hold-out check and forecast of the next days, for one series or for all series at once.

    The last ``holdout`` days of the calendar are kept out; the final model uses the mean number of trees of the folds.
    With ``keys`` one model is pooled over the series; what a series does on average enters as a cross-fitted ratio.
    The report has one row per fold (and series), forecasts one per day (and series).
    """
    keys = list(keys)
    table = staged(daily_table(call_rows, items, ahead=horizon, keys=keys).withColumn("series", series_name(keys)), "daily")
    future_rows = calls.after_the_data(table, call_rows, keys=keys)
    known = calls.clean_rows(table)
    clean = staged(linear_recency_weight(known, ["date"], by="date" if keys else None), "clean")
    days = prefix_scan(clean.select("date").distinct(), [], ["date"], {"from_end": position()}, reverse=True)
    marked = staged(clean.join(days, "date"), "marked")
    train = marked.filter(F.col("from_end") > holdout).drop("from_end")
    predictions, trees = walk_forward(train, folds, test, val, boost, keys)
    effects = series_effects(train) if keys else None
    final = train_gbt_regressor(with_effects(train, effects, F.lit(True)), "target_ratio", "sample_weight", boost=boost, trees=trees)

    def predict(rows):
        return final.transform(with_effects(rows, effects), "prediction").withColumn(
            "predicted_calls", calls.ratio_to_calls(F.col("prediction"), F.col("anchor_7d"))
        )

    held = predict(marked.filter(F.col("from_end") <= holdout)).select(*keys, "date", F.col("num_calls").alias("actual_calls"), "predicted_calls")
    ahead = future_rows.dropna(subset=["anchor_7d", "dow_historical_ratio_14d"])
    future = predict(ahead).select(*keys, "date", F.greatest(F.col("predicted_calls"), F.lit(0.0)).alias("predicted_calls"))
    report = regression_errors(predictions, "actual_calls", "predicted_calls", ["fold", *keys])
    return CallForecast(predictions, report, held, future, trees)
