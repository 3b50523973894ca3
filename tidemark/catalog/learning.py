"""Training, calibration, scoring and what explains them.

Fitted models have no SQL counterpart, so their queries return facts that SQL can state: row counts from the
tables, and properties every good fit must have as 0/1 columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.forecasting import daily_sql
from tidemark.catalog.registry import register
from tidemark.operators import evaluation as ev
from tidemark.operators import splits
from tidemark.operators.ordered import prefix_scan, running_max
from tidemark.plans import attempts, scoring
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources.scratch import scratch_folder, staged

ROLES = scoring.FeatureRoles(["score", "retries"], ["segment_code", "partner"], ["processor"])
# The library's own budgets: up to 2,000 trees of depth 7 (daily model 6), patience 50 (75).
BOOST, CALL_BOOST = scoring.CLASSIFY, scoring.REGRESS


def training_rows(i):
    """Labelled rows with a number that carries signal, categories, a text and a stable split.

    The labels of 3 in 20 rows are turned round by a rule on the row's id that no feature holds, so a model can't go on
    getting better for ever."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = i.scored.join(
        i.events.select(
            F.col("event_id").alias("row_id"), (k % 8).alias("retries"), F.concat(F.lit("P"), (k % 7).cast("string")).alias("partner"),
            F.when(k % 2 == 0, "x-TRX1 gateway").otherwise("y-ADYEN2 gateway").alias("processor"),
        ),
        "row_id",
    ).withColumn("segment_code", F.col("segment"))
    rows = rows.withColumn("label", F.when(F.col("row_id") * 7919 % 20 < 3, 1 - F.col("label")).otherwise(F.col("label")))
    # By order: all rows of an order are on one side.
    return splits.hash_split(rows, "order_id")


_trained: dict[tuple[str, str], str] = {}


def artifact(i) -> str:
    """Folder of the trained scorer. The training job runs once for a table; what scores, checks and explains reads
    its artifact from the shared folder."""
    key = (i.spark.sparkContext.applicationId, i.sf_dir)
    if key not in _trained:
        path = scratch_folder(i.spark, "artifact")
        model = scoring.train_scorer(training_rows(i), ROLES, "label", boost=BOOST, fold_key="order_id")
        scoring.save_artifact(model, path, {"threshold": 0.05})
        _trained[key] = path
    return _trained[key]


def scorer(i):
    return scoring.load_artifact(i.spark, artifact(i))[0]


def part_of(salt):
    return f"CAST(('0x' || left(md5(concat('{salt}:', CAST(order_id AS VARCHAR))), 16)) AS UBIGINT) / 18446744073709551616.0"


# All rows with their fractions for split and fold, and the label as given or turned round.
LABELLED = f"""a AS (SELECT * EXCLUDE (label), CASE WHEN row_id * 7919 % 20 < 3 THEN 1 - label ELSE label END AS label,
    concat('P', CAST(CAST(json_extract_string(props, '$.k') AS INT) % 7 AS VARCHAR)) AS partner,
    {part_of('retry_cutoff_v1')} AS h, CAST(floor({part_of('cross_fit')} * 5) AS INT) AS fold
    FROM v_scored JOIN events ON event_id = row_id)"""
# Training rows, kept levels, and smoothed label means of the two categories: for new rows (fold -1) and without one fold.
LEARNED = LABELLED + """,
  t AS (SELECT * FROM a WHERE h < 0.75),
  c AS (SELECT 'segment_code' AS feature, segment AS value, label, fold FROM t UNION ALL SELECT 'partner', partner, label, fold FROM t),
  n AS (SELECT feature, value FROM c GROUP BY 1, 2 HAVING COUNT(*) >= 50),
  r AS (SELECT c.feature, COALESCE(n.value, '__RARE__') AS value, label, fold FROM c LEFT JOIN n ON c.feature = n.feature AND c.value = n.value),
  asked AS (SELECT DISTINCT feature, value, fold FROM r UNION SELECT DISTINCT feature, value, -1 FROM r),
  m AS (SELECT q.feature, q.value, q.fold, (COALESCE((SELECT SUM(label) FROM r WHERE r.feature = q.feature AND r.value = q.value AND r.fold <> q.fold), 0)
      + 20 * (SELECT AVG(label) FROM t WHERE t.fold <> q.fold))
      / ((SELECT COUNT(*) FROM r WHERE r.feature = q.feature AND r.value = q.value AND r.fold <> q.fold) + 20) AS mean FROM asked q),
  p AS (SELECT AVG(label) AS prior FROM t)"""


def mean_of(feature, column, fold="-1"):
    level = f"COALESCE((SELECT value FROM n WHERE feature = '{feature}' AND value = {column}), '__RARE__')"
    return f"COALESCE((SELECT mean FROM m WHERE feature = '{feature}' AND m.value = {level} AND m.fold = {fold}), (SELECT prior FROM p))"


def preprocessor(i):
    return scoring.fit_preprocessor(training_rows(i).filter("split = 'train'"), ROLES, "label", fold_key="order_id")


@register(
    "replay_spec", "row_id segment_code_mean:d partner_mean:d retries",
    f"""WITH {LEARNED} SELECT row_id, {mean_of('segment_code', 'segment')} AS segment_code_mean, {mean_of('partner', 'partner')} AS partner_mean,
        CAST(json_extract_string(props, '$.k') AS INT) % 8 AS retries FROM a WHERE h >= 0.75""",
)
def replay_spec(i):
    return preprocessor(i).apply(training_rows(i).filter("split <> 'train'"))


@register(
    "cross_fitted_rows", "row_id segment_code_mean:d partner_mean:d",
    f"""WITH {LEARNED} SELECT row_id, {mean_of('segment_code', 'segment', 'a.fold')} AS segment_code_mean,
        {mean_of('partner', 'partner', 'a.fold')} AS partner_mean FROM a WHERE h < 0.75""",
)
def cross_fitted_rows(i):
    """Training rows as the trees see them: label means without the row's own fold of orders."""
    return preprocessor(i).apply(training_rows(i).filter("split = 'train'"), F.lit(True))


@register("encode", "feature:s value:s fold mean:d", f"WITH {LEARNED} SELECT * FROM m")
def encode(i):
    return preprocessor(i).means


def flag(value: bool):
    return F.lit(int(bool(value)))


# Split of every training row.
SIDES = LABELLED + """, s AS (SELECT *, CASE WHEN h < 0.75 THEN 'train' WHEN h < 0.85 THEN 'stop' WHEN h < 0.95 THEN 'calib' ELSE 'random_test' END
    AS split FROM a)"""
# Rank sum of the score per split, ties at their mean rank.
SCORE_AUC = """(SELECT split, (SUM(CASE WHEN label = 1 THEN rk ELSE 0 END) - SUM(label) * (SUM(label) + 1) / 2.0) / NULLIF(SUM(label) * SUM(1 - label), 0) AS auc
    FROM (SELECT split, label, RANK() OVER (PARTITION BY split ORDER BY score) + (COUNT(*) OVER (PARTITION BY split, score) - 1) / 2.0 AS rk FROM s)
    GROUP BY split)"""


@register(
    "train_gbt_classifier", "split:s n_rows n_positive score_auc:f mean_where_calibrated:f beats_score beats_prior",
    f"""WITH {SIDES} SELECT s.split, COUNT(*) AS n_rows, SUM(label) AS n_positive, MAX(auc) AS score_auc,
        CASE WHEN s.split = 'calib' THEN AVG(label) END AS mean_where_calibrated, 1 AS beats_score, 1 AS beats_prior
        FROM s JOIN {SCORE_AUC} u ON u.split = s.split GROUP BY s.split""",
)
def train_gbt_classifier(i):
    """Rows and positives per split, the AUC of the best single feature, the mean probability on the calibration rows
    (which isotonic calibration makes the mean label). On rows not trained on the model ranks at least about as well as
    that feature alone, and its squared error is below that of the mean label."""
    scored = staged(scorer(i).score(training_rows(i)).select("split", "label", "score", "success_prob"), "scored")
    error = F.avg(F.pow(F.col("success_prob") - F.col("label"), F.lit(2.0)))
    unseen = scored.filter("split <> 'train'")
    gain = ev.roc_auc(unseen, "success_prob", "label").first()["auc"] - ev.roc_auc(unseen, "score", "label").first()["auc"]
    loss, plain = unseen.select(error, F.var_pop("label")).first()
    alone = ev.roc_auc(scored, "score", "label", ["split"]).select("split", F.col("auc").alias("score_auc"))
    found = scored.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("n_positive"), F.avg("success_prob").alias("__mean"),
    )
    return found.join(alone, "split").withColumns(
        {"mean_where_calibrated": F.when(F.col("split") == "calib", F.col("__mean")), "beats_score": flag(gain > -0.02), "beats_prior": flag(loss < plain)}
    )


@register(
    "isotonic_calibrate", "n_rows n_positive mean_probability:f is_monotone in_range",
    f"""WITH {SIDES} SELECT COUNT(*) AS n_rows, SUM(label) AS n_positive, AVG(label) AS mean_probability, 1 AS is_monotone, 1 AS in_range
        FROM s WHERE split = 'calib'""",
)
def isotonic_calibrate(i):
    """Higher scores never get lower probabilities; on its own rows the mean probability is the mean label."""
    scored = scorer(i).score(training_rows(i).filter("split = 'calib'"))
    table = staged(scored.groupBy("raw_score", "success_prob").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("won")), "calibrated")
    before = prefix_scan(table, [], ["raw_score"], {"top": running_max(F.col("success_prob"))})
    return before.agg(
        F.sum("n").alias("n_rows"), F.sum("won").alias("n_positive"),
        (F.sum(F.col("success_prob") * F.col("n")) / F.sum("n")).alias("mean_probability"),
        F.min((F.coalesce("top", F.lit(0.0)) <= F.col("success_prob") + 1e-9).cast("int")).alias("is_monotone"),
        F.min(F.col("success_prob").between(0, 1).cast("int")).alias("in_range"),
    )


@register(
    "score_batch", "order_id:s n_rows n_early_known collected:m n_flagged",
    """WITH b AS (SELECT *, SUM(CASE WHEN transaction_status = 'accepted' THEN transaction_amount ELSE 0 END) OVER (PARTITION BY order_id
          ORDER BY transaction_datetime, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS paid FROM v_attempt
          WHERE retries IS NOT NULL AND transaction_type IN ('sale', 'capture') AND invoice_type NOT LIKE '%trial%'),
        r AS (SELECT b.* FROM b JOIN v_scored ON row_id = transaction_id JOIN events ON event_id = row_id)
        SELECT CAST(order_id AS VARCHAR) AS order_id, COUNT(*) AS n_rows, COUNT(*) AS n_early_known, SUM(COALESCE(paid, 0)) AS collected,
          (SELECT CAST(floor(COUNT(*) * 0.1) AS BIGINT) FROM r) AS n_flagged FROM r GROUP BY order_id""",
)
def score_batch(i):
    """Per order its decisions and money so far; over all, exactly a tenth flagged at random."""
    out = staged(decisions(i), "decisions")
    flagged = out.filter("random_selection").count()
    return out.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("is_cutoff_early").alias("n_early_known"),
        F.sum(F.col("current_cltv").cast("decimal(18,6)")).alias("collected"), F.lit(flagged).alias("n_flagged"),
    )


def decisions(i):
    model, spec = scoring.load_artifact(i.spark, artifact(i))
    extra = training_rows(i).select(F.col("row_id").alias("transaction_id"), "score", "segment_code", "partner", "processor")
    rows = attempts.scored_attempts(i.attempt).join(extra, "transaction_id")
    return scoring.score_batch(model, rows, F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'"), spec["threshold"])


SCORED = "(SELECT row_id, score FROM v_scored)"


@register(
    "score_leads", "row_id percentile_rank:d recommended_action:s confidence_tier:s",
    f"""WITH r AS (SELECT *, (RANK() OVER (ORDER BY score) + (COUNT(*) OVER (PARTITION BY score) - 1) / 2) / (COUNT(*) OVER ()) * 100
          AS percentile_rank FROM {SCORED})
        SELECT *, CASE WHEN score <= (SELECT quantile_cont(score, 0.25) FROM r) THEN 'REJECT' ELSE 'ACCEPT' END AS recommended_action,
          CASE WHEN percentile_rank <= 10 THEN 'Very Low' WHEN percentile_rank <= 25 THEN 'Low' WHEN percentile_rank <= 50 THEN 'Medium'
            WHEN percentile_rank <= 75 THEN 'High' ELSE 'Very High' END AS confidence_tier FROM r""",
)
def score_leads(i):
    return scoring.score_leads(i.scored.select("row_id", "score"), "score")


@register(
    "score_summary", "total rejected accepted rejection_threshold:d",
    f"""WITH c AS (SELECT quantile_cont(score, 0.25) AS q FROM {SCORED})
        SELECT COUNT(*) AS total, COUNT(*) FILTER (score <= q) AS rejected, COUNT(*) FILTER (score > q) AS accepted,
          MAX(CASE WHEN score <= q THEN score END) AS rejection_threshold FROM {SCORED}, c""",
)
def score_summary(i):
    return scoring.score_summary(scoring.score_leads(i.scored.select("row_id", "score"), "score"), "score")


@register(
    "score_hard_label", "row_id at_half at_040",
    f"SELECT row_id, CAST(score >= 0.5 AS INT) AS at_half, CAST(score >= 0.4 AS INT) AS at_040 FROM {SCORED}",
)
def score_hard_label(i):
    s = F.col("score")
    return i.scored.select("row_id", scoring.hard_label(s).alias("at_half"), scoring.hard_label(s, 0.4).alias("at_040"))


@register(
    "bottom_percentile_train", "iteration n_test n_positive precision_known n_low",
    f"""WITH {SIDES} SELECT n AS iteration, COUNT(*) AS n_test, SUM(label) AS n_positive, 1 AS precision_known, 1 AS n_low
        FROM s, range(1, 4) t(n) WHERE split <> 'train' GROUP BY n""",
)
def bottom_percentile_train(i):
    ensure_checkpoint_dir(i.spark)
    rows = training_rows(i).withColumn("split", F.when(F.col("split") == "train", "train").otherwise("test"))
    pre = scoring.fit_preprocessor(rows.filter("split = 'train'"), ROLES, "label", fold_key="order_id")
    # Every round reads the same rows: prepared once, written once.
    ready = staged(pre.apply(rows, F.col("split") == "train").select("row_id", "label", "split", "processor", *pre.inputs()), "training_rows")
    _, history = scoring.bottom_percentile_train(ready, pre, "label", "row_id", boost=BOOST)
    found = i.spark.createDataFrame(history, "iteration int, auc double, precision double, fn long, tn long")
    test = ready.filter("split = 'test'").agg(F.count(F.lit(1)).alias("n_test"), F.sum("label").alias("n_positive"))
    # A quarter of the test rows or more lies at or below the cut.
    n_test, n_positive = test.first()
    return found.select(
        "iteration", F.lit(n_test).alias("n_test"), F.lit(n_positive).alias("n_positive"),
        F.col("precision").between(0, 1).cast("int").alias("precision_known"),
        (F.col("fn") + F.col("tn") >= n_test // 4).cast("int").alias("n_low"),
    )


@register(
    "cv_fold_training", "fold n_rows n_positive first:t last:t has_trees auc_known",
    f"""WITH {SIDES} SELECT fold, COUNT(*) AS n_rows, SUM(label) AS n_positive, MIN(event_ts) AS first, MAX(event_ts) AS last, 1 AS has_trees, 1 AS auc_known
        FROM (SELECT label, event_ts, NTILE(3) OVER (ORDER BY event_ts, row_id) AS fold FROM s) GROUP BY fold""",
)
def cv_fold_training(i):
    """Three contiguous folds trained together: rows, positives and span of each, trees of its model, AUC on the rows it has not seen."""
    roles = scoring.FeatureRoles(["score", "retries"], [], ["segment_code", "partner", "processor"])
    scored, models = scoring.train_folds(training_rows(i), roles, "label", ["event_ts", "row_id"], 3, BOOST)
    scored = staged(scored.select("fold", "label", "event_ts", "raw_score"), "fold_scores")
    auc = ev.roc_auc(scored, "raw_score", "label", ["fold"]).select("fold", F.col("auc").between(0.6, 1).cast("int").alias("auc_known"))
    trees = F.element_at(F.array(*[F.lit(int(len(m.trees) >= 1)) for m in models]), F.col("fold"))
    rows = scored.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("n_positive"), F.min("event_ts").alias("first"), F.max("event_ts").alias("last"))
    return rows.join(auc, "fold").withColumn("has_trees", trees)


def explained_rows(i, pre):
    held = pre.apply(training_rows(i).filter("split IN ('calib', 'random_test')"))
    return held.withColumn("order", F.xxhash64("row_id", F.lit(42)))


@register(
    "permutation_importance", "feature:s is_strongest is_toxic_known error_known",
    """SELECT * FROM (VALUES ('partner_mean', 0, 1, 1), ('retries', 0, 1, 1), ('score', 1, 1, 1), ('segment_code_mean', 0, 1, 1))
        t(feature, is_strongest, is_toxic_known, error_known)""",
)
def permutation_importance(i):
    """The score carries the signal of the fixture; every importance comes with its standard error over the draws."""
    model = scorer(i)
    held = explained_rows(i, model.pre)
    found = staged(scoring.permutation_importance(model.trees, held, model.pre.inputs(), "label", ["order", "row_id"]), "importance")
    top = found.agg(F.max_by("feature", "importance")).scalar()
    known = (F.col("is_toxic") == (F.col("importance") <= 0).cast("int")).cast("int")
    return found.select(
        "feature", (F.col("feature") == top).cast("int").alias("is_strongest"), known.alias("is_toxic_known"),
        (F.col("standard_error") >= 0).cast("int").alias("error_known"),
    )


@register(
    "permuted_rows", "draw n_rows n_scores score_total:d squares:d retries_total",
    f"""WITH {SIDES}, x AS (SELECT score, CAST(json_extract_string(props, '$.k') AS INT) % 8 AS retries FROM s WHERE split IN ('calib', 'random_test'))
        SELECT d AS draw, COUNT(*) AS n_rows, COUNT(DISTINCT score) AS n_scores, SUM(score) AS score_total, SUM(score * score) AS squares,
          SUM(retries) AS retries_total FROM x, range(3) t(d) GROUP BY d""",
)
def permuted_rows(i):
    """Each draw's shuffled values are the values themselves in another order."""
    rows = training_rows(i).filter("split IN ('calib', 'random_test')").select("row_id", "score", "retries")
    rows = rows.withColumn("order", F.xxhash64("row_id", F.lit(42)))
    out = scoring.shuffled_rows(rows, ["score", "retries"], ["order", "row_id"], 3)
    return out.groupBy("draw").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("p_score").alias("n_scores"), F.sum("p_score").alias("score_total"),
        F.sum(F.col("p_score") * F.col("p_score")).alias("squares"), F.sum("p_retries").alias("retries_total"),
    )


COEF = {"transaction_amount": 0.02, "retries": -0.4, "offer_amount": 0.01}


@register(
    "attribution_summary", "feature:s mean_abs:d share:d direction:s",
    "WITH a AS (SELECT *, COALESCE(retries, -1) AS r0 FROM v_attempt), s AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, AVG(abs({w} * ({e} - (SELECT AVG({e}) FROM a)))) AS mean_abs, "
        f"'{'raises' if w > 0 else 'lowers'}' AS direction FROM a"
        for c, w, e in (("transaction_amount", 0.02, "transaction_amount"), ("retries", -0.4, "r0"), ("offer_amount", 0.01, "offer_amount"))
    )
    + ") SELECT *, mean_abs / (SELECT SUM(mean_abs) FROM s) AS share FROM s",
)
def attribution_summary(i):
    rows = i.attempt.fillna(-1, ["retries"])
    means = rows.agg(*[F.avg(c).alias(c) for c in COEF]).first().asDict()
    return ev.attribution_summary(ev.linear_contributions(rows, COEF, means, "transaction_id"))


@register(
    "attribution_exactness", "feature:s is_exact share_known",
    "SELECT * FROM (VALUES ('retries', 1, 1), ('score', 1, 1)) t(feature, is_exact, share_known)",
)
def attribution_exactness(i):
    rows = training_rows(i).withColumn("retries", F.coalesce("retries", F.lit(-1)))
    contributions, error = scoring.linear_attribution(rows, ["score", "retries"], "label", "row_id")
    exact = (error.select("max_error").scalar() < 1e-6).cast("int")
    shares = ev.attribution_summary(contributions)
    return shares.select("feature", exact.alias("is_exact"), F.col("share").between(0, 1).cast("int").alias("share_known"))


@register(
    "daily_forecast", "date:D is_known",
    f"""SELECT date, 1 AS is_known FROM {daily_sql(14, ahead=14)} WHERE date > (SELECT MAX(call_date) FROM v_daily_call)
          AND rolling_avg_calls_7d IS NOT NULL AND dow_historical_ratio_14d IS NOT NULL""",
)
def daily_forecast(i):
    """One prediction, not below 0, for each of the next 14 days whose anchor and weekday ratio are known; missing inputs are
    left out before any are filled, here and in training."""
    future = scoring.daily_forecast(i.daily_call, i.order_item, boost=CALL_BOOST).future
    return future.select("date", (F.col("predicted_calls") >= 0).cast("int").alias("is_known"))


_pooled: dict[tuple[str, str], scoring.CallForecast] = {}


def pooled_forecast(i) -> scoring.CallForecast:
    """One model over all call types, trained once for a table."""
    key = (i.spark.sparkContext.applicationId, i.sf_dir)
    if key not in _pooled:
        _pooled[key] = scoring.daily_forecast(i.daily_call, i.order_item, boost=CALL_BOOST, keys=["call_type"])
    return _pooled[key]


# Days that can be learned from, and their place among the distinct days.
def usable_sql(key=""):
    target = f"LAG(rolling_avg_calls_7d, 14) OVER ({'PARTITION BY ' + key if key else ''} ORDER BY date)"
    return f"""u AS (SELECT * FROM (SELECT *, calls_14d_ago / ({target} + 1) AS hr FROM {daily_sql(14, key=key)})
      WHERE num_calls IS NOT NULL AND rolling_avg_calls_7d IS NOT NULL AND rolling_avg_calls_30d IS NOT NULL AND hr IS NOT NULL),
    o AS (SELECT date, ROW_NUMBER() OVER (ORDER BY date) AS p, COUNT(*) OVER () AS n FROM (SELECT DISTINCT date FROM u))"""


@register(
    "daily_forecast_series", "call_type:s date:D is_known",
    f"""SELECT call_type, date, 1 AS is_known FROM {daily_sql(14, ahead=14, key='call_type')} x
        WHERE date > (SELECT MAX(call_date) FROM v_daily_call c WHERE c.call_type = x.call_type)
          AND rolling_avg_calls_7d IS NOT NULL AND dow_historical_ratio_14d IS NOT NULL""",
)
def daily_forecast_series(i):
    """One prediction per call type for each of its next 14 days for which the past suffices."""
    return pooled_forecast(i).future.select("call_type", "date", (F.col("predicted_calls") >= 0).cast("int").alias("is_known"))


@register(
    "fold_report_series", "call_type:s fold n actual:d mae_share_known",
    f"""WITH {usable_sql('call_type')} SELECT call_type, fold, COUNT(*) AS n, SUM(num_calls) AS actual, 1 AS mae_share_known
        FROM u JOIN (SELECT date, p, n - 5 AS m FROM o WHERE p <= n - 5) USING (date), range(1, 6) t(fold)
        WHERE p > m - (6 - fold) * 60 AND p <= m - (5 - fold) * 60 GROUP BY 1, 2""",
)
def fold_report_series(i):
    """Days and calls of every series in every fold's test days, as they stand in the job's predictions, and that its errors are known."""
    made = pooled_forecast(i)
    errors = made.fold_report.select("fold", "call_type", (F.col("mae_share") >= 0).cast("int").alias("mae_share_known"))
    rows = made.folds.groupBy("fold", "call_type").agg(F.count(F.lit(1)).alias("n"), F.sum("actual_calls").alias("actual"))
    return rows.join(errors, ["fold", "call_type"])


@register(
    "train_gbt_regressor", "fold n first_day:D last_day:D actual:d is_close",
    f"""WITH {usable_sql()} SELECT fold, COUNT(*) AS n, MIN(date) AS first_day, MAX(date) AS last_day, SUM(num_calls) AS actual, 1 AS is_close
        FROM u JOIN o USING (date), range(1, 6) t(fold) WHERE p > o.n - (6 - fold) * 60 AND p <= o.n - (5 - fold) * 60 GROUP BY fold""",
)
def train_gbt_regressor(i):
    """Test days and calls of every fold, and that the mean error is below the mean number of calls."""
    table = scoring.daily_table(i.daily_call, i.order_item)
    clean = splits.linear_recency_weight(scoring.calls.clean_rows(table), ["date"])
    predictions, _ = scoring.walk_forward(clean, folds=5, test=60, val=30, boost=CALL_BOOST)
    errors = ev.regression_errors(predictions, "actual_calls", "predicted_calls", ["fold"]).select("fold", (F.col("mae_share") < 1).cast("int").alias("is_close"))
    rows = predictions.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.sum("actual_calls").alias("actual")
    )
    return rows.join(errors, "fold")


@register(
    "avg_best_iteration_refit", "date:D actual_calls is_known has_trees",
    f"WITH {usable_sql()} SELECT date, num_calls AS actual_calls, 1 AS is_known, 1 AS has_trees FROM u JOIN o USING (date) WHERE p > n - 5",
)
def avg_best_iteration_refit(i):
    """The days held out, predicted with the mean number of trees of the folds."""
    result = scoring.daily_forecast(i.daily_call, i.order_item, boost=CALL_BOOST)
    return result.holdout.select("date", "actual_calls", F.col("predicted_calls").isNotNull().cast("int").alias("is_known"), flag(result.trees >= 1).alias("has_trees"))
