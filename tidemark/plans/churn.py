"""Churn queries: snapshots a week after signup, labels of the week after."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import probability
from ..operators import churn as op
from . import inputs
from .inputs import sql

LOOKBACK, LABEL, START, END, AS_OF = 7, 1, "2024-01-09 00:00:00", "2024-01-30 00:00:00", "1998-01-01 00:00:00"
NAMES, FAILURES, LEVELS, CAPACITY = ["signup", "error", "click", "view", "purchase"], ["error"], [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8], [0.1, 0.2, 0.3]


def points(spark, sf):
    return op.snapshots(inputs.users(spark, sf).select("user_id", "signup_ts", "persona"), LOOKBACK, LABEL, START, END)


def features(spark, sf):
    return op.features(points(spark, sf), inputs.events(spark, sf), NAMES, FAILURES)


def labels(spark, sf):
    return op.labels(points(spark, sf), inputs.events(spark, sf), FAILURES, "purchase")


def scored(spark, sf):
    """A fixed score of the features, as a stand-in for a model's."""
    score = probability(F.lit(0.9) - F.col("n_events") / 20.0 + F.col("failure_share") / 4.0 + F.col("longest_gap") / 25.0)
    return features(spark, sf).withColumn("score", score).join(labels(spark, sf).select("user_id", "churned"), "user_id").select("user_id", "persona", "score", "churned")


def asof_subscription(spark, sf):
    rows = inputs.subscriptions(spark, sf).select("user_id").distinct().withColumn("at", op.ts(AS_OF))
    return op.as_of(rows, inputs.subscriptions(spark, sf), "at", "plan", "subscription_id").select("user_id", "plan")


def churn_subgroups(spark, sf):
    return scored(spark, sf).groupBy("persona").agg(F.count("*").alias("n"), F.sum("churned").alias("positives"), F.bround(F.avg("score"), 6).alias("mean_score"))


_P = f"""SELECT user_id, signup_ts, persona, w AS snapshot_ts, w - INTERVAL {LOOKBACK} DAY AS feature_start, w + INTERVAL {LABEL} DAY AS label_end FROM (SELECT *, greatest(signup_ts + INTERVAL {LOOKBACK} DAY, TIMESTAMP '{START}') AS w FROM u)
    WHERE w + INTERVAL {LABEL} DAY <= TIMESTAMP '{END}'"""
_N = "SELECT e.*, coalesce(date_diff('day', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts), 0) AS gap, snapshot_ts FROM e JOIN p USING (user_id) WHERE ts BETWEEN feature_start AND snapshot_ts"
_F = """SELECT user_id, signup_ts, persona, p.snapshot_ts, feature_start, label_end, count(n.ts) AS n_events, count(DISTINCT CAST(n.ts AS DATE)) AS active_days, coalesce(max(gap), 0) AS longest_gap, count(*) FILTER (gap > 7) AS resurrections,
    count(DISTINCT k) AS n_features, coalesce(round_even(sum(value), 2), 0) AS value, """ + ", ".join(f"count(*) FILTER (event_name = '{x}') AS n_{x}" for x in NAMES) + """,
    coalesce(floor(date_sub('second', max(n.ts) FILTER (event_name <> 'error'), p.snapshot_ts) / 86400)::BIGINT, 999) AS days_since_activity, coalesce(round_even(count(*) FILTER (event_name = 'error') / nullif(count(n.ts), 0), 6), 0) AS failure_share,
    coalesce(round_even(count(n.ts) / nullif(count(DISTINCT CAST(n.ts AS DATE)), 0), 6), 0) AS events_per_day FROM p LEFT JOIN n USING (user_id) GROUP BY user_id, signup_ts, persona, p.snapshot_ts, feature_start, label_end"""
_L = """SELECT user_id, p.snapshot_ts, count(*) FILTER (event_name <> 'error') AS later_events, coalesce(bool_or(event_name = 'purchase'), false) AS cancelled, (count(*) FILTER (event_name <> 'error') = 0)::INT AS churned
    FROM p LEFT JOIN (SELECT user_id, event_name FROM e JOIN p USING (user_id) WHERE ts > snapshot_ts AND ts <= label_end) q USING (user_id) GROUP BY user_id, p.snapshot_ts"""
_S = "SELECT user_id, persona, round_even(least(greatest(0.9::DOUBLE - n_events / 20.0::DOUBLE + failure_share / 4.0::DOUBLE + longest_gap / 25.0::DOUBLE, 0), 1), 4) AS score, churned FROM f JOIN l USING (user_id)"
_ALL = {"p": _P, "n": _N, "f": _F, "l": _L, "sc": _S}


def _over(body: str) -> str:
    return sql(body, "e", "u", **_ALL)


LATER = "1998-07-01 00:00:00"
_NAMED = "SELECT user_id, arg_max(CASE plan WHEN 1 THEN 'free' WHEN 2 THEN 'pro' WHEN 3 THEN 'team' WHEN 4 THEN 'business' ELSE 'enterprise' END, (start_ts, subscription_id)) AS plan, arg_max(CASE plan WHEN 2 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 4 ELSE 0 END, (start_ts, subscription_id)) AS r FROM b WHERE start_ts <= TIMESTAMP '{0}' AND (end_ts IS NULL OR end_ts >= TIMESTAMP '{0}') GROUP BY user_id"


def plan_names(spark, sf):
    return inputs.subscriptions(spark, sf).withColumn("plan", F.element_at(F.array(*map(F.lit, ("free", "pro", "team", "business", "enterprise"))), F.col("plan")))


def plan_points(spark, sf):
    return inputs.subscriptions(spark, sf).select("user_id").distinct().withColumn("snapshot_ts", op.ts(AS_OF)).withColumn("label_end", op.ts(LATER))


QUERIES = {
    "asof_subscription": (asof_subscription, sql(f"SELECT user_id, plan FROM (SELECT DISTINCT user_id FROM b) LEFT JOIN (SELECT user_id, arg_max(plan, (start_ts, subscription_id)) AS plan FROM b WHERE start_ts <= TIMESTAMP '{AS_OF}' AND (end_ts IS NULL OR end_ts >= TIMESTAMP '{AS_OF}') GROUP BY user_id) USING (user_id)", "b")),
    "churn_features": (features, _over("SELECT * FROM f")),
    "churn_labels": (labels, _over("SELECT * FROM l")),
    "churn_splits": (lambda spark, sf: op.splits(points(spark, sf)).select("user_id", "split"), _over("""SELECT user_id, CASE WHEN r < greatest(floor(n * 0.6), 1) THEN 'train' WHEN r < greatest(floor(n * 0.8), 2) THEN 'validation' ELSE 'test' END AS split
        FROM (SELECT user_id, row_number() OVER (ORDER BY snapshot_ts, user_id) - 1 AS r, count(*) OVER () AS n FROM p)""")),
    "churn_scores": (scored, _over("SELECT * FROM sc")),
    "churn_threshold_table": (lambda spark, sf: op.thresholds(scored(spark, sf), LEVELS), _over(f"""SELECT threshold, tp, fp, fn, tn, coalesce(round_even(tp / nullif(tp + fp, 0), 6), 0) AS precision, coalesce(round_even(tp / nullif(tp + fn, 0), 6), 0) AS recall,
        coalesce(round_even(2 * tp / nullif(2 * tp + fp + fn, 0), 6), 0) AS f1 FROM (SELECT threshold, count(*) FILTER (score >= threshold AND churned = 1) AS tp, count(*) FILTER (score >= threshold AND churned = 0) AS fp,
        count(*) FILTER (score < threshold AND churned = 1) AS fn, count(*) FILTER (score < threshold AND churned = 0) AS tn FROM sc, (SELECT unnest({LEVELS}::DOUBLE[]) AS threshold) GROUP BY ALL)""")),
    "churn_capacity": (lambda spark, sf: op.capacity(scored(spark, sf), CAPACITY), _over(f"""SELECT capacity, cutoff, count(*) FILTER (score >= cutoff) AS flagged, sum(churned) FILTER (score >= cutoff)::BIGINT AS true_positives FROM sc,
        (SELECT capacity, (SELECT (list(score ORDER BY score DESC))[greatest(1, ceil(count(*) * capacity))::INT] FROM sc) AS cutoff FROM (SELECT unnest({CAPACITY}::DOUBLE[]) AS capacity)) GROUP BY ALL""")),
    "churn_calibration": (lambda spark, sf: op.calibration(scored(spark, sf)), _over("""SELECT bin::INT AS bin, bin / 4 AS lower, (bin + 1) / 4 AS upper, count(score) AS n, coalesce(round_even(avg(score), 6), 0) AS mean_score, coalesce(round_even(avg(churned), 6), 0) AS observed_rate
        FROM (SELECT unnest(range(4)) AS bin) LEFT JOIN sc ON least(floor(score * 4), 3) = bin GROUP BY ALL""")),
    "churn_eval_metrics": (lambda spark, sf: op.evaluation(scored(spark, sf), 0.5), _over("""SELECT count(*) AS n, round_even(avg(churned), 6) AS prevalence, round_even(avg(((score >= 0.5)::INT = churned)::INT), 6) AS accuracy, round_even(avg((score - churned) * (score - churned)), 6) AS brier,
        round_even(avg(-churned * ln(least(greatest(score, 1e-6), 1 - 1e-6)) - (1 - churned) * ln(1 - least(greatest(score, 1e-6), 1 - 1e-6))), 6) AS log_loss,
        (SELECT round_even(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END), 6) FROM sc a, sc b WHERE a.churned = 1 AND b.churned = 0) AS roc_auc,
        (SELECT round_even(avg((SELECT sum(b.churned) / count(*) FROM sc b WHERE b.score >= a.score)), 6) FROM sc a WHERE a.churned = 1) AS average_precision FROM sc""")),
    "churn_subgroups": (churn_subgroups, _over("SELECT persona, count(*) AS n, sum(churned)::BIGINT AS positives, round_even(avg(score), 6) AS mean_score FROM sc GROUP BY ALL")),
    "churn_risk_bands": (lambda spark, sf: scored(spark, sf).groupBy(op.risk_band(F.col("score")).alias("band")).agg(F.count("*").alias("n")), _over("SELECT CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM sc GROUP BY ALL")),
    "churn_confusion": (lambda spark, sf: op.confusion(scored(spark, sf), 0.5), _over("""SELECT tp, fp, fn, tn, coalesce(round_even(tp / nullif(tp + fp, 0), 6), 0) AS precision, coalesce(round_even(tp / nullif(tp + fn, 0), 6), 0) AS recall, coalesce(round_even(2 * tp / nullif(2 * tp + fp + fn, 0), 6), 0) AS f1,
        round_even((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy FROM (SELECT count(*) FILTER (score >= 0.5 AND churned = 1) AS tp, count(*) FILTER (score >= 0.5 AND churned = 0) AS fp, count(*) FILTER (score < 0.5 AND churned = 1) AS fn, count(*) FILTER (score < 0.5 AND churned = 0) AS tn FROM sc)""")),
    "churn_threshold_choice": (lambda spark, sf: op.best_threshold(op.thresholds(scored(spark, sf), LEVELS)), _over(f"""SELECT threshold, f1 FROM (SELECT threshold, coalesce(round_even(2 * count(*) FILTER (score >= threshold AND churned = 1) / nullif(2 * count(*) FILTER (score >= threshold AND churned = 1) + count(*) FILTER ((score >= threshold) <> (churned = 1)), 0), 6), 0) AS f1
        FROM sc, (SELECT unnest({LEVELS}::DOUBLE[]) AS threshold) GROUP BY threshold) ORDER BY f1 DESC, threshold DESC LIMIT 1""")),
    "churn_prefix_counts": (lambda spark, sf: op.prefix_counts(inputs.events(spark, sf).withColumnRenamed("k", "feature"), inputs.usage(spark, sf), ["1", "2", "9"], "feature", "usage_count"), sql(
        "SELECT user_id, " + ", ".join(f"coalesce(sum(n) FILTER (f LIKE '{p}%'), 0)::BIGINT AS n_{p}" for p in "129") + " FROM (SELECT user_id, k::VARCHAR AS f, 1 AS n FROM e UNION ALL SELECT user_id, feature::VARCHAR, usage_count FROM g) GROUP BY ALL", "e", "g")),
    "churn_activation_stage": (lambda spark, sf: features(spark, sf).select("user_id", op.stage_reached([(4, ["n_purchase"]), (3, ["n_click", "n_error"]), (1, ["n_view"])]).alias("stage")), _over("SELECT user_id, CASE WHEN n_purchase > 0 THEN 4 WHEN n_click > 0 OR n_error > 0 THEN 3 WHEN n_view > 0 THEN 1 ELSE 0 END AS stage FROM f")),
    "churn_downgrades": (lambda spark, sf: op.downgrades(plan_points(spark, sf), plan_names(spark, sf), op.CHURN_RANKS), sql(f"""SELECT user_id, a.plan AS plan_before, z.plan AS plan_after, coalesce(z.r < a.r, false) AS downgraded FROM (SELECT DISTINCT user_id FROM b) LEFT JOIN ({_NAMED.format(AS_OF)}) a USING (user_id) LEFT JOIN ({_NAMED.format(LATER)}) z USING (user_id)""", "b")),
    "churn_plan_ranks": (lambda spark, sf: plan_names(spark, sf).select("subscription_id", op.plan_rank(F.col("plan"), op.CHURN_RANKS).alias("churn_rank"), op.plan_rank(F.col("plan"), op.SEGMENT_RANKS).alias("segment_rank")), sql("SELECT subscription_id, CASE plan WHEN 2 THEN 2 WHEN 3 THEN 0 WHEN 4 THEN 3 WHEN 5 THEN 4 ELSE 0 END AS churn_rank, CASE plan WHEN 2 THEN 0 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 4 ELSE 0 END AS segment_rank FROM b", "b")),
    "churn_importance": (lambda spark, sf: op.score_importance(features(spark, sf).join(scored(spark, sf).select("user_id", "score"), "user_id"), ["n_events", "active_days", "longest_gap"]), _over(" UNION ALL ".join(f"SELECT '{c}' AS feature, round_even(corr({c}, score), 6) AS correlation, abs(round_even(corr({c}, score), 6)) AS importance FROM f JOIN sc USING (user_id)" for c in ("n_events", "active_days", "longest_gap")))),
}
