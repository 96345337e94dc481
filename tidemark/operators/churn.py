"""Point-in-time snapshots: features up to a moment, labels after it, and the measures of a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import days_floor, rate, safe_div

NEVER = 999  # days since the last activity of who had none


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def snapshots(users: DataFrame, lookback: int, label: int, start: str, end: str) -> DataFrame:
    """One moment per user, ``lookback`` days after signup and not before ``start``; gone if its label window passes ``end``."""
    at = F.greatest((F.col("signup_ts") + F.expr(f"INTERVAL {lookback} DAYS")).cast("timestamp_ntz"), ts(start))
    rows = users.withColumn("snapshot_ts", at).withColumn("feature_start", (F.col("snapshot_ts") - F.expr(f"INTERVAL {lookback} DAYS")).cast("timestamp_ntz"))
    return rows.withColumn("label_end", (F.col("snapshot_ts") + F.expr(f"INTERVAL {label} DAYS")).cast("timestamp_ntz")).where(F.col("label_end") <= ts(end))


def as_of(rows: DataFrame, periods: DataFrame, at: str, value: str, tie: str) -> DataFrame:
    """``value`` of the latest period that began by the moment and had not ended before it, null without one."""
    found = rows.select("user_id", at).join(periods.select("user_id", "start_ts", "end_ts", value, tie), "user_id").where((F.col("start_ts") <= F.col(at)) & (F.col("end_ts").isNull() | (F.col("end_ts") >= F.col(at))))
    best = found.groupBy("user_id").agg(F.max_by(value, F.struct("start_ts", tie)).alias(value))
    return rows.join(best, "user_id", "left")


def features(points: DataFrame, events: DataFrame, names: list[str], failures: list[str]) -> DataFrame:
    """Per snapshot, from events in [feature_start, snapshot_ts]: counts, days, values, gaps and shares, in one grouping."""
    near = events.join(points.select("user_id", "snapshot_ts", "feature_start"), "user_id").where(F.col("ts").between(F.col("feature_start"), F.col("snapshot_ts")))
    day = Window.partitionBy("user_id").orderBy("ts", "event_id")
    near = near.withColumn("gap", F.coalesce(F.datediff("ts", F.lag("ts").over(day)), F.lit(0)))
    good = ~F.col("event_name").isin(failures)
    got = near.groupBy("user_id").agg(
        F.count("*").alias("n_events"), F.countDistinct(F.to_date("ts")).alias("active_days"), F.max(F.when(good, F.col("ts"))).alias("last_good"), F.max("gap").alias("longest_gap"), F.count_if(F.col("gap") > 7).alias("resurrections"),
        F.countDistinct("k").alias("n_features"), F.bround(F.sum("value"), 2).alias("value"), *(F.count_if(F.col("event_name") == n).alias(f"n_{n}") for n in names),
    )
    counts = ["n_events", "active_days", "longest_gap", "resurrections", "n_features", *(f"n_{n}" for n in names)]
    rows = points.join(got, "user_id", "left").na.fill(0, counts).na.fill(0.0, ["value"])
    rows = rows.withColumn("days_since_activity", F.coalesce(days_floor("last_good", "snapshot_ts"), F.lit(NEVER)))
    return rows.withColumn("failure_share", safe_div(sum((F.col(f"n_{n}") for n in failures), F.lit(0)), "n_events")).withColumn("events_per_day", safe_div("n_events", "active_days")).drop("last_good")


def labels(points: DataFrame, events: DataFrame, failures: list[str], cancelled: str) -> DataFrame:
    """Per snapshot, from events in (snapshot_ts, label_end]: events that count, cancellation and churn, which is 1 without any event."""
    later = events.join(points.select("user_id", "snapshot_ts", "label_end"), "user_id").where((F.col("ts") > F.col("snapshot_ts")) & (F.col("ts") <= F.col("label_end")))
    got = later.groupBy("user_id").agg(F.count_if(~F.col("event_name").isin(failures)).alias("later_events"), F.bool_or(F.col("event_name") == cancelled).alias("cancelled"))
    rows = points.select("user_id", "snapshot_ts").join(got, "user_id", "left").na.fill(0, ["later_events"])
    return rows.withColumn("cancelled", F.coalesce("cancelled", F.lit(False))).withColumn("churned", (F.col("later_events") == 0).cast("int"))


def ranked(rows: DataFrame, bucket: Column, order: list[str]) -> DataFrame:
    """Rows with ``position`` (from 0) and ``total`` in a global order that a bucket refines, without one sorting task."""
    rows = rows.withColumn("_b", bucket)
    sizes = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("total"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy(*order)) - 1
    return rows.join(sizes, "_b").withColumn("position", F.col("_before") + place).drop("_b", "_before")


def splits(points: DataFrame, train: float = 0.6, valid: float = 0.8) -> DataFrame:
    """train, validation and test in order of time, by whole rows of the shares."""
    rows = ranked(points, F.to_date("snapshot_ts"), ["snapshot_ts", "user_id"])
    a, b = F.greatest(F.floor(F.col("total") * train), F.lit(1)), F.greatest(F.floor(F.col("total") * valid), F.lit(2))
    return rows.withColumn("split", F.when(F.col("position") < a, "train").when(F.col("position") < b, "validation").otherwise("test")).drop("position", "total")


def score_counts(scored: DataFrame) -> DataFrame:
    """(score, n, positives): scores have four places, so everything below works on ten thousand rows at most."""
    return scored.groupBy("score").agg(F.count("*").alias("n"), F.sum("churned").alias("positives"))


def thresholds(scored: DataFrame, levels: list[float]) -> DataFrame:
    """Confusion counts, precision, recall and F1 of score >= threshold."""
    rows = score_counts(scored).select("*", F.explode(F.array(*map(F.lit, levels))).alias("threshold"))
    hit = F.col("score") >= F.col("threshold")
    got = rows.groupBy("threshold").agg(
        F.sum(F.when(hit, F.col("positives")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("n") - F.col("positives")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("positives")).otherwise(0)).alias("fn"), F.sum(F.when(~hit, F.col("n") - F.col("positives")).otherwise(0)).alias("tn"),
    )
    got = got.withColumn("precision", safe_div("tp", F.col("tp") + F.col("fp"))).withColumn("recall", safe_div("tp", F.col("tp") + F.col("fn")))
    return got.withColumn("f1", safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def capacity(scored: DataFrame, shares: list[float]) -> DataFrame:
    """The score at the ceil(n c)th place from the top, and how many reach it; ties can exceed the capacity."""
    down = Window.orderBy(F.col("score").desc())
    rows = score_counts(scored).withColumn("upto", F.sum("n").over(down)).withColumn("hits", F.sum("positives").over(down)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    rows = rows.select("*", F.explode(F.array(*map(F.lit, shares))).alias("capacity")).where(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("total") * F.col("capacity"))))
    return rows.groupBy("capacity").agg(F.max("score").alias("cutoff"), F.min("upto").alias("flagged"), F.min("hits").alias("true_positives"))


def calibration(scored: DataFrame, bins: int = 4) -> DataFrame:
    """Equal-width bins, the last one closed, each with its row: bounds, rows, mean score and observed rate, 0 where it is empty."""
    each = [F.struct(F.lit(i).alias("bin"), F.lit(i / bins).alias("lower"), F.lit((i + 1) / bins).alias("upper")) for i in range(bins)]
    sums = []
    for i in range(bins):
        here = F.col("slot") == i
        sums.append(F.struct(each[i].alias("b"), F.count_if(here).alias("n"), F.coalesce(F.bround(F.avg(F.when(here, F.col("score"))), 6), F.lit(0.0)).alias("mean_score"), F.coalesce(F.bround(F.avg(F.when(here, F.col("churned"))), 6), F.lit(0.0)).alias("observed_rate")))
    slot = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    rows = scored.withColumn("slot", slot).agg(F.array(*sums).alias("x")).selectExpr("inline(x)")
    return rows.select("b.*", "n", "mean_score", "observed_rate")


def evaluation(scored: DataFrame, threshold: float) -> DataFrame:
    """One row: prevalence, accuracy, Brier score, log loss, ROC-AUC and average precision; the last two are null with one class."""
    p = F.least(F.greatest(F.col("score"), F.lit(1e-6)), F.lit(1 - 1e-6))
    neg = F.col("n") - F.col("positives")
    down = Window.orderBy(F.col("score").desc())
    rows = score_counts(scored).withColumn("tp", F.sum("positives").over(down)).withColumn("above", F.sum("n").over(down))
    rows = rows.withColumn("all_pos", F.sum("positives").over(Window.partitionBy())).withColumn("all_n", F.sum("n").over(Window.partitionBy()))
    good = F.when(F.col("score") >= threshold, F.col("positives")).otherwise(neg)
    pairs = F.col("all_pos") * (F.col("all_n") - F.col("all_pos"))
    got = rows.groupBy("all_pos", "all_n").agg(
        F.sum(good).alias("correct"), F.sum(F.col("positives") * F.pow(1 - F.col("score"), 2) + neg * F.pow("score", F.lit(2))).alias("square"), F.sum(-F.col("positives") * F.log(p) - neg * F.log(1 - p)).alias("loss"),
        F.sum(neg * (F.col("tp") - F.col("positives") / 2.0)).alias("wins"), F.sum(F.col("positives") * F.col("tp") / F.col("above")).alias("gain"),
    )
    return got.select(
        F.col("all_n").alias("n"), rate("all_pos", "all_n").alias("prevalence"), rate("correct", "all_n").alias("accuracy"), rate("square", "all_n").alias("brier"), rate("loss", "all_n").alias("log_loss"),
        F.bround(F.col("wins") / F.nullif(pairs, F.lit(0)), 6).alias("roc_auc"), F.when(pairs > 0, rate("gain", "all_pos")).alias("average_precision"),
    )


#: Ranks of plans by name, which churn and segmentation order differently; any other plan ranks 0.
CHURN_RANKS, SEGMENT_RANKS = {"free": 0, "starter": 1, "pro": 2, "business": 3, "enterprise": 4}, {"free": 0, "starter": 1, "team": 2, "business": 3, "enterprise": 4}


def plan_rank(plan: Column, ranks: dict[str, int]) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for row in ranks.items() for x in row))[plan], F.lit(0))


def risk_band(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def stage_reached(stages: list[tuple[int, list[str]]]) -> Column:
    """The first level, highest first, of which a count column is above 0; else 0."""
    out = F.lit(0)
    for level, names in sorted(stages):
        reached = F.lit(False)
        for n in names:
            reached |= F.col(n) > 0
        out = F.when(reached, level).otherwise(out)
    return out


def prefix_counts(events: DataFrame, usage: DataFrame, prefixes: list[str], feature: str, amount: str) -> DataFrame:
    """Per user and prefix, events of features that start so, plus the amounts of such usage."""
    both = events.select("user_id", F.col(feature).cast("string").alias("f"), F.lit(1).cast("long").alias("n")).unionByName(usage.select("user_id", F.col(feature).cast("string").alias("f"), F.col(amount).cast("long").alias("n")))
    return both.groupBy("user_id").agg(*(F.coalesce(F.sum(F.when(F.col("f").startswith(p), F.col("n"))), F.lit(0)).alias(f"n_{p}") for p in prefixes))


def downgrades(points: DataFrame, periods: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """user_id, the plans at the snapshot and at the end of the label window, and whether the later one ranks below."""
    before = as_of(points, periods, "snapshot_ts", "plan", "subscription_id").select("user_id", "label_end", F.col("plan").alias("plan_before"))
    after = as_of(before, periods, "label_end", "plan", "subscription_id").withColumnRenamed("plan", "plan_after")
    return after.select("user_id", "plan_before", "plan_after", F.coalesce(plan_rank(F.col("plan_after"), ranks) < plan_rank(F.col("plan_before"), ranks), F.lit(False)).alias("downgraded"))


def confusion(scored: DataFrame, threshold: float) -> DataFrame:
    """One row: confusion counts, precision, recall, F1 and balanced accuracy at a threshold; null where there is one class."""
    hit, bad = F.col("score") >= threshold, F.col("churned") == 1
    got = scored.agg(F.count_if(hit & bad).alias("tp"), F.count_if(hit & ~bad).alias("fp"), F.count_if(~hit & bad).alias("fn"), F.count_if(~hit & ~bad).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    balance = F.bround((tp / F.nullif(tp + fn, F.lit(0)) + tn / F.nullif(tn + fp, F.lit(0))) / 2, 6)
    return got.select("*", safe_div(tp, tp + fp).alias("precision"), safe_div(tp, tp + fn).alias("recall"), safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"), balance.alias("balanced_accuracy"))


def best_threshold(table: DataFrame) -> DataFrame:
    """The threshold with the best F1, the highest of equals."""
    return table.agg(F.max(F.struct("f1", "threshold")).alias("x")).select("x.threshold", "x.f1")


def best_model(measured: DataFrame, preferred: str = "logistic") -> DataFrame:
    """Of (model, average_precision, brier) the best by precision, then the smaller error, then the preferred one, then the last name."""
    order = F.struct(F.coalesce("average_precision", F.lit(0.0)).alias("a"), (-F.coalesce("brier", F.lit(1.0))).alias("b"), (F.col("model") == preferred).cast("int").alias("p"), "model")
    return measured.agg(F.max(order).alias("x")).select("x.model")


def score_importance(rows: DataFrame, names: list[str], score: str = "score") -> DataFrame:
    """feature, correlation and its size of each feature with a score, the largest first; a constant one has none."""
    got = rows.agg(*(F.bround(F.corr(F.col(n).cast("double"), F.col(score).cast("double")), 6).alias(n) for n in names))
    long = got.unpivot([], names, "feature", "correlation").withColumn("correlation", F.nanvl("correlation", F.lit(None).cast("double")))
    return long.where("correlation IS NOT NULL").withColumn("importance", F.abs("correlation"))
