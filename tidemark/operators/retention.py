"""Cohort retention on calendar periods, and the lifecycle of each member.

Period 0 is the calendar period that holds the anchor. Activity joins periods by the index that is computed
from the event's time, never by a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import add_periods, days_floor, fingerprint, period_index, period_label, rate, unpivoted


def memberships(events: DataFrame, anchors: dict[str, tuple[str, ...]], unit: str) -> DataFrame:
    """definition_id, user_id, anchor_ts and cohort: the first event of each definition's set (any event if it is empty)."""
    first = events.groupBy("user_id").agg(*(F.min(F.when(F.col("event_name").isin(list(names)), F.col("ts")) if names else F.col("ts")).alias(d) for d, names in anchors.items()))
    rows = first.unpivot("user_id", list(anchors), "definition_id", "anchor_ts").where("anchor_ts IS NOT NULL").withColumn("cohort", period_label("anchor_ts", unit))
    return rows.select(F.concat(F.lit("rtm_"), F.substring(fingerprint("definition_id", "user_id", "anchor_ts"), 1, 20)).alias("membership_id"), "definition_id", "user_id", "anchor_ts", "cohort")


def user_periods(members: DataFrame, events: DataFrame, unit: str, horizon: int, analysis_end: str) -> DataFrame:
    """A row per membership and period 0..horizon: observed (the period ended by analysis_end) and active."""
    grid = members.select("definition_id", "user_id", "anchor_ts", "cohort", F.explode(F.sequence(F.lit(0), F.lit(horizon))).alias("period"))
    grid = grid.withColumn("period_start", add_periods("anchor_ts", "period", unit)).withColumn("period_end", add_periods("anchor_ts", F.col("period") + 1, unit))
    grid = grid.withColumn("observed", F.col("period_end") <= F.lit(analysis_end).cast("timestamp_ntz"))
    active = members.select("definition_id", "user_id", "anchor_ts").join(events.select("user_id", "ts"), "user_id").withColumn("period", period_index("anchor_ts", "ts", unit))
    active = active.where(F.col("period").between(0, horizon)).groupBy("definition_id", "user_id", "period").agg(F.count("*").alias("events"))
    rows = grid.join(active, ["definition_id", "user_id", "period"], "left")
    return rows.select("definition_id", "user_id", "anchor_ts", "cohort", "period", "period_start", "observed", (F.col("observed") & F.col("events").isNotNull()).alias("active"), F.when(F.col("observed"), F.coalesce("events", F.lit(0))).otherwise(0).alias("events"))


def long(periods: DataFrame, suppression: int) -> DataFrame:
    """Classic and rolling retention per definition, cohort and period; where fewer than ``suppression`` are observed, counts stay and rates go.

    A member is rolling-retained in a period if it is active there or in any later one: the last active
    period of each member, counted from the end.
    """
    member = Window.partitionBy("definition_id", "user_id")
    rows = periods.withColumn("last_active", F.max(F.when(F.col("active"), F.col("period"))).over(member))
    rows = rows.groupBy("definition_id", "cohort", "period").agg(
        F.count("*").alias("cohort_size"), F.count_if("observed").alias("observed"), F.count_if("active").alias("retained"), F.count_if(F.col("observed") & (F.col("last_active") >= F.col("period"))).alias("rolling_retained")
    )
    shown = F.col("observed") >= suppression
    return rows.select("definition_id", "cohort", "period", "cohort_size", "observed", (F.col("cohort_size") - F.col("observed")).alias("censored"), "retained", "rolling_retained", F.when(shown, rate("retained", "observed")).alias("rate"), F.when(shown, rate("rolling_retained", "observed")).alias("rolling_rate"))


def matrix(table: DataFrame, horizon: int) -> DataFrame:
    """The classic rates with a column per period."""
    return table.groupBy("definition_id", "cohort").agg(*(F.max(F.when(F.col("period") == i, F.col("rate"))).alias(f"period_{i}") for i in range(horizon + 1)))


def member_summary(periods: DataFrame) -> DataFrame:
    """Per member: first return as a period and in whole days from the anchor, active periods, whether active again after an inactive observed period."""
    active, quiet = F.col("active"), F.col("observed") & ~F.col("active")
    back = active & (F.col("period") > 0)
    return periods.groupBy("definition_id", "cohort", "user_id").agg(
        F.min(F.when(back, F.col("period"))).alias("first_return"), F.min(F.when(back, days_floor("anchor_ts", "period_start"))).alias("days_to_return"),
        F.count_if(active).alias("active_periods"), F.count_if(~F.col("observed")).alias("censored_periods"),
        F.coalesce(F.max(F.when(active, F.col("period"))) > F.min(F.when(quiet, F.col("period"))), F.lit(False)).alias("resurrected"),
    )


def cohort_summary(periods: DataFrame) -> DataFrame:
    """Per cohort: members, returned, medians cut to whole numbers, never active, resurrected and censored members."""
    rows = member_summary(periods).groupBy("definition_id", "cohort").agg(
        F.count("*").alias("members"), F.count("first_return").alias("returned"), F.percentile("days_to_return", 0.5).cast("int").alias("median_days_to_return"), F.percentile("active_periods", 0.5).cast("int").alias("median_active_periods"),
        F.count_if(F.col("active_periods") == 0).alias("inactive"), F.count_if("resurrected").alias("resurrected"), F.count_if(F.col("censored_periods") > 0).alias("censored"),
    )
    return rows.withColumn("return_rate", rate("returned", "members"))


def segments(periods: DataFrame, users: DataFrame, dimensions: list[str], suppression: int) -> DataFrame:
    """Retention by cohort, period and one dimension at a time; where fewer than ``suppression`` are observed, the rate goes."""
    keep = ["definition_id", "cohort", "period"]
    rows = unpivoted(periods.select(*keep, "user_id", "observed", "active").join(users.select("user_id", *dimensions), "user_id"), [*keep, "observed", "active"], dimensions)
    rows = rows.groupBy(*keep, "dimension", "value").agg(F.count_if("observed").alias("observed"), F.count_if("active").alias("retained"))
    shown = F.col("observed") >= suppression
    return rows.withColumn("rate", F.when(shown, rate("retained", "observed"))).withColumn("status", F.when(shown, "shown").otherwise("suppressed"))


def lifecycle(periods: DataFrame, inactive_after: int, churned_after: int) -> DataFrame:
    """State of each member in each period: new, active, inactive, resurrected, churned_descriptive or censored.

    The quiet streak counts observed periods since the last active one, so it stands still once periods are
    censored; quiet_periods is the streak before an active period and one more in any other.
    """
    before = Window.partitionBy("definition_id", "user_id").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.coalesce(F.max(F.when(F.col(c), F.col("period"))).over(before), F.lit(-1))
    rows = periods.withColumn("streak_before", last("observed") - last("active"))
    active, first = F.col("active"), F.col("period") == 0
    state: Column = (
        F.when(~F.col("observed"), "censored").when(first, F.when(active, "new").otherwise("inactive")).when(active & (F.col("streak_before") >= inactive_after), "resurrected")
        .when(active, "active").when(F.col("streak_before") + 1 >= churned_after, "churned_descriptive").otherwise("inactive")
    )
    return rows.select("definition_id", "user_id", "cohort", "period", state.alias("state"), (F.col("streak_before") + F.when(active, 0).otherwise(1)).alias("quiet_periods"))


def broken_retention(table: DataFrame) -> DataFrame:
    """(definition_id, cohort, period, rule) of rows that don't reconcile."""
    rules = F.array(
        F.when(F.col("observed") + F.col("censored") != F.col("cohort_size"), F.lit("OBSERVED_PLUS_CENSORED")), F.when(F.col("retained") > F.col("observed"), F.lit("RETAINED_ABOVE_OBSERVED")),
        F.when(F.col("rolling_retained") < F.col("retained"), F.lit("ROLLING_BELOW_CLASSIC")), *(F.when(~F.col(r).between(0, 1), F.lit(f"RATE_RANGE:{r}")) for r in ("rate", "rolling_rate")),
    )
    return table.select("definition_id", "cohort", "period", F.explode(F.array_compact(rules)).alias("rule"))


def diagnostics(members: DataFrame, periods: DataFrame, segment_rows: DataFrame) -> DataFrame:
    """One row: definitions, memberships, member-periods, those censored, and suppressed segment rows."""
    a = members.agg(F.countDistinct("definition_id").alias("definitions"), F.count("*").alias("memberships"))
    b = periods.agg(F.count("*").alias("user_periods"), F.count_if(~F.col("observed")).alias("censored_periods"))
    c = segment_rows.agg(F.count_if(F.col("status") == "suppressed").alias("suppressed_segments"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))  # one row each


def resurrection_summary(states: DataFrame) -> DataFrame:
    """Per definition, counts of member-periods by state."""
    rows = states.groupBy("definition_id").agg(F.count_if(F.col("state").isin("inactive", "churned_descriptive")).alias("inactive_periods"), F.count_if(F.col("state") == "resurrected").alias("resurrected_periods"))
    return rows.withColumn("resurrection_rate", rate("resurrected_periods", "inactive_periods"))
