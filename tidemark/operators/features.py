"""Feature matrices at a snapshot: one tagged union of what users did, joined to the snapshots once and grouped once.

Events, sessions, daily usage and plan periods go into one table with a ``kind``. Joined by user to the snapshots it
is first summed by (user, kind, day, session, name, feature, step), which spreads a very active user over many groups,
and then by user with conditional sums; both matrices are expressions over that one row. Nothing after a snapshot
enters: rows later than it are gone before any sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import days_floor, safe_div
from .churn import CHURN_RANKS, NEVER, SEGMENT_RANKS, plan_rank, stage_reached

#: Event names that features count within the lookback, and those that they count over all time before.
WINDOW_COUNTS = """automation_created automation_executed cancellation_started comment_added dashboard_viewed feature_error file_uploaded
integration_connected invite_accepted invite_sent member_added onboarding_step_completed project_created project_shared recommendation_accepted
recommendation_clicked recommendation_shown report_exported request_failed search_performed task_completed task_created trial_started
upgrade_prompt_viewed workspace_created""".split()
EARLIER_COUNTS = """automation_executed onboarding_completed onboarding_started onboarding_step_completed plan_downgraded plan_upgraded
project_shared subscription_started task_completed workspace_created""".split()
ERRORS, ADVANCED, COLLABORATION = ["feature_error", "request_failed"], ["automation", "integrations", "reports"], ["invite_sent", "invite_accepted", "member_added", "project_shared"]
STAGES = [(4, ["p_onboarding_completed"]), (3, ["p_workspace_created", "p_task_completed"]), (2, ["p_onboarding_step_completed"]), (1, ["p_onboarding_started"])]
PROFILE = ["country", "region", "acquisition_channel", "device_preference", "persona", "company_size_band", "initial_plan", "marketing_consent", "is_team_account"]
#: The columns of the two matrices, in order.
CHURN_NUMERIC = """account_age_days sessions_in_lookback active_days_in_lookback qualifying_events_in_lookback events_per_active_day
average_session_duration_seconds days_since_last_qualifying_activity active_day_proportion recent_sessions prior_sessions session_delta
recent_qualifying_events prior_qualifying_events event_delta distinct_features_used collaboration_actions automation_actions search_actions
task_completion_events recommendation_interactions feature_errors failed_requests feature_usage_errors error_rate days_on_current_plan
mrr_at_snapshot prior_subscription_changes historical_active_days longest_inactivity_gap_days""".split()
CHURN_CATEGORICAL = [*PROFILE, "plan_at_snapshot", "billing_cycle_at_snapshot", "subscription_status_at_snapshot", "activated_before_snapshot", "paid_before_snapshot"]
SEGMENT_NUMERIC = """account_age_days sessions_in_lookback active_days_in_lookback qualifying_events_in_lookback events_per_active_day
average_session_duration_seconds days_since_last_activity active_day_proportion meaningful_sessions projects_created tasks_created tasks_completed
task_completion_ratio files_uploaded comments_added searches_performed dashboard_views report_exports invites_sent invites_accepted members_added
projects_shared collaboration_events collaboration_active_days automation_rules_created automation_executions successful_automation_uses
integrations_connected advanced_feature_count upgrade_prompts_viewed trials_started current_recurring_revenue upgrade_count downgrade_count
cancellation_intent_events days_on_current_plan recommendations_shown recommendations_clicked recommendations_accepted
recommendation_click_through_rate recommendation_acceptance_rate feature_errors failed_requests error_event_rate sessions_containing_errors
onboarding_step_repetitions active_periods_in_lookback longest_inactivity_gap_days prior_resurrection_count recent_engagement_decline
highest_activation_stage""".split()
SEGMENT_BINARY = """paid_user_flag collaboration_adoption_flag automation_adoption_flag paid_conversion_flag incomplete_onboarding_flag
activation_achieved onboarding_completed collaboration_funnel_completed automation_adoption_completed""".split()
SEGMENT_PROFILE = ["persona", "acquisition_channel", "region", "company_size_band", "is_team_account", "initial_plan", "current_plan", "subscription_status"]
UNKNOWN = "unknown"


def tagged(events: DataFrame, sessions: DataFrame, usage: DataFrame, periods: DataFrame) -> DataFrame:
    """The four inputs in one table.

    events: user_id, session_id, ts, event_name, feature_name, step; sessions: user_id, start_ts, duration_seconds; usage:
    user_id, day, feature_name, usage_count, error_count; periods: user_id, period_id, start_ts, end_ts, plan, cycle, status, mrr.
    """
    kind = lambda k: F.lit(k).alias("kind")
    rows = events.select("user_id", kind("event"), "ts", F.to_date("ts").alias("day"), F.coalesce(F.col("session_id").cast("string"), F.lit("None")).alias("session"), F.col("event_name").alias("name"), F.col("feature_name").alias("feature"), "step")
    more = [
        sessions.select("user_id", kind("session"), F.col("start_ts").alias("ts"), F.col("duration_seconds").cast("double").alias("amount")),
        usage.select("user_id", kind("usage"), F.col("day").cast("timestamp_ntz").alias("ts"), "day", F.col("feature_name").alias("feature"), F.col("usage_count").cast("double").alias("amount"), F.col("error_count").cast("long").alias("errors")),
        periods.select("user_id", kind("period"), F.col("start_ts").alias("ts"), F.struct("start_ts", F.col("period_id").cast("string").alias("period_id"), "end_ts", "plan", "cycle", "status", F.col("mrr").cast("double").alias("mrr")).alias("period")),
    ]
    for one in more:
        rows = rows.unionByName(one, allowMissingColumns=True)
    return rows


def activity(points: DataFrame, rows: DataFrame, qualifying: list[str]) -> DataFrame:
    """A row per snapshot (user_id, signup_ts, snapshot_ts, feature_start and profile columns) with the sums behind both matrices."""
    start, at = F.col("feature_start"), F.col("snapshot_ts")
    near = rows.join(points.select("user_id", "snapshot_ts", "feature_start", F.col("initial_plan").cast("string").alias("initial_plan")), "user_id").where((F.col("ts") <= at) & ((F.col("kind") != "session") | (F.col("ts") >= start)))
    inside = F.when(F.col("kind") == "usage", F.col("day").between(F.to_date(start), F.to_date(at))).otherwise(F.col("ts") >= start)
    near = near.withColumn("inside", inside).withColumn("late", inside & (F.col("ts") > start + (at - start) / 2))
    summed = near.groupBy("user_id", "kind", "day", "session", "name", "feature", "step", "period", "initial_plan", "snapshot_ts").agg(
        F.count("*").alias("n_all"), F.count_if("inside").alias("n"), F.count_if("late").alias("n_late"), F.sum(F.when(F.col("inside"), F.col("amount"))).alias("amount"),
        F.sum(F.when(F.col("inside"), F.col("errors"))).alias("errors"), F.max(F.when(F.col("inside"), F.col("ts"))).alias("last"),
    )
    event, used, name, feature, there = F.col("kind") == "event", F.col("kind") == "usage", F.col("name"), F.coalesce("feature", F.lit("")), F.col("n") > 0
    counted = event & name.isin(qualifying)
    ours = F.col("period")
    current = (F.col("kind") == "period") & (ours["end_ts"].isNull() | (ours["end_ts"] >= F.col("snapshot_ts")))

    def total(of: Column, column: str = "n") -> Column:
        return F.coalesce(F.sum(F.when(of, F.col(column))), F.lit(0))

    def starts(prefix: str) -> Column:
        return (total(event & feature.startswith(prefix)) + total(used & feature.startswith(prefix), "amount")).cast("long")

    sums = summed.groupBy("user_id").agg(
        total(F.col("kind") == "session").alias("sessions"), total(F.col("kind") == "session", "n_late").alias("late_sessions"), total(F.col("kind") == "session", "amount").alias("seconds"),
        total(event).alias("window_events"), total(counted).alias("counted"), total(counted, "n_late").alias("late_counted"), F.max(F.when(counted, F.col("last"))).alias("last_counted"),
        F.collect_set(F.when(counted & there, F.col("day"))).alias("days"), F.array_sort(F.collect_set(F.when(event, F.col("day")))).alias("all_days"), F.array_sort(F.collect_set(F.when(counted, F.col("day")))).alias("counted_days"),
        F.collect_set(F.when((event | used) & there & (feature != ""), feature)).alias("features"), F.collect_set(F.when(event & there & (feature == "collaboration"), F.col("day"))).alias("collaboration_days"),
        starts("collaboration").alias("collaboration_actions"), starts("automation").alias("automation_actions"), total(event & feature.isin(ADVANCED)).alias("advanced"),
        total(used, "errors").alias("usage_errors"), total(used, "amount").alias("usage_total"), F.collect_set(F.when(event & there & (name == "onboarding_step_completed"), F.coalesce("step", F.lit(UNKNOWN)))).alias("steps"),
        F.countDistinct(F.when(counted & there, F.col("session"))).alias("counted_sessions"), F.countDistinct(F.when(event & there & name.isin(ERRORS) & (F.col("session") != ""), F.col("session"))).alias("error_sessions"),
        F.max_by(F.when(current, ours), F.when(current, F.struct(ours["start_ts"], ours["period_id"]))).alias("now"), F.count_if((F.col("kind") == "period") & (F.coalesce(ours["plan"], F.lit("")) != F.coalesce("initial_plan", F.lit("")))).alias("changes"),
        *(total(event & (name == x)).alias(f"c_{x}") for x in WINDOW_COUNTS), *(total(event & (name == x), "n_all").alias(f"p_{x}") for x in EARLIER_COUNTS),
    )
    sets = {"days": "date", "all_days": "date", "counted_days": "date", "features": "string", "collaboration_days": "date", "steps": "string"}
    out = points.join(sums, "user_id", "left")
    out = out.na.fill(0, [c for c, kind in sums.dtypes if kind in ("bigint", "double") and c != "user_id"])
    return out.withColumns({c: F.coalesce(F.col(c), F.expr(f"cast(array() AS array<{kind}>)")) for c, kind in sets.items()})


def _gaps(days: str) -> Column:
    """Days from each day of a sorted set to the next."""
    return F.transform(F.slice(days, 2, F.greatest(F.size(days) - 1, F.lit(0))), lambda d, i: F.datediff(d, F.get(F.col(days), i)))


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(UNKNOWN))


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def _shared() -> dict[str, Column]:
    span = F.greatest(days_floor("feature_start", "snapshot_ts"), F.lit(1))
    return {
        "account_age_days": days_floor("signup_ts", "snapshot_ts"), "sessions_in_lookback": F.col("sessions"), "active_days_in_lookback": F.size("days"), "qualifying_events_in_lookback": F.col("counted"),
        "events_per_active_day": safe_div("counted", F.size("days")), "average_session_duration_seconds": safe_div("seconds", "sessions"), "active_day_proportion": safe_div(F.size("days"), span),
        "feature_errors": F.col("c_feature_error"), "failed_requests": F.col("c_request_failed"), "days_on_current_plan": F.coalesce(days_floor(F.col("now.start_ts"), "snapshot_ts"), F.lit(0)),
    }


def churn_matrix(wide: DataFrame) -> DataFrame:
    """user_id, snapshot_ts and the 29 numeric and 14 categorical features of churn models."""
    last, failed = days_floor("last_counted", "snapshot_ts"), F.col("c_feature_error") + F.col("c_request_failed") + F.col("usage_errors")
    plan = _text(F.col("now.plan"))
    made = _shared() | {
        "days_since_last_qualifying_activity": F.coalesce(last, F.lit(NEVER)), "recent_sessions": F.col("late_sessions"), "prior_sessions": F.col("sessions") - F.col("late_sessions"), "session_delta": 2 * F.col("late_sessions") - F.col("sessions"),
        "recent_qualifying_events": F.col("late_counted"), "prior_qualifying_events": F.col("counted") - F.col("late_counted"), "event_delta": 2 * F.col("late_counted") - F.col("counted"), "distinct_features_used": F.size("features"),
        "search_actions": F.col("c_search_performed"), "task_completion_events": F.col("c_task_completed"), "recommendation_interactions": F.col("c_recommendation_clicked") + F.col("c_recommendation_accepted"),
        "feature_usage_errors": F.col("usage_errors"), "error_rate": safe_div(failed, F.col("window_events") + F.col("usage_total")), "mrr_at_snapshot": F.coalesce("now.mrr", F.lit(0.0)), "prior_subscription_changes": F.col("changes"),
        "historical_active_days": F.size("all_days"), "longest_inactivity_gap_days": F.coalesce(F.array_max(_gaps("all_days")), F.lit(0)), "plan_at_snapshot": plan, "billing_cycle_at_snapshot": _text(F.col("now.cycle")),
        "subscription_status_at_snapshot": _text(F.col("now.status")), "activated_before_snapshot": F.when((F.col("c_task_completed") > 0) | (F.col("c_workspace_created") > 0), "True").otherwise("False"),
        "paid_before_snapshot": F.when(plan_rank(plan, CHURN_RANKS) > 0, "True").otherwise("False"), **{c: _text(F.col(c)) for c in PROFILE},
    }
    return wide.select("user_id", "snapshot_ts", *(made.get(c, F.col(c)).alias(c) for c in CHURN_NUMERIC + CHURN_CATEGORICAL))


def segment_matrix(wide: DataFrame) -> DataFrame:
    """user_id, snapshot_ts and the 51 numeric, 9 binary and 8 profile features of segmentation."""
    together = sum((F.col(f"c_{x}") for x in COLLABORATION), F.lit(0))
    plan = _text(F.col("now.plan"))
    named = {
        "projects_created": "project_created", "tasks_created": "task_created", "tasks_completed": "task_completed", "files_uploaded": "file_uploaded", "comments_added": "comment_added", "searches_performed": "search_performed",
        "dashboard_views": "dashboard_viewed", "report_exports": "report_exported", "invites_sent": "invite_sent", "invites_accepted": "invite_accepted", "members_added": "member_added", "projects_shared": "project_shared",
        "automation_rules_created": "automation_created", "automation_executions": "automation_executed", "successful_automation_uses": "automation_executed", "integrations_connected": "integration_connected",
        "upgrade_prompts_viewed": "upgrade_prompt_viewed", "trials_started": "trial_started", "cancellation_intent_events": "cancellation_started", "recommendations_shown": "recommendation_shown",
        "recommendations_clicked": "recommendation_clicked", "recommendations_accepted": "recommendation_accepted",
    }
    made = _shared() | {c: F.col(f"c_{x}") for c, x in named.items()} | {
        "days_since_last_activity": F.coalesce(days_floor("last_counted", "snapshot_ts"), F.lit(NEVER)), "meaningful_sessions": F.col("counted_sessions"), "task_completion_ratio": safe_div("c_task_completed", "c_task_created"),
        "collaboration_events": together, "collaboration_active_days": F.size("collaboration_days"), "advanced_feature_count": F.col("advanced"), "current_recurring_revenue": F.coalesce("now.mrr", F.lit(0.0)),
        "upgrade_count": F.col("p_plan_upgraded"), "downgrade_count": F.col("p_plan_downgraded"), "recommendation_click_through_rate": safe_div("c_recommendation_clicked", "c_recommendation_shown"),
        "recommendation_acceptance_rate": safe_div("c_recommendation_accepted", "c_recommendation_clicked"), "error_event_rate": safe_div(F.col("c_feature_error") + F.col("c_request_failed"), "window_events"),
        "sessions_containing_errors": F.col("error_sessions"), "onboarding_step_repetitions": F.col("c_onboarding_step_completed") - F.size("steps"), "active_periods_in_lookback": F.size(F.array_distinct(F.transform("days", F.weekofyear))),
        "longest_inactivity_gap_days": F.coalesce(F.array_max(_gaps("counted_days")), F.lit(0)), "prior_resurrection_count": F.size(F.filter(_gaps("counted_days"), lambda d: d > 7)),
        "recent_engagement_decline": _flag(2 * F.col("late_counted") < F.col("counted")), "highest_activation_stage": stage_reached(STAGES), "paid_user_flag": _flag(plan_rank(plan, SEGMENT_RANKS) > 0),
        "collaboration_adoption_flag": _flag(together > 0), "automation_adoption_flag": _flag(F.col("c_automation_created") + F.col("c_automation_executed") > 0), "paid_conversion_flag": _flag(F.col("p_subscription_started") > 0),
        "incomplete_onboarding_flag": _flag(F.col("p_onboarding_completed") == 0), "activation_achieved": _flag((F.col("p_workspace_created") > 0) | (F.col("p_task_completed") > 0)), "onboarding_completed": _flag(F.col("p_onboarding_completed") > 0),
        "collaboration_funnel_completed": _flag(F.col("p_project_shared") > 0), "automation_adoption_completed": _flag(F.col("p_automation_executed") > 0), "current_plan": plan, "subscription_status": _text(F.col("now.status")),
        **{c: _text(F.col(c)) for c in PROFILE},
    }
    return wide.select("user_id", "snapshot_ts", *(made[c].alias(c) for c in SEGMENT_NUMERIC + SEGMENT_BINARY + SEGMENT_PROFILE))


def numeric_fit(rows: DataFrame, names: list[str], split: str = "split") -> DataFrame:
    """feature, median, mean, deviation (of the population, 1 where it is 0) of the training rows; missing values count as the median."""
    train = rows.where(F.col(split) == "train")
    held = train.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in names))).alias("x")).select("x.*")
    # equal values are one row, so the median's buffer holds different values and the deviation comes from sums
    counts = held.groupBy("feature", "value").agg(F.count("*").alias("n"))
    middle = counts.where("value IS NOT NULL").groupBy("feature").agg(F.percentile("value", F.lit(0.5), F.col("n")).alias("median"))
    filled = counts.join(F.broadcast(middle), "feature", "left").withColumn("v", F.coalesce("value", "median"))  # one row a feature
    means = filled.groupBy("feature").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"))
    spread = filled.join(F.broadcast(means), "feature").groupBy("feature", "median", "mean").agg(F.sqrt(F.sum(F.pow(F.col("v") - F.col("mean"), F.lit(2)) * F.col("n")) / F.sum("n")).alias("deviation"))
    return spread.withColumn("deviation", F.when(F.col("deviation") < 1e-12, 1.0).otherwise(F.col("deviation")))


def category_fit(rows: DataFrame, names: list[str], split: str = "split") -> DataFrame:
    """feature, value, n and mode (the most frequent value, ties the smallest) of the training rows."""
    train = rows.where(F.col(split) == "train")
    held = train.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in names))).alias("x")).select("x.*")
    counts = held.where("value IS NOT NULL").groupBy("feature", "value").agg(F.count("*").alias("n"))
    first = counts.groupBy("feature").agg(F.min(F.struct((-F.col("n")).alias("r"), "value")).alias("m")).select("feature", F.col("m.value").alias("mode"))
    return counts.join(F.broadcast(first), "feature")  # one row a feature


def preprocessed(rows: DataFrame, numeric: list[str], categorical: list[str], key: str = "user_id", split: str = "split") -> DataFrame:
    """The model matrix in long form: key, split, column, value.

    Numeric features get the training median where missing and are scaled by the training mean and deviation. Of
    categorical ones, missing values become the training mode, and a value that training has gives a column
    ``feature=value`` of 1; others, which training never saw, give none. Columns that aren't there are 0.
    """
    fitted = numeric_fit(rows, numeric, split)
    numbers = rows.select(key, split, F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in numeric))).alias("x")).select(key, split, "x.*")
    scaled = numbers.join(F.broadcast(fitted), "feature").select(key, split, F.col("feature").alias("column"), F.bround((F.coalesce("v", "median") - F.col("mean")) / F.col("deviation"), 6).alias("value"))
    known = category_fit(rows, categorical, split)
    modes = F.broadcast(known.select("feature", "mode").distinct())
    classes = rows.select(key, split, F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v")) for c in categorical))).alias("x")).select(key, split, "x.*")
    classes = classes.join(modes, "feature").withColumn("value", F.coalesce("v", "mode")).join(known.select("feature", "value"), ["feature", "value"])
    return scaled.union(classes.select(key, split, F.concat("feature", F.lit("="), "value").alias("column"), F.lit(1.0)))
