"""The churn and segmentation matrices over the shared tables, and the matrix that models are fitted on."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import churn as churn_op
from ..operators import features as op
from . import churn, inputs
from .inputs import sql

#: What an event of the shared tables stands for, by its type and bucket; likewise its feature and step.
MEANS = {
    "view": ["dashboard_viewed", "recommendation_shown", "upgrade_prompt_viewed", "report_exported", "search_performed", "onboarding_started"],
    "click": ["task_created", "project_created", "recommendation_clicked", "invite_sent", "comment_added", "file_uploaded", "automation_created", "member_added", "invite_accepted"],
    "purchase": ["task_completed", "recommendation_accepted", "subscription_started", "plan_upgraded", "plan_downgraded", "automation_executed", "integration_connected", "project_shared"],
    "signup": ["session_started", "onboarding_step_completed", "onboarding_completed", "workspace_created", "trial_started"],
    "error": ["feature_error", "request_failed", "cancellation_started"],
}
FEATURE, STEP = ["collaboration", "automation", "integrations", "reports", "search", "automation_rules", None], ["profile", "team", None]
UNCOUNTED = {"session_started", "feature_error", "request_failed", "recommendation_shown"}
QUALIFYING = sorted({x for names in MEANS.values() for x in names} - UNCOUNTED)
PLANS, CYCLES, CHANNELS, DEVICES, BANDS = ["free", "starter", "pro", "team", "enterprise"], ["monthly", "annual"], ["organic", "paid", "referral"], ["web", "mobile"], ["small", "medium", "large", None]


def _pick(values, of):
    return F.element_at(F.array(*map(F.lit, values)), (of % len(values) + 1).cast("int"))


def users(spark, sf):
    rows = inputs.users(spark, sf)
    u = F.col("user_id")
    return rows.select(
        "user_id", "signup_ts", "country", "region", "persona", F.col("is_team").cast("string").alias("is_team_account"), _pick(CHANNELS, u).alias("acquisition_channel"), _pick(DEVICES, u).alias("device_preference"),
        _pick(BANDS, u).alias("company_size_band"), _pick(PLANS, u).alias("initial_plan"), (u % 3 == 0).cast("string").alias("marketing_consent"),
    )


def rows(spark, sf):
    found, k = inputs.sessionized(inputs.events(spark, sf)), F.col("k")
    name = F.coalesce(*(F.when(F.col("event_name") == t, _pick(names, k)) for t, names in MEANS.items()))
    events = found.select("user_id", F.col("session").alias("session_id"), "ts", name.alias("event_name"), _pick(FEATURE, k).alias("feature_name"), _pick(STEP, F.floor(k / 7)).alias("step"))
    sessions = inputs.sessions(spark, sf).select("user_id", "start_ts", F.timestamp_diff("SECOND", "start_ts", "end_ts").alias("duration_seconds"))
    usage = inputs.usage(spark, sf).select("user_id", "day", _pick(FEATURE, F.col("feature")).alias("feature_name"), "usage_count", F.col("errors").alias("error_count"))
    bought = inputs.subscriptions(spark, sf).join(inputs.table(spark, sf, "orders").select(F.col("o_orderkey").alias("subscription_id"), F.col("o_orderstatus").alias("status")), "subscription_id")
    periods = bought.select("user_id", F.col("subscription_id").alias("period_id"), "start_ts", "end_ts", _pick(PLANS, F.col("plan") - 1).alias("plan"), _pick(CYCLES, F.col("subscription_id")).alias("cycle"), "status", "mrr")
    return op.tagged(events, sessions, usage, periods)


def points(spark, sf):
    return churn_op.snapshots(users(spark, sf), churn.LOOKBACK, churn.LABEL, churn.START, churn.END)


def wide(spark, sf):
    return op.activity(points(spark, sf), rows(spark, sf), QUALIFYING)


def churn_matrix(spark, sf):
    return op.churn_matrix(wide(spark, sf)).withColumn("mrr_at_snapshot", F.bround("mrr_at_snapshot", 2))


def segment_matrix(spark, sf):
    return op.segment_matrix(wide(spark, sf))


def labelled(spark, sf):
    """Churn features with split and label; every ninth user's device is missing, and test users may come from countries that training lacks."""
    found = churn_matrix(spark, sf).withColumn("device_preference", F.when(F.col("user_id") % 9 != 0, F.col("device_preference")))
    found = found.withColumn("average_session_duration_seconds", F.when(F.col("user_id") % 7 != 0, F.col("average_session_duration_seconds")))
    return found.join(churn_op.splits(churn.points(spark, sf)).select("user_id", "split"), "user_id").join(churn.labels(spark, sf).select("user_id", "churned"), "user_id")


def _case(values: list, of: str) -> str:
    return f"(CASE {of} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v) + " END)"


_NAME = "CASE event_name " + " ".join(f"WHEN '{t}' THEN {_case(names, 'k')}" for t, names in MEANS.items()) + " END"
_Q = "name IN (" + ", ".join(f"'{x}'" for x in QUALIFYING) + ")"
_W = "ts >= feature_start"
_LATE = "ts > make_timestamp((epoch_us(feature_start) + epoch_us(snapshot_ts)) // 2)"
_CTES = {
    "fu": f"SELECT user_id, signup_ts, country, region, persona, is_team::VARCHAR AS is_team_account, {_case(CHANNELS, 'user_id')} AS acquisition_channel, {_case(DEVICES, 'user_id')} AS device_preference, {_case(BANDS, 'user_id')} AS company_size_band, {_case(PLANS, 'user_id')} AS initial_plan, (user_id % 3 = 0)::VARCHAR AS marketing_consent FROM u",
    "p": f"SELECT *, w AS snapshot_ts, w - INTERVAL {churn.LOOKBACK} DAY AS feature_start FROM (SELECT *, greatest(signup_ts + INTERVAL {churn.LOOKBACK} DAY, TIMESTAMP '{churn.START}') AS w FROM fu) WHERE w + INTERVAL {churn.LABEL} DAY <= TIMESTAMP '{churn.END}'",
    "ev": f"SELECT x.user_id, session::VARCHAR AS session, ts, ts::DATE AS day, {_NAME} AS name, {_case(FEATURE, 'k')} AS feature, {_case(STEP, '(k // 7)')} AS step, snapshot_ts, feature_start FROM x JOIN p USING (user_id) WHERE ts <= snapshot_ts",
    "ea": f"""SELECT user_id, count(*) FILTER ({_W}) AS n_events, count(*) FILTER ({_W} AND {_Q}) AS q, count(*) FILTER ({_LATE} AND {_Q}) AS q_late, count(DISTINCT day) FILTER ({_W} AND {_Q}) AS days,
        count(DISTINCT session) FILTER ({_W} AND {_Q}) AS q_sessions, count(DISTINCT session) FILTER ({_W} AND name IN ('feature_error', 'request_failed')) AS bad_sessions, max(ts) FILTER ({_W} AND {_Q}) AS last_q, count(DISTINCT day) AS all_days,
        count(*) FILTER ({_W} AND starts_with(feature, 'collaboration')) AS f_collaboration, count(*) FILTER ({_W} AND starts_with(feature, 'automation')) AS f_automation, count(*) FILTER ({_W} AND feature IN ('automation', 'integrations', 'reports')) AS advanced,
        count(DISTINCT day) FILTER ({_W} AND feature = 'collaboration') AS collaboration_days, count(DISTINCT week(day)) FILTER ({_W} AND {_Q}) AS weeks, count(DISTINCT coalesce(step, 'unknown')) FILTER ({_W} AND name = 'onboarding_step_completed') AS steps, """
        + ", ".join(f"count(*) FILTER ({_W} AND name = '{x}') AS c_{x}" for x in op.WINDOW_COUNTS) + ", " + ", ".join(f"count(*) FILTER (name = '{x}') AS p_{x}" for x in op.EARLIER_COUNTS) + " FROM ev GROUP BY user_id",
    "gp": "SELECT user_id, max(g) AS gap FROM (SELECT user_id, date_diff('day', lag(day) OVER (PARTITION BY user_id ORDER BY day), day) AS g FROM (SELECT DISTINCT user_id, day FROM ev)) GROUP BY user_id",
    "gq": f"SELECT user_id, max(g) AS gap, count(*) FILTER (g > 7) AS back FROM (SELECT user_id, date_diff('day', lag(day) OVER (PARTITION BY user_id ORDER BY day), day) AS g FROM (SELECT DISTINCT user_id, day FROM ev WHERE {_Q})) GROUP BY user_id",
    "sa": f"SELECT user_id, count(*) AS sessions, count(*) FILTER ({_LATE.replace('ts >', 'start_ts >')}) AS late, sum(date_sub('second', start_ts, end_ts)) AS seconds FROM s JOIN p USING (user_id) WHERE start_ts BETWEEN feature_start AND snapshot_ts GROUP BY user_id",
    "ug": f"SELECT user_id, {_case(FEATURE, 'feature')} AS feature, usage_count, errors FROM g JOIN p USING (user_id) WHERE day BETWEEN feature_start::DATE AND snapshot_ts::DATE",
    "ua": "SELECT user_id, sum(usage_count) AS used, sum(errors) AS errors, sum(usage_count) FILTER (starts_with(feature, 'collaboration')) AS collaboration, sum(usage_count) FILTER (starts_with(feature, 'automation')) AS automation FROM ug GROUP BY user_id",
    "fa": f"SELECT user_id, count(DISTINCT feature) AS features FROM (SELECT user_id, feature FROM ev WHERE {_W} UNION ALL SELECT user_id, feature FROM ug) GROUP BY user_id",
    "pe": f"SELECT b.user_id, subscription_id, start_ts, end_ts, {_case(PLANS, '(plan - 1)')} AS plan, {_case(CYCLES, 'subscription_id')} AS cycle, o_orderstatus AS status, mrr, snapshot_ts, initial_plan FROM b JOIN orders ON o_orderkey = subscription_id JOIN p ON p.user_id = b.user_id WHERE start_ts <= snapshot_ts",
    "pa": "SELECT user_id, count(*) FILTER (plan <> initial_plan) AS changes FROM pe GROUP BY user_id",
    "pc": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_ts DESC, subscription_id::VARCHAR DESC) AS r FROM pe WHERE end_ts IS NULL OR end_ts >= snapshot_ts) WHERE r = 1",
    "all_": """SELECT p.*, ea.* EXCLUDE (user_id), gp.gap AS gap_all, gq.gap AS gap_q, back, sessions, late, seconds, used, errors, collaboration, automation, features, changes, pc.start_ts AS plan_start, plan, cycle, status, mrr
        FROM p LEFT JOIN ea USING (user_id) LEFT JOIN gp USING (user_id) LEFT JOIN gq USING (user_id) LEFT JOIN sa USING (user_id) LEFT JOIN ua USING (user_id) LEFT JOIN fa USING (user_id) LEFT JOIN pa USING (user_id) LEFT JOIN pc ON pc.user_id = p.user_id""",
}


def _days(a: str) -> str:
    return f"floor(date_sub('second', {a}, snapshot_ts) / 86400)::BIGINT"


def _div(a: str, b: str) -> str:
    return f"coalesce(round_even(coalesce({a}, 0)::DOUBLE / nullif({b}, 0), 6), 0)"


def _n(column: str, name: str) -> str:
    return f"coalesce({column}, 0)::BIGINT AS {name}"


_BOTH = [
    f"{_days('signup_ts')} AS account_age_days", _n("sessions", "sessions_in_lookback"), _n("days", "active_days_in_lookback"), _n("q", "qualifying_events_in_lookback"), f"{_div('q', 'days')} AS events_per_active_day",
    f"{_div('seconds', 'sessions')} AS average_session_duration_seconds", f"{_div('days', str(churn.LOOKBACK))} AS active_day_proportion", _n("c_feature_error", "feature_errors"), _n("c_request_failed", "failed_requests"),
    f"coalesce({_days('plan_start')}, 0) AS days_on_current_plan", *(f"coalesce({c}, 'unknown') AS {c}" for c in ("persona", "region", "acquisition_channel", "company_size_band", "is_team_account", "initial_plan")),
]
_CHURN = [
    *_BOTH, f"coalesce({_days('last_q')}, 999) AS days_since_last_qualifying_activity", _n("late", "recent_sessions"), _n("sessions - late", "prior_sessions"), _n("2 * late - sessions", "session_delta"), _n("q_late", "recent_qualifying_events"), _n("q - q_late", "prior_qualifying_events"),
    _n("2 * q_late - q", "event_delta"), _n("features", "distinct_features_used"), _n("coalesce(f_collaboration, 0) + coalesce(collaboration, 0)", "collaboration_actions"), _n("coalesce(f_automation, 0) + coalesce(automation, 0)", "automation_actions"), _n("c_search_performed", "search_actions"),
    _n("c_task_completed", "task_completion_events"), _n("c_recommendation_clicked + c_recommendation_accepted", "recommendation_interactions"), _n("errors", "feature_usage_errors"),
    f"{_div('coalesce(c_feature_error + c_request_failed, 0) + coalesce(errors, 0)', '(coalesce(n_events, 0) + coalesce(used, 0))')} AS error_rate", "coalesce(round_even(mrr, 2), 0) AS mrr_at_snapshot", _n("changes", "prior_subscription_changes"), _n("all_days", "historical_active_days"),
    _n("gap_all", "longest_inactivity_gap_days"), "coalesce(plan, 'unknown') AS plan_at_snapshot", "coalesce(cycle, 'unknown') AS billing_cycle_at_snapshot", "coalesce(status, 'unknown') AS subscription_status_at_snapshot",
    "CASE WHEN c_task_completed > 0 OR c_workspace_created > 0 THEN 'True' ELSE 'False' END AS activated_before_snapshot", "CASE WHEN plan IN ('starter', 'pro', 'business', 'enterprise') THEN 'True' ELSE 'False' END AS paid_before_snapshot",
    *(f"coalesce({c}, 'unknown') AS {c}" for c in ("country", "device_preference", "marketing_consent")),
]
_SEGMENT = [
    *_BOTH, f"coalesce({_days('last_q')}, 999) AS days_since_last_activity", _n("q_sessions", "meaningful_sessions"), _n("c_project_created", "projects_created"), _n("c_task_created", "tasks_created"), _n("c_task_completed", "tasks_completed"), f"{_div('c_task_completed', 'c_task_created')} AS task_completion_ratio",
    _n("c_file_uploaded", "files_uploaded"), _n("c_comment_added", "comments_added"), _n("c_search_performed", "searches_performed"), _n("c_dashboard_viewed", "dashboard_views"), _n("c_report_exported", "report_exports"), _n("c_invite_sent", "invites_sent"), _n("c_invite_accepted", "invites_accepted"),
    _n("c_member_added", "members_added"), _n("c_project_shared", "projects_shared"), _n("c_invite_sent + c_invite_accepted + c_member_added + c_project_shared", "collaboration_events"), _n("collaboration_days", "collaboration_active_days"), _n("c_automation_created", "automation_rules_created"),
    _n("c_automation_executed", "automation_executions"), _n("c_automation_executed", "successful_automation_uses"), _n("c_integration_connected", "integrations_connected"), _n("advanced", "advanced_feature_count"), _n("c_upgrade_prompt_viewed", "upgrade_prompts_viewed"), _n("c_trial_started", "trials_started"),
    "coalesce(mrr, 0) AS current_recurring_revenue", _n("p_plan_upgraded", "upgrade_count"), _n("p_plan_downgraded", "downgrade_count"), _n("c_cancellation_started", "cancellation_intent_events"), _n("c_recommendation_shown", "recommendations_shown"), _n("c_recommendation_clicked", "recommendations_clicked"),
    _n("c_recommendation_accepted", "recommendations_accepted"), f"{_div('c_recommendation_clicked', 'c_recommendation_shown')} AS recommendation_click_through_rate", f"{_div('c_recommendation_accepted', 'c_recommendation_clicked')} AS recommendation_acceptance_rate",
    f"{_div('c_feature_error + c_request_failed', 'n_events')} AS error_event_rate", _n("bad_sessions", "sessions_containing_errors"), _n("c_onboarding_step_completed - steps", "onboarding_step_repetitions"), _n("weeks", "active_periods_in_lookback"), _n("gap_q", "longest_inactivity_gap_days"),
    _n("back", "prior_resurrection_count"), _n("(2 * q_late < q)::INT", "recent_engagement_decline"), _n("CASE WHEN p_onboarding_completed > 0 THEN 4 WHEN p_workspace_created + p_task_completed > 0 THEN 3 WHEN p_onboarding_step_completed > 0 THEN 2 WHEN p_onboarding_started > 0 THEN 1 END", "highest_activation_stage"),
    _n("(plan IN ('starter', 'team', 'business', 'enterprise'))::INT", "paid_user_flag"), _n("(c_invite_sent + c_invite_accepted + c_member_added + c_project_shared > 0)::INT", "collaboration_adoption_flag"), _n("(c_automation_created + c_automation_executed > 0)::INT", "automation_adoption_flag"),
    _n("(p_subscription_started > 0)::INT", "paid_conversion_flag"), "1 - coalesce((p_onboarding_completed > 0)::INT, 0)::BIGINT AS incomplete_onboarding_flag", _n("(p_workspace_created + p_task_completed > 0)::INT", "activation_achieved"), _n("(p_onboarding_completed > 0)::INT", "onboarding_completed"),
    _n("(p_project_shared > 0)::INT", "collaboration_funnel_completed"), _n("(p_automation_executed > 0)::INT", "automation_adoption_completed"), "coalesce(plan, 'unknown') AS current_plan", "coalesce(status, 'unknown') AS subscription_status",
]


def _over(body: str, **more: str) -> str:
    return sql(body, "e", "u", "x", "s", "b", "g", **_CTES, **more)


_NUMBERS, _CLASSES = op.CHURN_NUMERIC, op.CHURN_CATEGORICAL
_MATRIX = _over(
    "SELECT user_id, split, feature AS \"column\", round_even((coalesce(v, median) - mean) / deviation, 6) AS value FROM nu JOIN nf USING (feature) UNION ALL SELECT user_id, split, feature || '=' || coalesce(v, mode), 1.0 FROM cl JOIN (SELECT feature, arg_min(v, (-n, v)) AS mode FROM cf GROUP BY feature) USING (feature) WHERE (feature, coalesce(v, mode)) IN (SELECT feature, v FROM cf)",
    m=f"SELECT user_id, snapshot_ts, {', '.join(_CHURN)} FROM all_",
    sp="SELECT user_id, CASE WHEN r < greatest(floor(n * 0.6), 1) THEN 'train' WHEN r < greatest(floor(n * 0.8), 2) THEN 'validation' ELSE 'test' END AS split FROM (SELECT user_id, row_number() OVER (ORDER BY snapshot_ts, user_id) - 1 AS r, count(*) OVER () AS n FROM p)",
    ms="SELECT m.* REPLACE (CASE WHEN user_id % 9 <> 0 THEN device_preference END AS device_preference, CASE WHEN user_id % 7 <> 0 THEN average_session_duration_seconds END AS average_session_duration_seconds), split FROM m JOIN sp USING (user_id)",
    nu=" UNION ALL ".join(f"SELECT user_id, split, '{c}' AS feature, {c}::DOUBLE AS v FROM ms" for c in _NUMBERS),
    nm="SELECT feature, median(v) AS median FROM nu WHERE split = 'train' GROUP BY feature",
    nf="SELECT feature, any_value(median) AS median, avg(coalesce(v, median)) AS mean, CASE WHEN stddev_pop(coalesce(v, median)) < 1e-12 THEN 1 ELSE stddev_pop(coalesce(v, median)) END AS deviation FROM nu JOIN nm USING (feature) WHERE split = 'train' GROUP BY feature",
    cl=" UNION ALL ".join(f"SELECT user_id, split, '{c}' AS feature, {c} AS v FROM ms" for c in _CLASSES),
    cf="SELECT feature, v, count(*) AS n FROM cl WHERE split = 'train' AND v IS NOT NULL GROUP BY feature, v",
)

QUERIES = {
    "churn_matrix": (churn_matrix, _over(f"SELECT user_id, snapshot_ts, {', '.join(_CHURN)} FROM all_")),
    "segment_matrix": (segment_matrix, _over(f"SELECT user_id, snapshot_ts, {', '.join(_SEGMENT)} FROM all_")),
    "model_matrix": (lambda spark, sf: op.preprocessed(labelled(spark, sf), _NUMBERS, _CLASSES), _MATRIX),
}
