"""Retention and lifecycle queries."""

from __future__ import annotations

from ..operators import retention as op
from . import inputs
from .inputs import sql

ANALYSIS_END, SUPPRESSION = "2024-01-27 00:00:00", 5
ANCHORS: dict[str, tuple[str, ...]] = {"first_seen": (), "first_purchase": ("purchase",), "first_trouble": ("error",)}
HORIZON = {"daily": 12, "weekly": 4, "monthly": 1}
DIMENSIONS = ["persona", "region"]


def members(spark, sf, unit="weekly"):
    return op.memberships(inputs.events(spark, sf), ANCHORS, unit)


def qualifying(spark, sf):
    return inputs.events(spark, sf).where("event_name <> 'error'")


def periods(spark, sf, unit="weekly"):
    return op.user_periods(members(spark, sf, unit), qualifying(spark, sf), unit, HORIZON[unit], ANALYSIS_END)


def _members_sql(unit: str) -> dict[str, str]:
    cut = {"daily": "day", "weekly": "week", "monthly": "month"}[unit]
    label = {"daily": "strftime(anchor_ts, '%Y-%m-%d')", "weekly": "strftime(anchor_ts, '%G-W%V')", "monthly": "strftime(anchor_ts, '%Y-%m')"}[unit]
    some = " UNION ALL ".join(f"SELECT '{d}' AS definition_id, user_id, min(ts) AS anchor_ts FROM e {'WHERE event_name IN (' + ', '.join(repr(x) for x in n) + ')' if n else ''} GROUP BY user_id" for d, n in ANCHORS.items())
    return {
        "m": f"SELECT *, {label} AS cohort FROM ({some})",
        "gr": f"SELECT *, date_trunc('{cut}', anchor_ts)::TIMESTAMP + period * INTERVAL 1 {cut} AS period_start, date_trunc('{cut}', anchor_ts)::TIMESTAMP + (period + 1) * INTERVAL 1 {cut} AS period_end FROM (SELECT *, unnest(range({HORIZON[unit] + 1})) AS period FROM m)",
        "p": f"""SELECT definition_id, gr.user_id, anchor_ts, cohort, period, period_start, period_end <= TIMESTAMP '{ANALYSIS_END}' AS observed, period_end <= TIMESTAMP '{ANALYSIS_END}' AND count(e.ts) > 0 AS active,
            CASE WHEN period_end <= TIMESTAMP '{ANALYSIS_END}' THEN count(e.ts) ELSE 0 END AS events
            FROM gr LEFT JOIN e ON e.user_id = gr.user_id AND e.ts >= period_start AND e.ts < period_end AND event_name <> 'error' GROUP BY definition_id, gr.user_id, anchor_ts, cohort, period, period_start, period_end""",
        "l": f"""SELECT definition_id, cohort, period, cohort_size, observed, cohort_size - observed AS censored, retained, rolling_retained, CASE WHEN observed >= {SUPPRESSION} THEN round_even(retained / nullif(observed, 0), 6) END AS rate,
            CASE WHEN observed >= {SUPPRESSION} THEN round_even(rolling_retained / nullif(observed, 0), 6) END AS rolling_rate FROM (
            SELECT definition_id, cohort, period, count(*) AS cohort_size, count(*) FILTER (observed) AS observed, count(*) FILTER (active) AS retained,
            count(*) FILTER (observed AND EXISTS (SELECT 1 FROM p q WHERE q.definition_id = p.definition_id AND q.user_id = p.user_id AND q.active AND q.period >= p.period)) AS rolling_retained FROM p GROUP BY ALL)""",
        "lc": """SELECT definition_id, user_id, cohort, period, observed, active, CASE WHEN NOT observed THEN 'censored' WHEN period = 0 AND active THEN 'new' WHEN period = 0 THEN 'inactive' WHEN active AND streak >= 1 THEN 'resurrected' WHEN active THEN 'active'
            WHEN streak + 1 >= 2 THEN 'churned_descriptive' ELSE 'inactive' END AS state, CASE WHEN active THEN streak ELSE streak + 1 END AS quiet_periods FROM (
            SELECT *, coalesce(max(CASE WHEN observed THEN period END) OVER w, -1) - coalesce(max(CASE WHEN active THEN period END) OVER w, -1) AS streak FROM p WINDOW w AS (PARTITION BY definition_id, user_id ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    }


def _over(body: str, unit: str = "weekly") -> str:
    return sql(body, "e", "u", **_members_sql(unit))


def _long(unit):
    return lambda spark, sf: op.long(periods(spark, sf, unit), SUPPRESSION)


def segments(spark, sf):
    return op.segments(periods(spark, sf), inputs.users(spark, sf), DIMENSIONS, SUPPRESSION)


_SUMMARY = """
    SELECT definition_id, cohort, count(*) AS members, count(fr) AS returned, trunc(quantile_cont(fr, 0.5))::INT AS median_days_to_return, trunc(quantile_cont(ap, 0.5))::INT AS median_active_periods, count(*) FILTER (ap = 0) AS inactive,
    count(*) FILTER (la > fq) AS resurrected, count(*) FILTER (cens > 0) AS censored, round_even(count(fr) / count(*), 6) AS return_rate FROM (
    SELECT definition_id, cohort, user_id, min(floor(date_sub('second', anchor_ts, period_start) / 86400)) FILTER (active AND period > 0) AS fr, count(*) FILTER (active) AS ap, max(period) FILTER (active) AS la,
    min(period) FILTER (observed AND NOT active) AS fq, count(*) FILTER (NOT observed) AS cens FROM p GROUP BY ALL) GROUP BY ALL"""
_SEGMENTS = f"SELECT *, CASE WHEN observed >= {SUPPRESSION} THEN round_even(retained / nullif(observed, 0), 6) END AS rate, CASE WHEN observed >= {SUPPRESSION} THEN 'shown' ELSE 'suppressed' END AS status FROM (" + " UNION ALL ".join(
    f"SELECT definition_id, cohort, period, '{d}' AS dimension, {d}::VARCHAR AS value, count(*) FILTER (observed) AS observed, count(*) FILTER (active) AS retained FROM p JOIN u USING (user_id) GROUP BY ALL" for d in DIMENSIONS) + ")"
STATES = lambda spark, sf: op.lifecycle(periods(spark, sf), 1, 2)
QUERIES = {
    "retention_memberships": (lambda spark, sf: members(spark, sf).drop("membership_id"), _over("SELECT definition_id, user_id, anchor_ts, cohort FROM m")),
    "retention_user_periods": (periods, _over("SELECT * FROM p")),
    "g06_retention_long": (_long("weekly"), _over("SELECT * FROM l")),
    "retention_long_daily": (_long("daily"), _over("SELECT * FROM l", "daily")),
    "retention_long_monthly": (_long("monthly"), _over("SELECT * FROM l", "monthly")),
    "retention_matrix": (lambda spark, sf: op.matrix(op.long(periods(spark, sf), SUPPRESSION), HORIZON["weekly"]), _over("SELECT definition_id, cohort, " + ", ".join(f"max(rate) FILTER (period = {i}) AS period_{i}" for i in range(5)) + " FROM l GROUP BY ALL")),
    "retention_cohort_summary": (lambda spark, sf: op.cohort_summary(periods(spark, sf)), _over(_SUMMARY)),
    "retention_segments": (segments, _over(_SEGMENTS)),
    "retention_diagnostics": (lambda spark, sf: op.diagnostics(members(spark, sf), periods(spark, sf), segments(spark, sf)), _over(f"""SELECT count(DISTINCT definition_id) AS definitions, count(*) AS memberships, (SELECT count(*) FROM p) AS user_periods,
        (SELECT count(*) FROM p WHERE NOT observed) AS censored_periods, (SELECT count(*) FROM ({_SEGMENTS}) WHERE status = 'suppressed') AS suppressed_segments FROM m""")),
    "retention_reconciliation": (lambda spark, sf: op.broken_retention(op.long(periods(spark, sf), SUPPRESSION)).select("definition_id", "rule"), _over("SELECT definition_id, '' AS rule FROM l WHERE retained > observed OR observed + censored <> cohort_size")),
    "lifecycle_status": (STATES, _over("SELECT definition_id, user_id, cohort, period, state, quiet_periods FROM lc")),
    "lifecycle_daily": (lambda spark, sf: op.lifecycle(periods(spark, sf, "daily"), 1, 2), _over("SELECT definition_id, user_id, cohort, period, state, quiet_periods FROM lc", "daily")),
    "resurrection_summary": (lambda spark, sf: op.resurrection_summary(STATES(spark, sf)), _over("""SELECT definition_id, i AS inactive_periods, r AS resurrected_periods, round_even(r / nullif(i, 0), 6) AS resurrection_rate FROM (
        SELECT definition_id, count(*) FILTER (state IN ('inactive', 'churned_descriptive')) AS i, count(*) FILTER (state = 'resurrected') AS r FROM lc GROUP BY ALL)""")),
}
