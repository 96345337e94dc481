"""Funnel queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import funnel as op
from ..operators.funnel import Funnel, Stage
from . import inputs
from .inputs import sql

ANALYSIS_END, SUPPRESSION, DIMENSIONS = "2024-01-28 00:00:00", 5, ["persona", "country", "region", "is_team"]
FUNNELS = (
    Funnel("purchase", (Stage("view", ("view",)), Stage("click", ("click",)), Stage("purchase", ("purchase",))), 7),
    Funnel("late_signup", (Stage("signup", ("signup",)), Stage("act", ("view", "click")), Stage("view", ("view",)), Stage("purchase", ("purchase",))), 30, "signup_ts >= TIMESTAMP_NTZ'2024-01-01 12:00:00'"),
    Funnel("repeat_click", (Stage("view", ("view",)), Stage("clicks", ("click",), 2), Stage("purchase", ("purchase",))), 1, "is_team"),
    Funnel("rescue", (Stage("error", ("error",)), Stage("again", ("error",), 3), Stage("signup", ("signup",), 4)), 2, "array_contains(seen, 'purchase')"),
)


PAID = (Funnel("paying", (Stage("view", ("view",)), Stage("paid", (), paid=True)), 30),)


def eligible(spark, sf):
    people = inputs.users(spark, sf).join(op.names_seen(op.activity(inputs.events(spark, sf))), "user_id")
    rows = [F.struct(F.lit(f.name).alias("funnel_id"), F.count_if(F.expr(f.eligible)).alias("eligible")) for f in FUNNELS]
    return people.agg(F.array(*rows).alias("x")).selectExpr("inline(x)")


def attempts(spark, sf):
    return op.attempts(inputs.users(spark, sf), inputs.events(spark, sf), FUNNELS, ANALYSIS_END)


def paid_attempts(spark, sf):
    """Orders as paid starts: the last stage is a purchase or a paid subscription."""
    paid = inputs.subscriptions(spark, sf).withColumn("start_ts", (F.col("start_ts") + F.expr("INTERVAL 9500 DAYS")).cast("timestamp_ntz"))
    return op.attempts(inputs.users(spark, sf), inputs.events(spark, sf), PAID, ANALYSIS_END, paid)


def funnel_attempts(spark, sf):
    shown = F.array_join(F.transform("stage_times", lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")), ",", "-")
    return attempts(spark, sf).select("funnel_id", "user_id", "entry_ts", "n_reached", "status", "seconds", shown.alias("stage_times"))


def funnel_summary(spark, sf):
    return op.summary(attempts(spark, sf), eligible(spark, sf))


def funnel_stage_metrics(spark, sf):
    return op.stage_metrics(attempts(spark, sf))


def funnel_time_metrics(spark, sf):
    return op.time_metrics(attempts(spark, sf))


def funnel_segment_metrics(spark, sf):
    return op.segment_metrics(attempts(spark, sf), inputs.users(spark, sf), DIMENSIONS, SUPPRESSION)


def funnel_dropoff(spark, sf):
    return op.dropoff(attempts(spark, sf), inputs.sessionized(inputs.events(spark, sf)), ["error"])


def _attempt_sql(f: Funnel) -> dict[str, str]:
    """CTEs of one funnel's attempts by one join per stage; its stage times are t0, t1, ..."""
    out, n = {}, len(f.stages)
    rule = f.eligible.replace("TIMESTAMP_NTZ", "TIMESTAMP ").replace("array_contains(seen, 'purchase')", "user_id IN (SELECT user_id FROM e WHERE event_name = 'purchase')")
    out[f"el_{f.name}"] = f"SELECT user_id FROM u WHERE {rule}"
    for i, s in enumerate(f.stages):
        names = ", ".join(f"'{x}'" for x in (*s.events, *(["paid:"] if s.paid else [])))
        later = f"JOIN {f.name}_{i - 1} p USING (user_id) WHERE ev.ts > p.t{i - 1} AND" if i else f"JOIN el_{f.name} USING (user_id) WHERE"
        out[f"{f.name}_{i}"] = f"SELECT user_id, (list(ts ORDER BY ts, event_id))[{s.min_count}] AS t{i}, (list(event_id ORDER BY ts, event_id))[{s.min_count}] AS i{i} FROM ev {later} event_name IN ({names}) GROUP BY user_id HAVING count(*) >= {s.min_count}"
    joins = " ".join(f"LEFT JOIN {f.name}_{i} USING (user_id)" for i in range(1, n))
    times, ids = (", ".join(f"{x}{i}" for i in range(n)) for x in ("t", "i"))
    reached = " + ".join(f"(t{i} IS NOT NULL)::INT" for i in range(n))
    shown = " || ',' || ".join(f"coalesce(strftime(t{i}, '%Y-%m-%d %H:%M:%S'), '-')" for i in range(n))
    out[f"a_{f.name}"] = f"""SELECT '{f.name}' AS funnel_id, user_id, t0 AS entry_ts, CASE WHEN t{n - 1} <= t0 + INTERVAL {f.days} DAY THEN t{n - 1} ELSE greatest(last_ts, t0) END AS exit_ts, [{ids}] AS ids, {reached} AS n_reached, [{times}] AS times, {shown} AS stage_times,
        CASE WHEN t{n - 1} <= t0 + INTERVAL {f.days} DAY THEN 'completed' WHEN t0 + INTERVAL {f.days} DAY > TIMESTAMP '{ANALYSIS_END}' THEN 'censored' WHEN {reached} = 1 THEN 'incomplete' ELSE 'abandoned' END AS status,
        CASE WHEN t{n - 1} <= t0 + INTERVAL {f.days} DAY THEN date_sub('second', t0, t{n - 1}) END AS seconds FROM {f.name}_0 {joins} JOIN (SELECT user_id, max(ts) AS last_ts FROM ev GROUP BY user_id) USING (user_id)"""
    return out


_EVENTS = "SELECT user_id, ts, event_id::VARCHAR AS event_id, event_name FROM e"
_PAID = f"{_EVENTS} UNION ALL SELECT user_id, start_ts + INTERVAL 9500 DAY, 'subscription:' || subscription_id, 'paid:' FROM b WHERE mrr > 0"


def _over(body: str, funnels=FUNNELS, events: str = _EVENTS, **more: str) -> str:
    ctes: dict[str, str] = {"ev": events}
    for f in funnels:
        ctes |= _attempt_sql(f)
    ctes["a"] = " UNION ALL ".join(f"SELECT * FROM a_{f.name}" for f in funnels)
    ctes["el"] = " UNION ALL ".join(f"SELECT '{f.name}' AS funnel_id, count(*) AS eligible FROM el_{f.name}" for f in funnels)
    return sql(body, "e", "u", "x", "b", **ctes, **more)


def rank(p: float, value: str = "seconds") -> str:
    return f"(list({value} ORDER BY {value}))[CAST(round_even((count({value}) - 1) * {p}, 0) AS INT) + 1]"


STAGES = "SELECT funnel_id, user_id, i AS stage, times[i + 1] AS ts, CASE WHEN i > 0 THEN date_sub('second', times[i], times[i + 1]) END AS seconds FROM (SELECT *, unnest(range(len(times))) AS i FROM a)"
QUERIES = {
    "funnel_attempts": (funnel_attempts, _over("SELECT funnel_id, user_id, entry_ts, n_reached, status, seconds, stage_times FROM a")),
    "funnel_summary": (funnel_summary, _over(f"""
        SELECT funnel_id, eligible, count(user_id) AS entrants, eligible - count(user_id) AS non_entrants, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'censored') AS censored,
        count(*) FILTER (status = 'incomplete') AS incomplete, count(*) FILTER (status = 'abandoned') AS abandoned, round_even(count(user_id) / nullif(eligible, 0), 6) AS entry_rate,
        round_even(count(*) FILTER (status = 'completed') / nullif(eligible, 0), 6) AS completion_rate, round_even(count(*) FILTER (status = 'completed') / nullif(count(user_id) - count(*) FILTER (status = 'censored'), 0), 6) AS observed_completion_rate,
        {rank(0.5)} AS median_seconds FROM el LEFT JOIN a USING (funnel_id) GROUP BY funnel_id, eligible""".replace("list(seconds ORDER BY seconds)", "list(seconds ORDER BY seconds) FILTER (seconds IS NOT NULL)"))),
    "funnel_stage_metrics": (funnel_stage_metrics, _over("""
        SELECT funnel_id, stage, reached, previous, round_even(reached / nullif(previous, 0), 6) AS step_rate, round_even(reached / nullif(entrants, 0), 6) AS reach_rate, previous - reached AS drop_off
        FROM (SELECT *, coalesce(lag(reached) OVER (PARTITION BY funnel_id ORDER BY stage), entrants) AS previous FROM (SELECT funnel_id, stage, count(ts) AS reached, count(*) AS entrants FROM st GROUP BY ALL))""", st=STAGES)),
    "funnel_time_metrics": (funnel_time_metrics, _over(f"""
        SELECT funnel_id, stage, count(*) AS n, min(seconds) AS low, max(seconds) AS high, {rank(.25)} AS p25, {rank(.5)} AS p50, {rank(.75)} AS p75, CASE WHEN count(*) >= 5 THEN {rank(.9)} END AS p90
        FROM st WHERE seconds IS NOT NULL AND stage > 0 GROUP BY ALL""", st=STAGES)),
    "funnel_segment_metrics": (funnel_segment_metrics, _over(
        f"SELECT funnel_id, dimension, value, n AS entrants, CASE WHEN n >= {SUPPRESSION} THEN c END AS completed, CASE WHEN n >= {SUPPRESSION} THEN round_even(c / n, 6) END AS completion_rate, n < {SUPPRESSION} AS suppressed FROM ("
        + " UNION ALL ".join(f"SELECT funnel_id, '{d}' AS dimension, coalesce({d}::VARCHAR, 'None') AS value, count(*) AS n, count(*) FILTER (status = 'completed') AS c FROM a JOIN u USING (user_id) GROUP BY ALL" for d in DIMENSIONS) + ")")),
    "funnel_dropoff": (funnel_dropoff, _over(f"""
        SELECT funnel_id, highest_stage, users, errors, errors_per_user, median_sessions, common_last_event, round_even(users / entrants, 6) AS share_of_entrants FROM (
        SELECT funnel_id, highest_stage, count(*) AS users, sum(k)::BIGINT AS errors, round_even(avg(k), 6) AS errors_per_user, {rank(0.5, "sessions")} AS median_sessions FROM d GROUP BY funnel_id, highest_stage) g JOIN (
        SELECT funnel_id, highest_stage, last_event AS common_last_event FROM (SELECT funnel_id, highest_stage, last_event, row_number() OVER (PARTITION BY funnel_id, highest_stage ORDER BY count(*) DESC, last_event) AS r FROM d GROUP BY funnel_id, highest_stage, last_event) WHERE r = 1) USING (funnel_id, highest_stage) JOIN (SELECT funnel_id, count(*) AS entrants FROM a GROUP BY funnel_id) USING (funnel_id)""",
        d="""SELECT funnel_id, a.user_id, n_reached AS highest_stage, ids[n_reached] AS last_event, count(*) FILTER (event_name = 'error') AS k, count(DISTINCT session) AS sessions
            FROM a LEFT JOIN x ON x.user_id = a.user_id AND x.ts BETWEEN a.entry_ts AND a.exit_ts WHERE status <> 'completed' GROUP BY ALL""")),
    "funnel_paid_stage": (lambda spark, sf: paid_attempts(spark, sf).select("funnel_id", "user_id", "entry_ts", "exit_ts", "n_reached", "status", "seconds"), _over("SELECT funnel_id, user_id, entry_ts, exit_ts, n_reached, status, seconds FROM a", PAID, _PAID)),
    "funnel_diagnostics": (lambda spark, sf: op.diagnostics(attempts(spark, sf), funnel_segment_metrics(spark, sf)), _over(
        "SELECT count(DISTINCT funnel_id) AS funnels, count(*) AS attempts, " + ", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in ("completed", "abandoned", "incomplete", "censored")) + ", (SELECT count(*) FROM ("
        + " UNION ALL ".join(f"SELECT count(*) AS n FROM a JOIN u USING (user_id) GROUP BY funnel_id, {d}" for d in DIMENSIONS) + f") WHERE n < {SUPPRESSION}) AS suppressed_segments FROM a")),
    "funnel_invariants": (lambda spark, sf: op.broken_attempts(attempts(spark, sf)).groupBy("rule").agg(F.count("*").alias("n")), _over("SELECT '' AS rule, 0 AS n FROM a WHERE exit_ts < entry_ts")),
    "funnel_reconciliation": (lambda spark, sf: op.broken_summary(funnel_summary(spark, sf), funnel_stage_metrics(spark, sf)), _over("SELECT funnel_id, '' AS rule FROM el WHERE eligible < (SELECT count(*) FROM a WHERE a.funnel_id = el.funnel_id)")),
}
