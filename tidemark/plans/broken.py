"""Checks on results that are broken on purpose: every row is damaged in each way, and the rules that find it are counted.

On right results the checks return nothing, which shows nothing; here a check that overlooks a damage fails.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import insights as insight_op
from ..operators import reporting as report_op
from . import domains, experiments, funnels, retention

Damage = Callable[[DataFrame], DataFrame]


def found(rows: DataFrame, damages: dict[str, Damage], check: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """damage, keys and n: what a check says of the rows after each damage."""
    out = None
    for name, damage in damages.items():
        one = check(damage(rows)).groupBy(*keys).agg(F.count("*").alias("n")).select(F.lit(name).alias("damage"), *keys, "n")
        out = one if out is None else out.unionByName(one)
    return out


def having(**columns) -> Damage:
    return lambda rows: rows.withColumns({c: F.expr(x) for c, x in columns.items()})


ATTEMPTS: dict[str, Damage] = {
    "early_exit": having(exit_ts="CAST(entry_ts - INTERVAL 1 SECOND AS TIMESTAMP_NTZ)"), "twice": lambda rows: rows.unionByName(rows),
    "reversed": having(stage_times="reverse(array_compact(stage_times))"), "gap": having(stage_times="transform(stage_times, (t, i) -> IF(i = 1, NULL, t))"),
}
LONG: dict[str, Damage] = {"censored": having(censored="censored + 1"), "retained": having(retained="observed + 1"), "rates": having(rate="rate + 1")}
TESTED: dict[str, Damage] = {"p": having(p_value="p_value + 1.5"), "interval": having(low="1D", high="0D"), "rates": having(control_value="control_value + 2")}
#: Damages of summaries, then of stages.
SUMMARY: dict[str, Damage] = {"eligible": having(eligible="entrants - 1"), "statuses": having(completed="completed + 1"), "rates": having(entry_rate="entry_rate + 1")}
INSIGHTS = {
    "causal": ("summary", "concat(summary, ' It caused the change.')", "summary || ' It caused the change.'"), "certain": ("summary", "concat(summary, ' They will churn.')", "summary || ' They will churn.'"),
    "accepting": ("recommended_action", "'Show it: they will accept.'", "'Show it: they will accept.'"), "unknown_source": ("supporting_evidence", "array('nowhere')", "'nowhere'"),
    "no_source": ("supporting_evidence", "CAST(array() AS array<string>)", "''"), "no_disclaimer": ("disclaimer", "''", "''"), "no_caveats": ("caveats", "CAST(array() AS array<string>)", "''"),
}


def funnel_attempts(spark, sf):
    return found(funnels.attempts(spark, sf), ATTEMPTS, funnels.op.broken_attempts, ["rule"])


def funnel_summaries(spark, sf):
    totals, stages = funnels.funnel_summary(spark, sf), funnels.funnel_stage_metrics(spark, sf)
    rows = found(totals, SUMMARY, lambda x: funnels.op.broken_summary(x, stages), ["funnel_id", "rule"])
    return rows.unionByName(found(stages, {"reach": having(reached="previous + 1")}, lambda x: funnels.op.broken_summary(totals, x), ["funnel_id", "rule"]))


def retention_long(spark, sf):
    return found(retention.op.long(retention.periods(spark, sf), retention.SUPPRESSION), LONG, retention.op.broken_retention, ["definition_id", "rule"])


def experiment_tests(spark, sf):
    return found(experiments.tests(spark, sf), TESTED, lambda x: experiments.op.broken_outputs(x, experiments.BINARY), ["experiment", "metric", "rule"])


#: The artifacts that insights may cite.
KNOWN = sorted({e for t in insight_op.TEMPLATES for e in t.evidence})
CHECKS = ["have_sources", "sources_exist", "disclaimer_present", "no_causal_language", "no_certain_churn", "no_acceptance_probability", "segment_caveat", "experiment_caveat"]


def governance(spark, sf):
    """Per damage of all insights, the checks over them."""
    rows = insight_op.generated(insight_op.inputs(domains.read_queries(spark, sf)))
    rows = rows.withColumn("damage", F.explode(F.array(*map(F.lit, ["none", *INSIGHTS]))))
    columns = {c for c, _, _ in INSIGHTS.values()}
    spoiled = {c: "CASE " + " ".join(f"WHEN damage = '{d}' THEN {x}" for d, (of, x, _) in INSIGHTS.items() if of == c) + f" ELSE {c} END" for c in columns}
    return report_op.governance(having(**spoiled)(rows), KNOWN, ("damage",)).select("damage", "insights", *CHECKS, "status")


def _counts(table: str, parts: list[tuple[str, str, str, str]], keys: str = "") -> str:
    """A statement that counts, by damage and rule, the rows of a condition."""
    k = f"{keys}, " if keys else ""
    body = " UNION ALL ".join(f"SELECT '{d}' AS damage, {k}'{r}' AS rule, count(*) AS n FROM {t or table} WHERE {c} GROUP BY ALL" for d, r, c, t in parts)
    return f"SELECT * FROM ({body}) WHERE n > 0"


_ATTEMPTS = funnels._over(_counts("a", [
    ("early_exit", "EXIT_BEFORE_ENTRY", "true", ""), ("early_exit", "COMPLETION_NOT_LAST_STAGE", "status = 'completed'", ""), ("twice", "ATTEMPT_ID_REPEATED", "true", ""),
    ("reversed", "STAGES_OUT_OF_ORDER", "n_reached >= 2", ""), ("reversed", "COMPLETION_NOT_LAST_STAGE", "status = 'completed'", ""), ("gap", "STAGE_SKIPPED", "n_reached >= 3", ""),
]))
_FS, _ST = (f"({funnels.QUERIES[q][1]})" for q in ("funnel_summary", "funnel_stage_metrics"))
_SUMMARY = _counts(_FS, [("eligible", "ENTRANTS_ABOVE_ELIGIBLE", "true", ""), ("statuses", "STATUS_SUM", "true", ""), ("rates", "RATE_RANGE:entry_rate", "NOT entry_rate + 1 BETWEEN 0 AND 1", ""), ("reach", "REACH_GROWS", "true", f"(SELECT DISTINCT funnel_id FROM {_ST})")], "funnel_id")
_LONG = retention._over(_counts("l", [("censored", "OBSERVED_PLUS_CENSORED", "true", ""), ("retained", "RETAINED_ABOVE_OBSERVED", "true", ""), ("retained", "ROLLING_BELOW_CLASSIC", "rolling_retained < observed + 1", ""), ("rates", "RATE_RANGE:rate", "NOT rate + 1 BETWEEN 0 AND 1", "")], "definition_id"))
_TESTED = experiments._over(_counts("pv", [("p", "P_RANGE", "true", ""), ("p", "ADJUSTED_BELOW_P", "true", ""), ("interval", "INTERVAL_ORDER", "true", ""), ("rates", "RATE_RANGE", "metric = 'converted'", "")], "experiment, metric"), *experiments._EF, "pv")


def _governance() -> str:
    says = lambda *words: "(" + " OR ".join(f"contains(lower(concat_ws(' ', title, summary, recommended_action)), '{w}')" for w in words) + ")"
    known = "[" + ", ".join(f"'{k}'" for k in KNOWN) + "]"
    checks = {
        "have_sources": "bool_and(evidence <> '')", "sources_exist": f"bool_and(evidence = '' OR list_has_all({known}, string_split(evidence, '|')))", "disclaimer_present": "bool_and(disclaimer = '" + report_op.DISCLAIMER + "')",
        "no_causal_language": f"bool_and(NOT {says('caused', 'guaranteed')})", "no_certain_churn": f"bool_and(NOT {says('will churn', 'certain churn')})", "no_acceptance_probability": f"bool_and(insight_type <> 'recommendation' OR NOT {says('probability', 'will accept')})",
        "segment_caveat": "bool_or(insight_type = 'segmentation' AND contains(caveats, 'analytical interpretations'))", "experiment_caveat": "bool_or(insight_type = 'experiment' AND contains(caveats, 'sample-size'))",
    }
    names = {"supporting_evidence": "evidence"}
    spoiled = " UNION ALL ".join(["SELECT 'none' AS damage, * FROM i"] + [f"SELECT '{d}' AS damage, * REPLACE ({x} AS {names.get(c, c)}) FROM i" for d, (c, _, x) in INSIGHTS.items()])
    said = ", ".join(f"{x} AS {n}" for n, x in checks.items())
    return f"WITH i AS MATERIALIZED ({domains.INSIGHTS_SQL}), d AS ({spoiled}) SELECT *, CASE WHEN {' AND '.join(checks)} THEN 'passed' ELSE 'failed' END AS status FROM (SELECT damage, count(*) AS insights, {said} FROM d GROUP BY damage)"


QUERIES = {
    "funnel_invariants_damaged": (funnel_attempts, _ATTEMPTS), "funnel_reconciliation_damaged": (funnel_summaries, _SUMMARY), "retention_reconciliation_damaged": (retention_long, _LONG),
    "experiment_output_checks_damaged": (experiment_tests, _TESTED), "report_governance_damaged": (governance, _governance()),
}
