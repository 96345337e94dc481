"""Domain result sets as declared data: the tables of every verb with their order, what may be chosen, and the documents beside them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import insights as insight_op
from ..operators import reporting as report_op
from ..sources import evidence, ingestion, published
from ..sources.published import Output
from . import churn, experiments, features, funnels, models, quality, recommend, reporting, retention


@dataclass(frozen=True)
class Table:
    """A registered query as a stored table."""

    query: str
    order: tuple[str, ...]
    format: str = "csv"


@dataclass(frozen=True)
class Choice:
    """An option that keeps the rows of some values of a column, in every table that has it."""

    column: str
    known: tuple[str, ...]


@dataclass(frozen=True)
class Domain:
    verb: str
    about: str
    inputs: tuple[str, ...]
    tables: dict[str, Table]
    choices: dict[str, Choice] = field(default_factory=dict)
    definitions: Callable[[], list] = list
    diagnostics: str = ""
    report: tuple[str, ...] = ()
    dialect: str = "plain"


_STAR = ("events", "customer", "nation", "region")
_SOLD = (*_STAR, "orders")
FUNNEL_IDS = tuple(f.name for f in funnels.FUNNELS)
DOMAINS = {d.verb: d for d in (
    Domain("analyse-funnels", "sequential funnels", _STAR, {
        "funnel-attempts": Table("funnel_attempts", ("funnel_id", "user_id"), "jsonl"), "funnel-summary": Table("funnel_summary", ("funnel_id",)), "funnel-stage-metrics": Table("funnel_stage_metrics", ("funnel_id", "stage")), "funnel-segment-metrics": Table("funnel_segment_metrics", ("funnel_id", "dimension", "value")),
        "funnel-time-metrics": Table("funnel_time_metrics", ("funnel_id", "stage")), "funnel-dropoff-analysis": Table("funnel_dropoff", ("funnel_id", "highest_stage")), "funnel-invariants": Table("funnel_invariants", ("rule",)),
    }, {"funnel": Choice("funnel_id", FUNNEL_IDS)}, lambda: [asdict(f) for f in funnels.FUNNELS], "funnel_diagnostics", ("funnel-summary", "funnel-stage-metrics", "funnel-dropoff-analysis")),
    Domain("analyse-retention", "cohort retention", _STAR, {
        "memberships": Table("retention_memberships", ("definition_id", "user_id"), "jsonl"), "user-periods": Table("retention_user_periods", ("definition_id", "user_id", "period"), "jsonl"), "retention-long": Table("g06_retention_long", ("definition_id", "cohort", "period")), "rolling-retention": Table("g06_retention_long", ("definition_id", "cohort", "period")),
        "retention-matrix": Table("retention_matrix", ("definition_id", "cohort")), "cohort-summary": Table("retention_cohort_summary", ("definition_id", "cohort")), "segment-retention": Table("retention_segments", ("definition_id", "cohort", "period", "dimension", "value")), "lifecycle-status": Table("lifecycle_status", ("definition_id", "user_id", "period")),
        "resurrection-analysis": Table("resurrection_summary", ("definition_id",)),
    }, {"definition": Choice("definition_id", tuple(retention.ANCHORS))}, lambda: [{"definition_id": d, "anchor_events": list(e)} for d, e in retention.ANCHORS.items()], "retention_diagnostics", ("cohort-summary", "resurrection-analysis")),
    Domain("train-churn-model", "churn features, models and their measures", _SOLD, {
        "feature-matrix": Table("churn_matrix", ("user_id",)), "labels": Table("churn_labels", ("user_id",)), "dataset-splits": Table("churn_splits", ("user_id",)), "predictions": Table("model_matrix_logistic", ("user_id",)), "evaluation-metrics": Table("churn_confusion", ()), "score-metrics": Table("churn_eval_metrics", ()),
        "threshold-analysis": Table("churn_threshold_table", ("threshold",)), "capacity-analysis": Table("churn_capacity", ("capacity",)), "calibration": Table("churn_calibration", ("bin",)), "subgroup-metrics": Table("churn_subgroups", ("persona",)), "feature-importance": Table("churn_importance", ("feature",)), "model-importance": Table("model_importance_logistic", ()), "risk-bands": Table("churn_risk_bands", ("band",)),
    }, definitions=lambda: [{"numeric": list(features.op.CHURN_NUMERIC), "categorical": list(features.op.CHURN_CATEGORICAL)}], report=("evaluation-metrics", "threshold-analysis", "feature-importance"), dialect="sorted"),
    Domain("segment-users", "rule segments and clusters", _SOLD, {
        "feature-matrix": Table("segment_matrix", ("user_id",)), "exclusions": Table("segment_exclusions", ("exclusion",)), "rule-assignments": Table("segment_rules", ("user_id",)), "segment-profiles": Table("segment_profiles", ("segment", "metric")), "differentiating-features": Table("segment_differentiating", ("segment", "rank")), "segment-distribution": Table("segment_distribution", ("segment",)),
        "cluster-centroids": Table("segment_centroids", ("segment", "feature")), "cluster-assignments": Table("model_user_clusters", ("user_id",)), "cluster-candidate-metrics": Table("model_cluster_choice", ()), "cluster-stability": Table("segment_adjusted_rand", ()), "segment-name-mapping": Table("segment_names", ("segment",)), "pca-explained-variance": Table("pca_explained_variance", ()),
    }, report=("segment-profiles", "differentiating-features"), dialect="sorted"),
    Domain("build-recommendations", "recommendation baselines", _SOLD, {
        "interactions": Table("interactions", ("user_id", "item"), "jsonl"), "eligible-candidates": Table("recommendation_eligible", ("user_id", "item")), "item-popularity": Table("item_popularity", ("item",)), "segment-popularity": Table("segment_popularity", ("segment", "item")), "item-similarity": Table("similar_items", ("item", "rank")), "recommendations-global": Table("recommendation_offers_global", ("user_id", "rank")),
        "recommendations-segment": Table("recommendation_offers_segment", ("user_id", "rank")), "recommendations-item-item": Table("recommendation_offers_item_item", ("user_id", "rank")), "recommendation-reasons": Table("recommendation_reasons", ("user_id", "rank")), "metrics-by-k": Table("ranking_metrics_at_k", ()), "segment-metrics": Table("recommendation_segment_measures", ("segment",)),
        "catalogue-coverage": Table("catalogue_coverage", ()), "cold-start-metrics": Table("recommendation_cold_start", ()), "novelty": Table("recommendation_novelty", ()), "diversity": Table("recommendation_diversity", ()), "model-comparison": Table("recommendation_comparison", ("model",)), "model-choice": Table("recommendation_model_choice", ("model",)), "output-checks": Table("recommendation_invariants", ("rule",)),
    }, report=("model-comparison", "catalogue-coverage"), dialect="rounded"),
    Domain("analyse-experiments", "controlled experiments", _SOLD, {
        "assignment-integrity": Table("experiment_integrity", ("experiment", "user_id")), "exposures": Table("experiment_exposure", ("experiment", "user_id"), "jsonl"), "populations": Table("experiment_population", ("experiment", "population", "variant")), "outcomes": Table("experiment_outcomes", ("experiment", "population", "user_id", "metric"), "jsonl"), "sample-ratio": Table("experiment_srm_p", ("experiment",)),
        "metric-results": Table("experiment_tests", ("experiment", "population", "metric", "treatment")), "metric-statuses": Table("experiment_statuses", ("experiment", "population", "metric", "treatment")), "segment-effects": Table("experiment_segment_effects", ("experiment", "dimension", "value")), "guardrail-results": Table("experiment_guardrails", ("experiment", "treatment", "metric")),
        "guardrail-summary": Table("experiment_guardrail_summary", ("experiment", "treatment")), "power-analysis": Table("experiment_power", ("experiment",)), "decision-summary": Table("experiment_decisions", ("experiment", "treatment")), "output-checks": Table("experiment_output_checks", ("experiment", "metric")),
    }, {"experiment": Choice("experiment", tuple(experiments.VARIANTS)), "population": Choice("population", ("intention_to_treat", "exposed"))}, lambda: [{"experiment": e, "variants": v, "metrics": list(experiments.METRICS)} for e, v in experiments.VARIANTS.items()], "experiment_diagnostics", ("decision-summary", "guardrail-results"), "sorted"),
)}


def _known() -> dict:
    return {n: q for m in (funnels, retention, quality, churn, features, recommend, experiments, models, reporting) for n, (q, _) in m.QUERIES.items()}


def chosen(rows: DataFrame, domain: Domain, wanted: dict[str, list[str]]) -> DataFrame:
    """Rows of the wanted values; a value that is not known is an error."""
    for option, values in wanted.items():
        choice = domain.choices[option]
        if bad := sorted(set(values) - set(choice.known)):
            raise ValueError(f"unknown {option}: {', '.join(bad)}")
        if values and choice.column in rows.columns:
            rows = rows.where(F.col(choice.column).isin(*values))
    return rows


def as_report(title: str, tables: dict[str, list[dict]]) -> str:
    """One Markdown document with a section per table."""
    parts = [ingestion.markdown(name, rows).replace("# ", "## ", 1) if rows else f"## {name}\n\nNo rows.\n" for name, rows in tables.items()]
    return f"# {title}\n\n{report_op.DISCLAIMER}\n\n" + "\n".join(parts)


def shown(rows: DataFrame, order: tuple[str, ...], n: int = 24) -> list[dict]:
    """The first rows of a table in its order, as a report shows them."""
    return [r.asDict(True) for r in published.in_order(rows, order).limit(n).collect()]


def run(spark: SparkSession, verb: str, tables: str, target: str, wanted: dict[str, list[str]] | None = None, only: list[str] | None = None, overwrite: bool = False, at: str | None = None, run_id: str | None = None) -> dict:
    """The result set of a verb below ``target``: all tables (or ``only`` some), definitions, diagnostics and a report of what was written."""
    domain, known, wanted = DOMAINS[verb], _known(), wanted or {}
    if bad := sorted(set(only or ()) - set(domain.tables)):
        raise ValueError(f"unknown tables: {', '.join(bad)}")
    kept = {n: t for n, t in domain.tables.items() if not only or n in only}
    outputs = {n: Output(chosen(known[t.query](spark, tables), domain, wanted), t.order, t.format, domain.dialect if t.format == "csv" else "plain") for n, t in kept.items()}
    folder = f"{target}/{verb}"
    if published.exists(spark, folder) and not overwrite:
        raise FileExistsError(f"{folder} holds files; pass overwrite")
    if made := domain.definitions():
        outputs["definitions"] = Output(made, format="json")
    if domain.diagnostics:
        outputs["diagnostics"] = Output(known[domain.diagnostics](spark, tables).first().asDict(), format="json")  # one row
    told = {n: shown(outputs[n].rows, kept[n].order) for n in domain.report if n in kept}
    outputs["executive-report"] = Output(as_report(domain.about.capitalize(), told), format="md")
    counts = {name: spark.read.parquet(f"{tables}/{name}.parquet").count() for name in domain.inputs}
    config = {"verb": verb, "tables": tables, "choices": wanted, "only": sorted(kept)}
    return published.publish(spark, folder, verb, config, outputs, counts, overwrite, at, run_id)


def insights(spark: SparkSession, root: str, target: str, provider: str = "deterministic_template", overwrite: bool = False, at: str | None = None, run_id: str | None = None) -> dict:
    """Insights from the stored result sets below ``root``: texts, governance, caveats, health, brief and what the provider was asked."""
    found = evidence.load(spark, root, insight_op.REQUIRED)
    given = insight_op.inputs(found.table)
    rows = insight_op.generated(given, provider)
    ids = [x["artifact_id"] for x in found.inventory()]
    checked = report_op.governance(rows, ids)
    brief = report_op.brief(rows).first()[0]
    outputs = {
        "grounded-insights": Output(rows, ("insight_type",), "jsonl"), "risk-and-caveat-register": Output(report_op.risks(rows), ("insight_type", "number")), "insight-governance-checks": Output(checked.first().asDict(), format="json"),
        "evidence-inventory": Output(found.inventory(), format="json"), "prompt-package": Output(insight_op.provider(provider).package(given.columns), format="json"), "product-manager-action-brief": Output(brief, format="md"),
    }
    config = {"verb": "generate-product-insights", "root": root, "provider": provider, "evidence": {m: x["config_fingerprint"] for m, x in found.manifests.items()}}
    return published.publish(spark, f"{target}/generate-product-insights", "generate-product-insights", config, outputs, {x["artifact_id"]: x["rows"] or 0 for x in found.inventory()}, overwrite, at, run_id)


def report(spark: SparkSession, tables: str, target: str, wanted: list[str] | None = None, overwrite: bool = False, at: str | None = None, run_id: str | None = None) -> dict:
    """The reporting layer: facts of the wanted domains, dimensions, metrics, checks, semantic model and pages."""
    every = reporting.facts(spark, tables)
    domains = sorted({n.removeprefix("fact_") for n in every if n.startswith("fact_")})
    if bad := sorted(set(wanted or ()) - set(domains)):
        raise ValueError(f"unknown domain: {', '.join(bad)}")
    kept = report_op.of_domains(every, wanted)
    metrics = [m for m in reporting.METRICS if m.table in kept]
    relations = [r for r in reporting.RELATIONSHIPS if r.many in kept]
    pages = {p: t for p, t in reporting.PAGES.items() if set(t) <= set(kept)}
    outputs = {n: Output(r, ("record_key",) if n.startswith("fact_") else (r.columns[0],), "csv", "sorted") for n, r in kept.items()}
    outputs |= {"metric-dictionary": Output(report_op.metric_values(metrics, kept), ("metric_id",)), "reporting-checks": Output(report_op.checks(kept, relations, metrics, pages), ("check",)), "dashboard-pages": Output(pages, format="json")}
    outputs["semantic-model"] = Output(semantic_model(kept, relations, metrics), format="json")
    config = {"verb": "build-reporting-layer", "tables": tables, "domains": wanted or domains}
    return published.publish(spark, f"{target}/build-reporting-layer", "build-reporting-layer", config, outputs, {n: spark.read.parquet(f"{tables}/{n}.parquet").count() for n in _SOLD}, overwrite, at, run_id)


def semantic_model(kept: dict[str, DataFrame], relations: list, metrics: list) -> dict:
    """Tables with role, key, grain and columns, relationships and measures."""
    grains = {m.table: m.grain for m in metrics}
    return {
        "tables": [{"table": n, "role": "dimension" if n.startswith("dim_") else "fact", "key": "record_key" if n.startswith("fact_") else r.columns[0], "grain": grains.get(n, n.split("_", 1)[1]), "columns": [[c, t] for c, t in r.dtypes]} for n, r in sorted(kept.items())],
        "relationships": [asdict(r) | {"cardinality": "many_to_one"} for r in relations], "measures": [asdict(m) for m in metrics],
    }


_QUERY = {f"{d.verb}/{n}": t.query for d in DOMAINS.values() for n, t in d.tables.items()}


def read_queries(spark: SparkSession, sf: str) -> insight_op.Read:
    """Artifacts as the queries themselves, without stored files."""
    known = _known()
    return lambda artifact: known[_QUERY[artifact]](spark, sf)


def grounded(spark, sf):
    return insight_op.generated(insight_op.inputs(read_queries(spark, sf))).select("insight_type", "title", "summary", F.array_join("supporting_metrics", "|").alias("metrics"), F.array_join("supporting_evidence", "|").alias("evidence"), F.array_join("caveats", "|").alias("caveats"))


def _sql() -> str:
    q = {n: s for m in (funnels, retention, churn, recommend, experiments) for n, (_, s) in m.QUERIES.items()}
    f = lambda x: f"printf('%.4f', round_even(({x})::DOUBLE, 4))"
    ends = lambda t, n, v, to: f"SELECT (SELECT {n} FROM {t} WHERE {v} IS NOT NULL ORDER BY {v} DESC, {n} LIMIT 1) AS {to}_best, {f(f'max({v})')} AS {to}_best_value, (SELECT {n} FROM {t} WHERE {v} IS NOT NULL ORDER BY {v}, {n} LIMIT 1) AS {to}_lowest, {f(f'min({v})')} AS {to}_lowest_value, {f(f'(list({v} ORDER BY {v}))[count(*) // 2 + 1]')} AS {to}_median, count(*) AS {to}_n FROM {t} WHERE {v} IS NOT NULL"
    ctes = {
        "fs": q["funnel_summary"], "cs": q["retention_cohort_summary"], "im": q["churn_importance"], "cf": q["churn_confusion"], "pr": q["segment_profiles"], "cp": q["recommendation_comparison"], "ch": q["recommendation_model_choice"], "ds": q["experiment_decisions"], "gr": q["experiment_guardrails"],
        "i1": ends("fs", "funnel_id", "completion_rate", "funnel"), "i2": ends("cs", "definition_id || ' ' || cohort", "return_rate", "retention"),
        "i3": f"SELECT (SELECT feature FROM im ORDER BY importance DESC, feature LIMIT 1) AS churn_feature, {f('(SELECT max(importance) FROM im)')} AS churn_importance, {f('(SELECT f1 FROM cf)')} AS churn_f1",
        "i4": f"SELECT segment AS segment_largest, {f('round_even(users / (SELECT sum(u) FROM (SELECT max(users) AS u FROM pr GROUP BY segment)), 6)')} AS segment_share FROM pr ORDER BY users DESC, segment LIMIT 1",
        "i5": f"SELECT model AS recommend_model, {f('cp.ndcg')} AS recommend_ndcg, {f('recall')} AS recommend_recall FROM ch JOIN cp USING (model) WHERE selected ORDER BY model LIMIT 1",
        "i6": "SELECT (SELECT string_agg(decision || ': ' || n, ', ' ORDER BY decision || ': ' || n) FROM (SELECT decision, count(*) AS n FROM ds GROUP BY decision)) AS experiment_decisions, (SELECT count(*) FROM gr WHERE status = 'fail') AS experiment_failures",
        "r": "SELECT * FROM i1, i2, i3, i4, i5, i6",
    }
    lit = lambda x: "'" + x.replace("'", "''") + "'"

    def line(t) -> str:
        pieces = [p for part in t.summary.split("{") for p in part.split("}")]
        said = " || ".join(f"coalesce({p}::VARCHAR, '')" if i % 2 else lit(p) for i, p in enumerate(pieces))
        metrics = " || '|' || ".join(f"'{m}=' || coalesce({c}::VARCHAR, '')" for m, c in t.metrics) or "''"
        return f"SELECT {lit(t.kind)} AS insight_type, {lit(t.title)} AS title, {said} AS summary, {metrics} AS metrics, {lit('|'.join(t.evidence))} AS evidence, {lit('|'.join(t.caveats))} AS caveats, {lit(t.action)} AS recommended_action, {lit(report_op.DISCLAIMER)} AS disclaimer FROM r"

    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({s})" for n, s in ctes.items()) + " " + " UNION ALL ".join(map(line, insight_op.TEMPLATES))


#: All columns of the insights as SQL, for statements over them.
INSIGHTS_SQL = _sql()
QUERIES = {"report_grounded_insights": (grounded, f"SELECT insight_type, title, summary, metrics, evidence, caveats FROM ({INSIGHTS_SQL})")}
