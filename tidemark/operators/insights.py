"""Insights from the results of all domains: one-row inputs, templates as data, and the providers that word them.

Inputs are one row that Spark computes; templates are filled in by Spark too, so an insight is a row like any other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_div
from .recommend import chosen
from .reporting import DISCLAIMER, extremes

Read = Callable[[str], DataFrame]
#: The artifacts that insights are built from, by domain.
REQUIRED = {
    "analyse-funnels": ("funnel-summary",), "analyse-retention": ("cohort-summary",), "train-churn-model": ("evaluation-metrics", "feature-importance"),
    "segment-users": ("segment-profiles",), "build-recommendations": ("model-comparison",), "analyse-experiments": ("decision-summary", "guardrail-results"),
}


def shown(value: str) -> Column:
    """A number as insights show it, with four places; null stays null."""
    return F.when(F.col(value).isNotNull(), F.format_string("%.4f", F.bround(F.col(value).cast("double"), 4)))


def inputs(read: Read) -> DataFrame:
    """One row of texts for all templates, columns named by domain; ``read`` gives the table of an artifact id. An empty table gives nulls."""

    def ends(rows: DataFrame, name: Column, value: str, to: str) -> DataFrame:
        found = extremes(rows, name, value)
        return found.select(F.col("best").alias(f"{to}_best"), shown("best_value").alias(f"{to}_best_value"), F.col("lowest").alias(f"{to}_lowest"), shown("lowest_value").alias(f"{to}_lowest_value"), shown("upper_median").alias(f"{to}_median"), F.col("n").cast("string").alias(f"{to}_n"))

    top = read("train-churn-model/feature-importance").agg(F.min_by("feature", F.struct((-F.col("importance")).alias("i"), F.col("feature").alias("f"))).alias("churn_feature"), F.max("importance").alias("importance")).select("churn_feature", shown("importance").alias("churn_importance"))
    quality = read("train-churn-model/evaluation-metrics").agg(F.max("f1").alias("f1")).select(shown("f1").alias("churn_f1"))
    sizes = read("segment-users/segment-profiles").groupBy("segment").agg(F.max("users").alias("users"))
    largest = sizes.agg(F.min_by("segment", F.struct((-F.col("users")).alias("u"), F.col("segment").alias("s"))).alias("segment_largest"), safe_div(F.max("users"), F.sum("users")).alias("share")).select("segment_largest", shown("share").alias("segment_share"))
    best = chosen(read("build-recommendations/model-comparison"), 0.5).where("selected").agg(F.min(F.struct("model", "ndcg", "recall")).alias("m")).select("m.*").select(F.col("model").alias("recommend_model"), shown("ndcg").alias("recommend_ndcg"), shown("recall").alias("recommend_recall"))
    counted = read("analyse-experiments/decision-summary").groupBy("decision").agg(F.count("*").alias("n"))
    decided = counted.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "decision", F.col("n").cast("string")))), ", ").alias("experiment_decisions"))  # a row per kind of decision
    harmed = read("analyse-experiments/guardrail-results").agg(F.count_if(F.col("status") == "fail").cast("string").alias("experiment_failures"))
    out = ends(read("analyse-funnels/funnel-summary"), F.col("funnel_id"), "completion_rate", "funnel")
    for one in (ends(read("analyse-retention/cohort-summary"), F.concat_ws(" ", "definition_id", "cohort"), "return_rate", "retention"), top, quality, largest, best, decided, harmed):
        out = out.join(F.broadcast(one))  # one row each
    return out


@dataclass(frozen=True)
class Template:
    """One insight: ``summary`` names columns of its input in braces, ``metrics`` maps a metric to the column with its value."""

    kind: str
    title: str
    summary: str
    evidence: tuple[str, ...]
    caveats: tuple[str, ...]
    action: str
    owner: str
    metrics: tuple[tuple[str, str], ...] = ()
    confidence: str = "medium"
    priority: str = "high"
    flags: tuple[str, ...] = ()


#: Texts of the template provider.
TEMPLATES = (
    Template("funnel", "Funnels differ in how many users finish", "{funnel_best} is finished most ({funnel_best_value}), {funnel_lowest} least ({funnel_lowest_value}).", ("analyse-funnels/funnel-summary",), ("Some funnels are entered by few users.",), "Find the step of the weakest funnel that loses most users.", "Product analytics", (("completion_rate", "funnel_best_value"),), flags=("small_sample", "descriptive_only")),
    Template("retention", "Cohorts differ in how many members return", "Half of {retention_n} cohorts return at {retention_median} or more; {retention_lowest} returns least ({retention_lowest_value}).", ("analyse-retention/cohort-summary",), ("Rates count observed periods only.",), "Compare what members of the weakest cohort did first.", "Growth analytics", (("return_rate", "retention_lowest_value"),), priority="medium", flags=("small_sample",)),
    Template("churn", "One feature weighs most in the churn model", "{churn_feature} weighs most ({churn_importance}); the model's F1 is {churn_f1}.", ("train-churn-model/evaluation-metrics", "train-churn-model/feature-importance"), ("Scores point at risks and are no certainties.",), "Take the strongest features as leads for research.", "Data science", (("importance", "churn_importance"), ("f1", "churn_f1")), "low", flags=("model_risk", "small_test_split")),
    Template("segmentation", "One segment is the largest", "{segment_largest} holds {segment_share} of the users.", ("segment-users/segment-profiles",), ("Segment names are analytical interpretations.",), "Plan for the largest segment first.", "Product management", (("population_share", "segment_share"),), flags=("interpretation_risk",)),
    Template("recommendation", "One recommender ranks best", "{recommend_model} is chosen with NDCG {recommend_ndcg} and recall {recommend_recall}.", ("build-recommendations/model-comparison",), ("Scores rank items; they are not chances.",), "Look at coverage and reasons before users see lists.", "Recommendations", (("ndcg", "recommend_ndcg"), ("recall", "recommend_recall")), priority="medium", flags=("offline_only",)),
    Template("experiment", "What the experiments decide", "Decisions: {experiment_decisions}; guardrails failed: {experiment_failures}.", ("analyse-experiments/decision-summary", "analyse-experiments/guardrail-results"), ("Decisions depend on sample-size and guardrails.",), "Look into failed guardrails; go on with experiments that can show something.", "Experiment owner", (("guardrail_failures", "experiment_failures"),), flags=("guardrail_failure", "underpowered")),
    Template("cross_domain", "Where domains point together", "The weakest funnel ({funnel_lowest}), the strongest churn feature ({churn_feature}) and {experiment_failures} failed guardrails are one place to look.", ("analyse-funnels/funnel-summary", "train-churn-model/feature-importance", "analyse-experiments/guardrail-results"), ("Findings side by side prove no cause.",), "Open one investigation over these three.", "Product leadership", flags=("cross_domain_inference",)),
    Template("risk_caveat", "How far the evidence goes", "Results come from made data and offline analysis; {experiment_failures} guardrails failed.", ("segment-users/segment-profiles", "build-recommendations/model-comparison"), (DISCLAIMER,), "Have people review a decision before it is taken.", "Responsible analytics", confidence="high", flags=("synthetic_data", "offline_only")),
)


class Provider(Protocol):
    """What words insights: a name, the mode that its insights carry, and the account of what it was asked."""

    name: str
    mode: str

    def package(self, inputs: list[str]) -> dict: ...


@dataclass(frozen=True)
class TemplateProvider:
    name: str = "deterministic_template"
    mode: str = "deterministic_template"

    def package(self, inputs: list[str]) -> dict:
        return {"provider": self.name, "generation_mode": self.mode, "instruction": "State what the evidence shows, name the artifact and keep its caveats.", "input_sections": sorted(inputs), "llm_call_performed": False, "temperature": 0}


@dataclass(frozen=True)
class PlaceholderProvider:
    """Stands for a hosted model that is configured by the two variables it names; it calls nothing and falls back to the templates."""

    name: str = "hosted_placeholder"
    mode: str = "hosted_placeholder_no_call"
    settings: tuple[str, ...] = ("INSIGHT_ENDPOINT", "INSIGHT_DEPLOYMENT")

    def package(self, inputs: list[str]) -> dict:
        return {"provider": self.name, "generation_mode": self.mode, "instruction": "A model in this place keeps grounding, checks and logs of what it is asked.", "input_sections": sorted(inputs), "settings": list(self.settings), "llm_call_performed": False}


PROVIDERS: dict[str, Provider] = {p.name: p for p in (TemplateProvider(), PlaceholderProvider())}


def provider(name: str) -> Provider:
    if name not in PROVIDERS:
        raise ValueError(f"no provider {name}")
    return PROVIDERS[name]


def worded(t: Template, mode: str) -> Column:
    """The insight of one template as a struct over the input row; nulls show as an empty text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    pieces = [piece for part in t.summary.split("{") for piece in part.split("}")]  # texts and, at odd places, column names
    said = F.concat(*(text(p) if i % 2 else F.lit(p) for i, p in enumerate(pieces)))
    texts = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    metrics = F.array(*(F.concat(F.lit(f"{m}="), text(c)) for m, c in t.metrics)).cast("array<string>")
    return F.struct(
        F.concat(F.lit("insight_"), F.substring(F.sha2(F.concat_ws("|", F.lit(t.kind), said), 256), 1, 16)).alias("insight_id"), F.lit(t.kind).alias("insight_type"), F.lit(t.title).alias("title"), said.alias("summary"), texts(t.evidence).alias("supporting_evidence"), metrics.alias("supporting_metrics"),
        F.lit(t.confidence).alias("confidence"), texts(t.caveats).alias("caveats"), F.lit(t.action).alias("recommended_action"), F.lit(t.owner).alias("owner"), F.lit(t.priority).alias("priority"), texts(t.flags).alias("risk_flags"), F.lit(mode).alias("generation_mode"), F.lit(DISCLAIMER).alias("disclaimer"),
    )


def generated(row: DataFrame, name: str = "deterministic_template", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per template over the one row of inputs. A template that names an unknown input is an error of Spark's."""
    mode = provider(name).mode
    return row.select(F.inline(F.array(*(worded(t, mode) for t in templates))))
