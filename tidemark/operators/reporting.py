"""Reporting layer: facts and dimensions with lineage, derived metrics, insight texts and their governance, and checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import rate

LINEAGE = ["domain", "record_key", "label", "source", "synthetic"]
#: Fixed value: the notice that every insight carries.
DISCLAIMER = "Derived from data without real users; associations are descriptive and not causal."


def titled(code: Column) -> Column:
    return F.initcap(F.replace(code, F.lit("_"), F.lit(" ")))


def fact(rows: DataFrame, domain: str, key: Column, label: Column, source: str, measures: list[str]) -> DataFrame:
    """Rows of one fact: where each comes from, whether it is synthetic, and its measures."""
    return rows.select(F.lit(domain).alias("domain"), key.alias("record_key"), label.alias("label"), F.lit(source).alias("source"), F.lit(True).alias("synthetic"), *measures)


def first_rows(rows: DataFrame, order: list[str], n: int = 24) -> DataFrame:
    """The first n rows in an order, which is what a report shows of a long table."""
    return rows.orderBy(*order).limit(n)


def normalised(value: Column) -> Column:
    """A number in a text without superfluous places: whole ones as such, others to six places; other texts stay, null becomes empty."""
    x = value.try_cast("double")
    whole = F.when(x == F.floor(x), F.floor(x).cast("string"))
    return F.when(value.isNull() | (value == ""), "").otherwise(F.coalesce(whole, F.bround(x, 6).cast("string"), value))


def of_domains(facts: dict[str, DataFrame], domains: list[str] | None) -> dict[str, DataFrame]:
    """Facts of the wanted domains, all without a wish; dimensions (dim_...) always stay."""
    return {name: df for name, df in facts.items() if not domains or name.startswith("dim_") or name.removeprefix("fact_") in domains}


def date_dimension(ts: DataFrame, column: str) -> DataFrame:
    """A row per day that occurs: key, year, quarter, month, ISO week and weekday."""
    day = F.to_date(column)
    rows = ts.select(day.alias("date")).where("date IS NOT NULL").distinct()
    return rows.select(F.date_format("date", "yyyyMMdd").cast("int").alias("date_key"), "date", F.year("date").alias("year"), F.quarter("date").alias("quarter"), F.month("date").alias("month"), F.weekofyear("date").alias("iso_week"), (F.weekday("date") + 1).alias("weekday"))


def domain_dimension(facts: dict[str, DataFrame]) -> DataFrame:
    """A row per fact: its domain, table, sources and rows."""
    out = None
    for name, df in facts.items():
        one = df.groupBy("domain").agg(F.count("*").alias("rows"), F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources")).withColumn("table", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@dataclass(frozen=True)
class Metric:
    """A measure of the semantic layer: a ratio of sums of a fact, or the mean of one measure."""

    name: str
    table: str
    grain: str
    numerator: str
    denominator: str = ""
    unit: str = "proportion"


def metric_values(metrics: list[Metric], facts: dict[str, DataFrame]) -> DataFrame:
    """metric_id, table, grain, unit and value of each metric over its whole fact; one of an unknown table or measure is an error."""
    out = None
    for m in metrics:
        if m.table not in facts or not {m.numerator, *([m.denominator] if m.denominator else [])} <= set(facts[m.table].columns):
            raise ValueError(f"{m.name}: no such table or measure")
        value = rate(F.sum(m.numerator), F.sum(m.denominator)) if m.denominator else F.bround(F.avg(m.numerator), 6)
        one = facts[m.table].agg(value.cast("double").alias("value")).select(F.lit(m.name).alias("metric_id"), F.lit(m.table).alias("table"), F.lit(m.grain).alias("grain"), F.lit(m.unit).alias("unit"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def extremes(rows: DataFrame, name: Column, value: str) -> DataFrame:
    """One row: the best and the lowest of a table by a value (the first in name order of equals), the upper median and the count."""
    v = F.col(value)
    ranked = rows.where(v.isNotNull()).withColumn("_n", F.row_number().over(Window.orderBy(value))).withColumn("_all", F.count("*").over(Window.partitionBy()))  # a report's table, not a data set
    return ranked.agg(
        F.min_by(name, F.struct((-v).alias("v"), name.alias("n"))).alias("best"), F.max(value).alias("best_value"), F.min_by(name, F.struct(v.alias("v"), name.alias("n"))).alias("lowest"), F.min(value).alias("lowest_value"),
        F.max(F.when(F.col("_n") == F.floor(F.col("_all") / 2) + 1, v)).alias("upper_median"), F.count("*").alias("n"),
    )


def insight(inputs: DataFrame, kind: str, title: str, summary: str, action: str, evidence: str, caveats: list[str]) -> DataFrame:
    """One insight row; ``summary`` is a format with %s for each column of ``inputs`` in order."""
    said = F.format_string(summary, *(F.col(c).cast("string") for c in inputs.columns))
    return inputs.select(
        F.lit(kind).alias("insight_type"), F.lit(title).alias("title"), said.alias("summary"), F.lit(action).alias("recommended_action"), F.array(F.lit(evidence)).alias("supporting_evidence"), F.array(*map(F.lit, caveats)).cast("array<string>").alias("caveats"), F.lit(DISCLAIMER).alias("disclaimer")
    )


def says(phrases: list[str]) -> Column:
    """Whether an insight's title, summary or action has one of some phrases."""
    text = F.lower(F.concat_ws(" ", "title", "summary", "recommended_action"))
    out = F.lit(False)
    for p in phrases:
        out |= text.contains(p)
    return out


def governance(insights: DataFrame, known: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """One row of checks over all insights (of each group by some columns), and whether all passed."""
    every = lambda c: F.coalesce(F.bool_and(c), F.lit(True))
    of = lambda kind: F.col("insight_type") == kind
    caveat = lambda kind, words: F.coalesce(F.bool_or(of(kind) & F.array_join("caveats", " ").contains(words)), F.lit(False))
    out = insights.groupBy(*by).agg(
        F.count("*").alias("insights"), every(F.size("supporting_evidence") > 0).alias("have_sources"), every(F.size(F.array_except("supporting_evidence", F.array(*map(F.lit, known)))) == 0).alias("sources_exist"), every(F.col("disclaimer") == DISCLAIMER).alias("disclaimer_present"),
        every(~says(["caused", "guaranteed"])).alias("no_causal_language"), every(~says(["will churn", "certain churn"])).alias("no_certain_churn"), every(~of("recommendation") | ~says(["probability", "will accept"])).alias("no_acceptance_probability"),
        caveat("segmentation", "analytical interpretations").alias("segment_caveat"), caveat("experiment", "sample-size").alias("experiment_caveat"),
    )
    checks = [c for c in out.columns if c not in ("insights", *by)]
    return out.withColumn("status", F.when(F.forall(F.array(*checks), lambda x: x), "passed").otherwise("failed"))


def risks(insights: DataFrame) -> DataFrame:
    """A row per insight and caveat, numbered within the insight."""
    return insights.select("insight_type", "title", F.posexplode("caveats").alias("number", "caveat")).withColumn("number", F.col("number") + 1)


def brief(insights: DataFrame) -> DataFrame:
    """One Markdown text: a heading, the summary and the action of every insight in order of type."""
    part = F.concat(F.lit("## "), "title", F.lit("\n\n"), "summary", F.lit("\n\nNext: "), "recommended_action")
    return insights.select("insight_type", part.alias("p")).agg(F.concat(F.lit("# Insights\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("insight_type", "p"))), lambda x: x["p"]), "\n\n")).alias("text"))


@dataclass(frozen=True)
class Relationship:
    many: str
    column: str
    one: str
    key: str


def checks(facts: dict[str, DataFrame], relationships: list[Relationship], metrics: list[Metric], visuals: dict[str, list[str]]) -> DataFrame:
    """(check, passed) over the star schema: unique keys, lineage, flags, known tables, every page with visuals."""
    found = []
    for name, df in facts.items():
        if name.startswith("fact_"):
            found.append(df.agg(F.lit(f"{name}: keys unique").alias("check"), (F.count("*") == F.countDistinct("record_key")).alias("passed")))
            found.append(df.agg(F.lit(f"{name}: synthetic").alias("check"), F.coalesce(F.bool_and("synthetic"), F.lit(True)).alias("passed")))
            found.append(df.agg(F.lit(f"{name}: lineage").alias("check"), F.coalesce(F.bool_and(F.col("source").isNotNull() & (F.col("source") != "")), F.lit(True)).alias("passed")))
    for r in relationships:
        ok = r.many in facts and r.one in facts and r.column in facts[r.many].columns and r.key in facts[r.one].columns
        some = next(iter(facts.values()))
        found.append(some.agg(F.count("*")).select(F.lit(f"{r.many}.{r.column} -> {r.one}.{r.key}").alias("check"), F.lit(ok).alias("passed")))
    some = next(iter(facts.values())).agg(F.count("*"))
    named = len({m.name for m in metrics}) == len(metrics) and all(m.table in facts for m in metrics)
    shown = all(tables and all(t in facts for t in tables) for tables in visuals.values())
    found += [some.select(F.lit("metrics unique and of known tables").alias("check"), F.lit(named).alias("passed")), some.select(F.lit("pages have visuals of known tables").alias("check"), F.lit(shown).alias("passed"))]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def rates_in_range(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, value) of rates outside of [0, 1]; null is no rate."""
    long = rows.unpivot([F.col(key).cast("string").alias("key")], [F.col(c).cast("double").alias(c) for c in columns], "column", "value")
    return long.where(~F.col("value").between(0, 1))
