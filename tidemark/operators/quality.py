"""Data-quality operators: rules within a row, across tables and across rows, duplicates and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ruled(rows: DataFrame, rules: dict[str, Column | str]) -> DataFrame:
    """Rows with the array of broken rules; a rule whose condition is null holds."""
    tests = [F.when(F.expr(c) if isinstance(c, str) else c, F.lit(name)) for name, c in rules.items()]
    return rows.withColumn("rules", F.array_compact(F.array(*tests)))


def status(rows: DataFrame) -> DataFrame:
    return rows.withColumn("record_status", F.when(F.size("rules") > 0, "quarantined").otherwise("accepted"))


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows of the child whose key the parent lacks; a null key is one."""
    there = parent.select(F.col(parent_key or key).alias(key)).distinct()
    return child.join(there, key, "left_anti")


def outside(rows: DataFrame, bounds: DataFrame, key: str | list[str], ts: str, start: str, end: str) -> DataFrame:
    """Rows whose time lies outside the interval of their key; rows without an interval are not judged."""
    return rows.join(bounds, key).where(~F.col(ts).between(F.col(start), F.col(end)))


def out_of_order(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value is not above the one before, in the order of the input within the keys."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("before", before).where(F.col("before") >= F.col(value))


def overlaps(rows: DataFrame, key: str, start: str, end: str, tie: str) -> DataFrame:
    """Periods that have no end or one after the start of the key's next period."""
    after = F.lead(start).over(Window.partitionBy(key).orderBy(start, tie))
    return rows.withColumn("next_start", after).where(F.col("next_start").isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col("next_start"))))


def unreconciled(stored: DataFrame, counted: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Keys for which two aggregates differ or only one has a row, with the measures of both."""
    left = stored.select(*keys, *(F.col(m).alias(f"stored_{m}") for m in measures), F.lit(True).alias("_l"))
    right = counted.select(*keys, *(F.col(m).alias(f"counted_{m}") for m in measures), F.lit(True).alias("_r"))
    same = F.lit(True)
    for m in measures:
        same &= F.col(f"stored_{m}").eqNullSafe(F.col(f"counted_{m}"))
    return left.join(right, keys, "full_outer").where(~(same & F.col("_l").isNotNull() & F.col("_r").isNotNull())).drop("_l", "_r")


def deduplicated(rows: DataFrame, keys: list[str], order: list[str], policy: str) -> DataFrame:
    """Rows with ``outcome``: accepted, quarantined or discarded.

    reject accepts no copy of a repeated key and quarantines all but the first, which is discarded; the keep
    policies accept the first or last copy and discard the others.
    """
    group = Window.partitionBy(*keys)
    rank = F.row_number().over(group.orderBy(*(F.col(o).desc() if policy == "keep_last" else F.col(o) for o in order)))
    if policy == "reject":
        outcome = F.when(F.count("*").over(group) == 1, "accepted").when(rank > 1, "quarantined").otherwise("discarded")
    elif policy in ("keep_first", "keep_last"):
        outcome = F.when(rank == 1, "accepted").otherwise("discarded")
    else:
        raise ValueError(f"no policy {policy}")
    return rows.withColumn("outcome", outcome)


def rule_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("rules").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("failures"))


def verdict(rows: DataFrame, dataset: str, max_rate: float, critical: list[str]) -> DataFrame:
    """One row: counts, quarantine rate and passed, passed_with_warnings or failed."""
    bad, worst = F.count_if(F.col("record_status") == "quarantined"), F.count_if(F.arrays_overlap("rules", F.array(*map(F.lit, critical))) if critical else F.lit(False))
    out = rows.agg(F.count("*").alias("records"), bad.alias("quarantined"), worst.alias("critical"))
    share = F.coalesce(F.bround(F.col("quarantined") / F.nullif(F.col("records"), F.lit(0)), 6), F.lit(0.0))
    out = out.withColumn("quarantine_rate", share).withColumn("dataset", F.lit(dataset))
    return out.withColumn("status", F.when((F.col("quarantine_rate") > max_rate) | (F.col("critical") > 0), "failed").when(F.col("quarantined") > 0, "passed_with_warnings").otherwise("passed"))
