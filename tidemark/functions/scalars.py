"""Column expressions shared by all operators. Rounding is half to even throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rate(a: Column | str, b: Column | str) -> Column:
    """a / b to six places; null where b is zero."""
    return F.bround(col(a) / F.nullif(col(b), F.lit(0)), 6)


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b to six places; 0 where b is zero."""
    return F.coalesce(rate(a, b), F.lit(0.0))


def probability(p: Column | str) -> Column:
    """Clipped to [0, 1], four places, no negative zero."""
    return F.bround(F.least(F.greatest(col(p), F.lit(0.0)), F.lit(1.0)), 4) + F.lit(0.0)


def seconds_between(a: Column | str, b: Column | str) -> Column:
    return F.timestamp_diff("SECOND", col(a), col(b))


def days_floor(a: Column | str, b: Column | str) -> Column:
    """Whole days of 24 hours from a to b, rounded down for either sign."""
    return F.floor(seconds_between(a, b) / 86400)


def iso_utc(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def period_start(ts: Column | str, unit: str) -> Column:
    """Calendar day, Monday or first of month that holds a time."""
    return F.date_trunc({"daily": "DAY", "weekly": "WEEK", "monthly": "MONTH"}[unit], ts)


def period_index(anchor: Column | str, ts: Column | str, unit: str) -> Column:
    """Number of periods from the anchor's calendar period to that of a time."""
    a, b = period_start(anchor, unit), period_start(ts, unit)
    if unit == "monthly":
        return (F.year(b) * 12 + F.month(b) - F.year(a) * 12 - F.month(a)).cast("int")
    days = F.datediff(b, a)
    return (days if unit == "daily" else F.floor(days / 7)).cast("int")


def period_label(ts: Column | str, unit: str) -> Column:
    """2025-01-31, 2025-W05 (ISO year and week) or 2025-01."""
    ts = col(ts)
    if unit == "weekly":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.extract(F.lit("WEEK"), ts).cast("string"), 2, "0"))
    return F.date_format(ts, "yyyy-MM-dd" if unit == "daily" else "yyyy-MM")


def add_periods(ts: Column | str, n: Column | str, unit: str) -> Column:
    n = col(n).cast("int")
    made = {"daily": {"days": n}, "weekly": {"weeks": n}, "monthly": {"months": n}}[unit]
    return (period_start(ts, unit) + F.make_interval(**made)).cast("timestamp_ntz")


def fingerprint(*names: str) -> Column:
    """sha256 of the compact JSON of some columns with sorted keys, nulls included."""
    return F.sha2(F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"}), 256)


def sentence(code: Column | str) -> Column:
    """Underscores to spaces, first letter upper case."""
    words = F.replace(col(code), F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.expr("lower(substring({0}, 2))".format("replace(" + code + ", '_', ' ')")) if isinstance(code, str) else F.lower(F.substr(words, F.lit(2))))


def nearest_rank(df: DataFrame, keys: list[str], value: str, levels: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles per group: the value at index (n - 1) p, rounded half to even.

    Goes through counts per distinct value, which combine before they are shuffled, so no group is gathered.
    Adds n, low and high of the group; null values don't count.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*keys)
    counts = counts.withColumn("_upto", F.sum("_n").over(group.orderBy(value))).withColumn("_all", F.sum("_n").over(group))
    wanted = lambda p: F.bround((F.col("_all") - 1) * p, 0) + 1
    return counts.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"),
        *(F.min(F.when(F.col("_upto") >= wanted(p), F.col(value))).alias(name) for name, p in levels.items()),
    )


def unpivoted(df: DataFrame, keep: list[str], dimensions: list[str]) -> DataFrame:
    """One row per dimension: keep, dimension, value. A null value is the text None, as strings of values are."""
    return df.unpivot(keep, [F.coalesce(F.col(d).cast("string"), F.lit("None")).alias(d) for d in dimensions], "dimension", "value")
