"""Rule-based user segments and their profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_rule(rules: dict[str, str], default: str) -> Column:
    """The name of the first rule that holds."""
    out = None
    for name, condition in rules.items():
        out = F.when(F.expr(condition), name) if out is None else out.when(F.expr(condition), name)
    return out.otherwise(default) if out is not None else F.lit(default)


def assigned(features: DataFrame, exclusions: dict[str, str], rules: dict[str, str], default: str) -> DataFrame:
    """Features with the first exclusion that holds (null if none) and the segment of those that stay."""
    excluded = first_rule(exclusions, "") if exclusions else F.lit("")
    rows = features.withColumn("exclusion", F.nullif(excluded, F.lit("")))
    return rows.withColumn("segment", F.when(F.col("exclusion").isNull(), first_rule(rules, default)))


def profiles(rows: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """Mean of each metric by group, long, with its difference from the mean of all; nothing is suppressed here."""
    long = rows.unpivot([group], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")
    means = long.groupBy(group, "metric").agg(F.count("*").alias("users"), F.bround(F.avg("value"), 6).alias("mean"))
    everyone = long.groupBy("metric").agg(F.bround(F.avg("value"), 6).alias("overall"))
    return means.join(everyone, "metric").select(group, "metric", "users", "mean", "overall", F.bround(F.col("mean") - F.col("overall"), 6).alias("difference"))


def differentiating(profile: DataFrame, group: str, k: int = 3) -> DataFrame:
    """The k metrics of each group that lie farthest from the overall mean, the later name first among equals, and on which side."""
    order = Window.partitionBy(group).orderBy(F.abs("difference").desc(), F.desc("metric"))
    side = F.concat("metric", F.when(F.col("difference") > 0, ":above_population").otherwise(":below_population"))
    return profile.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(group, "rank", "metric", F.abs("difference").alias("distance"), side.alias("label"))


def distribution(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Per group, shares of a value as text: value:share in order of the value."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    total = rows.groupBy(group).agg(F.count("*").alias("total"))
    part = F.concat(F.coalesce(F.col(value).cast("string"), F.lit("None")), F.lit(":"), F.format_string("%.4f", F.bround(F.col("n") / F.col("total"), 4)))
    return counts.join(total, group).groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), part.alias("p")))), lambda x: x["p"]), "|").alias("distribution"))


def modal(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value per group, the smallest of equally frequent ones."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), value)).alias("mode"))


def centroids(rows: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Mean of each feature in each group, long."""
    long = rows.unpivot([group], [F.col(f).cast("double").alias(f) for f in features], "feature", "value")
    return long.groupBy(group, "feature").agg(F.bround(F.avg("value"), 6).alias("centroid"))


def varying(rows: DataFrame, features: list[str]) -> DataFrame:
    """The features of more than one value, with their deviation."""
    got = rows.agg(*(F.bround(F.stddev_pop(F.col(f).cast("double")), 6).alias(f) for f in features))
    return got.unpivot([], features, "feature", "deviation").where("deviation > 0")


def named(rows: DataFrame, group: str, rules: dict[str, str], default: str) -> DataFrame:
    """Each group with the name of the first rule that holds of its means (g_<feature>) against all rows' (p_<feature>)."""
    features = [c for c, t in rows.dtypes if c != group and t in ("int", "bigint", "double")]
    mean = lambda p: [F.bround(F.avg(F.col(f).cast("double")), 6).alias(f"{p}{f}") for f in features]
    groups = rows.groupBy(group).agg(*mean("g_")).join(F.broadcast(rows.agg(*mean("p_"))))  # one row
    return groups.select(group, first_rule(rules, default).alias("name"))


def confidence(rows: DataFrame, group: str, features: list[str]) -> DataFrame:
    """user_id, distance of each row to its group's centre in standardised features, and 1 / (1 + distance)."""
    every = rows.agg(*(F.stddev_pop(F.col(f).cast("double")).alias(f"s_{f}") for f in features))
    centre = rows.groupBy(F.col(group).alias("_g")).agg(*(F.avg(F.col(f).cast("double")).alias(f"c_{f}") for f in features))
    held = rows.join(centre, F.col(group) == F.col("_g")).join(F.broadcast(every))  # one row
    square = sum((F.coalesce(F.pow((F.col(f) - F.col(f"c_{f}")) / F.nullif(F.col(f"s_{f}"), F.lit(0.0)), 2), F.lit(0.0)) for f in features), F.lit(0.0))
    distance = F.sqrt(square)
    return held.select("user_id", group, F.bround(distance, 6).alias("distance"), F.bround(1 / (1 + distance), 6).alias("confidence"))


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the adjusted Rand index of two labellings, from counts of pairs; 1 where both are trivial."""
    two = lambda n: n * (n - 1) / 2
    cells = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    both = cells.agg(F.sum(two(F.col("n"))).alias("both"), F.sum("n").alias("total"))
    side = lambda c, name: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias(name))
    got = both.join(F.broadcast(side(a, "left_pairs"))).join(F.broadcast(side(b, "right_pairs")))  # one row each
    expected = F.col("left_pairs") * F.col("right_pairs") / F.nullif(two(F.col("total")), F.lit(0.0))
    most = (F.col("left_pairs") + F.col("right_pairs")) / 2
    return got.select(F.bround(F.coalesce((F.col("both") - expected) / F.nullif(most - expected, F.lit(0.0)), F.lit(1.0)), 6).alias("adjusted_rand"))


def chosen_clusters(candidates: DataFrame, least_size: int) -> DataFrame:
    """Candidates (k, silhouette, stability, smallest) with status: rejected below a size, selected the best by silhouette, stability and fewer clusters."""
    ok = F.col("smallest") >= least_size
    order = Window.partitionBy(ok).orderBy(F.desc(F.coalesce("silhouette", F.lit(-1.0))), F.desc(F.coalesce("stability", F.lit(0.0))), "k")  # a row per candidate
    return candidates.withColumn("status", F.when(~ok, "rejected").when(F.row_number().over(order) == 1, "selected").otherwise("eligible"))
