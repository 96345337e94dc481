"""Mixing sources to target weights in a tree of domain, language and source.

Every node hands its budget to its children by weight. A child that holds less than its share takes all it
holds, and what it leaves goes to its siblings by weight; only what a whole subtree can't take reaches the
siblings of the node above. That is water filling from the root down, with each node's capacity the sum of
its leaves'. Leaves then read their documents in seeded epochs up to their budget.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEVELS = ("domain", "lang", "source")
SEED, MAX_EPOCHS, BUDGET_PERCENT, SALTS = 1729, 3, 60, 16
#: Production weights; a name that is not listed weighs 1, a weight of 0 keeps a branch out.
WEIGHTS: dict[str, dict[str, int]] = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 6, "de": 3, "fr": 3, "es": 2}, "source": {}}
#: The tables name sources src<number>; four domains take them in turn, a source without a number is in domain dx.
DOMAIN_OF = "coalesce('d' || pmod(try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) AS INT), 4), 'dx')"


def n_words(text: Column) -> Column:
    """Tokens of a text, as words between white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")).cast("long")


def sized(documents: DataFrame, domain: str = DOMAIN_OF) -> DataFrame:
    """doc_id, the three levels and n_tokens; a null level is an empty name, a null text has no tokens."""
    return documents.select("doc_id", F.expr(domain).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), n_words(F.col("text")).alias("n_tokens"))


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    out = F.lit(1)
    for name, weight in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, weight).otherwise(out)
    return out.cast("long")


def filled(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Budget of each child, of the parent's ``budget``, by ``weight`` and within ``capacity``; all whole numbers.

    Children ordered by capacity per weight fill up one after another, so the full ones are a prefix and
    running sums find it. Shares are rounded down. A child without capacity or weight comes first and gets nothing.
    """
    siblings = Window.partitionBy(*parent)
    order = siblings.orderBy(F.try_divide("capacity", "weight").asc_nulls_first(), name)
    sofar = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = (F.col("weight") > 0) & (F.col("capacity") > 0)
    rows = children.withColumn("weight", F.when(open_, F.col("weight")).otherwise(0)).withColumn("capacity", F.when(open_, F.col("capacity")).otherwise(0))
    left = F.col("budget") - (F.sum("capacity").over(sofar) - F.col("capacity"))
    weight_left = F.sum("weight").over(siblings) - (F.sum("weight").over(sofar) - F.col("weight"))
    rows = rows.withColumn("fits", F.col("capacity") * weight_left <= F.col("weight") * left)
    rows = rows.withColumn("full", F.bool_and("fits").over(sofar))
    rest = F.col("budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(siblings)
    rest_weight = F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(siblings)
    share = F.when(F.col("full"), F.col("capacity")).otherwise(F.expr("weight") * rest)
    rows = rows.withColumn("rest_weight", rest_weight).withColumn("share", share)
    return rows.withColumn("budget", F.when(F.col("full"), F.col("share")).otherwise(F.expr("share div rest_weight"))).drop("fits", "full", "rest_weight", "share")


def budgets(rows: DataFrame, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """A row per leaf: domain, lang, source, leaf_tokens and leaf_budget.

    ``percent`` of all tokens are the root's budget; a leaf may be read ``max_epochs`` times.
    """
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("leaf_tokens"))
    nodes = leaves.withColumn("capacity", F.col("leaf_tokens") * max_epochs)
    given, parent = None, []
    for i, level in enumerate(LEVELS):
        at = list(LEVELS[: i + 1])
        children = nodes.groupBy(*at).agg(F.sum("capacity").alias("capacity"), F.sum("leaf_tokens").alias("own")).withColumn("weight", _weight(level, weights))
        if given is None:
            children = children.withColumn("budget", F.sum("own").over(Window.partitionBy())).withColumn("budget", F.expr(f"budget * {percent} div 100"))
        else:
            children = children.join(given, parent)
        given = filled(children, parent, level).select(*at, "budget")
        parent = at
    return leaves.join(given, list(LEVELS)).withColumnRenamed("budget", "leaf_budget")


def mixed(documents: DataFrame, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED, domain: str = DOMAIN_OF) -> DataFrame:
    """A row per selected document: doc_id, levels, n_tokens, n_copies.

    A leaf is read whole while its budget lasts; then the documents of one more epoch, in that epoch's
    seeded order, as long as their tokens fit. The order's leading digits split each leaf into buckets whose
    sums come first, so the running sum of a leaf with a third of all rows is spread over all tasks.
    Documents without tokens come along with the epochs that reach them. Equal rows are taken one by one.
    """
    from .scratch import written

    rows = written(sized(documents, domain), "mixing")
    plan = budgets(rows, weights, percent, max_epochs).where("leaf_budget > 0").select(
        *LEVELS, F.expr("leaf_budget div leaf_tokens").alias("epochs"), F.expr("leaf_budget % leaf_tokens").alias("rest"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(plan, [*LEVELS, "salt"])
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("key", key).withColumn("bucket", F.substring("key", 1, 3))
    sums = rows.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("bucket_tokens"))
    earlier = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*LEVELS, "bucket", F.coalesce(F.sum("bucket_tokens").over(earlier), F.lit(0)).alias("before"))
    sofar = Window.partitionBy(*LEVELS, "bucket").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(sums, [*LEVELS, "bucket"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(sofar))
    copies = F.col("epochs") + F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0)
    return rows.select("doc_id", *LEVELS, "n_tokens", copies.cast("long").alias("n_copies")).where("n_copies > 0")


def oracle(weights: Mapping[str, Mapping[str, int]] = WEIGHTS, percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED, documents: str = "documents") -> str:
    """``mixed`` with the tables' own domains, as DuckDB SQL."""
    ctes, parent = [], []
    for i, level in enumerate(LEVELS):
        at = list(LEVELS[: i + 1])
        part = f"PARTITION BY {', '.join(parent)} " if parent else ""
        case = "CASE " + level + "".join(f" WHEN '{k}' THEN {v}" for k, v in weights[level].items()) + " ELSE 1 END" if weights.get(level) else "1"
        given = f"given{i - 1} USING ({', '.join(parent)})" if parent else f"(SELECT sum(leaf_tokens) * {percent} // 100 AS budget FROM leaves) ON true"
        order = f"OVER ({part}ORDER BY capacity / nullif(weight, 0) NULLS FIRST, {level} ROWS UNBOUNDED PRECEDING)"
        ctes.append(f"""
n{i} AS (SELECT {', '.join(at)}, capacity, {case} AS weight, budget FROM (SELECT {', '.join(at)}, sum(leaf_tokens) * {max_epochs} AS capacity FROM leaves GROUP BY ALL) JOIN {given}),
o{i} AS (SELECT * REPLACE (CASE WHEN weight > 0 AND capacity > 0 THEN weight ELSE 0 END AS weight, CASE WHEN weight > 0 AND capacity > 0 THEN capacity ELSE 0 END AS capacity) FROM n{i}),
s{i} AS (SELECT *, sum(capacity) {order} - capacity AS cap_before, sum(weight) {order} - weight AS weight_before, sum(weight) OVER ({part}) AS weight_all FROM o{i}),
f{i} AS (SELECT *, bool_and(capacity * (weight_all - weight_before) <= weight * (budget - cap_before)) {order} AS is_full FROM s{i}),
given{i} AS (SELECT {', '.join(at)}, CASE WHEN is_full THEN capacity ELSE weight * (budget - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({part})) // sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({part}) END AS budget FROM f{i})""")
        parent = at
    return f"""
WITH d AS (SELECT doc_id, coalesce('d' || (TRY_CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INT) % 4), 'dx') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM {documents}),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS leaf_tokens FROM d GROUP BY ALL),{','.join(ctes)},
p AS (SELECT domain, lang, source, budget // leaf_tokens AS epochs, budget % leaf_tokens AS rest FROM leaves JOIN given2 USING (domain, lang, source) WHERE budget > 0),
u AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}:' || epochs::BIGINT || ':' || coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, n_tokens ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN p USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, (epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS n_copies FROM u WHERE epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0
"""
