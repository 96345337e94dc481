"""Segment and recommendation queries: part brands as items, order lines as interactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import offers
from ..operators import recommend as op
from ..operators import segmentation as seg
from ..sources import scratch
from . import churn, inputs
from .inputs import sql, table

SNAPSHOT, RECENT, SUPPORT, K = "1999-12-31 00:00:00", 365, 20, 5
EXCLUSIONS = {"no_activity": "n_events = 0", "few_days": "active_days < 3"}
RULES = {
    "at_risk": "days_since_activity >= 2 AND n_events >= 8", "troubled": "failure_share >= 0.3", "buyer": "n_purchase >= 5 AND value >= 800", "explorer": "n_features >= 14",
    "returning": "resurrections >= 2", "power": "n_events >= 18", "browser": "n_view > n_click",
}
NAMING = {"buyers": "g_n_purchase > p_n_purchase", "high_friction_users": "g_failure_share > p_failure_share", "high_engagement_power_users": "g_n_events > p_n_events", "inactive_or_declining_users": "g_days_since_activity > p_days_since_activity"}
METRICS = ["n_events", "active_days", "n_purchase", "failure_share", "value", "days_since_activity"]


def lines(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("o_custkey").alias("user_id"), F.col("p_brand").alias("item"), F.col("o_orderdate").alias("ts"), F.col("l_quantity").alias("weight"))


def found(spark, sf):
    return op.interactions(lines(spark, sf), SNAPSHOT)


def items(spark, sf):
    return table(spark, sf, "part").select(F.col("p_brand").alias("item")).distinct()


def baskets(spark, sf):
    return op.baskets(lines(spark, sf), SNAPSHOT, segments(spark, sf))


def popular(spark, sf):
    return op.popularity(found(spark, sf), SNAPSHOT, RECENT)


def pairs(spark, sf):
    return op.similarity(found(spark, sf), SUPPORT)


def held_out(spark, sf):
    return lines(spark, sf).where(F.col("ts") > F.lit(SNAPSHOT).cast("timestamp_ntz"))


def ranked(spark, sf):
    """Top lists by recent popularity of what a user has not had."""
    have = found(spark, sf)
    return op.top(op.popular_lists(have, have, popular(spark, sf).select("item", F.col("recent_score").alias("score")), K), K)


def by_score(spark, sf):
    have = found(spark, sf)
    return op.top(op.popular_lists(have, have, popular(spark, sf), K), K).withColumn("source", F.lit("global_popularity"))


def segments(spark, sf):
    return table(spark, sf, "customer").where("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))


def by_segment(spark, sf):
    have = found(spark, sf)
    users = op.with_segment(have.select("user_id").distinct(), segments(spark, sf))
    return op.top(op.by_segment(users, have, op.segment_popularity(have, segments(spark, sf)), popular(spark, sf), K), K)


def by_similarity(spark, sf):
    """From ``baskets``, popularity and pairs that are written once: the interactions are joined and grouped a single time."""
    held, share, near = written(spark, sf)
    return op.top(op.with_similar(held, near, share, K).select("user_id", F.inline("list")), K)


def written(spark, sf):
    """Scratch tables: ``baskets`` of who has interactions, popularity and similar pairs."""
    held = scratch.written(baskets(spark, sf).where("size(own) > 0"), "baskets")
    return held, scratch.written(op.popularity(op.unpacked(held), SNAPSHOT, RECENT), "popular"), scratch.written(op.similarity_of(held, SUPPORT), "similar")


def models(held, share, near):
    """Each model's lists as rows (user_id, wanted, list), from what ``written`` gives."""
    rows = held.withColumns({"had": F.col("own.item"), "segment": F.coalesce("segment", F.lit("unknown"))})
    own = op.segment_popularity(op.unpacked(held).where("segment IS NOT NULL").select("user_id", "item", "weight", "segment"))
    return {
        "global_popularity": op.with_popular(rows, share, K, "global_popularity"), "recent_popularity": op.with_popular(rows, share.select("item", F.col("recent_score").alias("score")), K, "recent_popularity"),
        "segment_popularity": op.with_segment_list(rows, rows.select("segment").distinct(), own, share, K), "item_item_cf": op.best_first(op.with_similar(held, near, share, K), K),
    }


def comparison(spark, sf):
    """A row per model, computed at once so that the scratch tables can go."""
    tables = written(spark, sf)
    try:
        rows = op.compared(models(*tables), items(spark, sf), tables[1], K)
        return spark.createDataFrame(rows.collect(), rows.schema)  # a row per model
    finally:
        for t in tables:
            scratch.dropped(t)


def catalogue(spark, sf):
    """Brands as a catalogue whose rules follow their number."""
    n = F.regexp_extract("item", "([0-9]+)$", 1).cast("int")
    none, strings = F.array().cast("array<string>"), lambda c: c.cast("array<string>")
    rows = items(spark, sf).withColumn("n", n)
    return rows.select(
        "item", F.concat(F.lit("c"), F.col("n") % 4).alias("category"), F.concat(F.lit("f"), F.col("n") % 3).alias("feature"), (F.col("n") % 7 != 3).alias("active"), (F.col("n") % 5 == 1).alias("repeatable"),
        strings(F.filter(F.array(*map(F.lit, range(1, 6))), lambda p: p >= F.col("n") % 5)).alias("plans"),
        F.when(F.col("n") % 6 == 2, strings(F.array(F.lit("BUILDING"), F.lit("MACHINERY")))).otherwise(none).alias("personas"), F.when(F.col("n") % 8 == 5, strings(F.array(F.lit("small")))).otherwise(none).alias("sizes"),
        F.when(F.col("n") % 9 == 4, strings(F.array(F.concat(F.lit("Brand#"), F.col("n") + 1)))).otherwise(none).alias("required"), F.when(F.col("n") % 10 == 6, strings(F.array(F.concat(F.lit("Brand#"), F.col("n") - 1)))).otherwise(none).alias("incompatible"),
    )


def context(spark, sf):
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("persona"), F.when(F.col("c_acctbal") < 2000, "small").otherwise("large").alias("size"), F.lit("0").alias("initial_plan"))
    plans = op.current_plan(people, inputs.subscriptions(spark, sf).withColumn("plan", F.col("plan").cast("string")), SNAPSHOT)
    return people.join(plans, "user_id")


def eligible(spark, sf):
    return op.eligible(context(spark, sf), catalogue(spark, sf), op.consumed(found(spark, sf), ["Brand#2"], 2))


#: Offers are made early, when most users are new and few pairs of items share users.
EARLY, EARLY_SUPPORT = "1995-02-01 00:00:00", 2


def offer_inputs(spark, sf):
    """What the models of offers read: users with plan and history, the catalogue, interactions and item scores."""
    have = op.consumed(op.interactions(lines(spark, sf), EARLY), ["Brand#2"], 2)
    items = catalogue(spark, sf).withColumn("priority", (F.regexp_extract("item", "([0-9]+)$", 1).cast("int") % 9 + 1).cast("double"))
    people = op.with_segment(offers.people(context(spark, sf), have), segments(spark, sf), op.history_segment(F.col("had")))
    return people, items, have, have.groupBy("item").agg(F.bround(F.sum("weight"), 6).alias("score")).where(F.col("item") != "Brand#11")


def offers_global(spark, sf):
    people, items, _, scores = offer_inputs(spark, sf)
    return op.top(offers.by_popularity(people, items, scores, K), K)


def offers_segment(spark, sf):
    people, items, have, scores = offer_inputs(spark, sf)
    own = op.with_segment(have, segments(spark, sf), op.history_segment(F.array("item"))).groupBy("segment", "item").agg(F.bround(F.sum("weight"), 6).alias("score"))
    return op.top(offers.by_segment(people, items, own, scores, K), K)


def offers_item_item(spark, sf):
    people, items, have, scores = offer_inputs(spark, sf)
    return op.top(offers.by_similarity(people, items, have, op.similarity(have, EARLY_SUPPORT), scores, K), K)


MAPPING = op.interaction_mapping({"view": ("item_view", None, "weak"), "click": ("item_click", "7", "medium"), "purchase": ("item_buy", None, "strong")}, {"weak": 1.0, "medium": 2.0, "strong": 5.0})
REASONS = {"segment_popularity": "popular_in_your_segment", "segment_global_fallback": "cold_start_popular_item"}


def assigned(spark, sf):
    return seg.assigned(churn.features(spark, sf), EXCLUSIONS, RULES, "casual")


_CASE = lambda rules, default: "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in rules.items()) + f" ELSE {default} END"
_SEG = f"SELECT *, CASE WHEN exclusion IS NULL THEN {_CASE(RULES, repr('casual'))} END AS segment FROM (SELECT *, {_CASE(EXCLUSIONS, 'NULL')} AS exclusion FROM f)"


def _users(body: str, **more: str) -> str:
    return sql(body, "e", "u", **{k: churn._ALL[k] for k in ("p", "n", "f")}, sg=_SEG, **more)


_PROFILE = (
    "SELECT segment, metric, users, mean, overall, round_even(mean - overall, 6) AS difference FROM (" + " UNION ALL ".join(f"SELECT segment, '{m}' AS metric, count(*) AS users, round_even(avg({m}::DOUBLE), 6) AS mean FROM sg WHERE segment IS NOT NULL GROUP BY ALL" for m in METRICS)
    + ") JOIN (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, round_even(avg({m}::DOUBLE), 6) AS overall FROM sg WHERE segment IS NOT NULL" for m in METRICS) + ") USING (metric)"
)
_I = {
    "li": "SELECT o_custkey AS user_id, p_brand AS item, o_orderdate AS ts, l_quantity AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey",
    "it": f"SELECT user_id, item, round_even(sum(weight), 6) AS weight, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT CAST(ts AS DATE)) AS days FROM li WHERE ts <= TIMESTAMP '{SNAPSHOT}' GROUP BY ALL",
    "po": f"SELECT *, round_even(score / sum(score) OVER (), 6) AS share FROM (SELECT item, round_even(sum(weight), 6) AS score, coalesce(round_even(sum(weight) FILTER (last_ts >= TIMESTAMP '{SNAPSHOT}' - INTERVAL {RECENT} DAY), 6), 0) AS recent_score, count(*) AS users FROM it GROUP BY ALL)",
    "si": f"SELECT a.item, b.item AS other, count(*) AS support, round_even(sum(a.weight * b.weight) / (any_value(x.norm) * any_value(y.norm)), 6) AS similarity FROM it a JOIN it b ON a.user_id = b.user_id AND a.item <> b.item JOIN (SELECT item, sqrt(sum(weight * weight)) AS norm FROM it GROUP BY ALL) x ON x.item = a.item JOIN (SELECT item, sqrt(sum(weight * weight)) AS norm FROM it GROUP BY ALL) y ON y.item = b.item GROUP BY a.item, b.item HAVING count(*) >= {SUPPORT}",
    "ca": "SELECT user_id, item FROM (SELECT DISTINCT user_id FROM it), (SELECT DISTINCT p_brand AS item FROM part) WHERE (user_id, item) NOT IN (SELECT user_id, item FROM it)",
    "ra": f"SELECT *, round_even(score / nullif(max(score) OVER (PARTITION BY user_id), 0), 6) AS relative FROM (SELECT user_id, item, recent_score AS score, row_number() OVER (PARTITION BY user_id ORDER BY recent_score DESC, item) AS rank FROM ca JOIN po USING (item)) WHERE rank <= {K}",
    "ho": f"SELECT DISTINCT user_id, item FROM li WHERE ts > TIMESTAMP '{SNAPSHOT}'",
    "gl": f"SELECT *, round_even(score / nullif(max(score) OVER (PARTITION BY user_id), 0), 6) AS relative, 'global_popularity' AS source FROM (SELECT user_id, item, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item) AS rank FROM ca JOIN po USING (item)) WHERE rank <= {K}",
    "us": "SELECT DISTINCT user_id, coalesce(c_mktsegment, 'unknown') AS segment FROM it LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 11 <> 0) ON c_custkey = user_id",
    "sp": "SELECT c_mktsegment AS segment, item, round_even(sum(weight), 6) AS score FROM it JOIN customer ON c_custkey = user_id WHERE c_custkey % 11 <> 0 GROUP BY ALL",
    "sl": f"""SELECT user_id, item, score, rank, round_even(score / nullif(max(score) OVER (PARTITION BY user_id), 0), 6) AS relative, source FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item) AS rank FROM (
        SELECT user_id, ca.item, CASE WHEN sp.score > 0 THEN sp.score ELSE po.score END AS score, CASE WHEN sp.score > 0 THEN 'segment_popularity' ELSE 'segment_global_fallback' END AS source
        FROM ca JOIN us USING (user_id) JOIN po ON po.item = ca.item LEFT JOIN sp ON sp.segment = us.segment AND sp.item = ca.item)) WHERE rank <= {K}""",
    "hi": "SELECT ra.*, CASE WHEN ho.item IS NULL THEN 0 ELSE 1 END AS hit FROM ra LEFT JOIN ho USING (user_id, item)",
    "ms": f"""SELECT user_id, round_even(hits / least({K}, listed), 6) AS precision, round_even(hits / wanted, 6) AS recall, (hits > 0)::INT AS hit, coalesce(round_even(1 / first_hit, 6), 0) AS mrr, round_even(gain / least(wanted, {K}), 6) AS map,
        round_even(dcg / list_sum(list_transform(range(1, least(wanted, {K}) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM (SELECT user_id, count(*) AS wanted FROM ho GROUP BY ALL) JOIN (
        SELECT user_id, count(*) AS listed, sum(hit) AS hits, min(rank) FILTER (hit = 1) AS first_hit, sum(CASE WHEN hit = 1 THEN so_far / rank ELSE 0 END) AS gain, sum(hit / log2(rank + 1)) AS dcg FROM (SELECT *, sum(hit) OVER (PARTITION BY user_id ORDER BY rank) AS so_far FROM hi) GROUP BY ALL) USING (user_id)""",
}


def _items(body: str, *names: str) -> str:
    return "WITH " + ", ".join(f"{k} AS ({_I[k]})" for k in names) + " " + body


_ALL = tuple(k for k in _I if k not in ("gl", "us", "sp", "sl"))


def _measures(lists: str) -> str:
    """Mean measures of a table of lists, one row."""
    return f"""SELECT count(*) AS users, {', '.join(f'round_even(avg({m}), 6) AS {m}' for m in ('precision', 'recall', 'hit', 'mrr', 'map', 'ndcg'))} FROM ({_I['ms'].replace('FROM hi)', f'FROM (SELECT x.*, CASE WHEN ho.item IS NULL THEN 0 ELSE 1 END AS hit FROM {lists} x LEFT JOIN ho USING (user_id, item)))')})"""


def _about(model: str, lists: str) -> str:
    return f"""SELECT '{model}' AS model, *, (SELECT round_even(count(DISTINCT item) / (SELECT count(DISTINCT p_brand) FROM part), 6) FROM {lists}) AS coverage,
        (SELECT round_even(avg(-log2(coalesce(share, 0) + 0.01)), 6) FROM {lists} LEFT JOIN po USING (item)) AS novelty, (SELECT round_even(count(*) FILTER (source LIKE '%fallback%') / count(*), 6) FROM {lists}) AS fallback_rate FROM ({_measures(lists)})"""


_CF = f"""SELECT *, round_even(score / nullif(max(score) OVER (PARTITION BY user_id), 0), 6) AS relative FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item) AS rank FROM (
        SELECT user_id, ca.item, round_even(CASE WHEN s > 0 THEN s ELSE share * 0.01 END, 6) AS score, CASE WHEN s > 0 THEN 'item_item' ELSE 'catalogue_fallback' END AS source
        FROM ca LEFT JOIN (SELECT it.user_id, si.item, max(similarity * weight) AS s FROM it JOIN si ON si.other = it.item GROUP BY ALL) h USING (user_id, item) LEFT JOIN po ON po.item = ca.item)) WHERE rank <= {K}"""
_MODELS = {"global_popularity": "gl", "recent_popularity": "rs", "segment_popularity": "sl", "item_item_cf": "cf"}
_COMPARED = " UNION ALL ".join(_about(m, t) for m, t in _MODELS.items())


def _every(body: str) -> str:
    more = {"rs": "SELECT *, 'recent_popularity' AS source FROM ra", "cf": _CF, "cm": _COMPARED}
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in (_I | more).items()) + " " + body


_CATALOGUE = """SELECT item, 'c' || n % 4 AS category, 'f' || n % 3 AS feature, n % 7 <> 3 AS active, n % 5 = 1 AS repeatable, n % 5 AS least_plan, CASE WHEN n % 6 = 2 THEN ['BUILDING', 'MACHINERY'] END AS personas, n % 8 = 5 AS small_only,
    CASE WHEN n % 9 = 4 THEN 'Brand#' || (n + 1) END AS required, CASE WHEN n % 10 = 6 THEN 'Brand#' || (n - 1) END AS incompatible FROM (SELECT DISTINCT p_brand AS item, regexp_extract(p_brand, '([0-9]+)$', 1)::INT AS n FROM part)"""
_PLAN = f"""SELECT c_custkey AS user_id, coalesce((SELECT max_by(plan, (start_ts, -subscription_id)) FROM ({inputs.CTES['b']}) b WHERE b.user_id = c_custkey AND start_ts <= TIMESTAMP '{SNAPSHOT}' AND (end_ts IS NULL OR end_ts >= TIMESTAMP '{SNAPSHOT}')), 0) AS plan,
    c_mktsegment AS persona, c_acctbal < 2000 AS small FROM customer"""
_ELIGIBLE = """SELECT user_id, item, EXISTS (SELECT 1 FROM done d WHERE d.user_id = p.user_id AND d.item = cat.item)::INT AS already_consumed FROM p, cat WHERE active AND plan >= greatest(least_plan, 1) AND (personas IS NULL OR list_contains(personas, persona)) AND (NOT small_only OR small)
    AND (repeatable OR NOT EXISTS (SELECT 1 FROM done d WHERE d.user_id = p.user_id AND d.item = cat.item)) AND (required IS NULL OR EXISTS (SELECT 1 FROM it WHERE it.user_id = p.user_id AND it.item = required)) AND NOT (incompatible IS NOT NULL AND EXISTS (SELECT 1 FROM it WHERE it.user_id = p.user_id AND it.item = incompatible))"""
_OFFERS = {
    "li": _I["li"], "it": _I["it"].replace(SNAPSHOT, EARLY), "cat": _CATALOGUE, "p": _PLAN, "done": "SELECT user_id, item FROM it WHERE n >= 2 AND item NOT LIKE 'Brand#2%'", "el": _ELIGIBLE,
    "pr": "SELECT item, ((regexp_extract(item, '([0-9]+)$', 1)::INT % 9 + 1) * 0.01::DOUBLE) AS priority FROM cat",
    "gs": "SELECT item, round_even(sum(weight), 6) AS score FROM it WHERE item <> 'Brand#11' GROUP BY ALL",
    "us": "SELECT c_custkey AS user_id, CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment WHEN c_custkey IN (SELECT user_id FROM it) THEN 'core_engaged' ELSE 'cold_start' END AS segment FROM customer",
    "ss": "SELECT CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment ELSE 'core_engaged' END AS segment, item, round_even(sum(weight), 6) AS score FROM it JOIN customer ON c_custkey = user_id GROUP BY ALL",
    "si": _I["si"].replace(f">= {SUPPORT}", f">= {EARLY_SUPPORT}"),
    "nr": "SELECT user_id, item, max(s) AS s, arg_min(other, (-s, other)) AS best FROM (SELECT it.user_id, si.item, si.other, round_even(similarity * weight, 6) AS s FROM it JOIN si ON si.other = it.item) WHERE s > 0 GROUP BY ALL",
}


def _offers(score: str, source: str, joins: str) -> str:
    """Eligible items in order of a score, each user's first K."""
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in _OFFERS.items()) + f"""
        SELECT *, round_even(score / nullif(max(score) OVER (PARTITION BY user_id), 0), 6) AS relative FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item) AS rank FROM (
        SELECT el.user_id, el.item, round_even({score}, 6) AS score, {source} AS source FROM el JOIN pr USING (item) LEFT JOIN gs ON gs.item = el.item {joins})) WHERE rank <= {K}"""


QUERIES = {
    "segment_exclusions": (lambda spark, sf: assigned(spark, sf).groupBy("exclusion").agg(F.count("*").alias("users")), _users("SELECT exclusion, count(*) AS users FROM sg GROUP BY ALL")),
    "segment_rules": (lambda spark, sf: assigned(spark, sf).select("user_id", "exclusion", "segment"), _users("SELECT user_id, exclusion, segment FROM sg")),
    "segment_profiles": (lambda spark, sf: seg.profiles(assigned(spark, sf).where("segment IS NOT NULL"), "segment", METRICS), _users(_PROFILE)),
    "segment_differentiating": (lambda spark, sf: seg.differentiating(seg.profiles(assigned(spark, sf).where("segment IS NOT NULL"), "segment", METRICS), "segment"), _users(
        "SELECT segment, rank, metric, abs(difference) AS distance, metric || CASE WHEN difference > 0 THEN ':above_population' ELSE ':below_population' END AS label FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY abs(difference) DESC, metric DESC) AS rank FROM pr) WHERE rank <= 3", pr=_PROFILE)),
    "segment_distribution": (lambda spark, sf: seg.distribution(assigned(spark, sf).where("segment IS NOT NULL"), "segment", "persona"), _users(
        "SELECT segment, string_agg(persona || ':' || printf('%.4f', round_even(n / total, 4)), '|' ORDER BY persona) AS distribution FROM (SELECT segment, persona, count(*) AS n, sum(count(*)) OVER (PARTITION BY segment) AS total FROM sg WHERE segment IS NOT NULL GROUP BY segment, persona) GROUP BY ALL")),
    "segment_mode": (lambda spark, sf: seg.modal(assigned(spark, sf).where("segment IS NOT NULL"), "segment", "persona"), _users(
        "SELECT segment, persona AS mode FROM (SELECT segment, persona, row_number() OVER (PARTITION BY segment ORDER BY count(*) DESC, persona) AS r FROM sg WHERE segment IS NOT NULL GROUP BY segment, persona) WHERE r = 1")),
    "interactions": (found, _items("SELECT * FROM it", "li", "it")),
    "item_popularity": (popular, _items("SELECT * FROM po", "li", "it", "po")),
    "segment_popularity": (lambda spark, sf: op.segment_popularity(found(spark, sf), table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))), _items(
        "SELECT c_mktsegment AS segment, item, round_even(sum(weight), 6) AS score FROM it JOIN customer ON c_custkey = user_id GROUP BY ALL", "li", "it")),
    "item_similarity": (pairs, _items("SELECT * FROM si", "li", "it", "si")),
    "similar_items": (lambda spark, sf: op.similar_items(pairs(spark, sf)), _items("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY similarity DESC, support DESC, other DESC) AS rank FROM si) WHERE rank <= 5", "li", "it", "si")),
    "candidates": (lambda spark, sf: op.candidates(found(spark, sf), items(spark, sf), found(spark, sf)), _items("SELECT * FROM ca", "li", "it", "ca")),
    "recommendations_item_item": (lambda spark, sf: by_similarity(spark, sf), _items(f"""
        SELECT *, round_even(score / nullif(max(score) OVER (PARTITION BY user_id), 0), 6) AS relative FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item) AS rank FROM (
        SELECT user_id, ca.item, round_even(CASE WHEN s > 0 THEN s ELSE share * 0.01 END, 6) AS score, CASE WHEN s > 0 THEN 'item_item' ELSE 'catalogue_fallback' END AS source
        FROM ca LEFT JOIN (SELECT it.user_id, si.item, max(similarity * weight) AS s FROM it JOIN si ON si.other = it.item GROUP BY ALL) h USING (user_id, item) LEFT JOIN po ON po.item = ca.item)) WHERE rank <= {K}""", "li", "it", "po", "si", "ca")),
    "recommendations_topk": (ranked, _items("SELECT * FROM ra", "li", "it", "po", "ca", "ra")),
    "ranking_metrics_users": (lambda spark, sf: op.list_measures(ranked(spark, sf), held_out(spark, sf), K), _items("SELECT * FROM ms", *_ALL)),
    "ranking_metrics_at_k": (lambda spark, sf: op.averages(op.list_measures(ranked(spark, sf), held_out(spark, sf), K)), _items("SELECT count(*) AS users, " + ", ".join(f"round_even(avg({m}), 6) AS {m}" for m in ("precision", "recall", "hit", "mrr", "map", "ndcg")) + " FROM ms", *_ALL)),
    "catalogue_coverage": (lambda spark, sf: op.coverage(ranked(spark, sf), items(spark, sf), K), _items("SELECT count(DISTINCT item) AS listed, (SELECT count(DISTINCT p_brand) FROM part) AS catalogue, round_even(count(DISTINCT item) / (SELECT count(DISTINCT p_brand) FROM part), 6) AS coverage FROM ra", "li", "it", "po", "ca", "ra")),
    "recommendation_novelty": (lambda spark, sf: op.novelty(ranked(spark, sf), popular(spark, sf), K), _items("SELECT count(*) AS listed, round_even(avg(-log2(coalesce(share, 0) + 0.01)), 6) AS novelty FROM ra LEFT JOIN po USING (item)", "li", "it", "po", "ca", "ra")),
    "recommendations_global": (by_score, _items("SELECT * FROM gl", "li", "it", "po", "ca", "gl")),
    "recommendations_segment": (by_segment, _items("SELECT * FROM sl", "li", "it", "po", "ca", "us", "sp", "sl")),
    "recommendation_plan_at": (lambda spark, sf: context(spark, sf).select("user_id", "plan"), f"SELECT user_id, plan::VARCHAR AS plan FROM ({_PLAN})"),
    "recommendation_eligible": (eligible, "WITH " + ", ".join(f"{k} AS ({_I[k]})" for k in ("li", "it")) + f""", cat AS ({_CATALOGUE}), p AS ({_PLAN}), done AS (SELECT user_id, item FROM it WHERE n >= 2 AND item NOT LIKE 'Brand#2%')
        SELECT user_id, item, EXISTS (SELECT 1 FROM done d WHERE d.user_id = p.user_id AND d.item = cat.item)::INT AS already_consumed FROM p, cat WHERE active AND plan >= greatest(least_plan, 1) AND (personas IS NULL OR list_contains(personas, persona)) AND (NOT small_only OR small)
        AND (repeatable OR NOT EXISTS (SELECT 1 FROM done d WHERE d.user_id = p.user_id AND d.item = cat.item)) AND (required IS NULL OR EXISTS (SELECT 1 FROM it WHERE it.user_id = p.user_id AND it.item = required)) AND NOT (incompatible IS NOT NULL AND EXISTS (SELECT 1 FROM it WHERE it.user_id = p.user_id AND it.item = incompatible))"""),
    "recommendation_offers_global": (offers_global, _offers("CASE WHEN gs.score > 0 THEN gs.score ELSE priority END", "CASE WHEN gs.score > 0 THEN 'global_popularity' ELSE 'catalogue_fallback' END", "")),
    "recommendation_offers_segment": (offers_segment, _offers("CASE WHEN ss.score > 0 THEN ss.score WHEN gs.score > 0 THEN gs.score ELSE priority END", "CASE WHEN ss.score > 0 THEN 'segment_popularity' WHEN gs.score > 0 THEN 'segment_global_fallback' ELSE 'catalogue_fallback' END",
        "JOIN us ON us.user_id = el.user_id LEFT JOIN ss ON ss.segment = us.segment AND ss.item = el.item")),
    "recommendation_offers_item_item": (offers_item_item, _offers("CASE WHEN nr.s > 0 THEN nr.s WHEN gs.score > 0 THEN gs.score ELSE priority END", "CASE WHEN nr.s > 0 THEN 'item_similarity:' || best WHEN gs.score > 0 THEN 'cf_popularity_fallback' ELSE 'catalogue_fallback' END",
        "LEFT JOIN nr ON nr.user_id = el.user_id AND nr.item = el.item")),
    "recommendation_mapped": (lambda spark, sf: op.mapped(inputs.events(spark, sf), MAPPING, "k"), sql("SELECT user_id, CASE event_name WHEN 'view' THEN 'item_view' WHEN 'click' THEN 'item_click' ELSE 'item_buy' END AS item, ts, CASE event_name WHEN 'view' THEN 1.0 WHEN 'click' THEN 2.0 ELSE 5.0 END::DOUBLE AS weight FROM e WHERE event_name IN ('view', 'purchase') OR (event_name = 'click' AND (k IS NULL OR k = 7))", "e")),
    "recommendation_inputs": (lambda spark, sf: op.known_inputs(inputs.events(spark, sf).select("user_id", "event_id", "ts"), inputs.users(spark, sf).withColumn("signup_ts", (F.col("signup_ts") + F.expr("INTERVAL 5 DAYS")).cast("timestamp_ntz")), "2024-01-20 00:00:00"), sql(
        "SELECT user_id, event_id, ts FROM e JOIN u USING (user_id) WHERE signup_ts + INTERVAL 5 DAY <= TIMESTAMP '2024-01-20' AND ts >= signup_ts + INTERVAL 5 DAY AND ts <= TIMESTAMP '2024-01-20'", "e", "u")),
    "recommendation_users": (lambda spark, sf: op.all_users(found(spark, sf), held_out(spark, sf)), _items("SELECT user_id FROM it UNION SELECT user_id FROM ho", "li", "it", "ho")),
    "recommendation_history_segment": (lambda spark, sf: op.mapped(inputs.events(spark, sf), {"view": ("invite_page", None, 1.0), "error": ("automation_run", "3", 1.0), "click": ("notes", None, 1.0)}, "k").groupBy("user_id").agg(op.history_segment(F.collect_set("item")).alias("segment")), sql(
        "SELECT user_id, CASE WHEN count(*) FILTER (event_name = 'error' AND k = 3) > 0 THEN 'automation_power_user' WHEN count(*) FILTER (event_name = 'view') > 0 THEN 'collaboration_adopter' ELSE 'core_engaged' END AS segment FROM e WHERE event_name IN ('view', 'click') OR (event_name = 'error' AND k = 3) GROUP BY ALL", "e")),
    "item_relationship": (lambda spark, sf: op.relationship(pairs(spark, sf), catalogue(spark, sf)), "WITH " + ", ".join(f"{k} AS ({_I[k]})" for k in ("li", "it", "si")) + f""", cat AS ({_CATALOGUE}) SELECT si.*, CASE WHEN a.category = b.category THEN 'same_category' WHEN a.feature = b.feature THEN 'same_feature_family' ELSE 'co_interaction' END AS relationship
        FROM si JOIN cat a ON a.item = si.item JOIN cat b ON b.item = si.other"""),
    "recommendation_reasons": (lambda spark, sf: op.reasons(by_segment(spark, sf), REASONS).select("user_id", "item", "rank", F.array_join("codes", "|").alias("codes"), "reason"), _items(
        "SELECT user_id, item, rank, CASE source WHEN 'segment_popularity' THEN 'popular_in_your_segment' ELSE 'cold_start_popular_item' END || '|' || source AS codes, CASE source WHEN 'segment_popularity' THEN 'Popular in your segment' ELSE 'Cold start popular item' END AS reason FROM sl", "li", "it", "po", "ca", "us", "sp", "sl")),
    "recommendation_segment_measures": (lambda spark, sf: op.segment_measures(by_segment(spark, sf), held_out(spark, sf), op.with_segment(found(spark, sf).select("user_id").distinct(), segments(spark, sf)), K), _every(
        f"SELECT segment, users, coalesce(precision, 0) AS precision, coalesce(recall, 0) AS recall, coalesce(hit, 0) AS hit FROM (SELECT segment, count(DISTINCT user_id) AS users FROM sl JOIN us USING (user_id) GROUP BY ALL) LEFT JOIN (SELECT segment, round_even(avg(precision), 6) AS precision, round_even(avg(recall), 6) AS recall, round_even(avg(hit), 6) AS hit FROM ({_I['ms'].replace('FROM hi)', 'FROM (SELECT x.*, CASE WHEN ho.item IS NULL THEN 0 ELSE 1 END AS hit FROM sl x LEFT JOIN ho USING (user_id, item)))')}) JOIN us USING (user_id) GROUP BY ALL) USING (segment)")),
    "recommendation_cold_start": (lambda spark, sf: op.cold_start(ranked(spark, sf), found(spark, sf).where("user_id % 3 <> 0"), held_out(spark, sf)), _items(
        "SELECT count(DISTINCT user_id) AS cold_users, 1.0::DOUBLE AS coverage, count(*) AS recommendations, count(DISTINCT user_id) FILTER (user_id IN (SELECT user_id FROM ho)) AS evaluated_users FROM ra WHERE user_id NOT IN (SELECT user_id FROM it WHERE user_id % 3 <> 0)", *_ALL)),
    "recommendation_diversity": (lambda spark, sf: op.diversity(ranked(spark, sf), catalogue(spark, sf), K), "WITH " + ", ".join(f"{k} AS ({_I[k]})" for k in ("li", "it", "po", "ca", "ra")) + f", cat AS ({_CATALOGUE}) SELECT round_even(avg(d), 6) AS diversity FROM (SELECT user_id, round_even(count(DISTINCT category) / count(*), 6) AS d FROM ra JOIN cat USING (item) GROUP BY ALL)"),
    "recommendation_comparison": (comparison, _every("SELECT * FROM cm")),
    "recommendation_model_choice": (lambda spark, sf: op.chosen(comparison(spark, sf), 0.5).select("model", "ndcg", "selected"), _every(
        "SELECT model, ndcg, row_number() OVER (ORDER BY (coverage >= 0.5)::INT DESC, ndcg DESC, recall DESC, CASE model WHEN 'global_popularity' THEN 4 WHEN 'recent_popularity' THEN 3 WHEN 'segment_popularity' THEN 2 ELSE 1 END DESC) = 1 AS selected FROM cm")),
    "recommendation_invariants": (lambda spark, sf: op.broken_recommendations(by_segment(spark, sf), items(spark, sf), K - 1).groupBy("rule").agg(F.count("*").alias("users")), _items("SELECT 'LIST_TOO_LONG' AS rule, count(*) AS users FROM (SELECT user_id FROM sl GROUP BY user_id HAVING count(*) > 4)", "li", "it", "po", "ca", "us", "sp", "sl")),
    "recommendation_catalogue_checks": (lambda spark, sf: op.broken_catalogue(catalogue(spark, sf).withColumn("incompatible", F.when(F.col("item") == "Brand#13", F.col("required")).otherwise(F.col("incompatible")))), "SELECT DISTINCT p_brand AS item, 'REQUIRED_AND_EXCLUDED' AS rule FROM part WHERE p_brand = 'Brand#13'"),
    "segment_centroids": (lambda spark, sf: seg.centroids(assigned(spark, sf).where("segment IS NOT NULL"), "segment", METRICS), _users(" UNION ALL ".join(f"SELECT segment, '{m}' AS feature, round_even(avg({m}::DOUBLE), 6) AS centroid FROM sg WHERE segment IS NOT NULL GROUP BY ALL" for m in METRICS))),
    "segment_varying_features": (lambda spark, sf: seg.varying(assigned(spark, sf), [*METRICS, "resurrections"]), _users("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS feature, round_even(stddev_pop({m}::DOUBLE), 6) AS deviation FROM sg" for m in [*METRICS, "resurrections"]) + ") WHERE deviation > 0")),
    "segment_names": (lambda spark, sf: seg.named(assigned(spark, sf).where("segment IS NOT NULL").select("segment", *METRICS), "segment", NAMING, "new_or_exploratory_users"), _users(
        "SELECT segment, CASE WHEN g_n_purchase > p_n_purchase THEN 'buyers' WHEN g_failure_share > p_failure_share THEN 'high_friction_users' WHEN g_n_events > p_n_events THEN 'high_engagement_power_users' WHEN g_days_since_activity > p_days_since_activity THEN 'inactive_or_declining_users' ELSE 'new_or_exploratory_users' END AS name FROM (SELECT segment, "
        + ", ".join(f"round_even(avg({m}::DOUBLE), 6) AS g_{m}" for m in METRICS) + " FROM sg WHERE segment IS NOT NULL GROUP BY ALL), (SELECT " + ", ".join(f"round_even(avg({m}::DOUBLE), 6) AS p_{m}" for m in METRICS) + " FROM sg WHERE segment IS NOT NULL)")),
    "segment_confidence": (lambda spark, sf: seg.confidence(assigned(spark, sf).where("segment IS NOT NULL"), "segment", METRICS), _users("SELECT user_id, segment, round_even(d, 6) AS distance, round_even(1 / (1 + d), 6) AS confidence FROM (SELECT user_id, segment, sqrt(" + " + ".join(f"coalesce(pow(({m} - c_{m}) / nullif(s_{m}, 0), 2), 0)" for m in METRICS) + ") AS d FROM (SELECT * FROM sg WHERE segment IS NOT NULL) JOIN (SELECT segment, "
        + ", ".join(f"avg({m}::DOUBLE) AS c_{m}" for m in METRICS) + " FROM sg WHERE segment IS NOT NULL GROUP BY ALL) USING (segment), (SELECT " + ", ".join(f"stddev_pop({m}::DOUBLE) AS s_{m}" for m in METRICS) + " FROM sg WHERE segment IS NOT NULL))")),
    "segment_adjusted_rand": (lambda spark, sf: seg.adjusted_rand(assigned(spark, sf).where("segment IS NOT NULL"), "segment", "persona"), _users("""SELECT round_even(coalesce((b - l * r / nullif(t, 0)) / nullif((l + r) / 2 - l * r / nullif(t, 0), 0), 1), 6) AS adjusted_rand FROM (SELECT (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM sg WHERE segment IS NOT NULL GROUP BY segment, persona)) AS b,
        (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM sg WHERE segment IS NOT NULL GROUP BY segment)) AS l, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM sg WHERE segment IS NOT NULL GROUP BY persona)) AS r, (SELECT count(*) * (count(*) - 1) / 2 FROM sg WHERE segment IS NOT NULL) AS t)""")),
}
