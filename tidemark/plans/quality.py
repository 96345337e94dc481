"""Data-quality queries: the tables judged by rules that some of their rows break."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as op
from ..sources import ingestion
from ..sources.contracts import Contract, Field, typed
from . import inputs
from .inputs import sql, table

RULES = {
    "EVENT_NAME_UNKNOWN": "event_name NOT IN ('signup', 'view', 'click', 'purchase')",
    "VALUE_BELOW_MINIMUM": "value < 5",
    "VALUE_ABOVE_MAXIMUM": "value > 150",
    "PROPERTY_MISSING": "k IS NULL",
    "PURCHASE_WITHOUT_VALUE": "event_name = 'purchase' AND value < 20",
}
CONTRACT = Contract("orders", (
    Field("o_orderkey", "integer", low=1), Field("o_custkey", "integer", low=1, high=1000), Field("o_orderstatus", allowed=("O", "F")), Field("o_totalprice", "decimal", low=1000, high=400000),
    Field("o_orderdate", "date"), Field("o_orderpriority", prefix="1"),
), ("o_orderkey",))
CRITICAL, MAX_RATE = ["PURCHASE_WITHOUT_VALUE"], 0.9


def ruled(spark, sf):
    return op.status(op.ruled(inputs.events(spark, sf), RULES))


def dq_record_rules(spark, sf):
    return ruled(spark, sf).select("event_id", "record_status", F.array_join("rules", ",").alias("rules"))


def dq_contract_types(spark, sf):
    rows = table(spark, sf, "orders").select(*(F.col(c).cast("string").alias(c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")), F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))
    return typed(rows, CONTRACT).select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderdate", F.array_join(F.array_sort("rules"), ",").alias("rules"))


def dq_fk_anti(spark, sf):
    return op.orphans(table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id")), inputs.users(spark, sf), "user_id")


def dq_event_in_session(spark, sf):
    """Shipments outside the 60 days from their order, as events outside the bounds of their session."""
    bounds = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).cast("timestamp_ntz").alias("end"))
    return op.outside(table(spark, sf, "lineitem"), bounds, "l_orderkey", "l_shipdate", "start", "end").select("l_orderkey", "l_linenumber", "l_shipdate", "start")


def dq_before_signup(spark, sf):
    """Sessions that begin before the user's first purchase."""
    bought = inputs.events(spark, sf).where("event_name = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("joined"))
    return inputs.sessions(spark, sf).join(bought, "user_id").where("start_ts < joined").select("user_id", "session", "start_ts", "joined")


def dq_session_counts(spark, sf):
    """Sessions whose number of events is not that of their events without errors."""
    counted = inputs.sessionized(inputs.events(spark, sf)).where("event_name <> 'error'").groupBy("user_id", "session").agg(F.count("*").alias("counted"))
    rows = inputs.sessions(spark, sf).join(counted, ["user_id", "session"], "left").withColumn("counted", F.coalesce("counted", F.lit(0)))
    return rows.where("event_count <> counted").select("user_id", "session", "event_count", "counted")


def dq_usage_reconciliation(spark, sf):
    stored = inputs.usage(spark, sf).where("feature <> 3")
    rows = inputs.events(spark, sf).where("event_name <> 'signup'").withColumn("day", F.to_date("ts"))
    counted = rows.groupBy("user_id", F.col("k").alias("feature"), "day").agg(F.count("*").alias("usage_count"), (2 * F.count("*")).alias("active_minutes"), F.count_if(F.col("event_name") == "purchase").alias("successes"), F.count_if(F.col("event_name") == "error").alias("errors"))
    return op.unreconciled(stored, counted, ["user_id", "feature", "day"], ["usage_count", "active_minutes", "successes", "errors"])


def dq_sequence_check(spark, sf):
    return op.out_of_order(inputs.events(spark, sf), ["user_id"], "event_id", "value").select("event_id", "user_id", "value", "before")


def dq_period_overlap(spark, sf):
    rows = inputs.subscriptions(spark, sf).withColumn("until", (F.col("start_ts") + F.expr("INTERVAL 200 DAYS")).cast("timestamp_ntz"))
    return op.overlaps(rows, "user_id", "start_ts", "until", "subscription_id").select("subscription_id", "user_id", "start_ts", "until", "next_start")


def _dedup(policy):
    def query(spark, sf):
        rows = inputs.events(spark, sf).withColumn("day", F.to_date("ts"))
        return op.deduplicated(rows, ["user_id", "event_name", "day"], ["event_id"], policy).select("event_id", "outcome")

    return query


def _dedup_sql(policy):
    rank = f"row_number() OVER (PARTITION BY user_id, event_name, CAST(ts AS DATE) ORDER BY event_id {'DESC' if policy == 'keep_last' else ''})"
    if policy == "reject":
        return sql(f"SELECT event_id, CASE WHEN count(*) OVER (PARTITION BY user_id, event_name, CAST(ts AS DATE)) = 1 THEN 'accepted' WHEN {rank} > 1 THEN 'quarantined' ELSE 'discarded' END AS outcome FROM e", "e")
    return sql(f"SELECT event_id, CASE WHEN {rank} = 1 THEN 'accepted' ELSE 'discarded' END AS outcome FROM e", "e")


LINES = Contract("lines", (Field("o_orderkey", "integer"), Field("o_totalprice", "integer")), ("o_orderkey",), "jsonl")


def lines(spark, sf):
    """Orders as JSON lines, some of them broken."""
    n = F.col("o_orderkey")
    good = F.concat(F.lit('{"o_orderkey":'), n, F.lit(',"o_totalprice":'), F.when(n % 109 == 0, F.lit('"x"')).otherwise((n * 2).cast("string")), F.lit("}"))
    value = F.when(n % 101 == 0, " ").when(n % 103 == 0, "{bad").when(n % 107 == 0, "[1]").otherwise(good)
    return table(spark, sf, "orders").select(F.lit("orders").alias("file"), n.alias("line"), value.alias("value"))


def cross_rules(spark, sf):
    """Orders that break rules across tables: the first one moves a record, all are counted."""
    orders = table(spark, sf, "orders")
    records = orders.withColumn("rules", F.when(F.col("o_orderkey") % 13 == 0, F.array(F.lit("RECORD_RULE"))).otherwise(F.array().cast("array<string>")))
    price = orders.where("o_totalprice > 400000").select("o_orderkey", F.lit("PRICE_ABOVE").alias("rule"), F.lit(1).alias("number"))
    orphans = dq_fk_anti(spark, sf).select("o_orderkey", F.lit("FK_USER_ID").alias("rule"), F.lit(0).alias("number"))
    return ingestion.moved(records, orphans.unionByName(price), ["o_orderkey"]).select("o_orderkey", F.coalesce(F.get("rules", F.lit(0)), F.lit("")).alias("rule"), "cross_failures")


_ARRAY = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in RULES.items()) + "], lambda x: x IS NOT NULL)"
_R = f"SELECT *, {_ARRAY} AS rules FROM e"
QUERIES = {
    "dq_record_rules": (dq_record_rules, sql("SELECT event_id, CASE WHEN len(rules) > 0 THEN 'quarantined' ELSE 'accepted' END AS record_status, array_to_string(rules, ',') AS rules FROM r", "e", r=_R)),
    "dq_contract_types": (dq_contract_types, """SELECT o_orderkey, round_even(o_totalprice, 4) AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, array_to_string(list_sort(list_filter([
        CASE WHEN o_custkey < 1 THEN 'VALUE_BELOW_MINIMUM:o_custkey' END, CASE WHEN o_orderkey < 1 THEN 'VALUE_BELOW_MINIMUM:o_orderkey' END, CASE WHEN o_custkey > 1000 THEN 'VALUE_ABOVE_MAXIMUM:o_custkey' END, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'CATEGORICAL_VALUE_INVALID:o_orderstatus' END, CASE WHEN o_totalprice < 1000 THEN 'VALUE_BELOW_MINIMUM:o_totalprice' END,
        CASE WHEN o_totalprice > 400000 THEN 'VALUE_ABOVE_MAXIMUM:o_totalprice' END, CASE WHEN o_orderpriority NOT LIKE '1%' THEN 'IDENTIFIER_PREFIX_INVALID:o_orderpriority' END], lambda x: x IS NOT NULL)), ',') AS rules FROM orders"""),
    "dq_rule_counts": (lambda spark, sf: op.rule_counts(ruled(spark, sf)), sql("SELECT rule_id, count(*) AS failures FROM (SELECT unnest(rules) AS rule_id FROM r) GROUP BY ALL", "e", r=_R)),
    "dq_fk_anti": (dq_fk_anti, sql("SELECT o_orderkey, o_custkey AS user_id FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM u)", "u")),
    "dq_event_in_session": (dq_event_in_session, "SELECT l_orderkey, l_linenumber, l_shipdate, o_orderdate AS start FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 60 DAY"),
    "dq_before_signup": (dq_before_signup, sql("SELECT user_id, session, start_ts, joined FROM s JOIN (SELECT user_id, min(ts) AS joined FROM e WHERE event_name = 'purchase' GROUP BY user_id) USING (user_id) WHERE start_ts < joined", "s")),
    "dq_session_counts": (dq_session_counts, sql("SELECT user_id, session, event_count, counted FROM (SELECT s.*, (SELECT count(*) FROM x WHERE x.user_id = s.user_id AND x.session = s.session AND event_name <> 'error') AS counted FROM s) WHERE event_count <> counted", "s")),
    "dq_usage_reconciliation": (dq_usage_reconciliation, sql("""SELECT user_id, feature, day, """ + ", ".join(f"a.{m} AS stored_{m}, c.{m} AS counted_{m}" for m in ("usage_count", "active_minutes", "successes", "errors")) + """
        FROM (SELECT * FROM g WHERE feature <> 3) a FULL JOIN c USING (user_id, feature, day) WHERE (a.usage_count, a.successes, a.errors) IS DISTINCT FROM (c.usage_count, c.successes, c.errors)""", "g",
        c="SELECT user_id, k AS feature, CAST(ts AS DATE) AS day, count(*) AS usage_count, 2 * count(*) AS active_minutes, count(*) FILTER (event_name = 'purchase') AS successes, count(*) FILTER (event_name = 'error') AS errors FROM e WHERE event_name <> 'signup' GROUP BY ALL")),
    "dq_sequence_check": (dq_sequence_check, sql("SELECT event_id, user_id, value, before FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM e) WHERE before >= value", "e")),
    "dq_period_overlap": (dq_period_overlap, sql("SELECT subscription_id, user_id, start_ts, start_ts + INTERVAL 200 DAY AS until, end_ts AS next_start FROM b WHERE end_ts IS NOT NULL AND start_ts + INTERVAL 200 DAY > end_ts", "b")),
    **{f"dq_dedup_{p}": (_dedup(p), _dedup_sql(p)) for p in ("reject", "keep_first", "keep_last")},
    "dq_status_summary": (lambda spark, sf: op.verdict(ruled(spark, sf), "events", MAX_RATE, CRITICAL), sql(f"""SELECT 'events' AS dataset, records, quarantined, critical, round_even(quarantined / records, 6) AS quarantine_rate,
        CASE WHEN quarantined / records > {MAX_RATE} OR critical > 0 THEN 'failed' WHEN quarantined > 0 THEN 'passed_with_warnings' ELSE 'passed' END AS status FROM (SELECT count(*) AS records, count(*) FILTER (len(rules) > 0) AS quarantined,
        count(*) FILTER (list_contains(rules, '{CRITICAL[0]}')) AS critical FROM r)""", "e", r=_R)),
    "sessionize": (inputs.sessions, sql("SELECT * FROM s", "s")),
    "feature_usage_rollup": (inputs.usage, sql("SELECT * FROM g", "g")),
    "ingest_lines": (lambda spark, sf: ingestion.of_lines(lines(spark, sf), LINES).select("line", F.array_join("rules", ",").alias("rules"), "o_totalprice"), """SELECT o_orderkey AS line, CASE WHEN o_orderkey % 101 = 0 THEN 'JSONL_BLANK_LINE' WHEN o_orderkey % 103 = 0 THEN 'JSONL_MALFORMED' WHEN o_orderkey % 107 = 0 THEN 'JSONL_NON_OBJECT' WHEN o_orderkey % 109 = 0 THEN 'FIELD_TYPE_INVALID:o_totalprice' ELSE '' END AS rules,
        CASE WHEN o_orderkey % 101 = 0 OR o_orderkey % 103 = 0 OR o_orderkey % 107 = 0 OR o_orderkey % 109 = 0 THEN NULL ELSE o_orderkey * 2 END AS o_totalprice FROM orders"""),
    "ingest_cross_rules": (cross_rules, sql("""SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'RECORD_RULE' WHEN o_custkey NOT IN (SELECT user_id FROM u) THEN 'FK_USER_ID' WHEN o_totalprice > 400000 THEN 'PRICE_ABOVE' ELSE '' END AS rule, (o_custkey NOT IN (SELECT user_id FROM u))::INT + (o_totalprice > 400000)::INT AS cross_failures FROM orders""", "u")),
}
