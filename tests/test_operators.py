"""Operators on small hand-made tables with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.functions.scalars import nearest_rank, period_index, period_label, rate
from tidemark.operators import funnel, quality, retention
from tidemark.sources.contracts import Contract, Field, drift, typed

DAY = dt.datetime(2025, 1, 1)
EVENTS = "user_id string, event_id string, ts timestamp_ntz, event_name string"


def at(minutes):
    return DAY + dt.timedelta(minutes=minutes)


def attempts(spark, rows, spec, end="2025-06-30 00:00:00"):
    events = spark.createDataFrame([("u", f"e{i}", at(m), n) for i, (m, n) in enumerate(rows)], EVENTS)
    users = spark.createDataFrame([("u",)], "user_id string")
    return funnel.attempts(users, events, [spec], end).collect()


SPEC = funnel.Funnel("rec", (funnel.Stage("shown", ("shown",)), funnel.Stage("clicked", ("clicked",)), funnel.Stage("accepted", ("accepted",))), 45)


def test_first_entry_completes(spark):
    (got,) = attempts(spark, [(0, "shown"), (1, "shown"), (2, "clicked"), (3, "accepted")], SPEC)
    assert (got.status, got.entry_ts, got.n_reached, got.seconds) == ("completed", DAY, 3, 180)


def test_equal_times_do_not_chain(spark):
    (got,) = attempts(spark, [(0, "shown"), (0, "clicked")], SPEC)
    assert got.n_reached == 1 and got.status == "incomplete"


def test_open_window_is_censored(spark):
    (got,) = attempts(spark, [(0, "shown")], SPEC, "2025-02-01 00:00:00")
    assert got.status == "censored"


@pytest.mark.parametrize("runs, reached", [(2, 2), (3, 3)])
def test_second_match_counts_from_the_cursor(spark, runs, reached):
    spec = funnel.Funnel("auto", (funnel.Stage("made", ("made",)), funnel.Stage("run", ("run",)), funnel.Stage("twice", ("run",), 2)), 30)
    (got,) = attempts(spark, [(0, "made")] + [(i + 1, "run") for i in range(runs)], spec)
    assert got.n_reached == reached


def test_period_arithmetic(spark):
    row = spark.sql("SELECT TIMESTAMP_NTZ'2025-01-31 12:00:00' a, TIMESTAMP_NTZ'2025-02-03 00:00:00' b").select(
        period_label("a", "weekly").alias("l"), *(period_index("a", "b", u).alias(u) for u in ("daily", "weekly", "monthly"))
    )
    assert tuple(row.first()) == ("2025-W05", 3, 1, 1)


def test_lifecycle_states(spark):
    active = [1, 0, 0, 1, 0, 0, 0, 0]
    rows = spark.createDataFrame([("d", "u", "c", i, True, bool(a)) for i, a in enumerate(active)], "definition_id string, user_id string, cohort string, period int, observed boolean, active boolean")
    got = [r.state for r in retention.lifecycle(rows, 2, 4).orderBy("period").collect()]
    assert got == ["new", "inactive", "inactive", "resurrected", "inactive", "inactive", "inactive", "churned_descriptive"]


def test_rounding_and_nearest_rank(spark):
    assert spark.range(1).select(rate(F.lit(1), F.lit(128)).alias("r")).first().r == 0.007812
    rows = spark.createDataFrame([("g", v) for v in (1, 2, 3, 4)], "g string, v int")
    assert nearest_rank(rows, ["g"], "v", {"p50": 0.5}).first().p50 == 3


def test_duplicate_policies(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, line int")
    got = {p: sorted((r.line, r.outcome) for r in quality.deduplicated(rows, ["k"], ["line"], p).collect()) for p in ("reject", "keep_first", "keep_last")}
    assert got["reject"] == [(1, "discarded"), (2, "quarantined"), (3, "accepted")]
    assert got["keep_first"] == [(1, "accepted"), (2, "discarded"), (3, "accepted")]
    assert got["keep_last"] == [(1, "discarded"), (2, "accepted"), (3, "accepted")]


def test_contract_rules(spark):
    contract = Contract("users", (Field("user_id", prefix="syn_"), Field("signup", "timestamp"), Field("consent", "boolean"), Field("age", "integer", nullable=True, low=0)), ("user_id",))
    rows = spark.createDataFrame([("syn_1", "", "not-bool", "-1", "x"), ("syn_2", "2025-01-01T00:00:00Z", " TRUE ", None, "y")], "user_id string, signup string, consent string, age string, extra string")
    bad, good = typed(rows, contract).orderBy("user_id").collect()
    assert bad.rules == ["FIELD_REQUIRED:signup", "FIELD_TYPE_INVALID:consent", "VALUE_BELOW_MINIMUM:age"] and bad.extra == "x"
    assert good.rules == [] and good.consent is True and good.signup == DAY and good.age is None
    assert drift(contract, ["user_id", "signup", "consent", "more"], "report-only") == [("MISSING_REQUIRED", "age", "error"), ("UNEXPECTED_COLUMN", "more", "warning")]


def test_distributions():
    assert abs(stats.t_two_sided(2.228139, 10) - 0.05) < 1e-6
    assert abs(stats.t_quantile(0.975, 10) - 2.228139) < 1e-5
    assert abs(stats.chi2_upper(10, 1) - 0.001565402) < 1e-8


def test_adjusted_p(spark):
    rows = spark.createDataFrame([("f", 0.01), ("f", 0.02), ("f", 0.03)], "f string, p_value double")
    assert sorted(r.adjusted_p for r in stats.adjusted(rows, ["f"]).collect()) == [0.03, 0.03, 0.03]
    assert sorted(r.adjusted_p for r in stats.adjusted(rows, ["f"], "bonferroni").collect()) == [0.03, 0.06, 0.09]


def test_registry_is_consistent():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


CONTRACT = Contract("events", (Field("event_id", prefix="syn_"), Field("n", "integer")), ("event_id",), format="jsonl")
LINES = ['{"event_id": "syn_1", "n": 3}', "{bad json", "[]", "", '{"event_id": "x", "n": "many"}']
RULES = [[], ["JSONL_MALFORMED"], ["JSONL_NON_OBJECT"], ["JSONL_BLANK_LINE"], ["IDENTIFIER_PREFIX_INVALID:event_id", "FIELD_TYPE_INVALID:n"]]


def test_jsonl_line_rules(spark):
    from tidemark.sources.readers import jsonl

    rows = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "i int, value string")
    assert [r.rules for r in jsonl(rows, CONTRACT).orderBy("i").collect()] == RULES


def test_stream_agrees_with_batch(spark, tmp_path):
    from tidemark.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    for i, line in enumerate(LINES):
        (tmp_path / "in" / f"{i}.jsonl").write_text(line + "\n")
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), CONTRACT, str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/accepted")).count() == 1
    assert spark.read.parquet(str(tmp_path / "out/quarantine")).count() == 4
