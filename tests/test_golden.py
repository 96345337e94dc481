"""Measures on rows made by hand; what is expected follows from the specified rules and not from this library's SQL."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import churn, funnel, quality, recommend, reporting, retention, segmentation

DAY = dt.datetime(2025, 1, 6)  # a Monday
EVENTS = "user_id string, event_id string, ts timestamp_ntz, event_name string, session string"


def at(hours):
    return DAY + dt.timedelta(hours=hours)


def test_errors_and_sessions_count_to_the_last_time_of_who_did_not_complete(spark):
    rows = [("u", "a", at(0), "view", "s1"), ("u", "b", at(1), "error", "s1"), ("u", "c", at(30), "error", "s2"), ("u", "d", at(40), "other", "s3"), ("v", "e", at(0), "view", "t1"), ("v", "f", at(1), "buy", "t1"), ("v", "g", at(2), "error", "t2")]
    events = spark.createDataFrame(rows, EVENTS)
    spec = funnel.Funnel("f", (funnel.Stage("view", ("view",)), funnel.Stage("buy", ("buy",))), 1)
    found = funnel.attempts(events.select("user_id").distinct(), events, [spec], "2025-06-30 00:00:00")
    by = {r.user_id: (r.status, r.exit_ts) for r in found.collect()}
    assert by == {"u": ("incomplete", at(40)), "v": ("completed", at(1))}
    (r,) = funnel.dropoff(found, events, ["error"]).collect()
    assert (r.highest_stage, r.users, r.errors, r.median_sessions, r.common_last_event, r.share_of_entrants) == (1, 1, 2, 3, "a", 0.5)
    assert funnel.broken_attempts(found).count() == 0


def test_counted_stages_take_the_nth_event_and_equal_times_do_not_chain(spark):
    rows = [("u", f"e{i}", at(h), n, "s") for i, (h, n) in enumerate([(0, "a"), (0, "b"), (1, "b"), (1, "b"), (2, "c"), (1, "c")])]
    events = spark.createDataFrame(rows, EVENTS)
    spec = funnel.Funnel("f", (funnel.Stage("a", ("a",)), funnel.Stage("two b", ("b",), 2), funnel.Stage("c", ("c",))), 3)
    (r,) = funnel.attempts(events.select("user_id").distinct(), events, [spec], "2025-06-30 00:00:00").collect()
    assert r.stage_times == [at(0), at(1), at(2)] and r.stage_events == ["e0", "e3", "e4"] and r.status == "completed" and r.seconds == 7200


def periods(spark, states):
    """One member per text: x active, . quiet, ? unobserved."""
    rows = [("d", f"u{k}", at(5), "c", i, DAY + dt.timedelta(weeks=i), s != "?", s == "x") for k, text in enumerate(states) for i, s in enumerate(text)]
    return spark.createDataFrame(rows, "definition_id string, user_id string, anchor_ts timestamp_ntz, cohort string, period int, period_start timestamp_ntz, observed boolean, active boolean")


def test_retention_hides_by_observed_and_counts_the_never_active(spark):
    rows = periods(spark, ["xx.", "x.x", "..?", "x??", "x.?"])
    table = {r.period: r for r in retention.long(rows, 3).collect()}
    assert (table[1].observed, table[1].rate) == (4, 0.25) and (table[2].observed, table[2].rate) == (2, None)
    (r,) = retention.cohort_summary(rows).collect()
    assert (r.members, r.returned, r.inactive, r.resurrected, r.censored, r.median_days_to_return) == (5, 2, 1, 1, 3, 9)  # 6 and 13 whole days from the anchor
    assert retention.broken_retention(retention.long(rows, 3)).count() == 0


def test_lifecycle_streak_stands_still_when_censored(spark):
    got = {(r.user_id, r.period): (r.state, r.quiet_periods) for r in retention.lifecycle(periods(spark, ["x..x", ".x??", "...?"]), 2, 3).collect()}
    assert [got["u0", i] for i in range(4)] == [("new", 0), ("inactive", 1), ("inactive", 2), ("resurrected", 2)]
    assert [got["u1", i] for i in range(4)] == [("inactive", 1), ("active", 1), ("censored", 1), ("censored", 1)]
    assert [got["u2", i] for i in range(4)] == [("inactive", 1), ("inactive", 2), ("churned_descriptive", 3), ("censored", 4)]


def test_calibration_has_four_bins_and_resurrections_need_more_than_a_week(spark):
    scored = spark.createDataFrame([(0.1, 0), (0.2, 1), (1.0, 1)], "score double, churned int")
    assert [(r.lower, r.upper, r.n, r.mean_score, r.observed_rate) for r in churn.calibration(scored).collect()] == [(0.0, 0.25, 2, 0.15, 0.5), (0.25, 0.5, 0, 0.0, 0.0), (0.5, 0.75, 0, 0.0, 0.0), (0.75, 1.0, 1, 1.0, 1.0)]
    points = spark.createDataFrame([("u", DAY, DAY + dt.timedelta(days=40))], "user_id string, feature_start timestamp_ntz, snapshot_ts timestamp_ntz")
    days = spark.createDataFrame([("u", str(d), DAY + dt.timedelta(days=d), "view", 1, 1.0) for d in (0, 7, 15, 16)], "user_id string, event_id string, ts timestamp_ntz, event_name string, k int, value double")
    (r,) = churn.features(points, days, ["view", "error"], ["error"]).collect()
    assert (r.longest_gap, r.resurrections) == (8, 1)


def test_choices(spark):
    table = spark.createDataFrame([(0.3, 0.5), (0.4, 0.6), (0.7, 0.6)], "threshold double, f1 double")
    assert churn.best_threshold(table).first().threshold == 0.7
    models = spark.createDataFrame([("forest", 0.8, 0.1), ("logistic", 0.8, 0.1), ("baseline", 0.8, 0.2)], "model string, average_precision double, brier double")
    assert churn.best_model(models).first().model == "logistic"
    found = spark.createDataFrame([(2, 0.4, 0.9, 20), (3, 0.4, 0.9, 9), (4, 0.9, 1.0, 2)], "k int, silhouette double, stability double, smallest long")
    assert {r.k: r.status for r in segmentation.chosen_clusters(found, 5).collect()} == {2: "selected", 3: "eligible", 4: "rejected"}
    comparison = spark.createDataFrame([("item_item_cf", 0.4, 0.3, 0.9), ("global_popularity", 0.4, 0.3, 0.9), ("segment_popularity", 0.9, 0.9, 0.1)], "model string, ndcg double, recall double, coverage double")
    assert [r.model for r in recommend.chosen(comparison, 0.5).where("selected").collect()] == ["global_popularity"]


def test_differentiators_by_absolute_difference_and_later_name(spark):
    profile = spark.createDataFrame([("s", "a", 2.0), ("s", "b", -2.0), ("s", "c", 1.0), ("s", "d", 0.5)], "segment string, metric string, difference double")
    assert [(r.rank, r.label) for r in segmentation.differentiating(profile, "segment").orderBy("rank").collect()] == [(1, "b:below_population"), (2, "a:above_population"), (3, "c:above_population")]


def test_eligibility_chain(spark):
    schema = "item string, active boolean, repeatable boolean, plans array<string>, personas array<string>, sizes array<string>, required array<string>, incompatible array<string>"
    shelf = [("ok", True, False, ["p"], [], [], [], []), ("off", False, False, ["p"], [], [], [], []), ("had", True, False, ["p"], [], [], [], []), ("again", True, True, ["p"], [], [], [], []), ("plan", True, False, ["q"], [], [], [], []), ("who", True, False, ["p"], ["z"], [], [], []), ("after", True, False, ["p"], [], [], ["had", "x"], []), ("not", True, False, ["p"], [], [], [], ["had"])]
    users = spark.createDataFrame([("u", "p", "a", "s"), ("w", "p", "z", "s")], "user_id string, plan string, persona string, size string")
    found = spark.createDataFrame([("u", "had", True), ("u", "again", True)], "user_id string, item string, consumed boolean")
    got = {(r.user_id, r.item, r.already_consumed) for r in recommend.eligible(users, spark.createDataFrame(shelf, schema), found).collect()}
    assert got == {("u", "ok", 0), ("u", "again", 1), ("w", "ok", 0), ("w", "had", 0), ("w", "again", 0), ("w", "who", 0), ("w", "not", 0)}


def test_governance_blocks_words_and_missing_sources(spark):
    one = spark.range(1).select(F.lit("x").alias("a"))
    good = reporting.insight(one, "segmentation", "T", "Said %s", "Act", "src", ["These are analytical interpretations."]).unionByName(reporting.insight(one, "experiment", "T", "Said %s", "Act", "src", ["Mind the sample-size."]))
    assert reporting.governance(good, ["src"]).first().status == "passed"
    bad = good.unionByName(reporting.insight(one, "funnel", "T", "It caused %s", "Act", "other", []))
    r = reporting.governance(bad, ["src"]).first()
    assert (r.status, r.no_causal_language, r.sources_exist, r.have_sources) == ("failed", False, False, True)
    assert [x[0] for x in spark.createDataFrame([("3.0",), ("0.1234567",), ("abc",), ("",), (None,)], "v string").select(reporting.normalised(F.col("v"))).collect()] == ["3", "0.123457", "abc", "", ""]


def test_duplicates_under_reject(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "n int, k string")
    assert {r.n: r.outcome for r in quality.deduplicated(rows, ["k"], ["n"], "reject").collect()} == {1: "discarded", 2: "quarantined", 3: "accepted"}
