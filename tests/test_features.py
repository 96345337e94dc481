"""Feature matrices, preprocessing and measures of models against values worked out by hand."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest

from tidemark.operators import features, models

START = datetime(2024, 1, 1)
QUALIFYING = ["task_created", "task_completed", "invite_sent", "onboarding_step_completed"]
EVENTS, SESSIONS = "user_id int, session_id string, ts timestamp_ntz, event_name string, feature_name string, step string", "user_id int, start_ts timestamp_ntz, duration_seconds int"
USAGE, PERIODS = "user_id int, day date, feature_name string, usage_count int, error_count int", "user_id int, period_id int, start_ts timestamp_ntz, end_ts timestamp_ntz, plan string, cycle string, status string, mrr double"
POINTS = "user_id int, signup_ts timestamp_ntz, snapshot_ts timestamp_ntz, feature_start timestamp_ntz, " + ", ".join(f"{c} string" for c in features.PROFILE)


def at(days, hours=0):
    return START + timedelta(days=days, hours=hours)


def wide(spark, more_events=(), more_periods=()):
    events = [
        (1, "a", at(-20), "plan_upgraded", None, None), (1, "a", at(-9), "task_created", None, None), (1, "b", at(1), "task_created", "collaboration", None), (1, "b", at(1, 1), "task_completed", "automation", None),
        (1, "b", at(6), "feature_error", "search", None), (1, "c", at(8), "onboarding_step_completed", None, "x"), (1, "c", at(9), "onboarding_step_completed", None, "x"), (1, None, at(10), "task_created", "collaboration_board", None), *more_events,
    ]
    sessions = [(1, at(-9), 999), (1, at(1), 60), (1, at(8), 31)]
    usage = [(1, date(2024, 1, 3), "automation", 4, 1), (1, date(2023, 12, 1), "reports", 9, 9)]
    periods = [(1, 1, at(-30), at(-5), "free", "monthly", "ended", 0.0), (1, 2, at(-5), None, "pro", "annual", "active", 25.0), *more_periods]
    points = [(1, at(-40), at(10), at(0), "NO", "EU", "paid", None, "p", "s", "free", "true", "false"), (2, at(-3), at(10), at(0), *["z"] * 9)]
    rows = features.tagged(spark.createDataFrame(events, EVENTS), spark.createDataFrame(sessions, SESSIONS), spark.createDataFrame(usage, USAGE), spark.createDataFrame(periods, PERIODS))
    return features.activity(spark.createDataFrame(points, POINTS), rows, QUALIFYING)


def test_churn_matrix_by_hand(spark):
    got = {r.user_id: r.asDict() for r in features.churn_matrix(wide(spark)).collect()}
    assert list(got[1])[2:] == features.CHURN_NUMERIC + features.CHURN_CATEGORICAL and len(got[1]) == 2 + 29 + 14
    want = {
        "account_age_days": 50, "sessions_in_lookback": 2, "active_days_in_lookback": 4, "qualifying_events_in_lookback": 5, "events_per_active_day": 1.25, "average_session_duration_seconds": 45.5, "days_since_last_qualifying_activity": 0,
        "active_day_proportion": 0.4, "recent_sessions": 1, "prior_sessions": 1, "session_delta": 0, "recent_qualifying_events": 3, "prior_qualifying_events": 2, "event_delta": 1, "distinct_features_used": 4, "collaboration_actions": 2,
        "automation_actions": 5, "feature_errors": 1, "feature_usage_errors": 1, "error_rate": 0.2, "days_on_current_plan": 15, "mrr_at_snapshot": 25.0, "prior_subscription_changes": 1, "historical_active_days": 7,
        "longest_inactivity_gap_days": 11, "plan_at_snapshot": "pro", "billing_cycle_at_snapshot": "annual", "subscription_status_at_snapshot": "active", "activated_before_snapshot": "True", "paid_before_snapshot": "True", "device_preference": "unknown",
    }
    assert {k: got[1][k] for k in want} == want
    nothing = got[2]
    assert nothing["days_since_last_qualifying_activity"] == 999 and nothing["plan_at_snapshot"] == "unknown" and nothing["paid_before_snapshot"] == "False"
    assert all(nothing[c] == 0 for c in features.CHURN_NUMERIC if c not in ("account_age_days", "days_since_last_qualifying_activity"))


def test_segment_matrix_by_hand(spark):
    got = {r.user_id: r.asDict() for r in features.segment_matrix(wide(spark)).collect()}
    assert list(got[1])[2:] == features.SEGMENT_NUMERIC + features.SEGMENT_BINARY + features.SEGMENT_PROFILE and len(got[1]) == 2 + 51 + 9 + 8
    want = {
        "meaningful_sessions": 3, "tasks_created": 2, "tasks_completed": 1, "task_completion_ratio": 0.5, "collaboration_active_days": 1, "advanced_feature_count": 1, "upgrade_count": 1, "error_event_rate": 0.166667, "sessions_containing_errors": 1,
        "onboarding_step_repetitions": 1, "active_periods_in_lookback": 2, "longest_inactivity_gap_days": 10, "prior_resurrection_count": 1, "recent_engagement_decline": 0, "highest_activation_stage": 3, "paid_user_flag": 0, "incomplete_onboarding_flag": 1,
        "current_plan": "pro", "activation_achieved": 1,
    }
    assert {k: got[1][k] for k in want} == want
    assert got[2]["highest_activation_stage"] == 0 and got[2]["days_since_last_activity"] == 999


def test_what_comes_later_changes_no_feature(spark):
    later = [(1, "d", at(10, 1), "task_completed", "new", None), (2, "d", at(11), "invite_sent", None, None)]
    period = [(1, 9, at(11), None, "enterprise", "annual", "active", 99.0)]
    for matrix in (features.churn_matrix, features.segment_matrix):
        assert matrix(wide(spark)).collect() == matrix(wide(spark, later, period)).collect()


def test_preprocessing_learns_from_training_rows_alone(spark):
    rows = spark.createDataFrame(
        [(1, "train", 1.0, "a", 5.0), (2, "train", 3.0, "b", 5.0), (3, "train", None, "b", 5.0), (4, "test", None, None, 7.0), (5, "test", 9.0, "unseen", 5.0)], "user_id int, split string, x double, c string, flat double"
    )
    got = {(r.user_id, r.column): r.value for r in features.preprocessed(rows, ["x", "flat"], ["c"]).collect()}
    deviation = np.std([1.0, 3.0, 2.0])
    assert got[1, "x"] == round(-1 / deviation, 6) and got[3, "x"] == got[4, "x"] == 0.0 and got[5, "x"] == round(7 / deviation, 6)
    assert got[4, "flat"] == 2.0 and got[5, "flat"] == 0.0  # a constant column is centred and not scaled
    assert {k for k in got if k[1].startswith("c=")} == {(1, "c=a"), (2, "c=b"), (3, "c=b"), (4, "c=b")}


def table(spark, n=60):
    r = np.random.default_rng(3)
    rows = [(i, "train" if i % 4 else "test", int(x > 0), float(x), float(y), ["u", "v", None][i % 3] if i % 4 else "w", i % 3) for i, (x, y) in enumerate(r.normal(size=(n, 2)).tolist())]
    return spark.createDataFrame(rows, "user_id int, split string, y int, a double, b double, c string, g int")


@pytest.mark.parametrize("kind", ["logistic", "forest"])
def test_importances_name_every_column_once(spark, kind):
    got = models.importance(table(spark), ["a", "b"], "y", "split", kind, ["c"]).collect()
    assert sorted(r.feature for r in got) == ["a", "b", "c=u", "c=v"] and got[0].feature == "a" and [r.rank for r in got] == [1, 2, 3, 4]
    assert [(r.importance, r.feature) for r in got] == sorted(((r.importance, r.feature) for r in got), reverse=True)
    assert all((r.signed_value is None) == (kind == "forest") for r in got)
    if kind == "forest":
        assert abs(sum(r.importance for r in got) - 1) < 1e-5
    scores = models.classified(table(spark), ["a", "b"], "y", "split", kind, ["c"]).collect()
    assert len(scores) == 60 and min(r.score for r in scores if r.y and r.split == "train") > max(r.score for r in scores if not r.y and r.split == "train") - 0.5


def test_components_and_validity_against_numpy(spark):
    rows = table(spark)
    x = np.array([(r.a, r.b, r.a + r.b) for r in rows.orderBy("user_id").collect()])
    z = (x - x.mean(0)) / x.std(0)
    rows = rows.withColumn("s", rows.a + rows.b)
    values, vectors = np.linalg.eigh(z.T @ z / len(z))
    got = models.explained(rows, ["a", "b", "s"], 2).collect()
    assert [r.explained_variance for r in got] == [round(v, 6) for v in (values[::-1] / values.sum())[:2]]
    first = vectors[:, -1] * np.sign(vectors[np.argmax(abs(vectors[:, -1])), -1])
    assert np.allclose([r.pc_1 for r in models.components(rows, ["a", "b", "s"]).orderBy("user_id").collect()], z @ first, atol=2e-6)
    z, g = z[:, :2], np.array([r.g for r in rows.orderBy("user_id").collect()])
    means, sizes = np.array([z[g == k].mean(0) for k in range(3)]), np.bincount(g)
    inner = sum(((z[g == k] - means[k]) ** 2).sum() for k in range(3))
    scatter = np.array([np.sqrt(((z[g == k] - means[k]) ** 2).sum(1)).mean() for k in range(3)])
    worst = [max((scatter[i] + scatter[j]) / np.linalg.norm(means[i] - means[j]) for j in range(3) if j != i) for i in range(3)]
    found = models.validity(rows, ["a", "b"], "g").first()
    assert abs(found.calinski_harabasz - (sizes * (means**2).sum(1)).sum() / 2 / (inner / 57)) < 1e-5 and abs(found.davies_bouldin - np.mean(worst)) < 1e-5
    one = models.validity(rows.withColumn("g", rows.g * 0), ["a", "b"], "g").first()
    assert one.calinski_harabasz is None and one.davies_bouldin is None


def test_candidates_measure_the_best_of_many_starts(spark):
    rows = table(spark, 40)
    got = {r.k: r for r in models.cluster_candidates(rows, ["a", "b"], [2, 3, 50], 2, seeds=2, starts=4).collect()}
    assert got[50].status == "rejected" and got[50].davies_bouldin is None and got[50].smallest == 0
    assert got[2].calinski_harabasz > 0 and got[3].davies_bouldin > 0 and sum(r.status == "selected" for r in got.values()) == 1


def test_lines_are_numbered_in_folders_of_files(spark, tmp_path):
    from tidemark.sources.ingestion import numbered

    for name, n in (("a", 3000), ("b", 4000), ("c", 1)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i:05d}\n" for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = numbered(spark.read.text(str(tmp_path))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 7001 and all(int(r.value[1:]) == r.line and r.file.endswith(f"{r.value[0]}.txt") for r in got)


def test_diversity_of_a_large_catalogue(spark):
    from tidemark.operators import recommend

    items = spark.range(12000).selectExpr("cast(id AS int) AS item", "cast(id AS string) AS category")
    ranked = spark.range(12000).selectExpr("cast(id DIV 4 AS int) AS user_id", "cast(id AS int) AS item", "cast(id % 4 + 1 AS int) AS rank")
    assert recommend.diversity(ranked, items, 4).first().diversity == 1.0
