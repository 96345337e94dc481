"""Models by their invariants: fits differ between libraries, these do not."""

import numpy as np
import pytest

from tidemark.operators import models

COLUMNS = "user_id int, split string, y int, a double, b double"


def table(spark, labels):
    return spark.createDataFrame([(i, "train" if i % 5 else "test", y, float(y * 4 + i % 3), float(i % 7)) for i, y in enumerate(labels)], COLUMNS)


def test_logistic_separates_and_baseline_is_the_share(spark):
    rows = table(spark, [i % 2 for i in range(40)])
    scores = {r.user_id: r for r in models.classified(rows, ["a", "b"], "y", "split").collect()}
    assert min(r.score for r in scores.values() if r.y) > max(r.score for r in scores.values() if not r.y)
    assert {r.score for r in models.classified(rows, ["a"], "y", "split", "baseline").collect()} == {0.5}


def test_one_class_is_an_error_but_for_the_baseline(spark):
    rows = table(spark, [0] * 20)
    with pytest.raises(ValueError):
        models.classified(rows, ["a"], "y", "split")
    assert models.classified(rows, ["a"], "y", "split", "baseline").first().score == 0.0


def test_clusters_are_named_by_size_and_standardising_is_exact(spark):
    rows = table(spark, [int(i < 10) for i in range(40)])
    got = {r.user_id: r.cluster for r in models.clustered(rows, ["a"], 2, 2).collect()}
    assert {got[i] for i in range(10)} == {"cluster_02"} and {got[i] for i in range(10, 40)} == {"cluster_01"}
    z = [r.a for r in models.standardised(rows, ["a"]).collect()]
    assert abs(sum(z)) < 1e-9 and abs(sum(x * x for x in z) / len(z) - 1) < 1e-9


def blobs(spark, n=240):
    """Three groups of 2 : 1 : 1 rows around (0, 0), (20, 0) and (0, 20), and a column that every row has in common."""
    around = [(0.0, 0.0), (20.0, 0.0), (0.0, 0.0), (0.0, 20.0)]
    return spark.createDataFrame([(i, around[i % 4][0] + i % 7 / 7, around[i % 4][1] + i % 5 / 5, 1.0) for i in range(n)], "user_id int, a double, b double, c double")


def test_all_starts_of_all_candidates_share_their_passes(spark):
    found = {}
    for starts in (1, 20):
        spark.sparkContext.setJobGroup(f"starts{starts}", "candidates")
        found[starts] = {r.k: r for r in models.cluster_candidates(blobs(spark), ["a", "b", "c"], [2, 3, 4], 5, seeds=3, starts=starts).collect()}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    few, many = (len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"starts{starts}")) for starts in (1, 20))
    assert many < few + 40, f"{many} jobs for twenty starts, {few} for one"
    got = found[20][3]
    assert (got.status, got.smallest, got.stability) == ("selected", 60, 1.0) and got.silhouette > 0.95


def test_starts_do_not_depend_on_partitions_and_equal_rows_are_no_second_centre(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import kmeans

    rows = blobs(spark).withColumn("key", F.xxhash64("user_id"))
    one, many = (kmeans.fitted(rows.repartition(n), ["a", "b"], "key", [(3, s) for s in range(4)]) for n in (1, 7))
    assert [f.sizes for f in one] == [f.sizes for f in many] and all(abs(f.cost - g.cost) < 1e-6 for f, g in zip(one, many, strict=True))
    x = np.array([(r.a, r.b) for r in rows.collect()])
    for fit in many:
        nearest = ((x[:, None] - fit.centres) ** 2).sum(2)
        assert abs(nearest.min(1).sum() - fit.cost) < 1e-6 and fit.sizes == tuple(np.bincount(nearest.argmin(1), minlength=3))
    two = spark.createDataFrame([(i, float(i == 0)) for i in range(50)], "key long, a double")
    assert all(sorted(f.sizes) == [1, 49] and f.cost == 0 for f in kmeans.fitted(two, ["a"], "key", [(2, s) for s in range(9)]))
    with pytest.raises(ValueError):
        kmeans.fitted(two, ["a"], "key", [(3, 0)])


def test_agreement_equals_the_operator_on_rows(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import kmeans, segmentation

    rows = blobs(spark).select((F.col("user_id") % 4).alias("p"), (F.col("user_id") % 6).alias("q"), F.lit(0).alias("one"))
    pairs = [("p", "q"), ("q", "p"), ("p", "p"), ("one", "one"), ("p", "one")]
    assert kmeans.agreements(rows, pairs) == {(a, b): segmentation.adjusted_rand(rows, a, b).first()[0] for a, b in pairs}
