"""The list of checksums of a result set."""

import glob

from tidemark.sources import published


def test_a_short_listing_is_one_part(spark, tmp_path):
    rows = spark.range(0, 40, 1, 5).selectExpr("id", "id % 7 AS n")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        published.publish(spark, str(tmp_path / "set"), "make-sets", {}, {"a": published.Output(rows, ("n",)), "b": published.Output(rows, ("id",), "jsonl")})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(glob.glob(str(tmp_path / "set/checksums/part-*"))) == 1
    said = published.stored(spark, str(tmp_path / "set")).select("output", "part").collect()
    assert said == sorted(said) and len(said) == sum(o["parts"] for o in published.manifest(spark, str(tmp_path / "set"))["outputs"].values())
