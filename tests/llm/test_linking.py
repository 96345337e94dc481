"""Centres of buckets."""

from tidemark.llm import linking


def test_later_centres_are_of_the_second_largest_component(spark):
    rows = spark.createDataFrame([(7, i, 1, 0 if i < 5 else 5 if i < 8 else i, 10) for i in range(10)], "key long, node long, times int, component long, n int")
    pairs = {tuple(x) for x in linking.centred(rows, ["n"], "s.n = t.n", 1).collect()}
    centre = next(c for c in (5, 6, 7) if all(c in p for p in pairs))
    assert pairs == {tuple(sorted((centre, i))) for i in [*range(5), 8, 9]}
    plan = linking.centred(rows, ["n"], "s.n = t.n", 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
