"""What the driver keeps of op12's plans."""

from tidemark.llm import byte_bpe, registry


def test_vocabulary_is_no_literal_of_plans(spark):
    codec = byte_bpe.Codec(spark, registry.VOCABULARY)
    docs = spark.createDataFrame([("a",), ("",), (None,)], "t string")
    plan = codec.decoded(docs, "t", "back").withColumn("pairs", codec._pairs)
    assert len(plan._jdf.queryExecution().toString()) < 1 << 16
    first = next(t for t, i in byte_bpe.tokens_of(registry.VOCABULARY).items() if i == ord("a"))
    assert [r.back for r in plan.drop("pairs").collect()] == [first, b"", None]
