"""The shared filter has no false negatives and separates."""

from pyspark.sql import functions as F

from ledger_spark.llm.common import may_contain


def test_filter_keeps_every_key_and_few_others(spark):
    keys = spark.range(0, 3000, 3).select(F.when(F.col("id") > 0, F.col("id")).alias("k"))  # one NULL
    rows = spark.range(3000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"))
    got = {r.k for r in rows.filter(may_contain(keys, "k", F.col("k"))).collect()}
    wanted = {None, *range(3, 3000, 3)}
    assert wanted <= got and len(got - wanted) < 5


def test_filter_of_nothing(spark):
    rows = spark.range(50)
    assert rows.filter(may_contain(rows.limit(0), "id", F.col("id"))).count() == 0
