import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from ledger_spark.session import get_spark

    s = get_spark(master="local[4]", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def cats(spark):
    from ledger_spark.sources.maintenance import seed_categories

    return seed_categories(spark)


def tx(spark, rows, cats=None):
    """Inline transactions: (id, 'YYYY-MM-DD', description, amount, category name or None)."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "id long, date string, description string, amount string, category string")
    df = df.select("id", F.to_date("date").alias("date"), "description",
                   F.col("amount").cast("decimal(12,2)").alias("amount"), "category")
    if cats is not None:
        ids = cats.select(F.col("name").alias("category"), F.col("id").alias("category_id"))
        df = df.join(ids, "category", "left").drop("category")
    return df
