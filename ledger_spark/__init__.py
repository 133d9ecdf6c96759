"""ledger_spark: transaction analytics expressed as Spark DataFrame plans.

Sub-packages
------------
sources    readers, writers, table maintenance and the test-table adapter
functions  column expressions (cleaning, dates, money, rules, tokens)
operators  DataFrame -> DataFrame operators (reports, dashboard, text,
           features, classifiers, evaluation, forecasts)
plans      composed, named queries (the registry behind ``__spark_entry__``)
streaming  Structured Streaming versions of the live paths
"""

from ledger_spark.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
