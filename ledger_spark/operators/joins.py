"""Join helpers (C2 and the dimension lookups).

No join carries a broadcast hint. Dimensions come as local or stored tables
whose size the planner knows in bytes, so it broadcasts them below
``spark.sql.autoBroadcastJoinThreshold`` and sort-merges beyond it, where AQE
splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, dim: DataFrame, key: str, dim_key: str, value_cols: list[str],
           how: str = "inner") -> DataFrame:
    """Join a dimension's columns onto ``df`` by key."""
    return df.join(dim.select(F.col(dim_key).alias(key), *value_cols), key, how)
