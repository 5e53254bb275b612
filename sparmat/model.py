"""The annotated matrix as tables.

``Matrix`` holds the long form: ``entries`` (obs_id, var_id, value) with absent entries meaning zero, and
the side tables ``obs`` (obs_id, ...) and ``var`` (var_id, ...). Statistics over observations divide by the
number of rows of ``obs``, not by the number of entries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparmat.session import table


@dataclass(frozen=True)
class Matrix:
    entries: DataFrame
    obs: DataFrame
    var: DataFrame


def orders_matrix(spark: SparkSession, d: str) -> Matrix:
    """The driver tables as a matrix: observations are orders, variables are parts, values are quantities."""
    entries = (
        table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("obs_id"), F.col("l_partkey").alias("var_id")).agg(F.sum("l_quantity").alias("value"))
    )
    obs = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("obs_id"), F.col("o_orderpriority").alias("grp"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("custkey")
    )
    var = table(spark, d, "part").select(
        F.col("p_partkey").alias("var_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"), F.col("p_name").alias("name")
    )
    return Matrix(entries, obs, var)
