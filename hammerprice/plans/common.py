"""The driver tables as sale listings, and what SQL twins share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import money
from ..registry import table

#: The instant that all time-dependent queries take as now.
AS_OF = "2001-06-30 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """brand, kind, part_key, supplier, price (money), quantity, sold: one row per line of an order."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    line = table(spark, sf_dir, "lineitem").where("l_quantity > 0")
    price = money(F.col("l_extendedprice") / F.col("l_quantity"))
    out = line.join(part, line.l_partkey == part.p_partkey)
    return out.select(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"), F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supplier"), "l_orderkey", "l_linenumber", price.alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_shipdate").cast("timestamp").alias("sold"))


#: The same for DuckDB.
SALES = """sales AS (SELECT p_brand AS brand, p_type AS kind, p_name AS name, l_partkey AS part_key, l_suppkey AS supplier, l_orderkey, l_linenumber,
  floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS price, l_quantity AS quantity, l_shipdate AS sold
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0)"""


def m(x: str) -> str:
    """``money`` in SQL."""
    return f"(floor(({x}) * 100 + 0.5) / 100)"
