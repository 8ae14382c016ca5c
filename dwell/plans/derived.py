"""Derived inputs for the scalar-function and audit queries, built on both sides
(Spark here, SQL text for the DuckDB oracle) from the driver tables.

Text attributes are produced from ``part`` / ``orders`` columns by a fixed rule
so every parser branch (good, padded, upper case, negative, unknown unit, blank,
null) occurs at every scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import stays as S


def part_text(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "part").select("p_partkey", "p_name", "p_type", "p_size")
    size = F.col("p_size").cast("string")
    age = (F.when(F.col("p_size") % 7 == 0, F.concat(size, F.lit(" days")))
           .when(F.col("p_size") % 7 == 1, F.concat(size, F.lit(" week")))
           .when(F.col("p_size") % 7 == 2, F.concat(F.lit(" "), size, F.lit(" MONTHS ")))
           .when(F.col("p_size") % 7 == 3, F.concat(size, F.lit(" years")))
           .when(F.col("p_size") % 7 == 4, F.concat(F.lit("-"), size, F.lit(" years")))
           .when(F.col("p_size") % 7 == 5, F.concat(size, F.lit(" fortnights"))))
    breed = (F.when(F.col("p_size") % 5 == 0, F.concat("p_type", F.lit(" Mix")))
             .when(F.col("p_size") % 5 == 1, F.concat("p_type", F.lit("/"), "p_name"))
             .when(F.col("p_size") % 5 == 2, F.col("p_type"))
             .when(F.col("p_size") % 5 == 3, F.lit("  "))
             .otherwise(F.lit("Mix")))
    color = (F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("Black/"), "p_name"))
             .when(F.col("p_size") % 4 == 1, F.concat("p_name", F.lit("/Black")))
             .when(F.col("p_size") % 4 == 2, F.lit("black tabby"))
             .otherwise(F.lit("BLACK")))
    sex = (F.when(F.col("p_size") % 6 == 0, F.lit("Neutered Male"))
           .when(F.col("p_size") % 6 == 1, F.lit("Intact Female"))
           .when(F.col("p_size") % 6 == 2, F.lit("Spayed Female"))
           .when(F.col("p_size") % 6 == 3, F.lit("Unknown"))
           .when(F.col("p_size") % 6 == 5, F.lit("intact male")))
    name = F.when(F.col("p_size") % 3 == 0, F.lit(" ")).when(F.col("p_size") % 3 == 1, F.lit("NA")) \
        .otherwise(F.col("p_name"))
    return p.select("p_partkey", age.alias("age_text"), breed.alias("breed_text"), color.alias("color_text"),
                    sex.alias("sex_text"), name.alias("name_text"))


PART_TEXT_SQL = """part_text AS (
  SELECT p_partkey,
    CASE p_size % 7 WHEN 0 THEN CAST(p_size AS VARCHAR) || ' days' WHEN 1 THEN CAST(p_size AS VARCHAR) || ' week'
      WHEN 2 THEN ' ' || CAST(p_size AS VARCHAR) || ' MONTHS ' WHEN 3 THEN CAST(p_size AS VARCHAR) || ' years'
      WHEN 4 THEN '-' || CAST(p_size AS VARCHAR) || ' years' WHEN 5 THEN CAST(p_size AS VARCHAR) || ' fortnights'
      END AS age_text,
    CASE p_size % 5 WHEN 0 THEN p_type || ' Mix' WHEN 1 THEN p_type || '/' || p_name WHEN 2 THEN p_type
      WHEN 3 THEN '  ' ELSE 'Mix' END AS breed_text,
    CASE p_size % 4 WHEN 0 THEN 'Black/' || p_name WHEN 1 THEN p_name || '/Black' WHEN 2 THEN 'black tabby'
      ELSE 'BLACK' END AS color_text,
    CASE p_size % 6 WHEN 0 THEN 'Neutered Male' WHEN 1 THEN 'Intact Female' WHEN 2 THEN 'Spayed Female'
      WHEN 3 THEN 'Unknown' WHEN 5 THEN 'intact male' END AS sex_text,
    CASE p_size % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'NA' ELSE p_name END AS name_text
  FROM part)"""


def order_text(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    k = F.col("o_orderkey") % 5
    text = (F.when(k == 0, iso).when(k == 1, F.concat(iso, F.lit("-05:00")))
            .when(k == 2, F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
            .when(k == 3, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("+0530")))
            .otherwise(F.lit("not a date")))
    return o.select("o_orderkey", "o_custkey", "o_orderdate", text.alias("ts_text"))


ORDER_TEXT_SQL = """order_text AS (
  SELECT o_orderkey, o_custkey, o_orderdate,
    CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000')
      WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000') || '-05:00'
      WHEN 2 THEN ' ' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z'
      WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '+0530'
      ELSE 'not a date' END AS ts_text
  FROM orders)"""


def stays_with_customer(spark: SparkSession, root: str, **kw) -> DataFrame:
    c = table(spark, root, "customer").select(F.col("c_custkey").alias("key"), "c_mktsegment", "c_nationkey")
    return S.stays(spark, root, **kw).join(c, "key", "left").withColumn(
        "start_month", F.month("start_ts"))


STAYS_CUST_SQL = """stays_c AS (
  SELECT s.*, c.c_mktsegment, c.c_nationkey, month(s.start_ts) AS start_month
  FROM stays s LEFT JOIN customer c ON s.key = c.c_custkey)"""
