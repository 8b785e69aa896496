"""Task inputs derived from the relational test tables (see the mapping in FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synthcal.operators import bradley_terry as bt
from synthcal.operators.moments import paired_stats, weighted_cells

LAST_CALIB, PREDICT = 1999, 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their part's brand and type: x real, y synthetic, w weight."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", F.col("l_discount").alias("x"), F.col("l_tax").alias("y"), F.col("l_quantity").alias("w"), F.col("l_extendedprice").alias("price"), "l_linestatus", "l_linenumber")
    return line.join(part, "l_partkey").withColumn("task_id", F.concat_ws("|", "p_brand", "p_type"))


def paired_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired_stats(pairs(spark, sf_dir), ["task_id"], "x", "y")


def temporal_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks (year, brand): years to 1999 calibrate, 2000 is predicted."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("year"))
    rows = pairs(spark, sf_dir).select("l_orderkey", "p_brand", "x", "y").join(orders.where(F.col("year") <= PREDICT), "l_orderkey")
    stats = paired_stats(rows, ["year", "p_brand"], "x", "y")
    role = F.when(F.col("year") == PREDICT, "predict").otherwise("calib")
    return stats.select(F.concat_ws(":", F.col("year").cast("string"), "p_brand").alias("task_id"), "year", F.concat_ws(" / ", "p_brand", F.col("year").cast("string")).alias("label"), role.alias("role"), *[c for c in stats.columns if c not in ("year", "p_brand")])


CELL = ["wave", "party", "region"]


def cell_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as respondents of a wave, party and region: x real, y synthetic, w weight."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("region"))
    customer = table(spark, sf_dir, "customer").join(nation, "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "region")
    orders = table(spark, sf_dir, "orders").join(customer, "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("wave"), "region")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("party"), (F.col("l_discount") * 10).alias("x"), (F.col("l_tax") * 10).alias("y"), F.col("l_quantity").alias("w"))
    return line.join(orders, "l_orderkey")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted cells (wave, party, region)."""
    return weighted_cells(cell_rows(spark, sf_dir), CELL, "x", "y", "w")


def battles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines of an order from suppliers of different nations: the dearer wins, by quantity for the automatic judge."""
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity").join(supplier, "l_suppkey").drop("l_suppkey")
    a, b = line.alias("a"), line.alias("b")
    met = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber")) & (F.col("a.nation") != F.col("b.nation")))
    won = lambda c: F.when(F.col(f"a.{c}") > F.col(f"b.{c}"), 1.0).when(F.col(f"a.{c}") < F.col(f"b.{c}"), 0.0).otherwise(0.5)
    return met.select(F.col("a.nation").alias("a"), F.col("b.nation").alias("b"), won("l_extendedprice").alias("y"), won("l_quantity").alias("y_auto"))


def battle_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.pair_stats(battles(spark, sf_dir))
