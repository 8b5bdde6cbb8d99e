"""Domain views over the star schema: each operator's input, derived the same way every time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series_name(fine: bool = True):
    return F.concat_ws("|", "p_brand", "p_type") if fine else F.col("p_brand")


def monthly(spark: SparkSession, sf_dir: str, fine: bool = True) -> DataFrame:
    """series_id, x (year * 12 + month), y (quantity): the observations, one point per month. Quantities are added by part and
    month first, so one row of those meets the join."""
    part = table(spark, sf_dir, "part").select("p_partkey", series_name(fine).alias("series_id"))
    items = table(spark, sf_dir, "lineitem").select("l_partkey", (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("x"), "l_quantity")
    items = items.groupBy("l_partkey", "x").agg(F.sum("l_quantity").alias("q"))
    return items.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("series_id", "x").agg(F.sum("q").alias("y"))


#: A yearly series from 2000 on that is flat but for noise; nothing may ever fire on it.
CONTROL = (100, 103, 98, 101, 99, 102, 100, 97, 101, 100, 103, 98, 100, 99, 102, 100, 101, 98, 100, 103, 99, 100, 102, 98, 101)


def with_control(points: DataFrame) -> DataFrame:
    """points (series_id, x, y) and the control series beside them, its years as their steps 24000, 24001, ..."""
    spark = points.sparkSession
    flat = spark.createDataFrame([(float(k), float(v)) for k, v in enumerate(CONTROL)], "x double, y double").select(F.lit("control").alias("series_id"), (F.col("x") + 24000).alias("x"), "y")
    return points.select("series_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).unionByName(flat)


def quarterly(spark: SparkSession, sf_dir: str, fine: bool = False) -> DataFrame:
    """series_id, cohort (p_type), x (quarter: year * 4 + 0 to 3), y (quantity)."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("|", "p_brand", "p_type").alias("series_id"), F.col("p_type").alias("cohort"))
    items = table(spark, sf_dir, "lineitem").select("l_partkey", (F.year("l_shipdate") * 4 + F.quarter("l_shipdate") - 1).alias("x"), "l_quantity")
    items = items.groupBy("l_partkey", "x").agg(F.sum("l_quantity").alias("q"))
    return items.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("series_id", "cohort", "x").agg(F.sum("q").alias("y"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type, day, n, total value in cents (whole numbers, so that sums don't depend on their order)."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, month (from doc_id), category (source), lang, text: the corpus as dated papers."""
    d = table(spark, sf_dir, "documents")
    month = F.date_format(F.add_months(F.lit("2018-01-01").cast("date"), (F.col("doc_id") % 48).cast("int")), "yyyy-MM")
    return d.select("doc_id", month.alias("month"), F.col("source").alias("category"), "lang", "text")


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved forecasts: doc_id, source, p, outcome. p is a fixed function of the document's length."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    p = F.round(F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + F.col("n_chars") / 800.0), 6)
    return l.join(d, "doc_id").select("doc_id", "source", p.alias("p"), F.col("quality").alias("outcome"), F.col("toxic").alias("second"))
