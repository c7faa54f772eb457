"""Scans and sinks: each sink is read back from the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.sources import io

from .base import load, query, r, sql_r


@query("scan_csv_gz", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def scan_csv_gz(spark, d):
    path = io.scratch(spark, "orders-csv")
    df = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    df.write.csv(path, header=True, compression="gzip")
    return io.read_csv(spark, path, df.schema)


@query("scan_limit", """
SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem
ORDER BY l_orderkey, l_partkey, l_suppkey, l_extendedprice LIMIT 1000""")
def scan_limit(spark, d):
    df = load(spark, d, "lineitem")
    rows = io.first_rows(df, 1000, ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"])
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")


@query("scan_parquet", "SELECT * FROM orders")
def scan_parquet(spark, d):
    return io.read_table(spark, f"{d}/orders.parquet")


@query("sink_cohort", "SELECT o_orderkey, o_custkey, o_totalprice, (SELECT count(*) FROM orders) AS written FROM orders")
def sink_cohort(spark, d):
    path = io.scratch(spark, "cohort")
    rows = io.write_cohort(load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), path)
    return spark.read.parquet(path).withColumn("written", F.lit(rows).cast("bigint"))


METHODS = {"low": "l_quantity <= 25", "high": "l_quantity > 25"}


@query("sink_metrics", " UNION ALL ".join(
    f"SELECT {sql_r('avg(l_extendedprice)', 4)} AS price, {sql_r('avg(l_discount)')} AS discount, '{m}' AS method FROM lineitem WHERE {w}"
    for m, w in METHODS.items()))
def sink_metrics(spark, d):
    path, lines = io.scratch(spark, "metrics"), load(spark, d, "lineitem")
    for method, rule in METHODS.items():
        row = lines.where(rule).agg(r(F.avg("l_extendedprice"), 4).alias("price"), r(F.avg("l_discount")).alias("discount"))
        io.append_metrics(row, path, method)
    return spark.read.schema("price double, discount double, method string").parquet(path)
