"""Streaming runs over the tables, checked against the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators.table import TableEncoder
from tabloom.streaming import jobs

from tabloom.sources.io import scratch

from .base import load, query, r, sql_r

FIELDS = ["event_id", "ts", "event_type", "value"]


def events(spark, d):
    return jobs.table_stream(spark, f"{d}/[e]vents.parquet").select(*FIELDS)


@query("stream_encode", f"""
WITH i AS (SELECT event_type, (2 * cum - n)::DOUBLE / (2 * total) AS mid FROM (SELECT event_type, count(*) AS n,
   sum(count(*)) OVER () AS total, sum(count(*)) OVER (ORDER BY count(*) DESC, event_type ROWS UNBOUNDED PRECEDING) AS cum
   FROM events GROUP BY event_type))
SELECT event_id, {sql_r('epoch_us(ts)::DOUBLE / 1e9', 3)} AS ts__value, {sql_r('mid', 9)} AS event_type__value, value AS value__value
FROM events JOIN i USING (event_type)""")
def stream_encode(spark, d):
    batch = spark.read.parquet(f"{d}/events.parquet").select(*FIELDS)
    encoder = TableEncoder(keep=("event_id",)).fit(batch)
    out = jobs.run_to_files(jobs.encode_stream(events(spark, d), encoder), spark, "encoded")
    return out.withColumns({"ts__value": r(F.col("ts__value") / 1e9, 3), "event_type__value": r(F.col("event_type__value"), 9)})


# append mode emits a window once the watermark (newest event minus the delay) has passed its end
@query("stream_thin", f"""
SELECT event_type, window_start, {sql_r('avg(value)')} AS value, count(*) AS n
FROM (SELECT event_type, value, time_bucket(INTERVAL 1 HOUR, ts) AS window_start FROM events)
WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events) GROUP BY ALL""")
def stream_thin(spark, d):
    thinned = jobs.thin_stream(events(spark, d), ["event_type"], "ts", "value", "1 hour", "2 hours")
    return jobs.run_to_files(thinned, spark, "thinned").withColumn("value", r(F.col("value")))


# an order is a category here: more of them than fit literals, so decoding searches the table of cells
@query("stream_decode", "SELECT l_linenumber, l_partkey, l_orderkey::VARCHAR AS order_text, l_quantity FROM lineitem")
def stream_decode(spark, d):
    df = load(spark, d, "lineitem").select("l_linenumber", "l_partkey", F.col("l_orderkey").cast("string").alias("order_text"), "l_quantity")
    encoder = TableEncoder(keep=("l_linenumber", "l_partkey")).fit(df)
    path = scratch(spark, "encoded")
    encoder.transform(df).write.parquet(path)
    return jobs.run_to_files(jobs.decode_stream(jobs.table_stream(spark, path, 100), encoder), spark, "decoded")


# Four arrivals by time, and every tenth event only in the last. A row is late if its window had ended by the
# watermark that the batch before its own began with, which here is that of the first two arrivals.
ARRIVALS = """(SELECT *, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
 CASE WHEN event_id % 10 = 0 THEN 3 ELSE least(3, floor(4 * (epoch_us(ts) - lo) / (hi - lo)))::INTEGER END AS arrival
 FROM events, (SELECT epoch_us(min(ts))::DOUBLE AS lo, epoch_us(max(ts))::DOUBLE AS hi FROM events))"""


@query("stream_late", f"""
SELECT event_type, window_end - INTERVAL 1 HOUR AS window_start, {sql_r('avg(value)')} AS value, count(*) AS n FROM {ARRIVALS}
WHERE window_end <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)
  AND NOT (arrival = 3 AND window_end <= (SELECT max(ts) - INTERVAL 2 HOUR FROM {ARRIVALS} WHERE arrival < 2)) GROUP BY ALL""")
def stream_late(spark, d):
    df = spark.read.parquet(f"{d}/events.parquet").select(*FIELDS)
    at = F.unix_micros(F.col("ts").cast("timestamp")).cast("double")
    lo, hi = df.agg(F.min(at), F.max(at)).first()
    quarter = F.least(F.lit(3), F.floor(4 * (at - lo) / (hi - lo)))
    arrival = F.when(F.pmod("event_id", F.lit(10)) == 0, F.lit(3)).otherwise(quarter)
    path = jobs.in_arrivals(df, arrival, 4, scratch(spark, "arrivals"))
    thinned = jobs.thin_stream(jobs.table_stream(spark, path), ["event_type"], "ts", "value", "1 hour", "2 hours")
    return jobs.run_to_files(thinned, spark, "late").withColumn("value", r(F.col("value")))
