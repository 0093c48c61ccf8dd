"""Registered queries that run as Structured Streaming over the table's files, to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.registry import query, table
from rollbook.streaming import ingest


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def p2_daily_windows(spark, sf):
    out = ingest.run_available(spark, f"{sf}/events.parquet", lambda s: ingest.tumbling(s, "ts", "1 day", "event_type"), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("SELECT count(DISTINCT (user_id, event_type)) AS n FROM events")
def p1_seen_keys(spark, sf):
    out = ingest.run_available(spark, f"{sf}/events.parquet", lambda s: s.select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]), "append")
    return out.agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events), l AS (SELECT d FROM w WHERE day(d) % 2 = 0)
SELECT CAST(e.ts AS DATE) AS "window", count(*) AS n FROM events e WHERE CAST(e.ts AS DATE) NOT IN (SELECT d FROM l) GROUP BY 1""")
def p2_window_ledger(spark, sf):
    events = table(spark, sf, "events").withColumn("window", F.to_date("ts"))
    ledger = events.select("window").distinct().select("window", F.when(F.dayofmonth("window") % 2 == 0, "complete").otherwise("suspect").alias("status"), F.lit(1).alias("recorded_at"))
    return ingest.open_windows(events, ledger, "window").groupBy("window").agg(F.count("*").alias("n"))
