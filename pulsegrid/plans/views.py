"""The shared tables in the roles the operators expect, on both engines.

``events`` is the request log: run = user_id, latency = value, failure = event_type 'error'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions.times import micros


def requests(t) -> DataFrame:
    e = t.events
    return e.select(
        "event_id", F.col("user_id").alias("run_id"), "ts", micros("ts").alias("us"), "event_type",
        F.col("value").alias("latency_ms"), (F.col("event_type") != "error").alias("ok"),
        F.get_json_object("props", "$.k").cast("int").alias("k"))


REQ = """req AS (SELECT event_id, user_id AS run_id, ts, epoch_us(ts) AS us, event_type, value AS latency_ms,
 event_type <> 'error' AS ok, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)"""


def openloop(t) -> DataFrame:
    """Events as an open-loop client log: seconds are hours since the start of the month."""
    r = requests(t)
    hours = (F.col("us") - F.lit(1704067200000000)) / F.lit(3.6e9)
    dropped = (F.col("event_type") == "signup") & (F.col("k") >= 80)
    return r.select(
        "event_id", "run_id", "event_type", "k",
        hours.alias("scheduled_s"), (hours + F.col("latency_ms") / 50.0).alias("__c"),
        F.when(dropped, "dropped_max_inflight").otherwise("launched").alias("launch_status"),
        (~dropped & (F.col("k") != 7)).alias("completed"),
        F.when(~dropped, F.col("ok")).alias("success"),
        F.when(~F.col("ok") & (F.col("k") < 30), "timeout").when(~F.col("ok"), "http_error").otherwise("").alias("error_type"),
        (F.col("k") * 20.0).alias("schedule_delay_ms"), (F.col("k") % 9).alias("inflight"), "latency_ms",
    ).withColumn("complete_s", F.when(F.col("completed"), F.col("__c"))).drop("__c")


OPEN = REQ + """, ol0 AS (SELECT *, (us - 1704067200000000) / 3.6e9 AS scheduled_s,
 (event_type = 'signup' AND k >= 80) AS dropped FROM req),
ol AS (SELECT event_id, run_id, event_type, k, scheduled_s, dropped, (NOT dropped AND k <> 7) AS completed,
 CASE WHEN NOT dropped AND k <> 7 THEN scheduled_s + latency_ms / 50.0 END AS complete_s,
 CASE WHEN NOT dropped THEN ok END AS success,
 CASE WHEN NOT ok AND k < 30 THEN 'timeout' WHEN NOT ok THEN 'http_error' ELSE '' END AS error_type,
 k * 20.0 AS schedule_delay_ms, k % 9 AS inflight, latency_ms FROM ol0)"""
