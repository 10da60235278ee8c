"""Ordering, limit and set-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import selection as G
from pulsegrid.operators.summary import forecast_metrics

from .registry import query, rounded


@query("g01_history", sql="SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def _(t):
    return G.history(t.orders, ["o_orderdate", "o_orderkey"], 5000, 100, F.col("o_orderstatus") == "F").select("o_orderkey", "o_orderdate", "o_totalprice")


@query("g02_best_per_group", sql="""WITH e AS (SELECT l_returnflag, l_linenumber, avg(abs(l_extendedprice - l_quantity * 1500)) AS mae, count(*) AS n FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY mae, l_linenumber) AS o FROM e) SELECT l_returnflag, l_linenumber, n, round(mae, 6) AS mae FROM r WHERE o = 1""")
def _(t):
    m = forecast_metrics(t.lineitem.withColumn("p", F.col("l_quantity") * 1500), ["l_returnflag", "l_linenumber"], "l_extendedprice", "p")
    return rounded(G.best_per_group(m.select("l_returnflag", "l_linenumber", "n", "mae"), ["l_returnflag"], [F.col("mae"), F.col("l_linenumber")]))


@query("g02_longest_latest", sql="SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def _(t):
    return G.best_per_group(t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"],
                            [-F.col("o_totalprice"), -F.unix_micros(F.col("o_orderdate").cast("timestamp")), -F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("g03_top_k", sql="SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal - 4500) DESC, c_custkey LIMIT 30")
def _(t):
    return G.top_k(t.customer, F.abs(F.col("c_acctbal") - 4500), 30, ["c_custkey"]).select("c_custkey", "c_acctbal")


@query("g04_last_points", sql="SELECT event_id, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS o FROM events) WHERE o <= 20")
def _(t):
    return G.last_n(t.events, ["user_id"], ["ts", "event_id"], 20).select("event_id", "user_id", "value")


@query("g05_seeded_sample", sql="SELECT event_id, value FROM events ORDER BY sha256(event_id || '|7'), event_id LIMIT 500")
def _(t):
    return G.seeded_sample(t.events.select("event_id", "value"), ["event_id"], 500)


@query("h01_union_by_name", sql="SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def _(t):
    return G.union_all([t.customer.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")),
                        t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))])


@query("h02_distinct", sql="SELECT DISTINCT user_id, date_trunc('hour', ts) AS bin FROM events")
def _(t):
    return t.events.select("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bin")).distinct()


@query("h03_intersect", sql="SELECT user_id AS run_id FROM events INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 480000")
def _(t):
    return t.events.select(F.col("user_id").alias("run_id")).intersect(t.orders.filter("o_totalprice > 480000").select(F.col("o_custkey").alias("run_id")))


@query("h03_except", sql="SELECT user_id AS run_id FROM events EXCEPT ALL SELECT o_custkey FROM orders")
def _(t):
    return t.events.select(F.col("user_id").alias("run_id")).exceptAll(t.orders.select(F.col("o_custkey").alias("run_id")))
