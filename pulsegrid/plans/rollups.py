"""Roll-up queries. Customers and suppliers play pods, nations deployments and nodes, regions namespaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import rollup as R, summary as S

from .registry import query, rounded


def pods(t):
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey"))


PODS = "pods AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query("e21_namespace_rollup", sql=f"""WITH {PODS} SELECT r_name, count(*) AS pods, count(*) FILTER (c_acctbal > 0) AS ready_pods, bool_and(c_acctbal > 0) AS all_ready,
 round(sum(c_acctbal), 6) AS cpu_rate FROM pods GROUP BY 1""")
def _(t):
    return rounded(R.levels_rollup(pods(t), ["r_name"], F.col("c_acctbal") > 0, {"cpu_rate": "c_acctbal"}))


@query("e21_deployment_rollup", sql=f"""WITH {PODS} SELECT r_name, n_name, count(*) AS pods, count(*) FILTER (c_acctbal > 0) AS ready_pods, bool_and(c_acctbal > 0) AS all_ready,
 round(sum(c_acctbal), 6) AS cpu_rate FROM pods GROUP BY 1, 2""")
def _(t):
    return rounded(R.levels_rollup(pods(t), ["r_name", "n_name"], F.col("c_acctbal") > 0, {"cpu_rate": "c_acctbal"}))


_PHASES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "UNKNOWN")


@query("e21_phase_counts", sql=f"""WITH {PODS}, w AS (SELECT DISTINCT n_name, unnest({list(_PHASES)}) AS c_mktsegment FROM pods),
g AS (SELECT n_name, c_mktsegment, count(*) AS n FROM pods GROUP BY 1, 2) SELECT n_name, c_mktsegment, coalesce(n, 0) AS n FROM w LEFT JOIN g USING (n_name, c_mktsegment)""")
def _(t):
    return R.phase_counts(pods(t), ["n_name"], "c_mktsegment", _PHASES)


def devices(t):
    p = t.part
    return p.select("p_brand", "p_partkey", F.when(F.col("p_size") % 5 != 0, F.col("p_retailprice")).alias("used"),
                    F.when(F.col("p_size") % 7 != 0, F.col("p_size") * 10.0).alias("free"), (F.col("p_size") % 3 * 1.0).alias("reserved"),
                    F.when(F.col("p_partkey") % 2 == 0, F.lit(3000.0)).alias("total"), F.lit(None).cast("double").alias("energy"))


DEV = """dev AS (SELECT p_brand, p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_retailprice END AS used, CASE WHEN p_size % 7 <> 0 THEN p_size * 10.0::DOUBLE END AS free,
 p_size % 3 * 1.0::DOUBLE AS reserved, CASE WHEN p_partkey % 2 = 0 THEN 3000.0::DOUBLE END AS total, NULL::DOUBLE AS energy FROM part)"""


@query("e22_fleet_devices", sql=f"""WITH {DEV}, d AS (SELECT *, coalesce(total, used + free + reserved) AS mem FROM dev)
SELECT p_brand, count(*) AS devices, round(avg(used), 6) AS used_avg, max(used) AS used_max, min(free) AS free_min, round(sum(mem), 6) AS mem_sum FROM d GROUP BY 1""")
def _(t):
    d = devices(t)
    d = d.withColumn("mem", R.device_memory(*[F.col(c) for c in ("total", "used", "free", "reserved")]))
    return rounded(R.fleet_devices(d, ["p_brand"], avg=["used"], high=["used"], low=["free"], total=["mem"]))


_FIELDS = {"fb_used": "used", "fb_free": "free", "fb_total": "total", "energy_mj": "energy"}


@query("e22_missing_fields", sql=f"""WITH {DEV} SELECT p_partkey, array_to_string(list_filter([CASE WHEN energy IS NULL THEN 'energy_mj' END, CASE WHEN free IS NULL THEN 'fb_free' END,
 CASE WHEN total IS NULL THEN 'fb_total' END, CASE WHEN used IS NULL THEN 'fb_used' END], lambda x: x IS NOT NULL), ',') AS missing FROM dev""")
def _(t):
    return devices(t).select("p_partkey", R.missing_fields(_FIELDS).alias("missing"))


@query("e22_missing_on_all", sql=f"""WITH {DEV} SELECT p_brand, count(*) AS devices, array_to_string(list_filter([CASE WHEN count(energy) = 0 THEN 'energy_mj' END, CASE WHEN count(free) = 0 THEN 'fb_free' END,
 CASE WHEN count(total) = 0 THEN 'fb_total' END, CASE WHEN count(used) = 0 THEN 'fb_used' END], lambda x: x IS NOT NULL), ',') AS missing_on_all FROM dev GROUP BY 1""")
def _(t):
    return R.missing_on_all(devices(t), ["p_brand"], _FIELDS)


@query("e25_distinct_members", sql="SELECT l_suppkey, count(DISTINCT l_partkey) AS cores FROM lineitem GROUP BY 1")
def _(t):
    return R.distinct_members(t.lineitem, ["l_suppkey"], "l_partkey", "cores")


@query("e26_workload_status", sql="""WITH r AS (SELECT s_nationkey, s_suppkey, s_acctbal > 2000 AS ready, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal / 10 END AS tps, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 100 END AS cache,
 CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey END AS stamp FROM supplier),
a AS (SELECT s_nationkey, count(*) AS n, count(*) FILTER (ready) AS ready, count(*) FILTER (tps IS NOT NULL) AS ma, sum(tps) AS tps, max(cache) AS cache, max(stamp) AS ts FROM r GROUP BY 1)
SELECT s_nationkey, 3 AS desired, ready, ma AS metrics_available, round(tps, 6) AS tps, cache AS cache_max, ts AS metrics_ts, greatest(ready - ma, 0) AS metrics_unavailable,
 CASE WHEN ts > 0 THEN round(100000.0::DOUBLE - ts, 3) ELSE 0.0 END AS freshness_s, CASE WHEN ready = 0 THEN 'not_ready' WHEN ma = 0 THEN 'metrics_unavailable' ELSE 'ready' END AS status FROM a""")
def _(t):
    seen = F.col("s_suppkey") % 3 != 0
    r = t.supplier.select("s_nationkey", (F.col("s_acctbal") > 2000).alias("ready"), F.when(seen, F.col("s_acctbal") / 10).alias("tps"),
                          F.when(seen, F.col("s_suppkey") % 100).alias("cache"), F.when(seen, F.col("s_suppkey")).alias("stamp"),
                          F.lit("Running").alias("phase"), F.lit(3).alias("desired"))
    return rounded(R.workload_status(r, ["s_nationkey"], "ready", "phase", ["tps"], "cache", "stamp", F.lit(100000.0), "desired"))


@query("e26_replica_status", sql="""SELECT s_suppkey, CASE WHEN s_acctbal > 2000 AND s_suppkey % 3 <> 0 THEN 'ready' WHEN s_acctbal > 2000 THEN 'metrics_unavailable'
 WHEN s_suppkey % 2 = 0 THEN 'not_ready' ELSE 'pending' END AS status FROM supplier""")
def _(t):
    return t.supplier.select("s_suppkey", R.replica_status(
        F.col("s_acctbal") > 2000, F.when(F.col("s_suppkey") % 2 == 0, F.lit("Running")), F.col("s_suppkey") % 3 != 0).alias("status"))


@query("e47_snapshot_means", sql="""SELECT l_linenumber, count(*) AS snapshots, round(avg(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 6) AS cpu_mean, round(avg(l_tax), 6) AS mem_mean FROM lineitem GROUP BY 1""")
def _(t):
    li = t.lineitem
    doc = F.array(F.struct(F.col("l_returnflag").alias("name"), F.col("l_quantity").alias("usage")), F.struct(F.lit("mem").alias("name"), F.col("l_tax").alias("usage")),
                  F.struct(F.lit("A").alias("name"), F.lit(-1.0).alias("usage")).alias("late"))
    snaps = li.select("l_linenumber", doc.alias("deployments"), "l_returnflag").select(
        "l_linenumber", R.named_member("deployments", "A", "usage").alias("cpu"), R.named_member("deployments", "mem", "usage").alias("mem")) \
        .withColumn("cpu", F.when(F.col("cpu") >= 0, F.col("cpu")))
    return rounded(R.snapshot_means(snaps, ["l_linenumber"], ["cpu", "mem"]))


@query("e48_fleet_summary", sql=f"""WITH {PODS}, h AS (SELECT *, CASE WHEN c_acctbal < 0 THEN 'offline' WHEN c_acctbal > 9000 THEN 'degraded' ELSE 'healthy' END AS health FROM pods)
SELECT r_name, count(*) AS nodes, count(*) FILTER (health = 'healthy') AS healthy_nodes, count(*) FILTER (health = 'degraded') AS degraded_nodes, count(*) FILTER (health = 'offline') AS offline_nodes,
 min_by(c_name, (-c_acctbal, c_name)) AS top_cpu, min_by(c_name, (-(c_custkey % 977), c_name)) AS top_memory FROM h GROUP BY 1""")
def _(t):
    n = pods(t).withColumn("health", F.when(F.col("c_acctbal") < 0, "offline").when(F.col("c_acctbal") > 9000, "degraded").otherwise("healthy")) \
        .withColumn("mem", F.col("c_custkey") % 977)
    return R.fleet_summary(n, ["r_name"], "health", ["healthy", "degraded", "offline"], "c_name", {"cpu": "c_acctbal", "memory": "mem"})


@query("e52_usage_rollup", sql=f"""WITH {PODS}, x AS (SELECT r_name, n_name, c_custkey % 7 AS m, c_acctbal AS v, n_nationkey FROM pods)
SELECT r_name, n_name, round(sum(v) FILTER (m < 2 AND n_nationkey % 2 = 0), 6) AS slice_sum, round(sum(v) FILTER (m >= 2 AND m <> 6), 6) AS scope_sum,
 round(coalesce(sum(v) FILTER (m < 2 AND n_nationkey % 2 = 0), sum(v) FILTER (m >= 2 AND m <> 6)), 6) AS usage FROM x GROUP BY 1, 2""")
def _(t):
    m, none = F.col("c_custkey") % 7, F.lit("[none]")
    is_slice = m < 2
    lab = F.create_map(
        F.lit("namespace"), F.col("r_name"), F.lit("pod"), F.col("n_name"), F.lit("id"),
        F.when(is_slice, F.lit("/kubepods/pod1.slice")).otherwise(F.lit("/kubepods/pod1/crio.scope")),
        F.lit("container"), F.when(is_slice, none).otherwise("app"), F.lit("image"), F.when(is_slice, none).when(m == 6, "k8s/pause:3").otherwise("app:1"),
        F.lit("name"), F.when(is_slice, none).otherwise("app"), F.lit("cpu"), F.when(F.col("n_nationkey") % 2 == 0, "total").otherwise("cpu0"))
    return rounded(S.usage_rollup(pods(t).withColumn("labels", lab), ["r_name", "n_name"], "c_acctbal"))


@query("e53_local_presence", sql="""WITH c AS (SELECT c_nationkey AS n_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9900 GROUP BY 1)
SELECT n_nationkey, n_name, coalesce(n, 0) AS local_pods, CASE WHEN n > 0 THEN 'present' ELSE 'none' END AS presence FROM nation LEFT JOIN c USING (n_nationkey)""")
def _(t):
    return R.local_presence(t.nation.select("n_nationkey", "n_name"), t.customer.filter("c_acctbal > 9900"), "n_nationkey", "c_nationkey")
