"""Alignment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.times import DAY, HOUR
from pulsegrid.operators import align as A
from pulsegrid.operators.keys import join_on
from pulsegrid.operators.ordered import numbered

from .registry import query, rounded
from .rollups import PODS, pods
from .summaries import _q
from .views import OPEN, REQ, openloop, requests


def sides(t):
    """Requests (left) and telemetry, played by the views (right)."""
    r = requests(t)
    left = r.filter(F.col("event_type") == "error").select("run_id", "event_id", "us", "latency_ms")
    right = r.filter(F.col("event_type") == "view").select("run_id", F.col("us").alias("tel_us"), F.col("k").alias("temp"), F.col("event_id").alias("tel_id"))
    return left, right


SIDES = REQ + """, lf AS (SELECT run_id, event_id, us, latency_ms FROM req WHERE event_type = 'error'),
rt AS (SELECT run_id, us AS tel_us, k AS temp, event_id AS tel_id FROM req WHERE event_type = 'view'),
bk AS (SELECT lf.*, rt.tel_us AS b_us, rt.temp AS b_temp FROM lf ASOF LEFT JOIN rt ON lf.run_id = rt.run_id AND lf.us >= rt.tel_us),
fw AS (SELECT lf.event_id, rt.tel_us AS f_us, rt.temp AS f_temp FROM lf ASOF LEFT JOIN rt ON lf.run_id = rt.run_id AND lf.us <= rt.tel_us),
nr AS (SELECT run_id, bk.event_id, us, latency_ms, CASE WHEN b_us IS NULL OR f_us - us < us - b_us THEN coalesce(f_us, b_us) ELSE b_us END AS tel_us,
 CASE WHEN b_us IS NULL OR f_us - us < us - b_us THEN coalesce(f_temp, b_temp) ELSE b_temp END AS temp FROM bk JOIN fw USING (event_id))"""


@query("d01_asof_nearest", sql=f"""WITH {SIDES} SELECT run_id, event_id, us, latency_ms, CASE WHEN abs(us - tel_us) <= 3600000000 * 12 THEN tel_us END AS tel_us,
 CASE WHEN abs(us - tel_us) <= 3600000000 * 12 THEN temp END AS temp FROM nr""")
def _(t):
    left, right = sides(t)
    return A.asof_join(left, right, "us", "tel_us", ["run_id"], width=2 * DAY, tolerance=12 * HOUR, payload=["temp"], order="tel_id")


@query("d01_asof_backward", sql=f"WITH {SIDES} SELECT run_id, event_id, us, latency_ms, b_us AS tel_us, b_temp AS temp FROM bk")
def _(t):
    left, right = sides(t)
    return A.asof_join(left, right, "us", "tel_us", ["run_id"], width=2 * DAY, direction="backward", payload=["temp"], order="tel_id")


@query("d01_asof_forward", sql=f"""WITH {SIDES} SELECT lf.run_id, event_id, us, latency_ms, f_us AS tel_us, f_temp AS temp FROM lf JOIN fw USING (event_id)""")
def _(t):
    left, right = sides(t)
    return A.asof_join(left, right, "us", "tel_us", ["run_id"], width=2 * DAY, direction="forward", payload=["temp"], order="tel_id")


@query("d02_asof_tie_later", sql="""WITH l AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) // 86400000000 AS d FROM orders WHERE o_orderstatus = 'F'),
r AS (SELECT o_custkey, epoch_us(o_orderdate) // 86400000000 AS rd, max(o_orderkey) AS other FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2),
b AS (SELECT l.*, r.rd AS bd, r.other AS bo FROM l ASOF LEFT JOIN r ON l.o_custkey = r.o_custkey AND l.d >= r.rd),
f AS (SELECT l.o_orderkey, r.rd AS fd, r.other AS fo FROM l ASOF LEFT JOIN r ON l.o_custkey = r.o_custkey AND l.d <= r.rd),
n AS (SELECT o_custkey, b.o_orderkey, d, CASE WHEN bd IS NULL OR fd - d <= d - bd THEN coalesce(fd, bd) ELSE bd END AS rd, CASE WHEN bd IS NULL OR fd - d <= d - bd THEN coalesce(fo, bo) ELSE bo END AS other FROM b JOIN f USING (o_orderkey))
SELECT o_custkey, o_orderkey, d, CASE WHEN abs(d - rd) <= 200 THEN rd END AS rd, CASE WHEN abs(d - rd) <= 200 THEN other END AS other FROM n""")
def _(t):
    o = t.orders.withColumn("d", F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / DAY))
    left = o.filter("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", "d")
    right = o.filter("o_orderstatus = 'O'").select("o_custkey", F.col("d").alias("rd"), F.col("o_orderkey").alias("other"))
    return A.asof_join(left, right, "d", "rd", ["o_custkey"], width=400, tolerance=200, tie="later", payload=["other"], order="other")


@query("d03_asof_unbounded", sql=f"WITH {SIDES} SELECT run_id, event_id, us, latency_ms, tel_us, temp FROM nr")
def _(t):
    left, right = sides(t)
    return A.asof_join(left, right, "us", "tel_us", ["run_id"], width=2 * DAY, payload=["temp"], order="tel_id")


@query("d04_tolerance_sensitivity", sql=f"""WITH {SIDES}, x AS (SELECT *, unnest([3.6e3, 1.8e4, 8.64e4]::DOUBLE[]) AS tolerance FROM nr), y AS (SELECT *, CASE WHEN abs(us - tel_us) / 1e6 <= tolerance THEN abs(us - tel_us) / 1e6 END AS o FROM x)
SELECT run_id, tolerance, count(*) AS bins, count(o) AS matched_bins, round(count(o) / count(*), 8) AS matched_rate, {_q('o', .5, d=8)} AS offset_p50, {_q('o', .95, d=8)} AS offset_p95 FROM y GROUP BY 1, 2""")
def _(t):
    left, right = sides(t)
    m = A.asof_join(left, right, "us", "tel_us", ["run_id"], width=2 * DAY, payload=["temp"], order="tel_id", offset="off")
    return rounded(A.tolerance_sensitivity(m.withColumn("off", F.col("off") / 1e6), ["run_id"], "off", [3.6e3, 1.8e4, 8.64e4]), 8)


@query("d05_invalidate_far_matches", sql=f"""WITH {SIDES} SELECT event_id, us - tel_us AS off, CASE WHEN NOT abs(us - tel_us) > 7200000000 THEN temp END AS temp FROM nr""")
def _(t):
    left, right = sides(t)
    m = A.asof_join(left, right, "us", "tel_us", ["run_id"], width=2 * DAY, payload=["temp"], order="tel_id", offset="off")
    return A.invalidate(m, "off", 2 * HOUR, ["temp"]).select("event_id", "off", "temp")


_HOURS = REQ + """, a AS (SELECT run_id, us // 86400000000 AS s, count(*) AS n FROM req WHERE ok GROUP BY 1, 2), b AS (SELECT run_id, us // 86400000000 AS s, avg(k) AS temp FROM req WHERE event_type = 'error' GROUP BY 1, 2)"""


def _grids(t):
    r = requests(t).withColumn("s", F.floor(F.col("us") / DAY))
    return (r.filter("ok").groupBy("run_id", "s").agg(F.count(F.lit(1)).alias("n")),
            r.filter("event_type = 'error'").groupBy("run_id", "s").agg(F.avg("k").alias("temp")))


@query("d06_left_equi_join", sql=f"WITH {_HOURS} SELECT run_id, s, n, round(temp, 6) AS temp FROM a LEFT JOIN b USING (run_id, s)")
def _(t):
    a, b = _grids(t)
    return rounded(join_on(a, b, ["run_id", "s"], "left"))


@query("d07_inner_equi_join", sql=f"WITH {_HOURS} SELECT run_id, s, n, round(temp, 6) AS temp FROM a JOIN b USING (run_id, s)")
def _(t):
    a, b = _grids(t)
    return rounded(join_on(a, b, ["run_id", "s"]))


@query("d07_full_outer_join", sql=f"WITH {_HOURS} SELECT run_id, s, n, round(temp, 6) AS temp FROM a FULL JOIN b USING (run_id, s)")
def _(t):
    a, b = _grids(t)
    return rounded(join_on(a, b, ["run_id", "s"], "full_outer"))


@query("d08_positional_alignment", sql=f"""WITH {REQ}, a AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY us, event_id) - 1 AS elapsed_s, latency_ms FROM req WHERE event_type = 'error'),
b AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY us, event_id) - 1 AS elapsed_s, k FROM req WHERE event_type = 'view') SELECT * FROM a JOIN b USING (run_id, elapsed_s)""")
def _(t):
    def indexed(kind, c):
        r = requests(t).filter(F.col("event_type") == kind)
        n = numbered(r, ["run_id"], ["us", "event_id"], width=2 * DAY)
        return n.select("run_id", (F.col("rn") - 1).alias("elapsed_s"), c)
    return join_on(indexed("error", "latency_ms"), indexed("view", "k"), ["run_id", "elapsed_s"])


def phases(t, buffer_us: int = 0):
    """A phase schedule per run: from each purchase for a day, numbered in order."""
    p = requests(t).filter("event_type = 'purchase'")
    p = numbered(p, ["run_id"], ["us", "event_id"], width=2 * DAY)
    return p.select("run_id", (F.col("us") - buffer_us).alias("start"), (F.col("us") + DAY + buffer_us).alias("end"), "rn", F.concat(F.lit("phase_"), F.col("rn") % 4).alias("label"))


PH = """ph AS (SELECT run_id, us AS s, us + 86400000000 AS e, row_number() OVER (PARTITION BY run_id ORDER BY us, event_id) AS rn FROM req WHERE event_type = 'purchase'),
er AS (SELECT run_id, event_id, us FROM req WHERE event_type = 'error')"""


@query("d09_first_interval", sql=f"""WITH {REQ}, {PH}, m AS (SELECT er.event_id, min(rn) AS rn FROM er JOIN ph ON er.run_id = ph.run_id AND us >= s AND us < e GROUP BY 1)
SELECT event_id, coalesce('phase_' || (rn % 4), 'unknown') AS label FROM er LEFT JOIN m USING (event_id)""")
def _(t):
    pts = requests(t).filter("event_type = 'error'").select("run_id", "event_id", "us")
    out = A.interval_join(pts, phases(t), "us", "start", "end", ["run_id"], bucket=DAY, pick="first", order=["rn"], payload=["label"])
    return out.select("event_id", F.coalesce("label", F.lit("unknown")).alias("label"))


@query("d10_window_midpoint", sql="""WITH w AS (SELECT date_trunc('month', o_orderdate) AS m, epoch_us(min(o_orderdate)) AS s, epoch_us(max(o_orderdate)) AS e FROM orders WHERE o_totalprice > 490000 GROUP BY 1),
p AS (SELECT o_orderkey, epoch_us(o_orderdate) + CAST(floor(o_totalprice) AS BIGINT) * 500 AS mid FROM orders) SELECT o_orderkey, mid, strftime(m, '%Y-%m') AS window_id FROM p JOIN w ON mid >= s AND mid <= e""")
def _(t):
    us = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    o = t.orders
    w = o.filter("o_totalprice > 490000").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("window_id")).agg(F.min(us).alias("s"), F.max(us).alias("e"))
    pts = o.select("o_orderkey", (us + F.floor("o_totalprice") * 500).alias("mid"))
    return A.interval_join(pts, w, "mid", "s", "e", bucket=30 * DAY, closed="both", how="inner", payload=["window_id"])


@query("d11_nested_labels", sql=f"""WITH {REQ}, {PH}, x AS (SELECT er.event_id, max(rn) AS win, max_by(CASE WHEN us BETWEEN s AND e THEN 'core' ELSE 'buffer' END, rn) AS lab, bool_or(us BETWEEN s AND e) AS core
 FROM er JOIN ph ON er.run_id = ph.run_id AND us BETWEEN s - 21600000000 AND e + 21600000000 GROUP BY 1)
SELECT event_id, win, CASE WHEN win IS NULL THEN 'reachable' ELSE CASE lab WHEN 'core' THEN 'service_unreachable' ELSE 'outage_buffer' END END AS label FROM er LEFT JOIN x USING (event_id)""")
def _(t):
    pts = requests(t).filter("event_type = 'error'").select("run_id", "event_id", "us")
    win = phases(t).withColumnRenamed("rn", "win")
    out = A.label_windows(pts, win, "us", ["run_id"], order="win", core=("start", "end"), buffer=6 * HOUR, bucket=2 * DAY)
    return out.select("event_id", "win", "label")


@query("d12_event_lookup", sql=f"""WITH {REQ}, ev AS (SELECT run_id, us // 86400000000 AS day, event_type, max_by(k, (us, event_id)) AS elapsed FROM req GROUP BY 1, 2, 3)
SELECT DISTINCT r.run_id, r.us // 86400000000 AS day, f.elapsed AS fault_start, g.elapsed AS recovery_start FROM req r LEFT JOIN ev f ON f.run_id = r.run_id AND f.day = r.us // 86400000000 AND f.event_type = 'error'
 LEFT JOIN ev g ON g.run_id = r.run_id AND g.day = r.us // 86400000000 AND g.event_type = 'purchase'""")
def _(t):
    r = requests(t).withColumn("day", F.floor(F.col("us") / DAY))
    by = ["run_id", "day"]
    pick = lambda kind, n: A.last_event(r.filter(F.col("event_type") == kind), by, "k", ["us", "event_id"], n)
    return join_on(join_on(r.select(*by).distinct(), pick("error", "fault_start"), by, "left"), pick("purchase", "recovery_start"), by, "left")


@query("d13_semi_join", sql="SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 150)")
def _(t):
    bad = t.events.filter("event_type = 'error' AND value > 150").select(F.col("user_id").alias("o_custkey")).distinct()
    return join_on(t.orders.select("o_orderkey", "o_custkey"), bad, ["o_custkey"], "left_semi")


@query("d14_anti_join", sql="SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(t):
    managed = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return join_on(t.customer.select("c_custkey", "c_name"), managed, ["c_custkey"], "left_anti")


@query("d15_merge_vectors", sql="SELECT user_id, " + ", ".join(
    f"max_by(value, (ts, event_id)) FILTER (event_type = '{m}') AS {m}" for m in ("signup", "click", "view", "purchase")) + " FROM events WHERE event_type <> 'error' GROUP BY 1")
def _(t):
    return A.merge_vectors(t.events, ["user_id"], "event_type", "value", ["ts", "event_id"], ["signup", "click", "view", "purchase"])


@query("d16_ownership_chain", sql="""SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN 'fallback' WHEN n_name IS NULL OR r_name IS NULL THEN 'partial' ELSE 'deployment' END AS owner_resolution,
 coalesce(r_name, CASE WHEN c_custkey % 13 <> 0 THEN 'NATION_' || (c_nationkey + c_custkey % 2) END, c_name) AS workload FROM customer
 LEFT JOIN nation ON c_custkey % 13 <> 0 AND n_name = 'NATION_' || (c_nationkey + c_custkey % 2) LEFT JOIN region ON r_name = (SELECT q.r_name FROM region q WHERE q.r_regionkey = n_regionkey AND q.r_name <> 'ASIA')""")
def _(t):
    owner = F.when(F.col("c_custkey") % 13 != 0, F.concat(F.lit("NATION_"), F.col("c_nationkey") + F.col("c_custkey") % 2))
    pod = t.customer.select("c_custkey", "c_name", owner.alias("owner"))
    sets = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.col("r_name").alias("set_owner"))
    out = A.ownership(pod, sets, t.region.filter("r_name <> 'ASIA'"), pod_owner="owner", set_name="n_name", set_owner="set_owner", dep_name="r_name", fallback="c_name")
    return out.select("c_custkey", "owner_resolution", "workload")


@query("d17_source_overlay", sql="""WITH b AS (SELECT o_custkey, avg(o_totalprice) AS cpu, count(*) AS mem FROM orders GROUP BY 1), p AS (SELECT user_id AS o_custkey, max(value) FILTER (event_type = 'error') AS cpu, nullif(count(*) FILTER (event_type = 'view') - 14, 0) AS mem FROM events GROUP BY 1)
SELECT o_custkey, round(coalesce(p.cpu, b.cpu), 6) AS cpu, coalesce(p.mem, b.mem) AS mem, concat_ws(',', CASE WHEN p.cpu IS NOT NULL THEN 'cpu' END, CASE WHEN p.mem IS NOT NULL THEN 'mem' END) AS overlaid FROM b LEFT JOIN p USING (o_custkey)""")
def _(t):
    base = t.orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("cpu"), F.count(F.lit(1)).alias("mem"))
    inst = t.events.groupBy(F.col("user_id").alias("o_custkey")).agg(
        F.max(F.when(F.col("event_type") == "error", F.col("value"))).alias("cpu"),
        F.nullif(F.count(F.when(F.col("event_type") == "view", 1)) - 14, F.lit(0)).alias("mem"))
    return rounded(A.overlay(base, inst, ["o_custkey"], ["cpu", "mem"]))


@query("d18_carry_forward", sql=f"""WITH {REQ}, u AS (SELECT run_id, us, event_id, CASE WHEN event_type = 'error' THEN latency_ms END AS cpu, CASE WHEN event_type = 'view' THEN k END AS gpu FROM req WHERE event_type IN ('error', 'view'))
SELECT run_id, us, event_id, last_value(cpu IGNORE NULLS) OVER w AS cpu, last_value(gpu IGNORE NULLS) OVER w AS gpu FROM u WINDOW w AS (PARTITION BY run_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)""")
def _(t):
    r = requests(t)
    a = r.filter("event_type = 'error'").select("run_id", "us", "event_id", F.col("latency_ms").alias("cpu"))
    b = r.filter("event_type = 'view'").select("run_id", "us", "event_id", F.col("k").alias("gpu"))
    return A.carry_forward(a, b, ["run_id"], ["us", "event_id"], ["cpu", "gpu"], width=DAY)


@query("d19_concat_on_time", sql=f"""WITH {REQ}, a AS (SELECT run_id, us // 3600000000 AS h, max_by(latency_ms, event_id) AS lat FROM req WHERE event_type = 'error' GROUP BY 1, 2),
b AS (SELECT run_id, us // 3600000000 AS h, max_by(k, event_id) AS temp FROM req WHERE event_type = 'view' GROUP BY 1, 2) SELECT run_id, h, lat, temp FROM a FULL JOIN b USING (run_id, h)""")
def _(t):
    r = requests(t).withColumn("h", F.floor(F.col("us") / HOUR))
    a = r.filter("event_type = 'error'").select("run_id", "h", "event_id", F.col("latency_ms").alias("lat"))
    b = r.filter("event_type = 'view'").select("run_id", "h", "event_id", F.col("k").alias("temp"))
    return A.concat_on_time([a, b], ["run_id"], "h", "event_id")


@query("d21_inventory_enrichment", sql="""SELECT p_partkey, p_size > 40 AS has_gpu, CASE WHEN p_size > 40 THEN coalesce(CASE WHEN p_partkey % 5 = 0 THEN p_name END, s_name, CASE WHEN p_type = 'ECONOMY' THEN 'ECONOMY-MODEL' END, 'GENERIC') END AS model,
 CASE WHEN p_size <= 40 THEN NULL WHEN p_partkey % 5 = 0 THEN 'label' WHEN s_name IS NOT NULL THEN 'inferred' WHEN p_type = 'ECONOMY' THEN 'static' ELSE 'generic' END AS model_source
FROM part LEFT JOIN supplier ON s_suppkey = p_partkey AND s_acctbal > 3000""")
def _(t):
    nodes = t.part.select("p_partkey", "p_type", (F.col("p_size") > 40).alias("has_gpu"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).alias("label"))
    inferred = t.supplier.filter("s_acctbal > 3000").select(F.col("s_suppkey").alias("p_partkey"), F.col("s_name").alias("inferred"))
    static = t.part.filter("p_type = 'ECONOMY'").select("p_type", F.lit("ECONOMY-MODEL").alias("static")).distinct()
    out = A.enrich(nodes, [(inferred, ["p_partkey"]), (static, ["p_type"])], [("label", "label"), ("inferred", "inferred"), ("static", "static")], "GENERIC", "generic", F.col("has_gpu"), "model")
    return out.select("p_partkey", "has_gpu", "model", "model_source")


_INV = REQ + """, r AS (SELECT * FROM req WHERE event_type <> 'view'), v AS (SELECT *, us // 604800000000 AS cyc FROM req WHERE event_type = 'view' AND run_id % 10 <> 0),
ri AS (SELECT run_id, us, us - lag(us) OVER (PARTITION BY run_id ORDER BY us, event_id) AS g FROM r), vi AS (SELECT run_id, us, us - lag(us) OVER (PARTITION BY run_id ORDER BY us, event_id) AS g FROM v),
a AS (SELECT run_id, count(*) AS request_rows, count(*) FILTER (ok) AS success_rows, avg(CAST(ok AS DOUBLE)) AS sr, min(us) AS a, max(us) AS z FROM r GROUP BY 1),
b AS (SELECT run_id, count(*) AS telemetry_rows, count(DISTINCT cyc) AS cycle_count, string_agg(DISTINCT phase, ',' ORDER BY phase) AS phases, min(us) AS a, max(us) AS z FROM (SELECT *, 'p' || (k % 3) AS phase FROM v) GROUP BY 1),
bins AS (SELECT DISTINCT run_id, us // 3600000000 * 3600000000 AS bin FROM r), m AS (SELECT bins.run_id, bin, min(abs(bin - v.us)) AS o FROM bins LEFT JOIN v ON bins.run_id = v.run_id GROUP BY 1, 2),
q AS (SELECT run_id, avg(CASE WHEN o <= 86400000000 THEN 1.0 ELSE 0.0 END) AS mr, quantile_cont(o / 1e6, .95) FILTER (o <= 86400000000) AS p95 FROM m GROUP BY 1),
x AS (SELECT a.run_id, request_rows, success_rows, sr, coalesce(telemetry_rows, 0) AS telemetry_rows, coalesce(cycle_count, 0) AS cycle_count, phases, CASE WHEN b.run_id IS NOT NULL THEN (least(a.z, b.z) - greatest(a.a, b.a)) / 1e6 END AS overlap_s, mr, p95,
 (SELECT quantile_cont(g / 1e6, .5) FROM ri WHERE ri.run_id = a.run_id) AS ri, (SELECT quantile_cont(g / 1e6, .5) FROM vi WHERE vi.run_id = a.run_id) AS vi FROM a LEFT JOIN b USING (run_id) LEFT JOIN q USING (run_id))"""


@query("e13_run_inventory", sql=f"""WITH {_INV} SELECT run_id, request_rows, success_rows, round(sr, 8) AS success_rate, telemetry_rows, cycle_count, phases, round(ri, 8) AS request_interval_s, round(vi, 8) AS telemetry_interval_s, round(mr, 8) AS matched_rate,
 round(p95, 8) AS offset_p95_s, round(overlap_s, 8) AS overlap_s, telemetry_rows > 0 AND coalesce(overlap_s, 0) > 2000000 AS suitable_for_time,
 telemetry_rows > 0 AND coalesce(overlap_s, 0) > 2000000 AND cycle_count >= 1 AND success_rows >= 38 AND coalesce(mr, 0) >= 0.6 AS suitable_for_modeling,
 concat_ws('; ', CASE WHEN telemetry_rows = 0 THEN 'missing telemetry' END, CASE WHEN coalesce(overlap_s, 0) <= 2000000 THEN 'insufficient overlap' END, CASE WHEN success_rows < 38 THEN 'insufficient successes' END,
 CASE WHEN coalesce(mr, 0) < 0.6 THEN 'weak alignment' END) AS exclude_reason FROM x""")
def _(t):
    r = requests(t).withColumn("cyc", F.floor(F.col("us") / (7 * DAY))).withColumn("phase", F.concat(F.lit("p"), F.col("k") % 3))
    req, tel = r.filter("event_type <> 'view'"), r.filter("event_type = 'view' AND run_id % 10 <> 0")
    return rounded(A.alignment_inventory(req, tel, ["run_id"], "us", "ok", "cyc", "phase", width=2 * DAY, bin_width=HOUR, tolerance=DAY,
                                         min_overlap=2000000, min_success=38, min_match=0.6, unit=1e6), 8)
