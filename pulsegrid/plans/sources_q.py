"""Source and sink queries. File formats are first written from the shared tables by Spark, then read."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W, functions as F, types as T

from pulsegrid.functions import columns as C
from pulsegrid.functions.times import DAY
from pulsegrid.operators.keys import scratch_folder
from pulsegrid.sources import files as X, parsing as P

from .registry import query, rounded
from .views import REQ, requests

cc = F.concat
S = lambda c: F.col(c).cast("string")


def folder(t) -> str:
    return f"{scratch_folder(t.spark)}/{uuid.uuid4().hex}"


@query("a01_csv_scan", sql="SELECT event_id, user_id, value, NULL::DOUBLE AS server_latency_ms FROM events WHERE event_type = 'view'")
def _(t):
    path = folder(t)
    t.events.select("event_id", "user_id", "event_type", S("value").alias("value"), "props").write.option("header", True).csv(path)
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
                           T.StructField("value", T.DoubleType()), T.StructField("server_latency_ms", T.DoubleType())])
    return X.read_csv(t.spark, path, schema).filter("event_type = 'view'").drop("event_type")


@query("a01_csv_mixed_headers", sql="SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN value END AS value, event_type FROM events WHERE event_type IN ('view', 'click', 'error')")
def _(t):
    path = folder(t)
    e = t.events.withColumn("value", S("value"))
    for kind, columns in (("view", ["event_id", "value", "event_type"]), ("click", ["value", "event_type", "event_id"]), ("error", ["event_type", "event_id"])):
        e.filter(F.col("event_type") == kind).select(*columns).write.mode("append").option("header", True).csv(path)
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("event_type", T.StringType())])
    return X.read_csv(t.spark, path, schema)


def _jsonl(t, spoil: bool):
    path = folder(t)
    good = F.to_json(F.struct("o_orderkey", "o_totalprice"))
    t.orders.select((F.when(F.col("o_orderkey") % 10 == 0, F.lit("{broken")).otherwise(good) if spoil else good).alias("value")).write.text(path)
    return path


@query("a02_jsonl_tolerant", sql="SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0")
def _(t):
    return X.read_jsonl(t.spark, _jsonl(t, True), "o_orderkey bigint, o_totalprice double")


@query("a02_jsonl_strict", sql="SELECT o_orderkey, o_totalprice FROM orders")
def _(t):
    return X.read_jsonl(t.spark, _jsonl(t, False), "o_orderkey bigint, o_totalprice double", strict=True)


@query("a02_bad_line_numbers", sql="SELECT line_no, value FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS line_no, CASE WHEN o_orderkey % 10 = 0 THEN '{broken ' || o_orderkey END AS value FROM orders) WHERE value IS NOT NULL")
def _(t):
    path = folder(t)
    good = F.to_json(F.struct("o_orderkey", "o_totalprice"))
    line = F.when(F.col("o_orderkey") % 10 == 0, cc(F.lit("{broken "), S("o_orderkey"))).otherwise(good)
    t.orders.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").select(line.alias("value")).write.text(path)
    lines = X.numbered_lines(t.spark, path)
    # The files follow each other by name: lines are numbered through all of them, one row a file.
    ends = lines.groupBy("file").agg(F.max("line_no").alias("n"))
    before = ends.select("file", F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return X.bad_lines(lines).join(before, "file").select((F.col("before") + F.col("line_no")).alias("line_no"), "value")


@query("a02_bad_lines", sql="SELECT count(*) AS bad FROM orders WHERE o_orderkey % 10 = 0")
def _(t):
    return X.bad_lines(X.read_lines(t.spark, _jsonl(t, True))).agg(F.count(F.lit(1)).alias("bad"))


@query("a03_manifests", sql="SELECT 'run_id=' || c_nationkey AS run_id, count(*) AS members, round(sum(c_acctbal), 4) AS target_rps FROM customer GROUP BY c_nationkey")
def _(t):
    path = folder(t)
    docs = t.customer.groupBy(F.col("c_nationkey").alias("run_id")).agg(F.count(F.lit(1)).alias("members"), F.round(F.sum("c_acctbal"), 4).alias("target_rps"))
    docs.write.partitionBy("run_id").json(path)
    return X.read_manifests(t.spark, f"{path}/*/*.json", "members bigint, target_rps double")


def _lines(t, text, order="event_id"):
    return requests(t).select("run_id", F.col(order).alias("line_no"), text.alias("line"))


@query("a04_key_values", sql=f"""WITH {REQ} SELECT run_id, max_by(CAST(latency_ms AS VARCHAR), event_id) FILTER (event_type = 'click') AS REPEAT, max_by('a=' || k, event_id) FILTER (event_type = 'view') AS BG_SIZE FROM req
 WHERE event_type IN ('click', 'view') GROUP BY 1""")
def _(t):
    text = F.when(F.col("event_type") == "click", cc(F.lit("REPEAT = "), S("latency_ms"))).when(F.col("event_type") == "view", cc(F.lit("BG_SIZE=a="), S("k"))).otherwise("# comment")
    return P.key_values(_lines(t, text), ["run_id"], ["line_no"], "line", ["REPEAT", "BG_SIZE"])


def _tree(t):
    """Folders of small files per nation, written by Spark."""
    path = folder(t)
    t.customer.select(cc(F.lit("run_"), S("c_nationkey")).alias("folder"), "c_name").repartition("folder").write.partitionBy("folder").text(path)
    return path


@query("a05_run_discovery", sql="SELECT DISTINCT 'folder=run_' || c_nationkey AS run_id, TRUE AS complete FROM customer")
def _(t):
    return X.discover_runs(X.list_files(t.spark, _tree(t)), "folder=run_", []).select("run_id", "complete")


@query("a06_completeness", sql=f"""WITH {REQ}, f AS (SELECT run_id, bool_or(event_type = 'signup' AND k < 40) AS a, bool_or(event_type = 'view' AND k > 60) AS b, bool_or(event_type = 'click' AND k > 85) AS m FROM req GROUP BY 1),
r AS (SELECT run_id, CASE WHEN NOT a AND NOT b THEN 'missing signup_low,view_high' WHEN NOT a THEN 'missing signup_low' WHEN NOT b THEN 'missing view_high' WHEN NOT m THEN 'time_window_missing_END_EPOCH' ELSE '' END AS exclude_reason FROM f)
SELECT run_id, exclude_reason = '' AS complete, exclude_reason FROM r""")
def _(t):
    r = requests(t)
    name = F.when((F.col("event_type") == "signup") & (F.col("k") < 40), "signup_low").when((F.col("event_type") == "view") & (F.col("k") > 60), "view_high")
    files = r.select("run_id", name.alias("file"), ((F.col("event_type") == "click") & (F.col("k") > 85)).alias("marker"))
    return X.completeness(r.select("run_id").distinct(), files, ["run_id"], "file", ["signup_low", "view_high"], "marker", "time_window_missing_END_EPOCH")


@query("a07_damaged_text", sql="""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN user_id % 20 < 10 OR event_id % 2 = 0 THEN '.' ELSE ',' END || '123+08:00,' || value AS line FROM events""")
def _(t):
    bad = F.col("user_id") % 20 < 10  # files in which every timestamp is cut; in the others every second one
    cut = bad | (F.col("event_id") % 2 != 0)
    text = cc(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(cut, ",").otherwise("."), F.lit("123+08:00,"), F.when(bad, F.lit("\0")).otherwise(""), S("value"))
    return P.repair_timestamps(t.events.select("event_id", (F.col("user_id") % 20).alias("file"), text.alias("line")), ["file"], "line").select("event_id", "line")


@query("a08_header_variants", sql="SELECT event_id, value AS gpu_util_pct, round(value + 1, 2) AS power_w FROM events")
def _(t):
    e = t.events.select("event_id", cc(S("value"), F.lit(" %")).alias(" utilization.gpu [%]"), cc(F.round(F.col("value") + 1, 2).cast("string"), F.lit(" W")).alias("power.draw"))
    return rounded(C.normalise_headers(e, {"gpu_util_pct": ["utilization.gpu [%]", "utilization.gpu"], "power_w": ["power.draw [W]", "power.draw"], "absent": ["nothing"]}, keep=["event_id"]))


@query("a09_exposition_text", sql="""SELECT event_id, 'request_latency' AS metric, CAST(user_id AS VARCHAR) AS run, event_type || ' "q" \\ x' AS kind, value, date_trunc('millisecond', ts) AS ts FROM events WHERE event_id % 9 <> 0""")
def _(t):
    e = t.events
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    text = cc(F.lit('request_latency{run="'), S("user_id"), F.lit('",kind="'), F.col("event_type"), F.lit(' \\"q\\" \\\\ x"} '), S("value"), F.lit(" "), ms.cast("string"))
    lines = e.select("event_id", F.when(F.col("event_id") % 18 == 0, F.lit("# HELP x")).when(F.col("event_id") % 9 == 0, F.lit("broken{")).otherwise(text).alias("value"))
    out = P.exposition(lines)
    return out.select("event_id", "metric", F.col("labels")["run"].alias("run"), F.col("labels")["kind"].alias("kind"), "value", "ts")


@query("a09_exposition_untimed", sql="SELECT event_id, 'm' AS metric, event_type AS kind, value, CAST(NULL AS TIMESTAMP) AS ts FROM events")
def _(t):
    text = cc(F.lit('m{kind="'), "event_type", F.lit('"} '), S("value"))
    out = P.exposition(t.events.select("event_id", text.alias("value")))
    return out.select("event_id", "metric", F.col("labels")["kind"].alias("kind"), "value", "ts")


@query("a09_repeated_label", sql="SELECT event_id, event_type AS a, CAST(user_id AS VARCHAR) AS b, 2 AS labels, value FROM events")
def _(t):
    text = cc(F.lit('m{a="first",b="'), S("user_id"), F.lit('",a="'), "event_type", F.lit('"} '), S("value"))
    out = P.exposition(t.events.select("event_id", text.alias("value")))
    return out.select("event_id", F.col("labels")["a"].alias("a"), F.col("labels")["b"].alias("b"), F.size("labels").alias("labels"), "value")


@query("a10_chart_latest", sql="SELECT o_orderkey, d AS dimension, CASE d WHEN 'user' THEN o_totalprice ELSE o_custkey::DOUBLE END AS value, 'MiB' AS units FROM orders, (SELECT unnest(['user', 'system']) AS d)")
def _(t):
    doc = F.to_json(F.struct(F.array(F.lit("time"), F.lit("user"), F.lit("system")).alias("labels"),
                             F.array(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.array(F.lit(2.0), F.col("o_totalprice"), F.col("o_custkey").cast("double"))).alias("data"), F.lit("MiB").alias("units")))
    return P.chart_latest(t.orders.select("o_orderkey", doc.alias("doc")), "doc", ["o_orderkey"])


@query("a11_station_dump", sql="""SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS station_no, printf('02:00:00:%02x:%02x:%02x', o_orderkey // 65536 % 256, o_orderkey // 256 % 256, o_orderkey % 256) AS mac,
 (o_orderkey * 10)::DOUBLE AS rx_bytes, -(o_orderkey % 90)::DOUBLE AS signal_avg_dbm, CASE WHEN o_orderkey % 2 = 0 THEN 40.5::DOUBLE END AS tx_bitrate_mbps FROM orders""")
def _(t):
    k = F.col("o_orderkey")
    mac = F.format_string("Station 02:00:00:%02X:%02X:%02X (on wlan0)", F.floor(k / 65536) % 256, F.floor(k / 256) % 256, k % 256)
    parts = F.array(mac, cc(F.lit("\trx bytes:\t"), (k * 10).cast("string")), cc(F.lit("\tsignal avg:\t-"), (k % 90).cast("string"), F.lit(" dBm")),
                    F.when(k % 2 == 0, F.lit("\ttx bitrate:\t40.5 MBit/s")).otherwise("\tauthorized: yes"))
    lines = t.orders.select("o_custkey", k, F.posexplode(parts).alias("i", "line")).select("o_custkey", (k * 10 + F.col("i")).alias("line_no"), "line")
    out = P.stations(lines, ["o_custkey"], ["line_no"], "line", width=50_000)
    return out.select("o_custkey", "station_no", "mac", "rx_bytes", F.col("signal_avg_dbm"), "tx_bitrate_mbps")


@query("a12_disk_and_radio", sql="""SELECT s_suppkey, s_suppkey * 512 AS read_bytes, s_nationkey::BIGINT * 512 AS written_bytes, 'net ' || s_nationkey AS ssid, CAST(s_nationkey AS INTEGER) AS channel, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 5180 ELSE 2412 END AS INTEGER) AS frequency_mhz,
 CASE WHEN s_suppkey % 2 = 0 THEN '5 GHz' ELSE '2.4 GHz' END AS band, 80 AS width_mhz, CASE WHEN s_suppkey % 3 = 0 THEN '20.00' ELSE 'unknown' END AS txpower_dbm FROM supplier""")
def _(t):
    k = F.col("s_suppkey")
    text = cc(F.lit("Interface wlan0\n\tssid net "), S("s_nationkey"), F.lit("\n\tchannel "), S("s_nationkey"), F.when(k % 2 == 0, " (5180 MHz), width: 80 MHz").otherwise(" (2412 MHz), width: 80 MHz"),
              F.when(k % 3 == 0, "\n\ttxpower 20.00 dBm").otherwise(""))
    r, w = P.disk_bytes("s_suppkey", "s_nationkey")
    return t.supplier.select("s_suppkey", r.alias("read_bytes"), w.alias("written_bytes"), *[c.alias(n) for n, c in P.radio(text).items()])


@query("a13_top_log", sql=f"""WITH {REQ}, l AS (SELECT *, CASE WHEN event_type = 'signup' THEN date_trunc('second', ts) END AS head FROM req), c AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY event_id) AS t0 FROM l)
SELECT run_id, event_id AS line_no, t0 AS ts, k::DOUBLE AS cpu_percent, latency_ms AS ram_used_percent FROM c WHERE event_type IN ('view', 'click') AND t0 IS NOT NULL""")
def _(t):
    text = F.when(F.col("event_type") == "signup", cc(F.lit("timestamp,"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))) \
        .when(F.col("event_type").isin("view", "click"), cc(F.lit("node-1 100m "), S("k"), F.lit("% 200Mi "), S("latency_ms"), F.lit("%"))).when(F.col("k") < 50, "----").otherwise("[warn] x y z w")
    return P.top_log(_lines(t, text), ["run_id"], ["line_no"], "line", width=2000)


@query("a14_log_scan", sql="SELECT doc_id FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 3")
def _(t):
    word = F.when(F.col("doc_id") % 7 == 0, " was OOMKilled now ").when(F.col("doc_id") % 11 == 3, " NODE-PRESSURE x ").otherwise(" OOMKilledX ")
    text = F.regexp_replace("text", "\n", " ")
    at = F.pmod(F.col("doc_id") * 31, F.length("text") + 1).cast("int")  # anywhere in the text, its end included
    line = cc(F.substring(text, F.lit(1), at), word, F.substring(text, at + 1, F.length("text")))
    return P.scan_log(t.documents.select("doc_id", line.alias("line")), "line").select("doc_id")


@query("a14_pod_states", sql="SELECT 'pod-' || o_custkey AS pod, o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY ALL")
def _(t):
    line = F.when(F.col("o_orderkey") % 5 == 0, cc(F.lit("other-1 1/1 "), "o_orderstatus")).otherwise(cc(F.lit("pod-"), S("o_custkey"), F.lit("  1/1   "), "o_orderstatus", F.lit(" 0 3d")))
    return P.pod_states(t.orders.select(line.alias("line")), "line", "pod-")


@query("a15_process_lines", sql="SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey END AS pid, p_name AS process_name, p_size || ',5 MiB' AS used_memory FROM part WHERE p_partkey % 6 <> 5")
def _(t):
    line = F.when(F.col("p_partkey") % 6 == 5, F.lit("only,two")).otherwise(cc(F.when(F.col("p_partkey") % 4 == 0, F.lit("[N/A]")).otherwise(S("p_partkey")), F.lit(", "), "p_name", F.lit(", "), S("p_size"), F.lit(",5 MiB")))
    out = t.part.select("p_partkey", *[c.alias(n) for n, c in P.process_line(line).items()])
    return out.filter("valid").drop("valid")


@query("a16_growing_header", sql="SELECT event_id, user_id, CASE WHEN event_type = 'view' THEN value END AS v_view, CASE WHEN event_type = 'click' THEN value END AS v_click FROM events WHERE event_type IN ('view', 'click')")
def _(t):
    old = t.events.filter("event_type = 'view'").select("event_id", "user_id", F.col("value").alias("v_view"))
    new = t.events.filter("event_type = 'click'").select("event_id", "user_id", F.col("value").alias("v_click"))
    path = folder(t)
    X.append_growing(old, new, ["event_id", "user_id"]).write.parquet(path)
    return t.spark.read.parquet(path)


@query("a17_locked_header", sql="SELECT event_id, CAST(value AS VARCHAR) AS cpu, CASE WHEN event_id % 2 = 0 THEN event_type END AS mode, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END + 1 AS extra_fields_dropped FROM events")
def _(t):
    base = F.create_map(F.lit("cpu"), S("value"), F.lit("x1"), F.lit("a"))
    more = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("mode"), F.col("event_type"))).otherwise(F.create_map().cast("map<string,string>"))
    extra = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("x2"), F.lit("b"))).otherwise(F.create_map().cast("map<string,string>"))
    return X.append_locked(t.events.select("event_id", F.map_concat(base, more, extra).alias("fields")), "fields", ["cpu", "mode"], ["event_id"])


@query("a18_metric_lines", sql="""SELECT c_custkey, 'balance{name="' || c_name || '",quoted="a\\"' || c_nationkey || '"} ' || c_custkey AS value FROM customer""")
def _(t):
    lab = F.create_map(F.lit("quoted"), cc(F.lit('a"'), S("c_nationkey")), F.lit("name"), F.col("c_name"))
    return P.metric_lines(t.customer, F.lit("balance"), lab, "c_custkey", "c_custkey")


@query("a19_input_fingerprint", sql="SELECT 'added' AS change, count(DISTINCT c_nationkey) AS folders FROM customer WHERE CAST(c_nationkey AS VARCHAR) NOT LIKE '1%'")
def _(t):
    path = _tree(t)
    before = X.fingerprint(X.list_files(t.spark, path)).filter(F.col("path").contains("folder=run_1"))
    return X.changed_inputs(before, X.fingerprint(X.list_files(t.spark, path))).groupBy("change").agg(
        F.count_distinct(X.run_of(F.col("path"))).alias("folders"))


@query("a20_planned_matrix", sql="SELECT p_brand, condition, replicate FROM (SELECT DISTINCT p_brand FROM part), (SELECT unnest(['normal_cooling', 'constrained_airflow']) AS condition), (SELECT unnest([1, 2, 3]) AS replicate)")
def _(t):
    return X.planned_matrix(t.part.select("p_brand").distinct(), ["normal_cooling", "constrained_airflow"], 3)


@query("a21_arrival_schedule", sql="""WITH s AS (SELECT s_suppkey, seg, CASE seg WHEN 'low' THEN 0.0 ELSE 10.0 END::DOUBLE AS a, CASE seg WHEN 'low' THEN 10.0 ELSE 20.0 END::DOUBLE AS z, (s_nationkey % 4 + CASE seg WHEN 'low' THEN 1 ELSE 0 END)::DOUBLE AS rps FROM supplier, (SELECT unnest(['low', 'high']) AS seg)),
r AS (SELECT s_suppkey, seg, rps, a + unnest(range(0, CAST(ceil((z - 1e-9 - a) * rps) AS BIGINT))) / rps AS t FROM s WHERE rps > 0)
SELECT s_suppkey, round(t, 9) AS scheduled_elapsed_s, rps AS target_rps, seg AS profile_name, row_number() OVER (PARTITION BY s_suppkey ORDER BY t, seg) - 1 AS schedule_index FROM r""")
def _(t):
    seg = t.supplier.select("s_suppkey", "s_nationkey", F.explode(F.array(F.lit("low"), F.lit("high"))).alias("seg"))
    low = F.col("seg") == "low"
    seg = seg.select("s_suppkey", "seg", F.when(low, 0.0).otherwise(10.0).alias("a"), F.when(low, 10.0).otherwise(25.0).alias("z"),
                     (F.col("s_nationkey") % 4 + low.cast("int")).cast("double").alias("rps"), F.lit(20.0).alias("dur"))
    return X.arrival_schedule(seg, ["s_suppkey"], "seg", "a", "z", "rps", "dur", width=8)


@query("a22_board_status", sql="""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 2 ELSE 1 END::INTEGER AS overlay_loaded, CASE WHEN s_suppkey % 3 = 0 THEN s_name || '.bit' ELSE s_name || '.img' END AS active_bitfile, CAST(s_nationkey AS INTEGER) AS ip_count,
 CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END AS has_dma, s_acctbal AS temperature_c FROM supplier""")
def _(t):
    k = F.col("s_suppkey")
    js = F.to_json(F.struct((k % 2).alias("loaded"), cc("s_name", F.lit(".bit")).alias("bitstream"), F.col("s_nationkey").alias("ip_num"), F.col("s_acctbal").alias("sysmon_temperature_c")))
    kv = cc(F.lit("Overlay_Loaded: Ready\nbitfile: "), "s_name", F.lit(".img\nIP_COUNT: "), S("s_nationkey"), F.lit("\naxi dma present\ntemperature_c: "), S("s_acctbal"))
    out = P.board_status(t.supplier.select("s_suppkey", F.when(k % 3 == 0, js).otherwise(kv).alias("text")), "text", ["s_suppkey"])
    return out.select("s_suppkey", "overlay_loaded", "active_bitfile", "ip_count", "has_dma", "temperature_c")


@query("a22_board_channels", sql="""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'idle' END AS dma_mm2s_state, CASE WHEN s_suppkey % 3 = 0 AND s_nationkey % 2 = 0 THEN 'halted' END AS dma_s2mm_state,
 CASE WHEN s_suppkey % 3 = 0 THEN '{"rx":' || s_nationkey || ',"tx":[1,2]}' END AS dma_channels_status, CASE WHEN s_suppkey % 3 <> 0 THEN 1 END::INTEGER AS has_dma FROM supplier""")
def _(t):
    k = F.col("s_suppkey")
    js = F.to_json(F.struct(F.lit("idle").alias("dma_mm2s_state"), F.when(F.col("s_nationkey") % 2 == 0, "halted").alias("dma_s2mm_state"),
                            F.struct(F.col("s_nationkey").alias("rx"), F.array(F.lit(1), F.lit(2)).alias("tx")).alias("dma_channels_status")))
    kv = F.lit("dma_mm2s_state: idle\ndma_channels_status: up")
    out = P.board_status(t.supplier.select("s_suppkey", F.when(k % 3 == 0, js).otherwise(kv).alias("text")), "text", ["s_suppkey"])
    return out.select("s_suppkey", "dma_mm2s_state", "dma_s2mm_state", "dma_channels_status", F.nullif("has_dma", F.lit(0)).alias("has_dma"))


@query("a23_range_matrix", sql="SELECT o_orderkey, pod, (o_orderkey * 10 + i)::DOUBLE AS ts_s, CASE pod WHEN 'a' THEN o_totalprice ELSE o_custkey + i END AS value FROM orders, (SELECT unnest([0, 1]) AS i), (SELECT unnest(['a', 'b']) AS pod)")
def _(t):
    k = F.col("o_orderkey")
    at = lambda i, v: F.array((k * 10 + i).cast("string"), v.cast("string"))
    one = lambda pod, values: F.struct(F.create_map(F.lit("pod"), F.lit(pod)).alias("metric"), values.alias("values"))
    result = F.array(one("a", F.array(at(0, F.col("o_totalprice")), at(1, F.col("o_totalprice")))), one("b", F.array(at(0, F.col("o_custkey")), at(1, F.col("o_custkey") + 1))))
    docs = t.orders.select("o_orderkey", F.to_json(F.struct(F.struct(result.alias("result")).alias("data"))).alias("doc"))
    return P.range_matrix(docs, "doc", ["o_orderkey"]).select("o_orderkey", F.col("labels")["pod"].alias("pod"), "ts_s", "value")


@query("a24_tagged_json", sql=f"""WITH {REQ}, s AS (SELECT run_id, count(*) FILTER (event_type = 'view' AND k % 5 <> 0) AS p, max_by(k, event_id) FILTER (event_type = 'error') AS lk, max_by(latency_ms, event_id) FILTER (event_type = 'error') AS ll FROM req GROUP BY 1)
SELECT run_id, p AS progress_samples, CASE WHEN lk >= 30 THEN ll END AS loops, coalesce(lk >= 30 AND lk % 2 = 0, false) AS success, CASE WHEN lk IS NULL OR lk < 30 THEN 'summary_missing' END AS error FROM s""")
def _(t):
    body = F.to_json(F.struct((F.col("k") % 2 == 0).alias("success"), F.col("latency_ms").alias("loops")))
    text = F.when(F.col("event_type") == "view", cc(F.lit("GPU_BURN_PROGRESS_JSON: "), F.when(F.col("k") % 5 == 0, "{bad").otherwise(body))) \
        .when(F.col("event_type") == "error", cc(F.lit("GPU_BURN_SUMMARY_JSON: "), F.when(F.col("k") < 30, "{bad").otherwise(body))).otherwise("noise")
    return P.tagged_json(_lines(t, text), ["run_id"], ["line_no"], "line", "GPU_BURN_PROGRESS_JSON:", "GPU_BURN_SUMMARY_JSON:", "loops double, success boolean, error string")
