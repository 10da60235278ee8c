"""Column-function and filter queries; their texts are made from the shared tables by Spark."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import columns as C
from pulsegrid.functions.times import DAY, HOUR
from pulsegrid.operators import documents as D, filters as L

from .registry import query, rounded
from .summaries import _q
from .views import OPEN, REQ, openloop, requests

cc = F.concat
S = lambda c: F.col(c).cast("string")


@query("b01_coerce_number", sql="SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS v FROM events")
def _(t):
    text = F.when(F.col("event_id") % 8 == 0, "n/a").when(F.col("event_id") % 4 == 0, "NaN").otherwise(S("value"))
    return t.events.select("event_id", C.number(text).alias("v"))


@query("b02_first_number", sql="SELECT page_id, TRY_CAST(nullif(regexp_extract(url, '[-+]?[0-9]+(\\.[0-9]+)?'), '') AS DOUBLE) AS v FROM pages")
def _(t):
    return t.pages.select("page_id", C.first_number("url").alias("v"))


@query("b03_strip_unit", sql="SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE value END AS v FROM events")
def _(t):
    unit = F.element_at(F.array(F.lit(" %"), F.lit(" W"), F.lit("MiB"), F.lit(" MHz "), F.lit(" furlongs")), (F.col("event_id") % 5 + 1).cast("int"))
    return t.events.select("event_id", C.strip_unit(cc(S("value"), unit)).alias("v"))


_WORDS = ["True", " yes", "0", "ok", "degraded", "healthy", "loaded", "OFF"]
_WORD = "['True', ' yes', '0', 'ok', 'degraded', 'healthy', 'loaded', 'OFF'][event_id % 8 + 1]"


def _word():
    return F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (F.col("event_id") % 8 + 1).cast("int"))


@query("b04_boolean_words", sql=f"""SELECT event_id, lower(trim({_WORD})) IN ('1', 'true', 'yes', 'ok') AS lenient, lower(trim({_WORD})) IN ('true', '1', 'yes') AS lenient_yes,
 CASE WHEN lower(trim({_WORD})) IN ('1', 'true', 'yes', 'y', 'ready', 'loaded', 'ok', 'present') THEN 1 ELSE 0 END AS flag,
 CASE WHEN event_id % 8 IN (3, 6) THEN NULL ELSE lower(trim({_WORD})) IN ('true', 'yes', 'degraded') END AS strict FROM events""")
def _(t):
    w = _word()
    known = ~(F.col("event_id") % 8).isin(3, 6)
    return t.events.select("event_id", C.lenient_ok(w).alias("lenient"), C.lenient_yes(w).alias("lenient_yes"), C.flag(w).alias("flag"),
                           F.when(known, C.strict_bool(w)).alias("strict"))


@query("b05_timestamps", sql="""SELECT event_id, ts - INTERVAL 8 HOUR AS from_local, date_trunc('second', ts) AS wall, date_trunc('second', ts) - INTERVAL 8 HOUR AS utc,
 CASE WHEN event_id % 3 = 2 THEN NULL ELSE date_trunc('second', ts) END AS any_format FROM events""")
def _(t):
    iso = cc(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00"))
    mixed = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy/MM/dd HH:mm:ss")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("bad")
    return t.events.select("event_id", C.local_to_utc("ts").alias("from_local"), C.wall_clock(iso).alias("wall"), C.utc_text(iso).alias("utc"), C.any_date(mixed).alias("any_format"))


@query("b06_key_extraction", sql="""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y%m%d_%H%M%S') ELSE 'plain_' || user_id END AS start_key, CAST(user_id AS INTEGER) AS cycle,
 value AS rate FROM events""")
def _(t):
    name = F.when(F.col("event_id") % 2 == 0, cc(F.lit("run_"), F.date_format("ts", "yyyyMMdd_HHmmss"))).otherwise(cc(F.lit("plain_"), S("user_id")))
    return t.events.select("event_id", C.run_start_key(name).alias("start_key"), C.cycle_number(cc(F.lit("x_cycle_"), S("user_id"))).alias("cycle"),
                           C.offered_rate(cc(F.lit("open_rps"), S("value"), F.lit("_r01"))).alias("rate"))


@query("b07_first_filled", sql="SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE 'fallback' END AS label, c_acctbal AS balance FROM customer")
def _(t):
    c = t.customer
    balance = C.pick_by_keywords(c.columns, ["acct"], ["key"])
    return c.select("c_custkey", C.first_filled(F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.lit(" ")),
                                                F.when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment")), F.lit("fallback")).alias("label"), F.col(balance).alias("balance"))


@query("b08_elapsed_axis", sql="SELECT event_id, round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6, 6) AS elapsed_s FROM events")
def _(t):
    from pulsegrid.operators.grid import elapsed_axis
    return rounded(elapsed_axis(requests(t), ["run_id"], "us", unit=1e6).select("event_id", "elapsed_s"))


_MSG = ["ok", "ConnectTimeout while", "Read timed out", "Remote Disconnected", "Connection aborted.", "connection refused", "weird"]


@query("b09_failure_class", sql="""SELECT event_id, CASE event_id % 11 WHEN 0 THEN 'none' WHEN 1 THEN 'connect_timeout' WHEN 2 THEN 'read_timeout' WHEN 3 THEN 'remote_disconnected' WHEN 4 THEN 'connection_error'
 WHEN 5 THEN 'connection_refused' WHEN 6 THEN 'client_transport_error' WHEN 7 THEN 'server_5xx' WHEN 8 THEN 'client_4xx' WHEN 9 THEN 'http_error' ELSE 'client_transport_error' END AS kind FROM events""")
def _(t):
    i = (F.col("event_id") % 11).cast("int")
    msg = F.element_at(F.array(*[F.lit(m) for m in _MSG]), F.least(i + 1, F.lit(7)))
    code = F.when(i == 0, "200").when(i < 7, "0").when(i == 7, "503").when(i == 8, "404").when(i == 9, "302").otherwise("n/a")
    return t.events.select("event_id", C.failure_class(code, msg).alias("kind"))


@query("b10_client_error", sql="""SELECT event_id, CASE event_type WHEN 'click' THEN 'connect_timeout' WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'timeout' ELSE 'url_error' END WHEN 'error' THEN 'connection_error'
 WHEN 'signup' THEN 'timeout' ELSE 'ValueError' END AS kind FROM events""")
def _(t):
    name = F.when(F.col("event_type") == "click", "ConnectTimeout").when(F.col("event_type") == "view", "URLError").when(F.col("event_type") == "error", "ConnectionError") \
        .when(F.col("event_type") == "signup", "TimeoutError").otherwise("ValueError")
    return t.events.select("event_id", C.client_error(name, F.when(F.col("event_id") % 2 == 0, "Timed out").otherwise("no route")).alias("kind"))


@query("b11_freshness_class", sql="""SELECT event_id, CASE WHEN event_type = 'error' THEN 'missing' WHEN value <= 5 THEN 'ok_for_10_30s_warning' WHEN value <= 30 THEN 'caution_for_10_30s_warning' ELSE 'not_primary_for_10_30s_warning' END AS decision FROM events""")
def _(t):
    from pulsegrid.operators.summary import freshness
    return t.events.select("event_id", freshness(F.when(F.col("event_type") != "error", F.col("value"))).alias("decision"))


_ROLE = [("node.disk_read", "storage_context"), ("vmagg.sample_age_s", "telemetry_quality"), ("gpu_util_avg", "gpu_load_candidate"), ("fb_used_mib", "memory_load_candidate"),
         ("cpu_user_pct", "cpu_load_candidate"), ("gpu_temp_c", "thermal_clock_power_context"), ("pods_running", "service_cluster_context"), ("anything", "other_numeric_candidate")]


@query("b12_feature_roles", sql=f"""WITH r AS (SELECT l_suppkey, l_linenumber, {[r for _, r in _ROLE]}[l_suppkey % 8 + 1] AS role, 1 - count(*) / 90.0 AS missing, count(DISTINCT l_tax) AS u, stddev_samp(l_tax) AS sd FROM lineitem GROUP BY ALL)
SELECT l_suppkey, l_linenumber, role, CASE WHEN role = 'telemetry_quality' THEN 'exclude_primary_feature' WHEN role IN ('thermal_clock_power_context', 'storage_context') THEN 'target_or_context_not_external_load'
 WHEN missing > 0.2 THEN 'exclude_missing' WHEN u <= 1 OR sd IS NULL OR sd = 0 THEN 'exclude_constant' WHEN role LIKE '%load_candidate' THEN 'candidate_load_feature' ELSE 'candidate_context_feature' END AS decision FROM r""")
def _(t):
    g = t.lineitem.groupBy("l_suppkey", "l_linenumber").agg((1 - F.count(F.lit(1)) / 90.0).alias("missing"), F.count_distinct("l_tax").alias("u"), F.stddev_samp("l_tax").alias("sd"))
    name = F.element_at(F.array(*[F.lit(n) for n, _ in _ROLE]), (F.col("l_suppkey") % 8 + 1).cast("int"))
    g = g.withColumn("role", C.feature_role(name))
    return g.select("l_suppkey", "l_linenumber", "role", C.feature_decision("role", "missing", "u", "sd").alias("decision"))


_KX = "CAST(regexp_extract(props, '[0-9]+') AS INTEGER)"


@query("b13_sample_state", sql=f"""WITH x AS (SELECT event_id, {_KX} AS k, value * 20 AS ms, event_type FROM events), y AS (SELECT event_id, CASE WHEN k < 5 THEN 'node_not_ready' WHEN event_type = 'error' THEN 'sentinel_unreachable' WHEN k > 95 THEN 'compute_check_failed'
 WHEN ms >= 2000 THEN 'compute_check_timeout' WHEN ms >= 1000 THEN 'compute_latency_high' ELSE '' END AS reason FROM x) SELECT event_id, reason, CASE WHEN reason = 'node_not_ready' THEN 'DOWN' WHEN reason <> '' THEN 'DEGRADED' ELSE 'UP' END AS state FROM y""")
def _(t):
    state, reason = C.sample_state(F.col("k") >= 5, F.col("event_type") != "error", F.col("k") <= 95, F.col("latency_ms") * 20)
    return requests(t).select("event_id", state.alias("state"), reason.alias("reason"))


@query("b14_node_health", sql=f"""WITH x AS (SELECT event_id, {_KX} AS k, value, event_type FROM events), y AS (SELECT *, k % 10 = 0 OR event_type = 'error' OR k % 13 = 0 AS err, k % 3 = 0 AS ext, k % 17 <> 0 AS known, k % 10 = 0 AS silent FROM x)
SELECT event_id, CASE WHEN NOT known OR (ext AND err) THEN 'offline' WHEN err OR (NOT silent AND greatest(least(value, 100), k) >= 90) THEN 'degraded' ELSE 'healthy' END AS health FROM y""")
def _(t):
    k, seen = F.col("k"), F.col("k") % 10 != 0
    return requests(t).select("event_id", C.node_health(
        F.when(k % 3 == 0, "edge").otherwise("worker"), k % 17 != 0, F.when(seen, F.col("latency_ms")), F.when(seen, k.cast("double")), F.lit(None).cast("double"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("node"), F.when(k % 13 == 0, "metrics_error").otherwise("ok")).alias("health"))


@query("b15_modes", sql=f"""WITH x AS (SELECT event_id, {_KX} AS k FROM events) SELECT event_id, CASE WHEN k % 3 > 0 AND k % 5 > 0 THEN 'mixed' WHEN k % 5 > 0 THEN 'shared' WHEN k % 3 > 0 THEN 'standard' ELSE 'none' END AS mode,
 CASE WHEN k % 2 > 0 AND k % 7 = 0 THEN 'pp' WHEN k % 2 = 0 AND k % 7 > 0 THEN 'tg' WHEN k % 2 > 0 THEN 'pg' END AS kind FROM x""")
def _(t):
    return requests(t).select("event_id", C.gpu_mode(F.col("k") % 3, F.col("k") % 5).alias("mode"), C.benchmark_kind(F.col("k") % 2, F.col("k") % 7).alias("kind"))


def documents_of_orders(t):
    """Nested status documents made of the orders."""
    o = t.orders
    return o.select(F.col("o_orderkey").alias("id"), F.struct(
        F.struct(F.col("o_totalprice").alias("used"), (F.col("o_orderkey") % 2 == 0).alias("ready"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("ts")).alias("node"),
        F.array(F.struct(F.lit("a").alias("name"), F.col("o_custkey").alias("mem")), F.struct(F.lit("b").alias("name"), (F.col("o_custkey") + 1).alias("mem"))).alias("gpus"),
        F.col("o_orderstatus").alias("phase")).alias("doc"))


@query("b16_flatten_dots", sql="""SELECT o_orderkey AS id, o_totalprice AS "doc.node.used", o_orderkey % 2 = 0 AS "doc.node.ready", CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS "doc.node.ts",
 '[{"name":"a","mem":' || o_custkey || '},{"name":"b","mem":' || (o_custkey + 1) || '}]' AS "doc.gpus", o_orderstatus AS "doc.phase" FROM orders""")
def _(t):
    return C.flatten(documents_of_orders(t), ".")


@query("b16_flatten_numeric", sql="""SELECT o_orderkey AS id, o_totalprice AS doc__node__used, CAST(o_orderkey % 2 = 0 AS INTEGER) AS doc__node__ready, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS doc__node__ts FROM orders""")
def _(t):
    return C.flatten(documents_of_orders(t), "__", numeric_only=True)


@query("b16_flatten_indexed", sql="""SELECT o_orderkey AS id, 'gpus[' || i || '].' || f AS name, CASE f WHEN 'mem' THEN CAST(o_custkey + i AS VARCHAR) ELSE ['a', 'b'][i + 1] END AS value FROM orders, (SELECT unnest([0, 1]) AS i), (SELECT unnest(['name', 'mem']) AS f)""")
def _(t):
    return C.flatten_indexed(documents_of_orders(t).select("id", F.col("doc.gpus").alias("gpus")), ["id"], "gpus", ["name", "mem"])


# One of three shapes by order: objects in lists in lists, a list at the top, a plain object with empty and null members.
SHAPES = """CASE o_orderkey % 3 WHEN 0 THEN '{"node":{"used":' || o_custkey || ',"gpus":[[{"mem":' || o_custkey || ',"ok":true},{"mem":null}],[]]},"name":"a \\"q\\" null,"}'
 WHEN 1 THEN '[[' || o_custkey || ',[null,"x",null]],{"deep":{"er":[[[' || o_orderkey || ']]]}}]' ELSE '{"e":{},"l":[],"s":"' || o_orderstatus || '","n":null}' END"""


def shapes_of_orders(t):
    """JSON texts of three shapes made of the orders."""
    k, c = F.col("o_orderkey"), S("o_custkey")
    first = cc(F.lit('{"node":{"used":'), c, F.lit(',"gpus":[[{"mem":'), c, F.lit(',"ok":true},{"mem":null}],[]]},"name":"a \\"q\\" null,"}'))
    second = cc(F.lit("[["), c, F.lit(',[null,"x",null]],{"deep":{"er":[[['), S("o_orderkey"), F.lit("]]]}}]"))
    third = cc(F.lit('{"e":{},"l":[],"s":"'), "o_orderstatus", F.lit('","n":null}'))
    return t.orders.select(k.alias("id"), F.when(k % 3 == 0, first).when(k % 3 == 1, second).otherwise(third).alias("doc"))


@query("b16_flatten_unknown", sql=f"""SELECT d.id, substr(j.fullkey, CASE WHEN substr(j.fullkey, 2, 1) = '.' THEN 3 ELSE 2 END) AS name, CASE WHEN j.type = 'NULL' THEN NULL WHEN j.type = 'VARCHAR' THEN j.atom ->> '$' ELSE j.atom::VARCHAR END AS value
 FROM (SELECT o_orderkey AS id, {SHAPES} AS doc FROM orders) d, json_tree(d.doc) j WHERE j.type NOT IN ('OBJECT', 'ARRAY')""")
def _(t):
    return D.flatten_unknown(shapes_of_orders(t), ["id"], "doc").select("id", "name", "value")


@query("b16_flatten_lists_kept", sql=f"""SELECT id, name, value FROM (SELECT o_orderkey AS id, o_orderkey % 3 AS m, o_custkey AS c, o_orderstatus AS s FROM orders) d,
 LATERAL (SELECT unnest(CASE m WHEN 0 THEN ['node__used', 'node__gpus', 'name'] WHEN 1 THEN [''] ELSE ['l', 's', 'n'] END) AS name,
 unnest(CASE m WHEN 0 THEN [c::VARCHAR, '[[{{"mem":' || c || ',"ok":true}},{{"mem":null}}],[]]', 'a "q" null,'] WHEN 1 THEN ['[[' || c || ',[null,"x",null]],{{"deep":{{"er":[[[' || id || ']]]}}}}]'] ELSE ['[]', s, NULL] END) AS value)""")
def _(t):
    return D.flatten_unknown(shapes_of_orders(t), ["id"], "doc", separator="__", lists=False).select("id", "name", "value")


@query("b16_flatten_indexed_deep", sql="""SELECT o_orderkey AS id, 'racks[' || i || '][' || j || '].' || f AS name, CASE f WHEN 'mem' THEN (o_custkey + 2 * i + j)::VARCHAR WHEN 'up' THEN CASE WHEN (o_orderkey + j) % 2 = 0 THEN 'true' END END AS value
 FROM orders, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j), (SELECT unnest(['mem', 'up']) AS f)""")
def _(t):
    gpu = lambda i, j: F.struct((F.col("o_custkey") + 2 * i + j).alias("mem"), F.when((F.col("o_orderkey") + j) % 2 == 0, True).alias("up"))
    racks = F.array(*[F.array(*[gpu(i, j) for j in (0, 1)]) for i in (0, 1)])
    return D.flatten_indexed_deep(t.orders.select(F.col("o_orderkey").alias("id"), racks.alias("racks")), ["id"], "racks").select("id", "name", "value")


@query("b17_prune_lists", sql="""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN '{"node":{"used":' || o_custkey || ',"gpus":[[{"mem":' || o_custkey || ',"ok":true},{}],[]]},"name":"a \\"q\\" null,"}'
 WHEN 1 THEN '[[' || o_custkey || ',["x"]],{"deep":{"er":[[[' || o_orderkey || ']]]}}]' ELSE '{"e":{},"l":[],"s":"' || o_orderstatus || '"}' END AS pruned FROM orders""")
def _(t):
    return shapes_of_orders(t).select("id", D.prune_text("doc").alias("pruned"))


@query("b17_prune_typed", sql="""SELECT o_orderkey AS id, '{"gpus":[{"mem":[' || o_custkey || ']}' || CASE WHEN o_orderkey % 2 = 0 THEN ',{"mem":[]}' ELSE '' END || ']}' AS pruned FROM orders""")
def _(t):
    gpu = lambda *m: F.struct(F.array(*m).alias("mem"), F.lit(None).cast("int").alias("none"))
    none = F.lit(None).cast("bigint")
    df = t.orders.select(F.col("o_orderkey").alias("id"), F.struct(F.array(gpu(none, F.col("o_custkey")), F.when(F.col("o_orderkey") % 2 == 0, gpu(none, none))).alias("gpus")).alias("doc"))
    return df.select("id", C.prune("doc", df.schema["doc"].dataType).alias("pruned"))


@query("b17_path_and_prune", sql="""SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) END, 'none') AS ts, o_orderstatus AS phase,
 '{"ready":' || (o_orderkey % 2 = 0)::VARCHAR || CASE WHEN o_orderkey % 3 = 0 THEN ',"ts":' || o_custkey ELSE '' END || '}' AS pruned FROM orders""")
def _(t):
    d = documents_of_orders(t).withColumn("json", F.to_json("doc"))
    return d.select("id", C.path_get("json", "node.ts", "none").alias("ts"), C.path_get("json", "phase").alias("phase"),
                    C.prune(F.struct(F.col("doc.node.ready").alias("ready"), F.col("doc.node.ts").alias("ts"))).alias("pruned"))


@query("b18_feature_selection", sql="SELECT event_id AS id, value AS \"node.value\" FROM events")
def _(t):
    flat = t.events.select(F.col("event_id").alias("id"), F.col("value").alias("vmagg.target_node_semantic.value"), F.col("event_type").alias("vmagg.text"), F.lit(1).alias("debug.x"))
    keep = C.usable_columns(flat, drop_prefixes=["debug."])
    return flat.select(*[F.col(f"`{c}`").alias(C.shorten(c, [("vmagg.", ""), ("target_node_semantic.", "node.")])) for c in keep])


@query("b19_unit_scaling", sql=f"""WITH x AS (SELECT event_id, value, {_KX} AS k FROM events) SELECT event_id, round(value * [1, 1024, 1048576, 1073741824, 1][k % 5 + 1], 3) AS bytes, CAST(trunc(value * 1048576) AS BIGINT) AS from_mib, round(value / 1048576, 9) AS mib,
 round(CASE WHEN value <= 1 THEN value * 100 ELSE value END, 6) AS pct, round(value * 8, 6) AS bits FROM x""")
def _(t):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("B/s", "KiB/s", " MiB", "gb per second", "furlong")]), (F.col("k") % 5 + 1).cast("int"))
    v = F.col("latency_ms")
    return requests(t).select("event_id", F.round(C.to_bytes(v, unit), 3).alias("bytes"), C.mib_to_bytes(v).alias("from_mib"), F.round(C.bytes_to_mib(v), 9).alias("mib"),
                              F.round(C.percent(v), 6).alias("pct"), F.round(v * 8, 6).alias("bits"))


@query("b20_cpu_and_ram", sql=f"""WITH x AS (SELECT event_id, value, {_KX} AS k FROM events) SELECT event_id, round(least(greatest(CASE WHEN k % 4 <> 0 THEN 100 - value ELSE value + k END, 0), 100), 6) AS cpu,
 round(k / (value + k + CASE WHEN k % 3 = 0 THEN 5 ELSE 0 END + 1) * 100, 6) AS ram FROM x""")
def _(t):
    v, k = F.col("latency_ms"), F.col("k").cast("double")
    return rounded(requests(t).select("event_id", C.cpu_used(F.when(F.col("k") % 4 != 0, v), [v, k]).alias("cpu"),
                                      C.ram_percent(k, v, F.when(F.col("k") % 3 == 0, F.lit(5.0)), F.lit(1.0)).alias("ram")))


@query("b21_guarded_ratios", sql="""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice - l_quantity, 6) AS overhead, round(CASE WHEN l_discount > 0 THEN l_tax / l_discount END, 6) AS ipc,
 round(CASE WHEN l_tax > 0 THEN l_discount / l_tax * 100 END, 6) AS vram_pct, greatest(l_quantity - 10, 0) AS swap_used FROM lineitem""")
def _(t):
    return rounded(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_extendedprice") - F.col("l_quantity")).alias("overhead"),
                                     C.guarded_ratio("l_tax", "l_discount").alias("ipc"), C.guarded_ratio("l_discount", "l_tax", 100.0).alias("vram_pct"),
                                     F.greatest(F.col("l_quantity") - 10, F.lit(0.0)).alias("swap_used")))


@query("b22_salted_id", sql="SELECT c_custkey, substr(sha256('salt:' || lower(c_name)), 1, 12) AS station FROM customer")
def _(t):
    return t.customer.select("c_custkey", C.salted_id("c_name", "salt").alias("station"))


@query("b23_query_texts", sql="""WITH d AS (SELECT doc_id, 'sum(rate(metric_' || doc_id || '{job="x"}[' || (doc_id % 9 + 1) || 'm])) + avg_over_time(y[30s]) ' || regexp_replace(text, '[^a-zA-Z \\n]', '', 'g') AS q FROM documents), c AS (SELECT doc_id, trim(regexp_replace(q, '\\s+', ' ', 'g')) AS s FROM d)
SELECT doc_id, CASE WHEN length(s) <= 140 THEN s ELSE substr(s, 1, 137) || '...' END AS compact, 'metric_' || doc_id AS hint, (doc_id % 9 + 1) || 'm,30s' AS windows FROM c""")
def _(t):
    q = cc(F.lit("sum(rate(metric_"), S("doc_id"), F.lit('{job="x"}['), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("m])) + avg_over_time(y[30s]) "), F.regexp_replace("text", r"[^a-zA-Z \n]", ""))
    return t.documents.select("doc_id", C.compact_text(q).alias("compact"), C.metric_hint(q).alias("hint"), C.range_windows(q).alias("windows"))


@query("b24_composite_keys", sql="SELECT o_orderkey, 'repeat=' || (o_orderkey % 3) || '|fan=' || CASE WHEN o_orderkey % 4 = 0 THEN 'nan' ELSE CAST(o_custkey AS VARCHAR) END AS profile_key, o_custkey || '_c' || CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE o_orderkey % 7 END AS cycle_uid FROM orders")
def _(t):
    return t.orders.select("o_orderkey", C.profile_key({"repeat": F.col("o_orderkey") % 3, "fan": F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey"))}).alias("profile_key"),
                           C.cycle_uid("o_custkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 7)).alias("cycle_uid"))


@query("b25_benchmark_payload", sql="""SELECT s_suppkey, round(s_acctbal / 1000, 3) AS mean_latency_s, CASE WHEN s_suppkey % 3 = 0 THEN round(s_suppkey / 1000, 3) ELSE round((s_suppkey + 7) / 1000, 3) END AS p95_ttft_s,
 s_acctbal AS prompt_tps, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS n_prompt, CASE WHEN s_suppkey % 5 = 0 THEN 'completed_with_errors' ELSE 'succeeded' END AS status FROM supplier""")
def _(t):
    from pulsegrid.sources.parsing import benchmark_payload
    k = F.col("s_suppkey")
    doc = F.to_json(F.struct(F.col("s_acctbal").alias("mean_e2el_ms"), F.when(k % 3 == 0, k).alias("p95_ttft_ms"), (k + 7).alias("p99_ttft_ms"), (k % 5 == 0).cast("int").alias("failed"),
                             F.when(k % 2 == 0, F.col("s_acctbal")).alias("avg_ts"), F.when(k % 2 == 1, F.col("s_acctbal")).alias("mean_tps"), F.when(k % 2 == 0, F.col("s_nationkey")).alias("prompt_tokens")))
    return benchmark_payload(t.supplier.select("s_suppkey", doc.alias("doc")), "doc").select("s_suppkey", "mean_latency_s", "p95_ttft_s", "prompt_tps", "n_prompt", "status")


@query("b26_identity_cascade", sql="""WITH nm AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN ' ' || lower(s_name) WHEN 1 THEN s_name || '-extra' WHEN 2 THEN substr(s_name, 1, 17) ELSE 'other' END AS name, CASE WHEN s_suppkey % 8 = 3 THEN '10.0.0.' || (s_suppkey - 3) END AS ip FROM supplier),
cd AS (SELECT s_name AS cand, lower(s_name) AS c, '10.0.0.' || s_suppkey AS cip FROM supplier WHERE s_suppkey % 4 IN (0, 1)),
j AS (SELECT s_suppkey, lower(trim(name)) AS n, ip FROM nm),
x AS (SELECT s_suppkey, (SELECT min(cand) FROM cd WHERE c = n) AS e, (SELECT min(cand) FROM cd WHERE starts_with(c, n) OR starts_with(n, c)) AS p, (SELECT min(cand) FROM cd WHERE cip = ip) AS a FROM j)
SELECT s_suppkey, coalesce(e, p, a) AS resolved, CASE WHEN e IS NOT NULL THEN 'exact' WHEN p IS NOT NULL THEN 'prefix' WHEN a IS NOT NULL THEN 'address' ELSE 'unresolved' END AS match_method FROM x""")
def _(t):
    from pulsegrid.operators.align import resolve_identity
    k = F.col("s_suppkey")
    names = t.supplier.select("s_suppkey", F.when(k % 4 == 0, cc(F.lit(" "), F.lower("s_name"))).when(k % 4 == 1, cc("s_name", F.lit("-extra"))).when(k % 4 == 2, F.substring("s_name", 1, 17)).otherwise("other").alias("name"),
                              F.when(k % 8 == 3, cc(F.lit("10.0.0."), (k - 3).cast("string"))).alias("ip"))
    cand = t.supplier.filter((k % 4).isin(0, 1)).select(F.col("s_name").alias("cand"), cc(F.lit("10.0.0."), S("s_suppkey")).alias("cip"))
    return resolve_identity(names, cand, "name", "ip", "cand", "cip").select("s_suppkey", "resolved", "match_method")


@query("b26_unique_match", sql="""WITH nm AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'NATION_' || c_nationkey WHEN 1 THEN 'NATION_' || c_nationkey || '.x' ELSE 'ION_' || c_nationkey END AS name FROM customer),
x AS (SELECT c_custkey, name, (SELECT CASE WHEN count(*) = 1 THEN min(n_name) END FROM nation WHERE starts_with(n_name, name)) AS d, (SELECT CASE WHEN count(*) = 1 THEN min(n_name) END FROM nation WHERE starts_with(name, n_name)) AS u,
 (SELECT CASE WHEN count(*) = 1 THEN min(n_name) END FROM nation WHERE contains(n_name, name)) AS i FROM nm)
SELECT c_custkey, coalesce(d, u, i, name) AS resolved, CASE WHEN d IS NOT NULL THEN 'prefix' WHEN u IS NOT NULL THEN 'reverse_prefix' WHEN i IS NOT NULL THEN 'contains' ELSE 'itself' END AS match_method FROM x""")
def _(t):
    from pulsegrid.operators.align import unique_match
    k, n = F.col("c_custkey"), S("c_nationkey")
    names = t.customer.select("c_custkey", F.when(k % 3 == 0, cc(F.lit("NATION_"), n)).when(k % 3 == 1, cc(F.lit("NATION_"), n, F.lit(".x"))).otherwise(cc(F.lit("ION_"), n)).alias("name"))
    return unique_match(names, t.nation, "name", "n_name").select("c_custkey", "resolved", "match_method")


@query("b27_register_state", sql=f"WITH x AS (SELECT event_id, CAST(event_id % 4 AS INTEGER) AS ctl, CAST(event_id % 33000 AS INTEGER) AS st FROM events) SELECT event_id, CASE WHEN st & 18288 <> 0 THEN 'error' WHEN ctl & 1 = 1 AND st & 1 = 0 THEN 'ready' ELSE 'degraded' END AS state FROM x")
def _(t):
    return t.events.select("event_id", C.dma_state((F.col("event_id") % 4).cast("int"), (F.col("event_id") % 33000).cast("int")).alias("state"))


@query("b28_hottest_sensor", sql="""WITH x AS (SELECT user_id, event_type, event_id, value * 500 / 1000 AS c FROM events) SELECT user_id, round(max(c) FILTER (c BETWEEN 0 AND 125), 6) AS celsius, max_by(event_type, (c, -event_id)) FILTER (c BETWEEN 0 AND 125) AS source FROM x GROUP BY 1""")
def _(t):
    c = C.plausible_celsius(F.col("value") * 500)
    return rounded(t.events.groupBy("user_id").agg(F.max(c).alias("celsius"), F.max_by("event_type", F.when(c.isNotNull(), F.struct(c, -F.col("event_id")))).alias("source")))


@query("b29_memory_quantity", sql=f"""WITH x AS (SELECT event_id, event_id % 5000 AS n, event_id % 7 AS u FROM events) SELECT event_id, CAST(CASE u WHEN 0 THEN floor(n / 1048576) WHEN 1 THEN floor(n / 1024) WHEN 2 THEN n WHEN 3 THEN n * 1024 WHEN 4 THEN n * 1000 WHEN 5 THEN n ELSE 0 END AS BIGINT) AS mib FROM x""")
def _(t):
    u = F.element_at(F.array(*[F.lit(x) for x in ("", "Ki", "Mi", "Gi", "G", "M", "Qi")]), (F.col("event_id") % 7 + 1).cast("int"))
    return t.events.select("event_id", C.quantity_mib(cc((F.col("event_id") % 5000).cast("string"), u)).alias("mib"))


# ---- filters ----


@query("c01_success_predicate", sql=f"WITH x AS (SELECT event_id, {_KX} AS k, event_type FROM events) SELECT event_id FROM x WHERE event_type = 'view' OR k % 2 = 1")
def _(t):
    r = requests(t).withColumn("error_type", F.when(F.col("event_type") == "view", "normal_success")).withColumn("success", F.col("k") % 2)
    return r.filter(L.succeeded("error_type", "success")).select("event_id")


@query("c02_clean_rows", sql=f"WITH {REQ} SELECT event_id FROM req WHERE ok AND k >= 10 AND event_type = 'click' AND latency_ms > 1 AND us BETWEEN 1704500000000000 AND 1706000000000000")
def _(t):
    r = requests(t).withColumn("status", F.when(F.col("k") >= 10, 200).otherwise(500)).withColumn("lat", F.when(F.col("latency_ms") > 1, F.col("latency_ms")))
    return L.clean_rows(r, F.col("ok"), "status", "event_type", "click", ["lat"], "us", 1704500000000000, 1706000000000000).select("event_id")


@query("c03_measurement_window", sql=f"""WITH {OPEN} SELECT event_id, run_id % 7 <> 0 AND scheduled_s >= run_id AND scheduled_s < run_id + 400 AS in_window, run_id % 7 <> 0 AND run_id % 5 <> 0 AND scheduled_s >= run_id AND scheduled_s < run_id + 400 AS eligible FROM ol""")
def _(t):
    w = t.events.select(F.col("user_id").alias("run_id")).distinct().filter("run_id % 7 <> 0").select(
        "run_id", F.col("run_id").cast("double").alias("a"), (F.col("run_id") + 400.0).alias("z"), (F.col("run_id") % 5 != 0).alias("valid"))
    return L.measurement_window(openloop(t), w, ["run_id"], "scheduled_s", "a", "z", "valid").select("event_id", "in_window", "eligible")


@query("c04_observation_window", sql=f"WITH {OPEN} SELECT event_id FROM ol WHERE run_id % 7 = 0 OR scheduled_s BETWEEN run_id AND run_id + 400")
def _(t):
    w = t.events.select(F.col("user_id").alias("run_id")).distinct().select("run_id", F.col("run_id").cast("double").alias("a"), F.when(F.col("run_id") % 7 != 0, F.col("run_id") + 400.0).alias("z"))
    return L.observed(openloop(t), w, ["run_id"], "scheduled_s", "a", "z").select("event_id")


@query("c05_trim_to", sql=f"WITH {REQ} SELECT event_id FROM req JOIN (SELECT run_id, max(us) AS z FROM req WHERE event_type = 'view' GROUP BY 1) USING (run_id) WHERE event_type <> 'view' AND us <= z")
def _(t):
    r = requests(t)
    return L.trim_to(r.filter("event_type <> 'view'"), r.filter("event_type = 'view'").select("run_id", F.col("us").alias("o")), ["run_id"], "us", "o").select("event_id")


@query("c06_eligibility", sql=f"WITH {OPEN} SELECT event_id, scheduled_s >= 100 AND k >= 20 AS thermal_eligible, scheduled_s >= 100 AND inflight >= 3 AS tail_eligible FROM ol")
def _(t):
    r = openloop(t).withColumn("temp", F.when(F.col("k") >= 20, F.col("k")))
    return L.eligibility(r, "scheduled_s", 100, ["temp"], "inflight", 3).select("event_id", "thermal_eligible", "tail_eligible")


@query("c07_quantile_cap", sql=f"WITH {REQ}, q AS (SELECT run_id, quantile_cont(latency_ms, .9) AS c FROM req GROUP BY 1) SELECT event_id, round(least(latency_ms, c), 6) AS latency_ms FROM req JOIN q USING (run_id)")
def _(t):
    return rounded(L.clip(requests(t), ["run_id"], "latency_ms", .9).select("event_id", "latency_ms"))


@query("c07_quantile_drop", sql=f"WITH {REQ} SELECT event_id FROM req WHERE latency_ms <= (SELECT quantile_cont(latency_ms, .99) FROM req)")
def _(t):
    return L.clip(requests(t), [], "latency_ms", .99, drop=True).select("event_id")


@query("c08_column_contract", sql="SELECT o_orderkey, o_totalprice FROM orders")
def _(t):
    return L.check_columns(t.orders, ["o_orderkey", "o_totalprice"], ["future_latency"], [("target_rps", "offered_rps")]).select("o_orderkey", "o_totalprice")


@query("c09_metric_alternatives", sql="""WITH x AS (SELECT user_id, event_id, event_type, CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 END AS r FROM events WHERE event_type <> 'error' OR user_id % 3 = 0)
SELECT event_id, event_type FROM (SELECT *, min(r) OVER (PARTITION BY user_id) AS m FROM x WHERE r IS NOT NULL) WHERE r = m""")
def _(t):
    e = t.events.filter("event_type <> 'error' OR user_id % 3 = 0")
    return L.first_with_rows(e, ["user_id"], "event_type", ["error", "click", "view"]).select("event_id", "event_type")


@query("c10_label_selectors", sql=f"WITH x AS (SELECT event_id, {_KX} AS k, event_type AS et, user_id AS u FROM events) SELECT event_id FROM x WHERE et = 'view' AND k % 4 <> 0 AND CAST(u AS VARCHAR) SIMILAR TO '1[0-9]+' AND NOT ('eth' || (k % 10)) SIMILAR TO 'eth[0-3]'")
def _(t):
    lab = F.create_map(F.lit("type"), F.col("event_type"), F.lit("fs"), F.when(F.col("k") % 4 == 0, "tmpfs").otherwise("ext4"), F.lit("node"), S("run_id"), F.lit("device"), cc(F.lit("eth"), (F.col("k") % 10).cast("string")))
    r = requests(t).withColumn("labels", lab)
    return L.select_labels(r, "labels", {"type": "view"}, {"fs": "tmpfs"}, {"node": "1[0-9]+"}, {"device": "eth[0-3]"}).select("event_id")
