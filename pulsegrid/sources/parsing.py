"""Parsers from text columns to typed rows. Line-oriented formats take (key, line number, line) rows, so a
long file is spread over tasks; what a line inherits from lines above comes from an ordered scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions import columns as C
from pulsegrid.operators.keys import col, join_on
from pulsegrid.operators.ordered import dealt, fill, running

NUMBER = r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"
# The forms of exposition lines and their labels.
EXPOSITION = r"^([A-Za-z_:][A-Za-z0-9_:]*)(\{.*\})?\s+(" + NUMBER + r")(?:\s+(\d+))?\s*$"
LABEL = r'(\w+)="((?:\\.|[^"\\])*)"'
BOARD_ALIASES = {  # Fixed values: names a board status may use for each field.
    "xrt_device_ready": ("xrt_device_ready", "device_ready", "xrt_ready"), "overlay_loaded": ("overlay_loaded", "is_overlay_loaded", "loaded"),
    "active_bitfile": ("active_bitfile", "bitfile", "bitstream"), "ip_count": ("ip_count", "ipcount", "ip_num"), "has_rfdc": ("has_rfdc", "rfdc"),
    "has_dma": ("has_dma", "dma"), "has_sysmon": ("has_sysmon", "sysmon"), "temperature_c": ("temperature_c", "sysmon_temperature_c"),
    "vccint_v": ("vccint_v", "sysmon_vccint_v"), "vccaux_v": ("vccaux_v", "sysmon_vccaux_v"),
}
BOARD_CHANNELS = ("dma_mm2s_state", "dma_s2mm_state", "dma_channels_status")  # Fixed values: fields of the transfer channels, in JSON only
BOARD_FLAGS = ("xrt_device_ready", "overlay_loaded", "has_rfdc", "has_dma", "has_sysmon")
BOARD_NUMBERS = ("temperature_c", "vccint_v", "vccaux_v")
BOARD_HINTS = {"has_rfdc": "rfdc", "has_dma": "dma", "has_sysmon": "sysmon"}


def exposition(lines: DataFrame, line: str = "value") -> DataFrame:
    """Metric exposition lines to (metric, labels, value, ts); comments and malformed lines are left out. Lines without a
    timestamp have a null ``ts``; of a label given twice the last value holds."""
    x = F.col(line)
    rows = lines.filter(x.rlike(EXPOSITION) & ~x.startswith("#"))
    blob = F.regexp_extract(x, EXPOSITION, 2)
    raw = F.regexp_extract_all(blob, F.lit(LABEL), F.lit(2))
    values = F.transform(raw, lambda v: F.replace(F.replace(F.replace(F.replace(
        v, F.lit("\\\\"), F.lit("\0")), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\0"), F.lit("\\")))
    pairs = F.arrays_zip(F.regexp_extract_all(blob, F.lit(LABEL), F.lit(1)).alias("k"), values.alias("v"))

    def last(p):  # looks for later copies only where a label is repeated
        later = lambda i: F.slice(p, i + 2, F.size(p) - i - 1)
        repeated = F.size(F.array_distinct(F.transform(p, lambda e: e["k"]))) < F.size(p)
        return F.when(repeated, F.filter(p, lambda e, i: ~F.exists(later(i), lambda z: z["k"] == e["k"]))).otherwise(p)

    labels = F.transform(F.array(pairs), lambda p: F.map_from_entries(last(p)))[0]  # the one-element array binds the pairs once
    return rows.select(
        *[c for c in lines.columns if c != line], F.regexp_extract(x, EXPOSITION, 1).alias("metric"),
        labels.alias("labels"), F.regexp_extract(x, EXPOSITION, 3).try_cast("double").alias("value"),
        F.timestamp_millis(F.regexp_extract(x, EXPOSITION, 4).try_cast("bigint")).cast("timestamp_ntz").alias("ts"))


def metric_lines(df: DataFrame, name, labels: Column, value, *keep: str) -> DataFrame:
    """Rows to exposition text ``name{k="v",…} value`` with labels sorted and escaped."""
    esc = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), esc(e["value"]), F.lit('"')))
    return df.select(*keep, F.concat(col(name), F.lit("{"), F.array_join(pairs, ","), F.lit("} "), col(value).cast("string")).alias("value"))


def chart_latest(df: DataFrame, payload: str, keep: Sequence[str], newest: str = "last") -> DataFrame:
    """Chart JSON (``labels``, ``data``) to one row per dimension of its newest data row."""
    doc = F.from_json(F.col(payload), "labels array<string>, data array<array<double>>, units string")
    rows = df.select(*keep, doc.alias("__d"))
    row = F.try_element_at(F.col("__d.data"), F.lit(-1 if newest == "last" else 1))
    every = F.arrays_zip(F.col("__d.labels").alias("dimension"), row.alias("value"))
    pairs = F.slice(every, F.lit(2), F.greatest(F.size(every) - 1, F.lit(0)))
    return rows.withColumn("__p", F.explode(F.when((F.size("__d.labels") >= 2) & row.isNotNull(), pairs))) \
        .select(*keep, F.col("__p.dimension").alias("dimension"), F.col("__p.value").alias("value"), F.col("__d.units").alias("units")) \
        .filter(F.col("dimension").isNotNull() & F.col("value").isNotNull())


STATION_FIELDS = {  # Fixed values: prefix of the line and pattern of the number behind it.
    "inactive_ms": "inactive time:", "rx_bytes": "rx bytes:", "tx_bytes": "tx bytes:", "rx_packets": "rx packets:", "tx_packets": "tx packets:",
    "tx_retries": "tx retries:", "tx_failed": "tx failed:", "signal_dbm": "signal:", "signal_avg_dbm": "signal avg:",
    "tx_bitrate_mbps": "tx bitrate:", "rx_bitrate_mbps": "rx bitrate:", "connected_seconds": "connected time:",
}
STATION = r"^Station\s+([0-9a-fA-F:]{17})"


def stations(lines: DataFrame, by: Sequence[str], order: Sequence[str], line: str, *, width, fields: Mapping[str, str] = STATION_FIELDS) -> DataFrame:
    """Station dump to one row per station block."""
    tagged = lines.withColumn("__mac", F.nullif(F.lower(F.regexp_extract(line, STATION, 1)), F.lit("")))
    tagged = running(dealt(tagged, by, order, width=width), by, order, {"station_no": F.col("__mac").isNotNull().cast("int")}, width=width).filter("station_no > 0")
    text = C.strip(F.col(line))
    position = F.struct(*[F.col(c) for c in order])
    return tagged.groupBy(*by, "station_no").agg(
        F.max("__mac").alias("mac"),
        *[F.max_by(F.when(text.startswith(p), C.first_number(F.substring(text, F.lit(len(p) + 1), F.length(text)))), F.when(text.startswith(p), position)).alias(n)
          for n, p in fields.items()])


def disk_bytes(read_sectors, written_sectors) -> tuple[Column, Column]:
    return col(read_sectors).cast("bigint") * 512, col(written_sectors).cast("bigint") * 512


def radio(text) -> dict[str, Column]:
    """Fields of a radio description text."""
    t = col(text)
    ch = r"channel (\d+) \((\d+) MHz\), width: (\d+) MHz"
    freq = F.regexp_extract(t, ch, 2).try_cast("int")
    return {"ssid": F.nullif(F.regexp_extract(t, r"(?m)^\s*ssid (.+)$", 1), F.lit("")), "channel": F.regexp_extract(t, ch, 1).try_cast("int"),
            "frequency_mhz": freq, "band": F.when(freq >= 5000, "5 GHz").when(freq.isNotNull(), "2.4 GHz"),
            "width_mhz": F.regexp_extract(t, ch, 3).try_cast("int"),
            "txpower_dbm": F.coalesce(F.nullif(F.regexp_extract(t, r"txpower ([0-9.]+) dBm", 1), F.lit("")), F.lit("unknown"))}


def top_log(lines: DataFrame, by: Sequence[str], order: Sequence[str], line: str, *, width) -> DataFrame:
    """Usage lines with the timestamp of the nearest ``timestamp,…`` header above; an unreadable header clears it."""
    text = C.strip(F.col(line))
    head = text.startswith("timestamp,")
    stamp = C.utc_text(F.substring_index(text, "timestamp,", -1))
    tagged = lines.withColumn("__s", F.when(head, F.struct(stamp.alias("ts"))))
    tagged = fill(tagged, by, order, {"__ts": "__s"}, width=width)
    parts = F.split(text, r"\s+")
    num = lambda i: C.first_number(F.try_element_at(parts, F.lit(i)))
    keep = ~head & (text != "") & ~text.startswith("[") & (text != "----") & (F.size(parts) >= 5) & F.col("__ts.ts").isNotNull()
    return tagged.filter(keep).select(*by, *order, F.col("__ts.ts").alias("ts"), num(3).alias("cpu_percent"), num(5).alias("ram_used_percent")) \
        .filter(F.col("cpu_percent").isNotNull() | F.col("ram_used_percent").isNotNull())


EVENT_PATTERNS = (r"\bEvicted\b", r"\bOOMKilled\b", r"\bMemoryPressure\b", r"(?i)\bnode-pressure\b", r"\bErrImagePull\b", r"\bImagePullBackOff\b")


def scan_log(lines: DataFrame, line: str, patterns: Sequence[str] = EVENT_PATTERNS) -> DataFrame:
    hit = F.lit(False)
    for p in patterns:
        hit |= F.col(line).rlike(p)
    return lines.filter(hit)


def pod_states(lines: DataFrame, line: str, prefix: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts per pod and status from ``name ready status …`` lines."""
    parts = F.split(C.strip(F.col(line)), r"\s+")
    rows = lines.filter(F.size(parts) >= 3).select(*by, parts[0].alias("pod"), parts[2].alias("status")).filter(F.col("pod").startswith(prefix))
    return rows.groupBy(*by, "pod", "status").agg(F.count(F.lit(1)).alias("n"))


def process_line(line) -> dict[str, Column]:
    """``pid, process, memory``; the memory text may hold commas, a pid may be unreadable."""
    parts = F.split(col(line), ",", 3)
    part = lambda i: F.nullif(C.strip(F.try_element_at(parts, F.lit(i))), F.lit(""))
    return {"valid": F.size(parts) >= 3, "pid": part(1).try_cast("bigint"), "process_name": part(2), "used_memory": part(3)}


def key_values(lines: DataFrame, by: Sequence[str], order: Sequence[str], line: str, names: Sequence[str]) -> DataFrame:
    """``KEY=VALUE`` lines to one row per key with the named settings; the last line of a name counts."""
    pair = F.split(F.col(line), "=", 2)
    rows = lines.filter(F.col(line).contains("=")).select(*by, *order, C.strip(pair[0]).alias("__k"), C.strip(pair[1]).alias("__v"))
    position = F.struct(*[F.col(c) for c in order])
    return rows.groupBy(*by).agg(*[F.max_by(F.when(F.col("__k") == n, F.col("__v")), F.when(F.col("__k") == n, position)).alias(n) for n in names])


def repair_timestamps(lines: DataFrame, by: Sequence[str], line: str, share: float = 0.8) -> DataFrame:
    """Strip NULs; where most rows of a file have a timestamp cut at its decimal comma, join it again."""
    clean = lines.withColumn(line, F.replace(F.col(line), F.lit("\0"), F.lit("")))
    broken = r"^([^,]*T\d{2}:\d{2}:\d{2}),(\d+(?:[+-]\d{2}:\d{2}|Z)?),"
    rate = clean.groupBy(*by).agg(F.avg(F.col(line).rlike(broken).cast("int")).alias("__rate"))
    return join_on(clean, rate, by).withColumn(line, F.when(F.col("__rate") > share, F.regexp_replace(line, broken, "$1.$2,")).otherwise(F.col(line))) \
        .drop("__rate")


def board_status(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """Board status from a JSON object with aliased keys, else from ``key: value`` lines and word hints. The states of the transfer channels are told
    in JSON only; a nested channel status stays as JSON text."""
    names = sorted({a for v in BOARD_ALIASES.values() for a in v} | set(BOARD_CHANNELS))
    doc = F.from_json(F.col(text), ", ".join(f"{n} string" for n in names))
    pairs = F.filter(F.transform(F.split(F.col(text), r"\r?\n"), lambda x: F.struct(
        F.lower(C.strip(F.substring_index(x, ":", 1))).alias("key"), C.strip(F.regexp_replace(x, r"^[^:]*:", "")).alias("value"), x.contains(":").alias("ok"))),
        lambda e: e["ok"])
    rows = df.select(*keep, F.col(text).alias("__t"), doc.alias("__d"), pairs.alias("__p"),
                     F.coalesce(F.size(F.json_object_keys(F.col(text))) > 0, F.lit(False)).alias("__json"))
    low = F.lower(F.col("__t"))
    out = []
    for field, aliases in BOARD_ALIASES.items():
        from_doc = F.coalesce(*[F.col("__d")[a] for a in aliases])
        last = F.try_element_at(F.filter(F.col("__p"), lambda e: e["key"].isin(*aliases)), F.lit(-1))["value"]
        v = F.when(F.col("__json"), from_doc).otherwise(last)
        if field in BOARD_FLAGS:
            v = C.flag(v)
            if field in BOARD_HINTS:
                v = F.when(~F.col("__json") & low.contains(BOARD_HINTS[field]), 1).otherwise(v)
        elif field in BOARD_NUMBERS:
            v = v.try_cast("double")
        elif field == "ip_count":
            v = v.try_cast("int")
        elif field == "active_bitfile":
            hint = F.regexp_extract(F.col("__t"), r"(?im)^\s*(.*bit.*?)\s*$", 1)
            v = F.coalesce(v, F.when(~F.col("__json"), F.nullif(hint, F.lit(""))))
        out.append(v.alias(field))
    channels = [F.when(F.col("__json"), F.col("__d")[c]).alias(c) for c in BOARD_CHANNELS]
    return rows.select(*keep, *out, *channels)


def range_matrix(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """Saved range-query answers to long samples (labels, epoch seconds, value)."""
    doc = F.from_json(F.col(text), "data struct<result: array<struct<metric: map<string,string>, values: array<array<string>>>>>")
    series = df.select(*keep, F.explode(doc["data"]["result"]).alias("__s"))
    points = series.select(*keep, F.col("__s.metric").alias("labels"), F.explode("__s.values").alias("__v"))
    return points.select(*keep, "labels", F.col("__v")[0].try_cast("double").alias("ts_s"), F.col("__v")[1].try_cast("double").alias("value"))


def tagged_json(lines: DataFrame, by: Sequence[str], order: Sequence[str], line: str, progress_tag: str, summary_tag: str, schema: str) -> DataFrame:
    """Progress count and last summary of a log with tagged JSON lines. A last summary that cannot be read,
    or none at all, gives the missing-summary default."""
    x = C.strip(F.col(line))
    body = lambda tag: C.strip(F.substring(x, F.lit(len(tag) + 1), F.length(x)))
    good = lambda tag: x.startswith(tag) & F.json_object_keys(body(tag)).isNotNull()
    position = F.struct(*[F.col(c) for c in order])
    last = F.max_by(F.when(good(summary_tag), body(summary_tag)), F.when(x.startswith(summary_tag), position))
    out = lines.groupBy(*by).agg(F.sum(good(progress_tag).cast("bigint")).alias("progress_samples"), last.alias("__s"))
    doc = F.from_json("__s", schema)
    fields = [f.strip().split()[0] for f in schema.split(",")]
    return out.select(*by, "progress_samples", *[doc[f].alias(f) for f in fields if f not in ("success", "error")],
                      F.coalesce(doc["success"], F.lit(False)).alias("success"),
                      F.when(F.col("__s").isNull(), "summary_missing").otherwise(doc["error"]).alias("error"))


THROUGHPUT_ALIASES = ("avg_ts", "avg_tps", "tokens_per_second_avg", "tps_avg", "mean_tps")
PROMPT_ALIASES = ("n_prompt", "prompt_tokens")


def benchmark_payload(df: DataFrame, text: str) -> DataFrame:
    """Benchmark result JSON to canonical columns: aliases resolved, milliseconds to seconds, p95 else p99."""
    names = ["failed", "median_e2el_ms", "p95_e2el_ms", "mean_e2el_ms", "mean_ttft_ms", "p95_ttft_ms", "p99_ttft_ms", "mean_tpot_ms", "p95_tpot_ms",
             "p99_tpot_ms", "mean_itl_ms", "p95_itl_ms", "p99_itl_ms", *THROUGHPUT_ALIASES, *PROMPT_ALIASES]
    doc = F.from_json(F.col(text), ", ".join(f"{n} string" for n in names))
    rows = df.withColumn("__d", doc)
    num = lambda n: F.col("__d")[n].try_cast("double")
    out = {"mean_latency_s": C.ms_to_s(num("mean_e2el_ms")), "latency_p50_s": C.ms_to_s(num("median_e2el_ms")), "latency_p95_s": C.ms_to_s(num("p95_e2el_ms")),
           "prompt_tps": F.coalesce(*[num(a) for a in THROUGHPUT_ALIASES]), "n_prompt": F.coalesce(*[F.col("__d")[a].try_cast("int") for a in PROMPT_ALIASES]),
           "status": F.when(F.coalesce(num("failed"), F.lit(0.0)) == 0, "succeeded").otherwise("completed_with_errors")}
    for m, digits in (("ttft", 3), ("tpot", 4), ("itl", 4)):
        out[f"mean_{m}_s"] = C.ms_to_s(num(f"mean_{m}_ms"), digits)
        out[f"p95_{m}_s"] = C.ms_to_s(F.coalesce(num(f"p95_{m}_ms"), num(f"p99_{m}_ms")), digits)
    return rows.select(*df.columns, *[c.alias(n) for n, c in out.items()])
