"""Column functions: coercion, text and unit clean-up, classification, identity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Word sets, thresholds, unit factors and name tokens of the telemetry formats.
LENIENT_OK = ("1", "true", "yes", "ok")
LENIENT_YES = ("true", "1", "yes")
STRICT_TRUE = ("true", "t", "yes", "y", "1", "on", "warning", "degraded")
STRICT_FALSE = ("false", "f", "no", "n", "0", "off", "", "none", "nan", "healthy", "normal")
FLAG_WORDS = ("1", "true", "yes", "y", "ready", "loaded", "ok", "present")
DATE_FORMATS = ("yyyy/MM/dd HH:mm:ss.SSS", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss")
BYTE_UNITS = {"b": 1, "byte": 1, "bytes": 1, "kib": 1024, "kb": 1024, "mib": 1024 ** 2, "mb": 1024 ** 2,
              "gib": 1024 ** 3, "gb": 1024 ** 3, "tib": 1024 ** 4, "tb": 1024 ** 4}
QUANTITY_MIB = {"": 1 / 1048576, "Ki": 1 / 1024, "Mi": 1, "Gi": 1024, "K": 1 / 1024, "M": 1, "G": 1000}
DMA_ERROR_MASK = 0x4770
FEATURE_EXCLUDED_PREFIXES = ("vmagg._debug.", "vmagg.meta.")
FEATURE_EXCLUDED_TOKENS = (".source", ".status", ".mode")
FEATURE_ROLES = (
    ("storage_context", ("disk_", "filesystem")),
    ("telemetry_quality", ("sample_age", "query_duration", "collector")),
    ("thermal_clock_power_context", ("energy_mj_sum",)),
    ("telemetry_semantic_pending", ("gpu_compute.gpu_util_avg",)),
    ("gpu_load_candidate", ("gpu_util", "gpu_compute.gpu_util", "gpu_pressure", "schedulable_gpu")),
    ("memory_load_candidate", ("fb_used", "vram", "memory.used", "memory_working_set", "mem_used", "ram_capacity", "memcap")),
    ("cpu_load_candidate", ("cpu_usage", "cpu_used", "cpu_cores_rate", "cpu_system", "cpu_user", "load1", "load5", "load15")),
    ("thermal_clock_power_context", ("temp", "clock", "power_watts", "power.draw", "pstate", "thermal_violation", "power_violation")),
    ("service_cluster_context", ("pods_running", "pods_ready", "gpu_pods", "deployments", "workloads")),
)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(_c(c).cast("string"), r"^\s+|\s+$", "")


def _word(c) -> Column:
    return F.lower(strip(c))


def number(c) -> Column:
    """Number, or null where the text is not one (NaN counts as none)."""
    v = _c(c).cast("string").try_cast("double")
    return F.when(~F.isnan(v), v)


def first_number(c) -> Column:
    return F.nullif(F.regexp_extract(_c(c), r"[-+]?\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double")


def strip_unit(c, units: Sequence[str] = ("%", "W", "MiB", "MHz")) -> Column:
    return F.trim(F.regexp_replace(_c(c), r"\s*(?:" + "|".join(units) + r")\s*$", "")).try_cast("double")


def lenient_ok(c) -> Column:
    return F.coalesce(_word(c).isin(*LENIENT_OK), F.lit(False))


def lenient_yes(c) -> Column:
    return F.coalesce(_word(c).isin(*LENIENT_YES), F.lit(False))


def strict_bool(c) -> Column:
    """True or false by word; null is false; any other word stops the job."""
    w = _word(c)
    return F.when(w.isNull() | w.isin(*STRICT_FALSE), F.lit(False)).when(w.isin(*STRICT_TRUE), F.lit(True)) \
        .otherwise(F.raise_error(F.concat(F.lit("cannot parse boolean value: "), w)).cast("boolean"))


def flag(c) -> Column:
    """1 for a flag word or a non-zero number, else 0."""
    w = _word(c)
    return F.when(w.isin(*FLAG_WORDS) | (F.coalesce(w.try_cast("double"), F.lit(0.0)) != 0), 1).otherwise(0)


def local_to_utc(c, zone: str = "Asia/Taipei") -> Column:
    """Zone-less local wall clock to UTC (zone-less)."""
    return F.to_utc_timestamp(_c(c).cast("timestamp"), zone).cast("timestamp_ntz")


def wall_clock(c) -> Column:
    """Timestamp text without its zone: the wall clock is kept as written."""
    bare = F.regexp_replace(F.trim(_c(c)), r"(?:Z|[+-]\d{2}:?\d{2})$", "")
    return bare.try_cast("timestamp_ntz")


def utc_text(c) -> Column:
    """Timestamp text with ``Z`` or an offset (none means UTC) to zone-less UTC. The session zone is UTC."""
    return _c(c).try_cast("timestamp").cast("timestamp_ntz")


def any_date(c, formats: Sequence[str] = DATE_FORMATS) -> Column:
    return F.coalesce(*[F.try_to_timestamp(F.trim(_c(c)), F.lit(f)) for f in formats]).cast("timestamp_ntz")


def run_start_key(run_id) -> Column:
    """Trailing ``YYYYMMDD_HHMMSS`` of a run name, or the name."""
    found = F.regexp_extract(_c(run_id), r"(\d{8}_\d{6})$", 1)
    return F.when(found != "", found).otherwise(_c(run_id))


def cycle_number(name) -> Column:
    return F.nullif(F.regexp_extract(_c(name), r"(?:cycle|_c)_?(\d+)", 1), F.lit("")).try_cast("int")


def offered_rate(name) -> Column:
    return F.nullif(F.regexp_extract(_c(name), r"rps([0-9.]+)_", 1), F.lit("")).try_cast("double")


def first_filled(*cols) -> Column:
    """First value that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(_c(c)), F.lit("")) for c in cols])


def pick_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """The first candidate that exists, compared as written and then trimmed."""
    trimmed = {c.strip(): c for c in reversed(columns)}
    return next((c if c in columns else trimmed[c.strip()] for c in candidates if c in columns or c.strip() in trimmed), None)


def pick_by_keywords(columns: Sequence[str], keywords: Sequence[str], exclude: Sequence[str] = ()) -> str | None:
    """The first column whose name holds every keyword and no excluded word."""
    return next((c for c in columns if all(k.lower() in c.lower() for k in keywords)
                 and not any(e.lower() in c.lower() for e in exclude)), None)


def normalise_headers(df: DataFrame, mapping: Mapping[str, Sequence[str]], keep: Sequence[str] = ()) -> DataFrame:
    """Canonical columns from the first header variant present, as the first number in each cell."""
    found = {name: pick_column(df.columns, choices) for name, choices in mapping.items()}
    return df.select(*keep, *[first_number(F.col(f"`{c}`").cast("string")).alias(n) for n, c in found.items() if c])


def failure_class(status, message) -> Column:
    code, msg = F.coalesce(_c(status).cast("string").try_cast("int"), F.lit(0)), F.lower(F.coalesce(_c(message), F.lit("")))
    has = lambda *words: reduce(lambda a, b: a | b, [msg.contains(w) for w in words])
    text = F.when(has("connecttimeout", "connect timeout"), "connect_timeout") \
        .when(has("readtimeout", "read timeout", "timed out", "timeout"), "read_timeout") \
        .when(has("remote disconnected"), "remote_disconnected").when(has("connectionerror", "connection aborted"), "connection_error") \
        .when(has("connection refused"), "connection_refused").otherwise("client_transport_error")
    return F.when(code.between(200, 299), "none").when(code == 0, text).when(code.between(500, 599), "server_5xx") \
        .when(code.between(400, 499), "client_4xx").otherwise("http_error")


def client_error(kind, reason) -> Column:
    """Class of a client exception from its type name and reason text."""
    k, r = _c(kind), F.lower(F.coalesce(_c(reason), F.lit("")))
    return F.when(k == "ConnectTimeout", "connect_timeout").when(k == "ReadTimeout", "read_timeout").when(k == "Timeout", "timeout") \
        .when(k == "ConnectionError", "connection_error").when(k == "HTTPError", "http_error") \
        .when(k.isin("URLError", "TimeoutError"), F.when((k == "TimeoutError") | r.contains("timed out") | r.contains("timeout"), "timeout")
              .otherwise("url_error")).otherwise(k)


def feature_role(name) -> Column:
    low = F.lower(_c(name))
    out = F.lit("other_numeric_candidate")
    for role, tokens in reversed(FEATURE_ROLES):
        out = F.when(reduce(lambda a, b: a | b, [low.contains(x) for x in tokens]), role).otherwise(out)
    internal = reduce(lambda a, b: a | b, [low.startswith(x) for x in FEATURE_EXCLUDED_PREFIXES]
                      + [low.contains(x) for x in FEATURE_EXCLUDED_TOKENS])
    return F.when(internal, "metadata_or_debug").otherwise(out)


def feature_decision(role, missing_rate, unique_count, std) -> Column:
    r = _c(role)
    return F.when(r.isin("metadata_or_debug", "telemetry_quality", "telemetry_semantic_pending"), "exclude_primary_feature") \
        .when(r.isin("thermal_clock_power_context", "storage_context"), "target_or_context_not_external_load") \
        .when(_c(missing_rate) > 0.2, "exclude_missing") \
        .when((_c(unique_count) <= 1) | _c(std).isNull() | (_c(std) == 0), "exclude_constant") \
        .when(r.isin("gpu_load_candidate", "memory_load_candidate", "cpu_load_candidate"), "candidate_load_feature") \
        .otherwise("candidate_context_feature")


def sample_state(ready, health_ok, compute_ok, compute_ms, degraded_ms: float = 1000.0, timeout_ms: float = 2000.0) -> tuple[Column, Column]:
    """State and reason of one availability sample."""
    reason = F.when(~_c(ready), "node_not_ready").when(~_c(health_ok), "sentinel_unreachable").when(~_c(compute_ok), "compute_check_failed") \
        .when(_c(compute_ms) >= timeout_ms, "compute_check_timeout").when(_c(compute_ms) >= degraded_ms, "compute_latency_high").otherwise("")
    return F.when(reason == "node_not_ready", "DOWN").when(reason != "", "DEGRADED").otherwise("UP"), reason


def clamp_percent(c) -> Column:
    return F.least(F.greatest(F.coalesce(_c(c), F.lit(0.0)), F.lit(0.0)), F.lit(100.0))


def node_health(role, known, cpu, mem, disk, source, gpu_status) -> Column:
    """Health of a node from its status; ``known`` says whether there is a status at all."""
    silent = _c(cpu).isNull() & _c(mem).isNull() & _c(disk).isNull()
    error = silent | (F.lower(F.coalesce(_c(source), F.lit(""))) == "error") | F.lower(F.coalesce(_c(gpu_status), F.lit(""))).contains("error")
    external = ~F.coalesce(_c(role), F.lit("")).isin("", "control-plane", "worker")
    hot = F.greatest(clamp_percent(cpu), clamp_percent(mem), clamp_percent(disk)) >= 90
    return F.when(~_c(known) | (external & error), "offline").when(error | hot, "degraded").otherwise("healthy")


def gpu_mode(standard, shared) -> Column:
    s, h = _c(standard) > 0, _c(shared) > 0
    return F.when(s & h, "mixed").when(h, "shared").when(s, "standard").otherwise("none")


def benchmark_kind(prompt, generated) -> Column:
    p, g = F.coalesce(_c(prompt), F.lit(0)), F.coalesce(_c(generated), F.lit(0))
    return F.when((p > 0) & (g == 0), "pp").when((p == 0) & (g > 0), "tg").when((p > 0) & (g > 0), "pg")


def leaves(schema: T.StructType, numeric_only: bool = False, prefix: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.DataType]]:
    """Paths of a schema's leaf fields; lists are leaves."""
    out = []
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            out += leaves(f.dataType, numeric_only, (*prefix, f.name))
        elif not numeric_only or isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            out.append(((*prefix, f.name), f.dataType))
    return out


def _at(path: Sequence[str]) -> Column:
    return reduce(lambda c, p: c.getField(p), path[1:], F.col(f"`{path[0]}`"))


def flatten(df: DataFrame, separator: str = ".", numeric_only: bool = False) -> DataFrame:
    """One column per leaf of the nested columns; lists stay as JSON text; ``numeric_only`` turns booleans to 0/1."""
    out = []
    for path, kind in leaves(df.schema, numeric_only):
        c = _at(path)
        if isinstance(kind, (T.ArrayType, T.MapType)):
            c = F.to_json(c)
        elif numeric_only and isinstance(kind, T.BooleanType):
            c = c.cast("int")
        out.append(c.alias(separator.join(path)))
    return df.select(*out)


def flatten_indexed(df: DataFrame, keys: Sequence[str], items: str, fields: Sequence[str]) -> DataFrame:
    """Long form of a list of structs: (keys, ``items[i].field``, value as text)."""
    rows = df.select(*keys, F.posexplode(items).alias("__i", "__e"))
    return rows.select(*keys, F.explode(F.array(*[F.struct(
        F.concat(F.lit(f"{items}["), F.col("__i").cast("string"), F.lit(f"].{f}")).alias("name"),
        F.col("__e")[f].cast("string").alias("value")) for f in fields])).alias("__f")).select(*keys, "__f.*")


def path_get(document, path: str, default=None) -> Column:
    return F.coalesce(F.get_json_object(_c(document), f"$.{path}"), F.lit(default))


def without_nulls(value: Column, kind: T.DataType) -> Column:
    """A typed value without the nulls in its lists and maps, at any depth; null fields of structs stay (JSON text leaves them out)."""
    if isinstance(kind, T.ArrayType):
        return F.filter(F.transform(value, lambda x: without_nulls(x, kind.elementType)), lambda x: x.isNotNull())
    if isinstance(kind, T.MapType):
        return F.map_filter(F.transform_values(value, lambda _, x: without_nulls(x, kind.valueType)), lambda _, x: x.isNotNull())
    if isinstance(kind, T.StructType) and any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) for f in kind.fields):
        return F.when(value.isNotNull(), F.struct(*[without_nulls(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    return value


def prune(document, kind: T.DataType | None = None) -> Column:
    """JSON text of a struct without its null fields; with its type also without the nulls inside its lists and maps."""
    return F.to_json(_c(document) if kind is None else without_nulls(_c(document), kind))


def usable_columns(df: DataFrame, drop_prefixes: Sequence[str] = (), drop_exact: Sequence[str] = ()) -> list[str]:
    """Columns that hold at least one number, apart from the named ones: one aggregation decides for all."""
    names = [c for c in df.columns if c not in drop_exact and not c.startswith(tuple(drop_prefixes) or ("\0",))]
    seen = df.agg(*[F.count(F.col(f"`{c}`").cast("string").try_cast("double")).alias(f"n{i}") for i, c in enumerate(names)]).first()
    return [c for c, n in zip(names, seen) if n]


def shorten(name: str, replacements: Sequence[tuple[str, str]]) -> str:
    for old, new in replacements:
        name = name.replace(old, new)
    return name


def to_bytes(value, unit) -> Column:
    """Value in bytes; rates lose their ``/s``; an unknown unit counts as bytes."""
    u = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(_c(unit), F.lit("")))), "/s", ""), "per second", ""))
    factor = F.create_map(*[F.lit(x) for k, v in BYTE_UNITS.items() for x in (k, float(v))])
    return _c(value).cast("double") * F.coalesce(F.try_element_at(factor, u), F.lit(1.0))


def mib_to_bytes(c) -> Column:
    return (_c(c).cast("double") * 1048576).cast("bigint")


def bytes_to_mib(c) -> Column:
    return _c(c).cast("double") / 1048576


def percent(c) -> Column:
    """Percent, reading values between 0 and 1 as ratios."""
    v = _c(c).cast("double")
    return F.when(v.between(0, 1), v * 100).otherwise(v)


def cpu_used(idle, dims: Sequence) -> Column:
    """100 - idle, else the sum of the busy dimensions, clamped to 0..100; null when nothing is known."""
    known = reduce(lambda a, b: a | b, [_c(d).isNotNull() for d in dims])
    total = reduce(lambda a, b: a + b, [F.coalesce(_c(d), F.lit(0.0)) for d in dims])
    used = F.when(_c(idle).isNotNull(), 100.0 - _c(idle)).when(known, total)
    return F.when(used.isNotNull(), F.least(F.greatest(used, F.lit(0.0)), F.lit(100.0)))


def ram_percent(used, free, cached, buffers) -> Column:
    total = _c(free) + _c(used) + F.coalesce(_c(cached), F.lit(0.0)) + F.coalesce(_c(buffers), F.lit(0.0))
    return F.when(total > 0, _c(used) / total * 100.0)


def guarded_ratio(part, whole, scale: float = 1.0) -> Column:
    return F.when(_c(whole) > 0, _c(part) / _c(whole) * scale)


def salted_id(value, salt: str) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", F.lit(salt), F.lower(_c(value))), 256), 1, 12)


def compact_text(c, limit: int = 140) -> Column:
    """Whitespace collapsed; a longer text is shortened to end in ``...``."""
    text = F.trim(F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"\s+", " "))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 3), F.lit("...")))


def metric_hint(c) -> Column:
    return F.regexp_extract(F.coalesce(_c(c), F.lit("")), r"([A-Za-z_:][A-Za-z0-9_:]*)\s*(?:\{|$|\[)", 1)


def range_windows(c) -> Column:
    """Range windows (``5m``, ``30s``) of a query text, in order, joined by commas."""
    return F.array_join(F.regexp_extract_all(_c(c), F.lit(r"\[(\d+[smhd])"), F.lit(1)), ",")


def profile_key(parts: Mapping[str, Column]) -> Column:
    return F.concat_ws("|", *[F.concat(F.lit(f"{n}="), F.coalesce(c.cast("string"), F.lit("nan"))) for n, c in parts.items()])


def cycle_uid(run_id, cycle) -> Column:
    return F.concat(_c(run_id).cast("string"), F.lit("_c"), F.coalesce(_c(cycle).cast("int"), F.lit(-1)).cast("string"))


def alias_value(record, names: Sequence[str], kind: str = "double") -> Column:
    """First alias present in a map or struct of text values."""
    return F.coalesce(*[_c(record)[n].cast(kind) for n in names])


def ms_to_s(c, digits: int = 3) -> Column:
    return F.round(_c(c).cast("double") / 1000.0, digits)


def dma_state(control, status) -> Column:
    """State of a transfer channel from its control and status registers."""
    error = _c(status).bitwiseAND(DMA_ERROR_MASK) != 0
    running, halted = _c(control).bitwiseAND(1) != 0, _c(status).bitwiseAND(1) != 0
    return F.when(error, "error").when(running & ~halted, "ready").otherwise("degraded")


def plausible_celsius(milli) -> Column:
    v = _c(milli) / 1000.0
    return F.when(v.between(0, 125), v)


def quantity_mib(c) -> Column:
    """Memory quantity text (``512Mi``) in whole MiB; 0 where it is not one."""
    text = F.trim(_c(c))
    size, unit = F.regexp_extract(text, r"^(\d+)([KMG]i?)?$", 1), F.regexp_extract(text, r"^(\d+)([KMG]i?)?$", 2)
    factor = F.create_map(*[F.lit(x) for k, v in QUANTITY_MIB.items() for x in (k, float(v))])
    return F.coalesce(F.floor(size.try_cast("double") * F.try_element_at(factor, unit)), F.lit(0)).cast("bigint")
