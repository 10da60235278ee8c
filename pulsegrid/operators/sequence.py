"""Sequence detection on ordered rows: rolling statistics, islands, onsets, outages, baselines."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .align import interval_join, last_event
from .grid import ratio
from .grouped import map_groups
from .keys import col, cut, join_on, keyed, spare
from .ordered import BLOCK, blocked, core, fill, framed, lagged, numbered, running
from .quantiles import average_rank, quantiles, summarise, top_share_median

FRAME = 512


def rolling(df: DataFrame, by: Sequence[str], order: Sequence[str], specs: Mapping[str, tuple[str, str, int, int]], *,
            width, **kw) -> DataFrame:
    """Trailing row windows: name -> (column, mean|median|std|sum|min|max, rows, minimum non-null values)."""
    def exprs(w):
        out = {}
        for name, (c, how, n, least) in specs.items():
            frame = w.rowsBetween(1 - n, 0)
            value = {"mean": F.avg(c), "median": F.percentile(c, F.lit(0.5)), "std": F.stddev_samp(c), "sum": F.sum(c),
                     "min": F.min(c), "max": F.max(c)}[how].over(frame)
            out[name] = F.when(F.count(c).over(frame) >= least, value)
        return out
    return framed(df, by, order, exprs, before=max(n for *_, n, _ in specs.values()) - 1, width=width, **kw)


def lags_and_slopes(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, lags: Sequence[int],
                    slopes: Sequence[int], *, width, per_row: bool = False, **kw) -> DataFrame:
    """``value_lag_k`` and ``value_slope_k`` (difference to k rows before, divided by k if ``per_row``)."""
    def exprs(w):
        out = {f"{value}_lag_{k}": F.lag(value, k).over(w) for k in lags}
        for k in slopes:
            step = F.col(value) - F.lag(value, k).over(w)
            out[f"{value}_slope_{k}"] = step / float(k) if per_row else step
        return out
    return framed(df, by, order, exprs, before=max([*lags, *slopes]), width=width, **kw)


def exponential_mean(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str, span: int = 15, *,
                     width, block: int = 20_000) -> DataFrame:
    """Exponentially weighted mean without bias correction; nulls keep the last mean and age it.

    The weight of a value falls below double precision after ``reach`` observations, so each block of
    rows is computed on its own from that many rows before it.
    """
    df, keys = keyed(df, by)
    decay = 1 - 2 / (span + 1)
    reach = math.ceil(45 / -math.log(decay))
    placed = numbered(df, keys, order, "__pos", width=width)
    seen = placed.filter(F.col(value).isNotNull())
    seen = fill(seen, keys, order, {"__before": "__pos"}, width=width, strict=True)
    seen = seen.select(*keys, "__pos", F.least(F.col("__pos") - F.coalesce(F.col("__before"), F.col("__pos") - 1),
                                               F.lit(reach)).alias("__gap"), F.col(value).cast("double").alias("__v"), *[c for c in order if c not in keys])
    near = blocked(seen, keys, order, "__rn", before=reach, after=0, width=width, block=block)

    def smooth(rn, pos, gap, value, blk):
        import numpy as np
        import pandas as pd
        at = np.cumsum(gap)
        full = pd.Series(np.nan, index=np.arange(at[0], at[-1] + 1))
        full.loc[at] = value
        own = (rn - 1) // block == blk
        return pos[own], full.ewm(span=span, adjust=False).mean().loc[at].to_numpy()[own]

    means = map_groups(near, [*keys, BLOCK], ["__rn"], ["__rn", "__pos", "__gap", "__v", BLOCK], smooth,
                       [T.StructField("__pos", T.LongType()), T.StructField(name, T.DoubleType())]).drop(BLOCK)
    out = join_on(placed, means, [*keys, "__pos"], "left")
    out = fill(out, keys, order, {name: name}, width=width)
    return out.drop("__pos", *spare(by))


def forecast_frame(df: DataFrame, by: Sequence[str], order: Sequence[str], target: str, horizon: int, *, width,
                   window: int = 15, least: int = 5, **kw) -> DataFrame:
    """Add the value ``horizon`` rows ahead and two baselines for it: the current value and a rolling median."""
    def exprs(w):
        frame = w.rowsBetween(1 - window, 0)
        return {"future": F.lead(target, horizon).over(w), "persistence": F.col(target),
                "rolling_median": F.when(F.count(target).over(frame) >= least, F.percentile(target, F.lit(0.5)).over(frame))}
    return framed(df, by, order, exprs, before=window - 1, after=horizon, width=width, **kw)


def sustained(df: DataFrame, by: Sequence[str], order: Sequence[str], flag: str, name: str, *, width, window: int = 15,
              bad: int = 5, least: int | None = None, **kw) -> DataFrame:
    """At least ``bad`` true rows among the last ``window``; false until ``least`` (default ``bad``) rows exist."""
    least = bad if least is None else least
    on = F.coalesce(F.col(flag), F.lit(False)).cast("int")

    def exprs(w):
        frame = w.rowsBetween(1 - window, 0)
        return {name: (F.sum(on).over(frame) >= bad) & (F.count(F.lit(1)).over(frame) >= least)}
    return framed(df, by, order, exprs, before=window - 1, width=width, **kw)


def future_label(df: DataFrame, by: Sequence[str], order: Sequence[str], flag: str, name: str, horizon: int, *, width,
                 include_now: bool = True, **kw) -> DataFrame:
    """Whether the flag is true within the next ``horizon`` rows. Rows whose horizon passes the end are false."""
    on = F.coalesce(F.col(flag), F.lit(False)).cast("int")

    def exprs(w):
        first, gate = (0, horizon) if include_now else (1, horizon - 1)
        whole = F.lead(F.lit(1), gate).over(w).isNotNull() if gate else F.lit(True)
        return {name: whole & (F.coalesce(F.max(on).over(w.rowsBetween(first, horizon)), F.lit(0)) == 1)}
    return framed(df, by, order, exprs, after=horizon, width=width, **kw)


def first_sustained(df: DataFrame, by: Sequence[str], order: Sequence[str], flags: Mapping[str, Column], *, width,
                    k: int = 5, **kw) -> DataFrame:
    """Per key and flag: the time of the first row that ends ``k`` consecutive true rows, minus k - 1."""
    base = df.select(*by, *order, *[F.coalesce(c, F.lit(False)).cast("int").alias(f"__f_{n}") for n, c in flags.items()])

    def exprs(w):
        frame = w.rowsBetween(1 - k, 0)
        return {f"__h_{n}": F.sum(f"__f_{n}").over(frame) >= k for n in flags}
    hits = framed(base, by, order, exprs, before=k - 1, width=width, **kw)
    return hits.groupBy(*by).agg(*[(F.min(F.when(F.col(f"__h_{n}"), F.col(order[0]))) - (k - 1)).alias(n) for n in flags])


def islands(df: DataFrame, by: Sequence[str], order: Sequence[str], flag: str, *, width) -> DataFrame:
    """Maximal runs of true rows: (key, start, end, rows). Only a false row ends a run, never a time gap."""
    on = F.coalesce(F.col(flag), F.lit(False))
    t = order[0]
    keyed_rows = running(df.select(*by, *order, on.alias("__on")), by, order, {"__false": (~F.col("__on")).cast("int")}, width=width)
    return keyed_rows.filter("__on").groupBy(*by, "__false").agg(
        F.min(t).alias("start"), F.max(t).alias("end"), F.count(F.lit(1)).alias("rows")).drop("__false")


def episodes(df: DataFrame, by: Sequence[str], order: Sequence[str], flag: str, *, width, min_duration=3, refractory=5,
             eligible: str | None = None, unit: float = 1) -> DataFrame:
    """Debounced episodes: short runs are dropped first, then runs starting within ``refractory`` of the
    previous end are merged. Durations count both ends; ``unit`` is one time step of ``order[0]``."""
    if eligible:
        df = df.withColumn(flag, F.col(flag) & F.col(eligible))
    runs = cut(islands(df, by, order, flag, width=width).filter(F.col("end") - F.col("start") + unit >= min_duration))
    prev = fill(runs, by, ["start"], {"__pe": "end"}, width=width, strict=True, keep_slice=True)
    fresh = (F.col("__pe").isNull() | (F.col("start") - F.col("__pe") > refractory)).cast("int")
    grouped = running(prev.withColumn("__new", fresh), by, ["start"], {"__ep": "__new"}, width=width)
    return grouped.groupBy(*by, "__ep").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__ep")


def episode_summary(df: DataFrame, by: Sequence[str], order: Sequence[str], flag: str, *, width, unit: float = 1,
                    text: bool = False, **kw) -> DataFrame:
    """One row per key, keys without episodes included. ``text`` adds the ``start-end`` list of the key."""
    on = F.coalesce(F.col(flag), F.lit(False))
    rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("scored_rows"), F.sum(on.cast("bigint")).alias("exceedances"))
    ep = episodes(df, by, order, flag, width=width, unit=unit, **kw)
    length = F.col("end") - F.col("start") + unit
    aggs = [F.count(F.lit(1)).alias("episode_count"), F.sum(length).alias("total_duration"), F.max(length).alias("max_duration")]
    if text:
        aggs.append(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end"))), lambda e: F.concat_ws(
            "-", e["start"].cast("string"), e["end"].cast("string"))), ";").alias("episodes"))
    out = join_on(rows, ep.groupBy(*by).agg(*aggs), by, "left").fillna(0, ["episode_count", "total_duration", "max_duration"])
    return out.fillna("", ["episodes"]) if text else out


def longest_segment(df: DataFrame, by: Sequence[str], order: Sequence[str], stable: str, *, width) -> DataFrame:
    """The longest run of stable rows per key; among equals the earliest."""
    runs = islands(df, by, order, stable, width=width)
    best = F.max_by(F.struct("start", "end", "rows"), F.struct(F.col("rows"), -F.col("start")))
    return runs.groupBy(*by).agg(best.alias("__b")).select(*by, "__b.*")


def change_points(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, *, width) -> DataFrame:
    """Rows at which the value differs from the row before (the first row counts)."""
    rows = df.filter(F.col(value).isNotNull() & F.col(order[0]).isNotNull())
    prev = fill(rows, by, order, {"__pv": value}, width=width, strict=True)
    return prev.filter(F.col("__pv").isNull() | (F.col("__pv") != F.col(value))).drop("__pv")


def onsets(df: DataFrame, by: Sequence[str], order: Sequence[str], flag: str, *, width, min_runin=1) -> DataFrame:
    """False-to-true changes after a healthy stretch of at least ``min_runin``; a first row is never an onset.

    The rows with equal counts of true rows before them are one healthy stretch and the true row that ends it.
    """
    t = order[0]
    on = F.coalesce(F.col(flag), F.lit(False))
    rows = running(df.select(*by, *order, on.alias("__on")), by, order, {"__true": F.col("__on").cast("int")}, width=width)
    rows = rows.withColumn("__g", F.col("__true") - F.col("__on").cast("int"))
    out = rows.groupBy(*by, "__g").agg(F.max(F.when(F.col("__on"), F.col(t))).alias("onset"),
                                       F.min(F.when(~F.col("__on"), F.col(t))).alias("__since"))
    runin = F.col("onset") - F.col("__since")
    return out.filter(runin >= min_runin).select(*by, "onset", runin.alias("healthy_runin"))


def debounce(df: DataFrame, by: Sequence[str], t: str, flag: str, refractory, *, width=None, carry: Sequence[str] = ()) -> DataFrame:
    """Keep an alert only if it comes at least ``refractory`` after the last *kept* one.

    What a slice of time keeps depends on earlier slices only through the first moment at which an alert
    may be kept again, and that moment lies less than ``refractory`` into the slice. Pass 1 gives, per
    slice, the moment it hands on for each moment it may receive (a few ranges); pass 2 chains these per
    key; pass 3 marks the kept alerts slice by slice. No task holds the alerts of a key.
    """
    import pandas as pd

    width = float(width or 1000 * refractory)
    if width < refractory:
        raise ValueError("a slice must be at least as long as the refractory time")
    alerts = df.filter(F.coalesce(F.col(flag), F.lit(False)) & F.col(t).isNotNull()).groupBy(*by, t).agg(
        F.count(F.lit(1)).alias("__n"), *[F.min(c).alias(c) for c in carry]).drop("__n")
    alerts = alerts.withColumn("__slice", F.floor(F.col(t) / width).cast("bigint"))
    alerts = cut(alerts)
    moment = T.DoubleType()

    def jumps(times):
        import numpy as np
        return np.searchsorted(times, times + refractory, side="left")

    def transitions(times, part):
        import numpy as np
        times = times.astype("float64")
        nxt = jumps(times)
        last = np.where(nxt < len(times), nxt, np.arange(len(times)))
        while not np.array_equal(last, last[last]):
            last = last[last]
        reach = min(len(times), int(np.searchsorted(times, part[0] * width + refractory, side="left")) + 1)
        exits = times[last[:reach]] + refractory
        edge = np.append(exits[1:] != exits[:-1], True)
        return times[:reach][edge], exits[edge]

    steps = map_groups(alerts, [*by, "__slice"], [t], [t, "__slice"], transitions,
                       [T.StructField("__upto", moment), T.StructField("__exit", moment)])

    def chain(part, upto, leave):
        import numpy as np
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        free, entry = -math.inf, []
        for a, z in zip(first, np.append(first[1:], len(part))):
            entry.append(free)
            i = a + int(np.searchsorted(upto[a:z], free, side="left"))
            if i < z:
                free = float(leave[i])
        return part[first], np.array(entry)

    entry = map_groups(steps, by, ["__slice", "__upto"], ["__slice", "__upto", "__exit"], chain,
                       [T.StructField("__slice", T.LongType()), T.StructField("__free", moment)])
    rows = join_on(alerts, entry, [*by, "__slice"])

    def mark(times, free, *others):
        import numpy as np
        at = times.astype("float64")
        nxt, kept = jumps(at), []
        i = int(np.searchsorted(at, free[0], side="left"))
        while i < len(at):
            kept.append(i)
            i = int(nxt[i])
        return [c[kept] for c in (times, *others)]

    return map_groups(rows, [*by, "__slice"], [t], [t, "__free", *carry], mark, [rows.schema[c] for c in (t, *carry)]).drop("__slice")


def match_alerts(onset_rows: DataFrame, alerts: DataFrame, by: Sequence[str], onset: str, alert: str, min_lead, max_lead, *,
                 width) -> DataFrame:
    """Give each onset, in order, the earliest unused alert in ``[onset - max_lead, onset - min_lead]``.

    Alerts of a key have distinct times, as debounced ones do. Onsets are cut into slices of time, and a
    slice depends on those before it only through the last alert they used. As in ``debounce``, pass 1
    gives the last alert a slice hands on for each it may receive, pass 2 chains the slices of a key, and
    pass 3 matches slice by slice.
    """
    width = float(max(width, max_lead))
    onset_rows, alerts = cut(onset_rows.select(*by, onset)), alerts.select(*by, alert).distinct()
    cell = lambda c: F.floor(c / width).cast("bigint")
    starts = onset_rows.select(*by, cell(F.col(onset)).alias("__slice"), F.col(onset).cast("double").alias("__t"), F.lit(1).alias("__side"))
    near = alerts.select(*by, F.explode(F.sequence(cell(F.col(alert) + min_lead), cell(F.col(alert) + max_lead))).alias("__slice"),
                         F.col(alert).cast("double").alias("__t"), F.lit(0).alias("__side"))
    near = join_on(near, starts.select(*by, "__slice").distinct(), [*by, "__slice"], "left_semi")
    both = cut(starts.unionByName(near))
    moment = T.DoubleType()

    def reach(times, side):
        import numpy as np
        warn, start = times[side == 0], times[side == 1]
        return (warn, start, np.searchsorted(warn, start - max_lead, side="left"), np.searchsorted(warn, start - min_lead, side="right"))

    def transitions(times, side, part):
        import numpy as np
        warn, start, low, high = reach(times, side)
        # Earlier slices can have used alerts up to this slice's first possible one only.
        k = int(np.searchsorted(warn, part[0] * width - min_lead, side="right"))
        free, place = np.arange(k + 1), np.arange(k + 1)
        for i in range(len(start)):
            j = np.maximum(free, low[i])
            free = np.where(j < high[i], j + 1, free)
            if i % 32 == 31:  # states that have met stay together
                free, back = np.unique(free, return_inverse=True)
                place = back[place]
        padded = np.append(-np.inf, warn)
        leave = padded[free[place]]
        edge = np.append(True, leave[1:] != leave[:-1])
        return padded[:k + 1][edge], leave[edge]

    steps = map_groups(both, [*by, "__slice"], ["__t", "__side"], ["__t", "__side", "__slice"], transitions,
                       [T.StructField("__from", moment), T.StructField("__exit", moment)])

    def chain(part, since, leave):
        import numpy as np
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        used, entry = -math.inf, []
        for a, z in zip(first, np.append(first[1:], len(part))):
            entry.append(used)
            used = max(used, float(leave[a + int(np.searchsorted(since[a:z], used, side="right")) - 1]))
        return part[first], np.array(entry)

    entry = map_groups(steps, by, ["__slice", "__from"], ["__slice", "__from", "__exit"], chain,
                       [T.StructField("__slice", T.LongType()), T.StructField("__used", moment)])

    def greedy(times, side, used):
        import numpy as np
        warn, start, low, high = reach(times, side)
        free, got = int(np.searchsorted(warn, used[0], side="right")), np.full(len(start), np.nan)
        for i in range(len(start)):
            j = max(free, low[i])
            if j < high[i]:
                got[i], free = warn[j], j + 1
        return start, got

    rows = join_on(both, entry, [*by, "__slice"])
    out = map_groups(rows, [*by, "__slice"], ["__t", "__side"], ["__t", "__side", "__used"], greedy,
                     [T.StructField("onset", moment), T.StructField("alert", moment)])
    found = ~F.isnan("alert") & F.col("alert").isNotNull()
    return out.select(*by, "onset", F.when(found, F.col("alert")).alias("alert"), found.alias("detected"),
                      F.when(found, F.col("onset") - F.col("alert")).alias("lead"))


def event_metrics(matches: DataFrame, alerts: DataFrame, healthy: DataFrame, by: Sequence[str], t: str, alert: str,
                  healthy_flag: str, hours: float = 3600.0) -> DataFrame:
    """Recall, precision, false alarms per healthy hour and lead-time statistics over all runs.

    ``alerts`` carries ``healthy_flag``: whether the alert fell on a healthy row.
    """
    m, _ = keyed(summarise(matches, [], {
        "events": F.count(F.lit(1)), "recall": F.avg(F.col("detected").cast("double")), "__used": F.count("alert")},
        {"lead_median": ("lead", .5), "__q1": ("lead", .25), "__q3": ("lead", .75)}), [])
    used = matches.filter("detected").select(*by, F.col("alert").alias("__at")).distinct()
    left = alerts.withColumn("__at", F.col(alert).cast("double"))
    false = join_on(left.filter(F.col(healthy_flag)), used, [*by, "__at"], "left_anti").agg(F.count(F.lit(1)).alias("__false"))
    totals = alerts.agg(F.count(F.lit(1)).alias("alerts"), F.sum(F.col(healthy_flag).cast("bigint")).alias("__healthy_alerts"))
    spans = healthy.groupBy(*by).agg((F.max(t) - F.min(t)).alias("__s")).agg(
        F.greatest(F.coalesce(F.sum("__s"), F.lit(0)) / hours, F.lit(1e-9)).alias("healthy_hours"))
    for extra in (false, totals, spans):
        m = join_on(m, keyed(extra, [])[0], ["__all"])
    return m.select("events", F.coalesce("recall", F.lit(0.0)).alias("recall"), (1 - F.coalesce("recall", F.lit(0.0))).alias("missed_rate"),
                    (F.col("__false") / F.col("healthy_hours")).alias("false_alarms_per_hour"),
                    (F.col("__used") / F.greatest(F.col("__healthy_alerts"), F.lit(1))).alias("precision"), "lead_median",
                    (F.col("__q3") - F.col("__q1")).alias("lead_iqr"), "healthy_hours", "alerts")


def failure_streaks(df: DataFrame, by: Sequence[str], order: Sequence[str], failed: str, name: str, *, width) -> DataFrame:
    """Number of failures in a row up to and including each row; a good row resets it to 0."""
    counted = running(df, by, order, {"__n": F.lit(1)}, width=width, keep_slice=True)
    reset = fill(counted, by, order, {"__ok": F.when(~F.col(failed), F.col("__n"))}, width=width)
    return reset.withColumn(name, F.col("__n") - F.coalesce("__ok", F.lit(0))).drop("__n", "__ok")


def confirmed(sample_state: Column, sample_reason: Column, streak: Column, confirm: int = 3) -> tuple[Column, Column, Column]:
    """Effective state, its reason and whether the anomaly is transient, from a sample and its failure streak."""
    lost = sample_reason == "sentinel_unreachable"
    state = F.when(sample_reason == "node_not_ready", "DOWN").when(lost & (streak >= confirm), "DOWN") \
        .when(lost | (sample_state == "DEGRADED"), "DEGRADED").otherwise("UP")
    reason = F.when(sample_reason == "node_not_ready", sample_reason).when(lost & (streak >= confirm), "sentinel_confirmed_outage") \
        .when(lost | (sample_state == "DEGRADED"), sample_reason).otherwise("")
    return state, reason, F.coalesce(lost & (streak < confirm), F.lit(False))


def outages(df: DataFrame, by: Sequence[str], t: str, instance: str, failed: str, *, width, window: int = 5, min_instances: int = 2,
            min_failures: int = 2, merge_gap: float = 5, buffer: float = 10, step: float = 1, kind: str | None = None) -> DataFrame:
    """Outage windows from failures of several instances.

    A grid time is a candidate when the failures within the ``window`` steps that end at it (both ends
    closed) come from enough instances. Each failure is sent to the at most ``window`` grid times it
    serves. ``t`` is numeric; ``step`` is the grid step and unit of ``window``, ``merge_gap``, ``buffer``.
    """
    df, keys = keyed(df, by)
    x = F.col(t) / F.lit(float(step))
    bounds = df.groupBy(*keys).agg(F.ceil(F.max(x)).alias("__last"))
    bad = df.filter(F.coalesce(F.col(failed), F.lit(False)))
    served = bad.withColumn("__x", x).select(
        *keys, instance, "__x", F.explode(F.sequence(F.ceil("__x"), F.floor(F.col("__x") + (window - 1)))).alias("__t")) \
        if window > 1 else bad.withColumn("__x", x).filter(F.ceil("__x") == F.col("__x")).select(*keys, instance, "__x", F.ceil("__x").alias("__t"))
    seconds = served.groupBy(*keys, "__t").agg(F.count_distinct(instance).alias("__i"), F.count(F.lit(1)).alias("__n")) \
        .filter((F.col("__i") >= min_instances) & (F.col("__n") >= min_failures))
    seconds = join_on(seconds, bounds, keys).filter(F.col("__t") <= F.col("__last")).select(*keys, "__t")
    seconds = cut(seconds)
    prev = fill(seconds, keys, ["__t"], {"__p": "__t"}, width=width, strict=True, keep_slice=True)
    fresh = (F.col("__p").isNull() | (F.col("__t") - F.col("__p") > merge_gap)).cast("int")
    grouped = running(prev.withColumn("__new", fresh), keys, ["__t"], {"outage_no": "__new"}, width=width)
    win = grouped.groupBy(*keys, "outage_no").agg((F.min("__t") - (window - 1)).alias("core_start"), F.max("__t").alias("core_end"))
    win = cut(win)
    kinds = [kind] if kind else []
    inside = interval_join(bad.withColumn("__x", x).select(*keys, instance, "__x", *kinds), win, "__x", "core_start", "core_end", keys,
                           bucket=width, closed="both", how="inner", payload=["outage_no"])
    stats = inside.groupBy(*keys, "outage_no").agg(
        F.count_distinct(instance).alias("failed_instances"), F.count(F.lit(1)).alias("failure_count"),
        *[F.array_join(F.array_sort(F.collect_set(k)), ",").alias("failure_types") for k in kinds])
    out = join_on(win, stats, [*keys, "outage_no"]).withColumn("expanded_start", F.col("core_start") - buffer) \
        .withColumn("expanded_end", F.col("core_end") + buffer).withColumn("duration", F.col("core_end") - F.col("core_start"))
    return out if by else out.drop("__all")


def clean_segments(df: DataFrame, windows: DataFrame, by: Sequence[str], t: str, start: str, end: str, *, width, min_length=60) -> DataFrame:
    """What is left of each run outside the merged windows, if at least ``min_length`` long."""
    runs = df.groupBy(*by).agg(F.min(t).cast("double").alias("__a"), F.max(t).cast("double").alias("__z"))
    w = windows.select(*by, F.col(start).cast("double").alias("__s"), F.col(end).cast("double").alias("__e"))
    high = running(w, by, ["__s", "__e"], maxima={"__m": "__e"}, width=width, strict=True, keep_slice=True)
    fresh = (F.col("__m").isNull() | (F.col("__s") > F.col("__m"))).cast("int")
    merged = running(high.withColumn("__new", fresh), by, ["__s", "__e"], {"__g": "__new"}, width=width) \
        .groupBy(*by, "__g").agg(F.min("__s").alias("__s"), F.max("__e").alias("__e"))
    merged = cut(merged)
    gaps = fill(merged, by, ["__s"], {"__pe": "__e"}, width=width, strict=True)
    inner = join_on(gaps, runs, by).select(*by, F.greatest("__a", "__pe").alias("segment_start"), F.col("__s").alias("segment_end"))
    tails = join_on(runs, merged.groupBy(*by).agg(F.max("__e").alias("__pe")), by, "left").select(
        *by, F.greatest("__a", "__pe").alias("segment_start"), F.col("__z").alias("segment_end"))
    out = inner.unionByName(tails).withColumn("duration", F.col("segment_end") - F.col("segment_start")) \
        .filter((F.col("duration") > 0) & (F.col("duration") >= min_length))
    return numbered(out, by, ["segment_start"], "segment_no", width=width)


def interpolate(df: DataFrame, by: Sequence[str], order: Sequence[str], cols: Sequence[str], *, width) -> DataFrame:
    """Fill gaps linearly in time; before the first and after the last known value, with that value."""
    t = order[0]
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(t).alias("t"), F.col(c).cast("double").alias("v"))) for c in cols}
    out = fill(df, by, order, {f"__b_{c}": k for c, k in known.items()}, width=width, keep_slice=True)
    out = fill(out, by, order, {f"__a_{c}": k for c, k in known.items()}, width=width, direction="next")

    def value(c):
        b, a = F.col(f"__b_{c}"), F.col(f"__a_{c}")
        mid = b["v"] + (a["v"] - b["v"]) * (F.col(t) - b["t"]) / (a["t"] - b["t"])
        return F.when(b.isNull(), a["v"]).when(a.isNull() | (a["t"] == b["t"]), b["v"]).otherwise(mid)
    return out.select(*[value(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def filled(df: DataFrame, by: Sequence[str], order: Sequence[str], cols: Sequence[str], *, width) -> DataFrame:
    """Forward fill, then backward fill what is left at the start."""
    out = fill(df, by, order, {f"__f_{c}": c for c in cols}, width=width, keep_slice=True)
    out = fill(out, by, order, {f"__b_{c}": c for c in cols}, width=width, direction="next")
    return out.select(*[F.coalesce(f"__f_{c}", f"__b_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


def centred_median(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str, window: int, *, width,
                   upper: bool = False, **kw) -> DataFrame:
    """Median of a centred odd window, truncated at the ends; even counts take the upper middle or the mean."""
    radius = (window if window % 2 else window + 1) // 2

    def exprs(w):
        frame = F.sort_array(F.collect_list(value).over(w.rowsBetween(-radius, radius)))
        n = F.size(frame)
        high = F.element_at(frame, (F.floor(n / 2) + 1).cast("int"))
        if upper:
            return {name: high}
        return {name: (F.element_at(frame, (F.floor((n - 1) / 2) + 1).cast("int")) + high) / 2}
    return framed(df, by, order, exprs, before=radius, after=radius, width=width, **kw)


def counter_difference(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str, *, width) -> DataFrame:
    prev = lagged(df, by, order, {"__p": (value, 1)}, width=width)
    return prev.withColumn(name, F.when(F.col("__p").isNotNull(), F.greatest(F.col(value) - F.col("__p"), F.lit(0)))).drop("__p")


def lag_scan(df: DataFrame, by: Sequence[str], order: Sequence[str], x: str, y: str, lags: Sequence[int], *, width,
             method: str = "spearman", min_pairs: int = 60, **kw) -> DataFrame:
    """Correlation of ``x`` with ``y`` so many rows later, per key and lag; null under ``min_pairs`` pairs."""
    reach = max(abs(k) for k in lags)

    def exprs(w):
        return {"__pairs": F.array(*[F.struct(F.lit(k).alias("lag"), (F.lead(y, k) if k >= 0 else F.lag(y, -k)).over(w).alias("y"))
                                     for k in lags])}
    wide = framed(df.select(*by, *order, F.col(x).alias("__x"), F.col(y).alias(y)), by, order, exprs, before=reach, after=reach,
                  width=width, **kw)
    pairs = wide.select(*by, "__x", F.explode("__pairs").alias("__p")).select(
        *by, F.col("__p.lag").alias("lag"), F.col("__x").cast("double").alias("__x"), F.col("__p.y").cast("double").alias("__y")) \
        .filter(F.col("__x").isNotNull() & F.col("__y").isNotNull())
    a, b = "__x", "__y"
    if method == "spearman":
        pairs = average_rank(pairs, [*by, "lag"], {"__rx": "__x", "__ry": "__y"})
        a, b = "__rx", "__ry"
    usable = (F.count(F.lit(1)) >= min_pairs) & (F.max(a) > F.min(a)) & (F.max(b) > F.min(b))
    return pairs.groupBy(*by, "lag").agg(F.count(F.lit(1)).alias("pairs"), F.when(usable, F.corr(a, b)).alias("corr"))


def lag_summary(scan: DataFrame) -> DataFrame:
    """Median correlation per lag over the keys that have one."""
    return summarise(scan, ["lag"], {"cycles": F.count("corr")}, {"median_corr": ("corr", .5)})


def intervals(df: DataFrame, by: Sequence[str], order: Sequence[str], *, width, unit: float = 1.0) -> DataFrame:
    """Median time between successive rows of a key."""
    gaps = fill(df, by, order, {"__p": order[0]}, width=width, strict=True)
    return quantiles(gaps, by, {"median_interval": ((F.col(order[0]) - F.col("__p")) / unit, .5)})


def baseline_delta(df: DataFrame, by: Sequence[str], order: Sequence[str], cols: Sequence[str], normal: Column, *, width,
                   min_rows: int = 60, fallback_rows: int = 300) -> DataFrame:
    """Add baseline, delta and ratio per column: the median of the normal rows, or of the first rows of the
    key where there are fewer than ``min_rows`` normal ones."""
    placed = numbered(df, by, order, "__rn", width=width).withColumn("__normal", F.coalesce(normal, F.lit(False)))
    head = F.col("__rn") <= fallback_rows
    specs = {}
    for c in cols:
        specs[f"__n_{c}"] = (F.when(F.col("__normal"), F.col(c)), .5)
        specs[f"__h_{c}"] = (F.when(head, F.col(c)), .5)
    base = summarise(placed, by, {"__count": F.sum(F.col("__normal").cast("bigint"))}, specs)
    out = join_on(placed, base, by, "left")
    added = []
    for c in cols:
        b = F.when(F.col("__count") >= min_rows, F.col(f"__n_{c}")).otherwise(F.col(f"__h_{c}"))
        added += [b.alias(f"{c}_baseline"), (F.col(c) - b).alias(f"{c}_delta"), F.when(F.abs(b) > 1e-9, F.col(c) / b).alias(f"{c}_ratio")]
    return out.select(*df.columns, *added)


def drop_from_baseline(df: DataFrame, by: Sequence[str], value: str, normal: Column, name: str, min_rows: int = 5,
                       share: float = 0.1) -> DataFrame:
    """Percent below the baseline, at least 0: the normal median, else the median of the top share."""
    base, keys = keyed(df, by)
    norm = F.when(F.coalesce(normal, F.lit(False)), F.col(value))
    stats = summarise(base, keys, {"__n": F.count(norm)}, {"__m": (norm, .5), "__top": (value, top_share_median(share))})
    b = F.coalesce(F.when((F.col("__n") >= min_rows) & (F.col("__m") > 0), F.col("__m")), F.col("__top"), F.lit(1.0))
    out = join_on(base, stats, keys, "left").withColumn(name, F.greatest((b - F.col(value)) / b * 100.0, F.lit(0.0)))
    return out.drop("__n", "__m", "__top", *spare(by))


def event_timing(df: DataFrame, events: DataFrame, by: Sequence[str], order: Sequence[str], temp: str, clock: str, latency: str,
                 normal: Column, recovery: str, *, width, k: int = 5, fallback_rows: int = 300, min_rows: int = 30) -> DataFrame:
    """Onset and recovery times of temperature, clock and latency per cycle, with the lags between them.

    ``events`` has one row per key with ``fault_start`` and ``recovery_start``.
    """
    t = order[0]
    placed = numbered(df.filter(F.col(latency).isNotNull()), by, order, "__rn", width=width)
    n, lat = F.coalesce(normal, F.lit(False)), F.col(latency)
    stats = summarise(placed, by, {"__n": F.count(F.when(n, lat))}, {
        "__mn": (F.when(n, lat), .5), "__pn": (F.when(n, lat), .95),
        "__mh": (F.when(F.col("__rn") <= fallback_rows, lat), .5), "__ph": (F.when(F.col("__rn") <= fallback_rows, lat), .95)})
    enough = F.col("__n") >= min_rows
    stats = stats.select(*by, enough.alias("__enough"), F.when(enough, F.col("__mn")).otherwise(F.col("__mh")).alias("baseline_latency"),
                         F.when(enough, F.col("__pn")).otherwise(F.col("__ph")).alias("__p95"))
    dev = join_on(placed, stats, by).withColumn("__used", F.when(F.col("__enough"), n).otherwise(F.col("__rn") <= fallback_rows))
    spread = quantiles(dev, by, {"__mad": (F.when(F.col("__used"), F.abs(lat - F.col("baseline_latency"))), .5)})
    base = quantiles(df, by, {"baseline_temp": (F.when(n, F.col(temp)), .5), "baseline_clock": (F.when(n, F.col(clock)), .5)})
    facts = cut(join_on(join_on(join_on(stats, spread, by, "left"), base, by, "left"), events, by, "left"))
    med = F.col("baseline_latency")
    mad = F.when(F.col("__mad") > 0, F.col("__mad")).otherwise(F.greatest(F.lit(1.0), med * 0.05))
    facts = facts.withColumn("latency_threshold", F.greatest(F.col("__p95"), med + 3.0 * mad, med * 1.25)).drop("__p95", "__mad", "__enough")
    rows = join_on(df, facts, by)
    first = first_sustained(rows, by, order, {
        "temp_onset": F.col(temp) >= F.col("baseline_temp") + 5.0, "clock_onset": F.col(clock) <= F.col("baseline_clock") * 0.8,
        "latency_onset": lat >= F.col("latency_threshold")}, width=width, k=k)
    after = first_sustained(rows.filter(F.col(t) >= F.col(recovery)), by, order, {
        "temp_recovered": F.col(temp) <= F.col("baseline_temp") + 2.0, "clock_recovered": F.col(clock) >= F.col("baseline_clock") * 0.9,
        "latency_recovered": lat <= F.col("latency_threshold")}, width=width, k=k)
    out = join_on(join_on(facts, first, by, "left"), after, by, "left")
    return out.withColumn("temp_after_fault", F.col("temp_onset") - F.col("fault_start")) \
        .withColumn("clock_after_temp", F.col("clock_onset") - F.col("temp_onset")) \
        .withColumn("latency_after_clock", F.col("latency_onset") - F.col("clock_onset")) \
        .withColumn("temp_recovery", F.col("temp_recovered") - F.col(recovery)) \
        .withColumn("latency_recovery", F.col("latency_recovered") - F.col(recovery))


def live_baseline(df: DataFrame, by: Sequence[str], order: Sequence[str], normal: Column, temp: str, clock: str, eligible: Column, *,
                  width, rows: int = 120) -> DataFrame:
    """Deltas against the mean of the first normal rows, and whether recovery looks stable."""
    n = numbered(df.filter(normal), by, order, "__rn", width=width).filter(F.col("__rn") <= rows)
    base = n.groupBy(*by).agg(F.avg(temp).alias("baseline_temp"), F.avg(clock).alias("baseline_clock"))
    out = join_on(df, base, by, "left").withColumn("delta_temp", F.col(temp) - F.col("baseline_temp")) \
        .withColumn("delta_clock", F.col(clock) - F.col("baseline_clock"))
    return out.withColumn("clock_drop_observed", F.coalesce(F.col("delta_clock") <= -150, F.lit(False))).withColumn(
        "recovery_stable", F.coalesce(eligible & (F.col("delta_temp") <= 2) & (F.col("delta_clock") >= -100), F.lit(False)))


def annotate_events(events: DataFrame, series: DataFrame, by: Sequence[str], order: Sequence[str], message: Column,
                    crossings: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """Event list with a message each, plus the first crossing of each threshold as an event."""
    t = order[0]
    out = events.select(*by, t, "event", F.lit("info").alias("level"), message.alias("message"))
    position = F.struct(*[F.col(c) for c in order])
    for name, level, hit in crossings:
        first = series.filter(hit).groupBy(*by).agg(F.min_by(t, position).alias(t))
        out = out.unionByName(first.select(*by, t, F.lit(name).alias("event"), F.lit(level).alias("level"), F.lit(f"first {name}").alias("message")))
    return out


def thin_out(df: DataFrame, by: Sequence[str], order: Sequence[str], *, width, points: int = 320) -> DataFrame:
    """About ``points`` rows per key for display: every n-th row from the first, and the last one."""
    placed = numbered(df, by, order, "__rn", width=width)
    size = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    step = F.when(F.col("__n") <= points, F.lit(1)).otherwise(F.greatest(F.floor(F.col("__n") / points), F.lit(1)))
    return join_on(placed, size, by).filter(((F.col("__rn") - 1) % step == 0) | (F.col("__rn") == F.col("__n"))).drop("__rn", "__n")


def phase_windows(df: DataFrame, start: Column, end: Column, remote_end: Column, warmup: Column, kind: Column, load_estimate: Column) -> DataFrame:
    """Warm-up, steady and cool-down windows of each run in elapsed seconds; empty ones are left out."""
    total = end - start
    remote = F.coalesce(remote_end - start, total)
    ram = kind == "ram_bound"
    load_end = F.least(remote, load_estimate)
    warm_end = F.when(ram, F.least(warmup, load_end)).otherwise(F.least(warmup, remote))
    steady_end = F.when(ram, load_end).otherwise(remote)
    parts = [("warm-up", F.lit(0.0), warm_end, F.lit(True)), ("steady-state", warm_end, steady_end, steady_end > warm_end),
             ("steady-state", load_end, remote, ram & (remote > load_end)), ("cooldown", remote, total, total > remote)]
    return df.select("*", F.explode(F.array_compact(F.array(*[F.when(keep, F.struct(
        F.lit(n).alias("phase"), a.cast("double").alias("start_s"), z.cast("double").alias("end_s"))) for n, a, z, keep in parts])))
        .alias("__w")).select(*df.columns, "__w.*")


def boundary_times(start: Column, warmup_s: Column, measurement_s: Column, post_s: Column) -> dict[str, Column]:
    """Planned boundary epochs (seconds) of a run."""
    a = start + warmup_s
    z = a + measurement_s
    return {"warmup_start": start, "warmup_end": a, "measurement_start": a, "measurement_end": z, "client_stop": z + post_s,
            "measurement_start_elapsed": warmup_s, "measurement_end_elapsed": warmup_s + measurement_s}
