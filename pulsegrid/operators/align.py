"""Alignment in time and identity: as-of, interval and overlay joins.

None of these pairs up whole groups. As-of joins are ordered scans over the union of both sides; interval
and neighbourhood joins meet on (key, time bucket) first, so a hot key is spread over its time range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .keys import col, join_on, keyed, spare
from .ordered import fill, running
from .quantiles import quantiles, summarise


def asof_join(left: DataFrame, right: DataFrame, left_t: str, right_t: str, by: Sequence[str] = (), *, width,
              direction: str = "nearest", tolerance=None, tie: str = "earlier", payload: Sequence[str] = (),
              order: str | None = None, offset: str | None = None) -> DataFrame:
    """Attach to each left row the closest right row in time (numeric columns of one unit).

    ``payload`` columns and ``right_t`` come from the right and are null when nothing lies within
    ``tolerance``. Equal distances go to the ``tie`` side; among right rows of one time the last by
    ``order`` counts. ``width`` is the slice of time one task sorts.
    """
    if right_t == left_t:
        raise ValueError("the two time columns need different names")
    tb = order if order else "__o"
    r = right.filter(F.col(right_t).isNotNull())
    if not order:
        r = r.withColumn("__o", F.struct(*[F.col(c) for c in payload]) if payload else F.lit(0))
    held = F.struct(F.col(right_t).alias("t"), *[F.col(c).alias(c) for c in payload])
    r = r.groupBy(*by, right_t).agg(F.max_by(held, F.col(tb)).alias("__r")) \
        .select(*by, F.col(right_t).alias("__t"), F.lit(0).alias("__side"), "__r")
    lcols = [c for c in left.columns if c not in by]
    l = left.select(*by, F.col(left_t).alias("__t"), F.lit(1).alias("__side"),
                    F.struct(*[F.col(c) for c in lcols]).alias("__l"))
    both = l.unionByName(r, allowMissingColumns=True)
    if direction in ("nearest", "backward"):
        both = fill(both, by, ["__t", "__side"], {"__b": "__r"}, width=width, keep_slice=direction == "nearest")
    if direction in ("nearest", "forward"):
        # Right rows sort before left rows of the same time, so a forward look needs the reverse placement.
        both = both.withColumn("__side2", 1 - F.col("__side"))
        both = fill(both, by, ["__t", "__side2"], {"__f": "__r"}, width=width, direction="next").drop("__side2")
    rows = both.filter(F.col("__side") == 1)
    if direction == "backward":
        pick = F.col("__b")
    elif direction == "forward":
        pick = F.col("__f")
    else:
        back, ahead = F.col("__t") - F.col("__b.t"), F.col("__f.t") - F.col("__t")
        forward = F.col("__b").isNull() | (ahead <= back if tie == "later" else ahead < back)
        pick = F.when(F.col("__f").isNotNull() & forward, F.col("__f")).otherwise(F.col("__b"))
    rows = rows.withColumn("__p", pick)
    if tolerance is not None:
        rows = rows.withColumn("__p", F.when(F.abs(F.col("__t") - F.col("__p.t")) <= tolerance, F.col("__p")))
    out = [*by, *[F.col("__l")[c].alias(c) for c in lcols], F.col("__p.t").alias(right_t),
           *[F.col("__p")[c].alias(c) for c in payload]]
    if offset:
        out.append((F.col("__t") - F.col("__p.t")).alias(offset))
    return rows.select(*out)


def tolerance_sensitivity(matched: DataFrame, by: Sequence[str], offset: str, tolerances: Sequence[float]) -> DataFrame:
    """Match rate and offset quantiles at several tolerances from one unbounded as-of join."""
    rows = matched.withColumn("tolerance", F.explode(F.array(*[F.lit(float(x)) for x in tolerances]))) \
        .withColumn("__o", F.when(F.abs(F.col(offset)) <= F.col("tolerance"), F.abs(F.col(offset)).cast("double")))
    return summarise(rows, [*by, "tolerance"], {
        "bins": F.count(F.lit(1)), "matched_bins": F.count("__o"),
        "matched_rate": F.count("__o") / F.count(F.lit(1))}, {"offset_p50": ("__o", .5), "offset_p95": ("__o", .95)})


def invalidate(df: DataFrame, offset: str, tolerance, cols: Sequence[str]) -> DataFrame:
    """Null the matched columns of rows whose offset is out of tolerance."""
    keep = ~(F.abs(F.col(offset)) > tolerance) | F.col(offset).isNull()
    return df.select(*[F.when(keep, F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def _winners(iv: DataFrame, keys: Sequence[str], closed: str, pick: str, order: Sequence[str], width) -> DataFrame:
    """Cut overlapping intervals to the stretches they win, so that no two hold the same point.

    An interval wins from where every interval starting before it has ended (``first``), or until the first
    start among the intervals that end after it (``last``). Both bounds come from an ordered scan.
    """
    if pick == "first":
        scan = running(iv, keys, ["__s", *order], maxima={"__m": "__e"}, width=width, strict=True)
        late = F.coalesce(F.col("__m") >= F.col("__s"), F.lit(False))
        out = scan.withColumn("__s", F.when(late, F.col("__m")).otherwise(F.col("__s"))).withColumn("__after", late & F.lit(closed == "both"))
        keep = (F.col("__s") < F.col("__e")) | (F.lit(closed == "both") & ~F.col("__after") & (F.col("__s") == F.col("__e")))
        return out.withColumn("__at_end", F.lit(closed == "both")).filter(keep).drop("__m")
    # Latest end first; among equal ends the last by ``order`` first.
    flipped = iv.withColumn("__ne", -F.col("__e")).withColumn("__ns", -F.col("__s"))
    back = []
    for i, c in enumerate(order):
        flipped = flipped.withColumn(f"__no{i}", -F.col(c))
        back.append(f"__no{i}")
    scan = running(flipped, keys, ["__ne", *back], maxima={"__m": "__ns"}, width=width, strict=True)
    early = F.coalesce(-F.col("__m") <= F.col("__e"), F.lit(False))
    out = scan.withColumn("__e", F.when(early, -F.col("__m")).otherwise(F.col("__e"))).withColumn("__at_end", ~early & F.lit(closed == "both"))
    keep = (F.col("__s") < F.col("__e")) | (F.col("__at_end") & (F.col("__s") == F.col("__e")))
    return out.withColumn("__after", F.lit(False)).filter(keep).drop("__m", "__ne", "__ns", *back)


def interval_join(points: DataFrame, intervals: DataFrame, t: str, start: str, end: str, by: Sequence[str] = (), *,
                  bucket, closed: str = "left", how: str = "left", pick: str | None = None,
                  order: Sequence[str] = (), payload: Sequence[str]) -> DataFrame:
    """Attach the interval that holds each point.

    Intervals are spread over the time buckets they cover and meet points on (key, bucket). ``closed`` is
    ``left`` (half-open) or ``both``. Where intervals may overlap, ``pick`` keeps the one that starts first
    (``first``) or ends last (``last``), ties going to the first or last by the numeric columns ``order``;
    in a schedule listed in time order these are its first and last match. The overlaps are resolved among
    the intervals, before any point is seen. Without ``pick`` every containing interval gives a row.
    """
    held = list(dict.fromkeys([*order, *payload]))
    iv, keys = keyed(intervals.filter(F.col(start) <= F.col(end)), by)
    iv = iv.select(*keys, F.col(start).alias("__s"), F.col(end).alias("__e"), *[F.col(c).alias(f"__p{i}") for i, c in enumerate(held)])
    if pick:
        iv = _winners(iv, keys, closed, pick, [f"__p{held.index(c)}" for c in order], bucket)
    else:
        iv = iv.withColumn("__after", F.lit(False)).withColumn("__at_end", F.lit(closed == "both"))
    cell = lambda c: F.floor(F.col(c) / bucket).cast("bigint")
    iv = iv.select(*keys, "__s", "__e", "__after", "__at_end", F.struct(*[F.col(f"__p{i}").alias(c) for i, c in enumerate(held)]).alias("__iv"),
                   F.explode(F.sequence(cell("__s"), cell("__e"))).alias("__bk"))
    pts, _ = keyed(points.withColumn("__bk", cell(t)), by)
    on = [*keys, "__bk"]
    right = iv.select(*[F.col(c).alias(f"__r{i}") for i, c in enumerate(on)], "__s", "__e", "__after", "__at_end", "__iv")
    condition = (F.col(t) > F.col("__s")) | ((F.col(t) == F.col("__s")) & ~F.col("__after"))
    condition &= (F.col(t) < F.col("__e")) | ((F.col(t) == F.col("__e")) & F.col("__at_end"))
    for i, c in enumerate(on):
        condition &= pts[c].eqNullSafe(right[f"__r{i}"])
    joined = pts.join(right, condition, how)
    return joined.select(*points.columns, *[F.col("__iv")[c].alias(c) for c in payload])


def near_join(points: DataFrame, anchors: DataFrame, by: Sequence[str], t: str, anchor: str, lo, hi) -> DataFrame:
    """Pairs with ``lo <= t - anchor <= hi`` of one key, meeting on buckets as wide as the neighbourhood."""
    width = float(hi - lo)
    a = anchors.withColumn("__bk", F.explode(F.sequence(F.floor((F.col(anchor) + lo) / width).cast("bigint"),
                                                        F.floor((F.col(anchor) + hi) / width).cast("bigint"))))
    p = points.withColumn("__bk", F.floor(F.col(t) / width).cast("bigint"))
    return join_on(p, a, [*by, "__bk"]).drop("__bk").filter((F.col(t) - F.col(anchor)).between(lo, hi))


def last_event(events: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], name: str) -> DataFrame:
    """Lookup table of an event log: the last value per key wins."""
    return events.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.max_by(value, F.struct(*[F.col(c) for c in order])).alias(name))


def merge_vectors(samples: DataFrame, by: Sequence[str], metric: str, value: str, order: Sequence[str],
                  metrics: Sequence[str]) -> DataFrame:
    """One row per entity with the latest value of each of the named metric vectors."""
    position = F.struct(*[F.col(c) for c in order])
    return samples.filter(F.col(metric).isin(*metrics)).groupBy(*by).agg(
        *[F.max_by(F.when(F.col(metric) == m, F.col(value)), F.when(F.col(metric) == m, position)).alias(m) for m in metrics])


def ownership(pods: DataFrame, sets: DataFrame, deployments: DataFrame, *, pod_owner: str, set_name: str,
              set_owner: str, dep_name: str, fallback: str) -> DataFrame:
    """Resolve pod -> replica set -> deployment and say how far the chain reached.

    ``deployment`` when the whole chain exists, ``partial`` (named after the owner) when it breaks on the
    way, ``fallback`` (named after the pod) when the pod has no owner.
    """
    chain = pods.join(sets.select(F.col(set_name).alias("__set"), F.col(set_owner).alias("__owner")),
                      F.col(pod_owner) == F.col("__set"), "left") \
        .join(deployments.select(F.col(dep_name).alias("__dep")), F.col("__owner") == F.col("__dep"), "left")
    return chain.withColumn("owner_resolution", F.when(F.col(pod_owner).isNull(), "fallback")
                            .when(F.col("__dep").isNull(), "partial").otherwise("deployment")) \
        .withColumn("workload", F.coalesce("__dep", pod_owner, fallback)).drop("__set", "__owner", "__dep")


def overlay(base: DataFrame, preferred: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Take each column from the preferred source where it has a value, else from the base; note the source."""
    renamed = preferred.select(*by, *[F.col(c).alias(f"__p_{c}") for c in cols])
    out = join_on(base, renamed, by, "left")
    used = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"__p_{c}").isNotNull(), F.lit(c)) for c in cols])), ",")
    return out.withColumn("overlaid", used).select(
        *[F.coalesce(F.col(f"__p_{c}"), F.col(c)).alias(c) if c in cols else F.col(c) for c in base.columns], "overlaid")


def carry_forward(left: DataFrame, right: DataFrame, by: Sequence[str], order: Sequence[str], cols: Sequence[str], *,
                  width) -> DataFrame:
    """Interleave two sample streams and carry the last known value of each column forward."""
    both = left.unionByName(right, allowMissingColumns=True)
    return fill(both, by, order, {c: c for c in cols}, width=width)


def concat_on_time(frames: Sequence[DataFrame], by: Sequence[str], t: str, order: str) -> DataFrame:
    """Outer concatenation of frames on (key, time); in each, the last row of a duplicated time is kept.

    The frames are stacked and grouped once rather than joined one by one.
    """
    cols = [[c for c in f.columns if c not in (*by, t, order)] for f in frames]
    stacked = None
    for i, (f, cs) in enumerate(zip(frames, cols)):
        part = f.select(*by, t, F.struct(*[F.col(c) for c in cs]).alias(f"__f{i}"), F.col(order).alias(f"__o{i}"))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    out = stacked.groupBy(*by, t).agg(*[F.max_by(f"__f{i}", f"__o{i}").alias(f"__f{i}") for i in range(len(frames))])
    return out.select(*by, t, *[F.col(f"__f{i}")[c].alias(c) for i, cs in enumerate(cols) for c in cs])


def _prefixes(c: Column) -> Column:
    """Every leading part of a name; names are short (253 characters at most in DNS)."""
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, F.lit(1), i)))


def _parts(c: Column) -> Column:
    """Every contiguous part of a name."""
    return F.when(F.length(c) > 0, F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), F.length(c)),
        lambda i: F.transform(F.sequence(F.lit(1), F.length(c) - i + 1), lambda n: F.substring(c, i, n))))))


def resolve_identity(names: DataFrame, candidates: DataFrame, name: str, ip: str, cand: str, cand_ip: str,
                     canonical=lambda c: F.lower(F.trim(c))) -> DataFrame:
    """Match names to candidate identities and say by which rule.

    The rules in order: equal canonical names; one name a prefix of the other; equal address; the single
    candidate there is. Among several candidates of one rule the smallest counts. Every rule is an
    equi-join (prefixes are exploded), never a scan of all pairs.
    """
    n = names.withColumn("__n", canonical(F.col(name)))
    c = candidates.select(F.col(cand), F.col(cand_ip).alias("__cip"), canonical(F.col(cand)).alias("__c"))
    exact = c.groupBy("__c").agg(F.min(cand).alias("__exact"))
    longer = c.select(F.explode(_prefixes(F.col("__c"))).alias("__stem"), cand).groupBy("__stem").agg(F.min(cand).alias("__down"))
    shorter = n.select("__n").distinct().select(F.col("__n").alias("__n2"), F.explode(_prefixes(F.col("__n"))).alias("__s")) \
        .join(exact, F.col("__s") == F.col("__c")).groupBy("__n2").agg(F.min("__exact").alias("__up"))
    address = c.filter(F.col("__cip").isNotNull()).groupBy("__cip").agg(F.min(cand).alias("__addr"))
    only = c.agg(F.when(F.count_distinct(cand) == 1, F.min(cand)).alias("__only")).withColumn("__k", F.lit(1))
    out = n.join(exact, F.col("__n") == F.col("__c"), "left").join(longer, F.col("__n") == F.col("__stem"), "left") \
        .join(shorter, F.col("__n") == F.col("__n2"), "left").join(address, F.col(ip) == F.col("__cip"), "left") \
        .withColumn("__k2", F.lit(1)).join(only, F.col("__k2") == F.col("__k"), "left")
    prefix = F.least("__down", "__up")
    return out.select(
        *names.columns, F.coalesce(F.col("__exact"), prefix, F.col("__addr"), F.col("__only")).alias("resolved"),
        F.when(F.col("__exact").isNotNull(), "exact").when(prefix.isNotNull(), "prefix")
        .when(F.col("__addr").isNotNull(), "address").when(F.col("__only").isNotNull(), "single_candidate")
        .otherwise("unresolved").alias("match_method"))


def unique_match(names: DataFrame, candidates: DataFrame, name: str, cand: str) -> DataFrame:
    """Match only where a rule has exactly one candidate: the candidate starts with the name, the name
    starts with the candidate, the candidate contains the name. Otherwise the name stands for itself."""
    c = candidates.select(cand).distinct()
    n = names.select(F.col(name).alias("__n")).distinct()

    def single(df, key, value):
        return df.groupBy(key).agg(F.when(F.count(F.lit(1)) == 1, F.min(value)).alias("__m"))

    down = single(c.select(F.explode(_prefixes(F.col(cand))).alias("__k1"), cand), "__k1", cand).withColumnRenamed("__m", "__m1")
    up = single(n.select("__n", F.explode(_prefixes(F.col("__n"))).alias("__s")).join(c, F.col("__s") == F.col(cand))
                .withColumnRenamed("__n", "__k2"), "__k2", cand).withColumnRenamed("__m", "__m2")
    inside = single(c.select(F.explode(_parts(F.col(cand))).alias("__k3"), cand), "__k3", cand).withColumnRenamed("__m", "__m3")
    out = names.join(down, F.col(name) == F.col("__k1"), "left").join(up, F.col(name) == F.col("__k2"), "left") \
        .join(inside, F.col(name) == F.col("__k3"), "left")
    return out.select(*names.columns, F.coalesce("__m1", "__m2", "__m3", name).alias("resolved"),
                      F.when(F.col("__m1").isNotNull(), "prefix").when(F.col("__m2").isNotNull(), "reverse_prefix")
                      .when(F.col("__m3").isNotNull(), "contains").otherwise("itself").alias("match_method"))


def alignment_inventory(requests: DataFrame, telemetry: DataFrame, by: Sequence[str], t: str, ok: str, cycle: str,
                        phase: str, *, width, bin_width: int, tolerance, min_overlap: float, min_success: int,
                        min_match: float, unit: float) -> DataFrame:
    """Run inventory: sizes, spans, overlap, alignment quality and suitability with reasons.

    Alignment is judged on the distinct time bins that have requests. ``unit`` converts ``t`` to seconds.
    ``phase`` takes few values.
    """
    def intervals(df, name):
        gaps = fill(df, by, [t, "__tb"], {"__prev": t}, width=width, strict=True)
        return quantiles(gaps, by, {name: ((F.col(t) - F.col("__prev")) / unit, .5)})

    req = requests.withColumn("__tb", F.col("event_id"))
    tel = telemetry.withColumn("__tb", F.col("event_id"))
    a = req.groupBy(*by).agg(F.count(F.lit(1)).alias("request_rows"), F.sum(F.col(ok).cast("bigint")).alias("success_rows"),
                             F.avg(F.col(ok).cast("double")).alias("success_rate"), F.min(t).alias("__ra"), F.max(t).alias("__rz"))
    b = tel.groupBy(*by).agg(F.count(F.lit(1)).alias("telemetry_rows"), F.count_distinct(cycle).alias("cycle_count"),
                             F.array_join(F.array_sort(F.collect_set(phase)), ",").alias("phases"),
                             F.min(t).alias("__ta"), F.max(t).alias("__tz"))
    bins = req.select(*by, (F.floor(F.col(t) / bin_width) * bin_width).cast("bigint").alias("__bin")).distinct()
    stamps = tel.select(*by, F.col(t).alias("__rt")).distinct()
    near = asof_join(bins, stamps, "__bin", "__rt", by, width=width, offset="__off")
    off = F.abs(F.col("__off"))
    quality = summarise(near, by, {"matched_rate": F.avg(F.when(off <= tolerance, 1.0).otherwise(0.0))},
                        {"offset_p95_s": (F.when(off <= tolerance, off / unit), .95)})
    out = join_on(a, b, by, "full_outer")
    for extra in (intervals(req, "request_interval_s"), intervals(tel, "telemetry_interval_s"), quality):
        out = join_on(out, extra, by, "left")
    overlap = (F.least("__rz", "__tz") - F.greatest("__ra", "__ta")) / unit
    overlap = F.when(F.col("request_rows").isNotNull() & F.col("telemetry_rows").isNotNull(), overlap)
    out = out.withColumn("overlap_s", overlap).fillna(0, ["request_rows", "success_rows", "telemetry_rows", "cycle_count"])
    o, m = F.coalesce("overlap_s", F.lit(0.0)), F.coalesce("matched_rate", F.lit(0.0))
    timely = (F.col("request_rows") > 0) & (F.col("telemetry_rows") > 0) & (o > min_overlap)
    return out.drop("__ra", "__rz", "__ta", "__tz").withColumn("suitable_for_time", timely).withColumn(
        "suitable_for_modeling", timely & (F.col("cycle_count") >= 1) & (F.col("success_rows") >= min_success) & (m >= min_match)
    ).withColumn("exclude_reason", F.concat_ws(
        "; ", F.when(F.col("request_rows") == 0, "missing requests"), F.when(F.col("telemetry_rows") == 0, "missing telemetry"),
        F.when(o <= min_overlap, "insufficient overlap"), F.when(F.col("success_rows") < min_success, "insufficient successes"),
        F.when(m < min_match, "weak alignment")))


def label_windows(points: DataFrame, windows: DataFrame, t: str, by: Sequence[str], *, order: str, core: tuple[str, str],
                  buffer, bucket, default: str = "reachable",
                  labels: tuple[str, str] = ("service_unreachable", "outage_buffer")) -> DataFrame:
    """Label points by nested windows: the last window whose buffered span holds a point decides, and within
    it the core overrides the buffer. Both spans are closed; windows are numbered by ``order`` in time order."""
    w = windows.select(*by, order, F.col(core[0]).alias("__c0"), F.col(core[1]).alias("__c1"),
                       (F.col(core[0]) - buffer).alias("__b0"), (F.col(core[1]) + buffer).alias("__b1"))
    out = interval_join(points, w, t, "__b0", "__b1", by, bucket=bucket, closed="both", pick="last", order=[order],
                        payload=[order, "__c0", "__c1"])
    label = F.when(F.col(order).isNull(), default).when(F.col(t).between(F.col("__c0"), F.col("__c1")), labels[0]).otherwise(labels[1])
    return out.withColumn("label", label).drop("__c0", "__c1")


def enrich(nodes: DataFrame, tables: Sequence[tuple[DataFrame, Sequence[str]]], precedence: Sequence[tuple[str, str]],
           generic: str, generic_label: str, applies: Column, name: str) -> DataFrame:
    """Left-join inventory tables and take the first known value in precedence order, noting its source."""
    out = nodes
    for table, on in tables:
        out = join_on(out, table, on, "left")
    known = F.coalesce(*[F.col(c) for c, _ in precedence], F.lit(generic))
    source = F.lit(generic_label)
    for c, label in reversed(precedence):
        source = F.when(F.col(c).isNotNull(), label).otherwise(source)
    return out.withColumn(name, F.when(applies, known)).withColumn(f"{name}_source", F.when(applies, source))
