"""Reading and writing runs as files, and checks on what was read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from pulsegrid.operators.grid import dense_bins
from pulsegrid.operators.keys import join_on
from pulsegrid.operators.ordered import numbered


def run_of(path: Column, level: int = 2) -> Column:
    """Run id from a file path: the name of its folder (``level`` 2) or of a folder further up."""
    parts = F.split(path, "/")
    return F.try_element_at(parts, F.lit(-level))


def read_csv(spark: SparkSession, path, schema: T.StructType, run: str | None = None, one_header: bool = False) -> DataFrame:
    """CSV files with a header, as the wanted columns only: text is converted where it can be, and wanted
    columns that a file lacks are null. Every file has its own header; files with equal ones are read together.

    Finding the headers takes a scan of the lines; ``one_header`` spares it where all files are known to agree.
    """
    def part(files) -> DataFrame:
        raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(files)
        have = {c.strip(): c for c in raw.columns}
        cols = [F.col(f"`{have[f.name]}`").try_cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
                for f in schema.fields]
        return raw.select(*cols, *([run_of(F.col("_metadata.file_path")).alias(run)] if run else []))

    if one_header:
        return part(path)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
                                         F.monotonically_increasing_id().alias("i"))
    first = lines.filter("b = 0 and trim(value) <> ''").groupBy("f").agg(F.min_by("value", "i").alias("h"))
    files = first.groupBy("h").agg(F.collect_list("f").alias("f")).orderBy("h").collect()  # one entry per file, as the file index has anyway
    if len(files) < 2:
        return part(path)
    whole = part(files[0]["f"])
    for other in files[1:]:
        whole = whole.unionByName(part(other["f"]))
    return whole


def read_jsonl(spark: SparkSession, path, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines: ``strict`` stops at a bad line and names its file and number, otherwise bad lines are left out. Blank lines are no rows."""
    if not strict:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    told = F.raise_error(F.concat("file", F.lit(":"), F.col("line_no").cast("string"), F.lit(": invalid JSON line")))
    checked = F.when(_is_bad("value"), told.cast("string")).otherwise(F.col("value"))
    return lines.select(F.from_json(checked, schema, {"mode": "PERMISSIVE"}).alias("__r")).select("__r.*")


def _is_bad(line: str) -> Column:
    return F.json_object_keys(F.col(line)).isNull()


def bad_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """The lines that are not JSON objects, for a report with their place."""
    return lines.filter((F.trim(F.col(line)) != "") & _is_bad(line))


def numbered_lines(spark: SparkSession, path) -> DataFrame:
    """``file, line_no, value`` of text files, lines counted from 1. A file may be read in many splits: each counts its own lines, and the counts of the splits before it
    (one row per split) say where it begins, so no file meets in one task."""
    lines = read_lines(spark, path)
    splits = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = splits.select("file", "block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return join_on(lines, starts, ["file", "block"]).select("file", (F.col("__before") + F.col("line_no") + 1).alias("line_no"), "value")


def read_lines(spark: SparkSession, path) -> DataFrame:
    """Text lines with their file and a number that rises with their place in it."""
    raw = spark.read.text(path)
    placed = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__b"),
                        F.monotonically_increasing_id().alias("__i"))
    # Splits of a file are ordered by their start; inside a split the id rises with the line.
    base = placed.groupBy("file", "__b").agg(F.min("__i").alias("__i0"))
    return join_on(placed, base, ["file", "__b"]).select("file", F.col("__b").alias("block"), (F.col("__i") - F.col("__i0")).alias("line_no"), "value")


def read_manifests(spark: SparkSession, path, schema: str) -> DataFrame:
    """One JSON document per run folder; an unreadable one gives a row of nulls with its run id."""
    raw = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema(schema).json(path)
    return raw.select(run_of(F.col("_metadata.file_path")).alias("run_id"), "*")


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files under a folder with path, length and time only; their content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root) \
        .select("path", "length", "modificationTime")


def discover_runs(files: DataFrame, prefix: str, sentinels: Sequence[str]) -> DataFrame:
    """Run folders by name prefix, with their newest file time and whether every sentinel file is there."""
    name = F.element_at(F.split("path", "/"), -1)
    named = files.select(run_of(F.col("path")).alias("run_id"), name.alias("file"), "length", "modificationTime").filter(F.col("run_id").startswith(prefix))
    found = F.lit(True)
    for s in sentinels:
        found &= F.bool_or(F.col("file") == s)
    return named.groupBy("run_id").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), found.alias("complete"))


def completeness(runs: DataFrame, files: DataFrame, by: Sequence[str], file: str, required: Sequence[str], marker: str,
                 marker_reason: str) -> DataFrame:
    """Which runs have every required file and the marker; else why not. ``files`` has (by, file, marker)."""
    have = files.groupBy(*by).agg(*[F.bool_or(F.col(file) == r).alias(f"__h{i}") for i, r in enumerate(required)],
                                  F.bool_or(F.coalesce(F.col(marker), F.lit(False))).alias("__marked"))
    out = join_on(runs.select(*by), have, by, "left")
    missing = F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(F.col(f"__h{i}"), F.lit(False)), F.lit(r)) for i, r in enumerate(required)])), ",")
    reason = F.when(missing != "", F.concat(F.lit("missing "), missing)).when(~F.coalesce("__marked", F.lit(False)), marker_reason).otherwise("")
    return out.select(*by, (reason == "").alias("complete"), reason.alias("exclude_reason"))


def append_growing(existing: DataFrame, new: DataFrame, common: Sequence[str]) -> DataFrame:
    """Union under the union of both headers: the common columns first, the others sorted."""
    both = existing.unionByName(new, allowMissingColumns=True)
    rest = sorted(c for c in both.columns if c not in common)
    return both.select(*[c for c in common if c in both.columns], *[F.col(f"`{c}`") for c in rest])


def append_locked(rows: DataFrame, fields: str, locked: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Rows of a map column under a fixed header, with the number of fields each row had beyond it."""
    m = F.col(fields)
    extra = F.size(F.array_except(F.map_keys(m), F.array(*[F.lit(x) for x in locked])))
    return rows.select(*keep, *[F.try_element_at(m, F.lit(x)).alias(x) for x in locked], extra.alias("extra_fields_dropped"))


def fingerprint(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2(F.concat_ws(":", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")), 256).alias("mark"))


def changed_inputs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files added, removed or altered between two fingerprints."""
    b, a = before.withColumnRenamed("mark", "__b"), after.withColumnRenamed("mark", "__a")
    both = join_on(b, a, ["path"], "full_outer")
    change = F.when(F.col("__b").isNull(), "added").when(F.col("__a").isNull(), "removed").when(F.col("__a") != F.col("__b"), "changed")
    return both.select("path", change.alias("change")).filter(F.col("change").isNotNull())


def planned_matrix(profiles: DataFrame, conditions: Sequence[str], replicates: int) -> DataFrame:
    """Every profile under every condition, so many times."""
    return profiles.withColumn("condition", F.explode(F.array(*[F.lit(c) for c in conditions]))) \
        .withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))


def arrival_schedule(segments: DataFrame, by: Sequence[str], name: str, start: str, end: str, rate: str, duration: str, *, width) -> DataFrame:
    """Planned arrival times of rate segments: one every 1/rate seconds from each start, numbered per key."""
    a = F.greatest(F.lit(0.0), F.col(start))
    z = F.least(F.col(duration), F.col(end))
    plan = segments.withColumn("__a", a.cast("double")).withColumn("__end", z.cast("double")).filter((F.col("__end") > F.col("__a")) & (F.col(rate) > 0))
    plan = plan.withColumn("__last", (F.ceil((F.col("__end") - 1e-9 - F.col("__a")) * F.col(rate)) - 1).cast("bigint")).withColumn("__zero", F.lit(0).cast("bigint"))
    rows = dense_bins(plan, "__zero", "__last", "__i")
    rows = rows.select(*by, F.round(F.col("__a") + F.col("__i") / F.col(rate), 9).alias("scheduled_elapsed_s"), F.col(rate).alias("target_rps"), F.col(name).alias("profile_name"))
    placed = numbered(rows, by, ["scheduled_elapsed_s", "profile_name"], "schedule_index", width=width)
    return placed.withColumn("schedule_index", F.col("schedule_index") - 1)
