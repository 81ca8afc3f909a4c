"""Loading, dimensions and maintenance of the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import LEGACY_RULES, RULES

#: Rows of a task that puts keys together. Parts measured by their packed bytes would hold tens of millions of rows with few distinct values.
KEYED_ROWS = 500_000

AUTOMATIC = ["overspeed", "acceleration", "braking", "pitch", "roll", "shock"]


def dedup_first(df: DataFrame, keys: list[str], order: list[str], target: DataFrame | None = None) -> DataFrame:
    """The first row of each key by order; rows whose key the target already holds are left out.

    The first row is an aggregate (combined before the shuffle), so a key that repeats often does no harm.
    """
    cols = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])
    return first if target is None else first.join(target.select(*keys), keys, "left_anti")


def device_dim(points: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """first_ms, last_ms, count and latest row of each device; with known devices, their rules, those of new ones being the default."""
    latest = F.max_by(F.struct("t_ms", "protocol", "speed", "lat", "lon", "fix_mode", "nav_mode"), F.struct("t_ms", "protocol"))
    dim = points.groupBy("device_id").agg(F.min("t_ms").alias("first_ms"), F.max("t_ms").alias("last_ms"), F.count(F.lit(1)).alias("points"), latest.alias("latest"))
    if known is None:
        return dim
    default = F.struct(*[F.lit(float(v)).alias(k) for k, v in RULES.items()])
    return dim.join(known.select("device_id", "rules"), "device_id", "left").withColumn("rules", F.coalesce("rules", default))


def device_latest(points: DataFrame) -> DataFrame:
    return device_dim(points).select("device_id", "latest.*")


def upsert(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """target with the rows of changes in place of those of the same key."""
    return target.join(changes.select(*keys), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def merge_package(target: DataFrame, package: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the latest version of each key of both."""
    both = target.unionByName(package)
    cols = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(version)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def admit_packages(packages: DataFrame, received: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packages whose id is new, and those refused as received before."""
    known = received.select("package_id").distinct()
    return packages.join(known, "package_id", "left_anti"), packages.join(known, "package_id", "left_semi")


def ignore_known(events: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    return events.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")


def export_delta(events: DataFrame, units: DataFrame, since: int, key: str) -> tuple[DataFrame, DataFrame]:
    """Events after a mark and the units that they touch."""
    fresh = events.where(F.col("seq") > since)
    return fresh, units.join(fresh.select(key).distinct(), key, "left_semi")


def migrate_rules(devices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Devices whose six thresholds are the legacy ones move to the present ones; an audit row for each."""
    legacy = F.forall(F.array(*[F.col(k) == v for k, v in LEGACY_RULES.items()]), lambda x: F.coalesce(x, F.lit(False)))
    marked = devices.withColumn("_legacy", legacy)
    moved = marked.withColumns({k: F.when(F.col("_legacy"), RULES[k]).otherwise(F.col(k)) for k in LEGACY_RULES} | {"version": F.col("version") + F.col("_legacy").cast("int")})
    audit = marked.where("_legacy").select("device_id", F.lit("rules_migrated").alias("action"), (F.col("version") + 1).alias("version"))
    return moved.drop("_legacy"), audit


def _in_order(key: str):
    """A key's changes in the order in which they were made, and those before one."""
    w = Window.partitionBy(key).orderBy("seq")
    return w, w.rowsBetween(Window.unboundedPreceding, -1)


def _dealt(key: str, *tables: DataFrame) -> list[DataFrame]:
    """Tables that meet on a key, dealt by it to tasks of about KEYED_ROWS rows in all."""
    parts = max(tables[0].sparkSession.sparkContext.defaultParallelism, -(-sum(t.count() for t in tables) // KEYED_ROWS))
    return [t.repartition(parts, key) for t in tables]


def update_devices(devices: DataFrame, changes: DataFrame, bounds: dict[str, tuple[float, float]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Devices with changed rules, an audit row for each change that changes something, and the changes refused (out of bounds, or of no known device).

    Changes (device_id, seq and some of the rules; null leaves one as it is) of a device are made one after another; each that
    changes something brings the version up by one.
    """
    wrong = F.exists(F.array(*[~F.col(k).between(*b) for k, b in bounds.items()]), lambda x: F.coalesce(x, F.lit(False)))
    known = devices.select("device_id", "version", *[F.col(k).alias(f"_{k}") for k in bounds])
    marked = changes.join(known, "device_id", "left").withColumn("refused", F.when(wrong, "bounds").when(F.col("version").isNull(), "unknown_device"))
    _, before = _in_order("device_id")
    steps = marked.where("refused IS NULL")
    steps = steps.withColumns({f"_was_{k}": F.coalesce(F.last(k, ignorenulls=True).over(before), f"_{k}") for k in bounds})
    changed = F.exists(F.array(*[F.col(k).isNotNull() & ~F.col(k).eqNullSafe(F.col(f"_was_{k}")) for k in bounds]), lambda x: x)
    steps = steps.withColumn("_changed", changed)
    steps = steps.withColumn("_version", F.col("version") + F.sum(F.col("_changed").cast("int")).over(before.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    log = steps.where("_changed").select("device_id", "seq", F.lit("device_update").alias("action"), F.col("_version").alias("version"), *[F.coalesce(k, f"_was_{k}").alias(k) for k in bounds])
    last = steps.groupBy("device_id").agg(F.max("_version").alias("_version"), *[F.max_by(k, F.when(F.col(k).isNotNull(), F.col("seq"))).alias(f"_{k}") for k in bounds])
    out = devices.join(last, "device_id", "left").withColumns({"version": F.coalesce("_version", "version")} | {k: F.coalesce(f"_{k}", k) for k in bounds})
    return out.drop("_version", *[f"_{k}" for k in bounds]), log, marked.where("refused IS NOT NULL").select(*changes.columns, "refused")


def review_events(events: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events with new states, an audit row for each change, and the changes refused: an unknown state, resolved without a note, no such event.

    Changes (event_id, seq, new_status, new_note) of an event are made one after another; notes are trimmed and cut at 1,000 characters.
    """
    note = F.substring(F.trim(F.coalesce("new_note", F.lit(""))), 1, 1000)
    known = events.select("event_id", F.col("status").alias("_status"), F.lit(True).alias("_there"))
    reason = F.when(~F.coalesce(F.col("new_status").isin("open", "acknowledged", "resolved"), F.lit(False)), "status").when((F.col("new_status") == "resolved") & (note == ""), "note").when(F.col("_there").isNull(), "unknown_event")
    dealt, known = _dealt("event_id", changes, known)
    marked = dealt.join(known, "event_id", "left").withColumn("refused", reason)
    steps = marked.where("refused IS NULL").withColumn("new_note", note)
    w, _ = _in_order("event_id")
    audit = steps.select("event_id", "seq", F.coalesce(F.lag("new_status").over(w), "_status").alias("old_status"), "new_status", "new_note")
    last = steps.groupBy("event_id").agg(F.max_by(F.struct("new_status", "new_note"), "seq").alias("_last"))
    out = events.join(last, "event_id", "left").withColumns({"status": F.coalesce("_last.new_status", "status"), "note": F.coalesce("_last.new_note", "note")})
    return out.drop("_last"), audit, marked.where("refused IS NOT NULL").select(*changes.columns, "refused")


#: A time after all others: where an interval without an end ends.
OPEN_END = 1 << 62


def _ended(df: DataFrame) -> DataFrame:
    return df.withColumn("_end", F.coalesce("end_ms", F.lit(OPEN_END)))


def overlap_conflicts(new: DataFrame, old: DataFrame) -> DataFrame:
    """New intervals that overlap one of the device's old ones; an interval whose end_ms is null goes on for ever.

    Starts and ends of a device stand in order of time: an interval overlaps as many as start up to its end less those
    that end before its start.
    """
    known = _ended(old).select("device_id", F.inline(F.array(_event("start_ms", 1, 0), _event("_end", 0, 1))))
    asked = _ended(new.select("context_id", "device_id", "start_ms", "end_ms"))
    probes = asked.select("device_id", F.inline(F.array(_event("_end", 0, 0, "context_id", "last"), _event("start_ms", 0, 0, "context_id", "first"))))
    # At one time starts come first, then the probes, then ends: what ends before a start ends earlier.
    w = Window.partitionBy("device_id").orderBy("at", F.desc("starts"), "ends").rowsBetween(Window.unboundedPreceding, 0)
    placed = known.unionByName(probes, allowMissingColumns=True).withColumns({"_starts": F.sum("starts").over(w), "_ends": F.sum("ends").over(w)}).where("probe IS NOT NULL")
    hit = placed.groupBy("context_id").agg((F.max(F.when(F.col("probe") == "last", F.col("_starts"))) - F.max(F.when(F.col("probe") == "first", F.col("_ends")))).alias("_n")).where("_n > 0")
    return new.join(hit.select("context_id"), "context_id", "left_semi")


def _event(at: str, starts: int, ends: int, context: str | None = None, probe: str | None = None):
    more = [F.col(context).alias("context_id"), F.lit(probe).alias("probe")] if context else []
    return F.struct(F.col(at).alias("at"), F.lit(starts).alias("starts"), F.lit(ends).alias("ends"), *more)


def install_contexts(contexts: DataFrame, new: DataFrame, now_ms: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """contexts with the new ones (of unknown ids) that overlap neither an old nor an admitted one; those installed; and those refused, with the reason.

    A device's new intervals are admitted in order of (start_ms, context_id). Refused are those that don't end after their start or, with now_ms, start
    in the future (invalid), those of a known id that say something else of it (frozen; what says the same is passed over, also where the known one was closed
    meanwhile), and those that overlap.
    """
    known = contexts.select("context_id", F.col("device_id").alias("_d"), F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"))
    invalid = (F.col("start_ms") >= F.coalesce("end_ms", F.lit(OPEN_END))) | (F.col("start_ms") > (OPEN_END if now_ms is None else now_ms))
    same = (F.col("_d") == F.col("device_id")) & (F.col("_s") == F.col("start_ms")) & (F.col("_e").eqNullSafe(F.col("end_ms")) | F.col("end_ms").isNull())
    marked = new.join(known, "context_id", "left").withColumn("refused", F.when(invalid, "invalid").when(F.col("_d").isNotNull() & ~F.coalesce(same, F.lit(False)), "frozen"))
    fresh = marked.where("refused IS NULL AND _d IS NULL").select(*new.columns)
    against = overlap_conflicts(fresh, contexts).select("context_id")
    free = fresh.join(against, "context_id", "left_anti")
    # One after another: an interval is admitted if it starts after the end of the last one that was.
    each = F.array_sort(F.collect_list(F.struct("start_ms", "context_id", F.coalesce("end_ms", F.lit(OPEN_END)).alias("end"))))
    none = F.struct(F.lit(-OPEN_END).cast("bigint").alias("end"), F.array_repeat(F.lit(None).cast(new.schema["context_id"].dataType), F.lit(0)).alias("ids"))
    admit = lambda a, x: F.when(x["start_ms"] > a["end"], F.struct(x["end"].alias("end"), F.array_append(a["ids"], x["context_id"]).alias("ids"))).otherwise(a)
    admitted = free.groupBy("device_id").agg(F.aggregate(each, none, admit)["ids"].alias("ids")).select(F.explode("ids").alias("context_id"))
    installed = free.join(admitted, "context_id", "left_semi")
    overlapping = fresh.join(admitted, "context_id", "left_anti").withColumn("refused", F.lit("overlap"))
    refused = marked.where("refused IS NOT NULL").select(*new.columns, "refused").unionByName(overlapping)
    return contexts.unionByName(installed), installed, refused


def without_spans(quality: DataFrame, spans: DataFrame) -> DataFrame:
    """Assessments but for those within a span (device_id, start_ms, end_ms or null) of their device: they are made anew."""
    listed = spans.groupBy("device_id").agg(F.collect_list(F.struct("start_ms", F.coalesce("end_ms", F.lit(OPEN_END)).alias("end"))).alias("_spans"))
    inside = F.exists("_spans", lambda s: F.col("t_ms").between(s["start_ms"], s["end"]))
    return quality.join(listed, "device_id", "left").where(~F.coalesce(inside, F.lit(False))).drop("_spans")


def close_contexts(contexts: DataFrame, quality: DataFrame, changes: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """contexts with open ones ended by changes (context_id, end_ms, note), the assessments without those devices' later ones, an audit row each, and the changes refused.

    Refused are changes of a context that isn't there or isn't open (not_open), whose end isn't after the start or is in the future (end), and
    those without a note (note). Of several changes of one context the earliest end closes it; the others find it closed.
    """
    known = contexts.select("context_id", "device_id", F.col("start_ms").alias("_start"), F.col("end_ms").alias("_end"))
    reason = F.when(F.col("device_id").isNull() | F.col("_end").isNotNull(), "not_open").when(F.col("end_ms").isNull() | (F.col("end_ms") <= F.col("_start")) | (F.col("end_ms") > now_ms), "end").when(F.trim(F.coalesce("note", F.lit(""))) == "", "note")
    marked = changes.join(known, "context_id", "left").withColumn("refused", reason)
    first = F.row_number().over(Window.partitionBy("context_id", F.col("refused").isNull()).orderBy("end_ms", "note")) == 1
    marked = marked.withColumn("refused", F.when(F.col("refused").isNull() & ~first, "not_open").otherwise(F.col("refused")))
    closed = marked.where("refused IS NULL").select("context_id", "device_id", F.col("end_ms").alias("_at"), F.trim("note").alias("note"))
    out = contexts.join(closed.select("context_id", "_at"), "context_id", "left").withColumn("end_ms", F.coalesce("_at", "end_ms")).drop("_at").select(*contexts.columns)
    later = closed.select("device_id", (F.col("_at") + 1).alias("start_ms"), F.lit(None).cast("bigint").alias("end_ms"))
    audit = closed.select("context_id", F.lit("context_close").alias("action"), F.col("_at").alias("end_ms"), "note")
    return out, without_spans(quality, later), audit, marked.where("refused IS NOT NULL").select(*changes.columns, "refused")


def backfill(points: DataFrame, quality: DataFrame, version: int, assess) -> DataFrame:
    """quality with assessments for every point that has none of this version.

    Only slices (of an hour, with the one before each, to which a first row looks back) in which a point is missing are assessed.
    """
    key = ["device_id", "t_ms", "protocol"]
    hour = lambda df: df.withColumn("_hour", F.floor(F.col("t_ms") / 3_600_000))
    current = quality.where(F.col("version") == version)
    missing = points.select(*key).join(current.select(*key), key, "left_anti")
    slices = hour(missing).select("device_id", F.explode(F.array(F.col("_hour"), F.col("_hour") - 1)).alias("_hour")).distinct()
    near = hour(points).join(slices, ["device_id", "_hour"], "left_semi").drop("_hour")
    fresh = assess(near).join(missing, key, "left_semi").withColumn("version", F.lit(version))
    return current.unionByName(fresh.select(*current.columns))


def backfill_plan(points: DataFrame, quality: DataFrame, version: int, size: int) -> DataFrame:
    """The hours of devices in which a point has no assessment of this version: device_id, _hour, missing and step, in order of device and hour.

    A step has hours of at least size such points. Steps are numbered from 1 without gaps: an hour of many times size is one step, and no number is left
    out for it. Running sums are in two steps, by device and within one.
    """
    key = ["device_id", "t_ms", "protocol"]
    missing = points.select(*key).join(quality.where(F.col("version") == version).select(*key), key, "left_anti")
    hours = missing.groupBy("device_id", F.floor(F.col("t_ms") / 3_600_000).alias("_hour")).agg(F.count(F.lit(1)).alias("missing"))
    devices = hours.groupBy("device_id").agg(F.sum("missing").alias("_all"))
    order = Window.partitionBy("device_id").orderBy("_hour")
    earlier = Window.orderBy("device_id").rowsBetween(Window.unboundedPreceding, -1)
    before = devices.select("device_id", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_before"))
    inner = F.coalesce(F.sum("missing").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = hours.withColumn("_inner", inner).join(before, "device_id").withColumn("_at", F.floor((F.col("_before") + F.col("_inner")) / size))
    # What begins a step within its device is counted; a device's first hours may go on with the last step of the device before.
    placed = placed.withColumn("_new", F.coalesce(F.col("_at") != F.lag("_at").over(order), F.lit(True)).cast("bigint"))
    ends = placed.groupBy("device_id").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.sum("_new").alias("_steps"))
    ends = ends.withColumn("_on", F.coalesce(F.col("_first") == F.lag("_last").over(Window.orderBy("device_id")), F.lit(False)).cast("bigint"))
    ends = ends.select("device_id", (F.coalesce(F.sum(F.col("_steps") - F.col("_on")).over(earlier), F.lit(0)) - F.col("_on")).alias("_done"))
    numbered = placed.withColumn("_nth", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).join(ends, "device_id")
    return numbered.select("device_id", "_hour", "missing", (F.col("_done") + F.col("_nth")).alias("step"))


def backfill_step(points: DataFrame, quality: DataFrame, hours: DataFrame, version: int, assess) -> DataFrame:
    """Assessments of the points of some hours (device_id, _hour) that have none of this version."""
    key = ["device_id", "t_ms", "protocol"]
    hour = lambda df: df.withColumn("_hour", F.floor(F.col("t_ms") / 3_600_000))
    within = lambda df, h: hour(df).join(h, ["device_id", "_hour"], "left_semi").drop("_hour")
    around = hours.select("device_id", F.explode(F.array("_hour", F.col("_hour") - 1)).alias("_hour")).distinct()
    have = within(quality.where(F.col("version") == version).select(*key), hours)
    fresh = within(assess(within(points, around)), hours).join(have, key, "left_anti")
    return fresh.withColumn("version", F.lit(version)).select(*quality.columns)


def retention_plan(files: DataFrame, used: float, total: float, now_ms: int, start: float = 0.8, target: float = 0.75, running: bool = False, protect_ms: int = 86_400_000) -> DataFrame:
    """files (path, day, mtime_ms, bytes, last_point_ms, pending) with eligible, freed_before and delete.

    Deletion starts at ``start`` of the disk (or goes on if running) and takes the oldest
    eligible files until use is at ``target``. The running sum is in two steps, by day
    and within a day.
    """
    needed = max(0.0, used - target * total) if used >= start * total or running else 0.0
    df = files.withColumn("eligible", (F.coalesce("last_point_ms", F.lit(0)) < now_ms - protect_ms) & (F.col("mtime_ms") < now_ms - protect_ms) & ~F.col("pending"))
    size = F.when(F.col("eligible"), F.col("bytes")).otherwise(0)
    days = df.groupBy("day").agg(F.sum(size).alias("_b"))
    before = days.select("day", F.coalesce(F.sum("_b").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    w = Window.partitionBy("day").orderBy("mtime_ms", "path").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inner", F.coalesce(F.sum(size).over(w), F.lit(0))).join(before, "day").withColumn("freed_before", F.col("_before") + F.col("_inner"))
    return df.withColumn("delete", F.col("eligible") & (F.col("freed_before") < needed)).drop("_before", "_inner")


def apply_retention(points: DataFrame, quality: DataFrame, events: DataFrame, plan: DataFrame, boundary_ms: int, rollups: DataFrame, build) -> dict[str, DataFrame]:
    """Points, assessments, events and rollups that stay, and the device table anew.

    Buckets of the points that go are built again (build: points to rollups) from those that stay around them.
    """
    gone = plan.where("delete").select(F.col("path").alias("source"))
    key = ["device_id", "t_ms", "protocol"]
    kept = points.join(gone, "source", "left_anti")
    minute = lambda df: df.withColumn("bucket_ms", F.floor(F.col("t_ms") / 60_000) * 60_000)
    touched = minute(points.join(gone, "source", "left_semi")).select("device_id", "bucket_ms").distinct()
    around = touched.select("device_id", F.explode(F.array("bucket_ms", F.col("bucket_ms") - 60_000)).alias("bucket_ms")).distinct()
    again = build(minute(kept).join(around, ["device_id", "bucket_ms"], "left_semi").drop("bucket_ms")).join(touched, ["device_id", "bucket_ms"], "left_semi")
    return {
        "points": kept, "quality": quality.join(kept.select(*key), key, "left_semi"), "events": events.where(F.col("end_ms") >= boundary_ms), "devices": device_dim(kept),
        "rollups": rollups.join(touched, ["device_id", "bucket_ms"], "left_anti").unionByName(again, allowMissingColumns=True)}


def verify_snapshot(raw: DataFrame, copy: DataFrame, quality: DataFrame, rollups: dict[int, DataFrame], version: int) -> DataFrame:
    """check and passed: the copy's digest is the raw table's, every point has an assessment, all of this version, and each level's points are all."""
    from .audit import table_digest

    digest = lambda df: table_digest(df).select(F.struct("rows", "digest").alias("d"))
    total = raw.agg(F.count(F.lit(1)).alias("n"))
    out = digest(raw).select(F.lit("raw_digest").alias("check"), (F.col("d") == digest(copy).scalar()).alias("passed"))
    counted = quality.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("version") == version).alias("v"))
    out = out.unionByName(counted.select(F.lit("row_count").alias("check"), (F.col("n") == total.scalar()).alias("passed")))
    out = out.unionByName(counted.select(F.lit("versions").alias("check"), (F.col("n") == F.col("v")).alias("passed")))
    for level, buckets in rollups.items():
        out = out.unionByName(buckets.agg(F.sum("points").alias("n")).select(F.lit(f"rollup_{level}").alias("check"), (F.col("n") == total.scalar()).alias("passed")))
    return out
