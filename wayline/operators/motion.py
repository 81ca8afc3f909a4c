"""Transitions, trips, gaps, motion segments, tracks and stops, over the projected view."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import CONTIGUOUS_MS
from ..functions.scalars import haversine_m, position_confidence
from .quality import drift_evidence
from .timeline import ordered, run_number, slice_of, with_neighbours, with_previous, with_rank, with_runs

_STATE = ["t_ms", "lat", "lon", "speed", "valid_pos", "motion_state", "lat_std", "lon_std"]


def transitions(view: DataFrame) -> DataFrame:
    """view with what lies between each row and the one before: delta_ms, contiguous, jump, covered_s, moving_s, distance_m, gap.

    Where prev is null, as a slice begins, a gap is before the row or the device begins with it. Keeps prev and _slice.
    """
    df = with_previous(view, _STATE)
    df = df.withColumn("delta_ms", F.col("t_ms") - F.col("prev.t_ms"))
    contiguous = F.coalesce(F.col("delta_ms").between(1, CONTIGUOUS_MS), F.lit(False))
    valid = F.coalesce(F.col("prev.valid_pos") & F.col("valid_pos"), F.lit(False))
    df = df.withColumn("contiguous", contiguous).withColumn("jump", contiguous & valid & drift_evidence().isNotNull())
    covered = F.col("contiguous") & valid & ~F.col("jump")
    moving = F.col("contiguous") & F.coalesce((F.col("prev.motion_state") == "moving") & (F.col("motion_state") == "moving"), F.lit(False))
    seconds = F.col("delta_ms") / 1000
    metres = F.when(covered & moving & F.col("speed").isNotNull() & F.col("prev.speed").isNotNull(), (F.col("speed") + F.col("prev.speed")) / 2 * seconds).otherwise(0.0)
    return df.withColumns({
        "covered_s": F.when(covered, seconds).otherwise(0.0), "moving_s": F.when(moving, seconds).otherwise(0.0), "distance_m": metres,
        "gap": F.coalesce(F.col("delta_ms") > CONTIGUOUS_MS, F.lit(False))})


def trip_summary(view: DataFrame) -> DataFrame:
    """A row for each device: distance, times, maximum speed, shares and rate of samples."""
    df = transitions(view)
    n = F.count(F.lit(1))
    span = (F.max("t_ms") - F.min("t_ms")) / 1000
    return df.groupBy("device_id").agg(
        n.alias("samples"), (F.sum("distance_m") / 1000).alias("distance_km"), F.sum("moving_s").alias("moving_s"), F.sum("covered_s").alias("covered_s"),
        (F.max("speed") * 3.6).alias("max_kmh"), (F.sum(F.col("fix_mode").isin(4, 8).cast("int")) / n * 100).alias("fixed_pct"),
        (F.sum(F.col("valid_pos").cast("int")) / n * 100).alias("valid_pct"), (F.sum(F.col("gap").cast("int")) + F.sum(F.col("prev").isNull().cast("int")) - 1).alias("gaps"),
        (F.count("speed") / n * 100).alias("speed_pct"), F.when(span > 0, (n - 1) / span).alias("sample_hz"))


def gaps(points: DataFrame, threshold_ms: int = CONTIGUOUS_MS) -> DataFrame:
    """device_id, start_ms and end_ms of each silence longer than the threshold."""
    df = points.withColumn("_slice", slice_of()).withColumn("_before", F.lag("t_ms").over(ordered()))
    silence = F.when(F.col("t_ms") - F.col("_before") > threshold_ms, F.struct(F.col("_before").alias("start_ms"), F.col("t_ms").alias("end_ms")))
    slices = df.groupBy("device_id", "_slice").agg(F.min("t_ms").alias("_first"), F.max("t_ms").alias("_last"), F.collect_list(silence).alias("_inner"))
    before = F.lag("_last").over(Window.partitionBy("device_id").orderBy("_slice"))
    between = F.when(F.col("_first") - before > threshold_ms, F.array(F.struct(before.alias("start_ms"), F.col("_first").alias("end_ms")))).otherwise(F.array().cast("array<struct<start_ms:bigint,end_ms:bigint>>"))
    return slices.withColumn("_between", between).select("device_id", F.explode(F.concat("_between", "_inner")).alias("g")).select("device_id", "g.*")


def motion_segments(view: DataFrame) -> DataFrame:
    """Runs of one motion state: a new one where the state changes, time is not contiguous or the position jumps."""
    df = transitions(view)
    new = F.col("prev").isNull() | (F.col("prev.motion_state") != F.col("motion_state")) | ~F.col("contiguous") | F.col("jump")
    df = with_runs(df.withColumn("_new", new), F.col("_new"))
    inside = F.when(F.col("_new"), 0.0).otherwise(F.col("distance_m"))
    parts = df.groupBy("device_id", "_slice", "_run", "motion_state").agg(F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("end_ms"), F.sum(inside).alias("distance_m"), F.max("speed").alias("_fast"), F.count(F.lit(1)).alias("samples"))
    return parts.withColumn("segment", run_number()).groupBy("device_id", "segment", "motion_state").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("distance_m").alias("distance_m"), (F.max("_fast") * 3.6).alias("max_kmh"), F.sum("samples").alias("samples"))


def segment_report(segments: DataFrame, least_s: float = 30.0, limit: int = 1000) -> DataFrame:
    """The first segments of at least so many seconds (a report: limit is part of it)."""
    return segments.where(F.col("end_ms") - F.col("start_ms") >= least_s * 1000).orderBy("start_ms", "device_id", "segment").limit(limit)


def track(view: DataFrame, bucket_s: int = 60) -> DataFrame:
    """First and last valid points of each unbroken run in a bucket; break_before tells that a run begins. A bucket lies within one slice."""
    kept = F.struct("lat", "lon", "speed", "motion_state", "fix_mode", "nav_mode", "lat_std", "lon_std", "valid_pos", "protocol")
    points = view.where("valid_pos").groupBy("device_id", "t_ms").agg(F.max_by(kept, "protocol").alias("p")).select("device_id", "t_ms", "p.*")
    points = with_previous(points, ["t_ms", "lat", "lon", "speed"])
    broken = F.col("prev").isNull() | (F.col("t_ms") - F.col("prev.t_ms") > CONTIGUOUS_MS) | drift_evidence().isNotNull()
    points = with_runs(points.withColumn("break_before", broken), F.col("break_before"))
    points = points.withColumn("bucket_ms", F.floor(F.col("t_ms") / (bucket_s * 1000)) * bucket_s * 1000)
    run = Window.partitionBy("device_id", "_slice", "bucket_ms", "_run")
    ends = points.withColumn("_a", F.min("t_ms").over(run)).withColumn("_b", F.max("t_ms").over(run))
    return ends.where((F.col("t_ms") == F.col("_a")) | (F.col("t_ms") == F.col("_b"))).drop("prev", "_slice", "_run", "_a", "_b")


def thin_track(points: DataFrame, most: int = 20_000) -> DataFrame:
    """At most ``most`` points of each device, evenly by rank, the ends kept (thinning is the feature)."""
    ranked = with_rank(points, "_rank", "_n")
    # The i-th pick is rank bround(i * (n - 1) / (most - 1)), from 0: a rank is a pick if one of the i next to it gives it.
    place = F.col("_rank") - 1
    near = F.round(place * (most - 1) / (F.col("_n") - 1))
    picked = F.exists(F.array(near - 1, near, near + 1), lambda i: (i >= 0) & (i <= most - 1) & (F.bround(i * (F.col("_n") - 1) / (most - 1)) == place))
    return ranked.where((F.col("_n") <= most) | picked).drop("_rank", "_n")


def stop_groups(segments: DataFrame, gap_ms: int = CONTIGUOUS_MS) -> DataFrame:
    """Stationary segments of a device that follow each other within the gap, as one stop."""
    w = Window.partitionBy("device_id").orderBy("start_ms", "segment")
    parts = segments.where("motion_state = 'stationary'").withColumn("_gap", F.col("start_ms") - F.lag("end_ms").over(w))
    parts = parts.withColumn("stop", F.sum(F.when(F.col("_gap").between(0, gap_ms), 0).otherwise(1)).over(w))
    return parts.groupBy("device_id", "stop").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("parts"), F.sum("samples").alias("samples"))


def _in_stop(points: DataFrame, stops: DataFrame) -> DataFrame:
    """points (device_id, t_ms) with the stop that holds them; minutes make the range join an equality join, so that few stops meet a point."""
    minute = 60_000
    more = [c for c in stops.columns if c not in ("device_id", "stop", "start_ms", "end_ms", "samples", "parts")]
    cells = stops.select(F.col("device_id").alias("_d"), "stop", "start_ms", "end_ms", *more, F.explode(F.sequence(F.floor(F.col("start_ms") / minute), F.floor(F.col("end_ms") / minute))).alias("_minute"))
    keyed = points.withColumn("_at", F.floor(F.col("t_ms") / minute))
    on = (keyed["device_id"] == cells["_d"]) & (keyed["_at"] == cells["_minute"]) & F.col("t_ms").between(F.col("start_ms"), F.col("end_ms"))
    return keyed.join(cells, on).drop("_d", "_minute", "_at")


def stop_neighbours(stops: DataFrame, moving: DataFrame) -> DataFrame:
    """stops with the last moving point before and the first after (structs t_ms, lat, lon)."""
    point = "struct<t_ms:bigint,lat:double,lon:double>"
    edge = F.explode(F.array(F.struct(F.col("start_ms").alias("t_ms"), F.lit(0).alias("kind")), F.struct(F.col("end_ms").alias("t_ms"), F.lit(2).alias("kind"))))
    marks = stops.select("device_id", "stop", F.struct(*stops.columns).alias("_stop"), edge.alias("e")).select("device_id", "e.t_ms", "e.kind", F.lit(None).cast(point).alias("p"), "stop", "_stop")
    rows = moving.select("device_id", "t_ms", F.lit(1).alias("kind"), F.struct(F.col("t_ms").cast("bigint").alias("t_ms"), "lat", "lon").alias("p"))
    both = marks.unionByName(rows, allowMissingColumns=True)
    found = with_neighbours(both, "p", ["device_id"], slice_of(), ["t_ms", "kind"]).where("stop IS NOT NULL")
    near = found.groupBy("device_id", "stop").agg(F.first("_stop").alias("_stop"), F.max(F.when(F.col("kind") == 0, F.col("before"))).alias("before"), F.max(F.when(F.col("kind") == 2, F.col("after"))).alias("after"))
    return near.select("_stop.*", "before", "after")


def stationary_anchor(view: DataFrame, stops: DataFrame, tolerance_m: float = 2.0) -> DataFrame:
    """One position for each stop: of the candidates within the tolerance of the nearest to the target the most credible.

    The target is the midpoint of the moving neighbours, or the one there is, or the first candidate.
    """
    around = stop_neighbours(stops, view.where("valid_pos AND motion_state = 'moving'"))
    rows = _in_stop(view.where("valid_pos AND motion_state = 'stationary'").withColumn("confidence", position_confidence()), around)
    stop = Window.partitionBy("device_id", "stop")
    rows = rows.withColumn("_first", F.min(F.struct("t_ms", "lat", "lon")).over(stop))
    middle = lambda c: F.coalesce((F.col(f"before.{c}") + F.col(f"after.{c}")) / 2, F.col(f"before.{c}"), F.col(f"after.{c}"), F.col(f"_first.{c}"))
    rows = rows.withColumns({"_mid_lat": middle("lat"), "_mid_lon": middle("lon")}).withColumn("_away", haversine_m("_mid_lat", "_mid_lon", "lat", "lon")).drop("_mid_lat", "_mid_lon").withColumn("_least", F.min("_away").over(stop))
    fit = rows.where(F.col("_away") <= F.col("_least") + tolerance_m)
    best = fit.groupBy("device_id", "stop").agg(F.max_by(F.struct("lat", "lon", "t_ms", "confidence"), F.struct("confidence", -F.col("_away"), -F.col("t_ms"))).alias("a"))
    return best.select("device_id", "stop", F.col("a.lat").alias("anchor_lat"), F.col("a.lon").alias("anchor_lon"), F.col("a.t_ms").alias("anchor_ms"), F.col("a.confidence").alias("confidence"))


def bounded_candidates(rows: DataFrame, keys: list[str], most: int = 32) -> DataFrame:
    """At most ``most`` candidates (t_ms, confidence) of each key: half the most credible, half even in time (the bound is the feature)."""
    half = most // 2
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("confidence"), "t_ms"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("t_ms")) - 1
    total = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    df = rows.withColumn("_rank", rank).withColumn("_place", place).withColumn("_n", total)
    picks = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / (half - 1)).cast("int"))
    return df.where((F.col("_n") <= most) | (F.col("_rank") <= half) | F.array_contains(picks, F.col("_place").cast("int"))).drop("_rank", "_place", "_n")


def anchor_track(points: DataFrame, stops: DataFrame, anchors: DataFrame) -> DataFrame:
    """Track points with anchored positions inside stops; source says which they have."""
    held = _in_stop(points.where("motion_state = 'stationary'").select("device_id", "t_ms", "protocol"), stops).select("device_id", "t_ms", "protocol", "stop")
    placed = held.join(anchors, ["device_id", "stop"]).select("device_id", "t_ms", "protocol", "anchor_lat", "anchor_lon")
    out = points.join(placed, ["device_id", "t_ms", "protocol"], "left")
    return out.withColumns({"source": F.when(F.col("anchor_lat").isNotNull(), "anchor").otherwise("measured"), "lat": F.coalesce("anchor_lat", "lat"), "lon": F.coalesce("anchor_lon", "lon")}).drop("anchor_lat", "anchor_lon")
