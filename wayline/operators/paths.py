"""Segments and track inside rollup buckets, mergeable over the seams between them.

A bucket has its runs of one motion state (segments) and the first and last valid points of its unbroken runs (track). Whether
its first segment goes on from the bucket before, and what lies between, follows from that bucket's last row and
its own first, so that any level, and any range of buckets and parts of buckets, gives the segments and track of its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import CONTIGUOUS_MS
from ..functions.scalars import bucket_start
from .motion import track, transitions
from .quality import drift_evidence
from .rollup import rerollup, rollup, seams
from .timeline import run_number, slice_of, with_runs

_SEGMENT = ["start_ms", "end_ms", "motion_state", "distance_m", "fast", "samples"]


def bucket_paths(view: DataFrame, seconds: int = 60) -> DataFrame:
    """device_id, bucket_ms, segments and track of each bucket by itself."""
    df = transitions(view).withColumn("bucket_ms", bucket_start("t_ms", seconds))
    within = bucket_start("prev.t_ms", seconds) == F.col("bucket_ms")
    goes_on = within & (F.col("prev.motion_state") == F.col("motion_state")) & F.col("contiguous") & ~F.col("jump")
    df = df.withColumn("_new", ~F.coalesce(goes_on, F.lit(False)))
    df = with_runs(df, F.col("_new"))
    inside = F.when(F.col("_new"), 0.0).otherwise(F.col("distance_m"))
    parts = df.groupBy("device_id", "_slice", "bucket_ms", "_run", "motion_state").agg(
        F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("end_ms"), F.sum(inside).alias("distance_m"), F.max("speed").alias("fast"), F.count(F.lit(1)).alias("samples"))
    segments = parts.groupBy("device_id", "bucket_ms").agg(_listed(F.col("_run"), _SEGMENT).alias("segments"))
    points = track(view, seconds)
    kept = [c for c in points.columns if c not in ("device_id", "bucket_ms")]
    tracks = points.groupBy("device_id", "bucket_ms").agg(_listed(F.col("t_ms"), kept).alias("track"))
    return segments.join(tracks, ["device_id", "bucket_ms"], "left")


def _listed(order, columns: list[str]):
    """A group's rows in order, as an array of structs."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("_o"), F.struct(*columns).alias("_x")))), lambda s: s["_x"])


def path_rollup(view: DataFrame, seconds: int = 60, metrics: list[str] | None = None) -> DataFrame:
    """Rollups with segments and track."""
    more = {} if metrics is None else {"metrics": metrics}
    return rollup(view, seconds, **more).join(bucket_paths(view, seconds), ["device_id", "bucket_ms"])


def _segment_rows(buckets: DataFrame, key: list[str]) -> DataFrame:
    """The segments of buckets within a key, each with _new: false where it goes on from the one before."""
    df = seams(buckets, key)
    state = F.col("motion_state") == F.col("prev.motion_state")
    df = df.withColumn("_joined", F.col("_contiguous") & ~F.col("_jump") & F.coalesce(state, F.lit(False)))
    rows = df.select(*key, F.col("first.t_ms").alias("_at"), F.col("first.protocol").alias("_protocol"), "_joined", F.col("_distance_m").alias("_between"), F.posexplode("segments").alias("_k", "s"))
    rows = rows.select(*key, "_at", "_protocol", "_k", ((F.col("_k") > 0) | ~F.col("_joined")).alias("_new"), "_between", "s.*")
    return rows.withColumn("distance_m", F.col("distance_m") + F.when(F.col("_new"), 0.0).otherwise(F.col("_between")))


_MERGED = [F.min, F.max, F.first, F.sum, F.max, F.sum]


def _track_rows(buckets: DataFrame, key: list[str]) -> DataFrame:
    """The track points of buckets within a key; whether a bucket's first point goes on from the one before is told anew."""
    df = buckets.where(F.size("track") > 0).withColumn("_end", F.element_at("track", -1))
    w = Window.partitionBy(*key).orderBy("first.t_ms", "first.protocol")
    rows = df.withColumn("prev", F.lag("_end").over(w)).select(*key, "prev", F.posexplode("track").alias("_k", "p")).select(*key, "prev", "_k", "p.*")
    broken = F.col("prev").isNull() | (F.col("t_ms") - F.col("prev.t_ms") > CONTIGUOUS_MS) | drift_evidence().isNotNull()
    # Parts of one bucket may share a time, of which the later projection stays; it isn't parted from itself.
    again = (F.col("_k") == 0) & F.coalesce(F.col("prev.t_ms") == F.col("t_ms"), F.lit(False))
    rows = rows.withColumn("break_before", F.when(again, F.col("prev.break_before")).when(F.col("_k") == 0, broken).otherwise(F.col("break_before")))
    cols = [c for c in rows.columns if c not in (*key, "prev", "_k", "t_ms")]
    return rows.groupBy(*key, "t_ms").agg(F.max_by(F.struct(*cols), "_k" if "protocol" not in cols else F.struct("protocol")).alias("_p")).select(*key, "t_ms", "_p.*")


def merged_paths(fine: DataFrame, seconds: int = 600) -> DataFrame:
    """segments and track of coarser buckets from finer ones."""
    df = fine.withColumn("_coarse", bucket_start("bucket_ms", seconds))
    key = ["device_id", "_coarse"]
    rows = _segment_rows(df, key)
    w = Window.partitionBy(*key).orderBy("_at", "_protocol", "_k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.sum(F.col("_new").cast("bigint")).over(w))
    merged = rows.groupBy(*key, "_run").agg(*[f(c).alias(c) for f, c in zip(_MERGED, _SEGMENT)])
    segments = merged.groupBy(*key).agg(_listed(F.col("_run"), _SEGMENT).alias("segments"))
    points = _track_rows(df, key)
    kept = [c for c in points.columns if c not in key]
    tracks = points.groupBy(*key).agg(_listed(F.col("t_ms"), kept).alias("track"))
    return segments.join(tracks, key, "left").withColumnRenamed("_coarse", "bucket_ms")


def path_rerollup(fine: DataFrame, seconds: int = 600, metrics: list[str] | None = None) -> DataFrame:
    """Coarser rollups with segments and track."""
    more = {} if metrics is None else {"metrics": metrics}
    return rerollup(fine, seconds, **more).join(merged_paths(fine, seconds), ["device_id", "bucket_ms"])


def segments_from(buckets: DataFrame) -> DataFrame:
    """The motion segments of a range's buckets, as motion_segments gives them of its rows."""
    rows = _segment_rows(buckets, ["device_id"]).withColumn("_slice", slice_of("_at"))
    w = Window.partitionBy("device_id", "_slice").orderBy("_at", "_protocol", "_k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.sum(F.col("_new").cast("bigint")).over(w))
    parts = rows.groupBy("device_id", "_slice", "_run").agg(*[f(c).alias(c) for f, c in zip(_MERGED, _SEGMENT)])
    merged = parts.withColumn("segment", run_number()).groupBy("device_id", "segment").agg(*[f(c).alias(c) for f, c in zip(_MERGED, _SEGMENT)])
    return merged.select("device_id", "segment", "motion_state", "start_ms", "end_ms", "distance_m", (F.col("fast") * 3.6).alias("max_kmh"), "samples")


def track_from(buckets: DataFrame) -> DataFrame:
    """The track of a range's buckets."""
    return _track_rows(buckets, ["device_id"])
