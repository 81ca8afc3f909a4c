"""Mergeable rollups, display series and hybrid range reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import CONTIGUOUS_MS, METRICS
from ..functions.scalars import bucket_start, resultant
from .motion import transitions
from .timeline import SLICE_MS, ordered
from .quality import drift_evidence

_ENDS = ["t_ms", "lat", "lon", "speed", "valid_pos", "motion_state", "lat_std", "lon_std"]
#: Spans from which a range query reads the 60 s and the 600 s level.
RAW_BELOW_S, COARSE_FROM_S = 1800, 2 * 86400


def level_for(span_s: float) -> int:
    return 0 if span_s < RAW_BELOW_S else 60 if span_s < COARSE_FROM_S else 600


def _partials(metrics: list[str]):
    for m in metrics:
        yield from (F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"), F.sum(m).alias(f"{m}_sum"), F.count(m).alias(f"{m}_n"), F.max_by(m, F.when(F.col(m).isNotNull(), F.col("t_ms"))).alias(f"{m}_last"))


def _checked(seconds: int) -> None:
    if SLICE_MS % (seconds * 1000):
        raise ValueError("buckets have to divide an hour")


def rollup(view: DataFrame, seconds: int = 60, metrics: list[str] = METRICS) -> DataFrame:
    """One row for each device and bucket; sums over transitions within the bucket only, first and last rows kept for merging.

    ``fixes`` counts rows by fix mode, ``quality`` by mask and reasons (where the view has them). Parts of one bucket,
    as of the head and tail of a range, are merged by ``rerollup`` of the same seconds.
    """
    _checked(seconds)
    df = transitions(view).withColumn("bucket_ms", bucket_start("t_ms", seconds))
    inside = F.coalesce(bucket_start("prev.t_ms", seconds) == F.col("bucket_ms"), F.lit(False))
    # A bucket's own rows make its transitions: a jump or gap from outside is left for the merge.
    sums = {c: F.sum(F.when(inside, F.col(c)).otherwise(0.0)).alias(c) for c in ("covered_s", "moving_s", "distance_m")}
    # One vibration sample a time: that of the extended protocol, the last of a time, if there are two.
    last = F.coalesce(F.lead("t_ms").over(ordered()) != F.col("t_ms"), F.lit(True))
    df = df.withColumn("_force", F.when(last, resultant())).withColumn("_row", F.struct(*_ENDS, "protocol"))
    more = [_histogram(F.col("fix_mode").cast("string")).alias("fixes")]
    if {"mask", "reasons"} <= set(view.columns):
        more.append(_histogram(F.concat_ws("/", F.col("mask").cast("string"), F.col("reasons").cast("string"))).alias("quality"))
    key = ["device_id", "_slice", "bucket_ms"]
    out = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("points"), F.sum(F.col("fix_mode").isin(4, 8).cast("int")).alias("fixed"), F.sum(F.col("valid_pos").cast("int")).alias("valid"),
        (F.max("speed") * 3.6).alias("max_kmh"), *sums.values(), F.sum((inside & F.col("gap")).cast("int")).alias("gaps"),
        F.min("_force").alias("vib_min"), F.max("_force").alias("vib_max"), F.sum("_force").alias("vib_sum"), F.sum(F.col("_force") * F.col("_force")).alias("vib_sq"), F.count("_force").alias("vib_n"),
        F.min_by("_row", F.struct("t_ms", "protocol")).alias("first"), F.max_by("_row", F.struct("t_ms", "protocol")).alias("last"), *more, *_partials(metrics))
    return out.drop("_slice")


def _histogram(value):
    """A map of counts by value; the values of a bucket are no more than its rows."""
    listed = F.sort_array(F.collect_list(value))
    return F.map_from_entries(F.transform(F.array_distinct(listed), lambda v: F.struct(v, F.size(F.filter(listed, lambda x: x == v)).cast("bigint"))))


def _added(column: str):
    """The sum of maps of counts by name."""
    entries = F.flatten(F.collect_list(F.map_entries(column)))
    names = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["key"])))
    return F.map_from_entries(F.transform(names, lambda k: F.struct(k, F.aggregate(F.filter(entries, lambda e: e["key"] == k), F.lit(0).cast("bigint"), lambda a, e: a + e["value"]))))


def seams(buckets: DataFrame, key: list[str]) -> DataFrame:
    """buckets with what lies between each and the one before it in its key: prev (its last row), the own first row's columns, _contiguous, _jump, _covered_s, _moving_s, _distance_m."""
    w = Window.partitionBy(*key).orderBy("first.t_ms", "first.protocol")
    step = buckets.withColumn("prev", F.lag("last").over(w)).withColumns({c: F.col(f"first.{c}") for c in _ENDS})
    contiguous = F.coalesce((F.col("t_ms") - F.col("prev.t_ms")).between(1, CONTIGUOUS_MS), F.lit(False))
    valid = F.coalesce(F.col("prev.valid_pos") & F.col("valid_pos"), F.lit(False))
    step = step.withColumns({"_contiguous": contiguous, "_jump": contiguous & valid & drift_evidence().isNotNull()}).withColumn("_covered", F.col("_contiguous") & valid & ~F.col("_jump"))
    seconds_ = (F.col("t_ms") - F.col("prev.t_ms")) / 1000
    moving = contiguous & F.coalesce((F.col("prev.motion_state") == "moving") & (F.col("motion_state") == "moving"), F.lit(False))
    both = F.col("speed").isNotNull() & F.col("prev.speed").isNotNull()
    return step.withColumns({
        "_covered_s": F.when(F.col("_covered"), seconds_).otherwise(0.0), "_moving_s": F.when(moving, seconds_).otherwise(0.0),
        "_distance_m": F.when(F.col("_covered") & moving & both, (F.col("speed") + F.col("prev.speed")) / 2 * seconds_).otherwise(0.0)})


def rerollup(fine: DataFrame, seconds: int = 600, metrics: list[str] = METRICS) -> DataFrame:
    """Coarser buckets from finer ones, or parts of a bucket as one; transitions between neighbouring parts of one coarse bucket are added."""
    step = seams(fine.withColumn("_coarse", bucket_start("bucket_ms", seconds)), ["device_id", "_coarse"])
    between = {c: F.col(f"_{c}") for c in ("covered_s", "moving_s", "distance_m")}
    gap = F.coalesce(F.col("t_ms") - F.col("prev.t_ms") > CONTIGUOUS_MS, F.lit(False)).cast("int")
    merged = []
    for m in metrics:
        merged += [F.min(f"{m}_min").alias(f"{m}_min"), F.max(f"{m}_max").alias(f"{m}_max"), F.sum(f"{m}_sum").alias(f"{m}_sum"), F.sum(f"{m}_n").alias(f"{m}_n"), F.max_by(f"{m}_last", F.when(F.col(f"{m}_n") > 0, F.col("last.t_ms"))).alias(f"{m}_last")]
    more = [_added(c).alias(c) for c in ("fixes", "quality") if c in fine.columns]
    out = step.groupBy("device_id", "_coarse").agg(
        *[F.sum(c).alias(c) for c in ("points", "fixed", "valid")], F.max("max_kmh").alias("max_kmh"), *[F.sum(F.col(c) + x).alias(c) for c, x in between.items()], F.sum(F.col("gaps") + gap).alias("gaps"),
        F.min("vib_min").alias("vib_min"), F.max("vib_max").alias("vib_max"), F.sum("vib_sum").alias("vib_sum"), F.sum("vib_sq").alias("vib_sq"), F.sum("vib_n").alias("vib_n"),
        F.min_by("first", F.struct("first.t_ms", "first.protocol")).alias("first"), F.max_by("last", F.struct("last.t_ms", "last.protocol")).alias("last"), *more, *merged)
    return out.withColumnRenamed("_coarse", "bucket_ms")


def hybrid_range(view: DataFrame, coarse: DataFrame, start_ms: int, end_ms: int, seconds: int, metrics: list[str] = METRICS, most_rows: int | None = None) -> DataFrame:
    """Buckets of a range, end included: whole ones from the rollup, the ragged head and tail from rows.

    A range without a whole bucket is read from rows alone; with most_rows, one of more rows is an error.
    """
    step = seconds * 1000
    lo, hi = -(-start_ms // step) * step, (end_ms + 1) // step * step
    if lo >= hi:
        rows = view.where(F.col("t_ms").between(start_ms, end_ms))
        if most_rows is not None and rows.limit(most_rows + 1).count() > most_rows:
            raise ValueError(f"more than {most_rows} rows; choose a shorter range")
        return rollup(rows, seconds, metrics)
    edges = view.where(F.col("t_ms").between(start_ms, min(lo - 1, end_ms)) | F.col("t_ms").between(max(hi, start_ms), end_ms))
    return coarse.where((F.col("bucket_ms") >= lo) & (F.col("bucket_ms") < hi)).unionByName(rollup(edges, seconds, metrics), allowMissingColumns=True)


def range_summary(buckets: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """Buckets of a device and range as one row, with the transitions over the seams between them."""
    return rerollup(buckets.withColumn("bucket_ms", F.col("bucket_ms") * 0), 1, metrics).drop("bucket_ms")


def display_series(buckets: DataFrame, start_ms: int, end_ms: int, bins: int = 288, metrics: list[str] | None = None) -> DataFrame:
    """The buckets of a range merged into display bins by the middle of each: mean (last, for angles), least and largest of each metric."""
    metrics = metrics or ["speed", "heading"]
    middle = (F.col("first.t_ms") + F.col("last.t_ms")) / 2
    key = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((middle - start_ms) / (end_ms - start_ms) * bins)))
    df = buckets.where((F.col("last.t_ms") >= start_ms) & (F.col("first.t_ms") <= end_ms)).withColumn("bin", key)
    out = []
    for m in metrics:
        mean = F.max_by(f"{m}_last", F.when(F.col(f"{m}_n") > 0, F.col("bucket_ms"))) if m in ("heading", "course") else F.sum(f"{m}_sum") / F.sum(f"{m}_n")
        out += [mean.alias(m), F.min(f"{m}_min").alias(f"{m}_min"), F.max(f"{m}_max").alias(f"{m}_max")]
    return df.groupBy("device_id", "bin").agg(F.min("first.t_ms").alias("t_ms"), F.sum("points").alias("points"), *out)


def series_ranges(series: DataFrame, metrics: list[str]) -> DataFrame:
    return series.groupBy("device_id").agg(*[f(f"{m}_{s}").alias(f"{m}_{s}") for m in metrics for s, f in (("min", F.min), ("max", F.max))])


def vibration_trend(buckets: DataFrame) -> DataFrame:
    """Mean, rms and peak of the resultant in each bucket."""
    mean = F.col("vib_sum") / F.col("vib_n")
    rms = F.sqrt(F.greatest(F.lit(0.0), F.col("vib_sq") / F.col("vib_n") - mean * mean))
    peak = F.greatest(F.abs(F.col("vib_min") - 1), F.abs(F.col("vib_max") - 1))
    return buckets.where("vib_n > 0").select("device_id", "bucket_ms", mean.alias("mean"), rms.alias("rms"), peak.alias("peak"), F.col("vib_n").alias("n"))


def vibration_range(buckets: DataFrame) -> DataFrame:
    """Pooled rms within buckets, largest peak and span, and mean for each device."""
    within = F.col("vib_sq") - F.col("vib_sum") * F.col("vib_sum") / F.col("vib_n")
    df = buckets.where("vib_n > 0")
    peak = F.greatest(F.abs(F.col("vib_min") - 1), F.abs(F.col("vib_max") - 1))
    return df.groupBy("device_id").agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(within) / F.sum("vib_n"))).alias("rms"), F.max(peak).alias("peak"), F.max(F.col("vib_max") - F.col("vib_min")).alias("span"), (F.sum("vib_sum") / F.sum("vib_n")).alias("mean"))


def bucket_state(segments: DataFrame, seconds: int = 60) -> DataFrame:
    """Motion state of most of each bucket by the time of segments in it (at least 0.1 s each), ties to moving; a segment counts in every bucket that it touches."""
    step = seconds * 1000
    first, last = F.floor(F.col("start_ms") / step), F.floor(F.col("end_ms") / step)
    df = segments.withColumn("_bucket", F.explode(F.sequence(first, last))).withColumn("bucket_ms", F.col("_bucket") * step)
    within = F.least(F.col("end_ms"), F.col("bucket_ms") + step) - F.greatest(F.col("start_ms"), F.col("bucket_ms"))
    weight = F.greatest(within / 1000, F.lit(0.1))
    summed = df.groupBy("device_id", "bucket_ms", "motion_state").agg(F.sum(weight).alias("w"))
    order = F.struct(F.round("w", 6), (F.col("motion_state") == "moving").cast("int"), F.col("motion_state"))
    return summed.groupBy("device_id", "bucket_ms").agg(F.max_by("motion_state", order).alias("state"), F.max("w").alias("seconds"))


def rollup_status(view: DataFrame, levels: dict[int, DataFrame], tolerance: int = 600) -> DataFrame:
    """For each device and level: buckets, points, raw count and whether they agree within the tolerance."""
    raw = view.groupBy("device_id").agg(F.count(F.lit(1)).alias("raw"))
    parts = None
    for level, buckets in levels.items():
        one = buckets.groupBy("device_id").agg(F.count(F.lit(1)).alias("buckets"), F.sum("points").alias("points")).withColumn("level", F.lit(level))
        parts = one if parts is None else parts.unionByName(one)
    return raw.join(parts, "device_id").withColumn("ready", F.abs(F.col("raw") - F.col("points")) <= tolerance)


def touched_buckets(batch: DataFrame, levels: tuple[int, ...] = (60, 600)) -> DataFrame:
    """Distinct (device_id, level, bucket_ms) of a batch's rows."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("level"), bucket_start("t_ms", s).alias("bucket_ms")) for s in levels]))
    return batch.select("device_id", each.alias("b")).select("device_id", "b.*").distinct()


def coalesce_intervals(intervals: DataFrame, pad_ms: int = 0) -> DataFrame:
    """Union of a device's overlapping or adjoining intervals (start_ms, end_ms)."""
    w = Window.partitionBy("device_id").orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = intervals.withColumn("_new", F.coalesce(F.col("start_ms") > reach + pad_ms, F.lit(True)).cast("int"))
    df = df.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy("device_id", "_run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("_run")


def unknown_codes(rows: DataFrame, column: str, registry: list[str]) -> DataFrame:
    return rows.select(F.explode(F.split(column, r"\|")).alias("code")).where((F.col("code") != "") & ~F.col("code").isin(registry)).distinct()
