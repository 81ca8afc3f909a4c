"""Operators over display series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .timeline import slice_of, with_neighbours


def speed_rate(series: DataFrame, bucket_ms: int = 60_000) -> DataFrame:
    """Change of speed from bin to bin in m/s², null across missing values or breaks."""
    w = Window.partitionBy("device_id").orderBy("t_ms")
    step = F.col("t_ms") - F.lag("t_ms").over(w)
    most = max(3000.0, 2.2 * bucket_ms)
    return series.withColumn("rate", F.when(step <= most, (F.col("speed") - F.lag("speed").over(w)) / (step / 1000)))


def break_series(series: DataFrame, bucket_ms: int = 60_000, angle: str = "heading", gaps: DataFrame | None = None) -> DataFrame:
    """series with an empty row 1 ms before every row that follows a break, a listed gap (start_ms, end_ms) or a turn of more than 180 degrees."""
    w = Window.partitionBy("device_id").orderBy("t_ms")
    before = F.lag("t_ms").over(w)
    turn = F.abs(F.col(angle) - F.lag(angle).over(w)) > 180
    df = series.withColumn("_before", before).withColumn("_cut", F.coalesce((F.col("t_ms") - F.col("_before") > max(3000.0, 2.2 * bucket_ms)) | turn, F.lit(False)))
    if gaps is not None:
        # A gap lies between two rows of the series if it begins at or after the first and ends at or before the second.
        ends = with_neighbours(
            df.select("device_id", "t_ms", F.lit(None).cast("bigint").alias("start"), F.lit(1).alias("kind"), F.struct(*df.columns).alias("_row"))
            .unionByName(gaps.select("device_id", F.col("end_ms").alias("t_ms"), F.col("start_ms").alias("start"), F.lit(0).alias("kind")), allowMissingColumns=True),
            "start", ["device_id"], slice_of(), ["t_ms", "kind"], "last_gap", None)
        df = ends.where("kind = 1").select("_row.*", "last_gap").withColumn("_cut", F.col("_cut") | F.coalesce(F.col("last_gap") >= F.col("_before"), F.lit(False)))
    rows = F.when(F.col("_cut"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    out = df.withColumn("is_break", F.explode(rows))
    names = [c for c in series.columns if c not in ("device_id", "t_ms")]
    return out.select("device_id", F.when(F.col("is_break"), F.col("t_ms") - 1).otherwise(F.col("t_ms")).alias("t_ms"), *[F.when(~F.col("is_break"), F.col(c)).alias(c) for c in names], "is_break")


def nearest_asof(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """left (device_id, t_ms, key) with the nearest right row in time, the earlier of two as near, and the next at or after."""
    kind = left.schema["key"].dataType
    point = F.struct(F.col("t_ms").cast("bigint").alias("t"), F.col(value).cast("double").alias("v"))
    # A left row stands between the right rows of its time for the search back (0, 1) and for that on (1, 2).
    l = left.select("device_id", "t_ms", "key", F.lit(None).cast("struct<t:bigint,v:double>").alias("r"), F.lit(1).alias("side"))
    r = right.select("device_id", "t_ms", F.lit(None).cast(kind).alias("key"), point.alias("r"), F.explode(F.array(F.lit(0), F.lit(2))).alias("side"))
    found = with_neighbours(l.unionByName(r), "r", ["device_id"], slice_of(), ["t_ms", "side"], "_back", "_on").where("side = 1")
    earlier = F.col("_on").isNull() | (F.col("t_ms") - F.col("_back.t") <= F.col("_on.t") - F.col("t_ms"))
    near = F.when(F.col("_back").isNotNull() & earlier, F.col("_back")).otherwise(F.col("_on"))
    return found.select("device_id", "t_ms", "key", near["t"].alias("near_ms"), near["v"].alias("near_value"), F.col("_on.t").alias("next_ms"), F.col("_back").alias("before"), F.col("_on").alias("after"))


def interpolate(left: DataFrame, right: DataFrame, value: str, gap_ms: int = 3000) -> DataFrame:
    """Linear between the neighbours of each time; nearest where they are further apart than the gap or one is missing."""
    df = nearest_asof(left, right, value)
    span = F.col("after.t") - F.col("before.t")
    between = F.when(span == 0, F.col("before.v")).when((span > 0) & (span <= gap_ms), F.col("before.v") + (F.col("after.v") - F.col("before.v")) * (F.col("t_ms") - F.col("before.t")) / span)
    return df.select("device_id", "t_ms", "key", F.coalesce(between, F.col("near_value")).alias("value"), between.isNotNull().alias("interpolated"))


def events_on_series(events: DataFrame, series: DataFrame) -> DataFrame:
    """events with the first bin of the series at or after their peak."""
    left = events.select("device_id", F.col("peak_ms").alias("t_ms"), "kind").distinct().withColumnRenamed("kind", "key")
    found = nearest_asof(left, series.withColumn("_v", F.lit(0.0)), "_v").select("device_id", F.col("t_ms").alias("peak_ms"), F.col("key").alias("kind"), F.col("next_ms").alias("bin_ms"))
    return events.join(found, ["device_id", "peak_ms", "kind"], "left")


def coverage(intervals: DataFrame, lo: int, hi: int, joint_ms: int = 1000) -> DataFrame:
    """Whether each device's intervals cover [lo, hi] with joints up to joint_ms."""
    w = Window.partitionBy("device_id").orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, -1)
    df = intervals.where((F.col("end_ms") >= lo) & (F.col("start_ms") <= hi)).withColumn("_reach", F.max("end_ms").over(w))
    late = F.max((F.col("start_ms") > F.coalesce("_reach", F.lit(lo)) + joint_ms).cast("int"))
    return df.groupBy("device_id").agg(((late == 0) & (F.max("end_ms") + joint_ms >= hi)).alias("covered"), F.count(F.lit(1)).alias("intervals"))


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """A page (from 0, at most the last one) with its number and whether more follow (paging is the feature)."""
    total = df.count()
    number = max(0, min(number, (total - 1) // size))
    return df.orderBy(*order).offset(number * size).limit(size).withColumn("page", F.lit(number)).withColumn("has_more", F.lit(total > (number + 1) * size))


def keyset_page(df: DataFrame, keys: list[str], after: tuple | None, limit: int) -> DataFrame:
    """The rows below a key, in descending order of the keys."""
    if after is not None:
        df = df.where(F.struct(*keys) < F.struct(*[F.lit(a).alias(k) for k, a in zip(keys, after)]))
    return df.orderBy(*[F.desc(k) for k in keys]).limit(limit)


def rank_fleet(df: DataFrame, keyword: str | None = None, filters: dict | None = None, sort: str = "risk", texts: list[str] = ()) -> DataFrame:
    """Fleet rows that hold the keyword and match the filters, by risk, health or id."""
    if keyword:
        df = df.where(F.contains(F.lower(F.concat_ws(" ", *texts)), F.lit(keyword.lower())))
    for k, v in (filters or {}).items():
        df = df.where(F.col(k) == v)
    return df.orderBy(*({"risk": [F.desc("risk"), "id"], "health": [F.desc("health"), "id"]}.get(sort, ["id"])))
