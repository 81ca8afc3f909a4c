"""Audits and distributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import MAX_SPEED, MOTION_G
from ..functions.scalars import angle_delta, haversine_m, local_day, local_hour, peak_deviation, valid_position
from .timeline import with_neighbours

# Floors of a fitted context and metres for a degree.
FLOORS = {"alt": 10.0, "speed": 0.3, "ve": 0.3, "vn": 0.3, "vu": 0.5, "gx": 0.15, "gy": 0.15, "gz": 0.15, "ax": 0.02, "ay": 0.02, "az": 0.02}
CIRCULAR = {"pitch": 1.0, "roll": 1.0}
DEGREE_M = 111195.0

STATES = ("moving", "stationary", "unknown")
# Reasons of the effective speed, and the channels of a window's audit.
SPEED_REASONS = ("gpchcx_speed", "vibration_stationary", "navigation_drift", "non_gpchcx", "missing_speed", "velocity_solution_outlier", "motion_unknown")
WINDOW_CHANNELS = ["speed", "heading", "pitch", "roll", "gx", "gy", "gz", "ax", "ay", "az", "ve", "vn", "vu", "alt"]


#: Quantiles of keys of up to SMALL rows are read off all their values; of larger keys, off those within MARGIN of a quantile, told by a sketch of
#: an error of 1 / ACCURACY.
SMALL, MARGIN, ACCURACY = 20_000, 5e-4, 20_000


def interpolated(rows: DataFrame, by: list[str], at: dict[str, float], value: str = "value") -> DataFrame:
    """Linearly interpolated quantiles of value for each key, a column for each name in at; exact.

    A sketch of each key (merged over tasks) gives for each quantile a bracket of values in which its place lies. A second pass counts,
    before the shuffle, the rows below each bracket, and the equal values within it: so no key's values meet in one task, but about a
    thousandth of them for each quantile, and those of small keys.
    """
    names, m = sorted(at, key=lambda k: at[k]), len(at)
    known = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    low, high = ([float(min(1.0, max(0.0, at[k] + d))) for k in names] for d in (-MARGIN, MARGIN))
    sketch = known.groupBy(*by).agg(F.count(F.lit(1)).alias("_total"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.percentile_approx("_v", low + high, ACCURACY).alias("_q"))
    few = F.col("_total") <= SMALL
    sketch = sketch.select(
        *[F.col(k).alias(f"_k_{k}") for k in by], "_total", F.when(few, F.array_repeat("_min", m)).otherwise(F.slice("_q", 1, m)).alias("_low"), F.when(few, F.array_repeat("_max", m)).otherwise(F.slice("_q", m + 1, m)).alias("_high"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by])
    joined = known.join(sketch, same)
    # A row counts below the brackets whose lower ends are above it (a mark, _j the first of them), and stands in those that hold it.
    # Those below no bracket need no mark. Written out for each quantile: functions over arrays aren't compiled, and this is done for every value.
    first = reduce(lambda a, b: a + b, [(F.col("_low")[i] <= F.col("_v")).cast("int") for i in range(m)])
    mark = F.when(first < m, F.struct(F.lit(True).alias("below"), first.alias("_j"), F.lit(None).cast("double").alias("_v")))
    inside = [F.when((F.col("_low")[i] <= F.col("_v")) & (F.col("_v") <= F.col("_high")[i]), F.struct(F.lit(False).alias("below"), F.lit(i).alias("_j"), F.col("_v").alias("_v"))) for i in range(m)]
    placed = joined.select(*by, "_total", F.inline(F.array(mark, *inside))).where("below IS NOT NULL").groupBy(*by, "_total", "below", "_j", "_v").agg(F.count(F.lit(1)).alias("_n"))
    each = F.when(~F.col("below"), F.array("_j")).when(F.col("_j") < m, F.sequence("_j", F.lit(m - 1)))
    placed = placed.select(*by, "_total", "_n", "_v", F.explode(each).alias("_j"))
    w = Window.partitionBy(*by, "_j").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_upto", F.sum("_n").over(w)).where("_v IS NOT NULL")
    out = []
    for name in at:
        j = names.index(name)
        place = F.lit(float(at[name])) * (F.col("_total") - 1)
        holds = lambda k, j=j: (F.col("_j") == j) & (F.col("_upto") - F.col("_n") <= k) & (k < F.col("_upto"))
        lower, upper = F.max(F.when(holds(F.floor(place)), F.col("_v"))), F.max(F.when(holds(F.ceil(place)), F.col("_v")))
        up, down = F.max(F.ceil(place) - place), F.max(place - F.floor(place))
        out.append(F.when(down == 0, lower).otherwise(up * lower + down * upper).alias(name))
    return placed.groupBy(*by).agg(*out)


def _long(df: DataFrame, columns: list[str], name: str, keys: tuple[str, ...] = ("device_id",)) -> DataFrame:
    return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias("value")) for c in columns])))


def quantiles(df: DataFrame, columns: list[str], at=(0.5, 0.9, 0.95, 0.99, 1.0)) -> DataFrame:
    """device_id, metric and interpolated quantiles of each column."""
    return interpolated(_long(df, columns, "metric"), ["device_id", "metric"], {f"q{round(a * 1000):04d}": a for a in at})


def deviation(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, centre (median of value) and mad (median distance from it)."""
    centre = interpolated(rows, by, {"centre": 0.5})
    away = rows.join(centre, by).select(*by, "centre", F.abs(F.col("value") - F.col("centre")).alias("value"))
    return interpolated(away, [*by, "centre"], {"mad": 0.5})


def robust_fit(points: DataFrame, fields: dict[str, float] = FLOORS, least: int = 100) -> DataFrame:
    """Median, median absolute deviation and limit = max(floor, 6 * 1.4826 * MAD) of each field of a device, over all its rows."""
    total = points.groupBy("device_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    fitted = deviation(_long(points.join(total, "device_id"), list(fields), "field"), ["device_id", "field"])
    floor = F.create_map(*[x for c, f in fields.items() for x in (F.lit(c), F.lit(float(f)))])[F.col("field")]
    return fitted.select("device_id", "field", "centre", "mad", F.greatest(floor, 6 * 1.4826 * F.col("mad")).alias("limit"))


def context_fit(points: DataFrame, least: int = 100) -> DataFrame:
    """The fitted context of each device: field, centre, mad and limit of fifteen fields, and of two more.

    Only rows with a valid position and a navigation mode count, of which there must be ``least``;
    all of them are used. Pitch and roll are fitted on the circle, around the first value. lat and
    lon are the anchor and have no limit; ``radius`` is the distance from it in metres, and
    ``horizontal`` has the greatest limit of speed, ve and vn only.
    """
    total = points.groupBy("device_id").agg(F.count(F.lit(1)).alias("population"))
    valid = points.where(valid_position() & (F.col("nav_mode") != 0))
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("t_ms", "protocol"))).alias(f"_{c}") for c in CIRCULAR]
    start = valid.groupBy("device_id").agg(F.count(F.lit(1)).alias("valid_population"), *first).where(F.col("valid_population") >= least)
    rows = valid.join(start, "device_id")

    def fit(df, fields):
        """Of each field (value, value from which it is measured on the circle, floor): centre and mad."""
        none = F.lit(None).cast("double")
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value"), (F.col(f"_{c}") if c in CIRCULAR else none).cast("double").alias("_from")) for c in fields]))
        long = df.select("device_id", each.alias("m")).select("device_id", "m.*").where("value IS NOT NULL")
        by = ["device_id", "field"]
        turned = long.select(*by, "_from", F.coalesce(angle_delta("value", "_from"), "value").alias("value"))
        centre = interpolated(turned, [*by, "_from"], {"_c": 0.5})
        centre = centre.select(*by, F.coalesce(angle_delta(F.col("_from") + F.col("_c"), F.lit(0.0)), "_c").alias("centre"))
        turned = F.when(F.col("_from").isNotNull(), angle_delta("value", "centre")).otherwise(F.col("value") - F.col("centre"))
        return interpolated(long.join(centre, by).select(*by, "centre", F.abs(turned).alias("value")), [*by, "centre"], {"mad": 0.5})

    fields = fit(rows, ["lat", "lon", *FLOORS, *CIRCULAR])
    anchor = fields.where("field IN ('lat', 'lon')").groupBy("device_id").agg(*[F.max(F.when(F.col("field") == c, F.col("centre"))).alias(f"_{c}") for c in ("lat", "lon")])
    radius = fit(valid.join(anchor, "device_id").withColumn("radius", haversine_m("lat", "lon", "_lat", "_lon")), ["radius"])
    floor = F.lit(None).cast("double")
    for c, f in (FLOORS | CIRCULAR).items():
        floor = F.when(F.col("field") == c, F.lit(float(f))).otherwise(floor)
    spread = 6 * 1.4826 * F.col("mad")
    limited = fields.withColumn("limit", F.when(floor.isNotNull(), F.greatest(floor, spread)))
    level = limited.where("field IN ('speed', 've', 'vn')").groupBy("device_id").agg(F.max("limit").alias("limit"))
    level = level.select("device_id", F.lit("horizontal").alias("field"), F.lit(None).cast("double").alias("centre"), F.lit(None).cast("double").alias("mad"), "limit")
    limited = limited.unionByName(radius.withColumn("limit", F.greatest(F.lit(10.0), F.col("centre") + spread)))
    return limited.unionByName(level).join(start.select("device_id", "valid_population"), "device_id").join(total, "device_id")


def daily_audit(view: DataFrame) -> DataFrame:
    """A row for each device and local day: rows, first, last, greatest raw and accepted speed with its time, share accepted, counts by state and by reason."""
    df = view.withColumn("day", local_day("t_ms"))
    n = F.count(F.lit(1))
    accepted = F.when(F.col("speed").isNotNull(), F.struct("speed", -F.col("t_ms")))
    return df.groupBy("device_id", "day").agg(
        n.alias("samples"), F.min("t_ms").alias("first_ms"), F.max("t_ms").alias("last_ms"), (F.max("ground.raw_speed") * 3.6).alias("raw_max_kmh"), (F.max("speed") * 3.6).alias("accepted_max_kmh"),
        F.max_by("t_ms", accepted).alias("accepted_max_ms"), (F.count("speed") / n * 100).alias("accepted_pct"),
        *[F.sum((F.col("motion_state") == s).cast("int")).alias(s) for s in STATES], *[F.count_if(F.col("ground.reason") == r).alias(f"reason_{r}") for r in SPEED_REASONS])


def hourly_profile(view: DataFrame) -> DataFrame:
    df = view.withColumn("hour", local_hour("t_ms"))
    return df.groupBy("device_id", "hour").agg(
        F.count(F.lit(1)).alias("samples"), (F.avg("speed") * 3.6).alias("mean_kmh"), (F.max("speed") * 3.6).alias("max_kmh"),
        F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"))


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quantiles from p01 to p999 and the median absolute deviation of each column."""
    mad = deviation(_long(df, columns, "metric"), ["device_id", "metric"]).drop("centre")
    return quantiles(df, columns, (0.01, 0.5, 0.9, 0.99, 0.999)).join(mad, ["device_id", "metric"])


def status_histogram(points: DataFrame) -> DataFrame:
    return points.groupBy("device_id", "nav_mode", "fix_mode").agg(F.count(F.lit(1)).alias("n"))


def window_audit(view: DataFrame, seconds: int = 60, channels: list[str] = WINDOW_CHANNELS) -> DataFrame:
    """Ranges of channels, counts of states and reasons, rows beyond the motion limit in each window, with the first and last row and the one that departs most from 1 g."""
    df = view.withColumn("window_ms", F.floor(F.col("t_ms") / (seconds * 1000)) * seconds * 1000)
    ranges = [f(c).alias(f"{c}_{s}") for c in channels for s, f in (("min", F.min), ("max", F.max))]
    away = F.round(peak_deviation(), 9)
    ends = F.struct("t_ms", "protocol")
    return df.groupBy("device_id", "window_ms").agg(
        F.count(F.lit(1)).alias("samples"), *ranges, *[F.sum((F.col("motion_state") == s).cast("int")).alias(s) for s in STATES],
        *[F.count_if(F.col("ground.reason") == r).alias(f"reason_{r}") for r in SPEED_REASONS], F.count_if(peak_deviation() > MOTION_G).alias("deviating"),
        F.min(ends).alias("first"), F.max(ends).alias("last"), F.max_by("t_ms", F.when(away.isNotNull(), F.struct(away, -F.col("t_ms")))).alias("largest_ms"), F.max(away).alias("largest_g"))


def velocity_audit(points: DataFrame) -> DataFrame:
    horizontal = F.sqrt(F.col("ve") * F.col("ve") + F.col("vn") * F.col("vn"))
    over = lambda c: F.sum((c > MAX_SPEED).cast("int"))
    return points.groupBy("device_id").agg((F.max("speed") * 3.6).alias("scalar_kmh"), (F.max(horizontal) * 3.6).alias("horizontal_kmh"), (F.max(F.abs("vu")) * 3.6).alias("vertical_kmh"), over(F.col("speed")).alias("scalar_over"), over(horizontal).alias("horizontal_over"))


def stream_audit(frames: DataFrame) -> DataFrame:
    """Counts by file and message type: frames, checksum errors and timed frames to which the auxiliary ones are given (the last before each)."""
    timed = F.when(F.col("name").startswith("GPCHC"), F.col("source_offset"))
    df = with_neighbours(frames.withColumn("_at", timed), "_at", ["source"], F.shiftright("source_offset", 24), ["source_offset"], "_timed", None)
    # The distinct timed frames are counted in two steps.
    by_frame = df.groupBy("source", "name", "_timed").agg(F.count(F.lit(1)).alias("_n"), F.sum((~F.col("checksum_ok")).cast("int")).alias("_bad"))
    return by_frame.groupBy("source", "name").agg(F.sum("_n").alias("n"), F.sum("_bad").alias("bad"), F.count("_timed").alias("timed"))


def stream_histogram(decoded: DataFrame) -> DataFrame:
    """Frames of each file by GPS week and status byte."""
    return decoded.groupBy("source", "week", "status_text").agg(F.count(F.lit(1)).alias("n"))


def table_digest(df: DataFrame) -> DataFrame:
    """Row count and an order-free digest: the sum of 60 bits of the md5 of each row's columns, as text with the null sign \\N."""
    h = _row_digest(df)
    return df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("digest"))


def _row_digest(df: DataFrame):
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in sorted(df.columns)])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")


def digest_tree(df: DataFrame, hour_ms: int = 3_600_000) -> DataFrame:
    """Digests of a table in a tree: level (0 the whole table, 1 a device, 2 a device's hour), device_id, hour, rows and digest.

    A node's digest is the sum of those below it, so the upper levels come from the hours and not from rows.
    """
    hours = df.select("device_id", F.floor(F.col("t_ms") / hour_ms).alias("hour"), _row_digest(df).alias("_h")).groupBy("device_id", "hour").agg(F.count(F.lit(1)).alias("rows"), F.sum("_h").alias("digest"))
    sums = [F.sum("rows").alias("rows"), F.sum("digest").alias("digest")]
    nodes = hours.rollup("device_id", "hour").agg(F.grouping_id().alias("_g"), *sums)
    level = F.when(F.col("_g") == 3, 0).when(F.col("_g") == 1, 1).otherwise(2)
    return nodes.select(level.alias("level"), "device_id", "hour", "rows", F.col("digest").cast("string").alias("digest"))


def tree_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """device_id, hour, rows_a and rows_b of the hours in which two tables differ, told from their trees from the top down.

    Equal devices are left at their one row; hours are compared of the others only.
    """
    def differ(level: int, keys: list[str], x: DataFrame, y: DataFrame) -> DataFrame:
        named = lambda t, n: t.where(F.col("level") == level).select(*[F.col(k).alias(f"_{n}_{k}") for k in keys], F.col("rows").alias(f"rows_{n}"), F.col("digest").alias(f"_{n}"))
        same = reduce(lambda p, q: p & q, [F.col(f"_a_{k}").eqNullSafe(F.col(f"_b_{k}")) for k in keys], F.lit(True))
        both = named(x, "a").join(named(y, "b"), same, "full")
        unequal = ~(F.col("_a").eqNullSafe(F.col("_b")) & F.col("rows_a").eqNullSafe(F.col("rows_b")))
        return both.where(unequal).select(*[F.coalesce(f"_a_{k}", f"_b_{k}").alias(k) for k in keys], *[F.coalesce(f"rows_{n}", F.lit(0)).alias(f"rows_{n}") for n in "ab"])

    devices = differ(1, ["device_id"], a, b).select(F.col("device_id").alias("_d"))
    below = lambda t: t.join(devices, F.col("device_id").eqNullSafe(F.col("_d")), "left_semi")
    return differ(2, ["device_id", "hour"], below(a), below(b))


def densest_window(points: DataFrame, seconds: int = 3600) -> DataFrame:
    """The minute at whose end the most rows lie within the last hour, the latest of equal ones."""
    minutes = points.groupBy("device_id", (F.floor(F.col("t_ms") / 60_000) * 60).alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("device_id").orderBy("minute").rangeBetween(-(seconds - 1), 0)
    return minutes.withColumn("rows", F.sum("n").over(w)).groupBy("device_id").agg(F.max(F.struct("rows", "minute")).alias("x")).select("device_id", "x.minute", "x.rows")


def tag_windows(points: DataFrame, windows: DataFrame) -> DataFrame:
    """points with the name of every labelled window (name, start_ms, end_ms) that holds them."""
    hour = 3_600_000
    cells = windows.withColumn("_h", F.explode(F.sequence(F.floor(F.col("start_ms") / hour), F.floor(F.col("end_ms") / hour))))
    return points.withColumn("_h", F.floor(F.col("t_ms") / hour)).join(cells, "_h").where(F.col("t_ms").between(F.col("start_ms"), F.col("end_ms"))).drop("_h")


def shadow_compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows by device in which value, state or reason of two estimates differ."""
    n = new.select("device_id", "t_ms", "protocol", F.col("ground").alias("_new"))
    differs = ~(F.col("ground.value").eqNullSafe(F.col("_new.value")) & F.col("ground.state").eqNullSafe(F.col("_new.state")) & F.col("ground.reason").eqNullSafe(F.col("_new.reason")))
    return old.join(n, ["device_id", "t_ms", "protocol"]).groupBy("device_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(differs.cast("int")).alias("mismatches"))


def stationary_audit(points: DataFrame, first_ms: int = 600_000) -> DataFrame:
    """Of each device the distance from the median position of its first minutes, speed, gyro, acceleration and deviation: quantiles of each, and rows beyond 15 m, 30 m and 5 m of deviation."""
    start = points.groupBy("device_id").agg(F.min("t_ms").alias("_t0"))
    early = points.join(start, "device_id").where(F.col("t_ms") <= F.col("_t0") + first_ms)
    medians = interpolated(_long(early, ["lat", "lon"], "axis"), ["device_id", "axis"], {"m": 0.5})
    anchor = medians.groupBy("device_id").agg(*[F.max(F.when(F.col("axis") == c, F.col("m"))).alias(f"_{c}") for c in ("lat", "lon")])
    dy = (F.col("lat") - F.col("_lat")) * DEGREE_M
    dx = (F.col("lon") - F.col("_lon")) * DEGREE_M * F.cos(F.radians("_lat"))
    df = points.join(anchor, "device_id").withColumns({
        "radius": F.sqrt(dx * dx + dy * dy), "gyro": F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + F.col("gz") * F.col("gz")), "accel": peak_deviation(), "spread": F.greatest("lat_std", "lon_std")})
    parts = ["radius", "speed", "gyro", "accel", "spread"]
    wide = quantiles(df, parts, (0.5, 0.99)).groupBy("device_id").agg(*[F.max(F.when(F.col("metric") == c, F.col(q))).alias(f"{c}_{n}") for c in parts for q, n in (("q0500", "p50"), ("q0990", "p99"))])
    counted = df.groupBy("device_id").agg(F.count_if(F.col("radius") > 15).alias("beyond15"), F.count_if(F.col("radius") > 30).alias("beyond30"), F.count_if(F.col("spread") > 5).alias("uncertain"))
    return wide.join(counted, "device_id")


def radius_counts(points: DataFrame, limits: tuple[float, ...] = (5.0, 15.0, 30.0, 100.0)) -> DataFrame:
    """Rows of each device beyond distances from its median position."""
    medians = interpolated(_long(points, ["lat", "lon"], "axis"), ["device_id", "axis"], {"m": 0.5})
    anchor = medians.groupBy("device_id").agg(*[F.max(F.when(F.col("axis") == c, F.col("m"))).alias(f"_{c}") for c in ("lat", "lon")])
    dy = (F.col("lat") - F.col("_lat")) * DEGREE_M
    dx = (F.col("lon") - F.col("_lon")) * DEGREE_M * F.cos(F.radians("_lat"))
    df = points.join(anchor, "device_id").withColumn("radius", F.sqrt(dx * dx + dy * dy))
    return df.groupBy("device_id").agg(*[F.count_if(F.col("radius") > r).alias(f"beyond{int(r)}") for r in limits])


def jump_log(drifted: DataFrame, limit: int = 20) -> DataFrame:
    """The first jumps with their evidence and the number of all (the log's length is the feature)."""
    rows = drifted.where("drift IS NOT NULL").select("device_id", "t_ms", "protocol", "drift.*")
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy("t_ms", "device_id", "protocol").limit(limit).withColumn("total", total.scalar())


def sum_counters(files: DataFrame, column: str = "counters") -> DataFrame:
    """Counter maps of many rows added up by name."""
    return files.select(F.explode(column).alias("name", "n")).groupBy("name").agg(F.sum("n").alias("n"))
