"""Scoring and projection of measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import BITS, CHANNELS, CONTIGUOUS_MS, COURSE_FIELDS, DRIFT_FIELDS, EXCLUDING, HEADING_FIELDS, MAX_SPEED, MAX_VELOCITY_STD, MAX_VERTICAL, NAVIGATION_FIELDS, OTHER_SPEED_LABEL, OUTLIER_FIELDS, REASON_BITS, REASON_LABELS, REASONS, SPEED_LABELS
from ..functions.scalars import bits_to_names, finite_sql, ground_speed, haversine_sql, motion_state, present, valid_position, velocity_outlier
from .timeline import with_previous

VERSION = 10


def drift_evidence(prev: str = "prev") -> Column:
    """distance_m, delta_s, limit_m, speed_change_ms and fast_inconsistent of a severe jump, else null."""
    delta = f"((t_ms - {prev}.t_ms) / 1000)"
    jump = haversine_sql(f"{prev}.lat", f"{prev}.lon", "lat", "lon")
    speed, before = "coalesce(speed, 0.0D)", f"coalesce({prev}.speed, 0.0D)"
    reach = f"((greatest({before}, {speed}, 0.0D) + 15) * {delta})"
    tolerance = "greatest(20.0D, 5 * coalesce(lat_std, 0.0D), 5 * coalesce(lon_std, 0.0D))"
    change = f"abs({speed} - {before})"
    fast = f"({jump} > {reach} AND {change} > greatest(1.0D, 10 * {delta}))"
    near = " AND ".join([*map(finite_sql, (f"{prev}.lat", f"{prev}.lon", "lat", "lon")), f"(t_ms - {prev}.t_ms) BETWEEN 1 AND {CONTIGUOUS_MS}"])
    found = f"named_struct('distance_m', {jump}, 'delta_s', {delta}, 'limit_m', {reach} + {tolerance}, 'speed_change_ms', {change}, 'fast_inconsistent', {fast})"
    return F.expr(f"CASE WHEN {near} AND ({jump} > {reach} + {tolerance} OR {fast}) THEN {found} END")


def position_drift(points: DataFrame) -> DataFrame:
    """points with ``drift``, the evidence against the device's row before."""
    return with_previous(points, ["t_ms", "lat", "lon", "speed"]).withColumn("drift", drift_evidence())


def _any(names: list[str]) -> Column:
    return F.expr("(" + " OR ".join(f"{n} IS NOT NULL" for n in names) + ")")


def complete(points: DataFrame) -> DataFrame:
    """points with all channels, those that are missing as null."""
    return points.withColumns({c: F.lit(None).cast("double") for c in CHANNELS if c not in points.columns})


def assess(points: DataFrame) -> DataFrame:
    """points with mask, reasons, ground speed and drift: 39 bits of hidden fields, 15 bits of reasons."""
    df = position_drift(complete(points))
    valid = valid_position()
    outlier, drift = velocity_outlier(), F.col("drift").isNotNull()
    zero = F.lit(0).cast("bigint")
    mask = F.when(outlier, present(OUTLIER_FIELDS)).otherwise(zero).bitwiseOR(F.when(drift, present(DRIFT_FIELDS)).otherwise(zero))
    speed_bit = F.lit(BITS["speed"]).cast("bigint")
    df = df.withColumn("_mask", mask).withColumn("ground", ground_speed(f"(_mask & {BITS['speed']}L) <> 0"))
    hidden = F.col("ground.value").isNull()

    def reason(name: str, when: Column) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), F.lit(REASON_BITS[name])).otherwise(0)

    reasons = (
        reason("invalid_navigation", (~valid | (F.col("nav_mode") == 0)) & _any(NAVIGATION_FIELDS))
        + reason("heading_unavailable", ((F.col("nav_mode") != 2) | ~F.col("fix_mode").between(1, 5)) & _any(HEADING_FIELDS))
        + reason("course_unavailable", (F.col("speed").isNull() | (F.col("speed") < 1) | ~valid) & _any(COURSE_FIELDS))
        + reason("navigation_velocity_outlier", outlier & _any(OUTLIER_FIELDS)) + reason("navigation_position_drift", drift) + reason("speed_unavailable", hidden))
    return df.withColumn("mask", F.when(hidden, F.col("_mask").bitwiseOR(speed_bit)).otherwise(F.col("_mask"))).withColumn("reasons", reasons.cast("bigint")).withColumn("valid_pos", valid).drop("_mask", "prev", "_slice")


def project(assessed: DataFrame) -> DataFrame:
    """The measurement view: hidden fields null, effective speed, valid position recomputed.

    Rows without an assessment (mask null) show nothing and have an unknown state.
    """
    shown = {c: F.expr(f"CASE WHEN (mask & {BITS[c]}L) = 0 THEN {c} END") for c in CHANNELS if c != "speed"}
    df = assessed.withColumns(shown | {"speed": F.when(F.col("mask").isNotNull(), F.col("ground.value")), "motion_state": F.when(F.col("mask").isNull(), "unknown").otherwise(F.col("ground.state"))})
    return df.withColumn("valid_pos", valid_position())


def joined_points(points: DataFrame, quality: DataFrame, version: int = VERSION) -> DataFrame:
    """points with the assessments of this version (left join), so that others stay pending."""
    current = quality.where(F.col("version") == version).select("device_id", "t_ms", "protocol", "mask", "reasons", "ground")
    return points.join(current, ["device_id", "t_ms", "protocol"], "left")


def quality_records(assessed: DataFrame, reason: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    """Rows with hidden fields, newest first, with the hidden raw values and whether more follow; at most limit after offset."""
    bits = EXCLUDING if reason is None else REASON_BITS[reason]
    rows = assessed.where((F.col("mask") != 0) & (F.col("reasons").bitwiseAND(F.lit(bits).cast("bigint")) != 0))
    raw = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in CHANNELS]), F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(BITS[c]).cast("bigint")) != 0, F.col(c)) for c in CHANNELS])), lambda k, v: v.isNotNull())
    out = rows.select("device_id", "t_ms", "protocol", bits_to_names("mask", CHANNELS).alias("fields"), bits_to_names("reasons", list(REASONS)).alias("codes"), raw.alias("raw_values"))
    # One row more than the page tells whether more follow.
    page = out.orderBy(F.desc("t_ms"), "device_id", "protocol").offset(offset).limit(limit + 1)
    place = F.row_number().over(Window.orderBy(F.desc("t_ms"), "device_id", "protocol"))
    page = page.withColumn("_place", place).withColumn("has_more", F.max("_place").over(Window.partitionBy()) > limit)
    return page.where(F.col("_place") <= limit).drop("_place")


def explain_quality(assessed: DataFrame) -> DataFrame:
    """A row for each reason of each point: code, label, category, fields, raw values, reference and limit (as texts of structs)."""
    names = {"invalid_navigation": NAVIGATION_FIELDS, "heading_unavailable": HEADING_FIELDS, "course_unavailable": COURSE_FIELDS, "navigation_velocity_outlier": OUTLIER_FIELDS, "navigation_position_drift": DRIFT_FIELDS, "speed_unavailable": ["speed"]}
    none = F.lit(None).cast("string")
    horizontal = F.sqrt(F.col("ve") * F.col("ve") + F.col("vn") * F.col("vn"))
    spread = F.greatest(F.abs("ve_std"), F.abs("vn_std"), F.abs("vu_std"))
    reference = {
        "navigation_velocity_outlier": F.to_json(F.struct(F.col("speed").alias("speed_ms"), horizontal.alias("horizontal_speed_ms"), F.col("vu").alias("vertical_speed_ms"), spread.alias("velocity_std_ms"))),
        "navigation_position_drift": F.to_json("drift"), "speed_unavailable": F.to_json("ground")}
    limit = {
        "navigation_velocity_outlier": F.to_json(F.struct(F.lit(MAX_SPEED).alias("max_speed_ms"), F.lit(MAX_VERTICAL).alias("max_vertical_speed_ms"), F.lit(MAX_VELOCITY_STD).alias("max_velocity_std_ms"))),
        "navigation_position_drift": F.col("drift.limit_m").cast("string")}
    speed_label = F.coalesce(F.create_map(*[F.lit(x) for pair in SPEED_LABELS.items() for x in pair])[F.col("ground.reason")], F.lit(OTHER_SPEED_LABEL))

    def one(code: str) -> Column:
        fields = names[code]
        there = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in fields]))
        values = F.map_filter(F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f) for f in fields])), lambda k, v: v.isNotNull())
        if code == "speed_unavailable":
            there = F.array(F.lit("speed"))
        return F.struct(
            F.lit(code).alias("code"), (speed_label if code == "speed_unavailable" else F.lit(REASON_LABELS[code])).alias("label"), F.lit(REASONS[code]).alias("category"),
            there.alias("fields"), values.alias("raw_values"), reference.get(code, none).alias("reference"), limit.get(code, none).alias("limit"))

    found = F.array_compact(F.array(*[F.when(F.col("reasons").bitwiseAND(F.lit(REASON_BITS[c]).cast("bigint")) != 0, one(c)) for c in names]))
    return assessed.select("device_id", "t_ms", "protocol", F.inline(found))


def quality_summary(assessed: DataFrame) -> DataFrame:
    """Counts by device: total, excluded, anomaly, unavailable, status, pending (no assessment), and a row for each reason and hidden field."""
    base = assessed.groupBy("device_id", "mask", "reasons").agg(F.count(F.lit(1)).alias("n"))
    items = [("total", F.lit(True)), ("pending", F.col("mask").isNull()), ("excluded", F.col("mask") != 0)]
    for kind in ("anomaly", "unavailable", "status"):
        bits = sum(b for n, b in REASON_BITS.items() if REASONS[n] == kind)
        items.append((kind, F.col("reasons").bitwiseAND(F.lit(bits).cast("bigint")) != 0))
    items += [(f"reason:{n}", F.col("reasons").bitwiseAND(F.lit(b).cast("bigint")) != 0) for n, b in REASON_BITS.items()]
    items += [(f"field:{n}", F.col("mask").bitwiseAND(F.lit(b).cast("bigint")) != 0) for n, b in BITS.items()]
    each = F.explode(F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in items]), lambda x: x.isNotNull()))
    return base.select("device_id", "n", each.alias("item")).groupBy("device_id", "item").agg(F.sum("n").alias("n"))


def with_context(points: DataFrame, contexts: DataFrame) -> DataFrame:
    """points with context_id, the context of the device that holds t and starts first; an open end is null."""
    day = 86_400_000
    bounded = contexts.where("end_ms IS NOT NULL").select(F.col("device_id").alias("_d"), "context_id", "start_ms", "end_ms", F.explode(F.sequence(F.floor(F.col("start_ms") / day), F.floor(F.col("end_ms") / day))).alias("_day"))
    keyed = points.select("device_id", "t_ms", "protocol", F.floor(F.col("t_ms") / day).alias("_at"))
    # Day cells make the range join an equality join on (device, day).
    on = (keyed["device_id"] == bounded["_d"]) & (keyed["_at"] == bounded["_day"]) & F.col("t_ms").between(F.col("start_ms"), F.col("end_ms"))
    found = keyed.join(bounded, on).groupBy("device_id", "t_ms", "protocol").agg(F.min(F.struct("start_ms", "context_id")).alias("_bounded"))
    # Of the open ones only that which starts first can hold a point first.
    open_ = contexts.where("end_ms IS NULL").groupBy("device_id").agg(F.min(F.struct("start_ms", "context_id")).alias("_open"))
    df = points.join(found, ["device_id", "t_ms", "protocol"], "left").join(open_, "device_id", "left")
    reached = F.when(F.col("_open.start_ms") <= F.col("t_ms"), F.col("_open"))
    return df.withColumn("context_id", F.least("_bounded", reached)["context_id"]).drop("_bounded", "_open")


def point_at(assessed: DataFrame, device_id: str, t_ms: int, protocol: str | None = None) -> DataFrame:
    rows = assessed.where((F.col("device_id") == device_id) & (F.col("t_ms") == t_ms))
    return rows if protocol is None else rows.where(F.col("protocol") == protocol)


def device_status(devices: DataFrame, now_ms: int) -> DataFrame:
    """devices (last_ms, received_ms) with lag_s and whether they are online."""
    lag = (F.lit(now_ms) - F.col("last_ms")) / 1000
    return devices.withColumn("lag_s", lag).withColumn("online", (F.lit(now_ms) - F.col("received_ms") < 30_000) & (F.abs(lag) < 60))
