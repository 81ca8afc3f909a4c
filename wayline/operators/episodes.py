"""Threshold signals, episodes and event lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import ACTIVE_WARNINGS, BITS, CONTIGUOUS_MS, GROUPS, KINDS, RULES
from ..functions.scalars import excess, haversine_m, peak_deviation
from .motion import gaps
from .timeline import run_number, sliced, with_previous, with_runs


def accel_baseline(view: DataFrame, far_ms: int = 1500, near_ms: int = 800) -> DataFrame:
    """view with ``base`` (t_ms, speed), the oldest row between far and near before each, and ``accel`` in m/s²."""
    w = Window.partitionBy("device_id", "_slice").orderBy("t_ms").rangeBetween(-far_ms, -near_ms)
    base = F.min_by(F.struct("t_ms", "speed"), F.struct("t_ms", "protocol")).over(w)
    out = sliced(view, far_ms).withColumn("base", base).where("_own").drop("_slice", "_own")
    return out.withColumn("accel", (F.col("speed") - F.col("base.speed")) / ((F.col("t_ms") - F.col("base.t_ms")) / 1000))


def signal_rows(view: DataFrame, rules: dict = RULES, mount_confirmed: bool = True) -> DataFrame:
    """Every row (device_id, t_ms, protocol) with ``signals``, its reliable exceedances as structs kind, value, threshold."""
    df = accel_baseline(view)
    kmh, shock = F.col("speed") * 3.6, peak_deviation()
    tests = [("overspeed", kmh, "speed_kmh"), ("acceleration", F.col("accel"), "accel_ms2"), ("braking", -F.col("accel"), "brake_ms2")]
    if mount_confirmed:
        tests += [("roll", F.abs("roll"), "roll_deg"), ("pitch", F.abs("pitch"), "pitch_deg"), ("shock", shock, "shock_g")]
    found = [F.when(value > rules[key], F.struct(F.lit(kind).alias("kind"), F.bround(value, 5).alias("value"), F.lit(rules[key]).alias("threshold"))) for kind, value, key in tests]
    return df.select("device_id", "t_ms", "protocol", F.array_compact(F.array(*found)).alias("signals"))


def threshold_signals(view: DataFrame, rules: dict = RULES, mount_confirmed: bool = True) -> DataFrame:
    """A row for each reliable exceedance: device_id, t_ms, protocol, kind, value, threshold."""
    return signal_rows(view, rules, mount_confirmed).select("device_id", "t_ms", "protocol", F.inline("signals"))


def diagnostic_conditions(points: DataFrame, rules: dict = RULES) -> DataFrame:
    """Quality evidence that is no threshold event: kind, value, threshold of each point."""
    df = with_previous(points, ["t_ms", "lat", "lon", "speed", "lat_std", "lon_std", "valid_pos"])
    zero = F.lit(0.0)
    std = F.greatest(F.coalesce("lat_std", zero), F.coalesce("lon_std", zero))
    active = F.col("warning").bitwiseAND(F.lit(sum(1 << b for b in ACTIVE_WARNINGS)))
    delta = (F.col("t_ms") - F.col("prev.t_ms")) / 1000
    jump = haversine_m("prev.lat", "prev.lon", "lat", "lon")
    tolerance = F.greatest(F.lit(20.0), 5 * std, 5 * F.coalesce("prev.lat_std", zero), 5 * F.coalesce("prev.lon_std", zero))
    reach = (F.greatest(F.coalesce("speed", zero), F.coalesce("prev.speed", zero)) + 15) * delta + tolerance
    tests = [
        ("fix_degraded", ~F.col("fix_mode").isin(4, 8), F.col("fix_mode"), F.lit(4.0)),
        ("heading_unavailable", (F.col("nav_mode") != 2) | F.col("fix_mode").isin(0, 6, 7, 8, 9), F.col("nav_mode"), F.lit(2.0)),
        ("hardware_warning", active != 0, active, zero),
        ("diff_age", F.col("age") > rules["age_s"], F.col("age"), F.lit(rules["age_s"])),
        ("position_std", std > rules["position_std_m"], std, F.lit(rules["position_std_m"])),
        ("position_jump", (delta > 0) & (delta <= rules["gap_s"]) & F.col("valid_pos") & F.col("prev.valid_pos") & (jump > reach), jump, tolerance)]
    found = [F.when(test, F.struct(F.lit(kind).alias("kind"), F.bround(value.cast("double"), 5).alias("value"), threshold.cast("double").alias("threshold"))) for kind, test, value, threshold in tests]
    each = df.select("device_id", "t_ms", "protocol", F.inline(F.array_compact(F.array(*found))))
    # The row that ends a gap: of several at its time the first.
    late = gaps(points, int(rules["gap_s"] * 1000))
    first = points.groupBy("device_id", "t_ms").agg(F.min("protocol").alias("protocol"))
    waits = late.join(first, (late["device_id"] == first["device_id"]) & (late["end_ms"] == first["t_ms"])).select(
        late["device_id"], "t_ms", "protocol", F.lit("data_gap").alias("kind"), F.bround((F.col("end_ms") - F.col("start_ms")) / 1000, 5).alias("value"), F.lit(float(rules["gap_s"])).alias("threshold"))
    return each.unionByName(waits)


def episode_parts(rows: DataFrame, gap_ms: int = CONTIGUOUS_MS) -> DataFrame:
    """The episodes of each slice (_slice, _run); one of _run 0 goes on from the slice before. rows as of signal_rows."""
    df = with_previous(rows.withColumn("_kinds", F.transform("signals", lambda s: s["kind"])), ["t_ms", "_kinds"], within_ms=gap_ms)
    near = F.coalesce(F.col("t_ms") - F.col("prev.t_ms") <= gap_ms, F.lit(False))
    s = df.select("device_id", "t_ms", "protocol", "_slice", near.alias("_near"), F.col("prev._kinds").alias("_had"), F.inline("signals"))
    s = with_runs(s, ~(F.col("_near") & F.coalesce(F.array_contains("_had", F.col("kind")), F.lit(False))), ("device_id", "kind"))
    peak = F.struct("value", (-F.col("t_ms")).alias("_before"))
    return s.groupBy("device_id", "kind", "_slice", "_run").agg(F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("end_ms"), F.max(peak).alias("_peak"), F.count(F.lit(1)).alias("samples"), F.max("threshold").alias("threshold"))


def merged_episodes(parts: DataFrame, rule_version: int = 1) -> DataFrame:
    """Whole episodes from their parts in slices."""
    parts = parts.withColumn("_number", run_number(("device_id", "kind")))
    out = parts.groupBy("device_id", "kind", "_number").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.max("_peak").alias("_peak"), F.sum("samples").alias("samples"), F.max("threshold").alias("threshold"))
    out = out.select("device_id", "kind", "start_ms", "end_ms", F.col("_peak.value").alias("peak"), (-F.col("_peak._before")).alias("peak_ms"), "samples", "threshold")
    return out.withColumn("severity", F.lit("warning")).withColumn("rule_version", F.lit(rule_version))


def episodes(rows: DataFrame, gap_ms: int = CONTIGUOUS_MS, rule_version: int = 1) -> DataFrame:
    """Runs of consecutive device rows with a signal of one kind, ended by a row without it or a longer gap; rows as of signal_rows."""
    return merged_episodes(episode_parts(rows, gap_ms), rule_version)


def gate_events(events: DataFrame, assessed: DataFrame, version: int | None = None) -> DataFrame:
    """Events at whose peak there is an assessment (of this version, without a context, where the columns are there) that hides none of the fields of their kind."""
    bits = F.create_map(*[x for kind, (_, fields) in KINDS.items() for x in (F.lit(kind), F.lit(sum(BITS[f] for f in fields)).cast("bigint"))])
    good = F.col("mask").isNotNull()
    if version is not None:
        good = good & (F.col("version") == version)
    if "context_id" in assessed.columns:
        good = good & F.col("context_id").isNull()
    more = ["protocol"] if "protocol" in events.columns else []
    seen = assessed.where(good).select(F.col("device_id").alias("_d"), F.col("t_ms").alias("_t"), F.col("mask").alias("_m"), *[F.col(c).alias("_p") for c in more])
    on = (events["device_id"] == seen["_d"]) & (events["peak_ms"] == seen["_t"]) & (seen["_m"].bitwiseAND(bits[events["kind"]]) == 0)
    for c in more:
        on = on & (events[c] == seen["_p"])
    return events.join(seen, on, "left_semi")


def group_of(kind="kind"):
    return F.create_map(*[x for k, (group, _) in KINDS.items() for x in (F.lit(k), F.lit(group))])[F.col(kind)]


def event_counts(events: DataFrame) -> DataFrame:
    """Events by group; groups without any count 0."""
    spark = events.sparkSession
    groups = spark.sql("SELECT explode(array(" + ", ".join(f"'{g}'" for g in GROUPS) + ")) AS grp")
    counted = events.groupBy(group_of().alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    return groups.join(counted, "grp", "left").select("grp", F.coalesce("n", F.lit(0)).alias("n"))


def event_top_k(events: DataFrame, k: int = 10) -> DataFrame:
    """The k largest exceedances of each group (top k is the feature), with excess and its share."""
    df = events.withColumn("grp", group_of()).withColumn("_e", excess("peak", "threshold"))
    w = Window.partitionBy("grp").orderBy(F.desc(F.col("peak") - F.col("threshold")), F.desc("peak"), F.desc("start_ms"), "device_id", "kind")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("grp", "rank", "device_id", "kind", "start_ms", "peak", "threshold", "_e.excess", "_e.excess_pct")


def overlapping(df: DataFrame, lo: int, hi: int) -> DataFrame:
    return df.where((F.col("start_ms") <= hi) & (F.col("end_ms") >= lo))


def list_events(events: DataFrame, lo: int, hi: int, cap: int = 2000) -> DataFrame:
    """Newest events of a range with the whole count and whether the list is cut (the cap is the feature)."""
    rows = overlapping(events, lo, hi)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    listed = rows.orderBy(F.desc("start_ms"), "device_id", "kind").limit(cap)
    return listed.withColumn("total", total.scalar()).withColumn("truncated", F.col("total") > cap)


def outlier_intervals(rows: DataFrame, flag, gap_ms: int = 1000) -> DataFrame:
    """Intervals of flagged rows no further apart than the gap."""
    flagged = with_previous(rows.where(flag), ["t_ms"], within_ms=gap_ms)
    runs = with_runs(flagged, ~F.coalesce(F.col("t_ms") - F.col("prev.t_ms") <= gap_ms, F.lit(False)))
    parts = runs.groupBy("device_id", "_slice", "_run").agg(F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("end_ms"), F.count(F.lit(1)).alias("samples"), F.max("speed").alias("max_speed"), F.max(F.abs("vu")).alias("max_vertical"))
    return parts.withColumn("interval", run_number()).groupBy("device_id", "interval").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("samples").alias("samples"), F.max("max_speed").alias("max_speed"), F.max("max_vertical").alias("max_vertical"))


def rebuild_episodes(view: DataFrame, highest_id: int, rules: dict = RULES, rule_version: int = 1) -> DataFrame:
    """All episodes anew, with ids that go on above the highest so far.

    Ids are given by start; ranks come from counts by day and a rank within the day, so no day waits for another.
    """
    found = episodes(signal_rows(view, rules), rule_version=rule_version)
    found = found.withColumn("_day", F.floor(F.col("start_ms") / 86_400_000))
    days = found.groupBy("_day").agg(F.count(F.lit(1)).alias("_n"))
    before = days.select("_day", F.coalesce(F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_day").orderBy("start_ms", "device_id", "kind"))
    return found.join(before, "_day").withColumn("event_id", highest_id + F.col("_before") + rank).drop("_day", "_before")
