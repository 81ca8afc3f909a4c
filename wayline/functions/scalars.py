"""Column functions of the telemetry model; all are native expressions."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import ACTIVE_WARNINGS, CHANNELS, EARTH_M, FIX_LABELS, LEAP_DAYS, MAX_SPEED, MAX_VELOCITY_STD, MAX_VERTICAL, MOTION_G, NAV_LABELS, UNKNOWN_LABEL, WARNING_LABELS


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite_sql(x: str) -> str:
    return f"({x} IS NOT NULL AND NOT isnan({x}) AND abs({x}) <> double('Infinity'))"


# What every query over the measurements builds is SQL text: one expression parsed at once instead of a call for each of its parts.


def finite(x: str) -> Column:
    return F.expr(finite_sql(x))


def _resultant_sql(ax="ax", ay="ay", az="az") -> str:
    return f"CASE WHEN {finite_sql(ax)} AND {finite_sql(ay)} AND {finite_sql(az)} THEN sqrt({ax} * {ax} + {ay} * {ay} + {az} * {az}) END"


def resultant(ax="ax", ay="ay", az="az") -> Column:
    """Length of the acceleration vector, null if an axis is missing."""
    return F.expr(_resultant_sql(ax, ay, az))


def _deviation_sql(ax="ax", ay="ay", az="az") -> str:
    return f"abs({_resultant_sql(ax, ay, az)} - 1.0D)"


def peak_deviation(ax="ax", ay="ay", az="az") -> Column:
    return F.expr(_deviation_sql(ax, ay, az))


def _state_sql(threshold: float = MOTION_G) -> str:
    d = _deviation_sql()
    return f"CASE WHEN {d} IS NULL THEN 'unknown' WHEN {d} > {float(threshold)!r}D THEN 'moving' ELSE 'stationary' END"


def motion_state(threshold: float = MOTION_G) -> Column:
    return F.expr(_state_sql(threshold))


def ground_speed(drift: str | None = None) -> Column:
    """value, state, reason and raw_speed; drift (a column or a condition in SQL) says whether the position is quarantined."""
    state = _state_sql()
    first = f"WHEN {drift} THEN 'navigation_drift' " if drift else ""
    reason = (
        f"CASE {first}WHEN protocol <> 'GPCHCX' THEN 'non_gpchcx' WHEN NOT {finite_sql('speed')} OR speed < 0 THEN 'missing_speed' WHEN speed > {float(MAX_SPEED)!r}D THEN 'velocity_solution_outlier' "
        f"WHEN {state} = 'unknown' THEN 'motion_unknown' WHEN {state} = 'stationary' THEN 'vibration_stationary' ELSE 'gpchcx_speed' END")
    value = f"CASE {reason} WHEN 'vibration_stationary' THEN 0.0D WHEN 'gpchcx_speed' THEN speed END"
    known = f"CASE {reason} WHEN 'vibration_stationary' THEN 'stationary' WHEN 'gpchcx_speed' THEN 'moving' ELSE 'unknown' END"
    return F.expr(f"named_struct('value', {value}, 'state', {known}, 'reason', {reason}, 'raw_speed', CASE WHEN protocol = 'GPCHCX' THEN speed END)")


def valid_position(fix="fix_mode", lat="lat", lon="lon") -> Column:
    return F.expr(f"coalesce({fix} BETWEEN 1 AND 9 AND {finite_sql(lat)} AND {finite_sql(lon)} AND ({lat} <> 0 OR {lon} <> 0), false)")


def velocity_outlier() -> Column:
    most, vertical, spread = (f"{float(x)!r}D" for x in (MAX_SPEED, MAX_VERTICAL, MAX_VELOCITY_STD))
    tests = [f"speed > {most}", f"sqrt(ve * ve + vn * vn) > {most}", f"abs(vu) > {vertical}", f"greatest(abs(ve_std), abs(vn_std), abs(vu_std)) > {spread}"]
    return F.expr(f"exists(array({', '.join(tests)}), x -> coalesce(x, false))")


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a, b = f"sin((radians({lat2}) - radians({lat1})) / 2)", f"sin((radians({lon2}) - radians({lon1})) / 2)"
    return f"({EARTH_M * 2!r}D * asin(sqrt(least(1.0D, {a} * {a} + cos(radians({lat1})) * cos(radians({lat2})) * {b} * {b}))))"


def haversine_m(lat1: str, lon1: str, lat2: str, lon2: str) -> Column:
    return F.expr(haversine_sql(lat1, lon1, lat2, lon2))


def angle_delta(a, b) -> Column:
    return F.pmod(col(a) - col(b) + 180, F.lit(360)) - 180


def bucket_start(t_ms, seconds: int) -> Column:
    """Start of the bucket in ms."""
    return F.floor(col(t_ms) / (seconds * 1000)) * (seconds * 1000)


def excess(peak, threshold) -> Column:
    peak, threshold = col(peak), col(threshold)
    over = F.greatest(F.lit(0.0), peak - threshold)
    return F.struct(F.bround(over, 5).alias("excess"), F.when(threshold > 0, F.bround(over / threshold * 100, 3)).alias("excess_pct"))


def bits_to_names(mask, names: list[str]) -> Column:
    """Names of the bits that are set, in bit order."""
    named = F.array(*[F.when(col(mask).bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, F.lit(n)) for i, n in enumerate(names)])
    return F.array_compact(named)


def names_to_bits(names, known: list[str]) -> Column:
    return sum((F.when(F.array_contains(col(names), n), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i, n in enumerate(known)), F.lit(0).cast("bigint"))


def norm_sequence(s) -> Column:
    """One to four digits as four; else null."""
    s = F.trim(col(s))
    return F.when(s.rlike("^[0-9]{1,4}$"), F.lpad(s, 4, "0"))


def norm_digits(s, prefixes: tuple[str, ...] = ()) -> Column:
    """Digits (a decimal part of zeros is dropped) that begin with one of the prefixes, if there are any; else null."""
    s = F.regexp_replace(F.trim(col(s)), r"^([0-9]+)\.0+$", "$1")
    good = s.rlike("^[0-9]+$")
    if prefixes:
        good = good & s.rlike("^(" + "|".join(prefixes) + ")")
    return F.when(good, s)


def contains_ci(column, text: str) -> Column:
    return F.contains(F.lower(col(column)), F.lit(text.lower()))


def process_no(code, key) -> Column:
    code, key = col(code), col(key)
    return F.when(F.startswith(code, key), F.substring(code, F.length(key) + 1, F.length(code))).otherwise(code)


def local_day(t_ms, hours: int = 8) -> Column:
    return F.date_format(F.timestamp_millis(col(t_ms) + hours * 3_600_000), "yyyy-MM-dd")


def local_hour(t_ms, hours: int = 8) -> Column:
    return F.date_format(F.timestamp_millis(col(t_ms) + hours * 3_600_000), "yyyy-MM-dd HH")


def capped_rate(a, b, c) -> Column:
    a, b, c = col(a), col(b), col(c)
    return F.when(c <= 0, 0).otherwise(F.least(F.lit(100), F.floor((a + b) / (2 * c) * 100 + 0.5))).cast("int")


def repair_text(df, pairs: list[tuple[str, str]]):
    """df with literal replacements in every string column."""
    out = {}
    for f in df.schema.fields:
        if f.dataType.simpleString() == "string":
            c = F.col(f.name)
            for old, new in pairs:
                c = F.replace(c, F.lit(old), F.lit(new))
            out[f.name] = c
    return df.withColumns(out) if out else df


def json_text(column, path: str) -> Column:
    return F.get_json_object(col(column), path)


def json_length(column) -> Column:
    return F.json_array_length(col(column))


def _labelled(value, labels: dict[int, str]) -> Column:
    return F.coalesce(F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))])[col(value).cast("int")], F.lit(UNKNOWN_LABEL))


def nav_label(nav="nav_mode") -> Column:
    return _labelled(nav, NAV_LABELS)


def fix_label(fix="fix_mode") -> Column:
    return _labelled(fix, FIX_LABELS)


def warning_labels(warning="warning") -> Column:
    """Labels of the warning bits that are set, in bit order."""
    return bits_to_names(col(warning).cast("bigint"), list(WARNING_LABELS.values()))


def gps_to_unix(week, tow) -> Column:
    """UTC seconds from GPS week and seconds of week, null out of range."""
    week, tow = col(week).cast("bigint"), col(tow)
    gps = F.lit(float(calendar.timegm((1980, 1, 6, 0, 0, 0)))) + week * 604800 + tow
    leaps = [calendar.timegm(dt.date.fromisoformat(d).timetuple()) + n for n, d in enumerate(LEAP_DAYS, 1)]
    offset = F.size(F.filter(F.array(*[F.lit(float(x)) for x in leaps]), lambda x: x <= gps))
    return F.when(week.between(0, 8191) & (tow >= 0) & (tow < 604800), F.round(gps - offset, 3))


def warning_codes(warning="warning") -> Column:
    """Numbers of the warning bits that are set and in use."""
    return F.filter(F.array(*[F.lit(b) for b in ACTIVE_WARNINGS]), lambda b: F.expr("0") + F.call_function("getbit", col(warning).cast("bigint"), b) == 1)


def position_confidence() -> Column:
    nav = F.when(F.col("nav_mode") == 2, 3).when(F.col("nav_mode") == 1, 2).otherwise(0)
    fix = F.when(F.col("fix_mode").isin(4, 8), 4).when(F.col("fix_mode").isin(5, 9), 3).when(F.col("fix_mode").isin(2, 3), 2).when(F.col("fix_mode") == 1, 1).otherwise(0)
    spread = F.greatest(F.coalesce("lat_std", F.lit(0.0)), F.coalesce("lon_std", F.lit(0.0)))
    return F.when(F.col("valid_pos"), nav * 100 + fix * 10 - F.least(spread, F.lit(100.0)) / 100)


def present(names: list[str]) -> Column:
    """Bits of the named channels that are not null."""
    return F.expr(" + ".join(f"CASE WHEN {n} IS NOT NULL THEN {1 << CHANNELS.index(n)}L ELSE 0L END" for n in names))
