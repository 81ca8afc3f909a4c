"""What the plans share: cleaned results and the common part of their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import BITS, DRIFT_FIELDS, OUTLIER_FIELDS, REASON_BITS
from ..operators.quality import assess, project
from ..sources.telemetry import TELEMETRY_SQL, telemetry


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with its doubles rounded, so that the order of a sum does not show."""
    return df.withColumns({f.name: F.round(F.col(f.name), digits) + F.lit(0.0) for f in df.schema.fields if f.dataType.simpleString() == "double"}) if any(f.dataType.simpleString() == "double" for f in df.schema.fields) else df


def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(telemetry(spark, sf_dir))


def span(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """The first and the last time of the telemetry."""
    return tuple(telemetry(spark, sf_dir).agg(F.min("t_ms"), F.max("t_ms")).first())


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(assessed(spark, sf_dir))


def distance_sql(a: str, b: str, c: str, d: str) -> str:
    return f"(6371008.8 * 2 * asin(sqrt(least(1.0, pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2)))))"


def drift_sql(jump: str, dt: str, speed: str, before: str) -> str:
    reach = f"((greatest(coalesce({before}, 0.0), coalesce({speed}, 0.0)) + 15) * {dt})"
    return f"({jump} > {reach} + greatest(20.0, 5 * lat_std, 5 * lon_std) OR ({jump} > {reach} AND abs(coalesce({speed}, 0.0) - coalesce({before}, 0.0)) > greatest(1.0, 10 * {dt})))"


_OUT = sum(BITS[f] for f in OUTLIER_FIELDS)
_DRIFT = sum(BITS[f] for f in DRIFT_FIELDS)

#: t: telemetry; q: with mask, reasons, ground speed; v: the projected view; x: with what lies between rows.
COMMON = f"""
t AS ({TELEMETRY_SQL.replace('{events}', 'events')}),
l AS (
  SELECT *, lag(t_ms) OVER w AS p_t, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon, lag(speed) OVER w AS p_speed
  FROM t WINDOW w AS (PARTITION BY device_id ORDER BY t_ms, protocol)),
h AS (SELECT *, (t_ms - p_t) / 1000.0::DOUBLE AS dt, {distance_sql('p_lat', 'p_lon', 'lat', 'lon')} AS jump FROM l),
d AS (
  SELECT *, coalesce(t_ms - p_t BETWEEN 1 AND 3000 AND {drift_sql('jump', 'dt', 'speed', 'p_speed')}, false) AS drift,
         (speed > 130 / 3.6::DOUBLE OR sqrt(ve * ve + vn * vn) > 130 / 3.6::DOUBLE OR abs(vu) > 18 / 3.6::DOUBLE OR greatest(ve_std, vn_std, vu_std) > 5) AS outlier,
         fix_mode BETWEEN 1 AND 9 AS raw_valid,
         CASE WHEN ax IS NULL THEN 'unknown' WHEN abs(sqrt(ax * ax + ay * ay + az * az) - 1.0::DOUBLE) > 0.01::DOUBLE THEN 'moving' ELSE 'stationary' END AS vib
  FROM h),
g AS (
  SELECT *, CASE WHEN outlier OR drift THEN 'navigation_drift' WHEN protocol <> 'GPCHCX' THEN 'non_gpchcx' WHEN speed < 0 THEN 'missing_speed'
                 WHEN speed > 130 / 3.6::DOUBLE THEN 'velocity_solution_outlier' WHEN vib = 'unknown' THEN 'motion_unknown'
                 WHEN vib = 'stationary' THEN 'vibration_stationary' ELSE 'gpchcx_speed' END AS reason
  FROM d),
q AS (
  SELECT *, CASE reason WHEN 'vibration_stationary' THEN 0.0::DOUBLE WHEN 'gpchcx_speed' THEN speed END AS ground,
         CASE reason WHEN 'vibration_stationary' THEN 'stationary' WHEN 'gpchcx_speed' THEN 'moving' ELSE 'unknown' END AS motion_state,
         (CASE WHEN outlier THEN {_OUT} ELSE 0 END) | (CASE WHEN drift THEN {_DRIFT} ELSE 0 END) | (CASE WHEN reason NOT IN ('vibration_stationary', 'gpchcx_speed') THEN {BITS['speed']} ELSE 0 END) AS mask,
         CASE WHEN NOT raw_valid OR nav_mode = 0 THEN {REASON_BITS['invalid_navigation']} ELSE 0 END
         + CASE WHEN nav_mode <> 2 OR NOT fix_mode BETWEEN 1 AND 5 THEN {REASON_BITS['heading_unavailable']} ELSE 0 END
         + CASE WHEN speed < 1 OR NOT raw_valid THEN {REASON_BITS['course_unavailable']} ELSE 0 END
         + CASE WHEN outlier THEN {REASON_BITS['navigation_velocity_outlier']} ELSE 0 END
         + CASE WHEN drift THEN {REASON_BITS['navigation_position_drift']} ELSE 0 END
         + CASE WHEN reason NOT IN ('vibration_stationary', 'gpchcx_speed') THEN {REASON_BITS['speed_unavailable']} ELSE 0 END AS reasons
  FROM g),
v AS (
  SELECT * EXCLUDE (p_t, p_lat, p_lon, p_speed, dt, jump, lat, lon, alt, ve, vn, vu, course, course_std, speed, reason), reason, speed AS raw_speed,
         CASE WHEN NOT (outlier OR drift) THEN lat END AS lat, CASE WHEN NOT (outlier OR drift) THEN lon END AS lon,
         CASE WHEN NOT outlier THEN alt END AS alt, CASE WHEN NOT outlier THEN ve END AS ve, CASE WHEN NOT outlier THEN vn END AS vn,
         CASE WHEN NOT outlier THEN vu END AS vu, CASE WHEN NOT outlier THEN course END AS course, CASE WHEN NOT outlier THEN course_std END AS course_std,
         ground AS speed, fix_mode BETWEEN 1 AND 9 AND NOT (outlier OR drift) AS valid_pos
  FROM q),
y AS (
  SELECT *, lag(t_ms) OVER w AS p_t, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon, lag(speed) OVER w AS p_speed, lag(valid_pos) OVER w AS p_valid, lag(motion_state) OVER w AS p_state
  FROM v WINDOW w AS (PARTITION BY device_id ORDER BY t_ms, protocol)),
z AS (
  SELECT *, (t_ms - p_t) / 1000.0::DOUBLE AS dt, coalesce(t_ms - p_t BETWEEN 1 AND 3000, false) AS contiguous, {distance_sql('p_lat', 'p_lon', 'lat', 'lon')} AS step FROM y),
x0 AS (SELECT *, contiguous AND coalesce(p_valid AND valid_pos, false) AND coalesce({drift_sql('step', 'dt', 'speed', 'p_speed')}, false) AS jumped FROM z),
x AS (
  SELECT *, CASE WHEN contiguous AND p_valid AND valid_pos AND NOT jumped THEN dt ELSE 0.0 END AS covered_s,
         CASE WHEN contiguous AND p_state = 'moving' AND motion_state = 'moving' THEN dt ELSE 0.0 END AS moving_s,
         CASE WHEN contiguous AND p_valid AND valid_pos AND NOT jumped AND p_state = 'moving' AND motion_state = 'moving' AND speed IS NOT NULL AND p_speed IS NOT NULL THEN (speed + p_speed) / 2 * dt ELSE 0.0 END AS distance_m,
         coalesce(t_ms - p_t > 3000, false) AS gap
  FROM x0)"""


def sql(body: str) -> str:
    return f"WITH {COMMON.strip()}{body}"
