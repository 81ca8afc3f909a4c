"""Queries over the telemetry view: quality, motion, events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import ACTIVE_WARNINGS, BITS, CHANNELS, GROUPS, KINDS, LEAP_DAYS, REASON_BITS, REASONS
from ..functions.scalars import gps_to_unix, motion_state, warning_codes
from ..operators import episodes as ep
from ..operators import lifecycle, motion, quality
from ..sources.telemetry import telemetry
from .shared import assessed, distance_sql, drift_sql, rounded, span, sql, view

QUERIES, SQL = {}, {}


def query(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return put


@query(sql("""
SELECT device_id, count(*) AS samples, round(sum(distance_m) / 1000, 4) + 0.0 AS distance_km, round(sum(moving_s), 4) + 0.0 AS moving_s, round(sum(covered_s), 4) + 0.0 AS covered_s,
  round(max(speed) * 3.6, 4) + 0.0 AS max_kmh, round(sum(CASE WHEN fix_mode IN (4, 8) THEN 1 ELSE 0 END) / count(*) * 100, 4) + 0.0 AS fixed_pct,
  round(sum(CASE WHEN valid_pos THEN 1 ELSE 0 END) / count(*) * 100, 4) + 0.0 AS valid_pct, CAST(sum(CASE WHEN gap THEN 1 ELSE 0 END) AS BIGINT) AS gaps,
  round(count(speed) / count(*) * 100, 4) + 0.0 AS speed_pct, round((count(*) - 1) / ((max(t_ms) - min(t_ms)) / 1000.0), 4) + 0.0 AS sample_hz
FROM x GROUP BY device_id"""))
def trip_summary(spark, sf_dir):
    return rounded(motion.trip_summary(view(spark, sf_dir)), 4)


@query(sql("\nSELECT device_id, p_t AS start_ms, t_ms AS end_ms FROM l WHERE t_ms - p_t > 3000"))
def gaps(spark, sf_dir):
    return motion.gaps(telemetry(spark, sf_dir))


_SEGMENTS = """,
sg AS (
  SELECT *, CASE WHEN p_t IS NULL OR p_state <> motion_state OR NOT contiguous OR jumped THEN 1 ELSE 0 END AS fresh FROM x),
sn AS (SELECT *, sum(fresh) OVER (PARTITION BY device_id ORDER BY t_ms, protocol ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment FROM sg),
seg AS (
  SELECT device_id, CAST(segment AS BIGINT) AS segment, motion_state, min(t_ms) AS start_ms, max(t_ms) AS end_ms, sum(CASE WHEN fresh = 1 THEN 0.0 ELSE distance_m END) AS distance_m,
         max(speed) * 3.6 AS max_kmh, count(*) AS samples
  FROM sn GROUP BY ALL)"""


@query(sql(_SEGMENTS + "\nSELECT device_id, segment, motion_state, start_ms, end_ms, round(distance_m, 6) + 0.0 AS distance_m, round(max_kmh, 6) + 0.0 AS max_kmh, samples FROM seg"))
def motion_segments(spark, sf_dir):
    return rounded(motion.motion_segments(view(spark, sf_dir)))


@query(sql(_SEGMENTS + "\nSELECT device_id, segment, motion_state, start_ms, end_ms, samples FROM seg WHERE end_ms - start_ms >= 1000 ORDER BY start_ms, device_id, segment LIMIT 1000"))
def segment_report(spark, sf_dir):
    return motion.segment_report(motion.motion_segments(view(spark, sf_dir)), 1.0).select("device_id", "segment", "motion_state", "start_ms", "end_ms", "samples")


_STOPS = _SEGMENTS + """,
st AS (SELECT *, start_ms - lag(end_ms) OVER (PARTITION BY device_id ORDER BY start_ms, segment) AS wait FROM seg WHERE motion_state = 'stationary'),
su AS (SELECT *, sum(CASE WHEN wait BETWEEN 0 AND 3000 THEN 0 ELSE 1 END) OVER (PARTITION BY device_id ORDER BY start_ms, segment) AS stop FROM st),
stops AS (SELECT device_id, CAST(stop AS BIGINT) AS stop, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS parts, CAST(sum(samples) AS BIGINT) AS samples FROM su GROUP BY device_id, stop)"""


@query(sql(_STOPS + "\nSELECT * FROM stops"))
def stop_groups(spark, sf_dir):
    return motion.stop_groups(motion.motion_segments(view(spark, sf_dir)))


@query(sql(_STOPS + """,
mv AS (SELECT device_id, t_ms, lat, lon FROM v WHERE valid_pos AND motion_state = 'moving'),
nb AS (
  SELECT s.*, (SELECT max(t_ms) FROM mv WHERE mv.device_id = s.device_id AND mv.t_ms < s.start_ms) AS bt, (SELECT min(t_ms) FROM mv WHERE mv.device_id = s.device_id AND mv.t_ms > s.end_ms) AS at
  FROM stops s),
nc AS (SELECT nb.*, b.lat AS b_lat, b.lon AS b_lon, a.lat AS a_lat, a.lon AS a_lon FROM nb LEFT JOIN mv b ON nb.device_id = b.device_id AND nb.bt = b.t_ms LEFT JOIN mv a ON nb.device_id = a.device_id AND nb.at = a.t_ms),
cd AS (
  SELECT nc.device_id, stop, v.t_ms, v.lat, v.lon, b_lat, b_lon, a_lat, a_lon,
    CASE nav_mode WHEN 2 THEN 300 WHEN 1 THEN 200 ELSE 0 END + CASE WHEN fix_mode IN (4, 8) THEN 40 WHEN fix_mode IN (5, 9) THEN 30 WHEN fix_mode IN (2, 3) THEN 20 WHEN fix_mode = 1 THEN 10 ELSE 0 END
    - least(greatest(lat_std, lon_std), 100.0) / 100 AS confidence
  FROM nc JOIN v ON v.device_id = nc.device_id AND v.t_ms BETWEEN nc.start_ms AND nc.end_ms AND v.valid_pos AND v.motion_state = 'stationary'),
fs AS (SELECT *, first_value(lat) OVER w AS f_lat, first_value(lon) OVER w AS f_lon FROM cd WINDOW w AS (PARTITION BY device_id, stop ORDER BY t_ms)),
tg AS (SELECT *, coalesce((b_lat + a_lat) / 2, b_lat, a_lat, f_lat) AS y_lat, coalesce((b_lon + a_lon) / 2, b_lon, a_lon, f_lon) AS y_lon FROM fs),
aw AS (SELECT *, """ + distance_sql("y_lat", "y_lon", "lat", "lon") + """ AS away FROM tg),
nr AS (SELECT *, min(away) OVER (PARTITION BY device_id, stop) AS least_away FROM aw),
rk AS (SELECT *, row_number() OVER (PARTITION BY device_id, stop ORDER BY confidence DESC, away, t_ms) AS k FROM nr WHERE away <= least_away + 2.0)
SELECT device_id, stop, round(lat, 6) + 0.0 AS anchor_lat, round(lon, 6) + 0.0 AS anchor_lon, t_ms AS anchor_ms, round(confidence, 6) + 0.0 AS confidence FROM rk WHERE k = 1"""))
def stationary_anchor(spark, sf_dir):
    v = view(spark, sf_dir)
    return rounded(motion.stationary_anchor(v, motion.stop_groups(motion.motion_segments(v))))


@query(sql("\nSELECT device_id, vib AS state, count(*) AS n FROM d GROUP BY ALL"))
def motion_states(spark, sf_dir):
    return telemetry(spark, sf_dir).groupBy("device_id", motion_state().alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(sql("\nSELECT device_id, reason, motion_state AS state, count(*) AS n, round(sum(ground), 6) + 0.0 AS total FROM q GROUP BY ALL"))
def ground_speed(spark, sf_dir):
    g = assessed(spark, sf_dir).select("device_id", "ground.*")
    return rounded(g.groupBy("device_id", "reason", "state").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


@query(sql("\nSELECT device_id, CAST(mask AS BIGINT) AS mask, CAST(reasons AS BIGINT) AS reasons, count(*) AS n FROM q GROUP BY ALL"))
def quality_mask(spark, sf_dir):
    return assessed(spark, sf_dir).groupBy("device_id", "mask", "reasons").agg(F.count(F.lit(1)).alias("n"))


def _summary_sql() -> str:
    items = [("total", "true"), ("pending", "mask IS NULL"), ("excluded", "mask <> 0")]
    items += [(k, f"(reasons & {sum(b for n, b in REASON_BITS.items() if REASONS[n] == k)}) <> 0") for k in ("anomaly", "unavailable", "status")]
    items += [(f"reason:{n}", f"(reasons & {b}) <> 0") for n, b in REASON_BITS.items()] + [(f"field:{n}", f"(mask & {b}) <> 0") for n, b in BITS.items()]
    parts = " UNION ALL ".join(f"SELECT device_id, '{n}' AS item, count(*) AS n FROM q WHERE {c} GROUP BY device_id" for n, c in items)
    return sql("\n" + parts)


@query(_summary_sql())
def quality_summary(spark, sf_dir):
    return quality.quality_summary(assessed(spark, sf_dir))


def _names(column: str, names) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN ({column} & {1 << i}) <> 0 THEN '{n}' END" for i, n in enumerate(names)) + "], lambda x: x IS NOT NULL), '|')"


@query(sql(f"""
SELECT device_id, t_ms, protocol, {_names('mask', CHANNELS)} AS fields, {_names('reasons', REASONS)} AS codes,
  (SELECT count(*) FROM q WHERE mask <> 0 AND (reasons & {sum(b for n, b in REASON_BITS.items() if REASONS[n] in ('anomaly', 'unavailable'))}) <> 0) > 120 AS has_more
FROM q WHERE mask <> 0 AND (reasons & {sum(b for n, b in REASON_BITS.items() if REASONS[n] in ('anomaly', 'unavailable'))}) <> 0
ORDER BY t_ms DESC, device_id, protocol LIMIT 100 OFFSET 20"""))
def quality_records(spark, sf_dir):
    rows = quality.quality_records(assessed(spark, sf_dir), offset=20, limit=100)
    return rows.select("device_id", "t_ms", "protocol", F.array_join("fields", "|").alias("fields"), F.array_join("codes", "|").alias("codes"), "has_more")


@query(sql("\nSELECT device_id, code, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT device_id, '{n}' AS code FROM q WHERE (reasons & {b}) <> 0" for n, b in REASON_BITS.items()) + ") GROUP BY ALL"))
def quality_reasons(spark, sf_dir):
    return quality.explain_quality(assessed(spark, sf_dir)).groupBy("device_id", "code").agg(F.count(F.lit(1)).alias("n"))


@query(sql("\nSELECT device_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN (warning & {1 << b}) <> 0 THEN '{b}' END" for b in ACTIVE_WARNINGS) + "], lambda c: c IS NOT NULL), '|') AS codes, count(*) AS n FROM t GROUP BY ALL"))
def warning_labels(spark, sf_dir):
    return telemetry(spark, sf_dir).groupBy("device_id", F.array_join(warning_codes().cast("array<string>"), "|").alias("codes")).agg(F.count(F.lit(1)).alias("n"))


@query(sql("\nSELECT device_id, t_ms, round(jump, 4) + 0.0 AS distance_m, round((greatest(speed, p_speed) + 15) * dt + greatest(20.0, 5 * lat_std, 5 * lon_std), 4) + 0.0 AS limit_m FROM d WHERE drift"))
def position_drift(spark, sf_dir):
    return rounded(quality.position_drift(telemetry(spark, sf_dir)).where("drift IS NOT NULL").select("device_id", "t_ms", "drift.distance_m", "drift.limit_m"), 4)


@query(sql("\nSELECT device_id, t_ms, protocol, round(jump, 4) + 0.0 AS distance_m, (SELECT count(*) FROM d WHERE drift) AS total FROM d WHERE drift ORDER BY t_ms, device_id, protocol LIMIT 20"))
def jump_log(spark, sf_dir):
    from ..operators.audit import jump_log as log

    return rounded(log(quality.position_drift(telemetry(spark, sf_dir))).select("device_id", "t_ms", "protocol", "distance_m", "total"), 4)


@query(sql(""",
oi AS (SELECT *, lag(t_ms) OVER (PARTITION BY device_id ORDER BY t_ms, protocol) AS o_t FROM d WHERE outlier),
oj AS (SELECT *, sum(CASE WHEN o_t IS NULL OR t_ms - o_t > 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY t_ms, protocol ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM oi)
SELECT device_id, CAST(k AS BIGINT) AS interval, min(t_ms) AS start_ms, max(t_ms) AS end_ms, count(*) AS samples, max(speed) AS max_speed, max(abs(vu)) AS max_vertical FROM oj GROUP BY device_id, k"""))
def outlier_intervals(spark, sf_dir):
    from ..functions.scalars import velocity_outlier

    return ep.outlier_intervals(telemetry(spark, sf_dir), velocity_outlier())


_SIGNALS = """,
b AS (
  SELECT *, min(t_ms) OVER r AS b_t, arg_min(speed, t_ms) FILTER (true) OVER r AS b_speed
  FROM (SELECT t_ms, protocol, device_id, speed, ax, ay, az, roll, pitch, mask FROM v) WINDOW r AS (PARTITION BY device_id ORDER BY t_ms RANGE BETWEEN 1500 PRECEDING AND 800 PRECEDING)),
b1 AS (SELECT b.*, o.speed AS o_speed FROM b LEFT JOIN v o ON o.device_id = b.device_id AND o.t_ms = b.b_t),
ac AS (SELECT *, (speed - o_speed) / ((t_ms - b_t) / 1000.0::DOUBLE) AS accel, abs(sqrt(ax * ax + ay * ay + az * az) - 1.0::DOUBLE) AS shock FROM b1),
sig AS (
  SELECT device_id, t_ms, protocol, 'overspeed' AS kind, speed * 3.6 AS value, 85.0::DOUBLE AS threshold FROM ac WHERE speed * 3.6 > 85
  UNION ALL SELECT device_id, t_ms, protocol, 'acceleration', accel, 14.0 FROM ac WHERE accel > 14
  UNION ALL SELECT device_id, t_ms, protocol, 'braking', -accel, 15.0 FROM ac WHERE -accel > 15
  UNION ALL SELECT device_id, t_ms, protocol, 'roll', abs(roll), 20.0 FROM ac WHERE abs(roll) > 20
  UNION ALL SELECT device_id, t_ms, protocol, 'pitch', abs(pitch), 18.0 FROM ac WHERE abs(pitch) > 18
  UNION ALL SELECT device_id, t_ms, protocol, 'shock', shock, 0.7 FROM ac WHERE shock > 0.7)"""


@query(sql(_SIGNALS + "\nSELECT device_id, count(accel) AS n, round(sum(accel), 4) + 0.0 AS total, round(max(accel), 6) + 0.0 AS greatest FROM ac GROUP BY device_id"))
def accel_baseline(spark, sf_dir):
    out = ep.accel_baseline(view(spark, sf_dir)).groupBy("device_id").agg(F.count("accel").alias("n"), F.sum("accel").alias("total"), F.max("accel").alias("greatest"))
    return out.select("device_id", "n", (F.round("total", 4) + 0.0).alias("total"), (F.round("greatest", 6) + 0.0).alias("greatest"))


@query(sql(_SIGNALS + "\nSELECT device_id, kind, count(*) AS n, round(sum(value), 3) + 0.0 AS total FROM sig GROUP BY ALL"))
def threshold_signals(spark, sf_dir):
    s = ep.threshold_signals(view(spark, sf_dir))
    return rounded(s.groupBy("device_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 3)


_EPISODES = _SIGNALS + """,
ix AS (SELECT device_id, t_ms, protocol, row_number() OVER (PARTITION BY device_id ORDER BY t_ms, protocol) AS idx FROM v),
si AS (SELECT sig.*, round(value, 5) AS val, idx FROM sig JOIN ix USING (device_id, t_ms, protocol)),
sj AS (SELECT *, CASE WHEN idx - lag(idx) OVER w > 1 OR t_ms - lag(t_ms) OVER w > 3000 OR lag(idx) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM si WINDOW w AS (PARTITION BY device_id, kind ORDER BY idx)),
sk AS (SELECT *, sum(fresh) OVER (PARTITION BY device_id, kind ORDER BY idx) AS run FROM sj),
epi AS (
  SELECT device_id, kind, min(t_ms) AS start_ms, max(t_ms) AS end_ms, max(val) AS peak, count(*) AS samples, max(threshold) AS threshold, run FROM sk GROUP BY device_id, kind, run),
ev AS (SELECT e.*, (SELECT min(t_ms) FROM sk WHERE sk.device_id = e.device_id AND sk.kind = e.kind AND sk.run = e.run AND sk.val = e.peak) AS peak_ms FROM epi e)"""


def _episodes(spark, sf_dir):
    return ep.episodes(ep.signal_rows(view(spark, sf_dir)))


@query(sql(_EPISODES + "\nSELECT device_id, kind, start_ms, end_ms, round(peak, 4) + 0.0 AS peak, peak_ms, samples, threshold FROM ev"))
def episodes(spark, sf_dir):
    return rounded(_episodes(spark, sf_dir).select("device_id", "kind", "start_ms", "end_ms", "peak", "peak_ms", "samples", "threshold"), 4)


_GATED = _EPISODES + ",\nge AS (SELECT ev.* FROM ev JOIN q ON q.device_id = ev.device_id AND q.t_ms = ev.peak_ms WHERE (q.mask & CASE ev.kind " + " ".join(f"WHEN '{k}' THEN {sum(BITS[f] for f in fields)}" for k, (_, fields) in KINDS.items()) + " END) = 0)"


def _gated(spark, sf_dir):
    return ep.gate_events(_episodes(spark, sf_dir), assessed(spark, sf_dir))


@query(sql(_GATED + "\nSELECT device_id, kind, start_ms, end_ms, round(peak, 4) + 0.0 AS peak, samples FROM ge"))
def gated_events(spark, sf_dir):
    return rounded(_gated(spark, sf_dir).select("device_id", "kind", "start_ms", "end_ms", "peak", "samples"), 4)


_GROUP = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{g}'" for k, (g, _) in KINDS.items()) + " END"


@query(sql(_GATED + f"""
SELECT grp, CAST(k AS INTEGER) AS rank, device_id, kind, start_ms, round(peak, 4) + 0.0 AS peak, threshold, round(peak - threshold, 4) + 0.0 AS excess FROM (
  SELECT *, {_GROUP} AS grp, row_number() OVER (PARTITION BY {_GROUP} ORDER BY peak - threshold DESC, peak DESC, start_ms DESC, device_id, kind) AS k FROM ge) WHERE k <= 10"""))
def event_top10(spark, sf_dir):
    return rounded(ep.event_top_k(_gated(spark, sf_dir)).drop("excess_pct"), 4)


@query(sql(_GATED + f"\nSELECT g AS grp, count(ge.kind) AS n FROM (SELECT unnest({GROUPS}) AS g) LEFT JOIN ge ON {_GROUP} = g GROUP BY g"))
def event_groups(spark, sf_dir):
    return ep.event_counts(_gated(spark, sf_dir))


@query(sql(_GATED + """
SELECT device_id, kind, start_ms, (SELECT count(*) FROM ge WHERE start_ms <= (SELECT max(t_ms) FROM t)) AS total, (SELECT count(*) FROM ge) > 50 AS truncated
FROM ge ORDER BY start_ms DESC, device_id, kind LIMIT 50"""))
def event_list(spark, sf_dir):
    return ep.list_events(_gated(spark, sf_dir), *span(spark, sf_dir), 50).select("device_id", "kind", "start_ms", "total", "truncated")


@query(sql(""",
dj AS (
  SELECT *, """ + distance_sql("p_lat", "p_lon", "lat", "lon") + """ AS jump
  FROM (SELECT *, lag(fix_mode) OVER w AS p_fix, lag(lat_std) OVER w AS p_lat_std, lag(lon_std) OVER w AS p_lon_std FROM l WINDOW w AS (PARTITION BY device_id ORDER BY t_ms, protocol)))
SELECT kind, count(*) AS n FROM (
  SELECT 'fix_degraded' AS kind FROM t WHERE fix_mode NOT IN (4, 8) UNION ALL SELECT 'heading_unavailable' FROM t WHERE nav_mode <> 2 OR fix_mode IN (0, 6, 7, 8, 9)
  UNION ALL SELECT 'hardware_warning' FROM t WHERE (warning & 25058) <> 0 UNION ALL SELECT 'diff_age' FROM t WHERE age > 10
  UNION ALL SELECT 'position_std' FROM t WHERE greatest(lat_std, lon_std) > 2 UNION ALL SELECT 'data_gap' FROM l WHERE t_ms - p_t > 3000
  UNION ALL SELECT 'position_jump' FROM dj WHERE t_ms - p_t BETWEEN 1 AND 3000 AND p_fix BETWEEN 1 AND 9 AND fix_mode BETWEEN 1 AND 9
    AND jump > (greatest(speed, p_speed) + 15) * (t_ms - p_t) / 1000.0::DOUBLE + greatest(20.0, 5 * lat_std, 5 * lon_std, 5 * p_lat_std, 5 * p_lon_std)) GROUP BY kind"""))
def diagnostic_conditions(spark, sf_dir):
    from ..functions.scalars import valid_position

    found = ep.diagnostic_conditions(telemetry(spark, sf_dir).withColumn("valid_pos", valid_position()))
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(sql("\nSELECT device_id, min(t_ms) AS first_ms, max(t_ms) AS last_ms, count(*) AS points, arg_max(speed, t_ms) AS latest_speed FROM t GROUP BY device_id"))
def device_dim(spark, sf_dir):
    return lifecycle.device_dim(telemetry(spark, sf_dir)).select("device_id", "first_ms", "last_ms", "points", F.col("latest.speed").alias("latest_speed"))


@query(sql("\nSELECT device_id, t_ms, protocol, speed, lat, lon, fix_mode, nav_mode FROM t QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY t_ms DESC, protocol DESC) = 1"))
def device_latest(spark, sf_dir):
    return lifecycle.device_latest(telemetry(spark, sf_dir))


@query("SELECT event_id, CASE WHEN event_id % 9000 <= 8191 THEN round(315964800.0::DOUBLE + (event_id % 9000) * 604800 + (event_id % 604800) + 0.25 - " + "(" + " + ".join(f"CASE WHEN 315964800.0::DOUBLE + (event_id % 9000) * 604800 + (event_id % 604800) + 0.25 >= epoch(DATE '{d}') + {n} THEN 1 ELSE 0 END" for n, d in enumerate(LEAP_DAYS, 1)) + "), 3) END AS t FROM events")
def gps_time(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", gps_to_unix((F.col("event_id") % 9000).cast("int"), (F.col("event_id") % 604800) + 0.25).alias("t"))

