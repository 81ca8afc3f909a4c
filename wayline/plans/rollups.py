"""Queries over rollups, vibration, series and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, motion, paths, rollup, series, vibration
from ..operators.quality import assess, project
from ..sources.telemetry import telemetry
from .shared import assessed, distance_sql, drift_sql, rounded, span, sql, view
from .telemetry import _SEGMENTS as SEGMENTS

QUERIES, SQL = {}, {}


def query(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return put


_SHOWN = ["speed", "heading"]


def _rolled(seconds: int, source: str = "x") -> str:
    ms = seconds * 1000
    last = ", ".join(f"arg_max({m}, t_ms) FILTER ({m} IS NOT NULL) AS {m}_last, min({m}) AS {m}_min, max({m}) AS {m}_max, sum({m}) AS {m}_sum, count({m}) AS {m}_n" for m in _SHOWN)
    inside = f"CAST(floor(p_t / {ms}) AS BIGINT) * {ms} = CAST(floor(t_ms / {ms}) AS BIGINT) * {ms}"
    sums = ", ".join(f"sum(CASE WHEN {inside} THEN {c} ELSE 0.0 END) AS {c}" for c in ("covered_s", "moving_s", "distance_m"))
    return f"""
  SELECT device_id, CAST(floor(t_ms / {ms}) AS BIGINT) * {ms} AS bucket_ms, CAST(count(*) AS BIGINT) AS points, CAST(sum(CASE WHEN fix_mode IN (4, 8) THEN 1 ELSE 0 END) AS BIGINT) AS fixed,
    CAST(sum(CASE WHEN valid_pos THEN 1 ELSE 0 END) AS BIGINT) AS valid, max(speed) * 3.6 AS max_kmh, {sums}, CAST(sum(CASE WHEN {inside} AND gap THEN 1 ELSE 0 END) AS BIGINT) AS gaps,
    min(force) AS vib_min, max(force) AS vib_max, sum(force) AS vib_sum, sum(force * force) AS vib_sq, count(force) AS vib_n, min(t_ms) AS first_ms, max(t_ms) AS last_ms, {last}
  FROM (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS force FROM {source}) GROUP BY ALL"""


_COLUMNS = "device_id, bucket_ms, points, fixed, valid, gaps, vib_n, " + ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in ("max_kmh", "covered_s", "moving_s", "distance_m", "vib_min", "vib_max", "vib_sum", "speed_min", "speed_max", "speed_sum", "speed_last", "heading_last"))


def _columns(df):
    names = ["max_kmh", "covered_s", "moving_s", "distance_m", "vib_min", "vib_max", "vib_sum", "speed_min", "speed_max", "speed_sum", "speed_last", "heading_last"]
    return rounded(df.select("device_id", "bucket_ms", "points", "fixed", "valid", "gaps", "vib_n", *names), 4)


@query(sql(f"\nSELECT {_COLUMNS} FROM ({_rolled(60)})"))
def rollup_60(spark, sf_dir):
    return _columns(rollup.rollup(view(spark, sf_dir)))


@query(sql(f"\nSELECT {_COLUMNS} FROM ({_rolled(600)})"))
def rollup_600(spark, sf_dir):
    """Merged from the 60 s level; the SQL computes it from rows."""
    return _columns(rollup.rerollup(rollup.rollup(view(spark, sf_dir))))


#: A range within the data whose ends lie in the middle of buckets.
_LO, _HI = "(SELECT min(t_ms) + 17300 FROM t)", "(SELECT max(t_ms) - 8800 FROM t)"


@query(sql(f"""
SELECT device_id, count(*) AS points, round(sum(speed), 4) + 0.0 AS speed_sum, round(max(speed) * 3.6, 4) + 0.0 AS max_kmh,
  round(sum(CASE WHEN p_t >= {_LO} THEN covered_s ELSE 0 END), 4) + 0.0 AS covered_s, round(sum(CASE WHEN p_t >= {_LO} THEN moving_s ELSE 0 END), 4) + 0.0 AS moving_s,
  round(sum(CASE WHEN p_t >= {_LO} THEN distance_m ELSE 0 END), 4) + 0.0 AS distance_m, CAST(sum(CASE WHEN p_t >= {_LO} AND gap THEN 1 ELSE 0 END) AS BIGINT) AS gaps,
  array_to_string(list_sort(list(DISTINCT fix_mode)), ',') AS fixes
FROM x WHERE t_ms BETWEEN {_LO} AND {_HI} GROUP BY device_id"""))
def hybrid_range(spark, sf_dir):
    """The range from whole 60 s buckets and rows at its ends, merged over the seams; the SQL computes it from rows."""
    lo, hi = span(spark, sf_dir)
    lo, hi = lo + 17_300, hi - 8_800
    t = telemetry(spark, sf_dir).where(F.col("t_ms").between(lo - 3000, hi))
    # Rows are cut to the range (with what a first row looks back) before they are assessed, and those of its ends are assessed by themselves.
    ends = project(assess(t.where((F.col("t_ms") < lo + 60_000) | (F.col("t_ms") > hi - 63_000))))
    h = rollup.range_summary(rollup.hybrid_range(ends, rollup.rollup(project(assess(t)), 60, ["speed"]), lo, hi, 60, ["speed"]), ["speed"])
    return rounded(h.select("device_id", "points", "speed_sum", "max_kmh", "covered_s", "moving_s", "distance_m", "gaps", F.array_join(F.array_sort(F.map_keys("fixes")), ",").alias("fixes")), 4)


#: The middle half of the data's time, in 60 bins.
_AT = "(SELECT min(t_ms) + (max(t_ms) - min(t_ms)) // 4 FROM t)"
_TO = "(SELECT max(t_ms) - (max(t_ms) - min(t_ms)) // 4 FROM t)"
_BINNED = f""",
r60 AS ({_rolled(60)}),
bn AS (SELECT *, least(59, greatest(0, CAST(floor(((first_ms + last_ms) / 2.0::DOUBLE - {_AT}) / ({_TO} - {_AT}) * 60) AS BIGINT))) AS bin FROM r60 WHERE last_ms >= {_AT} AND first_ms <= {_TO})"""


def _series(spark, sf_dir):
    lo, hi = span(spark, sf_dir)
    quarter = (hi - lo) // 4
    # Whole buckets of the range, with what their first rows look back.
    near = telemetry(spark, sf_dir).where(F.col("t_ms").between((lo + quarter) // 60_000 * 60_000 - 3000, (hi - quarter) // 60_000 * 60_000 + 59_999))
    return rollup.display_series(rollup.rollup(project(assess(near)), 60, ["speed", "heading"]), lo + quarter, hi - quarter, 60)


@query(sql(f"""{_BINNED}
SELECT device_id, bin, min(first_ms) AS t_ms, CAST(sum(points) AS BIGINT) AS points, round(sum(speed_sum) / sum(speed_n), 4) + 0.0 AS speed, round(min(speed_min), 4) + 0.0 AS speed_min, round(max(speed_max), 4) + 0.0 AS speed_max,
  arg_max(heading_last, bucket_ms) FILTER (heading_n > 0) AS heading, min(heading_min) AS heading_min, max(heading_max) AS heading_max
FROM bn GROUP BY device_id, bin"""))
def display_series(spark, sf_dir):
    return rounded(_series(spark, sf_dir), 4)


@query(sql(f"{_BINNED}\nSELECT device_id, round(min(speed_min), 4) + 0.0 AS speed_min, round(max(speed_max), 4) + 0.0 AS speed_max, min(heading_min) AS heading_min, max(heading_max) AS heading_max FROM bn GROUP BY device_id"))
def series_ranges(spark, sf_dir):
    return rounded(rollup.series_ranges(_series(spark, sf_dir), ["speed", "heading"]), 4)


@query(sql(f"\nSELECT device_id, bucket_ms, round(vib_sum / vib_n, 6) + 0.0 AS mean, round(sqrt(greatest(0.0, vib_sq / vib_n - (vib_sum / vib_n) * (vib_sum / vib_n))), 6) + 0.0 AS rms, round(greatest(abs(vib_min - 1), abs(vib_max - 1)), 6) + 0.0 AS peak, vib_n AS n FROM ({_rolled(60)}) WHERE vib_n > 0"))
def vibration_trend(spark, sf_dir):
    return rounded(rollup.vibration_trend(rollup.rollup(view(spark, sf_dir))))


@query(sql(f"\nSELECT device_id, round(sqrt(greatest(0.0, sum(vib_sq - vib_sum * vib_sum / vib_n) / sum(vib_n))), 6) + 0.0 AS rms, round(max(greatest(abs(vib_min - 1), abs(vib_max - 1))), 6) + 0.0 AS peak, round(max(vib_max - vib_min), 6) + 0.0 AS span, round(sum(vib_sum) / sum(vib_n), 6) + 0.0 AS mean FROM ({_rolled(60)}) WHERE vib_n > 0 GROUP BY device_id"))
def vibration_range(spark, sf_dir):
    return rounded(rollup.vibration_range(rollup.rollup(view(spark, sf_dir))))


def _status_sql() -> str:
    raw = "(SELECT count(*) FROM t WHERE t.device_id = r.device_id)"
    part = lambda level, rows: f"SELECT device_id, CAST({level} AS INTEGER) AS level, count(*) AS buckets, CAST(sum(points) AS BIGINT) AS points, {raw} AS raw, abs(CAST(sum(points) AS BIGINT) - {raw}) <= 600 AS ready FROM ({rows}) r GROUP BY device_id"
    holed = f"SELECT * FROM ({_rolled(600)}) WHERE device_id <> 'D1' OR bucket_ms > (SELECT min(bucket_ms) FROM ({_rolled(600)}))"
    return sql(f"\n{part(60, _rolled(60))} UNION ALL {part(600, holed)}")


@query(_status_sql())
def rollup_status(spark, sf_dir):
    """The 600 s level of one device lacks its first bucket, so that this level isn't ready."""
    v = view(spark, sf_dir)
    coarse = rollup.rerollup(rollup.rollup(v))
    start = F.lit(span(spark, sf_dir)[0])
    holed = coarse.where((F.col("device_id") != "D1") | (F.col("bucket_ms") > start))
    return rollup.rollup_status(v, {60: rollup.rollup(v), 600: holed})


_SEGMENTS = SEGMENTS


def _paths_600(spark, sf_dir):
    return paths.path_rerollup(paths.path_rollup(view(spark, sf_dir), 60, ["speed"]), 600, ["speed"])


@query(sql(_SEGMENTS + "\nSELECT device_id, segment, motion_state, start_ms, end_ms, round(distance_m, 6) + 0.0 AS distance_m, round(max_kmh, 6) + 0.0 AS max_kmh, samples FROM seg"))
def rollup_segments(spark, sf_dir):
    """The motion segments from 600 s buckets that were merged from 60 s ones; the SQL computes them from rows."""
    return rounded(paths.segments_from(_paths_600(spark, sf_dir)))


@query(sql(_SEGMENTS + """,
sb AS (SELECT *, unnest(range(CAST(floor(start_ms / 60000) AS BIGINT), CAST(floor(end_ms / 60000) AS BIGINT) + 1)) * 60000 AS bucket_ms FROM seg),
bw AS (SELECT device_id, bucket_ms, motion_state, round(sum(greatest((least(end_ms, bucket_ms + 60000) - greatest(start_ms, bucket_ms)) / 1000.0::DOUBLE, 0.1)), 6) AS w FROM sb GROUP BY ALL)
SELECT device_id, bucket_ms, motion_state AS state, w + 0.0 AS seconds FROM bw QUALIFY row_number() OVER (PARTITION BY device_id, bucket_ms ORDER BY w DESC, motion_state = 'moving' DESC, motion_state DESC) = 1"""))
def bucket_state(spark, sf_dir):
    return rounded(rollup.bucket_state(motion.motion_segments(view(spark, sf_dir))))


@query(sql("\nSELECT DISTINCT device_id, level, CAST(floor(t_ms / (level * 1000)) AS BIGINT) * level * 1000 AS bucket_ms FROM t, (SELECT CAST(unnest([60, 600]) AS INTEGER) AS level)"))
def touched_buckets(spark, sf_dir):
    return rollup.touched_buckets(telemetry(spark, sf_dir))


@query(sql(_SEGMENTS + """,
rc AS (SELECT *, max(end_ms) OVER (PARTITION BY device_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM seg),
rr AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach + 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM rc)
SELECT device_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM rr GROUP BY device_id, k"""))
def coalesced_intervals(spark, sf_dir):
    return rollup.coalesce_intervals(motion.motion_segments(view(spark, sf_dir)), 2000)


_RUNS = """,
vs AS (SELECT device_id, t_ms, sqrt(ax * ax + ay * ay + az * az) AS v FROM t WHERE ax IS NOT NULL),
vn AS (SELECT *, CASE WHEN t_ms - lag(t_ms) OVER (PARTITION BY device_id ORDER BY t_ms) <= 160 THEN 0 ELSE 1 END AS fresh FROM vs),
vr AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY device_id ORDER BY t_ms) AS BIGINT) AS run FROM vn),
runs AS (SELECT device_id, run, row_number() OVER (PARTITION BY device_id, run ORDER BY t_ms) - 1 AS idx, t_ms, v FROM vr)"""


@query(sql(_RUNS + "\nSELECT device_id, run, count(*) AS samples, min(t_ms) AS start_ms, round(sum(v), 4) + 0.0 AS total FROM runs GROUP BY device_id, run"))
def vibration_runs(spark, sf_dir):
    r = vibration.vibration_runs(telemetry(spark, sf_dir))
    return rounded(r.groupBy("device_id", "run").agg(F.count(F.lit(1)).alias("samples"), F.min("t_ms").alias("start_ms"), F.sum("v").alias("total")), 4)


def _whole(spark, sf_dir):
    """Telemetry without its missing IMU rows is gapless between the long breaks, so that 60 s windows exist."""
    return vibration.vibration_runs(telemetry(spark, sf_dir).withColumn("ax", F.coalesce("ax", F.lit(1.0))))


def _residual(runs):
    return vibration.detrend(vibration.window_samples(runs, vibration.best_window(runs)))


_BEST = _RUNS.replace("WHERE ax IS NOT NULL", "").replace("sqrt(ax * ax", "sqrt(coalesce(ax, 1.0) * coalesce(ax, 1.0)") + """,
st AS (SELECT *, (t_ms - lag(t_ms) OVER (PARTITION BY device_id, run ORDER BY idx)) / 1000.0::DOUBLE AS step FROM runs),
fit AS (SELECT device_id, run, count(*) AS samples, 1 / median(step) AS hz, greatest(100, CAST(round_even(1 / median(step) * 60, 0) AS BIGINT)) AS n FROM st GROUP BY ALL),
ok AS (SELECT * FROM fit WHERE samples >= n AND samples >= 100 AND hz BETWEEN 8.0 AND 10.5),
win AS (
  SELECT a.device_id, a.run, a.idx, a.t_ms, ok.n, count(*) AS have, avg(b.v) AS mv, avg((b.idx - a.idx)::DOUBLE) AS mx, sum(b.v * b.v) AS s2, sum(b.v) AS s1, sum(b.v * (b.idx - a.idx)) AS sx, sum((b.idx - a.idx)::DOUBLE * (b.idx - a.idx)) AS xx
  FROM ok JOIN runs a ON a.device_id = ok.device_id AND a.run = ok.run AND a.idx + ok.n <= ok.samples JOIN runs b ON b.device_id = a.device_id AND b.run = a.run AND b.idx BETWEEN a.idx AND a.idx + ok.n - 1
  GROUP BY ALL),
sc AS (SELECT *, sqrt(greatest(0.0, (s2 - n * mv * mv - (sx - n * mx * mv) * (sx - n * mx * mv) / (xx - n * mx * mx)) / n)) AS rms FROM win),
best AS (SELECT device_id, run, idx, t_ms, n, rms FROM sc QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY round(rms, 9) DESC, t_ms) = 1)"""


@query(sql(_BEST + "\nSELECT device_id, run, idx, t_ms, CAST(n AS BIGINT) AS n, round(rms, 6) + 0.0 AS rms FROM best"))
def vibration_best_window(spark, sf_dir):
    return rounded(vibration.best_window(_whole(spark, sf_dir)).select("device_id", "run", "idx", "t_ms", F.col("n").cast("bigint").alias("n"), "rms"))


_RESIDUAL = _BEST + """,
ws AS (SELECT r.device_id, r.t_ms, r.idx - b.idx AS k, r.v FROM runs r JOIN best b ON r.device_id = b.device_id AND r.run = b.run AND r.idx >= b.idx AND r.idx < b.idx + b.n),
w0 AS (SELECT *, (t_ms - min(t_ms) OVER (PARTITION BY device_id)) / 1000.0::DOUBLE AS s FROM ws),
ln AS (SELECT device_id, regr_slope(v, s) AS a, regr_intercept(v, s) AS b FROM w0 GROUP BY device_id),
res AS (SELECT w0.device_id, t_ms, k, v - a * s - b AS x FROM w0 JOIN ln USING (device_id))"""


@query(sql(_RESIDUAL + "\nSELECT device_id, round(sqrt(avg(x * x)), 6) + 0.0 AS rms, round(max(abs(x)), 6) + 0.0 AS peak, round(max(x) - min(x), 6) + 0.0 AS peak_to_peak, round(max(abs(x)) / sqrt(avg(x * x)), 6) + 0.0 AS crest FROM res GROUP BY device_id"))
def vibration_measures(spark, sf_dir):
    runs = _whole(spark, sf_dir)
    return rounded(vibration.window_measures(_residual(runs)))


@query(sql(_RESIDUAL + """,
sp AS (SELECT device_id, count(*) AS n, (count(*) - 1) / ((max(t_ms) - min(t_ms)) / 1000.0::DOUBLE) AS rate FROM res GROUP BY device_id),
bi AS (SELECT *, unnest(range(1, CAST(floor(least(4.0, 0.4 * rate) * n / rate) AS BIGINT) + 1)) AS bin FROM sp),
cs AS (
  SELECT bi.device_id, bin, any_value(rate) AS rate, any_value(n) AS n, sum(x * (0.5 - 0.5 * cos(2 * pi() * k / (n - 1))) * cos(2 * pi() * bin * k / n)) AS c, sum(x * (0.5 - 0.5 * cos(2 * pi() * k / (n - 1))) * sin(2 * pi() * bin * k / n)) AS s, sum(0.5 - 0.5 * cos(2 * pi() * k / (n - 1))) AS sw
  FROM bi JOIN res USING (device_id) GROUP BY bi.device_id, bin)
SELECT device_id, CAST(bin AS INTEGER) AS bin, round(bin * rate / n, 6) + 0.0 AS hz, round(2 * sqrt(c * c + s * s) / sw, 6) + 0.0 AS amplitude FROM cs"""))
def vibration_spectrum(spark, sf_dir):
    runs = _whole(spark, sf_dir)
    return rounded(vibration.spectrum(_residual(runs)))


@query(sql(_RESIDUAL + "\nSELECT device_id, k, CASE WHEN count(x) OVER w = 10 THEN round(sqrt(avg(x * x) OVER w), 6) + 0.0 END AS envelope FROM res WINDOW w AS (PARTITION BY device_id ORDER BY k ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"))
def rms_envelope(spark, sf_dir):
    runs = _whole(spark, sf_dir)
    return rounded(vibration.rms_envelope(_residual(runs)).select("device_id", "k", "envelope"))


_CANDIDATES = f""",
cb AS ({_rolled(60)}),
c0 AS (SELECT device_id, bucket_ms, vib_n, row_number() OVER (PARTITION BY device_id ORDER BY vib_n >= 100 DESC, sqrt(greatest(0.0, vib_sq / vib_n - (vib_sum / vib_n) * (vib_sum / vib_n))) DESC, greatest(vib_sum / vib_n - vib_min, vib_max - vib_sum / vib_n) DESC, bucket_ms) AS k,
  min(bucket_ms) OVER (PARTITION BY device_id) AS lo, max(bucket_ms) OVER (PARTITION BY device_id) AS hi FROM cb),
cand AS (SELECT DISTINCT device_id, bucket_ms + o AS bucket_ms FROM c0, (SELECT unnest([-60000, 0, 60000]) AS o) WHERE (vib_n >= 100 AND k <= 2) OR bucket_ms IN (lo, hi))"""


@query(sql(f"{_CANDIDATES}\nSELECT * FROM cand"))
def vibration_candidates(spark, sf_dir):
    """The two best buckets, the edges and their neighbours."""
    return vibration.candidates(rollup.rollup(view(spark, sf_dir)), 2)


@query(sql(_CANDIDATES + _BEST.replace("FROM t", "FROM (SELECT * FROM t WHERE EXISTS (SELECT 1 FROM cand WHERE cand.device_id = t.device_id AND t.t_ms BETWEEN cand.bucket_ms AND cand.bucket_ms + 59999))", 1) + "\nSELECT device_id, t_ms, CAST(n AS BIGINT) AS n, round(rms, 6) + 0.0 AS rms FROM best"))
def vibration_two_stage(spark, sf_dir):
    """The best window searched in candidate buckets only."""
    filled = telemetry(spark, sf_dir).withColumn("ax", F.coalesce("ax", F.lit(1.0)))
    best = vibration.two_stage(filled, vibration.candidates(rollup.rollup(view(spark, sf_dir)), 2), 10_000.0)
    return rounded(best.select("device_id", "t_ms", F.col("n").cast("bigint").alias("n"), "rms"))


@query(sql(_RUNS + """,
st AS (SELECT *, (t_ms - lag(t_ms) OVER (PARTITION BY device_id, run ORDER BY idx)) / 1000.0::DOUBLE AS step FROM runs),
fit AS (SELECT device_id, run, count(*) AS samples, 1 / median(step) AS hz FROM st GROUP BY ALL),
fr AS (SELECT *, CASE WHEN hz IS NULL OR samples < 100 OR samples < greatest(100, round_even(hz * 60, 0)) THEN 2 WHEN NOT hz BETWEEN 8.0 AND 10.5 THEN 1 ELSE 0 END AS k FROM fit),
dv AS (SELECT device_id, min(k) AS k FROM fr GROUP BY device_id)
SELECT 'run' AS level, device_id, run, samples, round(hz, 6) + 0.0 AS hz, CASE k WHEN 2 THEN 'short' WHEN 1 THEN 'rate' END AS reason FROM fr
UNION ALL SELECT 'device', device_id, NULL, NULL, NULL, CASE k WHEN 2 THEN 'short' WHEN 1 THEN 'rate' END FROM dv"""))
def vibration_admission(spark, sf_dir):
    """Why runs and devices have no window: with the missing samples left out most runs are short."""
    t = telemetry(spark, sf_dir)
    runs = vibration.vibration_runs(t)
    each = vibration.admit_runs(runs).select(F.lit("run").alias("level"), "device_id", "run", "samples", "hz", "reason")
    return rounded(each.unionByName(vibration.device_admission(t, runs).withColumn("level", F.lit("device")), allowMissingColumns=True))


_TEN = "s10 AS (SELECT device_id, CAST(floor(t_ms / 10000) AS BIGINT) * 10000 AS t_ms, avg(speed) AS speed, arg_max(heading, t_ms) AS heading FROM v GROUP BY ALL)"


def _ten(spark, sf_dir):
    v = view(spark, sf_dir)
    return v.groupBy("device_id", (F.floor(F.col("t_ms") / 10_000) * 10_000).alias("t_ms")).agg(F.avg("speed").alias("speed"), F.max_by("heading", "t_ms").alias("heading"))


@query(sql(f",\n{_TEN}\nSELECT device_id, t_ms, CASE WHEN t_ms - lag(t_ms) OVER w <= 22000 THEN round((speed - lag(speed) OVER w) / ((t_ms - lag(t_ms) OVER w) / 1000.0::DOUBLE), 6) + 0.0 END AS rate FROM s10 WINDOW w AS (PARTITION BY device_id ORDER BY t_ms)"))
def speed_rate(spark, sf_dir):
    return rounded(series.speed_rate(_ten(spark, sf_dir), 10_000).select("device_id", "t_ms", "rate"))


@query(sql(f""",
{_TEN},
bk AS (SELECT *, t_ms - lag(t_ms) OVER w > 22000 OR abs(heading - lag(heading) OVER w) > 180 AS c FROM s10 WINDOW w AS (PARTITION BY device_id ORDER BY t_ms))
SELECT device_id, t_ms, heading, false AS is_break FROM s10 UNION ALL SELECT device_id, t_ms - 1, NULL, true FROM bk WHERE c"""))
def break_series(spark, sf_dir):
    return series.break_series(_ten(spark, sf_dir), 10_000).select("device_id", "t_ms", "heading", "is_break")


_NEIGHBOURS = """,
pr AS (SELECT device_id, t_ms + 37 AS t_ms, t_ms AS key FROM t), tv AS (SELECT device_id, t_ms, speed FROM v WHERE speed IS NOT NULL),
nb AS (SELECT pr.*, x1.t_ms AS b, x1.speed AS bv FROM pr ASOF LEFT JOIN tv x1 ON pr.device_id = x1.device_id AND pr.t_ms >= x1.t_ms),
nv AS (SELECT nb.*, x2.t_ms AS a, x2.speed AS av FROM nb ASOF LEFT JOIN tv x2 ON nb.device_id = x2.device_id AND nb.t_ms <= x2.t_ms)"""


def _probes(spark, sf_dir):
    """Every row's time a little later, and the rows with a speed."""
    t = telemetry(spark, sf_dir)
    return t.select("device_id", (F.col("t_ms") + 37).alias("t_ms"), F.col("t_ms").alias("key")), view(spark, sf_dir).where("speed IS NOT NULL")


@query(sql(_NEIGHBOURS + "\nSELECT device_id, t_ms, CASE WHEN b IS NOT NULL AND (a IS NULL OR t_ms - b <= a - t_ms) THEN b ELSE a END AS near_ms, CASE WHEN b IS NOT NULL AND (a IS NULL OR t_ms - b <= a - t_ms) THEN bv ELSE av END AS near_value, a AS next_ms FROM nv"))
def nearest_asof(spark, sf_dir):
    return series.nearest_asof(*_probes(spark, sf_dir), "speed").select("device_id", "t_ms", "near_ms", "near_value", "next_ms")


@query(sql(_NEIGHBOURS + """
SELECT device_id, t_ms, round(CASE WHEN a = b THEN bv WHEN a - b > 0 AND a - b <= 3000 THEN bv + (av - bv) * (t_ms - b) / (a - b) WHEN b IS NOT NULL AND (a IS NULL OR t_ms - b <= a - t_ms) THEN bv ELSE av END, 6) + 0.0 AS value,
  coalesce(a - b BETWEEN 0 AND 3000, false) AS interpolated FROM nv"""))
def interpolate_track(spark, sf_dir):
    return rounded(series.interpolate(*_probes(spark, sf_dir), "speed").select("device_id", "t_ms", "value", "interpolated"))


@query(sql(_SEGMENTS + """,
cv AS (SELECT *, max(end_ms) OVER (PARTITION BY device_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM seg)
SELECT device_id, max(CASE WHEN start_ms > coalesce(reach, (SELECT min(t_ms) FROM t)) + 1000 THEN 1 ELSE 0 END) = 0 AND max(end_ms) + 1000 >= (SELECT max(t_ms) FROM t) AS covered, count(*) AS intervals FROM cv GROUP BY device_id"""))
def coverage(spark, sf_dir):
    return series.coverage(motion.motion_segments(view(spark, sf_dir)), *span(spark, sf_dir))


_REASON_COUNTS = ", ".join(f"CAST(count(*) FILTER (reason = '{r}') AS BIGINT) AS reason_{r}" for r in audit.SPEED_REASONS)


@query(sql("""
SELECT device_id, strftime(make_timestamp((t_ms + 28800000) * 1000), '%Y-%m-%d') AS day, count(*) AS samples, min(t_ms) AS first_ms, max(t_ms) AS last_ms,
  round(max(CASE WHEN protocol = 'GPCHCX' THEN raw_speed END) * 3.6, 6) + 0.0 AS raw_max_kmh, round(max(speed) * 3.6, 6) + 0.0 AS accepted_max_kmh, arg_max(t_ms, speed * 1000000 - (t_ms - 1704067200000) / 1000000.0) FILTER (speed IS NOT NULL) AS accepted_max_ms,
  round(count(speed) / count(*) * 100, 6) + 0.0 AS accepted_pct, CAST(sum(CASE WHEN motion_state = 'moving' THEN 1 ELSE 0 END) AS BIGINT) AS moving, CAST(sum(CASE WHEN motion_state = 'stationary' THEN 1 ELSE 0 END) AS BIGINT) AS stationary, CAST(sum(CASE WHEN motion_state = 'unknown' THEN 1 ELSE 0 END) AS BIGINT) AS unknown, """ + _REASON_COUNTS + """
FROM v GROUP BY ALL"""))
def daily_audit(spark, sf_dir):
    return rounded(audit.daily_audit(view(spark, sf_dir)))


@query(sql("""
SELECT device_id, strftime(make_timestamp((t_ms + 28800000) * 1000), '%Y-%m-%d %H') AS hour, count(*) AS samples, round(avg(speed) * 3.6, 5) + 0.0 AS mean_kmh, round(max(speed) * 3.6, 5) + 0.0 AS max_kmh,
  round(min(lat), 5) + 0.0 AS lat_min, round(max(lat), 5) + 0.0 AS lat_max, round(min(lon), 5) + 0.0 AS lon_min, round(max(lon), 5) + 0.0 AS lon_max FROM v GROUP BY ALL"""))
def hourly_profile(spark, sf_dir):
    return rounded(audit.hourly_profile(view(spark, sf_dir)), 5)


_METRICS = ["speed", "heading", "ax", "lat_std"]
_LONG = " UNION ALL ".join(f"SELECT device_id, '{m}' AS metric, {m} AS value FROM t WHERE {m} IS NOT NULL" for m in _METRICS)


@query(sql(f",\nlg AS ({_LONG}),\nqs AS (SELECT device_id, metric, " + ", ".join(f"quantile_cont(value, {a}) AS q{round(a * 1000):04d}" for a in (0.01, 0.5, 0.9, 0.99, 0.999)) + " FROM lg GROUP BY ALL),\nmd AS (SELECT device_id, metric, median(abs(value - q0500)) AS mad FROM lg JOIN qs USING (device_id, metric) GROUP BY ALL)\nSELECT device_id, metric, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("q0010", "q0500", "q0900", "q0990", "q0999", "mad")) + " FROM qs JOIN md USING (device_id, metric)"))
def distribution(spark, sf_dir):
    return rounded(audit.distribution(telemetry(spark, sf_dir), _METRICS))


_FITTED = audit.FLOORS
_FLONG = " UNION ALL ".join(f"SELECT device_id, '{m}' AS field, {m} AS value, {f}::DOUBLE AS fl FROM t WHERE {m} IS NOT NULL" for m, f in _FITTED.items())


@query(sql(f",\nfl AS ({_FLONG}),\nfc AS (SELECT device_id, field, fl, median(value) AS centre FROM fl GROUP BY ALL),\nfm AS (SELECT device_id, field, fc.fl, centre, median(abs(value - centre)) AS mad FROM fl JOIN fc USING (device_id, field) GROUP BY ALL)\nSELECT device_id, field, round(centre, 6) + 0.0 AS centre, round(mad, 6) + 0.0 AS mad, round(greatest(fl, 6 * 1.4826 * mad), 6) + 0.0 AS \"limit\" FROM fm"))
def robust_fit(spark, sf_dir):
    return rounded(audit.robust_fit(telemetry(spark, sf_dir), _FITTED))


def _fit_sql() -> str:
    """Each field by quantile_cont; pitch and roll on the circle from their first value."""
    delta = lambda a, b: f"((({a} - {b} + 180) % 360 + 360) % 360 - 180)"
    one = "SELECT device_id, '{0}' AS field, CAST({0} AS DOUBLE) AS value, CAST({1} AS DOUBLE) AS base, CAST({2} AS DOUBLE) AS least FROM fv JOIN fn USING (device_id) WHERE valid_population >= 100 AND {0} IS NOT NULL"
    each = [one.format(c, "NULL", "NULL") for c in ("lat", "lon")] + [one.format(c, "NULL", f) for c, f in audit.FLOORS.items()] + [one.format(c, f"first_{c}", f) for c, f in audit.CIRCULAR.items()]
    out = "SELECT device_id, field, centre, mad, CASE WHEN least IS NOT NULL THEN greatest(least, 6 * 1.4826::DOUBLE * mad) END AS \"limit\" FROM fm"
    return sql(f""",
fv AS (SELECT * FROM t WHERE fix_mode BETWEEN 1 AND 9 AND nav_mode <> 0),
fn AS (SELECT device_id, count(*) AS valid_population, arg_min(pitch, row(t_ms, protocol)) AS first_pitch, arg_min(roll, row(t_ms, protocol)) AS first_roll FROM fv GROUP BY device_id),
fp AS (SELECT device_id, count(*) AS population FROM t GROUP BY device_id),
fl AS ({' UNION ALL '.join(each)}),
fc AS (SELECT device_id, field, base, least, quantile_cont(CASE WHEN base IS NULL THEN value ELSE {delta('value', 'base')} END, 0.5) AS c FROM fl GROUP BY ALL),
fe AS (SELECT device_id, field, CASE WHEN base IS NULL THEN c ELSE {delta('(base + c)', '0')} END AS centre FROM fc),
fm AS (SELECT fl.device_id, fl.field, least, centre, quantile_cont(abs(CASE WHEN base IS NULL THEN value - centre ELSE {delta('value', 'centre')} END), 0.5) AS mad FROM fl JOIN fe USING (device_id, field) GROUP BY ALL),
fa AS (SELECT device_id, max(centre) FILTER (field = 'lat') AS la, max(centre) FILTER (field = 'lon') AS lo FROM fm GROUP BY device_id),
fr AS (SELECT fv.device_id, {distance_sql('la', 'lo', 'lat', 'lon')} AS r FROM fv JOIN fa USING (device_id)),
fs AS (SELECT device_id, quantile_cont(r, 0.5) AS centre FROM fr GROUP BY device_id),
fw AS (SELECT fr.device_id, centre, quantile_cont(abs(r - centre), 0.5) AS mad FROM fr JOIN fs USING (device_id) GROUP BY ALL),
fo AS ({out}),
fz AS (SELECT * FROM fo UNION ALL SELECT device_id, 'radius', centre, mad, greatest(10.0, centre + 6 * 1.4826::DOUBLE * mad) FROM fw UNION ALL SELECT device_id, 'horizontal', NULL, NULL, max("limit") FROM fo WHERE field IN ('speed', 've', 'vn') GROUP BY device_id)
SELECT device_id, field, round(centre, 6) + 0.0 AS centre, round(mad, 6) + 0.0 AS mad, round("limit", 6) + 0.0 AS "limit", valid_population, population FROM fz JOIN fn USING (device_id) JOIN fp USING (device_id)""")


@query(_fit_sql())
def context_fit(spark, sf_dir):
    """All fields of the fit, over the valid rows."""
    return rounded(audit.context_fit(telemetry(spark, sf_dir)))


@query(sql(""",
mn AS (SELECT device_id, CAST(floor(t_ms / 60000) AS BIGINT) * 60 AS minute, count(*) AS n FROM t GROUP BY ALL),
ds AS (SELECT device_id, minute, CAST(sum(n) OVER (PARTITION BY device_id ORDER BY minute RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS BIGINT) AS rows FROM mn)
SELECT device_id, minute, rows FROM ds QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY rows DESC, minute DESC) = 1"""))
def densest_window(spark, sf_dir):
    return audit.densest_window(telemetry(spark, sf_dir))


@query(sql("\nSELECT device_id, round(max(speed) * 3.6, 6) + 0.0 AS scalar_kmh, round(max(sqrt(ve * ve + vn * vn)) * 3.6, 6) + 0.0 AS horizontal_kmh, round(max(abs(vu)) * 3.6, 6) + 0.0 AS vertical_kmh, CAST(count(*) FILTER (speed > 130 / 3.6::DOUBLE) AS BIGINT) AS scalar_over, CAST(count(*) FILTER (sqrt(ve * ve + vn * vn) > 130 / 3.6::DOUBLE) AS BIGINT) AS horizontal_over FROM t GROUP BY device_id"))
def velocity_audit(spark, sf_dir):
    return rounded(audit.velocity_audit(telemetry(spark, sf_dir)))


_FORCE = "abs(sqrt(ax * ax + ay * ay + az * az) - 1)"


@query(sql(f"""
SELECT device_id, CAST(floor(t_ms / 60000) AS BIGINT) * 60000 AS window_ms, count(*) AS samples, {", ".join(f"min({c}) AS {c}_min, max({c}) AS {c}_max" for c in audit.WINDOW_CHANNELS)},
  {", ".join(f"CAST(count(*) FILTER (motion_state = '{x}') AS BIGINT) AS {x}" for x in audit.STATES)}, {_REASON_COUNTS}, CAST(count(*) FILTER ({_FORCE} > 0.01::DOUBLE) AS BIGINT) AS deviating, min(t_ms) AS first_ms, max(t_ms) AS last_ms,
  arg_min(t_ms, struct_pack(a := -round({_FORCE}, 9), b := t_ms)) FILTER (ax IS NOT NULL) AS largest_ms, max(round({_FORCE}, 9)) AS largest_g
FROM v GROUP BY ALL"""))
def window_audit(spark, sf_dir):
    w = audit.window_audit(view(spark, sf_dir))
    return w.withColumns({"first_ms": F.col("first.t_ms"), "last_ms": F.col("last.t_ms")}).drop("first", "last")


@query(sql("\nSELECT device_id, nav_mode, fix_mode, count(*) AS n FROM t GROUP BY ALL"))
def status_histogram(spark, sf_dir):
    return audit.status_histogram(telemetry(spark, sf_dir))


@query(sql("\nSELECT device_id, count(*) AS rows, CAST(count(*) FILTER (speed < 5 AND reason = 'gpchcx_speed') AS BIGINT) AS mismatches FROM q GROUP BY device_id"))
def shadow_compare(spark, sf_dir):
    """Estimates against those of another version, which takes slow rows as unknown."""
    old = assessed(spark, sf_dir)
    slow = (F.col("speed") < 5) & (F.col("ground.reason") == "gpchcx_speed")
    other = F.struct(F.when(~slow, F.col("ground.value")).alias("value"), F.when(slow, "unknown").otherwise(F.col("ground.state")).alias("state"), F.col("ground.reason").alias("reason"), F.col("ground.raw_speed").alias("raw_speed"))
    return audit.shadow_compare(old, old.withColumn("ground", other))


_DIGESTED = ["device_id", "fix_mode", "nav_mode", "protocol", "t_ms", "warning"]


@query(sql(f"""
SELECT count(*) AS rows, CAST(sum(CAST(concat('0x', left(md5(concat_ws('|', {", ".join(f"CAST({c} AS VARCHAR)" for c in _DIGESTED)})), 15)) AS HUGEINT)) AS VARCHAR) AS digest FROM t"""))
def table_digest(spark, sf_dir):
    return audit.table_digest(telemetry(spark, sf_dir).select(_DIGESTED))


_RADIUS = """,
an AS (SELECT device_id, median(lat) AS y, median(lon) AS o FROM t {early} GROUP BY device_id),
rd AS (SELECT t.*, sqrt(pow((lat - y) * 111195.0::DOUBLE, 2) + pow((lon - o) * 111195.0::DOUBLE * cos(radians(y)), 2)) AS radius, sqrt(gx * gx + gy * gy + gz * gz) AS gyro, abs(sqrt(ax * ax + ay * ay + az * az) - 1) AS accel, greatest(lat_std, lon_std) AS spread FROM t JOIN an USING (device_id))"""
_PARTS = ["radius", "speed", "gyro", "accel", "spread"]


@query(sql(_RADIUS.format(early="WHERE t_ms <= 1704067200000 + 60000") + "\nSELECT device_id, " + ", ".join(f"round(quantile_cont({c}, {q}), 5) + 0.0 AS {c}_{n}" for c in _PARTS for q, n in ((0.5, "p50"), (0.99, "p99"))) + ", CAST(count(*) FILTER (radius > 15) AS BIGINT) AS beyond15, CAST(count(*) FILTER (radius > 30) AS BIGINT) AS beyond30, CAST(count(*) FILTER (spread > 5) AS BIGINT) AS uncertain FROM rd GROUP BY device_id"))
def stationary_audit(spark, sf_dir):
    return rounded(audit.stationary_audit(telemetry(spark, sf_dir), 60_000), 5)


@query(sql(_RADIUS.format(early="") + "\nSELECT device_id, " + ", ".join(f"CAST(count(*) FILTER (radius > {r}) AS BIGINT) AS beyond{r}" for r in (5, 15, 30, 100)) + " FROM rd GROUP BY device_id"))
def radius_counts(spark, sf_dir):
    return audit.radius_counts(telemetry(spark, sf_dir))


@query(sql(""",
tp AS (SELECT device_id, t_ms, lat, lon, speed, lat_std, lon_std FROM v WHERE valid_pos),
tl AS (SELECT *, lag(t_ms) OVER w AS pt, lag(lat) OVER w AS pa, lag(lon) OVER w AS po, lag(speed) OVER w AS ps FROM tp WINDOW w AS (PARTITION BY device_id ORDER BY t_ms)),
tb AS (
  SELECT *, pt IS NULL OR t_ms - pt > 3000 OR coalesce(t_ms - pt BETWEEN 1 AND 3000 AND """ + drift_sql(distance_sql("pa", "po", "lat", "lon"), "((t_ms - pt) / 1000.0::DOUBLE)", "speed", "ps") + """, false) AS brk FROM tl),
tr AS (SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY t_ms) AS run, CAST(floor(t_ms / 60000) AS BIGINT) * 60000 AS bucket_ms FROM tb)
SELECT device_id, t_ms, bucket_ms, brk AS break_before, round(lat, 6) + 0.0 AS lat FROM tr QUALIFY t_ms = min(t_ms) OVER (PARTITION BY device_id, bucket_ms, run) OR t_ms = max(t_ms) OVER (PARTITION BY device_id, bucket_ms, run)"""))
def track(spark, sf_dir):
    return rounded(motion.track(view(spark, sf_dir)).select("device_id", "t_ms", "bucket_ms", "break_before", "lat"))


@query(SQL["track"])
def rollup_track(spark, sf_dir):
    """The track from 600 s buckets that were merged from 60 s ones; the SQL computes it from rows."""
    points = paths.track_from(_paths_600(spark, sf_dir)).withColumn("bucket_ms", F.floor(F.col("t_ms") / 60_000) * 60_000)
    return rounded(points.select("device_id", "t_ms", "bucket_ms", "break_before", "lat"))


@query(sql(""",
th AS (SELECT device_id, t_ms, row_number() OVER (PARTITION BY device_id ORDER BY t_ms, protocol) - 1 AS r, count(*) OVER (PARTITION BY device_id) AS n FROM t),
pk AS (SELECT DISTINCT device_id, CAST(round_even(i * (n - 1) / 99.0::DOUBLE, 0) AS BIGINT) AS r FROM (SELECT DISTINCT device_id, n FROM th), (SELECT unnest(range(0, 100)) AS i))
SELECT th.device_id, t_ms FROM th JOIN pk ON th.device_id = pk.device_id AND th.r = pk.r"""))
def thin_track(spark, sf_dir):
    return motion.thin_track(telemetry(spark, sf_dir), 100).select("device_id", "t_ms")
