"""Queries over joins of derived tables, and over their upkeep: contexts, assessments, rollups, rules and retention."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.constants import BITS, KINDS
from ..operators import audit, episodes, lifecycle, motion, quality, rollup, series, trace
from ..sources.telemetry import table, telemetry
from .rollups import _TEN, _rolled, _ten
from .shared import assessed, rounded, span, sql, view
from .telemetry import _EPISODES, _STOPS

QUERIES, SQL = {}, {}


def query(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return put


KEY = ["device_id", "t_ms", "protocol"]

# Assessments: a row in seven has none, one in eleven is of an older version.
_STALE = "(t_ms // 100) % 7 = 0 OR (t_ms // 100) % 11 = 0"


def _stored(spark, sf_dir):
    """An assessment table as an earlier version and a fault would leave it."""
    tick = F.floor(F.col("t_ms") / 100)
    old = F.when(tick % 11 == 0, quality.VERSION - 1).otherwise(quality.VERSION)
    return assessed(spark, sf_dir).where(tick % 7 != 0).select(*KEY, "mask", "reasons", "ground", old.alias("version"))


@query(sql(f"""
SELECT device_id, count(*) AS n, CAST(count(*) FILTER ({_STALE}) AS BIGINT) AS pending, count(CASE WHEN NOT ({_STALE}) THEN speed END) AS speeds, count(CASE WHEN NOT ({_STALE}) THEN heading END) AS headings,
  CAST(count(*) FILTER ({_STALE} OR motion_state = 'unknown') AS BIGINT) AS unknown FROM v GROUP BY device_id"""))
def pending_rows(spark, sf_dir):
    """Points joined with the assessments of the present version; those without one show nothing."""
    points = quality.complete(telemetry(spark, sf_dir))
    v = quality.project(quality.joined_points(points, _stored(spark, sf_dir)))
    return v.groupBy("device_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("mask").isNull()).alias("pending"), F.count("speed").alias("speeds"), F.count("heading").alias("headings"), F.count_if(F.col("motion_state") == "unknown").alias("unknown"))


@query(sql("\nSELECT device_id, CAST(mask AS BIGINT) AS mask, CAST(reasons AS BIGINT) AS reasons, CAST(10 AS INTEGER) AS version, count(*) AS n, round(sum(ground), 4) + 0.0 AS total FROM q GROUP BY device_id, mask, reasons"))
def backfill(spark, sf_dir):
    """The missing and older assessments made again; the SQL assesses all rows."""
    t = quality.complete(telemetry(spark, sf_dir))
    full = lifecycle.backfill(t, _stored(spark, sf_dir), quality.VERSION, quality.assess)
    return rounded(full.groupBy("device_id", "mask", "reasons", "version").agg(F.count(F.lit(1)).alias("n"), F.sum("ground.value").alias("total")), 4)


@query(sql("\nSELECT device_id, t_ms, protocol, speed AS raw_speed, ground AS speed, lat AS raw_lat, CASE WHEN NOT (outlier OR drift) THEN lat END AS lat, CAST(mask AS BIGINT) AS mask FROM q WHERE device_id = 'D1' AND t_ms = (SELECT max(t_ms) FROM t WHERE device_id = 'D1')"))
def point_lookup(spark, sf_dir):
    """One device's last point in both views (a lookup is the feature)."""
    at = telemetry(spark, sf_dir).where("device_id = 'D1'").agg(F.max("t_ms")).first()[0]
    raw = quality.point_at(assessed(spark, sf_dir), "D1", at)
    shown = quality.point_at(view(spark, sf_dir), "D1", at).select(*KEY, "speed", "lat")
    return raw.select(*KEY, F.col("speed").alias("raw_speed"), F.col("lat").alias("raw_lat"), "mask").join(shown, KEY)


@query(sql("""
SELECT device_id, round(((SELECT max(t_ms) FROM t) + 20000 - max(t_ms)) / 1000.0::DOUBLE, 3) + 0.0 AS lag_s,
  (SELECT max(t_ms) FROM t) + 20000 - (max(t_ms) - 15000 * CAST(substr(device_id, 2) AS BIGINT)) < 30000 AND (SELECT max(t_ms) FROM t) + 20000 - max(t_ms) < 60000 AS online FROM t GROUP BY device_id"""))
def device_status(spark, sf_dir):
    """Twenty seconds after the last row; devices were heard the earlier the greater their number."""
    dim = lifecycle.device_dim(telemetry(spark, sf_dir))
    heard = dim.withColumn("received_ms", F.col("last_ms") - 15_000 * F.substring("device_id", 2, 9).cast("bigint"))
    return rounded(quality.device_status(heard, span(spark, sf_dir)[1] + 20_000).select("device_id", "lag_s", "online"), 3)


@query(sql("\nSELECT device_id, count(*) AS points, CASE WHEN device_id IN ('D0', 'D1') THEN 90.0::DOUBLE ELSE 85.0 END AS speed_kmh FROM t GROUP BY device_id"))
def device_rules(spark, sf_dir):
    """Two devices have rules of their own, new ones get the default."""
    from ..functions.constants import RULES

    t = telemetry(spark, sf_dir)
    own = F.struct(*[F.lit(90.0 if k == "speed_kmh" else float(v)).alias(k) for k, v in RULES.items()])
    known = t.where("device_id IN ('D0', 'D1')").select("device_id").distinct().withColumn("rules", own)
    return lifecycle.device_dim(t, known).select("device_id", "points", "rules.speed_kmh")


# Contexts of each device: two that overlap, and one without an end from the middle of its time.
_CONTEXTS = """,
fl AS (SELECT device_id, min(t_ms) AS a, max(t_ms) AS b FROM t GROUP BY device_id),
ctx AS (
  SELECT device_id, concat(device_id, '-1') AS context_id, a + 1000 AS start_ms, a + 9000 AS end_ms FROM fl UNION ALL SELECT device_id, concat(device_id, '-2'), a + 5000, a + 14000 FROM fl
  UNION ALL SELECT device_id, concat(device_id, '-3'), a + (b - a) // 2, NULL FROM fl)"""


def _contexts(spark, sf_dir):
    dim = telemetry(spark, sf_dir).groupBy("device_id").agg(F.min("t_ms").alias("a"), F.max("t_ms").alias("b"))
    one = lambda n, start, end: F.struct(F.concat("device_id", F.lit(f"-{n}")).alias("context_id"), start.alias("start_ms"), end.alias("end_ms"))
    a, none = F.col("a"), F.lit(None).cast("bigint")
    return dim.select("device_id", F.inline(F.array(one(1, a + 1000, a + 9000), one(2, a + 5000, a + 14_000), one(3, a + F.floor((F.col("b") - a) / 2), none))))


_IN_CONTEXT = _CONTEXTS + """,
cx AS (SELECT t.device_id, t.t_ms, t.protocol, arg_min(context_id, start_ms) AS context_id FROM t LEFT JOIN ctx ON ctx.device_id = t.device_id AND t.t_ms >= start_ms AND (end_ms IS NULL OR t.t_ms <= end_ms) GROUP BY t.device_id, t.t_ms, t.protocol)"""


@query(sql(_IN_CONTEXT + "\nSELECT device_id, context_id, count(*) AS n FROM cx GROUP BY ALL"))
def context_rows(spark, sf_dir):
    return quality.with_context(telemetry(spark, sf_dir), _contexts(spark, sf_dir)).groupBy("device_id", "context_id").agg(F.count(F.lit(1)).alias("n"))


_BITS_OF = "CASE ev.kind " + " ".join(f"WHEN '{k}' THEN {sum(BITS[f] for f in fields)}" for k, (_, fields) in KINDS.items()) + " END"


@query(sql(_EPISODES + _IN_CONTEXT + f"""
SELECT ev.device_id, ev.kind, count(*) AS n FROM ev JOIN q ON q.device_id = ev.device_id AND q.t_ms = ev.peak_ms JOIN cx ON cx.device_id = q.device_id AND cx.t_ms = q.t_ms AND cx.protocol = q.protocol
WHERE (q.mask & {_BITS_OF}) = 0 AND context_id IS NULL AND NOT ({_STALE.replace('t_ms', 'q.t_ms')}) GROUP BY ALL"""))
def gated_in_context(spark, sf_dir):
    """Events whose peak has an assessment of the present version and lies in no context."""
    found = episodes.episodes(episodes.signal_rows(view(spark, sf_dir)))
    stored = quality.with_context(_stored(spark, sf_dir), _contexts(spark, sf_dir))
    return episodes.gate_events(found, stored, quality.VERSION).groupBy("device_id", "kind").agg(F.count(F.lit(1)).alias("n"))


# Intervals of customers: of the contexts that are there (one for each customer and quarter, whose last is open for one customer in five) and of new ones,
# which overlap those and each other; some are open, some end before they start, some have a known id.
_INTERVALS = """
o AS (SELECT o_custkey AS device_id, o_orderkey AS id, CAST(epoch_ms(o_orderdate) AS BIGINT) AS ts FROM orders),
l AS (SELECT device_id, id, ts, row_number() OVER (PARTITION BY device_id ORDER BY ts, id) AS k, row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, id DESC) AS r, lead(ts) OVER (PARTITION BY device_id ORDER BY ts, id) AS next_ts FROM o),
old AS (SELECT id AS context_id, device_id, ts AS start_ms, CASE WHEN r = 1 AND device_id % 5 = 0 THEN NULL ELSE ts + least(864000000, greatest(coalesce(next_ts, ts + 864000000) - ts - 1, 1)) END AS end_ms FROM l WHERE k % 3 = 1 AND (r = 1 OR next_ts > ts + 1)),
new AS (SELECT CASE WHEN id % 11 = 0 THEN id ELSE -id END AS context_id, device_id, ts + 1000 AS start_ms, CASE WHEN id % 7 = 0 THEN NULL WHEN id % 13 = 0 THEN ts ELSE ts + 1000 + 86400000 * (id % 40) END AS end_ms FROM l)"""


def _intervals(spark, sf_dir):
    """The contexts that are there and the new ones."""
    at = (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000).cast("bigint")
    w = Window.partitionBy("device_id")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("device_id"), F.col("o_orderkey").alias("id"), at.alias("at"))
    rows = rows.withColumns({"k": F.row_number().over(w.orderBy("at", "id")), "r": F.row_number().over(w.orderBy(F.desc("at"), F.desc("id"))), "next_at": F.lead("at").over(w.orderBy("at", "id"))})
    ten = F.lit(864_000_000)
    end = F.when((F.col("r") == 1) & (F.col("device_id") % 5 == 0), None).otherwise(F.col("at") + F.least(ten, F.greatest(F.coalesce("next_at", F.col("at") + ten) - F.col("at") - 1, F.lit(1))))
    old = rows.where("k % 3 = 1 AND (r = 1 OR next_at > at + 1)").select(F.col("id").alias("context_id"), "device_id", F.col("at").alias("start_ms"), end.cast("bigint").alias("end_ms"))
    ends = F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 13 == 0, F.col("at")).otherwise(F.col("at") + 1000 + F.col("id") % 40 * 86_400_000)
    new = rows.select(F.when(F.col("id") % 11 == 0, F.col("id")).otherwise(-F.col("id")).alias("context_id"), "device_id", (F.col("at") + 1000).alias("start_ms"), ends.cast("bigint").alias("end_ms"))
    return old, new


_INSTALLED = f"""
WITH RECURSIVE {_INTERVALS.strip()},
e AS (SELECT *, coalesce(end_ms, 9000000000000000) AS e FROM new),
m AS (SELECT n.*, CASE WHEN n.start_ms >= n.e THEN 'invalid' WHEN o.context_id IS NOT NULL THEN 'frozen' WHEN EXISTS (SELECT 1 FROM old p WHERE p.device_id = n.device_id AND p.start_ms <= n.e AND coalesce(p.end_ms, 9000000000000000) >= n.start_ms) THEN 'overlap' END AS refused FROM e n LEFT JOIN old o USING (context_id)),
f AS (SELECT device_id, context_id, start_ms, e, row_number() OVER (PARTITION BY device_id ORDER BY start_ms, context_id) AS place FROM m WHERE refused IS NULL),
-- One after another: what was the end of the last admitted one when an interval came, and whether it was admitted.
s AS (SELECT device_id, place, context_id, e AS upto, true AS ok FROM f WHERE place = 1
      UNION ALL SELECT f.device_id, f.place, f.context_id, CASE WHEN f.start_ms > s.upto THEN f.e ELSE s.upto END, f.start_ms > s.upto FROM s JOIN f ON f.device_id = s.device_id AND f.place = s.place + 1)"""


@query(_INSTALLED + """
SELECT context_id, 'old' AS outcome FROM old UNION ALL SELECT context_id, CASE WHEN ok THEN 'installed' ELSE 'overlap' END FROM s UNION ALL SELECT context_id, refused FROM m WHERE refused IS NOT NULL""")
def context_install(spark, sf_dir):
    """New contexts against those that are there and against each other, with open ends."""
    old, new = _intervals(spark, sf_dir)
    there, installed, refused = lifecycle.install_contexts(old, new)
    first = there.join(installed.select("context_id"), "context_id", "left_anti").select("context_id", F.lit("old").alias("outcome"))
    return first.unionByName(installed.select("context_id", F.lit("installed").alias("outcome"))).unionByName(refused.select("context_id", F.col("refused").alias("outcome")))


@query(_INSTALLED + """
, p AS (SELECT o_custkey AS device_id, o_orderkey AS point, CAST(epoch_ms(o_orderdate) AS BIGINT) + 43200000 AS t_ms FROM orders),
i AS (SELECT f.* FROM f JOIN s USING (device_id, place) WHERE ok)
SELECT device_id, count(*) AS n, max(point) AS last FROM p WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.device_id = p.device_id AND p.t_ms BETWEEN i.start_ms AND i.e) GROUP BY device_id""")
def context_reassess(spark, sf_dir):
    """The assessments that stay when contexts are installed: those outside of the new spans."""
    _, installed, _ = lifecycle.install_contexts(*_intervals(spark, sf_dir))
    at = (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000).cast("bigint") + 43_200_000
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("device_id"), F.col("o_orderkey").alias("point"), at.alias("t_ms"))
    return lifecycle.without_spans(rows, installed).groupBy("device_id").agg(F.count(F.lit(1)).alias("n"), F.max("point").alias("last"))


@query(sql(_CONTEXTS + """
SELECT q.device_id, count(*) AS n, max(t_ms) AS last_ms, CAST(count(*) FILTER (t_ms > a + (b - a) // 2 + 6000) AS BIGINT) AS later, CASE WHEN q.device_id = 'D1' THEN max(a + (b - a) // 2 + 6000) END AS closed_ms, (SELECT count(*) - 1 FROM ctx) AS refused
FROM q JOIN fl USING (device_id) WHERE device_id <> 'D1' OR t_ms <= a + (b - a) // 2 + 6000 GROUP BY q.device_id"""))
def context_close(spark, sf_dir):
    """An open context is closed, and that device's later assessments are dropped; changes of closed ones, without a note, of the future or repeated are refused."""
    contexts = _contexts(spark, sf_dir)
    ids = contexts.select("context_id", "start_ms", "end_ms")
    last = 4_000_000_000_000
    late = F.when(F.col("context_id") == "D2-3", last + 1).otherwise(F.col("start_ms") + 6000)
    note = F.when(F.col("context_id") != "D3-3", "seen to move")
    again = ids.where("context_id = 'D1-3'").select("context_id", (F.col("start_ms") + 7000).alias("end_ms"), F.lit("again").alias("note"))
    changes = ids.where("context_id <> 'D0-3'").select("context_id", late.cast("bigint").alias("end_ms"), note.alias("note")).unionByName(again)
    cut, left, audit, refused = lifecycle.close_contexts(contexts, assessed(spark, sf_dir).select(*KEY, "mask"), changes, last)
    closed = cut.join(audit.select("context_id", F.col("end_ms").alias("_at")), "context_id").where("end_ms = _at").select("device_id", F.col("end_ms").alias("closed_ms"))
    counted = left.join(contexts.where("context_id LIKE '%-3'").select("device_id", "start_ms"), "device_id").groupBy("device_id").agg(F.count(F.lit(1)).alias("n"), F.max("t_ms").alias("last_ms"), F.count_if(F.col("t_ms") > F.col("start_ms") + 6000).alias("later"))
    return counted.join(closed, "device_id", "left").withColumn("refused", refused.agg(F.count(F.lit(1))).scalar())


@query(sql("""
, w AS (SELECT concat('w', CAST(k AS VARCHAR)) AS name, a + k * (b - a) // 5 AS start_ms, a + (k + 2) * (b - a) // 5 AS end_ms FROM (SELECT min(t_ms) AS a, max(t_ms) AS b FROM t), (SELECT unnest(range(0, 4)) AS k))
SELECT device_id, name, count(*) AS n, round(avg(speed), 6) + 0.0 AS speed FROM t JOIN w ON t_ms BETWEEN start_ms AND end_ms GROUP BY ALL"""))
def tagged_windows(spark, sf_dir):
    """Four labelled windows, each over two fifths of the time."""
    t = telemetry(spark, sf_dir)
    ends = t.agg(F.min("t_ms").alias("a"), F.max("t_ms").alias("b"))
    at = lambda k: F.expr(f"a + {k} * (b - a) div 5")
    windows = ends.select(F.inline(F.array(*[F.struct(F.lit(f"w{k}").alias("name"), at(k).alias("start_ms"), at(k + 2).alias("end_ms")) for k in range(4)])))
    return rounded(audit.tag_windows(t, windows).groupBy("device_id", "name").agg(F.count(F.lit(1)).alias("n"), F.avg("speed").alias("speed")))


_ANCHORS = _STOPS + """,
mv AS (SELECT device_id, t_ms, lat, lon FROM v WHERE valid_pos AND motion_state = 'moving'),
an AS (SELECT device_id, stop, min(lat) AS y, min(lon) AS o FROM (SELECT s.device_id, s.stop, v.lat, v.lon FROM stops s JOIN v ON v.device_id = s.device_id AND v.t_ms BETWEEN s.start_ms AND s.end_ms AND v.valid_pos AND v.motion_state = 'stationary') GROUP BY ALL)"""


@query(sql(_ANCHORS + """
, pl AS (SELECT v.device_id, v.t_ms, y, o FROM v JOIN stops s ON v.device_id = s.device_id AND v.t_ms BETWEEN s.start_ms AND s.end_ms AND v.motion_state = 'stationary' JOIN an ON an.device_id = s.device_id AND an.stop = s.stop)
SELECT v.device_id, CASE WHEN pl.t_ms IS NULL THEN 'measured' ELSE 'anchor' END AS source, count(*) AS n, round(sum(coalesce(y, lat)), 4) + 0.0 AS lat, round(sum(coalesce(o, lon)), 4) + 0.0 AS lon
FROM v LEFT JOIN pl ON v.device_id = pl.device_id AND v.t_ms = pl.t_ms GROUP BY ALL"""))
def anchored_track(spark, sf_dir):
    """Points in stops take one position, here the least of each stop."""
    v = view(spark, sf_dir)
    stops = motion.stop_groups(motion.motion_segments(v))
    inside = motion._in_stop(v.where("valid_pos AND motion_state = 'stationary'"), stops)
    anchors = inside.groupBy("device_id", "stop").agg(F.min("lat").alias("anchor_lat"), F.min("lon").alias("anchor_lon"))
    return rounded(motion.anchor_track(v, stops, anchors).groupBy("device_id", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("lat").alias("lat"), F.sum("lon").alias("lon")), 4)


@query(sql("""
, bc AS (
  SELECT device_id, t_ms, CAST(floor(t_ms / 60000) AS BIGINT) * 60000 AS bucket_ms,
    CASE nav_mode WHEN 2 THEN 300 WHEN 1 THEN 200 ELSE 0 END + CASE WHEN fix_mode IN (4, 8) THEN 40 WHEN fix_mode IN (5, 9) THEN 30 WHEN fix_mode IN (2, 3) THEN 20 WHEN fix_mode = 1 THEN 10 ELSE 0 END - least(greatest(lat_std, lon_std), 100.0) / 100 AS confidence
  FROM v WHERE valid_pos),
br AS (SELECT *, row_number() OVER (PARTITION BY device_id, bucket_ms ORDER BY confidence DESC, t_ms) AS rank, row_number() OVER (PARTITION BY device_id, bucket_ms ORDER BY t_ms) - 1 AS place, count(*) OVER (PARTITION BY device_id, bucket_ms) AS n FROM bc)
SELECT device_id, bucket_ms, t_ms, round(confidence, 6) + 0.0 AS confidence FROM br
WHERE n <= 32 OR rank <= 16 OR place IN (SELECT CAST(round_even(i * (n - 1) / 15.0::DOUBLE, 0) AS BIGINT) FROM (SELECT unnest(range(0, 16)) AS i))"""))
def position_candidates(spark, sf_dir):
    """The bounded candidates of each minute."""
    from ..functions.scalars import bucket_start, position_confidence

    rows = view(spark, sf_dir).where("valid_pos").select("device_id", "t_ms", bucket_start("t_ms", 60).alias("bucket_ms"), position_confidence().alias("confidence"))
    return rounded(motion.bounded_candidates(rows, ["device_id", "bucket_ms"]).select("device_id", "bucket_ms", "t_ms", "confidence"))


@query(sql(_EPISODES + f",\n{_TEN}\nSELECT device_id, kind, start_ms, peak_ms, (SELECT min(s10.t_ms) FROM s10 WHERE s10.device_id = ev.device_id AND s10.t_ms >= ev.peak_ms) AS bin_ms FROM ev"))
def events_on_series(spark, sf_dir):
    """The first bin of a 10 s series at or after each event's peak."""
    found = episodes.episodes(episodes.signal_rows(view(spark, sf_dir)))
    return series.events_on_series(found, _ten(spark, sf_dir)).select("device_id", "kind", "start_ms", "peak_ms", "bin_ms")


@query(sql(f",\n{_TEN},\ngp AS (SELECT device_id, p_t AS start_ms, t_ms AS end_ms FROM l WHERE t_ms - p_t > 3000),\nbk AS (SELECT *, lag(t_ms) OVER w AS b, t_ms - lag(t_ms) OVER w > 22000 OR abs(heading - lag(heading) OVER w) > 180 AS c FROM s10 WINDOW w AS (PARTITION BY device_id ORDER BY t_ms))\nSELECT device_id, t_ms, heading, false AS is_break FROM s10 UNION ALL SELECT device_id, t_ms - 1, NULL, true FROM bk WHERE coalesce(c, false) OR EXISTS (SELECT 1 FROM gp WHERE gp.device_id = bk.device_id AND gp.start_ms >= bk.b AND gp.end_ms <= bk.t_ms)"))
def gapped_series(spark, sf_dir):
    """A series broken at the listed gaps of the points too."""
    return series.break_series(_ten(spark, sf_dir), 10_000, gaps=motion.gaps(telemetry(spark, sf_dir))).select("device_id", "t_ms", "heading", "is_break")


@query(sql(_EPISODES + "\nSELECT 1000 + row_number() OVER (ORDER BY start_ms, device_id, kind) AS event_id, device_id, kind, start_ms, end_ms, samples, CAST(2 AS INTEGER) AS rule_version FROM ev"))
def rebuilt_episodes(spark, sf_dir):
    """All episodes anew, with ids above the highest so far."""
    out = episodes.rebuild_episodes(view(spark, sf_dir), 1000, rule_version=2)
    return out.select(F.col("event_id").cast("bigint").alias("event_id"), "device_id", "kind", "start_ms", "end_ms", "samples", "rule_version")


# Of each device two changes: the first of a quarter changes nothing, that of another is out of bounds; a second, of every third device, changes one rule or both.
_CHANGES = """
c AS (SELECT s_suppkey AS device_id, 1 AS seq, CASE s_suppkey % 4 WHEN 0 THEN 85.0::DOUBLE WHEN 1 THEN 95.0 WHEN 2 THEN 999.0 END AS speed_kmh, NULL::DOUBLE AS pitch_deg FROM supplier WHERE s_suppkey % 4 < 3
  UNION ALL SELECT s_suppkey, 2, CASE WHEN s_suppkey % 2 = 0 THEN 95.0::DOUBLE END, 20.0 FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT -1, 1, 90.0, NULL),
g AS (SELECT * FROM c WHERE device_id >= 0 AND coalesce(speed_kmh, 85) BETWEEN 10 AND 200),
one AS (SELECT s_suppkey AS device_id, coalesce(a.speed_kmh, 85.0) AS s1, coalesce(b.speed_kmh, a.speed_kmh, 85.0) AS s2, CASE WHEN b.device_id IS NULL THEN 15.0 ELSE 20.0 END AS p2, b.device_id IS NOT NULL AS twice FROM supplier LEFT JOIN g a ON a.device_id = s_suppkey AND a.seq = 1 LEFT JOIN g b ON b.device_id = s_suppkey AND b.seq = 2)"""


def _changed(spark, sf_dir):
    d = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("device_id"), F.lit(85.0).alias("speed_kmh"), F.lit(15.0).alias("pitch_deg"), F.lit(1).alias("version"))
    k, none = F.col("device_id") % 4, F.lit(None).cast("double")
    first = d.where(k < 3).select("device_id", F.lit(1).alias("seq"), F.when(k == 0, 85.0).when(k == 1, 95.0).otherwise(999.0).alias("speed_kmh"), none.alias("pitch_deg"))
    second = d.where("device_id % 3 = 0").select("device_id", F.lit(2).alias("seq"), F.when(F.col("device_id") % 2 == 0, 95.0).alias("speed_kmh"), F.lit(20.0).alias("pitch_deg"))
    nobody = d.limit(1).select(F.lit(-1).cast(d.schema["device_id"].dataType).alias("device_id"), F.lit(1).alias("seq"), F.lit(90.0).alias("speed_kmh"), none.alias("pitch_deg"))
    return lifecycle.update_devices(d, first.unionByName(second).unionByName(nobody), {"speed_kmh": (10.0, 200.0), "pitch_deg": (1.0, 90.0)})


@query(f"WITH {_CHANGES.strip()} SELECT device_id, s2 AS speed_kmh, CAST(p2 AS DOUBLE) AS pitch_deg, CAST(1 + CASE WHEN s1 <> 85 THEN 1 ELSE 0 END + CASE WHEN twice THEN 1 ELSE 0 END AS INTEGER) AS version FROM one")
def device_update(spark, sf_dir):
    """Devices after up to two changes each."""
    return _changed(spark, sf_dir)[0].select("device_id", "speed_kmh", "pitch_deg", "version")


@query(f"""WITH {_CHANGES.strip()} SELECT device_id, CAST(1 AS INTEGER) AS seq, CAST(2 AS INTEGER) AS version, s1 AS speed_kmh, CAST(15 AS DOUBLE) AS pitch_deg, 'changed' AS outcome FROM one WHERE s1 <> 85
UNION ALL SELECT device_id, 2, CAST(2 + CASE WHEN s1 <> 85 THEN 1 ELSE 0 END AS INTEGER), s2, 20, 'changed' FROM one WHERE twice
UNION ALL SELECT device_id, seq, NULL, speed_kmh, pitch_deg, CASE WHEN speed_kmh = 999 THEN 'bounds' ELSE 'unknown_device' END FROM c WHERE speed_kmh = 999 OR device_id < 0""")
def device_audit(spark, sf_dir):
    """The audit rows of those changes and the changes refused."""
    _, log, refused = _changed(spark, sf_dir)
    no = refused.select("device_id", "seq", F.lit(None).cast("int").alias("version"), "speed_kmh", "pitch_deg", F.col("refused").alias("outcome"))
    return log.select("device_id", "seq", "version", "speed_kmh", "pitch_deg", F.lit("changed").alias("outcome")).unionByName(no)


# Every fourth event is acknowledged and then, of every fifth, resolved; every fourth is resolved, which needs a note.
_REVIEWS = """
r AS (SELECT o_orderkey AS event_id, 1 AS seq, CASE WHEN o_orderkey % 4 = 0 THEN 'acknowledged' ELSE 'resolved' END AS new_status, CASE WHEN o_orderkey % 3 = 0 THEN ' seen ' END AS new_note FROM orders WHERE o_orderkey % 4 < 2
  UNION ALL SELECT o_orderkey, 2, 'resolved', 'done' FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 3, 'closed', 'x' FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT -1, 1, 'open', NULL),
k AS (SELECT *, CASE WHEN new_status = 'closed' THEN 'status' WHEN new_status = 'resolved' AND new_note IS NULL THEN 'note' WHEN event_id < 0 THEN 'unknown_event' END AS refused FROM r)"""


def _reviewed(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.lit("open").alias("status"), F.lit(None).cast("string").alias("note"))
    one = lambda rows, seq, status, note: rows.select("event_id", F.lit(seq).alias("seq"), status.alias("new_status"), note.cast("string").alias("new_note"))
    e = F.col("event_id")
    changes = one(o.where(e % 4 < 2), 1, F.when(e % 4 == 0, "acknowledged").otherwise("resolved"), F.when(e % 3 == 0, " seen "))
    changes = changes.unionByName(one(o.where(e % 5 == 0), 2, F.lit("resolved"), F.lit("done"))).unionByName(one(o.where(e % 10 == 0), 3, F.lit("closed"), F.lit("x")))
    nothing = o.limit(1).withColumn("event_id", F.lit(-1).cast(o.schema["event_id"].dataType))
    return lifecycle.review_events(o, changes.unionByName(one(nothing, 1, F.lit("open"), F.lit(None))))


@query(f"WITH {_REVIEWS.strip()} SELECT o_orderkey AS event_id, coalesce(arg_max(new_status, seq), 'open') AS status, arg_max(trim(coalesce(new_note, '')), seq) AS note FROM orders LEFT JOIN k ON event_id = o_orderkey AND refused IS NULL GROUP BY o_orderkey")
def event_review(spark, sf_dir):
    """Events after up to three changes each: one row an event."""
    return _reviewed(spark, sf_dir)[0].select("event_id", "status", "note")


@query(f"""WITH {_REVIEWS.strip()} SELECT event_id, seq, coalesce(lag(new_status) OVER (PARTITION BY event_id ORDER BY seq), 'open') AS old_status, new_status, 'audit' AS table_ FROM k WHERE refused IS NULL
UNION ALL SELECT event_id, seq, refused, new_status, 'refused' FROM k WHERE refused IS NOT NULL""")
def review_audit(spark, sf_dir):
    """The audit rows of a review and the changes that it refuses, with the reason."""
    _, log, refused = _reviewed(spark, sf_dir)
    return log.select("event_id", "seq", "old_status", "new_status", F.lit("audit").alias("table_")).unionByName(refused.select("event_id", "seq", F.col("refused").alias("old_status"), "new_status", F.lit("refused").alias("table_")))


@query("SELECT s_suppkey AS device_id, 'rules_migrated' AS action, CAST(2 AS INTEGER) AS version FROM supplier WHERE s_suppkey % 3 = 0")
def migration_audit(spark, sf_dir):
    from ..functions.constants import LEGACY_RULES

    d = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("device_id"), F.lit(1).alias("version"))
    own = {k: F.lit(v) for k, v in LEGACY_RULES.items()} | {"speed_kmh": F.when(F.col("device_id") % 3 != 0, 90.0).otherwise(80.0)}
    return lifecycle.migrate_rules(d.withColumns(own))[1]


# Files of a minute of a device; those of the first third of the time go.
_FILES = """,
fi AS (SELECT *, concat(device_id, '/', CAST(CAST(floor(t_ms / 60000) AS BIGINT) AS VARCHAR)) AS source, CAST(floor(t_ms / 60000) AS BIGINT) * 60000 < (SELECT min(t_ms) + (max(t_ms) - min(t_ms)) // 3 FROM t) AS gone FROM x)"""


@query(sql(_EPISODES + _FILES + f"""
, cut AS (SELECT * FROM x WHERE (device_id, t_ms, protocol) IN (SELECT (device_id, t_ms, protocol) FROM fi WHERE NOT gone)),
rl AS ({_rolled(60, 'cut')}),
pt AS (SELECT device_id, count(*) AS points, max(t_ms) AS last_ms FROM fi WHERE NOT gone GROUP BY device_id),
ee AS (SELECT device_id, count(*) AS events FROM ev WHERE end_ms >= (SELECT min(t_ms) + (max(t_ms) - min(t_ms)) // 3 FROM t) GROUP BY device_id),
bk AS (SELECT device_id, count(*) AS buckets, CAST(sum(points) AS BIGINT) AS bucket_points FROM rl GROUP BY device_id)
SELECT pt.device_id, points, points AS assessments, last_ms, coalesce(events, 0) AS events, buckets, bucket_points FROM pt LEFT JOIN ee USING (device_id) JOIN bk USING (device_id)"""))
def retention(spark, sf_dir):
    """Tables after the files of the first third were retired."""
    lo, hi = span(spark, sf_dir)
    mark = lo + (hi - lo) // 3
    a = assessed(spark, sf_dir).withColumn("source", F.concat_ws("/", "device_id", F.floor(F.col("t_ms") / 60_000).cast("string")))
    files = a.select(F.col("source").alias("path"), (F.floor(F.col("t_ms") / 60_000) * 60_000 < mark).alias("delete")).distinct()
    v = quality.project(a)
    found = episodes.episodes(episodes.signal_rows(v))
    build = lambda rows: rollup.rollup(quality.project(rows))
    out = lifecycle.apply_retention(a, a.select(*KEY, "mask"), found, files, mark, rollup.rollup(v), build)
    n = lambda name: out[name].groupBy("device_id").agg(F.count(F.lit(1)).alias("n"))
    buckets = out["rollups"].groupBy("device_id").agg(F.count(F.lit(1)).alias("buckets"), F.sum("points").alias("bucket_points"))
    df = out["devices"].select("device_id", "points", "last_ms").join(n("quality").withColumnRenamed("n", "assessments"), "device_id").join(n("events").withColumnRenamed("n", "events"), "device_id", "left")
    return df.join(buckets, "device_id").withColumn("events", F.coalesce("events", F.lit(0)))


@query(sql(f"""
, st AS (SELECT * FROM q WHERE (t_ms // 100) % 7 <> 0)
SELECT 'raw_digest' AS "check", count(*) = (SELECT count(*) FROM t) AS passed FROM t UNION ALL SELECT 'row_count', (SELECT count(*) FROM st) = (SELECT count(*) FROM t)
UNION ALL SELECT 'versions', (SELECT count(*) FROM st WHERE (t_ms // 100) % 11 = 0) = 0 UNION ALL SELECT 'rollup_60', (SELECT sum(points) FROM ({_rolled(60)})) = (SELECT count(*) FROM t)
UNION ALL SELECT 'rollup_600', (SELECT sum(points) FROM ({_rolled(600)}) WHERE device_id <> 'D2') = (SELECT count(*) FROM t)"""))
def snapshot_checks(spark, sf_dir):
    """A snapshot whose assessments are not whole, nor one of its levels."""
    t, v = telemetry(spark, sf_dir), view(spark, sf_dir)
    fine = rollup.rollup(v)
    return lifecycle.verify_snapshot(t, t.repartition(7), _stored(spark, sf_dir), {60: fine, 600: rollup.rerollup(fine).where("device_id <> 'D2'")}, quality.VERSION)


@query("""
WITH g AS (SELECT l_orderkey * 10 + l_linenumber AS binding_id, l_partkey AS part_key FROM lineitem WHERE l_returnflag = 'R'), d AS (SELECT DISTINCT binding_id FROM g WHERE binding_id % 3 = 0)
SELECT 'stays' AS outcome, count(*) AS n FROM g WHERE binding_id NOT IN (SELECT binding_id FROM d) UNION ALL SELECT 'log', count(*) FROM g WHERE binding_id IN (SELECT binding_id FROM d)
UNION ALL SELECT 'free', count(DISTINCT part_key) FROM g WHERE binding_id IN (SELECT binding_id FROM d) UNION ALL SELECT 'held', (SELECT count(*) FROM part) - (SELECT count(DISTINCT part_key) FROM g WHERE binding_id IN (SELECT binding_id FROM d))""")
def unbound(spark, sf_dir):
    """Every third binding is taken off."""
    g = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("binding_id"), F.col("l_partkey").alias("part_key"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_key"), F.lit("BOUND").alias("state"))
    stays, log, freed = trace.unbind(g, g.where("binding_id % 3 = 0").select("binding_id").distinct(), parts)
    n = F.count(F.lit(1)).alias("n")
    out = stays.agg(n).withColumn("outcome", F.lit("stays")).unionByName(log.agg(n).withColumn("outcome", F.lit("log")))
    return out.unionByName(freed.groupBy(F.when(F.col("state") == "AVAILABLE", "free").otherwise("held").alias("outcome")).agg(n)).select("outcome", "n")


@query("""
WITH m AS (SELECT median(o_orderkey) AS m FROM orders)
SELECT 'event' AS kind, o_orderkey AS id FROM orders, m WHERE o_orderkey > m UNION ALL SELECT 'unit', c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders, m WHERE o_orderkey > m)""")
def delta_package(spark, sf_dir):
    """What a package holds since the middle key."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("c_custkey"))
    since = audit.interpolated(o.select(F.lit(1).alias("k"), F.col("seq").cast("double").alias("value")), ["k"], {"m": 0.5}).first()["m"]
    fresh, units = lifecycle.export_delta(o, table(spark, sf_dir, "customer"), since, "c_custkey")
    return fresh.select(F.lit("event").alias("kind"), F.col("seq").alias("id")).unionByName(units.select(F.lit("unit").alias("kind"), F.col("c_custkey").alias("id")))


@query("""
SELECT DISTINCT l_suppkey AS site, l_orderkey AS id FROM lineitem WHERE l_returnflag = 'A' AND (l_suppkey, l_orderkey) NOT IN (SELECT (l_suppkey, l_orderkey) FROM lineitem WHERE l_returnflag = 'R')""")
def inserted_events(spark, sf_dir):
    """Remote events of a package that the target doesn't have."""
    r = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("site"), F.col("l_orderkey").alias("id"), "l_returnflag")
    return lifecycle.ignore_known(r.where("l_returnflag = 'A'").select("site", "id"), r.where("l_returnflag = 'R'"), ["site", "id"])


@query("SELECT 'p' || CAST(o_orderkey AS VARCHAR) AS package_id, o_orderkey % 5 = 0 AS refused FROM orders")
def package_receipts(spark, sf_dir):
    """Packages whose id was received before are refused."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("package_id"), "o_orderkey")
    fresh, again = lifecycle.admit_packages(o.select("package_id"), o.where("o_orderkey % 5 = 0").select("package_id"))
    return fresh.select("package_id", F.lit(False).alias("refused")).unionByName(again.select("package_id", F.lit(True).alias("refused")))


def _explained_sql() -> str:
    from ..functions.constants import HEADING_FIELDS, OUTLIER_FIELDS, REASON_BITS, REASON_LABELS

    bit = lambda c: f"(reasons & {REASON_BITS[c]}) <> 0"
    listed = lambda fields: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {f} IS NOT NULL THEN '{f}' END" for f in fields) + "], lambda x: x IS NOT NULL), '|')"
    part = lambda c, fields: f"SELECT device_id, '{c}' AS code, '{REASON_LABELS[c]}' AS label, {listed(fields)} AS fields, count(*) AS n FROM q WHERE {bit(c)} GROUP BY ALL"
    return sql("\n" + " UNION ALL ".join([part("navigation_velocity_outlier", OUTLIER_FIELDS), part("navigation_position_drift", ["lat", "lon", "speed"]), part("heading_unavailable", HEADING_FIELDS)]))


@query(_explained_sql())
def quality_explained(spark, sf_dir):
    """Reasons with their label and fields."""
    e = quality.explain_quality(assessed(spark, sf_dir)).where("code IN ('navigation_velocity_outlier', 'navigation_position_drift', 'heading_unavailable')")
    return e.groupBy("device_id", "code", "label", F.array_join("fields", "|").alias("fields")).agg(F.count(F.lit(1)).alias("n"))


def _labels_sql() -> str:
    from ..functions.constants import FIX_LABELS, NAV_LABELS, WARNING_LABELS

    case = lambda c, labels: f"CASE {c} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in labels.items()) + " END"
    warn = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN (warning & {1 << b}) <> 0 THEN '{v}' END" for b, v in WARNING_LABELS.items()) + "], lambda x: x IS NOT NULL), '|')"
    return sql(f"\nSELECT {case('nav_mode', NAV_LABELS)} AS nav, {case('fix_mode', FIX_LABELS)} AS fix, {warn} AS warnings, count(*) AS n FROM t GROUP BY ALL")


@query(_labels_sql())
def described(spark, sf_dir):
    """Rows by the labels of their codes."""
    from ..functions.scalars import fix_label, nav_label, warning_labels

    return telemetry(spark, sf_dir).groupBy(nav_label().alias("nav"), fix_label().alias("fix"), F.array_join(warning_labels(), "|").alias("warnings")).agg(F.count(F.lit(1)).alias("n"))


@query(sql(f"""
, qm AS (SELECT *, CAST(floor(t_ms / 600000) AS BIGINT) * 600000 AS bucket_ms FROM q)
SELECT device_id, bucket_ms, 'fix' AS kind, CAST(fix_mode AS VARCHAR) AS item, count(*) AS n FROM qm GROUP BY ALL UNION ALL SELECT device_id, bucket_ms, 'quality', concat(CAST(mask AS VARCHAR), '/', CAST(reasons AS VARCHAR)), count(*) FROM qm GROUP BY ALL"""))
def rollup_histograms(spark, sf_dir):
    """Histograms of fix mode and quality of 600 s buckets, merged from 60 s ones."""
    r = rollup.rerollup(rollup.rollup(view(spark, sf_dir)))
    one = lambda c, kind: r.select("device_id", "bucket_ms", F.lit(kind).alias("kind"), F.explode(c).alias("item", "n"))
    return one("fixes", "fix").unionByName(one("quality", "quality"))


@query(sql("""
SELECT device_id, CAST(floor(t_ms / 60000) AS BIGINT) AS hour, count(*) AS rows_a, count(*) - count(*) FILTER (t_ms // 100 % 499 = 3) AS rows_b FROM t GROUP BY ALL
HAVING count(*) FILTER (t_ms // 100 % 499 = 3) > 0 OR count(*) FILTER (device_id = 'D1' AND t_ms // 100 % 701 = 5) > 0"""))
def digest_differences(spark, sf_dir):
    """The minutes in which a copy differs that lacks some rows and has others changed, told from two digest trees."""
    t = telemetry(spark, sf_dir)
    tick = F.floor(F.col("t_ms") / 100)
    copy = t.where(tick % 499 != 3).withColumn("speed", F.when((F.col("device_id") == "D1") & (tick % 701 == 5), F.col("speed") + 1).otherwise(F.col("speed")))
    return audit.tree_differences(audit.digest_tree(t, 60_000), audit.digest_tree(copy, 60_000))
