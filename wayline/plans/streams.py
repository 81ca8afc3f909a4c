"""Streaming queries: the stream has the rows of the batch query."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions.constants import RULES
from ..operators.quality import VERSION, assess, complete, project
from ..sources.frames import build_frames
from ..sources.logs import Folder
from ..sources.telemetry import TELEMETRY_SQL, spread, telemetry
from ..streaming.backfill import run_backfill
from ..streaming.episodes import rule_inputs, whole_episodes
from ..streaming.episodes import stream_all_episodes as all_episodes_of
from ..streaming.episodes import stream_episodes as episodes_of
from ..streaming.ingest import admit, counters, health_table, ingest_health, latest_episodes, latest_rollups, rejected, run_rollups, start_ingest, stored_points
from .rollups import _rolled
from .shared import rounded, span, sql, view
from .telemetry import _EPISODES
from .upkeep import SQL as _UPKEEP
from .upkeep import _stored

QUERIES, SQL = {}, {}


def _folder(spark) -> str:
    """A new folder where driver and executors can both write: below the checkpoint folder. Only a session within one process may have a folder of its machine."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="wayline-stream-")
    return f"{base}/stream-{uuid.uuid4().hex}"


def _stream(spark, sf_dir):
    events = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parquet*")
    return spark.sql(TELEMETRY_SQL, events=events)


def _land(part, folder, k):
    """One part of the events landed in the folder, in as many files as make tasks of a size."""
    spread(part).write.parquet(f"{folder}/landed/{k}")


def _landed(spark, folder):
    """A stream over the parts of the events that are landed in the folder; a run reads what was landed since the last as one batch."""
    schema = spark.read.parquet(f"{folder}/landed/0").schema
    events = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/landed")
    return spark.sql(TELEMETRY_SQL, events=events)


def _view(rows):
    return project(assess(rows))


def stream_rollup(spark, sf_dir):
    """60 s rollups kept by a stream over the events."""
    out = run_rollups(_stream(spark, sf_dir), _folder(spark), _view, 60, ["t_ms"], ["speed"])
    return rounded(out.select("device_id", "bucket_ms", "points", "fixed", "valid", "speed_sum"), 4)


def _run_late(spark, sf_dir, parents=(), rules=None):
    """The events in three parts, of which the second comes first and the first, then late, again last with some repeats."""
    folder = _folder(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = events.agg(F.max("event_id")).first()[0]
    third = [events.where(f"event_id BETWEEN {lo} AND {hi}") for lo, hi in ((n // 3, 2 * n // 3), (2 * n // 3 - 100, n), (0, n // 3))]
    for k, part in enumerate(third):
        _land(part, folder, k)
        run_rollups(_landed(spark, folder), folder, _view, 60, ["t_ms"], ["speed"], parents, rules)
    return folder


def stream_parents(spark, sf_dir):
    """600 s rollups kept from the 60 s ones by a stream that is restarted twice, with late and repeated rows."""
    out = latest_rollups(spark, _run_late(spark, sf_dir, (600,)), 600)
    return rounded(out.select("device_id", "bucket_ms", "points", "fixed", "valid", "speed_sum"), 4)


def stream_late_episodes(spark, sf_dir):
    """Episodes of all kinds by the same stream; late rows change those that they touch."""
    out = latest_episodes(spark, _run_late(spark, sf_dir, (), RULES))
    return rounded(out.select("device_id", "kind", "start_ms", "end_ms", "peak", "samples"), 4)


def stream_health(spark, sf_dir):
    """Batches and rows of the same stream, as its state tells them."""
    table = health_table(spark, _run_late(spark, sf_dir))
    now = table.agg(F.unix_millis(F.max("at"))).first()[0] / 1000 + 5
    return ingest_health(table.where("rows > 0"), now).select("rows", "behind", "ready")


def _frames_of(spark, sf_dir):
    t = telemetry(spark, sf_dir).withColumn("ax", F.coalesce("ax", F.lit(1.0))).withColumn("protocol", F.lit("GPCHCX"))
    return build_frames(t)


def _ingest(spark, sf_dir):
    """Log files landed in two parts (a file of a device and minute each), some of them retired, and an ingest that is restarted between.

    At first its clock stands in the middle of the telemetry, so that what is more than 300 s later is refused; then it has gone on by a day.
    """
    folder = _folder(spark)
    lo, hi = span(spark, sf_dir)
    minute = F.floor(F.col("source_offset") / 60_000)
    name = F.concat(F.element_at(F.split("source", "/"), -1), F.lit("-"), minute.cast("string"))
    rows = _frames_of(spark, sf_dir).select(name.alias("minute"), F.concat("frame", F.lit("\r")).alias("value"), (minute % 2).alias("half"))
    for k, part in enumerate((rows.where("half = 0"), rows)):
        part.select("minute", "value").repartition("minute").write.partitionBy("minute").text(f"{folder}/logs/{k}")
        files = spark.createDataFrame([(name,) for name in Folder(f"{folder}/logs", "*.txt").sizes()], "path string")
        retired = files.where(F.contains("path", F.lit("minute=D3-")))
        clock = (lo + hi) / 2000 + 86_400 * k
        start_ingest(spark, f"{folder}/logs", folder, {"availableNow": True}, "*.txt", retired, lambda at=clock: at).awaitTermination()
    return folder


def stream_ingest(spark, sf_dir):
    """The points of the ingest."""
    points = stored_points(spark, _ingest(spark, sf_dir))
    return rounded(points.groupBy("device_id").agg(F.count(F.lit(1)).alias("n"), F.min("t_ms").alias("first_ms"), F.max("t_ms").alias("last_ms"), F.sum("speed").alias("speed_sum")), 4)


def stream_rejects(spark, sf_dir):
    """What the same ingest refused by its clock, as the reject table and the files' counters tell it."""
    folder = _ingest(spark, sf_dir)
    refused = rejected(spark, folder).groupBy("device_id", "reject_reason").agg(F.count(F.lit(1)).alias("n"), F.min("t_ms").alias("first_ms"))
    get = lambda name: F.coalesce(F.col("counters")[name], F.lit(0))
    device = F.regexp_extract("source", "minute=(D[0-9])-", 1).alias("device_id")
    files = counters(spark, folder).groupBy(device).agg(*[F.sum(get(c)).alias(c) for c in ("points", "duplicates", "rejected", "valid_ascii", "unparsed_bytes")])
    return files.join(refused, "device_id", "left")


def stream_all_episodes(spark, sf_dir):
    """Episodes of all kinds by a stateful stream that is restarted twice; a tenth of the first half's rows comes late, when the stream has gone on."""
    folder = _folder(spark)
    inputs = rule_inputs(view(spark, sf_dir))
    lo, hi = span(spark, sf_dir)
    late = F.pmod(F.xxhash64("device_id", "t_ms"), F.lit(10)) == 3
    first = F.col("t_ms") <= (lo + hi) // 2
    inputs.withColumn("part", F.when(~first, 2).when(late, 1).otherwise(0)).write.partitionBy("part").parquet(f"{folder}/parts")  # the view is made once
    for k in range(3):
        spark.read.parquet(f"{folder}/parts").where(F.col("part") == k).drop("part").write.mode("append").parquet(f"{folder}/landed")
        stream = spark.readStream.schema(inputs.schema).parquet(f"{folder}/landed")
        updates = all_episodes_of(stream, hold_ms=hi - lo)

        def keep(batch, batch_id):
            batch.write.mode("overwrite").parquet(f"{folder}/all/batch={batch_id}")

        updates.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/detectors").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/all").where("state <> 'late'")
    last = rows.groupBy("device_id", "kind", "start_ms").agg(F.max_by(F.struct("end_ms", "peak", "peak_ms", "samples", "joined", "version", "state"), F.struct("batch", F.col("state") == "closed")).alias("e"))
    out = whole_episodes(last.where("e.state <> 'gone'").select("device_id", "kind", "start_ms", "e.*"))
    return rounded(out.select("device_id", "kind", "start_ms", "end_ms", "peak", "samples"), 4)


def backfill_steps(spark, sf_dir):
    """The backfill in steps of 500 missing points, stopped after two and begun again; the SQL assesses all rows."""
    folder = _folder(spark)
    t = complete(telemetry(spark, sf_dir))
    _stored(spark, sf_dir).write.parquet(f"{folder}/stored")  # a table, so that it is made once
    have = spark.read.parquet(f"{folder}/stored")
    run_backfill(t, have, VERSION, assess, folder, 500, steps=2)
    full = run_backfill(t, have, VERSION, assess, folder, 500)
    return rounded(full.groupBy("device_id", "mask", "reasons", "version").agg(F.count(F.lit(1)).alias("n"), F.sum("ground.value").alias("total")), 4)


def admitted_rows(spark, sf_dir):
    """Rows of the future and of before 2010 are refused, however old others are."""
    t = telemetry(spark, sf_dir)
    tick = F.floor(F.col("t_ms") / 100)
    moved = t.withColumn("t_ms", F.when(tick % 13 == 0, F.col("t_ms") + 3_155_760_000_000).when(tick % 17 == 0, F.lit(1_262_303_999_999)).when(tick % 19 == 0, F.lit(1_262_304_000_000)).otherwise(F.col("t_ms")))
    return admit(moved, 1_800_000_000.0).groupBy("device_id").agg(F.count(F.lit(1)).alias("n"), F.min("t_ms").alias("first_ms"))


def stream_rule_change(spark, sf_dir):
    """Overspeed episodes by a stateful stream whose rules change after half of the events: open episodes end there."""
    folder = _folder(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = events.agg(F.max("event_id")).first()[0]
    for version, part in ((1, events.where(f"event_id <= {n // 2}")), (2, events.where(f"event_id > {n // 2}"))):
        _land(part, folder, version - 1)
        _run_states(_landed(spark, folder), folder, version)
    return _episodes_in(spark, folder)


def _run_states(rows, folder, version):
    value = F.when((F.col("speed") * 3.6 > 85) & (F.col("protocol") == "GPCHCX"), F.col("speed") * 3.6)
    updates = episodes_of(rows.select("device_id", "t_ms", value.alias("value")), "overspeed", version)

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/updates/batch={batch_id}")

    updates.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/states").trigger(availableNow=True).start().awaitTermination()


def _episodes_in(spark, folder):
    last = spark.read.parquet(f"{folder}/updates").groupBy("device_id", "kind", "start_ms").agg(F.max_by(F.struct("end_ms", "peak", "samples"), F.struct("end_ms", "samples")).alias("e"))
    return rounded(last.select("device_id", "kind", "start_ms", "e.*"), 4)


def stream_episodes(spark, sf_dir):
    """Overspeed episodes of raw speed, found by a stateful stream over the events."""
    folder = _folder(spark)
    _run_states(_stream(spark, sf_dir), folder, 1)
    return _episodes_in(spark, folder)


QUERIES |= {f.__name__: f for f in (stream_rollup, stream_episodes, stream_parents, stream_late_episodes, stream_health, stream_ingest, stream_rejects, stream_all_episodes, backfill_steps, admitted_rows, stream_rule_change)}
SQL["stream_rollup"] = sql(f"\nSELECT device_id, bucket_ms, points, fixed, valid, round(speed_sum, 4) + 0.0 AS speed_sum FROM ({_rolled(60)})")
SQL["stream_episodes"] = sql(""",
se AS (SELECT device_id, t_ms, CASE WHEN speed * 3.6 > 85 AND protocol = 'GPCHCX' THEN speed * 3.6 END AS value FROM t),
sf AS (SELECT *, value IS NOT NULL AND (lag(value) OVER w IS NULL OR t_ms - lag(t_ms) OVER w > 3000) AS fresh FROM se WINDOW w AS (PARTITION BY device_id ORDER BY t_ms)),
sg AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY t_ms) AS run FROM sf)
SELECT device_id, 'overspeed' AS kind, min(t_ms) AS start_ms, max(t_ms) AS end_ms, round(max(value), 4) + 0.0 AS peak, count(*) AS samples FROM sg WHERE value IS NOT NULL GROUP BY device_id, run""")

SQL["stream_parents"] = sql(f"\nSELECT device_id, bucket_ms, points, fixed, valid, round(speed_sum, 4) + 0.0 AS speed_sum FROM ({_rolled(600)})")
SQL["stream_late_episodes"] = sql(_EPISODES + "\nSELECT device_id, kind, start_ms, end_ms, round(peak, 4) + 0.0 AS peak, samples FROM ev")
SQL["stream_health"] = "WITH m AS (SELECT max(event_id) AS n FROM events) SELECT count(*) FILTER (event_id BETWEEN n // 3 AND 2 * n // 3) + count(*) FILTER (event_id BETWEEN 2 * n // 3 - 100 AND n) + count(*) FILTER (event_id BETWEEN 0 AND n // 3) AS rows, CAST(0 AS BIGINT) AS behind, true AS ready FROM events, m"
_REFUSED = """, m AS (SELECT *, CAST(floor(t_ms / 60000) AS BIGINT) % 2 = 0 AS early, t_ms / 1000.0 > (min(t_ms) OVER () + max(t_ms) OVER ()) / 2000.0 + 300 AS ahead FROM t), i AS (SELECT *, early AND ahead AS refused FROM m WHERE device_id <> 'D3')"""
SQL["stream_rejects"] = sql(_REFUSED + """
SELECT device_id, count(*) AS points, count(*) FILTER (early AND NOT ahead) AS duplicates, count(*) FILTER (refused) AS rejected, count(*) + count(*) FILTER (early) AS valid_ascii, CAST(0 AS BIGINT) AS unparsed_bytes,
  CASE WHEN count(*) FILTER (refused) > 0 THEN 'clock_range' END AS reject_reason, CASE WHEN count(*) FILTER (refused) > 0 THEN count(*) FILTER (refused) END AS n, min(t_ms) FILTER (refused) AS first_ms FROM i GROUP BY device_id""")
SQL["stream_ingest"] = sql("\nSELECT device_id, count(*) AS n, min(t_ms) AS first_ms, max(t_ms) AS last_ms, round(sum(speed), 4) + 0.0 AS speed_sum FROM t WHERE device_id <> 'D3' GROUP BY device_id")
SQL["stream_all_episodes"] = SQL["stream_late_episodes"]
SQL["backfill_steps"] = _UPKEEP["backfill"]
SQL["admitted_rows"] = sql("""
, mo AS (SELECT device_id, CASE WHEN t_ms // 100 % 13 = 0 THEN t_ms + 3155760000000 WHEN t_ms // 100 % 17 = 0 THEN 1262303999999 WHEN t_ms // 100 % 19 = 0 THEN 1262304000000 ELSE t_ms END AS t_ms FROM t)
SELECT device_id, count(*) AS n, min(t_ms) AS first_ms FROM mo WHERE t_ms BETWEEN 1262304000000 AND 1800000300000 GROUP BY device_id""")
SQL["stream_rule_change"] = SQL["stream_episodes"].replace("AND protocol = 'GPCHCX' THEN speed * 3.6 END AS value FROM t", "AND protocol = 'GPCHCX' THEN speed * 3.6 END AS value, 4 * seq + dev > (SELECT max(event_id) FROM events) // 2 AS later FROM (SELECT *, (t_ms - 1704067200000) AS since, CAST(substr(device_id, 2) AS BIGINT) AS dev, (t_ms - 1704067200000 - (t_ms - 1704067200000) // 95000 * 5000) // 100 AS seq FROM t)").replace("t_ms - lag(t_ms) OVER w > 3000) AS fresh", "t_ms - lag(t_ms) OVER w > 3000 OR later <> lag(later) OVER w) AS fresh")
