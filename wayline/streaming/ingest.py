"""Continuous ingest with Structured Streaming.

Logs may grow: a stream reads on where it stopped in each file. What a batch writes (points, rejects, counters, cursors,
rollups, episodes) becomes visible at once when the batch is whole (``Ledger``); a batch that is tried again decides by the
clock of its first attempt and writes over what it left. Of what is stored a batch reads the cells that it touches.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import RULES
from ..functions.scalars import bucket_start
from ..operators.episodes import episode_parts, merged_episodes, signal_rows
from ..operators.lifecycle import dedup_first
from ..operators.rollup import rerollup, rollup, touched_buckets
from ..operators.timeline import SLICE_MS, slice_of
from ..sources.frames import FIELDS, counter_rows, decode_points, matches_in, with_checksum
from ..sources.logs import Folder, growing_logs
from .ledger import Ledger, celled, latest_of

KEY = ["device_id", "t_ms", "protocol"]
FUTURE_S, EARLIEST_S = 300, 1262304000


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source", "name").agg(F.sum("n").alias("n"))


MERGES = {"counters": _summed, "cursors": latest_of("path"), "episodes": latest_of("device_id", "_slice")}


def ledger_of(spark: SparkSession, folder: str, fanout: int | None = None) -> Ledger:
    return Ledger(spark, folder, _Merges(MERGES), **({"fanout": fanout} if fanout else {}))


class _Merges(dict):
    """Rollups of any level keep the latest row of a bucket."""

    def __contains__(self, name: str) -> bool:
        return name.startswith("rollups") or super().__contains__(name)

    def __getitem__(self, name: str):
        return latest_of("device_id", "bucket_ms") if name.startswith("rollups") else super().__getitem__(name)


def each_batch(work):
    """A function of (batch, batch_id) that keeps the batch while work reads it, so that its source is read once."""

    def run(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist(StorageLevel.DISK_ONLY)
        try:
            work(held, batch_id)
        finally:
            held.unpersist()

    return run


def admit(batch: DataFrame, now_s: float) -> DataFrame:
    """Rows of any age from 2010 on; none more than 300 s ahead."""
    return batch.where((F.col("t_ms") <= (now_s + FUTURE_S) * 1000) & (F.col("t_ms") >= EARLIEST_S * 1000))


def _between(rows: DataFrame, column: str, lo: int, hi: int) -> DataFrame:
    return rows.where(F.col(column).between(lo, hi))


def store_points(ledger: Ledger, rows: DataFrame, batch_id: int, order: list[str]) -> DataFrame:
    """Rows of a batch whose keys are new, written as its part; of the points so far only the batch's cells and times are read."""
    rows = celled(rows)
    lo, hi = rows.agg(F.min("t_ms"), F.max("t_ms")).first()
    have = None if lo is None else ledger.read_cells("points", rows)
    fresh = dedup_first(rows, KEY, order, None if have is None else _between(have, "t_ms", lo, hi))
    return ledger.add("points", fresh, batch_id, cells=True)


def _points_around(ledger: Ledger, fresh: DataFrame, around: DataFrame, at: str, width_ms: int) -> DataFrame:
    """All points in some places (device_id, at, a multiple of width_ms): those stored in their cells, and fresh ones."""
    lo, hi = around.agg(F.min(at), F.max(at)).first()
    if lo is None:
        return fresh.drop("day", "grp")
    have = ledger.read_cells("points", celled(around, at))
    rows = fresh if have is None else _between(have, "t_ms", lo, hi + width_ms - 1).unionByName(fresh)
    place = (F.floor(F.col("t_ms") / width_ms) * width_ms).alias(at)
    return rows.withColumn(at, place).join(around, ["device_id", at], "left_semi").drop(at, "day", "grp")


def maintain_rollups(ledger: Ledger, fresh: DataFrame, batch_id: int, project, seconds: int = 60, metrics: list[str] | None = None, parents: tuple[int, ...] = ()) -> None:
    """Buckets that a batch touches, computed anew from all their points, then their parents from them."""
    touched = touched_buckets(fresh, (seconds,)).select("device_id", "bucket_ms").persist()
    # A bucket's first row looks back at most one row: the bucket before is read as well.
    around = touched.unionByName(touched.withColumn("bucket_ms", F.col("bucket_ms") - seconds * 1000)).distinct()
    rows = _points_around(ledger, fresh, around, "bucket_ms", seconds * 1000)
    more = {"metrics": metrics} if metrics else {}
    out = rollup(project(rows), seconds, **more).join(touched, ["device_id", "bucket_ms"], "left_semi")
    new = ledger.add("rollups", celled(out.withColumn("batch", F.lit(batch_id)), "bucket_ms"), batch_id, cells=True)
    for level in parents:
        wide = touched.select("device_id", bucket_start("bucket_ms", level).alias("_wide")).distinct()
        have = ledger.read_cells("rollups", new)
        lo, hi = wide.agg(F.min("_wide"), F.max("_wide")).first()
        fine = new if have is None or lo is None else _between(have, "bucket_ms", lo, hi + level * 1000 - 1).unionByName(new)
        fine = latest_of("device_id", "bucket_ms")(fine).drop("batch", "day", "grp").withColumn("_wide", bucket_start("bucket_ms", level))
        merged = rerollup(fine.join(wide, ["device_id", "_wide"], "left_semi").drop("_wide"), level, **more)
        ledger.add(f"rollups-{level}", celled(merged.withColumn("batch", F.lit(batch_id)), "bucket_ms"), batch_id, cells=True)
    touched.unpersist()


def maintain_episodes(ledger: Ledger, fresh: DataFrame, batch_id: int, project, rules: dict = RULES) -> None:
    """Parts of episodes in the slices that a batch touches, found anew from all their points; late rows are rows like others.

    A slice has one row with all its parts, also when it has none (any more).
    """
    own = fresh.select("device_id", slice_of().alias("_slice")).distinct()
    # The slice after a touched one begins anew or goes on; a slice looks back into the one before.
    touched = own.select("device_id", F.explode(F.array("_slice", F.col("_slice") + 1)).alias("_slice")).distinct()
    around = touched.select("device_id", F.explode(F.array(F.col("_slice") * SLICE_MS, (F.col("_slice") - 1) * SLICE_MS)).alias("_at")).distinct()
    rows = _points_around(ledger, fresh, around, "_at", SLICE_MS)
    parts = episode_parts(signal_rows(project(rows), rules))
    cols = [c for c in parts.columns if c not in ("device_id", "_slice")]
    listed = parts.groupBy("device_id", "_slice").agg(F.collect_list(F.struct(*cols)).alias("parts"))
    out = touched.join(listed, ["device_id", "_slice"], "left").withColumn("batch", F.lit(batch_id))
    ledger.add("episodes", out, batch_id)


def latest_episodes(spark: SparkSession, folder: str) -> DataFrame:
    """Episodes from the parts of the last batch that touched each slice."""
    rows = latest_of("device_id", "_slice")(ledger_of(spark, folder).read("episodes"))
    return merged_episodes(rows.select("device_id", "_slice", F.inline("parts")))


def latest_rollups(spark: SparkSession, folder: str, seconds: int = 60, base: int = 60) -> DataFrame:
    rows = ledger_of(spark, folder).read("rollups" if seconds == base else f"rollups-{seconds}")
    return latest_of("device_id", "bucket_ms")(rows).drop("batch", "day", "grp")


def stored_points(spark: SparkSession, folder: str) -> DataFrame:
    return ledger_of(spark, folder).read("points").drop("day", "grp")


def rejected(spark: SparkSession, folder: str) -> DataFrame:
    """source, source_offset, source_length, protocol, device_id, t_ms, reject_reason and batch of each frame that was refused."""
    return ledger_of(spark, folder).read("rejects")


def counters(spark: SparkSession, folder: str) -> DataFrame:
    """The counters of each file over all batches."""
    rows = _summed(ledger_of(spark, folder).read("counters"))
    return rows.groupBy("source").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "n")))).alias("counters"))


def run_rollups(points: DataFrame, folder: str, project, seconds: int = 60, order: list[str] | None = None, metrics: list[str] | None = None, parents: tuple[int, ...] = (), rules: dict | None = None) -> DataFrame:
    """A stream of points to rollups (and, with rules, episodes) under folder, until its input is used up."""

    def each(batch: DataFrame, batch_id: int) -> None:
        ledger = ledger_of(batch.sparkSession, folder)
        if ledger.done(batch_id):
            return
        now_s = ledger.clock(batch_id)
        fresh = store_points(ledger, batch, batch_id, order or ["t_ms"])
        maintain_rollups(ledger, fresh, batch_id, project, seconds, metrics, parents)
        if rules is not None:
            maintain_episodes(ledger, fresh, batch_id, project, rules)
        ledger.commit(batch_id, rows=batch.count(), points=fresh.count(), at=now_s, behind=0)

    query = points.writeStream.foreachBatch(each_batch(each)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return latest_rollups(points.sparkSession, folder, seconds, seconds)


def ingest_batch(ledger: Ledger, pieces: DataFrame, batch_id: int, logs: Folder | None = None, now: Callable[[], float] = time.time, retired: DataFrame | None = None, project=None, seconds: int = 60, metrics: list[str] | None = None, parents: tuple[int, ...] = (), rules: dict | None = None) -> None:
    """One batch of log ranges (path, start, content, size) to all tables, by the clock of the batch."""
    if ledger.done(batch_id):
        return
    now_s = ledger.clock(batch_id, now)
    if retired is not None:
        pieces = pieces.join(retired.select("path"), "path", "left_anti")
    matches = matches_in(pieces).persist(StorageLevel.DISK_ONLY)
    decoded = decode_points(matches.drop("matched"), now_s).persist(StorageLevel.DISK_ONLY)
    try:
        fresh = store_points(ledger, decoded.where("reject_reason IS NULL").drop("reject_reason"), batch_id, ["source", "source_offset"])
        bad = decoded.where("reject_reason IS NOT NULL").select("source", "source_offset", "source_length", "protocol", "device_id", "t_ms", "reject_reason")
        other = with_checksum(matches.where(~F.substring_index(F.substring("frame", 2, 20), ",", 1).isin(*FIELDS))).where("NOT checksum_ok")
        other = other.select("source", "source_offset", "source_length", F.col("name").alias("protocol"), F.lit(None).cast("string").alias("device_id"), F.lit(None).cast("bigint").alias("t_ms"), F.lit("checksum").alias("reject_reason"))
        rejects = ledger.add("rejects", bad.unionByName(other).withColumn("batch", F.lit(batch_id)), batch_id)
        ledger.add("counters", counter_rows(decoded, fresh, matches, pieces), batch_id)
        read = pieces.groupBy("path").agg(F.max(F.col("start") + F.length("content")).alias("stop"), F.max("size").alias("size")).withColumn("batch", F.lit(batch_id))
        cursors = ledger.add("cursors", read, batch_id)
        if project is not None:
            maintain_rollups(ledger, fresh, batch_id, project, seconds, metrics, parents)
            if rules is not None:
                maintain_episodes(ledger, fresh, batch_id, project, rules)
        known = ledger.read("cursors")
        known = cursors if known is None else known.unionByName(cursors)
        behind = 0 if logs is None else _behind(logs, known, retired)
        ledger.commit(batch_id, rows=decoded.count(), points=fresh.count(), rejected=rejects.count(), at=now_s, behind=behind)
    finally:
        decoded.unpersist()
        matches.unpersist()


def _behind(logs: Folder, cursors: DataFrame, retired: DataFrame | None) -> int:
    """Bytes of the files that are there which no batch has read."""
    spark = cursors.sparkSession
    cursors = latest_of("path")(cursors)
    sizes = spark.createDataFrame(list(logs.sizes().items()), "path string, have bigint")
    if retired is not None:
        sizes = sizes.join(retired.select("path"), "path", "left_anti")
    # A file that is shorter than what was read of it is a new one.
    left = F.when(F.col("have") >= F.coalesce("stop", F.lit(0)), F.col("have") - F.coalesce("stop", F.lit(0))).otherwise(F.col("have"))
    return sizes.join(cursors.select("path", "stop"), "path", "left").agg(F.coalesce(F.sum(left), F.lit(0))).first()[0]


def start_ingest(spark: SparkSession, logs: str, folder: str, trigger: dict | None = None, glob: str = "*.log", retired: DataFrame | None = None, now: Callable[[], float] = time.time, step: int | None = None, **derived):
    """Continuous ingest of growing log files to the tables under folder; files of the retired list (path below logs) are passed over.

    now is asked once a batch; derived goes to ``ingest_batch`` (project, seconds, metrics, parents, rules). Returns the running query.
    """
    listed = Folder(logs, glob)

    def each(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(ledger_of(batch.sparkSession, folder), batch, batch_id, listed, now, retired, **derived)

    source = growing_logs(spark, logs, glob, stream=True, **({"step": step} if step else {}))
    return source.writeStream.foreachBatch(each_batch(each)).option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"processingTime": "1 second"})).start()


HEALTH = "batch bigint, rows bigint, at timestamp, behind bigint"


def health_table(spark: SparkSession, folder: str) -> DataFrame:
    """The last batches: rows, time and bytes still to be read."""
    state = ledger_of(spark, folder).state() or {"recent": []}
    rows = [(r["batch"], r["rows"], dt.datetime.fromtimestamp(r["at"], dt.UTC), r["behind"]) for r in state["recent"]]
    return spark.createDataFrame(rows, HEALTH)


def totals(spark: SparkSession, folder: str) -> dict[str, int]:
    """Rows, points and rejects over all batches."""
    return {k: v for k, v in (ledger_of(spark, folder).state() or {"totals": {}})["totals"].items() if k != "behind"}


def ingest_health(table: DataFrame, now_s: float, fresh_s: float = 30.0) -> DataFrame:
    """batches, rows, behind (of the last batch), age_s and whether the ingest is ready: fresh and with nothing left to read."""
    # A batch may tell its progress more than once.
    batches = table.groupBy("batch").agg(F.max("rows").alias("rows"), F.max("at").alias("at"), F.max_by("behind", "at").alias("behind"))
    age = F.lit(now_s) - F.unix_millis(F.max("at")) / 1000
    out = batches.agg(F.count(F.lit(1)).alias("batches"), F.sum("rows").alias("rows"), F.max_by("behind", "batch").alias("behind"), age.alias("age_s"))
    return out.withColumn("ready", (F.col("age_s") < fresh_s) & (F.col("behind") == 0))
