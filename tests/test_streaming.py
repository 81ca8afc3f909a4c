"""Growing logs, tables written batch by batch, and the ingest over both."""

import os
import time

import pytest
from pyspark.sql import functions as F

from wayline.operators.quality import assess, project
from wayline.sources import frames
from wayline.sources.logs import LINE, Folder, LogStream, growing_logs
from wayline.streaming import ingest
from wayline.streaming.ledger import Ledger, celled, latest_of


def _frame(t_s: float, device: str = "A", speed: float = 1.0) -> bytes:
    gps = t_s - 315_964_800 + 18
    at = {0: "GPCHCX", 1: str(int(gps // 604_800)), 2: f"{gps % 604_800:.3f}", 12: "31.2", 13: "121.6", 18: str(speed), 21: "42", 23: "0", 33: "X", 45: device}
    body = ",".join(at.get(i, "0") for i in range(46)).encode()
    xor = 0
    for b in body:
        xor ^= b
    return b"$" + body + b"*%02X\r\n" % xor


def test_ranges_part_a_file_at_line_ends(tmp_path):
    lines = [b"\x00\xff" * (k % 5) + b"$GPA,%d*00\r\n" % k for k in range(3000)]
    blob = b"".join(lines) + b"unfinished"
    (tmp_path / "a.log").write_bytes(blob)
    for step in (1, 7, 100, 4096, 1 << 20):
        folder = Folder(str(tmp_path), step=step)
        if step == 1:
            (tmp_path / "a.log").write_bytes(blob[:300])
        have = (tmp_path / "a.log").read_bytes()
        found = [r for part in folder.ranges("a.log", 0, len(have), len(have)) for r in folder.read(part)]
        assert b"".join(r[2] for r in found) == have and [r[1] for r in found] == [sum(len(x[2]) for x in found[:k]) for k in range(len(found))]
        assert all(r[1] == 0 or have[r[1] - 1 : r[1]] == b"\n" or r[1] > have.rfind(b"\n") for r in found)
        (tmp_path / "a.log").write_bytes(blob)


def test_long_stretches_without_a_line_end_are_cut(tmp_path):
    blob = b"\x01" * (5 * LINE) + b"$GPA,1*00\r\n" + b"\x02" * (3 * LINE)
    (tmp_path / "a.log").write_bytes(blob)
    folder = Folder(str(tmp_path), step=LINE // 2)
    found = [r for part in folder.ranges("a.log", 0, len(blob), len(blob)) for r in folder.read(part)]
    assert b"".join(r[2] for r in found) == blob and sum(b"$GPA,1*00\r\n" in r[2] for r in found) == 1
    assert folder.whole_lines("a.log", len(blob)) == len(blob) - LINE


def test_offsets_resume_and_tell_new_files_from_grown_ones(tmp_path):
    at = tmp_path / "2024-01-01" / "a.log"
    at.parent.mkdir()
    stream = LogStream(Folder(str(tmp_path)))
    read = lambda a, b: b"".join(r[2] for p in LogStream(Folder(str(tmp_path))).partitions(a, b) for r in stream.read(p))
    assert stream.latestOffset() == {}
    at.write_bytes(b"one\ntwo\nthr")
    first = stream.latestOffset()
    assert read({}, first) == b"one\ntwo\n"
    with at.open("ab") as f:
        f.write(b"ee\nfour\n")
    second = stream.latestOffset()
    assert read(first, second) == b"three\nfour\n" and read(second, stream.latestOffset()) == b""
    at.write_bytes(b"new file of the same name, longer\n" * 3)
    third = stream.latestOffset()
    assert read(second, third) == b"new file of the same name, longer\n" * 3
    at.write_bytes(b"short\n")
    assert read(third, stream.latestOffset()) == b"short\n"
    os.symlink(at, tmp_path / "b.log")
    assert list(stream.latestOffset()) == ["2024-01-01/a.log"]
    at.unlink()
    assert read(third, third) == b"" and stream.latestOffset() == {}


def test_a_large_file_is_many_tasks(spark, tmp_path):
    frame = b"$GPA,1*00\r\n"
    (tmp_path / "x.log").write_bytes(b"\x00\x01" + frame * 50_000)
    rows = growing_logs(spark, str(tmp_path), step=1 << 16)
    assert rows.rdd.getNumPartitions() == -(-(2 + 11 * 50_000) // (1 << 16))
    r = frames.frames_in(rows).agg(F.count("*"), F.max("source_offset"), F.sum("source_offset")).first()
    assert tuple(r) == (50_000, 2 + 49_999 * 11, 2 * 50_000 + 11 * 49_999 * 25_000)


def _view(rows):
    return project(assess(rows))


def _run(spark, logs, folder, now, **more):
    ingest.start_ingest(spark, str(logs), str(folder), {"availableNow": True}, now=now, **more).awaitTermination()


def _append(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("ab") as f:
        f.write(b"".join(lines))


def test_ingest_of_a_growing_file(spark, tmp_path):
    """Each batch has its own clock, refused frames are kept, counters add up, and what is appended is read once."""
    start, clock = 1_704_067_200.0, {"now": 1_704_067_200.0}
    log, folder = tmp_path / "logs" / "2024-01-01" / "a.log", tmp_path / "out"
    _append(log, b"\x80junk", _frame(start), _frame(start + 1), _frame(start + 3600), b"$GPAUX,1*46\r\n$GPAUX,1*00\r\n", _frame(start + 2)[:40])
    _run(spark, tmp_path / "logs", folder, lambda: clock["now"])
    clock["now"] += 3600
    _append(log, _frame(start + 2)[40:], _frame(start + 1), _frame(start + 3600), _frame(start + 3800), _frame(start)[:-4] + b"ZZ\r\n", _frame(start)[:-4] + b"00\r\n")
    _run(spark, tmp_path / "logs", folder, lambda: clock["now"])
    _run(spark, tmp_path / "logs", folder, lambda: clock["now"] + 9e9)
    times = sorted(r["t_ms"] / 1000 - start for r in ingest.stored_points(spark, str(folder)).collect())
    assert times == [0, 1, 2, 3600, 3800]
    refused = [(r["reject_reason"], r["protocol"], r["t_ms"] and r["t_ms"] / 1000 - start, r["batch"]) for r in ingest.rejected(spark, str(folder)).collect()]
    assert sorted(refused, key=str) == sorted([("clock_range", "GPCHCX", 3600.0, 0), ("checksum", "GPAUX", None, 0), ("checksum", "GPCHCX", 0.0, 1)], key=str)
    blob = log.read_bytes()
    (row,) = ingest.counters(spark, str(folder)).collect()
    assert row["source"] == "2024-01-01/a.log"
    # What isn't parsed: junk before the first frame, and the frame whose checksum is no number.
    assert row["counters"] == {"valid_ascii": 8, "protocol:GPCHCX": 7, "protocol:GPAUX": 1, "auxiliary_ascii": 1, "points": 5, "duplicates": 1, "rejected": 3, "error:clock_range": 1, "error:checksum": 2, "read_bytes": len(blob), "unparsed_bytes": 5 + len(_frame(start))}
    state = ingest.ledger_of(spark, str(folder)).state()
    assert [r["points"] for r in state["recent"]] == [2, 3] and ingest.totals(spark, str(folder))["points"] == 5
    health = ingest.ingest_health(ingest.health_table(spark, str(folder)), clock["now"] + 5).first()
    assert health["ready"] and health["behind"] == 0
    _append(log, _frame(start + 4000))
    assert ingest._behind(Folder(str(tmp_path / "logs")), ingest.ledger_of(spark, str(folder)).read("cursors"), None) == len(_frame(start + 4000))


def test_a_crash_between_two_tables_repeats_nothing(spark, tmp_path, monkeypatch):
    start = 1_704_067_200.0
    log, folder = tmp_path / "logs" / "d" / "a.log", tmp_path / "out"
    _append(log, *[_frame(start + k / 10) for k in range(50)])
    _run(spark, tmp_path / "logs", folder, lambda: start, project=_view, metrics=["speed"])
    _append(log, *[_frame(start + 4 + k / 10) for k in range(50)], _frame(start + 400))
    whole, calls = ingest.maintain_rollups, []

    def breaks(*a, **k):
        calls.append(1)
        raise OSError("the executor is gone")

    monkeypatch.setattr(ingest, "maintain_rollups", breaks)
    with pytest.raises(Exception, match="gone"):
        _run(spark, tmp_path / "logs", folder, lambda: start, project=_view, metrics=["speed"])
    assert calls and ingest.stored_points(spark, str(folder)).count() == 50  # nothing of the broken batch can be seen
    monkeypatch.setattr(ingest, "maintain_rollups", whole)
    # The second attempt keeps the clock of the first, by which the last frame is ahead.
    _run(spark, tmp_path / "logs", folder, lambda: start + 1000, project=_view, metrics=["speed"])
    points = ingest.stored_points(spark, str(folder))
    assert points.count() == 90 == points.select("t_ms").distinct().count()
    assert [r["reject_reason"] for r in ingest.rejected(spark, str(folder)).collect()] == ["clock_range"]
    assert ingest.latest_rollups(spark, str(folder)).agg(F.sum("points")).first()[0] == 90
    # A batch whose state stands is passed over.
    ingest.ingest_batch(ingest.ledger_of(spark, str(folder)), spark.createDataFrame([("d/a.log", 0, bytearray(_frame(start + 9)), 10)], "path string, start bigint, content binary, size bigint"), 1)
    assert ingest.stored_points(spark, str(folder)).count() == 90


def test_parts_are_merged_and_none_is_lost(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "t"), {"latest": latest_of("device_id", "t_ms")}, fanout=3)
    for b in range(11):
        rows = celled(spark.createDataFrame([("A", 1000 * b, b), ("B", 7, b)], "device_id string, t_ms bigint, batch bigint"))
        ledger.add("all", rows, b, cells=True)
        ledger.add("latest", rows, b, cells=True)
        ledger.commit(b, rows=2)
    state = ledger.state()
    assert len(state["tables"]["all"]["parts"]) == len("0-9 0-10 2-8".split()) and state["totals"] == {"rows": 22}
    assert ledger.read("all").count() == 22
    got = {(r["device_id"], r["t_ms"]): r["batch"] for r in latest_of("device_id", "t_ms")(ledger.read("latest")).collect()}
    assert got == {("A", 1000 * b): b for b in range(11)} | {("B", 7): 10}
    assert len(ledger.store.names(str(tmp_path / "t" / "state"))) == 2 and len(ledger.store.names(str(tmp_path / "t" / "all"))) <= 3 + 3


def _bytes_read(spark, work) -> int:
    """Bytes that the stages of some work read from files."""
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    last = lambda: {(s := stages.apply(i)).stageId(): s.inputBytes() for stages in [store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)] for i in range(stages.size())}
    before = set(last())
    work()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for k, n in last().items() if k not in before)


def test_what_a_batch_reads_does_not_grow(spark, tmp_path):
    """A day a batch: the tenth reads no more of the stored points and rollups than the second."""
    day = 86_400_000
    ledger = ingest.ledger_of(spark, str(tmp_path / "t"), fanout=100)
    read = []
    for b in range(10):
        t = [1_704_067_200_000 + day * b + 100 * k for k in range(3000)]
        cols = "device_id string, t_ms bigint, protocol string, speed double"
        rows = spark.createDataFrame([("A", x, "GPCHCX", float(x % 977) / 7) for x in t], cols)

        def step(rows=rows, b=b):
            fresh = ingest.store_points(ledger, rows, b, ["t_ms"])
            around = fresh.select("device_id", (F.floor(F.col("t_ms") / 60_000) * 60_000).alias("at")).distinct()
            assert ingest._points_around(ledger, fresh, around, "at", 60_000).count() == 3000

        read.append(_bytes_read(spark, step))
        ledger.commit(b, rows=3000)
    assert read[-1] <= 1.3 * read[1], read


def test_many_cells_are_joined(spark, tmp_path, monkeypatch):
    from wayline.streaming import ledger as module

    ledger = Ledger(spark, str(tmp_path / "t"))
    rows = celled(spark.createDataFrame([(d, 86_400_000 * k) for d in "ABCDE" for k in range(4)], "device_id string, t_ms bigint"))
    ledger.add("p", rows, 0, cells=True)
    ledger.commit(0)
    wanted = rows.where("device_id = 'C' OR t_ms = 0")
    few = {tuple(r) for r in ledger.read_cells("p", wanted).collect()}
    monkeypatch.setattr(module, "MOST_CELLS", 2)
    assert {tuple(r) for r in ledger.read_cells("p", wanted).collect()} == few and {tuple(r) for r in wanted.collect()} <= few


def test_the_time_is_asked_each_batch(spark, tmp_path):
    """A stream that goes on admits what is later than its start."""
    began = time.time()
    log, folder = tmp_path / "logs" / "a.log", tmp_path / "out"
    clock = {"now": began}
    _append(log, _frame(began))
    query = ingest.start_ingest(spark, str(tmp_path / "logs"), str(folder), {"processingTime": "100 milliseconds"}, now=lambda: clock["now"])
    try:
        for k in (1, 2):
            query.processAllAvailable()
            clock["now"] = began + 3600 * k
            _append(log, _frame(began + 3600 * k))
        query.processAllAvailable()
    finally:
        query.stop()
    assert ingest.stored_points(spark, str(folder)).count() == 3


def _track_view(spark, n=3000):
    """A device that stops, drives, jumps and is silent, with rows of two protocols at some times."""
    t = F.lit(1_704_067_200_000) + F.col("id") * 700 + F.when(F.col("id") > 1500, 30_000).otherwise(0)
    state = F.floor(F.col("id") / 97) % 2
    rows = spark.range(n).select(
        F.lit("A").alias("device_id"), t.alias("t_ms"), F.when(F.col("id") % 401 == 0, "GPCHC").otherwise("GPCHCX").alias("protocol"),
        F.when(F.col("id") % 53 == 0, 0).otherwise(4).alias("fix_mode"), F.lit(2).alias("nav_mode"), (state * 8 + (F.col("id") % 5) / 10).alias("speed"),
        (F.lit(31.2) + F.col("id") * 1e-5 + F.when(F.col("id") % 611 == 0, 0.05).otherwise(0.0)).alias("lat"), F.lit(121.6).alias("lon"),
        (1.0 + 0.05 * state).alias("ax"), F.lit(0.0).alias("ay"), F.lit(0.0).alias("az"), F.lit(0).alias("warning"))
    again = rows.where("t_ms % 49 = 0").withColumn("protocol", F.lit("GPCHC"))
    return _view(rows.unionByName(again).dropDuplicates(["device_id", "t_ms", "protocol"]))


def test_segments_and_track_of_a_range_come_from_its_buckets(spark):
    """Head and tail from rows and 600 s buckets between: as from the rows of the range."""
    from wayline.operators import motion, paths

    view = _track_view(spark).persist()
    lo, hi = view.agg(F.min("t_ms"), F.max("t_ms")).first()
    lo, hi = lo + 333_300, hi - 222_200
    whole = paths.path_rerollup(paths.path_rollup(view, 60, ["speed"]), 600, ["speed"])
    a, b = -(-lo // 600_000) * 600_000, (hi + 1) // 600_000 * 600_000
    edges = paths.path_rollup(view.where(F.col("t_ms").between(lo, a - 1) | F.col("t_ms").between(b, hi)), 60, ["speed"])
    buckets = whole.where(F.col("bucket_ms").between(a, b - 1)).unionByName(edges, allowMissingColumns=True)
    rows = view.where(F.col("t_ms").between(lo, hi))
    key = lambda r: (r["segment"], r["motion_state"], r["start_ms"], r["end_ms"], round(r["distance_m"], 6), round(r["max_kmh"], 6) if r["max_kmh"] is not None else None, r["samples"])
    got, want = ({key(r) for r in f.collect()} for f in (paths.segments_from(buckets), motion.motion_segments(rows)))
    assert got == want and len(want) > 20
    points = lambda f: sorted((r["t_ms"], r["break_before"], round(r["lat"], 9)) for r in f.select("t_ms", "break_before", "lat").collect())
    assert points(paths.track_from(buckets)) == points(motion.track(rows))
    view.unpersist()


def test_backfill_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    from wayline.operators import quality
    from wayline.operators.lifecycle import backfill
    from wayline.streaming import backfill as steps

    hour = 3_600_000
    rows = spark.createDataFrame([(d, 1_704_067_200_000 + h * hour + 1000 * k, "GPCHCX", float(k)) for d in "AB" for h in range(4) for k in range(10)], "device_id string, t_ms bigint, protocol string, speed double")
    points = quality.complete(rows.withColumns({"fix_mode": F.lit(4), "nav_mode": F.lit(2)}))
    have = quality.assess(points.where("device_id = 'A' AND t_ms % 2000 = 0")).withColumn("version", F.when(F.col("t_ms") % 3000 == 0, 9).otherwise(10))
    have = have.select(*have.columns).persist()
    whole = steps.backfill_step
    made = []

    def breaks(points, quality_, hours, *more):
        made.append(1)
        if len(made) == 3:
            raise OSError("gone")
        return whole(points, quality_, hours, *more)

    monkeypatch.setattr(steps, "backfill_step", breaks)
    with pytest.raises(OSError, match="gone"):
        steps.run_backfill(points, have, 10, quality.assess, str(tmp_path / "b"), size=12)
    full = steps.run_backfill(points, have, 10, quality.assess, str(tmp_path / "b"), size=12)
    keys = lambda f: sorted((r["device_id"], r["t_ms"], r["mask"], r["reasons"], r["version"]) for r in f.collect())
    assert keys(full) == keys(backfill(points, have, 10, quality.assess)) and len(keys(full)) == 80
    assert len(made) == 1 + Ledger(spark, str(tmp_path / "b")).state()["totals"]["steps"]


def test_a_changed_row_is_named_by_its_hour(spark):
    from wayline.operators import audit

    rows = spark.createDataFrame([(d, h * 3_600_000 + k, float(k)) for d in "ABC" for h in range(3) for k in range(5)] + [(None, 5, 1.0)], "device_id string, t_ms bigint, v double")
    tree = audit.digest_tree(rows)
    assert audit.tree_differences(tree, audit.digest_tree(rows.repartition(3))).count() == 0
    changed = rows.where("NOT (device_id = 'A' AND t_ms = 2)").withColumn("v", F.when((F.col("device_id") == "C") & (F.col("t_ms") == 7_200_001), -1.0).otherwise(F.col("v"))).unionByName(spark.createDataFrame([("D", 1, 1.0)], rows.schema))
    found = audit.tree_differences(tree, audit.digest_tree(changed)).collect()
    assert sorted(map(tuple, found)) == [("A", 0, 5, 4), ("C", 2, 5, 5), ("D", 0, 0, 1)]
    root = tree.where("level = 0").first()
    assert root["rows"] == 46 and sum(int(r["digest"]) for r in tree.where("level = 2").collect()) == int(root["digest"])


def test_detector_keeps_late_rows_and_tells_what_is_over(spark, tmp_path):
    from wayline.functions.constants import RULES
    from wayline.streaming import episodes

    fast, slow = (RULES["speed_kmh"] + 10) / 3.6, 1.0
    cols = "device_id string, at timestamp, t_ms bigint, protocol string, speed double, roll double, pitch double, shock double"
    row = lambda t, v: ("A", None, t, "GPCHCX", v, 0.0, 0.0, 0.0)

    def send(version, *rows):
        spark.createDataFrame(list(rows), cols).withColumn("at", F.timestamp_millis("t_ms")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = episodes.stream_all_episodes(stream, version=version, hold_ms=20_000)

        def keep(batch, batch_id):
            batch.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={batch_id}"))

        out.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        told = spark.read.parquet(str(tmp_path / "out")).where("kind = 'overspeed'").collect()
        last = {}
        for r in sorted(told, key=lambda r: (r["batch"], r["state"] == "closed")):
            last[r["start_ms"]] = (r["end_ms"], r["samples"], r["state"])
        return {k: v for k, v in last.items() if v[2] != "gone"}

    base = 1_704_067_200_000
    at = lambda *ks: [row(base + 100 * k, fast) for k in ks]
    assert send(1, *at(0, 1, 2, 40, 41)) == {base: (base + 200, 3, "open"), base + 4000: (base + 4100, 2, "open")}
    # Late rows join two episodes; a late one without the signal parts what was one.
    joined = send(1, *at(20))
    assert {k: v[:2] for k, v in joined.items()} == {base: (base + 4100, 6)}
    parted = send(1, row(base + 3000, slow))
    assert {k: v[:2] for k, v in parted.items()} == {base: (base + 2000, 4), base + 4000: (base + 4100, 2)}
    # New rules begin anew.
    again = send(2, *at(42, 43))
    assert again[base + 4200][:2] == (base + 4300, 2)
    # When time has gone on, what is over is told so.
    over = send(2, row(base + 100_000, slow))
    over = send(2, row(base + 200_000, slow))
    assert over[base + 4200] == (base + 4300, 2, "closed")


def test_small_files_share_a_task(tmp_path):
    from wayline.sources.logs import LogReader

    for k in range(20):
        (tmp_path / f"{k:02d}.log").write_bytes(b"x" * 99 + b"\n")
    reader = LogReader(Folder(str(tmp_path), step=500))
    parts = reader.partitions()
    assert len(parts) == 4 and sorted(r[0] for p in parts for r in reader.read(p)) == [f"{k:02d}.log" for k in range(20)]


def test_a_backfill_step_reads_its_own_rows(spark, tmp_path, monkeypatch):
    from wayline.streaming import backfill as steps

    points = spark.range(0, 60).selectExpr("'A' AS device_id", "id * 360000 AS t_ms", "'GPCHCX' AS protocol")
    have = points.where("t_ms < 0").withColumn("version", F.lit(1))
    seen = []

    def step(near, have_, hours, version, assess):
        seen.append((near.count(), len(near.inputFiles()) > 0))
        return near.join(hours, (near["t_ms"] / 3_600_000).cast("bigint") == hours["_hour"]).select(near["*"], F.lit(version).alias("version"))

    monkeypatch.setattr(steps, "backfill_step", step)
    assert steps.run_backfill(points, have, 1, None, str(tmp_path / "b"), size=10).count() == 60
    assert seen == [(10, True)] + [(20, True)] * 5  # an hour and the one before


def _hours_of(spark, counts):
    """Points of devices: so many in each of their hours, by their number."""
    rows = [(d, h * 3_600_000 + k, "GPCHCX") for d, hours in counts.items() for h, n in enumerate(hours) for k in range(n)]
    return spark.createDataFrame(rows, "device_id string, t_ms bigint, protocol string")


def test_backfill_steps_have_no_gaps_and_no_empty_ones(spark):
    from wayline.operators.lifecycle import backfill_plan

    points = _hours_of(spark, {"A": [50, 3, 40], "B": [2, 2, 2], "C": [1], "D": [25, 0, 1, 12, 4]})
    have = points.where("t_ms < 0").withColumn("version", F.lit(1))
    plan = {(r["device_id"], r["_hour"]): (r["missing"], r["step"]) for r in backfill_plan(points, have, 1, 10).collect()}
    # In order: 50 | 3 40 (begun at 50 and 53) | 2 2 2 1 (93 to 99) | 25 (100) | 1 (125) 12 (126) | 4 (138).
    assert plan == {
        ("A", 0): (50, 1), ("A", 1): (3, 2), ("A", 2): (40, 2), ("B", 0): (2, 3), ("B", 1): (2, 3), ("B", 2): (2, 3), ("C", 0): (1, 3),
        ("D", 0): (25, 4), ("D", 2): (1, 5), ("D", 3): (12, 5), ("D", 4): (4, 6)}


def test_a_backfill_of_many_steps_runs_as_few_jobs(spark, tmp_path, monkeypatch):
    """Jobs have several steps; a run may stop or break within them, and looks back over the hour before each."""
    from pyspark.sql import Window

    from wayline.operators.lifecycle import backfill
    from wayline.streaming import backfill as steps

    points = _hours_of(spark, {"A": [9] * 11, "B": [9] * 12})
    have = points.where("t_ms % 3 = 0").select("*", F.lit(0).cast("bigint").alias("back_ms"), F.lit(1).alias("version"))
    assess = lambda p: p.withColumn("back_ms", F.col("t_ms") - F.lag("t_ms").over(Window.partitionBy("device_id").orderBy("t_ms")))
    whole, made = steps.backfill_step, []

    def breaks(near, have_, hours, *more):
        made.append((hours.count(), near.count(), near.distinct().count()))
        if len(made) == 4:
            raise OSError("gone")
        return whole(near, have_, hours, *more)

    monkeypatch.setattr(steps, "backfill_step", breaks)
    monkeypatch.setattr(steps, "JOBS", 5)
    run = lambda **more: steps.run_backfill(points, have, 1, assess, str(tmp_path / "b"), size=6, **more)
    assert run(steps=2).count() == 23 * 3 + 2 * 6  # 2 of the 5 steps of the first job
    assert run(steps=0).count() == 23 * 3 + 2 * 6
    with pytest.raises(OSError, match="gone"):
        run()  # the rest of the first job, the second, and the third breaks
    monkeypatch.setattr(steps, "JOBS", 23)  # a run that goes on keeps to what was laid out
    full = run()
    assert [m[0] for m in made] == [2, 3, 5, 5, 5, 5, 3] and all(n == d <= 7 * 9 for _, n, d in made)
    rows = lambda f: sorted((r["device_id"], r["t_ms"], r["back_ms"], r["version"]) for r in f.collect() if r["t_ms"] % 3)
    assert rows(full) == rows(backfill(points, have, 1, assess)) and full.count() == 23 * 9
    assert run().count() == 23 * 9 and len(made) == 7


def test_detector_parts_meet_at_full_hours(spark, tmp_path):
    """State is an hour's, so that a device's rows are not those of one task; an episode over a full hour is whole again, also when a late row parts or joins it."""
    from wayline.functions.constants import RULES
    from wayline.streaming import episodes

    fast, slow = (RULES["speed_kmh"] + 10) / 3.6, 1.0
    cols = "device_id string, at timestamp, t_ms bigint, protocol string, speed double, roll double, pitch double, shock double"
    hour = 1_704_067_200_000 + 3_600_000
    row = lambda t, v=fast: ("A", None, hour + t, "GPCHCX", v, 0.0, 0.0, 0.0)

    def send(*rows):
        spark.createDataFrame(list(rows), cols).withColumn("at", F.timestamp_millis("t_ms")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = episodes.stream_all_episodes(spark.readStream.schema(cols).parquet(str(tmp_path / "in")), hold_ms=20_000)

        def keep(batch, batch_id):
            batch.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={batch_id}"))

        out.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        told = spark.read.parquet(str(tmp_path / "out")).where("state <> 'late'")
        last = told.groupBy("device_id", "kind", "start_ms").agg(F.max_by(F.struct("end_ms", "peak", "peak_ms", "samples", "joined", "version", "state"), F.struct("batch", F.col("state") == "closed")).alias("e"))
        last = last.where("e.state <> 'gone' AND kind = 'overspeed'").select("device_id", "kind", "start_ms", "e.*")
        parts = {r["start_ms"] - hour: r["state"] for r in last.collect()}
        return {r["start_ms"] - hour: (r["end_ms"] - hour, r["samples"], round(r["peak"], 3), r["peak_ms"] - hour) for r in episodes.whole_episodes(last).collect()}, parts

    peak = round(fast * 3.6, 3)
    whole, parts = send(row(-200), row(-100), row(0), row(100, fast + 1), row(8000))
    assert whole == {-200: (100, 4, round(peak + 3.6, 3), 100), 8000: (8000, 1, peak, 8000)} and set(parts) == {-200, 0, 8000}
    whole, _ = send(row(-50, slow))  # a late row of the hour before parts it
    assert whole == {-200: (-100, 2, peak, -200), 0: (100, 2, round(peak + 3.6, 3), 100), 8000: (8000, 1, peak, 8000)}
    whole, _ = send(row(-20), row(2500))  # and one joins it again; what comes after goes on
    assert whole == {-200: (-100, 2, peak, -200), -20: (2500, 4, round(peak + 3.6, 3), 100), 8000: (8000, 1, peak, 8000)}
    # When time has gone on by hours, all is told over and an old row changes nothing.
    send(row(3 * 3_600_000, slow))
    again, parts = send(row(3 * 3_600_000 + 60_000, slow))
    assert again == whole and set(parts.values()) == {"closed"}
    again, _ = send(row(-10))
    assert again == whole


def test_a_part_of_a_stream_lands_by_many_tasks(spark, monkeypatch):
    from wayline.plans import streams

    seen = []
    landed = lambda folder: spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/landed").inputFiles()
    monkeypatch.setattr(streams, "run_rollups", lambda rows, folder, *more: seen.append(len(landed(folder))))
    folder = streams._run_late(spark, "/root/testdata/sf0.001")
    tasks = spark.sparkContext.defaultParallelism
    assert tasks > 1 and seen == [tasks, 2 * tasks, 3 * tasks]
    counts = []
    query = streams._landed(spark, folder).writeStream.foreachBatch(lambda b, n: counts.append(b.count())).option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(counts) == 1 and counts[0] > spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()  # one batch, with the repeats
