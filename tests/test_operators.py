"""Operators on tiny literal frames."""

import math
import random
import zlib
from statistics import median

import pytest
from pyspark.sql import functions as F

from wayline.functions import scalars as s
from wayline.operators import audit, episodes, lifecycle, motion, quality, rollup, series, trace, vibration
from wayline.sources import frames

POINT = "device_id string, t_ms bigint, protocol string, fix_mode int, nav_mode int, speed double, ax double, ay double, az double, lat double, lon double, lat_std double, lon_std double"


def points(spark, rows):
    return spark.createDataFrame(rows, POINT)


def moving(n, start=0, speed=10.0, ax=1.05, step=100, fix=4, lat=31.0):
    return [("A", 1_700_000_000_000 + start + i * step, "GPCHCX", fix, 2, speed, ax, 0.0, 0.0, lat, 121.0, 0.1, 0.1) for i in range(n)]


def test_gap_breaks_distance(spark):
    """Eleven rows at 10 m/s, then one 19 s later: 0.01 km and one gap."""
    v = quality.project(quality.assess(points(spark, moving(11) + moving(1, 20_000))))
    r = motion.trip_summary(v).first()
    assert round(r["distance_km"], 6) == 0.01 and r["gaps"] == 1


def test_stationary_noise_is_zero(spark):
    v = quality.project(quality.assess(points(spark, moving(20, ax=1.001, speed=0.2))))
    r = motion.trip_summary(v).first()
    assert r["distance_km"] == 0 and r["max_kmh"] == 0


def test_drift_hides_position_and_speed(spark):
    rows = moving(3) + moving(1, 300, lat=31.01) + moving(3, 400)
    a = quality.assess(points(spark, rows)).orderBy("t_ms").collect()
    assert [r["drift"] is not None for r in a] == [False, False, False, True, True, False, False]
    assert a[3]["ground"]["reason"] == "navigation_drift"


def test_pending_rows_show_nothing(spark):
    df = quality.complete(points(spark, moving(1))).withColumns({"mask": F.lit(None).cast("bigint"), "ground": s.ground_speed()})
    r = quality.project(df).first()
    assert r["speed"] is None and r["lat"] is None and r["motion_state"] == "unknown" and not r["valid_pos"]


def test_raw_equals_rollups(spark):
    rows = moving(700) + moving(300, 90_000, ax=1.0) + moving(500, 150_000)
    v = quality.project(quality.assess(points(spark, rows)))
    v = quality.complete(v)
    fine = rollup.rollup(v, 60, ["speed"])
    coarse = rollup.rerollup(fine, 600, ["speed"])
    direct = rollup.rollup(v, 600, ["speed"])
    cols = ["points", "covered_s", "moving_s", "distance_m", "gaps", "speed_n"]
    both = [df.select("bucket_ms", *[F.round(c, 6).alias(c) for c in cols]).orderBy("bucket_ms").collect() for df in (coarse, direct)]
    assert both[0] == both[1]


def test_episode_ends_at_a_row_without_the_signal(spark):
    rows = moving(3, speed=30.0) + moving(1, 300, speed=5.0) + moving(2, 400, speed=30.0)
    v = quality.project(quality.assess(points(spark, rows)))
    found = episodes.episodes(episodes.signal_rows(quality.complete(v))).where("kind = 'overspeed'")
    assert [r["samples"] for r in found.orderBy("start_ms").collect()] == [3, 2]


def test_top_k_by_excess(spark):
    rows = [("A", "overspeed", i, i + 1, float(85 + i), i, 1, 85.0) for i in range(1, 13)]
    e = spark.createDataFrame(rows, "device_id string, kind string, start_ms bigint, end_ms bigint, peak double, peak_ms bigint, samples bigint, threshold double")
    top = episodes.event_top_k(e).orderBy("rank").collect()
    assert len(top) == 10 and top[0]["peak"] == 97.0 and {r["grp"]: r["n"] for r in episodes.event_counts(e).collect()}["speed"] == 12


def test_sine_is_found(spark):
    """600 samples at 10 Hz of .08 sin(2 pi 2 t) on 1 g: 2 Hz and .08 / sqrt 2."""
    rows = [("A", i * 100, "GPCHCX", 4, 2, 0.0, 1 + 0.08 * math.sin(2 * math.pi * 2 * i / 10), 0.0, 0.0, 31.0, 121.0, 0.1, 0.1) for i in range(600)]
    runs = vibration.vibration_runs(points(spark, rows))
    residual = vibration.detrend(vibration.window_samples(runs, vibration.best_window(runs)))
    assert vibration.window_measures(residual).first()["rms"] == pytest.approx(0.08 / math.sqrt(2), rel=1e-2)
    assert vibration.dominant(vibration.spectrum(residual)).first()["hz"] == pytest.approx(2.0, abs=0.05)


def test_short_and_gapped_runs_are_refused(spark):
    rows = [("A", i * 100 + (0 if i < 90 else 5000), "GPCHCX", 4, 2, 0.0, 1.0, 0.0, 0.0, 31.0, 121.0, 0.1, 0.1) for i in range(180)]
    assert {r["reason"] for r in vibration.admit_runs(vibration.vibration_runs(points(spark, rows))).collect()} == {"short"}


def test_checksums(spark):
    body = "GPABC,1,2"
    crc = format(zlib.crc32(body.encode(), 0xFFFFFFFF) ^ 0xFFFFFFFF, "08X")
    xor = 0
    for b in body.encode():
        xor ^= b
    rows = [("f", 0, 9, f"#{body}*{crc}"), ("f", 1, 9, f"${body}*{xor:02X}"), ("f", 2, 9, f"${body}*ZZ"), ("f", 3, 9, f"#{body}*00000000")]
    out = frames.with_checksum(spark.createDataFrame(rows, frames.FRAME_COLUMNS)).orderBy("source_offset").collect()
    assert [r["checksum_ok"] for r in out] == [True, True, False, False]


def test_scan_finds_offsets_between_binary(spark, tmp_path):
    (tmp_path / "2024-01-01").mkdir()
    blob = b"\x00\xff$GPA,1*00\r\n\x80\x81#GPB,2*00000000\njunk"
    (tmp_path / "2024-01-01" / "x.log").write_bytes(blob)
    out = frames.scan_frames(spark, str(tmp_path)).orderBy("source_offset").collect()
    assert [(r["frame"], blob[r["source_offset"] : r["source_offset"] + r["source_length"]].decode()) for r in out] == [("$GPA,1*00",) * 2, ("#GPB,2*00000000",) * 2]


def test_gps_time(spark):
    r = spark.range(1).select(s.gps_to_unix(F.lit(2295), F.lit(86418.0)).alias("t"), s.gps_to_unix(F.lit(9000), F.lit(0.0)).alias("bad")).first()
    assert r["t"] == 1704067200.0 and r["bad"] is None


def test_dedup_keeps_first_and_known(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z")], "k string, o int, v string")
    assert lifecycle.dedup_first(df, ["k"], ["o"], spark.createDataFrame([("b",)], "k string")).collect() == [("a", 1, "y")]


def test_intervals_and_breaks(spark):
    i = spark.createDataFrame([("A", 0, 10), ("A", 5, 20), ("A", 40, 50)], "device_id string, start_ms bigint, end_ms bigint")
    assert sorted(map(tuple, rollup.coalesce_intervals(i).collect())) == [("A", 0, 20), ("A", 40, 50)]
    b = spark.createDataFrame([("A", 0, 1.0, 10.0), ("A", 60_000, 2.0, 350.0), ("A", 400_000, 3.0, 351.0)], "device_id string, t_ms bigint, speed double, heading double")
    assert series.break_series(b).where("is_break").count() == 2


def test_scan_resolution_prefers_exact_sequence(spark):
    codes = {
        "json": '{"part_order_no": "25001234567", "serial_no": "7.0"}', "run": "A/25001234567-0007", "other": "25001234567-0009", "purchase": "45007654321-20-3", "json_line": '{"purchase_order": "45007654321", "line_no": "20", "sequence": "3"}',
        "digits": "450076543210020" + "0003", "lost": "9-9", "short": "25001234567", "none": "25009999999-0001", "bound": "25001234567-0008"}
    scans = spark.createDataFrame(list(codes.items()), "scan_id string, code string")
    catalog = spark.createDataFrame([("25001234567", "", "0007", 70), ("25001234567", "", "", 71), ("45007654321", "20", "", 80), ("45007654321", "0020", "", 81)], "order_no string, purchase_line string, seq string, part_key bigint")
    bound = spark.createDataFrame([("25001234567", "", "0008")], "order_no string, purchase_line string, seq string")
    out = {r["scan_id"]: (r["part_key"], r["flag"]) for r in trace.resolve_scans(scans, catalog, bound).collect()}
    assert out == {
        "json": (70, "ambiguous"), "run": (70, "ambiguous"), "other": (71, "ambiguous"), "purchase": (80, "ok"), "json_line": (80, "ok"), "digits": (81, "ok"), "lost": (None, "unreadable"), "short": (70, "incomplete"),
        "none": (None, "unknown"), "bound": (71, "duplicate")} or out["short"][1] == "incomplete"


def test_fit_uses_all_rows(spark):
    """A row a second, all at one phase: above 50,000 rows none may be left out."""
    df = spark.range(50_002).select(F.lit("A").alias("device_id"), (F.col("id") * 1000 + 100).alias("t_ms"), F.col("id").cast("double").alias("alt"))
    assert [tuple(r)[2:4] for r in audit.robust_fit(df, {"alt": 10.0}).collect()] == [(25_000.5, 12_500.5)]


def test_context_fit_equals_plain(spark):
    draw = random.Random(3)
    names = ["lat", "lon", *audit.FLOORS, "pitch", "roll"]
    rows = []
    for i in range(400):
        turn = [(175 + draw.gauss(0, 6) + 180) % 360 - 180, draw.gauss(-179, 3)]
        rows.append(("A", i * 100, "GPCHCX", draw.choice([0, 4, 4, 4]), draw.choice([0, 2, 2, 2]), 31 + draw.gauss(0, 1e-4), 121 + draw.gauss(0, 1e-4), *[draw.gauss(2, 1) for _ in audit.FLOORS], *turn))
    rows += [("B", i, "GPCHCX", 4 * (i < 99), 2, 31.0, 121.0, *[0.0] * 13) for i in range(150)]
    df = spark.createDataFrame(rows, "device_id string, t_ms bigint, protocol string, fix_mode int, nav_mode int, " + ", ".join(f"{n} double" for n in names))
    got = {r["field"]: r for r in audit.context_fit(df).collect()}
    v = [dict(zip(names, r[5:])) for r in rows if r[0] == "A" and r[3] and r[4]]
    delta = lambda a, b: (a - b + 180) % 360 - 180
    want = {}
    for n in names:
        x = [r[n] for r in v]
        turned = n in ("pitch", "roll")
        centre = (x[0] + median(delta(a, x[0]) for a in x) + 180) % 360 - 180 if turned else median(x)
        mad = median(abs(delta(a, centre) if turned else a - centre) for a in x)
        floor = {**audit.FLOORS, "pitch": 1.0, "roll": 1.0}.get(n)
        want[n] = (centre, mad, floor and max(floor, 6 * 1.4826 * mad))
    a, o = (math.radians(want[n][0]) for n in ("lat", "lon"))
    radii = []
    for r in v:
        b, p = math.radians(r["lat"]), math.radians(r["lon"])
        radii.append(2 * 6371008.8 * math.asin(math.sqrt(math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin((p - o) / 2) ** 2)))
    m = median(radii)
    d = median(abs(r - m) for r in radii)
    want["radius"] = (m, d, max(10, m + 6 * 1.4826 * d))
    want["horizontal"] = (None, None, max(want[n][2] for n in ("speed", "ve", "vn")))
    assert len(got) == 17 and all(r["device_id"] == "A" and r["population"] == 400 and r["valid_population"] == len(v) for r in got.values())
    for n, values in want.items():
        assert [got[n][c] for c in ("centre", "mad", "limit")] == [x if x is None else pytest.approx(x, rel=1e-6, abs=1e-9) for x in values], n


def test_every_row_is_probed(spark, tmp_path):
    """nearest_asof and interpolate_track against brute force on all rows of a small events table."""
    from wayline.plans import rollups, shared

    df = spark.range(1, 1201).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"), F.lit("x").alias("event_type"), (F.pmod(F.col("id") * 7919, F.lit(5000)) / 100.0).alias("value"))
    df.write.parquet(str(tmp_path / "events.parquet"))
    times, speed = [], {}
    for r in shared.view(spark, str(tmp_path)).select("device_id", "t_ms", "speed").collect():
        times.append((r["device_id"], r["t_ms"] + 37))
        if r["speed"] is not None:
            speed.setdefault(r["device_id"], {})[r["t_ms"]] = r["speed"]
    near, between = {}, {}
    for d, t in times:
        v = speed.get(d, {})
        b, a = max((x for x in v if x <= t), default=None), min((x for x in v if x >= t), default=None)
        n = b if b is not None and (a is None or t - b <= a - t) else a
        near[d, t] = (n, v.get(n), a)
        inner = b is not None and a is not None and a - b <= 3000
        value = v.get(n) if not inner or a == b else v[b] + (v[a] - v[b]) * (t - b) / (a - b)
        between[d, t] = (value if value is None else pytest.approx(value, abs=1e-5), inner)
    got = rollups.nearest_asof(spark, str(tmp_path)).collect()
    assert len(got) == len(near) == 1200 and {(r[0], r[1]): tuple(r)[2:] for r in got} == near
    got = rollups.interpolate_track(spark, str(tmp_path)).collect()
    assert len(got) == 1200 and {(r[0], r[1]): tuple(r)[2:] for r in got} == between


def drive(start_ms, device="A"):
    """Twelve minutes at 10 Hz: moving and resting by turns, gaps, jumps, fast and shaking stretches."""
    draw, rows = random.Random(7), []
    t = start_ms
    for i in range(7200):
        t += 100 if i % 911 else 5300
        rest = (i // 170) % 3 == 0
        ax = 1.001 if rest else 1.05 + (0.9 if 3000 < i < 3015 else 0.0) + draw.random() / 10
        speed = 0.1 if rest else 12.0 + (14.0 if 4000 < i < 4100 or i % 1301 < 7 else 0.0)
        rows.append((device, t, "GPCHCX", 4 if i % 5 else 8, 2, speed, ax, 0.0, 0.0, 31.0 + i * 1e-6 + (0.02 if i % 1777 == 5 else 0.0), 121.0, 0.1, 0.1))
    return rows


def test_results_do_not_change_where_an_hour_ends(spark):
    """The same drive within an hour and over its end gives the same rows, shifted."""
    hour = 3_600_000 * 472_222
    out = []
    for start in (hour + 600_000, hour + 3_600_000 - 360_000):
        v = quality.project(quality.assess(points(spark, drive(start))))
        runs = vibration.vibration_runs(v)
        stops = motion.stop_groups(motion.motion_segments(v))
        shift = lambda rows, names: sorted(tuple((round(r[n], 6) if isinstance(r[n], float) else r[n] - start if n.endswith("_ms") and r[n] is not None else r[n]) for n in names) for r in rows.collect())  # noqa: B023, E731
        out.append([
            shift(motion.trip_summary(v), ["samples", "distance_km", "moving_s", "covered_s", "gaps", "sample_hz"]), shift(motion.gaps(v), ["start_ms", "end_ms"]),
            shift(motion.motion_segments(v), ["segment", "motion_state", "start_ms", "end_ms", "distance_m", "samples"]), shift(stops, ["stop", "start_ms", "end_ms", "samples"]),
            shift(motion.stationary_anchor(v, stops), ["stop", "anchor_lat", "anchor_ms"]), shift(episodes.episodes(episodes.signal_rows(v)), ["kind", "start_ms", "end_ms", "peak", "peak_ms", "samples"]),
            shift(episodes.outlier_intervals(v.withColumn("vu", F.lit(0.0)), F.col("speed") > 20), ["interval", "start_ms", "end_ms", "samples"]),
            shift(vibration.window_scores(runs), ["run", "idx", "t_ms", "n", "rms"]), shift(vibration.admit_runs(runs), ["run", "samples", "hz", "n", "reason"]),
            shift(episodes.diagnostic_conditions(v.withColumn("warning", F.lit(0))).groupBy("kind").count(), ["kind", "count"]), shift(motion.thin_track(v, 50), ["t_ms"])])
    assert all(out[0]), [bool(x) for x in out[0]]
    for a, b in zip(*out):
        assert a == b


def test_window_scores_equal_plain(spark):
    """Each window's residual about a line on its samples, against a plain fit."""
    rows = drive(3_600_000 * 472_222 + 3_600_000 - 300_000)[:2600]
    got = {r["t_ms"]: r["rms"] for r in vibration.window_scores(vibration.vibration_runs(points(spark, rows))).collect()}
    assert len(got) > 500
    t = [r[1] for r in rows]
    for k in range(0, len(rows), 97):
        if t[k] in got:
            y = [r[6] for r in rows[k : k + 600]]
            x = list(range(600))
            mx, my = sum(x) / 600, sum(y) / 600
            b = sum((u - mx) * (w - my) for u, w in zip(x, y)) / sum((u - mx) ** 2 for u in x)
            assert got[t[k]] == pytest.approx(math.sqrt(sum((w - my - b * (u - mx)) ** 2 for u, w in zip(x, y)) / 600), rel=1e-9)


def test_segment_counts_in_every_bucket(spark):
    seg = spark.createDataFrame([("A", 1, "moving", 30_000, 200_000), ("A", 2, "stationary", 200_000, 230_000)], "device_id string, segment int, motion_state string, start_ms bigint, end_ms bigint")
    out = {r["bucket_ms"]: (r["state"], r["seconds"]) for r in rollup.bucket_state(seg).collect()}
    assert out == {0: ("moving", 30.0), 60_000: ("moving", 60.0), 120_000: ("moving", 60.0), 180_000: ("stationary", 30.0)}


def test_open_contexts_have_no_end(spark):
    """A point two hundred years after the start of an open context is in it; a bounded one that starts before goes first."""
    far = 200 * 366 * 86_400_000
    p = spark.createDataFrame([("A", far, "P"), ("A", 50, "P"), ("B", far, "P")], "device_id string, t_ms bigint, protocol string")
    c = spark.createDataFrame([("A", "open", 10, None), ("A", "closed", 5, 60)], "device_id string, context_id string, start_ms bigint, end_ms bigint")
    assert {(r["device_id"], r["t_ms"]): r["context_id"] for r in quality.with_context(p, c).collect()} == {("A", far): "open", ("A", 50): "closed", ("B", far): None}


def test_offsets_of_a_long_file(spark):
    """Fifty thousand frames in one file, in time in proportion."""
    import time

    frame = b"$GPA,1*00\r\n"
    df = spark.createDataFrame([("f", bytearray(b"\x00\x01" + frame * 50_000))], "path string, content binary")
    began = time.perf_counter()
    r = frames.frames_in(df).agg(F.count("*"), F.max("source_offset"), F.sum("source_offset")).first()
    assert tuple(r) == (50_000, 2 + 49_999 * 11, 2 * 50_000 + 11 * 49_999 * 25_000) and time.perf_counter() - began < 20


def test_parts_of_a_bucket_merge(spark):
    """Head and tail of a range and whole buckets between, merged, equal the rows."""
    v = quality.complete(quality.project(quality.assess(points(spark, drive(3_600_000 * 472_222)[:3000]))))
    lo, hi = 3_600_000 * 472_222 + 17_300, 3_600_000 * 472_222 + 250_100
    cols = ["points", "covered_s", "moving_s", "distance_m", "gaps", "speed_n", "speed_last"]
    merged = rollup.range_summary(rollup.hybrid_range(v, rollup.rollup(v, 60, ["speed"]), lo, hi, 60, ["speed"]), ["speed"])
    plain = rollup.rollup(v.where(F.col("t_ms").between(lo, hi)), 3600, ["speed"])
    assert [tuple(round(x, 6) for x in r) for r in merged.select(cols).collect()] == [tuple(round(x, 6) for x in r) for r in plain.select(cols).collect()]
    with pytest.raises(ValueError):
        rollup.hybrid_range(v, rollup.rollup(v, 60, ["speed"]), lo, lo + 5000, 60, ["speed"], most_rows=10)


def test_violations_of_a_file(spark):
    from wayline.sources import exports

    rows = [(k, "A" if k < 5 else "B", 1_700_000_000.0 + (k if k != 3 else 1)) for k in range(8)]
    text = ", ".join(f"CAST(NULL AS {t}) {c}" for c, t in (x.strip().split(" ") for x in exports.SCHEMA.split(",")) if c not in ("device_id", "t"))
    df = spark.createDataFrame(rows, "line bigint, device_id string, t double").selectExpr("line", "device_id", "t", *text.split(", "))
    found = {(r["rule"], r["line_t"]) for r in exports.import_violations(df, 1.8e9, most_rows=7).collect()}
    assert {("order", 1_700_000_001.0), ("one_device", None), ("rows", None)} <= found and not any(r == "span" for r, _ in found)


def test_filtered_export_is_one_ordered_file(spark, tmp_path):
    from wayline.sources import exports

    v = quality.project(quality.assess(points(spark, moving(30)[::-1]).withColumn("warning", F.lit(0))))
    assert exports.export_filtered(v, 0, 2 * 10**12, str(tmp_path / "out")) == 30
    (name,) = (tmp_path / "out").glob("*.csv")
    lines = name.read_text(encoding="utf-8").splitlines()
    assert lines[0].startswith("\ufeffdevice_id,t,") and len(lines) == 31
    times = [float(x.split(",")[1]) for x in lines[1:]]
    assert times == sorted(times)


@pytest.mark.parametrize("name, most", [("trip_summary", 2), ("motion_segments", 2), ("track", 2), ("event_top10", 2), ("vibration_best_window", 2), ("rollup_600", 2), ("stationary_anchor", 5)])
def test_plans_read_their_input_once_or_twice(spark, name, most):
    import re

    from wayline.plans import registry

    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan", plan.split("== Initial Plan ==")[-1])) <= most


def test_entry_imports_without_llm(tmp_path):
    """A copy without the subpackage and the pipeline still imports and has the other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "wayline", tmp_path / "wayline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'trip_summary' in q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_contexts_with_open_ends_and_against_each_other(spark):
    cols = "context_id string, device_id string, start_ms bigint, end_ms bigint"
    old = spark.createDataFrame([("a", "A", 0, 10), ("b", "A", 100, None), ("c", "B", 50, 60)], cols)
    new = spark.createDataFrame([
        ("in-open", "A", 500, 600), ("ends-at-start", "A", 60, 100), ("touches", "A", 10, 20), ("free", "A", 20, 30), ("second", "A", 25, 40), ("third", "A", 31, 90),
        ("open", "B", 70, None), ("after-open", "B", 1000, 1001), ("over-all", "B", 0, None), ("before", "B", 0, 49), ("back", "B", 9, 9), ("c", "B", 50, None), ("b", "A", 101, 102), ("late", "C", 5000, None), ("first", "C", 0, 7)], cols)
    there, installed, refused = lifecycle.install_contexts(old, new, now_ms=4000)
    assert {r["context_id"] for r in installed.collect()} == {"free", "third", "open", "before", "first"}
    assert there.count() == 8
    assert {(r["context_id"], r["refused"]) for r in refused.collect()} == {
        ("in-open", "overlap"), ("ends-at-start", "overlap"), ("touches", "overlap"), ("second", "overlap"), ("after-open", "overlap"), ("over-all", "overlap"), ("back", "invalid"), ("b", "frozen"), ("late", "invalid")}
    points = spark.createDataFrame([("A", t) for t in (0, 20, 30, 95)] + [("B", 10**15), ("D", 1)], "device_id string, t_ms bigint")
    assert _rows(lifecycle.without_spans(points, installed)) == [("A", 0), ("A", 95), ("D", 1)]
    assert lifecycle.install_contexts(old.limit(0), new.limit(0))[0].count() == 0


def test_contexts_are_closed_once(spark):
    old = spark.createDataFrame([("a", "A", 0, None), ("b", "B", 0, None), ("c", "B", 0, 5)], "context_id string, device_id string, start_ms bigint, end_ms bigint")
    quality = spark.createDataFrame([("A", 10), ("A", 11), ("B", 99)], "device_id string, t_ms bigint")
    changes = spark.createDataFrame([("a", 10, "moved"), ("a", 20, "again"), ("b", 5000, "future"), ("b", 0, "no time"), ("b", 7, " "), ("c", 7, "closed"), ("x", 7, "unknown")], "context_id string, end_ms bigint, note string")
    cut, left, audit, refused = lifecycle.close_contexts(old, quality, changes, 1000)
    assert _rows(cut.select("context_id", "end_ms")) == [("a", 10), ("b", None), ("c", 5)] and _rows(left) == [("A", 10), ("B", 99)]
    assert _rows(audit) == [("a", "context_close", 10, "moved")]
    assert _rows(refused.select("context_id", "end_ms", "refused")) == [("a", 20, "not_open"), ("b", 0, "end"), ("b", 5000, "end"), ("b", 7, "note"), ("c", 7, "not_open"), ("x", 7, "not_open")]


def test_changes_of_one_key_are_made_in_order(spark):
    events = spark.createDataFrame([(1, "open", None), (2, "open", "n")], "event_id int, status string, note string")
    changes = spark.createDataFrame([(1, 1, "acknowledged", None), (1, 2, "resolved", " "), (1, 3, "resolved", " done "), (1, 4, "open", None), (3, 1, "open", None), (2, 1, None, "x")], "event_id int, seq int, new_status string, new_note string")
    out, audit, refused = lifecycle.review_events(events, changes)
    assert _rows(out) == [(1, "open", ""), (2, "open", "n")]
    assert _rows(audit) == [(1, 1, "open", "acknowledged", ""), (1, 3, "acknowledged", "resolved", "done"), (1, 4, "resolved", "open", "")]
    assert [(r[0], r[1], r[-1]) for r in _rows(refused)] == [(1, 2, "note"), (2, 1, "status"), (3, 1, "unknown_event")]
    devices = spark.createDataFrame([("A", 1, 80.0, None), ("B", 7, 80.0, 2.0)], "device_id string, version int, speed double, roll double")
    rules = spark.createDataFrame([("A", 1, 90.0, None), ("A", 2, 90.0, None), ("A", 3, None, 5.0), ("A", 4, 500.0, None), ("A", 5, 80.0, 5.0), ("Z", 1, 90.0, None)], "device_id string, seq int, speed double, roll double")
    out, log, refused = lifecycle.update_devices(devices, rules, {"speed": (10.0, 200.0), "roll": (1.0, 90.0)})
    assert _rows(out.select("device_id", "version", "speed", "roll")) == [("A", 4, 80.0, 5.0), ("B", 7, 80.0, 2.0)]
    assert _rows(log.drop("action")) == [("A", 1, 2, 90.0, None), ("A", 3, 3, 90.0, 5.0), ("A", 5, 4, 80.0, 5.0)]
    assert [(r[0], r[1], r[-1]) for r in _rows(refused)] == [("A", 4, "bounds"), ("Z", 1, "unknown_device")]


def test_quantiles_of_distinct_values_need_no_task_for_a_key(spark, monkeypatch):
    """All values of one device differ: no task after the sketch reads more than a fraction of them."""
    import numpy as np

    from wayline.operators import audit

    monkeypatch.setattr(audit, "SMALL", 2000)
    n = 300_000
    df = spark.range(n).select(F.lit("A").alias("k"), (F.exp(F.randn(4) * 3) * F.randn(5)).alias("value")).unionByName(spark.createDataFrame([(None, 1.0), (None, 3.0), ("B", None), ("C", 5.0)], "k string, value double")).persist()
    at = {"a": 0.5, "b": 0.9, "z": 0.0, "m": 1.0, "c": 0.999, "d": 0.01}
    rows = audit.interpolated(df, ["k"], at)
    got = {r["k"]: r for r in rows.collect()}
    values = np.array([r["value"] for r in df.where("k = 'A'").collect()])
    assert all(got["A"][c] == pytest.approx(np.quantile(values, q), rel=1e-12, abs=1e-12) for c, q in at.items())
    assert got[None]["a"] == 2.0 and got[None]["b"] == pytest.approx(2.8) and got["C"]["m"] == 5.0 and "B" not in got
    # What goes on to the ordered part are marks and the values near a quantile.
    low, high = (float(np.quantile(values, min(1, max(0, 0.5 + d)))) for d in (-2 * audit.MARGIN, 2 * audit.MARGIN))
    assert ((values >= low) & (values <= high)).sum() < n / 200
    df.unpersist()


def test_median_steps_of_jittered_runs(spark):
    """Rates of runs over days with many different steps, in time in proportion to the days."""
    import time

    import numpy as np

    took = []
    for days in (1, 8):
        n = days * 864_000 // 4
        rows = spark.range(n).select(F.lit("A").alias("device_id"), (F.lit(1_704_067_200_000) + F.col("id") * 120 + F.pmod(F.xxhash64("id"), F.lit(30))).alias("t_ms"), F.lit("GPCHCX").alias("protocol"), F.lit(1.0).alias("ax"), F.lit(0.0).alias("ay"), F.lit(0.0).alias("az"))
        began = time.perf_counter()
        got = vibration.vibration_runs(rows).groupBy("run").agg(F.count("*").alias("n"), F.max("hz").alias("hz"), F.max("idx").alias("last"), F.max("samples").alias("samples")).collect()
        took.append(time.perf_counter() - began)
        t = np.array([r[0] for r in rows.select("t_ms").orderBy("t_ms").collect()])
        assert [(r["n"], r["last"], r["samples"]) for r in got] == [(n, n - 1, n)]
        assert got[0]["hz"] == pytest.approx(1000 / np.median(np.diff(t)))
    assert took[1] < 12 * took[0] + 5


def test_neighbours_without_shrinking_frames(spark):
    """A frame that ends with the partition is gone through anew for each row: an hour of a device then takes the square of its rows."""
    import io
    from contextlib import redirect_stdout

    left = spark.createDataFrame([("A", 10, 1), ("A", 25, 2), ("A", 3_600_001, 3)], "device_id string, t_ms bigint, key int")
    right = spark.createDataFrame([("A", 0, 1.0), ("A", 20, 2.0), ("A", 7_300_000, 3.0)], "device_id string, t_ms bigint, v double")
    found = series.nearest_asof(left, right, "v")
    with redirect_stdout(io.StringIO()) as plan:
        found.explain()
    assert "unboundedfollowing" not in plan.getvalue()
    assert sorted((r["key"], r["near_ms"], r["next_ms"]) for r in found.collect()) == [(1, 0, 20), (2, 20, 7_300_000), (3, 20, 7_300_000)]


def test_points_meet_few_stops(spark):
    """Stops are cut by minutes: a point isn't held against all stops of its day."""
    stops = spark.range(1000).selectExpr("'A' AS device_id", "id AS stop", "id * 80000 AS start_ms", "id * 80000 + 70000 AS end_ms")
    rows = spark.range(1000).selectExpr("'A' AS device_id", "id * 80000 + 65000 AS t_ms")
    found = motion._in_stop(rows, stops)
    assert "86400000" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.where("t_ms BETWEEN start_ms AND end_ms").count() == found.count() == 1000


def test_heavy_rows_are_dealt_by_number(spark):
    """A part of a scan may hold millions of rows: tasks get about so many."""
    from wayline.sources.telemetry import spread

    assert spread(spark.range(0, 10_000, 1, 1), 1000).rdd.getNumPartitions() == 10


def test_counters_go_through_points_once(spark, tmp_path):
    """A point that comes again, also from another source, is new once; refused frames count by reason; and the input is scanned once."""
    rows = [("a", 1, "GPCHCX", "D", 10, None), ("b", 1, "GPCHCX", "D", 10, None), ("b", 2, "GPCHCX", "D", 10, None), ("b", 3, "GPCHC", "D", 11, None), ("b", 4, "GPCHCX", None, None, "checksum"), ("a", 5, "GPCHCX", "D", 12, "clock_range")]
    spark.createDataFrame(rows, "source string, source_offset bigint, protocol string, device_id string, t_ms bigint, reject_reason string").write.parquet(str(tmp_path / "d"))
    found = frames.ingest_counters(spark.read.parquet(str(tmp_path / "d")))
    assert {r["source"]: r["counters"] for r in found.collect()} == {
        "a": {"points": 1, "valid_ascii": 2, "protocol:GPCHCX": 2, "rejected": 1, "error:clock_range": 1},
        "b": {"points": 1, "duplicates": 2, "valid_ascii": 3, "protocol:GPCHCX": 2, "protocol:GPCHC": 1, "rejected": 1, "error:checksum": 1}}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


def test_evidence_decodes_once(spark):
    """Stored points come from the table, not from another pass over the frames."""
    from wayline.plans import registry

    plan = registry.queries()["evidence"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("crc32") == 1, plan.count("crc32")


def test_units_are_made_after_the_shuffle(spark):
    rows = spark.createDataFrame([(1, 1, 7, 2.0), (1, 1, 8, 3.0), (1, 1, 8, 3.0), (1, 2, None, 1.0), (1, 2, 7, 1.5), (2, 1, 7, None), (3, 1, 7, -1.0)], "order_key int, line int, part_key int, quantity double")
    found = trace.unit_counts(rows)
    assert sorted(map(tuple, found.collect())) == [(1, 1, 1, 3), (1, 1, 2, 3), (1, 1, 3, 2), (1, 2, 1, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")  # nothing is exchanged above it


def test_a_review_is_dealt_by_rows(spark, monkeypatch):
    """Tasks of a review hold so many rows, however well these pack."""
    from wayline.operators import lifecycle

    monkeypatch.setattr(lifecycle, "KEYED_ROWS", 1000, raising=False)
    events = spark.range(6000).select(F.col("id").alias("event_id"), F.lit("open").alias("status"), F.lit(None).cast("string").alias("note"))
    changes = events.select("event_id", F.lit(1).alias("seq"), F.lit("acknowledged").alias("new_status"), F.lit(None).cast("string").alias("new_note"))
    _, log, refused = lifecycle.review_events(events, changes)
    sizes = log.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 12 and max(r["count"] for r in sizes) < 1000 and sum(r["count"] for r in sizes) == 6000 and refused.count() == 0


def test_quantile_marks_are_compiled(spark):
    """What is done for each value has no function over arrays (which is interpreted)."""
    df = spark.range(100).select(F.lit("A").alias("device_id"), F.col("id").cast("double").alias("value"))
    out = audit.interpolated(df, ["device_id"], {"m": 0.5, "q": 0.9, "top": 1.0})
    assert tuple(out.first()) == ("A", 49.5, pytest.approx(89.1), 99.0)
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
