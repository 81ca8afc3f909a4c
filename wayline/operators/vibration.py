"""Low-frequency vibration: runs, best window, detrended measures and spectrum."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import resultant
from .rollup import RAW_BELOW_S, coalesce_intervals
from .timeline import SLICE_MS, run_number, slice_of, sliced, with_previous, with_runs

GAP_MS, WINDOW_S, LEAST = 160, 60, 100
RATE = (8.0, 10.5)
#: No window of a run of that rate and gap is longer.
REACH_MS = round(RATE[1] * WINDOW_S + 1) * GAP_MS


def vibration_runs(points: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """device_id, run, idx, t_ms, v: samples with a resultant, one a time (the last protocol), in runs without a longer gap.

    Each row has its run's number of samples, rate hz and window length n as well. Steps are whole
    milliseconds up to the gap, so a run's median step comes from a count by step.
    """
    v = points.withColumn("v", resultant()).where("v IS NOT NULL")
    v = v.groupBy("device_id", "t_ms").agg(F.max_by("v", "protocol").alias("v"), F.max("protocol").alias("protocol"))
    v = with_previous(v, ["t_ms"], within_ms=gap_ms).withColumn("_step", F.col("t_ms") - F.col("prev.t_ms"))
    new = ~F.coalesce(F.col("_step") <= gap_ms, F.lit(False))
    v = with_runs(v.withColumn("_new", new), F.col("_new")).withColumn("_step", F.when(~F.col("_new"), F.col("_step")))
    part = ["device_id", "_slice", "_run"]
    steps = v.groupBy(*part, "_step").agg(F.count(F.lit(1)).alias("_n"))
    parts = steps.groupBy(*part).agg(F.sum("_n").alias("_n"), F.collect_list(F.when(F.col("_step").isNotNull(), F.struct("_step", "_n"))).alias("_steps"))
    # Once a run: at most gap_ms steps of each of its slices with their counts, in order; the median is read off their running sum.
    runs = parts.withColumn("run", run_number()).groupBy("device_id", "run").agg(
        F.sum("_n").alias("samples"), F.array_sort(F.flatten(F.collect_list("_steps"))).alias("_all"), F.collect_list(F.struct("_slice", "_run", "_n")).alias("_parts"))
    start = F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(None).cast("bigint").alias("low"), F.lit(None).cast("bigint").alias("high"))
    past = lambda a, x, k: a["upto"] + x["_n"] > F.floor(k / 2)
    step = lambda a, x: F.struct(
        (a["upto"] + x["_n"]).alias("upto"), F.coalesce(a["low"], F.when(past(a, x, F.col("samples") - 2), x["_step"])).alias("low"),
        F.coalesce(a["high"], F.when(past(a, x, F.col("samples") - 1), x["_step"])).alias("high"))
    runs = runs.withColumn("_middle", F.aggregate("_all", start, step)).withColumn("hz", 1 / ((F.col("_middle.low") + F.col("_middle.high")) / 2000))
    runs = runs.withColumn("n", F.greatest(F.lit(LEAST), F.bround(F.col("hz") * WINDOW_S)).cast("bigint"))
    merged = runs.select("device_id", "run", "samples", "hz", "n", F.inline("_parts"))
    before = Window.partitionBy("device_id", "run").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    merged = merged.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(*part).orderBy("t_ms"))
    rows = v.withColumn("_place", place).join(merged.select(*part, "run", "samples", "hz", "n", "_before"), part)
    return rows.select("device_id", "run", (F.col("_before") + F.col("_place") - 1).alias("idx"), "t_ms", "v", "samples", "hz", "n")


def admit_runs(runs: DataFrame) -> DataFrame:
    """device_id, run, samples, hz, n (samples of a window) and reason: null where a window fits."""
    out = runs.groupBy("device_id", "run").agg(F.first("samples").alias("samples"), F.first("hz").alias("hz"), F.first("n").alias("n"))
    return out.withColumn("reason", refusal())


def refusal() -> F.Column:
    """Why a run has no window: short or rate, else null."""
    return F.when((F.col("samples") < LEAST) | (F.col("samples") < F.col("n")) | F.col("n").isNull(), "short").when(~F.col("hz").between(*RATE), "rate")


def device_admission(devices: DataFrame, runs: DataFrame) -> DataFrame:
    """device_id and reason: null if a run of the device has a window, else rate, short, or none (no samples)."""
    order = F.when(F.col("reason").isNull(), 0).when(F.col("reason") == "rate", 1).otherwise(2)
    best = admit_runs(runs).groupBy("device_id").agg(F.min(order).alias("_k"))
    known = devices.select("device_id").distinct().join(best, "device_id", "left")
    return known.select("device_id", F.when(F.col("_k").isNull(), "none").when(F.col("_k") == 1, "rate").when(F.col("_k") == 2, "short").alias("reason"))


def window_scores(runs: DataFrame) -> DataFrame:
    """rms of the residual about a straight line of each window of n samples: device_id, run, idx (its first), t_ms, n, rms.

    From running sums within a slice and what follows it for the length of a window, of values less their
    mean: the sums of a window are those up to its last sample less those before its first.
    """
    df = sliced(runs.where(refusal().isNull()), 0, REACH_MS)
    w = Window.partitionBy("device_id", "_slice", "run")
    first = F.min("idx").over(w)
    df = df.withColumn("c", F.col("v") - F.avg("v").over(w)).withColumn("_x", F.col("idx") - first)
    upto = w.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"s1": F.sum("c").over(upto), "s2": F.sum(F.col("c") * F.col("c")).over(upto), "sx": F.sum(F.col("c") * F.col("_x")).over(upto)})
    # A sample ends the window that begins n - 1 before it, and begins its own.
    sums = ["s1", "s2", "sx"]
    role = lambda at, own: F.struct(at.alias("idx"), *[(F.col(s) if own else F.lit(None).cast("double")).alias(f"b_{s}") for s in sums], *[(F.lit(None).cast("double") if own else F.col(s)).alias(f"e_{s}") for s in sums], (F.col("c") if own else F.lit(None).cast("double")).alias("c"), (F.col("_x") if own else F.lit(None).cast("bigint")).alias("x"), F.when(F.lit(own) & F.col("_own"), F.col("t_ms")).alias("t_ms"))
    both = df.select("device_id", "_slice", "run", "n", F.inline(F.array(role(F.col("idx"), True), role(F.col("idx") - F.col("n") + 1, False))))
    both = both.groupBy("device_id", "_slice", "run", "idx", "n").agg(*[F.max(c).alias(c) for c in ("b_s1", "b_s2", "b_sx", "e_s1", "e_s2", "e_sx", "c", "x", "t_ms")])
    both = both.where("t_ms IS NOT NULL AND e_s1 IS NOT NULL")
    n = F.col("n").cast("double")
    sum1 = F.col("e_s1") - F.col("b_s1") + F.col("c")
    sum2 = F.col("e_s2") - F.col("b_s2") + F.col("c") * F.col("c")
    sumx = F.col("e_sx") - F.col("b_sx") + F.col("c") * F.col("x") - F.col("x") * sum1
    slope_part = sumx - (n - 1) / 2 * sum1
    spread = n * (n * n - 1) / 12
    residual = sum2 - sum1 * sum1 / n - slope_part * slope_part / spread
    return both.select("device_id", "run", "idx", "t_ms", "n", F.sqrt(F.greatest(F.lit(0.0), residual / n)).alias("rms"))


def best_window(runs: DataFrame) -> DataFrame:
    """The window of the largest rms of each device, the earliest of equal ones (to 1e-9)."""
    scored = window_scores(runs)
    order = F.struct(F.round("rms", 9), -F.col("t_ms"))
    return scored.groupBy("device_id").agg(F.max_by(F.struct("run", "idx", "t_ms", "n", "rms"), order).alias("w"), F.countDistinct("run").alias("candidates")).select("device_id", "w.*", "candidates")


def window_samples(runs: DataFrame, best: DataFrame) -> DataFrame:
    b = best.select("device_id", "run", F.col("idx").alias("_from"), F.col("n").alias("_n"))
    return runs.join(b, ["device_id", "run"]).where((F.col("idx") >= F.col("_from")) & (F.col("idx") < F.col("_from") + F.col("_n"))).select("device_id", "run", "idx", "t_ms", "v", F.col("_n").alias("n"), (F.col("idx") - F.col("_from")).alias("k"))


def detrend(samples: DataFrame) -> DataFrame:
    """samples with ``x``, the residual about a line on time. One window a device, of some hundred rows."""
    w = Window.partitionBy("device_id")
    df = samples.withColumn("_s", (F.col("t_ms") - F.min("t_ms").over(w)) / 1000)
    df = df.withColumn("_a", F.regr_slope("v", "_s").over(w)).withColumn("_b", F.regr_intercept("v", "_s").over(w))
    return df.withColumn("x", F.col("v") - F.col("_a") * F.col("_s") - F.col("_b")).drop("_s", "_a", "_b")


def window_measures(residual: DataFrame) -> DataFrame:
    rms = F.sqrt(F.avg(F.col("x") * F.col("x")))
    peak = F.max(F.abs("x"))
    return residual.groupBy("device_id").agg(rms.alias("rms"), peak.alias("peak"), (F.max("x") - F.min("x")).alias("peak_to_peak"), (peak / rms).alias("crest"))


def spectrum(residual: DataFrame, fmax: float = 4.0) -> DataFrame:
    """device_id, bin, hz, amplitude: the single-sided spectrum under a Hann window up to fmax or 0.4 of the rate."""
    w = Window.partitionBy("device_id")
    n = F.count(F.lit(1)).over(w)
    rate = (n - 1) / ((F.max("t_ms").over(w) - F.min("t_ms").over(w)) / 1000)
    df = residual.select("device_id", "k", "x", rate.alias("rate"), n.alias("_n")).withColumn("_w", 0.5 - 0.5 * F.cos(2 * math.pi * F.col("k") / (F.col("_n") - 1)))
    bins = F.floor(F.least(F.lit(fmax), 0.4 * F.col("rate")) * F.col("_n") / F.col("rate")).cast("int")
    each = df.withColumn("bin", F.explode(F.sequence(F.lit(1), bins)))
    angle = 2 * math.pi * F.col("bin") * F.col("k") / F.col("_n")
    out = each.groupBy("device_id", "bin", "rate", "_n").agg(F.sum(F.col("x") * F.col("_w") * F.cos(angle)).alias("_c"), F.sum(F.col("x") * F.col("_w") * F.sin(angle)).alias("_s"), F.sum("_w").alias("_sw"))
    return out.select("device_id", "bin", (F.col("bin") * F.col("rate") / F.col("_n")).alias("hz"), (2 * F.sqrt(F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s")) / F.col("_sw")).alias("amplitude"))


def dominant(spec: DataFrame, least_hz: float = 0.2) -> DataFrame:
    return spec.where(F.col("hz") >= least_hz).groupBy("device_id").agg(F.max_by(F.struct("hz", "amplitude"), F.struct("amplitude", -F.col("bin"))).alias("d")).select("device_id", "d.*")


def rms_envelope(residual: DataFrame, k: int = 10) -> DataFrame:
    """Rolling rms over k samples, null until there are as many."""
    w = Window.partitionBy("device_id").orderBy("k").rowsBetween(-(k - 1), 0)
    return residual.withColumn("envelope", F.when(F.count("x").over(w) == k, F.sqrt(F.avg(F.col("x") * F.col("x")).over(w))))


def candidates(buckets: DataFrame, k: int = 6, least: int = LEAST) -> DataFrame:
    """Buckets worth a search: the k of the largest rms of each device (top k is the feature), the first and last of its range, and their neighbours."""
    mean = F.col("vib_sum") / F.col("vib_n")
    df = buckets.withColumn("rms", F.sqrt(F.greatest(F.lit(0.0), F.col("vib_sq") / F.col("vib_n") - mean * mean))).withColumn("peak", F.greatest(mean - F.col("vib_min"), F.col("vib_max") - mean))
    good = F.col("vib_n") >= least
    w = Window.partitionBy("device_id")
    rank = F.row_number().over(w.orderBy(F.desc(good), F.desc("rms"), F.desc("peak"), "bucket_ms"))
    df = df.withColumn("_r", rank).withColumn("_edge", (F.col("bucket_ms") == F.min("bucket_ms").over(w)) | (F.col("bucket_ms") == F.max("bucket_ms").over(w)))
    top = df.where((good & (F.col("_r") <= k)) | F.col("_edge"))
    return top.select("device_id", F.explode(F.array(F.col("bucket_ms") - 60_000, "bucket_ms", F.col("bucket_ms") + 60_000)).alias("bucket_ms")).distinct()


def two_stage(points: DataFrame, shortlist: DataFrame, span_s: float, exact: bool = False) -> DataFrame:
    """The best window, searched everywhere if exact or the range is short (raw reads), else in the coalesced buckets of the shortlist (of ``candidates``)."""
    if not exact and span_s > RAW_BELOW_S:
        near = shortlist
        wide = coalesce_intervals(near.select("device_id", F.col("bucket_ms").alias("start_ms"), (F.col("bucket_ms") + 59_999).alias("end_ms")), 1)
        cells = wide.select(F.col("device_id").alias("_d"), F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"), F.explode(F.sequence(F.floor(F.col("start_ms") / SLICE_MS), F.floor(F.col("end_ms") / SLICE_MS))).alias("_cell"))
        keyed = points.withColumn("_at", slice_of())
        points = keyed.join(cells, (keyed["device_id"] == cells["_d"]) & (keyed["_at"] == cells["_cell"]) & F.col("t_ms").between(F.col("_s"), F.col("_e")), "left_semi").drop("_at")
    return best_window(vibration_runs(points))
