"""Raw log frames: scanning, integrity, decoding, rejects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import CHANNELS
from ..functions.scalars import gps_to_unix, valid_position
from .logs import STEP, growing_logs

# The shape of a frame and where the channels stand in it.
FRAME = r"([$#][A-Z][A-Z0-9]+,[\x20-\x7e]{1,4096}?\*[0-9a-fA-F]{2,8})\r?\n"
POSITIONS = {**{c: 3 + i for i, c in enumerate(CHANNELS[:18])}, "age": 22, **{c: 24 + i for i, c in enumerate(CHANNELS[19:28])}, **{c: 34 + i for i, c in enumerate(CHANNELS[28:39])}}
RANGES = {"lat": (-90, 90), "lon": (-180, 180), "heading": (0, 360), "pitch": (-90, 90), "roll": (-180, 180), "speed": (0, 300), "sat1": (0, 255), "sat2": (0, 255)}
FIELDS = {"GPCHC": 24, "GPCHCX": 46}
SERIAL = "^[A-Za-z0-9_-]{1,40}$"
FRAME_COLUMNS = "source string, source_offset bigint, source_length int, frame string"


def frames_in(raw: DataFrame) -> DataFrame:
    """source, source_offset, source_length and frame of each frame in files (path, content as binary) or in ranges of files (with their start)."""
    return matches_in(raw).drop("matched")


def matches_in(raw: DataFrame) -> DataFrame:
    """As frames_in, with matched: the bytes of a frame and of its line's end."""
    text = F.decode("content", "ISO-8859-1")
    start = F.col("start") if "start" in raw.columns else F.lit(0).cast("bigint")
    df = raw.select(F.col("path").alias("source"), start.alias("_start"), text.alias("_text"))
    # One character is one byte; a frame's offset is the length of what stands before it, a running sum in the range's order.
    pieces = F.zip_with(
        F.zip_with(F.split("_text", FRAME, -1), F.regexp_extract_all("_text", F.lit(FRAME), F.lit(0)), lambda a, b: F.struct(F.length(a).alias("a"), F.length(b).alias("b"))),
        F.regexp_extract_all("_text", F.lit(FRAME), F.lit(1)), lambda x, f: F.struct(x["a"].alias("a"), x["b"].alias("b"), f.alias("frame")))
    each = df.select("source", "_start", F.posexplode(pieces).alias("k", "p")).select("source", "_start", "k", "p.*")
    w = Window.partitionBy("source", "_start").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("_start") + F.sum(F.col("a").cast("bigint") + F.coalesce("b", F.lit(0))).over(w)
    out = each.withColumn("source_offset", upto - F.coalesce("b", F.lit(0))).where("frame IS NOT NULL")
    return out.select("source", "source_offset", F.length("frame").alias("source_length"), "frame", F.col("b").cast("bigint").alias("matched"))


def scan_frames(spark: SparkSession, path: str, glob: str = "*.log", step: int = STEP) -> DataFrame:
    """The frames of all log files under a path; a file is read in ranges, each by a task of its own."""
    return frames_in(growing_logs(spark, path, glob, step))


def xor_checksum(body: Column) -> Column:
    """XOR of the bytes of a text: folded seven bytes a step, then the seven into one."""
    raw = body.cast("binary")  # a part of bytes is reached at once, one of characters by going through the text up to it
    step = lambda a, k: a.bitwiseXOR(F.conv(F.hex(F.substring(raw, k, F.lit(7))), 16, 10).cast("bigint"))
    eight = lambda acc: [F.shiftright(acc, 8 * k) for k in range(8)]
    # The fold is finished inside the aggregate: outside, it would be worked out anew for every mention.
    last = lambda acc: reduce(lambda x, y: x.bitwiseXOR(y), eight(acc)).bitwiseAND(F.lit(255).cast("bigint")).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(raw)), F.lit(7)), F.lit(0).cast("bigint"), step, last)


def crc32_plain(body: Column) -> Column:
    """CRC-32 with the register starting at 0 and no final inversion."""
    return F.crc32(F.concat(F.unhex(F.lit("FFFFFFFF")), body.cast("binary"))).bitwiseXOR(F.lit(4294967295).cast("bigint"))


def with_checksum(frames: DataFrame) -> DataFrame:
    """frames with name, body, given and checksum_ok."""
    body = F.expr("substring(frame, 2, length(frame) - instr(reverse(frame), '*') - 1)")
    given = F.substring_index("frame", "*", -1)
    df = settled(frames.withColumn("body", body).withColumn("given", given).withColumn("name", F.expr("substring(frame, 2, instr(frame, ',') - 2)")))
    value = F.when(F.col("given").rlike("^[0-9a-fA-F]+$"), F.conv("given", 16, 10).cast("bigint"))
    ok = F.when(F.startswith("frame", F.lit("$")), (F.length("given") == 2) & (xor_checksum(F.col("body")) == value)).otherwise((F.length("given") == 8) & (crc32_plain(F.col("body")) == value))
    return df.withColumn("checksum_ok", F.coalesce(ok, F.lit(False)))


def settled(df: DataFrame) -> DataFrame:
    """df with its columns made once: later filters and columns refer to values and not to how they were made."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def decode_points(frames: DataFrame, now_s: float, bound_serial: str | None = None) -> DataFrame:
    """Typed points with reject_reason: null for good ones, else the first rule that fails."""
    df = with_checksum(frames.where(F.substring_index(F.substring("frame", 2, 20), ",", 1).isin(*FIELDS)))
    df = settled(df.withColumn("f", F.split("body", ",", -1)).drop("body", "given", "frame"))
    wide = F.col("name") == "GPCHCX"
    get = lambda i: F.try_element_at("f", F.lit(i + 1))
    cols = {"week": get(1).try_cast("int"), "tow": get(2).try_cast("double")}
    texts = {}
    for c, i in POSITIONS.items():
        texts[c] = get(i)
        number = get(i).try_cast("double")
        cols[c] = number if i <= 22 else F.when(wide, number)
    cols |= {"status_text": get(21), "_serial": F.when(wide, get(45)).otherwise(F.lit(bound_serial)), "warning": F.when(get(23).rlike("^[0-9A-Fa-f]{1,4}$"), F.conv(get(23), 16, 10).cast("int"))}
    df = settled(df.withColumns(cols | {"_mark": get(33)}))
    df = settled(df.withColumns({"device_id": F.col("_serial"), "protocol": F.col("name"), "t": gps_to_unix("week", "tow"), "fix_mode": F.conv(F.substring("status_text", 1, 1), 16, 10).cast("int"), "nav_mode": F.conv(F.substring("status_text", 2, 1), 16, 10).cast("int")}))
    numeric = [c for c in POSITIONS if POSITIONS[c] <= 22]
    missing = F.exists(F.array(*[F.col(c).isNull() for c in numeric], F.col("warning").isNull(), F.col("tow").isNull(), F.col("week").isNull(), *[wide & F.col(c).isNull() for c in POSITIONS if POSITIONS[c] > 22]), lambda x: x)
    infinite = F.exists(F.array(*[F.isnan(c) | (F.abs(F.col(c)) == float("inf")) for c in POSITIONS]), lambda x: F.coalesce(x, F.lit(False)))
    outside = lambda c: ~F.col(c).between(*RANGES[c]) if c != "heading" else (F.col(c) < 0) | (F.col(c) >= 360)
    any_ = lambda cs: F.exists(F.array(*cs), lambda x: F.coalesce(x, F.lit(False)))
    stds = [c for c in CHANNELS if c.endswith("_std")] + ["age"]
    reason = (
        F.when(~F.col("checksum_ok"), "checksum").when(F.size("f") != F.when(wide, 46).otherwise(24), "field_count")
        .when(F.col("_serial").isNull(), "unidentified_device").when(~F.col("_serial").rlike(SERIAL), "invalid_sn").when(missing, "malformed_number")
        .when(F.col("t").isNull(), "invalid_time").when(~F.col("status_text").rlike("^[0-9A-Fa-f]{2}$") | (F.col("nav_mode") > 3) | (F.col("fix_mode") > 9), "invalid_status")
        .when(wide & (F.col("_mark") != "X"), "separator").when(infinite, "nonfinite").when(any_([outside("lat"), outside("lon")]), "coordinate_range")
        .when(any_([outside(c) for c in ("heading", "pitch", "roll")]), "attitude_range").when(any_([outside(c) for c in ("speed", "sat1", "sat2")]), "range")
        .when(any_([F.col(c) < 0 for c in stds]), "negative_quality").when((F.col("t") > now_s + 300) | (F.col("t") < 1262304000), "clock_range"))
    df = settled(df.withColumn("reject_reason", reason))
    df = df.withColumn("t_ms", F.round(F.col("t") * 1000).cast("bigint")).withColumn("valid_pos", valid_position())
    return df.select("device_id", "t_ms", "protocol", "week", "tow", *CHANNELS, "status_text", "fix_mode", "nav_mode", "warning", "valid_pos", "source", "source_offset", "source_length", "reject_reason")


def counter_rows(decoded: DataFrame, fresh: DataFrame, frames: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """source, name and n of what was read.

    decoded are the points of all frames, fresh those that are new. Frames that parse count as valid_ascii and by protocol, even
    if their clock is refused; with all frames (as matches_in gives them) those of other kinds count as auxiliary_ascii, or as rejected where
    their checksum is wrong; with files or ranges of files, read_bytes and unparsed_bytes (all but frames with their line ends).
    """
    def named(rows, names):
        return rows.select("source", F.explode(F.array_compact(F.array(*names))).alias("name"), "n")

    one = F.count(F.lit(1)).alias("n")
    parsed, bad = F.col("reject_reason").isNull() | (F.col("reject_reason") == "clock_range"), F.col("reject_reason").isNotNull()
    kinds = decoded.groupBy("source", "protocol", "reject_reason").agg(one)
    out = named(kinds, [F.when(parsed, "valid_ascii"), F.when(parsed, F.concat(F.lit("protocol:"), "protocol")), F.when(bad, "rejected"), F.when(bad, F.concat(F.lit("error:"), "reject_reason"))])
    new = fresh.groupBy("source").agg(one)
    good = kinds.where(~bad).groupBy("source").agg(F.sum("n").alias("n"))
    again = good.join(new.withColumnRenamed("n", "_new"), "source", "left").select("source", F.lit("duplicates").alias("name"), (F.col("n") - F.coalesce("_new", F.lit(0))).alias("n"))
    out = out.unionByName(new.select("source", F.lit("points").alias("name"), "n")).unionByName(again.where("n > 0"))
    return _with_other_counters(out, frames, files)


def _with_other_counters(out: DataFrame, frames: DataFrame | None, files: DataFrame | None) -> DataFrame:
    """Counters of points, with those of frames of other kinds and of bytes."""
    def named(rows, names):
        return rows.select("source", F.explode(F.array_compact(F.array(*names))).alias("name"), "n")

    one = F.count(F.lit(1)).alias("n")
    if frames is not None:
        other = with_checksum(frames.where(~F.substring_index(F.substring("frame", 2, 20), ",", 1).isin(*FIELDS))).groupBy("source", "name", "checksum_ok").agg(one).withColumnRenamed("name", "kind")
        ok = F.col("checksum_ok")
        out = out.unionByName(named(other, [F.when(ok, "valid_ascii"), F.when(ok, F.concat(F.lit("protocol:"), "kind")), F.when(ok, "auxiliary_ascii"), F.when(~ok, "rejected"), F.when(~ok, "error:checksum")]))
    if files is not None:
        size = files.groupBy(F.col("path").alias("source")).agg(F.sum(F.length("content").cast("bigint")).alias("n"))
        matched = frames.groupBy("source").agg(F.sum("matched").alias("_matched"))
        out = out.unionByName(size.select("source", F.lit("read_bytes").alias("name"), "n"))
        out = out.unionByName(size.join(matched, "source", "left").select("source", F.lit("unparsed_bytes").alias("name"), (F.col("n") - F.coalesce("_matched", F.lit(0))).alias("n")))
    return out.groupBy("source", "name").agg(F.sum("n").alias("n"))


def ingest_counters(decoded: DataFrame, frames: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """A map of counters (see counter_rows) for each source; of repeated points the first is new. decoded is gone through once."""
    good = F.col("reject_reason").isNull()
    # A good point's sources stand together, a refused frame's is part of its key.
    key = [F.when(good, F.col(c)).alias(c) for c in ("device_id", "t_ms")] + ["protocol", "reject_reason", F.when(~good, F.col("source")).alias("_bad")]
    met = decoded.groupBy(*key, "source").agg(F.count(F.lit(1)).alias("n"), F.min("source_offset").alias("_at"))
    each = met.groupBy("device_id", "t_ms", "protocol", "reject_reason", "_bad").agg(F.collect_list(F.struct("source", "n")).alias("_in"), F.min(F.struct("source", "_at"))["source"].alias("_first"))
    each = each.select("protocol", "reject_reason", "_first", F.inline("_in"))
    new = (good & (F.col("source") == F.col("_first"))).cast("bigint")
    sums = each.groupBy("source", "protocol", "reject_reason").agg(F.sum("n").alias("n"), F.sum(new).alias("_new"))
    item = lambda when, name, n="n": F.when(when, F.struct((F.lit(name) if isinstance(name, str) else name).alias("name"), (F.col(n) if isinstance(n, str) else n).alias("n")))
    parsed, again = good | (F.col("reject_reason") == "clock_range"), F.col("n") - F.col("_new")
    items = [item(parsed, "valid_ascii"), item(parsed, F.concat(F.lit("protocol:"), "protocol")), item(~good, "rejected"), item(~good, F.concat(F.lit("error:"), "reject_reason")), item(good & (F.col("_new") > 0), "points", "_new"), item(good & (again > 0), "duplicates", again)]
    rows = _with_other_counters(sums.select("source", F.inline(F.array_compact(F.array(*items)))), frames, files)
    return rows.groupBy("source").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "n")))).alias("counters"))


def build_frames(points: DataFrame, source: str = "telemetry", changes: dict[int, Column] | None = None, basic: Column | None = None, more: Column | None = None) -> DataFrame:
    """Frames with good checksums from points: the fixture for decoding jobs.

    changes replaces fields, basic says which frames are basic ones (24 fields), more is put at the end of the body.
    """
    day = 604_800_000
    gps = F.col("t_ms") - 315_964_800_000 + 18_000
    week, tow = F.floor(gps / day), F.pmod(gps, F.lit(day)) / 1000
    at = {i: F.coalesce(F.col(c) if c in points.columns else F.lit(0.0), F.lit(0.0)).cast("string") for c, i in POSITIONS.items()}
    at |= {0: F.lit("GPCHCX"), 1: week.cast("string"), 2: tow.cast("string"), 21: F.concat(F.hex("fix_mode"), F.hex("nav_mode")), 23: F.hex("warning"), 33: F.lit("X"), 45: F.col("device_id")}
    for i, c in (changes or {}).items():
        at[i] = F.coalesce(c, at[i])
    body = F.concat_ws(",", *[at[i] for i in range(46)])
    if basic is not None:
        body = F.when(basic, F.concat_ws(",", F.lit("GPCHC"), *[at[i] for i in range(1, 24)])).otherwise(body)
    if more is not None:
        body = F.concat(body, more)
    df = settled(points.select("device_id", "t_ms", "protocol", body.alias("_body")))
    frame = F.concat(F.lit("$"), "_body", F.lit("*"), F.lpad(F.hex(xor_checksum(F.col("_body"))), 2, "0"))
    return df.select(F.concat(F.lit(source), F.lit("/"), "device_id").alias("source"), F.col("t_ms").alias("source_offset"), F.length(frame).alias("source_length"), frame.alias("frame"))


def verify_evidence(points: DataFrame, decoded: DataFrame) -> DataFrame:
    """verified, mismatch or missing for each point against the frame at its place."""
    raw = decoded.select(F.col("source").alias("_s"), F.col("source_offset").alias("_o"), F.struct(*CHANNELS).alias("_raw"))
    joined = points.join(raw, (points["source"] == raw["_s"]) & (points["source_offset"] == raw["_o"]), "left")
    same = F.forall(F.array(*[F.col(c).eqNullSafe(F.col(f"_raw.{c}")) for c in CHANNELS]), lambda x: x)
    return joined.withColumn("evidence", F.when(F.col("_raw").isNull(), "missing").when(same, "verified").otherwise("mismatch")).drop("_s", "_o", "_raw")
