"""CSV export and import of the measurement view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import CHANNELS, EXCLUDING, REASON_BITS, REASONS
from ..functions.scalars import bits_to_names, finite, gps_to_unix, motion_state
from ..operators.quality import VERSION

# The columns of an export row.
COLUMNS = ["device_id", "t", "protocol", "week", "tow", *CHANNELS, "status_text", "nav_mode", "fix_mode", "warning", "source", "source_offset", "data_view", "filter_version", "excluded_fields", "filter_reasons", "stationary_context", "ground_speed_json"]
SCHEMA = ", ".join(f"{c} {'double' if c in CHANNELS or c in ('t', 'tow') else 'int' if c in ('week', 'nav_mode', 'fix_mode', 'warning', 'filter_version') else 'bigint' if c == 'source_offset' else 'string'}" for c in COLUMNS)
CAP = 100_000
BOM = "\ufeff"
# Rules of an import.
MAX_ROWS, MAX_SPAN_S, CLOCK_S = 30_000_000, 31 * 86_400, 0.002
INTEGERS = {"week": (0, 8191), "nav_mode": (0, 3), "fix_mode": (0, 9), "warning": (0, 65535)}


def guarded(column) -> F.Column:
    """Text that a spreadsheet would run as a formula, quoted."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def export_rows(view: DataFrame) -> DataFrame:
    """The 56 columns of an export row; view is the projected view with mask, reasons and ground."""
    have = set(view.columns)
    extra = {c: F.lit(None).cast("string") for c in ("status_text", "source") if c not in have} | {c: F.lit(None).cast("double") for c in ("tow",) if c not in have} | {c: F.lit(None).cast("bigint") for c in ("week", "source_offset") if c not in have}
    df = view.withColumns(extra | {
        "t": F.col("t_ms") / 1000, "data_view": F.lit("filtered"), "filter_version": F.lit(VERSION), "excluded_fields": F.array_join(bits_to_names("mask", CHANNELS), "|"),
        "filter_reasons": F.array_join(bits_to_names("reasons", list(REASONS)), "|"), "stationary_context": F.lit(None).cast("string"), "ground_speed_json": F.to_json("ground")})
    return df.select(*[guarded(c).alias(c) if c in ("device_id", "protocol", "status_text", "source") else F.col(c) for c in COLUMNS])


def export_filtered(view: DataFrame, start_ms: int, end_ms: int, path: str) -> int:
    """CSV of a range, at most CAP rows (a longer range is refused, not cut)."""
    rows = view.where(F.col("t_ms").between(start_ms, end_ms))
    n = rows.limit(CAP + 1).count()
    if n > CAP:
        raise ValueError(f"more than {CAP} rows; choose a shorter range")
    # One file in order, with the mark that spreadsheets want: a range has at most CAP rows. A BOM before the header's first name.
    out = export_rows(rows).orderBy("t", "protocol").coalesce(1)
    out.withColumnRenamed(COLUMNS[0], BOM + COLUMNS[0]).write.option("header", True).csv(path)
    return n


def export_excluded(assessed: DataFrame, reason: str = "all") -> DataFrame:
    """Raw rows with hidden fields by reason: all, anomaly, unavailable or one code; status codes select nothing."""
    if reason in ("anomaly", "unavailable"):
        bits = sum(b for n, b in REASON_BITS.items() if REASONS[n] == reason)
    else:
        bits = EXCLUDING if reason == "all" else REASON_BITS[reason] & EXCLUDING
    return assessed.where((F.col("reasons").bitwiseAND(F.lit(bits).cast("bigint")) != 0) & (F.col("mask") != 0))


def import_violations(rows: DataFrame, now_s: float | None = None, most_rows: int = MAX_ROWS) -> DataFrame:
    """A row for each rule that an import row (or the whole file, line_t null) breaks: device_id, line_t, rule.

    Rules of a row: protocol, view, version, unknown fields and codes, hidden fields with values, finite numbers,
    ranges, GPS time against UTC within 2 ms, a speed record that agrees with the row. Rules of a file: serial, one
    device, order of time (against the row before, by line), 31 days and the number of rows.
    """
    listed = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: x != "")
    excluded = listed("excluded_fields")
    true = lambda tests: F.exists(F.array(*tests), lambda x: F.coalesce(x, F.lit(False)))
    shown = true([F.array_contains(excluded, c) & F.col(c).isNotNull() for c in CHANNELS])
    unknown = lambda names, known: F.size(F.array_except(names, F.array(*[F.lit(n) for n in known]))) > 0
    infinite = true([~finite(c) & F.col(c).isNotNull() for c in [*CHANNELS, "t", "tow"]])
    outside = true([F.col(c).isNull() | ~F.col(c).between(*b) for c, b in INTEGERS.items()])
    # The speed record is read once a row.
    rows = rows.withColumn("_speed", F.from_json("ground_speed_json", "value double, state string, reason string, raw_speed double"))
    value, raw, state = F.col("_speed.value"), F.col("_speed.raw_speed"), F.col("_speed.state")
    coherent = (
        state.isin("moving", "stationary", "unknown") & value.eqNullSafe(F.col("speed"))
        & F.when(F.col("protocol") == "GPCHCX", raw.isNotNull()).otherwise(F.col("_speed.reason").eqNullSafe(F.lit("non_gpchcx")))
        & F.when(state == "moving", value.eqNullSafe(raw) & (motion_state() == "moving")).when(state == "stationary", (value == 0) & (motion_state() == "stationary")).otherwise(value.isNull()))
    rules = [
        ("protocol", ~F.coalesce(F.col("protocol").isin("GPCHC", "GPCHCX"), F.lit(False))), ("serial", ~F.coalesce(F.col("device_id").rlike("^[A-Za-z0-9_-]{1,40}$"), F.lit(False))),
        ("view", ~F.col("data_view").eqNullSafe("filtered")), ("version", ~F.col("filter_version").eqNullSafe(VERSION)), ("fields", unknown(excluded, CHANNELS)), ("codes", unknown(listed("filter_reasons"), REASONS)),
        ("excluded_not_null", shown), ("finite", infinite), ("integers", outside), ("tow", F.col("tow").isNull() | (F.col("tow") < 0) | (F.col("tow") >= 604800)),
        ("gps_time", F.abs(gps_to_unix("week", "tow") - F.col("t")) > CLOCK_S),
        ("ranges", true([~F.col("lat").between(-90, 90), ~F.col("lon").between(-180, 180), ~F.col("speed").between(0, 300)])), ("negative_age", F.col("age") < 0),
        ("time", F.col("t").isNull() | F.isnan("t") | (F.col("t") <= 0) | (F.col("t") >= (F.lit(now_s) if now_s is not None else F.unix_timestamp(F.current_timestamp())) + 86_400)),
        ("speed_metadata", ~F.coalesce(coherent, F.lit(False)))]
    each = F.explode(F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules])))
    out = rows.select("device_id", F.col("t").alias("line_t"), each.alias("rule"))
    if "line" in rows.columns:
        # The order of lines, within blocks of lines; a block's first line is also held against the end of the block before.
        blocks = rows.select("line", "t", "device_id", F.floor(F.col("line") / 100_000).alias("_at"))
        before = F.lag("t").over(Window.partitionBy("_at").orderBy("line"))
        guests = blocks.withColumn("_to", F.explode(F.when(F.col("line") % 100_000 == 99_999, F.array("_at", F.col("_at") + 1)).otherwise(F.array("_at"))))
        late = guests.select("line", "t", "device_id", F.col("_to").alias("_at"), (F.col("_to") == F.col("_at")).alias("_own")).withColumn("_before", before).where(F.col("_own") & (F.col("t") < F.col("_before")))
        out = out.unionByName(late.select("device_id", F.col("t").alias("line_t"), F.lit("order").alias("rule")))
    whole = rows.agg(F.min("device_id").alias("a"), F.max("device_id").alias("b"), (F.max("t") - F.min("t")).alias("span"), F.count(F.lit(1)).alias("n"))
    broken = F.array_compact(F.array(F.when(F.col("a") != F.col("b"), "one_device"), F.when(F.col("span") > MAX_SPAN_S, "span"), F.when(F.col("n") > most_rows, "rows")))
    return out.unionByName(whole.select(F.col("a").alias("device_id"), F.lit(None).cast("double").alias("line_t"), F.explode(broken).alias("rule")))


def import_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(points, violations) of an export in CSV or CSV.GZ; a header that differs is an error."""
    rows = spark.read.schema(SCHEMA).option("header", True).option("enforceSchema", False).csv(path)
    return rows.withColumn("t_ms", F.round(F.col("t") * 1000).cast("bigint")), import_violations(rows)
