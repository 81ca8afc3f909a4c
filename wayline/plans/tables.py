"""Queries over frames, exports, the traceability tables and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import CHANNELS
from ..functions.scalars import angle_delta, capped_rate, contains_ci, json_length, json_text, local_day, norm_digits, norm_sequence, process_no, repair_text
from ..operators import audit, lifecycle, rollup, series, trace
from ..operators.quality import assess, project
from ..sources import exports, frames
from ..sources.telemetry import table, telemetry
from .shared import rounded, sql, view

QUERIES, SQL = {}, {}


def query(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return put


NOW_S = 1893456000.0


#: The reject reasons in the order of the frames that have them: frame k of 16 has the k-th.
REASONS = ["checksum", "field_count", "unidentified_device", "invalid_sn", "malformed_number", "invalid_time", "invalid_status", "separator", "nonfinite", "coordinate_range", "attitude_range", "range", "negative_quality", "clock_range"]


def _frames(spark, sf_dir):
    """Frames built from telemetry, of which 14 in 64 are spoiled, each for another reason."""
    t = telemetry(spark, sf_dir, dealt=True).withColumn("ax", F.coalesce("ax", F.lit(1.0))).withColumn("protocol", F.lit("GPCHCX"))
    k = F.pmod(F.floor(F.col("t_ms") / 100), F.lit(64))
    bad = lambda reason, value: F.when(k == REASONS.index(reason) + 1, F.lit(value))
    changes = {
        45: bad("invalid_sn", "no serial!"), 3: bad("malformed_number", "abc"), 2: bad("invalid_time", "700000"), 21: bad("invalid_status", "Z9"), 33: bad("separator", "Y"), 6: bad("nonfinite", "NaN"),
        12: bad("coordinate_range", "95"), 4: bad("attitude_range", "91"), 18: bad("range", "301"), 22: bad("negative_quality", "-1"), 1: bad("clock_range", "3000")}
    at = lambda reason: k == REASONS.index(reason) + 1
    built = frames.build_frames(t, changes=changes, basic=at("unidentified_device"), more=F.when(at("field_count"), ",1").otherwise(""))
    spoiled = F.concat(F.expr("substring(frame, 1, length(frame) - 2)"), F.lit("ZZ"))
    wrong = F.pmod(F.floor(F.col("source_offset") / 100), F.lit(64)) == REASONS.index("checksum") + 1
    return built.withColumn("frame", F.when(wrong, spoiled).otherwise(F.col("frame")))


_SPOILED = "CAST(floor(t_ms / 100) AS BIGINT) % 64"


@query(r"""
WITH o AS (SELECT concat('GP', CAST(o_orderkey AS VARCHAR), ',', o_orderpriority) AS body FROM orders)
SELECT body, CAST(list_reduce(list_transform(string_split(body, ''), lambda x: ascii(x)), lambda a, b: xor(a, b)) AS INTEGER) AS checksum, count(*) AS n FROM o GROUP BY ALL""")
def frame_checksum(spark, sf_dir):
    body = F.concat(F.lit("GP"), F.col("o_orderkey").cast("string"), F.lit(","), "o_orderpriority")
    return table(spark, sf_dir, "orders").select(body.alias("body")).withColumn("checksum", frames.xor_checksum(F.col("body"))).groupBy("body", "checksum").agg(F.count(F.lit(1)).alias("n"))


@query(sql("\nSELECT device_id, count(*) AS n, min(t_ms) AS first_ms, max(t_ms) AS last_ms, round(sum(speed), 4) + 0.0 AS speed_sum, CAST(sum(fix_mode) AS BIGINT) AS fixes, CAST(sum(warning) AS BIGINT) AS warnings FROM t WHERE NOT CAST(floor(t_ms / 100) AS BIGINT) % 64 BETWEEN 1 AND 14 GROUP BY device_id"))
def frame_decode(spark, sf_dir):
    points = frames.decode_points(_frames(spark, sf_dir), NOW_S).where("reject_reason IS NULL")
    return rounded(points.groupBy("device_id").agg(F.count(F.lit(1)).alias("n"), F.min("t_ms").alias("first_ms"), F.max("t_ms").alias("last_ms"), F.sum("speed").alias("speed_sum"), F.sum("fix_mode").alias("fixes"), F.sum("warning").alias("warnings")), 4)


@query(sql("\nSELECT " + "CASE " + " ".join(f"WHEN {_SPOILED} = {k} THEN '{r}'" for k, r in enumerate(REASONS, 1)) + f" END AS reject_reason, count(*) AS n FROM t WHERE {_SPOILED} BETWEEN 1 AND 14 GROUP BY ALL"))
def reject_summary(spark, sf_dir):
    return frames.decode_points(_frames(spark, sf_dir), NOW_S).where("reject_reason IS NOT NULL").groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query(sql(f"""
SELECT concat('telemetry/', device_id) AS source, 2 * count(*) FILTER (NOT {_SPOILED} BETWEEN 1 AND 13) + count(*) AS frames, count(*) AS auxiliary, count(*) FILTER (NOT {_SPOILED} BETWEEN 1 AND 14) AS points, count(*) FILTER (NOT {_SPOILED} BETWEEN 1 AND 14) AS duplicates,
  2 * count(*) FILTER ({_SPOILED} BETWEEN 1 AND 14) AS rejected, 2 * count(*) FILTER ({_SPOILED} = 1) AS bad, 2 * count(*) FILTER ({_SPOILED} = 14) AS ahead FROM t GROUP BY ALL"""))
def ingest_counters(spark, sf_dir):
    """Every frame comes twice, and once more as an auxiliary message."""
    f = _frames(spark, sf_dir)
    twice = f.withColumn("source_offset", F.explode(F.array(F.col("source_offset"), F.col("source_offset") + 1)))
    other = f.withColumn("frame", F.lit("$GPAUX,1*46"))
    c = frames.ingest_counters(frames.decode_points(twice, NOW_S), twice.unionByName(other))
    get = lambda name: F.coalesce(F.col("counters")[name], F.lit(0)).cast("bigint")
    return c.select("source", get("valid_ascii").alias("frames"), get("auxiliary_ascii").alias("auxiliary"), get("points").alias("points"), get("duplicates").alias("duplicates"), get("rejected").alias("rejected"), get("error:checksum").alias("bad"), get("error:clock_range").alias("ahead"))


_LOGS = """
WITH o AS (SELECT o_orderkey, concat('log', CAST(o_custkey % 20 AS VARCHAR)) AS source, concat('$GPORD,', CAST(o_orderkey AS VARCHAR), ',', o_orderpriority) AS body, o_orderkey % 7 = 0 AS noisy FROM orders),
p AS (SELECT *, CASE WHEN noisy THEN 5 ELSE 0 END AS before, strlen(body) + 3 AS length FROM o),
r AS (SELECT *, sum(before + length + 2) OVER (PARTITION BY source ORDER BY o_orderkey) - length - 2 AS source_offset FROM p)"""


def _logs(spark, sf_dir):
    """Log files (path, content) of frames from orders, with bytes of other kinds between them."""
    o = table(spark, sf_dir, "orders")
    frame = F.concat(F.lit("$GPORD,"), F.col("o_orderkey").cast("string"), F.lit(","), "o_orderpriority", F.lit("*00\r\n"))
    noise = F.when(F.col("o_orderkey") % 7 == 0, F.expr("X'00FF24800A'")).otherwise(F.expr("X''"))
    rows = o.select(F.concat(F.lit("log"), (F.col("o_custkey") % 20).cast("string")).alias("path"), "o_orderkey", F.concat(noise, frame.cast("binary")).alias("piece"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", F.hex("piece").alias("piece")))), lambda x: x["piece"])
    return rows.groupBy("path").agg(F.unhex(F.array_join(listed, "")).alias("content"))


@query(_LOGS + "\nSELECT source, CAST(source_offset AS BIGINT) AS source_offset, CAST(length AS INTEGER) AS source_length, concat(body, '*00') AS frame FROM r")
def frame_scan(spark, sf_dir):
    """Frames with their places in files that hold other bytes too."""
    return frames.frames_in(_logs(spark, sf_dir))


@query(_LOGS + "\nSELECT source, CAST(sum(before + length + 2) AS BIGINT) AS read_bytes, CAST(sum(before) AS BIGINT) AS unparsed_bytes, count(*) FILTER (sum_ok) AS auxiliary, count(*) FILTER (NOT sum_ok) AS rejected "
       "FROM (SELECT *, list_reduce(list_transform(range(2, strlen(body) + 1), lambda i: ascii(body[i])), lambda a, b: xor(a, b)) = 0 AS sum_ok FROM r) GROUP BY source")
def file_counters(spark, sf_dir):
    files = _logs(spark, sf_dir)
    found = frames.matches_in(files)
    c = frames.ingest_counters(frames.decode_points(found, NOW_S), found, files)
    get = lambda name: F.coalesce(F.col("counters")[name], F.lit(0)).cast("bigint")
    return c.select("source", get("read_bytes").alias("read_bytes"), get("unparsed_bytes").alias("unparsed_bytes"), get("auxiliary_ascii").alias("auxiliary"), get("rejected").alias("rejected"))


@query(sql(f"""
SELECT device_id, CASE WHEN {_SPOILED} BETWEEN 1 AND 14 THEN 'missing' WHEN t_ms % 1700 = 0 THEN 'mismatch' ELSE 'verified' END AS evidence, count(*) AS n FROM t GROUP BY ALL"""))
def evidence(spark, sf_dir):
    """Stored points against their frames: rejected frames are missing, some points were changed."""
    good = frames.decode_points(_frames(spark, sf_dir), NOW_S).where("reject_reason IS NULL").drop("reject_reason")
    t = telemetry(spark, sf_dir)
    # A frame has 0 where a channel is missing, and 1 for a missing ax.
    channels = [F.coalesce(F.col(c) if c in t.columns else F.lit(None), F.lit(1.0 if c == "ax" else 0.0)).alias(c) for c in CHANNELS]
    stored = t.select("device_id", "t_ms", F.concat(F.lit("telemetry/"), "device_id").alias("source"), F.col("t_ms").alias("source_offset"), *channels)
    stored = stored.withColumn("speed", F.when(F.col("t_ms") % 1700 == 0, F.col("speed") + 1).otherwise(F.col("speed")))
    return frames.verify_evidence(stored, good).groupBy("device_id", "evidence").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL")
def dedup_points(spark, sf_dir):
    """First row wins for each key: lineitem keys repeat."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return lifecycle.dedup_first(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query(sql("\nSELECT device_id, t_ms / 1000.0::DOUBLE AS t, protocol, speed, heading, data_view, filter_version FROM (SELECT *, 'filtered' AS data_view, CAST(10 AS INTEGER) AS filter_version FROM v)"))
def export_rows(spark, sf_dir):
    return exports.export_rows(view(spark, sf_dir)).select("device_id", "t", "protocol", "speed", "heading", "data_view", "filter_version")


#: all: drift, outlier and unavailable bits; a status code selects nothing.
_CHOSEN = {"all": 8 | 16 | 16384, "anomaly": 8 | 16, "unavailable": 16384, "navigation_position_drift": 8, "heading_unavailable": 0}


@query(sql("\n" + " UNION ALL ".join(f"SELECT '{r}' AS chosen, device_id, count(*) AS n, round(sum(speed), 4) + 0.0 AS raw_speed FROM q WHERE mask <> 0 AND (reasons & {b}) <> 0 GROUP BY device_id" for r, b in _CHOSEN.items())))
def export_excluded(spark, sf_dir):
    a = assess(telemetry(spark, sf_dir))
    out = None
    for reason in _CHOSEN:
        one = exports.export_excluded(a, reason).groupBy("device_id").agg(F.count(F.lit(1)).alias("n"), F.sum("speed").alias("raw_speed")).withColumn("chosen", F.lit(reason))
        out = one if out is None else out.unionByName(one)
    return rounded(out, 4)


#: The rule that row k of 40 breaks; speed and time rules also break where a row's own data do.
BROKEN = ["protocol", "view", "version", "fields", "codes", "excluded_not_null", "finite", "integers", "tow", "gps_time", "ranges", "negative_age"]


@query(sql("\nSELECT * FROM (SELECT device_id, CASE " + " ".join(f"WHEN k = {n} THEN '{r}'" for n, r in enumerate(BROKEN, 1)) + """ END AS rule, count(*) AS n FROM (SELECT *, CAST(floor(t_ms / 100) AS BIGINT) % 40 AS k FROM t) WHERE k BETWEEN 1 AND 12 GROUP BY ALL
  UNION ALL SELECT device_id, 'speed_metadata', count(*) FROM (SELECT *, CAST(floor(t_ms / 100) AS BIGINT) % 40 AS k FROM v) WHERE protocol <> 'GPCHCX' AND reason <> 'non_gpchcx' AND k <> 1 GROUP BY device_id
  UNION ALL SELECT min(device_id), 'one_device', 1 FROM t)"""))
def import_violations(spark, sf_dir):
    """Export rows, of which one in forty breaks each rule, checked as on import; basic rows that drift have a speed record that doesn't fit."""
    rows = exports.export_rows(project(assess(telemetry(spark, sf_dir))))
    k = F.pmod(F.floor(F.round(F.col("t") * 1000) / 100), F.lit(40))
    at = lambda rule: k == BROKEN.index(rule) + 1
    gps = F.round(F.col("t") * 1000).cast("bigint") - 315_964_800_000 + 18_000
    rows = rows.withColumns({"week": F.floor(gps / 604_800_000).cast("int"), "tow": F.pmod(gps, F.lit(604_800_000)) / 1000})
    change = lambda name, rule, value: F.when(at(rule), value).otherwise(F.col(name))
    spoiled = rows.withColumns({
        "protocol": change("protocol", "protocol", F.lit("GPX")), "data_view": change("data_view", "view", F.lit("raw")), "filter_version": change("filter_version", "version", F.lit(9)),
        "excluded_fields": F.when(at("fields"), "nothing").when(at("excluded_not_null"), "heading").when(at("ranges"), "").otherwise(F.col("excluded_fields")), "filter_reasons": change("filter_reasons", "codes", F.lit("no_such_code")),
        "gx": change("gx", "finite", F.lit(float("inf"))), "nav_mode": change("nav_mode", "integers", F.lit(7)), "tow": F.when(at("tow"), 700_000.0).when(at("gps_time"), F.col("tow") + 1).otherwise(F.col("tow")),
        "lat": change("lat", "ranges", F.lit(95.0)), "age": change("age", "negative_age", F.lit(-1.0))})
    # A wrong protocol contradicts the speed record, and a wrong tow the time: of these rows the first rule is told.
    found = exports.import_violations(spoiled, NOW_S).withColumn("k", F.pmod(F.floor(F.round(F.col("line_t") * 1000) / 100), F.lit(40)))
    also = (F.col("k") == BROKEN.index("protocol") + 1) & (F.col("rule") == "speed_metadata") | (F.col("k") == BROKEN.index("tow") + 1) & (F.col("rule") == "gps_time")
    return found.where(~F.coalesce(also, F.lit(False))).groupBy("device_id", "rule").agg(F.count(F.lit(1)).alias("n"))


# Traceability: orders are component orders, lineitem rows requirements and bindings, parts the part list.
def _requirements(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part_key"), F.col("l_quantity").alias("quantity"), F.col("l_suppkey").alias("operator"), "l_returnflag", "l_shipdate")


def _bindings(spark, sf_dir):
    return _requirements(spark, sf_dir).where("l_returnflag <> 'N'")


@query("SELECT order_key, line, CAST(unit AS INTEGER) AS unit, count(*) AS n FROM (SELECT l_orderkey AS order_key, l_linenumber AS line, unnest(range(1, CAST(l_quantity AS BIGINT) + 1)) AS unit FROM lineitem WHERE l_quantity > 0 AND l_quantity = floor(l_quantity)) GROUP BY ALL")
def requirement_expand(spark, sf_dir):
    return trace.unit_counts(_requirements(spark, sf_dir))


@query("""
SELECT 'duplicate' AS violation, count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey HAVING count(*) > 1)
UNION ALL SELECT 'several_parts', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING min(l_partkey) <> max(l_partkey))""")
def part_violations(spark, sf_dir):
    rows = _requirements(spark, sf_dir).withColumn("sequence", F.col("line").cast("string"))
    return trace.validate_parts(rows).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey AS order_key, min(l_returnflag) <> max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey HAVING min(l_returnflag) <> max(l_returnflag)")
def conflicting_orders(spark, sf_dir):
    return trace.conflicting_orders(_requirements(spark, sf_dir), ["l_returnflag"])


_FULFILMENT = """
WITH r AS (SELECT l_orderkey, count(*) AS required, count(*) FILTER (l_returnflag <> 'N') AS bound FROM lineitem GROUP BY l_orderkey),
f AS (SELECT o_orderkey AS order_key, coalesce(required, 0) AS required, coalesce(bound, 0) AS bound FROM orders LEFT JOIN r ON o_orderkey = l_orderkey),
s AS (SELECT *, CASE WHEN required = 0 THEN 'NO_REQUIREMENTS' WHEN bound = 0 THEN 'NOT_BOUND' WHEN bound < required THEN 'PARTIAL' ELSE 'COMPLETE' END AS state FROM f)"""


@query(_FULFILMENT + "\nSELECT * FROM s")
def fulfilment(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"))
    return trace.fulfilment(orders, _requirements(spark, sf_dir), _bindings(spark, sf_dir))


@query(_FULFILMENT.replace("SELECT o_orderkey AS order_key,", "SELECT o_orderkey AS order_key, o_orderpriority AS site,") + "\nSELECT site, count(*) AS orders, CAST(sum(required) AS BIGINT) AS required, CAST(sum(bound) AS BIGINT) AS bound, count(*) FILTER (state = 'COMPLETE') AS complete FROM s GROUP BY site")
def site_totals(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_orderpriority").alias("site"))
    return trace.site_totals(trace.fulfilment(orders, _requirements(spark, sf_dir), _bindings(spark, sf_dir)))


@query("""
SELECT violation, count(*) AS n FROM (
  SELECT CASE WHEN NOT (q > 0 AND q = floor(q)) THEN 'quantity' END AS violation FROM (SELECT CASE WHEN l_linenumber = 2 THEN l_quantity + 0.5 ELSE l_quantity END AS q FROM lineitem)
  UNION ALL SELECT CASE WHEN l_linenumber = 3 THEN 'missing_part' END FROM lineitem) WHERE violation IS NOT NULL GROUP BY violation""")
def requirement_violations(spark, sf_dir):
    """Half quantities on the second lines, no parts on the third."""
    r = _requirements(spark, sf_dir).withColumn("quantity", F.when(F.col("line") == 2, F.col("quantity") + 0.5).otherwise(F.col("quantity"))).withColumn("part_key", F.when(F.col("line") != 3, F.col("part_key")))
    return trace.expand_requirements(r)[1].groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_partkey AS part_key, count(*) AS n, CAST(sum(CASE WHEN l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') THEN 1 ELSE 0 END) AS BIGINT) AS fulfilled FROM lineitem GROUP BY ALL")
def fulfilled_parts(spark, sf_dir):
    r = trace.with_fulfilled(_requirements(spark, sf_dir), _requirements(spark, sf_dir).where("l_returnflag = 'R'"), ["part_key"])
    return r.groupBy("part_key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("fulfilled").cast("int")).alias("fulfilled"))


@query("SELECT l_suppkey AS operator, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL ORDER BY n DESC, operator LIMIT 8")
def top_operators(spark, sf_dir):
    return trace.top_counts(_bindings(spark, sf_dir), "operator")


@query("SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL ORDER BY day DESC LIMIT 14")
def daily_counts(spark, sf_dir):
    return trace.daily_counts(_bindings(spark, sf_dir).withColumn("day", F.date_format("l_shipdate", "yyyy-MM-dd")), "day")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return trace.latest_per_group(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT p_partkey AS part_key FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1)")
def orphans(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_key"))
    return trace.orphans(parts, _requirements(spark, sf_dir).where("l_returnflag = 'R' AND line = 1"), "part_key")


# Order numbers: 2500 or 4500 and seven digits of the key; a purchase order has lines of four digits.
_NUMBER = "concat(CASE WHEN {k} % 2 = 0 THEN '2500' ELSE '4500' END, lpad(CAST({k} AS VARCHAR), 7, '0'))"


@query(rf"""
WITH s AS (SELECT o_orderkey AS scan_id, {_NUMBER.format(k='o_orderkey')} AS order_no, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE lpad(CAST(1 + o_orderkey % 9 AS VARCHAR), 4, '0') END AS purchase_line,
    lpad(CAST(o_custkey % 5 AS VARCHAR), 4, '0') AS seq, o_orderkey % 11 = 0 AS lost FROM orders),
c AS (SELECT DISTINCT {_NUMBER.format(k='l_orderkey')} AS order_no, CASE WHEN l_orderkey % 2 = 0 THEN '' ELSE lpad(CAST(l_linenumber AS VARCHAR), 4, '0') END AS purchase_line,
    CASE WHEN l_partkey % 3 = 0 THEN '' ELSE lpad(CAST(l_partkey % 5 AS VARCHAR), 4, '0') END AS seq, l_partkey AS part_key, l_returnflag = 'R' AS bound FROM lineitem),
f AS (SELECT order_no, purchase_line, min(part_key) AS lo, max(part_key) AS hi FROM c GROUP BY ALL),
e AS (SELECT order_no, purchase_line, seq, min(part_key) AS p, bool_or(bound) AS bound FROM c GROUP BY ALL)
SELECT scan_id, CASE WHEN lost THEN NULL ELSE coalesce(e.p, b.p, lo) END AS part_key,
  CASE WHEN lost THEN 'unreadable' WHEN e.bound THEN 'duplicate' WHEN lo IS NULL THEN 'unknown' WHEN lo <> hi THEN 'ambiguous' ELSE 'ok' END AS flag
FROM s LEFT JOIN f USING (order_no, purchase_line) LEFT JOIN e ON e.order_no = s.order_no AND e.purchase_line = s.purchase_line AND e.seq = s.seq
  LEFT JOIN e b ON b.order_no = s.order_no AND b.purchase_line = s.purchase_line AND b.seq = ''""")
def scan_resolve(spark, sf_dir):
    """Codes as JSON under several keys, as one run of digits and as groups of digits; some hold no order number."""
    number = lambda k: F.concat(F.when(F.col(k) % 2 == 0, "2500").otherwise("4500"), F.lpad(F.col(k).cast("string"), 7, "0"))
    four = lambda c: F.lpad(c.cast("string"), 4, "0")
    o = table(spark, sf_dir, "orders").withColumns({"no": number("o_orderkey"), "ln": four(1 + F.col("o_orderkey") % 9), "sq": (F.col("o_custkey") % 5).cast("string"), "way": F.floor(F.col("o_orderkey") / 2) % 3})
    line = F.when(F.col("o_orderkey") % 2 == 0, F.lit("")).otherwise(F.col("ln"))
    as_json = F.to_json(F.struct(F.col("no").alias("part_order_no"), line.alias("line_no"), F.concat("sq", F.lit(".0")).alias("serial_no")))
    run = F.concat(F.lit("P/"), "no", F.lit("#"), line, F.lpad("sq", 4, "0"))
    groups = F.concat_ws("-", "no", F.when(line != "", line), F.lpad("sq", 4, "0"))
    code = F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("X-"), "sq")).when(F.col("way") == 0, as_json).when(F.col("way") == 1, run).otherwise(groups)
    scans = o.select(F.col("o_orderkey").alias("scan_id"), code.alias("code"))
    r = _requirements(spark, sf_dir).withColumns({
        "order_no": number("order_key"), "purchase_line": F.when(F.col("order_key") % 2 == 0, F.lit("")).otherwise(four(F.col("line"))), "seq": F.when(F.col("part_key") % 3 == 0, F.lit("")).otherwise(four(F.col("part_key") % 5))})
    found = trace.resolve_scans(scans, r.select("order_no", "purchase_line", "seq", "part_key").distinct(), r.where("l_returnflag = 'R'").select("order_no", "purchase_line", "seq"))
    return found.select("scan_id", "part_key", "flag")


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'PRODUCTION' ELSE 'PURCHASE' END AS kind, count(*) AS n FROM orders GROUP BY ALL")
def order_kinds(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("order_no", F.concat(F.when(F.col("o_orderkey") % 2 == 0, "2500").otherwise("4500"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0")))
    return o.groupBy(trace.order_kind().alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH a AS (SELECT l_partkey AS part_key, l_orderkey AS requirement, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS k FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem)),
b AS (SELECT l_partkey AS part_key, l_orderkey AS binding, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS k FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem WHERE l_returnflag = 'R'))
SELECT b.part_key, b.k, binding, requirement FROM b LEFT JOIN a ON a.part_key = b.part_key AND a.k = b.k""")
def reconcile(spark, sf_dir):
    r = _requirements(spark, sf_dir)
    a = r.select("part_key", F.col("order_key").alias("new_id")).distinct()
    b = r.where("l_returnflag = 'R'").select("part_key", F.col("order_key").alias("old_id")).distinct()
    return trace.reconcile(a, b, ["part_key"], "new_id", "old_id")[0].select("part_key", F.col("k").cast("bigint").alias("k"), "binding", "requirement")


@query("""
WITH a AS (SELECT l_partkey AS part_key, count(*) AS now FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), b AS (SELECT l_partkey AS part_key, count(*) AS bound FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL)
SELECT b.part_key, bound, now FROM b LEFT JOIN a USING (part_key) WHERE coalesce(now, 0) < bound""")
def reconcile_violations(spark, sf_dir):
    """Keys of which fewer are required than are bound."""
    r = _requirements(spark, sf_dir)
    a = r.where("l_returnflag = 'R'").select("part_key", F.col("order_key").alias("new_id"))
    b = r.where("l_returnflag <> 'R'").select("part_key", F.col("order_key").alias("old_id"))
    return trace.reconcile(a, b, ["part_key"], "new_id", "old_id")[1].select("part_key", "bound", "now")


@query("SELECT p_partkey AS part_key, l_orderkey AS order_key, l_suppkey AS batch_key, s_name AS batch_name FROM part LEFT JOIN (SELECT DISTINCT l_partkey, l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A') ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey")
def genealogy(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_key"))
    bindings = _requirements(spark, sf_dir).where("l_returnflag = 'A'").select("part_key", "order_key", F.col("operator").alias("batch_key")).distinct()
    batches = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("batch_key"), F.col("s_name").alias("batch_name"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"))
    return trace.genealogy(parts, bindings, batches, orders).select("part_key", "order_key", "batch_key", "batch_name")


@query("SELECT o_custkey AS unit_key, array_to_string(list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderdate, o_orderkey), ',') AS events FROM orders GROUP BY o_custkey")
def unit_history(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit_key"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("event_key"), F.col("o_orderstatus").alias("kind"))
    return trace.unit_history(o.select("unit_key").distinct(), o).select("unit_key", F.array_join(F.transform("events", lambda e: e["event_key"].cast("string")), ",").alias("events"))


@query("""
SELECT 'detail' AS report, CAST(l_suppkey AS VARCHAR) AS item, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL
UNION ALL SELECT 'batches', CAST(l_suppkey AS VARCHAR), count(*) FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL
UNION ALL SELECT 'requirements', CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_partkey AS VARCHAR), CAST(sum(l_quantity) AS BIGINT) FROM lineitem GROUP BY l_orderkey, l_partkey
UNION ALL SELECT 'stock', p_brand || '/' || CASE WHEN p_size > 25 THEN 'BOUND' ELSE 'PLANNED' END, count(*) FROM part GROUP BY ALL
UNION ALL SELECT 'unbound', CAST(l_suppkey AS VARCHAR), count(*) FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL""")
def binding_report(spark, sf_dir):
    """All five reports, told by item and number."""
    batches = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("batch_key"))
    rows = _requirements(spark, sf_dir).withColumn("batch_key", F.col("operator"))
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("part_code"), F.when(F.col("p_size") > 25, "BOUND").otherwise("PLANNED").alias("state"))
    r = trace.binding_report(batches, rows.where("l_returnflag <> 'N'"), rows, parts, rows.where("l_returnflag = 'N'"))
    key, n = F.col("batch_key").cast("string"), F.count(F.lit(1)).alias("n")
    out = r["detail"].groupBy(key.alias("item")).agg(n).withColumn("report", F.lit("detail"))
    out = out.unionByName(r["batches"].select(key.alias("item"), F.col("bound").alias("n"), F.lit("batches").alias("report")))
    out = out.unionByName(r["requirements"].select(F.concat_ws("/", "order_key", "part_key").alias("item"), F.col("quantity").cast("bigint").alias("n"), F.lit("requirements").alias("report")))
    out = out.unionByName(r["stock"].select(F.concat_ws("/", "part_code", "state").alias("item"), "n", F.lit("stock").alias("report")))
    return out.unionByName(r["unbound"].groupBy(key.alias("item")).agg(n).withColumn("report", F.lit("unbound")))


@query("""
SELECT 'site' AS board, n_name AS item, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE l_returnflag <> 'N' GROUP BY n_name
UNION ALL SELECT 'method', CASE WHEN l_linestatus = 'F' THEN 'scan' ELSE 'manual' END, count(*) FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL""")
def trace_dashboard(spark, sf_dir):
    """Bindings by site and by input method."""
    sites = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("operator"), F.col("n_name").alias("site"))
    status = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_suppkey").alias("operator"), F.when(F.col("l_linestatus") == "F", "scan").otherwise("manual").alias("method"))
    by = lambda board, df: trace.top_counts(df, board, 1_000).select(F.lit(board).alias("board"), F.col(board).alias("item"), "n")
    return by("site", status.join(sites, "operator")).unionByName(by("method", status))


@query("""
WITH r AS (SELECT p_brand AS component, count(*) AS required, count(*) FILTER (l_returnflag <> 'N') AS bound FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand)
SELECT * FROM r ORDER BY required DESC, component LIMIT 8""")
def component_progress(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_key"), F.col("p_brand").alias("component"))
    return trace.component_progress(_requirements(spark, sf_dir).join(parts, "part_key"), _bindings(spark, sf_dir).join(parts, "part_key"))


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) < (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - 180")
def old_snapshots(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    return trace.old_snapshots(o, str(o.agg(F.max("day")).first()[0])).select("o_orderkey")


@query("""
WITH d AS (SELECT o_orderpriority AS site, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS bytes FROM orders GROUP BY ALL),
e AS (SELECT site, min(day) AS a, max(day) AS b, arg_min(bytes, day) AS x, arg_max(bytes, day) AS y FROM d GROUP BY site)
SELECT site, CASE WHEN b - a >= 1 AND y > x THEN 'MEASURED' ELSE 'CONSERVATIVE' END AS basis, CASE WHEN y / 1000000.0 >= 0.9 THEN 'CRITICAL' WHEN y / 1000000.0 >= 0.8 THEN 'HIGH' WHEN y / 1000000.0 >= 0.7 THEN 'WATCH' ELSE 'OK' END AS level,
  round(greatest(0.0, 1000000.0 - y) / CASE WHEN b - a >= 1 AND y > x THEN (y - x) / (b - a) ELSE 1000.0 END, 3) + 0.0 AS days_left FROM e""")
def forecast(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("site"), F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("bytes"))
    return rounded(trace.growth_forecast(o, 1_000_000.0, 1000.0).select("site", "basis", "level", "days_left"), 3)


@query("SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'F') AS n_f FROM orders GROUP BY o_custkey")
def status_totals(spark, sf_dir):
    return trace.status_totals(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ["O", "F"])


@query("SELECT p_partkey, p_name FROM part WHERE (contains(lower(p_name), 'a') OR contains(lower(p_brand), 'a')) AND p_brand = (SELECT min(p_brand) FROM part)")
def record_search(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return trace.search(parts, "A", ["p_name", "p_brand"], ("p_brand", parts.agg(F.min("p_brand")).first()[0])).select("p_partkey", "p_name")


@query("""SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) > 60 AS has_more, CAST(2 AS INTEGER) AS page FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40)
UNION ALL SELECT o_orderkey, o_totalprice, false, CAST((SELECT (count(*) - 1) // 20 FROM orders) AS INTEGER) FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey OFFSET (SELECT (count(*) - 1) // 20 * 20 FROM orders))""")
def paged_orders(spark, sf_dir):
    """The third page, and the last in place of one beyond the end."""
    page = lambda k: series.page(table(spark, sf_dir, "orders"), [F.desc("o_totalprice"), "o_orderkey"], k, 20).select("o_orderkey", "o_totalprice", "has_more", "page")
    return page(2).unionByName(page(1_000_000))


@query("""
WITH k AS (SELECT o_orderdate AS d, o_orderkey AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC OFFSET 30 LIMIT 1)
SELECT o_orderdate, o_orderkey FROM orders, k WHERE o_orderdate < d OR (o_orderdate = d AND o_orderkey < id) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25""")
def keyset_orders(spark, sf_dir):
    """The page after the last row of a page."""
    o = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey")
    before = series.keyset_page(o, ["o_orderdate", "o_orderkey"], None, 31).orderBy("o_orderdate", "o_orderkey").first()
    return series.keyset_page(o, ["o_orderdate", "o_orderkey"], (before[0], before[1]), 25)


@query("SELECT c_custkey AS id, c_acctbal AS risk FROM customer WHERE contains(lower(concat_ws(' ', c_name, c_mktsegment)), 'build') ORDER BY c_acctbal DESC, c_custkey")
def fleet_rank(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("risk"), "c_name", "c_mktsegment")
    return series.rank_fleet(c, "BUILD", None, "risk", ["c_name", "c_mktsegment"]).select("id", "risk")


@query("SELECT l_suppkey, CAST(least(100, floor((count(*) FILTER (l_returnflag = 'R') + count(*) FILTER (l_returnflag = 'A')) / (2.0::DOUBLE * count(*)) * 100 + 0.5)) AS INTEGER) AS rate FROM lineitem GROUP BY l_suppkey")
def inspection_rate(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("a"), F.count_if(F.col("l_returnflag") == "A").alias("b"), F.count(F.lit(1)).alias("c"))
    return g.select("l_suppkey", capped_rate("a", "b", "c").alias("rate"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, CAST(1 + event_id % 3 AS INTEGER) AS items, contains(lower(event_type), 'c') AS has_c, CASE WHEN starts_with(event_type, 'c') THEN substr(event_type, 2) ELSE event_type END AS stripped FROM events")
def text_functions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    listed = F.to_json(F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int")))
    return e.select("event_id", json_text("props", "$.k").alias("k"), json_length(listed).alias("items"), contains_ci("event_type", "C").alias("has_c"), process_no("event_type", F.lit("c")).alias("stripped"))


@query(r"""
WITH s AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN concat(' ', CAST(l_partkey AS VARCHAR), ' ') WHEN 1 THEN CAST(l_linenumber AS VARCHAR) WHEN 2 THEN concat('x', CAST(l_linenumber AS VARCHAR)) ELSE concat(CAST(l_partkey AS VARCHAR), '.00') END AS code FROM lineitem)
SELECT l_orderkey, l_linenumber, code, CASE WHEN regexp_full_match(trim(code), '[0-9]{1,4}') THEN lpad(trim(code), 4, '0') END AS sequence,
  CASE WHEN regexp_full_match(regexp_replace(trim(code), '^([0-9]+)\.0+$', '\1'), '[0-9]+') THEN regexp_replace(trim(code), '^([0-9]+)\.0+$', '\1') END AS digits,
  CASE WHEN regexp_full_match(regexp_replace(trim(code), '^([0-9]+)\.0+$', '\1'), '[12][0-9]*') THEN regexp_replace(trim(code), '^([0-9]+)\.0+$', '\1') END AS prefixed
FROM s""")
def sequence_numbers(spark, sf_dir):
    line, part = F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")
    code = F.when(F.col("l_linenumber") % 4 == 0, F.concat(F.lit(" "), part, F.lit(" "))).when(F.col("l_linenumber") % 4 == 1, line).when(F.col("l_linenumber") % 4 == 2, F.concat(F.lit("x"), line)).otherwise(F.concat(part, F.lit(".00")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", code.alias("code"), norm_sequence(code).alias("sequence"), norm_digits(code).alias("digits"), norm_digits(code, ("1", "2")).alias("prefixed"))


@query("SELECT p_partkey, replace(replace(p_name, 'a', 'A'), 'e', '3') AS p_name, replace(replace(p_type, 'a', 'A'), 'e', '3') AS p_type FROM part")
def repaired_text(spark, sf_dir):
    return repair_text(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), [("a", "A"), ("e", "3")])


@query("SELECT DISTINCT code FROM (SELECT unnest(string_split(p_type, ' ')) AS code FROM part) WHERE code <> '' AND code <> (SELECT max(p_type) FROM part) AND code NOT IN ('STANDARD', 'SMALL', 'COPPER')")
def unknown_codes(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.replace("p_type", F.lit(" "), F.lit("|")).alias("codes"))
    return rollup.unknown_codes(parts, "codes", ["STANDARD", "SMALL", "COPPER"])


@query(sql("\nSELECT device_id, round(sum((heading - course + 180) - 360 * floor((heading - course + 180) / 360) - 180), 3) + 0.0 AS total, max((heading - course + 180) - 360 * floor((heading - course + 180) / 360) - 180) AS most, min((heading - course + 180) - 360 * floor((heading - course + 180) / 360) - 180) AS least FROM t GROUP BY device_id"))
def heading_course(spark, sf_dir):
    """Heading against course on the circle."""
    d = angle_delta("heading", "course")
    return rounded(telemetry(spark, sf_dir).groupBy("device_id").agg(F.sum(d).alias("total"), F.max(d).alias("most"), F.min(d).alias("least")), 3)


@query("SELECT l_returnflag AS name, count(*) AS n FROM lineitem GROUP BY ALL")
def summed_counters(spark, sf_dir):
    """Counter maps of orders, added up."""
    each = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    maps = each.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "n"))).alias("counters"))
    return audit.sum_counters(maps)


@query("""
WITH f AS (SELECT concat('log', CAST(o_custkey % 20 AS VARCHAR)) AS source, o_orderkey * 100 AS place, CASE WHEN o_orderkey % 5 = 0 THEN 'GPCHCX' ELSE 'GPAUX' END AS name, o_orderkey % 7 <> 0 AS ok FROM orders),
g AS (SELECT *, last_value(CASE WHEN name = 'GPCHCX' THEN place END IGNORE NULLS) OVER (PARTITION BY source ORDER BY place) AS timed FROM f)
SELECT source, name, count(*) AS n, count(*) FILTER (NOT ok) AS bad, count(DISTINCT timed) AS timed FROM g GROUP BY ALL""")
def stream_audit(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    f = o.select(F.concat(F.lit("log"), (F.col("o_custkey") % 20).cast("string")).alias("source"), (F.col("o_orderkey") * 100).alias("source_offset"), F.when(F.col("o_orderkey") % 5 == 0, "GPCHCX").otherwise("GPAUX").alias("name"), (F.col("o_orderkey") % 7 != 0).alias("checksum_ok"))
    return audit.stream_audit(f)


@query(sql(f"""
SELECT concat('telemetry/', device_id) AS source, CAST(floor((t_ms - 315964800000 + 18000) / 604800000) AS INTEGER) AS week, upper(concat(to_hex(fix_mode), to_hex(nav_mode))) AS status_text, count(*) AS n FROM t WHERE NOT {_SPOILED} BETWEEN 1 AND 14 GROUP BY ALL"""))
def stream_histogram(spark, sf_dir):
    return audit.stream_histogram(frames.decode_points(_frames(spark, sf_dir), NOW_S).where("reject_reason IS NULL"))


@query(sql("\nSELECT strftime(make_timestamp((t_ms + 28800000) * 1000), '%Y-%m-%d') AS day, count(*) AS n FROM t GROUP BY ALL"))
def local_days(spark, sf_dir):
    return telemetry(spark, sf_dir).groupBy(local_day("t_ms").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, greatest(a, b) AS v FROM (SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS a, CAST(floor(c_acctbal) + (CASE WHEN c_custkey % 3 = 0 THEN 10 ELSE -10 END) AS BIGINT) AS b FROM customer WHERE c_custkey % 2 = 0) UNION ALL SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) FROM customer WHERE c_custkey % 2 = 1")
def merged_package(spark, sf_dir):
    """Two versions of half of the rows; the greater version wins."""
    c = table(spark, sf_dir, "customer")
    old = c.select("c_custkey", F.floor("c_acctbal").alias("v"))
    new = c.where("c_custkey % 2 = 0").select("c_custkey", (F.floor("c_acctbal") + F.when(F.col("c_custkey") % 3 == 0, 10).otherwise(-10)).alias("v"))
    return lifecycle.merge_package(old, new, ["c_custkey"], "v").select("c_custkey", "v")


@query("""
WITH f AS (SELECT concat('f', CAST(o_orderkey AS VARCHAR)) AS path, CAST(o_orderdate AS DATE) AS day, CAST(epoch_ms(o_orderdate) AS BIGINT) AS mtime_ms, CAST(floor(o_totalprice) AS BIGINT) AS bytes, o_orderstatus = 'P' AS pending FROM orders),
e AS (SELECT *, NOT pending AND mtime_ms < 883612800000 AS eligible FROM f),
r AS (SELECT *, coalesce(sum(CASE WHEN eligible THEN bytes ELSE 0 END) OVER (ORDER BY day, mtime_ms, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM e)
SELECT path, eligible, CAST(freed AS BIGINT) AS freed_before, eligible AND freed < 50000000 AS "delete" FROM r""")
def retention_plan(spark, sf_dir):
    f = table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("path"), F.to_date("o_orderdate").alias("day"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000).cast("bigint").alias("mtime_ms"), F.floor("o_totalprice").alias("bytes"), F.lit(0).cast("bigint").alias("last_point_ms"), (F.col("o_orderstatus") == "P").alias("pending"))
    plan = lifecycle.retention_plan(f, used=800_000_000.0, total=1_000_000_000.0, now_ms=883612800000 + 86_400_000)
    return plan.select("path", "eligible", F.col("freed_before").cast("bigint").alias("freed_before"), "delete")


@query("SELECT s_suppkey AS device_id, CASE WHEN s_suppkey % 3 = 0 THEN 85.0::DOUBLE WHEN s_suppkey % 3 = 1 THEN 80.0 ELSE 90.0 END AS speed_kmh, CAST(1 + CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS version FROM supplier")
def rule_migration(spark, sf_dir):
    """A third of the devices have the legacy thresholds, a third all but one, a third their own."""
    from ..functions.constants import LEGACY_RULES

    d = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("device_id"), F.lit(1).alias("version"))
    own = {k: F.lit(v) for k, v in LEGACY_RULES.items()} | {"speed_kmh": F.when(F.col("device_id") % 3 == 2, 90.0).otherwise(80.0), "roll_deg": F.when(F.col("device_id") % 3 == 1, 16.0).otherwise(15.0)}
    return lifecycle.migrate_rules(d.withColumns(own))[0].select("device_id", "speed_kmh", "version")
