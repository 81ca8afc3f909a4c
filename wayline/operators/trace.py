"""Part traceability: requirements, fulfilment, scans, genealogy and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import norm_digits, norm_sequence


def expand_requirements(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for each unit of an integer quantity, and the violations (quantity, missing part)."""
    whole = (F.col("quantity") > 0) & (F.col("quantity") == F.floor("quantity"))
    bad = F.array_compact(F.array(F.when(~F.coalesce(whole, F.lit(False)), "quantity"), F.when(F.col("part_key").isNull(), "missing_part")))
    good = rows.where(whole).withColumn("unit", F.explode(F.sequence(F.lit(1), F.col("quantity").cast("int"))))
    return good, rows.select("order_key", "line", F.explode(bad).alias("violation"))


def unit_counts(rows: DataFrame) -> DataFrame:
    """order_key, line, unit and n: how many requirements of a line have a unit. Units are made after lines have met, so that none is shuffled."""
    good = rows.where((F.col("quantity") > 0) & (F.col("quantity") == F.floor("quantity")))
    same = good.groupBy("order_key", "line", "quantity").agg(F.count(F.lit(1)).alias("n"))
    lines = same.groupBy("order_key", "line").agg(F.max("quantity").alias("quantity"), F.lit(0).alias("part_key"), F.collect_list(F.struct("quantity", "n")).alias("_of"))
    reach = F.aggregate(F.filter("_of", lambda q: q["quantity"] >= F.col("unit")), F.lit(0).cast("bigint"), lambda a, q: a + q["n"])
    return expand_requirements(lines)[0].select("order_key", "line", "unit", reach.alias("n"))


def conflicting_orders(rows: DataFrame, attributes: list[str]) -> DataFrame:
    """Orders whose lines disagree on an attribute."""
    n = rows.groupBy("order_key").agg(*[(F.min(a) != F.max(a)).alias(a) for a in attributes])
    return n.where(F.exists(F.array(*attributes), lambda x: F.coalesce(x, F.lit(False))))


def validate_parts(rows: DataFrame) -> DataFrame:
    """order_key, line and violation: duplicate keys, several parts on a line, blank sequence."""
    keys = rows.groupBy("order_key", "line", "part_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("order_key", "line", F.lit("duplicate").alias("violation"))
    many = rows.groupBy("order_key", "line").agg((F.min("part_key") != F.max("part_key")).alias("m")).where("m").select("order_key", "line", F.lit("several_parts").alias("violation"))
    blank = rows.where(F.trim(F.coalesce("sequence", F.lit(""))) == "").select("order_key", "line", F.lit("blank_sequence").alias("violation")).distinct()
    return keys.unionByName(many).unionByName(blank)


def order_kind(order_no: str = "order_no"):
    """PRODUCTION or PURCHASE by the prefix of an order number, else null."""
    return F.when(F.startswith(F.col(order_no), F.lit("2500")), "PRODUCTION").when(F.startswith(F.col(order_no), F.lit("4500")), "PURCHASE")


def site_totals(fulfilled: DataFrame) -> DataFrame:
    """Orders, required, bound and complete orders of each site."""
    return fulfilled.groupBy("site").agg(F.count(F.lit(1)).alias("orders"), F.sum("required").alias("required"), F.sum("bound").alias("bound"), F.count_if(F.col("state") == "COMPLETE").alias("complete"))


def fulfilment(orders: DataFrame, requirements: DataFrame, bindings: DataFrame) -> DataFrame:
    """required, bound and state of each order."""
    r = requirements.groupBy("order_key").agg(F.count(F.lit(1)).alias("required"))
    b = bindings.groupBy("order_key").agg(F.count(F.lit(1)).alias("bound"))
    df = orders.join(r, "order_key", "left").join(b, "order_key", "left").withColumns({"required": F.coalesce("required", F.lit(0)), "bound": F.coalesce("bound", F.lit(0))})
    state = F.when(F.col("required") == 0, "NO_REQUIREMENTS").when(F.col("bound") == 0, "NOT_BOUND").when(F.col("bound") < F.col("required"), "PARTIAL").otherwise("COMPLETE")
    return df.withColumn("state", state)


def with_fulfilled(requirements: DataFrame, bindings: DataFrame, keys: list[str]) -> DataFrame:
    have = bindings.select(*keys).distinct().withColumn("_have", F.lit(True))
    return requirements.join(have, keys, "left").withColumn("fulfilled", F.coalesce("_have", F.lit(False))).drop("_have")


def top_counts(rows: DataFrame, key: str, k: int = 8) -> DataFrame:
    """The k most frequent keys (top k is the feature)."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(k)


def daily_counts(rows: DataFrame, day: str, k: int = 14) -> DataFrame:
    """Counts of the last k days, ascending (the number of days is the feature)."""
    return rows.groupBy(day).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc(day)).limit(k).orderBy(day)


def latest_per_group(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    cols = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def parsed_scans(scans: DataFrame) -> DataFrame:
    """scans (scan_id, code) with order_no, purchase_line and seq: from JSON keys, or from the digits of the code.

    An order number begins with 2500 (production) or 4500 (purchase); of a production order the line is empty.
    """
    text = F.trim(F.coalesce("code", F.lit("")))
    key = lambda *names: F.coalesce(*[F.when(F.trim(F.get_json_object("_json", f"$.{n}")) != "", F.trim(F.get_json_object("_json", f"$.{n}"))) for n in names], F.lit(""))
    df = scans.withColumn("_text", text).withColumn("_json", F.when(F.startswith("_text", F.lit("{")), F.col("_text")))
    df = df.withColumns({
        "_order": key("part_order_no", "production_order", "purchase_order"), "_line": F.replace(key("purchase_line", "line_no", "line"), F.lit(".0"), F.lit("")),
        "_seq": F.replace(key("sequence_no", "serial_no", "sequence"), F.lit(".0"), F.lit("")), "_digits": F.regexp_replace("_text", "[^0-9]", ""), "_tokens": F.regexp_extract_all("_text", F.lit("([0-9]+)"), F.lit(1))})
    run, tail = F.regexp_extract("_digits", "((?:2500|4500)[0-9]{7})(.*)$", 1), F.regexp_extract("_digits", "((?:2500|4500)[0-9]{7})(.*)$", 2)
    df = df.withColumns({"_run": F.when(F.col("_order") == "", run).otherwise(""), "_tail": tail})
    long_ = F.length("_tail")
    production, purchase = F.startswith("_run", F.lit("2500")), F.startswith("_run", F.lit("4500"))
    df = df.withColumns({
        "_order": F.when(F.col("_run") != "", F.col("_run")).otherwise(F.col("_order")),
        "_seq": F.when((production & (long_ >= 4)) | (purchase & (long_ >= 8)), F.right("_tail", F.lit(4))).otherwise(F.col("_seq")),
        "_line": F.when(purchase & (long_ >= 8), F.expr("substring(_tail, length(_tail) - 7, 4)")).otherwise(F.col("_line"))})
    named = F.get(F.filter("_tokens", lambda t: t.rlike("^(2500|4500)")), 0)
    df = df.withColumn("_order", F.when(F.col("_order") == "", F.coalesce(named, F.lit(""))).otherwise(F.col("_order")))
    n, is_production, is_purchase = F.size("_tokens"), F.startswith("_order", F.lit("2500")), F.startswith("_order", F.lit("4500"))
    last, second = F.try_element_at("_tokens", F.lit(-1)), F.try_element_at("_tokens", F.lit(-2))
    blank = F.col("_seq") == ""
    df = df.withColumns({
        "_seq": F.when(blank & ((is_production & (n >= 2)) | (is_purchase & (n >= 3))), last).otherwise(F.col("_seq")),
        "_line": F.when((F.col("_line") == "") & is_purchase & (n >= 3), second).otherwise(F.col("_line"))})
    known = is_production | is_purchase
    out = df.withColumns({"order_no": F.when(known, F.col("_order")), "seq": norm_sequence("_seq"), "purchase_line": F.when(is_purchase, norm_digits("_line")).when(is_production, "")})
    return out.drop("_text", "_json", "_order", "_line", "_seq", "_digits", "_tokens", "_run", "_tail")


def resolve_scans(scans: DataFrame, catalog: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    """scans with the catalog row (order_no, purchase_line, seq, part_key) that fits best and a flag.

    An exact sequence goes before a blank one and that before others. Flags: unreadable, incomplete, duplicate (its
    part is among those bound), unknown, ambiguous (several parts on the line), ok.
    """
    df = parsed_scans(scans)
    lines = catalog.groupBy("order_no", "purchase_line").agg(F.min("part_key").alias("_least"), F.max("part_key").alias("_most"))
    exact = catalog.groupBy("order_no", "purchase_line", "seq").agg(F.min("part_key").alias("_exact"))
    blank = catalog.where(F.coalesce("seq", F.lit("")) == "").groupBy("order_no", "purchase_line").agg(F.min("part_key").alias("_blank"))
    key = ["order_no", "purchase_line"]
    df = df.join(lines, key, "left").join(exact, [*key, "seq"], "left").join(blank, key, "left")
    again = F.lit(False)
    if bound is not None:
        df = df.join(bound.select(*key, "seq").distinct().withColumn("_bound", F.lit(True)), [*key, "seq"], "left")
        again = F.col("_bound").isNotNull()
    flag = (
        F.when(F.col("order_no").isNull(), "unreadable").when(F.col("seq").isNull() | F.col("purchase_line").isNull(), "incomplete").when(again, "duplicate")
        .when(F.col("_least").isNull(), "unknown").when(F.col("_least") != F.col("_most"), "ambiguous").otherwise("ok"))
    return df.withColumn("part_key", F.coalesce("_exact", "_blank", "_least")).withColumn("flag", flag).drop("_least", "_most", "_exact", "_blank", "_bound")


def reconcile(required: DataFrame, bindings: DataFrame, keys: list[str], new_id: str, old_id: str) -> tuple[DataFrame, DataFrame]:
    """The k-th old binding of a key with its k-th new requirement, and the keys whose count shrinks."""
    rank = lambda c: F.row_number().over(Window.partitionBy(*keys).orderBy(c))
    a = required.select(*keys, F.col(new_id).alias("requirement"), rank(new_id).alias("k"))
    b = bindings.select(*keys, F.col(old_id).alias("binding"), rank(old_id).alias("k"))
    n = required.groupBy(*keys).agg(F.count(F.lit(1)).alias("now"))
    m = bindings.groupBy(*keys).agg(F.count(F.lit(1)).alias("bound"))
    return b.join(a, [*keys, "k"], "left"), m.join(n, keys, "left").where(F.coalesce("now", F.lit(0)) < F.col("bound"))


def genealogy(parts: DataFrame, bindings: DataFrame, batches: DataFrame, orders: DataFrame) -> DataFrame:
    """parts with their binding, its batch and order (left joins)."""
    return parts.join(bindings, "part_key", "left").join(batches, "batch_key", "left").join(orders, "order_key", "left")


def unit_history(units: DataFrame, events: DataFrame) -> DataFrame:
    """units with their events in order, as an array."""
    listed = events.groupBy("unit_key").agg(F.sort_array(F.collect_list(F.struct("at", "event_key", "kind"))).alias("events"))
    return units.join(listed, "unit_key", "left")


def binding_report(batches: DataFrame, bindings: DataFrame, requirements: DataFrame, parts: DataFrame, log: DataFrame) -> dict[str, DataFrame]:
    """detail, batches with a binding (with its number), requirements by part, stock of parts by state, and the log of those taken off."""
    held = bindings.groupBy("batch_key").agg(F.count(F.lit(1)).alias("bound"))
    return {
        "detail": bindings.join(batches, "batch_key"),
        "batches": batches.join(held, "batch_key"),
        "requirements": requirements.groupBy("order_key", "part_key").agg(F.sum("quantity").alias("quantity")),
        "stock": parts.groupBy("part_code", "state").agg(F.count(F.lit(1)).alias("n")),
        "unbound": log.join(batches, "batch_key", "left")}


def component_progress(requirements: DataFrame, bindings: DataFrame, k: int = 8) -> DataFrame:
    """Components required and bound, the k most required (top k is the feature)."""
    need = requirements.groupBy("component").agg(F.count(F.lit(1)).alias("required"))
    have = bindings.groupBy("component").agg(F.count(F.lit(1)).alias("bound"))
    return need.join(have, "component", "left").select("component", "required", F.coalesce("bound", F.lit(0)).alias("bound")).orderBy(F.desc("required"), "component").limit(k)


def old_snapshots(snapshots: DataFrame, today: str, days: int = 180) -> DataFrame:
    return snapshots.where(F.col("day") < F.date_sub(F.lit(today).cast("date"), days))


def unbind(bindings: DataFrame, ids: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bindings that stay, the log of those taken off, and the parts set free."""
    gone = bindings.join(ids, "binding_id", "left_semi")
    free = parts.join(gone.select("part_key").distinct().withColumn("_f", F.lit(True)), "part_key", "left").withColumn("state", F.when(F.col("_f"), "AVAILABLE").otherwise(F.col("state"))).drop("_f")
    return bindings.join(ids, "binding_id", "left_anti"), gone, free


def orphans(parts: DataFrame, bindings: DataFrame, key: str) -> DataFrame:
    return parts.join(bindings.select(key), key, "left_anti")


def search(df: DataFrame, text: str, columns: list[str], site: tuple[str, str] | None = None) -> DataFrame:
    """Rows one of whose columns contains the text, of a site (column, value) if given."""
    df = df if site is None else df.where(F.col(site[0]) == site[1])
    return df.where(F.exists(F.array(*[F.lower(F.col(c).cast("string")) for c in columns]), lambda x: F.contains(x, F.lit(text.lower()))))


def growth_forecast(snapshots: DataFrame, limit: float, conservative: float) -> DataFrame:
    """Daily growth of each site, days to the limit, its basis and the level of use."""
    df = snapshots.groupBy("site").agg(F.min_by(F.struct("day", "bytes"), "day").alias("a"), F.max_by(F.struct("day", "bytes"), "day").alias("b"))
    days = F.datediff("b.day", "a.day")
    measured = (days >= 1) & (F.col("b.bytes") > F.col("a.bytes"))
    growth = F.when(measured, (F.col("b.bytes") - F.col("a.bytes")) / days).otherwise(conservative)
    used = F.col("b.bytes") / limit
    level = F.when(used >= 0.9, "CRITICAL").when(used >= 0.8, "HIGH").when(used >= 0.7, "WATCH").otherwise("OK")
    return df.select("site", growth.alias("daily"), F.greatest(F.lit(0.0), (limit - F.col("b.bytes")) / growth).alias("days_left"), F.when(measured, "MEASURED").otherwise("CONSERVATIVE").alias("basis"), level.alias("level"))


def status_totals(parts: DataFrame, key: str, status: str, values: list[str]) -> DataFrame:
    return parts.groupBy(key).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(status) == v).alias(f"n_{v.lower()}") for v in values])
