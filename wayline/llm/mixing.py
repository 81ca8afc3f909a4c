"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target of words. Within a source a document is expected the more
often the longer it is: in proportion to the bits of its size (its size class), up to
``most_copies`` times, so that the source's words come to the target. The whole part of
that number is certain: the document is taken so many times. For the rest p, which
differs from document to document, it draws a number U in (0, 1) and is ranked by its
random odds U / (1 - U) divided by its inclusion odds p / (1 - p); the first in rank
fill the words that are still open. What the next in rank would exceed is filled by the
one document, of those not drawn, whose size comes nearest to it, if any comes nearer
than none.

A source may hold a third of all rows, so no source is sorted whole: ranks are cut
into ``BINS`` bins, words are summed by bin, and only the documents of the bin in which
the cut falls are sorted. U is a hash of the id, so reruns agree. No text is shuffled.

Null ids draw as the word null; repeated rows draw alike and are taken by themselves.
Null and empty texts have size 0 and are taken 0 words; very long texts are sizes like
others. Ties of rank go by id and size. The null source is a source, the last. An empty
table gives no rows. Further columns of any name are carried through by ``sample``.
Uses DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, same, table

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = "mix-1"
BINS = 4096
#: Sources up to which the table of sources is broadcast (below 10 MB); above, Spark joins by shuffle.
SMALL = 50_000


def words_in(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_copies: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target of each source in sizes (source, source_size): a row a source, in name order.

    Shares are filled like connected vessels: with the sources in the order of
    cap / weight, a source is at its cap if the level that it would get with all
    later ones, after all earlier ones took their caps, reaches its own.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_rank", F.row_number().over(everything) - 1)
    ranked = ranked.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", most_copies * F.col("source_size"))
    filling = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_rank"))
    to_here = filling.rowsBetween(Window.unboundedPreceding, -1)
    onwards = filling.rowsBetween(0, Window.unboundedFollowing)
    whole = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumn("_open", F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(to_here), F.lit(0)))
    ranked = ranked.withColumn("_rest", F.sum("_w").over(onwards))
    ranked = ranked.withColumn("_full", F.col("_open") * F.col("_w") >= F.col("_cap") * F.col("_rest"))
    level = F.first(F.when(~F.col("_full"), F.col("_open") / F.col("_rest")), ignorenulls=True).over(whole)
    return ranked.select("source", "source_size", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.col("_w") * level).alias("target"))


def expected(classes: DataFrame, most_copies: int = MOST_COPIES) -> DataFrame:
    """classes (_key, weight, words, target) with ``copies``, the expected copies of a document of each class.

    Of each source: copies = min(most_copies, level * weight), at the level at which the
    words come to the target. Classes fill in the order of their weight, the heaviest first.
    """
    filling = Window.partitionBy("_key").orderBy(F.desc("weight"))
    before = F.coalesce(F.sum("words").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onwards = F.sum(F.col("weight") * F.col("words")).over(filling.rowsBetween(0, Window.unboundedFollowing))
    level = F.when(onwards > 0, (F.col("target") - most_copies * before) / onwards).otherwise(0.0)
    ranked = classes.withColumn("_level", level).withColumn("_full", F.col("_level") * F.col("weight") >= most_copies)
    open_ = F.first(F.when(~F.col("_full"), F.col("_level")), ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ranked.withColumn("copies", F.when(F.col("_full"), float(most_copies)).otherwise(F.greatest(F.lit(0.0), open_ * F.col("weight")))).drop("_level", "_full")


def sample(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_copies: int = MOST_COPIES, seed: str = SEED, bins: int = BINS) -> DataFrame:
    """rows (doc_id, source, size, any more) with source_size, target, copies and taken."""
    more = [c for c in rows.columns if c not in ("doc_id", "source", "size")]
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source")))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")), 1, 12), 16, 10).cast("double")
    rows = rows.select("doc_id", "source", "size", (F.struct(*more) if more else F.lit(None)).alias("_more"), key.alias("_key"), ((draw + 0.5) / float(1 << 48)).alias("_u"), F.length(F.bin("size")).alias("weight"))
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    by_class = cut(rows.groupBy("_key", "source", "weight").agg(F.sum("size").alias("words")))
    goals = cut(targets(by_class.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most_copies).withColumn("_key", key).drop("source"))
    classes = expected(by_class.drop("source").join(goals, "_key"), most_copies)
    # A number of copies a little short of a whole one by rounding is that whole one.
    whole = F.floor(F.col("copies") + 1e-9)
    classes = classes.withColumn("_certain", whole.cast("long")).withColumn("_p", F.greatest(F.lit(0.0), F.col("copies") - whole)).drop("copies")
    open_words = F.col("target") - F.sum(F.col("_certain") * F.col("words")).over(Window.partitionBy("_key"))
    classes = cut(classes.withColumn("_want", open_words).drop("words"))
    small = F.broadcast if classes.count() <= SMALL else (lambda df: df)
    # Odds against odds; the rank of equal odds is put on (0, 1) again to choose a bin.
    rank = F.when(F.col("_p") <= 0, F.lit(float("inf"))).otherwise(F.col("_u") / (1 - F.col("_u")) / (F.col("_p") / (1 - F.col("_p"))))
    even = F.when(F.col("_p") <= 0, F.lit(1.0)).otherwise(F.col("_rank") / (1 + F.col("_rank")))
    drawn = rows.join(small(classes), ["_key", "weight"]).withColumn("_rank", rank).withColumn("_bin", F.least(F.floor(even * bins), F.lit(bins - 1)).cast("int"))
    drawn = cut(drawn)
    in_draw = drawn.where("_p > 0")
    by_bin = in_draw.groupBy("_key", "_bin").agg(F.sum("size").alias("_words"), F.max("_want").alias("_want"))
    before = Window.partitionBy("_key").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    by_bin = by_bin.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    past = by_bin.where((F.col("_before") <= F.col("_want")) & (F.col("_before") + F.col("_words") > F.col("_want")))
    cuts = cut(past.groupBy("_key").agg(F.min(F.struct("_bin", "_before")).alias("_cut")))
    placed = in_draw.join(small(cuts), "_key", "left")
    order = Window.partitionBy("_key").orderBy("_rank", F.col("doc_id").asc_nulls_last(), "size", "_row")
    running = F.col("_cut._before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    # The first in rank up to the one that exceeds what is open; none after that one.
    edge = cut(placed.where(F.col("_bin") == F.col("_cut._bin")).withColumn("_running", running).select("_key", "_row", "size", "_running", "_want", (F.col("_running") <= F.col("_want")).alias("_in")))
    inside = edge.where("_in").select("_row", F.lit(1).alias("_edge"))
    gap = cut(placed.groupBy("_key").agg(F.max("_want").alias("_want"), F.max("_cut").alias("_cut")).where("_cut IS NOT NULL").join(edge.where("_in").groupBy("_key").agg(F.sum("size").alias("_got")), "_key", "left").select("_key", (F.col("_want") - F.col("_cut._before") - F.coalesce("_got", F.lit(0))).alias("_gap"), "_cut"))
    # One more for the gap: of all that were not drawn and have a copy to spare the nearest in size.
    spare = drawn.where((F.col("_certain") < most_copies) & (F.col("size") > 0)).join(small(gap), "_key").where(F.col("_bin") >= F.col("_cut._bin")).join(small(inside), "_row", "left_anti")
    off = F.abs(F.col("_gap") - F.col("size"))
    filler = spare.where(off < F.col("_gap")).groupBy("_key").agg(F.min(F.struct(F.round(off, 6), "_rank", F.col("doc_id").isNull(), "doc_id", "size", "_row")).alias("_f")).select(F.col("_f._row").alias("_row"), F.lit(1).alias("_edge"))
    extra = cut(inside.unionByName(filler))
    marked = drawn.join(small(cuts), "_key", "left").join(small(extra) if extra.count() <= SMALL else extra, "_row", "left")
    surely = (F.col("_p") > 0) & F.coalesce(F.col("_bin") < F.col("_cut._bin"), F.lit(True))
    copies = F.least(F.col("_certain") + (surely | F.col("_edge").isNotNull()).cast("long"), F.lit(most_copies)).cast("long")
    out = marked.withColumn("copies", copies).withColumn("taken", copies * F.col("size"))
    return out.select("doc_id", "source", "size", *[F.col("_more")[c].alias(c) for c in more], "source_size", "target", "copies", "taken")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words_in(F.col("text")).alias("size"))
    out = sample(docs)
    return out.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken", "copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it is taken."""
    drawn = sample(docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))).where("copies > 0")
    # Repeated rows draw alike but for the last place: the k-th of them has the k-th number of copies.
    listed = drawn.groupBy("doc_id", "source", "text_hash").agg(F.sort_array(F.collect_list("copies"), asc=False).alias("copies"))
    right = listed.select(F.struct("doc_id", "source", "text_hash").alias("_same"), "copies")
    keyed = docs.select(F.struct(*docs.columns).alias("_doc"), F.struct("doc_id", "source", F.xxhash64("text").alias("text_hash")).alias("_same"))
    keyed = keyed.withColumn("_k", F.row_number().over(Window.partitionBy("_same").orderBy(F.xxhash64("_doc"))))
    met = keyed.join(right, "_same").where(F.col("_k") <= F.size("copies"))
    return met.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.element_at("copies", F.col("_k"))))).select("_doc.*")


ORACLE_SQL = {
    "op7_mixing": rf"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
         (CAST(concat('0x', left(md5(concat('{SEED}/', coalesce(CAST(doc_id AS VARCHAR), 'null'))), 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS k FROM s),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 3 * source_size AS cap FROM r),
f AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open,
         sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM w),
g AS (SELECT *, open * w >= cap * rest AS filled FROM f),
t AS (
  SELECT source, source_size,
         CASE WHEN filled THEN CAST(cap AS DOUBLE) ELSE w * (SELECT CAST(open AS DOUBLE) / rest FROM g WHERE NOT filled ORDER BY cap / w, k LIMIT 1) END AS target
  FROM g),
y AS (SELECT d.*, source_size, target, length(bin(size)) AS weight FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT source, weight, sum(size) AS words, any_value(target) AS target FROM y GROUP BY source, weight),
lv AS (
  SELECT *, coalesce((target - 3 * coalesce(sum(words) OVER (PARTITION BY source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / nullif(sum(weight * words) OVER (PARTITION BY source ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0), 0) AS level FROM k),
ex AS (
  SELECT *, CASE WHEN level * weight >= 3 THEN 3.0::DOUBLE
    ELSE greatest(0.0, weight * first_value(CASE WHEN level * weight < 3 THEN level END IGNORE NULLS) OVER (PARTITION BY source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) END AS e
  FROM lv),
cl AS (SELECT *, CAST(floor(e + 1e-9) AS BIGINT) AS certain, greatest(0.0, e - floor(e + 1e-9)) AS p FROM ex),
cw AS (SELECT *, target - sum(certain * words) OVER (PARTITION BY source) AS want FROM cl),
x AS (
  SELECT row_number() OVER () AS r, y.*, certain, p, want, CASE WHEN p <= 0 THEN CAST('inf' AS DOUBLE) ELSE u / (1 - u) / (p / (1 - p)) END AS rank
  FROM y JOIN cw ON y.source IS NOT DISTINCT FROM cw.source AND y.weight = cw.weight),
rn AS (SELECT *, CASE WHEN p > 0 THEN sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank, doc_id NULLS LAST, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= want ELSE false END AS first_in FROM x),
gp AS (
  SELECT source, any_value(want) - coalesce(sum(size) FILTER (first_in), 0) AS gap, max(CASE WHEN p > 0 AND NOT first_in THEN 1 ELSE 0 END) = 1 AS passed FROM rn GROUP BY source),
fl AS (
  SELECT r FROM rn JOIN gp ON rn.source IS NOT DISTINCT FROM gp.source
  WHERE passed AND NOT first_in AND certain < 3 AND size > 0 AND abs(gap - size) < gap
  QUALIFY row_number() OVER (PARTITION BY rn.source ORDER BY round(abs(gap - size), 6), rank, doc_id NULLS LAST, size, r) = 1),
z AS (SELECT rn.*, least(certain + CASE WHEN first_in OR r IN (SELECT r FROM fl) THEN 1 ELSE 0 END, 3) AS copies FROM rn)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(target, 4) AS target,
       CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies
FROM z"""
}
