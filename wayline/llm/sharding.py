"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a 60-bit hash. A bucket whose documents
hold more than ``limit_bytes`` splits on one more bit, others stay, until every shard
fits; a shard of one document stays whole whatever its size.

Depths up to a leaf depth are settled on sums for each leaf (a table of about sixteen
rows a shard); only documents of leaves that are still too large are looked at one by
one. No text is shuffled, and no directory reaches the driver.

Repeated rows get a copy number in their hash, so that they can part. Null and empty
texts hold 0 bytes; a text longer than a shard is a shard of its own. A null id hashes as
the word null. Columns other than id and text are not read by ``assign`` and
``directory``, whatever their names; ``write`` refuses tables with its own names. An empty
table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, same, table

BITS = 60
LIMIT_BYTES, SMALL_LIMIT = 64 << 20, 64 << 10


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_md5, copy, n_bytes and hash: a row for each row of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.md5(text.cast("binary")).alias("text_md5"), F.octet_length(text).cast("long").alias("n_bytes"))
    counted = rows.groupBy("doc_id", "text_md5", "n_bytes").agg(F.count(F.lit(1)).alias("n"))
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).drop("n")
    key = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_md5", F.col("copy").cast("string"))
    return copies.withColumn("hash", F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long"))


def _prefix(value: str, drop: str) -> F.Column:
    return F.expr(f"shiftright({value}, cast({drop} as int))")


def _settled(sized: DataFrame, key: str, limit_bytes: int) -> DataFrame:
    """For each key, its least depth whose bucket (depth, prefix) fits; sized: key, depth, prefix, bytes, docs."""
    buckets = sized.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
    fits = buckets.where((F.col("shard_bytes") <= limit_bytes) | (F.col("shard_docs") == 1) | (F.col("depth") == BITS))
    return sized.join(fits, ["depth", "prefix"]).groupBy(key).agg(F.min(F.struct("depth", "shard_bytes", "shard_docs")).alias("shard"))


def assign(docs: DataFrame, limit_bytes: int = LIMIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_md5, copy, n_bytes, depth, shard (its bits), shard_bytes, shard_docs of each row."""
    rows = cut(hashed(docs, id_col, text_col))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    leaf_bits = min(40, max(0, math.ceil(math.log2(max(1, total / limit_bytes)))) + 4)
    rows = rows.withColumn("leaf", _prefix("hash", str(BITS - leaf_bits)))
    leaves = rows.groupBy("leaf").agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"))
    depths = leaves.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(leaf_bits)))).withColumn("prefix", _prefix("leaf", f"{leaf_bits} - depth"))
    placed = rows.join(_settled(depths, "leaf", limit_bytes), "leaf", "left")
    large = rows.join(leaves.where((F.col("bytes") > limit_bytes) & (F.col("docs") > 1)), "leaf", "left_semi").select("hash", F.col("n_bytes").alias("bytes"), F.lit(1).cast("long").alias("docs"))
    deeper = large.withColumn("depth", F.explode(F.sequence(F.lit(leaf_bits + 1), F.lit(BITS)))).withColumn("prefix", _prefix("hash", f"{BITS} - depth"))
    late = _settled(deeper, "hash", limit_bytes).withColumnRenamed("shard", "late")
    whole = placed.join(late, "hash", "left").withColumn("shard", F.coalesce("shard", "late"))
    bits = F.lpad(F.conv(_prefix("hash", f"{BITS} - shard.depth").cast("string"), 10, 2), F.col("shard.depth"), F.lit("0"))
    return whole.select("doc_id", "text_md5", "copy", "n_bytes", F.col("shard.depth").alias("depth"), bits.alias("shard_bits"), F.col("shard.shard_bytes").alias("shard_bytes"), F.col("shard.shard_docs").alias("shard_docs")).withColumnRenamed("shard_bits", "shard")


def directory(assigned: DataFrame) -> DataFrame:
    """The directory of what ``assign`` gives: depth, shard (the bits that lead to it), its bytes and documents, a row for each bucket."""
    return assigned.groupBy("depth", "shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_docs"))


def write(docs: DataFrame, path: str, limit_bytes: int = LIMIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """docs written under path as a folder for each shard; here the texts move, once."""
    spare = [x for x in ("shard", "_id", "_md5") if x in docs.columns]
    if spare:
        raise ValueError(f"these column names are taken: {spare}")
    placed = assign(docs, limit_bytes, id_col, text_col).select(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5"), "shard").groupBy("_id", "_md5", "shard").agg(F.count(F.lit(1)).alias("_n"))
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    one = docs.withColumn("_md5", text).dropDuplicates([id_col, "_md5"])
    out = one.join(placed, same(one[id_col], placed["_id"]) & (one["_md5"] == placed["_md5"])).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    out.select("shard", *[one[c] for c in docs.columns]).repartition("shard").write.partitionBy("shard").parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard, shards of at most 64 MiB of text."""
    return assign(table(spark, sf_dir, "documents")).select("doc_id", "copy", "n_bytes", "depth", "shard", "shard_bytes", "shard_docs")


def shard_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory for shards of at most 64 KiB: at this limit the smallest tables split to several depths."""
    return directory(assign(table(spark, sf_dir, "documents"), SMALL_LIMIT))


QUERIES = {"shard_directory": shard_directory}


def _placed_sql(limit_bytes: int) -> str:
    return f"""
WITH d AS (
  SELECT doc_id, md5(coalesce(text, '')) AS m, strlen(coalesce(text, '')) AS n_bytes,
         row_number() OVER (PARTITION BY doc_id, md5(coalesce(text, ''))) - 1 AS copy
  FROM documents),
h AS (
  SELECT doc_id, n_bytes, copy,
         CAST(concat('0x', left(md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), '/', m, '/', CAST(copy AS VARCHAR))), 15)) AS BIGINT) AS hash
  FROM d),
x AS (SELECT *, depth, hash >> CAST({BITS} - depth AS BIGINT) AS prefix FROM h, range(0, {BITS + 1}) AS r(depth)),
b AS (SELECT depth, prefix, sum(n_bytes) AS shard_bytes, count(*) AS shard_docs FROM x GROUP BY ALL),
f AS (
  SELECT x.*, b.shard_bytes, b.shard_docs, row_number() OVER (PARTITION BY x.doc_id, x.hash, x.copy ORDER BY x.depth) AS k
  FROM x JOIN b ON x.depth = b.depth AND x.prefix = b.prefix
  WHERE b.shard_bytes <= {limit_bytes} OR b.shard_docs = 1 OR b.depth = {BITS})
"""


ORACLE_SQL = {
    "op1_sharding": _placed_sql(LIMIT_BYTES) + """SELECT doc_id, CAST(copy AS BIGINT) AS copy, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(depth AS INTEGER) AS depth,
       CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), CAST(depth AS INTEGER), '0') END AS shard,
       CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_docs
FROM f WHERE k = 1""",
    "shard_directory": _placed_sql(SMALL_LIMIT) + """SELECT CAST(depth AS INTEGER) AS depth, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), CAST(depth AS INTEGER), '0') END AS shard,
       CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs
FROM f WHERE k = 1 GROUP BY ALL""",
}
