"""Exact dedup by content-defined chunk recipes.

Texts are lower-cased (A-Z only) and cut where a rolling hash of the last 48 bytes says
so, so that equal stretches give equal chunks. Chunks are deduplicated to identifiers:
a chunk's identifier is its 64-bit key, and where two chunks of one key differ in
length or SHA-256, the rank among them is added, so an identifier is verified. Texts
are equal if their ordered identifier lists are; only digests are shuffled, a text's
bytes are read where they lie and stay there.

Groups are counted in two steps, combined before the shuffle. What was counted of the
largest groups (at most ``MANY`` of more than ``LARGE`` distinct rows) is broadcast, so
that no group of copies has to come to one task to learn its keeper.

A null text counts as empty, and all empty texts are equal. Of equal texts the row with
the largest id stays (null is below every id); of repeated rows with that id one stays.
A very long text is chunked in its task, in memory in proportion to itself. Columns other
than id and text are not read, whatever their names; ``keep_last`` passes them through.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat
from .shared import cut, same, table

LEAST, MEAN, MOST, WINDOW = 1 << 10, 1 << 12, 1 << 15, 48
#: A key has so many bytes of the digest. Groups of more distinct rows than LARGE are broadcast, the largest MANY (some 10 MB) of them.
KEY_BYTES, LARGE, MANY = 8, 500, 100_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_COLUMNS = "doc_id {id}, text_sha256 string, recipe array<struct<key:bigint,length:int,digest:binary>>"


def boundaries(data: np.ndarray, least: int = LEAST, mean: int = MEAN, most: int = MOST) -> np.ndarray:
    """Where the chunks of data end: on a hash of the last bytes, between the least and the most length."""
    n = len(data)
    if n <= least:
        return np.array([n] if n else [], np.int64)
    up, down = flat.powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(flat._TABLE[data] * down[:-1], out=sums[1:])
    rolling = flat.mix((sums[WINDOW:] - sums[:-WINDOW]) * up[: n + 1 - WINDOW])
    marks = np.flatnonzero(rolling % np.uint64(mean - least) == 0) + WINDOW
    out, at = [], 0
    while n - at > least:
        k = np.searchsorted(marks, at + least)
        end = int(marks[k]) if k < len(marks) and marks[k] < at + most else at + most
        if end >= n:
            break
        out.append(end)
        at = end
    return np.array([*out, n], np.int64)


def _recipes(batches: Iterator[pa.RecordBatch], key_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in flat.runs(batch.column(1)):
            data = _LOWER[data]
            keys, lengths, digests, counts, hashes = [], [], [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                whole = data[a:b]
                hashes.append(hashlib.sha256(whole).hexdigest())
                ends = boundaries(whole)
                counts.append(len(ends))
                start = 0
                for end in ends.tolist():
                    digest = hashlib.sha256(whole[start:end]).digest()
                    keys.append(int.from_bytes(digest[:key_bytes], "little", signed=True))
                    lengths.append(end - start)
                    digests.append(digest[key_bytes:])
                    start = end
            entries = pa.StructArray.from_arrays([pa.array(keys, pa.int64()), pa.array(lengths, pa.int32()), pa.array(digests, pa.binary())], ["key", "length", "digest"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), entries)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(hashes), lists], ["doc_id", "text_sha256", "recipe"])


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bytes: int = KEY_BYTES) -> DataFrame:
    """doc_id, text_sha256 (of the normalised text) and recipe of each row: the chunks in order."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda batches: _recipes(batches, key_bytes), _COLUMNS.format(id=rows.schema["doc_id"].dataType.simpleString()))


def identified(rows: DataFrame) -> DataFrame:
    """rows with ``ids`` instead of ``recipe``: verified chunk identifiers in order."""
    chunks = rows.select(F.explode("recipe").alias("c")).select("c.*")
    distinct = chunks.groupBy("key", "length", "digest").agg(F.lit(1).alias("one"))
    # Keys of more than one chunk; by chance there is none below some billions of chunks.
    shared = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(F.struct("length", "digest"))).alias("chunks")).where("n > 1")
    clashes = cut(shared.select("key", F.posexplode("chunks").alias("rank", "c")).select("key", "rank", F.col("c.length").alias("length"), F.col("c.digest").alias("digest")))
    plain = rows.withColumn("ids", F.transform("recipe", lambda c: F.struct(c["key"].alias("key"), F.lit(0).alias("rank"))))
    if clashes.isEmpty():
        return plain.drop("recipe")
    placed = rows.select("doc_id", "text_sha256", F.posexplode("recipe").alias("at", "c")).join(clashes, (F.col("c.key") == clashes["key"]) & (F.col("c.length") == clashes["length"]) & (F.col("c.digest") == clashes["digest"]), "left")
    placed = placed.select("doc_id", "text_sha256", "at", F.struct(F.col("c.key").alias("key"), F.coalesce("rank", F.lit(0)).alias("rank")).alias("id")).distinct()
    lists = placed.groupBy("doc_id", "text_sha256").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("ids"))
    keyed = rows.join(lists.withColumnRenamed("doc_id", "_doc").withColumnRenamed("text_sha256", "_sha"), same("doc_id", "_doc") & (F.col("text_sha256") == F.col("_sha")), "left")
    return keyed.select("doc_id", "text_sha256", F.coalesce("ids", F.array().cast("array<struct<key:bigint,rank:int>>")).alias("ids"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bytes: int = KEY_BYTES, large: int = LARGE) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and n_chunks of each row of docs."""
    rows = identified(cut(recipes(docs, id_col, text_col, key_bytes)))
    # Long lists are compared by what stands for them in one shuffle: length, two hashes of the list.
    listed = rows.select("doc_id", "text_sha256", F.size("ids").alias("n_chunks"), F.xxhash64("ids").alias("a"), F.md5(F.to_json("ids").cast("binary")).alias("b"))
    counted = cut(listed.groupBy("doc_id", "text_sha256", "n_chunks", "a", "b").agg(F.count(F.lit(1)).alias("n")))
    key = ["n_chunks", "a", "b"]
    totals = cut(counted.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("_rows")))
    hot = F.broadcast(cut(totals.where(F.col("_rows") > large).orderBy(F.desc("_rows"), *key).limit(MANY)))
    alone = F.broadcast(hot.select(*key))
    few = counted.join(alone, key, "left_anti").join(totals.join(alone, key, "left_anti"), key)
    out = counted.join(hot, key).unionByName(few).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return out.select("doc_id", "keep_id", "group_size", (same("doc_id", "keep_id") & (F.col("copy") == 1)).alias("kept"), "text_sha256", "n_chunks")


def keep_last(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    rows = docs.select(F.col(id_col).alias("_doc"), F.struct(*docs.columns).alias("_row"))
    kept = cut(groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_kept_sha")))
    repeated = cut(docs.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    if repeated.isEmpty():
        return rows.join(kept, same("_doc", "_id"), "left_semi").select("_row.*")
    # Some ids stand on several rows: of those, one row for each text that stays.
    text = F.coalesce(F.col("_row")[text_col], F.lit(""))
    sha = F.sha2(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").cast("binary"), 256)
    marked = rows.withColumn("_sha", sha).join(kept, same("_doc", "_id") & (F.col("_sha") == F.col("_kept_sha")), "left_semi")
    once = marked.join(repeated, same("_doc", "_id"), "left_anti")
    several = marked.join(repeated, same("_doc", "_id"), "left_semi").groupBy("_doc", "_sha").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return once.select("_row.*").unionByName(several.select("_row.*"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of equal texts."""
    return groups(table(spark, sf_dir, "documents")).drop("n_chunks")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the largest id."""
    return keep_last(docs)


ORACLE_SQL = {
    "op3_exact_dedup": """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (
  SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
         row_number() OVER (PARTITION BY t, doc_id) AS copy
  FROM d)
SELECT doc_id, keep_id, group_size, (doc_id IS NOT DISTINCT FROM keep_id) AND copy = 1 AS kept, sha256(t) AS text_sha256 FROM g"""
}
