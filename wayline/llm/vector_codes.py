"""Vector code compression with LAESA pivots.

Vectors become integers (floor of ``SCALE`` times a component) and are cut into ``PARTS`` parts. Each part's codebook
starts as that part of the vectors of the smallest ids; rounds assign every part to its nearest entry and replace an
entry by the floored mean of its parts.

The pivots of a part position stay the same over all rounds: entries of the first codebook, each farthest from those
before it. A part's distances to them are worked out once and written with the part. In a round only the distances from
pivots to entries are new; the largest difference of the two is a lower bound of the distance between part and entry. A
part's entries are taken in the order of their bounds, ``AT_ONCE`` at a time, and evaluated in integers, until the next
bound is above the least distance found; so what is left out can't be nearest or tie.

All of it is exact: distances are sums of squares in 64-bit integers, and bounds are lowered by more than their rounding.
Each task sends one row of sums for each entry that it used, so that a codebook's update shuffles tasks times entries rows
and the driver gets at most ``PARTS * ENTRIES`` of them.

Vectors that are null, hold null or non-finite components, or whose length isn't that of the vector of the smallest id (or
isn't a multiple of ``PARTS``) are dropped. Components from ``LARGEST`` on can't be squared in 64 bits and raise an error.
Repeated rows count as often as they stand; where ids repeat, the lesser vector comes first, and null ids come after all
others. With fewer vectors than entries the codebooks are smaller. Null labels are one label. Other columns are
not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, same, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
PIVOTS, AT_ONCE, BLOCK = 8, 8, 1024
#: Absolute components below this have squares whose sums over a part of 64 components stay within 64 bits.
LARGEST = 1 << 17
#: Labels whose sums are broadcast.
FEW_LABELS = 100_000


def nearest(parts: np.ndarray, entries: np.ndarray, to_pivots: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each part's nearest entry (the least index of ties)."""
    gaps = (entries[:, None, :] - pivots[None, :, :]).astype(np.float64)
    entry_pivots = np.sqrt((gaps * gaps).sum(2))
    which, least = np.zeros(len(parts), np.int64), np.full(len(parts), np.iinfo(np.int64).max)
    for start in range(0, len(parts), BLOCK):
        rows = slice(start, start + BLOCK)
        _nearest_block(parts[rows], entries, to_pivots[rows], entry_pivots, which[rows], least[rows])
    return which, least


def _nearest_block(parts: np.ndarray, entries: np.ndarray, to_pivots: np.ndarray, entry_pivots: np.ndarray, which: np.ndarray, least: np.ndarray) -> None:
    bounds = np.zeros((len(parts), len(entries)))
    for k in range(to_pivots.shape[1]):
        np.maximum(bounds, np.abs(to_pivots[:, k, None] - entry_pivots[None, :, k]), out=bounds)
    bounds = np.maximum(0, bounds * (1 - 1e-9) - 1e-6) ** 2
    order = np.argsort(bounds, axis=1, kind="stable")
    bounds = np.take_along_axis(bounds, order, 1)
    open_ = np.arange(len(parts))
    for first in range(0, len(entries), AT_ONCE):
        open_ = open_[bounds[open_, first] <= least[open_]]
        if not len(open_):
            return
        tried = order[open_, first : first + AT_ONCE]
        gaps = parts[open_, None, :] - entries[tried]
        found = np.einsum("ijk,ijk->ij", gaps, gaps)
        low = found.min(1)
        index = np.where(found == low[:, None], tried, len(entries)).min(1)
        better = (low < least[open_]) | ((low == least[open_]) & (index < which[open_]))
        at = open_[better]
        which[at], least[at] = index[better], low[better]


def far_apart(entries: np.ndarray, n: int) -> np.ndarray:
    """The first entry, and again and again the entry farthest from those taken."""
    taken, apart = [0], np.full(len(entries), np.inf)
    while True:
        gaps = (entries - entries[taken[-1]]).astype(np.float64)
        apart = np.minimum(apart, (gaps * gaps).sum(1))
        if len(taken) == min(n, len(entries)) or not apart.max():
            return entries[taken]
        taken.append(int(apart.argmax()))


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, PARTS)


def _cut_parts(vectors: np.ndarray) -> list[np.ndarray]:
    return np.split(vectors, PARTS, axis=1)


def _measured(pivots):
    """Adds the distances of each part to its pivots."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = []
            for x, p in zip(_cut_parts(_vectors(batch.column(2))), pivots.value):
                gaps = (x[:, None, :] - p[None, :, :]).astype(np.float64)
                columns.append(np.sqrt((gaps * gaps).sum(2)))
            flat = np.concatenate(columns, axis=1)
            bounds = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(bounds, pa.array(flat.ravel()))], [*batch.schema.names, "to_pivots"])

    return work


def _assigned(batch: pa.RecordBatch, vectors: int, distances: int, pivots: list[np.ndarray], books: list[np.ndarray]) -> Iterator[tuple]:
    """(part of each vector, index, squared distance) by part position."""
    far = _vectors(batch.column(distances))
    ends = np.cumsum([len(p) for p in pivots])
    for x, p, e, end in zip(_cut_parts(_vectors(batch.column(vectors))), pivots, books, ends):
        yield (x, *nearest(x, e, far[:, end - len(p) : end], p))


def _summed(pivots, books):
    """The sums of the parts that a task assigns to each entry."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros_like(e) for e in books.value]
        counts = [np.zeros(len(e), np.int64) for e in books.value]
        for batch in batches:
            if not batch.num_rows:
                continue
            for k, (x, which, _) in enumerate(_assigned(batch, 0, 1, pivots.value, books.value)):
                np.add.at(sums[k], which, x)
                counts[k] += np.bincount(which, minlength=len(counts[k]))
        for k, n in enumerate(counts):
            used = np.flatnonzero(n)
            rows = sums[k][used]
            bounds = pa.array(np.arange(len(used) + 1, dtype=np.int32) * rows.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[used]), pa.ListArray.from_arrays(bounds, pa.array(rows.ravel()))], ["part", "entry", "n", "sums"])

    return work


def _coded(pivots, books):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = list(_assigned(batch, 2, 3, pivots.value, books.value))
            codes = np.stack([which for _, which, _ in found], axis=1).astype(np.uint8)
            error = np.sum([d for _, _, d in found], axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], ["vec_id", "label", "code", "error"])

    return work


def kept(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """vec_id, label and the integers v of the vectors that aren't dropped for what they hold."""
    whole = F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("e")).where(whole)
    exact = F.when(F.exists("e", lambda x: F.abs(x) >= LARGEST), F.raise_error(F.lit(f"a component is {LARGEST} or more")).cast("array<bigint>")).otherwise(F.transform("e", lambda x: F.floor(x * scale).cast("bigint")))
    return rows.select("vec_id", "label", exact.alias("v"))


def codebooks(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list, list] | None:
    """The rows with their distances to pivots, the pivots and the last codebooks; None without rows."""
    spark = rows.sparkSession
    ordered = [F.col("vec_id").asc_nulls_last(), F.col("v").asc()]
    head = rows.orderBy(*ordered).limit(1).collect()
    width = len(head[0]["v"]) if head else 0
    if width < PARTS or width % PARTS:
        return None
    rows = rows.where(F.size("v") == width)
    first = np.array([r["v"] for r in rows.orderBy(*ordered).limit(entries).select("v").collect()], np.int64)
    books = _cut_parts(first)
    pivots = [far_apart(e, PIVOTS) for e in books]
    context = spark.sparkContext
    sent = context.broadcast(pivots)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    measured = cut(rows.mapInArrow(_measured(sent), f"{kinds}, to_pivots array<double>"))
    for _ in range(rounds):
        sums = measured.select("v", "to_pivots").mapInArrow(_summed(sent, context.broadcast(books)), "part int, entry int, n bigint, sums array<bigint>")
        totals = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width // PARTS)]
        books = [e.copy() for e in books]
        for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect():  # a row for each entry at most
            books[r["part"]][r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width // PARTS)]
    return measured, pivots, books


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error and codebooks_sha256 of each vector that is kept."""
    rows = kept(vectors, id_col, vector_col, label_col)
    fitted = codebooks(rows, entries, rounds)
    if fitted is None:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit("").alias("codebooks_sha256")).limit(0)
    measured, pivots, books = fitted
    digest = hashlib.sha256(",".join(str(x) for e in books for x in e.ravel().tolist()).encode()).hexdigest()
    context = vectors.sparkSession.sparkContext
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:2])
    coded = measured.select("vec_id", "label", "v", "to_pivots").mapInArrow(_coded(context.broadcast(pivots), context.broadcast(books)), f"{kinds}, code string, error bigint")
    return coded.withColumn("codebooks_sha256", F.lit(digest))


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds label_error, the sum of the errors of equal labels (nulls are one label)."""
    coded = cut(coded)
    totals = cut(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    if totals.limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        totals = F.broadcast(totals)
    return coded.join(totals, same("label", "of")).drop("of")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code with its error, its label's error and the digest of the codebooks."""
    found = with_label_error(compress(table(spark, sf_dir, "embeddings")))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _oracle() -> str:
    """Each round by all distances, in SQL."""
    dot = "list_dot_product({0}, {1})"
    ctes = [
        "kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "part AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS w FROM kept, range(4) t(p))",
        "book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS i, w AS e FROM part WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256))",
    ]
    for k in range(ROUNDS + 1):
        gap = f"CAST({dot.format('w', 'w')} - 2 * {dot.format('w', 'e')} + {dot.format('e', 'e')} AS BIGINT)"
        ctes.append(f"near{k} AS MATERIALIZED (SELECT vec_id, label, p, min(struct_pack(d := {gap}, i := i)) AS m, any_value(w) AS w FROM part JOIN book{k} USING (p) GROUP BY vec_id, label, p)")
        if k < ROUNDS:
            mean = f"mean{k} AS (SELECT p, m.i AS i, j, floor(sum(w[j]) / count(*)) AS c FROM near{k}, range(1, 17) t(j) GROUP BY p, m.i, j)"
            ctes += [mean, f"book{k + 1} AS MATERIALIZED (SELECT p, i, coalesce(n.e, b.e) AS e FROM book{k} b LEFT JOIN (SELECT p, i, list(c ORDER BY j) AS e FROM mean{k} GROUP BY p, i) n USING (p, i))"]
    ctes.append(f"coded AS (SELECT vec_id, label, string_agg(lower(printf('%02x', CAST(m.i AS INTEGER))), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id, label)")
    ctes.append(f"digest AS (SELECT sha256(string_agg(array_to_string(list_transform(e, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, i)) AS codebooks_sha256 FROM book{ROUNDS})")
    return f"WITH {', '.join(ctes)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest"


ORACLE_SQL = {"op11_vector_codes": _oracle()}
