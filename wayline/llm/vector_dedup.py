"""Embedding near-dedup by collision-counting projections.

Unit vectors are projected on many random directions. On one direction two vectors collide if the second lies in
the window around the first; at the threshold's angle that has a known probability, and collisions on
different directions are independent, so that a count over ``COUNTED`` directions has a binomial distribution. A pair is
verified (cosine, in double precision) if its count isn't below the one that a pair at the threshold reaches with the
probability ``PASSES``.

No task sees all pairs. A table has a few directions of its own: the signs on the first ones make a cell, and the rows of a
cell are sorted along the last, so that a query's window there is a range of rows, found by binary search. Collisions
are counted for the pairs of that range: on ``FIRST`` directions for all, on the rest for those that have enough by then.
There are as many tables as give a pair at the threshold the probability ``RECALL`` to meet in one, and as many signs as
make cells of about ``CELL`` rows; both follow from the number of vectors, and work grows with about its power 1.2.
Cells of more than ``MOST`` rows (near copies share their cells) are cut into slices, and each two slices are a task's group.

A pair that meets in several tables counts in the first: projections are sums of integers, so that each task has the same
cells and windows for a vector. Pairs are never rows. A group gives the sum of links of a vector and the least
vector that it reaches in the group, from which Spark sums up links and joins components.

Equal vectors are one, with their number as weight. Vectors that are null, empty or zero, or hold null or non-finite
components link with nothing; vectors link with those of their own length only. Rows that repeat an id are vectors of their
own. A null id links as others do, but is no component's id unless all its ids are null. Other columns are not read,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .near_dedup import components
from .shared import cut, partitions, table

THRESHOLD = 0.9
#: A pair at the threshold meets in a table with the first probability, and its count is high enough with the second.
RECALL, PASSES = 0.998, 0.9995
COUNTED, FIRST = 32, 12
#: Rows of a cell as aimed at, and as worked on together at most.
CELL, MOST = 2048, 8192
#: Larger cells whose sizes are broadcast.
FEW_CELLS = 100_000
#: Half a window, in multiples of the distance of vectors at the threshold.
HALF = 2.0
#: A unit vector's components, a direction's components and a projection's standard deviation as integers.
_FINE, _ROUGH, _STEP = 1 << 15, 1 << 6, 28
_ROWS, _COLUMNS, _PAIRS = 256, 4096, 1 << 16


def at_least(n: int, p: float, sure: float) -> int:
    """The largest count that a binomial (n, p) reaches with the given probability."""
    below = 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if below > 1 - sure:
            return k
    return n


class Plan:
    """Tables, windows and counts for so many vectors."""

    def __init__(self, n: int, threshold: float = THRESHOLD, recall: float = RECALL, cell: int = CELL):
        self.threshold, self.signs = threshold, max(0, round(math.log2(max(1, n) / cell)))
        apart = math.sqrt(max(1e-6, 2 - 2 * threshold))
        self.half = HALF * apart
        inside = math.erf(HALF / math.sqrt(2))
        meets = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** self.signs * inside
        self.tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - meets)))
        self.first, self.all = at_least(FIRST, inside, PASSES), at_least(COUNTED, inside, PASSES)

    def directions(self, width: int) -> np.ndarray:
        return _directions(width, COUNTED + self.tables * (self.signs + 1))

    def project(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counted projections (steps, as unsigned bytes), cells and sorted projections of each table, the same for a vector in any batch."""
        whole = np.rint(unit * _FINE) @ self.directions(unit.shape[1])  # integers below 2**53: exact in any order
        counted = np.clip(np.rint(whole[:, :COUNTED] * (_STEP / _FINE / _ROUGH)), -100, 100).astype(np.int8).view(np.uint8)
        own = whole[:, COUNTED:].reshape(len(unit), self.tables, self.signs + 1)
        bits = (own[:, :, : self.signs] < 0).astype(np.int64) << np.arange(self.signs)
        return counted, bits.sum(2), own[:, :, self.signs]

    @property
    def window(self) -> float:
        return self.half * _FINE * _ROUGH


@lru_cache(4)
def _directions(width: int, n: int) -> np.ndarray:
    return np.rint(np.random.Generator(np.random.PCG64(width)).standard_normal((n, width)) * _ROUGH).T.copy()


def packed(vectors: np.ndarray) -> list[bytes]:
    """Each vector's bytes, as floats where these are exact."""
    with np.errstate(over="ignore"):
        short = vectors.astype(np.float32)
    return [(b if same_ else a).tobytes() for a, b, same_ in zip(vectors, short, (short == vectors).all(1).tolist())]


def units(raw: list[bytes], width: int, largest: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """What was packed, as unit vectors."""
    short = np.array([len(x) == 4 * width for x in raw], bool)
    out = np.empty((len(raw), width))
    for kind, rows in ((np.float32, np.flatnonzero(short)), (np.float64, np.flatnonzero(~short))):
        out[rows] = np.frombuffer(b"".join([raw[i] for i in rows]), kind).reshape(-1, width)
    return out / largest[:, None] / norms[:, None]


def joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (least members) once a and b are joined; parent has labels from before."""
    while True:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        apart = low < high
        if not apart.any():
            return parent
        a, b = low[apart], high[apart]
        np.minimum.at(parent, b, a)
        while not np.array_equal(further := parent[parent], parent):
            parent = further


def _together(plan: Plan, at: int, unit: np.ndarray, node: np.ndarray, weight: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """node, number of links and least node reached, of what links in a group of table at; sides, if there are two, meet each other only."""
    counted, cells, along = plan.project(unit)
    order = np.lexsort((node, along[:, at]))
    unit, node, weight, side, counted, cells, along = (x[order] for x in (unit, node, weight, side, counted, cells, along))
    sorted_, two = along[:, at], side.min() != side.max()
    ends = np.searchsorted(sorted_, sorted_ + plan.window, "right")
    links, parent = np.zeros(len(node), np.int64), np.arange(len(node))
    by_direction = np.ascontiguousarray(counted.T)
    for first in range(0, len(node), _ROWS):
        last = min(first + _ROWS, len(node))
        for left in range(first, int(ends[last - 1]), _COLUMNS):
            right = min(left + _COLUMNS, int(ends[last - 1]))
            for x, y in _colliding(plan, counted, by_direction, ends, first, last, left, right):
                if two:
                    x, y = (z[side[x] != side[y]] for z in (x, y))
                near = np.einsum("ij,ij->i", unit[x], unit[y]) >= plan.threshold
                x, y = x[near], y[near]
                if at:
                    before = ((cells[x, :at] == cells[y, :at]) & (np.abs(along[x, :at] - along[y, :at]) <= plan.window)).any(1)
                    x, y = x[~before], y[~before]
                links += np.bincount(x, weights=weight[y], minlength=len(node)).astype(np.int64)
                links += np.bincount(y, weights=weight[x], minlength=len(node)).astype(np.int64)
                parent = joined(parent, x, y)
    least = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(least, parent, node)
    some = links > 0
    return node[some], links[some], least[parent][some]


def _colliding(plan: Plan, counted: np.ndarray, by_direction: np.ndarray, ends: np.ndarray, first: int, last: int, left: int, right: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row, later row in its window) with enough collisions."""
    half = np.uint8(min(100, math.floor(plan.half * _STEP) + 1))  # a step more, for what rounding takes
    shape = (last - first, right - left)
    count, apart, hit = np.zeros(shape, np.uint8), np.empty(shape, np.uint8), np.empty(shape, bool)
    for p in by_direction[:FIRST]:
        np.subtract((p[first:last] + half)[:, None], p[None, left:right], out=apart)
        np.less_equal(apart, 2 * half, out=hit)
        count += hit.view(np.uint8)
    columns = np.arange(left, right)
    hit = (count >= plan.first) & (columns > np.arange(first, last)[:, None]) & (columns < ends[first:last, None])
    x, y = np.nonzero(hit)
    for k in range(0, len(x), _PAIRS):
        a, b = x[k : k + _PAIRS], y[k : k + _PAIRS]
        rest = (counted[first + a, FIRST:] + half - counted[left + b, FIRST:] <= 2 * half).sum(1, dtype=np.uint8)
        enough = rest + count[a, b] >= plan.all
        yield first + a[enough], left + b[enough]


def _dealt(plan: Plan):
    """Each vector once for each table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(lengths):
                rows = np.flatnonzero(lengths == width)
                for start in range(0, len(rows), max(1, 40_000 // plan.tables)):
                    part = batch.take(pa.array(rows[start : start + max(1, 40_000 // plan.tables)]))
                    x = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                    largest = np.abs(x).max(1)
                    norms = np.sqrt(((x / largest[:, None]) ** 2).sum(1))
                    raw = packed(x)
                    _, cells, _ = plan.project(units(raw, int(width), largest, norms))
                    n = part.num_rows
                    again = pa.array(np.tile(np.arange(n), plan.tables))
                    columns = [pa.array(np.repeat(np.arange(plan.tables, dtype=np.int32), n)), pa.array(np.full(n * plan.tables, width, np.int32)), pa.array(cells.T.ravel())]
                    yield pa.RecordBatch.from_arrays([*columns, *(c.take(again) for c in (part.column(0), part.column(1), pa.array(largest), pa.array(norms), pa.array(raw, pa.binary())))], ["tab", "width", "cell", "node", "weight", "largest", "norm", "vec"])

    return work


def _groups(plan: Plan):
    """Works on rows that lie sorted by group."""

    def give(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        of = pa.Table.from_batches(rows)
        largest, norm, node, weight, side = (of[c].to_numpy() for c in ("largest", "norm", "node", "weight", "side"))
        unit = units(of["vec"].to_pylist(), of["width"][0].as_py(), largest, norm)
        found = _together(plan, of["tab"][0].as_py(), unit, node, weight, side)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["node", "links", "least"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("tab", "width", "cell", "i", "j")], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if held and key != tuple(keys[a]):
                    yield give(held)
                    held = []
                key = tuple(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield give(held)

    return work


def links(vectors: DataFrame, plan: Plan, most: int = MOST) -> DataFrame:
    """node, links and least of each distinct vector (node, weight, embedding) and group in which it links."""
    dealt = vectors.select("node", "weight", "embedding").mapInArrow(_dealt(plan), "tab int, width int, cell bigint, node bigint, weight bigint, largest double, norm double, vec binary")
    keys = ["tab", "width", "cell"]
    large = cut(dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > most))
    if large.limit(FEW_CELLS + 1).count() <= FEW_CELLS:
        large = F.broadcast(large)
    sized = dealt.join(large, keys, "left").withColumn("slices", F.coalesce(F.ceil(F.col("size") / most), F.lit(1)).cast("int"))
    sized = sized.withColumn("side", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
    # Each slice meets itself and each other one.
    met = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")})
    keys += ["i", "j"]
    groups = met.select(*keys, "side", "node", "weight", "largest", "norm", "vec").repartition(partitions(vectors.sparkSession), *keys).sortWithinPartitions(*keys)
    return groups.mapInArrow(_groups(plan), "node bigint, links bigint, least bigint")


def near(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, cell: int = CELL, most: int = MOST) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors."""
    rows = cut(vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).withColumn("row", F.monotonically_increasing_id()))
    whole = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("embedding", lambda x: x != 0)
    fit = rows.where(F.col("embedding").isNotNull() & whole).withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    distinct = cut(fit.groupBy("embedding").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("weight")))
    found = cut(links(distinct, Plan(distinct.count(), threshold, recall, cell), most))
    totals = found.groupBy("node").agg(F.sum("links").alias("links"))
    one = components(found.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")))
    nodes = distinct.join(totals, "node", "left").join(one, F.col("node") == F.col("id"), "left")
    nodes = nodes.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    placed = fit.join(nodes, "embedding").select("row", "vec_id", "n_links", "component")
    alone = rows.join(fit.select("row"), "row", "left_anti").select("row", "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("row").alias("component"))
    every = cut(placed.union(alone))
    least = every.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    out = every.join(least, "component").select("vec_id", "n_links", "component_id")
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its number of links and its component of links at a cosine of 0.9 or more."""
    return near(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = {
    "op13_vector_dedup": """
WITH RECURSIVE whole AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM whole a JOIN whole b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS id, vec_id AS least FROM embeddings UNION SELECT l.b, r.least FROM reach r JOIN link l ON l.a = r.id),
component AS (SELECT id, min(least) AS component_id FROM reach GROUP BY id)
SELECT v.vec_id, (SELECT count(*) FROM link l WHERE l.a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept
FROM embeddings v JOIN component c ON c.id = v.vec_id""",
}
