"""Quality classifier on random Fourier features.

Each text becomes ``STATS`` statistics of its bytes, words, word chains and lines. They
are standardised, random Fourier features approximate a Gaussian kernel on them, and
ridge scores are fitted from normal equations that every partition sums for itself. On
a fold kept apart, pooled adjacent violators turn scores into calibrated ones that lie
between 0 and 1 and rise with the ridge score.

Learning uses labelled rows only, at most ``MOST_LABELLED`` of them (chosen by a hash of
the id if there are more), and none whose crc32(id as text) mod 4 is 2. Sums of a fixed
size reach the driver: one matrix for each of ``SUMS`` partitions, and counts by score.

Null and empty texts have zero statistics and get a score like others; a very long text
needs memory in proportion to itself. A text's score depends on the text alone, so repeated
rows agree; a null id is never labelled, of several labels of one id the mean counts, and
of several texts of a labelled id the one of the least statistics is learned from. Ties of
score are one knot of the calibration. Without labels every score is 0.5. Columns other
than id and text are not read, whatever their names; ``stage`` passes them through. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat
from .shared import cut, table

MOST_LABELLED = 200_000
SUMS = 16
FEATURES, RIDGE, SEED = 256, 1e-3, 11
ACCEPTED = 0.7

_LINE = np.zeros(256, bool)
_LINE[[0x0A, 0x0D]] = True
_KINDS = {
    "upper": [*range(65, 91)],
    "lower": [*range(97, 123), *range(0x80, 0x100)],
    "digit": [*range(48, 58)],
    "space": [*np.flatnonzero(flat.SPACE)],
    "stop": [ord(c) for c in ".,;:"],
    "bang": [ord(c) for c in "!?"],
    "bar": [ord(c) for c in "|"],
    "sign": [ord(c) for c in "#$%&*@~^+=<>{}[]\\/_`"],
}
STATS = 22


def stats(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The statistics of texts in one byte array, a row for each."""
    rows = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    per_byte = 1 / np.maximum(size, 1)
    share = {}
    for kind, members in _KINDS.items():
        is_in = np.zeros(256, np.uint8)
        is_in[members] = 1
        sums = np.concatenate([[0], np.cumsum(is_in[data], dtype=np.int64)])
        share[kind] = np.diff(sums[offsets]) * per_byte

    def lumps(part, chains):
        """Spans parted by ``part``: number, mean and deviation of lengths, and what share of them (and of chains of each k) are distinct."""
        starts, ends, at = flat.words(data, offsets, part)
        n = np.diff(at)
        text = np.repeat(np.arange(rows), n)
        length = (ends - starts).astype(float)
        mean = np.bincount(text, length, rows) / np.maximum(n, 1)
        spread = np.sqrt(np.maximum(0, np.bincount(text, length**2, rows) / np.maximum(n, 1) - mean**2))
        h = flat.span_hashes(data, starts, ends)
        out = [n, mean, spread]
        for k in chains:
            c, t = (h, text) if k == 1 else (flat.chain_hashes(h, k), text[: max(0, len(text) - k + 1)])
            if k > 1:
                inside = t == text[k - 1 :]
                c, t = c[inside], t[inside]
            order = np.lexsort((c, t))
            new = np.ones(len(c), bool)
            new[1:] = (c[order][1:] != c[order][:-1]) | (t[order][1:] != t[order][:-1])
            total = np.bincount(t, minlength=rows)
            out.append(np.where(total > 0, np.bincount(t[order], new, rows) / np.maximum(total, 1), 1.0))
        return out, starts, ends, text, h

    (n, mean, spread, unique, unique2, unique4), starts, ends, text, _ = lumps(flat.SPACE, (1, 2, 4))
    (lines, line_mean, line_spread, line_unique), *_ = lumps(_LINE, (1,))
    per_word = 1 / np.maximum(n, 1)
    first, last = data[starts], data[ends - 1]
    in_set = lambda b, members: np.isin(b, np.array(members, np.uint8))
    capital = np.bincount(text, in_set(first, _KINDS["upper"]), rows) * per_word
    odd_end = np.bincount(text, in_set(last, [*_KINDS["sign"], *_KINDS["bang"]]), rows) * per_word
    short = np.bincount(text, ends - starts <= 3, rows) * per_word
    cols = [*share.values(), np.log1p(size), np.log1p(n), np.minimum(mean, 50), np.minimum(spread, 50), unique, unique2, unique4]
    cols += [np.log1p(lines), np.log1p(line_mean), np.log1p(line_spread), line_unique, capital, odd_end, short]
    return np.stack(cols, 1)


def _stat_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in flat.runs(batch.column(1)):
            x = stats(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, STATS, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), lists], ["doc_id", "x"])


def with_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_stat_rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<double>")


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 4


class Model:
    """The fitted classifier; small whatever the corpus."""

    def __init__(self, mean, scale, weights, knots, values):
        self.mean, self.scale, self.weights, self.knots, self.values = mean, scale, weights, knots, values

    @staticmethod
    def features(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
        rng = np.random.Generator(np.random.PCG64(SEED))
        w = rng.normal(size=(STATS, FEATURES)) / np.sqrt(STATS)
        b = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - mean) / scale, -5, 5)
        return np.concatenate([np.ones((len(x), 1)), np.sqrt(2 / FEATURES) * np.cos(z @ w + b)], 1)

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return self.features(x, self.mean, self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(x):
            return np.full(len(x), 0.5)
        return np.round(np.clip(np.interp(self.ridge(x), self.knots, self.values), 0, 1), 6)


def pooled(at: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit: knots (mean place of each block) and values, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for p, k, o in zip(at.tolist(), n.tolist(), ones.tolist()):
        blocks.append([k, o, p * k])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


def _x(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, STATS)


def _summed(rows: DataFrame, of) -> np.ndarray | None:
    """The sum over all rows of arrays of one shape: of(x, y) for each batch, added up in each partition, then on the driver."""

    def each(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(_x(batch), batch.column("y").to_numpy(zero_copy_only=False))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = [np.frombuffer(r["part"]) for r in rows.mapInArrow(each, "part binary").collect()]
    return sum(parts) if parts else None


def learned_from(labels: DataFrame, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """doc_id and y (the mean label) of the rows that may be learned from, at most about most_labelled."""
    marked = cut(labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("y")).where(fold() != 2))
    there = marked.count()
    if there > most_labelled:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most_labelled / there))
    return marked


def fit(rows: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> Model:
    """The classifier learned from labels (doc_id, quality) and rows, documents (doc_id, text) or their statistics (doc_id, x).

    Only the labelled rows move: ids to learn from are at most about most_labelled, so they are broadcast.
    """
    marked = learned_from(labels, most_labelled)
    known = rows.join(F.broadcast(marked.select("doc_id")), "doc_id", "left_semi")
    statistics = known if "x" in rows.columns else with_stats(known)
    rows = statistics.groupBy("doc_id").agg(F.min("x").alias("x")).join(marked, "doc_id").select("x", "y", (fold() == 3).alias("apart"))
    rows = cut(rows.repartition(SUMS))
    ours, apart = rows.where("NOT apart"), rows.where("apart")
    moments = _summed(ours, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    if moments is None:
        return Model(None, None, None, None, None)
    n, mean = moments[0], moments[1 : STATS + 1] / moments[0]
    scale = np.sqrt(np.maximum(0, moments[STATS + 1 :] / n - mean**2))
    scale = np.where(scale > 1e-9, scale, 1.0)

    def normal(x, y):
        phi = Model.features(x, mean, scale)
        return np.concatenate([(phi.T @ phi).ravel(), phi.T @ y])

    sums = _summed(ours, normal)
    d = FEATURES + 1
    weights = np.linalg.solve(sums[: d * d].reshape(d, d) + RIDGE * n * np.eye(d) / FEATURES, sums[d * d :])
    model = Model(mean, scale, weights, None, None)

    def places(batches):
        for batch in batches:
            if batch.num_rows:
                at = np.round(model.ridge(_x(batch)), 3)
                yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("y")], ["at", "y"])

    held = apart if not apart.isEmpty() else ours
    counts = held.mapInArrow(places, "at double, y double").groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones")).orderBy("at").collect()
    model.knots, model.values = pooled(*(np.array([r[c] for r in counts], float) for c in ("at", "n", "ones")))
    return model


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score and what is predicted of it."""
    statistics = cut(with_stats(table(spark, sf_dir, "documents")))
    model = spark.sparkContext.broadcast(fit(statistics, table(spark, sf_dir, "labels")))

    def scored(batches):
        for batch in batches:
            score = model.value.score(_x(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    out = statistics.mapInArrow(scored, f"doc_id {statistics.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPTED).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts."""
    model = spark.sparkContext.broadcast(fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels")))
    at = docs.columns.index("text")

    def accepted(batches):
        for batch in batches:
            for first, last, data, offsets in flat.runs(batch.column(at)):
                keep = model.value.score(stats(data, offsets)) >= ACCEPTED
                yield batch.slice(first, last - first).filter(pa.array(keep))

    return docs.mapInArrow(accepted, docs.schema)


ORACLE_SQL = {}
