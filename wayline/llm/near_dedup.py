"""Near dedup by ProbMinHash, banding and verification.

A text's shingles are its runs of five words (all its words, if fewer), weighted by how
often they occur. Each shingle is a Poisson process whose rate is its weight; an arrival
falls on one of ``BANDS * ROWS`` places at random, each place keeps the shingle that came
first, and a shingle's arrivals end once it is later than all places. Two texts agree at
a place with the probability of their probability Jaccard index, which for texts whose
shingles occur once is the Jaccard index of the sets.

Texts of equal shingles form a class first, and only one of each goes on, so that copies
are never paired. Texts that agree on a band meet in a bucket. In a small bucket all are
compared; in a large one all are compared to one of them. Each pair is verified on the
shingles themselves; the texts of a pair meet in a task by the first of the two, and a
first with many partners is sent to several tasks. Components of the verified links follow.
Whoever is then apart from the largest component of a large bucket is compared to all of
the bucket that is in other components: such texts form blocks, the members of their
buckets pass by each block in slices, and each pair is verified there and then, with no
limit on partners and no row for a pair. Only links that join components leave the task.
Components of all links are the classes.

A text without words is near to none. Null texts count as empty; a very long text is signed
in memory in proportion to itself. Rows that repeat an id are one document: each of its texts
is compared, and the classes of all of them are one. Rows with a null id have a class of their
own (null). Columns other than id and text are not read, whatever their names; ``stage`` passes
them through. An empty table gives no rows. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat
from .shared import cut, same, table

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 26, 5
#: Members up to which all of a bucket are compared, and partners that one task compares to a head.
SMALL, PARTNERS = 8, 2000
#: Texts and shingles that a block of texts still apart holds, and how many pass by it in one slice (a longer text is a block of its own).
BLOCK, SHINGLES, PASSING = 2048, 1_000_000, 8192
#: Share of equal places that a pair needs to be verified in a block. A pair at the threshold has fewer with a probability
#: of 5e-8, which is less than that of missing all bands (3e-5).
NEAR = 0.6

_PLACES = BANDS * ROWS
_FILLED = 1.15 * _PLACES * float(np.sum(1 / np.arange(1, _PLACES + 1)))


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text as (text, hash, count), in order of text and hash."""
    starts, ends, at = flat.words(data, offsets)
    h = flat.span_hashes(data, starts, ends)
    n = np.diff(at)
    text = np.repeat(np.arange(len(n)), n)
    runs = flat.chain_hashes(h, WORDS)
    whole = text[: len(runs)] == text[WORDS - 1 :] if len(runs) else np.zeros(0, bool)
    of, value = [text[: len(runs)][whole]], [runs[whole]]
    for k in range(1, WORDS):
        short = np.flatnonzero(n == k)
        if len(short):
            of.append(short)
            value.append(flat.chain_hashes(h, k)[at[:-1][short]])
    of, value = np.concatenate(of), np.concatenate(value)
    order = np.lexsort((value, of))
    of, value = of[order], value[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    return of[first], value[first], np.diff(np.append(first, len(of)))


def signatures(of: np.ndarray, value: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """The shingle that comes first at each place, for each text."""
    first = np.full(rows * _PLACES, np.inf)
    out = np.zeros(rows * _PLACES, np.uint64)
    total = np.bincount(of, weight, rows)
    block = np.ceil(_FILLED * weight / total[of]).astype(np.int64)
    at = np.zeros(len(of))
    drawn = np.zeros(len(of), np.int64)
    live = np.arange(len(of))
    while len(live):
        n = block[live]
        each = np.repeat(live, n)
        turn = np.repeat(drawn[live], n) + flat.ragged(np.zeros(len(live), np.int64), n)
        r = flat.mix(value[each] + turn.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        wait = -np.log(((r >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / weight[each]
        sums = np.cumsum(wait)
        ends = np.cumsum(n)
        x = sums - np.repeat(np.concatenate([[0], sums[ends[:-1] - 1]]), n) + np.repeat(at[live], n)
        place = of[each] * _PLACES + (flat.mix(r ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(_PLACES)).astype(np.int64)
        np.minimum.at(first, place, x)
        won = first[place] == x
        out[place[won]] = value[each][won]
        at[live] = x[ends - 1]
        drawn[live] += n
        latest = first.reshape(rows, _PLACES).max(1)
        live = live[at[live] < latest[of[live]]]
    return out.reshape(rows, _PLACES)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop, data, offsets in flat.runs(batch.column(1)):
            rows = stop - start
            of, value, count = shingles(data, offsets)
            sig = signatures(of, value, count.astype(float), rows)
            n = np.bincount(of, count, rows).astype(np.int64)
            a, b = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
            np.add.at(a, of, flat.mix(value + np.uint64(1)) * count.astype(np.uint64))
            np.add.at(b, of, flat.mix(value ^ np.uint64(0x9FB21C651E98DF25)) * count.astype(np.uint64))
            bands = np.zeros((rows, BANDS), np.uint64)
            for k in range(ROWS):
                bands = flat.mix(bands * np.uint64(31) + sig[:, k::ROWS])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), flat.signed(bands.ravel()))
            short = (sig >> np.uint64(48)).astype(np.uint16)
            packed = pa.array([x.tobytes() for x in short], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, rows), pa.array(n), flat.signed(a), flat.signed(b), lists, packed], ["doc_id", "n", "a", "b", "bands", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of each text with their repeats, 32 bits each, in order."""
    for batch in batches:
        for start, stop, data, offsets in flat.runs(batch.column(1)):
            of, value, count = shingles(data, offsets)
            every = np.repeat((value >> np.uint64(32)).astype(np.uint32), count)
            ends = np.concatenate([[0], np.cumsum(np.bincount(of, count, stop - start).astype(np.int64))]) * 4
            packed = pa.Array.from_buffers(pa.binary(), stop - start, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(every)])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), packed], ["id", "shingles"])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Probability Jaccard index of two sorted arrays of shingles with repeats."""
    if not len(a) or not len(b):
        return 0.0
    keys, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x = np.bincount(inverse[: len(a)], minlength=len(keys)) / len(a)
    y = np.bincount(inverse[len(a) :], minlength=len(keys)) / len(b)
    with np.errstate(divide="ignore"):
        ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    below = np.cumsum(x)  # of the x with a ratio up to this one
    above = y.sum() - np.cumsum(y)
    last = np.searchsorted(ratio, ratio, "right") - 1
    both = (x > 0) & (y > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = 1 / (below[last] / x + above[last] / y)
    return float(terms[both].sum())


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares every text to the head of its task; rows come sorted by head and task, the head first."""
    key, head = None, None
    for batch in batches:
        heads, tasks, own, ids = (batch.column(i).to_pylist() for i in range(4))
        found = []
        for i, raw in enumerate(batch.column(4)):
            words = np.frombuffer(raw.as_py(), np.uint32)
            if own[i] == 0:
                key, head = (heads[i], tasks[i]), np.sort(words)
            elif key == (heads[i], tasks[i]):
                found.append((heads[i], ids[i], likeness(head, words)))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "likeness"])


def verified(sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of a likeness of at least the threshold; sets: id and shingles, an id once."""
    pairs = pairs.select("a", "b").distinct()
    tasks = pairs.groupBy("a").agg((F.floor((F.count(F.lit(1)) - 1) / PARTNERS) + 1).alias("tasks"))
    members = pairs.join(tasks, "a").select(F.col("b").alias("id"), F.struct(F.col("a").alias("head"), F.pmod(F.xxhash64("b"), "tasks").alias("task"), F.lit(1).alias("own")).alias("to"))
    spread = tasks.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tasks") - 1)).alias("task"))
    heads = spread.select(F.col("a").alias("id"), F.struct(F.col("a").alias("head"), "task", F.lit(0).alias("own")).alias("to"))
    shipped = members.unionByName(heads).join(sets, "id").select("to.head", "to.task", "to.own", F.col("id").alias("doc_id"), "shingles")
    met = shipped.repartition("head", "task").sortWithinPartitions("head", "task", "own")
    return met.mapInArrow(_verify, "a bigint, b bigint, likeness double").where(F.col("likeness") >= threshold - 1e-9)


def components(links: DataFrame) -> DataFrame:
    """id and component (its least id) of each id that stands in a link (a, b)."""
    edges = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.least("id", "near").alias("component"))
    while True:
        labels = cut(labels)
        least = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        jump = labels.select(F.col("id").alias("at"), F.col("component").alias("further"))
        new = labels.join(least, labels["id"] == least["a"]).join(jump, F.col("component") == F.col("at"))
        new = cut(new.select("id", F.col("component").alias("old"), F.least("component", "near", "further").alias("component")))
        if new.where("old <> component").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")


class _Block:
    """Texts still apart, with an index of their shingles, and the components joined so far."""

    def __init__(self, ids: list[int], components: list[int], sigs: list[bytes], raw: list[bytes], threshold: float, agree: float = NEAR):
        self.ids, self.components, self.threshold, self.agree = ids, np.array(components, np.int64), threshold, agree
        self.sig = np.frombuffer(b"".join(sigs), np.uint16).reshape(-1, _PLACES)
        self.words = [np.frombuffer(x, np.uint32) for x in raw]
        parts = [np.unique(x, return_counts=True) for x in self.words]
        self.sizes = np.array([len(x) for x, _ in parts])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.plain = np.array([len(x) for x in self.words]) == self.sizes
        self.weights = np.concatenate([n / n.sum() for _, n in parts])
        self.all, self.codes = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
        self.mark = np.zeros(len(self.all))
        self.parent, self.root = {}, self.components.copy()

    def find(self, component: int) -> int:
        while component in self.parent:
            component = self.parent[component]
        return component

    def candidates(self, components: np.ndarray, sigs: np.ndarray) -> np.ndarray:
        """Which of the block (rows) may be near which of those that pass by (columns)."""
        agree = (self.sig[:, None, :] == sigs[None, :, :]).sum(2, dtype=np.int16)
        return (agree >= self.agree * _PLACES) & (self.components[:, None] != components[None, :])

    def links(self, id_: int, component: int, x: np.ndarray, raw: bytes) -> Iterator[tuple[int, int]]:
        """Verifies all of x (rows of the block) against one text; tells the links that join components."""
        x = x[self.root[x] != self.find(component)]
        if not len(x):
            return
        words = np.frombuffer(raw, np.uint32)
        values, n = np.unique(words, return_counts=True)
        at = np.minimum(np.searchsorted(self.all, values), len(self.all) - 1)
        known = self.all[at] == values
        self.mark[at[known]] = n[known] / n.sum()
        sizes = self.sizes[x]
        places = flat.ragged(self.starts[x], sizes)
        met, first = self.mark[self.codes[places]], np.cumsum(sizes) - sizes
        self.mark[at[known]] = 0
        shared = np.add.reduceat((met > 0).astype(np.int64), first)
        # The sum of the lesser weights is never below the index; it is worked out where shingles repeat and that is enough.
        bound = np.add.reduceat(np.minimum(met, self.weights[places]), first)
        plain = self.plain[x] & (len(values) == len(words))
        least = self.threshold - 1e-9
        near = plain & (shared / (sizes + len(values) - shared) >= least)
        for k in np.flatnonzero(near | (~plain & (bound >= least))):
            old, new = int(self.root[x[k]]), self.find(component)
            if old != new and (near[k] or likeness(self.words[x[k]], words) >= least):
                self.parent[old] = new
                self.root[self.root == old] = new
                yield self.ids[x[k]], id_


def _in_blocks(threshold: float, agree: float):
    """Compares the texts of a block to all that pass by; rows come sorted by block and slice, the block's own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, block = None, None, None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            member, ids, components = (batch.column(i).to_numpy() for i in (3, 4, 5))
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1) | (member[1:] != member[:-1])) + 1
            found = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
                if lo == hi:
                    continue
                if tuple(keys[lo]) != key:
                    key, own, block = tuple(keys[lo]), ([], [], [], []), None
                if member[lo] == 0:
                    for held, column in zip(own, (4, 5, 6, 7)):
                        held.extend(batch.column(column).slice(lo, hi - lo).to_pylist())
                    continue
                block = block or _Block(*own, threshold, agree)
                for at in range(lo, hi, 64):
                    end = min(hi, at + 64)
                    sigs = np.frombuffer(b"".join(batch.column(6).slice(at, end - at).to_pylist()), np.uint16).reshape(-1, _PLACES)
                    may = block.candidates(components[at:end], sigs)
                    for y in np.flatnonzero(may.any(0)):
                        found.extend(block.links(int(ids[at + y]), int(components[at + y]), np.flatnonzero(may[:, y]), batch.column(7)[int(at + y)].as_py()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], ["a", "b"])

    return run


def across(many: DataFrame, joined: DataFrame, one: DataFrame, sets: DataFrame, threshold: float, agree: float = NEAR) -> DataFrame:
    """Links (a, b) that join the components of large buckets, as far as any two of their texts are near.

    many: band, key, id and n of the members of large buckets; joined: id and component of
    linked ids; one: id and signature; sets: id and shingles.
    """
    placed = many.select("band", "key", "id", "n").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = placed.groupBy("band", "key", "component").agg(F.count(F.lit(1)).alias("n"))
    split = parts.groupBy("band", "key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("size")).where("parts > 1")
    met = cut(placed.join(split, ["band", "key"]).select("band", "key", "id", "n", "component", "size", F.col("main.component").alias("main")))
    # Of two components in a bucket one is not the largest: each text apart meets all of every bucket in which it is.
    # Texts apart from the same component share most of their buckets, so they share blocks.
    apart = met.where("component <> main")
    homes = apart.groupBy("id").agg(F.max(F.struct("size", "main")).alias("home"), F.max("n").alias("n"), F.max("component").alias("component"))
    homes = homes.select("id", "n", "component", F.col("home.main").alias("home"))
    loads = homes.groupBy("home").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / SHINGLES)).alias("blocks"))
    homes = cut(homes.join(loads, "home").select("home", F.pmod(F.xxhash64("id"), "blocks").alias("block"), "id", "component"))
    visits = cut(apart.select("band", "key", "size", "id").join(homes.drop("component"), "id").select("band", "key", "size", "home", "block").distinct())
    # Slices follow from the sizes of the buckets, so that those who pass by need not be brought together to be counted.
    slices = visits.groupBy("home", "block").agg(F.ceil(F.greatest(F.max("size"), F.sum("size") / BANDS) / PASSING).alias("slices"))
    numbered = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1))
    own = homes.join(slices, ["home", "block"]).select("home", "block", numbered.alias("slice"), F.lit(0).alias("member"), "id", "component")
    passing = met.select("band", "key", "id", "component").join(visits.join(slices, ["home", "block"]), ["band", "key"])
    passing = passing.select("home", "block", F.pmod(F.xxhash64("id", F.lit(1)), "slices").alias("slice"), F.lit(1).alias("member"), "id", "component").distinct()
    texts = own.unionByName(passing).join(one.select("id", "sig"), "id").join(sets, "id")
    texts = texts.select("home", "block", "slice", "member", "id", "component", "sig", "shingles")
    dealt = texts.repartition("home", "block", "slice").sortWithinPartitions("home", "block", "slice", "member", "id")
    return dealt.mapInArrow(_in_blocks(threshold, agree), "a bigint, b bigint")


def _of_texts(texts: DataFrame, threshold: float, agree: float) -> DataFrame:
    """doc_id, same_id and class_id of texts (doc_id, text), an id once."""
    signed = cut(texts.mapInArrow(_sign, "doc_id bigint, n bigint, a bigint, b bigint, bands array<bigint>, sig binary"))
    one = signed.where("n > 0").groupBy("n", "a", "b", "bands", "sig").agg(F.min("doc_id").alias("id"))
    members = signed.join(one.select("n", "a", "b", "id"), ["n", "a", "b"], "left").select("doc_id", F.coalesce("id", "doc_id").alias("same_id"))
    members, one = cut(members), cut(one.select("id", "n", "bands", "sig"))
    in_bands = one.select("id", "n", F.posexplode("bands").alias("band", "key"))
    # One draw for all bands: a group that shares many bands gets one head, and few pairs.
    sized = in_bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("id").alias("draw"), "id")).alias("head"))
    met = cut(in_bands.join(sized.where("size > 1"), ["band", "key"]).select("band", "key", "id", "n", "size", F.col("head.id").alias("head")))
    few, many = met.where(F.col("size") <= SMALL), met.where(F.col("size") > SMALL)
    listed = few.groupBy("band", "key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    each = F.flatten(F.transform("ids", lambda x, i: F.transform(F.slice("ids", i + 2, SMALL), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = listed.select(F.explode(each).alias("p")).select("p.*")
    pairs = pairs.union(many.where("id <> head").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")))
    wanted = met.select("id").distinct()
    sets = cut(texts.join(wanted, texts["doc_id"] == wanted["id"], "left_semi").mapInArrow(_sets, "id bigint, shingles binary"))
    links = cut(verified(sets, pairs, threshold))
    joined = components(links)
    more = cut(across(many, joined, one, sets, threshold, agree))
    if not more.isEmpty():
        joined = components(links.select("a", "b").union(more))
    return members.join(joined, members["same_id"] == joined["id"], "left").select("doc_id", "same_id", F.coalesce("component", "same_id").alias("class_id"))


def _of_repeated(texts: DataFrame, threshold: float, agree: float) -> DataFrame:
    """As _of_texts where an id may stand on several texts: each gets a number of its own, and what shares an id is one."""
    numbered = cut(texts.groupBy("doc_id", "text").agg(F.lit(1).alias("one")).drop("one").withColumn("number", F.monotonically_increasing_id()))
    found = _of_texts(numbered.select(F.col("number").alias("doc_id"), "text"), threshold, agree)
    known = cut(numbered.select("doc_id", "number").join(found.withColumnRenamed("doc_id", "number"), "number").select("doc_id", "same_id", "class_id"))
    least = lambda key: known.groupBy(key).agg(F.min("doc_id").alias("least"))
    # Documents linked to the least document of each of their classes.
    links = known.join(least("class_id"), "class_id").select(F.col("doc_id").alias("a"), F.col("least").alias("b")).where("a <> b")
    joined = components(links)
    same_ = known.join(least("same_id"), "same_id").groupBy("doc_id").agg(F.min("least").alias("same_id"))
    return same_.join(joined, same_["doc_id"] == joined["id"], "left").select("doc_id", "same_id", F.coalesce("component", "doc_id").alias("class_id"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", agree: float = NEAR) -> DataFrame:
    """doc_id, same_id (least id of equal shingles), class_id (least id of its class) and class_size: a row for each row of docs.

    With agree=0 no pair of a large bucket is left to the agreement of its signatures.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    ends = cut((_of_repeated if _repeats(texts) else _of_texts)(texts, threshold, agree))
    sizes = ends.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    found = ends.join(sizes, "class_id").select(F.col("doc_id").alias("_doc"), "same_id", "class_id", "class_size")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"))
    return rows.join(found, rows["doc_id"] == found["_doc"], "left").drop("_doc")


def _repeats(texts: DataFrame) -> bool:
    return not texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies."""
    return classes(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, that of the least id."""
    found = classes(docs)
    kept = found.where("class_id IS NULL OR class_id = doc_id").select(F.col("doc_id").alias("_doc")).distinct()
    return docs.join(kept, same(docs["doc_id"], kept["_doc"]), "left_semi")


ORACLE_SQL = {}
