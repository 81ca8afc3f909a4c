"""Substring dedup by relative Lempel-Ziv parsing.

A stretch of ``WINDOW`` or more words that also stands in a document of a smaller id is
a duplicate span. Documents are parted by ranges of their ids, so that of two parts the
earlier holds the smaller ids. Four steps, each over whole texts:

1. Every part indexes its windows: of each distinct one a key and the place of its first
   holder go to a range of keys.
2. A range tells each part where an earlier part holds windows of its own.
3. A part asks the earlier ones for reference blocks, the longest stretches of places that
   it was told; they answer with the words.
4. Every document is parsed greedily against the blocks and the part's own earlier
   documents: from a window that the index knows a factor is taken on along its reference,
   word by word, as long as both agree; the search goes on at the last windows that the
   factor doesn't hold whole, so that none across the factor's end is missed. The words of
   all factors, each of at least a window, go.

Words alone decide in the end: a key that misleads yields no factor. A key has 48 bits below
those of its range (8 or more); with N windows about N * N / 2**57 meet another's key and may
so miss a holder, which leaves their words only if no window beside them covers these.

A part is about ``PART_BYTES`` of text and a range a bounded number of keys, as a part sends
a window once however often it holds it; a part asks for a place once and is sent each stretch
once. So no passage, be it in a third of all documents, brings more to one task than a few
parts' worth. Parts are put in the same order wherever they are made again.

Ids are integers; rows with a null id are neither references nor changed. Rows that
repeat an id stand in one part and are judged each by itself, against smaller ids only.
Null and empty texts have no words; a very long text makes its part larger. Columns other
than id and text are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat
from .shared import partitions, table

WINDOW = 13
PART_BYTES, RANGE_KEYS = 8 << 20, 2_000_000
KEY_BYTES = 6

_KEYS = "range int, part int, keys binary, places binary"
_HOLDERS = "part int, homes binary, places binary"
_ASKED = "part int, asker int, stretches binary"
_BLOCKS = "part int, doc bigint, at bigint, words binary"
_PARSED = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, spans array<struct<start:bigint,length:bigint,home:bigint,home_start:bigint>>"


def _column(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy()


class _Part:
    """The texts of a part by id, their words one after another, and their windows, each distinct one with its first holder."""

    def __init__(self, rows: pa.Table):
        ids = _column(rows, "doc_id")
        order = np.lexsort((_column(rows, "mark"), ids))
        texts = rows.column("text").take(pa.array(order)).combine_chunks()
        self.ids = ids[order]
        data, hashes, starts, ends, counts, base = [], [], [], [], [], 0
        for _, _, raw, offsets in flat.runs(texts):
            a, b, at = flat.words(raw, offsets)
            hashes.append(flat.span_hashes(raw, a, b))
            starts.append(a + base)
            ends.append(b + base)
            counts.append(np.diff(at))
            data.append(raw)
            base += len(raw)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.data = join(data, np.uint8).tobytes()
        self.starts, self.ends = join(starts, np.int64), join(ends, np.int64)
        self.first = np.append(0, np.cumsum(join(counts, np.int64)))
        text = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        self.place = np.flatnonzero(text[: max(0, len(text) - WINDOW + 1)] == text[WINDOW - 1 :])
        self.text = text[self.place]
        windows = flat.chain_hashes(join(hashes, np.uint64), WINDOW)
        self.windows = windows[self.place] if len(windows) else windows
        self.distinct, self.head, self.which = np.unique(self.windows, return_index=True, return_inverse=True)

    def words(self, a: int, b: int) -> bytes:
        """What stands from word a to word b of one text."""
        return self.data[self.starts[a] : self.ends[b]]

    def words_of(self, text: int) -> list[bytes]:
        a, b = self.first[text], self.first[text + 1]
        return self.words(a, b - 1).split() if b > a else []

    def ranges(self, bits: int) -> np.ndarray:
        """Where the ranges begin among the distinct windows, and their end."""
        return np.searchsorted(self.distinct >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def _packed(values: np.ndarray, width: int) -> bytes:
    """Integers as their lowest bytes."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _index(bits: int):
    """Step 1, for a part."""

    def index(rows: pa.Table) -> pa.Table:
        part = _Part(rows)
        edges = part.ranges(bits)
        keys = (part.distinct << np.uint64(bits)) >> np.uint64(64 - 8 * KEY_BYTES)
        places = part.place[part.head] if len(part.head) else np.zeros(0, np.int64)
        width = 3 if len(part.starts) < 1 << 24 else 5
        used = np.flatnonzero(np.diff(edges))
        cut = [(edges[r], edges[r + 1]) for r in used]
        return pa.table({
            "range": pa.array(used, pa.int32()), "part": pa.array(np.full(len(used), rows.column("part")[0].as_py()), pa.int32()),
            "keys": pa.array([_packed(keys[a:b], KEY_BYTES) for a, b in cut], pa.binary()), "places": pa.array([_packed(places[a:b], width) for a, b in cut], pa.binary())})

    return index


def _holders(rows: pa.Table) -> pa.Table:
    """Step 2, for a range: of each window of a part that an earlier part holds, the first such part and the place in it."""
    parts = _column(rows, "part").astype(np.int64)
    packed = rows.column("keys").to_pylist()
    keys = [_unpacked(k, KEY_BYTES) for k in packed]
    n = np.array([len(k) for k in keys])
    places = np.concatenate([_unpacked(x, len(x) // c) for x, c in zip(rows.column("places").to_pylist(), n.tolist())]).astype(np.int64)
    key, part = np.concatenate(keys), np.repeat(parts, n)
    order = np.lexsort((part, key))
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    home = np.empty(len(order), np.int64)
    home[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    held = part[home] < part
    out, at = [], 0
    for p, k in zip(parts.tolist(), n.tolist()):
        first = home[at : at + k][held[at : at + k]]
        if len(first):
            out.append((p, part[first].astype(np.int32).tobytes(), _packed(places[first], 5)))
        at += k
    return pa.table({"part": pa.array([o[0] for o in out], pa.int32()), "homes": pa.array([o[1] for o in out], pa.binary()), "places": pa.array([o[2] for o in out], pa.binary())})


def _ask(holders: pa.Table) -> pa.Table:
    """Step 3, for a part: the stretches of places in each earlier part that hold windows of its own."""
    homes = np.concatenate([np.frombuffer(x, np.int32) for x in holders.column("homes").to_pylist()]).astype(np.int64)
    places = np.concatenate([_unpacked(x, 5) for x in holders.column("places").to_pylist()]).astype(np.int64)
    order = np.lexsort((places, homes))
    homes, places = homes[order], places[order]
    new = np.ones(len(homes), bool)
    new[1:] = (homes[1:] != homes[:-1]) | (places[1:] > places[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(homes)) - 1
    stretches, of = np.stack([places[first], places[last]], 1), homes[first]
    asked = np.unique(of)
    edges = np.searchsorted(of, np.append(asked, asked[-1] + 1))
    return pa.table({
        "part": pa.array(asked, pa.int32()), "asker": pa.array(np.full(len(asked), holders.column("part")[0].as_py()), pa.int32()),
        "stretches": pa.array([stretches[a:b].astype("<i8").tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())})


def _answer(rows: pa.Table, asked: pa.Table) -> pa.Table:
    """Step 3, for a part that is asked: the words of each stretch with their document and place in it."""
    out: dict[str, list] = {"part": [], "doc": [], "at": [], "words": []}
    if rows.num_rows and asked.num_rows:
        part = _Part(rows)
        for asker, data in zip(asked.column("asker").to_pylist(), asked.column("stretches").to_pylist()):
            stretches = np.frombuffer(data, "<i8").reshape(-1, 2)
            text = np.searchsorted(part.first, stretches[:, 0], "right") - 1
            out["part"] += [asker] * len(stretches)
            out["doc"] += part.ids[text].tolist()
            out["at"] += (stretches[:, 0] - part.first[text]).tolist()
            out["words"] += [part.words(a, b + WINDOW - 1) for a, b in stretches.tolist()]
    return pa.table({"part": pa.array(out["part"], pa.int32()), "doc": pa.array(out["doc"], pa.int64()), "at": pa.array(out["at"], pa.int64()), "words": pa.array(out["words"], pa.binary())})


def parse(words: list[bytes], known: list[int], references) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, length, home, home_start) of a text.

    known: the windows that the index knows, in order. references(window): the (words, place, home, home_start)
    of each reference to try. A factor goes on along its reference as far as both agree.
    """
    out, at, k = [], 0, 0
    while True:
        k = bisect_left(known, at, k)
        if k == len(known):
            return out
        i, at = known[k], known[k] + 1
        for other, j, home, start in references(i):
            if words[i : i + WINDOW] != other[j : j + WINDOW]:
                continue
            n, most = WINDOW, min(len(words) - i, len(other) - j)
            step = 64
            while n < most:
                if words[i + n : i + n + step] == other[j + n : j + n + step]:
                    n = min(most, n + step)
                elif step == 1:
                    break
                else:
                    step = max(1, step // 8)
            out.append((i, n, home, start))
            at = i + n - WINDOW + 1
            break


def _parsed(rows: pa.Table, blocks: pa.Table) -> pa.Table:
    """Step 4, for a part."""
    out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "kept_text": [], "spans": []}
    if rows.num_rows:
        part = _Part(rows)
        # What the blocks hold: of each window one block and the place in it.
        at = np.zeros(0, np.int64)
        if blocks.num_rows:
            column = blocks.column("words").cast(pa.string()).combine_chunks()
            found, block, place, base = [], [], [], 0
            for first, last, raw, offsets in flat.runs(column):
                a, b, edge = flat.words(raw, offsets)
                windows = flat.chain_hashes(flat.span_hashes(raw, a, b), WINDOW)
                of = np.repeat(np.arange(last - first), np.diff(edge))
                inside = np.flatnonzero(of[: len(windows)] == of[WINDOW - 1 :])
                found.append(windows[inside])
                block.append(of[inside] + first)
                place.append(inside - edge[of[inside]])
            found, at = np.unique(np.concatenate(found), return_index=True)
            block, place = np.concatenate(block)[at], np.concatenate(place)[at]
            near = np.minimum(np.searchsorted(found, part.distinct), max(0, len(found) - 1))
            met = np.where(found[near] == part.distinct, near, -1)[part.which] if len(found) and len(part.distinct) else np.full(len(part.which), -1)
            docs, starts = _column(blocks, "doc"), _column(blocks, "at")
            raws = blocks.column("words")
        else:
            met = np.full(len(part.which), -1)
        own = part.head[part.which] if len(part.which) else np.zeros(0, np.int64)
        earlier = part.ids[part.text[own]] < part.ids[part.text] if len(own) else np.zeros(0, bool)
        known = (met >= 0) | earlier
        edges = np.searchsorted(part.text, np.arange(len(part.ids) + 1))
        texts: dict[int, list[bytes]] = {}
        held: dict[int, list[bytes]] = {}
        for t in range(len(part.ids)):
            words = texts.pop(t, None) or part.words_of(t)
            lo, hi = edges[t], edges[t + 1]
            mine = np.flatnonzero(known[lo:hi])
            factors = []
            if len(mine):
                first = part.first[t]

                def references(i):
                    w = lo + i
                    if met[w] >= 0:
                        b = int(block[met[w]])
                        if b not in held:
                            held[b] = raws[b].as_py().split()
                        j = int(place[met[w]])
                        yield held[b], j, int(docs[b]), int(starts[b]) + j
                    if earlier[w]:
                        o = int(part.text[own[w]])
                        if o not in texts:
                            texts[o] = part.words_of(o)
                        j = int(part.place[own[w]] - part.first[o])
                        yield texts[o], j, int(part.ids[o]), j

                # Windows of a text stand at consecutive words from its first.
                factors = parse(words, mine.tolist(), references)
            gone = np.zeros(len(words) + 1, np.int32)
            for i, n, _, _ in factors:
                gone[i] += 1
                gone[i + n] -= 1
            left = words
            if factors:
                keep = np.cumsum(gone)[:-1] == 0
                left = [words[k] for k in np.flatnonzero(keep).tolist()]
            out["doc_id"].append(int(part.ids[t]))
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(left))
            out["kept_text"].append(b" ".join(left).decode())
            out["spans"].append([{"start": i, "length": n, "home": home, "home_start": start} for i, n, home, start in factors])
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("home", pa.int64()), ("home_start", pa.int64())]))
    return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_text": pa.array(out["kept_text"], pa.string()), "spans": pa.array(out["spans"], span)})


def _unchanged(rows: DataFrame) -> DataFrame:
    """Rows without an id, whose words all stay."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    none = F.array().cast("array<struct<start:bigint,length:bigint,home:bigint,home_start:bigint>>")
    return rows.select("doc_id", F.size(words).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_removed"), F.array_join(words, " ").alias("kept_text"), none.alias("spans"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and spans (start, length, home, home_start: the factors) of each row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = rows.where("doc_id IS NOT NULL")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(math.ceil(size / part_bytes), partitions(spark))
    quantiles = known.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], max(10_000, 20 * n))).first()[0] if n > 1 else None
    # The ids at which parts begin, so that no id is in two of them.
    bounds = spark.sparkContext.broadcast(np.unique(np.array(quantiles or [], np.int64)))
    bits = max(8, math.ceil(math.log2(max(2 * partitions(spark), size / 6 / RANGE_KEYS))))

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds.value, ids.to_numpy(), "right").astype(np.int32))

    # Read by all steps; Spark shuffles it once.
    parts = known.select("doc_id", "text", F.xxhash64("text").alias("mark"), part_of("doc_id").alias("part")).repartition(n, "part")
    keyed = parts.groupBy("part")
    to_part = lambda df: df.repartition(n, "part").groupBy("part")
    holders = keyed.applyInArrow(_index(bits), _KEYS).groupBy("range").applyInArrow(_holders, _HOLDERS)
    asked = holders.groupBy("part").applyInArrow(_ask, _ASKED)
    blocks = keyed.cogroup(to_part(asked)).applyInArrow(_answer, _BLOCKS)
    parsed = keyed.cogroup(to_part(blocks)).applyInArrow(_parsed, _PARSED)
    return parsed.unionByName(_unchanged(rows.where("doc_id IS NULL")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of its words, of those removed, and a digest of what is kept."""
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = {
    "op2_substring_dedup": rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS words
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
m AS (SELECT words, min(doc_id) AS home FROM g GROUP BY words),
gone AS (
  SELECT DISTINCT doc_id, k FROM (SELECT g.doc_id, unnest(range(i, i + {WINDOW})) AS k FROM g JOIN m USING (words) WHERE m.home < g.doc_id)),
l AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id),
r AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(len(ks), 0) AS n_removed,
         CASE WHEN ks IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ks, i)) END AS kept
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM r"""
}
