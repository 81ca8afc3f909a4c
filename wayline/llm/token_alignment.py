"""Cross-tokenizer alignment by pointer jumping.

Each text is encoded by two tokenizers (A: byte-level BPE, B: SentencePiece BPE). Tokens are byte ranges of the
same bytes, a space and the text. Every token points to its farthest-right overlapping token of the other side, or
to itself where none ends later; doubling of the pointers (``p = p[p]``) takes all of them to the last token of their
component, which labels the group. Both tokenizers part a text at a space between two characters that aren't
white space, whatever stands around it, so each distinct piece between such spaces is encoded and aligned once a
batch, and a document's groups are those of its pieces, one after another.

Links are never listed: a piece has its distinct id pairs with their numbers, and a document the sums of these.
Documents that hold a pair are counted by partial counts of each batch, summed by Spark. An A id's highest count
stands in a table no longer than A's vocabulary. The most frequent pairs (whole levels of a power of two, ``FREQUENT`` at
most) are broadcast with their counts; the rest, each in few documents, is joined by a shuffle.

Null and empty texts, and those whose tokens don't give their bytes again (such as texts with U+2581), have no
tokens: zeros and ''. Repeated rows count as so many documents and each has its row, ids may be null. A very long text
needs memory in proportion to itself. Columns other than id and text are not read, whatever their names. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat
from .shared import cut, shared_folder, table

#: Pairs that are broadcast with their counts (12 bytes each).
FREQUENT = 1 << 19
#: Bytes of text worked on together, and of distinct pieces encoded at once.
RUN_BYTES, AT_ONCE = 4 << 20, 1 << 17
#: Pairs that are looked up together.
PAIRS = 1 << 20
#: Fixed by the byte-level vocabulary: how a text is parted before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_ROW = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<int>, times array<bigint>"


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers; a token's bytes by id."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            stored = json.load(f)
        special = {x["content"] for x in stored["added_tokens"]}
        of = byte_level()
        # An entry's id is also its rank among the merges.
        ranks = {bytes(of[c] for c in word): k for word, k in stored["model"]["vocab"].items() if word not in special}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_size = np.zeros(1 + max(ranks.values()), np.int64)
        for word, k in ranks.items():
            self.a_size[k] = len(word)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.n_b = self.b.get_piece_size()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.n_b)))]
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        # An id with what follows it within a group and at the group's end.
        self.a_names = [np.array([f"{i}{sep}" for i in range(len(self.a_size))], object) for sep in ",|"]
        self.b_names = [np.array([f"{i}{sep}" for i in range(self.n_b)], object) for sep in (",", ";")]

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids by A and by B of each piece with a space before it, the numbers of these, and which pieces B gives again."""
        good = np.array(["▁" not in p for p in pieces], bool)
        a, b = [], []
        n_a, n_b = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        rows = np.flatnonzero(good)
        sizes = np.array([1 + len(pieces[i].encode()) for i in rows], np.int64)
        # Pieces part at spaces as in any text, so many are encoded as one; those that begin or end with white space stand alone.
        alone = np.array([pieces[i][0].isspace() or pieces[i][-1].isspace() for i in rows], bool)
        cuts = np.flatnonzero((np.diff(np.cumsum(sizes) // AT_ONCE) > 0) | alone[1:] | alone[:-1]) + 1 if len(rows) else rows
        for part, size in zip(np.split(rows, cuts), np.split(sizes, cuts)):
            if not len(part):
                continue
            ids_a, ids_b, whole = self._encode_joined([pieces[i] for i in part])
            if not whole:  # told apart one by one
                for i in part:
                    ids_a, ids_b, whole = self._encode_joined([pieces[i]])
                    good[i] = whole
                    if whole:
                        n_a[i], n_b[i] = len(ids_a), len(ids_b)
                        a.append(ids_a)
                        b.append(ids_b)
                continue
            ends = np.cumsum(size)
            for ids, of, n, all_ in ((ids_a, self.a_size, n_a, a), (ids_b, self.b_size, n_b, b)):
                n[part] = np.bincount(np.searchsorted(ends, np.cumsum(of[ids]), "left"), minlength=len(part))
                all_.append(ids)
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *a]), np.concatenate([none, *b]), n_a, n_b, good

    def _encode_joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, bool]:
        text = " ".join(pieces)
        ids_a, ids_b = self.a.encode_ordinary(" " + text), self.b.encode(text)
        raw = self.b_bytes
        return np.array(ids_a, np.int64), np.array(ids_b, np.int64), b"".join([raw[i] for i in ids_b]) == (" " + text).encode()


def components(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last A token of each A and each B token's component; ends are those of tokens that tile the same bytes."""
    n = len(a_ends)
    over = np.searchsorted(b_ends, a_ends, "left")  # the B token over an A token's last byte
    to = np.concatenate([np.where(b_ends[over] > a_ends, n + over, np.arange(n)), np.searchsorted(a_ends, b_ends, "left")])
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to[:n], to[n:]
        to = further


def counted(first: np.ndarray, second: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (of numbers below 2**32) in order, and the sum of the weights (or the number) of each."""
    keys = (first.astype(np.int64) << 32) | second
    if weights is None:
        keys, times = np.unique(keys, return_counts=True)
    else:
        order = np.argsort(keys)
        keys = keys[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        keys, times = keys[at], np.add.reduceat(weights[order], at) if len(at) else np.zeros(0, np.int64)
    return keys >> 32, keys & 0xFFFFFFFF, times


class Pieces:
    """Distinct pieces encoded and aligned: numbers of tokens, groups and links, the groups as text, id pairs with their numbers."""

    def __init__(self, pieces: list[str], tokenizers: Tokenizers):
        a, b, self.n_a, self.n_b, self.good = tokenizers.encode(pieces)
        group_a, group_b = components(np.cumsum(tokenizers.a_size[a]), np.cumsum(tokenizers.b_size[b])) if len(a) else (a, b)
        last = np.unique(group_a)
        piece = np.repeat(np.arange(len(pieces)), self.n_a)[last]
        group_a, group_b = np.searchsorted(last, group_a), np.searchsorted(last, group_b)
        self.n_groups = np.bincount(piece, minlength=len(pieces))
        in_a, in_b = (np.bincount(g, minlength=len(last)) for g in (group_a, group_b))
        self.n_links = np.zeros(len(pieces), np.int64)
        np.add.at(self.n_links, piece, in_a * in_b)
        self.texts = self._texts(tokenizers, a, b, in_a, in_b)
        # Distinct ids of each group, then distinct pairs of each piece.
        at_a, id_a, times_a = counted(group_a, a)
        at_b, id_b, times_b = counted(group_b, b)
        per_b = np.bincount(at_b, minlength=len(last))
        width = per_b[at_a]
        with_b = flat.ragged((np.cumsum(per_b) - per_b)[at_a], width)
        pair = np.repeat(id_a * tokenizers.n_b, width) + id_b[with_b]
        of, self.pairs, self.times = counted(np.repeat(piece[at_a], width), pair, weights=np.repeat(times_a, width) * times_b[with_b])
        self.n_pairs = np.bincount(of, minlength=len(pieces))
        self.first = np.cumsum(self.n_pairs) - self.n_pairs

    def _texts(self, tokenizers: Tokenizers, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> list[str]:
        """The groups of each piece, with a ; after each."""
        names = np.empty(len(a) + len(b), object)
        before = np.cumsum(in_a + in_b) - in_a - in_b
        for ids, n, at, (within, end) in ((a, in_a, before, tokenizers.a_names), (b, in_b, before + in_a, tokenizers.b_names)):
            places, last = flat.ragged(at, n), np.cumsum(n) - 1
            names[places] = within[ids]
            names[places[last]] = end[ids[last]]
        ends, listed = np.cumsum(self.n_a + self.n_b).tolist(), names.tolist()
        return ["".join(listed[x:y]) for x, y in zip([0, *ends], ends)]


def aligned(texts: list[str | None], tokenizers: Tokenizers) -> tuple:
    """The columns of _ROW for texts."""
    known: dict[str, int] = {}
    place = known.setdefault
    parts = [[place(p, len(known)) for p in _BETWEEN.split(t)] if t else [] for t in texts]
    pieces = Pieces(list(known), tokenizers)
    n = np.array([len(x) for x in parts], np.int64)
    piece = np.fromiter((i for x in parts for i in x), np.int64, int(n.sum()))
    doc = np.repeat(np.arange(len(texts)), n)
    good = n > 0
    good[doc[~pieces.good[piece]]] = False
    piece, doc = piece[good[doc]], doc[good[doc]]
    sums = [np.bincount(doc, weights=x[piece], minlength=len(texts)).astype(np.int64) for x in (pieces.n_a, pieces.n_b, pieces.n_groups)]
    links = np.zeros(len(texts), np.int64)
    np.add.at(links, doc, pieces.n_links[piece])
    listed = pieces.texts
    digests = [hashlib.sha256("".join([listed[i] for i in x])[:-1].encode()).hexdigest() if g else "" for x, g in zip(parts, good.tolist())]
    doc, piece, times = counted(doc, piece)
    width = pieces.n_pairs[piece]
    at = flat.ragged(pieces.first[piece], width)
    doc, pairs, times = counted(np.repeat(doc, width), pieces.pairs[at], weights=pieces.times[at] * np.repeat(times, width))
    bounds = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))]).astype(np.int32)
    listed_pairs = pa.ListArray.from_arrays(pa.array(bounds), pa.array(pairs.astype(np.int32)))
    return (*map(pa.array, (*sums, links)), pa.array(digests, pa.string()), listed_pairs, pa.ListArray.from_arrays(pa.array(bounds), pa.array(times)))


def _align(a_path: str, b_path: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = Tokenizers(a_path, b_path)
        for batch in batches:
            for first, last, _, _ in flat.runs(batch.column(1), RUN_BYTES):
                texts = batch.column(1).slice(first, last - first).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *aligned(texts, tokenizers)], names)

    names = ["doc_id", *(x.split()[0] for x in _ROW.split(", "))]
    return work


def _in_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a batch's rows hold each pair."""
    for batch in batches:
        pairs, n = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int32)), pa.array(n.astype(np.int64))], ["pair", "n"])


def _looked_up(frequent, best, n_b: int):
    """The sums of each row over frequent pairs, and its other pairs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ends = whole.column(1).offsets.to_numpy().astype(np.int64)
            first = 0
            while first < whole.num_rows:
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + PAIRS, "right")) - 1)
                yield sums(whole.slice(first, last - first))
                first = last

    def sums(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, counts = frequent.value
        most = best.value
        sizes = np.diff(batch.column(1).offsets.to_numpy())
        pairs, times = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (1, 2))
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
        found = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
        n = counts[at[found]]
        total, high = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        np.add.at(total, row[found], times[found] * n)
        np.add.at(high, row[found], times[found] * (n == most[pairs[found] // n_b]))
        bounds = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[~found], minlength=len(sizes)))]).astype(np.int32))
        rest = [pa.ListArray.from_arrays(bounds, pa.array(x[~found])) for x in (pairs, times)]
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, *range(3, batch.num_columns))), pa.array(high), pa.array(total), *rest], [batch.schema.names[0], *batch.schema.names[3:], "n_best", "count_sum", "pairs", "times"])

    return work


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair and n (rows that hold it) over rows with distinct pairs."""
    return rows.select("pairs").mapInArrow(_in_batch, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def frequent_from(counts: DataFrame, most: int) -> int:
    """The least power of two from which on no more than most pairs have that count."""
    level = F.floor(F.log2("n")).cast("int")
    total, least = 0, 62
    for k, n in sorted(((r["level"], r["of"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("of")).collect()), reverse=True):
        if (total := total + n) > most:
            break
        least = k
    return 1 << least


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of docs."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    path = f"{shared_folder(spark)}/aligned-{uuid.uuid4().hex}"
    found = rows.mapInArrow(_align(a_path, b_path), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_ROW}")
    found.withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    stored = spark.read.parquet(path)
    counts = cut(pair_counts(stored))
    n_b = Tokenizers(a_path, b_path).n_b
    a_id: Column = F.floor(F.col("pair") / n_b).cast("int")
    highest = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("most"))
    of_a = highest.toArrow()  # no more rows than A has entries
    best = np.zeros(1 + max(of_a["a"].to_pylist(), default=0), np.int64)
    best[of_a["a"].to_numpy()] = of_a["most"].to_numpy()
    least = frequent_from(counts, frequent)
    often = counts.where(F.col("n") >= least).toArrow()  # at most the given number of rows
    order = np.argsort(often["pair"].to_numpy())
    context = spark.sparkContext
    known = context.broadcast((often["pair"].to_numpy()[order], often["n"].to_numpy()[order])), context.broadcast(best)
    plain = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kind = stored.schema["doc_id"].dataType.simpleString()
    schema = f"row bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint, pairs array<int>, times array<bigint>"
    summed = stored.select("row", "pairs", "times", "doc_id", *plain).mapInArrow(_looked_up(*known, n_b), schema)
    rare = counts.where(F.col("n") < least).withColumn("a", a_id).join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("most")).cast("bigint").alias("high"))
    if least == 1:  # all pairs are broadcast
        return summed.select("doc_id", *plain, "n_best", "count_sum")
    summed = cut(summed)
    each = summed.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", "p.*").withColumnRenamed("pairs", "pair")
    more = each.join(rare, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("count_more"), F.sum(F.col("times") * F.col("high")).alias("best_more"))
    both = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
    return summed.join(more, "row", "left").select("doc_id", *plain, both("n_best", "best_more"), both("count_sum", "count_more"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its tokens, groups and links of both tokenizers, and how common its links are."""
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


ORACLE_SQL = {}
