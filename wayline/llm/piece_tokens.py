"""SentencePiece (byte-pair) encoding and decoding in vectorised merge rounds.

Texts are turned into flat arrays of symbols, a symbol for each character, and cut into
words: a run of word marks and what follows it. No piece reaches over such a cut (this
is checked for every model), so each distinct word of a run of texts is encoded once.
In a round, every word finds the best rank among its neighbouring pairs and merges all
pairs of that rank at once, from the left and without overlap; arrays are then
compacted. Words without a pair leave. Where a merge would give rise to a pair of the
same rank or a better one, the word merges its leftmost pair only, so that the order is
that of one merge at a time. Characters outside the vocabulary become bytes.

The model file is read on the driver; its tables, a few MB whatever the corpus, are
broadcast. Encoding adds no begin or end ids. Null and empty texts have no ids and
decode to an empty text. An empty table gives no rows. Rows are handled one by one, so
repeated ids and null ids keep their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat
from .shared import table

MARK = "▁"
NONE = np.int32(2**31 - 1)
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class Pieces:
    """A byte-pair model as arrays: characters, pairs with what they merge to, ranks and surfaces."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("only byte-pair models with byte fallback and plain white space are handled")
        pieces = [p.piece for p in model.pieces]
        kinds = [p.type for p in model.pieces]
        if any(k not in (NORMAL, UNKNOWN, CONTROL, BYTE) for k in kinds):
            raise ValueError("user-defined and unused pieces are not handled")
        self.n = len(pieces)
        self.byte_id = np.zeros(256, np.int32)
        self.surface: list[bytes] = []
        for i, (piece, kind) in enumerate(zip(pieces, kinds)):
            if kind == BYTE:
                self.byte_id[int(piece[1:-1], 16)] = i
                self.surface.append(bytes([int(piece[1:-1], 16)]))
            elif kind == CONTROL:
                self.surface.append(b"")
            elif kind == UNKNOWN:
                self.surface.append(model.trainer_spec.unk_surface.encode())
            else:
                self.surface.append(piece.replace(MARK, " ").encode())
        self.kinds = np.array(kinds, np.int8)
        symbol = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == NORMAL}
        for piece in list(symbol):
            if MARK in piece.lstrip(MARK) or (piece[:2] == MARK * 2 and piece.strip(MARK)):
                raise ValueError("a piece reaches over the start of a word")
        whole = len(symbol)
        for c in sorted({c for p in list(symbol) for c in p} - set(symbol)):
            symbol[c] = self.n + len(symbol) - whole  # only inside pieces: no id of its own
        self.code = np.full(0x110000, -1, np.int32)
        self.inside = np.zeros(len(symbol) - whole, np.int64)
        for s, i in symbol.items():
            if len(s) == 1:
                self.code[ord(s)] = i
                if i >= self.n:
                    self.inside[i - self.n] = ord(s)
        scores = np.array([p.score for p in model.pieces], np.float32)
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        pairs = {}
        for piece, kind in zip(pieces, kinds):
            if kind == NORMAL:
                for k in range(1, len(piece)):
                    a, b = symbol.get(piece[:k]), symbol.get(piece[k:])
                    if a is not None and b is not None:
                        pairs[a << 32 | b] = symbol[piece]
        size = 1 << max(4, (8 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.keys, self.merged = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        keys = np.array(list(pairs), np.int64)
        self.probes = 1
        for key, slot in zip(keys.tolist(), self._slot(keys).tolist()):
            k = 0
            while self.keys[(slot + k) % size] != -1:
                k += 1
            self.keys[(slot + k) % size], self.merged[(slot + k) % size] = key, pairs[key]
            self.probes = max(self.probes, k + 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What each pair of symbols merges to, or NONE."""
        out = np.full(len(a), NONE, np.int32)
        ask = np.flatnonzero((a >= 0) & (b >= 0))
        key = a[ask].astype(np.int64) << 32 | b[ask]
        slot = self._slot(key)
        for _ in range(self.probes):
            if not len(ask):
                break
            found = self.keys[slot]
            hit = found == key
            out[ask[hit]] = self.merged[slot[hit]]
            on = ~hit & (found != -1)
            ask, key, slot = ask[on], key[on], (slot[on] + 1) % len(self.keys)
        return out

    def ranks(self, merged: np.ndarray) -> np.ndarray:
        return np.where(merged == NONE, NONE, self.rank[np.minimum(merged, self.n - 1)])

    def encode_words(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The final symbols of words given one after another, and how many each has."""
        word = np.arange(len(lengths))
        symbols, out_word, out = symbols.copy(), [], []
        starts = np.cumsum(lengths) - lengths
        last = starts + lengths - 1
        merged = np.full(len(symbols), NONE, np.int32)
        merged[:-1] = self.merge(symbols[:-1], symbols[1:])
        merged[last] = NONE
        rank = self.ranks(merged)
        while len(word):
            best = np.minimum.reduceat(rank, starts)
            done = best == NONE
            if done.any():
                gone = np.repeat(done, lengths)
                out.append(symbols[gone])
                out_word.append(np.repeat(word[done], lengths[done]))
                stay = ~gone
                symbols, merged, rank = symbols[stay], merged[stay], rank[stay]
                word, lengths, best = word[~done], lengths[~done], best[~done]
                starts = np.cumsum(lengths) - lengths
                if not len(word):
                    break
            at = np.flatnonzero(rank == np.repeat(best, lengths))
            if len(at) > len(word):
                # Of overlapping pairs every second one, from the left.
                run = np.ones(len(at), bool)
                run[1:] = at[1:] != at[:-1] + 1
                head = np.flatnonzero(run)
                at = at[(np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))) % 2 == 0]
            if len(at) > len(word):
                at = self._in_order(symbols, merged, starts, lengths, best, at)
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols[at] = merged[at]
            place = (np.cumsum(keep) - 1)[at]
            owner = np.searchsorted(starts, at, "right") - 1
            lengths = lengths - np.bincount(owner, minlength=len(lengths))
            starts = np.cumsum(lengths) - lengths
            symbols, merged, rank = symbols[keep], merged[keep], rank[keep]
            # Pairs that touch a merged symbol are looked up anew.
            touch = np.unique(np.concatenate([place, place - 1]))
            touch = touch[touch >= 0]
            inner = np.ones(len(symbols), bool)
            inner[starts + lengths - 1] = False
            merged[touch] = NONE
            touch = touch[inner[touch]]
            merged[touch] = self.merge(symbols[touch], symbols[touch + 1])
            again = np.unique(np.concatenate([place, np.maximum(place - 1, 0)]))
            rank[again] = self.ranks(merged[again])
        if not out:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        out, out_word = np.concatenate(out), np.concatenate(out_word)
        order = np.argsort(out_word, kind="stable")
        return out[order], np.bincount(out_word)

    def _in_order(self, symbols, merged, starts, lengths, best, at):
        """at without all but the first merge of the words in which a new pair would come before a later one."""
        owner = np.searchsorted(starts, at, "right") - 1
        many = np.bincount(owner, minlength=len(starts))[owner] > 1
        p, w = at[many], owner[many]
        new = merged[p]
        left_in = p > starts[w]
        right_in = p + 2 < starts[w] + lengths[w]
        before = np.where(left_in, symbols[np.maximum(p - 1, 0)], -1)
        after = np.where(right_in, symbols[np.minimum(p + 2, len(symbols) - 1)], -1)
        joined = np.full(len(p), -1, np.int32)
        joined[1:][p[1:] == p[:-1] + 2] = new[:-1][p[1:] == p[:-1] + 2]
        worst = np.minimum(self.ranks(self.merge(before, new)), np.minimum(self.ranks(self.merge(new, after)), self.ranks(self.merge(joined, new))))
        unsafe = np.unique(w[worst <= best[w]])
        if not len(unsafe):
            return at
        first = np.ones(len(at), bool)
        first[1:] = owner[1:] != owner[:-1]
        return at[first | ~np.isin(owner, unsafe)]

    def encode_run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of texts in one byte array, and the offsets of each text's ids."""
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        used = np.flatnonzero(chars[1:] > chars[:-1])
        points = np.insert(points, chars[:-1][used], ord(MARK)).astype(np.int64)
        points[points == 0x20] = ord(MARK)
        heads = chars[:-1][used] + np.arange(len(used))
        mark = points == ord(MARK)
        begins = mark.copy()
        begins[1:] &= ~mark[:-1]
        begins[heads] = True
        starts = np.flatnonzero(begins)
        lengths = np.diff(np.append(starts, len(points)))
        up, down = flat.powers(len(points) + 1)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(flat.mix(points.view(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        hashes = flat.mix((sums[starts + lengths] - sums[starts]) * down[starts] + lengths.astype(np.uint64))
        _, one, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        of = points[flat.ragged(starts[one], lengths[one])]
        symbols = self.code[of]
        symbols = np.where(symbols < 0, -2 - of, symbols).astype(np.int32)
        out, counts = self.encode_words(symbols, lengths[one])
        ids, counts = self._with_bytes(out, counts)
        first = np.cumsum(counts) - counts
        each = counts[inverse]
        flat_ids = ids[flat.ragged(first[inverse], each)]
        ends = np.concatenate([[0], np.cumsum(each)])
        bounds = np.zeros(rows + 1, np.int64)
        text_words = np.searchsorted(starts, np.append(heads, len(points)))
        bounds[used + 1] = np.diff(ends[text_words])
        return flat_ids, np.cumsum(bounds)

    def _with_bytes(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that have no id as the ids of their bytes."""
        odd = np.flatnonzero((symbols < 0) | (symbols >= self.n))
        if not len(odd):
            return symbols, counts
        s = symbols[odd]
        point = np.where(s < 0, -2 - s.astype(np.int64), self.inside[np.clip(s - self.n, 0, max(0, len(self.inside) - 1))] if len(self.inside) else 0)
        size = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
        width = np.ones(len(symbols), np.int64)
        width[odd] = size
        out = np.repeat(symbols, width)
        ends = np.cumsum(width)
        at = ends[odd] - size
        for k in range(4):
            has = size > k
            tail = 6 * (size[has] - 1 - k)
            value = point[has] >> tail
            lead = np.array([0, 0x00, 0xC0, 0xE0, 0xF0])[size[has]]
            out[at[has] + k] = self.byte_id[(value | lead) if k == 0 else (value & 0x3F) | 0x80]
        word = np.repeat(np.arange(len(counts)), counts)
        return out, np.bincount(word, weights=width, minlength=len(counts)).astype(np.int64)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the leading word mark is dropped, stray bytes become U+FFFD."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        head = next((i for i in ids if self.kinds[i] != CONTROL), None)
        if head is not None and self.kinds[head] == NORMAL and raw[:1] == b" ":
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._decode_stray(ids)

    def _decode_stray(self, ids: list[int]) -> str:
        parts, stray, bare = [], b"", True
        for i in [*ids, None]:
            if i is not None and self.kinds[i] == BYTE:
                stray += self.surface[i]
                continue
            while stray:
                for n in (1, 2, 3, 4):
                    try:
                        parts.append(stray[:n].decode())
                        break
                    except UnicodeDecodeError:
                        n = 0
                if not n:
                    parts.append("�")
                stray, bare = stray[n or 1 :], False
            if i is not None and self.kinds[i] != CONTROL:
                piece = self.surface[i].decode()
                parts.append(piece[1:] if bare and self.kinds[i] == NORMAL and piece[:1] == " " else piece)
                bare = False
        return "".join(parts)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and decoded (the text of the ids) of each row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(Pieces(path))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model.value
        for batch in batches:
            for first, last, data, offsets in flat.runs(batch.column(1)):
                ids, bounds = pieces.encode_run(data, offsets)
                listed, ends = ids.tolist(), bounds.tolist()
                decoded = [pieces.decode(listed[a:b]) for a, b in zip(ends, ends[1:])]
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(both, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what encode_decode gives."""
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number and digest of its ids and of the text that they decode to."""
    return digests(encode_decode(table(spark, sf_dir, "documents"), model_path()))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as ids, with the text that the ids decode to."""
    return encode_decode(docs, model_path())


ORACLE_SQL = {}
