"""Operators on vectors and on two tokenizers against plain versions that share no code with them."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from wayline.llm import token_alignment, vector_codes, vector_dedup

VECTORS = "vec_id bigint, embedding array<float>, label int, code string, row string"


def _rows(frame):
    return [r.asDict() for r in frame.collect()]


def _odd_vectors():
    nan, inf = float("nan"), float("inf")
    draw = np.random.default_rng(5)
    good = [(i, [float(x) for x in np.float32(draw.normal(size=8))], i % 3 if i % 7 else None, "x", "y") for i in range(60)]
    again = [good[3], good[3], (60, good[4][1], 1, None, None), (None, good[5][1], None, "x", "y"), (61, [0.0] * 8, 2, "x", "y")]
    bad = [(70, None, 1, "x", "y"), (71, [1.0] * 7 + [None], 1, "x", "y"), (72, [nan] + [1.0] * 7, 0, "x", "y"), (73, [inf] + [1.0] * 7, 0, "x", "y"), (74, [], 0, "x", "y")]
    return good + again + bad, {70, 71, 72, 73, 74}


def _plain_codes(rows, entries, rounds=4):
    """Codes by all distances in Python integers."""
    def order(r):
        return (r[0] is None, r[0] or 0, r[3])

    whole = [r for r in rows if r[1] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept = [(r[0], r[2], None, [math.floor(1024 * x) for x in r[1]]) for r in whole]
    width = len(kept[0][3]) // 4
    parts = [[r[3][p * width : (p + 1) * width] for r in kept] for p in range(4)]
    first = sorted(range(len(kept)), key=lambda i: order(kept[i]))[:entries]
    books = [[parts[p][i] for i in first] for p in range(4)]

    def assign(p):
        return [min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p])) for x in parts[p]]

    for _ in range(rounds):
        for p in range(4):
            found = assign(p)
            for i in range(len(books[p])):
                mine = [x for x, (_, j) in zip(parts[p], found) if j == i]
                if mine:
                    books[p][i] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [assign(p) for p in range(4)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(found[p][k][0] for p in range(4)) for k in range(len(kept))]
    by_label = Counter()
    for r, e in zip(kept, errors):
        by_label[r[1]] += e
    return Counter((r[0], "".join(f"{found[p][k][1]:02x}" for p in range(4)), errors[k], by_label[r[1]], digest) for k, r in enumerate(kept))


@pytest.mark.parametrize("entries", [16, 256])
def test_codes_of_odd_vectors(spark, entries):
    rows, _ = _odd_vectors()
    frame = spark.createDataFrame(rows, VECTORS).repartition(5)
    found = vector_codes.with_label_error(vector_codes.compress(frame, entries=entries))
    got = Counter((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in _rows(found))
    assert got == _plain_codes(rows, entries)


def test_codes_where_labels_are_joined_by_shuffle(spark, monkeypatch):
    rows, _ = _odd_vectors()
    monkeypatch.setattr(vector_codes, "FEW_LABELS", 1)
    found = vector_codes.with_label_error(vector_codes.compress(spark.createDataFrame(rows, VECTORS), entries=8))
    assert Counter(tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in _rows(found)) == _plain_codes(rows, 8)


def test_codes_of_nothing_and_of_large_components(spark):
    assert vector_codes.with_label_error(vector_codes.compress(spark.createDataFrame([], VECTORS))).collect() == []
    large = spark.createDataFrame([(1, [2.0**17] * 4, 1, "x", "y")], VECTORS)
    with pytest.raises(Exception, match="a component is"):
        vector_codes.compress(large).collect()


def test_bounds_leave_out_what_cannot_be_nearest():
    draw = np.random.default_rng(2)
    entries, parts = (draw.integers(-40, 40, (n, 4)) for n in (90, 500))
    pivots = vector_codes.far_apart(entries, 5)
    far = np.sqrt(((parts[:, None] - pivots[None]) ** 2).sum(2).astype(float))
    which, least = vector_codes.nearest(parts, entries, far, pivots)
    every = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert np.array_equal(which, every.argmin(1)) and np.array_equal(least, every.min(1))


def _plain_links(rows, threshold):
    unit = {}
    for k, (_, e, *_rest) in enumerate(rows):
        if e and all(x is not None and math.isfinite(x) for x in e) and any(e):
            n = math.sqrt(sum(x * x for x in e))
            unit[k] = [x / n for x in e]
    near = {k: {m for m in unit if m != k and len(unit[m]) == len(unit[k]) and sum(a * b for a, b in zip(unit[k], unit[m])) >= threshold} for k in unit}
    out = []
    for k, r in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for m in near.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        least = min((rows[m][0] for m in seen if rows[m][0] is not None), default=None)
        out.append((r[0], len(near.get(k, ())), least, r[0] == least))
    return Counter(out)


def _clustered(n, width, spread, seed):
    draw = np.random.default_rng(seed)
    heads = draw.normal(size=(n, width))
    out = []
    for k in range(n):
        for j in range(1 + 12 * (k % 17 == 0) + 60 * (k == 5)):
            v = heads[k] / np.linalg.norm(heads[k]) + spread * draw.normal(size=width) / math.sqrt(width) * (j > 0)
            out.append([float(x) for x in np.float32(v)])
    return out


@pytest.mark.parametrize(("cell", "most"), [(2048, 8192), (16, 20)])
def test_links_of_odd_and_clustered_vectors(spark, cell, most):
    rows, bad = _odd_vectors()
    rows += [(100 + i, e, 0, None, None) for i, e in enumerate(_clustered(40, 16, 0.1, 3))]
    rows += [(500, [0.5, 0.5], 0, None, None), (501, [1e30, 1e30], 0, None, None), (502, [1e-40, 1e-40], 0, None, None), (9, [0.5, -0.5], 0, None, None)]
    found = _rows(vector_dedup.near(spark.createDataFrame(rows, VECTORS).repartition(3), cell=cell, most=most, recall=0.99999))
    assert Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found) == _plain_links(rows, 0.9)
    assert all(r["n_links"] == 0 and r["kept"] for r in found if r["vec_id"] in bad)


def test_links_of_nothing(spark):
    assert vector_dedup.near(spark.createDataFrame([], VECTORS)).collect() == []


def test_recall_of_links_at_the_threshold(spark):
    """Pairs whose cosine is barely above the threshold are found as often as the plan says."""
    draw = np.random.default_rng(11)
    rows, n = [], 1500
    for k in range(n):
        a, b = draw.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [(2 * k, [float(x) for x in a], 0, None, None), (2 * k + 1, [float(x) for x in 0.9005 * a + math.sqrt(1 - 0.9005**2) * b], 0, None, None)]
    found = vector_dedup.near(spark.createDataFrame(rows, VECTORS), cell=32)
    linked = found.where("n_links > 0").count() / 2
    assert vector_dedup.Plan(2 * n, cell=32).signs >= 6
    assert linked >= 0.99 * n


def test_counts_that_pairs_at_the_threshold_reach():
    p = 0.95
    k = vector_dedup.at_least(32, p, 0.9995)
    tail = lambda m: sum(math.comb(32, i) * p**i * (1 - p) ** (32 - i) for i in range(m, 33))
    assert tail(k) >= 0.9995 > tail(k + 1)


def _plain_alignment(texts):
    """Every text aligned by walking both token lists, with the tokenizers' own libraries."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a_of = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a_of.encode_special_tokens = True
    entry = {v: k for k, v in a_of.get_vocab().items()}
    byte, spare = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            byte[chr(b)] = b
        else:
            byte[chr(256 + spare)] = b
            spare += 1
    b_of = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    groups = []
    for text in texts:
        found = []
        if text:
            a = a_of.encode(" " + text, add_special_tokens=False).ids
            b = b_of.encode(text)
            raw_a = [bytes(byte[c] for c in entry[i]) for i in a]
            raw_b = [bytes([int(b_of.id_to_piece(i)[3:5], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
                i = j = 0
                while i < len(a):
                    m, n = i + 1, j + 1
                    x, y = len(raw_a[i]), len(raw_b[j])
                    while x != y:
                        if x < y:
                            x, m = x + len(raw_a[m]), m + 1
                        else:
                            y, n = y + len(raw_b[n]), n + 1
                    found.append((a[i:m], b[j:n]))
                    i, j = m, n
        groups.append(found)
    links = [Counter((x, y) for g, h in found for x in g for y in h) for found in groups]
    held = Counter(k for c in links for k in c)
    best = {}
    for (x, _), n in held.items():
        best[x] = max(n, best.get(x, 0))
    out = []
    for found, c in zip(groups, links):
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in found)
        sums = sum(c.values()), sum(n for k, n in c.items() if held[k] == best[k[0]]), sum(n * held[k] for k, n in c.items())
        out.append((sum(len(g) for g, _ in found), sum(len(h) for _, h in found), len(found), *sums, hashlib.sha256(text.encode()).hexdigest() if found else ""))
    return out


def _texts():
    draw = np.random.default_rng(8)
    letters = [*"abcdefgh  \n\t\r.,'", "  ", " ", "　", " ", "\x1c", "\x00", "é", "漢", "字", "😀", "ﬁ", "١", "'ll", " the", " of", "<s>", "<|endoftext|>", "<0x41>", "²", "é"]
    drawn = ["".join(draw.choice(letters, int(n))) for n in draw.integers(1, 60, 300)]
    plain = ["the cat sat on the mat", "The quick  brown fox.", "a▁b", "▁", " ", "  ", "\n", "x ", " x", "don't you'll", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    return [None, "", *plain, *plain, *drawn, "ab" * 20_000, "wort " * 30_000]


@pytest.mark.parametrize("frequent", [1 << 19, 40, 0])
def test_alignment_of_odd_texts(spark, frequent):
    import public_tokenizers as P

    texts = _texts()
    frame = spark.createDataFrame([(i if i % 50 else None, t, "x", "y", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, pairs string, times string, row int").repartition(3)
    found = token_alignment.align(frame, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), frequent=frequent)
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = Counter((r["doc_id"], *(r[c] for c in columns)) for r in _rows(found))
    assert got == Counter((i if i % 50 else None, *want) for i, want in enumerate(_plain_alignment(texts)))


def test_alignment_of_nothing(spark):
    import public_tokenizers as P

    assert token_alignment.align(spark.createDataFrame([], "doc_id bigint, text string"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).collect() == []
