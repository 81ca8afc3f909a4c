"""The training-data operators on small frames, against plain versions, and on odd input."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import zlib
from pyspark.sql import functions as F

from wayline.llm import exact_dedup, html_text, licenses, mixing, near_dedup, piece_tokens, quality, sharding, spot_signatures, substring_dedup

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, label string, hash string, key string"


def docs(spark, rows):
    """(doc_id, text[, source]) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", "h", "k") for r in rows], DOC)


def corpus(seed=1, n=60):
    draw = random.Random(seed)
    words = ["w%d" % i for i in range(400)] + ["the", "of", "and"] * 20
    passage = [draw.choice(words) for _ in range(60)]
    rows = []
    for i in range(n):
        t = [draw.choice(words) for _ in range(draw.choice([0, 3, 5, 40, 200]))]
        if i % 3 == 0:
            k = draw.randrange(len(t) + 1)
            t[k:k] = passage[draw.randrange(20) : draw.randrange(40, 60)]
        rows.append((i, " ".join(t)))
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(200, rows[7][1].upper()), (201, None), (202, ""), (203, " \n\t"), (204, "x" * 50_000), (205, "a b " * 20_000)]
    rows += [(1, rows[1][1]), (1, rows[1][1]), (300, "same id one " * 8), (300, "same id two " * 8)]
    return rows


EMPTY = []


def words_of(text):
    return (text or "").encode().split()


def test_substring_dedup_equals_brute_force(spark):
    rows = corpus()
    first = {}
    for d, t in rows:
        w = words_of(t)
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            first[key] = min(d, first.get(key, d))
    want = []
    for d, t in rows:
        w = words_of(t)
        gone = {k for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for k in range(i, i + 13)}
        want.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    out = substring_dedup.dedup(docs(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out) == sorted(want)
    for r in out:
        assert all(s["length"] >= 13 and s["home"] < r["doc_id"] for s in r["spans"])
    assert substring_dedup.dedup(docs(spark, EMPTY)).count() == 0
    assert substring_dedup.dedup(docs(spark, [(None, "a b")])).first()["kept_text"] == "a b"


def test_exact_dedup_equals_brute_force(spark):
    rows = corpus() + [(400 + i, "long " * 9000 + str(i % 2)) for i in range(4)]
    low = lambda t: (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    groups = {}
    for d, t in rows:
        groups.setdefault(low(t), []).append(d)
    out = exact_dedup.groups(docs(spark, rows)).collect()
    want = sorted((d, max(groups[low(t)]), len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for d, t in rows)
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out) == want
    assert sum(r["kept"] for r in out) == len(groups)
    kept = exact_dedup.keep_last(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns and sorted(low(r["text"]) for r in kept.collect()) == sorted(groups)
    assert exact_dedup.groups(docs(spark, EMPTY)).count() == 0


def test_chunks_follow_content():
    import numpy as np

    data = np.frombuffer(random.Random(3).randbytes(200_000), np.uint8)
    a, b = exact_dedup.boundaries(data), exact_dedup.boundaries(data[5000:])
    assert len(set(a.tolist()) & set((b + 5000).tolist())) > 0.8 * len(b)


@pytest.mark.parametrize("limit", [100, 700, 5000, 10**9])
def test_shards_fit(spark, limit):
    rows = corpus()
    out = sharding.assign(docs(spark, rows), limit).collect()
    assert len(out) == len(rows)
    sums = {}
    for r in out:
        sums.setdefault(r["shard"], []).append(r["n_bytes"])
    for r in out:
        assert r["shard_bytes"] == sum(sums[r["shard"]]) and r["shard_docs"] == len(sums[r["shard"]])
        assert r["shard_bytes"] <= limit or r["shard_docs"] == 1
    for a in sums:  # no shard lies below another, and a split was needed: its sibling's documents don't fit with it
        assert not any(b != a and b.startswith(a) for b in sums)
        whole = sum(x for b, v in sums.items() if a and b.startswith(a[:-1]) for x in v)
        assert not a or whole > limit
    assert sharding.assign(docs(spark, EMPTY), limit).count() == 0


def test_written_shards_hold_all_rows(spark, tmp_path):
    rows = corpus()
    d = docs(spark, rows)
    sharding.write(d, str(tmp_path / "out"), 700)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and sorted((r["doc_id"], r["text"] or "") for r in back.collect()) == sorted((a, b or "") for a, b in rows)


def test_spots(spark):
    rows = sorted(corpus(), key=lambda r: (r[0], r[1] or ""))
    out = spot_signatures.fingerprints(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    texts = [t or "" for _, t in rows]
    want = sorted((d, t[: len(t) - len(t) // 2] + texts[(i + 1) % len(texts)][: len(t) // 2]) for i, ((d, _), t) in enumerate(zip(rows, texts)))
    assert sorted((r["doc_id"], r["edited"]) for r in out) == want
    by = {}
    for r in out:
        assert by.setdefault(r["text"], r["spots"]) == r["spots"]
    assert spot_signatures.fingerprints(docs(spark, EMPTY)).count() == 0
    assert spot_signatures.fingerprints(docs(spark, [(None, "a b c")])).count() == 1
    pairs, members = spot_signatures.near_pairs(docs(spark, rows))
    sets = {r["doc_id"]: set(r["spots"]) for r in out}
    found = {(p["a"], p["b"]) for p in pairs.collect()}
    classes = {r["class_id"] for r in members.collect()}
    brute = {(a, b) for a in classes for b in classes if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert {tuple(sorted(p)) for p in found} == brute


def test_pieces_equal_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_tokens.model_path())
    draw = random.Random(2)
    texts = [t for _, t in corpus()] + ["", " ", "  a\tb\n", "▁a▁", "😀é�<s></s><unk><0x41>", "aaaaaaa" * 30, "nananana"]
    texts += ["".join(draw.choice("ab nesti\n éß日😀▁") for _ in range(draw.randrange(60))) for _ in range(500)]
    out = sorted(piece_tokens.encode_decode(docs(spark, list(enumerate(texts))), piece_tokens.model_path()).collect())
    for r, t in zip(out, texts):
        ids = model.encode(t or "")
        assert r["ids"] == ids and r["decoded"] == model.decode(ids)
    pieces = piece_tokens.Pieces(piece_tokens.model_path())
    for _ in range(500):
        ids = [draw.choice([draw.randrange(32000), draw.randrange(3, 259)]) for _ in range(draw.randrange(9))]
        assert pieces.decode(ids) == model.decode(ids)


def shingle_sets(rows):
    out = {}
    for d, t in rows:
        w = words_of(t)
        out[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def test_near_classes_equal_brute_force(spark):
    draw = random.Random(5)
    base = [[f"b{k}w{draw.randrange(500)}" for _ in range(300)] for k in range(4)]
    rows = [(i, " ".join(f"u{i}w{draw.randrange(500)}" for _ in range(100))) for i in range(20)]
    for k in range(4):
        for j in range(25):
            w = list(base[k])
            for _ in range(draw.randrange(4)):
                w[draw.randrange(300)] = "edit%d" % draw.randrange(10**6)
            rows.append((1000 * (k + 1) + j, " ".join(w)))
    rows += [(5000, None), (5001, ""), (5002, "one two"), (5003, "one two"), (5004, "one two three")]
    sets, parent = shingle_sets(rows), {}
    find = lambda x: x if parent.get(x, x) == x else find(parent[x])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    out = near_dedup.classes(docs(spark, rows)).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == {d: find(d) for d in sets}
    assert near_dedup.classes(docs(spark, EMPTY)).count() == 0
    assert near_dedup.classes(docs(spark, [(None, "a b"), (1, "a b")])).count() == 2


@pytest.mark.parametrize("block, shingles, passing", [(7, 10**6, 16), (2048, 400, 8192), (2048, 10**6, 8192)])
def test_large_buckets_lose_no_link(spark, monkeypatch, block, shingles, passing):
    """Texts around the threshold, some with repeated shingles: compared whole, however the blocks and slices fall."""
    for name, value in (("BLOCK", block), ("SHINGLES", shingles), ("PASSING", passing)):
        monkeypatch.setattr(near_dedup, name, value)
    draw = random.Random(9)
    base = ["b%d" % draw.randrange(10**6) for _ in range(200)]
    texts = {}
    for i in range(90):
        w = list(base)
        for at in draw.sample(range(0, 200, 5), draw.choice([1, 3, 5])):
            w[at] = "edit%d" % draw.randrange(10**6)
        texts[i] = w + (w[:40] if i % 6 == 0 else [])
    tuples = {i: [tuple(w[k : k + 5]) for k in range(len(w) - 4)] for i, w in texts.items()}
    codes = {t: c for c, t in enumerate(sorted({t for x in tuples.values() for t in x}))}
    bags = {i: np.sort(np.array([codes[t] for t in x], np.uint32)) for i, x in tuples.items()}
    parent = {}
    find = lambda x: x if parent.get(x, x) == x else find(parent[x])
    for a in bags:
        for b in bags:
            if a < b and near_dedup.likeness(bags[a], bags[b]) >= 0.8 - 1e-9:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {i: find(i) for i in bags}
    assert 1 < len(set(want.values())) < 90
    out = near_dedup.classes(docs(spark, [(i, " ".join(w)) for i, w in texts.items()])).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == want


def test_block_tells_every_joining_link():
    """All pairs of a block and those that pass by, against plain comparison; no pair is left to chance or a limit."""
    draw = np.random.default_rng(3)
    base = draw.integers(0, 2**32, 100, dtype=np.uint32)
    bags = []
    for i in range(60):
        x = base.copy()
        x[draw.choice(100, draw.integers(2, 14), replace=False)] = draw.integers(0, 2**32, 1, dtype=np.uint32)
        bags.append(np.sort(np.concatenate([x, x[:20]]) if i % 4 == 0 else x))
    sig = [np.zeros(near_dedup._PLACES, np.uint16).tobytes()] * 60
    held = near_dedup._Block(list(range(30)), list(range(30)), sig[:30], [x.tobytes() for x in bags[:30]], 0.8)
    found = [link for y in range(30, 60) for link in held.links(y, y, np.arange(30), bags[y].tobytes())]
    parents = []
    for links in (found, [(a, b) for a in range(30) for b in range(30, 60) if near_dedup.likeness(bags[a], bags[b]) >= 0.8 - 1e-9]):
        parent = {}
        find = lambda x: x if parent.get(x, x) == x else find(parent[x])  # noqa: B023, E731
        for a, b in links:
            parent[max(find(a), find(b))] = min(find(a), find(b))
        parents.append([find(x) for x in range(60)])
    assert parents[0] == parents[1]
    assert len(found) == 60 - len(set(parents[0]))


def test_likeness_of_weighted_sets():
    assert near_dedup.likeness(np.array([1, 2, 3], np.uint32), np.array([2, 3, 4], np.uint32)) == pytest.approx(0.5)
    assert near_dedup.likeness(np.array([1, 1, 2, 2], np.uint32), np.array([1, 2], np.uint32)) == pytest.approx(1.0)
    x, y = {1: 3 / 4, 2: 1 / 4}, {1: 1 / 2, 2: 1 / 2}
    want = sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x) for i in x)
    assert near_dedup.likeness(np.array([1, 1, 1, 2], np.uint32), np.array([1, 2], np.uint32)) == pytest.approx(want)


def test_mix(spark):
    draw = random.Random(4)
    rows = [(i, "w " * draw.randrange(1, 60), f"s{i % 5}") for i in range(900)] + [(1000, None, None), (1001, "a b", None), (1002, "", "z")]
    d = docs(spark, rows).select("doc_id", "source", mixing.words_in(F.col("text")).alias("size"))
    out = mixing.sample(d).collect()
    assert len(out) == len(rows)
    taken, target, size = {}, {}, {}
    for r in out:
        assert r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]], size[r["source"]] = r["target"], r["source_size"]
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    for s in target:
        assert target[s] <= 3 * size[s] + 1e-6 and abs(taken[s] - target[s]) <= 10
    assert sorted(map(tuple, mixing.sample(d).collect()), key=repr) == sorted(map(tuple, out), key=repr)
    assert mixing.sample(d.limit(0)).count() == 0


def test_licenses(spark):
    rows = [(1, "All Rights Reserved. all rights, reserved"), (2, "CC BY"), (3, "licensed under the Apache License, Version 2.0"), (4, None), (5, ""), (6, "the GNU General Public License"), (6, "the GNU General Public License")]
    rows += [(7, "Permission is hereby granted, at no cost and free of charge, to any person obtaining a copy of this software and associated documentation files"), (8, "all rights " * 30_000)]
    out = sorted(licenses.scan(docs(spark, rows)).collect(), key=lambda r: r["doc_id"])
    got = [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for r in out]
    assert got[0] == (1, 6, 2, 0, 3, "reserved", "reserved") and got[1] == (2, 2, 1, 0, 0, "cc-by", "cc-by")
    assert got[2][2] == 0 and got[2][6] == "apache-2.0" and got[3] == (4, 0, 0, None, None, "", "") and got[4][1] == 0
    assert got[5] == got[6] == (6, 5, 1, 2, 2, "gpl", "gpl") and "mit" in got[7][6] and got[8][2] == 0
    assert all(0 <= r["score"] <= 1 for r in out) and licenses.scan(docs(spark, EMPTY)).count() == 0


def test_quality_is_learned(spark):
    draw = random.Random(6)
    good = lambda: ". ".join(" ".join("".join(draw.choice("abcdeirstno") for _ in range(draw.randrange(2, 9))) for _ in range(12)).capitalize() for _ in range(5)) + "."
    bad = lambda: " ".join("".join(draw.choice("ABCXYZ#$%") for _ in range(6)) + "!!" for _ in range(40))
    rows = [(i, good() if i % 4 else bad()) for i in range(600)] + [(700, None), (701, ""), (None, "x")]
    d = docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(600)], "doc_id bigint, quality int")
    statistics = quality.with_stats(d)
    model = quality.fit(statistics, labels)
    held = [r for r in statistics.where("doc_id < 600").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    import numpy as np

    score = model.score(np.array([r["x"] for r in held]))
    assert np.mean((score >= 0.7) == np.array([r["doc_id"] % 4 > 0 for r in held])) > 0.97
    none = quality.fit(statistics, labels.limit(0))
    assert none.score(np.zeros((2, quality.STATS))).tolist() == [0.5, 0.5]


def test_html(spark):
    chain = html_text.trained()
    pages = html_text.labelled_pages(150, 77)
    right = sum(html_text.extract_text(page, chain) == "\n".join(" ".join(x.split()) for x in main) for page, main in pages)
    assert right > 0.85 * len(pages)
    page = "<html><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One\n two&nbsp;three.<p>Four &lt;five&gt;</article><div class='comments'><p>I agree.</p></div><script>var a='<p>no</p>'</script></body>"
    assert html_text.extract_text(page, chain) == "A & B\nOne two three.\nFour <five>"
    rows = spark.createDataFrame([(1, "u", None, "t"), (2, None, "", "t"), (None, "u", "<p>" * 5000 + "x", "t")], "page_id bigint, url string, html string, text string")
    assert len(html_text.extract(rows, chain).collect()) == 3


@pytest.mark.parametrize("inline, kept", [
    ('<svg width="1"/>', ""), ("<svg/>", ""), ("<math/>", ""), ('<object data="x"/>', ""), ("<canvas/>", ""), ('<svg-icon name="a"></svg-icon>', ""), ("<template-x>a</template-x>", "a"),
    ("<object-list>a</object-list>", "a"), ("<svg><path d='M0'/></svg>", ""), ("<svg><style/><title>a</title></svg>", "a"), ("<math><mi>x</mi></math>", "x"), ("<object>a</object>", "a"),
    ("<canvas>a</canvas>", "a"), ("<script>a</script>", ""), ("<STYLE media=x>a</style >", ""), ("<template>a</template>", ""), ("<iframe src=x>a</iframe>", ""), ("<textarea>a</textarea>", ""), ("<script>'</scripts>'</script>", "")])
def test_html_elements_within_text(inline, kept):
    """Only raw elements hold no text, and none takes what stands behind it."""
    page = f"<html><body>{inline}<article><p>One {inline} two.</p><p>Three.</p></article><p>{inline} Four.</p></body></html>"
    texts = [text for text, _, _ in html_text.blocks(page)]
    assert texts == [kept] * bool(kept) + [" ".join(f"One {kept} two.".split()), "Three.", f"{kept} Four.".strip()]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact dedup", "near dedup", "mixing", "tokens"]
    draw = random.Random(9)
    rows = [(i, " ".join("w%d" % draw.randrange(3000) for _ in range(120)) + ".", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "s0") for i in range(10)] + [(200 + i, rows[i][1] + " extra", "s1") for i in range(10)]
    plain = spark.createDataFrame([(a, b, "en", c, len(b)) for a, b, c in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    plain.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out[0].asDict())
    assert not {r["doc_id"] for r in out} & set(range(10)) - {r["doc_id"] for r in out if r["doc_id"] >= 10}
