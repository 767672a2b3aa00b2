"""Quality trees, hard negatives and tokenizer alignment against plain versions of themselves."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from fleetshape.llm import alignment, hard_negatives, quality_trees, queries

PATH = pytest.importorskip("public_tokenizers").path
A, B = PATH("byte_bpe_50k.json"), PATH("piece_bpe_32k.model")


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# quality trees

def junk(rng, kind):
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 120))]
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 1:
        return " ".join(w + rng.choice(["###", "$$$"]) for w in words)
    if kind == 2:
        return " ".join([words[0]] * len(words))
    return ". ".join(words)


def labelled(n, seed):
    rng = random.Random(seed)
    return [(i, junk(rng, i % 7 if i % 7 < 3 else 3), int(i % 7 >= 3)) for i in range(n)]


@pytest.fixture(scope="module")
def learned(spark):
    data = labelled(600, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + data_twice(data), "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in data] + [(5, None), (None, 1), (7, 0), (999, 1)], "doc_id long, quality int")
    return quality_trees.train(docs, labels)


def data_twice(data):
    return [data[3][:2]] * 20 + [(None, "no id")]


def test_held_out_quality(spark, learned):
    data = labelled(400, 9)
    got = {r["doc_id"]: r for r in rows(quality_trees.classify(spark.createDataFrame([d[:2] for d in data], "doc_id long, text string"), learned))}
    right = [got[i]["predicted"] == q for i, _, q in data]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())


def test_flattened_trees_are_walked_right(learned):
    rng = np.random.default_rng(0)
    x = rng.random((50, len(quality_trees.STATISTICS))) * 5

    def walk(tree, row, node):
        inner = len(learned.feature[tree])
        if node >= inner:
            return learned.value[tree][node - inner]
        return walk(tree, row, 2 * node + (2 if row[learned.feature[tree][node]] > learned.above[tree][node] else 1))
    plain = [learned.base + sum(walk(t, r, 0) for t in range(len(learned.feature))) for r in x]
    assert np.allclose(learned.raw(x), plain)


def test_split_is_the_best_of_all():
    rng = np.random.default_rng(4)
    x, bins = rng.integers(0, 6, (80, 3)), 6
    g, h = rng.normal(size=80), np.full(80, 0.5)
    feature, cut, value, node = quality_trees.grow(x, g, h, bins, 1)
    ridge, least = quality_trees.RIDGE, quality_trees.LEAST_WEIGHT

    def gain(f, c):
        left = x[:, f] <= c
        if h[left].sum() < least or h[~left].sum() < least:
            return 0
        return sum(g[m].sum() ** 2 / (h[m].sum() + ridge) for m in (left, ~left)) - g.sum() ** 2 / (h.sum() + ridge)
    gains = {(f, c): gain(f, c) for f in range(3) for c in range(bins)}
    assert gains[feature[0], cut[0]] == pytest.approx(max(gains.values()))
    side = x[:, feature[0]] > cut[0]
    assert (node == side).all() and value[1] == pytest.approx(-g[side].sum() / (h[side].sum() + ridge))


def test_worst_window_against_loop():
    rng = np.random.default_rng(2)
    lengths = [0, 5, 31, 32, 33, 200, 0]
    starts = np.concatenate(([0], np.cumsum(lengths)))
    marks = (rng.random(starts[-1]) < 0.3).astype(float)
    got = quality_trees._worst(marks, starts)
    for i, n in enumerate(lengths):
        own, w = marks[starts[i]:starts[i + 1]], quality_trees.WINDOW
        want = 0 if not n else own.mean() if n < w else max(own[k:k + w].mean() for k in range(n - w + 1))
        assert got[i] == pytest.approx(want)


def test_quality_edges(spark, learned, docs, no_docs):
    got = rows(quality_trees.classify(docs, learned))
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality_trees.classify(no_docs, learned).count() == 0
    of = lambda data: quality_trees.train(docs, spark.createDataFrame(data, "doc_id long, quality int"))
    score = lambda forest: {r["score"] for r in rows(quality_trees.classify(docs, forest))}
    assert score(of([(1, 1), (2, 1)])) == {1.0} and score(of([(1, 0)])) == {0.0} and score(of([])) == {0.5}


def test_quality_query_learns_nothing_held_out(spark, tmp_path):
    """Labels of held-out documents are turned round: no score may change."""
    data = labelled(300, 5)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    for name, flip in (("plain", False), ("turned", True)):
        folder = tmp_path / name
        spark.createDataFrame([d[:2] for d in data], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(i, 1 - q if flip and held(i) else q) for i, _, q in data], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    got = [{r["doc_id"]: r for r in rows(queries.op11_quality_classifier(spark, str(tmp_path / n)))} for n in ("plain", "turned")]
    assert got[0] == got[1] and all(r["held_out"] == held(i) for i, r in got[0].items())


# hard negatives

@pytest.mark.parametrize("n,k,m", [(1, 1, 1), (3, 64, 5), (65, 64, 130), (97, 33, 71), (0, 4, 3)])
def test_strassen_is_exact(n, k, m):
    rng = np.random.default_rng(n + k)
    for top in (300, 1 << 30):
        a, b = rng.integers(-top, top, (n, k)), rng.integers(-top, top, (k, m))
        want = np.array(a.astype(object) @ b.astype(object), dtype=object).reshape(n, m)
        got = hard_negatives.strassen(a, b, 8)
        if top == 300 or (n and max(abs(int(x)) for x in want.ravel()) < 1 << 63):
            assert (got == want).all()


def test_heaps_merge_in_any_order():
    rng = random.Random(1)
    offers = [(rng.randrange(4), rng.randrange(6), rng.randrange(50)) for _ in range(200)]
    best = {o: sorted({(-s, i, k) for k, (q, s, i) in enumerate(offers) if q == o})[:3] for o in range(4)}
    for order in (offers, offers[::-1]):
        heaps = hard_negatives.Heaps(4, 3)
        for at in range(0, 200, 17):
            heaps.offer(*(np.array(x) for x in zip(*order[at:at + 17])))
        got = {}
        for o, s, i in zip(*(x.tolist() for x in heaps.entries())):
            got.setdefault(o, []).append((-s, i))
        assert got == {o: [x[:2] for x in v] for o, v in best.items()}


def brute(vectors):
    """vectors: (vec_id, components, label), ids once."""
    import math
    usable = [(i, [math.floor(256 * float(np.float32(x))) for x in v], (c + 1) % 10 if i % 7 == 0 else c) for i, v, c in vectors
              if None not in (i, v, c) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, c in usable:
        if i % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, d) for j, w, d in usable if j != i]
        for s, p, d in sorted(x for x in scored if x[2] == c)[:5]:
            fits = sorted(x for x in scored if x[2] != c and 50 * -s <= 100 * -x[0] <= 95 * -s)[:3]
            out += [(i, p, r + 1, j, -s, -t) for r, (t, j, _) in enumerate(fits)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(8)
    plain = [(i, [rng.gauss(0, 0.4) for _ in range(9)], rng.randrange(10)) for i in range(700)]
    one = [0.25] * 9
    crowd = [(1000 + i, one, i % 3) for i in range(500)]  # a common vector: ties by id
    odd = [(2000, None, 1), (2001, [None] + [0.1] * 8, 1), (2050, [float("nan")] * 9, 1), (2003, [float("inf")] * 9, 2), (None, one, 3),
           (2004, one, None), (2100, [0.0] * 9, 4), (2005, [0.5] * 4, 4), (2006, [], 4)]
    return plain + crowd + odd


def test_hard_negatives_against_brute_force(spark, vectors, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CANDIDATE_BLOCK", 300)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 8)
    monkeypatch.setattr(hard_negatives, "STEP", 64)
    df = spark.createDataFrame([(*v, "clash", 1) for v in vectors + vectors[:3]], "vec_id long, embedding array<float>, label int, mark string, part int")
    got = sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 50 == 0).collect())
    assert got == brute(vectors) and len(got) > 50


def test_hard_negatives_edges(spark):
    kind = "vec_id long, embedding array<float>, label int"
    run = lambda data: rows(hard_negatives.mine(spark.createDataFrame(data, kind), F.col("vec_id") % 50 == 0))
    assert run([]) == [] and run([(50, [1.0], 1)]) == [] and run([(50, [1.0], 1), (51, [1.0], 1)]) == []
    huge = [(100, [3e38], 1), (101, [3e38], 1), (102, [1.0], 1), (103, [0.7], 2), (150, [1.0], 1)]
    assert [(r["anchor_id"], r["positive_id"], r["negative_id"]) for r in run(huge)] == [(150, 102, 103)]
    # Ids that repeat with other vectors are rows of their own.
    twice = [(50, [1.0], 1), (50, [2.0], 1), (60, [0.8], 2)]
    assert sorted((r["positive_score"], r["negative_score"]) for r in run(twice)) == [(131072, 104448), (131072, 104448)][:len(run(twice))]


# alignment

def plain_alignment(texts):
    """Per text: (n_a, n_b, n_groups, n_links, n_best, count_sum, sha), token by token."""
    from collections import Counter

    import sentencepiece
    from tokenizers import Tokenizer
    left = Tokenizer.from_file(A)
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=B)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in printable)}

    def spell_a(i):
        return bytes(of[c] for c in left.id_to_token(i))

    def spell_b(i):
        p = right.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()
    found = []
    for t in texts:
        a = left.encode(" " + t, add_special_tokens=False).ids if t else []
        b = right.encode(t) if t else []
        if not t or b"".join(map(spell_a, a)) != (" " + t).encode() or b"".join(map(spell_b, b)) != (" " + t).encode():
            found.append(None)
            continue
        spans = []
        for ids, spell in ((a, spell_a), (b, spell_b)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(spell(i)), i))
                at = out[-1][1]
            spans.append(out)
        pairs = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        cuts = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(s[2]) for s in side if low < s[1] <= cut) for side in spans))
            low = cut
        found.append((len(a), len(b), len(cuts), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    counts = Counter(p for f in found if f for p in f[3])
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    return [(f[0], f[1], f[2], len(f[3]), sum(counts[p] == top[p[1]] for p in f[3]), sum(counts[p] for p in f[3]), f[4]) if f else (0, 0, 0, 0, 0, 0, "")
            for f in found]


ODD = ["", None, " ", "  two  blanks ", "a", "Straße, été; niño 42!", "tab\tand\nline", "<|endoftext|> and </s><s> <unk>", "emoji 😀👍🏽 done", "▁lower", "中文 テスト",
       "ﬁ ligature", "x" * 3000, "é", "﻿bom", "nul\x00byte", "don't we'll", "العربية", "a b", "½ ²"]


def test_alignment_against_token_loop(spark, texts):
    own = [t if t is None or len(t) < 5000 else t[:4000] for t in texts] + ODD
    data = [(i, t, "clash", 3) for i, t in enumerate(own)] + [(None, "null id", None, None)] * 2 + [(4, own[4], "again", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, n_a string, links int").repartition(3)
    want = sorted((-1 if d[0] is None else d[0], *w) for d, w in zip(data, plain_alignment([d[1] for d in data])))
    # Small slices and chunks: a document more than one chunk away still counts.
    for size in ((alignment.SLICE, alignment.CHUNK), (200, 900)):
        got = alignment.align(df, A, B, slice_bytes=size[0], chunk_bytes=size[1]).select(
            F.coalesce("doc_id", F.lit(-1)), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
        assert sorted(tuple(r) for r in got.collect()) == want
    assert sum(w[1] > 0 for w in want) > len(want) / 2 and any(w[1] == 0 for w in want)


def test_parts_are_encoded_as_their_texts_are():
    """Cutting at plain blanks and remembering parts changes no token, in texts of every kind and after forgetting."""
    encoders = alignment.Encoders(alignment.ByteLevel(A), alignment.Pieces(B))
    rng = random.Random(6)
    letters = list("ab'sdTr .,\n\t1½ éß中😀\u0301\u200b-_#<|>") + ["▁", "ll ", "'re ", "\u00a0", "\x1c"]
    odd = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 50))) for _ in range(3000)]
    assert encoders.cuts and sum(n > 1 for n in pa.compute.list_value_length(encoders.parts(pa.array(odd, pa.large_string()))).to_pylist()) > 100
    for at in range(0, len(odd), 250):
        texts = odd[at:at + 250]
        if at == 1500:
            encoders.forget()
        for side, (ids, doc) in zip(encoders.sides, encoders.encode(pa.array(texts, pa.large_string()))):
            whole = side.encode(texts)
            assert ids.tolist() == [i for tokens in whole for i in tokens]
            assert doc.tolist() == [n for n, tokens in enumerate(whole) for _ in tokens]


def test_alignment_of_long_and_of_no_texts(spark, no_docs, texts):
    assert alignment.align(no_docs, A, B).count() == 0
    assert alignment.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), A, B).where("n_a = 0 and groups_sha256 = ''").count() == 2
    long = max((t for t in texts if t), key=len)
    got = rows(alignment.align(spark.createDataFrame([(1, long)], "doc_id long, text string"), A, B))[0]
    assert got["n_links"] == got["n_a"] + got["n_b"] - got["n_groups"] > 30_000
