"""Language, tokens, chat, URLs, licences."""

import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetshape.llm import chat, language, licences, token_counts, url_filter

VOCABULARY = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# language

SYLLABLES = {"aa": ["ka", "lo", "mi", "ru"], "bb": ["sch", "ung", "eit", "ber"], "cc": ["ção", "nho", "que", "ar"]}


def prose(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    train = [(i, prose(lang, 60, rng), lang) for i, lang in enumerate(list(SYLLABLES) * 30)]
    train += [(900, None, "aa"), (901, "kalo", None), (902, "12 !", "bb")] + [(i, "привет мир как дела", "ru") for i in range(910, 930)]
    return language.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))


def test_held_out_language(spark, model):
    rng = random.Random(2)
    cases = [(i, prose(lang, rng.randint(3, 40), rng), lang) for i, lang in enumerate(list(SYLLABLES) * 40)]
    got = {r["doc_id"]: r for r in rows(language.identify(spark.createDataFrame(cases, "doc_id long, text string, lang string"), model))}
    right = [got[i]["lang_pred"] == lang for i, _, lang in cases]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_spans_of_mixed_text(model):
    rng = random.Random(4)
    a, b = prose("aa", 30, rng), prose("bb", 50, rng)
    langs, shares, spans = language.label(model, [f"{a}. {b}".encode(), "мир, дела".encode()])
    assert [s["lang"] for s in spans[0]] == ["aa", "bb"] and langs[0] == "bb" and 0.5 < shares[0] < 1
    assert (spans[0][0]["start"], spans[0][1]["end"]) == (0, len(a) + 2 + len(b))
    assert abs(spans[0][1]["start"] - len(a) - 2) <= 8
    assert langs[1] == "ru"


def test_viterbi_matches_all_paths():
    """Batched paths over the words of all detours, and documents without any, against plain dynamic programming."""
    import numpy as np
    rng = np.random.default_rng(0)
    lengths = np.concatenate(([1, 7, 40, 3, 40, 12, 0], rng.integers(1, 60, 400)))
    starts = np.concatenate(([0], np.cumsum(lengths)))
    # Scores that wander: long and short runs of every language, at the ends and inside.
    scores = rng.normal(0, 9, (starts[-1], 3)).cumsum(0)
    scores = (scores - np.repeat(np.array([scores[a:b].mean(0) if b > a else np.zeros(3) for a, b in zip(starts, starts[1:])]), lengths, 0)) * rng.choice([0.05, 0.15, 0.4], starts[-1])[:, None]
    total = np.concatenate((np.zeros((1, 3)), scores.cumsum(0)))
    main = np.array([scores[a:b].sum(0).argmax() for a, b in zip(starts, starts[1:])])
    paths, shorter = language._paths(scores, total, main, starts), 0
    for i, (a, b) in enumerate(zip(starts, starts[1:])):
        if a == b:
            continue
        best = scores[a].copy()
        for t in range(a + 1, b):
            best = np.maximum(best, best.max() - language.SWITCH) + scores[t]
        path = paths.get(i, np.full(b - a, main[i]))
        assert len(path) == b - a
        value = scores[np.arange(a, b), path].sum() - language.SWITCH * (np.diff(path) != 0).sum()
        assert value == pytest.approx(best.max())
        shorter += i in paths and (path[0] != main[i]) + (path[-1] != main[i])
    assert 50 < len(paths) < 350 and shorter > 20


def test_counts_and_scores_against_loops(spark):
    """N-grams of words counted one by one, and likelihoods added one by one."""
    import math

    import numpy as np
    data = [(1, "Kalo kalo, miru!", "x"), (2, "schung ber", "y"), (3, "мир", "x"), (4, "42 -", "y"), (5, None, "y"), (6, "lost", None)]
    model = language.train(spark.createDataFrame(data, "doc_id long, text string, lang string"), sample=10)
    assert model.languages == ["x", "y"]

    def grams(word):
        marked = f"\x02{word.lower()}\x03"
        for n in (1, 2, 3):
            for i in range(len(marked) - n + 1):
                h = 0
                for k, c in enumerate(marked[i:i + n], 1):
                    h = (h * 0x9E3779B97F4A7C15 + ord(c) + k) % (1 << 64)
                yield ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % (1 << 64)) >> 50
    words = {"x": ["Kalo", "kalo", "miru", "мир"], "y": ["schung", "ber"]}
    counts = {lang: Counter(g for w in ws for g in grams(w)) for lang, ws in words.items()}
    whole = {lang: sum(c.values()) + language.SMOOTHING * language.BUCKETS for lang, c in counts.items()}
    script = lambda w: "cyrillic" if w[0] in "мир" else "latin"
    used = {lang: {script(w) for w in ws} for lang, ws in words.items()}
    asked = ["kalo", "bermi", "мирра", "Zürich"]
    got = language._scores(model, asked)
    for i, w in enumerate(asked):
        for j, lang in enumerate(model.languages):
            want = sum(math.log((counts[lang][g] + language.SMOOTHING) / whole[lang]) for g in grams(w)) - language.FOREIGN * (script(w) not in used[lang])
            assert got[i, j] == pytest.approx(want)
    assert np.isfinite(got).all()


def test_paths_without_the_single_best_language(monkeypatch):
    """The best single language is not on the best path, and no run gains a whole change over it."""
    import numpy as np
    scores = np.array([[0.0, -10.0, -4.0]] * 4 + [[-10.0, 0.0, -4.0]] * 4)
    monkeypatch.setattr(language, "_scores", lambda model, words: scores)
    text = "ab cd ef gh ij kl mn op"
    langs, shares, spans = language.label(language.Model(["A", "B", "C"], np.zeros((1, 3)), np.ones((1, 3), bool)), [text.encode()])
    assert [(s["lang"], text[s["start"]:s["end"]]) for s in spans[0]] == [("A", "ab cd ef gh "), ("B", "ij kl mn op")]
    assert (langs[0], shares[0]) == ("A", 0.5)


def test_language_of_odd_rows(docs, no_docs, model, spark):
    got = rows(language.identify(docs, model))
    assert len(got) == docs.count() and language.identify(no_docs, model).count() == 0
    letterless = {r["doc_id"] for r in rows(docs) if not any(c.isalpha() for c in r["text"] or "")}
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == letterless
    nothing = language.train(no_docs)
    assert {r["lang_pred"] for r in rows(language.identify(docs, nothing))} == {"und"}


# tokens

def test_token_counts_match_the_library(docs, no_docs):
    library = token_counts.load(VOCABULARY)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows(token_counts.token_counts(docs, VOCABULARY)))
    want = Counter()
    for r in rows(docs):
        text = r["text"] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        want[r["doc_id"], len(text.encode()), n, n > 2048] += 1
    assert got == want and token_counts.token_counts(no_docs, VOCABULARY).count() == 0


def test_tokens_of_every_safe_character_and_of_random_text():
    library, counter = token_counts.load(VOCABULARY), token_counts.Counter(VOCABULARY, token_counts.whole_tokens(VOCABULARY))
    safe = [c for c in map(chr, range(0xD800)) if token_counts.SAFE.fullmatch(c)]
    texts = [f"a{c}b {c}" for c in safe]
    rng = random.Random(9)
    letters = "aA'sSt’ΣσςİßéÉ  \n\t\x1c\x85 19²½!?#<|>_日本かナ한€\u0301ก"
    for _ in range(3000):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        texts.append(s + rng.choice(["", "<|endoftext|>", "<|startoftext|>x", "<|ENDOFTEXT|>"]) + s)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [counter.count(t) for t in texts] == want


# chat

def test_layouts_become_canonical_turns(spark):
    cases = {
        "prompt_response": {"prompt": "p", "response": "r"},
        "prompt_completion": {"completion": "c", "prompt": "p"},
        "instruction_output": {"instruction": "i", "output": "o"},
        "instruction_input_output": {"instruction": "i", "input": None, "output": "o"},
        "system_prompt_response": {"system": "s", "prompt": "p", "response": None},
        "messages_role_content": {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]},
        "conversations_from_value": {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        "dialog_messages": {"dialog": {"messages": [{"role": "user", "text": "a"}]}},
        "message_row": {"role": "bot", "text": 'q"\n'},
        None: {"foo": 1},
    }
    df = spark.createDataFrame([(str(k), json.dumps(v)) for k, v in cases.items()], "name string, j string")
    got = {r["name"]: r for r in rows(chat.canonical_turns(df.select("name", F.parse_json("j").alias("record")), "record").drop("record"))}
    assert {k: r["layout"] for k, r in got.items()} == {str(k): k for k in cases}
    turns = {k: [(t["role"], t["text"]) for t in r["turns"]] for k, r in got.items()}
    assert turns["instruction_input_output"] == [("user", "i"), ("assistant", "o")]
    assert turns["system_prompt_response"] == [("system", "s"), ("user", "p"), ("assistant", "")]
    assert turns["messages_role_content"] == turns["conversations_from_value"] == [("user", "a"), ("assistant", "b")]
    assert turns["message_row"] == [("assistant", 'q"\n')] and turns["None"] == []


def test_chat_reads_back_what_it_wrote(spark):
    rng = random.Random(6)
    bits = ["<|im_start|>", "<|im_end|>", "<|im_sep|>", "<\\|", "<\\\\|", "<", "|", "\\", "é\n", "$1", "\\E", "\U0001f600", "", "x y"]
    text = lambda: rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))])
    turns = [(c, t, rng.choice(["user", "assistant", "system", None, "we<|im_sep|>ird"]), text()) for c in range(12) for t in range(rng.randint(1, 9))]
    turns += [(None, 0, "assistant", "lost"), (5, None, "user", "first"), turns[0], turns[0]]
    df = spark.createDataFrame([(*t, "more", t[3]) for t in turns], "conv_id long, turn long, role string, text string, head string, formatted string")
    formatted = chat.format_records(chat.rows_as_records(df))
    read = rows(formatted.select("conv_id", chat.read_turns(F.col("formatted")).alias("r"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss")))
    want = {}
    for c, t, role, x in sorted(turns, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", x or ""))
    assert {r["conv_id"]: [(t["role"], t["text"]) for t in r["r"]] for r in read} == want
    assert {r["conv_id"]: r["loss"] for r in read} == {c: "".join(x for role, x in v if role == "assistant") for c, v in want.items()}
    assert chat.digests(chat.format_records(chat.rows_as_records(df.limit(0)))).count() == 0


# urls

def test_no_conversation_is_lost(spark):
    """Layouts with more fields, empty lists, unknown and null records, several layouts in one conversation."""
    records = [
        (1, 0, '{"messages": [{"role": "user", "content": "q", "name": "x"}, {"role": "assistant", "content": "r"}], "id": 7, "tags": ["a", ["b"]]}'),
        (2, 0, '{"id": 3, "prompt": "q", "meta": {"text": {"deep": [{"x": 1}]}}, "response": "r"}'), (3, 0, '{"messages": []}'),
        (4, 0, '{"question": "q", "answer": "r"}'), (5, 0, None), (6, 0, '{"conversations": [{"from": "human", "value": "q", "weight": 1.5}]}'),
        (6, 1, '{"role": "assistant", "text": "r", "lang": "en"}'), (6, 2, '{"what": 1}'), (7, 0, '[1, 2]'), (8, 0, '{"dialog": {"messages": [{"role": "user", "text": "q"}], "n": 2}}'),
        (None, 0, '{"role": "user", "text": "q"}')]
    df = spark.createDataFrame(records, "conv_id long, turn long, j string").select("conv_id", "turn", F.parse_json("j").alias("record"))
    formatted = chat.format_records(df)
    read = {r["conv_id"]: ([tuple(t.values()) for t in r["r"]], r["n_unknown"]) for r in rows(formatted.select("conv_id", "n_unknown", chat.read_turns(F.col("formatted")).alias("r")))}
    asked, answered = ("user", "q"), ("assistant", "r")
    assert read == {1: ([asked, answered], 0), 2: ([asked, answered], 0), 3: ([], read[3][1]), 4: ([], 1), 5: ([], 1), 6: ([asked, answered], 1), 7: ([], 1), 8: ([asked], 0), None: ([asked], 0)}
    assert {r["conv_id"]: r["n_turns"] for r in rows(chat.digests(formatted))}[4] == 0


def test_shapes_say_the_same(spark):
    df = spark.createDataFrame([(c, t, r, f"<|im_end|> {c} {t}") for c in range(20) for t, r in enumerate(("system", "user", "assistant"))], "conv_id long, turn long, role string, text string")
    by_shape = [sorted(map(tuple, chat.digests(chat.format_records(chat.rows_as_records(df, (s,)))).collect())) for s in chat.SHAPES]
    assert all(x == by_shape[0] for x in by_shape) and by_shape[0] == sorted(map(tuple, chat.digests(chat.format_records(chat.rows_as_records(df))).collect()))
    assert {r["layout"] for r in rows(chat.canonical_turns(chat.rows_as_records(df), "record").select("layout"))} == set(chat.SHAPES)


def test_a_very_long_conversation(spark):
    df = spark.range(5000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                  F.repeat(F.lit("wort "), 60).alias("text"))
    got = rows(chat.digests(chat.format_records(chat.rows_as_records(df))))[0]
    assert (got["n_turns"], got["loss_chars"]) == (5000, 2500 * 300)


def test_hosts_paths_and_rules(spark):
    cases = [("HTTP://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/"), ("https://example.net/EN/", "example.net", "/EN/", "net/"),
             ("http://x.org/fr/1", "x.org", "/fr/1", "org/fr/"), ("http://borg/fr/", "borg", "/fr/", None), ("http://x.net", "x.net", "", None),
             ("http://u?//x/y", "u", "", None), ("no scheme.net/", "", "", None), (None, "", "", None), ("", "", "", None),
             ("a://example.com/de/#", "example.com", "/de/", "example.com/de/"), ("x://É.NET:80/p", "É.net:80", "/p", None)]
    df = spark.createDataFrame([(i, c[0], "z", 1.0) for i, c in enumerate(cases)], "page_id long, url string, rule string, p_block double")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in rows(url_filter.judge_urls(df, url_filter.Judge(None, 0.0)))}
    assert got == {i: c[1:] for i, c in enumerate(cases)}
    assert url_filter.judge_urls(df.limit(0), url_filter.Judge(None, 0.0)).count() == 0


def test_trees_learn_lexical_features(spark):
    rng = random.Random(8)

    def url(bad):
        host = "-".join(rng.choice(["win", "buy", "sale"]) for _ in range(3)) if bad else rng.choice(["news", "garden", "museum"])
        return f"http://{host}{rng.randrange(90)}.example.biz/" + (f"{rng.getrandbits(60)}?a=1&b=2&c=3" if bad else "page/view")
    data = [(url(i % 3 == 0), i % 3 == 0) for i in range(600)]
    judge = url_filter.train(spark.createDataFrame(data[:400] + [(None, True), ("http://x.biz/", None)], "url string, blocked boolean"))
    test = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(data[400:])], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] == "block" for r in rows(url_filter.judge_urls(test, judge))}
    assert sum(got[i] == b for i, (_, b) in enumerate(data[400:])) / 200 > 0.95
    empty = url_filter.train(spark.createDataFrame([], "url string, blocked boolean"))
    assert {r["verdict"] for r in rows(url_filter.judge_urls(test, empty))} == {"allow"}


def test_features_against_plain_python(spark):
    import math
    urls = ["https://Shop-one.Example.net/a/b//c?x=1&y=2&&z#f?q=1", "http://a.b.c", "no scheme/x?y=1", "", None, "https://münchen.de/ü?k", "http://h" + "/long" * 3000 + "?p"]
    got = {r["url"]: r for r in rows(url_filter.lexical(spark.createDataFrame([(u,) for u in urls], "url string")))}
    for u in urls:
        r, text = got[u], u or ""
        rest = text.split("://", 1)[1] if "://" in text else ""
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host):])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        query = text.split("?", 1)[1].split("#")[0] if "?" in text.split("#")[0] else ""
        plain = re.sub(r"[^!-~]", "~", text)
        shares = [n / len(plain) for n in Counter(plain).values()]
        assert (r["host"], r["path"], r["n_chars"], r["n_host"]) == (host, path, len(text), len(host))
        assert (r["depth"], r["hyphens"], r["dots"]) == (len(re.findall("/[^/]", path)), host.count("-"), host.count("."))
        assert r["digits"] == pytest.approx(sum(c in "0123456789" for c in text) / max(len(text), 1))
        assert r["entropy"] == pytest.approx(-sum(p * math.log2(p) for p in shares), abs=1e-9)
        if "?" in text.split("#")[0]:
            assert r["n_params"] == len([x for x in query.split("&") if x])


def test_suffix_rates_leave_the_own_fold_out(spark):
    data = [(f"http://h{i}.s{i % 3}.org/{i}", f"s{i % 3}.org", float(i % 4 == 0)) for i in range(60)] + [("http://x.only.one/1", "only.one", 1.0)]
    df = spark.createDataFrame(data, "url string, suffix string, label double")
    got = {r["url"]: r["suffix_rate"] for r in rows(url_filter.out_of_fold(df, 0.25))}
    fold = {r["url"]: r["f"] for r in rows(df.select("url", F.pmod(F.xxhash64("url"), F.lit(url_filter.FOLDS)).alias("f")))}
    for u, suffix, _ in data:
        rest = [y for v, s, y in data if s == suffix and fold[v] != fold[u]]
        assert got[u] == pytest.approx((sum(rest) + url_filter.PRIOR * 0.25) / (len(rest) + url_filter.PRIOR))
    assert got["http://x.only.one/1"] == 0.25


def test_url_query_joins_labels_by_number(spark, tmp_path):
    """Pages whose urls end in a labelled document's number teach; repeated, unlabelled, odd and very long ones are judged too."""
    from fleetshape.llm import queries
    urls = [(i, f"http://{'casino-win' if i % 2 else 'garden'}.example.com/x/{i}?{'a=1&b=2&c=3' if i % 2 else ''}") for i in range(300)]
    odd = [(900, None), (901, ""), (902, "http://A.ORG/fr/1"), (903, "https://b.net/" + "x" * 50_000), (3, urls[3][1]), (None, urls[4][1])]
    spark.createDataFrame(urls + odd, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, i % 2 == 0 and 1 or 0) for i in range(250)] + [(7, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = rows(queries.op8_url_filter(spark, str(tmp_path)))
    assert len(got) == 306
    held_out = [r for r in got if r["page_id"] is not None and 250 <= r["page_id"] < 300]
    assert sum((r["verdict"] == "block") == (r["page_id"] % 2 == 1) for r in held_out) > 45
    by_id = {r["page_id"]: r for r in got}
    assert (by_id[902]["host"], by_id[902]["rule"], by_id[902]["verdict"]) == ("a.org", "org/fr/", "allow") and by_id[903]["rule"] == "net/"


# licences

def plain_scan(text):
    """(template, segment, first word, last word, dice) by trying every line and every window of a template's length."""
    words = [(w, i + 1) for i, x in enumerate((text or "").lower().split("\n")) for w in re.split(r"[^\w]+|_", x) if w]
    only = [w for w, _ in words]
    grams = licences.bigrams_of(only)
    segments = [(0, 1, len(only), set(grams))]
    for line in sorted({i for _, i in words}):
        at = [p for p, (_, i) in enumerate(words) if i == line]
        segments.append((line, at[0] + 1, at[-1] + 1, set(licences.bigrams_of(only[at[0]:at[-1] + 1]))))
    found = []
    for t in licences.prepared():
        told = lambda ws: t.needed <= set(ws) and not t.barred & set(ws)
        for segment, a, b, own in segments:
            d = licences.dice(own, set(t.grams))
            if own and d >= licences.THRESHOLD and told(only[a - 1:b]):
                found.append((t.no, t.license, segment, a, b, d))
        good = {}
        for s in range(1, len(only) + 1):
            held = Counter(grams[s - 1:s - 1 + t.length]) & t.grams
            if sum(held.values()) >= licences.THRESHOLD * t.length - 1e-9 and told(only[s - 1:s + t.length]):
                good[s] = sum(held.values())
        while good:
            s = min(good)
            row = {}
            while s in good:
                row[s] = good.pop(s)
                s += 1
            best = min(row, key=lambda x: (-row[x], x))
            found.append((t.no, t.license, None, best, best + t.length, row[best] / t.length))
    return {(no, seg, a, b, round(d, 9)) for no, name, seg, a, b, d in found
            if not any(o[1] != name and o[3] <= a and o[4] >= b and o[4] - o[3] > b - a for o in found)}


PROSE = "The garden was quiet and nobody in the house had seen the lamp.\n"


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in rows(licences.scan(df))}


def named(row):
    return sorted({m["license"] for m in row["matches"]})


def test_licences_match_brute_force(spark, docs, no_docs):
    rng = random.Random(7)
    cases = [None, "", "License", "the license", "Licensed under"]
    for _, t in licences.TEMPLATES:
        for _ in range(1):
            v = t.split()
            for _ in range(rng.randint(0, 4)):
                v[rng.randrange(len(v))] = rng.choice(["other", "the", "LICENSE,", "3", "version", ""])
            body = "".join(x + rng.choice("    \n") for x in v)
            cases.append(PROSE * rng.randint(0, 1) + rng.choice(["", "so: "]) + body + rng.choice(["", "\n\nend", " " + body, " no derivatives", PROSE]))
    got = scanned(spark, cases)
    for i, t in enumerate(cases):
        assert {(m["no"], m["segment"], m["first_word"], m["last_word"], round(m["dice"], 9)) for m in got[i]["matches"]} == plain_scan(t), t
    assert Counter(r["doc_id"] for r in rows(licences.scan(docs))) == Counter(r["doc_id"] for r in rows(docs))
    assert licences.scan(no_docs).count() == 0 and licences.scan(docs.drop("lang")).where("size(matches) > 0").count() == 0


#: A header of each sibling family by its version and name, every one to be told from all others.
SIBLINGS = {
    **{f"{name}-{v}": licences._FSF.format(called, v).replace("-", " ") for name, called, vs in (
        ("GPL", "GNU General Public License", ("1", "2", "3")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3")),
        ("AGPL", "GNU Affero General Public License", ("3",))) for v in vs},
    **{k: f"This work is licensed under {v[-1]}." for k, v in licences.NAMES.items()},
}


@pytest.mark.parametrize("form", ["as one text", "as one line", "inside prose", "over several lines"])
def test_siblings_are_told_apart(spark, form):
    write = {"as one text": lambda t: t, "as one line": lambda t: PROSE * 2 + t + "\n" + PROSE * 3,
             "inside prose": lambda t: f"{PROSE.strip()} As the author says, {t} And {PROSE}", "over several lines": lambda t: PROSE + t.replace(" ", "\n", 6) + "\n" + PROSE}[form]
    got = scanned(spark, [write(t) for t in SIBLINGS.values()])
    for i, name in enumerate(SIBLINGS):
        assert [n.removesuffix(".0") for n in named(got[i])] == [name.removesuffix(".0")], SIBLINGS[name]


MIT = """MIT License\n\nCopyright (c) 2020 Foo\n
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so{}"""
CONDITIONS = """, subject to the following conditions:\n
The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.\n"""


def test_wrapped_and_embedded_notices(spark):
    filler = "".join(f"garden{i} was quiet{i}\n" for i in range(80))
    gpl = ("# This program is free software: you can redistribute it and/or\n# modify it under the terms of the GNU General Public License as\n"
           "# published by the Free Software Foundation, either version 3 of\n# the License, or (at your option) any later version.\n")
    cases = {
        MIT.format(CONDITIONS): "MIT", PROSE * 9 + MIT.format(CONDITIONS) + PROSE * 9: "MIT", MIT.format('.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY'): "MIT-0",
        filler + gpl + filler: "GPL-3.0", filler + gpl.replace("GNU", "GNU Affero") + filler: "AGPL-3.0",
        "Copyright 2020 Foo. Released under the MIT License. See the file for details.": "MIT", "Licensed under the MIT No Attribution License.": "MIT-0",
        f"{PROSE}See below. Released under the MIT\nLicense. Figures are licensed under CC BY-SA 4.0, as the author says. {PROSE}": "CC-BY-SA-4.0,MIT",
        PROSE * 5: "", "Released under a license of the house": "", "This work is licensed under CC BY-ND 4.0.": "CC-BY-ND-4.0",
    }
    got = scanned(spark, list(cases))
    assert [",".join(named(got[i])) for i in range(len(cases))] == list(cases.values())


def test_a_long_file_of_notices_is_read_in_one_pass(spark):
    import time
    notices = " ".join(t for _, t in licences.TEMPLATES)
    n = len(licences.words_of(notices))
    times = []
    for words in (5_000, 20_000):
        start = time.time()
        got = scanned(spark, [notices * (words // n + 1)])[0]
        times.append(time.time() - start)
        assert {m["license"] for m in got["matches"]} >= {"MIT", "GPL-3.0", "CC-BY-4.0"} and got["dice"] == 1.0
    assert times[1] < 60 and times[1] < 4 * times[0] + 5
