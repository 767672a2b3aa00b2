"""Document operators against brute force, over odd rows."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from fleetshape.llm import decontaminate, mixing, quality, sharding, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


# quality rules

def measured(text):
    text = text or ""
    w = WORD.findall(text)
    wins = defaultdict(list)
    for i in range(len(w) - 7):
        wins[tuple(w[i:i + 8])].append(i)
    covered = {i + j for at in wins.values() if len(at) > 1 for i in at for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_ledger_matches_brute_force(docs):
    got = Counter((r["doc_id"], *[r[m] for m in quality.MEASURES[:5]]) for r in rows(quality.measure(docs)))
    assert got == Counter((r["doc_id"], *measured(r["text"])) for r in rows(docs))


def test_policies_and_ablations(docs, no_docs):
    ledger = quality.measure(docs)
    kept = {v: sum(r["kept"] for r in rows(quality.apply_policy(ledger, v))) for v in quality.POLICIES}
    assert 0 < kept["v2"] <= kept["v1"]
    table = {(r["policy"], r["left_out"]): r for r in rows(quality.ablations(ledger))}
    for v in quality.POLICIES:
        assert table[v, None]["n_kept"] == kept[v]
        for rule in quality.POLICIES[v]:
            rest = quality.mask_of(tuple(x for x in quality.POLICIES[v] if x != rule))
            n = ledger.where(f"failed & {rest} = 0").count()
            assert (table[v, rule]["n_kept"], table[v, rule]["n_only_by_rule"]) == (n, n - kept[v])
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and good.count() == kept["v2"]
    assert quality.measure(no_docs).count() == 0 and quality.keep_good(no_docs).count() == 0


def test_clean_texts_of_other_scripts_are_kept(spark):
    clean = {
        "cyrillic": "мир дом сад река лес", "greek": "σπίτι κήπος ποτάμι δάσος νερό", "arabic": "بيت حديقة نهر غابة ماء", "hebrew": "בית גן נהר יער מים",
        "devanagari": "घर बगीचा नदी जंगल पानी", "latin": "house garden river été Straße",
    }
    texts = {k: " ".join(f"{w}{i}" for i in range(6) for w in v.split()) + " USB" for k, v in clean.items()}
    texts["chinese"] = " ".join(f"第{i}个花园里有一条河,河边的人们每天早上都在那里散步和谈话。" for i in range(25)) + " USB"
    texts["thai"] = " ".join(f"สวนที่{i}มีแม่น้ำและผู้คนเดินเล่นอยู่ริมน้ำทุกเช้า" for i in range(25)) + " USB"
    bad = {"shouted": texts["latin"].upper(), "shouted cyrillic": texts["cyrillic"].upper(), "long words": " ".join(f"{i}" + "lampe" * 6 for i in range(25))}
    df = spark.createDataFrame([(k, v) for k, v in (texts | bad).items()], "doc_id string, text string")
    failed = {r["doc_id"]: r["failed"] for r in rows(quality.measure(df))}
    assert {k: failed[k] for k in texts} == dict.fromkeys(texts, 0)
    assert {k: failed[k] for k in bad} == {"shouted": 32, "shouted cyrillic": 32, "long words": 16}


# near-duplicates

def simhash_of(text):
    w = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = WORD.findall(w)
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def classes(pairs):
    """doc -> least id reachable, by comparing all fingerprints."""
    prints = sorted({f for _, f in pairs})
    parent = {f: f for f in prints}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f
    for i, a in enumerate(prints):
        for b in prints[i + 1:]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for d, f in pairs:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return Counter((d, f"{f:016x}", least.get(find(f))) for d, f in pairs)


def test_near_duplicates_match_brute_force(docs, no_docs):
    got = Counter(tuple(r) for r in simhash.near_duplicates(docs).collect())
    assert got == classes([(r["doc_id"], simhash_of(r["text"])) for r in rows(docs)])
    assert simhash.near_duplicates(no_docs).count() == 0


def test_links_of_crowded_and_sparse_groups(spark):
    """Chains, balls and lone pairs of fingerprints: the components are those of all pairs."""
    import random
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for center in list(prints)[:12]:
        at = center
        for _ in range(25):  # a chain, each two bits from the last; and a ball around its start
            at ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            prints |= {at, center ^ 1 << rng.randrange(64)}
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(sorted(prints))]
    got = simhash.with_components(spark.createDataFrame(signed, "doc_id long, fp long"))
    want = {d: c for (d, _, c) in classes([(d, p % (1 << 64)) for d, p in signed])}
    assert {r["doc_id"]: r["component_id"] for r in rows(got)} == want


def test_keep_one_keeps_one_of_each_group(docs, no_docs):
    whole = rows(simhash.near_duplicates(docs))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and simhash.keep_one(no_docs).count() == 0
    ids = [r["doc_id"] for r in rows(kept)]
    groups = {(r["component_id"], r["fingerprint"] if r["component_id"] is None else "") for r in whole}
    assert len(ids) == len(groups) and {r["component_id"] for r in whole} == set(ids)


# decontamination

ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text):
    return ITEM_WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def contaminated(text, items):
    w, hit, found = item_words(text), set(), set()
    for item, t in items:
        own = item_words(t)
        for s in range(max(len(own) - 10, 0) + 1) if own else ():
            win = own[s:s + 10]
            for i in range(len(w) - len(win) + 1):
                if w[i:i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), sorted(found)


@pytest.fixture(scope="module")
def items(texts):
    full = [t for t in texts[:40]]
    return [(1, " ".join(full[0].split()[3:16])), (10, full[0].upper()), (2, "two WORDS"), (3, "one"), (4, None), (5, ""),
            (6, "never seen anywhere in any text of these documents at all"), (None, " ".join(full[1].split()[:12])), (7, " ".join(full[2].split()[:10]))]


@pytest.mark.parametrize("limit", [100_000, 0])
def test_contamination_matches_brute_force(spark, docs, items, limit, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", limit)
    bench = spark.createDataFrame(items, "item_id long, text string")
    short = docs.where("length(text) < 5000 or text is null")
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], tuple(r["items"])) for r in rows(decontaminate.contamination(short, bench)))
    want = Counter()
    for r in rows(short):
        n, hit, found = contaminated(r["text"], items)
        want[r["doc_id"], n, hit, len(found), tuple(found)] += 1
    assert got == want


def test_drop_contaminated(spark, docs, no_docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = decontaminate.drop_contaminated(docs, bench)
    want = sum(1 for r in rows(docs) if contaminated((r["text"] or "")[:5000], items)[1] == 0)
    assert clean.columns == docs.columns and clean.count() == want
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == docs.count()
    assert decontaminate.contamination(no_docs, bench).count() == 0


# mixing

def filled(sizes, weights, cap):
    """Targets by repeated resharing."""
    target, open_ = {}, set(sizes)
    left = sum(sizes.values())
    while open_:
        unit = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if unit * weights[s] > cap * sizes[s]}
        if not full:
            return target | {s: unit * weights[s] for s in open_}
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix_comes_near_its_targets(docs, no_docs):
    got = rows(mixing.taken(docs))
    assert len(got) == docs.count() and mixing.taken(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0
    by_source = defaultdict(list)
    for r in rows(docs):
        by_source[r["source"]].append(len(WORD.findall(r["text"] or "")))
    order = sorted((s for s in by_source if s is not None), key=lambda s: s.encode()) + [None]
    sizes = {s: sum(v) for s, v in by_source.items()}
    want = filled(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 3)
    taken = Counter()
    for r in got:
        (s,) = [s for s in sizes if sizes[s] == r["source_size"]]
        assert r["target"] == pytest.approx(want[s]) and r["taken"] in {k * r["size"] for k in range(4)}
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(by_source[s]) * 3  # rows with one id stand together
    assert sum(taken.values()) <= sum(sizes.values())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(WORD.findall(r["text"] or "")) for r in rows(mixed)) == sum(taken.values())
    assert Counter(map(str, rows(mixing.taken(docs)))) == Counter(map(str, got))


# sharding

def smallest(sizes, k):
    best = {(0, 0): 0}
    for j in range(1, k + 1):
        for i in range(len(sizes) + 1):
            best[j, i] = min((max(best[j - 1, h], sum(sizes[h:i])) for h in range(i + 1) if (j - 1, h) in best), default=None)
    return best[k, len(sizes)]


@pytest.mark.parametrize("sizes", [[3], [5, 1, 1, 9, 2, 2, 4, 7], [1] * 17, [100, 1, 1, 1, 1, 1, 1, 1, 1, 1], [2, 3, 5, 7, 11, 13, 17, 19, 1, 1, 1, 40]])
def test_cuts_are_minimax(sizes):
    at = [0, *sharding.cuts(sizes, 4), len(sizes)]
    assert at == sorted(at)
    assert max(sum(sizes[a:b]) for a, b in zip(at, at[1:])) == smallest(sizes, 4)


def test_shards(docs, no_docs):
    got = rows(sharding.shard_rows(docs))
    assert len(got) == docs.count() and sharding.shard_rows(no_docs).count() == 0 and sharding.sharded(no_docs).count() == 0
    source = rows(docs)
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, None if r["text"] is None else zlib.crc32(r["text"].encode())) for r in source)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    homes, slots = defaultdict(set), defaultdict(list)
    for r in got:
        homes[r["text_crc32"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(h) == 1 for h in homes.values()) and set(slots) <= set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    whole = sharding.sharded(docs)
    assert set(whole.columns) == set(docs.columns) | {"shard", "slot"} and whole.count() == len(got)
