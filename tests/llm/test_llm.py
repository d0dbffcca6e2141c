"""The training-data operators on small tables: brute force, round trips, and odd input."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstone.llm import chat_format, common, decontaminate, exact_dedup, license_scan, near_dedup, packing, queries, sql, suffix_dedup, token_counts, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cell int, hash string, score double"


def documents(spark, rows, schema=SCHEMA):
    """(doc_id, text) with further columns, some of which clash with names used inside the operators."""
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1, "x", 0.5) for d, t in rows], schema)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(8)
    return [
        "".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(2, 7))) for _ in range(150)
    ]


@pytest.fixture(scope="module")
def corpus(words):
    """Texts with copies, near copies, shared passages, repeats, nulls and odd ones."""
    rng = random.Random(3)
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = make(30)
    rows = [make(rng.randint(30, 120)) for _ in range(40)]
    for t in rows[:12]:
        rows.append(t)
        edited = t.split(" ")
        for _ in range(rng.randint(1, 4)):
            edited[rng.randrange(len(edited))] = rng.choice(words)
        rows.append(" ".join(edited))
        rows.append(t.upper() if t.isascii() else t + " End")
    rows += [make(10) + " " + passage + "\n" + make(12) for _ in range(15)]
    base = make(100)
    for _ in range(40):  # a large group of near copies, some farther than others
        edited = base.split(" ")
        for _ in range(rng.randint(1, 14)):
            edited[rng.randrange(100)] = rng.choice(words)
        rows.append(" ".join(edited))
    rows += [None, "", "", " \n ", "one", "one", "One two", "ha " * 200, "ha " * 190, "=" * 300, "日本語 " * 30, make(20000)]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(7 * i - 50, rows[k]) for i, k in enumerate(order)]


# --- exact dedup ---


def test_exact_groups(spark, corpus):
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(documents(spark, corpus)).collect()}
    low = {d: re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for d, t in corpus}
    groups = collections.defaultdict(list)
    for d, t in low.items():
        groups[t].append(d)
    for d, t in low.items():
        r = got[d]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(groups[t]), len(groups[t]), d == max(groups[t]))
        assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_exact_dedup_odd_rows(spark):
    docs = documents(spark, [(1, "A"), (1, "a"), (2, "b"), (None, "b"), (None, "c"), (None, "c")])
    got = sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs).collect())
    assert got == [(0, 0, 2, True), (0, 0, 2, True), (0, 2, 2, False), (1, 1, 2, True), (1, 1, 2, True), (2, 2, 2, True)]
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0
    kept = exact_dedup.exact_dedup(documents(spark, [(1, "A"), (5, "a"), (2, "b")]), keep="min")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]


def test_exact_dedup_drops_rows_not_ids(spark):
    rows = [(2, "b"), (None, "B"), (None, "unique"), (None, None), (3, ""), (5, "b"), (5, "own"), (1, "c"), (1, "d"), (0, "d")]
    docs = documents(spark, rows)
    order = lambda found: sorted(found, key=lambda r: tuple((x is None, x) for x in r))
    kept = [(r["doc_id"], r["text"]) for r in exact_dedup.exact_dedup(docs, keep="min").collect()]
    assert order(kept) == order([(2, "b"), (None, "unique"), (3, ""), (5, "own"), (1, "c"), (0, "d")])
    kept = [(r["doc_id"], r["text"]) for r in exact_dedup.exact_dedup(docs, keep="max").collect()]
    assert order(kept) == order([(None, "unique"), (3, ""), (5, "b"), (5, "own"), (1, "c"), (1, "d")])


# --- near-duplicates ---


def brute_components(rows, k, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return set(zip(*[w[i:] for i in range(k)], strict=False)) if len(w) >= k else {tuple(w)} if w else set()

    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, corpus, k):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(documents(spark, corpus), words=k).collect()}
    assert got == brute_components(corpus, k, 80)


def test_near_dedup_keeps_one(spark, corpus):
    docs = documents(spark, corpus)
    kept = near_dedup.near_dedup(docs)
    want = [d for d, (n, c) in brute_components(corpus, 5, 80).items() if d == c]
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


@pytest.mark.parametrize("block, shingles", [(3, 2_000_000), (1000, 300)])
def test_large_buckets_are_dealt_to_cells(spark, corpus, monkeypatch, block, shingles):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "WORDS", shingles)
    monkeypatch.setattr(near_dedup, "central", lambda near: near.select(near["doc"].alias("a"), near["doc"].alias("b")).limit(0))  # all is left to the cells
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(documents(spark, corpus), words=2).collect()}
    assert got == brute_components(corpus, 2, 80)


def test_cells_hold_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rows = spark.createDataFrame([(64, k, k if k < 9 else 100, 100) for k in range(30)], "key long, doc long, label long, top long")
    reps = spark.createDataFrame([(k, 5) for k in range(30)], "doc long, n long")
    dealt = collections.defaultdict(list)
    for r in near_dedup.cells(rows, reps).collect():
        dealt[r["p"], r["q"]].append((r["block"], r["doc"], r["label"]))
    met = collections.Counter()
    for (p, q), own in dealt.items():
        assert len(own) < 30
        met.update(frozenset((a[1], b[1])) for a in own for b in own if a[1] < b[1] and a[2] != b[2] and {a[0], b[0]} == {p, q})
    assert set(met.values()) == {1} and len(met) == 9 * 8 // 2 + 9 * 21


def test_many_near_copies_propose_one_pair_each(spark, words):
    rng = random.Random(31)
    base = [rng.choice(words) + str(k) for k in range(120)]
    rows = []
    for d in range(3000):
        text = list(base)
        text[rng.randrange(120)] = f"x{d}"
        rows.append((d, " ".join(text)))
    rows += [(3000 + k, " ".join(base[:95] + [f"y{k}z{j}" for j in range(25)])) for k in range(5)]  # outliers
    docs = documents(spark, rows)
    reps = near_dedup.sketches(docs, 2).selectExpr("doc_id AS doc", "n", "registers").cache()
    near = near_dedup.buckets(reps).cache()
    assert near_dedup.central(near).count() <= len(rows) and near.count() <= near_dedup.BANDS * len(rows)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, words=2).collect()}
    assert {got[d] for d in range(3000)} == {0} and len({got[3000 + k] for k in range(5)}) == 5


def thue_morse(n):
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 4096])
def test_regular_words_are_told_apart(spark, n):
    x, y = thue_morse(n)
    rows = [(1, f"{x} {y}"), (2, f"{y} {x}"), (3, f"{x} {x}"), (4, x), (5, y), (6, f"{x} {y} {x}")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(documents(spark, rows), words=2).collect()}
    assert got == brute_components(rows, 2, 80)


def test_near_duplicates_odd_rows(spark):
    docs = documents(spark, [(3, "a b c"), (3, "a b c"), (1, "A B C"), (None, "a b c"), (7, None), (8, "")])
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in near_dedup.near_duplicates(docs, words=2).collect())
    assert got == [(0, 0, True), (1, 1, True), (3, 1, False), (3, 1, False), (7, 7, True), (8, 8, True)]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_near_dedup_drops_rows_not_ids(spark, words):
    rng = random.Random(12)
    make = lambda: " ".join(rng.choice(words) for _ in range(80))
    a, b, c, d, e = (make() for _ in range(5))
    near = lambda t: t + " more"
    # 5 repeats with a copy and a text of its own; 7 stands for two texts, one near to that of 6; 9 for two near each other
    rows = [(1, a), (5, a), (5, b), (6, c), (7, near(c)), (7, d), (9, e), (9, near(e)), (None, a), (None, ""), (8, near(d))]
    docs = documents(spark, rows)
    got = collections.Counter((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect())
    assert got == collections.Counter([(1, 1, True), (5, 1, False), (5, 5, True), (6, 6, True), (7, 6, False), (7, 7, True), (9, 9, True), (9, 9, True), (None, None, True), (None, None, True), (8, 7, False)])
    kept = collections.Counter((r["doc_id"], r["text"]) for r in near_dedup.near_dedup(docs).collect())
    assert kept == collections.Counter(r for r in rows if r not in [(5, a), (7, near(c)), (8, near(d))])


def test_sketches():
    rng = np.random.default_rng(1)
    for j in (0.5, 0.8, 0.95):
        n, both = 2000, int(2 * 2000 * j / (1 + j))
        x = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
        a, b = near_dedup.sketch(x[:n]), near_dedup.sketch(x[n - both :])
        guess = near_dedup.estimate(np.array([(a > b).sum()]), np.array([(a < b).sum()]), np.array([n]), np.array([n]))[0]
        assert abs(guess - j) < 0.15
        assert (near_dedup.merge_sketches(a, b) == near_dedup.sketch(x)).all()


# --- suffix dedup ---


def brute_removed(rows, length):
    first = {}
    for d, t in sorted(((d, t) for d, t in rows if d is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1) if d is not None else ():
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest(), left))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


@pytest.mark.parametrize("cold, size", [(4096, 16 << 20), (1, 16 << 20), (2, 3000), (4096, 700)])
def test_remove_repeats(spark, corpus, monkeypatch, cold, size):
    monkeypatch.setattr(suffix_dedup, "COLD", cold)
    monkeypatch.setattr(suffix_dedup, "CHUNK", size)
    rows = [(d, t if len(t or "") < 5000 else t[:5000]) for d, t in corpus] + [(None, corpus[0][1]), (999, corpus[3][1]), (999, corpus[5][1])]
    got = sorted([tuple(r) for r in suffix_dedup.remove_repeats(documents(spark, rows), length=50, with_text=True).collect()], key=key)
    assert got == sorted(brute_removed(rows, 50), key=key)
    assert suffix_dedup.remove_repeats(documents(spark, []), length=50).count() == 0


def test_regular_texts_are_told_apart_byte_by_byte(spark):
    x, y = thue_morse(4096)
    rows = [(1, x), (2, y), (3, x[:100] + "c" * 60 + y[1000:1300]), (4, "c" * 200)]
    got = sorted([tuple(r) for r in suffix_dedup.remove_repeats(documents(spark, rows), length=50, with_text=True).collect()], key=key)
    assert got == sorted(brute_removed(rows, 50), key=key)


def test_joined_spans():
    rng = random.Random(5)
    for _ in range(200):
        spans = [(rng.randrange(3), a := rng.randrange(20), a + rng.randint(1, 5)) for _ in range(rng.randint(0, 9))]
        covered = collections.defaultdict(set)
        for k, a, z in spans:
            covered[k].update(range(a, z))
        want = [(k, i) for k in sorted(covered) for i in sorted(covered[k])]
        got = list(zip(*(x.tolist() for x in suffix_dedup.joined(*(np.array([r[c] for r in spans], np.int64) for c in range(3)))), strict=True))
        assert [(k, i) for k, a, z in got for i in range(a, z)] == want
        assert all(p[0] != q[0] or p[2] < q[1] for p, q in zip(got, got[1:], strict=False))


def test_repeated_id_with_a_copy_and_another_text(spark):
    rng = random.Random(11)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    whole, own = make(300), make(150)
    rows = [(1, whole), (5, whole), (5, make(90) + whole[40:160] + own), (9, make(70) + own + make(60))]
    got = sorted([tuple(r) for r in suffix_dedup.remove_repeats(documents(spark, rows), length=50, with_text=True).collect()], key=key)
    assert got == sorted(brute_removed(rows, 50), key=key)
    assert sorted(r[2] for r in got) == [0, 120, 150, 300]


@pytest.mark.parametrize("length", [18, 20, 33, 50])
def test_deep_shallow_sort(length):
    rng = random.Random(length)
    base = bytes(rng.choice(b"ab") for _ in range(200))
    raw = base + bytes(rng.choice(b"ab\xff\x00") for _ in range(300)) + base
    at = np.random.default_rng(1).permutation(len(raw) - length + 1)
    order, cuts = suffix_dedup.deep_shallow_sort(common.padded(raw), at, length)
    strings = [raw[i : i + length] for i in at[order]]
    assert strings == sorted(strings)
    assert list(cuts) == [0] + [i for i in range(1, len(strings)) if strings[i] != strings[i - 1]] + [len(strings)]


def test_deep_shallow_sort_of_strings_of_all_sizes():
    rng = random.Random(17)
    base = bytes(rng.choice(b"ab") for _ in range(120))
    raw = base + bytes(rng.choice(b"ab\xff\x00") for _ in range(200)) + base * 2
    at = np.array([rng.randrange(len(raw) - 90) for _ in range(500)])
    size = np.array([rng.choice((18, 19, 23, 24, 25, 50, 84)) for _ in range(500)])
    order, cuts = suffix_dedup.deep_shallow_sort(common.padded(raw), at, size)
    strings = [(int(n), raw[i : i + n]) for i, n in zip(at[order], size[order], strict=True)]
    assert strings == sorted(strings)
    assert list(cuts) == [0] + [i for i in range(1, 500) if strings[i] != strings[i - 1]] + [500]


# --- decontamination ---


@pytest.mark.parametrize(("block", "hot"), [(100_000, 100_000), (7, 100_000), (7, 20), (20, 0)])
def test_benchmark_hits(spark, corpus, words, block, hot):
    rng = random.Random(5)
    texts = {d: t for d, t in corpus}
    long = [t for t in texts.values() if t and len(t.split()) > 60]
    items = [(i, " ".join(rng.choice(long).split()[i : i + rng.randint(9, 30)])) for i in range(12)]
    items += [(100, "One"), (101, words[3] + "!! " + words[4].upper()), (102, ""), (103, None), (104, "ha " * 40), (105, items[0][1]), (None, words[0])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    got = {r["doc_id"]: r for r in decontaminate.benchmark_hits(documents(spark, corpus), bench, block=block, hot=hot).collect()}
    for d, t in corpus:
        w, hit, found = split(t), set(), set()
        for item, text in items:
            iw = split(text)
            n = min(len(iw), 10)
            grams = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n and item is not None else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    found.add(str(item))
        r = got[d]
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(found))
    clean = decontaminate.decontaminate(documents(spark, corpus), bench, block=block, hot=hot)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(d for d, r in got.items() if not r["n_hit"])
    assert decontaminate.benchmark_hits(documents(spark, []), bench, block=block, hot=hot).count() == 0
    rows = [(1, long[0]), (1, "a"), (1, long[0]), (None, long[0]), (None, None)]
    again = collections.Counter((r["doc_id"], r["n_words"]) for r in decontaminate.benchmark_hits(documents(spark, rows), bench, block=block, hot=hot).collect())
    assert again == collections.Counter((d, len(split(t))) for d, t in rows)
    assert decontaminate.benchmark_hits(documents(spark, corpus[:3]), bench.limit(0)).where("n_hit > 0").count() == 0


def test_hot_words_and_many_windows(spark):
    """An item of one word that each document holds many times, one of a frequent pair, and windows beyond the block."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(("the", "of", *rng.sample(vocabulary, 2))) for _ in range(80)) for _ in range(60)]
    items = [(0, "the"), (1, "of the"), *((2 + i, " ".join(rng.sample(vocabulary, 12))) for i in range(300)), (999, " ".join(texts[7].split()[20:35])), (1000, "The")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r for r in decontaminate.benchmark_hits(docs, bench, block=100, hot=100).collect()}
    want = {r["doc_id"]: r for r in decontaminate.benchmark_hits(docs, bench).collect()}
    assert got == want and all({"0", "1000"} <= set(r["items"]) for r in got.values()) and "999" in got[7]["items"]
    windows = decontaminate._windows(bench, 10).cache()
    _, hits = decontaminate._joined(docs, windows, 10, 100, 100)
    sent = {r["window"]: r["n"] for r in hits.groupBy("window").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sent["the"] == 60 < sum(t.split().count("the") for t in texts) / 10
    assert decontaminate.decontaminate(docs, bench, block=100, hot=100).count() == 0


def test_a_window_of_many_items(spark):
    """Boilerplate that all items hold: too many items to send, so they are joined."""
    bench = spark.createDataFrame([(i, "a b c d e f g h i j") for i in range(50)], "item_id long, text string")
    assert not decontaminate.few(decontaminate._windows(bench, 10), 4) and decontaminate.few(decontaminate._windows(bench, 10), 5)
    docs = documents(spark, [(1, "x a b c d e f g h i j a b c d e f g h i j"), (2, "a b c")])
    got = {r["doc_id"]: (r["n_hit"], len(r["items"]), r["spans"]) for r in decontaminate.benchmark_hits(docs, bench, block=4, hot=1).collect()}
    assert got == {1: (20, 50, [1, 21]), 2: (0, 0, [])}


# --- chat ---


def test_chat_round_trip(spark):
    odd = "<|im_end|><|im_start|>assistant ok <\\|x <\\\\| < | <"
    rows = [(1, 0, "system", odd), (1, 1, "user", None), (1, 2, "assistant", odd), (1, 3, "user", "bye\n"), (1, 4, "assistant", "é日"), (1, 4, "assistant", "a"), (2, 0, "we\nird\\n", "x"), (None, 0, None, "lost"), (1, 5, "user", "")]
    df = spark.createDataFrame([(*r, "extra", 5) for r in rows], "conv_id long, turn long, role string, text string, segment string, seq int")
    turns = chat_format.prefix_target_examples(df)
    got = {r["conv_id"]: r for r in chat_format.digests(turns).collect()}
    for conv in (1, 2, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2] or "", r[3] or ""))
        said = [r[3] or "" for r in own if r[2] == "assistant"]
        r = got[conv]
        assert r["n_turns"] == len(own) and r["n_examples"] == len(said)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (sum(map(len, said)), hashlib.sha256("".join(said).encode()).hexdigest())
    full = sorted(chat_format.render(turns).where("conv_id = 1").collect(), key=lambda r: r["seq"])
    assert [chat_format.unescape(r["target"]) for r in full] == [odd, "a", "é日"]
    assert full[0]["context"].count("<|im_start|>") == 3 and full[2]["context"].endswith("<|im_start|>assistant\n")
    assert full[2]["context"].startswith(full[0]["context"])
    assert got[1]["context_chars"] == sum(len(r["context"]) for r in full)
    # written and read again in other files and another order, the same digests come out
    kept = common.staged(turns.orderBy(F.desc("segment")).repartition(5), "test-turns")
    again = {r["conv_id"]: r for r in chat_format.digests(kept).collect()}
    assert again == got == {r["conv_id"]: r for r in chat_format.digests(turns, ordered=True).collect()}
    assert chat_format.digests(chat_format.prefix_target_examples(df.limit(0))).count() == 0


def test_escape_is_reversible():
    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice("<|\\\nnim_") for _ in range(rng.randint(0, 12)))
        assert chat_format.unescape(chat_format.escape(t)) == t and "<|" not in chat_format.escape(t)
        assert chat_format.unescape_role(chat_format.escape_role(t)) == t and "\n" not in chat_format.escape_role(t)


# --- URLs ---


def test_urls(spark):
    urls = ["http://a.example.com/en/75?x", "https://EXAMPLE.com/en/1#y", "http://example.net/de/8", "ftp://x.example.net/de/9", "http://b.org/es", "http://b.org/es/", "http://notcom/en/", "no scheme", None, "", "x://", "http://com/en/?q", "http://u@com:80/en/", "http://é.org/es/ü"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(df, queries.URL_RULES).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.name), default=None)
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        assert (got[i]["rule"], got[i]["verdict"]) == ((best.name, best.action) if best else (None, "allow"))
    assert url_filter.judge_urls(df.limit(0), queries.URL_RULES).count() == 0


# --- tokens and packing ---


def test_token_counts(spark, corpus):
    import sentencepiece

    path = queries.tokenizer("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(6)
    parts = ["a", "the", " ", "  ", "\n", "é", "日本", "▁", "Hello", ".", "\t", "<s>", "🙂", "\xa0", "\0"]
    rows = corpus + [(10_000 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for i in range(500)]
    for r in token_counts.count_tokens(documents(spark, rows), path, limit=20).collect():
        text = dict(rows)[r["doc_id"]] or ""
        n = len(library.encode(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 20)


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(7)
    parts = ["a", "The", " ", "\n", "É", "é", "日本", "ß", "×", "'s", "Hello", ".", "<|endoftext|>", "<|", "🙂", "12", "!!", "é", "—", "\x00"]
    rows = corpus + [(10_000 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for i in range(300)]
    pieces = packing.pack(documents(spark, rows), path, length=256, per_range=500).collect()
    ids = {d: [*library.encode(t or "", add_special_tokens=False).ids, 1] for d, t in rows}
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
        own = np.array(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4").tobytes()
        assert p["doc_tokens"] == len(ids[p["doc_id"]]) and p["ids_crc32"] == zlib.crc32(own)
    for d, own in by_doc.items():
        own.sort(key=lambda p: p["start"])
        assert [p["start"] for p in own] == [0, *np.cumsum([p["length"] for p in own])[:-1]] and sum(p["length"] for p in own) == len(ids[d])
    assert by_doc.keys() == ids.keys()
    padding = 0
    for own in by_seq.values():
        own.sort(key=lambda p: p["offset"])
        size = sum(p["length"] for p in own)
        assert [p["offset"] for p in own] == [0, *np.cumsum([p["length"] for p in own])[:-1]] and size <= 256
        padding += 0 if size & (size - 1) == 0 else 256 - size
    assert padding == 0
    assert packing.pack(documents(spark, []), path).count() == 0


@pytest.mark.parametrize("n", [1024, 4096])
def test_packing_tells_regular_words_apart(spark, n):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    x, y = thue_morse(n)
    rows = [(1, f"{x} {y}"), (2, y), (3, f"a {x} b")]
    pieces = packing.pack(documents(spark, rows), path, length=1 << 16).orderBy("doc_id", "start").collect()
    for d, t in rows:
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        own = b"".join(bytes(p["ids"]) for p in pieces if p["doc_id"] == d)
        assert np.frombuffer(own, "<u4").tolist() == ids


def test_words_whose_hashes_meet_go_to_the_library(monkeypatch):
    encoder = packing.Encoder(queries.tokenizer("word_bpe_49k.json"))
    texts = [b"some words here", b"other words", b"", b"a longerwordthanothers here"]
    want = [encoder.whole(t).tolist() for t in texts]
    monkeypatch.setattr(packing, "range_hashes", lambda buf, starts, ends: np.zeros(len(starts), np.uint64))
    assert [x.tolist() for x in encoder(texts)] == want


def test_ranges_hold_about_equal_numbers_of_ids(spark):
    rng = np.random.default_rng(2)
    keys = np.concatenate([rng.integers(0, 1 << 63, 300), (1 << 50) + rng.integers(0, 1 << 20, 300), (1 << 50) + np.arange(300)])
    rows = [(int(k), int(n)) for k, n in zip(keys, rng.integers(1, 200, 900), strict=True)]
    ends = packing.range_ends(spark.createDataFrame(rows, "key long, n long"), 2000)
    sums = np.bincount(np.searchsorted(ends, [k for k, _ in rows], "right"), [n for _, n in rows])
    assert sums.max() <= 2000 and len(sums) < 2.2 * sums.sum() / 2000
    assert packing.range_ends(spark.createDataFrame([], "key long, n long"), 2000) == []


def test_curve_puts_like_texts_together(words):
    grid = np.array([(i, j) for i in range(8) for j in range(8)])
    numbers = packing.hilbert(grid, 3)
    walk = grid[np.argsort(numbers)]
    assert sorted(numbers) == list(range(64)) and np.abs(np.diff(walk, axis=0)).sum(1).max() == 1
    rng = np.random.default_rng(3)
    topics = [rng.choice(40_000, 60, replace=False) for _ in range(6)]
    docs = [(k, rng.choice(topics[k], 300)) for k in range(6) for _ in range(20)]
    order = np.argsort(packing.hilbert(np.array([packing.project(x) for _, x in docs])))
    kinds = [docs[i][0] for i in order]
    assert sum(a == b for a, b in zip(kinds, kinds[1:], strict=False)) > 60  # by chance about 20


# --- licences ---


def test_licenses(spark):
    mit = license_scan.TEMPLATES[2][2]
    rows = [(1, "Some text.\nReleased under the MIT License.\nMore"), (2, mit.replace("Software", "Program", 1).upper()), (3, "plain words only here"), (4, None), (5, ""), (6, "This work is licensed under the GNU General Public License, version 3."), (7, "I sell. Licensed under CC BY-NC 4.0. Bye"), (8, "license"), (9, " ".join(f"w{i}" for i in range(5000)) + " Licensed under the Apache License, Version 2.0.")]
    got = {r["doc_id"]: r for r in license_scan.scan(documents(spark, rows)).collect()}
    names = {d: r["license"] for d, r in got.items()}
    assert names == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: "GPL-3.0", 7: "CC-BY-NC-4.0", 8: None, 9: "Apache-2.0"}
    index = license_scan.Index(license_scan.TEMPLATES, 0.8)
    for d, t in rows[:8]:  # whole units; document 9 holds its notice at the end of a line
        grams = [license_scan.bigrams(u) for _, u in license_scan.units((t or "").encode())]
        best = max((license_scan.dice(g, x.grams) for g in grams for x in index.templates if g), default=0)
        assert got[d]["dice"] == (best if best >= 0.8 else 0)
    assert license_scan.scan(documents(spark, [])).count() == 0


MIT_FILE = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE."""
APACHE_HEADER = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License."""


def test_licenses_inside_long_texts(spark):
    other = lambda n, k: "\n\n".join(" ".join(f"w{k}x{i}y{j}" for j in range(20)) for i in range(n))
    inside = lambda *notices: "\n\n".join(x for k, t in enumerate(notices) for x in (other(40, k), t)) + "\n\n" + other(40, "z")
    line = "This work is licensed under the GNU General Public License, version 2."
    rows = [(1, inside(MIT_FILE)), (2, inside(APACHE_HEADER.replace("#\n", "\n"))), (3, inside(MIT_FILE, APACHE_HEADER, MIT_FILE)), (4, "so it says " + line[:-1] + " as far as known"), (5, line), (6, inside("Copyright X. All rights reserved.\n" + MIT_FILE)), (7, inside(MIT_FILE[:200])), (8, "see all rights reserved here, and all rights reserved there")]
    got = {r["doc_id"]: (r["license"], r["unit"], r["n_matches"], r["licenses"]) for r in license_scan.scan(documents(spark, rows)).collect()}
    assert got[1] == ("MIT", "window", 1, ["MIT"])
    assert got[2][0] == "Apache-2.0" and got[2][3] == ["Apache-2.0"]
    assert got[3][2:] == (4, ["Apache-2.0", "MIT"])  # two windows, and the header as a paragraph and by its first line
    assert got[4] == ("GPL-2.0", "window", 1, ["GPL-2.0"]) and got[5] == ("GPL-2.0", "text", 1, ["GPL-2.0"])
    assert got[6][3] == ["MIT", "Proprietary"]
    assert got[7] == (None, None, 0, [])
    assert got[8] == ("Proprietary", "window", 2, ["Proprietary"])


WHOLE = [
    ("MIT", license_scan._MIT + license_scan._WARRANTY + license_scan._LIABILITY), ("BSD-2-Clause", license_scan._BSD + license_scan._BSD_WARRANTY),
    ("BSD-3-Clause", license_scan._BSD + license_scan._BSD_THIRD + license_scan._BSD_WARRANTY), ("ISC", license_scan._ISC + license_scan._ISC_NOTICE + license_scan._ISC_WARRANTY),
    ("0BSD", license_scan._ISC + "." + license_scan._ISC_WARRANTY), ("Zlib", license_scan._ZLIB + license_scan._ZLIB_RULES),
    ("Unlicense", license_scan._UNLICENSE + license_scan._UNLICENSE_REST + license_scan._WARRANTY + license_scan._LIABILITY),
    *[(n, t) for n, _, t in license_scan.TEMPLATES if n in ("Apache-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0") and len(t.split()) > 15],
]


def test_licenses_as_files_wrapped_and_commented(spark):
    import textwrap

    code = "\n".join(f"x{k} = call_{k}(y{k}, z{k})  # step {k}" for k in range(60))
    rows, want = [], {}
    for k, (name, text) in enumerate(WHOLE):
        wrapped = textwrap.wrap(text, 72)
        forms = [
            text, "Project notes\n\nCopyright (c) 2020 Some One\n\n" + "\n".join(wrapped) + "\n\n" + code, "\r\n\r\n".join(["Readme", "\r\n".join(wrapped), code]),
            "\n".join(f"# {x}" for x in wrapped) + "\n\n" + code, "/*\n" + "\n".join(f" * {x}" for x in wrapped) + "\n */\n" + code, code + "\n" + "\n".join(f"// {x}" for x in wrapped),
        ]
        for j, form in enumerate(forms):
            rows.append((10 * k + j, form))
            want[10 * k + j] = name
    got = {r["doc_id"]: r["license"] for r in license_scan.scan(documents(spark, rows + [(-1, code)])).collect()}
    assert got == want | {-1: None}


def test_best_windows_match_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        make = lambda n: " ".join(rng.choice("abcdefg") for _ in range(n))  # noqa: B023, E731
        index = license_scan.Index([(f"T{k}", "x", make(rng.randint(2, 9))) for k in range(3)], 0.8)
        words = make(rng.randint(0, 40)).encode().split()
        found = license_scan.windows(words, index.held(words), index)
        every = (license_scan.dice(license_scan.bigrams(b" ".join(words[i:j])), t.grams) for t in index.templates for i in range(len(words)) for j in range(i + 2, len(words) + 1))
        best = max(every, default=0)
        assert max((-f[0] for f in found), default=0) == (best if best >= 0.8 else 0)


# --- toxicity ---


def test_toxicity_held_out(spark):
    rng = random.Random(9)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    bad = ["vexq" + "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(40)]
    rows, labels = [], []
    for d in range(600):
        toxic = d % 4 == 0
        text = [rng.choice(plain) for _ in range(rng.randint(20, 200))]
        for _ in range(rng.randint(2, 5) if toxic else 0):
            text[rng.randrange(len(text))] = rng.choice(bad)
        rows.append((d, " ".join(text)))
        labels.append((d, 1, int(toxic)))
    docs = documents(spark, rows + [(1000, None), (1001, "")])
    marks = spark.createDataFrame(labels + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [d for d in range(600) if zlib.crc32(str(d).encode()) % 3 == 1]
    assert len(got) == 602 and all(0 <= r["score"] <= 1 for r in got.values()) and got[1000]["score"] == got[1001]["score"]
    assert sum(got[d]["predicted"] == (d % 4 == 0) for d in held) / len(held) > 0.95
    kept = toxicity.reject_toxic(docs, marks)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, r in got.items() if not r["flagged"]}
    # labels of held-out rows don't matter
    other = spark.createDataFrame([(d, 1, 1 - t if d in held else t) for d, _, t in labels], "doc_id long, quality int, toxic int")
    assert np.array_equal(toxicity.train(docs, other).table, model.table)
    nothing = toxicity.train(docs, marks.limit(0))
    assert {r["score"] for r in toxicity.score(docs, nothing).collect()} == {0.0}


def test_tables_score_as_a_plain_convolution():
    rng = np.random.default_rng(3)
    n = toxicity.FILTERS * len(toxicity.WIDTHS)
    E, W = rng.normal(size=(toxicity.CELLS + 1, toxicity.DIM)), rng.normal(size=(toxicity.DIM, toxicity.FILTERS * sum(toxicity.WIDTHS)))
    E[toxicity.CELLS] = 0
    bias, weights = rng.normal(size=n), rng.normal(size=n)
    model = toxicity.Model((E @ W).astype(np.float32), bias.astype(np.float32), weights.astype(np.float32), 0.25)
    texts = [b"", b"one", b"One two", "é b ccccccccc d e f g".encode(), b" ".join(rng.choice([b"aa", b"bbbb", b"cccccc"], 60))]
    for t, got in zip(texts, model.logits(texts), strict=True):
        cells, _ = toxicity.cells_of([t])
        vectors = E[cells].sum(1)
        pooled = []
        for k, w in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                filters = [W[:, toxicity.PART_AT[k] + o * toxicity.FILTERS + f] for o in range(w)]
                windows = [sum(vectors[i + o] @ filters[o] for o in range(w) if i + o < len(vectors)) for i in range(len(vectors))]
                # an own text's windows may reach into the empty places behind it, never into another text
                pooled.append(max(windows[: len(vectors) - toxicity.PAD] or [0]))
        assert abs(np.maximum(np.array(pooled) + bias, 0) @ weights + 0.25 - got) < 1e-2


def test_gradients_match_differences(monkeypatch):
    monkeypatch.setattr(toxicity, "CELLS", 40)
    rng = np.random.default_rng(4)
    params = {"E": rng.normal(size=(41, toxicity.DIM)), "W": rng.normal(0, 0.3, (toxicity.DIM, int(toxicity.PART_AT[-1]))), "b": rng.normal(size=24), "v": rng.normal(size=24), "c": rng.normal(size=1)}
    params["E"][40] = 0
    texts = [b"a b c d e", b"f", b"g h a a b c i j k"]
    ready = [toxicity.cells_of([t])[0] for t in texts]
    cells, begin = np.concatenate(ready), np.cumsum([0] + [len(r) for r in ready[:-1]])
    toxic, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    _, grads = toxicity.gradients(params, cells, begin, toxic, weight)
    for name, value in params.items():
        for _ in range(25):
            at = tuple(int(rng.integers(0, n)) for n in value.shape)
            if name == "E" and at[0] == 40:
                continue
            old, losses = value[at], []
            for step in (1e-5, -1e-5):
                value[at] = old + step
                losses.append(toxicity.gradients(params, cells, begin, toxic, weight)[0])
            value[at] = old
            assert abs((losses[0] - losses[1]) / 2e-5 - grads[name][at]) < 1e-5


def test_the_sample_is_bounded(spark):
    learnt = [k for k in range(100) if zlib.crc32(str(k).encode()) % 3 != 1]
    many, long, null, short = learnt[:4]
    rows = spark.range(20_000).select(F.lit(many).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    rows = rows.unionByName(spark.createDataFrame([(long, "x" * 70_000), (null, None), (short, "short")], "doc_id long, text string"))
    marks = spark.createDataFrame([(many, 1), (many, 0), (long, 0), (null, 0), (short, 0)], "doc_id long, toxic int")
    chosen = toxicity.sampled(rows, marks, max_toxic=3, max_clean=9, max_bytes=1 << 16).collect()
    assert {r["doc_id"]: r["toxic"] for r in chosen} == {many: 1, null: 0, short: 0} and len(chosen) == 3
    some = documents(spark, [(k, f"w{k} v") for k in learnt])
    marks = spark.createDataFrame([(k, k % 2) for k in learnt], "doc_id long, toxic int")
    assert toxicity.sampled(some, marks, max_toxic=3, max_clean=4, max_bytes=99).count() == 7


def test_toxicity_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, None), (1, "", None), (None, "a " * 50_000, "xx")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(9)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 3 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0
    assert toxicity.reject_toxic(docs.limit(0), labels).count() == 0


# --- registered queries ---


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", sorted(sql.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    df = queries.queries()[name](spark, "/root/testdata/sf0.001")
    result = con.execute(sql.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=key) == sorted(result.fetchall(), key=key)


# --- shared ---


@pytest.mark.parametrize("n, most", [(0, 1 << 30), (1, 1 << 30), (1000, 1 << 30), (60_000, 1 << 30), (60_000, 1 << 15)])
def test_sieve_loses_no_key(spark, monkeypatch, n, most):
    monkeypatch.setattr(common, "MOST_BITS", most)
    keys = spark.range(n).select((F.col("id") * 3).alias("k"))
    keys = common.staged(keys.union(spark.sql("SELECT CAST(NULL AS BIGINT)")) if n else keys, "keys")
    value = F.when(F.col("id") % 1000 == 1, None).otherwise(F.col("id"))
    # columns named as those of the sieve do no harm
    rows = spark.range(200_000).select(value.alias("k"), F.lit("x").alias("sieve_at"), F.lit(1).alias("sieve_bits"))
    sieve = common.Sieve(keys, "k")
    passed, rest = ([r.k for r in df.collect()] for df in (sieve.passed(rows, rows["k"]), sieve.held_back(rows, rows["k"])))
    wanted = {None, *range(0, 3 * n, 3)} if n else set()
    assert len(passed) + len(rest) == 200_000
    assert not wanted & set(rest)
    assert sieve.bits <= most and sieve.table.count() <= -(-sieve.bits // (1 << 15))
    if most > 1 << 15:
        assert len(set(passed) - wanted) <= 200_000 / 64


@pytest.mark.parametrize("size", [10, 100, 1 << 20])
def test_slices_are_bounded(size):
    import pyarrow as pa

    texts = ["x" * n for n in (0, 5, 200, 3, 3, 3, 90, 40)] + [None, "é"]
    batch = pa.RecordBatch.from_pydict({"t": texts, "n": list(range(10))})
    parts = list(common.slices(batch, 4, size))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    assert all(p.num_rows <= 4 and (p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(0).to_pylist()) <= size) for p in parts)
    assert list(common.slices(batch.slice(0, 0))) == []


def test_workers_keep_what_one_operator_needs():
    def use(make):
        return common.tidy(lambda batches: (common.kept(make, "x") for _ in batches), make)

    first, again = next(use(Counted)(iter([1]))), next(use(Counted)(iter([1])))
    assert first is again and Counted.made == 1
    list(common.tidy(lambda batches: batches)(iter(())))
    assert not common._kept
    assert next(use(Counted)(iter([1]))) is not first and Counted.made == 2
    common.let_go(None)


class Counted:
    made = 0

    def __init__(self, path: str):
        Counted.made += 1
        self.me = self  # as counters do, which refer to themselves


def test_staged_tables_can_be_discarded(spark):
    table = common.staged(spark.range(3), "test-some")
    assert table.count() == 3 and os.path.isdir(table._staged_at.removeprefix("file:"))
    common.discard(table)
    assert not os.path.exists(table._staged_at.removeprefix("file:"))


def test_word_hashes_match_words(words):
    texts = [" ".join(words).encode(), b"", b"  a b ", "é ß".encode()]
    found = common.Words(texts, common.NOT_SPACE)
    assert [found.raw[s:e] for s, e in zip(found.starts, found.ends, strict=True)] == [w for t in texts for w in t.split()]
    assert list(np.diff(found.first)) == [len(t.split()) for t in texts]
    hashes = found.hashes(found.starts, found.ends)
    by_word = {}
    for s, e, h in zip(found.starts, found.ends, hashes, strict=True):
        assert by_word.setdefault(found.raw[s:e], h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_pipeline_stages(spark, tmp_path, corpus):
    import corpus_pipeline

    rows = documents(spark, corpus).select("doc_id", "text", "lang", "source", "n_chars", F.lit(1).alias("gone_cell"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    passage = next(t for _, t in corpus if t and "\n" in t and len(t.split()) > 40).split()[12:30]
    spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = common.staged(stage(spark, docs, str(tmp_path)), f"test-{k}")
        assert out.columns == docs.columns
        docs = out
        kept.append(sorted(r["doc_id"] for r in out.collect()))
    low = {d: re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for d, t in corpus}
    first = {}
    for d in sorted(low):
        first.setdefault(low[d], d)
    assert kept[0] == sorted(low) and kept[1] == sorted(first.values())
    near = brute_components([(d, t) for d, t in corpus if d in set(kept[1])], 5, 80)
    assert kept[2] == sorted(d for d, (_, c) in near.items() if d == c)
    assert set(kept[3]) < set(kept[2])
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p["doc_id"] for p in pieces} == set(kept[3])


def test_pipeline_odd_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, cell int"
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    long = "lorem " + " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, "x y z", "en", "s", 5, 1), (2, "x y z", None, "s", 5, 1), (2, "unique text here", "en", "s", 5, 1), (3, None, None, None, None, None), (None, "x y z", "en", "s", 1, 1), (None, None, "en", "s", 1, 1), (4, "", "en", "s", 0, 0), (5, long, "en", "s", 1, 1), (6, long + " more", "en", "s", 1, 1)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    pieces = collections.Counter(p["doc_id"] for p in corpus_pipeline.run(spark, str(tmp_path)).collect() if p["start"] == 0)
    # (1) and the unique text of (2) stay, of the empty ones (3), of the long ones (5); rows without doc_id equal others
    assert pieces == {1: 1, 2: 1, 3: 1, 5: 1}


def test_toxicity_learns_from_every_row(spark, monkeypatch):
    """All labelled rows and whole texts count, in several shards: rows that a sample of 3600 doc_ids and 64 KiB left out."""
    monkeypatch.setattr(toxicity, "SHARD", 60)
    learnt = [k for k in range(400) if zlib.crc32(str(k).encode()) % 3 != 1]
    rng = random.Random(2)
    make = lambda bad: " ".join([*("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(30)), *(["vexq"] * bad)])
    docs = documents(spark, [(k, make(k % 3 == 0)) for k in learnt] + [(learnt[0], "again")] * 5 + [(learnt[1], "pad " * 40_000 + "vexq")])
    marks = spark.createDataFrame([(k, int(k % 3 == 0)) for k in learnt], "doc_id long, toxic int")
    rows = toxicity.labelled(docs, marks)
    shards = toxicity._dealt(rows)
    assert rows.count() == len(learnt) + 6 == shards.count() and shards.select("shard").distinct().count() > 3
    assert max(len(r["cells"]) for r in shards.collect()) == 6 * (40_001 + 2 * toxicity.PAD)
    model, again = toxicity.train(docs, marks), toxicity.train(docs.repartition(5), marks)
    assert np.array_equal(model.table, again.table) and model.scale == again.scale
    bad, good = model.scores([make(True).encode() for _ in range(50)]), model.scores([make(False).encode() for _ in range(50)])
    assert (bad > 0.5).mean() > 0.9 and (good < 0.5).mean() > 0.9
