"""Corpus steps by row: null and repeated ids and tags; and terms in texts against plain search."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from inkstone.functions.constants import AUTHOR_VALID, BANNED_PHRASES, BANNED_WORDS
from inkstone.operators import corpus, distance, lexicon, rank, terms

# --- ingest and splits ---

ODD = [
    (1, "one two three four five", "a"), (1, "one two three four five", "b"), (3, "first text of three here", "b"), (3, "another text of three here now", "c"), (3, "another text of three here now", None),
    (None, "no id at all in here", "none"), (None, "no id at all in here", None), (4, "no id at all in here", "none"), (5, None, None), (6, "", "none"), (7, "w " * 30, "a"), (None, "no id and unique words here", None),
]


def expected(rows, max_words):
    best, tags = {}, {}
    for d, t, g in rows:
        key = (d is None, d or 0, g is None, g or "")
        if (t or "") not in best or key < best[t or ""][0]:
            best[t or ""] = (key, d, g)
    chunks = [
        (d, g, i, c) for t, (_, d, g) in best.items() for i, c in enumerate(corpus.chunk_text(t, max_words, "\n"))
    ]
    for _, _, g in rows:
        tags.setdefault(g or "none", [0, 0, 0, 0])[1] += 1
    for _, _, g in best.values():
        tags[g or "none"][0] += 1
        tags[g or "none"][1] -= 1
    for _, g, _, c in chunks:
        tags[g or "none"][2] += 1
        tags[g or "none"][3] += len(c.split())
    total = [sum(v[k] for v in tags.values()) for k in range(4)]
    return sorted(chunks, key=repr), sorted([(k, *v) for k, v in tags.items()] + [(None, *total)], key=repr)


def test_ingest_by_row(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string, context_tag string")
    chunks, report = corpus.ingest(rows, max_words=20, cleaned=False, paragraph="\n")
    want = expected(ODD, 20)
    assert sorted((tuple(r) for r in chunks.select("doc_id", "context_tag", "chunk_index", "text").collect()), key=repr) == want[0]
    assert sorted((tuple(r) for r in report.select("context", "samples", "skipped", "chunks", "words").collect()), key=repr) == want[1]
    total = report.where("context is null").first()
    assert total["samples"] + total["skipped"] == len(ODD)


def test_ingest_known_and_empty(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string, context_tag string")
    known = corpus.content_hash(rows).select("content_hash")
    chunks, report = corpus.ingest(rows, max_words=20, cleaned=False, existing=known)
    assert chunks.count() == 0
    assert {r["context"]: r["skipped"] for r in report.collect()}[None] == len(ODD)
    none, report = corpus.ingest(rows.limit(0), max_words=20)
    assert none.count() == 0 and [tuple(r) for r in report.collect()] == [(None, 0, 0, 0, 0)]


@pytest.mark.parametrize("ratio", [0.01, 0.1, 0.25, 0.5, 0.9, 1.0])
@pytest.mark.parametrize("half", [False, True])
def test_split_of_odd_ids(spark, ratio, half):
    ids = [5, 5, 5, None, None, 9, 2, -(1 << 62), (1 << 62), 5, None, 1]
    rows = spark.createDataFrame([(d, f"text {k}") for k, d in enumerate(ids)], "doc_id long, text string")
    got = corpus.holdout_split(rows, ratio, at_most_half=half)
    found = [(r["doc_id"], r["held_out"]) for r in got.collect()]
    k = min(max(1, -int(-len(ids) * ratio // 1)), len(ids) // 2 if half else len(ids))
    assert got.columns == ["doc_id", "text", "held_out"] and len(found) == len(ids) and sum(h for _, h in found) == k
    order = lambda d: (d is None, d or 0)
    assert sorted((d for d, h in found if h), key=order) == sorted(ids, key=order)[:k]


def test_split_keeps_equal_rows_together(spark):
    rows = spark.createDataFrame([(1, "same")] * 6 + [(2, "other")], "doc_id long, text string")
    held = [r["held_out"] for r in corpus.holdout_split(rows, 0.1).orderBy("doc_id").collect()]
    assert held == [True] * 6 + [False]
    assert corpus.holdout_split(rows.limit(0), 0.1).count() == 0


# --- terms ---


def test_terms_against_search(evaluate):
    rng = random.Random(3)
    some = ["ab", "aba", "b", "a b", "c++", "aa", "é", "1.5", ""]
    texts = ["".join(rng.choice("aab é+c1.5-") for _ in range(rng.randint(0, 60))) for _ in range(80)] + ["", None, "c++", "aaaa"]
    own = terms.Terms([*some, "ab"])
    real = [t for t in some if t]
    assert evaluate(own.total, *texts) == [sum((t or "").count(w) for w in real) for t in texts]
    assert evaluate(lambda c: own.total(c, {"b": 5, "aa": 0}), *texts) == [sum({"b": 5, "aa": 0}.get(w, 1) * (t or "").count(w) for w in real) for t in texts]
    assert evaluate(own.present, *texts) == [[w for w in real if w in (t or "")] for t in texts]
    bounded = lambda w, t: re.search(rf"(?<![^\W_]){re.escape(w)}(?![^\W_])", t or "") is not None
    assert evaluate(own.whole, *texts) == [[w for w in real if bounded(w, t)] for t in texts]


def test_no_terms(evaluate):
    assert evaluate(terms.Terms([]).total, "a", None) == [0, 0] and evaluate(terms.Terms([""]).whole, "a") == [[]]


def test_ten_thousand_terms(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 9))) for _ in range(10_000)]
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(300)]
    rows = spark.createDataFrame([(k, "nothing", t) for k, t in enumerate(texts)], "k int, prompt string, output string")
    began = time.time()
    found = {r["k"]: r for r in lexicon.leakage(rows, words).collect()}
    assert time.time() - began < 60
    for k in range(0, 300, 50):
        said = set(texts[k].split())
        assert found[k]["leaked"] == [w for w in dict.fromkeys(words) if w in said] and found[k]["checkable"] == len(set(words))


def test_slop_and_filter_as_before(evaluate):
    texts = ["We delve into a rich tapestry; " + BANNED_PHRASES[0] + " ok", "plain words only here", "", None, "implementation implement " * 5]
    hits = lambda t: sum(t.lower().count(w) for w in BANNED_WORDS if w not in AUTHOR_VALID) + 2 * sum(t.lower().count(p) for p in BANNED_PHRASES)
    words = lambda t: len(re.findall(r"\w+", t))
    got = evaluate(distance.slop, *texts)
    for t, x in zip(texts, got, strict=True):
        assert x == pytest.approx(min(hits(t) * 100 / words(t) / 5, 1) if t else 0.0)
    reasons = evaluate(rank.rejections, *texts)
    assert reasons[0][0] == f"phrase: {BANNED_PHRASES[0]}" and reasons[2] == reasons[3] == ["too short"]
