"""Windows across the borders of texts against the joined text."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkstone.functions.constants import LEXICON_STOPWORDS
from inkstone.operators import borders, distance, lexicon
from inkstone.operators import features as ft

WORDS = ["Ada", "Byron", "Van", "Dyk", "the", "and", "Mill.", "(Who)", "x", "Ärzte", "I", "go!", "ΑΣ", "Ö"]


def corpus(n=400, seed=5):
    """Texts of two keys and none, most of one key; many are empty, null or a word, and some places are taken twice."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        kind = draw.random()
        text = None if kind < 0.1 else "" if kind < 0.2 else draw.choice(["x", "AB", " ", "\n", "Σ"]) if kind < 0.4 else " ".join(draw.choices(WORDS, k=draw.randint(1, 6)))
        rows.append((draw.choice(["a", "a", "a", "b", None]), i, text))
    return rows


def joined(rows):
    out = {}
    for k, _, text in sorted((r for r in rows if r[2] is not None), key=lambda r: r[1]):
        out.setdefault(k, []).append(text)
    return {k: "\n\n".join(texts) for k, texts in out.items()}


def grams(text):
    low = text.lower()
    return Counter(low[i : i + 3] for i in range(len(low) - 2))


def names(text):
    trim = lambda w: re.sub(r"^[^\w]+|[^\w]+$", "", w)
    raw = text.split()
    words, out = [trim(w) for w in raw], Counter()
    for size in (2, 3, 4):
        for i in range(len(words) - size + 1):
            part = words[i : i + size]
            if all(w[:1].isupper() for w in part) and len(" ".join(part).encode()) >= 3:
                out[" ".join(part)] += 1
    for before, w in zip(raw, words[1:], strict=False):
        if w[:1].isupper() and len(w.encode()) >= 3 and before[-1] not in ".!?" and w.lower() not in LEXICON_STOPWORDS:
            out[w] += 1
    return out


def table(spark, rows, parts=5):
    return spark.createDataFrame(rows, "k string, row long, text string").repartition(parts)


def test_trigrams_of_the_joined_text(spark):
    rows = corpus()
    got = {(r["k"], r["gram"]): r["n"] for r in ft.trigrams(table(spark, rows), order="row").collect()}
    assert got == {(k, g): n for k, text in joined(rows).items() for g, n in grams(text).items()}


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_blocks_change_nothing(spark, block):
    rows = [("a", i, t) for _, i, t in corpus(seed=9)]
    inside, whole = Counter(), grams(joined(rows)["a"])
    for _, _, t in rows:
        inside.update(grams(t or ""))
    found = borders.trigrams(table(spark, rows, 9), "row", block=block).groupBy("gram").agg(F.sum("n").alias("n"))
    assert {r["gram"]: r["n"] for r in found.collect()} == dict(whole - inside)


def test_names_of_the_joined_text(spark):
    rows = corpus()
    text = joined([("a", i, t) for _, i, t in rows])["a"]
    got = {r["term"]: r["n"] for r in lexicon.entities(table(spark, rows), min_count=1, order="row").collect()}
    assert got == dict(names(text))
    apart = {r["term"]: r["n"] for r in lexicon.entities(table(spark, rows), min_count=1).collect()}
    assert sum(apart.values()) < sum(got.values())


def test_places_taken_twice(spark):
    rows = [("a", 1, "ab"), ("a", 1, "ab"), ("a", 1, "ab"), ("a", None, "c"), ("a", 2, None)]
    got = {r["gram"]: r["n"] for r in ft.trigrams(table(spark, rows), order="row").collect()}
    assert got == dict(grams("c\n\nab\n\nab\n\nab"))
    tied = table(spark, [("a", 1, t) for t in ("Ada", "Byron", "Dyk")])
    once = {r["term"] for r in lexicon.entities(tied, min_count=1, order="row").collect()}
    assert once == {r["term"] for r in lexicon.entities(tied.repartition(2), min_count=1, order="row").collect()} and len(once) == 5


@pytest.mark.parametrize("rows", [[], [("a", 1, None)], [("a", 1, "")], [("a", 1, "Ada")]])
def test_nothing_to_cross(spark, rows):
    assert not borders.trigrams(table(spark, rows), "row").collect()
    assert not borders.words(table(spark, rows), "row", 4).collect()
    assert not lexicon.entities(table(spark, rows), min_count=1, order="row").collect()


def test_texts_are_not_moved(spark):
    """Only edges are sorted: no exchange holds a text."""
    found = borders.followed(borders._edges(table(spark, corpus()), "row", F.left("text", F.lit(2)), F.right("text", F.lit(2))), 2)
    assert "text#" not in found._jdf.queryExecution().executedPlan().toString()


def test_profiles_of_the_joined_text(spark):
    rows = [r for r in corpus() if r[0]]
    style = distance.fingerprint(table(spark, rows), order="row")
    texts = joined(rows)
    for r in style.collect():
        best = sorted(grams(texts[r["k"]]).items(), key=lambda x: (-x[1], x[0]))[:500]
        assert [(g["gram"], g["n"]) for g in r["ngram_profile"]] == best
