"""Passes over texts: counts of words, trigrams and lengths, in arrays that stay small."""

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from inkstone.operators import distance
from inkstone.operators import features as ft
from inkstone.operators import frequent, textpass


def test_words_leave_no_lists():
    """Lower-cased words are cut out in arrays, and are those of each text for itself."""
    texts = ["It's THE Été 3.14 𝒳y", "", "foo_Bar U.S.A. ß", "ΟΔΟΣ is Σ", "İstanbul I"]
    words = textpass.Words(texts)
    assert isinstance(words.lowered(), pa.Array) and words.lowered().to_pylist() == words._lowered_apart()
    plain = textpass.Words(texts[:3])
    assert plain.lowered().to_pylist() == plain._lowered_apart() == ["it's", "the", "été", "3.14", "𝒳y", "foo_bar", "u.s.a", "ß"]
    assert textpass.Words(["", "..."]).lowered().to_pylist() == []


def test_a_task_sends_each_trigram_once():
    """However many batches a task has, and in however many parts each is counted."""
    draw = random.Random(3)
    rows = [(draw.choice("ab"), "".join(draw.choice("xyz ") for _ in range(draw.randint(0, 50)))) for _ in range(400)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 100], strict=True)], ["k", "text"]) for i in range(0, 400, 100)]
    sent = [x for keys, grams, n in frequent.counted(iter(batches), sent=20) for x in zip(keys.to_pylist(), grams, n.tolist(), strict=True)]
    want = Counter((k, t[i : i + 3]) for k, t in rows for i in range(len(t) - 2))
    assert len(sent) == len(want) and {(k, g): n for k, g, n in sent} == want
    some = Counter()
    for keys, grams, n in frequent.counted(iter(batches), held=1, sent=20):  # too many to be held: sent in parts, none lost
        for k, g, c in zip(keys.to_pylist(), grams, n.tolist(), strict=True):
            some[k, g] += c
    assert some == want


def test_lengths_are_counts(spark):
    """A key's lengths leave the tasks as counts of each length, not one row for each word."""
    text = "One two three. Four five?\n\n...\n\nsix.\n\n\nseven eight"
    rows = spark.createDataFrame([("a", text), ("a", text), ("b", None), ("c", "")], "k string, text string").coalesce(1)
    got = sorted(map(tuple, ft.lengths(rows).collect()))
    assert got == [
        ("a", "paragraph", 1, 2), ("a", "paragraph", 2, 2), ("a", "paragraph", 5, 2),
        ("a", "sentence", 1, 2), ("a", "sentence", 2, 4), ("a", "sentence", 3, 2),
        ("a", "word", 3, 6), ("a", "word", 4, 4), ("a", "word", 5, 6),
    ]
    assert ft.length_table(rows).where(F.col("kind") == "word").select("median").first()["median"] == 4


def test_a_style_goes_through_the_texts_once(spark, monkeypatch):
    """Sums, words and trigrams come from one pass, and are those that each has on its own."""
    draw = random.Random(5)
    make = lambda: " ".join(draw.choice(["The", "the", "ÉTÉ", "of", "Σ", "x1", "a—b", "İs", "no. 5!"]) for _ in range(draw.randint(0, 30)))
    texts = [(draw.choice(["a", "b", None]), make()) for _ in range(200)] + [("a", None), ("none", None), ("two", "ab"), ("empty", "")]
    rows = spark.createDataFrame(texts, "k string, text string").coalesce(2)
    got = lambda df: sorted(map(repr, df.collect()))
    want = [got(ft.sums(rows)), got(ft.word_counts(rows)), got(ft.trigrams(rows))]
    passes = []
    keep = distance.staged
    monkeypatch.setattr(distance, "staged", lambda df, name: passes.append(df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")) or keep(df, name))
    own = distance.Counts.of(rows)
    assert sum(passes) == 1 and [got(own.sums), got(own.words), got(own.grams)] == want
    for held in (1, 20):  # counts are sent again and again
        every = ft.counts(rows, held=held)
        assert got(every.where(F.col("kind") == ft.WORD).select("k", F.col("term").alias("word"), "n")) == want[1]
        assert got(every.where(F.col("kind") == ft.GRAM).select("k", F.col("term").alias("gram"), "n")) == want[2]
    assert not ft.counts(rows.limit(0)).collect()
