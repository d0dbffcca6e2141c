"""The most frequent trigrams against plain counting."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkstone.operators import frequent
from inkstone.operators import features as ft


def plain(rows, limit):
    counts = {}
    for k, text in rows:
        low = (text or "").lower()
        counts.setdefault(k, Counter()).update(low[i : i + 3] for i in range(len(low) - 2))
    out = set()
    for k, c in counts.items():
        for rank, (g, n) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:limit], 1):
            out.add((k, g, n, rank))
    return out


def table(spark, rows, parts):
    return spark.createDataFrame(rows, "k string, text string").repartition(parts)


def drawn(seed, n, letters="abcdeé𝒳 "):
    draw = random.Random(seed)
    weights = [1 / (1 + i) for i in range(len(letters))]
    return [(draw.choice(["x", "x", "x", "y", None]), None if draw.random() < 0.05 else "".join(draw.choices(letters, weights, k=draw.randint(0, 30)))) for _ in range(n)]


def got(df):
    rows = [(r["k"], r["gram"], r["n"], r["rank"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(("limit", "kept", "parts", "held"), [(5, 5, 7, 1 << 20), (20, 30, 7, 1 << 20), (5, 8, 3, 1), (50, 5000, 4, 1 << 20), (1000, 1000, 2, 1 << 20)])
def test_counts_are_exact(spark, limit, kept, parts, held):
    rows = drawn(limit, 600)
    assert got(frequent.top_trigrams(table(spark, rows, parts), limit, kept=kept, held=held)) == plain(rows, limit)


def test_second_everywhere(spark):
    """A trigram that no task sends is the most frequent of all."""
    rows = [("x", own * 6 + "_" + "zzz" + "_" + "zzzz") for own in ("abc", "bcd", "cde", "def", "efg", "fgh", "ghi", "hij")]
    df = spark.createDataFrame(rows, "k string, text string").repartitionByRange(8, "text")
    assert got(frequent.top_trigrams(df, 1, kept=1)) == plain(rows, 1) == {("x", "zzz", 24, 1)}


def test_sent_by_some_only(spark):
    """Counts of tasks that did not send a trigram are looked up."""
    rows = [("x", "aaa" * 30 + f"{'b' * i}") for i in range(3, 12)] + [("x", "bbb" * 9 + "aaa" * 2), ("y", "ab")]
    for kept in (1, 2, 3):
        assert got(frequent.top_trigrams(spark.createDataFrame(rows, "k string, text string").repartition(11), 2, kept=kept)) == plain(rows, 2)


@pytest.mark.parametrize("rows", [[], [("x", None)], [("x", ""), (None, "ab")]])
def test_nothing_to_count(spark, rows):
    assert not frequent.top_trigrams(table(spark, rows, 2)).collect()


def test_few_rows_are_sent(spark):
    rows = [("x", t) for _, t in drawn(3, 2000, "abcdefghijklmnopqrstuvwxyz ")]
    counted = frequent._counted(table(spark, rows, 4), 50, 1 << 20).cache()
    assert counted.where("sent").count() == 4 * 51 < counted.count() / 10
    sums = counted.where(F.col("code") >= 0).groupBy("k", "code").agg(F.sum("n").alias("n")).count()
    assert sums == ft.trigrams(table(spark, rows, 4)).count()
    counted.unpersist()


def test_many_keys_and_numbers_as_keys(spark):
    draw = random.Random(8)
    rows = [(i % 300, "".join(draw.choices("abc", k=12))) for i in range(900)]
    df = spark.createDataFrame(rows, "k long, text string").repartition(5)
    assert got(frequent.top_trigrams(df, 3, kept=4)) == plain(rows, 3)
