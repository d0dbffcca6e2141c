"""Distances of texts from a style profile.

Texts and profiles are the same thing: style tables by key. `pairs` (k, p) says which text is held against which
profile. The sparse vectors (function words, trigrams) are joined on pair and term with whole-number dot products; only
terms that both sides hold meet, and norms are summed apart.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import AUTHOR_VALID, BANNED_PHRASES, BANNED_WORDS, DISTANCE_WEIGHTS, FUNCTION_WORDS, HISTOGRAM_CENTERS
from ..functions.tokens import plain_word_count, unicode_word_count
from ..stage import staged
from . import features as ft
from .features import rounded
from .sentences import bind
from .terms import Terms


@dataclass
class Counts:
    """What a style is made of, by k. Counts add up, so a larger key's are had from smaller ones' without the texts."""

    sums: DataFrame
    words: DataFrame
    grams: DataFrame

    @classmethod
    def of(cls, texts: DataFrame, *, order: str | None = None) -> Counts:
        """Written to the shared folder, since all measures rest on them: texts are read once for all. With `order` trigrams
        cross from text to text, see `features.trigrams`."""
        every = staged(ft.counts(texts, order=order), "style")
        of = lambda kind: every.where(F.col("kind") == kind)
        sums = of(ft.SUM).groupBy("k").agg(*[F.sum(F.when(F.col("term") == c, F.col("n"))).alias(c) for c in ft.SUMS])
        words, grams = (of(kind).select("k", F.col("term").alias(name), "n") for kind, name in ((ft.WORD, "word"), (ft.GRAM, "gram")))
        return cls(sums, words, grams)

    def merged(self, key: Column) -> Counts:
        """Summed by a coarser key, given in terms of k."""
        n = F.sum("n").alias("n")
        return Counts(
            self.sums.groupBy(key.alias("k")).agg(*[F.sum(c).alias(c) for c in ft.SUMS]),
            self.words.groupBy(key.alias("k"), "word").agg(n),
            self.grams.groupBy(key.alias("k"), "gram").agg(n),
        )


@dataclass
class Style:
    """Style tables by k: dense measures, counts of function words, and the most frequent trigrams."""

    dense: DataFrame
    words: DataFrame
    grams: DataFrame

    @classmethod
    def of(cls, texts: DataFrame | Counts) -> Style:
        counts = texts if isinstance(texts, Counts) else Counts.of(texts)
        # one projection of the sums: the texts are gone through once
        measures = [*ft.shape_columns(), *ft.punctuation_columns(), *ft.readability_columns()]
        dense = counts.sums.select("k", "n_words", "n_chars", *measures).join(ft.richness(counts.words), "k", "left")
        dense = dense.fillna(0, ["ttr", "yule_k", "hapax", "dis", "simpson"])
        words = counts.words.where(F.col("word").isin(sorted(set(FUNCTION_WORDS))))
        return cls(dense, words, ft.top_trigrams(counts.grams).select("k", "gram", "n"))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def cosine_distance(a: DataFrame, b: DataFrame, pairs: DataFrame, term: str) -> DataFrame:
    """k, p, distance: 1 - cosine of the counts; 0.5 where either side has none."""
    # counts fit well into doubles, and sums of their products up to 2**53 are exact
    n = lambda t: F.col(t).cast("double")
    na = a.groupBy("k").agg(F.sum(n("n") * n("n")).alias("norm_a"))
    nb = b.groupBy("k").agg(F.sum(n("n") * n("n")).alias("norm_b")).withColumnRenamed("k", "p")
    left = a.select("k", term, F.col("n").alias("a")).join(pairs, "k")
    right = b.select(F.col("k").alias("p"), term, F.col("n").alias("b"))
    dots = left.join(right, ["p", term]).groupBy("k", "p").agg(F.sum(n("a") * n("b")).alias("dot"))
    joined = pairs.join(na, "k", "left").join(nb, "p", "left").join(dots, ["k", "p"], "left")
    cosine = F.coalesce("dot", F.lit(0.0)) / (F.sqrt("norm_a") * F.sqrt("norm_b"))
    return joined.select("k", "p", rounded(F.when(cosine.isNull(), 0.5).otherwise(clamp(1.0 - cosine))).alias("distance"))


def histogram_emd(a: Column, b: Column) -> Column:
    """Earth mover's distance of two histograms of sentence lengths, scaled to 1."""
    gaps = [y - x for x, y in zip(HISTOGRAM_CENTERS, HISTOGRAM_CENTERS[1:], strict=False)]
    total, running = F.lit(0.0), F.lit(0.0)
    for i, gap in enumerate(gaps):
        running = running + (a[i] - b[i])
        total = total + F.abs(running) * gap
    return clamp(total / (HISTOGRAM_CENTERS[-1] - HISTOGRAM_CENTERS[0]))


def sentence_shift(mean: Column, sd: Column, own_mean: Column, own_sd: Column) -> Column:
    """Distance of sentence lengths from a profile that has no histogram: relative shifts of mean and deviation."""
    by_mean = F.abs((mean - own_mean) / F.greatest(own_mean, F.lit(1.0)))
    by_sd = F.when(own_sd > 0, F.abs((sd - own_sd) / own_sd)).otherwise(0.0)
    return clamp((by_mean + by_sd) / 2)


def fingerprint(texts: DataFrame, *, order: str | None = None) -> DataFrame:
    """The whole profile by k: dense measures, lengths of words, sentences and paragraphs as structs, frequencies of
    function words as a map, the most frequent trigrams in order, vocabulary_size, banned and preferred words."""
    counts = Counts.of(texts, order=order)
    style = Style.of(counts)
    stats = F.struct("mean", "sd", "median", "p95")
    kinds = ("word", "sentence", "paragraph")
    lengths = ft.length_table(texts).groupBy("k").agg(*[F.max(F.when(F.col("kind") == x, stats)).alias(f"{x}_length") for x in kinds])
    words = ft.function_words(counts.words).groupBy("k").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "freq")))).alias("function_words"))
    top = ft.top_trigrams(counts.grams).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("rank", "gram", "n"))).alias("t"))
    grams = top.select("k", F.transform("t", lambda x: F.struct(x["gram"].alias("gram"), x["n"].alias("n"))).alias("ngram_profile"))
    out = style.dense.drop("tokens", "types")
    for part in (lengths, words, grams, ft.vocabulary(counts.words)):
        out = out.join(part, "k", "left")
    return out


#: Far below the sixth digit, and far above the last bit.
HALF_UP = 1e-9

#: Formulaic words and phrases; the second list leaves out words that authors use as well.
ALL_FORMULAS = Terms([*BANNED_WORDS, *BANNED_PHRASES])
FORMULAS = Terms([*(w for w in BANNED_WORDS if w not in AUTHOR_VALID), *BANNED_PHRASES])
_TWICE = dict.fromkeys(BANNED_PHRASES, 2)


def slop(text: Column) -> Column:
    """Density of formulaic words and (twice) phrases, 1 at five in a hundred words."""
    found = F.struct(FORMULAS.total(F.lower(text), _TWICE).alias("hits"), unicode_word_count(text).alias("words"))
    return bind(found, lambda x: F.when(x["words"] > 0, clamp(x["hits"] * 100.0 / x["words"] / 5.0)).otherwise(0.0))


def slop_presence(text: Column) -> Column:
    """Distinct formulaic words and (twice) phrases in a hundred plain words, 100 at most."""
    found, words = ALL_FORMULAS.present(F.lower(text)), plain_word_count(text)
    phrases = F.array(*[F.lit(p) for p in BANNED_PHRASES])
    hits = F.size(found) + F.size(F.array_intersect(found, phrases))
    return F.when(words > 0, F.least(hits * 100.0 / words, F.lit(100.0))).otherwise(0.0)


def relative(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) > 0.1, F.abs((a - b) / F.greatest(F.abs(b), F.lit(1.0)))).otherwise(0.0)


def dense_parts(x: Callable[[str], Column], y: Callable[[str], Column]) -> dict[str, Column]:
    """The parts of the distance that dense measures give; x and y: the columns of a text and of a profile."""
    off = lambda c, scale: F.abs(x(c) - y(c)) / scale
    syllables = F.when(y("avg_syllables") > 0, F.abs((x("avg_syllables") - y("avg_syllables")) / y("avg_syllables"))).otherwise(0.0)
    yule = F.when(y("yule_k") > 0, F.abs((x("yule_k") - y("yule_k")) / F.greatest(y("yule_k"), F.lit(50.0)))).otherwise(0.0)
    return {
        "sentences": F.when((x("mean") == 0) | (y("mean") == 0), 0.5)
        .when(y("histogram").isNull(), sentence_shift(x("mean"), x("sd"), y("mean"), y("sd")))
        .otherwise(histogram_emd(x("histogram"), y("histogram"))),
        "terminal": clamp((off("question", 10) + off("exclamation", 10)) / 2),
        "structural": clamp((off("em_dash", 20) + off("semicolon", 10) + off("colon", 10) + off("paren", 20)) / 4),
        "readability": clamp((relative(x("flesch_kincaid"), y("flesch_kincaid")) + relative(x("coleman_liau"), y("coleman_liau")) + syllables) / 3),
        "richness": clamp((yule + F.abs(x("hapax") - y("hapax")) * 2 + F.abs(x("simpson") - y("simpson")) * 10) / 3),
    }


def overall(rows: DataFrame, slop_col: Column) -> DataFrame:
    """rows (k, p and all parts) with slop, base and overall. Parts have six digits and their weights two, so base often
    lies half way between two numbers of six digits; HALF_UP lifts it over, whatever the last bit of the double."""
    base = clamp(sum((F.col(k) * w for k, w in DISTANCE_WEIGHTS.items()), F.lit(0.0)))
    over = F.least(F.greatest(slop_col - 0.02, F.lit(0.0)) / 0.08, F.lit(1.0))
    return rows.select(
        "k", "p", *DISTANCE_WEIGHTS, rounded(slop_col).alias("slop"), rounded(base + HALF_UP).alias("base"),
        rounded(clamp(base * (1.0 + 0.4 * over * over)) + HALF_UP).alias("overall"),
    )


def distances(texts: Style, profiles: Style, pairs: DataFrame, slops: DataFrame | None = None) -> DataFrame:
    """The parts of the distance for each pair, base and overall. slops (k, slop): 0 where it has no row."""
    a, b = texts.dense.alias("a"), profiles.dense.withColumnRenamed("k", "p").alias("b")
    rows = pairs.join(a, "k").join(b, "p")
    parts = dense_parts(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}"))
    rows = rows.select("k", "p", *[rounded(v).alias(k) for k, v in parts.items()])
    for name, one, two, term in (
        ("function_words", texts.words, profiles.words, "word"),
        ("ngrams", texts.grams, profiles.grams, "gram"),
    ):
        rows = rows.join(cosine_distance(one, two, pairs, term).withColumnRenamed("distance", name), ["k", "p"])
    if slops is None:
        return overall(rows, F.lit(0.0))
    return overall(rows.join(slops.select("k", "slop"), "k", "left"), F.coalesce("slop", F.lit(0.0)))
