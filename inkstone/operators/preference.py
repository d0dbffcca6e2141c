"""Preference losses over pairs of texts, from the log-probabilities that a model gives their parts.

Any model that gives a mean log-probability for a text will do. The one here is a character model, counted from trigrams:
the chance of a character after the two before it, each character of the corpus added once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stage import staged
from . import features as ft
from .features import rounded


@dataclass
class CharacterModel:
    """Counts of trigrams (gram, n) and of what they begin with (head, m), and how many characters follow anything."""

    grams: DataFrame
    heads: DataFrame
    characters: int

    @classmethod
    def of(cls, texts: DataFrame) -> CharacterModel:
        """Counted from all texts (a column text)."""
        counts = ft.trigrams(texts.select(F.lit(0).alias("k"), "text"))
        grams = staged(counts.select("gram", "n"), "model-grams")
        heads = staged(grams.groupBy(F.substring("gram", 1, 2).alias("head")).agg(F.sum("n").alias("m")), "model-heads")
        return cls(grams, heads, grams.select(F.substring("gram", 3, 1)).distinct().count())


def log_probabilities(texts: DataFrame, model: CharacterModel) -> DataFrame:
    """k, tokens, mean_logp of texts (k, text): the mean over all characters that have two before them; null without any. A
    text sends its distinct trigrams, each once, however often it has them."""
    own = ft.trigrams(texts).withColumn("head", F.substring("gram", 1, 2)).withColumnRenamed("n", "times")
    rows = own.join(model.grams, "gram", "left").join(model.heads, "head", "left").fillna(0, ["n", "m"])
    logp = F.log((F.col("n") + 1) / (F.col("m") + F.lit(max(model.characters, 1))))
    found = rows.groupBy("k").agg(F.sum("times").alias("tokens"), F.sum(F.col("times") * logp).alias("total"))
    return texts.select("k").distinct().join(found, "k", "left").select("k", F.coalesce("tokens", F.lit(0)).alias("tokens"), rounded(F.col("total") / F.col("tokens")).alias("mean_logp"))


def simpo(margin: Column, *, beta: float = 0.1, gamma: float = 1.0) -> Column:
    """-log(sigmoid(beta * (margin - gamma))), for a margin of mean log-probabilities."""
    return F.log1p(F.exp(-beta * (margin - gamma)))


def dpo(margin: Column, *, beta: float = 0.1) -> Column:
    """-log(sigmoid(beta * margin)): without a reference model."""
    return F.log1p(F.exp(-beta * margin))


def losses(pairs: DataFrame, scores: DataFrame, *, beta: float = 0.1, gamma: float = 1.0) -> DataFrame:
    """pairs (chosen, rejected: keys of texts, ...) with the mean log-probabilities of both (scores: k, mean_logp), their
    margin and the losses; a text without log-probability leaves null."""
    side = lambda name: scores.select(F.col("k").alias(name), F.col("mean_logp").alias(f"{name}_logp"))
    rows = pairs.join(side("chosen"), "chosen", "left").join(side("rejected"), "rejected", "left")
    rows = rows.withColumn("logp_margin", rounded(F.col("chosen_logp") - F.col("rejected_logp")))
    margin = F.col("logp_margin")
    return rows.withColumns({"simpo": rounded(simpo(margin, beta=beta, gamma=gamma)), "dpo": rounded(dpo(margin, beta=beta))})
