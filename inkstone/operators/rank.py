"""Candidates: relevance, quality filter, ranking, choice, and preference pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tokens as K
from ..functions.constants import AUTHOR_VALID, BANNED_PHRASES, BANNED_WORDS, PROMPT_STOPWORDS
from .distance import FORMULAS, HALF_UP
from .features import repetition, rounded
from .sentences import bind


def relevance(prompt: Column, output: Column) -> Column:
    """Share of the prompt's content words that the output has, whole or by their first letters (four, or all of a
    shorter word); 1 if the prompt has none."""
    low = lambda words: F.array_distinct(F.transform(words, lambda w: F.lower(w)))
    heads = lambda said, n: F.array_distinct(F.transform(said, lambda w: F.substring(w, 1, n)))

    def share(words: Column, said: Column, stems: Column, threes: Column) -> Column:
        hit = F.filter(
            words,
            lambda w: F.when(F.length(w) >= 4, F.array_contains(stems, F.substring(w, 1, 4)))
            .when(F.length(w) == 3, F.array_contains(threes, w))
            .otherwise(F.exists(said, lambda s: s.startswith(w))),
        )
        return F.when(F.size(words) == 0, 1.0).otherwise(F.size(hit) / F.size(words))

    # bound, or each word of the prompt would have the output cut into words again
    def with_words(words: Column) -> Column:
        return bind(low(K.unicode_words(output)), lambda said: bind(heads(said, 4), lambda stems: bind(heads(said, 3), lambda threes: share(words, said, stems, threes))))

    return bind(K.content_words(prompt, PROMPT_STOPWORDS), with_words)


def rejections(text: Column) -> Column:
    """Why a text fails: phrases, more than three formulaic words, under ten words, repetition over 0.4."""
    text = F.coalesce(text, F.lit(""))
    found = FORMULAS.present(F.lower(text))
    phrases = F.array_intersect(found, F.array(*[F.lit(p) for p in BANNED_PHRASES]))
    n_words = F.size(found) - F.size(phrases)
    n = K.plain_word_count(text)
    return F.concat(
        F.transform(phrases, lambda p: F.concat(F.lit("phrase: "), p)),
        F.array_compact(
            F.array(
                F.when(n_words > 3, F.concat(F.lit("formulaic words: "), n_words.cast("string"))),
                F.when(n < 10, F.lit("too short")),
                F.when((n > 20) & (repetition(text) > 0.4), F.lit("repetition")),
            )
        ),
    )


def rank_score(distance: Column, relevance: Column, slop: Column, repeated: Column) -> Column:
    """Lower is better: distance, with penalties for straying from the prompt, formulas and repetition; 0 to 1.5, rounded
    half up to six digits (see `distance.overall`)."""
    score = distance + 0.25 * (1 - relevance) * (1 - relevance) + 0.10 * slop + 0.10 * repeated
    return F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.5)) + HALF_UP, 6)


def rank(candidates: DataFrame) -> DataFrame:
    """candidates (prompt_id, candidate_index, rank_score, ...) with rank, ties by index."""
    order = Window.partitionBy("prompt_id").orderBy("rank_score", "candidate_index")
    return candidates.withColumn("rank", F.row_number().over(order))


def choose(candidates: DataFrame) -> DataFrame:
    """Of each prompt the best candidate that passes; if none does, the best. (prompt_id, candidate_index, rank_score,
    passed, ...)"""
    key = F.struct((~F.col("passed")).alias("failed"), F.col("rank_score"), F.col("candidate_index"))
    best = candidates.groupBy("prompt_id").agg(
        F.min_by(F.struct("candidate_index", "rank_score", "passed"), key).alias("best"), F.count(F.lit(1)).alias("candidates")
    )
    return best.select("prompt_id", "best.*", "candidates")


def decode(candidates: DataFrame, *, max_attempts: int = 3) -> DataFrame:
    """Of each prompt the best passing candidate of the first attempt that has one; if none has, the best of the last
    attempt. candidates (prompt_id, attempt, candidate_index, rank_score, passed); later attempts than max_attempts are
    never made."""
    rows = candidates.where(F.col("attempt") <= max_attempts)
    # attempts of a prompt are few, so a key tells them apart: passing ones by attempt, others from the last one back
    failed = ~F.col("passed")
    key = F.struct(failed, F.when(failed, -F.col("attempt")).otherwise(F.col("attempt")).alias("a"), "rank_score", "candidate_index")
    best = rows.groupBy("prompt_id").agg(F.min_by(F.struct("attempt", "candidate_index", "rank_score", "passed"), key).alias("best"))
    return best.select("prompt_id", "best.*")


def mine_pairs(candidates: DataFrame, *, min_margin: float = 0.03, min_relevance: float = 0.3) -> DataFrame:
    """Of each prompt with two candidates at least, the best and the middle one, if far enough apart and the best is
    relevant. (prompt_id, candidate_index, distance, relevance)"""
    order = Window.partitionBy("prompt_id").orderBy("distance", "candidate_index")
    rows = candidates.withColumn("at", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("prompt_id")))
    pick = lambda c, at: F.max(F.when(F.col("at") == at, F.col(c)))
    pairs = (
        rows.where("n >= 2")
        .withColumn("middle", F.floor(F.col("n") / 2))
        .groupBy("prompt_id")
        .agg(
            pick("candidate_index", 0).alias("chosen"),
            pick("candidate_index", F.col("middle")).alias("rejected"),
            pick("distance", 0).alias("chosen_distance"),
            pick("distance", F.col("middle")).alias("rejected_distance"),
            pick("relevance", 0).alias("chosen_relevance"),
        )
        .withColumn("margin", rounded(F.col("rejected_distance") - F.col("chosen_distance")))
    )
    return pairs.where((F.col("margin") >= min_margin) & (F.col("chosen_relevance") >= min_relevance))


def pair_stats(pairs: DataFrame) -> DataFrame:
    m = F.col("margin")
    return pairs.agg(
        F.count(F.lit(1)).alias("pairs"), rounded(F.avg(m)).alias("avg_margin"), F.min(m).alias("min_margin"), F.max(m).alias("max_margin")
    )


def logit_bias(banned: DataFrame, em_dashes: DataFrame) -> DataFrame:
    """k, bias: formulaic words at -4.0, and the em dash at +0.3 for authors that use over two in 1000 words.
    banned (k, banned array), em_dashes (k, em_dash)."""
    fixed = F.array(*[F.lit(w) for w in BANNED_WORDS if w not in AUTHOR_VALID])
    words = F.array_sort(F.array_union("banned", fixed))
    minus = F.map_from_entries(F.transform(words, lambda w: F.struct(w, F.lit(-4.0))))
    dash = F.when(F.col("em_dash") > 2, F.create_map(F.lit("—"), F.lit(0.3)))
    both = F.coalesce(F.map_concat(minus, dash), minus)
    return banned.join(em_dashes, "k").select("k", both.alias("bias"))
