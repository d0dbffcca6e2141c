"""Decoding with regeneration: prompts whose candidates all fail go to the backend again.

The prompts still open are a table, the frontier. Each attempt gives every open prompt its candidates, scores them in the
pass over their texts that also holds them against the profile, and closes the prompts that have one which passes; only
the others are generated for again. An attempt's candidates are written to the shared folder before they are scored, so
that the backend is asked once for each, whatever is lost later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stage import discard, staged
from . import backends, rank
from .distance import Style
from .features import repetition
from .profiles import against


def score(candidates: DataFrame, profile: Style) -> DataFrame:
    """candidates (prompt_id, prompt, candidate_index, output, ...) with distance, relevance, slop, repetition, rank_score
    and passed. Nothing is joined: a candidate's columns go along with its text."""
    texts = candidates.select(F.struct(*candidates.columns).alias("k"), F.col("output").alias("text"))
    rows = against(texts, profile).select("k.*", F.col("overall").alias("distance"), "slop")
    out = F.col("output")
    rows = rows.withColumns({
        "relevance": F.round(rank.relevance(F.col("prompt"), out), 6), "repetition": F.round(repetition(out), 6), "passed": F.size(rank.rejections(out)) == 0,
    })
    return rows.withColumn("rank_score", rank.rank_score(F.col("distance"), F.col("relevance"), F.col("slop"), F.col("repetition")))


def decode(prompts: DataFrame, backend: backends.Backend, profile: Style, *, candidates: int = 3, max_attempts: int = 3, seed: int = 0, max_tokens: int = 512) -> DataFrame:
    """prompt_id, output, candidate_index, rank_score, passed, candidates (that came back in its attempt), regenerations.

    prompts (prompt_id, prompt), each id once. Of the first attempt that has a passing candidate, the best of those that
    pass; in the last attempt the best, whether it passes or not. A candidate for which the backend fails is left out; a
    prompt that has none is open still, and has null output after the last attempt. Null prompts are empty ones."""
    frontier, found = prompts.select("prompt_id", F.coalesce("prompt", F.lit("")).alias("prompt")), []
    for attempt in range(max_attempts):
        last = attempt == max_attempts - 1
        grid = frontier.select("*", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1))).alias("candidate_index"))
        grid = grid.withColumn("seed", F.lit(seed + attempt * candidates) + F.col("candidate_index"))
        made = staged(backends.generate(grid, backend, max_tokens=max_tokens, errors=True), "decode-candidates")
        scored = score(made.where("error is null").drop("error", "seed"), profile)
        # by rank alone in the last attempt, else those that pass first
        order = F.struct((F.lit(not last) & ~F.col("passed")).alias("failed"), "rank_score", "candidate_index")
        best = scored.groupBy("prompt_id", "prompt").agg(
            F.min_by(F.struct("output", "candidate_index", "rank_score", "passed"), order).alias("best"), F.count(F.lit(1)).alias("candidates")
        )
        best = best.select("prompt_id", "prompt", "best.*", "candidates")
        if last:  # those without any candidate too
            best = frontier.join(best, ["prompt_id", "prompt"], "left").fillna({"passed": False, "candidates": 0})
        best = staged(best.withColumn("regenerations", F.lit(attempt)), "decode-best")
        found.append(best if last else best.where("passed"))
        if last:
            break
        closed = found[-1].select("prompt_id", "prompt")
        frontier, before = staged(frontier.join(closed, ["prompt_id", "prompt"], "left_anti"), "decode-open"), frontier
        discard(made, *([before] if attempt else []))
        if frontier.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.drop("prompt")
