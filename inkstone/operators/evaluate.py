"""Evaluation records: summaries, buckets with totals, and the gated winner.

Sums are of decimals, so that they don't depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..stage import staged
from . import distance, profiles
from .corpus import holdout_split

STANDARD_BUCKETS = ["off-domain", "canon-adjacent", "longform", "shortform"]


def bucket_of(category: Column) -> Column:
    return F.when(category.isin("canon-adjacent", "longform", "shortform"), category).otherwise("off-domain")


def mean(x: str) -> Column:
    return F.coalesce(F.round(F.avg(F.col(x).cast("decimal(20,6)")).cast("double"), 6), F.lit(0.0))


def median(x: Column) -> Column:
    """The median, rounded half up to six digits; of whole millionths, so that ties don't depend on how doubles are."""
    return F.floor(F.percentile(F.round(x * 1_000_000).cast("long"), 0.5) + 0.5) / 1_000_000


def summary(records: DataFrame, measures: list[str], *, prompt: str = "prompt") -> DataFrame:
    """One row: means of the measures, the median of the first, prompts and records."""
    first = measures[0]
    return records.agg(
        *[mean(m).alias(f"mean_{m}") for m in measures],
        F.coalesce(median(F.col(first)), F.lit(0.0)).alias(f"median_{first}"),
        F.countDistinct(prompt).alias("prompts"),
        F.count(F.lit(1)).alias("records"),
    )


def buckets(records: DataFrame) -> DataFrame:
    """combo, bucket ('overall' too), count, failed, and measures of the records that succeeded; nulls where none did.
    records (combo, bucket, status, distance, leakage, terminal, structural). Standard buckets always appear."""
    ok = lambda x: F.when(F.col("status") == "ok", F.col(x))
    avg = lambda x: F.round(F.avg(ok(x).cast("decimal(20,6)")).cast("double"), 6)
    records = staged(records, "records")
    got = records.rollup("combo", "bucket").agg(
        F.grouping_id().alias("level"),
        F.count_if(F.col("status") == "ok").alias("count"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        avg("distance").alias("mean_distance"),
        median(ok("distance")).alias("median_distance"),
        F.round(F.var_pop(ok("distance")), 6).alias("variance_distance"),
        avg("leakage").alias("mean_leakage"),
        F.max(ok("leakage")).alias("worst_leakage"),
        avg("terminal").alias("mean_terminal"),
        avg("structural").alias("mean_structural"),
    )
    got = got.where("level < 3").withColumn("bucket", F.when(F.col("level") == 1, "overall").otherwise(F.col("bucket"))).drop("level")
    names = F.explode(F.array(*[F.lit(b) for b in STANDARD_BUCKETS])).alias("bucket")
    frame = records.select("combo").distinct().select("combo", names)
    missing = frame.join(got.select("combo", "bucket"), ["combo", "bucket"], "left_anti")
    return got.unionByName(missing, allowMissingColumns=True).fillna(0, ["count", "failed"])


def _gate(rows: DataFrame, score: str, name: str) -> DataFrame:
    """rows with {name}: whether they pass, for those that passed before: the better half and one more, two at least;
    combos are few."""
    own = Window.partitionBy("in_play")
    n = F.count(F.lit(1)).over(own)
    at = F.row_number().over(own.orderBy(F.asc_nulls_last(score), "combo"))
    rows = rows.withColumn("_keep", F.col("in_play") & (at <= F.least(n, F.greatest(F.floor(n / 2) + 1, F.lit(2)))))
    return rows.withColumn(name, F.when(F.col("in_play"), F.col("_keep"))).withColumn("in_play", F.col("_keep")).drop("_keep")


def gates(stats: DataFrame) -> DataFrame:
    """combo, off_domain_leakage, voice, overall_distance, gate (that eliminates it: 0 no success, 1 leakage off the domain,
    2 punctuation, 3 distance; null for the winner) and reasons, in order."""
    stats = staged(stats, "buckets")  # a few rows for each combo
    overall = stats.where("bucket = 'overall'")
    off = stats.where("bucket = 'off-domain' and count > 0").select("combo", F.col("mean_leakage").alias("off"))
    rows = overall.join(off, "combo", "left").withColumn("off_domain_leakage", F.coalesce("off", "mean_leakage"))
    rows = rows.withColumn("voice", F.col("mean_terminal") + F.col("mean_structural")).withColumn("in_play", F.col("count") > 0)
    rows = _gate(_gate(rows, "off_domain_leakage", "g1"), "voice", "g2")
    best = Window.partitionBy("in_play").orderBy(F.asc_nulls_last("mean_distance"), "combo")
    rows = rows.withColumn("g3", F.when(F.col("in_play"), F.row_number().over(best) == 1))
    gate = F.when(F.col("count") == 0, 0).when(~F.col("g1"), 1).when(~F.col("g2"), 2).when(~F.col("g3"), 3)
    said = lambda g, form, x: F.when(F.col(g).isNotNull(), F.format_string(form, F.col(x), F.when(F.col(g), "PASS").otherwise("ELIMINATED")))
    reasons = F.array_compact(F.array(
        F.when(F.col("count") == 0, "no successful generation"), said("g1", "G1 leak=%.4f %s", "off_domain_leakage"), said("g2", "G2 voice_dist=%.4f %s", "voice"),
        F.when(F.col("g3"), F.format_string("WINNER dist=%.3f leak=%.4f", F.col("mean_distance"), F.col("off_domain_leakage"))),
    ))
    return rows.select("combo", "off_domain_leakage", F.round("voice", 6).alias("voice"), F.col("mean_distance").alias("overall_distance"), gate.alias("gate"), reasons.alias("reasons"))


def winner(stats: DataFrame) -> DataFrame:
    """The combo that passes all gates; no row if none has a success."""
    return gates(stats).where("gate is null").drop("gate", "reasons")


def voice_fidelity(distances: DataFrame) -> DataFrame:
    """One row: mean distance of samples (overall) from a profile, 1 without any, and their number."""
    return distances.agg(F.coalesce(F.round(F.avg(F.col("overall").cast("decimal(20,6)")).cast("double"), 6), F.lit(1.0)).alias("voice"), F.count(F.lit(1)).alias("samples"))


def bench(samples: DataFrame, *, ratio: float = 0.1, creative: float = 72.0, smoke: bool = False) -> DataFrame:
    """One row: how near the held-out samples (doc_id, text) are to the profile of all others, their mean slop, the given
    creative score, and the combined score. smoke: the first three of them only."""
    split = holdout_split(samples, ratio)
    held = split.where("held_out")
    if smoke:
        held = held.orderBy("doc_id").limit(3)
    # the first by doc_id lie together, in few files; by all that is in a row they are dealt to all tasks
    held = held.select("doc_id", "text").repartition(F.xxhash64("doc_id", "text"))
    presence = F.round(distance.slop_presence(F.col("text")).cast("double"), 6)
    texts = staged(held.select(F.col("doc_id").alias("k"), "text", presence.alias("presence")), "held-out")
    profile = distance.Style.of(split.where("not held_out").select(F.lit("train").alias("k"), "text"))
    voice = voice_fidelity(profiles.against(texts.select("k", "text"), profile))
    slop = texts.agg(mean("presence").alias("slop"))
    both = voice.crossJoin(F.broadcast(slop)).withColumn("creative", F.lit(creative))  # one row each
    return both.withColumn("combined", F.round(combined(F.col("voice"), F.col("slop"), F.col("creative")), 6))


def grid(prompts: DataFrame, seeds: list[int], formats: list[str], modes: list[str]) -> DataFrame:
    """prompts with seed, format, mode and combo: each prompt with each combination, whose lists are short parameters."""
    each = lambda name, values: F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
    rows = prompts
    for name, values in (("seed", seeds), ("format", formats), ("mode", modes)):
        rows = rows.select("*", each(name, values))
    return rows.withColumn("combo", F.concat_ws(" + ", "format", "mode"))


def combined(voice: Column, slop: Column, creative: Column) -> Column:
    score = 0.5 * (1 - voice) + 0.3 * (1 - slop / 100) + 0.2 * creative / 100
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
