"""Prompt texts, progress lines of trainers, and model names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. The texts below are part of what is sent to a model, so they stand here as they are.

RHYTHM = "Match the author's rhythm and register, not the training corpus subject matter."
FRAGMENTS = "Alternate clipped sentences (%.0f-word fragments) with longer flowing ones."
DICTION = "Prefer concrete, everyday diction over abstract jargon."
DASHES = "Use occasional em-dash asides."
ASIDES = "Use asides sparingly; punctuation should feel incidental, not performative."
PREFERRED = "Words you naturally reach for: %s."
AVOIDED = "Avoid these AI-sounding words: delve, tapestry, landscape, leverage, nuance, multifaceted, holistic, pivotal."
NAMES = "Do not reuse recurring names or universe-specific nouns unless the user asks for them."
ON_TOPIC = "Keep the answer on-topic. Output only the requested text."
REWRITE = (
    "Rewrite the following text while preserving its meaning and the author's voice. Keep the same level of formality, "
    "vocabulary preferences, and sentence rhythm. Do not add flourishes or structure the original did not have. Output only "
    "the rewritten text.\n\nORIGINAL:\n%s\n\nREWRITTEN:"
)


def system_prompt(mean: Column, sd: Column, em_dash: Column, preferred: Column) -> Column:
    """Instructions from a profile: sentence lengths, em dashes by 1000 words, preferred words (the first eight)."""
    shortest = F.round(F.greatest(mean - sd, F.lit(1.0)))
    words = F.array_join(F.slice(preferred, 1, 8), ", ")
    notes = F.array(
        F.lit(RHYTHM), F.format_string(FRAGMENTS, shortest), F.lit(DICTION), F.when(em_dash > 2.0, F.lit(DASHES)), F.lit(ASIDES),
        F.when(words != "", F.format_string(PREFERRED, words)), F.lit(AVOIDED), F.lit(NAMES), F.lit(ON_TOPIC),
    )
    return F.array_join(F.array_compact(notes), "\n")


def rewrite_prompt(original: Column) -> Column:
    return F.format_string(REWRITE, original)


def progress(line: Column) -> Column:
    """step, loss, learning_rate and steps a second of a line such as `Iter 100: Train loss 2.345, Learning Rate 1e-4, ...`;
    null for other lines."""
    number = lambda name: F.trim(F.regexp_extract(line, rf"{name} ([^,]*)", 1)).try_cast("double")
    step = F.trim(F.regexp_extract(line, r"^Iter ([^:]*)", 1)).try_cast("int")
    loss = number("Train loss")
    whole = line.startswith("Iter ") & line.contains("Train loss ") & line.contains("Learning Rate ") & line.contains("It/sec ")
    return F.when(
        whole & step.isNotNull() & loss.isNotNull(),
        F.struct(step.alias("step"), loss.alias("loss"), F.coalesce(number("Learning Rate"), F.lit(0.0)).alias("learning_rate"), F.coalesce(number("It/sec"), F.lit(0.0)).alias("steps_per_second")),
    )


_SIZED = r"^(?:(.*?)-)?([0-9]+b(?:-.*)?)$"
#: Owners by family of models.
OWNERS = {"gemma": "google", "llama": "meta", "qwen": "qwen"}


def model_tag(name: Column) -> Column:
    """family:size of a hyphenated model name: the size is its first part of digits and a `b`, else its last part; hyphens
    before it go."""
    family = lambda x: F.replace(x, F.lit("-"), F.lit(""))
    sized = F.concat(family(F.regexp_extract(name, _SIZED, 1)), F.lit(":"), F.regexp_extract(name, _SIZED, 2))
    last = F.concat(family(F.regexp_extract(name, "^(.*)-[^-]*$", 1)), F.lit(":"), F.regexp_extract(name, "^.*-([^-]*)$", 1))
    return F.when(name.contains(":") | ~name.contains("-"), name).when(name.rlike(_SIZED), sized).otherwise(last)


def model_id(tag: Column) -> Column:
    """owner/name of a tag; the owner goes by the family where the tag has none."""
    plain = F.regexp_replace(tag, ":latest$", "")
    owner = F.lit("local")
    for family, name in OWNERS.items():
        owner = F.when(plain.startswith(family), name).otherwise(owner)
    return F.when(plain.contains("/"), plain).otherwise(F.concat(owner, F.lit("/"), F.replace(plain, F.lit(":"), F.lit("-"))))
