"""Corpus steps: dedupe, splits, chunks, reports, training rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clean
from ..functions import tokens as K
from ..stage import staged


def content_hash(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn("content_hash", F.sha2(F.coalesce(column, F.lit("")).cast("binary"), 256))


def dedupe(samples: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """content_hash, doc_id (the first), copies for each new text; existing (content_hash) holds those known before."""
    hashed = content_hash(samples).groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    return hashed if existing is None else hashed.join(existing, "content_hash", "left_anti")


def kth_smallest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th smallest of a whole-number column, by counts in ever narrower ranges: a few scans of one column, no
    sort and no task that sees all rows."""
    c = F.col(column)
    low, high, n = df.agg(F.min(c).cast("long"), F.max(c).cast("long"), F.count(c)).first()
    if not n or k < 1:
        return None
    k = min(k, n)
    while low < high:
        width = max(1, -(-(high - low + 1) // 255))
        # whole numbers throughout, and no difference that could leave 64 bits; as Python's //
        bucket = F.expr(f"`{column}` div {width} - if(`{column}` % {width} < 0, 1, 0)")
        found = df.where(c.between(low, high)).groupBy(bucket.alias("b")).count().collect()
        for b, m in sorted((r["b"], r["count"]) for r in found):
            if k <= m:
                low, high = max(low, b * width), min(high, (b + 1) * width - 1)
                break
            k -= m
    return low


def _tie(samples: DataFrame) -> Column:
    """A number of what is in a row, between 0 and 2**62."""
    plain = [f.name for f in samples.schema if not isinstance(f.dataType, T.MapType)]
    return F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), 2)


def holdout_split(samples: DataFrame, ratio: float, *, at_most_half: bool = False) -> DataFrame:
    """samples with held_out, which is never null: the first rows by doc_id, the ratio of them rounded up, one at least.
    Rows without doc_id come last; rows that share one go by a hash of what is in them, so that only rows that are equal
    throughout can be held out beyond the ratio, since they go together."""
    n, known = samples.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    k = int(min(max(1, -(-n * ratio // 1)), n // 2 if at_most_half and n > 1 else n))
    if not k or not n:
        return samples.withColumn("held_out", F.lit(False))
    tied = samples.withColumn("_tie", _tie(samples))
    if k > known:
        last = kth_smallest(tied.where("doc_id is null"), "_tie", k - known)
        held = F.col("doc_id").isNotNull() | (F.col("_tie") <= last)
        return tied.withColumn("held_out", held).drop("_tie")
    edge = kth_smallest(samples, "doc_id", k)
    below, at = samples.agg(F.count_if(F.col("doc_id") < edge), F.count_if(F.col("doc_id") == edge)).first()
    if below + at == k:
        return samples.withColumn("held_out", F.coalesce(F.col("doc_id") <= edge, F.lit(False)))
    last = kth_smallest(tied.where(F.col("doc_id") == edge), "_tie", k - below)
    held = (F.col("doc_id") < edge) | ((F.col("doc_id") == edge) & (F.col("_tie") <= last))
    return tied.withColumn("held_out", F.coalesce(held, F.lit(False))).drop("_tie")


def report(samples: DataFrame, tag: str = "lang") -> DataFrame:
    """context, samples, words."""
    words = K.unicode_word_count(F.col("text"))
    return samples.groupBy(F.coalesce(F.col(tag), F.lit("none")).alias("context")).agg(
        F.count(F.lit(1)).alias("samples"), F.sum(words).alias("words")
    )


def chunk_text(text: str, max_words: int, paragraph: str = "\n\n") -> list[str]:
    """Paragraphs packed up to max_words. A new chunk starts with the last paragraphs of the one before, about a fifth
    of max_words; a last chunk under five words goes. Texts of at most max_words stay whole."""
    if len(text.split()) <= max_words:
        return [text]
    out: list[str] = []
    own: list[str] = []  # paragraphs of the chunk
    recent: list[tuple[str, int]] = []
    size = 0
    for part in filter(None, (p.strip() for p in text.split(paragraph))):
        n = len(part.split())
        if own and size + n > max_words:
            out.append(paragraph.join(own))
            own, size = [p for p, _ in recent], sum(m for _, m in recent)
            recent = []
        own.append(part)
        size += n
        recent.append((part, n))
        if len(recent) > 1 and sum(m for _, m in recent) > max_words // 5:
            recent.pop(0)
    if size >= 5:
        out.append(paragraph.join(own))
    return out


def chunk(samples: DataFrame, max_words: int, *, paragraph: str = "\n\n", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns to keep, chunk_index, text. Packing is a fold over the paragraphs of one text, done in Arrow batches."""
    fields = [samples.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("chunk_index", T.LongType()), T.StructField("text", T.StringType())])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, texts = [], [], []
            for row, text in enumerate(batch.column(n).to_pylist()):
                for i, part in enumerate(chunk_text(text or "", max_words, paragraph)):
                    rows.append(row)
                    places.append(i)
                    texts.append(part)
            at = pa.array(rows, pa.int64())
            kept = [batch.column(i).take(at) for i in range(n)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(places, pa.int64()), pa.array(texts, pa.string())], [*keep, "chunk_index", "text"])

    return samples.select(*keep, "text").mapInArrow(run, schema)


def ingest(samples: DataFrame, *, max_words: int, existing: DataFrame | None = None, cleaned: bool = True, paragraph: str = "\n\n") -> tuple[DataFrame, DataFrame]:
    """The whole way of new samples (doc_id, text, context_tag): cleaned, those known before or earlier left out, cut into
    chunks. Gives the chunks (doc_id, context_tag, chunk_index, text) and a report: a row for each context (samples,
    skipped, chunks, words), and one for all with context null.

    Each row is a sample of its own, whatever ids repeat or are missing. Of rows with equal texts the one with the
    smallest doc_id stays (one without only where none has one), then that with the smallest tag; its chunks carry its
    own tag. A null tag is reported as `none`, together with a tag of that name; a null text is an empty one."""
    text = F.coalesce(clean.clean(F.col("text")) if cleaned else F.col("text"), F.lit(""))
    rows = content_hash(staged(samples.select("doc_id", "context_tag", text.alias("text")), "ingest-samples"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("context_tag").isNull().alias("no_tag"), "context_tag")
    first = rows.groupBy("content_hash").agg(F.min(order).alias("first")).select("content_hash", "first.doc_id", "first.context_tag")
    if existing is not None:
        first = first.join(existing.select("content_hash"), "content_hash", "left_anti")
    own = F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & F.col("r.context_tag").eqNullSafe(F.col("f.context_tag"))
    kept = rows.alias("r").join(first.alias("f"), (F.col("r.content_hash") == F.col("f.content_hash")) & own, "left_semi")
    kept = staged(kept.dropDuplicates(["content_hash"]), "ingest-kept")  # equal throughout, so any of them
    chunks = staged(chunk(kept, max_words, paragraph=paragraph, keep=("doc_id", "context_tag")), "ingest-chunks")
    context, one = F.coalesce("context_tag", F.lit("none")).alias("context"), F.lit(1)
    none = F.lit(0)
    counted = (
        rows.select(context, one.alias("read"), none.alias("samples"), none.alias("chunks"), none.alias("words"))
        .unionByName(kept.select(context, none.alias("read"), one.alias("samples"), none.alias("chunks"), none.alias("words")))
        .unionByName(chunks.select(context, none.alias("read"), none.alias("samples"), one.alias("chunks"), K.unicode_word_count(F.col("text")).alias("words")))
    )
    sums = counted.groupBy("context").agg(*[F.sum(c).alias(c) for c in ("read", "samples", "chunks", "words")])
    numbers = ("samples", "skipped", "chunks", "words")
    report = staged(sums.withColumn("skipped", F.col("read") - F.col("samples")).select("context", *numbers), "ingest-report")
    total = report.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numbers]).select(F.lit(None).cast("string").alias("context"), *numbers)
    return chunks, report.unionByName(total)


def training_rows(samples: DataFrame, style: str = "chat", *, instruction: str = "Write in the author's style.") -> DataFrame:
    """doc_id and JSON rows for training: chat messages, prompt and completion, or plain text; samples of 20 words at
    least."""
    rows = samples.where(K.unicode_word_count(F.col("text")) >= 20)
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    made = {
        "chat": F.struct(F.array(message("user", F.lit(instruction)), message("assistant", F.col("text"))).alias("messages")),
        "completions": F.struct(F.lit(instruction).alias("prompt"), F.col("text").alias("completion")),
        "text": F.struct(F.col("text").alias("text")),
    }[style]
    return rows.select("doc_id", F.to_json(made).alias("row"))


def profile_info(samples: DataFrame, key: str) -> DataFrame:
    """k, files, words, chars, mean and deviation of sentence lengths (parts between end marks), vocabulary."""
    from .features import rounded

    t = F.col("text")
    rows = samples.select(F.col(key).alias("k"), t).where("text is not null")
    lengths = rows.select("k", K.plain_word_count(t).alias("w"), F.length(t).alias("c"), F.transform(K.split_sentences_plain(t), K.plain_word_count).alias("s"))
    each = lambda f: F.aggregate("s", F.lit(0).cast("long"), f)
    sums = lengths.groupBy("k").agg(
        F.count(F.lit(1)).alias("files"), F.sum("w").alias("words"), F.sum("c").alias("chars"), F.sum(F.size("s")).alias("n"),
        F.sum(each(lambda a, x: a + x)).alias("total"), F.sum(each(lambda a, x: a + x.cast("long") * x)).alias("squares"),
    )
    vocabulary = rows.select("k", F.explode(K.letter_words(t)).alias("w")).distinct().groupBy("k").agg(F.count(F.lit(1)).alias("vocabulary"))
    n, s, q = F.col("n"), F.col("total"), F.col("squares")
    return sums.join(vocabulary, "k", "left").select(
        "k", "files", "words", "chars",
        rounded(F.when(n > 0, s / n).otherwise(0.0)).alias("sentence_mean"),
        rounded(F.when(n > 0, F.sqrt((n * q - s * s) / (n.cast("double") * n))).otherwise(0.0)).alias("sentence_sd"),
        F.coalesce("vocabulary", F.lit(0)).alias("vocabulary"),
    )
