"""Corpus lexicons: names and frequent words, merged; and how much of a lexicon leaks into outputs."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tokens as K
from ..functions.constants import LEXICON_STOPWORDS
from ..stage import staged
from . import borders, textpass
from .terms import Terms

_STOP = sorted(set(LEXICON_STOPWORDS))


#: Distinct terms that a task holds before it sends their counts.
HELD = 200_000


def _counted(texts: DataFrame, add: Callable[[Counter, list[str]], None]) -> DataFrame:
    """term, n: what add(counts, plain words) counts of each text, summed. Terms are counted before they leave a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            terms, n = list(counts), list(counts.values())
            for k in range(0, len(terms), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(terms[k : k + 50_000], pa.string()), pa.array(n[k : k + 50_000], pa.int64())], ["term", "n"])
            counts.clear()

        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    add(counts, textpass.plain_words(text.as_py()))
                    if len(counts) > HELD:
                        yield from out()
        yield from out()

    return texts.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


class _Trimmed(dict):
    """Of a plain word: its trimmed form if that begins with a capital, else an empty string; emptied at a bound."""

    def __missing__(self, word: str) -> str:
        if len(self) > HELD:
            self.clear()
        inside = [i for i, c in enumerate(word) if unicodedata.category(c)[0] in "LN"]
        name = word[inside[0] : inside[-1] + 1] if inside else ""
        found = self[word] = name if name and unicodedata.category(name[0]) == "Lu" else ""
        return found


def _name_counter() -> Callable[[Counter, list[str]], None]:
    trimmed, stop = _Trimmed(), frozenset(_STOP)

    def add(counts: Counter, words: list[str]) -> None:
        names = ["" if "a" <= w[0] <= "z" else trimmed[w] for w in words]
        last = len(names)
        for i in [i for i, name in enumerate(names) if name]:
            run = names[i]
            if i and len(run.encode()) >= 3 and words[i - 1][-1] not in ".!?" and run.lower() not in stop:
                counts[run] += 1
            for j in range(i + 1, min(i + 4, last)):
                if not names[j]:
                    break
                run += " " + names[j]
                counts[run] += 1  # never under three bytes

    return add


def _border_names(rows: DataFrame) -> DataFrame:
    """term: the names of `around` (plain words) that reach from the first `edge` of them to those behind."""
    rows = rows.withColumn("words", F.transform("around", K.trim_marks))
    # flags of capitals, so that runs are found by position
    rows = rows.withColumn("caps", F.transform("words", lambda w: w.rlike(r"^\p{Lu}")))
    edge, none = F.col("edge"), F.array().cast("array<string>")

    def run(size: int) -> Column:
        first, last = F.greatest(F.lit(1), edge - size + 2), F.least(F.size("words") - size + 1, edge)
        good = F.filter(F.sequence(first, last), lambda i: F.forall(F.slice("caps", i, size), lambda c: c))
        return F.when(first <= last, F.transform(good, lambda i: F.array_join(F.slice("words", i, size), " ")))

    single = F.filter(
        F.when(F.size("words") >= 2, F.array(edge + 1)),
        lambda i: F.element_at("caps", i)
        & (F.octet_length(F.element_at("words", i)) >= 3)
        & ~F.element_at("around", i - 1).rlike("[.!?]$")
        & ~F.lower(F.element_at("words", i)).isin(_STOP),
    )
    runs = F.filter(F.concat(*[F.coalesce(run(k), none) for k in (2, 3, 4)]), lambda t: F.octet_length(t) >= 3)
    singles = F.coalesce(F.transform(single, lambda i: F.element_at("words", i)), none)
    return rows.select(F.explode(F.concat(runs, singles)).alias("term"))


def entities(texts: DataFrame, *, min_count: int = 3, order: str | None = None) -> DataFrame:
    """term, n: runs of two to four capitalised words, and single ones that don't start a sentence and are no stop
    words. Runs stay within a text; with `order` (a column) the texts are one text in that order, and runs cross."""
    counted = _counted(texts, _name_counter())
    if order:
        rows = borders.words(texts.select(F.lit(0).alias("k"), F.col(order).alias("row"), "text"), "row", 4)
        more = rows.select(F.col("words").alias("around"), "edge").transform(_border_names)
        counted = counted.unionByName(more.select("term", F.lit(1).cast("long").alias("n")))
        counted = counted.groupBy("term").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


def frequent_words(texts: DataFrame, *, min_count: int = 3) -> DataFrame:
    """term, n, score: words by the logarithm of their frequency in 10,000, above 0.5."""
    words = staged(_counted(texts, Counter.update), "lexicon-words")
    total = words.agg(F.sum("n").alias("total"))  # one row
    terms = words.select(K.bare_word(F.col("term")).alias("term"), "n")
    good = (F.octet_length("term") >= 3) & ~F.col("term").isin(_STOP) & ~F.col("term").rlike(r"^\p{N}+$")
    counted = terms.where(good).groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    score = F.greatest(F.log(F.col("n") / F.col("total") * 10000.0), F.lit(0.0))
    return counted.crossJoin(F.broadcast(total)).select("term", "n", F.round(score, 6).alias("score")).where("score > 0.5")


def merge(names: DataFrame, words: DataFrame, *, max_terms: int = 200) -> DataFrame:
    """rank, term: names by count, then words by score, lower-cased, each once, the first max_terms."""
    both = names.select(F.lit(0).alias("kind"), F.lower("term").alias("term"), F.col("n").cast("double").alias("weight")).unionByName(
        words.select(F.lit(1).alias("kind"), F.lower("term").alias("term"), F.col("score").alias("weight"))
    )
    best = both.groupBy("term").agg(F.min(F.struct("kind", (-F.col("weight")).alias("w"))).alias("key"))
    top = best.orderBy("key.kind", "key.w", "term").limit(max_terms)
    order = Window.orderBy("key.kind", "key.w", "term")  # over max_terms rows
    return top.select(F.row_number().over(order).alias("rank"), "term")


def leakage(texts: DataFrame, lexicon: list[str]) -> DataFrame:
    """texts (prompt, output, ...) with checkable (how many terms the prompt lacks), leaked (those of them that the output
    has, in the lexicon's order) and leakage. Terms are whole words; the lexicon is a list that fits a task."""
    terms = Terms(lexicon)
    found = texts.withColumn("_asked", terms.whole(F.lower("prompt"))).withColumn("_said", terms.whole(F.lower("output")))
    rows = found.withColumn("leaked", F.array_except("_said", "_asked")).withColumn("checkable", F.lit(len(terms.terms)) - F.size("_asked"))
    share = F.when(F.col("checkable") > 0, F.size("leaked") / F.col("checkable")).otherwise(0.0)
    return rows.withColumn("leakage", F.round(share, 6)).drop("_asked", "_said")
