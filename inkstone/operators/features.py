"""Style features of texts, summed by a key: a document, an author, or a whole corpus.

Texts stay where they are: each row gives its counts, which are summed on the map side; only (key, word) and
(key, trigram) counts shuffle beside them. All sums are whole numbers and are divided last, so that results don't depend
on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import tokens as K
from ..functions.constants import BANNED_WORDS, FUNCTION_WORDS, HISTOGRAM_EDGES
from . import borders, frequent, textpass
from .sentences import bind

DIGITS = 6


def rounded(x: Column) -> Column:
    return F.round(x, DIGITS)


def ratio(a: Column, b: Column, other: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(other))


def punctuation_counts(text: Column) -> dict[str, Column]:
    triple, double = K.count_of(text, "---"), K.count_of(text, "--")
    one = lambda *marks: reduce(lambda a, b: a + b, [K.count_of(text, m) for m in marks])
    return {
        "em_dash": one("—") + triple,
        "en_dash": one("–") + F.greatest(double - triple, F.lit(0)),
        "semicolon": one(";"),
        "colon": one(":"),
        "exclamation": one("!"),
        "question": one("?"),
        "paren": one("(", ")"),
    }


MARKS = ["em_dash", "en_dash", "semicolon", "colon", "exclamation", "question", "paren"]


SUMS = [
    "n_words", "n_chars", "n_letters", "n_syllables", "n_sentences", "n_lengths", "sum_lengths", "sum_squares",
    *[f"bin{i}" for i in range(len(HISTOGRAM_EDGES))], *MARKS,
]

def _texts(df: DataFrame) -> DataFrame:
    return df.select("k", F.coalesce("text", F.lit("")).alias("text"))


def row_counts(texts: DataFrame) -> DataFrame:
    """texts (k, text) with the counts of each row; null texts are empty."""
    schema = T.StructType([texts.schema["k"], *(T.StructField(c, T.LongType()) for c in SUMS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in textpass.parts(batch, 1)):
            counts = textpass.counted(textpass.Words(part.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in counts.T)], schema.names)

    return _texts(texts).mapInArrow(run, schema)


def _keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row's key, and the first row of each."""
    names: dict[str, int] = {}
    number = np.array([names.setdefault(repr(k), len(names)) for k in column.to_pylist()], np.int64)
    return number, np.unique(number, return_index=True)[1]


def word_rows(words: textpass.Words, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Keys, the places of lower-cased words among the names that follow, and counts; key: the number of each text's key."""
    coded = words.lowered().dictionary_encode()
    size = max(len(coded.dictionary), 1)
    owner = np.repeat(key, np.diff(words.first))
    found, n = np.unique(owner * size + np.asarray(coded.indices).astype(np.int64), return_counts=True)
    return found // size, found % size, coded.dictionary, n


def _term_rows(texts: DataFrame, name: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[list[pa.Array]]]) -> DataFrame:
    """k, a term by that name, n, yet to be summed. Terms are counted in arrays before they leave a task: a text has as many
    trigrams as characters, and sending each as a row costs ten times as much."""
    schema = T.StructType([texts.schema["k"], T.StructField(name, T.StringType()), T.StructField("n", T.LongType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in run(batches):
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return _texts(texts).mapInArrow(rows, schema)


#: Bytes of text that are counted at once; what is made of a byte takes some 30.
PART = 2 << 20


def _word_run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    for batch in batches:
        for part in textpass.parts(batch, 1, batch.num_rows, PART):
            key, first = _keys(part.column(0))
            keys, places, names, n = word_rows(textpass.Words(part.column(1).to_pylist()), key)
            yield [part.column(0).take(pa.array(first[keys])), names.take(pa.array(places)), pa.array(n, pa.int64())]


def _gram_run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    for keys, grams, n in frequent.counted(batches):
        yield [keys, pa.array(grams, pa.string()), pa.array(n)]


def sums(texts: DataFrame) -> DataFrame:
    return row_counts(texts).groupBy("k").agg(*[F.sum(c).alias(c) for c in SUMS])


def word_counts(texts: DataFrame) -> DataFrame:
    """k, word (lower-cased), n."""
    rows = _term_rows(texts, "word", _word_run)
    return rows.groupBy("k", "word").agg(F.sum("n").alias("n"))


#: What a row of `counts` counts: one of SUMS, a word, a trigram.
SUM, WORD, GRAM = 0, 1, 2
#: Keys, and words, that a task holds before it sends their counts; trigrams have `frequent.HELD`.
KEYS, HELD = 20_000, 500_000


class _Counts:
    """Counts of the texts of a task by key: sums, words and trigrams, each text cut into words once."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.values: list = []
        self.sums: list[np.ndarray] = []
        self.parts: list[pa.Table] = []
        self.came = self.left = 0
        self.grams = frequent._Sums()

    def add(self, part: pa.RecordBatch) -> None:
        key, first = _keys(part.column(0))
        words = textpass.Words(part.column(1).to_pylist())
        sums = np.zeros((len(first), len(SUMS)), np.int64)
        np.add.at(sums, key, textpass.counted(words))
        number = np.zeros(len(first), np.int64)
        for i, value in enumerate(part.column(0).take(pa.array(first)).to_pylist()):
            at = number[i] = self.numbers.setdefault(repr(value), len(self.numbers))
            if at == len(self.values):
                self.values.append(value)
                self.sums.append(sums[i])
            else:
                self.sums[at] = self.sums[at] + sums[i]
        keys, places, names, n = word_rows(words, key)
        self.parts.append(pa.table([pa.array(number[keys]), names.take(pa.array(places)), pa.array(n, pa.int64())], ["key", "word", "n"]))
        self.came += len(n)
        self.grams.add_texts(part)

    def _words(self) -> pa.Table:
        if len(self.parts) > 1:
            self.parts = [pa.concat_tables(self.parts).group_by(["key", "word"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["key", "word", "n"])]
        return self.parts[0]

    def full(self, held: int) -> bool:
        if self.came > max(2 * self.left, 200_000):
            self.came = self.left = self._words().num_rows
        return self.grams.join() > 2 * held or self.came > held or len(self.values) > KEYS

    def rows(self, kind: pa.DataType, sent: int) -> Iterator[tuple[pa.Array, int, pa.Array, pa.Array]]:
        """Keys, what is counted, terms, counts: `sent` at once."""
        if not self.values:
            return
        values, m = pa.array(self.values, kind), len(SUMS)
        for at in range(0, len(self.sums), max(sent // m, 1)):
            some = np.array(self.sums[at : at + max(sent // m, 1)])
            yield values.take(pa.array(np.repeat(np.arange(at, at + len(some)), m))), SUM, pa.array(SUMS * len(some), pa.string()), pa.array(some.ravel())
        for b in self._words().to_batches(max_chunksize=sent):
            yield values.take(b.column(0)), WORD, b.column(1), b.column(2)
        values = pa.array(self.grams.values, kind)
        for place, found, n in self.grams.every(sent):
            yield values.take(pa.array(place)), GRAM, pa.array(frequent.spelled(found), pa.string()), pa.array(n)


def counts(texts: DataFrame, *, order: str | None = None, held: int = HELD) -> DataFrame:
    """k, kind (SUM, WORD, GRAM), term, n: what `sums`, `word_counts` and `trigrams` give, from one pass over the texts. A
    task adds up as long as there are at most `held` words and twice as many trigrams."""
    fields = [T.StructField("kind", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("n", T.LongType())]
    schema = T.StructType([texts.schema["k"], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kind = _Counts(), None

        def out() -> Iterator[pa.RecordBatch]:
            for keys, what, terms, n in own.rows(kind, 50_000):
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(len(n), what, np.int32)), terms, n], schema.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for part in textpass.parts(batch, 1, batch.num_rows):
                own.add(part)
                if own.full(held):
                    yield from out()
                    own = _Counts()
        yield from out()

    rows = _texts(texts).mapInArrow(run, schema)
    if order:
        rows = rows.unionByName(borders.trigrams(texts, order).select("k", F.lit(GRAM).alias("kind"), F.col("gram").alias("term"), "n"))
    return rows.groupBy("k", "kind", "term").agg(F.sum("n").alias("n"))


def richness(words: DataFrame) -> DataFrame:
    """From word counts: type-token ratio, Yule's K, shares of words used once and twice, Simpson's index."""
    n = F.col("n")
    got = words.groupBy("k").agg(
        F.sum(n).alias("tokens"),
        F.count(F.lit(1)).alias("types"),
        F.sum(n * n).alias("squares"),
        F.count_if(n == 1).alias("once"),
        F.count_if(n == 2).alias("twice"),
    )
    return got.select("k", "tokens", "types", *richness_columns())


def richness_columns() -> list[Column]:
    """Of tokens, types, squares (of the words' counts), once and twice (words with that count)."""
    t, v, sq = F.col("tokens"), F.col("types"), F.col("squares")
    return [
        rounded(F.when(v > 0, v / t)).alias("ttr"),
        rounded(F.when(t > 1, 10000.0 * (sq - t) / (t.cast("double") * t)).otherwise(0.0)).alias("yule_k"),
        rounded(F.when(v > 0, F.col("once") / v)).alias("hapax"),
        rounded(F.when(v > 0, F.col("twice") / v)).alias("dis"),
        rounded(F.when(t > 1, 1.0 - (sq - t) / (t.cast("double") * (t - 1))).otherwise(0.0)).alias("simpson"),
    ]


def function_words(words: DataFrame) -> DataFrame:
    """k, word, n, freq for the function words that occur."""
    total = words.groupBy("k").agg(F.sum("n").alias("total"))
    found = words.where(F.col("word").isin(sorted(set(FUNCTION_WORDS))))
    return found.join(total, "k").select("k", "word", "n", rounded(F.col("n") / F.col("total")).alias("freq"))


def vocabulary(words: DataFrame) -> DataFrame:
    """k, vocabulary_size, banned (banned words never used, sorted), preferred (frequent longer words, sorted)."""
    total = words.groupBy("k").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("vocabulary_size"))
    rows = words.where(F.col("word").isin(BANNED_WORDS) | ((F.col("n") > 3) & (F.octet_length("word") > 4))).join(total, "k", "right")
    used = F.collect_set(F.when(F.col("word").isin(BANNED_WORDS), F.col("word")))
    preferred = (F.col("n") > 3) & (F.octet_length("word") > 4) & (F.col("n") / F.col("total") > 0.001)
    banned = F.array(*[F.lit(w) for w in BANNED_WORDS])
    return rows.groupBy("k", "vocabulary_size").agg(
        F.array_sort(F.array_except(banned, used)).alias("banned"),
        F.array_sort(F.collect_list(F.when(preferred, F.col("word")))).alias("preferred"),
    )


def trigrams(texts: DataFrame, *, order: str | None = None) -> DataFrame:
    """k, gram, n: runs of three characters of the lower-cased texts. With `order` (a column) a key's texts are one text in
    that order, an empty line between them, and runs cross from one to the next."""
    rows = _term_rows(texts, "gram", _gram_run)
    if order:
        rows = rows.unionByName(borders.trigrams(texts, order))
    return rows.groupBy("k", "gram").agg(F.sum("n").alias("n"))


def top_trigrams(grams: DataFrame, limit: int = 500) -> DataFrame:
    """The most frequent of each key, ties by the trigram; rank is limited before rows are gathered by key. Of texts that need
    no other counts, `frequent.top_trigrams` gives the same with less to shuffle."""
    order = Window.partitionBy("k").orderBy(F.desc("n"), F.asc("gram"))
    return grams.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def punctuation_columns() -> list[Column]:
    """Marks by 1000 words."""
    return [rounded(ratio(F.col(m) * 1000.0, F.col("n_words"))).alias(m) for m in MARKS]


def readability_columns() -> list[Column]:
    w, s, c, y = (F.col(x) for x in ("n_words", "n_sentences", "n_letters", "n_syllables"))
    has = (w > 0) & (s > 0)
    measure = lambda x: rounded(F.when(has, x).otherwise(0.0))
    return [
        measure(0.39 * (w / s) + 11.8 * (y / w) - 15.59).alias("flesch_kincaid"),
        measure(0.0588 * (c * 100.0 / w) - 0.296 * (s * 100.0 / w) - 15.8).alias("coleman_liau"),
        measure(4.71 * (c / w) + 0.5 * (w / s) - 21.43).alias("ari"),
        measure(y / w).alias("avg_syllables"),
    ]


def shape_columns() -> list[Column]:
    """Mean and deviation of sentence lengths, and the histogram as shares."""
    n, total, squares = F.col("n_lengths"), F.col("sum_lengths"), F.col("sum_squares")
    bins = [rounded(ratio(F.col(f"bin{i}"), n)) for i in range(len(HISTOGRAM_EDGES))]
    variance = (n * squares - total * total) / (n.cast("double") * n)
    return [
        rounded(ratio(total, n)).alias("mean"),
        rounded(F.when(n > 0, F.sqrt(F.greatest(variance, F.lit(0.0)))).otherwise(0.0)).alias("sd"),
        F.array(*bins).alias("histogram"),
    ]


def punctuation(sums: DataFrame) -> DataFrame:
    return sums.select("k", *punctuation_columns())


def readability(sums: DataFrame) -> DataFrame:
    return sums.select("k", *readability_columns())


def sentence_shape(sums: DataFrame) -> DataFrame:
    return sums.select("k", *shape_columns())


def length_stats(values: DataFrame) -> DataFrame:
    """k, mean, sd (of the population), median (upper) and p95 of values (k, n); from counts of each value, so that a
    key's values never meet in one place."""
    return _stats(values.groupBy("k", "n").agg(F.count(F.lit(1)).alias("c")))


def _stats(counted: DataFrame) -> DataFrame:
    """Of counts of each value: k, n, c."""
    total = counted.groupBy("k").agg(
        F.sum("c").alias("total"), F.sum(F.col("n") * F.col("c")).alias("s"), F.sum(F.col("n") * F.col("n") * F.col("c")).alias("q")
    )
    # distinct lengths of a key are few
    upto = F.sum("c").over(Window.partitionBy("k").orderBy("n"))
    placed = counted.withColumn("upto", upto).join(total, "k")
    at = lambda p: F.min(F.when(F.col("upto") > p, F.col("n")))
    got = placed.groupBy("k", "total", "s", "q").agg(
        at(F.floor(F.col("total") / 2)).alias("median"),
        at(F.least(F.floor(F.col("total") * 95 / 100), F.col("total") - 1)).alias("p95"),
    )
    n, s, q = F.col("total"), F.col("s"), F.col("q")
    return got.select(
        "k", rounded(s / n).alias("mean"), rounded(F.sqrt((n * q - s * s) / (n.cast("double") * n))).alias("sd"), "median", "p95"
    )


KINDS = ("word", "sentence", "paragraph")


def lengths(texts: DataFrame) -> DataFrame:
    """k, kind (word, sentence, paragraph), n, c, yet to be summed: how many have that length, words in characters, sentences
    and paragraphs in words; those without a word are left out."""
    fields = [T.StructField("kind", T.StringType()), T.StructField("n", T.LongType()), T.StructField("c", T.LongType())]
    schema, size = T.StructType([texts.schema["k"], *fields]), np.int64(1) << 40

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in textpass.parts(batch, 1, batch.num_rows)):
            key, first = _keys(part.column(0))
            words = textpass.Words(part.column(1).to_pylist())
            values = [np.repeat(key, np.diff(words.first)) * 3 * size + words.ends - words.starts]
            for i, k in enumerate(key.tolist()):
                values += [(k * 3 + 1) * size + textpass.sentence_lengths(words, i)[1], (k * 3 + 2) * size + textpass.paragraph_lengths(words, i)]
            found, c = np.unique(np.concatenate(values), return_counts=True)
            some = found % size > 0
            found, c = found[some], c[some]
            own = part.column(0).take(pa.array(first[found // size // 3]))
            kinds = pa.array(KINDS).take(pa.array(found // size % 3))
            yield pa.RecordBatch.from_arrays([own, kinds, pa.array(found % size), pa.array(c)], schema.names)

    return _texts(texts).mapInArrow(run, schema)


def length_table(texts: DataFrame) -> DataFrame:
    """k, kind, mean, sd, median, p95."""
    counted = lengths(texts).groupBy(F.struct("k", "kind").alias("k"), "n").agg(F.sum("c").alias("c"))
    return _stats(counted).select("k.k", "k.kind", "mean", "sd", "median", "p95")


def repetition(text: Column) -> Column:
    """Share of runs of four plain words that occurred before in the text; 0 under 20 words."""
    return bind(
        K.plain_words(text),
        lambda w: F.when(F.size(w) < 20, 0.0).otherwise(
            bind(
                K.word_windows(w, 4),
                lambda g: (F.size(g) - F.size(F.array_distinct(g))) / F.size(g),
            )
        ),
    )
