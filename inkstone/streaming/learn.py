"""Learning as files arrive: new samples are cleaned, held against what is known, and their counts added.

Which texts are known is state of the stream, kept by content hash: a batch looks up its own texts only, not all that came
before. Of equal texts in one batch the smallest author counts, so nothing depends on the order in which rows arrive.
What a batch adds is written to the store before anything is counted; its tables rest on that, and a last small table says
that the batch is complete. Readers take complete batches only. A batch that is run again, after a failure or a lost
executor, finds the state as it was before it and writes the same tables under the same number.

Counts of words and trigrams by author add up; what doesn't (the most frequent trigrams, medians) is taken from the
summed counts when a style is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import clean
from ..operators import features as ft
from ..operators.corpus import content_hash

SCHEMA = "author string, text string"
NEW = "content_hash string, author string, text string"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def unseen(rows: DataFrame) -> DataFrame:
    """Of texts (author, text): content_hash, author, text and `new`. A text that comes for the first time gives one row
    that is new, without author, and each of its authors a row without text. What is kept by key is hashes and authors,
    by Spark's own state; null texts are left out."""
    cleaned = content_hash(rows.where("text is not null").withColumn("text", clean.clean(F.col("text"))))
    none = F.lit(None).cast("string")
    text = F.struct(none.alias("author"), F.col("text"), F.lit(True).alias("new"))
    author = F.struct(F.col("author"), none.alias("text"), F.lit(False).alias("new"))
    both = cleaned.select("content_hash", F.explode(F.array(text, author)).alias("r")).select("content_hash", "r.*")
    return both.dropDuplicates(["content_hash", "author", "new"])


def absorb(batch: DataFrame, number: int, store: str) -> None:
    """Adds the new texts of one batch (see `unseen`) to the store, each under its smallest author. An author that an old text
    gets has no new row beside it, and is left out."""
    spark = batch.sparkSession
    own = lambda name: f"{store}/{name}/batch={number}"
    texts = batch.groupBy("content_hash").agg(F.min("author").alias("author"), F.max("text").alias("text"), F.max("new").alias("new"))
    texts.where("new").select("content_hash", "author", "text").write.mode("overwrite").parquet(own("texts"))
    new = spark.read.schema(NEW).parquet(own("texts"))
    texts = new.select(F.col("author").alias("k"), "text")
    for name, table in {"words": ft.word_counts(texts), "sums": ft.sums(texts), "trigrams": ft.trigrams(texts)}.items():
        table.write.mode("overwrite").parquet(own(name))
    new.agg(F.count(F.lit(1)).alias("samples")).write.mode("overwrite").parquet(own("complete"))


def learn(spark: SparkSession, source: str, store: str, *, files_a_batch: int = 1000) -> StreamingQuery:
    """Reads JSON lines (author, text) as they arrive below source; call processAllAvailable() or awaitTermination()."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).json(source)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, _ROCKS)  # state on disk, as there is a row for each text ever seen
    try:
        out = unseen(rows).writeStream.foreachBatch(lambda b, n: absorb(b, n, store)).outputMode("append")
        return out.option("checkpointLocation", f"{store}/progress").trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)


def stored(spark: SparkSession, store: str, name: str) -> DataFrame:
    """A table of the store (texts, words, sums or trigrams), of complete batches."""
    done = spark.read.parquet(f"{store}/complete").select("batch")  # a row for each batch
    return spark.read.parquet(f"{store}/{name}").join(F.broadcast(done), "batch", "left_semi").drop("batch")


def word_counts(spark: SparkSession, store: str) -> DataFrame:
    return stored(spark, store, "words").groupBy("k", "word").agg(F.sum("n").alias("n"))


def sums(spark: SparkSession, store: str) -> DataFrame:
    return stored(spark, store, "sums").groupBy("k").agg(*[F.sum(c).alias(c) for c in ft.SUMS])


def trigrams(spark: SparkSession, store: str) -> DataFrame:
    return ft.top_trigrams(stored(spark, store, "trigrams").groupBy("k", "gram").agg(F.sum("n").alias("n")))
