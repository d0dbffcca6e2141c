"""Windows across the borders of texts, for a corpus that is read as one text with an empty line between texts.

Texts stay where they are, and so do the windows inside them. Of each text only its edges (a few characters or words) are
sorted by key and place, and each row looks at the rows after it. Rows are numbered through all range partitions and
dealt to blocks of equal size by number, each with the first rows of the next block beside its own, so that a key that
holds all rows is no larger task than any other, and empty partitions don't matter.

Null texts are not there. Texts of one place are ordered by their hash, then by their edges; what is left are rows with
equal edges, whose order changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tokens as K
from ..stage import discard, staged

#: Edges of a block; some 100 bytes each.
BLOCK = 100_000
#: monotonically_increasing_id counts the rows of a partition in as many bits.
_BITS = 33


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with `at`, their number from 0 in that order over the whole table."""
    once = staged(rows, "edges")  # ranges are drawn from a sample, which would read the texts once more
    sorted_rows = once.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = staged(sorted_rows.withColumn("_id", F.monotonically_increasing_id()), "edges-sorted")
    discard(once)
    part = F.shiftrightunsigned("_id", _BITS)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row for each range partition, so one task may hold them and they may be broadcast
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    out = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.withColumn("at", F.col("_start") + F.col("_id").bitwiseAND((1 << _BITS) - 1)).drop("_part", "_id", "_start")


def followed(edges: DataFrame, size: int, *, block: int = BLOCK) -> DataFrame:
    """edges (k, row, hash, head, tail) with `after`: the heads of the next `size` rows of the same key, in order. Rows that
    nothing follows are left out."""
    rows = numbered(edges, ["k", "row", "hash", "head", "tail"])
    own = F.floor(F.col("at") / block)
    also = F.when((F.col("at") % block < size) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = rows.withColumn("block", F.explode(also))
    window = Window.partitionBy("block", "k").orderBy("at").rowsBetween(1, size)
    seen = dealt.withColumn("after", F.collect_list("head").over(window))
    return seen.where((F.col("block") == own) & (F.size("after") > 0)).select("k", "tail", "after")


def _edges(texts: DataFrame, order: str, head: Column, tail: Column) -> DataFrame:
    rows = texts.where("text is not null")
    return rows.select("k", F.col(order).alias("row"), F.xxhash64("text").alias("hash"), head.alias("head"), tail.alias("tail"))


def trigrams(texts: DataFrame, order: str, *, block: int = BLOCK) -> DataFrame:
    """k, gram, n: the runs of three characters that no single text of (k, order, text) holds, in map-side sums."""
    low = F.lower("text")
    found = followed(_edges(texts, order, F.left(low, F.lit(2)), F.right(low, F.lit(2))), 2, block=block)
    line = F.concat("tail", F.lit("\n\n"), F.left(F.array_join("after", "\n\n"), F.lit(2)))
    rows = found.select("k", line.alias("line")).groupBy("k", "line").agg(F.count(F.lit(1)).alias("n")).where("length(line) > 2")
    place = F.explode(F.sequence(F.lit(1), F.length("line") - 2)).alias("i")
    return rows.select("k", "line", "n", place).select("k", F.substring("line", F.col("i"), F.lit(3)).alias("gram"), "n")


def words(texts: DataFrame, order: str, size: int, *, block: int = BLOCK) -> DataFrame:
    """k, words, edge: the plain words around each border that windows of up to `size` words can take, the first `edge` of
    them from the text before it. Texts without words are passed over. `size` words are looked at before the border, since a
    window's neighbour may matter, and `size` - 1 after it."""
    split = texts.where("text is not null").withColumn("_words", K.plain_words(F.col("text"))).where("size(_words) > 0")
    n = F.least(F.size("_words"), F.lit(size))
    edges = _edges(split, order, F.slice("_words", 1, size - 1), F.slice("_words", -n, n))
    found = followed(edges, size - 1, block=block)
    around = F.concat("tail", F.slice(F.flatten("after"), 1, size - 1))
    return found.select("k", around.alias("words"), F.size("tail").alias("edge"))
