"""The most frequent trigrams of each key, exactly, where only what may be among them is shuffled.

A task counts its texts in arrays and writes the counts to the shared folder. Of each key it marks the `kept` most frequent
as sent, with a bound: the count of the first that was not. Sent counts are summed by key and trigram, which gives a count
from below for each, and from above by the bounds of the tasks that did not send it. The limit-th largest count from below
is a threshold. Trigrams that reach it only from above have their other counts looked up in what was written; trigrams that
no task sent can reach it only where the sum of all bounds does, and of such a key all counts are taken. So the result does
not depend on how texts are dealt to tasks, nor on `kept`; only the rows shuffled do."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..stage import discard, staged
from . import textpass

KEPT = 2000
#: Counts that a task holds before it writes them, 16 bytes each.
HELD = 1_000_000
#: Bytes of text that are counted at once.
PART = 2 << 20
#: Stands for the bound itself among the trigrams of a key.
BOUND = -1


def codes(text: str) -> np.ndarray:
    """All runs of three characters of the lower-cased text, as numbers that sort as they do."""
    c = np.frombuffer(text.lower().encode("utf-32-le"), "<u4").astype(np.int64)
    return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]


def spelled(found: np.ndarray) -> list[str]:
    """The trigrams of such numbers."""
    points = np.stack([found >> 42, (found >> 21) & 0x1FFFFF, found & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le")
    return [points[i : i + 3] for i in range(0, len(points), 3)]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    every, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    found, at = np.unique(every, return_inverse=True)
    return found, np.bincount(at, n).astype(np.int64)


class _Sums:
    """Counts by key: arrays of what came, joined when they have grown to twice what is left of them."""

    def __init__(self):
        self.keys: dict[str, int] = {}
        self.values: list = []
        self.parts: list[list[tuple[np.ndarray, np.ndarray]]] = []
        self.came = self.left = 0

    def add(self, key, found: np.ndarray) -> None:
        at = self.keys.setdefault(repr(key), len(self.keys))
        if at == len(self.parts):
            self.parts.append([])
            self.values.append(key)
        self.parts[at].append(np.unique(found, return_counts=True))
        self.came += len(self.parts[at][-1][0])

    def add_texts(self, part: pa.RecordBatch) -> None:
        """The trigrams of texts: keys and texts are the first columns."""
        by: dict[str, tuple] = {}
        for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            if len(text) > 1:  # lower case may be longer
                by.setdefault(repr(key), (key, []))[1].append(codes(text))
        for key, found in by.values():
            self.add(key, np.concatenate(found))

    def join(self) -> int:
        """How many counts there are, at most."""
        if self.came > max(2 * self.left, 100_000):
            for own in self.parts:
                own[:] = [_summed(own)]
            self.came = self.left = sum(len(own[0][0]) for own in self.parts)
        return self.came

    def every(self, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of keys, codes and counts, in arrays of some `least` counts, or of one key."""
        waiting, size = [], 0
        for i, own in enumerate(self.parts):
            found, n = _summed(own)
            waiting.append((np.full(len(n), i), found, n))
            size += len(n)
            if size > least or i == len(self.parts) - 1:
                place, found, n = (np.concatenate(x) for x in zip(*waiting, strict=True))
                for at in range(0, len(n), least):
                    yield place[at : at + least], found[at : at + least], n[at : at + least]
                waiting, size = [], 0

    def rows(self, kept: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Place of the key, codes, counts, bounds and whether each is sent."""
        for i, own in enumerate(self.parts):
            found, n = _summed(own)
            order = np.lexsort((found, -n))
            found, n = found[order], n[order]
            bound = int(n[kept]) if len(n) > kept else 0
            sent = np.arange(len(n)) < kept
            bounds = np.where(sent, bound, 0)
            if bound:
                found, n, bounds, sent = (np.append(x, y) for x, y in ((found, BOUND), (n, bound), (bounds, 0), (sent, True)))
            yield i, found, n, bounds, sent


def counted(batches: Iterator[pa.RecordBatch], *, held: int = HELD, sent: int = 50_000) -> Iterator[tuple[pa.Array, list[str], np.ndarray]]:
    """Keys, trigrams and counts of the texts of a task (keys and texts in the first columns), `sent` at once. They are added
    up as long as there are at most `held` of them, so that few leave the task where keys are few."""
    sums, kind = _Sums(), None

    def out() -> Iterator[tuple[pa.Array, list[str], np.ndarray]]:
        values = pa.array(sums.values, kind)
        for place, found, n in sums.every(sent):
            yield values.take(pa.array(place)), spelled(found), n

    for whole in batches:
        kind = whole.schema.field(0).type
        for part in textpass.parts(whole, 1, whole.num_rows, PART):
            sums.add_texts(part)
            if sums.join() > held:
                yield from out()
                sums = _Sums()
    yield from out()


def _counted(texts: DataFrame, kept: int, held: int) -> DataFrame:
    """k, code, n, bound, sent: what each task counts."""
    schema = T.StructType([texts.schema["k"], *(T.StructField(c, T.LongType()) for c in ("code", "n", "bound")), T.StructField("sent", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, arrow = _Sums(), None

        def out() -> Iterator[pa.RecordBatch]:
            waiting: list = []

            def batch() -> pa.RecordBatch:
                place, *rest = (np.concatenate(x) for x in zip(*waiting, strict=True))
                keys = pa.array(sums.values, arrow).take(pa.array(place))
                return pa.RecordBatch.from_arrays([keys, *map(pa.array, rest)], schema.names)

            size = 0
            for i, *columns in sums.rows(kept):
                waiting.append((np.full(len(columns[0]), i), *columns))
                size += len(columns[0])
                if size > 200_000:
                    yield batch()
                    waiting, size = [], 0
            if waiting:
                yield batch()

        for whole in batches:
            arrow = whole.schema.field(0).type
            for part in textpass.parts(whole, 1, whole.num_rows, PART):
                sums.add_texts(part)
                if sums.join() > held:
                    yield from out()
                    sums = _Sums()
        yield from out()

    return texts.select("k", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def _same(a: DataFrame, b: DataFrame, *names: str):
    condition = a["k"].eqNullSafe(b["k"])
    for name in names:
        condition &= a[name] == b[name]
    return condition


def top_trigrams(texts: DataFrame, limit: int = 500, *, kept: int = KEPT, held: int = HELD) -> DataFrame:
    """k, gram, n, rank of the `limit` most frequent trigrams of each key of texts (k, text), ties by the trigram. Null texts
    are empty, null keys are a key; texts of fewer than three characters have none."""
    kept = max(kept, limit)
    counted = staged(_counted(texts, kept, held), "trigrams-counted")
    sent = staged(counted.where("sent").groupBy("k", "code").agg(F.sum("n").alias("n"), F.sum("bound").alias("bound")), "trigrams-sent")
    below = sent.where(F.col("code") != BOUND)
    # keys of which some task has not sent all; of the others the counts are whole
    part = sent.where(F.col("code") == BOUND).select("k", F.col("n").alias("total"))
    order = lambda *ties: Window.partitionBy("k").orderBy(F.desc("n"), *ties)
    first = below.withColumn("rank", F.row_number().over(order("code"))).where(F.col("rank") <= limit)
    least = first.groupBy(F.col("k").alias("of")).agg(F.min("n").alias("least"))
    keys = part.join(least, part["k"].eqNullSafe(least["of"])).drop("of")
    whole = keys.where("total >= least").select("k", F.lit(BOUND).cast("long").alias("code"))
    some = keys.where("total < least").withColumnRenamed("k", "of")
    near = below.join(some, below["k"].eqNullSafe(some["of"])).where("bound < total and n + total - bound >= least")
    # staged, so that Spark knows the size, and sends a small one to every task
    asked = staged(near.select("k", "code").unionByName(whole), "trigrams-asked")
    rest, rows = counted.where("not sent").select("k", "code", "n"), below.select("k", "code", "n")
    one, all_of = asked.where(F.col("code") != BOUND), asked.where(F.col("code") == BOUND)
    for more in (rest.join(one, _same(rest, one, "code"), "left_semi"), rest.join(all_of, _same(rest, all_of), "left_semi")):
        rows = rows.unionByName(more)
    exact = rows.groupBy("k", "code").agg(F.sum("n").alias("n"))
    best = staged(exact.withColumn("rank", F.row_number().over(order("code"))).where(F.col("rank") <= limit), "trigrams-top")
    discard(counted, sent, asked)

    schema = T.StructType([best.schema["k"], T.StructField("gram", T.StringType()), best.schema["n"], best.schema["rank"]])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = pa.array(spelled(b.column(1).to_numpy()), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), grams, b.column(2), b.column(3)], schema.names)

    return best.select("k", "code", "n", "rank").mapInArrow(spell, schema)
