"""Hard negatives by distributed radix selection over integer scores.

Anchors are held against all rows in blocks: rows are packed into blocks of up to ROWS vectors, anchors into packs of some
ANCHORS, and each pair of a block and a pack is one cell, a product of two small matrices. What is wanted of a window
(an anchor's rows of its own label, or an anchor and positive's rows of other labels between two scores) is its k-th
best score. Each cell sends a histogram of the window's scores by their leading digit; the sums over all cells locate the
digit's bucket in which the k-th score lies, and the next round counts within that bucket alone, until a bucket is one
score. Then only rows that reach it are gathered. A cell's histogram leaves out buckets below its own k-th score, and a
cell gathers at most its k first rows of a window, so scores that tie by the thousand don't pile up: neither can hold or
precede the window's k-th row.

Scores are exact: whole numbers in single precision while no sum can leave 2**24 (by the norms), in double precision
up to 2**53, and as integers of any size beyond that, where scores outside of 2**56 count as 2**56.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part. A null vec_id is
no anchor's and comes last among ties. Each row is one of its own, so repeated rows are each other's positives; rows
that tie in score and vec_id are interchangeable. Vectors of unequal length are as if filled up with zeros. Anchors
without positives, and positives without a row in their window, give no row. Extra columns are ignored; empty tables
give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_schema, discard, record_batch, staged, tidy
from ..grid import cells, pack_of

#: Vectors of a block (and at most so many components), anchors of a pack on average, scores worked on at a time.
ROWS, COMPONENTS, ANCHORS, SCORES = 8192, 1 << 21, 4096, 1 << 22
#: Bits of a digit of the radix selection.
DIGIT = 10
#: Scores count as no more than this.
MOST = 1 << 56

BLOCK = "block long, n int, norm double, ids binary, labels binary, wide boolean, vectors binary"


def _vectors(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and their components times scale, rounded down, filled up with zeros."""
    valid = np.asarray(column.is_valid())
    sizes = np.where(valid, np.asarray(column.value_lengths().fill_null(0)), 0).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null is NaN
    row, ends = np.repeat(np.arange(len(column)), sizes), np.cumsum(sizes)
    fine = valid & (np.bincount(row[~np.isfinite(values)], minlength=len(column)) == 0)
    out = np.zeros((len(column), int(sizes.max(initial=0))))
    with np.errstate(over="ignore", invalid="ignore"):
        out[row, np.arange(len(values)) - np.repeat(ends - sizes, sizes)] = np.floor(values * scale)
    return fine, out


def _blocks(rows: DataFrame, scale: int) -> DataFrame:
    """The rows that take part in blocks sorted by label and vec_id. A row's uid is block + its place there."""
    target = arrow_schema(BLOCK)

    def packed(base: int, part: pa.RecordBatch) -> dict:
        fine, vectors = _vectors(part.column(2), scale)
        fine &= np.asarray(part.column(1).is_valid())
        none = np.asarray(part.column(0).is_null())
        ids, labels = (np.asarray(part.column(k).fill_null(0)).astype(np.int64) for k in (0, 1))
        order = np.lexsort((ids, none, labels))
        order = order[fine[order]]
        vectors, wide = vectors[order], bool((np.abs(vectors[order]) > 32767).any())
        norm = float(np.sqrt((vectors * vectors).sum(1).max(initial=0)))
        return {
            "block": [base], "n": [len(order)], "norm": [norm], "ids": [(np.stack([ids, none])[:, order]).tobytes()], "labels": [labels[order].tobytes()],
            "wide": [wide], "vectors": [vectors.astype(np.float64 if wide else np.int16).tobytes()],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        for part in _parts(batches):
            yield record_batch(packed(base, part), target)
            base += part.num_rows

    return rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").mapInArrow(tidy(run), BLOCK)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined or cut to up to ROWS rows whose longest vector, times the rows, gives up to COMPONENTS, or one row."""
    held: list[pa.RecordBatch] = []
    rows = longest = 0
    whole = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in batches:
        sizes = np.asarray(batch.column(2).value_lengths().fill_null(0))
        k = 0
        while k < batch.num_rows:
            upto = np.maximum(np.maximum.accumulate(sizes[k : k + ROWS - rows]), longest)
            n = int(np.searchsorted(upto * (rows + 1 + np.arange(len(upto))), COMPONENTS, "right"))
            if not n and rows:
                yield whole()
                held, rows, longest = [], 0, 0
                continue
            n = max(n, 1)
            held.append(batch.slice(k, n))
            rows, longest, k = rows + n, int(upto[n - 1]), k + n
            if rows >= ROWS:
                yield whole()
                held, rows, longest = [], 0, 0
    if rows:
        yield whole()


def _matrix(n: int, data: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(data, np.float64 if wide else np.int16).reshape(n, -1)


def _anchors(blocks: DataFrame, chosen: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """uid, anchor_id, label and vector (doubles) of the rows with a vec_id that is chosen."""
    schema = "uid long, anchor_id long, label long, vector binary"
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, none = np.frombuffer(r["ids"], np.int64).reshape(2, -1)
                at = np.flatnonzero(chosen(ids) & (none == 0))
                vectors = _matrix(r["n"], r["vectors"], r["wide"])[at].astype(np.float64)
                labels = np.frombuffer(r["labels"], np.int64)[at]
                yield record_batch({"uid": r["block"] + at, "anchor_id": ids[at], "label": labels, "vector": [v.tobytes() for v in vectors]}, target)

    return blocks.where("n > 0").mapInArrow(tidy(run), schema)


class _Cells:
    """All cells of blocks and packs, gone through once for each count or gathering."""

    def __init__(self, blocks: DataFrame, anchors: DataFrame, packs: int):
        n, norm = blocks.agg(F.count(F.lit(1)), F.max("norm")).first()
        self.slots = max(n, 1)
        # by Cauchy and Schwarz no sum of products of any components is larger
        self.bound = min(int((norm or 0.0) ** 2 * 1.001) + 1, MOST) if (norm or 0.0) < 2.0**64 else MOST
        self.blocks, self.n_packs = blocks.where("n > 0"), packs
        # some ANCHORS rows each, dealt by hash
        self.packs = anchors.groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("uid", "label", "vector"))).alias("anchors"))

    def through(self, windows: DataFrame, work: Callable, schema: str, *, same: bool) -> DataFrame:
        """work(scores of one anchor's rows, their places in the block, windows of the anchor, block) for all cells.
        windows (uid, pack, w, lo, hi, top, need)."""
        own = windows.groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("uid", "w", "lo", "hi", "top", "need"))).alias("windows"))
        sides = cells(self.blocks, self.packs.join(own, "pack"), slots=self.slots, n_packs=self.n_packs)
        target, small = arrow_schema(schema), self.bound

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    yield record_batch(_cell(batch.slice(k, 1), work, small, same, target.names), target)

        return sides.select("block", "n", "ids", "labels", "wide", "vectors", "anchors", "windows").mapInArrow(tidy(run), schema)


def _structs(column: pa.Array) -> dict:
    """The only row of a list of structs: its fields as arrays."""
    items = column.flatten()
    return {f.name: items.field(i) for i, f in enumerate(items.type)}


def _cell(row: pa.RecordBatch, work: Callable, bound: int, same: bool, names: list[str]) -> dict:
    block, n, ids, labels, wide, vectors = (row.column(k)[0].as_py() for k in range(6))
    rows, labels = _matrix(n, vectors, wide), np.frombuffer(labels, np.int64)
    ids = np.frombuffer(ids, np.int64).reshape(2, -1)
    anchors, windows = _structs(row.column(6)), _structs(row.column(7))
    uids, own = np.asarray(anchors["uid"]), np.asarray(anchors["label"])
    held = [np.frombuffer(v, np.float64) for v in anchors["vector"].to_pylist()]
    windows = {k: np.asarray(v) for k, v in windows.items()}
    first = np.searchsorted(windows["uid"], uids), np.searchsorted(windows["uid"], uids, "right")
    low, high = np.searchsorted(labels, own), np.searchsorted(labels, own, "right")
    there = np.arange(n)
    out: dict[str, list] = {name: [] for name in names}
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object
    rows = _exact(rows, kind).T
    step = max(1, SCORES // max(n, 1))
    # those that have a window, and with `same` a row of their label here
    used = np.flatnonzero((first[1] > first[0]) & ((high > low) if same else (high - low < n)))
    for k in range(0, len(used), step):
        some = used[k : k + step]
        wide = max((len(held[i]) for i in some), default=0)
        mine = np.zeros((len(some), wide))
        for j, i in enumerate(some):
            mine[j, : len(held[i])] = held[i]
        d = min(wide, len(rows))
        scores = _exact(mine[:, :d], kind) @ rows[:d] if d else np.zeros((len(some), n))
        scores = np.clip(scores, -MOST, MOST).astype(np.int64) if kind is object else scores
        for j, i in enumerate(some):
            if same:
                at = there[low[i] : high[i]]
                if block <= uids[i] < block + n:
                    at = at[at != uids[i] - block]
                mine_scores = scores[j, at]
            else:
                at = None if low[i] == high[i] else np.concatenate([there[: low[i]], there[high[i] :]])
                mine_scores, at = (scores[j], there) if at is None else (scores[j, at], at)
            work(mine_scores, at, {f: v[first[0][i] : first[1][i]] for f, v in windows.items()}, block, ids, out)
    return {name: np.concatenate(v) if v else np.zeros(0, np.int64) for name, v in out.items()}


def _exact(x: np.ndarray, kind) -> np.ndarray:
    if kind is not object:
        return x.astype(kind)
    return np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)


def digit_shift(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Bits below the leading digit of the range from lo to hi."""
    return np.maximum(np.array([int(w).bit_length() for w in hi - lo], np.int64) - DIGIT, 0)


def _histogram(scores: np.ndarray, at: np.ndarray, windows: dict, block: int, ids: np.ndarray, out: dict) -> None:
    """Counts by bucket, from the highest score down as far as the window's k-th could lie."""
    scores = np.sort(scores)
    end, begin = np.searchsorted(scores, windows["hi"], "right"), np.searchsorted(scores, windows["lo"], "left")
    n = np.minimum(end - begin, windows["need"])
    for w, lo, e, m, shift in zip(windows["w"], windows["lo"], end, n, digit_shift(windows["lo"], windows["hi"]), strict=True):
        if m:
            buckets, counts = np.unique((scores[e - m : e].astype(np.int64) - lo) >> shift, return_counts=True)
            out["w"].append(np.full(len(buckets), w))
            out["bucket"].append(buckets)
            out["n"].append(counts)


def _gather(scores: np.ndarray, at: np.ndarray, windows: dict, block: int, ids: np.ndarray, out: dict) -> None:
    """The first rows of each window, by score, then vec_id."""
    near = np.flatnonzero(scores >= windows["lo"].min())
    scores, at = scores[near].astype(np.int64), at[near]
    for w, lo, top, need in zip(windows["w"], windows["lo"], windows["top"], windows["need"], strict=True):
        found = np.flatnonzero((scores >= lo) & (scores <= top))
        if len(found):
            who = at[found]
            order = np.lexsort((ids[0][who], ids[1][who], -scores[found]))[:need]
            out["w"].append(np.full(len(order), w))
            out["uid"].append(block + who[order])
            out["vec_id"].append(ids[0][who][order])
            out["none"].append(ids[1][who][order])
            out["score"].append(scores[found][order])


def _select(grid: _Cells, windows: DataFrame, bits: int, *, same: bool) -> DataFrame:
    """The first `need` rows of each window (uid, pack, w, lo, hi, need; w tells them apart): w, rank, vec_id, uid and
    score. bits: of the widest range from lo to hi."""
    windows = staged(windows.withColumn("top", F.col("hi")).withColumn("k", F.col("need")), "negatives-windows")
    for _ in range(math.ceil(bits / DIGIT)):
        counted = grid.through(windows, _histogram, "w long, bucket long, n long", same=same)
        sums = counted.groupBy("w", "bucket").agg(F.sum("n").alias("n"))
        own = Window.partitionBy("w")
        upto = F.sum("n").over(own.orderBy(F.desc("bucket")))
        sums = sums.select("w", "bucket", "n", upto.alias("upto"), F.sum("n").over(own).alias("every"))
        wanted = F.least("need", "every")
        located = windows.join(sums, "w").where((F.col("upto") >= wanted) & (F.col("upto") - F.col("n") < wanted))
        width = F.col("hi") - F.col("lo")
        shift = F.greatest(F.when(width > 0, F.length(F.bin(width))).otherwise(0) - DIGIT, F.lit(0))
        lo = F.col("lo") + F.expr("shiftleft(bucket, shift)")
        hi = F.least("hi", lo + F.expr("shiftleft(1L, shift)") - 1)
        located = located.withColumn("shift", shift).select("uid", "pack", "w", lo.alias("lo"), hi.alias("hi"), "top", "k", (wanted - F.col("upto") + F.col("n")).cast("int").alias("need"))
        windows, last = staged(located, "negatives-windows"), windows
        discard(last)
    reached = windows.withColumn("need", F.col("k"))
    rows = grid.through(reached, _gather, "w long, uid long, vec_id long, none long, score long", same=same)
    order = Window.partitionBy("w").orderBy(F.desc("score"), "none", "vec_id", "uid")
    first = rows.withColumn("rank", F.row_number().over(order)).join(windows.select("w", "k"), "w").where("rank <= k")
    found = staged(first.select("w", "rank", F.when(F.col("none") == 0, F.col("vec_id")).alias("vec_id"), "uid", "score"), "negatives-found")
    discard(windows)
    return found


def mine(
    rows: DataFrame, anchors: Callable[[np.ndarray], np.ndarray], *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows (vec_id, embedding, label). An
    anchor is a row whose vec_id `anchors` picks. Its positives are its first other rows of the same label; the negatives
    of each are the first rows of other labels with low % to high % of the positive's score."""
    blocks = staged(_blocks(rows, scale), "negatives-blocks")
    among = staged(_anchors(blocks, anchors), "negatives-anchors")
    packs = max(1, -(-among.count() // ANCHORS))
    found = among.withColumn("pack", pack_of("uid", packs))
    grid = _Cells(blocks, found, packs)
    grid.packs = staged(grid.packs, "negatives-packs")
    number = lambda x: F.lit(x).cast("long")
    windows = found.select("uid", "pack", F.col("uid").alias("w"), number(-grid.bound).alias("lo"), number(grid.bound).alias("hi"), F.lit(positives).alias("need"))
    near = _select(grid, windows, (2 * grid.bound).bit_length(), same=True)
    pairs = near.select(F.col("w").alias("uid"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("at")).join(found, "uid")
    # few enough windows for an anchor that its uid has room for their places
    pairs = staged(pairs.select("uid", "pack", "anchor_id", "positive_id", "positive_score", (F.col("uid") * positives + F.col("at") - 1).alias("w")), "negatives-pairs")
    score = F.col("positive_score")
    lo, hi = F.expr(f"({low} * positive_score + 99) div 100"), F.expr(f"({high} * positive_score) div 100")
    windows = pairs.where((score >= 0) & (lo <= hi)).select("uid", "pack", "w", lo.alias("lo"), hi.alias("hi"), F.lit(negatives).alias("need"))
    far = _select(grid, windows, (grid.bound * (high - low) // 100 + 1).bit_length(), same=False)
    out = pairs.join(far.select("w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), "w")
    out = staged(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    discard(blocks, among, grid.packs, near, pairs, far)
    return out


def mined(rows: DataFrame, *, every: int, **options) -> DataFrame:
    """mine() with rows as anchors whose vec_id is divisible by `every`."""
    return mine(rows, lambda ids: ids % every == 0, **options)


def shifted_label(vec_id: Column, label: Column, *, every: int = 7, classes: int = 10) -> Column:
    """The label, moved on by one for each row whose vec_id is divisible by `every`, as noise."""
    label = label.cast("long")
    return F.when(vec_id % every == 0, (label + 1) % classes).otherwise(label)
