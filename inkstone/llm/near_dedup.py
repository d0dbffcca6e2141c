"""Near-duplicates by SetSketch registers.

A text is its set of word shingles. Texts with equal sets form a class, found by a 128-bit hash of the sorted 64-bit
shingle hashes, and only one document of a class goes on. Its sketch holds REGISTERS values: for each of as many hash
functions the smallest value over the set, made exponential, on an exponentially spaced scale of base BASE, truncated to
16 bits. Sketches of a union are the larger values (`merge_sketches`), and two sketches agree in a register about as
often as the sets' Jaccard similarity. The registers are banded; documents with an equal band share a bucket.

1. Proposals. A document's degree is the number of rows in its buckets, and the centre of a bucket is its row of the
   highest degree: the text that most others resemble. Each document proposes one pair, with the centre that it meets in
   most buckets. A group of n near copies proposes n pairs, not n * n.
2. Pairs that pass the bound on set sizes and a likelihood estimate of the similarity from both sketches and set sizes,
   with a margin of five standard errors, are proved: the shingles themselves are compared, made anew from the texts.
   Components come from min-label propagation with pointer jumping, all in tables.
3. In buckets that still hold several components, each row outside the largest one tries the likeliest of FEW rows of
   the largest; again one proof a row.
4. What is left is exact. In each bucket that still holds several components, every row outside the largest one is held
   against all rows of other components: by sketch first, then by the shingles. A bucket's rows are dealt to blocks of
   about BLOCK rows (or WORDS shingles), and a task compares two blocks, so that no task holds a whole bucket. No pair
   leaves a task but a proven one.

So a pair at the threshold 0.8 is lost only if it misses all BANDS bands (chance 1.3e-7, (1 - 0.8**5) ** 40) or is
dropped by the estimate (1.2e-6 at most, reckoned from the registers that agree alone). Rows of a bucket are
joined with its size and centre, so that a bucket of any size may be split over tasks.

Shingle hashes are mixed word by word, not sums of powers. Two different shingles agree in them with a chance of 2**-64:
n_shingles and the classes rest on that. Links between classes are proved on the shingles themselves.

Defined results: null and empty texts, or such without words, have no shingles, are linked with nothing and kept. Texts
with fewer words than a shingle has are one shingle. Rows that repeat a doc_id are each reported with the component of
their own text. Rows without doc_id are reported with a null component and kept. Extra columns are ignored. Very long
texts are one row of a batch. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NOT_SPACE, Sieve, Words, arrow_schema, blobs, discard, map_batches, mix64, record_batch, runs_of, slices, staged, text_key, tidy, without

BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
BASE, RATE = 1.001, 20.0
#: Low bits of a bucket's key, which hold its band.
BAND_BITS = 6
#: Rows and shingles of a block, about, in the exact comparison within a bucket.
BLOCK, WORDS = 512, 2_000_000
#: Rows of the largest component that a row outside it is estimated with before that.
FEW = 4

_RNG = np.random.default_rng(5)
_XOR = _RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_MUL = _RNG.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


# --- sets and sketches ----------------------------------------------------------------------------------------------


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text; A-Z lower-cased."""
    out: list[np.ndarray] = []
    for lo, hi in runs_of(texts):
        found = Words([t.lower() for t in texts[lo:hi]], NOT_SPACE)
        h = found.hashes(found.starts, found.ends)
        joined = h[: max(0, len(h) - words + 1)]
        for j in range(1, words):
            joined = mix64(joined * np.uint64(0xC2B2AE3D27D4EB4F) + h[j : len(joined) + j])
        for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
            if b - a >= words:
                out.append(np.unique(joined[a : b - words + 1]))
            elif b > a:
                whole = np.uint64(b - a)
                for x in h[a:b]:
                    whole = mix64(np.array([whole]) * np.uint64(0x165667B19E3779F9) + x)[0]
                out.append(np.array([whole], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def real_shingles(text: bytes, words: int) -> set:
    """The word shingles themselves."""
    w = text.lower().split()
    if len(w) < words:
        return {tuple(w)} if w else set()
    return set(zip(*(w[k:] for k in range(words)), strict=False))


def linked(a: set, b: set, similarity: int) -> bool:
    both = len(a & b)
    return bool(both) and 100 * both >= similarity * (len(a) + len(b) - both)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers of a set: floor(1 - log_BASE(min h)), truncated to 16 bits, with h exponential of rate RATE."""
    x = mix64(shingles).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 1024):
        values = np.bitwise_xor.outer(_XOR, x[k : k + 1024])
        values *= _MUL[:, None]
        values ^= values >> np.uint32(15)
        np.minimum(least, values.min(axis=1), out=least)
    h = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, 65535).astype("<u2")


def merge_sketches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(a, b)


def estimate(plus: np.ndarray, minus: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Likeliest similarity of pairs of sketches, from the numbers of registers in which the first or the second is
    larger, and the set sizes. With a base this near to 1 the likelihood is greatest at a root of a quadratic."""
    same = REGISTERS - plus - minus
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    a = u * v * REGISTERS
    b = same * (u * u + v * v) + v * v * plus + u * u * minus
    c = same * u * v
    root = (b - np.sqrt(np.maximum(b * b - 4 * a * c, 0))) / (2 * a)
    return np.clip(root, 0, np.minimum(u / v, v / u))


def margin(similarity: float) -> float:
    return 5 * (similarity * (1 - similarity) / REGISTERS) ** 0.5


def sketches(docs: DataFrame, words: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        sets = shingle_sets([b or b"" for b in blobs(batch.column(1))], words)
        return {
            "doc_id": batch.column(0),
            "n": [len(s) for s in sets],
            "set_key": [hashlib.md5(s).digest() if len(s) else None for s in sets],
            "registers": [sketch(s).tobytes() if len(s) else None for s in sets],
            "text_key": batch.column(2),
        }

    schema = "doc_id long, n long, set_key binary, registers binary, text_key binary"
    return map_batches(docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key")), run, schema)


# --- candidates -----------------------------------------------------------------------------------------------------


def buckets(reps: DataFrame) -> DataFrame:
    """key, doc, size: the rows of all buckets with more than one row. A key ends with the number of its band."""
    band = lambda k: F.substring("registers", 1 + 2 * ROWS * k, 2 * ROWS)
    keys = [F.shiftleft(F.xxhash64(band(k), F.lit(k)), BAND_BITS).bitwiseOR(F.lit(k).cast("long")) for k in range(BANDS)]
    rows = reps.select("doc", F.explode(F.array(*keys)).alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return rows.join(sizes, "key").select("key", "doc", "size")


def fits(n: Column, m: Column, similarity: int) -> Column:
    """Sets of these sizes can reach the similarity, in percent."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * similarity


def central(near: DataFrame) -> DataFrame:
    """a, b: for each document b the centre that it meets in most of its buckets, if that is another."""
    degree = near.groupBy("doc").agg(F.sum("size").alias("degree"))
    centre = near.join(degree, "doc").groupBy("key").agg(F.max_by("doc", "degree").alias("a"))
    met = near.select("key", F.col("doc").alias("b")).join(centre, "key").where("a <> b").groupBy("b", "a").agg(F.count(F.lit(1)).alias("n"))
    return met.groupBy("b").agg(F.max_by("a", "n").alias("a")).select("a", "b")


def mixed(near: DataFrame, labels: DataFrame) -> DataFrame:
    """key, doc, label, top: the rows of buckets that hold several components, with the label of the largest."""
    label = labels.select(F.col("node").alias("doc"), "label")
    rows = near.select("key", "doc").join(label, "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    counts = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    tops = counts.groupBy("key").agg(F.max_by("label", "n").alias("top"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    return rows.join(tops.select("key", "top"), "key")


def toward_top(rows: DataFrame, tried: DataFrame) -> DataFrame:
    """a, b: for each row b outside the largest component of a bucket, up to FEW rows of the largest, one from each
    bucket, that were not tried."""
    some = rows.where("label = top").groupBy("key").agg(F.max_by("doc", F.xxhash64("key", "doc")).alias("a"))
    pairs = rows.where("label <> top").select("key", F.col("doc").alias("b")).join(some, "key").select("a", "b").distinct()
    pairs = pairs.join(tried, ["a", "b"], "left_anti")
    order = Window.partitionBy("b").orderBy(F.xxhash64("a", "b"))  # at most BANDS rows each
    return pairs.withColumn("at", F.row_number().over(order)).where(F.col("at") <= FEW).select("a", "b")


def likely(pairs: DataFrame, reps: DataFrame, similarity: int) -> DataFrame:
    """a, b, guess for the pairs whose sizes fit and that pass the estimate."""
    least = similarity / 100 - margin(similarity / 100)
    target = arrow_schema("a long, b long, guess double")
    side = lambda x: reps.select(F.col("doc").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 4096):
                regs = [np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in (3, 5)]
                counts = (regs[0] > regs[1]).sum(1), (regs[0] < regs[1]).sum(1)
                guess = estimate(*counts, b.column(2).to_numpy(), b.column(4).to_numpy())
                keep = guess >= least
                yield record_batch({"a": b.column(0).to_numpy()[keep], "b": b.column(1).to_numpy()[keep], "guess": guess[keep]}, target)

    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(fits(F.col("n_a"), F.col("n_b"), similarity))
    return joined.select("a", "b", "n_a", "r_a", "n_b", "r_b").mapInArrow(tidy(run), "a long, b long, guess double")


# --- the exact comparison within buckets -----------------------------------------------------------------------------


def first_seen(equal: np.ndarray, band: int) -> np.ndarray:
    """Which pairs share no band before this one (equal: pairs by bands)."""
    return equal.argmax(1) >= band


def cells(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """key, p, q, block, doc, n, label: the rows of mixed buckets dealt to cells, each of which holds two blocks p and q of
    a bucket, or one where they are the same. Blocks below `odd` hold the rows outside the largest component; each of
    them meets itself and all blocks after it. A small bucket is one cell."""
    rows = rows.join(reps.select("doc", "n"), "doc").withColumn("odd", F.col("label") != F.col("top"))
    over = lambda flag: [F.sum(F.when(flag, x)).alias(name) for x, name in ((F.lit(1), "rows"), (F.col("n"), "words"))]
    sizes = rows.groupBy("key").agg(*[c.alias(f"{side}_{k}") for side, flag in (("odd", F.col("odd")), ("top", ~F.col("odd"))) for k, c in zip(("rows", "words"), over(flag), strict=True)])
    blocks = lambda side: F.greatest(F.ceil(F.col(f"{side}_rows") / BLOCK), F.ceil(F.col(f"{side}_words") / WORDS)).cast("int")
    whole = (F.col("odd_rows") + F.col("top_rows") <= BLOCK) & (F.col("odd_words") + F.col("top_words") <= WORDS)
    sizes = sizes.select("key", F.when(whole, 0).otherwise(blocks("odd")).alias("i"), F.when(whole, 1).otherwise(blocks("top")).alias("j"))
    rows = rows.join(sizes, "key")
    spread = lambda n: F.pmod(F.xxhash64("doc"), n.cast("long")).cast("int")
    i, j = F.col("i"), F.col("j")
    block = F.when(i == 0, 0).when(F.col("odd"), spread(i)).otherwise(i + spread(j))
    rows = rows.withColumn("block", block)
    own = F.col("block")
    others = F.sequence(F.lit(0), F.when(F.col("odd"), i + j - 1).otherwise(i - 1))
    pair = lambda o: F.struct(F.least(o, own).alias("p"), F.greatest(o, own).alias("q"))
    single = F.array(F.struct(own.alias("p"), own.alias("q")))
    rows = rows.withColumn("cell", F.explode(F.when(i == 0, single).otherwise(F.transform(others, pair))))
    return rows.select("key", "cell.p", "cell.q", "block", "doc", "n", "label")


def _compared(held: list, regs: np.ndarray, band: int, similarity: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of a cell's rows that lie in different components, whose sizes fit, whose estimate passes, and
    that share no band before this one; some at a time."""
    p, q, block, n, label = held
    least = similarity / 100 - margin(similarity / 100)
    if p == q:
        left = right = np.arange(len(n))
    else:
        left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
    for i in range(0, len(left), 512):
        for j in range(0, len(right), 512):
            x, y = left[i : i + 512], right[j : j + 512]
            small, great = np.minimum.outer(n[x], n[y]), np.maximum.outer(n[x], n[y])
            a, b = np.nonzero((label[x][:, None] != label[y][None]) & (small * 100 >= great * similarity))
            s, t = x[a], y[b]
            if p == q:
                s, t = s[s < t], t[s < t]
            for k in range(0, len(s), 4096):
                u, v = s[k : k + 4096], t[k : k + 4096]
                more, less = regs[u] > regs[v], regs[u] < regs[v]
                ok = estimate(more.sum(1), less.sum(1), n[u], n[v]) >= least
                equal = ~(more[ok] | less[ok]).reshape(-1, BANDS, ROWS).any(2)
                ok[ok] = first_seen(equal, band)
                if ok.any():
                    yield u[ok], v[ok]


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], pa.Table]]:
    """The rows of each cell (key, p, q), from rows sorted by it."""
    held, current = [], None
    for b in batches:
        ids = np.stack([b.column(c).to_numpy().astype(np.int64) for c in range(3)], 1)
        cuts = np.concatenate([[0], np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1, [len(ids)]])
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if s == e:
                continue
            if held and tuple(ids[s].tolist()) != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = tuple(ids[s].tolist())
            held.append(b.slice(s, e - s))
    if held:
        yield current, pa.Table.from_batches(held)


_BAND = (1 << BAND_BITS) - 1
_CELL = "key long, p int, q int, block int, doc long, n long, label long"


def unresolved(rows: DataFrame, reps: DataFrame, docs: DataFrame, words: int, similarity: int) -> DataFrame:
    """a, b: links between rows (of `mixed`) that share a bucket and lie in different components.

    Sketches tell which rows of a cell have any likely partner; only these bring their texts to the cell, where their
    shingles are compared."""
    active, link = arrow_schema(_CELL), arrow_schema("a long, b long")

    def likely_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, p, q), table in _by_cell(batches):
            block, n, label = (table.column(c).to_numpy() for c in (3, 5, 6))
            regs = np.frombuffer(b"".join(table.column(7).to_pylist()), "<u2").reshape(-1, REGISTERS)
            hit = np.zeros(len(n), bool)
            for s, t in _compared((p, q, block, n, label), regs, key & _BAND, similarity):
                hit[s] = hit[t] = True
            if hit.any():
                some = table.filter(pa.array(hit))
                yield record_batch({f.name: some.column(f.name) for f in active}, active)

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, p, q), table in _by_cell(batches):
            block, doc, n, own = (table.column(c).to_numpy() for c in (3, 4, 5, 6))
            texts = [x or b"" for x in blobs(table.column(7))]
            sets = shingle_sets(texts, words)
            regs = np.stack([sketch(s) for s in sets])
            joined = {int(x): int(x) for x in own}  # components joined by links found here

            def root(x: int, joined: dict = joined) -> int:
                while joined[x] != x:
                    x = joined[x] = joined[joined[x]]
                return x

            found = []
            for s, t in _compared((p, q, block, n, own), regs, key & _BAND, similarity):
                for i, j in zip(s.tolist(), t.tolist(), strict=True):
                    a, b = root(int(own[i])), root(int(own[j]))
                    if a != b:
                        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if 100 * both >= similarity * (len(sets[i]) + len(sets[j]) - both) and linked(real_shingles(texts[i], words), real_shingles(texts[j], words), similarity):
                            joined[max(a, b)] = min(a, b)
                            found.append((min(doc[i], doc[j]), max(doc[i], doc[j])))
            if found:
                yield record_batch(dict(zip(("a", "b"), zip(*found), strict=True)), link)

    dealt = staged(cells(rows, reps), "near-cells")
    together = lambda df: df.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "doc")
    some = staged(together(dealt.join(reps.select("doc", "registers"), "doc").select(*dealt.columns, "registers")).mapInArrow(tidy(likely_rows), _CELL), "near-active")
    texts = _texts(some.select("doc").distinct(), reps, docs)
    proven = staged(together(some.join(texts, "doc").select(*some.columns, "text")).mapInArrow(tidy(prove), "a long, b long").distinct(), "near-links")
    discard(dealt, some, texts)
    return proven


# --- proof and components -------------------------------------------------------------------------------------------


def _texts(wanted: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """doc, text of the wanted ones, once each. A sieve of their doc_ids keeps most texts out of the shuffle, the join
    does the rest."""
    wanted = staged(reps.select("doc", "own", "text_key").join(wanted, "doc", "left_semi"), "near-wanted")
    texts = docs.select(F.col("doc_id").alias("own"), "text").where("own is not null")
    texts = Sieve(wanted, "own").passed(texts, texts["own"])
    texts = texts.select("own", text_key(F.col("text")).alias("text_key"), "text")
    found = staged(texts.join(wanted, ["own", "text_key"]).select("doc", "text").dropDuplicates(["doc"]), "near-texts")
    discard(wanted)
    return found


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, words: int, similarity: int) -> DataFrame:
    """a, b of the pairs whose shingles reach the similarity, in percent. Texts are compared in groups of one document a
    with up to 256 others, so that no document gathers all its pairs."""
    texts = _texts(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), reps, docs)
    groups = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).select("a", F.ceil(F.col("n") / 256).cast("int").alias("chunks"))
    left = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    left = left.join(texts.select(F.col("doc").alias("a"), "text"), "a").select("a", "chunk", F.lit(None).cast("long").alias("b"), "text")
    right = pairs.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks").cast("long")).cast("int").alias("chunk"), "b")
    right = right.join(texts.select(F.col("doc").alias("b"), "text"), "b").select("a", "chunk", "b", "text")
    target = arrow_schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, group = set(), None
        for batch in (part for whole in batches for part in slices(whole)):
            out: dict = {"a": [], "b": []}
            for a, chunk, b, text in zip(*(batch.column(c).to_pylist() for c in range(3)), blobs(batch.column(3)), strict=True):
                shingles = real_shingles(text or b"", words)
                if b is None:
                    own, group = shingles, (a, chunk)
                    continue
                assert group == (a, chunk), "the text of a comes first"
                if linked(own, shingles, similarity):
                    out["a"].append(a)
                    out["b"].append(b)
            yield record_batch(out, target)

    rows = left.unionByName(right).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.asc_nulls_first("b"))
    links = staged(rows.mapInArrow(tidy(run), "a long, b long"), "near-links")
    discard(texts)
    return links


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that each node of links (a, b) reaches."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
    labels = staged(first.select("node", F.least("node", "least").alias("label")), "near-labels")
    while True:
        of = labels.select(F.col("node").alias("b"), F.col("label").alias("heard"))
        heard = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("heard").alias("heard"))
        told = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = staged(told.join(jump, "label").select("node", "old", F.least("label", "next").alias("label")), "near-labels")
        discard(labels)
        labels = new
        if new.where("label <> old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, *, words: int = 5, similarity: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept for each row; similarity in percent."""
    return _judged(docs, words, similarity).drop("text_key")


def _judged(docs: DataFrame, words: int, similarity: int) -> DataFrame:
    """What near_duplicates gives, and text_key."""
    all_sketches = staged(sketches(docs, words), "near-sketches")
    some = all_sketches.where("set_key is not null and doc_id is not null")
    classes = staged(some.groupBy("set_key").agg(F.min("doc_id").alias("own")), "near-classes")
    # a class is named by its doc_id; if that stands for several classes, all but one are named by a hash
    shared = staged(
        classes.groupBy("own").agg(F.min("set_key").alias("named"), F.count(F.lit(1)).alias("k")).where("k > 1").select("own", "named"),
        "near-shared",
    )
    repeats = not shared.isEmpty()
    if repeats:
        hashed = F.col("named").isNotNull() & (F.col("set_key") != F.col("named"))
        classes = classes.join(shared, "own", "left").withColumn("rep", F.when(hashed, F.xxhash64("own", "set_key")).otherwise(F.col("own")))
        classes = staged(classes.select("set_key", "own", "rep"), "near-classes")
    else:
        classes = classes.withColumn("rep", F.col("own"))
    reps = staged(
        some.join(classes.select(F.col("own").alias("doc_id"), "set_key", "rep"), ["doc_id", "set_key"])
        .dropDuplicates(["doc_id", "set_key"])
        .select(F.col("rep").alias("doc"), "n", "registers", F.col("doc_id").alias("own"), "text_key"),
        "near-reps",
    )
    near = staged(buckets(reps), "near-buckets")
    links: list[DataFrame] = []
    labels = tried = None
    for propose in (lambda: central(near), lambda: toward_top(mixed(near, labels), tried)):
        guesses = staged(likely(propose(), reps, similarity), "near-guesses")
        best = guesses.groupBy("b").agg(F.max_by("a", "guess").alias("a")).select("a", "b")
        links.append(verified(best, reps, docs, words, similarity))
        if labels is not None:
            discard(tried, labels)
        tried, labels = guesses, components(reduce(DataFrame.union, links))
    rest = staged(mixed(near, labels), "near-mixed")
    if not rest.isEmpty():
        links.append(unresolved(rest, reps, docs, words, similarity))
        discard(labels)
        labels = components(reduce(DataFrame.union, links))
    discard(rest, tried, near, *links)
    if repeats:  # the smallest name in a component need not be its smallest doc_id
        least = labels.join(reps.select(F.col("doc").alias("node"), "own"), "node").groupBy("label").agg(F.min("own").alias("least"))
        labels = labels.join(least, "label").select("node", F.col("least").alias("label"))
    else:
        discard(reps, shared)
    found = all_sketches.select("doc_id", "n", "set_key", "text_key").join(classes, "set_key", "left")
    found = found.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "own", "doc_id"))
    kept = F.coalesce(component == F.col("doc_id"), F.lit(True))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), "text_key")


def near_dedup(docs: DataFrame, *, words: int = 5, similarity: int = 80) -> DataFrame:
    """The rows of docs that are kept, one document of each component, with all their columns. A row goes only where its
    own text is a near copy, whatever other rows with its doc_id hold."""
    gone = _judged(docs, words, similarity).where("not kept")
    return without(docs, gone.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")))
