"""Ranked lexical search as a threshold-seeded join.

Documents become an index restricted to the items' terms: blocks of postings by term, with the document's place and the
term's count. Which words are terms is told by a bitmap of 2**BITS bits of their hashes, sent to every task, whatever the
number of items; words that pass by chance are kept for nothing, and meet no item, since terms are matched by their bytes.

Of each term the `top` largest impacts of all documents are stored. Summed by item and document over the item's terms they
are lower bounds of scores, and the k-th largest is a lower bound of the item's k-th score: its threshold. An item's terms
are then ordered by their largest possible part of a score. As long as the parts of the smallest ones together stay below
the threshold, no document with these terms alone can be among the first k: the other terms generate the candidates, cell
by cell (`grid.cells`, blocks against packs of items). A candidate is dropped when what it has and the bounds of the
terms still to come do not reach the threshold, and is exactly rescored otherwise. Each cell gives at most k rows of an
item, and the first k of all cells are its result.

Scores are whole numbers of 64 bits. A term's weight is floor(1000 * ln((2N + 2) / (2 df + 1))); see `impact`.

Defined results: null and empty texts have no terms and are not counted among N. Each row of items is an item and each row
of documents a document, also where ids repeat or are null; equal scores go by ascending doc_id, without an id last.
Items without terms, or whose terms no document holds, give no row. Very long texts are gone through in parts. Extra
columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ALNUM_TABLE, NOT_SPACE, Words, arrow_schema, blobs, discard, padded, range_hashes, record_batch, slices, staged, tidy, word_blocks
from ..grid import cells, pack_of

BITS = 26
#: Documents and postings of a block, rows of a pack of items, bytes of text gone through at a time.
DOCS, POSTINGS, PACK, PART = 8192, 1 << 20, 50_000, 4 << 20

BLOCK = "block long, n int, holding long, terms long, ids binary, lengths binary, words binary, starts binary, docs binary, counts binary"


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all beyond ASCII, with A-Z lower-cased."""
    return text.translate(ALNUM_TABLE).split() if text else []


def impact(counts: np.ndarray, lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a term's occurrences in a document of so many terms are worth, before the term's weight; n documents have
    `total` terms. 1000000000 * tf div (1000 * tf + 12 * m) with m = 100 - 25 + 25 * length * n div total."""
    if total and 25 * n * int(lengths.max(initial=0)) >= 1 << 63:
        share = np.array([25 * n * int(x) // total for x in lengths], np.int64)
    else:
        share = 25 * n * lengths // max(total, 1)
    return 1_000_000_000 * counts // (1000 * counts + 12 * (75 + share))


def _item_terms(items: DataFrame) -> DataFrame:
    """item (a number of its own for each row), item_id, word, times."""
    target = arrow_schema("item long, item_id long, word string, times long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch)):
            rows = [(item, i, w.decode(), n) for item, i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), blobs(part.column(2)), strict=True) for w, n in Counter(terms_of(t)).items()]
            yield record_batch({f.name: [r[k] for r in rows] for k, f in enumerate(target)}, target)

    numbered = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long"), "text")
    return numbered.mapInArrow(tidy(run), "item long, item_id long, word string, times long")


def _bitmap(spark: SparkSession, words: DataFrame) -> Broadcast:
    """2**BITS bits, those set that the hash of a word points to."""
    target = arrow_schema("slot long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = blobs(batch.column(0))
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
            hashes = range_hashes(padded(b"".join(texts)), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)
            yield record_batch({"slot": (hashes & np.uint64((1 << BITS) - 1)).astype(np.int64)}, target)

    slots = words.select("word").distinct().mapInArrow(tidy(run), "slot long")
    pieces = slots.groupBy(F.shiftright("slot", 15).alias("at")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(32767).cast("int")).alias("bits"))
    bits = np.zeros((1 << BITS - 15, 4096), np.uint8)
    for r in pieces.collect():  # at most 2**BITS bits
        bits[r["at"]] = np.frombuffer(r["bits"], np.uint8)
    return spark.sparkContext.broadcast(bits.reshape(-1))


def _parts(text: bytes) -> Iterator[bytes]:
    """A text, cut between words where it is long."""
    at = 0
    while len(text) - at > PART and (end := text.rfind(b" ", at, at + PART)) > at:
        yield text[at:end]
        at = end
    yield text[at:]


def _same_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, like: np.ndarray) -> bool:
    """Whether each range of bytes equals that at `like`."""
    words, left, a, b = word_blocks(buf), ends - starts, starts, starts[like]
    if not (left == left[like]).all():
        return False
    while len(a):
        unused = np.uint64(8) * (np.uint64(8) - np.minimum(left, 8).astype(np.uint64))
        if (((words[a] ^ words[b]) << unused) != 0).any():
            return False
        more = left > 8
        a, b, left = a[more] + 8, b[more] + 8, left[more] - 8
    return True


def _counted(texts: list[bytes], bits: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text; words that the bitmap passes; and for each of these and each text that has it the number of the
    word, of the text, and how often it occurs."""
    parts, owner = [], []
    for k, text in enumerate(texts):
        for part in _parts(text.translate(ALNUM_TABLE)):
            parts.append(part)
            owner.append(k)
    words, lengths = Words(parts, NOT_SPACE), np.zeros(len(texts), np.int64)
    np.add.at(lengths, owner, np.diff(words.first))
    hashes = words.hashes(words.starts, words.ends)
    slot = (hashes & np.uint64((1 << BITS) - 1)).astype(np.int64)
    at = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
    starts, ends = words.starts[at], words.ends[at]
    text = np.asarray(owner, np.int64)[np.searchsorted(words.first, at, "right") - 1]
    _, first, number = np.unique(hashes[at], return_index=True, return_inverse=True)
    if not _same_words(words.buf, starts, ends, first[number]):  # hashes that agree by chance
        numbers: dict[bytes, int] = {}
        number = np.array([numbers.setdefault(words.raw[a:b], len(numbers)) for a, b in zip(starts, ends, strict=True)], np.int64)
        first = np.unique(number, return_index=True)[1]
    found, counts = np.unique(number * len(texts) + text, return_counts=True)
    return lengths, [words.raw[starts[k] : ends[k]] for k in first], found // max(len(texts), 1), found % max(len(texts), 1), counts


class _Postings:
    """A block in the making."""

    def __init__(self, block: int):
        self.block, self.n, self.size = block, 0, 0
        self.numbers: dict[bytes, int] = {}
        self.ids, self.none, self.lengths, self.words, self.docs, self.counts = ([] for _ in range(6))

    def add(self, ids: pa.Array, texts: list[bytes], bits: np.ndarray) -> None:
        lengths, words, number, text, counts = _counted(texts, bits)
        self.ids.append(np.asarray(ids.fill_null(0)).astype(np.int64))
        self.none.append(np.asarray(ids.is_null()))
        self.lengths.append(lengths)
        own = np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words], np.int64)
        self.words.append(own[number])
        self.docs.append(text + self.n)
        self.counts.append(counts)
        self.n, self.size = self.n + len(texts), self.size + len(counts)

    def row(self) -> dict:
        words, lengths = np.concatenate(self.words), np.concatenate(self.lengths)
        order = np.argsort(words, kind="stable")
        starts = np.searchsorted(words[order], np.arange(len(self.numbers) + 1))
        small = lambda x: np.concatenate(x)[order].astype(np.int32).tobytes()
        return {
            "block": [self.block], "n": [self.n], "holding": [int((lengths > 0).sum())], "terms": [int(lengths.sum())],
            "ids": [np.stack([np.concatenate(self.ids), np.concatenate(self.none)]).astype(np.int64).tobytes()], "lengths": [lengths.tobytes()],
            "words": [b" ".join(self.numbers)], "starts": [starts.astype(np.int64).tobytes()], "docs": [small(self.docs)], "counts": [small(self.counts)],
        }


def _index(docs: DataFrame, bits: Broadcast) -> DataFrame:
    """All documents in blocks; a document's number is block + its place."""
    target = arrow_schema(BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _Postings(TaskContext.get().partitionId() << 40)
        for part in (part for batch in batches for part in slices(batch, size=PART)):
            made.add(part.column(0), [t or b"" for t in blobs(part.column(1))], bits.value)
            if made.n >= DOCS or made.size >= POSTINGS:
                yield record_batch(made.row(), target)
                made = _Postings(made.block + made.n)
        if made.n:
            yield record_batch(made.row(), target)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), BLOCK)


class _Block:
    """A block as arrays: impacts by term."""

    def __init__(self, row: dict, n: int, total: int):
        long = lambda name: np.frombuffer(row[name], np.int64)
        self.block, self.n, self.starts, self.lengths = row["block"], row["n"], long("starts"), long("lengths")
        self.ids, self.none = long("ids").reshape(2, -1)
        self.words = row["words"].split(b" ") if row["words"] else []
        self.docs = np.frombuffer(row["docs"], np.int32).astype(np.int64)
        self.impacts = impact(np.frombuffer(row["counts"], np.int32).astype(np.int64), self.lengths[self.docs], n, total)


COLUMNS = ("block", "n", "ids", "lengths", "words", "starts", "docs", "counts")


def _first_by(group: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values of each group."""
    order = np.lexsort((-value, group))
    begin = np.flatnonzero(np.diff(group[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return order[rank < k]


def _impacts(blocks: DataFrame, n: int, total: int, k: int) -> DataFrame:
    """word, doc, impact: its k largest in each task; df: the documents of the task that hold it, with its first row."""
    schema = "word string, doc long, impact long, df long"
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[bytes, int] = {}
        held = [np.zeros((3, 0), np.int64)]
        df, size = Counter(), 0

        def best() -> np.ndarray:
            rows = np.concatenate(held, axis=1)
            return rows[:, _first_by(rows[0], rows[2], k)]

        def out() -> pa.RecordBatch:
            rows, words = best(), list(numbers)
            first = np.diff(rows[0], prepend=-1) != 0
            return record_batch({"word": [words[i].decode() for i in rows[0]], "doc": rows[1], "impact": rows[2], "df": [df[int(i)] if f else 0 for i, f in zip(rows[0], first, strict=True)]}, target)

        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row, n, total)
                own = np.array([numbers.setdefault(w, len(numbers)) for w in b.words], np.int64)
                sizes = np.diff(b.starts)
                df.update(dict(zip(own.tolist(), sizes.tolist(), strict=True)))
                word = np.repeat(np.arange(len(own)), sizes)
                some = _first_by(word, b.impacts, k)
                held.append(np.stack([own[word[some]], b.block + b.docs[some], b.impacts[some]]))
                size += len(some)
                if size > POSTINGS:
                    held = [best()]
                    size = held[0].shape[1]
                    if size > POSTINGS // 2:  # more words than should be held
                        yield out()
                        numbers, held, df, size = {}, [np.zeros((3, 0), np.int64)], Counter(), 0
        yield out()

    return blocks.select(*COLUMNS).mapInArrow(tidy(run), schema)


def _found(row: pa.RecordBatch, n: int, total: int, k: int, names: list[str]) -> dict:
    """The first k documents of a block for each item of a pack, of those that reach its threshold."""
    b = _Block(row.select(COLUMNS).to_pylist()[0], n, total)
    entries = row.column("entries").flatten()
    own = {f.name: np.asarray(entries.field(i)) for i, f in enumerate(entries.type) if f.name != "word"}
    place = {w: i for i, w in enumerate(b.words)}
    number = np.array([place.get(w, -1) for w in blobs(entries.field("word"))], np.int64)
    out: dict[str, list] = {name: [] for name in names}
    begin = np.flatnonzero(np.diff(own["item"], prepend=-1))
    score = np.zeros(b.n, np.int64)
    for lo, hi in zip(begin, np.append(begin, len(number))[1:], strict=True):
        here = lo + np.flatnonzero(number[lo:hi] >= 0)
        leading = here[own["leading"][here]]
        if not len(leading):
            continue
        threshold = max(int(own["threshold"][lo]), 1)
        rest = here[~own["leading"][here]]
        rest = rest[np.argsort(-own["bound"][rest], kind="stable")]
        bound = int(own["bound"][rest].sum())
        score[:] = 0
        for j in leading:
            span = slice(b.starts[number[j]], b.starts[number[j] + 1])
            score[b.docs[span]] += own["weight"][j] * b.impacts[span]
        some = np.flatnonzero((score > 0) & (score >= threshold - bound))
        for j in rest:
            if not len(some):
                break
            span = slice(b.starts[number[j]], b.starts[number[j] + 1])
            docs, impacts = b.docs[span], b.impacts[span]
            at = np.minimum(np.searchsorted(docs, some), len(docs) - 1)
            score[some] += np.where(docs[at] == some, own["weight"][j] * impacts[at], 0)
            bound -= int(own["bound"][j])
            some = some[score[some] >= threshold - bound]
        if len(some):
            some = some[np.lexsort((b.ids[some], b.none[some], -score[some]))][:k]
            out["item"].append(np.full(len(some), own["item"][lo]))
            out["doc"].append(b.block + some)
            out["doc_id"].append(b.ids[some])
            out["none"].append(b.none[some])
            out["score"].append(score[some])
    return {name: np.concatenate(v) if v else np.zeros(0, np.int64) for name, v in out.items()}


def search(docs: DataFrame, items: DataFrame, *, top: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents (doc_id, text) of each item (item_id, text) with a score above 0."""
    spark = docs.sparkSession
    terms = staged(_item_terms(items), "search-terms")
    bits = _bitmap(spark, terms)
    blocks = staged(_index(docs, bits), "search-blocks")
    slots, n, total = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("holding"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    impacts = staged(_impacts(blocks, n, total, top), "search-impacts")
    counts = impacts.groupBy("word").agg(F.sum("df").alias("df"), F.max("impact").alias("best"))
    weight = F.floor(1000 * F.log((2 * F.lit(float(n)) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = terms.join(counts, "word").select("item", "item_id", "word", (F.col("times") * weight).alias("weight"), (F.col("times") * weight * F.col("best")).alias("bound"))
    weighted = staged(weighted.where("weight > 0"), "search-weighted")
    stored = impacts.withColumn("k", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("impact"), "doc"))).where(F.col("k") <= top)
    seeds = weighted.join(stored, "word").groupBy("item", "doc").agg(F.sum(F.col("weight") * F.col("impact")).alias("part"))
    seeds = seeds.withColumn("k", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("part"), "doc"))).where(F.col("k") == top)
    below = F.sum("bound").over(Window.partitionBy("item").orderBy("bound", "word").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    entries = weighted.join(seeds.select("item", F.col("part").alias("threshold")), "item", "left").fillna(0, ["threshold"]).withColumn("leading", below >= F.col("threshold"))
    n_packs = max(1, -(-weighted.count() // PACK))
    struct = F.struct("item", "word", "weight", "bound", "threshold", "leading")
    packs = staged(entries.groupBy(pack_of("item", n_packs).alias("pack")).agg(F.sort_array(F.collect_list(struct)).alias("entries")), "search-packs")
    schema = "item long, doc long, doc_id long, none long, score long"
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield record_batch(_found(batch.slice(k, 1), n, total, top, target.names), target)

    both = cells(blocks.select(*COLUMNS), packs, slots=max(slots, 1), n_packs=n_packs)
    found = both.select(*COLUMNS, "entries").mapInArrow(tidy(run), schema)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "none", "doc_id", "doc")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = terms.select("item", "item_id").distinct()
    doc_id = F.when(F.col("none") == 0, F.col("doc_id"))
    out = staged(ranked.join(names, "item").select("item_id", "rank", doc_id.alias("doc_id"), "score"), "search")
    discard(terms, blocks, impacts, weighted, packs)
    bits.unpersist()
    return out
