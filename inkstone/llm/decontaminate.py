"""Benchmark decontamination as a prefix-filtered set join.

An item's windows are its runs of `size` words; an item with fewer words is one window. Tokens of the join are shingles
of up to SHINGLE words, ordered by rarity over all documents. A window occurs only if all its shingles do, so its
necessary prefix is the rarest one: each window is filed under it. Where a document holds such a prefix token, the place
of the token in the window bounds where the window would lie, its length must fit between the ends of the document, and
what passes is compared word for word over the window.

Up to BLOCK windows, of at most 10 * BLOCK items in all, are sent to every task: documents are counted once and searched
once, and none is shuffled. For more the join shuffles. Rarity is then taken from the counts of a shingle's rarest word.
Documents give (token, place and the words around it) for tokens that a Bloom filter of 2**FILTER_BITS bits passes,
whatever the size of the benchmark; these meet the windows by token, and are verified there. The more windows, the more the
filter lets through for nothing, some 0.1 % of all places at 1 million windows and 7 % at 10 million, which costs time and
no row. Windows whose token may occur HOT times or more (an item of one common word) would send each occurrence by one key:
of these the BLOCK most frequent go to every task and are found there, and a document sends one row for each that it
holds. Which items hold a window is joined last, to one row for each document and window.

Words are lower-cased for A-Z and made of ASCII letters, digits and all characters beyond ASCII.

Defined results: null and empty texts have no words and hit nothing. An item without words has no window; items with
equal text all count. Null item_ids are ignored. Rows that repeat are reported each; extra columns are ignored. A very
long text is one row of a batch. An empty table of documents gives an empty result, an empty benchmark no hit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_TABLE, arrow_schema, blobs, discard, keep_rows, map_batches, padded, range_hashes, record_batch, slices, staged, text_key, tidy, without

SIZE, SHINGLE = 10, 3
#: Windows sent to a task: some 60 MB at 10 words each.
BLOCK = 100_000
#: Occurrences of a token from which on its windows don't go by key; some 15 MB of words around it.
HOT = 100_000
FILTER_BITS = 26

Words = list[bytes]


def words_of(text: bytes | None) -> Words:
    return text.translate(ALNUM_TABLE).split() if text else []


def windows_of(words: Words, size: int = SIZE) -> set[tuple[bytes, ...]]:
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def shingles(words: Words, k: int) -> list[tuple[bytes, ...]]:
    return list(zip(*(words[i:] for i in range(k)), strict=False))


def _windows(benchmark: DataFrame, size: int) -> DataFrame:
    """window (words joined by a space), items: the item_ids that have it, sorted."""

    def run(batch: pa.RecordBatch) -> dict:
        ids, windows = [], []
        for item, text in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), strict=True):
            for w in windows_of(words_of(text), size):
                ids.append(item)
                windows.append(b" ".join(w).decode())
        return {"item": ids, "window": windows}

    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string"), "text")
    return map_batches(items, run, "item string, window string").groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def merged(ranges: list[int]) -> list[int]:
    """Starts and ends in turn, sorted and joined where they touch."""
    out: list[int] = []
    for a, b in sorted(zip(ranges[::2], ranges[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def few(windows: DataFrame, block: int) -> bool:
    """Whether they can go to every task, with the items that hold them."""
    seen = windows.agg(F.count(F.lit(1)).alias("windows"), F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("items")).first()
    return seen["windows"] <= block and seen["items"] <= 10 * block


OUT = "doc_id long, n_words long, n_hit long, spans array<int>, items array<string>"


# --- few windows: sent to every task ---------------------------------------------------------------------------------


def shingle_counts(docs: DataFrame, wanted: dict[int, frozenset]) -> dict[tuple, int]:
    """How often each wanted shingle (by its number of words) occurs in all documents."""
    target = arrow_schema("shingle binary, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in (part for whole in batches for part in slices(whole)):
            for text in blobs(batch.column(0)):
                words = words_of(text)
                for k, own in wanted.items():
                    total.update(filter(own.__contains__, zip(*(words[i:] for i in range(k)), strict=False)))
        yield record_batch({"shingle": [b" ".join(t) for t in total], "n": list(total.values())}, target)

    rows = docs.select("text").mapInArrow(tidy(run), "shingle binary, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return {tuple(bytes(r["shingle"]).split(b" ")): r["n"] for r in rows.collect()}  # as many rows as wanted, at most


def prefix_index(windows: dict[tuple, tuple], counts: dict[tuple, int]) -> dict[int, dict[tuple, list[tuple[int, int]]]]:
    """By number of words and rarest shingle: the places it takes and the lengths of the windows filed under it."""
    index: dict[int, dict] = {}
    for w in windows:
        k = min(SHINGLE, len(w))
        tokens = shingles(w, k)
        at = min(range(len(tokens)), key=lambda i: (counts.get(tokens[i], 0), tokens[i], i))
        index.setdefault(k, {}).setdefault(tokens[at], set()).add((at, len(w)))
    return {k: {t: sorted(v) for t, v in own.items()} for k, own in index.items()}


def hits_of(words: Words, windows: dict, index: dict) -> tuple[list[tuple[int, int]], set[str]]:
    """Word ranges of the windows that occur, and the items they are from."""
    ranges, items = [], set()
    for k, own in index.items():
        tokens = shingles(words, k)
        if own.keys().isdisjoint(tokens):
            continue
        for i in [i for i, t in enumerate(tokens) if t in own]:
            for at, length in own[tokens[i]]:
                start = i - at
                if start >= 0 and start + length <= len(words):
                    found = windows.get(tuple(words[start : start + length]))
                    if found:
                        ranges.append((start, start + length))
                        items.update(found)
    return ranges, items


def _index(docs: DataFrame, windows: DataFrame) -> Broadcast:
    table = {tuple(r["window"].encode().split(b" ")): tuple(r["items"]) for r in windows.collect()}
    wanted: dict[int, set] = {}
    for w in table:
        k = min(SHINGLE, len(w))
        wanted.setdefault(k, set()).update(shingles(w, k))
    counts = shingle_counts(docs, {k: frozenset(v) for k, v in wanted.items()}) if table else {}
    return docs.sparkSession.sparkContext.broadcast((table, prefix_index(table, counts)))


# --- many windows: a join --------------------------------------------------------------------------------------------


def _word_counts(docs: DataFrame) -> DataFrame:
    """word, n: of all documents, added up in each task first."""
    target = arrow_schema("word string, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                for text in blobs(part.column(0)):
                    total.update(words_of(text))
                if len(total) > 500_000:
                    yield record_batch({"word": [w.decode() for w in total], "n": list(total.values())}, target)
                    total.clear()
        yield record_batch({"word": [w.decode() for w in total], "n": list(total.values())}, target)

    return docs.select("text").mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _filed(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """window, token (the hash of its rarest shingle), n (the token occurs so often at most), at, length."""
    words = windows.select("window", F.posexplode(F.split("window", " ")).alias("at", "word")).join(counts, "word", "left")
    rated = words.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n")))).alias("w"))

    def run(batch: pa.RecordBatch) -> dict:
        tokens, upto, places, lengths = [], [], [], []
        for window, rates in zip(blobs(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            words = window.split(b" ")
            k = min(SHINGLE, len(words))
            rare = [min(r["n"] for r in rates[i : i + k]) for i in range(len(words) - k + 1)]
            at = min(range(len(rare)), key=lambda i: (rare[i], words[i : i + k], i))  # noqa: B023
            tokens.append(b" ".join(words[at : at + k]))
            upto.append(rare[at])
            places.append(at)
            lengths.append(len(words))
        ends = np.cumsum([len(t) for t in tokens] or [0])
        hashes = range_hashes(padded(b"".join(tokens)), np.concatenate([[0], ends[:-1]])[: len(tokens)], ends[: len(tokens)])
        return {"window": batch.column(0), "token": hashes.view(np.int64), "n": upto, "at": places, "length": lengths}

    return map_batches(rated, run, "window string, token long, n long, at int, length int")


_BITS = [(7, (1 << FILTER_BITS) - 1), (33, (1 << FILTER_BITS) - 1)]


def _filter(filed: DataFrame) -> np.ndarray:
    """The Bloom filter of all tokens, as bytes: at most 2**(FILTER_BITS - 6) rows come to the driver."""
    token = F.col("token")
    cell = F.explode(F.array(*[F.shiftrightunsigned(token, s).bitwiseAND(F.lit(m)) for s, m in _BITS]))
    bits = filed.select(cell.alias("cell")).groupBy(F.shiftright("cell", 6).alias("at"))
    rows = bits.agg(F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("bits")).collect()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in rows:
        out[r["at"]] = r["bits"]
    return out.view(np.uint8)


def _common(filed: DataFrame, block: int, hot: int) -> tuple[Broadcast, DataFrame]:
    """The windows that every task gets, at most `block`, with their prefix index; and the others."""
    most = staged(filed.where(F.col("n") >= hot).orderBy(F.desc("n"), "window").limit(block), "decontam-hot")
    table, index = {}, {}
    for r in most.collect():
        words = tuple(r["window"].encode().split(b" "))
        table[words] = (r["window"],)
        k = min(SHINGLE, len(words))
        index.setdefault(k, {}).setdefault(words[r["at"] : r["at"] + k], set()).add((r["at"], len(words)))
    index = {k: {t: sorted(v) for t, v in own.items()} for k, own in index.items()}
    rest = staged(filed.join(F.broadcast(most.select("window")), "window", "left_anti"), "decontam-filed")
    discard(most)
    return filed.sparkSession.sparkContext.broadcast((table, index)), rest


def _joined(docs: DataFrame, windows: DataFrame, size: int, block: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_key, n_words, ranges (of the hot windows, null if none) of all rows, staged; and doc_id, text_key, window,
    start, stop of each hit, staged, without start and stop for hot windows."""
    filed = staged(_filed(windows, _word_counts(docs)), "decontam-windows")
    common, rest = _common(filed, block, hot)
    discard(filed)
    lengths = [r["k"] for r in rest.select(F.least("length", F.lit(SHINGLE)).alias("k")).distinct().collect()]
    shared = docs.sparkSession.sparkContext.broadcast(_filter(rest))
    schema = "doc_id long, text_key binary, n_words long, ranges array<int>, windows array<string>, token long, place int, before string, after string"
    target = arrow_schema(schema)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, (table, index) = shared.value, common.value
        for batch in batches:
            for part in slices(batch):
                out: dict = {f.name: [] for f in target}
                for doc, key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), blobs(part.column(2)), strict=True):
                    plain = text.translate(ALNUM_TABLE) if text else b""
                    words = plain.split()
                    ranges, found = hits_of(words, table, index)
                    rows = [(doc, key, len(words), merged([x for r in ranges for x in r]) or None, sorted(found), None, None, None, None)]
                    whole = b" ".join(words)
                    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                    starts = np.concatenate([[0], ends[:-1] + 1]) if words else ends
                    buf = padded(whole)
                    for k in lengths:
                        if len(words) < k:
                            continue
                        # a shingle's words are joined by spaces here as in the windows
                        tokens = range_hashes(buf, starts[: len(words) - k + 1], ends[k - 1 :])
                        hit = np.ones(len(tokens), bool)
                        for s, m in _BITS:
                            cells = (tokens >> np.uint64(s)) & np.uint64(m)
                            hit &= (held[(cells >> np.uint64(3)).astype(np.int64)] >> (cells & np.uint64(7)).astype(np.uint8)) & 1 > 0
                        for i in np.flatnonzero(hit).tolist():
                            before, after = b" ".join(words[max(0, i - size) : i]), b" ".join(words[i : i + size])
                            rows.append((doc, key, len(words), None, None, int(tokens[i].view(np.int64)), i, before.decode(), after.decode()))
                    for r in rows:
                        for name, v in zip(out, r, strict=True):
                            out[name].append(v)
                yield record_batch(out, target)

    found = staged(docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text").mapInArrow(tidy(give), schema), "decontam-tokens")
    before = F.when(F.col("before") == "", F.array().cast("array<string>")).otherwise(F.split("before", " "))
    near = F.concat(before, F.split("after", " "))
    first = F.size(before) - F.col("at")  # where the window would begin among the words around the token
    lies = F.when((first >= 0) & (first + F.col("length") <= F.size(near)), F.array_join(F.slice(near, first + 1, F.col("length")), " "))
    start = F.col("place") - F.col("at")
    hits = found.where("token is not null").join(rest, "token").where(lies == F.col("window"))
    hits = hits.select("doc_id", "text_key", "window", start.alias("start"), (start + F.col("length")).alias("stop"))
    none = F.lit(None).cast("int")
    own = found.where("token is null").select("doc_id", "text_key", F.explode("windows").alias("window"), none.alias("start"), none.alias("stop"))
    rows = staged(found.where("token is null").select("doc_id", "text_key", "n_words", "ranges"), "decontam-rows")
    every = staged(hits.unionByName(own), "decontam-hits")
    discard(found, rest)
    return rows, every


# --- the operator ----------------------------------------------------------------------------------------------------


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, *, size: int = SIZE, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_hit, spans (word starts and ends in turn, merged), items (sorted as strings) for each row."""
    windows = staged(_windows(benchmark, size), "decontam-windows")
    if not few(windows, block):
        rows, hits = _joined(docs, windows, size, block, hot)
        of = [F.col("doc_id").alias("id"), F.col("text_key").alias("key")]
        ranges = hits.where("start is not null").groupBy(*of).agg(F.collect_set(F.struct("start", "stop")).alias("more"))
        # an item once for each document, before lists are made
        items = hits.select("doc_id", "text_key", "window").distinct().join(windows, "window").select(*of, F.explode("items").alias("item")).distinct()
        items = items.groupBy("id", "key").agg(F.array_sort(F.collect_list("item")).alias("items"))
        for table in (ranges, items):
            same = F.col("doc_id").eqNullSafe(table["id"]) & F.col("text_key").eqNullSafe(table["key"])
            rows = rows.join(table, same, "left").drop("id", "key")

        def merge(batch: pa.RecordBatch) -> dict:
            spans = [
                merged([*(hot or []), *(x for r in cold or [] for x in (r["start"], r["stop"]))])
                for hot, cold in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            n_hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
            return {"doc_id": batch.column(0), "n_words": batch.column(1), "n_hit": n_hit, "spans": spans, "items": [x or [] for x in batch.column(4).to_pylist()]}

        return map_batches(rows.select("doc_id", "n_words", "ranges", "more", "items"), merge, OUT)
    shared = _index(docs, windows)
    discard(windows)

    def run(batch: pa.RecordBatch) -> dict:
        table, index = shared.value
        out: dict = {"n_words": [], "n_hit": [], "spans": [], "items": []}
        for text in blobs(batch.column(1)):
            words = words_of(text)
            ranges, found = hits_of(words, table, index)
            spans = merged([x for r in ranges for x in r])
            for k, v in zip(out, (len(words), sum(spans[1::2]) - sum(spans[::2]), spans, sorted(found)), strict=True):
                out[k].append(v)
        return out | {"doc_id": batch.column(0)}

    return map_batches(docs.select("doc_id", "text"), run, OUT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, size: int = SIZE, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """The rows of docs without a benchmark window, with all their columns."""
    windows = staged(_windows(benchmark, size), "decontam-windows")
    if not few(windows, block):
        rows, hits = _joined(docs, windows, size, block, hot)
        discard(rows, windows)
        return without(docs, hits.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct())
    shared = _index(docs, windows)
    discard(windows)

    def clean(batch: pa.RecordBatch) -> list[bool]:
        table, index = shared.value
        texts = blobs(batch.column(batch.schema.names.index("text")))
        return [not hits_of(words_of(t), table, index)[0] for t in texts]

    return keep_rows(docs, clean)
