"""Removal of repeated byte strings by suffix sorting.

Of each text (UTF-8 bytes; null: empty) every byte goes that is covered by a string of `length` bytes which also starts
in a document with a smaller doc_id. All is judged on the input. What goes is decided by sorting alone; hashes only leave
out what occurs in a single document, and deal the rest to tasks.

Each window of `length` bytes has an anchor: the place of the least hash among its runs of GRAM bytes, which depends on
the window's bytes alone, so equal windows have equal anchors at equal places. The windows of one anchor follow one
another; their bytes together are its cut, and cuts of one anchor hash are where equal windows can be.

1. Texts are packed into chunks of about CHUNK bytes, compressed, and written once. A chunk gives each anchor hash that
   it holds once, with the number of its documents, sorted, in one blob for each bucket of hashes. A bucket answers each
   blob with a bit for each entry: whether other documents hold the anchor too.
2. Chunks meet their answers. The cuts of shared anchors are sorted in the chunk. Of equal ones that of the smallest
   doc_id goes on to its bucket, with its bytes; those of larger doc_ids are removed.
3. A bucket sorts the cuts of all chunks; of equal ones, again, all but those of the smallest doc_id are removed. Where
   an anchor hash has several different cuts, the suffixes that start its windows are sorted too. What agrees over
   `length` bytes is one string; its smallest doc_id keeps it, every other document's windows of it are removed.
4. Chunks meet what is removed from them.

Sorting is deep-shallow: multikey quicksort over symbols of eight bytes to SHALLOW bytes, all groups of a level at once;
groups that still agree are ordered by blind tries: a group's members hang on the path of its first one, at the depth
where they leave it and by the byte with which they do, and each such bunch becomes a group of the next round.

No group gathers in one task: a chunk sends an anchor hash once and equal cuts once, however many copies it holds, and an
anchor that more than COLD documents hold is cut into single windows that are dealt by their own bytes. Buckets hold the
anchors of about BUCKET bytes of text, so that a task's memory does not depend on the input; a chunk writes a blob for
each bucket, some 1,000,000 * BUCKET / input anchors in each.

Defined results: texts under `length` bytes lose nothing. Rows that repeat a doc_id don't remove each other's bytes and
are reported each. Rows without doc_id are reported unchanged and remove nothing. A text longer than a chunk is a chunk
of its own. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, blobs, discard, mix64, padded, range_hashes, record_batch, staged, tidy

GRAM, SHALLOW = 16, 16
CHUNK, BUCKET = 16 << 20, 64 << 20
COLD = 4096
#: Windows that are sorted at a time, about.
WINDOWS = 400_000


# --- anchors --------------------------------------------------------------------------------------------------------


def words_at(buf: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on, big-endian, so that numbers sort as the bytes do; a view."""
    return np.ndarray((max(len(buf) - 7, 0),), ">u8", buf, strides=(1,))


def anchors_of(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor of a text its hash, the first window it stands for and how many follow one another."""
    windows = len(text) - length + 1
    if windows <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = words_at(np.frombuffer(text, np.uint8)).astype(np.uint64)
    h = mix64(w[: len(w) - GRAM + 8] * np.uint64(0x9E3779B97F4A7C15) + mix64(w[GRAM - 8 :]))
    span = length - GRAM + 1
    # the hash's upper half and the place: least hash first, leftmost of equal ones
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    # least hashes are small; mixed once more they deal evenly
    return mix64(h[place[first]]), first, np.diff(np.append(first, len(place)))


def _planes(values: np.ndarray) -> bytes:
    """Bytes of numbers by significance: those that are alike stand together and compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _unplanes(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, and the end."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes."""
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _parts(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each bucket and where it lies, in sorted buckets."""
    cuts = _runs(bucket)
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(bucket[a]), slice(a, z)


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of some runs of these sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


# --- chunks ---------------------------------------------------------------------------------------------------------

CHUNKS = "chunk long, n_bytes long, docs binary, real binary, sizes binary, data binary"


def chunks(docs: DataFrame) -> DataFrame:
    """The texts of docs in chunks of about CHUNK bytes: doc_ids, whether there is one, sizes, and the compressed texts."""
    target = arrow_schema(CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)

        def flush(ids: list, texts: list[bytes]) -> pa.RecordBatch:
            whole = b"".join(texts)
            values = (
                int.from_bytes(os.urandom(8), "little") >> 1,
                len(whole),
                np.array([d or 0 for d in ids], np.int64).tobytes(),
                bytes(d is not None for d in ids),
                np.fromiter(map(len, texts), np.int64, len(texts)).tobytes(),
                pack.compress(whole),
            )
            return record_batch({f.name: [v] for f, v in zip(target, values, strict=True)}, target)

        ids, texts, size = [], [], 0
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                for d, t in zip(part.column(0).to_pylist(), blobs(part.column(1)), strict=True):
                    if texts and (size + len(t or b"") > CHUNK or len(texts) >= 1 << 17):
                        yield flush(ids, texts)
                        ids, texts, size = [], [], 0
                    ids.append(d)
                    texts.append(t or b"")
                    size += len(texts[-1])
        if texts:
            yield flush(ids, texts)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), CHUNKS)


class Chunk:
    """The texts of a row of chunks, and their anchors."""

    def __init__(self, row: dict):
        self.name = row["chunk"]
        self.docs = np.frombuffer(row["docs"], np.int64)
        self.real = np.frombuffer(row["real"], np.uint8) > 0
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.raw = zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=max(1, row["n_bytes"]))

    def text(self, k: int) -> bytes:
        return self.raw[self.begin[k] : self.begin[k] + self.sizes[k]]

    def anchors(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, text, first window and number of windows of each anchor."""
        found = []
        for k in np.flatnonzero(self.real & (self.sizes >= length)).tolist():
            h, first, n = anchors_of(self.text(k), length)
            found.append((h, np.full(len(h), k, np.int32), first, n))
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate([x[c] for x in found]) for c in range(4))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each key, from rows sorted by it; those with a key below 0 one by one."""
    held, current = [], None
    for row in _rows(batches):
        if held and (row[key] != current or current < 0):
            yield current, held
            held = []
        current = row[key]
        held.append(row)
    if held:
        yield current, held


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows of a bucket together; a partition for each bucket, up to some thousands."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionById(min(buckets, max(least, 10_000)), F.col("bucket")).sortWithinPartitions("bucket")


# --- which anchors are shared ---------------------------------------------------------------------------------------

_HELD = "bucket int, chunk long, hashes binary, counts binary"
_ANSWERS = "chunk long, bucket int, shared binary, hot binary"


def shared_anchors(table: DataFrame, length: int, buckets: int) -> DataFrame:
    """chunk, bucket, shared, hot: for each bucket's part of the sorted anchor hashes of a chunk a bit for those that
    another document holds too, and for those that more than COLD documents do."""
    held, answers = arrow_schema(_HELD), arrow_schema(_ANSWERS)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row)
            hashes, which, _, _ = chunk.anchors(length)
            own = chunk.docs[which]
            order = np.lexsort((own, hashes))
            hashes, own = hashes[order], own[order]
            once = _runs(hashes, own)[:-1]  # a document counts once
            hashes = hashes[once]
            starts = _runs(hashes)
            counts = np.minimum(np.diff(starts), 255).astype(np.uint8)
            hashes = hashes[starts[:-1]]
            out: dict = {f.name: [] for f in held}
            for bucket, part in _parts(_bucket(hashes, buckets)):
                value = hashes[part] >> np.uint64(24)
                values = bucket, chunk.name, _planes(np.diff(value, prepend=np.uint64(0))), counts[part].tobytes()
                for k, v in zip(out, values, strict=True):
                    out[k].append(v)
            yield record_batch(out, held)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _groups(batches, "bucket"):
            values = [np.cumsum(_unplanes(r["hashes"], "<u8"), dtype=np.uint64) for r in rows]
            ends = np.cumsum([len(v) for v in values])
            value = np.concatenate(values)
            n = np.frombuffer(b"".join(r["counts"] for r in rows), np.uint8).astype(np.int64)
            order = np.argsort(value, kind="stable")
            starts = _runs(value[order])
            total = np.empty(len(value), np.int64)
            total[order] = np.repeat(np.add.reduceat(n[order], starts[:-1]), np.diff(starts))
            out: dict = {f.name: [] for f in answers}
            for r, a, z in zip(rows, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                own = total[a:z]
                if (own > 1).any():
                    bits = (r["chunk"], bucket, np.packbits(own > 1).tobytes(), np.packbits(own > COLD).tobytes())
                    for k, v in zip(out, bits, strict=True):
                        out[k].append(v)
            yield record_batch(out, answers)

    return _dealt(table.mapInArrow(tidy(give), _HELD), buckets).mapInArrow(tidy(answer), _ANSWERS)


# --- suffix sorting -------------------------------------------------------------------------------------------------


def deep_shallow_sort(buf: np.ndarray, at: np.ndarray, size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings of a padded array that start at the given places and have these sizes, by size and bytes;
    and where in this order a new string begins, and the end."""
    n = len(at)
    size = np.broadcast_to(np.asarray(size, np.int64), n)
    words = words_at(buf)
    order = np.argsort(size, kind="stable")
    starts = _runs(size[order])
    group = np.repeat(starts[:-1], np.diff(starts))
    one = len(starts) <= 2
    shallow = min(SHALLOW, int(size.min(initial=1 << 60)) // 8 * 8)
    active = np.arange(n)  # places in the order whose group has several members
    for depth in range(0, shallow if n else 0, 8):  # multikey quicksort, a symbol of eight bytes a level, all groups at once
        symbol = words[at[order[active]] + depth].astype(np.uint64)
        moved = np.argsort(symbol) if one and not depth else np.lexsort((symbol, group[active]))
        order[active] = order[active][moved]
        symbol = symbol[moved]
        starts = _runs(group[active], symbol)
        group[active] = np.repeat(active[starts[:-1]], np.diff(starts))
        active = active[np.repeat(np.diff(starts) > 1, np.diff(starts))]
    active = active[size[order[active]] > shallow]
    while len(active):  # blind tries over what still agrees
        left = size[order[active]] - shallow
        pivot = at[order[group[active]]] + shallow
        own = at[order[active]] + shallow
        lcp = left.copy()
        alive = np.arange(len(active))
        for d in range(0, int(left.max()), 8):
            alive = alive[left[alive] > d]
            # compare eight bytes at a time; the last word reaches back so that it ends with the string
            width = np.minimum(left[alive], 8)
            place = np.where(width < 8, d, np.minimum(d, left[alive] - 8))
            bits = (words[own[alive] + place].astype(np.uint64) ^ words[pivot[alive] + place].astype(np.uint64)) >> (np.uint64(8) * (np.uint64(8) - width.astype(np.uint64)))
            differ = bits != 0
            if differ.any():
                bits = bits[differ]
                upper = bits >> np.uint64(32)
                half = np.where(upper > 0, upper, bits & np.uint64(0xFFFFFFFF)).astype(np.float64)
                high = np.frexp(half)[1] - 1 + np.where(upper > 0, 32, 0)  # the highest bit that differs
                lcp[alive[differ]] = (place + width - 1)[differ] - high // 8
                alive = alive[~differ]
        equal = lcp >= left
        safe = np.minimum(lcp, left - 1)
        byte, base = buf[own + safe], buf[pivot + safe]
        # before the first member: what leaves earliest; after it: what leaves latest
        rank = np.where(equal, 0, np.where(byte < base, lcp - left - 1, left + 1 - lcp))
        moved = np.lexsort((byte, rank, group[active]))
        order[active] = order[active][moved]
        rank, byte, equal = rank[moved], np.where(equal[moved], 0, byte[moved]), equal[moved]
        starts = _runs(group[active], rank, byte)
        sizes = np.diff(starts)
        group[active] = np.repeat(active[starts[:-1]], sizes)
        active = active[np.repeat(sizes > 1, sizes) & ~equal]
    return order, _runs(group)


def least_of(order: np.ndarray, starts: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The smallest doc of the string that each element is, given their order and where strings begin."""
    least = np.empty(len(doc), np.int64)
    if len(doc):
        least[order] = np.repeat(np.minimum.reduceat(doc[order], starts[:-1]), np.diff(starts))
    return least


def joined(which: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of texts, joined where they touch, in order."""
    order = np.lexsort((start, which))
    which, start, stop = which[order], start[order], stop[order]
    if not len(which):
        return which, start, stop
    shift = which.astype(np.int64) * (int(stop.max()) + 2)  # texts stand apart
    reach = np.maximum.accumulate(stop + shift)
    new = np.concatenate([[True], (start + shift)[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return which[at], start[at], (reach - shift)[np.append(at[1:], len(which)) - 1]


# --- cuts -----------------------------------------------------------------------------------------------------------

_CUTS = "bucket int, chunk long, hashes binary, sizes binary, docs binary, members binary, which binary, start binary, bytes binary"
_SPANS = "chunk long, which binary, start binary, stop binary"


def shared_cuts(table: DataFrame, answers: DataFrame, length: int, buckets: int) -> DataFrame:
    """Blobs of cuts by bucket: hash, size, doc and number of members of each, and text and place of each member; under
    buckets below 0 the spans that are settled already (which, start, and stop as sizes)."""
    target = arrow_schema(_CUTS)
    by_chunk = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "shared", "hot")).alias("answers"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for row in _rows(batches):
            chunk = Chunk(row)
            hashes, which, first, n = chunk.anchors(length)
            unique, inverse = np.unique(hashes, return_inverse=True)
            bucket = _bucket(unique, buckets)
            shared, hot = np.zeros(len(unique), bool), np.zeros(len(unique), bool)
            for a in row["answers"]:
                lo, hi = np.searchsorted(bucket, [a["bucket"], a["bucket"] + 1])
                shared[lo:hi] = np.unpackbits(np.frombuffer(a["shared"], np.uint8), count=hi - lo)
                hot[lo:hi] = np.unpackbits(np.frombuffer(a["hot"], np.uint8), count=hi - lo)
            buf = padded(chunk.raw)
            keep = shared[inverse]
            hot, hashes, which, first, n = (hot[inverse])[keep], hashes[keep], which[keep], first[keep], n[keep]
            if hot.any():  # single windows, dealt by their bytes
                each = np.where(hot, n, 1)
                inner = _within(each)
                hot, hashes, which, first, n = (np.repeat(x, each) for x in (hot, hashes, which, first, n))
                first, n = np.where(hot, first + inner, first), np.where(hot, 1, n)
                at = chunk.begin[which] + first
                hashes = np.where(hot, range_hashes(buf, at, at + length), hashes)
            at, size, doc = chunk.begin[which] + first, n + length - 1, chunk.docs[which]
            order, strings = deep_shallow_sort(buf, at, size)
            least = least_of(order, strings, doc)
            gone = doc > least
            out: dict = {f.name: [] for f in target}
            if gone.any():
                spans = joined(which[gone], first[gone], (first + size)[gone])
                values = -1 - chunk.name % (1 << 20), chunk.name, b"", _planes(spans[2]), b"", b"", _planes(spans[0]), _planes(spans[1]), b""
                for k, v in zip(out, values, strict=True):
                    out[k].append(v)
            # what stays, string by string: all its members are of one doc
            stays = ~gone[order]
            number, order = np.repeat(np.arange(len(strings) - 1), np.diff(strings))[stays], order[stays]
            starts = _runs(number)
            heads, members = order[starts[:-1]], np.diff(starts)
            dealt = np.argsort(_bucket(hashes[heads], buckets), kind="stable")
            for k, part in _parts(_bucket(hashes[heads], buckets)[dealt]):
                some = dealt[part]
                one = heads[some]
                every = order[np.repeat(starts[some], members[some]) + _within(members[some])]
                text = b"".join(chunk.raw[a:z] for a, z in zip(at[one].tolist(), (at + size)[one].tolist(), strict=True))
                values = (
                    k, chunk.name, _planes(hashes[one]), _planes(size[one].astype(np.int32)), _planes(doc[one]), _planes(members[some].astype(np.int32)),
                    _planes(which[every]), _planes(first[every]), pack.compress(text),
                )
                for f, v in zip(out, values, strict=True):
                    out[f].append(v)
            yield record_batch(out, target)

    return table.join(by_chunk, "chunk").mapInArrow(tidy(cut), _CUTS)


def gone_windows(buf: np.ndarray, at: np.ndarray, size: np.ndarray, doc: np.ndarray, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of strings that are sorted by the hash of their anchor: number of the string, start and stop of its runs of
    windows that a smaller doc has too. Only windows of one hash can be equal, so some hashes are sorted at a time."""
    n = size - length + 1
    cuts = _runs(hashes)
    upto = np.concatenate([[0], np.cumsum(n)])[cuts]
    found, k = [(np.zeros(0, np.int64),) * 3], 0
    while k < len(cuts) - 1:
        end = max(k + 1, int(np.searchsorted(upto, upto[k] + WINDOWS, "right")) - 1)
        own = np.arange(cuts[k], cuts[end])
        owner, inner = np.repeat(own, n[own]), _within(n[own])
        order, strings = deep_shallow_sort(buf, at[owner] + inner, length)
        place = np.flatnonzero(doc[owner] > least_of(order, strings, doc[owner]))
        runs = _runs(owner[place], place - np.arange(len(place)))
        a, z = place[runs[:-1]], place[runs[1:] - 1]
        found.append((owner[a], inner[a], inner[z] + length))
        k = end
    return tuple(np.concatenate([x[c] for x in found]) for c in range(3))


def repeated_spans(cuts: DataFrame, length: int, buckets: int) -> DataFrame:
    """chunk, which, start, stop: what is removed from texts of a chunk, from blobs of cuts."""
    target = arrow_schema(_SPANS)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _groups(batches, "bucket"):
            if bucket < 0:
                r = rows[0]
                yield record_batch({"chunk": [r["chunk"]], "which": [_unplanes(r["which"], "<i4").tobytes()], "start": [_unplanes(r["start"], "<i8").tobytes()], "stop": [_unplanes(r["sizes"], "<i8").tobytes()]}, target)
                continue
            every = lambda name, kind: np.concatenate([_unplanes(r[name], kind) for r in rows])  # noqa: B023, E731
            hashes, size, doc, members = every("hashes", "<u8"), every("sizes", "<i4").astype(np.int64), every("docs", "<i8"), every("members", "<i4")
            unpack = zstandard.ZstdDecompressor()
            buf = padded(b"".join(unpack.decompress(r["bytes"]) for r in rows))
            at = np.cumsum(size) - size
            order, strings = deep_shallow_sort(buf, at, size)
            least = least_of(order, strings, doc)
            # of each string one, where its anchor has several strings and holds several windows
            one = order[strings[:-1]]
            one = one[np.argsort(hashes[one], kind="stable")]
            kinds = np.diff(_runs(hashes[one]))
            one = one[np.repeat(kinds > 1, kinds)]
            run_owner, run_start, run_stop = gone_windows(buf, at[one], size[one], least[one], hashes[one], length)
            # every cut: whole where a smaller doc has it, else the runs of its string
            string = np.empty(len(at), np.int64)
            string[order] = np.repeat(np.arange(len(strings) - 1), np.diff(strings))
            of = np.full(len(strings) - 1, -1)
            of[string[one]] = np.arange(len(one))
            number = np.where(doc > least, -1, of[string])
            first_run = np.searchsorted(run_owner, np.arange(len(one) + 1))
            n_runs = np.where(doc > least, 1, np.where(number >= 0, np.diff(first_run, append=0)[:-1][np.maximum(number, 0)] if len(one) else 0, 0))
            cut = np.repeat(np.arange(len(at)), n_runs)
            run = np.where(number[cut] >= 0, first_run[np.maximum(number[cut], 0)] + _within(n_runs), -1)
            some = lambda values, other: np.where(run >= 0, values[np.maximum(run, 0)] if len(values) else 0, other)  # noqa: B023, E731
            low, high = some(run_start, 0), some(run_stop, size[cut])
            # and all its members
            m = members[cut].astype(np.int64)
            member = np.repeat((np.cumsum(members) - members)[cut], m) + _within(m)
            which, start = every("which", "<i4")[member], every("start", "<i8")[member]
            chunk = np.repeat(np.arange(len(rows)), [len(r["sizes"]) // 4 for r in rows])[np.repeat(cut, m)]
            low, high = start + np.repeat(low, m), start + np.repeat(high, m)
            out: dict = {f.name: [] for f in target}
            ordered = np.argsort(chunk, kind="stable")
            for k, part in _parts(chunk[ordered]):
                some_of = ordered[part]
                spans = joined(which[some_of], low[some_of], high[some_of])
                values = rows[k]["chunk"], spans[0].astype(np.int32).tobytes(), spans[1].tobytes(), spans[2].tobytes()
                for name, v in zip(out, values, strict=True):
                    out[name].append(v)
            yield record_batch(out, target)

    return _dealt(cuts, buckets).mapInArrow(tidy(sort), _SPANS)


# --- the operator ---------------------------------------------------------------------------------------------------

OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, *, length: int = 50, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal runs removed), kept_sha256 for each row; with with_text also kept
    (the bytes that are left)."""
    table = staged(chunks(docs), "suffix-chunks")
    # the number of buckets follows the input, so that one holds some MB
    size = table.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    buckets = max(-(-size // BUCKET), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    answers = staged(shared_anchors(table, length, buckets), "suffix-answers")
    spans = staged(repeated_spans(shared_cuts(table, answers, length, buckets), length, buckets), "suffix-spans")
    discard(answers)
    by_chunk = spans.groupBy("chunk").agg(F.collect_list(F.struct("which", "start", "stop")).alias("spans"))
    schema = OUT + (", kept binary" if with_text else "")
    target = arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row)
            every = [np.concatenate([np.frombuffer(x[c], kind) for x in row["spans"] or []] or [np.zeros(0, kind)]) for c, kind in (("which", "<i4"), ("start", "<i8"), ("stop", "<i8"))]
            which, start, stop = joined(*every)
            removed = np.bincount(which, stop - start, len(chunk.docs)).astype(np.int64)
            n_spans = np.bincount(which, minlength=len(chunk.docs))
            ends = np.cumsum(n_spans)
            start, stop = start.tolist(), stop.tolist()
            for lo in range(0, len(chunk.docs), 4096):
                texts = []
                for k in range(lo, min(lo + 4096, len(chunk.docs))):
                    text, at, left = chunk.text(k), 0, []
                    for i in range(ends[k] - n_spans[k], ends[k]):
                        left.append(text[at : start[i]])
                        at = stop[i]
                    texts.append(b"".join([*left, text[at:]]) if left else text)
                part = slice(lo, lo + 4096)
                out = {
                    "doc_id": pa.array(chunk.docs[part], mask=~chunk.real[part]), "n_bytes": chunk.sizes[part], "n_removed": removed[part],
                    "n_spans": n_spans[part], "kept_sha256": [hashlib.sha256(t).hexdigest() for t in texts], "kept": texts,
                }
                yield record_batch(out, target)

    return table.join(by_chunk, "chunk", "left").mapInArrow(tidy(cut), schema)
