"""Packing along a space-filling curve.

Documents become token ids. Their counts, hashed into DIMS cells and scaled to length one, are projected to AXES
dimensions by fixed random signs, put on a grid, and numbered along a Hilbert curve, so that documents near on the curve
use like words. The curve is cut into ranges of about equal numbers of ids; each range is sorted by Hilbert key and
laid end to end with the others, and sequences are cut from that line every `length` ids. A document's ids stay in one
piece but where a sequence ends. What is left at the end of the line goes to sequences of powers of two, which need no
padding, so that no id of padding is added at all.

Ids are written once, as a table in the shared folder. Where ranges end is found from sums of ids by cells of the curve:
2**CELL_BITS cells, and where a cell holds more than a range should, finer ones. Places on the line come from sums by
range, and one shuffle gives each range a partition of its own. The key ends with bits hashed from doc_id, so documents
with one Hilbert key, such as many copies, split over ranges as any others do. The driver holds one number for each
range; there are at most MOST_RANGES, beyond which ranges grow with the input. A task streams its range, so its memory
is that of a batch for a range of any size.

Fast ids: the tokenizer drops white space, lower-cases, and encodes pre-tokens apart: runs of letters, single digits,
runs of other characters. For ASCII text and the letters U+00C0 to U+00FF these are found with arrays over a whole
batch, each distinct pre-token is encoded once by the library and remembered by its bytes; a text with other characters,
with an apostrophe or a special token's string goes to the library whole. Equal pre-tokens of a batch are found by hash
and their bytes compared; a text with one whose bytes differ goes to the library too.

Defined results: null text counts as empty; an empty text is the end id alone. Rows that repeat a doc_id are packed
each. Rows without doc_id are packed too. A very long text is cut wherever a sequence ends. Extra columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, blobs, kept, map_batches, mix64, padded, range_hashes, record_batch, runs_of, slices, staged, tidy, word_blocks

LENGTH, END = 2048, 1
DIMS, AXES, BITS = 1024, 4, 10
#: Pre-tokens that a process remembers. With 600,000 of them a worker took 230 MB, and as many as cores share an executor.
KNOWN = 200_000
CELL_BITS, MOST_RANGES = 16, 1 << 16
#: Bits of the key below the Hilbert number, hashed from doc_id.
LOW = 63 - AXES * BITS

_LETTER, _DIGIT, _OTHER, _BAD = 1, 2, 3, 4
_CLASS = bytes(
    0 if b in b" \t\n\x0b\x0c\r" else _DIGIT if 48 <= b <= 57 else _LETTER if 65 <= b <= 90 or 97 <= b <= 122
    else _BAD if b == 39 or b < 32 or b == 127 else _OTHER if b < 128 else _LETTER if b == 0xC3 or b < 0xC0 else _BAD
    for b in range(256)
)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Encoder:
    """Ids of whole texts as the library gives them, without special tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.plain = all(not t.content.isalnum() and "<" in t.content for t in self.library.get_added_tokens_decoder().values())
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for w, i in self.library.get_vocab().items() if w.endswith("</w>")]] = True
        self.reset()

    def reset(self) -> None:
        """Forgets all pre-tokens. By number: `words` holds their bytes from `at` on, `flat` their ids from `place` on;
        `hashes` are sorted, and `number` says whose they are."""
        self.hashes, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.words, self.at, self.length = Grown(np.uint8), Grown(np.int64), Grown(np.int32)
        self.flat, self.place, self.size = Grown(np.uint16), Grown(np.int64), Grown(np.int32)

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.library.encode(text.decode(), add_special_tokens=False).ids, np.uint16)

    def apart(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, and how many each has. A text of many at once is faster, and as the last id of each
        pre-token marks a word's end, it is cut there; if the ends don't come out even, each is encoded alone."""
        texts = [b" ".join(words[k : k + 4000]).decode() for k in range(0, len(words), 4000)]
        flat = np.array([i for e in self.library.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], np.uint16)
        ends = np.flatnonzero(self.ends[flat])
        if len(ends) == len(words) and (not len(flat) or ends[-1] == len(flat) - 1):
            return flat, np.diff(ends, prepend=-1)
        ids = [e.ids for e in self.library.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        return np.array([i for x in ids for i in x], np.uint16), np.fromiter(map(len, ids), np.int64, len(ids))

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        # words of rows that go to the library may be cut inside a character; they are never used
        flat, sizes = self.apart([w if _valid(w) else b"!" for w in words])
        numbers = np.arange(self.at.n, self.at.n + len(words), dtype=np.int32)
        self.place.add(self.flat.n + np.cumsum(sizes) - sizes)
        self.size.add(sizes)
        self.flat.add(flat)
        length = np.fromiter(map(len, words), np.int64, len(words))
        self.at.add(self.words.n + np.cumsum(length) - length)
        self.length.add(length)
        self.words.add(np.frombuffer(b"".join(words), np.uint8))
        where = np.searchsorted(self.hashes, hashes)
        self.hashes, self.number = np.insert(self.hashes, where, hashes), np.insert(self.number, where, numbers)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of pre-tokens by sorted hashes, -1 for those that are not known."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.number[at], np.int32(-1))

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for lo, hi in runs_of(texts):
            out += self.some(texts[lo:hi])
        return out

    def some(self, texts: list[bytes]) -> list[np.ndarray]:
        raw = b" ".join(texts) + b" "
        buf = np.frombuffer(raw, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.concatenate([[0], np.cumsum(sizes + 1)])
        kind = np.frombuffer(raw.translate(_CLASS), np.uint8)
        low = np.frombuffer(raw.translate(_LOWER), np.uint8)
        bad = kind == _BAD
        if not raw.isascii():
            follow = np.zeros(len(buf), bool)
            follow[1:] = buf[:-1] == 0xC3
            # letters are C3 80 to C3 BF but for the signs C3 97 and C3 B7; other characters go to the library
            bad |= (buf - np.uint8(0x80) < 0x40) ^ follow
            bad |= follow & ((buf == 0x97) | (buf == 0xB7))
            low = low + (follow & (buf <= 0x9E)) * np.uint8(32)
        # a special token's string starts with <|
        bad[:-1] |= (buf[:-1] == 60) & (buf[1:] == 124)
        rows_bad = np.zeros(len(texts), bool)
        rows_bad[np.searchsorted(begin, np.flatnonzero(bad), "right") - 1] = True
        edge = np.ones(len(buf) + 1, bool)
        edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        cuts = np.flatnonzero(edge)
        starts, ends = cuts[:-1], cuts[1:]
        real = kind[starts] > 0
        starts, ends = starts[real], ends[real]
        flat = low.tobytes()
        low = padded(flat)
        hashes, where, inverse = np.unique(range_hashes(low, starts, ends), return_index=True, return_inverse=True)
        if self.at.n + len(where) > KNOWN:
            self.reset()
        a, z = starts[where], ends[where]
        if len(new := np.flatnonzero(self.numbers(hashes) < 0)):
            self.learn(hashes[new], [flat[i:j] for i, j in zip(a[new].tolist(), z[new].tolist(), strict=True)])
        number = self.numbers(hashes)
        # equal hashes are taken for equal words only where their bytes agree, in this batch and with what is known
        at, length = self.at.values[number], self.length.values[number]
        wrong = unlike(low, a, z, self.words.values, at, at + length)[inverse]
        wrong |= unlike(low, starts, ends, low, a[inverse], z[inverse])
        rows_bad[np.searchsorted(begin, starts[wrong], "right") - 1] = True
        index = number[inverse]
        size, place = self.size.values[index].astype(np.int64), self.place.values[index]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat.values[np.arange(total[-1]) + np.repeat(place - total[:-1], size)]
        first = total[np.searchsorted(starts, begin)]
        return [
            self.whole(texts[r]) if rows_bad[r] or not self.plain else ids[first[r] : first[r + 1]]
            for r in range(len(texts))
        ]


class Grown:
    """An array that grows; there is always room for eight bytes behind its end."""

    def __init__(self, kind: type):
        self.values, self.n = np.zeros(1 << 16, kind), 0

    def add(self, more: np.ndarray) -> None:
        while self.n + len(more) + 8 > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.values[self.n : self.n + len(more)] = more
        self.n += len(more)


def unlike(x: np.ndarray, a: np.ndarray, z: np.ndarray, y: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which byte ranges a to z of a padded array x differ from the ranges b to c of y."""
    left, right, size = word_blocks(x), word_blocks(y), z - a
    differ = size != c - b
    at = np.flatnonzero((size > 0) & ~differ & ((a != b) | (x is not y)))
    done = 0
    while len(at):
        shift = np.uint64(8) * (np.uint64(8) - np.minimum(size[at] - done, 8).astype(np.uint64))
        differ[at] |= ((left[a[at] + done] ^ right[b[at] + done]) << shift) != 0
        done += 8
        at = at[size[at] > done]
    return differ


def _valid(word: bytes) -> bool:
    try:
        word.decode()
    except UnicodeDecodeError:
        return False
    return True


def encoder(path: str) -> Encoder:
    return kept(Encoder, path)


_RNG = np.random.default_rng(7)
_CELL = _RNG.integers(0, DIMS, 1 << 16)
_SIGNS = _RNG.choice([-1.0, 1.0], (DIMS, AXES))


def project(ids: np.ndarray) -> np.ndarray:
    """Places on the grid, one for each axis."""
    counts = np.sqrt(np.bincount(_CELL[ids], minlength=DIMS))
    norm = np.sqrt((counts * counts).sum())
    p = counts @ _SIGNS / norm if norm else np.zeros(AXES)
    return np.clip((p + 3.0) / 6.0 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Numbers along the Hilbert curve of rows of grid places (Skilling's transform)."""
    x = points.T.copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) > 0
            t = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, key, n (ids with the end), ids (16-bit little-endian)."""

    def run(batch: pa.RecordBatch) -> dict:
        found = encoder(path)([b or b"" for b in blobs(batch.column(1))])
        ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        place = hilbert(np.array([project(x) for x in found]).reshape(-1, AXES))
        salt = (mix64(ids.astype(np.uint64)) >> np.uint64(64 - LOW)).astype(np.int64)
        return {
            "doc_id": batch.column(0),
            "key": (place << LOW) | salt,
            "n": [len(x) + 1 for x in found],
            "ids": [np.append(x, np.uint16(END)).astype("<u2").tobytes() for x in found],
        }

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, key long, n long, ids binary", keeps=Encoder)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def sequence_at(place: int, total: int, length: int) -> tuple[int, int, int]:
    """Sequence, offset in it and its size, for a place on a line of `total` ids."""
    full = total // length
    if place < full * length:
        return place // length, place % length, length
    rest, at, number = total - full * length, full * length, full
    while True:
        size = 1 << (rest.bit_length() - 1)
        if place < at + size:
            return number, place - at, size
        rest, at, number = rest - size, at + size, number + 1


def range_ends(table: DataFrame, per_range: int) -> list[int]:
    """Keys at which new ranges begin, so that a range holds about `per_range` ids of the table (key, n): from sums by
    cells, and by finer cells of those that hold more."""
    bits = 63
    low = bits - CELL_BITS
    sums = table.groupBy(F.shiftright("key", low).alias("cell")).agg(F.sum("n").alias("n")).collect()  # 2**CELL_BITS at most
    cells = {r["cell"] << low: (r["n"], low) for r in sums}
    while low and (heavy := [(k >> b) for k, (n, b) in cells.items() if n > per_range and b == low]):
        # fewer cells are heavy than there are ranges
        step = min(8, low)
        some = table.sparkSession.createDataFrame([(c,) for c in heavy], "cell long")
        rows = table.withColumn("cell", F.shiftright("key", low)).join(F.broadcast(some), "cell", "left_semi")
        for c in heavy:
            del cells[c << low]
        low -= step
        for r in rows.groupBy(F.shiftright("key", low).alias("cell")).agg(F.sum("n").alias("n")).collect():
            cells[r["cell"] << low] = (r["n"], low)
    ends, held = [], 0
    for key, (n, _) in sorted(cells.items()):
        if held and held + n > per_range:
            ends.append(key)
            held = 0
        held += n
    return ends


def pack(docs: DataFrame, path: str, *, length: int = LENGTH, per_range: int = 4_000_000) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (binary).

    per_range: ids in a range of the curve, about, at most."""
    table = staged(encoded(docs, path), "packing-ids")
    total = table.agg(F.sum("n").alias("n")).first()["n"] or 0
    # as many ranges as there are partitions, at least, if a range then has enough to fill sequences
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = max(min(per_range, max(total // least, 16 * length)), total // MOST_RANGES)
    edges = np.array(range_ends(table, size), np.int64)
    target = arrow_schema("doc_id long, key long, n long, ids binary, range int")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = dict(zip(b.schema.names, b.columns, strict=True))
            yield record_batch(cols | {"range": np.searchsorted(edges, cols["key"].to_numpy(), "right").astype(np.int32)}, target)

    ranged = table.mapInArrow(tidy(put), "doc_id long, key long, n long, ids binary, range int")
    keys = table.select("key", "n").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array(np.searchsorted(edges, b.column(0).to_numpy(), "right").astype(np.int32)), b.column(1)], ["range", "n"]) for b in batches), "range int, n long")
    sums = {r["range"]: r["n"] for r in keys.groupBy("range").agg(F.sum("n").alias("n")).collect()}
    offsets = np.concatenate([[0], np.cumsum([sums.get(k, 0) for k in range(len(edges))])]).astype(np.int64).tolist()

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, place = None, 0
        for b in (part for batch in batches for part in slices(batch)):
            out: list[tuple] = []
            ids_out: list[bytes] = []
            rows = zip(*(b.column(k).to_pylist() for k in range(5)), strict=True)
            for doc, _, n, ids, part in rows:
                if part != current:
                    current, place = part, offsets[part]
                wide = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                start = 0
                while start < n:
                    number, offset, size = sequence_at(place, total, length)
                    take = min(n - start, size - offset)
                    piece = wide[4 * start : 4 * (start + take)]
                    out.append((doc, start, take, zlib.crc32(piece), n, number, offset))
                    ids_out.append(piece)
                    start, place = start + take, place + take
            if out:
                names = [f.split()[0] for f in PIECES.split(", ")]
                yield record_batch(dict(zip(names, zip(*out), strict=True)) | {"ids": ids_out}, arrow_schema(PIECES + ", ids binary"))

    return (
        ranged.repartitionById(len(edges) + 1, F.col("range"))
        .sortWithinPartitions("range", "key", "doc_id", "ids")
        .mapInArrow(tidy(lay), PIECES + ", ids binary")
    )
