"""What the training-data operators share: staged tables, whole-text access, word splitting."""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stage import discard, staged  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space; bytes from 0x80 on stay.
ALNUM_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. lower() has a fast path for pure ASCII, where it means the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def blobs(column: pa.Array) -> list:
    """UTF-8 bytes of a string column, None where it is null."""
    return column.cast(pa.large_binary()).to_pylist()


_kept: dict[tuple[Callable, str], object] = {}


def kept(make: Callable, path: str):
    """make(path), which a Python worker keeps from task to task until it is given one that does not need it."""
    if (make, path) not in _kept:
        _kept[make, path] = make(path)
    return _kept[make, path]


def let_go(keeps: Callable | None) -> None:
    """Forgets what is kept, but for what `keeps` made."""
    if others := [k for k in _kept if k[0] is not keeps]:
        for key in others:
            del _kept[key]
        gc.collect()  # what was kept may refer to itself


def tidy(run: Callable, keeps: Callable | None = None) -> Callable:
    """A function over Arrow batches that gives unused memory back to the system: when a task ends, and at its start what
    other operators have `kept`. Python workers live on from task to task, and what they once held would add up."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc = _libc()
        let_go(keeps)
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if libc:
            libc.malloc_trim(0)

    return tidied


@cache
def _libc() -> ctypes.CDLL | None:
    """The C library, if it is one that can be told to map large blocks apart, so that they go back at once."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD
        return libc if hasattr(libc, "malloc_trim") else None
    except (OSError, AttributeError):
        return None


#: Bytes of an Arrow batch from an executor to a Python worker, about.
ARROW_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From the session's next query on, workers get their rows in Arrow batches of some ARROW_BYTES. Executor and worker both
    hold a whole batch, with Spark's 10,000 rows 35 MB of texts, and twice that while it grows; freed blocks of that size
    don't all go back to the system. A setting of the session's own stays. Results don't depend on it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(ARROW_BYTES))


def map_batches(df: DataFrame, rows: Callable[[pa.RecordBatch], dict], schema: str, keeps: Callable | None = None) -> DataFrame:
    """mapInArrow with one output batch, given as columns by name, for each part of an input batch. keeps: what makes the
    things that `rows` has `kept`."""
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield record_batch(rows(part), target)

    return df.mapInArrow(tidy(run, keeps), schema)


def slices(batch: pa.RecordBatch, rows: int = 1000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most so many rows, and so many bytes of texts or one row, so that what is made from one at
    a time stays small."""
    long = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
    sizes = sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in long), np.zeros(batch.num_rows, np.int64))
    upto = np.cumsum(sizes)
    k = 0
    while k < batch.num_rows:
        end = int(np.searchsorted(upto, (upto[k - 1] if k else 0) + size, "right"))
        n = max(1, min(rows, end - k))
        yield batch.slice(k, n)
        k += n


def keep_rows(df: DataFrame, keep: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The rows of df for which keep gives true, with all columns as they are; nothing moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(keep(part), pa.bool_()))

    return df.mapInArrow(tidy(run), df.schema)


#: Bits of a sieve: so many for each key, a power of two within these; 2**30 bits are 128 MB.
BITS_A_KEY, LEAST_BITS, MOST_BITS = 64, 1 << 15, 1 << 30
_ROW_BITS = 1 << 15  # what bitmap_construct_agg holds


class Sieve:
    """A set of hashed keys as a bitmap, which tells of most rows that they match no key, before any shuffle.

    It takes 64 to 128 bits a key, so it passes at most one row in 64 that matches none, and has at most MOST_BITS bits:
    that is the proven bound of what is broadcast, 32768 rows of 4 KB. With more than 16 million keys more rows pass (one
    in 16 with 67 million, nearly all with some billions); the join behind the sieve decides, so that costs time and loses
    nothing. Null is a key like others."""

    def __init__(self, keys: DataFrame, key: str):
        """keys: a staged table, which is counted first."""
        wanted = max(1, keys.count() * BITS_A_KEY - 1)
        self.bits = min(max(1 << wanted.bit_length(), LEAST_BITS), MOST_BITS)
        at, bit = self._place(F.col(key))
        self.table = F.broadcast(keys.groupBy(at.alias("sieve_at")).agg(F.bitmap_construct_agg(bit).alias("sieve_bits")))

    def _place(self, key: Column) -> tuple[Column, Column]:
        slot = F.xxhash64(key).bitwiseAND(F.lit(self.bits - 1).cast("long"))
        return F.shiftright(slot, 15).cast("int"), slot.bitwiseAND(_ROW_BITS - 1).cast("int")

    def _held(self, key: Column) -> Column:
        at, bit = self._place(key)
        byte = F.conv(F.hex(F.substr(self.table["sieve_bits"], F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
        return (at == self.table["sieve_at"]) & (F.getbit(byte, bit.bitwiseAND(7)) == 1)

    def passed(self, rows: DataFrame, key: Column) -> DataFrame:
        """The rows that may match a key."""
        return rows.join(self.table, self._held(key), "left_semi")

    def held_back(self, rows: DataFrame, key: Column) -> DataFrame:
        """All other rows."""
        return rows.join(self.table, self._held(key), "left_anti")


def text_key(text: Column) -> Column:
    """128-bit hash of a text; null is a key of its own."""
    return F.unhex(F.md5(text.cast("binary")))


def without(docs: DataFrame, gone: DataFrame, key: Callable[[Column], Column] = text_key) -> DataFrame:
    """The rows of docs whose doc_id and key of the text are not together in gone (gone_id, gone_key), with all their
    columns; null equals null. Only rows whose doc_id passes a sieve of the gone ones are shuffled."""
    gone = staged(gone.select("gone_id", "gone_key").distinct(), "gone")
    sieve = Sieve(gone, "gone_id")
    maybe = sieve.passed(docs, docs["doc_id"])
    both = maybe["doc_id"].eqNullSafe(gone["gone_id"]) & key(maybe["text"]).eqNullSafe(gone["gone_key"])
    return sieve.held_back(docs, docs["doc_id"]).unionByName(maybe.join(gone, both, "left_anti"))


def arrow_schema(schema: str) -> pa.Schema:
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
        "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
        "array<long>": pa.list_(pa.int64()),
    }
    return pa.schema([pa.field(*(lambda n, k: (n, kinds[k]))(*f.split())) for f in schema.split(", ")])


def record_batch(columns: dict, target: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for field in target:
        value = columns[field.name]
        if isinstance(value, pa.ChunkedArray):
            value = value.combine_chunks()
        arrays.append(value.cast(field.type) if isinstance(value, pa.Array) else pa.array(value, type=field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=target)


class Memo(dict):
    """Values by key, made when first asked for. Emptied at a bound, so that it stays small for any input."""

    def __init__(self, make: Callable, bound: int = 700_000, fixed: dict | None = None):
        super().__init__(fixed or {})
        self.make, self.bound, self.fixed = make, bound, fixed or {}

    def __missing__(self, key):
        if len(self) >= self.bound + len(self.fixed):
            self.clear()
            self.update(self.fixed)
        value = self[key] = self.make(key)
        return value


# --- whole batches of texts as arrays -------------------------------------------------------------------------------

def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts, joined into one array of bytes: runs of bytes that `table` marks as 1."""

    def __init__(self, texts: list[bytes], table: np.ndarray):
        self.raw = b" ".join(texts) + b" "
        self.buf = padded(self.raw)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.concatenate([[0], np.cumsum(sizes + 1)])
        inside = np.zeros(len(self.raw) + 1, np.int8)
        inside[1:] = table[self.buf[: len(self.raw)]]
        edges = np.flatnonzero(np.diff(inside))
        self.starts, self.ends = edges[::2], edges[1::2]
        #: words of text r: first[r] to first[r + 1]
        self.first = np.searchsorted(self.starts, self.begin)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return range_hashes(self.buf, starts, ends)


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer byte ranges are hashed one by one.
_LONG = 1024


def padded(raw: bytes) -> np.ndarray:
    """Bytes as an array with eight zeros behind them, which `range_hashes` needs to read whole words."""
    return np.frombuffer(raw + bytes(8), np.uint8)


def word_blocks(buf: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on, little-endian; a view."""
    return np.ndarray((max(len(buf) - 7, 0),), "<u8", buf, strides=(1,))


def range_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges of a padded array. Eight bytes at a time are mixed in, each step not linear, so that
    no regular pattern of letters (as Thue-Morse words for sums of powers) makes hashes agree."""
    words, left = word_blocks(buf), ends - starts
    h = mix64(left.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    h = mix64(h ^ (words[starts] & _MASKS[np.minimum(left, 8)]))
    at = np.flatnonzero(left > 8)
    done = 8
    while len(at):
        if done >= _LONG:
            for k in at.tolist():
                h[k] = int.from_bytes(hashlib.blake2b(buf[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
            break
        block = words[starts[at] + done] & _MASKS[np.minimum(left[at] - done, 8)]
        h[at] = mix64(h[at] * np.uint64(0xD6E8FEB86659FD93) + block)
        done += 8
        at = at[left[at] > done]
    return h


def runs_of(texts: list[bytes], limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of rows with up to `limit` bytes together, or one row."""
    lo, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, k
            lo, size = k, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def byte_table(inside: Callable[[int], bool]) -> np.ndarray:
    return np.array([inside(b) for b in range(256)], np.int8)


#: Words are what stands between ASCII white space.
NOT_SPACE = byte_table(lambda b: b not in b" \t\n\x0b\x0c\r")
#: ASCII letters and digits, and all that is not ASCII.
ALNUM = byte_table(lambda b: b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)
