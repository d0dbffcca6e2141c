"""WARC archives of pages, and a two-level capture index to read them by.

`write` turns pages into records, one gzip member each, in files of the shared folder: a response for each payload, and a
revisit in place of each further copy of a payload of MIN_REVISIT bytes or more. `build_index` sorts the captures by
their URL key (host names reversed, then path) and cuts them into compressed blocks of up to LINES lines. Of each block a
sparse directory keeps the first key and the place; of each directory, one for each range of keys, the two ends are kept
in a list of at most PARTS entries. `lookup` finds the range of a key by binary search in that list, the blocks by binary
search in the range's directory, reads them by range, and finds the captures by binary search in the block. `read`
merges neighbouring captures of a file into longer reads and takes the records apart, checking their digests.

Each step of a lookup is a shuffle of keys or places only, so a key that a third of all captures share is looked for in
many blocks by many tasks. Copies are found by SHA-256 and size on small rows (salted, so that a hot payload is dealt to
many tasks); of their pages only the URL is moved. Two sieves (`common.Sieve`) tell which pages are written in place.
Files are named by attempt: what a lost task has written is never read.

Defined results: a null payload is empty; null page_ids count in their group, and are a response only where no page with
an id has the payload. Rows that repeat a response's page_id and payload are responses as well. A null URL has the key
"-"; one without "://" is its own key; blanks and control characters in keys and headers become %XX. Very long payloads
are one record each. Extra columns are ignored. Empty tables make an empty archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sieve, arrow_schema, discard, record_batch, slices, staged, tidy
from ..files import Reader, Writer, make_folder

#: Payloads of fewer bytes are written each time.
MIN_REVISIT = 1000
#: Bytes of an archive file; lines and bytes of an index block; captures of a directory; directories at most.
FILE, LINES, BLOCK, CAPTURES, PARTS = 1 << 30, 3000, 1 << 18, 200_000, 16_384
#: Bytes of a key that lists and directories keep; keys that agree so far are told apart in the blocks.
PREFIX = 256
#: A read takes so many bytes at most, and goes on over gaps of up to GAP.
READ, GAP = 4 << 20, 1 << 16
SALTS = 32

_BLANK = re.compile(rb"[\x00-\x20\x7f]")


def quoted(text: str) -> bytes:
    return _BLANK.sub(lambda m: b"%%%02X" % m[0][0], text.encode())


def url_key(url: str | None) -> bytes:
    """com,example,www)/path?query of http://www.example.com/path?query."""
    if not url:
        return b"-"
    scheme, mark, rest = url.partition("://")
    if not mark:
        return quoted(url)
    host = re.match(r"[^/?#]*", rest)[0]
    return quoted(",".join(reversed(host.lower().split("."))) + ")" + rest[len(host) :])


# --- records --------------------------------------------------------------------------------------------------------


def record_id(page_id: int | None, sha1: bytes) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{sha1.hex()}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, sha1: bytes, refers_to: int | None, date: str) -> bytes:
    """A response, or without payload a revisit of the page refers_to."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {record_id(page_id, sha1)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {quoted(url or 'urn:none').decode()}", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}", "Content-Type: application/http;msgtype=response",
    ]
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, sha1)}"]
    head += [f"Content-Length: {len(http) + len(payload or b'')}", "", ""]
    return b"".join(("\r\n".join(head).encode(), http, payload or b"", b"\r\n\r\n"))


def parsed(data: bytes) -> dict:
    """The parts of a record: page_id, url, record_type, payload (null of a revisit), payload_bytes, payload_digest,
    refers_to. A response whose payload does not match its digest is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, body = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    kind = fields["WARC-Type"]
    if kind == "response" and (hashlib.sha1(body).digest() != digest or len(body) != size):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda x: None if x is None or (n := x.split(":")[2]) == "none" else int(n)
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": kind, "payload": body if kind == "response" else None,
        "payload_bytes": size, "payload_digest": digest.hex(), "refers_to": number(fields.get("WARC-Refers-To")),
    }


ENTRY = "key string, page_id long, file string, offset long, length long"


def _records(rows: DataFrame, folder: str, date: str, level: int) -> DataFrame:
    """Writes rows (page_id, url, payload, size, sha1, refers_to) as records, and gives the places."""
    target = arrow_schema(ENTRY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for part in (part for batch in batches for part in slices(batch)):
            found: dict[str, list] = {f.name: [] for f in target}
            for page, url, payload, size, sha1, refers in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if payload is not None:
                    size, sha1 = len(payload), hashlib.sha1(payload).digest()
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = packer.compress(record(page, url, payload, size, sha1, refers, date)) + packer.flush()
                if out is None or out.size >= FILE:
                    if out:
                        out.close()
                    out = Writer(folder, ".warc.gz")
                for name, value in zip(found, (url_key(url).decode(), page, out.name, out.write(data), len(data)), strict=True):
                    found[name].append(value)
            yield record_batch(found, target)
        if out:
            out.close()

    return rows.select("page_id", "url", "payload", "size", "sha1", "refers_to").mapInArrow(tidy(run), ENTRY)


@dataclass
class Archive:
    """A folder of WARC files, and the places of their records (key, page_id, file, offset, length)."""

    folder: str
    entries: DataFrame


def write(pages: DataFrame, folder: str, *, date: str = "1970-01-01T00:00:00Z", level: int = 4) -> Archive:
    """Writes pages (page_id, url, payload binary) to files in a new folder."""
    make_folder(folder)
    rows = pages.select("page_id", "url", F.coalesce("payload", F.lit(b"")).alias("payload"))
    sha = F.unhex(F.sha2("payload", 256))
    large = rows.where(F.octet_length("payload") >= MIN_REVISIT)
    digests = staged(
        large.select("page_id", "url", F.octet_length("payload").cast("long").alias("size"), sha.alias("sha"), F.unhex(F.sha1("payload")).alias("sha1")), "warc-digests"
    )
    groups = digests.groupBy("sha", "size").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    groups = staged(groups.where("n > 1").drop("n"), "warc-groups")
    # copies of a payload are many, so its small row goes to each salt
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    some = Sieve(groups, "sha").passed(digests, digests["sha"]).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    copies = some.join(salted, ["sha", "size", "salt"]).where(~F.col("page_id").eqNullSafe(F.col("keeper")))
    copies = staged(copies.select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "size", "sha", "sha1", F.col("keeper").alias("refers_to")), "warc-copies")
    # pages whose id is no copy's are written where they are; of the others, only those that turn out to be none are moved
    same = lambda a, b: a["page_id"].eqNullSafe(b["page_id"]) & (a["sha"] == b["sha"])
    sieve = Sieve(copies, "page_id")
    ids = digests.select("page_id", "sha")
    # small payloads are responses each, so they need no look at the copies
    doubtful = sieve.passed(ids, ids["page_id"])
    others = staged(doubtful.join(copies, same(doubtful, copies), "left_anti").distinct(), "warc-others")
    in_place = sieve.held_back(rows, rows["page_id"])
    again = sieve.passed(rows, rows["page_id"])
    small = again.where(F.octet_length("payload") < MIN_REVISIT)
    again = Sieve(others, "page_id").passed(again.where(F.octet_length("payload") >= MIN_REVISIT), again["page_id"]).withColumn("sha", sha)
    moved = again.join(others, same(again, others), "left_semi").drop("sha")
    nothing = {"size": "long", "sha1": "binary", "refers_to": "long"}
    responses = in_place.union(small).union(moved).select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in nothing.items()])
    entries = staged(_records(responses.unionByName(copies.drop("sha")), folder, date, level), "warc-entries")
    discard(digests, groups, copies, others)
    return Archive(folder, entries)


# --- index ----------------------------------------------------------------------------------------------------------


@dataclass
class Index:
    """The folder of the index, and its parts in order: first and last key (cut to PREFIX), file of blocks, directory."""

    folder: str
    parts: list[tuple[bytes, bytes, str, str]]


def build_index(archive: Archive, folder: str, *, lines_a_block: int = LINES) -> Index:
    """Captures sorted by key, in blocks with a directory for each range of keys. At most PARTS rows go to the driver."""
    make_folder(folder)
    spark = archive.entries.sparkSession
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-archive.entries.count() // CAPTURES))
    order = ["key", "page_id", "file", "offset"]
    schema = "first binary, last binary, blocks string, directory string"
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: list[bytes] = []
        first = last = out = None
        size, directory = 0, []

        def cut() -> None:
            data = gzip.compress(b"".join(lines), 6, mtime=0)
            directory.append(b"%d %d %s\n" % (out.write(data), len(data), lines[0].split(b" ", 1)[0][:PREFIX]))
            lines.clear()

        for batch in batches:
            for key, page, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or Writer(folder, ".cdx.gz")
                last = key.encode()
                first = last if first is None else first
                lines.append(b"%s %s %s %d %d\n" % (last, b"-" if page is None else b"%d" % page, file.encode(), offset, length))
                size += len(lines[-1])
                if len(lines) >= lines_a_block or size >= BLOCK:
                    cut()
                    size = 0
        if out:
            if lines:
                cut()
            out.close()
            listed = Writer(folder, ".idx")
            listed.write(b"".join(directory))
            listed.close()
            yield record_batch({"first": [first[:PREFIX]], "last": [last[:PREFIX]], "blocks": [out.name], "directory": [listed.name]}, target)

    rows = archive.entries.repartitionByRange(min(wanted, PARTS), *order).sortWithinPartitions(*order).select(*order, "length")
    found = staged(rows.mapInArrow(tidy(run), schema), "warc-parts")
    parts = sorted((bytes(r["first"]), bytes(r["last"]), r["blocks"], r["directory"]) for r in found.collect())
    discard(found)
    return Index(folder, parts)


def overlapping(firsts: list[bytes], prefix: bytes) -> range:
    """Which of the sorted ranges that begin with firsts may hold keys with this beginning."""
    return range(max(bisect_left(firsts, prefix) - 1, 0), bisect_right(firsts, prefix))


def lookup(index: Index, urls: DataFrame) -> DataFrame:
    """The captures of some URLs (a column url; which repeat or not): file, offset, length."""
    folder, parts = index.folder, index.parts
    firsts = [p[0] for p in parts]
    found, place = arrow_schema("key string, part int"), arrow_schema("key string, file string, offset long, length long")
    capture = arrow_schema("file string, offset long, length long")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield record_batch({"key": [url_key(u).decode() for u in batch.column(0).to_pylist()]}, arrow_schema("key string"))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = [(k, k.encode()[:PREFIX]) for k in batch.column(0).to_pylist()]
            rows = [(k, i) for k, p in prefixes for i in overlapping(firsts, p) if parts[i][1] >= p]
            yield record_batch({"key": [k for k, _ in rows], "part": [i for _, i in rows]}, found)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, now = Reader(folder), None
        for batch in batches:
            rows = []
            for key, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    now, listed = part, [line.split(b" ", 2) for line in reader.read(parts[part][3]).splitlines()]
                    begins = [x[2] for x in listed]
                rows += [(key, parts[part][2], int(listed[i][0]), int(listed[i][1])) for i in overlapping(begins, key.encode()[:PREFIX])]
            yield record_batch({f.name: [r[k] for r in rows] for k, f in enumerate(place)}, place)
        reader.close()

    def captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, now = Reader(folder), None
        for batch in batches:
            rows = []
            for key, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, offset) != now:
                    now, lines = (file, offset), gzip.decompress(reader.read(file, offset, length)).splitlines()
                for line in lines[bisect_left(lines, wanted := key.encode() + b" ") :]:
                    if not line.startswith(wanted):
                        break
                    rows.append(line[len(wanted) :].split(b" "))
            yield record_batch({"file": [r[1].decode() for r in rows], "offset": [int(r[2]) for r in rows], "length": [int(r[3]) for r in rows]}, capture)
        reader.close()

    distinct = urls.select("url").distinct().mapInArrow(tidy(keys), "key string").distinct()
    by_part = distinct.mapInArrow(tidy(ranges), "key string, part int").repartitionByRange("part", "key").sortWithinPartitions("part", "key")
    by_block = by_part.mapInArrow(tidy(blocks), "key string, file string, offset long, length long")
    by_block = by_block.repartition("file", "offset").sortWithinPartitions("file", "offset", "key")
    return by_block.mapInArrow(tidy(captures), "file string, offset long, length long")


RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def read(archive: Archive, captures: DataFrame, *, payloads: bool = False) -> DataFrame:
    """The records at some places: page_id, url, record_type, payload_bytes and payload_digest (both of the whole payload),
    refers_to; payload if asked for, null of a revisit."""
    folder, schema = archive.folder, RECORD + (", payload binary" if payloads else "")
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)
        for batch in batches:
            places = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            k = 0
            while k < len(places):
                file, begin, length = places[k]
                n, end = k + 1, begin + length
                while n < len(places) and places[n][0] == file and places[n][1] <= end + GAP and places[n][1] + places[n][2] - begin <= READ:
                    end, n = places[n][1] + places[n][2], n + 1
                data = memoryview(reader.read(file, begin, end - begin))
                rows = [parsed(zlib.decompress(data[at - begin : at - begin + size], 31)) for _, at, size in places[k:n]]
                yield record_batch({f.name: [r[f.name] for r in rows] for f in target}, target)
                k = n
        reader.close()

    near = captures.select("file", "offset", "length").withColumn("chunk", F.expr(f"offset div {READ}"))
    near = near.repartition("file", "chunk").sortWithinPartitions("file", "offset").drop("chunk")
    return near.mapInArrow(tidy(run), schema)


def round_trip(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, payload), indexes the archive, looks up each URL, and reads the records back."""
    archive = write(pages, f"{folder}/archive")
    index = build_index(archive, f"{folder}/index")
    records = read(archive, lookup(index, pages.select("url")))
    discard(archive.entries)
    return records
