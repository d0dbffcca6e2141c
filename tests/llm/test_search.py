"""Ranked search, WARC archives and hard negatives against brute force, on small tables with odd rows."""

import base64
import collections
import gzip
import hashlib
import math
import os
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkstone import files
from inkstone.llm import hard_negatives, lexical_search, queries, sql, warc
from inkstone.stage import fresh

# --- ranked lexical search ---


def best_documents(docs, items, top):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").encode().lower())
    rows = [(d, collections.Counter(w), len(w)) for d, t in docs if (w := words(t))]
    n, total = len(rows), sum(r[2] for r in rows)
    df = collections.Counter(t for _, c, _ in rows for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, size in rows:
            m = 100 - 25 + 25 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def searched(spark, docs, items, top):
    a = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, word string, block int")
    b = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, item long")
    return sorted((tuple(r) for r in lexical_search.search(a, b, top=top).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_search(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé9") for _ in range(rng.randint(1, 12))) for _ in range(120)] + ["long" * 9 + "x", "long" * 9 + "y"]
    make = lambda n: " ".join(rng.choice(vocabulary[: rng.randint(2, 122)]) for _ in range(n))
    docs = [(k, make(rng.randint(1, 60))) for k in range(150)]
    docs += [(200 + k, "Same-Text, 日本 same") for k in range(30)] + [(None, "same text"), (None, "same text"), (7, "same text"), (400, None), (401, ""), (402, "!?"), (403, make(3000))]
    items = [(k, make(rng.randint(1, 12))) for k in range(25)] + [(25, "same same text 日本"), (26, "nowhere0"), (27, None), (28, ""), (25, "text"), (None, make(5))]
    for top in (3, 20):
        assert searched(spark, docs, items, top) == best_documents(docs, items, top)


def test_search_of_empty_tables(spark):
    assert searched(spark, [], [(1, "a")], 5) == searched(spark, [(1, "a")], [], 5) == searched(spark, [(1, None)], [(1, "a")], 5) == []


def test_search_parts_of_long_texts(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["ab", "cde", "f", "g" * 30]) for _ in range(400)).encode() for _ in range(3)] + [b"", b"x" * 90]
    bits = np.full(1 << lexical_search.BITS - 3, 255, np.uint8)

    def counted():
        lengths, words, number, text, counts = lexical_search._counted(texts, bits)
        return lengths.tolist(), sorted((words[a], int(b), int(c)) for a, b, c in zip(number, text, counts, strict=True))

    whole = counted()
    monkeypatch.setattr(lexical_search, "PART", 64)
    assert counted() == whole
    assert sum(n for _, _, n in whole[1]) == sum(whole[0]) == 1201
    # hashes that agree are told apart by bytes
    monkeypatch.setattr(lexical_search.Words, "hashes", lambda self, starts, ends: np.ones(len(starts), np.uint64))
    assert counted() == whole


def test_impact_of_very_long_documents():
    lengths, counts = np.array([1 << 40, 5]), np.array([9, 1])
    got = lexical_search.impact(counts, lengths, 1 << 40, (1 << 40) + 5)
    share = [25 * (1 << 40) * n // ((1 << 40) + 5) for n in lengths.tolist()]
    assert got.tolist() == [10**9 * c // (1000 * c + 12 * (75 + s)) for c, s in zip(counts.tolist(), share, strict=True)]


# --- WARC ---


def page_rows(rng):
    html = ["<p>" + "".join(rng.choice("abcé ") for _ in range(rng.randint(900, 1500))) for _ in range(12)]
    rows = [(k, f"http://{rng.choice(['A', 'b', 'm.c'])}.Example.com/{k}?q", rng.choice(html)) for k in range(60)]
    rows += [(100, None, html[0]), (101, "no scheme here", "x"), (102, "http://h.org/a b\nc", None), (103, "http://h.org/", ""), (104, "ftp://ü.de/日本", html[1])]
    rows += [(None, "http://n.org/1", html[2]), (None, "http://n.org/2", "n" * 1000), (None, "http://n.org/3", "n" * 1000), (59, "http://again.org/", html[3]), (200, "http://r.org/", "r" * 2000), (200, "http://r.org/", "r" * 2000)]
    rows += [(300 + k, "http://hot.org/same", f"hot {k % 3}" * 300) for k in range(200)] + [(600, "http://l.org/" + "u" * 3000, "y" * 3_000_000), (601, "http://l.org/" + "u" * 3000 + "1", "z")]
    return rows


def told(rows):
    groups = collections.defaultdict(list)
    for page, _, html in rows:
        groups[html or ""].append(page)
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        first = max((p for p in groups[html or ""] if p is not None), default=None)
        copy = len(body) >= 1000 and page != first
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if copy else "response", first if copy else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def pages(spark):
    rows = page_rows(random.Random(2))
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, size int").withColumn("payload", F.col("html").cast("binary"))


def test_warc_round_trip(spark, pages):
    rows, df = pages
    got = warc.round_trip(spark, df, fresh(spark, "warc"))
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == told(rows)


def test_warc_files_and_index(spark, pages):
    rows, df = pages
    folder = fresh(spark, "warc")
    archive = warc.write(df, f"{folder}/archive")
    # the files are what any reader of such archives takes: members of gzip, one record each
    system, path = files.place(f"{folder}/archive")
    records = 0
    for info in system.get_file_info(files.pafs.FileSelector(path)):
        data = gzip.decompress(open(info.path, "rb").read())
        for head in re.findall(rb"WARC/1\.1\r\n(.*?)\r\n\r\n", data, re.S):
            records += 1
            assert re.search(rb"WARC-Type: (response|revisit)", head) and re.search(rb"Content-Length: \d+", head)
    assert records == len(rows)
    index = warc.build_index(archive, f"{folder}/index", lines_a_block=4)
    keys = []
    for first, last, blocks, directory in index.parts:
        reader = files.Reader(index.folder)
        listed = [line.split(b" ", 2) for line in reader.read(directory).splitlines()]
        own = [line.split(b" ")[0] for at, n, _ in listed for line in gzip.decompress(reader.read(blocks, int(at), int(n))).splitlines()]
        assert (own[0][: warc.PREFIX], own[-1][: warc.PREFIX]) == (first, last)
        keys += own
    assert keys == sorted(warc.url_key(u) for _, u, _ in rows)
    asked = spark.createDataFrame([("http://hot.org/same",), ("http://l.org/" + "u" * 3000,), ("HTTP://nowhere/",), (None,), ("http://hot.org/same",)], "url string")
    found = warc.read(archive, warc.lookup(index, asked), payloads=True).collect()
    want = [p for p, u, _ in rows if u in ("http://hot.org/same", "http://l.org/" + "u" * 3000, None)]
    assert sorted(r["page_id"] for r in found) == sorted(want)
    for r in found:
        assert r["payload"] is None if r["record_type"] == "revisit" else hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"]


def test_warc_record_damage():
    data = warc.record(1, "u", b"body", 4, hashlib.sha1(b"body").digest(), None, "1970-01-01T00:00:00Z")
    assert warc.parsed(data)["payload"] == b"body" and base64.b32encode(hashlib.sha1(b"body").digest()) in data
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(data.replace(b"body", b"b0dy"))


def test_warc_empty(spark, pages):
    assert warc.round_trip(spark, pages[1].limit(0), fresh(spark, "warc")).count() == 0


def test_url_keys():
    assert warc.url_key("http://M.b.Org:80/p?q#f") == b"org:80,b,m)/p?q#f"
    assert [warc.url_key(u) for u in (None, "", "x y", "http://")] == [b"-", b"-", b"x%20y", b")"]


# --- hard negatives ---


def negatives(rows, every, positives, k, low, high):
    """rows (vec_id, embedding, label)."""
    rows = [(v, [math.floor(256 * float(x)) for x in e], y) for v, e, y in rows if e is not None and y is not None and all(x is not None and math.isfinite(x) for x in e)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, (v, e, y) in enumerate(rows):
        if v is None or v % every:
            continue
        scored = [(-dot(e, f), w is None, w or 0, z == y) for j, (w, f, z) in enumerate(rows) if j != i]
        for ps, pn, p, _ in sorted(s for s in scored if s[3])[:positives]:
            near = sorted(s[:3] for s in scored if not s[3] and low * -ps <= 100 * -s[0] <= high * -ps)[:k]
            out += [(v, None if pn else p, r + 1, None if n else w, -ps, -s) for r, (s, n, w) in enumerate(near)]
    return sorted(out, key=repr)


def mined(spark, rows, every=5, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, uid int, w string")
    return sorted((tuple(r) for r in hard_negatives.mined(df, every=every, **options).collect()), key=repr)


def test_hard_negatives(spark):
    rng = random.Random(4)
    near = lambda: [float(np.float32(rng.gauss(0.3, 0.4))) for _ in range(6)]
    same = near()
    rows = [(k, near(), rng.randrange(3)) for k in range(120)] + [(200 + k, same, k % 2) for k in range(60)]
    rows += [(300, near()[:2], 1), (305, [], 1), (310, None, 1), (315, near(), None), (320, [0.1, None], 1), (325, [float("nan"), 1.0], 1), (330, [float("inf")], 2), (None, near(), 1), (None, near(), 2), (5, near(), 1), (5, near(), 1), (-10, near(), 0)]
    rows += [(400, [0.0] * 6, 1), (401, [0.0] * 6, 2), (405, [0.5] * 6, 9)]
    rng.shuffle(rows)
    assert mined(spark, rows, positives=5, negatives=3, low=50, high=95) == negatives(rows, 5, 5, 3, 50, 95)


@pytest.mark.parametrize("size", [40.0, 3e4, 4e5])
def test_hard_negatives_of_large_vectors(spark, size):
    """Scores in single and double precision, and beyond."""
    rng = random.Random(6)
    rows = [(k, [float(np.float32(rng.uniform(0, size))) for _ in range(3)], k % 2) for k in range(30)]
    assert mined(spark, rows, positives=2, negatives=2, low=50, high=95) == negatives(rows, 5, 2, 2, 50, 95)


def test_hard_negatives_of_empty_tables(spark):
    assert mined(spark, []) == mined(spark, [(1, [1.0], 1)]) == mined(spark, [(5, [1.0], 1)]) == []


def test_blocks_of_vectors():
    rows = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array([1] * 10), pa.array([[1.0] * 3, None, [], [2.0] * 5, [1.0]] * 2)], ["vec_id", "label", "embedding"])
    assert [p.num_rows for p in hard_negatives._parts(iter([rows, rows]))] == [20]
    hard_negatives.COMPONENTS, kept = 12, hard_negatives.COMPONENTS
    try:
        parts = list(hard_negatives._parts(iter([rows, rows])))
    finally:
        hard_negatives.COMPONENTS = kept
    assert sum(p.num_rows for p in parts) == 20 and all(p.num_rows * max(len(v or ()) for v in p.column(2).to_pylist()) <= 12 or p.num_rows == 1 for p in parts)


# --- registered queries ---

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_warc", "op13_hard_negatives"])
def test_registered(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    want = con.execute(sql.ORACLE_SQL[name])
    df = queries.queries()[name](spark, DIR)
    names = [c[0] for c in want.description]
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)
