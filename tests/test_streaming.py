"""Learning with replayed, broken and lost work; and the folder walk."""

import json
import os
import subprocess
import sys

import pytest

from inkstone.operators import features as ft
from inkstone.sources import sinks, walk
from inkstone.streaming import learn

FILES = [
    [("b", "one two two"), ("a", "one two two"), (None, "one two two"), ("y", "three")],
    [("0", "one two two"), ("x", "two <b>four</b>"), (None, "no author"), ("x", None), ("x", "")],
    [("z", "three"), ("z", "five"), ("w", "five"), ("x", "two four")],
]
WORDS = {("a", "one"): 1, ("a", "two"): 2, ("y", "three"): 1, ("x", "two"): 1, ("x", "four"): 1, (None, "no"): 1, (None, "author"): 1, ("w", "five"): 1}


def put(folder, k, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{k}.json", "w") as f:
        f.write("\n".join(json.dumps({"author": a, "text": t}) for a, t in rows))


def run(spark, source, store):
    learn.learn(spark, source, store, files_a_batch=1).awaitTermination()


def tables(spark, store):
    show = lambda t: sorted((tuple(r) for r in t.collect()), key=repr)
    return show(learn.word_counts(spark, store)), show(learn.sums(spark, store)), show(learn.trigrams(spark, store)), show(learn.stored(spark, store, "texts").select("content_hash", "author", "text"))


def as_dict(rows):
    return {tuple(r[:2]): r[2] for r in rows}


def test_replayed_batch(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    for k, rows in enumerate(FILES):
        put(source, k, rows)
        run(spark, source, store)
    before = tables(spark, store)
    assert as_dict(before[0]) == WORDS
    last = max(int(n) for n in os.listdir(f"{store}/progress/commits") if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        os.remove(f"{store}/progress/commits/{name}")
    run(spark, source, store)  # the last batch again
    assert tables(spark, store) == before


def test_broken_batch(spark, tmp_path, monkeypatch):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    put(source, 0, FILES[0])
    run(spark, source, store)
    first = tables(spark, store)
    put(source, 1, FILES[1])
    sums = ft.sums
    monkeypatch.setattr(ft, "sums", lambda texts: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception, match="lost"):
        run(spark, source, store)
    assert tables(spark, store) == first  # words of the broken batch are there, but it is not complete
    monkeypatch.setattr(ft, "sums", sums)
    put(source, 2, FILES[2])
    run(spark, source, store)
    assert as_dict(tables(spark, store)[0]) == WORDS


LOST = """
import json, os, sys, threading, time
import psutil
from pyspark.sql import SparkSession
sys.path.insert(0, os.getcwd())
from tests import test_streaming as t
spark = (SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
         .config("spark.executor.memory", "800m").config("spark.driver.host", "127.0.0.1").getOrCreate())
spark.sparkContext.setLogLevel("OFF")
source, store = sys.argv[1] + "/in", sys.argv[1] + "/store"
for k, rows in enumerate(t.FILES):
    t.put(source, k, rows)
    if k == 1:
        def strike():
            time.sleep(1.5)
            for p in psutil.Process().children(recursive=True):
                try:
                    if "CoarseGrainedExecutorBackend" in " ".join(p.cmdline()):
                        p.kill()
                        print("killed", flush=True)
                        break
                except psutil.Error:  # gone meanwhile
                    pass
        threading.Thread(target=strike).start()
    t.run(spark, source, store)
print(json.dumps(sorted([[a, w, n] for (a, w), n in t.as_dict(t.tables(spark, store)[0]).items()], key=repr)))
"""


def test_lost_executor(tmp_path):
    pytest.importorskip("psutil")
    import pyspark

    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"SPARK_HOME": os.path.dirname(pyspark.__file__), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": f"{home}:{os.environ.get('PYTHONPATH', '')}", "SPARK_WORKER_DIR": str(tmp_path), "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", LOST, str(tmp_path)], cwd=home, env=env, capture_output=True, text=True, timeout=400)
    lines = done.stdout.strip().splitlines()
    assert "killed" in lines, done.stderr[-2000:]
    assert json.loads(lines[-1]) == sorted([[a, w, n] for (a, w), n in WORDS.items()], key=repr)


# --- walk ---


def test_walk(spark, tmp_path):
    root = tmp_path / ".hidden root"
    for name, data in {
        "a.md": b"# Head\none two three four five", "b/c.TXT": b"six seven eight nine ten", "b/bad.txt": b"ok \xff\xfe", "b/.d/e.md": b"hidden text of five words", ".f.md": b"hidden text of five words",
        "g.pdf": b"no reader for this one here", "b/empty.txt": b"", "b/short.md": b"too short", "vault/.obsidian/x.md": b"not for reading at all here", "vault/n.md": b"a note in a nested vault here",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    (root / "gone.md").symlink_to(root / "nowhere.md")
    found = walk.files(spark, str(root))
    names = lambda rows: sorted(r["origin_path"].split("hidden root/")[1] for r in rows)
    assert names(found.where("error is null").collect()) == ["a.md", "b/c.TXT", "b/empty.txt", "b/short.md", "vault/n.md"]
    bad = {r["origin_path"].split("hidden root/")[1]: (r["kind"], r["reason"]) for r in walk.failures(found).collect()}
    assert bad["b/bad.txt"] == ("plain_text", "not UTF-8 at byte 3") and bad.keys() <= {"b/bad.txt", "gone.md"}
    got = sorted((r["content"], r["source"], r["context_tag"]) for r in walk.samples(found).collect())
    assert got == [("a note in a nested vault here", "markdown", "longform"), ("one two three four five", "markdown", "Head"), ("six seven eight nine ten", "plain_text", None)]
    assert {r["kind"]: r["failed"] for r in walk.report(found).collect()}["plain_text"] == 1
    assert walk.files(spark, f"{root}/a.md").count() == 1 and walk.files(spark, f"{root}/b/.d").count() == 1


def test_walk_deals_files(tmp_path, monkeypatch):
    for k in range(25):
        (tmp_path / f"{k:02}.txt").write_text("x" * (10 * k))
    monkeypatch.setattr(walk, "PART", 500)
    parts = walk.WalkReader(str(tmp_path)).partitions()
    assert [f[0][-6:-4] for p in parts for f in p.files] == [f"{k:02}" for k in range(25)]
    assert len(parts) > 4 and all(sum(f[2] for f in p.files) <= 500 or len(p.files) == 1 for p in parts)
    (tmp_path / "none").mkdir()
    assert [p.files for p in walk.WalkReader(f"{tmp_path}/none").partitions()] == [[]]


def test_files_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.txt", b"one"), ("a/c.md", None), ("d.txt.gz", b"not packed")], "name string, data binary")
    assert sorted(r["name"] for r in sinks.write_files(rows, str(tmp_path / "out")).collect()) == ["a/b.txt", "a/c.md", "d.txt.gz"]
    assert (tmp_path / "out/a/b.txt").read_bytes() == b"one" and (tmp_path / "out/a/c.md").read_bytes() == b"" and (tmp_path / "out/d.txt.gz").read_bytes() == b"not packed"


def test_smallest_author_of_a_batch(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    put(source, 0, [(a, f"text {k}") for k in range(300) for a in ("m", None, f"c{k % 7}", "z")])
    run(spark, source, store)
    put(source, 1, [("a", f"text {k}") for k in range(300)] + [(None, "later")])
    run(spark, source, store)
    found = learn.stored(spark, store, "texts").select("author", "text").collect()
    assert sorted(map(tuple, found), key=repr) == sorted([*((f"c{k % 7}", f"text {k}") for k in range(300)), (None, "later")], key=repr)


def test_learning_keeps_no_text_and_calls_no_python_by_text(spark, tmp_path):
    stream = spark.readStream.schema(learn.SCHEMA).json(str(tmp_path))
    plan = learn.unseen(stream)._jdf.queryExecution().logical().toString()
    assert "Deduplicate" in plan and "Pandas" not in plan
