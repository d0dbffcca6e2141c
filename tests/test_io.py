import json

from pyspark.sql import functions as F

from inkstone.operators import distance, evaluate
from inkstone.sources import readers, sinks
from inkstone.streaming import learn


def test_markdown_and_text(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\nt: x\n---\nOne two three four five\n# Head\nsix seven eight nine ten <!-- no -->\n# Short\nfew\n")
    (tmp_path / "b.txt").write_text("﻿First par with five words.\r\n\r\nSecond one here.")
    (tmp_path / ".hidden.md").write_text("one two three four five six")
    rows = {r["content"]: (r["source"], r["context_tag"]) for r in readers.read_folder(spark, str(tmp_path)).collect()}
    assert rows == {
        "One two three four five": ("markdown", "longform"),
        "six seven eight nine ten": ("markdown", "Head"),
        "First par with five words.\n\nSecond one here.": ("plain_text", None),
    }


def test_packing_of_paragraphs(spark):
    parts = [" ".join(["w"] * n) for n in (700, 400, 30, 2)]
    df = spark.createDataFrame([(parts,)], "p array<string>")
    got = df.select(readers.pack_paragraphs(F.col("p")).alias("x")).first()["x"]
    assert [len(g.split()) for g in got] == [700, 432]


def test_vault(spark, tmp_path):
    (tmp_path / ".obsidian").mkdir()
    (tmp_path / "templates").mkdir()
    (tmp_path / "templates" / "t.md").write_text("a template of many words here")
    (tmp_path / "n.md").write_text("see [[Page|the page]] for one two three\n```dataview\nx\n```\n")
    (tmp_path / "d.md").write_text("---\ntags: daily\n---\nwent out and came back home\n")
    rows = {(r["content"], r["context_tag"]) for r in readers.read_vault(spark, str(tmp_path)).collect()}
    assert rows == {("see the page for one two three", "notes"), ("went out and came back home", "journal")}


def test_registry():
    assert readers.detect("x", is_vault=True).name == "obsidian"
    assert readers.detect("a.MD").name == "markdown" and readers.detect("a.text").name == "plain_text"
    assert readers.detect("a.pdf") is None


def test_lexicon_and_prompts(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# head\n Dragon \n\nTower\n")
    assert {r["term"] for r in readers.read_lexicon(spark, str(tmp_path / "l.txt")).collect()} == {"dragon", "tower"}
    (tmp_path / "p.yaml").write_text('name: s\nprompts:\n  - text: "A b: c"\n    category: travel\n  - text: Plain one\n')
    got = [(r["text"], r["category"]) for r in readers.read_prompts(spark, str(tmp_path / "p.yaml")).collect()]
    assert got == [("A b: c", "travel"), ("Plain one", "")]


def test_prompt_suites(spark, tmp_path):
    suite = """name: "all forms"
# a comment
prompts:
  - text: "A b: \\"c\\""   # told apart
    category: travel
  - category: first
    text: 'it''s'
  - {text: "a, b", category: c}
  - { category: wide,
      text: over lines }
  - text: |
      line one
        line two

      end
    category: block
  - text: >-
      folded
      text
    category: fold
  - text: Plain one # note
"""
    (tmp_path / "s.yaml").write_text(suite)
    assert readers.parse_suite(suite)["name"] == "all forms"
    got = [tuple(r) for r in readers.read_prompts(spark, str(tmp_path / "s.yaml")).collect()]
    assert got == [
        ('A b: "c"', "travel"), ("it's", "first"), ("a, b", "c"), ("over lines", "wide"), ("line one\n  line two\n\nend\n", "block"), ("folded text", "fold"), ("Plain one", ""),
    ]


def test_samples_or_texts_are_loaded(spark, tmp_path):
    (tmp_path / "a.md").write_text("One two three four five six\n")
    (tmp_path / "b.txt").write_text("seven eight nine ten eleven")
    assert {r["text"] for r in readers.load_samples(spark, str(tmp_path)).collect()} == {"One two three four five six", "seven eight nine ten eleven"}
    (tmp_path / "s.jsonl").write_text(json.dumps({"content": "stored before", "metadata": {"origin_path": "x"}}) + "\n{broken\n")
    assert [r["text"] for r in readers.load_samples(spark, str(tmp_path)).collect()] == ["stored before"]


def test_fingerprint_round_trip(spark, tmp_path):
    texts = spark.createDataFrame([("x", "The ship hung there. It was large, and nobody knew!\n\nThe day went on."), ("y", "")], "k string, text string")
    style = distance.fingerprint(texts)
    sinks.write_fingerprint(style, str(tmp_path / "f"))
    rows = lambda df: sorted(map(str, df.collect()))
    again = readers.read_fingerprints(spark, str(tmp_path / "f"), style.schema)
    assert rows(again) == rows(style)
    x = again.where("k = 'x'").first()
    assert x["paragraph_length"]["p95"] == 10 and x["function_words"]["the"] > 0.1 and len(x["ngram_profile"]) > 20 and "delve" in x["banned"]


def test_record_files(spark, tmp_path):
    rows = [("chat + raw", "off-domain", "ok", 0.3, 0.1, 0.2, 0.1), ("chat + raw", "longform", "failed", 0.9, 0.9, 0.9, 0.9), ("text + raw", "off-domain", "ok", 0.2, 0.3, 0.1, 0.1), ("text + wrapped", "off-domain", "failed", 0.1, 0.1, 0.1, 0.1)]
    records = spark.createDataFrame(rows, "combo string, bucket string, status string, distance double, leakage double, terminal double, structural double")
    stats = evaluate.buckets(records)
    sinks.write_ablation(records, stats, str(tmp_path / "a"))
    found = {r["combo"]: (r.asDict().get("gate"), r["reasons"]) for r in spark.read.json(str(tmp_path / "a" / "ablation_summary")).collect()}
    assert found["text + wrapped"] == (0, ["no successful generation"])
    assert found["text + raw"][0] is None and found["text + raw"][1][-1] == "WINNER dist=0.200 leak=0.3000"
    assert found["chat + raw"] == (3, ["G1 leak=0.1000 PASS", "G2 voice_dist=0.3000 PASS"])
    assert spark.read.json(str(tmp_path / "a" / "per_generation")).count() == 4
    sinks.write_records(records, evaluate.summary(records, ["distance"], prompt="combo"), str(tmp_path / "r"), four=["distance", "leakage"], two=["terminal"])
    assert spark.read.json(str(tmp_path / "r" / "eval_summary")).first()["records"] == 4
    assert spark.read.option("header", True).csv(str(tmp_path / "r" / "eval_results_csv")).where("distance = '0.9000' and terminal = '0.90'").count() == 1
    sinks.write_pairs(records.limit(2), str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).count() == 2
    assert json.loads(sinks.progress(1, 8, 95, "a + b", "running")) == {"completed": 1, "total": 8, "percent": 12, "eta_minutes": 2, "current_combo": "a + b", "status": "running"}
    assert json.loads(sinks.progress(0, 0, 0, "", "done"))["percent"] == 0


def test_corpus_files(spark, tmp_path):
    rows = [(2, "second\nline", "a"), (1, "first", "a"), (3, None, "a"), (4, "other", "b")]
    sinks.write_corpus(spark.createDataFrame(rows, "doc_id long, text string, source string"), str(tmp_path / "c"))
    files = {p.parent.name: p.read_text() for p in (tmp_path / "c").glob("source=*/part-*")}
    assert files == {"source=a": "first\n\nsecond\nline\n\n", "source=b": "other\n\n"}


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("x", ("m", "p", None, None), "h")], readers.SAMPLE)
    sinks.write_samples(df, str(tmp_path / "s"))
    sinks.write_samples(df, str(tmp_path / "s"))
    (tmp_path / "s" / "bad.json").write_text("{broken\n")
    assert readers.read_jsonl(spark, str(tmp_path / "s")).count() == 2


def test_training_files(spark, tmp_path):
    df = spark.createDataFrame([(i, "word " * 25) for i in range(20)] + [(99, "short")], "doc_id long, text string")
    sinks.write_training(df, str(tmp_path / "t"))
    read = lambda n: [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "t" / n)).collect()]
    assert len(read("train")) == 17 and len(read("valid")) == 3 and len(read("test")) == 3
    assert [m["role"] for m in read("valid")[0]["messages"]] == ["user", "assistant"]


def test_csv_lexicon_and_envelope(spark, tmp_path):
    df = spark.createDataFrame([('say "x", y', 0.123456, 7.555)], "prompt string, distance double, grade double")
    sinks.write_records_csv(df, str(tmp_path / "c"), four=["distance"], two=["grade"])
    got = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first()
    assert (got["prompt"], got["distance"]) == ('say "x", y', "0.1235")
    sinks.write_lexicon(spark.createDataFrame([(1, "a"), (2, "b")], "rank int, term string"), str(tmp_path / "l"), title="terms")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "l")).collect()] == ["# terms", "a", "b"]
    assert json.loads(sinks.envelope({"n": 1}))["status"] == "success" and "error" in json.loads(sinks.envelope(error="no"))


def test_learning_stream(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    (tmp_path / "in").mkdir()
    put = lambda n, *rows: (tmp_path / "in" / n).write_text("\n".join(json.dumps({"author": a, "text": t}) for a, t in rows))
    put("1.json", ("x", "one two two"), ("x", "one two two"), ("y", "three"))
    learn.learn(spark, source, store).awaitTermination()
    put("2.json", ("x", "one two two"), ("x", "two <b>four</b>"))
    learn.learn(spark, source, store).awaitTermination()
    got = {(r["k"], r["word"]): r["n"] for r in learn.word_counts(spark, store).collect()}
    assert got == {("x", "one"): 1, ("x", "two"): 3, ("x", "four"): 1, ("y", "three"): 1}
    assert {r["k"]: r["n_words"] for r in learn.sums(spark, store).collect()} == {"x": 5, "y": 1}
    assert learn.trigrams(spark, store).count() > 0
