import math

import pytest
from pyspark.sql import functions as F

from inkstone.functions.constants import BANNED_WORDS
from inkstone.operators import backends, corpus, distance, evaluate, lexicon, rank
from inkstone.operators import features as ft

PLAIN = (
    "The ship hung in the sky. It was very large, and nobody had noticed it until now. The people of the town looked up. "
    "Some of them ran; others laughed! What else could they do? The day went on. By the evening it was gone, and they ate."
)
FORMULAIC = (
    "In today's world, it is important to note that we delve into a rich tapestry of robust and holistic frameworks. "
    "Furthermore, this underscores the pivotal role of synergy: a testament to innovative, transformative paradigms."
)


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([("a", PLAIN), ("b", FORMULAIC), ("c", ""), ("d", None)], "k string, text string")


def test_features(texts):
    sums = {r["k"]: r for r in ft.sums(texts).collect()}
    assert sums["a"]["n_sentences"] == 7 and sums["a"]["semicolon"] == 1 and sums["a"]["question"] == 1
    assert sums["c"]["n_words"] == sums["d"]["n_words"] == 0
    shape = {r["k"]: r for r in ft.sentence_shape(ft.sums(texts)).collect()}
    assert math.isclose(sum(shape["a"]["histogram"]), 1, abs_tol=1e-5) and shape["c"]["mean"] == 0
    read = {r["k"]: r for r in ft.readability(ft.sums(texts)).collect()}
    assert read["c"]["flesch_kincaid"] == 0 and read["b"]["flesch_kincaid"] > read["a"]["flesch_kincaid"]


def test_richness(spark):
    rows = spark.createDataFrame([("x", "a a b c c c")], "k string, text string")
    r = ft.richness(ft.word_counts(rows)).first()
    assert (r["tokens"], r["types"], r["ttr"]) == (6, 3, 0.5)
    assert r["yule_k"] == round(10000 * (14 - 6) / 36, 6) and r["simpson"] == round(1 - 8 / 30, 6)
    assert r["hapax"] == r["dis"] == round(1 / 3, 6)


def test_punctuation(spark):
    rows = spark.createDataFrame([("x", "a---b -- c — d – e")], "k string, text string")
    p = ft.punctuation(ft.sums(rows)).first()
    assert p["em_dash"] == 400 and p["en_dash"] == 400  # two of each in five words


def test_trigrams(spark):
    rows = spark.createDataFrame([("x", "ABAB"), ("x", "ab"), ("y", "éab")], "k string, text string")
    got = {(r["k"], r["gram"]): r["n"] for r in ft.trigrams(rows).collect()}
    assert got == {("x", "aba"): 1, ("x", "bab"): 1, ("y", "éab"): 1}


def test_length_stats(spark):
    rows = spark.createDataFrame([("x", n) for n in [1, 2, 3, 4]], "k string, n long")
    r = ft.length_stats(rows).first()
    assert (r["mean"], r["median"], r["p95"]) == (2.5, 3, 4) and r["sd"] == round(math.sqrt(1.25), 6)


def test_repetition(spark, evaluate):  # noqa: F811
    assert spark.range(1).select(ft.repetition(F.lit("a b c d " * 10))).first()[0] == round(33 / 37, 20)
    assert spark.range(1).select(ft.repetition(F.lit("a b c d"))).first()[0] == 0


def test_distance_to_self_is_small(spark, texts):
    rows = texts.where("k in ('a', 'b')")
    style = distance.Style.of(rows)
    pairs = spark.createDataFrame([(x, y) for x in "ab" for y in "ab"], "k string, p string")
    slops = rows.select("k", distance.slop(F.col("text")).alias("slop"))
    got = {(r["k"], r["p"]): r for r in distance.distances(style, style, pairs, slops).collect()}
    assert got["a", "a"]["overall"] < 1e-6 < got["b", "a"]["overall"] <= 1
    assert got["b", "a"]["slop"] > 0.1 and got["a", "b"]["slop"] == 0
    assert all(0 <= v <= 1 for r in got.values() for k, v in r.asDict().items() if k not in "kp")


def test_empty_vectors_are_half_way(spark):
    style = spark.createDataFrame([("a", "x", 1)], "k string, word string, n long")
    pairs = spark.createDataFrame([("a", "none")], "k string, p string")
    assert distance.cosine_distance(style, style, pairs, "word").first()["distance"] == 0.5


def test_slop(spark):
    one = lambda f, t: spark.range(1).select(f(F.lit(t))).first()[0]
    assert one(distance.slop, "furthermore we go") == 0 and one(distance.slop_presence, "furthermore we go") > 33
    assert one(distance.slop, "implementation " * 10) == 1.0 and one(distance.slop, "") == 0


def test_rejections(spark):
    one = lambda t: spark.range(1).select(rank.rejections(F.lit(t))).first()[0]
    assert one(PLAIN) == [] and "too short" in one("few words") and "repetition" in one("a b c d " * 10)
    assert any(r.startswith("phrase") for r in one(FORMULAIC)) and any("formulaic" in r for r in one(FORMULAIC))


@pytest.mark.parametrize(
    "prompt, output, low, high",
    [
        ("Write about the ocean and its tides", "The ocean has tides.", 0.99, 1), ("Describe mountains", "Rivers run.", 0, 0),
        ("Write a paragraph", "anything", 1, 1), ("cat", "a category", 1, 1), ("describe gardening", "my gardens", 1, 1),
    ],
)
def test_relevance(spark, prompt, output, low, high):
    assert low <= spark.range(1).select(rank.relevance(F.lit(prompt), F.lit(output))).first()[0] <= high


def test_pairs_and_choice(spark):
    rows = [(1, 0, 0.5, 0.9, True), (1, 1, 0.2, 0.9, False), (2, 0, 0.3, 0.9, False), (3, 0, 0.1, 0.9, True), (3, 1, 0.4, 0.9, True), (3, 2, 0.9, 0.9, True), (4, 0, 0.1, 0.1, True), (4, 1, 0.9, 0.9, True)]
    df = spark.createDataFrame(rows, "prompt_id int, candidate_index int, distance double, relevance double, passed boolean").withColumn("rank_score", F.col("distance"))
    pairs = {r["prompt_id"]: (r["chosen"], r["rejected"], r["margin"]) for r in rank.mine_pairs(df).collect()}
    assert pairs == {1: (1, 0, 0.3), 3: (0, 1, 0.3)}
    assert {r["prompt_id"]: r["candidate_index"] for r in rank.choose(df).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}


def test_logit_bias(spark):
    banned = spark.createDataFrame([("x", ["furthermore"])], "k string, banned array<string>")
    got = rank.logit_bias(banned, spark.createDataFrame([("x", 3.0)], "k string, em_dash double")).first()["bias"]
    assert got["furthermore"] == -4 and got["—"] == 0.3 and len(got) == len(BANNED_WORDS) - 3 + 2


def test_lexicon(spark):
    text = "We met Ada Lovelace there. Ada spoke. Later Ada Lovelace left with ada3 and 42 42 42"
    rows = spark.createDataFrame([(text,)] * 3, "text string")
    names = {r["term"]: r["n"] for r in lexicon.entities(rows).collect()}
    assert names["Ada Lovelace"] == 6 and names["Lovelace"] == 6 and "Later" not in names and "Later Ada" in names
    words = {r["term"] for r in lexicon.frequent_words(rows).collect()}
    assert {"ada", "lovelace", "ada3"} <= words and not {"42", "the", "we"} & words
    top = [r["term"] for r in lexicon.merge(lexicon.entities(rows), lexicon.frequent_words(rows), max_terms=3).orderBy("rank").collect()]
    assert len(top) == 3 and top[0] == "ada"


def test_leakage(spark):
    rows = spark.createDataFrame([("about dragons", "Dragons and a Tower"), ("x", "nothing")], "prompt string, output string")
    got = [(r["leaked"], r["checkable"], r["leakage"]) for r in lexicon.leakage(rows, ["dragons", "tower", "sword"]).collect()]
    assert got == [(["tower"], 2, 0.5), ([], 3, 0.0)]
    assert lexicon.leakage(rows, []).first()["leakage"] == 0


def test_buckets_and_winner(spark):
    rows = [(f"c{i}", "longform", "ok", 0.5 + i / 10, 0.1 * i, 0.1, 0.2) for i in range(3)] + [("c9", "off-domain", "failed", None, None, None, None)]
    df = spark.createDataFrame(rows, "combo string, bucket string, status string, distance double, leakage double, terminal double, structural double")
    stats = evaluate.buckets(df)
    got = {(r["combo"], r["bucket"]): r for r in stats.collect()}
    assert len(got) == 4 * 5 and got["c9", "overall"]["failed"] == 1 and got["c9", "overall"]["mean_distance"] is None
    assert got["c1", "shortform"]["count"] == 0
    assert evaluate.winner(stats).first()["combo"] == "c0"


def test_combined(spark):
    one = spark.range(1).select(evaluate.combined(F.lit(0.121), F.lit(0.044), F.lit(72.0))).first()[0]
    assert round(one, 3) == 0.883


def test_chunks():
    text = "\n\n".join(" ".join([c] * n) for c, n in (("a", 10), ("b", 20), ("c", 5)))
    assert corpus.chunk_text(text, 100) == [text]
    got = corpus.chunk_text(text, 25)
    assert got[0] == " ".join(["a"] * 10) and " ".join(["c"] * 5) in got[-1]
    assert corpus.chunk_text("word " * 300, 25) == [("word " * 300).strip()]


def test_dedupe_and_split(spark):
    df = spark.createDataFrame([(5, "x"), (3, "x"), (9, "y")], "doc_id long, text string")
    got = {r["doc_id"]: r["copies"] for r in corpus.dedupe(df).collect()}
    assert got == {3: 2, 9: 1}
    known = corpus.content_hash(df.where("text = 'x'")).select("content_hash").distinct()
    assert [r["doc_id"] for r in corpus.dedupe(df, known).collect()] == [9]
    many = spark.createDataFrame([(i * i * 977 - 5000,) for i in range(137)], "doc_id long")
    held = [r["doc_id"] for r in corpus.holdout_split(many, 0.1).where("held_out").collect()]
    assert sorted(held) == sorted(i * i * 977 - 5000 for i in range(137))[:14]
    assert corpus.kth_smallest(many.limit(0), "doc_id", 3) is None


def test_backend_over_a_grid(spark):
    prompts = spark.createDataFrame([(1, "one two three"), (2, ""), (3, None)], "prompt_id long, prompt string")
    grid = evaluate.grid(prompts, [1, 2], ["chat"], ["raw", "wrapped"])
    rows = backends.generate(grid, backends.Echo(), max_tokens=2).collect()
    assert len(rows) == 12 and {r["combo"] for r in rows} == {"chat + raw", "chat + wrapped"}
    for r in rows:
        assert r["output"] == backends.Echo().generate(r["prompt"] or "", seed=r["seed"], max_tokens=2)
        assert len(r["output"].split()) == (2 if r["prompt_id"] == 1 else 0)


def test_decode_takes_the_first_attempt_that_passes(spark):
    rows = [
        (1, 1, 10, 0.1, False), (1, 2, 11, 0.9, True), (1, 2, 12, 0.8, True), (1, 3, 13, 0.0, True),
        (2, 1, 20, 0.1, False), (2, 2, 21, 0.5, False), (2, 2, 22, 0.5, False), (3, 3, 30, 0.4, False), (3, 4, 31, 0.1, True),
    ]
    got = rank.decode(spark.createDataFrame(rows, "prompt_id long, attempt int, candidate_index long, rank_score double, passed boolean"))
    assert {r["prompt_id"]: (r["attempt"], r["candidate_index"]) for r in got.collect()} == {1: (2, 12), 2: (2, 21), 3: (3, 30)}


def test_profile_without_a_histogram(spark):
    texts = spark.createDataFrame([("a", PLAIN)], "k string, text string")
    own = distance.Style.of(texts)
    old = distance.Style(own.dense.withColumn("k", F.lit("p")).withColumn("histogram", F.lit(None).cast("array<double>")).withColumn("mean", F.col("mean") * 2), own.words.withColumn("k", F.lit("p")), own.grams.withColumn("k", F.lit("p")))
    pairs = spark.createDataFrame([("a", "p")], "k string, p string")
    assert distance.distances(own, old, pairs).first()["sentences"] == 0.25


def test_bench_of_few_samples(spark):
    rows = spark.createDataFrame([(k, PLAIN if k % 2 else FORMULAIC) for k in range(40)], "doc_id long, text string")
    r = evaluate.bench(rows, smoke=True).first()
    assert r["samples"] == 3 and 0 <= r["voice"] <= 1 and r["creative"] == 72.0
    assert r["combined"] == round(0.5 * (1 - r["voice"]) + 0.3 * (1 - r["slop"] / 100) + 0.144, 6)
    none = spark.createDataFrame([], "overall double")
    assert evaluate.voice_fidelity(none).first()["voice"] == 1.0


def test_bench_deals_out_what_it_holds_out(spark, monkeypatch):
    """The first tenth lies in the first partition, but is no single task's work."""
    rows = spark.createDataFrame([(k, f"{PLAIN} {k}") for k in range(400)], "doc_id long, text string")
    assert rows.where("doc_id < 40").select(F.spark_partition_id()).distinct().count() == 1
    seen, against = [], evaluate.profiles.against
    monkeypatch.setattr(evaluate.profiles, "against", lambda texts, profile: seen.append(texts) or against(texts, profile))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert evaluate.bench(rows).first()["samples"] == 40
        sizes = [r["count"] for r in seen[0].groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 40 and max(sizes) < 30


def test_ingest_counts_what_it_leaves_out(spark):
    long = "\n\n".join(f"{PLAIN} part {k}" for k in range(6))
    rows = [(1, "a <b>short</b> text of five", "x"), (2, "a short text of five", "x"), (3, long, "y"), (4, "known before it came", None)]
    known = corpus.content_hash(spark.createDataFrame([("known before it came",)], "text string")).select("content_hash")
    chunks, report = corpus.ingest(spark.createDataFrame(rows, "doc_id long, text string, context_tag string"), max_words=100, existing=known)
    got = {r["context"]: (r["samples"], r["skipped"], r["chunks"]) for r in report.collect()}
    assert got["x"] == (1, 1, 1) and got["none"] == (0, 1, 0) and got["y"][:2] == (1, 0) and got["y"][2] > 2
    assert got[None] == (2, 2, got["y"][2] + 1) and chunks.count() == got[None][2]


def test_relevance_cuts_the_output_into_words_once(spark):
    rows = spark.createDataFrame([("Tell of cats and dogs, ok", "cat dogged")], "p string, o string")
    found = rows.select(rank.relevance(F.col("p"), F.col("o")).alias("r"))
    assert found._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 2
    assert rows.select(rank.relevance(F.col("p"), F.lit(None).cast("string")).alias("r")).first()["r"] == 0.0


def test_lexicon_counts_leave_the_task_summed(spark, monkeypatch):
    monkeypatch.setattr(lexicon, "HELD", 3)  # counts are sent, and forms forgotten, again and again
    text = "we met Ann Lee, in Élan City. Then \x1cAnn Lee Ohm Ray Box went. Bo (Ann) x"
    rows = spark.createDataFrame([(text,), (None,), ("",), (text,)], "text string").coalesce(1)
    found = {r["term"]: r["n"] for r in lexicon.entities(rows, min_count=1).collect()}
    # a separator that is no white space stands before a trimmed word
    assert found == {k: 2 for k in ("Ann", "Lee", "Élan", "City", "Ohm", "Ray", "Box", "Ann Lee", "Élan City", "Élan City Then", "Élan City Then Ann", "City Then", "City Then Ann", "City Then Ann Lee", "Then Ann", "Then Ann Lee", "Then Ann Lee Ohm", "Ann Lee Ohm", "Ann Lee Ohm Ray", "Lee Ohm", "Lee Ohm Ray", "Lee Ohm Ray Box", "Ohm Ray", "Ohm Ray Box", "Ray Box", "Bo Ann")} | {"Ann": 6, "Ann Lee": 4, "Lee": 4}
    words = {r["term"]: r["n"] for r in lexicon.frequent_words(rows, min_count=1).collect()}
    assert words["ann"] == 6 and words["lee"] == 4 and words["élan"] == 2 and "in" not in words


def test_lexicon_texts_are_not_exploded(spark):
    rows = spark.createDataFrame([("One Two",)], "text string")
    plan = lexicon.entities(rows)._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
