"""Texts against profiles and regeneration, against the joined distances and plain loops."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkstone.operators import backends, decode, distance, profiles


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeté") for _ in range(rng.randint(1, 8))) for _ in range(60)] + ["the", "of", "and", "a", "in", "to"]
    make = lambda: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", ",", "!", "?", ";", " — "]) for _ in range(rng.randint(3, 90))).capitalize()
    rows = [(k, f"s{k % 7}", make()) for k in range(60)] + [(60, "s0", ""), (61, "s1", "ab"), (62, "s2", "word"), (63, "s3", "... !!"), (64, "same", "The same text."), (65, "copy", "The same text.")]
    return spark.createDataFrame(rows, "k long, source string, text string")


@pytest.fixture(scope="module")
def both(spark, texts):
    """Distances of all texts from all sources, by joins."""
    style = distance.Style.of(texts.select(F.col("source").alias("k"), "text"))
    pairs = texts.select("k").crossJoin(texts.select(F.col("source").alias("p")).distinct())
    found = distance.distances(distance.Style.of(texts.select("k", "text")), style, pairs, texts.select("k", distance.slop(F.col("text")).alias("slop")))
    return style, [r.asDict() for r in found.collect()]


def test_nearest(texts, both):
    style, every = both
    got = {}
    for r in profiles.nearest(texts.select("k", "text"), style, top=3).collect():
        got.setdefault(r["k"], []).append((r["rank"], r["distance"], r["p"]))
    want = {}
    for r in every:
        want.setdefault(r["k"], []).append((r["base"], r["p"]))
    assert got.keys() == want.keys()
    for k, own in got.items():
        assert [(round(d, 6), p) for _, d, p in sorted(own)] == [(round(d, 6), p) for d, p in sorted(want[k])[:3]], k


def test_nearest_in_packs(texts, both, monkeypatch):
    style, _ = both
    one = sorted(map(tuple, profiles.nearest(texts.select("k", "text"), style, top=2).collect()))
    monkeypatch.setattr(profiles, "PROFILES", 2)  # read where packs are dealt
    assert sorted(map(tuple, profiles.nearest(texts.select("k", "text"), style, top=2).collect())) == one


def test_nearest_compares_few(spark, texts, both):
    """Bounds leave most profiles' trigrams out when one is much nearer than the others."""
    block = profiles._blocks(texts.select("k", "text").limit(1)).first()
    rows = pa.ipc.open_stream(block["rows"]).read_next_batch()
    own = {f: rows.column(f)[0].as_py() for f in ("histogram", "fw", "codes", "counts")} | {"measures": [rows.column(m)[0].as_py() for m in profiles.MEASURES], "p": "a"}
    far = own | {"measures": [x * 9 + 50 for x in own["measures"]], "codes": [1], "counts": [1], "histogram": own["histogram"][::-1]}
    near = profiles._near(rows, [own, *[far | {"p": f"f{i}"} for i in range(50)]], 1)
    assert near[1] == [0] and near[2] == [0.0] and near[3] == 1


def test_against(spark, texts, both):
    style, every = both
    one = distance.Style(*(t.where("k = 's3'") for t in (style.dense, style.words, style.grams)))
    got = {r["k"]: r.asDict() for r in profiles.against(texts.select("k", "text"), one).collect()}
    want = {r["k"]: r for r in every if r["p"] == "s3"}
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert got[k] == pytest.approx(r, abs=2e-6) or {x: (got[k][x], r[x]) for x in r if got[k][x] != r[x]} == {}


def test_nearest_of_nothing(spark, texts, both):
    assert profiles.nearest(texts.select("k", "text").limit(0), both[0]).count() == 0


# --- regeneration ---


def test_decode_loop(spark, texts, both):
    style, _ = both
    one = distance.Style(*(t.where("k = 's3'") for t in (style.dense, style.words, style.grams)))
    rng = random.Random(2)
    prompts = [(k, " ".join(rng.choice(["walk", "river", "stone", "bright", "the", "of", "cold", "field"]) + str(rng.randrange(9)) for _ in range(rng.randint(2, 30)))) for k in range(25)]
    prompts += [(100, None), (101, ""), (102, "refuse me now " * 8), (103, "one")]
    df = spark.createDataFrame(prompts, "prompt_id long, prompt string")
    backend, n, most = backends.Sampler(), 2, 3
    made = []
    for i, p in prompts:
        for seed in range(n * most):
            try:
                made.append((i, p or "", seed // n, seed % n, backend.generate(p or "", seed=seed, max_tokens=512)))
            except RuntimeError:
                pass
    rows = spark.createDataFrame(made, "prompt_id long, prompt string, attempt long, candidate_index long, output string")
    scored = {}
    for r in decode.score(rows, one).collect():
        scored.setdefault(r["prompt_id"], {}).setdefault(r["attempt"], []).append(((not r["passed"]), r["rank_score"], r["candidate_index"], r["output"]))
    want = {}
    for i, tries in scored.items():
        for a in range(most):
            last, own = a == most - 1, tries.get(a, [])
            best = min(own, key=lambda r: r[1:3] if last else r[:3])
            if last or not best[0]:
                want[i] = (best[3], best[2], best[1], not best[0], len(own), a)
                break
    got = {r["prompt_id"]: tuple(r)[1:] for r in decode.decode(df, backend, one, candidates=n, max_attempts=most).select("prompt_id", "output", "candidate_index", "rank_score", "passed", "candidates", "regenerations").collect()}
    assert got == want and len({v[-1] for v in want.values()}) == 3 and any(v[4] == 1 for v in want.values())


def test_decode_without_candidates(spark, both):
    class Broken:
        name = "broken"

        def generate(self, prompt, *, seed, max_tokens):
            raise ValueError("no model")

    style = both[0]
    one = distance.Style(*(t.where("k = 's3'") for t in (style.dense, style.words, style.grams)))
    df = spark.createDataFrame([(1, "a prompt")], "prompt_id long, prompt string")
    r = decode.decode(df, Broken(), one, candidates=2, max_attempts=2).first()
    assert (r["output"], r["passed"], r["candidates"], r["regenerations"]) == (None, False, 0, 1)
    with pytest.raises(Exception, match="no model"):
        backends.generate(df.withColumn("seed", F.lit(1)), Broken()).collect()


# --- preference losses ---


def test_preference_losses(spark):
    import collections
    import math

    from inkstone.operators import preference

    corpus, texts = ["the cat sat", "The hat", None, "ab", ""], {1: "the cat", 2: "zzz the", 3: "ab", 4: None, 5: "hat hat"}
    grams, heads = collections.Counter(), collections.Counter()
    three = lambda t: [t.lower()[i : i + 3] for i in range(len(t or "") - 2)]
    for t in corpus:
        grams.update(three(t))
    for g, n in grams.items():
        heads[g[:2]] += n
    v = len({g[2] for g in grams})
    logp = lambda t: sum(math.log((grams[g] + 1) / (heads[g[:2]] + v)) for g in three(t)) / len(three(t)) if three(t) else None
    model = preference.CharacterModel.of(spark.createDataFrame([(t,) for t in corpus], "text string"))
    scores = preference.log_probabilities(spark.createDataFrame(list(texts.items()), "k long, text string"), model)
    got = {r["k"]: (r["tokens"], r["mean_logp"]) for r in scores.collect()}
    assert {k: n for k, (n, _) in got.items()} == {k: len(three(t)) for k, t in texts.items()}
    assert {k: x for k, (_, x) in got.items()} == pytest.approx({k: logp(t) for k, t in texts.items()}, abs=1e-6)
    pairs = spark.createDataFrame([(1, 2), (5, 1), (3, 1)], "chosen long, rejected long")
    for r in preference.losses(pairs, scores, beta=0.5, gamma=0.2).collect():
        if r["chosen"] == 3:
            assert r["logp_margin"] is r["simpo"] is r["dpo"] is None
            continue
        margin = logp(texts[r["chosen"]]) - logp(texts[r["rejected"]])
        sigmoid = lambda x: 1 / (1 + math.exp(-x))
        assert (r["logp_margin"], r["simpo"], r["dpo"]) == pytest.approx((margin, -math.log(sigmoid(0.5 * (margin - 0.2))), -math.log(sigmoid(0.5 * margin))), abs=3e-6)


def test_few_profiles_write_nothing_of_texts(texts, both, monkeypatch):
    """Up to PROFILES profiles go with the task: no table of the texts is staged, whose rows of many texts filled executors."""
    style, _ = both
    monkeypatch.setattr(profiles, "staged", lambda *_: pytest.fail("staged"))
    assert profiles.nearest(texts.select("k", "text"), style, top=2).count() == 2 * texts.count()


def test_blocks_are_small(spark):
    """A block of texts with all the trigrams they can have is no row of megabytes."""
    rng = random.Random(4)
    long = spark.createDataFrame([(i, "".join(chr(97 + rng.randrange(26)) for _ in range(3000))) for i in range(600)], "k long, text string").coalesce(1)
    assert max(len(r["rows"]) for r in profiles._blocks(long).collect()) < 1 << 20
