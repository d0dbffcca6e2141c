"""Toxicity by a convolutional text classifier, trained in numpy.

A word's vector is the sum of three hashed embeddings: of the word, of its first four bytes and of its first five, so
that forms of one stem that the sample lacks are near those it has. Filters of several widths run over the whole text,
their largest responses are kept, and a logistic layer scores them. Responses of each embedding cell to each part of
each filter are tabulated after training, which leaves three table look-ups a word and sums.

The model is fitted on every row of docs that has a label and whose crc32 of doc_id mod 3 is not 1, whole and as often as
it is there. Rows are dealt to shards of some SHARD rows by hash, and their cells written once. In each epoch every shard
goes on from the model that all shared so far, by itself and in the task that holds it; then models (and the state of
their steps) are averaged by rows, slice by slice, so that the driver gets one model of some 3 MB an epoch, whatever the
number of rows. A fifth of the rows is not trained on: it sets the scale of the scores and, by language, the threshold
of `flagged`, all by counts of logits in steps of 1 / STEPS. Of a text of over LONG words those places are learnt from
where the model responds most, looked for in all of it each time. `predicted` is score >= 0.7 in any language. The score comes
from the text alone.

Defined results: null and empty texts have no words and get the score of an empty text. A doc_id with several labels is
toxic if any says so; labels other than 0 and 1 are ignored. Without both labels among the rows every score is the share
of toxic labels (0 without any). Languages with too few labels in the held-back fifth, and null ones, take 0.7. Rows
that repeat are scored each; extra columns are ignored. A very long text is scored whole, as one row of a batch. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Sieve, Words, blobs, discard, keep_rows, map_batches, runs_of, staged, tidy

CELLS, DIM, WIDTHS, FILTERS = 1 << 14, 16, (1, 2, 3), 8
PAD = max(WIDTHS) - 1
THRESHOLD = 0.7
#: Rows that one task trains on by itself; words of a text that are held at once; slices of a model; steps of a logit.
SHARD, LONG, SLICES, STEPS = 4000, 30_000, 32, 256


def cells_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding cells (places, 3) of the words of some texts, each text after PAD empty places (cell CELLS); and
    where each text begins."""
    words = Words([t.lower() for t in texts], ALNUM)
    s, e, first = words.starts, words.ends, words.first
    rows = len(texts)
    counts = np.diff(first)
    out = np.full((len(s) + PAD * (rows + 1), 3), CELLS, np.int32)
    at = np.arange(len(s)) + PAD * (1 + np.repeat(np.arange(rows), counts))
    for k, end in enumerate((e, np.minimum(e, s + 4), np.minimum(e, s + 5))):
        out[at, k] = (words.hashes(s, end) + np.uint64(k * 0x9E37)) % np.uint64(CELLS)
    return out, first[:-1] + PAD * np.arange(rows)


@dataclass
class Model:
    """Tables for scoring. table: (cells + 1, filter parts); bias by filter; weights of the last layer; scale of the
    logit; thresholds by language."""

    table: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)
    constant: float | None = None

    def logits(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        for lo, hi in runs_of(texts, 1 << 18):
            out[lo:hi] = self.logits_of(*cells_of(texts[lo:hi]))
        return out

    def logits_of(self, cells: np.ndarray, begin: np.ndarray) -> np.ndarray:
        parts = self.table[cells[:, 0]]
        parts += self.table[cells[:, 1]]
        parts += self.table[cells[:, 2]]
        pooled = [np.maximum.reduceat(x, begin, axis=0) for x in responses(parts)]
        return np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0) @ self.weights + self.offset

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return sigmoid(self.logits(texts) * self.scale[0] + self.scale[1])


def responses(parts: np.ndarray) -> list[np.ndarray]:
    """By width, the sums of filter parts for each window start; the last places see fewer parts."""
    out, at = [], 0
    for w in WIDTHS:
        x = parts[:, at : at + FILTERS].copy()
        for o in range(1, w):
            at += FILTERS
            x[:-o] += parts[o:, at : at + FILTERS]
        at += FILTERS
        out.append(x)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


#: Where the filter parts of each width begin.
PART_AT = np.concatenate([[0], np.cumsum([FILTERS * w for w in WIDTHS])])


def gradients(params: dict, cells: np.ndarray, begin: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """The weighted cross entropy of texts (their cells one after the other, and where each begins) and its gradients;
    they reach only the places that the pooling chose."""
    E, W = params["E"], params["W"]
    x = E[cells[:, 0]] + E[cells[:, 1]] + E[cells[:, 2]]
    found = responses(x @ W)
    pooled = np.concatenate([np.maximum.reduceat(f, begin, axis=0) for f in found], axis=1)
    active = np.maximum(pooled + params["b"], 0)
    p = sigmoid(active @ params["v"] + params["c"][0])
    loss = float(-(weight * np.log(np.maximum(np.where(toxic > 0, p, 1 - p), 1e-30))).mean())
    error = ((p - toxic) * weight / len(toxic)).astype(E.dtype)
    grads = {k: np.zeros_like(v) for k, v in params.items()}
    grads["v"] = active.T @ error
    grads["c"][0] = error.sum()
    back = error[:, None] * params["v"] * (active > 0)
    grads["b"] = back.sum(0)
    ends = np.append(begin[1:], len(cells))
    for k, (w, f) in enumerate(zip(WIDTHS, found, strict=True)):
        at = np.array([b + f[b:e].argmax(0) for b, e in zip(begin, ends, strict=True)])
        g = back[:, k * FILTERS : (k + 1) * FILTERS]
        for o in range(w):
            cols = slice(PART_AT[k] + o * FILTERS, PART_AT[k] + (o + 1) * FILTERS)
            places = np.minimum(at + o, len(cells) - 1)
            live = g * (at + o < len(cells))
            grads["W"][:, cols] += np.einsum("rfd,rf->df", x[places], live)
            toward = live[:, :, None] * W[:, cols].T[None]
            for j in range(3):
                np.add.at(grads["E"], cells[places, j], toward)
    grads["E"][CELLS] = 0
    return loss, grads


def started(seed: int = 11) -> dict[str, np.ndarray]:
    """Parameters before training, and both moments of Adam's steps."""
    rng = np.random.default_rng(seed)
    params = {
        "E": rng.normal(0, 0.1, (CELLS + 1, DIM)).astype(np.float32),
        "W": rng.normal(0, 0.3, (DIM, int(PART_AT[-1]))).astype(np.float32),
        "b": np.zeros(FILTERS * len(WIDTHS), np.float32),
        "v": np.full(FILTERS * len(WIDTHS), 0.3, np.float32),
        "c": np.full(1, -1.0, np.float32),
    }
    params["E"][CELLS] = 0
    return params | {f"{n}{k}": np.zeros_like(v) for n in "12" for k, v in params.items()}


def telling(params: dict, cells: np.ndarray) -> np.ndarray:
    """Of the cells of a long text, the places that the pooling chooses, with what their windows hold and empty places
    between them."""
    if len(cells) <= LONG:
        return cells
    best, places = np.full(FILTERS * len(WIDTHS), -np.inf), np.zeros(FILTERS * len(WIDTHS), np.int64)
    for lo in range(0, len(cells), LONG):
        part = cells[lo : lo + LONG + PAD]
        x = params["E"][part[:, 0]] + params["E"][part[:, 1]] + params["E"][part[:, 2]]
        found = np.concatenate([f[:LONG] for f in responses(x @ params["W"])], axis=1)
        at = found.argmax(0)
        top = found[at, np.arange(len(at))]
        best, places = np.where(top > best, top, best), np.where(top > best, at + lo, places)
    empty = np.full((PAD, 3), CELLS, cells.dtype)
    return np.concatenate([x for p in np.unique(places) for x in (cells[p : p + PAD + 1], empty)])


def epoch(state: dict, steps: int, ready: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, rng: np.random.Generator, rate: float = 0.01) -> dict:
    """The state after one pass over some texts (their cells) with Adam, which has made so many steps before."""
    state = {k: v.copy() for k, v in state.items()}
    params = {k: state[k] for k in "EWbvc"}
    order = rng.permutation(len(ready))
    for lo in range(0, len(order), 32):
        rows = order[lo : lo + 32]
        own = [telling(params, ready[r]) for r in rows]
        cells = np.concatenate(own).astype(np.int32)
        drop = rng.random(len(cells)) < 0.1
        cells = np.where(drop[:, None], CELLS, cells)
        begin = np.concatenate([[0], np.cumsum([len(c) for c in own])[:-1]])
        _, grads = gradients(params, cells, begin, toxic[rows], weight[rows])
        steps += 1
        for k, g in grads.items():
            first, second = state[f"1{k}"], state[f"2{k}"]
            first += 0.1 * (g - first)
            second += 0.001 * (g * g - second)
            m, s = first / (1 - 0.9**steps), second / (1 - 0.999**steps)
            params[k] -= rate * (m / (np.sqrt(s) + 1e-8) + (1e-3 * params[k] if k in "EW" else 0))
    return state


def fit(shards: DataFrame, rows: int, positive: int, n_shards: int, *, epochs: int = 8) -> Model:
    """Trains on whole texts: shards (shard, place, toxic, held, cells), with each shard in one file and in order."""
    state = started()
    sizes = np.cumsum([0, *(v.size for v in state.values())])
    cut = np.linspace(0, sizes[-1], SLICES + 1).astype(int)
    weigh = np.array([rows / (2 * max(1, rows - positive)), rows / (2 * max(1, positive))])
    mine = shards.where("not held").select("shard", "toxic", "cells")
    for e in range(epochs):
        shared = shards.sparkSession.sparkContext.broadcast((state, e * -(-rows // n_shards // 32)))

        def learnt(shard: int, own: list[tuple[float, bytes]], e: int = e, shared=shared) -> tuple[int, np.ndarray]:
            state, steps = shared.value
            toxic = np.array([t for t, _ in own], float)
            ready = [np.frombuffer(c, np.int16).reshape(-1, 3) for _, c in own]
            after = epoch(state, steps, ready, toxic, weigh[toxic.astype(int)], np.random.default_rng((11, e, shard)))
            return len(own), np.concatenate([v.ravel() for v in after.values()]).astype(float) * len(own)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, own, n, total, least = None, [], 0, 0.0, None
            for batch in batches:
                for s, t, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    if s != shard and own:
                        more = learnt(shard, own)
                        n, total, own = n + more[0], total + more[1], []
                    shard, least = s, s if least is None else min(least, s)
                    own.append((t, c))
            if own:
                more = learnt(shard, own)
                n, total = n + more[0], total + more[1]
                parts = [total[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([least] * SLICES, pa.int64()), pa.array([n] * SLICES, pa.int64()), pa.array(parts, pa.binary())], ["slice", "least", "n", "sums"])

        def added(key: tuple, table: pa.Table) -> pa.Table:
            own = table.sort_by("least")
            total = sum(np.frombuffer(x.as_py(), float) for x in own.column("sums"))
            return pa.table({"slice": [key[0]], "mean": [(total / sum(own.column("n").to_pylist())).astype(np.float32).tobytes()]}, pa.schema([("slice", pa.int32()), ("mean", pa.binary())]))

        sums = mine.mapInArrow(tidy(run), "slice int, least long, n long, sums binary")
        found = sums.groupBy("slice").applyInArrow(lambda key, t: added(tuple(k.as_py() for k in key), t), "slice int, mean binary").collect()
        whole = np.concatenate([np.frombuffer(r["mean"], np.float32) for r in sorted(found, key=lambda r: r["slice"])])
        state = {k: whole[a:b].reshape(v.shape).copy() for (k, v), a, b in zip(state.items(), sizes, sizes[1:], strict=False)}
        shared.destroy()
    return Model((state["E"] @ state["W"]).astype(np.float32), state["b"], state["v"], float(state["c"][0]))


def platt(logits: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logit by Newton steps, with Platt's softened targets; n: how many rows each stands for."""
    pos, neg = n @ toxic, n.sum() - n @ toxic
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(toxic > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = n * np.where(toxic > 0, 0.5 / pos, 0.5 / neg)
    a, b = 1.0, 0.0
    for _ in range(60):
        p = sigmoid(a * logits + b)
        g = weight * (p - target)
        h = weight * np.maximum(p * (1 - p), 1e-6)
        grad = np.array([g @ logits + 1e-3 * (a - 1), g.sum()])
        hess = np.array([[h @ logits**2 + 1e-3, h @ logits], [h @ logits, h.sum() + 1e-9]])
        da, db = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = a - da, b - db
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


#: Labels of each kind that a language needs for a threshold of its own.
LEAST = 15


def language_threshold(scores: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> float:
    """Where the F1 score is best; of equal ones the nearest to THRESHOLD. n: how many rows each stands for."""
    best = (-1.0, 0.0, THRESHOLD)
    for t in np.arange(0.4, 0.91, 0.02):
        hit = scores >= t
        f1 = 2 * (n @ (hit & (toxic > 0))) / max(1, n @ hit + n @ toxic)
        best = max(best, (round(float(f1), 6), -abs(t - THRESHOLD), float(t)))
    return round(best[2], 2)


def sampled(docs: DataFrame, labels: DataFrame, *, max_toxic: int, max_clean: int, max_bytes: int) -> DataFrame:
    """doc_id, toxic, text, lang of a bounded sample of labelled rows, for a look at them; `train` takes all."""
    marks = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    order = [F.xxhash64(F.col("doc_id"), F.lit("sample")), F.col("doc_id")]
    chosen = [marks.where(F.col("toxic") == y).orderBy(*order).limit(n) for y, n in ((1, max_toxic), (0, max_clean))]
    sample = chosen[0].unionByName(chosen[1])
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    # at most max_toxic + max_clean rows are broadcast; tasks add up rows of a doc_id first
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang")).where(F.octet_length("text") <= max_bytes)
    one = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic")
    return one.agg(F.min_by(F.struct("text", "lang"), F.struct(F.xxhash64("text"), "text", "lang")).alias("r")).select("doc_id", "toxic", "r.*")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic, text, lang of all rows to learn from."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    marks = labels.where("toxic in (0, 1) and doc_id is not null").where(fold != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.where(fold != 1).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"))
    keys = staged(marks, "toxicity-labels")
    return Sieve(keys, "doc_id").passed(rows, rows["doc_id"]).join(keys, "doc_id")


def _dealt(rows: DataFrame) -> DataFrame:
    """shard, place, toxic, held, lang, cells of labelled rows, written in shards."""

    def cells(batch: pa.RecordBatch) -> dict:
        ready = [cells_of([t])[0].astype(np.int16).tobytes() for t in blobs(batch.column(2))]
        held = [d * 2654435761 % 1000 < 200 for d in batch.column(0).to_pylist()]
        return {"place": batch.column(4), "toxic": batch.column(1).cast(pa.int32()), "held": held, "lang": batch.column(3), "cells": ready}

    place = F.xxhash64("doc_id", "text").alias("place")
    once = staged(map_batches(rows.select("doc_id", "toxic", "text", "lang", place), cells, "place long, toxic int, held boolean, lang string, cells binary"), "toxicity-cells")
    n_shards = max(1, -(-once.count() // SHARD))
    shard = F.pmod("place", F.lit(n_shards)).cast("int").alias("shard")
    out = staged(once.select(shard, "*").repartition(n_shards, "shard").sortWithinPartitions("shard", "place", "cells"), "toxicity-shards")
    discard(once)
    return out


def train(docs: DataFrame, labels: DataFrame, *, epochs: int = 8) -> Model:
    shards = _dealt(labelled(docs, labels))
    by = {(r["held"], r["toxic"]): r["n"] for r in shards.groupBy("held", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, bad = by.get((False, 0), 0), by.get((False, 1), 0)
    if not clean or not bad:
        empty = np.zeros((CELLS + 1, FILTERS * sum(WIDTHS)), np.float32)
        zero = np.zeros(FILTERS * len(WIDTHS), np.float32)
        every = sum(by.values())
        discard(shards)
        return Model(empty, zero, zero, 0.0, constant=(bad + by.get((True, 1), 0)) / every if every else 0.0)
    n_shards = shards.select(F.max("shard")).first()[0] + 1
    model = fit(shards, clean + bad, bad, n_shards, epochs=epochs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def steps(batch: pa.RecordBatch) -> dict:
        own = [np.frombuffer(c, np.int16).reshape(-1, 3).astype(np.int32) for c in batch.column(2).to_pylist()]
        found = np.array([shared.value.logits_of(c, np.zeros(1, np.int64))[0] for c in own])
        return {"lang": batch.column(0), "toxic": batch.column(1), "step": np.rint(np.clip(found, -64, 64) * STEPS).astype(np.int64)}

    rows = map_batches(shards.where("held").select("lang", "toxic", "cells"), steps, "lang string, toxic int, step long")
    counts = staged(rows.groupBy("lang", "toxic", "step").agg(F.count(F.lit(1)).alias("n")), "toxicity-logits")

    def taken(some: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # 2 * 128 * STEPS rows at most
        got = some.groupBy("toxic", "step").agg(F.sum("n").alias("n")).orderBy("toxic", "step").collect()
        return tuple(np.array([r[c] for r in got], float) for c in ("step", "toxic", "n"))

    at, toxic, n = taken(counts)
    if len(at):
        model.scale = platt(at / STEPS, toxic, n)
        kinds = counts.where("lang <> ''").groupBy("lang").agg(F.sum(F.col("n") * F.col("toxic")).alias("bad"), F.sum("n").alias("n"))
        for r in kinds.where(f"bad >= {LEAST} and n - bad >= {LEAST}").orderBy("lang").collect():
            at, toxic, n = taken(counts.where(F.col("lang") == r["lang"]))
            model.thresholds[r["lang"]] = language_threshold(sigmoid(at / STEPS * model.scale[0] + model.scale[1]), toxic, n)
    discard(shards, counts)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, lang_threshold, flagged (score reaches the language's threshold) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")

    def run(batch: pa.RecordBatch) -> dict:
        model = shared.value
        scores = model.scores([b or b"" for b in blobs(batch.column(1))])
        limits = np.array([model.thresholds.get(x, THRESHOLD) for x in batch.column(2).to_pylist()])
        return {
            "doc_id": batch.column(0),
            "score": scores,
            "predicted": (scores >= THRESHOLD).astype(np.int32),
            "lang_threshold": limits,
            "flagged": scores >= limits,
        }

    schema = "doc_id long, score double, predicted int, lang_threshold double, flagged boolean"
    return map_batches(docs.select("doc_id", "text", lang.alias("lang")), run, schema)


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not flagged, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def clean(batch: pa.RecordBatch) -> np.ndarray:
        model, names = shared.value, batch.schema.names
        scores = model.scores([b or b"" for b in blobs(batch.column(names.index("text")))])
        langs = batch.column(names.index("lang")).to_pylist() if "lang" in names else [None] * batch.num_rows
        return scores < np.array([model.thresholds.get(x, THRESHOLD) for x in langs])

    return keep_rows(docs, clean)
