"""Texts against profiles, text by text: one pass over a text gives all that its distance from a profile needs, so no term
or trigram of a text ever shuffles.

`against` holds each text against one profile, whose counts (some 150 function words, TOP trigrams) go with the task.
`nearest` holds each text against all profiles and keeps the first few. Up to PROFILES profiles go with the task, and
nothing of a text is written or shuffled. More are dealt into packs of some PROFILES, texts into blocks of TEXTS, and each
pair of both is one cell (`grid.cells`); a block is small, since readers and writers hold many rows at once. In a cell the dense parts and the function words of
all profiles are had at once; they and a bound of the trigrams (no cosine is larger than the share of the text's norm that
lies on trigrams of any profile of the pack) bound each distance from below, and only profiles whose bound does not
exceed the text's k-th distance so far have their trigrams compared. So what a cell gives is k rows a text, not a row for
each pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.constants import DISTANCE_WEIGHTS, FUNCTION_WORDS, HISTOGRAM_CENTERS
from ..grid import cells, pack_of
from ..stage import discard, staged
from . import features as ft
from . import frequent
from . import textpass
from .distance import HALF_UP, Style, clamp, dense_parts, overall, slop
from .features import rounded

TOP, PROFILES, TEXTS = 500, 256, 32
#: Texts that are counted at once.
COUNTED = 500
#: Counts of trigrams of all profiles of a pack, by profile, that are held as one table.
TABLE = 4_000_000
WORDS = sorted(set(FUNCTION_WORDS))
_PLACE = {w: i for i, w in enumerate(WORDS)}
_COUNTED = ("tokens", "types", "squares", "once", "twice")
#: Dense measures of a text or profile, but for the histogram.
MEASURES = ["mean", "sd", *ft.MARKS, "flesch_kincaid", "coleman_liau", "ari", "avg_syllables", "ttr", "yule_k", "hapax", "dis", "simpson"]


def _word_stats(words: textpass.Words) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Of each text: the counts that richness is made of, and a table of the function words' counts."""
    n = len(words.texts)
    own, places, names, counts = ft.word_rows(words, np.arange(n))
    total = lambda x: np.bincount(own, x, n).astype(np.int64)
    stats = dict(zip(_COUNTED, (np.diff(words.first), total(np.ones(len(own))), total(counts * counts), total(counts == 1), total(counts == 2)), strict=True))
    at = np.array([_PLACE.get(w, -1) for w in names.to_pylist()], np.int64)[places]
    table = np.zeros((n, len(WORDS)), np.int64)
    table[own[at >= 0], at[at >= 0]] = counts[at >= 0]
    return stats, table


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The TOP most frequent trigrams and their counts, ties by trigram, sorted by trigram."""
    if len(text) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes, counts = np.unique(frequent.codes(text), return_counts=True)
    if len(codes) > TOP:
        first = np.sort(np.argsort(-counts, kind="stable")[:TOP])
        codes, counts = codes[first], counts[first]
    return codes, counts.astype(np.int64)


def _measured(counted: DataFrame, *more: str) -> DataFrame:
    """Dense measures of rows that have all counts."""
    columns = [*ft.shape_columns(), *ft.punctuation_columns(), *ft.readability_columns(), *ft.richness_columns()]
    return counted.select("k", *more, *columns).fillna(0, ["ttr", "yule_k", "hapax", "dis", "simpson"])


def _rows(texts: DataFrame, more: list[T.StructField], make) -> DataFrame:
    """All counts of each text (k, text), beside columns that make(table of function words, texts) gives."""
    schema = T.StructType([texts.schema["k"], *(T.StructField(c, T.LongType()) for c in (*ft.SUMS, *_COUNTED)), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in textpass.parts(batch, 1, COUNTED)):
            words = textpass.Words(part.column(1).to_pylist())
            stats, table = _word_stats(words)
            arrays = [part.column(0), *(pa.array(c) for c in textpass.counted(words).T), *(pa.array(stats[c]) for c in _COUNTED), *make(table, words.texts)]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return texts.select("k", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


# --- one profile ----------------------------------------------------------------------------------------------------


def against(texts: DataFrame, profile: Style) -> DataFrame:
    """The distance of each text (k, text; each row is a text) from the only profile of a style, with its parts and slop:
    k, p, parts, slop, base, overall. No profile, no rows."""
    own = np.zeros(len(WORDS), np.int64)
    for r in profile.words.collect():  # at most one of each function word
        own[_PLACE[r["word"]]] = r["n"]
    grams = sorted((ord(r["gram"][0]) << 42 | ord(r["gram"][1]) << 21 | ord(r["gram"][2]), r["n"]) for r in profile.grams.collect())  # at most TOP
    codes, counts = (np.array([g[i] for g in grams], np.int64) for i in (0, 1))
    names = ("word_dot", "word_norm", "gram_dot", "gram_norm")

    def make(table: np.ndarray, rows: list[str]) -> list[pa.Array]:
        out = np.zeros((4, len(rows)))
        out[0], out[1] = table @ own, (table * table).sum(1)
        for i, text in enumerate(rows):
            mine, n = _grams(text)
            _, a, b = np.intersect1d(mine, codes, assume_unique=True, return_indices=True)
            out[2, i], out[3, i] = n[a] @ counts[b], n @ n
        return [pa.array(x) for x in out]

    fields = [T.StructField(n, T.DoubleType()) for n in names]
    rows = _measured(_rows(texts.withColumn("k", F.struct("k", slop(F.col("text")).alias("slop"))), fields, make), *names)
    dense = profile.dense.withColumnRenamed("k", "p")
    both = rows.alias("a").crossJoin(F.broadcast(dense.alias("b")))  # a single row
    parts = {k: rounded(v) for k, v in dense_parts(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}")).items()}
    for name, kind, norm in (("function_words", "word", own), ("ngrams", "gram", counts)):
        cosine = F.col(f"a.{kind}_dot") / (F.sqrt(f"a.{kind}_norm") * F.lit(float(norm @ norm) ** 0.5))
        none = (F.col(f"a.{kind}_norm") == 0) | F.lit(not len(norm) or not norm.any())
        parts[name] = rounded(F.when(none, 0.5).otherwise(clamp(1.0 - cosine)))
    return overall(both.select(F.col("a.k.k").alias("k"), "b.p", *[c.alias(n) for n, c in parts.items()], F.col("a.k.slop").alias("_slop")), F.coalesce("_slop", F.lit(0.0)))


# --- all profiles ---------------------------------------------------------------------------------------------------


def _compared(texts: DataFrame) -> DataFrame:
    """Measures, function words and trigrams of each text."""
    lists = T.ArrayType(T.LongType())

    def make(table: np.ndarray, rows: list[str]) -> list[pa.Array]:
        grams = [_grams(t) for t in rows]
        kind = pa.list_(pa.int64())
        return [pa.array(list(table), kind), *(pa.array([g[i] for g in grams], kind) for i in (0, 1))]

    extra = ("fw", "codes", "counts")
    return _measured(_rows(texts, [T.StructField(n, lists) for n in extra], make), *extra)


def _blocks(texts: DataFrame) -> DataFrame:
    """The same of some TEXTS texts in a row, packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, small = TaskContext.get().partitionId() << 32, pa.ipc.IpcWriteOptions(compression="lz4")
        for whole in batches:
            for k in range(0, whole.num_rows, TEXTS):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, whole.schema, options=small) as out:
                    out.write_batch(whole.slice(k, TEXTS))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])
                block += 1

    return _compared(texts).mapInArrow(run, "block long, rows binary")


def _packs(profiles: Style, n_packs: int) -> DataFrame:
    """Profiles with all they are compared by, some PROFILES in a row."""
    point = lambda i: F.ascii(F.substring("gram", i, 1)).cast("long")
    code = F.shiftleft(point(1), 42) + F.shiftleft(point(2), 21) + point(3)
    words = profiles.words.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("by_word"))
    fw = F.transform(F.array(*[F.lit(w) for w in WORDS]), lambda w: F.coalesce(F.try_element_at("by_word", w), F.lit(0).cast("long")))
    none = F.map_from_entries(F.array().cast("array<struct<w:string,n:bigint>>"))
    grams = profiles.grams.groupBy("k").agg(F.array_sort(F.collect_list(F.struct(code.alias("code"), "n"))).alias("grams"))
    rows = profiles.dense.join(words, "k", "left").join(grams, "k", "left").withColumn("by_word", F.coalesce("by_word", none))
    entry = F.struct(F.col("k").alias("p"), F.array(*MEASURES).alias("measures"), "histogram", fw.alias("fw"), F.coalesce("grams.code", F.array().cast("array<bigint>")).alias("codes"), F.coalesce("grams.n", F.array().cast("array<bigint>")).alias("counts"))
    return rows.groupBy(pack_of("k", n_packs).alias("pack")).agg(F.sort_array(F.collect_list(entry)).alias("profiles"))


def _six(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e6 + 0.5) / 1e6


def _unit(x: np.ndarray) -> np.ndarray:
    return np.clip(x, 0.0, 1.0)


def _dense(x: dict[str, np.ndarray], hist: np.ndarray, y: dict[str, np.ndarray], hists: np.ndarray) -> dict[str, np.ndarray]:
    """The parts of `distance.dense_parts`, of texts (rows) and all profiles (columns)."""
    off = lambda c, scale: np.abs(x[c] - y[c]) / scale
    relative = lambda c: np.where(np.abs(y[c]) > 0.1, np.abs((x[c] - y[c]) / np.maximum(np.abs(y[c]), 1.0)), 0.0)
    safe = lambda v: np.where(v > 0, v, 1.0)
    syllables = np.where(y["avg_syllables"] > 0, np.abs((x["avg_syllables"] - y["avg_syllables"]) / safe(y["avg_syllables"])), 0.0)
    yule = np.where(y["yule_k"] > 0, np.abs((x["yule_k"] - y["yule_k"]) / np.maximum(y["yule_k"], 50.0)), 0.0)
    gaps = np.diff(HISTOGRAM_CENTERS)
    moved = (np.abs(np.cumsum(hist - hists, axis=-1)[..., :-1]) * gaps).sum(-1) / (HISTOGRAM_CENTERS[-1] - HISTOGRAM_CENTERS[0])
    return {
        "sentences": _six(np.where((x["mean"] == 0) | (y["mean"] == 0), 0.5, _unit(moved))),
        "terminal": _six(_unit((off("question", 10) + off("exclamation", 10)) / 2)),
        "structural": _six(_unit((off("em_dash", 20) + off("semicolon", 10) + off("colon", 10) + off("paren", 20)) / 4)),
        "readability": _six(_unit((relative("flesch_kincaid") + relative("coleman_liau") + syllables) / 3)),
        "richness": _six(_unit((yule + np.abs(x["hapax"] - y["hapax"]) * 2 + np.abs(x["simpson"] - y["simpson"]) * 10) / 3)),
    }


class _Pack:
    """Profiles as arrays."""

    def __init__(self, profiles: list[dict]):
        self.names = [p["p"] for p in profiles]
        self.measures = dict(zip(MEASURES, np.array([p["measures"] for p in profiles]).T, strict=True))
        self.hists, self.table = np.array([p["histogram"] for p in profiles]), np.array([p["fw"] for p in profiles], float)
        self.norms = (self.table * self.table).sum(1)
        self.codes, self.counts = [np.array(p["codes"], np.int64) for p in profiles], [np.array(p["counts"], float) for p in profiles]
        self.gram_norms, self.every = [c @ c for c in self.counts], np.unique(np.concatenate(self.codes))
        self.grid = None
        if len(profiles) * len(self.every) <= TABLE:
            self.grid = np.zeros((len(profiles), len(self.every)))
            for row, codes, counts in zip(self.grid, self.codes, self.counts, strict=True):
                row[np.searchsorted(self.every, codes)] = counts

    def dot(self, j: int, codes: np.ndarray, counts: np.ndarray, places: np.ndarray) -> float:
        """Of a profile's trigrams and those of a text that any profile has (their places among all of the pack's)."""
        if self.grid is not None:
            return self.grid[j][places] @ counts
        _, a, b = np.intersect1d(codes, self.codes[j], assume_unique=True, return_indices=True)
        return counts[a] @ self.counts[j][b]


def _lists(block: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and where each list begins."""
    column = block.column(name)
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(), offsets - offsets[0]


def _near(block: pa.RecordBatch, profiles: list[dict] | _Pack, top: int) -> tuple[list[int], list[int], list[float], int]:
    """Rows of the block, profiles and distances: the first `top` of each text; and how many trigram lists were compared."""
    pack = profiles if isinstance(profiles, _Pack) else _Pack(profiles)
    rows = block.num_rows
    x = {m: block.column(m).to_numpy()[:, None] for m in MEASURES}
    every = _dense(x, _lists(block, "histogram")[0].reshape(rows, 1, -1), pack.measures, pack.hists)
    fw = _lists(block, "fw")[0].reshape(rows, -1).astype(float)
    own = (fw * fw).sum(1)[:, None]
    some = pack.norms * own > 0
    every["function_words"] = _six(np.where(some, _unit(1.0 - (fw @ pack.table.T) / (np.sqrt(np.maximum(own, 1.0)) * np.sqrt(np.where(some, pack.norms, 1.0)))), 0.5))
    (codes, begin), (counts, _), compared = _lists(block, "codes"), _lists(block, "counts"), 0
    places = np.searchsorted(pack.every, codes)
    shared = pack.every[np.minimum(places, len(pack.every) - 1)] == codes if len(pack.every) else np.zeros(len(codes), bool)
    out: tuple[list, list, list] = ([], [], [])
    for i in range(rows):
        parts = {k: v[i] for k, v in every.items()}
        own_rows = slice(begin[i], begin[i + 1])
        n, in_any = counts[own_rows].astype(float), shared[own_rows]
        norm = n @ n
        mine, n, at = codes[own_rows][in_any], n[in_any], places[own_rows][in_any]
        least = 0.0 if not norm else max(0.0, 1.0 - np.sqrt(n @ n / norm) - 1e-6)
        base = lambda grams, j: _unit(sum(((grams if k == "ngrams" else parts[k][j]) * w for k, w in DISTANCE_WEIGHTS.items()), 0.0))
        bound = base(least, slice(None))
        best: list[tuple[float, int]] = []
        for j in np.argsort(bound, kind="stable"):
            if len(best) == top and bound[j] > best[-1][0] + 1e-6:
                break
            compared += 1
            grams = 0.5
            if norm and pack.gram_norms[j]:
                grams = float(_six(_unit(1.0 - pack.dot(j, mine, n, at) / (np.sqrt(norm) * np.sqrt(pack.gram_norms[j])))))
            best = sorted([*best, (float(_six(base(grams, j) + HALF_UP)), int(j))])[:top]  # profiles are sorted, so ties go by name
        for d, j in best:
            out[0].append(i)
            out[1].append(j)
            out[2].append(d)
    return *out, compared


def _nearest_of_few(texts: DataFrame, profiles: Style, top: int) -> DataFrame:
    """`nearest`, where all profiles go with the task: at most PROFILES, each with at most TOP trigrams."""
    found = _packs(profiles, 1).collect()
    own = [p.asDict(recursive=True) for p in found[0]["profiles"]] if found else []
    kind, name = texts.schema["k"].dataType, profiles.dense.schema["k"].dataType
    schema = T.StructType([T.StructField("k", kind), T.StructField("rank", T.IntegerType()), T.StructField("p", name), T.StructField("distance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = _Pack(own) if own else None
        for whole in batches:
            for part in (whole.slice(k, COUNTED) for k in range(0, whole.num_rows, COUNTED)) if pack else ():
                rows, which, far, _ = _near(part, pack, top)
                at = np.array(rows, np.int64)
                rank = np.arange(len(at)) - np.searchsorted(at, at) + 1
                names = pa.array(pack.names).take(pa.array(which, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("k").take(pa.array(at)), pa.array(rank, pa.int32()), names, pa.array(far, pa.float64())], schema.names)

    return _compared(texts).mapInArrow(run, schema)


def nearest(texts: DataFrame, profiles: Style, *, top: int = 3) -> DataFrame:
    """k, rank, p, distance: the nearest profiles of each text (k, text; each row is a text of its own), ties by profile.
    Distances are those of `distance.distances` without slop, which is the same for all profiles of a text."""
    n_packs = max(1, -(-profiles.dense.count() // PROFILES))
    if n_packs == 1:
        return _nearest_of_few(texts, profiles, top)
    blocks = staged(_blocks(texts), "profile-blocks")
    slots = max(1, blocks.count())
    packs = staged(_packs(profiles, n_packs), "profile-packs")
    kind, name = texts.schema["k"].dataType, profiles.dense.schema["k"].dataType
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("k", kind), T.StructField("p", name), T.StructField("distance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                texts = pa.ipc.open_stream(batch.column("rows")[k].as_py()).read_next_batch()
                own = batch.column("profiles")[k].as_py()
                rows, which, far, _ = _near(texts, own, top)
                at = pa.array(rows, pa.int64())
                number = pa.array([(batch.column("block")[k].as_py() << 20) + i for i in rows], pa.int64())
                names = pa.array([p["p"] for p in own]).take(pa.array(which, pa.int64()))
                yield pa.RecordBatch.from_arrays([number, texts.column("k").take(at), names, pa.array(far, pa.float64())], schema.names)

    found = cells(blocks, packs, slots=slots, n_packs=n_packs).select("block", "rows", "profiles").mapInArrow(run, schema)
    order = Window.partitionBy("row").orderBy("distance", "p")
    out = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = staged(out.select("k", "rank", "p", "distance"), "nearest")
    discard(blocks, packs)
    return out
