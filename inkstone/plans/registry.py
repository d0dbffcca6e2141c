"""All registered queries of the engine, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean, prompts, tokens
from ..functions.constants import BANNED_WORDS
from ..operators import backends, corpus, decode, distance, evaluate, frequent, lexicon, preference, profiles, rank
from ..operators import features as ft
from ..operators.sentences import sentences
from ..sources import readers, sinks, walk
from ..stage import fresh, staged
from ..streaming import learn
from . import sql as S

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(text: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if text:
            _SQL[f.__name__] = text
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def keyed(df: DataFrame, key: Column | str) -> DataFrame:
    return df.select((F.col(key) if isinstance(key, str) else key).alias("k"), "text")


BY_SOURCE = "src AS (SELECT source AS k, doc_id AS row, text FROM documents)"
BY_DOC = "src AS (SELECT doc_id AS k, doc_id AS row, text FROM documents)"

#: Formulaic additions by doc_id, since plain documents have none.
ADDED = [
    "",
    " We delve into a rich tapestry of robust ideas, and it's worth noting the framework.",
    " Furthermore, at the end of the day, implementation matters.",
    " A holistic approach plays a pivotal role in the ecosystem of innovative, vibrant, diverse paradigms.",
    " " + "again and again and " * 12 + "again.",
    " The landscape of leverage.",
]
ADDED_SQL = "text || [" + ", ".join(S.q(a) for a in ADDED) + f"][1 + doc_id % {len(ADDED)}]"


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = F.element_at(F.array(*[F.lit(a) for a in ADDED]), (F.col("doc_id") % len(ADDED) + 1).cast("int"))
    return docs(spark, sf_dir).select("doc_id", "source", "lang", F.concat("text", added).alias("text"))


MARKED = f"marked AS (SELECT doc_id, source, lang, {ADDED_SQL} AS text FROM documents)"


@query(
    f"SELECT doc_id, CAST(len({S.words('text')}) AS BIGINT) AS words, CAST(length(text) AS BIGINT) AS chars, CAST(len({S.plain('text')}) AS BIGINT) AS plain_words, "
    "CAST(len(list_filter(string_split(replace(replace(text, '!', '.'), '?', '.'), '.'), lambda s: true)) - CASE WHEN regexp_matches(text, '[.!?]\\z') OR text = '' THEN 1 ELSE 0 END AS BIGINT) AS terminated FROM documents"
)
def q01_word_stats(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select(
        "doc_id",
        tokens.unicode_word_count(t).cast("long").alias("words"),
        F.length(t).cast("long").alias("chars"),
        tokens.plain_word_count(t).cast("long").alias("plain_words"),
        tokens.terminated_sentence_count(t).cast("long").alias("terminated"),
    )


@query(f"""WITH {BY_SOURCE}, {S.counts_cte('src').strip()},
r AS (SELECT k, CAST(sum(n) AS BIGINT) AS t, count(*) AS v, CAST(sum(n * n) AS BIGINT) AS s2, count(*) FILTER (WHERE n = 1) AS v1, count(*) FILTER (WHERE n = 2) AS v2 FROM wc GROUP BY k)
SELECT k AS source, t AS tokens, v AS types, {S.RICH} FROM r""")
def q02_richness_by_source(spark, sf_dir):
    return ft.richness(ft.word_counts(keyed(docs(spark, sf_dir), "source"))).withColumnRenamed("k", "source")


@query(f"""WITH {BY_SOURCE}, {S.counts_cte('src').strip()}
SELECT k AS source, word, n, round(CAST(n AS DOUBLE) / total, 6) AS freq FROM wc JOIN (SELECT k, sum(n) AS total FROM wc GROUP BY k) USING (k)
WHERE word IN ({S.literals(S.FUNCTION_WORDS)})""")
def q03_function_words(spark, sf_dir):
    return ft.function_words(ft.word_counts(keyed(docs(spark, sf_dir), "source"))).withColumnRenamed("k", "source")


@query("""SELECT source, gram, n, rank FROM (SELECT source, gram, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, gram) AS rank
FROM (SELECT source, s[i] || s[i + 1] || s[i + 2] AS gram FROM (SELECT source, s, unnest(range(1, len(s) - 1)) AS i FROM (SELECT source, string_split(lower(text), '') AS s FROM documents)))
GROUP BY source, gram) WHERE rank <= 500""")
def q04_trigram_top500(spark, sf_dir):
    return frequent.top_trigrams(keyed(docs(spark, sf_dir), "source")).withColumnRenamed("k", "source")


@query("SELECT doc_id, " + ", ".join(
    f"round(CASE WHEN w > 0 THEN {f('text')} * 1000.0 / w ELSE 0 END, 6) AS {m}" for m, f in S.MARKS_SQL.items()
) + f" FROM (SELECT doc_id, text, len({S.words('text')}) AS w FROM documents)")
def q05_punctuation(spark, sf_dir):
    rows = docs(spark, sf_dir).select(
        F.col("doc_id").alias("k"), tokens.unicode_word_count(F.col("text")).alias("n_words"), *[c.alias(m) for m, c in ft.punctuation_counts(F.col("text")).items()]
    )
    return ft.punctuation(rows).withColumnRenamed("k", "doc_id")


@query(f"""WITH {BY_DOC}, {S.sentences_cte('src').strip()}
SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY sid) - 1 AS pos, sentence, CAST(len({S.words('sentence')}) AS BIGINT) AS words FROM sents""")
def q06_sentences(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence", tokens.unicode_word_count(F.col("sentence")).cast("long").alias("words"))


_HIST = ", ".join(f"round(CAST({b} AS DOUBLE) / count(*) FILTER (WHERE len > 0), 6)" for b in S.bins("len"))


@query(f"""WITH {BY_SOURCE}, {S.sentences_cte('src').strip()}, l AS (SELECT k, len({S.words('sentence')}) AS len FROM sents)
SELECT k AS source, round(CAST(sum(len) AS DOUBLE) / count(*) FILTER (WHERE len > 0), 6) AS mean,
round(sqrt((count(*) FILTER (WHERE len > 0) * sum(len * len) - sum(len) * sum(len)) / (CAST(count(*) FILTER (WHERE len > 0) AS DOUBLE) * count(*) FILTER (WHERE len > 0))), 6) AS sd,
[{_HIST}] AS histogram FROM l GROUP BY k""")
def q07_sentence_histogram(spark, sf_dir):
    return ft.sentence_shape(ft.sums(keyed(docs(spark, sf_dir), "source"))).withColumnRenamed("k", "source")


_DOC_STYLE = f"WITH {BY_DOC}, {S.style_cte('src', 'a').strip()}"


@query(f"{_DOC_STYLE} SELECT k AS doc_id, flesch_kincaid, coleman_liau, ari, avg_syllables FROM a_dense")
def q08_readability(spark, sf_dir):
    return ft.readability(ft.sums(keyed(docs(spark, sf_dir), "doc_id"))).withColumnRenamed("k", "doc_id")


@query(f"""WITH {BY_SOURCE}, {S.counts_cte('src').strip()}, t AS (SELECT k, sum(n) AS total, count(*) AS vocabulary_size FROM wc GROUP BY k)
SELECT k AS source, vocabulary_size, list_sort(list_filter([{S.BANNED}], lambda b: NOT list_contains(list(word), b))) AS banned,
coalesce(list_sort(list(word) FILTER (WHERE n > 3 AND strlen(word) > 4 AND CAST(n AS DOUBLE) / total > 0.001)), []) AS preferred
FROM wc JOIN t USING (k) GROUP BY k, vocabulary_size""")
def q09_vocabulary(spark, sf_dir):
    return ft.vocabulary(ft.word_counts(keyed(docs(spark, sf_dir), "source"))).withColumnRenamed("k", "source")


@query(f"SELECT page_id, {S.html_strip('html')} AS text FROM pages")
def q10_html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", clean.strip_html_tags(F.col("html")).alias("text"))


@query(f"SELECT page_id, {S.tracking('url')} AS url FROM pages")
def q11_tracking_params(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", clean.strip_tracking(F.col("url")).alias("url"))


@query(f"SELECT page_id, t AS text FROM ({S.clean_steps('html', 'pages', 'page_id')})")
def q12_clean_chain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", clean.clean(F.col("html")).alias("text"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def q13_dedupe(spark, sf_dir):
    return corpus.dedupe(docs(spark, sf_dir))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) <= (SELECT greatest(ceil(count(*) * 0.1), 1) FROM documents) AS held_out FROM documents")
def q14_holdout_split(spark, sf_dir):
    return corpus.holdout_split(docs(spark, sf_dir).select("doc_id"), 0.1)


@query(f"SELECT coalesce(lang, 'none') AS context, count(*) AS samples, CAST(sum(len({S.words('text')})) AS BIGINT) AS words FROM documents GROUP BY 1")
def q15_ingest_report(spark, sf_dir):
    return corpus.report(docs(spark, sf_dir), "lang")


@query(f"WITH {MARKED} SELECT doc_id, round(CAST({S.slop('text', f'len({S.words("text")})')} AS DOUBLE), 6) AS slop FROM marked")
def q16_slop_canonical(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", F.round(distance.slop(F.col("text")).cast("double"), 6).alias("slop"))


@query(f"WITH {MARKED} SELECT doc_id, round(CAST({S.slop_presence('text')} AS DOUBLE), 6) AS slop FROM marked")
def q17_slop_presence(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", F.round(distance.slop_presence(F.col("text")).cast("double"), 6).alias("slop"))


@query(f"WITH {MARKED} SELECT doc_id, round(CAST({S.repetition('text')} AS DOUBLE), 6) AS repetition FROM marked")
def q18_repetition(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", F.round(ft.repetition(F.col("text")).cast("double"), 6).alias("repetition"))


_REASONS = f"""list_concat(list_transform(list_filter([{S.literals(S.BANNED_PHRASES)}], lambda p: contains(low, p)), lambda p: 'phrase: ' || p),
list_filter([CASE WHEN nw > 3 THEN 'formulaic words: ' || nw END, CASE WHEN n < 10 THEN 'too short' END, CASE WHEN n > 20 AND rep > 0.4 THEN 'repetition' END], lambda x: x IS NOT NULL))"""


@query(f"""WITH {MARKED}, m AS (SELECT doc_id, lower(text) AS low, len({S.plain('text')}) AS n, {S.repetition('text')} AS rep,
len(list_filter([{S.literals([w for w in BANNED_WORDS if w not in S.AUTHOR_VALID])}], lambda w: contains(lower(text), w))) AS nw FROM marked)
SELECT doc_id, reasons, len(reasons) = 0 AS passed FROM (SELECT doc_id, {_REASONS} AS reasons FROM m)""")
def q19_filter(spark, sf_dir):
    rows = marked(spark, sf_dir).select("doc_id", rank.rejections(F.col("text")).alias("reasons"))
    return rows.withColumn("passed", F.size("reasons") == 0)


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn after it."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    said = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return asked.join(said, ["conv_id", "turn"])


EXCHANGES = """ex AS (SELECT a.conv_id, a.turn, a.text AS prompt, b.text AS output FROM conversations a JOIN conversations b
ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant')"""


@query(f"WITH {EXCHANGES} SELECT conv_id, turn, round({S.relevance('prompt', 'output')}, 6) AS relevance FROM ex")
def q20_relevance(spark, sf_dir):
    return exchanges(spark, sf_dir).select("conv_id", "turn", F.round(rank.relevance(F.col("prompt"), F.col("output")), 6).alias("relevance"))


def own_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(F.col("doc_id").alias("k"), F.col("source").alias("p"))


_FW = f"k, word, n FROM wc WHERE word IN ({S.literals(S.FUNCTION_WORDS)})"


@query(f"""WITH {BY_DOC}, {S.counts_cte('src').strip()}, pairs AS (SELECT doc_id AS k, source AS p FROM documents),
a AS (SELECT {_FW}), b AS (SELECT source AS k, word, sum(n) AS n FROM a JOIN documents ON doc_id = k GROUP BY ALL),
{S.cosine_cte('c', 'a', 'b', 'word').strip()} SELECT k AS doc_id, p AS source, d AS distance FROM c""")
def q21_function_word_distance(spark, sf_dir):
    counts = ft.word_counts(keyed(docs(spark, sf_dir), "doc_id")).where(F.col("word").isin(sorted(set(S.FUNCTION_WORDS))))
    pairs = own_source(spark, sf_dir)
    profile = counts.join(pairs, "k").groupBy(F.col("p").alias("k"), "word").agg(F.sum("n").alias("n"))
    return distance.cosine_distance(counts, profile, pairs, "word").select(F.col("k").alias("doc_id"), F.col("p").alias("source"), "distance")


_SOURCE_STYLE = f"""WITH {BY_SOURCE}, whole AS (SELECT 'corpus' AS k, doc_id AS row, text FROM documents),
{S.style_cte('src', 'a').strip()}, {S.style_cte('whole', 'b').strip()}, pairs AS (SELECT DISTINCT source AS k, 'corpus' AS p FROM documents)"""


def source_styles(spark: SparkSession, sf_dir: str) -> tuple[distance.Style, distance.Style, DataFrame]:
    rows = docs(spark, sf_dir)
    counts = distance.Counts.of(keyed(rows, "source"))
    pairs = staged(counts.sums.select("k", F.lit("corpus").alias("p")), "pairs")
    whole = counts.merged(F.lit("corpus"))
    whole = distance.Counts(*(staged(t, "style-whole") for t in (whole.sums, whole.words, whole.grams)))
    return distance.Style.of(counts), distance.Style.of(whole), pairs


@query(f"{_SOURCE_STYLE}, {S.cosine_cte('c', 'a_grams', 'b_grams', 'gram').strip()} SELECT k AS source, d AS distance FROM c")
def q22_trigram_distance(spark, sf_dir):
    rows = docs(spark, sf_dir)
    own = staged(ft.trigrams(keyed(rows, "source")), "trigrams")
    every = staged(own.groupBy(F.lit("corpus").alias("k"), "gram").agg(F.sum("n").alias("n")), "trigrams")
    pairs = staged(own.select("k").distinct().withColumn("p", F.lit("corpus")), "pairs")
    return distance.cosine_distance(ft.top_trigrams(own), ft.top_trigrams(every), pairs, "gram").select(F.col("k").alias("source"), "distance")


@query(f"{_SOURCE_STYLE} SELECT x.k AS source, round({S.emd('x.histogram', 'y.histogram')}, 6) AS distance FROM a_dense x, b_dense y")
def q23_sentence_emd(spark, sf_dir):
    sums = ft.sums(keyed(docs(spark, sf_dir), "source"))
    every = sums.groupBy(F.lit("corpus").alias("k")).agg(*[F.sum(c).alias(c) for c in ft.SUMS])
    one = ft.sentence_shape(every).select(F.col("histogram").alias("whole"))  # a single row
    rows = ft.sentence_shape(sums).crossJoin(F.broadcast(one))
    return rows.select(F.col("k").alias("source"), F.round(distance.histogram_emd(F.col("histogram"), F.col("whole")), 6).alias("distance"))


@query(f"{_SOURCE_STYLE}, {S.distance_cte('a', 'b', None).strip()} SELECT k AS source, {', '.join(S.DISTANCE_WEIGHTS)}, slop, base, overall FROM dist")
def q24_distance(spark, sf_dir):
    texts, profiles, pairs = source_styles(spark, sf_dir)
    return distance.distances(texts, profiles, pairs).drop("p").withColumnRenamed("k", "source")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of conversations as candidates, by a prompt: prompt_id, candidate_index, prompt, output."""
    rows = exchanges(spark, sf_dir)
    return rows.select(
        (F.col("conv_id") % 40).alias("prompt_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("candidate_index"), "prompt", "output"
    )


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance of each candidate from the corpus, with its parts; k is the candidate_index."""
    texts = candidates(spark, sf_dir).select(F.col("candidate_index").alias("k"), F.col("output").alias("text"))
    return profiles.against(texts, distance.Style.of(keyed(docs(spark, sf_dir), F.lit("corpus"))))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with distance from the corpus, relevance, repetition, rank score and whether they pass."""
    rows = candidates(spark, sf_dir)
    found = measured(spark, sf_dir)
    out = F.col("output")
    rows = rows.select(
        "prompt_id", F.col("candidate_index").alias("k"),
        F.round(rank.relevance(F.col("prompt"), out), 6).alias("relevance"),
        F.round(ft.repetition(out), 6).alias("repetition"),
        (F.size(rank.rejections(out)) == 0).alias("passed"),
    )
    rows = rows.join(found.select("k", F.col("overall").alias("distance"), "slop"), "k")
    score = rank.rank_score(F.col("distance"), F.col("relevance"), F.col("slop"), F.col("repetition"))
    return rows.withColumn("rank_score", score).withColumnRenamed("k", "candidate_index")


_SCORED = f"""WITH {EXCHANGES}, cand AS (SELECT conv_id % 40 AS prompt_id, conv_id * 1000 + turn AS candidate_index, prompt, output FROM ex),
src AS (SELECT candidate_index AS k, candidate_index AS row, output AS text FROM cand), whole AS (SELECT 'corpus' AS k, doc_id AS row, text FROM documents),
{S.style_cte('src', 'a').strip()}, {S.style_cte('whole', 'b').strip()}, pairs AS (SELECT k, 'corpus' AS p FROM src),
sl AS (SELECT k, {S.slop('text', f'len({S.words("text")})')} AS slop FROM src),
{S.distance_cte('a', 'b', 'sl').strip()},
measured AS (SELECT prompt_id, candidate_index, round({S.relevance('prompt', 'output')}, 6) AS relevance, round(CAST({S.repetition('output')} AS DOUBLE), 6) AS repetition,
  lower(output) AS low, len({S.plain('output')}) AS n, {S.repetition('output')} AS rep,
  len(list_filter([{S.literals([w for w in BANNED_WORDS if w not in S.AUTHOR_VALID])}], lambda w: contains(lower(output), w))) AS nw FROM cand),
scored AS (SELECT m.prompt_id, m.candidate_index, relevance, repetition, len({_REASONS}) = 0 AS passed, d.overall AS distance, d.slop AS slop,
  round(least(greatest(d.overall + 0.25 * (1 - relevance) * (1 - relevance) + 0.10 * d.slop + 0.10 * repetition, 0), 1.5) + 1e-9, 6) AS rank_score
  FROM measured m JOIN dist d ON d.k = m.candidate_index)"""


@query(f"{_SCORED} SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY rank_score, candidate_index) AS rank FROM scored")
def q25_rank(spark, sf_dir):
    return rank.rank(scored(spark, sf_dir))


@query(f"""{_SCORED}, o AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY distance, candidate_index) - 1 AS at, count(*) OVER (PARTITION BY prompt_id) AS n FROM scored),
p AS (SELECT a.prompt_id, a.candidate_index AS chosen, b.candidate_index AS rejected, a.distance AS chosen_distance, b.distance AS rejected_distance, a.relevance AS chosen_relevance,
round(b.distance - a.distance, 6) AS margin FROM o a JOIN o b ON a.prompt_id = b.prompt_id AND a.at = 0 AND b.at = a.n // 2 AND a.n >= 2)
SELECT * FROM p WHERE margin >= 0.03 AND chosen_relevance >= 0.3""")
def q26_pairs(spark, sf_dir):
    return rank.mine_pairs(scored(spark, sf_dir))


@query(f"""{_SCORED} SELECT prompt_id, candidate_index, rank_score, passed, candidates FROM (SELECT *, count(*) OVER (PARTITION BY prompt_id) AS candidates,
row_number() OVER (PARTITION BY prompt_id ORDER BY NOT passed, rank_score, candidate_index) AS r FROM scored) WHERE r = 1""")
def q27_choose(spark, sf_dir):
    return rank.choose(scored(spark, sf_dir))


_TRIM = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
_ENTITIES = f"""ents AS (SELECT term, count(*) AS n FROM (
  SELECT unnest(list_filter(list_concat(r2, r3, r4, s1), lambda t: strlen(t) >= 3)) AS term FROM (SELECT
    {', '.join(f"list_transform(list_filter(range(1, len(w) - {k - 2}), lambda i: {' AND '.join(f'regexp_matches(w[i + {j}], {S.q(chr(94) + chr(92) + 'p{Lu}')})' for j in range(k))}), lambda i: {' || chr(32) || '.join(f'w[i + {j}]' for j in range(k))}) AS r{k}" for k in (2, 3, 4))},
    list_transform(list_filter(range(2, len(w) + 1), lambda i: regexp_matches(w[i], '^\\p{{Lu}}') AND strlen(w[i]) >= 3 AND NOT regexp_matches(raw[i - 1], '[.!?]$') AND lower(w[i]) NOT IN ({S.STOP})), lambda i: w[i]) AS s1
  FROM (SELECT raw, list_transform(raw, lambda x: regexp_replace(x, {S.q(_TRIM)}, '', 'g')) AS w FROM (SELECT {S.plain('text')} AS raw FROM documents)))) GROUP BY term HAVING count(*) >= 3)"""
_FREQUENT = f"""total AS (SELECT sum(len({S.plain('text')})) AS total FROM documents),
bare AS (SELECT {S.bare_word('x')} AS term FROM (SELECT unnest({S.plain('text')}) AS x FROM documents)),
freq AS (SELECT * FROM (SELECT term, n, round(greatest(ln(CAST(n AS DOUBLE) / total * 10000.0), 0), 6) AS score FROM (SELECT term, count(*) AS n FROM bare
  WHERE strlen(term) >= 3 AND term NOT IN ({S.STOP}) AND NOT regexp_matches(term, '^\\p{{N}}+$') GROUP BY term HAVING count(*) >= 3), total) WHERE score > 0.5)"""


@query(f"WITH {_ENTITIES} SELECT * FROM ents")
def q28_lexicon_entities(spark, sf_dir):
    return lexicon.entities(docs(spark, sf_dir))


@query(f"WITH {_FREQUENT} SELECT * FROM freq")
def q29_lexicon_words(spark, sf_dir):
    return lexicon.frequent_words(docs(spark, sf_dir))


@query(f"""WITH {_ENTITIES}, {_FREQUENT}, u AS (SELECT lower(term) AS term, 0 AS kind, -CAST(n AS DOUBLE) AS w FROM ents UNION ALL SELECT lower(term), 1, -score FROM freq),
f AS (SELECT term, kind, w, row_number() OVER (PARTITION BY term ORDER BY kind, w) AS r FROM u)
SELECT * FROM (SELECT row_number() OVER (ORDER BY kind, w, term) AS rank, term FROM f WHERE r = 1) WHERE rank <= 200""")
def q30_lexicon(spark, sf_dir):
    rows = docs(spark, sf_dir)
    return lexicon.merge(lexicon.entities(rows), lexicon.frequent_words(rows))


#: A lexicon as a file would give it: whole words, phrases, and one with a mark in it.
LEXICON = ["the", "erst", "and the", "of a", "thin", "le", "une", "der", "enre", "que", "ein", "zzz", "c++"]
_WHOLE = lambda t, term: f"regexp_matches({t}, '(^|[^\\p{{L}}\\p{{N}}])' || regexp_escape({term}) || '($|[^\\p{{L}}\\p{{N}}])')"


@query(f"""WITH {EXCHANGES}, l AS (SELECT conv_id, turn, lower(output) AS o, list_filter([{S.literals(LEXICON)}], lambda t: NOT {_WHOLE('lower(prompt)', 't')}) AS free FROM ex),
m AS (SELECT *, list_filter(free, lambda t: {_WHOLE('o', 't')}) AS leaked FROM l)
SELECT conv_id, turn, leaked, CAST(len(free) AS BIGINT) AS checkable, round(CASE WHEN len(free) > 0 THEN CAST(len(leaked) AS DOUBLE) / len(free) ELSE 0 END, 6) AS leakage FROM m""")
def q31_leakage(spark, sf_dir):
    rows = lexicon.leakage(exchanges(spark, sf_dir), LEXICON)
    return rows.select("conv_id", "turn", "leaked", F.col("checkable").cast("long").alias("checkable"), "leakage")


FORMATS, MODES = ["chat", "completions", "text"], ["wrapped", "raw"]
CATEGORIES = ["travel", "canon-adjacent", "longform", "shortform", "technology"]


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation records: exchanges, each given to a combo and a category by its conversation, with the measured distance
    from the corpus, its parts, and the leakage of a lexicon; one that the filter rejects has failed."""
    rows = candidates(spark, sf_dir).withColumn("x", F.floor(F.col("candidate_index") / 1000))
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), n.cast("int") + 1)
    x = F.col("x")
    leaked = lexicon.leakage(rows, LEXICON).select(
        "candidate_index", "prompt", F.concat_ws(" + ", pick(FORMATS, x % 3), pick(MODES, F.floor(x / 3) % 2)).alias("combo"),
        evaluate.bucket_of(pick(CATEGORIES, x % 5)).alias("bucket"),
        F.when(F.size(rank.rejections(F.col("output"))) > 0, "failed").otherwise("ok").alias("status"), "leakage",
    )
    return leaked.join(measured(spark, sf_dir).select(F.col("k").alias("candidate_index"), F.col("overall").alias("distance"), "terminal", "structural"), "candidate_index")


_RECORDS = f"""{_SCORED}, lk AS (SELECT candidate_index, prompt, output, lower(output) AS o, conv_id AS x, list_filter([{S.literals(LEXICON)}], lambda t: NOT {_WHOLE('lower(prompt)', 't')}) AS free
  FROM (SELECT conv_id, conv_id * 1000 + turn AS candidate_index, prompt, output FROM ex)),
lm AS (SELECT *, list_filter(free, lambda t: {_WHOLE('o', 't')}) AS leaked, [{S.literals(CATEGORIES)}][1 + x % 5] AS c FROM lk),
rec AS (SELECT lm.candidate_index, prompt, [{S.literals(FORMATS)}][1 + x % 3] || ' + ' || [{S.literals(MODES)}][1 + (x // 3) % 2] AS combo,
  CASE WHEN c IN ('canon-adjacent', 'longform', 'shortform') THEN c ELSE 'off-domain' END AS bucket, CASE WHEN passed THEN 'ok' ELSE 'failed' END AS status,
  round(CASE WHEN len(free) > 0 THEN CAST(len(leaked) AS DOUBLE) / len(free) ELSE 0 END, 6) AS leakage, d.overall AS distance, d.terminal, d.structural
  FROM lm JOIN scored USING (candidate_index) JOIN dist d ON d.k = lm.candidate_index)"""
_AVG = lambda x: S.mean6(x, "FILTER (WHERE status = 'ok')")
_STATS = f"""count(*) FILTER (WHERE status = 'ok') AS count, count(*) FILTER (WHERE status = 'failed') AS failed, {_AVG('distance')} AS mean_distance,
floor(quantile_cont(round(distance * 1000000), 0.5) FILTER (WHERE status = 'ok') + 0.5) / 1000000 AS median_distance, round(var_pop(distance) FILTER (WHERE status = 'ok'), 6) AS variance_distance,
{_AVG('leakage')} AS mean_leakage, max(leakage) FILTER (WHERE status = 'ok') AS worst_leakage, {_AVG('terminal')} AS mean_terminal, {_AVG('structural')} AS mean_structural"""
_BUCKETS = f"""{_RECORDS}, every AS (SELECT *, 'overall' AS b FROM rec UNION ALL SELECT *, bucket AS b FROM rec),
frame AS (SELECT DISTINCT combo, unnest(['overall', {S.literals(evaluate.STANDARD_BUCKETS)}]) AS b FROM rec),
stats AS (SELECT combo, b, {_STATS} FROM every GROUP BY combo, b),
buckets AS (SELECT frame.combo, frame.b AS bucket, coalesce(count, 0) AS count, coalesce(failed, 0) AS failed, mean_distance, median_distance, variance_distance, mean_leakage, worst_leakage, mean_terminal, mean_structural
  FROM frame LEFT JOIN stats ON stats.combo = frame.combo AND stats.b = frame.b)"""


@query(f"""{_RECORDS} SELECT {', '.join(f"{S.mean6(m)} AS mean_{m}" for m in ('distance', 'leakage', 'terminal', 'structural'))},
floor(quantile_cont(round(distance * 1000000), 0.5) + 0.5) / 1000000 AS median_distance, count(DISTINCT prompt) AS prompts, count(*) AS records FROM rec""")
def q32_eval_summary(spark, sf_dir):
    return evaluate.summary(records(spark, sf_dir), ["distance", "leakage", "terminal", "structural"])


@query(f"{_BUCKETS} SELECT * FROM buckets")
def q33_bucket_rollup(spark, sf_dir):
    return evaluate.buckets(records(spark, sf_dir))


_GATES = """g0 AS (SELECT o.*, coalesce(x.mean_leakage, o.mean_leakage) AS off_domain_leakage, o.mean_terminal + o.mean_structural AS voice FROM buckets o
LEFT JOIN buckets x ON x.combo = o.combo AND x.bucket = 'off-domain' AND x.count > 0 WHERE o.bucket = 'overall' AND o.count > 0),
g1 AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY off_domain_leakage, combo) AS r1, count(*) OVER () AS n1 FROM g0) WHERE r1 <= least(n1, greatest(n1 // 2 + 1, 2))),
g2 AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY voice, combo) AS r2, count(*) OVER () AS n2 FROM g1) WHERE r2 <= least(n2, greatest(n2 // 2 + 1, 2)))"""


@query(f"""{_BUCKETS}, {_GATES}
SELECT combo, off_domain_leakage, round(voice, 6) AS voice, mean_distance AS overall_distance FROM g2 ORDER BY mean_distance, combo LIMIT 1""")
def q34_winner(spark, sf_dir):
    return evaluate.winner(evaluate.buckets(records(spark, sf_dir)))


@query(f"""WITH d AS (SELECT source, text, len({S.plain('text')}) AS w, length(text) AS c, list_filter(string_split_regex(text, '[.!?]'), lambda s: regexp_matches(s, {S.q(S.NOT_SPACE)})) AS s FROM documents),
l AS (SELECT source, len({S.plain('x')}) AS n FROM (SELECT source, unnest(s) AS x FROM d)),
sums AS (SELECT source, count(*) AS m, sum(n) AS t, sum(n * n) AS q FROM l GROUP BY source),
v AS (SELECT source, count(DISTINCT w) AS vocabulary FROM (SELECT source, lower(regexp_replace(x, '[^\\p{{L}}]', '', 'g')) AS w FROM (SELECT source, unnest({S.plain('text')}) AS x FROM documents)) WHERE w <> '' GROUP BY source)
SELECT source, count(*) AS files, CAST(sum(w) AS BIGINT) AS words, CAST(sum(c) AS BIGINT) AS chars, round(CAST(any_value(t) AS DOUBLE) / any_value(m), 6) AS sentence_mean,
round(sqrt((any_value(m) * any_value(q) - any_value(t) * any_value(t)) / (CAST(any_value(m) AS DOUBLE) * any_value(m))), 6) AS sentence_sd, any_value(vocabulary) AS vocabulary
FROM d JOIN sums USING (source) JOIN v USING (source) GROUP BY source""")
def q35_profile_info(spark, sf_dir):
    return corpus.profile_info(docs(spark, sf_dir), "source").withColumnRenamed("k", "source")


@query(f"""SELECT doc_id, sha256(text) AS text_sha, CAST(len({S.words('text')}) AS BIGINT) AS words FROM documents WHERE len({S.words('text')}) >= 20""")
def q36_training_rows(spark, sf_dir):
    rows = corpus.training_rows(docs(spark, sf_dir), "chat")
    shape = "struct<messages:array<struct<role:string,content:string>>>"
    content = F.from_json("row", shape)["messages"][1]["content"]
    return rows.select("doc_id", F.sha2(content.cast("binary"), 256).alias("text_sha"), tokens.unicode_word_count(content).cast("long").alias("words"))


@query(f"WITH RECURSIVE {S.chunks_cte('documents', 200, chr(10)).strip()} SELECT doc_id, chunk_index, text FROM chunks")
def q37_chunks(spark, sf_dir):
    return corpus.chunk(docs(spark, sf_dir), 200, paragraph="\n")


@query(f"""{_SOURCE_STYLE} SELECT k AS source, n_words, n_chars, mean, sd, histogram, {', '.join(S.MARKS_SQL)}, flesch_kincaid, coleman_liau, ari, avg_syllables, ttr, yule_k, hapax, dis, simpson FROM a_dense""")
def q38_fingerprint(spark, sf_dir):
    return distance.Style.of(keyed(docs(spark, sf_dir), "source")).dense.withColumnRenamed("k", "source").drop("tokens", "types")


@query(f"""WITH {BY_DOC}, {S.sentences_cte('src').strip()}, v AS (SELECT source AS k, len({S.words('sentence')}) AS n FROM sents JOIN documents ON doc_id = k),
o AS (SELECT k, list_sort(list(n)) AS l, avg(n) AS mean, sum(n) AS s, sum(n * n) AS q, count(*) AS c FROM v WHERE n > 0 GROUP BY k)
SELECT k AS source, round(CAST(s AS DOUBLE) / c, 6) AS mean, round(sqrt((c * q - s * s) / (CAST(c AS DOUBLE) * c)), 6) AS sd, CAST(l[c // 2 + 1] AS BIGINT) AS median, CAST(l[least(c * 95 // 100, c - 1) + 1] AS BIGINT) AS p95 FROM o""")
def q39_sentence_lengths(spark, sf_dir):
    rows = docs(spark, sf_dir).select(F.col("source").alias("k"), F.explode(sentences(F.col("text"))).alias("s"))
    values = rows.select("k", tokens.unicode_word_count(F.col("s")).cast("long").alias("n")).where("n > 0")
    return ft.length_stats(values).withColumnRenamed("k", "source")


@query(f"""{_SCORED}, o AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY distance, candidate_index) - 1 AS at, count(*) OVER (PARTITION BY prompt_id) AS n FROM scored),
p AS (SELECT a.relevance AS rel, round(b.distance - a.distance, 6) AS margin FROM o a JOIN o b ON a.prompt_id = b.prompt_id AND a.at = 0 AND b.at = a.n // 2 AND a.n >= 2)
SELECT count(*) AS pairs, round(avg(margin), 6) AS avg_margin, min(margin) AS min_margin, max(margin) AS max_margin FROM p WHERE margin >= 0.03 AND rel >= 0.3""")
def q40_pair_stats(spark, sf_dir):
    return rank.pair_stats(rank.mine_pairs(scored(spark, sf_dir)))



@query(f"""WITH {BY_SOURCE}, {S.counts_cte('src').strip()}, used AS (SELECT k, list_filter([{S.BANNED}], lambda b: NOT list_contains(list(word), b)) AS banned FROM wc GROUP BY k)
SELECT k AS source, unnest(list_sort(list_distinct(list_concat(banned, [{S.literals([w for w in BANNED_WORDS if w not in S.AUTHOR_VALID])}])))) AS word, CAST(-4.0 AS DOUBLE) AS bias FROM used""")
def q41_logit_bias(spark, sf_dir):
    rows = keyed(docs(spark, sf_dir), "source")
    sums = rows.groupBy("k").agg(
        F.sum(tokens.unicode_word_count(F.col("text"))).alias("n_words"), *[F.sum(c).alias(m) for m, c in ft.punctuation_counts(F.col("text")).items()]
    )
    bias = rank.logit_bias(ft.vocabulary(ft.word_counts(rows)), ft.punctuation(sums).select("k", "em_dash"))
    return bias.select(F.col("k").alias("source"), F.explode("bias").alias("word", "bias")).withColumn("bias", F.col("bias").cast("double"))


@query(f"""WITH {BY_DOC}, {S.sentences_cte('src').strip()}, d AS (SELECT doc_id, source AS k, {S.words('text')} AS w, {S.paragraphs("replace(text, chr(10), chr(10) || chr(10))")} AS p FROM documents),
l AS (SELECT k, list_transform(w, lambda x: length(x)) AS w, list_transform(p, lambda x: len({S.words('x')})) AS p, [] AS s FROM d
UNION ALL SELECT source, [], [], [len({S.words('sentence')})] FROM sents JOIN documents ON doc_id = k)
{S.length_table({'word': 'w', 'paragraph': 'p', 'sentence': 's'}, 'l')}""")
def q42_length_table(spark, sf_dir):
    # sentences are the same with single and double line feeds
    text = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return ft.length_table(docs(spark, sf_dir).select(F.col("source").alias("k"), text.alias("text")))


@query(f"""{_SOURCE_STYLE}, lens AS ({S.length_table({'word': f"list_transform({S.words('text')}, lambda x: length(x))"}, 'src')}),
fw AS (SELECT k, sha256(string_agg(word || ' ' || n, ',' ORDER BY word)) AS words_sha, count(*) AS n_function_words FROM a_words GROUP BY k),
ng AS (SELECT k, sha256(string_agg(gram || ' ' || n, ',' ORDER BY n DESC, gram)) AS grams_sha, count(*) AS n_grams FROM a_grams GROUP BY k),
voc AS (SELECT k, count(*) AS vocabulary_size, list_sort(list_filter([{S.BANNED}], lambda b: NOT list_contains(list(word), b))) AS banned FROM a_wc GROUP BY k)
SELECT k AS source, n_words, round(lens.mean, 6) AS word_mean, lens.sd AS word_sd, lens.median AS word_median, lens.p95 AS word_p95, a_dense.mean AS sentence_mean, em_dash, flesch_kincaid, yule_k,
n_function_words, grams_sha, n_grams, vocabulary_size, banned FROM a_dense JOIN lens USING (k) JOIN fw USING (k) JOIN ng USING (k) JOIN voc USING (k)""")
def q43_fingerprint_record(spark, sf_dir):
    return record_digest(distance.fingerprint(keyed(docs(spark, sf_dir), "source")))


def record_digest(rows: DataFrame) -> DataFrame:
    """What a table can show of whole profiles."""
    grams = F.array_join(F.transform("ngram_profile", lambda g: F.concat(g["gram"], F.lit(" "), g["n"].cast("string"))), ",")
    word = F.col("word_length")
    return rows.select(
        F.col("k").alias("source"), "n_words", *[word[x].alias(f"word_{x}") for x in ("mean", "sd", "median", "p95")], F.col("mean").alias("sentence_mean"), "em_dash",
        "flesch_kincaid", "yule_k", F.size("function_words").cast("long").alias("n_function_words"), F.sha2(grams.cast("binary"), 256).alias("grams_sha"),
        F.size("ngram_profile").cast("long").alias("n_grams"), "vocabulary_size", "banned",
    )


@query(f"""WITH RECURSIVE firsts AS (SELECT doc_id, lang, text, min(doc_id) OVER (PARTITION BY text) AS first FROM documents),
kept AS (SELECT doc_id, lang, text FROM firsts WHERE doc_id = first), {S.chunks_cte('kept', 200, chr(10)).strip()},
cut AS (SELECT lang, count(*) AS chunks, sum(len({S.words('c.text')})) AS words FROM chunks c JOIN kept USING (doc_id) GROUP BY lang),
per AS (SELECT lang AS context, count(*) FILTER (WHERE doc_id = first) AS samples, count(*) FILTER (WHERE doc_id <> first) AS skipped, any_value(coalesce(chunks, 0)) AS chunks, any_value(coalesce(words, 0)) AS words
FROM firsts LEFT JOIN cut USING (lang) GROUP BY lang)
SELECT context, samples, skipped, CAST(chunks AS BIGINT) AS chunks, CAST(words AS BIGINT) AS words FROM per
UNION ALL SELECT NULL, CAST(sum(samples) AS BIGINT), CAST(sum(skipped) AS BIGINT), CAST(sum(chunks) AS BIGINT), CAST(sum(words) AS BIGINT) FROM per""")
def q44_ingest(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "text", F.col("lang").alias("context_tag"))
    return corpus.ingest(rows, max_words=200, cleaned=False, paragraph="\n")[1]


@query(f"""{_SCORED}, t AS (SELECT *, candidate_index % 3 + 1 AS attempt FROM scored), l AS (SELECT *, max(attempt) OVER (PARTITION BY prompt_id) AS last FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY NOT passed, CASE WHEN passed THEN attempt ELSE 0 END, rank_score, candidate_index) AS k FROM l WHERE passed OR attempt = last)
SELECT prompt_id, attempt, candidate_index, rank_score, passed FROM r WHERE k = 1""")
def q45_decode(spark, sf_dir):
    return rank.decode(scored(spark, sf_dir).withColumn("attempt", F.col("candidate_index") % 3 + 1))


@query(f"""WITH h AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) <= (SELECT greatest(ceil(count(*) * 0.1), 1) FROM documents) AS held FROM documents),
src AS (SELECT doc_id AS k, doc_id AS row, text FROM h WHERE held), whole AS (SELECT 'train' AS k, doc_id AS row, text FROM h WHERE NOT held),
{S.style_cte('src', 'a').strip()}, {S.style_cte('whole', 'b').strip()}, pairs AS (SELECT k, 'train' AS p FROM src),
sl AS (SELECT k, {S.slop('text', f'len({S.words("text")})')} AS slop FROM src), {S.distance_cte('a', 'b', 'sl').strip()},
m AS (SELECT {S.mean6('overall')} AS voice, count(*) AS samples FROM dist),
n AS (SELECT {S.mean6(f"round(CAST({S.slop_presence('text')} AS DOUBLE), 6)")} AS slop FROM src)
SELECT voice, samples, slop, CAST(72.0 AS DOUBLE) AS creative, round(CAST(least(greatest(0.5 * (1 - voice) + 0.3 * (1 - slop / 100) + 0.2 * 72.0 / 100, 0), 1) AS DOUBLE), 6) AS combined FROM m, n""")
def q46_bench(spark, sf_dir):
    return evaluate.bench(docs(spark, sf_dir).select("doc_id", "text"))


@query(f"""SELECT item_id, seed, format, mode, format || ' + ' || mode AS combo FROM benchmark, (SELECT unnest([1, 2, 3]) AS seed), (SELECT unnest([{S.literals(FORMATS)}]) AS format), (SELECT unnest([{S.literals(MODES)}]) AS mode)""")
def q47_grid(spark, sf_dir):
    return evaluate.grid(table(spark, sf_dir, "benchmark").select("item_id"), [1, 2, 3], FORMATS, MODES)


@query(f"""{_BUCKETS}, {_GATES}, gated AS (SELECT o.combo, o.count AS ok, g0.off_domain_leakage, coalesce(g0.voice, o.mean_terminal + o.mean_structural) AS voice, o.mean_distance AS overall_distance, g1.combo IS NOT NULL AS p1, g2.combo IS NOT NULL AS p2,
  g2.combo IS NOT NULL AND o.combo = (SELECT combo FROM g2 ORDER BY mean_distance, combo LIMIT 1) AS p3 FROM buckets o LEFT JOIN g0 USING (combo) LEFT JOIN g1 USING (combo) LEFT JOIN g2 USING (combo) WHERE o.bucket = 'overall')
SELECT combo, off_domain_leakage, round(voice, 6) AS voice, overall_distance, CASE WHEN ok = 0 THEN 0 WHEN NOT p1 THEN 1 WHEN NOT p2 THEN 2 WHEN NOT p3 THEN 3 END AS gate,
list_filter([CASE WHEN ok = 0 THEN 'no successful generation' END, CASE WHEN ok > 0 THEN printf('G1 leak=%.4f %s', off_domain_leakage, CASE WHEN p1 THEN 'PASS' ELSE 'ELIMINATED' END) END,
CASE WHEN p1 THEN printf('G2 voice_dist=%.4f %s', voice, CASE WHEN p2 THEN 'PASS' ELSE 'ELIMINATED' END) END, CASE WHEN p3 THEN printf('WINNER dist=%.3f leak=%.4f', overall_distance, off_domain_leakage) END], lambda x: x IS NOT NULL) AS reasons FROM gated""")
def q48_gates(spark, sf_dir):
    return evaluate.gates(evaluate.buckets(records(spark, sf_dir)))


@query("""SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents
WHERE text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id) WHERE quality = 0) GROUP BY 1""")
def q49_dedupe_against_known(spark, sf_dir):
    rows = docs(spark, sf_dir)
    known = corpus.content_hash(rows.join(table(spark, sf_dir, "labels").where("quality = 0"), "doc_id")).select("content_hash")
    return corpus.dedupe(rows, known)


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) <= (SELECT least(greatest(ceil(count(*) * 0.1), 1), count(*) // 2) FROM documents) AS held_out FROM documents")
def q50_train_valid_split(spark, sf_dir):
    return corpus.holdout_split(docs(spark, sf_dir).select("doc_id"), 0.1, at_most_half=True)


@query(f"""WITH {MARKED}, v AS (SELECT doc_id, round(CAST({S.slop('text', f'len({S.words("text")})')} AS DOUBLE), 6) AS voice, round(CAST({S.slop_presence('text')} AS DOUBLE), 6) AS slop FROM marked)
SELECT doc_id, round(CAST(least(greatest(0.5 * (1 - voice) + 0.3 * (1 - slop / 100) + 0.2 * 72.0 / 100, 0), 1) AS DOUBLE), 6) AS combined FROM v""")
def q51_combined(spark, sf_dir):
    t = F.col("text")
    rows = marked(spark, sf_dir).select("doc_id", F.round(distance.slop(t).cast("double"), 6).alias("v"), F.round(distance.slop_presence(t).cast("double"), 6).alias("s"))
    return rows.select("doc_id", F.round(evaluate.combined(F.col("v"), F.col("s"), F.lit(72.0)), 6).alias("combined"))


@query(f"SELECT doc_id, {S.paragraphs('text', chr(10))} AS paragraphs FROM documents")
def q52_paragraphs(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tokens.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("paragraphs"))


#: Marks that the tables lack, put before (notes) and behind (pages) each document in turn.
SNIPPETS = [
    " <svg><path d='M0'/></svg> tail", " before <svg open never closed", "\n::: note\nbody\n  :::\r\nnext\r\nlast", " see []{#anchor} and {=html} raw {=latex} end here",
    " ![alt text](img.png) and ![broken", " it\\'s \\\"quoted\\\" a\\-b end\\. \\*bold\\*", "\n-- \nJohn\nphone 12", "\n--\nshort", " zero​width﻿mark‏",
    "  spaced \t out  \n\n\n\nmore   \n", " “smart” and ‘single’ with \"straight\" 'ones' and \"more\" 'still'", " <b>bold</b> a < b and c > d", " http://x.org/?utm_source=a&id=5&ref=b end",
]
NOTE_MARKS = [
    "---\ntitle: x\ntags: [daily]\n---\n\n", "---\ntags: note\n---\n", "", "no front --- here\n", "---\nunclosed: yes\n", "<!-- hidden -->shown ", "[[page]] and [[page|shown]] [[a b|c d]] ",
    "```dataview\nLIST\n```\nafter ", "intro line\n# First\nbody one\n## sub\n# Second\n", "﻿", "one\r\ntwo\rthree\n", "before <!-- open\n",
]


def with_marks(spark, sf_dir):
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % len(values) + 1).cast("int"))
    return docs(spark, sf_dir).select("doc_id", F.concat(F.coalesce("text", F.lit("")), pick(SNIPPETS)).alias("page"), F.concat(pick(NOTE_MARKS), F.coalesce("text", F.lit(""))).alias("note"))


_PICK = lambda values: f"[{', '.join(S.q(v) for v in values)}][1 + doc_id % {len(values)}]"
_WITH_MARKS = f"with_marks AS (SELECT doc_id, coalesce(text, '') || {_PICK(SNIPPETS)} AS page, {_PICK(NOTE_MARKS)} || coalesce(text, '') AS note FROM documents)"


def _step(name: str, column: str, sql_text: str) -> None:
    def run(spark, sf_dir):
        return with_marks(spark, sf_dir).select("doc_id", getattr(clean, name)(F.col(column)).alias("text"))

    _QUERIES[f"clean_{name}"] = run
    _SQL[f"clean_{name}"] = f"WITH {_WITH_MARKS} SELECT doc_id, {sql_text} AS text FROM (SELECT doc_id, {column} AS t FROM with_marks)"


for _name, _text in S.CLEAN.items():
    _step(_name, "page", _text)
for _name, _text in S.NOTES.items():
    _step(_name, "note", _text)


@query(f"WITH {_WITH_MARKS} SELECT doc_id, regexp_matches(lower(regexp_extract(note, '(?s)\\A---(.*?)---', 1)), 'daily|journal') AS daily FROM with_marks")
def clean_is_daily_note(spark, sf_dir):
    return with_marks(spark, sf_dir).select("doc_id", clean.is_daily_note(F.col("note")).alias("daily"))


@query(f"""WITH {_WITH_MARKS}, p AS (SELECT doc_id, string_split(chr(10) || {S.replace_all('note', (r'\r\n?', chr(10)))}, chr(10) || '# ') AS parts FROM with_marks),
s AS (SELECT doc_id, i, parts[i] AS part FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM p)),
h AS (SELECT doc_id, CASE WHEN i > 1 THEN {S.replace_all("regexp_extract(part, '^([^' || chr(10) || ']*)', 1)", (S._ENDS, ''))} END AS header,
  {S.replace_all("CASE WHEN i > 1 THEN regexp_replace(part, '^[^' || chr(10) || ']*' || chr(10) || '?', '') ELSE part END", (S._ENDS, ''))} AS body FROM s)
SELECT doc_id, header, body FROM h WHERE body <> ''""")
def clean_split_by_h1(spark, sf_dir):
    rows = with_marks(spark, sf_dir).select("doc_id", F.explode(clean.split_by_h1(F.col("note"))).alias("s"))
    return rows.select("doc_id", "s.header", "s.body")


#: Names and lines as trainers and model stores give them.
MODELS = ["gemma-4-{N}b", "tuned-{L}-{N}b-v2", "gemma-4-26b", "gemma-3-4b", "gemma-4-26b-a4b", "qwen3.5-9b", "llama3.2-3b", "gemma4:26b", "single", "odd-name-v2", "26b-x"]
TAGS = ["gemma3:{N}b-{L}:latest", "gemma3:26b-a4b", "llama3.2:3b", "qwen3.5:9b:latest", "phi:3b", "own/name", "gemma3:latest"]
LINES = [
    "Iter {N}: Train loss 2.345, Learning Rate 0.0001, It/sec 5.5, {L}", "Iter 7: Train loss 1.5, Learning Rate x, It/sec 2", "Iter x: Train loss 1.0, Learning Rate 1, It/sec 1",
    "Iter 9: Val loss 2.0", "Loading model", "Iter 3: Train loss nope, Learning Rate 1, It/sec 1",
]


def picked(spark: SparkSession, sf_dir: str, values: list[str]) -> DataFrame:
    """doc_id, t: each document with one of the values in turn, its number in place of N and its language in place of L."""
    value = F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % len(values) + 1).cast("int"))
    return docs(spark, sf_dir).select("doc_id", F.replace(F.replace(value, F.lit("{N}"), F.col("doc_id").cast("string")), F.lit("{L}"), F.col("lang")).alias("t"))


_PICKED = lambda values: f"picked AS (SELECT doc_id, replace(replace([{S.literals(values)}][1 + doc_id % {len(values)}], '{{N}}', CAST(doc_id AS VARCHAR)), '{{L}}', lang) AS t FROM documents)"


@query(f"""WITH {_PICKED(MODELS)} SELECT doc_id, t, CASE WHEN contains(t, ':') OR NOT contains(t, '-') THEN t WHEN regexp_matches(t, '(^|-)[0-9]+b(-|$)')
THEN replace(regexp_extract(t, '^(?:(.*?)-)?([0-9]+b(?:-.*)?)$', 1), '-', '') || ':' || regexp_extract(t, '^(?:(.*?)-)?([0-9]+b(?:-.*)?)$', 2)
ELSE replace(regexp_extract(t, '^(.*)-[^-]*$', 1), '-', '') || ':' || regexp_extract(t, '-([^-]*)$', 1) END AS tag FROM picked""")
def q53_model_tags(spark, sf_dir):
    return picked(spark, sf_dir, MODELS).select("doc_id", "t", prompts.model_tag(F.col("t")).alias("tag"))


@query(f"""WITH {_PICKED(TAGS)} SELECT doc_id, t, CASE WHEN contains(x, '/') THEN x ELSE CASE WHEN starts_with(x, 'gemma') THEN 'google/' WHEN starts_with(x, 'llama') THEN 'meta/' WHEN starts_with(x, 'qwen') THEN 'qwen/' ELSE 'local/' END || replace(x, ':', '-') END AS id
FROM (SELECT doc_id, t, regexp_replace(t, ':latest$', '') AS x FROM picked)""")
def q54_model_ids(spark, sf_dir):
    return picked(spark, sf_dir, TAGS).select("doc_id", "t", prompts.model_id(F.col("t")).alias("id"))


@query(f"""WITH {_PICKED(LINES)} SELECT doc_id, t, TRY_CAST(regexp_extract(t, '^Iter ([^:]*)', 1) AS INT) AS step, TRY_CAST(regexp_extract(t, 'Train loss ([^,]*)', 1) AS DOUBLE) AS loss, coalesce(TRY_CAST(regexp_extract(t, 'Learning Rate ([^,]*)', 1) AS DOUBLE), 0) AS learning_rate,
coalesce(TRY_CAST(regexp_extract(t, 'It/sec ([^,]*)', 1) AS DOUBLE), 0) AS steps_per_second FROM picked WHERE regexp_matches(t, '^Iter [0-9]+:.*Train loss [0-9.]+, Learning Rate .*It/sec ')""")
def q55_progress_lines(spark, sf_dir):
    return picked(spark, sf_dir, LINES).withColumn("p", prompts.progress(F.col("t"))).where("p is not null").select("doc_id", "t", "p.*")


@query(f"""{_SOURCE_STYLE}, t AS (SELECT k, sum(n) AS total FROM a_wc GROUP BY k), v AS (SELECT k, coalesce(list_sort(list(word) FILTER (WHERE n > 3 AND strlen(word) > 4 AND CAST(n AS DOUBLE) / total > 0.001)), []) AS preferred FROM a_wc JOIN t USING (k) GROUP BY k)
SELECT k AS source, array_to_string(list_filter([{S.q(prompts.RHYTHM)}, printf({S.q(prompts.FRAGMENTS)}, round(greatest(mean - sd, 1.0))), {S.q(prompts.DICTION)}, CASE WHEN em_dash > 2 THEN {S.q(prompts.DASHES)} END, {S.q(prompts.ASIDES)},
CASE WHEN len(preferred) > 0 THEN printf({S.q(prompts.PREFERRED)}, array_to_string(preferred[1:8], ', ')) END, {S.q(prompts.AVOIDED)}, {S.q(prompts.NAMES)}, {S.q(prompts.ON_TOPIC)}], lambda x: x IS NOT NULL), chr(10)) AS prompt FROM a_dense JOIN v USING (k)""")
def q56_system_prompts(spark, sf_dir):
    rows = distance.fingerprint(keyed(docs(spark, sf_dir), "source"))
    return rows.select(F.col("k").alias("source"), prompts.system_prompt(F.col("mean"), F.col("sd"), F.col("em_dash"), F.col("preferred")).alias("prompt"))


@query(f"SELECT doc_id, printf({S.q(prompts.REWRITE)}, text) AS prompt FROM documents")
def q57_rewrite_prompts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", prompts.rewrite_prompt(F.col("text")).alias("prompt"))


@query("SELECT doc_id, text AS content, source, lang AS context_tag, sha256(text) AS content_hash FROM documents")
def q58_samples_file(spark, sf_dir):
    rows = corpus.content_hash(docs(spark, sf_dir))
    none = F.lit(None).cast("string")
    meta = F.struct(F.col("source"), F.concat(F.lit("/d/"), F.col("doc_id").cast("string")).alias("origin_path"), F.col("lang").alias("context_tag"), none.alias("captured_at"))
    path = fresh(spark, "samples")
    sinks.write_samples(rows.select(F.col("text").alias("content"), meta.alias("metadata"), "content_hash"), path)
    read = readers.read_jsonl(spark, path)
    number = F.substring_index("metadata.origin_path", "/", -1).cast("long")
    return read.select(number.alias("doc_id"), "content", "metadata.source", "metadata.context_tag", "content_hash")


@query(_SQL["q30_lexicon"].replace("SELECT * FROM (SELECT row_number() OVER (ORDER BY kind, w, term) AS rank, term", "SELECT DISTINCT term FROM (SELECT row_number() OVER (ORDER BY kind, w, term) AS rank, term"))
def q59_lexicon_file(spark, sf_dir):
    path = fresh(spark, "lexicon")
    sinks.write_lexicon(q30_lexicon(spark, sf_dir), path, title="terms")
    return readers.read_lexicon(spark, path)


#: Numbers of six digits written with fewer, half up, by whole numbers.
_FIXED = lambda x, n: f"printf('%.{n}f', ((CAST(round({x} * 1000000) AS BIGINT) + {5 * 10 ** (5 - n)}) // {10 ** (6 - n)}) / {10.0 ** n}) AS {x}"


@query(f"{_SCORED} SELECT prompt_id, candidate_index, {_FIXED('distance', 4)}, {_FIXED('relevance', 4)}, {_FIXED('rank_score', 2)} FROM scored")
def q60_records_file(spark, sf_dir):
    path = fresh(spark, "records")
    rows = scored(spark, sf_dir).select("prompt_id", "candidate_index", "distance", "relevance", "rank_score")
    sinks.write_records_csv(rows, path, four=["distance", "relevance"], two=["rank_score"])
    read = spark.read.option("header", True).csv(path)
    return read.withColumn("prompt_id", F.col("prompt_id").cast("long")).withColumn("candidate_index", F.col("candidate_index").cast("long"))


@query(_SQL["q26_pairs"])
def q61_pairs_file(spark, sf_dir):
    path = fresh(spark, "pairs")
    pairs = q26_pairs(spark, sf_dir)
    sinks.write_pairs(pairs, path)
    return spark.read.schema(pairs.schema).json(path)


@query(f"""WITH t AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) <= (SELECT least(greatest(ceil(count(*) * 0.1), 1), count(*) // 2) FROM documents) AS held FROM documents),
k AS (SELECT sha256(text) AS text_sha, held FROM t WHERE len({S.words('text')}) >= 20)
SELECT part, text_sha FROM (SELECT 'train' AS part, text_sha FROM k WHERE NOT held UNION ALL SELECT 'valid', text_sha FROM k WHERE held UNION ALL SELECT 'test', text_sha FROM k WHERE held)""")
def q62_training_files(spark, sf_dir):
    path = fresh(spark, "training")
    sinks.write_training(docs(spark, sf_dir).select("doc_id", "text"), path, style="completions")
    parts = [spark.read.text(f"{path}/{p}").select(F.lit(p).alias("part"), F.get_json_object("value", "$.completion").alias("t")) for p in ("train", "valid", "test")]
    return parts[0].union(parts[1]).union(parts[2]).select("part", F.sha2(F.col("t").cast("binary"), 256).alias("text_sha"))


@query(_SQL["q43_fingerprint_record"])
def q63_fingerprint_file(spark, sf_dir):
    path = fresh(spark, "fingerprint")
    style = distance.fingerprint(keyed(docs(spark, sf_dir), "source"))
    sinks.write_fingerprint(style, path)
    return record_digest(readers.read_fingerprints(spark, path, style.schema))


@query(f"""WITH RECURSIVE par AS MATERIALIZED (SELECT doc_id, CAST(i AS BIGINT) AS i, parts[i] AS part, CAST(len({S.plain('parts[i]')}) AS BIGINT) AS n FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, {S.paragraphs('text', chr(10))} AS parts FROM documents))),
walk AS (SELECT doc_id, i, CAST(0 AS BIGINT) AS pack, n AS size FROM par WHERE i = 1 UNION ALL SELECT p.doc_id, p.i, CASE WHEN size + n > 100 THEN pack + 1 ELSE pack END, CASE WHEN size + n > 100 THEN n ELSE size + n END FROM walk w JOIN par p ON p.doc_id = w.doc_id AND p.i = w.i + 1),
packs AS (SELECT doc_id, pack, string_agg(part, chr(10) || chr(10) ORDER BY i) AS content, sum(n) AS words, max(pack) OVER (PARTITION BY doc_id) AS last FROM walk JOIN par USING (doc_id, i) GROUP BY doc_id, pack)
SELECT doc_id, pack AS position, content FROM packs WHERE words >= 5 OR pack < last""")
def q64_paragraph_packs(spark, sf_dir):
    parts = tokens.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")))
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(readers.pack_paragraphs(parts, 100)).alias("position", "content"))
    return rows.withColumn("position", F.col("position").cast("long"))


ENDINGS = [".md", ".MARKDOWN", ".txt", ".text", ".pdf", "", ".md.bak"]


@query(f"""WITH p AS (SELECT page_id, url || [{S.literals(ENDINGS)}][1 + page_id % 7] AS path, page_id % 5 = 0 AS vault FROM pages)
SELECT page_id, path, vault, CASE WHEN vault THEN 'obsidian' WHEN regexp_matches(lower(path), '\\.(md|markdown)$') THEN 'markdown' WHEN regexp_matches(lower(path), '\\.(txt|text)$') THEN 'plain_text' END AS source FROM p""")
def q65_source_registry(spark, sf_dir):
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("page_id") % 7 + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat("url", ending).alias("path"), (F.col("page_id") % 5 == 0).alias("vault"))
    return rows.withColumn("source", readers.source_of(F.col("path"), F.col("vault")))


@query(f"""WITH {BY_DOC}, whole AS (SELECT source AS k, doc_id AS row, text FROM documents), {S.style_cte('src', 'a').strip()}, {S.style_cte('whole', 'b').strip()},
pairs AS (SELECT doc_id AS k, p FROM documents, (SELECT DISTINCT source AS p FROM documents)), {S.distance_cte('a', 'b', None).strip()}
SELECT k AS doc_id, CAST(rank AS INTEGER) AS rank, p AS source, overall AS distance FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY overall, p) AS rank FROM dist) WHERE rank <= 3""")
def q66_nearest_sources(spark, sf_dir):
    rows = docs(spark, sf_dir)
    found = profiles.nearest(keyed(rows, "doc_id"), distance.Style.of(keyed(rows, "source")), top=3)
    return found.withColumnRenamed("k", "doc_id").withColumnRenamed("p", "source")


_WRITTEN = """tries AS (SELECT conv_id * 1000 + turn AS prompt_id, coalesce(text, '') AS prompt, unnest(range(9)) AS seed FROM conversations WHERE role = 'user'),
drawn AS (SELECT *, CAST('0x' || substr(sha256(seed || ':' || prompt), 1, 12) AS BIGINT) AS number, PLAIN AS w FROM tries),
cand AS (SELECT prompt_id, prompt_id * 9 + seed AS candidate_index, prompt, coalesce(array_to_string(list_slice(list_concat(list_slice(w, number % len(w) + 1, len(w)), list_slice(w, 1, number % len(w))), 1, 4 + number // len(w) % 10), ' '), '') AS output FROM drawn)"""
_DECODED = _SCORED.replace(_SCORED[_SCORED.index("cand AS (") : _SCORED.index("src AS (")], _WRITTEN.replace("PLAIN", S.plain("prompt")) + ",\n")


@query(f"""{_DECODED}, t AS (SELECT *, candidate_index % 9 // 3 AS attempt FROM scored), f AS (SELECT prompt_id, coalesce(min(attempt) FILTER (WHERE passed), 2) AS a FROM t GROUP BY prompt_id),
r AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY a < 2 AND NOT passed, rank_score, candidate_index) AS k FROM t JOIN f USING (prompt_id) WHERE attempt = a)
SELECT prompt_id, CAST(candidate_index % 3 AS INTEGER) AS candidate_index, CAST(a AS INTEGER) AS regenerations, rank_score, passed, output FROM r JOIN cand USING (prompt_id, candidate_index) WHERE k = 1""")
def q67_regenerate(spark, sf_dir):
    prompts = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("prompt_id"), F.col("text").alias("prompt"))
    profile = distance.Style.of(keyed(docs(spark, sf_dir), F.lit("corpus")))
    return decode.decode(prompts, backends.Sampler(), profile, candidates=3, max_attempts=3).drop("candidates")


def written_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of a folder, two kinds with a reader and one without, some hidden and some that are no
    UTF-8; and what a walk through the folder gives, with doc_id."""
    n = F.col("doc_id")
    ending = F.element_at(F.array(F.lit(".md"), F.lit(".txt"), F.lit(".pdf")), (n % 3 + 1).cast("int"))
    name = F.concat(F.col("lang"), F.when(n % 13 == 5, "/.hidden/").otherwise("/"), n.cast("string"), ending)
    data = F.concat(F.when(n % 11 == 3, F.unhex(F.lit("C328"))).otherwise(F.lit(b"")), F.col("text").cast("binary"))
    folder = fresh(spark, "files")
    sinks.write_files(docs(spark, sf_dir).select(name.alias("name"), data.alias("data")), folder)
    return walk.files(spark, folder)


_FILES = "files AS (SELECT doc_id, lang, text, CASE doc_id % 3 WHEN 0 THEN 'markdown' ELSE 'plain_text' END AS kind, doc_id % 11 = 3 AS broken FROM documents WHERE doc_id % 3 < 2 AND doc_id % 13 <> 5)"
_NUMBER = lambda path: F.regexp_extract(path, r"/(\d+)\.\w+$", 1).cast("long")


@query(f"WITH {_FILES} SELECT doc_id, kind, 'not UTF-8 at byte 0' AS reason FROM files WHERE broken")
def q68_broken_files(spark, sf_dir):
    return walk.failures(written_files(spark, sf_dir)).select(_NUMBER("origin_path").alias("doc_id"), "kind", "reason")


@query(f"""WITH {_FILES}, s AS (SELECT doc_id, kind, {S.replace_all('text', (S._ENDS, ''))} AS content FROM files WHERE NOT broken)
SELECT doc_id, kind AS source, CASE kind WHEN 'markdown' THEN 'longform' END AS context_tag, sha256(content) AS content_sha FROM s WHERE len({S.plain('content')}) >= 5""")
def q69_walked_samples(spark, sf_dir):
    rows = walk.samples(written_files(spark, sf_dir))
    return rows.select(_NUMBER("origin_path").alias("doc_id"), "source", "context_tag", F.sha2(F.col("content").cast("binary"), 256).alias("content_sha"))


@query(f"""WITH first AS (SELECT min(source) AS k, t AS text FROM ({S.clean_steps('text', '(SELECT source, text FROM documents WHERE text IS NOT NULL)', 'source')}) GROUP BY t),
src AS (SELECT k, text FROM first), {S.counts_cte('src').strip()} SELECT k AS source, word, n FROM wc""")
def q70_learned_words(spark, sf_dir):
    inbox, store = fresh(spark, "inbox"), fresh(spark, "store")
    docs(spark, sf_dir).select(F.col("source").alias("author"), "text").write.json(inbox)
    learn.learn(spark, inbox, store, files_a_batch=1 << 20).awaitTermination()
    return learn.word_counts(spark, store).withColumnRenamed("k", "source")


_TRIGRAMS = lambda source, key: f"(SELECT {key}s[i] || s[i + 1] || s[i + 2] AS gram FROM (SELECT {key}s, unnest(range(1, len(s) - 1)) AS i FROM (SELECT {key}string_split(lower(text), '') AS s FROM {source})))"


@query(f"""WITH pairs AS ({_SQL["q26_pairs"]}), texts AS (SELECT b.conv_id * 1000 + a.turn AS k, b.text FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant'),
grams AS (SELECT gram, count(*) AS n FROM {_TRIGRAMS('documents', '')} GROUP BY gram), heads AS (SELECT substr(gram, 1, 2) AS head, sum(n) AS m FROM grams GROUP BY 1),
size AS (SELECT count(DISTINCT substr(gram, 3, 1)) AS v FROM grams), own AS (SELECT k, gram, count(*) AS times FROM {_TRIGRAMS('texts', 'k, ')} GROUP BY k, gram),
scores AS (SELECT k, round(sum(times * ln((coalesce(n, 0) + 1) / CAST(coalesce(m, 0) + v AS DOUBLE))) / sum(times), 6) AS mean_logp FROM own LEFT JOIN grams USING (gram) LEFT JOIN heads ON head = substr(gram, 1, 2), size GROUP BY k),
m AS (SELECT prompt_id, chosen, rejected, c.mean_logp AS chosen_logp, r.mean_logp AS rejected_logp, round(c.mean_logp - r.mean_logp, 6) AS logp_margin FROM pairs LEFT JOIN scores c ON c.k = chosen LEFT JOIN scores r ON r.k = rejected)
SELECT *, round(ln(1 + exp(-0.1 * (logp_margin - 1.0))), 6) AS simpo, round(ln(1 + exp(-0.1 * logp_margin)), 6) AS dpo FROM m""")
def q71_preference_losses(spark, sf_dir):
    pairs = rank.mine_pairs(scored(spark, sf_dir)).select("prompt_id", "chosen", "rejected")
    texts = candidates(spark, sf_dir).select(F.col("candidate_index").alias("k"), F.col("output").alias("text"))
    model = preference.CharacterModel.of(docs(spark, sf_dir))
    return preference.losses(pairs, preference.log_probabilities(texts, model))


def in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source, to be read as one text each in the order of doc_id."""
    return docs(spark, sf_dir).select(F.col("source").alias("k"), F.col("doc_id").alias("row"), "text")


_ONE_TEXT = lambda key: f"one AS (SELECT {key} AS k, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS text FROM documents WHERE text IS NOT NULL GROUP BY 1)"


@query(f"WITH {_ONE_TEXT('source')} SELECT k AS source, gram, count(*) AS n FROM {_TRIGRAMS('one', 'k, ')} GROUP BY k, gram")
def q72_joined_trigrams(spark, sf_dir):
    return ft.trigrams(in_order(spark, sf_dir), order="row").withColumnRenamed("k", "source")


@query(f"WITH {_ONE_TEXT('0')}, {_ENTITIES.replace('FROM documents', 'FROM one')} SELECT * FROM ents")
def q73_joined_entities(spark, sf_dir):
    return lexicon.entities(docs(spark, sf_dir), order="doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
