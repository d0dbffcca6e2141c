"""DuckDB SQL that gives the same rows as the queries of `registry`."""

from __future__ import annotations

from ..functions.constants import (
    AUTHOR_VALID, BANNED_PHRASES, BANNED_WORDS, DISTANCE_WEIGHTS, FUNCTION_WORDS, HISTOGRAM_CENTERS, HISTOGRAM_EDGES,
    INTERNAL_ABBREVIATIONS, LEXICON_STOPWORDS, PROMPT_STOPWORDS, STRONG_ABBREVIATIONS, TRACKING_PARAMETERS, WEAK_ABBREVIATIONS,
)
from ..functions.tokens import NOT_SPACE, SPACE, UNICODE_WORD

#: A run of text up to and with end marks and what closes behind them.
CHUNK = "[^.!?…]*[.!?…]+[\"')\\]}”’»]*|[^.!?…]+"


def q(s: str) -> str:
    """A string literal."""
    return "'" + s.replace("'", "''") + "'"


def words(t: str) -> str:
    return f"regexp_extract_all({t}, {q(UNICODE_WORD)})"


def plain(t: str) -> str:
    return f"regexp_extract_all({t}, {q(NOT_SPACE + '+')})"


def mean6(x: str, where: str = "") -> str:
    """The mean of numbers of at least 0, rounded half up to six digits, in whole numbers so that ties don't depend on
    how doubles are rounded."""
    return f"CAST((2 * CAST(sum(CAST({x} AS DECIMAL(20,6))) {where} * 1000000 AS BIGINT) + count(*) {where}) // nullif(2 * count(*) {where}, 0) AS DOUBLE) / 1000000"


def literals(values: list[str]) -> str:
    return ", ".join(q(v) for v in dict.fromkeys(values))


def count_of(t: str, s: str) -> str:
    return f"CAST((length({t}) - length(replace({t}, {q(s)}, ''))) / {len(s)} AS BIGINT)"


def counts_cte(source: str) -> str:
    """tokens(k, w), wc(k, word, n) from `source`(k, text)."""
    return f"""
tokens AS (SELECT k, unnest({words('text')}) AS w FROM {source}),
wc AS (SELECT k, lower(w) AS word, count(*) AS n FROM tokens GROUP BY ALL)"""


_NEXT = "^" + SPACE + "*(" + NOT_SPACE + ")"
_SINGLE = "(^|" + SPACE + r"|\.)\p{L}$"
_ENDS = r"\A" + SPACE + "+|" + SPACE + r"+\z"


def sentences_cte(source: str) -> str:
    """sents(k, row, sid, sentence) from `source`(k, row, text)."""
    group = rf"(?:^|{SPACE}|[(\[{{\"'“‘])(\p{{L}}+(?:\.\p{{L}}+)*)$"
    strong, weak = literals(STRONG_ABBREVIATIONS + INTERNAL_ABBREVIATIONS), literals(WEAK_ABBREVIATIONS)
    return f"""
chunks AS (SELECT k, row, unnest(ch) AS chunk, unnest(range(1, len(ch) + 1)) AS pos
           FROM (SELECT k, row, regexp_extract_all(text, {q(CHUNK)}) AS ch FROM {source})),
looked AS (SELECT *, regexp_extract(chunk, '^([^.!?…]*)', 1) AS head, regexp_extract(chunk, '^[^.!?…]*([.!?…]*)', 1) AS marks,
           coalesce(lead(chunk) OVER (PARTITION BY row ORDER BY pos), '') AS nx,
           coalesce(string_agg(chunk, '') OVER (PARTITION BY row ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), '') AS prev FROM chunks),
context AS (SELECT *, substr(chunk, length(head) + length(marks) + 1) AS clo, right(prev || head, 64) AS ctx,
            regexp_extract(nx, {q(_NEXT)}, 1) AS nc FROM looked),
grouped AS (SELECT *, regexp_extract(ctx, {q(group)}, 1) AS g FROM context),
flags AS (SELECT *, CASE
    WHEN marks = '' THEN false
    WHEN starts_with(marks, '.') AND length(marks) > 1 THEN regexp_matches(nc, '^\\p{{Lu}}')
    WHEN NOT starts_with(marks, '.') THEN NOT regexp_matches(nc, '^\\p{{Ll}}')
    WHEN clo = '' AND regexp_matches(ctx, '[0-9]$') AND regexp_matches(nx, '^[0-9]') THEN false
    WHEN clo = '' AND regexp_matches(nx, '^\\p{{L}}{{1,6}}\\.') THEN false
    WHEN lower(replace(g, '.', '')) IN ({strong}) THEN false
    WHEN lower(replace(g, '.', '')) IN ({weak}) THEN regexp_matches(nc, '^\\p{{Lu}}')
    WHEN regexp_matches(g, '^[A-Z](\\.[A-Z])+$') THEN false
    WHEN regexp_matches(ctx, {q(_SINGLE)}) THEN false
    ELSE true END AS ends FROM grouped),
numbered AS (SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY row ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sid FROM flags),
sents AS (SELECT * FROM (SELECT k, row, sid, regexp_replace(string_agg(chunk, '' ORDER BY pos), {q(_ENDS)}, '', 'g') AS sentence
          FROM numbered GROUP BY k, row, sid) WHERE sentence <> '')"""


def syllables(w: str) -> str:
    groups = f"len(regexp_extract_all(lower({w}), '[aeiouy]+'))"
    return (
        f"CASE WHEN strlen(lower({w})) <= 3 THEN 1 ELSE greatest({groups} - CASE WHEN ends_with(lower({w}), 'e') AND {groups} > 1 THEN 1 ELSE 0 END, 1) END"
    )


MARKS_SQL = {
    "em_dash": lambda t: f"({count_of(t, '—')} + {count_of(t, '---')})",
    "en_dash": lambda t: f"({count_of(t, '–')} + greatest({count_of(t, '--')} - {count_of(t, '---')}, 0))",
    "semicolon": lambda t: count_of(t, ";"),
    "colon": lambda t: count_of(t, ":"),
    "exclamation": lambda t: count_of(t, "!"),
    "question": lambda t: count_of(t, "?"),
    "paren": lambda t: f"({count_of(t, '(')} + {count_of(t, ')')})",
}


def bins(n: str) -> list[str]:
    edges = [*HISTOGRAM_EDGES, 1 << 30]
    return [f"count(*) FILTER (WHERE {n} >= {a} AND {n} < {b})" for a, b in zip(edges, edges[1:], strict=False)]


def style_cte(source: str, name: str) -> str:
    """{name}_dense, {name}_words and {name}_grams from `source`(k, row, text)."""
    n = name
    marks = ", ".join(f"sum({f('text')}) AS {m}" for m, f in MARKS_SQL.items())
    per = ", ".join(f"round(CASE WHEN nw > 0 THEN {m} * 1000.0 / nw ELSE 0 END, 6) AS {m}" for m in MARKS_SQL)
    hist = ", ".join(f"round(CASE WHEN nl > 0 THEN CAST(b{i} AS DOUBLE) / nl ELSE 0 END, 6)" for i in range(len(HISTOGRAM_EDGES)))
    bin_cols = ", ".join(f"{b} AS b{i}" for i, b in enumerate(bins("len")))
    has = lambda x: f"round(CASE WHEN nw > 0 AND ns > 0 THEN {x} ELSE 0 END, 6)"
    return f"""
{n}_src AS (SELECT * FROM {source}),
{sentences_cte(f'{n}_src').replace('chunks', f'{n}_chunks').replace('looked', f'{n}_looked').replace('context', f'{n}_context').replace('grouped', f'{n}_grouped').replace('flags', f'{n}_flags').replace('numbered', f'{n}_numbered').replace('sents AS', f'{n}_sents AS').strip()},
{n}_len AS (SELECT k, len({words('sentence')}) AS len FROM {n}_sents),
{n}_shape AS (SELECT k, count(*) AS ns, count(*) FILTER (WHERE len > 0) AS nl, sum(len) AS sl, sum(len * len) AS sq, {bin_cols} FROM {n}_len GROUP BY k),
{n}_tok AS (SELECT k, unnest({words('text')}) AS w FROM {n}_src),
{n}_wc AS (SELECT k, lower(w) AS word, count(*) AS n FROM {n}_tok GROUP BY ALL),
{n}_tsum AS (SELECT k, count(*) AS nw, sum(length(w)) AS nc, sum({syllables('w')}) AS ny FROM {n}_tok GROUP BY k),
{n}_msum AS (SELECT k, sum(length(text)) AS n_chars, {marks} FROM {n}_src GROUP BY k),
{n}_rich AS (SELECT k, CAST(sum(n) AS BIGINT) AS t, count(*) AS v, CAST(sum(n * n) AS BIGINT) AS s2, count(*) FILTER (WHERE n = 1) AS v1, count(*) FILTER (WHERE n = 2) AS v2 FROM {n}_wc GROUP BY k),
{n}_all AS (SELECT m.*, coalesce(nw, 0) AS nw, coalesce(nc, 0) AS nc, coalesce(ny, 0) AS ny, coalesce(ns, 0) AS ns, coalesce(nl, 0) AS nl, sl, sq,
    t, v, s2, v1, v2, {', '.join(f'b{i}' for i in range(len(HISTOGRAM_EDGES)))}
    FROM {n}_msum m LEFT JOIN {n}_tsum USING (k) LEFT JOIN {n}_shape USING (k) LEFT JOIN {n}_rich USING (k)),
{n}_dense AS (SELECT k, CAST(nw AS BIGINT) AS n_words, CAST(n_chars AS BIGINT) AS n_chars,
    round(CASE WHEN nl > 0 THEN sl / nl ELSE 0 END, 6) AS mean,
    round(CASE WHEN nl > 0 THEN sqrt(greatest((nl * sq - sl * sl) / (CAST(nl AS DOUBLE) * nl), 0)) ELSE 0 END, 6) AS sd, [{hist}] AS histogram, {per},
    {has('0.39 * (CAST(nw AS DOUBLE) / ns) + 11.8 * (CAST(ny AS DOUBLE) / nw) - 15.59')} AS flesch_kincaid,
    {has('0.0588 * (CAST(nc AS DOUBLE) * 100.0 / nw) - 0.296 * (CAST(ns AS DOUBLE) * 100.0 / nw) - 15.8')} AS coleman_liau,
    {has('4.71 * (CAST(nc AS DOUBLE) / nw) + 0.5 * (CAST(nw AS DOUBLE) / ns) - 21.43')} AS ari,
    {has('CAST(ny AS DOUBLE) / nw')} AS avg_syllables,
    {RICH}
    FROM {n}_all),
{n}_words AS (SELECT k, word, n FROM {n}_wc WHERE word IN ({literals(FUNCTION_WORDS)})),
{n}_grams AS (SELECT k, gram, n FROM (SELECT k, gram, count(*) AS n, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, gram) AS r
    FROM (SELECT k, s[i] || s[i + 1] || s[i + 2] AS gram FROM (SELECT k, s, unnest(range(1, len(s) - 1)) AS i FROM (SELECT k, string_split(lower(text), '') AS s FROM {n}_src)))
    GROUP BY k, gram) WHERE r <= 500)"""


RICH = """round(coalesce(CAST(v AS DOUBLE) / t, 0), 6) AS ttr, round(CASE WHEN t > 1 THEN 10000.0 * (s2 - t) / (CAST(t AS DOUBLE) * t) ELSE 0 END, 6) AS yule_k,
    round(coalesce(CAST(v1 AS DOUBLE) / v, 0), 6) AS hapax, round(coalesce(CAST(v2 AS DOUBLE) / v, 0), 6) AS dis,
    round(CASE WHEN t > 1 THEN 1.0 - (s2 - t) / (CAST(t AS DOUBLE) * (t - 1)) ELSE 0 END, 6) AS simpson"""


def cosine_cte(name: str, a: str, b: str, term: str) -> str:
    """{name}(k, p, d) from pairs(k, p)."""
    return f"""
{name}_dot AS (SELECT pairs.k, pairs.p, sum(CAST(x.n AS DOUBLE) * y.n) AS dot FROM pairs JOIN {a} x ON x.k = pairs.k JOIN {b} y ON y.k = pairs.p AND y.{term} = x.{term} GROUP BY ALL),
{name} AS (SELECT pairs.k, pairs.p, round(CASE WHEN na IS NULL OR nb IS NULL THEN 0.5 ELSE least(greatest(1.0 - coalesce(dot, 0) / (sqrt(na) * sqrt(nb)), 0), 1) END, 6) AS d FROM pairs
    LEFT JOIN (SELECT k, sum(CAST(n AS DOUBLE) * n) AS na FROM {a} GROUP BY k) xa ON xa.k = pairs.k
    LEFT JOIN (SELECT k, sum(CAST(n AS DOUBLE) * n) AS nb FROM {b} GROUP BY k) xb ON xb.k = pairs.p
    LEFT JOIN {name}_dot z ON z.k = pairs.k AND z.p = pairs.p)"""


def emd(a: str, b: str) -> str:
    parts = []
    for i, (x, y) in enumerate(zip(HISTOGRAM_CENTERS, HISTOGRAM_CENTERS[1:], strict=False)):
        run = " + ".join(f"({a}[{j}] - {b}[{j}])" for j in range(1, i + 2))
        parts.append(f"abs({run}) * {y - x}")
    return f"least(greatest(({' + '.join(parts)}) / {HISTOGRAM_CENTERS[-1] - HISTOGRAM_CENTERS[0]}, 0), 1)"


def distance_cte(a: str, b: str, slop: str | None) -> str:
    """dist(k, p, parts, slop, base, overall) from pairs and the styles a and b; slop: a CTE (k, slop)."""
    off = lambda c, s: f"abs(x.{c} - y.{c}) / {s}"
    rel = lambda c: f"CASE WHEN abs(y.{c}) > 0.1 THEN abs((x.{c} - y.{c}) / greatest(abs(y.{c}), 1.0)) ELSE 0 END"
    unit = lambda e: f"round(least(greatest({e}, 0), 1), 6)"
    base = " + ".join(f"{k} * {w}" for k, w in DISTANCE_WEIGHTS.items())
    return f"""
{cosine_cte('fw', f'{a}_words', f'{b}_words', 'word').strip()},
{cosine_cte('ng', f'{a}_grams', f'{b}_grams', 'gram').strip()},
parts AS (SELECT pairs.k, pairs.p, fw.d AS function_words, ng.d AS ngrams,
    round(CASE WHEN x.mean = 0 OR y.mean = 0 THEN 0.5 ELSE {emd('x.histogram', 'y.histogram')} END, 6) AS sentences,
    {unit(f"({off('question', 10)} + {off('exclamation', 10)}) / 2")} AS terminal,
    {unit(f"({off('em_dash', 20)} + {off('semicolon', 10)} + {off('colon', 10)} + {off('paren', 20)}) / 4")} AS structural,
    {unit(f"({rel('flesch_kincaid')} + {rel('coleman_liau')} + CASE WHEN y.avg_syllables > 0 THEN abs((x.avg_syllables - y.avg_syllables) / y.avg_syllables) ELSE 0 END) / 3")} AS readability,
    {unit("(CASE WHEN y.yule_k > 0 THEN abs((x.yule_k - y.yule_k) / greatest(y.yule_k, 50.0)) ELSE 0 END + abs(x.hapax - y.hapax) * 2 + abs(x.simpson - y.simpson) * 10) / 3")} AS richness,
    {'coalesce(slop, 0.0)' if slop else '0.0'} AS sl
    FROM pairs JOIN {a}_dense x ON x.k = pairs.k JOIN {b}_dense y ON y.k = pairs.p JOIN fw ON fw.k = pairs.k AND fw.p = pairs.p JOIN ng ON ng.k = pairs.k AND ng.p = pairs.p
    {f'LEFT JOIN {slop} ON {slop}.k = pairs.k' if slop else ''}),
dist AS (SELECT *, round(CAST(sl AS DOUBLE), 6) AS slop, round(CAST(b0 AS DOUBLE) + 1e-9, 6) AS base, round(CAST(least(greatest(b0 * (1.0 + 0.4 * over * over), 0), 1) AS DOUBLE) + 1e-9, 6) AS overall
    FROM (SELECT *, least(greatest({base}, 0), 1) AS b0, least(greatest(sl - 0.02, 0) / 0.08, 1) AS over FROM parts))"""


def slop(t: str, denominator: str) -> str:
    hits = " + ".join(count_of(f"lower({t})", w) for w in BANNED_WORDS if w not in AUTHOR_VALID)
    phrases = " + ".join(count_of(f"lower({t})", p) for p in BANNED_PHRASES)
    return f"CASE WHEN {denominator} > 0 THEN least(greatest(({hits} + 2 * ({phrases})) * 100.0 / {denominator} / 5.0, 0), 1) ELSE 0 END"


def slop_presence(t: str) -> str:
    hits = " + ".join(f"CAST(contains(lower({t}), {q(w)}) AS INT)" for w in BANNED_WORDS)
    phrases = " + ".join(f"CAST(contains(lower({t}), {q(p)}) AS INT)" for p in BANNED_PHRASES)
    n = f"len({plain(t)})"
    return f"CASE WHEN {n} > 0 THEN least(({hits} + 2 * ({phrases})) * 100.0 / {n}, 100.0) ELSE 0 END"


def repetition(t: str) -> str:
    return f"""(SELECT CASE WHEN len(w) < 20 THEN 0 ELSE CAST(len(g) - len(list_distinct(g)) AS DOUBLE) / len(g) END FROM
    (SELECT w, list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) AS g FROM (SELECT {plain(t)} AS w)))"""


def content_words(t: str) -> str:
    return f"list_distinct(list_filter(list_transform({words(t)}, lambda w: lower(w)), lambda w: strlen(w) >= 3 AND regexp_matches(w, '^\\p{{L}}+$') AND w NOT IN ({literals(PROMPT_STOPWORDS)})))"


def relevance(prompt: str, output: str) -> str:
    return f"""(SELECT CASE WHEN len(cw) = 0 THEN 1.0 ELSE CAST(len(list_filter(cw, lambda w: len(list_filter(said, lambda s: starts_with(s, substr(w, 1, least(4, length(w)))))) > 0)) AS DOUBLE) / len(cw) END
    FROM (SELECT {content_words(prompt)} AS cw, list_distinct(list_transform({words(output)}, lambda w: lower(w))) AS said))"""


def replace_all(t: str, *steps: tuple[str, str]) -> str:
    for pattern, by in steps:
        t = f"regexp_replace({t}, {q(pattern)}, {q(by)}, 'g')"
    return t


def html_strip(t: str) -> str:
    return replace_all(t, (r"<[^>]*(?:>|\z)", ""), (">", ""))


def tracking(t: str) -> str:
    for p in TRACKING_PARAMETERS:
        value = rf"{p}=[^&\s\p{{Z}})\]]*"
        t = replace_all(t, *[(rf"\?{value}&", "?")] * 4, (rf"[?&]{value}", ""))
    return t


_LINE = "[\\t\\v\\f\\r \\p{Z}\\x{85}]+(\\n|\\z)"


def _cut(mark: str) -> str:
    return f"CASE WHEN strpos(t, chr(10) || {q(mark)} || chr(10)) > 0 THEN regexp_replace(string_split(t, chr(10) || {q(mark)} || chr(10))[1], {q(SPACE + '+' + chr(92) + 'z')}, '') ELSE NULL END"


#: The cleaning steps on a column t, in order.
CLEAN = {
    "strip_html_tags": html_strip("t"),
    "strip_svg_blocks": replace_all("t", (r"(?s)<svg.*?(?:</svg>|\z)", "")),
    "strip_fenced_divs": "array_to_string(list_filter(string_split(" + replace_all("t", (r"\r\n", "\n"), (r"\n\z", "")) + ", chr(10)), lambda l: NOT regexp_matches(l, " + q(rf"^{SPACE}*:::") + ")), chr(10))",
    "strip_link_anchors": replace_all("t", (r"\[\]\{#[^}]*\}?|\{=[^}]*\}", "")),
    "strip_images": replace_all("t", (r"!\[[^\]]*(?:\](?:\([^)]*\)?)?)?", "")),
    "unescape_marks": "replace(replace(replace(replace(replace(t, '\\''', ''''), '\\\"', '\"'), '\\-', '-'), '\\.', '.'), '\\*', '*')",
    "strip_signature": f"coalesce({_cut('-- ')}, {_cut('--')}, t)",
    "strip_zero_width": replace_all("t", (r"[\x{200B}-\x{200F}\x{FEFF}]", "")),
    "normalize_whitespace": replace_all("t", (_LINE, "\\1"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (rf"\A{SPACE}+|{SPACE}+\z", "")),
    "normalize_quotes": "CASE WHEN length(t) > length(translate(t, '“”‘’', '')) AND length(t) - length(translate(t, '\"''', '')) > length(t) - length(translate(t, '“”‘’', '')) THEN translate(t, '“”‘’', '\"\"''''') ELSE t END",
    "strip_tracking": tracking("t"),
}


def clean_steps(column: str, source: str, key: str) -> str:
    """The cleaning chain, one step for each select."""
    inner = f"SELECT {key}, {column} AS t FROM {source}"
    for s in CLEAN.values():
        inner = f"SELECT {key}, {s} AS t FROM ({inner})"
    return inner


#: Steps on notes and files, on a column t.
NOTES = {
    "strip_front_matter": replace_all("t", (r"(?s)\A---\r?\n.*?\n---\n*", "")),
    "strip_html_comments": replace_all("t", (r"(?s)<!--.*?(?:-->|\z)", "")),
    "strip_wikilinks": replace_all("t", (r"\[\[[^|\]]*\|([^\]]*)\]\]|\[\[([^\]]*)\]\]", r"\1\2")),
    "strip_bom": replace_all("t", (r"\A\x{FEFF}", "")),
    "unify_line_ends": replace_all("t", (r"\r\n?", "\n")),
}
_FENCED = replace_all("t", (r"(?ms)^[^\S\n]*```dataview.*?(?:^[^\S\n]*```[^\S\n]*$\n?|\z)", ""))
NOTES["strip_dataview"] = f"CASE WHEN {_FENCED} = '' OR ends_with({_FENCED}, chr(10)) THEN {_FENCED} ELSE {_FENCED} || chr(10) END"


def paragraphs(t: str, by: str = "\n\n") -> str:
    return f"list_filter(list_transform(string_split({t}, {q(by)}), lambda p: {replace_all('p', (_ENDS, ''))}), lambda p: p <> '')"


def chunks_cte(source: str, max_words: int, by: str) -> str:
    """chunks(doc_id, chunk_index, text) from `source`(doc_id, text): a walk over the paragraphs of each text. s is where
    the chunk in the making begins, r where its last paragraphs to be repeated begin, size and rsize their words."""
    return f"""
whole AS (SELECT doc_id, text, len({plain('text')}) AS n FROM {source}),
par AS MATERIALIZED (SELECT doc_id, CAST(i AS BIGINT) AS i, parts[i] AS part, CAST(len({plain('parts[i]')}) AS BIGINT) AS n FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, {paragraphs('text', by)} AS parts FROM whole WHERE n > {max_words}))),
walk AS (SELECT doc_id, i, i AS s, n AS size, i AS r, n AS rsize, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS z FROM par WHERE i = 1
  UNION ALL SELECT doc_id, i, s, size, CASE WHEN pop THEN r + 1 ELSE r END, CASE WHEN pop THEN rsize - first_n ELSE rsize END, a, z FROM (
    SELECT m.doc_id, m.i, m.s, m.size, m.r, m.rsize, m.a, m.z, m.r < m.i AND m.rsize > {max_words // 5} AS pop, f.n AS first_n FROM (
      SELECT w.doc_id, p.i, CASE WHEN w.size + p.n > {max_words} THEN w.r ELSE w.s END AS s, CASE WHEN w.size + p.n > {max_words} THEN w.rsize ELSE w.size END + p.n AS size,
             CASE WHEN w.size + p.n > {max_words} THEN p.i ELSE w.r END AS r, CASE WHEN w.size + p.n > {max_words} THEN 0 ELSE w.rsize END + p.n AS rsize,
             CASE WHEN w.size + p.n > {max_words} THEN w.s END AS a, CASE WHEN w.size + p.n > {max_words} THEN w.i END AS z
      FROM walk w JOIN par p ON p.doc_id = w.doc_id AND p.i = w.i + 1) m
    JOIN par f ON f.doc_id = m.doc_id AND f.i = m.r)),
ends AS (SELECT doc_id, a, z FROM walk WHERE a IS NOT NULL UNION ALL SELECT doc_id, s, i FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS k FROM walk) WHERE k = 1 AND size >= 5),
chunks AS (SELECT doc_id, CAST(0 AS BIGINT) AS chunk_index, text FROM whole WHERE n <= {max_words}
  UNION ALL SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY z, a) - 1, text FROM (
    SELECT e.doc_id, e.a, e.z, string_agg(part, {q(by)} ORDER BY i) AS text FROM ends e JOIN par p ON p.doc_id = e.doc_id AND p.i BETWEEN e.a AND e.z GROUP BY e.doc_id, e.a, e.z))"""


def length_table(kinds: dict[str, str], source: str) -> str:
    """SELECT of k, kind, mean, sd, median, p95 from lists of lengths (by kind) of `source`."""
    parts = " UNION ALL ".join(f"SELECT k, '{kind}' AS kind, unnest({e}) AS n FROM {source}" for kind, e in kinds.items())
    return f"""SELECT k, kind, round(CAST(sum(n) AS DOUBLE) / count(*), 6) AS mean, round(sqrt((count(*) * sum(n * n) - sum(n) * sum(n)) / (CAST(count(*) AS DOUBLE) * count(*))), 6) AS sd,
CAST(list_sort(list(n))[count(*) // 2 + 1] AS BIGINT) AS median, CAST(list_sort(list(n))[least(count(*) * 95 // 100, count(*) - 1) + 1] AS BIGINT) AS p95 FROM ({parts}) WHERE n > 0 GROUP BY k, kind"""


def bare_word(w: str) -> str:
    return f"lower(regexp_replace({w}, {q(chr(91) + '^' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + chr(39) + ']')}, '', 'g'))"


STOP = literals(LEXICON_STOPWORDS)
BANNED = literals(BANNED_WORDS)
