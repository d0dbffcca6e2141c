"""Readers: each gives samples (content, source, origin_path, context_tag, position).

A registry finds the reader of a path: vaults first, then markdown, then plain text. Files are read whole by Spark, so
any store that Spark reaches will do."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clean, tokens
from ..operators import corpus

METADATA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("source", "origin_path", "context_tag", "captured_at")]
)
SAMPLE = T.StructType(
    [T.StructField("content", T.StringType()), T.StructField("metadata", METADATA), T.StructField("content_hash", T.StringType())]
)
#: Words of a plain-text pack; packs and sections of fewer than LEAST words are left out.
PACK, LEAST = 1024, 5


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    rows = rows.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("origin_path"))
    return rows.where(~F.col("origin_path").rlike(r"/\.[^/]+(/|$)"))  # nothing hidden


def _sections(files: DataFrame, source: str, tag: Callable[[Column], Column]) -> DataFrame:
    body = clean.strip_html_comments(clean.strip_front_matter(F.col("text")))
    rows = files.select("*", F.posexplode(clean.split_by_h1(body)).alias("position", "section"))
    rows = rows.where(tokens.plain_word_count(F.col("section.body")) >= LEAST)
    return rows.select(
        F.col("section.body").alias("content"), F.lit(source).alias("source"), "origin_path",
        tag(F.col("section.header")).alias("context_tag"), F.col("position").cast("long").alias("position"),
    )


def read_markdown(spark: SparkSession, path: str, context: str | None = None) -> DataFrame:
    return markdown_samples(_files(spark, path, "*.{md,markdown}"), context)


def markdown_samples(files: DataFrame, context: str | None = None) -> DataFrame:
    """The samples of markdown files (text, origin_path)."""
    return _sections(files, "markdown", lambda header: F.coalesce(F.lit(context), header, F.lit("longform")))


def read_vault(spark: SparkSession, path: str, context: str | None = None) -> DataFrame:
    """A note vault: notes only, no templates or trash, links unwrapped; daily notes are journal entries."""
    files = _files(spark, path, "*.md").where(~F.col("origin_path").rlike(r"/(templates|\.trash|\.obsidian)/"))
    tag = F.when(clean.is_daily_note(F.col("text")), "journal").otherwise(F.coalesce(F.lit(context), F.lit("notes")))
    files = files.withColumn("tag", tag).withColumn("text", clean.strip_dataview(clean.strip_wikilinks(F.col("text"))))
    return _sections(files, "obsidian", lambda header: F.col("tag"))


def pack_paragraphs(parts: Column, limit: int = PACK) -> Column:
    """Paragraphs joined up to the limit of plain words, in order; a last pack of fewer than LEAST words goes."""
    words = lambda p: tokens.plain_word_count(p)
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("own"), F.lit(0).alias("n"))

    def add(state: Column, part: Column) -> Column:
        full = (state["n"] + words(part) > limit) & (state["own"] != "")
        own = F.when(full | (state["own"] == ""), part).otherwise(F.concat(state["own"], F.lit("\n\n"), part))
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(state["own"]))).otherwise(state["done"]).alias("done"),
            own.alias("own"),
            F.when(full, words(part)).otherwise(state["n"] + words(part)).alias("n"),
        )

    return F.aggregate(
        parts, empty, add, lambda s: F.when(s["n"] >= LEAST, F.concat(s["done"], F.array(s["own"]))).otherwise(s["done"])
    )


def read_plain_text(spark: SparkSession, path: str, context: str | None = None) -> DataFrame:
    return plain_text_samples(_files(spark, path, "*.{txt,text}"), context)


def plain_text_samples(files: DataFrame, context: str | None = None) -> DataFrame:
    """The samples of plain text files (text, origin_path)."""
    text = clean.unify_line_ends(clean.strip_bom(F.col("text")))
    rows = files.select("origin_path", F.posexplode(pack_paragraphs(tokens.paragraphs(text))).alias("position", "content"))
    return rows.select(
        "content", F.lit("plain_text").alias("source"), "origin_path", F.lit(context).cast("string").alias("context_tag"),
        F.col("position").cast("long").alias("position"),
    )


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Samples stored before; lines that don't parse are left out."""
    return spark.read.schema(SAMPLE).option("mode", "DROPMALFORMED").json(path)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """term: lower-cased lines that are neither empty nor comments."""
    rows = spark.read.text(path).select(F.lower(F.trim("value")).alias("term"))
    return rows.where((F.col("term") != "") & ~F.col("term").startswith("#"))


def _scalar(value: str) -> str:
    value = value.strip()
    if value[:1] == '"':
        return json.loads(re.match(r'"(?:[^"\\]|\\.)*"', value)[0])
    if value[:1] == "'":
        return re.match(r"'((?:[^']|'')*)'", value)[1].replace("''", "'")
    return re.split(r"(?:^|\s)#", value)[0].strip()


_FLOW = re.compile(r"""(\w+):\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,}]*)""")
_ENTRY = re.compile(r"^( *)(- +)?(\w+):(?: +(.*)|)$")


def parse_suite(text: str) -> dict:
    """name, and prompts as (text, category), of a prompt suite: the part of YAML that such files use (a list of maps,
    quoted and plain values, block and folded texts, maps in braces, comments)."""
    lines = text.splitlines()
    suite: dict = {"name": "", "prompts": []}
    items: list[dict] = []
    k = 0
    while k < len(lines):
        line = lines[k]
        k += 1
        if re.match(r"^ *- *\{", line):
            while "}" not in line and k < len(lines):
                line, k = line + " " + lines[k].strip(), k + 1
            items.append({n: _scalar(v) for n, v in _FLOW.findall(line)})
            continue
        if not (m := _ENTRY.match(line)):
            continue
        indent, dash, name, value = len(m[1]) + len(m[2] or ""), m[2], m[3], (m[4] or "").strip()
        if re.fullmatch(r"[|>][+-]?", value):
            block = []
            while k < len(lines) and (not lines[k].strip() or len(lines[k]) - len(lines[k].lstrip(" ")) > (indent if dash else len(m[1]))):
                block.append(lines[k])
                k += 1
            while block and not block[-1].strip():
                block.pop()
            left = min((len(x) - len(x.lstrip(" ")) for x in block if x.strip()), default=0)
            body = "\n".join(x[left:].rstrip() for x in block)
            if value[0] == ">":
                body = re.sub(r"(?<!\n)\n(?!\n)", " ", body).replace("\n\n", "\n")
            value = body + ("" if value.endswith("-") or not body else "\n")
        else:
            value = _scalar(value)
        if dash:
            items.append({name: value})
        elif m[1] and items:
            items[-1][name] = value
        elif not m[1] and name == "name":
            suite["name"] = value
    suite["prompts"] = [(x.get("text", ""), x.get("category", "")) for x in items]
    return suite


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """text, category of the prompt suites at a path; each is a small file, parsed as a whole."""
    parse = F.udf(lambda t: parse_suite(t)["prompts"], "array<struct<text:string,category:string>>")
    return spark.read.text(path, wholetext=True).select(F.explode(parse("value")).alias("p")).select("p.*")


def read_fingerprints(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Profiles as `sinks.write_fingerprint` writes them, or a single one over several lines."""
    return spark.read.schema(schema).json(path) if schema else spark.read.option("multiLine", True).json(path)


def load_samples(spark: SparkSession, path: str, *, max_words: int = 2048) -> DataFrame:
    """doc_id, text of the samples stored below a path as JSON lines; if there are none, of its markdown and plain texts,
    taken in as `corpus.ingest` does."""
    stored = spark.read.schema(SAMPLE).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.{jsonl,json}").json(path).where("content is not null")
    number = F.xxhash64("content", "origin_path", "position")
    if not stored.isEmpty():
        return stored.select(F.xxhash64("content", "metadata.origin_path").alias("doc_id"), F.col("content").alias("text"))
    rows = read_folder(spark, path).select(number.alias("doc_id"), F.col("content").alias("text"), "context_tag")
    chunks, _ = corpus.ingest(rows, max_words=max_words)
    return chunks.select(F.xxhash64("doc_id", "chunk_index").alias("doc_id"), "text")


@dataclass(frozen=True)
class Source:
    name: str
    fits: Callable[[str, bool], bool]
    read: Callable[..., DataFrame]


#: In the order in which they are tried.
REGISTRY = [
    Source("obsidian", lambda path, vault: vault, read_vault),
    Source("markdown", lambda path, vault: path.lower().endswith((".md", ".markdown")), read_markdown),
    Source("plain_text", lambda path, vault: path.lower().endswith((".txt", ".text")), read_plain_text),
]


def detect(path: str, *, is_vault: bool = False) -> Source | None:
    return next((s for s in REGISTRY if s.fits(path, is_vault)), None)


def source_of(path: Column, is_vault: Column) -> Column:
    """The name of the reader that `detect` gives, as a column; null if none fits."""
    return (
        F.when(is_vault, "obsidian")
        .when(F.lower(path).rlike(r"\.(md|markdown)$"), "markdown")
        .when(F.lower(path).rlike(r"\.(txt|text)$"), "plain_text")
    )


def read_folder(spark: SparkSession, path: str, context: str | None = None) -> DataFrame:
    """All markdown and plain text below a folder."""
    return read_markdown(spark, path, context).unionByName(read_plain_text(spark, path, context))
