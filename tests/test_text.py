import random
import re

import pytest

from inkstone.functions import clean, tokens
from inkstone.operators.sentences import sentences

CLEANERS = [
    (clean.strip_html_tags, "a <b>bold</b> x", "a bold x"),
    (clean.strip_html_tags, "a < b and c", "a "),
    (clean.strip_html_tags, "> quoted", " quoted"),
    (clean.strip_svg_blocks, "a<svg x>y</svg>b<svg>z", "ab"),
    (clean.strip_fenced_divs, "a\r\n::: note\nb\n", "a\nb"),
    (clean.strip_link_anchors, "x[]{#a.b}y{=html}z", "xyz"),
    (clean.strip_link_anchors, "x[]{#open", "x"),
    (clean.strip_images, "a![alt](u)b![only]c", "abc"),
    (clean.unescape_marks, r"it\'s \"x\" \- \. \*", 'it\'s "x" - . *'),
    (clean.strip_signature, "text  \n-- \nname", "text"),
    (clean.strip_signature, "text\n--\nname", "text"),
    (clean.strip_zero_width, "a​b﻿c", "abc"),
    (clean.normalize_whitespace, "  a  b \n\n\n\nc\t \n", "a b\n\nc"),
    (clean.normalize_quotes, "\"a\" “b” \"c\"", '"a" "b" "c"'),
    (clean.normalize_quotes, "“a” “b” \"c", "“a” “b” \"c"),
    (clean.strip_tracking, "http://a/b?utm_source=x&id=5", "http://a/b?id=5"),
    (clean.strip_tracking, "http://a/b?id=5&ref=z end", "http://a/b?id=5 end"),
    (clean.strip_front_matter, "---\na: b\n---\n\nBody", "Body"),
    (clean.strip_html_comments, "a<!-- x -->b<!-- open", "ab"),
    (clean.strip_wikilinks, "[[page]] [[page|shown]] [[open", "page shown [[open"),
    (clean.strip_dataview, "a\n```dataview\nlist\n```\nb", "a\nb\n"),
    (clean.strip_bom, "﻿x", "x"),
    (clean.unify_line_ends, "a\r\nb\rc", "a\nb\nc"),
]


@pytest.mark.parametrize("cleaner, before, after", CLEANERS)
def test_cleaners(evaluate, cleaner, before, after):
    assert evaluate(cleaner, before) == [after]


def test_clean_chain(evaluate):
    assert evaluate(clean.clean, "<p>Hello​  “there”</p>\n::: x\n![i](u) see http://a/?utm_source=b&k=1\n-- \nme") == [
        "Hello “there”\n see http://a/?k=1"
    ]


def test_h1_sections(evaluate):
    got = evaluate(clean.split_by_h1, "intro\n# One\nbody one\n## sub\nx\n# Empty\n# Two\nlast")[0]
    assert [(s["header"], s["body"]) for s in got] == [(None, "intro"), ("One", "body one\n## sub\nx"), ("Two", "last")]


def test_words(evaluate):
    text = "can't e.g. 3.14 1,000 cutting-edge foo_bar U.S.A. it’s"
    assert evaluate(tokens.unicode_words, text, "", "--") == [
        ["can't", "e.g", "3.14", "1,000", "cutting", "edge", "foo_bar", "U.S.A", "it’s"], [], [],
    ]
    assert evaluate(tokens.plain_words, " a b c\n") == [["a", "b", "c"]]
    assert evaluate(tokens.letter_words, "It's 42 A1b") == [["its", "ab"]]


def test_sentence_counts(evaluate):
    assert evaluate(lambda t: tokens.terminated_sentence_count(t), "a. b. c", "a. b.", "") == [3, 2, 0]
    assert evaluate(tokens.split_sentences_plain, "a. . b!") == [["a", " b"]]
    assert evaluate(tokens.paragraphs, "a\n\n \n\n b ") == [["a", "b"]]


def test_syllables(evaluate):
    assert evaluate(tokens.syllables, "cat", "make", "reading", "idea", "queue", "rhythm") == [1, 1, 2, 2, 1, 1]


def test_whole_words(evaluate, spark):
    from pyspark.sql import functions as F

    hit = lambda term: lambda t: tokens.contains_whole(t, F.lit(term))
    assert evaluate(hit("art"), "art", "an art.", "party", "éart", "art2") == [True, True, False, False, False]
    assert evaluate(hit("c++"), "i use c++ now", "c++x") == [True, False]


SENTENCES = [
    ("Hello world. This is a test.", 2), ("Dr. Smith went home. He slept.", 2), ("He said no. Then left.", 1),
    ("so am I. Then", 1), ("google.com is", 2), ("end.Later. x", 2), ("Wait... what?", 1), ("Wait... What?", 2),
    ('"Go!" he said. Then.', 2), ('"Go!" She went.', 2), ("3.14 is pi.", 1), ("U.S.A. is big.", 1), ("H.G. Wells wrote.", 1),
    ("It was etc. and more.", 1), ("It was etc. Then more.", 2), ("See fig. 3 now.", 1), ("", 0), ("   ", 0), ("no end", 1),
    ("Really?! Yes.", 2), ("At 5 p.m. we left.", 1), ("e.g. this one.", 1),
]


@pytest.mark.parametrize("text, n", SENTENCES)
def test_sentences(evaluate, text, n):
    assert len(evaluate(sentences, text)[0]) == n


def test_sentences_keep_all_text(evaluate):
    rng = random.Random(4)
    parts = ["a", "Mr", "He", ".", "!", "?", "…", " ", "\n", "3", '"', ")", "e.g", "é", "É", "(", "no", "etc"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    squeeze = lambda s: re.sub(r"\s", "", s)
    for text, got in zip(texts, evaluate(sentences, *texts), strict=True):
        assert squeeze("".join(got)) == squeeze(text)
        assert all(s == s.strip() and s for s in got)


def test_cleaning_names_each_step_once(spark):
    from pyspark.sql import functions as F

    from inkstone.functions import clean

    rows = spark.range(1).select(F.col("id").cast("string").alias("text")).select(clean.clean(F.col("text")).alias("t"))
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert plan.count("<svg") == 1
