"""Word, sentence and paragraph expressions.

Three kinds of word are told apart, and each measure says which it counts:
* unicode words: segments by Unicode word boundaries that hold a letter or digit, case kept (`unicode_words`);
* plain words: what stands between white space (`plain_words`);
* letter words: plain words cut down to letters, lower-cased (`letter_words`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LETTER, _MORE = r"[\p{L}\p{Nl}]", r"[\p{L}\p{Nl}\p{M}\x{200D}]*"
_L = rf"{_LETTER}{_MORE}(?:[.:·'’]{_LETTER}{_MORE})*"
_D = r"\p{Nd}+(?:[.,;'’]\p{Nd}+)*"
#: A unicode word, for Java's and RE2's engines alike. Runs of letters are one class, which engines go through fast.
UNICODE_WORD = rf"_*(?:{_L}|{_D})(?:{_L}|{_D}|_)*"
#: White space as Unicode has it; the engines' own \s is ASCII only.
SPACE = r"[\s\p{Z}\x{85}]"
NOT_SPACE = r"[^\s\p{Z}\x{85}]"


def unicode_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(UNICODE_WORD), F.lit(0))


def unicode_word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(UNICODE_WORD))


def plain_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NOT_SPACE + "+"), F.lit(0))


def plain_word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(NOT_SPACE + "+"))


def letter_words(text: Column) -> Column:
    words = F.transform(plain_words(text), lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}]", "")))
    return F.filter(words, lambda w: w != "")


def paragraphs(text: Column) -> Column:
    parts = F.transform(F.split(text, "\n\n"), lambda p: F.regexp_replace(p, rf"\A{SPACE}+|{SPACE}+\z", ""))
    return F.filter(parts, lambda p: p != "")


def split_sentences_plain(text: Column) -> Column:
    """Parts between `.`, `!` and `?` that hold a plain word."""
    return F.filter(F.split(text, "[.!?]", -1), lambda s: s.rlike(NOT_SPACE))


def terminated_sentence_count(text: Column) -> Column:
    """Parts between `.`, `!` and `?`, the empty one after a last mark left out."""
    parts = F.split(text, "[.!?]", -1)
    return F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)


def syllables(word: Column) -> Column:
    """Vowel groups, a last e left out; short words (three bytes at most) have one."""
    low = F.lower(word)
    groups = F.regexp_count(low, F.lit("[aeiouy]+"))
    silent = F.when(low.endswith("e") & (groups > 1), 1).otherwise(0)
    return F.when(F.octet_length(low) <= 3, 1).otherwise(F.greatest(groups - silent, F.lit(1)))


def count_of(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a string."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))
    return (removed / len(literal)).cast("long")


def trim_marks(word: Column) -> Column:
    return F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def bare_word(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"[^\p{L}\p{N}']", ""))


def contains_whole(text: Column, term: Column) -> Column:
    """Whether the term occurs with no letter or digit at either side. Both should be lower-cased."""
    quoted = F.regexp_replace(term, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    return F.regexp_like(text, F.concat(F.lit(r"(?<![\p{L}\p{N}])"), quoted, F.lit(r"(?![\p{L}\p{N}])")))


def word_windows(words: Column, n: int) -> Column:
    """Runs of n words, joined by a space."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def content_words(text: Column, stopwords: list[str]) -> Column:
    """Distinct lower-cased unicode words of letters only, three bytes at least, that are no stop words."""
    words = F.transform(unicode_words(text), lambda w: F.lower(w))
    stop = sorted(set(stopwords))
    return F.array_distinct(
        F.filter(words, lambda w: (F.octet_length(w) >= 3) & w.rlike(r"^\p{L}+$") & ~w.isin(stop))
    )
