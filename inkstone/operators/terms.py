"""Terms in texts: an automaton of all terms, built once in each Python worker, goes through each text once, whatever the
number of terms. Texts come in Arrow batches; what goes back is a number or the terms found."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def _automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        found.add_word(term, i)
    if terms:
        found.make_automaton()
    return found


def _places(terms: tuple[str, ...], text: str) -> Iterator[tuple[int, int]]:
    """Each occurrence of each term, by its end: the term's number, and the place behind it."""
    if terms:
        for last, i in _automaton(terms).iter(text):
            yield i, last + 1


def _inside(text: str, at: int) -> bool:
    """Whether there is a letter or digit at a place."""
    return 0 <= at < len(text) and unicodedata.category(text[at])[0] in "LN"


def counts(terms: tuple[str, ...], text: str) -> dict[int, int]:
    """Occurrences of each term that do not overlap with each other, from the left."""
    n: dict[int, int] = {}
    free: dict[int, int] = {}
    for i, end in _places(terms, text):
        if end - len(terms[i]) >= free.get(i, 0):
            n[i], free[i] = n.get(i, 0) + 1, end
    return n


def present(terms: tuple[str, ...], text: str) -> list[str]:
    return [terms[i] for i in sorted({i for i, _ in _places(terms, text)})]


def whole(terms: tuple[str, ...], text: str) -> list[str]:
    found = {i for i, end in _places(terms, text) if not _inside(text, end) and not _inside(text, end - len(terms[i]) - 1)}
    return [terms[i] for i in sorted(found)]


def _over(text: Column, kind: str, value: Callable[[str], object], type_: pa.DataType) -> Column:
    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([value(t or "") for t in texts.to_pylist()], type_)

    return run(text)


class Terms:
    """Distinct terms, in the order given; empty ones are left out. Compare lower-cased texts with lower-cased terms. A
    null text has no terms."""

    def __init__(self, terms: Iterable[str]):
        self.terms = tuple(dict.fromkeys(t for t in terms if t))

    def total(self, text: Column, weights: Mapping[str, int] | None = None) -> Column:
        """Occurrences of all terms, each times its weight; those of one term don't overlap, those of different ones may."""
        terms, by = self.terms, [(weights or {}).get(t, 1) for t in self.terms]
        return _over(text, "long", lambda t: sum(by[i] * n for i, n in counts(terms, t).items()), pa.int64())

    def present(self, text: Column) -> Column:
        """The terms that a text contains, in order."""
        terms = self.terms
        return _over(text, "array<string>", lambda t: present(terms, t), pa.list_(pa.string()))

    def whole(self, text: Column) -> Column:
        """The terms that occur with no letter or digit at either side, in order."""
        terms = self.terms
        return _over(text, "array<string>", lambda t: whole(terms, t), pa.list_(pa.string()))
