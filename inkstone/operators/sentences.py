"""Rule-based sentences, within each row: no shuffle. The rules are in `textpass`."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import textpass


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once; inside array functions nothing else keeps it from being repeated."""
    return F.element_at(F.transform(F.array(value), then), 1)


def sentences(text: Column) -> Column:
    """The sentences of a text, trimmed, without empty ones; null of null."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else textpass.sentences(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return run(text)
