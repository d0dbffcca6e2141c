"""Model backends: whatever gives candidates for prompts. The engine needs no more of a model than this."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Backend(Protocol):
    """Gives a text for a prompt, the same one for the same seed."""

    name: str

    def generate(self, prompt: str, *, seed: int, max_tokens: int) -> str: ...


class Echo:
    """A backend for tests: the prompt's words, turned by a number that seed and prompt determine."""

    name = "echo"

    def generate(self, prompt: str, *, seed: int, max_tokens: int) -> str:
        words = prompt.split()
        if not words:
            return ""
        turn = int(hashlib.sha256(f"{seed}:{prompt}".encode()).hexdigest(), 16) % len(words)
        return " ".join((words[turn:] + words[:turn])[:max_tokens])


class Sampler:
    """A backend for tests, whose texts differ in length: the prompt's words, turned, and 4 to 13 of them. A prompt that
    begins with `refuse` fails for odd seeds."""

    name = "sampler"

    def generate(self, prompt: str, *, seed: int, max_tokens: int) -> str:
        words = prompt.split()
        if not words:
            return ""
        if words[0] == "refuse" and seed % 2:
            raise RuntimeError("refused")
        number = int(hashlib.sha256(f"{seed}:{prompt}".encode()).hexdigest()[:12], 16)
        turn = number % len(words)
        return " ".join((words[turn:] + words[:turn])[: min(4 + number // len(words) % 10, max_tokens)])


def generate(grid: DataFrame, backend: Backend, *, max_tokens: int = 512, errors: bool = False) -> DataFrame:
    """grid (prompt, seed, ...) with output: one call for each row, in the task that holds it. With errors, a call that
    fails gives null and a column error says why; else it ends the job."""
    schema = T.StructType([*grid.schema.fields, T.StructField("output", T.StringType()), *([T.StructField("error", T.StringType())] if errors else [])])

    def call(prompt: str | None, seed: int) -> tuple[str | None, str | None]:
        try:
            return backend.generate(prompt or "", seed=seed, max_tokens=max_tokens), None
        except Exception as e:
            if not errors:
                raise
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [call(p, s) for p, s in zip(batch.column("prompt").to_pylist(), batch.column("seed").to_pylist(), strict=True)]
            more = [pa.array([m[i] for m in made], pa.string()) for i in range(1 + errors)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema.names)

    return grid.mapInArrow(run, schema)
