r"""Chat formatting by prefix-target expansion.

Each turn is written as `<|im_start|>role\ntext<|im_end|>\n`. Inside texts and roles every `<|`, with any backslashes
between the two, gets one more backslash between them, so no control string can stand there, and taking one away again
restores any text. Line feeds and backslashes of roles are escaped too.

Every assistant turn becomes an example: all turns before it are its context, and only its reply is trainable. The
examples of a conversation are prefixes of one another. So each is kept as a range of its conversation's transcript:
the row of an assistant turn says where its reply starts and ends, and what stands before is its context. That keeps a
conversation of n turns at n rows, not n * n / 2 texts. `render` writes examples out in full.

Rows are hashed by conversation, sorted by turn, and streamed, so a task holds one batch of rows, never a whole
conversation; hashes of a whole conversation are taken on the way. A conversation is read in order of turns by nature, so
one of any length is one task's stream.

Defined results: rows go by turn, then role, then text, nulls first. Null texts and roles count as empty; rows without
conv_id are one conversation of their own. Rows that repeat are turns each. A conversation without assistant turns has
no example (loss_chars 0). Extra columns are ignored. A very long text is one row of a batch. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, record_batch, tidy

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.DOTALL)

TURNS = "conv_id long, seq long, segment string, start long, loss_start long, loss_end long"
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "n_examples long, context_chars long"
)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def prefix_target_examples(conversations: DataFrame) -> DataFrame:
    """One row for each turn, in order within its task: conv_id, seq, segment (the turn as written), start (its place
    in the transcript), and for assistant turns loss_start and loss_end: the example whose context is the transcript up
    to loss_start and whose only trainable text is the range. Places are in characters; other turns have nulls."""
    target = arrow_schema(TURNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seq, place = object(), 0, 0
        for batch in batches:
            out: dict = {f.name: [] for f in target}
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if conv != current:
                    current, seq, place = conv, 0, 0
                head = f"{OPEN}{escape_role(role or '')}\n"
                body = escape(text or "")
                segment = f"{head}{body}{CLOSE}\n"
                from_ = place + len(head)
                loss = (from_, from_ + len(body)) if role == "assistant" else (None, None)
                for k, v in zip(out, (conv, seq, segment, place, *loss), strict=True):
                    out[k].append(v)
                seq, place = seq + 1, place + len(segment)
            yield record_batch(out, target)

    rows = conversations.select("conv_id", "turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(tidy(run), TURNS)


def render(turns: DataFrame) -> DataFrame:
    """conv_id, seq, context, target: the examples in full. Its size is that of all prefixes together."""
    t, e = turns.alias("t"), turns.where("loss_start is not null").alias("e")
    joined = e.join(t, F.col("t.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("t.seq") <= F.col("e.seq")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t.seq", "t.segment"))), lambda x: x["segment"]), "")
    whole = joined.groupBy("e.conv_id", "e.seq", "e.loss_start", "e.loss_end").agg(text.alias("text"))
    size = (F.col("loss_end") - F.col("loss_start")).cast("int")
    return whole.select(
        "conv_id",
        "seq",
        F.substring("text", 1, F.col("loss_start").cast("int")).alias("context"),
        F.substring("text", F.col("loss_start").cast("int") + 1, size).alias("target"),
    )


def digests(turns: DataFrame, *, ordered: bool = False) -> DataFrame:
    """What reading the written turns back gives, one row for each conversation; context_chars is the length of all
    examples' contexts together. ordered: turns come as `prefix_target_examples` gives them, with all of a conversation
    in one task and in order, and need not be dealt and sorted again."""
    if not ordered:
        turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    target = arrow_schema(DIGESTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def row() -> tuple:
            conv, n, turns_hash, chars, loss_hash, *rest = state
            return conv, n, turns_hash.hexdigest(), chars, loss_hash.hexdigest(), *rest

        for batch in batches:
            done = []
            columns = (batch.column(k).to_pylist() for k in (0, 1, 2, 3, 4, 5))
            for conv, seq, segment, start, loss_start, loss_end in zip(*columns, strict=True):
                if state is None or conv != state[0]:
                    if state is not None:
                        done.append(row())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                role, text = _TURN.fullmatch(segment).groups()
                state[1] += 1
                state[2].update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
                if loss_start is not None:
                    reply = unescape(segment[loss_start - start : loss_end - start])
                    state[3] += len(reply)
                    state[4].update(reply.encode())
                    state[6] += 1
                    state[7] += loss_start
                state[5] += len(segment)
            if done:
                yield record_batch(dict(zip((f.name for f in target), zip(*done), strict=True)), target)
        if state is not None:
            yield record_batch(dict(zip((f.name for f in target), zip(row()), strict=True)), target)

    return turns.mapInArrow(tidy(run), DIGESTS)
