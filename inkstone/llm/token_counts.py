"""Token counts of a BPE model with word marks, by whole-token shortcut.

The model marks each space. Its vocabulary is read once in each process and gives what the shortcut rests on:
* no piece holds a mark after another character, so that no merge joins what stands before a mark with it: the text
  falls into units, each the marks and the characters up to the next mark, and units are merged apart;
* no piece holds a line feed with anything else, so that a line feed is a unit by itself;
* each piece `mark + word` is encoded alone, and where it comes out as one token the unit is put into a table.
If a model breaks one of the first two, every text goes to the library whole. Units in the table count as one token;
only the rest are merged, by the library, and remembered up to a bound.

Defined results: null or empty texts have 0 bytes and 0 tokens. Rows are kept as they are, repeated ones too; a null
doc_id stays null. Extra columns are ignored. A very long text is counted whole, as one row of a batch. An empty table
gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo, blobs, kept, map_batches

MARK = "▁"
UNIT = re.compile(" +[^ ]*")


class Counter:
    """Counts the tokens of whole texts as the library does."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.vocab_size())]
        inner = [p for p in pieces if MARK in p.lstrip(MARK)]
        feeds = [p for p in pieces if "\n" in p and p != "\n"]
        # a space must become a mark, a mark alone a token, and nothing else may be rewritten
        plain = "".join(self.library.encode("a  B", out_type=str)) == f"{MARK}a{MARK}{MARK}B" and MARK in pieces
        self.splits = plain and not inner and not feeds
        self.feed = len(self.library.encode("\n")) - 1
        self.words = Memo(self.count, fixed=self.proven(pieces) | {"": 1} if self.splits else {})
        self.starts = Memo(self.count_start, fixed={"": 0})

    def proven(self, pieces: list[str]) -> dict[str, int]:
        """Words that alone, after a mark, are one token."""
        words = [p[1:] for p in pieces if len(p) > 1 and p[0] == MARK and MARK not in p[1:]]
        return {w: 1 for w, ids in zip(words, self.library.encode(words, num_threads=1), strict=True) if len(ids) == 1}

    def count(self, word: str) -> int:
        """Tokens of mark + word; the library puts the first mark itself."""
        return len(self.library.encode(word))

    def count_start(self, word: str) -> int:
        """Tokens of a word without a mark before it, as after a line feed."""
        return len(self.library.encode("\n" + word)) - 1 - self.feed

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if not self.splits or MARK in text or "\0" in text:
            return len(self.library.encode(text))
        lines = text.split("\n")
        total = self.feed * (len(lines) - 1)
        for k, line in enumerate(lines):
            first, *rest = line.split(" ")
            if "" in rest or not (k or first):  # several spaces in a row, or one at an end
                # the mark that the library puts before the text is one more space
                first, rest = ("", UNIT.findall(" " + line)) if not k else (first, UNIT.findall(line))
                rest = [unit[1:] for unit in rest]
                total += (self.starts[first] if k else 0) + sum(map(self.words.__getitem__, rest))
            else:
                total += (self.starts if k else self.words)[first] + sum(map(self.words.__getitem__, rest))
        return total


def counter(path: str) -> Counter:
    return kept(Counter, path)


def count_tokens(docs: DataFrame, path: str, *, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs."""

    def run(batch: pa.RecordBatch) -> dict:
        count = counter(path)
        texts = [b or b"" for b in blobs(batch.column(1))]
        tokens = [count(b.decode()) for b in texts]
        return {
            "doc_id": batch.column(0),
            "n_bytes": [len(b) for b in texts],
            "n_tokens": tokens,
            "over_limit": [n > limit for n in tokens],
        }

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", keeps=Counter)
