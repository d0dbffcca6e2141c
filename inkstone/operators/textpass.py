"""One pass over texts for words, syllables, sentences and marks.

The texts of an Arrow batch lie in one array of code points. Each code point has a class, and words are had from the
classes of neighbours, for all texts at once: runs of letters (with the marks behind them), digits and underscores, with
a single joining mark between two letters or two digits. Sentences are decided where end marks stand, which is the only
work that is done piece by piece. Nothing here leaves its task but counts, or what the caller asked for."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from ..functions.constants import HISTOGRAM_EDGES, INTERNAL_ABBREVIATIONS, STRONG_ABBREVIATIONS, WEAK_ABBREVIATIONS

LETTER, MARK, DIGIT, UNDER, JOINS_LETTERS, JOINS_DIGITS = 1, 2, 4, 8, 16, 32
_CLASS = {"L": LETTER, "Nl": LETTER, "M": MARK, "Nd": DIGIT}


def _class_of(code: int) -> int:
    char = chr(code)
    category = unicodedata.category(char)
    found = _CLASS.get(category, _CLASS.get(category[0], 0))
    found |= MARK * (code == 0x200D) | UNDER * (char == "_")
    return found | JOINS_LETTERS * (char in ".:·'’") | JOINS_DIGITS * (char in ".,;'’")


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point below 2**16: its class, the bytes of its lower case, and whether that has a vowel."""
    chars = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(1 << 16)]
    low = [c.lower() for c in chars]
    kinds = np.array([_class_of(ord(c)) for c in chars], np.uint8)
    return kinds, np.array([len(c.encode()) for c in low], np.int32), np.array([c[0] in "aeiouy" for c in low])


def _classes(codes: np.ndarray) -> np.ndarray:
    kinds = _tables()[0]
    out = kinds[np.minimum(codes, 0xFFFF)]
    for code in np.unique(codes[codes > 0xFFFF]).tolist():
        out[codes == code] = _class_of(code)
    return out


def parts(batch: pa.RecordBatch, column: int, rows: int = 500, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most so many rows and bytes of text, or one row; what is made of a byte takes some 30."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    k = 0
    while k < batch.num_rows:
        n = int(np.searchsorted(upto, (upto[k - 1] if k else 0) + size, "right")) - k
        n = max(1, min(rows, n))
        yield batch.slice(k, n)
        k += n


class Words:
    """The unicode words of some texts. Text i lies at begin[i] in the array of code points, its words are those from
    first[i] to first[i + 1]."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), "<i4")
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.concatenate([[0], np.cumsum(sizes + 1)])
        kind = _classes(self.codes)
        letter, digit = kind & LETTER > 0, kind & DIGIT > 0
        # a mark belongs to a letter before it, over other marks
        mark = (kind & MARK > 0) & ~letter
        owner = np.maximum.accumulate(np.where(mark, np.int32(0), np.arange(len(kind), dtype=np.int32)))
        lettery = letter | (mark & letter[owner])
        before, after = lambda x: np.concatenate([[False], x[:-1]]), lambda x: np.concatenate([x[1:], [False]])
        joins = ((kind & JOINS_LETTERS > 0) & before(lettery) & after(letter)) | ((kind & JOINS_DIGITS > 0) & before(digit) & after(digit))
        edges = np.flatnonzero(np.diff(lettery | digit | (kind & UNDER > 0) | joins, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        real = np.concatenate([[0], np.cumsum(letter | digit, dtype=np.int32)])
        some = real[ends] > real[starts]
        self.starts, self.ends = starts[some], ends[some]
        self.first = np.searchsorted(self.starts, self.begin)

    def lowered(self) -> pa.Array:
        """All words, lower-cased. They are cut out of the texts as arrays, unless a text's lower case is no character for
        each of its own, or depends on what follows."""
        if not len(self.starts):
            return pa.array([], pa.string())
        whole = "\n".join(self.texts)
        low = whole.lower()
        if len(low) != len(whole) or "Σ" in whole:
            return pa.array(self._lowered_apart(), pa.string())
        codes = np.frombuffer((low + "\n").encode("utf-32-le"), "<i4")
        inside = np.zeros(len(codes) + 1, np.int8)
        inside[self.starts] += 1
        inside[self.ends] -= 1
        own = codes[np.cumsum(inside[:-1], dtype=np.int8) > 0]
        width = 1 + (own > 0x7F).astype(np.int8) + (own > 0x7FF) + (own > 0xFFFF)
        upto = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        offsets = upto[np.concatenate([[0], np.cumsum(self.ends - self.starts)])].astype(np.int32)
        data = own.tobytes().decode("utf-32-le").encode()
        return pa.StringArray.from_buffers(len(self.starts), pa.py_buffer(offsets), pa.py_buffer(data))

    def _lowered_apart(self) -> list[str]:
        out: list[str] = []
        for i, text in enumerate(self.texts):
            low, at = text.lower(), int(self.begin[i])
            own = range(self.first[i], self.first[i + 1])
            if len(low) == len(text) and "Σ" not in text:  # whose lower case depends on what follows
                out += [low[a - at : b - at] for a, b in zip(self.starts[own.start : own.stop].tolist(), self.ends[own.start : own.stop].tolist(), strict=True)]
            else:
                out += [text[a - at : b - at].lower() for a, b in zip(self.starts[own.start : own.stop].tolist(), self.ends[own.start : own.stop].tolist(), strict=True)]
        return out

    def syllables(self) -> np.ndarray:
        """Of each word: vowel groups, a last e left out; words of three bytes at most have one."""
        _, sizes, vowels = _tables()
        small = np.minimum(self.codes, 0xFFFF)
        vowel = vowels[small] & (self.codes <= 0xFFFF)
        # the lower case of U+0130 is an i and a mark, which ends the group
        opens = vowel & ~np.concatenate([[False], (vowel & (self.codes != 0x130))[:-1]])
        upto = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int32)])
        groups, length = upto(opens), upto(np.where(self.codes > 0xFFFF, 4, sizes[small]))
        # a group that is open where the word begins is one of the word's too
        n = groups[self.ends] - groups[self.starts] + (vowel[self.starts] & ~opens[self.starts])
        last = self.codes[self.ends - 1]
        n = n - (((last == 101) | (last == 69)) & (n > 1))
        return np.where(length[self.ends] - length[self.starts] <= 3, 1, np.maximum(n, 1))


# --- sentences ------------------------------------------------------------------------------------------------------

_SPACES = "\t\n\x0b\x0c\r\x85" + "".join(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "Z")
_SPACE = f"[{re.escape(_SPACES)}]"
_ENDS = re.compile("([.!?…]+)[\"')\\]}”’»]*")
_PLAIN_WORD = re.compile(f"[^{re.escape(_SPACES)}]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")
_FIRST = re.compile(f"{_SPACE}*([^{re.escape(_SPACES)}])?")
_HAS_SPACE = re.compile(_SPACE)
_TO_LAST = re.compile(f"(?s:.*)[{re.escape(_SPACES)}(\\[{{\"'“‘]")
_LETTERS_STOP = regex.compile(r"\p{L}{1,6}\.")
_INITIALS = re.compile(r"[A-Z](\.[A-Z])+\Z")
_NEVER, _BEFORE_CAPITALS = frozenset(STRONG_ABBREVIATIONS + INTERNAL_ABBREVIATIONS), frozenset(WEAK_ABBREVIATIONS)
_PLAIN = frozenset(["", " ", "\n"])
#: Chunks, and characters, looked back at for a dotted abbreviation.
BACK, REACH = 8, 64


def _after_stop(text: str, start: int, stop: int, end: int, before: int, first: str) -> bool:
    """Whether a single full stop at `stop` ends a sentence. Its chunk is from start to end, the chunks looked back at begin
    at `before`, and first is the next character that is no space."""
    head = text[start:stop]
    context = (head if _HAS_SPACE.search(head) else text[before:stop])[-REACH:]
    if end == stop + 1:  # nothing closes behind it
        if context[-1:].isascii() and context[-1:].isdigit() and text[end : end + 1].isascii() and text[end : end + 1].isdigit():
            return False
        if text[end : end + 1].isalpha() and _LETTERS_STOP.match(text, end):
            return False
    # what stands before the stop, from the last space or opening mark: letters, with stops between them
    opened = _TO_LAST.match(context)
    group = context[opened.end() :] if opened else context
    if not all(part.isalpha() for part in group.split(".")):
        group = ""
    bare = group.replace(".", "").lower()
    if bare in _NEVER:
        return False
    if bare in _BEFORE_CAPITALS:
        return unicodedata.category(first) == "Lu" if first else False
    single = context[-1:].isalpha() and (len(context) == 1 or context[-2] == "." or context[-2] in _SPACES)
    return not (single or _INITIALS.match(group))


def _first(text: str, end: int) -> str:
    """The next character from `end` on that is no space."""
    near = text[end : end + 2]
    return near[1] if len(near) == 2 and near[0] == " " and near[1].isalnum() else _FIRST.match(text, end)[1] or ""


def cuts(text: str) -> list[int]:
    """The places behind each sentence but a last one without end marks."""
    out, starts, end = [], [], 0
    for found in _ENDS.finditer(text):
        start, stop, end = end, found.start(), found.end()
        starts.append(start)
        marks = found[1]
        if marks == ".":
            # most stops close a plain word behind a space, with a space or nothing after them
            space = text.rfind(" ", start, stop)
            word = text[space + 1 : stop]
            if space >= 0 and 1 < len(word) < REACH - 1 and text[end : end + 1] in _PLAIN and end == stop + 1 and word.isalpha() and (bare := word.lower()) not in _BEFORE_CAPITALS:
                good = bare not in _NEVER
            else:
                good = _after_stop(text, start, stop, end, starts[max(len(starts) - 1 - BACK, 0)], _first(text, end))
        else:
            first = _first(text, end)
            kind = unicodedata.category(first) if first else ""
            good = kind == "Lu" if marks[0] == "." else kind != "Ll"
        if good:
            out.append(end)
    return out


def plain_words(text: str) -> list[str]:
    """What stands between white space (see `tokens.plain_words`). split() goes by four separators more."""
    return _PLAIN_WORD.findall(text) if _SEPARATORS.search(text) else text.split()


def sentences(text: str) -> list[str]:
    """The sentences of a text, trimmed, without empty ones."""
    places = [0, *cuts(text), len(text)]
    parts = (text[a:b].strip(_SPACES) for a, b in zip(places, places[1:], strict=False))
    return [p for p in parts if p]


# --- counts ---------------------------------------------------------------------------------------------------------


def marks(text: str) -> list[int]:
    """Em dashes, en dashes, semicolons, colons, exclamation and question marks, parentheses (see `features.MARKS`)."""
    triple, n = text.count("---"), text.count
    return [n("—") + triple, n("–") + max(n("--") - triple, 0), n(";"), n(":"), n("!"), n("?"), n("(") + n(")")]


def sentence_lengths(words: Words, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the sentences of a text lie in the array of code points, and how many words each has."""
    text, at, own = words.texts[i], int(words.begin[i]), slice(words.first[i], words.first[i + 1])
    places = np.array([0, *cuts(text), len(text)], np.int64) + at
    starts, last = words.starts[own], words.ends[own] - 1
    a, b = np.searchsorted(places[1:-1], starts, "right"), np.searchsorted(places[1:-1], last, "right")
    lengths = np.bincount(a, minlength=len(places) - 1)
    for k in np.flatnonzero(b > a):  # a sentence ends inside of what would be one word
        lengths[a[k] + 1 : b[k] + 1] += 1
    return places, lengths


def paragraph_lengths(words: Words, i: int) -> np.ndarray:
    """How many words stand between the empty lines of a text."""
    text, at, breaks = words.texts[i], int(words.begin[i]), []
    place = text.find("\n\n")
    while place >= 0:
        breaks.append(place + at)
        place = text.find("\n\n", place + 2)
    return np.bincount(np.searchsorted(np.array(breaks, np.int64), words.starts[words.first[i] : words.first[i + 1]], "right"))


def counted(words: Words) -> np.ndarray:
    """A row for each text, in the order of `features.SUMS`."""
    n = len(words.texts)
    out = np.zeros((n, 8 + len(HISTOGRAM_EDGES) + 7), np.int64)
    out[:, 0] = np.diff(words.first)
    out[:, 1] = np.fromiter(map(len, words.texts), np.int64, n)
    upto = lambda x: np.concatenate([[0], np.cumsum(x)])[words.first]
    out[:, 2], out[:, 3] = np.diff(upto(words.ends - words.starts)), np.diff(upto(words.syllables()))
    edges = np.array(HISTOGRAM_EDGES)
    for i, text in enumerate(words.texts):
        at = int(words.begin[i])
        places, lengths = sentence_lengths(words, i)
        wordless = sum(1 for k in np.flatnonzero(lengths == 0).tolist() if text[places[k] - at : places[k + 1] - at].strip(_SPACES))
        some = lengths[lengths > 0]
        out[i, 4:8] = len(some) + wordless, len(some), some.sum(), (some * some).sum()
        out[i, 8 : 8 + len(edges)] = np.bincount(np.searchsorted(edges, some, "right") - 1, minlength=len(edges))[: len(edges)] if len(some) else 0
        out[i, 8 + len(edges) :] = marks(text)
    return out
