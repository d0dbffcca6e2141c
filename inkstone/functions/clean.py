"""Text cleaning as column expressions, in the order that `clean` applies them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import TRACKING_PARAMETERS
from .tokens import SPACE


def _replace(text: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, pattern, by)


def strip_html_tags(text: Column) -> Column:
    """Drops `<` up to `>`, an unclosed `<` with all that follows, and each `>` left."""
    return _replace(_replace(text, r"<[^>]*(?:>|\z)"), ">")


def strip_svg_blocks(text: Column) -> Column:
    return _replace(text, r"(?s)<svg.*?(?:</svg>|\z)")


def strip_fenced_divs(text: Column) -> Column:
    """Drops lines that start with `:::`; line ends become line feeds, a last one goes."""
    lines = F.split(_replace(_replace(text, r"\r\n", "\n"), r"\n\z"), "\n", -1)
    return F.array_join(F.filter(lines, lambda line: ~line.rlike(rf"^{SPACE}*:::")), "\n")


def strip_link_anchors(text: Column) -> Column:
    return _replace(text, r"\[\]\{#[^}]*\}?|\{=(?=(?s:.{4}))[^}]*\}")


def strip_images(text: Column) -> Column:
    return _replace(text, r"!\[[^\]]*(?:\](?:\([^)]*\)?)?)?")


def unescape_marks(text: Column) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit("\\" + c), F.lit(c)), "'\"-.*", text)


def strip_signature(text: Column) -> Column:
    """Cuts at the first signature mark, `-- ` on a line by itself before `--`."""
    out = text
    for mark in ("\n--\n", "\n-- \n"):
        cut = _replace(F.substring_index(text, mark, 1), rf"{SPACE}+\z")
        out = F.when(F.instr(text, mark) > 0, cut).otherwise(out)
    return out


def strip_zero_width(text: Column) -> Column:
    return _replace(text, r"[\x{200B}-\x{200F}\x{FEFF}]")


def normalize_whitespace(text: Column) -> Column:
    """No spaces at line ends, single ones elsewhere, one empty line at most, none at either end."""
    text = _replace(text, r"(?:[\s\p{Z}\x{85}&&[^\n]])+(?=\n|\z)")
    text = _replace(_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return _replace(text, rf"\A{SPACE}+|{SPACE}+\z")


def normalize_quotes(text: Column) -> Column:
    """Makes quotation marks straight where both styles occur and the straight ones prevail."""
    smart = F.length(text) - F.length(F.translate(text, "“”‘’", ""))
    straight = F.length(text) - F.length(F.translate(text, "\"'", ""))
    return F.when((smart > 0) & (straight > smart), F.translate(text, "“”‘’", "\"\"''")).otherwise(text)


def strip_tracking(text: Column) -> Column:
    """Drops tracking parameters, one after the other; `?` stays where other parameters follow. Texts without any are
    looked at once."""

    def strip(text: Column) -> Column:
        for p in TRACKING_PARAMETERS:
            value = rf"{p}=[^&\s\p{{Z}})\]]*"
            for _ in range(4):
                text = _replace(text, rf"\?{value}&", "?")
            text = _replace(text, rf"[?&]{value}")
        return text

    any_of = "[?&](?:" + "|".join(TRACKING_PARAMETERS) + ")="
    return _bound(lambda t: F.when(t.rlike(any_of), strip(t)).otherwise(t), text)


CHAIN = [
    strip_html_tags, strip_svg_blocks, strip_fenced_divs, strip_link_anchors, strip_images, unescape_marks,
    strip_signature, strip_zero_width, normalize_whitespace, normalize_quotes, strip_tracking,
]


def _bound(step: Callable[[Column], Column], text: Column) -> Column:
    """step(text), with the text had once however often the step names it: unbound, the chain grows with the product of
    how often."""
    return F.element_at(F.transform(F.array(text), step), 1)


def clean(text: Column) -> Column:
    return reduce(lambda t, f: _bound(f, t), CHAIN, text)


def strip_front_matter(text: Column) -> Column:
    return _replace(text, r"(?s)\A---(?=\r?\n).*?\n---\n*")


def strip_html_comments(text: Column) -> Column:
    return _replace(text, r"(?s)<!--.*?(?:-->|\z)")


def strip_wikilinks(text: Column) -> Column:
    """`[[page]]` becomes page, `[[page|shown]]` becomes shown."""
    inner = r"(?:(?!\]\])[^|])*+"
    return _replace(text, rf"(?s)\[\[{inner}\|((?:(?!\]\]).)*)\]\]|\[\[((?:(?!\]\]).)*)\]\]", "$1$2")


def strip_dataview(text: Column) -> Column:
    """Drops fenced dataview blocks, an unclosed one with all that follows; the text then ends with a line feed."""
    blank = r"[^\S\n]*"
    out = _replace(text, rf"(?dms)^{blank}```dataview.*?(?:^{blank}```{blank}$\n?|\z)")
    return F.when((out == "") | out.endswith("\n"), out).otherwise(F.concat(out, F.lit("\n")))


def is_daily_note(text: Column) -> Column:
    return F.lower(F.regexp_extract(text, r"(?s)\A---(.*?)---", 1)).rlike("daily|journal")


def strip_bom(text: Column) -> Column:
    return _replace(text, r"\A\x{FEFF}")


def unify_line_ends(text: Column) -> Column:
    return _replace(text, r"\r\n?", "\n")


def split_by_h1(text: Column) -> Column:
    """Sections with a body, as (header, body): a header is a line that starts with `# `; what stands before the first
    one has none."""
    ends = rf"\A{SPACE}+|{SPACE}+\z"
    parts = F.split(unify_line_ends(text), r"(?dm)^# ", -1)
    head = F.array(F.struct(F.lit(None).cast("string").alias("header"), _replace(F.element_at(parts, 1), ends).alias("body")))
    rest = F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda s: F.struct(
            _replace(F.regexp_extract(s, r"\A([^\n]*)", 1), ends).alias("header"),
            _replace(_replace(s, r"\A[^\n]*\n?"), ends).alias("body"),
        ),
    )
    return F.filter(F.concat(head, rest), lambda x: x["body"] != "")
