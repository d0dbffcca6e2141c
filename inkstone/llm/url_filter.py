"""URL rules, indexed by their rarest literal token.

A rule has a host, a path and an action. It fits its host and all subdomains of it, if the path of the URL starts with
the rule's. Each rule is filed under one of the literal tokens that any URL it fits must hold whole: the labels of its
host and the path's words but for a last one that may go on in the URL. Of these the rarest over all URLs is taken. The
tokens of a URL fetch candidate rules, and only the candidates' regular expressions run. The longest fitting rule wins;
at equal length `allow` wins, then the rule that sorts first.

Defined results: a null URL, or one without `://`, has an empty host and path; where no rule fits, the verdict is
`default`. Rows are kept as they are, repeated ones too; extra columns are ignored. A very long URL is read whole. An
empty table gives an empty result. More than MAX_RULES rules are refused.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, blobs, map_batches, record_batch, tidy

WORD = re.compile(rb"[A-Za-z0-9]+")
#: Rules are broadcast with the function that uses them; more than this are refused rather than sent to every task.
MAX_RULES = 200_000


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parse_rule(action: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(action, host.lower(), slash + path)


def split_url(url: bytes | None) -> tuple[bytes, bytes]:
    at = url.find(b"://") if url is not None else -1
    if at < 0:
        return b"", b""
    rest = url[at + 3 :]
    for mark in (b"#", b"?"):
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition(b"/")
    return host.lower(), slash + path


def literals(rule: Rule) -> set[bytes]:
    """Tokens that a URL must hold whole for the rule to fit."""
    path = rule.path.encode()
    words = [m for m in WORD.finditer(path) if m.end() < len(path)]
    return {b"h" + x for x in rule.host.encode().split(b".") if x} | {b"p" + m[0] for m in words}


def tokens(host: bytes, path: bytes) -> set[bytes]:
    return {b"h" + x for x in host.split(b".") if x} | {b"p" + x for x in WORD.findall(path)}


def token_counts(urls: DataFrame, wanted: frozenset[bytes]) -> dict[bytes, int]:
    """In how many URLs each wanted token occurs; the result has no more rows than there are wanted tokens."""
    target = arrow_schema("token binary, n long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for url in blobs(batch.column(0)):
                seen.update(wanted & tokens(*split_url(url)))
        yield record_batch({"token": list(seen), "n": list(seen.values())}, target)

    rows = urls.select("url").mapInArrow(tidy(count), "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {bytes(r["token"]): r["n"] for r in rows.collect()}


def build_index(rules: list[Rule], counts: dict[bytes, int]) -> tuple[dict, list]:
    """Candidates by token, and those rules that have no literal token and are always tried."""
    index: dict[bytes, list] = {}
    always = []
    for rule in rules:
        tail = re.escape(rule.path.encode()) if rule.path else rb"(?=/|\Z)"
        entry = (re.compile(rb"(?:[^/]*\.)?" + re.escape(rule.host.encode()) + tail), rule.name, rule.action)
        if found := literals(rule):
            index.setdefault(min(found, key=lambda t: (counts.get(t, 0), t)), []).append(entry)
        else:
            always.append(entry)
    return index, always


def judge_urls(pages: DataFrame, rules: list[Rule], *, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} can be sent to every task")
    wanted = frozenset(t for r in rules for t in literals(r))
    index, always = build_index(rules, token_counts(pages, wanted))
    keys = frozenset(index)

    def judge(batch: pa.RecordBatch) -> dict:
        out: dict = {k: [] for k in ("host", "path", "rule", "verdict")}
        for url in blobs(batch.column(1)):
            host, path = split_url(url)
            best = None
            tried = [x for t in keys & tokens(host, path) for x in index[t]] + always
            for pattern, name, action in tried:
                key = (-len(name), action != "allow", name)
                if (best is None or key < best[0]) and pattern.match(host + path):
                    best = (key, name, action)
            out["host"].append(host.decode())
            out["path"].append(path.decode())
            out["rule"].append(best and best[1])
            out["verdict"].append(best[2] if best else default)
        return out | {"page_id": batch.column(0)}

    return map_batches(pages.select("page_id", "url"), judge, "page_id long, host string, path string, rule string, verdict string")
