"""Personal data: fixed patterns first, then identifiers found by their contexts.

One pass over the texts finds the base spans and every other mention that looks like an
identifier (words with a digit or an at sign, also one written as (at) or [at], with or
without spaces around it). A mention's lexical pattern is the two
words before it and the word after it. Patterns and instances form a bipartite graph of
counts. Base instances are known at the start; each round scores a pattern by the share of
its mentions that are known, over at least ``support`` different instances, and an instance
by its patterns. Patterns that end above ``confidence`` turn their other mentions into spans.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import id_and_text, map_text, with_row_ids
from lodestone.staging import stage

KINDS = ["email", "ip", "card", "phone"]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"(?:[0-9@]|\(at\)|\[at\])\S*")
_AT = ("@", "(at)", "[at]")  # forms of the sign; words beside one that stands apart belong to it
_NOT_DIGIT = re.compile(r"[^0-9]+")
_EDGE = " \t\r\n\"'`.,;:!?()[]{}<>|*#$%&="
_CONTEXT = 64  # characters looked at on either side of a mention
_PARTS = 24  # no shape has more words: a card number has at most 23 digits
_LONG = 256  # longer values are compared by a digest

_SHAPES = {
    "email": re.compile(r"\S+\s?(?:@|\(at\)|\[at\])\s?\S+"),
    "ip": re.compile(r"[0-9]+(?:[.:][0-9]+){2,7}"),
    "card": re.compile(r"[0-9](?:[ -]?[0-9]){11,22}"),
    "phone": re.compile(r"[(+]?[0-9][ ().0-9/-]{5,22}[0-9]"),
}


def _emails(text: str):
    """Leftmost matches around each at sign: the part before it is one run of characters."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            free = match.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def _ip_ok(value: str) -> bool:
    parts = [p.lstrip("0") for p in value.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _card_ok(value: str) -> bool:
    digits = _NOT_DIGIT.sub("", value)
    return 16 <= len(digits) <= 19 and luhn(digits)


def _phone_ok(value: str) -> bool:
    return 8 <= len(_NOT_DIGIT.sub("", value)) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; ends are exclusive, in code points."""
    spans = [("email", s, e) for s, e in _emails(text)]
    for kind, pattern, holds in (
        ("ip", _IP, _ip_ok), ("card", _CARD, _card_ok), ("phone", _PHONE, _phone_ok)
    ):
        spans += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if holds(m.group())]
    return spans


def _context(text: str, start: int, end: int) -> str:
    before = text[max(0, start - _CONTEXT) : start].lower().split()
    after = text[end : end + _CONTEXT].lower().split()
    left = [w.strip(_EDGE) for w in before[-2:]]
    right = after[0].strip(_EDGE) if after else ""
    return " ".join(left) + " _ " + right


def mentions(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """Base spans and other identifier-like runs of words, each with its context."""
    out = [
        {"kind": k, "start": s, "end": e, "value": text[s:e], "pattern": _context(text, s, e)}
        for k, s, e in spans
    ]
    taken = sorted((s, e) for _, s, e in spans)
    at = 0
    for group in _word_groups(text):
        i = 0
        while i < len(group):
            for j in range(min(len(group), i + _PARTS), i, -1):  # the longest run that has a shape
                start, end = _stripped(text, group[i][0], group[j - 1][1])
                value = text[start:end]
                fits = [k for k in KINDS if _SHAPES[k].fullmatch(value)]
                if fits:
                    break
            else:
                i += 1
                continue
            i = j
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            if at < len(taken) and taken[at][0] < end:
                continue
            if len(value) > _LONG:
                value = digest(value)
            out.append({"kind": None, "start": start, "end": end, "value": value,
                        "pattern": _context(text, start, end), "fits": fits})
    return out


def _stripped(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in _EDGE:
        start += 1
    while end > start and text[end - 1] in _EDGE:
        end -= 1
    return start, end


def _word_groups(text: str) -> list[list[tuple[int, int]]]:
    """Words with a digit or an at sign, in groups of those with single spaces between."""
    groups: list[list[tuple[int, int]]] = []
    found, floor = _MARK.search(text), 0
    while found:
        start, end = found.start(), found.end()
        while start > floor and not text[start - 1].isspace():
            start -= 1
        if text.startswith(_AT, start) and start - 1 > floor and text[start - 1].isspace():
            before = start - 1
            while before > floor and not text[before - 1].isspace():
                before -= 1
            start = before if before < start - 1 else start
        if text.endswith(_AT, start, end) and text[end : end + 1].isspace():
            after = end + 1
            while after < len(text) and not text[after].isspace():
                after += 1
            end = after if after > end + 1 else end
        if groups and start - groups[-1][-1][1] == 1 and text[start - 1] == " ":
            groups[-1].append((start, end))
        else:
            groups.append([(start, end)])
        floor = end
        found = _MARK.search(text, end)
    return groups


def accepted_patterns(
    edges: DataFrame, rounds: int, support: int, confidence: float
) -> DataFrame:
    """(pattern, kind) of the patterns that score high after ``rounds`` rounds.

    ``edges`` has (pattern, value, fits, known, n). Every step is a join and a grouping of
    counts; nothing of the graph reaches the driver.
    """
    pairs = stage(
        edges.select("pattern", "value", "known", "n", F.explode("fits").alias("kind")), "pii-pairs"
    )
    totals = edges.groupBy("pattern").agg(F.sum("n").alias("all"))
    base = pairs.select("value", "kind", F.when(F.col("known") == F.col("kind"), 1.0)
                        .otherwise(0.0).alias("s"))
    score = base.groupBy("value", "kind").agg(F.max("s").alias("s"))
    patterns = None
    for _ in range(rounds):
        patterns = stage(
            pairs.join(score, ["value", "kind"]).groupBy("pattern", "kind").agg(
                F.sum(F.col("n") * F.col("s")).alias("hit"),
                F.sum(F.when(F.col("s") >= confidence, 1).otherwise(0)).alias("instances"),
            ).join(totals, "pattern").select(
                "pattern", "kind",
                F.when(F.col("instances") >= support, F.col("hit") / F.col("all"))
                .otherwise(0.0).alias("c"),
            ),
            "pii-patterns",
        )
        good = patterns.where(F.col("c") >= confidence)
        score = stage(
            pairs.join(good, ["pattern", "kind"], "left").groupBy("value", "kind").agg(
                F.greatest(
                    F.max(F.when(F.col("known") == F.col("kind"), 1.0).otherwise(0.0)),
                    F.coalesce(F.max("c"), F.lit(0.0)),
                ).alias("s")
            ),
            "pii-scores",
        )
    return patterns.where(F.col("c") >= confidence).select("pattern", "kind")


def find(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3,
    support: int = 3, confidence: float = 0.8,
) -> DataFrame:
    """(doc_id, base, added): base spans and spans found by context, per document row.

    Both are arrays of (rank, kind, start, end); rank is the kind's place in KINDS, and both are sorted
    by rank, then start. Null and empty texts have no spans; a repeated or null id keeps a
    row each; other columns are not read. A shape only limits which kinds a mention may
    become; the added span takes the kind of its pattern.
    """
    def work(part: pa.RecordBatch) -> dict:
        base, seen = [], []
        for text in part["text"].to_pylist():
            spans = base_spans(text or "")
            base.append([{"rank": KINDS.index(k), "kind": k, "start": s, "end": e}
                         for k, s, e in spans])
            seen.append([m | {"fits": m.get("fits", KINDS)} for m in mentions(text or "", spans)])
        return {"rid": part["rid"], "doc_id": part["doc_id"], "base": base, "seen": seen}

    span = "array<struct<rank: int, kind: string, start: long, end: long>>"
    schema = (
        f"rid long, doc_id long, base {span}, seen array<struct<kind: string, start: long, "
        "end: long, value: string, pattern: string, fits: array<string>>>"
    )
    source = with_row_ids(id_and_text(docs, id_col, text_col))
    rows = stage(map_text(source, work, schema), "pii-mentions")
    flat = rows.select("rid", F.explode("seen").alias("m")).select("rid", "m.*")
    edges = flat.groupBy("pattern", "value", F.col("kind").alias("known"), "fits").agg(
        F.count("*").alias("n")
    )
    good = accepted_patterns(stage(edges, "pii-edges"), rounds, support, confidence)
    fresh = flat.where("kind is null").drop("kind").join(good, "pattern").where(
        F.array_contains("fits", F.col("kind"))
    )
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    added = fresh.groupBy("rid", "start", "end").agg(
        F.min(F.struct(rank.alias("rank"), "kind")).alias("k")
    ).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct(
        F.col("k.rank").alias("rank"), F.col("k.kind").alias("kind"), "start", "end"
    ))).alias("added"))
    return rows.select("rid", "doc_id", "base").join(added, "rid", "left").select(
        "doc_id", "base", F.coalesce("added", F.array().cast(span)).alias("added")
    )


def digest(spans: str) -> str:
    """The checksum of a joined list of spans."""
    return hashlib.sha256(spans.encode()).hexdigest()
