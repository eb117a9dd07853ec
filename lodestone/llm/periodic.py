"""Periodic runs of words, found as maximal pairs of a bottom-up LCP-interval tree.

Two equal stretches of a text that neither the words before nor the words after prolong
are a maximal pair. A pair at distance q whose stretch has 2 q words or more spans one
repetition of period q with at least three periods, and it is a run as it stands: nothing
has to be extended. Pairs at a multiple of the period name the same words, so of the pairs
with the same first and last word the nearest one gives the period.

A stretch of a run has ``least - least // 3`` words or more, so the tree needs no nodes
above that depth: suffixes whose first words occur once in their document are let go. The
documents of the others are ranked by doubling the length that suffixes are compared by,
and the tree is walked bottom-up over the LCP array. A node holds its positions in order, and again by the word to their left;
the smaller of two children looks up its positions in the lists of the larger one.

Within half the length of a node its positions are evenly spaced, so all but the first
have the same word on their left and all but the last the same word after them. One
position has one partner on each side at most: there are never more pairs than positions.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import id_and_text, map_text, raw_bytes

LEAST = 24  # words of the shortest run
AT_ONCE = 2 << 20  # bytes of text whose suffixes are ranked together; one longer text still comes whole


def _numbers(documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, other ones in each document, and the end of its document."""
    out, base = [], 0
    for words in documents:
        known: dict[bytes, int] = {}
        out.append(np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64) + base)
        base += len(known)
    sizes = np.array([len(d) for d in documents], dtype=np.int64)
    return np.concatenate(out), np.repeat(np.cumsum(sizes), sizes)


def _joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs of ranks."""
    return np.unique(first * (second.max(initial=0) + 1) + second, return_inverse=True)[1]


def deep_suffixes(ids: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Positions of all suffixes whose first ``depth`` words occur twice in their document."""
    at, rank, length = np.arange(len(ids)), ids, 1
    while True:
        often = np.bincount(rank)[rank] > 1 if len(rank) else np.zeros(0, dtype=bool)
        at, rank = at[often], rank[often]
        if length == depth or not len(at):
            return at
        step = min(length, depth - length)
        place = np.full(len(ids), -1, dtype=np.int64)
        place[at] = rank
        goes_on = at + step + length <= ends[at]
        at, rank = at[goes_on], rank[goes_on]
        after = place[at + step]
        at, rank, after = at[after >= 0], rank[after >= 0], after[after >= 0]
        rank, length = _joined(rank, after), length + step


def suffix_order(
    ids: np.ndarray, ends: np.ndarray, at: np.ndarray, depth: int
) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes ``at`` in the order of their words, and the number of words each shares
    with the one before it (0: fewer than ``depth``)."""
    words = np.arange(len(ids))
    rank, length, levels = np.unique(ids, return_inverse=True)[1], 1, []
    while True:
        levels.append((length, rank.astype(np.int32)))
        if len(np.unique(rank[at])) == len(at):
            break
        after = np.where(words + length < ends, rank[np.minimum(words + length, len(ids) - 1)] + 1, 0)
        rank, length = _joined(rank, after), 2 * length
    order = at[np.argsort(rank[at])]
    left, right = order[:-1].copy(), order[1:].copy()
    for length, rank in reversed(levels):
        on = np.flatnonzero((left < ends[order[:-1]]) & (right < ends[order[1:]]))
        on = on[rank[left[on]] == rank[right[on]]]
        left[on] += length
        right[on] += length
    shared = left - order[:-1]
    return order, np.concatenate([[0], np.where(shared >= depth, shared, 0)])


def _join(a: tuple, b: tuple, depth: int, before: np.ndarray, pairs: list) -> tuple:
    """The node of two children that share ``depth`` words; its maximal pairs go to ``pairs``.

    A node is its positions in order, and the same by the word before them.
    """
    if len(a[0]) < len(b[0]):
        a, b = b, a
    places, classes = a
    reach = depth // 2
    for x in b[0]:
        word = before[x]
        low, at = bisect_left(places, x - reach), bisect_left(places, x)
        if low < at:
            same = classes.get(word, ())
            if bisect_left(same, x) - bisect_left(same, x - reach) < at - low:
                pairs.append((places[low], x, depth))
        if at < len(places) and places[at] - x <= reach and before[places[at]] != word:
            pairs.append((x, places[at], depth))
    for x in b[0]:
        insort(places, x)
    for word, own in b[1].items():
        held = classes.get(word)
        if held is None:
            classes[word] = own
        else:
            for x in own:
                insort(held, x)
    return a


def maximal_pairs(
    order: np.ndarray, shared: np.ndarray, before: dict[int, int]
) -> list[tuple[int, int, int]]:
    """(first, second, words) of all maximal pairs at a distance of half their words or less."""
    pairs: list[tuple[int, int, int]] = []
    stack: list[tuple[int, tuple]] = []
    depths = [*shared.tolist()[1:], 0]
    for x, depth in zip(order.tolist(), depths, strict=True):
        node = ([x], {before[x]: [x]})
        while stack and stack[-1][0] > depth:  # intervals that end here
            deep, left = stack.pop()
            node = _join(left, node, deep, before, pairs)
        if depth:
            stack.append((depth, node))
    return pairs


def runs(documents: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each document, by start and then period.

    A run has ``least`` words or more and three periods or more.
    """
    depth = least - least // 3
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    if not any(len(d) >= least for d in documents):
        return out
    ids, ends = _numbers(documents)
    at = deep_suffixes(ids, ends, depth)
    if not len(at):
        return out
    # Only the documents that have such suffixes are sorted.
    sought = np.unique(np.searchsorted(np.unique(ends), at, side="right"))
    named = np.flatnonzero([len(d) > 0 for d in documents])[sought]
    inside = np.isin(ends, np.unique(ends)[sought])
    place = np.cumsum(inside) - 1
    firsts = np.cumsum([0] + [len(documents[k]) for k in named.tolist()])
    ids, ends, at = ids[inside], np.repeat(firsts[1:], np.diff(firsts)), place[at]
    order, shared = suffix_order(ids, ends, at, depth)
    opens = np.isin(at, firsts)  # nothing stands before the first word: a class of its own
    before = dict(zip(at.tolist(), np.where(opens, -1 - at, ids[at - 1]).tolist(), strict=True))
    found: dict[tuple[int, int], int] = {}
    for first, second, words in maximal_pairs(order, shared, before):
        period, end = second - first, second + words
        if end - first >= least and period < found.get((first, end), end):
            found[first, end] = period
    starts = np.array([s for s, _ in found], dtype=np.int64)
    owners = np.searchsorted(firsts, starts, side="right") - 1
    for ((start, end), period), k in zip(found.items(), owners.tolist(), strict=True):
        out[named[k]].append((start - int(firsts[k]), end - start, period))
    for each in out:
        each.sort(key=lambda r: (r[0], r[2]))
    return out


def with_planted_period(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a repetition that the id decides on; every tenth document has one."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def _most_periods(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    best = None
    for start, length, period in found:  # by start, then period: the first of equals stays
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run has after its first period."""
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()
    return [words[i] for i in kept]


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
    planted: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: its runs, the one with most periods, and the text without them.

    doc_id, n_runs, start, length, period, exponent_milli (of the run with the greatest
    length by period; nulls without a run), runs_sha256, collapsed_sha256 and n_words_kept.
    Words are runs of characters other than ASCII white space and are numbered from 0.
    Null and empty texts have no words and no runs; repeated rows are judged alike; a null
    id keeps its row. Texts are read whole, and one text is the unit of work. ``planted``
    first puts a repetition into every tenth document, for rows with an id. Other columns
    are not read.
    """
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
             "collapsed_sha256", "n_words_kept")

    def judge(documents: list[list[bytes]], made: dict) -> None:
        for words, found in zip(documents, runs(documents, least), strict=True):
            best = _most_periods(found)
            kept = collapsed(words, found) if found else words
            lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
            row = (len(found), *(best or (None, None, None)),
                   best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(),
                   hashlib.sha256(b" ".join(kept)).hexdigest(), len(kept))
            for name, value in zip(names, row, strict=True):
                made[name].append(value)

    def work(part: pa.RecordBatch) -> dict:
        made: dict = {"doc_id": part["doc_id"], **{n: [] for n in names}}
        held: list[list[bytes]] = []
        size = 0
        for doc_id, text in zip(part["doc_id"].to_pylist(), raw_bytes(part["text"]), strict=True):
            words = text.split()
            held.append(with_planted_period(words, doc_id) if planted else words)
            size += len(text)
            if size >= AT_ONCE:
                judge(held, made)
                held, size = [], 0
        if held:
            judge(held, made)
        return made

    return map_text(
        id_and_text(docs, id_col, text_col), work,
        "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string, n_words_kept long")
