"""Encoding through a bounded memory of words.

A tokenizer whose pieces never cross the start of a word gives a text the ids of its
words one after the other. Each worker then encodes a word once and looks it up later.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of one generation. A worker remembers two; older words are encoded anew when they
#: come again, which changes no result.
MOST_WORDS = 300_000


class WordMemory:
    """Ids of words, as bytes; ``encode`` gets lists of words that are not known yet.

    ``parts`` may cut a word into parts whose ids make up its own.
    """

    def __init__(
        self, encode: Callable[[list[str]], list[bytes]], most: int = MOST_WORDS,
        parts: Callable[[str], list[str] | None] | None = None,
    ):
        self.encode, self.most, self.parts = encode, most, parts
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def of(self, words: list[str]) -> list[bytes]:
        """The ids of each of the words."""
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        ids = list(map(self.known.get, words))
        unknown = {w for w, x in zip(words, ids, strict=True) if x is None}
        if not unknown:
            return ids
        self._learn(unknown)
        find = self.known.__getitem__
        return [find(w) if x is None else x for w, x in zip(words, ids, strict=True)]

    def join_spaced(self, texts: list[str], wide: np.dtype, lead: str = "") -> list[bytes]:
        """As ``join``, for texts that are words with single spaces between them.

        A word but the first is looked up with ``lead`` before it. Each distinct word of the
        texts is looked up once, and the ids are gathered by number.
        """
        if not texts:
            return []
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = coded.indices.to_numpy().astype(np.int64)
        firsts = lists.offsets.to_numpy()
        if lead:
            number[firsts[:-1]] = len(words) + np.arange(len(texts))
            words = [lead + w for w in words] + [t.partition(" ")[0] for t in texts]
        ids = self.of(words)
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // wide.itemsize
        flat, starts = np.frombuffer(b"".join(ids), dtype=wide), np.cumsum(sizes) - sizes
        counts = sizes[number]
        ends = np.cumsum(counts)
        where = np.arange(ends[-1]) + np.repeat(starts[number] - (ends - counts), counts)
        data, cuts = flat[where].tobytes(), np.append(0, ends)[firsts] * wide.itemsize
        return [data[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def join(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of each text, given as its words."""
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        get, out, open_texts, unknown = self.known.get, [], [], set()
        for i, words in enumerate(texts):
            ids = list(map(get, words))
            try:
                out.append(b"".join(ids))
            except TypeError:  # a word is not known yet
                out.append(b"")
                open_texts.append((i, words, ids))
                unknown.update([w for w, x in zip(words, ids, strict=True) if x is None])
        self._learn(unknown)
        find = self.known.__getitem__
        for i, words, ids in open_texts:
            out[i] = b"".join([find(w) if x is None else x for w, x in zip(words, ids, strict=True)])
        return out

    def _learn(self, words: set[str]) -> None:
        known, older, fresh, cut = self.known, self.older, [], {}
        for word in words:
            ids = older.get(word)
            if ids is not None:
                known[word] = ids
            elif self.parts is not None and (parts := self.parts(word)) is not None:
                cut[word] = parts
            else:
                fresh.append(word)
        if cut:
            self._learn_plain({p for parts in cut.values() for p in parts}.union(fresh))
            find = known.__getitem__
            for word, parts in cut.items():
                known[word] = b"".join(map(find, parts))
        elif fresh:
            known.update(zip(fresh, self.encode(fresh), strict=True))

    def _learn_plain(self, words: set[str]) -> None:
        fresh = list(words.difference(self.known))
        if fresh:
            self.known.update(zip(fresh, self.encode(fresh), strict=True))
