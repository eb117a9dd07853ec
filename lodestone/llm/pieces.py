"""SentencePiece models run by the tokenizers library.

The model file is parsed here (it is a small protobuf), and its normaliser, the metaspace
marker, piece scores and byte fallback are rebuilt as a tokenizers pipeline. A model of
kind BPE gets its merges from the piece scores; a unigram model takes the scores as they
are. Every word that a worker meets for the first time is also encoded and decoded by the
sentencepiece library, so parity is verified on all text and not on a sample.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import arrow_schema, id_and_text, map_text
from lodestone.llm.words import WordMemory

MARK = "▁"  # stands for a space
#: New words that both libraries encode at once; what they return for a word is far larger than its ids.
WORDS_AT_ONCE = 8192
#: Text handled at once. A larger part has more new words than a worker should remember.
PART_BYTES = 2 << 20
UNIGRAM, BPE = 1, 2  # fixed values of the model format
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> list[tuple[int, object]]:
    """(number, value) of each field of a protobuf message."""
    out, at = [], 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        number, kind = key >> 3, key & 7
        if kind == 0:
            out.append((number, varint()))
        elif kind == 2:
            size = varint()
            out.append((number, data[at : at + size]))
            at += size
        else:
            size = 4 if kind == 5 else 8
            out.append((number, struct.unpack_from("<f" if size == 4 else "<d", data, at)[0]))
            at += size
    return out


def parse_model(data: bytes) -> dict:
    """Pieces (text, score, type) and the settings that encoding needs."""
    pieces, trainer, normaliser = [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append((piece[1].decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normaliser = dict(_fields(value))
    return {
        "pieces": pieces,
        "kind": trainer.get(3, UNIGRAM),
        "byte_fallback": bool(trainer.get(35, 0)),
        "unknown_surface": trainer.get(44, " ⁇ ".encode()).decode(),
        "charsmap": normaliser.get(2, b""),
        "prefix": bool(normaliser.get(3, 1)),
        "squeeze": bool(normaliser.get(4, 1)),
        "escape": bool(normaliser.get(5, 1)),
    }


def _merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """All splits of each piece into two pieces, best scored piece first."""
    number = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER, UNUSED)}
    made = []
    for piece, i in number.items():
        for cut in range(1, len(piece)):
            left, right = number.get(piece[:cut]), number.get(piece[cut:])
            if left is not None and right is not None:
                made.append((-pieces[i][1], i, left, right))
    return [(pieces[a][0], pieces[b][0]) for _, _, a, b in sorted(made)]


def build(model: dict):
    """The tokenizers pipeline of a parsed model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    pieces = model["pieces"]
    unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), None)
    if model["kind"] == UNIGRAM:
        core = models.Unigram(
            [(p, s) for p, s, _ in pieces], unk_id=unknown, byte_fallback=model["byte_fallback"])
    elif model["kind"] == BPE:
        core = models.BPE(
            {p: i for i, (p, _, _) in enumerate(pieces)}, _merges(pieces), fuse_unk=True,
            unk_token=None if unknown is None else pieces[unknown][0],
            byte_fallback=model["byte_fallback"])
    else:
        raise ValueError(f"model kind {model['kind']} has no pieces of its own")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model["charsmap"])] if model["charsmap"] else []
    if model["squeeze"]:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model["prefix"]:
        steps.append(normalizers.Prepend(MARK))
    if model["escape"]:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    tokenizer.decoder = decoders.Sequence(
        [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        + ([decoders.Strip(" ", 1, 0)] if model["prefix"] else []))
    own = [p for p, _, kind in pieces if kind == USER]
    if own:
        tokenizer.add_tokens([AddedToken(p, normalized=True, special=False) for p in own])
    return tokenizer


class Codec:
    """Encoding and decoding of whole texts, verified word by word."""

    def __init__(self, path: str, threads: int):
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        import sentencepiece

        with open(path, "rb") as file:
            self.model = parse_model(file.read())
        self.tokenizer = build(self.model)
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        self.threads = threads
        pieces = self.model["pieces"]
        self.mark = next((i for i, p in enumerate(pieces) if p[0] == MARK), None)
        #: Words may be encoded alone if no piece has the marker behind another character,
        #: the normaliser changes nothing but spaces, and a lone marker is a piece.
        self.by_words = (
            self.mark is not None and model_is_plain(self.model)
            and not any(MARK in p.lstrip(MARK) for p, _, _ in pieces)
        )
        self.table = [self._surface(p, kind) for p, _, kind in pieces]
        self.differing: set[str] = set()
        self.memory = WordMemory(self._encode_new, most=250_000)

    def _surface(self, piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == UNKNOWN:
            return self.model["unknown_surface"].encode()
        return b"" if kind == CONTROL else piece.replace(MARK, " ").encode()

    def _encode_new(self, words: list[str]) -> list[bytes]:
        """Ids of new words by the tokenizers library; where the sentencepiece library has
        others, the word is noted as one without parity."""
        out = []
        for start in range(0, len(words), WORDS_AT_ONCE):
            some = words[start : start + WORDS_AT_ONCE]
            mine = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            theirs = self.reference.encode(some, num_threads=self.threads)
            for word, a, b in zip(some, mine, theirs, strict=True):
                if self.by_words and word == "":
                    a = b = [self.mark]
                if a != b:
                    self.differing.add(word)
                out.append(np.array(a, dtype="<u4").tobytes())
        return out

    def cut(self, text: str) -> list[str]:
        """Words, each without the one space before it that its marker stands for."""
        if not text:
            return []
        if not self.by_words:
            return [text]
        if not self.is_spaced(text):
            return re.split(f"(?<=[^ {MARK}]) ", text)
        return text.split(" ")

    def is_spaced(self, text: str) -> bool:
        """Whether the words are what stands between single spaces."""
        return bool(text) and self.by_words and not ("  " in text or text[0] == " " or MARK in text)

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[int]]:
        """Ids (little-endian, 32 bits each) of each text and its number of words without parity."""
        spaced = [i for i, t in enumerate(texts) if self.is_spaced(t)]
        others = sorted(set(range(len(texts))).difference(spaced))
        ids: list = [b""] * len(texts)
        for at, data in (
            (spaced, self.memory.join_spaced([texts[i] for i in spaced], np.dtype("<u4"))),
            (others, self.memory.join([self.cut(texts[i]) for i in others])),
        ):
            for i, x in zip(at, data, strict=True):
                ids[i] = x
        if not self.differing:
            return ids, [0] * len(texts)
        return ids, [sum(w in self.differing for w in self.cut(t)) for t in texts]

    def decode(self, ids: list[bytes]) -> list[str]:
        find, prefix = self.table.__getitem__, self.model["prefix"]
        out = []
        for data in ids:
            text = b"".join(map(find, np.frombuffer(data, dtype="<u4").tolist()))
            out.append((text[1:] if prefix and text[:1] == b" " else text).decode(errors="replace"))
        return out


def model_is_plain(model: dict) -> bool:
    return (
        not model["charsmap"] and model["prefix"] and model["escape"] and not model["squeeze"]
        and not any(kind == USER for _, _, kind in model["pieces"])
    )


@lru_cache(2)
def codec(path: str, threads: int) -> Codec:
    """Kept by the worker between tasks, with the words it knows."""
    return Codec(path, threads)


def encode(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", threads: int = 2
) -> DataFrame:
    """(doc_id, ids array<int>, n_differing): the whole text of every row.

    Ids are those of the tokenizers library. Null and empty texts have none. ``n_differing``
    counts the words to which the sentencepiece library gives other ids. Repeated and null ids keep
    their rows; other columns are not read. ``model_path`` must exist on every executor.
    """
    def work(part: pa.RecordBatch) -> dict:
        ids, differing = codec(model_path, threads).encode([t or "" for t in part["text"].to_pylist()])
        values = np.frombuffer(b"".join(ids), dtype="<i4")
        ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
        return {"doc_id": part["doc_id"], "ids": pa.ListArray.from_arrays(ends, values).cast(kind),
                "n_differing": differing}

    schema = "doc_id long, ids array<int>, n_differing long"
    kind = arrow_schema(schema).field("ids").type
    return map_text(id_and_text(docs, id_col, text_col), work, schema, PART_BYTES)


def decode(encoded: DataFrame, model_path: str, threads: int = 2) -> DataFrame:
    """(doc_id, text) of the ids of every row; null ids are an empty text."""
    schema = "doc_id long, text string"
    arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            ids = [np.array(x or [], dtype="<u4").tobytes() for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(codec(model_path, threads).decode(ids), pa.string())],
                schema=arrow)

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def round_trip(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", threads: int = 2
) -> DataFrame:
    """Encodes and decodes every whole text in one pass over it, and reports both.

    n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers), decoded_sha256
    (lowercase hex, UTF-8), same_text (the decoded text equals the given one; null counts as
    empty) and n_differing as in ``encode``.
    """
    def work(part: pa.RecordBatch) -> dict:
        texts, own = [t or "" for t in part["text"].to_pylist()], codec(model_path, threads)
        ids, differing = own.encode(texts)
        back = own.decode(ids)
        return {
            "doc_id": part["doc_id"], "n_tokens": [len(x) // 4 for x in ids],
            "ids_crc32": [zlib.crc32(x) for x in ids],
            "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in back],
            "same_text": [a == b for a, b in zip(texts, back, strict=True)], "n_differing": differing,
        }

    return map_text(
        id_and_text(docs, id_col, text_col), work,
        "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, same_text boolean, "
        "n_differing long", PART_BYTES)
