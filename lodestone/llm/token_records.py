"""Token ids in length-delimited binary records with a separate offset index.

A record is the length of its data (8 bytes), a masked CRC-32C of these bytes, the data
(ids as little-endian 16- or 32-bit numbers) and a masked CRC-32C of the data. The index
is a table of its own: document, file, offset, ids and place in the whole sequence, so any
record can be read in any order without scanning the files.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_schema, hand_back, id_and_text, slices
from lodestone.llm.files import attempt_name, open_folder
from lodestone.llm.words import WordMemory
from lodestone.staging import new_path, stage

_POLYNOMIAL, _MASK = 0x82F63B78, 0xA282EAD8  # fixed values of the record format
_BLOCK = 128  # bytes whose checksums are computed side by side
_FRAME = 16  # bytes around the data of a record


def _step(state: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[state & 0xFF] ^ (state >> 8)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Table for two bytes at once, and four tables that move a state over a block of zeros."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1)
    pair = _step(_step(np.arange(1 << 16, dtype=np.uint32), table), table)
    moves = []
    for k in range(4):
        state = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(_BLOCK):
            state = _step(state, table)
        moves.append(state)
    return pair, moves


def masked_checksums(datas: list[bytes]) -> np.ndarray:
    """Masked CRC-32C of each of ``datas``, which have four bytes or more, or are padded by rule."""
    pair, moves = _tables()
    sizes = np.array([len(d) for d in datas], dtype=np.int64)
    counts = np.maximum(1, -(-np.maximum(sizes, 4) // _BLOCK))
    ends = np.cumsum(counts) * _BLOCK
    flat = np.zeros(int(ends[-1]), dtype=np.uint8)
    for data, size, end in zip(datas, sizes.tolist(), ends.tolist(), strict=True):
        flat[end - size : end] = np.frombuffer(data, dtype=np.uint8)
    # A start value of all ones equals inverting the first four bytes; zeros before the data
    # change nothing.
    for k in range(4):
        at = (ends - sizes + k)[sizes > k]
        flat[at] ^= 0xFF
    words = flat.view("<u2").reshape(-1, _BLOCK // 2)
    state = np.zeros(len(words), dtype=np.uint32)
    for column in range(words.shape[1]):
        state = pair[(state ^ words[:, column]) & 0xFFFF] ^ (state >> 16)
    firsts = ends // _BLOCK - counts
    total = np.zeros(len(datas), dtype=np.uint32)
    for j in range(int(counts.max())):
        on = np.flatnonzero(counts > j)
        s = total[on]
        moved = moves[0][s & 0xFF] ^ moves[1][(s >> 8) & 0xFF] ^ moves[2][(s >> 16) & 0xFF] ^ moves[3][s >> 24]
        total[on] = moved ^ state[firsts[on] + j]
    # Data of under four bytes leave part of the start value beyond their end.
    short = np.flatnonzero(sizes < 4)
    total[short] ^= (np.uint64(0xFFFFFFFF) >> (8 * sizes[short]).astype(np.uint64)).astype(np.uint32)
    crc = ~total
    return ((crc >> 15) | (crc << 17)) + np.uint32(_MASK)


def frame(datas: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(d)) for d in datas]
    checks = masked_checksums(lengths + datas)
    head, tail = checks[: len(datas)].astype("<u4"), checks[len(datas) :].astype("<u4")
    return [
        b"".join((n, a.tobytes(), d, b.tobytes()))
        for n, a, d, b in zip(lengths, head, datas, tail, strict=True)
    ]


def unframe(records: list[bytes]) -> list[bytes]:
    """Data of whole records; raises where a length or a checksum does not fit."""
    datas = [r[12:-4] for r in records]
    if frame(datas) != records:
        raise ValueError("a record is damaged")
    return datas


#: A space that white space or the end follows starts no word of its own.
_UNSAFE = re.compile(r" (?:\s|$)")
_SAFE_CUT = re.compile(r"(?= \S)")
#: A word with the space before it, and no other space that starts no word of its own.
_SAFE_WORD = re.compile(r" (?!\s)(?:[^ ]| (?!\s|$))+\Z")


def cut_words(text: str) -> list[str]:
    """Pieces of the text, cut only before a space that a visible character follows."""
    if _UNSAFE.search(text):
        return [p for p in _SAFE_CUT.split(text) if p]
    first, *rest = text.split(" ")
    return ([first] if first else []) + [" " + w for w in rest]


#: Marks that the tokenizer keeps apart from a letter before them. The apostrophe is none.
_MARKS = ".,;:!?#$%&*|"


def word_parts(word: str) -> list[str] | None:
    """Parts of a word that the tokenizer would not join: lines, and marks after a letter."""
    if word[-1:].isalpha() and "\n" not in word:
        return None
    if "\n" in word:
        lines = word.split("\n")
        if len(lines) < 2 or not all(lines) or word.split() != [lines[0].strip(" "), *lines[1:]]:
            return None
        out = [lines[0]]
        for line in lines[1:]:
            out += ["\n", line]
        return out
    base = word.rstrip(_MARKS)
    if len(base) == len(word) or not base[-1:].isalpha():
        return None
    return [base, word[len(base) :]]


@lru_cache(2)
def _byte_bpe(path: str):
    """An encoder of whole texts, kept by the worker between tasks, and the type of its ids.

    Words are remembered where the tokenizer cuts them apart. A text that holds the string of
    a special token is encoded by the tokenizer as it stands, since that token takes it out.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    wide = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
    lengths = np.zeros(tokenizer.get_vocab_size(), dtype=np.int64)
    for piece, i in tokenizer.get_vocab().items():
        lengths[i] = len(piece)  # one character stands for one byte

    def encode(words: list[str]) -> list[bytes]:
        """Words run together in groups: each starts a piece of its own, so the ids are cut
        again where the bytes of a word end."""
        spaced = _SAFE_WORD.match
        starts_right = [w for w in words if spaced(w)]
        found = dict.fromkeys(words)
        groups = [starts_right[i : i + 512] for i in range(0, len(starts_right), 512)]
        texts = ["".join(g) for g in groups]
        for group, text, coded in zip(
                groups, texts, tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, dtype=wide)
            sizes = list(map(len, group if text.isascii() else [w.encode() for w in group]))
            ends = (np.searchsorted(np.cumsum(lengths[ids]), np.cumsum(sizes)) + 1) * wide.itemsize
            data, at = ids.tobytes(), 0
            for word, end in zip(group, ends.tolist(), strict=True):
                found[word] = data[at:end]
                at = end
        rest = [w for w, v in found.items() if v is None]
        for word, coded in zip(rest, tokenizer.encode_batch_fast(
                rest, add_special_tokens=False), strict=True):
            found[word] = np.array(coded.ids, dtype=wide).tobytes()
        return [found[w] for w in words]

    memory = WordMemory(encode, parts=word_parts)
    memory.known[""] = b""

    def encode_texts(texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        spaced, cut, whole = [], [], []
        for i, text in enumerate(texts):
            if any(s in text for s in special):
                whole.append(i)
            elif _UNSAFE.search(text):
                cut.append(i)
            else:
                spaced.append(i)
        coded = tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False) if whole else []
        for at, data in (
            (spaced, memory.join_spaced([texts[i] for i in spaced], wide, " ")),
            (cut, memory.join([cut_words(texts[i]) for i in cut])),
            (whole, [np.array(c.ids, dtype=wide).tobytes() for c in coded]),
        ):
            for i, x in zip(at, data, strict=True):
                out[i] = x
        return out

    return encode_texts, wide


def write(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = 0, file_bytes: int = 128 << 20,
) -> DataFrame:
    """Writes one record per document in ascending id order; returns the offset index.

    Index: doc_id, path, offset, n_tokens, width (bytes of an id), start (ids of all
    documents before it). Texts go whole; null counts as empty, and every record ends with
    ``end_id``. The string of a special token in a text is that token, as the library has it.
    Documents without an id come first, repeated ids are neighbours. A file is
    closed after ``file_bytes``; one document is never split. Other columns are not read.
    """
    folder = new_path(docs.sparkSession, "tokens")
    # Words that the range partitioner samples are ids only; the text moves once.
    ordered = id_and_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    schema = "doc_id long, path string, offset long, n_tokens long, width int, part int, before long"
    arrow = arrow_schema(schema)

    def run(batches):
        encode, wide = _byte_bpe(tokenizer_path)
        filesystem, root = open_folder(folder)
        filesystem.create_dir(root, recursive=True)
        part, number, before = TaskContext.get().partitionId(), 0, 0
        end = wide.type(end_id).tobytes()
        out, name, at = None, None, 0
        try:
            for piece in slices(batches):
                texts = [t or "" for t in piece["text"].to_pylist()]
                records = frame([d + end for d in encode(texts)])
                if out is None:
                    name, at = attempt_name("ids", number, ".rec"), 0
                    out, number = filesystem.open_output_stream(f"{root}/{name}"), number + 1
                offsets, counts, befores = [], [], []
                for r in records:
                    offsets.append(at)
                    counts.append((len(r) - _FRAME) // wide.itemsize)
                    befores.append(before)
                    at += len(r)
                    before += counts[-1]
                out.write(b"".join(records))
                n = len(records)
                yield pa.RecordBatch.from_arrays([
                    piece["doc_id"], pa.array([f"{folder}/{name}"] * n), pa.array(offsets, pa.int64()),
                    pa.array(counts, pa.int64()), pa.array([wide.itemsize] * n, pa.int32()),
                    pa.array([part] * n, pa.int32()), pa.array(befores, pa.int64())], schema=arrow)
                if at >= file_bytes:
                    out.close()
                    out = None
        finally:
            if out is not None:
                out.close()
            hand_back()

    index = stage(ordered.mapInArrow(run, schema), "token-index")
    # One row per writing task: a running total over as many rows as there were tasks.
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return index.join(parts, "part").withColumn("start", F.col("base") + F.col("before")).drop(
        "part", "base", "before")


def read(index: DataFrame, block_bytes: int = 8 << 20) -> DataFrame:
    """Reads the records of ``index`` back: doc_id, start, n_tokens and ids_crc32.

    The rows may come in any order and from any part of the index. Neighbours within a file
    are read together, up to ``block_bytes``; each record's checksums are verified.
    ``ids_crc32`` is that of the ids as little-endian unsigned 32-bit numbers.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for path, group in groupby(rows, key=lambda r: r["path"]):
                filesystem, at = open_folder(path)
                with filesystem.open_input_file(at) as handle:
                    for run_of in _runs(list(group), block_bytes):
                        yield _read_run(handle, run_of)

    def _read_run(handle, rows):
        sizes = [r["n_tokens"] * r["width"] + _FRAME for r in rows]
        data, records, at = handle.read_at(sum(sizes), rows[0]["offset"]), [], 0
        for size in sizes:
            records.append(data[at : at + size])
            at += size
        ids = [
            np.frombuffer(d, dtype=f"<u{r['width']}").astype("<u4")
            for d, r in zip(unframe(records), rows, strict=True)
        ]
        return pa.RecordBatch.from_arrays([
            pa.array([r["doc_id"] for r in rows], pa.int64()),
            pa.array([r["start"] for r in rows], pa.int64()),
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
        ], schema=arrow)

    return index.mapInArrow(run, schema)


def _runs(rows: list[dict], most: int) -> list[list[dict]]:
    """Rows whose records follow each other in the file, in runs of bounded size."""
    runs, held, end = [], 0, None
    for r in rows:
        size = r["n_tokens"] * r["width"] + _FRAME
        if end == r["offset"] and held + size <= most:
            runs[-1].append(r)
            held += size
        else:
            runs.append([r])
            held = size
        end = r["offset"] + size
    return runs
