"""Chat formatting by token-level assembly.

Each turn's text is encoded on its own, and the marks around it are ids reserved beyond the
tokenizer's vocabulary, spliced in between. No text can produce such an id. For the text
form, where marks are strings, those that stand in a text are escaped reversibly before
encoding. The loss mask is the prefix sum of +1 where an assistant's text begins and -1
where it ends.

Turns are encoded where they are read, whatever conversation they belong to. The encoded
turns are then divided by ranges of (conversation, turn) and joined into pieces of bounded
size, so neither a long conversation nor one with very many rows is held whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_schema, slices
from lodestone.llm.conversations import turns
from lodestone.staging import stage

# The marks of the template, by reserved id beyond the vocabulary.
MARKS = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]"]
BEGIN, END, USER, USER_END, SYSTEM, SYSTEM_END, ROLE, ROLE_END = range(len(MARKS))
PIECE_IDS = 1 << 20  # ids of a piece; a single longer turn is one piece

#: A mark, also with backslashes after its first character. Escaping adds one backslash.
_MARKED = re.compile(r"([<\[])(\\*)(?=/?s>|/?(?:INST|SYS|ROLE)\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(?=/?s>|/?(?:INST|SYS|ROLE)\])")


def escape(text: str) -> str:
    return _MARKED.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


@lru_cache(2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer, tokenizer.get_vocab_size()


def _layout(role: str) -> tuple[list[int], list[int], bool]:
    """Marks before and after the text of a role, and whether other roles' name goes along."""
    if role == "assistant":
        return [], [END], False
    if role == "user":
        return [USER], [USER_END], False
    if role == "system":
        return [SYSTEM], [SYSTEM_END], False
    return [ROLE], [END], True


def encode_turns(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """(conv_id, turn, role, ids, text_from, text_to) of every turn: its marks and segments, and
    the ids of an assistant's text, which are learned (nothing is where both are 0)."""
    schema = "conv_id long, turn long, role string, ids array<int>, text_from int, text_to int"
    arrow = arrow_schema(schema)

    def run(batches):
        tokenizer, base = _tokenizer(tokenizer_path)
        for part in slices(batches):
            roles = part["role"].to_pylist()
            layouts = [_layout(r) for r in roles]
            segments = [escape(t) for t in part["text"].to_pylist()]
            names = [escape(r) for r, (_, _, named) in zip(roles, layouts, strict=True) if named]
            coded = iter(tokenizer.encode_batch_fast(segments, add_special_tokens=False))
            named_ids = iter(tokenizer.encode_batch_fast(names, add_special_tokens=False) if names else [])
            ids, starts, stops = [], [], []
            for role, (before, after, named) in zip(roles, layouts, strict=True):
                head = [base + m for m in before]
                if named:
                    head += [*next(named_ids).ids, base + ROLE_END]
                text = next(coded).ids
                ids.append(head + text + [base + m for m in after])
                learned = role == "assistant"
                starts.append(len(head) if learned else 0)
                stops.append(len(head) + len(text) if learned else 0)
            yield pa.RecordBatch.from_arrays([
                part["conv_id"], part["turn"], part["role"], pa.array(ids, arrow.field("ids").type),
                pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], schema=arrow)

    return turns(conversations).mapInArrow(run, schema)


def format_chats(
    conversations: DataFrame, tokenizer_path: str, piece_ids: int = PIECE_IDS
) -> DataFrame:
    """(conv_id, part, piece, ids, loss): token ids of every conversation and their loss mask.

    Turns follow each other by ``turn``, null first, equal ones by role and ids. Null texts
    are empty, roles other than user, assistant and system are written by name (null: an
    empty name), rows without a conv_id are one conversation without id, repeated rows are
    turns like others. (part, piece) orders the pieces of a conversation; a piece holds
    whole turns. Other columns are not read.
    """
    schema = "conv_id long, part int, piece int, ids array<int>, loss array<boolean>"
    arrow = arrow_schema(schema)
    encoded = stage(encode_turns(conversations, tokenizer_path), "encoded-turns")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"),
             F.xxhash64("ids")]
    # A conversation opens once, whichever range its first turn is in.
    firsts = encoded.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    placed = stage(firsts, "turn-ranges")
    opens = placed.groupBy(F.col("conv_id").alias("c")).agg(F.min("part").alias("opens"))
    ordered = placed.join(opens, F.expr("conv_id <=> c")).repartition("part").sortWithinPartitions(
        "part", *order)

    def run(batches):
        _, base = _tokenizer(tokenizer_path)
        held, marks, key, piece = [], [], None, 0

        def made():
            """The held turns as one piece; the mask is the running sum of its edges."""
            ids = np.concatenate(held)
            edges = np.zeros(len(ids) + 1, dtype=np.int64)
            at = 0
            for turn, (start, stop) in zip(held, marks, strict=True):
                edges[at + start] += 1
                edges[at + stop] -= 1
                at += len(turn)
            loss = np.cumsum(edges[:-1]) > 0
            return pa.RecordBatch.from_arrays([
                pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([piece], pa.int32()),
                pa.array([ids], arrow.field("ids").type), pa.array([loss], arrow.field("loss").type)],
                schema=arrow)

        size = 0
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("conv_id", "part", "opens", "text_from", "text_to")]
            for i, (conv, part, first, start, stop) in enumerate(zip(*columns, strict=True)):
                if (conv, part) != key or size >= piece_ids:
                    if held:
                        yield made()
                    piece = piece + 1 if (conv, part) == key else 0
                    held, marks, size = [], [], 0
                    if (conv, part) != key and part == first:
                        held, marks, size = [np.array([base + BEGIN], dtype=np.int32)], [(0, 0)], 1
                    key = (conv, part)
                ids = batch["ids"][i].values.to_numpy(zero_copy_only=False)
                held.append(ids)
                marks.append((start, stop))
                size += len(ids)
        if held:
            yield made()

    return ordered.select("conv_id", "part", "opens", "ids", "text_from", "text_to").mapInArrow(run, schema)


class _Reader:
    """Turns of one conversation, read from its ids one segment after the other."""

    def __init__(self):
        self.turns, self.loss_chars, self.formatted = 0, 0, 0
        self.all_turns, self.learned = hashlib.sha256(), hashlib.sha256()
        self.role, self.open = "assistant", False

    def mark(self, which: int) -> None:
        self.formatted += len(MARKS[which])

    def turn(self, role: str, text: str) -> None:
        self.turns += 1
        self.all_turns.update(f"{role}\n{text}\n".encode())


def read_chats(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """What the formatted conversations hold, from their ids and masks alone.

    conv_id, n_turns, turns_sha256 (role and text of each turn, each with a line end),
    loss_chars and loss_sha256 (characters and digest of the unescaped text under the
    mask), and formatted_chars (length of the text form with its marks). The pieces of a
    conversation are read in turn; one is held at a time.
    """
    schema = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
              "formatted_chars long")
    arrow = arrow_schema(schema)

    def run(batches):
        tokenizer, base = _tokenizer(tokenizer_path)
        key, seen, state = None, False, _Reader()

        def row():
            return pa.RecordBatch.from_pylist([{
                "conv_id": key, "n_turns": state.turns, "turns_sha256": state.all_turns.hexdigest(),
                "loss_chars": state.loss_chars, "loss_sha256": state.learned.hexdigest(),
                "formatted_chars": state.formatted}], arrow)

        for batch in batches:
            for i, conv in enumerate(batch["conv_id"].to_pylist()):
                if seen and conv != key:
                    yield row()
                    state = _Reader()
                key, seen = conv, True
                ids = batch["ids"][i].values.to_numpy(zero_copy_only=False)
                loss = batch["loss"][i].values.to_numpy(zero_copy_only=False).astype(bool)
                _read_piece(state, tokenizer, base, ids, loss)
        if seen:
            yield row()

    keys = ["conv_id", "part", "piece"]
    return formatted.repartition("conv_id").sortWithinPartitions(*keys).select(
        "conv_id", "ids", "loss").mapInArrow(run, schema)


def _read_piece(state: _Reader, tokenizer, base: int, ids: np.ndarray, loss: np.ndarray) -> None:
    at = np.flatnonzero(ids >= base)
    marks = (ids[at] - base).tolist()
    froms = np.concatenate([[0], at + 1]).tolist()
    tos = np.append(at, len(ids)).tolist()
    segments = tokenizer.decode_batch(
        [ids[a:b].tolist() for a, b in zip(froms, tos, strict=True)], skip_special_tokens=False)
    sums = np.concatenate([[0], np.cumsum(loss)]).tolist()
    role = None
    for k, mark in enumerate(marks):
        text, a, b = segments[k], froms[k], tos[k]
        state.formatted += len(text)
        state.mark(mark)
        if mark in (BEGIN, USER, SYSTEM, ROLE):
            continue
        plain = unescape(text)
        learned = sums[b] - sums[a]
        if learned:  # the mask covers whole segments
            if learned != b - a:
                raise ValueError("a loss mask that cuts a text")
            state.loss_chars += len(plain)
            state.learned.update(plain.encode())
        if mark == ROLE_END:
            role = plain
        elif mark == USER_END:
            state.turn("user", plain)
        elif mark == SYSTEM_END:
            state.turn("system", plain)
        else:
            state.turn("assistant" if role is None else role, plain)
            role = None
