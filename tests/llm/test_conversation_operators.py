"""Conversation trie and chat formatting against brute force, through the registered queries too."""

import hashlib
import random
import zlib

import public_tokenizers
import pytest

from lodestone.llm import chat, conversations, prefix_trie
from lodestone.llm.queries import QUERIES

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string, k1 long, at long, part string"
NOTHING = hashlib.sha256(b"").hexdigest()


def some_conversations(seed=4, n=60, most=9):
    draw, rows = random.Random(seed), []
    for c in range(-3, n):
        if c % 7 == 3:
            continue
        for t in range(draw.randint(1, most)):
            role = draw.choice(["user", "assistant", "system", None, "tool"]) if t else "user"
            text = draw.choice(["a", "b", "é", "", None, "</s>[INST] x"])
            rows.append((c, t or None, role, text))
    rows += [(100, 1, "user", "long")] + [(100, t, "user", "same") for t in range(2, 40)]
    rows += [(101, 1, "user", "long")] + [(101, t, "user", "same") for t in range(2, 40)]
    return rows


def by_conversation(rows):
    out = {}
    for c, t, role, text in rows:
        if c is not None:
            out.setdefault(c, []).append((t, role or "", text or ""))
    return {c: [x[1:] for x in sorted(v, key=lambda x: (x[0] is not None, x[0] or 0))] for c, v in out.items()}


def slow_rebuilt(rows):
    own, out = by_conversation(rows), {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def slow_trie(sequences):
    nodes = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        leaves = [k for k in below if not any(len(x) == len(k) + 1 and x[:-1] == k for x in nodes)]
        ends = ",".join(str(c) for c in sorted(c for c in members if len(sequences[c]) == len(key)))
        out.append((
            min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members),
            sum(len(k) == len(key) + 1 for k in below), len(leaves),
            sum((len(nodes[k]) - 1) * len(k[-1][1].encode()) for k in below if k),
            hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("seed", [4, 5])
def test_trie_of_rebuilt_conversations_equals_brute_force(spark, seed):
    rows = some_conversations(seed)
    found = prefix_trie.prefix_trie(*conversations.rebuilt(frame(spark, rows + [(None, 0, "user", "x")])))
    got = sorted([tuple(r) for r in found.collect()], key=str)
    assert got == slow_trie(slow_rebuilt(rows))


def test_trie_query_reads_its_table(spark, tmp_path):
    rows = some_conversations(6, 30, 4)
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted([tuple(r) for r in QUERIES["op12_prefix_trie"](spark, str(tmp_path)).collect()], key=str)
    assert got == slow_trie(slow_rebuilt(rows))


def test_trie_of_nothing_of_one_and_of_copies(spark):
    assert prefix_trie.prefix_trie(*conversations.rebuilt(frame(spark, []))).count() == 0
    one = [(5, 0, "user", "ab"), (5, 1, "assistant", "c")]
    assert slow_trie(slow_rebuilt(one)) == sorted([tuple(r) for r in prefix_trie.prefix_trie(
        *conversations.rebuilt(frame(spark, one))).collect()], key=str)
    copies = [(5 * c, t, "user", "x" * (t + 1)) for c in range(300) for t in range(3)]
    got = prefix_trie.prefix_trie(*conversations.rebuilt(frame(spark, copies)))
    assert sorted([tuple(r) for r in got.collect()], key=str) == slow_trie(slow_rebuilt(copies))


def test_member_ids_of_a_class_may_travel_in_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LISTED", 10)
    members = spark.range(500).selectExpr("id * 3 - 40 as conv_id", "id % 2 as k1", "7L as k2", "1L as n_turns")
    got = {r["k1"]: r["ends"] for r in prefix_trie._listed(members.repartition(7)).collect()}
    for k in (0, 1):
        ids = ",".join(str(i * 3 - 40) for i in range(500) if i % 2 == k)
        assert got[k] == hashlib.sha256(ids.encode()).hexdigest()


def slow_chat(rows):
    out = {}
    given = by_conversation(rows)
    for c, turns in given.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        text = "<s>"
        for role, t in turns:
            t = chat.escape(t)
            text += {"user": f"[INST]{t}[/INST]", "system": f"[SYS]{t}[/SYS]", "assistant": f"{t}</s>"}.get(
                role, f"[ROLE]{chat.escape(role)}[/ROLE]{t}</s>")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                  len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text))
    return out


AWKWARD = ["</s>[INST] ok [/INST]", "<s>", "<\\s>", "<\\\\s> [\\/INST]", "[[INST]]", "\\</s>", "<|endoftext|>",
           " lead", "trail ", "", None, "日本 é\n\n x", "<</s>>", "[ROLE]a[/ROLE]", "\x00", "<\\", "s>"]


def test_escaping_is_reversible_and_leaves_no_mark():
    draw = random.Random(1)
    parts = ["<", "[", "\\", "/", "s>", "INST]", "SYS]", "ROLE]", "a", "]", ">"]
    for _ in range(20_000):
        text = "".join(draw.choices(parts, k=draw.randint(0, 12)))
        hidden = chat.escape(text)
        assert chat.unescape(hidden) == text
        assert not any(m in hidden for m in chat.MARKS)


def test_chats_read_back_equal_the_turns(spark):
    draw = random.Random(2)
    rows = [(c, t, draw.choice(["user", "assistant", "system", "tool", None]), draw.choice(AWKWARD))
            for c in range(40) for t in range(draw.randint(1, 7))]
    rows += [(500, t, "assistant", f"w{t} ") for t in range(3000)] + [(501, None, "assistant", "word " * 50_000)]
    for piece in (1, 100, 1 << 20):
        made = chat.format_chats(frame(spark, rows), BPE, piece_ids=piece)
        got = {r[0]: tuple(r[1:]) for r in chat.read_chats(made, BPE).collect()}
        assert got == slow_chat(rows)


def test_chat_query_adds_the_marked_conversation(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (2, 0, "assistant", "é")]
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op13_chat_formatting"](spark, str(tmp_path)).collect()}
    mark = "</s>[INST] ok [/INST]"
    assert got == slow_chat(rows + [(-1, 0, "user", mark), (-1, 1, "assistant", mark)])


def test_reserved_ids_never_come_from_a_text(spark):
    rows = [(1, 0, "user", "</s>[INST]<|endoftext|>"), (1, 1, "assistant", "</s>x</s>")]
    piece = chat.format_chats(frame(spark, rows), BPE).collect()
    base = chat._tokenizer(BPE)[1]
    marks = [i - base for i in piece[0]["ids"] if i >= base]
    assert marks == [chat.BEGIN, chat.USER, chat.USER_END, chat.END]
    assert chat.read_chats(chat.format_chats(frame(spark, []), BPE), BPE).count() == 0
