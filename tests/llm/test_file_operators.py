"""Token records, SentencePiece models and packaged web archives: round trips and parity."""

import base64
import gzip
import hashlib
import io
import random
import struct
import zipfile
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lodestone.llm import pieces, token_records, warc_zip
from lodestone.llm.files import open_folder

BPE = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
CLASH = "doc_id long, text string, path string, start string, ids string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], CLASH).repartition(3)


def awkward_texts(n=400):
    draw = random.Random(1)
    parts = ["a", " ", "\n", "\t", "é", "1", "'s", "  ", "<|endoftext|>", "\x1c", ".", "▁", "<s>", "日", " the",
             "\x00", " ", "Stadt", "Straße,"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 30))) for _ in range(n)]
    return texts + ["", " ", "a ", "  a", "word " * 30_000, "x" * 50_000]


def slow_masked(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    crc ^= 0xFFFFFFFF
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def test_checksums_match_the_definition():
    draw = random.Random(2)
    datas = [draw.randbytes(n) for n in (4, 8, 5, 127, 128, 129, 1000, 2, 0, 1, 3)]
    assert token_records.masked_checksums(datas).tolist() == [slow_masked(d) for d in datas]
    assert slow_masked(b"123456789") == ((0xE3069283 >> 15 | 0xE3069283 << 17) + 0xA282EAD8) & 0xFFFFFFFF


def test_damaged_records_are_refused():
    records = token_records.frame([b"abcd", b"efghij"])
    assert token_records.unframe(records) == [b"abcd", b"efghij"]
    for at in (0, 9, 13, len(records[0]) - 1):
        bad = bytearray(records[0])
        bad[at] ^= 1
        with pytest.raises(ValueError):
            token_records.unframe([bytes(bad), records[1]])


def test_token_records_round_trip(spark):
    rows = [(7 * i % 1009, t) for i, t in enumerate(awkward_texts())] + [(None, "no id"), (5000, None), (5000, "x")]
    index = token_records.write(frame(spark, rows), BPE, file_bytes=4096)
    got = sorted(token_records.read(index).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(ids) == len(rows)
    tokenizer = Tokenizer.from_file(BPE)
    want = {}
    for i, t in rows:
        coded = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want.setdefault(i, []).append((len(coded), zlib.crc32(np.array(coded, "<u4").tobytes())))
    total = 0
    for r in got:
        assert r["start"] == total
        total += r["n_tokens"]
        want[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
    assert not any(want.values())
    shuffled = index.where("n_tokens > 3").orderBy("n_tokens", ascending=False)
    kept = {(r["start"], r["ids_crc32"]) for r in got if r["n_tokens"] > 3}
    assert {(r["start"], r["ids_crc32"]) for r in token_records.read(shuffled).collect()} == kept


def test_a_stock_reader_finds_the_records(spark):
    index = token_records.write(frame(spark, [(2, "two words"), (1, "one")]), BPE)
    row = index.where("doc_id = 2").first()
    filesystem, path = open_folder(row["path"])
    data = filesystem.open_input_file(path).read()
    (length,) = struct.unpack_from("<Q", data, row["offset"])
    assert length == row["n_tokens"] * row["width"]
    assert struct.unpack_from("<I", data, row["offset"] + 8)[0] == slow_masked(struct.pack("<Q", length))


def test_pieces_equal_the_reference():
    reference = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = awkward_texts(1500)
    own = pieces.Codec(MODEL, 2)
    ids, differing = own.encode(texts)
    want = reference.encode(texts)
    assert own.by_words and not own.differing and not any(differing)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == want
    assert own.decode(ids) == reference.decode(want)
    assert [own.tokenizer.decode(w, skip_special_tokens=False) for w in want[:50]] == reference.decode(want[:50])


def field(number, value):
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    if isinstance(value, int):
        key = number << 3
        return (bytes([key]) if key < 128 else bytes([key & 127 | 128, key >> 7])) + bytes([value])
    size = len(value)
    return bytes([number << 3 | 2]) + (bytes([size]) if size < 128 else bytes([size & 127 | 128, size >> 7])) + value


def small_unigram(squeeze):
    names = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    names += [(f"<0x{b:02X}>", -20.0, 6) for b in range(256)]
    names += [(p, -float(s), 1) for p, s in [
        ("▁", 4), ("a", 5), ("b", 5), ("c", 6), ("ab", 6.5), ("▁ab", 7), ("bc", 6), ("abc", 9.5), ("▁a", 7.5)]]
    model = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in names)
    model += field(2, field(3, 1) + field(35, 1))
    return model + field(3, field(1, b"identity") + field(3, 1) + field(4, int(squeeze)) + field(5, 1))


def test_unigram_scores_are_rebuilt(tmp_path):
    draw = random.Random(3)
    for squeeze in (False, True):
        path = str(tmp_path / f"small{squeeze}.model")
        with open(path, "wb") as file:
            file.write(small_unigram(squeeze))
        reference = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = ["".join(draw.choices(["a", "b", "c", " ", "abc", "é"], k=draw.randint(0, 20))) for _ in range(300)]
        own = pieces.Codec(path, 1)
        assert own.model["kind"] == pieces.UNIGRAM and own.by_words != squeeze
        ids, _ = own.encode(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in ids] == reference.encode(texts)
        assert len(own.differing) < 5


def test_pieces_over_a_table(spark):
    rows = [(i, t) for i, t in enumerate(awkward_texts(60))] + [(None, "no id"), (3, None), (3, "again")]
    docs = frame(spark, rows)
    reference = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = sorted((str(i), reference.encode(t or "")) for i, t in rows)
    encoded = pieces.encode(docs, MODEL)
    assert sorted((str(r[0]), list(r[1])) for r in encoded.collect()) == want
    back = sorted((str(r[0]), r[1]) for r in pieces.decode(encoded, MODEL).collect())
    assert back == sorted((str(i), reference.decode(reference.encode(t or ""))) for i, t in rows)
    tripped = pieces.round_trip(docs, MODEL).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in tripped) == sorted(
        (i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want)
    assert all(r["same_text"] for r in tripped if "▁" not in (dict(rows[:-3]).get(r["doc_id"]) or ""))


PAGES = "page_id long, url string, html string, digest string, id string, first string"


def page_rows():
    rows = [(i, f"http://x/{i}", f"<p>{i % 5}</p>" * (i % 4)) for i in range(40)]
    return rows + [(100, "http://x/\r\nevil: 1", "ü" * 200_000), (101, None, None), (102, "u", ""),
                   (None, "n", "<p>1</p>"), (None, "n", "alone"), (7, "http://x/7", rows[7][2])]


def test_archives_round_trip(spark):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, "d", "i", "f") for r in rows], PAGES).repartition(3)
    for least in (0, 1):
        manifest = warc_zip.write(pages, least_bytes=least, package_bytes=2000)
        assert manifest.count() > 3
        got = warc_zip.read(manifest, with_payload=True).collect()
        first = {}
        for i, _, h in rows:
            if i is not None:
                first[h or ""] = min(first.get(h or "", i), i)
        want, seen = [], set()
        for i, _, h in rows:
            body = (h or "").encode()
            refers = first.get(h or "") if len(body) >= least else None
            if refers == i and (i, h) not in seen:
                refers = None
            seen.add((i, h))
            want.append((str(i), len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                         "response" if refers is None else "revisit", str(refers),
                         body if refers is None else b""))
        assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"],
                       str(r["refers_to"]), bytes(r["payload"])) for r in got) == sorted(want)


def test_repeated_rows_in_different_partitions(spark, tmp_path):
    one = spark.createDataFrame([(1, "u", "<p>one</p>"), (2, "u", "<p>two</p>")],
                                "page_id long, url string, html string").coalesce(1)
    for _ in range(6):
        one.write.mode("append").parquet(str(tmp_path / "pages"))
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # a task for every file
    try:
        pages = spark.read.parquet(str(tmp_path / "pages"))
        assert pages.rdd.getNumPartitions() == 6
        got = warc_zip.read(warc_zip.write(pages)).collect()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)
    kinds = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["refers_to"] is not None)
    assert kinds == [(i, "revisit", i) for i in (1, 2) for _ in range(5)]
    assert sorted(r["page_id"] for r in got if r["record_type"] == "response") == [1, 2]


def test_packages_open_with_other_tools(spark):
    pages = spark.createDataFrame([(*r, "d", "i", "f") for r in page_rows()], PAGES)
    path = warc_zip.write(pages).first()["path"]
    filesystem, at = open_folder(path)
    with zipfile.ZipFile(io.BytesIO(filesystem.open_input_file(at).read())) as archive:
        assert archive.testzip() is None
        assert all(x.compress_type == zipfile.ZIP_STORED for x in archive.infolist())
        assert gzip.decompress(archive.read(warc_zip.ARCHIVE)).startswith(b"WARC/1.1\r\n")


def test_reader_takes_both_kinds_of_directory():
    members = [("a.bin", b"12345"), ("b/c.bin", b"")]
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as archive:
        for name, data in members:
            archive.writestr(name, data)
        archive.comment = b"a comment PK"
    for data in (b"".join(warc_zip.package(members)), b"".join(warc_zip.package(members, zip64=False)),
                 made.getvalue()):
        reader = warc_zip.PackageReader(io.BytesIO(data), len(data))
        assert reader.read("a.bin") == b"12345" and reader.read("a.bin", 1, 3) == b"234"
        assert reader.read("b/c.bin") == b""
        with pytest.raises(ValueError):
            reader.read("a.bin", 3, 3)
    with pytest.raises(ValueError):
        warc_zip.PackageReader(io.BytesIO(b"no zip"), 6)


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert token_records.read(token_records.write(nothing, BPE)).count() == 0
    assert pieces.encode(nothing, MODEL).count() == 0 and pieces.round_trip(nothing, MODEL).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc_zip.read(warc_zip.write(pages)).count() == 0


def test_new_words_go_to_the_libraries_in_bounded_batches(monkeypatch):
    seen = []

    class Spy:
        def __init__(self, real):
            self.real = real

        def encode_batch_fast(self, words, **options):
            seen.append(len(words))
            return self.real.encode_batch_fast(words, **options)

    path = public_tokenizers.path("piece_bpe_32k.model")
    text = " ".join(f"word{i}" for i in range(100))
    whole = pieces.Codec(path, 1).encode([text, "", "word7  word8"])
    monkeypatch.setattr(pieces, "WORDS_AT_ONCE", 7)
    one = pieces.Codec(path, 1)
    one.tokenizer = Spy(one.tokenizer)
    assert one.encode([text, "", "word7  word8"]) == whole
    assert max(seen) == 7 and sum(seen) >= 100


def test_words_that_run_together_are_told_from_those_that_do_not():
    words = [" a", " a b", " a  b", " a ", "  a", " ", "a", " a\nb", " a \nb", "  a", " a.", " 一 c", " a\n"]
    want = [
        w for w in words
        if w[0] == " " and w[1:2].strip() and (" " not in w[1:] or not token_records._UNSAFE.search(w))]
    assert [w for w in words if token_records._SAFE_WORD.match(w)] == want
