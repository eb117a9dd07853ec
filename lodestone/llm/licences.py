"""Licence scan as an exact set-similarity join of text blocks with licence templates.

A block contains a template when it has at least ``ceil(threshold * size)`` of the
template's distinct words. Words are ordered by how many documents of the whole corpus
have them, rare ones first. A block that meets the threshold must share one of the first
``size - need + 1`` words of a template (prefix filter), must have ``need`` template words
(length filter), and from its first shared word on both sides must have enough words left
(positional filter). What passes is verified with the full sets, so the join is exact.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import id_and_text, map_text, raw_bytes, with_row_ids
from lodestone.staging import stage

# Phrases that stand for a licence wherever their words are consecutive.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# Published licence notices, as words.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a "
                 "copy of the license at http www apache org licenses license 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public "
              "license as published by the free software foundation either version 3"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2"),
    ("lgpl-3", "this work is licensed under the gnu lesser general public license version 3"),
    ("agpl-3", "this work is licensed under the gnu affero general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are "
              "permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 "
                 "international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 "
                 "international license"),
]

# Words are runs of letters, digits and non-ASCII characters; A-Z are lowered.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32
    for b in range(256)
)


def word_frequencies(docs: DataFrame, vocabulary: set[str]) -> DataFrame:
    """(word, documents) over every document, for the words of the templates."""
    wanted = {w.encode() for w in vocabulary}

    def work(part: pa.RecordBatch) -> dict:
        counts = Counter()
        for text in raw_bytes(part["text"]):
            counts.update(wanted.intersection(text.translate(_WORD_BYTES).split()))
        return {"word": [w.decode() for w in counts], "n": list(counts.values())}

    return map_text(docs, work, "word string, n long").groupBy("word").agg(
        F.sum("n").alias("documents")
    )


def ordered_templates(templates, frequencies: dict[str, int], threshold: float):
    """Rank of every template word, and (template, label, ranks, need) with ascending ranks."""
    words = sorted({w for _, t in templates for w in t.split()})
    words.sort(key=lambda w: (frequencies.get(w, 0), w))
    rank = {w: i for i, w in enumerate(words)}
    rows = []
    for number, (label, text) in enumerate(templates):
        ranks = sorted({rank[w] for w in text.split()})
        rows.append((number, label, ranks, math.ceil(threshold * len(ranks) - 1e-9)))
    return rank, rows


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=None, templates=None,
    threshold: float = 0.85, block_words: int = 64,
) -> DataFrame:
    """One row per document row: word count, phrase places, labels and best containment.

    A text block is ``block_words`` consecutive words of the whole text, whatever its lines,
    and at least twice the longest template. Blocks are half a block apart, so every notice
    lies whole in one of them.
    ``score`` is the best containment of a template that met the threshold, 1 where a
    phrase stands, else 0. Null and empty texts have no words and no labels; a repeated
    or null id keeps a row each; other columns are not read. The templates are a fixed
    list, so their words, ranks and frequencies are bounded by it.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    source = id_and_text(docs, id_col, text_col)
    vocabulary = {w for _, t in templates for w in t.split()}
    counted = {r["word"]: r["documents"] for r in word_frequencies(source, vocabulary).collect()}
    rank, rows = ordered_templates(templates, counted, threshold)
    byte_rank = {w.encode(): i for w, i in rank.items()}
    prefix = {r for _, _, ranks, need in rows for r in ranks[: len(ranks) - need + 1]}
    rare = frozenset(w for w, r in byte_rank.items() if r in prefix)
    found = [(label, b" " + p.encode() + b" ") for label, p in phrases]
    half = max([block_words // 2, *(len(t.split()) for _, t in templates)])

    def places(joined: bytes, phrase: bytes) -> list[int]:
        at, out, counted_to, word = joined.find(phrase), [], 0, 0
        while at >= 0:
            word += joined.count(b" ", counted_to, at)
            counted_to = at
            out.append(word)
            at = joined.find(phrase, at + 1)
        return out

    def blocks(words: list[bytes]) -> list[list[int]]:
        out = []
        if rare.isdisjoint(words):
            return out
        for at in range(0, max(1, len(words) - half), half):
            block = words[at : at + 2 * half]
            if not rare.isdisjoint(block):
                out.append(sorted({byte_rank[w] for w in block if w in byte_rank}))
        return out

    def work(part: pa.RecordBatch) -> dict:
        made: dict = {k: [] for k in (
            "n_words", "n_base", "first_word", "last_word", "base", "blocks")}
        for text in raw_bytes(part["text"]):
            words = text.translate(_WORD_BYTES).split()
            joined = b" " + b" ".join(words) + b" "
            hits = [(label, places(joined, p)) for label, p in found]
            starts = [x for _, xs in hits for x in xs]
            made["n_words"].append(len(words))
            made["n_base"].append(len(starts))
            made["first_word"].append(min(starts, default=None))
            made["last_word"].append(max(starts, default=None))
            made["base"].append(sorted({label for label, xs in hits if xs}))
            made["blocks"].append(blocks(words))
        return {"rid": part["rid"], "doc_id": part["doc_id"], **made}

    schema = (
        "rid long, doc_id long, n_words long, n_base long, first_word long, last_word long, "
        "base array<string>, blocks array<array<int>>"
    )
    seen = stage(map_text(with_row_ids(source), work, schema), "licence-blocks")

    index = spark.createDataFrame(
        [(number, label, ranks, len(ranks), need) for number, label, ranks, need in rows],
        "template int, label string, ranks array<int>, size int, need int",
    )
    heads = index.select(
        "*", F.posexplode(F.expr("slice(ranks, 1, size - need + 1)")).alias("i", "word")
    )
    block = seen.where(F.size("blocks") > 0).select(
        "rid", F.posexplode("blocks").alias("block", "words")
    )
    tokens = block.select(
        "rid", "block", "words", F.size("words").alias("m"), F.posexplode("words").alias("j", "word")
    )
    met = tokens.join(heads, "word").where("m >= need").groupBy(
        "rid", "block", "template", "label", "words", "ranks", "m", "size", "need"
    ).agg(F.min("i").alias("i"), F.min("j").alias("j"))
    passed = met.where("1 + least(size - i - 1, m - j - 1) >= need").withColumn(
        "overlap", F.size(F.array_intersect("words", "ranks"))
    ).where("overlap >= need")
    per_row = passed.groupBy("rid").agg(
        F.collect_set("label").alias("found"), F.max(F.expr("overlap / size")).alias("best")
    )
    nothing = F.array().cast("array<string>")
    return seen.drop("blocks").join(per_row, "rid", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.sort_array("base"), ",").alias("base_labels"),
        F.array_join(
            F.array_sort(F.array_union("base", F.coalesce("found", nothing))), ","
        ).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
