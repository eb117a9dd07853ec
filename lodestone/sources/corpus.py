"""Markdown corpus: scan, front matter, validation, chunking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.functions.text import strip, token_estimate

_BLOCK = r"(?s)\A---\n(.*?)\n---\n"
_FIELD = r"^([a-z_]+):\s*(.*)$"
_LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


class CorpusError(ValueError):
    """The corpus holds a malformed or ambiguous document."""


def scan_markdown(spark: SparkSession, root: str) -> DataFrame:
    """``(source, source_uri, text)`` of every markdown file below ``root``.

    One row per file; files are listed and read by the executors' scan. The page
    that lists what the corpus leaves out is never indexed.
    """
    files = spark.read.text(
        root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md"
    )
    path = F.col("_metadata.file_path")
    return files.select(
        F.col("_metadata.file_name").alias("source"),
        F.concat(F.lit("corpus/"), F.regexp_extract(path, r"([^/]+/[^/]+)$", 1)).alias("source_uri"),
        F.col("value").alias("text"),
    ).filter(F.col("source") != C.UNINDEXED_FILE)


def parse_front_matter(raw: DataFrame) -> DataFrame:
    """Add ``id, kind, title, body`` and ``problem``, null where the file is sound."""
    block = F.regexp_extract("text", _BLOCK, 1)
    lines = F.filter(F.split(block, _LINE_END), lambda line: strip(line) != "")
    pairs = F.transform(
        lines,
        lambda line: F.struct(
            F.regexp_extract(line, _FIELD, 1).alias("k"),
            F.regexp_replace(strip(F.regexp_extract(line, _FIELD, 2)), '^"+|"+$', "").alias("v"),
        ),
    )

    def field(name: str) -> Column:
        # a repeated key keeps its last value
        return F.try_element_at(F.filter("_pairs", lambda p: p["k"] == name), F.lit(-1))["v"]

    parsed = raw.withColumn("_lines", lines).withColumn("_pairs", pairs).select(
        *raw.columns,
        *[field(name).alias(name) for name in C.REQUIRED_FIELDS],
        strip(F.regexp_replace("text", _BLOCK, "")).alias("body"),
        F.size(F.filter("_lines", lambda line: ~line.rlike(_FIELD))).alias("_bad_lines"),
    )

    def missing(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) == ""

    problem = F.when(~F.col("text").rlike(_BLOCK), "missing front matter block").when(
        F.col("_bad_lines") > 0, "front matter line is not key: value"
    )
    for name in C.REQUIRED_FIELDS:
        problem = problem.when(missing(name), f"front matter is missing {name}")
    problem = problem.when(~F.col("kind").isin(*C.DOCUMENT_KINDS), "unknown kind").when(
        F.col("body") == "", "front matter but no body"
    )
    return parsed.withColumn("problem", problem).drop("_bad_lines")


def rejects(parsed: DataFrame) -> DataFrame:
    """``(source, problem)`` of every file that cannot be loaded, duplicates included."""
    sound = parsed.filter("problem IS NULL")
    twice = sound.groupBy("id").count().filter("count > 1").select("id")
    duplicated = sound.join(twice, "id", "left_semi").select(
        "source", F.lit("duplicate document id").alias("problem")
    )
    return parsed.filter("problem IS NOT NULL").select("source", "problem").unionByName(duplicated)


def load_corpus(spark: SparkSession, root: str) -> DataFrame:
    """``(id, kind, title, source_uri, body)``; any reject is an error."""
    parsed = parse_front_matter(scan_markdown(spark, root))
    first = rejects(parsed).orderBy("source", "problem").limit(5).collect()
    if first:
        raise CorpusError("; ".join(f"{r['source']}: {r['problem']}" for r in first))
    return parsed.select("id", "kind", "title", "source_uri", "body")


def chunk_documents(docs: DataFrame, key: str = "id", body: str = "body") -> DataFrame:
    """``(chunk_id, document_id, ordinal, heading, body, token_count)``.

    A section begins at each line that starts with ``#``. A block shorter than
    the minimum joins the block before it, which keeps its own heading. All of it
    happens inside the row of the document, so nothing is shuffled.
    """
    text = F.regexp_replace(F.col(body), _LINE_END, "\n")
    sections = F.split(text, r"\n(?=#)")
    headed = F.transform(
        sections,
        lambda s: F.struct(
            F.when(
                s.startswith("#"),
                strip(F.regexp_replace(F.regexp_extract(s, r"^([^\n]*)", 1), "^#+", "")),
            ).alias("heading"),
            strip(F.when(s.startswith("#"), F.regexp_extract(s, r"(?s)^[^\n]*(.*)$", 1)).otherwise(s))
            .alias("text"),
        ),
    )
    blocks = F.transform(
        F.filter(headed, lambda s: s["heading"].isNotNull() | (s["text"] != "")),
        lambda s: F.struct(
            s["heading"].alias("heading"),
            F.when(
                F.coalesce(s["heading"], F.lit("")) != "",
                strip(F.concat(s["heading"], F.lit("\n\n"), s["text"])),
            )
            .otherwise(s["text"])
            .alias("block"),
        ),
    )
    empty = F.array().cast("array<struct<heading:string,block:string>>")

    def merge(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(
            last["heading"].alias("heading"),
            F.concat(last["block"], F.lit("\n\n"), s["block"]).alias("block"),
        )
        is_short = (F.size(done) > 0) & (F.length(s["block"]) < C.MIN_CHUNK_CHARS)
        return F.when(
            is_short, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))
        ).otherwise(F.concat(done, F.array(s)))

    merged = docs.select(F.col(key).alias("document_id"), blocks.alias("_blocks")).select(
        "document_id", F.posexplode(F.aggregate("_blocks", empty, merge)).alias("ordinal", "_b")
    )
    return merged.filter("_b.block <> ''").select(
        F.format_string("%s#%02d", F.col("document_id").cast("string"), "ordinal").alias("chunk_id"),
        "document_id",
        "ordinal",
        F.col("_b.heading").alias("heading"),
        F.col("_b.block").alias("body"),
        token_estimate(F.col("_b.block")).alias("token_count"),
    )
