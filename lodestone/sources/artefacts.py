"""Line-oriented artefacts: markdown tables, constants, event frames, JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def markdown_rows(lines: DataFrame, id_pattern: str = r"[A-Z]{1,4}-\d+", column: str = "value") -> DataFrame:
    """Table rows whose first cell is an identifier, with trimmed ``cells``."""
    rows = lines.filter(F.col(column).rlike(rf"^\|\s*{id_pattern}\s*\|"))
    cells = F.transform(F.split(column, r"\|"), lambda c: F.trim(c))
    return rows.withColumn("cells", F.slice(cells, F.lit(2), F.size(cells) - 2))


def plain_cell(cell: Column) -> Column:
    """A cell without emphasis marks."""
    return F.regexp_replace(cell, r"\*", "")


def number_constants(lines: DataFrame, column: str = "value") -> DataFrame:
    """``(name, number)`` of lines of the form ``NAME = number``, comments skipped."""
    name = F.trim(F.regexp_extract(column, r"^([^=]*)=", 1))
    number = F.regexp_extract(column, r"=\s*([-+]?\d+\.?\d*(?:[eE][-+]?\d+)?)", 1)
    return lines.filter(~F.col(column).rlike(r"^\s*#")).select(
        name.alias("name"), F.nullif(number, F.lit("")).cast("double").alias("number")
    ).filter(F.col("name").rlike(r"^\w+$") & F.col("number").isNotNull())


def json_artefact(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def encode_event(kind: Column, data: Column) -> Column:
    """One server-sent event frame, ended by a blank line."""
    return F.concat(F.lit("event: "), kind, F.lit("\ndata: "), data, F.lit("\n\n"))


def decode_events(buffers: DataFrame, column: str, schema: str) -> DataFrame:
    """Complete frames of each buffer as ``(position, kind, data)``, and the ``tail``.

    The text after the last blank line is a partial frame and is handed back.
    Frames without a kind or payload, and payloads that are not JSON, are dropped.
    """
    parts = F.split(column, "\n\n")
    framed = buffers.withColumn("tail", F.element_at(parts, -1)).withColumn(
        "_frames", F.slice(parts, F.lit(1), F.size(parts) - 1)
    )
    rows = framed.select(
        *buffers.columns, "tail", F.posexplode("_frames").alias("position", "_frame")
    )
    lines = F.split("_frame", "\n")
    kind = F.trim(
        F.regexp_replace(
            F.coalesce(
                F.try_element_at(F.filter(lines, lambda x: x.startswith("event: ")), F.lit(-1)),
                F.lit(""),
            ), "^event: ", "",
        )
    )
    payload = F.array_join(
        F.transform(
            F.filter(lines, lambda x: x.startswith("data: ")),
            lambda x: F.regexp_replace(x, "^data: ", ""),
        ), "",
    )
    parsed = rows.withColumn("kind", kind).withColumn("_payload", payload)
    kept = parsed.filter((F.col("kind") != "") & (F.col("_payload") != ""))
    # JSON that does not parse gives null here, unlike a struct of nulls.
    valid = kept.filter(F.expr("try_parse_json(_payload)").isNotNull())
    return valid.withColumn("data", F.from_json("_payload", schema)).drop("_frame", "_payload")
