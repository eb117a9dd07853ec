"""Small helpers the text operators share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

#: Text handled at once inside a task; a single longer text still comes whole.
SLICE_BYTES = 8 << 20


def column(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_and_text(frame: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads; other columns, whatever their names, stay out."""
    return frame.select(
        column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text")
    )


def with_row_ids(frame: DataFrame) -> DataFrame:
    """Adds ``rid``, a number of the row. Write the result before using it twice."""
    return frame.withColumn("rid", F.monotonically_increasing_id())


def slices(
    batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about ``most`` bytes of text, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch[text]), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def map_text(
    frame: DataFrame, work: Callable[[pa.RecordBatch], dict | None], schema: str,
    most: int = SLICE_BYTES,
) -> DataFrame:
    """Runs ``work`` on slices of whole rows; it returns lists by column name."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=most):
            made = work(part)
            if made is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(made[f.name], type=f.type) for f in arrow], schema=arrow
                )
        hand_back()

    return frame.mapInArrow(run, schema)


def hand_back() -> None:
    """Gives memory that a task no longer uses back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # systems with another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_schema(schema: str | StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    parsed = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    return to_arrow_schema(parsed)


def raw_bytes(array: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in array.cast(pa.binary()).to_pylist()]


def boxed(frame: DataFrame, text_col: str = "text") -> DataFrame:
    """(rid, row, text): a number of each row, its other columns under their own names, and its
    text. Whatever columns there are, no name clashes. Write the result before using it twice."""
    return frame.select(
        F.monotonically_increasing_id().alias("rid"),
        F.struct(*[column(c) for c in frame.columns if c != text_col]).alias("row"),
        column(text_col).alias("text"))


def unboxed(rows: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """The rows of ``boxed`` with the columns they came with."""
    return rows.select(*[
        F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in columns])
