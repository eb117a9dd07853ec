"""Exact nearest neighbours by blocks.

Every query has to meet every vector, but the pairs never become rows. Queries
are written in blocks of a fixed number of rows that tasks read from the shared
folder; each task multiplies its Arrow batches with a block and keeps only the
best ``k`` per query.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.staging import new_path, stage

#: Rows of one block of queries (4096 x 768 doubles is 24 MiB).
QUERY_BLOCK = 4096
BLOCK = "_block"
#: Share of a block that its part of the queries fills on average.
FILLED = 0.9
NEIGHBOURS = "query_id long, id long, score double"
#: Blocks whose leaders a task keeps through its partition; the queries are read again.
CARRIED = 64
#: Candidates of a partition that are held while all blocks pass by, and their bytes.
PIECE, PIECE_BYTES = 8192, 32 << 20
#: Candidates scored together; with the query block it bounds a task's score matrix.
SLICE = 512
#: Rows of a batch that Spark sends to a worker at once: 2048 vectors are 12 MiB.
BATCH_ROWS = 2048
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lets the session send at most BATCH_ROWS rows at once; a worker holds a batch whole."""
    rows = int(spark.conf.get(BATCH_KEY))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)


def hand_back() -> None:
    """Gives memory that is no longer used back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # systems with another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as a two-dimensional array of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.empty((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if flat.size % n or pa.compute.list_value_length(column).unique().to_pylist() != [
        flat.size // n
    ]:
        raise ValueError("dimension mismatch between vectors")
    return flat.reshape(n, -1)


def written_blocks(queries: DataFrame, block: int) -> tuple[str, list[str]]:
    """Writes the queries in blocks of at most ``block`` rows; their folder and names.

    Rows are dealt by a digest of their id into parts of somewhat less than a block, and a
    part that has more is cut by position, so no task sorts or holds all vectors.
    """
    queries = stage(queries, "queries")
    n = queries.count()
    folder = new_path(queries.sparkSession, "query-blocks")
    if n == 0:
        return folder, []
    parts = 1 if n <= block else math.ceil(n / (FILLED * block))
    row = F.monotonically_increasing_id()  # the part, and the place in it
    place = F.floor(row.bitwiseAND(F.lit((1 << 33) - 1)) / block)
    name = F.concat_ws("-", F.shiftright(row, 33).cast("string"), place.cast("string"))
    dealt = queries.repartition(parts, "query_id").withColumn(BLOCK, name)
    dealt.write.partitionBy(BLOCK).parquet(folder)
    written = queries.sparkSession.read.schema(queries.schema.add(BLOCK, "string")).parquet(folder)
    return folder, sorted(r[0] for r in written.select(BLOCK).distinct().collect())


def read_block(folder: str, name: str) -> pa.Table:
    """One block, by ``query_id``; called in tasks."""
    filesystem, path = fs.FileSystem.from_uri(f"{folder}/{BLOCK}={name}")
    return pq.read_table(path, filesystem=filesystem, partitioning=None).sort_by("query_id")


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Slices of the input in lists of about PIECE rows or PIECE_BYTES, whichever is less."""
    held, rows, size = [], 0, 0
    for part in slices(batches):
        held.append(part)
        rows += part.num_rows
        size += part.nbytes
        if rows >= PIECE or size >= PIECE_BYTES:
            yield held
            held, rows, size = [], 0, 0
    if held:
        yield held


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row of ``scores``: positions of the k best, ties to the smaller id.

    Entries at minus infinity are absent and never chosen.
    """
    chosen = []
    for row in scores:
        at = np.flatnonzero(row > -np.inf)
        if at.size > k:
            cut = np.partition(row[at], at.size - k)[at.size - k]
            at = at[row[at] >= cut]
        order = np.lexsort((ids[at], -row[at]))[:k]
        chosen.append(at[order])
    return chosen


class Leaders:
    """The k best candidates seen so far for every query of a block."""

    def __init__(self, n_queries: int, k: int, carried: int = 0) -> None:
        self.k = k
        self.ids = np.zeros((n_queries, k), dtype=np.int64)
        self.scores = np.full((n_queries, k), -np.inf)  # best first; an absent one is minus infinity
        self.extra = np.zeros((carried, n_queries, k))

    def add(self, scores: np.ndarray, ids: np.ndarray, extra: Sequence[np.ndarray] = ()) -> None:
        """``scores`` is queries by candidates; each of ``extra`` has a carried value per cell.

        Entries at minus infinity are absent and never chosen; ties go to the smaller id.
        """
        top = scores.max(axis=1, initial=-np.inf)
        rows = np.flatnonzero((top > -np.inf) & (top >= self.scores[:, -1]))
        if not rows.size:
            return
        part, least = scores[rows], self.scores[rows, -1]
        if part.shape[1] > self.k:
            at_least = part.shape[1] - self.k
            least = np.maximum(least, np.partition(part, at_least, axis=1)[:, at_least])
        row, at = np.nonzero((part >= least[:, None]) & (part > -np.inf))
        owner = np.concatenate([np.repeat(np.arange(rows.size), self.k), row])
        all_ids = np.concatenate([self.ids[rows].ravel(), ids[at]])
        all_scores = np.concatenate([self.scores[rows].ravel(), part[row, at]])
        order = np.lexsort((all_ids, -all_scores, owner))
        sizes = np.bincount(owner, minlength=rows.size)
        place = np.arange(owner.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        kept = order[place < self.k]
        self.ids[rows] = all_ids[kept].reshape(-1, self.k)
        self.scores[rows] = all_scores[kept].reshape(-1, self.k)
        for held, values in zip(self.extra, extra, strict=True):
            both = np.concatenate([held[rows].ravel(), values[rows[row], at]])
            held[rows] = both[kept].reshape(-1, self.k)

    def rows(self, query_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        present = self.scores > -np.inf
        return (
            np.repeat(query_ids, present.sum(axis=1)), self.ids[present], self.scores[present],
            self.extra[:, present],
        )


class BlockTask(Protocol):
    """Work of one task on one block of queries.

    ``asked`` is what scoring needs of the block, None while it is not loaded. What was found
    is much smaller and stays.
    """

    asked: object

    def load(self, block: pa.Table) -> None: ...

    def add(self, part: pa.RecordBatch) -> None: ...

    def rows(self) -> pa.RecordBatch: ...


def scan_with_blocks(
    vectors: DataFrame, queries: DataFrame, task: Callable[[], BlockTask], schema: str,
    block: int = QUERY_BLOCK,
) -> DataFrame:
    """One scan of ``vectors`` against all blocks of queries.

    Tasks read the written blocks themselves; nothing of the queries passes the driver but
    the names of the blocks. A task holds one block at a time and reads it again for every
    piece of its partition. The first CARRIED blocks keep their leaders through the partition;
    later ones report what each piece holds, so a task's memory is bounded by both. A single
    block stays, and the input passes it slice by slice.
    """
    small_batches(vectors.sparkSession)
    folder, blocks = written_blocks(queries, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: dict[str, BlockTask] = {}
        for piece in pieces(batches) if len(blocks) > 1 else ([part] for part in slices(batches)):
            for name in blocks:
                work = carried.get(name) or task()
                if work.asked is None:
                    work.load(read_block(folder, name))
                for part in piece:
                    work.add(part)
                if name not in carried and len(carried) >= CARRIED:
                    yield work.rows()
                    continue
                carried[name] = work
                if len(blocks) > 1:
                    work.asked = None
            if len(blocks) > 1:
                hand_back()
        for work in carried.values():
            yield work.rows()
        carried.clear()
        hand_back()

    return vectors.mapInArrow(run, schema)
