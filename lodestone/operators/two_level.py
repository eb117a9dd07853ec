"""Approximate neighbours through two levels of inverted lists.

A bounded number of coarse centres, fitted on a bounded sample, is known to every task. Each
coarse list has fine centres of its own, picked from the sample; they are a table, and a
task reads only those of the coarse list it works on. Vectors are stored by coarse list and
sorted by fine list, so what no query visits is not read. How many lists a query visits is
chosen from the recall that sampled queries have against all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.operators.ordered import top_k
from lodestone.operators.topk_blocks import NEIGHBOURS, best, matrix
from lodestone.staging import new_path, stage

MOST_COARSE = 512  # coarse centres in the driver and in every task
SAMPLE = 50_000  # vectors that centres are fitted on
MOST_FINE = 4096  # fine centres of one coarse list
ROWS_PER_CELL = 50_000  # vectors of a list, or of a coarse list, that one task works on
QUERIES_PER_CELL = 4096
ASKED = 64  # sampled queries of a calibration
OPENED = 64  # coarse lists whose fine centres a query is compared with


def _distances(asked: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances but for the part of the query; rounded, so that ties are ties."""
    return np.round((centres**2).sum(axis=1)[None, :] - 2 * asked @ centres.T, 9)


def digest(column: str):
    """An order that has nothing to do with the values, and that SQL can repeat."""
    return F.md5(F.col(column).cast("string"))


class TwoLevelLists:
    """``vectors(id, vec)`` in lists of about ``rows_per_list``.

    ``fitted`` moves the picked centres by KMeans; otherwise centres are the vectors that come
    first by digest. Every vector is in exactly one list, whatever the sample was.
    """

    def __init__(
        self, vectors: DataFrame, rows_per_list: int = C.IVF_ROWS_PER_LIST, fitted: bool = True,
        seed: int = C.SEED,
    ) -> None:
        self.spark = vectors.sparkSession
        self.vectors = vectors = vectors.select("id", F.col("vec").cast("array<double>").alias("vec"))
        n = vectors.count()
        lists = max(1, n // rows_per_list)
        # Only fitting needs a sample; which vectors come first by digest is known of all of them.
        kept = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // SAMPLE)))) == 0
        sample = stage(vectors.where(kept) if fitted else vectors, "list-sample")
        k = min(MOST_COARSE, math.ceil(math.sqrt(lists)))
        if fitted and k > 1:
            model = KMeans(k=k, seed=seed, maxIter=10).fit(
                sample.select(array_to_vector("vec").alias("features")))
            self.coarse = np.array(model.clusterCenters())
        else:
            first = sample.orderBy(digest("id"), "id").limit(k).collect()
            self.coarse = np.array([r["vec"] for r in first]) if first else np.zeros((1, 1))
        placed = stage(self._with_coarse(sample), "coarse-sample")
        shares = {r["coarse"]: r["n"] for r in placed.groupBy("coarse").agg(F.count("*").alias("n")).collect()}
        total = max(1, sum(shares.values()))
        self.fine_folder = new_path(self.spark, "fine-centres")
        per_coarse = self._lookup({c: min(MOST_FINE, -(-s * lists // total)) for c, s in shares.items()}, 1)
        picked = top_k(placed, ["coarse"], [digest("id"), F.col("id")], MOST_FINE).where(
            F.col("rank") <= per_coarse).select("coarse", (F.col("rank") - 1).alias("fine"), "vec")
        if fitted:
            picked = self._moved(stage(picked, "picked-centres"), placed)
        picked.repartition("coarse").write.partitionBy("coarse").parquet(self.fine_folder)
        cells = self._lookup({c: -(-s * n // (total * ROWS_PER_CELL)) for c, s in shares.items()}, 1)
        self.folder = new_path(self.spark, "two-level-lists")
        rows = self._with_coarse(vectors).withColumn("salt", F.pmod(F.xxhash64("id"), cells))
        rows = rows.repartition("coarse", "salt").sortWithinPartitions("coarse").select("id", "vec", "coarse")
        self._with_fine(rows).sortWithinPartitions("coarse", "fine").write.partitionBy("coarse").parquet(self.folder)
        schema = "id long, vec array<double>, fine int, coarse int"
        self.members = self.spark.read.schema(schema).parquet(self.folder)
        self.sizes = stage(self.members.groupBy("coarse", "fine").agg(F.count("*").alias("n")), "list-sizes")
        self.lists, self.probes = self.sizes.count(), None

    def _lookup(self, values: dict[int, int], other: int):
        """The value of the row's coarse list, one of at most MOST_COARSE."""
        pairs = [F.lit(x) for pair in values.items() for x in pair]
        found = F.element_at(F.create_map(*pairs), F.col("coarse")) if pairs else F.lit(None)
        return F.greatest(F.coalesce(found.cast("long"), F.lit(other)), F.lit(1))

    def _with_coarse(self, rows: DataFrame, opened: int = 1, key: str = "id") -> DataFrame:
        centres = self.coarse

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                order = np.argsort(_distances(matrix(batch["vec"]), centres), axis=1, kind="stable")[:, :opened]
                at = pa.array(np.repeat(np.arange(batch.num_rows), order.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [batch[key].take(at), batch["vec"].take(at), pa.array(order.ravel().astype(np.int32))],
                    names=[key, "vec", "coarse"])

        return rows.select(key, "vec").mapInArrow(run, f"{key} long, vec array<double>, coarse int")

    def _moved(self, picked: DataFrame, placed: DataFrame) -> DataFrame:
        """Fine centres after a few rounds over the sample of their coarse list."""
        def move(left: pa.Table, right: pa.Table) -> pa.Table:
            centres, rows = matrix(left["vec"]).copy(), matrix(right["vec"])
            for _ in range(5):
                own = _distances(rows, centres).argmin(axis=1)
                for f in np.unique(own):
                    centres[f] = rows[own == f].mean(axis=0)
            return pa.table({"coarse": left["coarse"], "fine": left["fine"],
                             "vec": pa.array(list(centres), pa.list_(pa.float64()))})

        ordered = picked.select("coarse", F.col("fine").cast("int").alias("fine"), "vec")
        return ordered.groupBy("coarse").cogroup(placed.select("coarse", "vec").groupBy("coarse")).applyInArrow(
            move, "coarse int, fine int, vec array<double>")

    def _by_coarse(self, rows: DataFrame, work, schema: str) -> DataFrame:
        """Runs ``work(batch, fine, centres)`` on rows sorted by coarse list."""
        folder = self.fine_folder

        def centres_of(coarse: int) -> tuple[np.ndarray, np.ndarray]:
            filesystem, path = fs.FileSystem.from_uri(f"{folder}/coarse={coarse}")
            if filesystem.get_file_info(path).type == fs.FileType.NotFound:
                return np.zeros(1, np.int32), None  # no vector of the sample was here: one list
            table = ds.dataset(path, filesystem=filesystem, format="parquet").to_table().sort_by("fine")
            return table["fine"].to_numpy().astype(np.int32), matrix(table["vec"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, fine, centres = None, None, None
            for batch in batches:
                at = 0
                for coarse, group in groupby(batch["coarse"].to_pylist()):
                    size = sum(1 for _ in group)
                    if coarse != known:
                        known, (fine, centres) = coarse, centres_of(coarse)
                    for start in range(at, at + size, 2048):
                        part = batch.slice(start, min(2048, at + size - start))
                        if centres is None:
                            yield work(part, fine, np.zeros((part.num_rows, 1)))
                        else:
                            yield work(part, fine, _distances(matrix(part["vec"]), centres))
                    at += size

        return rows.mapInArrow(run, schema)

    def _with_fine(self, rows: DataFrame) -> DataFrame:
        def nearest(part: pa.RecordBatch, fine: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [part["id"], part["vec"], pa.array(fine[distance.argmin(axis=1)]), part["coarse"]],
                names=["id", "vec", "fine", "coarse"])

        return self._by_coarse(rows, nearest, "id long, vec array<double>, fine int, coarse int")

    def list_order(self, queries: DataFrame, opened: int, most: int) -> DataFrame:
        """(query_id, coarse, fine, rank): the ``most`` lists of the ``opened`` coarse ones that
        are nearest to each query."""
        def ranked(part: pa.RecordBatch, fine: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
            order = np.argsort(distance, axis=1, kind="stable")[:, :most]
            at = np.repeat(np.arange(part.num_rows), order.shape[1])
            return pa.RecordBatch.from_arrays([
                part["query_id"].take(pa.array(at)), part["coarse"].take(pa.array(at)),
                pa.array(fine[order.ravel()]), pa.array(np.take_along_axis(distance, order, 1).ravel())],
                names=["query_id", "coarse", "fine", "distance"])

        rows = self._with_coarse(queries, min(opened, len(self.coarse)), "query_id")
        rows = rows.repartition("coarse", F.pmod(F.xxhash64("query_id"), F.lit(8))).sortWithinPartitions("coarse")
        found = self._by_coarse(rows, ranked, "query_id long, coarse int, fine int, distance double")
        return top_k(found, ["query_id"], [F.col("distance"), F.col("coarse"), F.col("fine")], most).select(
            "query_id", "coarse", "fine", "rank")

    def calibrate(self, exact, k: int = 10, target: float = 0.9, asked: int = ASKED, opened: int = OPENED) -> float:
        """Sets ``probes`` to the fewest lists that hold the share ``target`` of the true neighbours
        of sampled queries, and returns that share.

        ``exact(vectors, queries, k)`` finds the true ones among all rows. Only ranks of lists,
        ``asked * k`` numbers, reach the driver.
        """
        queries = stage(self.vectors.orderBy(digest("id"), "id").limit(asked).withColumnRenamed(
            "id", "query_id"), "calibration")
        truth = exact(self.vectors, queries, k).join(self.members.select("id", "coarse", "fine"), "id")
        order = self.list_order(queries, opened, self.lists)
        ranks = truth.join(order.withColumnRenamed("rank", "place"), ["query_id", "coarse", "fine"], "left").select(
            "place").toArrow()["place"].to_pylist()
        held = sorted(r for r in ranks if r is not None)
        wanted = min(len(held), math.ceil(target * len(ranks)))
        self.probes = held[wanted - 1] if wanted else self.lists
        return sum(r <= self.probes for r in held) / max(1, len(ranks))

    def search(self, queries: DataFrame, k: int, probes: int | None = None, opened: int = OPENED) -> DataFrame:
        """``(query_id, rank, id, score)`` from the nearest lists; as many as ``calibrate`` chose
        unless given. Ties in the rounded score go to the smaller id.

        A task scores a bounded part of one list against a bounded part of its queries.
        """
        probes = probes or self.probes
        if probes is None:
            raise ValueError("give the number of lists to visit, or calibrate first")
        queries = stage(queries.select("query_id", F.col("vec").cast("array<double>").alias("vec")), "queries")
        visits = stage(self.list_order(queries, opened, probes).drop("rank"), "visits")
        visited = [r["coarse"] for r in visits.select("coarse").distinct().collect()]  # at most MOST_COARSE
        parts = visits.groupBy("coarse", "fine").agg(F.count("*").alias("asking")).join(
            self.sizes, ["coarse", "fine"]).select(
            "coarse", "fine", F.ceil(F.col("n") / ROWS_PER_CELL).cast("int").alias("cells"),
            F.ceil(F.col("asking") / QUERIES_PER_CELL).cast("int").alias("blocks"))
        parts = stage(parts, "visited-lists")
        left = visits.join(queries, "query_id").join(parts, ["coarse", "fine"]).select(
            "query_id", "vec", "coarse", "fine", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"),
            F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
        right = self.members.where(F.col("coarse").isin(visited)).join(parts, ["coarse", "fine"]).select(
            "id", "vec", "coarse", "fine", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int").alias("cell"),
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        keys = ["coarse", "fine", "cell", "block"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_scored(k), NEIGHBOURS)
        ranked = top_k(found, ["query_id"], [F.desc("score"), F.asc("id")], k)
        return ranked.select("query_id", "rank", "id", "score")

    def rows_visited(self, queries: DataFrame, probes: int | None = None, opened: int = OPENED) -> DataFrame:
        """One row: vectors that the queries were compared with, and all pairs there are."""
        visits = self.list_order(queries, opened, probes or self.probes)
        pairs = visits.join(self.sizes, ["coarse", "fine"]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("compared"))
        return pairs.withColumn("of", F.lit(self.vectors.count() * queries.count()))


def _scored(k: int):
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        owner, ids, scores = [np.empty(0)], [np.empty(0)], [np.empty(0)]
        if left.num_rows and right.num_rows:
            names, vectors, asking = right["id"].to_numpy(), matrix(right["vec"]), left["query_id"].to_numpy()
            asked = matrix(left["vec"])
            for start in range(0, len(asking), 512):
                part = np.round(asked[start : start + 512] @ vectors.T, 6)
                for q, at in enumerate(best(part, names, k)):
                    owner.append(np.full(len(at), asking[start + q]))
                    ids.append(names[at])
                    scores.append(part[q, at])
        return pa.table({
            "query_id": pa.array(np.concatenate(owner).astype(np.int64)),
            "id": pa.array(np.concatenate(ids).astype(np.int64)),
            "score": pa.array(np.concatenate(scores).astype(np.float64))})

    return score
