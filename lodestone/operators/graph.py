"""Dependency graphs: neighbours, closure, validation, cycles.

Edges are ``(upstream_id, downstream_id)``: the upstream node depends on the
downstream one, so a failure travels from downstream to upstream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.staging import stage


def neighbours(edges: DataFrame) -> DataFrame:
    """``(node, n_downstream, n_upstream)`` for every node on an edge."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("upstream_id").alias("node"), F.lit(1).alias("d"), F.lit(0).alias("u")),
                F.struct(F.col("downstream_id").alias("node"), F.lit(0).alias("d"), F.lit(1).alias("u")),
            )
        ).alias("e")
    ).select("e.*")
    return ends.groupBy("node").agg(
        F.sum("d").alias("n_downstream"), F.sum("u").alias("n_upstream")
    )


def affected(edges: DataFrame, roots: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(root, node, hops)``: everything upstream of each root, at its least distance.

    One join per hop. Each round is written, so lineage stays one join long, the
    small early rounds are broadcast by their measured size, and a lost executor
    repeats one round at most. The rounds end when none finds a new node.
    """
    if nodes is not None:
        unknown = roots.join(nodes, roots["root"] == nodes["node"], "left_anti").limit(1).collect()
        if unknown:
            raise KeyError(unknown[0]["root"])
    edges = stage(edges.select("upstream_id", "downstream_id").distinct(), "edges")
    frontier = stage(
        roots.select("root", F.col("root").alias("node"), F.lit(0).alias("hops")).distinct(), "hop"
    )
    reached = frontier
    while True:
        step = frontier.join(edges, F.col("node") == F.col("downstream_id")).select(
            "root", F.col("upstream_id").alias("node"), (F.col("hops") + 1).alias("hops")
        ).distinct()
        frontier = stage(step.join(reached, ["root", "node"], "left_anti"), "hop")
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)


def blast_radius(edges: DataFrame, roots: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    return affected(edges, roots, nodes).filter("hops > 0").select("root", "node")


def graph_problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(problem, n)`` of a node frame ``(id, name)`` and its edges."""
    def surplus(frame: DataFrame, *columns: str):
        return frame.groupBy(*columns).count().agg(F.sum(F.col("count") - 1).alias("n"))

    known = nodes.select("id").distinct()
    found = {
        "duplicate id": surplus(nodes, "id"),
        "duplicate name": surplus(nodes, "name"),
        "unknown upstream": edges.join(known, edges["upstream_id"] == known["id"], "left_anti").agg(
            F.count(F.lit(1)).alias("n")
        ),
        "unknown downstream": edges.join(
            known, edges["downstream_id"] == known["id"], "left_anti"
        ).agg(F.count(F.lit(1)).alias("n")),
        "self edge": edges.agg(F.count_if(F.col("upstream_id") == F.col("downstream_id")).alias("n")),
        "duplicate edge": surplus(edges, "upstream_id", "downstream_id"),
    }
    out = None
    for name, frame in found.items():
        row = frame.select(F.lit(name).alias("problem"), F.col("n").cast("long").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out.filter("n > 0")


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges left after repeatedly dropping nodes without a way in or out.

    Empty exactly when the graph has no cycle. What is left are the cycles and
    the paths between them.
    """
    core = stage(edges.select("upstream_id", "downstream_id").distinct(), "core")
    n = core.count()
    while n:
        sources = core.select(F.col("upstream_id").alias("node")).distinct()
        targets = core.select(F.col("downstream_id").alias("node")).distinct()
        kept = core.join(sources, core["downstream_id"] == sources["node"], "left_semi").join(
            targets, F.col("upstream_id") == targets["node"], "left_semi"
        )
        core = stage(kept, "core")
        left = core.count()
        if left == n:
            break
        n = left
    return core


def cycles(core: DataFrame) -> DataFrame:
    """(cycle, position, node): the cycles that the least successors of a core lead to.

    ``core`` is what ``cyclic_core`` leaves, so every node has a successor. A cycle is named
    by its least node, which is at position 0. Pointers are doubled: after as many steps as
    there are nodes a walk is on its cycle, and the places on a cycle come from doubling
    again, so the number of jobs is logarithmic in the nodes.
    """
    step = stage(core.groupBy(F.col("upstream_id").alias("node")).agg(
        F.min("downstream_id").alias("next")), "successors")
    rounds = step.count().bit_length()
    jump = step.select("node", F.col("next").alias("to"), F.least("node", "next").alias("least"))
    for _ in range(rounds):
        further = jump.select(F.col("node").alias("to"), F.col("to").alias("then"), F.col("least").alias("other"))
        jump = stage(jump.join(further, "to").select(
            "node", F.col("then").alias("to"), F.least("least", "other").alias("least")), "jumps")
    on = jump.select(F.col("to").alias("node")).distinct().join(jump, "node").select(
        "node", F.col("least").alias("cycle"))
    ends = F.col("next") == F.col("cycle")
    rank = stage(on.join(step, "node").select(
        "cycle", "node", F.when(~ends, F.col("next")).alias("to"),
        F.when(ends, 0).otherwise(1).cast("long").alias("left")), "ranks")
    for _ in range(rounds):
        further = rank.select(F.col("node").alias("to"), F.col("to").alias("then"), F.col("left").alias("more"))
        rank = stage(rank.join(further, "to", "left").select(
            "cycle", "node", F.col("then").alias("to"),
            (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")), "ranks")
    sizes = rank.groupBy("cycle").agg(F.max("left").alias("last"))
    return rank.join(sizes, "cycle").select("cycle", (F.col("last") - F.col("left")).alias("position"), "node")


def cycle_path(core: DataFrame) -> list | None:
    """One cycle as a list of nodes, the first repeated at the end, for an error message."""
    found = cycles(core)
    first = found.agg(F.min("cycle").alias("cycle"))
    path = [r["node"] for r in found.join(first, "cycle").orderBy("position").collect()]
    return [*path, path[0]] if path else None


def downstream_of(edges: DataFrame, node) -> DataFrame:
    """What ``node`` depends on directly."""
    return edges.filter(F.col("upstream_id") == F.lit(node)).select(F.col("downstream_id").alias("node"))


def upstream_of(edges: DataFrame, node) -> DataFrame:
    """What depends on ``node`` directly."""
    return edges.filter(F.col("downstream_id") == F.lit(node)).select(F.col("upstream_id").alias("node"))


def lookup_one(rows: DataFrame, column: str, value):
    """The row with this id; an unknown id is an error."""
    found = rows.filter(F.col(column) == F.lit(value)).limit(1).collect()
    if not found:
        raise KeyError(value)
    return found[0]
