"""Hierarchies and graphs: level by level, each level one join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import shared_dir


def _materialised(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder, so that a lost executor costs no recomputation of all levels."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def descendants(roots: DataFrame, edges: DataFrame, node: str = "node", parent: str = "parent", child: str = "child", max_levels: int | None = None) -> DataFrame:
    """All descendants with level (from 1) and path (nodes from the root on); roots are not given.

    A node that can be reached in several ways comes once for each, as in a tree walk.  A
    cycle has no end and raises, unless ``max_levels`` sets one.
    """
    level = roots.select(F.col(node).alias("_node"), F.array(F.col(node)).alias("path"))
    e = edges.select(F.col(parent).alias("_parent"), F.col(child).alias("_child"))
    out, k = None, 0
    while max_levels is None or k < max_levels:
        k += 1
        further = F.concat("path", F.array("_child"))
        if max_levels is None:
            further = F.when(F.array_contains("path", F.col("_child")), F.raise_error(F.lit("the hierarchy has a cycle")).cast(level.schema["path"].dataType)).otherwise(further)
        level = level.join(e, level["_node"] == e["_parent"]).select(F.col("_child").alias("_node"), further.alias("path"))
        level = _materialised(level)
        if level.isEmpty():
            break
        found = level.select(F.col("_node").alias(node), F.lit(k).alias("level"), "path")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else level.select(F.col("_node").alias(node), F.lit(0).alias("level"), "path").limit(0)


def deep_first(found: DataFrame) -> tuple[str, ...]:
    """What to order descendants by for a walk in pre-order."""
    return ("path",)


def breadth_first(found: DataFrame) -> tuple[str, ...]:
    """What to order descendants by for a walk level by level."""
    return ("level", "path")


def reachable(start: DataFrame, edges: DataFrame, node: str = "node", a: str = "a", b: str = "b", directed: bool = False) -> DataFrame:
    """Nodes that can be reached from the start nodes, without these; each once, cycles or not."""
    e = edges.select(F.col(a).alias("_a"), F.col(b).alias("_b"))
    if not directed:
        e = e.unionByName(edges.select(F.col(b).alias("_a"), F.col(a).alias("_b")))
    e = _materialised(e.distinct())
    begun = start.select(F.col(node).alias("_n")).distinct()
    frontier = seen = _materialised(begun)
    rounds = 0
    while True:
        nexts = e.join(frontier, e["_a"] == frontier["_n"], "left_semi").select(F.col("_b").alias("_n")).distinct()
        frontier = _materialised(nexts.join(seen, "_n", "left_anti"))
        if frontier.isEmpty():
            break
        seen, rounds = seen.unionByName(frontier), rounds + 1
        if rounds % 8 == 0:  # one table again, not one for each round
            seen = _materialised(seen)
    return seen.join(begun, "_n", "left_anti").select(F.col("_n").alias(node))
