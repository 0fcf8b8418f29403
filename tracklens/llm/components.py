"""Connected components over a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.llm.common import Workspace
from tracklens.llm.skew import join_dealt


def connected_components(ws: Workspace, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, label)`` for every node of ``edges``; label is the smallest reachable node.

    Every round lets each node point at the smallest node around it, follows that pointer once
    more, and replaces the edges by those between the nodes pointed at. Nodes that are not the
    smallest around them vanish, so the edges go down geometrically, chains included. All steps
    are joins and minimum aggregates, which combine before they shuffle; no node or edge is collected but the few
    hot ones: the centre of a star, which a third of all edges may point at, is dealt over tasks in every join.

    Self-loops and repeated edges are harmless; an empty edge list gives an empty result; edges
    with a null end are ignored.
    """
    work = ws.put(
        edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    step = 0
    while work.limit(1).count():
        step += 1
        both = work.unionByName(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = ws.put(
            both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("p")),
            f"parent{step}")
        up = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        parent = ws.put(join_dealt(parent, up, "p", "node").select("node", F.col("pp").alias("p")), f"jump{step}")
        if labels is None:
            labels = parent.select("node", F.col("p").alias("label"))
        else:
            labels = ws.put(
                join_dealt(labels, parent.select(F.col("node").alias("label"), "p"), "label", "node", "left").select(
                    "node", F.coalesce("p", "label").alias("label")), f"labels{step}")
        to = parent.select(F.col("node").alias("a"), F.col("p").alias("pa"))
        work = ws.put(
            join_dealt(join_dealt(work, to, "a", "b"), to.select(F.col("a").alias("b"), F.col("pa").alias("pb")), "b", "a", keys=work)
            .filter("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(),
            f"edges{step}")
    return labels if labels is not None else work.select(F.col("a").alias("node"), F.col("b").alias("label"))
