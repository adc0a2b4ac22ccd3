"""Connected components of an edge table, by hooking to the least neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomosaic.llm.common import Workspace


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(node, label) for every node of ``edges`` (columns a, b): the least node that can be reached.

    In each round a label hooks to the least label at the other end of its edges, hooks are followed once more, and labels
    and edges move along; edges within one label are dropped, and the rounds end when none is left. A hook always leads to
    a lesser label, so there are no rings, and a chain of hooks shrinks by a factor in each round. All steps are
    aggregations and joins on one key, so a node with very many edges is combined before the shuffle. Null ends and loops
    are ignored. Each round is written, and the one before is deleted.
    """
    a, b = F.col("a"), F.col("b")
    once = edges.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    live = ws.keep(once, "edges")
    labels = live.select(F.col("a").alias("node")).union(live.select("b")).distinct().withColumn("label", F.col("node"))
    written = None
    while not live.isEmpty():
        first = live.groupBy(F.col("b").alias("label")).agg(F.min("a").alias("to"))
        further = first.select(F.col("label").alias("to"), F.col("to").alias("next"))
        hooks = ws.keep(first.join(further, "to", "left").select("label", F.coalesce("next", "to").alias("to")), "hooks")
        moved = ws.keep(labels.join(hooks, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        low = hooks.select(F.col("label").alias("a"), F.col("to").alias("a_to"))
        high = hooks.select(F.col("label").alias("b"), F.col("to").alias("b_to"))
        ends = live.join(low, "a", "left").join(high, "b", "left").select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b"))
        rest = ws.keep(ends.filter(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")
        ws.drop(hooks, live, *([written] if written is not None else []))
        labels = written = moved
        live = rest
    return labels
