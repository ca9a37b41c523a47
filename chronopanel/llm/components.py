"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.session import materialize


def _roots(pointers: DataFrame) -> DataFrame:
    """(id, to) with each pointer taken to the end of its chain; an id's pointer goes to a smaller one, so there are no rings."""
    found = materialize(pointers)
    while True:
        ahead = found.select(F.col("id").alias("to"), F.col("to").alias("next"))
        moved = materialize(found.join(ahead, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        found = moved.select("id", "to")
        if not moved.filter("moved").limit(1).count():
            return found


def components(edges: DataFrame) -> DataFrame:
    """(id, component): of each id in ``edges`` (a, b), the smallest id it is connected with.

    Each id first follows one edge, that to its least neighbour, and the chains of these are taken to their ends: joins
    of one row per id. The other edges count only where they join two ends; they are put in terms of the ends, loops
    and repeated edges dropped, and the rest goes into the next round. Rounds end when no edge is left. A hub is no large
    group, as minima are taken before rows are dealt out.
    """
    left = materialize(edges.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("other")).filter("id <> other").distinct())
    label = None
    while label is None or left.limit(1).count():
        roots = _roots(left.groupBy("id").agg(F.min("other").alias("to")))
        if label is None:
            label = roots
        else:
            ahead = roots.select(F.col("id").alias("to"), F.col("to").alias("next"))
            label = materialize(label.join(ahead, "to", "left").select("id", F.coalesce("next", "to").alias("to")).unionByName(roots))
        high = left.join(roots.withColumnRenamed("to", "x"), "id").select("x", "other")
        both = high.join(roots.select(F.col("id").alias("other"), F.col("to").alias("y")), "other", "left").select("x", F.coalesce("y", "other").alias("y"))
        left = materialize(both.select(F.greatest("x", "y").alias("id"), F.least("x", "y").alias("other")).filter("id <> other").distinct())
    ends = label.select(F.col("to").alias("id")).distinct()
    return materialize(label.union(ends.select("id", F.col("id").alias("to"))).toDF("id", "component"))
