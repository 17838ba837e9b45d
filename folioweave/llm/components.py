"""Connected components by propagation of minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.session import cut, forget


def minimum_labels(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, label) of all ids in the edges: the smallest id of its component. Loops, repeated edges and both directions of
    one edge are fine; an edge with a null end is left out; no edges give no rows.

    A round takes the smallest label of each id's neighbours, then the label of that label, so a chain of n ids needs about
    log n rounds. Each round is written to the shared folder, so nothing is recomputed if executors are lost, and the one
    before it is deleted.
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("id"), F.col(b).alias("other"))
    both = cut(ends.unionByName(ends.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct(), "edges")
    stored = cut(both.groupBy("id").agg(F.least(F.min("other"), F.first("id")).alias("label")), "labels")
    labels = stored
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("id").alias("other"), F.col("label").alias("near")), "other").groupBy("id").agg(F.min("near").alias("near"))
        step = labels.join(near, "id").select("id", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        jumped = step.join(labels.select(F.col("id").alias("next"), F.col("label").alias("far")), "next", "left").select("id", F.least("next", F.coalesce("far", "next")).alias("label"), "old")
        written = cut(jumped, "labels")
        forget(stored)
        stored, labels = written, written.select("id", "label")
        if written.where("label <> old").limit(1).count() == 0:
            return labels
    raise RuntimeError(f"labels still change after {max_rounds} rounds")
