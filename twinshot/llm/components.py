"""Connected components of an edge table, by repeated minimum labels in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinshot.llm.store import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id on an edge (a, b); component is the smallest id reachable.

    Each round gives an id the least label among itself and its neighbours, then follows the
    label once more, so stars settle in two rounds and chains of length n in about log n. The
    labels of a round are written out, which also cuts the lineage. An empty edge table gives an
    empty result; loops and repeated edges do no harm.
    """
    both = stored(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    )
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    while True:
        near = (
            both.join(labels.withColumnRenamed("id", "b"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        step = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("next"))
        # The label of the label: a component id is itself an id of the table.
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("beyond"))
        new = stored(step.join(jump, "next").select("id", F.least("next", "beyond").alias("label"), "component"))
        changed = new.where("label <> component").limit(1).count()
        labels = new.select("id", F.col("label").alias("component"))
        if not changed:
            return labels
