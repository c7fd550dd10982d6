"""Connected components over an edge table, wholly as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


#: Labels that are broadcast at most, two numbers each.
SENT = 200_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for each node that has an edge; label is the smallest node it can reach.

    Each round takes the neighbours' smallest label and then the label's own label, so a chain of
    length n needs about log n rounds. Every round is written to the shared folder. Edges with a
    null end and loops add nothing; no edges give no rows."""
    one = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    both = materialize(one.union(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "m").alias("low"), "label")
        lower = materialize(lower, "lower")
        up = lower.select(F.col("node").alias("low"), F.col("low").alias("next"))
        used = lower.select("low").distinct()
        # one label of a huge component is one key of this join; few labels are sent to all tasks instead, many are a key a row
        up = F.broadcast(up.join(used, "low")) if used.limit(SENT + 1).count() <= SENT else up
        new = materialize(lower.join(up, "low").select("node", F.least("low", "next").alias("label"), (F.least("low", "next") < F.col("label")).alias("moved")), "labels")
        if not new.where("moved").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")
