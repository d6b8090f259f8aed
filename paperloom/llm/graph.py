"""Connected components of an edge table, by joins and aggregations with a written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.shared import checkpointed, drop


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the least node that it reaches.

    Each round takes the least label among neighbours (an aggregation that is combined before it
    is shuffled), hands it to the node that was the label so far as well, and follows labels to
    their own labels, so chains shorten by doubling.  Labels only fall; the rounds end when the
    table no longer changes.  Each round is written to the shared folder, so a lost executor
    costs that round at most.
    """
    edges = checkpointed(
        edges.where("a <> b").select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).distinct()
    )
    labels = checkpointed(edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")))
    while True:
        of = labels.select(F.col("node").alias("b"), F.col("root").alias("near"))
        near = edges.join(of, "b").groupBy("a").agg(F.min("near").alias("near"))
        met = labels.join(near, labels.node == near.a).select("node", "root", F.least("root", "near").alias("least"))
        hooked = met.select(F.inline(F.array(F.struct("node", F.col("least").alias("to")), F.struct(F.col("root").alias("node"), F.col("least").alias("to")))))
        fell = checkpointed(hooked.groupBy("node").agg(F.min("to").alias("to")))
        onward = fell.select(F.col("node").alias("to"), F.col("to").alias("next"))
        jumped = fell.join(onward, "to").select("node", F.col("next").alias("root"))
        new = checkpointed(jumped)
        before = labels.select("node", F.col("root").alias("was"))
        done = new.join(before, "node").where("root <> was").isEmpty()
        drop(fell, labels)
        if done:
            drop(edges)
            return new
        labels = new
