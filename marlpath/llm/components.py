"""Connected components of link tables, as joins; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import pinned, released


def components(nodes: DataFrame, links: DataFrame, rounds: int = 60, broadcast_rows: int = 300_000) -> DataFrame:
    """(id, class_id) for each distinct non-null ``id`` of ``nodes``: class_id is the smallest id reachable over ``links`` (a, b).

    Each round a node takes the least label among itself and its neighbours and then its label's label, so that
    paths halve. A round is two joins and a map-side combined minimum; a node with very many links is one key of a
    join, which adaptive skew handling splits. Labels are broadcast while there are at most ``broadcast_rows`` (about 12 MB as a hash table)
    and shuffled beyond that. Links with null ends, self links and ends outside ``nodes`` count
    for nothing. Raises if ``rounds`` don't suffice.
    """
    ids = nodes.select("id").where("id is not null").distinct()
    both = pinned(
        links.where("a <> b").select("a", "b").union(links.where("a <> b").select(F.col("b"), F.col("a"))).distinct(), "links"
    )
    linked = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("label"))
    labels = pinned(linked, "labels")
    small = F.broadcast if labels.limit(broadcast_rows + 1).count() <= broadcast_rows else lambda df: df
    for _ in range(rounds):
        near = (
            both.join(small(labels.withColumnRenamed("id", "b")), "b")
            .groupBy("a")
            .agg(F.min("label").alias("near"))
            .withColumnRenamed("a", "id")
        )
        step = labels.join(small(near), "id", "left").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        above = labels.select(F.col("id").alias("label"), F.col("label").alias("top"))
        new = pinned(
            step.join(small(above), "label", "left").select("id", F.least("label", "top").alias("label"), "was"), "labels"
        )
        released(ids.sparkSession, labels)
        labels = new.drop("was")
        if new.where("label <> was").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return ids.join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("class_id"))
