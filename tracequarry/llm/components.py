"""Connected components of a table of links, by smallest labels and pointer jumping in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash


def connected_components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """id and root (smallest id reachable) of every id in ``links`` (a, b); null ends are dropped.

    Each round takes the smallest label among neighbours, then the label of that label, so the
    number of rounds grows with the logarithm of the longest chain. A round is written out, so a
    lost executor costs that round alone.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = stash(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stash(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("root")), "labels")
    stashed = labels
    for _ in range(most_rounds):
        near = both.join(labels, F.col("b") == F.col("id")).groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "id").select("id", "root", F.least("root", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("root").alias("beyond"))
        moved = stash(lower.join(jump, "low").select("id", F.least("low", "beyond").alias("root"), (F.least("low", "beyond") < F.col("root")).alias("moved")), "labels")
        discard(stashed)
        stashed, labels = moved, moved.select("id", "root")
        if moved.where("moved").isEmpty():
            return labels
    raise RuntimeError("components did not settle")
