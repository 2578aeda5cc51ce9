"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for every id in the links (a, b): comp is the smallest id reachable.

    Each round gives a node the smallest label among its neighbours, then follows the label's own label, so that chains
    shorten by doubling. Minima are aggregated before the shuffle, which keeps a node with very many links cheap; each
    round is written to the shared folder. Null ids and loops are left out.
    """
    both = links.filter("a is not null and b is not null and a <> b").select("a", "b")
    edges = materialise(both.union(both.select("b", "a")).distinct())
    labels = materialise(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")))
    old: tuple[DataFrame, ...] = (labels,)
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "id", "left").select("id", "comp", F.least("comp", "near").alias("next"))
        step = materialise(step)
        jump = step.select(F.col("id").alias("next"), F.col("next").alias("beyond"))
        new = materialise(step.join(jump, "next", "left").select("id", "comp", F.least("next", "beyond").alias("new")))
        release(*old, step)
        labels, old = new.select("id", F.col("new").alias("comp")), (new,)
        if new.filter("new <> comp").isEmpty():
            release(edges)
            return labels
