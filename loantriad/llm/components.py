"""Connected components of a table of links, by joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loantriad.session import materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in ``links``: the least id that can be reached.

    Every round hands each id's label to its neighbours and then jumps to the label's own label, so labels settle in
    about the logarithm of the longest path. A round is stored before the next one reads it. Minima are taken before
    the shuffle, so an id with very many links costs no more than its task's share.
    """
    both = materialise(
        links.select(F.col(a).alias("id"), F.col(b).alias("other"))
        .unionByName(links.select(F.col(b).alias("id"), F.col(a).alias("other"))).where("id <> other").distinct(), "links")
    labels = materialise(both.groupBy("id").agg(F.min("other").alias("least")).select(
        "id", F.least("id", "least").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "other"), "other").select("id", "label")
        least = materialise(near.unionByName(labels).groupBy("id").agg(F.min("label").alias("label")), "labels")
        # a label is itself an id of the graph: follow it once
        roots = least.select(F.col("id").alias("label"), F.col("label").alias("root"))
        jumped = least.join(roots, "label").select("id", F.least("label", "root").alias("label"))
        jumped = materialise(jumped, "labels")
        changed = labels.withColumnRenamed("label", "old").join(jumped, "id").where("old <> label").limit(1).count()
        labels = jumped
        if not changed:
            return labels.withColumnRenamed("label", "component")
