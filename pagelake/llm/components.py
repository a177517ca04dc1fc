"""Connected components of an edge table, by joins and groupings only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import stored


def components(edges: DataFrame, name: str) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``, component the smallest node.

    Each round hooks a node, and the root it points to, onto the smallest label among
    its neighbours, then lets every node point where its root points. Rounds grow with
    the logarithm of the longest path. Every join reads two stored tables, so a hub with
    most of the edges is split by adaptive execution; every grouping is a minimum with a
    map side. An empty edge table gives no rows.
    """
    plain = edges.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v"))
    plain = plain.filter("u <> v")
    both = plain.union(plain.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = stored(both, f"{name}-edges")
    labels = stored(both.groupBy("u").agg(F.min("v").alias("v")).select(
        F.col("u").alias("node"), F.least("u", "v").alias("label")), f"{name}-labels")
    last = None
    while True:
        total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if total == last:  # labels only ever fall
            return labels.withColumnRenamed("label", "component")
        last = total
        seen = (
            both.join(labels, both.u == labels.node)
            .groupBy(F.col("v").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        known = labels.join(seen, "node")
        hooked = (
            labels.union(known.select("node", "near"))
            .union(known.select(F.col("label").alias("node"), "near"))
            .groupBy("node")
            .agg(F.min("label").alias("label"))
        )
        hooked = stored(hooked, f"{name}-hooked")
        roots = hooked.select(F.col("node").alias("root"), F.col("label").alias("root_label"))
        labels = stored(
            hooked.join(roots, hooked.label == roots.root).select(
                "node", F.least("label", "root_label").alias("label")
            ),
            f"{name}-labels",
        )
