"""Connected components of a link graph, by repeated joins on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.session import written


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node it reaches, for every node of ``links`` (``a``, ``b``).

    Each round, a node's larger neighbours and itself are linked to its smallest
    neighbour, until every link leads from a node straight to the smallest of its
    component. Links stay in tasks; the driver sees two numbers a round. A node of many
    links costs rows, not memory: minima are combined before they are shuffled.
    """
    edges = written(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    state = None
    while True:
        # Large star: neighbours larger than a node go to the smallest around it.
        both = edges.select("u", "v").union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        # Small star: smaller neighbours, and the node, go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == (now.n, now.s):
            break
        state = (now.n, now.s)
    ends = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return ends.union(roots).groupBy("node").agg(F.min("label").alias("label"))
