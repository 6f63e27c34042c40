"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, component): each node of ``edges`` with the least node it is connected with.

    Alternating large-star and small-star rounds: each node links its neighbours to the least of them, so that long chains halve in a few rounds; every
    round is one aggregation by node and a join, written to the shared folder. Null ends and loops are ignored (a loop alone still lists its node).
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    nodes = e.select("u").union(e.select("v")).distinct()
    links = materialize(e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(most):
        both = links.union(links.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", "m"))
        after = materialize(small.distinct(), "links")
        if after.exceptAll(links).isEmpty() and links.exceptAll(after).isEmpty():
            break
        links = after
    else:
        raise RuntimeError(f"the components didn't settle in {most} rounds")
    return nodes.join(links, nodes.u == links.u, "left").select(nodes.u.alias("node"), F.coalesce(links.v, nodes.u).alias("component"))
