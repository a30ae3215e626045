"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.runtime import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id of each component, for every id that is in an edge.

    Alternates two steps until nothing changes: every node's larger neighbours are linked to the smallest of the node and
    its neighbours, then its smaller neighbours are. Stars grow that way in a logarithmic number of rounds even for long
    chains. Each round is written as a table. Edges with a null end, loops and repeated edges are left out.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y").distinct()
    e = cut(e, "edges")
    before = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("y"), F.col("x"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        down = large.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("x"), F.col("m").alias("y")).union(low.select("u", "m"))
        e = cut(small.where("x <> y").distinct(), "edges")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("the components didn't settle")
    stars = e.select(F.greatest("x", "y").alias("id"), F.least("x", "y").alias("component"))
    return stars.union(stars.select("component", "component").distinct())
