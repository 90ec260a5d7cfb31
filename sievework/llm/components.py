"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import remove, stored


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node, root: root is the smallest node of the component. Only nodes with links appear.

    Every round links each node's larger neighbours (large star), then its smaller ones (small star), to the
    smallest of its neighbours, until no link changes; rounds grow with the logarithm of the longest path. Each
    round is a table in the shared folder. Loops, nulls and repeated links don't matter.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges, path = stored(edges, "links")
    for _ in range(most_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u")
        small = star.select(F.col("v").alias("u"), F.col("m").alias("v")).union(star.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after, new_path = stored(small, "links")
        changed = not after.join(edges, ["u", "v"], "left_anti").isEmpty() or after.count() != edges.count()
        remove(spark, path)
        edges, path = after, new_path
        if not changed:
            break
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
