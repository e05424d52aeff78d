"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(id, root): for every id in links(a, b), a != b, the smallest id that it is connected to.

    Each round links every id to the smallest id among its neighbours, first seen from the
    larger ids and then from the smaller ones; rounds are logarithmic in the size of a
    component. A frequent root appears as a key of minimum aggregates only, which combine
    before the shuffle; the join on it has one row on the other side.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        # large star: every larger neighbour goes to the smallest id around
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("root"))
    )
