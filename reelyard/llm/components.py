"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def components(links: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of ``links(a, b)``: rows ``(node, label)``.

    Nodes may be of any ordered type; links with a null end or with equal ends are ignored.
    Every round hangs the neighbours of a node below its smallest neighbour, first the
    larger ones, then the smaller ones, until nothing changes. A node's neighbours are only
    ever reduced to a minimum, never gathered. Each round is written to the shared folder.
    """
    def oriented(df: DataFrame) -> DataFrame:
        return df.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        ).where("a != b").distinct()

    links = stored(oriented(links.select("a", "b").where("a is not null and b is not null")), "links")
    seen = None
    while True:
        state = links.agg(
            F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))
        ).first()
        if tuple(state) == seen or state[0] == 0:
            break
        seen = tuple(state)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(lowest, "a").where("b > a").select(
            F.col("b").alias("a"), F.least("a", "m").alias("b")
        )
        large = oriented(large)
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = stored(
            oriented(small.unionByName(lowest.withColumnRenamed("m", "b"))), "links"
        )
    own = links.select(F.col("b").alias("node"), F.col("b").alias("label"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(own).distinct()
