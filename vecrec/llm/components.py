"""Connected components of a table of links, by rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecrec.session import cut_and_count, fewer_files

MAX_ROUNDS = 60


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node that each linked node can reach, itself included.

    Each round every node tells its larger neighbours the smallest node it sees, then its smaller ones,
    so trees halve in depth. Sums are partial minima per task; a hub's own links stay as they are, since
    only nodes that see a smaller one enter the join. Each round ends in a written table of no more rows
    than ``links``, which is counted first and so should be a written table too. Links with a null end or both
    ends equal say nothing and are passed over; no links give no rows. Links whose graph has not settled
    after ``MAX_ROUNDS`` rounds raise an error, no partial result is given.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges, most = edges.distinct(), links.count()
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).where(F.col("m") < F.col("u"))
        # a larger neighbour of u moves to the smallest node that u sees
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(low, "u", "left").select(F.col("w").alias("u"), F.coalesce("m", "u").alias("v")).distinct()
        # then u's smaller neighbours, all but the smallest, are hung below the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), (F.col("v") != F.col("m")).alias("moved")
        )
        after = small.groupBy("u", "v").agg(F.max("moved").alias("moved"))
        before = edges.select("u", "v").withColumn("old", F.lit(True))
        stored, changed = cut_and_count(fewer_files(after.join(before, ["u", "v"], "left"), most), F.col("moved") | F.col("old").isNull())
        edges = stored.select("u", "v")
        if not changed:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    raise RuntimeError(f"links not settled after {MAX_ROUNDS} rounds")
