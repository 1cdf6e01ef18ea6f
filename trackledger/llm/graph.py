"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackledger.llm.store import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node with an edge to a smaller one, the smallest node it reaches.

    Alternating large-star and small-star steps: each round links the neighbours of a
    node to the smallest of them, so chains halve and hubs spread over partial
    aggregates.  Nodes that are the smallest of their component have no row.  Edges
    with a null end and self-loops are ignored.  Every round is written to the shared
    folder, so a lost executor costs one round at most.
    """
    ends = edges.where(F.col(a) != F.col(b))
    now = written(ends.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    before = None
    while True:
        sign = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())
        if sign == before or sign[0] == 0:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        before = sign
        both = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy(F.col("hi").alias("at")).agg(F.least(F.min("lo"), F.col("at")).alias("least"))
        large = now.join(least, now["lo"] == least["at"]).select("hi", F.col("least").alias("lo")).where("hi <> lo").distinct()
        large = written(large, "edges")
        first = large.groupBy(F.col("hi").alias("at")).agg(F.min("lo").alias("least"))
        joined = large.join(first, large["hi"] == first["at"])
        small = joined.where("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        now = written(small.unionByName(first.select(F.col("at").alias("hi"), F.col("least").alias("lo"))).distinct(), "edges")
