"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import cut, discard


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node that links reach.

    A large star joins each node's larger neighbours to its smallest, a small star its smaller ones, until every edge
    points at a smallest node: O(log^2 n) rounds. Each round is written to the shared folder, so that a lost executor costs a
    round at most and the plan stays short. Minima are summed up before the shuffle; the joins are plain ones that
    adaptive execution splits where a hub holds many edges. Edges with a null end and loops are left out, repeated edges
    count once, and no edges give no rows.
    """
    hi, lo = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(hi.alias("hi"), lo.alias("lo"))
    now, before = cut(now.distinct(), "edges"), None
    while (mark := now.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("lo", "hi") % 1000003)).first()) != before:
        before = mark
        if not mark[0]:
            break
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "large")
        small = large.join(large.groupBy("hi").agg(F.min("lo").alias("m")), "hi")
        small = small.select("hi", F.col("m").alias("lo")).union(small.where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
        new = cut(small.distinct(), "edges")
        discard(large)
        discard(now)
        now = new
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
