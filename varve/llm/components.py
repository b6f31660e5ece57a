"""Connected components of an edge table by alternating star contractions.

Large-star and small-star steps (Kiveris et al. 2014) rewrite the edges until
each component is a star around its least node; the number of rounds grows with
the logarithm of the size.  Nothing is gathered on the driver but two numbers a
round.  Joins hash the node once more, so that both sides are shuffled and
adaptive execution can split a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.durable import durable


def _least(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return edges.join(least, (F.xxhash64("u") == F.xxhash64("w")) & (F.col("u") == F.col("w"))).select("u", "v", "m")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``edges(u, v)``; the label is the least node of its component.

    Loops and repeated edges are allowed; no edges give no rows.
    """
    e = durable(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _least(large)
        pairs = F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))
        e = durable(
            small.select(F.explode(pairs).alias("p")).select(F.col("p.a").alias("u"), F.col("p.b").alias("v")).filter("u <> v").distinct()
        )
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if now == last or now[0] == 0:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    labelled = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labelled.union(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
