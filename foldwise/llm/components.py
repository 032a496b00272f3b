"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.workspace import materialize

MAX_ROUNDS = 60


def _starred(edges: DataFrame) -> DataFrame:
    """Large star, then small star: every node is hung to the least node it knows of."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("least"))
    large = (
        both.where("dst > src")
        .join(least, "src")
        .select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    )
    least = large.groupBy("src").agg(F.min("dst").alias("least"))
    joined = large.join(least, "src")
    return (
        joined.where("dst > least")
        .select(F.col("dst").alias("src"), F.col("least").alias("dst"))
        .union(least.select("src", F.col("least").alias("dst")))
        .where("src > dst")
        .distinct()
    )


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(src, dst)``; the least node names it.

    Rows with a NULL end and links of a node to itself are left out. Each round is written to the
    shared folder, so that lineage stays short and a lost executor costs a re-read. Rounds grow
    with the logarithm of the longest chain.
    """
    given = links.where("src is not null and dst is not null")
    oriented = given.select(
        F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")
    )
    edges = materialize(oriented.where("src > dst").distinct(), "links")
    state = None
    for _ in range(MAX_ROUNDS):
        edges = materialize(_starred(edges), "stars")
        seen = edges.agg(
            F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))
        ).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    hung = edges.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    roots = edges.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return hung.union(roots)
