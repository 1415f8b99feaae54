"""Connected components of a link table, by alternating star steps over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: hang neighbours (the larger ones, or the smaller ones with the node itself) on the least of them."""
    if large:
        sides = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = sides.join(least, "a")
    moved = joined.filter(F.col("b") > F.col("a")) if large else joined
    out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.union(least.select("a", F.col("m").alias("b")))
    return out.filter("a != b").distinct()


#: Edges in one file of the written tables.
FILE_EDGES = 200_000


def components(links: DataFrame, a: str = "a", b: str = "b", files: int | None = None) -> DataFrame:
    """Node and its component (the least node in it), for every node that has a link to another.

    ``links`` are undirected pairs; repeated pairs and loops are fine, pairs
    with a null end are left out. Rounds are logarithmic in the number of
    nodes for chains and few for stars; a hub's rows are only aggregated or
    joined, which adaptive execution splits. Nothing is collected but one
    count and checksum per round, which also says how many files the next
    round writes. ``files`` gathers the links of many small tasks into as many
    files at first.
    """
    first = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a != b")
    edges = materialise(first.repartition(files) if files else first, "links")
    sign = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"))
    last, n = None, edges.count()
    while True:
        edges = materialise(_star(_star(edges, True), False).coalesce(-(-n // FILE_EDGES) or 1), "stars")
        now = tuple(edges.agg(sign.alias("s")).first()["s"])
        if now == last or not now[0]:
            break
        last, n = now, now[0]
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
