"""Connected components by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import discard, save


def at_rest(edges: DataFrame) -> bool:
    """Are edges(u, v) stars: one v for each u, and no v that is a u?"""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("own"), F.lit(0).alias("top")).union(edges.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("id").agg(F.sum("own").alias("own"), F.max("top").alias("top"))
    return seen.where("own > 1 OR (own > 0 AND top > 0)").isEmpty()


def stars(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """As `components`, without the smallest ids themselves; links are read several times and should be a saved table."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    for _ in range(most_rounds):
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours of u go to u's smallest neighbour
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: u and its smaller neighbours go to the smallest of them
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        last, edges = edges, save(small, "links")
        discard(last)
        if at_rest(edges):
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    raise RuntimeError(f"components are not at rest after {most_rounds} rounds")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links(a, b), any order and repeats, to (id, component): the smallest id that links reach.

    Alternating large-star and small-star steps; each round is written to the shared folder.
    Ids without links do not appear. Empty links give an empty table. A null end is no link.
    Rounds grow with the logarithm of the longest path; if `most_rounds` do not bring the links to
    rest, an error is raised and no component is given.
    """
    given = save(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    found = stars(given, most_rounds)
    discard(given)
    return found.union(found.select(F.col("component").alias("id"), "component").distinct())
