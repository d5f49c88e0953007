"""Classes of rows that equal keys tie together, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.session import removed, saved


def classes(links: DataFrame, most_rounds: int = 40) -> tuple[DataFrame, int]:
    """links(a, b) to (id, least) with the smallest id that links reach, and the number of rounds.

    A round hangs every larger neighbour of an id on the id's smallest neighbour, then every id on
    the smallest of its smaller neighbours; a chain shortens by a factor each time, so rounds grow
    with its logarithm. Each round is written, the one before removed. Links that are not at rest
    after `most_rounds` raise an error. Ids without a link do not appear; null ends are no links.
    """
    stars = saved(links.where("a <> b").select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("least")).distinct(), "stars")
    before, rounds = None, 0
    while before != (state := stars.agg(F.count("*"), F.sum(F.xxhash64("id", "least").cast("decimal(38,0)"))).first()):
        if rounds == most_rounds:
            raise RuntimeError(f"classes are not at rest after {rounds} rounds")
        before, rounds = state, rounds + 1
        either = stars.union(stars.select("least", "id"))
        lowest = either.groupBy("id").agg(F.min("least").alias("low")).select("id", F.least("id", "low").alias("low"))
        hung = stars.select(F.col("least").alias("id"), F.col("id").alias("larger")).join(lowest, "id").select(F.col("larger").alias("id"), F.col("low").alias("least"))
        hung = hung.distinct()
        lowest = hung.groupBy("id").agg(F.min("least").alias("low"))
        new = hung.join(lowest, "id").select(F.explode(F.array("id", "least")).alias("id"), F.col("low").alias("least")).where("id <> least").distinct()
        last, stars = stars, saved(new, "stars")
        removed(last)
    tops = stars.select(F.col("least").alias("id"), "least").distinct()
    return stars.groupBy("id").agg(F.min("least").alias("least")).union(tops), rounds


def deduplicated(subjects: DataFrame) -> DataFrame:
    """subjects(id, wiki_id, abbr, country) with `canonical`: the least id that equal keys reach.

    Keys are the wiki id and, null countries being equal, abbreviation and country; null wiki ids
    and abbreviations tie nothing. Chains of any length are followed to their end.
    """
    text = lambda c: F.col(c).cast("string")
    keys = F.array(
        F.struct(F.lit("w").alias("kind"), text("wiki_id").alias("a"), F.lit(None).cast("string").alias("b")),
        F.struct(F.lit("a").alias("kind"), text("abbr").alias("a"), text("country").alias("b")),
    )
    ties = subjects.select("id", F.inline(keys)).where("a IS NOT NULL").withColumn("key", F.to_json(F.struct("kind", "a", "b"), {"ignoreNullFields": "false"}))
    low = ties.groupBy("key").agg(F.min("id").alias("low"))
    found, _ = classes(ties.join(low, "key").select(F.col("id").alias("a"), F.col("low").alias("b")))
    return subjects.join(found, "id", "left").withColumn("canonical", F.coalesce("least", "id")).drop("least")


def aliases(subjects: DataFrame, known: DataFrame) -> DataFrame:
    """id, canonical of the subjects that stand for another one and are not among known(id) yet: rows to append to the table of aliases."""
    return deduplicated(subjects).where("id <> canonical").select("id", "canonical").join(known.select("id").distinct(), "id", "left_anti")
