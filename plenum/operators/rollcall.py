"""Membership, counts, cohesion, agreement, loyalty and attendance of members and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenum.operators import pairs
from plenum.plans.model import Model
from plenum.session import saved

ACTIVE = "option IN (1, 2, 3)"
SUBSTANTIAL = "procedural IS NOT TRUE"  # unknown counts as substantial


def open_end() -> Column:
    """What stands for the end of a membership or term that has none."""
    return F.lit("9999-12-31").cast("date")


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def term_votes(m: Model) -> DataFrame:
    """Votes that are valid or of unknown validity, with term and day. Sessions are few and broadcast by size."""
    return m.votes.where("valid IS NOT FALSE").join(m.sessions, "session_id")


def cast_votes(m: Model) -> DataFrame:
    """The fact, scanned once, with what is known of its vote."""
    return m.member_votes.where(ACTIVE).join(term_votes(m), "vote_id")


def spans(spells: DataFrame, days: DataFrame) -> DataFrame:
    """spells(d_from, d_to, ...; no d_to: open) with `low` and `high`: the numbers (from 1) of the first and last of days(day, distinct) within.

    The ends of the spells and the days are united, sorted and swept once, as distinct dates: at
    most a row a calendar day, however many spells there are. Spells without a day have high < low.
    """
    ends = F.explode(F.array("d_from", F.date_add(F.coalesce("d_to", open_end()), 1)))
    dates = spells.select(ends.alias("date")).distinct().select("date", F.lit(0).alias("is_day")).union(days.select("day", F.lit(1)))
    dates = dates.where("date IS NOT NULL").groupBy("date").agg(F.max("is_day").alias("is_day"))
    swept = dates.withColumn("before", F.sum("is_day").over(Window.orderBy("date")) - F.col("is_day"))
    low, high = (swept.select(F.col("date").alias(f"{c}_date"), F.col("before").alias(f"{c}_n")) for c in ("low", "high"))
    both = spells.withColumn("low_date", F.col("d_from")).withColumn("high_date", F.date_add(F.coalesce("d_to", open_end()), 1))
    return both.join(low, "low_date").join(high, "high_date").withColumn("low", F.col("low_n") + 1).withColumnRenamed("high_n", "high").drop("low_date", "high_date", "low_n")


def affiliation(m: Model, kind: str = "group", variant: str = "date") -> DataFrame:
    """session_id, member_id, subject_id at each session day.

    variant date: the day lies within the membership; term_or_start: and the membership is of
    the session's term or began after that term did. Two memberships of a kind on one day give
    two rows. A membership covers a run of numbered session days, so sessions are joined by the
    number of their day: as many keys as days, no candidate that does not fit.
    """
    kinds = F.col("kind") == "group" if kind == "group" else F.col("kind") != "group"
    days = m.sessions.select("day").where("day IS NOT NULL").distinct()
    spells = spans(m.memberships.where(kinds), days).where("low <= high").withColumnRenamed("term", "own_term")
    numbered = m.sessions.join(days.withColumn("no", F.row_number().over(Window.orderBy("day")).cast("long")), "day")  # a row a calendar day at most
    found = spells.withColumn("no", F.explode(F.sequence("low", "high"))).join(numbered, "no")
    if variant == "term_or_start":
        found = found.join(m.terms.select("term", F.col("d_from").alias("begun")), "term").where((F.col("own_term") == F.col("term")) | (F.col("d_from") >= F.col("begun")))
    return found.select("session_id", "member_id", "subject_id").distinct()


def with_subject(votes: DataFrame, at: DataFrame, how: str = "inner") -> DataFrame:
    return votes.join(at, ["session_id", "member_id"], how)


def with_plurality(votes: DataFrame) -> DataFrame:
    """votes with `plurality`: of their vote and subject the most frequent option of substantial votes, the lowest of ties, null if there are none.

    Three counts over one window, so that a vote meets its plurality in one shuffle.
    """
    own = Window.partitionBy("vote_id", "subject_id")
    n1, n2, n3 = (F.count_if((F.col("option") == k) & F.expr(SUBSTANTIAL)).over(own) for k in (1, 2, 3))
    top = F.when((n1 >= n2) & (n1 >= n3), F.when(n1 > 0, 1)).when(n2 >= n3, 2).otherwise(3)
    return votes.withColumn("plurality", top)


def group_votes(m: Model) -> DataFrame:
    """Cast votes with the member's group on that day and the group's plurality; from prepared tables if the model has them."""
    return m.prepared() if m.prepared else with_plurality(with_subject(cast_votes(m), affiliation(m)))


def vote_counts(votes: DataFrame, include_procedural: bool = False) -> DataFrame:
    return (votes if include_procedural else votes.where(SUBSTANTIAL)).groupBy("vote_id", "subject_id", "option").agg(F.count("*").alias("n"))


def plurality(votes: DataFrame) -> DataFrame:
    """vote_id, subject_id, plurality: the most frequent option, the lowest of ties."""
    if "plurality" in votes.columns:
        return votes.where(SUBSTANTIAL).groupBy("vote_id", "subject_id").agg(F.min("plurality").alias("plurality"))
    return vote_counts(votes).groupBy("vote_id", "subject_id").agg(F.max_by("option", F.struct("n", -F.col("option"))).alias("plurality"))


def term_of(m: Model, days: DataFrame) -> DataFrame:
    """days(day) with the first term that it lies in."""
    t = m.terms.select(F.col("term").alias("in_term"), "d_from", "d_to")
    hit = days.join(F.broadcast(t), F.col("day").between(F.col("d_from"), F.coalesce("d_to", open_end())), "left")  # a row a term
    return hit.groupBy("day").agg(F.min_by("in_term", F.struct("d_from", "in_term")).alias("term_found"))


def current_affiliation(m: Model) -> DataFrame:
    """The membership of each kind in force that began last, in each term; an open term lasts five years."""
    t = m.terms.select(F.col("term").alias("t"), F.col("d_from").alias("t_from"), F.coalesce("d_to", F.add_months("d_from", 60)).alias("t_to"))
    over = m.memberships.join(F.broadcast(t), (F.col("d_from") <= F.col("t_to")) & (F.coalesce("d_to", open_end()) >= F.col("t_from")))
    last = over.withColumn("r", F.row_number().over(Window.partitionBy("t", "member_id", "kind").orderBy(F.desc("d_from"), "subject_id")))
    return last.where("r = 1").select(F.col("t").alias("term"), "member_id", "kind", "subject_id")


def attendance(m: Model, recorded: DataFrame | None = None) -> DataFrame:
    """Present: any vote in the session. Absent: a membership that day, and no vote.

    Sessions in recorded(session_id) have their attendance already and give no rows.
    """
    present = m.member_votes.join(m.votes.select("vote_id", "session_id"), "vote_id").select("session_id", "member_id").distinct()
    due = affiliation(m, "group").union(affiliation(m, "national")).select("session_id", "member_id").distinct()
    absent = due.join(present, ["session_id", "member_id"], "left_anti")
    both = present.withColumn("status", F.lit("present")).unionByName(absent.withColumn("status", F.lit("absent")))
    return both if recorded is None else both.join(recorded.select("session_id").distinct(), "session_id", "left_anti")


def present_count(m: Model) -> DataFrame:
    n = attendance(m).groupBy("session_id").agg(F.count_if(F.col("status") == "present").alias("present"))
    return m.sessions.join(n, "session_id", "left").select("session_id", F.coalesce("present", F.lit(0)).alias("present"))


def participation(m: Model) -> DataFrame:
    by = attendance(m).groupBy("member_id").agg(F.count_if(F.col("status") == "present").alias("present"), F.count("*").alias("total"))
    return by.withColumn("ratio", F.round(F.col("present") / F.col("total"), 4))


def histogram(values: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """bin (0 to bins - 1), n; empty bins count 0, the value 1 is in the last."""
    spark = values.sparkSession
    n = values.where(F.col(value).isNotNull()).groupBy(F.least(F.lit(bins - 1), F.floor(F.col(value) * bins)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return spark.range(bins).withColumnRenamed("id", "bin").join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def member_stats(m: Model) -> DataFrame:
    """term, member_id, subject_id (null: none), option, n."""
    return with_subject(cast_votes(m), affiliation(m), "left").groupBy("term", "member_id", "subject_id", "option").agg(F.count("*").alias("n"))


def subject_stats(m: Model) -> DataFrame:
    """Groups rolled up from the member counts, national parties from the fact."""
    groups = member_stats(m).groupBy("term", "subject_id", "option").agg(F.sum("n").alias("n"))
    parties = with_subject(cast_votes(m), affiliation(m, "national")).groupBy("term", "subject_id", "option").agg(F.count("*").alias("n"))
    return groups.unionByName(parties)


def by_option(stats: DataFrame, *keys: str) -> DataFrame:
    """Counts for, against, abstain and in total."""
    n = lambda k: F.sum(F.when(F.col("option") == k, F.col("n")).otherwise(0))
    return stats.groupBy(*keys).agg(n(1).alias("n_for"), n(2).alias("n_against"), n(3).alias("n_abstain"), F.sum("n").alias("total"))


def main_subject(stats: DataFrame, *keys: str) -> DataFrame:
    """The subject with most votes of each key; ties to the lowest."""
    n = stats.where("subject_id IS NOT NULL").groupBy(*keys, "subject_id").agg(F.sum("n").alias("n"))
    return n.groupBy(*keys).agg(F.max_by("subject_id", F.struct("n", -F.col("subject_id"))).alias("main_subject"))


def pooled_cohesion(votes: DataFrame) -> DataFrame:
    """(most - half of the others) / all * 100, over all votes of a subject in a session, procedural ones too."""
    y, n, a = (F.count_if(F.col("option") == k).cast("double").alias(c) for k, c in ((1, "y"), (2, "n"), (3, "a")))
    counted = votes.groupBy("session_id", "subject_id").agg(y, n, a)
    most, total = F.greatest("y", "n", "a"), F.col("y") + F.col("n") + F.col("a")
    return counted.withColumn("cohesion", (most - 0.5 * (total - most)) / total * 100)


def party_cohesion(m: Model) -> DataFrame:
    by = pooled_cohesion(group_votes(m)).join(m.sessions, "session_id").groupBy("term", "subject_id")
    return by.agg(F.round(F.avg("cohesion"), 4).alias("ai"), F.count("*").alias("sessions"))


def country_cohesion(m: Model) -> DataFrame:
    """Mean over votes with two or more voters of the plurality's share, in percent."""
    voters = cast_votes(m).where(SUBSTANTIAL).join(m.members, "member_id").where("country IS NOT NULL")
    n = voters.groupBy("term", "country", "vote_id").agg(*(F.count_if(F.col("option") == k).alias(c) for k, c in ((1, "y"), (2, "n"), (3, "a"))))
    total = F.col("y") + F.col("n") + F.col("a")
    ai = n.where(total >= 2).groupBy("term", "country").agg(F.round(F.avg(F.greatest("y", "n", "a") / total * 100), 4).alias("ai"), F.count("*").alias("votes"))
    return ai.join(voters.groupBy("term", "country").agg(F.countDistinct("member_id").alias("mep_count")), ["term", "country"])


def group_agreement(m: Model) -> DataFrame:
    """Share of votes in which two groups have the same plurality; groups are few."""
    p = group_votes(m).where(SUBSTANTIAL).groupBy("term", "vote_id", "subject_id").agg(F.min("plurality").alias("plurality"))
    a, b = (p.select("term", "vote_id", F.col("subject_id").alias(f"subject{k}"), F.col("plurality").alias(f"p{k}")) for k in "12")
    pairs = a.join(b, ["term", "vote_id"]).where("subject1 < subject2").groupBy("term", "subject1", "subject2")
    return pairs.agg(F.count_if(F.col("p1") == F.col("p2")).alias("agreed"), F.count("*").alias("total")).withColumn("agreement", F.round(F.col("agreed") / F.col("total"), 4))


def agreement_matrix(m: Model) -> DataFrame:
    """Both directions and the diagonal."""
    a = group_agreement(m).select("term", "subject1", "subject2", "agreement")
    back = a.select("term", F.col("subject2").alias("subject1"), F.col("subject1").alias("subject2"), "agreement")
    own = a.union(back).select("term", "subject1").distinct().select("term", "subject1", F.col("subject1").alias("subject2"), F.lit(1.0).alias("agreement"))
    return a.union(back).union(own)


def loyalty(votes: DataFrame, *more: str) -> DataFrame:
    """Votes equal to the group's plurality; more: further keys, which do not change the plurality."""
    with_p = (votes if "plurality" in votes.columns else with_plurality(votes)).where(SUBSTANTIAL)
    by = with_p.groupBy("member_id", "subject_id", "term", *more).agg(F.count("*").alias("total"), F.count_if(F.col("option") == F.col("plurality")).alias("loyal"))
    return by.withColumn("loyalty", F.round(F.col("loyal") / F.col("total"), 4))


def government_loyalty(m: Model) -> DataFrame:
    """Loyalty to the group, apart for years in which the national party governed (from <= year < to)."""
    year = lambda c: F.left(F.col(c), F.lit(4)).try_cast("int")
    spells = m.government.select(F.col("subject_id").alias("party"), year("year_from").alias("y0"), F.coalesce(year("year_to"), F.lit(9999)).alias("y1"))
    at = affiliation(m, "national").withColumnRenamed("subject_id", "party").join(m.sessions, "session_id").withColumn("year", F.year("day"))
    governs = at.join(spells, (at["party"] == spells["party"]) & (F.col("y0") <= F.col("year")) & (F.col("year") < F.col("y1")), "left").groupBy("session_id", "member_id", at["party"]).agg(F.max(F.col("y0").isNotNull()).alias("in_government"))
    tagged = group_votes(m).where(SUBSTANTIAL).join(governs, ["session_id", "member_id"])
    by = tagged.groupBy("member_id", "subject_id", "term", "in_government").agg(F.count("*").alias("total"), F.count_if(F.col("option") == F.col("plurality")).alias("loyal"))
    return by.withColumn("loyalty", F.round(F.col("loyal") / F.col("total"), 4))


def compare_members(m: Model, one: int, two: int, include_procedural: bool = True) -> DataFrame:
    """The votes that both cast."""
    votes = cast_votes(m) if include_procedural else cast_votes(m).where(SUBSTANTIAL)
    a, b = (votes.where(F.col("member_id") == k).select("vote_id", "topic", F.col("option").alias(f"option{i}")) for i, k in ((1, one), (2, two)))
    return a.join(b.drop("topic"), "vote_id").withColumn("agree", F.col("option1") == F.col("option2"))


def member_pairs(votes: DataFrame, *view: str, min_common: int = 10, top: int = 5000, method: str = "measured") -> DataFrame:
    """All pairs of members: agreeing votes, common votes, percent; the `top` of each view.

    method join: members who voted meet by lists of voters, best where few vote; tiles: blocks of
    members and votes multiplied, see `pairs`; measured: whichever the density of the votes asks for.
    """
    votes = saved(votes.where(SUBSTANTIAL).groupBy(*view, "vote_id", "member_id").agg(F.min("option").alias("option")), "votes")
    if method == "measured":
        method = "join" if pairs.sparse(votes, *view) else "tiles"
    counts = pairs.listed_counts if method == "join" else pairs.tiled_counts
    n = counts(votes, *view, least=min_common, top=top)
    n = n.where(F.col("common") >= min_common).withColumn("pct", F.round(F.col("agree") * 100.0 / F.col("common"), 1))
    rank = F.row_number().over(Window.partitionBy(*view).orderBy(F.desc("pct"), F.desc("common"), "member1", "member2"))
    return n.withColumn("rank", rank).where(F.col("rank") <= top)


def counts_before(votes: DataFrame, keys: list[str], block: list[Column], order: list[str], options: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """votes with c1, c2, c3: how many votes of each option the keys have before, in the order of `block` and `order`.

    Counted within blocks, carried from block to block, and added: one key's history of any length
    is dealt over as many tasks as it has blocks. block: columns that ascend with the order.
    """
    names = [f"_b{k}" for k in range(len(block))]
    rows = votes.withColumns(dict(zip(names, block)))
    n = lambda k: F.count_if(F.col("option") == k)
    within = Window.partitionBy(*keys, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, *names).agg(*(n(k).alias(f"s{k}") for k in options))
    carried = sums.select(*keys, *names, *(F.coalesce(F.sum(f"s{k}").over(earlier), F.lit(0)).alias(f"s{k}") for k in options))
    rows = rows.withColumns({f"c{k}": n(k).over(within) for k in options})
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*keys, *names)]
    both = rows.alias("l").join(carried.alias("r"), same)
    return both.select(*(F.col(f"l.{c}") for c in votes.columns), *((F.col(f"l.c{k}") + F.col(f"r.s{k}")).alias(f"c{k}") for k in options))


def anomalies(m: Model, final_only: bool = True, least: int = 5, block: int = 4096) -> DataFrame:
    """Votes against the member's own plurality so far (`least` earlier votes or more) and against the group's.

    A member's history is counted in blocks of a day and a run of `block` vote ids.
    """
    votes = group_votes(m).where(SUBSTANTIAL)
    votes = votes.where("final IS TRUE") if final_only else votes
    votes = counts_before(votes, ["term", "member_id"], [F.col("day"), F.floor(F.col("vote_id") / block)], ["vote_id", "subject_id"])
    own = F.when((F.col("c1") >= F.col("c2")) & (F.col("c1") >= F.col("c3")), 1).when(F.col("c2") >= F.col("c3"), 2).otherwise(3)
    judged = votes.withColumn("own", own)
    odd = (F.col("c1") + F.col("c2") + F.col("c3") >= least) & (F.col("option") != F.col("own")) & (F.col("option") != F.col("plurality"))
    return judged.withColumn("anomalous", odd)
