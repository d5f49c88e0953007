"""Agreement of all pairs of members: tiles of members and votes multiplied, or lists of voters met where votes are sparse.

Either way a task has all that two blocks of members, or one and the others, have in common, unless
that is more than it may hold; so most pairs leave it with their last counts, and those that are
under `least` or beyond the `top` of a view need not leave it at all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenum.operators.resample import numbered
from plenum.session import saved


def sparse(votes: DataFrame, *view: str, speed: int = 200) -> bool:
    """Are lists of voters cheaper than tiles? Pairs that the lists make against pairs of members times votes, of which tiles do `speed` in the time of a row.

    Measured over all views: the sum over votes of voters squared, and members squared times votes.
    """
    of_vote = votes.groupBy(*view, "vote_id").agg(F.count("*").alias("n"))
    of_view = of_vote.groupBy(*view).agg(F.sum(F.col("n") * F.col("n")).cast("double").alias("made"), F.count("*").cast("double").alias("votes"))
    members = votes.groupBy(*view).agg(F.approx_count_distinct("member_id").cast("double").alias("members"))
    both = of_view.join(members, list(view)) if view else of_view.crossJoin(members)  # one row each
    row = both.agg(F.sum("made"), F.sum(F.col("members") * F.col("members") * F.col("votes"))).first()
    return (row[0] or 0) * speed < (row[1] or 0)


FEW = 1 << 19  # rows of numbers that every task may hold
RUN = 1 << 20


def sent(df: DataFrame) -> DataFrame:
    """A table of numbers, sent to all tasks if it is small; Spark would go by the size of its files."""
    return F.broadcast(df) if df.count() <= FEW else df


def under(df: DataFrame, view: list[str], *names: str) -> DataFrame:
    """df with these numbers from 0 in each view."""
    if not view:
        return df
    lows = df.groupBy(*view).agg(*(F.min(c).alias(f"_{c}") for c in names))
    return df.join(lows, view).withColumns({c: F.col(c) - F.col(f"_{c}") for c in names}).drop(*(f"_{c}" for c in names))


def kept(m1: np.ndarray, m2: np.ndarray, agree: np.ndarray, common: np.ndarray, least: int, top: int | None) -> list[np.ndarray]:
    """Pairs with `least` common votes, and of these the `top` by percent, rounded half up to a tenth, and so on as `topped`."""
    out = [x[common >= least] for x in (m1, m2, agree, common)]
    if top is None or len(out[0]) <= top:
        return out
    m1, m2, agree, common = out
    tenths = (2000 * agree + common) // (2 * common)
    if len(m1) > 4 * top:  # only those that reach the percent of the last one
        near = np.nonzero(tenths >= np.partition(tenths, -top)[-top])[0]
        m1, m2, agree, common, tenths = (x[near] for x in (m1, m2, agree, common, tenths))
    first = np.lexsort((m2, m1, -common, -tenths))[:top]
    return [x[first] for x in (m1, m2, agree, common)]


def topped(counts: DataFrame, view: list[str], least: int, top: int | None, salt: int = 64) -> DataFrame:
    """counts(view..., m1, m2, agree, common) summed, with `least` common votes, and the `top` of each view, found first in `salt` parts of it."""
    counts = counts.groupBy(*view, "m1", "m2").agg(F.sum("agree").alias("agree"), F.sum("common").alias("common")).where(F.col("common") >= least)
    if top is None:
        return counts
    order = [F.desc(F.round(F.col("agree") * 100.0 / F.col("common"), 1)), F.desc("common"), "m1", "m2"]
    for part in ([F.pmod(F.hash("m1", "m2"), F.lit(salt))], []):
        counts = counts.withColumn("_rank", F.row_number().over(Window.partitionBy(*view, *part).orderBy(*order))).where(F.col("_rank") <= top).drop("_rank")
    return counts


def table(t: pa.Table, view: list[str], found: list[np.ndarray]) -> pa.Table:
    """Rows view..., m1, m2, agree, common of the view that t is of."""
    fixed = [pa.array([t[c][0].as_py()] * len(found[0]), t.schema.field(c).type) for c in view]
    return pa.table([*fixed, *(pa.array(x.astype(np.int64)) for x in found)], names=[*view, "m1", "m2", "agree", "common"])


def schema(votes: DataFrame, view: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in votes.schema}
    return ", ".join([*(f"`{c}` {kinds[c]}" for c in view), "m1 long, m2 long, agree long, common long"])


def named(counts: DataFrame, people: DataFrame, view: list[str]) -> DataFrame:
    """counts with member1 and member2 in place of their numbers, which stand in the same order."""
    keys = [c for c in view if c in people.columns]
    for k in "12":
        counts = counts.join(people.select(*keys, F.col("m").alias(f"m{k}"), F.col("member_id").alias(f"member{k}")), [*keys, f"m{k}"])
    return counts.select(*view, "member1", "member2", "agree", "common")


def voters(votes: DataFrame, people: DataFrame, view: list[str]) -> DataFrame:
    """view..., vote_id, codes: of all who voted, 4 x number + option, ascending."""
    rows = votes.join(sent(people), [c for c in [*view, "member_id"] if c in people.columns])
    return rows.groupBy(*view, "vote_id").agg(F.array_sort(F.collect_list((F.col("m") * 4 + F.col("option")).cast("long"))).alias("codes")).where("size(codes) > 1")


def listed_counts(votes: DataFrame, *view: str, members: int = 256, most: int = 1 << 23, least: int = 1, top: int | None = None) -> DataFrame:
    """votes(view..., vote_id, member_id, option 1 to 3; a row each) to view..., member1 < member2, agree, common.

    Members are numbered by their place in a sort. The list of who voted goes once to each block of
    `members` that has a voter in it, from the block on; there the block's members meet those after
    them. What is more than `most` numbers of a block is dealt over several tasks by vote.
    """
    view = list(view)
    people = numbered(votes.select("member_id").distinct(), "member_id", name="m")
    lists, n = saved(voters(votes, people, view), "voters"), 4 * members
    dealt = lists.withColumn("b", F.explode(F.expr(f"array_distinct(transform(codes, c -> c DIV {n}))"))).withColumn("codes", F.expr(f"filter(codes, c -> c >= b * {n})")).where("size(codes) > 1")
    parts = saved(dealt.groupBy(*view, "b").agg(F.ceil(F.sum(F.size("codes")) / most).alias("parts")), "parts")
    dealt = dealt.join(sent(parts), [*view, "b"]).withColumn("part", F.pmod(F.xxhash64("vote_id"), F.col("parts")))

    def meet(t: pa.Table) -> pa.Table:
        base = t["b"][0].as_py() * members
        lists = t["codes"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        codes, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
        member, option = (codes >> 2) - base, codes & 3
        own = np.nonzero(member < members)[0]
        after = ends[np.searchsorted(ends, own, "right")] - own - 1
        span, upto = int(member.max()) + 1, np.cumsum(after)
        width = members * span
        flat = width <= min(8 * int(upto[-1]), 1 << 22)
        sums, pending, held = np.zeros(2 * width if flat else 0, np.int64), [], 0
        runs = np.unique(np.searchsorted(upto, np.arange(0, int(upto[-1]) + RUN, RUN)).clip(0, len(own)))  # each of a million meetings, or of one member's
        for low, high in zip(runs, [*runs[1:], len(own)]):
            one, times = own[low:high], after[low:high]
            one, starts = np.repeat(one, times), np.repeat(np.cumsum(times) - times, times)
            two = one + 1 + np.arange(len(one)) - starts
            key = (member[one] * span + member[two]) * 2 + (option[one] == option[two])
            if flat:
                sums += np.bincount(key, minlength=2 * width)
                continue
            pending.append(np.unique(key, return_counts=True))
            held += len(pending[-1][0])
            if held > 1 << 23:
                pending = [summed(pending)]
                held = len(pending[0][0])
        if flat:
            pairs = np.nonzero(sums[0::2] + sums[1::2])[0]
            agree, common = sums[1::2][pairs], (sums[0::2] + sums[1::2])[pairs]
        else:
            keys, counts = summed(pending)
            pairs, at = np.unique(keys >> 1, return_inverse=True)
            common = np.bincount(at, counts, len(pairs)).astype(np.int64)
            agree = np.bincount(at, counts * (keys & 1), len(pairs)).astype(np.int64)
        found = [pairs // span + base, pairs % span + base, agree, common]
        return table(t, view, kept(*found, least, top) if t["parts"][0].as_py() == 1 else found)

    counts = dealt.groupBy(*view, "b", "parts", "part").applyInArrow(meet, schema(votes, view))
    return named(topped(counts, view, least, top), people, view)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and their counts of several such, each key once."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def tiled_counts(votes: DataFrame, *view: str, members: int = 1024, width: int = 2048, stack: int = 4, least: int = 1, top: int | None = None) -> DataFrame:
    """votes(view..., vote_id, member_id, option 1 to 3; a row each) to view..., member1 < member2, agree, common.

    Members and votes of a view are numbered by their place in a sort by range, and cut into tiles
    of `members` by `width`, a number for each vote cast. Two blocks of members that share a block of
    votes meet in as many of these at a time as hold the votes of `stack` full ones: there they are
    multiplied, one product for the common votes and one for each option.
    """
    view = list(view)
    people = saved(under(numbered(votes.select(*view, "member_id").distinct(), *view, "member_id", name="m"), view, "m"), "people")
    lists = under(numbered(saved(voters(votes, people, view), "voters"), *view, "vote_id", name="v"), view, "v")
    code, m = F.col("code"), F.shiftright("code", 2)
    cell = (((m % members) * width + F.col("v") % width) * 4 + code.bitwiseAND(3)).cast("int").alias("cell")
    rows = lists.select(*view, "v", F.explode("codes").alias("code")).select(*view, F.expr(f"v DIV {width}").alias("vb"), F.floor(m / members).alias("mb"), cell)
    tiles = saved(rows.groupBy(*view, "vb", "mb").agg(F.collect_list("cell").alias("cells")), "tiles")  # members x width at most
    index = tiles.select(*view, "vb", "mb", F.size("cells").alias("n"))
    largest = index.groupBy(*view, "vb").agg(F.max("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*view).orderBy("vb")) - F.col("n")  # a row a block of votes
    stacks = largest.select(*view, "vb", F.floor(upto / (members * width * stack)).alias("stack"))
    one, two = (index.select(*view, "vb", F.col("mb").alias(f"mb{k}")) for k in "12")
    met = one.join(two, [*view, "vb"]).where("mb1 <= mb2").join(stacks, [*view, "vb"])
    of = Window.partitionBy(*view, "mb1", "mb2")
    met = met.withColumn("alone", F.min("stack").over(of) == F.max("stack").over(of)).withColumn("mb", F.explode(F.array_distinct(F.array("mb1", "mb2"))))
    dealt = tiles.join(sent(saved(met, "met")), [*view, "vb", "mb"])

    def matrix(cells: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
        code = cells.values.to_numpy()
        at, option = code >> 2, code & 3
        rows, row = np.unique(at // width, return_inverse=True)
        out = np.zeros((len(rows), width), np.int8)
        out[row, at % width] = option
        return rows, out

    def multiply(t: pa.Table) -> pa.Table:
        mb1, mb2 = t["mb1"][0].as_py(), t["mb2"][0].as_py()
        of = {}
        for k, (v, mb) in enumerate(zip(t["vb"].to_pylist(), t["mb"].to_pylist())):
            of.setdefault(v, {})[mb] = k
        agree, common = np.zeros((members, members), np.int64), np.zeros((members, members), np.int64)
        for tile in of.values():
            r1, x = matrix(t["cells"][tile[mb1]])
            r2, y = (r1, x) if mb1 == mb2 else matrix(t["cells"][tile[mb2]])
            at = np.ix_(r1, r2)
            by = [(x == o).astype(np.float32) @ (y == o).astype(np.float32).T for o in (1, 2, 3)]
            agree[at] += np.rint(by[0] + by[1] + by[2]).astype(np.int64)
            common[at] += np.rint((x > 0).astype(np.float32) @ (y > 0).astype(np.float32).T).astype(np.int64)
        i, j = np.nonzero(common)
        if mb1 == mb2:
            i, j = i[i < j], j[i < j]
        found = [i + mb1 * members, j + mb2 * members, agree[i, j], common[i, j]]
        return table(t, view, kept(*found, least, top) if t["alone"][0].as_py() else found)

    counts = dealt.groupBy(*view, "stack", "mb1", "mb2", "alone").applyInArrow(multiply, schema(votes, view))
    return named(topped(counts, view, least, top), people, view)
