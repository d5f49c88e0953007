"""Nearest neighbours by cosine: a graph by NN-descent, queries by greedy search on it.

The graph begins with exact neighbours within small groups, made by the signs of random
projections (several times, each vector once a time). Then, in each round, a vector and all its
neighbours, in either direction, are shown to each other: a join brings their vectors together, once
for all vectors of a group, and each learns of all others that are nearer than its farthest. Only
pairs meet of which one at least is a neighbour since the round before; the others have met. Rounds
end when they change one edge in a thousand or less. A query keeps the `beam` nearest found so far; in each step the
`width` nearest of those that have not yet shown their neighbours do so, until all of them have.
All cosines are those of the original components. Equal vectors are one node.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenum.llm.common import discard, save
from plenum.llm.vectors import matrix, units, valid

TIE = 1e-12  # more than the rounding of a cosine in double precision
EDGES = "id long, other long, s double"


def small(column, kind: str) -> np.ndarray:
    """Unit vectors of rows of bytes; kind: the type of their components, that of the table."""
    rows = column.to_pylist()
    return units(np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)) if rows else np.zeros((0, 1))


def edges(ids: np.ndarray, x: np.ndarray, worst: np.ndarray, new: np.ndarray | None = None, most: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows that are nearer than the first one's worst known: id, other, cosine.

    new: only pairs of which one at least is new. most: so many of each row at most, the nearest.
    """
    fresh = np.arange(len(ids)) if new is None else np.flatnonzero(new)
    s = x[fresh] @ x.T
    s[np.arange(len(fresh)), fresh] = -2
    if most and len(ids) > most + 1:  # exactly `most` of each row, also where many tie
        j = np.argpartition(-s, most - 1, 1)[:, :most].ravel()
        i = np.repeat(np.arange(len(fresh)), most)
        near = s[i, j] > worst[fresh[i]]
        i, j = i[near], j[near]
    else:
        i, j = np.nonzero(s > worst[fresh][:, None])
    found = [(ids[fresh[i]], ids[j], s[i, j])]
    if new is not None and len(fresh) < len(ids):
        known = np.flatnonzero(~new)
        i, j = np.nonzero(s[:, known] > worst[known][None, :])
        found.append((ids[known[j]], ids[fresh[i]], s[i, known[j]]))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def nearest(parts: list[tuple], k: int) -> list[tuple]:
    """Of all pairs of a task each once, and of each id the k nearest others: what a merge of all tasks would keep of them."""
    if not parts:
        return []
    i, j, s = (np.concatenate([p[c] for p in parts]) for c in range(3))
    order = np.lexsort((j, i))
    i, j, s = i[order], j[order], s[order]
    once = np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1])]) if len(i) else np.zeros(0, bool)
    i, j, s = i[once], j[once], s[once]
    order = np.lexsort((j, -s, i))
    i, j, s = i[order], j[order], s[order]
    begin = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, int)
    place = np.arange(len(i)) - np.repeat(begin, np.diff(np.append(begin, len(i))))
    return [(i[place < k], j[place < k], s[place < k])]


def flat(parts: list[tuple]) -> pa.Table:
    return pa.table([pa.array(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0), t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["id", "other", "s"])


def merged(rows: DataFrame, k: int) -> DataFrame:
    """EDGES and `born` of any number to the k nearest others of each id, each once, as first born."""
    once = rows.groupBy("id", "other").agg(F.max("s").alias("s"), F.min("born").alias("born"))
    return once.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("s"), "other"))).where(F.col("r") <= k).drop("r")


def graph(nodes: DataFrame, kind: str, k: int = 32, tables: int = 3, group: int = 400, seed: int = 3, delta: float = 0.001) -> DataFrame:
    """nodes(id, q) to EDGES: about the k nearest others of each, by NN-descent. q, kind: see small."""
    n = nodes.count()
    bits = max(0, math.ceil(math.log2(max(n, 1) / group)))

    def deal(batches):
        for batch in batches:
            x = small(batch.column(1), kind)
            rng = np.random.default_rng(seed)
            for t in range(tables if bits else 1):
                code = (x @ rng.normal(0, 1, (x.shape[1], max(bits, 1))) > 0) @ (1 << np.arange(max(bits, 1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t)), pa.array(code.astype(np.int64) * bool(bits)), batch.column(0), batch.column(1)], ["t", "code", "id", "q"])

    dealt = save(nodes.select("id", "q").mapInArrow(deal, "t long, code long, id long, q binary"), "dealt")
    sizes = dealt.groupBy("t", "code").agg(F.count("*").alias("n"))
    dealt = dealt.join(sizes, ["t", "code"]).withColumn("part", F.pmod(F.xxhash64("id", "t"), F.ceil(F.col("n") / (2 * group))))

    def exact(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        return flat([edges(ids, small(table["q"], kind), np.full(len(ids), -1.5), most=k)])

    first = dealt.select("t", "code", "part", "id", "q").groupBy("t", "code", "part").applyInArrow(exact, EDGES)
    known = save(merged(first.withColumn("born", F.lit(0)), k), "graph")
    home = save(dealt.where("t = 0").select("id", "code", "part"), "homes")
    r, changed = 0, n * k
    while bits and changed > delta * n * k:
        r += 1
        ways = known.select("id", "other", (F.col("born") == r - 1).alias("new"))
        back = ways.select(F.col("other").alias("id"), F.col("id").alias("other"), "new")
        back = back.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("new"), F.xxhash64("other", F.lit(r)), "other"))).where(F.col("r") <= k).drop("r")
        worst = known.groupBy("id").agg(F.when(F.count("*") >= k, F.min("s")).otherwise(-1.5).alias("worst"))
        shown = nodes.join(worst, "id", "left").select(F.col("id").alias("other"), "q", F.coalesce("worst", F.lit(-1.5)).alias("worst"))
        both = ways.union(back).union(nodes.select("id", F.col("id").alias("other"), F.lit(False).alias("new"))).groupBy("id", "other").agg(F.max("new").alias("new"))
        shows = both.where("new").select("id").distinct()  # where no edge is new, all pairs have met before
        around = save(both.join(shows, "id").join(home, "id"), "around")
        brought = around.select("code", "part", "other").distinct().join(shown, "other").select(F.col("code").alias("code2"), F.col("part").alias("part2"), F.col("other").alias("node"), "worst", "q")

        def meet(table: pa.Table, given: pa.Table) -> pa.Table:
            ids, worst = given["node"].to_numpy(), given["worst"].to_numpy()
            if not table.num_rows or not len(ids):
                return flat([])
            x, sort = small(given["q"], kind), np.argsort(ids)
            at = table["id"].to_numpy()
            place = sort[np.searchsorted(ids[sort], table["other"].to_numpy())]
            order = np.argsort(at, kind="stable")
            new = table["new"].to_numpy()[order]
            cuts = np.flatnonzero(np.diff(at[order])) + 1
            groups = zip(np.split(place[order], cuts), np.split(new, cuts))
            held = []
            for own, fresh in groups:
                held.append(edges(ids[own], x[own], worst[own], fresh))
                if sum(len(p[0]) for p in held) > 1 << 20:
                    held = nearest(held, k)
            return flat(nearest(held, k))

        learned = around.select("code", "part", "id", "other", "new").groupBy("code", "part").cogroup(brought.groupBy("code2", "part2")).applyInArrow(meet, EDGES)
        before, known = known, save(merged(known.union(learned.withColumn("born", F.lit(r))), k), "graph")
        changed = known.where(F.col("born") == r).count()
        discard(before, around)
    return known.drop("born")


def search(vectors: DataFrame, queries: str, k: int = 5, beam: int = 192, degree: int = 32, width: int = 32) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that the condition `queries` picks.

    score is the cosine of the original vectors in double precision; ties go to the smaller
    vec_id; a query is no candidate of its own. Vectors that do not count (see `vectors.valid`)
    take no part. Only vectors of one length are compared: each length has a graph of its own.
    Repeated vec_ids: the one with the least vector stands. Fewer candidates than k: all that are
    found. An empty table gives an empty result; other columns are not looked at.
    """
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    rows = save(valid(vectors).groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    lengths = sorted(r[0] for r in rows.select(F.size("v")).distinct().collect())  # as many as there are kinds of vectors
    if len(lengths) < 2:
        return searched(rows, kind, queries, k, beam, degree, width)
    found = [searched(rows.where(F.size("v") == n), kind, queries, k, beam, degree, width) for n in lengths]
    return functools.reduce(DataFrame.union, found)


def searched(rows: DataFrame, kind: str, queries: str, k: int, beam: int, degree: int, width: int) -> DataFrame:
    """search() among rows(vec_id, v) of one length."""
    stands = save(rows.groupBy("v").agg(F.min("vec_id").alias("id")), "nodes")
    members = save(rows.join(stands, "v").select("vec_id", "id"), "members")

    def shrink(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in matrix(b.column(1)).astype(kind)], pa.binary())], ["id", "q"])

    shrunk = save(stands.select("id", "v").mapInArrow(shrink, "id long, q binary"), "shrunk")
    near = graph(shrunk, kind, degree)
    asked = members.where(queries).select(F.col("vec_id").alias("query"), "id")
    vector = stands.select("id", "v")
    places = max(1, math.ceil(shrunk.count() / 4096))
    place = F.pmod(F.xxhash64("other"), F.lit(places))
    homes = save(shrunk.select(F.col("id").alias("other"), "q").withColumn("home", place), "homes")

    def measure(pairs: DataFrame, worst: DataFrame) -> DataFrame:
        """Of pairs(node, other) those nearer than the node's `worst`, with their cosine: a node's vector goes once to each place where others of its pairs live."""
        asks = pairs.withColumn("place", place).groupBy("node", "place").agg(F.collect_list("other").alias("others"))
        asks = asks.join(worst, "node").join(shrunk.select(F.col("id").alias("node"), F.col("q").alias("vn")), "node")

        def cosines(table: pa.Table, given: pa.Table) -> pa.Table:
            parts = []
            if table.num_rows and given.num_rows:
                ids, y = given["other"].to_numpy(), small(given["q"], kind)
                order = np.argsort(ids)
                for node, others, least, x in zip(table["node"].to_pylist(), table["others"].to_pylist(), table["worst"].to_pylist(), small(table["vn"], kind)):
                    others = np.array(others)
                    c = y[order[np.searchsorted(ids[order], others)]] @ x
                    parts.append((np.full(int((c > least).sum()), node), others[c > least], c[c > least]))
            return flat(parts).rename_columns(["node", "other", "s"])

        return asks.groupBy("place").cogroup(homes.groupBy("home")).applyInArrow(cosines, "node long, other long, s double")

    # greedy search from the query's own node: the nearest so far show their neighbours
    nodes = asked.select(F.col("id").alias("node")).distinct()
    best = Window.partitionBy("node").orderBy(F.desc("s"), "other")

    def held(pairs: DataFrame) -> DataFrame:
        """Of pairs(node, other, s, done) the nearest, `beam` of them; asks: the nearest that have not shown theirs, `width` of them."""
        nearest = pairs.withColumn("r", F.row_number().over(best)).where(F.col("r") <= beam)
        open_ = F.count(F.when(~F.col("done"), 1)).over(best.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return save(nearest.select("node", "other", "s", "done", (~F.col("done") & (open_ <= width)).alias("asks")), "found")

    found = held(nodes.join(near.withColumnRenamed("id", "node"), "node").select("node", "other", "s", F.lit(False).alias("done")))
    while not (asking := found.where("asks").select("node", "other")).isEmpty():
        steps = asking.join(near.select(F.col("id").alias("other"), F.col("other").alias("next")), "other").where("node <> next").select("node", F.col("next").alias("other")).distinct()
        worst = found.groupBy("node").agg(F.when(F.count("*") >= beam, F.min("s")).otherwise(-1.5).alias("worst"))
        more = measure(steps.join(found, ["node", "other"], "left_anti"), worst).withColumn("done", F.lit(False))
        before, found = found, held(found.select("node", "other", "s", (F.col("done") | F.col("asks")).alias("done")).unionByName(more))
        discard(before)
    # all that are not farther than the k-th by more than the error of these cosines: ties are told apart below
    last = F.min(F.when(F.col("r") <= k, F.col("s"))).over(Window.partitionBy("node"))
    top = found.withColumn("r", F.row_number().over(best)).withColumn("last", last).where(F.col("s") >= F.col("last") - TIE).select("node", "other", "s")
    top = top.union(nodes.select("node", F.col("node").alias("other"), F.lit(1.0).alias("s")))
    # equal vectors: of each node its k + 1 least members can be among the answers
    least = members.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))).where(F.col("r") <= k + 1).select(F.col("id").alias("other"), "vec_id")
    answers = asked.withColumnRenamed("id", "node").join(top.join(least, "other"), "node").where("vec_id <> query")
    full = answers.select("query", "vec_id", "node", "other").join(vector.select(F.col("id").alias("node"), F.col("v").alias("a")), "node").join(vector.select(F.col("id").alias("other"), F.col("v").alias("b")), "other")

    def score(batches):
        for b in batches:
            x, y = matrix(b.column(2)), matrix(b.column(3))
            x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
            s = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], ["query_id", "vec_id", "score"])

    scored = full.select("query", "vec_id", "a", "b").mapInArrow(score, "query_id long, vec_id long, score double")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
