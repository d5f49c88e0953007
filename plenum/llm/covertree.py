"""All pairs of vectors within a cosine threshold, by cover trees and a dual traversal.

Cosines of at least t are distances of unit vectors of at most sqrt(2 - 2 t). The upper levels of a
label's tree are nested sets of its vectors, each some `fan` times the one above: all vectors go
down together, a join a level, each from its centre to the nearest of the centres below that one.
A lowest centre with many vectors has several nodes, so that no node is large. The levels below a
node, radii halving, are made once and stored with it. The tree is traversed against itself in the
same way: pairs of centres whose covering radii leave them within reach go on to the pairs of
their children, by joins down to the nodes. Each pair of nodes that is left is a task, which
descends both trees level by level. Links are counted for every vector, and a spanning forest of
them gives the components; pairs are not written out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import save
from plenum.llm.components import components
from plenum.llm.hashstats import arrow
from plenum.llm.vectors import matrix, units, valid


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def nearest(x: np.ndarray, c: np.ndarray, rows: int = 1024, columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """The place of the nearest of c for each of x, and its distance; no more than rows x columns at once."""
    home, far = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    for i in range(0, len(x), rows):
        for j in range(0, len(c), columns):
            d = distances(x[i : i + rows], c[j : j + columns])
            at = d.argmin(1)
            d = d[np.arange(len(at)), at]
            closer = d < far[i : i + rows]
            home[i : i + rows][closer], far[i : i + rows][closer] = at[closer] + j, d[closer]
    return home, far


class Tree:
    """Nested levels of points: each a prefix of `order`, the last all of them.

    up[k]: for the points of level k + 1 their parents, places in level k; radii[k]: how far the
    points below each point of level k are.
    """

    def __init__(self, x: np.ndarray, order: np.ndarray, up: list[np.ndarray], radii: list[np.ndarray]):
        self.x, self.order, self.up, self.radii = x, order, up, radii

    @classmethod
    def grown(cls, x: np.ndarray, floor: float) -> Tree:
        """Points are taken, farthest first; a level ends when all are within half the last radius of one.

        No level has a radius under `floor`; points nearer to each other than that stay below one
        of them. A point once taken is marked by the distance -1, the first like all others.
        """
        n = len(x)
        order, home = [int((x @ x.mean(0)).argmax())], np.zeros(n, np.int64)
        nearest = distances(x, x[order])[:, 0]
        nearest[order[0]] = -1
        goal, sizes, homes = float(nearest.max()) / 2, [1], [home.copy()]
        while len(order) < n and goal >= floor:
            pick = int(nearest.argmax())
            if nearest[pick] <= goal:
                if len(order) > sizes[-1]:
                    sizes.append(len(order))
                    homes.append(home.copy())
                goal /= 2
                continue
            d = distances(x, x[[pick]])[:, 0]
            closer = d < nearest
            closer[pick] = True
            nearest[closer], home[closer] = d[closer], len(order)
            nearest[pick] = -1
            order.append(pick)
        whole = np.array(order + np.setdiff1d(np.arange(n), order).tolist(), np.int64)
        x = x[whole]
        up = [h[whole[:m]] for h, m in zip(homes, [*sizes[1:], n])]
        radii, above = [], np.arange(n)
        for k in range(len(up) - 1, -1, -1):
            above = up[k][above]
            far = np.zeros(sizes[k])
            np.maximum.at(far, above, np.sqrt(((x - x[above]) ** 2).sum(1)))
            radii.insert(0, far)
        return cls(x, whole, up, [*radii, np.zeros(n)])


def descend(tree: Tree, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points of the level below those of `at`, and for each the place of its parent in `at`."""
    place = np.full(len(tree.radii[level - 1]), -1)
    place[at] = np.arange(len(at))
    parent = place[tree.up[level - 1]]
    own = np.flatnonzero(parent >= 0)
    return own, parent[own]


def join(a: Tree, b: Tree, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Points of a and of b, as places in the trees, with cosine of at least threshold; of a tree with itself each pair once."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    i = j = np.zeros(1, np.int64)
    open_, bottom = np.ones((1, 1), bool), max(len(a.radii), len(b.radii)) - 1
    for level in range(bottom + 1):
        if 0 < level < len(a.radii):
            i, above = descend(a, level, i)
            open_ = open_[above]
        if 0 < level < len(b.radii):
            j, above = descend(b, level, j)
            open_ = open_[:, above]
        dot = a.x[i] @ b.x[j].T
        if level == bottom:
            open_ &= dot >= threshold
            break
        ra, rb = a.radii[min(level, len(a.radii) - 1)][i], b.radii[min(level, len(b.radii) - 1)][j]
        bound = ra[:, None] + rb[None] + reach + 1e-7
        open_ &= 2 - 2 * dot <= bound * bound
        rows, columns = open_.any(1), open_.any(0)
        i, j, open_ = i[rows], j[columns], open_[rows][:, columns]
        if not len(i):
            break
    at, to = np.nonzero(open_)
    i, j = i[at], j[to]
    return (i[i < j], j[i < j]) if a is b else (i, j)


def least(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n points the least that the links (i, j) reach."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[i], low[j])
        new = low.copy()
        for at in (i, j, low[i], low[j]):
            np.minimum.at(new, at, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


NODE = "kind string, node long, c array<double>, radius double, ids binary, m binary, x binary, sizes array<int>, up binary, radii binary"


def packed(tree: Tree, kind: str, ids: np.ndarray, m: np.ndarray) -> pa.Table:
    raw = lambda x, t: np.concatenate(x).astype(t).tobytes() if x else b""
    return arrow({"kind": [kind], "node": [int(ids.min())], "c": [tree.x[0].tolist()], "radius": [float(tree.radii[0][0])], "ids": [raw([ids[tree.order]], "<i8")], "m": [raw([m[tree.order]], "<i8")], "x": [raw([tree.x.ravel()], "<f8")], "sizes": [[len(r) for r in tree.radii]], "up": [raw(tree.up, "<i8")], "radii": [raw(tree.radii, "<f8")]}, NODE)


def unpacked(row: dict) -> tuple[Tree, np.ndarray, np.ndarray]:
    sizes, ids = row["sizes"], np.frombuffer(row["ids"], "<i8")
    up = np.split(np.frombuffer(row["up"], "<i8"), np.cumsum(sizes[1:])[:-1]) if len(sizes) > 1 else []
    radii = np.split(np.frombuffer(row["radii"], "<f8"), np.cumsum(sizes)[:-1])
    return Tree(np.frombuffer(row["x"], "<f8").reshape(len(ids), -1), np.arange(len(ids)), up, radii), ids, np.frombuffer(row["m"], "<i8")


LINKS = "a long, b long, n long"


NONE = -(2**63) + 1  # stands where a cell has no centre: everything is within its radius
PLACED = "kind string, id long, m long, v array<double>, at array<long>, ds array<double>"


def settled(points: DataFrame, share, most: int) -> DataFrame:
    """PLACED with one more level: each point's nearest of the centres in its cell, and how far it is.

    share: the part of a label's points that are centres now, those of least hash. A cell (kind,
    at) of many points is dealt out to groups of about `most`, each with the cell's centres.
    """
    uniform = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)
    counts = save(points.groupBy("kind", "at").agg(F.ceil(F.count("*") / most).alias("salts")), "cells")
    salted = points.join(counts, ["kind", "at"]).withColumn("salt", F.pmod(F.xxhash64("id", F.lit(1)), "salts"))
    centres = points.join(share, "kind").where(uniform < F.col("share")).select("kind", "at", F.col("id").alias("centre"), F.col("v").alias("c"))
    sent = centres.join(counts, ["kind", "at"]).select(F.col("kind").alias("of"), F.col("at").alias("above"), F.explode(F.expr("sequence(0L, salts - 1)")).alias("to"), "centre", "c")

    def settle(t: pa.Table, given: pa.Table) -> pa.Table:
        names = ["kind", "id", "m", "v", "at", "ds"]
        if not t.num_rows:
            return pa.table([pa.array([], x) for x in (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.float64()))], names=names)
        centre, far = np.full(t.num_rows, NONE), np.full(t.num_rows, 2.0)
        if given.num_rows:
            home, far = nearest(units(matrix(t["v"])), units(matrix(given["c"])))
            centre = given["centre"].to_numpy()[home]
        at = t["at"][0].as_py()
        ds = [[*x, y] for x, y in zip(t["ds"].to_pylist(), far.tolist())]
        return pa.table([t["kind"], t["id"], t["m"], t["v"], pa.array([[*at, c] for c in centre.tolist()], pa.list_(pa.int64())), pa.array(ds, pa.list_(pa.float64()))], names=names)

    return save(salted.select("kind", "at", "salt", "id", "m", "v", "ds").groupBy("kind", "at", "salt").cogroup(sent.groupBy("of", "above", "to")).applyInArrow(settle, PLACED), "placed")


def near_cells(placed: DataFrame, nodes: DataFrame, levels: int, reach: float) -> DataFrame:
    """kind, a, b: pairs of lowest cells (a <= b) that the covering radii leave within reach, level by level."""
    pairs = placed.select("kind").distinct().select("kind", F.array().cast("array<long>").alias("a"), F.array().cast("array<long>").alias("b"))
    centres = nodes.select("kind", F.col("id").alias("centre"), F.col("v").alias("c"))
    unit = F.transform("c", lambda x: x / F.col("norm"))
    for level in range(1, levels + 1):
        cells = placed.groupBy("kind", F.slice("at", 1, level).alias("at")).agg(F.max(F.element_at("ds", level)).alias("radius"))
        cells = cells.withColumn("centre", F.element_at("at", -1)).join(centres, ["kind", "centre"], "left")
        cells = cells.withColumn("norm", F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x))).select("kind", F.slice("at", 1, level - 1).alias("above"), "at", "radius", unit.alias("c"))
        cells = save(cells, "cells")
        one, two = (cells.select("kind", F.col("above").alias(x), F.col("at").alias(f"at{x}"), F.col("radius").alias(f"r{x}"), F.col("c").alias(f"c{x}")) for x in "ab")
        dot = F.aggregate(F.zip_with("ca", "cb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        apart = F.coalesce(F.sqrt(F.greatest(2 - 2 * dot, F.lit(0.0))), F.lit(0.0))
        both = pairs.join(one, ["kind", "a"]).join(two, ["kind", "b"]).where("ata <= atb").where(apart <= F.col("ra") + F.col("rb") + reach + 1e-7)
        pairs = save(both.select("kind", F.col("ata").alias("a"), F.col("atb").alias("b")), "pairs")
    return pairs


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, node: int = 1500, most: int = 16384, fan: int = 64, bundle: int = 16) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; links only within one label that is not null.

    Vectors that do not count (null, zero, null or non-finite components) and rows without a label
    link with nothing. Equal vectors of a label link with each other and with all that one of
    them links with. Repeated vec_ids: one row each, links of any of its rows count. Null vec_id:
    a row of its own without links. Vectors of different lengths are never compared. An empty
    table gives an empty result; other columns are not looked at.

    The result is exact whatever the radii leave out. Where they leave out nothing, as among
    random vectors of many dimensions, the pairs of nodes of a label are as many as its nodes
    squared; the nodes travel in bundles of about `bundle`, so that what is sent is the nodes times
    the bundles of their label. In such a label work grows with the square of its vectors.
    """
    rows = save(valid(vectors.where("label IS NOT NULL"), F.col("label").cast("string").alias("kind")).withColumn("kind", F.concat_ws("/", "kind", F.size("v"))), "vectors")
    nodes = save(rows.groupBy("kind", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("m")), "nodes")
    members = rows.join(nodes, ["kind", "v"]).select("vec_id", "kind", "id", "m")
    sizes = save(nodes.groupBy("kind").agg(F.count("*").alias("n")), "sizes")
    # lowest centres: of each label one in `node` vectors; labels of one node need none
    lowest = math.ceil((sizes.agg(F.max("n")).first()[0] or 0) / node)
    levels = 1
    while fan**levels < lowest:
        levels += 1
    placed = nodes.select("kind", "id", "m", "v", F.array().cast("array<long>").alias("at"), F.array().cast("array<double>").alias("ds"))
    for level in range(1, levels + 1):
        wanted = F.least(F.ceil(F.col("n") / node), F.lit(fan**level))
        placed = settled(placed, sizes.where(wanted > 1).select("kind", (wanted / F.col("n")).alias("share")), most)
    many = placed.groupBy("kind", "at").agg(F.ceil(F.count("*") / (2 * node)).alias("parts"))
    reach = float(np.sqrt(2 - 2 * threshold))

    def grow(t: pa.Table) -> pa.Table:
        tree = packed(Tree.grown(units(matrix(t["v"])), reach / 4), t["kind"][0].as_py(), t["id"].to_numpy(), t["m"].to_numpy())
        return tree.append_column("at", t["at"].slice(0, 1))

    dealt = placed.join(many, ["kind", "at"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(2)), "parts")).select("kind", "at", "part", "id", "m", "v")
    trees = save(dealt.groupBy("kind", "at", "part").applyInArrow(grow, NODE + ", at array<long>"), "trees")
    one, two = (trees.select("kind", F.col("at").alias(x), F.col("node").alias(f"node{k}"), F.col("radius").alias(f"radius{k}"), F.col("c").alias(f"c{k}")) for x, k in (("a", "1"), ("b", "2")))
    dot = F.aggregate(F.zip_with("c1", "c2", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.sqrt(F.greatest(2 - 2 * dot, F.lit(0.0)))
    met = near_cells(placed, nodes, levels, reach).join(one, ["kind", "a"]).join(two, ["kind", "b"]).where("a < b OR node1 <= node2")
    near = save(met.where(apart <= F.col("radius1") + F.col("radius2") + reach + 1e-7).select("kind", "node1", "node2"), "near")
    # nodes travel in bundles: the trees of two bundles go once to the task of all their pairs
    bundles = trees.select("kind", "node", F.slice("at", 1, levels - 1).alias("above"), F.pmod(F.xxhash64("node"), F.lit(max(1, fan // bundle))).alias("share"))
    bundles = bundles.select("kind", "node", F.xxhash64("above", "share").alias("g"))
    for k in "12":
        near = near.join(bundles.select("kind", F.col("node").alias(f"node{k}"), F.col("g").alias(f"g{k}")), ["kind", f"node{k}"])
    turned = F.col("g1") > F.col("g2")
    sides = {f"{c}{k}": F.when(turned, F.col(f"{c}{o}")).otherwise(F.col(f"{c}{k}")) for c in ("g", "node") for k, o in ("12", "21")}
    near = save(near.select("kind", *(v.alias(c) for c, v in sides.items())), "bundled")
    task = ["kind", "g1", "g2"]
    inner = ["ids", "m", "x", "sizes", "up", "radii"]
    asks = near.groupBy(*task, "node1").agg(F.collect_list("node2").alias("partners"))  # a bundle at most
    left = asks.join(trees.withColumnRenamed("node", "node1"), ["kind", "node1"]).select(*task, "node1", "partners", *inner)
    right = near.select(*task, "node2").distinct().join(trees.withColumnRenamed("node", "node2"), ["kind", "node2"]).select(*(F.col(x).alias(x) for x in (*task, "node2", *inner)))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        partners = {r["node2"]: unpacked(r) for r in b.to_pylist()}
        out = []
        for row in a.to_pylist():
            x, own, weight = unpacked(row)
            for node2 in row["partners"]:
                ids, m, y = own, weight, x
                if node2 != row["node1"]:
                    y, others, more = partners[node2]
                    ids, m = np.concatenate([own, others]), np.concatenate([weight, more])
                i, j = join(x, y, threshold)
                j = j + len(own) if y is not x else j
                n = np.bincount(i, m[j], len(ids)) + np.bincount(j, m[i], len(ids))
                low = least(i, j, len(ids))
                tied, some = np.flatnonzero(low != np.arange(len(ids))), np.flatnonzero(n)
                out.append((np.concatenate([ids[tied], ids[some]]), np.concatenate([ids[low[tied]], ids[some]]), np.concatenate([np.zeros(len(tied)), n[some]]).astype(np.int64)))
        return pa.table([pa.array(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64)) for k in range(3)], names=["a", "b", "n"])

    found = save(left.groupBy(*task).cogroup(right.groupBy(*task)).applyInArrow(compare, LINKS), "links")
    counts = found.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    linked = members.join(counts, "id", "left").select("vec_id", "id", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    linked = save(linked, "linked")
    edges = found.where("a <> b").select("a", "b").union(linked.select(F.col("id").alias("a"), F.col("vec_id").alias("b")).where("a <> b"))
    classes = components(edges).withColumnRenamed("id", "vec_id")
    counted = linked.groupBy("vec_id").agg(F.sum("n_links").alias("n_links")).join(classes, "vec_id", "left")
    all_ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).where("vec_id IS NOT NULL").distinct()
    whole = all_ids.join(counted, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    nameless = vectors.where("vec_id IS NULL").select(F.lit(None).cast("long"), F.lit(0).cast("long"), F.lit(None).cast("long"), F.lit(True))
    return whole.withColumn("kept", F.col("vec_id") == F.col("component_id")).union(nameless)
