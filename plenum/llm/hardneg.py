"""Hard negatives of anchors among integer vectors, with angles to reference directions as a filter.

Every vector keeps its angles to a few directions. By the triangle inequality of angles, those of
an anchor and of a window of rows bound the angle between them; its cosine times both lengths
bounds the integer score. Only windows whose bounds meet what is asked for are scored, exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenum.llm.common import partitions, save
from plenum.llm.vectors import units

POINT = "vec_id long, label long, dim int, cell int, angle float, anchor boolean, q binary, angles binary"
BLOCK = "anchors boolean, part int, dim int, ids binary, labels binary, q binary, angles binary"
HIT = "a int, anchor_id long, vec_id long, score long"
NEGATIVE = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
WINDOW, CHUNK = 64, 32
SLACK = 1e-5  # of an angle: single precision, and the arc cosine near 1
EXACT = 2.0**53  # up to which doubles add up integers without error


def directions_of(sample: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` directions amid the unit vectors of the sample: a few steps of spherical k-means."""
    x = units(sample)
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(most, len(x)) and near.min() < 1 - 1e-9:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    at = x[chosen]
    for _ in range(5):
        of = (x @ at.T).argmax(1)
        sums = np.zeros_like(at)
        np.add.at(sums, of, x)
        full = np.sqrt((sums * sums).sum(1)) > 1e-9
        at[full] = units(sums[full])
    return at


def angles_to(q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Angles of rows to directions; zero rows count as at right angles, and their length is 0."""
    length = np.sqrt((q * q).sum(1, keepdims=True))
    return np.arccos(np.clip(q @ at.T / np.where(length > 0, length, 1), -1, 1)).astype(np.float32)


def measured(vectors: DataFrame, scale: int, anchors: str, directions: int, sample: int) -> DataFrame:
    """POINT rows of the vectors that take part, one for each vec_id."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    picked = rows.where("exists(v, x -> x <> 0)").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()  # `sample` rows at most
    at: dict[int, np.ndarray] = {}
    for n in {len(r.v) for r in picked}:
        at[n] = directions_of(np.array([r.v for r in picked if len(r.v) == n]), directions)

    def measure(batches):
        for batch in batches:
            lists = batch.column("v")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
            ids, labels, isanchor = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "anchor"))
            out = {f.split()[0]: [] for f in POINT.split(", ")}
            for n in np.unique(sizes):
                own = np.flatnonzero(sizes == n)
                q = np.floor(scale * flat[(ends[own] - n)[:, None] + np.arange(n)])
                fits = (q * q).sum(1) < 2.0**62  # else a score with itself leaves the 64 bits
                own, q = own[fits], q[fits]
                dirs = at.get(int(n), np.zeros((0, n)))
                theta = angles_to(q, dirs)
                cell = theta.argmin(1) if len(dirs) else np.zeros(len(own), int)
                whole = q.astype(np.int64)
                small = (np.abs(whole) < 2**31).all(1)
                out["vec_id"] += ids[own].tolist()
                out["label"] += labels[own].tolist()
                out["dim"] += [int(n)] * len(own)
                out["cell"] += cell.tolist()
                out["angle"] += (theta[np.arange(len(own)), cell] if len(dirs) else np.zeros(len(own))).tolist()
                out["anchor"] += isanchor[own].tolist()
                out["q"] += [(r.astype("<i4") if s else r).tobytes() for r, s in zip(whole, small)]
                out["angles"] += [r.tobytes() for r in theta]
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("cell", pa.int32()), ("angle", pa.float32()), ("anchor", pa.bool_()), ("q", pa.binary()), ("angles", pa.binary())]))

    points = rows.withColumn("anchor", F.coalesce(F.expr(anchors), F.lit(False))).mapInArrow(measure, POINT)
    rest = ["label", "q", "dim", "cell", "angle", "anchor", "angles"]
    return points.groupBy("vec_id").agg(F.min(F.struct(*rest)).alias("p")).select("vec_id", "p.*")


def blocks(points: DataFrame, most: int = 1024) -> DataFrame:
    """BLOCK rows: up to `most` vectors of one length that stand next to each other by cell, label and angle; anchors once more in blocks of their own."""
    order = ["dim", "cell", "label", "angle", "vec_id"]
    dealt = points.repartitionByRange(partitions(points.sparkSession), *order).sortWithinPartitions(*order)
    columns = ["vec_id", "label", "dim", "anchor", "q", "angles"]

    def pack(batches):
        part = TaskContext.get().partitionId()
        held: dict[tuple[bool, int], list] = {}

        def block(key):
            rows = held.pop(key)
            q = [np.frombuffer(r[2], "<i4" if len(r[2]) == 4 * key[1] else "<i8") for r in rows]
            q = np.array(q, np.int64 if any(x.dtype.itemsize == 8 for x in q) else np.int32).reshape(len(rows), key[1])
            made = [key[0], part, key[1], np.array([r[0] for r in rows], "<i8").tobytes(), np.array([r[1] for r in rows], "<i8").tobytes(), q.tobytes(), b"".join(r[3] for r in rows)]
            kinds = [pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(made, kinds)], [f.split()[0] for f in BLOCK.split(", ")])

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in columns))
            for vec_id, label, dim, anchor, q, angles in rows:
                for kind in (False, True) if anchor else (False,):
                    key = (kind, dim)
                    held.setdefault(key, []).append((vec_id, label, q, angles))
                    if len(held[key]) == most:
                        yield block(key)
        for key in list(held):
            yield block(key)

    return dealt.select(columns).mapInArrow(pack, BLOCK)


class Side:
    """Vectors of one length out of BLOCK rows, in the order of the blocks."""

    def __init__(self, rows: list[dict], dim: int):
        rows = sorted((r for r in rows if r["dim"] == dim), key=lambda r: (r["ids"][:8], r["ids"]))
        self.sizes = [len(r["ids"]) // 8 for r in rows]
        self.ids = np.concatenate([np.frombuffer(r["ids"], "<i8") for r in rows])
        self.labels = np.concatenate([np.frombuffer(r["labels"], "<i8") for r in rows])
        self.q = np.concatenate([np.frombuffer(r["q"], "<i4" if len(r["q"]) == 4 * n * dim else "<i8").reshape(n, dim).astype(np.int64) for r, n in zip(rows, self.sizes)])
        self.angles = np.concatenate([np.frombuffer(r["angles"], "<f4").reshape(n, -1) for r, n in zip(rows, self.sizes)]).astype(np.float64)
        self.x = self.q.astype(np.float64)
        self.length = np.sqrt((self.x * self.x).sum(1))

    def windows(self) -> None:
        """Runs of WINDOW rows within a block, and what bounds them."""
        ends = np.cumsum(self.sizes)
        begin = np.concatenate([np.arange(e - n, e, WINDOW) for e, n in zip(ends, self.sizes)])
        self.begin, self.end = begin, np.append(begin[1:], len(self.ids))
        low, high = np.minimum.reduceat, np.maximum.reduceat
        self.near, self.far = low(self.angles, begin, 0) - SLACK, high(self.angles, begin, 0) + SLACK
        self.short, self.long = low(self.length, begin), high(self.length, begin)
        self.label_low, self.label_high = low(self.labels, begin), high(self.labels, begin)


def bounds(angles: np.ndarray, length: np.ndarray, rows: Side) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest integer score of each anchor with any row of each window, safe against rounding."""
    least = np.zeros((len(length), len(rows.begin)))
    most = np.full_like(least, np.pi)
    for k in range(angles.shape[1]):
        theta = angles[:, k, None]
        least = np.maximum(least, np.maximum(theta - SLACK - rows.far[:, k], rows.near[:, k] - theta - SLACK))
        most = np.minimum(most, np.minimum(theta + SLACK + rows.far[:, k], 2 * np.pi - (theta - SLACK + rows.near[:, k])))
    upper, lower = np.cos(np.minimum(least, np.pi)), np.cos(np.maximum(most, 0))
    upper = length[:, None] * np.where(upper > 0, rows.long, rows.short) * upper
    lower = length[:, None] * np.where(lower > 0, rows.short, rows.long) * lower
    return np.floor(lower - 1 - 1e-9 * np.abs(lower)), np.ceil(upper + 1 + 1e-9 * np.abs(upper))


def scorer(anchors: Side, rows: Side, own: slice):
    """From windows to the indices of their rows and the scores of the anchors with them, exact."""
    doubles = anchors.length[own].max(initial=0) * rows.length.max(initial=0) < EXACT / 2
    left, right = (anchors.x, rows.x) if doubles else (anchors.q, rows.q)

    def scores(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(np.repeat(windows, rows.end - rows.begin))
        return at, (left[own] @ right[at].T).astype(np.int64)

    return scores


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by the smaller id."""
    at = np.arange(len(scores))
    if len(at) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def positives_of(anchors: Side, rows: Side, k: int):
    """(anchor, ids, scores): the k best rows of each anchor's label among these, the anchor itself left out."""
    for at in range(0, len(anchors.ids), CHUNK):
        own = slice(at, at + CHUNK)
        ids, labels = anchors.ids[own], anchors.labels[own]
        _, upper = bounds(anchors.angles[own], anchors.length[own], rows)
        upper[(labels[:, None] < rows.label_low) | (labels[:, None] > rows.label_high)] = -np.inf
        score = scorer(anchors, rows, own)
        first = min(2, upper.shape[1])
        windows = np.zeros(upper.shape[1], bool)
        windows[np.argpartition(-upper, first - 1, 1)[:, :first].ravel()] = True
        windows &= (upper > -np.inf).any(0)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        for _ in range(2):
            index, scores = score(windows)
            for a in range(len(ids)):
                fine = (rows.labels[index] == labels[a]) & (rows.ids[index] != ids[a])
                i, s = np.concatenate([found[a][0], rows.ids[index[fine]]]), np.concatenate([found[a][1], scores[a, fine]])
                top = best(i, s, k)
                found[a] = i[top], s[top]
            least = np.array([s[-1] if len(s) == k else -np.inf for _, s in found])
            windows = ((upper >= least[:, None]) & (upper > -np.inf)).any(0) & ~windows
        yield from ((int(i), *f) for i, f in zip(ids, found))


def negatives_of(anchors: Side, rows: Side, wanted: dict[int, list[tuple[int, int]]], k: int, low: int, high: int):
    """(anchor, positive, its score, ids, scores): the k best rows of other labels whose score is from low to high percent of the positive's."""
    for at in range(0, len(anchors.ids), CHUNK):
        own = slice(at, at + CHUNK)
        ids, labels = anchors.ids[own], anchors.labels[own]
        asked = [[(p, s, -(-low * s // 100), high * s // 100) for p, s in wanted.get(int(i), [])] for i in ids]
        asked = [[x for x in xs if x[2] <= x[3]] for xs in asked]
        lower, upper = bounds(anchors.angles[own], anchors.length[own], rows)
        other = (rows.label_low != rows.label_high) | (rows.label_low != labels[:, None])
        score = scorer(anchors, rows, own)
        found = {(a, p): (np.zeros(0, np.int64), np.zeros(0, np.int64)) for a, xs in enumerate(asked) for p, *_ in xs}
        done = np.zeros(upper.shape[1], bool)
        for turn in range(2):
            windows = np.zeros_like(done)
            for a, xs in enumerate(asked):
                for p, _, least, most in xs:
                    s = found[a, p][1]
                    fits = other[a] & (upper[a] >= (max(least, s[-1]) if len(s) == k else least)) & (lower[a] <= most) & ~done
                    if turn == 0 and fits.sum() > 4:  # first the windows that may hold the best
                        ranked = np.flatnonzero(fits)
                        fits = np.zeros_like(fits)
                        fits[ranked[np.argpartition(-np.minimum(upper[a, ranked], most), 3)[:4]]] = True
                    windows |= fits
            index, scores = score(windows)
            for a, xs in enumerate(asked):
                if not xs:
                    continue
                fine = rows.labels[index] != labels[a]
                i, s = rows.ids[index[fine]], scores[a, fine]
                for p, _, least, most in xs:
                    within = (s >= least) & (s <= most)
                    both_i, both_s = np.concatenate([found[a, p][0], i[within]]), np.concatenate([found[a, p][1], s[within]])
                    top = best(both_i, both_s, k)
                    found[a, p] = both_i[top], both_s[top]
            done |= windows
        for a, xs in enumerate(asked):
            yield from ((int(ids[a]), p, s, *found[a, p]) for p, s, *_ in xs if len(found[a, p][0]))


def sides(left: pa.Table, right: pa.Table):
    """Anchors and rows of each length that both tables have."""
    one, two = (t.select([c for c in t.column_names if c != "pos"]).to_pylist() for t in (left, right))
    one, two = ([r for r in x if r["ids"] is not None] for x in (one, two))
    for dim in sorted({r["dim"] for r in one} & {r["dim"] for r in two}):
        a, b = Side(one, dim), Side(two, dim)
        b.windows()
        yield a, b


def mine(vectors: DataFrame, anchors: str, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, directions: int = 16, sample: int = 4096, rows_a_group: int = 65536, anchors_a_group: int = 16384) -> DataFrame:
    """vectors(vec_id, label, embedding) to anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is the integer inner product with the anchor
    (`anchors`: a condition on vec_id), higher first, ties by smaller vec_id. An anchor's
    positives are its `positives` best other rows of its label. For each, the `negatives` best
    rows of other labels with a score from `low` to `high` percent of the positive's, ranked from
    1; a positive without one, an anchor without a positive, and a positive below zero have no row.

    Rows with a null vec_id, label or vector, or a null or non-finite component take no part, nor
    do those whose integers, squared and added, leave 62 bits. Zero vectors take part with score 0.
    Vectors are compared with those of their own length only. Of rows with one vec_id the least by
    label and integers counts. Empty table: empty result. Other columns are not read.

    Directions are fitted on `sample` rows at most (those of least hash) and decide only what is
    left out of scoring, never a result. Rows and anchors are dealt to groups of a bounded size,
    each pair of groups is one task's work; what leaves it are the best few of each anchor. The
    work on anchors and rows grows with their product, less what the angles leave out.
    """
    spark = vectors.sparkSession
    packed = save(blocks(measured(vectors, scale, anchors, directions, sample)), "blocks")
    n = {r["anchors"]: r["n"] for r in packed.groupBy("anchors").agg(F.sum(F.octet_length("ids") / 8).alias("n")).collect()}
    count = int(n.get(False, 0))
    r = max(1, -(-count // rows_a_group), min(partitions(spark), -(-count // 2048)))  # a group of few rows would repeat each anchor's best few
    a = max(1, -(-int(n.get(True, 0)) // anchors_a_group))
    salt = F.xxhash64("part", "ids")
    rows = packed.where("NOT anchors").withColumn("r", F.pmod(salt, F.lit(r)).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(a - 1))))
    asking = packed.where("anchors").withColumn("a", F.pmod(salt, F.lit(a)).cast("int"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(r - 1))).alias("r")

    def find_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(i, v, s) for x, y in sides(left, right) for i, ids, scores in positives_of(x, y, positives) for v, s in zip(ids.tolist(), scores.tolist())]
        group = left["a"][0].as_py() if left.num_rows else 0
        return pa.Table.from_pandas(pd.DataFrame({"a": np.full(len(out), group, np.int32), **{c: np.array([o[k] for o in out], np.int64) for k, c in enumerate(("anchor_id", "vec_id", "score"))}}), preserve_index=False)

    met = asking.select("*", everywhere).groupBy("r", "a").cogroup(rows.groupBy("r", "a")).applyInArrow(find_positives, HIT)
    ranked = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    chosen = met.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= positives)
    chosen = save(chosen.groupBy("a", "anchor_id").agg(F.collect_list(F.struct("vec_id", "score")).alias("pos")), "positives")

    def find_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = {x["anchor_id"]: [(p["vec_id"], p["score"]) for p in x["pos"]] for x in left.select(["anchor_id", "pos"]).to_pylist() if x["pos"]}
        out = [(i, p, s, v, t) for x, y in sides(left.drop_columns(["anchor_id"]), right) for i, p, s, ids, scores in negatives_of(x, y, wanted, negatives, low, high) for v, t in zip(ids.tolist(), scores.tolist())]
        return pa.Table.from_pandas(pd.DataFrame({f.split()[0]: np.array([o[k] for o in out], np.int64) for k, f in enumerate(NEGATIVE.split(", "))}), preserve_index=False)

    both = asking.unionByName(chosen, allowMissingColumns=True)
    met = both.select("*", everywhere).groupBy("r", "a").cogroup(rows.groupBy("r", "a")).applyInArrow(find_negatives, NEGATIVE)
    ranked = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    best_ = met.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives)
    return best_.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute_sql(anchors: str = "vec_id % 100 = 0") -> str:
    """The contract's result in DuckDB's SQL, every anchor with every row."""
    return f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.{anchors}),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) x WHERE r <= 5),
    n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
