"""Near copies among documents: improved consistent weighted sampling over TF-IDF shingles.

A document is the multiset of its `words`-word shingles (fewer words: one shingle of them all),
words being what white space parts, in lower case. A shingle's weight is its count in the
document times 1 + ln(N / df) / ln(N), from 1 (in every document) to 2; df counts all documents.
Two documents are linked if their weighted Jaccard similarity, sum of minima over sum of maxima,
is at least the threshold. Candidates share a band of weighted samples; all links are verified.

Exact copies are put together first and do not take part beyond one of them. In a bucket of
candidates not all pairs are compared: each is compared with the member that meets most others
in all its buckets, then, in buckets that are still of several classes, with a few drawn by that
measure, all of them in one pass. Members of a bucket that are still in different classes after
that are paired by their rarest shingles where those can still meet the threshold, which leaves
out no link, and compared. Links found in the two later passes tie classes, not documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import power_of_two, save, text_bytes, texts, write_blocks
from plenum.llm.components import stars
from plenum.llm.hashstats import BLOBS, answered, arrow, blobs, global_sums
from plenum.llm.words import PRIME as P
from plenum.llm.words import lower_words, mixed

POOL = 1 << 16
SLACK = 1e-5  # of sums of single-precision weights
LOW = np.uint64(0xFFFF)
RANDOM = np.random.default_rng(4)
R, LN_C, BETA = RANDOM.gamma(2, 1, POOL).astype(np.float32), np.log(RANDOM.gamma(2, 1, POOL)).astype(np.float32), RANDOM.random(POOL).astype(np.float32)


def shingles(rows: list[str], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, key and count of each distinct shingle of each text, by row and key."""
    if len(rows) > 1 << 16:  # rows and keys are sorted as one number
        parts = [shingles(rows[at : at + (1 << 16)], words) for at in range(0, len(rows), 1 << 16)]
        return np.concatenate([p[0] + (k << 16) for k, p in enumerate(parts)]), *(np.concatenate(x) for x in list(zip(*parts))[1:])
    row, h = lower_words(rows)
    n = np.bincount(row, minlength=len(rows))
    key = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        key = key * P + h[k : k + len(key)]
    whole = row[: len(key)] == row[len(row) - len(key) :]
    short = np.flatnonzero((n > 0) & (n < words))
    begin, own = (np.cumsum(n) - n)[short], np.zeros(len(short), np.uint64)
    for k in range(words):
        own = own * P + np.where(k < n[short], h[np.minimum(begin + k, len(h) - 1)] if len(h) else own, np.uint64(k + 1))
    row, key = np.concatenate([row[: len(key)][whole], short]), mixed(np.concatenate([key[whole], own])) >> np.uint64(16)
    both = np.sort(row.astype(np.uint64) << np.uint64(48) | key)
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    both, count = both[first], np.diff(np.append(first, len(both)))
    return (both >> np.uint64(48)).astype(np.int64), both << np.uint64(16), count


def weights(tf: np.ndarray, df: np.ndarray, n_docs: int) -> np.ndarray:
    return (tf * (1 + np.log(n_docs / np.maximum(df, 1)) / np.log(max(n_docs, 3)))).astype(np.float32)


def draws(log_w: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Level and ln a of a consistent weighted sample, for weights and places in the pool."""
    r, beta = R[idx], BETA[idx]
    level = np.floor(log_w / r + beta)
    return level, LN_C[idx] - r * (level - beta + 1)


def ordered(x: np.ndarray) -> np.ndarray:
    """Single-precision numbers as integers of the same order, in the upper half of 64 bits."""
    bits = x.astype(np.float32).view(np.uint32)
    return (bits ^ np.where(bits >> np.uint32(31), np.uint32(0xFFFFFFFF), np.uint32(0x80000000))).astype(np.uint64) << np.uint64(32)


def samples(row: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int, common: int = 12, slice_: int = 32768) -> np.ndarray:
    """n consistent weighted samples (hashes of shingle and level) of each row that has shingles.

    What a draw gives depends on weight and place in the pool alone: for the `common` most frequent
    weights (most shingles stand in one document) it is looked up, for all others worked out.
    """
    begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    out = np.zeros((len(begins), n), np.uint64)
    if not len(begins):
        return out
    values, counts = np.unique(weight, return_counts=True)
    values = values[np.argsort(-counts, kind="stable")[:common]]
    place = np.arange(POOL)
    table = np.concatenate([ordered(draws(np.full(POOL, np.log(v), np.float32), place)[1]) for v in values])
    kind = np.full(len(weight), -1, np.int64)
    for k, v in enumerate(values):
        kind[weight == v] = k
    log_w, ends = np.log(weight), np.append(begins[1:], len(row))
    to = 0
    while to < len(begins):
        a, upto = begins[to], max(to + 1, int(np.searchsorted(ends, begins[to] + slice_, "right")))
        own = slice(a, ends[upto - 1])
        at, step = (key[own] >> np.uint64(16)).astype(np.uint16), (key[own] >> np.uint64(40)).astype(np.uint16) | np.uint16(1)
        base, number = np.maximum(kind[own], 0) * POOL, np.arange(own.stop - a, dtype=np.uint64)
        rare = np.flatnonzero(kind[own] < 0)
        looked, value = np.empty(len(number), np.int64), np.empty(len(number), np.uint64)
        for k in range(n):
            table.take(np.add(base, at, out=looked), mode="clip", out=value)
            if len(rare):
                value[rare] = ordered(draws(log_w[own][rare], at[rare])[1])
            value |= number
            hit = (np.minimum.reduceat(value, begins[to:upto] - a) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            level = draws(log_w[own][hit], at[hit])[0]
            out[to:upto, k] = mixed(key[own][hit] + level.astype(np.int64).astype(np.uint64) * P + np.uint64(k))
            at += step
        to = upto
    return out


def block_shingles(table: pa.Table, answers: pa.Table, bits: int, words: int, n_docs: int):
    """A block's rows, shingle keys, weights and document counts."""
    row, key, tf = shingles(table["text"].to_pylist(), words)
    distinct, at = np.unique(key, return_inverse=True)
    df = answered(answers, distinct, bits)[at]
    return row, key, weights(tf, df, n_docs), df


def rarest(key: np.ndarray, weight: np.ndarray, df: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """A document's shingles, rarest first, and what it weighs from each on, while that is the threshold's share of it.

    Two documents whose similarity reaches the threshold t have t / (1 + t) of their summed weights
    in common. All of it lies from their first common shingle on, which is thus among these of both.
    """
    order = np.lexsort((key, df))
    rest = np.cumsum(weight[order][::-1], dtype=np.float64)[::-1]
    n = np.count_nonzero(rest >= (threshold - SLACK) * rest[0])
    return key[order[:n]], rest[:n]


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard of two packed documents: sorted keys, then weights."""
    (ka, wa), (kb, wb) = ((np.frombuffer(x, "<u4", len(x) // 8), np.frombuffer(x, "<f4", len(x) // 8, len(x) // 2)) for x in (a, b))
    at = np.minimum(np.searchsorted(kb, ka), max(len(kb) - 1, 0))
    same = kb[at] == ka if len(kb) else np.zeros(len(ka), bool)
    both = float(np.minimum(wa[same], wb[at[same]]).sum(dtype=np.float64))
    whole = float(wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64)) - both
    return both / whole if whole else 0.0


BANDS = "block long, ids binary, bands binary"
BUCKETS = "doc_id long, block long, band long, degree long"
FEATURES = "doc_id long, f binary, whole double, keys binary, rests binary"
OPEN = "doc_id long, component long, bands array<long>, whole double"


def linked(pairs: DataFrame, features: DataFrame, threshold: float) -> DataFrame:
    """Of pairs(a, b, ca, cb) those whose similarity reaches the threshold, as links (ca, cb) of their classes."""
    fa, fb = (features.select(F.col("doc_id").alias(x), F.col("f").alias(f"f{x}")) for x in "ab")

    def test(batches):
        for batch in batches:
            keep = [similarity(x, y) >= threshold for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(fa, "a").join(fb, "b").select("ca", "cb", "fa", "fb").mapInArrow(test, "a long, b long")


def placed(rows: DataFrame, column: str, ties: list[DataFrame]) -> DataFrame:
    """rows with `component`, the class of the document in `column` after each of ties(id, component) in turn; untied ids are their own."""
    out = rows.withColumn("component", F.col(column))
    for t in ties:
        out = out.join(t.select(F.col("id").alias("component"), F.col("component").alias("tied")), "component", "left").withColumn("component", F.coalesce("tied", "component")).drop("tied")
    return out


def spread(batches):
    """The columns of OPEN with each key and its rest."""
    for batch in batches:
        keys, rests = ([np.frombuffer(x, kind) for x in batch.column(k).to_pylist()] for k, kind in ((4, "<i8"), (5, "<f8")))
        at = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
        flat = [pa.array(np.concatenate(x) if x else np.zeros(0, kind)) for x, kind in ((keys, np.int64), (rests, np.float64))]
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(4)), *flat], ["doc_id", "component", "bands", "whole", "key", "rest"])


def near_duplicates(docs: DataFrame, threshold: float = 0.8, words: int = 5, bands: int = 16, rows: int = 4, leaders_tried: int = 3, block_mb: float = 4) -> DataFrame:
    """One row a document: doc_id, class_id (least doc_id that links reach), kept (doc_id = class_id).

    Null texts count as empty; documents without a word have no copies. Rows with the same doc_id
    are one document. Null doc_id: its own class, kept, once a row. A long text is a block of its
    own. An empty table gives an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    nameless = docs.where("doc_id IS NULL").select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept"))
    docs = texts(docs).where("doc_id IS NOT NULL")
    size = text_bytes(docs)
    bits = power_of_two(size / (4 << 20)).bit_length() - 1
    blocks = write_blocks(docs, size, block_mb)
    n_docs = blocks.count()

    # exact copies: the least doc_id of each text stands for all of them
    same = save(blocks.select("doc_id", "block", F.unhex(F.sha2("text", 256)).alias("same"), (F.trim("text") != "").alias("worded")), "texts")
    stands = same.groupBy("same").agg(F.min("doc_id").alias("stands"), F.count("*").alias("n"))
    resting = same.join(stands.select(F.col("stands").alias("doc_id")), "doc_id", "left_anti").select("block", "doc_id")

    def count(table: pa.Table) -> pa.Table:
        keys, n = np.unique(shingles(table["text"].to_pylist(), words)[1], return_counts=True)
        return arrow(blobs(table["block"][0].as_py(), keys, n.astype(np.uint64), bits), BLOBS)

    by_block = blocks.groupBy("block")
    df = save(global_sums(by_block.applyInArrow(count, BLOBS)).drop("total", "n_distinct"), "df")

    def band(table: pa.Table, sent: pa.Table) -> pa.Table:
        """Bands of a block's documents, without those that another document stands for."""
        out = {"block": [], "ids": [], "bands": []}
        if table.num_rows:
            row, key, weight, _ = block_shingles(table, sent.filter(sent["doc_id"].is_null()), bits, words, n_docs)
            ids = table["doc_id"].to_numpy()
            use = ~np.isin(ids, sent["doc_id"].drop_null().to_numpy())[row]
            row, key, weight = row[use], key[use], weight[use]
            drawn = samples(row, key, weight, bands * rows)
            found = np.zeros((len(drawn), bands), np.uint64)
            for k in range(rows):
                found = found * P + drawn[:, k::rows]
            found = mixed(found + np.arange(bands, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            out = {"block": [table["block"][0].as_py()], "ids": [ids[np.unique(row)].astype("<i8").tobytes()], "bands": [found.astype("<u8").tobytes()]}
        return arrow(out, BANDS)

    few = max(0, bits - 4)

    def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents and bands of a block, the distinct bands, and the place of each among them."""
        found = np.frombuffer(row["bands"], "<u8").reshape(-1, bands)
        keys, at = np.unique(found, return_inverse=True)
        return np.frombuffer(row["ids"], "<i8"), found, keys, at.reshape(found.shape)

    def tell(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, _, keys, at = unpacked(row)
                yield from arrow(blobs(row["block"], keys, np.bincount(at.ravel(), minlength=len(keys)).astype(np.uint64), few), BLOBS).to_batches()

    def meet(table: pa.Table, answers: pa.Table) -> pa.Table:
        """The bands of a block that more documents have, and how many others each document meets in its bands."""
        out = {"doc_id": [], "block": [], "band": [], "degree": []}
        for row in table.to_pylist():
            ids, found, keys, at = unpacked(row)
            n = answered(answers, keys, few)[at].astype(np.int64)
            i, j = np.nonzero(n > 1)
            degree = np.where(n > 1, n, 0).sum(1)
            out = {"doc_id": ids[i], "block": np.full(len(i), row["block"]), "band": found[i, j].view(np.int64), "degree": degree[i]}
        return arrow(out, BUCKETS)

    null = F.lit(None)
    asked = df.select("block", "bucket", "answer", null.cast("long").alias("doc_id"))
    told = asked.unionByName(resting.select("block", null.cast("int").alias("bucket"), null.cast("binary").alias("answer"), "doc_id"))
    banded = save(by_block.cogroup(told.groupBy("block")).applyInArrow(band, BANDS), "bands")
    sums = global_sums(banded.mapInArrow(tell, BLOBS)).select("block", "bucket", "answer")
    # a document with a high degree stands amid a group of copies
    buckets = save(banded.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(meet, BUCKETS), "buckets")

    def feature(table: pa.Table, sent: pa.Table) -> pa.Table:
        out = {"doc_id": [], "f": [], "whole": [], "keys": [], "rests": []}
        wanted = sent["doc_id"].drop_null().to_numpy()
        if table.num_rows and len(wanted):
            row, key, weight, df = block_shingles(table, sent.filter(sent["doc_id"].is_null()), bits, words, n_docs)
            chosen = np.isin(table["doc_id"].to_numpy(), wanted)[row]
            row, key, weight, df = row[chosen], key[chosen], weight[chosen], df[chosen]
            short = (key >> np.uint64(32)).astype("<u4")
            begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
            ids = table["doc_id"].to_pylist()
            for a, b in zip(begins, np.append(begins[1:], len(row))):
                out["doc_id"].append(ids[row[a]])
                out["f"].append(short[a:b].tobytes() + weight[a:b].astype("<f4").tobytes())
                out["whole"].append(float(weight[a:b].sum(dtype=np.float64)))
                rare, rest = rarest(key[a:b], weight[a:b], df[a:b], threshold)
                out["keys"].append(rare.astype("<u8").tobytes())
                out["rests"].append(rest.astype("<f8").tobytes())
        return arrow(out, FEATURES)

    wanted = buckets.select("block", null.cast("int").alias("bucket"), null.cast("binary").alias("answer"), "doc_id").distinct()
    asked = asked.unionByName(wanted)
    features = save(by_block.cogroup(asked.groupBy("block")).applyInArrow(feature, FEATURES), "features")

    rank = F.struct("degree", -F.col("doc_id"))
    leaders = buckets.groupBy("band").agg(F.max_by("doc_id", rank).alias("leader"))
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    tested = save(buckets.join(leaders, "band").where("leader <> doc_id").select(*pair("leader", "doc_id")).distinct(), "pairs")
    ties = [stars(save(linked(tested.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")), features, threshold), "found"))]
    for last in (False, True) if leaders_tried else (True,):
        state = placed(buckets.select("band", "doc_id", "degree"), "doc_id", ties)
        draw = [F.xxhash64("doc_id", F.lit(k)).cast("double") / 2.0**63 + F.log("degree") for k in range(1, leaders_tried + 1)]
        drawn = F.array(*(F.max_by(F.struct(F.col("doc_id").alias("other"), F.col("component").alias("its")), d) for d in draw))
        split = state.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), drawn.alias("drawn")).where("low <> high")
        if not last:
            pairs = state.join(split.select("band", "drawn"), "band").select("doc_id", "component", F.inline("drawn")).where("component <> its").select(*pair("other", "doc_id"), F.col("component").alias("ca"), F.col("its").alias("cb"))
        else:
            still = state.join(split.select("band"), "band", "left_semi").groupBy("doc_id", "component").agg(F.collect_set("band").alias("bands"))
            still = still.join(features, "doc_id").select("doc_id", "component", "bands", "whole", "keys", "rests")
            rare = still.mapInArrow(spread, f"{OPEN}, key long, rest double")
            left, right = (rare.select("key", *(F.col(c).alias(c[0] + x) for c in ("doc_id", "component", "bands", "whole", "rest"))) for x in "ab")
            enough = F.least("ra", "rb") >= (F.col("wa") + F.col("wb")) * (threshold / (1 + threshold) - SLACK)
            pairs = left.join(right, "key").where("da < db AND ca <> cb").where(enough).where(F.arrays_overlap("ba", "bb")).select(F.col("da").alias("a"), F.col("db").alias("b"), "ca", "cb")
        pairs = pairs.groupBy("a", "b").agg(F.least(F.min("ca"), F.min("cb")).alias("ca"), F.greatest(F.max("ca"), F.max("cb")).alias("cb"))
        pairs = save(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        found, tested = save(linked(pairs, features, threshold), "found"), tested.union(pairs.select("a", "b"))
        if not found.isEmpty():
            ties.append(stars(found))
    # a text's class goes to its copies; texts of more than one in a thousand documents, a thousand at most, are sent to all tasks
    groups = save(placed(stands, "stands", ties).select("same", "n", F.col("component").alias("class_id")), "groups")
    often, worded = groups.where(F.col("n") > n_docs / 1000), same.where("worded").select("doc_id", "same")
    rest = worded.join(F.broadcast(often.select("same")), "same", "left_anti").join(groups, "same")
    out = worded.join(F.broadcast(often), "same").select("doc_id", "class_id").union(rest.select("doc_id", "class_id"))
    out = out.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    wordless = same.where("NOT worded").select("doc_id").distinct().join(out.select("doc_id"), "doc_id", "left_anti").withColumn("class_id", F.col("doc_id"))
    return out.union(wordless).withColumn("kept", F.col("doc_id") == F.col("class_id")).unionByName(nameless)
