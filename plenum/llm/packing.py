"""Best-fit packing of tokenised documents by exact-complement hashing.

Only the *lengths* of pieces decide how they are packed, and there are at most `size` different
ones. So the plan is made from the histogram of lengths (size entries, whatever the corpus), and
it is a short list of patterns "n sequences that hold pieces of these lengths". Pieces then find
their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenum.llm.common import blocks_of, save, texts
from plenum.llm.wordcache import ByteLevelEncoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
RUN = 5_000  # pieces whose places one window partition gives out, about


def plan(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """counts[l]: pieces of length l (1 to size). To (lengths of a sequence, how many such).

    From the longest length on, its gap is filled exactly while any can be had: by the length
    equal to the gap, by two or by three lengths that sum up to it. Which lengths are there is
    held as the bits of one number; the same bits reversed and moved by the gap give in one AND
    every first length whose complement is there too. A combination is used as often as the
    scarcest of its lengths allows. What no combination completes goes by best fit, longest
    first, to the sequences with the smallest sufficient gap.
    """
    c = [int(x) for x in counts[: size + 1]] + [0] * (size + 1 - len(counts))
    there = sum(1 << i for i in range(1, size + 1) if c[i])
    back = sum(1 << (size - i) for i in range(1, size + 1) if c[i])
    out: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...], n: int) -> None:
        nonlocal there, back
        out.append((lengths, n))
        for x in lengths:
            c[x] -= n
            if not c[x]:
                there &= ~(1 << x)
                back &= ~(1 << (size - x))

    def enough(*lengths: int) -> int:
        return min(c[x] // lengths.count(x) for x in lengths)

    def pair(gap: int, *others: int) -> tuple[int, int] | None:
        """The longest a with its complement there, a + b = gap."""
        both = there & (back >> (size - gap)) & ((1 << gap) - 2) if gap > 1 else 0
        while both:
            a = both.bit_length() - 1
            if enough(a, gap - a, *others):
                return a, gap - a
            both &= ~(1 << a) & ~(1 << (gap - a))
        return None

    if size < len(c) and c[size]:
        take((size,), c[size])
    rest: list[tuple[int, int]] = []
    for x in range(size - 1, 0, -1):
        gap = size - x
        while c[x]:
            if c[gap] and (n := enough(x, gap)):
                take((x, gap), n)
            elif found := pair(gap, x):
                take((x, *found), enough(x, *found))
            else:
                break
        below = (there & ((1 << gap) - 1)) if c[x] else 0
        while below and c[x]:
            a = below.bit_length() - 1
            if 3 * a < gap:
                break
            found = pair(gap - a, x, a) if c[a] else None
            if found:
                take((x, a, *found), enough(x, a, *found))
            else:
                below &= ~(1 << a)
        if c[x]:
            rest.append((x, c[x]))
            c[x] = 0
            there &= ~(1 << x)
            back &= ~(1 << (size - x))
    # best fit for what is left: open[gap] holds sequences of one pattern each
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps = 0
    for x, n in rest:
        while n:
            fit = gaps >> x
            if fit:
                gap = x + (fit & -fit).bit_length() - 1
                held, m = open_[gap].pop()
                if not open_[gap]:
                    gaps &= ~(1 << gap)
            else:
                gap, held, m = size, (), n
            each = gap // x
            used = min(m, max(1, n // each))
            each = min(each, n // used)
            if used < m and held:
                open_.setdefault(gap, []).append((held, m - used))
                gaps |= 1 << gap
            n -= used * each
            left = gap - each * x
            if left:
                open_.setdefault(left, []).append((held + (x,) * each, used))
                gaps |= 1 << left
            else:
                out.append((held + (x,) * each, used))
    for same in open_.values():
        out += same
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]], size: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first ranks of its runs, their first sequence, and the place in it."""
    used, base, found = [0] * (size + 1), 0, {}
    for lengths, n in patterns:
        at = 0
        for x in lengths:
            found.setdefault(x, []).append((used[x], base, at))
            used[x] += n
            at += x
        base += n
    return {x: tuple(np.array(v, np.int64) for v in zip(*rows)) for x, rows in found.items()}


def pieces(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Every document's ids and `end_id`, cut if longer than `size`; the first piece may be shorter.

    Null and empty texts are the end id alone. with_ids adds `ids` (array of int), for a training
    set; without it the ids do not leave the task.
    """
    fields = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids)
    end = int(end_id).to_bytes(4, "little")

    def encode(batches):
        encoder = ByteLevelEncoder(tokenizer_path)
        for table in blocks_of(batches, 2 << 20):
            doc_ids, rows = table["doc_id"].to_pylist(), [[] for _ in fields]
            for doc_id, ids in zip(doc_ids, encoder.encode_all(table["text"].to_pylist())):
                ids += end
                n = len(ids) // 4
                cuts = list(range(n % size or size, n + 1, size)) if n > size else [n]
                for k, (a, b) in enumerate(zip([0, *cuts[:-1]], cuts)):
                    own = ids[4 * a : 4 * b]
                    for out, value in zip(rows, (doc_id, k, a, b - a, zlib.crc32(own))):
                        out.append(value)
                    if with_ids:
                        rows[5].append(np.frombuffer(own, "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, fields)], schema=fields)

    return texts(docs).mapInArrow(encode, PIECES + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with sequence_id and offset: as few sequences as best fit finds.

    Repeated rows are packed as often as they stand; ties of a length go by doc_id and piece.
    An empty table gives an empty result. Null doc_id: packed like any other document.
    """
    spark = docs.sparkSession
    cut = save(pieces(docs, tokenizer_path, size, end_id, with_ids), "pieces")
    n = cut.count()
    parts = max(1, math.ceil(n / RUN))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    cells = save(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(size + 1, np.int64)
    for length, m in cells.groupBy("length").agg(F.sum("n")).collect():  # size rows at most
        counts[length] = m
    placed = spark.sparkContext.broadcast(slots(plan(counts, size), size))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = cells.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.join(firsts, ["length", "part"]).withColumn("rank", F.col("first") + F.row_number().over(own) - 1)

    def place(batches):
        where = placed.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                first, base, at = where[int(length[rows[0]])]
                k = np.searchsorted(first, rank[rows], "right") - 1
                sequence[rows], offset[rows] = base[k] + rank[rows] - first[k], at[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(x)) for x in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = [f.split()[0] for f in PIECES.split(", ")] + ["ids"] * with_ids
    return ranked.select(*names, "rank").mapInArrow(place, PIECES + ", ids array<int>" * with_ids + ", sequence_id long, offset long")
