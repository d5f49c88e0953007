"""Counts of 64-bit keys over all blocks, sent as packed sorted runs instead of a row a key.

Each block sends its distinct keys once, split by their leading bits into buckets; a bucket adds
up what all blocks say of a key, and answers each block in the block's own key order. A key that
very many documents hold thus costs one entry a block, never one a document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOBS = "block long, bucket int, keys binary, vals binary"
ANSWERS = "block long, bucket int, answer binary, total long, n_distinct long"
TOP = ", top_keys array<long>, top_sums array<long>"


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers by byte planes, without the planes that are all zero."""
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    used = [p for p in range(8) if planes[:, p].any()]
    return bytes([sum(1 << p for p in used)]) + b"".join(planes[:, p].tobytes() for p in used)


def unpack(blob: bytes, n: int) -> np.ndarray:
    out, at = np.zeros((n, 8), np.uint8), 1
    for p in range(8):
        if blob[0] >> p & 1:
            out[:, p] = np.frombuffer(blob, np.uint8, n, at)
            at += n
    return out.view("<u8").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return len(keys).to_bytes(4, "little") + pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob[4:], int.from_bytes(blob[:4], "little")), dtype=np.uint64)


def bounds(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket begins in sorted keys."""
    return np.searchsorted(keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64), np.arange((1 << bits) + 1, dtype=np.uint64))


def blobs(block: int, keys: np.ndarray, vals: np.ndarray, bits: int) -> dict[str, list]:
    """Rows of BLOBS for the sorted distinct keys of a block."""
    at, out = bounds(keys, bits), {"block": [], "bucket": [], "keys": [], "vals": []}
    for b in np.flatnonzero(np.diff(at)):
        s = slice(at[b], at[b + 1])
        for name, value in (("block", block), ("bucket", int(b)), ("keys", pack_sorted(keys[s])), ("vals", pack(vals[s]))):
            out[name].append(value)
    return out


def arrow(columns: dict[str, list], ddl: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "float": pa.float32(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    fields = [x.split() for x in ddl.split(", ")]
    return pa.table([pa.array(columns[n], kinds[k]) for n, k in fields], schema=pa.schema([(n, kinds[k]) for n, k in fields]))


def add_up(table: pa.Table, top: int = 0) -> pa.Table:
    runs = [unpack_sorted(x) for x in table["keys"].to_pylist()]
    ends = np.cumsum([len(x) for x in runs])
    vals = np.concatenate([unpack(x, len(k)) for x, k in zip(table["vals"].to_pylist(), runs)])
    keys = np.concatenate(runs)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sums = np.add.reduceat(vals[order], first)
    spread = np.empty(len(keys), np.uint64)
    spread[order] = np.repeat(sums, np.diff(np.append(first, len(keys))))
    answers = [pack(x) for x in np.split(spread, ends[:-1])]
    n = table.num_rows
    out = {"block": table["block"].to_pylist(), "bucket": table["bucket"].to_pylist(), "answer": answers, "total": [int(sums.sum())] + [0] * (n - 1), "n_distinct": [int((sums > 0).sum())] + [0] * (n - 1)}
    if not top:
        return arrow(out, ANSWERS)
    own = keys[first].view(np.int64)
    best = np.lexsort((own, -sums.astype(np.int64)))[:top]
    best = best[sums[best] > 0]
    out |= {"top_keys": [own[best].tolist()] + [[]] * (n - 1), "top_sums": [sums[best].astype(np.int64).tolist()] + [[]] * (n - 1)}
    return arrow(out, ANSWERS + TOP)


def global_sums(sent: DataFrame, top: int = 0) -> DataFrame:
    """BLOBS of all blocks to ANSWERS: for each block's keys the sum of all blocks' values.

    With `top`, one row a bucket also lists that many keys of the greatest sums.
    """
    return sent.groupBy("bucket").applyInArrow(lambda table: add_up(table, top), ANSWERS + TOP * bool(top))


def answered(rows: pa.Table, keys: np.ndarray, bits: int) -> np.ndarray:
    """A block's answers in the order of its sorted keys."""
    at, out = bounds(keys, bits), np.zeros(len(keys), np.uint64)
    for b, blob in zip(rows["bucket"].to_pylist(), rows["answer"].to_pylist()):
        out[at[b] : at[b + 1]] = unpack(blob, int(at[b + 1] - at[b]))
    return out
