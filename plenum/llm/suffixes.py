"""Repeated byte strings over all documents: longest previous factors by suffix order.

A string of `span` bytes that also starts in a document with a smaller id is a later copy; every
byte that such strings cover goes. Which strings are equal is decided by suffix order and the
array of longest previous factors, in pieces that are made so that equal strings meet:

1. Of the grams (`gram` bytes) in a string the one with the least hash is its anchor. Equal
   strings have equal anchors at equal places, so strings are dealt out by their anchors.
2. Anchors are counted over all blocks (packed, see `hashstats`). Strings whose anchor stands in
   one document only have no copy; they, the bulk of most corpora, are not sent anywhere.
3. Runs of strings with one anchor are sent as the text they cover, once a block and content,
   with the least document. In a bucket of anchors all string starts are brought into suffix
   order; the previous and next smaller document there give the longest previous factor.
   A bucket that is too large, one anchor in many contexts, is dealt out once more by the hash of
   each whole string: equal strings still meet, and one string costs its bytes once a block.
4. The answers, a bit for each string, return to the blocks, where the bytes go.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import power_of_two, save, text_bytes, texts, utf8, write_blocks
from plenum.llm.hashstats import BLOBS, answered, arrow, blobs, bounds, global_sums, pack, unpack
from plenum.llm.words import TABLE, contents, mixed, power

GRAM = 26
STRETCH = 1 << 17  # starts looked at together: what is worked out for them fits a core's cache
LOW = np.uint64(0xFFFF)


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """A hash for each `size` bytes, made of those of powers of two."""
    h, n, parts = TABLE[data], 1, []
    while n <= size:
        if size & n:
            parts.append((n, h))
        if 2 * n <= size:
            h = h[:-n] * power(n) + h[n:]
        n *= 2
    m, at, out = len(data) - size + 1, 0, None
    for n, h in reversed(parts):
        out = h[at : at + m].copy() if out is None else out * power(n) + h[at : at + m]
        at += n
    return mixed(out)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours."""
    n, m = 1, len(values) - width + 1
    while 2 * n <= width:
        values = np.minimum(values[:-n], values[n:])
        n *= 2
    return np.minimum(values[:m], values[width - n : width - n + m])


def runs(data: np.ndarray, offsets: np.ndarray, span: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of strings with one anchor in one document: first start, number, anchor's place and key, document."""
    found: dict[str, list] = {"start": [], "n": [], "anchor": [], "key": []}
    for at in range(0, max(0, len(data) - span + 1), STRETCH):
        part = data[at : at + STRETCH + span - 1]
        h = grams(part, gram)
        place = least((h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64), span - gram + 1) & np.uint64(0xFFFFFF)
        place = place.astype(np.int64)
        new = np.concatenate([[True], place[1:] != place[:-1]])
        inner = offsets[(offsets > at) & (offsets < at + len(place))] - at
        new[inner] = True
        begins = np.flatnonzero(new)
        found["start"].append(begins + at)
        found["n"].append(np.diff(np.append(begins, len(place))))
        found["anchor"].append(place[begins] + at)
        found["key"].append(h[place[begins]])
    out = {k: np.concatenate(v) if v else np.zeros(0, np.uint64 if k == "key" else np.int64) for k, v in found.items()}
    out["doc"] = np.searchsorted(offsets, out["start"], "right") - 1
    out["n"] = np.minimum(out["n"], offsets[out["doc"] + 1] - span + 1 - out["start"]) if len(out["n"]) else out["n"]
    inside = (out["n"] > 0) & (out["anchor"] + gram <= offsets[out["doc"] + 1]) if len(out["n"]) else np.zeros(0, bool)
    return {k: v[inside] for k, v in out.items()}


def distinct(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, 1 or 2 (in one document of the block or in more), and each key's place among them."""
    order = np.argsort(key)
    key, doc, place = key[order], doc[order], np.empty(len(key), np.int64)
    if not len(key):
        return key, np.zeros(0, np.uint64), place
    new = np.concatenate([[True], key[1:] != key[:-1]])
    first = np.flatnonzero(new)
    place[order] = np.cumsum(new) - 1
    more = np.maximum.reduceat(doc, first) != np.minimum.reduceat(doc, first)
    return key[first], more.astype(np.uint64) + np.uint64(1), place


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def suffix_order(data: np.ndarray, at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of data[at:at + span], and for each in that order which run of equal ones it is in."""
    words = np.zeros(len(data), np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k : k + len(data)]
    group, order = np.zeros(len(at), np.int64), np.arange(len(at))
    live = np.arange(len(at))
    for k in range(0, span, 8):
        if not len(live):
            break
        word = words[np.minimum(at[order[live]] + k, len(data) - 1)]
        if span - k < 8:
            word = word >> np.uint64(8 * (8 - span + k))
        if k:
            inner = np.lexsort((word, group[live]))
        else:
            inner = np.argsort(word)
        order[live], word = order[live[inner]], word[inner]
        g = group[live]
        new = np.concatenate([[True], (word[1:] != word[:-1]) | (g[1:] != g[:-1])])
        # a group is named by the place of its first member
        name = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        group[live] = name
        same = ~new
        shared = same | np.concatenate([same[1:], [False]])
        live = live[shared]
    return order, group


def smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the previous and of the next smaller value, -1 and len(values) if there is none."""

    def previous(v: np.ndarray) -> np.ndarray:
        to = np.arange(-1, len(v) - 1)
        live = np.flatnonzero(to >= 0)
        while len(live):
            live = live[(v[to[live]] >= v[live])]
            to[live] = to[to[live]]
            live = live[to[live] >= 0]
        return to

    return previous(values), len(values) - 1 - previous(values[::-1])[::-1]


def later_copies(data: np.ndarray, at: np.ndarray, doc: np.ndarray, span: int) -> np.ndarray:
    """For each start: is its longest previous factor, the longest match with a smaller document, span bytes?"""
    order, group = suffix_order(data, at, span)
    before, after = smaller(doc[order])
    n = len(order)
    found = ((before >= 0) & (group[np.maximum(before, 0)] == group)) | ((after < n) & (group[np.minimum(after, n - 1)] == group)) if n else np.zeros(0, bool)
    out = np.empty(n, bool)
    out[order] = found
    return out


SENT = "block long, bucket int, size int, doc binary, n binary, text binary, bytes long"
STRINGS = "block long, bucket int, size int, sub long, n_places int, places binary, docs binary, which binary, text binary"
MASKS = "block long, bucket int, answer binary, total long, n_distinct long"


def local_runs(table: pa.Table, flags: pa.Table, bits: int, span: int, gram: int) -> dict:
    """A block's runs whose anchor stands in more documents, and of equal ones the one to send."""
    data, offsets = utf8(table["text"])
    ids = table["doc_id"].to_numpy()
    r = runs(data, offsets, span, gram)
    r["key"] = r["key"] & ~LOW
    keys, _, place = distinct(r["key"], ids[r["doc"]])
    shared = (answered(flags, keys, bits) > 1)[place]
    r = {k: v[shared] for k, v in r.items()}
    doc = ids[r["doc"]]
    same = contents(data, r["start"], r["n"] + span - 1) ^ (r["anchor"] - r["start"]).astype(np.uint64)
    order = np.lexsort((doc, same, r["key"]))
    first = np.concatenate([[True], (same[order][1:] != same[order][:-1]) | (r["key"][order][1:] != r["key"][order][:-1])]) if len(order) else np.zeros(0, bool)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(first) - 1
    sent = order[first]  # by key, so by bucket
    return {"data": data, "offsets": offsets, "ids": ids, "start": r["start"], "n": r["n"], "doc": doc, "number": number, "sent": sent, "key": r["key"]}


def bucket_answers(table: pa.Table, span: int) -> pa.Table:
    """One bucket of anchors: for each sent run the strings that are later copies, as bits."""
    sizes = table["size"].to_pylist()
    docs = np.concatenate([unpack(x, n) for x, n in zip(table["doc"].to_pylist(), sizes)]).astype(np.int64)
    ns = np.concatenate([unpack(x, n) for x, n in zip(table["n"].to_pylist(), sizes)]).astype(np.int64)
    data = np.frombuffer(b"".join(zstandard.decompress(x) for x in table["text"].to_pylist()), np.uint8)
    lengths = ns + span - 1
    starts = np.cumsum(lengths) - lengths
    # equal runs of several blocks: the least document's stays to be compared, the others are copies
    same = contents(data, starts, lengths)
    order = np.lexsort((docs, same))
    first = np.concatenate([[True], same[order][1:] != same[order][:-1]])
    leader = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    kept = np.sort(order[first])
    at = spread(starts[kept], ns[kept])
    copies = later_copies(data, at, np.repeat(docs[kept], ns[kept]), span)
    begins = np.cumsum(ns[kept]) - ns[kept]
    masks = np.zeros(len(ns), np.uint64)
    masks[kept] = np.bitwise_or.reduceat(copies.astype(np.uint64) << (np.arange(len(at)) - np.repeat(begins, ns[kept])).astype(np.uint64), begins)
    masks[order] = np.where(docs[order] > docs[leader], np.uint64(2**64 - 1), masks[leader])
    answers = [pack(x) for x in np.split(masks, np.cumsum(sizes)[:-1])]
    zeros = [0] * len(sizes)
    return arrow({"block": table["block"].to_pylist(), "bucket": table["bucket"].to_pylist(), "answer": answers, "total": zeros, "n_distinct": zeros}, MASKS)


def strings(row: dict, span: int) -> dict[str, list]:
    """STRINGS of one row of runs: its strings by hash in `ways` parts, the bytes of equal ones once."""
    docs, ns = (unpack(row[x], row["size"]).astype(np.int64) for x in ("doc", "n"))
    data = np.frombuffer(zstandard.decompress(row["text"]), np.uint8)
    lengths = ns + span - 1
    at = spread(np.cumsum(lengths) - lengths, ns)
    run = np.repeat(np.arange(len(ns)), ns)
    place = run << 6 | at - np.repeat(np.cumsum(lengths) - lengths, ns)
    same = grams(data, span)[at]
    _, first, which = np.unique(same, return_index=True, return_inverse=True)
    part = (same % np.uint64(row["ways"])).astype(np.int64)
    order = np.lexsort((which, part))
    out: dict[str, list] = {x.split()[0]: [] for x in STRINGS.split(", ")}
    for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        kinds, inner = np.unique(which[own], return_inverse=True)
        text = data[(at[first[kinds]][:, None] + np.arange(span)).ravel()]
        for name, value in zip(out, (row["block"], row["bucket"], row["size"], int(part[own[0]]), len(own), *(zstandard.compress(x.astype(np.int64).tobytes(), 1) for x in (place[own], docs[run[own]], inner)), zstandard.compress(text.tobytes(), 1))):
            out[name].append(value)
    return out


def string_answers(table: pa.Table, span: int) -> pa.Table:
    """One part of a large bucket: of each row the places of the strings that are later copies."""
    data, least_docs, rows = [], [], []
    for row in table.select(["docs", "which", "text"]).to_pylist():
        docs, which = (np.frombuffer(zstandard.decompress(row[x]), np.int64) for x in ("docs", "which"))
        low = np.full(int(which.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, which, docs)
        data.append(zstandard.decompress(row["text"]))
        least_docs.append(low)
        rows.append((docs, which))
    low = np.concatenate(least_docs)
    copies = later_copies(np.frombuffer(b"".join(data), np.uint8), np.arange(len(low)) * span, low, span)
    found, begin = [], 0
    for (docs, which), places in zip(rows, table["places"].to_pylist()):
        gone = copies[begin + which] | (docs > low[begin + which])
        found.append(np.frombuffer(zstandard.decompress(places), np.int64)[gone].tobytes())
        begin += int(which.max()) + 1
    return pa.table([table["block"], table["bucket"], table["size"], pa.array(found, pa.binary())], names=["block", "bucket", "size", "places"])


def string_masks(table: pa.Table) -> pa.Table:
    """The answers of one block and bucket in all parts, as those of bucket_answers."""
    places = np.frombuffer(b"".join(table["places"].to_pylist()), np.int64)
    masks = np.zeros(table["size"][0].as_py(), np.uint64)
    np.bitwise_or.at(masks, places >> 6, np.uint64(1) << (places & 63).astype(np.uint64))
    return arrow({"block": [table["block"][0].as_py()], "bucket": [table["bucket"][0].as_py()], "answer": [pack(masks)], "total": [0], "n_distinct": [0]}, MASKS)


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, removed array<struct<start:long,length:long>>"
KEPT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))])


def remove(table: pa.Table, answers: pa.Table, bits: int, span: int, gram: int) -> pa.Table:
    """What is left of a block's documents."""
    kinds = answers["kind"].to_numpy()
    x = local_runs(table, answers.filter(pa.array(kinds == 0)), bits, span, gram)
    masks = answered(answers.filter(pa.array(kinds == 1)), x["key"][x["sent"]], bits)[x["number"]] if len(x["sent"]) else np.zeros(0, np.uint64)
    masks = np.where(x["doc"] > x["doc"][x["sent"]][x["number"]], np.uint64(2**64 - 1), masks) if len(masks) else masks
    at = spread(x["start"], x["n"])
    bit = (at - np.repeat(x["start"], x["n"])).astype(np.uint64)
    at = at[(np.repeat(masks, x["n"]) >> bit & np.uint64(1)).astype(bool)]
    n = len(x["data"]) + span
    gone = np.cumsum(np.bincount(at, minlength=n) - np.bincount(at + span, minlength=n))[: len(x["data"])] > 0
    offsets, out = x["offsets"], {n: [] for n in KEPT_SCHEMA.names}
    for k, doc_id in enumerate(x["ids"].tolist()):
        own, lost = x["data"][offsets[k] : offsets[k + 1]], gone[offsets[k] : offsets[k + 1]]
        edges = np.flatnonzero(np.diff(lost.astype(np.int8), prepend=0, append=0))
        kept = own[~lost].tobytes() if len(edges) else own.tobytes()
        for name, value in zip(out, (doc_id, len(own), len(own) - len(kept), len(edges) // 2, hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "length": b - a} for a, b in edges.reshape(-1, 2).tolist()])):
            out[name].append(value)
    return pa.table(out, schema=KEPT_SCHEMA)


def remove_later_copies(docs: DataFrame, span: int = 50, gram: int = GRAM, block_mb: float = 4, bucket_mb: float = 24) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes), removed (runs).

    Null text counts as empty; texts under `span` bytes stay whole. Of rows with one doc_id none
    is earlier than another, so they stay beside each other. Null doc_id: before all others. An
    empty table gives an empty result. Matches never cross documents and are judged on the input.
    """
    if not gram < span <= gram + 63:
        raise ValueError("gram must be under span by 63 at most")
    docs = texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(2**62))))
    size = text_bytes(docs)
    blocks = write_blocks(docs, size, block_mb)
    bits = power_of_two(size / (1 << 20)).bit_length() - 1

    def anchors(table: pa.Table) -> pa.Table:
        data, offsets = utf8(table["text"])
        r = runs(data, offsets, span, gram)
        return arrow(blobs(table["block"][0].as_py(), *distinct(r["key"] & ~LOW, table["doc_id"].to_numpy()[r["doc"]])[:2], bits), BLOBS)

    flags = save(global_sums(blocks.groupBy("block").applyInArrow(anchors, BLOBS)), "anchors")

    def send(table: pa.Table, flags: pa.Table) -> pa.Table:
        rows = {n: [] for n in ("block", "bucket", "size", "doc", "n", "text", "bytes")}
        if table.num_rows:
            x = local_runs(table, flags, bits, span, gram)
            at, text = bounds(x["key"][x["sent"]], bits), x["data"]
            for b in np.flatnonzero(np.diff(at)):
                own = x["sent"][at[b] : at[b + 1]]
                begins, n = x["start"][own], x["n"][own]
                for name, value in zip(rows, (table["block"][0].as_py(), int(b), len(own), pack(x["doc"][own].astype(np.uint64)), pack(n), zstandard.compress(text[spread(begins, n + span - 1)].tobytes(), 1), int((n + span - 1).sum()))):
                    rows[name].append(value)
        return arrow(rows, SENT)

    by_block = blocks.groupBy("block")
    sent = save(by_block.cogroup(flags.groupBy("block")).applyInArrow(send, SENT), "sent")
    limit = bucket_mb * 2**20
    large = save(sent.groupBy("bucket").agg(F.sum("bytes").alias("all")).where(F.col("all") > limit).select("bucket", F.ceil(F.col("all") * span / limit).alias("ways")), "large")
    masks = sent.join(large, "bucket", "left_anti").groupBy("bucket").applyInArrow(lambda t: bucket_answers(t, span), MASKS)
    if not large.isEmpty():

        def part(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    yield from arrow(strings(batch.slice(k, 1).to_pylist()[0], span), STRINGS).to_batches()

        dealt = sent.join(F.broadcast(large), "bucket").mapInArrow(part, STRINGS)
        places = dealt.groupBy("bucket", "sub").applyInArrow(lambda t: string_answers(t, span), "block long, bucket int, size int, places binary")
        masks = masks.union(places.groupBy("block", "bucket").applyInArrow(string_masks, MASKS))
    masks = save(masks, "copies")
    answers = flags.withColumn("kind", F.lit(0)).unionByName(masks.withColumn("kind", F.lit(1)))
    kept = by_block.cogroup(answers.groupBy("block")).applyInArrow(lambda t, a: remove(t, a, bits, span, gram), KEPT)
    return kept.withColumn("doc_id", F.nullif("doc_id", F.lit(-(2**62))))
