"""The prefix trie of conversations, by digests of blocks of turns first and of turns where they part.

A turn's digest holds its place, role and text; a node is known by its depth and the XOR of the
digests up to it (128 bits). Conversations meet in blocks of a fixed number of turns. Where a
block is the only one behind its predecessor, all its nodes have the block's own members; only
blocks with siblings are opened turn by turn, once for each distinct block.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenum.llm.common import partitions, save

WORD = r"[^\x20\x09-\x0D]+"
NODE, ABOVE = ["depth", "key1", "key2"], ["depth", "above1", "above2"]
CHUNK = "depth long, key1 long, key2 long, first long, ids string"
DIGEST = "depth long, key1 long, key2 long, ends_sha256 string"


def ordered(turns: DataFrame) -> DataFrame:
    """conv_id, place, digest, words of every turn, `place` ascending along the table in the order of conversations and turns.

    Sorted by range, so that one long conversation is dealt over many tasks; of the numbering
    the driver sees one number a partition.
    """
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).where("conv_id IS NOT NULL")
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    rows = rows.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.select("conv_id", F.unhex(digest).alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("id"))
    rows = save(rows, "turns").withColumn("part", F.shiftright("id", 33))
    sizes = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect())
    begin, at = [], 0
    for part, n in sizes:
        begin.append((part, at))
        at += n
    begin = F.broadcast(rows.sparkSession.createDataFrame(begin, "part long, begin long"))  # a row a partition
    return rows.join(begin, "part").select("conv_id", (F.col("begin") + F.col("id").bitwiseAND((1 << 33) - 1)).alias("place"), "digest", "words")


def rebuilt(turns: DataFrame, base: str, head: str) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id) and their turns (conv_id, depth from 1, x1, x2, words) after rebuilding.

    base and head: SQL over conv_id; the first `head` turns of the conversation `base` (all if it
    has fewer, none if it is not there) stand for the conversation's own first `head`.
    """
    rows = ordered(turns)
    own = rows.groupBy("conv_id").agg(F.min("place").alias("begin"), F.count("*").alias("n")).select("*", F.expr(base).cast("long").alias("base"), F.expr(head).cast("long").alias("head"))
    other = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = save(own.join(other, "base", "left").select("conv_id", "begin", "base", "head", F.least("head", F.coalesce("base_n", F.lit(0))).alias("taken")), "conversations")
    most = convs.agg(F.max("head")).first()[0] or 0
    place = F.col("place") - F.col("begin") + 1
    numbered = rows.join(convs, "conv_id").withColumn("i", place).where((F.col("i") <= most) | (F.col("i") > F.col("head")))
    numbered = save(numbered.select("conv_id", "i", F.when(F.col("i") > F.col("head"), F.col("i") - F.col("head") + F.col("taken")).alias("depth"), "digest", "words"), "numbered")
    heads = numbered.where(F.col("i") <= most).select(F.col("conv_id").alias("base"), F.col("i").alias("depth"), "digest", "words")
    heads = heads.join(convs.where("taken > 0").select("conv_id", "base", "taken"), "base").where("depth <= taken")
    cols = ["conv_id", "depth", "digest", "words"]
    both = numbered.where("depth IS NOT NULL").select(cols).unionByName(heads.select(cols))
    x = (F.xxhash64(F.lit(k), "depth", "digest").alias(f"x{k}") for k in (1, 2))
    return convs.select("conv_id"), both.select("conv_id", "depth", *x, "words")


def carried(rows: DataFrame, most: int, fan: int = 256) -> DataFrame:
    """rows(conv_id, k, x1, x2, words) with what all earlier k of the conversation come to: above1, above2, before.

    In levels of `fan`, so that no task walks a long conversation; most: the greatest k.
    """
    rows = rows.withColumn("s", F.floor(F.col("k") / fan))
    earlier = Window.partitionBy("conv_id", "s").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    over = lambda c: F.coalesce(c.over(earlier), F.lit(0).cast("long"))
    out = rows.withColumns({"above1": over(F.bit_xor("x1")), "above2": over(F.bit_xor("x2")), "before": over(F.sum("words"))})
    if most < fan:
        return out.drop("s")
    sums = rows.groupBy("conv_id", F.col("s").alias("k")).agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("words").alias("words"))
    up = carried(sums, most // fan, fan).select("conv_id", F.col("k").alias("s"), F.col("above1").alias("u1"), F.col("above2").alias("u2"), F.col("before").alias("u"))
    out = out.join(up, ["conv_id", "s"])
    return out.withColumns({"above1": F.col("above1").bitwiseXOR(F.col("u1")), "above2": F.col("above2").bitwiseXOR(F.col("u2")), "before": F.col("before") + F.col("u")}).drop("s", "u", "u1", "u2")


def blocks_of(turns: DataFrame, size: int) -> DataFrame:
    """Blocks of `size` turns: conv_id, k, keys before and behind it, words before it, its turns in order."""
    turn = F.struct("depth", "x1", "x2", "words")
    rows = turns.groupBy("conv_id", F.floor((F.col("depth") - 1) / size).alias("k")).agg(
        F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("words").alias("words"), F.sort_array(F.collect_list(turn)).alias("turns")
    )  # `size` turns at most
    rows = save(rows, "turn_blocks")
    most = rows.agg(F.max("k")).first()[0] or 0
    out = carried(rows, most)
    return save(out.select("conv_id", "k", "above1", "above2", "before", F.col("above1").bitwiseXOR(F.col("x1")).alias("key1"), F.col("above2").bitwiseXOR(F.col("x2")).alias("key2"), "words", "turns"), "chained_blocks")


def opened(kinds: DataFrame, sums: list[str], least: str) -> DataFrame:
    """A row for each node of the distinct blocks kinds(..., turns, only, sums, least).

    Blocks without a sibling give their nodes as they are; the turns of the others are met by key
    and their `sums` added, the least of `least` kept.
    """
    at = kinds.select("*", F.posexplode("turns").alias("pos", "turn"))
    xor = lambda c, x, n: F.aggregate(F.slice("turns", F.lit(1), n), F.col(c), lambda a, t: a.bitwiseXOR(t[x]))
    before = F.aggregate(F.slice("turns", F.lit(1), F.col("pos")), F.col("before"), lambda a, t: a + t["words"])
    named = [F.col("turn.depth").alias("depth"), *(xor(f"above{k}", f"x{k}", F.col("pos") + 1).alias(f"key{k}") for k in (1, 2)), *(xor(f"above{k}", f"x{k}", F.col("pos")).alias(f"above{k}") for k in (1, 2)), F.col("turn.words").alias("words"), before.alias("before")]
    rows = at.select(*named, *sums, least, "only")
    keys = [*NODE, "above1", "above2", "words", "before"]
    met = rows.where("NOT only").groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums), F.min(least).alias(least))
    return rows.where("only").select(*keys, *sums, least).unionByName(met)


def end_digests(ends: DataFrame) -> DataFrame:
    """ends(depth, key1, key2, conv_id) to the SHA-256 of each node's ids, ascending, comma-joined.

    Ids are joined to chunks where they stand after a sort by range; a node's chunks then pass
    one task in order and only the state of the hash is held: a digest is sequential by nature.
    """
    spark = ends.sparkSession

    def join(batches):
        held, key = [], None

        def row():
            return pa.RecordBatch.from_pydict({"depth": [key[0]], "key1": [key[1]], "key2": [key[2]], "first": [held[0]], "ids": [",".join(map(str, held))]})

        for batch in batches:
            for *own, i in zip(*(batch.column(c).to_pylist() for c in (*NODE, "conv_id"))):
                if held and (own != key or len(held) == 1 << 16):
                    yield row()
                    held = []
                key = own
                held.append(i)
        if held:
            yield row()

    def digest(batches):
        state, key, out = None, None, {"depth": [], "key1": [], "key2": [], "ends_sha256": []}

        def put():
            for c, v in zip(out, (*key, state.hexdigest())):
                out[c].append(v)

        for batch in batches:
            for *own, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
                if own != key:
                    if key:
                        put()
                    state, key = hashlib.sha256(), own
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("depth", pa.int64()), ("key1", pa.int64()), ("key2", pa.int64()), ("ends_sha256", pa.string())]))
            out = {c: [] for c in out}
        if key:
            put()
            yield pa.RecordBatch.from_pydict(out)

    order = [*NODE, "conv_id"]
    chunks = ends.select(order).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(join, CHUNK)
    return chunks.repartition(partitions(spark), *NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digest, DIGEST)


def prefix_trie(turns: DataFrame, base: str = "conv_id", head: str = "0", size: int = 4) -> DataFrame:
    """turns(conv_id, turn, role, text) to the nodes of the trie of the (rebuilt) conversations, a row each.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves, saved_tokens (over the subtree, (n_convs - 1) * words of a node's text), ends_sha256
    (of the ids of those that end there). base, head: see `rebuilt`; `size`: turns of a block.

    Turns go by number, null first, ties by role and then text; repeated rows are turns of their
    own. Null role or text: empty. Rows with a null conv_id belong to no conversation. An empty
    table gives no row, else the root is there, with turnless conversations as its members. Other
    columns are not read. Long conversations are numbered, chained and counted in pieces; texts of
    any length are digested where they stand.

    Subtrees need no walk: saved tokens are the members' words behind the node, less each node's
    own words once; a node's words count at its smallest member, and so does a leaf.
    """
    convs, rows = rebuilt(turns, base, head)
    blocks = blocks_of(rows, size)
    ends = blocks.groupBy("conv_id").agg(F.max(F.get("turns", F.size("turns") - 1)["depth"]).alias("depth"), F.bit_xor(F.col("key1").bitwiseXOR(F.col("above1"))).alias("key1"), F.bit_xor(F.col("key2").bitwiseXOR(F.col("above2"))).alias("key2"), F.sum("words").alias("total"))
    ends = save(convs.join(ends, "conv_id", "left").select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in (*NODE, "total"))), "ends")

    block = ["k", "key1", "key2"]
    kinds = blocks.groupBy(*block, "above1", "above2", "before").agg(F.first("turns").alias("turns"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    kinds = save(kinds, "kinds")
    alone = kinds.groupBy("k", "above1", "above2").agg(F.count("*").alias("siblings"), F.min("key1").alias("key1"), F.min("key2").alias("key2")).where("siblings = 1")
    kinds = kinds.join(alone.select(*block, F.lit(True).alias("only")), block, "left").withColumn("only", F.coalesce("only", F.lit(False)))
    nodes = save(opened(kinds, ["n"], "conv_id"), "nodes")
    children = save(nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("above1").alias("key1"), F.col("above2").alias("key2")).agg(F.count("*").alias("n_children")), "children")

    owned = nodes.join(children, NODE, "left").groupBy("conv_id").agg(F.sum("words").alias("own"), F.max(F.col("n_children").isNull().cast("long")).alias("leaf"))
    values = save(ends.join(owned, "conv_id", "left").select("conv_id", "total", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("own", "leaf"))), "values")
    first = F.struct("conv_id", "total", "own")
    more = [F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("total", "own", "leaf")), F.min(first).alias("first")]
    sums = blocks.select("conv_id", *block).join(values, "conv_id").groupBy(*block).agg(*more)
    counted = opened(kinds.drop("n", "conv_id").join(sums, block), ["n", "total", "own", "leaf"], "first")
    zero = F.lit(0).cast("long")
    root = values.agg(*more).where("n > 0").select(*(zero.alias(c) for c in (*NODE, "above1", "above2", "words", "before")), "n", "total", "own", "leaf", "first")

    tops = save(root.select(F.col("first.conv_id").alias("parent_conv_id")), "root")  # one row
    low = counted.where("depth = 1").crossJoin(F.broadcast(tops))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("key1").alias("above1"), F.col("key2").alias("above2"), F.col("conv_id").alias("parent_conv_id"))
    high = counted.where("depth > 1").join(above, ABOVE)
    every = low.unionByName(high).unionByName(root.withColumn("parent_conv_id", F.lit(None).cast("long")))
    every = every.join(children, NODE, "left").join(end_digests(ends), NODE, "left")
    once = F.col("own") - F.col("first.own") + F.col("first.total") - F.col("before")
    return every.select(
        F.col("first.conv_id").alias("conv_id"),
        "depth",
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        F.coalesce("n_children", zero).alias("n_children"),
        F.when(F.col("n_children").isNull(), F.lit(1).cast("long")).otherwise(F.col("leaf")).alias("n_leaves"),
        (F.col("total") - F.col("n") * F.col("before") - once).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def brute_sql() -> str:
    """The contract's nodes in DuckDB's SQL, every prefix of every conversation spelled out."""
    return r"""WITH bits AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) r(i)) x),
    o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id),
    c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_concat([4294967295], [CAST(ascii(d) AS BIGINT) FOR d IN string_split(CAST(conv_id AS VARCHAR), '')]), lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1])), 4294967295) % 4 AS h FROM own, bits),
    r AS (SELECT c.conv_id, o.i AS d, role, text FROM c JOIN o ON o.conv_id = c.base AND o.i <= h
        UNION ALL SELECT c.conv_id, least(h, coalesce(b.n, 0)) + o.i - h, role, text FROM c LEFT JOIN own b ON b.conv_id = c.base JOIN o ON o.conv_id = c.conv_id AND o.i > h),
    m AS (SELECT conv_id, d, string_agg(sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY d) AS key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r UNION ALL SELECT conv_id, 0, '', 0 FROM own),
    n AS (SELECT d, key, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words FROM m GROUP BY d, key),
    k AS (SELECT d - 1 AS d, left(key, len(key) - 64) AS key, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
    u AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.d = n.d AND k.key = n.key),
    s AS (SELECT m.d, m.key, sum((u.n - 1) * u.words) AS saved, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM u JOIN m ON m.conv_id = u.conv_id AND m.d <= u.d GROUP BY ALL),
    e AS (SELECT d, key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM (SELECT *, max(d) OVER (PARTITION BY conv_id) AS last FROM m) x WHERE d = last GROUP BY d, key)
    SELECT u.conv_id, u.d AS depth, p.conv_id AS parent_conv_id, u.n AS n_convs, u.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
    FROM u JOIN s ON s.d = u.d AND s.key = u.key LEFT JOIN n p ON u.d > 0 AND p.d = u.d - 1 AND p.key = left(u.key, len(u.key) - 64) LEFT JOIN e ON e.d = u.d AND e.key = u.key"""
