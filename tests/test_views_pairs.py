"""Views and their manifest, pairs by tiles and by join, itemsets by prefix trees: against plain versions."""

import itertools
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenum.operators import itemsets, pairs
from plenum.operators import rollcall as rc
from plenum.operators import topics as tp
from plenum.sources import views as vw


def test_views_are_read_back(spark, tmp_path):
    root, ddl = f"file://{tmp_path}/v", "term long, member string, n long"
    rows = [(9, "a b/c", 1), (9, "a b/c", 2), (10, "d", 3), (10, None, 4)]
    every = spark.createDataFrame([(9, "a b/c"), (9, "none"), (10, "d"), (10, None)], "term long, member string")
    vw.write_views(spark.createDataFrame(rows, ddl), root, "term", "member", every=every)
    assert {(r.term, r.member): r.rows for r in vw.read_manifest(spark, root).collect()} == {(9, "a b/c"): 2, (9, "none"): 0, (10, "d"): 1, (10, None): 1}
    assert sorted(tuple(r) for r in vw.read_view(spark, root, ddl, term=9, member="a b/c").collect()) == rows[:2]
    assert vw.read_view(spark, root, ddl, term=9, member="none").count() == 0 == vw.read_view(spark, root, ddl, term=8, member="x").count()
    version = vw.current(spark, root)
    broken = spark.createDataFrame(rows, ddl).withColumn("n", F.when(F.col("n") < 4, F.col("n")).otherwise(F.raise_error(F.lit("broken")).cast("long")))
    with pytest.raises(Exception, match="broken"):
        vw.write_views(broken, root, "term", "member")
    assert vw.current(spark, root) == version and vw.read_view(spark, root, ddl, term=10, member="d").count() == 1
    assert {p.name for p in (tmp_path / "v").iterdir() if "CURRENT" not in p.name} == {version}
    vw.write_views(spark.createDataFrame(rows[2:3], ddl), root, "term", "member")
    assert [r.rows for r in vw.read_manifest(spark, root).collect()] == [1] and not (tmp_path / "v" / version).exists()


def test_rows_of_views_are_made_once(spark, tmp_path):
    root, seen = f"file://{tmp_path}/v", tmp_path / "seen"
    seen.mkdir()

    def traced(batches):
        (seen / uuid.uuid4().hex).touch()
        yield from batches

    rows = spark.range(0, 50, 1, 2).selectExpr("id % 3 AS topic", "id AS n").mapInArrow(traced, "topic long, n long")
    vw.write_views(rows, root, "topic")
    assert len(list(seen.iterdir())) == 2  # once a partition
    assert {r.topic: r.rows for r in vw.read_manifest(spark, root).collect()} == {0: 17, 1: 17, 2: 16}


def plain_pairs(rows):
    by, out = {}, {}
    for t, v, m, o in rows:
        by.setdefault((t, v), []).append((m, o))
    for (t, _), voters in by.items():
        for (a, x), (b, y) in itertools.combinations(sorted(voters), 2):
            n = out.setdefault((t, a, b), [0, 0])
            n[0] += x == y
            n[1] += 1
    return {(*k, *n) for k, n in out.items()}


def test_tiles_and_join_agree(spark):
    rng = random.Random(6)
    rows = [(t, v * 10**9, m * 7 - 50, rng.randrange(1, 4)) for t in (1, 2) for v in range(40) for m in range(23) if rng.random() < (0.8 if t == 1 else 0.1)]
    frame = spark.createDataFrame(rows, "term int, vote_id long, member_id long, option int").withColumn("procedural", F.lit(False))
    want = plain_pairs(rows)
    for sizes in ({}, {"members": 5, "width": 8, "stack": 2}):
        assert {tuple(r) for r in pairs.tiled_counts(frame.drop("procedural"), "term", **sizes).collect()} == want
    cols = ["term", "member1", "member2", "agree", "common"]
    for method in ("join", "tiles", "measured"):
        assert {tuple(r) for r in rc.member_pairs(frame, "term", min_common=1, method=method).select(cols).collect()} == want
    assert pairs.tiled_counts(frame.drop("procedural").limit(0), "term").count() == 0


def test_plan_follows_the_density_of_votes(spark):
    dense = spark.range(300).selectExpr("id % 60 AS vote_id", "id DIV 60 AS member_id")
    few = spark.range(6000).selectExpr("id DIV 2 AS vote_id", "(id * 31) % 3000 AS member_id")  # two of 3000 vote
    assert not pairs.sparse(dense) and pairs.sparse(few) and not pairs.sparse(dense.limit(0))


def test_itemsets_by_prefix_trees(spark):
    rng = random.Random(8)
    rows = [(s, k, f"i{int(min(19, rng.expovariate(0.25)))}") for s in ("a", "b") for k in range(60) for _ in range(rng.randrange(1, 9))] + [("a", 0, None), (None, 1, "i0")] * 2
    frame = spark.createDataFrame(rows, "scope string, key long, item string")
    for support, longest, least in ((0.1, 3, 1), (0.05, 4, 2), (0.3, 2, 3)):
        want = set()
        for s in ("a", "b"):
            keys = {}
            for t, k, i in rows:
                if t == s and i:
                    keys.setdefault(k, set()).add(i)
            keys = [v for v in keys.values() if len(v) >= least]
            for size in range(1, longest + 1):
                for c in itertools.combinations(sorted(set().union(*keys)), size):
                    n = sum(set(c) <= k for k in keys)
                    if n and n / len(keys) >= support:
                        want.add((s, c, round(n / len(keys), 9)))
        for groups in (1, 4, 64):
            got = [(r.scope, tuple(r["items"]), round(r.support, 9)) for r in itemsets.frequent_itemsets(frame, support, longest, least, groups).collect()]
            assert len(got) == len(set(got)) and set(got) == want
        if longest < 4:
            level = tp.frequent_itemsets(frame.dropna().distinct(), support, longest, least)
            assert {(r.scope, tuple(r["items"]), round(r.support, 9)) for r in level.collect()} == want


def test_top_pairs_are_found_in_the_tasks(spark, monkeypatch):
    """Whole blocks, blocks cut in parts, runs of one meeting: the pairs with enough common votes, the best of each view."""
    rng = random.Random(9)
    rows = [(t, v, m * 3, rng.randrange(1, 4)) for t in ("a", "b") for v in range(60) for m in range(40) if rng.random() < (0.3 if m % 4 else 0.05)]
    frame = spark.createDataFrame(rows, "topic string, vote_id long, member_id long, option int")
    order = lambda r: (-((2000 * r[3] + r[4]) // (2 * r[4])), -r[4], r[1], r[2])
    want = {r for t in ("a", "b") for r in sorted((r for r in plain_pairs(rows) if r[0] == t and r[4] >= 4), key=order)[:30]}
    for tiles in ({}, {"members": 8, "width": 16, "stack": 1}):
        assert {tuple(r) for r in pairs.tiled_counts(frame, "topic", **tiles, least=4, top=30).collect()} == want
    for lists in ({}, {"members": 8}, {"members": 8, "most": 50}):
        assert {tuple(r) for r in pairs.listed_counts(frame, "topic", **lists, least=4, top=30).collect()} == want
    assert {tuple(r) for r in pairs.listed_counts(frame, "topic", members=8, most=50).collect()} == plain_pairs(rows)
    spread = [("a", v, rng.randrange(10**6), 1 + v % 3) for v in range(300) for _ in range(3)]  # few meet, far apart
    few = spark.createDataFrame(sorted(set(spread)), frame.schema)
    assert {tuple(r) for r in pairs.listed_counts(few, "topic").collect()} == plain_pairs(set(spread))
    assert pairs.listed_counts(frame.limit(0), "topic", top=5).count() == 0
    one = [np.array([0, 0, 1]), np.array([1, 2, 2]), np.array([1, 2, 1]), np.array([2, 3, 2])]
    assert [x.tolist() for x in pairs.kept(*one, 2, 2)] == [[0, 0], [2, 1], [2, 1], [3, 2]]


def test_tiles_hold_a_number_a_vote(spark, monkeypatch):
    """What is kept of a vote cast, and sent to each pair of blocks, is a number."""
    frame = spark.range(400 * 300).selectExpr("id DIV 300 AS vote_id", "id % 300 AS member_id", "CAST(hash(id) & 1 AS INT) + 1 AS option")
    tables, save = {}, pairs.saved
    monkeypatch.setattr(pairs, "saved", lambda df, name: tables.setdefault(name, save(df, name)))
    assert pairs.tiled_counts(frame, members=32).count() == 300 * 299 // 2
    assert dict(tables["tiles"].dtypes)["cells"] == "array<int>"
