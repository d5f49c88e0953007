"""Draws, order statistics and paired bootstraps against plain versions; terms prepared once and remade when they change."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from plenum.operators import resample as rs
from plenum.operators import rollcall as rc


def test_order_statistics(spark):
    rng = random.Random(1)
    groups = {"a": [rng.gauss(0, 1) for _ in range(5000)], "b": [0.25] * 3000 + [0.25 + 1e-15, 1e300], "c": [-1e-300, 0.0, 1e-300, 5.0], None: [rng.choice([1.0, 2.0]) for _ in range(500)]}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "g string, v double")
    got = {(r.g, r.place): r.value for r in rs.order_statistics(rows, "v", [0, 1, 3, 250, 4999], "g").collect()}
    assert got == {(k, p): sorted(vs)[p] for k, vs in groups.items() for p in (0, 1, 3, 250, 4999) if p < len(vs)}
    assert rs.order_statistics(rows.limit(0), "v", [0], "g").count() == 0


def plain_samples(rows, n_boot, seed):
    n = len(rows)
    pick = lambda boot, k: rows[int(hashlib.md5(f"{seed}:{boot}:{k}".encode()).hexdigest()[:15], 16) % n]
    return [[pick(b, k) for k in range(n)] for b in range(n_boot)]


def plain_f1(rows, at):
    tp, fp, fn = (sum(r[k] for r in rows) for k in at)
    return 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0


def test_bootstraps(spark):
    rng = random.Random(3)
    rows = [(k * 3, *(rng.randrange(9) for _ in range(4))) for k in range(17)]
    frame = spark.createDataFrame(rows, "no long, tp long, fp long, fn long, strict long")
    for matched, at in (("tp", (1, 2, 3)), ("strict", (4, 2, 3))):
        scores = sorted(plain_f1(s, at) for s in plain_samples(rows, 400, 7))
        got = rs.bootstrap(frame, 400, 7, matched=matched).first()
        assert tuple(got) == pytest.approx((plain_f1(rows, at), scores[10], scores[390]))
    other = frame.withColumn("fp", (F.col("fp") + F.col("no")) % 9)
    second = [(k, tp, (fp + k) % 9, fn, s) for k, tp, fp, fn, s in rows]
    both = [a + b for a, b in zip(rows, second)]
    diffs = sorted(plain_f1(s, (1, 2, 3)) - plain_f1(s, (6, 7, 8)) for s in plain_samples(both, 400, 42))
    point = plain_f1(both, (1, 2, 3)) - plain_f1(both, (6, 7, 8))
    p = min(1.0, 2 * sum((d <= 0) if point >= 0 else (d >= 0) for d in diffs) / 400)
    assert tuple(rs.paired_bootstrap(frame, other, 400).first()) == pytest.approx((point, diffs[10], diffs[390], p))
    for wrong in (other.where("no > 3"), other.union(other.limit(1)), other.withColumn("no", F.col("no") + 1)):
        with pytest.raises(ValueError):
            rs.paired_bootstrap(frame, wrong, 10)
    assert rs.bootstrap(frame.limit(0), 10).count() == 0


def test_draws_are_not_sent_to_all_tasks(spark, monkeypatch):
    frame = spark.range(3000).selectExpr("id AS no", "id % 5 AS tp", "id % 3 AS fp", "id % 2 AS fn").withColumn("mode", F.explode(F.array(*map(F.lit, ("a", "b", None)))))
    frame = frame.withColumn("fp", F.col("fp") + F.col("mode").eqNullSafe("b").cast("int"))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "48m")  # the 3,000,000 draws are more
    try:
        get = lambda: sorted(map(tuple, rs.bootstrap(frame, 1000, 7, "mode").collect()), key=str)
        want = get()
        monkeypatch.setattr(rs.by_tag, "__defaults__", (1,))  # a row a mode
        assert get() == want and len(want) == 3
        monkeypatch.setattr(rs, "SENT", 0)  # dealt by number
        assert get() == want
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_numbering_of_rows(spark):
    rows = spark.range(1000).selectExpr("(id * 37) % 501 AS a", "id % 2 AS b").repartition(5)
    got = rs.numbered(rows, "a", "b").collect()
    assert sorted(r.no for r in got) == list(range(1000))
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.no)] == sorted((r.a, r.b) for r in got)


def test_counts_before(spark):
    """One long history and several short ones, blocks of any size, null days, ties of all but the last key."""
    rng = random.Random(4)
    rows = [(1, rng.choice([None, 1, 2, 3]), k // 2, k % 2, rng.randrange(1, 4)) for k in range(2000)] + [(m, 1, v, 0, 1 + v % 3) for m in (2, 3) for v in range(5)]
    frame = spark.createDataFrame(rows, "member_id long, day int, vote_id long, subject_id long, option int").repartition(4)
    want, seen = set(), {}
    for r in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2], r[3])):
        n = seen.setdefault(r[0], [0, 0, 0])
        want.add((*r, *n))
        n[r[4] - 1] += 1
    for block in (1, 64, 10_000):
        got = rc.counts_before(frame, ["member_id"], [F.col("day"), F.floor(F.col("vote_id") / block)], ["vote_id", "subject_id"])
        assert {tuple(r) for r in got.collect()} == want


def test_spans_of_days(spark):
    days = ["2020-01-05", "2020-03-01", "2020-03-02"]
    spells = [("2019-01-01", None), ("2020-01-05", "2020-01-05"), ("2020-01-06", "2020-02-28"), ("2020-03-01", "2020-03-02"), ("2020-03-02", "2020-03-01"), ("2021-01-01", None), ("2020-01-05", "9999-12-31")]
    frame = spark.createDataFrame(spells, "a string, b string").selectExpr("CAST(a AS DATE) AS d_from", "CAST(b AS DATE) AS d_to")
    dates = spark.createDataFrame([(d,) for d in days], "d string").selectExpr("CAST(d AS DATE) AS day")
    got = {(str(r.d_from), r.d_to and str(r.d_to)): list(range(r.low, r.high + 1)) for r in rc.spans(frame, dates).collect()}
    assert got == {(a, b): [k + 1 for k, d in enumerate(days) if a <= d <= (b or "9999-12-31")] for a, b in spells}


def test_terms_are_remade_where_they_changed(spark, tmp_path):
    from plenum.plans.model import from_orders
    from plenum.plans.prepared import Prepared

    m = from_orders(spark, "/root/testdata/sf0.001")
    own = Prepared(spark, f"file://{tmp_path}/kept")
    remade = lambda: {r.term: r.remade for r in own.refresh(m).collect()}
    same = lambda: rc.with_plurality(rc.with_subject(rc.cast_votes(m), rc.affiliation(m))).select(own.votes().columns).exceptAll(own.votes()).count() == 0
    assert remade() == {9: True, 10: True} and same()
    assert remade() == {9: False, 10: False} and own.counts == {}
    whole = m.memberships
    m.memberships = whole.where("NOT (member_id = 3 AND kind = 'group')")  # changes affiliations alone
    changed = {r.term for r in rc.affiliation(m, "group").select("session_id").join(m.sessions, "session_id").select("term").distinct().collect()}
    assert any(remade().values()) and same() and changed
    sessions = m.sessions
    m.sessions = sessions.where("term = 9")
    assert remade() == {9: False} and same() and own.votes().select("term").distinct().count() == 1
    again = Prepared(spark, own.path)  # as another session finds it
    m.sessions = sessions
    assert {r.term: r.remade for r in again.refresh(m).collect()} == {9: False, 10: True} and same()
    plan = own.votes().groupBy("vote_id", "subject_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
