"""The seed-and-compare case, rewritten with our names, and queries against their SQL twins."""

import glob
import math
import os

import pytest

from plenum.operators import rollcall as rc
from plenum.operators import topics as tp
from plenum.operators.classes import deduplicated
from plenum.operators.matching import differences, registry_match
from plenum.operators.resample import bootstrap
from plenum.operators.pages import grid, read
from plenum.plans.model import Model

#: The votes of the small case.
VOTES = [[1, 1, 2, 2, 1, 1, 2, 2, 1, 1, 1, 2, 1, 1, 2, 2], [2, 1, 1, 1, 2, 1, 1, 1, 1, 3, 1, 1, 2, 1, 1, 1]]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    group = {1: 1, 2: 3, 3: 2, 0: 4}
    members = [(k, f"m{k}", c, 0) for k, c in zip(range(1, 17), [c for c in ("DEU", "FRA", "POL", "CZE") for _ in range(4)])]
    belongs = [(k, group[k % 4], "group", 99, "2024-01-01", None) for k in range(1, 17)] + [(k, 5 + (k - 1) // 2, "national", 99, "2024-01-01", None) for k in range(1, 17)]
    day = lambda d, *c: d.withColumns({x: d[x].cast("date") for x in c})
    return Model(
        members=spark.createDataFrame(members, "member_id long, name string, country string, nation long"),
        votes=spark.createDataFrame([(k, 1, False, True, None, None) for k in (1, 2)], "vote_id long, session_id long, procedural boolean, valid boolean, final boolean, topic string"),
        sessions=day(spark.createDataFrame([(1, "2024-01-15", 99)], "session_id long, day string, term int"), "day"),
        terms=day(spark.createDataFrame([(99, "2024-01-01", "2024-12-31")], "term int, d_from string, d_to string"), "d_from", "d_to"),
        member_votes=spark.createDataFrame([(v + 1, k + 1, o) for v, row in enumerate(VOTES) for k, o in enumerate(row)], "vote_id long, member_id long, option int"),
        memberships=day(spark.createDataFrame(belongs, "member_id long, subject_id long, kind string, term int, d_from string, d_to string"), "d_from", "d_to"),
        government=spark.createDataFrame([(5, "2023", None)], "subject_id long, year_from string, year_to string"),
        indicators=spark.createDataFrame([], "name string, country string, year int, value double"),
    )


def test_party_cohesion(model):
    assert {r.subject_id: r.ai for r in rc.party_cohesion(model).collect()} == {3: 81.25, 1: 43.75, 2: 43.75, 4: 25.0}


def test_country_cohesion(model):
    # two voters of a vote and more; Poland 3 of 4 in both votes
    assert {r.country: (r.ai, r.votes) for r in rc.country_cohesion(model).collect()} == {"POL": (75.0, 2), "DEU": (62.5, 2), "FRA": (62.5, 2), "CZE": (62.5, 2)}


def test_group_agreement(model):
    got = {(r.subject1, r.subject2): r.agreement for r in rc.group_agreement(model).collect()}
    assert got == {(2, 4): 1.0, (1, 3): 0.5, (2, 3): 0.5, (3, 4): 0.5, (1, 2): 0.0, (1, 4): 0.0}


def test_participation_and_loyalty(model):
    assert {(r.present, r.total, r.ratio) for r in rc.participation(model).collect()} == {(1, 1, 1.0)}
    loyal = sorted(r.loyalty for r in rc.loyalty(rc.group_votes(model)).collect())
    assert loyal == [0.5] * 3 + [1.0] * 13


def test_tiled_pairs_equal_join_pairs(model):
    votes = rc.cast_votes(model)
    a, b = (sorted(rc.member_pairs(votes, min_common=1, method=k).select("member1", "member2", "agree", "common").collect()) for k in ("join", "tiles"))
    assert a == b and len(a) == 120


def test_p_value(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0.5, 12), (0.9, 3), (0.3, 27), (1.0, 5), (0.2, 4)], "r double, n long")
    got = [r.p for r in rows.select(tp.two_sided_p(F.col("r"), F.col("n")).alias("p")).collect()]

    def by_hand(r, n):  # the density of t, summed numerically
        k, t = n - 2, abs(r) * math.sqrt((n - 2) / (1 - r * r))
        c = math.gamma((k + 1) / 2) / math.sqrt(k * math.pi) / math.gamma(k / 2)
        m = 20000
        f = lambda x: c * (1 + x * x / k) ** (-(k + 1) / 2)
        return 1 - 2 * t / m * (sum(f(t * (i + 0.5) / m) for i in range(m)))

    assert got[3] == 0
    for k in (0, 1, 2, 4):
        assert abs(got[k] - by_hand(*rows.collect()[k])) < 1e-5


def test_fill_linear_without_data(spark):
    s = spark.createDataFrame([("x", "a", y, float(y - 1990)) for y in range(1990, 1995)] + [("x", "a", 1995, None), ("x", "b", 1992, None)], "name string, country string, year int, value double")
    got = {(r.country, r.year): (r.value, r.predicted) for r in tp.filled(s, "linear").collect()}
    assert got["a", 1995] == (5.0, True) and got["b", 1992] == (2.0, True) and got["a", 1990] == (0.0, False)


def test_matching(spark):
    party = spark.createDataFrame([(1, "X", ["green left", "gl"]), (2, "X", ["labour"]), (3, "X", ["none"])], "key long, country string, aliases array<string>")
    body = spark.createDataFrame([("X", "Green Left", ["green left"]), ("X", "Labour Party", ["labour party"])], "country string, label string, aliases array<string>")
    assert {r.key: (r.label, r.method) for r in registry_match(party, body).collect()} == {1: ("Green Left", "exact_alias"), 2: ("Labour Party", "token_containment"), 3: (None, "no_match")}


def test_bootstrap_and_compare(spark):
    r = spark.createDataFrame([(k, 8, 1, 1) for k in range(10)], "no long, tp long, fp long, fn long")
    got = bootstrap(r, 200).first()
    assert abs(got.low - 8 / 9) < 1e-9 and abs(got.high - 8 / 9) < 1e-9
    a, b = (spark.createDataFrame(x, "k long, v double") for x in ([(1, 1.0), (2, 2.0)], [(1, 1.005), (2, 3.0), (3, 0.0)]))
    assert sorted(x.k for x in differences(a, b, "k").collect()) == [2, 3]


def test_tables_with_spans():
    page = read("<table><tr><td rowspan=2>a</td><td colspan=2>b</td></tr><tr><td>c</td><td>d</td></tr><tr><td></td></tr></table><script>x</script><h2>T</h2><p>see <a href='/u'>it</a></p>")
    assert grid(page.tables[0]) == [["a", "b", "b"], ["a", "c", "d"]]
    assert page.lines[-2:] == ["## T", "see [it](/u)"]
    assert grid([]) == [] and read(None).lines == []


@pytest.mark.parametrize("name", ["member_loyalty", "government_loyalty", "session_attendance", "anomalous_votes", "opposition_items", "csv_vote_rows", "indicator_fill_loglinear"])
def test_sql_twin(spark, name):
    import duckdb

    import __spark_entry__ as entry

    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = entry.queries()[name](spark, SF)
    r = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    want = sorted(str([x[names.index(c)] for c in sorted(names)]) for x in r.fetchall())
    assert sorted(df.columns) == sorted(names) and sorted(str([x[c] for c in sorted(names)]) for x in df.collect()) == want


def test_pairs_in_the_order_of_truth(spark):
    """A truth party tries all its means before the next may choose; ambiguous single words pair nothing."""
    from plenum.operators import evaluation as ev

    cols = "country string, year long, pos long, name string, abbr string"
    truth = [("X", 2020, 0, "Croatian Democratic Union", "HDZ"), ("X", 2020, 1, "HDZ", None), ("X", 2020, 2, "Estonian Reform Party", None), ("X", 2020, 3, "Green Left", None), ("Y", 2020, 0, "Green Left", None), ("Z", 2020, 0, "Ab cd", None)]
    found = [("X", 2020, 0, "HDZ", None), ("X", 2020, 1, "Reform", None), ("X", 2020, 2, "The Green of Left (Green Left)", None), ("Y", 2020, 0, "Green", None), ("Y", 2020, 1, "Left", None), ("Z", 2020, 0, "cd", None)]
    t, x = (ev.named(spark.createDataFrame(rows, cols), "name", "abbr") for rows in (truth, found))
    assert {(r.country, r.t, r.x) for r in ev.paired(t, x).collect()} == {("X", 0, 0), ("X", 2, 1), ("X", 3, 2)}


def test_chains_of_equal_subjects(spark):
    """A chain of wiki ids and names in turn is followed to its end; nulls tie nothing."""
    rows = [(k, f"Q{(k + 1) // 2}", f"A{k // 2}", None if k < 8 else "C") for k in range(8)] + [(20, None, None, "C"), (21, None, None, "C"), (22, None, "A3", "C")]
    got = {r.id: r.canonical for r in deduplicated(spark.createDataFrame(rows, "id long, wiki_id string, abbr string, country string")).collect()}
    assert got == {k: 0 for k in range(8)} | {20: 20, 21: 21, 22: 22}


def test_record_report_and_empty_records(spark, tmp_path):
    from plenum.operators import evaluation as ev

    kinds = "country string, year long, pos long, name string, seats long, in_government boolean"
    truth = ev.named(spark.createDataFrame([("A", 1, 0, "One", 5, True), ("A", 1, 1, "Two", 6, None), ("B", 1, 0, "Three", 1, True)], kinds))
    found = ev.named(spark.createDataFrame([("A", 1, 0, "one", 5, False), ("A", 1, 1, "two", 6, True), ("C", 1, 0, "four", 1, True)], kinds))
    records = ev.record_scores(truth, found, ev.paired(truth, found))
    got = {r.country: r for r in records.collect()}
    assert (got["A"].tp, got["A"].strict, got["A"].government_accuracy, got["A"].existence_f1) == (2, 1, 0.0, 1.0)
    assert (got["B"].existence_precision, got["B"].existence_f1, got["B"].fn) == (None, None, 1) and (got["C"].existence_recall, got["C"].fp) == (None, 1)
    ev.write_report(records, str(tmp_path))
    assert {r.country for r in spark.read.json(f"{tmp_path}/countries").collect()} == {"A", "B", "C"} and spark.read.json(f"{tmp_path}/overall").first().tp == 2


def test_landed_files(spark, tmp_path):
    """Dumps (plain and gzip), envelopes, bindings and arrays are read from files, and views and terms written to them."""
    import gzip
    import json

    from plenum.operators import flatten as fl
    from plenum.sources import landed as ld

    head = "id,timestamp,display_title,count_for,count_against,count_abstention,count_did_not_vote,procedure_reference,texts_adopted_reference,is_main,procedure_type,procedure_title\n"
    (tmp_path / "votes.csv").write_text(head + '1,2024-01-02T03:04:05Z,"A, ""b""",3,1,,2,R,,true,COD,\n2,,,0,0,0,,,,,,T\n')
    with gzip.open(tmp_path / "members.csv.gz", "wt") as f:
        f.write("vote_id,member_id,position\n1,7,FOR\n1,8,DID_NOT_VOTE\n1,9,AGAINST\n")
    rows = {r.vote_id: r for r in ld.vote_rows(ld.read_votes(spark, f"{tmp_path}/votes.csv")).collect()}
    assert rows[1].subject_text == 'A, "b"' and rows[1].outcome == "ADOPTED" and rows[1].final and not rows[1].procedural
    assert rows[2].outcome == "LAPSED" and rows[2].subject_text == "T" and rows[2].ts is None
    members = spark.createDataFrame([(7, 70), (8, 80)], "ep_id long, member_id long")
    assert [tuple(r) for r in ld.member_vote_rows(ld.read_member_votes(spark, f"{tmp_path}/members.csv.gz"), members).collect()] == [(1, 70, 1)]
    (tmp_path / "doc.json").write_text(json.dumps({"data": [{"id": 1, "tags": {"a": {"b": 1}, "c": {"b": 2}}}, {"id": 2}]}))
    assert {r.id for r in ld.read_envelope(spark, f"{tmp_path}/doc.json", "id LONG").collect()} == {1, 2}
    (tmp_path / "sparql.json").write_text(json.dumps({"results": {"bindings": [{"item": {"value": "Q1"}}, {"acronym": {"value": "X"}}]}}))
    assert {tuple(r) for r in ld.read_bindings(spark, f"{tmp_path}/sparql.json", "item", "acronym").collect()} == {("Q1", ""), ("", "X")}
    (tmp_path / "truth").mkdir()
    (tmp_path / "truth/a.json").write_text(json.dumps({"country": "A", "parties": [{"party_name": "x"}]}))
    (tmp_path / "truth/b.json").write_text(json.dumps({"country": "B", "parties": "none"}))
    assert [r.country for r in ld.read_arrays(spark, f"{tmp_path}/truth/*.json", "country STRING, parties ARRAY<STRUCT<party_name: STRING>>", "parties").collect()] == ["A"]
    (tmp_path / "wide.tsv").write_text("freq,unit,geo\\TIME_PERIOD\t1999 \t2000 \nA,T,AT\t1 b\t: \nA,M,BE\t-2.5\t4 e\n")
    wide = fl.by_dimensions(ld.read_wide(spark, f"{tmp_path}/wide.tsv"), {"unit": "T", "sex": "F"}, countries=["AT", "BE"])
    assert {tuple(r) for r in ld.years_to_rows(wide).collect()} == {("AT", 1999, 1.0), ("AT", 2000, None)}
    assert {(r.geo, r.value) for r in ld.years_to_rows(ld.read_wide(spark, f"{tmp_path}/wide.tsv").where("unit = 'M'")).collect()} == {("BE", -2.5), ("BE", 4.0)}
    doc = spark.read.text(f"{tmp_path}/doc.json").withColumnRenamed("value", "doc")
    assert sorted(r.leaf for r in fl.leaves(doc, "doc", "data/*/tags/*/b").collect()) == ["1", "2"]
    df = spark.createDataFrame([("9", "a b/c", 1), ("10", "d", 2)], "term string, member string, n int")
    ld.write_views(df, f"{tmp_path}/views", "term", "member")
    assert (tmp_path / "views/term=9/member=a_b_c").is_dir()
    ld.replace_terms(df, f"{tmp_path}/terms")
    ld.replace_terms(spark.createDataFrame([("9", "z", 5)], df.schema), f"{tmp_path}/terms")
    assert sorted((str(r.term), r.n) for r in spark.read.parquet(f"{tmp_path}/terms").collect()) == [("10", 2), ("9", 5)]
