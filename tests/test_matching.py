"""Names, pairing, registry and entity ids against plain versions, and classes of subjects."""

import random
import re
import time
import unicodedata

import pytest

from plenum.functions import text as tx
from plenum.operators import classes as cl
from plenum.operators import evaluation as ev
from plenum.operators import matching as mt

NAMES = ["Strana zelených", "Strana zelenych", "Zelení!", "zeleni", "Union (the people)", "People", "UP", "Union of Left (UL)", "left", "Unión de izquierda (UL)", "", None, "(x)", "Ő", "o", "ﬁne party", "Party (Fine) (é)", "reform", "Estonian Reform Party", "re form", "Straße", "ab", "Q"]


def ascii_form(name):
    name = unicodedata.normalize("NFKD", re.sub(r"\([^)]*\)", "", name or "")).encode("ascii", "ignore").decode()
    return " ".join(re.findall("[a-z0-9]+", name.lower()))


def folded_form(name):
    name = "".join(c for c in unicodedata.normalize("NFKD", name or "") if not unicodedata.combining(c))
    return " ".join(re.findall("[a-z0-9]+", name.lower()))


def own_aliases(name, abbr=None):
    found = [ascii_form(name), *(ascii_form(x) for x in re.findall(r"\(([^)]*)\)", name or "")), ascii_form(abbr)]
    return list(dict.fromkeys(x for x in found if x))


def plain_pairs(truth, found):
    free, pairs = dict(enumerate(found)), set()
    for t, (name, abbr) in enumerate(truth):
        aliases = own_aliases(name, abbr)
        hit = next((k for a in aliases for k, x in free.items() if a in own_aliases(x)), None)
        if hit is None:
            words = set(ascii_form(name).split()) | set(ascii_form(abbr).split())
            near = {k for k, x in free.items() for a in aliases if " " not in a and len(a) >= 3 and a in ascii_form(x).split()}
            near |= {k for k, x in free.items() if len(ascii_form(x)) >= 3 and ascii_form(x) in words}
            hit = near.pop() if len(near) == 1 else None
        if hit is not None:
            pairs.add((t, hit))
            del free[hit]
    return pairs


def test_pairing_of_names(spark):
    rng = random.Random(1)
    records = [([(rng.choice(NAMES), rng.choice(NAMES)) for _ in range(rng.randrange(7))], [rng.choice(NAMES) for _ in range(rng.randrange(7))]) for _ in range(60)]
    records += [([("Strana zelených", None)], ["Strana zelenych"]), ([("Union (the people)", None)], ["People"])]
    truth = spark.createDataFrame([(1, y, k, n, a) for y, (t, _) in enumerate(records) for k, (n, a) in enumerate(t)], "country long, year long, pos long, name string, abbr string")
    found = spark.createDataFrame([(1, y, k, n) for y, (_, x) in enumerate(records) for k, n in enumerate(x)], "country long, year long, pos long, name string")
    got = {(r.year, r.t, r.x) for r in ev.paired(ev.named(truth, "name", "abbr"), ev.named(found)).collect()}
    want = [plain_pairs(*r) for r in records]
    assert got == {(y, *p) for y, ps in enumerate(want) for p in ps}
    assert want[-2] == {(0, 0)} and want[-1] == set()  # what stands in parentheses gives no words


def test_first_attempts(spark):
    parties = spark.createDataFrame([(1, "u1", "Zelení!"), (2, None, "(a) x"), (3, "u3", None), (4, "u4", "y")], "key long, url string, name string")
    tried = spark.createDataFrame([(7, None, "zeleni"), (5, "u1", "z"), (9, "u3", "X"), (8, "u9", ""), (2, "", "q")], "no long, url string, name string")
    assert {r.key: r.no for r in ev.first_attempts(parties, tried).collect()} == {1: 5, 2: 9, 3: 8, 4: None}


def folded_aliases(name, *more):
    found = [name, re.sub(r"\([^)]*\)", " ", name or ""), *re.findall(r"\(([^)]*)\)", name or ""), *more]
    return {folded_form(x) for x in found} - {""}


def plain_match(aliases, bodies):
    exact = {label for label, names in bodies.items() if aliases & names}
    if exact:
        return (exact.pop(), "exact_alias") if len(exact) == 1 else (None, "ambiguous")
    single = lambda names: {a for a in names if " " not in a and len(a) >= 2}
    words = lambda names: {w for a in names for w in a.split()}
    near = {label for label, names in bodies.items() if single(aliases) & words(names) or single(names) & words(aliases)}
    return (near.pop(), "token_containment") if len(near) == 1 else (None, "ambiguous" if near else "no_match")


def test_registry(spark):
    rng = random.Random(2)
    pool = NAMES + ["green left", "green", "Grün links", "Ünion", "a b", "b", "the Q"]
    parties = [(k, k % 4, rng.choice(pool), rng.choice(pool)) for k in range(300)]
    bodies = [(k % 3, f"L{k % 17}", rng.choice(pool), rng.choice(pool)) for k in range(40)]
    by = {}
    for c, label, name, alt in bodies:
        by.setdefault(c, {}).setdefault(label, set()).update(folded_aliases(name, alt))
    forms = lambda rows, names: spark.createDataFrame(rows, f"{names}, name string, alt string").withColumn("aliases", tx.aliases(*map(tx.F.col, ("name", "alt")), form="folded"))
    got = {r.key: (r.label, r.method) for r in mt.registry_match(forms(parties, "key long, country long"), forms(bodies, "country long, label string")).collect()}
    assert got == {k: plain_match(folded_aliases(name, alt), by.get(c, {})) for k, c, name, alt in parties}
    assert {m for _, m in got.values()} == {"exact_alias", "token_containment", "ambiguous", "no_match"}
    one = lambda party, body: mt.registry_match(spark.createDataFrame([(1, 1, party)], "key long, country long, aliases array<string>"), spark.createDataFrame([(1, "G", body)], "country long, label string, aliases array<string>")).first()
    assert one(["green left"], ["green"]).method == "token_containment" and one(["g left"], ["g"]).method == "no_match"


def test_registry_of_one_large_country(spark):
    """A word that all share brings no row for a pair of party and body."""
    n = 30_000
    parties = spark.range(n).selectExpr("id AS key", "1L AS country", "array('party of ' || id, IF(id % 2 = 0, 'w' || id, 'party')) AS aliases")
    bodies = spark.range(n).selectExpr("1L AS country", "'B' || id AS label", "array('the w' || id, 'party') AS aliases")
    began = time.time()
    got = {r.method: r.n for r in mt.outcomes(mt.registry_match(parties, bodies)).collect()}
    assert got == {"ambiguous": n} and time.time() - began < 60


@pytest.mark.parametrize("script, want", [
    ('{"mainEntity": "http://www.wikidata.org/entity/Q12"}', "Q12"), ("{broken", None), ('{"sameAs": "https://wikidata.org/Q3"}', "Q3"), ('{"mainEntity": "https://other.org/Q4", "sameAs": "wikidata.org/Q5"}', None),
    ('{"mainEntity": "", "sameAs": "wikidata.org/Q6"}', "Q6"), ("[1]", None), ('{"mainEntity": {"@id": "wikidata.org/Q7"}, "sameAs": "wikidata.org/Q8"}', None), ('{"sameAs": ["wikidata.org/Q9"]}', None), ("", None),
])
def test_entity_ids(spark, script, want):
    tag = f"<script type='application/ld+json'>{script}</script>"
    pages = [(1, tag), (2, f'<p>{tag}</p><SCRIPT async type="application/ld+json" id=x>\n{{"sameAs": "//wikidata.org/wiki/Q99"}}\n</SCRIPT>'), (3, None), (4, '<script type="text/x">{"sameAs": "wikidata.org/Q1"}</script>')]
    got = {r.k: r.e for r in spark.createDataFrame(pages, "k int, html string").select("k", tx.entity_id(tx.F.col("html")).alias("e")).collect()}
    assert got == {1: want, 2: want or "Q99", 3: None, 4: None}


def test_classes_of_a_long_chain(spark):
    n = 10_000
    links = spark.range(1, n).selectExpr("(id * 7919) % 10007 AS a", "((id + 1) * 7919) % 10007 AS b")  # in no order of ids
    found, rounds = cl.classes(links)
    rows = {r.id: r.least for r in found.collect()}
    assert len(rows) == n and set(rows.values()) == {min(rows)} and rounds < 20
    found, _ = cl.classes(spark.createDataFrame([(1, 1), (None, 2), (5, 4), (9, 8), (8, 5)], "a long, b long"))
    assert {r.id: r.least for r in found.collect()} == {4: 4, 5: 4, 8: 4, 9: 4}


def test_deduplicated(spark):
    rows = [(5, "w1", None, None), (4, "w1", "A", None), (9, None, "A", None), (8, None, "A", "x"), (7, None, None, None), (3, None, "A", "x")]
    got = cl.deduplicated(spark.createDataFrame(rows, "id long, wiki_id string, abbr string, country string"))
    assert {r.id: r.canonical for r in got.collect()} == {5: 4, 4: 4, 9: 4, 8: 3, 7: 7, 3: 3}


def test_alias_resolution(spark, tmp_path):
    """The registered query against its SQL, with suppliers of one name and nation, of one name alone and without a name."""
    import duckdb

    import __spark_entry__ as e

    names = [(1, "Supplier#000000001", 3), (2, "Supplier#000000002", 3), (3, "Supplier#000000003", 4), (4, None, 3), (5, None, 3), (6, "", 3), (7, "Supplier#00000000", None), (8, "Supplier#00000000", None), (9, "x", 3)]
    spark.createDataFrame(names, "s_suppkey long, s_name string, s_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(k // 3, k % 3, k % 11) for k in range(60)], "l_orderkey long, l_linenumber int, l_suppkey long").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("supplier", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = e.queries()["alias_resolution"](spark, str(tmp_path))
    want = con.execute(e.oracle_sql()["alias_resolution"]).fetchall()
    assert got.columns == ["l_orderkey", "l_linenumber", "canonical"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert {c for *_, c in want} == {1, 3, 4, 6, 7, 9}
