"""Registered queries of flattened documents, registry matching, evaluation records and ranked outputs, each beside its SQL twin."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenum.functions import text as tx
from plenum.operators import classes as cl
from plenum.operators import evaluation as ev
from plenum.operators import flatten as fl
from plenum.operators import matching as mt
from plenum.operators import rollcall as rc
from plenum.operators import topics as tp
from plenum.plans import landing as lg
from plenum.plans import prepared
from plenum.plans import queries as rq
from plenum.plans.model import MODEL, Model, from_orders, twin
from plenum.session import shared_dir
from plenum.sources import landed as ld
from plenum.sources import views as vw

QUERIES, SQL = {}, {}


def add(name: str, f, sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


def model(name: str, f, sql: str) -> None:
    """A query over the roll-call model: counts go out as long, days as text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(prepared.model(spark, sf_dir))
        return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes))

    add(name, run, twin(sql))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- documents to rows: orders with their lines, customers and suppliers as landed documents


def order_docs(s, d) -> DataFrame:
    line = F.struct(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_quantity").alias("quantity"))
    return read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(line).alias("lines"))


def json_leaves(s, d):
    docs = order_docs(s, d).select("id", F.to_json(F.struct("lines")).alias("doc"))
    return fl.leaves(docs, "doc", "lines/*/part").select("id", F.col("leaf").cast("long").alias("part"))


add("json_leaves", json_leaves, "SELECT l_orderkey AS id, CAST(l_partkey AS BIGINT) AS part FROM lineitem")
add(
    "nested_children",
    lambda s, d: ld.children(order_docs(s, d).select("id", fl.nested("lines", lambda x: x["quantity"] > 25, part=lambda x: x["part"], twice=lambda x: 2 * x["quantity"]).alias("many")), "id", "many"),
    "SELECT l_orderkey AS id, l_partkey AS part, 2 * l_quantity AS twice FROM lineitem WHERE l_quantity > 25",
)


def linked_documents(s, d):
    docs = read(s, d, "supplier").where("s_suppkey % 5 > 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"))
    orders = order_docs(s, d).select(F.col("id").alias("order_id"), F.transform("lines", lambda x: x["supplier"]).alias("ids"))
    found = fl.followed(orders, "order_id", "ids", docs, "suppliers")
    return found.select("order_id", F.coalesce(F.size("suppliers"), F.lit(0)).cast("long").alias("n"), F.concat_ws(",", F.transform("suppliers", lambda x: x["label"])).alias("labels"))


add(
    "linked_documents",
    linked_documents,
    """SELECT l_orderkey AS order_id, count(s_suppkey) AS n, coalesce(string_agg(s_name, ',' ORDER BY s_suppkey), '') AS labels
    FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) l LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_suppkey % 5 > 0 GROUP BY l_orderkey""",
)
add(
    "term_rows",
    lambda s, d: fl.term_rows(read(s, d, "customer").selectExpr("concat('http://x/org/ep-', c_custkey) AS uri", "IF(c_custkey % 3 = 0, array('Body', 'ParliamentaryTerm'), array('Body')) AS classes", "IF(c_custkey % 7 > 0, c_nationkey + 1950, NULL) AS d_from", "CAST(NULL AS INT) AS d_to")).select(F.col("term").cast("long").alias("term"), F.col("d_from").cast("long").alias("d_from"), F.col("d_to").cast("long").alias("d_to")),
    "SELECT c_custkey AS term, CAST(c_nationkey + 1950 AS BIGINT) AS d_from, CAST(NULL AS BIGINT) AS d_to FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 7 > 0",
)


def subject_rows(s, d):
    def docs(kind: int):
        return read(s, d, "supplier").where(f"s_suppkey % {kind} = 0").selectExpr("s_suppkey AS id", "s_name AS label", f"IF(s_suppkey % 3 = 0, concat('{kind} ', s_name), NULL) AS label_en", "IF(s_suppkey % 4 > 0, array(concat('http://x/country/', s_nationkey), 'y'), array()) AS represented")

    return fl.subject_rows(("NATIONAL", docs(2)), ("GROUP", docs(3)))


add(
    "subject_rows",
    subject_rows,
    """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'NATIONAL' ELSE 'GROUP' END AS typ, s_name AS label,
    CASE WHEN s_suppkey % 3 = 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN '2 ' ELSE '3 ' END || s_name ELSE s_name END AS name, CASE WHEN s_suppkey % 4 > 0 THEN CAST(s_nationkey AS VARCHAR) END AS country
    FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0""",
)


def membership_rows(s, d):
    spell = F.struct(F.col("l_suppkey").alias("org"), F.col("l_returnflag").alias("cls"), F.col("l_linenumber").alias("d_from"), F.lit(None).cast("long").alias("d_to"))
    docs = read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("member_id")).agg(F.collect_list(spell).alias("memberships"))
    aliases = read(s, d, "supplier").where("s_suppkey % 4 > 0").selectExpr("s_suppkey AS ep_id", "s_suppkey DIV 10 AS subject_id")
    rows = fl.membership_rows(docs, aliases, {"A": "group", "N": "national"})
    return rows.select("member_id", F.col("subject_id").cast("long").alias("subject_id"), "kind", F.col("d_from").cast("long").alias("d_from"))


add("membership_rows", membership_rows, "SELECT l_orderkey AS member_id, CAST(l_suppkey // 10 AS BIGINT) AS subject_id, CASE l_returnflag WHEN 'A' THEN 'group' ELSE 'national' END AS kind, CAST(l_linenumber AS BIGINT) AS d_from FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_suppkey % 4 > 0 AND l_returnflag IN ('A', 'N')")
add(
    "session_rows",
    lambda s, d: fl.session_rows(read(s, d, "orders").selectExpr("o_orderkey AS session_id", "concat('http://x/', IF(o_custkey % 2 = 0, 'PLENARY_SITTING', 'COMMITTEE')) AS type", "CAST(CAST(o_orderdate AS DATE) AS STRING) AS day")),
    "SELECT o_orderkey AS session_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders WHERE o_custkey % 2 = 0",
)


def attendance_docs(s, d):
    flag = lambda k: F.collect_list(F.when(F.col("l_returnflag") == k, F.col("l_suppkey")))
    docs = read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("session_id")).agg(flag("R").alias("excused"), flag("A").alias("present"))
    return fl.attendance_rows(docs, read(s, d, "supplier").where("s_suppkey % 3 > 0").selectExpr("s_suppkey AS ep_id", "s_suppkey + 1000 AS member_id"))


add("attendance_rows", lambda s, d: attendance_docs(s, d)[0].select("session_id", "member_id", F.col("status").cast("long").alias("status")), "SELECT l_orderkey AS session_id, s_suppkey + 1000 AS member_id, CAST(CASE l_returnflag WHEN 'R' THEN 4 ELSE 1 END AS BIGINT) AS status FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_suppkey % 3 > 0 AND l_returnflag IN ('A', 'R')")
add("attendance_unknown", lambda s, d: attendance_docs(s, d)[1], "SELECT l_orderkey AS session_id, count(*) AS unknown FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 > 0) GROUP BY l_orderkey")
VOTE_DOCS = [
    "o_orderkey AS vote_id",
    "CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS title",
    "CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS activity_title",
    "'http://x/outcome/' || o_orderstatus AS outcome",
    "CASE WHEN o_custkey % 5 = 0 THEN 'VOTE_SECRET_ELECTRONIC' WHEN o_custkey % 5 > 1 THEN 'VOTE_ROLL_CALL' END AS method",
    "CASE WHEN o_custkey % 4 > 0 THEN 700 END AS attendees",
    "o_custkey % 100 AS n_for",
    "o_orderkey % 100 AS n_against",
    "7 AS n_abstain",
]
add(
    "vote_fields",
    lambda s, d: fl.vote_fields(read(s, d, "orders").selectExpr(*VOTE_DOCS)).withColumn("not_voted", F.col("not_voted").cast("long")),
    f"""SELECT vote_id, coalesce(title, activity_title) AS title, split_part(outcome, '/', -1) AS outcome, coalesce(contains(lower(method), 'secret'), false) AS secret,
    CAST(attendees - n_for - n_against - n_abstain AS BIGINT) AS not_voted FROM (SELECT {', '.join(VOTE_DOCS)} FROM orders) v""",
)
add(
    "dimension_rows",
    lambda s, d: fl.by_dimensions(fl.walked(read(s, d, "customer").select(F.col("c_nationkey").cast("string").alias("geo\\TIME_PERIOD"), F.col("c_mktsegment").alias("unit"), F.col("c_acctbal").alias("1999")), fl.geo_named), {"unit": "BUILDING", "sex": "T"}, countries=[str(k) for k in range(20)]),
    "SELECT CAST(c_nationkey AS VARCHAR) AS geo, c_mktsegment AS unit, c_acctbal AS \"1999\" FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 20",
)
add(
    "acronym_links",
    lambda s, d: fl.acronym_links(read(s, d, "customer").selectExpr("c_custkey AS id", "concat(' G', c_nationkey, IF(c_custkey % 9 = 0, 'x', '')) AS acronym"), read(s, d, "supplier").selectExpr("s_suppkey AS no", "concat('g', s_nationkey, ' ') AS acronym", "IF(s_suppkey % 2 = 0, concat('http://w/Q', s_suppkey), NULL) AS item", "concat('##', s_suppkey) AS colour")),
    """SELECT c_custkey AS id, ' G' || c_nationkey || CASE WHEN c_custkey % 9 = 0 THEN 'x' ELSE '' END AS acronym, 'Q' || no AS wiki_id, CAST(no AS VARCHAR) AS colour
    FROM customer LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS no FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY s_nationkey) e ON c_custkey % 9 > 0 AND s_nationkey = c_nationkey""",
)
add(
    "alias_resolution",
    lambda s, d: read(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("id")).join(cl.deduplicated(read(s, d, "supplier").selectExpr("s_suppkey AS id", "CAST(NULL AS STRING) AS wiki_id", "coalesce('=' || left(s_name, 17), '') AS abbr", "s_nationkey AS country")).select("id", "canonical"), "id").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "canonical"),
    "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, canonical FROM lineitem JOIN (SELECT s_suppkey, min(s_suppkey) OVER (PARTITION BY left(s_name, 17), s_nationkey) AS canonical FROM supplier) c ON l_suppkey = s_suppkey",
)

# --- registry matching and evaluation records: a supplier is a party of a record (nation, year)
WORD = "'pty' || translate(CAST(s_suppkey AS VARCHAR), '0123456789', 'abcdefghij')"
YEAR = "CAST(2000 + s_suppkey // 40 AS BIGINT)"


def parties(s, d) -> tuple[DataFrame, DataFrame]:
    """Truth and extracted parties: of five the same name in other letters, the abbreviation, one word of it, none, another name or what all have in parentheses."""
    t = read(s, d, "supplier").selectExpr("CAST(s_nationkey AS LONG) AS country", "2000 + s_suppkey DIV 40 AS year", "s_suppkey AS pos", "'pty' || translate(CAST(s_suppkey AS STRING), '0123456789', 'abcdefghij') AS word", "s_suppkey AS k", "s_nationkey", "s_acctbal")
    truth = t.selectExpr("country", "year", "pos", "concat('\u00danion of ', word, '\u00e9 (the people)') AS name", "concat('X-', word) AS abbr", "k % 30 AS seats", "k % 2 = 0 AS in_government")
    said = "CASE k % 5 WHEN 0 THEN concat('Union OF ', word, 'e\u0301!') WHEN 1 THEN concat('x ', word) WHEN 2 THEN concat(word, 'E') ELSE IF(k % 2 = 0, 'People', concat('other ', k)) END"
    found = t.where("k % 5 <> 3").selectExpr("country", "year", "pos", f"{said} AS name", "k % 30 + IF(k % 7 = 0, 1, 0) AS seats", "IF(k % 3 = 0, NULL, k % 4 = 0) AS in_government")
    return ev.named(truth, "name", "abbr"), ev.named(found)


def scored(s, d) -> DataFrame:
    truth, found = parties(s, d)
    return ev.record_scores(truth, found, ev.paired(truth, found))


HIT = "s_suppkey % 5 < 3"
GOV_OK = "s_suppkey % 3 > 0 AND (s_suppkey % 2 = 0) = (s_suppkey % 4 = 0)"
STRICT = f"{HIT} AND s_suppkey % 7 > 0 AND NOT (s_suppkey % 3 > 0 AND (s_suppkey % 2 = 0) <> (s_suppkey % 4 = 0))"
RECORDS = f"""SELECT country, year, tp, strict, n_found - tp AS fp, n_truth - tp AS fn, p1 AS existence_precision, r1 AS existence_recall, {{f1}} AS existence_f1, p2 AS strict_precision, r2 AS strict_recall, {{f2}} AS strict_f1,
    seats / CAST(nullif(tp, 0) AS DOUBLE) AS seat_accuracy, gov / CAST(nullif(known, 0) AS DOUBLE) AS government_accuracy
    FROM (SELECT *, tp / CAST(nullif(n_found, 0) AS DOUBLE) AS p1, tp / CAST(n_truth AS DOUBLE) AS r1, strict / CAST(nullif(n_found, 0) AS DOUBLE) AS p2, strict / CAST(n_truth AS DOUBLE) AS r2
    FROM (SELECT CAST(s_nationkey AS BIGINT) AS country, {YEAR} AS year, count(*) AS n_truth, count(*) FILTER (WHERE s_suppkey % 5 <> 3) AS n_found, count(*) FILTER (WHERE {HIT}) AS tp, count(*) FILTER (WHERE {STRICT}) AS strict,
    count(*) FILTER (WHERE {HIT} AND s_suppkey % 7 > 0) AS seats, count(*) FILTER (WHERE {HIT} AND s_suppkey % 3 > 0) AS known, count(*) FILTER (WHERE {HIT} AND {GOV_OK}) AS gov FROM supplier GROUP BY ALL) a) b"""
for k in "12":
    RECORDS = RECORDS.replace(f"{{f{k}}}", f"CASE WHEN p{k} IS NULL OR r{k} IS NULL THEN NULL WHEN p{k} + r{k} = 0 THEN 0 ELSE 2 * p{k} * r{k} / (p{k} + r{k}) END")
DIGITS = [*ev.RATIOS, "existence_precision", "existence_recall", "strict_precision", "strict_recall"]
ROUNDED = ", ".join(f"round({c}, 4) AS {c}" for c in DIGITS)
MACRO = "sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(strict)::BIGINT AS strict, " + ", ".join(f"round(avg({c}), 4) AS {c}" for c in ev.RATIOS)
add("party_pairing", lambda s, d: ev.paired(*parties(s, d)), f"SELECT CAST(s_nationkey AS BIGINT) AS country, {YEAR} AS year, s_suppkey AS t, s_suppkey AS x FROM supplier WHERE {HIT}")
add("record_scores", lambda s, d: scored(s, d).select("country", "year", "tp", "fp", "fn", "strict", *(F.round(c, 4).alias(c) for c in DIGITS)), f"SELECT country, year, tp, fp, fn, strict, {ROUNDED} FROM ({RECORDS}) r")
add("record_means", lambda s, d: ev.macro(scored(s, d)), f"SELECT {MACRO} FROM ({RECORDS}) r")
add("record_means_by_country", lambda s, d: ev.macro(scored(s, d), "country"), f"SELECT country, {MACRO} FROM ({RECORDS}) r GROUP BY country")
add("record_f1_micro", lambda s, d: mt.scores(scored(s, d)).select("tp", "fp", "fn", "strict", "f1_tp", "f1_strict"), f"SELECT tp, fp, fn, strict, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 4) AS f1_tp, round(2.0::DOUBLE * strict / (2 * tp + fp + fn), 4) AS f1_strict FROM (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(strict)::BIGINT AS strict FROM ({RECORDS}) r) a")

def by_mode(s, d) -> DataFrame:
    modes = F.explode(F.array(F.lit("html"), F.lit("text"))).alias("mode")
    rows = scored(s, d).select(modes, "country", "year", "tp", "fp", "fn").where("mode = 'html' OR (country + year) % 4 > 0")
    return rows.withColumn("fp", F.col("fp") + F.when(F.col("mode") == "text", 1).otherwise(0))


add("intervals_by_mode", lambda s, d: lg.rounded(ev.intervals(by_mode(s, d), lg.BOOTS)), f"""WITH a AS ({RECORDS}), r AS (SELECT * FROM a WHERE (country + year) % 4 > 0), {lg.draws_sql('country, year')},
    m AS (SELECT mode, country, year, tp, fp + CASE WHEN mode = 'text' THEN 1 ELSE 0 END AS fp, fn FROM r, (VALUES ('html'), ('text')) v(mode)), f AS (SELECT mode, {lg.f1_sql('tp')} AS v FROM b JOIN m USING (country, year) GROUP BY mode, boot)
    SELECT mode, point, low, high FROM (SELECT mode, {lg.interval_sql('v')} FROM f GROUP BY mode) i JOIN (SELECT mode, round({lg.f1_sql('tp')}, 9) AS point FROM m GROUP BY mode) o USING (mode)""")


def evaluation_log(s, d):
    t = read(s, d, "supplier").selectExpr("CAST(s_nationkey AS LONG) AS country", "2000 + s_suppkey DIV 40 AS year")
    return ev.with_logs(t.distinct(), t.where("country % 3 > 0").groupBy("country", "year").agg(F.count("*").alias("attempts")))


add("evaluation_log", evaluation_log, f"SELECT CAST(s_nationkey AS BIGINT) AS country, {YEAR} AS year, CASE WHEN s_nationkey % 3 > 0 THEN count(*) END AS attempts FROM supplier GROUP BY s_nationkey, {YEAR}")
add(
    "source_rates",
    lambda s, d: ev.source_rates(read(s, d, "customer").selectExpr("c_mktsegment", "IF(c_custkey % 5 > 0, concat('https://a.org/wiki/', c_name, IF(c_custkey % 3 = 0, '_2', '/')), NULL) AS found_url", "concat('http://b.org/wiki/', c_name) AS truth_url"), "c_mktsegment"),
    "SELECT c_mktsegment, count(*) AS n, round(avg(CASE WHEN c_custkey % 5 > 0 THEN 1.0::DOUBLE ELSE 0 END), 4) AS found_rate, round(avg(CASE WHEN c_custkey % 5 > 0 THEN CASE WHEN c_custkey % 3 > 0 THEN 1.0::DOUBLE ELSE 0 END END), 4) AS same_rate FROM customer GROUP BY c_mktsegment",
)
add(
    "first_attempts",
    lambda s, d: ev.first_attempts(read(s, d, "supplier").selectExpr("s_suppkey AS key", "concat('u', s_nationkey, s_suppkey % 2) AS url", "concat('(of) N\u00c1ME-', s_suppkey % 97) AS name"), read(s, d, "customer").where("c_custkey % 3 = 0").selectExpr("c_custkey AS no", "concat('u', c_nationkey, c_custkey % 3) AS url", "concat('na\u0301me ', c_custkey % 450, '!') AS name")),
    """SELECT s_suppkey AS key, min(c_custkey) AS no FROM supplier LEFT JOIN customer ON c_custkey % 3 = 0
    AND ('u' || s_nationkey || s_suppkey % 2 = 'u' || c_nationkey || c_custkey % 3 OR s_suppkey % 97 = c_custkey % 450) GROUP BY s_suppkey""",
)


PARTY = """CASE {k} % 8 WHEN 0 THEN 'B\u00f6dy ' || {k} WHEN 1 THEN 'W' || {k} WHEN 2 THEN 'Shared' WHEN 3 THEN 'None (of it)' WHEN 4 THEN 'Gr\u00fcn g' || {k} || ' left' WHEN 5 THEN 'Some (\u00c5' || {k} || ') \u00dfthing' WHEN 6 THEN 'Q' ELSE 'tie t' || {k} END"""
BODY = {"name": "'body ' || {k} || ' (\u00e5' || {k} || ')'", "abbr": "CASE {k} % 8 WHEN 1 THEN 'the w' || {k} WHEN 4 THEN 'G' || {k} WHEN 6 THEN 'q x' WHEN 7 THEN 'T' || {k} ELSE CASE WHEN {k} % 16 < 6 THEN 'sh\u00e1red' ELSE 'late ' || {k} END END", "more": "CASE WHEN {k} % 3 = 0 THEN 'late ' || {k} WHEN {k} % 8 = 7 THEN 'tie' END"}


def registry(s, d):
    """Parties by country with their aliases; bodies of the registry with theirs: accents, parentheses, words either way, ties."""
    k = {"k": "s_suppkey"}
    p = read(s, d, "supplier").selectExpr("s_suppkey AS key", "s_nationkey AS country", f"{PARTY.format(**k)} AS name", "IF(s_suppkey % 8 = 3, 'x\u00e9', NULL) AS abbr")
    g = read(s, d, "supplier").selectExpr("s_nationkey AS country", "'B' || s_suppkey AS label", *(f"{v.format(**k)} AS {c}" for c, v in BODY.items()))
    p = p.select("key", "country", tx.aliases(F.col("name"), F.col("abbr"), form="folded").alias("aliases"))
    return p, g.select("country", "label", tx.aliases(F.col("name"), F.col("abbr"), F.col("more"), form="folded").alias("aliases"))


def forms_sql(name: str, *more: str) -> str:
    """In DuckDB: the distinct normal forms of a name, of it without parentheses, of what is in them, and of `more`."""
    plain = lambda x: f"trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', ' ', 'g'))"
    outer = ", ".join(plain(x) for x in (name, f"regexp_replace({name}, '\\([^)]*\\)', ' ', 'g')", *more))
    return f"list_distinct([x FOR x IN list_concat([{outer}], [{plain('y')} FOR y IN regexp_extract_all({name}, '\\(([^)]*)\\)', 1)]) IF x <> ''])"


def match_sql(extra: str = "NULL") -> str:
    """Every party of a country against every body; extra: one more name of the party."""
    one = lambda a, b: f"len([x FOR x IN {a} IF NOT contains(x, ' ') AND len(x) >= 2 AND list_contains(string_split(array_to_string({b}, ' '), ' '), x)]) > 0"
    k = {"k": "s_suppkey"}
    return f"""SELECT key, CASE WHEN e = 1 THEN e1 WHEN e = 0 AND t = 1 THEN t1 END AS label, CASE WHEN e = 1 THEN 'exact_alias' WHEN e > 1 THEN 'ambiguous' WHEN t = 1 THEN 'token_containment' WHEN t > 1 THEN 'ambiguous' ELSE 'no_match' END AS method
    FROM (SELECT key, count(*) FILTER (WHERE exact) AS e, min(label) FILTER (WHERE exact) AS e1, count(*) FILTER (WHERE part) AS t, min(label) FILTER (WHERE part) AS t1
    FROM (SELECT key, label, coalesce(list_has_any(a, b), false) AS exact, coalesce({one('a', 'b')} OR {one('b', 'a')}, false) AS part
    FROM (SELECT s_suppkey AS key, s_nationkey AS country, {forms_sql('name', "CASE WHEN s_suppkey % 8 = 3 THEN 'x\u00e9' END", extra)} AS a FROM (SELECT *, {PARTY.format(**k)} AS name FROM supplier) n) p
    LEFT JOIN (SELECT 'B' || s_suppkey AS label, s_nationkey AS country, {forms_sql('name', 'abbr', 'more')} AS b FROM (SELECT *, {', '.join(f'{v.format(**k)} AS {c}' for c, v in BODY.items())} FROM supplier) n) g USING (country)) x GROUP BY key) y"""


MATCH = match_sql()
SECOND = f"""SELECT m.key, CASE WHEN m.label IS NULL AND w.label IS NOT NULL THEN w.label ELSE m.label END AS label, CASE WHEN m.label IS NULL AND w.label IS NOT NULL THEN w.method || '+aliases' ELSE m.method END AS method
    FROM ({MATCH}) m LEFT JOIN (SELECT * FROM ({match_sql("'late ' || s_suppkey")}) x WHERE key % 3 = 0) w USING (key)"""


def second_pass(s, d):
    p, g = registry(s, d)
    return mt.second_pass(mt.registry_match(p, g), p, g, p.where("key % 3 = 0").selectExpr("key", "array('late ' || key) AS aliases"))


add("registry_match", lambda s, d: mt.registry_match(*registry(s, d)), MATCH)
add("registry_second_pass", second_pass, SECOND)
add("registry_overrides", lambda s, d: mt.with_overrides(mt.registry_match(*registry(s, d)), read(s, d, "supplier").where("s_suppkey % 10 = 0").selectExpr("s_suppkey AS key", "'reviewed' AS label", "'manual' AS method")), f"SELECT key, CASE WHEN key % 10 = 0 THEN 'reviewed' ELSE label END AS label, CASE WHEN key % 10 = 0 THEN 'manual' ELSE method END AS method FROM ({MATCH}) m")
add("registry_outcomes", lambda s, d: mt.outcomes(second_pass(s, d)), f"SELECT method, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM supplier) AS DOUBLE), 4) AS share FROM ({SECOND}) m GROUP BY method")

# --- the prepared votes of groups: what a change of the input remakes, and how many rows each step has
CHANGED = "vote_id % 40 = 25"  # votes of one session of the second term


def prepared_twice(s, d) -> tuple[DataFrame, prepared.Prepared]:
    """Prepared anew in a folder of its own, then brought up to date after votes of one term were taken back."""
    m = from_orders(s, d)
    own = prepared.Prepared(s, f"{shared_dir(s)}/prepared-{uuid.uuid4().hex}")
    own.refresh(m)
    m.member_votes = m.member_votes.withColumn("option", F.when(F.expr(CHANGED) & (F.col("member_id") % 2 == 0), 3).otherwise(F.col("option")))
    return own.refresh(m), own


def prepared_changes(s, d) -> DataFrame:
    remade, own = prepared_twice(s, d)
    rows = own.votes().groupBy("term").agg(F.count("*").alias("n"), F.sum("plurality").alias("pluralities"), F.sum("option").alias("options"))
    return rows.join(remade, "term").select(F.col("term").cast("long").alias("term"), "remade", "n", "pluralities", "options")


def stage_counts(s, d) -> DataFrame:
    _, own = prepared_twice(s, d)
    return s.createDataFrame(sorted(own.counts.items()), "step string, n long")


NEW_VOTES = MODEL["member_votes"].replace("{", "").replace("}", "")
NEW = f"""member_votes AS (SELECT vote_id, member_id, CASE WHEN {CHANGED} AND member_id % 2 = 0 THEN 3 ELSE option END AS option FROM ({NEW_VOTES}) o)"""
add("prepared_changes", prepared_changes, twin("""SELECT CAST(term AS BIGINT) AS term, term = 10 AS remade, count(*) AS n, CAST(sum(plurality) AS BIGINT) AS pluralities, CAST(sum(option) AS BIGINT) AS options
    FROM group_votes LEFT JOIN plurality USING (vote_id, subject_id) GROUP BY term""").replace(f"member_votes AS ({NEW_VOTES})", NEW))  # fmt: skip
add("stage_counts", stage_counts, twin("""SELECT 'read' AS step, (SELECT count(*) FROM member_votes) AS n UNION ALL SELECT 'cast', (SELECT count(*) FROM cast_votes WHERE term = 10)
    UNION ALL SELECT 'with_group', (SELECT count(*) FROM group_votes WHERE term = 10) UNION ALL SELECT 'written', (SELECT count(*) FROM group_votes WHERE term = 10)"""))

# --- ids of entities in the scripts of pages: broken, in a second script, of another host, empty, no text
SCRIPTS = ['{"mainEntity": "http://www.wikidata.org/entity/Q%"}', '{broken', '{"sameAs": "https://www.wikidata.org/wiki/Q%"}', '{"mainEntity": "https://example.org/Q%", "sameAs": "http://wikidata.org/Q1"}', '{"mainEntity": "", "sameAs": "http://wikidata.org/Q%x"}', '["wikidata.org/Q5"]', '{"mainEntity": {"@id": "wikidata.org/Q6"}, "sameAs": "wikidata.org/Q%"}', '{"mainEntity": null, "sameAs": "wikidata.org/none"}']


def page_scripts(s, d) -> DataFrame:
    """pages with a script by the page's number, and another by its number / 8, before its own text."""
    tag = lambda no: F.concat(F.lit('<SCRIPT id=x type="application/ld+json">\n'), F.replace(F.element_at(F.array(*map(F.lit, SCRIPTS)), (no + 1).cast("int")), F.lit("%"), F.col("page_id").cast("string")), F.lit("</script>"))
    first, second = (F.floor(F.col("page_id") / n) % 8 for n in (1, 8))
    return read(s, d, "pages").select("page_id", F.concat(F.lit('<script type="text/javascript">{"sameAs": "wikidata.org/Q7"}</script>'), tag(first), tag(second), F.coalesce("html", F.lit(""))).alias("html"))


SCRIPT = "replace([" + ", ".join(f"'{x}'" for x in SCRIPTS) + "][CAST(page_id // @ % 8 AS INT) + 1], '%', CAST(page_id AS VARCHAR))"
MAIN = "json_extract(j, '$.mainEntity')"
add(
    "page_entity_ids",
    lambda s, d: page_scripts(s, d).select("page_id", tx.entity_id(F.col("html")).alias("entity")),
    f"""WITH s AS (SELECT page_id, no, CASE WHEN json_valid(j) THEN CAST(j AS JSON) END AS j FROM (SELECT page_id, 1 AS no, {SCRIPT.replace('@', '1')} AS j FROM pages UNION ALL SELECT page_id, 2, {SCRIPT.replace('@', '8')} FROM pages) x),
    u AS (SELECT page_id, no, CASE WHEN {MAIN} IS NULL OR json_type({MAIN}) = 'NULL' OR CAST({MAIN} AS VARCHAR) IN ('""', '0', 'false', '[]', '{{}}') THEN json_extract(j, '$.sameAs') ELSE {MAIN} END AS v FROM s),
    i AS (SELECT page_id, no, nullif(regexp_extract(v ->> '$', 'Q[0-9]+'), '') AS id FROM u WHERE json_type(v) = 'VARCHAR' AND contains(v ->> '$', 'wikidata.org'))
    SELECT page_id, arg_min(id, no) AS entity FROM pages LEFT JOIN (SELECT * FROM i WHERE id IS NOT NULL) i USING (page_id) GROUP BY page_id""",
)

# --- analyses with an order, a filter or a top list
PLACE = "row_number() OVER (PARTITION BY {} ORDER BY {})"


def placed(df: DataFrame, by: list, *order) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).orderBy(*by, "place")


model("loyalty_ranked", lambda m: placed(rc.loyalty(rc.group_votes(m)), ["term"], F.desc("loyalty"), "member_id", "subject_id"), f"SELECT *, {PLACE.format('term', 'loyalty DESC, member_id, subject_id')} AS place FROM ({rq.LOYAL}) l")
model("government_loyalty_ranked", lambda m: placed(rc.government_loyalty(m), ["term"], "subject_id", F.desc("in_government"), F.desc("loyalty"), "member_id"), f"SELECT *, {PLACE.format('term', 'subject_id, in_government DESC, loyalty DESC, member_id')} AS place FROM ({rq.GOV}) l")
model("government_loyalty_in_office", lambda m: rc.government_loyalty(m).where("in_government"), f"SELECT * FROM ({rq.GOV}) l WHERE in_government")
model("members_ordered", lambda m: placed(m.members, ["country"], F.substring_index("name", "#", 1), "name").select("member_id", "name", "country", "place"), f"SELECT member_id, name, country, {PLACE.format('country', chr(39).join(('split_part(name, ', '#', ', 1), name')))} AS place FROM members")
model(
    "party_topics_ordered",
    lambda m: placed(tp.party_topics(m).join(m.memberships.where("kind <> 'group'").join(m.members, "member_id").groupBy(F.col("subject_id").alias("party")).agg(F.min("country").alias("country")), "party", "left"), ["term"], F.coalesce("country", F.lit("")), "party", F.array_position(F.array(*map(F.lit, rq.tp.TOPIC_ORDER)), F.col("topic"))).select("term", "party", "country", "topic", "n", "place"),
    f"""SELECT CAST(term AS BIGINT) AS term, party, country, topic, n, {PLACE.format('term', "coalesce(country, ''), party, list_position(" + str(list(tp.TOPIC_ORDER)) + ", topic)")} AS place
    FROM party_topic LEFT JOIN (SELECT subject_id AS party, min(country) AS country FROM memberships JOIN members USING (member_id) WHERE kind <> 'group' GROUP BY subject_id) c USING (party)""",
)
for name, f, value, key, base in (
    ("party_cohesion_ranked", rc.party_cohesion, "ai", "subject_id", rq.PARTY), ("country_cohesion_ranked", rc.country_cohesion, "ai", "country", rq.COUNTRY),
    ("agreement_ranked", rc.group_agreement, "agreement", "subject1, subject2", rq.AGREE),
):
    model(name, lambda m, f=f, v=value, k=key: placed(f(m), ["term"], F.desc(v), *k.split(", ")), f"SELECT *, {PLACE.format('term', f'{value} DESC, {key}')} AS place FROM ({base}) b")
model("participation_ranked", lambda m: placed(rc.participation(m).withColumn("all", F.lit(1)), ["all"], F.desc("ratio"), "member_id").drop("all"), f"SELECT *, row_number() OVER (ORDER BY ratio DESC, member_id) AS place FROM ({rq.PARTICIPATION}) p")
model("country_cohesion_average", lambda m: rc.country_cohesion(m).groupBy("term").agg(F.round(F.avg("ai"), 3).alias("average")), f"SELECT term, round(avg(ai), 3) AS average FROM ({rq.COUNTRY}) c GROUP BY term")
PARTY_COUNTRY = "(SELECT subject_id AS party, min(country) AS country FROM memberships JOIN members USING (member_id) WHERE kind <> 'group' GROUP BY subject_id)"
model("profile_countries", lambda m: tp.party_topics(m).join(tp.party_countries(m), "party").select("term", "country").where("country <> ''").distinct().orderBy("term", "country"), f"SELECT DISTINCT CAST(term AS BIGINT) AS term, country FROM party_topic JOIN {PARTY_COUNTRY} c USING (party)")
COLOUR = lambda key: f"'#' || {tx.COLOURS}[{lg.CRC.replace('s_name', f'CAST({key} AS VARCHAR)')} % {len(tx.COLOURS)} + 1]"
model(
    "party_profile",
    lambda m: tp.party_profile(m).withColumn("topics", F.array_join(F.transform(F.map_entries("topics"), lambda e: F.concat_ws(":", e["key"], F.round(e["value"]["share"] * 10000).cast("long").cast("string"), e["value"]["n"].cast("string"))), ",")).select("term", "party", "country", "grp", "colour", "topics"),
    f"""SELECT CAST(term AS BIGINT) AS term, party, any_value(country) AS country, any_value(grp) AS grp, {COLOUR('party')} AS colour, string_agg(topic || ':' || CAST(round(round(share, 4) * 10000) AS BIGINT) || ':' || n, ',' ORDER BY topic) AS topics
    FROM party_topic LEFT JOIN party_group USING (term, party) LEFT JOIN {PARTY_COUNTRY} c USING (party), {lg.BITS} b GROUP BY term, party, t""",
)


def pair_views(s, d) -> DataFrame:
    """Pairs of members by topic written as views and their manifest read back: every topic, also one without pairs."""
    m = prepared.model(s, d)
    root = f"{shared_dir(s)}/views-{uuid.uuid4().hex}"
    topics = s.createDataFrame([(t,) for t in tp.TOPIC_ORDER], "topic string")
    vw.write_views(rc.member_pairs(rc.cast_votes(m).where("topic IS NOT NULL AND topic <> 'AGRI'"), "topic"), root, "topic", every=topics)
    return vw.read_manifest(s, root).select("topic", "rows", (F.col("folder") == F.concat(F.lit("_topic="), "topic")).alias("placed"))


add("pair_view_index", pair_views, twin(f"""SELECT topic, coalesce(n, 0) AS rows, CASE WHEN n > 0 THEN true END AS placed FROM (SELECT unnest({list(tp.TOPIC_ORDER)}) AS topic) t
    LEFT JOIN (SELECT topic, count(*) AS n FROM ({rq.PAIRS.format(v='topic,', p='topic', a='a.topic,', w="AND a.topic IS NOT NULL AND a.topic <> 'AGRI'")}) p GROUP BY topic) q USING (topic)"""))  # fmt: skip


def coded_countries(m: Model) -> Model:
    """Members' countries in three letters, those of the indicators in two, where they have a code."""
    three, two = (F.create_map(*map(F.lit, [x for pair in CODES for x in (pair[0], pair[k])])) for k in (1, 2))
    m.members = m.members.withColumn("country", F.coalesce(F.element_at(three, F.col("country")), "country"))
    m.indicators = m.indicators.withColumn("country", F.coalesce(F.element_at(two, F.col("country")), "country"))
    return m


CODES = [("FRANCE", "FRA", "FR"), ("GERMANY", "DEU", "DE"), ("ROMANIA", "ROU", "RO"), ("CHINA", "GRC", "EL")]
model(
    "indicator_points_by_code",
    lambda m: tp.points(coded_countries(m)).select("term", "topic", "country", "code", F.round("x", 2).alias("x"), F.round("y", 4).alias("y")),
    f"""SELECT CAST(term AS BIGINT) AS term, topic, CASE country {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b, _ in CODES)} ELSE country END AS country, CASE country {' '.join(f"WHEN '{a}' THEN '{c}'" for a, _, c in CODES)} ELSE country END AS code,
    round(value, 2) AS x, round(share, 4) AS y FROM country_topic JOIN ({rq.IND}) i USING (term, country)""",
)
model("member_search", lambda m: m.members.where(F.contains(F.lower("name"), F.lower(F.lit("#00000000")))).select("member_id", "name"), "SELECT member_id, name FROM members WHERE contains(lower(name), lower('#00000000'))")
model("members_with_votes", lambda m: rc.cast_votes(m).select("term", "member_id").distinct(), "SELECT DISTINCT CAST(term AS BIGINT) AS term, member_id FROM cast_votes")
model("unusual_by_topic", lambda m: rc.anomalies(m).where("anomalous").groupBy("member_id", F.coalesce("topic", F.lit("OTHER")).alias("topic")).agg(F.count("*").alias("n")), f"SELECT member_id, coalesce(topic, 'OTHER') AS topic, count(*) AS n FROM ({rq.ODD}) o WHERE anomalous GROUP BY ALL")
model("profile_groups", lambda m: tp.party_topics(m).join(tp.party_main_group(m), ["term", "party"]).select("term", "grp").distinct(), "SELECT DISTINCT CAST(term AS BIGINT) AS term, grp FROM party_topic JOIN party_group USING (term, party)")
model("terms_with_results", lambda m: fl.terms_with_results(m.terms, rc.cast_votes(m)).select("term", "d_from", "ordinal"), "SELECT CAST(term AS BIGINT) AS term, CAST(d_from AS VARCHAR) AS d_from, row_number() OVER (ORDER BY d_from, term) - 1 AS ordinal FROM terms WHERE term IN (SELECT term FROM cast_votes)")


def new_attendance(m: Model) -> DataFrame:
    recorded = m.sessions.where("session_id % 2 = 0").select("session_id")
    return rc.attendance(m, recorded)


model("attendance_of_new_sessions", new_attendance, "SELECT session_id, member_id, status FROM attendance WHERE session_id % 2 <> 0")


def card_subjects(m: Model) -> DataFrame:
    n = [rc.with_subject(rc.cast_votes(m), rc.affiliation(m, kind)).groupBy("term", "member_id", "subject_id").agg(F.count("*").alias("n")).withColumn("is_group", F.lit(kind == "group")) for kind in ("group", "national")]
    first = F.row_number().over(Window.partitionBy("term", "member_id").orderBy(F.desc("is_group"), F.desc("n"), "subject_id"))
    return n[0].unionByName(n[1]).withColumn("r", first).where("r = 1").drop("r")


CARD = " UNION ALL ".join(f"SELECT term, member_id, subject_id, count(*) AS n, {str(t == 'group_at').lower()} AS is_group FROM cast_votes JOIN {t} USING (session_id, member_id) GROUP BY ALL" for t in ("group_at", "national_at"))
model("card_subjects", card_subjects, f"SELECT CAST(term AS BIGINT) AS term, member_id, subject_id, n, is_group FROM (SELECT *, row_number() OVER (PARTITION BY term, member_id ORDER BY is_group DESC, n DESC, subject_id) AS r FROM ({CARD}) c) x WHERE r = 1")
POINTS = f"SELECT c.term, c.topic, i.name, c.country, i.value AS x, c.share AS y FROM country_topic c JOIN ({rq.IND}) i USING (term, country)"
model("correlation_points", lambda m: tp.points(m).select("term", "topic", "name", "country", F.round("x", 2).alias("x"), F.round("y", 4).alias("y")), f"SELECT CAST(term AS BIGINT) AS term, topic, name, country, round(x, 2) AS x, round(y, 4) AS y FROM ({POINTS}) p")
model(
    "regression_lines",
    lambda m: tp.lines(m).select("term", "topic", "name", *(F.round(c, 3).alias(c) for c in ("x1", "y1", "x2", "y2"))),
    f"""SELECT CAST(term AS BIGINT) AS term, topic, name, round(x1, 3) AS x1, round(b + k * x1, 3) AS y1, round(x2, 3) AS x2, round(b + k * x2, 3) AS y2
    FROM (SELECT term, topic, name, regr_slope(y, x) AS k, regr_intercept(y, x) AS b, min(x) - 0.02 AS x1, max(x) + 0.02 AS x2 FROM ({POINTS}) p GROUP BY ALL HAVING count(*) >= 2) l WHERE k IS NOT NULL""",
)
RULES = rq.rules_sql(rq.DEV, 0.2, 1)


def deviation_rules(m: Model) -> tuple[DataFrame, DataFrame]:
    items = tp.saved(tp.deviation_items(m), "deviations")
    return tp.rules(tp.frequent_itemsets(items, 0.2)), items


model("top_rules", lambda m: tp.top_rules(deviation_rules(m)[0]), f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY lift DESC, antecedents, consequents) AS place FROM rules_) r WHERE place <= 30".replace("rules_", f"({RULES}) q"))
model("rule_parties", lambda m: tp.rule_keys(*deviation_rules(m)), f"""SELECT r.scope, antecedents, consequents, i.key FROM (SELECT *, string_split(antecedents || ',' || consequents, ',') AS wanted FROM ({RULES}) q) r
    JOIN ({rq.DEV}) i ON i.scope = r.scope AND list_contains(wanted, i.item) GROUP BY ALL HAVING count(DISTINCT item) = len(any_value(wanted))""")
SHARE = "CASE WHEN share > 0.65 THEN 'YES' WHEN share < 0.35 THEN 'NO' ELSE 'ABSTAIN' END"
model("item_parties", lambda m: tp.item_keys(tp.party_topics(m), ["ENER:ABSTAIN", "TECH:ABSTAIN"]), f"SELECT CAST(term AS BIGINT) AS term, party FROM party_topic GROUP BY ALL HAVING bool_or(topic = 'ENER' AND {SHARE} = 'ABSTAIN') AND bool_or(topic = 'TECH' AND {SHARE} = 'ABSTAIN')")


def filled_by(s, d):
    series = from_orders(s, d).indicators.drop("name").select(F.explode(F.array(*map(F.lit, ("a", "b", "c")))).alias("name"), "*")
    found = tp.filled_by(series, {"a": "linear", "b": "loglinear", "c": "mean"}, 1996)
    return found.select("name", "country", F.col("year").cast("long").alias("year"), F.round("value", 1).alias("value"), "predicted")


add("indicator_fill_dispatch", filled_by, " UNION ALL ".join(f"SELECT '{k}' AS name, country, year, value, predicted FROM ({rq.SQL[f'indicator_fill_{how}']}) f{k} WHERE year >= 1996" for k, how in (("a", "linear"), ("b", "loglinear"), ("c", "mean"))))
add("web_colours", lambda s, d: read(s, d, "supplier").select("s_suppkey", tx.web_colour(F.when(F.col("s_suppkey") % 3 == 0, F.lit("ED7D31"))).alias("colour")), "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '#ED7D31' ELSE '#9E9E9E' END AS colour FROM supplier")
add("item_parts", lambda s, d: read(s, d, "customer").select("c_custkey", *(x.alias(n) for x, n in zip(tx.item_parts(F.concat("c_mktsegment", F.lit(":x:"), F.col("c_nationkey").cast("string"))), ("topic", "direction")))), "SELECT c_custkey, c_mktsegment || ':x' AS topic, CAST(c_nationkey AS VARCHAR) AS direction FROM customer")
