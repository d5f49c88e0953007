"""Registered queries of the jobs around the analyses: landed rows, names, matching, scores, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.functions import text as tx
from plenum.operators import classes as cl
from plenum.operators import matching as mt
from plenum.operators import pages as pg
from plenum.operators import resample as rs
from plenum.plans.model import TOPICS
from plenum.sources import landed as ld

QUERIES, SQL = {}, {}


def add(name: str, f, sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dump(spark, d):
    """Orders in the layout of a votes dump."""
    return read(spark, d, "orders").selectExpr("o_orderkey AS id", "CAST(date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS STRING) AS timestamp", "o_orderpriority AS display_title", "CAST(NULL AS STRING) AS procedure_title",
        "o_custkey % 5 AS count_for", "o_custkey % 3 AS count_against", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 0L END AS count_abstention", "CAST(NULL AS LONG) AS count_did_not_vote", "CASE WHEN o_orderkey % 3 > 0 THEN 'R' END AS procedure_reference", "CASE WHEN o_orderkey % 2 = 0 THEN ' True' END AS is_main", "CASE WHEN o_orderkey % 5 > 0 THEN 'COD' END AS procedure_type")


COUNTS = "o_custkey % 5 AS n_for, o_custkey % 3 AS n_against"
add("csv_vote_rows", lambda s, d: ld.vote_rows(dump(s, d)).drop("subject_text").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), f"SELECT vote_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CASE WHEN n_for = 0 AND n_against = 0 THEN 'LAPSED' WHEN n_for > n_against THEN 'ADOPTED' ELSE 'REJECTED' END AS outcome, n_for, n_against, CAST(0 AS BIGINT) AS n_abstain, CAST(0 AS BIGINT) AS n_absent, final, procedural, procedure_type FROM (SELECT o_orderkey AS vote_id, o_orderdate AS ts, {COUNTS}, o_orderkey % 2 = 0 AS final, o_orderkey % 3 = 0 AS procedural, CASE WHEN o_orderkey % 5 > 0 THEN 'COD' END AS procedure_type FROM orders) o")
add("csv_vote_topics", lambda s, d: ld.with_topics(ld.vote_rows(dump(s, d)), read(s, d, "orders").select(F.col("o_orderkey").alias("vote_id"), F.when(F.col("o_orderkey") % 7 == 0, "ECON").otherwise("NONE").alias("label")), TOPICS).where("topic IS NOT NULL").select("vote_id", "topic"), "SELECT o_orderkey AS vote_id, 'ECON' AS topic FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 2 = 0 AND o_orderkey % 5 > 0")
add("csv_member_vote_rows", lambda s, d: ld.member_vote_rows(read(s, d, "lineitem").selectExpr("l_orderkey AS vote_id", "l_suppkey AS member_id", "CASE l_returnflag WHEN 'A' THEN 'FOR' WHEN 'N' THEN 'AGAINST' ELSE 'DID_NOT_VOTE' END AS position"), read(s, d, "supplier").where("s_suppkey % 2 = 0").selectExpr("s_suppkey AS ep_id", "s_suppkey + 1000000 AS member_id")).withColumn("option", F.col("option").cast("long")), "SELECT l_orderkey AS vote_id, l_suppkey + 1000000 AS member_id, CASE l_returnflag WHEN 'A' THEN CAST(1 AS BIGINT) ELSE 2 END AS option FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag IN ('A', 'N') AND s_suppkey % 2 = 0")
add("json_fields", lambda s, d: ld.fields(read(s, d, "events"), {"k": F.get_json_object("props", "$.k").try_cast("long")}, {"event_id": F.col("event_id")})[0], "SELECT try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id FROM events WHERE try_cast(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL")
add("reject_rows", lambda s, d: ld.fields(read(s, d, "events"), {"k": F.when(F.get_json_object("props", "$.k").try_cast("long") % 3 > 0, F.lit(1))}, {"event_id": F.col("event_id")})[1].select("event_id"), "SELECT event_id FROM events WHERE coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT) % 3, 0) <= 0")
add("json_explode_votes", lambda s, d: ld.last_is_final(read(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("ids")), "ids").selectExpr("l_orderkey", "CAST(pos AS LONG) AS pos", "CAST(vote_id AS LONG) AS vote_id", "final"), "SELECT l_orderkey, row_number() OVER w - 1 AS pos, CAST(l_linenumber AS BIGINT) AS vote_id, row_number() OVER w = count(*) OVER (PARTITION BY l_orderkey) AS final FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)")
add("upsert_rows", lambda s, d: ld.upsert(read(s, d, "customer").select("c_custkey", "c_acctbal"), read(s, d, "customer").where("c_custkey % 3 = 0").selectExpr("c_custkey", "0.0D AS c_acctbal"), "c_custkey"), "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0.0::DOUBLE ELSE c_acctbal END AS c_acctbal FROM customer")
add("new_rows", lambda s, d: ld.new_only(read(s, d, "customer").select("c_custkey", "c_nationkey"), read(s, d, "orders").where("o_orderkey % 16 = 0").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 16 = 0)")
add("stub_sessions", lambda s, d: ld.stub_sessions(read(s, d, "orders").select(F.to_date("o_orderdate").alias("day")), read(s, d, "orders").where("o_orderkey % 2 = 0").select(F.to_date("o_orderdate").alias("day"))).select(F.col("day").cast("string").alias("day")), "SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders WHERE CAST(o_orderdate AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 2 = 0)")
add("election_spells", lambda s, d: ld.election_spells(read(s, d, "orders").join(read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).selectExpr("CAST(c_nationkey AS STRING) AS country", "year(o_orderdate) AS year", "c_mktsegment AS party", "o_orderkey % 9 = 0 AS in_government")).selectExpr("country", "party", "CAST(year_from AS LONG) AS year_from", "CAST(year_to AS LONG) AS year_to"),
    "WITH r AS (SELECT CAST(c_nationkey AS VARCHAR) AS country, year(o_orderdate) AS year, c_mktsegment AS party, o_orderkey % 9 = 0 AS g FROM orders JOIN customer ON o_custkey = c_custkey), y AS (SELECT country, year, lead(year) OVER (PARTITION BY country ORDER BY year) AS nxt FROM (SELECT DISTINCT country, year FROM r) x) SELECT DISTINCT r.country, party, year AS year_from, nxt AS year_to FROM r JOIN y USING (country, year) WHERE g")
add("uri_parts", lambda s, d: read(s, d, "pages").select("page_id", tx.basename(F.col("url")).alias("last"), tx.digits(tx.basename(F.col("url"))).cast("long").alias("number")), "SELECT page_id, split_part(url, '/', -1) AS last, try_cast(regexp_replace(split_part(url, '/', -1), '[^0-9]', '', 'g') AS BIGINT) AS number FROM pages")
URIS = ["concat('http://x/', IF(s_suppkey % 3 = 0, 'FEMALE', 'MALE')) AS sex", "concat('http://x/org/', IF(s_suppkey % 4 = 0, 'EP-x', concat('EP-', s_suppkey % 11))) AS term", "array('a/b/' || s_suppkey, s_suppkey || '', 'c/') AS many"]
add(
    "uri_values",
    lambda s, d: read(s, d, "supplier").selectExpr("s_suppkey", *URIS).select("s_suppkey", tx.is_female(F.col("sex")).alias("female"), tx.term_number(F.col("term")).cast("long").alias("term"), F.concat_ws(",", tx.basenames(F.col("many"))).alias("last_parts")),
    "SELECT s_suppkey, s_suppkey % 3 = 0 AS female, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 11 END AS term, s_suppkey || ',' || s_suppkey || ',' AS last_parts FROM supplier",
)
add("one_line_texts", lambda s, d: read(s, d, "conversations").select("conv_id", "turn", tx.one_line(F.col("text")).alias("line")), "SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS line FROM conversations")
add("name_ids", lambda s, d: ld.name_ids(read(s, d, "customer").selectExpr("IF(c_custkey % 10 = 0, NULL, c_mktsegment || c_nationkey) AS name"), "name").agg(F.count("*").alias("rows"), F.count_distinct("name").alias("names"), F.count_distinct("id").alias("ids")), "SELECT count(DISTINCT n) AS rows, count(DISTINCT n) AS names, count(DISTINCT n) AS ids FROM (SELECT c_mktsegment || c_nationkey AS n FROM customer WHERE c_custkey % 10 > 0) x")
add("refresh_rows", lambda s, d: ld.refresh(read(s, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), read(s, d, "customer").where("c_custkey % 3 = 0").selectExpr("c_custkey", "IF(c_custkey % 2 = 0, 1.5D, NULL) AS c_acctbal"), "c_custkey"), "SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 1.5 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
add("iso_timestamps", lambda s, d: read(s, d, "orders").select("o_orderkey", tx.timestamp(F.concat(F.lit("http://x/"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))).alias("ts")), "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ts FROM orders")
BITS = "(SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) r(i)) x)"
CRC = "xor(list_reduce(list_concat([4294967295], [CAST(ascii(c) AS BIGINT) FOR c IN string_split(s_name, '')]), lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1])), 4294967295)"
add("colours", lambda s, d: read(s, d, "supplier").select("s_suppkey", tx.colour(F.when(F.col("s_suppkey") % 5 == 0, F.lit("ABCDEF")), F.col("s_name")).alias("colour")), f"SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN '#ABCDEF' ELSE '#' || {tx.COLOURS}[{CRC} % {len(tx.COLOURS)} + 1] END AS colour FROM supplier, {BITS} b")
ACCENTED = "concat(s_name, ' \u00c9t\u00e9 (\u00fcber) N\u0303and\u00fa', s_nationkey, ' ', chr(64257))"
add(
    "name_normal_forms",
    lambda s, d: read(s, d, "supplier").select("s_suppkey", tx.ascii_name(F.expr(ACCENTED.replace("chr(64257)", "'\ufb01'"))).alias("plain"), tx.folded_name(F.expr(ACCENTED.replace("chr(64257)", "'\ufb01'"))).alias("folded")),
    "SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) || ' ete nandu' || s_nationkey || ' fi' AS plain, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) || ' ete uber nandu' || s_nationkey || ' fi' AS folded FROM supplier",
)
CHAIN = ["CASE WHEN s_suppkey % 5 > 0 THEN 'w' || s_suppkey {d} 2 END AS wiki_id", "CASE WHEN s_suppkey % 16 NOT IN (0, 15) THEN 'a' || (s_suppkey + 1) {d} 2 END AS abbr", "CASE WHEN s_suppkey % 32 < 16 THEN s_suppkey {d} 32 END AS country"]
TIED = f"""WITH RECURSIVE s AS (SELECT s_suppkey AS id, {', '.join(c.format(d='//') for c in CHAIN)} FROM supplier),
    t AS (SELECT id, 'w' || wiki_id AS key FROM s WHERE wiki_id IS NOT NULL UNION ALL SELECT id, 'a' || abbr || coalesce('-' || country, '') FROM s WHERE abbr IS NOT NULL),
    r AS (SELECT id, id AS other FROM s UNION SELECT r.id, b.id FROM r JOIN t a ON a.id = r.other JOIN t b ON b.key = a.key), c AS (SELECT id, min(other) AS canonical FROM r GROUP BY id)"""


def chained(s, d) -> DataFrame:
    """Suppliers as subjects in chains, each tied to the one before by wiki id or by abbreviation."""
    return read(s, d, "supplier").selectExpr("s_suppkey AS id", *(c.format(d="DIV") for c in CHAIN))


add("subject_dedup", lambda s, d: cl.deduplicated(chained(s, d)).select("id", "canonical"), f"{TIED} SELECT id, canonical FROM c")
add("subject_aliases", lambda s, d: cl.aliases(chained(s, d), read(s, d, "supplier").where("s_suppkey % 7 = 0").selectExpr("s_suppkey AS id")), f"{TIED} SELECT id, canonical FROM c WHERE id <> canonical AND id % 7 > 0")
add("match_cascade", lambda s, d: mt.cascade(read(s, d, "customer").selectExpr("c_custkey AS key", "CASE WHEN c_custkey % 3 = 0 THEN concat('Q', c_custkey) END AS wiki_id", "upper(replace(c_name, 'Customer', 'Supplier')) AS full", "c_name AS short"), read(s, d, "supplier").selectExpr("s_suppkey AS id", "concat('Q', s_suppkey) AS wiki_id", "s_name AS name")),
    "SELECT c_custkey AS key, coalesce(w.s_suppkey, f.s_suppkey) AS id, CASE WHEN w.s_suppkey IS NOT NULL THEN 'wiki_id' WHEN f.s_suppkey IS NOT NULL THEN 'full_name' ELSE 'none' END AS method FROM customer LEFT JOIN supplier w ON c_custkey % 3 = 0 AND w.s_suppkey = c_custkey LEFT JOIN supplier f ON lower(f.s_name) = lower(replace(c_name, 'Customer', 'Supplier'))")
add("registry_clusters", lambda s, d: mt.clusters(read(s, d, "supplier").selectExpr("s_nationkey AS country", "left(s_name, 17) AS label", "s_suppkey AS id")).select(F.col("country").cast("long").alias("country"), "label", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids")), "SELECT CAST(s_nationkey AS BIGINT) AS country, left(s_name, 17) AS label, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) AS ids FROM supplier GROUP BY 1, 2")


def records(s, d):
    return read(s, d, "nation").join(read(s, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_name", F.col("n_nationkey").cast("long").alias("no")).agg(F.count_if(F.col("c_acctbal") > 0).alias("tp"), F.count_if(F.col("c_acctbal") <= 0).alias("fp"), F.count_if(F.col("c_custkey") % 7 == 0).alias("fn"), F.count_if((F.col("c_acctbal") > 0) & (F.col("c_custkey") % 2 == 0)).alias("strict"))


def score_sql(by: str) -> str:
    f = lambda c: f"round({c} / CAST(tp + fp AS DOUBLE), 4) AS precision_{c}, round({c} / CAST(tp + fn AS DOUBLE), 4) AS recall_{c}, round(CASE WHEN {c} = 0 THEN 0 ELSE 2 * ({c} / CAST(tp + fp AS DOUBLE)) * ({c} / CAST(tp + fn AS DOUBLE)) / ({c} / CAST(tp + fp AS DOUBLE) + {c} / CAST(tp + fn AS DOUBLE)) END, 4) AS f1_{c}"
    return f"SELECT {by and 'n_name,'} tp, fp, fn, strict, {f('tp')}, {f('strict')} FROM (SELECT {by and 'n_name,'} count(*) FILTER (WHERE c_acctbal > 0) AS tp, count(*) FILTER (WHERE c_acctbal <= 0) AS fp, count(*) FILTER (WHERE c_custkey % 7 = 0) AS fn, count(*) FILTER (WHERE c_acctbal > 0 AND c_custkey % 2 = 0) AS strict FROM nation JOIN customer ON n_nationkey = c_nationkey {by and 'GROUP BY n_name'}) x"


add("extraction_scores", lambda s, d: mt.scores(records(s, d)), score_sql(""))
add("extraction_scores_by_country", lambda s, d: mt.scores(records(s, d), "n_name"), score_sql("n"))
NUMBERED = lambda s, d: records(s, d).drop("n_name")
BOOTS = 10_000
RECORD_SQL = "r AS (SELECT n_nationkey AS no, count(*) FILTER (WHERE c_acctbal > 0) AS tp, count(*) FILTER (WHERE c_acctbal <= 0) AS fp, count(*) FILTER (WHERE c_custkey % 7 = 0) AS fn, count(*) FILTER (WHERE c_acctbal > 0 AND c_custkey % 2 = 0) AS strict FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_nationkey)"


def draws_sql(keys: str, n_boot: int = BOOTS) -> str:
    """The same draws in DuckDB: `p` numbers the keys of r, `b` has the key of each resample and place."""
    return f"""p AS (SELECT *, row_number() OVER (ORDER BY {keys}) - 1 AS place FROM (SELECT DISTINCT {keys} FROM r) k), c AS (SELECT count(*) AS n FROM p),
    b AS (SELECT boot, {keys} FROM (SELECT boot, CAST('0x' || substr(md5(concat_ws(':', 42, boot, k)), 1, 15) AS BIGINT) % n AS place FROM range({n_boot}) x(boot), c, range(c.n) y(k)) d JOIN p USING (place))"""


def f1_sql(tp: str, fp: str = "fp", fn: str = "fn") -> str:
    return f"coalesce(2.0::DOUBLE * sum({tp}) / nullif(2 * sum({tp}) + sum({fp}) + sum({fn}), 0), 0)"


def interval_sql(v: str, n_boot: int = BOOTS) -> str:
    return f"round(list_sort(list({v}))[{int(0.025 * n_boot) + 1}], 9) AS low, round(list_sort(list({v}))[{int(0.975 * n_boot) + 1}], 9) AS high"


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


for name, tp in (("bootstrap_f1", "tp"), ("bootstrap_f1_strict", "strict")):
    add(name, lambda s, d, tp=tp: rounded(rs.bootstrap(NUMBERED(s, d), BOOTS, matched=tp)), f"WITH {RECORD_SQL}, {draws_sql('no')}, f AS (SELECT {f1_sql(tp)} AS v FROM b JOIN r USING (no) GROUP BY boot) SELECT (SELECT round({f1_sql(tp)}, 9) FROM r) AS point, {interval_sql('v')} FROM f")
add("paired_bootstrap", lambda s, d: rounded(rs.paired_bootstrap(NUMBERED(s, d), NUMBERED(s, d).withColumn("fp", F.col("fp") + F.col("no") % 5 - 2), BOOTS)), f"""WITH {RECORD_SQL}, {draws_sql('no')}, f AS (SELECT {f1_sql('tp')} - {f1_sql('tp', 'fp + no % 5 - 2')} AS v FROM b JOIN r USING (no) GROUP BY boot),
    o AS (SELECT {f1_sql('tp')} - {f1_sql('tp', 'fp + no % 5 - 2')} AS point FROM r)
    SELECT round(point, 9) AS point, {interval_sql('v')}, round(least(1.0, 2.0 * CASE WHEN point >= 0 THEN count(*) FILTER (WHERE v <= 0) ELSE count(*) FILTER (WHERE v >= 0) END / {BOOTS}), 9) AS p FROM f, o GROUP BY point""")
add("keyed_compare", lambda s, d: mt.differences(read(s, d, "part").selectExpr("p_partkey", "p_retailprice + IF(p_partkey % 10 = 0, 1, 0) AS price"), read(s, d, "part").selectExpr("p_partkey", "p_retailprice AS price"), "p_partkey").select("p_partkey"), "SELECT p_partkey FROM part WHERE p_partkey % 10 = 0")
add("valid_extraction", lambda s, d: mt.valid_extraction(read(s, d, "events").selectExpr("event_id", "CASE WHEN event_id % 2 = 0 THEN '[{\"party_name\":\"A\",\"seats\":1,\"in_government\":true}]' ELSE props END AS raw"), "raw").select("event_id", "schema_valid"), "SELECT event_id, event_id % 2 = 0 AS schema_valid FROM events")
add("page_reduction", lambda s, d: pg.reduced(read(s, d, "pages"), "text"))
add("page_markdown", lambda s, d: pg.reduced(read(s, d, "pages")))
add("page_tables", lambda s, d: pg.tables(read(s, d, "pages")))
add("page_compression", lambda s, d: pg.reduced(read(s, d, "pages")).agg(F.avg("ratio").alias("ratio"), F.count("*").alias("n")))
