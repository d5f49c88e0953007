"""The registered queries over the roll-call model, each beside its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.operators import itemsets as its
from plenum.operators import rollcall as rc
from plenum.operators import topics as tp
from plenum.plans import prepared
from plenum.plans.model import Model, twin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, f: Callable[[Model], DataFrame], sql: str | None) -> None:
    """Counts go out as long, days as text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(prepared.model(spark, sf_dir))
        return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes))

    QUERIES[name] = run
    if sql:
        SQL[name] = twin(sql)


def pct(a: str, b: str, places: int = 4) -> str:
    return f"round(CAST({a} AS DOUBLE) / {b}, {places})"


VOTE = "vote_id, session_id, term, CAST(day AS VARCHAR) AS day, procedural, final, topic"
add("valid_term_votes", lambda m: rc.term_votes(m).select("vote_id", "session_id", "term", "day", "procedural", "final", "topic"), f"SELECT {VOTE} FROM term_votes".replace("term,", "CAST(term AS BIGINT) AS term,"))
add("active_votes", lambda m: rc.cast_votes(m).select("vote_id", "member_id", "option", "term"), "SELECT vote_id, member_id, CAST(option AS BIGINT) AS option, CAST(term AS BIGINT) AS term FROM cast_votes")
add("member_group_by_session", lambda m: rc.affiliation(m), "SELECT * FROM group_at")
add("member_national_by_session", lambda m: rc.affiliation(m, "national"), "SELECT * FROM national_at")
add("member_group_by_session_of_term", lambda m: rc.affiliation(m, variant="term_or_start"), """SELECT DISTINCT s.session_id, m.member_id, m.subject_id FROM sessions s JOIN terms t USING (term) JOIN memberships m
    ON s.day BETWEEN m.d_from AND coalesce(m.d_to, DATE '9999-12-31') WHERE m.kind = 'group' AND (m.term = s.term OR m.d_from >= t.d_from)""")
add("term_of_date", lambda m: rc.term_of(m, m.sessions.select("day").distinct()), "SELECT CAST(day AS VARCHAR) AS day, CAST(term AS BIGINT) AS term_found FROM (SELECT DISTINCT day FROM sessions) s LEFT JOIN terms t ON day BETWEEN d_from AND coalesce(d_to, DATE '9999-12-31')")
add("current_affiliation", rc.current_affiliation, """SELECT CAST(t AS BIGINT) AS term, member_id, kind, subject_id FROM (SELECT t.term AS t, m.member_id, m.kind, m.subject_id,
    row_number() OVER (PARTITION BY t.term, m.member_id, m.kind ORDER BY m.d_from DESC, m.subject_id) AS r FROM memberships m JOIN terms t
    ON m.d_from <= coalesce(t.d_to, CAST(t.d_from + INTERVAL 60 MONTH AS DATE)) AND coalesce(m.d_to, DATE '9999-12-31') >= t.d_from) x WHERE r = 1""")
add("group_vote_counts", lambda m: rc.vote_counts(rc.group_votes(m)), "SELECT vote_id, subject_id, CAST(option AS BIGINT) AS option, count(*) AS n FROM group_votes WHERE procedural IS NOT TRUE GROUP BY ALL")
add("group_vote_counts_all", lambda m: rc.vote_counts(rc.group_votes(m), True), "SELECT vote_id, subject_id, CAST(option AS BIGINT) AS option, count(*) AS n FROM group_votes GROUP BY ALL")
add("group_plurality", lambda m: rc.plurality(rc.group_votes(m)), "SELECT vote_id, subject_id, CAST(plurality AS BIGINT) AS plurality FROM plurality")
add("session_attendance", rc.attendance, "SELECT DISTINCT * FROM attendance")
add("session_present_count", rc.present_count, "SELECT session_id, count(*) FILTER (WHERE status = 'present') AS present FROM sessions LEFT JOIN (SELECT DISTINCT * FROM attendance) a USING (session_id) GROUP BY session_id")
PARTICIPATION = f"SELECT member_id, count(*) FILTER (WHERE status = 'present') AS present, count(*) AS total, {pct("count(*) FILTER (WHERE status = 'present')", 'count(*)')} AS ratio FROM (SELECT DISTINCT * FROM attendance) a GROUP BY member_id"
BINS = "SELECT b.bin, coalesce(h.n, 0) AS n FROM (SELECT range AS bin FROM range(10)) b LEFT JOIN (SELECT CAST(least(9, floor({0} * 10)) AS BIGINT) AS bin, count(*) AS n FROM ({1}) x WHERE {0} IS NOT NULL GROUP BY 1) h USING (bin)"
add("member_participation", rc.participation, PARTICIPATION)
add("participation_histogram", lambda m: rc.histogram(rc.participation(m), "ratio"), BINS.format("ratio", PARTICIPATION))
add("member_vote_stats", rc.member_stats, "SELECT CAST(term AS BIGINT) AS term, member_id, subject_id, CAST(option AS BIGINT) AS option, n FROM member_stats")
SUBJECTS = """SELECT term, subject_id, option, CAST(sum(n) AS BIGINT) AS n FROM member_stats GROUP BY ALL UNION ALL
    SELECT c.term, n.subject_id, c.option, count(*) AS n FROM cast_votes c JOIN national_at n USING (session_id, member_id) GROUP BY ALL"""
OPTIONS = "CAST(sum(CASE WHEN option = 1 THEN n ELSE 0 END) AS BIGINT) AS n_for, CAST(sum(CASE WHEN option = 2 THEN n ELSE 0 END) AS BIGINT) AS n_against, CAST(sum(CASE WHEN option = 3 THEN n ELSE 0 END) AS BIGINT) AS n_abstain, CAST(sum(n) AS BIGINT) AS total"
add("subject_vote_stats", rc.subject_stats, f"SELECT CAST(term AS BIGINT) AS term, subject_id, CAST(option AS BIGINT) AS option, n FROM ({SUBJECTS}) s")
MAIN = "(SELECT term, member_id, subject_id AS main_subject FROM (SELECT *, row_number() OVER (PARTITION BY term, member_id ORDER BY n DESC, subject_id) AS r FROM (SELECT term, member_id, subject_id, sum(n) AS n FROM member_stats WHERE subject_id IS NOT NULL GROUP BY ALL) a) b WHERE r = 1)"
add("member_statistics", lambda m: rc.by_option(s := rc.member_stats(m), "term", "member_id").join(rc.main_subject(s, "term", "member_id"), ["term", "member_id"], "left"), f"SELECT CAST(term AS BIGINT) AS term, member_id, n_for, n_against, n_abstain, total, main_subject FROM (SELECT term, member_id, {OPTIONS} FROM member_stats GROUP BY ALL) s LEFT JOIN {MAIN} m USING (term, member_id)")
add("subject_statistics", lambda m: rc.by_option(rc.subject_stats(m).where("subject_id IS NOT NULL"), "term", "subject_id"), f"SELECT CAST(term AS BIGINT) AS term, subject_id, {OPTIONS} FROM ({SUBJECTS}) s WHERE subject_id IS NOT NULL GROUP BY ALL")
add("member_list", lambda m: rc.main_subject(rc.member_stats(m), "term", "member_id").join(m.members, "member_id").select("term", "member_id", "name", "country", "main_subject"), f"SELECT CAST(term AS BIGINT) AS term, member_id, name, country, main_subject FROM {MAIN} s JOIN members USING (member_id)")
add("subject_percentages", lambda m: rc.by_option(rc.subject_stats(m).where("subject_id IS NOT NULL"), "term", "subject_id").select("term", "subject_id", *(F.round(F.coalesce(F.col(c) * 100.0 / F.nullif("total", F.lit(0)), F.lit(0.0)), 4).alias(c.replace("n_", "pct_")) for c in ("n_for", "n_against", "n_abstain"))),
    f"SELECT CAST(term AS BIGINT) AS term, subject_id, round(n_for * 100.0::DOUBLE / total, 4) AS pct_for, round(n_against * 100.0::DOUBLE / total, 4) AS pct_against, round(n_abstain * 100.0::DOUBLE / total, 4) AS pct_abstain FROM (SELECT term, subject_id, {OPTIONS} FROM ({SUBJECTS}) s WHERE subject_id IS NOT NULL GROUP BY ALL) x")
add("for_share_histogram", lambda m: rc.histogram(rc.by_option(rc.member_stats(m), "member_id").withColumn("x", F.round(F.col("n_for") / F.col("total"), 6)), "x"), BINS.format("x", f"SELECT round(CAST(n_for AS DOUBLE) / total, 6) AS x FROM (SELECT member_id, {OPTIONS} FROM member_stats GROUP BY ALL) s"))
add("session_cohesion", lambda m: rc.pooled_cohesion(rc.group_votes(m)).withColumn("cohesion", F.round("cohesion", 4)), "SELECT session_id, subject_id, y, n, a, round(cohesion, 4) AS cohesion FROM session_cohesion")
PARTY = "SELECT CAST(term AS BIGINT) AS term, subject_id, round(avg(cohesion), 4) AS ai, count(*) AS sessions FROM session_cohesion JOIN sessions USING (session_id) GROUP BY ALL"
add("party_cohesion", rc.party_cohesion, PARTY)
COUNTRY = """WITH v AS (SELECT * FROM cast_votes JOIN members USING (member_id) WHERE procedural IS NOT TRUE AND country IS NOT NULL),
    n AS (SELECT term, country, vote_id, count(*) FILTER (WHERE option = 1) AS y, count(*) FILTER (WHERE option = 2) AS n, count(*) FILTER (WHERE option = 3) AS a FROM v GROUP BY ALL)
    SELECT CAST(term AS BIGINT) AS term, country, ai, votes, mep_count FROM (SELECT term, country, round(avg(CAST(greatest(y, n, a) AS DOUBLE) / (y + n + a) * 100), 4) AS ai, count(*) AS votes FROM n WHERE y + n + a >= 2 GROUP BY ALL) a
    JOIN (SELECT term, country, count(DISTINCT member_id) AS mep_count FROM v GROUP BY ALL) b USING (term, country)"""
add("country_cohesion", rc.country_cohesion, COUNTRY)
add("cohesion_average", lambda m: rc.party_cohesion(m).groupBy("term").agg(F.round(F.avg("ai"), 3).alias("average")), f"SELECT term, round(avg(ai), 3) AS average FROM ({PARTY}) p GROUP BY term")
AGREE = f"""SELECT CAST(a.term AS BIGINT) AS term, a.subject_id AS subject1, b.subject_id AS subject2, count(*) FILTER (WHERE a.plurality = b.plurality) AS agreed, count(*) AS total, {pct('count(*) FILTER (WHERE a.plurality = b.plurality)', 'count(*)')} AS agreement
    FROM (SELECT * FROM plurality JOIN term_votes USING (vote_id)) a JOIN (SELECT * FROM plurality JOIN term_votes USING (vote_id)) b ON a.vote_id = b.vote_id AND a.subject_id < b.subject_id GROUP BY 1, 2, 3"""
add("group_agreement", rc.group_agreement, AGREE)
add("group_agreement_matrix", rc.agreement_matrix, f"WITH p AS ({AGREE}), e AS (SELECT term, subject1, subject2, agreement FROM p UNION ALL SELECT term, subject2, subject1, agreement FROM p) SELECT * FROM e UNION ALL SELECT DISTINCT term, subject1, subject1, 1.0::DOUBLE FROM e")
LOYAL = f"SELECT member_id, subject_id, CAST(term AS BIGINT) AS term, total, loyal, {pct('loyal', 'total')} AS loyalty FROM loyalty"
add("member_loyalty", lambda m: rc.loyalty(rc.group_votes(m)), LOYAL)
add("loyalty_histogram", lambda m: rc.histogram(rc.loyalty(rc.group_votes(m)), "loyalty"), BINS.format("loyalty", LOYAL))
GOV = f"""SELECT member_id, subject_id, CAST(term AS BIGINT) AS term, in_government, total, loyal, {pct('loyal', 'total')} AS loyalty FROM (SELECT v.member_id, v.subject_id, v.term, in_government, count(*) AS total, count(*) FILTER (WHERE v.option = p.plurality) AS loyal
    FROM group_votes v JOIN plurality p USING (vote_id, subject_id) JOIN (SELECT n.session_id, n.member_id, n.subject_id AS party, EXISTS (SELECT 1 FROM government g WHERE g.subject_id = n.subject_id
    AND CAST(left(year_from, 4) AS INT) <= year(s.day) AND year(s.day) < coalesce(CAST(left(year_to, 4) AS INT), 9999)) AS in_government FROM national_at n JOIN sessions s USING (session_id)) g
    USING (session_id, member_id) WHERE v.procedural IS NOT TRUE GROUP BY ALL) x"""
add("government_loyalty", rc.government_loyalty, GOV)
add("government_loyalty_by_group", lambda m: rc.government_loyalty(m).groupBy("term", "subject_id", "in_government").agg(F.round(F.sum("loyal") * 100.0 / F.sum("total"), 4).alias("loyalty")), f"SELECT term, subject_id, in_government, round(CAST(sum(loyal) AS DOUBLE) * 100.0 / CAST(sum(total) AS DOUBLE), 4) AS loyalty FROM ({GOV}) g GROUP BY ALL")
COMPARE = "SELECT a.vote_id, a.topic, CAST(a.option AS BIGINT) AS option1, CAST(b.option AS BIGINT) AS option2, a.option = b.option AS agree FROM cast_votes a JOIN cast_votes b ON a.vote_id = b.vote_id AND a.member_id = 1 AND b.member_id = 2"
add("compare_members_votes", lambda m: rc.compare_members(m, 1, 2), COMPARE)
add("compare_members_topics", lambda m: rc.compare_members(m, 1, 2, False).groupBy("topic").agg(F.count("*").alias("total"), F.count_if("agree").alias("agreed"), F.round(F.count_if("agree") * 100.0 / F.count("*"), 4).alias("pct")), f"SELECT topic, count(*) AS total, count(*) FILTER (WHERE agree) AS agreed, round(count(*) FILTER (WHERE agree) * 100.0::DOUBLE / count(*), 4) AS pct FROM ({COMPARE} WHERE a.procedural IS NOT TRUE) c GROUP BY topic")
CURRENT = SQL["current_affiliation"]
add("member_card", lambda m: rc.current_affiliation(m).groupBy("term", "member_id").pivot("kind", ["group", "national"]).agg(F.first("subject_id")).join(m.members, "member_id").select("term", "member_id", "name", "country", F.col("group").alias("grp"), F.col("national").alias("party")),
    f"SELECT term, member_id, name, country, max(CASE WHEN kind = 'group' THEN subject_id END) AS grp, max(CASE WHEN kind = 'national' THEN subject_id END) AS party FROM ({CURRENT}) c JOIN members USING (member_id) GROUP BY ALL")
PAIRS = """SELECT {v} member1, member2, agree, common, pct, rank FROM (SELECT *, row_number() OVER (PARTITION BY {p} ORDER BY pct DESC, common DESC, member1, member2) AS rank FROM (SELECT {v} member1, member2, agree, common, round(CAST(agree AS DOUBLE) * 100.0 / common, 1) AS pct FROM (
    SELECT {a} a.member_id AS member1, b.member_id AS member2, count(*) FILTER (WHERE a.option = b.option) AS agree, count(*) AS common FROM cast_votes a JOIN cast_votes b ON a.vote_id = b.vote_id AND a.member_id < b.member_id
    WHERE a.procedural IS NOT TRUE {w} GROUP BY ALL) x WHERE common >= 10) y) z WHERE rank <= 5000"""
add("member_pairs_overall", lambda m: rc.member_pairs(rc.cast_votes(m), "term"), PAIRS.format(v="CAST(term AS BIGINT) AS term,", p="term", a="a.term,", w=""))
add("member_pairs_overall_tiles", lambda m: rc.member_pairs(rc.cast_votes(m), "term", method="tiles"), PAIRS.format(v="CAST(term AS BIGINT) AS term,", p="term", a="a.term,", w=""))
add("member_pairs_by_topic", lambda m: rc.member_pairs(rc.cast_votes(m).where("topic IS NOT NULL"), "topic"), PAIRS.format(v="topic,", p="topic", a="a.topic,", w="AND a.topic IS NOT NULL"))
add("member_index", lambda m: rc.main_subject(rc.member_stats(m), "member_id").join(m.members, "member_id").join(rc.main_subject(rc.with_subject(rc.cast_votes(m), rc.affiliation(m, "national")).groupBy("member_id", "subject_id").agg(F.count("*").alias("n")), "member_id").withColumnRenamed("main_subject", "main_party"), "member_id", "left").select("member_id", "name", "country", "main_subject", "main_party"),
    """WITH g AS (SELECT member_id, subject_id AS main_subject, row_number() OVER (PARTITION BY member_id ORDER BY sum(n) DESC, subject_id) AS r FROM member_stats WHERE subject_id IS NOT NULL GROUP BY member_id, subject_id),
    p AS (SELECT member_id, subject_id AS main_party, row_number() OVER (PARTITION BY member_id ORDER BY count(*) DESC, subject_id) AS r FROM cast_votes JOIN national_at USING (session_id, member_id) GROUP BY member_id, subject_id)
    SELECT g.member_id, name, country, main_subject, main_party FROM g JOIN members USING (member_id) LEFT JOIN p ON p.member_id = g.member_id AND p.r = 1 WHERE g.r = 1""")  # fmt: skip
add("party_main_group", tp.party_main_group, "SELECT CAST(term AS BIGINT) AS term, party, grp FROM party_group")
add("party_topic_profile", lambda m: tp.party_topics(m).withColumn("share", F.round("share", 4)).join(tp.party_main_group(m), ["term", "party"], "left"), "SELECT CAST(term AS BIGINT) AS term, party, topic, n, round(share, 4) AS share, grp FROM party_topic LEFT JOIN party_group USING (term, party)")
add("topic_heatmap", lambda m: tp.party_topics(m).join(tp.party_main_group(m), ["term", "party"]).where("grp = 1").select("term", "party", "topic", F.round(100 * F.round("share", 6), 0).alias("pct")), "SELECT CAST(term AS BIGINT) AS term, party, topic, round(100 * round(share, 6), 0) AS pct FROM party_topic JOIN party_group USING (term, party) WHERE grp = 1")
add("topic_share_by_country", lambda m: tp.country_topics(m).withColumn("share", F.round("share", 4)), "SELECT CAST(term AS BIGINT) AS term, topic, country, n, round(share, 4) AS share FROM country_topic")
IND = "SELECT t.term, i.name, i.country, avg(i.value) AS value FROM indicators i JOIN terms t ON i.year BETWEEN year(t.d_from) AND year(coalesce(t.d_to, DATE '9999-12-31')) WHERE value IS NOT NULL GROUP BY ALL"
add("topic_indicator_correlation", lambda m: tp.correlations(m).select("term", "topic", "name", "n", F.round("r", 4).alias("r"), F.round("slope", 9).alias("slope"), F.round("intercept", 4).alias("intercept")), f"SELECT CAST(term AS BIGINT) AS term, topic, i.name, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(corr(value, share), 4) END AS r, round(regr_slope(share, value), 9) AS slope, round(regr_intercept(share, value), 4) AS intercept FROM country_topic c JOIN ({IND}) i USING (term, country) GROUP BY ALL")
# the tail of Student's t with k degrees of freedom, a finite series in the angle whose sine is |r|; odd and even k apart
SERIES = "list_sum([coalesce(list_aggregate([CASE WHEN k % 2 = 1 THEN 2.0::DOUBLE * j / (2 * j + 1) ELSE (2.0::DOUBLE * j - 1) / (2 * j) END * (1 - r * r) FOR j IN range(1, i + 1)], 'product'), 1) FOR i IN range(0, CASE WHEN k % 2 = 1 THEN (k - 1) // 2 ELSE k // 2 END)])"
TAIL = f"CASE WHEN k < 1 OR r IS NULL THEN NULL WHEN abs(r) >= 1 THEN 0 WHEN k % 2 = 1 THEN 1 - 2 / pi() * (asin(abs(r)) + CASE WHEN k > 1 THEN abs(r) * sqrt(1 - r * r) * {SERIES} ELSE 0 END) ELSE 1 - abs(r) * {SERIES} END"
STARS = "CASE WHEN p IS NULL THEN '' WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'n.s.' END"
add("topic_indicator_pvalue", lambda m: tp.correlations(m).select("term", "topic", "name", F.round("p", 4).alias("p"), tp.stars(F.col("p")).alias("stars")), f"""SELECT term, topic, name, round(p, 4) AS p, {STARS} AS stars FROM (SELECT *, greatest({TAIL}, 0) AS p
    FROM (SELECT CAST(term AS BIGINT) AS term, topic, i.name, count(*) - 2 AS k, CASE WHEN count(*) >= 3 THEN CASE WHEN isfinite(corr(value, share)) THEN corr(value, share) END END AS r FROM country_topic c JOIN ({IND}) i USING (term, country) GROUP BY ALL) q) z""")
DEV = """SELECT DISTINCT CAST(term AS BIGINT) AS scope, party AS key, topic || ':' || CASE WHEN gap > 0 THEN 'ABOVE' ELSE 'BELOW' END AS item FROM (SELECT term, party, topic, round(share - round(avg(share) OVER (PARTITION BY term, grp, topic), 4), 6) AS gap FROM party_topic JOIN party_group USING (term, party)) d WHERE abs(gap) > 0.10"""
OPP = "SELECT CAST(term AS BIGINT) AS scope, vote_id AS key, item FROM vote_items JOIN term_votes USING (vote_id)"


def opposition_items(m: Model) -> DataFrame:
    p = rc.group_votes(m).where(rc.SUBSTANTIAL).where("final IS TRUE").groupBy("term", "vote_id", "subject_id").agg(F.min("plurality").alias("plurality"))
    said = F.when(F.col("plurality") == 1, "FOR").when(F.col("plurality") == 2, "AGAINST").otherwise("ABSTAIN")
    return p.select(F.col("term").cast("long").alias("scope"), F.col("vote_id").alias("key"), F.concat_ws(":", F.col("subject_id").cast("string"), said).alias("item")).distinct()


def itemsets_sql(items: str, support: float, least: int) -> str:
    return f"""i0 AS ({items}), tx AS (SELECT scope, key FROM i0 GROUP BY ALL HAVING count(*) >= {least}), it AS (SELECT * FROM i0 JOIN tx USING (scope, key)),
    tot AS (SELECT scope, CAST(count(*) AS DOUBLE) AS total FROM tx GROUP BY scope),
    l1 AS (SELECT scope, item AS a, count(*) / any_value(total) AS support FROM it JOIN tot USING (scope) GROUP BY ALL HAVING count(*) / any_value(total) >= {support}),
    f AS (SELECT it.scope, key, item FROM it JOIN l1 ON it.scope = l1.scope AND item = a),
    l2 AS (SELECT x.scope, x.item AS a, y.item AS b, count(*) / any_value(total) AS support FROM f x JOIN f y ON x.scope = y.scope AND x.key = y.key AND x.item < y.item JOIN tot ON tot.scope = x.scope GROUP BY ALL HAVING count(*) / any_value(total) >= {support}),
    l3 AS (SELECT x.scope, x.item AS a, y.item AS b, z.item AS c, count(*) / any_value(total) AS support FROM f x JOIN f y ON x.scope = y.scope AND x.key = y.key AND x.item < y.item JOIN f z ON x.scope = z.scope AND x.key = z.key AND y.item < z.item JOIN tot ON tot.scope = x.scope GROUP BY ALL HAVING count(*) / any_value(total) >= {support}),
    sets AS (SELECT scope, [a] AS items, support FROM l1 UNION ALL SELECT scope, [a, b], support FROM l2 UNION ALL SELECT scope, [a, b, c], support FROM l3)"""


def rules_sql(items: str, support: float, least: int) -> str:
    return f"""WITH {itemsets_sql(items, support, least)}, sp AS (SELECT scope, items, support, [x FOR x, i IN items IF (mask >> (i - 1)) % 2 = 1] AS ante, [x FOR x, i IN items IF (mask >> (i - 1)) % 2 = 0] AS cons FROM sets, (SELECT CAST(range AS INT) AS mask FROM range(1, 7)) m WHERE len(items) >= 2 AND mask < (1 << len(items)) - 1),
    b AS (SELECT sp.*, sp.support / p.support AS confidence, round(sp.support / p.support / q.support, 4) AS lift FROM sp JOIN sets p ON p.scope = sp.scope AND p.items = ante JOIN sets q ON q.scope = sp.scope AND q.items = cons WHERE round(sp.support / p.support, 9) >= 0.7),
    k AS (SELECT *, row_number() OVER (PARTITION BY scope, items ORDER BY lift DESC, len(ante), array_to_string(ante, ',')) AS r FROM b)
    SELECT scope, array_to_string(ante, ',') AS antecedents, array_to_string(cons, ',') AS consequents, round(support, 4) AS support, round(confidence, 4) AS confidence, lift FROM k WHERE r = 1 AND lift >= 1.15"""


add("deviation_items", tp.deviation_items, DEV)
add("opposition_items", opposition_items, OPP)
SQL_FP = f"WITH {itemsets_sql(OPP, 0.3, 3)} SELECT scope, array_to_string(items, ',') AS items, round(support, 4) AS support FROM sets"
add("frequent_itemsets", lambda m: tp.frequent_itemsets(opposition_items(m), 0.3, least_items=3).select("scope", F.concat_ws(",", "items").alias("items"), F.round("support", 4).alias("support")), SQL_FP)
add("frequent_itemsets_fp", lambda m: its.frequent_itemsets(opposition_items(m), 0.3, least_items=3).select("scope", F.concat_ws(",", "items").alias("items"), F.round("support", 4).alias("support")), SQL_FP)
add("deviation_rules", lambda m: tp.rules(tp.frequent_itemsets(tp.deviation_items(m), 0.2)), rules_sql(DEV, 0.2, 1))
add("opposition_rules", lambda m: tp.rules(tp.frequent_itemsets(opposition_items(m), 0.3, least_items=3)), rules_sql(OPP, 0.3, 3))
ODD = """SELECT j.*, c1 + c2 + c3 >= 5 AND option <> own AND option <> plurality AS anomalous FROM (SELECT *, CASE WHEN c1 >= c2 AND c1 >= c3 THEN 1 WHEN c2 >= c3 THEN 2 ELSE 3 END AS own FROM (
    SELECT *, count(*) FILTER (WHERE option = 1) OVER w AS c1, count(*) FILTER (WHERE option = 2) OVER w AS c2, count(*) FILTER (WHERE option = 3) OVER w AS c3 FROM group_votes WHERE procedural IS NOT TRUE AND final IS TRUE
    WINDOW w AS (PARTITION BY term, member_id ORDER BY day, vote_id, subject_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) x) j JOIN plurality USING (vote_id, subject_id)"""
add("anomalous_votes", lambda m: rc.anomalies(m).where("anomalous").select("term", "member_id", "vote_id", "subject_id", "option", "own", "topic"), f"SELECT CAST(term AS BIGINT) AS term, member_id, vote_id, subject_id, CAST(option AS BIGINT) AS option, CAST(own AS BIGINT) AS own, topic FROM ({ODD}) o WHERE anomalous")
add("anomaly_summary", lambda m: m.members.select("member_id").join(rc.anomalies(m).groupBy("member_id").agg(F.count("*").alias("total"), F.count_if("anomalous").alias("odd")), "member_id", "left").select("member_id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("odd", F.lit(0)).alias("odd"), F.round(F.coalesce(F.col("odd") / F.col("total"), F.lit(0.0)), 4).alias("rate")),
    f"SELECT member_id, coalesce(total, 0) AS total, coalesce(odd, 0) AS odd, round(coalesce(CAST(odd AS DOUBLE) / total, 0), 4) AS rate FROM members LEFT JOIN (SELECT member_id, count(*) AS total, count(*) FILTER (WHERE anomalous) AS odd FROM ({ODD}) o GROUP BY member_id) a USING (member_id)")
add("indicator_long", lambda m: m.indicators.groupBy("name", "country").pivot("year", list(range(1995, 2002))).agg(F.round(F.max("value"), 2)).unpivot(["name", "country"], [str(y) for y in range(1995, 2002)], "year", "value").withColumn("year", F.col("year").try_cast("int")).where("value IS NOT NULL"), "SELECT name, country, CAST(year AS BIGINT) AS year, round(value, 2) AS value FROM indicators WHERE value IS NOT NULL")
FIT = """WITH s AS (SELECT name, country, year, value, {v} AS v FROM indicators), g AS (SELECT name, regr_slope(v, year) AS gs, regr_intercept(v, year) AS ga, avg(v) AS gm, avg(CASE WHEN v IS NOT NULL THEN year END) AS gy FROM s GROUP BY name),
    o AS (SELECT name, country, count(v) AS n, regr_slope(v, year) AS sl, regr_r2(v, year) AS r2, arg_max(v, year) AS lv, max(year) FILTER (WHERE v IS NOT NULL) AS ly, arg_min(v, year) AS fv, min(year) FILTER (WHERE v IS NOT NULL) AS fy FROM s GROUP BY name, country),
    b AS (SELECT s.*, o.* EXCLUDE (name, country), g.* EXCLUDE (name), CASE WHEN n < 2 THEN gs ELSE greatest(0.5, coalesce(r2, 0)) * sl + (1 - greatest(0.5, coalesce(r2, 0))) * gs END AS k FROM s JOIN o USING (name, country) JOIN g USING (name))"""
add("indicator_fill_linear", lambda m: tp.filled(m.indicators, "linear").withColumn("value", F.round("value", 1)), FIT.format(v="value") + " SELECT name, country, CAST(year AS BIGINT) AS year, round(greatest(round(coalesce(value, CASE WHEN n = 0 THEN gm + gs * (year - gy) ELSE lv + k * (year - ly) END), 2), 0), 1) AS value, value IS NULL AS predicted FROM b")
add("indicator_fill_loglinear", lambda m: tp.filled(m.indicators, "loglinear").withColumn("value", F.round("value", 1)), FIT.format(v="CASE WHEN value > 0 THEN ln(value) END") + """, w AS (SELECT *, row_number() OVER q AS no FROM b WINDOW q AS (PARTITION BY name, country ORDER BY year)),
    x AS (SELECT *, last_value(value IGNORE NULLS) OVER p AS a, last_value(CASE WHEN v IS NOT NULL THEN no END IGNORE NULLS) OVER p AS ia, first_value(value IGNORE NULLS) OVER l AS bb, first_value(CASE WHEN v IS NOT NULL THEN no END IGNORE NULLS) OVER l AS ib FROM w
    WINDOW p AS (PARTITION BY name, country ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), l AS (PARTITION BY name, country ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT name, country, CAST(year AS BIGINT) AS year, round(round(coalesce(value, CASE WHEN n = 0 THEN exp(ga + gs * year) WHEN year > ly THEN exp(lv + k * (year - ly)) WHEN year < fy THEN exp(fv + gs * (year - fy)) ELSE a + (bb - a) * (no - ia) / (ib - ia) END), 2), 1) AS value, value IS NULL AS predicted FROM x""")
add("indicator_fill_mean", lambda m: tp.filled(m.indicators, "mean").withColumn("value", F.round("value", 1)), """WITH r AS (SELECT name, country, avg(value) AS m FROM (SELECT *, row_number() OVER (PARTITION BY name, country ORDER BY year DESC) AS r FROM indicators WHERE value IS NOT NULL) x WHERE r <= 5 GROUP BY ALL),
    g AS (SELECT name, avg(value) AS gm FROM indicators GROUP BY name) SELECT name, country, CAST(year AS BIGINT) AS year, round(greatest(round(coalesce(value, m, gm), 2), 0), 1) AS value, value IS NULL AS predicted FROM indicators LEFT JOIN r USING (name, country) JOIN g USING (name)""")
for k in [k for k, v in SQL.items() if ") WITH " in v]:
    SQL[k] = SQL[k].replace(") WITH ", "), ", 1)
