"""Roll-call model tables, derived from the order tables by SQL that Spark and DuckDB both run.

Suppliers are members, parts are votes, a line of a part by a supplier is that member's vote.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: The fifteen topic codes in display order.
TOPICS = ["ECON", "IMCO", "TECH", "ENVI", "ENER", "AGRI", "TRAN", "EMPL", "SANT", "CULT", "LIBE", "AFET", "SEDE", "INTA", "INST"]

TOPIC = "CASE CAST(substr(p_brand, 7) AS INT) % 15 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TOPICS)) + " END"
TOPIC_NO = "CAST(substr(p_brand, 7) AS INT) % 15"

MODEL = {
    "members": "SELECT s_suppkey AS member_id, s_name AS name, n_name AS country, CAST(s_nationkey AS BIGINT) AS nation FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey",
    "votes": f"""SELECT p_partkey AS vote_id, p_partkey % 40 AS session_id,
        CASE WHEN p_size % 10 = 0 THEN true WHEN p_size % 7 = 0 THEN NULL ELSE false END AS procedural,
        CASE WHEN p_size = 13 THEN false WHEN p_size % 11 = 0 THEN NULL ELSE true END AS valid,
        p_type IN ('ECONOMY', 'SMALL', 'LARGE') AS final,
        CASE WHEN p_size % 15 = 14 THEN NULL ELSE {TOPIC} END AS topic FROM {{part}}""",
    "sessions": """SELECT session_id, DATE '1996-01-01' + CAST(45 * session_id AS INT) AS day, CASE WHEN session_id < 20 THEN 9 ELSE 10 END AS term
        FROM (SELECT DISTINCT p_partkey % 40 AS session_id FROM {part}) s""",
    "terms": "SELECT 9 AS term, DATE '1994-01-01' AS d_from, DATE '1998-06-18' AS d_to UNION ALL SELECT 10, DATE '1998-06-19', CAST(NULL AS DATE)",
    "member_votes": f"""SELECT l_partkey AS vote_id, l_suppkey AS member_id, CAST(CASE WHEN flag IN ('A', 'N')
        THEN 1 + (p_size + (l_suppkey % 7) % 2) % 2 ELSE 1 + (s_nationkey + {TOPIC_NO}) % 3 END AS INT) AS option
        FROM (SELECT l_partkey, l_suppkey, min(l_returnflag) AS flag FROM {{lineitem}} GROUP BY l_partkey, l_suppkey) l
        JOIN {{part}} ON l_partkey = p_partkey JOIN {{supplier}} ON l_suppkey = s_suppkey""",
    "memberships": """SELECT s_suppkey AS member_id, s_suppkey % 7 AS subject_id, 'group' AS kind, 9 AS term, DATE '1994-01-01' AS d_from,
        CASE WHEN s_suppkey % 10 = 0 THEN DATE '1998-06-18' END AS d_to FROM {supplier}
        UNION ALL SELECT s_suppkey, (s_suppkey + 3) % 7, 'group', 10, DATE '1998-06-19', CAST(NULL AS DATE) FROM {supplier} WHERE s_suppkey % 10 = 0
        UNION ALL SELECT s_suppkey, 100 + 2 * s_nationkey + s_suppkey % 2, 'national', 9, DATE '1994-01-01', CAST(NULL AS DATE) FROM {supplier}""",
    "government": """SELECT DISTINCT subject_id, CASE WHEN subject_id % 3 = 0 THEN '1996' ELSE '1998 (Oct)' END AS year_from, CASE WHEN subject_id % 3 = 0 THEN '1998' END AS year_to
        FROM (SELECT 100 + 2 * s_nationkey + s_suppkey % 2 AS subject_id FROM {supplier}) s WHERE subject_id % 3 IN (0, 1)""",
    "indicators": """SELECT CASE year % 3 WHEN 0 THEN 'income' WHEN 1 THEN 'income' ELSE 'income' END AS name, n_name AS country, year,
        CASE WHEN (n_nationkey + year) % 4 = 0 OR n_nationkey = 24 THEN NULL ELSE value END AS value
        FROM (SELECT n_nationkey, n_name, year(o_orderdate) AS year, avg(o_totalprice) AS value FROM {orders}
        JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name, year(o_orderdate)) y""",
}
MODEL["indicators"] = MODEL["indicators"].replace("CASE year % 3 WHEN 0 THEN 'income' WHEN 1 THEN 'income' ELSE 'income' END AS name", "'income' AS name")
SOURCES = ("supplier", "nation", "part", "lineitem", "orders", "customer")


@dataclass
class Model:
    """The model tables; any set of DataFrames with these columns will do.

    prepared: gives the votes of groups from tables made before, see plans/prepared.py; without it they are joined anew.
    """

    members: DataFrame
    votes: DataFrame
    sessions: DataFrame
    terms: DataFrame
    member_votes: DataFrame
    memberships: DataFrame
    government: DataFrame
    indicators: DataFrame
    prepared: Callable[[], DataFrame] | None = None


def from_orders(spark: SparkSession, sf_dir: str) -> Model:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCES}
    return Model(**{k: spark.sql(q, **{t: d for t, d in tables.items() if "{" + t + "}" in q}) for k, q in MODEL.items()})


#: Shared steps of the SQL twins, after the model tables.
STEPS = {
    "term_votes": "SELECT v.*, s.term, s.day FROM votes v JOIN sessions s USING (session_id) WHERE v.valid IS NOT FALSE",
    "group_at": "SELECT DISTINCT s.session_id, m.member_id, m.subject_id FROM sessions s JOIN memberships m ON s.day BETWEEN m.d_from AND coalesce(m.d_to, DATE '9999-12-31') WHERE m.kind = 'group'",
    "national_at": "SELECT DISTINCT s.session_id, m.member_id, m.subject_id FROM sessions s JOIN memberships m ON s.day BETWEEN m.d_from AND coalesce(m.d_to, DATE '9999-12-31') WHERE m.kind <> 'group'",
    "cast_votes": "SELECT v.*, mv.member_id, mv.option FROM member_votes mv JOIN term_votes v USING (vote_id) WHERE mv.option IN (1, 2, 3)",
    "group_votes": "SELECT c.*, g.subject_id FROM cast_votes c JOIN group_at g USING (session_id, member_id)",
    "plurality": """SELECT vote_id, subject_id, CAST(min(option) AS INT) AS plurality FROM (SELECT vote_id, subject_id, option, n, max(n) OVER (PARTITION BY vote_id, subject_id) AS top
        FROM (SELECT vote_id, subject_id, option, count(*) AS n FROM group_votes WHERE procedural IS NOT TRUE GROUP BY vote_id, subject_id, option) a) b WHERE n = top GROUP BY vote_id, subject_id""",
    "loyalty": """SELECT g.member_id, g.subject_id, g.term, count(*) AS total, count(*) FILTER (WHERE g.option = p.plurality) AS loyal
        FROM group_votes g JOIN plurality p USING (vote_id, subject_id) WHERE g.procedural IS NOT TRUE GROUP BY g.member_id, g.subject_id, g.term""",
    "attendance": """SELECT DISTINCT v.session_id, mv.member_id, 'present' AS status FROM member_votes mv JOIN votes v USING (vote_id)
        UNION ALL SELECT DISTINCT s.session_id, m.member_id, 'absent' FROM sessions s JOIN memberships m ON s.day BETWEEN m.d_from AND coalesce(m.d_to, DATE '9999-12-31')
        WHERE NOT EXISTS (SELECT 1 FROM member_votes mv JOIN votes v USING (vote_id) WHERE v.session_id = s.session_id AND mv.member_id = m.member_id)""",
    "member_stats": "SELECT c.term, c.member_id, g.subject_id, c.option, count(*) AS n FROM cast_votes c LEFT JOIN group_at g USING (session_id, member_id) GROUP BY ALL",
    "session_cohesion": """SELECT session_id, subject_id, y, n, a, (greatest(y, n, a) - 0.5 * (y + n + a - greatest(y, n, a))) / (y + n + a) * 100 AS cohesion
        FROM (SELECT session_id, subject_id, CAST(count(*) FILTER (WHERE option = 1) AS DOUBLE) AS y, CAST(count(*) FILTER (WHERE option = 2) AS DOUBLE) AS n,
        CAST(count(*) FILTER (WHERE option = 3) AS DOUBLE) AS a FROM group_votes GROUP BY session_id, subject_id) x""",
    "party_topic": """SELECT c.term, n.subject_id AS party, c.topic, count(*) AS n, avg(CASE WHEN option = 1 THEN 1.0::DOUBLE ELSE 0.0 END) AS share
        FROM cast_votes c JOIN national_at n USING (session_id, member_id) WHERE topic IS NOT NULL AND procedural IS NOT TRUE GROUP BY ALL HAVING count(*) >= 5""",
    "party_group": """SELECT term, party, grp FROM (SELECT *, row_number() OVER (PARTITION BY term, party ORDER BY n DESC, grp) AS r FROM (
        SELECT t.term, a.subject_id AS party, b.subject_id AS grp, count(DISTINCT a.member_id) AS n FROM memberships a JOIN memberships b ON a.member_id = b.member_id
        AND a.kind <> 'group' AND b.kind = 'group' AND a.d_from <= coalesce(b.d_to, DATE '9999-12-31') AND b.d_from <= coalesce(a.d_to, DATE '9999-12-31')
        JOIN terms t ON a.d_from <= coalesce(t.d_to, DATE '9999-12-31') AND t.d_from <= coalesce(a.d_to, DATE '9999-12-31')
        AND b.d_from <= coalesce(t.d_to, DATE '9999-12-31') AND t.d_from <= coalesce(b.d_to, DATE '9999-12-31') GROUP BY ALL) x) y WHERE r = 1""",
    "vote_items": """SELECT DISTINCT vote_id, CAST(subject_id AS VARCHAR) || ':' || CASE plurality WHEN 1 THEN 'FOR' WHEN 2 THEN 'AGAINST' ELSE 'ABSTAIN' END AS item
        FROM plurality JOIN term_votes USING (vote_id) WHERE final IS TRUE""",
    "country_topic": """SELECT term, topic, country, count(*) AS n, avg(CASE WHEN option = 1 THEN 1.0::DOUBLE ELSE 0.0 END) AS share FROM cast_votes JOIN members USING (member_id)
        WHERE final IS TRUE AND topic IS NOT NULL AND procedural IS NOT TRUE GROUP BY ALL""",
}


def twin(sql: str) -> str:
    """A whole DuckDB statement: the model tables and steps that `sql` needs, then `sql`."""
    import re

    found = {**{k: re.sub(r"\{(\w+)\}", r"\1", q) for k, q in MODEL.items()}, **STEPS}
    names, more = [], [sql]
    while more:
        text = more.pop()
        for k, q in found.items():
            if k not in names and re.search(rf"\b(FROM|JOIN)\s+{k}\b", text):
                names.append(k)
                more.append(q)
    order = [k for k in found if k in names]
    return f"WITH {', '.join(f'{k} AS ({found[k]})' for k in order)} {sql}" if order else sql
