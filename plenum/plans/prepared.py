"""Tables that analyses share: the votes of groups, made once, kept by term, remade only where a term's input changed."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation

from plenum.operators import rollcall as rc
from plenum.plans.model import SOURCES, Model, from_orders
from plenum.session import remove, shared_dir

LAYOUT = "vote_id BIGINT, session_id BIGINT, member_id BIGINT, option INT, procedural BOOLEAN, final BOOLEAN, topic STRING, day DATE, subject_id BIGINT, plurality INT, term INT"
COLUMNS = [c.split()[0] for c in LAYOUT.split(", ")]


def fingerprints(m: Model) -> DataFrame:
    """term, n, hash: number and sum of the hashes of the input rows of a term, its cast votes and the affiliations on its session days."""
    row = lambda df: F.xxhash64(*(c for c in df.columns if c != "term")).cast("decimal(38,0)")
    at = rc.affiliation(m).join(m.sessions.select("session_id", "term"), "session_id")
    parts = [df.groupBy("term").agg(F.count("*").alias("n"), F.sum(row(df)).alias("hash")) for df in (rc.cast_votes(m), at)]
    return parts[0].unionByName(parts[1]).groupBy("term").agg(F.sum("n").alias("n"), F.sum("hash").cast("decimal(38,0)").alias("hash"))


class Prepared:
    """The table at `path`, partitioned by term and bucketed by vote; counts: rows of each step of the last refresh."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.counts = spark, path, {}
        buckets = spark.conf.get("spark.sql.shuffle.partitions")
        self.table = "prepared_" + hashlib.sha256(f"{path} {buckets}".encode()).hexdigest()[:16]
        self.data, self.known = f"{path}/votes-{buckets}", f"{path}/known-{buckets}"
        if not spark.catalog.tableExists(self.table):
            spark.sql(f"CREATE TABLE {self.table} ({LAYOUT}) USING parquet PARTITIONED BY (term) CLUSTERED BY (vote_id) INTO {buckets} BUCKETS LOCATION '{self.data}'")
            if self.there():  # made by another session
                spark.sql(f"ALTER TABLE {self.table} RECOVER PARTITIONS")

    def there(self) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.known)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def refresh(self, m: Model) -> DataFrame:
        """term, remade: bring the table up to date with the model; terms with the same fingerprint are not touched.

        A changed term is replaced as a whole, one that is gone is removed. The fingerprints are
        written last: a refresh that breaks off is done again by the next.
        """
        new = {r["term"]: (r["n"], r["hash"]) for r in fingerprints(m).collect()}  # a row a term
        old = {r["term"]: (r["n"], r["hash"]) for r in self.spark.read.parquet(self.known).collect()} if self.there() else {}
        changed = sorted(t for t in new if new[t] != old.get(t))
        for term in sorted(set(old) - set(new)):
            self.spark.sql(f"ALTER TABLE {self.table} DROP IF EXISTS PARTITION (term = {term})")
            remove(self.spark, f"{self.data}/term={term}")
        self.counts = {}
        if changed:
            self.write(m, changed)
        if changed or set(old) - set(new):
            kept = self.spark.createDataFrame([(t, *v) for t, v in sorted(new.items())], "term int, n long, hash decimal(38,0)")
            kept.coalesce(1).write.mode("overwrite").parquet(self.known)
        return self.spark.createDataFrame([(t, t in changed) for t in sorted(new)], "term int, remade boolean")

    def write(self, m: Model, terms: list[int]) -> None:
        """Replace the partitions of these terms; rows are counted in the pass that writes them."""
        seen = {name: Observation(name) for name in ("read", "cast", "with_group", "written")}
        counted = lambda df, name: df.observe(seen[name], F.count(F.lit(1)).alias("n"))
        wanted = m.sessions.where(F.col("term").isin(terms))
        few = Model(m.members, m.votes, wanted, m.terms, counted(m.member_votes, "read"), m.memberships, m.government, m.indicators)
        votes = counted(rc.with_subject(counted(rc.cast_votes(few), "cast"), rc.affiliation(few)), "with_group")
        votes = votes.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "vote_id")  # the buckets; the window below needs no other
        rows = counted(rc.with_plurality(votes).select(COLUMNS), "written")
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(mode)
        self.spark.conf.set(mode, "dynamic")
        try:
            rows.write.mode("overwrite").insertInto(self.table)
        finally:
            self.spark.conf.set(mode, before)
        self.counts = {name: o.get["n"] for name, o in seen.items()}

    def votes(self) -> DataFrame:
        return self.spark.table(self.table)


def listing(spark: SparkSession, sf_dir: str) -> str:
    """Names, sizes and times of the input files: while they stay, nothing needs to be looked at."""
    found = []
    for name in SOURCES:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = place.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(place, True)
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def model(spark: SparkSession, sf_dir: str) -> Model:
    """The model over the order tables; its votes of groups come from the table prepared for them, made or refreshed if the input files changed."""
    m = from_orders(spark, sf_dir)

    def votes() -> DataFrame:
        own = Prepared(spark, f"{shared_dir(spark)}/prepared-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}")
        now, context = listing(spark, sf_dir), spark.sparkContext
        fresh = context.__dict__.setdefault("_plenum_prepared", {})
        if fresh.get(own.table) != now or not own.there():
            own.refresh(from_orders(spark, sf_dir))
            fresh[own.table] = now
        return own.votes()

    m.prepared = votes
    return m
