"""Landed files in, tables out: CSV dumps, nested JSON, upserts and replacements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VOTES = "id LONG, timestamp STRING, display_title STRING, count_for LONG, count_against LONG, count_abstention LONG, count_did_not_vote LONG, procedure_reference STRING, texts_adopted_reference STRING, is_main STRING, procedure_type STRING, procedure_title STRING"
MEMBER_VOTES = "vote_id LONG, member_id LONG, position STRING"


def read_votes(spark: SparkSession, path: str) -> DataFrame:
    """Votes dump, plain or gzip; titles may hold quotes (doubled), commas and line ends."""
    return spark.read.schema(VOTES).option("header", True).option("escape", "\"").option("multiLine", True).csv(path)


def read_member_votes(spark: SparkSession, path: str) -> DataFrame:
    """Member votes dump; a gzip file is one task, so rows are dealt out by vote."""
    return spark.read.schema(MEMBER_VOTES).option("header", True).csv(path).repartition("vote_id")


def read_envelope(spark: SparkSession, path: str, schema: str, field: str = "data") -> DataFrame:
    """Rows of the array `field` in JSON documents; schema: that of a row."""
    return spark.read.schema(f"{field} ARRAY<STRUCT<{schema}>>").json(path, multiLine=True).select(F.explode(field).alias("r")).select("r.*")


def read_bindings(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """Query results as strings, missing ones empty."""
    schema = f"results STRUCT<bindings: ARRAY<STRUCT<{', '.join(f'{n}: STRUCT<value: STRING>' for n in names)}>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("results.bindings").alias("b"))
    return rows.select(*(F.coalesce(F.col(f"b.{n}.value"), F.lit("")).alias(n) for n in names))


def read_arrays(spark: SparkSession, path: str, schema: str, needed: str | None = None) -> DataFrame:
    """JSON arrays of records, with the file of each; records whose field `needed` is no list (a note that they are to be done) are passed over."""
    rows = spark.read.schema(schema).json(path, multiLine=True).withColumn("file", F.input_file_name())
    return rows.where(F.col(needed).isNotNull()) if needed else rows


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated file whose first column holds several dimensions (`freq,unit,geo\\TIME_PERIOD`), then one column a year.

    The dimensions become columns, the country's is `geo`; values lose their flags, `:` is null.
    """
    rows = spark.read.csv(path, sep="\t", header=True)
    first = rows.columns[0]
    names = [n.strip().split("\\")[0] for n in first.split(",")]
    parts = F.split(F.col(f"`{first}`"), ",")
    dims = [F.trim(F.get(parts, F.lit(k))).alias(n) for k, n in enumerate(names)]
    value = lambda c: F.regexp_extract(F.col(f"`{c}`"), r"^\s*(-?[0-9.]+)", 1).try_cast("double").alias(c.strip())
    return rows.select(*dims, *(value(c) for c in rows.columns[1:]))


def vote_rows(dump: DataFrame) -> DataFrame:
    """Outcome from the counts (null: 0), final and procedural flags, timestamp without zone."""
    n = {c: F.coalesce(f"count_{c}", F.lit(0)) for c in ("for", "against", "abstention", "did_not_vote")}
    outcome = F.when((n["for"] == 0) & (n["against"] == 0) & (n["abstention"] == 0), "LAPSED").when(n["for"] > n["against"], "ADOPTED").otherwise("REJECTED")
    return dump.select(F.col("id").alias("vote_id"), F.expr("try_to_timestamp(substr(timestamp, 1, 19))").cast("timestamp_ntz").alias("ts"), F.coalesce("display_title", "procedure_title").alias("subject_text"), outcome.alias("outcome"), n["for"].alias("n_for"), n["against"].alias("n_against"), n["abstention"].alias("n_abstain"), n["did_not_vote"].alias("n_absent"), F.coalesce(F.lower(F.trim("is_main")) == "true", F.lit(False)).alias("final"), F.col("procedure_reference").isNull().alias("procedural"), "procedure_type")


def member_vote_rows(dump: DataFrame, members: DataFrame) -> DataFrame:
    """FOR, AGAINST, ABSTENTION as 1, 2, 3; others and unknown members go. members(ep_id, member_id)."""
    option = F.when(F.col("position") == "FOR", 1).when(F.col("position") == "AGAINST", 2).when(F.col("position") == "ABSTENTION", 3)
    return dump.withColumn("option", option).where("option IS NOT NULL").withColumnRenamed("member_id", "ep_id").join(members.select("ep_id", "member_id"), "ep_id").select("vote_id", "member_id", "option")


def with_topics(votes: DataFrame, labels: DataFrame, codes: list[str]) -> DataFrame:
    """labels(vote_id, label), accepted for final votes with a procedure type and for known codes."""
    fine = F.col("final") & F.col("procedure_type").isNotNull() & F.col("label").isin(codes)
    return votes.join(labels, "vote_id", "left").withColumn("topic", F.when(fine, F.col("label"))).drop("label")


def fields(rows: DataFrame, required: dict[str, Column], optional: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Extracted fields by name; rows that lack a required one apart, as rejects."""
    out = rows.select(*(c.alias(n) for n, c in {**required, **optional}.items()))
    whole = reduce(lambda a, b: a & b, (F.col(n).isNotNull() for n in required), F.lit(True))
    return out.where(whole), out.where(~whole)


def last_is_final(rows: DataFrame, ids: str) -> DataFrame:
    """One row an id of an array; the last place is the final vote."""
    return rows.select("*", F.posexplode(ids).alias("pos", "vote_id")).withColumn("final", F.col("pos") == F.size(ids) - 1)


def voters(rows: DataFrame, favour: str, against: str, abstain: str) -> DataFrame:
    """Three arrays of voters to vote_id, member, option."""
    tagged = F.array(*(F.struct(F.lit(k).alias("option"), F.col(c).alias("who")) for k, c in ((1, favour), (2, against), (3, abstain))))
    return rows.select("vote_id", F.explode(tagged).alias("t")).select("vote_id", "t.option", F.explode("t.who").alias("member"))


def children(rows: DataFrame, key: str, array: str) -> DataFrame:
    """A child table from a nested array, with its parent's key."""
    return rows.select(key, F.explode(array).alias("c")).select(key, "c.*")


def years_to_rows(wide: DataFrame, key: str = "geo") -> DataFrame:
    """One column a year to one row a year; columns that are no year go."""
    years = [c for c in wide.columns if c.strip().isdigit()]
    return wide.unpivot([key], years, "year", "value").withColumn("year", F.trim("year").cast("int"))


def new_only(new: DataFrame, old: DataFrame, *key: str) -> DataFrame:
    """Rows whose key is not there yet (null keys equal each other), one a key."""
    o = old.select(*(F.col(k).alias(f"_{k}") for k in key)).distinct()
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key))
    return new.dropDuplicates(list(key)).join(o, same, "left_anti")


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """New rows replace old ones of their key; others are added."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def refresh(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Values of `new` that are not null replace those of rows that exist."""
    rest = [c for c in old.columns if c not in key]
    n = new.select(*key, *(F.col(c).alias(f"_{c}") for c in rest if c in new.columns))
    return old.join(n, list(key), "left").select(*key, *((F.coalesce(f"_{c}", c) if c in new.columns else F.col(c)).alias(c) for c in rest))


def replace_terms(df: DataFrame, path: str) -> None:
    """A derived table's terms in `df` replace what the folder holds of them; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("term").parquet(path)


def write_views(df: DataFrame, path: str, *by: str, form: str = "json") -> None:
    """One folder a view (term, member or topic, its name without blanks and slashes)."""
    safe = df.withColumns({c: F.regexp_replace(F.col(c).cast("string"), "[/ ]", "_") for c in by})
    safe.write.mode("overwrite").partitionBy(*by).format(form).save(path)


def stub_sessions(days: DataFrame, sessions: DataFrame) -> DataFrame:
    """Days without a session, one row each, with ids by their hash."""
    return days.select("day").distinct().join(sessions.select("day"), "day", "left_anti").withColumn("session_id", F.xxhash64("day"))


def name_ids(rows: DataFrame, name: str) -> DataFrame:
    """One id a name, the same in every run."""
    return rows.where(F.col(name).isNotNull()).select(name).distinct().withColumn("id", F.xxhash64(name))


def election_spells(results: DataFrame) -> DataFrame:
    """results(country, year, party, in_government) to party, year_from, year_to: up to the next election."""
    from pyspark.sql.window import Window

    years = results.where("year >= 1990").select("country", "year").distinct().withColumn("next", F.lead("year").over(Window.partitionBy("country").orderBy("year")))
    return results.where("in_government").join(years, ["country", "year"]).select("country", "party", F.col("year").alias("year_from"), F.col("next").alias("year_to")).distinct()
