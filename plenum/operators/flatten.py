"""Landed documents to rows of the model: walks over nested fields, followed ids, rows by kind of document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions import text as tx


def walked(rows: DataFrame, *steps) -> DataFrame:
    """Steps (DataFrame to DataFrame) one after the other; none: the rows as they are."""
    return reduce(lambda df, step: df.transform(step), steps, rows)


def first_of(*paths: str | Column) -> Column:
    """The first value of several paths that is not null; null if none is there."""
    return F.coalesce(*paths)


def leaves(rows: DataFrame, doc: str, path: str) -> DataFrame:
    """One row with `leaf` for each value at `path` of a JSON text; `*` goes over a list or an object."""
    out = rows.withColumn("leaf", F.col(doc))
    for step in path.split("/"):
        if step == "*":
            values = F.coalesce(F.from_json("leaf", "array<string>"), F.map_values(F.from_json("leaf", "map<string,string>")))
            out = out.withColumn("leaf", F.explode(F.filter(values, lambda x: x.isNotNull())))
        else:
            out = out.withColumn("leaf", F.get_json_object("leaf", f"$.{step}"))
    return out.where("leaf IS NOT NULL")


def nested(array: str | Column, keep, **fields) -> Column:
    """A list of structs: the children for which keep(child) holds, each with fields(child) by name."""
    return F.transform(F.filter(array, keep), lambda x: F.struct(*(f(x).alias(n) for n, f in fields.items())))


def followed(rows: DataFrame, key: str, ids: str, documents: DataFrame, alias: str) -> DataFrame:
    """rows(key, ids) with the documents(id, ...) that the ids name as a list of structs; unknown ids give none."""
    each = rows.select(key, F.explode(F.array_distinct(ids)).alias("id")).join(documents, "id")
    found = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*documents.columns))).alias(alias))
    return rows.join(found, key, "left")


def term_rows(docs: DataFrame) -> DataFrame:
    """docs(uri, classes, d_from, d_to) of parliamentary terms: term, d_from, d_to."""
    terms = docs.where(F.array_contains("classes", "ParliamentaryTerm")).select(tx.digits(tx.basename(F.col("uri"))).alias("term"), "d_from", "d_to")
    return terms.where("term IS NOT NULL AND d_from IS NOT NULL")


def subject_rows(*classes: tuple[str, DataFrame]) -> DataFrame:
    """docs(id, label, label_en, represented) of several classes, first class first: one row an id.

    name: the English label, else the label; country: the end of the first URI represented.
    """
    tagged = [d.select("id", F.lit(k).alias("k"), F.lit(kind).alias("typ"), "label", first_of("label_en", "label").alias("name"), tx.basename(F.get("represented", 0)).alias("country")) for k, (kind, d) in enumerate(classes)]
    every = reduce(DataFrame.unionByName, tagged)
    best = every.groupBy("id").agg(F.min_by(F.struct("typ", "label", "name", "country"), F.struct("k", "label", "name")).alias("s"))
    return best.select("id", "s.*")


def membership_rows(docs: DataFrame, aliases: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """docs(member_id, memberships) to member_id, subject_id, kind, d_from, d_to.

    memberships: structs of org, cls, d_from, d_to; classes not in `kinds` go, and organisations
    that aliases(ep_id, subject_id) does not know.
    """
    each = docs.select("member_id", F.explode("memberships").alias("s")).select("member_id", "s.*")
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), F.col("cls"))
    return each.withColumn("kind", kind).where("kind IS NOT NULL").join(aliases, F.col("org") == F.col("ep_id")).select("member_id", "subject_id", "kind", "d_from", "d_to")


def session_rows(docs: DataFrame) -> DataFrame:
    """docs(session_id, type, day): plenary sittings alone."""
    return docs.where(tx.basename(F.col("type")) == "PLENARY_SITTING").select("session_id", "day")


def attendance_rows(docs: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs(session_id, excused, present) to session_id, member_id, status (4, 1); and the number of ids that no member has, by session."""
    each = docs.select("session_id", F.explode(F.array(F.struct(F.lit(4).alias("status"), F.col("excused").alias("ids")), F.struct(F.lit(1).alias("status"), F.col("present").alias("ids")))).alias("s"))
    each = each.select("session_id", "s.status", F.explode("s.ids").alias("ep_id"))
    known = members.select("ep_id", "member_id")
    return each.join(known, "ep_id").select("session_id", "member_id", "status"), each.join(known, "ep_id", "left_anti").groupBy("session_id").agg(F.count("*").alias("unknown"))


def vote_fields(docs: DataFrame) -> DataFrame:
    """docs(vote_id, title, activity_title, outcome, method, attendees, n_for, n_against, n_abstain) to the vote's row.

    outcome: the end of its URI; secret by the method; not_voted: attendees less those who voted,
    null without attendees.
    """
    voted = F.col("n_for") + F.col("n_against") + F.col("n_abstain")
    return docs.select("vote_id", first_of("title", "activity_title").alias("title"), tx.basename(F.col("outcome")).alias("outcome"), F.coalesce(F.contains(F.lower("method"), F.lit("secret")), F.lit(False)).alias("secret"), (F.col("attendees") - voted).alias("not_voted"))


def by_dimensions(rows: DataFrame, wanted: dict[str, str], country: str = "geo", countries: list[str] | None = None) -> DataFrame:
    """Rows with the wanted value in each dimension that the table has, of the countries named."""
    for column, value in wanted.items():
        if column in rows.columns:
            rows = rows.where(F.col(column) == value)
    return rows.where(F.col(country).isin(countries)) if countries is not None else rows


def geo_named(rows: DataFrame) -> DataFrame:
    """The column of countries under its one name."""
    for old in ("geo\\TIME_PERIOD", "geo\\time"):
        rows = rows.withColumnRenamed(old, "geo")
    return rows


def acronym_links(groups: DataFrame, entities: DataFrame) -> DataFrame:
    """groups(id, acronym) with wiki_id and colour of entities(no, acronym, item, colour): of equal acronyms the first; colours without #."""
    key = lambda c: F.lower(F.trim(c))
    known = entities.where("trim(acronym) <> '' AND item IS NOT NULL").groupBy(key("acronym").alias("k"))
    known = known.agg(F.min_by(F.struct(tx.basename(F.col("item")).alias("wiki_id"), F.nullif(F.ltrim("colour", F.lit("#")), F.lit("")).alias("colour")), "no").alias("e"))
    return groups.join(known, key("acronym") == F.col("k"), "left").select("id", "acronym", "e.wiki_id", "e.colour")


def terms_with_results(terms: DataFrame, results: DataFrame) -> DataFrame:
    """Terms that have results, numbered from 0 by their start."""
    from pyspark.sql.window import Window

    found = terms.join(results.select("term").distinct(), "term", "left_semi")
    return found.withColumn("ordinal", F.row_number().over(Window.orderBy("d_from", "term")) - 1)  # a row a term
