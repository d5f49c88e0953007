"""Matching of party names, scores of extraction runs, bootstrap intervals, comparison of results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window



def cascade(parties: DataFrame, registry: DataFrame) -> DataFrame:
    """parties(key, wiki_id, full, short) to registry(id, wiki_id, name): by wiki id, full name, abbreviation, with the method; of equal names the last id."""
    wiki = registry.where("wiki_id IS NOT NULL").groupBy("wiki_id").agg(F.max("id").alias("w"))
    names = registry.groupBy(F.lower("name").alias("n")).agg(F.max("id").alias("i"))
    out = parties.join(wiki, "wiki_id", "left")
    for c in ("full", "short"):
        out = out.join(names.select(F.col("n").alias(f"n_{c}"), F.col("i").alias(f"i_{c}")), F.lower(c) == F.col(f"n_{c}"), "left")
    method = F.when(F.col("w").isNotNull(), "wiki_id").when(F.col("i_full").isNotNull(), "full_name").when(F.col("i_short").isNotNull(), "abbreviation").otherwise("none")
    return out.select("key", F.coalesce("w", "i_full", "i_short").alias("id"), method.alias("method"))


def clusters(bodies: DataFrame) -> DataFrame:
    """Registry bodies(country, label, id) by country and label: sorted ids."""
    return bodies.groupBy("country", "label").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def word_index(strings: DataFrame) -> DataFrame:
    """strings(country, label, term) to country, term, n (bodies that have it) and the one body if it is one."""
    return strings.distinct().groupBy("country", "term").agg(F.count("*").alias("n"), F.min("label").alias("one"))


def registry_match(parties: DataFrame, groups: DataFrame) -> DataFrame:
    """parties(key, country, aliases) to groups(country, label, aliases), all in normal form, within a country.

    A body that shares an alias (exact_alias); else one of which an alias holds the word of a
    one-word alias of the party, or that has a one-word alias among the words of the party's
    (token_containment; words of two letters or more). Several bodies: ambiguous; none: no_match.
    Bodies of one country and label are one.

    Aliases and words are looked up in an index that says of each how many bodies have it and, if
    one, which: there is never a row for a pair of party and body, however common a word.
    """
    alias = groups.select("country", "label", F.explode("aliases").alias("term"))
    single = lambda c: ~F.contains(c, F.lit(" ")) & (F.length(c) >= 2)
    parts = alias.select("country", "label", F.explode(F.split("term", " ")).alias("term"))
    index = word_index(alias).select("country", F.lit("alias").alias("kind"), "term", "n", "one")
    index = index.union(word_index(parts).select("country", F.lit("holds"), "term", "n", "one"))
    index = index.union(word_index(alias.where(single(F.col("term")))).select("country", F.lit("held"), "term", "n", "one"))
    own = parties.select("key", "country", F.explode("aliases").alias("term"))
    asks = own.select("key", "country", F.lit("alias").alias("kind"), "term")
    asks = asks.union(own.where(single(F.col("term"))).select("key", "country", F.lit("holds"), "term"))
    asks = asks.union(own.select("key", "country", F.lit("held"), F.explode(F.split("term", " ")))).distinct()
    met = asks.join(index, ["country", "kind", "term"]).withColumn("exact", F.col("kind") == "alias")
    by = met.groupBy("key").agg(
        *(F.max(F.when(c, F.col("n"))).alias(f"n_{k}") for k, c in (("e", F.col("exact")), ("p", ~F.col("exact")))),
        *(F.collect_set(F.when(c & (F.col("n") == 1), F.col("one"))).alias(k) for k, c in (("e", F.col("exact")), ("p", ~F.col("exact")))),
    )  # as many labels as the party has words, at most
    by = parties.select("key").distinct().join(by, "key", "left")
    kind = F.when(F.col("n_e").isNotNull(), "e").when(F.col("n_p").isNotNull(), "p")
    found, most = F.when(kind == "e", F.col("e")).otherwise(F.col("p")), F.when(kind == "e", F.col("n_e")).otherwise(F.col("n_p"))
    one = (most == 1) & (F.size(found) == 1)
    method = F.when(kind.isNull(), "no_match").when(~one, "ambiguous").when(kind == "e", "exact_alias").otherwise("token_containment")
    return by.select("key", F.when(one, found[0]).alias("label"), method.alias("method"))


def with_overrides(matches: DataFrame, reviewed: DataFrame) -> DataFrame:
    """reviewed(key, label, method) wins."""
    r = reviewed.select("key", F.col("label").alias("r_label"), F.col("method").alias("r_method"))
    return matches.join(r, "key", "left").select("key", F.coalesce("r_label", "label").alias("label"), F.coalesce("r_method", "method").alias("method"))


def second_pass(matches: DataFrame, parties: DataFrame, groups: DataFrame, more: DataFrame) -> DataFrame:
    """Parties that registry_match left ambiguous or without a match, tried again with more(key, aliases); the method says so."""
    open_ = matches.where("method IN ('ambiguous', 'no_match')").select("key")
    extra = more.select("key", F.col("aliases").alias("extra"))
    wider = parties.join(open_, "key").join(extra, "key").select("key", "country", F.array_distinct(F.concat("aliases", "extra")).alias("aliases"))
    again = registry_match(wider, groups).where("label IS NOT NULL").select("key", F.col("label").alias("found"), F.concat("method", F.lit("+aliases")).alias("how"))
    return matches.join(again, "key", "left").select("key", F.coalesce("found", "label").alias("label"), F.coalesce("how", "method").alias("method"))


def outcomes(matches: DataFrame) -> DataFrame:
    """Number and share of parties by method, each key once."""
    n = matches.groupBy("key").agg(F.min("method").alias("method")).groupBy("method").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))  # a row a method


def f_score(p, r):
    return F.when(p.isNull() | r.isNull(), None).when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def scores(records: DataFrame, *by: str) -> DataFrame:
    """records(tp, fp, fn, strict) to precision, recall, F1, existing and strict, from the sums."""
    s = records.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "strict")))
    p, r = (lambda c: F.try_divide(F.col(c), F.col("tp") + F.col("fp"))), (lambda c: F.try_divide(F.col(c), F.col("tp") + F.col("fn")))
    for c in ("tp", "strict"):
        s = s.withColumn(f"precision_{c}", F.round(p(c), 4)).withColumn(f"recall_{c}", F.round(r(c), 4)).withColumn(f"f1_{c}", F.round(f_score(p(c), r(c)), 4))
    return s


def differences(actual: DataFrame, expected: DataFrame, *key: str, tolerance: float = 0.01) -> DataFrame:
    """Keys that one side lacks or whose expected columns differ by more than the tolerance."""
    rest = [c for c in expected.columns if c not in key]
    a = actual.select(*key, *(F.col(c).alias(f"a_{c}") for c in rest), F.lit(True).alias("a_"))
    e = expected.select(*key, *(F.col(c).alias(f"e_{c}") for c in rest), F.lit(True).alias("e_"))
    number = {c for c, t in expected.dtypes if t in ("double", "float", "int", "bigint")}
    same = reduce(lambda x, y: x & y, ((F.abs(F.col(f"a_{c}") - F.col(f"e_{c}")) <= tolerance) if c in number else F.col(f"a_{c}").eqNullSafe(F.col(f"e_{c}")) for c in rest), F.lit(True))
    return a.join(e, list(key), "full").where(F.col("a_").isNull() | F.col("e_").isNull() | ~F.coalesce(same, F.lit(False)))


def valid_extraction(rows: DataFrame, column: str) -> DataFrame:
    """Is the JSON a list of objects with name, seats and government?"""
    parsed = F.from_json(column, "ARRAY<STRUCT<party_name: STRING, seats: INT, in_government: BOOLEAN>>", {"mode": "PERMISSIVE"})
    whole = F.forall(parsed, lambda x: x["party_name"].isNotNull() & x["seats"].isNotNull() & x["in_government"].isNotNull())
    return rows.withColumn("schema_valid", F.coalesce(whole & F.startswith(F.ltrim(column), F.lit("[")), F.lit(False)))
