"""Scores of extraction records: truth and extracted parties paired, counted, averaged, reported."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions import text as tx
from plenum.operators.matching import f_score
from plenum.operators.resample import bootstrap
from plenum.session import saved

RECORD = ["country", "year"]


def named(parties: DataFrame, name: str = "name", abbreviation: str | None = None) -> DataFrame:
    """parties with `plain` (normal form of the name, without parentheses), `aliases` (that, those of its parentheses and of the abbreviation) and `words` (those of plain and abbreviation)."""
    more = [F.col(abbreviation)] if abbreviation else []
    out = parties.withColumn("plain", F.coalesce(tx.ascii_name(F.col(name)), F.lit(""))).withColumn("aliases", tx.aliases(F.col(name), *more))
    said = F.concat_ws(" ", "plain", *(tx.ascii_name(c) for c in more))
    return out.withColumn("words", F.array_distinct(F.split(said, " ")))


def paired(truth: DataFrame, extracted: DataFrame) -> DataFrame:
    """One-to-one pairs t, x (places) of a record's parties(country, year, pos, plain, aliases).

    Truth parties choose in their order, each by all its means before the next: a common name or
    alias (its own in order, of each the first free extracted party that has it), else a word of
    three letters or more: one of its aliases among the words of an extracted name, or an extracted
    name among the words of its own name and abbreviation, if one free party alone qualifies. A
    record is a handful of parties, so it is one row; a task pairs those of a batch in one call.
    """
    of = lambda df, name: df.select(*RECORD, F.struct("pos", "plain", "aliases", "words").alias(name))
    both = of(truth, "t").unionByName(of(extracted, "x"), allowMissingColumns=True)
    records = both.groupBy(RECORD).agg(F.collect_list("t").alias("t"), F.collect_list("x").alias("x")).where("size(t) > 0 AND size(x) > 0")
    kinds = {f.name: f.dataType.simpleString() for f in truth.schema}
    ddl = f"country {kinds['country']}, year {kinds['year']}, t {kinds['pos']}, x {kinds['pos']}"

    def pair(batches):
        for batch in batches:
            out = {c: [] for c in (*RECORD, "t", "x")}
            for r in batch.to_pylist():
                for t, x in pairs_of(r["t"], r["x"]):
                    for c, v in zip(out, (r["country"], r["year"], t, x)):
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, batch.schema.field(c).type if c in RECORD else batch.schema.field(c).type.value_type.field("pos").type) for c, v in out.items()], names=list(out))

    return records.mapInArrow(pair, ddl)


def pairs_of(truth: list[dict], extracted: list[dict]) -> list[tuple]:
    """The places of the pairs of one record, see `paired`."""
    in_order = lambda rows: sorted(rows, key=lambda r: (r["pos"] is None, r["pos"]))
    free = {r["pos"]: (r["plain"], r["aliases"]) for r in in_order(extracted)}
    out = []
    for t in in_order(truth):
        own = t["aliases"]
        hit = next((k for name in own for k, (_, others) in free.items() if name in others), None)
        if hit is None:
            words = set(t["words"])
            single = [x for x in own if " " not in x and len(x) >= 3]
            near = [k for k, (plain, _) in free.items() if any(x in plain.split() for x in single) or (" " not in plain and len(plain) >= 3 and plain in words)]
            hit = near[0] if len(near) == 1 else None
        if hit is not None:
            out.append((t["pos"], hit))
            del free[hit]
    return out


def ratio(a: str, b: Column) -> Column:
    return F.try_divide(F.col(a).cast("double"), b)


def record_scores(truth: DataFrame, extracted: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of each record: tp, fp, fn, strict, seat and government accuracy, precision, recall and F1 of both.

    A pair is strict if the seats are equal and the government is not wrong; a government that
    either side leaves out is not evaluated. Ratios without a denominator are null.
    """
    one = truth.select(*RECORD, F.col("pos").alias("t"), F.col("seats").alias("t_seats"), F.col("in_government").alias("t_gov"))
    two = extracted.select(*RECORD, F.col("pos").alias("x"), F.col("seats").alias("x_seats"), F.col("in_government").alias("x_gov"))
    both = pairs.join(one, [*RECORD, "t"]).join(two, [*RECORD, "x"])
    seats, gov = F.col("t_seats").eqNullSafe(F.col("x_seats")), F.col("t_gov") == F.col("x_gov")
    counts = both.groupBy(RECORD).agg(F.count("*").alias("tp"), F.count_if(seats).alias("seats_ok"), F.count_if(gov).alias("gov_ok"), F.count(gov).alias("gov_known"), F.count_if(seats & F.coalesce(gov, F.lit(True))).alias("strict"))
    sizes = truth.groupBy(RECORD).agg(F.count("*").alias("n_truth")).join(extracted.groupBy(RECORD).agg(F.count("*").alias("n_extracted")), RECORD, "full").join(counts, RECORD, "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_truth", "n_extracted", "tp", "strict", "seats_ok", "gov_ok", "gov_known")]
    out = sizes.select(*RECORD, *zero).withColumn("fp", F.col("n_extracted") - F.col("tp")).withColumn("fn", F.col("n_truth") - F.col("tp"))
    for c, name in (("tp", "existence"), ("strict", "strict")):
        p, r = ratio(c, F.col("n_extracted")), ratio(c, F.col("n_truth"))
        out = out.withColumn(f"{name}_precision", p).withColumn(f"{name}_recall", r).withColumn(f"{name}_f1", f_score(p, r))
    return out.withColumn("seat_accuracy", ratio("seats_ok", F.col("tp"))).withColumn("government_accuracy", ratio("gov_ok", F.col("gov_known"))).drop("n_truth", "n_extracted", "seats_ok", "gov_ok", "gov_known")


RATIOS = ["existence_f1", "strict_f1", "seat_accuracy", "government_accuracy"]


def macro(records: DataFrame, *by: str) -> DataFrame:
    """Sums of the counts and means of the ratios, records without a ratio left out of its mean."""
    return records.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "strict")), *(F.round(F.avg(c), 4).alias(c) for c in RATIOS))


def with_logs(truth: DataFrame, logs: DataFrame) -> DataFrame:
    """Truth records with the log of their country and year, null where there is none."""
    return truth.join(logs, RECORD, "left")


def source_rates(records: DataFrame, *by: str) -> DataFrame:
    """records(found_url, truth_url): share of records with a source, and with the truth's own page among those that have one."""
    flags = records.withColumn("found", F.col("found_url").isNotNull()).withColumn("same", tx.slug(F.col("found_url")) == tx.slug(F.col("truth_url")))
    return flags.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(F.col("found").cast("double")), 4).alias("found_rate"), F.round(F.avg(F.col("same").cast("double")), 4).alias("same_rate"))


def first_attempts(parties: DataFrame, attempts: DataFrame) -> DataFrame:
    """parties(key, url, name) with the number of the first of attempts(no, url, name) of the same URL (none: no URL) or the same normal form of the name (no name: empty)."""
    by_url = parties.select("key", "url").join(attempts.where("url <> ''").groupBy("url").agg(F.min("no").alias("no")), "url").select("key", "no")
    plain = lambda d: d.withColumn("plain", F.coalesce(tx.ascii_name(F.col("name")), F.lit("")))
    firsts = plain(attempts).groupBy("plain").agg(F.min("no").alias("no"))
    by_name = plain(parties).select("key", "plain").join(firsts, "plain").select("key", "no")
    return parties.select("key").join(by_url.union(by_name).groupBy("key").agg(F.min("no").alias("no")), "key", "left")


def intervals(records: DataFrame, n_boot: int = 10_000, *key: str) -> DataFrame:
    """Bootstrap interval of F1 of each mode of records(mode, key..., tp, fp, fn), over the records that all modes have."""
    key, records = key or tuple(RECORD), saved(records, "records")
    n = records.select("mode").distinct().count()
    common = records.groupBy(*key).agg(F.count_distinct("mode").alias("n")).where(F.col("n") == n).select(*key)
    return bootstrap(records.join(common, list(key), "left_semi"), n_boot, 42, "mode", key=key)


def write_report(records: DataFrame, path: str) -> None:
    """Three JSON folders: overall, countries, records."""
    for name, part in (("overall", macro(records)), ("countries", macro(records, "country")), ("records", records)):
        part.write.mode("overwrite").json(f"{path}/{name}")
