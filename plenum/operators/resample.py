"""Bootstrap intervals of F1: seeded draws by hash, order statistics without a sort of all draws."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenum.session import saved

BINS = 256
SENT = 1 << 19  # records that every task may hold, some 40 MB


def numbered(rows: DataFrame, *order: str, name: str = "no") -> DataFrame:
    """rows with their place (from 0) in the order: sorted by range, places carried from partition to partition.

    The driver sees one number a partition; no task has all rows.
    """
    order = order or tuple(rows.columns)
    rows = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "sorted")
    sizes = sorted((r["part"], r["n"]) for r in rows.groupBy(F.shiftright("_id", 33).alias("part")).agg(F.count("*").alias("n")).collect())
    starts = [(part, sum(n for _, n in sizes[:k])) for k, (part, _) in enumerate(sizes)]
    offset = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part long, _start long"))  # a row a partition
    at = rows.join(offset, F.shiftright("_id", 33) == F.col("_part"))
    return at.withColumn(name, F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_part", "_start")


def draw(boot: Column, k: Column, seed: int, n: int) -> Column:
    """A number from 0 to n - 1 for each resample and place, of the MD5 of seed, resample and place: the same in every engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), boot.cast("string"), F.lit(":"), k.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % n


def draws(spark, n: int, n_boot: int, seed: int, chunk: int = 4096) -> DataFrame:
    """boot, no: n draws for each of n_boot resamples, made in chunks, as many tasks as they are millions."""
    chunks = -(-n // chunk)
    rows = spark.range(0, n_boot * chunks, 1, -(-n_boot * n // 1_000_000)).selectExpr(f"id DIV {chunks} AS boot", f"id % {chunks} * {chunk} AS k")
    rows = rows.withColumn("k", F.explode(F.sequence(F.col("k"), F.least(F.col("k") + chunk, F.lit(n)) - 1)))
    return rows.select("boot", draw(F.col("boot"), F.col("k"), seed, n).alias("no"))


def by_tag(rows: DataFrame, tags: tuple[str, ...], cols: tuple[str, ...], most: int = 16) -> tuple[DataFrame, list]:
    """rows(tags..., no, cols...) as a row for each no with columns `col_k` of the k-th tag, and the tags; (rows, []) if they are more than `most`."""
    found = [tuple(r) for r in rows.select(*tags).distinct().limit(most + 1).collect()] if tags else [()]
    if len(found) > most:
        return rows, []
    has = lambda tag: F.lit(True) if not tag else functools.reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(tags, tag)))
    wide = [F.sum(F.when(has(tag), F.col(c))).alias(f"{c}_{k}") for k, tag in enumerate(found) for c in cols]
    return rows.groupBy("no").agg(*wide), found


def resampled(rows: DataFrame, n: int, n_boot: int, seed: int) -> DataFrame:
    """boot and the columns of rows(no below n, ...): a row for each draw and row of its number.

    Spark takes the draws to be as few as the chunks they come from and would send them to all
    tasks; here the rows are sent, or, if they are more than SENT, both sides are dealt by number.
    """
    met = F.broadcast(rows) if rows.count() <= SENT else rows.hint("merge")
    return draws(rows.sparkSession, n, n_boot, seed).join(met, "no")


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2 * tp, (2 * tp + fp + fn).cast("double")), F.lit(0.0))


def order_statistics(values: DataFrame, value: str, places: list[int], *by: str) -> DataFrame:
    """by..., place, value: the values at these places (from 0) of each group's ascending order.

    Each round counts the values of the range that holds a place in 256 bins and keeps the bin, cut
    to the least and greatest value in it, until both are equal. What a round sends is a few
    numbers a group and place, never the values.
    """
    ends = values.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high")).where("low IS NOT NULL")
    state = saved(ends.select(*by, F.explode(F.array(*map(F.lit, places))).alias("place"), F.lit(0).cast("long").alias("below"), "low", "high"), "range")
    while not state.where("low < high").isEmpty():
        same = [F.col(f"v.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by]
        inside = F.col(f"v.{value}").between(F.col("s.low"), F.col("s.high"))
        met = values.select(*by, value).alias("v").join(F.broadcast(state).alias("s"), [*same, inside] if same else inside)  # groups x places rows
        width = F.col("s.high") - F.col("s.low")
        bin_ = F.when(width > 0, F.least(F.floor((F.col(f"v.{value}") - F.col("s.low")) / width * BINS), F.lit(BINS - 1))).otherwise(0)
        keys = [*(F.col(f"s.{c}").alias(c) for c in by), F.col("s.place").alias("place"), F.col("s.below").alias("below"), bin_.alias("bin")]
        bins = met.groupBy(*keys).agg(F.count("*").alias("n"), F.min(f"v.{value}").alias("low"), F.max(f"v.{value}").alias("high"))
        upto = F.sum("n").over(Window.partitionBy(*by, "place").orderBy("bin"))  # 256 rows at most
        bins = bins.withColumn("upto", F.col("below") + upto).withColumn("below", F.col("upto") - F.col("n"))
        state = saved(bins.where("below <= place AND place < upto").select(*by, "place", "below", "low", "high"), "range")
    return state.select(*by, "place", F.col("low").alias("value"))


def interval(samples: DataFrame, value: str, n_boot: int, *by: str) -> DataFrame:
    """by..., low, high: the 2.5 and 97.5 percent places of the samples."""
    low, high = int(0.025 * n_boot), int(0.975 * n_boot)
    at = order_statistics(samples, value, sorted({low, high}), *by)
    pick = lambda k: F.max(F.when(F.col("place") == k, F.col("value")))
    return at.groupBy(*by).agg(pick(low).alias("low"), pick(high).alias("high"))


def same_keys(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    if not by:
        return left.crossJoin(right)  # one row each
    both = left.alias("l").join(right.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by])
    return both.select("l.*", *(F.col(f"r.{c}") for c in right.columns if c not in by))


def bootstrap(records: DataFrame, n_boot: int = 10_000, seed: int = 42, *tags: str, matched: str = "tp", key: tuple[str, ...] = ("no",)) -> DataFrame:
    """tags..., point, low, high: F1 of records(key..., tp, fp, fn) and its 95 % interval over resampled records.

    matched: the column that counts as found, `strict` for the strict score. Every tag has the same
    draws; records are told apart by their key, of which each tag has all. No records: no row.
    """
    places = numbered(records.select(*key).distinct(), *key, name="_place")
    n = places.count()
    if not n:
        return records.select(*tags, *(F.lit(0.0).alias(c) for c in ("point", "low", "high"))).limit(0)
    rows = saved(records.join(places, list(key)).select(*tags, F.col("_place").alias("no"), F.col(matched).alias("tp"), "fp", "fn"), "records")
    sums = lambda df, *by: df.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))).select(*by, f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))
    cols = ("tp", "fp", "fn")
    wide, found = by_tag(rows, tags, cols)
    if found:  # all tags of a draw in one row, summed by the number of its resample alone
        drawn = resampled(saved(wide, "records"), n, n_boot, seed).groupBy("boot").agg(*(F.sum(c).alias(c) for c in wide.columns if c != "no"))
        kinds = dict(rows.dtypes)
        each = [F.struct(*(F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(tags, tag)), f1(*(F.col(f"{c}_{k}") for c in cols)).alias("f1")) for k, tag in enumerate(found)]
        samples = saved(drawn.select("boot", F.inline(F.array(*each))), "samples")
    else:
        samples = saved(sums(resampled(rows, n, n_boot, seed), *tags, "boot"), "samples")
    point = sums(rows, *tags).withColumnRenamed("f1", "point")
    return same_keys(point, interval(samples, "f1", n_boot, *tags), list(tags)).select(*tags, "point", "low", "high")


def paired_bootstrap(a: DataFrame, b: DataFrame, n_boot: int = 10_000, seed: int = 42, matched: str = "tp", key: tuple[str, ...] = ("no",)) -> DataFrame:
    """point, low, high, p: the difference of F1 of a and b, its interval by the same draws for both, and a two-sided p.

    p is twice the share of draws on the other side of 0 than the difference itself, 1 at most. Both
    must have the same records, each once; otherwise ValueError.
    """
    sides = [df.select(*key, *(F.col(c).alias(f"{n}{k}") for c, n in ((matched, "tp"), ("fp", "fp"), ("fn", "fn")))) for df, k in ((a, "1"), (b, "2"))]
    both = saved(sides[0].join(sides[1], list(key)), "pairs")
    sizes = [both.count(), both.select(*key).distinct().count(), a.count(), b.count()]
    if len(set(sizes)) > 1:
        raise ValueError(f"a paired bootstrap needs the same records on both sides, each once: {sizes[0]} in common, {sizes[1]} different, {sizes[2]} and {sizes[3]} given")
    rows = saved(numbered(both, *key, name="_place").drop(*key).withColumnRenamed("_place", "no"), "records")
    cols = [f"{c}{k}" for k in "12" for c in ("tp", "fp", "fn")]
    diff = (f1(*(F.col(f"{c}1") for c in ("tp", "fp", "fn"))) - f1(*(F.col(f"{c}2") for c in ("tp", "fp", "fn")))).alias("d")
    samples = saved(resampled(rows, sizes[0], n_boot, seed).groupBy("boot").agg(*(F.sum(c).alias(c) for c in cols)).select("boot", diff), "samples")
    point = both.agg(*(F.sum(c).alias(c) for c in cols)).select(diff).withColumnRenamed("d", "point")
    counts = samples.agg(F.count_if(F.col("d") <= 0).alias("below"), F.count_if(F.col("d") >= 0).alias("above"))
    p = F.least(F.lit(1.0), F.when(F.col("point") >= 0, F.col("below")).otherwise(F.col("above")) * 2.0 / n_boot)
    return point.crossJoin(interval(samples, "d", n_boot)).crossJoin(counts).select("point", "low", "high", p.alias("p"))
