"""Views of a table as files that readers find whole: written aside, then made current by one small file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.session import remove, removed, saved

CURRENT = "_CURRENT"


def file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def current(spark: SparkSession, root: str) -> str | None:
    """The version that readers see; none: nothing was ever committed."""
    fs, place = file_system(spark, f"{root}/{CURRENT}")
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return stream.readUTF()
    finally:
        stream.close()


def safe(name: str):
    """A view's name in a path: no blank and no slash."""
    return F.regexp_replace(F.col(name).cast("string"), "[/ ]", "_")


def write_views(df: DataFrame, root: str, *by: str, every: DataFrame | None = None) -> None:
    """One folder of JSON for each value of `by`, and the manifest: by..., rows, folder.

    every(by...): all views there are; those without rows stand in the manifest with 0 and no
    folder. The files of a version lie in a folder of their own; it becomes current when all of it
    is written, and the one before goes then. A write that fails leaves what readers see as it was.
    The rows are made once, for the files and for the counts of the manifest.
    """
    spark, version, before = df.sparkSession, uuid.uuid4().hex, current(df.sparkSession, root)
    data, folders = f"{root}/{version}/data", [f"_{c}" for c in by]
    rows = None
    try:
        df = rows = saved(df, "rows")
        df.withColumns(dict(zip(folders, map(safe, by)))).write.partitionBy(*folders).json(data)
        there = df.groupBy(*by).agg(F.count("*").alias("rows"))
        every = (df if every is None else every).select(*by).distinct()
        there = there.withColumnsRenamed({c: f"t_{c}" for c in by})
        same = [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in by]
        path = F.concat_ws("/", *(F.concat(F.lit(f"{f}="), F.coalesce(safe(c), F.lit("__HIVE_DEFAULT_PARTITION__"))) for f, c in zip(folders, by)))
        index = every.join(there, same, "left").select(*by, F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), F.when(F.col("rows") > 0, path).alias("folder"))
        index.write.parquet(f"{root}/{version}/manifest")
    except BaseException:
        remove(spark, f"{root}/{version}")
        raise
    finally:
        if rows is not None:
            removed(rows)
    fs, place = file_system(spark, f"{root}/{CURRENT}")
    stream = fs.create(place, True)
    stream.writeUTF(version)
    stream.close()
    if before:
        remove(spark, f"{root}/{before}")


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{current(spark, root)}/manifest")


def read_view(spark: SparkSession, root: str, schema, **view) -> DataFrame:
    """The rows of one view; a view without rows, or one that is not there, is empty."""
    chosen = read_manifest(spark, root)
    for c, v in view.items():
        chosen = chosen.where(F.col(c) == v)
    row = chosen.where("folder IS NOT NULL").first()
    if row is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{root}/{current(spark, root)}/data/{row['folder']}")
