"""Making this package importable on the executors, and ending lineages in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors, unless their Python path has them already."""
    paths = [os.path.abspath(p or ".") for p in [".", *os.environ.get("PYTHONPATH", "").split(os.pathsep)]]
    context = spark.sparkContext
    if str(ROOT) in paths or getattr(context, "_plenum_shipped", False):
        return spark
    target = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "plenum.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in [*ROOT.glob("plenum/**/*.py"), *ROOT.glob("*.py")]:
            z.write(p, p.relative_to(ROOT))
    context.addPyFile(str(target))
    context._plenum_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in spark.checkpoint.dir.

    Only a session in local mode, as in tests, may leave it unset and gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read from there: its lineage ends, its statistics are known."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def removed(*tables: DataFrame) -> None:
    """Remove what `saved` wrote, once nothing reads it any more."""
    for df in tables:
        if path := df.__dict__.pop("_saved_at", None):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
