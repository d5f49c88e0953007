"""What the operators of this subpackage share: the shared folder, saved tables and document blocks.

A *block* is a run of whole documents of one input split, about `block_mb` of text. Blocks are
written once, bucketed by their number, so that answers computed elsewhere come back to a block
by a shuffle of the answers alone; the texts stay where they are.
"""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a session whose tasks all run in the driver's own process (local mode, as in tests) may
    leave it unset and gets a folder of its own; on a cluster a missing setting is an error.
    """
    folder = spark.conf.get(SHARED, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError(f"{SHARED} must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(SHARED, folder)
    return folder.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(*saved_: DataFrame) -> None:
    """Remove tables that `save` wrote and nothing reads any more: a round's, once the next is written."""
    for df in saved_:
        if path := df.__dict__.pop("_saved_at", None):
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id and text (null: empty) alone, whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *others)


def text_bytes(docs: DataFrame) -> int:
    """Bytes of text in the table (one number)."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def power_of_two(n: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(n, 1))))


def bucket_count(size: int, limit: int, least: int, most: int) -> int:
    """Buckets of a table of blocks: two blocks each, more where Spark allows no more buckets."""
    return min(max(least, math.ceil(size / (2 * limit))), most)


def write_blocks(docs: DataFrame, size: int, block_mb: float = 4) -> DataFrame:
    """docs(doc_id, text, ...) plus `block`, as a table bucketed by block; size: its bytes of text."""
    spark = docs.sparkSession
    limit = int(block_mb * 2**20)
    fields = docs.schema

    def deal(batches):
        base, filled = TaskContext.get().partitionId() << 28, 0
        for batch in batches:
            sizes = pc.binary_length(batch.column(batch.schema.get_field_index("text"))).to_numpy(zero_copy_only=False)
            ends = filled + np.cumsum(sizes.astype(np.int64) + 1)
            blocks = pa.array(base + (ends - sizes - 1) // limit, pa.int64())
            filled = int(ends[-1]) if len(ends) else filled
            yield pa.RecordBatch.from_arrays([*batch.columns, blocks], [*batch.schema.names, "block"])

    from pyspark.sql import types as T

    dealt = docs.mapInArrow(deal, T.StructType([*fields.fields, T.StructField("block", T.LongType())]))
    name = f"blocks_{uuid.uuid4().hex}"
    n = bucket_count(size, limit, partitions(spark), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    dealt.write.format("parquet").option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").bucketBy(n, "block").sortBy("block").saveAsTable(name)
    return spark.table(name)


def blocks_of(batches, limit: int = 8 << 20):
    """Arrow record batches with a `text` column, regrouped to about `limit` bytes of text."""
    held, size = [], 0
    for batch in batches:
        at = 0
        sizes = np.cumsum(pc.binary_length(batch.column(batch.schema.get_field_index("text"))).to_numpy(zero_copy_only=False).astype(np.int64))
        while at < batch.num_rows:
            before = int(sizes[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(sizes, before + limit - size, "right")))
            upto = min(upto, batch.num_rows)
            part = batch.slice(at, upto - at)
            held.append(part)
            size += int(sizes[upto - 1]) - before
            at = upto
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column without nulls, and the n + 1 offsets of its rows."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = array.cast(pa.large_binary())
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None else np.zeros(0, np.uint8)
    return (data[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(offsets) else (data[:0], np.zeros(1, np.int64))
