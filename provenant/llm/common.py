"""What the operators of this package share: shared storage, hashing of rows, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Only used where the session names no shared folder, as in tests.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Without one, an own folder where all run on one machine, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="provenant-"))


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back: a lineage cut that outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, rows: int = 1024, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most so many rows and, if its rows are alike, bytes: what Python holds of it at once."""
    step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
    for lo in range(0, batch.num_rows, step):
        yield batch.slice(lo, step)


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores where its files give fewer parts than cores, for a Python stage that follows; else as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, n: int) -> Column:
    """crc32 of a column as text, modulo n; null counts as the empty string."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def append_arrow(df: DataFrame, fields: T.StructType, fn: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]]) -> DataFrame:
    """df with further columns, computed by parts of Arrow batches. fn is called once per task and returns the function of a part."""
    names = df.columns + fields.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = fn()
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, *each(part)], names=names)

    return df.mapInArrow(run, T.StructType(df.schema.fields + fields.fields))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def sampled_by_hash(df: DataFrame, group: Column, keys: list[str], per_group: int) -> DataFrame:
    """At most about per_group rows of each group, chosen by a hash of the keys; every row of a smaller group.

    The groups' sizes are counted over all rows; only those counts reach the driver. The
    hash threshold keeps per_group rows on average, and a row limit bounds the whole.
    """
    counts = {r[0]: r[1] for r in df.groupBy(group.alias("g")).count().collect()}
    if not counts:
        return df.limit(0)
    share = F.lit(0.0)
    for g, n in counts.items():
        share = F.when(group.eqNullSafe(F.lit(g)), F.lit(min(1.0, per_group / n))).otherwise(share)
    unit = F.pmod(F.xxhash64(*keys), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return df.filter(unit < share).limit(per_group * len(counts) * 2)
