"""Readers and writers of tables: formats by suffix, partitioned datasets, parts, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from provenant.operators.tables import keep_first


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Parquet, CSV with a header, JSON lines, or multi-line JSON, by suffix."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    name = path.lower().removesuffix(".gz")
    if name.endswith(".csv"):
        return reader.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    if name.endswith(".jsonl"):
        return reader.json(path)
    if name.endswith(".json"):
        return reader.option("multiLine", True).json(path)
    return reader.parquet(path)


def read_if_exists(spark: SparkSession, path: str, schema: StructType | str, required: bool = False) -> DataFrame:
    """The table, or an empty one of the schema where there is none (an error, if required)."""
    try:
        return read_table(spark, path, schema)
    except AnalysisException as e:
        if required or "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_repo(spark: SparkSession, path: str, repo: str, column: str = "repo_full_name") -> DataFrame:
    """One repository of a partitioned dataset; the filter prunes partitions."""
    return spark.read.parquet(path).filter(F.col(column) == repo)


def repo_filter(df: DataFrame, repo: str) -> DataFrame:
    """Rows of a repository; a table that names none gives no rows."""
    column = next((c for c in ("repo_full_name", "full_name") if c in df.columns), None)
    return df.filter(F.col(column) == repo) if column else df.limit(0)


def read_parts(spark: SparkSession, pattern: str) -> DataFrame:
    """All part files that match a glob, with columns that some of them lack as null."""
    return spark.read.option("mergeSchema", True).parquet(pattern)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", *, partition_by: list[str] | None = None, rows_per_file: int | None = None, dedupe: list[str] | None = None, order: list[str] | None = None) -> None:
    """Overwrite a table; deduped by key (first row by order) and sorted within files where asked."""
    if dedupe:
        df = keep_first(df, dedupe, *[F.col(c).asc_nulls_last() for c in order or dedupe])
    if partition_by:
        df = df.repartition(*partition_by)
    if order:
        df = df.sortWithinPartitions(*(partition_by or []), *[F.col(c).asc_nulls_last() for c in order])
    out = df.write.mode("overwrite")
    if rows_per_file:
        out = out.option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        out = out.partitionBy(*partition_by)
    if fmt == "csv":
        out.option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        out.option("compression", "gzip").json(path)
    else:
        out.option("compression", "snappy").parquet(path)


def write_manifest(spark: SparkSession, path: str, counters: dict[str, object]) -> None:
    """One JSON row of run counters."""
    import json

    spark.createDataFrame([(json.dumps(counters, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def merge_groups(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns that some lack are null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
