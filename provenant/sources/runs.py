"""Runs of a stage that can be stopped and taken up again, with counters from the same pass.

A stage's output is partitioned by repository, and the manifest, a table beside it, has a row for each batch of repositories that is finished. What is finished is left out by an anti join before the
stage; what was written without having been noted is written again, over its own partitions only. So a repository is neither lost nor there twice.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFEST = "repo string, batch int, rows_in bigint, rows_out bigint, counters map<string,bigint>, finished_at timestamp"


def finished(spark: SparkSession, manifest: str) -> DataFrame:
    """The manifest, or an empty one."""
    try:
        return spark.read.schema(MANIFEST).parquet(manifest)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST)


def counted(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """df with an observation of its rows and of further counters (sums of numbers or truths), taken while it is read for something else."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in counters.items())), seen


def run_stage(rows: DataFrame, stage: Callable[[DataFrame], DataFrame], path: str, manifest: str, *, repo: str = "repo", batches: int = 8, counters: dict[str, Column] | None = None) -> dict[int, dict[str, int]]:
    """Apply a stage to the rows of repositories that are not finished, in batches by hash of the repository, and write its output below path; the counters of the batches of this run.

    rows_in are the rows that the stage is given, rows_out those it makes; counters are sums over its output. All are observed while the output is written, so that nothing is read twice. Rows without a
    repository are in no batch. The stage must keep the column of the repository. Only counters reach the driver.
    """
    spark = rows.sparkSession
    done: dict[int, dict[str, int]] = {}
    for batch in range(batches):
        own = rows.filter(F.pmod(F.xxhash64(repo), F.lit(batches)) == batch).filter(F.col(repo).isNotNull())
        # dealt by repository: one that is noted is left out before the stage
        todo = own.join(finished(spark, manifest).select(F.col("repo").alias(repo)).distinct(), repo, "left_anti")
        if todo.limit(1).count() == 0:
            continue
        given, before = counted(todo, f"in-{batch}")
        out, after = counted(stage(given), f"out-{batch}", **(counters or {}))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(repo).parquet(path)
        got = after.get
        more = {k: int(v) for k, v in got.items() if k != "rows"}
        done[batch] = {"rows_in": int(before.get["rows"]), "rows_out": int(got["rows"]), **more}
        note = todo.select(F.col(repo).cast("string").alias("repo")).distinct().withColumns({"batch": F.lit(batch), "rows_in": F.lit(done[batch]["rows_in"]).cast("long"), "rows_out": F.lit(done[batch]["rows_out"]).cast("long"), "counters": F.create_map(*[F.lit(x) for k, v in more.items() for x in (k, v)]).cast("map<string,bigint>") if more else F.create_map().cast("map<string,bigint>"), "finished_at": F.lit(datetime.datetime.now(datetime.timezone.utc))})
        note.write.mode("append").parquet(manifest)
    return done
