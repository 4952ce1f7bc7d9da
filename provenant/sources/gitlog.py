"""Git logs as text: records split by Spark's text source, headers, messages and file lines parsed by column functions.

A log is written by two passes of one command, with file sizes (--numstat) and with states (--name-status). Each record begins with a line of its own; its fields are on the next one.
A file of any size is split by records, so a large history is many tasks.

Defined cases: what stands before the first record is none. A record without fields, or without a hash, gives no commit. The message ends at the first empty line; what follows are lines on files,
and those that are neither kind are none. A hash that a pass has twice counts with its last record; both passes may have it. Without both counts or a path a line is no file's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.operators.flatten import file_changes

#: The line before each record, and what separates the fields of its first line.
RECORD = "__COMMIT__"
FIELD = "\x1f"


def log_command(files: str, *, since: str | None = None, until: str | None = None) -> list[str]:
    """The command whose output read_log reads; files is --numstat or --name-status."""
    window = [f"--since={since}"] * bool(since) + [f"--until={until}"] * bool(until)
    return ["git", "log", "--all", "--date=iso-strict", f"--pretty=format:{RECORD}%n" + FIELD.join(("%H", "%P", "%an", "%ae", "%aI", "%B")), files, *window]


def read_log(spark: SparkSession, path: str, *, whole_message: bool = True) -> DataFrame:
    """commit_sha, parent_shas, author_name, author_email, commit_timestamp (text), commit_message, file_lines of each record, and its place in its file."""
    raw = spark.read.option("lineSep", f"{RECORD}\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"))
    return parse_records(raw, whole_message=whole_message)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s++|(?<!\s)\s++\z", "")


def parse_records(raw: DataFrame, value: str = "value", *, whole_message: bool = True) -> DataFrame:
    """The other columns of raw with the parts of a record's text. Without whole_message the first line is all of it."""
    kept = [c for c in raw.columns if c != value]
    j = raw.withColumn("_lines", F.split(value, "\r?\n")).withColumn("_f", F.split(F.col("_lines")[0], FIELD))
    rest = F.slice("_lines", 2, F.greatest(F.size("_lines") - 1, F.lit(0)))
    blank = F.array_position(rest, "").cast("int")
    first = F.array_join(F.slice("_f", 6, F.greatest(F.size("_f") - 5, F.lit(0))), FIELD)
    more = F.when(blank > 0, F.slice(rest, F.lit(1), blank - 1)).otherwise(rest) if whole_message else F.array().cast("array<string>")
    files = (F.when(blank > 0, F.slice(rest, blank + 1, F.size(rest))).otherwise(F.array().cast("array<string>"))) if whole_message else rest
    message = _strip(F.array_join(F.concat(F.when(first != "", F.array(first)).otherwise(F.array().cast("array<string>")), more), "\n"))
    field = lambda k: F.get("_f", F.lit(k))
    parents = F.filter(F.split(F.coalesce(field(1), F.lit("")), r"\s+"), lambda x: x != "")
    out = j.filter(F.size("_f") > 1).select(*kept, field(0).alias("commit_sha"), parents.alias("parent_shas"), field(2).alias("author_name"), field(3).alias("author_email"), field(4).alias("commit_timestamp"), message.alias("commit_message"), F.filter(files, lambda x: x != "").alias("file_lines"))
    return out.filter("commit_sha <> ''")


def merged_passes(numstat: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each keys + commit_sha of either pass: the fields of the first (of the second, where only that has it), numstat_lines and state_lines."""
    at = [*keys, "commit_sha"]
    fields = ("parent_shas", "author_name", "author_email", "commit_timestamp", "commit_message", "file_lines")
    last = lambda df, n: df.groupBy(*at).agg(F.max_by(F.struct(*fields), "place").alias(n))
    j = last(numstat, "a").join(last(states, "b"), at, "full")
    return j.select(*at, *(F.when(F.col("a").isNotNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in fields[:-1]), F.col("a.file_lines").alias("numstat_lines"), F.col("b.file_lines").alias("state_lines"))


def commit_rows(merged: DataFrame, keys: list[str], *, most_chars: int | None = 300) -> DataFrame:
    """keys, commit_sha, author, time and message (cut to most_chars, whole if None), and the parents as a JSON list."""
    message = F.col("commit_message") if most_chars is None else F.substring("commit_message", 1, most_chars)
    return merged.select(*keys, "commit_sha", "author_name", "author_email", "commit_timestamp", message.alias("commit_message"), F.to_json("parent_shas").alias("parent_shas_json"), F.lit("local_git").alias("source_system"))


def commit_file_rows(merged: DataFrame, keys: list[str]) -> DataFrame:
    """keys, commit_sha and each file's path, former path, sizes of change, state and raw state."""
    lines = merged.select(*keys, "commit_sha", F.posexplode(F.concat(F.coalesce("numstat_lines", F.array().cast("array<string>")), F.coalesce("state_lines", F.array().cast("array<string>")))).alias("place", "line"))
    return file_changes(lines, [*keys, "commit_sha"], "line", "place")
