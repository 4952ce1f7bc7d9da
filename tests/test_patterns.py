"""Patterns on text: equal to their plain forms, linear in long texts, and without need of stack."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from provenant.functions import text as tx

#: The plain forms, which backtrack.
PATH = r"(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+\.[A-Za-z0-9]{1,10}"
REFERENCE = r"(?i)(?:#|gh-|[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+#|https?://github\.com/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+/issues/)(\d+)"
PATH_REFERENCE = r"(?:\.{0,2}/)?(?:[A-Za-z0-9_.-]+[\\/])+[A-Za-z0-9_.-]+(?:\.[A-Za-z0-9]{1,10})?"
FILE_NAME = r"(?<![/\\])[A-Za-z0-9_.-]+\.(?:" + "|".join(tx.SUFFIXES) + r")\b"
PIECES = ["a", "b.c", "/", "//", "\\", ".", "..", "#", "gh-", "GH-", "12", "7", " ", "-", "_", "x.py", ".cc", ".cpp", ".verylongextension", "https://github.com/", "issues/", "/issues/8", "o/r#5", "`", "!", "é", ".c", "\n", "src/m.go"]


def texts(n):
    random.seed(11)
    return ["".join(random.choice(PIECES) for _ in range(random.randint(0, 14))) for _ in range(n)]


def test_patterns_equal_their_plain_forms(spark):
    rows = texts(6000)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    joined = F.filter(F.transform(F.regexp_extract_all("t", F.lit(tx.JOINED), F.lit(0)), lambda x: F.regexp_extract(x, tx.PATH, 0)), lambda x: x != "")
    got = df.select("i", joined.alias("p"), F.regexp_extract_all("t", F.lit(tx.ISSUE_REFERENCE), F.lit(1)).alias("r"), F.regexp_extract_all("t", F.lit(tx.FILE_NAME), F.lit(0)).alias("f"), F.col("t").rlike(tx.PATH_REFERENCE).alias("h"), tx.clean_text("t").alias("c")).collect()
    for x in got:
        t = rows[x["i"]]
        assert x["p"] == re.findall(PATH, t, re.A), t
        assert x["r"] == re.findall(REFERENCE, t, re.A), t
        assert x["f"] == [m.group(0) for m in re.finditer(FILE_NAME, t)], t
        assert x["h"] == bool(re.search(PATH_REFERENCE, t, re.A)), t
        assert x["c"] == (t.strip() or None), t


LONG = {
    "segments": "a/" * 100_000 + "a",
    "file": "a/" * 100_000 + "a.py",
    "dotted": "a." * 500_000,
    "word": "x" * 1_000_000,
    "gh": "gh-1x" * 100_000,
    "chain": "gh-1" * 200_000,
    "dots": "a/" + "." * 500_000 + "b.c",
    "spaces": "a" + " " * 1_000_000 + "b",
    "labels": "[" + ",".join(f"'l{k}'" for k in range(100_000)) + "]",
    "slashes": "\\" * 500_000 + "./" * 100_000,
    "closes": "closes " * 100_000,
}


@pytest.mark.parametrize("name", sorted(LONG))
def test_long_texts(spark, name):
    df = spark.createDataFrame([(LONG[name],)], "t string")
    began = time.time()
    row = df.select(F.size(tx.file_mentions("t")).alias("m"), F.size(tx.issue_references("t")).alias("r"), F.size(tx.closing_references("t")).alias("k"), tx.text_features("t")["has_path_reference"].alias("p"), tx.clean_text("t").alias("c"), F.size(tx.parse_labels("t")).alias("l"), tx.polarity("t")["neu"].alias("n")).first()
    assert time.time() - began < 20
    assert row["p"] == int(name in ("segments", "file", "dots", "slashes"))
    if name == "file":
        assert row["m"] >= 1
    if name in ("gh", "chain"):
        assert row["r"] == 1
    if name == "labels":
        assert row["l"] == 100_000
