"""Payloads, lists and git logs on small rows, awkward ones among them."""

import pytest
from pyspark.sql import functions as F

from provenant.operators import flatten as fl
from provenant.sources import gitlog as gl


def test_lists_are_both_asked(spark):
    df = spark.createDataFrame([("own/r1",), ("own/other",), ("else/r1",), ("OWN/r1",), ("bad/r2",), ("own/no",)], "r string")
    passed = lambda *lists: [x["r"] for x in df.filter(fl.passes_lists(F.col("r"), *lists)).collect()]
    assert passed(["own/r1", "else/r1"], [], ["own"], []) == ["own/r1"]
    assert passed([], ["own/no"], [], ["bad"]) == ["own/r1", "own/other", "else/r1", "OWN/r1"]
    assert passed(["own/r1"], [], [], []) == ["own/r1"] and passed([], [], ["own"], []) == ["own/r1", "own/other", "own/no"]


def test_issue_payloads(spark):
    rows = [
        '{"id": 1, "labels": ["wontfix", {"name": "Bug", "color": "f00"}], "assignees": [{"login": "x"}, {}], "title": "t"}',
        '{"id": 2, "comments": null, "labels": [], "user": {"login": "u", "type": "Bot"}}',
        '{"id": 3, "comments": 4, "labels": null, "performed_via_github_app": {"id": 9}, "created_at": "2024-01-02T03:04:05Z"}',
        "no json",
        None,
    ]
    got = fl.flatten_issues(spark.createDataFrame([(r,) for r in rows], "p string"), "p", ["wont fix", "wontfix"], hidden=("title",)).collect()
    assert [r["comment_count"] for r in got[:3]] == [0, None, 4] and [r["has_wanted_label"] for r in got] == [1, 0, 0, 0, 0]
    assert got[0]["labels"] == '["wontfix","Bug"]' and got[0]["label_payloads"].replace(" ", "") == '[{"name":"wontfix"},{"name":"Bug","color":"f00"}]'
    assert got[0]["title"] is None and got[0]["assignee_logins"] in ('["x",null]', '["x"]') and got[2]["performed_via_github_app"].replace(" ", "") == '{"id":9}'
    assert got[3]["issue_id"] is None and got[4]["issue_id"] is None and got[0]["performed_via_github_app"] == "null"
    assert len(got[0].asDict()) == 29


def record(sha, *rest, parents="", fields=("Ann", "a@x", "2024-01-01T00:00:00+00:00")):
    return f"{gl.RECORD}\n" + gl.FIELD.join([sha, parents, *fields, rest[0]]) + "\n" + "\n".join(rest[1:]) + "\n"


@pytest.fixture
def logs(spark, tmp_path):
    a = "warning: before all\n" + record("s1", "first line", "second", "", "1\t2\ta.py", "-\t-\tb.bin", "", "no file", parents="p1 p2") + record("s2", "x" * 400, "", "5\t0\td.py", "7\t1\td.py") + record("", "none") + record("s4", "only here", "")
    b = record("s1", "first line", "second", "", "M\ta.py", "R087\told.bin\tb.bin") + record("s2", "x" * 400, "", "A\td.py") + record("s3", f"a{gl.FIELD}b", "", "D\tgone.py")
    (tmp_path / "a.log").write_text(a)
    (tmp_path / "b.log").write_text(b)
    return gl.read_log(spark, str(tmp_path / "a.log")), gl.read_log(spark, str(tmp_path / "b.log"))


def test_git_logs(logs):
    merged = gl.merged_passes(*logs, [])
    rows = {r["commit_sha"]: r for r in gl.commit_rows(merged, []).collect()}
    assert sorted(rows) == ["s1", "s2", "s3", "s4"]
    assert rows["s1"]["commit_message"] == "first line\nsecond" and rows["s1"]["parent_shas_json"] == '["p1","p2"]' and rows["s1"]["author_name"] == "Ann"
    assert rows["s2"]["commit_message"] == "x" * 300 and rows["s3"]["commit_message"] == f"a{gl.FIELD}b" and rows["s4"]["parent_shas_json"] == "[]"
    files = {(r["commit_sha"], r["path"]): (r["old_path"], r["status"], r["raw_status"], r["additions"], r["deletions"]) for r in gl.commit_file_rows(merged, []).collect()}
    assert files == {("s1", "a.py"): (None, "M", "M", 1, 2), ("s1", "b.bin"): ("old.bin", "R", "R087", None, None), ("s2", "d.py"): (None, "A", "A", 7, 1), ("s3", "gone.py"): (None, "D", "D", None, None)}
    first = {r["commit_sha"]: r for r in gl.parse_records(logs[0].sparkSession.createDataFrame([(f"s9{gl.FIELD}{gl.FIELD}n{gl.FIELD}m{gl.FIELD}t{gl.FIELD}subject\n3\t4\tz.py\n",)], "value string"), whole_message=False).collect()}
    assert first["s9"]["commit_message"] == "subject" and first["s9"]["file_lines"] == ["3\t4\tz.py"]


def test_a_large_log_is_split_by_records(spark, tmp_path):
    (tmp_path / "big.log").write_text("".join(record(f"s{k}", "m", "", f"{k}\t1\tf{k}.py") for k in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        log = gl.read_log(spark, str(tmp_path / "big.log"))
        assert log.rdd.getNumPartitions() > 3 and log.select("commit_sha").distinct().count() == 20_000 == log.filter("size(file_lines) = 1").count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_log_command():
    assert gl.log_command("--numstat", since="2024-01-01")[-2:] == ["--numstat", "--since=2024-01-01"]


def test_of_lines_with_the_same_number_the_first_in_the_table_counts(spark, tmp_path):
    from provenant.plans import catalog

    rows = [(1, 5, 1, 2, 9.0), (1, 5, 2, 7, 8.0), (1, 5, 3, 7, 27.0), (2, 5, 1, 3, 30.0), (2, 5, 1, 3, 4.0), (2, 5, 4, 1, 40.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.QUERIES["git_file_changes"](spark, str(tmp_path)).select("sha", "additions", "deletions").collect()
    assert sorted(map(tuple, got)) == [(1, 8, 7), (2, 30, 3)]
