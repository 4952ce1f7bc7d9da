"""Queries on raw payloads, which are made of the given tables as JSON and git log text."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenant.operators import flatten as fl
from provenant.operators.shards import plan_shards
from provenant.plans.registry import iso_times, load, query
from provenant.sources import gitlog as gl
from provenant.sources import runs
from provenant.sources.scratch import new_path


_DAY = "yyyy-MM-dd'T'00:00:00'Z'"
_AT = "strftime(o_orderdate, '%Y-%m-%dT00:00:00')"


@query(f"""SELECT c_name AS repo, o_orderkey AS issue_id, 'n' || o_orderkey AS issue_node_id, o_orderkey % 1000 AS issue_number, lower(o_orderstatus) AS state, CASE WHEN o_orderkey % 4 = 0 THEN 'completed' END AS state_reason, o_orderpriority AS title, NULL AS body, c_name AS author_login, 'User' AS author_type,
  CASE WHEN o_orderkey % 6 = 0 THEN '["a","b"]' ELSE '[]' END AS assignee_logins, CASE WHEN o_orderkey % 3 = 0 THEN '["wontfix","' || o_orderpriority || '"]' WHEN o_orderkey % 3 = 1 THEN '["' || o_orderpriority || '","Won''t-Fix"]' ELSE '[]' END AS labels,
  CASE WHEN o_orderkey % 3 = 0 THEN '[{{"name":"wontfix"}},{{"name":"' || o_orderpriority || '"}}]' WHEN o_orderkey % 3 = 1 THEN '[{{"name":"' || o_orderpriority || '"}},{{"name":"Won''t-Fix"}}]' ELSE '[]' END AS label_payloads, CASE WHEN o_orderkey % 7 = 0 THEN 'v1' END AS milestone_title,
  CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 40 ELSE 0 END AS comment_count, o_orderkey % 8 = 0 AS locked, 'OWNER' AS author_association, {_AT} AS created_at, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%dT00:00:00') END AS closed_at, CASE WHEN o_orderstatus = 'F' THEN 'closer' END AS closed_by_login,
  'https://example.org/' || o_orderkey AS html_url, 'null' AS performed_via_github_app, (o_orderkey % 3 < 2)::INT AS has_wanted_label, (o_orderkey % 2)::INT AS is_pull_request, 'search/issues' AS source_api FROM orders JOIN customer ON o_custkey = c_custkey""")
def flattened_issues(spark, sf):
    """Orders as payloads: labels as text or as objects or absent, comments absent from every fifth; bodies are not to be kept."""
    o, c = load(spark, sf, "orders"), load(spark, sf, "customer")
    k, day = F.col("o_orderkey"), lambda n: F.date_format(F.date_add("o_orderdate", n), _DAY)
    texts = F.to_json(F.array(F.lit("wontfix"), F.col("o_orderpriority")))
    objects = F.to_json(F.array(F.struct(F.col("o_orderpriority").alias("name")), F.struct(F.lit("Won't-Fix").alias("name"))))
    person = lambda x, when=None: F.when(F.lit(True) if when is None else when, F.struct(x.alias("login"), F.lit("User").alias("type")))
    known = F.to_json(F.struct(k.alias("id"), F.concat(F.lit("n"), k).alias("node_id"), (k % 1000).alias("number"), F.lower("o_orderstatus").alias("state"), F.when(k % 4 == 0, "completed").alias("state_reason"), F.col("o_orderpriority").alias("title"), F.lit("a body").alias("body"), person(F.col("c_name")).alias("user"), F.when(k % 6 == 0, F.array(person(F.lit("a")), person(F.lit("b")))).alias("assignees"), F.when(k % 7 == 0, F.struct(F.lit("v1").alias("title"))).alias("milestone"), F.when(k % 5 > 0, F.col("o_custkey") % 40).alias("comments"), (k % 8 == 0).alias("locked"), F.lit("OWNER").alias("author_association"), day(0).alias("created_at"), F.when(F.col("o_orderstatus") == "F", day(1)).alias("closed_at"), person(F.lit("closer"), F.col("o_orderstatus") == "F").alias("closed_by"), F.concat(F.lit("https://example.org/"), k).alias("html_url"), F.when(k % 2 == 1, F.struct(F.lit("u").alias("url"))).alias("pull_request")))
    labels = F.when(k % 3 == 0, texts).when(k % 3 == 1, objects)
    raw = F.when(labels.isNull(), known).otherwise(F.concat(F.lit('{"labels":'), labels, F.lit(","), F.substring(known, F.lit(2), F.length(known))))
    rows = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_name").alias("repo"), raw.alias("payload"))
    return iso_times(fl.flatten_issues(rows, "payload", ["wont fix", "wontfix"], hidden=("body",)).drop("updated_at", "active_lock_reason", "url", "repository_url", "timeline_url"))


@query("""SELECT conv_id AS issue_number, conv_id * 100 + turn AS comment_id, role AS author_login, CASE WHEN role IS NOT NULL THEN 'User' END AS author_type, text AS body, '{"total":' || turn || '}' AS reactions, 'null' AS performed_via_github_app, '2024-01-01T00:00:00' AS created_at FROM conversations""")
def flattened_comments(spark, sf):
    c = load(spark, sf, "conversations")
    raw = F.to_json(F.struct((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.when(F.col("role").isNotNull(), F.struct(F.col("role").alias("login"), F.lit("User").alias("type"))).alias("user"), F.lit("2024-01-01T00:00:00Z").alias("created_at"), F.col("text").alias("body"), F.struct(F.col("turn").alias("total")).alias("reactions")))
    return iso_times(fl.flatten_comments(c.select(F.col("conv_id").alias("issue_number"), raw.alias("payload")), "payload").select("issue_number", "comment_id", "author_login", "author_type", "body", "reactions", "performed_via_github_app", "created_at"))


@query("""SELECT s_suppkey AS listed_id, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey + 1000 ELSE s_suppkey END AS repo_id_found, CASE WHEN s_suppkey % 4 > 0 THEN 'o/' || s_name ELSE 'listed/' || s_suppkey END AS full_name_found, 'o' AS owner_login, s_nationkey::BIGINT AS stargazers_count, s_suppkey % 2 = 0 AS is_fork,
  CASE WHEN s_suppkey % 5 = 0 THEN '["x","y"]' ELSE '[]' END AS topics FROM supplier""")
def flattened_repositories(spark, sf):
    k = F.col("s_suppkey")
    raw = F.to_json(F.struct(F.when(k % 3 > 0, k + 1000).alias("id"), F.when(k % 4 > 0, F.concat(F.lit("o/"), "s_name")).otherwise("").alias("full_name"), F.struct(F.lit("o").alias("login")).alias("owner"), F.col("s_nationkey").alias("stargazers_count"), (k % 2 == 0).alias("fork"), F.when(k % 5 == 0, F.array(F.lit("x"), F.lit("y"))).alias("topics")))
    rows = load(spark, sf, "supplier").select(k.alias("listed_id"), F.concat(F.lit("listed/"), k).alias("listed_name"), raw.alias("payload"))
    return fl.flatten_repositories(rows, "payload", "listed_id", "listed_name").select("listed_id", "repo_id_found", "full_name_found", "owner_login", "stargazers_count", "is_fork", "topics")


@query("""SELECT o_orderkey AS pr_id, o_custkey AS pr_number, 'closed' AS state, strftime(o_orderdate, '%Y-%m-%dT00:00:00') AS created_at, CASE WHEN o_orderkey % 3 > 0 THEN strftime(o_orderdate + INTERVAL 2 DAY, '%Y-%m-%dT00:00:00') END AS merged_at, 'm' || o_orderkey AS merge_commit_sha, o_clerk AS author_login, 'h' || o_orderkey AS head_sha, 'main' AS base_ref FROM
  (SELECT *, 'clerk' || (o_custkey % 17) AS o_clerk FROM orders)""")
def flattened_pulls(spark, sf):
    k, day = F.col("o_orderkey"), "yyyy-MM-dd'T'00:00:00'Z'"
    raw = F.to_json(F.struct(k.alias("id"), F.col("o_custkey").alias("number"), F.lit("closed").alias("state"), F.date_format("o_orderdate", day).alias("created_at"), F.when(k % 3 > 0, F.date_format(F.date_add("o_orderdate", 2), day)).alias("merged_at"), F.concat(F.lit("m"), k).alias("merge_commit_sha"), F.struct(F.concat(F.lit("clerk"), F.col("o_custkey") % 17).alias("login")).alias("user"), F.struct(F.lit("topic").alias("ref"), F.concat(F.lit("h"), k).alias("sha")).alias("head"), F.struct(F.lit("main").alias("ref"), F.lit("b").alias("sha")).alias("base")))
    return iso_times(fl.flatten_pulls(load(spark, sf, "orders").select(raw.alias("payload")), "payload"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber DESC) AS rn FROM lineitem)
  SELECT l_orderkey AS sha, concat('src/p', l_partkey, '.py') AS path, CASE WHEN l_linenumber % 5 = 0 THEN concat('old/p', l_partkey, '.py') END AS old_path, CASE WHEN l_linenumber % 5 = 0 THEN 'R' ELSE 'M' END AS status, CASE WHEN l_linenumber % 5 = 0 THEN 'R097' ELSE 'M' END AS raw_status,
  CASE WHEN l_suppkey % 4 > 0 THEN l_quantity::BIGINT END AS additions, CASE WHEN l_suppkey % 4 > 0 THEN l_linenumber::BIGINT END AS deletions FROM r WHERE rn = 1""")
def git_file_changes(spark, sf):
    """Of lines with the same number the first in the table counts."""
    li = load(spark, sf, "lineitem", placed=True)
    path, old = F.concat(F.lit("src/p"), "l_partkey", F.lit(".py")), F.concat(F.lit("old/p"), "l_partkey", F.lit(".py"))
    text = lambda c: F.when(F.col("l_suppkey") % 4 > 0, F.col(c).cast("bigint").cast("string")).otherwise("-")
    numstat = F.concat_ws("\t", text("l_quantity"), text("l_linenumber"), path)
    status = F.when(F.col("l_linenumber") % 5 == 0, F.concat_ws("\t", F.lit("R097"), old, path)).otherwise(F.concat_ws("\t", F.lit("M"), path))
    lines = li.select(F.col("l_orderkey").alias("sha"), F.col("l_linenumber").alias("place"), "in_file", "in_row", F.explode(F.array(numstat, status, F.lit(""), F.lit("a line of a message"))).alias("line"))
    return fl.file_changes(lines, ["sha"], "line", "place", ("in_file", "in_row"))


@query("""WITH w AS (SELECT c_custkey, DATE '2021-01-01' + (c_custkey % 500)::INT AS a, DATE '2021-01-01' + (c_custkey % 500 + c_custkey % 90)::INT AS b FROM customer)
  SELECT c_custkey, 1 AS part, a::VARCHAR AS start_date, CASE WHEN a >= b THEN b ELSE a + ((b - a) // 2)::INT END::VARCHAR AS end_date FROM w
  UNION ALL SELECT c_custkey, 2, (a + ((b - a) // 2)::INT + 1)::VARCHAR, b::VARCHAR FROM w WHERE a < b""")
def split_date_windows(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", F.date_add(F.lit("2021-01-01").cast("date"), (F.col("c_custkey") % 500).cast("int")).alias("a"), F.date_add(F.lit("2021-01-01").cast("date"), (F.col("c_custkey") % 500 + F.col("c_custkey") % 90).cast("int")).alias("b"))
    return c.select("c_custkey", F.posexplode(fl.split_window(F.col("a"), F.col("b"))).alias("k", "w")).select("c_custkey", (F.col("k") + 1).alias("part"), F.col("w.start").cast("string").alias("start_date"), F.col("w.end").cast("string").alias("end_date"))


@query("""WITH o AS (SELECT o_custkey, min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders GROUP BY o_custkey), y AS (SELECT *, unnest(range(year(a), year(b) + 1)) AS y FROM o)
  SELECT o_custkey, y::INT AS year, greatest(a, make_date(y, 1, 1))::VARCHAR AS start_date, least(b, make_date(y, 12, 31))::VARCHAR AS end_date FROM y""")
def year_shards(spark, sf):
    g = load(spark, sf, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    w = g.select("o_custkey", F.explode(fl.year_ranges(F.col("a"), F.col("b"))).alias("w"))
    return w.select("o_custkey", F.year("w.start").alias("year"), F.col("w.start").cast("string").alias("start_date"), F.col("w.end").cast("string").alias("end_date"))


@query("""SELECT s_suppkey, 'o' || (s_suppkey % 7) || '/r' || s_suppkey AS repo_full_name, (s_suppkey % 7 <> 3 AND s_suppkey <> 8)::INT AS passes, (s_suppkey % 7 IN (1, 2) AND s_suppkey IN (1, 2, 8, 9, 10) AND s_suppkey <> 8)::INT AS passes_allowed FROM supplier""")
def repo_lists(spark, sf):
    s = load(spark, sf, "supplier")
    url = F.concat(F.lit("https://example.org/repos/o"), F.col("s_suppkey") % 7, F.lit("/r"), "s_suppkey", F.lit("/"))
    repo = fl.repo_of_url(url)
    allowed = fl.passes_lists(repo, ["o1/r1", "o2/r2", "o1/r8", "o2/r9", "o3/r10", "O4/r11"], ["o1/r8"], ["o1", "o2"], ["o3"])
    return s.select("s_suppkey", repo.alias("repo_full_name"), fl.passes_lists(repo, [], ["o1/r8"], [], ["o3"]).cast("int").alias("passes"), allowed.cast("int").alias("passes_allowed"))


def _log(spark, sf, line, name):
    """Orders as records of a log: a message of one line or two, then lines of their items. Written as text, as git writes it."""
    path = new_path(spark, name)
    k = F.col("o_orderkey")
    message = F.when(k % 3 == 0, F.concat(F.lit("closes #"), k, F.lit("\n"), F.repeat(F.lit("long words "), 40))).otherwise(F.concat(F.lit("fix "), "o_orderpriority"))
    head = F.concat_ws(gl.FIELD, F.concat(F.lit("s"), k), F.when(k % 4 > 0, F.concat(F.lit("s"), k - 1, F.lit(" s"), k - 2)).otherwise(""), F.concat(F.lit("name "), "o_custkey"), F.concat("o_custkey", F.lit("@example.org")), F.date_format("o_orderdate", _DAY), message)
    files = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("files"))
    rows = load(spark, sf, "orders").join(files, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rows.select(F.concat(F.lit(f"{gl.RECORD}\n"), head, F.lit("\n\n"), F.coalesce("files", F.lit("")), F.lit("\n"))).write.option("lineSep", "\n").text(path)
    return gl.read_log(spark, path)


def _merged(spark, sf):
    path, old = F.concat(F.lit("src/p"), "l_partkey", F.lit(".py")), F.concat(F.lit("old/p"), "l_partkey", F.lit(".py"))
    count = lambda c: F.when(F.col("l_suppkey") % 4 > 0, F.col(c).cast("bigint").cast("string")).otherwise("-")
    sizes = _log(spark, sf, F.concat_ws("\t", count("l_quantity"), count("l_linenumber"), path), "numstat")
    states = _log(spark, sf, F.when(F.col("l_partkey") % 5 == 0, F.concat_ws("\t", F.lit("R097"), old, path)).otherwise(F.concat_ws("\t", F.lit("M"), path)), "name-status")
    return gl.merged_passes(sizes, states.filter("commit_sha not like '%7'"), [])


@query("""SELECT 's' || o_orderkey AS commit_sha, 'name ' || o_custkey AS author_name, o_custkey || '@example.org' AS author_email, strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') AS commit_timestamp,
  CASE WHEN o_orderkey % 3 = 0 THEN left('closes #' || o_orderkey || chr(10) || repeat('long words ', 40), 300) ELSE 'fix ' || o_orderpriority END AS commit_message, CASE WHEN o_orderkey % 4 > 0 THEN '["s' || (o_orderkey - 1) || '","s' || (o_orderkey - 2) || '"]' ELSE '[]' END AS parent_shas_json, 'local_git' AS source_system FROM orders""")
def git_log_commits(spark, sf):
    """Both passes of a log, read as text by records."""
    return gl.commit_rows(_merged(spark, sf), [])


@query("""WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey % 4 > 0 AS known, l_quantity::BIGINT AS q, l_linenumber::BIGINT AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey), t AS (SELECT *, CASE WHEN known THEN q || chr(9) || n ELSE '-' || chr(9) || '-' END || chr(9) AS line FROM l),
  r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY line DESC) AS rn FROM t)
  SELECT 's' || l_orderkey AS commit_sha, 'src/p' || l_partkey || '.py' AS path, CASE WHEN l_partkey % 5 = 0 AND l_orderkey % 10 <> 7 THEN 'old/p' || l_partkey || '.py' END AS old_path, CASE WHEN l_orderkey % 10 <> 7 THEN CASE WHEN l_partkey % 5 = 0 THEN 'R' ELSE 'M' END END AS status,
    CASE WHEN l_orderkey % 10 <> 7 THEN CASE WHEN l_partkey % 5 = 0 THEN 'R097' ELSE 'M' END END AS raw_status, CASE WHEN known THEN q END AS additions, CASE WHEN known THEN n END AS deletions FROM r WHERE rn = 1""")
def git_log_files(spark, sf):
    """The last line of a path counts; the lines of a record are sorted here, so that is the greatest."""
    return gl.commit_file_rows(_merged(spark, sf), [])


@query("""WITH RECURSIVE d AS (SELECT o_orderpriority AS repo, o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT DISTINCT repo FROM d),
  w AS (SELECT repo, DATE '1990-01-01' AS a, DATE '2029-12-31' AS b, (SELECT sum(n) FROM d WHERE d.repo = r.repo)::BIGINT AS n FROM r
    UNION ALL SELECT repo, a, b, n FROM (SELECT w.repo, h.a, h.b, (SELECT sum(n) FROM d WHERE d.repo = w.repo AND d.day BETWEEN h.a AND h.b)::BIGINT AS n
      FROM (SELECT repo, a, b, unnest([{'a': a, 'b': a + ((b - a) // 2)::INT}, {'a': a + ((b - a) // 2)::INT + 1, 'b': b}]) AS h FROM w WHERE n > 900 AND a < b) w) WHERE n > 0)
  SELECT repo, a::VARCHAR AS start_date, b::VARCHAR AS end_date, n AS total_count, (n > 1000)::INT AS is_truncated_risk FROM w WHERE n <= 900 OR a >= b""")
def search_shards(spark, sf):
    """Orders of a priority as search hits of a repository."""
    o = load(spark, sf, "orders")
    return plan_shards(o.groupBy(F.col("o_orderpriority").alias("repo"), F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n")), "1990-01-01", "2029-12-31")


@query("""SELECT o_orderpriority AS repo, count(*) AS rows_kept, sum((o_totalprice > 100000)::INT)::BIGINT AS dear, (SELECT count(*) FROM orders) AS all_in, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS all_out, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 2 = 1) AS all_odd
  FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_orderpriority""")
def resumable_stage(spark, sf):
    """A stage by priority, in batches with a manifest, run twice: the second run finds nothing to do. Its counters are those observed while it wrote."""
    path, manifest = new_path(spark, "stage"), new_path(spark, "manifest")
    rows = load(spark, sf, "orders").withColumnRenamed("o_orderpriority", "repo")
    for _ in range(2):
        runs.run_stage(rows, lambda df: df.filter("o_orderstatus <> 'P'").select("repo", "o_orderkey", "o_totalprice"), path, manifest, batches=2, counters={"odd": F.col("o_orderkey") % 2 == 1})
    out = spark.read.parquet(path).groupBy("repo").agg(F.count(F.lit(1)).alias("rows_kept"), F.sum((F.col("o_totalprice") > 100_000).cast("long")).alias("dear"))
    # one row for each batch, of the rows for each repository
    batch = runs.finished(spark, manifest).groupBy("batch").agg(F.max("rows_in").alias("i"), F.max("rows_out").alias("o"), F.max(F.col("counters")["odd"]).alias("d"))
    return out.join(F.broadcast(batch.agg(F.sum("i").alias("all_in"), F.sum("o").alias("all_out"), F.sum("d").alias("all_odd"))))
