"""Raw payloads as flat rows: issues and pull requests of JSON text, file changes of git log lines, windows of dates.

Defined cases: a field that a payload lacks is null; text that is no JSON gives a row of nulls. A count of "-" (a binary file) is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions import text as tx

ISSUE = """id bigint, node_id string, number bigint, state string, state_reason string, title string, body string, user struct<login:string,type:string>, assignees array<struct<login:string>>, labels array<string>,
  milestone struct<title:string>, comments bigint, locked boolean, active_lock_reason string, author_association string, created_at string, updated_at string, closed_at string, closed_by struct<login:string>,
  html_url string, url string, repository_url string, timeline_url string, performed_via_github_app string, pull_request struct<url:string>"""
COMMENT = "id bigint, node_id string, issue_url string, user struct<login:string,type:string>, author_association string, created_at string, updated_at string, body string, html_url string, url string, reactions string, performed_via_github_app string"
REPOSITORY = """id bigint, node_id string, name string, full_name string, owner struct<login:string>, html_url string, description string, language string, stargazers_count bigint, forks_count bigint, open_issues_count bigint, watchers_count bigint,
  default_branch string, visibility string, fork boolean, archived boolean, disabled boolean, is_template boolean, created_at string, updated_at string, pushed_at string, topics array<string>"""
PULL = "id bigint, number bigint, state string, created_at string, merged_at string, merge_commit_sha string, user struct<login:string>, head struct<ref:string,sha:string>, base struct<ref:string,sha:string>"


def utc(c: Column) -> Column:
    """ISO text as a timestamp; null where it is none."""
    return F.try_to_timestamp(c)


def _flat(raw: DataFrame, payload: str, schema: str) -> tuple[DataFrame, list[str]]:
    """raw with the payload as _j, and the columns it keeps."""
    return raw.withColumn("_j", F.from_json(payload, schema)), [c for c in raw.columns if c != payload]


def _times(*names: str) -> list[Column]:
    return [utc(F.col(f"_j.{n}")).alias(n) for n in names]


def flatten_issues(raw: DataFrame, payload: str, wanted: list[str], hidden: tuple[str, ...] = ()) -> DataFrame:
    """The other columns of raw with an issue's fields, whether a wanted label is among its labels, and whether it is a pull request.

    Labels may be objects or plain text. A payload that lacks comments has 0 of them. Columns named in hidden stay null, for fields that are not to be kept.
    """
    j, kept = _flat(raw, payload, ISSUE)
    is_object = lambda x: F.get_json_object(x, "$.name").isNotNull() | x.startswith("{")
    names = F.transform("_j.labels", lambda x: F.when(is_object(x), F.get_json_object(x, "$.name")).otherwise(x))
    objects = F.concat(F.lit("["), F.array_join(F.transform("_j.labels", lambda x: F.when(is_object(x), x).otherwise(F.to_json(F.struct(x.alias("name"))))), ","), F.lit("]"))
    lacks = ~F.coalesce(F.array_contains(F.json_object_keys(F.col(payload)), "comments"), F.lit(True))
    none = F.lit("[]")
    out = j.select(
        *kept, F.col("_j.id").alias("issue_id"), F.col("_j.node_id").alias("issue_node_id"), F.col("_j.number").alias("issue_number"), "_j.state", "_j.state_reason", "_j.title", "_j.body", F.col("_j.user.login").alias("author_login"), F.col("_j.user.type").alias("author_type"),
        F.coalesce(F.to_json(F.transform("_j.assignees", lambda x: x["login"])), none).alias("assignee_logins"), F.coalesce(F.to_json(names), none).alias("labels"), F.coalesce(objects, none).alias("label_payloads"), F.col("_j.milestone.title").alias("milestone_title"),
        F.when(lacks, F.lit(0)).otherwise(F.col("_j.comments")).cast("bigint").alias("comment_count"), "_j.locked", "_j.active_lock_reason", "_j.author_association", *_times("created_at", "updated_at", "closed_at"), F.col("_j.closed_by.login").alias("closed_by_login"),
        "_j.html_url", "_j.url", "_j.repository_url", "_j.timeline_url", F.coalesce("_j.performed_via_github_app", F.lit("null")).alias("performed_via_github_app"),
        F.coalesce(tx.has_label(names, wanted), F.lit(False)).cast("int").alias("has_wanted_label"), F.col("_j.pull_request").isNotNull().cast("int").alias("is_pull_request"), F.lit("search/issues").alias("source_api"),
    )
    return out.withColumns({c: F.lit(None).cast(out.schema[c].dataType) for c in hidden})


def flatten_comments(raw: DataFrame, payload: str, hidden: tuple[str, ...] = ()) -> DataFrame:
    """The other columns of raw (of the repository and issue) with a comment's fields; reactions and the app as JSON text."""
    j, kept = _flat(raw, payload, COMMENT)
    out = j.select(*kept, F.col("_j.id").alias("comment_id"), F.col("_j.node_id").alias("comment_node_id"), "_j.issue_url", F.col("_j.user.login").alias("author_login"), F.col("_j.user.type").alias("author_type"), "_j.author_association", *_times("created_at", "updated_at"), "_j.body", "_j.html_url", "_j.url", F.coalesce("_j.reactions", F.lit("null")).alias("reactions"), F.coalesce("_j.performed_via_github_app", F.lit("null")).alias("performed_via_github_app"))
    return out.withColumns({c: F.lit(None).cast(out.schema[c].dataType) for c in hidden})


def flatten_repositories(raw: DataFrame, payload: str, listed_id: str | None = None, listed_name: str | None = None) -> DataFrame:
    """The other columns of raw with a repository's fields; id and full name are those of the list (listed columns) where the payload has none (or 0, or an empty name)."""
    j, kept = _flat(raw, payload, REPOSITORY)
    known = lambda c, none, listed: F.coalesce(F.nullif(F.col(c), F.lit(none)), F.col(listed)) if listed else F.col(c)
    plain = ("html_url", "description", "language", "stargazers_count", "forks_count", "open_issues_count", "watchers_count", "default_branch", "visibility")
    flags = {"fork": "is_fork", "archived": "is_archived", "disabled": "is_disabled", "is_template": "is_template"}
    return j.select(*kept, known("_j.id", 0, listed_id).alias("repo_id_found"), F.col("_j.node_id").alias("repo_node_id"), F.col("_j.name").alias("repo_name"), known("_j.full_name", "", listed_name).alias("full_name_found"), F.col("_j.owner.login").alias("owner_login"), *(F.col(f"_j.{c}").alias(c) for c in plain), *(F.col(f"_j.{c}").alias(n) for c, n in flags.items()), *_times("created_at", "updated_at", "pushed_at"), F.coalesce(F.to_json("_j.topics"), F.lit("[]")).alias("topics"))


def flatten_pulls(raw: DataFrame, payload: str) -> DataFrame:
    """The other columns of raw with a pull request's fields."""
    j = raw.withColumn("_j", F.from_json(payload, PULL))
    kept = [c for c in raw.columns if c != payload]
    return j.select(*kept, F.col("_j.id").alias("pr_id"), F.col("_j.number").alias("pr_number"), "_j.state", utc(F.col("_j.created_at")).alias("created_at"), utc(F.col("_j.merged_at")).alias("merged_at"), "_j.merge_commit_sha", F.col("_j.user.login").alias("author_login"), F.col("_j.head.sha").alias("head_sha"), F.col("_j.base.ref").alias("base_ref"))


def file_changes(lines: DataFrame, keys: list[str], line: str, place: str | None = None, first: tuple[str, ...] = ()) -> DataFrame:
    """keys, path, old_path, status, raw_status, additions, deletions from lines of --numstat and --name-status, merged by path.

    A numstat line has two counts and a path; a name-status line a letter (with a score for renames and copies) and one path or two. Of lines of one kind on the same path
    the last by place (a number) counts; without places, the greatest. Of lines in the same place the first by the columns named in first counts; without those, the greatest.
    """
    part = F.split(line, "\t")
    at = F.col(place) if place else F.lit(0)
    # with columns by which the first counts, all is turned round: the least by falling places, those without one last
    order, last = ([at.alias("at")], F.max) if not first else ([at.isNull().alias("none"), (-at).alias("at"), *first], F.min)
    count = lambda k: F.when(F.get(part, F.lit(k)) == "-", None).otherwise(F.get(part, F.lit(k))).cast("bigint")
    sizes, state = F.col(line).rlike(r"^(\d+|-)\t(\d+|-)\t."), F.col(line).rlike(r"^[ACDMRTUX]\d*\t.")
    moved = part[0].rlike("^[RC]") & (F.size(part) >= 3)
    path = F.when(sizes | moved, F.get(part, F.lit(2))).otherwise(F.get(part, F.lit(1)))
    rows = lines.filter(sizes | state).select(
        *keys, path.alias("path"),
        F.when(sizes, F.struct(*order, count(0).alias("additions"), count(1).alias("deletions"))).alias("n"),
        F.when(~sizes, F.struct(*order, part[0].alias("raw"), F.when(moved, F.get(part, F.lit(1))).alias("old"))).alias("s"),
    ).filter("path <> ''")
    g = rows.groupBy(*keys, "path").agg(last("n").alias("n"), last("s").alias("s"))
    return g.select(*keys, "path", F.col("s.old").alias("old_path"), F.substring("s.raw", 1, 1).alias("status"), F.col("s.raw").alias("raw_status"), F.col("n.additions").alias("additions"), F.col("n.deletions").alias("deletions"))


def split_window(start: Column, end: Column) -> Column:
    """The two halves of a window of dates as structs (start, end); the second begins the day after the middle. One day isn't split."""
    middle = F.date_add(start, F.floor(F.datediff(end, start) / 2).cast("int"))
    half = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    return F.when(start >= end, F.array(half(start, end))).otherwise(F.array(half(start, middle), half(F.date_add(middle, 1), end)))


def year_ranges(start: Column, end: Column) -> Column:
    """Windows of dates by calendar year, cut to start and end."""
    return F.transform(F.sequence(F.year(start), F.year(end)), lambda y: F.struct(F.greatest(start, F.make_date(y, F.lit(1), F.lit(1))).alias("start"), F.least(end, F.make_date(y, F.lit(12), F.lit(31))).alias("end")))


def repo_of_url(c: Column) -> Column:
    """owner/name: the last two parts of a repository's URL."""
    return F.array_join(F.slice(F.split(F.regexp_replace(c, "/+$", ""), "/"), -2, 2), "/")


def passes_lists(repo: Column, allow_repos: list[str], block_repos: list[str], allow_owners: list[str], block_owners: list[str]) -> Column:
    """Blocked owners and repositories never pass; each allow list that is not empty must name the owner, or the repository. Names are compared as they are."""
    owner = F.split(repo, "/")[0]
    out = ~(owner.isin(*block_owners) | repo.isin(*block_repos))
    for c, names in ((owner, allow_owners), (repo, allow_repos)):
        if names:
            out = out & c.isin(*names)
    return out
