"""Who is who in issues, comments, pull requests and commits: contributor keys by actor, and how each key came about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.functions import text as tx

#: By table, the actors (source of an identity's rows, columns of the table by those of the identity map, the key's column); the first one carries provenance.
ACTORS = {
    "issues": (("issue_author", {"author_login": "raw_login"}, "issue_author_contributor_key"), ("issue_closer", {"closed_by_login": "raw_login"}, "issue_closer_contributor_key")),
    "comments": (("issue_comment", {"author_login": "raw_login"}, "comment_author_contributor_key"),),
    "pull_requests": (("pr_author", {"author_login": "raw_login"}, "pr_author_contributor_key"),),
    "commits": (("commit_author", {"author_name": "raw_name", "author_email": "raw_email"}, "commit_author_contributor_key"),),
}
PROVENANCE = ("strict_resolved_contributor_key", "fuzzy_resolved_contributor_key", "fuzzy_resolution_method")


def _value(df: DataFrame, name: str):
    return tx.clean_text(F.col(name)) if name in df.columns else F.lit(None).cast("string")


def key_lookup(identities: DataFrame, source: str, columns: list[str]) -> DataFrame:
    """repo, _k (values of columns; null is a value), _key and _how (the least provenance) of a source's keys that one contributor has alone."""
    own = identities.filter((F.col("raw_source_type") == source) & F.col("resolved_contributor_key").isNotNull())
    how = F.struct(*(_value(own, c).alias(c) for c in PROVENANCE))
    g = own.groupBy("repo", F.struct(*(_value(own, c).alias(c) for c in columns)).alias("_k")).agg(F.min("resolved_contributor_key").alias("_key"), F.max("resolved_contributor_key").alias("_last"), F.min(how).alias("_how"))
    return g.filter("_key = _last").drop("_last")


def attach_actor(base: DataFrame, identities: DataFrame, source: str, pairs: dict[str, str], into: str, *, provenance: bool = False) -> DataFrame:
    """base (repo, ...) with a contributor key in into by repository and the pairs of columns, null-safe; with provenance also its strict and fuzzy key and method.

    Values that several contributors share attach none; a column that base lacks counts as null. Columns of these names that base has are replaced.
    """
    lookup = key_lookup(identities, source, list(pairs.values())).withColumnRenamed("repo", "_repo")
    new = {into: F.col("_key")} | ({c: F.col(f"_how.{c}") for c in PROVENANCE} if provenance else {})
    left = base.drop(*new)
    own = left.withColumn("_mine", F.struct(*(_value(left, b).alias(i) for b, i in pairs.items())))
    same = [F.col("repo") == F.col("_repo"), *(F.col(f"_mine.{c}").eqNullSafe(F.col(f"_k.{c}")) for c in pairs.values())]
    return own.join(lookup, same, "left").select(*left.columns, *(v.alias(n) for n, v in new.items()))


def annotate(base: DataFrame, identities: DataFrame, table: str, *, fuzzy: bool = False) -> DataFrame:
    """base with the keys of its table's actors, identity_resolution_mode and, in the fuzzy mode, the provenance of the first actor."""
    for n, (source, pairs, into) in enumerate(ACTORS[table]):
        base = attach_actor(base, identities, source, pairs, into, provenance=fuzzy and n == 0)
    return base if "identity_resolution_mode" in base.columns else base.withColumn("identity_resolution_mode", F.lit("fuzzy" if fuzzy else "strict"))


def attachment_counts(base: DataFrame, identities: DataFrame, table: str) -> DataFrame:
    """Per actor of an annotated table: rows with a real value, rows with a key, and values dropped because several contributors share them."""
    out = None
    for source, pairs, into in ACTORS[table]:
        real = F.lit(False)
        for c in pairs:
            real = real | (tx.has_real_value(c) if c in base.columns else F.lit(False))
        seen = base.agg(F.coalesce(F.sum(real.cast("int")), F.lit(0)).alias("rows_with_actor"), F.count(into).alias("rows_attached"))
        own = identities.filter((F.col("raw_source_type") == source) & F.col("resolved_contributor_key").isNotNull())
        shared = own.groupBy("repo", *(_value(own, c).alias(c) for c in pairs.values())).agg((F.min("resolved_contributor_key") < F.max("resolved_contributor_key")).alias("many")).agg(F.count(F.when(F.col("many"), 1)).alias("ambiguous_keys_dropped"))
        one = seen.join(F.broadcast(shared)).select(F.lit(source).alias("actor"), "*")  # one row
        out = one if out is None else out.union(one)
    return out
