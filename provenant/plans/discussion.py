"""Queries on discussions, texts, labels and mentions."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenant.functions import text as tx
from provenant.functions.numbers import count_bin
from provenant.operators import discussion as d
from provenant.operators import statistics as st
from provenant.operators import tables as tb
from provenant.plans.registry import LEXICON, comments, load, longs, polarity_sql, query, rounded

_FEATURES = """(t <> '')::INT AS has_text, length(t)::BIGINT AS text_length_chars, len(tok)::BIGINT AS token_count,
  (length(t) - length(replace(t, '?', '')))::BIGINT AS question_mark_count, (length(t) - length(replace(t, '!', '')))::BIGINT AS exclamation_mark_count,
  CASE WHEN len(regexp_extract_all(t, '[A-Za-z]')) > 0 THEN len(regexp_extract_all(t, '[A-Z]'))::DOUBLE / len(regexp_extract_all(t, '[A-Za-z]')) ELSE 0.0 END AS uppercase_ratio"""
_SCORED = f"(SELECT conv_id AS issue, turn + 1 AS seq, role AS author, {_FEATURES}, neg, neu, pos, compound FROM {polarity_sql('conversations', 'text', '*')})"


def scored(spark, sf):
    return d.comment_features(comments(spark, sf), **LEXICON)


@query(f"""SELECT issue, seq::INT AS seq, has_text, text_length_chars, token_count, question_mark_count, exclamation_mark_count, round(uppercase_ratio, 6) AS uppercase_ratio,
  round(neg, 6) AS sentiment_neg, round(neu, 6) AS sentiment_neu, round(pos, 6) AS sentiment_pos, round(compound, 6) AS sentiment_compound,
  (compound > 0.05)::INT AS is_positive_comment, (compound < -0.05)::INT AS is_negative_comment, (compound BETWEEN -0.05 AND 0.05)::INT AS is_neutral_comment FROM {_SCORED}""")
def comment_sentiment_features(spark, sf):
    out = scored(spark, sf).drop("author", "has_code_block", "has_url", "has_path_reference")
    return rounded(longs(out, "text_length_chars", "token_count", "question_mark_count", "exclamation_mark_count"))


_ISSUE = f"""
WITH s AS {_SCORED},
k AS (SELECT *, row_number() OVER (PARTITION BY issue, has_text ORDER BY seq) AS k, sum(has_text) OVER (PARTITION BY issue) AS n_text FROM s),
e AS (SELECT *, greatest(1, n_text // 2) AS cut, CASE WHEN has_text = 1 THEN compound END AS v FROM k),
m AS (SELECT issue, count(*) AS comment_count, sum(has_text)::BIGINT AS comments_with_text_count,
  sum((compound > 0.05)::INT)::BIGINT AS positive_comment_count, sum((compound < -0.05)::INT)::BIGINT AS negative_comment_count, sum((compound BETWEEN -0.05 AND 0.05)::INT)::BIGINT AS neutral_comment_count,
  coalesce(avg(v), 0) AS mean_comment_sentiment, coalesce(median(v), 0) AS median_comment_sentiment, coalesce(min(v), 0) AS min_comment_sentiment, coalesce(max(v), 0) AS max_comment_sentiment,
  coalesce(stddev_samp(v), 0) AS std_comment_sentiment,
  coalesce(avg(CASE WHEN has_text = 1 AND k <= cut THEN v END), 0) AS early_mean_comment_sentiment,
  coalesce(avg(CASE WHEN has_text = 1 AND (k > cut OR n_text = 1) THEN v END), 0) AS late_mean_comment_sentiment,
  coalesce(CASE WHEN count(v) > 1 THEN regr_slope(v, k - 1) END, 0) AS comment_sentiment_slope,
  sum(text_length_chars * has_text)::BIGINT AS total_comment_text_chars, sum(question_mark_count)::BIGINT AS total_question_mark_count FROM e GROUP BY issue),
c AS (SELECT issue, count(*) AS u, max(k) AS top, sum(k * k)::BIGINT AS sq FROM (SELECT issue, author, count(*) AS k FROM s WHERE author IS NOT NULL GROUP BY ALL) GROUP BY issue)
SELECT m.issue, comment_count, comments_with_text_count, positive_comment_count, negative_comment_count, neutral_comment_count,
  round(mean_comment_sentiment, 6) AS mean_comment_sentiment, round(median_comment_sentiment, 6) AS median_comment_sentiment, round(min_comment_sentiment, 6) AS min_comment_sentiment, round(max_comment_sentiment, 6) AS max_comment_sentiment,
  round(std_comment_sentiment, 6) AS std_comment_sentiment, round(early_mean_comment_sentiment, 6) AS early_mean_comment_sentiment, round(late_mean_comment_sentiment, 6) AS late_mean_comment_sentiment, round(comment_sentiment_slope, 6) AS comment_sentiment_slope,
  total_comment_text_chars, total_question_mark_count,
  round(positive_comment_count / comment_count, 6) AS positive_comment_share, round(negative_comment_count / comment_count, 6) AS negative_comment_share, round(neutral_comment_count / comment_count, 6) AS neutral_comment_share,
  round(late_mean_comment_sentiment - early_mean_comment_sentiment, 6) AS comment_sentiment_change_late_minus_early,
  coalesce(u, 0) AS unique_commenter_count, round(coalesce(top, 0) / comment_count, 6) AS top_commenter_share, round(coalesce(sq, 0) / (comment_count * comment_count), 6) AS comment_concentration_ratio
FROM m LEFT JOIN c ON m.issue = c.issue"""


@query(_ISSUE)
def issue_sentiment_features(spark, sf):
    return rounded(longs(d.issue_sentiment(scored(spark, sf)), "total_question_mark_count", "total_comment_text_chars"))


def _issues(spark, sf):
    return comments(spark, sf).groupBy("issue").agg(F.min_by("author", "seq").alias("issue_author"))


@query("""
WITH s AS (SELECT conv_id AS issue, turn AS seq, role AS author FROM conversations),
i AS (SELECT issue, arg_min(author, seq) AS a, arg_max(author, seq) AS last_a, count(*) AS n, count(author) AS r FROM s GROUP BY issue),
p AS (SELECT issue, author, count(*) AS k FROM s WHERE author IS NOT NULL GROUP BY ALL),
q AS (SELECT p.issue, count(*) AS u, list_sort(list(k), 'DESC') AS ks, sum((k > 1)::INT)::BIGINT AS rep, max((author = a)::INT) AS own, sum(CASE WHEN author = a THEN 0 ELSE k END)::BIGINT AS oth, sum((author <> a)::INT)::BIGINT AS n_oth FROM p JOIN i ON p.issue = i.issue GROUP BY p.issue)
SELECT i.issue, n AS comment_count, r AS resolved_comment_count, n - r AS missing_resolved_comment_count, u AS unique_commenter_count,
  round(ks[1] / r, 6) AS top_commenter_share, round((ks[1] + coalesce(ks[2], 0)) / r, 6) AS top_2_commenters_share, rep AS repeat_commenter_count, round(r / u, 6) AS mean_comments_per_commenter,
  own AS issue_author_commented_flag, n_oth AS num_distinct_non_author_commenters, round(oth / r, 6) AS non_author_comment_share,
  (own = 1 AND n_oth = 0)::INT AS only_author_commented_flag, (u = 1)::INT AS single_commenter_flag, 1 AS first_comment_by_author_flag, (last_a = a)::INT AS last_comment_by_author_flag, 'ok' AS participation_coverage_flag
FROM i JOIN q ON i.issue = q.issue""")
def issue_participation_features(spark, sf):
    return rounded(d.issue_participation(_issues(spark, sf), comments(spark, sf)))


@query("""SELECT issue, author AS top_commenter_key, k AS top_commenter_count FROM (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY k DESC, f, author) AS rk
  FROM (SELECT conv_id AS issue, role AS author, count(*) AS k, min(turn) AS f FROM conversations WHERE role IS NOT NULL GROUP BY ALL)) WHERE rk = 1""")
def top_commenter(spark, sf):
    return d.top_commenter(comments(spark, sf))


@query(f"""
WITH s AS {_SCORED}, n AS (SELECT *, count(*) OVER (PARTITION BY issue) AS n FROM s),
b AS (SELECT least(floor((seq - 1)::DOUBLE / (n - 1) * 5) + 1, 5)::INT AS position_bin, compound FROM n WHERE n >= 2),
g AS (SELECT position_bin, avg(compound) AS m, count(*) AS k, coalesce(stddev_samp(compound), 0) AS sd FROM b GROUP BY position_bin)
SELECT position_bin, round(m, 6) AS mean_sentiment, k AS n_comments, round(m - 1.96 * sd / sqrt(k), 6) AS ci_low, round(m + 1.96 * sd / sqrt(k), 6) AS ci_high FROM g""")
def sentiment_trajectory(spark, sf):
    return rounded(d.trajectory(scored(spark, sf)))


@query("""SELECT doc_id, regexp_matches(t, '(?i)\\b(?:https?://|www\\.)[^\\s<>()\\[\\]{}"'']+')::INT AS has_url,
  regexp_matches(t, '(?:\\.{0,2}/)?(?:[A-Za-z0-9_.-]+[\\\\/])+[A-Za-z0-9_.-]+(?:\\.[A-Za-z0-9]{1,10})?')::INT AS has_path_reference, contains(t, '`')::INT AS has_code_block, length(t)::BIGINT AS text_length_chars
  FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM documents)""")
def document_text_flags(spark, sf):
    d = load(spark, sf, "documents")
    f = tx.text_features("text")
    return longs(d.select("doc_id", *(f[c].alias(c) for c in ("has_url", "has_path_reference", "has_code_block", "text_length_chars"))), "text_length_chars")


_REF = "(?i)(?:#|gh-|[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+#|https?://github\\.com/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+/issues/)(\\d+)"
_BODY = "concat('Fixes #', l_orderkey, ', gh-', l_partkey, '. see https://github.com/o/r/issues/', l_suppkey, ' and #99999999999999999999')"


@query(f"""SELECT l_orderkey, l_linenumber, list_aggregate(list_sort(list_distinct(list_transform(regexp_extract_all(b, '{_REF}', 1), lambda x: TRY_CAST(x AS BIGINT)))), 'string_agg', ',') AS all_refs,
  list_aggregate(list_sort(list_distinct(list_transform(regexp_extract_all(regexp_extract(b, '(?i)\\bfixes\\b([^\\n.;]*)', 1), '{_REF}', 1), lambda x: TRY_CAST(x AS BIGINT)))), 'string_agg', ',') AS closing_refs
  FROM (SELECT *, {_BODY} AS b FROM lineitem)""")
def issue_reference_extraction(spark, sf):
    li = load(spark, sf, "lineitem")
    body = F.concat(F.lit("Fixes #"), "l_orderkey", F.lit(", gh-"), "l_partkey", F.lit(". see https://github.com/o/r/issues/"), "l_suppkey", F.lit(" and #99999999999999999999"))
    listed = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x.cast("string")), ",")
    return li.select("l_orderkey", "l_linenumber", listed(tx.issue_references(body)).alias("all_refs"), listed(tx.closing_references(body)).alias("closing_refs"))


@query("""
WITH f AS (SELECT p_partkey AS issue, concat('src/', lower(p_type), '/', replace(p_name, ' ', '_'), '.py') AS path, concat(replace(p_name, ' ', '_'), '.py') AS name FROM part),
u AS (SELECT DISTINCT path, name FROM f),
m AS (SELECT issue, path AS mention FROM f WHERE issue % 2 = 0 UNION ALL SELECT issue, name FROM f WHERE issue % 2 = 1
  UNION ALL SELECT issue, substr(name, 2) FROM f WHERE issue % 2 = 0), -- within a path the file-name pattern starts at the second letter
b AS (SELECT name, min(path) AS path FROM u GROUP BY name HAVING count(*) = 1)
SELECT issue, path, how FROM (SELECT issue, mention AS path, 'exact' AS how FROM m WHERE mention IN (SELECT path FROM u)
  UNION SELECT issue, b.path, 'basename' FROM m JOIN b ON m.mention = b.name)""")
def file_mention_links(spark, sf):
    p = load(spark, sf, "part")
    name = F.concat(F.translate("p_name", " ", "_"), F.lit(".py"))
    path = F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), name)
    body = F.concat(F.lit("Crash in "), F.when(F.col("p_partkey") % 2 == 0, path).otherwise(name), F.lit(", please look"))
    mentions = p.select(F.col("p_partkey").alias("issue"), F.explode(tx.file_mentions(body)).alias("mention"))
    return tb.unique_path_links(mentions, p.select(path.alias("path")))


@query("""SELECT event_id, label, (label IN ('won t fix', 'error'))::INT AS is_wanted, contains(label, 'cli')::INT AS has_substring
  FROM (SELECT event_id, trim(regexp_replace(regexp_replace(lower(concat(' ', upper(event_type), '_')), '[-_]', ' ', 'g'), '\\s+', ' ', 'g')) AS label FROM events)""")
def label_normalization(spark, sf):
    e = load(spark, sf, "events")
    label = tx.normalize_label(F.concat(F.lit(" "), F.upper("event_type"), F.lit("_")))
    labels = tx.parse_labels(F.concat(F.lit("["), F.lit("'"), "event_type", F.lit("'"), F.lit("]")))
    return e.select("event_id", label.alias("label"), tx.has_label(labels, ["won t fix", "error"]).cast("int").alias("is_wanted"), tx.contains_any(labels, ["cli"]).cast("int").alias("has_substring"))


@query("""SELECT issue, CASE WHEN n = 0 THEN 'zero_comments' WHEN n < 3 THEN 'sparse_discussion' WHEN u = 1 THEN 'single_voice' ELSE 'ok' END AS coverage_flag
  FROM (SELECT conv_id AS issue, count(*) AS n, count(DISTINCT role) AS u FROM conversations GROUP BY conv_id)""")
def coverage_flag_ladder(spark, sf):
    g = comments(spark, sf).groupBy("issue").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("author").alias("u"))
    return g.select("issue", F.when(F.col("n") == 0, "zero_comments").when(F.col("n") < 3, "sparse_discussion").when(F.col("u") == 1, "single_voice").otherwise("ok").alias("coverage_flag"))


@query(f"""
WITH s AS {polarity_sql('documents', 'text', 'doc_id, n_chars')},
e AS (SELECT list_distinct(quantile_cont(n_chars, [0, 0.25, 0.5, 0.75, 1.0])) AS es FROM documents),
b AS (SELECT s.compound, 1 + len(list_filter(list_sort(es)[2:len(es) - 1], lambda q: s.n_chars > q)) AS bucket FROM s, e)
SELECT bucket::INT AS bucket, count(*) AS n, round(avg(compound), 6) AS mean_sentiment FROM b GROUP BY bucket""")
def quantile_bucket_sentiment(spark, sf):
    docs = load(spark, sf, "documents").select("n_chars", tx.polarity("text", **LEXICON)["compound"].alias("compound"))
    out = tb.quantile_bucket(docs, "n_chars", 4).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("compound").alias("mean_sentiment"))
    return rounded(out)


@query(f"""
WITH s AS {_SCORED}, i AS (SELECT issue, count(*) AS n, avg(compound) AS v FROM s GROUP BY issue),
b AS (SELECT CASE WHEN n >= 6 THEN '6+' WHEN n >= 3 THEN '3-5' WHEN n >= 1 THEN '1-2' ELSE '0' END AS comment_bin, v FROM i)
SELECT comment_bin, count(*) AS n, round(avg(v), 6) AS mean_value, round(coalesce(stddev_samp(v), 0) / sqrt(count(*)), 6) AS se FROM b GROUP BY comment_bin""")
def binned_trend(spark, sf):
    i = d.issue_sentiment(scored(spark, sf))
    b = i.select(count_bin(F.col("comment_count"), [0, 1, 3, 6]).alias("comment_bin"), F.col("mean_comment_sentiment").alias("v"))
    return rounded(b.groupBy("comment_bin").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean_value"), (F.coalesce(F.stddev_samp("v"), F.lit(0.0)) / F.sqrt(F.count(F.lit(1)))).alias("se")))


@query("""
WITH c AS (SELECT role, CASE length(text) % 4 WHEN 0 THEN 'joy' WHEN 1 THEN 'anger' WHEN 2 THEN 'neutral' END AS emotion FROM conversations)
SELECT role, emotion, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY role), 4) AS share_within_role FROM c WHERE emotion <> 'neutral' GROUP BY role, emotion""")
def emotion_role_breakdown(spark, sf):
    """The classifier is a parameter of the engine; this stub labels a comment by its length."""
    c = load(spark, sf, "conversations")
    k = F.length("text") % 4
    labelled = c.select("role", F.when(k == 0, "joy").when(k == 1, "anger").when(k == 2, "neutral").alias("emotion")).filter("emotion <> 'neutral'")
    g = labelled.groupBy("role", "emotion").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql.window import Window

    return g.withColumn("share_within_role", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("role")), 4))


@query(f"""
WITH s AS {_SCORED}, i AS (SELECT issue, avg(compound) AS y, count(*)::DOUBLE AS x FROM s GROUP BY issue),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry, x, y FROM i)
SELECT count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r""")
def spearman_corr(spark, sf):
    i = d.issue_sentiment(scored(spark, sf)).select(F.round("mean_comment_sentiment", 12).alias("y"), F.col("comment_count").cast("double").alias("x"))
    return rounded(st.spearman(i, "x", "y"))
