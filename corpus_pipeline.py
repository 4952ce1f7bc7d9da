"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows of its predecessor. Language ID drops documents that it
rejects; line dedup deletes later copies of repeated runs of lines; the Jaccard join (five words, 0.8) keeps one
document of each group; mixing puts the rows in the order of the target weights and gives each its position in it, a column that the last stage keeps;
the last stage encodes the texts, whose chunks have no order of their own.
"""

from __future__ import annotations

from provenant.llm import language, linededup, mixing, pieces, setjoin
from provenant.llm.common import stored, table


def language_id(spark, docs, sf_dir):
    return language.keep_identified(docs, language.fit(docs))


def line_dedup(spark, docs, sf_dir):
    return linededup.rewrite_lines(docs)


def ngram_jaccard(spark, docs, sf_dir):
    return setjoin.keep_one(docs, size=5, num=80, den=100)


def mix_sources(spark, docs, sf_dir):
    return mixing.with_position(docs)


def sentencepiece(spark, docs, sf_dir):
    return pieces.encoded_stage(docs, settled=True)  # docs is a stored table


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("mix_sources", mix_sources),
    ("sentencepiece", sentencepiece),
]

#: The stages learn centroids and hash with functions that SQL doesn't have.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages, each one's rows written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
