"""The corpus pipeline: quality, line dedup, near dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; its result is written as Parquet and reread as the next stage's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumigraph.llm import decontaminate, line_dedup, mixing, ngram_join, quality
from lumigraph.sources.tables import stash, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Each text is scored whole, however long, by a model fitted on labelled rows
    of `docs`.  Null and empty texts have the score of an average passage;
    repeated rows fare alike; a score at the threshold stays; null doc_ids are
    scored like others.  Without labels of both classes all have one score.
    Other columns, whatever their names, pass through; an empty table stays one.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one.

    No row goes: a document that loses all its lines, like a null or empty one,
    stays.  Rows of one doc_id are one document, and so are those without one.
    Of documents that tie, the largest doc_id keeps the line.  n_chars is what
    it was before.  Long texts are split whole; other columns pass through.
    """
    return line_dedup.dedup_lines(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id.

    Null and empty texts are no copies of each other and stay, as do rows with
    a null doc_id and repeated rows of a document that stays.  Texts of one
    doc_id that differ are looked at one by one.  A similarity of exactly 0.8
    links.  Long texts are compared whole; other columns pass through.
    """
    return ngram_join.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts stay, and null or wordless items hit nothing; repeated
    rows fare alike; rows with a null doc_id are judged by their text.  Long
    texts are searched whole; other columns pass through; either table may be
    empty.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; copy_no, or a free name like it, counts its copies.

    Null and empty texts have size 0 and are taken by a draw of their own;
    repeated rows are taken equally often; a null source is a source, a null
    doc_id a document.  Draws are hashes, so ties and reruns agree.  Long texts
    count whole; other columns pass through; an empty table stays one.
    """
    return mixing.mixed(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

#: A fitted classifier and random draws: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
