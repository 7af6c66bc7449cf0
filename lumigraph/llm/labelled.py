"""Bounded samples of labelled documents, and classifiers applied to a table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumigraph.llm.text import free_name
from lumigraph.sources.tables import stash

#: Labelled rows that a classifier is fitted on, at most, and bytes of their texts together: the first by hash of doc_id.
TRAIN_ROWS, TRAIN_BYTES = 4000, 48 << 20


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents whose labels no classifier sees; null, like 0, is no number of five's rest: false."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS, most: int = TRAIN_BYTES) -> tuple[pa.Array, np.ndarray]:
    """(texts, labels) of at most `rows` labelled documents outside the held-out fifth, in a fixed order.

    Labels of documents that are not in `docs` don't count for the bound.  A
    text that would take the texts together over `most` bytes is left out.
    Null labels or ids are left out; of several labels of one doc_id the largest
    counts, and of several rows of a document the smallest text.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    found = stash(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"), F.xxhash64("doc_id").alias("h")))
    kept, total = [], 0
    for doc_id, size in found.orderBy("h", "doc_id").select("doc_id", F.octet_length("text")).collect():  # `rows` at most
        if total + size <= most:
            kept.append((doc_id,))
            total += size
    if not kept:
        return pa.array([], pa.string()), np.zeros(0)
    kept = docs.sparkSession.createDataFrame(kept, docs.select("doc_id").schema)
    table = found.join(F.broadcast(kept), "doc_id").orderBy("h", "doc_id").select("text", "y").toArrow()
    return table["text"].combine_chunks().cast(pa.string()), table["y"].to_numpy().astype("float64")


def scored(docs: DataFrame, score, name: str) -> DataFrame:
    """`docs` with column `name`: `score` (a function from an Arrow string column to float64) of each text."""
    spark = docs.sparkSession
    kept = spark.sparkContext.broadcast(score)
    text = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept.value(batch.column(text)), pa.float64())], [*[f"c{i}" for i in range(batch.num_columns)], "score"])

    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    schema = T.StructType([*inner.schema.fields, T.StructField("score", T.DoubleType())])
    return inner.mapInArrow(run, schema).toDF(*docs.columns, name)


def report(docs: DataFrame, score, threshold: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    name = free_name(["doc_id", "text"], "score")
    out = scored(docs.select("doc_id", "text"), score, name)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
