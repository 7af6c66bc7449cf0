"""Zero-shot labels: photos against a small matrix of label vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumigraph.functions.vectors import EPSILON, matrix
from lumigraph.operators.similarity import usable

#: The labels that photos are tagged with by default.
LABELS = (
    "portrait", "selfie", "group photo", "family", "friends", "landscape", "city", "night", "sunset",
    "food", "pets", "indoors", "outdoors", "travel", "wedding", "party", "sports",
)
#: Labels that the driver takes, at most, and bytes of their vectors that are broadcast together.
MOST_LABELS, BLOCK_BYTES = 100_000, 32 << 20
#: Scores of vectors by labels that a task holds at once.
MOST_SCORES = 1 << 22


def rank_labels(vectors: DataFrame, labels: Sequence[str], weights: np.ndarray, k: int = 5, id_col: str = "id", vector: str = "vector") -> DataFrame:
    """(id, rank, tag, score): for each vector its k labels of highest cosine, ties by the labels' order; none without labels or with k 0.

    The labels' vectors are broadcast BLOCK_BYTES at a time; of several blocks
    the best of each meet again by vector.
    """
    if len(labels) > MOST_LABELS:
        raise ValueError(f"{len(labels)} labels; {MOST_LABELS} at most")
    k = min(k, len(labels))
    spark = vectors.sparkSession
    if k <= 0:
        return spark.createDataFrame([], "id long, rank int, tag string, score double")
    w = np.asarray(weights, float)
    w = w / (np.sqrt((w * w).sum(1, keepdims=True)) + EPSILON)
    rows, step = usable(vectors, id_col, vector, w.shape[1]), max(1, BLOCK_BYTES // (8 * w.shape[1]))
    blocks = [_block(rows, labels[i : i + step], w[i : i + step], k, i) for i in range(0, len(labels), step)]
    if len(blocks) == 1:
        return blocks[0].drop("at")
    first = Window.partitionBy("id").orderBy(F.desc("score"), "at")
    every = reduce(DataFrame.unionByName, blocks).withColumn("rank", F.row_number().over(first))
    return every.where(F.col("rank") <= k).select("id", "rank", "tag", "score")


def _block(rows: DataFrame, labels: Sequence[str], w: np.ndarray, k: int, start: int) -> DataFrame:
    """(id, rank, tag, score, at) for the labels from place `start` on."""
    sent = rows.sparkSession.sparkContext.broadcast((list(labels), w))
    k = min(k, len(labels))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, w = sent.value
        step = max(1, MOST_SCORES // len(labels))
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                batch = whole.slice(i, step)
                score = matrix(batch.column(1), w.shape[1]) @ w.T
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                n = batch.num_rows
                ids, rank = np.repeat(batch.column(0).to_numpy(), k), np.tile(np.arange(1, k + 1, dtype=np.int32), n)
                columns = [ids, rank, [labels[j] for j in top.ravel()], np.take_along_axis(score, top, 1).ravel(), (top.ravel() + start).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["id", "rank", "tag", "score", "at"])

    return rows.mapInArrow(best, "id long, rank int, tag string, score double, at int")


def tags_text(photos: DataFrame, tags: DataFrame) -> DataFrame:
    """(id, file_path, tags): each photo's tags joined by commas in order of their ids; empty without any."""
    by = tags.groupBy("photo_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "tag"))), lambda x: x["tag"]), ", ").alias("tags"))
    return photos.join(by, photos["id"] == by["photo_id"], "left").select("id", "file_path", F.coalesce("tags", F.lit("")).alias("tags"))
