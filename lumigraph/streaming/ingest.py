"""Streaming ingest: files that arrive are put in the photos table, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lumigraph.functions.text import is_image
from lumigraph.plans.engine import Engine
from lumigraph.sources.files import LISTING


def arriving(spark: SparkSession, root: str) -> DataFrame:
    """New image files below `root`, as a stream of (path, modificationTime, length, content)."""
    return spark.readStream.format("binaryFile").schema(LISTING).option("recursiveFileLookup", True).load(root).where(is_image(F.col("path")))


def ingest(engine: Engine, root: str, checkpoint: str) -> StreamingQuery:
    """Index what arrives, as a scan does: hashes and EXIF data included.

    What has a known path and size is skipped, so that a repeated batch does no harm.
    """

    def put(batch: DataFrame, _: int) -> None:
        engine.index(batch)

    return arriving(engine.spark, root).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
