"""Top-k search, k-nearest-neighbour join and threshold graph over vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumigraph.functions.vectors import EPSILON, dot, matrix, norm
from lumigraph.operators.components import connected_components
from lumigraph.sources.tables import stash

#: A vector matrix of so many bytes at most is broadcast; a larger one is dealt into lists.  Scores that a task holds at once.
BROADCAST_BYTES, MOST_SCORES = 32 << 20, 1 << 22
#: Rows of a list, about, and of a chunk of one, at most; lists, at most; rows that their centres are fitted on, for each list, and rounds of it.
LIST, CHUNK, LISTS, FIT, ROUNDS = 1_024, 4_096, 4_096, 16, 5


def usable(vectors: DataFrame, id_col: str, vector: str, dim: int | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """(id, vec), and the columns `extra`: rows whose vector has `dim` elements (that of the first non-empty row by default), none of them null."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("vec"), *extra).where("id IS NOT NULL AND size(vec) > 0")
    if dim is None:
        first = rows.select(F.size("vec").alias("n")).first()
        dim = first["n"] if first else 0
    return rows.where((F.size("vec") == dim) & ~F.exists("vec", lambda x: x.isNull()))


def latest(vectors: DataFrame, key: str, order: str) -> DataFrame:
    """Of several rows of a key the one of the highest `order`: the last write wins."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return vectors.withColumn("lg_row", F.row_number().over(last)).where("lg_row = 1").drop("lg_row")


def search(vectors: DataFrame, query: Sequence[float], k: int = 20, id_col: str = "id", vector: str = "vector") -> DataFrame:
    """(id, score) of the k vectors of highest cosine with `query`, ties by id.

    Exhaustive: one pass over the vectors in the JVM, of which each task keeps
    its own best k; the best of these are taken at the end.
    """
    q = np.asarray(query, float)
    q = q / (np.sqrt((q * q).sum()) + EPSILON)
    rows = usable(vectors, id_col, vector, len(q))
    score = dot(F.col("vec"), F.lit(q.tolist())) / (norm(F.col("vec")) + EPSILON)
    return rows.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def _top(ids: np.ndarray, others: np.ndarray, s: np.ndarray, k: int) -> pd.DataFrame:
    """The k highest of each row of s, ties by the other's id, without the row itself."""
    s = np.where(ids[:, None] == others[None], -np.inf, s)
    keep = min(k, s.shape[1])
    cut = -np.partition(-s, keep - 1, axis=1)[:, keep - 1] if keep else np.zeros(len(s))
    i, j = np.nonzero((s >= cut[:, None]) & np.isfinite(s))
    order = np.lexsort((others[j], -s[i, j], i))
    i, j = i[order], j[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    i, j = i[rank < k], j[rank < k]
    return pd.DataFrame({"id": ids[i], "near": others[j], "score": s[i, j]})


EDGE = T.StructType([T.StructField("id", T.LongType()), T.StructField("near", T.LongType()), T.StructField("score", T.DoubleType())])


def knn_join(vectors: DataFrame, k: int = 9, id_col: str = "id", vector: str = "vector") -> DataFrame:
    """(id, near, score): for each vector its k nearest others by cosine, ties by id.

    The vector itself is left out by its id.  A matrix of BROADCAST_BYTES at
    most is broadcast and met once by each batch; a larger one is dealt into
    lists (`listed_knn`).  Either way no task holds more than MOST_SCORES scores.
    """
    rows = usable(vectors, id_col, vector)
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    if n * dim * 8 > BROADCAST_BYTES:
        return listed_knn(rows, n, dim, k)
    whole = rows.toArrow()
    ids = whole["id"].to_numpy()
    kept = rows.sparkSession.sparkContext.broadcast((ids, matrix(whole["vec"].combine_chunks(), dim) if n else np.zeros((0, 1))))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, y = kept.value
        step = max(1, min(1024, MOST_SCORES // len(ids)))
        for pdf in batches:
            for i in range(0, len(pdf), step):
                part = pdf.iloc[i : i + step]
                x = np.stack(part["vec"].to_numpy()).astype(float)
                x /= np.sqrt((x * x).sum(1, keepdims=True)) + EPSILON
                yield _top(part["id"].to_numpy(), ids, x @ y.T, k)

    spread = max(1, min(rows.sparkSession.sparkContext.defaultParallelism, n // 256))
    return rows.repartition(spread, "id").mapInPandas(near, EDGE)


def centres(x: np.ndarray, k: int) -> np.ndarray:
    """Centres of k groups of the rows, by a few rounds of k-means."""
    rng = np.random.default_rng(3)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = nearest_of(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0][:, None]
    return c


def nearest_of(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half, step = (c * c).sum(1) / 2, max(1, MOST_SCORES // len(c))
    return np.concatenate([np.argmax(x[i : i + step] @ c.T - half, 1) for i in range(0, len(x), step)])


def met(asking: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """EDGE rows: for each of `asking` (id, list, vec) its k nearest among each chunk of the members of that list."""
    chunk = lambda df: F.ceil(F.count("*") / CHUNK).cast("int")
    sizes = asking.groupBy("list").agg(chunk(asking).alias("is")).join(members.groupBy("list").agg(chunk(members).alias("js")), "list")
    part, every = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = asking.join(sizes, "list").select("list", part("is").alias("i"), every("js").alias("j"), "id", "vec", F.lit(True).alias("asks"))
    two = members.join(sizes, "list").select("list", every("is").alias("i"), part("js").alias("j"), "id", "vec", F.lit(False).alias("asks"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy()
        if asks.all() or not asks.any():
            return pd.DataFrame({"id": [], "near": [], "score": []})
        ids, x = pdf["id"].to_numpy(), np.frombuffer(b"".join(pdf["vec"])).reshape(len(pdf), -1)
        step = max(1, MOST_SCORES // int((~asks).sum()))
        at = np.flatnonzero(asks)
        return pd.concat([_top(ids[at[i : i + step]], ids[~asks], x[at[i : i + step]] @ x[~asks].T, k) for i in range(0, len(at), step)])

    return one.unionByName(two).groupBy("list", "i", "j").applyInPandas(meet, EDGE)


def best_edges(edges: DataFrame, k: int) -> DataFrame:
    first = Window.partitionBy("id").orderBy(F.desc("score"), "near")
    return edges.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).drop("r")


def first_ids(rows: DataFrame, k: int) -> list[int]:
    """The k + 1 smallest ids."""
    return [r["id"] for r in rows.orderBy("id").limit(k + 1).select("id").collect()]


def listed_knn(rows: DataFrame, n: int, dim: int, k: int) -> DataFrame:
    """kNN without loss from lists around centres, each with a covering radius.

    Each vector first meets those of its own list, which bounds how far its k
    nearest can be.  It then visits those lists alone whose ball reaches within
    that distance.  Vectors of length zero have cosine 0 with all: they are in
    no list.
    """
    spark = rows.sparkSession
    lists = max(1, min(LISTS, n // LIST))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(FIT * lists).select("vec").toArrow()["vec"].combine_chunks()
    x = matrix(sample, dim)
    x = x[np.abs(x).sum(1) > 0]
    kept = spark.sparkContext.broadcast(centres(x, lists) if len(x) else np.zeros((1, dim)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1), dim)
                at = nearest_of(x, kept.value)
                away = np.sqrt(((x - kept.value[at]) ** 2).sum(1))
                at = np.where(np.abs(x).sum(1) > 0, at, -1)
                columns = [batch.column(0), pa.array(at.astype(np.int32)), pa.array(away), pa.array([v.tobytes() for v in x], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "list", "away", "vec"])

    placed = stash(rows.mapInArrow(place, "id long, list int, away double, vec binary"))
    members = placed.where("list >= 0")
    radius = np.full(len(kept.value), -np.inf)
    for r in members.groupBy("list").agg(F.max("away").alias("r")).collect():  # LISTS at most
        radius[r["list"]] = r["r"]
    radii = spark.sparkContext.broadcast(radius)
    own = stash(best_edges(met(members, members, k), k))
    least = own.groupBy("id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, r = kept.value, radii.value
        for whole in batches:
            step = max(1, MOST_SCORES // len(c))
            for i in range(0, len(whole), step):
                pdf = whole.iloc[i : i + step]
                x = np.frombuffer(b"".join(pdf["vec"])).reshape(len(pdf), -1)
                far = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0))
                reach = np.sqrt(np.maximum(2 - 2 * pdf["least"].fillna(-1.0).to_numpy(), 0))  # a cosine is -1 at least
                near = far - r <= reach[:, None] + 1e-6
                near[np.arange(len(pdf)), pdf["list"].to_numpy()] = False
                row, at = np.nonzero(near)
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[row], "list": at.astype(np.int32), "vec": pdf["vec"].to_numpy()[row]})

    asking = stash(members.join(least, "id", "left").select("id", "list", "vec", "least").mapInPandas(visits, "id long, list int, vec binary"))
    edges = own.unionByName(met(asking, members, k))
    # Of all vectors, and of those of length zero, the smallest ids: k + 1 are enough.
    zero = placed.where("list < 0")
    nulls, smallest = first_ids(zero, k), first_ids(placed, k)
    if nulls:
        to = lambda ids: F.explode(F.array(*[F.lit(i).cast("long") for i in ids])).alias("near")
        low = members.join(least, "id", "left").where("least IS NULL OR least <= 0").select("id", to(nulls), F.lit(0.0).alias("score"))
        edges = edges.unionByName(low).unionByName(zero.select("id", to(smallest), F.lit(0.0).alias("score")).where("id <> near"))
    return best_edges(edges, k)


def threshold_clusters(vectors: DataFrame, threshold: float, k: int = 9, id_col: str = "id", vector: str = "vector") -> DataFrame:
    """(id, component): components of the graph that has an edge where one of two vectors is among the other's k nearest and the cosine is `threshold` or more.

    Every usable vector is returned; component is the smallest id of its group.
    """
    return edge_clusters(usable(vectors, id_col, vector), knn_join(vectors, k, id_col, vector), threshold)


def edge_clusters(rows: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """(id, component) of the ids of `rows`, joined by edges (id, near, score) of `threshold` or more."""
    groups = connected_components(stash(edges.where(F.col("score") >= threshold)), "id", "near")
    return rows.select("id").distinct().join(groups, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def dense_ids(groups: DataFrame, component: str = "component") -> DataFrame:
    """(component, cluster_id): clusters numbered from 0 by their smallest id."""
    only = groups.select(component).distinct()
    return number(only, [component], 0).withColumnRenamed("number", "cluster_id")


def number(df: DataFrame, order: Sequence[str], start: int = 1) -> DataFrame:
    """`df` with consecutive numbers from `start` in the order of `order`, without sending all rows to one task.

    Rows are range-partitioned and numbered within; the partitions' sizes, one
    row each, give the offsets.
    """
    placed = stash(df.repartitionByRange(*order).withColumn("lg_part", F.spark_partition_id()))
    sizes = placed.groupBy("lg_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("lg_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("lg_part", before.alias("lg_before"))  # as many rows as partitions
    own = F.row_number().over(Window.partitionBy("lg_part").orderBy(*order))
    return placed.join(F.broadcast(sizes), "lg_part").withColumn("number", (F.col("lg_before") + own + start - 1).cast("long")).drop("lg_part", "lg_before")
