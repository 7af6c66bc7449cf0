"""Embedding near-dedup: an inverted file with product-quantised residuals, exact cosine last."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigraph.operators.components import connected_components
from lumigraph.sources.tables import stash, table

COSINE = 0.98
#: Vectors that centroids and codebooks are fitted on, at most; rows of a label in one list, about; lists, at least and at most (all are broadcast).
SAMPLE, PER_LIST, LISTS = 65_536, 512, (4, 8_192)
#: Subspaces, codewords of each, and rounds of k-means.
SUBSPACES, CODEWORDS, ROUNDS = 8, 64, 8
#: Rows of a list, on either side, that one task holds at once.
CHUNK = 2_048


def scaled(rows: pa.Array, width: int) -> np.ndarray:
    """Vectors of one length as doubles, each times a power of two that brings its largest element near 1: cosines stay what they are to the last bit."""
    x = rows.cast(pa.large_list(pa.float64())).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0][:, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c**2).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, 1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class Index:
    """Coarse centroids and, for each subspace, codewords of the residuals."""

    def __init__(self, x: np.ndarray, lists: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.width = x.shape[1]
        self.coarse = kmeans(x, lists, rng)
        rest = x - self.coarse[nearest(x, self.coarse)]
        self.cuts = np.linspace(0, self.width, min(SUBSPACES, self.width) + 1).astype(int)
        self.books = [kmeans(rest[:, a:b], CODEWORDS, rng) for a, b in zip(self.cuts, self.cuts[1:])]

    def encode(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, distance of each vector from what its list and codes stand for)."""
        rest = x - self.coarse[at]
        codes = np.stack([nearest(rest[:, a:b], w) for a, b, w in zip(self.cuts, self.cuts[1:], self.books)], 1).astype(np.uint8)
        error = sum(((rest[:, a:b] - w[codes[:, i]]) ** 2).sum(1) for i, (a, b, w) in enumerate(zip(self.cuts, self.cuts[1:], self.books)))
        return codes, np.sqrt(error)

    def probes(self, x: np.ndarray, at: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the lists before its own list `at` that can hold a vector within `radius` of each of `x`.

        What lies in another list is no nearer than the plane halfway between
        the two centroids.  Of two lists the later one's vectors look in the
        earlier one, so that each pair is looked at once.
        """
        size = (self.coarse**2).sum(1)
        d = size - 2 * x @ self.coarse.T
        gap = np.sqrt(np.maximum(size[at][:, None] + size - 2 * self.coarse[at] @ self.coarse.T, 0))
        near = d - d[np.arange(len(x)), at][:, None] <= 2 * gap * radius + 1e-6
        return np.nonzero(near & (np.arange(len(size)) < at[:, None]))

    def tables(self, x: np.ndarray, at: int) -> list[np.ndarray]:
        """For each subspace the squared distances of queries' residuals from all codewords."""
        rest = x - self.coarse[at]
        return [((rest[:, None, a:b] - w[None]) ** 2).sum(2).astype(np.float32) for a, b, w in zip(self.cuts, self.cuts[1:], self.books)]

    def far(self, x: np.ndarray, at: int, code: np.ndarray) -> np.ndarray:
        """Squared distances of queries from what the codes of members of list `at` stand for, as sums of table entries."""
        return sum(t[:, code[:, k]] for k, t in enumerate(self.tables(x, at)))


class Trivial(Index):
    """One list around zero and one code, for lengths that the sample lacks: all of a label are compared."""

    def __init__(self, width: int):
        self.width, self.coarse, self.cuts, self.books = width, np.zeros((1, width)), np.array([0, width]), [np.zeros((1, width))]


def _index(known: dict[int, Index], width: int) -> Index:
    return known.get(width) or Trivial(width)


HOME = "id long, `group` string, copies long, list int, error double, code binary, vec binary, probes array<int>"


def _homes(known, radius: float):
    """Rows (id, group, copies, embedding) with their list, codes and coding error, and the other lists that a neighbour may be in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                part = whole.slice(i, 1024)
                widths = part.column("embedding").value_lengths().to_numpy()
                for width in np.unique(widths).tolist():
                    batch = part.filter(pa.array(widths == width))
                    index = _index(known.value, width)
                    vec = scaled(batch.column("embedding"), width)
                    x = unit(vec)
                    at = nearest(x, index.coarse)
                    codes, error = index.encode(x, at)
                    row, lists = index.probes(x, at, radius)
                    ends = np.append(0, np.cumsum(np.bincount(row, minlength=len(x))))
                    probes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(lists, pa.int32()))
                    columns = [batch.column(c) for c in ("id", "group", "copies")]
                    columns += [pa.array(at, pa.int32()), pa.array(error), pa.array([v.tobytes() for v in codes], pa.binary()), pa.array([v.tobytes() for v in vec], pa.binary()), probes]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "group", "copies", "list", "error", "code", "vec", "probes"])

    return run


def _tasks(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """What `work` makes of the rows of each (group, list, i, j), which come one after another."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = np.zeros(batch.num_rows - 1, bool)
        for c in ("group", "list", "i", "j"):
            column = batch.column(c)
            cut |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(cut) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            own = tuple(batch.column(c)[a].as_py() for c in ("group", "list", "i", "j"))
            if own != key:
                if held and (out := work(*key[:2], pa.Table.from_batches(held))):
                    yield out
                key, held = own, []
            held.append(batch.slice(a, b - a))
    if held and (out := work(*key[:2], pa.Table.from_batches(held))):
        yield out


def _matrix(blobs: pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    """Rows of a column of byte strings of one length."""
    return np.frombuffer(b"".join(blobs.to_pylist()), kind).reshape(len(blobs), -1)


#: Slack of bounds against rounding: table entries have 24 bits.
SLACK = 1e-5


def _survivors(known, radius: float):
    """(group, list, id): vectors of other lists, given by their codes alone, that a vector at home in the list may be near.

    A vector y that codes for z with error e is within the radius of x only if
    |x - z| <= radius + e, and |x - z| is a sum of table entries.
    """

    def work(group: str, at: int, rows: pa.Table) -> pa.RecordBatch | None:
        home, away = rows.filter(pc.is_valid(rows["vec"])), rows.filter(pc.is_null(rows["vec"]))
        if not len(home) or not len(away):
            return None
        x, code, origin = unit(_matrix(home["vec"])), _matrix(away["code"], np.uint8), away["origin"].to_numpy()
        index, reach = _index(known.value, x.shape[1]), ((radius + away["error"].to_numpy()) ** 2 + SLACK).astype(np.float32)
        keep = np.zeros(len(away), bool)
        for place in np.unique(origin).tolist():
            own = np.flatnonzero(origin == place)
            for i in range(0, len(x), 256):
                keep[own] |= (index.far(x[i : i + 256], place, code[own]) <= reach[own]).any(0)
        n = int(keep.sum())
        return pa.RecordBatch.from_arrays([pa.array([group] * n, pa.string()), pa.array([at] * n, pa.int32()), pa.array(away["id"].to_numpy()[keep])], ["group", "list", "id"])

    return lambda batches: _tasks(batches, work)


def _compare(known, cosine: float, radius: float):
    """For each (group, list, i, j): links of the vectors of chunk j, some of them from other lists, with the members of chunk i.

    The same bound on table distances decides whose exact cosine is taken.
    Gives rows (id, links, other): links found for id, and one neighbour to
    reach each component of the chunk by.
    """

    def links(_: str, at: int, rows: pa.Table) -> pa.RecordBatch | None:
        home, ask = rows.filter(rows["member"]), rows.filter(pc.invert(rows["member"]))
        if not len(home) or not len(ask):
            return None
        members, y, code = home["id"].to_numpy(), _matrix(home["vec"]), _matrix(home["code"], np.uint8)
        asking, x, foreign = ask["id"].to_numpy(), _matrix(ask["vec"]), ask["foreign"].to_numpy()
        copies = dict(zip([*members.tolist(), *asking.tolist()], [*home["copies"].to_pylist(), *ask["copies"].to_pylist()], strict=True))
        index, size = _index(known.value, y.shape[1]), (y * y).sum(1)
        reach = ((radius + home["error"].to_numpy()) ** 2 + SLACK).astype(np.float32)
        root: dict[int, int] = {}
        count: dict[int, int] = {}

        def find(a: int) -> int:
            while root.setdefault(a, a) != a:
                root[a] = root[root[a]]
                a = root[a]
            return a

        for i in range(0, len(ask), 256):
            z, ids = x[i : i + 256], asking[i : i + 256]
            q, m = np.nonzero((index.far(unit(z), at, code) <= reach) & (foreign[i : i + 256, None] | (ids[:, None] < members)))
            for k in range(0, len(q), 1 << 16):
                a, b = q[k : k + (1 << 16)], m[k : k + (1 << 16)]
                hit = np.flatnonzero((z[a] * y[b]).sum(1) / np.sqrt((z[a] * z[a]).sum(1) * size[b]) >= cosine)
                for s, t in zip(ids[a[hit]].tolist(), members[b[hit]].tolist(), strict=True):
                    count[s] = count.get(s, 0) + copies[t]
                    count[t] = count.get(t, 0) + copies[s]
                    s, t = sorted((find(s), find(t)))
                    root[t] = s
        if not count:
            return None
        ids = list(count)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([count[r] for r in ids], pa.int64()), pa.array([find(r) for r in ids], pa.int64())], ["id", "links", "other"])

    return lambda batches: _tasks(batches, links)


def _dealt(members: DataFrame, others: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of both sides with (i, j): each chunk i of a list's members meets each chunk j of its others."""
    count = lambda df, name: df.groupBy("group", "list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias(name))
    sizes = count(members, "is").join(count(others, "js"), ["group", "list"])
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = members.join(sizes, ["group", "list"]).select("group", "list", part("is").alias("i"), every("js").alias("j"), *columns)
    two = others.join(sizes, ["group", "list"]).select("group", "list", every("is").alias("i"), part("js").alias("j"), *columns)
    return one.unionByName(two).repartition("group", "list", "i", "j").sortWithinPartitions("group", "list", "i", "j", "id")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of `vectors` (vec_id, embedding, label).

    Rows of one label and one length link at a cosine of `cosine` or more, in
    double precision; a cosine that comes out at exactly `cosine` links.  Equal
    vectors of a label collapse first; a class of copies costs one row.
    Centroids and codebooks are fitted, for each length, on at most `sample`
    vectors, taken by hash; every vector is indexed and looked up.  Both the
    lists probed and the table distances that pass follow from exact bounds
    (the plane between two centroids, and the triangle inequality with each
    row's own coding error), so that no link is lost.  To other lists go codes
    first; the vectors follow for those alone that some vector there may be
    near.  Lists of more than CHUNK rows are dealt into chunks, and each pair
    of chunks has its task.  Tasks return counts and spanning links, never all
    pairs.

    Null, zero or non-finite vectors, ones with null components, and rows with
    a null label or vec_id link with nothing: n_links 0, own component (null
    vec_id: null component, not kept).  Repeated rows of a vec_id count as
    further vectors and give a row each.  An empty table gives no rows; extra
    columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    group = F.when(F.coalesce(usable & finite, F.lit(False)), F.concat(F.size("embedding").cast("string"), F.lit(":"), "label"))
    rows = rows.select("vec_id", "embedding", group.alias("group"))
    one, two = F.xxhash64("group", "embedding"), F.xxhash64(F.lit(1), "group", "embedding")
    good = rows.where(F.col("group").isNotNull())
    classes = good.groupBy("group", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = stash(classes.select("*", one.alias("h1"), two.alias("h2"), F.monotonically_increasing_id().alias("id")))
    total, groups = classes.agg(F.count("*"), F.approx_count_distinct("group")).first()
    known: dict[int, Index] = {}
    if total:
        chosen = classes.orderBy("h1", "h2").limit(sample).select("embedding").toArrow()["embedding"].combine_chunks()
        widths = chosen.value_lengths().to_numpy()
        for width, n in zip(*np.unique(widths, return_counts=True), strict=True):
            x = unit(scaled(chosen.filter(pa.array(widths == width)), int(width)))
            lists = int(total * n / len(widths) / groups / PER_LIST)
            known[int(width)] = Index(x, max(1, min(max(lists, LISTS[0]), LISTS[1], n // 8)))
    index = spark.sparkContext.broadcast(known)
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))

    home = stash(classes.select("id", "group", "copies", "embedding").mapInArrow(_homes(index, radius), HOME))
    at_home = home.select("group", "list", "id", F.lit(None).cast("int").alias("origin"), "error", "code", "vec")
    away = home.select("group", F.col("list").alias("origin"), "id", "error", "code", F.lit(None).cast("binary").alias("vec"), F.explode("probes").alias("list"))
    tasks = _dealt(at_home, away, ["id", "origin", "error", "code", "vec"])
    asking = stash(tasks.mapInArrow(_survivors(index, radius), "`group` string, list int, id long").distinct())
    members = home.select("group", "list", "id", "copies", "error", "code", "vec", F.lit(True).alias("member"), F.lit(False).alias("foreign"))
    asking = asking.join(home.select("id", "copies", "error", "code", "vec"), "id").withColumn("foreign", F.lit(True))
    asking = asking.unionByName(members.drop("member")).withColumn("member", F.lit(False))
    tasks = _dealt(members, asking, ["id", "copies", "error", "member", "foreign", "code", "vec"])
    links = stash(tasks.mapInArrow(_compare(index, cosine, radius), "id long, links long, other long"))
    found = connected_components(links, "id", "other").join(classes.select("id", "least"), "id")
    least = found.groupBy("component").agg(F.min("least").alias("component_id"))
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    found = found.join(least, "component").select("id", "component_id").join(counts, "id", "left")
    n_links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    of = classes.join(found, "id", "left").select("h1", "h2", F.coalesce("component_id", "least").alias("component_id"), n_links.alias("n_links"))
    linked = good.select("vec_id", one.alias("h1"), two.alias("h2")).join(of, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(F.col("group").isNull()).select("vec_id", F.lit(0).cast("long"), "vec_id")
    out = linked.union(alone)
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
c AS (SELECT x, min(y) AS c FROM reach GROUP BY x), n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.c AS component_id, vec_id = c.c AS kept
FROM v LEFT JOIN n ON n.x = vec_id JOIN c ON c.x = vec_id
"""
