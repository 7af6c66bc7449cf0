"""Queries that run the commands and the catalog over a library made of the tables of a data folder, each with its SQL.

Files are made below the shared folder: a document's text stands for a picture
that can't be decoded, a vector's elements are the grey pixels of one that can.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigraph.functions.pixels import png, png_pixels
from lumigraph.operators import components, similarity
from lumigraph.operators.code_index import CodeIndex
from lumigraph.operators.tagging import LABELS
from lumigraph.operators.vector_index import VectorIndex
from lumigraph.plans import queries as plain
from lumigraph.plans.engine import Engine
from lumigraph.plans.queries import BITS, COSINE, NEAR, SIM, codes, faces, persons, photos, vectors
from lumigraph.sources.catalog import Catalog
from lumigraph.sources.sink import put_files
from lumigraph.sources.tables import stash, table, work_dir

LEVEL = 127.5
#: The vectors that PixelEmbedder makes of the pictures.
PIXELS = f"SELECT vec_id AS id, list_transform(embedding, lambda x: floor((x::DOUBLE + 1) * {LEVEL}) - {LEVEL}) AS v FROM embeddings"


class PixelEmbedder:
    """Vectors of pictures of 8 by 8 grey pixels: their levels around the middle; text i of the default labels looks at pixel i alone."""

    dim = 64

    def images(self, contents: list[bytes]) -> np.ndarray:
        return np.array([png_pixels(c)[..., 0].ravel() - LEVEL for c in contents], "float32").reshape(-1, self.dim)

    def texts(self, texts: list[str]) -> np.ndarray:
        return np.eye(self.dim)[[LABELS.index(t) for t in texts]]


class PixelDetector:
    """Four faces in each picture, of which the first four pixels say how sure they are; the second has no extent."""

    def faces(self, contents: list[bytes]) -> list[list[dict]]:
        found = PixelEmbedder().images(contents)
        return [[{"bbox": (k, 0, 4 * (k != 1), 4), "embedding": v.tolist(), "score": float(abs(v[k])) / LEVEL} for k in range(4)] for v in found]


def pictures(spark: SparkSession, d: str, folder: str, where: str = "true") -> None:
    """A PNG file v<id>.png of each vector."""
    grey = F.transform("vector", lambda x: F.floor((x.cast("double") + 1) * LEVEL).cast("int"))

    def draw(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"name": [f"v{i}.png" for i in pdf["id"]], "content": [png(np.repeat(np.array(x).reshape(8, 8, 1), 3, 2)) for x in pdf["grey"]]})

    put_files(vectors(spark, d).where(where).select("id", grey.alias("grey")).mapInPandas(draw, "name string, content binary"), folder)


def analyzed(spark: SparkSession, d: str) -> Engine:
    """A library of the vectors' pictures, scanned and analysed."""
    root = work_dir(spark)
    pictures(spark, d, f"{root}/in")
    engine = Engine(spark, f"{root}/library")
    engine.scan(f"{root}/in")
    engine.analyze(PixelEmbedder())
    return engine


def named(engine: Engine) -> DataFrame:
    """(photo_id, vec_id) of the photos."""
    return engine.tables.read("photos").select(F.col("id").alias("photo_id"), F.regexp_extract("file_path", r"v(\d+)\.png$", 1).cast("long").alias("vec_id"))


def _texts(spark: SparkSession, d: str, folder: str, where: str) -> None:
    put_files(table(spark, d, "documents").where(where).select(F.format_string("%s/doc_%d.jpg", "source", "doc_id"), F.encode("text", "utf-8")), folder)


def engine_scan(spark: SparkSession, d: str) -> DataFrame:
    """Files scanned twice, the second time with more of them and some changed: path, size and checksum of each, in the order of ids."""
    root = work_dir(spark)
    engine = Engine(spark, f"{root}/library")
    _texts(spark, d, f"{root}/in", "length(text) > 0 AND doc_id % 3 <> 0")
    engine.scan(f"{root}/in")
    _texts(spark, d, f"{root}/in", "length(text) > 0 AND doc_id % 3 = 0")
    engine.scan(f"{root}/in")
    out = engine.tables.read("photos").withColumn("path", F.regexp_extract("file_path", r"([^/]+/[^/]+)$", 1))
    return out.select("path", "size", "checksum", "phash", "exif_datetime", F.length("created_at").alias("stamp"))


def engine_scan_counts(spark: SparkSession, d: str) -> DataFrame:
    """What a scan, one after files came, one after nothing came, and one from scratch report."""
    root = work_dir(spark)
    engine, counts = Engine(spark, f"{root}/library"), []
    for where in ("id % 4 <> 0", "id % 4 = 0", "false"):
        pictures(spark, d, f"{root}/in", where)
        counts.append(engine.scan(f"{root}/in"))
    counts.append(engine.scan(f"{root}/in", incremental=False))
    return spark.createDataFrame([(k, *c) for k, c in enumerate(counts)], "turn long, indexed long, skipped long")


def engine_hashes(spark: SparkSession, d: str) -> DataFrame:
    engine = analyzed(spark, d)
    return engine.tables.read("photos").join(named(engine).withColumnRenamed("photo_id", "id"), "id").select(F.col("vec_id").alias("id"), "phash")


def engine_tags(spark: SparkSession, d: str) -> DataFrame:
    """Five of the default labels for each photo."""
    engine = analyzed(spark, d)
    tags = engine.tables.read("tags").join(named(engine), "photo_id")
    rank = F.row_number().over(similarity.Window.partitionBy("photo_id").orderBy("id"))
    return tags.select(F.col("vec_id").alias("id"), rank.alias("rank"), "tag", F.round("score", 6).alias("score"))


def engine_embeddings(spark: SparkSession, d: str) -> DataFrame:
    engine = analyzed(spark, d)
    read = engine.tables.read("embeddings").where("size(vector) = dim").join(named(engine), "photo_id")
    return read.select(F.col("vec_id").alias("id"), "dim", F.posexplode("vector").alias("i", "x")).select("id", "dim", F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"))


def engine_search(spark: SparkSession, d: str) -> DataFrame:
    """The twenty photos nearest to the first one, from the stored index."""
    engine = analyzed(spark, d)
    first = engine.tables.read("embeddings").join(named(engine), "photo_id").orderBy("vec_id").first()["vector"]
    hits = engine.search(list(first), 20, stored=True).withColumnRenamed("id", "photo_id").join(named(engine), "photo_id")
    return hits.select(F.col("vec_id").alias("id"), F.round("score", 6).alias("score"))


def engine_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters by the stored neighbours, named by their smallest vector."""
    engine = analyzed(spark, d)
    engine.cluster(COSINE, NEAR + 1, stored=True)
    clusters = engine.tables.read("clusters").join(named(engine), "photo_id")
    first = clusters.groupBy("cluster_id").agg(F.min("vec_id").alias("component"))
    return clusters.join(first, "cluster_id").select(F.col("vec_id").alias("id"), "component")


def engine_faces(spark: SparkSession, d: str) -> DataFrame:
    """Faces that are sure enough, with their persons: one for each group of near embeddings."""
    engine = analyzed(spark, d)
    engine.faces_detect(PixelDetector(), min_score=0.1)
    shown = engine.faces_list().join(named(engine), "photo_id")
    return shown.select(F.col("vec_id").alias("id"), "face_index", "person")


def engine_gallery(spark: SparkSession, d: str) -> DataFrame:
    """What the pages say of each photo, and the sizes of its thumbnail and of the crops of its faces."""
    engine = analyzed(spark, d)
    engine.faces_detect(PixelDetector(), min_score=0.1)
    out = f"{work_dir(spark)}/gallery"
    engine.export(out)
    name = F.regexp_extract("value", r'"thumb": "thumbs/\d+_(v\d+\.png)\.png", "tags"', 1).alias("name")
    rows = spark.read.text(out, pathGlobFilter="*.html").select(name).where("name <> ''")
    image = lambda folder: spark.read.format("image").load(f"{out}/{folder}").select("image.*")
    thumbs = image("thumbs").select(F.regexp_extract("origin", r"_(v\d+\.png)\.png$", 1).alias("name"), "width")
    crops = image("faces").select(F.regexp_extract("origin", r"face_(\d+)\.png$", 1).cast("long").alias("face_id"), F.col("width").alias("crop"))
    faces = engine.tables.read("faces").select(F.col("id").alias("face_id"), "photo_id").join(crops, "face_id").join(named(engine), "photo_id")
    faces = faces.groupBy(F.format_string("v%d.png", "vec_id").alias("name")).agg(F.count("*").alias("crops"), F.max("crop").alias("crop"))
    none = F.lit(0)
    shown = rows.join(thumbs, "name").join(faces, "name", "left")
    return shown.select("name", "width", F.coalesce("crops", none).cast("long").alias("crops"), F.coalesce("crop", none).alias("crop"))


def engine_commands(spark: SparkSession, d: str) -> DataFrame:
    """What commands report: photos analysed, again, anew; faces; rows of a page, by its limit; faces named by hand."""
    root, embed = work_dir(spark), PixelEmbedder()
    pictures(spark, d, f"{root}/in")
    engine = Engine(spark, f"{root}/library")
    engine.scan(f"{root}/in")
    out = [("analyze 100", engine.analyze(embed, limit=100)), ("analyze", engine.analyze(embed)), ("analyze again", engine.analyze(embed))]
    out += [("analyze anew", engine.analyze(embed, incremental=False, tag_k=2))]
    out += [("tags", engine.tables.read("tags").count()), ("embeddings", engine.tables.read("embeddings").count()), ("browse", engine.browse(300).count())]
    out += [("faces", engine.faces_detect(PixelDetector(), min_score=0.0)), ("faces again", engine.faces_detect(PixelDetector(), min_score=0.0))]
    engine.faces_tag(3, "Ann")
    engine.faces_tag(10**9, "Nobody")
    out += [("named", engine.faces_list().where("person = 'Ann'").count()), ("persons", engine.tables.read("persons").count()), ("files missing", sum(engine.scan(f"{root}/none")))]
    return spark.createDataFrame(out, "command string, n long")


def _catalog(spark: SparkSession) -> Catalog:
    tables = Catalog(spark, f"{work_dir(spark)}/catalog")
    tables.init()
    return tables


def _as(tables: Catalog, name: str, rows: DataFrame) -> DataFrame:
    """`rows` with all columns of a table, nulls where they have none."""
    kinds = {f.name: f.dataType for f in tables.read(name).schema}
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()])


def catalog_upsert_photos(spark: SparkSession, d: str) -> DataFrame:
    """Photos put into a stored table: only the parts that they touch are written."""
    tables, old = _catalog(spark), plain._stored(spark, d)
    tables.write("photos", _as(tables, "photos", old))
    new = plain.changed(photos(spark, d).drop("id"), old)
    tables.put("photos", _as(tables, "photos", new).drop("id"), ["file_path"], "id")
    return tables.read("photos").select("id", "file_path", "size", "checksum")


def catalog_upsert_faces(spark: SparkSession, d: str) -> DataFrame:
    tables = _catalog(spark)
    tables.write("faces", _as(tables, "faces", faces(spark, d).where("id % 2 = 0")))
    new = faces(spark, d).where("photo_id % 3 = 0").select("photo_id", "face_index", F.lit(None).cast("long").alias("person_id"))
    tables.put("faces", _as(tables, "faces", new).drop("id"), ["photo_id", "face_index"], "id")
    return tables.read("faces").select("id", "photo_id", "face_index", "person_id")


def catalog_set_person(spark: SparkSession, d: str) -> DataFrame:
    tables = _catalog(spark)
    tables.write("faces", _as(tables, "faces", faces(spark, d)))
    tables.assign("faces", spark.createDataFrame([(7, 3), (14, None), (10_000_000, 1)], "id long, person_id long"), "id", "person_id")
    return tables.read("faces").select("id", "photo_id", "face_index", "person_id")


def catalog_append_embeddings(spark: SparkSession, d: str) -> DataFrame:
    tables, v = _catalog(spark), vectors(spark, d).select("id", F.col("id").alias("photo_id"))
    tables.write("embeddings", _as(tables, "embeddings", v))
    tables.append("embeddings", _as(tables, "embeddings", v.where("id % 4 = 0")).drop("id"), ["photo_id"])
    return tables.read("embeddings").select("id", "photo_id")


def catalog_retag(spark: SparkSession, d: str) -> DataFrame:
    tables = _catalog(spark)
    old = photos(spark, d).select("id", F.col("id").alias("photo_id"), F.lit("old").alias("tag"), F.lit(1.0).alias("score"))
    tables.write("tags", old)
    new = plain._tags(spark, d).where("rank = 1 AND id % 4 = 0").select(F.col("id").alias("photo_id"), "tag", F.round("score", 6).alias("score"))
    tables.replace("tags", new, "photo_id", vectors(spark, d).where("id % 2 = 0").select(F.col("id").alias("photo_id")), ["photo_id"])
    return tables.read("tags").select("photo_id", "tag", "score")


def catalog_get_or_create(spark: SparkSession, d: str) -> DataFrame:
    tables = _catalog(spark)
    tables.write("persons", persons(spark, d))
    tables.put("persons", table(spark, d, "region").select(F.col("r_name").alias("name")).unionByName(persons(spark, d).select("name")), ["name"], "id")
    return tables.read("persons")


def _thirds(df: DataFrame, key: str = "id") -> list[DataFrame]:
    """Three batches of rows."""
    return [df.where(F.pmod(F.xxhash64(key), F.lit(3)) == k) for k in range(3)]


def indexed_topk(spark: SparkSession, d: str) -> DataFrame:
    """The top twenty from lists near the query, in an index that grew in three batches."""
    v, index = vectors(spark, d), VectorIndex(spark, work_dir(spark))
    for part in _thirds(v):
        index.add(part, lists=32)
    hits = index.search(v.orderBy("id").select("vector").first()["vector"], 20)
    return hits.join(photos(spark, d).select("id", "file_path"), "id").select("id", "file_path", F.round("score", 6).alias("score"))


def indexed_knn_edges(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours kept while vectors come in three batches."""
    index = VectorIndex(spark, work_dir(spark), k=NEAR)
    for part in _thirds(vectors(spark, d)):
        index.add(part, lists=32)
    return index.neighbours().where(F.col("score") >= COSINE).select("id", "near", F.round("score", 6).alias("score"))


def indexed_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Groups of near codes that came in three batches, each compared with what was there."""
    index = CodeIndex(spark, work_dir(spark), BITS, expected=1000)
    for part in _thirds(codes(spark, d)):
        index.add(part)
    return index.groups()


def grown_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of users and classes of events, kept while edges come in three batches."""
    edges = table(spark, d, "events").select(F.col("user_id").alias("a"), (F.col("event_id") % 997 + 1_000_000).alias("b")).where("event_id % 50 = 0 OR event_type = 'purchase'")
    known = None
    for part in _thirds(edges, "a"):
        known = stash(components.connected_components(part, "a", "b") if known is None else components.with_edges(known, part, "a", "b"))
    return known


_SHOWN = f"list_transform(range(0, 4), lambda k: round(abs(floor((embedding[k + 1]::DOUBLE + 1) * {LEVEL}) - {LEVEL}) / {LEVEL}, 9) >= 0.1)"
SQL = {
    "engine_scan": """SELECT source || '/doc_' || doc_id || '.jpg' AS path, strlen(text) AS size, sha1(text) AS checksum, '' AS phash, '' AS exif_datetime, 19 AS stamp FROM documents WHERE length(text) > 0""",
    "engine_scan_counts": """WITH n AS (SELECT count(*) FILTER (vec_id % 4 <> 0) AS a, count(*) FILTER (vec_id % 4 = 0) AS b FROM embeddings)
        SELECT unnest([0, 1, 2, 3])::BIGINT AS turn, unnest([a, b, 0, a + b])::BIGINT AS indexed, unnest([0, a, a + b, 0])::BIGINT AS skipped FROM n""",
    "engine_hashes": plain.SQL["pixel_hashes"],
    "engine_tags": f"""WITH p AS ({PIXELS}), s AS (SELECT id, i, v[i] / (sqrt(list_inner_product(v, v)) + 1e-9) / (1 + 1e-9) AS score FROM p, range(1, {len(LABELS) + 1}) t(i)),
        r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, i) AS rank FROM s)
        SELECT id, rank::INT AS rank, {list(LABELS)}[i] AS tag, round(score, 6) AS score FROM r WHERE rank <= 5""",
    "engine_embeddings": f"WITH p AS ({PIXELS}) SELECT id, 64::INT AS dim, i - 1 AS i, v[i] AS x FROM p, range(1, 65) t(i)",
    "engine_search": f"WITH v AS ({PIXELS}) SELECT a.id, round({SIM}, 6) AS score FROM v a, (SELECT v FROM v ORDER BY id LIMIT 1) b ORDER BY {SIM} DESC, a.id LIMIT 20",
    "engine_clusters": f"WITH RECURSIVE {plain.COMPONENTS.replace(plain.VECTORS, PIXELS)} SELECT id, component FROM c",
    "engine_faces": f"SELECT vec_id AS id, k::INT AS face_index, 'Unknown' AS person FROM embeddings, range(0, 4) t(k) WHERE {_SHOWN}[k + 1]",
    "engine_gallery": f"""WITH f AS (SELECT vec_id, count(*) FILTER (k <> 1 AND {_SHOWN}[k + 1]) AS n FROM embeddings, range(0, 4) t(k) GROUP BY vec_id)
        SELECT 'v' || vec_id || '.png' AS name, 8::INT AS width, n AS crops, CASE WHEN n > 0 THEN 160 ELSE 0 END::INT AS crop FROM f""",
    "engine_commands": """WITH n AS (SELECT count(*) AS n FROM embeddings)
        SELECT unnest(['analyze 100', 'analyze', 'analyze again', 'analyze anew', 'tags', 'embeddings', 'browse', 'faces', 'faces again', 'named', 'persons', 'files missing']) AS command,
               unnest([100, n - 100, 0, n, 2 * n, n, least(300, n), 4 * n, 4 * n, 1, 2, 0])::BIGINT AS n FROM n""",
    "catalog_upsert_photos": plain.SQL["upsert_photos"],
    "catalog_upsert_faces": plain.SQL["upsert_faces"],
    "catalog_set_person": plain.SQL["set_face_person"],
    "catalog_append_embeddings": plain.SQL["append_embeddings"],
    "catalog_retag": plain.SQL["retag_replace"],
    "catalog_get_or_create": plain.SQL["get_or_create_person"],
    "indexed_topk": plain.SQL["search_topk"].replace(", printf('%.3f', score) AS shown", ""),
    "indexed_knn_edges": plain.SQL["knn_edges"],
    "indexed_duplicates": plain.SQL["duplicate_groups"],
    "grown_components": """WITH RECURSIVE e AS (SELECT user_id AS a, event_id % 997 + 1000000 AS b FROM events WHERE event_id % 50 = 0 OR event_type = 'purchase'),
        u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
        reach AS (SELECT x, x AS y FROM u UNION SELECT r.x, u.y FROM reach r JOIN u ON r.y = u.x)
        SELECT x AS id, min(y) AS component FROM reach GROUP BY x""",
}

QUERIES = {name: globals()[name] for name in SQL}
