"""The library's operators as queries over the tables of a data folder, each with its SQL.

The folder has no photos; its tables stand for them: a document is a photo, a
vector is a photo's or a face's embedding, its signs are a perceptual hash,
its label names a person or a tag, nations are persons.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigraph.functions.exif import SCHEMA as EXIF
from lumigraph.functions.exif import exif_rows
from lumigraph.functions.pixels import crop, hash_rows, thumbnail
from lumigraph.functions.text import basename, decimal_degrees, exif_timestamp, is_image, iso_seconds, score_text
from lumigraph.functions.vectors import cosine, float_blob, l2_normalize, norm, sign_code
from lumigraph.operators import duplicates, merge, people, similarity, tagging
from lumigraph.sources.catalog import Catalog
from lumigraph.sources.files import changed
from lumigraph.sources.tables import table, work_dir

COSINE, BITS, NEAR = 0.40, 18, 9

PHOTOS = "SELECT doc_id AS id, source || '/' || lang || '/doc_' || doc_id || '.jpg' AS file_path, n_chars AS size, sha1(text) AS checksum FROM documents"
FACES = "SELECT vec_id AS id, vec_id // 2 AS photo_id, (vec_id % 2)::INT AS face_index, CASE WHEN label < 8 THEN label END::BIGINT AS person_id FROM embeddings"
VECTORS = "SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings"
SIM = "list_inner_product(a.v, b.v) / ((sqrt(list_inner_product(a.v, a.v)) + 1e-9) * (sqrt(list_inner_product(b.v, b.v)) + 1e-9))"
KNN = f"""v AS ({VECTORS}), s AS (SELECT a.id, b.id AS near, {SIM} AS score FROM v a JOIN v b ON a.id <> b.id),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, near) AS r FROM s) WHERE r <= {NEAR} AND score >= {COSINE})"""
COMPONENTS = f"""{KNN}, e AS (SELECT id AS x, near AS y FROM k UNION SELECT near, id FROM k),
reach AS (SELECT id AS x, id AS y FROM v UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x),
c AS (SELECT x AS id, min(y) AS component FROM reach GROUP BY x)"""
CODES = "h AS (SELECT vec_id AS id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')::BIT AS code FROM embeddings)"
TAGS = f"""m AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) t(i) GROUP BY label, i) GROUP BY label),
e AS ({VECTORS}), t AS (SELECT a.id, b.label, {SIM} AS score FROM e a, m b),
r AS (SELECT id, label, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS rank FROM t),
tags AS (SELECT id, rank::INT AS rank, 'label_' || label AS tag, score FROM r WHERE rank <= 3)"""


def photos(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".jpg"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), path.alias("file_path"), F.col("n_chars").alias("size"), F.sha1("text").alias("checksum"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("label"))


def faces(spark: SparkSession, d: str) -> DataFrame:
    person = F.when(F.col("label") < 8, F.col("label"))
    return vectors(spark, d).select("id", F.expr("id div 2").alias("photo_id"), (F.col("id") % 2).cast("int").alias("face_index"), person.alias("person_id"))


def persons(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))


def thumbs(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).where("id % 3 = 0").select(F.col("id").alias("face_id"), F.format_string("faces/face_%d.jpg", F.col("id")).alias("thumb_path"))


def codes(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("id", sign_code(F.col("vector")).alias("phash"))


def search_topk(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    first = v.orderBy("id").select("vector").first()
    hits = similarity.search(v, first["vector"], 20)
    return hits.join(photos(spark, d).select("id", "file_path"), "id").select("id", "file_path", F.round("score", 6).alias("score"), score_text(F.col("score")).alias("shown"))


def pending_analysis(spark: SparkSession, d: str) -> DataFrame:
    done = vectors(spark, d).where("id % 10 <> 0").select("id")
    return photos(spark, d).select("id", "file_path").join(done, "id", "left_anti")


def scan_metadata(spark: SparkSession, d: str) -> DataFrame:
    p = photos(spark, d).withColumn("name", basename(F.col("file_path")))
    return p.where(is_image(F.col("file_path"))).select("id", "file_path", "name", "size", "checksum")


def suffix_filter(spark: SparkSession, d: str) -> DataFrame:
    end = F.element_at(F.array(*[F.lit(x) for x in ("a.JPG", "b.Nef", "c.txt", ".jpg", "e.tar.png")]), F.pmod("doc_id", F.lit(5)).cast("int") + 1)
    p = table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), end).alias("file_path"))
    return p.where(is_image(F.col("file_path")))


def checksum_groups(spark: SparkSession, d: str) -> DataFrame:
    return photos(spark, d).groupBy("checksum").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def _stored(spark: SparkSession, d: str) -> DataFrame:
    return photos(spark, d).where("id % 4 <> 0").withColumn("size", F.when(F.col("id") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))


def incremental_diff(spark: SparkSession, d: str) -> DataFrame:
    return changed(photos(spark, d).drop("id"), _stored(spark, d)).select("file_path", "size")


def upsert_photos(spark: SparkSession, d: str) -> DataFrame:
    old = _stored(spark, d)
    return merge.upsert(old, changed(photos(spark, d).drop("id"), old), ["file_path"], "id")


def upsert_clusters(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    old = v.where("id % 2 = 0").select(F.col("id").alias("photo_id"), F.col("label").alias("cluster_id"), F.lit(0.5).alias("score"))
    new = v.where("id % 3 = 0").select(F.col("id").alias("photo_id"), (F.col("label") + 100).alias("cluster_id"), F.lit(1.0).alias("score"))
    return merge.upsert(old, new, ["photo_id"])


def upsert_faces(spark: SparkSession, d: str) -> DataFrame:
    old = faces(spark, d).where("id % 2 = 0")
    new = faces(spark, d).where("photo_id % 3 = 0").select("photo_id", "face_index", F.lit(None).cast("long").alias("person_id"))
    out = merge.upsert(old, new, ["photo_id", "face_index"], "id")
    return out


def latest_embedding(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).select("id", F.col("id").alias("photo_id"))
    again = v.where("id % 10 = 0").select((F.col("id") + 1_000_000).alias("id"), "photo_id")
    return similarity.latest(v.unionByName(again), "photo_id", "id")


def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("id", F.round(norm(F.col("vector")), 6).alias("norm"))


def pair_cosine(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    a, b = v.select("id", F.col("vector").alias("x")), v.select((F.col("id") - 1).alias("id"), F.col("vector").alias("y"))
    return a.join(b, "id").select("id", F.round(cosine(F.col("x"), F.col("y")), 6).alias("score"))


def _tags(spark: SparkSession, d: str, k: int = 3) -> DataFrame:
    v = vectors(spark, d)
    means = v.select("label", F.posexplode("vector").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("label").limit(tagging.MOST_LABELS + 1).collect()  # rank_labels refuses more than MOST_LABELS
    return tagging.rank_labels(v, [f"label_{r['label']}" for r in means], np.array([[x["x"] for x in r["v"]] for r in means]), k)


def auto_tags(spark: SparkSession, d: str) -> DataFrame:
    return _tags(spark, d).select("id", "rank", "tag", F.round("score", 6).alias("score"))


def photo_tags_concat(spark: SparkSession, d: str) -> DataFrame:
    return tagging.tags_text(photos(spark, d), _tags(spark, d).select(F.col("id").alias("photo_id"), F.col("rank").alias("id"), "tag"))


def retag_replace(spark: SparkSession, d: str) -> DataFrame:
    old = photos(spark, d).select(F.col("id").alias("photo_id"), F.lit("old").alias("tag"), F.lit(1.0).alias("score"))
    seen = vectors(spark, d).where("id % 2 = 0").select(F.col("id").alias("photo_id"))
    new = _tags(spark, d).where("rank = 1 AND id % 4 = 0").select(F.col("id").alias("photo_id"), "tag", F.round("score", 6).alias("score"))
    return merge.replace_of(old, new, "photo_id", seen)


def hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.hamming_pairs(codes(spark, d), BITS)


def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.duplicate_groups(codes(spark, d), BITS)


def knn_edges(spark: SparkSession, d: str) -> DataFrame:
    return similarity.knn_join(vectors(spark, d), NEAR).where(F.col("score") >= COSINE).select("id", "near", F.round("score", 6).alias("score"))


def photo_clusters(spark: SparkSession, d: str) -> DataFrame:
    return similarity.threshold_clusters(vectors(spark, d), COSINE, NEAR)


def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    c = photo_clusters(spark, d)
    n = c.groupBy("component").agg(F.count("*").alias("n"))
    return n.join(similarity.dense_ids(n), "component").select("cluster_id", "n")


def person_names(spark: SparkSession, d: str) -> DataFrame:
    return people.name_clusters(photo_clusters(spark, d))


def assign_persons(spark: SparkSession, d: str) -> DataFrame:
    known = persons(spark, d).unionByName(spark.createDataFrame([(25, "Person 1")], "id long, name string"))
    known, named = people.assign_clusters(faces(spark, d), known, photo_clusters(spark, d))
    return named.join(known.select(F.col("id").alias("person_id"), "name"), "person_id", "left").select("id", "person_id", "name")


def faces_list(spark: SparkSession, d: str) -> DataFrame:
    return people.faces_list(faces(spark, d), photos(spark, d), persons(spark, d))


def face_thumbs(spark: SparkSession, d: str) -> DataFrame:
    return people.with_thumbs(faces(spark, d), photos(spark, d), thumbs(spark, d), persons(spark, d))


def faces_for_person(spark: SparkSession, d: str) -> DataFrame:
    name = persons(spark, d).where("id = 2").first()["name"]
    return people.faces_of(name, faces(spark, d), photos(spark, d), persons(spark, d))


def persons_face_count(spark: SparkSession, d: str) -> DataFrame:
    return people.face_counts(persons(spark, d), faces(spark, d))


def person_cards(spark: SparkSession, d: str) -> DataFrame:
    return people.person_cards(faces_list(spark, d))


def set_face_person(spark: SparkSession, d: str) -> DataFrame:
    values = spark.createDataFrame([(7, 3), (14, None), (10_000_000, 1)], "id long, person_id long")
    return merge.assign(faces(spark, d), values, "id", "person_id")


def get_or_create_person(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "region").select(F.col("r_name").alias("name")).unionByName(persons(spark, d).select("name"))
    return merge.get_or_create(persons(spark, d), names)


def browse_page(spark: SparkSession, d: str) -> DataFrame:
    """The newest 500 photos with their tags and cluster: a page, and a page's limit."""
    page = photos(spark, d).select("id", "file_path").orderBy(F.desc("id")).limit(500)
    out = tagging.tags_text(page, _tags(spark, d).select(F.col("id").alias("photo_id"), F.col("rank").alias("id"), "tag"))
    clusters = vectors(spark, d).select("id", F.col("label").cast("string").alias("cluster"))
    return out.join(clusters, "id", "left").select("id", "file_path", "tags", F.coalesce("cluster", F.lit("")).alias("cluster"))


def first_photos(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 photos: `limit` of an analysis."""
    return photos(spark, d).select("id", "file_path").orderBy("id").limit(25)


def faces_min_score(spark: SparkSession, d: str) -> DataFrame:
    e = lambda i: F.get("vector", F.lit(i)).cast("double")
    box = F.struct(*[F.lit(0).alias(c) for c in "xywh"])
    found = F.array(*[F.struct(box.alias("bbox"), F.array(F.lit(0.0)).alias("embedding"), F.abs(e(i)).alias("score")) for i in range(4)])
    out = people.detected(vectors(spark, d).select(F.col("id").alias("photo_id"), found.alias("faces")), 0.1)
    return out.select("photo_id", "face_index", F.round("score", 6).alias("score"))


def bbox_xywh(spark: SparkSession, d: str) -> DataFrame:
    e = lambda i: F.get("vector", F.lit(i)).cast("double") * 1000
    return vectors(spark, d).select("id", *people.xywh(e(0), e(1), e(2), e(3)))


def gps_decimal(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    part = lambda num, den: F.struct(num.alias("num"), den.alias("den"))
    ref = F.element_at(F.array(F.lit("N"), F.lit("S"), F.lit("W"), F.lit(None)), (k % 4).cast("int") + 1)
    value = decimal_degrees(part(k % 180, F.lit(1)), part(k % 60, F.lit(1)), part(k % 3600, k % 7), ref)
    return table(spark, d, "customer").select("c_custkey", F.round(value, 6).alias("degrees"))


def exif_datetime_parse(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 5 == 0, "").when(F.col("o_orderkey") % 7 == 0, "0000:00:00 00:00:00").otherwise(F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss"))
    return table(spark, d, "orders").select("o_orderkey", iso_seconds(exif_timestamp(raw)).alias("taken"))


def gallery_items_json(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct(F.col("id").alias("photo_id"), "file_path", F.nullif("tags", F.lit("")).alias("tags"))
    return photo_tags_concat(spark, d).select("id", F.to_json(item, {"ignoreNullFields": "false"}).alias("item"))


def normalized_vectors(spark: SparkSession, d: str) -> DataFrame:
    unit = l2_normalize(F.col("vector"))
    return vectors(spark, d).select("id", F.posexplode(unit).alias("i", "x")).select("id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def append_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """New rows after the old ones, also for photos that have a vector already."""
    v = vectors(spark, d).select("id", F.col("id").alias("photo_id"))
    new = v.where("id % 4 = 0").select("photo_id")
    top = v.agg(F.max("id")).first()[0]
    return v.unionByName(similarity.number(new, ["photo_id"], top + 1).select(F.col("number").alias("id"), "photo_id"))


def rename_person(spark: SparkSession, d: str) -> DataFrame:
    return merge.rename(persons(spark, d), 4, "Renamed")


def upsert_thumbs(spark: SparkSession, d: str) -> DataFrame:
    old = thumbs(spark, d).withColumn("id", (F.col("face_id") / 3 + 1).cast("long"))
    new = vectors(spark, d).where("id % 2 = 0").select(F.col("id").alias("face_id"), F.format_string("faces/new_%d.png", F.col("id")).alias("thumb_path"))
    return merge.upsert(old, new, ["face_id"], "id")


def dim_filter(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that have as many elements as their row says."""
    v = vectors(spark, d).withColumn("vector", F.expr("slice(vector, 1, 64 - CAST(id % 3 AS INT))")).withColumn("dim", F.lit(64))
    return v.where("size(vector) = dim").select("id")


def nonempty_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).withColumn("vector", F.expr("slice(vector, 1, CAST(id % 4 AS INT))"))
    return v.where("size(vector) > 0").select("id", F.size("vector").alias("n"))


def nonempty_codes(spark: SparkSession, d: str) -> DataFrame:
    some = codes(spark, d).withColumn("phash", F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, F.col("phash")))
    return duplicates.coded(some)


def scan_counts(spark: SparkSession, d: str) -> DataFrame:
    """What a scan, a detection and a clustering report: files indexed and skipped, faces, persons, clusters."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    files = changed(photos(spark, d).drop("id"), _stored(spark, d))
    out = count(photos(spark, d), "seen").join(count(files, "indexed")).join(count(faces(spark, d), "faces"))
    out = out.join(faces(spark, d).agg(F.countDistinct("person_id").alias("persons")))
    return out.select("indexed", (F.col("seen") - F.col("indexed")).alias("skipped"), "faces", "persons")


def embeddings_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("photo_id"), F.size("embedding").alias("dim"), F.round(F.element_at("embedding", -1).cast("double"), 6).alias("last"))


def vector_blobs(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that went through their bytes: four for each element, the first one's sign and exponent last."""
    pack = lambda pdf: pdf.assign(blob=[x.astype("<f4").tobytes() for x in pdf["vector"]])[["id", "blob"]]
    blobs = vectors(spark, d).select("id", "vector").mapInPandas(lambda it: map(pack, it), "id long, blob binary")
    back = blobs.select("id", F.length("blob").alias("bytes"), float_blob(F.col("blob")).alias("v"))
    return back.select("id", "bytes", F.posexplode("v").alias("i", "x")).select("id", "bytes", F.col("i").cast("long").alias("i"), F.round(F.col("x").cast("double"), 6).alias("x"))


def pixel_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Perceptual hashes of images of 8 by 8 grey pixels: a vector's elements, in 256 steps."""
    grey = F.transform("vector", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int"))
    three = F.flatten(F.transform(grey, lambda x: F.array(x, x, x)))

    def image(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"file_path": pdf["id"].astype(str), "height": 8, "width": 8, "nChannels": 3, "data": [np.array(x, np.uint8).tobytes() for x in pdf["grey"]]})

    pixels = vectors(spark, d).select("id", three.alias("grey")).mapInPandas(image, "file_path string, height int, width int, nChannels int, data binary")
    return pixels.mapInPandas(hash_rows, "file_path string, phash string").select(F.col("file_path").cast("long").alias("id"), "phash")


def knn_edges_listed(spark: SparkSession, d: str) -> DataFrame:
    """The same neighbours by lists and covering radii, as for tables too large to broadcast."""
    rows = similarity.usable(vectors(spark, d), "id", "vector")
    found = similarity.listed_knn(rows, rows.count(), 64, NEAR)
    return found.where(F.col("score") >= COSINE).select("id", "near", F.round("score", 6).alias("score"))


def catalog_persons(spark: SparkSession, d: str) -> DataFrame:
    """A catalog made, a table replaced twice, the second time by what it reads, and read back."""
    tables = Catalog(spark, f"{work_dir(spark)}/catalog")
    tables.init()
    tables.write("persons", persons(spark, d))
    tables.write("persons", tables.read("persons").where("id % 2 = 0"))
    return tables.read("persons")


def _tiff(key: int) -> bytes:
    """EXIF data of a picture: a date, and a latitude of degrees, minutes and hundredths of seconds."""
    entry = lambda tag, kind, n, value: struct.pack("<HHI", tag, kind, n) + value.ljust(4, b"\0")
    at = lambda x: struct.pack("<I", x)
    main = struct.pack("<H", 2) + entry(0x8769, 4, 1, at(38)) + entry(0x8825, 4, 1, at(56)) + at(0)
    date = struct.pack("<H", 1) + entry(0x9003, 2, 20, at(100)) + at(0)
    gps = struct.pack("<H", 2) + entry(1, 2, 2, b"NS"[key % 2 : key % 2 + 1] + b"\0") + entry(2, 5, 3, at(120)) + at(0)
    body = ((b"II*\0" + at(8) + main).ljust(38, b"\0") + date).ljust(56, b"\0") + gps
    text = f"20{key % 30:02}:{key % 12 + 1:02}:{key % 28 + 1:02} 10:20:{key % 60:02}\0".encode()
    return (body.ljust(100, b"\0") + text).ljust(120, b"\0") + struct.pack("<6I", key % 90, 1, key % 60, 1, key % 6000, 100)


def exif_fields(spark: SparkSession, d: str) -> DataFrame:
    def made(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.assign(content=[_tiff(int(k)) for k in pdf["c_custkey"]])

    files = table(spark, d, "customer").select("c_custkey").mapInPandas(made, "c_custkey long, content binary")
    read = files.mapInPandas(exif_rows, f"c_custkey long, {EXIF}")
    part = lambda i: F.get("lat", F.lit(i))
    return read.select("c_custkey", "exif_datetime", F.round(decimal_degrees(part(0), part(1), part(2), F.col("lat_ref")), 6).alias("latitude"))


def thumbnail_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Height and width of thumbnails of 32 pixels at most, and of square crops, of pictures of many sizes."""

    def sizes(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            small = [thumbnail(np.zeros((h, w, 3)), 32).shape for h, w in zip(pdf["h"], pdf["w"], strict=True)]
            face = [crop(np.zeros((h, w, 3)), w - 5, -3, 20, 9).shape for h, w in zip(pdf["h"], pdf["w"], strict=True)]
            yield pd.DataFrame({"p_partkey": pdf["p_partkey"], "height": [x[0] for x in small], "width": [x[1] for x in small], "crop_height": [x[0] for x in face], "crop_width": [x[1] for x in face]})

    sides = table(spark, d, "part").select("p_partkey", (F.col("p_size") + 5).cast("int").alias("h"), (F.col("p_partkey") % 97 + 5).cast("int").alias("w"))
    return sides.mapInPandas(sizes, "p_partkey long, height int, width int, crop_height int, crop_width int")


SQL = {
    "search_topk": f"""WITH v AS ({VECTORS}), p AS ({PHOTOS}), s AS (SELECT a.id, {SIM} AS score FROM v a, (SELECT v FROM v ORDER BY id LIMIT 1) b ORDER BY score DESC, a.id LIMIT 20)
        SELECT id, file_path, round(score, 6) AS score, printf('%.3f', score) AS shown FROM s JOIN p USING (id)""",
    "pending_analysis": f"WITH p AS ({PHOTOS}) SELECT id, file_path FROM p LEFT JOIN (SELECT vec_id FROM embeddings WHERE vec_id % 10 <> 0) ON id = vec_id WHERE vec_id IS NULL",
    "scan_metadata": f"WITH p AS ({PHOTOS}) SELECT id, file_path, 'doc_' || id || '.jpg' AS name, size, checksum FROM p",
    "suffix_filter": "SELECT doc_id, source || '/' || ['a.JPG', 'b.Nef', 'c.txt', '.jpg', 'e.tar.png'][doc_id % 5 + 1] AS file_path FROM documents WHERE doc_id % 5 NOT IN (2, 3)",
    "checksum_groups": "SELECT sha1(text) AS checksum, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "incremental_diff": f"WITH p AS ({PHOTOS}) SELECT file_path, size FROM p WHERE id % 4 = 0 OR id % 5 = 0",
    "upsert_photos": f"""WITH p AS ({PHOTOS}), top AS (SELECT max(id) AS top FROM p WHERE id % 4 <> 0)
        SELECT CASE WHEN id % 4 <> 0 THEN id ELSE top + row_number() OVER (PARTITION BY id % 4 <> 0 ORDER BY file_path) END AS id, file_path, size, checksum FROM p, top""",
    "upsert_clusters": """SELECT vec_id AS photo_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END::BIGINT AS cluster_id, CASE WHEN vec_id % 3 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS score
        FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0""",
    "upsert_faces": f"""WITH f AS ({FACES}), top AS (SELECT max(id) AS top FROM f WHERE id % 2 = 0), w AS (SELECT * FROM f WHERE id % 2 = 0 OR photo_id % 3 = 0)
        SELECT CASE WHEN id % 2 = 0 THEN id ELSE top + row_number() OVER (PARTITION BY id % 2 ORDER BY photo_id, face_index) END AS id, photo_id, face_index,
               CASE WHEN photo_id % 3 <> 0 THEN person_id END AS person_id FROM w, top""",
    "latest_embedding": "SELECT CASE WHEN vec_id % 10 = 0 THEN vec_id + 1000000 ELSE vec_id END AS id, vec_id AS photo_id FROM embeddings",
    "vector_norms": f"WITH v AS ({VECTORS}) SELECT id, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM v",
    "pair_cosine": f"WITH v AS ({VECTORS}) SELECT a.id, round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)) + 1e-9), 6) AS score FROM v a JOIN v b ON b.id = a.id + 1",
    "auto_tags": f"WITH {TAGS} SELECT id, rank, tag, round(score, 6) AS score FROM tags",
    "photo_tags_concat": f"WITH {TAGS}, p AS ({PHOTOS}) SELECT p.id, p.file_path, coalesce(string_agg(tag, ', ' ORDER BY rank), '') AS tags FROM p LEFT JOIN tags ON tags.id = p.id GROUP BY p.id, p.file_path",
    "retag_replace": f"""WITH {TAGS}, p AS ({PHOTOS}) SELECT id AS photo_id, 'old' AS tag, 1.0::DOUBLE AS score FROM p WHERE id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0)
        UNION ALL SELECT id, tag, round(score, 6) FROM tags WHERE rank = 1 AND id % 4 = 0""",
    "hamming_pairs": f"WITH {CODES} SELECT a.id AS a, b.id AS b, bit_count(xor(a.code, b.code))::INT AS distance FROM h a JOIN h b ON a.id < b.id WHERE bit_count(xor(a.code, b.code)) <= {BITS}",
    "duplicate_groups": f"""WITH RECURSIVE {CODES}, pairs AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM h a JOIN h b ON a.id < b.id WHERE bit_count(xor(a.code, b.code)) <= {BITS}),
        ids AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS n FROM (SELECT a AS id FROM pairs UNION SELECT b FROM pairs)),
        before AS MATERIALIZED (SELECT ids.id, ids.n, coalesce(list(pairs.a) FILTER (pairs.a IS NOT NULL), []) AS smaller FROM ids LEFT JOIN pairs ON pairs.b = ids.id GROUP BY ids.id, ids.n),
        scan AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS leaders UNION ALL
                 SELECT before.n, CASE WHEN list_has_any(leaders, smaller) THEN leaders ELSE list_append(leaders, before.id) END FROM scan JOIN before ON before.n = scan.n + 1),
        lead AS (SELECT unnest(leaders) AS id FROM scan WHERE n = (SELECT count(*) FROM ids)),
        taken AS (SELECT min(a) AS leader, b AS member FROM pairs WHERE a IN (SELECT id FROM lead) AND b NOT IN (SELECT id FROM lead) GROUP BY b)
        SELECT leader, member FROM taken UNION SELECT leader, leader FROM taken""",
    "knn_edges": f"WITH {KNN} SELECT id, near, round(score, 6) AS score FROM k",
    "photo_clusters": f"WITH RECURSIVE {COMPONENTS} SELECT id, component FROM c",
    "cluster_sizes": f"WITH RECURSIVE {COMPONENTS} SELECT row_number() OVER (ORDER BY component) - 1 AS cluster_id, count(*) AS n FROM c GROUP BY component",
    "person_names": f"WITH RECURSIVE {COMPONENTS} SELECT id, 'Person ' || dense_rank() OVER (ORDER BY component) AS name FROM c",
    "assign_persons": f"""WITH RECURSIVE {COMPONENTS}, named AS (SELECT id, 'Person ' || dense_rank() OVER (ORDER BY component) AS name FROM c),
        new AS (SELECT name, 25 + row_number() OVER (ORDER BY name) AS person_id FROM (SELECT DISTINCT name FROM named WHERE name <> 'Person 1')),
        known AS (SELECT 'Person 1' AS name, 25 AS person_id UNION ALL SELECT * FROM new)
        SELECT named.id, known.person_id::BIGINT AS person_id, named.name FROM named JOIN known USING (name)""",
    "faces_list": f"""WITH f AS ({FACES}), p AS ({PHOTOS}) SELECT f.id AS face_id, photo_id, file_path, face_index, person_id, coalesce(n_name, 'Unknown') AS person
        FROM f JOIN p ON p.id = photo_id LEFT JOIN nation ON n_nationkey = person_id""",
    "face_thumbs": f"""WITH f AS ({FACES}), p AS ({PHOTOS}) SELECT f.id AS face_id, photo_id, file_path, face_index, person_id, coalesce(n_name, 'Unknown') AS person,
        CASE WHEN f.id % 3 = 0 THEN 'faces/face_' || f.id || '.jpg' END AS thumb_path FROM f JOIN p ON p.id = photo_id LEFT JOIN nation ON n_nationkey = person_id""",
    "faces_for_person": f"WITH f AS ({FACES}), p AS ({PHOTOS}) SELECT f.id AS face_id, photo_id, file_path, face_index, n_name AS person FROM f JOIN nation ON n_nationkey = person_id JOIN p ON p.id = photo_id WHERE n_nationkey = 2",
    "persons_face_count": f"WITH f AS ({FACES}) SELECT n_nationkey::BIGINT AS id, n_name AS name, count(f.id) AS faces FROM nation LEFT JOIN f ON person_id = n_nationkey GROUP BY 1, 2",
    "person_cards": f"""WITH f AS ({FACES}), p AS ({PHOTOS}) SELECT coalesce(n_name, 'Unknown') AS person, count(*) AS faces, min_by(file_path, f.id) AS cover
        FROM f JOIN p ON p.id = photo_id LEFT JOIN nation ON n_nationkey = person_id GROUP BY 1""",
    "set_face_person": f"WITH f AS ({FACES}) SELECT id, photo_id, face_index, CASE WHEN id = 7 THEN 3 WHEN id = 14 THEN NULL ELSE person_id END AS person_id FROM f",
    "get_or_create_person": "SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation UNION ALL SELECT 24 + row_number() OVER (ORDER BY r_name), r_name FROM region WHERE r_name NOT IN (SELECT n_name FROM nation)",
    "browse_page": f"""WITH {TAGS}, p AS ({PHOTOS}), page AS (SELECT id, file_path FROM p ORDER BY id DESC LIMIT 500)
        SELECT page.id, page.file_path, coalesce(string_agg(tag, ', ' ORDER BY rank), '') AS tags, coalesce(any_value(label)::VARCHAR, '') AS cluster
        FROM page LEFT JOIN tags ON tags.id = page.id LEFT JOIN embeddings ON vec_id = page.id GROUP BY page.id, page.file_path""",
    "first_photos": f"WITH p AS ({PHOTOS}) SELECT id, file_path FROM p ORDER BY id LIMIT 25",
    "faces_min_score": "SELECT vec_id AS photo_id, i::INT AS face_index, round(abs(embedding[i + 1]::DOUBLE), 6) AS score FROM embeddings, range(4) t(i) WHERE abs(embedding[i + 1]::DOUBLE) >= 0.1",
    "bbox_xywh": "SELECT vec_id AS id, trunc(x1)::INT AS x, trunc(y1)::INT AS y, (trunc(x2) - trunc(x1))::INT AS w, (trunc(y2) - trunc(y1))::INT AS h FROM (SELECT vec_id, embedding[1]::DOUBLE * 1000 AS x1, embedding[2]::DOUBLE * 1000 AS y1, embedding[3]::DOUBLE * 1000 AS x2, embedding[4]::DOUBLE * 1000 AS y2 FROM embeddings)",
    "gps_decimal": """SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN NULL WHEN 0 THEN round(x, 6) ELSE CASE WHEN x = 0 THEN 0.0 ELSE round(-x, 6) END END AS degrees
        FROM (SELECT c_custkey, (c_custkey % 180) + (c_custkey % 60) / 60 + (c_custkey % 3600)::DOUBLE / nullif(c_custkey % 7, 0) / 3600 AS x FROM customer)""",
    "exif_datetime_parse": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS taken FROM orders",
    "gallery_items_json": f"""WITH {TAGS}, p AS ({PHOTOS}), g AS (SELECT p.id, p.file_path, string_agg(tag, ', ' ORDER BY rank) AS tags FROM p LEFT JOIN tags ON tags.id = p.id GROUP BY p.id, p.file_path)
        SELECT id, to_json({{'photo_id': id, 'file_path': file_path, 'tags': tags}})::VARCHAR AS item FROM g""",
    "knn_edges_listed": f"WITH {KNN} SELECT id, near, round(score, 6) AS score FROM k",
    "catalog_persons": "SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation WHERE n_nationkey % 2 = 0",
    "exif_fields": """SELECT c_custkey, printf('20%02d:%02d:%02d 10:20:%02d', c_custkey % 30, c_custkey % 12 + 1, c_custkey % 28 + 1, c_custkey % 60) AS exif_datetime,
        round((CASE WHEN c_custkey % 2 = 1 THEN -1 ELSE 1 END) * (c_custkey % 90 + (c_custkey % 60) / 60 + (c_custkey % 6000) / 100 / 3600), 6) AS latitude FROM customer""",
    "thumbnail_sizes": """WITH s AS (SELECT p_partkey, p_size + 5 AS h, p_partkey % 97 + 5 AS w FROM part), k AS (SELECT *, least(1.0::DOUBLE, 32.0::DOUBLE / greatest(h, w)) AS k FROM s)
        SELECT p_partkey, greatest(1, round_even(h * k, 0))::INT AS height, greatest(1, round_even(w * k, 0))::INT AS width, least(h, 6)::INT AS crop_height, 5::INT AS crop_width FROM k""",
    "normalized_vectors": f"""WITH v AS ({VECTORS}), n AS (SELECT id, v, sqrt(list_inner_product(v, v)) + 1e-9 AS n FROM v)
        SELECT id, i - 1 AS i, round(v[i] / n, 6) AS x FROM n, range(1, 65) t(i)""",
    "append_embeddings": """SELECT vec_id AS id, vec_id AS photo_id FROM embeddings
        UNION ALL SELECT (SELECT max(vec_id) FROM embeddings) + row_number() OVER (ORDER BY vec_id), vec_id FROM embeddings WHERE vec_id % 4 = 0""",
    "rename_person": "SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey = 4 THEN 'Renamed' ELSE n_name END AS name FROM nation",
    "upsert_thumbs": """WITH w AS (SELECT vec_id AS face_id, vec_id % 3 = 0 AS old, vec_id % 2 = 0 AS new FROM embeddings WHERE vec_id % 3 = 0 OR vec_id % 2 = 0), top AS (SELECT max(face_id) // 3 + 1 AS top FROM w WHERE old)
        SELECT CASE WHEN old THEN face_id // 3 + 1 ELSE top + row_number() OVER (PARTITION BY old ORDER BY face_id) END AS id, face_id,
               CASE WHEN new THEN 'faces/new_' || face_id || '.png' ELSE 'faces/face_' || face_id || '.jpg' END AS thumb_path FROM w, top""",
    "dim_filter": "SELECT vec_id AS id FROM embeddings WHERE len(embedding[1:64 - vec_id % 3]) = 64",
    "nonempty_vectors": "SELECT vec_id AS id, (vec_id % 4)::INT AS n FROM embeddings WHERE vec_id % 4 > 0",
    "nonempty_codes": f"""WITH b AS (SELECT vec_id AS id, sum(CASE WHEN embedding[i] > 0 THEN 1::HUGEINT << (64 - i) ELSE 0 END) AS code FROM embeddings, range(1, 65) t(i) WHERE vec_id % 3 = 1 GROUP BY vec_id)
        SELECT id, (CASE WHEN code >= 1::HUGEINT << 63 THEN code - (1::HUGEINT << 64) ELSE code END)::BIGINT AS code FROM b""",
    "scan_counts": """SELECT (SELECT count(*) FROM documents WHERE doc_id % 4 = 0 OR doc_id % 5 = 0) AS indexed, (SELECT count(*) FROM documents WHERE NOT (doc_id % 4 = 0 OR doc_id % 5 = 0)) AS skipped,
        (SELECT count(*) FROM embeddings) AS faces, (SELECT count(DISTINCT label) FROM embeddings WHERE label < 8) AS persons""",
    "embeddings_scan": "SELECT vec_id AS photo_id, len(embedding)::INT AS dim, round(embedding[-1]::DOUBLE, 6) AS last FROM embeddings",
    "vector_blobs": "SELECT vec_id AS id, (4 * len(embedding))::INT AS bytes, i - 1 AS i, round(embedding[i]::DOUBLE, 6) AS x FROM embeddings, range(1, 65) t(i)",
    "pixel_hashes": """WITH p AS (SELECT vec_id AS id, (i - 1) // 8 AS r, (i - 1) % 8 AS c, floor((embedding[i]::DOUBLE + 1) * 127.5) AS x FROM embeddings, range(1, 65) t(i)),
        w AS (SELECT k, n // 4 AS b, sum(cos(pi() * k * (2 * n + 1) / 64)) AS w FROM range(0, 8) a(k), range(0, 32) b(n) GROUP BY k, n // 4),
        half AS (SELECT id, k, c, sum(w * x) AS x FROM p JOIN w ON b = r GROUP BY id, k, c),
        low AS (SELECT id, half.k * 8 + w.k AS j, sum(w * x) AS x FROM half JOIN w ON b = c GROUP BY id, half.k, w.k),
        mid AS (SELECT id, median(x) AS m FROM low GROUP BY id),
        bits AS (SELECT id, string_agg(CASE WHEN x > m THEN '1' ELSE '0' END, '' ORDER BY j) AS bits FROM low JOIN mid USING (id) GROUP BY id),
        nib AS (SELECT id, i, bits[4 * i + 1:4 * i + 4] AS q FROM bits, range(0, 16) t(i))
        SELECT id, string_agg(lower(to_hex((q[1]::INT * 8 + q[2]::INT * 4 + q[3]::INT * 2 + q[4]::INT)::INT)), '' ORDER BY i) AS phash FROM nib GROUP BY id""",
}

QUERIES = {name: globals()[name] for name in SQL}
