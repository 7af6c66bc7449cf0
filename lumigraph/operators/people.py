"""Faces, persons and what reports show of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigraph.functions.text import person_label
from lumigraph.operators.merge import assign, get_or_create
from lumigraph.operators.similarity import dense_ids


def faces_list(faces: DataFrame, photos: DataFrame, persons: DataFrame) -> DataFrame:
    """Faces with the path of their photo and the name of their person, if any; faces without a photo go."""
    f = faces.select(F.col("id").alias("face_id"), "photo_id", "face_index", "person_id")
    out = f.join(photos.select(F.col("id").alias("photo_id"), "file_path"), "photo_id")
    out = out.join(persons.select(F.col("id").alias("person_id"), F.col("name").alias("person_name")), "person_id", "left")
    return out.select("face_id", "photo_id", "file_path", "face_index", "person_id", person_label(F.col("person_name")).alias("person"))


def with_thumbs(faces: DataFrame, photos: DataFrame, thumbs: DataFrame, persons: DataFrame) -> DataFrame:
    """`faces_list` with the path of the face's thumbnail, if any."""
    return faces_list(faces, photos, persons).join(thumbs.select("face_id", "thumb_path"), "face_id", "left")


def faces_of(name: str, faces: DataFrame, photos: DataFrame, persons: DataFrame) -> DataFrame:
    """Faces of the person of that name."""
    own = persons.where(F.col("name") == name).select(F.col("id").alias("person_id"), F.col("name").alias("person"))
    out = faces.select(F.col("id").alias("face_id"), "photo_id", "face_index", "person_id").join(own, "person_id")
    return out.join(photos.select(F.col("id").alias("photo_id"), "file_path"), "photo_id").select("face_id", "photo_id", "file_path", "face_index", "person")


def face_counts(persons: DataFrame, faces: DataFrame) -> DataFrame:
    """(id, name, faces) of every person, also those without a face."""
    n = faces.where("person_id IS NOT NULL").groupBy("person_id").agg(F.count("*").alias("n"))
    return persons.join(n, persons["id"] == n["person_id"], "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("faces"))


def person_cards(listed: DataFrame) -> DataFrame:
    """(person, faces, cover): for each name in `listed` the number of faces and the path of the first one."""
    return listed.groupBy("person").agg(F.count("*").alias("faces"), F.min_by("file_path", "face_id").alias("cover"))


def name_clusters(clusters: DataFrame) -> DataFrame:
    """(id, name): faces with the name of their cluster, Person 1, Person 2, … by each cluster's first face."""
    names = dense_ids(clusters).select("component", F.format_string("Person %d", F.col("cluster_id") + 1).alias("name"))
    return clusters.join(names, "component").select("id", "name")


def assign_clusters(faces: DataFrame, persons: DataFrame, clusters: DataFrame, keep_named: bool = False) -> tuple[DataFrame, DataFrame]:
    """(persons, faces) after each cluster of faces has its person; names that exist are taken as they are.

    `keep_named` leaves faces alone that have a person already.
    """
    named = name_clusters(clusters)
    persons = get_or_create(persons, named)
    values = named.join(persons.select(F.col("id").alias("person_id"), "name"), "name").select("id", "person_id")
    if keep_named:
        values = values.join(faces.where("person_id IS NOT NULL").select("id"), "id", "left_anti")
    return persons, assign(faces, values, "id", "person_id")


def detected(photos: DataFrame, min_score: float = 0.5) -> DataFrame:
    """(photo_id, face_index, bbox_x, bbox_y, bbox_w, bbox_h, embedding, score) from (photo_id, faces array<struct<bbox, embedding, score>>).

    The index counts all faces of the photo, also those under `min_score`, which go.
    """
    out = photos.select("photo_id", F.posexplode("faces").alias("face_index", "face")).where(F.col("face.score") >= min_score)
    box = [F.col(f"face.bbox.{c}").cast("double").alias(f"bbox_{c}") for c in "xywh"]
    return out.select("photo_id", "face_index", *box, "face.embedding", "face.score")


def xywh(x1, y1, x2, y2) -> list:
    """Corner coordinates as whole x, y, width and height, each cut toward zero before it is subtracted."""
    x1, y1, x2, y2 = (c.cast("int") for c in (x1, y1, x2, y2))
    return [x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h")]
