"""Path, date, coordinate and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of raster images and of camera raw files.
IMAGES = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff", "gif")
RAWS = ("arw", "cr2", "cr3", "nef", "rw2", "orf", "raf", "dng", "srw", "pef")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-case suffix without the dot; a leading dot begins no suffix."""
    return F.lower(F.regexp_extract(basename(path), r"[^.].*\.([^.]+)$|^[^.]\.([^.]+)$", 1))


def is_image(path: Column) -> Column:
    """Whether the file's suffix, in any case, is one of an image; `.jpg` alone is a name, not a suffix."""
    return F.lower(basename(path)).rlike(r"^.+\.(" + "|".join(IMAGES + RAWS) + ")$")


def decimal_degrees(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Degrees as one number, negative for S and W.

    Each part is a struct (num, den).  A zero denominator, a null part or a
    null reference gives null; zero stays zero in any hemisphere.
    """
    part = lambda x: F.try_divide(x["num"].cast("double"), x["den"].cast("double"))
    value = part(degrees) + part(minutes) / 60 + part(seconds) / 3600
    return F.when(ref.isNull(), None).when(ref.isin("S", "W") & (value != 0), -value).otherwise(value)


def exif_timestamp(text: Column) -> Column:
    """The raw EXIF date as a timestamp; null for the empty string or another form."""
    return F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss"))


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def person_label(name: Column) -> Column:
    """The name, or Unknown for null and the empty string."""
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("Unknown"))


def score_text(score: Column) -> Column:
    return F.format_string("%.3f", score)
