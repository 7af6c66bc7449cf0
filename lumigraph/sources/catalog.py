"""The tables of a media library below one root, each dealt into parts by a hash of its key, of which a change writes only those it touches."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable, Sequence
from contextlib import nullcontext
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumigraph.operators import merge
from lumigraph.sources.tables import settings, stash



class Table(NamedTuple):
    """Columns, the column whose hash deals the rows (or that is the part itself), and whether rows have a growing `id`."""

    schema: str
    by: str
    numbered: bool = True
    direct: bool = False


TABLES = {
    "photos": Table("id long, file_path string, size long, created_at string, checksum string, phash string, exif_datetime string, latitude double, longitude double", "file_path"),
    "embeddings": Table("id long, photo_id long, dim int, vector array<float>", "photo_id"),
    "tags": Table("id long, photo_id long, tag string, score double", "photo_id"),
    "clusters": Table("photo_id long, cluster_id long, score double", "photo_id", numbered=False),
    "persons": Table("id long, name string", "name"),
    "faces": Table("id long, photo_id long, face_index int, bbox_x double, bbox_y double, bbox_w double, bbox_h double, embedding array<float>, person_id long", "photo_id"),
    "face_thumbs": Table("id long, face_id long, thumb_path string", "face_id"),
}
#: Parts of a table; folders of one part from which on an append writes it anew.
PARTS, FOLDERS = 64, 16
#: Folders that the driver lists by itself: a call for each is less than a job.
LISTED = 256
#: Versions of a table that are kept, so that plans made before a change can still run; attempts of a change that others get ahead of.
KEPT, TRIES = 3, 20
#: Changed rows that are broadcast to the stored ones, at most; more are shuffled.
BROADCAST_ROWS = 100_000


class Version(NamedTuple):
    """What a table consists of: the folders of each part, and its largest id."""

    number: int
    parts: dict[int, list[str]]
    top: int


class Change(NamedTuple):
    """Rows to write, the parts that they replace (None: all), and whether they come beside what is there."""

    rows: DataFrame
    parts: Iterable[int] | None
    beside: bool = False


class Conflict(Exception):
    """Others changed a table again and again while a change was being made."""


class Catalog:
    """Reads and changes tables; `init` may be called again and again.

    A version is a small file that names the folders of each part.  A change
    writes the parts that it touches to a folder of its own and then claims the
    next number, which only one writer can do; the others make their change
    again on top of it.  So a writer that dies leaves the table as it was, no
    change is lost, and none is seen in part.

    A number is claimed by a link on local disks and else by a rename, which
    must fail where there is such a file, as that of HDFS does.
    """

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table] | None = None, parts: int = PARTS):
        self.spark, self.root, self.tables, self.n_parts = spark, root.rstrip("/"), tables or TABLES, parts

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(folder)
        return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []

    def _numbers(self, name: str) -> list[int]:
        return sorted(int(x[1:]) for x in self._names(f"{self.root}/{name}/versions") if x[:1] == "v" and x[1:].isdigit())

    def _load(self, name: str, number: int) -> Version:
        fs, at = self._fs(f"{self.root}/{name}/versions/v{number}")
        stream = fs.open(at)
        try:
            told = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(number, {int(k): v for k, v in told["parts"].items()}, told["top"])

    def version(self, name: str) -> Version:
        numbers = self._numbers(name)
        return self._load(name, numbers[-1]) if numbers else Version(-1, {}, 0)

    def _claim(self, name: str, new: Version) -> bool:
        """Whether this is the one writer that makes the version."""
        fs, at = self._fs(f"{self.root}/{name}/versions/v{new.number}")
        _, draft = self._fs(f"{self.root}/{name}/versions/draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps({"parts": new.parts, "top": new.top}).encode()))
        stream.close()
        if fs.getUri().getScheme() != "file":
            won = fs.rename(draft, at)
            if not won:
                fs.delete(draft, False)
            return won
        try:
            os.link(draft.toUri().getPath(), at.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(draft, False)

    def _forget(self, name: str) -> None:
        """Delete the versions before the last KEPT, and the folders that only they name."""
        numbers = self._numbers(name)
        used = {f for n in numbers[-KEPT:] for x in self._load(name, n).parts.values() for f in x}
        for n in numbers[:-KEPT]:
            try:
                old = {(k, f) for k, x in self._load(name, n).parts.items() for f in x if f not in used}
            except Py4JJavaError:  # another writer is at it
                continue
            for k, f in old:
                self._fs(self.root)[0].delete(self._fs(f"{self.root}/{name}/data/{f}/part={k}")[1], True)
            self._fs(self.root)[0].delete(self._fs(f"{self.root}/{name}/versions/v{n}")[1], False)

    def init(self) -> None:
        for name in self.tables:
            if not self._numbers(name):
                self._claim(name, Version(0, {}, 0))

    def part(self, name: str, column: Column | None = None) -> Column:
        """The part of a row, by its key or by another column that holds such keys."""
        table = self.tables[name]
        column = F.col(table.by) if column is None else column
        return column.cast("int") if table.direct else F.pmod(F.xxhash64(column), F.lit(self.n_parts)).cast("int")

    def columns(self, name: str) -> list[str]:
        return T.StructType.fromDDL(self.tables[name].schema).names

    def rows(self, name: str, version: Version, parts: Iterable[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its parts; no other part's files are listed."""
        some = version.parts if parts is None else parts
        paths = [f"{self.root}/{name}/data/{f}/part={k}" for k in some for f in version.parts.get(k, ())]
        schema = self.tables[name].schema
        if not paths:
            return self.spark.createDataFrame([], schema)
        with settings(self.spark, threshold=LISTED) if len(paths) <= LISTED else nullcontext():
            return self.spark.read.schema(schema).parquet(*paths)

    def read(self, name: str) -> DataFrame:
        return self.rows(name, self.version(name))

    def change(self, name: str, make: Callable[[Version], Change]) -> int:
        """Make a change on top of the last version, again if another writer was first: rows written."""
        top = F.max("id") if self.tables[name].numbered else F.max(F.lit(0))
        for _ in range(TRIES):
            old = self.version(name)
            try:
                new = make(old)
                folder, told = uuid.uuid4().hex, Observation()
                rows = new.rows.select(*self.columns(name)).observe(told, F.count(F.lit(1)).alias("n"), top.alias("top"))
                rows.withColumn("part", self.part(name)).write.partitionBy("part").parquet(f"{self.root}/{name}/data/{folder}")
            except (PySparkException, Py4JJavaError):
                if self.version(name).number - old.number < KEPT:  # else what it read may have been deleted meanwhile
                    raise
                continue
            made = [int(x[5:]) for x in self._names(f"{self.root}/{name}/data/{folder}") if x.startswith("part=")]
            gone = set(old.parts if new.parts is None else new.parts) if not new.beside else set()
            parts = {k: x for k, x in old.parts.items() if k not in gone}
            parts |= {k: [*parts.get(k, []), folder] for k in made}
            if self._claim(name, Version(old.number + 1, parts, max(old.top, told.get["top"] or 0))):
                self._forget(name)
                return told.get["n"]
            self._fs(self.root)[0].delete(self._fs(f"{self.root}/{name}/data/{folder}")[1], True)
        raise Conflict(f"{name}: {TRIES} attempts failed")

    def write(self, name: str, df: DataFrame) -> int:
        """Replace a table by `df`, which may read it: rows written."""
        return self.change(name, lambda old: Change(df, None))

    def _held(self, name: str, rows: DataFrame, column: Column | None = None) -> tuple[DataFrame, int, list[int]]:
        """`rows` written aside, how many they are and which parts they touch: one job."""
        told = Observation()
        held = stash(rows.observe(told, F.count(F.lit(1)).alias("n"), F.collect_set(self.part(name, column)).alias("parts")))
        return held, told.get["n"], sorted(told.get["parts"])

    def put(self, name: str, new: DataFrame, keys: Sequence[str], id_col: str | None = None) -> int:
        """`merge.upsert` of the parts that `new` touches: how many different keys `new` has."""
        columns = [x for x in self.columns(name) if x not in keys and x != id_col]
        fresh, n, parts = self._held(name, merge.one_each(new, keys, columns))
        if n:
            self.change(name, lambda old: Change(merge.put_in(self.rows(name, old, parts), fresh, keys, id_col, old.top, n <= BROADCAST_ROWS), parts))
        return n

    def append(self, name: str, new: DataFrame, order: Sequence[str] = ()) -> int:
        """Rows, with the next ids in the order of `order` if the table has such: how many.  Files that are there stay, unless a part has many folders."""
        held, n, parts = self._held(name, new)

        def make(old: Version) -> Change:
            added = self._numbered(name, held, order, old)
            full = [k for k in parts if len(old.parts.get(k, ())) >= FOLDERS]
            if not full:
                return Change(added, parts, beside=True)
            return Change(self.rows(name, old, parts).unionByName(added.select(*self.columns(name))), parts)

        if n:
            self.change(name, make)
        return n

    def _numbered(self, name: str, rows: DataFrame, order: Sequence[str], old: Version) -> DataFrame:
        return merge.numbered(rows, order, "id", old.top) if self.tables[name].numbered else rows

    def replace(self, name: str, new: DataFrame, key: str, touched: DataFrame, order: Sequence[str] = ()) -> int:
        """What was said of the keys in `touched`, by which the table is dealt, goes, even if nothing is said now; `new` comes, as in `append`: how many rows."""
        held, n, parts = self._held(name, new)
        gone, many, all_ = self._held(name, touched.select(key).distinct(), F.col(key))
        all_ = sorted({*all_, *parts})
        keys = F.broadcast(gone) if many <= BROADCAST_ROWS else gone

        def make(old: Version) -> Change:
            kept = self.rows(name, old, all_).join(keys, key, "left_anti")
            return Change(kept.unionByName(self._numbered(name, held, order, old).select(*kept.columns)), all_)

        if many or n:
            self.change(name, make)
        return n

    def assign(self, name: str, values: DataFrame, key: str, column: str) -> None:
        """`merge.assign` of the parts that hold a key of `values`; to find them, only keys are read."""
        told = Observation()
        values = stash(values.select(key, column).observe(told, F.count(F.lit(1)).alias("n")))
        small = F.broadcast(values) if told.get["n"] <= BROADCAST_ROWS else values

        def make(old: Version) -> Change:
            stored = self.rows(name, old).select(key, self.part(name).alias("part"))
            parts = [r["part"] for r in stored.join(small, key, "left_semi").select("part").distinct().collect()]  # n_parts at most
            return Change(merge.assign(self.rows(name, old, parts), small, key, column), parts)

        self.change(name, make)
