"""The commands over folders of pictures made here."""

import hashlib
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigraph.functions import exif, pixels
from lumigraph.operators import merge
from lumigraph.plans import engine as plans
from lumigraph.plans.engine import Engine
from lumigraph.plans.models import HashDetector, HashEmbedder, Lazy
from lumigraph.sources import files, sink
from lumigraph.sources import opened as opened_files
from lumigraph.sources.catalog import Catalog, Change, Version
from lumigraph.sources.tables import stash
from lumigraph.streaming.ingest import ingest


def picture(seed, side=48):
    x = np.linspace(0, 1, side)
    rng = np.random.default_rng(seed)
    a = sum(rng.normal() * np.outer(np.cos(np.pi * i * x), np.cos(np.pi * j * x)) for i in range(6) for j in range(6))
    a = 255 * (a - a.min()) / (np.ptp(a) + 1e-9)
    return np.stack([a, a, a], 2)


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "A.PNG").write_bytes(pixels.png(picture(1)))
    (root / "sub" / "b.png").write_bytes(pixels.png(picture(1) * 0.9 + 5))
    (root / "sub" / "A.PNG").write_bytes(pixels.png(picture(2)))
    (root / "bad.png").write_bytes(b"not a picture")
    (root / "empty.jpg").write_bytes(b"")
    (root / "raw.Nef").write_bytes(b"II*\0raw")
    (root / "notes.txt").write_bytes(b"text")
    return root


def test_whole_library(spark, folder, tmp_path):
    engine = Engine(spark, str(tmp_path / "lib"))
    assert engine.scan(str(tmp_path / "missing")) == (0, 0)
    assert engine.scan(str(folder)) == (5, 0)
    assert engine.scan(str(folder)) == (0, 5)
    photos = {os.path.basename(os.path.dirname(r.file_path)) + "/" + os.path.basename(r.file_path): r for r in engine.tables.read("photos").collect()}
    assert sorted(r.id for r in photos.values()) == [1, 2, 3, 4, 5]
    assert [len(photos[x].phash) for x in ("in/A.PNG", "in/bad.png", "in/raw.Nef")] == [16, 0, 0]
    assert all(r.exif_datetime == "" and r.latitude is None for r in photos.values())

    (folder / "A.PNG").write_bytes(pixels.png(picture(1, 50)))
    assert engine.scan(str(folder)) == (1, 4)
    assert engine.tables.read("photos").where("file_path like '%in/A.PNG'").first().id == photos["in/A.PNG"].id
    groups = engine.duplicates(10).collect()
    assert {r.member for r in groups} == {photos["in/A.PNG"].id, photos["sub/b.png"].id}

    embed = HashEmbedder()
    assert engine.analyze(embed, tag_k=3, limit=2) == 2
    assert engine.analyze(embed, tag_k=3) == 3
    assert engine.analyze(embed) == 0
    assert engine.tables.read("tags").count() == 15
    assert engine.analyze(embed, tag_k=0, incremental=False) == 5
    assert engine.tables.read("tags").count() == 0
    assert engine.tables.read("embeddings").count() == 5
    with pytest.raises(ValueError, match="limit"):
        engine.analyze(embed, limit=-1)
    hit = engine.search(embed.images([(folder / "sub" / "b.png").read_bytes()])[0], 2).first()
    assert hit.id == photos["sub/b.png"].id and abs(hit.score - 1) < 1e-5
    assert engine.search("words", 3, embed).count() == 3
    assert engine.cluster(0.99) == 5
    assert engine.browse().count() == 5

    assert engine.faces_detect(HashDetector()) == 5
    assert engine.faces_cluster() == 5
    engine.faces_tag(2, "Ann </script>")
    engine.faces_tag(99, "Nobody")
    listed = {r.face_id: r.person for r in engine.faces_list().collect()}
    assert listed[2] == "Ann </script>" and listed[1] == "Person 1"
    out = engine.export(str(tmp_path / "out"))
    text = open(out).read()
    assert text.count("</script>") == 1 and "Ann" in text
    assert len(os.listdir(tmp_path / "out" / "thumbs")) >= 3
    with pytest.raises(ValueError, match="export"):
        engine.export(str(tmp_path), "video")
    assert engine.faces_detect(HashDetector()) == 5
    assert {r.person for r in engine.faces_list().collect()} == {"Unknown"}


def opened(monkeypatch):
    """Paths that are opened from now on: by tasks, and those that go to Spark's image source once more."""
    paths = {"tasks": [], "source": []}
    plain, shown = plans.each_file, plans.images

    def each_file(files, *how, **named):
        paths["tasks"] += [r[0] for r in files.select("file_path").collect()]
        return plain(files, *how, **named)

    monkeypatch.setattr(plans, "each_file", each_file)
    monkeypatch.setattr(plans, "images", lambda spark, some: paths["source"].extend(some) or shown(spark, some))
    return paths


def test_scan_opens_changed_files_only(spark, folder, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path / "lib"))
    engine.scan(str(folder))
    paths = opened(monkeypatch)
    (folder / "sub" / "new[1] {a}*+%41é.png").write_bytes(pixels.png(picture(7)))
    (folder / "A.PNG").write_bytes(pixels.png(picture(1, 50)))
    assert engine.scan(str(folder)) == (2, 4)
    assert {os.path.basename(p) for p in paths["tasks"]} == {"A.PNG", "new[1] {a}*+%41é.png"} and not any("sub/A.PNG" in p for p in paths["tasks"])
    new = engine.tables.read("photos").where("file_path LIKE '%new%'").first()
    assert len(new.phash) == 16 and new.checksum == hashlib.sha1((folder / "sub" / "new[1] {a}*+%41é.png").read_bytes()).hexdigest()
    assert not paths["source"]
    (folder / "bad2.png").write_bytes(b"not a picture")
    paths["tasks"].clear()
    assert engine.scan(str(folder)) == (1, 6)
    assert [os.path.basename(p) for p in paths["tasks"] + paths["source"]] == ["bad2.png"] * 2
    paths["tasks"].clear()
    assert engine.scan(str(folder)) == (0, 7) and not paths["tasks"]


def jobs(spark, act):
    """How many jobs `act` runs."""
    spark.sparkContext.setJobGroup("counted", "")
    act()
    spark.sparkContext.setJobGroup("", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))


def test_one_job_opens_all(spark, tmp_path):
    """However many files: the job that holds the paths and the job that opens them."""
    (tmp_path / "in").mkdir()
    for i in range(90):
        (tmp_path / "in" / f"{i}.png").write_bytes(b"x" * i)
    rows = spark.createDataFrame([(f"file:{tmp_path}/in/{i}.png", i) for i in range(100)], "file_path string, size long")
    made = []
    work = lambda contents: [(len(c),) for c in contents]
    assert jobs(spark, lambda: made.append(opened_files.each_file(rows, work, "n int"))) <= 3
    assert sorted((r["size"], r.n) for r in made[0].collect()) == [(i, i) for i in range(90)]  # those that are gone are left out
    assert opened_files.each_file(rows.limit(0), work, "n int").count() == 0


@pytest.mark.parametrize("known", [True, False])
def test_lost_files(spark, folder, tmp_path, monkeypatch, known):
    """Also where only Spark reaches the file system, in small batches."""
    monkeypatch.setattr(files, "BATCH", 2)
    monkeypatch.setattr(opened_files, "known", lambda path: known)
    engine = Engine(spark, str(tmp_path / "lib"))
    assert engine.scan(str(folder)) == (5, 0)
    hashes = {r.file_path: r.phash for r in engine.tables.read("photos").collect()}
    assert sorted(len(x) for x in hashes.values()) == [0, 0, 16, 16, 16]
    (folder / "sub" / "b.png").unlink()
    assert engine.analyze(HashEmbedder(), tag_k=1, limit=1) == 1
    assert engine.analyze(HashEmbedder(), tag_k=1) == 3
    assert engine.faces_detect(HashDetector()) == 4


def filtered_png(rows, how, depth, colour, palette=b""):
    """A PNG file of rows of bytes, each row written as differences of kind `how[r]`."""
    step, out, above = max(1, pixels.SAMPLES[colour] * depth // 8), b"", bytes(len(rows[0]))
    for kind, row in zip(how, rows, strict=True):
        left, corner = bytes(step) + row[:-step], bytes(step) + above[:-step]

        def guess(a, b, c):
            p = a + b - c
            return (0, a, b, (a + b) // 2, min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2])[kind]  # noqa: B023

        out += bytes([kind]) + bytes((x - guess(a, b, c)) % 256 for x, a, b, c in zip(row, left, above, corner, strict=True))
        above = row
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + b"\0\0\0\0"
    width = len(rows[0]) * 8 // (pixels.SAMPLES[colour] * depth)
    head = struct.pack(">IIBBBBB", width, len(rows), depth, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + (part(b"PLTE", palette) if palette else b"") + part(b"IDAT", zlib.compress(out)) + part(b"IEND", b"")


@pytest.mark.parametrize("colour,depth", [(0, 8), (2, 8), (4, 8), (6, 8), (2, 16), (3, 8), (3, 4), (0, 1), (0, 16)])
def test_png(colour, depth):
    rng = np.random.default_rng(colour + depth)
    for how in ([0] * 7, [0, 1, 2, 2, 1, 1, 2], [4, 3, 4, 2, 1, 0, 4]):
        rows = [rng.integers(0, 256, 24, np.uint8).tobytes() for _ in how]
        palette = bytes(range(256)) * 3 if colour == 3 else b""
        got = pixels.png_pixels(filtered_png(rows, how, depth, colour, palette))
        raw = np.frombuffer(b"".join(rows), np.uint8).reshape(7, 24)
        if depth < 8:
            raw = np.unpackbits(raw, axis=1).reshape(7, -1, depth) @ (1 << np.arange(depth)[::-1])
            raw = raw if colour == 3 else raw * (255 // (2**depth - 1))
        raw = (raw[:, ::2] if depth == 16 else raw).reshape(7, -1, pixels.SAMPLES[colour])
        want = np.frombuffer(palette, np.uint8).reshape(-1, 3)[raw[..., 0]] if colour == 3 else np.repeat(raw[..., :1], 3, 2) if colour in (0, 4) else raw[..., :3]
        assert np.array_equal(got, want)
    assert np.array_equal(pixels.png_pixels(pixels.png(picture(3))), np.clip(np.rint(picture(3)), 0, 255))
    for bad in (b"", b"\x89PNG\r\n\x1a\n", b"text", pixels.png(picture(3))[:80], b"\xff\xd8\xff"):
        assert pixels.png_pixels(bad) is None


def test_png_as_the_image_source(spark, tmp_path):
    """Both ways to decode agree."""
    (tmp_path / "x.png").write_bytes(pixels.png(picture(5)))
    r = files.images(spark, [f"file:{tmp_path}/x.png"]).first()
    assert np.array_equal(pixels.rgb(r.data, r.height, r.width, r.nChannels), pixels.png_pixels((tmp_path / "x.png").read_bytes()))


def test_sink_attempts(tmp_path):
    """Of two attempts at the same rows, and one that fails half way, one whole file each is left."""
    root = tmp_path / "out"
    (root / "a").mkdir(parents=True)
    (root / "a" / "1.txt").write_bytes(b"old")
    writer, rows = sink.FileWriter(f"file:{root}"), [("a/1.txt", b"one"), ("2 %41.txt", b"two")]

    def cut():
        yield rows[0]
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        writer.write(cut())
    writer.write(iter(rows))  # a copy whose message never comes
    done = writer.write(iter(rows))
    assert (root / "a" / "1.txt").read_bytes() == b"old"
    writer.commit([done, None])
    assert sorted(os.listdir(root)) == ["2 %41.txt", "a"] and (root / "a" / "1.txt").read_bytes() == b"one"
    for name in ("../x", "/x", "a/../x", "", "a//x"):
        with pytest.raises(ValueError, match="name"):
            writer.write(iter([(name, b"")]))
    writer.abort([])
    assert sorted(os.listdir(root)) == ["2 %41.txt", "a"]


@pytest.mark.parametrize("known", [True, False])
def test_sink(spark, tmp_path, monkeypatch, known):
    monkeypatch.setattr(sink, "known", lambda path: known)
    rows = spark.range(40).select(F.concat(F.lit("d"), F.col("id") % 3, F.lit("/"), "id"), F.col("id").cast("string").cast("binary"))
    sink.put_files(rows, str(tmp_path / "out"))
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file() and p.suffix != ".crc"} == {str(i): str(i).encode() for i in range(40)}
    if known:  # a job that fails leaves nothing
        broken = spark.range(40).repartition(4).select(F.concat(F.lit("x"), "id"), F.when(F.col("id") != 39, F.lit(b"1")).otherwise(F.raise_error(F.lit("boom")).cast("binary")))
        with pytest.raises(Exception, match="boom"):
            sink.put_files(broken, str(tmp_path / "other"))
        assert not [p for p in (tmp_path / "other").rglob("*") if p.is_file()]


def test_stored_indexes(spark, folder, tmp_path):
    """With indexes, commands say the same, also after photos came, changed and were embedded anew."""
    engine, embed = Engine(spark, str(tmp_path / "lib")), HashEmbedder()

    def agree():
        query = embed.images([(folder / "sub" / "b.png").read_bytes()])[0]
        shown = lambda df: [(r.id, round(r.score, 6)) for r in df.collect()]
        assert shown(engine.search(query, 4, stored=True)) == shown(engine.search(query, 4))
        assert engine.duplicates(10, stored=True).collect() == engine.duplicates(10).collect()
        counts = engine.cluster(0.3), sorted(engine.tables.read("clusters").collect())
        assert (engine.cluster(0.3, stored=True), sorted(engine.tables.read("clusters").collect())) == counts

    engine.scan(str(folder))
    engine.analyze(embed, tag_k=1)
    agree()
    for i in range(3):
        (folder / f"more{i}.png").write_bytes(pixels.png(picture(1, 40 + i)))
    engine.scan(str(folder))
    engine.analyze(embed, tag_k=1)
    index = engine.vector_index()
    assert index.tables.read("sources").count() == 8
    agree()
    (folder / "A.PNG").write_bytes(pixels.png(picture(2, 50)))
    engine.scan(str(folder))
    engine.analyze(embed, tag_k=1, incremental=False)
    agree()
    index._mark(False)  # a change that broke off
    assert engine.vector_index().tables.read("members").count() == 8


def test_stream(spark, folder, tmp_path):
    """What arrives has hashes, dates and positions, as after a scan, and a scan has nothing to add."""
    (folder / "dated.jpg").write_bytes(b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff("<")) + 8) + b"Exif\0\0" + tiff("<") + b"\xff\xd9")
    engine, other = Engine(spark, str(tmp_path / "lib")), Engine(spark, str(tmp_path / "other"))
    other.scan(str(folder))
    for _ in range(2):
        query = ingest(engine, str(folder), str(tmp_path / "state"))
        query.awaitTermination(120)
        assert engine.tables.read("photos").count() == 6
    facts = lambda e: sorted(map(str, e.tables.read("photos").drop("id").collect()))
    assert facts(engine) == facts(other) and any("2020:01:02" in x for x in facts(engine))
    assert engine.scan(str(folder)) == (0, 6)


def test_plugged_decoder(spark, folder, tmp_path):
    class Grey:
        """Decodes what begins like a TIFF file: a ramp of grey."""

        def pixels(self, content):
            return np.full((16, 16, 3), content[4]) * np.linspace(0, 1, 16)[:, None, None] if content[:4] == b"II*\0" else None

    engine = Engine(spark, str(tmp_path / "lib"), Grey())
    engine.scan(str(folder))
    hashes = {os.path.basename(r.file_path): r.phash for r in engine.tables.read("photos").collect()}
    assert len(hashes["raw.Nef"]) == 16 and hashes["bad.png"] == ""


def make_embedder(dim):
    with open(os.environ["LUMIGRAPH_TEST_LOG"], "a") as log:
        log.write(f"{os.getpid()}\n")
    return HashEmbedder(dim)


def test_lazy_model(spark, folder, tmp_path, monkeypatch):
    """Made by the process that uses it, once."""
    import pickle

    monkeypatch.setenv("LUMIGRAPH_TEST_LOG", str(tmp_path / "log"))
    model = Lazy(make_embedder, 24, dim=24)
    again = pickle.loads(pickle.dumps(model))
    assert again.dim == 24 and not os.path.exists(tmp_path / "log")
    assert again.texts(["a"]).shape == model.images([b"x"]).shape == (1, 24)
    assert open(tmp_path / "log").read().count("\n") == 1
    engine = Engine(spark, str(tmp_path / "lib"))
    engine.scan(str(folder))
    assert engine.analyze(Lazy(HashEmbedder, 24, dim=24), tag_k=2) == 5


def test_import_vectors(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "lib"))
    blob = lambda *x: np.array(x, "<f4").tobytes()
    rows = [(1, 2, blob(1, 2)), (2, 3, blob(1, 2)), (3, 2, None), (4, 1, b"xyz")]
    assert engine.import_vectors(spark.createDataFrame(rows, "photo_id long, dim int, vector binary")) == 1
    assert engine.import_vectors(spark.createDataFrame(rows, "photo_id long, dim int, vector binary")) == 1
    assert [(r.id, r.photo_id, list(r.vector)) for r in engine.tables.read("embeddings").orderBy("id").collect()] == [(1, 1, [1.0, 2.0]), (2, 1, [1.0, 2.0])]


def test_write_that_dies(spark, tmp_path, monkeypatch):
    """The table stays as it was, whether the new version is cut off or only not marked."""
    tables = Catalog(spark, str(tmp_path / "lib"))
    tables.init()
    row = lambda i: spark.createDataFrame([(i, f"p{i}")], "id long, name string")
    tables.write("persons", row(1))
    with pytest.raises(Exception, match="(?i)boom|arithmetic|divide|cast"):
        tables.write("persons", row(2).select(F.expr("CAST(concat('boom', name) AS INT)").alias("id"), "name"))
    assert [r.id for r in tables.read("persons").collect()] == [1]
    os.makedirs(tmp_path / "lib" / "persons" / "data" / "left" / "part=3")  # by a writer that died before its claim
    assert [r.id for r in tables.read("persons").collect()] == [1]
    for i in range(3, 8):
        before = tables.read("persons")
        tables.write("persons", row(i).unionByName(before).distinct())
        assert before.count() == i - 2
    assert sorted(r.id for r in tables.read("persons").collect()) == [1, 3, 4, 5, 6, 7]
    assert len(os.listdir(tmp_path / "lib" / "persons" / "versions")) == 3


def parts_of(tmp_path, name):
    """(folder, part) of all data files of a table."""
    root = tmp_path / "lib" / name / "data"
    return {(f, p) for f in os.listdir(root) for p in os.listdir(root / f) if p.startswith("part=")}


def photo_rows(spark, ids, size):
    return spark.createDataFrame([(f"p{i}", size, f"sum{i}") for i in ids], "file_path string, size long, checksum string").select(
        "file_path", "size", F.lit("").alias("created_at"), "checksum", *[F.lit(None).cast(k).alias(c) for c, k in (("phash", "string"), ("exif_datetime", "string"), ("latitude", "double"), ("longitude", "double"))]
    )


def test_put_writes_touched_parts(spark, tmp_path):
    """Ten changed rows write ten parts of 64 at most; new keys go on from the largest id; the stored side isn't exchanged."""
    tables = Catalog(spark, str(tmp_path / "lib"))
    tables.init()
    assert tables.put("photos", photo_rows(spark, range(2000), 1), ["file_path"], "id") == 2000
    before = parts_of(tmp_path, "photos")
    assert len(before) == 64
    old = {r.file_path: r.id for r in tables.read("photos").collect()}
    assert sorted(old.values()) == list(range(1, 2001))
    changed = [*range(0, 1800, 200), 5000]
    assert tables.put("photos", photo_rows(spark, changed, 2), ["file_path"], "id") == 10
    fresh = parts_of(tmp_path, "photos") - before
    assert 1 <= len(fresh) <= 10 and len({f for f, _ in fresh}) == 1
    now = {r.file_path: r for r in tables.read("photos").collect()}
    assert len(now) == 2001 and now["p5000"].id == 2001
    assert {p for p, r in now.items() if r["size"] == 2} == {f"p{i}" for i in changed}
    assert all(now[p].id == i for p, i in old.items())


def test_put_keeps_stored_rows_in_place(spark, tmp_path):
    tables = Catalog(spark, str(tmp_path / "lib"))
    tables.init()
    tables.put("clusters", spark.range(500).select(F.col("id").alias("photo_id"), F.lit(1).cast("long").alias("cluster_id"), F.lit(1.0).alias("score")), ["photo_id"])
    fresh = stash(merge.one_each(spark.createDataFrame([(3, 9, 0.5), (900, 9, 0.5)], "photo_id long, cluster_id long, score double"), ["photo_id"], ["cluster_id", "score"]))
    rows = merge.put_in(tables.read("clusters"), fresh, ["photo_id"], None, 0, True)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    # the only exchange is that of the keys found, which are no more than there are fresh ones
    assert "SortMergeJoin" not in plan and len(scans) <= 1
    assert rows.count() == 501 and rows.where("cluster_id = 9").count() == 2
    large = merge.put_in(tables.read("clusters"), fresh, ["photo_id"], None, 0, False)
    assert sorted(large.collect()) == sorted(rows.collect())


def test_appends_stay_beside(spark, tmp_path, monkeypatch):
    """An append touches no file that is there, until a part has many folders."""
    from lumigraph.sources import catalog

    monkeypatch.setattr(catalog, "FOLDERS", 3)
    tables = Catalog(spark, str(tmp_path / "lib"), parts=2)
    tables.init()
    vector = lambda ids: spark.createDataFrame([(i, 1, [float(i)]) for i in ids], "photo_id long, dim int, vector array<float>")
    seen = set()
    for k in range(5):
        assert tables.append("embeddings", vector(range(10 * k, 10 * k + 10)), ["photo_id"]) == 10
        now = parts_of(tmp_path, "embeddings")
        assert seen <= now or k >= 3
        seen = now
    assert [(r.id, r.photo_id) for r in tables.read("embeddings").orderBy("id").collect()] == [(i + 1, i) for i in range(50)]
    assert tables.append("embeddings", vector([]), ["photo_id"]) == 0
    assert tables.replace("tags", spark.createDataFrame([], "photo_id long, tag string, score double"), "photo_id", vector([1]).select("photo_id"), ["photo_id"]) == 0


def test_two_writers(spark, tmp_path):
    """Both changes are there, whole, whoever comes first; of two claims of a number one succeeds."""
    from concurrent.futures import ThreadPoolExecutor

    tables = Catalog(spark, str(tmp_path / "lib"), parts=4)
    tables.init()
    assert [tables._claim("persons", Version(7, {}, 0)) for _ in range(2)] == [True, False]
    names = lambda k: spark.createDataFrame([(f"n{k}-{i}",) for i in range(20)], "name string")
    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(lambda k: Catalog(spark, str(tmp_path / "lib"), parts=4).put("persons", names(k), ["name"], "id"), range(4))) == [20] * 4
    rows = tables.read("persons").collect()
    assert {r.name for r in rows} == {f"n{k}-{i}" for k in range(4) for i in range(20)}
    assert sorted(r.id for r in rows) == list(range(1, 81))
    first = tables.version("persons")
    # a writer that is overtaken between its reading and its claim makes its change again
    overtaken = []

    def make(old):
        if not overtaken:
            overtaken.append(old.number)
            Catalog(spark, str(tmp_path / "lib"), parts=4).put("persons", spark.createDataFrame([("other",)], "name string"), ["name"], "id")
        return Change(tables.rows("persons", old).where("id % 2 = 0"), None)

    assert tables.change("persons", make) == 40
    assert overtaken == [first.number] and tables.version("persons").number == first.number + 2
    assert tables.read("persons").where("id % 2 = 1").count() == 0


def test_export_in_pages(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(plans, "PAGE_ROWS", 2)
    engine = Engine(spark, str(tmp_path / "lib"))
    for i in range(4):
        (folder / f"p{i}.png").write_bytes(pixels.png(picture(i, 20)))
    engine.scan(str(folder))
    engine.faces_detect(HashDetector())
    engine.export(str(tmp_path / "out"))
    names = ["index.html", *[f"page-{k}.html" for k in range(2, 6)]]
    texts = [open(tmp_path / "out" / n).read() for n in names]
    assert sorted(x for x in os.listdir(tmp_path / "out") if x.endswith(".html")) == sorted(names)
    assert all('"photo_id"' in t for t in texts)
    thumbs = sum(t.count('"thumb": "thumbs/') for t in texts)
    assert thumbs >= 7 and "page-2.html" in texts[0] and "index.html" in texts[1]
    assert len(os.listdir(tmp_path / "out" / "thumbs")) == 7


def tiff(order, lat_ref=b"S", dens=(1, 1, 1)):
    pack = lambda f, *v: struct.pack(order + f, *v)
    entry = lambda tag, kind, n, value: pack("HHI", tag, kind, n) + value.ljust(4, b"\0")
    head = (b"II*\0" if order == "<" else b"MM\0*") + pack("I", 8)
    date = b"2020:01:02 03:04:05\0"
    sub, gps, text, lat = 38, 56, 100, 120
    main = pack("H", 2) + entry(0x8769, 4, 1, pack("I", sub)) + entry(0x8825, 4, 1, pack("I", gps)) + pack("I", 0)
    exif_dir = pack("H", 1) + entry(0x9003, 2, 20, pack("I", text)) + pack("I", 0)
    gps_dir = pack("H", 2) + entry(1, 2, 2, lat_ref + b"\0") + entry(2, 5, 3, pack("I", lat)) + pack("I", 0)
    body = (head + main).ljust(sub, b"\0") + exif_dir
    body = (body.ljust(gps, b"\0") + gps_dir).ljust(text, b"\0") + date
    return body.ljust(lat, b"\0") + b"".join(pack("II", n, d) for n, d in zip((10, 30, 36), dens, strict=True))


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif(order):
    data = tiff(order)
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(data) + 8) + b"Exif\0\0" + data + b"\xff\xd9"
    for x in (data, jpeg):
        date, ref, lat, lon_ref, lon = exif.read(x)
        assert (date, ref, lon_ref, lon) == ("2020:01:02 03:04:05", "S", None, None)
        assert [p["num"] for p in lat] == [10, 30, 36]
    for cut in (b"", b"\xff\xd8", data[:60], b"II*\0\xff\xff\xff\xff"):
        assert exif.read(cut)[0] in ("", "2020:01:02 03:04:05")


def test_hash_ignores_brightness():
    a, b = pixels.perceptual_hash(picture(3)), pixels.perceptual_hash(picture(3) * 0.8 + 10)
    assert (int(a, 16) ^ int(b, 16)).bit_count() <= 4
    assert len(pixels.perceptual_hash(np.zeros((5, 7, 3)))) == 16


#: Grey levels, 8 by 8, of two pictures with two equal frequencies in the middle, and their hashes in DuckDB by the SQL of `pixel_hashes`.
EVEN = {
    "96f270a2bd45a366": "928b8c617da67d858d9b7c778d90758777737e7a76876c758761798c946e8e718a6f80926898838a7a6d9c7f88968a906f76797f6d816f6487686170898d8a72",
    "f2473da497356056": "8d7788656b85926980818679867684897f967a6c768a656a8a7f8b6d738186958689849d799f7c8e7ea8678f7379759a887f5a6f86858880957779689286678d",
}


def grey(levels):
    return np.repeat(np.frombuffer(bytes.fromhex(levels), np.uint8).reshape(8, 8, 1), 3, 2)


def test_hash_sums_in_order():
    assert [pixels.perceptual_hash(grey(x)) for x in EVEN.values()] == list(EVEN)


def test_scan_hashes_sums_in_order(spark, tmp_path):
    """The hashes that a scan stores of these pictures, as `engine_hashes` reads them."""
    (tmp_path / "in").mkdir()
    for name, levels in EVEN.items():
        (tmp_path / "in" / f"{name}.png").write_bytes(pixels.png(grey(levels)))
    engine = Engine(spark, str(tmp_path / "library"))
    engine.scan(str(tmp_path / "in"))
    rows = engine.tables.read("photos").collect()
    assert {r["file_path"].rsplit("/", 1)[1] for r in rows} == {f"{r['phash']}.png" for r in rows} == {f"{x}.png" for x in EVEN}
