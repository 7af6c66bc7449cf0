"""Iterative and custom operators against plain versions."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigraph.functions import vectors as V
from lumigraph.operators import components, duplicates, merge, similarity, tagging
from lumigraph.plans import queries
from lumigraph.sources import tables


def naive_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("last", [0, 20, 16_000])
def test_components(spark, monkeypatch, last):
    monkeypatch.setattr(components, "LAST", last)
    rnd = random.Random(last)
    edges = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)]
    df = spark.createDataFrame([*edges, (7, 7), (None, 3)], "a long, b long").repartition(3)
    got = {r.id: r.component for r in components.connected_components(df, "a", "b").collect()}
    assert got == naive_components([e for e in edges if e[0] != e[1]])


def test_components_empty(spark):
    assert components.connected_components(spark.createDataFrame([], "a string, b string"), "a", "b").collect() == []


def greedy(codes, limit):
    taken, groups = set(), {}
    for i, (a, x) in enumerate(codes):
        if a in taken:
            continue
        taken.add(a)
        own = [b for b, y in codes[i + 1 :] if b not in taken and (x ^ y).bit_count() <= limit]
        taken.update(own)
        if own:
            groups[a] = [a, *own]
    return groups


@pytest.mark.parametrize(("limit", "n", "bits"), [(5, 80, 10), (2, 60, 6), (16, 60, 40)])
def test_duplicates(spark, limit, n, bits):
    rnd = random.Random(n)
    codes = [(i, (0xF0F0 << 40) ^ rnd.getrandbits(bits)) for i in range(n)] + [(n, (1 << 64) - 1), (n + 1, (1 << 64) - 1)]
    df = spark.createDataFrame([(i, f"{c:016x}") for i, c in codes] + [(900, ""), (901, None)], "id long, phash string")
    pairs = duplicates.hamming_pairs(df, limit)
    want = {(a, b, (x ^ y).bit_count()) for a, x in codes for b, y in codes if a < b and (x ^ y).bit_count() <= limit}
    assert {tuple(r) for r in pairs.collect()} == want
    got = {}
    for r in duplicates.greedy_groups(pairs).collect():
        got.setdefault(r.leader, []).append(r.member)
    assert {k: sorted(v) for k, v in got.items()} == greedy(codes, limit)


def test_banded_and_blocked_agree(spark, monkeypatch):
    rnd = random.Random(1)
    df = spark.createDataFrame([(i, f"{rnd.getrandbits(12) << 20:016x}") for i in range(100)], "id long, phash string")
    one = set(map(tuple, duplicates.hamming_pairs(df, 4).collect()))
    monkeypatch.setattr(duplicates, "bands_of", lambda n, limit: (5, 0, -1.0))
    assert one == set(map(tuple, duplicates.hamming_pairs(df, 4).collect()))


def test_chain_does_not_group(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")
    assert sorted(map(tuple, duplicates.greedy_groups(pairs).collect())) == [(1, 1), (1, 2), (3, 3), (3, 4)]


@pytest.mark.parametrize("most", [0, 32 << 20])
def test_knn(spark, monkeypatch, most):
    monkeypatch.setattr(similarity, "BROADCAST_BYTES", most)
    monkeypatch.setattr(similarity, "LIST", 8)
    monkeypatch.setattr(similarity, "CHUNK", 5)
    monkeypatch.setattr(similarity, "MOST_SCORES", 200)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 8))
    x[7] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(90, [0.0] * 8), (91, [1.0]), (92, None)], "id long, vector array<float>")
    got = {}
    for r in similarity.knn_join(df, 4).collect():
        got.setdefault(r.id, []).append((round(-r.score, 5), r.near))
    x = np.vstack([x.astype(np.float32).astype(float), np.zeros(8)])
    u = x / (np.linalg.norm(x, axis=1)[:, None] + 1e-9)
    ids = [*range(50), 90]
    for i, a in enumerate(ids):
        want = sorted((round(-float(u[i] @ u[j]), 5), ids[j]) for j in range(51) if j != i)[:4]
        assert [s for s, _ in sorted(got[a])] == [s for s, _ in want]
    assert (round(-1.0, 5), 7) in got[3]


def test_knn_visits_few_lists(spark, monkeypatch):
    """Vectors in families: exact, with fewer comparisons than all pairs; several zero vectors are near none but tie by id."""
    monkeypatch.setattr(similarity, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(similarity, "LIST", 20)
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(20, 6)), 20, 0) + rng.normal(size=(400, 6)) * 0.05
    x[[5, 50, 130]] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    met = []
    plain = similarity.met
    monkeypatch.setattr(similarity, "met", lambda asking, members, k: met.append(asking.count()) or plain(asking, members, k))
    got = {}
    for r in similarity.knn_join(df, 5).collect():
        got.setdefault(r.id, []).append((-round(r.score, 9), r.near))
    u = x / (np.linalg.norm(x, axis=1)[:, None] + 1e-9)
    for i in range(400):
        want = sorted((-round(float(u[i] @ u[j]), 9), j) for j in range(400) if j != i)[:5]
        assert [w for w, _ in sorted(got[i])] == [w for w, _ in want]
    assert sorted(j for _, j in got[50]) == [0, 1, 2, 3, 4]
    assert met[1] < 400 * 5


def test_greedy_groups_of_large_components(spark, monkeypatch):
    rnd = random.Random(8)
    for scan in (0, 40, 10_000):
        monkeypatch.setattr(duplicates, "SCAN", scan)
        edges = sorted({tuple(sorted(rnd.sample(range(90), 2))) for _ in range(130)} | {(200 + i, 201 + i) for i in range(12)} | {(300, i) for i in range(301, 330)})
        leader = {}
        for i in range(400):
            if i not in leader:
                for x, y in edges:
                    if x == i:
                        leader.setdefault(y, i)
        want = sorted({(v, k) for k, v in leader.items()} | {(v, v) for v in leader.values()})
        got = sorted(map(tuple, duplicates.greedy_groups(spark.createDataFrame(edges, "a long, b long")).collect()))
        assert got == want


def test_equal_codes_make_no_pairs(spark, monkeypatch):
    """Groups of very many equal codes: their ids are never paired with each other."""
    codes = [(i, "00000000000000ff") for i in range(3000)] + [(5000 + i, "00000000000000fe") for i in range(2000)] + [(1, "ffffffffffffffff"), (9000, "0f0f0f0f0f0f0f0f"), (9001, ""), (9002, None)]
    df = spark.createDataFrame(codes[:3000][::-1] + codes[3000:], "id long, phash string").where("NOT (id = 1 AND phash LIKE '00%')")
    seen = []
    plain = duplicates.greedy_groups
    monkeypatch.setattr(duplicates, "greedy_groups", lambda pairs: seen.append(pairs.count()) or plain(pairs))
    got = sorted(map(tuple, duplicates.duplicate_groups(df, 2).collect()))
    assert got == [(0, i) for i in [*range(1), *range(2, 3000), *range(5000, 7000)]] and seen == [1]


def test_search_and_normalisation(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 0.0]), (4, [0.0, 0.0]), (5, [1.0])], "id long, vector array<float>")
    hits = [r.id for r in similarity.search(df, [1.0, 0.0], 3).collect()]  # the longer of two parallel vectors first: lengths are plus 1e-9
    assert hits == [3, 1, 2]
    assert [list(r[0]) for r in df.where("id = 4").select(V.l2_normalize(F.col("vector"))).collect()] == [[0.0, 0.0]]


def test_clusters_small(spark):
    df = spark.createDataFrame([(5, [1.0, 0.0])], "id long, vector array<float>")
    assert [tuple(r) for r in similarity.threshold_clusters(df, 0.5).collect()] == [(5, 5)]
    assert similarity.threshold_clusters(df.limit(0), 0.5).collect() == []


def test_number(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(3).sample(range(1000), 200)], "x long").repartition(5)
    got = sorted((r.x, r.number) for r in similarity.number(df, ["x"], 10).collect())
    assert [n for _, n in got] == list(range(10, 210))


def test_upsert_keeps_ids_and_repeats(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, path string, size long")
    new = spark.createDataFrame([("c", 3), ("a", None), ("d", 4)], "path string, size long")
    once = merge.upsert(old, new, ["path"], "id")
    assert sorted(map(tuple, once.collect())) == [(1, "a", None), (2, "b", 2), (3, "c", 3), (4, "d", 4)]
    assert sorted(map(tuple, merge.upsert(once, new, ["path"], "id").collect())) == sorted(map(tuple, once.collect()))
    assert merge.upsert(old.limit(0), new, ["path"], "id").count() == 3


def test_upsert_of_repeated_and_null_keys(spark):
    old = spark.createDataFrame([(1, "a", 1, "x"), (2, None, 2, "y")], "id long, path string, size long, note string")
    new = spark.createDataFrame([("a", 3, "p"), ("a", 3, "q"), ("a", None, "z"), (None, 9, "n"), ("c", 1, None), ("c", 1, None)], "path string, size long, note string")
    want = [(1, "a", 3, "q"), (2, None, 9, "n"), (3, "c", 1, None)]
    once = merge.upsert(old, new, ["path"], "id")
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, merge.upsert(once, new, ["path"], "id").collect())) == want
    faces = spark.createDataFrame([(1, 5), (2, None), (None, 6)], "id long, person_id long")
    values = spark.createDataFrame([(1, 7), (1, 8), (None, 9), (3, 1)], "id long, person_id long")
    assert sorted(map(str, map(tuple, merge.assign(faces, values, "id", "person_id").collect()))) == ["(1, 8)", "(2, None)", "(None, 6)"]


def test_float_blobs(spark):
    rows = [(1, np.array([1.5, -2, 0], "<f4").tobytes()), (2, b""), (3, b"abc"), (4, None)]
    got = {r.id: r.v for r in spark.createDataFrame(rows, "id long, b binary").select("id", V.float_blob(F.col("b")).alias("v")).collect()}
    assert got == {1: [1.5, -2.0, 0.0], 2: [], 3: None, 4: None}


def test_stash_and_sweep(spark):
    kept = tables.stash(spark.range(3))
    left = os.path.join(tables.shared_dir(spark), "lumigraph", "crashed")
    os.makedirs(left)
    os.utime(left, (0, 0))
    assert tables.sweep(spark, 1) == 1 and not os.path.exists(left) and kept.count() == 3
    assert tables.stash_each(spark, [], "x long").count() == 0
    assert tables.stash_each(spark, (spark.range(n).select(F.col("id").alias("x")) for n in (2, 3)), "x long").count() == 5


def test_persons(spark):
    persons = spark.createDataFrame([(1, "Ann"), (2, "Bo")], "id long, name string")
    names = spark.createDataFrame([("Bo",), ("Cy",), ("Cy",), (None,)], "name string")
    assert sorted(map(tuple, merge.get_or_create(persons, names).collect())) == [(1, "Ann"), (2, "Bo"), (3, "Cy")]
    assert sorted(map(tuple, merge.rename(persons, 1, "Al").collect())) == [(1, "Al"), (2, "Bo")]
    with pytest.raises(ValueError, match="another"):
        merge.rename(persons, 1, "Bo")


def test_labels(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vector array<float>")
    got = tagging.rank_labels(df, ["x", "y", "z"], np.array([[0, 1], [1, 0], [1, 0]]), 2).collect()
    assert [(r.rank, r.tag) for r in got] == [(1, "y"), (2, "z")]
    assert tagging.rank_labels(df, [], np.zeros((0, 2)), 5).collect() == []
    assert tagging.rank_labels(df, ["x"], np.array([[1, 1]]), 0).collect() == []


def test_labels_in_blocks(spark, monkeypatch):
    """Blocks of labels give what one matrix gives, ties included."""
    rng = np.random.default_rng(5)
    w = rng.integers(-2, 3, (40, 4)).astype(float)
    v = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(rng.integers(-2, 3, (50, 4)))], "id long, vector array<double>")
    names = [f"l{i}" for i in range(40)]
    shown = lambda: sorted((r.id, r["rank"], r.tag, round(r.score, 9)) for r in tagging.rank_labels(v, names, w, 6).collect())
    whole = shown()
    monkeypatch.setattr(tagging, "BLOCK_BYTES", 4 * 8 * 3)
    assert shown() == whole


def test_tags_of_many_labels(spark, monkeypatch, tmp_path):
    n = 1100
    at = 2 * np.pi * np.arange(n) / n
    rows = [(i, [float(np.cos(a)), float(np.sin(a))], i) for i, a in enumerate(at)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.id: r.tag for r in queries.auto_tags(spark, str(tmp_path)).where("rank = 1").collect()}
    assert got == {i: f"label_{i}" for i in range(n)}
    monkeypatch.setattr(tagging, "MOST_LABELS", n - 1)
    with pytest.raises(ValueError, match="labels"):
        queries.auto_tags(spark, str(tmp_path))


def test_names_have_no_cap(spark, monkeypatch, tmp_path):
    spark.createDataFrame([("R",)], "r_name string").coalesce(1).write.parquet(str(tmp_path / "region.parquet"))
    many = spark.createDataFrame([(i, f"n{i}") for i in range(1500)], "id long, name string")
    given = iter([many, many.limit(1)])  # the names handed in, then the known persons
    monkeypatch.setattr(queries, "persons", lambda spark, d: next(given))
    assert queries.get_or_create_person(spark, str(tmp_path)).count() == 1501
