"""Stored indexes that grow batch by batch, against working everything out anew."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigraph.operators import code_index, components, duplicates, similarity, stored_index
from lumigraph.operators.code_index import CodeIndex
from lumigraph.operators.vector_index import VectorIndex


@pytest.fixture(autouse=True)
def few_parts(monkeypatch):
    """Small tables in few files."""
    monkeypatch.setattr(stored_index, "PARTS", 3)


def vector_rows(seed, n, dim=8, groups=12):
    """Vectors around some directions; equal ones, opposite ones, and some of length zero."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dim))
    x = middle[rng.integers(0, groups, n)] + rng.normal(size=(n, dim)) * 0.15
    x[::17], x[5::41] = x[0], 0
    x[3::29] *= -1
    return [(i, [float(np.float32(v)) for v in x[i]]) for i in range(n)]


def edges_of(df):
    return sorted((r.id, r.near, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("lists", [1, 12])
def test_knn_in_batches(spark, tmp_path, lists):
    """After each of three batches the edges are those of all vectors so far."""
    rows = vector_rows(1, 260)
    random.Random(1).shuffle(rows)
    index = VectorIndex(spark, str(tmp_path / "index"), k=4)
    schema = "id long, vector array<float>"
    for end, start in ((120, 0), (200, 120), (260, 200)):
        assert index.add(spark.createDataFrame(rows[start:end], schema), lists=lists) == end - start
        want = edges_of(similarity.knn_join(spark.createDataFrame(rows[:end], schema), 4))
        assert edges_of(index.neighbours()) == want
    assert index.add(spark.createDataFrame([(999, [1.0]), (998, None)], schema)) == 0


def test_index_reads_few_lists(spark, tmp_path):
    """A search, and a few new vectors, look at lists near them only."""
    rows = vector_rows(2, 700, dim=16, groups=24)
    index = VectorIndex(spark, str(tmp_path / "index"), k=3)
    schema = "id long, vector array<float>"
    index.add(spark.createDataFrame(rows[:690], schema), lists=24)
    vectors = spark.createDataFrame(rows, schema)
    index.lists_read.clear()
    index.add(spark.createDataFrame(rows[690:692], schema))
    assert len(set(index.lists_read)) < 20  # of 24
    index.add(spark.createDataFrame(rows[692:], schema))
    assert edges_of(index.neighbours()) == edges_of(similarity.knn_join(vectors, 3))
    read = []
    for i in (0, 100):
        index.lists_read.clear()
        got = [(r.id, round(r.score, 9)) for r in index.search(rows[i][1], 10).collect()]
        assert got == [(r.id, round(r.score, 9)) for r in similarity.search(vectors, rows[i][1], 10).collect()]
        read.append(len(set(index.lists_read)))
    assert max(read) < 20


@pytest.mark.parametrize("k", [1, 20, 150, 400])
def test_search_is_exact(spark, tmp_path, k):
    """Also where it must go on to opposite vectors and to those of length zero, or asks for more than there are."""
    rows = vector_rows(3, 300)
    index = VectorIndex(spark, str(tmp_path / "index"))
    schema = "id long, vector array<float>"
    assert index.search([1.0] * 8, k).count() == 0
    index.add(spark.createDataFrame(rows, schema), lists=9)
    for query in (rows[1][1], [0.0] * 8, [1.0] + [0.0] * 7):
        want = similarity.search(spark.createDataFrame(rows, schema), query, k).collect()
        assert [(r.id, round(r.score, 9) + 0.0) for r in index.search(query, k).collect()] == [(r.id, round(r.score, 9) + 0.0) for r in want]


def labels(df):
    return sorted(map(tuple, df.select("id", "component").collect()))


@pytest.mark.parametrize("seed", range(3))
def test_components_in_batches(spark, seed):
    """New edges into known labels, and edges taken away, against all edges at once; nulls and loops too."""
    rnd = random.Random(seed)
    edge = lambda: (rnd.randrange(120), rnd.randrange(120))
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    edges = [edge() for _ in range(30)]
    known = components.connected_components(frame(edges), "a", "b")
    for _ in range(2):
        new = [edge() for _ in range(25)] + [(None, 5), (7, 7), (None, None)]
        known = spark.createDataFrame(components.with_edges(known, frame(new), "a", "b").collect(), "id long, component long")
        edges += new
        assert labels(known) == labels(components.connected_components(frame(edges), "a", "b"))
    whole = [e for e in edges if None not in e and e[0] != e[1]]
    gone = rnd.sample(whole, 12)
    left = [e for e in whole if e not in gone]
    got = {r.id: r.component for r in components.without_edges(known, frame(gone), frame(left), "a", "b").collect()}
    want = {r.id: r.component for r in components.connected_components(frame(left), "a", "b").collect()}
    assert got == {x: want.get(x, x) for e in whole for x in e}


def test_components_touch_what_edges_join(spark):
    """What moves is bound by the new edges, whatever is known."""
    known = spark.range(1000).select("id", (F.col("id") - F.col("id") % 10).alias("component"))
    moved = components.merged_components(known, spark.createDataFrame([(15, 27), (28, 33), (999, 2000)], "a long, b long"), "a", "b")
    assert sorted(map(tuple, moved.collect())) == [(20, 10), (30, 10), (2000, 990)]


@pytest.mark.parametrize("limit,expected", [(5, 10_000_000), (5, 100), (0, 1000), (12, 1000)])
def test_codes_in_batches(spark, tmp_path, limit, expected):
    rnd = random.Random(limit)
    base = [rnd.getrandbits(64) for _ in range(25)]
    flip = lambda x, n: x ^ sum(1 << i for i in rnd.sample(range(64), n))
    rows = [(i, f"{flip(rnd.choice(base), rnd.randrange(0, limit + 2)):016x}") for i in range(160)]
    rnd.shuffle(rows)
    rows += [(1000, None), (1001, "")]
    index = CodeIndex(spark, str(tmp_path / "index"), limit, expected)
    frame = lambda rows: spark.createDataFrame(rows, "id long, phash string")
    for end, start in ((80, 0), (82, 80), (162, 82)):
        index.add(frame(rows[start:end]))
        want = duplicates.duplicate_groups(frame(rows[:end]), limit)
        assert sorted(map(tuple, index.groups().collect())) == sorted(map(tuple, want.collect()))
    assert index.add(frame(rows[:2]).where("id < 0")) == 0


@pytest.mark.parametrize(("limit", "expected"), [(18, 1000), (5, 10_000_000)])
def test_many_new_codes_are_not_broadcast(spark, tmp_path, monkeypatch, limit, expected):
    """The tries of many codes, hundreds of rows each, stay with the executors; wide limits compare blocks."""
    monkeypatch.setattr(code_index, "BROADCAST_ROWS", 0)
    plans = []
    append = stored_index.Catalog.append
    seen = lambda self, name, new, *rest: (plans.append(new._jdf.queryExecution().toString()) if name == "pairs" else None, append(self, name, new, *rest))[1]
    rng = np.random.default_rng(limit)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    rows = [(i, f"{base[i % 40] ^ sum(1 << int(k) for k in set(rng.integers(0, 64, i % 12).tolist())):016x}") for i in range(240)]
    index = CodeIndex(spark, str(tmp_path / "index"), limit, expected)
    frame = lambda rows: spark.createDataFrame(rows, "id long, phash string")
    with monkeypatch.context() as m:
        m.setattr(stored_index.Catalog, "append", seen)
        for start, end in ((0, 150), (150, 240)):
            index.add(frame(rows[start:end]))
    assert len(plans) == 2 and not any("BroadcastHashJoin" in p or "BroadcastExchange" in p for p in plans)
    codes = sorted({int(x, 16) - (int(x, 16) >> 63 << 64) for _, x in rows})
    bits = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    want = [(a, b, bits(a, b)) for i, a in enumerate(codes) for b in codes[i + 1 :] if bits(a, b) <= limit]
    assert sorted(map(tuple, index.pairs().collect())) == want and len(want) > 50


@pytest.mark.parametrize("block", [7, 4096])
def test_codes_near(spark, block):
    rng = np.random.default_rng(3)
    old, new = ([int(x) for x in rng.integers(0, 1 << 40, n)] for n in (30, 20))
    frame = lambda x: spark.createDataFrame([(i,) for i in x], "code long")
    got = duplicates.codes_near(frame(new), frame(old + new), 15, len(new), len(old + new), block)
    want = {(min(a, b), max(a, b), (a ^ b).bit_count()) for a in new for b in old + new if a != b and (a ^ b).bit_count() <= 15}
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
