"""Joins of near copies against brute force."""

import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumigraph.llm import arrays, embed_dedup, ngram_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    c = components(sets, links)
    return {i: (len(s), c[i]) for i, s in sets.items()}


def corpus(seed, n):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "été", "x|y"]
    text = lambda k: [rnd.choice(words) for _ in range(k)]
    passage, docs = text(30), []
    while len(docs) < n:
        w = text(rnd.choice([1, 3, 4, 5, 6, 9, 20, 60, 200]))
        if rnd.random() < 0.5:
            w = passage[: rnd.randrange(30)] + w
        docs.append(w)
        for _ in range(rnd.choice([0, 0, 1, 6])):
            v = list(w)
            for _ in range(rnd.choice([0, 1, 1, 2, len(v) // 30])):
                v[rnd.randrange(len(v))] = rnd.choice(words)
            if rnd.random() < 0.3:
                v = v[: max(1, len(v) * 9 // 10)]
            docs.append(v)
    rnd.shuffle(docs)
    return [(i * 3 % (3 * n + 1), rnd.choice([" ", "\n", "\t "]).join(w).upper() if rnd.random() < 0.1 else " ".join(w)) for i, w in enumerate(docs[:n])]


@pytest.mark.parametrize("seed", [1, 2])
def test_join(spark, seed):
    docs = corpus(seed, 260)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()}
    assert got == brute(docs)


def test_join_in_chunks(spark):
    docs = corpus(3, 120) + [(10_000 + i, " ".join(f"h{j}" for j in range(60) if j != i)) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df, task_shingles=200, task_sets=5).collect()}
    assert got == brute(docs)


def test_join_edge_rows(spark):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  B"), (6, long), (7, long + " end"), (7, long + " end"), (None, "a b"), (None, None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, N int, `group` int")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in ngram_join.join(df).collect())
    assert got == [(-1, 0, None), (-1, 1, None), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 29_996, 6), (7, 29_997, 6), (7, 29_997, 6)]
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 1, 2, 3, 4, 6]
    assert ngram_join.join(df.limit(0)).collect() == []


def changed(words, *at):
    return " ".join(f"c{i}" if i in at else w for i, w in enumerate(words))


@pytest.mark.parametrize("turn", [0, 1, 2])
def test_join_repeated_ids(spark, turn):
    """One doc_id with several texts: each text links, whatever the order of rows."""
    w = [f"w{i}" for i in range(104)]
    a, b, c = changed(w), changed(w, 10), changed(w, 10, 40, 60)
    rows = [(7, a), (7, b), (9, c), (-3, "far from all of these words"), (7, "far from all of these words")]
    df = spark.createDataFrame(rows[turn:] + rows[:turn], "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(df).collect())
    assert got == [(-3, 2, -3), (7, 2, -3), (7, 100, 7), (7, 100, 7), (9, 100, 7)]
    assert sorted((r.doc_id, len(r.text)) for r in ngram_join.keep_one(df).collect()) == sorted([(-3, len(rows[3][1])), (7, len(a)), (7, len(b))])


@pytest.mark.parametrize("sets", [7, 40])
def test_join_in_rounds(spark, sets):
    """Clusters of many chunks: one of near copies, one of a chain of links, one of sets that share much and don't link."""
    rnd = random.Random(sets)
    base = [f"b{i}" for i in range(120)]
    docs = [(i, changed(base, rnd.randrange(120))) for i in range(90)]
    chain = [f"k{i}" for i in range(300)]
    docs += [(1000 + i, " ".join(chain[2 * i : 2 * i + 100])) for i in range(90)]
    docs += [(2000 + i, " ".join([f"s{j}" for j in range(60)] + [f"o{i}x{j}" for j in range(16)])) for i in range(60)]
    rnd.shuffle(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string"), task_sets=sets).collect()}
    assert got == brute(docs)


def test_combined_keys_tie_the_same():
    rng = np.random.default_rng(2)
    key, node = rng.integers(0, 300, 900).astype(np.uint64), rng.integers(0, 400, 900)
    key[:500] = 5
    keys, nodes = ngram_join.combined(key, node)
    assert (keys == 5).sum() == 1 and max(np.unique(keys, return_counts=True)[1]) == 2 and set(key.tolist()) <= set(keys.tolist())

    def parts(key, node):
        by = {}
        for k, n in zip(key.tolist(), node.tolist(), strict=True):
            by.setdefault(k, []).append(n)
        return components(set(node.tolist()), [(x[0], y) for x in by.values() for y in x[1:]])

    assert parts(keys, nodes) == parts(key, node)
    assert all(len(x) == 0 for x in ngram_join.combined(key[:0], node[:0]))


def test_word_hashes():
    """Words and their complements, of any length, alone and among others."""
    turn = str.maketrans("ab", "ba")
    word, words = "a", ["x" * n for n in range(1, 40)] + ["abcdefgh" * 2 + "ijklmnop", "abcdefgh" + "ijklmnop" + "abcdefgh"]
    for _ in range(12):
        word += word.translate(turn)
        words += [word, word.translate(turn)]
    t = next(arrays.texts(pa.array([" ".join(words)])))
    begin, end, _ = arrays.words(t)
    h = arrays.hashes(t.data, begin, end)
    assert len(h) == len(set(words)) == len(set(h.tolist()))
    for w, x in zip(words, h.tolist(), strict=True):
        alone = next(arrays.texts(pa.array([w.upper()])))
        assert arrays.hashes(alone.data, np.array([0]), np.array([len(w)])).tolist() == [x]


def test_every_link_shares_a_key():
    rng = np.random.default_rng(0)
    for n in [*range(1, 60), 100, 333, 1000]:
        for _ in range(6):
            drop = int(rng.integers(0, n // 9 + 1))
            base = np.sort(rng.integers(1, 1 << 63, n + drop, dtype=np.uint64))
            x, y = np.sort(rng.permutation(base)[:n]), np.sort(rng.permutation(base)[:n])
            common = len(np.intersect1d(x, y))
            if 5 * common < 4 * (len(x) + len(y) - common):
                continue
            keys = [ngram_join.keys_of(s, np.array([len(s)]), base[: n // 2]) for s in (x, y)]
            assert {*zip(keys[0][0].tolist(), keys[0][2].tolist())} & {*zip(keys[1][0].tolist(), keys[1][2].tolist())}


def test_keys_of_short_sets_leave_out_hot_shingles():
    """Short texts that share a line that many have get no key in common; those that link do, whichever order the hot shingles are in."""
    rng = np.random.default_rng(5)
    shingles = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    for n in (12, 30, 60):
        line = np.sort(shingles(n) >> np.uint64(8))  # the least hashes of all
        hot, ranks = np.sort(line), rng.permutation(n)
        keys = lambda s: {(int(k), int(r)) for k, _, r in zip(*ngram_join.keys_of(np.sort(s), np.array([len(s)]), hot, ranks), strict=True)}
        one, other = (np.concatenate([line[: n // 2], shingles(n - n // 2)]) for _ in range(2))
        assert not keys(one) & keys(other)
        mostly = n // 10
        for own in (0, n // 2, n):  # of all shingles, so many are hot
            base = np.concatenate([line[:own], shingles(n - own)])
            near = np.concatenate([base[mostly:], shingles(mostly)]) if own < n else np.concatenate([base[: n - mostly], shingles(mostly)])
            assert ngram_join.linked(np.sort(base), np.sort(near)) and keys(base) & keys(near)


def families(seed, n):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(n):
        s = rng.integers(1, 1 << 63, 50, dtype=np.uint64)
        for _ in range(rng.integers(1, 8)):
            t = s.copy()
            t[rng.integers(0, 50, rng.integers(0, 9))] += np.uint64(1)
            sets.append(np.unique(t))
    return sets


def same_parts(first, want):
    return len({(int(a), want[i]) for i, a in enumerate(first)}) == len(set(want.values())) == len(set(first.tolist()))


def test_tree_against_all_pairs():
    sets, looked = families(5, 30), []
    links = [(i, j) for i in range(len(sets)) for j in range(i) if ngram_join.linked(sets[i], sets[j])]
    assert links == [(i, j) for i in range(len(sets)) for j in range(i) if 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))]
    want = components(range(len(sets)), links)
    assert same_parts(ngram_join.tree_links(sets, looked=looked), want)
    side = np.arange(len(sets)) % 3 == 0
    across = components(range(len(sets)), [p for p in links if side[p[0]] != side[p[1]]])
    assert same_parts(ngram_join.tree_links(sets, side=side), across)
    known = [want[i] for i in range(len(sets))]
    assert same_parts(ngram_join.tree_links(sets, known, looked=looked), want)
    assert len(ngram_join.tree_links(sets[:2], side=np.array([True, True]))) == 2


def test_tree_prunes():
    """Of all pairs of sets few are compared, and only by the bound: without it, or with all known, the counts tell."""
    sets, looked = families(6, 60), []
    first = ngram_join.tree_links(sets, looked=looked)
    pairs = len(sets) * (len(sets) - 1) // 2
    assert looked[0] < pairs / 20
    ngram_join.tree_links(sets, first.tolist(), looked=looked)
    assert looked[1] <= looked[0]
    ngram_join.tree_links(sets, [0] * len(sets), looked=looked)
    assert looked[2] == 0


def brute_vectors(rows, cosine=0.98):
    ok = {}
    for k, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = np.array(v, np.float32).astype(float)
            ok[k] = (v / np.linalg.norm(v), label)
    links = [(a, b) for a in ok for b in ok if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] >= cosine]
    n = {k: sum(k in p for p in links) for k in range(len(rows))}
    c = components(range(len(rows)), links)
    least = {}
    for k, r in c.items():
        if rows[k][0] is not None:
            least[r] = min(least.get(r, rows[k][0]), rows[k][0])
    return sorted((rows[k][0] if rows[k][0] is not None else -1, n[k], least.get(c[k]) if rows[k][0] is not None else None) for k in range(len(rows)))


@pytest.mark.parametrize("chunk", [7, 2048])
def test_vectors(spark, monkeypatch, chunk):
    monkeypatch.setattr(embed_dedup, "CHUNK", chunk)
    monkeypatch.setattr(embed_dedup, "PER_LIST", 8)
    rng = np.random.default_rng(chunk)
    rows = []
    for i in range(60):
        v = rng.normal(size=12)
        for _ in range(rng.integers(1, 7)):
            rows.append((len(rows), (v + rng.normal(size=12) * rng.choice([0, 0.05, 0.12])).tolist(), int(rng.integers(0, 2))))
    rows += [(600 + i, (np.eye(5)[i % 2] + rng.normal(size=5) * 0.1).tolist(), i % 3 % 2) for i in range(40)] + [(700, [1.0, 0.0], 1), (701, [1.0, 0.01], 1), (702, [-0.0, 3.0], 1), (703, [0.0, 1.0], 1)]
    rows += [(500, None, 1), (501, [0.0] * 12, 1), (502, [float("nan")] * 12, 1), (503, rows[0][1], None), (504, [1.0], 1), (None, rows[0][1], 1), (505, [float("inf"), *[0.0] * 11], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep string")
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df).collect())
    assert got == brute_vectors(rows)
    out = embed_dedup.near_duplicates(df)
    assert out.where("kept <> (vec_id <=> component_id AND vec_id IS NOT NULL)").count() == 0
    assert embed_dedup.near_duplicates(df.limit(0)).collect() == []
    assert embed_dedup.near_duplicates(df.where(F.col("vec_id") == 501)).first().n_links == 0


def test_vectors_at_the_edge(spark):
    """A cosine of exactly 0.98, very large and very small vectors, and a length that the sample lacks."""
    v = [49.0, 7.0, 7.0, 1.0]
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (2, v), (3, [x * 2.0**900 for x in v]), (4, [x * 2.0**-1000 for x in v]), (5, [49.0, 7.0, 7.0, 1.1]), (6, [1.0, 0.0, 0.0, 0.0, 0.0]), (7, [2.0, 0.0, 0.0, 0.0, 0.1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int")
    for sample in (1, 100):
        got = sorted((r.vec_id, r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df, sample=sample).collect())
        assert got == [(1, 3, 1), (2, 4, 1), (3, 4, 1), (4, 4, 1), (5, 3, 1), (6, 1, 6), (7, 1, 6)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data here")
def test_vectors_of_the_tables(spark):
    """Several lists and probes: all links that a product of the whole table finds."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = np.array(df.orderBy("vec_id").toArrow()["embedding"].to_pylist(), float)
    pdf = df.select("vec_id", "label").orderBy("vec_id").toPandas()
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.98) & (pdf["label"].to_numpy()[:, None] == pdf["label"].to_numpy()) & ~np.eye(len(x), dtype=bool)
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(df).collect()}
    assert [got[i].n_links for i in pdf["vec_id"]] == near.sum(1).tolist()
    c = components(range(len(x)), np.argwhere(near).tolist())
    assert [got[i].component_id for i in pdf["vec_id"]] == [pdf["vec_id"][c[k]] for k in range(len(x))]


def test_bounds_hold():
    """Vectors within the radius are in a probed list, and their table distance passes."""
    rng = np.random.default_rng(8)
    x = embed_dedup.unit(rng.normal(size=(800, 4)))
    index, radius = embed_dedup.Index(x, 25), 0.2
    at = embed_dedup.nearest(x, index.coarse)
    codes, error = index.encode(x, at)
    row, place = index.probes(x, at, radius)
    probed = set(zip(row.tolist(), place.tolist(), strict=True))
    near = np.argwhere((x @ x.T >= 0.98) & ~np.eye(800, dtype=bool))
    assert len({(int(at[a]), int(at[b])) for a, b in near if at[a] != at[b]}) > 5 and len(probed) < 800 * 12
    for a, b in near.tolist():
        assert at[a] >= at[b] or (b, int(at[a])) in probed
        assert index.far(x[a : a + 1], int(at[b]), codes[b : b + 1])[0, 0] <= (radius + error[b]) ** 2 + embed_dedup.SLACK
