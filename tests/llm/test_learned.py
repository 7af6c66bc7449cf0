"""Classifiers by held-out accuracy, mixing by its targets, and the pipeline whole."""

import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumigraph.llm import arrays, labelled, mixing, quality, toxicity

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@needs_data
@pytest.mark.parametrize(("module", "label", "least"), [(quality, "quality", 0.97), (toxicity, "toxic", 0.9)])
def test_held_out(spark, module, label, least):
    out = module.query(spark, DATA)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = out.join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= module.THRESHOLD)).all()
    held = got[got["held_out"]]
    assert (held["predicted"] == held[label]).mean() >= least


@needs_data
def test_recall_of_rare_words(spark):
    """Few labels: each telling word stands in fewer than 20 documents of the sample."""
    read = lambda d, name: spark.read.parquet(f"/root/testdata/{d}/{name}.parquet")
    model = toxicity.trained(read("sf0.01", "documents"), read("sf0.01", "labels"))
    held = read("sf0.1", "documents").join(read("sf0.1", "labels"), "doc_id").where(labelled.held_out(F.col("doc_id"))).select("text", "toxic").toArrow()
    found, toxic = model(held["text"].combine_chunks()) >= toxicity.THRESHOLD, held["toxic"].to_numpy() == 1
    print(f"toxic found {(found & toxic).sum()} of {toxic.sum()}, clean flagged {(found & ~toxic).sum()} of {(~toxic).sum()}")
    assert (found & toxic).sum() >= 0.4 * toxic.sum()
    assert (found & ~toxic).sum() <= 0.1 * (~toxic).sum()


@needs_data
def test_toxic_recall(spark):
    """Fitted on the training rows of a table, over its held-out fifth.  6 % of the toxic documents of English hold no telling word."""
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet")
    model = toxicity.trained(read("documents"), read("labels"))
    held = read("documents").join(read("labels"), "doc_id").where(labelled.held_out(F.col("doc_id"))).select("text", "toxic").toArrow()
    found, toxic = model(held["text"].combine_chunks()) >= toxicity.THRESHOLD, held["toxic"].to_numpy() == 1
    print(f"toxic found {(found & toxic).sum()} of {toxic.sum()}, clean flagged {(found & ~toxic).sum()} of {(~toxic).sum()}")
    assert (found & toxic).sum() >= 0.85 * toxic.sum()
    assert (found & ~toxic).sum() <= 0.03 * (~toxic).sum()


def plain_toxic(model, text):
    """The features of one document in plain Python."""
    wrap = (1 << 32) - 1
    fold = lambda c: (ord(c.lower()) if len(c.lower()) == 1 else ord(c)) if c.isalnum() else 0
    codes = [fold(c) if ord(c) < 0x250 else ord(c) for c in text]
    found, word = [], []
    for c in [*codes, 0]:
        if c:
            word.append(c)
        elif word:
            found.append(word)
            word = []
    bits = 32 - toxicity.BUCKETS.bit_length() + 1

    def buckets(word):
        h = 0
        for i, c in enumerate(word):
            x = (c + (i + 1) * 0x9E3779B9 & wrap) * 0x85EBCA6B & wrap
            h = h + ((x ^ x >> 15) * 0xC2B2AE35 & wrap) & wrap
        yield (h * 0x27D4EB2F & wrap) >> bits
        around = [0, *word, 0]
        for n in toxicity.GRAMS:
            for i in range(len(around) - n + 1):
                h = n
                for j, c in enumerate(around[i : i + n]):
                    h = (h ^ ((c + j + 1) * int(toxicity._MULTIPLY[j]) & wrap)) * 0x85EBCA6B & wrap
                    h ^= h >> 13
                yield (h * 0xC2B2AE35 & wrap) >> bits

    logits = []
    for i in range(0, len(found), toxicity.PASSAGE):
        own = [b for w in dict.fromkeys(map(tuple, found[i : i + toxicity.PASSAGE])) for b in buckets(list(w)) if model.known[b]]
        logits.append(model.bias + sum(float(model.weight[b]) for b in own) / (len(own) + toxicity.PRIOR))
    p = lambda z: 1 / (1 + np.exp(-z))
    if not logits:
        return [model.bias, model.bias, p(model.bias), 0.0, 1.0]
    return [np.mean(logits), max(logits), np.mean([p(z) for z in logits]), np.log(len(logits)), 1.0]


def test_toxicity_scores_plainly():
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["good", "Bad!!", "über", "x|y", "\n", "idiot", "日本語", "a", "İx"]) for _ in range(rnd.randrange(0, 150))) for _ in range(40)] + ["", "..", "one"]
    model = toxicity.fit(pa.array(texts), np.array([float("idiot" in t) for t in texts]))
    got = model.features(pa.array(texts))
    assert model.known.any() and np.allclose(got, [plain_toxic(model, t) for t in texts], atol=1e-6)


def test_toxicity_gradients():
    rng = np.random.default_rng(5)
    net = toxicity.Net(rng, 12)
    net.e, net.w = net.e.astype(float), net.w.astype(float)
    b, n, label, share = np.array([0, 3, 3, 5, 11, 2]), np.array([3, 1, 2]), np.array([1, 0, 1]), np.array([0.5, 2.0, 0.7])

    def loss():
        z = net.means(b, n) @ net.w + net.bias
        return (share * (np.log(np.exp(z).sum(1)) - z[np.arange(3), label])).mean()

    unique, ge, gw, gb = net.gradients(b, n, label, share)
    full = np.zeros_like(net.e)
    full[unique] = ge
    for value, grad in ((net.e, full), (net.w, gw), (net.bias, gb)):
        flat = value.reshape(-1)
        for i in range(len(flat)):
            was = flat[i]
            flat[i] = was + 1e-4
            up = loss()
            flat[i] = was - 1e-4
            down = loss()
            flat[i] = was
            assert abs((up - down) / 2e-4 - grad.reshape(-1)[i]) < 1e-7


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_do_not_depend_on_company(module):
    rnd = random.Random(0)
    texts = [" ".join(rnd.choice(["good", "bad!!", "über", "x|y", "\n", "idiot"]) for _ in range(rnd.randrange(0, 400))) for _ in range(60)] + ["", " \n", "é", "word " * 20_000]
    y = np.array([float("idiot" in t) for t in texts])
    model = module.fit(pa.array(texts), y)
    together = model(pa.array([*texts, None]))
    alone = np.concatenate([model(pa.array([t])) for t in texts])
    assert np.allclose(together[:-1], alone, atol=1e-9) and together[-1] == together[texts.index("")]


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifier_edge_rows(spark, module):
    """Nulls, repeated rows, one doc_id with several texts, a very long text, clashing columns, labels of documents that are not there."""
    rows = [(1, "a b"), (2, None), (None, "x"), (1, "a b"), (1, "other words"), (3, "long words " * 100_000), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(9)).withColumn("c0", F.lit("y"))
    labels = spark.createDataFrame([(1, 1, 1), (1, None, None), (None, 1, 1), (77, 0, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        got = module.score(docs, some).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert module.score(docs.limit(0), labels).count() == 0
    kept = labelled.scored(docs, module.fit(pa.array([], pa.string()), np.zeros(0)), "score_")
    assert kept.columns == [*docs.columns, "score_"] and kept.count() == len(rows)


def test_sample_is_of_documents_that_are_there(spark):
    """Labels without a document don't use up the bound; bytes are bounded; of several texts of a doc_id one counts."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, f"text {i} " + "x" * (i % 7)) for i in ids[-60:]] + [(ids[-1], "another"), (ids[-2], "y" * 5000), (None, "z")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(ids[-1], 1), (None, 1)], "doc_id long, toxic int")
    texts, y = labelled.sample(docs, labels, "toxic", rows=50)
    assert len(texts) == len(y) == 50 and len(set(texts.to_pylist())) == 50
    assert {t for t in texts.to_pylist() if t[0] == "t"} <= {f"text {i} " + "x" * (i % 7) for i in ids[-60:]}
    again, _ = labelled.sample(docs.repartition(3), labels.repartition(2), "toxic", rows=50)
    assert again.to_pylist() == texts.to_pylist()
    few, y = labelled.sample(docs, labels, "toxic", rows=1000, most=300)
    assert sum(map(len, few.to_pylist())) <= 300 and len(few) == len(y) > 10
    assert len(labelled.sample(docs, labels, "toxic", most=0)[0]) == 0


def test_quality_gradients():
    """Every weight's gradient against differences of the loss."""
    rng = np.random.default_rng(1)
    texts = ["Some words, of one kind. And more of them " * 9, "|| bars |x| (y) 12 34", "aa aa aa aa bb", "é" * 50 + " word " * 120]
    pieces = [quality.encode(t) for t in arrays.texts(pa.array(texts))]
    x, doc = pieces[0]
    first, y = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), np.array([1.0, 0, 0, 1])
    shapes = {"enc": (quality.FEATURES, 4), "enc_b": (4,), "gate_v": (4, 3), "gate_u": (4, 3), "att": (3,), "out": (4,), "out_b": (1,)}
    model = quality.Model({k: rng.normal(size=v) for k, v in shapes.items()}, x.mean(0), x.std(0) + 1e-3)

    def loss():
        z = model.forward(x, first)["logit"]
        return (np.logaddexp(0, z) - y * z).mean()

    for name, grad in quality.gradients(model, x, first, y).items():
        flat = model.w[name].reshape(-1)
        for i in range(len(flat)):
            was = flat[i]
            flat[i] = was + 1e-5
            up = loss()
            flat[i] = was - 1e-5
            down = loss()
            flat[i] = was
            assert abs((up - down) / 2e-5 - grad.reshape(-1)[i]) < 1e-6, name


def test_quality_scores_plainly():
    """A document's score from its passages, one by one."""
    texts = ["one two three " * 60, "short", "x " * 500 + "Y."]
    model = quality.fit(pa.array(texts * 10), np.tile([1.0, 0, 0], 10))
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for text, score in zip(texts, model(pa.array(texts)), strict=True):
        x, _ = quality.encode(next(arrays.texts(pa.array([text]))))
        h = [np.tanh((v - model.mean) / model.spread @ model.w["enc"] + model.w["enc_b"]) for v in x]
        e = [float((np.tanh(v @ model.w["gate_v"]) * sigmoid(v @ model.w["gate_u"])) @ model.w["att"]) for v in h]
        a = [np.exp(v) / sum(np.exp(e)) for v in e]
        z = sum(p * v for p, v in zip(a, h, strict=True))
        assert abs(sigmoid(z @ model.w["out"] + model.w["out_b"][0]) - score) < 1e-9


def resharing(sizes, weights=(5, 2, 1)):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in target]
        left = total - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        target |= {s: 3.0 * sizes[s] for s in over}


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 16)
    monkeypatch.setattr(mixing, "FAN", 3)
    rnd = random.Random(0)
    source = ["b", "a", "é", "Z", "tiny", None]
    rows = [(i, " ".join("w" for _ in range(rnd.randrange(0, 60))), source[min(5, int(rnd.expovariate(0.8)))]) for i in range(900)]
    rows += [(903, "many words " * 30_000, "b"), (903, "other words", "b")]
    rows += [(900, None, "a"), (901, "", "b"), (None, "x y", "b"), (902, "one two", "tiny"), (5, rows[5][1], rows[5][2]), (902, "one two", "tiny")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, source string, copies int, `rows` string").repartition(5)
    out = mixing.mix(df).toPandas()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    want = resharing(size)
    assert out["rows"].sum() == len(rows)
    for s, t in want.items():
        own = out[out["source"].isna() if s is None else out["source"] == s]
        assert np.allclose(own["target"], t) and (own["source_size"] == size[s]).all()
        assert abs((own["copies"] * own["size"] * own["rows"]).sum() - t) <= (120 if s != "b" else 60_000)
        whole = int(t / size[s]) if size[s] else 0
        assert own["copies"].between(whole, whole + 1).all() and (own["copies"] <= 3).all()
    again = mixing.mix(df.repartition(2)).toPandas()
    key = ["doc_id", "source", "print"]
    assert again.sort_values(key)["copies"].tolist() == out.sort_values(key)["copies"].tolist()
    taken = mixing.mixed(df)
    assert taken.columns == [*df.columns, "copy_no"]
    assert taken.count() == (out["copies"] * out["rows"]).sum()
    assert mixing.mix(df.limit(0)).count() == 0


def test_pivot_keeps_mass_and_expectation():
    rng = np.random.default_rng(0)
    mass, p = rng.integers(1, 50, 40).astype(float), rng.random(40)
    total = np.zeros(40)
    for _ in range(4000):
        q = mixing.pivot(mass, p, rng.random(40))
        assert ((q > 0) & (q < 1)).sum() <= 1 and abs((mass * (q - p)).sum()) < 1e-6
        total += q
    assert np.abs(total / 4000 - p).max() < 0.05


@needs_data
def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stash(stage(spark, docs, DATA))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert 0.5 * n < docs.count() <= n
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == [*docs.columns, "copy_no"]
    assert out.select("doc_id").distinct().join(docs, "doc_id", "left_anti").count() == 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0


def words_of(text, apart):
    return [w for w in re.split(apart, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage on a small table, with nulls, repeats, ties, a long text and clashing columns, against plain Python."""
    rnd = random.Random(6)
    vocabulary = [f"word{i}" for i in range(400)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n)).capitalize() + "."
    junk = lambda n: " ".join(rnd.choice(["|||", "<>", "##", "99", "x"]) for _ in range(n))
    shared = [f"This line number {i} stands in very many of the documents" for i in range(3)]
    items = [(1, prose(14)), (2, prose(5)), (3, None), (None, prose(12))]
    rows, labels = [], []
    for i in range(150):
        bad = rnd.random() < 0.3
        parts = [junk(30) if bad else prose(30) for _ in range(rnd.randrange(1, 5))] + rnd.sample(shared, rnd.randrange(0, 3))
        rnd.shuffle(parts)
        rows.append((i, "\n".join(parts)))
        labels.append((i, int(not bad), 0))
    good = [i for i, y, _ in labels if y]
    for k in range(30):
        w = rows[rnd.choice(good)][1].split(" ")
        w[rnd.randrange(len(w))] = "changed"
        rows.append((200 + k, " ".join(w)))
    rows += [(300, prose(20) + " " + items[0][1]), (301, items[1][1] + " " + prose(20)), (302, prose(9) + " " + items[3][1]), (303, None), (304, ""), (305, rows[good[0]][1]), (305, rows[good[0]][1]), (None, prose(40)), (306, prose(40_000)), (307, shared[0])]
    docs = [(i, t, "en", rnd.choice(["a", "b", None]), len(t or ""), k) for k, (i, t) in enumerate(rows)]
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, lg_gone long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    start = spark.read.parquet(f"{d}/documents.parquet")
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    outs, frame = [], start
    for _, stage in corpus_pipeline.STAGES:
        frame = corpus_pipeline.stash(stage(spark, frame, d))
        outs.append(sorted(map(tuple, frame.select(*start.columns, *[c for c in frame.columns if c not in start.columns]).collect()), key=key))

    model = quality.trained(start, spark.read.parquet(f"{d}/labels.parquet"))
    now = [r for r in docs if model(pa.array([r[1]], pa.string()))[0] >= quality.THRESHOLD]
    assert outs[0] == sorted(now, key=key) and 100 < len(now) < len(docs)

    line = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for r in now:
        for x in (r[1] or "").split("\n"):
            holders.setdefault(line(x), set()).add(r[0])
    stays = {k: max(i for i in v if i is not None) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    cut = lambda r: [x for x in r[1].split("\n") if stays.get(line(x), r[0]) == r[0]]
    now = [r if r[1] is None or len(cut(r)) == r[1].count("\n") + 1 else (r[0], "\n".join(cut(r)), *r[2:]) for r in now]
    assert outs[1] == sorted(now, key=key) and len(stays) == 3

    sets = {}
    for r in now:
        w = words_of(r[1], r"[\x20\x09-\x0D]+")
        sets[r[-1]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = {r[-1]: r[0] for r in now}
    link = lambda a, b: ids[a] is not None and ids[b] is not None and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    gone = set()
    for k in sets:
        seen, todo = set(), [k]
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += [y for y in sets if y not in seen and link(x, y)]
        if ids[k] is not None and ids[k] > min(ids[x] for x in seen if ids[x] is not None):
            gone.add(k)
    now = [r for r in now if r[-1] not in gone]
    assert outs[2] == sorted(now, key=key) and len(gone) >= 20

    def hit(text):
        w = words_of(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        for _, t in items:
            v = words_of(t, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
            n = min(10, len(v))
            grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            if any(tuple(w[i : i + n]) in grams for i in range(len(w) - n + 1)):
                return True
        return False

    now = [r for r in now if not hit(r[1])]
    assert outs[3] == sorted(now, key=key) and not {300, 301, 302} & {r[0] for r in now}

    taken = {}
    for r in outs[4]:
        taken.setdefault(r[:-1], []).append(r[-1])
    assert set(taken) <= set(now) and all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= 3 for v in taken.values())
    sizes = {}
    for r in now:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    for source, target in resharing(sizes).items():
        own = [(len((r[1] or "").split()), len(taken.get(r, ()))) for r in now if r[3] == source]
        assert abs(sum(a * b for a, b in own) - target) <= max(a for a, _ in own)
        assert all(int(target / sizes[source]) <= b <= int(target / sizes[source]) + 1 for a, b in own if a)
