"""Operators on single texts and lines against plain Python."""

import math
import os
import random
import re
import string
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from lumigraph.llm import decontaminate, line_dedup, pii, secrets, url_filter
from lumigraph.llm.spans import listed, replaced

EXTRA = "doc_id long, text string, pos int, H1 int, line string, w int, spans string, d long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3, "y", 4) for r in rows], EXTRA)


def low(x):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x)


@pytest.mark.parametrize("sent", [line_dedup.BROADCAST_DROPS, -1])
def test_lines(spark, monkeypatch, sent):
    monkeypatch.setattr(line_dedup, "BROADCAST_DROPS", sent)
    rnd = random.Random(0)
    common = [f"Common line number {i} that is long enough to count" for i in range(4)] + ["É" * 45, "short"]
    rows = []
    for i in range(60):
        ls = [rnd.choice(common) if rnd.random() < 0.5 else f"own line {rnd.random()} of document number {i}, long enough" for _ in range(rnd.randrange(1, 9))]
        rows.append((i, "\n".join(x.upper() if rnd.random() < 0.2 else f" \t{x}\r" if rnd.random() < 0.2 else x for x in ls)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, common[0]), (103, "\n".join([common[1]] * 5000)), (59, rows[59][1])]
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders.setdefault(low(x.strip(" \t\n\x0b\x0c\r")), set()).add(i)
    gone = {k: max(x for x in v if x is not None) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    want = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if gone.get(low(x.strip(" \t\n\x0b\x0c\r")), i) == i]
        want.append((i if i is not None else -1, len(ls), len(ls) - len(kept), "\n".join(kept) if len(kept) < len(ls) else t))
    df = frame(spark, rows)
    out = line_dedup.dedup_lines(df, stats="info")
    got = [(r.doc_id if r.doc_id is not None else -1, r.info.n_lines, r.info.n_dropped, r.text) for r in out.collect()]
    key = lambda r: (r[0], r[1], r[2], r[3] or "")
    assert sorted(got, key=key) == sorted(want, key=key)
    assert line_dedup.dedup_lines(df).columns == df.columns
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_long_texts_cost_their_length(spark, monkeypatch):
    """Beyond the broadcast no row of a hash carries a text: fifty times the words don't take ten times as long."""
    monkeypatch.setattr(decontaminate, "BROADCAST_HASHES", 0)
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    item = text(40)
    items = spark.createDataFrame([(1, item), (2, "a short one")], "item_id long, text string")
    took = []
    for n in (1000, 1000, 50_000):
        docs = spark.createDataFrame([(i, f"{text(n)} {item} {text(5)} a short one") for i in range(2)], "doc_id long, text string")
        began = time.time()
        assert [(r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.contamination(docs, items).collect()] == [(n + 48, 43, ["1", "2"])] * 2
        took.append(time.time() - began)
    assert took[2] < 10 * max(took[1], 1)


def brute_windows(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
    w, hit, found = words(text), set(), set()
    for k, t in items:
        v = words(t)
        n = min(len(v), 10)
        for i in range(len(v) - n + 1) if n else ():
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[i : i + n]:
                    hit.update(range(j, j + n))
                    if k is not None:
                        found.add(str(k))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("keys", [0, 3])
def test_lines_with_more_keys_than_are_broadcast(spark, monkeypatch, keys):
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", keys)
    test_lines(spark, monkeypatch, -1)


@pytest.mark.parametrize("big", [True, False])
def test_windows(spark, monkeypatch, big):
    if big:
        monkeypatch.setattr(decontaminate, "BROADCAST_HASHES", 0)
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    rnd = random.Random(4)
    word = lambda: rnd.choice(["a", "b", "É", "Ab1", "c", "dd", "xyz"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 9, 10, 11, 25, 40])] + [(6, None), (7, " ,; "), (8, "a a a a a a a a a a a a"), (None, "only of a null id one two three four five six"), (3, "repeated id a b c")]
    docs = []
    for i in range(40):
        w = [word() for _ in range(rnd.randrange(0, 40))]
        if rnd.random() < 0.6:
            v = rnd.choice([t for _, t in items if t]).split()
            a = rnd.randrange(len(v))
            w[len(w) // 2 : len(w) // 2] = v[a : a + rnd.randrange(1, 30)]
        docs.append((i, rnd.choice([" ", ", ", "\n"]).join(w)))
    docs += [(90, None), (91, ""), (None, items[4][1]), (92, "a " * 3000), (92, "b")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = frame(spark, docs)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(df, bench).collect())
    assert got == sorted((i if i is not None else -1, *brute_windows(t, items)) for i, t in docs)
    clean = decontaminate.decontaminate(df, bench)
    assert clean.columns == df.columns
    assert clean.count() == sum(not brute_windows(t, items)[1] for _, t in docs)
    assert decontaminate.contamination(df, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(df.limit(0), bench).count() == 0


def base_secrets(t):
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        out += [(m.start(), 0, "assign", m.end())] * (len(m.group(2)) >= 8)
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_secrets(spark):
    rnd = random.Random(1)
    key = lambda n: "".join(rnd.choice(string.ascii_letters + string.digits) for _ in range(n))
    plain = ["aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "internationalisationalismofthings", "12345678901234567890123456789", "abcdefghijklmnopqrstuvwxyzabcdefgh", "entschuldigungsschreibenvorlage"]
    rows = [(0, None), (1, ""), (2, 'token=secret : abcdefghijk password="Abcd+/_9" 😀é token : \'xyz12345'), (3, "AKIAABCDEFGHIJKL AKIAAKIAAA"), (4, "é" * 3 + "0" * 40 + " a" * 50), (5, "token=abc token=abcdefgh TOKEN = 'ABCDEFGHIJ' Api_Key:ABCDEFGH1"), (6, " ".join(key(40) for _ in range(20))), (7, " ".join(plain)), (8, "x" * 50_000), (8, "x")]
    for _ in range(60):
        rows.append((100 + len(rows), " ".join(rnd.choice(["api_key", "Token", "=", ":", '"', "deadbeef" * 5, key(9), "AKIA" + key(14).upper(), "passwd='" + key(8), "é"]) for _ in range(12))))
    df = frame(spark, rows)
    got = sorted((r.doc_id, r.b, r.s) for r in secrets.scan(df).select("doc_id", listed(F.col("base")).alias("b"), listed(F.col("spans")).alias("s")).collect())
    assert [(i, b) for i, b, _ in got] == sorted((i, base_secrets(t or "")) for i, t in rows)
    spans = {i: s for i, _, s in got}
    assert spans[6].count("random") >= 18
    assert "random" not in spans[7]
    assert all(set(filter(None, b.split(","))) <= set(s.split(",")) for _, b, s in got)
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert clean[3] == "[ACCESS] AKIAAKIAAA" and clean[0] is None
    assert secrets.scan(df.limit(0)).count() == 0


def test_tails(spark):
    z = [-38.0, -12.0, -8.0, -6.0, -5.0, -3.0, -1.0, -0.1, 0.0, 0.5, 2.0, 4.5, 7.0, 20.0]
    got = {r.z: r.p for r in spark.createDataFrame([(x,) for x in z], "z double").select("z", secrets.upper_tail(F.col("z")).alias("p")).collect()}
    for x in z:
        assert math.isclose(got[x], math.erfc(x / math.sqrt(2)) / 2, rel_tol=1e-6)
    p = [0.3, 0.01, 0.9, 1e-12]
    r = spark.range(1).select(secrets.fisher(F.lit(0.05)).alias("one"), secrets.fisher(*[F.lit(x) for x in p]).alias("four")).first()
    t = -sum(map(math.log, p))
    assert math.isclose(r.one, 0.05, rel_tol=1e-9) and math.isclose(r.four, math.exp(-t) * (1 + t + t**2 / 2 + t**3 / 6), rel_tol=1e-9)


def plain_battery(value):
    """The same p of a token in plain Python."""
    tail = lambda z: math.erfc(z / math.sqrt(2)) / 2

    def fisher(*ps):
        t = -sum(math.log(max(p, 1e-300)) for p in ps)
        return math.exp(-t) * sum(t**k / math.factorial(k) for k in range(len(ps)))

    t = re.sub("=+$", "", value.replace("-", "+").replace("_", "/"))
    alphabet, pair, triple, usual = next(e[2:] for e in secrets.ENCODINGS if re.search(e[1], value))
    if alphabet == alphabet.lower():
        t = t.lower()
    n, k, steps = len(t), len(alphabet), len(t) - 1
    if n < 16:
        return 1.0
    at = [alphabet.index(c) + 1 - (k + 1) / 2 for c in t]
    kinds = [next(i for i, x in enumerate(secrets.CLASSES) if c in x) for c in t]
    free = 1 - sum((sum(c in alphabet for c in x) / k) ** 2 for x in secrets.CLASSES)
    squares = sum(t.count(c) ** 2 for c in set(t))
    chi, df = k * squares / n - n, k - 1
    cube = ((max(chi, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    turns = sum((a < 0) != (b < 0) for a, b in zip(at, at[1:]))
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    mean = sum(at) / n
    serial = (sum(a * b for a, b in zip(at, at[1:])) - steps * mean**2) / max(sum(a * a for a in at) - n * mean**2, 1e-9) * math.sqrt(n)
    z = [(turns - steps / 2) / math.sqrt(steps / 4), (changes - steps * free) / math.sqrt(steps * free * (1 - free)), serial]
    if fisher(tail(cube), *[min(1, 2 * tail(abs(x))) for x in z]) < secrets.REFUSED:
        return 1.0
    spread = math.sqrt(2 * n * steps * (pair - pair**2) + 4 * n * steps * (n - 2) * (triple - pair**2))
    rate = changes / steps
    mixed = 1.0 if rate <= usual else sum(math.comb(steps, j) * usual**j * (1 - usual) ** (steps - j) for j in range(changes, steps + 1))
    return fisher(tail((n + n * steps * pair - squares) / spread), mixed)


ALPHABETS = {"hex": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": string.ascii_lowercase + string.digits, "base64": string.ascii_letters + string.digits + "+/"}


def structured(rnd, words, n):
    """A token of prose, names, numbers or patterns, of n characters."""
    some = [rnd.choice(words) for _ in range(n)]
    kind = rnd.randrange(9)
    text = ["".join(some), "".join(w.capitalize() for w in some), "_".join(some), "-".join(some).upper(), "/".join(some), "".join(w + str(rnd.randrange(10, 3000)) * (rnd.random() < 0.3) for w in some), "".join(rnd.choice("0123456789") for _ in range(n)), "".join(f"{rnd.randrange(1990, 2030)}{rnd.randrange(1, 13):02}{rnd.randrange(1, 29):02}" for _ in range(n)), rnd.choice(["0123456789abcdef", "deadbeef", "AbCdEf12", "x0", "abcdefghijklmnopqrstuvwxyz", "1a2b3c4d5e6f"]) * n][kind]
    return text[:n]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data here")
def test_randomness_calibrated(spark):
    """Against plain Python; power by encoding and length; share of structured tokens that are taken for random."""
    rnd = random.Random(5)
    words = sorted({w.lower() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() for w in re.findall("[A-Za-z]{2,}", r.text or "")})
    lengths, each = (24, 32, 40, 48, 64), 120
    tokens = [(e, n, "".join(rnd.choice(chars) for _ in range(n))) for e, chars in ALPHABETS.items() for n in lengths for _ in range(each)]
    tokens += [("plain", n, structured(rnd, words, n)) for n in lengths for _ in range(1500)]
    tokens = [t for t in tokens if not re.fullmatch(r"[0-9a-f]{32,}|AKIA.*", t[2])]
    rows = spark.createDataFrame([(i, t[2]) for i, t in enumerate(tokens)], "doc_id long, text string").repartition(4)
    p = {r.doc_id: r.p for r in rows.select("doc_id", secrets.randomness(F.col("text")).alias("p")).collect()}
    for i in rnd.sample(range(len(tokens)), 800):
        exact = plain_battery(tokens[i][2])  # with a binomial tail where the operator has a bound on it
        assert exact * 0.999 <= p[i] <= 2 * exact or exact > 0.2, (tokens[i], p[i], exact)
    found = {r.doc_id for r in secrets.scan(rows).select("doc_id", listed(F.col("spans")).alias("s")).collect() if "random" in r.s}
    count = {}
    for i, (e, n, _) in enumerate(tokens):
        hit, total = count.get((e, n), (0, 0))
        count[e, n] = hit + (i in found), total + 1
    print({k: round(a / b, 3) for k, (a, b) in count.items()})
    false = sum(a for (e, _), (a, _) in count.items() if e == "plain")
    assert false <= 2 * secrets.LEVEL * len(found)
    least = {"hex": 24, "base32": 48, "base36": 32, "base64": 32}  # shorter ones tell too little
    assert all(a >= 0.9 * b for (e, n), (a, b) in count.items() if n >= least.get(e, 99))


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_pii(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


def test_personal_data(spark):
    rnd = random.Random(2)
    bits = ["a@b.com", "_x@y.z", "@", "1.2.3.4", ".5", "4111 1111 1111 1111", "4111-1111", "+1 (017) 555-7713", "+12 ", " ", "é😀", "0012.1.1.255", "378282246310005", "7", "j.d+1@m-x.example.com."]
    rows = [(0, None), (1, ""), (2, "1 " * 20_000 + "1.1.1.1"), (3, "x" * 30_000 + "@" + "y" * 10), (4, "1" * 30_000), (4, "a@b.c")]
    rows += [(10 + i, "".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 9)))) for i in range(300)]
    df = frame(spark, rows)
    got = sorted((r.doc_id, r.b) for r in pii.find(df).select("doc_id", listed(F.col("base")).alias("b")).collect())
    assert got == sorted((i, base_pii(t or "")) for i, t in rows)
    assert pii.find(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [0, 100_000])
def test_disclosing_terms(spark, monkeypatch, most):
    monkeypatch.setattr(pii, "BROADCAST", most)
    near = ["blue", "green", "red", "black", "white"]
    rows = [(i, f"note {i} tarantella meets {near[i % 5]} Quixotry at bob@corp.example.com please {i}") for i in range(5)]
    rows += [(50 + i, "copied words surround ann@corp.example.com everywhere alike") for i in range(6)]
    rows += [(100 + i, f"some text number {i} note about please at meets") for i in range(200)] + [(400, "who is QUIXOTRY?")]
    df = frame(spark, rows)
    found = {r.doc_id: [(s.kind, s.hit) for s in r.spans] for r in pii.find(df).collect()}
    assert ("term", "Quixotry") in found[0] and ("term", "QUIXOTRY") in found[400]
    assert all(k != "term" or h.lower() in ("tarantella", "quixotry") for v in found.values() for k, h in v)
    assert all(k != "term" for i in range(50, 56) for k, _ in found[i])
    text = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert text[400] == "who is [TERM]?" and "[EMAIL]" in text[0]


def brute_terms(rows):
    """Terms by plain counting, from sequences of words and entities."""
    seqs, texts = {}, {t or "" for _, t in rows}
    for t in texts:
        found = [(int(a), 0, int(b), k, low(t[int(a) : int(b)])) for k, a, b in (x.split(":") for x in base_pii(t).split(",") if x)]
        found += [(m.start(), 1, m.end(), "", low(m.group())) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)]
        seq, high = [], 0
        for start, rank, end, kind, hit in sorted(found):
            if rank == 0 or start >= high:
                seq.append((kind, hit))
            high = max(high, end * (rank == 0))
        seqs[t] = seq
    of_entity, by, of_term = {}, {}, {}
    for t, seq in seqs.items():
        for e in {x for x in seq if x[0]}:
            of_entity.setdefault(e, set()).add(t)
        for w in set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(t))):
            of_term.setdefault(w, set()).add(t)
        name = lambda i: None if not 0 <= i < len(seq) else seq[i][0] and "@" + seq[i][0] or seq[i][1]  # noqa: B023, E731
        for i, e in enumerate(seq):
            for j in range(max(0, i - pii.WINDOW), min(len(seq), i + pii.WINDOW + 1)) if e[0] else ():
                if not seq[j][0]:
                    by.setdefault((e, seq[j][1]), set()).add((t, name(j - 1), name(j + 1)))
    out = set()
    for (e, w), held in by.items():
        together, contexts = len({x[0] for x in held}), len({x[1:] for x in held})
        share = together / len(of_term[w])
        if len(of_entity[e]) >= pii.CONTEXTS <= min(together, contexts) and contexts >= pii.DIVERSITY * together and share >= pii.SHARE and math.log2(share * len(texts) / len(of_entity[e])) >= pii.BITS:
            out.add(w)
    return out


def test_planted_terms(spark):
    """Terms planted by entities, anywhere in the window, are found; nothing is in plain text; brute force agrees."""
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: [rnd.choice(words) for _ in range(n)]
    rows, planted = [], set()
    for i in range(500):
        rows.append((i, " ".join(text(rnd.randrange(1, 60)))))
    for k in range(12):
        entity = rnd.choice([f"user{k}@mail.example.org", f"10.0.{k}.7", f"+49 30 55501{k:02}"])
        for _ in range(rnd.randrange(3, 9)):
            w = text(50)
            w[25:25] = [entity, "reach", entity][: rnd.choice([1, 3])]
            for at in (2, 40):
                term = f"codename{k}x{at}"
                w.insert(at, term)
                planted.add(term)
            rows.append((1000 + len(rows), " ".join(w)))
    copied = text(40) + ["nobody", "elsewhere", "u@copies.example.com"]
    for _ in range(40):
        w = list(copied)
        w[rnd.randrange(40)] = rnd.choice(words)
        rows.append((5000 + len(rows), " ".join(w)))
    rows += [(9000, None), (9001, ""), (9002, "two@x.yy " * 3000), (9003, rows[600][1]), (9003, rows[600][1])]
    df = frame(spark, rows)
    risky = {r.term for r in pii.terms(df)[0].collect()}
    assert risky == brute_terms(rows)
    assert len(risky & planted) >= 0.9 * len(planted) and not risky & set(words) and "nobody" not in risky
    found = {r.doc_id: r.s for r in pii.find(df).select("doc_id", listed(F.col("spans")).alias("s")).collect()}
    for i, t in rows:
        assert found[i].count("term:") == sum(x in risky for x in re.findall(r"[0-9A-Za-z]+", low(t or ""))), t


def test_replaced(spark):
    """Overlapping spans go together; many in a long text as few in a short one."""
    rnd = random.Random(3)
    rows = [(0, "é" * 5 + "abc😀def", [("x", 1, 4), ("y", 3, 6), ("z", 6, 7)]), (1, "", []), (2, None, []), (3, "abc", [])]
    rows.append((4, "😀a" * 2000, sorted(("k", a, a + rnd.randrange(1, 4)) for a in rnd.sample(range(3990), 900))))
    span = "array<struct<kind: string, start: int, `end`: int, hit: string, part: string>>"
    df = spark.createDataFrame([(i, t, [(*s, "", "") for s in of]) for i, t, of in rows], f"doc_id long, text string, of {span}")
    got = {r.doc_id: r.out for r in df.select("doc_id", replaced(F.col("text"), F.col("of"), lambda s: F.concat(F.lit("<"), s["kind"], F.lit(">"))).alias("out")).collect()}
    for i, t, of in rows:
        out, at, high = "", 0, 0
        for k, a, b in of:
            if a >= high:
                out += t[high:a] + f"<{k}>"
            high = max(high, b)
        assert got[i] == (None if t is None else out + t[high:])


def test_urls(spark):
    link = lambda to: f'<html><LINK href="{to}" rel=canonical></html>'
    move = lambda to: f"<meta http-equiv='Refresh' content='0; URL={to}'>"
    rows = [
        (1, "http://x.example.net/de/1", ""), (2, "https://EXAMPLE.net/en/1?q", ""), (3, "http://a.example.com/de/x#y", ""), (4, "http://b.org/fr/", ""), (5, "http://b.org/de/", ""),
        (6, None, ""), (7, "no url", ""), (8, "http://notexample.com/de/", ""), (9, "http://net", ""), (10, "http://a.com/alias", link("http://a.example.com/de/x")),
        (11, "http://a.com/chain", move("http://a.com/alias#z")), (12, "http://c.com/both", link("http://x.net/")), (13, "http://d.com/both", link("http://c.com/both") + move("http://o.org/fr/1")),
        (14, "http://c.com/plain", "<p>canonical</p>"), (15, "http://a.example.com/en/ok", link("http://a.com/alias")), (10, "http://a.com/alias", None),
    ]
    df = spark.createDataFrame([(*r, "h", "v") for r in rows], "page_id long, url string, html string, host string, verdict string")
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got[1, "x.example.net", "/de/1"] == ("net/", "block") and got[2, "example.net", "/en/1"] == ("example.net/en/", "allow")
    assert got[3, "a.example.com", "/de/x"] == ("example.com/de/", "block") and got[4, "b.org", "/fr/"] == ("org/fr/", "allow")
    assert got[6, "", ""] == got[7, "", ""] == (None, "allow") and got[9, "net", ""] == (None, "allow") and got[8, "notexample.com", "/de/"][0] is None
    verdict = {k[0]: v[1] for k, v in got.items()}
    assert [verdict[i] for i in (5, 10, 11, 12, 13, 14, 15)] == ["allow", "block", "block", "allow", "allow", "allow", "block"]
    assert url_filter.judge(df).count() == len(rows)
    assert url_filter.judge(df.limit(0)).count() == 0


def test_aliases(spark):
    """A query tells pages apart; comments and other attributes link nothing; references are read."""
    rows = [
        (1, "http://s.com/p?id=1", '<link rel="canonical" href="http://bad.net/x">'), (2, "http://s.com/p?id=2", ""), (3, "https://s.com/p?id=1#top", None), (4, "http://t.com", '<link href="http://u.net/" rel=canonical>'), (5, "https://T.com/#x", ""),
        (6, "http://c.com/1", '<!-- <link rel="canonical" href="http://bad.net/x"> --> canonical'), (7, "http://c.com/2", '<link data-rel="canonical" rel="icon" href="http://bad.net/x">'), (8, "http://c.com/3", '<link rel="noncanonical" href="http://bad.net/x">'),
        (9, "http://c.com/4", '<link rel="alternate canonical" href="http:&#x2F;/bad.net/y?a=1&amp;b=2">'), (10, "http://bad.org/z", '<meta http-equiv="refresh" content="0;url=http://bad.net/y?a=1&b=2">'), (11, "http://c.com/5", "<!-- canonical <link rel=canonical href=http://bad.net/x>"),
        (12, "http://c.com/6", "x" * 300_000 + '<link rel="canonical" href="//bad.net/x">'),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    blocked = {r.page_id for r in url_filter.judge(df).collect() if r.verdict == "block"}
    assert blocked == {1, 3, 4, 5, 9, 10, 12}


def test_aliases_against_sql_and_brute_force(spark):
    rnd = random.Random(9)
    hosts = ["a.example.com", "x.net", "b.org", "c.com", "d.com", "example.net"]
    address = lambda: f"http{rnd.choice(['', 's'])}://{rnd.choice(hosts)}{rnd.choice(['', '/', '/de/', '/fr/', '/en/'])}{rnd.randrange(12) or ''}{rnd.choice(['', '', '?q=1'])}{rnd.choice(['', '#f'])}"

    def html(targets):
        form = ['<link rel="canonical" href="{}">', "<LINK href='{}' rel=canonical>", '<meta http-equiv="Refresh" content="5; url={}">', "<!-- <link rel=canonical href={}> -->", '<link rel="icon" href="{}">']
        return "".join(rnd.choice(form).format(t) for t in targets)

    rows = [(i, address(), html([rnd.choice([address(), f"/de/{rnd.randrange(9)}", f"//{rnd.choice(hosts)}/de/1"]) for _ in range(rnd.choice([0, 0, 1, 2]))])) for i in range(150)]
    rows += [(200, None, html(["http://x.net/"])), (201, "plain", html(["http://x.net/"])), (202, "http://alone.com/?q", None)]
    got = sorted(map(tuple, url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert got == sorted(con.execute(url_filter.SQL).fetchall())

    def parts(url):
        if "://" not in (url or ""):
            return "", "", None
        rest = url.split("://", 1)[1].split("#")[0]
        host = re.match("[^/?]*", rest)[0]
        path = rest[len(host) :].split("?")[0]
        query = rest[len(host) + len(path) :]
        return low(host), path, low(host) + (path or "/") + query if host else None

    def own(host, path):
        fit = [(len(h + p), v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[1] if fit else None

    near, said = {}, {}
    for _, url, text in rows:
        for t in re.findall(r"""<(?:link rel="canonical" href="|LINK href='|meta http-equiv="Refresh" content="5; url=)([^"'>]*)""", text or ""):
            if "://" in (url or ""):
                scheme, rest = url.split("://", 1)
                t = f"{scheme}:{t}" if t.startswith("//") else f"{scheme}://{re.match('[^/?#]*', rest)[0]}{t}" if t.startswith("/") else t
                a, b = parts(url), parts(t)
                near.setdefault(a[2], set()).add(b[2])
                near.setdefault(b[2], set()).add(a[2])
                said[a[2]], said[b[2]] = own(*a[:2]), own(*b[:2])
    verdict = {}
    for i, url, _ in rows:
        host, path, node = parts(url)
        seen, todo = set(), [node]
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += near.get(x, ())
        verdict[i] = own(host, path) or min((said[x] for x in seen if said.get(x)), default="allow")
    assert {r[0]: r[4] for r in got} == verdict
    assert len({v for v in verdict.values()}) == 2 and sum(len(x) for x in near.values()) > 60


def test_relative_links(spark):
    link = lambda to: f'<link rel="canonical" href="{to}">'
    move = lambda to: f'<meta content="0; url={to}" http-equiv="refresh">'
    page, d = "http://a.example.com/en/alias?q=/x/y", "http://a.example.com"
    cases = [
        (page, link("/de/x"), f"{d}/de/x"), (page, link("//b.net/de/x"), "http://b.net/de/x"), (page, link("x.html"), f"{d}/en/x.html"), (page, link("../de/./x?z#f"), f"{d}/de/x?z#f"),
        (page, link("?p=1"), f"{d}/en/alias?p=1"), (page, link("#top"), f"{d}/en/alias#top"), (page, link("../../.."), f"{d}/"), (page, link("/it's"), f"{d}/it's"), (d, link("de/x"), f"{d}/de/x"),
        (page, link("/go?to=http://c.org/fr/"), f"{d}/go?to=http://c.org/fr/"), (page, move("/de/y"), f"{d}/de/y"), (page, move("'z'"), f"{d}/en/z"), ("https://h.org/a/", move("//i.org"), "https://i.org"),
        (page, '<base href="/de/">' + link("w"), f"{d}/de/w"), (page, '<base target="_top"><base href="http://e.org/fr/x">' + move("w"), "http://e.org/fr/w"),
        (page, link(""), None), (page, link("mailto:me"), None), (page, move(""), None), (page, '<meta content="0;" http-equiv="refresh">', None), (page, '<meta http-equiv="refresh" content="30">', None),
        ("no url", link("/de/x"), None), (None, link("/de/x"), None),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "url string, html string")
    assert sorted(map(tuple, url_filter.links(df).collect())) == sorted((url, want) for url, _, want in cases if want)
    rows = [(1, page, link("/de/x")), (2, "http://b.com/a/p", move("//b.org/fr/x")), (3, "http://q.net/de/a", link("/en/ok")), (4, "http://c.com/a/p", link("//q.net/z")), (5, "http://c.com/a/q", link("p"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in url_filter.judge(df).collect()} == {1: "block", 2: "allow", 3: "block", 4: "block", 5: "block"}
