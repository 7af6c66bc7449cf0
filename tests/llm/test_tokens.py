"""Operators on tokens and words against the tokenizers' own libraries and plain Python."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lumigraph.llm import piece_codec, spelling, token_align

EXTRA = "doc_id long, text string, ids string, IDS_ int, aligned string, decoded int, row int, word string, n int"
ODD = ["", None, "a", " ", "   ", "hello world", " lead", "trail  ", "▁▁a ▁", "日本語 テキスト", "\U0001f600 x", "\x00\x01\t\n\n", "<s> </s> <0x0A> <|endoftext|>", "ab" * 40, "x" + " " * 37 + "y"]
PARTS = ["a", "b", " ", "  ", "the", "ing", "\n", "12", "é", "日", "\U0001f600", "'s", "A", " " * 17, "="]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 3, "z", 4) for r in rows], EXTRA)


def texts(seed, n=150):
    rnd = random.Random(seed)
    return ODD + ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(50))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(piece_codec.MODEL))


@pytest.fixture(scope="module")
def codec():
    return piece_codec.Codec(piece_codec.read_model(public_tokenizers.path(piece_codec.MODEL)))


def lists(codec, column, **how):
    for ids, count in codec.encode(pa.array(column, pa.string()), **how):
        yield from (x.tolist() for x in np.split(ids, np.cumsum(count)[:-1]))


def test_codec_names(spark):
    """Columns whose names clash pass through; what is added has a free name."""
    df = frame(spark, [(1, "some text")])
    out = piece_codec.encode(df)
    assert out.columns[:-1] == df.columns and out.columns[-1] == "ids__"
    back = piece_codec.decode(out, ids="ids__")
    assert back.columns[-1] == "decoded_" and back.first()["decoded_"] == "some text"


def test_codec_rows(spark, library):
    rows = [*enumerate(texts(1)), (0, "again"), (0, "again"), (None, "no id")]
    out = piece_codec.decode(piece_codec.encode(spark.createDataFrame(rows, "doc_id long, text string")))
    want = sorted((str(i), t or "", library.encode(t or "", add_bos=True, add_eos=True), library.decode(library.encode(t or ""))) for i, t in rows)
    assert sorted((str(r.doc_id), r.text or "", r.ids, r.decoded) for r in out.collect()) == want
    empty = piece_codec.encode(spark.createDataFrame([], "doc_id long, text string"))
    assert piece_codec.decode(empty).count() == 0


def test_codec_digest(spark, library):
    rows = [*enumerate(texts(5, 40)), (0, "again"), (None, "no id")]
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    df = frame(spark, rows)
    assert sorted((tuple(r) for r in piece_codec.report(df).collect()), key=str) == sorted(want, key=str)
    assert piece_codec.report(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [64, 1 << 20])
def test_codec_long(codec, library, most):
    """Runs of spaces, of signs and of letters, long words, and texts cut into parts."""
    rnd = random.Random(2)
    column = [" " * k + "w" for k in range(0, 70, 3)] + ["w" + " " * k for k in range(0, 70, 3)] + ["=" * 300, "a" * 500, "0" * 333, "日 " * 200, " " * 20_000]
    column += ["".join(rnd.choice("aeioutnsrhl") for _ in range(rnd.randrange(400))) for _ in range(20)] + [" ".join(f"word{rnd.randrange(99)}" for _ in range(3000))]
    assert list(lists(codec, column, most=most)) == [library.encode(x) for x in column]


def test_decode_any(codec, library):
    """Any ids: control pieces, unknown ones, bytes that are no UTF-8."""
    rnd = random.Random(3)
    column = [[rnd.choice([rnd.randrange(3), rnd.randrange(3, 259), rnd.randrange(259, 32_000)]) for _ in range(rnd.randrange(12))] for _ in range(400)]
    got = codec.decode(np.array(sum(column, []), np.int32), np.array([len(x) for x in column]))
    assert got == [library.decode(x) for x in column]
    with pytest.raises(ValueError):
        codec.decode(np.array([32_000]), np.array([1]))


@pytest.fixture(scope="module")
def brute(library):
    """Counts, digest and links of one text, token by token."""
    a = Tokenizer.from_file(public_tokenizers.path(token_align.TOKENS))
    a.encode_special_tokens = True
    value = token_align.byte_values()
    words = {i: bytes(value[c] for c in p) for p, i in a.get_vocab(False).items()}

    def piece(i):
        p = library.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace("▁", " ").encode()

    def ends(parts):
        return np.cumsum([len(p) for p in parts]).tolist()

    def look(text):
        left, right, whole = a.encode(f" {text}", add_special_tokens=False).ids, library.encode(text or ""), f" {text}".encode()
        x, y = [words[i] for i in left], [piece(i) for i in right]
        if not text or b"".join(x) != whole or b"".join(y) != whole:
            return (0, 0, 0, 0, "", Counter())
        x, y = ends(x), ends(y)
        links = Counter((left[i], right[j]) for i in range(len(x)) for j in range(len(y)) if max(x[i - 1] if i else 0, y[j - 1] if j else 0) < min(x[i], y[j]))
        groups, last = [], 0
        for e in sorted(set(x) & set(y)):
            groups.append(",".join(str(i) for i, k in zip(left, x, strict=True) if last < k <= e) + "|" + ",".join(str(i) for i, k in zip(right, y, strict=True) if last < k <= e))
            last = e
        return (len(left), len(right), len(groups), links.total(), hashlib.sha256(";".join(groups).encode()).hexdigest(), links)

    return look


def test_alignment(spark, brute):
    rows = [*enumerate(texts(4, 80)), (0, "again the"), (0, "again the"), (None, "no id")]
    each = [(i, *brute(t)) for i, t in rows]
    total = sum((x[6] for x in each), Counter())
    top = {}
    for (_, b), n in total.items():
        top[b] = max(top.get(b, 0), n)
    want = [(i, *x[:4], sum(n for p, n in x[5].items() if total[p] == top[p[1]]), sum(n * total[p] for p, n in x[5].items()), x[4]) for i, *x in each]
    df = frame(spark, rows)
    for pairs in (token_align.PAIRS, 10, 0):  # all by broadcast, some, none
        got = [tuple(r) for r in token_align.report(df, pairs=pairs).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert token_align.report(df.limit(0)).count() == 0


def test_alignment_groups(spark, brute):
    """The groups themselves, beside columns whose names clash; a long text in parts."""
    out = token_align.align(frame(spark, [(1, "tokenization of naïve things"), (2, "a▁b"), (3, None)])).orderBy("doc_id").collect()
    assert out[0].asDict()["aligned"] == "y"
    found = out[0]["aligned_"]
    text = ";".join(",".join(map(str, g.a)) + "|" + ",".join(map(str, g.b)) for g in found.groups)
    assert hashlib.sha256(text.encode()).hexdigest() == brute("tokenization of naïve things")[4]
    assert [(r["aligned_"].n_a, r["aligned_"].groups, r["aligned_"].links) for r in out[1:]] == [(0, [], [])] * 2
    both = token_align.Aligner(token_align.byte_ranks(public_tokenizers.path(token_align.TOKENS)), piece_codec.Codec(piece_codec.read_model(public_tokenizers.path(piece_codec.MODEL))))
    for long in (" ".join(f"word{i % 37}, then" for i in range(200)), " ".join(["some"] * 50) + " ▁ " + " ".join(["more"] * 50)):
        for digest in (True, False):
            (n, whole), *_ = both.align(pa.array([long]), digest)
            (m, parts), *_ = both.align(pa.array([long]), digest, most=40)
            assert n == m == 1 and whole.to_pylist() == parts.to_pylist()


def near(a, b):
    """Whether one inserted, deleted or replaced code point makes one of the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    words = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            words[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}
    form, out = {}, []
    for w, n in words.items():
        others = sorted((-m, x) for x, m in words.items() if near(w, x))
        form[w] = others[0][1] if others and -others[0][0] >= 5 * n else None
        out.append([w, n, len(others), form[w], words.get(form[w])])
    for row in out:
        root = row[0]
        while form[root]:
            root = form[root]
        row.append(root)
    return sorted(map(tuple, out))


def corpus(seed):
    rnd = random.Random(seed)
    base = ["banana", "bananas", "cabanas", "élégant", "Élégant", "öffnung", "question"]
    base += ["".join(rnd.choice("abcé") for _ in range(rnd.randrange(5, 9))) for _ in range(60)]
    rows = [(i, " ".join(rnd.choice(base[: 1 + int(len(base) * rnd.random() ** 3)]) + rnd.choice(["", "", "x", ",", "7"]) for _ in range(rnd.randrange(80)))) for i in range(150)]
    chain = " ".join(["aaaaaaaa"] * 5 + ["aaaaaaab"] * 25 + ["aaaaaabb"] * 125 + ["aaaaabbb"] * 625 + ["aaaabbbb"] * 3125)
    return [*rows, (900, chain), (901, None), (902, ""), (None, "banana BANANA ÀÀÀÀÀÀ"), (5, "again banana"), (5, "again banana"), (903, "question " * 2000)]


@pytest.mark.parametrize("shard,group", [(spelling.SHARD, spelling.GROUP_BYTES), (7, 1), (20, 2000)])
def test_variants(spark, shard, group):
    """One trie and many, in one broadcast and in several; chains of forms; nulls, ties, repeats, clashing columns."""
    rows = corpus(6)
    got = spelling.variants(frame(spark, rows), shard=shard, group_bytes=group)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[0]) == brute_variants(rows)


def test_variants_empty(spark):
    assert spelling.variants(frame(spark, [])).count() == 0
    assert spelling.variants(frame(spark, [(1, None), (2, "word")])).count() == 0


def test_variants_long(monkeypatch):
    """A long text in parts has the same words."""
    monkeypatch.setattr(spelling, "PART", 50)
    text = " ".join(f"wörter{i % 13}abc" for i in range(500))
    cut = list(spelling.parts(text))
    assert len(cut) > 5 and "".join(cut) == text
    assert [w for p in cut for w in spelling.RUN.findall(p)] == spelling.RUN.findall(text)
    assert [x for x in spelling.parts("x" * 500) if x] == ["x" * 500]
