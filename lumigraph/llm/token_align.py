"""Alignment of two tokenizers over the same bytes: groups of tokens between common ends, and which ids are linked.

Every byte of a text gets a label: no token ends here, one of A, one of B, or
both.  A regular expression cuts the labels behind each "both"; how often the
labels occur in a span says how many tokens of either side make a group.  Each
labelled byte is also the last one of exactly one pair of overlapping tokens.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigraph.llm import arrays as A
from lumigraph.llm.piece_codec import MODEL, Codec, gathered, pieces, read_model, wider
from lumigraph.llm.text import free_name
from lumigraph.sources.tables import stash, table

TOKENS = "byte_bpe_50k.json"
#: Bytes of text aligned together; a longer text is looked at in parts of about so many.
BYTES = 1 << 19
#: Labels of a byte: a token of A ends, one of B ends, or both; 0 if none does.
A_END, B_END, BOTH = 1, 2, 3
SPAN = re.compile(rb"[^\x03]*\x03")
#: Id pairs that are broadcast, at most (17 bytes each); of more, the most frequent are broadcast and the rest, none of which is frequent, shuffled.
PAIRS = 500_000
LINKS = "array<struct<a: int, b: int, n: int>>"
COUNTS = "n_a: long, n_b: long, n_groups: long, n_links: long"
GROUPS = "array<struct<a: array<int>, b: array<int>>>"


def byte_values() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(others)}


def byte_ranks(path: str) -> dict[bytes, int]:
    """The bytes of each token of a byte-level vocabulary file; a ValueError if its merges don't go by id."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, value = whole["model"], byte_values()
    if whole.get("normalizer") or model["type"] != "BPE" or whole["pre_tokenizer"]["type"] != "ByteLevel" or whole["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError("not a byte-level byte-pair vocabulary that leaves the text as it is")
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged) or len(model["vocab"]) != 256 + len(merged):
        raise ValueError("merges are not in the order of ids")
    return {bytes(value[c] for c in piece): i for piece, i in model["vocab"].items()}


class Numbers:
    """Decimal ids, each with a comma behind it, in one array of bytes."""

    def __init__(self, n: int):
        words = [b"%d," % i for i in range(n)]
        self.size = np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(words), np.uint8)

    def listed(self, a: np.ndarray, b: np.ndarray, a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`a1,a2|b1;a3|b2;` of groups that end before the given tokens; and where each group ends."""
        many_a, many_b = np.diff(a_end, prepend=0), np.diff(b_end, prepend=0)
        ids = np.empty(len(a) + len(b), np.int64)
        ids[np.arange(len(a)) + np.repeat(b_end - many_b, many_a)] = a
        ids[np.arange(len(b)) + np.repeat(a_end, many_b)] = b
        size = self.size[ids]
        out, ends = gathered(self.bytes, self.start[ids], size), np.cumsum(size)
        out[ends[a_end + b_end - many_b - 1] - 1] = ord("|")
        ends = ends[a_end + b_end - 1]
        out[ends - 1] = ord(";")
        return out, ends


class Found:
    """The alignment of some texts: counts, ends of groups (in tokens), links (text << 32 | pair), and whether each text has tokens."""

    def __init__(self, aligner: Aligner, data: np.ndarray, ends: np.ndarray, first: bool):
        n = len(ends) - 1
        some = np.flatnonzero(np.diff(ends) > 0)
        lists = [aligner.a.encode_to_numpy(" " * first + data[ends[i] : ends[i + 1]].tobytes().decode(), disallowed_special=()) for i in some]
        a, a_count = np.concatenate([np.zeros(0, np.int32), *lists]).astype(np.int32), np.zeros(n, np.int64)
        a_count[some] = [len(x) for x in lists]
        b, b_count = aligner.b.encode_flat(data, ends, first)
        want, want_ends = data, ends
        if first:
            want, want_ends = np.insert(data, ends[some], 0x20), ends + np.append(0, np.cumsum(np.diff(ends) > 0))
        self.whole = aligner.same(a, a_count, aligner.a_bytes, want, want_ends) & aligner.same(b, b_count, aligner.b_bytes, want, want_ends)
        if not self.whole.all():
            a, b = a[np.repeat(self.whole, a_count)], b[np.repeat(self.whole, b_count)]
            a_count, b_count, length = a_count * self.whole, b_count * self.whole, np.diff(want_ends) * self.whole
            want_ends = np.append(0, np.cumsum(length))
        self.a, self.b, self.a_count, self.b_count = a, b, a_count, b_count
        labels = np.zeros(want_ends[-1], np.uint8)
        labels[np.cumsum(aligner.a_bytes.size[a]) - 1] = A_END
        labels[np.cumsum(aligner.b_bytes.size[b]) - 1] += B_END
        spans = np.cumsum(np.fromiter(map(len, SPAN.findall(labels.tobytes())), np.int64))
        a_seen, b_seen = np.cumsum(labels & A_END, dtype=np.int64), np.cumsum(labels >> 1, dtype=np.int64)
        self.a_end, self.b_end = a_seen[spans - 1], b_seen[spans - 1]
        self.groups = np.diff(np.searchsorted(spans, want_ends, "right"))
        links = np.flatnonzero(labels)
        self.links = np.diff(np.searchsorted(links, want_ends, "left"))
        a_of, b_of = a[a_seen[links] - (labels[links] & 1)] if len(links) else a[:0], b[b_seen[links] - (labels[links] >> 1)] if len(links) else b[:0]
        self.pairs = np.repeat(np.arange(n), self.links) << 32 | a_of.astype(np.int64) << 16 | b_of


class Tokens:
    """The bytes of each id of a vocabulary, one after another."""

    def __init__(self, words: list[bytes]):
        self.size = np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(words), np.uint8)


class Aligner:
    """Both tokenizers; vocabularies of up to 65,536 ids."""

    def __init__(self, ranks: dict[bytes, int], codec: Codec):
        self.a = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b, words = codec, [b""] * (max(ranks.values()) + 1)
        for word, i in ranks.items():
            words[i] = word
        if max(len(words), codec.n) > 1 << 16:
            raise ValueError("a vocabulary of over 65,536 ids")
        self.a_bytes, self.b_bytes, self.numbers = Tokens(words), codec, Numbers(max(len(words), codec.n))

    @staticmethod
    def same(ids: np.ndarray, count: np.ndarray, words: Tokens | Codec, want: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether the joined bytes of each text's tokens are the text's; not so for empty texts."""
        size = words.size[ids]
        data = gathered(words.bytes, words.start[ids], size)
        some = np.diff(ends) > 0
        last = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(count))]
        if np.array_equal(last, ends) and np.array_equal(data, want):
            return some
        return np.array([some[i] and np.array_equal(data[last[i] : last[i + 1]], want[ends[i] : ends[i + 1]]) for i in range(len(ends) - 1)], bool)

    def align(self, column: pa.Array, digest: bool, most: int = BYTES) -> Iterator[tuple[int, pa.StructArray]]:
        """(number of texts, struct of counts, groups and links) for one run of texts after another."""
        for t in A.texts(column, most):
            parts = [Found(self, data, ends, k == 0) for k, (data, ends) in enumerate(pieces(t, most))]
            whole = np.logical_and.reduce([p.whole for p in parts])
            if len(parts) > 1 and not whole.all():  # one text in parts, of which one doesn't hold
                parts = [Found(self, np.zeros(0, np.uint8), np.zeros(2, np.int64), True)]
            counts = [sum(getattr(p, x) for p in parts) for x in ("a_count", "b_count", "groups", "links")]
            pairs, times = np.unique(np.concatenate([p.pairs for p in parts]), return_counts=True)
            own = np.append(0, np.cumsum(np.bincount(pairs >> 32, minlength=t.n)))
            links = pa.StructArray.from_arrays([pa.array((pairs >> 16 & 0xFFFF).astype(np.int32)), pa.array((pairs & 0xFFFF).astype(np.int32)), pa.array(times.astype(np.int32))], ["a", "b", "n"])
            columns = [*map(pa.array, counts), self._digests(parts) if digest else _groups(parts, counts[2]), pa.ListArray.from_arrays(pa.array(own, pa.int32()), links)]
            yield t.n, pa.StructArray.from_arrays(columns, ["n_a", "n_b", "n_groups", "n_links", "groups_sha256" if digest else "groups", "links"])

    def _digests(self, parts: list[Found]) -> pa.Array:
        """SHA-256, in hex, of each text's groups, '' without tokens; parts of one text follow each other."""
        out = []
        if len(parts) > 1:
            sha = hashlib.sha256()
            for k, p in enumerate(parts):
                text, _ = self.numbers.listed(p.a, p.b, p.a_end, p.b_end)
                sha.update(text if k < len(parts) - 1 else text[:-1])
            out.append(sha.hexdigest())
        for p in parts if len(parts) == 1 else ():
            text, ends = self.numbers.listed(p.a, p.b, p.a_end, p.b_end)
            last = np.append(0, ends)[np.append(0, np.cumsum(p.groups))].tolist()
            out += [hashlib.sha256(text[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(last, last[1:], strict=False)]
        return pa.array(out, pa.string())


def _groups(parts: list[Found], count: np.ndarray) -> pa.ListArray:
    """A list of groups for each text, each with its ids of A and of B."""
    many = lambda x: np.append(0, np.cumsum(np.concatenate([np.diff(getattr(p, x), prepend=0) for p in parts])))
    sides = [pa.ListArray.from_arrays(pa.array(many(f"{x}_end"), pa.int32()), pa.array(np.concatenate([getattr(p, x) for p in parts]), pa.int32())) for x in "ab"]
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.StructArray.from_arrays(sides, ["a", "b"]))


def align(docs: DataFrame, tokens: str | None = None, model: str | None = None, text: str = "text", out: str = "aligned", digest: bool = False) -> DataFrame:
    """`docs` with a struct named `out`, or a free name like it: n_a, n_b, n_groups, n_links, groups, links.

    A encodes a space and the text with the byte-level vocabulary file `tokens`,
    B the text with the sentencepiece model `model`, which puts the space there
    itself; both are read on the driver and broadcast.  `groups` lists the ids
    of A and B between byte offsets where tokens of both end; with `digest`, it
    is groups_sha256, the hash of `a1,a2|b1;a3|b2`.  `links` has each different
    pair of ids of which occurrences overlap in this text, and how often.

    Null and empty texts, and those whose tokens of A or B don't join to the
    space and the text again (such as texts with U+2581), have no tokens: zeros,
    no groups, no links, and '' for the digest.  Strings of special tokens are
    text like other text.  Repeated rows and null doc_ids are rows like others;
    other columns pass through; an empty table stays one.  A long text is
    looked at in parts, cut before a space where tokens of both end, so that a
    task holds about BYTES of text besides a row's own result.
    """
    name, at = free_name(docs.columns, out), docs.columns.index(text)
    both = docs.sparkSession.sparkContext.broadcast((byte_ranks(tokens or public_tokenizers.path(TOKENS)), Codec(read_model(model or public_tokenizers.path(MODEL)))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*both.value)
        for batch in batches:
            done = 0
            for n, column in aligner.align(batch.column(at), digest):
                rows = batch.slice(done, n)
                yield pa.RecordBatch.from_arrays([*rows.columns, column], [*batch.schema.names, name])
                done += n

    kind = f"struct<{COUNTS}, {'groups_sha256: string' if digest else f'groups: {GROUPS}'}, links: {LINKS}>"
    return docs.mapInArrow(work, wider(docs, name, kind))


def pair_counts(links: DataFrame, pairs: int = PAIRS) -> tuple[DataFrame, DataFrame | None]:
    """Corpus-wide counts of id pairs, (pair, total, best), from rows (pair, n): all of them or the `pairs` most frequent, and then all.

    `best` says that no pair with the same id of B counts more.  There are no
    more maxima than ids of B, so these are broadcast.
    """
    totals = stash(links.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.col("pair").bitwiseAND(0xFFFF)))
    top = totals.groupBy("b").agg(F.max("total").alias("top"))
    totals = stash(totals.join(F.broadcast(top), "b").select("pair", "total", (F.col("total") == F.col("top")).alias("best")))
    if totals.count() <= pairs:
        return totals, None
    return totals.orderBy(F.desc("total"), "pair").limit(pairs), totals


def scored(rows: DataFrame, key: str, links: str, pairs: int = PAIRS) -> DataFrame:
    """(key, n_best, count_sum) of rows with a unique `key` and their `links`; rows without links are left out.

    Counts meet the links by broadcast, as far as they are frequent; the rest,
    in which no pair has more than one in `pairs` of all links, by a shuffle.
    """
    one = rows.select(key, F.explode(links).alias("l")).select(key, F.shiftleft(F.col("l.a").cast("long"), 16).bitwiseOR(F.col("l.b").cast("long")).alias("pair"), F.col("l.n").cast("long").alias("n"))
    frequent, all_ = pair_counts(one, pairs)
    met = one.join(F.broadcast(frequent), "pair")
    if all_ is not None:
        met = met.unionByName(one.join(F.broadcast(frequent), "pair", "left_anti").join(all_, "pair"))
    return met.groupBy(key).agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("total")).alias("count_sum"))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """`rows` with a long that no two of them share; the same when a task is run again."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at, at + len(batch)))], [*batch.schema.names, name])
            at += len(batch)

    return rows.mapInArrow(work, wider(rows, name, "long"))


def report(docs: DataFrame, tokens: str | None = None, model: str | None = None, pairs: int = PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row; cases as in `align`."""
    done = align(docs.select("doc_id", "text"), tokens, model, digest=True).select("doc_id", "aligned.*")
    done = stash(numbered(done, "row"))
    sums = scored(done, "row", "links", pairs)
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return done.drop("links").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


SQL = None
