"""Subword encoding and decoding with a byte-pair model of the sentencepiece format, in vectorised merge rounds.

The texts of a batch become one flat array of code points.  It is cut into words
where no piece of the vocabulary reaches across, each different word is encoded
once, and all of them together: every round finds the best pair of each word,
merges it, leftmost first, and closes the gaps, until no pair remains.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lumigraph.llm import arrays as A
from lumigraph.llm.text import free_name
from lumigraph.sources.tables import table

MODEL = "piece_bpe_32k.model"
#: Bytes of text encoded together; a longer text is cut into parts of about so many.
BYTES = 1 << 19
#: Code points from which on a word is cut where no piece reaches across.
LONG = 32
#: What stands for a space in pieces.
MARK = 0x2581
#: Kinds of pieces in the model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
NONE = np.iinfo(np.int32).max
_UNICODE = 0x110000

codecs.register_error("lumigraph_each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pieces flat[start : start + size], one after another."""
    ends = np.cumsum(size)
    if not len(ends) or not ends[-1]:
        return flat[:0].copy()
    step = np.ones(ends[-1], np.int32 if len(flat) < NONE else np.int64)
    some = np.flatnonzero(size)
    at = ends[some] - size[some]
    step[at] = start[some]
    step[at[1:]] -= start[some[:-1]] + size[some[:-1]] - 1
    return flat[np.cumsum(step, dtype=step.dtype)]


class Codec:
    """The tables of a model; symbols are ids of pieces, and past those the code points that are no piece.

    Only byte-pair models that leave the text as it is (no normalisation, no
    white space removed) and fall back to bytes are taken; for others a
    ValueError is raised, as it is for models with user-defined or unused pieces.
    """

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        how, kinds = proto.normalizer_spec, np.array([p.type for p in proto.pieces], np.int8)
        plain = not how.precompiled_charsmap and not how.remove_extra_whitespaces and how.escape_whitespaces and not proto.trainer_spec.treat_whitespace_as_suffix
        if proto.trainer_spec.model_type != 2 or not plain or (kinds == BYTE).sum() != 256 or np.isin(kinds, (USER_DEFINED, UNUSED)).any():
            raise ValueError("not a byte-pair model with byte fallback and without normalisation")
        self.prefix, self.n = how.add_dummy_prefix, len(proto.pieces)
        self.bos, self.eos = proto.trainer_spec.bos_id, proto.trainer_spec.eos_id
        names = [p.piece for p in proto.pieces]
        normal = np.flatnonzero(kinds == NORMAL)
        ids = {names[i]: int(i) for i in normal}
        score = np.array([p.score for p in proto.pieces], np.float32)
        self.rank = np.full(self.n, NONE, np.int32)
        self.rank[normal] = np.unique(-score[normal], return_inverse=True)[1]  # equal scores have equal ranks
        self.byte = np.zeros(256, np.int32)
        for i in np.flatnonzero(kinds == BYTE):
            self.byte[int(names[i][1:-1], 16)] = i

        self.symbol = np.arange(_UNICODE, dtype=np.int32) + self.n
        for i in normal:
            if len(names[i]) == 1:
                self.symbol[ord(names[i])] = i
        symbol = lambda part: ids.get(part, self.n + ord(part) if len(part) == 1 else None)
        pairs, near, slow = {}, set(), set()
        for piece, i in ids.items():
            near.update(zip(piece, piece[1:], strict=False))
            for k in range(1, len(piece)):
                left, right = symbol(piece[:k]), symbol(piece[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = i
                    slow.update(p for p in (left, right) if p < self.n and self.rank[p] >= self.rank[i])
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[x] for x in self.pairs.tolist()], np.int32)
        #: Pieces that a better or equal one may grow from: of these only the leftmost is merged in a round.
        self.slow = np.zeros(self.n, bool)
        self.slow[list(slow)] = True
        self.near = np.array(sorted(ord(a) << 32 | ord(b) for a, b in near), np.int64)
        mark = chr(MARK)
        #: Whether no piece goes on behind a word with a space.
        self.cuts = all(mark not in p.lstrip(mark) for p in ids)
        #: Spaces that go together from the left: so many become one piece before any behind them is looked at, for their
        #: pieces are all of one rank, worse than others that begin with a space, and none is longer.
        runs = sorted((p for p in ids if p.startswith(mark * 2)), key=len)
        self.run = 0
        if runs and len({self.rank[ids[p]] for p in runs}) == 1 and all(not p.strip(mark) for p in runs):
            worst, most = self.rank[ids[runs[0]]], len(runs[-1])
            alone = self.merge(np.full(most, MARK, np.uint32), np.arange(most) == 0)[0]
            if len(alone) == 1 and all(self.rank[i] < worst for p, i in ids.items() if len(p) > 1 and p.startswith(mark) and p not in runs):
                self.run = most

        words = [b"" if k in (CONTROL, UNKNOWN) else bytes([int(p[1:-1], 16)]) if k == BYTE else p.replace(mark, " ").encode() for p, k in zip(names, kinds, strict=True)]
        words = [proto.trainer_spec.unk_surface.encode() if k == UNKNOWN else w for w, k in zip(words, kinds, strict=True)]
        self.size = np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        self.spaced = np.array([k == NORMAL and p.startswith(mark) for p, k in zip(names, kinds, strict=True)])
        self.silent = kinds == CONTROL

    def pair_ids(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, -1 if none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], -1)

    def merge(self, points: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, word of each) for words given as code points, `head` marking the first of each word."""
        word = np.cumsum(head) - 1
        apart = head.copy()
        at = np.flatnonzero(np.bincount(word)[word[1:]] > LONG)
        key = points[at].astype(np.int64) << 32 | points[at + 1]
        apart[at + 1] |= self.near[np.minimum(np.searchsorted(self.near, key), len(self.near) - 1)] != key  # no piece holds these two side by side
        part = np.cumsum(apart) - 1  # what is left whole of a word: rounds work on these
        symbol, place = self.symbol[points], np.arange(len(points))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        made = np.full(len(symbol), -1, np.int32)
        made[:-1] = np.where(part[1:] == part[:-1], self.pair_ids(symbol[:-1], symbol[1:]), -1)
        while len(symbol):
            rank = np.where(made >= 0, self.rank[made], NONE)
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            many = np.diff(np.append(first, len(part)))
            best = np.minimum.reduceat(rank, first)
            if (best == NONE).any():  # these are done, the others close up
                keep = np.repeat(best != NONE, many)
                done.append((symbol[~keep], place[~keep]))
                symbol, place, part, made, rank = (x[keep] for x in (symbol, place, part, made, rank))
                many, best = many[best != NONE], best[best != NONE]
                if not len(symbol):
                    break
                first = np.cumsum(many) - many
            hit = np.flatnonzero(rank == np.repeat(best, many))
            # of hits side by side each other one counts, from the left
            run = np.append(True, (np.diff(hit) > 1) | (part[hit[1:]] != part[hit[:-1]]))
            since = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            leftmost = np.append(True, part[hit[1:]] != part[hit[:-1]])
            slow = np.zeros(part[-1] + 1, bool)
            slow[part[hit[self.slow[made[hit]]]]] = True  # parts of which one hit may be overtaken
            hit = hit[np.where(slow[part[hit]], leftmost, since % 2 == 0)]
            symbol[hit] = made[hit]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            new = np.zeros(len(symbol), bool)
            new[hit] = True
            symbol, place, part, made, new = (x[keep] for x in (symbol, place, part, made, new))
            new[:-1] |= new[1:]  # the pairs on both sides of what was merged
            at = np.flatnonzero(new)
            next_ = np.minimum(at + 1, len(symbol) - 1)
            made[at] = np.where((at + 1 < len(symbol)) & (part[at] == part[next_]), self.pair_ids(symbol[at], symbol[next_]), -1)
        symbol = np.concatenate([x for x, _ in done]) if done else symbol
        place = np.concatenate([x for _, x in done]) if done else place
        order = np.argsort(place)
        return symbol[order], word[place[order]]

    def spelled(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids for symbols, of code points that are no piece those of their bytes."""
        odd = symbol >= self.n
        if not odd.any():
            return symbol, word
        size = np.ones(len(symbol), np.int64)
        point = symbol[odd] - self.n
        size[odd] = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
        out, which = np.repeat(symbol, size), np.repeat(odd, size)
        out[which] = self.byte[np.frombuffer(point.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)]
        return out, np.repeat(word, size)

    def encode_flat(self, data: np.ndarray, ends: np.ndarray, prefixed: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each text has) of UTF-8 texts that lie between `ends`."""
        n = len(ends) - 1
        count = np.zeros(n, np.int64)
        if not len(data):
            return np.zeros(0, np.int32), count
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        first = np.append(0, np.cumsum((data & 0xC0) != 0x80))[ends[:-1]]
        some = np.flatnonzero(np.diff(ends) > 0)
        first = first[some]
        if self.prefix and prefixed:
            points = np.insert(points, first, MARK)
            first = first + np.arange(len(first))
        else:
            points = points.copy()
        points[points == 0x20] = MARK
        head = np.zeros(len(points), bool)
        head[first] = True
        space = points == MARK
        if self.cuts:
            head[1:] |= space[1:] & ~space[:-1]
        if self.cuts and self.run and (space[1:] & space[:-1]).any():
            # a run of spaces is cut every `run` of them from the left, so that 1 to `run` remain before the word
            at = np.arange(len(points))
            since = at - np.maximum.accumulate(np.where(head | ~space, at, 0))
            head |= space & (since > 0) & (since % self.run == 0)
        start = np.flatnonzero(head)
        # each different word once
        offsets = pa.py_buffer(np.append(start, len(points)).astype(np.int64) * 4)
        words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, offsets, pa.py_buffer(points.view(np.uint8))]).dictionary_encode()
        _, at, values = words.dictionary.buffers()
        at = np.frombuffer(at, np.int64)[: len(words.dictionary) + 1] // 4
        values = np.frombuffer(values, np.uint32)[: at[-1]]
        values = np.frombuffer(values, np.uint32)[: at[-1]]
        head = np.zeros(len(values), bool)
        head[at[:-1]] = True
        ids, word = self.spelled(*self.merge(values, head))
        size, which = np.bincount(word, minlength=len(at) - 1), words.indices.to_numpy()
        count[some] = np.add.reduceat(size[which], np.searchsorted(start, first))
        return gathered(ids, (np.cumsum(size) - size)[which], size[which]), count

    def encode(self, column: pa.Array, bos: bool = False, eos: bool = False, most: int = BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, how many each text has) for one run of texts after another; null is empty."""
        for t in A.texts(column, most):
            parts, count = [], np.zeros(t.n, np.int64)
            for k, (data, ends) in enumerate(pieces(t, most)):
                ids, n = self.encode_flat(data, ends, k == 0)
                parts.append(ids)
                count += n
            ids = np.concatenate(parts)
            if bos or eos:
                last = np.cumsum(count)
                around = ([last - count] if bos else []) + ([last] if eos else [])
                # at one place, which an empty text has, what ends the text before comes first
                at = np.stack(around, 1).ravel()
                ids = np.insert(ids, at, np.tile([x for x, wanted in ((self.bos, bos), (self.eos, eos)) if wanted], t.n))
                count += bos + eos
            yield ids.astype(np.int32), count

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[str]:
        """The texts of lists of ids that lie one after another; bytes that are no UTF-8 become U+FFFD each."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.n):
            raise ValueError("an id outside the vocabulary")
        size = self.size[ids]
        data, ends = gathered(self.bytes, self.start[ids], size).tobytes(), np.append(0, np.cumsum(size))
        last = np.cumsum(count)
        heard, quiet = np.flatnonzero(~self.silent[ids]), np.flatnonzero(self.silent[ids])
        opening, marks = np.searchsorted(heard, last - count), np.searchsorted(quiet, np.append(last - count, last[-1:]))
        quiet = ends[quiet].tolist()
        out = []
        for i, (a, b, k) in enumerate(zip((last - count).tolist(), last.tolist(), opening.tolist(), strict=True)):
            start = int(ends[a]) + bool(self.prefix and k < len(heard) and heard[k] < b and self.spaced[ids[heard[k]]])
            cuts = [start, *(max(start, q) for q in quiet[marks[i] : marks[i + 1]]), int(ends[b])]  # bytes don't join across a control piece
            out.append("".join(data[x:y].decode(errors="lumigraph_each_byte") for x, y in zip(cuts, cuts[1:], strict=False) if y > x))
        return out


def pieces(t: A.Texts, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, ends) of the texts; one that is much longer than `most` comes in parts, cut before a space behind an ASCII letter or sign."""
    if t.n > 1 or len(t.data) <= 2 * most:
        yield t.data, t.ends
        return
    at = 0
    while at < len(t.data):
        end, window = min(at + most, len(t.data)), 1 << 16
        while end < len(t.data):
            here = t.data[end : end + window]
            before = t.data[end - 1 : end - 1 + len(here)]
            found = np.flatnonzero((here == 0x20) & (before > 0x20) & (before < 0x7F))
            if len(found):
                end += int(found[0])
                break
            end = min(end + window, len(t.data))
        yield t.data[at:end], np.array([0, end - at])
        at = end


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def wider(rows: DataFrame, name: str, kind: str) -> T.StructType:
    """The schema of `rows` with one more column."""
    return T.StructType([*rows.schema.fields, T.StructField(name, T.DataType.fromDDL(kind))])


def encode(docs: DataFrame, model: str | None = None, text: str = "text", out: str = "ids", bos: bool = True, eos: bool = True) -> DataFrame:
    """`docs` with the ids of `text`, as the sentencepiece library encodes it, in a column array<int> named `out` or a free name like it.

    `model` is the path of a model file on the driver, read once and broadcast
    (its tables are bounded by the vocabulary: some 7 MB for 32,000 pieces).
    Null and empty texts have no ids but those of begin and end.  Equal texts
    have equal ids; repeated rows and null doc_ids are rows like others; other
    columns pass through; an empty table stays one.  Of pairs of equal rank the
    leftmost is merged.  Texts are encoded whole, a long one in parts between
    which no piece reaches, so that a task holds BYTES of text at a time
    besides a row's own ids.
    """
    name, at = free_name(docs.columns, out), docs.columns.index(text)
    codec = docs.sparkSession.sparkContext.broadcast(Codec(read_model(model or public_tokenizers.path(MODEL))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for ids, count in codec.value.encode(batch.column(at), bos, eos):
                column = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(ids))
                rows = batch.slice(done, len(count))
                yield pa.RecordBatch.from_arrays([*rows.columns, column], [*batch.schema.names, name])
                done += len(count)

    return docs.mapInArrow(work, wider(docs, name, "array<int>"))


def decode(tokens: DataFrame, model: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`tokens` with the text of each list of ids in a column named `out` or a free name like it, as the library decodes it.

    Ids of control pieces say nothing; bytes that are no UTF-8 become U+FFFD
    each.  A null list is an empty one; null ids and such outside the
    vocabulary are errors.  Other columns pass through.
    """
    name, at = free_name(tokens.columns, out), tokens.columns.index(ids)
    codec = tokens.sparkSession.sparkContext.broadcast(Codec(read_model(model or public_tokenizers.path(MODEL))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(at).fill_null([])
            flat = lists.flatten()
            if flat.null_count:
                raise ValueError("a null id")
            texts = codec.value.decode(flat.to_numpy(), lists.value_lengths().to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])

    return tokens.mapInArrow(work, wider(tokens, name, "string"))


def digest(ids: np.ndarray) -> str:
    """SHA-256, in hex, of ids as little-endian unsigned 32-bit integers."""
    return hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest()


def report(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: encoded with begin and end, decoded again, in one pass; cases as in `encode`."""
    codec = docs.sparkSession.sparkContext.broadcast(Codec(read_model(model or public_tokenizers.path(MODEL))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for ids, count in codec.value.encode(batch.column("text"), True, True):
                back = [hashlib.sha256(x.encode()).hexdigest() for x in codec.value.decode(ids, count)]
                own = [digest(x) for x in np.split(ids, np.cumsum(count)[:-1])]
                columns = [batch.column("doc_id").slice(done, len(count)), pa.array(count), pa.array(own), pa.array(back)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                done += len(count)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


SQL = None
