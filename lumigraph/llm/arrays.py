"""Numpy over the bytes of Arrow text columns: words and their hashes, many documents at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text looked at together; a longer text is looked at alone.
BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(7))
_PLACE = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP, _SIZE = (int(x) | 1 for x in _rng.integers(1 << 62, 1 << 63, 2, dtype=np.uint64))
#: What is kept of eight bytes if k of them count.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Texts:
    """Some documents' UTF-8 bytes in one array: `data`, and `ends`, the first byte of each and the end of the last."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, first: int):
        self.data, self.ends, self.first, self.n = data, ends, first, len(ends) - 1


def texts(column: pa.Array, most: int = BYTES) -> Iterator[Texts]:
    """The column's documents in pieces of about `most` bytes; null is empty; `first` is the row of a piece's first document."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1)
        yield Texts(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i], i)
        i = j


def words(t: Texts, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every run of bytes that are not in `apart`; runs stop where a document ends."""
    inside = np.zeros(len(t.data) + 2, bool)
    inside[1:-1] = ~apart[t.data]
    cut = t.ends[1:-1]
    begin, end = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cut = cut[(cut > 0) & (cut < len(t.data))]
    begin[cut] |= inside[1:-1][cut]
    end[cut - 1] |= inside[1:-1][cut - 1]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return begin, end, np.searchsorted(t.ends, begin, "right") - 1


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """A 64-bit hash of each span of bytes, each byte taken through `fold`.

    Blocks of eight bytes are scrambled together with their place in the span
    and summed: no structure of a text, such as a word and its complement,
    makes equal hashes likelier than chance.
    """
    size = end - begin
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = fold[data]
    eight = np.ndarray(len(data) + 9, "<u8", padded, strides=(1,))
    blocks = (size + 7) >> 3
    with np.errstate(over="ignore"):
        salt = mix(np.arange(1, max(blocks.max(initial=1), 1) + 1, dtype=np.uint64) * np.uint64(_STEP))
        out = mix((eight[begin] & _KEEP[np.minimum(size, 8)]) ^ salt[0])
        long = np.flatnonzero(blocks > 1)
        if len(long):
            more = blocks[long] - 1
            which = np.repeat(long, more)
            place = np.arange(len(which)) - np.repeat(np.cumsum(more) - more, more) + 1
            x = mix((eight[begin[which] + 8 * place] & _KEEP[np.minimum(size[which] - 8 * place, 8)]) ^ salt[place])
            out[long] += np.add.reduceat(x, np.cumsum(more) - more)
        return mix(out + size.astype(np.uint64) * np.uint64(_SIZE))


def shingles(t: Texts, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every run of k words; a document with fewer words, but not none, has its whole sequence as one."""
    begin, end, doc = words(t)
    h = hashes(t.data, begin, end)
    count = np.bincount(doc, minlength=t.n)
    with np.errstate(over="ignore"):
        out = np.zeros(max(len(h) - k + 1, 0), np.uint64)
        for i in range(k):
            out += h[i : i + len(out)] * _PLACE[i]
        whole = doc[: len(out)] == doc[k - 1 : k - 1 + len(out)]
        out, at = mix(out[whole]), doc[: len(out)][whole]
        few = np.flatnonzero((count > 0) & (count < k))
        if len(few):
            first = (np.cumsum(count) - count)[few]
            short = np.zeros(len(few), np.uint64)
            for i in range(k - 1):
                has = count[few] > i
                short[has] += h[first[has] + i] * _PLACE[i]
            out, at = np.append(out, mix(short + count[few].astype(np.uint64))), np.append(at, few)
    return out, at


def shingle_sets(t: Texts, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, size): the distinct shingles of each document, ascending, documents one after another, and how many each has."""
    h, doc = shingles(t, k)
    order = np.lexsort((h, doc)) if t.n > 1 else np.argsort(h)
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=t.n)
