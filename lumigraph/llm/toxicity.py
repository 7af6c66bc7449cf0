"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumigraph.llm import arrays as A
from lumigraph.llm.labelled import TRAIN_ROWS, report, sample
from lumigraph.sources.tables import table

GRAMS, BUCKETS, DIM, PASSAGE = (3, 4, 5), 1 << 17, 8, 32
THRESHOLD = 0.5
#: Bytes of text looked at together: every character becomes some hundred bytes of hashes.
PIECE = 1 << 20
#: Buckets found in fewer documents of the sample (or than it has toxic ones, if these are fewer) have no vector and take no part in means.
LEAST_DOCS = 3
#: Grams without a meaning that every mean holds, so that short passages tell little; factor of the mean in the softmax.
PRIOR, GAIN, RATE = 1_000, 40, 0.05
#: Passages of the sample that one fit looks at, at most: part of the bound on labelled rows.
FIT_PASSAGES = 40_000
#: Passes over them, or as many as make so many steps; how often they are chosen anew after that.
EPOCHS, LEAST_STEPS, REFITS = 2, 100, 3
#: How far the classes are brought to one weight in the last regression (1: wholly), and its prior.
BALANCE, RIDGE = 0.5, 1.0

#: Letters and digits below 0x250 in lower case, 0 for all that parts words; above, every code point is a letter.
_FOLD = np.array([ord(x) if len(x := chr(c).lower()) == 1 and chr(c).isalnum() else c if chr(c).isalnum() else 0 for c in range(0x250)], np.uint32)
_MULTIPLY = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393], np.uint32)


def code_points(t: A.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(folded code points with a 0 around each document, start of each document and the end)."""
    chars = np.frombuffer(t.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    first = np.append(0, np.cumsum((t.data & 0xC0) != 0x80))
    ends = first[t.ends]
    out = np.zeros(len(chars) + t.n + 1, np.uint32)
    where = np.arange(len(chars)) + np.repeat(np.arange(1, t.n + 1), np.diff(ends))
    out[where] = np.where(chars < 0x250, _FOLD[np.minimum(chars, 0x24F)], chars)
    return out, ends + np.arange(t.n + 1)


def words(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(boundary before each word, its hash, positions of all characters of words, the word of each)."""
    inside = c != 0
    at, chars = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside)
    if not len(at):
        return at, np.zeros(0, np.uint32), chars, chars
    first = np.flatnonzero(np.append(True, np.diff(chars) > 1))
    number = np.repeat(np.arange(len(at)), np.diff(np.append(first, len(chars))))
    place = (chars - at[number]).astype(np.uint32)
    with np.errstate(over="ignore"):
        x = (c[chars] + place * np.uint32(0x9E3779B9)) * np.uint32(0x85EBCA6B)
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0xC2B2AE35)
        return at, np.add.reduceat(x, first, dtype=np.uint32) * np.uint32(0x27D4EB2F), chars, number


def passages(t: A.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, first position of each passage and the end, document of each passage).

    A passage is PASSAGE words; it begins at the boundary before its first word.
    Words that a passage has had already are blanked: a word said twenty times
    tells what it tells once.
    """
    c, starts = code_points(t)
    at, h, chars, number = words(c)
    doc = np.searchsorted(starts, at, "right") - 1
    count = np.bincount(doc, minlength=t.n)
    head = (np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)) % PASSAGE == 0
    _, first = np.unique((np.cumsum(head).astype(np.uint64) << np.uint64(32)) | h, return_index=True)
    new = np.zeros(len(at), bool)
    new[first] = True
    c[chars[~new[number]]] = 0
    return c, np.append(at[head], len(c)), doc[head]


def grams(c: np.ndarray):
    """For whole words, and for each size: (bucket of what starts at each position, which of them lie in one word with its boundaries)."""
    inside = c != 0
    at, h, _, _ = words(c)
    bucket, ok = np.zeros(len(c), np.uint32), np.zeros(len(c), bool)
    bucket[at], ok[at] = h >> np.uint32(32 - BUCKETS.bit_length() + 1), True
    yield bucket, ok
    with np.errstate(over="ignore"):
        for n in GRAMS:
            m = len(c) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n, np.uint32)
            ok = np.ones(m, bool)
            for i in range(n):
                x = c[i : i + m] + np.uint32(i + 1)
                h = (h ^ (x * _MULTIPLY[i])) * np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(13)
                if 0 < i < n - 1:
                    ok &= inside[i : i + m]
            yield (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BUCKETS.bit_length() + 1), ok


class Model:
    """What scoring needs of the embeddings and the softmax: each bucket's share of the difference of the two logits."""

    def __init__(self, weight: np.ndarray, known: np.ndarray, bias: float, scale: np.ndarray):
        self.weight, self.known, self.bias, self.scale = np.where(known, weight, 0).astype(np.float32), known, bias, scale

    def features(self, column: pa.Array) -> np.ndarray:
        """For each document: the mean and the largest of its passages' logits, their mean probability, the logarithm of their number, and 1.

        A document without words has the bias, the logit of no evidence.
        """
        out = []
        for t in A.texts(column, PIECE):
            c, at, doc = passages(t)
            total, count = np.zeros(len(c)), np.zeros(len(c))
            for bucket, ok in grams(c):
                total[: len(ok)] += np.where(ok, self.weight[bucket], 0)
                count[: len(ok)] += ok & self.known[bucket]
            rows = np.tile([self.bias, self.bias, 1 / (1 + np.exp(-self.bias)), 0.0, 1.0], (t.n, 1))
            if len(doc):
                z = self.bias + np.add.reduceat(total, at[:-1]) / (np.add.reduceat(count, at[:-1]) + PRIOR)
                first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                n = np.diff(np.append(first, len(doc)))
                rows[doc[first], 0] = np.add.reduceat(z, first) / n
                rows[doc[first], 1] = np.maximum.reduceat(z, first)
                rows[doc[first], 2] = np.add.reduceat(1 / (1 + np.exp(-z)), first) / n
                rows[doc[first], 3] = np.log(n)
            out.append(rows)
        return np.concatenate(out) if out else np.zeros((0, 5))

    def __call__(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(column) @ self.scale, -500, 500)))


def bags(column: pa.Array):
    """For each piece of the column: (bucket of each gram, passage of each gram, document of each passage)."""
    for t in A.texts(column, PIECE):
        c, at, doc = passages(t)
        if len(doc):
            found = [(np.flatnonzero(ok), b[ok]) for b, ok in grams(c)]
            of = np.searchsorted(at, np.concatenate([x for x, _ in found]), "right") - 1
            yield np.concatenate([b for _, b in found]), of, doc + t.first


def chosen_bags(column: pa.Array, known: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(known buckets of the chosen passages, one passage after another; where each ends, from 0 on)."""
    out, ends, before, base = [], [np.zeros(1, np.int64)], 0, 0
    for bucket, of, doc in bags(column):
        own = chosen[(chosen >= before) & (chosen < before + len(doc))] - before
        take = np.zeros(len(doc), bool)
        take[own] = True
        keep = take[of] & known[bucket]
        order = np.argsort(of[keep], kind="stable")
        out.append(bucket[keep][order])
        ends.append(base + np.cumsum(np.bincount(of[keep], minlength=len(doc))[take]))
        base += len(out[-1])
        before += len(doc)
    return np.concatenate(out), np.concatenate(ends)


def calibrated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the features of documents, by logistic regression with a weak prior, in Newton steps; the rarer class weighs more, by BALANCE."""
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    share = share**BALANCE
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (p - y)) + RIDGE * w
        h = (x * (share * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(h, g), -2, 2)
    return w


class Bags:
    """Passages as bags of buckets: those of passage i are buckets[ends[i] : ends[i + 1]]."""

    def __init__(self, buckets: np.ndarray, ends: np.ndarray):
        self.buckets, self.ends = buckets, ends

    def of(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(buckets of these passages one after another, how many each has)."""
        n = self.ends[some + 1] - self.ends[some]
        at = np.repeat(self.ends[some] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        return self.buckets[at], n


class Net:
    """Embeddings of buckets, and a linear softmax over GAIN times the mean of a passage's."""

    def __init__(self, rng: np.random.Generator, size: int = BUCKETS):
        self.e = rng.normal(0, 0.1, (size, DIM)).astype(np.float32)
        self.w = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
        self.bias = np.zeros(2)
        self.seen = [np.full(size, 1e-6), np.full(self.w.shape, 1e-6), np.full(2, 1e-6)]

    def means(self, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.e[b], np.append(0, np.cumsum(n)[:-1]), axis=0) * (GAIN / (n[:, None] + PRIOR))

    def gradients(self, b: np.ndarray, n: np.ndarray, label: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, ...]:
        """(different buckets, gradient of their embeddings, of w, of bias) of the mean cross-entropy of passages that weigh `share`."""
        m = self.means(b, n)
        z = m @ self.w + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(n)), label] -= 1
        g = p * (share / len(n))[:, None]
        ge = (g @ self.w.T) * (GAIN / (n[:, None] + PRIOR))
        unique, inverse = np.unique(b, return_inverse=True)
        rows = np.repeat(np.arange(len(n)), n)
        return unique, np.stack([np.bincount(inverse, ge[rows, k], len(unique)) for k in range(DIM)], 1), m.T @ g, g.sum(0)

    def learn(self, bags: Bags, label: np.ndarray, some: np.ndarray) -> None:
        """One pass over the passages `some`, by Adagrad on everything at once; both labels weigh the same."""
        weight = np.array([0.5 / max(1, (label[some] == k).sum()) for k in (0, 1)]) * len(some)
        for i in range(0, len(some), 256):
            part = some[i : i + 256]
            b, n = bags.of(part)
            unique, ge, gw, gb = self.gradients(b, n, label[part], weight[label[part]])
            for value, at, grad, seen in ((self.e, unique, ge, self.seen[0]), (self.w, ..., gw, self.seen[1]), (self.bias, ..., gb, self.seen[2])):
                seen[at] += (grad**2).mean(1) if value is self.e else grad**2
                root = np.sqrt(seen[at])
                value[at] -= (RATE * grad / (root[:, None] if value is self.e else root)).astype(value.dtype)

    def logits(self, bags: Bags, some: np.ndarray) -> np.ndarray:
        """Difference of the two logits of each passage."""
        out = [np.zeros(0)]
        for i in range(0, len(some), 4096):
            out.append(self.means(*bags.of(some[i : i + 4096])) @ (self.w[:, 1] - self.w[:, 0]) + self.bias[1] - self.bias[0])
        return np.concatenate(out)


def fit(column: pa.Array, y: np.ndarray, seed: int = 1) -> Model:
    """Embeddings of character n-gram buckets and the softmax over their mean, trained jointly.

    The passages of the sample, or, where there are more, FIT_PASSAGES of them
    drawn by label, have their document's label.  That is wrong for most
    passages of a toxic document, so after EPOCHS passes those that the model
    takes for clean are left out, but for each document's likeliest, and
    training goes on with the rest.  A fifth of the sample, kept from the fit,
    sets how much the mean and the highest passages of a document count.
    Without two classes: one constant score.
    """
    rate = (y.sum() + 0.5) / (len(y) + 1)
    constant = Model(np.zeros(BUCKETS), np.zeros(BUCKETS, bool), float(np.log(rate / (1 - rate))), np.array([1.0, 0, 0, 0, 0]))
    if len(y) < 20 or y.min() == y.max():
        return constant
    rng = np.random.default_rng(seed)
    check = np.arange(len(y)) % 5 == 0
    found, doc = np.zeros(BUCKETS, np.int64), []
    for bucket, of, own in bags(column):
        found += np.bincount(np.unique(own[of] * BUCKETS + bucket) % BUCKETS, minlength=BUCKETS)
        doc.append(own)
    doc = np.concatenate(doc) if doc else np.zeros(0, np.int64)
    known = found >= min(LEAST_DOCS, y.sum())  # telling words are rare: the floor does not grow with the sample
    own = np.flatnonzero(~check[doc])
    toxic = rng.permutation(own[y[doc[own]] == 1])[: FIT_PASSAGES // 2]
    clean = rng.permutation(own[y[doc[own]] == 0])[: FIT_PASSAGES - len(toxic)]
    chosen = np.sort(np.append(toxic, clean))
    if not len(toxic) or not len(clean) or not known.any():
        return constant
    buckets, ends = chosen_bags(column, known, chosen)
    doc, full = doc[chosen], np.diff(ends) > 0
    some, doc = Bags(buckets, np.append(0, ends[1:][full])), doc[full]
    label, net = y[doc].astype(int), Net(rng)
    every = np.arange(len(doc))
    for turn in range(1 + REFITS):
        if turn:
            z = net.logits(some, every)
            first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            best = np.maximum.reduceat(z, first)[np.cumsum(np.append(True, doc[1:] != doc[:-1])) - 1]
            kept = np.flatnonzero((label == 0) | (z >= 0) | (z == best))
        else:
            kept = every
        for _ in range(max(EPOCHS, -(-LEAST_STEPS // -(-len(kept) // 256)))):
            net.learn(some, label, rng.permutation(kept))
    model = Model(GAIN * net.e @ (net.w[:, 1] - net.w[:, 0]), known, float(net.bias[1] - net.bias[0]), np.zeros(5))
    model.scale = calibrated(model.features(column.filter(pa.array(check))), y[check])
    return model


def trained(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    return fit(*sample(docs, labels, "toxic", rows))


def score(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted): probability that a document is toxic; predicted from THRESHOLD on.

    The model is fitted on the driver from `rows` labelled documents and
    FIT_PASSAGES passages of them at most; every text, however long, is scored
    whole, by the mean and the highest of its passages' softmax.  Null and empty
    texts, and texts without letters, have the score of no evidence; a score of
    exactly THRESHOLD is predicted 1.  A null doc_id is not held out.  Repeated
    rows give a row each, each by its own text; an empty table gives no rows;
    extra columns are not looked at; without usable labels of both classes all
    scores are one constant.
    """
    return report(docs, trained(docs, labels, rows), THRESHOLD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = None
