"""Quality classifier: attention-based multiple-instance learning over a document's passages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigraph.llm import arrays as A
from lumigraph.llm.labelled import report, sample, scored
from lumigraph.llm.text import free_name
from lumigraph.sources.tables import table

PASSAGE, HIDDEN, ATTENTION = 48, 16, 8
THRESHOLD, STEPS, RATE, DECAY = 0.3, 150, 0.03, 1e-3
#: Labelled rows of one fit, at most.
ROWS = 1500

#: What a byte counts as: 0 lower case, 1 upper case, 2 digit, 3 space, 4 line end, 5 . and ,; 6 other sentence marks, 7 bars and brackets, 8 other ASCII, 9 beyond ASCII.
_CLASS = np.full(256, 8, np.uint8)
for _k, _bytes in enumerate((range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), b" \t\r\x0b\x0c", b"\n", b".,", b"!?;:'\"-", b"|()[]{}<>/\\_=", (), range(0x80, 0x100))):
    _CLASS[list(_bytes)] = _k
CLASSES = 10
FEATURES = CLASSES + 6


def encode(t: A.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(features, document) of every passage of PASSAGE words, from a word's start to the next passage's.

    Features: shares of the byte classes, mean length of words, share of words
    equal to the one before, of words new in the passage, of three-word runs
    found more than once in the document, and size of passage and document.
    """
    begin, end, doc = A.words(t)
    if not len(begin):
        return np.zeros((0, FEATURES)), np.zeros(0, np.int64)
    count = np.bincount(doc, minlength=t.n)
    first = np.cumsum(count) - count
    head = np.flatnonzero((np.arange(len(begin)) - first[doc]) % PASSAGE == 0)
    owner = doc[head]
    passage = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(begin))))
    n = np.diff(np.append(head, len(begin)))
    start = begin[head]
    stop = np.append(begin[head[1:]], len(t.data))
    stop = np.minimum(stop, t.ends[owner + 1])
    size = np.maximum(stop - start, 1)
    out = np.zeros((len(head), FEATURES))
    of = np.repeat(np.arange(len(head)), np.diff(np.append(start, len(t.data))))
    inner = np.arange(start[0], len(t.data)) < stop[of]  # not what precedes the next document's first word
    code = of * CLASSES + _CLASS[t.data[start[0] :]]
    out[:, :CLASSES] = np.bincount(code[inner], minlength=len(head) * CLASSES).reshape(-1, CLASSES) / size[:, None]
    h = A.hashes(t.data, begin, end)
    out[:, CLASSES] = np.log1p(np.add.reduceat(end - begin, head) / n)
    same = np.append(False, (h[1:] == h[:-1]) & (passage[1:] == passage[:-1]))
    out[:, CLASSES + 1] = np.add.reduceat(same, head, dtype=np.int64) / n
    key = np.unique((passage.astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32)))
    out[:, CLASSES + 2] = np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=len(head)) / n
    again = np.zeros(len(h))
    inside = np.flatnonzero(doc[:-2] == doc[2:])  # runs of three words of one document
    with np.errstate(over="ignore"):
        run = A.mix(h[inside] * np.uint64(3) + h[inside + 1] * np.uint64(5) + h[inside + 2] * np.uint64(7) + doc[inside].astype(np.uint64))
    ordered = np.sort(run)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(twice):
        again[inside] = twice[np.minimum(np.searchsorted(twice, run), len(twice) - 1)] == run
    out[:, CLASSES + 3] = np.add.reduceat(again, head) / n
    out[:, CLASSES + 4] = np.log1p(n) / np.log1p(PASSAGE)
    out[:, CLASSES + 5] = np.log1p(count[owner]) / 10
    return out, owner


class Model:
    """Encoder, gated attention and classifier; a document is the attention-weighted mean of its encoded passages."""

    NAMES = ("enc", "enc_b", "gate_v", "gate_u", "att", "out", "out_b")

    def __init__(self, weights: dict[str, np.ndarray], mean: np.ndarray, spread: np.ndarray):
        self.w, self.mean, self.spread = weights, mean, spread

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """All layers for passages `x`, those of a document from `first` on."""
        w = self.w
        n = np.diff(np.append(first, len(x)))
        x = (x - self.mean) / self.spread
        h = np.tanh(x @ w["enc"] + w["enc_b"])
        v, u = np.tanh(h @ w["gate_v"]), 1 / (1 + np.exp(-(h @ w["gate_u"])))
        e = (v * u) @ w["att"]
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, first), n))
        a /= np.repeat(np.add.reduceat(a, first), n)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "n": n, "logit": z @ w["out"] + w["out_b"]}

    def __call__(self, column: pa.Array) -> np.ndarray:
        """Score of each document; without words, that of a passage as the average one."""
        out = []
        for t in A.texts(column):
            x, doc = encode(t)
            score = np.full(t.n, 1 / (1 + np.exp(-self.forward(self.mean[None], np.zeros(1, np.int64))["logit"][0])))
            if len(doc):
                first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                score[doc[first]] = 1 / (1 + np.exp(-np.clip(self.forward(x, first)["logit"], -500, 500)))
            out.append(score)
        return np.concatenate(out) if out else np.zeros(0)


def gradients(model: Model, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy of documents, by every weight."""
    f, w = model.forward(x, first), model.w
    g = (1 / (1 + np.exp(-f["logit"])) - y) / len(y)
    gz = g[:, None] * w["out"]
    wide = np.repeat(gz, f["n"], axis=0)
    ga = (wide * f["h"]).sum(1)
    ge = f["a"] * (ga - np.repeat(np.add.reduceat(f["a"] * ga, first), f["n"]))
    gv, gu = ge[:, None] * w["att"] * f["u"] * (1 - f["v"] ** 2), ge[:, None] * w["att"] * f["v"] * f["u"] * (1 - f["u"])
    gh = (f["a"][:, None] * wide + gv @ w["gate_v"].T + gu @ w["gate_u"].T) * (1 - f["h"] ** 2)
    return {"enc": f["x"].T @ gh, "enc_b": gh.sum(0), "gate_v": f["h"].T @ gv, "gate_u": f["h"].T @ gu, "att": (f["v"] * f["u"]).T @ ge, "out": f["z"].T @ g, "out_b": np.array([g.sum()])}


def fit(column: pa.Array, y: np.ndarray, seed: int = 3) -> Model:
    """All layers together from document labels, by Adam on the whole sample; without two classes: one constant score."""
    rng = np.random.default_rng(seed)
    parts = [(encode(t), t.first) for t in A.texts(column)]
    x = np.concatenate([e[0] for e, _ in parts]) if parts else np.zeros((0, FEATURES))
    doc = np.concatenate([e[1] + at for e, at in parts]) if parts else np.zeros(0, np.int64)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    w = {"enc": draw(FEATURES, HIDDEN), "enc_b": np.zeros(HIDDEN), "gate_v": draw(HIDDEN, ATTENTION), "gate_u": draw(HIDDEN, ATTENTION)}
    w |= {"att": draw(ATTENTION), "out": draw(HIDDEN), "out_b": np.zeros(1)}
    if len(doc) < 20 or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        w["out"], w["out_b"] = np.zeros(HIDDEN), np.array([np.log(rate / (1 - rate))])
        return Model(w, np.zeros(FEATURES), np.ones(FEATURES))
    model = Model(w, x.mean(0), x.std(0) + 1e-3)
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    y = y[doc[first]]
    m, s = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        grad = gradients(model, x, first, y)
        for k in Model.NAMES:
            d = grad[k] + DECAY * w[k] * (w[k].ndim > 1)
            m[k] = 0.9 * m[k] + 0.1 * d
            s[k] = 0.999 * s[k] + 0.001 * d**2
            w[k] = w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return model


def trained(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    return fit(*sample(docs, labels, "quality", rows))


def score(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted): probability of quality 1; predicted from THRESHOLD on.

    The model is fitted on the driver from `rows` labelled documents at most;
    every passage of every text, however long, is encoded and weighed.  Null and
    empty texts have the score of an average passage; a score of exactly
    THRESHOLD is predicted 1.  A null doc_id is not held out.  Repeated rows
    give a row each, each by its own text; an empty table gives no rows; extra
    columns are not looked at; without usable labels of both classes all scores
    are one constant.
    """
    return report(docs, trained(docs, labels, rows), THRESHOLD)


def accepted(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """`docs` without those that score under THRESHOLD; all columns as they were."""
    name = free_name(docs.columns, "lg_score")
    return scored(docs, trained(docs, labels, rows), name).where(F.col(name) >= THRESHOLD).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = None
