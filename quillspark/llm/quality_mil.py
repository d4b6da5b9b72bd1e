"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded by hashed counts of its words and
of its character 3-grams and by what its bytes are like; a learned projection turns that into
a hidden representation. Gated attention, learned from document labels alone, says how much
each passage counts, and the weighted passage representation is scored. Texts are encoded on
the executors over whole documents. The model is fitted in numpy on a bounded sample of
labelled bags: ``SAMPLE_DOCS`` documents, chosen by a hash, of each at most ``BAG`` passages,
evenly spaced (a longer text so takes no more room than others); it is some kilobytes.

Defined cases: null or empty text: one passage without bytes. A null id: the row is left
out. Repeated labels of an id: their mean decides, at least half is 1. Rows that repeat an
id each get a row; the smallest text is fitted. Labels without a document do not count. No
usable labels, or labels of one kind: every score is the share of label 1 (0.5 without
labels), and ``Model.n_bags`` says how many bags were used. Empty table: empty result. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import exchange as X
from quillspark.llm import hashing as H
from quillspark.llm import scratch

SAMPLE_DOCS, BAG = 6000, 48
PASSAGE = 512
#: Buckets of hashed words and of hashed character 3-grams.
WORDS, GRAMS = 128, 256
_MARKS = b"#*$%&|<>!.,;:?\"'()[]{}-_=+/@~^\\"
N_CLASSES = 10 + len(_MARKS)
_CLASS = np.zeros(256, np.int64)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[0x20] = 4
_CLASS[[0x09, 0x0D, 0x0B, 0x0C]] = 5
_CLASS[0x0A] = 6
_CLASS[0x80:0xC0] = 7
_CLASS[0xC0:] = 8
for _i, _c in enumerate(_MARKS):
    _CLASS[_c] = 10 + _i
BASE = N_CLASSES + 6
DIM = BASE + WORDS + GRAMS
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def encode(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features, document index) of the passages of whole texts; one at least a document."""
    size = np.array([len(d) for d in docs], np.int64)
    count = np.maximum(1, -(-size // PASSAGE))
    first = np.cumsum(count) - count
    doc = np.repeat(np.arange(len(docs)), count)
    n = len(doc)
    buf = np.frombuffer(b"".join(docs), np.uint8)
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(docs)), size)
    passage = first[owner] + (np.arange(len(buf)) - begin[owner]) // PASSAGE
    hist = np.bincount(passage * N_CLASSES + _CLASS[buf], minlength=n * N_CLASSES).reshape(n, N_CLASSES).astype(np.float32)
    total = np.maximum(1, hist.sum(1))
    out = np.zeros((n, DIM), np.float32)
    out[:, :N_CLASSES] = np.sqrt(hist / total[:, None])
    # words that lie in shingles which come again in the document, by passage
    w, wd = H.words(docs)
    g = _again(w, wd, 5)
    both = np.frombuffer(b" ".join([b"", *docs, b""]), np.uint8)
    space = H._SPACE[both]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    inside = start - 1 - np.repeat(begin + np.arange(len(docs)), np.bincount(wd, minlength=len(docs)))
    wp = first[wd] + inside // PASSAGE
    words = np.bincount(wp, minlength=n).astype(np.float32)
    again = np.bincount(wp, weights=g, minlength=n).astype(np.float32)
    out[:, N_CLASSES] = again / np.maximum(1, words)
    out[:, N_CLASSES + 1] = (total - hist[:, 4] - hist[:, 6]) / np.maximum(1, words) / 10
    out[:, N_CLASSES + 2] = np.log1p(words) / 5
    per = np.bincount(wd, minlength=len(docs)).astype(np.float32)
    out[:, N_CLASSES + 3] = np.log1p(per)[doc] / 8
    out[:, N_CLASSES + 4] = (np.bincount(wd, weights=g, minlength=len(docs)) / np.maximum(1, per))[doc]
    out[:, N_CLASSES + 5] = hist[:, 2] / np.maximum(1, hist[:, 1] + hist[:, 2])
    # hashed n-grams, as square roots of their shares
    h = np.bincount(wp * WORDS + (w >> np.uint64(40)).astype(np.int64) % WORDS, minlength=n * WORDS).reshape(n, WORDS)
    out[:, BASE : BASE + WORDS] = np.sqrt(h / np.maximum(1, words)[:, None])
    if len(buf) > 2:
        low = _LOWER[buf].astype(np.uint32)
        g = low[:-2] | low[1:-1] << np.uint32(8) | low[2:] << np.uint32(16)
        g = (g * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.int64)
        same = passage[:-2] == passage[2:]
        h = np.bincount(passage[:-2][same] * GRAMS + g[same], minlength=n * GRAMS).reshape(n, GRAMS)
        out[:, BASE + WORDS :] = np.sqrt(h / total[:, None])
    return out, doc


def _again(w: np.ndarray, d: np.ndarray, width: int) -> np.ndarray:
    """1 for words in a window of ``width`` words that comes twice or more in its document."""
    out = np.zeros(len(w))
    n = len(w) - width + 1
    if n <= 0:
        return out
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = H.mix(h ^ w[k : k + n]) * H.BASE
    h ^= H.mix(d[:n].astype(np.uint64))
    at = np.flatnonzero(d[:n] == d[width - 1 :])
    order = at[np.argsort(h[at], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    hit = np.zeros(len(order), bool)
    hit[1:] |= same
    hit[:-1] |= same
    edge = np.zeros(len(w) + 1)
    np.add.at(edge, order[hit], 1)
    np.add.at(edge, order[hit] + width, -1)
    return (np.cumsum(edge[:-1]) > 0).astype(float)


class Model:
    """Gated attention over passages, one hidden layer; plain numpy."""

    def __init__(self, dim: int = DIM, hidden: int = 24, att: int = 12, seed: int = 1):
        r = np.random.default_rng(seed)
        self.p = {"W": r.normal(0, dim**-0.5, (dim, hidden)), "b": np.zeros(hidden), "V": r.normal(0, hidden**-0.5, (hidden, att)),
                  "U": r.normal(0, hidden**-0.5, (hidden, att)), "a": r.normal(0, att**-0.5, att), "c": r.normal(0, hidden**-0.5, hidden), "d": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.mean, self.std = np.zeros(dim, np.float32), np.ones(dim, np.float32)
        self.constant: float | None = None
        self.n_bags = 0

    def forward(self, x: np.ndarray, doc: np.ndarray, n: int) -> dict[str, np.ndarray]:
        p = self.p
        x = np.clip((x - self.mean) / self.std, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["a"]
        first = np.searchsorted(doc, np.arange(n))
        e = np.exp(e - np.maximum.reduceat(e, first)[doc])
        w = e / np.add.reduceat(e, first)[doc]
        z = np.add.reduceat(w[:, None] * h, first, axis=0)
        s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"x": x, "h": h, "t": t, "g": g, "w": w, "z": z, "s": s}

    def score(self, x: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        return np.full(n, self.constant) if self.constant is not None else self.forward(x, doc, n)["s"]

    def fit(self, x: np.ndarray, doc: np.ndarray, y: np.ndarray, epochs: int = 24, batch: int = 256, rate: float = 0.01, decay: float = 1e-3) -> "Model":
        """Adam on mini-batches of bags, in a fixed random order; the rate falls to a tenth."""
        n = self.n_bags = len(y)
        if not n or y.min() == y.max():
            self.constant = float(y.mean()) if n else 0.5
            return self
        self.mean, self.std = (a.astype(np.float32) for a in (x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64) + 1e-3))
        y = y.astype(np.float32)
        first = np.searchsorted(doc, np.arange(n + 1))
        rng = np.random.default_rng(3)
        m, v = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}
        i, steps = 0, epochs * -(-n // batch)
        for _ in range(epochs):
            order = rng.permutation(n)
            for lo in range(0, n, batch):
                own = order[lo : lo + batch]
                size = first[own + 1] - first[own]
                rows = np.repeat(first[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
                grad = self._gradient(x[rows], np.repeat(np.arange(len(own)), size), y[own])
                i += 1
                now = rate * (1 - 0.9 * i / steps)
                for k in self.p:
                    gk = grad[k] + np.float32(decay) * self.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * gk, 0.999 * v[k] + 0.001 * gk**2
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-8)).astype(np.float32)
        return self

    def _gradient(self, x: np.ndarray, doc: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(y)
        f = self.forward(x, doc, n)
        ds = (f["s"] - y) / n
        grad = {"c": f["z"].T @ ds, "d": np.array([ds.sum()])}
        dz = ds[:, None] * p["c"]
        dw = (f["h"] * dz[doc]).sum(1)
        first = np.searchsorted(doc, np.arange(n))
        de = f["w"] * (dw - np.add.reduceat(f["w"] * dw, first)[doc])
        q = f["t"] * f["g"]
        grad["a"] = q.T @ de
        dq = de[:, None] * p["a"]
        dt, dg = dq * f["g"] * (1 - f["t"] ** 2), dq * f["t"] * f["g"] * (1 - f["g"])
        grad["V"], grad["U"] = f["h"].T @ dt, f["h"].T @ dg
        dh = (f["w"][:, None] * dz[doc] + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        grad["W"], grad["b"] = f["x"].T @ dh, dh.sum(0)
        return grad


def _some(n: int) -> np.ndarray:
    """Places of at most BAG of a bag's passages, evenly spaced."""
    return np.arange(n) if n <= BAG else np.arange(BAG) * n // BAG


def _bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for ids, docs in X.runs(batches, "doc_id", "text", 1 << 20):
        f, d = encode(docs)
        cut = np.searchsorted(d, np.arange(len(docs) + 1))
        yield pd.DataFrame({"doc_id": ids, "bag": [f[cut[k] + _some(cut[k + 1] - cut[k])].astype("<f2").tobytes() for k in range(len(docs))]})


def _scorer(model: Model):
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, docs in X.runs(batches, "doc_id", "text", 1 << 20):
            x, d = encode(docs)
            yield pd.DataFrame({"doc_id": ids, "score": model.score(x, d, len(docs)).astype(np.float64)})

    return f


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on (doc_id, text) and (doc_id, label); see the module for the bound."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("double").alias("label")).filter("doc_id is not null and label is not null")
    some = some.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label")).join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    ids = [(r.doc_id, r.label) for r in some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).collect()]  # SAMPLE_DOCS pairs at most
    if not ids:
        return Model().fit(np.zeros((0, DIM)), np.zeros(0, np.int64), np.zeros(0))
    chosen = F.broadcast(spark.createDataFrame([(i,) for i, _ in ids], "doc_id long"))
    bags = texts.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    got = {r.doc_id: r.bag for r in bags.repartition(scratch.parts(spark), "doc_id").mapInPandas(_bags, "doc_id long, bag binary").collect()}  # SAMPLE_DOCS bags of BAG passages at most
    pairs = sorted(ids)
    size = [len(got[i]) // (2 * DIM) for i, _ in pairs]
    x = np.frombuffer(b"".join(got.pop(i) for i, _ in pairs), "<f2").reshape(-1, DIM).astype(np.float32)
    return Model().fit(x, np.repeat(np.arange(len(pairs)), size), np.array([y for _, y in pairs], float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInPandas(_scorer(model), "doc_id long, score double")


def op5_quality_mil(spark, sf_dir: str) -> DataFrame:
    scratch.small_batches(spark)
    docs = scratch.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    labels = scratch.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long"), F.col("quality").alias("label")).filter(~held)
    out = score(docs, train(docs, labels))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
