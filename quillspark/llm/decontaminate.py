"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

The CGK walk turns a string into one of fixed length: at each step it emits the current
character and moves on or stays by a random bit that depends on the step and the character
alone. Two strings at a small edit distance fall back into step, so their embeddings are at
a small Hamming distance. Some of an embedding's positions, sampled, make a key; several
keys from several walks are looked up, and a true match meets the item in one of them.

An item is covered by walks that begin at each of its words (``LONG`` bytes and more) or each
of its bytes (shorter ones); the text's windows begin likewise. So the number of windows that
can meet follows an item's size, and the keys of its size (``KEYS``: shorter spans for shorter
items) are chosen so that the search reaches ``TARGET`` of the true matches at every length
and up to the full threshold; a test measures that. Each candidate is settled exactly.
Distances of an item's parts come first, which drop no match; then the least edit distance between the item and any substring of the text around it must be at most
``EDITS`` of the item's length.

Texts are compared lower-cased with runs of white space as one space; distances count UTF-8
bytes. Items of so few bytes that no edit is allowed must equal whole words. The walk and the
index are a fixed function of the items; a block of items is bounded by its bytes
(``BLOCK_BYTES``), is sent once an executor and indexed once a worker; further blocks are
further passes. No row is shuffled but hits.

Defined cases: null or empty texts and items match nothing. Null ids: the row is left out.
Repeated rows give a hit each pair once. Empty tables: empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import scratch

EDITS, TARGET = 0.2, 0.9
#: Items of so many bytes are met at words, others at bytes.
LONG = 64
#: Walks, and the keys of each: (sampled positions, steps they lie in, least and most bytes of an
#: item that is looked up by it).
WALKS = 2
KEYS = [(12, 30, LONG, 1 << 30), (12, 36, LONG, 1 << 30), (10, 20, LONG, 160), (9, 17, LONG, 90), (4, 7, 1, LONG - 1), (3, 5, 1, 15)]
BLOCK_BYTES = 4 << 20
CHUNK = 8 << 20
#: Windows that are embedded at once, and candidates whose distances are computed at once.
LANES, PAIRS = 1 << 15, 1 << 11


class Plan:
    """Random bits and sampled positions, the same wherever they are made, of some of the keys."""

    def __init__(self, keys: list[tuple[int, int, int, int]], seed: int = 7):
        self.keys = keys
        self.steps = max([span for _, span, *_ in keys], default=1)
        self.bits, self.sampled = [], []
        for w in range(WALKS):
            # a character on which one walk stays moves the next walk on
            bits = np.random.default_rng([seed, w // 2]).integers(0, 2, (self.steps, 256), dtype=np.int32)
            self.bits.append(bits if w % 2 == 0 else 1 - bits)
            # one position of each of n equal stretches, so that a key covers its whole span
            self.sampled.append([{int((i + u) * span / n) for i, u in enumerate(np.random.default_rng([seed, w, n, span]).random(n))} for n, span, *_ in keys])

    def embed(self, buf: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
        """A key for each table of windows of ``buf`` (padded) that begin at ``start``."""
        n = len(self.keys)
        out = [np.empty(len(start), np.uint32) for _ in range(WALKS * n)]
        for lo in range(0, len(start), LANES):
            for w in range(WALKS):
                at = start[lo : lo + LANES].astype(np.int32)
                h = [np.full(len(at), k + 1 + w * n, np.uint32) for k in range(n)]
                for j in range(self.steps):
                    c = buf[at]
                    for k in range(n):
                        if j in self.sampled[w][k]:
                            h[k] *= np.uint32(0x01000193)
                            h[k] ^= c
                            h[k] *= np.uint32(0x85EBCA6B)
                    at += self.bits[w][j][c]
                for k in range(n):
                    out[w * n + k][lo : lo + LANES] = h[k]
        return out


def clean(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode("utf-8", "surrogatepass")


def distance(item: bytes, text: bytes) -> int:
    """Least edit distance between ``item`` and any substring of ``text`` (bit-parallel)."""
    m = len(item)
    if not m:
        return 0
    where: dict[int, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = m
    for c in text:
        eq = where.get(c, 0)
        x = eq | down
        d = ((((eq & up) + up) ^ up) | eq) & full
        plus, minus = down | (full & ~(d | up)), up & d
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = plus << 1 & full
        minus = minus << 1 & full
        up, down = minus | (full & ~(x | plus)), plus & x
        if score < best:
            best = score
            if not best:
                break
    return best


def distances(items: list[bytes], which: np.ndarray, buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """``distance`` of ``items[which]`` and ``buf[lo:hi]`` for many pairs at once, in words of 64 bits."""
    out = np.empty(len(which), np.int64)
    words = np.array([-(-len(t) // 64) for t in items], np.int64)[which]
    order = np.lexsort((hi - lo, words))
    for x in np.unique(words).tolist():
        own = order[words[order] == x]
        for i in range(0, len(own), PAIRS):
            part = own[i : i + PAIRS]
            out[part] = _distances(items, which[part], buf, lo[part], hi[part], x)
    return out


def _distances(items: list[bytes], which: np.ndarray, buf: np.ndarray, lo: np.ndarray, hi: np.ndarray, words: int) -> np.ndarray:
    used, row = np.unique(which, return_inverse=True)
    where = np.zeros((words, len(used) * 257), np.uint64)  # the last column stands for the end of a text
    for r, k in enumerate(used.tolist()):
        t = np.frombuffer(items[k], np.uint8).astype(np.int64)
        i = np.arange(len(t))
        np.bitwise_or.at(where, (i >> 6, r * 257 + t), np.uint64(1) << (i & 63).astype(np.uint64))
    m = np.array([len(items[k]) for k in used.tolist()])[row]
    top, one = ((m - 1) & 63).astype(np.uint64), np.uint64(1)
    score, base, n = m.copy(), row * 257, hi - lo
    best = score.copy()
    up = [np.full(len(m), ~np.uint64(0)) for _ in range(words)]
    down = [np.zeros(len(m), np.uint64) for _ in range(words)]
    none = np.zeros(len(m), np.uint64)
    for j in range(int(n.max())):
        at = base + np.where(j < n, buf[np.minimum(lo + j, len(buf) - 1)], 256)
        more = less = none
        for w in range(words):
            eq = where[w].take(at)
            u, d = up[w], down[w]
            xv = eq | d
            eq |= less
            xh = eq & u
            xh += u
            xh ^= u
            xh |= eq
            p, q = ~(xh | u), u & xh
            p |= d
            if w == words - 1:
                score += (p >> top & one).astype(np.int64) - (q >> top & one).astype(np.int64)
            p2, q2 = p << one, q << one
            p2 |= more
            q2 |= less
            more, less = p >> np.uint64(63), q >> np.uint64(63)
            up[w] = q2 | ~(xv | p2)
            down[w] = p2 & xv
        np.minimum(best, score, out=best)
    return best


class Band:
    """Items that are met at words, or at bytes: sorted keys of each table, with (item, offset)."""

    def __init__(self, items: list[tuple[int, bytes]], words: bool):
        self.items, self.words = items, words
        self.size = np.array([len(t) for _, t in items], np.int64)
        self.allowed = np.array([int(EDITS * len(t)) for _, t in items], np.int64)
        self.plan = Plan([k for k in KEYS if any(k[2] <= len(t) <= k[3] for _, t in items)])
        self.pad = bytes(self.plan.steps + 1)
        buf = np.frombuffer(self.pad.join([*(t for _, t in items), b""]) + self.pad, np.uint8)
        begin = np.cumsum(self.size + len(self.pad)) - self.size - len(self.pad)
        start, self.item = [], []
        for k, (_, t) in enumerate(items):
            at = self.starts(np.frombuffer(b" " + t, np.uint8)) - 1 if words else np.arange(len(t))
            start.append(begin[k] + at)
            self.item.append(np.full(len(at), k, np.int64))
        start, self.item = np.concatenate(start), np.concatenate(self.item)
        self.offset = start - begin[self.item]
        left = self.size[self.item] - self.offset
        self.tables = []
        for k, h in enumerate(self.plan.embed(buf, start)):
            _, span, least, most = self.plan.keys[k % len(self.plan.keys)]
            size = self.size[self.item]
            own = np.flatnonzero((size >= least) & (size <= most) & ((self.offset == 0) | (left >= (span if words else span // 2 + 1))))
            own = own[np.argsort(h[own], kind="stable")]
            seen = np.zeros(1 << 22, bool)
            seen[h[own] & np.uint32((1 << 22) - 1)] = True
            self.tables.append((h[own], own, seen))

    @staticmethod
    def starts(buf: np.ndarray) -> np.ndarray:
        space = buf == 0x20
        return np.flatnonzero(space[:-1] & ~space[1:]) + 1

    def candidates(self, buf: np.ndarray, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, place in the index) of windows whose key is an item's, by table."""
        for h, (keys, order, seen) in zip(self.plan.embed(buf, start), self.tables):
            hit = np.flatnonzero(seen[h & np.uint32((1 << 22) - 1)])
            lo, hi = np.searchsorted(keys, h[hit]), np.searchsorted(keys, h[hit], side="right")
            n = hi - lo
            yield np.repeat(hit, n), order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def near(self, k: np.ndarray, buf: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The pairs left when the distances of an item's 64-byte parts, each to the text around
        its own place, are added up: more than is allowed is no match there."""
        left, spent = np.arange(len(k)), np.zeros(len(k), np.int64)
        for w in range(0, int(self.size[k].max(initial=0)), 64):
            part = [t[w : w + 64] for _, t in self.items]
            x = left[(self.size[k[left]] > w) & (self.size[k[left]] > 64)]
            begin = np.clip(at[x] + w - self.allowed[k[x]], lo[x], hi[x])
            end = np.clip(at[x] + w + 96 + self.allowed[k[x]], begin, hi[x])
            spent[x] += distances(part, k[x], buf, begin, end)
            left = left[spent[left] <= self.allowed[k[left]]]
        return left

    def search(self, docs: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(document, item, edits) of matches, by their places in the lists."""
        buf = np.frombuffer(b" ".join([b"", *docs]) + b" " + self.pad, np.uint8)
        start = self.starts(buf) if self.words else np.arange(1, len(buf) - len(self.pad))
        ends = np.cumsum([len(d) + 1 for d in docs])
        doc = np.searchsorted(ends, start, side="right")
        keep = doc < len(docs)
        start, doc = start[keep], doc[keep]
        # places of candidates, in steps of 32 bytes; each is settled once
        met = [np.zeros(0, np.int64)]
        span = (len(buf) >> 5) + 2 + (int(self.size.max()) >> 5)
        for w, o in self.candidates(buf, start):
            at = (start[w] - self.offset[o] >> 5) + span
            met.append((doc[w] * len(self.items) + self.item[o]) * 2 * span + at)
        tried = np.sort(np.concatenate(met))
        tried = tried[np.diff(tried, prepend=-1) > 0]
        pair, at = tried // (2 * span), (tried % (2 * span) - span) << 5
        d, k = pair // len(self.items), pair % len(self.items)
        first = ends - [len(x) + 1 for x in docs] + 1
        lo = np.maximum(first[d], at - self.allowed[k])
        hi = np.maximum(lo, np.minimum(ends[d], at + 32 + self.size[k] + self.allowed[k]))
        texts = [t for _, t in self.items]
        keep = self.near(k, buf, at, lo, hi)
        d, k, lo, hi = d[keep], k[keep], lo[keep], hi[keep]
        n = distances(texts, k, buf, lo, hi)
        ok = n <= self.allowed[k]
        yield from zip(d[ok].tolist(), k[ok].tolist(), n[ok].tolist())


class Index:
    """All items of a block, by their sizes."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.whole = [(i, t, re.compile(rb"(?<!\S)" + re.escape(t) + rb"(?!\S)")) for i, t in items if t and not int(EDITS * len(t))]
        some = [x for x in items if int(EDITS * len(x[1]))]
        groups = [([x for x in some if len(x[1]) >= LONG], True), ([x for x in some if len(x[1]) < LONG], False)]
        self.bands = [Band(x, words) for x, words in groups if x]

    def search(self, ids: list[int], docs: list[bytes]) -> list[tuple[int, int, int]]:
        """(document, item, edits) of every match."""
        found = {(i, item): 0 for i, t in zip(ids, docs) for item, _, pattern in self.whole if pattern.search(t)}
        for band in self.bands if docs else []:
            for d, k, n in band.search(docs):
                key = ids[d], band.items[k][0]
                found[key] = min(found.get(key, 1 << 30), n)
        return [(i, item, n) for (i, item), n in found.items()]


_built: dict[str, Index] = {}


def _search(items, name: str):
    """``items``: a broadcast block of bounded size; a worker keeps the index of the last one."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _built:
            _built.clear()
            _built[name] = Index(items.value)
        index = _built[name]
        ids, docs, n = [], [], 0

        def flush() -> pd.DataFrame:
            return pd.DataFrame(index.search(ids, docs), columns=["doc_id", "item_id", "edits"])

        for pdf in batches:
            for i, t in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                ids.append(i)
                docs.append(clean(t))
                n += len(docs[-1])
                if n >= CHUNK:
                    yield flush()
                    ids, docs, n = [], [], 0
        if ids:
            yield flush()

    return f


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits): every document with an item that occurs in it, nearly."""
    spark = docs.sparkSession
    scratch.small_batches(spark)
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id is not null")
    b = benchmark.select(F.col(item).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("item_id is not null and text is not null").distinct()
    size = b.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    out = None
    for k in range(blocks):  # one block is the rule; its size is bounded by BLOCK_BYTES
        rows = b.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        items = sorted((r.item_id, t) for r in rows if (t := clean(r.text)))
        hits = d.mapInPandas(_search(spark.sparkContext.broadcast(items), uuid.uuid4().hex), "doc_id long, item_id long, edits long")
        out = hits if out is None else out.unionByName(hits)
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(scratch.table(spark, sf_dir, "documents"), scratch.table(spark, sf_dir, "benchmark"))
