"""Which keys occur more than once in the whole input, told back to the documents that hold them.

Each input run sorts its own (key, document, aux) entries. A key that occurs twice in a run
is known to be shared, so its entries go straight to their documents' bucket and the key
crosses the exchange once; other keys cross with their document. So a key held by a third
of all rows crosses once a run, never once a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quillspark.llm import hashing as H

SCHEMA = "part int, kind int, a binary, b binary, c binary"
SINGLE, SHARED, DIRECT, HEADER = 0, 1, 2, 3
#: Bytes of text that one run holds.
RUN_BYTES = 4 << 20


def runs(batches: Iterator[pd.DataFrame], key: str, text: str, size: int = RUN_BYTES) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Documents of a partition in runs of about ``size`` bytes; null text is empty."""
    ids: list[int] = []
    docs: list[bytes] = []
    total = 0
    for pdf in batches:
        for i, t in zip(pdf[key].tolist(), pdf[text].tolist()):
            b = t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass")
            ids.append(i)
            docs.append(b)
            total += len(b)
            if total >= size:
                yield np.array(ids, np.int64), docs
                ids, docs, total = [], [], 0
    if ids:
        yield np.array(ids, np.int64), docs


def bucket_of(doc: np.ndarray, n: int) -> np.ndarray:
    return (H.mix(doc.astype(np.int64).view(np.uint64)) % np.uint64(n)).astype(np.int64)


def part_of(key: np.ndarray, n: int) -> np.ndarray:
    return ((H.mix(key + np.uint64(1)) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def by_part(part: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, indices in order) of each part that has any."""
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(n + 1))
    for p in range(n):
        if cut[p] < cut[p + 1]:
            yield p, order[cut[p] : cut[p + 1]]


def send(key: np.ndarray, doc: np.ndarray, aux: np.ndarray | None, n: int) -> Iterator[tuple]:
    """Rows of SCHEMA for one run. Entries must be distinct; aux None: the key itself. Parts go by
    a mix of the key, for keys that are least hashes of a span all lie low."""
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    aux = None if aux is None else aux[order]
    same = key[1:] == key[:-1]
    many = np.zeros(len(key), bool)
    many[1:] |= same
    many[:-1] |= same
    first = np.ones(len(key), bool)
    first[1:] = ~same
    for p, i in by_part(part_of(key, n), n):
        alone, shared = i[~many[i]], i[many[i] & first[i]]
        if len(alone):
            yield p, SINGLE, H.sorted_planes(key[alone]), H.planes(doc[alone]), b"" if aux is None else H.planes(aux[alone])
        if len(shared):
            yield p, SHARED, H.sorted_planes(key[shared]), b"", b""
    twice = np.flatnonzero(many)
    yield from direct(doc[twice], (key if aux is None else aux)[twice], n)


def direct(doc: np.ndarray, aux: np.ndarray, n: int) -> Iterator[tuple]:
    """Rows that go to their documents' bucket as they are."""
    for p, i in by_part(bucket_of(doc, n), n):
        yield p, DIRECT, H.planes(doc[i]), H.planes(aux[i]), b""


def answer(n: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Reducer of a part: passes on what is addressed to documents, and sends the entries of
    keys that came more than once to their documents."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        keys, docs, aux = [], [], []
        shared = [np.zeros(0, np.uint64)]
        for kind, a, b, c in zip(pdf["kind"], pdf["a"], pdf["b"], pdf["c"]):
            if kind == SINGLE:
                k = H.unsorted_planes(a)
                keys.append(k)
                docs.append(H.unplanes(b, np.int64))
                aux.append(H.unplanes(c) if c else k)
            elif kind == SHARED:
                shared.append(H.unsorted_planes(a))
            else:
                out.append((int(pdf["part"].iloc[0]), kind, a, b, c))
        if keys:
            k, d, x = np.concatenate(keys), np.concatenate(docs), np.concatenate(aux)
            every = np.sort(np.concatenate([k, *shared]))
            twice = np.unique(every[1:][every[1:] == every[:-1]])
            if len(twice):
                at = np.searchsorted(twice, k)
                hit = twice[np.minimum(at, len(twice) - 1)] == k
                out += direct(d[hit], x[hit], n)
        return pd.DataFrame(out, columns=["part", "kind", "a", "b", "c"])

    return f


def exchange(sent: DataFrame, n: int) -> DataFrame:
    """Rows of SCHEMA by document bucket: DIRECT (documents, aux) and HEADER rows."""
    return sent.groupBy("part").applyInPandas(answer(n), SCHEMA)


def gathered(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All (document, aux) entries of a bucket, sorted by document."""
    rows = pdf[pdf["kind"] == DIRECT]
    doc = np.concatenate([np.zeros(0, np.int64), *(H.unplanes(b, np.int64) for b in rows["a"])])
    aux = np.concatenate([np.zeros(0, np.uint64), *(H.unplanes(b) for b in rows["b"])])
    order = np.lexsort((aux, doc))
    return doc[order], aux[order]
