"""Exact substring removal with front-coded sorted suffix runs and loser-tree merges.

A byte goes if a ``WIDTH``-byte string that covers it also starts anywhere else in the input.

Not every suffix has to be sorted. In each window of WIDTH bytes the least ``GRAM``-byte hash
(the leftmost of equals) marks an anchor, so equal windows have equal anchors at equal places.
The windows that share an anchor form a stretch. What is sorted is the suffix at the anchor,
cut at the last window's end, then the bytes of the stretch before the anchor. Then:

1. Anchors whose gram comes once cannot lie in a repeated window; one exchange of sorted
   hash runs leaves the others as candidates.
2. Candidate stretches are sorted in each input run, front-coded (length of the prefix
   shared with the one before, and the rest), and exchanged. A loser tree that keeps common
   prefixes merges a part's runs; an item equal to its neighbour is a repeat as a whole.
   An item that comes twice in a run is known to repeat there, and crosses once a run.
3. What is left are stretches at the edges of repeats. Blocks of windows whose common core
   comes once leave by one more exchange of hashes; the single windows of the others are
   sorted, front-coded and merged in the same way, each named by its gram and window hash
   (128 bits): windows whole would need more than the allowed disk (README).

A text held by a third of all rows so crosses an exchange once a run and never meets in one
task by row. A document's answers come back to its own bucket.

Defined cases: null text is empty; texts under WIDTH bytes lose nothing. A null id: the row
is left out. Rows that repeat an id: the smallest text stays. Empty table: empty result.
Other input columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import exchange as X
from quillspark.llm import hashing as H
from quillspark.llm import scratch
from quillspark.llm.merging import front_code, lcp_merge

WIDTH, GRAM = 200, 64
#: Windows of a block; blocks of a stretch at most; numbers of blocks in a run's document at most.
BLOCK, BLOCKS, NUMBERS = 12, 16, 1 << 40
#: Bytes of text in a run of suffixes, and in one of gram hashes, which take less memory.
RUN_BYTES, GRAM_RUN_BYTES = 3 << 19, 8 << 20
#: Windows whose hashes are held at once, and items of a run that are packed together.
PLACES, PACK = 1 << 17, 4096


def stretches(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor, gram hash, document) of the anchors of joined
    documents; ``ends``: where each document ends in ``buf``. Hashes of ``PLACES`` windows are
    held at once; they do not depend on where a piece of ``buf`` begins."""
    n = len(buf) - WIDTH + 1
    span = WIDTH - GRAM + 1
    begins, anchors, names, insides = [], [], [], []
    last, was = -1, True
    for a in range(0, max(n, 0), PLACES):
        m = min(PLACES, n - a)
        grams = H.windows(H.prefix_sums(buf[a : a + m + WIDTH - 1]), GRAM)
        key = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
        # least key of each span of grams: prefix and suffix minima of blocks
        rows = -(-len(key) // span)
        pad = np.full(rows * span, np.iinfo(np.uint64).max, np.uint64)
        pad[: len(key)] = key
        block = pad.reshape(rows, span)
        ahead = np.minimum.accumulate(block, axis=1).reshape(-1)
        behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        place = (np.minimum(behind[:m], ahead[span - 1 : span - 1 + m]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # windows that stay in their document
        inside = np.ones(m, bool)
        for e in ends[np.searchsorted(ends, a, side="right") : np.searchsorted(ends, a + m + WIDTH)].tolist():
            inside[max(0, e - WIDTH + 1 - a) : max(0, min(e - a, m))] = False
        new = np.ones(m, bool)
        new[1:] = (place[1:] != place[:-1]) | (inside[1:] != inside[:-1])
        new[0] = place[0] + a != last or bool(inside[0]) != was
        at = np.flatnonzero(new)
        begins.append(at + a)
        anchors.append(place[at] + a)
        names.append(grams[place[at]])
        insides.append(inside[at])
        last, was = int(place[-1]) + a, bool(inside[-1])
    none = np.zeros(0, np.int64)
    lo = np.concatenate([none, *begins])
    keep = np.concatenate([none.astype(bool), *insides])
    hi = np.append(lo[1:], max(n, 0)) - 1 if len(lo) else lo
    lo, hi = lo[keep], hi[keep]
    return lo, hi, np.concatenate([none, *anchors])[keep], np.concatenate([none.astype(np.uint64), *names])[keep], np.searchsorted(ends, lo, side="right")


def _joined(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(docs), np.uint8), np.cumsum([len(d) for d in docs])


def _number(doc: np.ndarray) -> np.ndarray:
    """Position of each stretch among its document's."""
    first = np.searchsorted(doc, doc)
    return np.arange(len(doc)) - first


def _grams(n: int):
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, docs in X.runs(batches, "doc_id", "text", GRAM_RUN_BYTES):
            _, _, _, gram, doc = stretches(*_joined(docs))
            yield pd.DataFrame(list(X.send(gram, ids[doc], _number(doc).astype(np.uint64), n)), columns=["part", "kind", "a", "b", "c"])

    return f


def _per_document(pdf: pd.DataFrame) -> pd.DataFrame:
    doc, aux = X.gathered(pdf)
    ids, first = np.unique(doc, return_index=True)
    return pd.DataFrame({"doc_id": ids, "hits": [H.planes(a) for a in np.split(aux, first[1:])] if len(ids) else []})


def _answers(sent: DataFrame) -> DataFrame:
    return sent.groupBy("part").applyInPandas(_per_document, "doc_id long, hits binary")


def _packed(lcps: np.ndarray, sizes: np.ndarray, rests: bytes, doc: np.ndarray, aux: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """A run in blocks of ``PACK`` items, each packed by itself, so that a merge holds one block
    of each run: (blocks, references of the blocks, lengths of both)."""
    ends = np.append(0, np.cumsum(sizes, dtype=np.int64))
    items, refs, size = [], [], []
    for i in range(0, len(doc), PACK):
        j = min(i + PACK, len(doc))
        a = lcps[i:j].astype("<u2").tobytes() + sizes[i:j].astype("<u2").tobytes() + rests[ends[i] : ends[j]]
        items.append(zlib.compress(a, 1))
        refs.append(zlib.compress(H.planes(doc[i:j]) + H.planes(aux[i:j]), 1))
        size += [j - i, len(items[-1]), len(refs[-1])]
    return b"".join(items), b"".join(refs), np.array(size, "<u4").tobytes()


def _pack_run(items: list[bytes], docs: list[int], aux: list[int]) -> tuple[bytes, bytes, bytes]:
    lcps, rests = front_code(items)
    return _packed(np.array(lcps, "<u2"), np.array([len(r) for r in rests], "<u2"), b"".join(rests), np.array(docs, np.int64), np.array(aux, np.uint64))


def _unpack_run(items: bytes, refs: bytes, sizes: bytes) -> Iterator[tuple[int, bytes, object]]:
    """(shared prefix, rest, (document, aux)) of a run, a block at a time."""
    x = y = 0
    for m, n, k in np.frombuffer(sizes, "<u4").reshape(-1, 3).tolist():
        a, r = zlib.decompress(items[x : x + n]), zlib.decompress(refs[y : y + k])
        x, y = x + n, y + k
        lcps = np.frombuffer(a, "<u2", m).tolist()
        ends = (np.cumsum(np.frombuffer(a, "<u2", m, 2 * m), dtype=np.int64) + 4 * m).tolist()
        docs, aux = H.unplanes(r[: 8 * m], np.int64).tolist(), H.unplanes(r[8 * m :]).tolist()
        at = 4 * m
        for i in range(m):
            yield lcps[i], a[at : ends[i]], (docs[i], aux[i])
            at = ends[i]


#: On an entry that crosses for several of its run, which are answered already; on an
#: answer: the stretch's single windows are to be looked at too.
SEVERAL = EXPAND = 1 << 62


def _send_runs(items: list[bytes], part: np.ndarray, doc: np.ndarray, aux: np.ndarray, n: int) -> Iterator[tuple]:
    """Rows of X.SCHEMA: a front-coded sorted run for each part, and the entries of items
    that come twice in this run, for their documents."""
    twice: list[int] = []
    for p, at in X.by_part(part, n):
        order = sorted(at.tolist(), key=items.__getitem__)
        run, docs, refs = [], [], []
        k = 0
        while k < len(order):
            j = k + 1
            x = items[order[k]]
            while j < len(order) and items[order[j]] == x:
                j += 1
            run.append(x)
            if j - k > 1:
                twice += order[k:j]
            docs.append(int(doc[order[k]]))
            refs.append(int(aux[order[k]]) | (SEVERAL if j - k > 1 else 0))
            k = j
        yield (p, X.SINGLE, *_pack_run(run, docs, refs))
    i = np.array(twice, np.int64)
    yield from X.direct(doc[i], aux[i], n)


def _merge(n: int, expand: bool = True):
    """Reducer of a part: the entries of items that come twice. ``expand``: items of a gram
    that has both such items and single ones are marked, one entry each."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        runs, out = [], []
        part = int(pdf["part"].iloc[0])
        for kind, a, b, c in zip(pdf["kind"], pdf["a"], pdf["b"], pdf["c"]):
            if kind == X.SINGLE:
                runs.append(_unpack_run(a, b, c))
            else:
                out.append((part, kind, a, b, c))
        found: list[tuple[int, int]] = []
        held: list[tuple[int, int]] = []  # entries of the item at hand
        repeated: list[tuple[int, int]] = []  # one entry of each repeated item of the gram at hand
        single, size = False, -1

        def close() -> bool:
            """End of an item; whether it came once."""
            if len(held) == 1 and not held[0][1] & SEVERAL:
                return True
            found.extend(x for x in held if not x[1] & SEVERAL)
            repeated.extend(held[:1])
            return False

        for lcp, item, ref in lcp_merge(runs):
            if lcp == size == len(item):
                held.append(ref)
                continue
            single |= close()
            if lcp < GRAM:  # another gram
                found += [(d, x | EXPAND) for d, x in repeated] if single and expand else []
                repeated, single = [], False
            size, held = len(item), [ref]
        if (close() and repeated or single) and expand:
            found += [(d, x | EXPAND) for d, x in repeated]
        docs, aux = [d for d, _ in found], [x for _, x in found]
        out += X.direct(np.array(docs, np.int64), np.array(aux, np.uint64), n)
        return pd.DataFrame(out, columns=["part", "kind", "a", "b", "c"])

    return f


def _candidates(docs: list[bytes], hits: list[bytes]) -> tuple:
    """Stretches of a run's documents that ``hits`` name."""
    buf, ends = _joined(docs)
    lo, hi, anchor, gram, doc = stretches(buf, ends)
    number = _number(doc)
    first = np.searchsorted(doc, np.arange(len(docs)))
    named = [first[k] + H.unplanes(h).astype(np.int64) for k, h in enumerate(hits) if h]
    at = np.concatenate([np.zeros(0, np.int64), *named])
    return buf, ends, lo, hi, anchor, gram, doc, number, at


def _batches(batches: Iterator[pd.DataFrame], *more: str) -> Iterator[tuple]:
    """Runs of (ids, texts, further columns)."""
    ids, docs, rest, size = [], [], [[] for _ in more], 0
    for pdf in batches:
        for row in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), *(pdf[c].tolist() for c in more)):
            ids.append(row[0])
            docs.append(bytes(row[1]))
            for k, x in enumerate(row[2:]):
                rest[k].append(x)
            size += len(docs[-1])
            if size >= RUN_BYTES:
                yield (np.array(ids, np.int64), docs, *rest)
                ids, docs, rest, size = [], [], [[] for _ in more], 0
    if ids:
        yield (np.array(ids, np.int64), docs, *rest)


def _suffixes(n: int):
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, docs, hits in _batches(batches, "hits"):
            buf, _, lo, hi, anchor, gram, doc, number, at = _candidates(docs, hits)
            whole = buf.tobytes()
            # the suffix at the anchor, then what stands before it reversed, then where they part
            items = [whole[c : b + WIDTH] + whole[a:c][::-1] + (b - c).to_bytes(2, "big", signed=True) for a, b, c in zip(lo[at].tolist(), hi[at].tolist(), anchor[at].tolist())]
            rows = _send_runs(items, X.part_of(gram[at], n), ids[doc[at]], number[at].astype(np.uint64), n)
            yield pd.DataFrame(list(rows), columns=["part", "kind", "a", "b", "c"])

    return f


def _edge_units(docs: list[bytes], hits: list, done: list) -> tuple:
    """Stretches whose single windows are to be looked at."""
    buf, ends, lo, hi, anchor, gram, doc, number, at = _candidates(docs, hits)
    first = np.searchsorted(doc, np.arange(len(docs)))
    told = [(k, H.unplanes(h).astype(np.int64)) for k, h in enumerate(done) if h]
    none = np.zeros(0, np.int64)
    over = np.concatenate([none, *(first[k] + x[x < EXPAND] for k, x in told)])
    look = np.concatenate([none, *(first[k] + (x[x >= EXPAND] & (EXPAND - 1)) for k, x in told)])
    at = np.union1d(np.setdiff1d(at, over), look)
    begin = ends - np.array([len(x) for x in docs], np.int64) if docs else ends
    return lo[at], hi[at], anchor[at], gram[at], doc[at], number[at], buf, begin


def _blocks(lo: np.ndarray, hi: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit, block) of every block of windows: BLOCK windows with like distance to the anchor."""
    least, most = (anchor - hi) // BLOCK, (anchor - lo) // BLOCK
    size = most - least + 1
    unit = np.repeat(np.arange(len(lo)), size)
    return unit, np.arange(len(unit)) - np.repeat(np.cumsum(size) - size - least, size)


def _cores(n: int):
    """Hashes of what all windows of a block have in common."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, docs, hits, done in _batches(batches, "hits", "done"):
            lo, hi, anchor, gram, doc, number, buf, _ = _edge_units(docs, hits, done)
            s = H.prefix_sums(buf)
            unit, block = _blocks(lo, hi, anchor)
            start = anchor[unit] - block * BLOCK
            core = H.ranges(s, start, start + WIDTH - BLOCK + 1)
            key = H.mix(core ^ H.mix(gram[unit] + block.astype(np.uint64)))
            rows = X.send(key, ids[doc[unit]], (number[unit] * BLOCKS + block).astype(np.uint64), n)
            yield pd.DataFrame(list(rows), columns=["part", "kind", "a", "b", "c"])

    return f


def _edges(n: int):
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, docs, hits, done, cores in _batches(batches, "hits", "done", "cores"):
            lo, hi, anchor, gram, doc, number, buf, begin = _edge_units(docs, hits, done)
            unit, block = _blocks(lo, hi, anchor)
            none = np.zeros(0, np.int64)
            known = [k * NUMBERS + H.unplanes(h).astype(np.int64) for k, h in enumerate(cores) if h]
            keep = np.isin(doc[unit] * NUMBERS + number[unit] * BLOCKS + block, np.concatenate([none, *known]))
            unit, block = unit[keep], block[keep]
            last = np.minimum(hi[unit], anchor[unit] - block * BLOCK)
            low = np.maximum(lo[unit], anchor[unit] - block * BLOCK - BLOCK + 1)
            size = last - low + 1
            start = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
            g, d = np.repeat(gram[unit], size), np.repeat(doc[unit], size)
            w = H.ranges(H.prefix_sums(buf), start, start + WIDTH)
            rows = _send_names(g, w, ids[d], (start - begin[d]).astype(np.uint64), n)
            yield pd.DataFrame(list(rows), columns=["part", "kind", "a", "b", "c"])

    return f


def _send_names(g: np.ndarray, w: np.ndarray, doc: np.ndarray, aux: np.ndarray, n: int) -> Iterator[tuple]:
    """As ``_send_runs`` for the 16-byte names (g, w), in array operations."""
    twice = []
    for p, at in X.by_part(X.part_of(w, n), n):
        at = at[np.lexsort((w[at], g[at]))]
        same = (g[at][1:] == g[at][:-1]) & (w[at][1:] == w[at][:-1])
        many = np.zeros(len(at), bool)
        many[1:] |= same
        many[:-1] |= same
        first = np.ones(len(at), bool)
        first[1:] = ~same
        twice.append(at[many])
        sent, several = at[first], many[first]
        name = np.stack([g[sent], w[sent]], axis=1).astype(">u8").view(np.uint8).reshape(-1, 16)
        lcp = np.zeros(len(sent), "<u2")
        lcp[1:] = (name[1:] != name[:-1]).argmax(axis=1)
        rests = name[np.arange(16) >= lcp[:, None]].tobytes()
        refs = aux[sent] | np.where(several, np.uint64(SEVERAL), np.uint64(0))
        yield (p, X.SINGLE, *_packed(lcp, (16 - lcp).astype("<u2"), rests, doc[sent], refs))
    i = np.concatenate([np.zeros(0, np.int64), *twice])
    yield from X.direct(doc[i], aux[i], n)


def _removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spans to remove from each candidate document: repeated stretches and windows, united."""
    for ids, docs, done, windows in _batches(batches, "done", "windows"):
        buf, ends = _joined(docs)
        lo, hi, _, _, doc = stretches(buf, ends)
        first = np.searchsorted(doc, np.arange(len(docs)))
        out = []
        for k, (i, t, a, b) in enumerate(zip(ids.tolist(), docs, done, windows)):
            base = int(ends[k]) - len(t)
            at = first[k] + (H.unplanes(a).astype(np.int64) & (EXPAND - 1)) if a else np.zeros(0, np.int64)
            one = H.unplanes(b).astype(np.int64) if b else np.zeros(0, np.int64)
            start = np.concatenate([lo[at] - base, one])
            end = np.concatenate([hi[at] - base, one]) + WIDTH
            out.append((i, len(t), *apply_spans(t, unite(start, end))))
        yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "spans", "n_removed", "kept"])


def unite(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs that the spans cover; spans that touch are one run."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    cut = np.flatnonzero(start[1:] > end[:-1]) + 1
    return list(zip(start[np.concatenate([[0], cut])].tolist(), end[np.concatenate([cut - 1, [len(end) - 1]])].tolist()))


def apply_spans(text: bytes, spans: list[tuple[int, int]]) -> tuple[list[list[int]], int, bytes]:
    kept, at, gone = [], 0, 0
    for a, b in spans:
        kept.append(text[at:a])
        gone += b - a
        at = b
    kept.append(text[at:])
    return [list(x) for x in spans], gone, b"".join(kept)


RESULT = "doc_id long, n_bytes long, spans array<array<long>>, n_removed long, kept binary"


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, n_removed, kept): what is removed and the bytes that stay."""
    spark = docs.sparkSession
    scratch.small_batches(spark)
    n = scratch.parts(spark, docs)
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    d = scratch.one_row_per_id(d, "doc_id").withColumn("text", F.col("text").cast("binary"))
    hits = scratch.stage(_answers(X.exchange(d.mapInPandas(_grams(n), X.SCHEMA), n)), "hits")
    # the one shuffle of the texts: all that follows is joined to its buckets
    every = d.repartition(n, "doc_id").join(hits.repartition(n, "doc_id"), "doc_id", "left")
    every = scratch.stage_bucketed(every, "candidates", "doc_id", n)
    some = every.filter("hits is not null")
    sent = some.mapInPandas(_suffixes(n), X.SCHEMA)
    done = scratch.stage(_answers(sent.groupBy("part").applyInPandas(_merge(n), X.SCHEMA)).withColumnRenamed("hits", "done"), "stretches")
    some = some.join(done, "doc_id", "left")
    cores = scratch.stage(_answers(X.exchange(some.mapInPandas(_cores(n), X.SCHEMA), n)).withColumnRenamed("hits", "cores"), "cores")
    sent = some.join(cores, "doc_id").mapInPandas(_edges(n), X.SCHEMA)
    windows = scratch.stage(_answers(sent.groupBy("part").applyInPandas(_merge(n, False), X.SCHEMA)).withColumnRenamed("hits", "windows"), "windows")
    out = some.join(windows, "doc_id", "left").select("doc_id", "text", "done", "windows").mapInPandas(_removed, RESULT)
    rest = every.filter("hits is null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
                                               F.array().cast("array<array<long>>").alias("spans"), F.lit(0).cast("long").alias("n_removed"), F.col("text").alias("kept"))
    return out.unionByName(rest)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(scratch.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
