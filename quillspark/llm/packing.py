"""Packing by Karmarkar-Karp multiway differencing.

Documents become token ids and an end id, cut into pieces of at most ``PIECE`` ids. Pieces
are dealt to groups by a hash of document id and start, so neither a long document nor a hot
source fills one group; the number of groups follows from the bytes of all texts, and a
group is packed in runs of at most ``GROUP`` pieces, whatever that estimate was. In a run, partial partitions into k windows
with the largest imbalances are merged, largest sums against smallest, until one partition
into k near-equal windows is left; k starts at the least count that can hold the tokens and
rises whenever a window exceeds the capacity.

Defined cases: null or empty text: one piece with the end id alone. A null id: the row is
left out. Rows that repeat an id: the smallest text stays. Empty table: empty result. Other
input columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import scratch
from quillspark.llm.tokens import encoder, groups

CAPACITY, END_ID = 4096, 2
#: Longest piece; pieces that are packed together at most.
PIECE, GROUP = 1024, 1024
#: Bytes of text that a token has at the least on average, for the number of groups alone.
BYTES_A_TOKEN = 3
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def difference(sizes: Sequence[int], k: int) -> list[list[int]]:
    """Indices of ``sizes`` in k windows of near-equal sums, by multiway differencing.

    A partial partition is its non-empty windows by falling sum; the windows it lacks are
    empty. Merging joins largest sums with smallest, so imbalances cancel.
    """
    if not len(sizes):
        return [[] for _ in range(k)]
    heap = []
    for i, s in enumerate(sizes):
        heap.append((-(s if k > 1 else 0), i, [s], [[i]]))
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, sa, wa = heapq.heappop(heap)
        _, _, sb, wb = heapq.heappop(heap)
        if len(sa) < len(sb):
            sa, wa, sb, wb = sb, wb, sa, wa
        over = len(sa) + len(sb) - k
        if len(sb) == 1 and over > 0:  # one piece joins the smallest window
            sums, wins = sa, wa
            s, w = sums.pop() + sb[0], wins.pop() + wb[0]
            at = len(sums)
            lo = 0
            while lo < at:
                mid = (lo + at) // 2
                if sums[mid] >= s:
                    lo = mid + 1
                else:
                    at = mid
            sums.insert(lo, s)
            wins.insert(lo, w)
        else:
            pairs = list(zip(sa, wa))
            rest = list(zip(sb, wb))
            if over > 0:  # the smallest of a join the largest of b
                tail = pairs[len(pairs) - over :]
                joined = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(reversed(tail), rest[:over])]
                pairs = pairs[: len(pairs) - over] + joined + rest[over:]
            else:
                pairs += rest
            pairs.sort(key=lambda x: -x[0])
            sums, wins = [x[0] for x in pairs], [x[1] for x in pairs]
        spread = sums[0] - (sums[-1] if len(sums) == k else 0)
        count += 1
        heapq.heappush(heap, (-spread, count, sums, wins))
    wins = heap[0][3]
    return wins + [[] for _ in range(k - len(wins))]


def windows(sizes: Sequence[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most ``capacity``; every size must fit one."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        out = difference(sizes, k)
        if max(sum(sizes[i] for i in w) for w in out) <= capacity:
            return [w for w in out if w]
        k += 1


def _cut(path: str, keep_space: bool, n_groups: int):
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, keep_space)
        end = np.array([END_ID], "<u4").tobytes()
        for pdf in batches:
            for ids, texts in groups(zip(pdf["doc_id"].tolist(), pdf["text"].tolist())):
                out = []
                for i, b in zip(ids, enc.encode(texts)):
                    b += end
                    n = len(b) // 4
                    # equal cuts: no piece is a mere remainder
                    m = -(-n // PIECE)
                    for j in range(m):
                        s, e = n * j // m, n * (j + 1) // m
                        g = zlib.crc32(b"%d:%d" % (i, s)) % n_groups
                        out.append((g, i, s, e - s, b[4 * s : 4 * e], n))
                yield pd.DataFrame(out, columns=["grp", "doc_id", "start", "length", "ids", "doc_tokens"])

    return f


def _pack(capacity: int):
    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        # runs of like numbers of pieces, dealt by hash: each holds long and short ones alike
        name = [zlib.crc32(b"%d,%d" % x) for x in zip(pdf["doc_id"].tolist(), pdf["start"].tolist())]
        pdf = pdf.assign(run=name).sort_values(["run", "doc_id", "start"], ignore_index=True)
        runs = -(-len(pdf) // GROUP)
        pdf["run"] = np.arange(len(pdf)) * runs // len(pdf)
        pdf = pdf.sort_values(["run", "length", "doc_id", "start"], ascending=[True, False, True, True], ignore_index=True)
        sizes = pdf["length"].tolist()
        seq, off = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        cut = np.searchsorted(pdf["run"], np.arange(runs + 1)).tolist()
        now = int(pdf["grp"].iloc[0]) << 32
        for a, b in zip(cut, cut[1:]):
            for w in windows(sizes[a:b], capacity):
                at = 0
                for i in w:
                    seq[a + i], off[a + i] = now, at
                    at += sizes[a + i]
                now += 1
        return pdf.assign(sequence_id=seq, offset=off)[["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]]

    return f


def pack(docs: DataFrame, path: str, keep_space: bool = False, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces with their ids and places: see SCHEMA."""
    spark = docs.sparkSession
    scratch.small_batches(spark)
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    d = scratch.one_row_per_id(d, "doc_id")
    size = d.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("b")).first()
    n_groups = max(1, -(-(size.n + size.b // (BYTES_A_TOKEN * PIECE)) // GROUP))
    pieces = d.mapInPandas(_cut(path, keep_space, n_groups), "grp long, doc_id long, start long, length long, ids binary, doc_tokens long")
    return pieces.groupBy("grp").applyInPandas(_pack(capacity), SCHEMA)


def word_pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    out = pack(scratch.table(spark, sf_dir, "documents"), word_pieces_path())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
