"""N-gram Jaccard join by vertical partitioning.

Every document is the set of its distinct 5-word shingles. Two documents link when
100 * |A and B| >= 75 * |A or B|. The join finds every such link between different sets
and labels each document with the smallest id that links reach.

1. Shingles that one document alone holds cannot count towards an overlap. One exchange
   of sorted runs finds the others; a document with fewer than three quarters of its set
   shared links with nothing and leaves.
2. Documents with equal sets form a class; its smallest id stands for it.
3. The global n-gram order is frequency band, then hash. A pair that links has a common
   n-gram in both prefixes, and at the first such n-gram both have enough n-grams left to
   reach the overlap that their sizes ask for; other meetings are no candidates. In each
   n-gram's group every member is paired first with the member that has the fewest n-grams
   of its own, which is nearest to what the group was copied from; after these links are
   contracted, only members outside a group's largest component are paired with other
   components' members. So a group of copies costs its size, not its square.
4. The order is cut into fragments. Partial overlaps of a candidate pair are counted in
   each fragment separately and summed per pair; the sum decides.
5. A document's links all lie in its component, so they are counted there, exactly: a
   component's sets are dealt into blocks, and each two blocks are compared as a whole. This
   is the square of a component's distinct sets, in as many tasks as it has pairs of blocks.

Defined cases: null or wordless text: empty set, no link, its own component. Fewer than
five words: the whole sequence is the one shingle. A null id: the row is left out. Rows
that repeat an id: the smallest text stays. Empty table: empty result. Columns besides
the named two are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import exchange as X
from quillspark.llm import hashing as H
from quillspark.llm import scratch
from quillspark.llm.components import components

FRAGMENTS = 8
#: Sets in a block, their n-grams on average, and n-grams that are compared at once.
BLOCK, BLOCK_GRAMS, GRAMS = 512, 1 << 19, 4096
SET_SCHEMA = "doc_id long, n_shingles long, d1 long, d2 long, hs array<long>"


def _sender(n: int, width: int):
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, docs in X.runs(batches, "doc_id", "text"):
            h, d = H.shingles([x.lower() for x in docs], width)
            order = np.lexsort((h, d))
            h, d = h[order], d[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            h, d = h[new], d[new]
            size = np.bincount(d, minlength=len(ids)).astype(np.uint64)
            digest = []
            for salt in (0x51, 0xA7):
                s = np.zeros(len(ids), np.uint64)
                np.add.at(s, d, H.mix(h + np.uint64(salt)))
                digest.append(s)
            out = list(X.send(h, ids[d], None, n))
            head = np.stack([size, *digest])
            for p, i in X.by_part(X.bucket_of(ids, n), n):
                out.append((p, X.HEADER, H.planes(ids[i]), H.planes(head[:, i].reshape(-1)), b""))
            yield pd.DataFrame(out, columns=["part", "kind", "a", "b", "c"])

    return f


def _assemble(least: int):
    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        doc, h = X.gathered(pdf)
        rows = pdf[pdf["kind"] == X.HEADER]
        out = []
        for a, b in zip(rows["a"], rows["b"]):
            ids, head = H.unplanes(a, np.int64), H.unplanes(b).reshape(3, -1)
            lo, hi = np.searchsorted(doc, ids), np.searchsorted(doc, ids, side="right")
            for i, n, d1, d2, x, y in zip(ids.tolist(), head[0].tolist(), head[1].view(np.int64).tolist(), head[2].view(np.int64).tolist(), lo, hi):
                out.append((i, n, d1, d2, h[x:y].view(np.int64) if n and 100 * (y - x) >= least * n else None))
        return pd.DataFrame(out, columns=["doc_id", "n_shingles", "d1", "d2", "hs"])

    return f


def shingle_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, hs), staged: set size, set digest, and the shared shingles
    of documents that can link (else null)."""
    spark = docs.sparkSession
    scratch.small_batches(spark)
    n = 2 * scratch.parts(spark, docs)
    d = scratch.one_row_per_id(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), "doc_id")
    sent = d.mapInPandas(_sender(n, width), X.SCHEMA)
    return scratch.stage_through(X.exchange(sent, n), "answers", lambda x: x.groupBy("part").applyInPandas(_assemble(percent), SET_SCHEMA), "sets")


def _segments(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rep, frag, n, hs): each set's n-grams that another set holds, by fragment of the
    global order; and (h, rep, n, left, own): the prefixes, with the number of n-grams from
    there on and of those that no other set holds."""
    each = sets.select("rep", "n", F.explode("hs").alias("h"))
    df = scratch.stage(each.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"), "frequencies")
    # the order: frequency band, then the hash as a fraction of its range
    unit = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    each = each.join(df, "h").select("rep", "n", F.struct((F.floor(F.log2("df")) + unit).alias("o"), "h").alias("x"))
    # each set's n-grams cross once, into one list in order; fragments and prefixes are slices of it
    whole = scratch.stage(each.groupBy("rep").agg(F.first("n").alias("n"), F.array_sort(F.collect_list("x")).alias("l")), "ranked")
    share = [i / FRAGMENTS for i in range(1, FRAGMENTS)]
    cuts = whole.select(F.explode("l.o").alias("o")).agg(F.percentile_approx("o", share, 1000).alias("c")).first()[0] or []
    ends = [F.lit(0), *(F.expr(f"size(filter(l.o, o -> o <= {float(c)!r}D))") for c in cuts), F.size("l")]
    segs = whole.select("rep", "n", F.col("l.h").alias("h"), F.array(*ends).alias("at"))
    cut = [F.struct(F.lit(i).alias("frag"), F.slice("h", F.col("at")[i] + 1, F.col("at")[i + 1] - F.col("at")[i]).alias("hs")) for i in range(len(cuts) + 1)]
    segs = segs.select("rep", "n", F.explode(F.array(*cut)).alias("x")).select("rep", "x.frag", "n", "x.hs").filter(F.size("hs") > 0)
    # n-grams of one set alone come first in the order and take up places of the prefix
    need = F.ceil(F.col("n") * F.lit(percent) / 100)
    take = (F.size("l") - need + 1).cast("int")
    prefix = whole.filter(take > 0).select("rep", "n", F.size("l").alias("s"), F.posexplode(F.slice("l", F.lit(1), take)).alias("at", "x"))
    prefix = prefix.select("x.h", "rep", "n", (F.col("s") - F.col("at")).cast("long").alias("left"), (F.col("n") - F.col("s")).alias("own"))
    return scratch.stage(segs, "segments"), scratch.stage(prefix, "prefix")


def _links(pairs: DataFrame, segs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose partial overlaps, counted by fragment and summed, reach the bound."""
    left = segs.select(F.col("rep").alias("a"), "frag", F.col("n").alias("na"), F.col("hs").alias("ha"))
    right = segs.select(F.col("rep").alias("b"), "frag", F.col("n").alias("nb"), F.col("hs").alias("hb"))
    part = pairs.join(left, "a").join(right, ["b", "frag"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).alias("k"))
    total = part.groupBy("a", "b", "na", "nb").agg(F.sum("k").alias("k"))
    return total.filter(F.expr(f"(100 + {percent}) * k >= {percent} * (na + nb)")).select("a", "b")


def _degrees(percent: int):
    def count(rep: np.ndarray, n: np.ndarray, size: np.ndarray, block: np.ndarray, hs: list) -> Iterator[tuple[int, int]]:
        h = np.concatenate(hs)
        row = np.repeat(np.arange(len(hs)), [len(x) for x in hs])
        _, name, df = np.unique(h, return_inverse=True, return_counts=True)
        row, name = row[df[name] > 1], (np.cumsum(df > 1) - 1)[name[df[name] > 1]]
        order = np.argsort(name, kind="stable")
        row, name = row[order], name[order]
        x, y = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        common = np.zeros((len(x), len(y)), np.float32)  # whole numbers under 2 ** 24
        for lo in range(0, int(name[-1]) + 1 if len(name) else 0, GRAMS):
            a, b = np.searchsorted(name, [lo, lo + GRAMS])
            has = np.zeros((len(hs), int(name[b - 1]) - lo + 1), np.float32)
            has[row[a:b], name[a:b] - lo] = 1
            common += has[x] @ has[y].T
        link = (100 + percent) * common.astype(np.int64) >= percent * (n[x, None] + n[y])
        link &= rep[x, None] != rep[y]
        yield from zip(rep[x].tolist(), (link @ size[y]).tolist())
        if block.min() != block.max():
            yield from zip(rep[y].tolist(), (size[x] @ link).tolist())

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, c in pdf.groupby("component", sort=False):
            if c["x"].iloc[0] == c["y"].iloc[0] or c["block"].nunique() == 2:  # else one of the two is empty
                out += count(*(c[k].to_numpy() for k in ("rep", "n", "size", "block")), c["hs"].tolist())
        return pd.DataFrame(out, columns=["rep", "n_links"])

    return f


def link_counts(member: DataFrame, reps: DataFrame, comp: DataFrame, percent: int = 75) -> DataFrame:
    """(rep, n_links): for each class, the documents of other classes that link with it."""
    n = 8 * scratch.parts(reps.sparkSession)
    every = comp.select(F.col("node").alias("rep"), "component")
    reps = scratch.stage(reps.join(every, "rep").join(member.groupBy("rep").agg(F.count("*").alias("size")), "rep"), "linked")
    wanted = F.greatest(F.count("*") / BLOCK, F.sum(F.size("hs")) / BLOCK_GRAMS)
    many = scratch.stage(reps.groupBy("component").agg(F.ceil(wanted).cast("int").alias("blocks")), "blocks")
    each = reps.join(many, "component")
    each = each.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # components of one block share groups; others have one for each two blocks
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
    each = each.withColumn("many", F.col("blocks") > 1).withColumn("g", F.when(F.col("many"), F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(n))))
    counted = each.groupBy("many", "g", "x", "y").applyInPandas(_degrees(percent), "rep long, n_links long")
    return counted.groupBy("rep").agg(F.sum("n_links").alias("n_links"))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75, count_links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, n_links): class_id is the smallest id
    with an equal set; n_links counts the other documents that the document links with,
    those with an equal set too. Without ``count_links`` that column is left out."""
    all_sets = shingle_sets(docs, key, text, width, percent)
    sets = all_sets.filter("hs is not null")
    # what is joined to rows is written first: Spark splits a frequent key only where no aggregate
    # stands between the exchange and the join
    classes = scratch.stage(sets.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    member = sets.select("doc_id", "d1", "d2", "n_shingles").join(classes, ["d1", "d2", "n_shingles"]).select("doc_id", "rep")
    member = scratch.stage(member, "classes")
    reps = member.filter("doc_id = rep").select("rep").join(sets.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "hs"), "rep")
    # read three times; joined anew each time, all sets would cross each time
    reps = scratch.stage(reps, "reps")
    segs, prefix = _segments(reps, percent)

    def able(a: str, b: str):
        """Whether a meeting can be a linking pair's first."""
        return F.expr(f"(100 + {percent}) * least(l{a}, l{b}) >= {percent} * (n{a} + n{b})")

    def side(x: str) -> list:
        return [F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("left").alias(f"l{x}")]

    pivot = prefix.groupBy("h").agg(F.min(F.struct((F.col("own") / F.col("n")).alias("share"), "rep", "n", "left")).alias("p"), F.count("*").alias("m"))
    pivot = scratch.stage(pivot.filter("m > 1").select("h", "p.*").select("h", *side("b")), "pivots")
    met = prefix.select("h", *side("a")).join(pivot, "h").filter("a <> b").filter(able("a", "b"))
    pairs = met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = scratch.stage(_links(pairs, segs, percent), "links")
    comp = components(links, "a", "b")
    # the rest: groups that still hold more than one component
    named = prefix.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = scratch.stage(named, "named")
    by = named.groupBy("h", "component").agg(F.count("*").alias("m"))
    big = by.groupBy("h").agg(F.max_by("component", F.struct("m", "component")).alias("big"), F.count("*").alias("c")).filter("c > 1").select("h", "big")
    open_ = scratch.stage(named.join(scratch.stage(big, "largest"), "h"), "open")
    # sizes of sets that link differ by a quarter at most, so they lie in the same band or the next
    band = F.floor(F.log(F.col("n")) / F.lit(math.log(100 / percent) * (1 + 1e-9))).cast("int")
    left = open_.filter("component <> big").select("h", "big", *side("a"), F.col("component").alias("ca"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    inner = open_.select("h", *side("b"), F.col("component").alias("cb"), F.col("big").alias("bb"), band.alias("band"))
    # a is outside the largest component; of two such each pair is taken once
    met = left.join(inner, ["h", "band"]).filter("ca <> cb and (cb = bb or a < b)").filter(able("a", "b"))
    more = met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    links2 = scratch.stage(_links(more, segs, percent), "links")
    every = links.unionByName(links2)
    if not links2.isEmpty():
        comp = components(every, "a", "b")
    label = member.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component"))
    out = all_sets.select("doc_id", "n_shingles").join(label, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))
    if not count_links:
        return out
    same = member.groupBy("rep").agg((F.count("*") - 1).alias("same"))
    degree = same.join(link_counts(member, reps, comp, percent), "rep", "left")
    degree = degree.select(F.col("rep").alias("class_id"), (F.col("same") + F.coalesce("n_links", F.lit(0))).alias("n_links"))
    degree = scratch.stage(degree, "degrees")
    return out.join(degree, "class_id", "left").select(*out.columns, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(scratch.table(spark, sf_dir, "documents"))
