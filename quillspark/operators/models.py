"""Expert routing statistics and selection, tensor inventories, retention, kernels, artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.textops import planted_sql, with_planted
from quillspark.plans.tables import table


def topk(scores: Column, k: int) -> Column:
    """Indices of the k largest scores, ties to the lower index, ascending."""
    ranked = F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i"))))
    return F.array_sort(F.transform(F.slice(ranked, 1, k), lambda x: x["i"]))


def softmax_gates(scores: Column, selected: Column) -> Column:
    """Softmax over the selected experts' scores."""
    picked = F.transform(selected, lambda i: F.exp(F.get(scores, i)))
    return F.transform(picked, lambda p: p / F.aggregate(picked, F.lit(0.0), lambda a, x: a + x))


def coactivation(routing: DataFrame) -> DataFrame:
    """(layer, i, j, n): how often experts i and j of a layer serve one token, i = j included."""
    return routing.select("layer", F.explode("selected").alias("i"), "selected").select("layer", "i", F.explode("selected").alias("j")).groupBy("layer", "i", "j").agg(F.count("*").alias("n"))


def pair_statistics(routing: DataFrame) -> DataFrame:
    """(layer, i, j, n, s): tokens that experts i and j serve together, and the sum of the products
    of what each adds (gate times norm); ``routing`` has (layer, selected, added)."""
    each = routing.select("layer", F.arrays_zip("selected", "added").alias("x"))
    both = each.select("layer", F.explode("x").alias("a"), "x").select("layer", "a", F.explode("x").alias("b"))
    return both.groupBy("layer", F.col("a.selected").alias("i"), F.col("b.selected").alias("j")).agg(F.count("*").alias("n"), F.sum(F.col("a.added") * F.col("b.added")).alias("s"))


def conditional_f(pairs: DataFrame) -> DataFrame:
    """(layer, i, j, f): mean product of two experts over the tokens that both serve."""
    return pairs.select("layer", "i", "j", (F.col("s") / F.col("n")).alias("f"))


def exhaustive_select(matrix: DataFrame, experts: int, budget: int) -> DataFrame:
    """(layer, objective, pruned, ties): of all subsets of ``budget`` experts (at most 16 in all) the
    one whose entries of (layer, i, j, f) have the least sum, ties to the lexicographically
    smallest list. Absent entries are 0."""
    if experts > 16:
        raise ValueError("exhaustive selection takes at most 16 experts")
    spark = matrix.sparkSession
    masks = spark.range(1 << experts).filter(F.bit_count("id") == budget).select(F.col("id").alias("mask"))
    bits = masks.select("mask", F.explode(F.sequence(F.lit(0), F.lit(experts - 1))).alias("i")).filter("shiftright(mask, i) & 1 = 1")
    member = bits.groupBy("mask").agg(F.array_sort(F.collect_list("i")).alias("pruned"))
    cells = bits.withColumnRenamed("i", "j").join(bits, "mask")  # budget * budget rows a subset
    total = cells.join(matrix, ["i", "j"]).groupBy("layer", "mask").agg(F.sum("f").alias("objective"))
    layers = matrix.select("layer").distinct()
    every = masks.crossJoin(layers).join(total, ["layer", "mask"], "left").withColumn("objective", F.coalesce("objective", F.lit(0))).join(member, "mask")  # at most 12,870 subsets a layer
    best = every.groupBy("layer").agg(F.min("objective").alias("best"))
    return every.join(best, "layer").filter("objective = best").groupBy("layer", "objective").agg(F.min("pruned").alias("pruned"), F.count("*").alias("ties"))


def over_quota(pool: DataFrame, key: str, cap: float) -> DataFrame:
    """Oldest rows to evict until the pool's bytes are within ``cap``."""
    total = F.sum("bytes").over(Window.partitionBy(key))
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy(key).orderBy("last_accessed", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return pool.withColumn("evict", total - before > cap)


def freed_until(pool: DataFrame, key: str, order: list, target: Column, name: str = "evict") -> DataFrame:
    """Rows in ``order`` to evict until ``target`` bytes are freed; none for a target of 0."""
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return pool.withColumn(name, (target > 0) & (before < target))


def build_plan(tensors: DataFrame, kept: DataFrame, low: DataFrame) -> DataFrame:
    """Each tensor's action, new name and bytes. ``tensors`` (name, layer, expert, shard, bytes, values);
    ``kept`` (layer, expert, new_id); ``low`` (layer, expert): packed to 3 bits. Tensors without
    an expert are copied; an expert's tensor that ``kept`` lacks is dropped."""
    k = kept.select("layer", "expert", "new_id")
    q = low.select("layer", "expert", F.lit(True).alias("_q"))
    t = tensors.join(k, ["layer", "expert"], "left").join(q, ["layer", "expert"], "left")
    action = F.when(F.col("expert").isNull(), "copy").when(F.col("new_id").isNull(), "drop").when(F.col("_q"), "affine").otherwise("copy")
    out = F.when(F.col("new_id").isNull(), F.col("name")).otherwise(F.concat_ws(".", F.lit("layer"), "layer", F.lit("expert"), "new_id"))
    size = F.when(F.col("action") == "drop", 0).when(F.col("action") == "affine", F.floor(F.col("values") * 3 / 8)).otherwise(F.col("bytes"))
    return t.withColumn("action", action).withColumn("out_name", out).withColumn("out_bytes", size.cast("long")).drop("_q", "new_id")


def shard_offsets(plan: DataFrame) -> DataFrame:
    """Kept tensors with their offsets in their shard, in the order of names."""
    w = Window.partitionBy("shard").orderBy("out_name").rowsBetween(Window.unboundedPreceding, -1)
    return plan.filter("action <> 'drop'").withColumn("offset", F.coalesce(F.sum("out_bytes").over(w), F.lit(0)))


def swap_descent(weights: dict[tuple[int, int], float], experts: int, chosen: list[int], passes: int = 8) -> list[int]:
    """Lower the total pairwise weight of ``chosen`` by single swaps, each the best strict gain, to
    a local optimum. A heuristic for more experts than exhaustive selection takes."""
    pair = lambda a, b: weights.get((a, b), 0.0) + weights.get((b, a), 0.0)
    alone = lambda x, rest: weights.get((x, x), 0.0) + sum(pair(x, j) for j in rest)
    now = set(chosen)
    for _ in range(passes):
        moved = False
        for x in sorted(now):
            rest = now - {x}
            y = min(sorted(set(range(experts)) - now), key=lambda c: alone(c, rest), default=x)
            if alone(y, rest) < alone(x, rest):
                now, moved = rest | {y}, True
        if not moved:
            break
    return sorted(now)


# --- queries ------------------------------------------------------------------------------

EXPERTS, ACTIVE = 16, 4
#: Buckets of Jaccard indices; each begins above its number, the first is exact.
JACCARD = (("1.0", 1.0), ("0.9-1.0", 0.9), ("0.75-0.9", 0.75), ("0.5-0.75", 0.5), ("0.25-0.5", 0.25), ("0.0-0.25", 0.0))


def _routing(spark, d):
    """Each vector's numbers as the scores of 16 experts in each of four layers of its label."""
    e = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("token"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.explode(F.sequence(F.lit(0), F.floor((F.size("embedding") - 1) / EXPERTS).cast("int"))).alias("g"))
    e = e.select((F.col("label") * 4 + F.col("g")).alias("layer"), "token", F.slice("v", F.col("g") * EXPERTS + 1, EXPERTS).alias("scores"))
    e = e.withColumn("selected", topk(F.col("scores"), ACTIVE)).withColumn("gates", softmax_gates(F.col("scores"), F.col("selected")))
    return e.withColumn("added", F.zip_with("gates", "selected", lambda g, i: g * F.abs(F.get("scores", i))))


def q_routing_topk(spark, d):
    r = _routing(spark, d).withColumn("max_gate", F.round(F.array_max("gates"), 6))
    return r.select("token", "layer", F.array_join(F.transform("selected", lambda x: x.cast("string")), ",").alias("selected"), "max_gate")


def q_coactivation(spark, d):
    return pair_statistics(_routing(spark, d)).select("layer", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "n", F.round("s", 6).alias("pair_sum"))


def q_conditional_f(spark, d):
    return conditional_f(pair_statistics(_routing(spark, d))).select("layer", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("f", 6).alias("f"))


def q_first_order(spark, d):
    """Derived means of each expert over the tokens it serves."""
    r = _routing(spark, d)
    x = r.select("layer", F.explode(F.arrays_zip("selected", "added", "gates")).alias("x")).select("layer", "x.*")
    return x.groupBy("layer", F.col("selected").cast("long").alias("i")).agg(F.count("*").alias("n"), F.round(F.avg("added"), 6).alias("first_order"), F.round(F.avg("gates"), 6).alias("mean_gate"))


def q_exhaustive_select(spark, d):
    f = conditional_f(pair_statistics(_routing(spark, d))).withColumn("f", F.round(F.col("f") * 10000).cast("long"))
    return exhaustive_select(f, EXPERTS, EXPERTS // 2).select("layer", "objective", F.array_join(F.transform("pruned", lambda v: v.cast("string")), ",").alias("pruned"), "ties")


def _ranks(spark, d):
    p = coactivation(_routing(spark, d)).filter("i = j")
    return p.withColumn("rank", F.row_number().over(Window.partitionBy("layer").orderBy(F.col("n").desc(), "i")))


def q_diag_topk(spark, d):
    return _ranks(spark, d).filter("rank <= 4").select("layer", F.col("i").cast("long").alias("i"), "n", F.col("rank").cast("long").alias("rank"))


def q_convergence(spark, d):
    """Spearman's rho of expert ranks between half and all of the tokens."""

    def ranked(r):
        p = coactivation(r).filter("i = j")
        return p.select("layer", "i", F.row_number().over(Window.partitionBy("layer").orderBy(F.col("n").desc(), "i")).alias("rank"))

    r = _routing(spark, d)
    a, b = ranked(r.filter("token % 2 = 0")).withColumnRenamed("rank", "ra"), ranked(r).withColumnRenamed("rank", "rb")
    g = b.join(a, ["layer", "i"]).groupBy("layer").agg(F.count("*").alias("n"), F.sum((F.col("ra") - F.col("rb")) * (F.col("ra") - F.col("rb"))).alias("d2"))
    return g.select("layer", "n", "d2", F.when(F.col("n") > 1, 1 - 6 * F.col("d2") / (F.col("n") * (F.col("n") * F.col("n") - 1))).alias("rho"))


def _tensors(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy((F.col("l_partkey") % 12).alias("layer"), (F.col("l_suppkey") % 16).alias("expert")).agg(F.sum("l_quantity").cast("long").alias("bytes"), F.count("*").alias("tensors"))


def q_component_totals(spark, d):
    return _tensors(spark, d).rollup("layer").agg(F.sum("bytes").alias("bytes"), F.sum("tensors").alias("tensors"))


def q_build_plan(spark, d):
    t = _tensors(spark, d).select("layer", "expert", F.concat_ws(".", F.lit("t"), "layer", "expert").alias("name"), (F.col("layer") % 3).alias("shard"), "bytes", F.col("tensors").alias("values"))
    low = t.filter("expert % 5 = 0").select("layer", "expert")
    return shard_offsets(build_plan(t, q_prune_map(spark, d), low)).select("name", "out_name", "action", "shard", "out_bytes", "offset")


def q_closure(spark, d):
    t = _tensors(spark, d)
    drop = F.col("expert") % 4 == F.col("layer") % 4
    g = t.groupBy("layer").agg(F.sum(F.when(~drop, F.col("bytes")).otherwise(0)).alias("kept"), F.sum(F.when(drop, F.col("bytes")).otherwise(0)).alias("dropped"), F.sum("bytes").alias("total"))
    return g.withColumn("closes", F.col("kept") + F.col("dropped") == F.col("total"))


def q_prune_map(spark, d):
    t = _tensors(spark, d).filter("expert % 4 <> layer % 4")
    return t.select("layer", F.col("expert").cast("long").alias("expert"), (F.row_number().over(Window.partitionBy("layer").orderBy("expert")) - 1).cast("long").alias("new_id"))


def q_memory_whatif(spark, d):
    per = _tensors(spark, d).groupBy("layer").agg(F.sum("bytes").alias("total"), F.count("*").alias("experts"))
    return per.select("layer", F.explode(F.array(*(F.lit(x) for x in (12, 10, 8)))).alias("keep"), "total", "experts").select("layer", F.col("keep").cast("long").alias("keep"), F.floor(F.col("total") * F.col("keep") / F.col("experts")).alias("bytes"))


def _maps(spark, d):
    p = table(spark, d, "part").groupBy((F.col("p_partkey") % 10).alias("layer"), (F.col("p_size") % 16).alias("expert")).agg(F.sum("p_retailprice").alias("v"), F.count("*").alias("n"))
    a = Window.partitionBy("layer").orderBy(F.col("n").desc(), "expert")
    b = Window.partitionBy("layer").orderBy(F.col("n"), "expert")
    return p.withColumn("in_a", F.row_number().over(a) <= 10).withColumn("in_b", F.row_number().over(b) <= 10)


def q_selection_compare(spark, d):
    both = (F.col("in_a") & F.col("in_b")).cast("long")
    return _maps(spark, d).groupBy("layer").agg(F.sum(both).alias("both"), F.sum((F.col("in_a") & ~F.col("in_b")).cast("long")).alias("only_a"), F.sum((F.col("in_b") & ~F.col("in_a")).cast("long")).alias("only_b"))


def q_jaccard_hist(spark, d):
    j = q_selection_compare(spark, d).withColumn("j", F.col("both") / (F.col("both") + F.col("only_a") + F.col("only_b")))
    bucket = F.when(F.col("j") == 1, "1.0")
    for name, low in JACCARD[1:-1]:
        bucket = bucket.when(F.col("j") > low, name)
    dim = spark.createDataFrame([(b,) for b, _ in JACCARD], "bucket string")
    return dim.join(j.groupBy(bucket.otherwise(JACCARD[-1][0]).alias("bucket")).agg(F.count("*").alias("n")), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def q_pair_evidence(spark, d):
    m = _maps(spark, d).select("layer", "expert", "in_a")
    pairs = m.select("layer", F.col("expert").alias("x"), F.col("in_a").alias("ax")).join(m.select("layer", ((F.col("expert") + 1) % 16).alias("x"), F.col("in_a").alias("ay")), ["layer", "x"])
    state = F.when(F.col("ax") & F.col("ay"), "kept").when(F.col("ax") | F.col("ay"), "split").otherwise("dropped")
    return pairs.groupBy("layer", state.alias("state")).agg(F.count("*").alias("n"))


def q_precision_ref(spark, d):
    p = table(spark, d, "part").groupBy((F.col("p_partkey") % 10).alias("layer"), (F.col("p_size") % 4 * 2 + 2).alias("bits")).agg(F.count("*").alias("n"))
    return p.groupBy("layer").agg(F.min_by("bits", F.struct(-F.col("n"), "bits")).cast("long").alias("modal_bits"), F.sum("n").alias("projections"))


def _pool(spark, d):
    last = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_accessed"))
    c = table(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"))
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("pool"), F.greatest(F.col("c_acctbal"), F.lit(0.0)).cast("long").alias("bytes"), "last_accessed", (F.col("c_custkey") % 4).alias("priority"))


def q_lru_evict(spark, d):
    return over_quota(_pool(spark, d), "pool", 100000).select("id", "evict")


def q_hot_evict(spark, d):
    return freed_until(_pool(spark, d), "pool", [F.col("priority").desc(), "last_accessed", "id"], F.lit(50000)).select("id", "evict")


def q_disk_evict(spark, d):
    s = table(spark, d, "supplier").select((F.col("s_suppkey") + 1000000).alias("id"), F.col("s_nationkey").alias("pool"), F.greatest(F.col("s_acctbal"), F.lit(0.0)).cast("long").alias("bytes"), F.lit(0).alias("rank"))
    u = s.unionByName(_pool(spark, d).select("id", "pool", "bytes", F.lit(1).alias("rank")))
    return freed_until(u, "pool", ["rank", "id"], F.lit(40000)).select("id", "evict")


def _insns(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 20).alias("kernel"), "event_id", F.col("event_type").alias("op"))
    return e.withColumn("idx", F.row_number().over(Window.partitionBy("kernel").orderBy("event_id")))


def q_kernel_counts(spark, d):
    n = lambda p: F.count_if(F.col("op").rlike(p))
    return _insns(spark, d).groupBy("kernel").agg(F.count("*").alias("n"), n("^v|^c").alias("memory"), n("^p").alias("math"), (n("^p") / F.count("*")).alias("density"))


def q_kernel_class(spark, d):
    """Loads with an index computation in the 3 instructions before, per kernel."""
    w = Window.partitionBy("kernel").orderBy("idx").rowsBetween(-3, -1)
    x = _insns(spark, d).withColumn("before", F.max((F.col("op") == "click").cast("int")).over(w))
    g = x.filter("op = 'view'").groupBy("kernel").agg(F.count("*").alias("loads"), F.sum(F.coalesce("before", F.lit(0)).cast("long")).alias("indexed"))
    return g.select("kernel", "loads", "indexed", F.when(F.col("indexed") * 2 > F.col("loads"), "gather").otherwise("stream").alias("category"))


def q_snapshot_put(spark, d):
    """Content-addressed snapshots: the newest generation of each (source, digest)."""
    t = table(spark, d, "documents").select("source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.col("doc_id").alias("generation"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    return t.groupBy("source", "digest").agg(F.max("generation").alias("generation"), F.max("size").alias("size"), F.count("*").alias("puts"))


def q_artifact_verify(spark, d):
    """Bijection of a manifest and what is there: missing, extra and altered files."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    m = t.filter("path % 11 <> 0").select("path", F.when(F.col("path") % 13 == 0, "x").otherwise(F.col("sha")).alias("want"))
    f = t.filter("path % 7 <> 0")
    j = m.join(f, "path", "full_outer")
    state = F.when(F.col("sha").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("sha") != F.col("want"), "altered").otherwise("ok")
    return j.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Each row's broken rules; rows without any are left out. A rule that is null is broken."""
    bad = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(k)) for k, ok in rules.items())), lambda x: x.isNotNull())
    return df.withColumn("violations", bad).filter(F.size("violations") > 0)


def q_schema_violations(spark, d):
    t = table(spark, d, "documents")
    v = violations(t.select("doc_id", "lang", "n_chars"), {"lang": F.col("lang").isin("en", "fr", "de"), "n_chars": F.col("n_chars").between(100, 20000)})
    return v.select("doc_id", F.array_join("violations", ",").alias("violations"))


def markdown_rows(text: Column) -> Column:
    """Cells of a text's pipe-table rows; rules under headers are left out."""
    rows = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x).startswith("|") & ~F.trim(x).rlike(r"^[|\s:-]+$"))
    return F.transform(rows, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))


def q_markdown_tables(spark, d):
    r = with_planted(spark, d).select("doc_id", F.posexplode(markdown_rows(F.col("text"))).alias("row", "cells"))
    return r.select("doc_id", F.col("row").cast("long").alias("row"), F.array_join("cells", "/").alias("cells"))


QUERIES = {k[2:]: f for k, f in list(globals().items()) if k.startswith("q_")}

_R = """s AS (SELECT label * 4 + i // 16 AS layer, vec_id AS token, embedding[i + 1]::DOUBLE AS score, (i % 16)::BIGINT AS i FROM embeddings, range(0, 64) t(i)),
q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY token, layer ORDER BY score DESC, i) AS rn FROM s) WHERE rn <= 4),
k AS (SELECT *, exp(score) / sum(exp(score)) OVER (PARTITION BY token, layer) AS gate FROM q),
p AS (SELECT a.layer, a.i, b.i AS j, count(*) AS n, sum(a.gate * abs(a.score) * b.gate * abs(b.score)) AS s FROM k a JOIN k b USING (token, layer) GROUP BY ALL)"""
_T = "t AS (SELECT l_partkey % 12 AS layer, l_suppkey % 16 AS expert, sum(l_quantity)::BIGINT AS bytes, count(*) AS tensors FROM lineitem GROUP BY ALL)"
_MAPS = """g AS (SELECT p_partkey % 10 AS layer, p_size % 16 AS expert, count(*) AS n FROM part GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY n DESC, expert) <= 10 AS in_a, row_number() OVER (PARTITION BY layer ORDER BY n, expert) <= 10 AS in_b FROM g),
c AS (SELECT layer, count(*) FILTER (WHERE in_a AND in_b) AS "both", count(*) FILTER (WHERE in_a AND NOT in_b) AS only_a, count(*) FILTER (WHERE in_b AND NOT in_a) AS only_b FROM m GROUP BY layer)"""
_P = "p AS (SELECT c_custkey AS id, c_nationkey AS pool, trunc(greatest(c_acctbal, 0))::BIGINT AS bytes, max(o_orderdate) AS la, c_custkey % 4 AS priority FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL)"
_I = "x AS (SELECT user_id % 20 AS kernel, event_type AS op, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS idx FROM events)"
ORACLE_SQL = {
    "routing_topk": f"WITH {_R} SELECT token, layer, string_agg(i::VARCHAR, ',' ORDER BY i) AS selected, round(max(gate), 6) AS max_gate FROM k GROUP BY token, layer",
    "coactivation": f"WITH {_R} SELECT layer, i, j, n, round(s, 6) AS pair_sum FROM p",
    "conditional_f": f"WITH {_R} SELECT layer, i, j, round(s / n, 6) AS f FROM p",
    "first_order": f"WITH {_R} SELECT layer, i, count(*) AS n, round(avg(gate * abs(score)), 6) AS first_order, round(avg(gate), 6) AS mean_gate FROM k GROUP BY layer, i",
    "exhaustive_select": f"""WITH {_R}, f AS (SELECT layer, i, j, round(s / n * 10000)::BIGINT AS f FROM p), m AS (SELECT mask FROM range(0, 65536) m(mask) WHERE bit_count(mask) = 8), b AS (SELECT mask, i::BIGINT AS i FROM m, range(0, 16) t(i) WHERE (mask >> i) & 1 = 1),
l AS (SELECT mask, list(i ORDER BY i) AS pruned FROM b GROUP BY mask), o AS (SELECT f.layer, x.mask, sum(f)::BIGINT AS objective FROM b x JOIN b y USING (mask) JOIN f ON f.i = x.i AND f.j = y.i GROUP BY ALL),
e AS (SELECT c.layer, l.mask, pruned, coalesce(objective, 0) AS objective FROM l CROSS JOIN (SELECT DISTINCT layer FROM f) c LEFT JOIN o ON o.layer = c.layer AND o.mask = l.mask), z AS (SELECT *, min(objective) OVER (PARTITION BY layer) AS best FROM e)
SELECT layer, objective, array_to_string(min(pruned), ',') AS pruned, count(*) AS ties FROM z WHERE objective = best GROUP BY layer, objective""",
    "diag_topk": f"WITH {_R} SELECT layer, i, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY n DESC, i) AS rank FROM p WHERE i = j) WHERE rank <= 4",
    "convergence": f"""WITH {_R}, a AS (SELECT layer, i, row_number() OVER (PARTITION BY layer ORDER BY count(*) DESC, i) AS ra FROM k WHERE token % 2 = 0 GROUP BY layer, i), b AS (SELECT layer, i, row_number() OVER (PARTITION BY layer ORDER BY count(*) DESC, i) AS rb FROM k GROUP BY layer, i),
g AS (SELECT layer, count(*) AS n, sum((ra - rb) * (ra - rb))::BIGINT AS d2 FROM b JOIN a USING (layer, i) GROUP BY layer) SELECT layer, n, d2, CASE WHEN n > 1 THEN 1 - 6 * d2 / (n * (n * n - 1)) END AS rho FROM g""",
    "component_totals": f"WITH {_T} SELECT layer, sum(bytes)::BIGINT AS bytes, sum(tensors)::BIGINT AS tensors FROM t GROUP BY ROLLUP (layer)",
    "build_plan": f"""WITH {_T}, k AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY expert) - 1 AS new_id FROM t WHERE expert % 4 <> layer % 4),
p AS (SELECT 't.' || layer || '.' || expert AS name, 'layer.' || layer || '.expert.' || new_id AS out_name, CASE WHEN expert % 5 = 0 THEN 'affine' ELSE 'copy' END AS action, layer % 3 AS shard, CASE WHEN expert % 5 = 0 THEN floor(tensors * 3 / 8)::BIGINT ELSE bytes END AS out_bytes FROM k)
SELECT *, coalesce(sum(out_bytes) OVER (PARTITION BY shard ORDER BY out_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset FROM p""",
    "closure": f"WITH {_T} SELECT layer, coalesce(sum(bytes) FILTER (WHERE expert % 4 <> layer % 4), 0)::BIGINT AS kept, coalesce(sum(bytes) FILTER (WHERE expert % 4 = layer % 4), 0)::BIGINT AS dropped, sum(bytes)::BIGINT AS total, true AS closes FROM t GROUP BY layer",
    "prune_map": f"WITH {_T} SELECT layer, expert, row_number() OVER (PARTITION BY layer ORDER BY expert) - 1 AS new_id FROM t WHERE expert % 4 <> layer % 4",
    "memory_whatif": f"WITH {_T}, g AS (SELECT layer, sum(bytes) AS total, count(*) AS experts FROM t GROUP BY layer) SELECT layer, keep::BIGINT AS keep, floor(total * keep / experts)::BIGINT AS bytes FROM g, (VALUES (12), (10), (8)) v(keep)",
    "selection_compare": f"WITH {_MAPS} SELECT * FROM c",
    "jaccard_hist": f"""WITH {_MAPS}, j AS (SELECT "both" / ("both" + only_a + only_b) AS j FROM c), x AS (SELECT CASE WHEN j = 1 THEN '1.0' WHEN j > 0.9 THEN '0.9-1.0' WHEN j > 0.75 THEN '0.75-0.9' WHEN j > 0.5 THEN '0.5-0.75' WHEN j > 0.25 THEN '0.25-0.5' ELSE '0.0-0.25' END AS bucket FROM j)
SELECT b.bucket, count(x.bucket) AS n FROM (VALUES ('1.0'), ('0.9-1.0'), ('0.75-0.9'), ('0.5-0.75'), ('0.25-0.5'), ('0.0-0.25')) b(bucket) LEFT JOIN x USING (bucket) GROUP BY b.bucket""",
    "pair_evidence": f"WITH {_MAPS} SELECT a.layer, CASE WHEN a.in_a AND b.in_a THEN 'kept' WHEN a.in_a OR b.in_a THEN 'split' ELSE 'dropped' END AS state, count(*) AS n FROM m a JOIN m b ON a.layer = b.layer AND a.expert = (b.expert + 1) % 16 GROUP BY ALL",
    "precision_ref": "WITH g AS (SELECT p_partkey % 10 AS layer, p_size % 4 * 2 + 2 AS bits, count(*) AS n FROM part GROUP BY ALL) SELECT layer, arg_min(bits, row(-n, bits))::BIGINT AS modal_bits, sum(n)::BIGINT AS projections FROM g GROUP BY layer",
    "lru_evict": f"WITH {_P} SELECT id, sum(bytes) OVER (PARTITION BY pool) - coalesce(sum(bytes) OVER (PARTITION BY pool ORDER BY la, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 100000 AS evict FROM p",
    "hot_evict": f"WITH {_P} SELECT id, coalesce(sum(bytes) OVER (PARTITION BY pool ORDER BY priority DESC, la, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 50000 AS evict FROM p",
    "disk_evict": f"WITH {_P}, u AS (SELECT id, pool, bytes, 1 AS rank FROM p UNION ALL SELECT s_suppkey + 1000000, s_nationkey, trunc(greatest(s_acctbal, 0))::BIGINT, 0 FROM supplier) SELECT id, coalesce(sum(bytes) OVER (PARTITION BY pool ORDER BY rank, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 40000 AS evict FROM u",
    "kernel_counts": f"WITH {_I} SELECT kernel, count(*) AS n, count(*) FILTER (WHERE op IN ('view', 'click')) AS memory, count(*) FILTER (WHERE op = 'purchase') AS math, count(*) FILTER (WHERE op = 'purchase') / count(*) AS density FROM x GROUP BY kernel",
    "kernel_class": f"WITH {_I}, y AS (SELECT *, coalesce(max((op = 'click')::INT) OVER (PARTITION BY kernel ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS b FROM x), g AS (SELECT kernel, count(*) AS loads, sum(b)::BIGINT AS indexed FROM y WHERE op = 'view' GROUP BY kernel) SELECT *, CASE WHEN indexed * 2 > loads THEN 'gather' ELSE 'stream' END AS category FROM g",
    "snapshot_put": "SELECT source, sha256(coalesce(text, '')) AS digest, max(doc_id) AS generation, max(octet_length(encode(coalesce(text, ''))))::BIGINT AS size, count(*) AS puts FROM documents GROUP BY ALL",
    "artifact_verify": "SELECT CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 11 = 0 THEN 'extra' WHEN doc_id % 13 = 0 THEN 'altered' ELSE 'ok' END AS state, count(*) AS n FROM documents WHERE NOT (doc_id % 7 = 0 AND doc_id % 11 = 0) GROUP BY 1",
    "schema_violations": "SELECT * FROM (SELECT doc_id, concat_ws(',', CASE WHEN NOT coalesce(lang IN ('en', 'fr', 'de'), false) THEN 'lang' END, CASE WHEN NOT coalesce(n_chars BETWEEN 100 AND 20000, false) THEN 'n_chars' END) AS violations FROM documents) WHERE violations <> ''",
    "markdown_tables": f"""WITH {planted_sql()}, l AS (SELECT doc_id, [trim(x) for x in string_split(t, chr(10)) if starts_with(trim(x), '|') AND NOT regexp_matches(trim(x), '^[|\\s:-]+$')] AS l FROM p), r AS (SELECT doc_id, unnest(l) AS x, unnest(range(0, len(l))) AS row FROM l)
SELECT doc_id, row, array_to_string([trim(c) for c in string_split(regexp_replace(regexp_replace(x, '^\\|', ''), '\\|$', ''), '|')], '/') AS cells FROM r""",
}
