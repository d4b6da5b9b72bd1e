"""Paired outcomes, gates, levels, protocol metrics, calibration grids and sampling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import canon
from quillspark.plans.tables import table


def pair(reference: DataFrame, candidate: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer match on ``keys``; ``missing_from`` says which side lacks the pair."""
    a = reference.select(*keys, *(F.col(c).alias(f"ref_{c}") for c in reference.columns if c not in keys), F.lit(True).alias("_a"))
    b = candidate.select(*keys, *(F.col(c).alias(f"cand_{c}") for c in candidate.columns if c not in keys), F.lit(True).alias("_b"))
    j = a.join(b, list(keys), "full_outer")
    return j.withColumn("missing_from", F.when(F.col("_a").isNull(), "reference").when(F.col("_b").isNull(), "candidate")).drop("_a", "_b")


def cluster_means(matched: DataFrame) -> DataFrame:
    """Mean success of each side by task, over matched pairs only."""
    return matched.filter("missing_from is null").groupBy("task_id").agg(F.avg(F.col("ref_success").cast("double")).alias("ref_mean"), F.avg(F.col("cand_success").cast("double")).alias("cand_mean"), F.count("*").alias("n"))


def wins_losses(clusters: DataFrame) -> DataFrame:
    """One row over task clusters: wins, losses, ties by their means, and the ratio of the mean task
    rates (null where the reference's is zero)."""
    a, b = F.col("ref_mean"), F.col("cand_mean")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    g = clusters.agg(n(b > a).alias("wins"), n(b < a).alias("losses"), n(a == b).alias("ties"), F.avg(a).alias("_ra"), F.avg(b).alias("_rb"))
    return g.select("wins", "losses", "ties", F.when(F.col("_ra") > 0, F.col("_rb") / F.col("_ra")).alias("ratio"))


def discordant(matched: DataFrame) -> DataFrame:
    """One row: (n, repeated, lost, won): pairs, tasks with more than one seed, and discordant pairs.
    A paired test holds only where no task has more than one seed."""
    m = matched.filter("missing_from is null")
    by = m.groupBy("task_id").agg(F.count("*").alias("n"), F.sum((F.col("ref_success") & ~F.col("cand_success")).cast("long")).alias("lost"), F.sum((~F.col("ref_success") & F.col("cand_success")).cast("long")).alias("won"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 1).alias("repeated"), F.coalesce(F.sum("lost"), F.lit(0)).alias("lost"), F.coalesce(F.sum("won"), F.lit(0)).alias("won"))


def mcnemar(wins: int, losses: int) -> float:
    """Exact two-sided p; in log space, so that thousands of discordant pairs do not underflow."""
    n, k = wins + losses, min(wins, losses)
    if not n:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    return min(1.0, 2 * sum(math.exp(x) for x in log))


def bootstrap(clusters: DataFrame, replicates: int = 200, salt: str = "boot") -> DataFrame:
    """Cluster bootstrap: (replicate, mean difference). Each draw takes the task whose place is a
    hash of (replicate, draw), so the result does not depend on partitions. Tasks are numbered
    within hash buckets and offsets, not by one global sort."""
    c = clusters.select("task_id", (F.col("cand_mean") - F.col("ref_mean")).alias("diff"))
    n = c.count()
    b = c.withColumn("_b", F.pmod(F.xxhash64("task_id"), F.lit(64)).cast("int"))
    size = {r._b: r.n for r in b.groupBy("_b").agg(F.count("*").alias("n")).collect()}
    offset, at = {}, 0
    for k in sorted(size):
        offset[k] = at
        at += size[k]
    start = F.create_map(*(x for k, v in offset.items() for x in (F.lit(k), F.lit(v))))
    place = start[F.col("_b")] + F.row_number().over(Window.partitionBy("_b").orderBy("task_id")) - 1
    numbered = b.withColumn("place", place.cast("long")).select("place", "diff")
    draws = c.sparkSession.range(replicates * n).select((F.col("id") / n).cast("long").alias("replicate"), F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(n)).alias("place"))
    return draws.join(numbered, "place").groupBy("replicate").agg(F.avg("diff").alias("mean_diff"))


def gates(records: DataFrame, checks: Sequence[tuple[str, str, float]]) -> DataFrame:
    """(id, gate, value, verdict): a null or unmeasured metric is ``unmeasured``, never a pass."""

    def one(name: str, op: str, bound: float) -> Column:
        v = F.col(name).cast("double")
        ok = v >= bound if op == ">=" else v <= bound
        verdict = F.when(v.isNull() | ~F.col("measured"), "unmeasured").when(ok, "pass").otherwise("fail")
        return F.struct(F.lit(name).alias("gate"), v.alias("value"), verdict.alias("verdict"))

    return records.select("id", F.inline(F.array(*(one(*c) for c in checks))))


def level_rollup(records: DataFrame, levels: int = 7) -> DataFrame:
    """(candidate_id, level, verdict, overall) for every level, absent ones ``unmeasured``; a pass
    without evidence is unmeasured. ``overall`` is over all levels but the last: fail before
    unmeasured before pass. A repeated (candidate, level) or a level out of range is an error."""
    bad = records.groupBy("candidate_id", "level").count().filter((F.col("count") > 1) | ~F.col("level").between(1, levels))
    if not bad.isEmpty():
        raise ValueError("a level is given twice for a candidate, or is out of range")
    rank = F.when(F.col("verdict") == "fail", 0).when((F.col("verdict") == "pass") & F.col("has_evidence"), 2).otherwise(1)
    every = records.select("candidate_id").distinct().select("candidate_id", F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("level"))
    r = every.join(records.select("candidate_id", "level", rank.alias("r")), ["candidate_id", "level"], "left").withColumn("r", F.coalesce("r", F.lit(1)))
    worst = F.min(F.when(F.col("level") < levels, F.col("r"))).over(Window.partitionBy("candidate_id"))
    name = lambda c: F.element_at(F.array(*(F.lit(x) for x in ("fail", "unmeasured", "pass"))), c + 1)
    return r.select("candidate_id", F.col("level").cast("long").alias("level"), name(F.col("r")).alias("verdict"), name(worst).alias("overall"))


def calibration_grid(records: DataFrame, anchors: DataFrame, weights=canon.WEIGHTS, spam_weight: float = 0.25) -> DataFrame:
    """Mass by (partition, label), split over a record's labels, against target shares: a partition's
    weight among those that are not golden, times the label's anchor. Golden records take no
    part. ``sampling`` is target over realized, 0 for an empty target, null where nothing was
    realized of a target; cells without both are left out."""
    spark = records.sparkSession
    mass = F.when(F.col("events") > 0, F.col("weight") * (1 - (1 - spam_weight) * F.col("downweighted") / F.col("events"))).otherwise(F.col("weight"))
    r = records.filter("partition <> 'golden'").withColumn("mass", mass)
    cells = r.select("partition", F.explode("labels").alias("label"), (F.col("mass") / F.size("labels")).alias("m")).groupBy("partition", "label").agg(F.count("*").alias("episodes"), F.sum("m").alias("mass"))
    total = r.agg(F.sum("mass").alias("total"))
    live = {p: w for p, w in weights.items() if p != "golden"}
    parts = spark.createDataFrame([(p, w / sum(live.values())) for p, w in live.items()], "partition string, share double")
    j = anchors.crossJoin(F.broadcast(parts)).join(cells, ["partition", "label"], "left").crossJoin(F.broadcast(total))  # a few partitions, and one row
    j = j.withColumn("target", F.col("share") * F.col("anchor")).withColumn("realized", F.coalesce("mass", F.lit(0.0)) / F.col("total")).filter("mass is not null or target > 0")
    sampling = F.when(F.col("realized") > 0, F.col("target") / F.col("realized")).when(F.col("target") <= 0, 0.0)
    return j.select("partition", "label", F.coalesce("episodes", F.lit(0)).alias("episodes"), "target", "realized", sampling.alias("sampling"), ((F.col("realized") <= 0) & (F.col("target") > 0)).alias("unreachable"))


def quotas(strata: DataFrame, total: int, floor: int = 2) -> DataFrame:
    """Quotas over (stratum, size) that add up to ``total`` where there is so much: ``floor`` of each
    stratum first, the rest in proportion to what is left of each, and what then remains by
    largest remainder. Strata are few: one row each."""
    every = Window.partitionBy()
    base = F.least(F.col("size"), F.lit(floor))
    x = strata.withColumn("base", base).withColumn("w", F.col("size") - F.col("base"))
    x = x.withColumn("whole", F.least(F.lit(total), F.sum("size").over(every))).withColumn("pool", F.greatest(F.lit(0), F.col("whole") - F.sum("base").over(every)))
    x = x.withColumn("exact", F.when(F.sum("w").over(every) > 0, F.col("pool") * F.col("w") / F.sum("w").over(every)).otherwise(0.0))
    x = x.withColumn("add", F.least(F.col("w"), F.floor("exact"))).withColumn("now", F.col("base") + F.col("add"))
    x = x.withColumn("left", F.col("whole") - F.sum("now").over(every)).withColumn("open", F.col("now") < F.col("size"))
    rest = F.when(F.col("w") > 0, (F.col("exact") - F.col("add")) / F.col("w")).otherwise(0.0)
    x = x.withColumn("n", F.row_number().over(Window.partitionBy("open").orderBy(rest.desc(), "stratum")))
    one = F.col("open") & (F.col("pool") > 0) & (F.col("n") <= F.col("left"))
    return x.select("stratum", "size", (F.col("now") + one.cast("long")).cast("long").alias("quota"))


def round_robin(rows: DataFrame, take: int) -> DataFrame:
    """``take`` rows of each cell, one bucket after the other; the first bucket moves on each round."""
    w = Window.partitionBy("cell", "bucket").orderBy("order_hash", "id")
    r = rows.withColumn("round", F.row_number().over(w) - 1)
    n = rows.groupBy("cell").agg((F.max("bucket") + 1).alias("n_buckets"))
    r = r.join(n, "cell").withColumn("turn", F.pmod(F.col("bucket") - F.col("round"), F.col("n_buckets")))
    return r.withColumn("pick", F.row_number().over(Window.partitionBy("cell").orderBy("round", "turn", "id"))).filter(F.col("pick") <= take)


# --- queries ------------------------------------------------------------------------------


def _outcomes(spark, d):
    o = table(spark, d, "orders").withColumn("seed", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long"))
    key = [F.col("o_custkey").alias("task_id"), "seed"]
    a = o.select(*key, (F.col("o_orderstatus") != "F").alias("success"), F.col("o_orderpriority").alias("domain"))
    b = o.filter("o_orderkey % 17 <> 0").select(*key, (F.col("o_totalprice") < 250000).alias("success"), F.col("o_orderpriority").alias("domain"))
    return pair(a, b, ["task_id", "seed"])


def q_paired_match(spark, d):
    return _outcomes(spark, d).filter("missing_from is null").select("task_id", "seed", "ref_success", "cand_success")


def q_paired_missing(spark, d):
    return _outcomes(spark, d).filter("missing_from is not null").groupBy("missing_from").agg(F.count("*").alias("n"))


def q_cluster_means(spark, d):
    return cluster_means(_outcomes(spark, d))


def q_wlt(spark, d):
    return wins_losses(cluster_means(_outcomes(spark, d)))


def q_slices(spark, d):
    m = _outcomes(spark, d).filter("missing_from is null")
    return m.groupBy(F.col("ref_domain").alias("domain")).agg(F.count("*").alias("n"), F.sum(F.col("ref_success").cast("long")).alias("ref_successes"), F.sum(F.col("cand_success").cast("long")).alias("cand_successes"))


def q_mcnemar(spark, d):
    """All pairs, where tasks have several seeds and the test does not apply, and the pairs of each
    task's first seed."""
    out = []
    for scope, m in (("all", _outcomes(spark, d)), ("first_seed", _outcomes(spark, d).filter("seed = 1"))):
        w = discordant(m).first()
        ok = not w.repeated
        out.append((scope, "computed" if ok else "not_applicable", w.n, w.lost if ok else None, w.won if ok else None, mcnemar(w.won, w.lost) if ok else None))
    return spark.createDataFrame(out, "scope string, status string, n long, lost long, won long, p double")


def q_bootstrap_ci(spark, d):
    b = bootstrap(cluster_means(_outcomes(spark, d)))
    return b.agg(F.percentile("mean_diff", F.lit(0.025)).alias("low"), F.percentile("mean_diff", F.lit(0.975)).alias("high"), F.count("*").alias("replicates"))


def q_gates_unpivot(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") != "P").alias("measured"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("price"), (F.col("o_custkey") % 100).cast("double").alias("rate"))
    return gates(o, [("price", "<=", 200000.0), ("rate", ">=", 65.0)])


def q_level_rollup(spark, d):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    o = table(spark, d, "orders").withColumn("n", n)
    o = o.select((F.col("o_custkey") * 1000 + F.floor(F.col("n") / 7)).alias("candidate_id"), (F.col("n") % 7 + 1).cast("int").alias("level"), F.when(F.col("o_orderstatus") == "F", "fail").otherwise("pass").alias("verdict"), (F.col("o_totalprice") > 100000).alias("has_evidence"))
    return level_rollup(o)


def q_protocol_metrics(spark, d):
    e = table(spark, d, "events")
    g = e.groupBy("user_id").agg(F.count("*").alias("total"), F.sum((F.col("event_type") != "error").cast("long")).alias("ok"), F.sum((F.col("event_type") == "purchase").cast("long")).alias("bought"), F.sum(F.col("event_type").isin("purchase", "view").cast("long")).alias("seen"))

    def rate(name: str, count: str, total: str) -> Column:
        return F.struct(F.lit(name).alias("metric"), F.col(count).alias("count"), F.col(total).alias("total"), F.when(F.col(total) > 0, F.col(count) / F.col(total)).alias("rate"))

    return g.select("user_id", F.inline(F.array(rate("success", "ok", "total"), rate("conversion", "bought", "seen"))))


def q_torture_assign(spark, d):
    r = table(spark, d, "documents").select("doc_id", F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 16).alias("ref"))
    u = r.groupBy("ref").agg(F.min("doc_id").alias("doc_id"))
    # ranks by hash prefix: counts of 256 buckets, then a rank within each
    u = u.withColumn("b", F.substring("ref", 1, 2))
    before = u.groupBy("b").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    u = u.join(F.broadcast(before.select("b", "before")), "b").withColumn("rank", F.row_number().over(Window.partitionBy("b").orderBy("ref")) + F.col("before") - 1)
    return u.select("doc_id", (F.col("rank") % 6).cast("long").alias("element"))


def q_calibration_grid(spark, d):
    p = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("events"), F.sum((F.col("event_type") == "error").cast("long")).alias("downweighted"), F.array_sort(F.collect_set("event_type")).alias("labels"))
    p = p.withColumn("partition", F.element_at(F.array(*(F.lit(x) for x in canon.PARTITIONS)), (F.col("user_id") % 6 + 1).cast("int"))).withColumn("weight", F.lit(1.0))
    t = spark.createDataFrame([("click", 0.4), ("view", 0.3), ("error", 0.0), ("purchase", 0.2), ("refund", 0.1)], "label string, anchor double")
    return calibration_grid(p, t)


def q_stratified_quota(spark, d):
    return quotas(table(spark, d, "documents").groupBy(F.col("source").alias("stratum")).agg(F.count("*").alias("size")), 100)


def q_roundrobin_pick(spark, d):
    r = table(spark, d, "documents").select(F.col("lang").alias("cell"), (F.col("doc_id") % 5).alias("bucket"), F.sha2(F.col("doc_id").cast("string"), 256).alias("order_hash"), F.col("doc_id").alias("id"))
    return round_robin(r, 12).select("cell", "id", F.col("pick").cast("long").alias("pick"))


QUERIES = {f.__name__[2:]: f for f in (q_paired_match, q_paired_missing, q_cluster_means, q_wlt, q_slices, q_mcnemar, q_bootstrap_ci, q_gates_unpivot, q_level_rollup, q_protocol_metrics, q_torture_assign, q_calibration_grid, q_stratified_quota, q_roundrobin_pick)}

_O = """o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seed FROM orders),
m AS (SELECT o_custkey AS task_id, seed, o_orderstatus <> 'F' AS ref_success, o_totalprice < 250000 AS cand_success, o_orderpriority AS domain FROM o WHERE o_orderkey % 17 <> 0)"""
ORACLE_SQL = {
    "paired_match": f"WITH {_O} SELECT task_id, seed, ref_success, cand_success FROM m",
    "paired_missing": "SELECT 'candidate' AS missing_from, count(*) AS n FROM orders WHERE o_orderkey % 17 = 0 HAVING count(*) > 0",
    "cluster_means": f"WITH {_O} SELECT task_id, avg(ref_success::INT) AS ref_mean, avg(cand_success::INT) AS cand_mean, count(*) AS n FROM m GROUP BY task_id",
    "wlt": f"WITH {_O}, c AS (SELECT task_id, avg(ref_success::INT) AS r, avg(cand_success::INT) AS k FROM m GROUP BY task_id) SELECT count(*) FILTER (WHERE k > r) AS wins, count(*) FILTER (WHERE k < r) AS losses, count(*) FILTER (WHERE k = r) AS ties, avg(k) / nullif(avg(r), 0) AS ratio FROM c",
    "slices": f"WITH {_O} SELECT domain, count(*) AS n, count(*) FILTER (WHERE ref_success) AS ref_successes, count(*) FILTER (WHERE cand_success) AS cand_successes FROM m GROUP BY domain",
    "mcnemar": f"""WITH {_O}, x AS (SELECT 'all' AS scope, * FROM m UNION ALL SELECT 'first_seed', * FROM m WHERE seed = 1), t AS (SELECT scope, task_id, count(*) AS n, count(*) FILTER (WHERE ref_success AND NOT cand_success) AS l, count(*) FILTER (WHERE cand_success AND NOT ref_success) AS w FROM x GROUP BY ALL),
g AS (SELECT scope, sum(n)::BIGINT AS n, max(n) > 1 AS rep, sum(l)::BIGINT AS l, sum(w)::BIGINT AS w FROM t GROUP BY scope), k AS (SELECT scope, sum(exp(lgamma(l + w + 1) - lgamma(i + 1) - lgamma(l + w - i + 1) - (l + w) * ln(2))) AS s FROM g, range(0, 1000000) r(i) WHERE NOT rep AND i <= least(l, w) GROUP BY scope)
SELECT scope, CASE WHEN rep THEN 'not_applicable' ELSE 'computed' END AS status, n, CASE WHEN NOT rep THEN l END AS lost, CASE WHEN NOT rep THEN w END AS won, CASE WHEN NOT rep THEN CASE WHEN l + w = 0 THEN 1 ELSE least(1, 2 * s) END END::DOUBLE AS p FROM g LEFT JOIN k USING (scope)""",
    "gates_unpivot": "WITH r AS (SELECT o_orderkey AS id, o_orderstatus <> 'P' AS measured, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price, (o_custkey % 100)::DOUBLE AS rate FROM orders) SELECT id, 'price' AS gate, price AS value, CASE WHEN price IS NULL OR NOT measured THEN 'unmeasured' WHEN price <= 200000 THEN 'pass' ELSE 'fail' END AS verdict FROM r UNION ALL SELECT id, 'rate', rate, CASE WHEN NOT measured THEN 'unmeasured' WHEN rate >= 65 THEN 'pass' ELSE 'fail' END FROM r",
    "level_rollup": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders), r AS (SELECT o_custkey * 1000 + n // 7 AS candidate_id, n % 7 + 1 AS level, CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_totalprice > 100000 THEN 3 ELSE 2 END AS v FROM o),
e AS (SELECT c.candidate_id, l.level, coalesce(v, 2) AS v FROM (SELECT DISTINCT candidate_id FROM r) c CROSS JOIN range(1, 8) l(level) LEFT JOIN r ON r.candidate_id = c.candidate_id AND r.level = l.level)
SELECT candidate_id, level, ['fail', 'unmeasured', 'pass'][v] AS verdict, ['fail', 'unmeasured', 'pass'][min(v) FILTER (WHERE level < 7) OVER (PARTITION BY candidate_id)] AS overall FROM e""",
    "protocol_metrics": "WITH g AS (SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS ok, count(*) FILTER (WHERE event_type = 'purchase') AS bought, count(*) FILTER (WHERE event_type IN ('purchase', 'view')) AS seen FROM events GROUP BY user_id) SELECT user_id, 'success' AS metric, ok AS count, total, ok / total AS rate FROM g UNION ALL SELECT user_id, 'conversion', bought, seen, CASE WHEN seen > 0 THEN bought / seen END FROM g",
    "torture_assign": "WITH u AS (SELECT substr(sha256(coalesce(text, '')), 1, 16) AS ref, min(doc_id) AS doc_id FROM documents GROUP BY 1) SELECT doc_id, (row_number() OVER (ORDER BY ref) - 1) % 6 AS element FROM u",
    "calibration_grid": """WITH p AS (SELECT user_id, ['pruning', 'quant', 'recovery', 'validation', 'golden', 'torture'][user_id % 6 + 1] AS partition, 1 - 0.75::DOUBLE * count(*) FILTER (WHERE event_type = 'error') / count(*) AS mass, count(DISTINCT event_type) AS k FROM events GROUP BY user_id),
q AS (SELECT * FROM p WHERE partition <> 'golden'), c AS (SELECT partition, event_type AS label, count(*) AS episodes, sum(mass / k) AS mass FROM q JOIN (SELECT DISTINCT user_id, event_type FROM events) USING (user_id) GROUP BY ALL),
a(label, anchor) AS (VALUES ('click', 0.4::DOUBLE), ('view', 0.3::DOUBLE), ('error', 0::DOUBLE), ('purchase', 0.2::DOUBLE), ('refund', 0.1::DOUBLE)), w(partition, w) AS (VALUES ('pruning', 0.35::DOUBLE), ('quant', 0.2::DOUBLE), ('recovery', 0.2::DOUBLE), ('validation', 0.1::DOUBLE), ('torture', 0.05::DOUBLE)),
j AS (SELECT partition, label, coalesce(episodes, 0) AS episodes, w / 0.9::DOUBLE * anchor AS target, coalesce(mass, 0) / (SELECT sum(mass) FROM q) AS realized FROM a CROSS JOIN w LEFT JOIN c USING (partition, label))
SELECT partition, label, episodes, target, realized, CASE WHEN realized > 0 THEN target / realized WHEN target <= 0 THEN 0 END AS sampling, realized <= 0 AND target > 0 AS unreachable FROM j WHERE episodes > 0 OR target > 0""",
    "stratified_quota": """WITH s AS (SELECT source AS stratum, count(*) AS size FROM documents GROUP BY 1), x AS (SELECT *, least(size, 2) AS base, size - least(size, 2) AS w FROM s), t AS (SELECT least(100, sum(size)) AS whole, greatest(0, least(100, sum(size)) - sum(base)) AS pool, sum(w) AS sw FROM x),
y AS (SELECT stratum, size, w, base + least(w, floor(pool * w / sw::DOUBLE)) AS now, pool * w / sw::DOUBLE - least(w, floor(pool * w / sw::DOUBLE)) AS rest, pool, whole FROM x, t), z AS (SELECT *, whole - sum(now) OVER () AS left_, row_number() OVER (PARTITION BY now < size ORDER BY CASE WHEN w > 0 THEN rest / w ELSE 0 END DESC, stratum) AS n FROM y)
SELECT stratum, size, (now + (now < size AND pool > 0 AND n <= left_)::INT)::BIGINT AS quota FROM z""",
    "roundrobin_pick": "WITH r AS (SELECT lang AS cell, doc_id % 5 AS bucket, doc_id AS id, row_number() OVER (PARTITION BY lang, doc_id % 5 ORDER BY sha256(doc_id::VARCHAR), doc_id) - 1 AS rnd FROM documents), n AS (SELECT cell, max(bucket) + 1 AS nb FROM r GROUP BY cell), p AS (SELECT cell, id, row_number() OVER (PARTITION BY cell ORDER BY rnd, ((bucket - rnd) % nb + nb) % nb, id) AS pick FROM r JOIN n USING (cell)) SELECT cell, id, pick FROM p WHERE pick <= 12",
}
