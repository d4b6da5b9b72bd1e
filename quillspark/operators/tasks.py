"""Task groups: deterministic partitions, reservations, eligibility, grouping, quarantine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import canon
from quillspark.plans.tables import table

SALT = "quill-v1"
#: Fields that a golden task must have.
GOLDEN_FIELDS = ("repository", "start_revision", "issue", "oracle", "prompt")
BANK_MIN, BANK_MAX = 50, 200


def assign(groups: DataFrame, salt: str, frozen: DataFrame | None = None, weights=canon.WEIGHTS) -> DataFrame:
    """Groups with their partition; an assignment frozen before is kept as it is."""
    hashed = canon.weighted_bucket(canon.unit_hash(salt, F.col("group_id")), canon.PARTITIONS, weights)
    if frozen is None:
        return groups.withColumn("partition", hashed).withColumn("frozen", F.lit(False))
    f = frozen.select("group_id", F.col("partition").alias("was"))
    return groups.join(f, "group_id", "left").withColumn("partition", F.coalesce("was", hashed)).withColumn("frozen", F.col("was").isNotNull()).drop("was")


def partition_counts(assigned: DataFrame) -> DataFrame:
    """Counts of all partitions, those without groups at 0."""
    dim = assigned.sparkSession.createDataFrame([(p,) for p in canon.PARTITIONS], "partition string")
    n = assigned.groupBy("partition").agg(F.count("*").alias("n"))
    return dim.join(n, "partition", "left").select("partition", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def reserved_not_ready(assigned: DataFrame, eligible: DataFrame) -> DataFrame:
    """Golden groups without eligibility: reported, never moved."""
    gone = assigned.filter("partition = 'golden'").join(eligible.select("group_id").distinct(), "group_id", "left_anti")
    return gone.select("group_id", F.lit("reserved_golden_missing_eligibility").alias("reason"))


def missing_fields(tasks: DataFrame, fields: Sequence[str] = GOLDEN_FIELDS) -> DataFrame:
    """``tasks`` with ``missing``: the fields that are null or empty, and ``eligible``."""

    def name(f: str) -> Column:
        return F.when(F.col(f).isNull() | (F.col(f).cast("string") == ""), F.lit(f))

    return tasks.withColumn("missing", F.filter(F.array(*(name(f) for f in fields)), lambda x: x.isNotNull())).withColumn("eligible", F.size("missing") == 0)


def missing_histogram(tasks: DataFrame) -> DataFrame:
    return tasks.select(F.explode("missing").alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def bank_status(tasks: DataFrame, low: int = BANK_MIN, high: int = BANK_MAX) -> DataFrame:
    """One row: eligible and reserved counts, status, and what blocks a bank that is not ready."""
    t = tasks.agg(F.count("*").alias("reserved"), F.coalesce(F.sum(F.col("eligible").cast("long")), F.lit(0)).alias("eligible"))
    status = F.when(F.col("eligible") < low, "below_minimum").when(F.col("eligible") > high, "above_maximum").otherwise("ready")
    hist = missing_histogram(tasks).agg(F.array_join(F.array_sort(F.collect_list(F.concat("field", F.lit("="), F.col("n").cast("string")))), ",").alias("blockers"))
    return t.withColumn("status", status).crossJoin(hist).withColumn("blockers", F.when(F.col("status") == "below_minimum", F.col("blockers")).otherwise(""))


def fill_evidence(groups: DataFrame, evidence: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Fill empty fields of groups from (task_id, field, value, pointer) rows, never replacing a
    value. Evidence without a pointer or for an unknown task is an error. Of several values of
    a field the smallest pointer's counts."""
    bad = evidence.filter("pointer is null").select("task_id").unionByName(evidence.join(groups.select(F.col("group_id").alias("task_id")), "task_id", "left_anti").select("task_id"))
    if not bad.isEmpty():
        raise ValueError("evidence names an unknown task or has no pointer")
    by = evidence.groupBy("task_id").agg(*(F.min_by(F.when(F.col("field") == f, F.col("value")), F.when((F.col("field") == f) & F.col("value").isNotNull(), F.col("pointer"))).alias(f"_{f}") for f in fields))
    out = groups.join(by.withColumnRenamed("task_id", "group_id"), "group_id", "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.when(F.col(f) != "", F.col(f)), F.col(f"_{f}"))).drop(f"_{f}")
    return out


def retry_dedup(sessions: DataFrame) -> DataFrame:
    """Of sessions with the same group and prompt hash the smallest reference stays."""
    w = Window.partitionBy("group_id", "prompt_sha256").orderBy("session_ref")
    return sessions.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def prompt_groups(sessions: DataFrame) -> DataFrame:
    """Sessions by prompt hash: sources, sessions, and whether the group is quarantined because
    the same prompt came from more than one source."""
    g = sessions.groupBy("prompt_sha256").agg(F.sort_array(F.collect_set("source")).alias("sources"), F.count("*").alias("n_sessions"), F.min("session_ref").alias("first_ref"))
    return g.withColumn("quarantined", F.size("sources") > 1)


# --- queries over the driver's tables ------------------------------------------------------


def _groups(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("group_id"))


def _frozen(spark, d):
    c = table(spark, d, "customer")
    return c.filter("c_custkey % 10 = 3").select(F.col("c_custkey").cast("string").alias("group_id"), F.lit("validation").alias("partition"))


def q_partition_assign(spark, d):
    return assign(_groups(spark, d), SALT, _frozen(spark, d)).select("group_id", "partition", "frozen")


def q_partition_counts(spark, d):
    return partition_counts(assign(_groups(spark, d), SALT))


def q_reserved_not_ready(spark, d):
    ok = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("group_id"))
    return reserved_not_ready(assign(_groups(spark, d), SALT), ok)


def _bank(spark, d):
    c = table(spark, d, "customer").withColumn("group_id", F.col("c_custkey").cast("string"))
    c = c.filter(canon.weighted_bucket(canon.unit_hash(SALT, F.col("group_id")), canon.PARTITIONS, canon.WEIGHTS) == "golden")
    t = c.select("group_id", F.col("c_name").alias("repository"), F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey").cast("string")).alias("start_revision"),
                 F.when(F.col("c_acctbal") > 0, "issue").otherwise("").alias("issue"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("oracle"), F.col("c_name").alias("prompt"))
    return missing_fields(t)


def q_golden_missing_hist(spark, d):
    return missing_histogram(_bank(spark, d))


def q_bank_status(spark, d):
    return bank_status(_bank(spark, d))


def _sessions(spark, d):
    """Conversations by their whole first prompts; every fifth comes once more as a retry."""
    c = table(spark, d, "conversations").filter("role = 'user'")
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("prompt"))
    first = first.unionByName(first.filter("conv_id % 5 = 0").select((F.col("conv_id") + 1000007).alias("conv_id"), "prompt"))
    return first.select(F.col("conv_id").alias("session_ref"), F.concat(F.lit("s"), (F.col("conv_id") % 4).cast("string")).alias("source"),
                        (F.col("conv_id") % 1000007 % 7).alias("group_id"), canon.sha256_hex(F.col("prompt")).alias("prompt_sha256"), "prompt")


def q_first_prompt(spark, d):
    return _sessions(spark, d).select("session_ref", canon.sha256_hex(F.col("prompt")).alias("prompt_sha256"), F.length("prompt").cast("long").alias("prompt_chars"))


def q_retry_dedup(spark, d):
    return retry_dedup(_sessions(spark, d)).select("group_id", "prompt_sha256", "session_ref")


def q_quarantine(spark, d):
    return prompt_groups(_sessions(spark, d)).select("prompt_sha256", F.array_join("sources", ",").alias("sources"), "n_sessions", "first_ref", "quarantined")


def q_evidence_fill(spark, d):
    g = table(spark, d, "customer").select(F.col("c_custkey").alias("group_id"), F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).otherwise("").alias("oracle"), F.when(F.col("c_nationkey") > 12, "rev").alias("revision"))
    o = table(spark, d, "orders")
    e = o.select(F.col("o_custkey").alias("task_id"), F.when(F.col("o_orderstatus") == "F", "oracle").otherwise("revision").alias("field"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("pointer"))
    e = e.join(g.select(F.col("group_id").alias("task_id")), "task_id", "left_semi")
    return fill_evidence(g, e, ["oracle", "revision"])


QUERIES = {
    "partition_assign": q_partition_assign, "partition_counts": q_partition_counts, "reserved_not_ready": q_reserved_not_ready,
    "golden_missing_hist": q_golden_missing_hist, "bank_status": q_bank_status, "first_prompt": q_first_prompt,
    "retry_dedup": q_retry_dedup, "quarantine": q_quarantine, "evidence_fill": q_evidence_fill,
}

_UNIT = "(('0x' || substr(sha256('quill-v1|' || c_custkey::VARCHAR), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"
_PART = f"CASE WHEN {_UNIT} < 0.35 THEN 'pruning' WHEN {_UNIT} < 0.35::DOUBLE + 0.2::DOUBLE THEN 'quant' WHEN {_UNIT} < 0.35::DOUBLE + 0.2::DOUBLE + 0.2::DOUBLE THEN 'recovery' WHEN {_UNIT} < 0.35::DOUBLE + 0.2::DOUBLE + 0.2::DOUBLE + 0.1::DOUBLE THEN 'validation' WHEN {_UNIT} < 0.35::DOUBLE + 0.2::DOUBLE + 0.2::DOUBLE + 0.1::DOUBLE + 0.1::DOUBLE THEN 'golden' ELSE 'torture' END"
_BANK = f"""b AS (SELECT c_custkey::VARCHAR AS group_id, [x for x in [CASE WHEN c_nationkey % 5 = 0 THEN 'start_revision' END,
  CASE WHEN c_acctbal <= 0 THEN 'issue' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'oracle' END] if x IS NOT NULL] AS missing FROM customer WHERE {_PART} = 'golden'),
h AS (SELECT field, count(*) AS n FROM (SELECT unnest(missing) AS field FROM b) GROUP BY field)"""
_SESS = """f AS (SELECT conv_id, arg_min(text, turn) AS prompt FROM conversations WHERE role = 'user' GROUP BY conv_id), g AS (SELECT * FROM f UNION ALL SELECT conv_id + 1000007, prompt FROM f WHERE conv_id % 5 = 0),
s AS (SELECT conv_id AS session_ref, 's' || (conv_id % 4)::VARCHAR AS source, conv_id % 1000007 % 7 AS group_id, prompt FROM g),
p AS (SELECT *, sha256(prompt) AS prompt_sha256 FROM s)"""

ORACLE_SQL = {
    "partition_assign": f"SELECT c_custkey::VARCHAR AS group_id, CASE WHEN c_custkey % 10 = 3 THEN 'validation' ELSE {_PART} END AS partition, c_custkey % 10 = 3 AS frozen FROM customer",
    "partition_counts": f"SELECT d.partition, count(c.p) AS n FROM (VALUES ('pruning'), ('quant'), ('recovery'), ('validation'), ('golden'), ('torture')) d(partition) LEFT JOIN (SELECT {_PART} AS p FROM customer) c ON c.p = d.partition GROUP BY d.partition",
    "reserved_not_ready": f"SELECT c_custkey::VARCHAR AS group_id, 'reserved_golden_missing_eligibility' AS reason FROM customer WHERE {_PART} = 'golden' AND NOT c_acctbal > 0",
    "golden_missing_hist": f"WITH {_BANK} SELECT field, n FROM h",
    "bank_status": f"""WITH {_BANK}, t AS (SELECT count(*) AS reserved, count(*) FILTER (WHERE len(missing) = 0) AS eligible FROM b),
u AS (SELECT *, CASE WHEN eligible < 50 THEN 'below_minimum' WHEN eligible > 200 THEN 'above_maximum' ELSE 'ready' END AS status FROM t)
SELECT reserved, eligible, status, CASE WHEN status = 'below_minimum' THEN (SELECT string_agg(field || '=' || n::VARCHAR, ',' ORDER BY field) FROM h) ELSE '' END AS blockers FROM u""",
    "first_prompt": f"WITH {_SESS} SELECT session_ref, sha256(prompt) AS prompt_sha256, length(prompt)::BIGINT AS prompt_chars FROM s",
    "retry_dedup": f"WITH {_SESS} SELECT group_id, prompt_sha256, min(session_ref) AS session_ref FROM p GROUP BY group_id, prompt_sha256",
    "quarantine": f"WITH {_SESS} SELECT prompt_sha256, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS n_sessions, min(session_ref) AS first_ref, count(DISTINCT source) > 1 AS quarantined FROM p GROUP BY prompt_sha256",
    "evidence_fill": """WITH e AS (SELECT o_custkey AS task_id, arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS o, arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderstatus <> 'F') AS r FROM orders GROUP BY o_custkey)
SELECT c_custkey AS group_id, CASE WHEN c_acctbal > 5000 THEN c_mktsegment ELSE o END AS oracle, CASE WHEN c_nationkey > 12 THEN 'rev' ELSE r END AS revision FROM customer LEFT JOIN e ON e.task_id = c_custkey""",
}
