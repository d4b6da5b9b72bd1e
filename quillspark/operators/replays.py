"""Ordered sessions, budgeted prefixes, replay totals and control summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.plans.tables import table


def started_ended(events: DataFrame, key: str, order: str, ts: str) -> DataFrame:
    """(key, started, ended): the first and last timestamp that is not null, in event order.
    A session without any has null for both."""
    known = F.when(F.col(ts).isNotNull(), F.col(order))
    return events.groupBy(key).agg(F.min_by(ts, known).alias("started"), F.max_by(ts, known).alias("ended"))


def branching(entries: DataFrame, key: str, order: str) -> DataFrame:
    """(key, forks): entries whose parent is given and is not the entry before."""
    last = F.lag("id").over(Window.partitionBy(key).orderBy(order))
    fork = last.isNotNull() & F.col("parent").isNotNull() & (F.col("parent") != last)
    return entries.select(key, fork.alias("fork")).groupBy(key).agg(F.count_if("fork").alias("forks"))


def place(rows: DataFrame, key: str) -> DataFrame:
    """Rows with ``place``, from 0, by their sequence number where there is one, else by position."""
    by = Window.partitionBy(key).orderBy(F.coalesce("sequence", "position"), "position")
    return rows.withColumn("place", (F.row_number().over(by) - 1).cast("long"))


def budget_prefix(parts: DataFrame, key: str, order: str, budgets: Sequence[int]) -> DataFrame:
    """(key, budget, parts, rows, reached): the shortest prefix of a key's parts, one at least,
    whose rows reach each budget of an ascending schedule; all parts where none does."""
    if list(budgets) != sorted(budgets):
        raise ValueError("budgets must ascend")
    w = Window.partitionBy(key).orderBy(order)
    sums = parts.withColumn("upto", F.sum("rows").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.row_number().over(w))
    before = F.col("upto") - F.col("rows")
    each = sums.withColumn("budget", F.explode(F.array(*(F.lit(int(b)).cast("long") for b in budgets))))
    taken = each.filter((before < F.col("budget")) | (F.col("n") == 1)).groupBy(key, "budget").agg(F.count("*").alias("parts"), F.sum("rows").alias("rows"))
    return taken.withColumn("reached", F.col("rows") >= F.col("budget"))


def control_summary(records: DataFrame, side: str) -> DataFrame:
    """Negative controls of each side: records, successes, pass rate, catastrophes."""
    c = records.filter("record_type = 'negative_control'").groupBy(side)
    return c.agg(F.count("*").alias("records"), F.count_if("success").alias("successes"), (F.count_if("success") / F.count("*")).alias("pass_rate"), F.count_if("catastrophic").alias("catastrophes"))


def wave_totals(attempts: DataFrame, key: str) -> DataFrame:
    """Totals of a wave of requests (start and end in seconds, status, tokens): wall time, counts by
    status, tokens of successful ones by second, successful ones by hour; null without wall time."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    tokens = F.coalesce(F.sum(F.when(F.col("status") == "ok", F.col("tokens"))), F.lit(0)).alias("tokens")
    g = attempts.groupBy(key).agg((F.max("end") - F.min("start")).alias("wall"), tokens, *map(n, ("ok", "failed", "timeout", "parse_error")))
    rate = lambda c, unit: F.when(F.col("wall") > 0, F.round(F.col(c) * F.lit(unit) / F.col("wall"), 3))
    return g.withColumn("tokens_per_s", rate("tokens", 1.0)).withColumn("ok_per_hour", rate("ok", 3600.0))


def counter_delta(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What each counter of ``after`` gained; one that ``before`` lacks began at zero."""
    b = before.select(*keys, F.col("count").alias("was"))
    return after.join(b, list(keys), "left").select(*keys, (F.col("count") - F.coalesce("was", F.lit(0))).alias("delta"))


def has_trio(rows: DataFrame, key: str, order: str, shift: str, convert: str) -> DataFrame:
    """(key, unpacks): whether three mnemonics in a row hold a shift among the first two and a
    conversion anywhere. ``shift`` and ``convert`` are patterns."""
    w = Window.partitionBy(key).orderBy(order)
    t = rows.select(key, F.col("mnemonic").alias("a"), F.lead("mnemonic", 1).over(w).alias("b"), F.lead("mnemonic", 2).over(w).alias("c"))
    hit = (F.col("a").rlike(shift) | F.col("b").rlike(shift)) & (F.col("a").rlike(convert) | F.col("b").rlike(convert) | F.col("c").rlike(convert))
    return t.groupBy(key).agg(F.coalesce(F.bool_or(hit & F.col("c").isNotNull()), F.lit(False)).alias("unpacks"))


def prompt_groups(sessions: DataFrame, explicit: DataFrame) -> DataFrame:
    """(digest, sessions, sources) of sessions that no explicit group covers; groups left without
    a session are absent."""
    rest = sessions.join(explicit.select("session").distinct(), "session", "left_anti")
    return rest.groupBy("digest").agg(F.count("*").alias("sessions"), F.array_sort(F.collect_set("source")).alias("sources"))


def complement(sets: DataFrame, column: str, size: int) -> DataFrame:
    """``sets`` with ``kept``: what of 0 to size - 1 a set lacks, ascending."""
    return sets.withColumn("kept", F.array_except(F.sequence(F.lit(0), F.lit(size - 1)), F.col(column).cast("array<int>")))


def order_prefix(rows: DataFrame, key: str, order: Sequence[Column], take: DataFrame) -> DataFrame:
    """The first ``n`` rows of each key, ``n`` from ``take`` (one row a key); an error where a key
    has fewer."""
    w = Window.partitionBy(key)
    r = rows.join(take, key).withColumn("at", F.row_number().over(w.orderBy(*order))).withColumn("size", F.count("*").over(w))
    ok = F.when(F.col("n") > F.col("size"), F.raise_error(F.lit("more rows are asked of a key than it has")).cast("boolean")).otherwise(F.col("at") <= F.col("n"))
    return r.filter(ok).drop("size", "n")


def sigmoid(v: Column) -> Column:
    """Without overflow for any finite value."""
    return F.when(v >= 0, 1 / (1 + F.exp(-v))).otherwise(F.exp(v) / (1 + F.exp(v)))


def log_sigmoid(v: Column) -> Column:
    return F.when(v >= 0, -F.log1p(F.exp(-v))).otherwise(v - F.log1p(F.exp(v)))


# --- queries ------------------------------------------------------------------------------


def q_started_ended(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.unix_micros(F.col("ts").cast("timestamp"))).alias("us"))
    return started_ended(e, "user_id", "event_id", "us")


def q_branching(spark, d):
    last = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    e = table(spark, d, "events").withColumn("parent", F.when(F.col("event_type") == "refund", F.col("event_id") - 1).otherwise(last))
    return branching(e.withColumnRenamed("event_id", "id").withColumn("at", F.col("id")), "user_id", "at")


def q_session_place(spark, d):
    e = table(spark, d, "events").withColumn("position", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    e = e.withColumn("sequence", F.when(F.col("event_type") != "error", F.col("position") * 7 % 13))
    return place(e, "user_id").select("event_id", "place")


def q_budget_prefix(spark, d):
    size = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("rows"))
    return budget_prefix(table(spark, d, "orders").select("o_custkey", "o_orderkey").join(size, "o_orderkey"), "o_custkey", "o_orderkey", [8, 32, 64])


def q_control_summary(spark, d):
    kind = F.when(F.col("o_orderpriority").startswith("1"), "negative_control").otherwise("task")
    o = table(spark, d, "orders").select(kind.alias("record_type"), F.col("o_orderstatus").alias("side"), (F.col("o_totalprice") > 150000).alias("success"), (F.col("o_totalprice") < 20000).alias("catastrophic"))
    return control_summary(o, "side")


def q_wave_totals(spark, d):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "refund", "timeout").otherwise("ok")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").select("user_id", at.alias("start"), (at + 30).alias("end"), status.alias("status"), F.floor("value").alias("tokens"))
    return wave_totals(e, "user_id")


def q_counter_delta(spark, d):
    e = table(spark, d, "events")
    keys = ["user_id", "event_type"]
    return counter_delta(e.filter("value <= 40").groupBy(*keys).count(), e.groupBy(*keys).count(), keys)


def q_trio_pattern(spark, d):
    return has_trio(table(spark, d, "events").withColumnRenamed("event_type", "mnemonic"), "user_id", "event_id", "^click", "^(refund|purchase)")


def q_prompt_groups(spark, d):
    s = table(spark, d, "documents").select(F.col("doc_id").alias("session"), "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    g = prompt_groups(s, table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("session")))
    return g.withColumn("sources", F.array_join("sources", ","))


def q_complement(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.hour(F.col("ts").cast("timestamp"))).alias("hours"))
    return complement(e, "hours", 24).select("user_id", F.array_join("kept", ",").alias("kept"))


def q_order_prefix(spark, d):
    x = table(spark, d, "documents").select("lang", "doc_id", "n_chars")
    n = x.groupBy("lang").agg(F.ceil(F.count("*") / 4).alias("n"))
    return order_prefix(x, "lang", [F.col("n_chars").desc(), F.col("doc_id")], n).select("lang", "doc_id", F.col("at").cast("long").alias("at"))


def q_sigmoid(spark, d):
    v = (F.col("value") - 50) / 25
    return table(spark, d, "events").select("event_id", sigmoid(v).alias("sigmoid"), log_sigmoid(v).alias("log_sigmoid"))


QUERIES = {f.__name__[2:]: f for f in (q_started_ended, q_branching, q_session_place, q_budget_prefix, q_control_summary, q_wave_totals, q_counter_delta, q_trio_pattern, q_prompt_groups, q_complement, q_order_prefix, q_sigmoid)}

ORACLE_SQL = {
    "started_ended": "SELECT user_id, epoch_us(arg_min(ts, event_id) FILTER (WHERE event_type <> 'error')) AS started, epoch_us(arg_max(ts, event_id) FILTER (WHERE event_type <> 'error')) AS ended FROM events GROUP BY user_id",
    "branching": "WITH e AS (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM events) SELECT user_id, count(*) FILTER (WHERE event_type = 'refund' AND last <> event_id - 1) AS forks FROM e GROUP BY user_id",
    "session_place": "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p FROM events) SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type <> 'error' THEN p * 7 % 13 ELSE p END, p) - 1 AS place FROM e",
    "budget_prefix": """WITH p AS (SELECT o_custkey, o_orderkey, count(*) AS rows FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
s AS (SELECT *, sum(rows) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS upto FROM p), b(budget) AS (VALUES (8::BIGINT), (32), (64)),
f AS (SELECT o_custkey, budget, min(o_orderkey) FILTER (WHERE upto >= budget) AS last FROM s, b GROUP BY ALL)
SELECT o_custkey, budget, count(*) AS parts, sum(rows)::BIGINT AS rows, sum(rows) >= budget AS reached FROM f JOIN p USING (o_custkey) WHERE last IS NULL OR o_orderkey <= last GROUP BY o_custkey, budget""",
    "control_summary": "SELECT o_orderstatus AS side, count(*) AS records, count(*) FILTER (WHERE o_totalprice > 150000) AS successes, avg((o_totalprice > 150000)::INT) AS pass_rate, count(*) FILTER (WHERE o_totalprice < 20000) AS catastrophes FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1",
    "wave_totals": """WITH g AS (SELECT user_id, max(epoch(ts)::BIGINT) + 30 - min(epoch(ts)::BIGINT) AS wall, coalesce(sum(floor(value)) FILTER (WHERE event_type NOT IN ('error', 'refund')), 0)::BIGINT AS tokens, count(*) FILTER (WHERE event_type NOT IN ('error', 'refund')) AS ok,
count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'refund') AS timeout, 0::BIGINT AS parse_error FROM (SELECT * REPLACE (date_trunc('second', ts) AS ts) FROM events) GROUP BY user_id) SELECT *, round(tokens / wall, 3) AS tokens_per_s, round(ok * 3600 / wall, 3) AS ok_per_hour FROM g""",
    "counter_delta": "SELECT user_id, event_type, count(*) - count(*) FILTER (WHERE value <= 40) AS delta FROM events GROUP BY ALL",
    "trio_pattern": "WITH t AS (SELECT user_id, event_type AS a, lead(event_type, 1) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, coalesce(bool_or('click' IN (a, b) AND ('refund' IN (a, b, c) OR 'purchase' IN (a, b, c))) FILTER (WHERE c IS NOT NULL), false) AS unpacks FROM t GROUP BY user_id",
    "prompt_groups": "SELECT sha256(coalesce(text, '')) AS digest, count(*) AS sessions, coalesce(string_agg(DISTINCT source, ',' ORDER BY source), '') AS sources FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1",
    "complement": "WITH h AS (SELECT user_id, list(DISTINCT hour(ts)) AS h FROM events GROUP BY user_id) SELECT user_id, array_to_string(list_filter(range(24), lambda x: NOT list_contains(h, x)), ',') AS kept FROM h",
    "order_prefix": """WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS "at", count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT lang, doc_id, "at" FROM r WHERE "at" <= ceil(n / 4)""",
    "sigmoid": "SELECT event_id, 1 / (1 + exp((50 - value) / 25)) AS sigmoid, -ln(1 + exp((50 - value) / 25)) AS log_sigmoid FROM events",
}
