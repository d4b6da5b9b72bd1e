"""Events to sequences, call and result correlation, bounded episodes and their labels.

Ordered scans are window functions over one session. A session's window sorts and spills;
it is never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import canon
from quillspark.plans.tables import table

CAP, RECOVERY, OVERSIZED = 64, 12, 16384


def over(*keys: str):
    return Window.partitionBy(*keys)


def event_seq(events: DataFrame) -> DataFrame:
    """Sequence numbers from 0 in each session by (line, block)."""
    return events.withColumn("seq", (F.row_number().over(over("session").orderBy("line", "block")) - 1).cast("long"))


def segment(events: DataFrame) -> DataFrame:
    """``turn`` of main-chain events: a user event opens an episode; 64 events close one, and an
    error result opens the next only then. ``episode`` counts the closed pieces."""
    e = events.filter(~F.col("sidechain"))
    w = over("session").orderBy("seq")
    user = (F.col("type") == "user").cast("long")
    e = e.withColumn("_seg", F.sum(user).over(w))
    pos = F.row_number().over(over("session", "_seg").orderBy("seq")) - 1
    e = e.withColumn("_chunk", F.floor(pos / CAP).cast("long")).withColumn("_start", pos % CAP == 0)
    opens = (F.col("type") == "user") | (F.col("_start") & (F.col("type") == "tool_result") & F.coalesce("is_error", F.lit(False)))
    return e.withColumn("turn", F.sum(opens.cast("long")).over(w)).withColumnRenamed("_seg", "segment").withColumnRenamed("_chunk", "chunk").drop("_start")


def is_spam(hint: Column, kind: Column, chars: Column) -> Column:
    return F.coalesce(hint, (kind == "tool_result") & (F.coalesce(chars, F.lit(0)) > OVERSIZED))


def is_verification(hint: Column, kind: Column, tool: Column) -> Column:
    """A known hint decides, also against the name."""
    return F.coalesce(hint, (kind == "tool_call") & F.coalesce(F.lower(tool).rlike("test|check|lint"), F.lit(False)))


def recovered(events: DataFrame, *keys: str) -> DataFrame:
    """``recovers``: an error with a good result or a verification within the next 12 events."""
    w = over(*keys).orderBy("seq").rowsBetween(1, RECOVERY)
    good = ((F.col("type") == "tool_result") & (F.col("is_error") == F.lit(False))) | ((F.col("type") == "tool_call") & F.col("verification"))
    error = (F.col("type") == "tool_result") & F.coalesce("is_error", F.lit(False))
    return events.withColumn("_good", F.max(F.coalesce(good, F.lit(False)).cast("int")).over(w)).withColumn("recovers", error & (F.coalesce("_good", F.lit(0)) == 1)).drop("_good")


def episode_weight(spam: Column, total: Column, decision: Column, verification: Column) -> Column:
    """0 for no events, else at least 0.05."""
    base = 1.0 - 0.5 * spam / total + F.when(decision, 0.2).otherwise(0.0) + F.least(verification, F.lit(3)) * 0.1
    return F.when(total == 0, 0.0).otherwise(F.greatest(F.lit(0.05), base))


def difficulty(span: Column, calls: Column, decision: Column, recovers: Column, verification: Column, long_context: Column) -> Column:
    return (F.when(long_context & recovers & (verification >= 1), "D4").when(recovers | long_context, "D3")
            .when(decision & ((span >= 16) | (calls >= 8)), "D2").when(decision, "D1").otherwise("D0"))


def correlate_by_name(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls and results without ids: the k-th call of a tool meets its k-th result. Both sides'
    leftovers stay, unmatched."""
    n = F.row_number().over(over("session", "tool").orderBy("seq"))
    c = calls.select("session", "tool", F.col("seq").alias("call_seq"), n.alias("k"))
    r = results.select("session", "tool", F.col("seq").alias("result_seq"), n.alias("k"))
    return c.join(r, ["session", "tool", "k"], "full_outer")


def correlate_by_id(events: DataFrame) -> DataFrame:
    """One row a (session, call id): the last call, the last result, and whether both are there."""
    last = lambda kind: F.max(F.when(F.col("type") == kind, F.col("seq")))
    g = events.filter("call_id is not null").groupBy("session", "call_id").agg(last("tool_call").alias("call_seq"), last("tool_result").alias("result_seq"))
    return g.withColumn("correlated", F.col("call_seq").isNotNull() & F.col("result_seq").isNotNull())


def next_match(events: DataFrame, keys: list[str], match: Column, value: Column, name: str) -> DataFrame:
    """``name``: ``value`` of the first later event that matches."""
    w = over(*keys).orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    return events.withColumn(name, F.first(F.when(match, value), ignorenulls=True).over(w))


# --- the driver's events as sessions of users ----------------------------------------------


def _events(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("session"), F.struct("ts", "event_id").alias("line"), F.lit(0).alias("block"), "event_type", "value", "props", "event_id", "ts")
    e = event_seq(e)
    kind = F.col("event_type")
    return e.select("session", "seq", "event_id", "ts", "value", F.when(kind == "signup", "user").when(kind.isin("view", "click"), "tool_call").otherwise("tool_result").alias("type"),
                    F.when(kind == "view", "read").when(kind == "click", "bash").when(kind == "purchase", "read").when(kind == "error", "bash").alias("tool"),
                    F.when(kind == "error", True).when(kind == "purchase", False).alias("is_error"), F.lit(False).alias("sidechain"), canon.sha256_hex(F.col("props")).alias("sha"))


def q_event_seq(spark, d):
    return _events(spark, d).select("session", "seq", "event_id", "type")


def q_correlate_positional(spark, d):
    e = _events(spark, d)
    return correlate_by_name(e.filter("type = 'tool_call'"), e.filter("type = 'tool_result'")).select("session", "tool", F.col("k").cast("long").alias("k"), "call_seq", "result_seq")


def q_unmatched(spark, d):
    m = q_correlate_positional(spark, d)
    return m.groupBy("session").agg(F.sum(F.col("result_seq").isNull().cast("long")).alias("unmatched_calls"), F.sum(F.col("call_seq").isNull().cast("long")).alias("unmatched_results"))


def _segmented(spark, d):
    e = segment(_events(spark, d))
    return e.withColumn("verification", (F.col("tool") == "bash") & (F.col("type") == "tool_call") & (F.col("value") > 30)).withColumn("spam", F.col("value") > 40)


def q_episodes(spark, d):
    return _segmented(spark, d).select("session", "seq", "turn", "segment", "chunk")


def _rollup(spark, d):
    e = recovered(_segmented(spark, d), "session", "segment", "chunk")
    calls = (F.col("type") == "tool_call").cast("long")
    return e.groupBy("session", "segment", "chunk").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n_events"), F.sum(calls).alias("tool_calls"), F.sum(F.col("verification").cast("long")).alias("verification"),
        F.sum(F.col("spam").cast("long")).alias("spam"), F.max("recovers").alias("recovered"), F.max(F.col("type") == "user").alias("decision"),
        F.array_join(F.transform(F.array_sort(F.collect_list("seq")), lambda x: x.cast("string")), ",").alias("event_seq"), F.min("seq").alias("_s"))


def q_episode_rollup(spark, d):
    return _rollup(spark, d).select("session", "segment", "chunk", "first_seq", "last_seq", "n_events", "tool_calls", "event_seq")


def q_recovered(spark, d):
    return _rollup(spark, d).select("session", "first_seq", "recovered")


def q_spam_verif(spark, d):
    return _rollup(spark, d).select("session", "first_seq", "spam", "verification")


def q_episode_weight(spark, d):
    w = episode_weight(F.col("spam"), F.col("n_events"), F.col("decision"), F.col("verification"))
    return _rollup(spark, d).select("session", "first_seq", F.round(w, 6).alias("weight"))


def q_difficulty(spark, d):
    c = difficulty(F.col("n_events"), F.col("tool_calls"), F.col("decision"), F.col("recovered"), F.col("verification"), (F.col("n_events") >= 12) & F.col("decision"))
    return _rollup(spark, d).select("session", "first_seq", c.alias("difficulty"))


#: Capabilities that a tool's name shows, and tools.
TOOL_CAPABILITIES = {"repo_exploration": ("read", "grep", "glob", "ls", "find"), "shell": ("bash", "shell", "terminal"), "verification": ("pytest", "test", "lint")}


def capabilities(tool: Column) -> Column:
    """Capabilities of a tool: its name is listed, or holds a listed name of over 3 letters."""
    name = F.lower(tool)
    tags = []
    for cap, names in sorted(TOOL_CAPABILITIES.items()):
        hit = name.isin(*names)
        for n in names:
            hit = hit | name.contains(n) if len(n) > 3 else hit
        tags.append(F.when(hit, F.lit(cap)))
    return F.filter(F.array(*tags), lambda x: x.isNotNull())


def q_capabilities(spark, d):
    e = _segmented(spark, d).filter("type = 'tool_call'")
    return e.groupBy("session", "segment", "chunk").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(capabilities(F.col("tool")))))), ",").alias("capabilities"))


def q_primary_tag(spark, d):
    e = _segmented(spark, d)
    g = e.groupBy("session", "segment", "chunk").agg(F.min_by("tool", F.when(F.col("type") == "tool_call", F.col("seq"))).alias("first_tool"), F.min(F.when(F.coalesce("is_error", F.lit(False)), F.col("seq"))).alias("error_seq"),
                                                     F.max(F.when(F.col("tool") == "read", F.col("seq"))).alias("edit_seq"))
    tag = F.when(F.col("edit_seq") > F.col("error_seq"), "debugging").when(F.col("edit_seq").isNotNull(), "implementation").when(F.col("first_tool") == "bash", "shell")
    return g.select("session", "segment", "chunk", tag.alias("primary_tag"))


def q_discovery_summary(spark, d):
    e = _events(spark, d)
    by = F.concat(F.lit("src"), (F.col("session") % 3).cast("string"))
    n = lambda c: F.sum(c.cast("long"))
    return e.groupBy(by.alias("source")).agg(F.countDistinct("session").alias("sessions"), F.count("*").alias("events"), n(F.col("type") == "user").alias("user_events"), n(F.col("type") == "tool_call").alias("tool_calls"),
                                             n(F.coalesce("is_error", F.lit(False))).alias("errors"), F.countDistinct("sha").alias("distinct_args"))


def q_async_followup(spark, d):
    e = next_match(_events(spark, d), ["session"], F.col("type") == "tool_result", F.col("event_id"), "followup")
    return e.filter("type = 'tool_call'").select("session", "seq", "followup")


def q_error_handled(spark, d):
    e = next_match(_events(spark, d), ["session"], F.col("type") == "user", F.lit(True), "later")
    return e.filter("is_error").groupBy("session").agg(F.count("*").alias("errors"), F.count("later").alias("handled"))


def q_head_before_op(spark, d):
    e = _events(spark, d)
    op = e.filter("tool = 'bash' and type = 'tool_call'").groupBy("session").agg(F.min("seq").alias("op_seq"))
    return e.join(op, "session", "left").filter("type = 'user' and (op_seq is null or seq < op_seq)").groupBy("session").agg(F.min_by("sha", "seq").alias("head"))


def linked(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """(target, session, rule): pairs of sessions that share a key; the first key in order that they
    share is the rule. One equi-join a key, on written keys."""
    out = None
    for n, k in enumerate(keys, 1):
        a = sessions.filter(F.col(k).isNotNull()).select(F.col("session").alias("target"), k)
        one = a.join(sessions.select("session", k), k).filter("target <> session").select("target", "session", F.lit(n).cast("long").alias("rule"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("target", "session").agg(F.min("rule").alias("rule"))


def q_linked_sessions(spark, d):
    """Sessions linked by the content of their first user event, else by the second it came in."""
    s = _events(spark, d).filter("type = 'user'").groupBy("session").agg(F.min_by("sha", "seq").alias("sha"), F.min_by("ts", "seq").alias("ts"))
    return linked(s.select("session", "sha", F.date_trunc("hour", "ts").alias("hour")), ["sha", "hour"])


def q_conv_turns(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum((F.col("role") == "user").cast("long")).alias("user_turns"), F.max_by("role", "turn").alias("last_role"))


QUERIES = {f.__name__[2:]: f for f in (q_event_seq, q_correlate_positional, q_unmatched, q_episodes, q_episode_rollup, q_recovered, q_spam_verif, q_episode_weight, q_difficulty, q_capabilities, q_primary_tag,
                                       q_discovery_summary, q_async_followup, q_error_handled, q_head_before_op, q_linked_sessions, q_conv_turns)}

_E = """e AS (SELECT user_id AS session, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS seq, event_id, ts, value, sha256(props) AS sha,
  CASE WHEN event_type = 'signup' THEN 'user' WHEN event_type IN ('view', 'click') THEN 'tool_call' ELSE 'tool_result' END AS type,
  CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'bash' WHEN 'purchase' THEN 'read' WHEN 'error' THEN 'bash' END AS tool, event_type = 'error' AS is_error FROM events)"""
_M = _E + """, c AS (SELECT *, row_number() OVER (PARTITION BY session, tool ORDER BY seq) AS k FROM e WHERE type = 'tool_call'),
r AS (SELECT *, row_number() OVER (PARTITION BY session, tool ORDER BY seq) AS k FROM e WHERE type = 'tool_result'),
m AS (SELECT session, tool, k, c.seq AS call_seq, r.seq AS result_seq FROM c FULL JOIN r USING (session, tool, k))"""
_S = _E + """, a AS (SELECT *, sum((type = 'user')::INT) OVER (PARTITION BY session ORDER BY seq) AS segment FROM e),
b AS (SELECT *, row_number() OVER (PARTITION BY session, segment ORDER BY seq) - 1 AS pos FROM a),
s AS (SELECT *, (pos // 64)::BIGINT AS chunk, sum((type = 'user' OR (pos % 64 = 0 AND type = 'tool_result' AND is_error))::INT) OVER (PARTITION BY session ORDER BY seq) AS turn,
  tool = 'bash' AND type = 'tool_call' AND value > 30 AS verification, value > 40 AS spam FROM b),
v AS (SELECT *, type = 'tool_result' AND is_error AND coalesce(max((coalesce(type = 'tool_result' AND NOT is_error, false) OR coalesce(type = 'tool_call' AND verification, false))::INT) OVER (PARTITION BY session, segment, chunk ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING), 0) = 1 AS recovers FROM s),
u AS (SELECT session, segment::BIGINT AS segment, chunk, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_events, count(*) FILTER (WHERE type = 'tool_call') AS tool_calls, count(*) FILTER (WHERE verification) AS verification,
  count(*) FILTER (WHERE spam) AS spam, bool_or(recovers) AS recovered, bool_or(type = 'user') AS decision, string_agg(seq::VARCHAR, ',' ORDER BY seq) AS event_seq FROM v GROUP BY ALL)"""
ORACLE_SQL = {
    "event_seq": f"WITH {_E} SELECT session, seq, event_id, type FROM e",
    "correlate_positional": f"WITH {_M} SELECT * FROM m",
    "unmatched": f"WITH {_M} SELECT session, count(*) FILTER (WHERE result_seq IS NULL) AS unmatched_calls, count(*) FILTER (WHERE call_seq IS NULL) AS unmatched_results FROM m GROUP BY session",
    "episodes": f"WITH {_S} SELECT session, seq, turn::BIGINT AS turn, segment::BIGINT AS segment, chunk FROM s",
    "episode_rollup": f"WITH {_S} SELECT session, segment, chunk, first_seq, last_seq, n_events, tool_calls, event_seq FROM u",
    "recovered": f"WITH {_S} SELECT session, first_seq, recovered FROM u",
    "spam_verif": f"WITH {_S} SELECT session, first_seq, spam, verification FROM u",
    "episode_weight": f"WITH {_S} SELECT session, first_seq, round(greatest(0.05::DOUBLE, 1::DOUBLE - 0.5::DOUBLE * spam / n_events + CASE WHEN decision THEN 0.2::DOUBLE ELSE 0 END + least(verification, 3) * 0.1::DOUBLE), 6) AS weight FROM u",
    "difficulty": f"WITH {_S} SELECT session, first_seq, CASE WHEN n_events >= 12 AND decision AND recovered AND verification >= 1 THEN 'D4' WHEN recovered OR (n_events >= 12 AND decision) THEN 'D3' WHEN decision AND (n_events >= 16 OR tool_calls >= 8) THEN 'D2' WHEN decision THEN 'D1' ELSE 'D0' END AS difficulty FROM u",
    "capabilities": f"WITH {_S} SELECT session, segment::BIGINT AS segment, chunk, string_agg(DISTINCT CASE tool WHEN 'read' THEN 'repo_exploration' ELSE 'shell' END, ',' ORDER BY CASE tool WHEN 'read' THEN 'repo_exploration' ELSE 'shell' END) AS capabilities FROM s WHERE type = 'tool_call' GROUP BY ALL",
    "primary_tag": f"WITH {_S}, g AS (SELECT session, segment::BIGINT AS segment, chunk, arg_min(tool, seq) FILTER (WHERE type = 'tool_call') AS ft, min(seq) FILTER (WHERE is_error) AS es, max(seq) FILTER (WHERE tool = 'read') AS ed FROM s GROUP BY ALL) SELECT session, segment, chunk, CASE WHEN ed > es THEN 'debugging' WHEN ed IS NOT NULL THEN 'implementation' WHEN ft = 'bash' THEN 'shell' END AS primary_tag FROM g",
    "discovery_summary": f"WITH {_E} SELECT 'src' || (session % 3)::VARCHAR AS source, count(DISTINCT session) AS sessions, count(*) AS events, count(*) FILTER (WHERE type = 'user') AS user_events, count(*) FILTER (WHERE type = 'tool_call') AS tool_calls, count(*) FILTER (WHERE is_error) AS errors, count(DISTINCT sha) AS distinct_args FROM e GROUP BY 1",
    "async_followup": f"WITH {_E}, f AS (SELECT *, first(CASE WHEN type = 'tool_result' THEN event_id END IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS followup FROM e) SELECT session, seq, followup FROM f WHERE type = 'tool_call'",
    "error_handled": f"WITH {_E}, f AS (SELECT *, max(CASE WHEN type = 'user' THEN seq END) OVER (PARTITION BY session) AS lu FROM e) SELECT session, count(*) AS errors, count(*) FILTER (WHERE lu > seq) AS handled FROM f WHERE is_error GROUP BY session",
    "head_before_op": f"WITH {_E}, o AS (SELECT session, min(seq) AS op_seq FROM e WHERE tool = 'bash' AND type = 'tool_call' GROUP BY session) SELECT session, arg_min(sha, seq) AS head FROM e LEFT JOIN o USING (session) WHERE type = 'user' AND (op_seq IS NULL OR seq < op_seq) GROUP BY session",
    "linked_sessions": f"WITH {_E}, s AS (SELECT session, arg_min(sha, seq) AS sha, date_trunc('hour', arg_min(ts, seq)) AS h FROM e WHERE type = 'user' GROUP BY session) SELECT t.session AS target, s.session, CASE WHEN t.sha = s.sha THEN 1 ELSE 2 END::BIGINT AS rule FROM s t JOIN s ON t.session <> s.session AND (t.sha = s.sha OR t.h = s.h)",
    "conv_turns": "SELECT conv_id, count(*) AS n_turns, count(*) FILTER (WHERE role = 'user') AS user_turns, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id",
}
