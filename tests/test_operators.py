"""Hand-made fixtures and sequential equivalents."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from quillspark.functions import canon, textops
from quillspark.operators import episodes, evalstats, models, tasks
from quillspark.sources import records
from quillspark.streaming import incremental


def test_unit_hash_matches_python(spark):
    import hashlib

    rows = [(str(i),) for i in range(500)]
    got = {r.k: r.u for r in spark.createDataFrame(rows, "k string").select("k", canon.unit_hash("s", F.col("k")).alias("u")).collect()}
    for (k,) in rows:
        assert got[k] == int(hashlib.sha256(f"s|{k}".encode()).hexdigest()[:16], 16) / float(16**16)


def test_weights_must_sum_to_one():
    with pytest.raises(ValueError):
        canon.weighted_bucket(F.lit(0.5), ["a", "b"], {"a": 0.5, "b": 0.4})


def test_redaction_kinds(spark):
    fake = {"aws_access_key": "AKIA" + "A1" * 8, "github_token": "ghp_" + "a" * 36, "jwt": "eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 12, "secret_assignment": "password = " + "q" * 14, "openai_key": "sk-ant-" + "a" * 30, "long_hex_secret": "0f" * 40}
    df = textops.redacted(spark.createDataFrame([(k, f"x {v} y") for k, v in fake.items()] + [("none", "plain"), ("null", None)], "k string, text string"), "text")
    got = {r.k: r for r in df.collect()}
    for k in fake:
        assert got[k].kinds == k and got[k].hits == 1 and f"[REDACTED:{k}]" in got[k].text_redacted
    assert got["none"].hits == 0 and got["null"].text_redacted == ""


def sequential(events):
    turn, cur, out = 0, 0, []
    for seq, kind, err in events:
        if kind == "user":
            turn, cur = turn + 1, 1
        elif kind == "tool_result" and err and not cur:
            turn, cur = turn + 1, 1
        else:
            cur += 1
        out.append((seq, turn))
        if cur >= 64 and kind != "user":
            cur = 0
    return out


def test_segmentation_equals_a_sequential_scan(spark):
    rng, rows, want = random.Random(4), [], {}
    for s in range(12):
        ev = [(i, rng.choices(["user", "tool_call", "tool_result"], [0.01, 0.5, 0.5])[0], rng.random() < 0.3) for i in range(300)]
        rows += [(s, i, k, e if k == "tool_result" else None, False) for i, k, e in ev]
        want[s] = dict(sequential(ev))
    got = episodes.segment(spark.createDataFrame(rows, "session int, seq long, type string, is_error boolean, sidechain boolean"))
    for r in got.collect():
        assert want[r.session][r.seq] == r.turn


def test_mcnemar():
    assert evalstats.mcnemar(3, 0) == pytest.approx(0.25)
    assert evalstats.mcnemar(0, 0) == 1.0
    assert 0 <= evalstats.mcnemar(4000, 3000) < 1e-20


def test_gates_unmeasured_never_pass(spark):
    df = spark.createDataFrame([(1, True, None), (2, False, 9.0), (3, True, 9.0)], "id int, measured boolean, m double")
    assert {r.id: r.verdict for r in evalstats.gates(df, [("m", ">=", 5)]).collect()} == {1: "unmeasured", 2: "unmeasured", 3: "pass"}


def test_evidence_without_pointer_is_refused(spark):
    g = spark.createDataFrame([("a", "")], "group_id string, oracle string")
    e = spark.createDataFrame([("a", "oracle", "v", None)], "task_id string, field string, value string, pointer string")
    with pytest.raises(ValueError):
        tasks.fill_evidence(g, e, ["oracle"])


def test_lru_equals_greedy(spark):
    rng = random.Random(2)
    rows = [(p, i, rng.randrange(100), rng.randrange(50)) for p in range(20) for i in range(30)]
    df = models.over_quota(spark.createDataFrame(rows, "pool int, id int, bytes long, last_accessed int"), "pool", 700)
    got = {(r.pool, r.id): r.evict for r in df.collect()}
    for p in range(20):
        mine = sorted((r for r in rows if r[0] == p), key=lambda r: (r[3], r[1]))
        total = sum(r[2] for r in mine)
        for r in mine:
            assert got[p, r[1]] == (total > 700)
            total -= r[2] if total > 700 else 0


def test_transcripts(spark, tmp_path):
    lines = [json.dumps({"type": "user", "uuid": "a", "message": {"role": "user", "content": "hi"}}), "not json", "[1]", "",
             json.dumps({"type": "assistant", "uuid": "b", "parentUuid": "a", "message": {"role": "assistant", "content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "id": "t1", "name": "bash", "input": {}}]}}),
             json.dumps({"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "done", "is_error": True}]}})]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "s.jsonl").write_text("\n".join(lines))
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "s.jsonl").write_text(json.dumps({"payload": {"type": "function_call", "call_id": "k", "name": "sh"}}) + "\n" + json.dumps({"payload": {"type": "function_call_output", "call_id": "k", "output": "Error: no"}}))
    got = records.transcripts(spark, {"claude": str(tmp_path / "c"), "codex": str(tmp_path / "x")}).orderBy("source", "seq").collect()
    assert [(r.source, r.seq, r.type, r.call_id, r.is_error) for r in got] == [("claude", 0, "user", None, None), ("claude", 1, "assistant", None, None), ("claude", 2, "tool_call", "t1", None), ("claude", 3, "tool_result", "t1", True),
                                                                              ("codex", 0, "tool_call", "k", None), ("codex", 1, "tool_result", "k", True)]
    e = records.transcripts(spark, {"claude": str(tmp_path / "c")}).withColumnRenamed("file", "session")
    assert [r.correlated for r in episodes.correlate_by_id(e).collect()] == [True]


def test_tensor_headers(spark, tmp_path):
    head = json.dumps({"a": {"dtype": "F16", "shape": [2, 3], "data_offsets": [0, 12]}, "b": {"dtype": "U8", "shape": [4], "data_offsets": [12, 16]}}).encode()
    (tmp_path / "m.bin").write_bytes(struct.pack("<Q", len(head)) + head + bytes(16))
    assert [(r.name, r.shape, r.bytes) for r in records.tensor_headers(spark, str(tmp_path)).collect()] == [("a", [2, 3], 12), ("b", [4], 4)]
    (tmp_path / "n.bin").write_bytes(struct.pack("<Q", len(head)) + head + bytes(15))
    with pytest.raises(Exception, match="cover"):
        records.tensor_headers(spark, str(tmp_path / "n.bin")).collect()


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    schema = "group_id string, n long"
    for k, rows in enumerate(([("a", 1), ("b", 2)], [("b", 5), ("c", 7)])):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        q = spark.readStream.schema(schema).parquet(src).writeStream.foreachBatch(incremental.merge_counts(out + "/n", ["group_id"], "n")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        q = spark.readStream.schema(schema).parquet(src).writeStream.foreachBatch(incremental.place_new(out + "/p", "s")).option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {r.group_id: r.n for r in incremental.merged(spark, out + "/n", ["group_id"], "n").collect()} == {"a": 1, "b": 7, "c": 7}
    placed = spark.read.parquet(out + "/p")
    assert sorted(r.group_id for r in placed.collect()) == ["a", "b", "c"]


def test_swap_descent_reaches_a_local_optimum():
    rng = random.Random(8)
    for _ in range(30):
        w = {(i, j): rng.randrange(10) for i in range(10) for j in range(10)}
        cost = lambda c: sum(w[i, j] for i in c for j in c)
        got = models.swap_descent(w, 10, [0, 1, 2, 3], passes=50)
        assert cost(got) <= cost([0, 1, 2, 3]) and len(got) == 4
        assert all(cost((set(got) - {x}) | {y}) >= cost(got) for x in got for y in set(range(10)) - set(got))


def test_selection_takes_the_least_subset_and_the_first_of_equals(spark):
    rng = random.Random(5)
    import itertools

    for layer in range(3):
        f = {(i, j): rng.randrange(3) for i in range(8) for j in range(8)}
        rows = [(layer, i, j, v) for (i, j), v in f.items() if v]
        got = models.exhaustive_select(spark.createDataFrame(rows, "layer int, i int, j int, f long"), 8, 4).first()
        cost = {c: sum(f[i, j] for i in c for j in c) for c in itertools.combinations(range(8), 4)}
        best = min(cost.values())
        assert (got.objective, tuple(got.pruned), got.ties) == (best, min(c for c in cost if cost[c] == best), sum(v == best for v in cost.values()))


def test_levels_refuse_repeats(spark):
    rows = [(1, 1, "pass", True), (1, 2, "pass", False), (2, 3, "fail", True)]
    schema = "candidate_id int, level int, verdict string, has_evidence boolean"
    got = {(r.candidate_id, r.level): (r.verdict, r.overall) for r in evalstats.level_rollup(spark.createDataFrame(rows, schema)).collect()}
    assert got[1, 1] == ("pass", "unmeasured") and got[1, 2][0] == "unmeasured" and got[2, 3] == ("fail", "fail") and len(got) == 14
    with pytest.raises(ValueError):
        evalstats.level_rollup(spark.createDataFrame([*rows, (1, 1, "fail", True)], schema))


def test_quotas_add_up(spark):
    rng = random.Random(6)
    for total in (0, 3, 20, 500):
        rows = [(f"s{k}", rng.randrange(1, 40)) for k in range(9)]
        got = {r.stratum: r.quota for r in evalstats.quotas(spark.createDataFrame(rows, "stratum string, size long"), total).collect()}
        floors = sum(min(2, n) for _, n in rows)
        assert sum(got.values()) == max(floors, min(total, sum(n for _, n in rows))) and all(min(2, n) <= got[s] <= n for s, n in rows)


def test_paired_test_needs_one_seed_a_task(spark):
    schema = "task_id int, seed int, success boolean"
    a = spark.createDataFrame([(1, 1, True), (2, 1, False), (3, 1, False)], schema)
    b = spark.createDataFrame([(1, 1, False), (2, 1, True), (3, 1, False)], schema)
    assert tuple(evalstats.discordant(evalstats.pair(a, b, ["task_id", "seed"])).first()) == (3, 0, 1, 1)
    c = spark.createDataFrame([(1, 1, True), (1, 2, False)], schema)
    assert evalstats.discordant(evalstats.pair(c, c, ["task_id", "seed"])).first().repeated == 1
    m = evalstats.wins_losses(evalstats.cluster_means(evalstats.pair(c, c, ["task_id", "seed"]))).first()
    assert (m.wins, m.losses, m.ties, m.ratio) == (0, 0, 1, 1.0)


def test_canonical_json_keeps_nulls(spark):
    got = spark.range(1).select(canon.canonical_json(b=F.lit(1), a=F.lit(None).cast("string"))).first()[0]
    assert got == '{"a":null,"b":1}'
