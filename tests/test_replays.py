"""Hand values of ordered sessions, prefixes and replay totals."""

import math

import pytest
from pyspark.sql import functions as F

from quillspark.operators import replays as R


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_started_ended(spark):
    e = spark.createDataFrame([(1, 0, None), (1, 1, 50), (1, 2, 10), (1, 3, None), (2, 0, None)], "s int, n int, ts long")
    assert got(R.started_ended(e, "s", "n", "ts").filter("s = 1")) == [(1, 50, 10)]
    assert R.started_ended(e, "s", "n", "ts").filter("s = 2").first()[1:] == (None, None)
    assert got(R.started_ended(e.limit(0), "s", "n", "ts")) == []


def test_branching(spark):
    e = spark.createDataFrame([(1, 0, "a", None), (1, 1, "b", "a"), (1, 2, "c", "a"), (1, 3, "d", None)], "s int, n int, id string, parent string")
    assert got(R.branching(e, "s", "n")) == [(1, 1)]


def test_place(spark):
    e = spark.createDataFrame([(1, 0, 2), (1, 1, None), (1, 2, 0), (1, 3, 0)], "s int, position int, sequence int")
    assert got(R.place(e, "s").select("place", "position")) == [(0, 2), (1, 3), (2, 1), (3, 0)]


def test_budget_prefix(spark):
    p = spark.createDataFrame([("x", 1, 3), ("x", 2, 4), ("x", 3, 0), ("x", 4, 1)], "k string, n int, rows long")
    assert got(R.budget_prefix(p, "k", "n", [0, 3, 7, 8, 9])) == [("x", 0, 1, 3, True), ("x", 3, 1, 3, True), ("x", 7, 2, 7, True), ("x", 8, 4, 8, True), ("x", 9, 4, 8, False)]
    with pytest.raises(ValueError):
        R.budget_prefix(p, "k", "n", [3, 1])


def test_wave_without_wall_time(spark):
    a = spark.createDataFrame([(1, 5, 5, "ok", 7), (1, 5, 5, "failed", None)], "level int, start long, end long, status string, tokens long")
    assert got(R.wave_totals(a, "level")) == [(1, 0, 7, 1, 1, 0, 0, None, None)]


def test_counter_delta(spark):
    b, a = spark.createDataFrame([("x", 3), ("gone", 1)], "name string, count long"), spark.createDataFrame([("x", 5), ("new", 2)], "name string, count long")
    assert got(R.counter_delta(b, a, ["name"])) == [("new", 2), ("x", 2)]


def test_trio(spark):
    rows = [(1, 0, "shl"), (1, 1, "mov"), (1, 2, "cvt"), (2, 0, "mov"), (2, 1, "cvt"), (2, 2, "shl"), (3, 0, "shl"), (3, 1, "cvt")]
    e = spark.createDataFrame(rows, "s int, n int, mnemonic string")
    assert got(R.has_trio(e, "s", "n", "^shl", "^cvt")) == [(1, True), (2, False), (3, False)]


def test_prompt_groups_and_complement(spark):
    s = spark.createDataFrame([(1, "b", "p"), (2, "a", "p"), (3, "a", "q")], "session int, source string, digest string")
    assert got(R.prompt_groups(s, spark.createDataFrame([(3,), (3,)], "session int"))) == [("p", 2, ["a", "b"])]
    assert R.complement(spark.createDataFrame([([0, 2],)], "x array<int>"), "x", 4).first().kept == [1, 3]


def test_order_prefix(spark):
    r = spark.createDataFrame([("x", 2), ("x", 1), ("y", 9)], "k string, v int")
    n = lambda x: spark.createDataFrame([("x", x), ("y", 1)], "k string, n long")
    assert got(R.order_prefix(r, "k", [F.col("v")], n(1)).select("k", "v")) == [("x", 1), ("y", 9)]
    with pytest.raises(Exception, match="more rows"):
        R.order_prefix(r, "k", [F.col("v")], n(3)).collect()


def test_sigmoid_far_out(spark):
    v = spark.createDataFrame([(-1000.0,), (0.0,), (1000.0,)], "v double").select("v", R.sigmoid(F.col("v")).alias("s"), R.log_sigmoid(F.col("v")).alias("l"))
    assert got(v) == [(-1000.0, 0.0, -1000.0), (0.0, 0.5, -math.log(2)), (1000.0, 1.0, 0.0)]
