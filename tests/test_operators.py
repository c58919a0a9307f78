"""Operators against brute force on small fixtures, hot keys included."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonelytics.operators.joins import asof_join, interval_join
from zonelytics.operators.latest import latest_incremental, latest_per_key
from zonelytics.operators.quantiles import exact_quantile
from zonelytics.operators.rules import spaced
from zonelytics.operators.scenario import allocate
from zonelytics.operators.windows import running_total
from zonelytics.operators.series import decompose_anomalies, fir, make_series, mv_expand, to_arrays

T0 = datetime(2024, 1, 1)
rng = random.Random(7)


def hot_key():
    return "hot" if rng.random() < 0.5 else f"k{rng.randrange(6)}"


@pytest.mark.parametrize("chunk", [600, 3600, 86400])
def test_spaced_equals_greedy_scan(frame, chunk):
    rows = sorted({(hot_key(), T0 + timedelta(seconds=rng.randrange(0, 40000))) for _ in range(1500)})
    got = {tuple(r) for r in spaced(frame(rows, "k string, timestamp timestamp"), ["k"], "timestamp", 500, chunk).collect()}
    last, expected = {}, set()
    for k, t in rows:
        if k not in last or t - last[k] >= timedelta(seconds=500):
            last[k] = t
            expected.add((k, t))
    assert got == expected


@pytest.mark.parametrize("direction,strict", [("backward", False), ("backward", True), ("forward", False), ("forward", True)])
def test_asof_equals_brute_force(frame, direction, strict):
    left = [(i, hot_key(), T0 + timedelta(seconds=60 * rng.randrange(600))) for i in range(300)]
    right = list({(hot_key(), T0 + timedelta(seconds=60 * rng.randrange(600))) for _ in range(200)})
    l = frame(left, "id int, k string, timestamp timestamp")
    r = frame([(k, t, t.isoformat()) for k, t in right], "k string, timestamp timestamp, v string")
    got = {row["id"]: row["r_v"] for row in asof_join(l, r, ["k"], direction=direction, strict=strict, chunk=1800, prefix="r_").collect()}
    for i, k, t in left:
        if direction == "backward":
            best = max((u for j, u in right if j == k and (u < t if strict else u <= t)), default=None)
        else:
            best = min((u for j, u in right if j == k and (u > t if strict else u >= t)), default=None)
        assert got[i] == (best.isoformat() if best else None)


def test_interval_join_equals_brute_force(frame):
    points = [(i, hot_key(), T0 + timedelta(seconds=rng.randrange(20000))) for i in range(400)]
    spans = [(f"s{i}", hot_key(), (a := T0 + timedelta(seconds=rng.randrange(20000))), a + timedelta(seconds=rng.choice([0, 1, 300, 5000]))) for i in range(40)]
    got = interval_join(frame(points, "id int, k string, timestamp timestamp"), frame(spans, "name string, k string, start_time timestamp, end_time timestamp"), ["k"], bucket=300)
    expected = {(i, n) for i, k, t in points for n, j, a, b in spans if k == j and a <= t < b}
    assert {(r["id"], r["name"]) for r in got.collect()} == expected
    assert got.count() == len(expected)


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_exact_quantile(frame, q):
    rows = [(hot_key(), rng.choice([rng.gauss(0, 50), 3.0, -1e-9, 1e6 * rng.random()])) for _ in range(2000)] + [("one", 4.0)]
    got = {r[0]: r[1] for r in exact_quantile(frame(rows, "k string, v double"), "v", q, ["k"]).collect()}
    for k in got:
        assert got[k] == pytest.approx(np.quantile([v for j, v in rows if j == k], q), rel=1e-12, abs=1e-12)


def test_running_total_and_allocation(frame):
    rows = [("hot" if i % 3 else "cold", i, float(rng.randrange(1, 20))) for i in range(600)]
    df = frame(rows, "g string, n int, request_kg double")
    got = {r["n"]: r["t"] for r in running_total(df, "request_kg", ["g"], ["n"], F.floor(F.col("n") / 50), "t").collect()}
    seen = {}
    for g, n, v in rows:
        assert got[n] == seen.get(g, 0.0)
        seen[g] = seen.get(g, 0.0) + v
    stock = frame([("hot", 500.0)], "g string, stock_kg double")
    out = allocate(df, stock, ["g"], ["n"], F.floor(F.col("n") / 50))
    used = {r["g"]: r["kg"] for r in out.groupBy("g").agg(F.sum("allocated_kg").alias("kg")).collect()}
    assert used == {"hot": 500.0, "cold": 0.0}
    assert out.filter("allocated_kg < 0 OR allocated_kg > request_kg").count() == 0


def test_latest_forms_agree(frame):
    rows = [(hot_key(), T0 + timedelta(seconds=rng.randrange(50)), i) for i in range(300)]
    df = frame(rows, "k string, timestamp timestamp, i int")
    a = latest_per_key(df, ["k"], tie=["i"]).select("k", "timestamp", "i")
    b = latest_incremental(df, ["k"], tie=["i"]).select("k", "timestamp", "i")
    assert sorted(a.collect()) == sorted(b.collect())


def test_series_gap_fill(frame):
    df = frame([("z", T0, 1.0), ("z", T0 + timedelta(minutes=11), 3.0), ("z", T0 + timedelta(minutes=12), 5.0)], "k string, timestamp timestamp, v double")
    for fill, expected in ((0.0, [1.0, 0.0, 4.0]), (None, [1.0, None, 4.0]), ("ffill", [1.0, 1.0, 4.0])):
        s = make_series(df, timedelta(minutes=5), F.avg("v"), "v", ["k"], fill=fill).orderBy("timestamp")
        assert [r["v"] for r in s.collect()] == expected


def test_decomposition_edge_cases(frame):
    rows = [("two", T0 + timedelta(minutes=i), float(i * 100)) for i in range(2)]
    rows += [("line", T0 + timedelta(minutes=i), 2.0 * i) for i in range(20)]
    rows += [("spike", T0 + timedelta(minutes=i), 50.0 if i == 10 else 1.0) for i in range(20)]
    out = decompose_anomalies(frame(rows, "k string, timestamp timestamp, v double"), "v", ["k"])
    flags = {r["k"]: r["n"] for r in out.groupBy("k").agg(F.sum(F.abs("anomaly")).alias("n")).collect()}
    assert flags == {"two": 0, "line": 0, "spike": 1}
    assert out.filter("k = 'spike' AND anomaly = 1").first()["v"] == 50.0


def test_fir_is_linear(frame):
    rows = [("z", T0 + timedelta(minutes=i), rng.random(), rng.random()) for i in range(30)]
    df = frame(rows, "k string, timestamp timestamp, a double, b double").withColumn("c", 2 * F.col("a") + F.col("b"))
    for c in "abc":
        df = fir(df, c, [1, 2, 3], ["k"], name=f"f{c}")
    assert df.filter(F.abs(F.col("fc") - 2 * F.col("fa") - F.col("fb")) > 1e-9).count() == 0


def test_arrays_round_trip(frame):
    rows = [("z", T0 + timedelta(minutes=i), float(i), i) for i in range(10)]
    df = frame(rows, "k string, timestamp timestamp, v double, n int")
    back = mv_expand(to_arrays(df, ["v", "n"], ["k"]), {"timestamp": "timestamp", "v": "double", "n": "int"}, index="i")
    assert sorted(tuple(r) for r in back.select("k", "timestamp", "v", "n").collect()) == rows
    assert back.filter("i <> n").count() == 0
