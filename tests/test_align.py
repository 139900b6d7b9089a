import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from conftest import plan_of

from tapewire.operators import align
from tapewire.operators.align import asof_join, forward_prices, profile_series

START = dt.datetime(2024, 1, 1)


def make(spark, seed, tickers=3, prices=120, events=150, span=40 * 86400, ties=20):
    rnd = random.Random(seed)
    names = [f"t{i}" for i in range(tickers)]
    p = []
    for i in range(prices):
        if p and i < ties:
            name, ts = p[-1][0], p[-1][1]
        else:
            name, ts = rnd.choice(names), START + dt.timedelta(seconds=rnd.randrange(span), microseconds=rnd.randrange(2))
        p.append((name, ts, float(i), i))
    rnd.shuffle(p)
    e = []
    for i in range(events):
        at = rnd.choice(p)[1] if i % 3 == 0 else START + dt.timedelta(seconds=rnd.randrange(-span // 4, span * 5 // 4))
        e.append((i, rnd.choice([*names, "absent", None]), at))
    return p, e


def brute(p, e, horizons, by_ticker=True):
    out = {}
    for i, name, ts in e:
        s = sorted((x for x in p if not by_ticker or x[0] == name), key=lambda x: (x[1], x[3]))
        at = max((k for k, x in enumerate(s) if x[1] <= ts), default=None)
        out[i] = tuple(
            s[at + h][2] if at is not None and at + h < len(s) else None for h in horizons
        )
    return out


def frames(spark, p, e):
    prices = spark.createDataFrame(p, "ticker string, ts timestamp, adj_close double, n int")
    events = spark.createDataFrame(e, "i int, ticker string, ts timestamp")
    return prices.repartition(3), events.repartition(3)


@pytest.mark.parametrize("span", [40 * 86400, 90, 4000 * 86400])
@pytest.mark.parametrize("settings", [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "rows_per_task": 7}, {"rows_per_task": 9}])
def test_against_brute_force(spark, span, settings):
    p, e = make(spark, span + len(settings), span=span)
    prices, events = frames(spark, p, e)
    got = asof_join(events, prices, (1, 3), ["ticker"], ["n"], **settings)
    assert got.columns == ["i", "ticker", "ts", "t0", "t1", "t3"]
    rows = got.collect()
    assert len(rows) == len(e)
    assert {r.i: (r.t0, r.t1, r.t3) for r in rows} == brute(p, e, (0, 1, 3))


@pytest.mark.parametrize("settings", [{}, {"broadcast_bytes": 0, "rows_per_task": 11}])
def test_single_series(spark, settings):
    p, e = make(spark, 5)
    prices, events = frames(spark, p, e)
    got = asof_join(events, prices.drop("ticker"), (2,), (), ["n"], **settings)
    assert {r.i: (r.t0, r.t2) for r in got.collect()} == brute(p, e, (0, 2), by_ticker=False)


def test_crowded_series_and_bursts(spark):
    """One series with most rows, most of them in one minute, and copies of one event."""
    rnd = random.Random(1)
    p = [("hot", START + dt.timedelta(microseconds=rnd.randrange(60_000_000)), float(i), i) for i in range(400)]
    p += [("hot", START + dt.timedelta(days=5), -1.0, 400), ("cold", START, -2.0, 401)]
    e = [(i, "hot", START + dt.timedelta(seconds=30)) for i in range(300)]
    e += [(300 + i, "hot", START + dt.timedelta(seconds=i)) for i in range(90)] + [(999, "cold", START)]
    prices, events = frames(spark, p, e)
    want = brute(p, e, (0, 4))
    for settings in ({}, {"broadcast_bytes": 0, "rows_per_task": 50}):
        got = asof_join(events, prices, (4,), ["ticker"], ["n"], **settings)
        assert {r.i: (r.t0, r.t4) for r in got.collect()} == want


def test_hand_cases(spark):
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    prices = spark.createDataFrame(
        [(day(4), 1.0), (day(5), 2.0), (day(8), 3.0)], "ts timestamp, adj_close double"
    )
    cases = {
        day(3, 23): (None, None), day(4): (1.0, 2.0), day(4, 12): (1.0, 2.0),
        day(6, 10): (2.0, 3.0), day(8): (3.0, None), day(30): (3.0, None),
    }
    events = spark.createDataFrame([(t,) for t in cases], "ts timestamp")
    got = {r.ts: (r.t0, r.t1) for r in asof_join(events, prices, (1,)).collect()}
    assert got == cases


@pytest.mark.parametrize("limit", [1_000_000, 10, 3, 1])
def test_forward_prices_in_ranges(spark, limit):
    p, _ = make(spark, 9)
    prices, _ = frames(spark, p, [(0, "x", START)])
    rows = forward_prices(prices, (0, 1, 6), ["ticker"], ["n"], rows_per_task=limit).collect()
    want = {}
    for name in {x[0] for x in p}:
        s = sorted((x for x in p if x[0] == name), key=lambda x: (x[1], x[3]))
        for k, x in enumerate(s):
            want[x[3]] = tuple(s[k + h][2] if k + h < len(s) else None for h in (0, 1, 6))
    assert len(rows) == len(p)
    assert {r.n: (r.t0, r.t1, r.t6) for r in rows} == want


def test_empty_sides(spark):
    p, e = make(spark, 3)
    prices, events = frames(spark, p, e)
    got = asof_join(events, prices.where("false"), (1,), ["ticker"], ["n"])
    assert {(r.t0, r.t1) for r in got.collect()} == {(None, None)}
    assert asof_join(events.where("false"), prices, (1,), ["ticker"], ["n"]).count() == 0


def test_negative_horizon(spark):
    with pytest.raises(ValueError):
        forward_prices(spark.createDataFrame([(START, 1.0)], "ts timestamp, adj_close double"), (-1,))


def test_profile(spark):
    p, _ = make(spark, 2)
    prices, _ = frames(spark, p, [(0, "x", START)])
    profile = profile_series(prices, ["ticker"])
    assert profile.rows == len(p) and profile.series == 3
    assert profile.longest == max(sum(x[0] == t for x in p) for t in ("t0", "t1", "t2"))


def test_small_prices_leave_events_in_place(spark, tmp_path):
    p, e = make(spark, 4)
    prices, events = frames(spark, p, e)
    events.write.parquet(str(tmp_path / "e"))
    stored = spark.read.parquet(str(tmp_path / "e"))
    plan = plan_of(asof_join(stored, prices.drop("ticker"), (1,), (), ["n"]))
    final = plan.split("Initial Plan")[0]
    assert "BroadcastHashJoin" in final and "NestedLoop" not in final and "Cartesian" not in final
    # above the scan of the events there is no exchange
    assert "SortMergeJoin" not in final


def test_large_prices_never_pair_up(spark):
    p, e = make(spark, 4)
    prices, events = frames(spark, p, e)
    plan = asof_join(events, prices, (1,), ["ticker"], ["n"], broadcast_bytes=0)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in text and "Cartesian" not in text


@pytest.mark.parametrize("horizon", [1, 2500])
def test_crowded_prices_stay_in_small_groups(spark, monkeypatch, horizon):
    """Ticks within a second beside daily prices: no window group grows far beyond the limit."""
    limit, seen = 1000, []
    real = align.Window.partitionBy

    class Watched(align.Window):
        @staticmethod
        def partitionBy(*cols):
            seen.append(cols)
            return real(*cols)

    monkeypatch.setattr(align, "Window", Watched)
    micro = dt.timedelta(microseconds=40)
    prices = [(START + k * micro, float(k)) for k in range(20_000)] + [(START + dt.timedelta(days=k), -float(k)) for k in range(1, 399)]
    events = [(k, START + (k * 37 % 20_000) * micro) for k in range(3000)]
    p = spark.createDataFrame(prices, "ts timestamp, adj_close double")
    e = spark.createDataFrame(events, "k long, ts timestamp")
    groups = {}
    monkeypatch.setattr(align, "durable", lambda df: groups.setdefault(len(groups), df.cache()))
    got = {r.k: (r.t0, r[f"t{horizon}"]) for r in asof_join(e, p, (horizon,), rows_per_task=limit, broadcast_bytes=0).collect()}
    order = sorted(prices)
    for k, ts in events:
        at = round((ts - START) / micro)
        assert got[k] == (float(at), order[at + horizon][1] if at + horizon < len(order) else None)
    sizes = [r["count"] for df in groups.values() if "_range" in df.columns for r in df.groupBy("_range").count().collect()]
    assert sizes and max(sizes) < 3 * limit
    assert all("_range" in cols for cols in seen if cols)
    # and the ranges that both sides are merged in
    bounds = align._bounds(e, p, profile_series(p), limit)
    merged = e.select("ts").union(p.select("ts")).groupBy(bounds.range_of(F.col("ts")).alias("at")).count().collect()
    assert len(merged) > 20 and max(r["count"] for r in merged) < limit


def test_hot_instants_are_salted(spark):
    """Half of the events at one instant: their range has salts, and its prices go to each."""
    events = spark.range(4000).selectExpr("id AS k", "timestamp_micros(1700000000000000 + if(id % 2 = 0, 0, id * 1000000)) AS ts")
    prices = spark.range(400).selectExpr("timestamp_micros(1699999900000000 + id * 5000000) AS ts", "cast(id AS double) AS adj_close")
    bounds = align._bounds(events, prices, profile_series(prices), 400)
    assert max(bounds.salts) >= 15 and sorted(bounds.starts) == bounds.starts
    got = asof_join(events, prices, (), rows_per_task=400, broadcast_bytes=0).collect()
    want = {k: min(399, (100 + (0 if k % 2 == 0 else k)) // 5) for k in range(4000)}
    assert {r.k: r.t0 for r in got} == want


def test_merge_shuffles_once(spark, tmp_path):
    p, e = make(spark, 4)
    prices, events = frames(spark, p, e)
    events.write.parquet(str(tmp_path / "e"))
    prices.write.parquet(str(tmp_path / "p"))
    stored = [spark.read.parquet(str(tmp_path / n)) for n in "ep"]
    plan = asof_join(*stored, (1,), ["ticker"], ["n"], broadcast_bytes=0)._jdf.queryExecution().executedPlan().toString()
    # the prices by series, for the rows after them, and then both sides by range
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_series_without_a_name_and_events_without_a_time(spark):
    day = START + dt.timedelta(days=1)
    prices = spark.createDataFrame([("a", START, 1.0), (None, START, 2.0)], "ticker string, ts timestamp, adj_close double")
    events = spark.createDataFrame([(1, "a", day), (2, None, day), (3, "a", None)], "k int, ticker string, ts timestamp")
    for settings in ({}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "rows_per_task": 1}):
        got = asof_join(events, prices, (), ["ticker"], **settings).collect()
        assert {r.k: r.t0 for r in got} == {1: 1.0, 2: None, 3: None}


def test_columns_that_clash_are_refused(spark):
    p = spark.createDataFrame([(START, 1.0)], "ts timestamp, adj_close double")
    e = spark.createDataFrame([(START, 1.0)], "ts timestamp, t0 double")
    with pytest.raises(ValueError, match="t0"):
        asof_join(e, p)
