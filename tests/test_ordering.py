"""Order-dependent operators against brute force, with a hot key and copies of one moment."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from callgauge.operators import alignment as al, ordering as od
from callgauge.operators.quantiles import exact_quantiles

D0 = dt.date(2020, 1, 1)


def days(n):
    return D0 + dt.timedelta(days=n)


def make(seed, n=600, hot=0.35, span=2000):
    rng = random.Random(seed)
    return [("hot" if rng.random() < hot else f"k{rng.randrange(8)}", days(rng.randrange(span)), i) for i in range(n)]


def by_moment(facts):
    out = {}
    for k, d, v in facts:
        out[k, d] = max(out.get((k, d), v), v)
    return out


@pytest.mark.parametrize("width", [3, 90, 100000])
@pytest.mark.parametrize("forward", [False, True])
def test_asof_equals_brute_force(spark, width, forward):
    left, right = make(1), make(2, 400)
    l = spark.createDataFrame(left, "k string, d date, i int")
    r = spark.createDataFrame(right, "k string, t date, v int")
    got = {x.i: (x.match.t, x.match.v) if x.match else None
           for x in od.asof(l, r, ["k"], "d", "t", ["v"], forward=forward, range_of=od.calendar_range(width)).collect()}
    facts = by_moment(right)
    for k, d, i in left:
        near = [(t, v) for (kk, t), v in facts.items() if kk == k and (t >= d if forward else t <= d)]
        want = (min(near) if forward else max(near)) if near else None
        assert got[i] == want
    assert len(got) == len(left)


@pytest.mark.parametrize("width", [2, 40, 100000])
def test_nearby_third_fact_after(spark, width):
    left, right = make(3, 300), make(4, 300)
    l = spark.createDataFrame(left, "k string, d date, i int")
    r = spark.createDataFrame(right, "k string, t date, v int")
    table = od.nearby(l, r, ["k"], "d", "t", ["v"], before="b", after="a", n_after=3, range_of=od.calendar_range(width))
    got = {(x.k, x.d): (x.b and (x.b.t, x.b.v), x.a and (x.a.t, x.a.v)) for x in table.collect()}
    facts = by_moment(right)
    for k, d, _ in left:
        before = sorted((t, v) for (kk, t), v in facts.items() if kk == k and t <= d)
        after = sorted((t, v) for (kk, t), v in facts.items() if kk == k and t > d)
        want = (before[-1] if before else None, (after[2] if len(after) > 2 else after[-1]) if after else None)
        assert got[k, d] == want


def test_asof_within_sees_one_range_back(spark):
    l = spark.createDataFrame([("a", days(n)) for n in (0, 180, 181, 400)], "k string, d date")
    r = spark.createDataFrame([("a", days(0), 1.0)], "k string, t date, v double")
    got = {x.k: x for x in od.asof_within(l.filter(F.col("d") == days(180)), r, ["k"], "d", "t", ["v"], range_of=od.calendar_range(181)).collect()}
    assert got["a"].match.v == 1.0


@pytest.mark.parametrize("width", [5, 100000])
def test_fill_forward_with_copies(spark, width):
    rng = random.Random(5)
    rows = [(k, d, i, rng.random() if rng.random() < 0.4 else None) for k, d, i in make(5, 500, span=300)]
    df = spark.createDataFrame(rows, "k string, d date, i int, x double")
    got = {x.i: x.x for x in od.fill_forward(df, ["k"], "d", ["x"], range_of=od.calendar_range(width)).collect()}
    best = {}
    for k, d, _, x in rows:
        if x is not None:
            best[k, d] = max(best.get((k, d), x), x)
    for k, d, i, x in rows:
        known = [t for (kk, t) in best if kk == k and t <= d]
        assert got[i] == (x if x is not None else (best[k, max(known)] if known else None))


def test_chronological_index_is_total_order_on_a_hot_date(spark):
    rng = random.Random(6)
    rows = [(days(7) if rng.random() < 0.4 else days(rng.randrange(30)), f"t{rng.randrange(9)}", i) for i in range(1000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "d date, t string, i int")
    got = {x.i: x.idx for x in od.chronological_index(df, "d", ["t", "i"]).collect()}
    want = {r[2]: n for n, r in enumerate(sorted(rows))}
    assert got == want
    numeric = {x.i: x.idx for x in od.chronological_index(df, "d", ["i"]).collect()}
    assert numeric == {r[2]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[0], r[2])))}


@pytest.mark.parametrize("ranges", [1, 7, 200])
def test_range_index_agrees_with_searchsorted(spark, ranges):
    values = [random.Random(7).uniform(-5, 5) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    bounds = od.even_bounds(df, F.col("v"), ranges)
    got = [(x.v, x.r) for x in df.select("v", od.range_index(F.col("v"), bounds).alias("r")).collect()]
    assert all(r == np.searchsorted(bounds, v, side="left") for v, r in got)


def test_running_totals_with_ties(spark):
    rows = [(random.Random(8 + i).choice([0.1, 0.5, 0.5, 0.9, i / 100]), i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "s double, y int")
    for x in od.running_totals(df, "s", {"n": F.lit(1), "p": F.col("y")}).collect():
        assert x.n == sum(s == x.s for s, _ in rows) and x.n_before == sum(s < x.s for s, _ in rows)
        assert x.p_before == sum(y for s, y in rows if s < x.s)


def test_running_max(spark):
    rows = [("a", i, float((i * 37) % 101)) for i in range(200)] + [("b", 1, 3.0)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    got = {(x.k, x.i): x.before for x in od.running_max(df, ["k"], "i", "v").collect()}
    for k, i, _ in rows:
        earlier = [v for kk, j, v in rows if kk == k and j < i]
        assert got[k, i] == (max(earlier) if earlier else None)


def test_exact_quantiles_equal_numpy(spark):
    rng = random.Random(9)
    rows = [(rng.gauss(0, 1), rng.choice([1.0, 2.0, 2.0, 5.0]), None, None if i % 3 else float(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    ps = [0.0, 0.01, 0.25, 0.33, 0.5, 0.67, 0.99, 1.0]
    got = exact_quantiles(df, ["a", "b", "c", "d"], ps)
    assert got["c"] == [None] * len(ps)
    for i, c in ((0, "a"), (1, "b"), (3, "d")):
        assert got[c] == pytest.approx(np.quantile([r[i] for r in rows if r[i] is not None], ps).tolist())


def test_daily_lookup_by_date_and_clock(spark):
    rows = [(dt.datetime(2020, 1, 2, 5), 10.0), (dt.datetime(2020, 1, 3, 5), 11.0), (dt.datetime(2020, 1, 6, 5), 12.0)]
    idx = spark.createDataFrame(rows, "date timestamp, close double")
    got = {x.day.day: (x.at_or_before, x.at_or_after) for x in od.daily_lookup(idx, "date", "close").collect()}
    # a bar stamped 05:00 is known only from the next midnight on
    assert got[3] == (10.0, 11.0) and got[4] == (11.0, 12.0) and got[6] == (11.0, 12.0) and got[2] == (None, 10.0)
    plain = spark.createDataFrame([(days(0), 1.0), (days(3), 2.0)], "date date, close double")
    got = {x.day: (x.at_or_before, x.at_or_after) for x in od.daily_lookup(plain, "date", "close").collect()}
    assert got == {days(0): (1.0, 1.0), days(1): (1.0, 2.0), days(2): (1.0, 2.0), days(3): (2.0, 2.0)}


def test_benchmark_return_with_missing_ends(spark):
    idx = spark.createDataFrame([(days(5), 100.0), (days(8), 110.0)], "date date, close double")
    w = spark.createDataFrame([(1, days(6), days(7)), (2, days(1), days(7)), (3, days(6), days(9)), (4, days(20), days(21))], "i int, s date, e date")
    got = {x.i: x.sp500_return_3day for x in al.benchmark_window_return(w, idx, "s", "e").collect()}
    assert got[1] == pytest.approx(0.1) and got[2] is None and got[3] is None and got[4] is None


def test_statement_tiers_at_their_limits(spark):
    gaps = {"m1": -1, "z": 0, "t": 120, "f0": 121, "f1": 180, "s": 181}
    calls = spark.createDataFrame([(k, days(1000)) for k in gaps] + [("none", days(1000)), ("null", None)], "k string, d date")
    stm = spark.createDataFrame([(k, days(1000 - g), 1.0) for k, g in gaps.items()], "k string, t date, v double")
    got = {x.k: (x.match_type, x.match_days) for x in al.asof_tiered(calls, stm, ["k"], "d", "t").collect()}
    assert got == {
        "m1": ("all_future", None), "z": ("tight", 0), "t": ("tight", 120), "f0": ("fallback", 121), "f1": ("fallback", 180),
        "s": ("too_stale", None), "none": ("no_ticker", None), "null": ("no_date", None),
    }


def test_calls_pass_one_exchange_on_ticker_and_date(spark):
    calls = spark.createDataFrame([("a", days(9), "long text")], "ticker string, date date, text string")
    stm = spark.createDataFrame([("a", days(1), 1.0)], "ticker string, date date, v double")
    bars = spark.createDataFrame([("a", days(n), float(n)) for n in (8, 9, 12)], "ticker string, date date, close double")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        matched = al.match_all(calls, stm, bars)
        plan = spark._jvm.PythonSQLUtils.explainString(matched._jdf.queryExecution(), "formatted")
        assert [(x.outcome, x.match_days, x.text) for x in matched.collect()] == [("aligned", 8, "long text")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    nodes = plan.split("\n\n")
    carrying = [n for n in nodes if ") Exchange" in n and "text#" in n]
    assert len(carrying) == 1 and "hashpartitioning(ticker#" in carrying[0] and ", date#" in carrying[0].split("Arguments:")[1]
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_merged_looks_agree_with_brute_force(spark):
    """Two fact tables on one key, moments and facts repeated, a hot key over many ranges, and keys on one side alone."""
    rng = np.random.default_rng(11)
    draw = lambda n, keys: [(str(rng.choice(keys)), days(int(d)), float(v)) for d, v in zip(rng.integers(0, 900, n), rng.integers(0, 9, n))]
    asks, one, two = draw(120, ["a", "a", "b", "x"]), draw(150, ["a", "a", "b", "c"]), draw(200, ["a", "b", "x"])
    frame = lambda rows: spark.createDataFrame(rows + [("a", None, 1.0), (None, days(3), 1.0)], "k string, t date, v double")
    for width in (30, 366, 5000):
        table = od.merged(frame(asks), ["k"], "t", [
            od.Look(frame(one), "t", ["v"], before="m", known="has"), od.Look(frame(two), "t", ["v"], before="b", after="f", n=2),
        ], od.calendar_range(width))
        got = {(x.k, x.t): x for x in table.collect() if x.k is not None}
        assert len(got) == len({(k, t) for k, t, _ in asks})
        tops = lambda rows, k: sorted({t: max(v for kk, tt, v in rows if (kk, tt) == (k, t)) for kk, t, _ in rows if kk == k}.items())
        for (k, t), x in got.items():
            past = [p for p in tops(one, k) if p[0] <= t]
            assert (tuple(x.m) if x.m else None) == (past[-1] if past else None) and x.has == any(kk == k for kk, _, _ in one)
            past, later = [p for p in tops(two, k) if p[0] <= t], [p for p in tops(two, k) if p[0] > t][:2]
            assert (tuple(x.b) if x.b else None, tuple(x.f) if x.f else None) == (past[-1] if past else None, later[-1] if later else None)


def test_price_window_edges(spark):
    bars = [("a", days(n), float(n)) for n in (10, 11, 14, 15, 16)]
    p = spark.createDataFrame(bars, "k string, d date, close double")
    e = spark.createDataFrame([("a", days(n)) for n in (9, 10, 12, 14, 15, 16)] + [("b", days(10))], "k string, t date")
    got = {(x.k, x.t): (x.price_before_earnings, x.price_after_earnings) for x in al.event_window_prices(e, p, ["k"], "t", "d", "close").collect()}
    assert got == {
        ("a", days(9)): (None, None), ("a", days(10)): (10.0, 15.0), ("a", days(12)): (11.0, 16.0), ("a", days(14)): (14.0, 16.0),
        ("a", days(15)): (15.0, 16.0), ("a", days(16)): (None, None), ("b", days(10)): (None, None),
    }


def test_clock_bars_of_the_event_day_come_after(spark):
    bars = [("a", dt.datetime(2020, 1, n, 5), float(n)) for n in (1, 2, 3, 6, 7)]
    p = spark.createDataFrame(bars, "k string, d timestamp, close double")
    e = spark.createDataFrame([("a", dt.datetime(2020, 1, 3))], "k string, t timestamp")
    x = al.event_window_prices(e, p, ["k"], "t", "d", "close").first()
    assert (x.price_before_earnings, x.price_after_earnings) == (2.0, 7.0)
    x = al.event_window_prices(e, p, ["k"], "t", "d", "close", by_date=True).first()
    assert (x.price_before_earnings, x.price_after_earnings) == (3.0, 7.0)


def test_every_call_is_aligned_or_rejected(spark):
    calls = spark.createDataFrame([(i, f"k{i % 3}", days(i * 9)) for i in range(100)], "i int, ticker string, date date")
    stm = spark.createDataFrame([(f"k{i % 2}", days(i * 100), float(i)) for i in range(10)], "ticker string, date date, m double")
    bars = spark.createDataFrame([(f"k{i % 3}", days(i * 3), 1.0 + i) for i in range(250)], "ticker string, date date, close double")
    kept, left = al.align(calls, stm, bars), al.alignment_rejects(calls, stm, bars)
    assert kept.count() + left.count() == 100 and kept.count() > 0 and left.count() > 0
    assert kept.filter("financial_date > transcript_date or market_date_before > transcript_date or market_date_after <= transcript_date").count() == 0
    assert "financial_m" in kept.columns
