"""Second-order boosting against plain Python over rows, for every setting."""

import math
import random

import numpy as np
import pytest

from callgauge.operators import boosting as bt


def rows_of(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.gauss(0, 1), float(rng.randint(0, 4)), rng.random()
        y = a * 2 + (b > 2) * 1.5 + rng.gauss(0, 0.3)
        out.append((i, None if rng.random() < 0.2 else a, b, float("nan") if rng.random() < 0.1 else c, 1.0, y, float(y > 0.8) if rng.random() > 0.02 else None))
    return out


COLS = ["a", "b", "c", "same"]
SCHEMA = "i long, a double, b double, c double, same double, y double, label double"


def plain_fit(rows, edges, label, s, logistic, rounds):
    """Outputs of the rows after each round, by looking at every cut and every row."""
    bins = [[-1 if r[1 + k] is None or math.isnan(r[1 + k]) else sum(e < r[1 + k] for e in edges[c]) for k, c in enumerate(COLS)] for r in rows]
    y = [r[label] for r in rows]
    margin = [0.0 if logistic else sum(y) / len(y)] * len(rows)
    soft = lambda g: math.copysign(max(abs(g) - s.l1, 0), g)
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g = [a - b for a, b in zip(p if logistic else margin, y)]
        h = [q * (1 - q) if logistic else 1.0 for q in p]

        def grow(members, depth):
            big_g, big_h = math.fsum(g[i] for i in members), math.fsum(h[i] for i in members)
            best = (max(s.min_gain, 1e-9),)
            for k, c in enumerate(COLS) if depth < s.depth else ():
                for cut in range(len(edges[c])):
                    for missing_left in (True, False):
                        left = [i for i in members if (missing_left if bins[i][k] < 0 else bins[i][k] <= cut)]
                        lg, lh = math.fsum(g[i] for i in left), math.fsum(h[i] for i in left)
                        if lh < s.min_weight or big_h - lh < s.min_weight:
                            continue
                        gain = soft(lg) ** 2 / (lh + s.l2) + soft(big_g - lg) ** 2 / (big_h - lh + s.l2) - soft(big_g) ** 2 / (big_h + s.l2)
                        if round(gain, 9) > best[0]:
                            best = (round(gain, 9), set(left))
            if len(best) == 2:
                grow([i for i in members if i in best[1]], depth + 1)
                grow([i for i in members if i not in best[1]], depth + 1)
                return
            for i in members:
                margin[i] -= soft(big_g) / (big_h + s.l2) * s.rate

        grow(list(range(len(rows))), 0)
    return [1 / (1 + math.exp(-m)) for m in margin] if logistic else margin


@pytest.mark.parametrize("logistic, settings", [
    (True, bt.Settings(rounds=3, depth=3, rate=0.4, bins=8)), (False, bt.Settings(rounds=3, depth=2, rate=0.5, bins=6, l1=2.0, l2=0.5)),
    (True, bt.Settings(rounds=2, depth=4, rate=1.0, bins=5, min_gain=3.0, min_weight=4.0)), (False, bt.Settings(rounds=12, depth=1, rate=0.3, bins=4, l2=0.0)),
])
def test_agrees_with_plain_rows(spark, logistic, settings):
    rows = rows_of(3, 160)
    df = spark.createDataFrame(rows, SCHEMA)
    label = "label" if logistic else "y"
    model = bt.fit_second_order(df.repartition(3), COLS, label, "i", settings, logistic)
    kept = [r for r in rows if not logistic or r[6] is not None]
    want = plain_fit(kept, model.edges, 6 if logistic else 5, settings, logistic, settings.rounds)
    got = {r.i: r.score for r in model.score(df).collect()}
    assert len(got) == len(rows) and [got[r[0]] for r in kept] == pytest.approx(want, abs=1e-8)


def test_draws_and_edges(spark):
    rows = rows_of(5, 300)
    df = spark.createDataFrame(rows, SCHEMA)
    s = bt.Settings(rounds=4, depth=3, bins=8, columns=0.5, subsample=0.6)
    first, again = (bt.fit_second_order(d, COLS, "label", "i", s) for d in (df, df.repartition(5)))
    assert all(np.allclose(x, y) for a, b in zip(first.trees, again.trees) for x, y in zip(a, b))
    assert all(len(set(t.column[t.left >= 0])) <= 2 for t in first.trees)
    share = bt.drawn(np.arange(20_000, dtype=np.int64), 3, 0.6).mean()
    assert abs(share - 0.6) < 0.02 and bt.drawn(np.arange(5, dtype=np.int64), 0, 1.0).all()
    none = bt.fit_second_order(df.filter("false"), COLS, "label", "i", bt.Settings(rounds=2, depth=2))
    assert {r.score for r in none.score(df).collect()} == {0.5} and none.score(df.filter("false")).count() == 0
    constant = bt.fit_second_order(df, ["same"], "y", "i", bt.Settings(rounds=1), logistic=False)
    assert constant.score(df).selectExpr("max(score) - min(score) AS d").first().d == 0
