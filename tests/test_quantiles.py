"""Quantiles by narrowing sketches against sorted values, merging sketches, and the number of rounds."""

import numpy as np
import pytest

from callgauge.operators import quantiles as qt

PS = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.75, 0.99, 1.0]


def columns(n, seed=3):
    r = np.random.default_rng(seed)
    return {
        "spread": r.normal(size=n), "tied": r.integers(0, 5, n).astype(float), "one": np.full(n, 7.0),
        "signed": r.choice([-0.0, 0.0, 1.0], n), "heavy": np.where(r.random(n) < 0.4, 3.0, r.exponential(5, n)),
    }


def table(spark, values, parts=6):
    rows = [tuple(float(x) for x in row) for row in zip(*values.values())]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in values)).repartition(parts)


@pytest.mark.parametrize("n,k", [(1, 4096), (2, 4096), (3, 4096), (4_000, 4096), (20_000, 4096), (20_000, 64)])
def test_equal_to_sorted_values(spark, monkeypatch, n, k):
    """A small sketch needs several rounds and misses brackets; the result stays exact."""
    monkeypatch.setattr(qt, "K", k)
    monkeypatch.setattr(qt, "SLACK", 2 * 2.296 / k**0.9723)
    values = columns(n)
    got = qt.exact_quantiles(table(spark, values), list(values), PS, keep=True)
    for c, x in values.items():
        assert got[c] == pytest.approx(list(np.quantile(x, PS)), abs=1e-12), c


def test_brackets_that_miss_their_rank(spark, monkeypatch):
    """Without any slack at all brackets often miss; counts show it, and the search goes on beside them."""
    monkeypatch.setattr(qt, "K", 16)
    monkeypatch.setattr(qt, "SLACK", 0.0)
    values = columns(3_000, seed=8)
    got = qt.exact_quantiles(table(spark, values), list(values), PS, keep=True)
    for c, x in values.items():
        assert got[c] == pytest.approx(list(np.quantile(x, PS)), abs=1e-12), c


def test_missing_and_infinite_values_do_not_count(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (float("nan"), None), (float("inf"), None), (4.0, None)], "a double, b double")
    assert qt.exact_quantiles(df, ["a", "b"], [0.5, 0.75]) == {"a": [2.5, 3.25], "b": [None, None]}
    assert qt.exact_quantiles(df.filter("false"), ["a"], [0.5]) == {"a": [None]}
    assert qt.exact_quantiles(df.filter("false"), ["a"], [0.5], exact=False) == {"a": [None]}
    assert qt.exact_quantiles(df, [], [0.5]) == {}


def test_sketches_merge_over_batches(spark):
    values = columns(30_000, seed=5)
    df = table(spark, values).selectExpr("*", "monotonically_increasing_id() % 3 AS batch").persist()
    parts = [qt.quantile_sketches(df.filter(f"batch = {b}"), list(values)) for b in range(3)]
    merged = qt.merge_sketches(parts)
    for r in qt.sketch_quantiles(merged, [0.1, 0.5, 0.9]).collect():
        assert r["count"] == 30_000
        x = np.sort(values[r["column"]])
        for p, v in zip([0.1, 0.5, 0.9], r["quantiles"]):
            low, high = np.searchsorted(x, v, "left") / len(x), np.searchsorted(x, v, "right") / len(x)
            assert low - 3 * qt.RANK_ERROR <= p <= high + 3 * qt.RANK_ERROR
    got = qt.exact_quantiles(df, list(values), [0.25, 0.5], sketches=merged)
    assert got == {c: pytest.approx(list(np.quantile(x, [0.25, 0.5]))) for c, x in values.items()}
    df.unpersist()


def test_changed_values_are_noticed(spark):
    df = table(spark, {"a": np.arange(50.0)})
    with pytest.raises(RuntimeError, match="changed"):
        qt.exact_quantiles(df.filter("a < 10"), ["a"], [0.99], sketches=qt.quantile_sketches(df, ["a"]))
