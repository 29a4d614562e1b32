"""Boosted fits that grow together: Spark's own trees where nothing is drawn, the same trees in one task and in several, few jobs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from callgauge.operators import boosting as bt, evaluation as ev, lockstep as ls, modeling as md


def _rows(spark, n=960, wide=False):
    rng = np.random.default_rng(1)
    rows = [(i, float(i % 8), float(i // 8 % 16), float(rng.gamma(2) * 3)) for i in range(n)]
    rows = [(*r, int(r[1] * 0.4 + r[2] * 0.2 - (r[3] > 2) * 2 + rng.normal() > 2)) for r in rows]
    df = spark.createDataFrame(rows, "i long, a double, b double, c double, y int")
    cols = [*"abc", *[f"z{k}" for k in range(8)]] if wide else [*"abc"]
    return md.assemble(df.withColumns({c: F.col("a") for c in cols[3:]}).repartition(3), cols).persist()


@pytest.fixture
def jobs(spark):
    """Number of jobs that ran in a scope."""
    def count(f):
        sc = spark.sparkContext
        sc.setJobGroup("lockstep", "lockstep")
        before = len(sc.statusTracker().getJobIdsForGroup("lockstep"))
        f()
        return len(sc.statusTracker().getJobIdsForGroup("lockstep")) - before

    return count


def test_trees_are_those_of_sparks_learner(spark):
    d = _rows(spark)
    spark_own = md.fit_boosted_classifier(d, "y", "features", 4, 4, 0.3, 1.0, 1.0, weighted=False, min_rows=3, min_gain=0.0005)
    assert [len(e) for e in ls.vector_edges(d, "features")[1].values()] == [7, 15, 31]
    mine = ls.fit_lockstep([(ls.Boosted(4, 4, 0.3, 1.0, 1.0, 3, 0.0005), d, "y", "features", "i")])[0]
    both = md.scored(mine, md.scored(spark_own, d, "s1"), "s2")
    assert both.columns[-2:] == ["s1", "s2"] and both.count() == 960
    assert both.select(F.max(F.abs(F.col("s1") - F.col("s2")))).first()[0] < 1e-9


def test_one_task_and_several_give_the_same_trees(spark, monkeypatch):
    d = _rows(spark, wide=True)
    settings = [ls.Boosted(3, 3, 0.3, 0.7, 0.5, 4), ls.Boosted(1, 8, 0.1, 1.0, 0.9), ls.Boosted(4, 2, 0.2)]
    asked = [(s, rows, "y", "features", "i") for s in settings for rows in (d, d.filter("i < 500"))]
    whole = ls.fit_lockstep(asked)
    monkeypatch.setattr(ls, "TASK_ROWS", 501)
    monkeypatch.setattr(ls, "STRETCH", 3)
    monkeypatch.setattr(ls, "HELD_STEPS", 4)
    monkeypatch.setattr(ls, "BLOCK_ROWS", 100)
    mixed = ls.fit_lockstep(asked)
    for a, b, (s, *_) in zip(whole, mixed, asked):
        assert a.trees.edges == b.trees.edges and len(a.trees.trees) == len(b.trees.trees) == s.rounds
        for t, u in zip(a.trees.trees, b.trees.trees):
            assert all(np.allclose(x, y) for x, y in zip(t, u))


def test_fits_together_cost_as_many_jobs_as_one(spark, jobs):
    d = _rows(spark)
    assert d.count() == 960
    one, many = (jobs(lambda k=k: ls.fit_lockstep([(ls.Boosted(12, 5, 0.1 + i / 10), d, "y", "features", "i") for i in range(k)])) for k in (1, 8))
    assert many <= one < 12


def test_many_rows_are_cut_at_quantiles(spark, monkeypatch):
    d = _rows(spark)
    monkeypatch.setattr(ls, "COUNTED_ROWS", 900)
    n, edges = ls.vector_edges(d, "features")
    assert n == 960 and edges["__x0"] == [float(v) for v in range(8)] and len(edges["__x2"]) == 31
    assert ev.roc_auc(md.scored(ls.Boosted(4, 3, 0.3)(d, "y", "features"), d), "score", "y").first().roc_auc > 0.85


def test_draws_and_odd_rows(spark):
    d = _rows(spark)
    level = ls.Level(ls.Boosted(columns=0.5), 3, 2, 4000, 6)
    drawn = ls.open_columns(level, 0, 4000)
    assert (drawn.sum(1) == 3).all() and abs(drawn.mean(0) - 0.5).max() < 0.05 and (ls.open_columns(level, 64, 10) == drawn[64:74]).all()
    fit = ls.Boosted(6, 3, 0.3, 0.6, 0.6)
    out = md.scored(fit(d, "y", "features"), d)
    assert ev.roc_auc(out, "score", "y").first().roc_auc > 0.85
    alike = ls.Boosted(2, 3)(d.withColumn("y", F.lit(1)), "y", "features")
    assert out.count() == 960 and md.scored(alike, d).agg(F.min("score")).first()[0] > 0.8
    with pytest.raises(Exception, match="labels must be 0 or 1"):
        fit(d.withColumn("y", F.when(F.col("i") > 3, F.col("y"))), "y", "features")
    with pytest.raises(ValueError, match="no rows"):
        fit(d.filter("false"), "y", "features")
    repeated = d.unionByName(d).withColumn("i", F.when(F.col("i") > 5, F.col("i")))
    assert md.scored(ls.fit_lockstep([(fit, repeated, "y", "features", "i")])[0], d).filter("score IS NULL").count() == 0


def test_queries_grow_all_their_boosted_fits_in_one_call(spark, monkeypatch):
    """Architectures, stacks in them, and all sets and folds of a cross-validation."""
    calls = []
    monkeypatch.setattr(md, "fit_lockstep", lambda asked: calls.append(len(asked)) or ls.fit_lockstep(asked))
    d = _rows(spark, 240).withColumnRenamed("i", "idx").drop("features").persist()
    got = {(r.architecture, r.fold): r.auc for r in md.compare_architectures(d, 240, [*"abc"], rounds=2, trees=2, k=2, label="y", stack_folds=2).collect()}
    assert set(got) == {(a, f) for a in ("Boosted Trees", "Random Forest", "Stacking") for f in (1, 2)} and min(got.values()) > 0.6
    assert calls == [2 + 2 * 3]
    dated = d.withColumn("at", F.to_timestamp(F.lit("2020-01-01")))
    cv = md.time_series_cv(dated, "at", ["idx"], {"all": [*"abc"], "two": ["a", "b"]}, {"boosted": ls.Boosted(2, 3, 0.3)}, 2, "y").collect()
    assert {(r.feature_set, r.model, r.fold) for r in cv} == {(s, "boosted", f) for s in ("all", "two") for f in (1, 2)}
    assert calls[1:] == [4] and min(r.auc for r in cv) > 0.6


def test_edges_of_many_sets_cost_as_many_jobs_as_of_one(spark, jobs, monkeypatch):
    d = _rows(spark)
    sets = [(md.assemble(d.drop("features").filter(f"i >= {k}"), ["a", "b", "c"][:1 + k % 3]), "features") for k in range(6)]
    monkeypatch.setattr(ls, "COUNTED_ROWS", 957)
    found = ls.edges_of_sets(sets)
    assert found == [ls.vector_edges(*s) for s in sets] and [len(e) for _, e in found] == [1, 2, 3, 1, 2, 3]
    fits = [(ls.Boosted(2, 3), s, "y", "features", "i") for s, _ in sets]
    monkeypatch.setattr(ls, "COUNTED_ROWS", 10_000)
    one, many = (jobs(lambda k=k: ls.fit_lockstep(fits[:k])) for k in (1, 6))
    assert many <= one + 1


def test_a_small_fit_grows_all_its_trees_in_one_step(spark, jobs, monkeypatch):
    d = _rows(spark)
    assert d.count() == 960
    few, many = (jobs(lambda n=n: ls.fit_lockstep([(ls.Boosted(n, 2), d, "y", "features", "i")])) for n in (10, 50))
    assert many <= few
    monkeypatch.setattr(ls, "STEP_ROWS", 960)
    monkeypatch.setattr(ls, "STEP_ROUNDS", 3)
    whole = ls.fit_lockstep([(ls.Boosted(8, 3, 0.3, 0.7, 0.6), d, "y", "features", "i")])[0]
    monkeypatch.setattr(ls, "STEP_ROWS", 10**6)
    again = ls.fit_lockstep([(ls.Boosted(8, 3, 0.3, 0.7, 0.6), d, "y", "features", "i")])[0]
    assert len(whole.trees.trees) == 8 and all(np.array_equal(x, y) for t, u in zip(whole.trees.trees, again.trees.trees) for x, y in zip(t, u))


def test_bins_of_arrays_are_those_of_columns(spark):
    values = [-1.0, -0.0, 0.0, 0.5, 1.0, 2.5, float("nan"), float("inf"), float("-inf")]
    edges = {"a": [-0.5, 0.0, 1.0], "b": []}
    d = spark.createDataFrame([(i, v, v) for i, v in enumerate(values)], "i int, a double, b double")
    want = [r.x for r in d.select("i", bt.binned(edges).alias("x")).orderBy("i").collect()]
    assert ls.bins_of(np.array([values, values]).T, ls.edge_arrays(edges)).tolist() == want


def test_folds_are_prepared_once_and_scored_in_one_pass(spark, monkeypatch):
    """For all sets of columns and all models, stacks among them."""
    calls = []
    monkeypatch.setattr(md, "prepare", lambda *a, own=md.prepare, **k: calls.append(a[2]) or own(*a, **k))
    d = _rows(spark, 240).withColumnRenamed("i", "idx").drop("features").persist()
    both = md.prepared_sets(d, 240, [["a", "b"], ["b", "c"]], 2, "y")
    assert calls == [["a", "b", "c"]] * 2
    for folds, cols in zip(both, (["a", "b"], ["b", "c"])):
        for (f, train, test), (g, train_1, test_1) in zip(folds, md.prepared_folds(d, 240, cols, 2, "y")):
            assert f == g and all(x.select("idx", "y", "__x").exceptAll(y.select("idx", "y", "__x")).isEmpty() for x, y in ((train, train_1), (test, test_1)))
    fold, train, test = both[0][1]
    models = [("boosted", ls.Boosted(2, 2)(train, "y", "__x")), ("line", md.fit_logistic(train, "y", "__x")), ("forest", md.fit_forest(train, "y", "__x", 2, 2))]
    out = md._fold_rows(models, fold, test, "y")
    assert out._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    got = {(r.fit, r.idx): r for r in out.collect()}
    assert len(got) == 3 * 80 and {r.fold for r in got.values()} == {2}
    for name, model in models:
        assert all(got[name, r.idx].score == pytest.approx(r.score) and got[name, r.idx].label == r.y for r in md.scored(model, test).collect())
    calls.clear()
    md.compare_architectures(d, 240, ["a", "b"], rounds=1, trees=1, k=2, label="y", stack_folds=2)
    assert len(calls) == 2


def _block(n=4000, width=5, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 32, (n, width)).astype(np.uint8)
    x[:, 1] = 7
    y = np.where(x[:, 0] + x[:, 2] * (x[:, 3] > 9) + rng.normal(0, 8, n) > 20, 1.0, -1.0)
    return ls.Block(0, x, y, rng.integers(-2**62, 2**62, n), np.zeros(n, np.int32), np.zeros(n))


@pytest.mark.parametrize("settings", [
    ls.Boosted(4, 7, 0.3, 0.6, 0.7, 3, 0.001), ls.Boosted(3, 11, 0.2, 1.0, 1.0, 1), ls.Boosted(3, 5, 0.1, 0.9, 0.5, 400), ls.Boosted(2, 3, min_gain=9.0), ls.Boosted(2, 1),
])
def test_a_fit_in_one_task_counts_one_child_of_a_node_and_grows_the_trees_of_whole_counts(monkeypatch, settings):
    b = _block()
    fit, block = ls.Growing(settings, 5), b
    while not fit.done:
        at = fit.level()
        found = ls.no_cuts(at)
        for (_, first), table in ls.sums(block, at):
            found[first:first + len(table)] = ls.best_cuts(table, at, first)
        block = ls.move(block, fit.take(found))
    counted = []
    monkeypatch.setattr(ls.Part, "count", lambda self, at, *a, own=ls.Part.count: counted.append(len(at)) or own(self, at, *a))
    for rows in (4000, 333):
        monkeypatch.setattr(ls, "PART_ROWS", rows)
        counted.clear()
        got = ls.grown(b, ls.Level(settings, 0, 0, 1, 5))
        for t, u in zip(got.trees, fit.trees, strict=True):
            assert all(np.array_equal(v, w) for v, w in zip(t[:5], u[:5])) and np.allclose(t.value, u.value, atol=1e-12)
        assert sum(counted) <= 4000 * settings.rounds * (1 + (settings.depth - 1) / 2)
        assert len(got.y) == len(got.x) == len(got.margin) == 0
    monkeypatch.setattr(ls, "STEP_ROUNDS", 1)
    monkeypatch.setattr(ls, "STEP_ROWS", 1)
    half = ls.grown(b, ls.Level(settings, 0, 0, 1, 5))
    rest = ls.grown(half, ls.Level(settings, 1, 0, 1, 5))
    assert len(half.trees) == len(rest.trees) == 1 and np.allclose(rest.trees[0].value, fit.trees[1].value)
    assert np.allclose(half.margin, bt.outputs(half.trees, b.x.astype(np.int16), np.zeros(4000)))


def test_a_fit_of_some_hundred_thousand_rows_needs_no_job_for_each_level(spark, jobs):
    d = spark.range(260_000).select("id", (F.col("id") % 97).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    d = md.assemble(d.withColumn("y", (F.col("a") + 9 * F.col("b") > 50).cast("int")).coalesce(4), ["a", "b"]).persist()
    assert d.count() == 260_000
    assert jobs(lambda: ls.fit_lockstep([(ls.Boosted(8, 3, 0.3), d, "y", "features", "id")])) < 12
    d.unpersist()


def test_wide_rows_are_dealt_over_more_tasks(spark, monkeypatch):
    d = _rows(spark, wide=True)
    asked = [(ls.Boosted(2, 2, 0.3), d, "y", "features", "i")]
    parts = []
    monkeypatch.setattr(ls, "deal", lambda sets, users, n, order, own=ls.deal: parts.append(list(n)) or own(sets, users, n, order))
    whole = ls.fit_lockstep(asked)[0]
    monkeypatch.setattr(ls, "TASK_CELLS", 11 * 400)
    dealt = ls.fit_lockstep(asked)[0]
    assert parts == [[1], [3]] and all(np.allclose(x, y) for t, u in zip(whole.trees.trees, dealt.trees.trees) for x, y in zip(t, u))


@pytest.mark.parametrize("balanced", [False, True])
def test_a_tree_of_all_rows_is_that_of_sparks_forest(spark, monkeypatch, balanced):
    from pyspark.ml.classification import RandomForestClassifier

    d = _rows(spark).drop("features")
    # weights move the edges of Spark's bins where values are many
    d = md.assemble(d, [*"ab"] if balanced else [*"abc"]).persist()
    weighted = (md.balanced_weights(d, "y", "__w") if balanced else d.withColumn("__w", F.lit(1.0))).coalesce(1)
    monkeypatch.setattr(ls, "poisson", lambda u, round_: np.ones(len(u), np.int8))
    (n, edges), block = ls.vector_edges(d, "features"), []
    rows = ls.blocks(d, "y", "features", "i", edges).collect()
    u, y, x = (np.concatenate([np.frombuffer(r[c], kind) for r in rows]) for c, kind in (("u", np.int64), ("y", np.int8), ("x", np.uint8)))
    block = ls.Block(0, x.reshape(n, -1), y * 2.0 - 1, u, np.zeros(n, np.int32), np.zeros(n))
    for depth in (1, 3, 8):
        own = RandomForestClassifier(labelCol="y", featuresCol="features", weightCol="__w", numTrees=1, maxDepth=depth, bootstrap=False).fit(weighted)
        got = ls.grown(block, ls.Level(ls.Bagged(1, depth, balanced), 0, 0, 1, len(edges)))
        assert len(got.trees[0].left) == own.trees[0].numNodes
        mine = ls.VectorTrees(bt.BoostedTrees(edges, got.trees, 0.0, True), "features", True)
        both = md.scored(mine, md.scored(own, d, "s1"), "s2")
        assert both.select(F.max(F.abs(F.col("s1") - F.col("s2")))).first()[0] < 1e-12


def test_rows_of_a_tree_are_poisson_draws():
    u = np.random.default_rng(0).integers(-2**62, 2**62, 20_000)
    draws = np.stack([ls.poisson(u, k) for k in range(20)])
    assert abs(draws.mean() - 1) < 0.01 and abs(draws.var() - 1) < 0.02 and abs(np.corrcoef(draws) - np.eye(20)).max() < 0.04
    assert (ls.poisson(u[100:200], 7) == draws[7, 100:200]).all()


def test_large_forests_grow_beside_the_boosted_fits(spark, monkeypatch):
    d = _rows(spark).withColumnRenamed("i", "idx").withColumnRenamed("features", "__x").persist()
    calls, own = [], []
    monkeypatch.setattr(md, "fit_lockstep", lambda asked: calls.append([type(a[0]) for a in asked]) or ls.fit_lockstep(asked))
    monkeypatch.setattr(md, "fit_forest", lambda *a, fit=md.fit_forest, **k: own.append(a[3:]) or fit(*a, **k))
    forest = md.Forest(40, 5, True)
    asked = [(ls.Boosted(2, 2), d, "y", "__x", "idx"), (forest, d, "y", "__x", "idx"), (forest, d.filter("idx < 500"), "y", "__x", "idx")]
    few = md.fit_all(spark, asked)
    assert calls == [[ls.Boosted]] and own == [(40, 5, True)] * 2
    calls.clear(), own.clear()
    monkeypatch.setattr(ls, "COUNTED_ROWS", 700)
    many = md.fit_all(spark, asked)
    assert calls == [[ls.Boosted, ls.Bagged]] and own == [(40, 5, True)]
    a, b = (md.scored(models[1], d, "s") for models in (few, many))
    auc = [ev.roc_auc(m, "s", "y").first().roc_auc for m in (a, b)]
    assert min(auc) > 0.9 and abs(auc[0] - auc[1]) < 0.02
    assert a.join(b.select("idx", F.col("s").alias("t")), "idx").select(F.avg(F.abs(F.col("s") - F.col("t")))).first()[0] < 0.05
    assert len(many[1].trees.trees) == 40 and b.agg(F.min("s"), F.max("s")).first()[0] >= 0
    monkeypatch.setattr(ls, "TASK_ROWS", 900)
    assert forest.together(d, "__x") is None
    with pytest.raises(ValueError, match="forests of over"):
        ls.fit_lockstep([(ls.Bagged(2, 2), d, "y", "__x", "idx")])


def test_many_equal_values_leave_a_forest_its_other_cuts(spark, monkeypatch):
    d = spark.range(2000).select("id", F.when(F.col("id") < 1500, 0.0).otherwise(F.col("id").cast("double")).alias("a"), (F.col("id") % 2).cast("int").alias("y"))
    d = md.assemble(d, ["a"])
    monkeypatch.setattr(ls, "COUNTED_ROWS", 900)
    (_, quantiles), (_, found) = ls.edges_of_sets([(d, "features")] * 2, middle=frozenset([1]))
    assert len(quantiles["__x0"]) < 12 < len(found["__x0"]) <= 31 and min(found["__x0"]) > 0
