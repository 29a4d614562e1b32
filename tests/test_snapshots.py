"""Appends that a crash cannot halve and that a second run does not repeat."""

import pytest

from callgauge.sources.snapshots import Conflict, SnapshotTable, score_new, store_new_bars


def rows(spark, ids):
    return spark.createDataFrame([(i, f"text {i}") for i in ids], "id long, text string")


def score(df):
    return df.selectExpr("id", "length(text) AS score")


def ids(table, version=None):
    got = table.read(version)
    return [] if got is None else sorted(r["id"] for r in got.collect())


@pytest.fixture()
def table(spark, tmp_path):
    return SnapshotTable(spark, str(tmp_path / "scores"))


def test_batches_add_up_and_old_versions_stay(spark, table):
    assert table.read() is None and table.versions() == []
    score_new(table, rows(spark, [1, 2]), ["id"], score, "monday")
    score_new(table, rows(spark, [2, 3]), ["id"], score, "tuesday")
    assert ids(table) == [1, 2, 3] and ids(table, 1) == [1, 2] and table.open().batches == ("monday", "tuesday")


def test_a_second_run_scores_and_adds_nothing(spark, table):
    first = score_new(table, rows(spark, [1, 2]), ["id"], score, "monday")
    never = lambda df: pytest.fail("scored again")
    assert score_new(table, rows(spark, [1, 2, 3]), ["id"], never, "monday") == first
    assert table.append(score(rows(spark, [9])), "monday") == first
    assert ids(table) == [1, 2] and len(table._names("data")) == 1


def test_a_crash_between_write_and_commit_changes_nothing(spark, table, monkeypatch):
    score_new(table, rows(spark, [1, 2]), ["id"], score, "monday")

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(SnapshotTable, "_publish", dies)
        with pytest.raises(KeyboardInterrupt):
            score_new(table, rows(spark, [2, 3]), ["id"], score, "tuesday")
    assert len(table._names("data")) == 2 and ids(table) == [1, 2] and table.versions() == [1]
    score_new(table, rows(spark, [2, 3]), ["id"], score, "tuesday")
    assert ids(table) == [1, 2, 3] and table.versions() == [1, 2]
    left = table.vacuum()
    assert len(left) == 2 and len(table._names("data")) == 2 and ids(table) == [1, 2, 3] and table.vacuum() == []


def test_a_crash_while_scoring_changes_nothing(spark, table):
    bad = lambda df: df.selectExpr("id", "CAST(raise_error('lost') AS BIGINT) AS score")
    with pytest.raises(Exception, match="lost"):
        score_new(table, rows(spark, [1]), ["id"], bad, "monday")
    assert table.read() is None
    score_new(table, rows(spark, [1]), ["id"], score, "monday")
    assert ids(table) == [1]


def test_of_two_runs_from_one_version_one_wins(spark, table, monkeypatch):
    base = table.open()
    table.append(score(rows(spark, [1])), "a", base)
    with pytest.raises(Conflict):
        table.append(score(rows(spark, [1])), "b", base)
    # also if the other run commits after this one has looked
    monkeypatch.setattr(table, "open", lambda number=None: base)
    with pytest.raises(Conflict):
        table.append(score(rows(spark, [1])), "b", base)
    monkeypatch.undo()
    assert ids(table) == [1] and not [n for n in table._names("manifests") if "draft" in n]


def test_the_first_batch_fixes_names_and_types(spark, table):
    table.append(spark.createDataFrame([(1, "a")], "id long, name string"), "a")
    table.append(spark.createDataFrame([("b", 2, True)], "name string, id int, more boolean"), "b")
    assert sorted(map(tuple, table.read().collect())) == [(1, "a"), (2, "b")]


def test_an_empty_batch_is_a_version(spark, table):
    score_new(table, rows(spark, []), ["id"], score, "none")
    assert ids(table) == [] and table.versions() == [1] and table.read().columns == ["id", "score"]


def test_bars_after_the_last_stored_date(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "bars"))
    bars = spark.createDataFrame([("A", "2024-01-01", 1.0), ("A", "2024-01-02", 2.0), ("A", "2024-01-02", 2.0)], "t string, d string, c double")
    late = spark.createDataFrame([("A", "2024-01-02", 9.0), ("A", "2024-01-03", 3.0)], "t string, d string, c double")
    for batch, fresh in (("one", bars), ("two", late), ("two", late)):
        store_new_bars(table, fresh, ["t", "d"], "d", ["t", "d", "c", "x"], batch)
    assert sorted(map(tuple, table.read().collect())) == [("A", "2024-01-01", 1.0, 0), ("A", "2024-01-02", 2.0, 0), ("A", "2024-01-03", 3.0, 0)]
