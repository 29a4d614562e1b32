"""Mutual information between numbers and a label by nearest neighbours, without bins and without pairs of rows.

For every value the distance to its k-th nearest neighbour of the same class is found, and how many rows of
any class lie nearer than that. On one axis neighbours stand next to each other: the axis is cut into ranges,
each range of a class gets the k values before and after it carried over, and the rest is a window of k rows.
How many rows lie in a stretch is the difference of two running totals. Equal values of a class are one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from callgauge.operators.ordering import range_index, running_totals
from callgauge.session import materialize, shuffle_width

EULER = 0.5772156649015329
#: Up to this number the digamma function is a sum, beyond it a series that is exact to twelve digits.
SUMMED = 20


def digamma_table() -> list[float]:
    """Digamma of 1 to ``SUMMED``."""
    return [-EULER + sum(1 / j for j in range(1, n)) for n in range(1, SUMMED + 1)]


def digamma(n: Column) -> Column:
    """Digamma function of a whole number from 1 on."""
    x = n.cast("double")
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    return F.when(n <= SUMMED, F.get(F.array(*map(F.lit, digamma_table())), n.cast("int") - 1)).otherwise(series)


def default_neighbours(n: int) -> int:
    """Five, or a fifth of the rows if there are few."""
    return min(5, max(1, n // 5))


def class_values(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """(feature, y, x, n): how often each class has each value; missing, NaN and infinite values and missing labels take no part."""
    value = lambda c: F.col(c).cast("double")
    known = lambda c: value(c).isNotNull() & ~F.isnan(value(c)) & (F.abs(value(c)) < float("inf"))
    # -0.0 is 0.0
    cells = F.array_compact(F.array(*[F.when(known(c), F.struct(F.lit(c).alias("feature"), (value(c) + 0.0).alias("x"))) for c in cols]))
    rows = df.filter(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("y"), F.explode(cells).alias("f"))
    return rows.groupBy("f.feature", "y", "f.x").agg(F.count(F.lit(1)).alias("n"))


def axis_ranges(values: DataFrame, cols: Sequence[str]) -> Column:
    """The range of ``x`` on the axis of its ``feature``, each feature's with about equally many values."""
    n = shuffle_width(values.sparkSession)
    cuts = [i / n for i in range(1, n)]
    bounds = {}
    if cuts:
        found = values.groupBy("feature").agg(F.percentile_approx("x", F.array(*map(F.lit, cuts)), F.lit(max(10_000, 10 * n))).alias("b")).collect()
        bounds = {row["feature"]: sorted(set(row["b"])) for row in found}
    out = F.lit(0)
    for c in cols:
        out = F.when(F.col("feature") == c, range_index(F.col("x"), bounds.get(c, []))).otherwise(out)
    return out


def with_margins(values: DataFrame, k: int) -> DataFrame:
    """``values`` (feature, y, x, n, r) and, marked as ``ghost``, the ``k`` values of the class before and after each range."""
    inside = W.partitionBy("feature", "y", "r")
    numbered = values.withColumns({"up": F.row_number().over(inside.orderBy("x")), "down": F.row_number().over(inside.orderBy(F.desc("x")))})
    point = F.struct("x", "n")
    ends = numbered.filter((F.col("up") <= k) | (F.col("down") <= k)).groupBy("feature", "y", "r").agg(
        F.sort_array(F.collect_list(F.when(F.col("up") <= k, point))).alias("head"), F.sort_array(F.collect_list(F.when(F.col("down") <= k, point))).alias("tail"))
    # every range listed has a value at least, so k of them hold the k values next to a border
    along = W.partitionBy("feature", "y").orderBy("r")
    before = F.flatten(F.collect_list("tail").over(along.rowsBetween(-k, -1)))
    after = F.flatten(F.collect_list("head").over(along.rowsBetween(1, k)))
    margins = ends.select("feature", "y", "r", before.alias("b"), after.alias("a"))
    near = F.concat(F.slice("b", F.greatest(F.size("b") - k + 1, F.lit(1)), k), F.slice("a", 1, k))
    ghosts = margins.select("feature", "y", "r", F.explode(near).alias("g")).select("feature", "y", "g.x", "g.n", "r", F.lit(True).alias("ghost"))
    return values.select("feature", "y", "x", "n", "r", F.lit(False).alias("ghost")).unionByName(ghosts)


def balls(values: DataFrame, k: int) -> DataFrame:
    """(feature, x, n, k, n_class, lo, hi): between which values the rows nearer than the k-th neighbour lie, borders left out.

    With k copies or more of a value its ball is the value itself: ``lo`` and ``hi`` are null. ``k`` is smaller
    in a class with fewer other rows; a class of one row has none.
    """
    line = W.partitionBy("feature", "y", "r").orderBy("x")
    point = F.struct("x", "n")
    lined = with_margins(values, k).withColumns({"left": F.collect_list(point).over(line.rowsBetween(-k, -1)), "right": F.collect_list(point).over(line.rowsBetween(1, k))})
    classes = values.groupBy("feature", "y").agg(F.sum("n").alias("n_class")).filter("n_class > 1")
    asked = lined.filter("NOT ghost").join(classes, ["feature", "y"]).withColumn("k", F.least(F.lit(k), F.col("n_class") - 1))
    apart = F.sort_array(F.transform(F.concat("left", "right"), lambda p: F.struct(F.abs(p["x"] - F.col("x")).alias("d"), p["n"].alias("n"))))
    need = F.col("k") - F.col("n") + 1
    start = F.struct(F.lit(0).cast("long").alias("met"), F.lit(0.0).alias("d"))
    reach = F.aggregate(apart, start, lambda a, p: F.when(a["met"] >= need, a).otherwise(F.struct((a["met"] + p["n"]).alias("met"), p["d"].alias("d"))), lambda a: a["d"])
    asked = asked.withColumn("d", reach)
    # where the k-th neighbour itself is the border its value is taken, not a sum that may be rounded
    own = lambda side: F.array_max(F.transform(F.filter(side, lambda p: F.abs(p["x"] - F.col("x")) == F.col("d")), lambda p: p["x"]))
    some = F.col("d") > 0
    return asked.select(
        "feature", "x", "n", "k", "n_class", F.when(some, F.coalesce(own("left"), F.col("x") - F.col("d"))).alias("lo"),
        F.when(some, F.coalesce(own("right"), F.col("x") + F.col("d"))).alias("hi"))


def neighbour_information(df: DataFrame, cols: Sequence[str], label: str, neighbours: int | None = None) -> DataFrame:
    """(feature, score): mutual information in nats of each of ``cols`` with ``label``, at least 0.

    No noise is added to break ties: values at the same distance count together, and a value with ``neighbours``
    copies or more in its class has a ball of no width, which holds all rows of that value. Features without a
    class of two rows score 0.
    """
    k = neighbours or default_neighbours(df.count())
    values = class_values(df, cols, label)
    values = materialize(values.withColumn("r", axis_ranges(values, cols)), "class-values")
    asked = materialize(balls(values, k), "balls")
    sized = values.join(values.groupBy("feature", "y").agg(F.sum("n").alias("n_class")).filter("n_class > 1"), ["feature", "y"])
    points = sized.select("feature", "x", "n")
    borders = asked.select("feature", F.explode(F.array("lo", "hi", "x")).alias("x")).filter("x IS NOT NULL").select("feature", "x", F.lit(0).cast("long").alias("n"))
    along = running_totals(points.unionByName(borders), "x", {"n": F.col("n")}, ["feature"], lambda _: axis_ranges(values, cols))
    upto = lambda name: along.select("feature", F.col("x").alias(name), F.col("n_before").alias(f"{name}_below"), (F.col("n_before") + F.col("n")).alias(f"{name}_upto"))
    wide = asked.filter("lo IS NOT NULL").join(upto("lo"), ["feature", "lo"]).join(upto("hi"), ["feature", "hi"])
    narrow = asked.filter("lo IS NULL").join(upto("x"), ["feature", "x"])
    figures = ("feature", "n", "k", "n_class")
    held = wide.select(*figures, (F.col("hi_below") - F.col("lo_upto")).alias("m")).unionByName(narrow.select(*figures, (F.col("x_upto") - F.col("x_below")).alias("m")))
    mean = lambda c: F.sum(F.col("n") * digamma(F.col(c))) / F.sum("n")
    scores = held.groupBy("feature").agg((digamma(F.sum("n")) + mean("k") - mean("n_class") - mean("m")).alias("score"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    return names.join(scores, "feature", "left").select("feature", F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)).alias("score"))
