"""Order-dependent operators without one-task windows.

A window over a hot key, or over no key at all, lands in one task. Everything here
first cuts the order axis into ranges, works inside ``(key, range)``, and carries the
little that crosses a range border (a total, a last value, a few rows) over a table
with one row per key and range. Rows with an equal key and order value are folded
together before anything is sorted, so copies of one moment cost one row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from callgauge.session import shuffle_width

RangeFn = Callable[[Column], Column]

DAY = 86_400
#: Distinct strings from which the borders of string ranges are taken.
STRING_SAMPLE = 10_000


def order_number(col: Column, dtype: T.DataType) -> Column:
    """A number that never decreases along the order of ``col``."""
    if isinstance(dtype, T.DateType):
        return F.unix_date(col).cast("double")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(col.cast("timestamp")).cast("double")
    if isinstance(dtype, T.NumericType):
        return col.cast("double")
    raise TypeError(f"no number follows the order of {dtype.simpleString()}")


def calendar_range(days: int) -> RangeFn:
    """Ranges of a fixed number of days on a date or timestamp column."""
    return lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / F.lit(days * DAY))


def default_range(df: DataFrame, col: str, *others: tuple[DataFrame, str]) -> RangeFn:
    """Years for dates: a key has few distinct days in one and few of them altogether, whatever
    share of the rows it holds. For clock times, ranges with about equally many rows of all
    tables, so that the part of a hot key in one range is no larger than a usual partition."""
    if isinstance(df.schema[col].dataType, T.DateType):
        return calendar_range(366)
    times = df.select(F.col(col).alias("__t"))
    for other, other_col in others:
        times = times.unionByName(other.select(F.col(other_col).alias("__t")))
    return even_range(times, "__t")


def _pick(number: Column, bounds: Sequence[float], lo: int, hi: int) -> Column:
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(number <= F.lit(bounds[mid]), _pick(number, bounds, lo, mid)).otherwise(
        _pick(number, bounds, mid + 1, hi)
    )


def _search(number: Column, bounds: Sequence[float]) -> Column:
    """Binary search in a literal array, for more borders than generated code can hold."""
    edges = F.array(*map(F.lit, bounds))
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        left = F.struct(s["lo"].alias("lo"), mid.alias("hi"))
        right = F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))
        return F.when(s["lo"] >= s["hi"], s).when(number <= F.get(edges, mid), left).otherwise(right)

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), halve, lambda s: s["lo"])


def range_index(number: Column, bounds: Sequence[float]) -> Column:
    """Position of the range a number falls in; null for null."""
    where = _pick(number, bounds, 0, len(bounds)) if len(bounds) <= 64 else _search(number, bounds)
    return F.when(number.isNotNull(), where)


def even_bounds(df: DataFrame, number: Column, ranges: int | None = None) -> list[float]:
    """Borders of ranges that hold about equally many rows (one pass, bounded result)."""
    n = ranges or shuffle_width(df.sparkSession)
    if n <= 1:
        return []
    cuts = [i / n for i in range(1, n)]
    row = df.agg(F.percentile_approx(number, F.array(*map(F.lit, cuts)), F.lit(max(10_000, 10 * n))).alias("b")).first()
    return sorted(set(row["b"] or []))


def borders(df: DataFrame, col: str, ranges: int | None = None) -> tuple[RangeFn, list]:
    """What to compare of a column, and borders of ranges with about equally many rows each."""
    dtype = df.schema[col].dataType
    if not isinstance(dtype, T.StringType):
        return lambda c: order_number(c, dtype), even_bounds(df, order_number(F.col(col), dtype), ranges)
    # borders of strings are whole values, taken evenly from a sample of the distinct ones
    values = df.select(F.col(col).alias("v")).filter("v IS NOT NULL").distinct().orderBy(F.xxhash64("v")).limit(STRING_SAMPLE)
    sample = sorted((row["v"] for row in values.collect()), key=lambda v: v.encode())
    n = ranges or shuffle_width(df.sparkSession)
    return lambda c: c, sorted({sample[len(sample) * i // n] for i in range(1, n)} if sample else (), key=lambda v: v.encode())


def even_range(df: DataFrame, col: str, ranges: int | None = None) -> RangeFn:
    """Ranges with about equally many rows of ``df[col]`` each."""
    measure, bounds = borders(df, col, ranges)
    return lambda c: range_index(measure(c), bounds)


# ---------------------------------------------------------------- running totals

def running_totals(
    df: DataFrame, order: str, totals: dict[str, Column], by: Sequence[str] = (), range_of: RangeFn | None = None
) -> DataFrame:
    """One row per distinct ``order`` value (within ``by``): each total, ``<name>_before``, the sum
    of that total over all smaller values, and ``<name>_all``, the sum over all values."""
    by = list(by)
    per_value = df.filter(F.col(order).isNotNull()).groupBy(*by, order).agg(
        *[F.sum(c).alias(n) for n, c in totals.items()]
    )
    range_of = range_of or even_range(df, order)
    per_value = per_value.withColumn("__r", range_of(F.col(order)))
    ranges = W.partitionBy(*_over_ranges(by))
    earlier = ranges.orderBy("__r").rowsBetween(W.unboundedPreceding, -1)
    carry = per_value.groupBy(*by, "__r").agg(*[F.sum(n).alias(f"__{n}") for n in totals]).select(
        *by, "__r",
        *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__before_{n}") for n in totals],
        *[F.sum(f"__{n}").over(ranges).alias(f"{n}_all") for n in totals],
    )
    inside = W.partitionBy(*by, "__r").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return (
        per_value.select("*", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"{n}_before") for n in totals])
        .join(carry, [*by, "__r"])
        .select(
            *by, order, *totals,
            *[(F.col(f"{n}_before") + F.col(f"__before_{n}")).alias(f"{n}_before") for n in totals],
            *[f"{n}_all" for n in totals],
        )
    )


def chronological_index(df: DataFrame, order: str, ties: Sequence[str], name: str = "idx") -> DataFrame:
    """Global 0-based position by ``(order, *ties)``.

    Ranges are cut on the order value. A value that is a border itself may hold many rows; these
    are cut further by the first tie column, so that they are spread over several ranges too.
    """
    measure, bounds = borders(df, order)
    main = measure(F.col(order))
    which = range_index(main, bounds)
    at_border = main == F.get(F.array(*map(F.lit, bounds)), which) if bounds else F.lit(False)
    within = F.when(at_border, F.coalesce(even_range(df, ties[0])(F.col(ties[0])), F.lit(-1)) + 2).otherwise(F.lit(0))
    ranged = df.withColumn("__r", F.struct(F.coalesce(which, F.lit(-1)).alias("main"), F.coalesce(within, F.lit(0)).alias("tie")))
    carry = ranged.groupBy("__r").agg(F.count(F.lit(1)).alias("__n")).select(
        "__r",
        F.coalesce(
            F.sum("__n").over(W.partitionBy(F.lit(0)).orderBy("__r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("__before"),
    )
    inside = W.partitionBy("__r").orderBy(order, *ties)
    return (
        ranged.withColumn("__i", F.row_number().over(inside) - 1)
        .join(carry, "__r")
        .withColumn(name, (F.col("__before") + F.col("__i")).cast("long"))
        .drop("__r", "__i", "__before")
    )


# ---------------------------------------------------------------- carrying values forward

def running_max(df: DataFrame, by: Sequence[str], order: str, value: str, name: str = "before", range_of: RangeFn | None = None) -> DataFrame:
    """Adds ``name``: the largest ``value`` at strictly smaller ``order`` of the key, null at the start."""
    by = list(by)
    range_of = range_of or even_range(df, order)
    per_moment = df.groupBy(*by, order).agg(F.max(value).alias("__x")).withColumn("__r", range_of(F.col(order)))
    tops = per_moment.groupBy(*by, "__r").agg(F.max("__x").alias("__top"))
    earlier = W.partitionBy(*_over_ranges(by)).orderBy("__r").rowsBetween(W.unboundedPreceding, -1)
    carry = tops.select(*by, "__r", F.max("__top").over(earlier).alias("__carry"))
    inside = W.partitionBy(*by, "__r").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    table = (
        per_moment.withColumn("__in", F.max("__x").over(inside)).join(carry, [*by, "__r"], "left")
        .select(*by, order, F.greatest("__in", "__carry").alias(name))
    )
    return df.join(table, [*by, order], "left").select(*df.columns, name)


def fill_forward(
    df: DataFrame, by: Sequence[str], order: str, cols: Sequence[str], range_of: RangeFn | None = None
) -> DataFrame:
    """Each null takes the last non-null value its key had at or before that moment.

    Rows of one key and moment are folded first (the largest value of a column counts), so
    copies neither fill a task nor depend on their order.
    """
    by = list(by)
    if not cols:
        return df
    range_of = range_of or default_range(df, order)
    folded = df.groupBy(*by, order).agg(*[F.max(c).alias(f"__{c}") for c in cols]).withColumn("__r", range_of(F.col(order)))
    closers = folded.groupBy(*by, "__r").agg(
        *[F.max_by(f"__{c}", F.when(F.col(f"__{c}").isNotNull(), F.col(order))).alias(f"__c_{c}") for c in cols]
    )
    earlier = W.partitionBy(*_over_ranges(by)).orderBy("__r").rowsBetween(W.unboundedPreceding, -1)
    carry = closers.select(*by, "__r", *[F.last(f"__c_{c}", True).over(earlier).alias(f"__c_{c}") for c in cols])
    inside = W.partitionBy(*by, "__r").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    seen = folded.withColumns({f"__{c}": F.last(f"__{c}", True).over(inside) for c in cols})
    table = seen.join(carry, [*by, "__r"], "left").select(
        *by, order, *[F.coalesce(f"__{c}", f"__c_{c}").alias(f"__{c}") for c in cols]
    )
    return (
        df.join(table, [*by, order], "left")
        .withColumns({c: F.coalesce(c, f"__{c}") for c in cols})
        .select(*df.columns)
    )


def nth_after(
    df: DataFrame, by: Sequence[str], order: str, n: int, cols: Sequence[str], name: str = "after", range_of: RangeFn | None = None
) -> DataFrame:
    """Adds struct ``name``: the row at the n-th following moment of the key, or at the last one if fewer follow."""
    by = list(by)
    table = nearby(df, df, by, order, order, cols, before=None, after=name, n_after=n, range_of=range_of)
    return df.join(table, [*by, order], "left").select(*df.columns, name)


# ---------------------------------------------------------------- as-of

def _folded(moments: DataFrame, facts: DataFrame, by: list[str], on: str, facts_on: str, cols: Sequence[str], range_of: RangeFn) -> DataFrame:
    """One row per key and moment: ``__asks`` if a left row asks there, ``__v`` the fact there, ``__r`` the range.

    Of several facts at one moment the largest by ``cols`` is kept.
    """
    value = F.struct(F.col(facts_on).alias(facts_on), *[F.col(c) for c in cols if c != facts_on])
    asks = moments.filter(F.col(on).isNotNull()).select(*by, F.col(on).alias("__t")).distinct()
    has = facts.filter(F.col(facts_on).isNotNull()).select(
        *by, F.col(facts_on).alias("__t"), F.lit(False).alias("__asks"), value.alias("__v")
    )
    empty = F.lit(None).cast(has.schema["__v"].dataType)
    both = asks.select(*by, "__t", F.lit(True).alias("__asks"), empty.alias("__v")).unionByName(has)
    folded = both.groupBy(*by, "__t").agg(F.max("__v").alias("__v"), F.max("__asks").alias("__asks"))
    return folded.withColumn("__r", range_of(F.col("__t")))


def _over_ranges(by: list[str]) -> list:
    return list(by) or [F.lit(0)]


@dataclass(frozen=True)
class Look:
    """What to find in one table of facts: the newest at or before a moment (``before``), the ``n``-th after it or the
    last if fewer follow (``after``), and whether the key has any fact at all (``known``). Each is a column name, or None."""

    facts: DataFrame
    on: str
    cols: Sequence[str]
    before: str | None = None
    after: str | None = None
    n: int = 3
    known: str | None = None

    def values(self, by: list[str], i: int) -> DataFrame:
        value = F.struct(F.col(self.on).alias(self.on), *[F.col(c) for c in self.cols if c != self.on])
        return self.facts.filter(F.col(self.on).isNotNull()).select(*by, F.col(self.on).alias("__t"), value.alias(f"__v{i}"))


def merged(moments: DataFrame, by: Sequence[str], on: str, looks: Sequence[Look], range_of: RangeFn | None = None) -> DataFrame:
    """Lookup table: a row per distinct key and moment with what every ``Look`` found.

    Moments and all facts are brought together, one row per key and moment, and sorted once inside ``(key, range)``;
    that pass finds what lies in the range. A table with a row per key and range carries the last fact and the
    first n facts of each over the borders.
    """
    by = list(by)
    range_of = range_of or default_range(moments, on, *[(look.facts, look.on) for look in looks])
    asks = moments.filter(F.col(on).isNotNull()).select(*by, F.col(on).alias("__t")).distinct().withColumn("__asks", F.lit(True))
    both = asks
    for i, look in enumerate(looks):
        both = both.unionByName(look.values(by, i), allowMissingColumns=True)
    # of several facts at one moment the largest by its columns is kept
    folded = both.groupBy(*by, "__t").agg(
        F.coalesce(F.max("__asks"), F.lit(False)).alias("__asks"), *[F.max(f"__v{i}").alias(f"__v{i}") for i in range(len(looks))]
    ).withColumn("__r", range_of(F.col("__t")))

    inside = W.partitionBy(*by, "__r").orderBy("__t")
    so_far = inside.rowsBetween(W.unboundedPreceding, 0)
    keys = ", ".join([*[f"`{c}`" for c in by], "__r"])
    range_keys = ", ".join(f"`{c}`" for c in by) or "0"
    ranges = W.partitionBy(*_over_ranges(by))
    earlier = ranges.orderBy("__r").rowsBetween(W.unboundedPreceding, -1)

    seen, closing, carried, out = {}, [], [], [*by, F.col("__t").alias(on)]
    for i, look in enumerate(looks):
        v = f"__v{i}"
        if look.before:
            seen[f"__m{i}"] = F.last(v, True).over(so_far)
            closing.append(F.max_by(v, F.when(F.col(v).isNotNull(), F.col("__t"))).alias(f"__closer{i}"))
            carried.append(F.last(f"__closer{i}", True).over(earlier).alias(f"__carry{i}"))
            out.append(F.coalesce(f"__m{i}", f"__carry{i}").alias(look.before))
        if look.after:
            ahead = [F.expr(f"lead({v}, {k}) IGNORE NULLS OVER (PARTITION BY {keys} ORDER BY __t)") for k in range(1, look.n + 1)]
            seen[f"__next{i}"] = F.array_compact(F.array(*ahead))
            seen[f"__i{i}"] = F.count(v).over(so_far)
            heads = F.sort_array(F.collect_list(F.when(F.col(f"__i{i}") <= look.n, F.col(v))))
            closing.append(F.when(F.size(heads) > 0, heads).alias(f"__heads{i}"))
            later = [F.expr(f"lead(__heads{i}, {k}) IGNORE NULLS OVER (PARTITION BY {range_keys} ORDER BY __r)") for k in range(1, look.n + 1)]
            carried.append(F.flatten(F.array_compact(F.array(*later))).alias(f"__later{i}"))
            following = F.slice(F.concat(f"__next{i}", f"__later{i}"), 1, look.n)
            out.append(F.try_element_at(following, F.lit(-1)).alias(look.after))
        if look.known:
            closing.append(F.max(F.col(v).isNotNull()).alias(f"__some{i}"))
            carried.append(F.max(f"__some{i}").over(ranges).alias(f"__known{i}"))
            out.append(F.col(f"__known{i}").alias(look.known))
    passed = folded.withColumns(seen)
    border = passed.groupBy(*by, "__r").agg(*closing).select(*by, "__r", *carried)
    return passed.filter("__asks").join(border, [*by, "__r"], "left").select(*out)


def nearby(
    moments: DataFrame, facts: DataFrame, by: Sequence[str], on: str, facts_on: str, cols: Sequence[str],
    *, before: str | None = "before", after: str | None = None, n_after: int = 3, range_of: RangeFn | None = None,
) -> DataFrame:
    """Lookup table: per distinct key and moment the newest fact at or before it, and the n-th
    fact after it (the last one if fewer follow)."""
    return merged(moments, by, on, [Look(facts, facts_on, cols, before, after, n_after)], range_of)


def asof_within(
    moments: DataFrame, facts: DataFrame, by: Sequence[str], on: str, facts_on: str, cols: Sequence[str],
    *, name: str = "match", range_of: RangeFn, ranges_back: int = 1,
) -> DataFrame:
    """Lookup table: per distinct key and moment the newest fact at or before it, seen only up to
    ``ranges_back`` ranges away: each fact visits those ranges, and nothing has to be carried."""
    by = list(by)
    folded = _folded(moments, facts, by, on, facts_on, cols, range_of)
    visits = F.when(F.col("__v").isNotNull(), F.array(*map(F.lit, range(ranges_back + 1)))).otherwise(F.array(F.lit(0)))
    spread = folded.withColumn("__s", F.explode(visits)).select(
        *by, "__t", "__v", (F.col("__asks") & (F.col("__s") == 0)).alias("__asks"), (F.col("__r") + F.col("__s")).alias("__r")
    )
    so_far = W.partitionBy(*by, "__r").orderBy("__t").rowsBetween(W.unboundedPreceding, 0)
    found = spread.withColumn("__m", F.last("__v", True).over(so_far)).filter("__asks")
    return found.select(*by, F.col("__t").alias(on), F.col("__m").alias(name))


def asof(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, cols: Sequence[str],
    *, name: str = "match", forward: bool = False, range_of: RangeFn | None = None,
) -> DataFrame:
    """Adds struct ``name`` to ``left``: the newest ``right`` row at or before ``left_on``
    (``forward``: the oldest at or after it), with ``right_on`` and ``cols``; null if none.

    The lookup is resolved on distinct moments and joined back by equality, where adaptive
    execution splits a hot key.
    """
    by = list(by)
    if not forward:
        table = nearby(left, right, by, left_on, right_on, cols, before=name, range_of=range_of)
        return left.join(table, [*by, left_on], "left").select(*left.columns, name)
    range_of = range_of or default_range(left, left_on, (right, right_on))
    folded = _folded(left, right, by, left_on, right_on, cols, range_of)
    back = W.partitionBy(*by, "__r").orderBy(F.desc("__t")).rowsBetween(W.unboundedPreceding, 0)
    seen = folded.withColumn("__m", F.last("__v", True).over(back))
    opener = F.min_by("__v", F.when(F.col("__v").isNotNull(), F.col("__t")))
    border = seen.groupBy(*by, "__r").agg(opener.alias("__o")).select(
        *by, "__r",
        F.last("__o", True).over(
            W.partitionBy(*_over_ranges(by)).orderBy(F.desc("__r")).rowsBetween(W.unboundedPreceding, -1)
        ).alias("__carry"),
    )
    table = seen.filter("__asks").join(border, [*by, "__r"], "left").select(
        *by, F.col("__t").alias(left_on), F.coalesce("__m", "__carry").alias(name)
    )
    return left.join(table, [*by, left_on], "left").select(*left.columns, name)


def daily_lookup(series: DataFrame, on: str, value: str) -> DataFrame:
    """One row per calendar day from the first to the last of a series: the newest value at or
    before the day's start (``at_or_before``), the oldest at or after it (``at_or_after``).

    The result is as long as the calendar, so joins on the day stay cheap however many rows ask.
    """
    ts = F.col(on).cast("timestamp")
    known_by = F.to_date(ts + F.expr("INTERVAL 86399999999 MICROSECOND"))
    points = series.filter(F.col(on).isNotNull())
    back = points.groupBy(known_by.alias("day")).agg(F.max_by(value, ts).alias("at_or_before"))
    ahead = points.groupBy(F.to_date(ts).alias("day")).agg(F.min_by(value, ts).alias("at_or_after"))
    both = back.join(ahead, "day", "full")
    width = F.datediff(F.lead("day").over(W.partitionBy(F.lit(0)).orderBy("day")), "day")
    ordered = both.select(
        "day", F.coalesce(width, F.lit(1)).alias("__gap"),
        F.last("at_or_before", True).over(
            W.partitionBy(F.lit(0)).orderBy("day").rowsBetween(W.unboundedPreceding, 0)).alias("at_or_before"),
        F.col("at_or_after").alias("__here"),
        F.last("at_or_after", True).over(
            W.partitionBy(F.lit(0)).orderBy(F.desc("day")).rowsBetween(W.unboundedPreceding, -1)).alias("__next"),
    )
    days = ordered.withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__gap") - 1)))
    return days.select(
        F.date_add("day", F.col("__k")).alias("day"), "at_or_before",
        F.when(F.col("__k") == 0, F.coalesce("__here", "__next")).otherwise(F.col("__next")).alias("at_or_after"),
    )
