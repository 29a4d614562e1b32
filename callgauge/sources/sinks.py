"""Sinks: every stage table, its narrow view, its statistics and its texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from callgauge.session import shuffle_width


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "error") -> str:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def write_records_json(df: DataFrame, path: str, mode: str = "error") -> str:
    """JSON lines, one record per line, so that readers can split the files."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
    return path


def write_metadata_projection(df: DataFrame, cols: Sequence[str], path: str, mode: str = "error") -> str:
    return write_table(df.select(*cols), path, "csv", mode=mode)


def write_run_stats(stats: DataFrame, path: str, mode: str = "error") -> str:
    """A one-row table of counters as one JSON record."""
    stats.coalesce(1).write.mode(mode).json(path)
    return path


def text_with_header(text: str, company: str, ticker: str, quarter: str, date: str) -> Column:
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return F.concat_ws(
        "\n", line("Company", company), line("Ticker", ticker), line("Quarter", quarter), line("Date", date),
        F.lit("=" * 60), F.lit(""), F.col(text),
    )


def write_text_by_key(
    df: DataFrame, path: str, text: str = "full_text", key: Sequence[str] = ("ticker", "quarter"), company: str = "company_name",
    date: str = "date", mode: str = "error",
) -> str:
    """One folder per key with the text below a five-line header.

    Rows are placed by key and, within a key, by a hash of the text: a key with one text gets
    one file, a key with very many spreads over several.
    """
    out = df.withColumn("value", text_with_header(text, company, key[0], key[1], date)).select(*key, "value")
    out.repartition(*key, F.pmod(F.xxhash64("value"), F.lit(shuffle_width(df.sparkSession)))).write.mode(mode).partitionBy(*key).text(path)
    return path
