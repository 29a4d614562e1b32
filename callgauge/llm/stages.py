"""Stage tables of one query: written to the shared folder, dropped when nothing reads them any more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callgauge.session import discard, new_path


class Stage:
    """Writes stage tables and remembers where each lies."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame, name: str = "stage", path: str | None = None) -> DataFrame:
        path = path or new_path(self.spark, name)
        df.write.parquet(path)
        # nothing holds the shuffle files behind this table any more: let Spark's cleaner see that now, as a
        # driver with little garbage of its own would keep them on the executors' disks until the query ends
        self.spark._jvm.System.gc()
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for table, path in list(self.paths):
            if any(table is t for t in tables):
                discard(self.spark, path)
                self.paths.remove((table, path))
