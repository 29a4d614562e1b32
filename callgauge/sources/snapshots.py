"""Tables that grow by batches and survive a crash at any moment.

A table is a folder. ``data`` holds one folder of parquet files for each batch, ``manifests`` one JSON file for
each version that names the folders of that version and the batches in them. A batch is written first, under a name
never used before; it becomes part of the table when its manifest is renamed to the next version's name, which is one
step and fails if that version exists. So a run that dies before the rename has changed nothing, one that dies after it
has added everything, and running a batch again adds nothing. Readers see the version they opened, whatever is added
meanwhile. The folder's file system must rename a file in one step and refuse an existing name, as HDFS does.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from callgauge.operators.sets import append_new_bars
from callgauge.session import discard

_VERSION = re.compile(r"v(\d{10})\.json")


class Conflict(RuntimeError):
    """Another run has made the version that this one was about to make."""


@dataclass(frozen=True)
class Version:
    """One state of a table: folders in the order they were added, each with the name of its batch."""

    number: int
    folders: tuple[str, ...]
    batches: tuple[str, ...]
    schema: T.StructType | None


_EMPTY = Version(0, (), (), None)


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark._jvm
        self._hadoop_path = jvm.org.apache.hadoop.fs.Path
        self._files = self._hadoop_path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _in(self, *names: str):
        return self._hadoop_path(os.path.join(self.path, *names))

    def _names(self, folder: str) -> list[str]:
        where = self._in(folder)
        return sorted(s.getPath().getName() for s in self._files.listStatus(where)) if self._files.exists(where) else []

    # ------------------------------------------------------------ versions

    def versions(self) -> list[int]:
        return [int(m[1]) for n in self._names("manifests") if (m := _VERSION.fullmatch(n))]

    def open(self, number: int | None = None) -> Version:
        """The given version, or the newest; version 0 is the empty table."""
        number = max(self.versions(), default=0) if number is None else number
        if number == 0:
            return _EMPTY
        lines = self.spark.read.text(str(self._in("manifests", f"v{number:010d}.json")), wholetext=True).first()
        told = json.loads(lines["value"])
        return Version(number, tuple(told["folders"]), tuple(told["batches"]), T.StructType.fromJson(told["schema"]))

    def read(self, version: Version | int | None = None) -> DataFrame | None:
        """Rows of a version, None of the empty table."""
        version = version if isinstance(version, Version) else self.open(version)
        if not version.folders:
            return None
        return self.spark.read.schema(version.schema).parquet(*[str(self._in("data", f)) for f in version.folders])

    # ------------------------------------------------------------ writing

    def append(self, rows: DataFrame, batch: str, base: Version | None = None) -> Version:
        """Add ``rows`` as ``batch`` and return the new version; nothing happens if the batch is there already.

        ``base`` is the version that ``rows`` were worked out from: if another run has added to the table
        since then, ``Conflict`` is raised and the rows are not added.
        """
        newest = self.open()
        if batch in newest.batches:
            return newest
        base = newest if base is None else base
        if base.number != newest.number:
            raise Conflict(f"version {newest.number} was made after version {base.number} was read")
        if base.schema is not None:
            rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in base.schema])
        folder = uuid.uuid4().hex
        rows.write.parquet(str(self._in("data", folder)))
        schema = base.schema or self.spark.read.parquet(str(self._in("data", folder))).schema
        made = Version(base.number + 1, (*base.folders, folder), (*base.batches, batch), schema)
        self._commit(made)
        return made

    def _commit(self, version: Version) -> None:
        told = {"folders": version.folders, "batches": version.batches, "schema": version.schema.jsonValue()}
        draft = self._in("manifests", f"_draft-{uuid.uuid4().hex}")
        out = self._files.create(draft, False)
        try:
            out.write(json.dumps(told).encode())
        finally:
            out.close()
        self._publish(draft, self._in("manifests", f"v{version.number:010d}.json"))

    def _publish(self, draft, target) -> None:
        """The one step that makes a version: a rename that does not replace."""
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getFileSystem(
            self.spark._jsc.hadoopConfiguration()).getUri(), self.spark._jsc.hadoopConfiguration())
        if self._files.exists(target):
            self._files.delete(draft, False)
            raise Conflict(f"{target.getName()} exists")
        context.rename(self._files.makeQualified(draft), self._files.makeQualified(target), options)

    def vacuum(self) -> list[str]:
        """Remove what no version names: folders and drafts of runs that died. Only while no run is writing."""
        named = {f for n in self.versions() for f in self.open(n).folders}
        left = [os.path.join("data", f) for f in self._names("data") if f not in named]
        left += [os.path.join("manifests", n) for n in self._names("manifests") if not _VERSION.fullmatch(n)]
        for name in left:
            discard(self.spark, str(self._in(name)))
        return left


# ---------------------------------------------------------------- what the stages append


def score_new(table: SnapshotTable, rows: DataFrame, key: Sequence[str], score: Callable[[DataFrame], DataFrame], batch: str) -> Version:
    """Score the rows whose key the table lacks and add them as one batch; a run again scores and adds nothing."""
    base = table.open()
    if batch in base.batches:
        return base
    done = table.read(base)
    fresh = rows if done is None else rows.join(done.select(*key).distinct(), list(key), "left_anti")
    return table.append(score(fresh), batch, base)


def store_new_bars(table: SnapshotTable, fresh: DataFrame, key: Sequence[str], date: str, columns: Sequence[str], batch: str) -> Version:
    """Add the bars after the last stored date as one batch; stored rows stay as they are."""
    base = table.open()
    if batch in base.batches:
        return base
    done = table.read(base)
    stored = fresh.sparkSession.createDataFrame([], fresh.select(*[c for c in columns if c in fresh.columns]).schema) if done is None else done
    newest = None if done is None else done.agg(F.max(date)).first()[0]
    added = append_new_bars(stored.filter("false"), fresh if newest is None else fresh.filter(F.col(date) > F.lit(newest)), key, date, columns)
    return table.append(added, batch, base)
