"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size: an offset and a
step, both drawn from its name, visit every slot once. Shards take turns claiming the next slot they
prefer that is still free, until all are taken. So every shard holds nearly the same number of slots
(they differ by one at most, per unit of weight), and taking a shard away moves few slots that were
not its own. A row's place is one hash and one look-up; the table has as many rows as slots,
whatever the corpus, and is broadcast.

Defined cases: null keys hash like any other value and share one slot; repeated keys share a shard;
an empty table gives an empty result; without shards, with repeated names, a size that is not prime
or fewer slots than shards there is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgauge.llm.registry import query, table

SLOTS = 65_537
SHARDS = tuple(f"shard-{i:04d}" for i in range(256))


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def preference(shard: str, slots: int) -> tuple[int, int]:
    """Offset and step of a shard's walk over the slots; the step is never 0."""
    digest = hashlib.sha256(shard.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1


def fill_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """Shard number of every slot. Shards take turns in the order given."""
    if not shards or len(set(shards)) != len(shards) or not is_prime(slots) or slots < len(shards):
        raise ValueError("needs distinct shards and a prime number of slots, at least one for each")
    owner = [-1] * slots
    walks = [preference(s, slots) for s in shards]
    at = [offset for offset, _ in walks]
    left = slots
    while True:
        for shard, (_, step) in enumerate(walks):
            slot = at[shard]
            while owner[slot] >= 0:
                slot = (slot + step) % slots
            owner[slot] = shard
            at[shard] = (slot + step) % slots
            left -= 1
            if not left:
                return owner


def table_frame(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """The filled table as rows (slot, shard)."""
    rows = list(enumerate(fill_table(shards, slots)))
    return spark.createDataFrame(rows, "slot int, shard int")


def slot_of(key, slots: int = SLOTS) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Add ``slot`` and ``shard`` to every row; a column of either name is replaced."""
    lookup = F.broadcast(table_frame(df.sparkSession, shards, slots))
    placed = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    return placed.join(lookup, "slot", "left").select(*[c for c in placed.columns if c != "slot"], "slot", "shard")


def write_shards(df: DataFrame, folder: str, key: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS, files: int = 1) -> None:
    """Write each shard to its own folder, as ``files`` files where a shard is large."""
    placed = place(df, key, shards, slots).withColumn("__file", F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(files)))
    placed.repartition("shard", "__file").drop("__file").write.partitionBy("shard").parquet(folder)


@query("op7_sharding")
def op7_sharding(spark, sf_dir):
    """Slot and shard of every document, and the shard it would go to if the last one were taken away."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    without = table_frame(spark, SHARDS[:-1]).withColumnRenamed("shard", "shard_without_last")
    return place(docs).join(F.broadcast(without), "slot").select("doc_id", "slot", "shard", "shard_without_last")
