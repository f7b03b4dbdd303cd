"""Sharding by a permutation-filled lookup table.

The table has a prime number of slots. Every shard has its own order of preference
over all slots: a start and a step, both hashes of its name, so the order visits each
slot once. The shards take turns; each claims the first slot of its order that is
still free, until all are taken. So slots are dealt almost evenly, and when a shard
leaves, most slots keep their shard. A row's slot is the hash of its key; the table is
broadcast, which makes placement one look-up per row without a shuffle.

Edge cases: equal keys share a shard; a null key counts as the empty one; shards may
have a whole-number weight, the turns they get per round; no shards, repeated names or
a size that is no prime above their number are refused; an empty table gives no rows.
"""

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import documents, only

#: Slots of the table, a prime; it bounds what is broadcast.
SLOTS = 65_537
SHARDS = 64


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def preference(name: str, slots: int) -> tuple[int, int]:
    """Start and step of a shard's order; any step from 1 on visits all slots, as their number is prime."""
    digest = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1


def fill(names: Sequence[str], slots: int = SLOTS, weights: Sequence[int] | None = None) -> np.ndarray:
    """The table: for each slot the position of its shard in ``names``."""
    weights = [1] * len(names) if weights is None else list(weights)
    if not names or len(set(names)) < len(names) or not is_prime(slots) or slots <= len(names) or min(weights) < 1 or len(weights) != len(names):
        raise ValueError("shards need different names, weights of at least 1, and a prime number of slots above their own")
    orders = [preference(name, slots) for name in names]
    owner, at, taken = [-1] * slots, [start for start, _ in orders], 0
    turns = [shard for shard, weight in enumerate(weights) for _ in range(weight)]
    while True:
        for shard in turns:
            slot, step = at[shard], orders[shard][1]
            while owner[slot] >= 0:
                slot = (slot + step) % slots
            owner[slot], at[shard] = shard, (slot + step) % slots
            taken += 1
            if taken == slots:
                return np.array(owner, np.int32)


def slot_of(key: str, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(slots)).cast("int")


def placed(rows: DataFrame, key: str, tables: dict[str, Sequence[str]], slots: int = SLOTS) -> DataFrame:
    """``rows`` with ``slot`` and, for each named set of shards, the name of the shard that holds the row."""
    spark = rows.sparkSession
    table = pd.DataFrame({"slot": np.arange(slots, dtype=np.int32)} | {name: np.array(shards, object)[fill(shards, slots)] for name, shards in tables.items()})
    schema = "slot int, " + ", ".join(f"`{name}` string" for name in tables)
    kept = [c for c in rows.columns if c not in ("slot", *tables)]
    lookup = F.broadcast(spark.createDataFrame(table, schema))  # ``slots`` rows
    return rows.select(*[F.col(f"`{c}`") for c in kept], slot_of(key, slots).alias("slot")).join(lookup, "slot").select(*[F.col(f"`{c}`") for c in kept], "slot", *tables)


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{k:04d}" for k in range(n)]


def op2_permutation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot and shard, and the shard it has once the last shard has left."""
    docs, names = only(documents(spark, sf_dir), "doc_id"), shard_names()
    return placed(docs, "doc_id", {"shard": names, "shard_without_last": names[:-1]})
