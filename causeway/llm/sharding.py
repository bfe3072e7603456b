"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table (an offset and a step, both hashed
from its name). Shards take turns, each claiming its next preferred free slot, until the table is full. A key's place is
one hash and one lookup. Shares differ by one slot at most per unit of weight, and removing a shard moves few other slots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537
#: The table is broadcast; its size is a parameter, and this is the most that is taken.
MOST_SLOTS = 1_000_003


def _number(name: str, salt: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8, salt=salt).digest(), "little")


def lookup_table(shards: Sequence[str], slots: int = SLOTS, weights: Mapping[str, int] | None = None) -> np.ndarray:
    """slot -> index into shards. slots: a prime, at least as many as shards. weights: turns per round, 1 unless given."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if not len(shards) <= slots <= MOST_SLOTS or slots < 3 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime from the number of shards to MOST_SLOTS")
    turns = [int((weights or {}).get(s, 1)) for s in shards]
    if min(turns) < 0 or not any(turns):
        raise ValueError("weights must be non-negative, one of them positive")
    offset = [_number(s, b"offset") % slots for s in shards]
    step = [_number(s, b"step") % (slots - 1) + 1 for s in shards]
    taken, tried, left = [-1] * slots, [0] * len(shards), slots
    while left:
        for i, n in enumerate(turns):
            for _ in range(min(n, left)):
                at = (offset[i] + tried[i] * step[i]) % slots
                while taken[at] >= 0:
                    tried[i] += 1
                    at = (offset[i] + tried[i] * step[i]) % slots
                taken[at], left = i, left - 1
                tried[i] += 1
    return np.array(taken, dtype=np.int32)


def place(df: DataFrame, key: str, shards: Sequence[str], slots: int = SLOTS, weights: Mapping[str, int] | None = None) -> DataFrame:
    """df with the columns slot (int) and shard (string); columns of those names are replaced.

    Equal keys go to one shard. A null key has a slot too, that of the null hash. An empty df stays empty. Only the
    table (slots rows) is broadcast; rows of df are not shuffled, so a hot key costs nothing here.
    """
    table = lookup_table(shards, slots, weights)
    names = np.array(list(shards), dtype=object)[table]
    rows = df.sparkSession.createDataFrame(pd.DataFrame({"slot": np.arange(slots, dtype=np.int32), "shard": names}), "slot int, shard string")
    keyed = df.withColumn("slot", F.pmod(F.xxhash64(F.col(key)), F.lit(slots)).cast("int")).drop("shard")
    return keyed.join(F.broadcast(rows), "slot").select(*[c for c in df.columns if c not in ("slot", "shard")], "slot", "shard")


def write_shards(placed: DataFrame, path: str, rows_a_file: int = 1_000_000) -> None:
    """One folder per shard; files of one shard come from several tasks, so a heavy shard isn't written by one."""
    placed.write.option("maxRecordsPerFile", rows_a_file).partitionBy("shard").parquet(path)


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """documents over 64 shards by doc_id: doc_id, slot, shard."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return place(docs, "doc_id", [f"shard-{i:05d}" for i in range(64)])
