"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a prime-sized table;
shards take turns claiming their next free slot until none is left.  A row's key
gives its slot, so a broadcast of the table places rows in constant time, and
when shards come or go few other rows move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65_537
#: The table is broadcast; its size is this at most, whatever the data.
LARGEST_TABLE = 1_048_583


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """Slot by slot the index of the shard that claimed it.  Shards take turns in the order of their names."""
    if not is_prime(size) or size > LARGEST_TABLE:
        raise ValueError(f"the table's size must be a prime of at most {LARGEST_TABLE}")
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be named, each once, and not outnumber the slots")
    turns = sorted(range(len(shards)), key=lambda i: shards[i])
    at = [_number(s, "offset") % size for s in shards]
    skip = [_number(s, "skip") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    table, left = [-1] * size, size
    while left:
        for i in turns:
            # A prime size makes every skip visit every slot.
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            table[at[i]] = i
            left -= 1
            if not left:
                break
    return table


def assign_shards(df: DataFrame, key_cols: Sequence[str], shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """Adds ``slot`` (long) and ``shard`` (string), replacing columns of these names, to every row.

    Rows with equal keys share a shard, however often a key comes; keys are
    read as text of any length, and a null key column counts as a value of its
    own.  No shuffle.  An empty table stays empty; other columns, whatever
    their names, stay as they are.
    """
    table = df.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(lookup_table(shards, size))], "slot bigint, shard string")
    # Length-prefixed parts: no two different keys read alike.
    part = lambda c: F.coalesce(F.concat(F.length(F.col(f"`{c}`").cast("string")), F.lit(":"), F.col(f"`{c}`").cast("string")), F.lit("-"))
    slot = F.conv(F.substring(F.md5(F.concat(*map(part, key_cols))), 1, 15), 16, 10).cast("bigint") % size
    # The row goes in one struct, so that no column of it can clash.
    keep = [F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard")]
    row = F.struct(*keep) if keep else F.struct(F.lit(0).alias("_"))
    placed = df.select(row.alias("row"), slot.alias("slot")).join(F.broadcast(table), "slot", "left")
    return placed.select(*(["row.*"] if keep else []), "slot", "shard")
