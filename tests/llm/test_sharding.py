import collections
import hashlib

import pytest

from meshlark.llm.sharding import assign_shards, lookup_table

SHARDS = [f"s{i}" for i in range(10)]


def test_table_is_even_and_stable():
    table = lookup_table(SHARDS, 997)
    counts = collections.Counter(table)
    assert set(counts) == set(range(10)) and max(counts.values()) - min(counts.values()) <= 1
    assert table == lookup_table(SHARDS, 997)
    fewer = lookup_table(SHARDS[:-1], 997)
    moved = sum(1 for a, b in zip(table, fewer) if a != b and a != 9)
    assert moved < 0.2 * 997
    shuffled = lookup_table(SHARDS[::-1], 997)
    assert [SHARDS[i] for i in table] == [SHARDS[::-1][i] for i in shuffled]


def test_turns_follow_preferences():
    """By the definition, slot by slot, with lists of preferences."""
    from meshlark.llm.sharding import _number

    size, names = 31, ["a", "b", "c"]
    orders = {s: [(_number(s, "offset") + j * (_number(s, "skip") % (size - 1) + 1)) % size for j in range(size)] for s in names}
    want = [None] * size
    while None in want:
        for s in names:
            free = [x for x in orders[s] if want[x] is None]
            if free:
                want[free[0]] = s
    assert [names[i] for i in lookup_table(names, size)] == want


@pytest.mark.parametrize("shards,size", [(SHARDS, 1000), ([], 997), (["a", "a"], 997), (SHARDS, 7), (SHARDS, 10**7 + 19)])
def test_bad_tables(shards, size):
    with pytest.raises(ValueError):
        lookup_table(shards, size)


def test_placement(documents, clashing):
    rows = [(i, "t") for i in range(3000)] + [(7, "other"), (None, "a"), (None, None)]
    df = clashing(documents(rows))
    placed = assign_shards(df, ["doc_id"], SHARDS, 997)
    assert sorted(placed.columns) == sorted(df.columns) and placed.count() == len(rows)
    got = placed.select("doc_id", "slot", "shard").collect()
    table = lookup_table(SHARDS, 997)
    assert all(SHARDS[table[r.slot]] == r.shard for r in got)
    assert len({(r.doc_id, r.shard) for r in got}) == 3001
    # The slot by its definition: the first 15 hex digits of the key's digest.
    part = lambda i: f"{len(str(i))}:{i}" if i is not None else "-"
    assert all(r.slot == int(hashlib.md5(part(r.doc_id).encode()).hexdigest()[:15], 16) % 997 for r in got)
    assert {tuple(r) for r in placed.select("_slot", "_shard", "row").collect()} == {("x", "x", "x")}
    counts = collections.Counter(r.shard for r in got)
    assert min(counts.values()) > 220 and len(counts) == 10
    assert assign_shards(df.limit(0), ["doc_id", "source"], SHARDS, 997).count() == 0


def test_long_and_repeated_keys(spark):
    df = spark.createDataFrame([("k" * 500_000, 1), ("k" * 500_000, 2), ("", 3), (None, 4)], "key string, n int")
    got = {r.n: r.shard for r in assign_shards(df, ["key"], SHARDS, 997).collect()}
    assert got[1] == got[2] and len(got) == 4
    assert assign_shards(df.select(df.n.alias("slot")), ["slot"], SHARDS, 997).columns == ["slot", "shard"]
