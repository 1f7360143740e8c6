"""Sharding by a permutation-filled lookup table.

Shards take turns: each claims the next free slot of its own permutation of a prime-sized table, until all slots are
taken. A document's slot is a hash of its id modulo the table's size; its shard is looked up in constant time from the
table, which enters the plan as one literal array of fixed size (a parameter, whatever the size of the data). Taking a
shard away moves mostly the documents of that shard. Placement is a projection: no shuffle, so hot sources or groups of
copies cost nothing.

Defined cases: a null id is placed by its text (null text: as empty); equal ids share a shard; an empty table gives an
empty result; extra columns may have any names but ``slot`` and ``shard``, which are replaced.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS = 32
SLOTS = 4099  # a prime over 100 times the number of shards: shares differ by about one slot


@lru_cache
def lookup_table(shards: int = SHARDS, slots: int = SLOTS, gone: frozenset[int] = frozenset()) -> tuple[int, ...]:
    """The shard of each slot. ``gone``: shards that take no slots."""
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    live = [k for k in range(shards) if k not in gone]
    if not live or len(live) > slots:
        raise ValueError("there must be from one shard to as many as slots")
    number = lambda what, k: int(md5(f"{what}:{k}".encode()).hexdigest()[:13], 16)
    at = {k: number("offset", k) % slots for k in live}
    step = {k: number("skip", k) % (slots - 1) + 1 for k in live}
    table = [-1] * slots
    for turn in range(slots):
        k = live[turn % len(live)]
        while table[at[k]] >= 0:
            at[k] = (at[k] + step[k]) % slots
        table[at[k]] = k
    return tuple(table)


def slot_of(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(text, F.lit("")))))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") % slots).cast("int")


def place(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, gone: frozenset[int] = frozenset()) -> DataFrame:
    """``docs`` with ``slot`` and ``shard``."""
    table = F.split(F.lit(",".join(map(str, lookup_table(shards, slots, gone)))), ",").cast("array<int>")
    slot = slot_of(docs["doc_id"], docs["text"], slots)
    return docs.withColumn("slot", slot).withColumn("shard", F.get(table, F.col("slot")))


def write_shards(docs: DataFrame, path: str, files: int = 8, **how) -> None:
    """Writes a folder per shard, each of ``files`` files: rows are dealt by (shard, salt), so none is one task's work."""
    placed = place(docs, **how)
    salt = F.pmod(F.xxhash64(placed["doc_id"], placed["text"]), F.lit(files))
    placed.repartition(SHARDS * files, "shard", salt).write.partitionBy("shard").parquet(path)


def place_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, slot, shard."""
    return place(docs.select("doc_id", "text")).select("doc_id", "slot", "shard")


#: The table is filled anew here: a row of x for each turn, with the slots taken so far.
ORACLE_SQL = f"""
WITH RECURSIVE s AS (
  SELECT list(('0x' || substr(md5('offset:' || k), 1, 13))::BIGINT % {SLOTS} ORDER BY k) AS at,
    list(('0x' || substr(md5('skip:' || k), 1, 13))::BIGINT % {SLOTS - 1} + 1 ORDER BY k) AS step FROM range({SHARDS}) t(k)),
x(turn, taken, slot) AS (
  SELECT 0, list_transform(range({SLOTS}), lambda i: false), -1::BIGINT
  UNION ALL
  SELECT turn + 1, list_transform(taken, lambda v, i: v OR i = c + 1), c FROM (
    SELECT turn, taken, list_filter(list_transform(range({SLOTS}), lambda j: (s.at[turn % {SHARDS} + 1] + j * s.step[turn % {SHARDS} + 1]) % {SLOTS}), lambda p: NOT taken[p + 1])[1] AS c
    FROM x, s WHERE turn < {SLOTS}))
SELECT d.doc_id, x.slot::INTEGER AS slot, ((x.turn - 1) % {SHARDS})::INTEGER AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, '')))), 1, 13))::BIGINT % {SLOTS} AS slot FROM documents) d JOIN x USING (slot)
"""
