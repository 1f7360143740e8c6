"""64-bit hashes of integer keys that are the same with and without ANSI arithmetic."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

FACTOR = 0xD6E8FEB86659FD93  # fixed value: ids must be the same everywhere


_LOW = 0xFFFFFFFF


def _product(x: str) -> str:
    """x times FACTOR modulo 2^64, of halves and quarters small enough that nothing overflows."""
    low, high = FACTOR & _LOW, FACTOR >> 32  # low has 31 bits
    least = f"(({x}) & {_LOW}L) * {low}L"
    upper = f"(shiftrightunsigned({x}, 32) * {low}L & {_LOW}L) + ((({x}) & 65535L) * {high}L & {_LOW}L) + shiftleft((shiftrightunsigned({x}, 16) & 65535L) * {high}L & 65535L, 16)"
    return f"(shiftleft(shiftrightunsigned({least}, 32) + {upper}, 32) | ({least} & {_LOW}L))"


def _fold(x: str) -> str:
    return f"({x} ^ shiftrightunsigned({x}, 32))"


def with_hash(df: DataFrame, names: tuple[str, ...], out: str) -> DataFrame:
    """``df`` with a hash of long columns: each is mixed by two products, and joined to the hash so far by another.

    Each step is a column of its own, which later steps name several times, so all of it stays in generated code.
    """
    mixed = {f"{out}:{k}": n for k, n in enumerate(names)}
    df = df.withColumns({c: F.expr(f"cast(`{n}` as bigint)") for c, n in mixed.items()})
    for _ in range(2):
        df = df.withColumns({c: F.expr(_product(_fold(f"`{c}`"))) for c in mixed})
    df = df.withColumns({c: F.expr(_fold(f"`{c}`")) for c in mixed})
    first, *rest = mixed
    df = df.withColumn(out, F.col(f"`{first}`"))
    for c in rest:
        df = df.withColumn(out, F.expr(f"{_product(_fold(out))} ^ `{c}`"))
    return df.drop(*mixed)


def with_edge_id(df: DataFrame, out: str = "edge_id") -> DataFrame:
    """63-bit ids of (osm_id, source, target)."""
    return with_hash(df, ("osm_id", "source", "target"), out).withColumn(out, F.shiftrightunsigned(out, 1))


# Fixed values of the hash of texts.
TEXT_START, TEXT_LENGTH = 0xE17A1465, 0xC6A4A7935BD1E995
_WORD = (1 << 64) - 1


def _mixed(x: int) -> int:
    for _ in range(2):
        x = (x ^ x >> 32) * FACTOR & _WORD
    return x ^ x >> 32


def text_hash(text: str) -> int:
    """The hash of a text: its bytes in words of eight, little end first, each folded in by a product."""
    raw = text.encode()
    h = TEXT_START ^ len(raw) * TEXT_LENGTH & _WORD
    for k in range(0, len(raw), 8):
        h = (h ^ int.from_bytes(raw[k : k + 8], "little")) * FACTOR & _WORD
    return _mixed(h)


def joined_hash(*parts: int | str) -> int:
    """The hash of several values in order, as of a row."""
    h = None
    for p in parts:
        x = text_hash(p) if isinstance(p, str) else _mixed(p & _WORD)
        h = x if h is None else (h ^ h >> 32) * FACTOR & _WORD ^ x
    return h


def _virtual_ids(osm_id: pd.Series, source: pd.Series, target: pd.Series, refs: pd.Series) -> pd.Series:
    ids = []
    for o, s, t, r in zip(osm_id, source, target, refs, strict=True):
        ends = (int(o), int(s)) if s == t else (int(o), int(s), int(t))
        ids.append(-(joined_hash(*ends, "[" + ", ".join(str(int(x)) for x in r) + "]") >> 2))
    return pd.Series(ids, dtype="int64")


def virtual_node(*arc: str) -> Column:
    """The negative id of the node that cuts an arc (osm_id, source, target, refs) in two, from its content; loops leave the target out.

    Few arcs are cut, so a Python function is no burden here.
    """
    return F.pandas_udf(_virtual_ids, LongType())(*arc)
