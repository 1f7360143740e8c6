"""SimHash near-duplicates, found by fuzzy hashing of fingerprints with the Golay code.

A fingerprint has 64 bits in four segments of 16. If two differ in 3 bits or fewer, one segment is equal, and of two
windows of 23 bits taken from the other 48 one has at most one differing bit. Windows that differ in one bit share a
near codeword of the Golay code. So each fingerprint gets, for each choice of equal segment and window, the key
(choice, 16 bits, codeword index), one or six codewords a window; fingerprints that share a key are compared exactly.

Only distinct fingerprints are keyed, so exact copies cost one sum. Keys that a single fingerprint holds are dropped by
partial counts. A key with more than ``BLOCK`` fingerprints is split into pairs of blocks: a task holds two blocks at
most, and each group gives the edges of a spanning forest, not all pairs. No partner or candidate is dropped.

Defined cases: a null text is as an empty one, of fingerprint zero, linked like any other; fewer than three words make
one shingle; rows with equal ids share what their texts say; a null id is never a component's name unless no other is
there; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.operators.components import components
from roadloom.llm.golay import LENGTH, codeword_indices
from roadloom.staging import bounded, grown, python_ready, staged

SHINGLE = 3
SEED = 42
BITS = 3
BLOCK = 512
FEW = 8  # groups up to so many rows are compared at once, larger ones each by itself


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64 bits, each 1 if set in over half the shingles' hashes. bytes.lower() and bytes.split() know ASCII only."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(fp.view(np.int64))], ["doc_id", "h", "fp"])


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position in ``fp``) for all keys of all fingerprints (uint64)."""
    all_keys, rows = [], []
    segments = [(fp >> np.uint64(16 * k)) & np.uint64(0xFFFF) for k in range(4)]
    for k in range(4):
        a, b, c = (segments[j].astype(np.int64) for j in range(4) if j != k)
        rest = a | b << 16 | c << 32
        for w in range(2):
            index = codeword_indices(rest >> (LENGTH * w) & ((1 << LENGTH) - 1))
            key = (np.int64(2 * k + w) << 28) | (segments[k].astype(np.int64)[:, None] << 12) | index
            row, col = np.nonzero(index >= 0)
            all_keys.append(key[row, col])
            rows.append(row)
    return np.concatenate(all_keys), np.concatenate(rows)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column("fp").to_numpy(zero_copy_only=False)
        key, row = keys(fp.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(fp[row])], ["key", "fp"])


def _forest(fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the fingerprints linked at ``bits`` or fewer."""
    edges, left = [], fp
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= bits
            if near.any():
                todo.extend(left[near])
                edges.extend((x, y) for y in left[near])
                left = left[~near]
    return edges


def linked(group: np.ndarray, fp: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges within the groups: ``group`` numbers the rows' groups, equal ones stand together."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    large = np.repeat(sizes > FEW, sizes)
    g, f = group[~large], fp[~large]
    a, b = [], []
    for step in range(1, FEW):
        near = (g[step:] == g[:-step]) & (np.bitwise_count(f[step:] ^ f[:-step]) <= bits)
        a.append(f[:-step][near])
        b.append(f[step:][near])
    for s, n in zip(starts[sizes > FEW], sizes[sizes > FEW], strict=True):
        if pairs := _forest(np.unique(fp[s : s + n]), bits):
            x, y = np.array(pairs, np.uint64).T
            a.append(x)
            b.append(y)
    return np.concatenate(a), np.concatenate(b)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of ``g``: edges. The last group of a batch may go on in the next; groups have two blocks at most."""
    rest_g, rest_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        g = np.concatenate([rest_g, b.column("g").to_numpy(zero_copy_only=False)])
        f = np.concatenate([rest_f, b.column("fp").to_numpy(zero_copy_only=False)])
        cut = int(np.searchsorted(g == g[-1], True)) if len(g) else 0
        rest_g, rest_f = g[cut:], f[cut:]
        if cut:
            yield _pairs(g[:cut], f[:cut])
    if len(rest_g):
        yield _pairs(rest_g, rest_f)


def _pairs(g: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
    x, y = linked(g, f.view(np.uint64))
    e = np.unique(np.stack([x.view(np.int64), y.view(np.int64)], 1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], ["a", "b"])


def near_pairs(fps: DataFrame) -> DataFrame:
    """(a, b): enough of the pairs of distinct fingerprints (fp long) that differ in at most 3 bits to connect all such pairs."""
    keyed = fps.select("fp").mapInArrow(_keyed, "key int, fp long")
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("key", "k")
    rows = grown(keyed).join(counts, keyed["key"] == counts["k"]).select("key", "fp", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    g = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    rows = rows.select(g.alias("g"), "fp")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(_edges, "a long, b long")


def _named(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, fp) of each row, h a hash of its text; (named, root, component) of the fingerprints that several rows share or that are linked."""
    python_ready(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(_fingerprints, "doc_id long, h long, fp long")
    x = staged(rows, "fingerprints")
    classes = staged(x.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    comps = staged(components(near_pairs(classes)), "components")
    held = bounded(comps)
    linked_ = staged(classes.join(held, classes["fp"] == held["node"]).select("node", "root", "rep"), "linked")
    least = staged(linked_.groupBy("root").agg(F.min("rep").alias("component")), "least")
    linked_ = linked_.join(bounded(least), "root").select(F.col("node").alias("named"), "root", "component")
    lone = classes.where("n > 1").join(held, classes["fp"] == held["node"], "left_anti")
    return x, staged(linked_.unionByName(lone.select(F.col("fp").alias("named"), F.col("fp").alias("root"), F.col("rep").alias("component"))), "names")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fp (long), component_id."""
    x, names = _named(docs)
    out = x.join(bounded(names), x["fp"] == names["named"], "left")
    return out.select("doc_id", "fp", F.coalesce("component", "doc_id").alias("component_id"))


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id (a null one only if there is no other); of equal such rows, one.

    Rows are told apart by id and text, and only those that go are joined with the whole texts: they are broadcast if
    they are few, by their count, and else the texts are shuffled once.
    """
    x, names = _named(docs)
    y = staged(x.join(bounded(names), x["fp"] == names["named"]).select("root", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h").alias("me")), "members")
    first = staged(y.groupBy("root").agg(F.min("me").alias("first")), "first")
    y = y.join(bounded(first), "root")
    gone = y.where("me <> first").select(F.col("me.doc_id").alias("gone_id"), F.col("me.h").alias("gone_h")).distinct()
    again = y.where("me = first").groupBy("root", "me").count().where("count > 1").select(F.col("me.doc_id").alias("gone_id"), F.col("me.h").alias("gone_h"))
    gone, again = staged(gone, "gone"), staged(again, "again")

    def same(t: DataFrame) -> Column:
        return docs["doc_id"].eqNullSafe(t["gone_id"]) & F.xxhash64(docs["text"]).eqNullSafe(t["gone_h"])

    few = bounded(gone)
    out = docs.join(few, same(few), "left_anti")
    if again.isEmpty():
        return out
    again = bounded(again)
    more = docs.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "text"])
    return out.join(again, same(again), "left_anti").unionByName(more)
