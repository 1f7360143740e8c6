"""run() of the corpus pipeline against the same stages done plainly: every pair, every diagonal, and DuckDB for mixing and shards."""

import os
import random
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
import zstandard

import corpus_pipeline
from roadloom.llm import decontamination, langid, mixing, sharding

SF = "/root/testdata/sf0.001"


def language_kept(text, learned):
    dictionaries, margin = learned
    if not text or not any(map(str.isalpha, text)) or not dictionaries:
        return False
    sizes = []
    for _, raw in dictionaries:
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        sizes.append(len(zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress(langid.normal(text))))
    return len(sizes) < 2 or sorted(sizes)[1] - min(sizes) >= margin


def simple_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_of_groups(rows):
    """Ids that no smaller id is linked with, through others or not."""
    fps = {d: simple_fingerprint(t) for d, t in rows}
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d for d in ids if find(d) == d}


def leaks(text, items):
    words = np.array(decontamination.tokens(text), object)
    for item in items:
        m = len(item)
        if m < decontamination.LEAST or len(words) < decontamination.LEAST:
            continue
        pad = np.full(m, None, object)
        laid = np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, words, pad]), m)
        inside = np.lib.stride_tricks.sliding_window_view(np.r_[np.zeros(m), np.ones(len(words)), np.zeros(m)].astype(bool), m)
        same = laid == np.array(item, object)
        long = min(decontamination.STRETCH, m)
        agree = np.lib.stride_tricks.sliding_window_view(same & inside, long, axis=1).sum(2) >= decontamination.AGREE * long - 1e-9
        agree &= np.lib.stride_tricks.sliding_window_view(inside, long, axis=1).all(2)
        for diagonal in np.flatnonzero(agree.any(1)):
            for seed in decontamination.SEEDS:
                keep = [k for k, c in enumerate(seed) if c == "1"]
                if any(inside[diagonal, p] and inside[diagonal, p + len(seed) - 1] and same[diagonal, [p + k for k in keep]].all() for p in range(m - len(seed) + 1)):
                    return True
    return False


def plainly(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    learned = langid.learn(docs)
    rows = [r for r in docs.collect() if language_kept(r.text, learned)]
    first = smallest_of_groups([(r.doc_id, r.text) for r in rows])
    items = [decontamination.tokens(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [r for r in rows if r.doc_id in first and not leaks(r.text, items)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=docs.columns))
    copies = dict(con.sql(f"SELECT doc_id, copies FROM ({mixing.ORACLE_SQL})").fetchall())
    places = {d: (slot, shard) for d, slot, shard in con.sql(sharding.ORACLE_SQL).fetchall()}
    return Counter({(d, *places[d]): n for d, n in copies.items() if n})


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_run_against_plain_stages(spark):
    got = Counter((r.doc_id, r.slot, r.shard) for r in corpus_pipeline.run(spark, SF).collect())
    assert got and got == plainly(spark, SF)


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, extra columns; then no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, slot int, h string"
    rng = random.Random(6)
    words = [["".join(rng.choice(letters) for _ in range(6)) for _ in range(200)] for letters in ("abcdefg", "mnopqrs")]
    many = [(100 + k, " ".join(rng.choices(words[k % 2], k=60)), ["xx", "yy"][k % 2], "s", 1, 0, "") for k in range(40)]
    odd = [(1, None, None, None, None, None, None), (2, "", "xx", "s", 0, 0, ""), (None, "some words w10 w11 here", None, None, 1, 1, "a"), (3, "long " * 30_000, "xx", "s", 1, 1, "b")]
    for name, rows in (("odd", many + odd + odd), ("none", [])):
        sf = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        for title, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert title == "sharding" or out.columns == docs.columns
            docs = out
        assert docs.where("shard is null").count() == 0 and (name == "odd") == (docs.count() > 0)
        assert docs.where("doc_id = 1 or doc_id = 2").count() == 0
