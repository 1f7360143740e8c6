import random
import re
from zlib import crc32

import numpy as np
import pytest

from roadloom.llm import decontamination, golay, langid, licenses, mixing, pii, quality, sharding, simhash, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, count long"
LONG = "word " * 30_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "one two three four", "en", "a", 1, 0), (1, "one two three four", "en", "a", 1, 0), (2, None, None, None, None, None), (3, "", "en", "b", 0, 0), (None, "one two three four", "en", None, 1, 1), (4, LONG, "en", "a", 2, 2), (5, "Released under the MIT License.", "en", "b", 3, 3)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_mixing(docs, empty):
    rows = mixing.mix_documents(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.copies <= 3 and r.taken == r.copies * r["size"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_documents(docs).collect()))
    assert mixing.mix_documents(empty).count() == 0
    assert mixing.repeat_documents(docs).columns == docs.columns


def test_sharding(docs, empty):
    assert sharding.place_documents(docs).where("shard is null").count() == 0 and sharding.place_documents(empty).count() == 0
    full, less = sharding.lookup_table(), sharding.lookup_table(gone=frozenset({3}))
    assert max(map(full.count, range(32))) - min(map(full.count, range(32))) <= 1 and 3 not in less
    assert sum(a != b for a, b in zip(full, less, strict=True)) < len(full) / 8


def test_golay_keys_meet():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 200)
    for bit in range(23):
        a, b = golay.codeword_indices(words), golay.codeword_indices(words ^ (1 << bit))
        assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(a, b, strict=True))


def test_simhash_against_brute_force(spark, docs, empty):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base[:20] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in (1, 2, 3, 4)]]))
    pairs = simhash.near_pairs(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")).collect()
    parent = {int(x): int(x) for x in fps.view(np.int64)}

    def root(x, p):
        while p[x] != x:
            x = p[x]
        return x

    for r in pairs:
        parent[root(r.a, parent)] = root(r.b, parent)
    other = {x: x for x in parent}
    for i, x in enumerate(fps):
        for y in fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ x) <= 3]:
            other[root(int(x.view(np.int64)), other)] = root(int(y.view(np.int64)), other)
    same = lambda p: {(a, b) for a in p for b in p if root(a, p) == root(b, p)}
    assert same(parent) == same(other)
    rows = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert (None, 1) in rows and (2, 2) in rows and (3, 2) in rows
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [1, 2, 4, 5]
    assert simhash.near_duplicates(empty).count() == 0


def test_pii_against_patterns(docs, empty):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice("a@.-+ 1234()09%İ") for _ in range(rng.randint(0, 40)))
        for kind, p in patterns.items():
            want = []
            for m in re.finditer(p, text):
                d = re.sub("[^0-9]", "", m[0])
                if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and pii.luhn(d or "0"), "phone": 9 <= len(d) <= 15}[kind]:
                    want.append(m.span())
            assert pii.find(text)[kind] == want
    assert pii.scan(docs).count() == docs.count() and pii.scan(empty).count() == 0
    assert pii.mask("mail a@b.co now") == "mail <email> now"


def test_langid(docs, empty, spark):
    words = {"xx": ["alpha", "beta", "gamma"], "yy": ["uno", "dos", "tres"]}
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(40)), lang, None, 0, 0) for k, lang in enumerate(["xx", "yy"] * 40)]
    got = langid.identify(spark.createDataFrame(rows, DOCS)).collect()
    assert all(r.lang_pred == rows[r.doc_id][2] and r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert {r.lang_pred for r in langid.identify(docs).where("doc_id = 2 or doc_id = 3").collect()} == {"und"}
    assert langid.identify(empty).count() == 0 and langid.keep_identified(docs).columns == docs.columns


def test_decontamination(docs, empty, spark):
    item = [f"w{k}" for k in range(20)]
    changed = list(item)
    changed[7] = "other"
    rows = [(1, " ".join(["x"] * 5 + changed + ["y"] * 5)), (2, " ".join(item[::-1])), (3, None)]
    leaks = decontamination.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(9, " ".join(item)), (10, None)], "item_id long, text string"))
    assert [(r.doc_id, r.item_id, r.agreeing) for r in leaks.collect()] == [(1, 9, 19)]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_leaks(docs, none).count() == 0 and decontamination.drop_leaks(docs, none).count() == docs.count()


def test_levenshtein_automaton_against_table():
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    terms = ["idiot", "scum", "pathetic", "worthless"]
    a = toxicity.Automaton([(t, False) for t in terms])
    rng = random.Random(4)
    for _ in range(2000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(["", "a", "st", "i"])
        word = "".join(w)
        want = min((d for t in terms if (d := edits(word, t)) <= toxicity.allowed_edits(len(t))), default=9)
        assert a.distance(word) == want


def test_toxicity_and_quality(docs, empty, spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, labels).collect()) and toxicity.score(empty, labels).count() == 0
    ratings = labels.select("doc_id", quality.grade_of(labels["quality"], labels["toxic"]).alias("grade"))
    assert quality.score(docs, ratings).count() == docs.count() and quality.score(empty, ratings.where("false")).count() == 0


def test_topk(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4))
    rows = [(k, [float(v) for v in x[k]]) for k in range(60)] + [(100, None), (120, [1.0, None, 2.0, 3.0]), (140, [float("nan")] * 4)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    v = np.floor(64 * x).astype(int)
    want = {(q, r + 1, int(k), int(s)) for q in (0, 20, 40) for r, (s, k) in enumerate(sorted(((int(v[q] @ v[k]), k) for k in range(60) if k != q), key=lambda p: (-p[0], p[1]))[:20])}
    assert {tuple(r) for r in got} == want


def test_licenses(docs, empty):
    rows = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert rows[5].labels == "mit,mit-notice" and rows[5].n_base == 1 and rows[5].first_word == 3 and rows[2].n_words == 0
    assert licenses.scan(empty).count() == 0
