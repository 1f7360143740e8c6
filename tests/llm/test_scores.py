"""Scores and spans of the learned operators and of decontamination, against the same done word by word."""

import math
import os
import random
import re
from zlib import crc32

import pytest
import zstandard

from roadloom.llm import decontamination, langid, pii, quality, toxicity

SF = "/root/testdata/sf0.001"
ODD = [(9001, None), (9002, ""), (9003, "... 12 !"), (9003, "... 12 !"), (None, "plain words here"), (9004, "wörter und sätze " * 4000), (9005, "you idiot you"), (9006, 'he wrote "you idiot" to me')]
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame([(d, t, None, None, 0) for d, t in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    return spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd)


@needs_tables
def test_language_by_plain_compression(docs):
    learned = langid.learn(docs)
    dictionaries, margin = learned
    assert len(dictionaries) > 1 and margin >= 1 and learned == langid.learn(docs.repartition(7))
    got = {(r.doc_id, r.lang_pred, round(r.score, 12), r.rejected) for r in langid.identify(docs).collect()}
    want = set()
    for r in docs.collect():
        if not r.text or not any(map(str.isalpha, r.text)):
            want.add((r.doc_id, "und", 0.0, True))
            continue
        sizes = {}
        for lang, raw in dictionaries:
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes[lang] = len(zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress(langid.normal(r.text)))
        best = min(sizes.values())
        odds = [2.0 ** (best - s) if s - best < 1000 else 0.0 for s in sizes.values()]
        want.add((r.doc_id, next(k for k, s in sizes.items() if s == best), round(1 / sum(odds), 12), sorted(sizes.values())[1] - best < margin))
    assert got == want


@needs_tables
def test_grades_word_by_word(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet").union(spark.createDataFrame([(9005, 0, 1), (9005, 1, 0), (9001, 1, 1), (None, 1, 1), (9002, None, 1)], "doc_id long, quality int, toxic int"))
    ratings = labels.select("doc_id", quality.grade_of(labels["quality"], labels["toxic"]).alias("grade"))
    w, thresholds = quality.learn(docs, ratings)
    again, _ = quality.learn(docs.repartition(5), ratings.repartition(3))
    assert (w == again).all() and list(thresholds) == sorted(thresholds)
    bucket = lambda s: crc32(s.encode()) % quality.BUCKETS
    sig = lambda z: 1 / (1 + math.exp(-max(-30, min(30, z))))
    got = {(r.doc_id, round(r.expected_grade, 3), round(r.p_top, 3)) for r in quality.score(docs, ratings).collect()}
    want = set()
    for r in docs.collect():
        words, x = (r.text or "").split(), {}
        for word in words:
            for b in (bucket("w:" + word.lower()), bucket("s:" + quality.shape(word))):
                x[b] = x.get(b, 0) + 3 / len(words)
        again = sum(words[k] == words[k + 1] for k in range(len(words) - 1)) / max(1, len(words))
        for t in (f"t:size{int(math.log2(len(words)))}", f"t:again{int(again * 20)}", f"t:distinct{int(len(set(words)) / len(words) * 20)}") if words else ():
            x[bucket(t)] = x.get(bucket(t), 0) + 0.5
        z = sum(w[b] * v for b, v in x.items()) if words else w[bucket("t:empty")]
        above = [1 - sig(t - z) for t in thresholds]
        want.add((r.doc_id, sum(above), above[-1]))
    close = lambda a, b: a[0] == b[0] and abs(a[1] - b[1]) < 0.002 and abs(a[2] - b[2]) < 0.002
    assert all(any(close(a, b) for b in want) for a in got) and all(any(close(a, b) for b in got) for a in want)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain_hit(word, terms):
    """0 for an exact hit or a beginning, else the fewest edits within a term's allowance, None if there are none."""
    best = None
    for t, beginning in terms:
        if beginning:
            if word.startswith(t):
                return 0
        elif abs(len(word) - len(t)) <= (most := 0 if len(t) < 5 else 1 if len(t) < 9 else 2) and (d := edits(word, t)) <= most:
            best = d if best is None else min(best, d)
    return best


def plain_score(text, terms, weights):
    low = (text or "").lower()
    spots = list(re.finditer(r"\w+", low))
    words, memo, exact, near, quoted, addressed = [m[0] for m in spots], {}, 0, 0, 0, 0
    double, single = "\"“”„«»", "'‘’`"
    for k, m in enumerate(spots):
        if m[0] not in memo:
            memo[m[0]] = plain_hit(m[0], terms)
        if memo[m[0]] is None:
            continue
        around = set(words[max(0, k - 6) : k] + words[k + 1 : k + 7])
        left, right = low[m.start() - 1] if m.start() else "", low[m.end() : m.end() + 1]
        whole = left and right and (left in double and right in double or left in single and right in single and not (m.start() > 1 and low[m.start() - 2].isalnum()) and not low[m.end() + 1 : m.end() + 2].isalnum())
        marks = any(c in double for c in low[max(0, m.start() - 80) : m.start()]) and any(c in double for c in low[m.end() : m.end() + 80])
        told = whole or (marks and around & toxicity.REPORTING)
        quoted += bool(told)
        exact += not told and memo[m[0]] == 0
        near += not told and memo[m[0]] > 0
        addressed += not told and bool(around & toxicity.ADDRESS)
    hit = exact + 0.6 * near
    x = [1, math.log1p(hit), math.log1p(quoted), 100 * hit / max(20, len(words)), math.log1p(addressed)]
    return 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(x, weights, strict=True))))))


@needs_tables
def test_toxicity_word_by_word(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet").union(spark.createDataFrame([(9005, 0, 1), (9005, 1, 0), (None, 1, 1), (9002, 1, None)], "doc_id long, quality int, toxic int"))
    terms, weights = toxicity.learn(docs, labels)
    assert (terms, weights) == toxicity.learn(docs.repartition(5), labels.repartition(3))
    got = {(r.doc_id, r.score) for r in toxicity.score(docs, labels).collect()}
    short = [r for r in docs.collect() if r.text is None or len(r.text) < 4000]
    for r in short[::3] + short[-8:]:
        want = plain_score(r.text, terms, weights)
        assert any(d == r.doc_id and abs(s - want) < 1e-9 for d, s in got), (r, want)


def test_apostrophes_are_no_quotation():
    a = toxicity.Automaton([("idiot", False), ("stupid", False)])
    for text in ("He said you are an idiot, don't listen", "I'll say it again you're stupid, so don't write here", "they wrote that you're an idiot's friend"):
        x = toxicity.features(text, a)
        assert x[1] > 0 and x[2] == 0 and x[4] > 0, text
    for text in ('He said "you are an idiot" yesterday', "the word 'idiot' is old", "she wrote: “such a stupid thing” and left"):
        x = toxicity.features(text, a)
        assert x[1] == 0 and x[2] > 0, text


def plain_overlap(words, item):
    """(first, end, agreeing) of the best overlap over all diagonals, None if none counts."""
    long = min(decontamination.STRETCH, len(item))
    best = None
    for d in range(-len(item), len(words)):
        same = [0 <= d + k < len(words) and words[d + k] == w for k, w in enumerate(item)]
        good = [p for p in range(len(item) - long + 1) if d + p >= 0 and d + p + long <= len(words) and sum(same[p : p + long]) >= decontamination.needed(long)]
        if good:
            agree = sum(same[good[0] : good[-1] + long])
            if best is None or agree > best[2]:
                best = (d + good[0], d + good[-1] + long, agree)
    return best


def test_overlaps_on_all_diagonals(spark):
    rng = random.Random(12)
    items = [(k, [rng.choice("abcdef") for _ in range(rng.randint(1, 40))]) for k in range(12)]
    items += [(3, items[0][1]), (20, [f"w{k}" for k in range(100)])]
    docs = [(1, None), (1, ""), (2, " ".join(["zz"] * 30_000 + items[-1][1]))]
    for d in range(120):
        words = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))]
        for _, t in rng.sample(items, 2):
            words += [w if rng.random() > 0.12 else "x" for w in t]
        docs.append((d % 90, " ".join(words)))
    got = sorted(map(tuple, decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(t)) for k, t in items] + [(99, "")], "item_id long, text string"), most=60).collect()))
    want = []
    for d, text in docs:
        words = (text or "").split()
        for k, t in items:
            if (len(words) < 1000 or len(t) == 100) and (o := plain_overlap(words, t)):
                want.append((d, k, *o, len(t)))
    assert got == sorted(want) and len(want) > 200


def test_accounts():
    spans = lambda t: [t[a:b] for a, b in pii.find(t)["account"]]
    assert spans("iban DE89 3704 0044 0532 0130 00 paid") == ["DE89 3704 0044 0532 0130 00"] and spans("IBAN: GB82WEST12345698765432.") == ["GB82WEST12345698765432"]
    assert spans("iban DE89 3704 0044 0532 0130 01") == [] and spans("ssn 123-45-6789") == ["123-45-6789"] and spans("ssn 666-45-6789") == [] and spans("ssn 123-45-67890") == []
