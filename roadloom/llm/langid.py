"""Language identification by compression.

For each language a zstandard dictionary holds raw text of that language. A text is compressed with each of them; the
language that gives the fewest bytes is chosen, and the choice is rejected when the margin to the second is narrow. What
is narrow is fitted: the most bytes that reject at most ``GIVE_UP`` of the rightly identified documents among labelled
ones kept out of the dictionaries; a tie is always narrow. Bytes are logarithms of odds, so they mean the same for short
and long texts; a share of the size would reject long ones, to which a dictionary matters at their beginning only.

Everything is learned from a bounded sample of labelled rows, the first in order of a hash of id and text: for at most
``LANGUAGES`` languages (those with most labelled rows), about ``SAMPLE`` documents each for the dictionaries, up to
``DICT_BYTES`` bytes, and about ``CHECKED`` documents in all for the margin, none of more than ``LONGEST`` characters.
Every whole text is compressed. Learning never sees rows whose crc32(id as text) mod 4 is 2.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; ties go to the language with
more labelled rows, then to the smaller name; with one language nothing else is rejected; without labelled rows
everything is ``und``; equal rows are predicted alike, and repeated ones are learned from once; an empty table gives an
empty result; extra columns are kept by the filter and left out by the report.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.staging import python_ready

FOLDS, HELD_OUT = 4, 2
SAMPLE = 80
LONGEST = 20_000
DICT_BYTES = 96_000
LEVEL = 5
LANGUAGES = 256
CHECKED = 2_000
GIVE_UP = 0.0075


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


_NO_LETTERS = re.compile(r"[\W\d_]+")


def normal(text: str) -> bytes:
    """Lower-case letters with single spaces between: marks and digits say little about a language."""
    return _NO_LETTERS.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def learn(docs: DataFrame, sample: int = SAMPLE, checked: int = CHECKED, most: int = LANGUAGES) -> tuple[list[tuple[str, bytes]], int]:
    """([(language, dictionary)], least margin in bytes); languages with more labelled rows first."""
    labelled = docs.where((fold(F.col("doc_id")) != HELD_OUT) & F.col("lang").isNotNull())
    rows = labelled.where((F.length("text") > 0) & (F.length("text") <= LONGEST))
    per = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()
    if not per:
        return [], 1
    wanted = sample + -(-checked // len(per))
    spark = docs.sparkSession
    shares = spark.createDataFrame([(r["lang"], min(1.0, wanted / r["n"])) for r in per], "known string, share double")
    drawn = rows.select("lang", "text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("draw")).join(F.broadcast(shares), F.col("lang") == F.col("known"))
    drawn = drawn.where(F.pmod("draw", F.lit(1 << 30)) < F.col("share") * float(1 << 30)).groupBy("lang", "draw").agg(F.min("text").alias("text"))
    found: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    full: set[str] = set()
    rest: list[tuple[str, str]] = []
    for r in drawn.orderBy("draw", "lang").limit(4 * wanted * len(per)).collect():
        text = normal(r["text"])
        if len(found.get(r["lang"], ())) == sample or size.get(r["lang"], 0) + len(text) > DICT_BYTES:
            full.add(r["lang"])  # from here on for the margin, whatever the length
        if r["lang"] not in full:
            found.setdefault(r["lang"], []).append(text)
            size[r["lang"]] = size.get(r["lang"], 0) + len(text)
        else:
            rest.append((r["lang"], r["text"]))
    dictionaries = [(r["lang"], b" ".join(found[r["lang"]])) for r in per if found.get(r["lang"])]
    return dictionaries, fit_margin(dictionaries, rest[:checked])


def fit_margin(dictionaries: list[tuple[str, bytes]], rows: list[tuple[str, str]], give_up: float = GIVE_UP) -> int:
    """The largest margin that rejects at most ``give_up`` of the rows (language, text) that are rightly identified."""
    model = Model((dictionaries, 1))
    margins = []
    for lang, text in rows:
        sizes = model.sizes(text)
        if len(sizes) > 1 and model.langs[sizes.index(min(sizes))] == lang:
            margins.append(margin_of(sizes))
    margins.sort()
    return max([1, *margins[int(give_up * len(margins)) :][:1]])


def margin_of(sizes: list[int]) -> int:
    """By how many bytes the second best is larger."""
    best, second = sorted(sizes)[:2]
    return second - best


class Model:
    """Compressors for what ``learn`` gives."""

    def __init__(self, learned: tuple[list[tuple[str, bytes]], int], level: int = LEVEL):
        dictionaries, self.margin = learned
        self.langs = [lang for lang, _ in dictionaries]
        how = {"level": level, "write_content_size": False, "write_dict_id": False}
        self.compressors = []
        for _, raw in dictionaries:
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, **how))

    def sizes(self, text: str | None) -> list[int]:
        """Bytes with each dictionary; none if there is nothing to go by."""
        if not text or not any(map(str.isalpha, text)):
            return []
        data = normal(text)
        return [len(c.compress(data)) for c in self.compressors]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected). The score is the best language's share of 2 ** -bytes over all languages."""
        sizes = self.sizes(text)
        if not sizes:
            return "und", 0.0, True
        best = min(sizes)
        narrow = len(sizes) > 1 and margin_of(sizes) < self.margin
        return self.langs[sizes.index(best)], 1.0 / sum(2.0 ** max(best - s, -1000) for s in sizes), narrow


_models: dict[str, Model] = {}


def _model(key: str, learned: tuple[list[tuple[str, bytes]], int]) -> Model:
    if key not in _models:
        _models.clear()
        _models[key] = Model(learned)
    return _models[key]


def identify(docs: DataFrame, learned: tuple[list[tuple[str, bytes]], int] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, rejected."""
    python_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs) if learned is None else learned)
    key = uuid4().hex

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(key, shared.value)
        for b in batches:
            langs, scores, rejected = zip(*map(model.predict, b.column("text").to_pylist()), strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select("doc_id", (fold(docs["doc_id"]) == HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language is rejected."""
    python_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))
    key = uuid4().hex

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(key, shared.value)
        for b in batches:
            yield b.filter(pa.array([not model.predict(t)[2] for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
