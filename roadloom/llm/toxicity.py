"""Toxicity from a lexicon met by Levenshtein automata, with the context of each hit.

The lexicon (whole words and word beginnings) is learned from labelled documents and held in a trie. The Levenshtein
automaton of a word, intersected with the trie, is run as one automaton whose states are made as they are met: a state is
the set of (trie node, edits spent), so misspelled terms are found in one pass over a word's letters, and most words are
given up after two or three. Each hit is scored in a window of words around it: quotation marks and words of reporting
make it a quotation, a second person or further hits make it abuse. A logistic regression on the sums per document gives
the score.

Labels are learned from a bounded sample: the first ``SAMPLE`` labelled documents of at most ``LONGEST`` characters in
order of a hash of their id, then id and a hash of the text, so equal tables give equal samples; rows whose crc32(id as
text) mod 5 is 0 are never learned from. The lexicon is all that the sample supports. Every whole text is scored.

Defined cases: a null or empty text gets the score of a text without hits; without labels the built-in terms and weights
are used; a null id counts as labelled by none; rows with equal texts score alike; an empty table gives an empty result;
extra columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.langid import fold
from roadloom.staging import python_ready

FOLDS, HELD_OUT = 5, 0
SAMPLE = 6_000
LONGEST = 20_000
WINDOW = 6
TOLD = 80  # characters on either side of a hit in which quotation marks enclose it
BEGINNING = (5, 9)  # lengths of word beginnings that may become terms

# Common insults, words of reporting and of address.
TERMS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "bastard", "retard", "imbecile")
REPORTING = frozenset("said says say wrote writes called calls quoted quote quotes term word phrase reported according".split())
ADDRESS = frozenset("you your youre yours u ur du dein deine tu ton vous votre eres tus".split())
QUOTES = frozenset("\"“”„«»")
SINGLE = frozenset("'‘’`")  # also apostrophes, so they count only right around a term
NEAR = 0.6  # of an exact hit
WEIGHTS = (-3.0, 3.0, -0.5, 0.5, 0.5)

_WORD = re.compile(r"\w+")
_MEMO = 300_000


def allowed_edits(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


class Automaton:
    """The trie of (term, is a beginning) and its Levenshtein states, made as they are met."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.children: list[dict[str, int]] = [{}]
        self.edits = [-1]  # most edits of the terms below a node
        self.ends: list[int] = [-1]  # edits allowed where a whole term ends
        self.begins = [False]
        for term, beginning in terms:
            node, most = 0, 0 if beginning else allowed_edits(len(term))
            path = [0]
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.edits.append(-1)
                    self.ends.append(-1)
                    self.begins.append(False)
                node = self.children[node][c]
                path.append(node)
            for n in path:
                self.edits[n] = max(self.edits[n], most)
            if beginning:
                self.begins[node] = True
            else:
                self.ends[node] = most
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.accepts: list[int] = []
        self.next: list[dict[str, int]] = []
        self.dead = self._state({})
        self.start = self._state({0: 0})
        self.memo: dict[str, int] = {}

    def _state(self, spent: dict[int, int]) -> int:
        todo = sorted(spent.items(), key=lambda x: x[1])
        best: dict[int, int] = {}
        while todo:  # a letter of a term may be missing from the word
            node, e = todo.pop(0)
            if e > self.edits[node] or best.get(node, 99) <= e:
                continue
            best[node] = e
            todo.extend((child, e + 1) for child in self.children[node].values())
        key = frozenset(best.items())
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            self.accepts.append(min((e for n, e in key if self.ends[n] >= e), default=9))
            self.next.append({})
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        spent: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.edits[node] and e < spent.get(node, 99):
                spent[node] = e

        for node, e in self.members[state]:
            put(node, e + 1)  # a letter too many
            for letter, child in self.children[node].items():
                put(child, e + (letter != c))
        new = self._state(spent)
        if len(self.next[state]) < 4096:
            self.next[state][c] = new
        return new

    def distance(self, word: str) -> int:
        """Edits to the nearest term within its allowance, 9 if there is none. A beginning must be met exactly."""
        got = self.memo.get(word)
        if got is None:
            state, got = self.start, 9
            for c in word:
                to = self.next[state].get(c)
                state = self._step(state, c) if to is None else to
                if state == self.dead:
                    break
                if any(e == 0 and self.begins[n] for n, e in self.members[state]):
                    got = 0
                    break
            else:
                got = self.accepts[state]
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            self.memo[word] = got
        return got


def enclosed(text: str, a: int, b: int) -> bool:
    """Whether marks stand right around text[a:b]; single ones must not be apostrophes within a word."""
    left, right = text[a - 1 : a], text[b : b + 1]
    if a == 0 or not right:
        return False
    if left in QUOTES and right in QUOTES:
        return True
    return left in SINGLE and right in SINGLE and not text[max(0, a - 2) : a - 1].isalnum() and not text[b + 1 : b + 2].isalnum()


def reported(text: str, a: int, b: int, around: list[str]) -> bool:
    """Whether a word of reporting is near and quotation marks stand on both sides."""
    return not REPORTING.isdisjoint(around) and not QUOTES.isdisjoint(text[max(0, a - TOLD) : a]) and not QUOTES.isdisjoint(text[b : b + TOLD])


def features(text: str | None, automaton: Automaton) -> np.ndarray:
    """1; logs of the hits, a misspelled one counting less, and of quotations; density of hits; hits that address somebody."""
    low = (text or "").lower()
    words = _WORD.findall(low)
    hits = [(i, d) for i, d in enumerate(map(automaton.distance, words)) if d < 9] if words else []
    exact = near = quoted = addressed = 0.0
    if hits:
        spots = {i for i, _ in hits}
        marks: list[tuple[int, int]] = []
        for k, m in enumerate(_WORD.finditer(low)):
            if k in spots:
                marks.append(m.span())
        for (i, d), (a, b) in zip(hits, marks, strict=True):
            around = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
            told = enclosed(low, a, b) or reported(low, a, b, around)
            if told:
                quoted += 1
            elif d == 0:
                exact += 1
            else:
                near += 1
            addressed += not told and not ADDRESS.isdisjoint(around)
    hit = exact + NEAR * near
    return np.array([1.0, np.log1p(hit), np.log1p(quoted), 100 * hit / max(20, len(words)), np.log1p(addressed)])


def learn_terms(texts: list[str], toxic: list[int]) -> list[tuple[str, bool]]:
    """Words and beginnings that stand in several toxic documents and in hardly any others."""
    lo, hi = BEGINNING
    sides: tuple[Counter, Counter] = (Counter(), Counter())

    def forms(text: str, wanted=None) -> set[tuple[str, bool]]:
        out: set[tuple[str, bool]] = set()
        for w in set(_WORD.findall(text.lower())):
            if not w.isdigit() and len(w) >= 3:
                out.add((w, False))
                out.update((w[:n], True) for n in range(lo, min(hi, len(w)) + 1))
        return out if wanted is None else out & wanted

    for t, y in zip(texts, toxic, strict=True):
        if y:
            sides[1].update(forms(t))
    n = max(1, sum(toxic))
    least = max(3, n // 100)
    wanted = {f for f, k in sides[1].items() if k >= least}
    for t, y in zip(texts, toxic, strict=True):
        if not y:
            sides[0].update(forms(t, wanted))
    m = max(1, len(toxic) - sum(toxic))
    good = [(k, f) for f, k in sides[1].items() if k >= least and (k + 0.5) / n > 20 * (sides[0][f] + 0.5) / m]
    chosen: list[tuple[str, bool]] = []
    begun: set[str] = set()
    for _, (w, beginning) in sorted(good, key=lambda x: (-x[0], len(x[1][0]), x[1])):
        if not any(w[:k] in begun for k in range(lo, len(w) + 1)):
            chosen.append((w, beginning))
            if beginning:
                begun.add(w)
    return chosen


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 30, penalty: float = 0.5) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + penalty * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[tuple[str, bool]], list[float]]:
    """(terms, weights) from the sample."""
    known = labels.where(F.col("toxic").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("doc_id").isNotNull())
    draw = F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxic"))
    chosen = known.select(F.col("doc_id").alias("labelled"), "toxic", draw.alias("draw")).orderBy("draw", "labelled", "toxic").limit(sample)
    rows = docs.select("doc_id", "text").where(F.length("text") <= LONGEST).join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))
    rows = rows.select("draw", "doc_id", "toxic", "text").orderBy("draw", "doc_id", F.xxhash64("text"), "toxic").limit(sample).collect()
    texts, y = [r["text"] or "" for r in rows], [int(r["toxic"] > 0) for r in rows]
    terms = [*dict.fromkeys([*learn_terms(texts, y), *((t, False) for t in TERMS)])]
    if len(set(y)) < 2:
        return terms, list(WEIGHTS)
    a = Automaton(terms)
    return terms, fit(np.array([features(t, a) for t in texts]), np.array(y, float)).tolist()


_automata: dict[str, Automaton] = {}


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    python_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    key = uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights = shared.value
        if key not in _automata:
            _automata.clear()
            _automata[key] = Automaton(terms)
        automaton, w = _automata[key], np.array(weights)
        for b in batches:
            z = np.array([features(t, automaton) @ w for t in b.column("text").to_pylist()], float)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", (fold(docs["doc_id"], FOLDS) == HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
