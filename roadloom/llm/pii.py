"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes and identifier cues. From each,
a deterministic parser expands to the boundaries of an email, a number, an address on the web or an account, and
validates it. A parser reads each run of characters a fixed number of times, so very long texts cost linear time.

Base kinds (email, ip, card, phone) are exactly the leftmost non-overlapping matches of their patterns that pass their
tests; failing matches are dropped and not tried again. The method adds ``url`` and ``account`` spans. After the cue of
an IBAN an account is a country, two check digits and blocks that pass the remainder by 97; after that of a social
security number, nine digits of which no part is one that is never given out; after other cues, a value with a digit.

Defined cases: a null or empty text has no spans; a very long one is read whole; of anchors that would give overlapping
spans of a kind the first counts; rows with equal ids give a row each; an empty table gives an empty
result; extra columns are left out. Offsets count code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from roadloom.staging import python_ready

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]

# Schemes, and words that announce an account or a secret.
SCHEMES = ("http://", "https://", "ftp://", "mailto:", "tel:")
CUES = ("iban", "account", "acct", "passport", "ssn", "token", "api_key", "apikey", "password", "secret", "license no", "customer no")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_RUN = re.compile(r"[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])*+")
_PHONE = re.compile(r"[\x20().0-9-]++")
_DIGITS = re.compile(r"[0-9]")
_URL = re.compile(r"[^\s<>\"'`{}|\\^]++")
_VALUE = re.compile(r"[\x20]?[:=#]?[\x20]?[\"']?([A-Za-z0-9][A-Za-z0-9_-]{5,63}+)")
_IBAN = re.compile(r"[^A-Za-z0-9]{0,3}(?:(?i:no|number|nr)[.:]?[\x20])?([A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30}+)")
_SSN = re.compile(r"[^A-Za-z0-9]{0,3}(?:(?i:no|number|nr)[.:]?[\x20])?([0-9]{3})([-\x20]?)([0-9]{2})\2([0-9]{4})(?![0-9])")
_UPPER = {c: c + 32 for c in range(65, 91)}


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in ("@", "+", *"0123456789", *SCHEMES, *CUES):
        a.add_word(w, (w if len(w) == 1 else "scheme" if w in SCHEMES else "cue", len(w)))
    a.make_automaton()
    return a


_anchors: list[ahocorasick.Automaton] = []


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c)
        total += v if k % 2 == 0 else 2 * v - 9 * (v > 4)
    return total % 10 == 0


def iban(text: str, at: int) -> tuple[int, int] | None:
    """The span of the IBAN after a cue that ends at ``at``: the longest run of blocks that passes its check."""
    m = _IBAN.match(text, at)
    if not m:
        return None
    a, b = m.span(1)
    for stop in range(b, a + 14, -1):
        plain = text[a:stop].replace(" ", "")
        if 15 <= len(plain) <= 34 and text[stop - 1] != " " and not text[stop : stop + 1].isalnum() and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
            return a, stop
    return None


def ssn(text: str, at: int) -> tuple[int, int] | None:
    """The span of the social security number after a cue that ends at ``at``."""
    m = _SSN.match(text, at)
    if not m or m[1] in ("000", "666") or m[1] >= "900" or m[3] == "00" or m[4] == "0000":
        return None
    return m.start(1), m.end()


def find(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """The spans (start, end) of each kind, in order."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return spans
    if not _anchors:
        _anchors.append(_automaton())
    low = text.lower()
    if len(low) != len(text):
        low = text.translate(_UPPER)
    emails = ips = cards = phones = urls = accounts = 0  # where the next of the kind may start
    for end, (what, size) in _anchors[0].iter(low):
        i = end - size + 1
        if what == "@":
            a = i
            while a > emails and text[a - 1] in _LOCAL:
                a -= 1
            if a < i and (m := _DOMAIN.match(text, i + 1)):
                spans["email"].append((a, m.end()))
                emails = m.end()
            else:
                emails = i + 1  # no later match can reach back over this sign
        elif what == "+":
            if i >= phones and _DIGITS.match(text, i + 1) and (m := _PHONE.match(text, i + 2)):
                stop = m.end()
                while stop > i + 3 and not "0" <= text[stop - 1] <= "9":
                    stop -= 1
                if stop > i + 3:
                    phones = stop
                    if 9 <= len(_DIGITS.findall(text, i, stop)) <= 15:
                        spans["phone"].append((i, stop))
        elif what == "scheme":
            m = _URL.match(text, end + 1)
            if i >= urls and m and (i == 0 or not text[i - 1].isalnum()):
                stop = m.end()
                while stop > end + 1 and text[stop - 1] in ".,;:!?)]":
                    stop -= 1
                if stop > end + 2:
                    spans["url"].append((i, stop))
                    urls = stop
        elif what == "cue":
            whole = (i == 0 or not low[i - 1].isalnum()) and not low[end + 1 : end + 2].isalnum()
            if whole and i >= accounts and low[i : end + 1] in ("iban", "ssn"):
                if span := (iban if low[i] == "i" else ssn)(text, end + 1):
                    spans["account"].append(span)
                    accounts = span[1]
            elif whole and i >= accounts and (m := _VALUE.match(text, end + 1)) and _DIGITS.search(m[1]) and not text[m.end() : m.end() + 1].isalnum():
                spans["account"].append(m.span(1))
                accounts = m.end()
        else:
            if i >= ips:
                if m := _IP.match(text, i):
                    ips = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                        spans["ip"].append(m.span())
                else:
                    ips = _RUN.match(text, i).end()
            if i >= cards:
                m = _CARD.match(text, i)
                cards = m.end()
                if 13 <= cards - i <= 37:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        spans["card"].append(m.span())
    return spans


def written(spans: dict[str, list[tuple[int, int]]], kinds=KINDS) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_url", "n_account", "base_sha256", "spans"]
    for b in batches:
        found = [find(t) for t in b.column("text").to_pylist()]
        counts = [pa.array([len(f[k]) for f in found], pa.int64()) for k in KINDS]
        base = pa.array([sha256(written(f, BASE).encode()).hexdigest() for f in found], pa.string())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, base, pa.array([written(f) for f in found], pa.string())], names)


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts of the kinds, a hash of the base spans, and all spans."""
    python_ready(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_url long, n_account long, base_sha256 string, spans string")


def mask(text: str | None) -> str | None:
    """``text`` with each span replaced by its kind in angle brackets; of overlapping spans the first and longest counts."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, k in sorted(((a, b, k) for k, xs in find(text).items() for a, b in xs), key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], f"<{k}>"]
            at = b
    return "".join([*out, text[at:]])
