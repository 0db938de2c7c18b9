"""Secrets: base patterns, and sliding-window entropy over candidate strings.

The base patterns find assignments to telling names, cloud access keys and hexadecimal
strings. The method then takes every run of 20 and more characters that keys are written in;
its character class (hexadecimal, or base64 and the like) sets the entropy that a window of
WINDOW characters must reach, as a class of few characters can't reach what another can. The
window slides by one; counts, and with them the sum of c * log2(c), are updated by the
character that comes and the one that goes. Windows that reach the threshold make up a span,
unless the string is on the allow list (plain words, numbers, paths, dates). A part between
separators that is a placeholder is cut out, and what is left on each side is looked at as a
string of its own, so an ``example`` in a path or name hides no key beside it.
Spans are added only beside base spans, which are never changed.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import session
from tessera.llm.kernel import tidy
from tessera.llm.spans import Span, Taken, digest, joined

KINDS = ("assign", "access", "hex")
ORDER = {k: i for i, k in enumerate((*KINDS, "entropy"))}
WINDOW = 20
#: Bits a character that a window must reach; a window of 20 has 4.32 at most.
THRESHOLDS = {"hex": 3.0, "base64": 3.8}

_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_NAMES = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}")
_IS_HEX = re.compile(r"[0-9a-fA-F]+\Z")

#: A candidate, or what placeholders leave of it, that matches one of these as a whole is no secret.
ALLOW = (
    r"[^0-9]*",  # no digit: words, however long or joined
    r"[^A-Za-z]*",  # no letter: numbers, dates, rules of dashes
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # identifiers
    r"(?:[A-Za-z]{2,}[0-9]{0,4}|[0-9]{1,4})(?:[-_/+=](?:[A-Za-z]{2,}[0-9]{0,4}|[0-9]{1,4})?)*",  # words and short numbers, joined
)
#: A part of a candidate (letters and digits between separators) that matches one of these as a whole is cut out.
PLACEHOLDERS = (
    r"(?i:.*(?:example|placeholder|x{6}|0{8}).*)",
    r"(?:0123456789|[aA]bcdefghijklmnop|ABCDEFGHIJKLMNOP).*",
)
_PART = re.compile(r"[A-Za-z0-9]+")


def high_windows(text: str, threshold: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """The stretches of ``text`` made up of windows whose Shannon entropy reaches ``threshold`` bits."""
    n = len(text)
    if n < window:
        return []
    log = [c * math.log2(c) if c else 0.0 for c in range(window + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    out: list[tuple[int, int]] = []
    # entropy = log2(window) - total / window
    most = (math.log2(window) - threshold) * window + 1e-9
    for i, c in enumerate(text):
        k = counts.get(c, 0)
        counts[c] = k + 1
        total += log[k + 1] - log[k]
        if i >= window:
            gone = text[i - window]
            k = counts[gone]
            counts[gone] = k - 1
            total += log[k - 1] - log[k]
        if i >= window - 1 and total <= most:
            start = i - window + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def base_spans(text: str) -> list[Span]:
    """Leftmost matches that don't overlap, for each kind; failing ones are dropped."""
    out: list[Span] = []
    low = text.lower()
    if any(x in low for x in _NAMES):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def compiled(patterns: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(f"(?:{x})" for x in patterns) or r"(?!)", re.ASCII)


_PLACEHOLDERS = compiled(PLACEHOLDERS)


def _without_placeholders(word: str, placeholders: re.Pattern) -> list[tuple[int, int]]:
    """What is left of ``word`` beside its placeholders, without the separators towards them."""
    cuts = [(m.start(), m.end()) for m in _PART.finditer(word) if placeholders.fullmatch(m[0])]
    out = []
    for a, b in zip([0, *(e for _, e in cuts)], [*(x for x, _ in cuts), len(word)]):
        while a and a < b and word[a] in "-_/+=":
            a += 1
        while b < len(word) and b > a and word[b - 1] in "-_/+":  # = may end a key
            b -= 1
        out.append((a, b))
    return out


def entropy_spans(text: str, base: list[Span], allow: re.Pattern, placeholders: re.Pattern = _PLACEHOLDERS) -> list[Span]:
    out: list[Span] = []
    taken = Taken(base)
    for m in _CANDIDATE.finditer(text):
        if allow.fullmatch(m[0]):
            continue
        for start, end in _without_placeholders(m[0], placeholders):
            word = m[0][start:end]
            if len(word) < WINDOW or allow.fullmatch(word):
                continue
            kind = "hex" if _IS_HEX.match(word) else "base64"
            for a, b in high_windows(word, THRESHOLDS[kind]):
                a, b = m.start() + start + a, m.start() + start + b
                if not taken.overlaps(a, b):
                    out.append(("entropy", a, b))
    return out


@tidy
def _scan(batches, allow: tuple[str, ...], placeholders: tuple[str, ...]):
    allowed, cut = compiled(allow), compiled(placeholders)
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans")}
        for text in batch.column(1).to_pylist():
            text = text or ""
            base = base_spans(text)
            every = base + entropy_spans(text, base, allowed, cut)
            for k in KINDS:
                out[f"n_{k}"].append(sum(s[0] == k for s in base))
            out["base_sha256"].append(digest(base, ORDER))
            out["spans"].append(joined(every, ORDER))
            out["n_spans"].append(len(every))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.int64() if k.startswith("n_") else pa.string()) for k, v in out.items())], ["id", *out])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: tuple[str, ...] = ALLOW, placeholders: tuple[str, ...] = PLACEHOLDERS) -> DataFrame:
    """One row for each row of ``docs``: id, base counts by kind, base_sha256, all spans and their number.

    Null and empty texts have no spans (the hash is that of the empty string). Rows are judged
    each on its own, so repeated rows and null ids change nothing; an empty table gives an empty
    result, and other columns, whatever they are called, play no part.
    """
    session.ship_code(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(lambda it: _scan(it, allow, placeholders), "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long").withColumnRenamed("id", id_col)
