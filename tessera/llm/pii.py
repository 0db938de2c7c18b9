"""Personal data: base patterns, and a skip-chain conditional random field over tokens.

The base patterns find e-mail addresses, IP addresses, payment cards and phone numbers. The
field then labels the tokens that hold a digit or an ``@`` (no other token can be personal
data here). A base span is one token, whatever white space it holds; groups of digits joined
by spaces, dots, hyphens or brackets are one where, read together, they are the digits of a
card or phone span, or one of the two is a long suffix of the other; what is left is cut at
white space. Its factors:

* node: shape features of a token;
* chain: labels of tokens next to each other;
* skip: labels of tokens, however distant, with the same key (letters and digits only, in
  lower case), or of a number and a card or phone one of which is a suffix of the other. A
  span counts with its own key and those of its parts between white space; each occurrence
  is tied straight to an observed one where there is any, else to the one before it, so n
  copies make at most n - 1 factors.

Tokens in base spans are observed with their kind. Sum-product messages pass over the graph,
loops included, until they settle, however many rounds that takes; a token that is not in a
base span is added as a span of its label if it is tied to an observed token and its marginal
reaches CERTAIN. So the second mention of a number that only once stood in full form is found.
Base spans are never changed.

The weights are trained piecewise (each kind of factor on its own) on a sample of at most
FIT_DOCS documents, those of least hash, that hold a digit or an ``@``. Base patterns label
full mentions only, so for the skip factors a shorter mention of each base span, written after
the text, is a pair that agrees; ties between tokens that no pattern labels are pairs too.
Workers count, the driver sees sums by shape and label.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import session
from tessera.llm.kernel import tidy
from tessera.llm.spans import Span, Taken, digest, joined

KINDS = ("email", "ip", "card", "phone")
ORDER = {k: i for i, k in enumerate(KINDS)}
FIT_DOCS = 2_000
#: Tied pairs of a label that the sample must have for its skip potentials to be learned.
FIT_TIES = 20
CERTAIN = 0.9
#: Letters and digits that a key needs to tie tokens.
KEY_LENGTH = 7
#: Messages have settled when none changes by more.
SETTLED = 1e-4
#: After so many rounds without progress the step is halved; below LEAST_STEP messages don't settle.
PATIENCE, LEAST_STEP = 100, 1e-4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]+")
# A match begins where its run of digits does: from inside the run it would fail the same way.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^ \t\n\x0b\x0c\r]*[0-9@][^ \t\n\x0b\x0c\r]*")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]+")
_GROUP = re.compile(r"(?<!\w)[0-9]+(?!\w)")
_JOINT = re.compile(r"[ .()-]{1,3}")
#: Digits that a card or phone span has at most.
MOST_DIGITS = 19


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)  # no address reaches back over an @
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """Leftmost matches that don't overlap, for each kind; failing ones are dropped."""
    out = _emails(text) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(x := part.lstrip("0")) < 4 and int(x or 0) <= 255 for part in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


@dataclass(frozen=True)
class Token:
    """``others`` are further keys of a base span; ``numbers`` the digits of cards and phones in
    it, or of joined groups."""

    start: int
    end: int
    key: str
    shape: tuple[int, ...]
    others: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()


_KEY = re.compile(r"[^a-z0-9]+")
_EDGE = "\"'`.,;:!?()[]{}<>#*$%&|"
N_SHAPES = 18


def _key(text: str) -> str:
    return _KEY.sub("", text.lower())


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _shape(text: str, start: int, core: str, bracket: bool) -> tuple[int, ...]:
    """Of ``core``; its token begins at ``start``, with a bracket or not."""
    digits = _digits(core)
    n = len(digits)
    letters = any(c.isalpha() for c in core)
    parts = core.split(".")
    quad = len(parts) == 4 and all(x.isascii() and x.isdigit() and len(x) < 4 and int(x) < 256 for x in parts)
    shape = [0]  # the constant
    shape += [1] if "@" in core else []
    shape += [2 + (n > 3) + (n > 6) + (n > 11) + (n > 19)]
    shape += [7] if letters else [8]
    shape += [9] if quad else []
    shape += [10] if core[0] == "+" else []
    shape += [11] if 12 <= n <= 19 and not letters and luhn(digits) else []
    shape += [12] if core.count(".") == 3 else []
    shape += [13] if "-" in core else []
    shape += [14] if bracket else []
    shape += [15] if start and text[max(0, start - 3) : start].strip()[-1:].isdigit() else []
    shape += [16] if n == len(core) else []
    shape += [17] if "@" in core and _DOMAIN.search(core) else []
    return tuple(shape)


def _piece(text: str, a: int, b: int) -> Token | None:
    """The token between two places, without the punctuation around it."""
    raw = text[a:b]
    core = raw.strip(_EDGE)
    if not core:
        return None
    start = a + raw.index(core)
    return Token(start, start + len(core), _key(core), _shape(text, a, core, raw[:1] == "("))


class Numbers:
    """The digits of cards and phones: which digits are one of them, a long suffix of one, or end with one."""

    def __init__(self) -> None:
        self.whole: dict[str, list[int]] = {}
        self.suffix: dict[str, list[int]] = {}

    def add(self, digits: str, at: int) -> None:
        if len(digits) >= KEY_LENGTH:
            self.whole.setdefault(digits, []).append(at)
            for k in range(len(digits) - KEY_LENGTH + 1):
                self.suffix.setdefault(digits[k:], []).append(at)

    def like(self, digits: str) -> tuple[int, list[int]]:
        """How many digits of the two are the same, and the places; 0 if too few."""
        for found in (self.whole, self.suffix):
            if digits in found:
                return len(digits), found[digits]
        for n in range(min(len(digits) - 1, MOST_DIGITS), KEY_LENGTH - 1, -1):
            if digits[-n:] in self.whole:
                return n, self.whole[digits[-n:]]
        return 0, []


def _joined_numbers(text: str, taken: Taken, numbers: Numbers) -> list[Token]:
    """Digit groups outside of base spans that together read like one of ``numbers``."""
    groups = [(m.start(), m.end()) for m in _GROUP.finditer(text) if not taken.overlaps(m.start(), m.end())]
    out = []
    last = len(groups) - 1
    while last >= 0:
        first, digits, same, best = last, "", 0, None
        while True:
            digits = text[groups[first][0] : groups[first][1]] + digits
            n = numbers.like(digits)[0]
            if n > same:  # another group must bring more of the number
                same, best = n, (first, digits)
            joint = first and text[groups[first - 1][1] : groups[first][0]]
            if len(digits) >= MOST_DIGITS or not joint or not _JOINT.fullmatch(joint):
                break
            first -= 1
        if best:
            start, end = groups[best[0]][0], groups[last][1]
            if text[start - 1 : start] == "(" and ")" in text[start:end]:
                start -= 1
            if start and text[start - 1] == "+":
                start -= 1
            out.append(Token(start, end, best[1], _shape(text, start, text[start:end], text[start] == "("), (), (best[1],)))
            last = best[0]
        last -= 1
    return out[::-1]


def tokens(text: str, spans: list[Span] | tuple[()] = ()) -> list[Token]:
    """Base spans (those that overlap as one), numbers like theirs, and what else has a digit or an ``@``."""
    whole: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if whole and a < whole[-1][1]:
            whole[-1][1] = max(whole[-1][1], b)
        else:
            whole.append([a, b])
    pieces = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    if not whole:
        return [t for a, b in pieces if (t := _piece(text, a, b))]
    starts = [a for a, _ in whole]
    keys: list[list[str]] = [[] for _ in whole]
    numbers, digits = Numbers(), [[] for _ in whole]
    for kind, a, b in spans:
        k = bisect(starts, a) - 1
        keys[k].append(_key(text[a:b]))
        if kind in ("card", "phone"):
            digits[k].append(_digits(text[a:b]))
            numbers.add(digits[k][-1], a)
    ends = [b for _, b in whole]
    for a, b in pieces:  # the parts of spans between white space, with what sticks to them
        touched = range(bisect(ends, a), bisect(starts, b - 1))
        if touched:
            key = _key(text[a:b].strip(_EDGE))  # one copy, however many spans are in the piece
            for k in touched:
                keys[k].append(key)
    out = [Token(a, b, _key(text[a:b]), _shape(text, a, text[a:b], text[a] == "("), tuple(keys[k]), tuple(digits[k])) for k, (a, b) in enumerate(whole)]
    if numbers.whole:
        out += _joined_numbers(text, Taken(list(spans)), numbers)
        out.sort(key=lambda t: t.start)
    starts, ends = [t.start for t in out], [t.end for t in out]
    rest = []
    for a, b in pieces:
        for k in range(bisect(ends, a), bisect(starts, b - 1)):
            rest.append((a, out[k].start))
            a = out[k].end
        rest.append((a, b))
    out += [t for a, b in rest if a < b and _MARK.search(text, a, b) and (t := _piece(text, a, b))]
    return sorted(out, key=lambda t: t.start)


LABELS = ("O", *KINDS)


@dataclass
class Field:
    """Log potentials: of shapes (by label), of neighbours, and of tied tokens."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def scores(self, toks: list[Token]) -> np.ndarray:
        return np.array([self.node[list(t.shape)].sum(axis=0) for t in toks])

    def marginals(self, toks: list[Token], observed: list[int], rounds: int | None = None) -> np.ndarray:
        """Label marginals of each token by loopy belief propagation; ``observed`` is a label or -1.

        Messages pass until they settle (or for ``rounds``, if given). Should they not settle at
        any step, ties between tokens that aren't observed are left out: those to observed
        tokens close no loop, so the rest is a chain, on which messages are exact and settle.
        """
        local = self.scores(toks)
        for i, y in enumerate(observed):
            if y >= 0:
                local[i] = -30.0
                local[i, y] = 0.0
        chain = [(i, i + 1, self.chain) for i in range(len(toks) - 1)]
        skip = [(i, j, self.skip) for i, j in ties(toks, observed)]
        if chain:
            got = _received(local, chain + skip, rounds)
            if got is None:
                got = _received(local, chain + [e for e in skip if max(observed[e[0]], observed[e[1]]) >= 0], rounds)
            local = local if got is None else local + got
        p = np.exp(local - local.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _received(local: np.ndarray, edges: list[tuple[int, int, np.ndarray]], rounds: int | None) -> np.ndarray | None:
    """The sum of the settled messages to each token; None if they don't settle."""
    a, b = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
    pot = np.stack([e[2] for e in edges])
    source, target = np.concatenate((a, b)), np.concatenate((b, a))
    pot = np.concatenate((pot, pot.transpose(0, 2, 1)))
    back = np.concatenate((np.arange(len(a), 2 * len(a)), np.arange(len(a))))
    sent = np.zeros((len(source), len(LABELS)))
    step, least, stale, done = 0.5, np.inf, 0, 0
    while rounds is None or done < rounds:
        belief = local.copy()
        np.add.at(belief, target, sent)
        new = _logsumexp((belief[source] - sent[back])[:, :, None] + pot, 1)
        new -= new.max(axis=1, keepdims=True)
        change = np.abs(new - sent).max()
        sent = (1 - step) * sent + step * new
        done += 1
        if change < SETTLED:
            break
        if change < 0.99 * least:
            least, stale = change, 0
        else:
            stale += 1
        if stale == PATIENCE:
            step, least, stale = step / 2, np.inf, 0
            if step < LEAST_STEP:
                return None
    got = np.zeros_like(local)
    np.add.at(got, target, sent)
    return got


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def anchors(toks: list[Token], observed: list[int]) -> dict[int, int]:
    """For tokens that aren't observed, an observed one of the same key, or else one whose number
    is like theirs: the last before, else the first after."""
    of_key: dict[str, list[int]] = {}
    numbers = Numbers()
    for i, t in enumerate(toks):
        if observed[i] >= 0:
            for key in {t.key, *t.others}:
                if len(key) >= KEY_LENGTH:
                    of_key.setdefault(key, []).append(i)
            for digits in t.numbers:
                numbers.add(digits, i)
    out = {}
    for i, t in enumerate(toks):
        if observed[i] < 0:
            found = of_key.get(t.key) or t.numbers and numbers.like(t.numbers[0])[1]
            if found:
                out[i] = found[max(bisect(found, i) - 1, 0)]
    return out


def ties(toks: list[Token], observed: list[int]) -> list[tuple[int, int]]:
    """Each token with its anchor; tokens of a key that is nowhere observed with the one before."""
    anchor = anchors(toks, observed)
    out = [(j, i) for i, j in anchor.items()]
    last: dict[str, int] = {}
    for i, t in enumerate(toks):
        if observed[i] < 0 and i not in anchor and len(t.key) >= KEY_LENGTH:
            if t.key in last:
                out.append((last[t.key], i))
            last[t.key] = i
    return out


def _observed(toks: list[Token], spans: list[Span]) -> list[int]:
    label = [-1] * len(toks)
    for kind, a, b in spans:
        for i in range(_first_after(toks, a), len(toks)):
            if toks[i].start >= b:
                break
            if toks[i].end > a:
                label[i] = 1 + ORDER[kind]
    return label


def _first_after(toks: list[Token], at: int) -> int:
    low, high = 0, len(toks)
    while low < high:
        mid = (low + high) // 2
        if toks[mid].end <= at:
            low = mid + 1
        else:
            high = mid
    return low


def mention(kind: str, span: str) -> str:
    """The span as it may be written when it comes up again, so that no base pattern finds it."""
    if kind == "email":
        return span.replace("@", "(@)")
    if kind == "ip":
        return span.replace(".", "-")
    parts = _DIGITS.findall(span)
    if len(parts) > 1 and sum(map(len, parts[1:])) >= KEY_LENGTH:
        return "-".join(parts[1:])
    return "".join(parts)[-KEY_LENGTH - 2 :]


def text_counts(text: str) -> Counter:
    """What a text adds to the counts of (shape, label), of neighbours' labels and of tied tokens' labels."""
    out: Counter = Counter()
    base = base_spans(text)
    toks = tokens(text, base)
    seen = _observed(toks, base)
    y = [max(v, 0) for v in seen]
    # Shapes are learned from the parts of spans as well, since later mentions look like parts.
    parts = tokens(text)
    out.update(("node", t.shape, max(v, 0)) for t, v in zip(parts, _observed(parts, base)))
    out.update(("node", t.shape, v) for t, v in zip(toks, y) if v and any(c.isspace() for c in text[t.start : t.end]))
    out.update(("chain", a, b) for a, b in zip(y, y[1:]))
    out.update(("skip", 0, 0) for a, b in ties(toks, seen) if seen[a] < 0 and seen[b] < 0)
    for kind, a, b in base:  # on its own, so that a long text costs no more for many spans
        short = f"{text[a:b]} \n {mention(kind, text[a:b])}"
        own = base_spans(short)
        toks = tokens(short, own)
        seen = _observed(toks, own)
        out.update(("skip", seen[i], 1 + ORDER[kind]) for t, i in anchors(toks, seen).items() if toks[t].start > b - a)
    return out


def train(counts: Counter, steps: int = 300) -> Field:
    """Piecewise: shapes by multinomial regression on base labels, pairs by smoothed log ratios of their counts."""
    k = len(LABELS)
    node = np.zeros((N_SHAPES, k))
    shapes = sorted({key[1] for key in counts if key[0] == "node"})
    if shapes:
        x, target = np.zeros((len(shapes), N_SHAPES)), np.zeros((len(shapes), k))
        for i, shape in enumerate(shapes):
            x[i, list(shape)] = 1
            target[i] = [counts["node", shape, label] for label in range(k)]
        weight = target.sum(1, keepdims=True)
        for step in range(steps):
            p = x @ node
            p = np.exp(p - p.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            node += 2.0 / (1 + step / 100) * (x.T @ (target - weight * p) / weight.sum() - 1e-4 * node)

    def table(name: str, more: float) -> np.ndarray:
        return np.array([[counts[name, a, b] for b in range(k)] for a in range(k)], float) + more

    def ratio(c: np.ndarray, most: float) -> np.ndarray:
        c = c / c.sum()
        return np.clip(np.log(c / (c.sum(1, keepdims=True) * c.sum(0, keepdims=True))), -most, most)

    skip = table("skip", 0.1)
    learned = ratio(skip + skip.T, 6.0)
    fixed = agreement(k)
    for label in range(k):  # labels that are hardly ever tied in the sample keep the fixed potentials
        if skip[label, label] < FIT_TIES:
            learned[label], learned[:, label] = fixed[label], fixed[:, label]
    return Field(node, ratio(table("chain", 0.5), 2.0), learned)


def agreement(k: int) -> np.ndarray:
    """Potentials of tied tokens where the sample has too few ties: to differ costs 6, and a
    mention without a label speaks less for O than a labelled one for its kind."""
    same = np.where(np.eye(k, dtype=bool), 0.0, -6.0)
    same[0, 0] = -3.0
    return same


def find(text: str, field: Field | None) -> tuple[list[Span], list[Span]]:
    """(base spans, spans that the field adds)."""
    base = base_spans(text)
    if field is None or not _DIGIT.search(text) and "@" not in text:
        return base, []
    toks = tokens(text, base)
    if not toks:
        return base, []
    label = _observed(toks, base)
    # Only a token that is tied to an observed one can have its label changed by it.
    open_ = list(anchors(toks, label))
    if not open_:
        return base, []
    p = field.marginals(toks, label)
    taken = Taken(base)
    more = []
    for i in open_:
        y = int(p[i].argmax())
        if y and p[i, y] >= CERTAIN and not taken.overlaps(toks[i].start, toks[i].end):
            more.append((LABELS[y], toks[i].start, toks[i].end))
    return base, more


@tidy
def _detect(batches, field: Field):
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans")}
        for text in batch.column(1).to_pylist():
            base, more = find(text or "", field)
            for k in KINDS:
                out[f"n_{k}"].append(sum(s[0] == k for s in base))
            out["base_sha256"].append(digest(base, ORDER))
            out["spans"].append(joined(base + more, ORDER))
            out["n_spans"].append(len(base) + len(more))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.int64() if k.startswith("n_") else pa.string()) for k, v in out.items())], ["id", *out])


@tidy
def _counts(batches):
    total: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            total.update(text_counts(text))
    yield pa.RecordBatch.from_arrays([pa.array(map(repr, total), pa.string()), pa.array(total.values(), pa.int64())], ["what", "n"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS) -> Field:
    """Learn from ``fit_docs`` documents at most. Null and empty texts, and those without a digit
    or ``@``, have no say; rows that repeat id and text are one. Without any document the field
    is flat, and adds nothing but by its fixed ties."""
    session.ship_code(docs.sparkSession)
    rows = docs.where(F.col(text_col).rlike("[0-9@]")).select(F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    chosen = rows.select("h").distinct().orderBy("h").limit(fit_docs)  # hashes alone are sorted
    texts = rows.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("text").alias("text")).select("text")
    sums = texts.mapInArrow(_counts, "what string, n long").groupBy("what").agg(F.sum("n").alias("n")).toArrow()  # a few rows for each shape
    return train(Counter({ast.literal_eval(what): n for what, n in zip(sums["what"].to_pylist(), sums["n"].to_pylist())}))


def detect(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, base counts by kind, base_sha256, all spans and their number.

    Null and empty texts have no spans (the hash is that of the empty string). Rows are judged
    each on its own, so repeated rows and null ids change nothing; an empty table gives an empty
    result, and other columns, whatever they are called, play no part.
    """
    session.ship_code(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(lambda it: _detect(it, field), "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long").withColumnRenamed("id", id_col)
