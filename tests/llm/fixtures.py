"""Small tables with every awkward case, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile("[^\x20\x09-\x0d]+")


def awkward(seed: int = 0, n: int = 60) -> list[tuple]:
    """Random texts with copies, near copies, shared passages, nulls, empty and very long texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(["th", "er", "on", "an", "é", "ß", "re"]) for _ in range(rng.randrange(1, 4))) for _ in range(400)]

    def text(k: int) -> str:
        return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\n", "\t", "  ", " ", "\x1c", ", "]) for _ in range(k))

    passage = text(40)
    texts: list[str | None] = [None, "", "   \n\t", "one", "One", "ONE two", "one two", "a b c d", "a b x c d", "A b c d", text(30_000)]
    for _ in range(n):
        kind = rng.randrange(6)
        if kind == 0 and texts[-1]:
            texts.append(rng.choice(texts))
        elif kind == 1:
            base = rng.choice([t for t in texts if t and len(t) < 5000]).split(" ")
            for _ in range(max(1, len(base) // 25)):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            texts.append(" ".join(base))
        elif kind == 2:
            texts.append(text(rng.randrange(60)) + passage + text(rng.randrange(60)))
        elif kind == 3 and texts[-1]:
            texts.append(texts[-1][:3000].upper())
        else:
            texts.append(text(rng.randrange(1, 200)))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    sources = [None, "src1", "src10", "é", "", "Src"]
    return [(i, t, rng.choice([None, "en"]), rng.choice(sources), rng.choice([None, 1])) for i, t in zip(ids, texts)]


def frame(spark, rows, clash: bool = False):
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        for c in ("id", "n", "sig", "kept", "key", "rep", "size", "component", "value", "bucket", "target", "copies", "h", "n_words"):
            df = df.withColumn(c, F.lit("clash"))
    return df


def byte_words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def shingle_set(text: str | None) -> frozenset:
    w = (text or "").encode().translate(LOW).split()
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)]) if w else frozenset()


def near_classes(rows) -> dict[int, tuple]:
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j, t in sets.items():
            if i < j and s and t and 100 * len(s & t) >= 80 * len(s | t):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def exact_groups(rows) -> dict[int, tuple]:
    low = {r[0]: (r[1] or "").encode().translate(LOW) for r in rows}
    size = Counter(low.values())
    keep = {}
    for i, t in low.items():
        keep[t] = max(i, keep.get(t, i))
    return {i: (keep[t], size[t], keep[t] == i, hashlib.sha256(t).hexdigest()) for i, t in low.items()}


def without_repeats(rows, k: int = 13) -> dict[int, tuple]:
    first: dict[tuple, int] = {}
    words = {r[0]: byte_words(r[1]) for r in rows}
    for i, w in words.items():
        for j in range(len(w) - k + 1):
            x = tuple(w[j : j + k])
            first[x] = min(i, first.get(x, i))
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < i:
                gone[j : j + k] = [True] * k
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    return out


def quality_counts(text: str | None) -> tuple:
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    repeated = [False] * len(words)
    for i, w in enumerate(windows):
        if count[w] > 1:
            repeated[i : i + 8] = [True] * 8
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(repeated)
