"""The English (Porter2) stemmer, written from its published description."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.normalize import MAX_TERM_BYTES, NormalizerConfig, stop_words

_VOWELS = frozenset("aeiouy")
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = frozenset("cdeghkmnrt")
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
}
_INVARIANT = frozenset(("sky", "news", "howe", "atlas", "cosmos", "bias", "andes"))
_AFTER_1A = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
_STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"),
    ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"),
    ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"),
    ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
_ENDS2, _ENDS3, _ENDS1B = tuple(s for s, _ in _STEP2), tuple(s for s, _ in _STEP3), ("eedly", "eed", "ingly", "edly", "ing", "ed")
_PREFIXES = ("gener", "commun", "arsen")
#: A vowel and what isn't one.
_SYLLABLE = re.compile("[aeiouy][^aeiouy]").search


def _regions(w: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""

    def after(start: int) -> int:
        found = _SYLLABLE(w, start)
        return found.end() if found else len(w)

    r1 = next((len(p) for p in _PREFIXES if w.startswith(p)), 0) if w.startswith(_PREFIXES) else after(0)
    return r1, after(r1)


def _short_syllable(w: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-1] not in _VOWELS and w[-1] not in "wxY" and w[-2] in _VOWELS and w[-3] not in _VOWELS


def _has_vowel(w: str) -> bool:
    return not _VOWELS.isdisjoint(w)


def _step1b(w: str, r1: int) -> str:
    if not w.endswith(_ENDS1B):
        return w
    for s in ("eedly", "eed"):
        if w.endswith(s):
            return w[: -len(s)] + "ee" if len(w) - len(s) >= r1 else w
    for s in ("ingly", "edly", "ing", "ed"):
        if w.endswith(s):
            stem = w[: -len(s)]
            if not _has_vowel(stem):
                return w
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if stem.endswith(_DOUBLES):
                return stem[:-1]
            if r1 >= len(stem) and _short_syllable(stem):
                return stem + "e"
            return stem
    return w


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    w = word.removeprefix("'")
    if w in _SPECIAL:
        return _SPECIAL[w]
    if w in _INVARIANT:
        return w
    if not w:
        return w
    # A y at the start, or after a vowel, is a consonant.
    if "y" in w:
        marked = list(w)
        for i, c in enumerate(marked):
            if c == "y" and (i == 0 or marked[i - 1] in _VOWELS):
                marked[i] = "Y"
        w = "".join(marked)
    r1, r2 = _regions(w)

    if "'" in w:
        for s in ("'s'", "'s", "'"):
            if w.endswith(s):
                w = w[: -len(s)]
                break

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _has_vowel(w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w.replace("Y", "y")

    w = _step1b(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"

    for s, to in _STEP2 if w.endswith(_ENDS2) else ():
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                if s == "ogi":
                    w = w[:-1] if w[-4:-3] == "l" else w
                elif s == "li":
                    w = w[:-2] if w[-3:-2] in _LI and len(w) > 2 else w
                else:
                    w = w[: -len(s)] + to
            break
    for s, to in _STEP3 if w.endswith(_ENDS3) else ():
        if w.endswith(s):
            if len(w) - len(s) >= (r2 if s == "ative" else r1):
                w = w[: -len(s)] + to
            break
    for s in _STEP4 if w.endswith(_STEP4) else ():
        if w.endswith(s):
            if len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(s)]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_syllable(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stem_array(words: pa.Array) -> pa.Array:
    """Stems of an array, each distinct word of it looked up once."""
    coded = words.dictionary_encode()
    return pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


def stem_column(word: Column) -> Column:
    """Stems in Arrow batches."""

    @F.arrow_udf("string")
    def apply(words: pa.Array) -> pa.Array:
        return stem_array(words)

    return apply(word)


def split_words(batches: Iterator[pa.RecordBatch], config: NormalizerConfig) -> Iterator[pa.RecordBatch]:
    """(docid, term, tf = 1), a row for each term, of normalised texts (docid, text). Each distinct word
    of a batch is looked at once."""
    stop = pa.array(stop_words() if config.stop_words else [], pa.string())
    for batch in batches:
        lists = pc.split_pattern(batch.column("text"), " ")
        words = lists.flatten().dictionary_encode()
        docs = batch.column("docid").take(pc.list_parent_indices(lists))
        each, size = words.dictionary, pc.binary_length(words.dictionary)
        good = pc.and_(pc.and_(pc.greater(size, 0), pc.less_equal(size, MAX_TERM_BYTES)), pc.invert(pc.is_in(each, stop)))
        rows = pa.RecordBatch.from_arrays([docs, words, pa.array(np.ones(len(words), np.int64))], ["docid", "term", "tf"])
        yield rows.filter(good.take(words.indices))


def _starts(ids: pa.Array) -> np.ndarray:
    """For each row, whether another document begins."""
    values, null = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), pc.is_null(ids).to_numpy(zero_copy_only=False)
    return np.concatenate([[True], (values[1:] != values[:-1]) | (null[1:] != null[:-1])])


def _counted(rows: pa.RecordBatch, stemming: bool) -> pa.RecordBatch:
    """Sums by document and term of rows that come document by document."""
    words, docs = rows.column("term").dictionary_encode(), rows.column("docid")
    terms, code = words.dictionary, words.indices
    if stemming:
        stems = pa.array([stem(w) for w in terms.to_pylist()], pa.string()).dictionary_encode()
        terms, code = stems.dictionary, stems.indices.take(code)
    code = code.to_numpy().astype(np.int64)
    key = np.cumsum(_starts(docs)) * len(terms) + code
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
    tf, at = np.add.reduceat(rows.column("tf").to_numpy()[order], first), order[first]
    sums = pa.RecordBatch.from_arrays([docs.take(pa.array(at)), terms.take(pa.array(code[at])), pa.array(tf, pa.int64())], ["docid", "term", "tf"])
    return sums.filter(pc.not_equal(sums.column("term"), ""))


def _lengthened(rows: pa.Table) -> list[pa.RecordBatch]:
    """Rows of whole documents, with the sum ``dl`` of each one's ``tf``."""
    if not rows:
        return []
    first = np.flatnonzero(_starts(rows["docid"].combine_chunks()))
    sums = np.add.reduceat(rows["tf"].to_numpy(), first)
    return rows.append_column("dl", pa.array(np.repeat(sums, np.diff(first, append=rows.num_rows)))).combine_chunks().to_batches()


def stem_counts(batches: Iterator[pa.RecordBatch], stemming: bool = True) -> Iterator[pa.RecordBatch]:
    """(docid, term, tf, dl) by stem, or by term, of rows that come document by document."""

    def summed(tables: list[pa.Table]) -> pa.Table:
        if len(tables) == 1:
            return tables[0]
        sums = pa.concat_tables(tables).group_by(["docid", "term"]).aggregate([("tf", "sum")])
        return sums.select(["docid", "term", "tf_sum"]).rename_columns(["docid", "term", "tf"])

    held: list[pa.Table] = []  # the last document, which may go on in the next batch
    for batch in batches:
        rows = pa.Table.from_batches([_counted(batch, stemming)]) if batch.num_rows else None
        if not rows:
            continue
        if held and held[0]["docid"][0] == rows["docid"][0]:
            n = _first_run(rows["docid"])
            held.append(rows.slice(0, n))
            rows = rows.slice(n)
            if not rows:
                continue
        if held:
            yield from _lengthened(summed(held))
        last = int(np.flatnonzero(_starts(rows["docid"].combine_chunks()))[-1])
        yield from _lengthened(rows.slice(0, last))
        held = [rows.slice(last)]
    if held:
        yield from _lengthened(summed(held))


def _first_run(ids: pa.ChunkedArray) -> int:
    """How many rows the first document has."""
    return int(np.append(np.flatnonzero(_starts(ids.combine_chunks())), len(ids))[1])


def text_counts(config: NormalizerConfig) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(docid, term, tf, dl), by stem if terms are stemmed, of normalised texts (docid, text) in order of documents."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return stem_counts(split_words(batches, config), config.stem)

    return counts
