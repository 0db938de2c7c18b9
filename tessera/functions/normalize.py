"""Text normalisation as column expressions.

Order, for documents and queries alike: repair of double-encoded text (optional), punctuation
to spaces, split at ASCII white space, lower case, drop (empty, over 240 bytes, stop words),
stemming (a join on distinct terms, see ``tessera.operators.index``).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from importlib import resources

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that become spaces, by their length in UTF-8.
PUNCTUATION_1 = "\t\n!\"#$%&'()*,-./:;=?@[\\]^_{|}"
PUNCTUATION_2 = "".join(map(chr, (0xA1, 0xA3, 0xA7, 0xAB, 0xB6, 0xB7, 0xBB, 0xBF, *range(0x55A, 0x560), 0x589, 0x609, 0x60A)))
PUNCTUATION_3 = "".join(map(chr, (*range(0x2010, 0x2016), *range(0x2018, 0x2020), 0x2039, 0x203A, 0x2045, 0x2046, *range(0x2308, 0x230C), 0x2E17, 0x2E1A, 0x2E3A, 0x2E3B, 0x2E40, 0x3008, 0x3009, 0x301C, 0x3030, 0x30A0, 0xFE31, 0xFE32, 0xFE58, 0xFE63, 0xFF0D, 0xFF3F)))
PUNCTUATION = PUNCTUATION_1 + PUNCTUATION_2 + PUNCTUATION_3

#: C-locale white space.
WHITE = " \t\n\x0b\f\r"
MAX_TERM_BYTES = 240

ASCII_UPPER = "".join(map(chr, range(65, 91)))
LATIN1_UPPER = "".join(map(chr, range(0xC0, 0xE0)))
ASCII_LOWER = ASCII_UPPER.lower()
#: By code point + 32, so that the multiplication sign becomes the division sign and sharp s becomes y with diaeresis.
LATIN1_LOWER = "".join(chr(ord(c) + 32) for c in LATIN1_UPPER)


@dataclass(frozen=True)
class NormalizerConfig:
    """``english()`` has what a build with stemming does; the default has Latin-1 case and stop words."""

    fix_encoding: bool = False
    latin1_case: bool = True
    stop_words: bool = True
    stem: bool = False

    @classmethod
    def english(cls, **options) -> NormalizerConfig:
        return cls(**{"stop_words": True, "stem": True, **options})

    @classmethod
    def plain(cls, **options) -> NormalizerConfig:
        return cls(**{"stop_words": False, "stem": False, "latin1_case": False, **options})


@lru_cache(maxsize=1)
def stop_words() -> tuple[str, ...]:
    return tuple(resources.files("tessera.functions").joinpath("data/stopwords_en.txt").read_text("utf-8").split())


def character_class(chars: str) -> str:
    """A bracket expression that Java and RE2 both read."""
    return "[" + "".join(f"\\x{{{ord(c):X}}}" for c in chars) + "]"


def strip_punctuation(text: Column) -> Column:
    """Each punctuation character becomes as many spaces as it has bytes."""
    x = F.translate(text, PUNCTUATION_1, " " * len(PUNCTUATION_1))
    x = F.regexp_replace(x, character_class(PUNCTUATION_2), "  ")
    return F.regexp_replace(x, character_class(PUNCTUATION_3), "   ")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def lower_latin1(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER + LATIN1_UPPER, ASCII_LOWER + LATIN1_LOWER)


def looks_double_encoded(text: Column) -> Column:
    """Whether there is a C1 control, no-break space or soft hyphen, anywhere."""
    return text.rlike(r"[\x{80}-\x{A0}\x{AD}]")


def fix_encoding(text: Column) -> Column:
    """Read text whose UTF-8 was taken for Latin-1, if all of it reads so; else leave it."""
    bytes_ = F.encode(F.when(text.rlike(r"^[\x00-\xFF]*$"), text), "ISO-8859-1")
    return F.when(looks_double_encoded(text), F.coalesce(F.try_validate_utf8(bytes_.cast("string")), text)).otherwise(text)


def normal(text: Column, config: NormalizerConfig = NormalizerConfig()) -> Column:
    """A text in lower case whose words are separated by spaces: one pass of ``translate``."""
    if config.fix_encoding:
        text = fix_encoding(text)
    upper, lower = (ASCII_UPPER + LATIN1_UPPER, ASCII_LOWER + LATIN1_LOWER) if config.latin1_case else (ASCII_UPPER, ASCII_LOWER)
    blank = PUNCTUATION + "".join(c for c in WHITE if c not in PUNCTUATION and c != " ")
    return F.translate(text, blank + upper, " " * len(blank) + lower)


def words(text: Column, config: NormalizerConfig = NormalizerConfig()) -> Column:
    """The words of a text, empty ones among them, in an array."""
    return F.split(normal(text, config), " ")


def is_term(word: Column, config: NormalizerConfig = NormalizerConfig()) -> Column:
    """Whether a word counts: not empty, at most 240 bytes, no stop word."""
    ok = (word != "") & (F.octet_length(word) <= MAX_TERM_BYTES)
    return ok & ~word.isin(*stop_words()) if config.stop_words else ok


def terms(text: Column, config: NormalizerConfig = NormalizerConfig()) -> Column:
    """The terms of a text in order, in an array (before stemming)."""
    return F.filter(words(text, config), lambda w: is_term(w, config))
