"""Bengali character functions as Columns, with plain Python twins for use inside parsing tasks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

VIRAMA, RA, NUKTA = "্", "র", "়"

# The Indic category of code points, first match wins.
CATEGORY_RANGES = [
    ("nukta", [(0x09BC, 0x09BC)]),
    ("halant", [(0x09CD, 0x09CD)]),
    ("zwnj", [(0x200C, 0x200C)]),
    ("zwj", [(0x200D, 0x200D)]),
    ("ra", [(0x09B0, 0x09B0), (0x09F0, 0x09F0)]),
    ("syllable_modifier", [(0x0981, 0x0983)]),
    ("placeholder", [(0x0980, 0x0980), (0x09BD, 0x09BD), (0x25CC, 0x25CC)]),
    ("vowel", [(0x0985, 0x098C), (0x098F, 0x0990), (0x0993, 0x0994), (0x09E0, 0x09E1)]),
    ("consonant", [(0x0995, 0x09A8), (0x09AA, 0x09B0), (0x09B2, 0x09B2), (0x09B6, 0x09B9), (0x09CE, 0x09CE), (0x09DC, 0x09DD), (0x09DF, 0x09DF), (0x09F1, 0x09F1)]),
    ("matra", [(0x09BE, 0x09C4), (0x09C7, 0x09C8), (0x09CB, 0x09CC), (0x09D7, 0x09D7), (0x09E2, 0x09E3)]),
    ("digit", [(0x09E6, 0x09EF)]),
    ("symbol", [(0x09F2, 0x09FE)]),
]
# Two-part vowel signs and letters with nukta, and their parts.
DECOMPOSITIONS = [("ো", "ো"), ("ৌ", "ৌ"), ("ড়", "ড়"), ("ঢ়", "ঢ়"), ("য়", "য়")]
# Vowel signs drawn left of their cluster.
PRE_BASE = "িেৈ"

BENGALI_CLASS = "[ঀ-৿]"
_DEPENDENT = ("matra", "syllable_modifier", "nukta")


def category_of(cp: int) -> str:
    for name, ranges in CATEGORY_RANGES:
        if any(a <= cp <= b for a, b in ranges):
            return name
    return "other"


def category(cp: Column) -> Column:
    """Indic category of a code point column."""
    out = F
    for name, ranges in CATEGORY_RANGES:
        test = F.lit(False)
        for a, b in ranges:
            test = test | (cp == a if a == b else cp.between(a, b))
        out = out.when(test, name)
    return out.otherwise("other")


def is_pre_base_matra(cp: Column) -> Column:
    return cp.isin(*map(ord, PRE_BASE))


def is_dependent_sign(cp: Column) -> Column:
    return category(cp).isin(*_DEPENDENT)


def has_bengali(text: Column) -> Column:
    return text.rlike(BENGALI_CLASS)


def _replaced(text, pairs):
    for a, b in pairs:
        text = text.replace(a, b) if isinstance(text, str) else F.replace(text, F.lit(a), F.lit(b))
    return text


def decompose(text):
    """Split the five characters that can be written two ways; Column or str."""
    return _replaced(text, DECOMPOSITIONS)


def recompose(text):
    """The inverse of ``decompose``; Column or str."""
    return _replaced(text, [(b, a) for a, b in DECOMPOSITIONS])


# Fixed value: a vowel sign directly before a virama and its consonants.
_SIGN_BEFORE_VIRAMA = "([\u09be-\u09cc\u09d7]+)((?:\u09cd[\u0995-\u09b9\u09dc-\u09df]\u09bc?)+)"


def signs_after_conjuncts(text):
    """A vowel sign that precedes a virama and consonants moves behind them; Column or str."""
    if isinstance(text, str):
        return re.sub(_SIGN_BEFORE_VIRAMA, r"\2\1", text)
    return F.regexp_replace(text, _SIGN_BEFORE_VIRAMA, "$2$1")


# A Bengali word is malformed if it starts with a dependent sign, or has two vowel signs in a row.
MALFORMED = "^[ঁ-ঃা-্ৗ]|[া-ৌৗ]{2}"
BENGALI_WORD = "[ঀ-৿]+"


def bengali_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(BENGALI_WORD), F.lit(0))


def malformed_words(text: Column) -> Column:
    """The Bengali words of a text that no speller would write."""
    return F.filter(bengali_words(text), lambda w: w.rlike(MALFORMED))


#: White space as JavaScript's trim takes it.
SPACES = "\t-\r    -     　﻿"


def normalise(text: Column) -> Column:
    """For comparing extractions: decomposed, joiners dropped, white space collapsed and trimmed."""
    t = F.regexp_replace(decompose(text), "[\u200c\u200d]", "")
    return F.regexp_replace(F.regexp_replace(t, f"[{SPACES}]+", " "), "^ | $", "")


def normalise_composed(text: Column) -> Column:
    """As ``normalise``, in the composed direction."""
    t = F.regexp_replace(recompose(text), "[\u200c\u200d]", "")
    return F.regexp_replace(F.regexp_replace(t, f"[{SPACES}]+", " "), "^ | $", "")


def is_wordless(text: Column) -> Column:
    """No letter of any script."""
    return ~text.rlike("\\p{L}")


# Scripts and combining ranges of the layout step.
SCRIPT_BENGALI = [(0x0980, 0x09FF)]
SCRIPT_COMMON = [(0x200C, 0x200D), (0x0000, 0x0040), (0x005B, 0x0060), (0x007B, 0x00BF), (0x2000, 0x206F), (0x20A0, 0x20CF)]
COMBINING = [(0x0300, 0x036F), (0x0900, 0x0DFF), (0x200C, 0x200D), (0xFE00, 0xFE0F)]


def _within(cp: Column, ranges) -> Column:
    test = F.lit(False)
    for a, b in ranges:
        test = test | cp.between(a, b)
    return test


def script(cp: Column) -> Column:
    return F.when(_within(cp, SCRIPT_BENGALI), "Beng").when(_within(cp, SCRIPT_COMMON), "Zyyy").otherwise("Other")


def script_of(cp: int) -> str:
    if any(a <= cp <= b for a, b in SCRIPT_BENGALI):
        return "Beng"
    return "Zyyy" if any(a <= cp <= b for a, b in SCRIPT_COMMON) else "Other"


def is_combining(cp: Column) -> Column:
    return _within(cp, COMBINING)


def combining(cp: int) -> bool:
    return any(a <= cp <= b for a, b in COMBINING)
