"""Legacy 8-bit (Bijoy) Bengali: confidence, font names, conversion to Unicode.

The Column functions stay in the JVM except where a step depends on what has
been written so far (a reph moves back over its cluster, step by step); that
one is an Arrow-batched function that only looks at texts with a reph. Every step has a plain Python twin, used by
parsing tasks and as the tests' oracle.
"""

from __future__ import annotations

import re
from functools import lru_cache
from graphlib import TopologicalSorter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quire.functions.bengali import PRE_BASE, VIRAMA

# What each code, and each sequence of codes, stands for.
CODES = {
    "$": "৳", "&": "্", "0": "০", "1": "১", "2": "২", "3": "৩", "4": "৪", "5": "৫", "6": "৬", "7": "৭", "8": "৮", "9": "৯", "A": "অ", "B": "ই",
    "C": "ঈ", "D": "উ", "E": "ঊ", "F": "ঋ", "G": "এ", "H": "ঐ", "I": "ও", "J": "ঔ", "K": "ক", "L": "খ", "M": "গ", "N": "ঘ", "O": "ঙ", "P": "চ",
    "Q": "ছ", "R": "জ", "S": "ঝ", "T": "ঞ", "U": "ট", "V": "ঠ", "W": "ড", "X": "ঢ", "Y": "ণ", "Z": "ত", "_": "থ", "`": "দ", "a": "ধ", "b": "ন",
    "c": "প", "d": "ফ", "e": "ব", "f": "ভ", "g": "ম", "h": "য", "i": "র", "j": "ল", "k": "শ", "l": "ষ", "m": "স", "n": "হ", "o": "ড়", "p": "ঢ়",
    "q": "য়", "r": "ৎ", "s": "ং", "t": "ঃ", "u": "ঁ", "v": "া", "w": "ি", "x": "ী", "y": "ু", "|": "।", "~": "ূ", "¨": "্য", "©": "র্", "ª": "্র",
    "°": "ক্ক", "±": "ক্ট", "³": "ক্ত", "µ": "ক্র", "¶": "ক্ষ", "·": "ক্স", "¸": "গু", "»": "গ্ধ", "¼": "ঙ্ক", "½": "ঙ্গ", "¾": "জ্জ", "À": "জ্ঝ",
    "Á": "জ্ঞ", "Â": "ঞ্চ", "Ã": "ঞ্ছ", "Ä": "ঞ্জ", "Å": "ঞ্ঝ", "Æ": "ট্ট", "Ç": "ড্ড", "È": "ণ্ট", "É": "ণ্ঠ", "Ë": "ত্ত", "Ì": "ত্থ", "Î": "ত্র",
    "Ï": "দ্দ", "Ð": "ণ্ড", "Ò": "“", "Ó": "”", "Ô": "‘", "Õ": "’", "×": "দ্ধ", "Ø": "দ্ব", "Ù": "দ্ম", "Ú": "ন্ঠ", "Û": "ন্ড", "Ü": "ন্ধ",
    "Ý": "ন্স", "Þ": "প্ট", "ß": "প্ত", "à": "প্প", "á": "প্স", "â": "ব্জ", "ã": "ব্দ", "ä": "ব্ধ", "å": "ভ্র", "ç": "ম্ফ", "é": "ল্ক", "ê": "ল্গ",
    "ë": "ল্ট", "ì": "ল্ড", "í": "ল্প", "î": "ল্ফ", "ï": "শু", "ð": "শ্চ", "ò": "ষ্ণ", "ó": "ষ্ট", "ô": "ষ্ঠ", "õ": "ষ্ফ", "ö": "স্খ", "÷": "স্ট",
    "ù": "স্ফ", "û": "হু", "ü": "হৃ", "ý": "হ্ন", "þ": "হ্ম", "Š": "ৗ", "‡": "ে", "…": "ৃ", "‰": "ৈ", "Av": "আ", "K¡": "ক্ব", "K¬": "ক্ল",
    "M¥": "গ্ম", "Mªy": "গ্রু", "M\u00ad": "গ্ল", "Mœ": "গ্ন", "R¡": "জ্ব", "U¡": "ট্ব", "U¥": "ট্ম", "Y^": "ণ্ব", "Z¡": "ত্ব", "Z¥": "ত্ম",
    "Zœ": "ত্ন", "_¡": "থ্ব", "`ªæ": "দ্রু", "a¥": "ধ্ম", "aŸ": "ধ্ব", "b¥": "ন্ম", "bœ": "ন্ন", "cø": "প্ল", "cœ": "প্ন", "d¬": "ফ্ল", "eø": "ব্ল",
    "eŸ": "ব্ব", "gœ": "ম্ন", "iy": "রু", "i¨": "র\u200c্য", "iƒ": "রূ", "j¥": "ল্ম", "j¦": "ল্ব", "jø": "ল্ল", "k¥": "শ্ম", "k¦": "শ্ব", "kø": "শ্ল",
    "kœ": "শ্ন", "mœ": "স্ন", "n¬": "হ্ল", "nè": "হ্ণ", "¤^": "ম্ব", "¤¢": "ম্ভ", "¤£": "ম্ভ্র", "¤§": "ম্ম", "¤\u00ad": "ম্ল", "¤ú": "ম্প",
    "ª¨": "্র্য", "®§": "ষ্ম", "®ú": "ষ্প", "®Œ": "ষ্ক্র", "®‹": "ষ্ক", "¯Z": "স্ত", "¯^": "স্ব", "¯§": "স্ম", "¯\u00ad": "স্ল", "¯¿": "স্ত্র",
    "¯ú": "স্প", "¯Œ": "স্ক্র", "¯‘": "স্তু", "¯’": "স্থ", "¯‹": "স্ক", "¾¡": "জ্জ্ব", "Ë¡": "ত্ত্ব", "š^": "ন্ব", "š¿": "ন্ত্র", "šÍ": "ন্ত",
    "š—¡": "ন্ত্ব", "š‘": "ন্তু", "š’": "ন্থ", "˜M": "দ্গ", "˜N": "দ্ঘ", "”P": "চ্চ", "”Q": "চ্ছ", "”Q¡": "চ্ছ্ব", "”T": "চ্ঞ", "•L": "ঙ্খ",
    "•N": "ঙ্ঘ", "•¶": "ঙ্ক্ষ", "›U": "ন্ট", "›`": "ন্দ", "›Ø": "ন্দ্ব", "™¢": "দ্ভ",
}
# Second codes of two signs.
ALIASES = ("†Ö", "‡ª")
# Parts of the names of such fonts, compared to the name's letters in lower case.
FONT_HINTS = ["sutonny", "sutonnymj", "sutonnyomj", "sutonnyemj", "boishakhi", "chandrabati", "modhumati", "amarbangla", "shreelipi", "bijoy", "ansi", "proshika", "ekushey"]

CONSONANT = "ক-হৎড়ঢ়য়ৰৱ"
CLUSTER_TAIL = "়ঁংঃ"
_PRE_BASE = f"([{PRE_BASE}])([{CONSONANT}](?:[{CLUSTER_TAIL}]|{VIRAMA}[{CONSONANT}])*)"
_REPH = "র" + VIRAMA
_PAIRS = [("ো", "ো"), ("ৌ", "ৌ")]
_NUKTAS = [("ড়", "ড়"), ("ঢ়", "ঢ়"), ("য়", "য়")]


@lru_cache(maxsize=1)
def conversion_table() -> dict[str, str]:
    """``CODES``, longest sequences first."""
    return dict(sorted(CODES.items(), key=lambda kv: (-len(kv[0]), kv[0])))


@lru_cache(maxsize=1)
def substitution_pattern() -> str:
    """Matches the longest known sequence, else any one character; the same in Java, RE2 and Python."""
    escaped = ["".join("\\" + c if c in "$^|\\.*+?()[]{}" else c for c in k) for k in conversion_table()]
    return "(?s)" + "|".join(escaped) + "|."


def ascii_keys() -> str:
    return "".join(k for k in CODES if len(k) == 1 and ord(k) < 0x80)


# --- plain Python -----------------------------------------------------------


@lru_cache(maxsize=1)
def _compiled() -> tuple[re.Pattern, dict]:
    """The sequences as a pattern, and what ``str.translate`` makes of single codes and of the sequences' stand-ins."""
    more = [k for k in conversion_table() if len(k) > 1]
    stand_in = {k: chr(0xF0000 + i) for i, k in enumerate(more)}
    single = {ord(k): v for k, v in CODES.items() if len(k) == 1}
    return re.compile("|".join(map(re.escape, more))), single | {ord(c): CODES[k] for k, c in stand_in.items()} | {"of": stand_in}


def substitute_text(text: str) -> str:
    if not text.isascii() and re.search("[\U000f0000-\U000f00ff]", text):  # it holds stand-ins itself
        return re.sub(substitution_pattern()[4:-2], lambda m: CODES[m[0]], text)
    sequences, table = _compiled()
    return sequences.sub(lambda m: table["of"][m[0]], text).translate(table)


def move_rephs_text(text: str) -> str:
    """Each reph that follows a cluster moves before it.

    A reph is a ra with virama not preceded by a virama. It goes back over
    anything that is no consonant, then over one cluster of consonants.
    """
    if _REPH not in text:
        return text
    out: list[str] = []
    is_consonant = re.compile(f"[{CONSONANT}]").match
    at = 0
    for m in re.finditer(f"(?<!{VIRAMA}){_REPH}", text):
        out.extend(text[at : m.start()])
        at = m.end()
        k = len(out)
        while k and not is_consonant(out[k - 1]):
            k -= 1
        while k >= 3 and out[k - 2] == VIRAMA and is_consonant(out[k - 3]):
            k -= 2
        out[max(k - 1, 0) : max(k - 1, 0)] = _REPH
    return "".join(out) + text[at:]


def to_unicode_text(ansi: str) -> str:
    if not ansi:
        return ansi
    text = substitute_text(ansi.translate(str.maketrans(*ALIASES)))
    text = move_rephs_text(re.sub(_PRE_BASE, r"\2\1", text))
    for a, b in [*_PAIRS, *_NUKTAS]:
        text = text.replace(a, b)
    return text


def confidence_text(text: str) -> float:
    if not text or re.search("[ঀ-৿]", text):
        return 0.0
    letters = len(re.findall("[\x21-\x7e\x80-\U0010ffff]", text))
    keys = len(re.findall(f"[{re.escape(ascii_keys())}\x80-\U0010ffff]", text))
    return min(1.0, keys / letters) if letters else 0.0


def font_name_hints(name: str) -> bool:
    letters = re.sub("[^a-z]", "", name.lower())
    return any(h in letters for h in FONT_HINTS)


# --- Columns ----------------------------------------------------------------

NOT_LETTERS = "[^\\x21-\\x7E\\x{80}-\\x{10FFFF}]"


def not_keys() -> str:
    keys = "".join("\\" + c if not c.isalnum() else c for c in ascii_keys())
    return f"[^{keys}\\x{{80}}-\\x{{10FFFF}}]"


def confidence(text: Column) -> Column:
    """How strongly a text looks like Bijoy codes, 0 to 1; 0 for empty text and text with Bengali letters."""
    letters = F.length(F.regexp_replace(text, NOT_LETTERS, ""))
    keys = F.length(F.regexp_replace(text, not_keys(), ""))
    share = F.when(letters > 0, F.least(F.lit(1.0), keys / letters)).otherwise(0.0)
    return F.when((F.length(text) == 0) | text.rlike("[ঀ-৿]"), 0.0).otherwise(share)


def looks_like_font(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z]", "").rlike("|".join(FONT_HINTS))


def canonical(text: Column) -> Column:
    return F.translate(text, *ALIASES)


@lru_cache(maxsize=1)
def replacement_order() -> list[str]:
    """The sequences so that replacing one after the other gives the leftmost, longest matches.

    A sequence goes before those that it begins with, and before those that
    begin with its end, as it lies left of them where they overlap.
    """
    more = [k for k in CODES if len(k) > 1]
    before = {k: {x for x in more if x != k and (x.startswith(k) or not k.startswith(x) and any(x.endswith(k[:n]) for n in range(1, len(k))))} for k in more}
    return list(TopologicalSorter(before).static_order())


def _replaced(text: Column, keys: list[str]) -> Column:
    pairs = F.array(*[F.struct(F.lit(k).alias("code"), F.lit(CODES[k]).alias("text")) for k in keys])
    return F.aggregate(pairs, text, lambda t, p: F.replace(t, p["code"], p["text"]))


def substitute(text: Column | str) -> Column:
    """The table's longest matches replaced, in the JVM: sequences, then single codes that stand for several characters, then the others."""
    text = F.col(text) if isinstance(text, str) else text
    single = {k: v for k, v in CODES.items() if len(k) == 1}
    several = [k for k, v in single.items() if len(v) > 1]
    plain = {k: v for k, v in single.items() if len(v) == 1}
    ascii_only = F.octet_length(text) == F.length(text)
    replaced = F.when(ascii_only, _replaced(text, [k for k in replacement_order() if k.isascii()])).otherwise(_replaced(text, replacement_order() + several))
    return F.translate(replaced, "".join(plain), "".join(plain.values()))


def reorder_pre_base(text: Column) -> Column:
    """A vowel sign drawn before its cluster moves behind it."""
    return F.regexp_replace(text, _PRE_BASE, "$2$1")


@F.pandas_udf(StringType())
def move_rephs(text: pd.Series) -> pd.Series:
    """Each reph that follows a cluster moves before it; texts without one come back as they are."""
    return text.map(move_rephs_text, na_action="ignore")


def recompose_vowels(text: Column) -> Column:
    for a, b in _PAIRS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def compose_nuktas(text: Column) -> Column:
    for a, b in _NUKTAS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def to_unicode(ansi: Column | str) -> Column:
    """Bijoy codes to Unicode Bengali."""
    ansi = F.col(ansi) if isinstance(ansi, str) else ansi
    return compose_nuktas(recompose_vowels(move_rephs(reorder_pre_base(substitute(canonical(ansi))))))


@F.pandas_udf(ArrayType(StringType()))
def to_unicode_each(texts: pd.Series) -> pd.Series:
    """Arrays of Bijoy codes to Unicode Bengali, text by text; null texts stay."""
    return texts.map(lambda row: [None if t is None else to_unicode_text(t) for t in row], na_action="ignore")


def _as_udf(f):
    return F.pandas_udf(lambda text: text.map(f, na_action="ignore"), StringType())


def register(spark) -> None:
    """The scalar functions under SQL names."""
    spark.udf.register("bijoy_to_unicode", _as_udf(to_unicode_text))
    spark.udf.register("bijoy_substitute", _as_udf(substitute_text))
    spark.udf.register("bijoy_move_rephs", _as_udf(move_rephs_text))
