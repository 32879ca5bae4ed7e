"""Character classes and text normalizers: column expressions where Java's regular expressions can say it, else over Arrow."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, punctuation and CJK characters, as classes of Java's regular expressions (fixed values).
SPACE = r"\t\n\x0B\f\r \u0085\p{Z}"
PUNCT = r"!-/:-@\[-`{-~\p{P}"
CJK_RANGES = [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F)]
CJK = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in CJK_RANGES)
FORMS = ("NFC", "NFD", "NFKC", "NFKD")


def is_space(c: str) -> bool:
    return c in "\t\n\v\f\r \x85" or unicodedata.category(c).startswith("Z")


def is_punctuation(c: str) -> bool:
    return "!" <= c <= "/" or ":" <= c <= "@" or "[" <= c <= "`" or "{" <= c <= "~" or unicodedata.category(c).startswith("P")


def is_cjk(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in CJK_RANGES)


def is_control(c: str) -> bool:
    return c not in "\t\n\r" and unicodedata.category(c) == "Cc"


def clean(text: Column) -> Column:
    """Without NUL, U+FFFD and control characters; every white space is a space."""
    return F.regexp_replace(F.regexp_replace(text, r"[\x00\x{FFFD}]|[\p{Cc}&&[^\t\n\r]]", ""), r"[\t\n\r\p{Zs}]", " ")


def space_cjk(text: Column) -> Column:
    return F.regexp_replace(text, f"([{CJK}])", " $1 ")


def lowercase(text: Column) -> Column:
    return F.lower(text)


def unicode_form(text: Column, form: str) -> Column:
    """NFC, NFD, NFKC or NFKD. ASCII stays in the JVM's hands: only other texts change, but all go through Arrow."""
    if form not in FORMS:
        raise ValueError(f"unknown form {form}")

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize(form, t))

    return run(text)


def strip_marks(text: Column) -> Column:
    """Without nonspacing marks; after NFD these are the accents."""
    return F.regexp_replace(text, r"\p{Mn}+", "")


def strip_accents(text: Column) -> Column:
    return strip_marks(unicode_form(text, "NFD"))
