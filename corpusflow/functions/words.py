"""Pre-tokenizers as column expressions: text to an array of words, in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import PUNCT, SPACE

BEHAVIORS = ("removed", "isolated", "contiguous", "merged_with_previous", "merged_with_next")


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def whitespace_words(text: Column) -> Column:
    """Runs between white space."""
    return _all(text, f"[^{SPACE}]+")


def bert_words(text: Column) -> Column:
    """Runs without white space and punctuation, and each punctuation character."""
    return _all(text, f"[{PUNCT}]|[^{SPACE}{PUNCT}]+")


def punctuation_words(text: Column) -> Column:
    """Each punctuation character, and what lies between, white space included."""
    return _all(text, f"[{PUNCT}]|[^{PUNCT}]+")


#: Characters of no text that open and close a match, or part two neighbours, while a text is being split.
OPEN, CLOSE, PART = "\ue000", "\ue001", "\ue002"
MARKS = OPEN + CLOSE + PART


def split_words(text: Column, pattern: str, behavior: str = "removed", literal: bool = False, invert: bool = False) -> Column:
    """Split at a pattern's matches (with invert: at what lies between) and treat these as behavior says. No empty words.

    Matches get marks around them; each behavior takes some marks away before the text is split at the others.
    """
    found = re.escape(pattern) if literal else pattern
    behavior = re.sub("(?<!^)(?=[A-Z])", "_", behavior).lower()
    if behavior not in BEHAVIORS:
        raise ValueError(f"unknown behavior {behavior}")
    marked = F.regexp_replace(text, f"(?:{found})", f"{OPEN}$0{CLOSE}")
    if invert:
        swapped = F.concat(F.lit(OPEN), F.translate(marked, OPEN + CLOSE, CLOSE + OPEN), F.lit(CLOSE))
        marked = F.replace(swapped, F.lit(OPEN + CLOSE), F.lit(PART))
    if behavior == "removed":
        marked = F.regexp_replace(marked, f"{OPEN}[^{CLOSE}]*{CLOSE}", OPEN)
    elif behavior == "contiguous":
        marked = F.replace(marked, F.lit(CLOSE + OPEN), F.lit(""))
    elif behavior == "merged_with_previous":
        marked = F.regexp_replace(marked, f"(?<=[^{MARKS}]){OPEN}", "")
    elif behavior == "merged_with_next":
        marked = F.regexp_replace(marked, f"{CLOSE}(?=[^{MARKS}])", "")
    return F.filter(F.split(marked, f"[{MARKS}]"), lambda w: w != "")


def space_led_words(text: Column, prefix: bool = False) -> Column:
    """Cut before each space, which stays with its word; prefix puts one before the text if it has none."""
    text = F.when(~text.startswith(" "), F.concat(F.lit(" "), text)).otherwise(text) if prefix else text
    return F.filter(F.split(text, "(?= )"), lambda w: w != "")


def metaspace_words(text: Column, replacement: str = "▁", prepend: bool = True, split: bool = True) -> Column:
    """Spaces as `replacement`, cut before each; split=False keeps one word."""
    text = F.when((text != "") & ~text.startswith(" "), F.concat(F.lit(" "), text)).otherwise(text) if prepend else text
    marked = F.replace(text, F.lit(" "), F.lit(replacement))
    if not split:
        return F.filter(F.array(marked), lambda w: w != "")
    return F.filter(F.split(marked, f"(?={re.escape(replacement)})"), lambda w: w != "")


def added_token_segments(text: Column, tokens: list[str]) -> Column:
    """Cut out the added tokens, the longest first; they are words of their own."""
    if not tokens:
        return F.filter(F.array(text), lambda w: w != "")
    pattern = "|".join(re.escape(t) for t in sorted(tokens, key=len, reverse=True))
    return split_words(text, pattern, "isolated")
