"""Texts that know which bytes of the original each of their characters comes from; normalizers and pre-tokenizers on them."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import regex

from ...functions.chars import PUNCT, SPACE, is_cjk, is_control

Span = tuple[int, int]
WORDS = regex.compile(f"[^{SPACE}]+")
BERT = regex.compile(f"[{PUNCT}]|[^{SPACE}{PUNCT}]+")
PUNCTUATED = regex.compile(f"[{PUNCT}]|[^{PUNCT}]+")
MARKS = regex.compile(r"\p{Mn}+")


def byte_letters() -> list[str]:
    """The printable letter of each byte value: its own where printable, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


LETTERS = byte_letters()
BYTES = {c: b for b, c in enumerate(LETTERS)}


@dataclass
class Aligned:
    """text, and of each character the bytes of the original it stands for; without spans only the text is kept up."""

    text: str
    spans: list[Span] | None = None

    @staticmethod
    def of(text: str, start: int = 0) -> Aligned:
        spans, at = [], start
        for c in text:
            n = len(c.encode())
            spans.append((at, at + n))
            at += n
        return Aligned(text, spans)

    def cut(self, a: int, b: int) -> Aligned:
        return Aligned(self.text[a:b], self.spans[a:b] if self.spans is not None else None)

    def span(self, a: int, b: int) -> Span:
        """Of characters a to b: from the first's first byte to the last's end."""
        some = (self.spans or [])[a:b]
        return (min(x for x, _ in some), max(y for _, y in some)) if some else (0, 0)

    def each(self, fn: Callable[[str], str]) -> Aligned:
        """Each character replaced by any number of others, which stand for the same bytes."""
        if self.spans is None:
            return Aligned("".join(map(fn, self.text)))
        made = [(new, span) for c, span in zip(self.text, self.spans, strict=True) for new in fn(c)]
        return Aligned("".join(c for c, _ in made), [s for _, s in made])

    def whole(self, fn: Callable[[str], str]) -> Aligned:
        """A function of whole texts. Aligned by runs that start at a base character, as composition works on those."""
        if self.spans is None:
            return Aligned(fn(self.text))
        parts, at = [], 0
        while at < len(self.text):
            end = at + 1
            while end < len(self.text) and (unicodedata.combining(self.text[end]) or unicodedata.category(self.text[end]) == "Mn" or "ᅠ" <= self.text[end] <= "ᇿ"):
                end += 1
            parts.append((fn(self.text[at:end]), self.span(at, end)))
            at = end
        if "".join(p for p, _ in parts) != (made := fn(self.text)):  # a form that joins across runs: all of it stands for all
            return Aligned(made, [self.span(0, len(self.text))] * len(made))
        return Aligned(made, [s for p, s in parts for _ in p])

    def replaced(self, pattern: regex.Pattern, to: Callable[[regex.Match], str]) -> Aligned:
        if self.spans is None:
            return Aligned(pattern.sub(to, self.text))
        text, spans, at = [], [], 0
        for m in pattern.finditer(self.text):
            text.append(self.text[at : m.start()])
            spans += self.spans[at : m.start()]
            new = to(m)
            near = self.span(m.start(), m.end()) if m.end() > m.start() else (self.spans[m.start()][0],) * 2 if m.start() < len(self.spans) else (self.spans[-1][1],) * 2 if self.spans else (0, 0)
            text.append(new)
            spans += [near] * len(new)
            at = m.end()
        return Aligned("".join(text) + self.text[at:], spans + self.spans[at:])


Normalizer = Callable[[Aligned], Aligned]
PreTokenizer = Callable[[Aligned], list[Aligned]]


def lower(t: Aligned) -> Aligned:
    return Aligned(t.text.lower()) if t.spans is None else t.each(str.lower)


def strip_accents(t: Aligned) -> Aligned:
    t = t.whole(lambda x: unicodedata.normalize("NFD", x))
    return t.replaced(MARKS, lambda _: "")


def clean(t: Aligned) -> Aligned:
    return t.each(lambda c: "" if c in "\0�" or is_control(c) else " " if c in "\t\n\r" or unicodedata.category(c) == "Zs" else c)


def pattern_of(spec: dict | None) -> regex.Pattern | None:
    """Of {"String": s} or {"Regex": r}; None for none, or for a pattern that isn't valid."""
    if not spec:
        return None
    if spec.get("String"):
        return regex.compile(regex.escape(spec["String"]))
    try:
        return regex.compile(spec["Regex"]) if spec.get("Regex") else None
    except regex.error:
        return None


def normalizer(spec: dict | None, clean_text: bool = False) -> Normalizer:
    """Unknown types leave texts as they are. clean_text: whether BertNormalizer heeds its own flag of that name."""
    kind = (spec or {}).get("type")
    if kind == "Sequence":
        steps = [normalizer(s, clean_text) for s in spec.get("normalizers") or []]

        def sequence(t: Aligned) -> Aligned:
            for s in steps:
                t = s(t)
            return t

        return sequence
    if kind == "Lowercase":
        return lower
    if kind in ("NFC", "NFD", "NFKC", "NFKD"):
        return lambda t: t if t.text.isascii() else t.whole(lambda x: unicodedata.normalize(kind, x))
    if kind == "StripAccents":
        return lambda t: t if t.text.isascii() else strip_accents(t)
    if kind == "Replace":
        found, content = pattern_of(spec.get("pattern")), spec.get("content") or ""
        if found is None:
            return lambda t: t
        if spec["pattern"].get("String"):
            return lambda t: t.replaced(found, lambda _: content)
        content = regex.sub(r"\$(\d+)", r"\\g<\1>", content.replace("\\", "\\\\"))
        return lambda t: t.replaced(found, lambda m: m.expand(content))
    if kind == "BertNormalizer":
        accents = spec.get("strip_accents")

        def bert(t: Aligned) -> Aligned:
            t = clean(t) if clean_text and spec.get("clean_text") else t
            if not t.text.isascii():
                t = t.each(lambda c: f" {c} " if is_cjk(c) else c) if spec.get("handle_chinese_chars") else t
                t = strip_accents(t) if accents or accents is None and spec.get("lowercase") else t
            return lower(t) if spec.get("lowercase") else t

        return bert
    return lambda t: t


def _cut_by(pattern: regex.Pattern) -> PreTokenizer:
    return lambda t: [t.cut(*m.span()) for m in pattern.finditer(t.text)]


def _before(t: Aligned, mark: str) -> list[Aligned]:
    """Cut before each mark."""
    at = [0, *(m.start() for m in regex.finditer(regex.escape(mark), t.text) if m.start()), len(t.text)]
    return [t.cut(a, b) for a, b in zip(at, at[1:], strict=False) if b > a]


def _led(t: Aligned) -> Aligned:
    """With a space before it that stands for no bytes."""
    if not t.text or t.text.startswith(" "):
        return t
    return Aligned(" " + t.text, None if t.spans is None else [(t.spans[0][0],) * 2, *t.spans])


def to_bytes(t: Aligned) -> Aligned:
    """Each byte as its letter. A character's bytes stand for one byte each if it is the original's own."""
    if t.spans is None:
        return Aligned("".join(LETTERS[b] for b in t.text.encode()))
    text, spans = [], []
    for c, (a, b) in zip(t.text, t.spans, strict=True):
        raw = c.encode()
        text += [LETTERS[x] for x in raw]
        spans += [(a + i, a + i + 1) for i in range(len(raw))] if b - a == len(raw) else [(a, b)] * len(raw)
    return Aligned("".join(text), spans)


def _byte_level(spec: dict) -> PreTokenizer:
    return lambda t: [to_bytes(w) for w in _before(_led(t) if spec.get("add_prefix_space") else t, " ")]


def _metaspace(spec: dict) -> PreTokenizer:
    mark = spec.get("replacement") or "▁"
    lead = spec.get("add_prefix_space") or spec.get("prepend_scheme") == "always"
    apart = spec.get("split") is not False

    def run(t: Aligned) -> list[Aligned]:
        t = _led(t) if lead else t
        words = _before(t, " ") if apart else [t] if t.text else []
        return [w.each(lambda c: mark if c == " " else c) for w in words]

    return run


def _split(spec: dict, strict: bool) -> PreTokenizer:
    """strict: MergedWithPrevious and MergedWithNext in one word count as `Removed`, as any unknown behavior does."""
    found, behavior = pattern_of(spec.get("pattern")), spec.get("behavior") or ""
    behavior = behavior.lower() if strict else regex.sub("(?<!^)(?=[A-Z])", "_", behavior).lower()
    if found is None:
        return lambda t: [t] if t.text else []

    def run(t: Aligned) -> list[Aligned]:
        pieces, at = [], 0
        for m in found.finditer(t.text):
            if m.end() > m.start():
                pieces += [(at, m.start(), False), (*m.span(), True)]
                at = m.end()
        pieces = [(a, b, cut != bool(spec.get("invert"))) for a, b, cut in [*pieces, (at, len(t.text), False)] if b > a]
        joins = {"contiguous": lambda x, y: x and y, "merged_with_previous": lambda x, y: y and not x, "merged_with_next": lambda x, y: x and not y}.get(behavior)
        if joins:
            merged: list[tuple[int, int, bool]] = []
            for a, b, cut in pieces:
                if merged and joins(merged[-1][2], cut):
                    merged[-1] = (merged[-1][0], b, cut)
                else:
                    merged.append((a, b, cut))
            pieces = merged
        elif behavior != "isolated":
            pieces = [p for p in pieces if not p[2]]
        return [t.cut(a, b) for a, b, _ in pieces]

    return run


def pre_tokenizer(spec: dict | None, strict: bool = False) -> PreTokenizer:
    """Unknown types, and none, cut at white space."""
    kind = (spec or {}).get("type")
    if kind == "Sequence":
        steps = [pre_tokenizer(s, strict) for s in spec.get("pretokenizers") or []]

        def sequence(t: Aligned) -> list[Aligned]:
            words = [t]
            for s in steps:
                words = [w for x in words for w in s(x)]
            return words

        return sequence
    if kind == "BertPreTokenizer":
        return _cut_by(BERT)
    if kind == "Punctuation":
        return _cut_by(PUNCTUATED)
    if kind == "ByteLevel":
        return _byte_level(spec)
    if kind == "Metaspace":
        return _metaspace(spec)
    if kind == "Split":
        return _split(spec, strict)
    return _cut_by(WORDS)
