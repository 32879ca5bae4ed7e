"""Tokens to text."""

from __future__ import annotations

from collections.abc import Callable

import regex

from .text import BYTES

Step = Callable[[list[str]], list[str]]
Decoder = Callable[[list[str]], str]


def spaced(prefix: str) -> Decoder:
    """Words with spaces between; a token that starts with the prefix continues the word before."""
    return lambda tokens: "".join(t[len(prefix) :] if t.startswith(prefix) else f" {t}" if i else t for i, t in enumerate(tokens))


def byte_level(tokens: list[str]) -> str:
    """Letters back to bytes; other characters are their own UTF-8."""
    return b"".join(bytes([BYTES[c]]) if c in BYTES else c.encode() for t in tokens for c in t).decode("utf-8", "replace")


def _metaspace(spec: dict, lead: bool) -> Step:
    mark = spec.get("replacement") or "▁"

    def run(tokens: list[str]) -> list[str]:
        out = [t.replace(mark, " ") for t in tokens]
        return [t.removeprefix(" ") if i == 0 and lead else t for i, t in enumerate(out)]

    return run


def _step(spec: dict) -> Step:
    kind = spec.get("type")
    if kind == "Replace":
        pattern, content = spec.get("pattern") or {}, spec.get("content") or ""
        if pattern.get("String"):
            return lambda tokens: [t.replace(pattern["String"], content) for t in tokens]
        if pattern.get("Regex"):
            found, to = regex.compile(pattern["Regex"]), regex.sub(r"\$(\d+)", r"\\g<\1>", content.replace("\\", "\\\\"))
            return lambda tokens: [found.sub(to, t) for t in tokens]
    if kind == "Strip":
        chars = spec.get("content") or " \t\n\r"
        return lambda tokens: [t.strip(chars) for t in tokens]
    if kind == "ByteFallback":
        # Bytes are kept as lone surrogates until all tokens are joined.
        found = regex.compile(r"<0x([0-9A-Fa-f]{2})>")
        return lambda tokens: [bytes([int(m[1], 16)]).decode("utf-8", "surrogateescape") if (m := found.fullmatch(t)) else t for t in tokens]
    if kind == "Metaspace":
        return _metaspace(spec, spec.get("prepend_scheme") == "always")
    return lambda tokens: tokens


def decoder(spec: dict | None, model: dict, pre: dict | None) -> Decoder:
    """An invalid pattern is an error here, not when decoding."""
    kind = (spec or {}).get("type")
    if kind == "WordPiece":
        return spaced(spec.get("prefix") or "##")
    if kind == "ByteLevel":
        return byte_level
    if kind == "Metaspace":
        pre = pre or {}
        run = _metaspace(spec, "always" in (spec.get("prepend_scheme"), pre.get("prepend_scheme")) or bool(pre.get("add_prefix_space")))
        return lambda tokens: "".join(run(tokens))
    if kind == "BPEDecoder":
        suffix = model.get("end_of_word_suffix") or ""
        end = lambda t, last: t if not suffix or not t.endswith(suffix) else t.removesuffix(suffix) + ("" if last else " ")
        return lambda tokens: "".join(end(t, i == len(tokens) - 1) for i, t in enumerate(tokens))
    if kind == "Sequence":
        steps = [_step(s) for s in spec.get("decoders") or []]

        def run_all(tokens: list[str]) -> str:
            for s in steps:
                tokens = s(tokens)
            return "".join(tokens).encode("utf-8", "surrogateescape").decode("utf-8", "replace")

        return run_all
    return spaced(model.get("continuing_subword_prefix") or "##")
