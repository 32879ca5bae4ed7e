"""Small deterministic inputs of the queries: vocabularies by rule, tensors from row numbers."""

from __future__ import annotations

ALPHABET = "abcdefghijklmnopqrstuvwxyz"
#: Frequent words and syllables of the documents; with single letters they make a closed vocabulary (fixed values).
PIECES = ["the", "of", "and", "in", "to", "on", "is", "er", "re", "th", "an", "en", "st", "ing", "tion", "de", "la", "le", "que", "der", "die", "und", "ch", "es", "os"]


def vocabulary(continuing: str = "", letters: str = ALPHABET) -> dict[str, int]:
    """[UNK], pieces and letters, then the same continued where a prefix is given."""
    words = ["[UNK]", *dict.fromkeys([*PIECES, *letters])]
    return {w: i for i, w in enumerate([*words, *(continuing + w for w in words[1:] if continuing)])}


def word_piece_spec() -> dict:
    return {
        "added_tokens": [], "normalizer": {"type": "Lowercase"}, "pre_tokenizer": {"type": "BertPreTokenizer"}, "decoder": {"type": "WordPiece", "prefix": "##"},
        "model": {"type": "WordPiece", "unk_token": "[UNK]", "continuing_subword_prefix": "##", "max_input_chars_per_word": 100, "vocab": vocabulary("##")},
    }


def unigram_spec() -> dict:
    return {
        "added_tokens": [], "normalizer": {"type": "Lowercase"}, "pre_tokenizer": {"type": "Whitespace"}, "decoder": None,
        "model": {"type": "Unigram", "unk_id": 0, "vocab": [[w, 0.0] for w in vocabulary()]},
    }


#: Merges in order of rank: every piece is built up from the left (by rule).
def merges() -> list[str]:
    return list(dict.fromkeys(f"{p[:i]} {p[i]}" for p in PIECES for i in range(1, len(p))))


def bpe_spec() -> dict:
    words = dict.fromkeys([*vocabulary(), *(m.replace(" ", "") for m in merges())])
    return {
        "added_tokens": [], "normalizer": {"type": "Lowercase"}, "pre_tokenizer": {"type": "Whitespace"}, "decoder": None,
        "model": {"type": "BPE", "unk_token": "[UNK]", "vocab": {w: i for i, w in enumerate(words)}, "merges": merges()},
    }


def byte_level_spec() -> dict:
    """Every byte a token, and merges of the ASCII pieces."""
    letters = [chr(b) for b in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]]
    letters += [chr(0x100 + i) for i in range(256 - len(letters))]
    words = dict.fromkeys([*letters, *(m.replace(" ", "") for m in merges())])
    return {"added_tokens": [], "pre_tokenizer": {"type": "ByteLevel"}, "decoder": {"type": "ByteLevel"}, "model": {"type": "BPE", "vocab": {w: i for i, w in enumerate(words)}, "merges": merges()}}


def characters() -> list[str]:
    """Every printable character of Latin-1 and a few beyond."""
    return [chr(c) for c in [*range(0x21, 0x7F), *range(0xA1, 0x180), *range(0x2010, 0x2040), 0x20AC]]


#: Steps of a decoder that undoes the marks of spaces and tells itself by an E.
STEPS = {"type": "Sequence", "decoders": [{"type": "Replace", "pattern": {"String": "\u2581"}, "content": " "}, {"type": "Replace", "pattern": {"Regex": "e"}, "content": "E"}]}


def metaspace_spec(decoder: dict | None = None) -> dict:
    """Unigram over single characters, white space among them, with marks for spaces."""
    mark = {"type": "Metaspace", "replacement": "\u2581", "prepend_scheme": "always"}
    pieces = ["<unk>", "\u2581", *(chr(c) for c in range(9, 14)), *characters()]
    return {"added_tokens": [], "pre_tokenizer": mark, "decoder": decoder or mark, "model": {"type": "Unigram", "unk_id": 0, "vocab": [[w, 0.0] for w in pieces]}}


def suffix_spec() -> dict:
    """BPE without merges, each character with and without a mark of the word's end."""
    words = ["<unk>", *characters(), *(c + "</w>" for c in characters())]
    model = {"type": "BPE", "unk_token": "<unk>", "end_of_word_suffix": "</w>", "vocab": {w: i for i, w in enumerate(words)}, "merges": []}
    return {"added_tokens": [], "pre_tokenizer": {"type": "Whitespace"}, "decoder": {"type": "BPEDecoder"}, "model": model}


def character_spec() -> dict:
    """WordPiece with characters() as pieces, first and continuing."""
    chars = characters()
    return {
        "added_tokens": [], "pre_tokenizer": {"type": "Whitespace"}, "decoder": {"type": "WordPiece", "prefix": "##"},
        "model": {"type": "WordPiece", "unk_token": "[UNK]", "max_input_chars_per_word": 10_000, "vocab": {w: i for i, w in enumerate(["[UNK]", *chars, *("##" + c for c in chars)])}},
    }


#: Text prompts by task (fixed values).
PROMPTS = {"query": "query: ", "document": "passage: ", "summary": "Summarize: "}
