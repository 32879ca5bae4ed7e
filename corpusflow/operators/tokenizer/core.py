"""The tokenizer itself, its options and the registry of tokenizer classes."""

from __future__ import annotations

import enum
import json
from collections.abc import Callable
from dataclasses import dataclass, field, fields

import regex

from . import models
from .decode import decoder
from .text import Aligned, normalizer, pre_tokenizer

NOWHERE = (-1, -1)


class SpecialToken(enum.Enum):
    BEGINNING_OF_SENTENCE = "beginning_of_sentence"
    END_OF_SENTENCE = "end_of_sentence"
    UNKNOWN = "unknown"
    PAD = "pad"
    MASK = "mask"
    CLASSIFICATION = "classification"

    @classmethod
    def parse(cls, name: str) -> SpecialToken:
        """By name, in any case."""
        try:
            return cls(name.strip().lower())
        except ValueError:
            raise ValueError(f"{name!r} is none of {', '.join(t.value for t in cls)}") from None


def _content(value: object) -> str:
    """Tokens in a config are strings or objects with `content`."""
    return value.get("content", "") if isinstance(value, dict) else value if isinstance(value, str) else ""


@dataclass
class TokenizerConfig:
    """What tokenizer_config.json says; unknown fields are in `extra`."""

    tokenizer_class: str = ""
    unk_token: str = ""
    pad_token: str = ""
    cls_token: str = ""
    sep_token: str = ""
    mask_token: str = ""
    bos_token: str = ""
    eos_token: str = ""
    add_bos_token: bool = False
    add_eos_token: bool = False
    extra: dict = field(default_factory=dict)

    @classmethod
    def parse(cls, content: str) -> TokenizerConfig:
        spec = json.loads(content)
        names = {f.name for f in fields(cls)} - {"extra"}
        known = {k: _content(v) if k.endswith("_token") and not k.startswith("add_") else v for k, v in spec.items() if k in names and v is not None}
        return cls(**known, extra={k: v for k, v in spec.items() if k not in names})

    @classmethod
    def load(cls, path: str) -> TokenizerConfig:
        with open(path, encoding="utf-8") as f:
            return cls.parse(f.read())


@dataclass(frozen=True)
class Options:
    """max_len cuts the ids with their special tokens; 0 is no limit. Spans and mask only where asked for."""

    add_special_tokens: bool = True
    max_len: int = 0
    include_spans: bool = False
    include_special_tokens_mask: bool = False


@dataclass
class Encoding:
    ids: list[int]
    spans: list[tuple[int, int]] | None = None
    special_tokens_mask: list[int] | None = None


#: What added special tokens are called, by role (fixed values).
ROLES = {"unk": ("[UNK]", "<unk>"), "pad": ("[PAD]", "<pad>"), "cls": ("[CLS]", "<s>"), "sep": ("[SEP]", "</s>"), "mask": ("[MASK]", "<mask>")}


class Tokenizer:
    """A tokenizer.json. strict=True keeps to lenient readings that others have: see pre_tokenizer()."""

    def __init__(self, spec: dict | str, config: TokenizerConfig | None = None, options: Options = Options(), strict: bool = False) -> None:
        self.spec = spec = json.loads(spec) if isinstance(spec, str) else spec
        self.config, self.options = config, options
        model = self.model = spec.get("model") or {}
        vocab = model.get("vocab") or {}
        self.vocab: dict[str, int] = vocab if isinstance(vocab, dict) else {token: i for i, (token, *_) in enumerate(vocab)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.special = {t["content"] for t in spec.get("added_tokens") or [] if t.get("special")}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.roles = self._roles()
        self._normalize, self._display = normalizer(spec.get("normalizer")), normalizer(spec.get("normalizer"), clean_text=True)
        self._cut = pre_tokenizer(spec.get("pre_tokenizer"), strict)
        self._words = self._word_model()
        self._decode = decoder(spec.get("decoder"), model, spec.get("pre_tokenizer"))
        longest_first = sorted(self.added, key=lambda t: -len(t.encode()))
        self._added = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None
        self._memo: dict[str, list[int]] = {}

    @classmethod
    def load(cls, path: str, config_path: str | None = None, **kwargs) -> Tokenizer:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f), TokenizerConfig.load(config_path) if config_path else None, **kwargs)

    def __reduce__(self):
        return type(self), (self.spec, self.config, self.options)

    def _word_model(self) -> models.WordModel:
        m, unk = self.model, self.roles.get("unk")
        if m.get("type") == "WordPiece":
            return models.word_piece(self.vocab, unk, m.get("continuing_subword_prefix") or "##", m.get("max_input_chars_per_word") or 100)
        if m.get("type") == "BPE":
            merges = [tuple(x.split(" ", 1)) if isinstance(x, str) else tuple(x) for x in m.get("merges") or []]
            return models.bpe(self.vocab, merges, unk, m.get("end_of_word_suffix") or "")
        if m.get("type") == "Unigram":
            return models.unigram(self.vocab, unk)
        return models.whole_words(self.vocab, unk)

    def _roles(self) -> dict[str, int]:
        """Ids of unk, pad, cls, sep, mask, bos, eos: from the model, then from special added tokens, then from the config's names."""
        found: dict[str, int] = {}
        if (unk := self.model.get("unk_token")) in self.vocab:
            found["unk"] = self.vocab[unk]
        elif isinstance(self.model.get("unk_id"), int):
            found["unk"] = self.model["unk_id"]
        for token in (t for t in self.spec.get("added_tokens") or [] if t.get("special")):
            for role, names in ROLES.items():
                if token["content"] in names:
                    found[role] = token["id"]
            for role in ("bos", "eos"):
                if self.config and token["content"] == getattr(self.config, f"{role}_token"):
                    found[role] = token["id"]
        for role in (*ROLES, "bos", "eos"):
            name = getattr(self.config, f"{role}_token", "") if self.config else ""
            if role not in found and name in self.vocab:
                found[role] = self.vocab[name]
        return found

    def with_options(self, options: Options) -> Tokenizer:
        return type(self)(self.spec, self.config, options)

    def normalize(self, text: str) -> str:
        return self._display(Aligned(text)).text

    def _segments(self, text: str) -> list[tuple[str, int, int | None]]:
        """(text, first character, id of an added token)."""
        out, at = [], 0
        for m in self._added.finditer(text) if self._added else ():
            out += [(text[at : m.start()], at, None), (m[0], m.start(), self.added[m[0]])]
            at = m.end()
        return [x for x in [*out, (text[at:], at, None)] if x[0]]

    def word_ids(self, word: str) -> list[int]:
        if (known := self._memo.get(word)) is None:
            known = [self.added[word]] if word in self.added else [i for i, _, _ in self._words(word)]
            if len(self._memo) > 200_000:
                self._memo = {}
            self._memo[word] = known
        return known

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for segment, _, added in self._segments(text):
            if added is not None:
                ids.append(added)
                continue
            for word in self._cut(self._normalize(Aligned(segment))):
                ids += self.word_ids(word.text)
        if self.options.add_special_tokens:
            ids = self.post_process(ids, None)[0]
        return ids[: self.options.max_len] if self.options.max_len else ids

    def annotate(self, text: str) -> Encoding:
        """Ids with the bytes of the text that each stands for; added ones are nowhere, (-1, -1)."""
        ids, spans = [], []
        for segment, first, added in self._segments(text):
            start = len(text[:first].encode())
            if added is not None:
                ids.append(added)
                spans.append((start, start + len(segment.encode())))
                continue
            for word in self._cut(self._normalize(Aligned.of(segment, start))):
                pieces = [(self.added[word.text], 0, len(word.text))] if word.text in self.added else self._words(word.text)
                ids += [i for i, _, _ in pieces]
                spans += [word.span(a, b) for _, a, b in pieces]
        mask = [0] * len(ids)
        if self.options.add_special_tokens:
            ids, spans, mask = self.post_process(ids, spans)
        cut = slice(self.options.max_len or None)
        return Encoding(ids[cut], spans[cut] if self.options.include_spans else None, mask[cut] if self.options.include_special_tokens_mask else None)

    def post_process(self, ids: list[int], spans: list | None) -> tuple[list[int], list, list[int]]:
        """Special tokens around the ids, as the post-processor and then the config have it."""
        spec, body = self.spec.get("post_processor") or {}, (ids, spans if spans is not None else [NOWHERE] * len(ids), [0] * len(ids))
        put = lambda some: (list(some), [NOWHERE] * len(some), [1] * len(some))
        parts = [body]
        if spec.get("type") == "TemplateProcessing" and spec.get("single"):
            known = spec.get("special_tokens") or {}
            parts = [put(known.get(x["SpecialToken"]["id"], {}).get("ids") or []) if "SpecialToken" in x else body for x in spec["single"]]
        elif spec.get("type") in ("BertProcessing", "RobertaProcessing"):
            ends = [put([x[1]] if isinstance(x := spec.get(k), list) and len(x) > 1 and isinstance(x[1], int) else []) for k in ("cls", "sep")]
            parts = [ends[0], body, ends[1]]
        out = [[y for p in parts for y in p[i]] for i in range(3)]
        bos, eos = self.roles.get("bos"), self.roles.get("eos")
        if self.config and self.config.add_bos_token and bos is not None and out[0][:1] != [bos]:
            out = [a + b for a, b in zip(put([bos]), out, strict=True)]
        if self.config and self.config.add_eos_token and eos is not None and out[0][-1:] != [eos]:
            out = [b + a for a, b in zip(put([eos]), out, strict=True)]
        return out[0], out[1], out[2]

    def decode(self, ids: list[int]) -> str:
        """Ids without a token are left out; special tokens stay."""
        return self._decode([self.tokens[i] for i in ids if i in self.tokens])

    def special_token_id(self, token: SpecialToken) -> int:
        roles = {
            SpecialToken.UNKNOWN: ("unk",), SpecialToken.PAD: ("pad",), SpecialToken.MASK: ("mask",), SpecialToken.CLASSIFICATION: ("cls",),
            SpecialToken.BEGINNING_OF_SENTENCE: ("bos", "cls"), SpecialToken.END_OF_SENTENCE: ("eos", "sep"),
        }[token]
        for role in roles:
            if role in self.roles:
                return self.roles[role]
        raise KeyError(f"the tokenizer has no {token.value} token")

    @property
    def vocab_size(self) -> int:
        """Tokens of the model and added ones, those in both counted twice."""
        return len(self.vocab) + len(self.added)

    @property
    def distinct_tokens(self) -> int:
        return len(self.vocab.keys() | self.added.keys())

    def token_to_id(self, token: str) -> int | None:
        return self.added.get(token, self.vocab.get(token))

    def id_to_token(self, i: int) -> str | None:
        return self.tokens.get(i)

    def added_tokens(self) -> list[tuple[int, str]]:
        """By id."""
        return sorted((i, t) for t, i in self.added.items())

    @property
    def type(self) -> str:
        return self.model.get("type") or ""


class SentencePiece:
    """A SentencePiece model, with spans found by looking for each piece after the one before. Needs the sentencepiece library."""

    def __init__(self, path: str, config: TokenizerConfig | None = None, options: Options = Options()) -> None:
        import sentencepiece

        if options.max_len or options.include_special_tokens_mask:
            raise ValueError("SentencePiece tokenizers have neither max_len nor a mask of special tokens")
        self.path, self.config, self.options = path, config, options
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)

    def __reduce__(self):
        return type(self), (self.path, self.config, self.options)

    def with_options(self, options: Options) -> SentencePiece:
        return type(self)(self.path, self.config, options)

    def normalize(self, text: str) -> str:
        return text

    def _post(self, ids: list[int], spans: list) -> tuple[list[int], list]:
        if self.options.add_special_tokens and self.config:
            bos, eos = self.processor.bos_id(), self.processor.eos_id()
            if self.config.add_bos_token and bos >= 0 and ids[:1] != [bos]:
                ids, spans = [bos, *ids], [NOWHERE, *spans]
            if self.config.add_eos_token and eos >= 0 and ids[-1:] != [eos]:
                ids, spans = [*ids, eos], [*spans, NOWHERE]
        return ids, spans

    def encode(self, text: str) -> list[int]:
        ids = self.processor.encode(text)
        return self._post(ids, [NOWHERE] * len(ids))[0]

    def annotate(self, text: str) -> Encoding:
        ids, raw, at, spans = self.processor.encode(text), text.encode(), 0, []
        for i in ids:
            piece = self.processor.id_to_piece(i).replace("▁", " ").encode()
            found = next((x for p in (piece, piece.strip()) if p and (x := raw.find(p, at)) >= 0), None)
            size = len(piece if found is not None and raw.startswith(piece, found) else piece.strip())
            spans.append((found, found + size) if found is not None else (at, at))
            at = found + size if found is not None else at
        ids, spans = self._post(ids, spans)
        return Encoding(ids, spans if self.options.include_spans else None)

    def decode(self, ids: list[int]) -> str:
        return self.processor.decode(ids)

    def special_token_id(self, token: SpecialToken) -> int:
        at = {SpecialToken.UNKNOWN: "unk_id", SpecialToken.PAD: "pad_id", SpecialToken.BEGINNING_OF_SENTENCE: "bos_id", SpecialToken.END_OF_SENTENCE: "eos_id"}
        found = getattr(self.processor, at[token])() if token in at else -1
        if found < 0:
            raise KeyError(f"the tokenizer has no {token.value} token")
        return found

    @property
    def vocab_size(self) -> int:
        return self.processor.vocab_size()


_CLASSES: dict[str, Callable] = {}


def register(name: str, make: Callable[[str, TokenizerConfig | None], object]) -> None:
    """make(folder, config) builds tokenizers of this class."""
    _CLASSES[name] = make


def tokenizer_for(folder: str) -> object:
    """Of a local folder: by the class its config names, else from its tokenizer.json, else from its SentencePiece model."""
    import os

    at = lambda name: p if os.path.exists(p := os.path.join(folder, name)) else None
    config = TokenizerConfig.load(p) if (p := at("tokenizer_config.json")) else None
    if config and config.tokenizer_class in _CLASSES:
        return _CLASSES[config.tokenizer_class](folder, config)
    if path := at("tokenizer.json"):
        return Tokenizer.load(path, at("tokenizer_config.json"))
    if path := at("tokenizer.model"):
        return SentencePiece(path, config)
    raise ValueError(f"{folder}: no known tokenizer class, tokenizer.json or tokenizer.model")
