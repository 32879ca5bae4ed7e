"""Byte-level BPE by speculation and verification, and its inverse.

A word's bytes are first cut greedily into the longest tokens of the vocabulary. Such a cut is what merging gives exactly if
each token and each adjacent pair of tokens is what merging gives for its own bytes; these verdicts are looked up for all
words of a batch at once. Only words with a refused pair are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, over_arrow, ranges, with_columns_of

#: The byte-level split of words that the vocabulary was made for (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts within Latin-1, whose letters, numbers and white space can be told one by one; Python's own engine is faster.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\\t-\\r \x85\xa0"
LATIN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Distinct words that a worker remembers; texts of more characters are matched piece by piece, so many words at a time.
MEMO, BLOCK, PIECE = 300_000, 1 << 20, 1 << 17
NONE = np.iinfo(np.int64).max
#: Words of up to so many bytes are merged by scanning; the rank of a pair that doesn't merge.
SHORT, WORST = 48, (1 << 60, -1)


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte: itself where printable, else the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE tokenizer.json: tokens as bytes, ranks of merges, special tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        step, model, letters = spec["pre_tokenizer"], spec["model"], byte_letters()
        if model["type"] != "BPE" or step["type"] != "ByteLevel" or step["add_prefix_space"] or spec["normalizer"] or spec["post_processor"]:
            raise ValueError(f"{path}: not a plain byte-level BPE")
        # What would give other ids than plain merging is refused, not ignored.
        odd = [k for k in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        odd += [f"{k} of {t['content']}" for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip") if t.get(k)]
        if odd or step.get("use_regex") is False:
            raise ValueError(f"{path}: {', '.join(odd) or 'no splitting'} isn't supported")
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(s): i for s, i in model["vocab"].items()}
        self.size = 1 + max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        of = [b""] * self.size
        for b, i in self.ids.items():
            of[i] = b
        for s, i in self.special.items():
            of[i] = s.encode()
        self.bytes = of
        self.ends = np.cumsum([0, *map(len, of)])
        self.flat = np.frombuffer(b"".join(of), np.uint8)
        self.longest = max(map(len, self.ids))
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = (raw(x) for x in (m.split(" ") if isinstance(m, str) else m))
            self.ranks[self.ids[a], self.ids[b]] = rank, self.ids[a + b]
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """Exactly: the pair of least rank first, the leftmost on a tie, one occurrence at a time."""
        ids, n = [self.single[b] for b in word], len(word)
        return self._merge_few(ids) if n <= SHORT else self._merge_many(ids, n)

    def _merge_few(self, ids: list[int]) -> list[int]:
        get = self.ranks.get
        found = [get(p, WORST) for p in zip(ids, ids[1:], strict=False)]
        while found and (best := min(found)) is not WORST:
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
            del found[i]
            if i < len(found):
                found[i] = get((ids[i], ids[i + 1]), WORST)
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]), WORST)
        return ids

    def _merge_many(self, ids: list[int], n: int) -> list[int]:
        """By a heap, so n log n."""
        after, before, get = [*range(1, n), -1], [*range(-1, n - 1)], self.ranks.get
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if (k := after[j]) >= 0:
                before[k] = i
                if r := get((new, ids[k])):
                    heapq.heappush(heap, (r[0], i, new, ids[k], r[1]))
            if (p := before[i]) >= 0 and (r := get((ids[p], new))):
                heapq.heappush(heap, (r[0], p, ids[p], new, r[1]))
        return [x for x in ids if x >= 0]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match; every byte is a token, so it always ends."""
        out, at, n, ids, most = [], 0, len(word), self.ids, self.longest
        while at < n:
            end = min(n, at + most)
            while (t := ids.get(word[at:end])) is None:
                end -= 1
            out.append(t)
            at = end
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Ids outside of the vocabulary give nothing."""
        ids = ids[(ids >= 0) & (ids < self.size)]
        return self.flat[ranges(self.ends[ids], self.ends[ids + 1] - self.ends[ids])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


class Verdicts:
    """Which pairs (and single tokens, as pairs with `size`) merging leaves as they are; each is worked out once."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.codes, self.good = np.array([NONE]), np.array([False])

    def look(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.codes, codes)
        if len(new := np.unique(codes[self.codes[at] != codes])):
            good = np.fromiter(map(self.work_out, new.tolist()), bool, len(new))
            merged = np.concatenate([self.codes, new])
            order = np.argsort(merged, kind="stable")
            self.codes, self.good = merged[order], np.concatenate([self.good, good])[order]
            at = np.searchsorted(self.codes, codes)
        return self.good[at]

    def work_out(self, code: int) -> bool:
        a, b = divmod(code, self.v.size + 1)
        parts = [a] if b == self.v.size else [a, b]
        return self.v.merge(b"".join(self.v.bytes[i] for i in parts)) == parts


class SpeculativeWords:
    """Encodes distinct words; `failed` counts those that had to be merged exactly."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v, self.verdicts, self.words, self.failed = vocabulary, Verdicts(vocabulary), 0, 0

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one word after the other, and each word's number of ids."""
        if len(self.verdicts.codes) > 4 * MEMO:
            self.verdicts = Verdicts(self.v)
        raw = [w.encode() for w in words]
        cuts = [self.v.propose(w) for w in raw]
        lengths = np.fromiter(map(len, cuts), np.int64, len(cuts))
        flat = np.fromiter((t for c in cuts for t in c), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(cuts)), lengths)
        base, inner = self.v.size + 1, owner[1:] == owner[:-1]
        codes = np.concatenate([flat * base + self.v.size, (flat[:-1] * base + flat[1:])[inner]])
        good = self.verdicts.look(codes)
        bad = np.unique(np.concatenate([owner, owner[1:][inner]])[~good])
        self.words, self.failed = self.words + len(words), self.failed + len(bad)
        if len(bad):
            for i in bad.tolist():
                cuts[i] = self.v.merge(raw[i])
            lengths = np.fromiter(map(len, cuts), np.int64, len(cuts))
            flat = np.fromiter((t for c in cuts for t in c), np.int64, int(lengths.sum()))
        return flat.astype(np.uint32), lengths


class Memo(dict):
    """Numbers words as they come; new ones wait in `pending`."""

    def __init__(self) -> None:
        self.pending: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.pending.append(word)
        return n


class TextEncoder:
    """Texts to ids: cut at special tokens, match words, look words up; `words` encodes those not yet known."""

    def __init__(self, vocabulary: Vocabulary, words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], memo: int = MEMO) -> None:
        self.v, self.words, self.most, self.any, self.latin = vocabulary, words, memo, regex.compile(PATTERN), re.compile(LATIN)
        self.forget()

    def forget(self) -> None:
        self.memo, self.flat, self.starts, self.lengths = Memo(), np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def pieces(self, text: str) -> Iterator[list[str] | int]:
        """Lists of words, and ids of special tokens."""
        at, segments = 0, []
        try:
            text.encode("latin-1")
            pattern = self.latin
        except UnicodeEncodeError:
            pattern = self.any
        for m in self.v.cut.finditer(text) if self.v.cut else ():
            segments += [text[at : m.start()], self.v.special[m[0]]]
            at = m.end()
        for x in [*segments, text[at:] if at else text]:
            if isinstance(x, int):
                yield x
            elif len(x) <= BLOCK:
                yield pattern.findall(x)
            else:
                found = pattern.finditer(x)
                while some := [m[0] for m in islice(found, PIECE)]:
                    yield some

    def number(self, text: str) -> list[np.ndarray | int]:
        get = self.memo.__getitem__
        return [x if isinstance(x, int) else np.fromiter(map(get, x), np.int64, len(x)) for x in self.pieces(text)]

    def learn(self) -> None:
        if self.memo.pending:
            flat, lengths = self.words(self.memo.pending)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.flat, self.lengths = np.concatenate([self.flat, flat]), np.concatenate([self.lengths, lengths])
            self.memo.pending = []

    def gather(self, numbered: list[np.ndarray | int]) -> np.ndarray:
        out = [np.array([x], np.uint32) if isinstance(x, int) else self.flat[ranges(self.starts[x], self.lengths[x])] for x in numbered]
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, np.uint32)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out = []
        while len(out) < len(texts):
            group, size = [], 0
            while len(out) + len(group) < len(texts) and (not group or size < BLOCK):  # so that a memo holds bounded texts
                text = texts[len(out) + len(group)] or ""
                size += len(text)
                group.append(self.number(text))
            self.learn()
            out += [self.gather(x) for x in group]
            if len(self.memo) > self.most:
                self.forget()
        return out


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(2)
def speculative(path: str) -> TextEncoder:
    """One a worker and path: its memory of words serves all tasks of that worker."""
    return TextEncoder(vocabulary(path), SpeculativeWords(vocabulary(path)))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): a row for each row of docs; ids is array<int>.

    ids are those of whole texts, special tokens' strings as their ids; decoded_sha256 is of what the ids decode to, in
    UTF-8. Null and empty texts have no ids and decode to the empty text. Repeated rows and null doc_ids are rows like any
    other. Other columns are ignored. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    rows = with_columns_of(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, v = speculative(path), vocabulary(path)
        for b in batches:
            found = encoder.encode(b.column(1).to_pylist())
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.concatenate(found) if found else np.empty(0, np.uint32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
            sums = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found]
            texts = [hashlib.sha256(v.decode(x.astype(np.int64)).encode()).hexdigest() for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths), lists, pa.array(sums, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    return over_arrow(rows, run, "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): null ids give a null text, ids outside of the vocabulary nothing."""
    bounded_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            texts = [None if x is None else v.decode(np.array([-1 if i is None else i for i in x], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = with_columns_of(encoded, ["doc_id", "ids"]).select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"))
    return over_arrow(rows, run, "doc_id long, text string")
