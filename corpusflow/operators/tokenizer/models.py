"""Words to ids: WordPiece, BPE and greedy Unigram. Each gives (id, first character, end) for the pieces of a word."""

from __future__ import annotations

import heapq
from collections.abc import Callable

Piece = tuple[int, int, int]
WordModel = Callable[[str], list[Piece]]


def _longest(vocab: dict[str, int], word: str, start: int, most: int, prefix: str) -> tuple[int, int] | None:
    for end in range(min(len(word), start + most), start, -1):
        if (i := vocab.get(prefix + word[start:end])) is not None:
            return i, end
    return None


def word_piece(vocab: dict[str, int], unk: int | None, prefix: str = "##", most_bytes: int = 100) -> WordModel:
    """Longest pieces from the left; a word that is too long or has a place without a piece is `unk` as a whole, or nothing."""
    longest = max(map(len, vocab), default=0)

    def run(word: str) -> list[Piece]:
        whole = [(unk, 0, len(word))] if unk is not None else []
        if len(word.encode()) > most_bytes:
            return whole
        out, at = [], 0
        while at < len(word):
            found = _longest(vocab, word, at, longest, prefix if at else "")
            if not found:
                return whole
            out.append((found[0], at, found[1]))
            at = found[1]
        return out

    return run


#: Characters of a word beyond which pairs wait in a heap instead of being looked over at every merge.
LONG = 64


def _merged_long(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[tuple[str, int, int]]:
    """(symbol, start, end) after merging, in n log n: a pair in the heap counts only while both its symbols are as it saw them."""
    held: list[str | None] = list(symbols)
    left, right = [i - 1 for i in range(len(held))], [i + 1 for i in range(len(held))]
    waiting: list[tuple[int, int, str, str]] = []

    def meet(i: int) -> None:
        if i >= 0 and (j := right[i]) < len(held) and (rank := ranks.get((held[i], held[j]))) is not None:
            heapq.heappush(waiting, (rank, i, held[i], held[j]))

    for i in range(len(held)):
        meet(i)
    while waiting:
        _, i, a, b = heapq.heappop(waiting)
        if held[i] != a or (j := right[i]) >= len(held) or held[j] != b:
            continue
        held[i], held[j], right[i] = a + b, None, right[j]
        if right[i] < len(held):
            left[right[i]] = i
        meet(left[i])
        meet(i)
    starts = [i for i, s in enumerate(held) if s is not None]
    return [(held[a], a, b) for a, b in zip(starts, [*starts[1:], len(held)], strict=True)]


def bpe(vocab: dict[str, int], merges: list[tuple[str, str]], unk: int | None, suffix: str = "") -> WordModel:
    """Merges the pair of least rank, the leftmost on a tie, one at a time. Symbols without an id are `unk`, or nothing."""
    ranks = {pair: n for n, pair in reversed(list(enumerate(merges)))}
    never = len(ranks) + len(merges) + 1

    def run(word: str) -> list[Piece]:
        if not word:
            return []
        symbols = list(word)
        symbols[-1] += suffix
        if len(symbols) > LONG:
            return [(i, a, b) for s, a, b in _merged_long(symbols, ranks) if (i := vocab.get(s, unk)) is not None]
        ends = list(range(1, len(word) + 1))
        rank = [ranks.get(p, never) for p in zip(symbols, symbols[1:], strict=False)]
        while rank and (best := min(rank)) < never:
            i = rank.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ends[i], rank[i]
            if i < len(rank):
                rank[i] = ranks.get((symbols[i], symbols[i + 1]), never)
            if i:
                rank[i - 1] = ranks.get((symbols[i - 1], symbols[i]), never)
        return [(i, a, b) for s, a, b in zip(symbols, [0, *ends], ends, strict=False) if (i := vocab.get(s, unk)) is not None]

    return run


def unigram(vocab: dict[str, int], unk: int | None) -> WordModel:
    """Longest pieces from the left, scores aside; a character without a piece is `unk`, or nothing."""
    longest = max(map(len, vocab), default=0)

    def run(word: str) -> list[Piece]:
        out, at = [], 0
        while at < len(word):
            i, end = _longest(vocab, word, at, longest, "") or (unk, at + 1)
            if i is not None:
                out.append((i, at, end))
            at = end
        return out

    return run


def whole_words(vocab: dict[str, int], unk: int | None) -> WordModel:
    return lambda word: [(i, 0, len(word))] if (i := vocab.get(word, unk)) is not None else []
