"""Byte-pair merging with a heap over a linked list, vocabulary files, and splitting into pre-tokens."""

from __future__ import annotations

import base64
import functools
import json
import unicodedata
from collections.abc import Callable
from heapq import heapify, heappop, heappush

import public_tokenizers
import regex

#: Memos are emptied beyond this number of entries, so a worker's memory stays bounded.
MEMO_ENTRIES = 700_000
#: Longer pre-tokens are never kept in a memo.
MEMO_LENGTH = 64

split_pattern = regex.compile(public_tokenizers.PATTERN)


class Memo(dict):
    """``memo[x]`` is ``make(x)``, kept for short keys only."""

    def __init__(self, make: Callable, most: int = MEMO_ENTRIES):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= MEMO_LENGTH:
            self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()


@functools.cache
def stand_in(c: str) -> str:
    """For a code point that this Python leaves unassigned: a letter, digit or symbol, as the tokenizer library's newer tables class it."""
    from tokenizers import Regex, pre_tokenizers

    cut = pre_tokenizers.Split(Regex(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"), "isolated")
    return next((alike for alike in "\u0416\u00b2" if len(cut.pre_tokenize_str(alike + c)) == 1), "\u00a4")


class Splitter:
    """``pattern.findall`` by the tokenizer libraries' Unicode age, whatever that of the regex module is."""

    def __init__(self, pattern: regex.Pattern):
        self.pattern = pattern
        self.known: set[str] = set()

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or self.known.issuperset(text):
            return self.pattern.findall(text)
        fresh = {c for c in text if c not in self.known}
        strange = {c for c in fresh if unicodedata.category(c) == "Cn"}
        self.known |= fresh - strange
        if not strange:
            return self.pattern.findall(text)
        shadow = text.translate({ord(c): stand_in(c) for c in strange})
        return [text[m.start() : m.end()] for m in self.pattern.finditer(shadow)]


@functools.cache
def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others, in order, for U+0100 on."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in kept else next(others)) for b in range(256)]


class PairRanks:
    """Merge rules of a tokenizer file: ``pairs[left << 20 | right]`` is the rank, ``made[rank]`` the new symbol."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        vocab = model["vocab"]
        self.pairs: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (left, right) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.pairs[vocab[left] << 20 | vocab[right]] = rank
            self.made.append(vocab[left + right])
        self.first = [vocab[c] for c in byte_letters()]
        self.special = [t["content"] for t in data["added_tokens"] if t["special"]]

    def merges(self, token: bytes) -> int:
        """How many merges the pre-token takes: the adjacent pair of lowest rank goes first, the leftmost on ties."""
        ids = [self.first[b] for b in token]
        n, done = len(ids), 0
        rank_of, made = self.pairs.get, self.made
        heap = [r << 32 | i for i in range(n - 1) if (r := rank_of(ids[i] << 20 | ids[i + 1])) is not None]
        if not heap:
            return 0
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            rank, i = top >> 32, top & 0xFFFFFFFF
            left, j = ids[i], after[i]
            if left < 0 or j >= n or rank_of(left << 20 | ids[j]) != rank:
                continue  # one side has changed since the pair was pushed
            ids[i], ids[j] = made[rank], -1
            done += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(ids[i] << 20 | ids[k])) is not None:
                    heappush(heap, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank_of(ids[h] << 20 | ids[i])) is not None:
                heappush(heap, r << 32 | h)
        return done


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def heap_encode(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece that is no token itself: the lowest-ranked concatenation of two neighbours is joined first."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a part runs from its start to end[start], where the next begins
    rank_of = ranks.get
    heap = [r << 32 | i for i in range(n - 1) if (r := rank_of(piece[i : i + 2])) is not None]
    heapify(heap)
    alive = bytearray(b"\1" * n)
    while heap:
        top = heappop(heap)
        rank, i = top >> 32, top & 0xFFFFFFFF
        j = end[i]
        if not alive[i] or j >= n or rank_of(piece[i : end[j]]) != rank:
            continue
        alive[j] = 0
        k = end[i] = end[j]
        if k < n:
            before[k] = i
            if (r := rank_of(piece[i : end[k]])) is not None:
                heappush(heap, r << 32 | i)
        if (h := before[i]) >= 0 and (r := rank_of(piece[h:k])) is not None:
            heappush(heap, r << 32 | h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def splitter(special: list[str]) -> Callable[[str], list[str]]:
    """Cuts a text at special strings; these stand at the odd places."""
    if not special:
        return lambda text: [text]
    pattern = regex.compile("(" + "|".join(map(regex.escape, special)) + ")")
    marks = tuple(special)
    return lambda text: pattern.split(text) if any(m in text for m in marks) else [text]
