"""Exact byte-pair encoding by dynamic programming over prefixes.

For a rank-ordered byte-pair vocabulary the encoding of a string is unique, and
so is the last token of the encoding of each of its prefixes. A table of these
last tokens therefore stores the encodings of all prefixes at once: the entry of
a prefix is the one vocabulary token that ends there and may follow the entry of
the prefix before it. Appending bytes only appends entries, and an edit keeps
all entries in front of it.
"""

from __future__ import annotations

import base64
import re
from itertools import chain

import numpy as np
import regex

#: The split pattern published with the rank files, and the
#: characters with the Unicode property White_Space.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = r"\t-\r \x85\xa0  -     　"

#: Runs of non-white characters with one blank in front, and white runs. Each cut
#: of this pattern is a cut of SPLIT too, so the parts can be split one by one.
COARSE = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file of base64 tokens and numbers."""
    out = {}
    with open(path, "rb") as f:
        for line in f:
            token, _, rank = line.strip().partition(b" ")
            if rank:
                out[base64.b64decode(token)] = int(rank)
    return out


class PrefixEncoder:
    """Encodes by the table of last tokens; memories are bounded by `keep` entries."""

    def __init__(self, ranks: dict[bytes, int], keep: int = 400_000):
        self.ranks = ranks
        self.text = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.keep = keep
        self._follows: dict[tuple[int, int], bool] = {}
        self._whole: dict[bytes, bool] = {}
        self._split = regex.compile(SPLIT)
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._parts: dict[str, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> list[int]:
        """The definition: join the neighbours of lowest rank until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def stands(self, token: bytes) -> bool:
        """Whether the token is its own encoding."""
        got = self._whole.get(token)
        if got is None:
            got = self._whole[token] = len(self.merge(token)) == 1
        return got

    def follows(self, a: int, b: int) -> bool:
        """Whether the tokens a, b stay apart when their bytes are encoded together."""
        got = self._follows.get((a, b))
        if got is None:
            if len(self._follows) >= self.keep:
                self._follows.clear()
            got = self._follows[(a, b)] = self.merge(self.text[a] + self.text[b]) == [a, b]
        return got

    def extend(self, last: list[int], data: bytes, upto: int | None = None) -> list[int]:
        """Add the entries of data[len(last):upto] to the table of its prefix, in place."""
        for end in range(len(last) + 1, (len(data) if upto is None else upto) + 1):
            for start in range(max(0, end - self.longest), end):
                token = self.ranks.get(data[start:end])
                if token is None or not self.stands(data[start:end]):
                    continue
                if start == 0 or self.follows(last[start - 1], token):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")
        return last

    def edit(self, last: list[int], data: bytes, at: int, removed: int | None = None) -> list[int]:
        """The table of `data`: the old string with `removed` bytes from `at` on (else all of them) replaced by others.

        An entry depends on the bytes and entries of the longest token before it: where so
        many entries behind the edit are the old ones again, so are all that follow.
        """
        shift = len(data) - len(last)
        tail = len(data) if removed is None else at + removed + shift
        table, same = last[:at], 0
        while len(table) < len(data):
            end = len(table) + 1
            self.extend(table, data, end)
            same = same + 1 if end > tail and table[-1] == last[end - 1 - shift] else 0
            if same >= self.longest:
                return table + last[end - shift :]
        return table

    def tokens(self, last: list[int]) -> list[int]:
        """Read the encoding back from the end of a table."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.text[last[end - 1]])
        return out[::-1]

    def piece(self, s: str) -> tuple[int, ...]:
        got = self._pieces.get(s)
        if got is None:
            data = s.encode("utf-8", "replace")
            whole = self.ranks.get(data)
            got = (whole,) if whole is not None and self.stands(data) else tuple(self.tokens(self.extend([], data)))
            if len(s) <= 24:
                if len(self._pieces) >= self.keep:
                    self._pieces.clear()
                self._pieces[s] = got
        return got

    def part(self, s: str) -> tuple[int, ...]:
        got = tuple(chain.from_iterable(map(self.piece, self._split.findall(s))))
        if len(s) <= 24:
            if len(self._parts) >= self.keep:
                self._parts.clear()
            self._parts[s] = got
        return got

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text; null and empty texts give no ids."""
        if not text:
            return np.zeros(0, np.int32)
        known, part = self._parts.get, self.part
        return np.fromiter(chain.from_iterable([known(p) or part(p) for p in COARSE.findall(text)]), np.int32)
