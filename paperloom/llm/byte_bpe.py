"""Byte-level BPE as a finite-state transducer, for a public tokenizer's vocabulary.

The merges become a trie of the tokens' bytes and a test whether two tokens may
stand side by side (no merge across their border has priority). Reading a piece
byte by byte, the transducer keeps the last token of the encoding of every
prefix that a longer token could still reach back to. That window is its state:
it is at most one token long, and where all readings agree on the tokens before
it, these are written out. States and transitions are made when they are first
met and kept, so known stretches cost one look-up a byte. The encoding of a
piece equals that of applying its merges in order of rank.
"""

from __future__ import annotations

import base64
from pathlib import Path

import regex

#: Places where the vocabulary files may be; a path can also be given.
DEFAULT_FOLDER = "/opt/tokenizers"
#: Fixed value: how text is cut to pieces before it is encoded, as the public vocabulary defines it.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_MAX_STATES = 200_000
_MAX_PIECES = 300_000


def read_ranks(path: str | Path) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    ranks = {}
    for line in Path(path).read_bytes().splitlines():
        if line.strip():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


class _NotLearned(Exception):
    """The vocabulary is none that merging gives."""


class Transducer:
    """Encodes bytes; decodes ids. Holds what it has determined so far."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PIECES):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.cut = regex.compile(pattern).findall
        self.open = {t[:n] for t in ranks for n in range(1, len(t))}  # what a longer token may begin with
        self.made_of: dict[int, tuple[int, int] | None] = {}
        self.borders: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.reset()

    def reset(self) -> None:
        """Forget the states determined so far."""
        # A state: the token before the window, the window's bytes, and the last token after each of them.
        self.states: list[tuple[int | None, bytes, tuple[int, ...]]] = [(None, b"", ())]
        self.number = {self.states[0]: 0}
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self.ends: list[tuple[int, ...]] = [()]

    # the merges ------------------------------------------------------------

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens that are merged to this one; None for a single byte and for what no merge makes."""
        if token not in self.made_of:
            text = self.bytes_of[token]
            ids = [self.ranks[text[i : i + 1]] for i in range(len(text))]
            while len(ids) > 2:
                ranked = [(r, i) for i in range(len(ids) - 1) if (r := self.ranks.get(self.bytes_of[ids[i]] + self.bytes_of[ids[i + 1]], token)) < token]
                if not ranked:
                    break
                best, at = min(ranked)
                ids[at : at + 2] = [best]
            self.made_of[token] = (ids[0], ids[1]) if len(ids) == 2 else None
        return self.made_of[token]

    def stands(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        return len(self.bytes_of[token]) == 1 or self.parts(token) is not None

    def beside(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' bytes together is the two tokens."""
        key = (left, right)
        if key not in self.borders:
            if len(self.borders) > 2_000_000:
                self.borders.clear()
            self.borders[key] = self._border_holds(left, right)
        return self.borders[key]

    def _border_holds(self, left: int, right: int) -> bool:
        """Go back through the merges at the border, latest first, and look for one across it that would have come earlier.

        ``before`` is the rank at which the merge that is undone took place. On
        equal ranks the left one of two merges comes first.
        """
        before = len(self.ranks) * 2
        while True:
            across = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if across is not None and across < before:
                return False
            inner_left, inner_right = self.parts(left), self.parts(right)
            if inner_left is None and inner_right is None:
                return True
            if inner_right is None or (inner_left is not None and left > right):
                before, left = left, inner_left[1]
            else:
                before, right = right + 1, inner_right[0]

    # the transducer --------------------------------------------------------

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The next state and the tokens that are certain by then."""
        move = self.moves[state].get(byte)
        if move is None:
            move = self.moves[state][byte] = self._determine(*self.states[state], byte)
        return move

    def _determine(self, before: int | None, window: bytes, lasts: tuple[int, ...], byte: int) -> tuple[int, tuple[int, ...]]:
        window += bytes([byte])
        for start in range(len(window)):
            token = self.ranks.get(window[start:])
            left = lasts[start - 1] if start else before
            if token is not None and self.stands(token) and (left is None or self.beside(left, token)):
                lasts = (*lasts, token)
                break
        else:
            raise _NotLearned
        size = len(window)
        # places that a later token may still begin at
        first = next((s for s in range(size) if window[s:] in self.open), size)
        shared: set[int] | None = None
        for end in range(first, size + 1):
            trail, at = {end}, end
            while at:
                at -= len(self.bytes_of[lasts[at - 1]])
                trail.add(at)
            shared = trail if shared is None else shared & trail
        settled = max(shared)
        written = self._trail(lasts, settled)
        key = (lasts[settled - 1] if settled else before, window[settled:], lasts[settled:])
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            self.ends.append(self._trail(key[2], len(key[2])))
        return self.number[key], written

    def _trail(self, lasts: tuple[int, ...], end: int) -> tuple[int, ...]:
        out = []
        while end:
            out.append(lasts[end - 1])
            end -= len(self.bytes_of[out[-1]])
        return tuple(reversed(out))

    def run(self, raw: bytes) -> list[int]:
        """The ids of one piece."""
        if len(self.states) > _MAX_STATES:
            self.reset()
        state, out, moves = 0, [], self.moves
        try:
            for byte in raw:
                move = moves[state].get(byte) or self.step(state, byte)
                state = move[0]
                if move[1]:
                    out.extend(move[1])
        except _NotLearned:
            return self._merged(raw)
        out.extend(self.ends[state])
        return out

    def _merged(self, raw: bytes) -> list[int]:
        """The ids by merging, for vocabularies with tokens that their merges never make."""
        ids = [self.ranks[raw[i : i + 1]] for i in range(len(raw))]
        while True:
            ranked = [(r, i) for i in range(len(ids) - 1) if (r := self.ranks.get(self.bytes_of[ids[i]] + self.bytes_of[ids[i + 1]])) is not None]
            if not ranked:
                return ids
            best, at = min(ranked)
            ids[at : at + 2] = [best]

    def encode(self, text: str) -> list[int]:
        """The ids of a text, without special tokens: their strings are ordinary text."""
        out: list[int] = []
        known = self.pieces
        for piece in self.cut(text):
            ids = known.get(piece)
            if ids is None:
                ids = tuple(self.run(piece.encode("utf-8", "replace")))
                if len(piece) <= 48:
                    if len(known) > _MAX_PIECES:
                        known.clear()
                    known[piece] = ids
            out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        reader = Utf8Reader()
        out = [reader.feed(self.bytes_of[i]) for i in ids]
        return "".join(out) + reader.close()


class Utf8Reader:
    """UTF-8 as it comes in: a state machine that keeps an unfinished character until its bytes are there.

    A byte that fits no character gives U+FFFD, as does an unfinished one before it.
    """

    def __init__(self) -> None:
        self.missing, self.value, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, raw: bytes) -> str:
        out = []
        for b in raw:
            if self.missing:
                if self.low <= b <= self.high:
                    self.value = self.value << 6 | b & 0x3F
                    self.missing -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.missing:
                        out.append(chr(self.value))
                    continue
                self.missing = 0
                self.low, self.high = 0x80, 0xBF
                out.append("\ufffd")
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self.missing = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
                self.value = b & (0x3F >> self.missing)
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
            else:
                out.append("\ufffd")
        return "".join(out)

    def close(self) -> str:
        left, self.missing = self.missing, 0
        return "\ufffd" if left else ""
