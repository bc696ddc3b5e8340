"""Evaluation texts that leak into training text.

Training documents are taken in shards. A shard's words, numbered by the
shard's own vocabulary, become an FM-index (`fm_index`), which can be kept as a
table row: items that come later are searched in it without the documents. All
short runs of words of all items are searched at once. Where they occur, the runs of
one item in one document are put together, and a search over all numbers of
edits tells whether the document holds enough of the item there. What leaked is reported
as spans of the document, merged where they overlap.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np

from paperloom.llm.fm_index import FMIndex

#: So many consecutive words leak; or a stretch of so many words with one in EDIT_EVERY changed, dropped or added.
EXACT_WORDS, LOOSE_WORDS, EDIT_EVERY = 12, 24, 8
#: "About" one in EDIT_EVERY: this many more edits than that are still let through.
SLACK = 1
#: Runs that are searched: among 24 words with 4 edits, one run at least has 4 words.
SEED = 4
#: Such runs that the shortest stretch with most edits still holds, each edit spoiling SEED of them; longer stretches hold more.
LEAST_SEEDS = LOOSE_WORDS - SEED + 1 - SEED * (LOOSE_WORDS // EDIT_EVERY + SLACK)
#: Words without a run after which another place begins: the shortest stretches cannot go over so many, and
#: of a longer one that does, one side has LEAST_SEEDS still.
GAP = LOOSE_WORDS + EDIT_EVERY
#: Words of a shard. A longer document is a shard of its own.
SHARD_WORDS = 1 << 18
#: Words of a document that are compared with an item at once; more are compared in parts that overlap.
PART_WORDS = 1 << 10

# a stretch as one number: its words above, its first place below
_PLACE_BITS = 21
_WORD_ADDED, _NOTHING, _RUN = 1 << _PLACE_BITS, -(1 << 40), 1 << 42

_WORD = re.compile(r"([^\W_]+(?:['’‘`´ʼ\-‐‑][^\W_]+)*)")
_MARKS = str.maketrans("’‘‑‐", "''--")


def plain(word: str) -> str:
    """A word as it is compared."""
    return word.lower() if word.isascii() else unicodedata.normalize("NFKC", word).casefold().translate(_MARKS)


class _Plain(dict):
    """Keeps what `plain` gave for words met before."""

    def __missing__(self, word: str) -> str:
        if len(self) > 300_000:
            self.clear()
        self[word] = out = plain(word)
        return out


_PLAIN = _Plain()


def words_with_places(text: str) -> tuple[list[str], np.ndarray]:
    """The words of a text as they are compared, and where they begin and end. Case, marks and line breaks do not matter."""
    parts = _WORD.split(text)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    return list(map(_PLAIN.__getitem__, parts[1::2])), np.stack((ends[:-1:2], ends[1::2]), axis=1)


@dataclass
class Items:
    """Evaluation items as numbered words, and their distinct runs of SEED words."""

    ids: list[int]
    words: list[np.ndarray]
    numbers: dict[str, int]
    seeds: np.ndarray
    homes: list[list[tuple[int, int]]]  # of each seed: items and places in them


def prepare(rows: list[tuple[int, str | None]]) -> Items:
    """Items from ``(id, text)`` rows; null texts and those with too few words cannot leak."""
    numbers: dict[str, int] = {}
    ids, words = [], []
    for key, text in rows:
        found, _ = words_with_places(text or "")
        if key is not None and len(found) >= EXACT_WORDS:
            ids.append(key)
            words.append(np.array([numbers.setdefault(w, len(numbers) + 2) for w in found], np.int64))
    homes: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
    for k, item in enumerate(words):
        for i in range(len(item) - SEED + 1):
            homes[tuple(item[i : i + SEED].tolist())].append((k, i))
    seeds = np.array(list(homes), np.int64).reshape(len(homes), SEED)
    return Items(ids, words, numbers, seeds, list(homes.values()))


def leaked_part(item: np.ndarray, part: np.ndarray, shifts: set[int] | None = None) -> tuple[int, int] | None:
    """The stretch of ``part`` that holds enough of the item, as first and last place; None if there is none.

    For each number of edits in turn, every pair of places gets the longest
    stretch of the item that ends there with so many words changed, dropped or
    added. A stretch begins and ends with kept words and counts if its edits are
    few enough for its words; one a few words short of LOOSE_WORDS counts if its
    neighbours taken as changed still leave no more than one in EDIT_EVERY. Of
    those that count, the one with most words less 4 for each edit is given.
    ``shifts`` names by how many places part and item may be apart where they
    agree; as each edit shifts by one at most, only what lies that near is looked at.
    """
    n, m = len(item), len(part)
    if n < EXACT_WORDS or m < EXACT_WORDS:
        return None
    most = n // EDIT_EVERY + SLACK
    low, high = 1 - n, m - 1
    bands: list[list[int]] = []
    for shift in sorted(shifts) if shifts is not None else ():
        if bands and shift - most <= bands[-1][1] + 1:
            bands[-1][1] = min(shift + most, high)
        else:
            bands.append([max(shift - most, low), min(shift + most, high)])
    padded = np.concatenate((np.full(n - 1, -1), part, np.full(n - 1, -1)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, n)
    best, found = -n * EDIT_EVERY, None
    for first, last in bands if shifts is not None else [(low, high)]:
        score, stretch = _in_band(item, windows[first - low : last - low + 1], first, most, best)
        if score > best:
            best, found = score, stretch
    return found


def _in_band(item: np.ndarray, windows: np.ndarray, first: int, most: int, best: int) -> tuple[int, tuple[int, int] | None]:
    """The best score above ``best`` and its stretch, with a row of ``windows`` for each shift from ``first`` on."""
    n = len(item)
    # a row for each diagonal, a column for each word of the item; a value is the stretch's words, then its first place
    equal = windows == item
    column = np.arange(n)
    place = np.arange(first, first + len(windows))[:, None] + column
    run = np.cumsum(~equal, axis=1) * _RUN - column * _WORD_ADDED
    entry = np.where(equal, _WORD_ADDED + place, _NOTHING)
    found = None
    for edits in range(most + 1):
        # kept words go on along the diagonal
        value = np.maximum.accumulate(entry + run, axis=1) - run
        value[value < 0] = _NOTHING
        words = value >> _PLACE_BITS
        loose = (words >= LOOSE_WORDS) & (edits <= words // EDIT_EVERY + SLACK)
        if n >= LOOSE_WORDS:
            loose |= (words < LOOSE_WORDS) & (edits + LOOSE_WORDS - words <= LOOSE_WORDS // EDIT_EVERY)
        score = np.where(equal & (loose | (words >= EXACT_WORDS) & (edits == 0)), words - 4 * edits, -n * EDIT_EVERY)
        k = int(score.argmax())
        if score.flat[k] > best:
            best, found = int(score.flat[k]), (int(value.flat[k] & _WORD_ADDED - 1), int(place.flat[k]))
        if n - 4 * (edits + 1) <= best:
            break
        entry = np.full_like(value, _NOTHING)
        entry[:, 1:] = value[:, :-1] + _WORD_ADDED  # changed
        entry[:-1, 1:] = np.maximum(entry[:-1, 1:], value[1:, :-1] + _WORD_ADDED)  # dropped
        entry[1:] = np.maximum(entry[1:], value[:-1])  # added
    return best, found


@dataclass
class Index:
    """An FM-index of one shard of documents, with all that a search needs."""

    keys: list[int | None]
    starts: np.ndarray  # of each document: its first word's place, and the whole length at the end
    places: np.ndarray  # of each word: where it begins and ends in its text
    numbers: np.ndarray  # of each word; 1 stands between documents
    words: list[str]  # with the numbers from 2 on
    fm: FMIndex

    @classmethod
    def of(cls, documents: list[tuple[int | None, list[str], np.ndarray]]) -> Index:
        """Index documents given as key, words and places."""
        vocabulary: dict[str, int] = defaultdict(count(2).__next__)
        parts, starts, places, at = [], [0], [], 0
        for _, words, where in documents:
            parts.append(np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words)))
            parts.append(np.ones(1, np.int64))
            places += [where, np.zeros((1, 2), np.int64)]
            at += len(words) + 1
            starts.append(at)
        numbers = np.concatenate(parts)
        return cls([d[0] for d in documents], np.array(starts), np.concatenate(places), numbers, list(vocabulary), FMIndex(numbers))

    def pack(self) -> dict[str, object]:
        """The index as one row of the table `INDEX_TABLE`."""
        as_bytes = lambda a, kind="<u4": np.ascontiguousarray(a).astype(kind).tobytes()
        return {
            "keys": self.keys, "starts": as_bytes(self.starts), "places": as_bytes(self.places), "numbers": as_bytes(self.numbers),
            "words": self.words, "symbols_before": as_bytes(self.fm.symbols), "sampled": as_bytes(self.fm.places), "marks": np.packbits(self.fm.marks).tobytes(),
        }

    @classmethod
    def unpack(cls, row: dict[str, object]) -> Index:
        read = lambda name: np.frombuffer(row[name], "<u4").astype(np.int64)
        symbols = read("symbols_before")
        marks = np.unpackbits(np.frombuffer(row["marks"], np.uint8), count=len(symbols)).astype(bool)
        return cls(list(row["keys"]), read("starts"), read("places").reshape(-1, 2), read("numbers"), list(row["words"]), FMIndex.restored(symbols, marks, read("sampled")))

    def leaks(self, items: Items) -> list[tuple[int | None, int, int, int]]:
        """``(document, item, first character, end)`` of what leaked."""
        if not len(items.seeds):
            return []
        own = {w: i for i, w in enumerate(self.words, 2)}
        renumbered = np.zeros(len(items.numbers) + 2, np.int64)
        for w, k in items.numbers.items():
            renumbered[k] = own.get(w, 0)
        seeds = renumbered[items.seeds]
        known = np.flatnonzero((seeds > 0).all(axis=1))
        low, high = self.fm.search(seeds[known])
        hit = np.flatnonzero(high > low)
        if not len(hit):
            return []
        sizes = high[hit] - low[hit]
        seed = np.repeat(known[hit], sizes)
        rows = np.repeat(low[hit] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        place = self.fm.locate(rows)
        owner = np.searchsorted(self.starts, place, "right") - 1
        found: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for s, d, p in zip(seed.tolist(), owner.tolist(), (place - self.starts[owner]).tolist()):
            for item, i in items.homes[s]:
                found[d, item].append((p, i))
        out = []
        for (d, item), hits in found.items():
            start, stop = int(self.starts[d]), int(self.starts[d + 1]) - 1
            for first, last in _spans(renumbered[items.words[item]], self.numbers[start:stop], sorted(hits)):
                out.append((self.keys[d], items.ids[item], int(self.places[start + first, 0]), int(self.places[start + last, 1])))
        return out


#: Columns of a table of indexes.
INDEX_TABLE = "keys array<bigint>, starts binary, places binary, numbers binary, words array<string>, symbols_before binary, sampled binary, marks binary"


def _spans(item: np.ndarray, numbers: np.ndarray, hits: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Places of one document that hold enough of one item."""
    group: list[tuple[int, int]] = []
    # a stretch takes no more of a document
    reach = len(item) + len(item) // EDIT_EVERY + SLACK

    def within(first: int, stop: int) -> Iterator[tuple[int, int]]:
        while stop - first >= EXACT_WORDS:
            end = min(stop, first + PART_WORDS + reach)
            shifts = {p - first - i for p, i in group if first <= p < end}
            if shifts and (part := leaked_part(item, numbers[first:end], shifts)):
                # other passages of the item may stand before the best one as well
                yield from within(first, first + part[0])
                yield first + part[0], first + part[1]
                first += part[1] + 1
            else:
                first = end if end == stop else end - reach

    def close() -> Iterator[tuple[int, int]]:
        if len({i for _, i in group}) >= LEAST_SEEDS:
            yield from within(max(0, group[0][0] - reach), min(len(numbers), group[-1][0] + reach))

    for hit in hits:
        if group and hit[0] - group[-1][0] > GAP:
            yield from close()
            group = []
        group.append(hit)
    yield from close()


def shards(documents: Iterator[tuple[int | None, str | None]]) -> Iterator[Index]:
    """Indexes of documents given as key and text, SHARD_WORDS words or one longer document each. Too short texts are left out."""
    taken: list[tuple[int | None, list[str], np.ndarray]] = []
    size = 0
    for key, text in documents:
        if text:
            words, places = words_with_places(text)
            if len(words) >= EXACT_WORDS:
                taken.append((key, words, places))
                size += len(words)
        if size >= SHARD_WORDS:
            yield Index.of(taken)
            taken, size = [], 0
    if taken:
        yield Index.of(taken)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans with those that overlap or touch put together."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
