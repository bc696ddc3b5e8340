"""Statistics of texts and the kind of text they tell: prose, list, table or junk.

All measures are taken for a whole Arrow batch at once: the texts are split to
lines and words, each is measured by vectorized kernels, and the measures are
folded back to their texts. A table of rules with fixed thresholds, `RULES`,
then says what each text fails, by name, and the failed rules give its class:
the published rules that tell prose from other text by bullets, symbols, words
and common words, and rules on what share of a text stands in lines of items,
of cells or of no language.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PROSE, LIST, TABLE, JUNK = "prose", "list", "table", "junk"
_KINDS = [PROSE, LIST, TABLE, JUNK]
#: Of lines: short ones without an end, as lists without marks have.
OPEN = len(_KINDS)

_BULLET = r"^(?:[-*•–·◦▪‣]\s|\(?\d{1,3}[.)]\s|\(?\pL[.)]\s|\(?[ivxIVX]{1,6}[.)]\s)"
_LEADER = r"\.{3,}\s*[\divxlcIVXLC]+$|…\s*\d+$"
_INDEX = r"\pL[^.!?]*,\s*\d+(?:\s*[-–]\s*\d+)?(?:,\s*\d+(?:\s*[-–]\s*\d+)?)*$"
_CELLS = r"\t|\s\|\s|\||;|,|\s{2,}"
_EMPTY_CELL = r"n/a|-{1,3}|–"
_GLYPH_CODE = r"(?:\(cid:\d+\)\s*)+"
# Operators of page descriptions.
_DRAWING = r"^(?:-?[\d.]+\s+)+(?:m|l|c|v|y|h|re|f|F|S|s|n|W|b|B|cm|w|J|j|M|d|i|q|Q|BT|ET|Td|TD|Tm|Tf|Tj|TJ|Tc|Tw|Tz|TL|Tr|Ts|RG|rg|G|g|K|k|sc|scn|SC|SCN|gs|Do|sh)(?:\s+(?:f|S|s|n|W|B|b)\*?)*$"
_BLOB = r"^[A-Za-z0-9+/=_-]{24,}$"
# What lines of items, rows and codes have: digits, separators of cells, leaders, bullets, letters of lists, or one long word.
_MARKED = r"\d|\t|\||;\S|,\S|\s{2,}\S|\.{3}|…|^[-*•–·◦▪‣(]|^(?:\pL|[ivxIVX]{1,6})[.)]\s|^\S{24,}$"
_END = r"[^\s.][.!?…。．]+[”\"’»)\]]*(?:\s|$)"
_CLOSED = r"[.!?…。．:;,][”\"’»)\]]*$"

# Thresholds of the published rules for web text.
MIN_WORDS, MAX_WORDS, MIN_MEAN, MAX_MEAN = 50, 100_000, 3.0, 10.0
MAX_SYMBOLS, MAX_BULLETS, MAX_ELLIPSES, MIN_ALPHABETIC, MIN_COMMON = 0.1, 0.9, 0.3, 0.8, 2
#: Less prose than this, and a text is none.
MIN_PROSE = 0.5
#: A text of so many words in ASCII letters has common words, at least this share, or uses some words again: a language without a list of common words does.
JUDGED_WORDS, MIN_COMMON_SHARE, ASCII_LETTERS, MAX_DIFFERENT = 30, 0.02, 0.95, 0.9
#: Of so many words, so few different ones are one word over and over.
REPEATED_WORDS, WORDS_EACH = 6, 20


@dataclass(frozen=True)
class Rule:
    """``fails`` tells from the statistics which texts fail; ``kind`` is the class that a failure gives, None if it gives none by itself."""

    name: str
    fails: Callable[[Statistics], np.ndarray]
    kind: str | None = None


#: The rules. Of the classes that a text's failures give, the last one's counts.
RULES = [
    Rule("few_words", lambda s: s.words < MIN_WORDS),
    Rule("many_words", lambda s: s.words > MAX_WORDS),
    Rule("short_words", lambda s: s.mean_word_length < MIN_MEAN),
    Rule("long_words", lambda s: s.mean_word_length > MAX_MEAN),
    Rule("symbols", lambda s: s.symbols > MAX_SYMBOLS),
    Rule("bullets", lambda s: s.bullets > MAX_BULLETS),
    Rule("ellipses", lambda s: s.ellipses > MAX_ELLIPSES),
    Rule("not_alphabetic", lambda s: s.alphabetic < MIN_ALPHABETIC),
    Rule("few_common_words", lambda s: s.different_common < MIN_COMMON),
    Rule("mostly_items", lambda s: (s.prose < MIN_PROSE) & (s.items >= np.maximum(s.rows, s.no_language)), LIST),
    Rule("mostly_rows", lambda s: (s.prose < MIN_PROSE) & (s.rows > s.items) & (s.rows >= s.no_language), TABLE),
    Rule("mostly_no_language", lambda s: (s.prose < MIN_PROSE) & (s.no_language > np.maximum(s.items, s.rows)), JUNK),
    Rule("no_common_words", lambda s: _lacks_common_words(s), JUNK),
    Rule("one_word", lambda s: (s.rows < MIN_PROSE) & (s.words >= REPEATED_WORDS) & (s.different <= np.maximum(2, s.words // WORDS_EACH)) & (s.numbers < 0.5), JUNK),
]


def _count(lines: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)


def _has(lines: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)


def _lacks_common_words(s: Statistics) -> np.ndarray:
    """Texts of many different words in ASCII letters with hardly a common one; only those that may be so are looked at."""
    near = np.flatnonzero((s.prose + s.open >= MIN_PROSE) & (s.words >= JUDGED_WORDS) & (s.different >= MAX_DIFFERENT * s.words))
    part = s.part(near)
    out = np.zeros(s.n, bool)
    out[near] = (part.letter_words >= JUDGED_WORDS) & (part.common < MIN_COMMON_SHARE) & (part.ascii_letters >= ASCII_LETTERS)
    return out


class _Subset:
    """Measures of the lines that a mask takes; of all others they are 0."""

    def __init__(self, lines: pa.Array, mask: np.ndarray, taken: bool = False):
        self.mask = mask
        self.lines = lines if taken else lines.filter(pa.array(mask))

    def count(self, pattern: str) -> np.ndarray:
        out = np.zeros(len(self.mask), np.int64)
        out[self.mask] = _count(self.lines, pattern)
        return out

    def has(self, pattern: str) -> np.ndarray:
        out = np.zeros(len(self.mask), bool)
        out[self.mask] = _has(self.lines, pattern)
        return out


def _cleaned(texts: pa.Array) -> pa.Array:
    """Compatibility forms made plain and zero-width characters dropped, so that they do not disturb the measures."""
    plain = pc.utf8_normalize(texts, form="NFKC")
    return pc.replace_substring_regex(plain, "[​‌‍⁠﻿]", "")


def line_kinds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all non-blank lines of cleaned texts: the text's index, the kind's index, OPEN for open lines that are no marked items, and the number of characters."""
    parts = pc.split_pattern(texts, "\n")
    owner = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
    raw = pc.list_flatten(parts)
    lines = pc.utf8_trim_whitespace(raw)
    size = pc.utf8_length(lines).to_numpy(zero_copy_only=False)
    filled = size > 0
    letters, words = _count(lines, r"\pL|\pM"), _count(lines, r"\S+")
    # most lines have nothing that an item, a row or a code has, and are not looked at further
    marked_lines = _has(lines, _MARKED)
    on = _Subset(lines, marked_lines)
    few = _Subset(lines, letters < 0.3 * size)
    symbols = filled & few.mask & (letters + few.count(r"\d") < 0.3 * np.maximum(size - few.count(r"\s"), 1))
    marked = _Subset(pc.replace_substring_regex(on.lines, rf"(^|[\s;,|])(?:{_EMPTY_CELL})", r"\1 0"), marked_lines, taken=True)
    wordlike, cells, digits = marked.count(r"[^\s;,|]*\pL[^\s;,|]*"), marked.count(r"[^\s;,|]+"), marked.count(r"\d")
    separators = on.count(_CELLS)
    single = words - _count(lines, r"\S\S+")
    no_vowel = _count(lines, r"(?i)\b[bcdfghjklmnpqrstvwxz]{3,}\b")
    long_ascii = _Subset(lines, no_vowel > 0).count(r"(?i)\b[a-z]{3,}\b")

    junk = symbols | on.has(rf"^{_GLYPH_CODE}$") | on.has(_DRAWING) | on.has(_BLOB)
    junk |= (words >= 5) & (single >= 0.6 * words) & (no_vowel == 0) & (letters >= digits)
    junk |= (long_ascii >= 2) & (no_vowel >= 0.5 * long_ascii)
    numeric = (digits > 0) & (cells >= 2) & (cells - wordlike >= 0.5 * cells)
    row = ~junk & (numeric | ((separators >= 2) & (digits > 0) & (cells - wordlike >= 0.3 * cells)))
    ended = _has(lines, _END)
    row |= ~junk & (on.count(r"\t|\s\|\s|;\S|,\S|\s{2,}\S") >= 2) & ~ended
    leader = ~junk & on.has(_LEADER)
    row &= ~leader
    item = ~junk & ~row & (leader | on.has(_BULLET) | on.has(_INDEX) & ~ended & (words <= 12))
    row |= ~junk & ~item & (size > 0) & (digits > 0) & (wordlike == 0)
    plain = filled & ~junk & ~row & ~item
    # a sentence may go on with a number: such a line is neither an item nor a row
    flows = np.zeros(len(size), bool)
    if len(size) > 1:
        flows[1:] = plain[:-1] & (words[:-1] >= 5) & (owner[1:] == owner[:-1]) & (item | row)[1:]
        flows[1:] &= ~_Subset(lines.slice(0, len(lines) - 1), flows[1:]).has(_CLOSED)
    resumed = flows & (item | row) & on.has(r"^\(?\d") & (wordlike > 0) & ~leader & (separators < 2)
    plain |= resumed
    item &= ~resumed
    row &= ~resumed
    ends = ended & plain

    # runs of plain lines: what stands up to the last sentence end of its run is prose
    kind = np.where(junk, 3, np.where(row, 2, np.where(item, 1, 0)))
    start = np.ones(len(size), bool)
    start[1:] = ~((plain[1:] & plain[:-1]) & (owner[1:] == owner[:-1]))
    run = np.cumsum(start) - 1 if len(size) else np.zeros(0, int)
    place = np.arange(len(size))
    last_end = np.full(run[-1] + 1 if len(run) else 0, -1)
    np.maximum.at(last_end, run[ends], place[ends])
    open_tail = plain & (place > last_end[run] + 2 * (last_end[run] >= 0)) & (words <= 8)
    # up to two open lines beside whole sentences are headings, up to three on their own a piece of text
    opened, closed = np.bincount(owner[open_tail], minlength=len(texts)), np.bincount(owner[ends], minlength=len(texts))
    all_lines = np.bincount(owner[filled], minlength=len(texts))
    open_tail &= ~((opened[owner] <= 2) & (closed[owner] > 0) | (opened[owner] <= 3) & (opened[owner] == all_lines[owner]))
    kind = np.where(open_tail, OPEN, kind)
    return owner[filled], kind[filled], size[filled]


def _words_of(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of the strings that are not empty: the text's index, the number of the string, and the different strings."""
    owner, coded = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), pc.dictionary_encode(pc.list_flatten(lists))
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    filled = pc.greater(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, bool)
    return owner[filled], codes[filled], coded.dictionary


def _different(owner: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """How many different words each text has."""
    size = int(codes.max()) + 1 if len(codes) else 1
    pairs = np.sort(owner * size + codes)
    new = np.ones(len(pairs), bool)
    new[1:] = pairs[1:] != pairs[:-1]
    return np.bincount(pairs[new] // size, minlength=n)


class Statistics:
    """The statistics of texts that `RULES` judge, an array of each, worked out when asked for; a null text counts as an empty one.

    ``words`` and ``different`` count what white space separates;
    ``mean_word_length`` is its mean length, ``numbers`` the share with a digit,
    ``alphabetic`` that with a letter, ``symbols`` how many number signs and
    ellipses there are for each; ``bullets`` and ``ellipses`` are shares of the
    lines that are not blank; of the runs of letters, ``letter_words`` is the
    number, ``common`` the share of common words, ``different_common`` how many
    different ones there are, ``ascii_letters`` the share of ASCII letters among
    all letters; ``prose``, ``items``, ``rows`` and
    ``no_language`` are the shares of the characters that stand in such lines,
    ``open`` that of items without a mark. Without a set of ``common`` words
    nothing fails for want of them.
    """

    def __init__(self, texts: pa.Array, common: set[str] | None):
        self.n, self._common = len(texts), common
        self.texts = pc.fill_null(texts, "")
        self._plain = _cleaned(self.texts)
        owner, kind, size = line_kinds(self._plain)
        mass = np.zeros((self.n, OPEN + 1))
        np.add.at(mass, (owner, kind), size)
        share = mass / np.maximum(mass.sum(axis=1), 1)[:, None]
        self.prose = np.where(mass.sum(axis=1) > 0, share[:, 0], 1.0)
        self.open = share[:, OPEN]
        self.items, self.rows, self.no_language = share[:, 1] + self.open, share[:, 2], share[:, 3]
        # what holds of a word is worked out once for each different one
        self._words = _words_of(pc.utf8_split_whitespace(self.texts))
        self.words = np.bincount(self._words[0], minlength=self.n)

    def _per_word(self, measure: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
        owner, codes, words = self._words
        return np.bincount(owner, weights=measure(words)[codes], minlength=self.n) / np.maximum(self.words, 1)

    def _per_line(self, pattern: str) -> np.ndarray:
        owner, lines = self._lines
        return np.bincount(owner[_has(lines, pattern)], minlength=self.n) / np.maximum(np.bincount(owner, minlength=self.n), 1)

    @cached_property
    def _lines(self) -> tuple[np.ndarray, pa.Array]:
        parts = pc.split_pattern(self.texts, "\n")
        lines = pc.utf8_trim_whitespace(pc.list_flatten(parts))
        full = pc.greater(pc.binary_length(lines), 0)
        return pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)[full.to_numpy(zero_copy_only=False)], lines.filter(full)

    def part(self, rows: np.ndarray) -> LetterRuns:
        """The runs of letters of some texts."""
        return LetterRuns(self._plain.take(pa.array(rows)), self._common)

    @cached_property
    def different_common(self) -> np.ndarray:
        return self.part(np.arange(self.n)).different_common

    @cached_property
    def different(self) -> np.ndarray:
        return _different(*self._words[:2], self.n)

    @cached_property
    def mean_word_length(self) -> np.ndarray:
        return self._per_word(lambda words: pc.utf8_length(words).to_numpy(zero_copy_only=False))

    @cached_property
    def numbers(self) -> np.ndarray:
        return self._per_word(lambda words: _has(words, r"\d"))

    @cached_property
    def alphabetic(self) -> np.ndarray:
        return self._per_word(lambda words: _has(words, r"\pL"))

    @cached_property
    def symbols(self) -> np.ndarray:
        return (_count(self.texts, "#") + _count(self.texts, r"\.\.\.|…")) / np.maximum(self.words, 1)

    @cached_property
    def bullets(self) -> np.ndarray:
        return self._per_line(_BULLET)

    @cached_property
    def ellipses(self) -> np.ndarray:
        return self._per_line(r"(?:\.\.\.|…)$")


class LetterRuns:
    """The statistics that are taken from the runs of letters of cleaned texts."""

    def __init__(self, plain: pa.Array, common: set[str] | None):
        self.n, self._common = len(plain), common
        self._owner, self._codes, self._runs = _words_of(pc.split_pattern_regex(pc.utf8_lower(plain), r"[^\pL\pM]+"))

    def _sum(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self._owner, weights=values[self._codes], minlength=self.n)

    @cached_property
    def _is_common(self) -> np.ndarray:
        return pc.is_in(self._runs, value_set=pa.array(sorted(self._common), pa.string())).to_numpy(zero_copy_only=False)

    @cached_property
    def letter_words(self) -> np.ndarray:
        return np.bincount(self._owner, minlength=self.n)

    @cached_property
    def common(self) -> np.ndarray:
        return np.ones(self.n) if self._common is None else self._sum(self._is_common) / np.maximum(self.letter_words, 1)

    @cached_property
    def different_common(self) -> np.ndarray:
        if self._common is None:
            return np.full(self.n, MIN_COMMON)
        taken = self._is_common[self._codes]
        return _different(self._owner[taken], self._codes[taken], self.n)

    @cached_property
    def ascii_letters(self) -> np.ndarray:
        # marks stand behind their letters here
        return self._sum(_count(self._runs, "[a-z]") - _count(self._runs, r"\pM")) / np.maximum(self._sum(_count(self._runs, r"\pL")), 1)


def _failures(measured: Statistics, rules: list[Rule]) -> tuple[list[str | None], np.ndarray]:
    fails = np.zeros((measured.n, len(rules)), bool)
    kinds = np.full(measured.n, PROSE, object)
    kinds[measured.words == 0] = None
    for k, rule in enumerate(rules):
        fails[:, k] = rule.fails(measured) & (measured.words > 0)
        if rule.kind is not None:
            kinds[fails[:, k]] = rule.kind
    return kinds.tolist(), fails


def judged(texts: pa.Array, common: set[str] | None) -> tuple[list[str | None], pa.Array]:
    """The class of each text, None if it is null or blank, and the names of the rules it fails; a blank text fails none."""
    kinds, fails = _failures(Statistics(texts, common), RULES)
    names = pa.array([r.name for r in RULES]).take(pa.array(np.nonzero(fails)[1]))
    offsets = np.concatenate(([0], np.cumsum(fails.sum(axis=1)))).astype(np.int32)
    return kinds, pa.ListArray.from_arrays(pa.array(offsets), names)


def classify(texts: pa.Array, common: set[str] | None = None) -> list[str | None]:
    """The class of each text alone, by the rules that give one."""
    return _failures(Statistics(texts, common), [r for r in RULES if r.kind is not None])[0]


def rows_of(batches: Iterator[pa.RecordBatch], common: set[str]) -> Iterator[pa.RecordBatch]:
    """``path, result_id, text_class, failed`` of a batch's non-blank texts."""
    for batch in batches:
        kinds, failed = judged(batch.column("text"), common)
        keep = pa.array([k is not None for k in kinds], pa.bool_())
        columns = [batch.column("path").filter(keep), batch.column("result_id").filter(keep), pa.array([k for k in kinds if k], pa.string()), failed.filter(keep)]
        yield pa.RecordBatch.from_arrays(columns, names=["path", "result_id", "text_class", "failed"])
