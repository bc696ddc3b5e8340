"""Noise in text from scanned pages: finding it, and repairing the text into paragraphs.

What is read as what is learned from the corpus: an inverted index from
character q-grams to the words of its vocabulary pairs each word with the much
more frequent ones that one place sets apart from it, and what the pairs
differ in is counted. An unknown word is then corrected in two steps. The same
index, and a walk through the vocabulary by what was learned, give the words it
may have been; boosted trees rank these candidates by how likely the one is
misread as the other. Lines are judged in pairs: one classifier tells whether a
mark at a line's end breaks a word that the next line goes on with, another
whether a line stands among the text as a running header, footer or page
number. The classifiers are fitted on samples of fixed size, whose labels are
made: words are misread as was learned and broken on purpose, and lines that
come again from page to page, or count the pages, tell where furniture stands.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np

from paperloom.llm.boosting import BoostedTrees
from paperloom.llm.vocabulary import Vocabulary

#: Records that the line classifier is fitted to, and vocabulary words for the other two, at most.
SAMPLE_RECORDS, SAMPLE_WORDS = 2000, 900
#: A line or compound counts as frequent from this share of those of its language, so that there are at most 1 / share of each.
LINE_SHARE, COMPOUND_SHARE, MIN_COUNT = 1e-4, 2e-5, 3
Q = 2
ACCEPT = 0.5
#: Words are compared with those so many times as frequent: a misreading is much rarer than the word.
MUCH_MORE = 50
#: A misreading is learned from so many different words, and so large a share of all such words.
LEARNED_WORDS, LEARNED_SHARE = 3, 0.002
#: Words that a usual misreading counts for beside those that it was learned from.
USUAL_WORDS = 2.0

# Usual misreadings, what is written and what was meant. They count a little where little was learned.
MISREADINGS = [
    ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"), ("ii", "ü"), ("ri", "n"), ("n", "ri"), ("vv", "w"), ("w", "vv"),
    ("li", "h"), ("h", "li"), ("h", "fi"), ("in", "m"), ("nn", "m"), ("l", "i"), ("i", "l"), ("1", "l"), ("1", "i"), ("l", "1"), ("j", "i"), ("0", "o"), ("o", "0"),
    ("5", "s"), ("s", "5"), ("9", "g"), ("g", "9"), ("q", "g"), ("g", "q"), ("6", "b"), ("6", "é"), ("8", "b"), ("3", "e"), ("2", "z"), ("7", "t"), ("4", "a"),
    ("c", "e"), ("e", "c"), ("o", "a"), ("a", "o"), ("o", "c"), ("f", "t"), ("t", "f"), ("b", "h"), ("h", "b"), ("v", "y"), ("y", "v"), ("u", "v"), ("v", "u"),
    ("é", "è"), ("e", "é"), ("é", "e"), ("a", "á"), ("o", "ó"), ("o", "ö"), ("u", "ü"), ("a", "ä"), ("i", "í"), ("n", "ñ"), ("b", "ß"), ("ê", "é"),
]
# Letters of like shape.
SHAPES = ["aceos", "nmurh", "iltjf1", "vwxyzk", "gqpy", "bdhk"]
_SHAPES_OF = {c: {k for k, shape in enumerate(SHAPES) if c in shape} for shape in SHAPES for c in shape}

MARKS = "-‐‑¬\xad"
_WORD = re.compile(r"[^\W_]+")
_SMALL = re.compile(r"(?<![^\W_])[a-zß-öø-ÿа-яё][^\W_]{4}")  # a longer word without a capital
_NUMERAL = re.compile(r"[ivxlcdm]+", re.I)
_BROKEN = re.compile(rf"([^\W_]+)([{MARKS}])$")
_STARTS = re.compile(r"[^\W_]+")
_ENDED = re.compile(r"[.!?…。．:;,][”\"’»)\]]*$")
_NUMBERED = re.compile(
    r"[\W_]*(?:(?:p|pp|pg|page|seite|s|página|pagina|pág|pag|стр|страница|bladzijde|blz|side|f|folio)\b\.?\s*)?(?:\d{1,5}|[ivxlc]{1,9})(?:\s*(?:of|/|von|de|sur|van|из|out of|-)\s*(?:\d{1,5}|[ivxlc]{1,9}))?(?:\s*쪽)?[\W_]*",
    re.I,
)
_BESIDE = re.compile(r"^\d{1,5}\s{2,}\D.*$|^.*\D\s{2,}\d{1,5}$|^\d{1,5}\s*[|·•]\s*\D.*$|^.*\D\s*[|·•]\s*\d{1,5}$")
_DIGITS = re.compile(r"\d+")


# misread words --------------------------------------------------------------


def grams(word: str) -> set[str]:
    padded = f" {word} "
    return {padded[i : i + Q] for i in range(len(padded) - Q + 1)}


class Index:
    """The vocabulary's words by their q-grams."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words = sorted(w for w in vocabulary.counts if len(w) >= 3 and w[0] < "ʰ" and not any(c.isdigit() for c in w[:2]))
        self.sizes = np.array([len(grams(w)) for w in self.words] or [0])
        self.lengths = np.array([len(w) for w in self.words] or [0])
        self.counts = np.array([vocabulary.counts[w] for w in self.words] or [0])
        postings: dict[str, list[int]] = defaultdict(list)
        for i, w in enumerate(self.words):
            for g in grams(w):
                postings[g].append(i)
        self.postings = {g: np.array(p) for g, p in postings.items()}

    def near(self, word: str) -> np.ndarray:
        """Numbers of all words but the word itself that up to two letters at one place set apart from it.

        Two letters are in Q + 1 grams, so that all others have to agree.
        """
        lists = [p for g in grams(word) if (p := self.postings.get(g)) is not None]
        if not lists:
            return np.empty(0, int)
        common = np.bincount(np.concatenate(lists), minlength=len(self.words))
        found = np.flatnonzero((common > 0) & (common >= self.sizes - Q - 1) & (np.abs(self.lengths - len(word)) <= 1))
        return found[[self.words[i] != word and difference(word, self.words[i]) is not None for i in found]] if len(found) else found


def difference(word: str, meant: str) -> tuple[str, str, int, int] | None:
    """What ``word`` has in place of what of ``meant``, one or two letters each, and how many letters before and behind agree; None if they differ in more."""
    before, most = 0, min(len(word), len(meant))
    while before < most and word[before] == meant[before]:
        before += 1
    behind = 0
    while behind < most - before and word[-1 - behind] == meant[-1 - behind]:
        behind += 1
    a, b = word[before : len(word) - behind], meant[before : len(meant) - behind]
    if not a and b and before and len(b) == 1:  # one of two like letters
        before, a, b = before - 1, word[before - 1], meant[before - 1 : before + 1]
    elif not b and a and before and len(a) == 1:
        before, a, b = before - 1, word[before - 1 : before + 1], meant[before - 1]
    return (a, b, before, behind) if 1 <= len(a) <= 2 and 1 <= len(b) <= 2 else None


def differences(words: Iterable[tuple[str, int]], index: Index) -> Iterator[tuple[str, str]]:
    """What words with their counts have in place of what of the one much more frequent word near them.

    Ends of words are left out, as they change with the grammar, and so are words with more than one such neighbour.
    """
    for word, n in words:
        if len(word) < 4 or word.isdigit():
            continue
        found = []
        for i in index.near(word):
            if index.counts[i] >= MUCH_MORE * n:
                a, b, before, behind = difference(word, index.words[i])
                if behind and before + behind >= 2 and all(c.isdigit() or _same_script(c, b[0]) for c in a):
                    found.append((a, b))
        if len(found) == 1:
            yield found[0]


def _same_script(c: str, d: str) -> bool:
    return c.isalpha() and (c < "Ͱ") == (d < "Ͱ")


class Confusions:
    """How likely what is read as what: from the numbers of words that it was learned from, and a little from the usual ones."""

    def __init__(self, learned: dict[tuple[str, str], int]):
        self.learned = learned
        weights = dict.fromkeys(MISREADINGS, USUAL_WORDS)
        for pair, n in learned.items():
            weights[pair] = weights.get(pair, 0.0) + n
        total = sum(weights.values())
        self.cost = {pair: float(np.log(total / n)) for pair, n in weights.items()}
        #: The cost of any other change of one letter, of like shape or not.
        self.like, self.unlike = float(np.log(2 * total)), float(np.log(2 * total)) + 2.0
        self.weights = weights
        self.by_written: dict[str, list[str]] = defaultdict(list)
        self.by_meant: dict[str, list[str]] = defaultdict(list)
        for written, meant in weights:
            self.by_written[written].append(meant)
            self.by_meant[meant].append(written)

    def __getstate__(self) -> dict:
        return self.learned

    def __setstate__(self, learned: dict) -> None:
        self.__init__(learned)

    def other(self, a: str, b: str) -> float | None:
        """The cost of one letter in place of another that was not learned; None if letters are more or of another script."""
        if len(a) != 1 or len(b) != 1 or not (a.isdigit() or _same_script(a, b)):
            return None
        return self.like if _SHAPES_OF.get(a, set()) & _SHAPES_OF.get(b, set()) else self.unlike

    def known_steps(self, word: str, meant: str) -> tuple[int, float] | None:
        """The number and cost of the likeliest learned misreadings that make ``meant`` the word; None if it takes others."""
        best: tuple[float, int] | None = None
        stack, seen = [(0, 0, 0.0, 0)], {}
        n, m = len(word), len(meant)
        while stack:
            i, j, cost, steps = stack.pop()
            if seen.get((i, j), 1e9) <= cost or best is not None and cost >= best[0]:
                continue
            seen[i, j] = cost
            if i == n and j == m:
                best = (cost, steps)
                continue
            for step, back in ((1, 1), (2, 1), (1, 2), (2, 2)):
                if i + step <= n and j + back <= m and (more := self.cost.get((word[i : i + step], meant[j : j + back]))) is not None:
                    stack.append((i + step, j + back, cost + more, steps + 1))
            if i < n and j < m and word[i] == meant[j]:
                stack.append((i + 1, j + 1, cost, steps))
        return (best[1], best[0]) if best else None

    def meant_words(self, word: str, vocabulary: Vocabulary) -> set[str]:
        """All vocabulary words but the word itself that learned misreadings alone, of any number, make the word."""
        out, seen, n = set(), set(), len(word)
        stack = [(0, "", vocabulary.trie())]
        while stack:
            i, meant, node = stack.pop()
            if (i, meant) in seen:
                continue
            seen.add((i, meant))
            if i == n:
                if "" in node and meant != word:
                    out.add(meant)
                continue
            if (below := node.get(word[i])) is not None:
                stack.append((i + 1, meant + word[i], below))
            for step in (1, 2):
                for back in self.by_written.get(word[i : i + step], ()) if i + step <= n else ():
                    below = node
                    for c in back:
                        below = below.get(c) if below is not None else None
                    if below is not None:
                        stack.append((i + step, meant + back, below))
        return out

    def misread(self, word: str, rng: random.Random, other: float = 0.0) -> str | None:
        """The word with one or two of its letters misread as was learned, or at a rate ``other`` with one letter taken for any of like shape."""
        if rng.random() < other:
            i = rng.randrange(len(word))
            if not (like := sorted({c for k in _SHAPES_OF.get(word[i], ()) for c in SHAPES[k]} - {word[i]})):
                return None
            return word[:i] + rng.choice(like) + word[i + 1 :]
        for _ in range(1 + (rng.random() < 0.3)):
            places = [(i, written, meant) for i in range(len(word)) for size in (1, 2) if i + size <= len(word) for meant in (word[i : i + size],) for written in self.by_meant.get(meant, ())]
            if not places:
                return None
            i, written, meant = rng.choices(places, [self.weights[w, m] for _, w, m in places])[0]
            word = word[:i] + written + word[i + len(meant) :]
        return word


def without_misread(vocabulary: Vocabulary, confusions: Confusions) -> Vocabulary:
    """Without words that are misread forms of much more frequent ones; those with digits among letters, of any more frequent one without."""
    bad = set()
    for word, n in vocabulary.counts.items():
        if len(word) < 3 or word.isdigit():
            continue
        mixed = any(c.isdigit() for c in word)
        for meant in confusions.meant_words(word, vocabulary):
            more = vocabulary.counts[meant]
            if len(meant) >= 3 and (more >= MUCH_MORE * n or mixed and more > n and not any(c.isdigit() for c in meant)):
                bad.add(word)
    return vocabulary.without(bad)


class Corrector:
    """Vocabulary words that an unknown one may have been, and their ranking."""

    def __init__(self, vocabulary: Vocabulary, confusions: Confusions):
        self.vocabulary, self.confusions = vocabulary, confusions
        self.index = Index(vocabulary)
        self.numbers = {w: i for i, w in enumerate(self.index.words)}
        self.ranker: BoostedTrees | None = None
        self.known: dict[str, str | None] = {}

    def candidates(self, word: str) -> list[tuple[str, int, float, bool]]:
        """Words that the word may have been, with the number and cost of the misreadings, and whether one was not learned."""
        found = {}
        for i in self.index.near(word):
            meant = self.index.words[i]
            a, b, _, _ = difference(word, meant)
            if (steps := self.confusions.known_steps(word, meant)) is not None:
                found[meant] = (*steps, False)
            elif (cost := self.confusions.other(a, b)) is not None:
                found[meant] = (1, cost, True)
        for meant in self.confusions.meant_words(word, self.vocabulary):
            if meant not in found and meant in self.numbers:
                found[meant] = (*self.confusions.known_steps(word, meant), False)
        return [(meant, *how) for meant, how in sorted(found.items())]

    def _features(self, word: str, found: list[tuple[str, int, float, bool]]) -> np.ndarray:
        own, digits = grams(word), sum(c.isdigit() for c in word)
        least = min((cost + self.vocabulary.cost[meant] for meant, _, cost, _ in found), default=0.0)
        rows = []
        for meant, steps, cost, other in found:
            theirs = grams(meant)
            price = self.vocabulary.cost[meant]
            rows.append((
                steps, cost, other, cost + price, cost + price - least, len(own & theirs) / len(own | theirs), len(word), len(meant) - len(word), price, digits,
                steps / len(word), word[0] == meant[0], word[-1] == meant[-1], len(found),
            ))
        return np.array(rows, float).reshape(len(rows), 14)

    def fit(self, seed: int = 5) -> Corrector:
        """Fit the ranking to words misread on purpose, and to sound words whose neighbours are not what was meant."""
        rng = random.Random(seed)
        words = self.index.words
        sample = rng.sample(words, min(SAMPLE_WORDS, len(words)))
        # frequent words are misread more often; what was not learned is only believed of those
        often = rng.choices(words, self.index.counts, k=SAMPLE_WORDS) if words else []
        x, y = [], []
        for word, other in [*((w, 0.0) for w in sample), *((w, 0.5) for w in often)]:
            written = self.confusions.misread(word, rng, other)
            if written and written not in self.vocabulary and (found := self.candidates(written)):
                x.append(self._features(written, found))
                y += [float(meant == word) for meant, *_ in found]
        for word in sample:
            if found := self.candidates(word):
                x.append(self._features(word, found))
                y += [0.0] * len(found)
        self.ranker = BoostedTrees(rounds=40).fit(np.concatenate(x) if x else np.zeros((0, 14)), np.array(y))
        return self

    def correct(self, word: str) -> str | None:
        """The word that was meant, in lower case; None if the word seems right or nothing is like it."""
        low = word.lower()
        if low in self.known:
            return self.known[low]
        out = None
        if 3 <= len(low) and low not in self.vocabulary and low[0] < "ʰ" and not low.isdigit() and not _NUMERAL.fullmatch(low):
            if found := self.candidates(low):
                p = self.ranker.probability(self._features(low, found))
                k = int(p.argmax())
                if p[k] >= ACCEPT:
                    out = found[k][0]
        if len(self.known) > 300_000:
            self.known.clear()
        self.known[low] = out
        return out


# pairs of lines -------------------------------------------------------------


@dataclass
class LineStatistics:
    """Of all results: frequent lines without their numbers, and frequent words with a hyphen inside."""

    lines: dict[str, int] = field(default_factory=dict)
    compounds: dict[str, int] = field(default_factory=dict)


def template(line: str) -> str:
    """A line without case, numbers and their place, and what stands behind a bar."""
    return " ".join(_WORD.findall(_DIGITS.sub("", line.split(" | ")[0]).lower()))


def count_lines(text: str, lines: Counter, compounds: Counter) -> None:
    for row in text.split("\n"):
        if 3 <= len(row) <= 80 and not row[0].islower() and title_like(row) and not _ENDED.search(row.rstrip()):
            lines[template(row)] += 1
        if "-" in row:
            for m in re.finditer(r"[^\W_]+(?:-[^\W_]+)+", row):
                compounds[m[0].lower()] += 1


def title_like(line: str) -> bool:
    """Whether a line's words have capitals, but for short ones, as headings have."""
    if _SMALL.search(line):
        return False
    words = [w for w in _WORD.findall(line) if not w.isdigit()]
    return bool(words) and len(words) <= 9 and all(w[0].isupper() or len(w) <= 4 for w in words) and words[0][0].isupper() and sum(w[0].isupper() for w in words) >= 2


def is_candidate(line: str) -> bool:
    """Whether a line may be furniture at all."""
    first, last = line[0], line[-1]
    if len(line) > 80 or first.isalpha() and not first.isupper() and len(line) > 12:
        return False
    if _NUMBERED.fullmatch(line) is not None or (first.isdigit() or last.isdigit()) and _BESIDE.match(line) is not None:
        return True
    return (last.isalnum() or not _ENDED.search(line)) and title_like(line)


def _number(line: str) -> int | None:
    """The first number of a line, in digits or as a Roman numeral."""
    if m := _DIGITS.search(line):
        return int(m[0])
    if m := _NUMERAL.search(line):
        values = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}[c] for c in m[0].lower()]
        return sum(-v if any(w > v for w in values[k + 1 :]) else v for k, v in enumerate(values))
    return None


class Furniture:
    """Tells running headers, footers and page numbers from text, by a line and the lines around it."""

    def __init__(self, statistics: LineStatistics, corrector: Corrector):
        self.statistics, self.corrector = statistics, corrector
        self.model: BoostedTrees | None = None

    def _template(self, line: str) -> str:
        """The line's template with misread words set right, if that makes it a frequent one."""
        plain = template(line)
        if plain and plain not in self.statistics.lines:
            words = [w for w in _WORD.findall(line.split(" | ")[0]) if not w.isdigit()]
            right = " ".join(self.corrector.correct(w) or w.lower() for w in words) if len(words) <= 9 else ""
            if right in self.statistics.lines:
                return right
        return plain

    def features(self, rows: list[str], at: list[int], own: Counter) -> np.ndarray:
        """Features of the lines ``at`` of a record's stripped lines."""
        full = [i for i, r in enumerate(rows) if r]
        place = {i: k for k, i in enumerate(full)}
        usual = float(sorted(len(rows[i]) for i in full)[len(full) // 2]) or 1.0
        out = []
        for i in at:
            line, k = rows[i], place[i]
            before, after = rows[full[k - 1]] if k else "", rows[full[k + 1]] if k + 1 < len(full) else ""
            # another such line may stand between
            before2 = rows[full[k - 2]] if k > 1 and is_candidate(before) else before
            after2 = rows[full[k + 2]] if k + 2 < len(full) and is_candidate(after) else after
            words = [w for w in _WORD.findall(line) if not w.isdigit()]
            breaks_in = bool(before2) and not _ENDED.search(before2) and bool(after2) and after2[0].islower()
            out.append((
                _NUMBERED.fullmatch(line) is not None, _BESIDE.match(line) is not None, len(words), len(line) / usual,
                sum(w[0].isupper() for w in words) / (len(words) or 1), line.isupper(), breaks_in,
                k == 0, k == len(full) - 1, np.log1p(self.statistics.lines.get(self._template(line), 0)), min(own[self._template(line)], 4),
                bool(before) and not _ENDED.search(before), bool(after) and after[0].islower(),
                _NUMBERED.fullmatch(before) is not None if before else False, _NUMBERED.fullmatch(after) is not None if after else False,
                _ENDED.search(line) is not None, i > 0 and not rows[i - 1], i + 1 < len(rows) and not rows[i + 1],
            ))
        return np.array(out, float).reshape(len(at), 18)

    def _candidates(self, rows: list[str]) -> tuple[list[int], Counter]:
        at = [i for i, r in enumerate(rows) if r and is_candidate(r)]
        return at, Counter(self._template(rows[i]) for i in at)

    def fit(self, texts: list[str]) -> Furniture:
        """Fit to a sample, labelled by what comes again.

        A line that comes again in its record but for its number, or that many
        records have, is furniture; so are numbers alone that go up through a
        record. A line that comes once in all is none, nor is a number that
        goes down. What is neither, as a page number of a single page, has no label.
        """
        x, y = [], []
        for text in texts:
            rows = [r.strip() for r in text.split("\n")]
            at, own = self._candidates(rows)
            if not at:
                continue
            templates = {i: "" if _NUMBERED.fullmatch(rows[i]) else self._template(rows[i]) for i in at}
            alone = [(i, _number(rows[i])) for i in at if not templates[i] and _number(rows[i]) is not None]
            rises = {i for (i, n), (_, after) in zip(alone, alone[1:]) if after > n} | {i for (_, before), (i, n) in zip(alone, alone[1:]) if before < n}
            falls = {i for (i, n), (_, after) in zip(alone, alone[1:]) if after <= n}
            labels: list[float | None] = []
            for i in at:
                t = templates[i]
                if t:
                    again = own[t] > 1 or self.statistics.lines.get(t, 0) > 0
                    labels.append(1.0 if again and not _ENDED.search(rows[i]) else 0.0)
                else:
                    labels.append(1.0 if i in rises and i not in falls else 0.0 if i in falls or _ENDED.search(rows[i]) else None)
            keep = [k for k, label in enumerate(labels) if label is not None]
            if keep:
                x.append(self.features(rows, at, own)[keep])
                y += [labels[k] for k in keep]
        self.model = BoostedTrees(rounds=40).fit(np.concatenate(x) if x else np.zeros((0, 18)), np.array(y))
        return self

    @staticmethod
    def _plain_number(rows: list[str], i: int) -> bool:
        """A page number on its own; a sentence's last number is none."""
        line = rows[i]
        if not _NUMBERED.fullmatch(line) or line[0] == "(" and line[-1] != ")":
            return False
        return not line.endswith((".", ",", ";", ":", "!", "?"))

    def find(self, rows: list[str]) -> set[int]:
        """The record's lines that are furniture."""
        at, own = self._candidates(rows)
        if not at:
            return set()
        p = self.model.probability(self.features(rows, at, own))
        sure = {i for i in at if self._plain_number(rows, i) or _BESIDE.match(rows[i])}
        likely = {i for i, q in zip(at, p) if q >= 0.5}
        found = likely & sure
        # a heading is furniture only if it comes again, here or in other records, and stands at an edge or beside a number
        full = [i for i, r in enumerate(rows) if r]
        place = {i: k for k, i in enumerate(full)}
        edges: set[str] = set()
        for i in likely - sure:
            t, k = self._template(rows[i]), place[i]
            beside = {full[k - 1] if k else -1, full[k + 1] if k + 1 < len(full) else -1}
            if t and (t in self.statistics.lines or own[t] > 1) and (k in (0, len(full) - 1) or beside & found):
                edges.add(t)
        return found | {i for i in likely - sure if self._template(rows[i]) in edges}


class Joiner:
    """Tells whether a mark at a line's end breaks a word."""

    def __init__(self, vocabulary: Vocabulary, statistics: LineStatistics):
        self.vocabulary, self.statistics = vocabulary, statistics
        self.model: BoostedTrees | None = None
        self.firsts = Counter()
        for c, n in statistics.compounds.items():
            self.firsts[c.split("-")[0]] += n

    def _known(self, word: str) -> float:
        return np.log1p(self.vocabulary.counts.get(word, 0))

    def features(self, head: str, mark: str, tail: str) -> tuple:
        a, b = head.lower(), tail.lower()
        plain = mark == "-"
        return (
            plain, self._known(a + b), self._known(a), self._known(b), np.log1p(self.statistics.compounds.get(f"{a}-{b}", 0)), np.log1p(self.firsts.get(a, 0)),
            tail[0].islower(), tail[0].isdigit(), head[-1].isdigit(), len(a), len(b), head.isupper(),
        )

    def fit(self, seed: int = 3) -> Joiner:
        """Fit to vocabulary words broken anywhere, and to compounds broken at their own hyphen."""
        rng = random.Random(seed)
        whole = [w for w in self.vocabulary.counts if len(w) >= 5 and w.isalpha()]
        x, y = [], []
        for w in rng.sample(whole, min(SAMPLE_WORDS, len(whole))):
            i = rng.randint(2, len(w) - 2)
            head = w[:i].capitalize() if rng.random() < 0.2 else w[:i]
            # the word may be misread, or rare
            other = Vocabulary({}, 1) if rng.random() < 0.15 else self.vocabulary
            row = list(self.features(head, rng.choice("-‐¬"), w[i:]))
            if other is not self.vocabulary:
                row[1] = 0.0
            x.append(row)
            y.append(1.0)
        compounds = sorted(self.statistics.compounds)
        for c in rng.sample(compounds, min(SAMPLE_WORDS, len(compounds))):
            head, _, tail = c.partition("-")
            for h in (head, head.capitalize()):
                x.append(list(self.features(h, "-", tail)))
                y.append(0.0)
        self.model = BoostedTrees(rounds=40).fit(np.array(x, float).reshape(len(x), 12), np.array(y))
        return self

    def breaks(self, head: str, mark: str, tail: str | None) -> bool:
        """Whether ``head`` and ``tail`` are one word; without a tail, whether the head is the first part of one."""
        if head.isdigit():
            return False
        if tail is None:
            a = head.lower()
            return mark != "-" or not (self.firsts.get(a, 0) > 0 or self._known(a) > 0 and a not in self._beginnings())
        if not tail[0].islower() and not head.isupper():
            return False
        return bool(self.model.probability(np.array([self.features(head, mark, tail)], float))[0] >= 0.5)

    def _beginnings(self) -> set[str]:
        if not hasattr(self, "_starts"):
            self._starts = {w[:n] for w in self.vocabulary.counts for n in range(2, len(w) - 1)}
        return self._starts


# records --------------------------------------------------------------------


@dataclass
class Repair:
    """What a record's noise is, and its text without it."""

    noise: set[str]
    text: str


class Seen(dict):
    """Of words met before: whether they are known, and what was meant, written as the word is; None for a word that is right."""

    def __init__(self, corrector: Corrector):
        super().__init__()
        self.corrector = corrector

    def __reduce__(self) -> tuple:
        return Seen, (self.corrector,)

    def __missing__(self, word: str) -> tuple[bool, str | None]:
        low, out, vocabulary = word.lower(), None, self.corrector.vocabulary
        known = low in vocabulary
        if not known:
            sharp = word.isupper() and "ss" in low and any(low[:i] + "ß" + low[i + 2 :] in vocabulary for i in range(len(low)) if low.startswith("ss", i))
            if not sharp and (meant := self.corrector.correct(word)) is not None:
                out = meant.upper() if word.isupper() and len(word) > 1 else meant.capitalize() if word[0].isupper() else meant
        if len(self) > 300_000:
            self.clear()
        self[word] = known or word[0].isdigit(), out
        return self[word]


class Cleaner:
    """Finds and repairs the noise of records."""

    def __init__(self, corrector: Corrector, furniture: Furniture, joiner: Joiner):
        self.corrector, self.furniture, self.joiner = corrector, furniture, joiner
        self.seen = Seen(corrector)

    def clean(self, text: str, skip: frozenset[str] | set[str] = frozenset()) -> Repair:
        """Repair a text whose characters are right. Words in ``skip``, in lower case, are left as they are."""
        noise: set[str] = set()
        rows = [r.strip() for r in text.replace("\r\n", "\n").split("\n")]
        dropped = self.furniture.find(rows)
        if dropped:
            noise.add("furniture")
            if any(self.seen[w][1] for i in dropped for w in _WORD.findall(rows[i])):
                noise.add("chars")
        filled = [i for i, r in enumerate(rows) if r and i not in dropped]
        after = dict(zip(filled, filled[1:]))
        taken: dict[int, int] = {}
        kept: list[str] = []
        torn: set[str] = set()  # first halves whose second ones are elsewhere
        for i, row in enumerate(rows):
            if i in dropped:
                continue
            if i in taken:  # its beginning went to the line before
                row = row[taken[i] :].lstrip()
            if row and row[-1] in MARKS and (m := _BROKEN.search(row)):
                follower = after.get(i)
                tail = _STARTS.match(rows[follower]) if follower is not None else None
                if (tail or follower is None) and self.joiner.breaks(m[1], m[2], tail[0] if tail else None):
                    noise.add("hyphen")
                    if tail:
                        rest = rows[follower].split(None, 1)[0]
                        row = row[: m.start(2)] + rest
                        taken[follower] = len(rest)
                    else:
                        torn.add(m[1].lower())
            kept.append(row)
        body = "\n".join(kept)
        words = set(_WORD.findall(body))
        right: dict[str, str] = {}
        found = list(map(self.seen.__getitem__, words))
        # where most words are unknown, there is no language to correct by
        if 2 * sum(known for known, _ in found) >= len(words):
            right = {w: r for w, (_, r) in zip(words, found) if r is not None and w.lower() not in skip and w.lower() not in torn}
        # a text may begin with the rest of a word that the page before broke, which is like many words
        first = _STARTS.match(rows[filled[0]]) if filled else None
        if first and first[0] in right and first[0][0].islower() and self.corrector.confusions.known_steps(first[0], right[first[0]]) is None:
            del right[first[0]]
        if right:
            noise.add("chars")
            body = _WORD.sub(lambda m: right.get(m[0], m[0]), body)
        return Repair(noise, self._paragraphs(body))

    @staticmethod
    def _paragraphs(text: str) -> str:
        """Lines of a paragraph put together; blank lines part paragraphs, but not within a sentence."""
        out: list[str] = []
        for part in re.split(r"\n\s*\n", text):
            joined = " ".join(r for r in part.split("\n") if r)
            if not joined:
                continue
            if out and not re.search(r"[.!?…。．:;][”\"’»)\]]*$", out[-1]) and joined[0].islower():
                out[-1] += " " + joined
            else:
                out.append(joined)
        return "\n\n".join(out)
