"""Languages of texts and of their paragraphs, by the nearest centroid.

A text is a normalised TF-IDF vector of hashed character n-grams. Each language
has several centroids, the means of clusters of its labelled texts, so that
texts of different make find one near them. A text gets the language of the
centroid with the largest cosine; one farther from it than nearly all texts of
its length that were held out gets none. The labels of the texts that the
centroids are fitted to may be wrong: texts nearer to another language's centre
are left out. A fit to a sample (`fit`) only tells where the clusters begin:
frequencies, means and least cosines are then taken over all labelled texts, by
sums over any number of parts of them. Texts are taken many at a time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# What names each language, as code or English or own name.
NAMES = {
    "en": ["en", "eng", "english"],
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "es": ["es", "spa", "esp", "spanish", "español", "espanol", "castilian"],
    "pt": ["pt", "por", "portuguese", "português", "portugues"],
    "nl": ["nl", "nld", "dut", "dutch", "nederlands", "flemish"],
    "ko": ["ko", "kor", "korean", "한국어"],
    "ru": ["ru", "rus", "russian", "русский"],
}
_CODES = {name: code for code, names in NAMES.items() for name in names}
LANGUAGES = list(NAMES)

#: Labelled texts of each language that the clusters of all labelled texts begin with, at most.
SAMPLE_ROWS = 300
CLUSTERS = 3
#: So often all labelled texts go to their nearest centroid and the centroids to their texts' means.
ROUNDS = 2
BITS = 15
SIZE = 1 << BITS
#: One labelled text in so many is held out to measure how near texts are to their language ...
HELD_OUT = 5
#: ... by their letters: fewer than these, and more. Of so small a share the cosine is less than REJECT_SHARE of it gives.
LENGTHS, REJECT_QUANTILE, REJECT_SHARE = (15, 30, 60, 120, 400), 0.005, 0.8
#: So many pieces of a length tell for a centroid by themselves.
LEAST_PIECES = 50
#: A script that one language alone is written in makes up for a cosine down to this share of the least one.
SCRIPT_SHARE = 0.25
#: Means are added up in whole numbers of this share, so that the sum does not depend on the order; cosines of pieces are counted by this share.
_UNIT, COSINE_UNIT = 2.0**-30, 1e-4
#: Nothing below this cosine is like any language; more than the other is never asked for, however alike the sample is.
LEAST_COSINE, MOST_ASKED = 0.02, 0.2
#: Parts of texts that are measured at once; few, so that their n-grams take little memory.
_PARTS = 512
#: A paragraph decides for itself if its lead is this large. On sf0.1 99 % of even 4 to 9 letters with it are told right.
MIN_LEAD = 0.05
#: With fewer letters it must end as a sentence does: running headers and page numbers do not count.
HEADING_LETTERS = 24
_NOT_LETTERS = re.compile(r"[\W\d_]+")
# Scripts that one language alone is written in.
_SCRIPTS = [("ko", re.compile("[가-힣]")), ("ru", re.compile("[а-яё]", re.I))]
_ENDED = re.compile(r"[.!?…。．][”\"’»)\]]*$")
_BLANK = re.compile(r"\n[ \t\r]*(?:\n[ \t\r]*)+")


def named(label: str | None) -> str | None:
    """The language that a label names, in any of its spellings and regional forms; None if it names none of the eight."""
    words = re.split(r"[^\w]+|_", (label or "").strip().lower())
    return _CODES.get(words[0]) if words and words[0] else None


def named_column(label: str) -> Column:
    """The same of a column, by built-in functions."""
    word = F.regexp_extract(F.lower(F.trim(label)), r"^([\p{L}]+)", 1)
    out = F.lit(None).cast("string")
    for code, names in NAMES.items():
        out = F.when(word.isin(names), F.lit(code)).otherwise(out)
    return out


def paragraphs(text: str) -> list[str]:
    """What blank lines separate, without blank ones."""
    return [p for p in _BLANK.split(text.replace("\r\n", "\n").strip("\n\r\t ")) if p.strip()]


def _is_letter() -> np.ndarray:
    """Whether each character of the basic plane is a letter."""
    every = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x10000)))
    flags = np.ones(len(every) + 1, bool)
    for m in _NOT_LETTERS.finditer(every):
        flags[m.start() : m.end()] = False
    flags[-1] = False  # stands for all others
    return flags


_LETTER = _is_letter()


@dataclass
class Grams:
    """Hashed n-grams of one to four characters of several parts, words padded with spaces: part, key and weight, by part; and letters of each part."""

    part: np.ndarray
    key: np.ndarray
    weight: np.ndarray
    letters: np.ndarray

    @classmethod
    def of(cls, parts: list[str]) -> Grams:
        """The n-grams of parts, of _PARTS at a time."""
        if len(parts) <= _PARTS:
            return cls._of_few(parts)
        some = [cls._of_few(parts[low : low + _PARTS]) for low in range(0, len(parts), _PARTS)]
        return cls(
            np.concatenate([g.part + k * _PARTS for k, g in enumerate(some)]), np.concatenate([g.key for g in some]), np.concatenate([g.weight for g in some]), np.concatenate([g.letters for g in some]),
        )

    @classmethod
    def _of_few(cls, parts: list[str]) -> Grams:
        # a tab stands before each part; it is no letter, so that it pads the first word
        text = "\t" + "\t".join(p.replace("\t", " ") for p in parts).lower() + "\t" if parts else "\t"
        c = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
        letter = _LETTER[np.minimum(c, 0x10000)]
        if (far := c > 0xFFFF).any():
            others, which = np.unique(c[far], return_inverse=True)
            letter[far] = np.array([chr(o).isalpha() for o in others])[which]
        begins = c == 9
        # runs of what is no letter are one space, the end of a part and the beginning of the next are two
        kept = letter | np.append(False, letter[:-1]) | begins
        owner = np.cumsum(begins) - 1
        letters = np.bincount(owner[letter], minlength=len(parts) + 1)[: len(parts)]
        c, owner, begins, letter = c[kept], owner[kept], begins[kept], letter[kept]
        kept = letter | begins | ~np.append(begins[1:], False)  # no space before a part's end
        c, owner, begins, letter = c[kept], owner[kept], begins[kept], letter[kept]
        at = np.flatnonzero(begins[1:]) + 1
        plain = np.where(letter, c, 32).astype(np.uint64)
        # the space that ends a part
        plain, owner = np.insert(plain, at, 32), np.insert(owner, at, owner[at] - 1)
        inside = owner < len(parts)
        plain, owner = plain[inside], owner[inside]
        filled = letters[owner] > 0
        plain, owner = plain[filled], owner[filled].astype(np.uint64)
        keys, h = [], np.zeros(len(plain), np.uint64)
        for n in range(4):
            if len(plain) <= n:
                break
            h = (h[:-1] if n else h) * np.uint64(1_000_003) + plain[n:] + np.uint64(1)
            whole = owner[n:] == owner[: len(owner) - n]
            keys.append(((owner[n:][whole] << np.uint64(BITS)) | ((h[whole] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS))).astype(np.uint32))
        every = np.concatenate(keys) if keys else np.empty(0, np.uint32)
        every.sort()
        first = np.append(True, every[1:] != every[:-1]) if len(every) else np.empty(0, bool)
        starts = np.flatnonzero(first)
        counts = np.diff(np.append(starts, len(every)))
        found = every[starts].astype(np.int64)
        return cls((found >> BITS).astype(np.int32), (found & (SIZE - 1)).astype(np.int32), (1.0 + np.log(counts)).astype("f4"), letters)

    def taken(self, parts: np.ndarray) -> tuple[Grams, np.ndarray]:
        """The grams of some parts, given in order, and where they stood."""
        number = np.full(len(self.letters), -1)
        number[parts] = np.arange(len(parts))
        at = np.flatnonzero(number[self.part] >= 0)
        return Grams(number[self.part[at]], self.key[at], self.weight[at], self.letters[parts]), at

    def weighted(self, idf: np.ndarray) -> np.ndarray:
        """Normalised TF-IDF weights."""
        v = self.weight * idf[self.key]
        norm = np.sqrt(np.bincount(self.part, weights=v * v, minlength=len(self.letters)))
        return v / np.maximum(norm, 1e-12)[self.part] if len(v) else v

    def cosines(self, unit: np.ndarray, centers: np.ndarray) -> np.ndarray:
        """Cosines of each part with each column of ``centers``."""
        out = np.zeros((len(self.letters), centers.shape[1]), "f4")
        if len(unit) and centers.shape[1]:
            starts = np.flatnonzero(np.append(True, self.part[1:] != self.part[:-1]))
            ends, unit, centers = np.append(starts[1:], len(unit)).tolist(), unit.astype("f4"), np.ascontiguousarray(centers, "f4")
            # a part at a time, so that its rows fit into the cache
            for part, a, b in zip(self.part[starts].tolist(), starts.tolist(), ends):
                np.dot(unit[a:b], centers.take(self.key[a:b], axis=0), out=out[part])
        return out


def by_script(text: str) -> str | None:
    """The language that most letters' script tells, if more than one word is in it: one alone may be a page number's."""
    words = [w for w in _NOT_LETTERS.split(text) if w]
    letters = sum(map(len, words))
    for lang, script in _SCRIPTS:
        if 2 * len(script.findall(text)) > letters and sum(script.search(w) is not None for w in words) > 1:
            return lang
    return None


@dataclass
class Centroids:
    """``centers`` has a column for each centroid, ``languages`` its language's index, ``least`` the least cosine for each of LENGTHS and beyond."""

    idf: np.ndarray
    centers: np.ndarray
    languages: np.ndarray
    least: np.ndarray

    def scores(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The largest cosine of each part with each language, the least that does not reject it, and the part's letters."""
        cosines, letters = [np.zeros((0, len(self.languages)), "f4")], [np.zeros(0, int)]
        for low in range(0, len(parts), _PARTS):
            grams = Grams.of(parts[low : low + _PARTS])
            cosines.append(grams.cosines(grams.weighted(self.idf), self.centers))
            letters.append(grams.letters)
        found, size = np.concatenate(cosines), np.concatenate(letters)
        best, least = np.zeros((len(found), len(LANGUAGES))), np.full((len(found), len(LANGUAGES)), np.inf)
        bound = self.least[:, np.searchsorted(LENGTHS, size, "right")]
        for k in range(len(self.languages)):
            lang, nearer = self.languages[k], found[:, k] > best[:, self.languages[k]]
            best[nearer, lang] = found[nearer, k]
            least[nearer, lang] = bound[k, nearer]
        return best, least, size


def _pieces(text: str) -> list[str]:
    """A text, its paragraphs, and their sentences and lines: what may be judged as one part."""
    out = [text]
    for paragraph in paragraphs(text):
        out += [paragraph, *re.split(r"(?<=[.!?。])\s+|\n", paragraph)]
    return [p for p in dict.fromkeys(out) if p.strip()]


def idf_of(frequency: np.ndarray, texts: float) -> np.ndarray:
    """The weight of each key, by the number of texts that have it."""
    return np.log((1 + texts) / (1 + frequency)) + 0.1


def _has(masks: np.ndarray, languages: np.ndarray | int) -> np.ndarray:
    """Whether masks, with a bit for each language, have the language beside them."""
    return (masks >> languages) & 1 > 0


def frequencies(texts: list[str], masks: np.ndarray) -> np.ndarray:
    """How many of the texts of each language have each key; parts of them add up."""
    out = np.zeros((len(LANGUAGES), SIZE), np.int64)
    for low in range(0, len(texts), _PARTS):
        grams = Grams.of(texts[low : low + _PARTS])
        some = masks[low : low + _PARTS]
        for k in np.flatnonzero([_has(some, k).any() for k in range(len(LANGUAGES))]):
            out[k] += np.bincount(grams.key[_has(some, k)[grams.part]], minlength=SIZE)
    return out


def even_idf(frequency: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """`idf_of` the frequencies in all texts of each language. A language weighs as SAMPLE_ROWS texts if it has more, lest its share of the corpus tells."""
    weights = np.minimum(texts, SAMPLE_ROWS)
    return idf_of((weights / np.maximum(texts, 1)) @ frequency, weights.sum())


def sums(model: Centroids, texts: list[str], masks: np.ndarray) -> np.ndarray:
    """Of each centroid, the sum of the texts nearest to it, of those that its language is among the labels of, in `_UNIT`; parts of them add up."""
    columns = len(model.languages)
    out = np.zeros(columns * SIZE, np.int64)
    for low in range(0, len(texts), _PARTS):
        grams = Grams.of(texts[low : low + _PARTS])
        unit = grams.weighted(model.idf)
        cosines = grams.cosines(unit, model.centers)
        nearest = cosines.argmax(axis=1)
        kept = _has(masks[low : low + _PARTS], model.languages[nearest]) & (cosines.max(axis=1) > 0)
        at = kept[grams.part]
        # sums of whole numbers are exact
        out += np.bincount(nearest[grams.part[at]] * SIZE + grams.key[at], weights=np.rint(unit[at] / _UNIT), minlength=columns * SIZE).astype(np.int64)
    return out.reshape(columns, SIZE)


def moved(model: Centroids, total: np.ndarray) -> Centroids:
    """The centroids at the means of their texts; one without any stays."""
    norm = np.linalg.norm(total.astype(float), axis=1)
    means = (total / np.maximum(norm, 1.0)[:, None]).T
    return replace(model, centers=np.ascontiguousarray(np.where(norm > 0, means, model.centers), "f4"))


def held_pieces(model: Centroids, texts: list[str], masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The centroid, the length's place and the cosine, in COSINE_UNIT, of held-out texts' pieces that count in `_least`.

    Texts that are nearer to another language than their labels' do not count.
    """
    found = []
    for low in range(0, len(texts), _PARTS):
        several = [_pieces(t) for t in texts[low : low + _PARTS]]
        grams, unit = (g := Grams.of([p for own in several for p in own])), g.weighted(model.idf)
        cosines = grams.cosines(unit, model.centers)
        nearest, top = cosines.argmax(axis=1), cosines.max(axis=1)
        languages, sizes = model.languages[nearest], np.array([len(own) for own in several])
        whole = languages[np.cumsum(sizes) - sizes]  # a text is the first of its pieces
        right = _has(masks[low : low + _PARTS], whole)
        counted = (grams.letters > 0) & np.repeat(right, sizes) & (languages == np.repeat(whole, sizes))
        bins = np.searchsorted(LENGTHS, grams.letters, "right")
        found.append((nearest[counted], bins[counted], np.rint(top[counted] / COSINE_UNIT).astype(int)))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, int),) * 3


def fit(texts: list[tuple[str, str]], seed: int = 7) -> Centroids:
    """Centroids of ``(text, language)`` rows. A language without rows gets no centroid."""
    rng = np.random.default_rng(seed)
    labels = np.array([LANGUAGES.index(lang) for _, lang in texts], int)
    grams = Grams.of([t for t, _ in texts])
    frequency = np.bincount(grams.key, minlength=SIZE)
    idf = idf_of(frequency, len(texts))
    unit = grams.weighted(idf)
    bounds = np.searchsorted(grams.part, np.arange(len(texts) + 1))

    def mean(rows: np.ndarray) -> np.ndarray:
        center = np.zeros(SIZE)
        for i in rows:
            part = slice(bounds[i], bounds[i + 1])
            center[grams.key[part]] += unit[part]
        return center / (np.linalg.norm(center) or 1.0)

    kept = np.arange(len(texts))
    present = [k for k in range(len(LANGUAGES)) if (labels == k).any()]
    for _ in range(3):  # leave out texts that are nearer to another language's centre
        if not present:
            break
        centers = np.stack([mean(kept[labels[kept] == k]) for k in present], axis=1)
        nearest = np.array(present)[grams.cosines(unit, centers.astype("f4")).argmax(axis=1)]
        kept = np.flatnonzero(nearest == labels)
    columns, languages, pieces, owners = [], [], [], []
    for k in present:
        rows = kept[labels[kept] == k]
        if not len(rows):
            continue
        held = rows[::HELD_OUT] if len(rows) >= 2 * HELD_OUT else rows
        fitted = np.setdiff1d(rows, held) if len(rows) >= 2 * HELD_OUT else rows
        own, at = grams.taken(fitted)
        clusters = min(CLUSTERS, len(fitted))
        centers = np.stack([mean(rng.choice(fitted, 1)) for _ in range(clusters)], axis=1)
        for _ in range(8):  # k-means on the sphere
            nearest = own.cosines(unit[at], centers.astype("f4")).argmax(axis=1)
            centers = np.stack([mean(fitted[nearest == j]) if (nearest == j).any() else centers[:, j] for j in range(clusters)], axis=1)
        columns.append(centers)
        languages += [k] * clusters
        parts = [p for i in held for p in _pieces(texts[i][0])]
        pieces += parts
        owners += [k] * len(parts)
    centers = (np.concatenate(columns, axis=1) if columns else np.zeros((SIZE, 0))).astype("f4")
    least = _least(pieces, np.array(owners, int), idf, centers, np.array(languages, int))
    return Centroids(idf.astype("f4"), centers, np.array(languages, int), least)


def _least(pieces: list[str], owners: np.ndarray, idf: np.ndarray, centers: np.ndarray, languages: np.ndarray) -> np.ndarray:
    """Of each centroid, for each of LENGTHS and beyond, the cosine that hardly any of the held-out pieces nearest to it is below.

    Pieces nearer to another language than their text's may be foreign and do
    not count. Where there are too few, all centroids' pieces of that length do.
    """
    if not len(pieces) or not len(languages):
        return bounds({}, {}, len(languages))
    grams = Grams.of(pieces)
    cosines = grams.cosines(grams.weighted(idf), centers)
    nearest, top = cosines.argmax(axis=1), cosines.max(axis=1)
    bins = np.searchsorted(LENGTHS, grams.letters, "right")
    counted = (grams.letters > 0) & (languages[nearest] == owners)
    own, every = {}, {}
    for b in range(len(LENGTHS) + 1):
        if (here := counted & (bins == b)).any():
            every[b] = float(np.quantile(top[here], REJECT_QUANTILE))
        for k in range(len(languages)):
            if (of := here & (nearest == k)).any():
                own[k, b] = int(of.sum()), float(np.quantile(top[of], REJECT_QUANTILE))
    return bounds(own, every, len(languages))


def bounds(own: dict[tuple[int, int], tuple[int, float]], every: dict[int, float], columns: int) -> np.ndarray:
    """Least cosines, by the number and the quantile of the pieces of each centroid and length, and the quantile of all of each length."""
    out = np.full((columns, len(LENGTHS) + 1), LEAST_COSINE)
    bound = lambda quantile: min(MOST_ASKED, max(LEAST_COSINE, REJECT_SHARE * quantile))
    for b in range(out.shape[1] if columns else 0):
        common = bound(every[b]) if b in every else out[:, b - 1].min() if b else LEAST_COSINE
        for k in range(columns):
            n, quantile = own.get((k, b), (0, 0.0))
            out[k, b] = bound(quantile) if n >= LEAST_PIECES else common
    return out


def identify_all(model: Centroids, texts: list[str]) -> list[tuple[str | None, float, list[tuple[str | None, float]]]]:
    """Of each text, its language and confidence, and those of each of its paragraphs.

    The confidence is the lead of the best language's cosine over the next one's, as a share.
    Of several paragraphs each decides for itself, by its script or a clear lead;
    one that does neither takes the language of most of the text.
    """
    parts = [paragraphs(t) for t in texts]
    flat, first = [], []
    for text, own in zip(texts, parts):
        first.append(len(flat))
        flat += own if len(own) > 1 else [text]
    scores, least, letters = model.scores(flat)
    order = np.argsort(-scores, axis=1, kind="stable")
    rows = np.arange(len(flat))
    top, second = scores[rows, order[:, 0]], scores[rows, order[:, 1]]
    best = np.where((top > 0) & (top >= least[rows, order[:, 0]]), order[:, 0], -1)
    lead = top - second
    sure = np.where(top > 0, lead / np.maximum(top, 1e-12), 0.0)
    out, unclear = [], []
    for n, (text, own) in enumerate(zip(texts, parts)):
        at = first[n]
        if len(own) < 2:
            name = LANGUAGES[best[at]] if best[at] >= 0 else None
            out.append((name, float(sure[at]), [(name, float(sure[at]))] * len(own)))
            continue
        found: list[tuple[int, float]] = []
        mass, trust = np.zeros(len(LANGUAGES)), np.zeros(len(LANGUAGES))
        for i, part in enumerate(own, at):
            k = int(best[i])
            certain = k >= 0 and lead[i] >= MIN_LEAD and (letters[i] >= HEADING_LETTERS or _ENDED.search(part.rstrip()) is not None)
            if (script := by_script(part)) and scores[i, LANGUAGES.index(script)] >= SCRIPT_SHARE * least[i, LANGUAGES.index(script)]:
                k, certain = LANGUAGES.index(script), True
            found.append((k if certain else -1, float(sure[i])))
            if certain:
                mass[k] += letters[i]
                trust[k] += letters[i] * sure[i]
        main = int(mass.argmax()) if mass.any() else -1
        if main < 0:  # no paragraph decides for itself
            unclear.append(n)
        out.append((main, float(trust[main] / mass[main]) if main >= 0 else 0.0, found))
    if unclear:
        whole = identify_all(model, [" ".join(parts[n]) for n in unclear])
        for n, (name, confidence, _) in zip(unclear, whole):
            out[n] = (LANGUAGES.index(name) if name else -1, confidence, out[n][2])
    name_of = lambda k: LANGUAGES[k] if isinstance(k, int) and k >= 0 else None
    return [row if row[0] is None or isinstance(row[0], str) else (name_of(row[0]), row[1], [(name_of(k) or name_of(row[0]), c) for k, c in row[2]]) for row in out]


def identify(model: Centroids, text: str) -> tuple[str | None, float, list[tuple[str | None, float]]]:
    """`identify_all` of one text."""
    return identify_all(model, [text])[0]
