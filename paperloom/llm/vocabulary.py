"""Word frequencies of the whole corpus, and the words frequent enough to be its vocabulary.

Words are counted by the language that their texts are labelled with, and a
word belongs to the vocabulary if it is frequent enough in one of them: so a
language with a small part of the corpus keeps the words it would have on its
own, whatever the size of the corpus.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word belongs to the vocabulary if at least this share of a language's words is it: this defines what a word is
#: in a corpus of any size, and the vocabulary never holds more than 1 / MIN_SHARE words for each language ...
MIN_SHARE = 2e-5
#: ... and if it occurs this often: less says nothing in a small corpus.
MIN_COUNT = 3

#: A letter is usual if the words that hold it have this share.
LETTER_SHARE = 3e-4

WORD = re.compile(r"[^\W_]+")
_EDGES = " \t\r\n\f.,;:!?…\"'“”„‟‘’‚«»‹›()[]{}<>|*#=+~`^&@%/\\_-‐–—•·§"
_INNER = re.compile(r"['’/_\-‐–.,:;]+")
_FLUSH = 400_000


def tokens(text: str) -> list[str]:
    """The text split at plain white space only: other space characters may be part of damaged text."""
    return text.replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" ")


_BREAK = re.compile(r"[-‐‑¬\xad][ \t\r]*\n\s*")


def without_broken(text: str) -> str:
    """The text without words broken at a line's end, and what the next line goes on with: neither half is a word."""
    parts = _BREAK.split(text)
    for k, part in enumerate(parts):
        first, last = 0, len(part)
        while k and first < last and part[first].isalnum():
            first += 1
        while k < len(parts) - 1 and last > first and part[last - 1].isalnum():
            last -= 1
        parts[k] = part[first:last]
    return " ".join(parts)


def pieces(token: str) -> list[str]:
    """The lower-case words of a token that are letters and digits throughout; damaged tokens are not taken apart."""
    return [p.lower() for p in _pieces(token)]


def _pieces(token: str) -> list[str]:
    if token.isalpha():
        return [token]
    parts = _INNER.split(token.strip(_EDGES))
    if "–" in token and any(len(p) == 1 and p > "\x7f" for p in parts):  # the dash is what damage made of a letter's second byte
        return []
    return [p for p in parts if p.isalnum() and not p.isdigit()]


def capitals(piece: str, word: str) -> int:
    """Which places of a piece are capitals, as bits; 0 if its lower case is not as long, or very long."""
    return sum(1 << i for i, (a, b) in enumerate(zip(piece, word)) if a != b) if len(piece) == len(word) < 63 else 0


def capitalised(word: str, places: int) -> str:
    return "".join(c.upper() if places >> i & 1 else c for i, c in enumerate(word))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(counts: dict[str | None, Counter]) -> pa.RecordBatch:
        languages, keys, forms, numbers = [], [], [], []
        for lang, counter in counts.items():
            words: Counter = Counter()
            written: dict[str, int] = {}
            for token, n in counter.items():
                for piece in _pieces(token):
                    word = piece.lower()
                    words[word] += n
                    if not word.isascii() and piece != word:
                        written[word] = max(capitals(piece, word), written.get(word, 0))
            words[""] = sum(words.values())
            languages += [lang] * len(words)
            keys += words
            forms += (written.get(w, 0) for w in words)
            numbers += words.values()
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in (languages, keys)), *(pa.array(c, pa.int64()) for c in (forms, numbers))], names=["lang", "word", "capitals", "n"])

    counts: dict[str | None, Counter] = defaultdict(Counter)
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                counts[lang].update(tokens(without_broken(text)))
        if sum(map(len, counts.values())) > _FLUSH:
            yield out(counts)
            counts = defaultdict(Counter)
    yield out(counts)


def word_counts(texts: DataFrame, column: str, lang: Column | None = None) -> DataFrame:
    """``lang, word, capitals, n`` over all texts; the empty word holds the number of all words of a language.

    ``word`` is in lower case, ``capitals`` tells one way of writing it if it is not ASCII: a bit for each place.
    Halves of words that are broken at a line's end are left out.
    ``lang`` tells each text's language, of which there are few; texts without
    one are a group of their own. Each task counts its own texts before
    anything is shuffled. Null and empty texts have no words; an empty table
    gives no rows.
    """
    label = F.lit(None).cast("string") if lang is None else lang
    return texts.select(F.col(column).alias("_text"), label.alias("_lang")).mapInArrow(_count, "lang string, word string, capitals bigint, n bigint").groupBy("lang", "word").agg(F.max("capitals").alias("capitals"), F.sum("n").alias("n"))


class Vocabulary:
    """Frequent words with their counts, small enough to send to every task.

    A word's cost is the negative logarithm of its share of all ``total`` words,
    or of those of the language where it is most frequent if ``shares`` tells.
    """

    def __init__(self, counts: dict[str, int], total: int, shares: dict[str, float] | None = None):
        self.counts, self.shares = counts, shares
        self.total = max(total, 1)
        self.cost = {w: -math.log(shares[w] if shares else n / self.total) for w, n in counts.items()}
        mass: Counter = Counter()
        for w in counts:
            share = shares[w] if shares else counts[w] / self.total
            for c in set(w):
                mass[c] += share
        self.letters = {c for c, share in mass.items() if share >= LETTER_SHARE}
        self._trie: dict | None = None
        self._shared: dict[type, object] = {}

    def __contains__(self, word: str) -> bool:
        return word in self.cost

    def shared(self, kind: type):
        """The ``kind(vocabulary)`` that all tasks of a process use, so that what it worked out is kept."""
        if kind not in self._shared:
            self._shared[kind] = kind(self)
        return self._shared[kind]

    def __getstate__(self) -> tuple:
        return self.counts, self.total, self.shares

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def trie(self) -> dict:
        """Nested dictionaries by character; the key '' holds a word's cost, None the least cost of the words below."""
        if self._trie is None:
            self._trie = {}
            for word, cost in self.cost.items():
                node = self._trie
                for c in word:
                    node = node.setdefault(c, {})
                    node[None] = min(cost, node.get(None, cost))
                node[""] = cost
        return self._trie

    def without(self, words: set[str]) -> Vocabulary:
        counts = {w: n for w, n in self.counts.items() if w not in words}
        return Vocabulary(counts, self.total, {w: self.shares[w] for w in counts} if self.shares else None)


def frequent_words(counts: DataFrame) -> tuple[Vocabulary, dict[str, str]]:
    """From `word_counts`, written once: the vocabulary, and ways of writing its words that are not ASCII.

    Of each language, at most 1 / MIN_SHARE words can have a share of MIN_SHARE, whatever the corpus.
    """
    totals = {r["lang"]: r["n"] for r in counts.where("word = '' and n > 0").collect()}
    total_of = F.lit(None).cast("bigint")
    for lang, n in totals.items():
        total_of = F.when(F.col("lang").eqNullSafe(lang), F.lit(n)).otherwise(total_of)
    shares = counts.where("word <> ''").withColumn("share", F.col("n") / total_of)
    rows = shares.groupBy("word").agg(F.max("capitals").alias("capitals"), F.sum("n").alias("n"), F.max("share").alias("share")).where((F.col("n") >= MIN_COUNT) & (F.col("share") >= MIN_SHARE)).collect()
    words = Vocabulary({r["word"]: r["n"] for r in rows}, sum(totals.values()), {r["word"]: r["share"] for r in rows})
    return words, {r["word"]: capitalised(r["word"], r["capitals"]) for r in rows if r["capitals"]}
