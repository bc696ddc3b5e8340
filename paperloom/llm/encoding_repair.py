"""Text decoded with the wrong character encoding: finding it and restoring it.

Noisy-channel decoding. A damaged token is turned back into the bytes it was
made from, under each wrong encoding that it may have gone through. Bytes that
were lost on the way (U+FFFD, a question mark inside a word, control characters
dropped from a multi-byte sequence) are wildcards, so the bytes form a lattice.
A Viterbi search through the lattice, with the corpus vocabulary as a trie,
finds the likeliest text; without wildcards the lattice is one path. A token is
damaged if that text is likelier than the token as it stands by more than the
damage itself is unlikely.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

from paperloom.llm.vocabulary import WORD, Vocabulary, pieces, tokens

# Pairs of the encoding that was wrongly used and the right one.
CHANNELS = [
    ("cp1252", "utf-8"), ("mac_roman", "utf-8"), ("cp1251", "utf-8"), ("koi8_r", "utf-8"), ("cp437", "utf-8"), ("cp850", "utf-8"),
    ("cp1252", "cp949"), ("mac_roman", "cp949"), ("cp1251", "cp949"),
    ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1252", "cp866"), ("mac_roman", "cp1251"),
    ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("koi8_r", "cp866"), ("cp866", "koi8_r"),
    ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"),
]

#: Cost (negative logarithm) of a damaged token: multi-byte sequences prove themselves, single bytes do not.
PRIOR_UTF8, PRIOR_OTHER = 6.0, 9.0
#: By how much a reading must be better than the token as it stands.
MARGIN = 4.0
_UNKNOWN_WORD, _ASCII_LETTER, _KNOWN_LETTER, _STRANGE = 12.0, 2.5, 4.0, 9.0
_PLAIN_MARKS = set("“”„‘’‚«»–—…•·°§¿¡")
_NEVER_INSIDE = set("“”„‚«»•°§¿¡")  # not between the letters of a word
_LOST = "�"
_LEADS = re.compile(rb"[\xc2-\xf4]")
#: States that the first search goes on from.
FEW_STATES = 32
#: What the first byte of a letter whose second one is a no-break space looks like.
_BEFORE_SPACE = frozenset("ÃÂÐÑРС├┬╨╤√¬")
_LOST_INSIDE = re.compile(r"(?<=[^\W\d_])\?(?=[^\W\d_])")
#: How unlikely a question mark is within a word, and what a lost mark within a word was: an apostrophe after or before few letters, or a letter.
_LOST_MARK = 12.0
_ELIDED = re.compile(r"\b\w{1,2}’\w|\w’(?:s|t|d|m|re|ll|ve)\b|^[^’]*[^\x00-\x7f’][^’]*$")
#: What a quoted mention of a damaged sequence looks like: the marks, then a few characters without letters of a word.
_CITED = re.compile(r"""[“"„«‘'‹(\[]([^\sA-Za-z]{1,9})[”"“»’'›)\]][.,;:!?)]*""")


def _byte_table(name: str) -> dict[str, int]:
    """Character to byte; bytes without a character are the control characters of the same number."""
    table = {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            pass
    for b in range(128, 160):
        table.setdefault(chr(b), b)
    if name == "cp1252":  # Latin-1 reads the same bytes, but for those of the control characters
        for b in range(128, 160):
            table[chr(b)] = b
    return table


_TABLES = {name: _byte_table(name) for name, _ in CHANNELS}


def to_bytes(token: str, wrong: str) -> bytes | None:
    """The bytes that ``wrong`` would have read as this token, or None."""
    try:
        return token.encode(wrong)
    except UnicodeEncodeError as problem:
        if not "\x80" <= token[problem.start] <= "\x9f":
            return None
    table = _TABLES[wrong]
    try:
        return bytes([o if (o := ord(c)) < 128 else table[c] for c in token])
    except KeyError:
        return None


def units_of(token: str, wrong: str) -> list[int | None] | None:
    """The same with None for each lost character."""
    table = _TABLES[wrong]
    try:
        return [None if c == _LOST else o if (o := ord(c)) < 128 else table[c] for c in token]
    except KeyError:
        return None


def lattice(units: list[int | None], right: str) -> tuple[list[tuple[str, int, int]], int, int] | None:
    """Steps as in `utf8_lattice` over the bytes of any encoding, None being a lost one; None if the bytes are none of it."""
    if right == "utf-8":
        return utf8_lattice(units)
    steps, whole, broken, i = [], 0, 0, 0
    while i < len(units):
        b = units[i]
        double = right == "cp949" and (b is None or b >= 0x80) and i + 1 < len(units)
        if b is not None and b < 0x80:
            steps.append((chr(b), b, b))
        elif double and (b is not None or (units[i + 1] or 0) >= 0x80):
            pair = units[i : i + 2]
            i += 1
            if None in pair:
                steps.append(("", 0xAC00, 0xD7A3))
                broken += 1
            else:
                steps.append((char := _decoded(bytes(pair), right), 0, 0))
                whole += 1
                if not char:
                    return None
        elif b is None or right == "cp949":
            steps.append(("", 0xA0, 0xFFFC))
            broken += 1
        else:
            steps.append((char := _decoded(bytes([b]), right), 0, 0))
            whole += 1
            if not char:
                return None
        i += 1
    return steps, whole, broken


def _decoded(raw: bytes, encoding: str) -> str:
    try:
        return raw.decode(encoding)
    except UnicodeDecodeError:
        return ""


def utf8_lattice(raw: bytes | list[int | None]) -> tuple[list[tuple[str, int, int]], int, int]:
    """Steps of the lattice over UTF-8 bytes some of which were lost, or are known to be (None).

    A step is ``(character, low, high)``; where bytes are missing, ``character``
    is '' and the lost one is in the range ``low..high``. Also the numbers of
    complete and of broken sequences.
    """
    steps, whole, broken, i = [], 0, 0, 0
    while i < len(raw):
        b = raw[i]
        if b is None:  # with what goes on behind it, one character
            i += 1
            while i < len(raw) and raw[i] is not None and 0x80 <= raw[i] < 0xC0:
                i += 1
            steps.append(("", 0x80, 0x10FFFF))
            broken += 1
            continue
        if b < 0x80:
            steps.append((chr(b), b, b))
            i += 1
            continue
        size = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
        if not size:  # a continuation byte whose start was lost
            steps.append(("", 0x80, 0x10FFFF))
            broken += 1
            i += 1
            continue
        rest: list[int | None] = []
        while len(rest) < size - 1 and i + 1 + len(rest) < len(raw) and ((c := raw[i + 1 + len(rest)]) is None or 0x80 <= c < 0xC0):
            rest.append(c)
        low = high = b & (0x3F >> (size - 1))
        for k in range(size - 1):
            known = k < len(rest) and rest[k] is not None
            low = low << 6 | (rest[k] & 0x3F if known else 0)
            high = high << 6 | (rest[k] & 0x3F if known else 0x3F)
        if len(rest) == size - 1 and None not in rest and low >= (0x80, 0x800, 0x10000)[size - 2] and not 0xD800 <= low < 0xE000 and low < 0x110000:
            steps.append((chr(low), low, low))
            whole += 1
        else:
            steps.append(("", max(low, 0x80), min(high, 0x10FFFF)))
            broken += 1
        i += 1 + len(rest)
    return steps, whole, broken


class Repairer:
    """Verdicts on tokens, each worked out once."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, tuple[str, float] | None] = {}
        self.channel: dict[str, tuple[tuple[str, str], ...]] = {}  # of damaged tokens: the pairs they went through

    # costs -----------------------------------------------------------------

    def _letter(self, c: str) -> float:
        return _ASCII_LETTER if c < "\x80" else _KNOWN_LETTER if c.lower() in self.vocabulary.letters else _STRANGE

    def _symbol(self, c: str) -> float:
        return 3.0 if c < "\x7f" or c in _PLAIN_MARKS else _STRANGE

    def cost(self, text: str) -> float:
        """Negative logarithm of the likelihood of a text under the corpus' words."""
        total, at = 0.0, 0
        for m in WORD.finditer(text):
            between = text[at : m.start()]
            total += _STRANGE if at and len(between) == 1 and between in _NEVER_INSIDE else sum(map(self._symbol, between))
            word, at = m[0], m.end()
            if word.isascii() and word.isdigit():
                total += 2.0 * len(word)
            elif (known := self.vocabulary.cost.get(word.lower())) is not None:
                total += known
            else:
                total += _UNKNOWN_WORD + sum(map(self._letter, word))
        return total + sum(map(self._symbol, text[at:]))

    def in_vocabulary(self, text: str) -> bool:
        """All words known, and one of them of three letters (two in Hangul)."""
        words = [w.lower() for w in WORD.findall(text) if not w.isdigit()]
        return bool(words) and all(w in self.vocabulary for w in words) and any(len(w) > 2 or len(w) > 1 and "가" <= w[0] <= "힣" for w in words)

    # search ----------------------------------------------------------------

    def viterbi(self, steps: list[tuple[str, int, int]]) -> tuple[str, float]:
        """The likeliest text through a lattice.

        A first search goes on from a few states at each step; what it finds
        bounds a second one, which drops only states that cannot become likelier.
        """
        text, cost, whole = self._search(steps, FEW_STATES, float("inf"))
        if not whole:
            better, less, _ = self._search(steps, None, cost)
            if less < cost:
                return better, less
        return text, cost

    def _search(self, steps: list[tuple[str, int, int]], most: int | None, bound: float) -> tuple[str, float, bool]:
        """The likeliest text, its cost, and whether no state was dropped. A state is a trie node, or no node inside an unknown word."""
        root = self.vocabulary.trie()
        # state id -> (cost up to the word, text, node or None, inside a word, cost of the word as an unknown one)
        states: dict[object, tuple[float, str, dict | None, bool, float]] = {"": (0.0, "", root, False, 0.0)}
        whole = True

        def ended(cost: float, node: dict | None, inside: bool, unknown: float) -> float:
            if not inside:
                return cost
            return cost + (node[""] if node is not None and "" in node else unknown)

        def least(state: tuple) -> float:
            return state[0] + (min(state[2].get(None, state[4]), state[4]) if state[3] and state[2] is not None else state[4])

        for char, low, high in steps:
            new: dict = {}
            for cost, text, node, inside, unknown in states.values():
                if char:
                    choices = [char]
                else:
                    choices = [c for c in node if c and low <= ord(c) <= high] if node is not None else []
                    choices += [c for c in "’“”–…" if low <= ord(c) <= high]
                    choices.append(_LOST)
                for c in choices:
                    if c.isalnum() and c != _LOST:
                        follow = node.get(c.lower()) if node is not None else None
                        more = (unknown if inside else _UNKNOWN_WORD) + self._letter(c)
                        key = id(follow) if follow is not None else "unknown"
                        if key not in new or new[key][0] + (new[key][4] if follow is None else 0.0) > cost + (more if follow is None else 0.0):
                            new[key] = (cost, text + c, follow, True, more)
                        if follow is not None and ("unknown" not in new or new["unknown"][0] + new["unknown"][4] > cost + more):
                            new["unknown"] = (cost, text + c, None, True, more)
                    else:
                        done = ended(cost, node, inside, unknown) + (_STRANGE if c == _LOST else self._symbol(c))
                        if "between" not in new or new["between"][0] > done:
                            new["between"] = (done, text + c, root, False, 0.0)
            if bound < float("inf"):
                new = {k: s for k, s in new.items() if least(s) < bound}
            if most is not None and len(new) > most:
                whole = False
                new = dict(sorted(new.items(), key=lambda x: least(x[1]))[:most])
            states = new
        best = ("", float("inf"))
        for cost, text, node, inside, unknown in states.values():
            done = ended(cost, node, inside, unknown)
            if done < best[1]:
                best = (text, done)
        return *best, whole

    def _readings(self, token: str):
        """Texts the token may have been, with their cost, that of the damage, and the pair of encodings."""
        raws: dict[str, bytes | None] = {}
        for pair in CHANNELS:
            wrong, right = pair
            if _LOST in token:
                units = units_of(token, wrong)
                found = lattice(units, right) if units is not None else None
                # besides the lost ones, something must have come through this pair
                if found is not None and found[1]:
                    text, cost = self.viterbi(found[0])
                    if _LOST not in text and self.in_vocabulary(text):
                        yield text, cost, (PRIOR_UTF8 if right == "utf-8" else PRIOR_OTHER) + 2.0 * found[2], pair
                continue
            if wrong not in raws:
                raws[wrong] = to_bytes(token, wrong)
            raw = raws[wrong]
            if raw is None:
                continue
            if right == "utf-8":
                if not _LEADS.search(raw):
                    continue
                steps, whole, broken = utf8_lattice(raw)
                if not broken:
                    text = "".join(s[0] for s in steps)
                    if all(map(self._assigned, text)):
                        yield text, self.cost(text), PRIOR_UTF8, pair
                elif whole and whole >= broken or broken + whole >= 2 and all(x >= 0x80 for x in raw if not chr(x).isascii()) and self._same_leads(raw):
                    yield *self.viterbi(steps), PRIOR_UTF8 + 2.0 * broken, pair
            else:
                try:
                    text = raw.decode(right)
                except UnicodeDecodeError:
                    continue
                if text != token and self.in_vocabulary(text) and all(c < "\x80" or c.isalnum() or c in _PLAIN_MARKS for c in text):
                    yield text, self.cost(text), PRIOR_OTHER, pair

    @staticmethod
    def _assigned(c: str) -> bool:
        return c < "\x80" or unicodedata.category(c) not in ("Cn", "Co")

    @staticmethod
    def _same_leads(raw: bytes) -> bool:
        """Several lead bytes of one script, as of Cyrillic or Hangul text whose other bytes were lost."""
        high = [b for b in raw if b >= 0x80]
        return len(high) >= 2 and (all(b in (0xD0, 0xD1) for b in high if b >= 0xC0) or all(0xEA <= b <= 0xED for b in high if b >= 0xC0)) and any(b >= 0xC0 for b in high)

    def _patch(self, token: str) -> tuple[str, float]:
        """A token with single lost characters, filled from the vocabulary."""
        return self.viterbi([("", 0xA0, 0xFFFC) if c == _LOST else (c, 0, 0) for c in token])

    def verdict(self, token: str) -> tuple[str, float] | None:
        """``(restored text, gain)`` of a damaged token, None of a sound one."""
        if token in self.known:
            return self.known[token]
        found = self._judge(token)
        if len(self.known) > 300_000:
            self.known.clear()
            self.channel.clear()
        self.known[token] = found
        return found

    def _judge(self, token: str) -> tuple[str, float] | None:
        if _LOST in token:  # a lone mark could be anything
            if not WORD.search(token):
                return token, _STRANGE
            text, cost = self._patch(token)
            readings = [(cost + prior, reading, pair) for reading, cost, prior, pair in self._readings(token)] if not token.isascii() else []
            if readings and min(readings)[0] < cost:
                _, text, pair = min(readings)
                self.channel[token] = (pair,)
            return text, _STRANGE
        lost = _LOST_INSIDE.search(token) is not None and "/" not in token and "=" not in token
        if token.isascii() and not lost:
            return None
        words = pieces(token)
        if words and all(w in self.vocabulary for w in words) and all(c.isalnum() or self._symbol(c) < _STRANGE for c in token):
            return None
        best, text, gain = None, token, 0.0
        pairs: list[tuple[str, str]] = []
        least, spent, tried = self.cost(token), 0.0, []
        whole = least
        for _ in range(3):  # text may have been damaged more than once, and only the last step may tell
            readings = [(cost + prior, cost, reading, pair) for reading, cost, prior, pair in self._readings(text) if reading != text]
            if not readings:
                break
            paid, cost, text, pair = min(readings)
            tried.append(pair)
            if least - spent - paid > MARGIN:
                least = spent + paid
                best, gain, pairs = text, whole - least, list(tried)
            elif pair[1] != "utf-8" or _LOST in text:
                break
            spent += paid - cost
        text = token if best is None else best
        if pairs:
            self.channel[token] = tuple(pairs)
        if lost and _LOST_INSIDE.search(text):
            filled, cost = self.viterbi([("", 0xA0, 0xFFFC) if _LOST_INSIDE.match(text, i) else (c, 0, 0) for i, c in enumerate(text)])
            gained = self.cost(text) + _LOST_MARK - cost
            if _LOST not in filled and self.in_vocabulary(filled) and _ELIDED.search(filled) and gained > PRIOR_UTF8 + MARGIN:
                best, gain = filled, gain + gained
        return (best, gain) if best is not None else None

    # records ---------------------------------------------------------------

    def _is_cited(self, token: str) -> bool:
        if not (m := _CITED.fullmatch(token)):
            return False
        inner = m[1]
        found = self.verdict(inner)
        return inner.strip(_LOST) == "" or found is not None and len(found[0]) <= 2

    def damage(self, text: str) -> dict[str, str]:
        """Damaged tokens of a text and what they were; empty for a sound text and for one without language."""
        if text.isascii() and not _LOST_INSIDE.search(text):
            return {}
        found: dict[str, str] = {}
        own = set(tokens(text))
        for token in own:
            if token.isascii() and "?" not in token:
                continue
            verdict = self.verdict(token)
            if verdict is None and token[-1:] in _BEFORE_SPACE and (ended := self.verdict(token + "\xa0")) is not None and self.in_vocabulary(ended[0]):
                verdict = ended  # the token's last byte became a space and then a plain one
            if verdict is not None and not self._is_cited(token):
                found[token] = verdict[0]
        if not found:
            return {}
        self._same_way(own, found)
        self._lost_spaces(text, found)
        sound = 0  # tokens that speak for language, as they are or repaired
        for token in own:
            restored = found.get(token)
            sound += any(w.lower() in self.vocabulary for w in (pieces(token) if restored is None else WORD.findall(restored)))
            if sound >= 2:
                return found
        return {}

    @staticmethod
    def _lost_spaces(text: str, found: dict[str, str]) -> None:
        """Add the spaces that take the place of a byte behind a token, so that they go with it."""
        for token in [t for t in found if t[-1:] in _BEFORE_SPACE and not found[t].endswith(t[-1])]:
            if f"{token}  " in text:
                found[f"{token} "] = found[token]

    def _same_way(self, own: set[str], found: dict[str, str]) -> None:
        """Add tokens too short to tell by themselves that went through what most of the text's damaged ones did."""
        ways = Counter(self.channel[t] for t in found if t in self.channel)
        for token in own if ways else ():
            if token in found or token.isascii() or self._is_cited(token) or all(w in self.vocabulary for w in pieces(token) or ("",)):
                continue
            for way, n in ways.most_common(2):
                text: str | None = token
                for wrong, right in way:
                    raw = to_bytes(text, wrong) if text is not None else None
                    try:
                        text = raw.decode(right) if raw is not None else None
                    except UnicodeDecodeError:
                        text = None
                words = [w.lower() for w in WORD.findall(text or "") if not w.isdigit()]
                if text and text != token and n > 1 and words and all(w in self.vocabulary for w in words) and self.cost(text) < self.cost(token):
                    found[token] = text
                    break

    def restore(self, text: str, damage: dict[str, str]) -> str:
        """The text with its damaged tokens replaced; white space stays."""
        if not damage:
            return text
        def restored(m: re.Match) -> str:
            if m[2] and (whole := damage.get(m[1] + " ")) is not None:
                return whole + m[2][1:]
            return damage.get(m[1], m[1]) + m[2]

        return re.sub(r"([^ \n\r\t]+)((?:  )?)", restored, text)


def clean_vocabulary(vocabulary: Vocabulary, forms: dict[str, str]) -> Vocabulary:
    """Without words that are damaged forms of more frequent ones, up to three times damaged. ``forms`` tells how words that are not ASCII are written."""
    repairer = Repairer(vocabulary)

    def made_of_others(form: str, n: int, times: int) -> bool:
        for wrong, right in CHANNELS:
            raw = to_bytes(form, wrong)
            try:
                text = raw.decode(right) if raw is not None else form
            except UnicodeDecodeError:
                continue
            if text == form:
                continue
            if text.isalnum() and repairer.in_vocabulary(text) and all(vocabulary.counts[w.lower()] > n for w in WORD.findall(text)):
                return True
            if right == "utf-8" and times > 1 and made_of_others(text, n, times - 1):
                return True
        return False

    return vocabulary.without({word for word, n in vocabulary.counts.items() if not word.isascii() and any(made_of_others(f, n, 3) for f in {word, forms.get(word, word)})})
