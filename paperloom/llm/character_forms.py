"""Text that looks ordinary but is spelled with other characters.

Characters with a plain counterpart are replaced one by one: full-width and
styled forms, decomposed letters and syllables, zero-width characters, special
spaces. Look-alike letters are repaired by script: a token's dominant script is
the one most of its letters have, and letters of another script are replaced
only in tokens that mix scripts and only if the result is a word of the corpus
vocabulary. Text that wrong decoding made (`encoding_repair`) is left out.
"""

from __future__ import annotations

import re
import unicodedata

from paperloom.llm.encoding_repair import Repairer
from paperloom.llm.vocabulary import Vocabulary, tokens

# Letters of other scripts that look like Latin ones, and back.
_CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮԌԚԜаеѕіјорсухһԁԛԝгпк", "ABESIJKMHOPCTYXYGQWaesijopcyxhdqwrnk"))
_GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοονυικρα", "ABEZHIKMNOPTYXoovuikpa"))
_OTHERS = dict(
    [
        *zip("օոսհցզքյլ", "onuhgqfjl"), *zip("ՕՍԼՏ", "OULS"),  # Armenian
        *zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"), *zip("ꮯꮪꮩꮃꮓꭰꭺꮶꮋ", "csvwzdakh"),  # Cherokee
        *zip("ⲞⲢⲤⲬⲘⲚⲎⲔⲂⲀ", "OPCXMNHKBA"), *zip("ⲟⲣⲥⲭⲩⲅ", "opcxur"),  # Coptic
        *zip("ɑɡıɩɪʏᴄᴏᴠᴡᴢꜱƽɼʋꞌ", "agiiiycovwzssru'"),  # phonetic and other letters of Latin kind
        *zip("үӏѵѡүԍ", "ylvwyg"), *zip("ϲϳγωτσηκ", "cjywtonk"),  # more of Cyrillic and Greek
    ]
)
_TO_LATIN = _OTHERS | _CYRILLIC | _GREEK
_TO_CYRILLIC = {
    **dict(zip("ABEKMHOPCTXYaeopcyxiksjurnmt", "АВЕКМНОРСТХУаеорсухікѕјигпмт")),
    **dict(zip("ΑΒΕΗΚΜΟΡΤΧο", "АВЕНКМОРТХо")),
    **dict(zip("օᎪᏴᎬᎻᎷᏢᏟᎢⲞⲢⲤⲬⲟⲣⲥⲭɑᴏᴄ", "оАВЕНМРСТОРСХорсхаос")),
}
#: What stands in for Latin letters though it is of no other script by itself.
_PHONETIC = frozenset("ɑɡıɩɪʏᴄᴏᴠᴡᴢꜱƽɼʋꞌ")

_SPACES = "               　"
_ZERO_WIDTH = "​‌‍⁠⁡⁢⁣⁤﻿᠎"
_JAMO = "ᄀ-ᇿꥠ-꥿ힰ-퟿"
_FORMS = re.compile(
    f"(?P<full>[！-～￠-￦]+)|(?P<styled>[\U0001d400-\U0001d7ff]+)|(?P<space>[{_SPACES}])|(?P<zero>[{_ZERO_WIDTH}])"
    f"|(?P<decomposed>[{_JAMO}]+|[^\\W\\d_][̀-ͯ]+)"
)
_WORD = re.compile(r"[^\W\d_]+")
_QUICK = re.compile(f"[！-￦\U0001d400-\U0001d7ff{_SPACES}{_ZERO_WIDTH}{_JAMO}̀-ͯͰ-ϿЀ-ԯ\u0530-\u058fᎠ-Ᏽꭰ-ꮿⲀ-⳿ɐ-ʯᴀ-ᵿıꜱƽꞌ]")
_EMOJI = ("☀", "\U0001f000")


def script(c: str) -> str:
    """LATIN, CYRILLIC, GREEK, OTHER of letters that stand in for these, or '' of a letter."""
    o = ord(c)
    if c in _PHONETIC:
        return "OTHER"
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "LATIN"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "GREEK"
    if 0x400 <= o < 0x530:
        return "CYRILLIC"
    return "OTHER" if 0x530 <= o < 0x590 or 0x13A0 <= o < 0x1400 or 0xAB70 <= o < 0xABC0 or 0x2C80 <= o < 0x2D00 else ""


class Forms:
    """Finds and removes deviating forms; keeps its verdicts on tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.repairer = vocabulary.shared(Repairer)
        self.words: dict[str, str] = {}

    def repair_word(self, word: str) -> str:
        """The word with look-alike letters replaced, or as it is."""
        if word.isascii():
            return word
        if (known := self.words.get(word)) is not None:
            return known
        counts: dict[str, int] = {}
        for c in word:
            if s := script(c):
                counts[s] = counts.get(s, 0) + 1
        fixed = word
        if len(counts) > 1:
            for target in sorted((s for s in counts if s in ("LATIN", "CYRILLIC")), key=lambda s: -counts[s]):
                table = _TO_LATIN if target == "LATIN" else _TO_CYRILLIC
                trial = "".join(c if script(c) in ("", target) else table.get(c, c) for c in word)
                if all(script(c) in ("", target) for c in trial) and trial.lower() in self.vocabulary:
                    fixed = trial
                    break
        if len(self.words) > 300_000:
            self.words.clear()
        self.words[word] = fixed
        return fixed

    def _plain(self, m: re.Match) -> str:
        kind, text = m.lastgroup, m[0]
        if kind == "zero":
            before, after = m.string[m.start() - 1 : m.start()], m.string[m.end() : m.end() + 1]
            joins = text == "‍" and before and after and before > _EMOJI[0] and after > _EMOJI[0] and not before.isalnum() and not after.isalnum()
            return text if joins else ""  # a joiner between emoji is part of one
        if kind == "space":
            return " "
        return unicodedata.normalize("NFC" if kind == "decomposed" else "NFKC", text)

    def normalise(self, text: str) -> str:
        """The consistent form of a text without wrongly decoded parts."""
        if text.isascii() or not _QUICK.search(text):
            return text
        plain = _FORMS.sub(self._plain, text)
        if plain != text:  # a mark may have stood behind a zero-width character
            plain = _FORMS.sub(self._plain, plain)
        return _WORD.sub(lambda m: self.repair_word(m[0]), plain)

    def consistent(self, text: str, damage: dict[str, str] | None = None) -> tuple[str, bool]:
        """The consistent form, with wrong decoding restored, and whether the text deviated by other than that.

        ``damage`` is what the repairer found, if that was asked before.
        """
        if text.isascii():
            return text, False
        if damage is None:
            damage = self.repairer.damage(text)
        quick = _QUICK.search(text) is not None
        if not damage:
            plain = self.normalise(text) if quick else text
            return plain, plain != text and self._deviates(text)
        deviates, done = False, {}
        for token in set(tokens(text)):
            if token in damage:
                done[token] = self.normalise(damage[token])
            elif quick and (plain := self.normalise(token)) != token:
                done[token] = plain
                deviates = deviates or self._deviates(token)
        return self.repairer.restore(text, done), deviates

    def _deviates(self, text: str) -> bool:
        """Whether something else than the quoted mention of a damaged sequence deviates."""
        return any(t and self.normalise(t) != t and not self.repairer._is_cited(t) for t in tokens(text))
