"""Texts that were cut off by a field limit or a broken transfer.

A stack automaton reads a text's marks and tells what is still open at its end:
quotes, brackets, markup, fences, an escape, a character whose bytes are not
all there. What it holds makes a text cut. Where nothing is open, the last line
tells how the text should have ended: a sentence ends with a stop, unless its
source leaves stops out, while a list item, a log line, a signature, a tag, an
address or a table row ends where its line does. Whether such a line's last
word is whole and may stand at a line's end, and whether the text's length is a
limit of its source, are facts of all documents: `examine` reads the text alone
and gives what has to be looked up, `decide` judges by what was found.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

#: A word, pair or line is known if it occurs so often ...
MIN_COUNT = 3
#: ... and a word is no fragment of one so many times as frequent.
MUCH_MORE = 50
#: A word may end a line if it does so at this share of its places, a pair of words if it is this share of the last one's line ends.
ENDING_SHARE, PAIR_SHARE = 0.004, 0.01
#: A line is a sign-off if it stands near its text's end at this share of its places.
CLOSING_SHARE = 0.5
#: A length is a limit if so many texts of a source have it, and so large a share of the longer half of the source.
LIMIT_COUNT, LIMIT_SHARE = 4, 0.03
#: Lengths below this are not looked at as limits: whole texts of few words often have equal lengths.
LEAST_LIMIT = 16
#: In a source of which less running texts than this, those at a limit aside, end with a stop, the lack of one says nothing.
MIN_TERMINATED = 0.2
#: So many texts at the rate of all sources are added to each source's own.
PRIOR_TEXTS = 10

_WORD = re.compile(r"[^\W\d_]+")
_STOP = re.compile(r"[.!?。…．？！:;]")
_CLOSERS = "\"'”’»›)]}>*_`"
_MARK = re.compile(r"\s*(?:\[\s*(?:more|mehr|suite|\.{3}|…|cut|truncated|snip|continued)\s*\]|\(\s*(?:more|continued|truncated|cut|\.{3}|…)\s*\)|<\s*(?:more|cut|truncated|snip)\s*>|(?:…|\.{3,})\s*(?:\(?more\)?|read more|weiter|suite)?|>>+|»»)\s*$", re.I)
_BULLET = re.compile(r"^\s*(?:[-*•–·◦▪‣+]\s|\(?\d{1,3}[.)]\s|\(?\w[.)]\s|\(?[ivxIVX]{1,6}[.)]\s)")
_LOG = re.compile(r"^\[?(?:\d{4}-\d\d-\d\d[T ]?)?\d\d:\d\d(?::\d\d)?(?:[.,]\d+)?\]?\s")
_TAG = re.compile(r"^\s*(?:@\w+|:\w+:|\\\w+|#+\s|[\w-]+:\s*v?\d[\w.]*$|</?\w+[^>]*>)")
_ADDRESS = re.compile(r"(?:https?://|www\.|ftp://|mailto:)\S+$|\S+@\S+\.\w+$")
_CODE = re.compile(r"[{};]\s*$|^\s*(?:class|def|public|private|return|if|for|while|int|void|import|package|//|/\*)\b.*[{(;]?$")
_LEADER = re.compile(r"\.{3,}\s*\d+\s*$")
_CELLS = re.compile(r"\t|\s\|\s?|;|,(?=\S)|,$")
_PICTURE = re.compile("[☀-➿\U0001f000-\U0001faff️⃣]+$")
_BROKEN = re.compile(r"(?:&#?\w{0,8}|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|\\|%[0-9A-Fa-f]?|<[/!]?[a-zA-Z][^<>]{0,40}|</?)$")
_PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«", "›": "‹"}
_LEVELS = re.compile(
    r"(?P<fence>^[ \t]*(?:```|~~~))|(?P<comment><!--|-->)|<(?P<close>/?)(?P<tag>[A-Za-z][\w:.-]*)(?:\s[^<>]*?)?(?P<empty>/?)>"
    r"|(?P<escaped>\\.)|(?P<blank>\n[ \t\r]*\n)|(?P<face>[:;=]-?[()\[\]{}])|(?P<mark>[()\[\]{}“”„«»‹›\"])",
    re.M,
)
# Elements of HTML that must be closed.
_CLOSED_TAGS = frozenset(
    "html head body title style script div span section article header footer nav main aside table ul ol dl a b i u s em strong code pre kbd samp var blockquote q cite sub sup small h1 h2 h3 h4 h5 h6 form label select button textarea figure figcaption details summary".split()
)


def still_open(text: str) -> list[str]:
    """What the stack automaton holds at the end, innermost last.

    A closing mark takes off its partner and what stands above it; one without
    a partner is ignored. An escaped mark and one in a face are none. What
    prose opened, brackets and quotes, is dropped where a blank line ends its
    paragraph; braces, fences, comments and elements last. A straight quote
    opens or closes; behind a digit it only closes, as it may be an inch. Of
    elements, those count that have to be closed, or that are closed elsewhere
    in the text. In a fence only its end counts.
    """
    stack: list[str] = []
    # of prose, only the last paragraph can leave anything
    closed = {m.lower() for m in re.findall(r"</([A-Za-z][\w:.-]*)\s*>", text)} if "</" in text else set()
    start = 0
    if "`" not in text and "~~~" not in text and "<" not in text and "{" not in text:
        start = max((m.end() for m in _BLANK_LINE.finditer(text)), default=0)
    for m in _LEVELS.finditer(text, start):
        kind = m.lastgroup if m["tag"] is None else "tag"
        if m["fence"] is not None:
            if "```" in stack:
                del stack[stack.index("```") :]
            else:
                stack.append("```")
        elif "```" in stack or kind in ("escaped", "face"):
            continue
        elif m["comment"] is not None:
            if m[0] == "<!--":
                stack.append("<!--")
            elif "<!--" in stack:
                del stack[stack.index("<!--") :]
        elif m["tag"] is not None:
            name = m["tag"].lower()
            if m["empty"] or name not in _CLOSED_TAGS and name not in closed:
                continue
            tag = f"<{name}>"
            if not m["close"]:
                stack.append(tag)
            elif tag in stack:
                while stack.pop() != tag:
                    pass
        elif m["blank"] is not None:
            stack = [x for x in stack if x == "{" or x[0] in "<`"]
        else:
            c = m[0]
            if c == '"':
                if c in stack:
                    while stack.pop() != c:
                        pass
                elif not (m.start() and text[m.start() - 1].isdigit()):
                    stack.append(c)
            elif c in "([{“„«‹":
                other = {"“": "„", "«": "»"}.get(c)  # these close in some languages
                if other in stack:
                    while stack.pop() != other:
                        pass
                else:
                    stack.append(c)
            else:
                partner = _PAIRS[c]
                if partner not in stack and c == "”" and "„" in stack:
                    partner = "„"
                if partner in stack:
                    while stack.pop() != partner:
                        pass
                elif c == "»":  # may open in some languages
                    stack.append(c)
    return [x for x in stack if x != "»"]


_BLANK_LINE = re.compile(r"\n[ \t\r]*\n")


def count_lines(text: str, words: Counter, endings: Counter, pairs: Counter, lines: Counter, closings: Counter) -> None:
    """Add a text's words, the words and pairs of words that end its lines, its short lines, and those near its end.

    A word before a mark that breaks it at its line's end counts as none.
    Quoted mail is broken anywhere, so its lines have no ends. A text's own end
    may be a cut, but cuts are spread over all words.
    """
    text = text.replace("\r\n", "\n").replace("\r", "\n").rstrip()
    rows = text.split("\n")
    words.update(_WORD.findall(text.lower()))
    last = len(rows) - 1
    for k, row in enumerate(rows):
        tail = row[-120:]
        found = _WORD.findall(tail)
        if len(found) < 6 and len(tail) < len(row):
            found = _WORD.findall(row)
        if not found:
            continue
        low = found[-1].lower()
        if row.rstrip().endswith(("-", "¬", "\xad", "‐")):
            words[low] -= 1
        elif not row.startswith(">"):
            endings[low] += 1
            if k == last:
                continue
            pairs[f"{found[-2].lower()} {low}" if len(found) > 1 else low] += 1
            if len(found) <= 4:
                line = row.strip()
                lines[line] += 1
                if k >= last - 3:
                    closings[line] += 1


@dataclass
class Ending:
    """What a text alone tells: ``cut`` if that is enough, else what has to be looked up.

    ``running`` is 1 for running text that ends with a stop, 2 for such without
    one, 0 for all others. ``word`` and ``before`` are the last words of the last line.
    """

    cut: bool | None = None
    running: int = 0
    kind: str | None = None
    marked: bool = False
    address: bool = False
    short: bool = False
    spaced: bool = False
    ends_in: str = ""
    word_last: bool = False
    word: str | None = None
    before: str | None = None
    above: tuple[str, ...] = ()


@dataclass
class Facts:
    """What all documents tell of an ending: counts of its words, and whether its length is a limit of its source."""

    limited: bool = False
    words: int = 0
    endings: int = 0
    extends: int = 0  # the count of the most frequent word that begins with the last one
    before: int = 0
    pairs: int = 0
    sign_off: bool = False
    stops: bool = True  # whether running texts of the source end with stops


def is_code(rows: list[str]) -> bool:
    filled = [r for r in rows if r.strip()]
    coded = sum(bool(_CODE.search(r)) for r in filled)
    return coded >= 3 and coded >= 0.4 * len(filled) and any(r.rstrip().endswith(("{", "}", ";")) for r in filled)


def examine(text: str | None) -> Ending:
    """What a text alone tells of its end. Null, empty and blank texts were not cut."""
    if not text or not text.strip():
        return Ending(False)
    body = text.rstrip()
    if body[-1] in "\ufffd\u200d":  # a character whose bytes, or a sequence whose parts, are not all there
        return Ending(True)
    marked = False
    if m := _MARK.search(body, max(0, len(body) - 200)):
        stripped = body[: m.start()].rstrip()
        if stripped:
            marked, body = True, stripped
    picture = _PICTURE.search(body, max(0, len(body) - 200))
    if picture and picture.start():
        body = body[: picture.start()].rstrip("\u200d\ufe0f ")
        if not body:
            return Ending(False)
    rows = body.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    last = rows[-1].strip()
    if still_open(body):
        return Ending(True)
    if is_code(rows):
        return Ending(not last.endswith(("}", ";", "*/")) and not last.startswith("//"))
    if _ADDRESS.search(last):
        return Ending(None if not marked else True, address=True, spaced=text[-1].isspace() or re.search(r"/\d+$|/\w{3,}$", last) is not None)
    if _BROKEN.search(last) and not last.endswith("%") and not last.endswith("\\"):
        return Ending(True)
    if last[-1] in _CLOSERS:
        inner = last.rstrip(_CLOSERS)
        if not inner or last[-1] in ")]}>" or _STOP.search(inner[-1:]):
            return Ending(marked and not _STOP.search(inner[-1:]), running=1)
    if _STOP.search(last[-1]) and last[-1] not in ":;":
        return Ending(False, running=1)  # marks of a cut were taken off before
    kind, above = _kind(rows)
    if kind == "table":
        return Ending(_row_is_short(text.replace("\r\n", "\n").rstrip("\r\n").split("\n")))
    words = _WORD.findall(last)
    word_last = bool(words) and last.rstrip(_CLOSERS).endswith(words[-1])
    if kind == "log" and ": " not in last and any(": " in r for r in rows[:-1] if _LOG.search(r)):
        return Ending(True)
    short = kind is None and len(rows) == 1 and not marked and len(_WORD.findall(body)) <= 6
    return Ending(
        None, 2 if kind is None and not short else 0, kind, marked, False, short, text[-1] in " \t", last[-1],
        word_last, words[-1] if words else None, words[-2] if len(words) > 1 else None, above,
    )


def _kind(rows: list[str]) -> tuple[str | None, tuple[str, ...]]:
    """What kind of line the text ends with, None for running text, and the lines above that make it a signature if they are sign-offs."""
    last = rows[-1]
    if _LOG.search(last):
        return "log", ()
    if _BULLET.search(last):
        others = [r.rstrip() for r in rows[:-1] if _BULLET.search(r)]
        return (None if others and sum(bool(re.search(r"[.!?。．]$", r)) for r in others) > 0.5 * len(others) else "item"), ()
    if _TAG.search(last):
        return "tag", ()
    if _LEADER.search(last):
        return "item", ()
    block = []
    for r in reversed(rows):
        if not r.strip():
            break
        block.append(r.strip())
    cells = [len(_CELLS.findall(r)) for r in block]
    numeric = [r for r in block if sum(any(c.isdigit() for c in t) or t in ("-", "n/a", "|") for t in re.split(r"[\s;,|]+", r) if t) >= 0.5 * max(1, len([t for t in re.split(r"[\s;,|]+", r) if t]))]
    if len(block) >= 3 and len(numeric) >= 0.5 * len(block):
        return "table", ()
    # a sign-off, or a dash line, stands above a short last line
    above = [r.strip() for r in rows[-4:-1] if r.strip()]
    sign_offs: tuple[str, ...] = ()
    if len(_WORD.findall(last)) <= 6 and not any(len(_WORD.findall(r)) > 8 for r in above[-1:]):
        if "--" in above[-2:]:
            return "signature", ()
        sign_offs = tuple(r for r in above[-2:] if not _STOP.search(r[-1]))
    plain = [r for r in block if r and not _STOP.search(r[-1]) or r.endswith(";")]
    if len(block) >= 3 and len(plain) >= 0.8 * len(block) and sum(len(_WORD.findall(r)) <= 8 for r in block) >= 0.8 * len(block) and max(cells) <= 2:
        return "item", sign_offs
    return None, sign_offs


def _row_is_short(rows: list[str]) -> bool:
    """Whether the last row has fewer separators than its table's rows have."""
    block = []
    for r in reversed(rows):
        if not r.strip():
            break
        block.append(len(_CELLS.findall(r)))
    usual, n = Counter(block[1:]).most_common(1)[0]
    return usual > 0 and n >= 0.8 * (len(block) - 1) and block[0] < usual


def decide(end: Ending, facts: Facts) -> bool:
    """Whether the rest of the text was cut off."""
    if end.cut is not None:
        return end.cut
    if end.address:
        return facts.limited and not end.spaced
    kind = "signature" if facts.sign_off else end.kind
    if kind is None and end.short and not facts.limited:
        return end.word_last and not _word_ends(end, facts, False)
    if kind is None and facts.stops:
        return True
    if end.marked and not (end.word_last and _line_ends(end, facts, True)):
        return True
    if end.ends_in in ":;":
        return False
    if end.word is None or not end.word_last:
        return end.marked or end.ends_in in ",-–—’'/("
    if end.spaced and kind in ("item", "log", "tag"):
        return facts.limited or not _line_ends(end, facts, facts.limited)
    return not _line_ends(end, facts, facts.limited)


def _known(facts: Facts) -> bool:
    return facts.words >= MIN_COUNT and facts.extends < MUCH_MORE * facts.words


def _word_ends(end: Ending, facts: Facts, limited: bool) -> bool:
    """Whether the last word is whole and may be the last of a line."""
    if _known(facts):
        return facts.endings >= ENDING_SHARE * facts.words
    if facts.extends:
        return not (limited or end.word.islower() and len(end.word) > 1)
    return not limited or not end.word.islower()


def _line_ends(end: Ending, facts: Facts, limited: bool) -> bool:
    """Whether a line may end with these words; at a limit the last two must be known to."""
    if not _word_ends(end, facts, limited):
        return False
    if limited and _known(facts) and facts.before >= MIN_COUNT:
        return facts.pairs >= MIN_COUNT and facts.pairs >= PAIR_SHARE * facts.endings
    return True
