"""Facsimile images: groups 3 (one- and two-dimensional) and 4, to packed rows of pixels and back (group 4)."""

from __future__ import annotations

# Code words of runs of 0 to 63 pixels, then of 64, 128 and so on up to 1728; the last ones hold for both colours.
_WHITE = """00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 0010111
0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000
00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001
01011010 01011011 01001010 01001011 00110010 00110011 00110100
11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 011010110
011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011""".split()
_BLACK = """0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000 00001100111
00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001
000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011
000001010100 000001010101 000001010110 000001010111 000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111
000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111
0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100
0000001001101 0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101
0000001011010 0000001011011 0000001100100 0000001100101""".split()
_LONG = """00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110
000000011111""".split()
_MODES = {"1": 0, "011": 1, "000011": 2, "0000011": 3, "010": -1, "000010": -2, "0000010": -3, "0001": "pass", "001": "horizontal"}


def _runs(words: list[str]) -> dict[str, int]:
    sizes = [*range(64), *range(64, 1729, 64)]
    return dict(zip(words, sizes)) | {w: 1792 + 64 * i for i, w in enumerate(_LONG)}


_RUNS = (_runs(_WHITE), _runs(_BLACK))
_WORDS = tuple({size: word for word, size in table.items()} for table in _RUNS)
_END_OF_LINE = "000000000001"


class _Bits:
    def __init__(self, data: bytes):
        self.bits, self.at = "".join(f"{b:08b}" for b in data), 0

    def word(self, table: dict) -> object:
        """The value of the code word that comes next; EOFError if there is none."""
        for n in range(1, 14):
            found = table.get(self.bits[self.at : self.at + n])
            if found is not None and self.at + n <= len(self.bits):
                self.at += n
                return found
        raise EOFError

    def run(self, color: int) -> int:
        total = 0
        while True:
            size = self.word(_RUNS[color])
            total += size
            if size < 64:
                return total

    def skip_end_of_line(self) -> bool:
        """Step over fill bits and a mark of a line's end, if they come."""
        at = self.bits.find("1", self.at)
        if at - self.at >= 11:
            self.at = at + 1
            return True
        return False


def _next_change(reference: list[int], start: int, color: int) -> int:
    """The place in the row above of the first change right of ``start`` to the other colour than ``color``."""
    k = color
    while k < len(reference) and reference[k] <= start and not (start < 0):
        k += 2
    return k


def _one_dimension(bits: _Bits, columns: int) -> list[int]:
    changes, at, color = [], 0, 0
    while at < columns:
        at += bits.run(color)
        changes.append(min(at, columns))
        color ^= 1
    return changes


def _two_dimensions(bits: _Bits, reference: list[int], columns: int) -> list[int]:
    changes: list[int] = []
    at, color = -1, 0
    above = [*reference, columns, columns, columns]
    while at < columns:
        k = _next_change(above, at, color)
        b1 = above[k] if k < len(above) else columns
        b2 = above[k + 1] if k + 1 < len(above) else columns
        mode = bits.word(_MODES)
        if mode == "pass":
            at = b2
        elif mode == "horizontal":
            first, second = bits.run(color), bits.run(color ^ 1)
            at = max(at, 0) + first
            changes.append(min(at, columns))
            at += second
            changes.append(min(at, columns))
        else:
            at = b1 + mode
            changes.append(min(max(at, 0), columns))
            color ^= 1
        if at >= columns:
            break
    return changes


def fax_decode(data: bytes, k: int = 0, columns: int = 1728, rows: int = 0, black_is_1: bool = False, byte_align: bool = False) -> bytes:
    """Packed rows, as far as they can be read; ``k`` is below 0 for group 4, 0 for one and above 0 for two dimensions of group 3."""
    bits, out, reference = _Bits(data), bytearray(), []
    count = 0
    while not rows or count < rows:
        try:
            if byte_align:
                bits.at = (bits.at + 7) // 8 * 8
            if k >= 0:
                bits.skip_end_of_line()
                flat = k == 0
                if k > 0:
                    flat = bits.bits[bits.at : bits.at + 1] == "1"
                    bits.at += 1
                changes = _one_dimension(bits, columns) if flat else _two_dimensions(bits, reference, columns)
            else:
                if bits.bits.startswith(_END_OF_LINE, bits.at):
                    break
                changes = _two_dimensions(bits, reference, columns)
        except EOFError:
            break
        out += _packed(changes, columns, black_is_1)
        reference = changes
        count += 1
    return bytes(out)


def _packed(changes: list[int], columns: int, black_is_1: bool) -> bytes:
    row, at, color = [], 0, 0
    for change in [*changes, columns]:
        row.append(("01" if black_is_1 else "10")[color] * max(0, change - at))
        at, color = max(at, change), color ^ 1
    text = "".join(row)[:columns]
    text = text.ljust((columns + 7) // 8 * 8, "0" if black_is_1 else "1")
    return int(text, 2).to_bytes(len(text) // 8, "big") if text else b""


def fax_encode(data: bytes, columns: int, black_is_1: bool = False) -> bytes:
    """Packed rows as group 4."""
    width, out, reference = (columns + 7) // 8, [], []
    for i in range(0, len(data) - width + 1, width):
        pixels = "".join(f"{b:08b}" for b in data[i : i + width])[:columns]
        dark = "1" if black_is_1 else "0"
        changes = [x for x in range(columns) if (pixels[x] == dark) != (x > 0 and pixels[x - 1] == dark)]
        at, color = -1, 0
        above = [*reference, columns, columns, columns]
        while at < columns:
            k = _next_change(above, at, color)
            b1, b2 = (above[j] if j < len(above) else columns for j in (k, k + 1))
            own = [c for c in changes if c > at or at < 0]
            own = own[next((j for j, c in enumerate(own) if (pixels[c] == dark) != bool(color)), len(own)) :]
            a1, a2 = (own + [columns, columns])[:2]
            if b2 < a1:
                out.append("0001")
                at = b2
            elif abs(a1 - b1) <= 3:
                out.append(next(w for w, v in _MODES.items() if v == a1 - b1))
                at, color = a1, color ^ 1
            else:
                out.append("001" + _run_words(a1 - max(at, 0), color) + _run_words(a2 - a1, color ^ 1))
                at = a2
        reference = changes
    text = "".join(out) + _END_OF_LINE * 2
    text = text.ljust((len(text) + 7) // 8 * 8, "0")
    return int(text, 2).to_bytes(len(text) // 8, "big")


def _run_words(size: int, color: int) -> str:
    words = ""
    while size > 2560:
        words += _WORDS[color][2560]
        size -= 2560
    if size >= 64:
        words += _WORDS[color][size // 64 * 64]
    return words + _WORDS[color][size % 64]
