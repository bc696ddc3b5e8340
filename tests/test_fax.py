import random

import pytest

from paperloom.functions.fax import _BLACK, _LONG, _WHITE, _run_words, fax_decode, fax_encode
from paperloom.functions.stream_filters import decode


@pytest.mark.parametrize("words", [_WHITE + _LONG, _BLACK + _LONG])
def test_no_word_begins_another(words):
    assert len(words) == len(set(words)) == 104
    ordered = sorted(words)
    assert not any(b.startswith(a) for a, b in zip(ordered, ordered[1:]))


def image(rng, columns, rows):
    out = bytearray()
    row = ""
    for _ in range(rows):
        if rng.random() < 0.6 and row:
            bits = list(row)
            for _ in range(rng.randint(0, 3)):
                x = rng.randrange(columns)
                bits[x] = "10"[int(bits[x])]
            row = "".join(bits)
        else:
            row = ""
            while len(row) < columns:
                row += rng.choice("01") * rng.choice([1, 2, 5, 70, 900])
            row = row[:columns]
        padded = row.ljust((columns + 7) // 8 * 8, "1")
        out += int(padded, 2).to_bytes(len(padded) // 8, "big")
    return bytes(out)


@pytest.mark.parametrize("columns", [1, 7, 8, 64, 333, 1728, 6000])
def test_group_4_round_trip(columns):
    data = image(random.Random(columns), columns, 12)
    assert fax_decode(fax_encode(data, columns), -1, columns) == data
    assert decode(fax_encode(data, columns), "CCF", {"K": -1, "Columns": columns, "Rows": 5}) == data[: 5 * ((columns + 7) // 8)]


def test_group_3():
    line = _run_words(3, 0) + _run_words(5, 1)
    for mark in ("", "000000000001"):
        text = (mark + line) * 2
        packed = int(text.ljust((len(text) + 7) // 8 * 8, "0"), 2).to_bytes((len(text) + 7) // 8, "big")
        assert fax_decode(packed, 0, 8, 2) == b"\xe0\xe0" and fax_decode(packed, 0, 8, 2, black_is_1=True) == b"\x1f\x1f"
    assert fax_decode(b"", 0) == b"" and fax_decode(b"\0\0", -1, 8) == b""
