"""Filters of PDF streams as functions on bytes, with their inverses, and as column functions.

Decoders are tolerant: damaged data gives what could be decoded before the
damage. Null in, null out.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.fax import fax_decode

# Names of filters and their short forms.
ABBREVIATIONS = {"Fl": "FlateDecode", "LZW": "LZWDecode", "AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "RL": "RunLengthDecode", "CCF": "CCITTFaxDecode", "DCT": "DCTDecode"}
#: Filters of images, whose data are handed on as they are.
OPAQUE = {"DCTDecode", "JPXDecode", "JBIG2Decode"}


def flate_decode(data: bytes) -> bytes:
    """Inflate; without a right header or checksum, as far as it goes."""
    for bits in (15, -15):
        source = zlib.decompressobj(bits)
        out = bytearray()
        try:
            at = 0
            while at < len(data) and not source.eof:
                out += source.decompress(data[at : at + 512])
                at += 512
            out += source.flush()
        except zlib.error:
            pass
        if out:
            return bytes(out)
        if bits == 15 and len(data) > 2 and data[:1] in (b"\x78", b"\x58", b"\x48", b"\x68"):
            data = data[2:]
    return b""


def flate_encode(data: bytes) -> bytes:
    return zlib.compress(data)


def lzw_decode(data: bytes, early: int = 1) -> bytes:
    """Variable-width LZW, most significant bit first, codes of 9 to 12 bits."""
    out = bytearray()
    table: list[bytes] = []
    previous = b""
    width, held, bits = 9, 0, 0
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    table = start[:]
    for byte in data:
        held = (held << 8 | byte) & 0xFFFFFF
        bits += 8
        if bits < width:
            continue
        code = held >> (bits - width) & ((1 << width) - 1)
        bits -= width
        if code == 256:
            table, width, previous = start[:], 9, b""
            continue
        if code == 257:
            break
        if code < len(table):
            entry = table[code]
        elif code == len(table) and previous:
            entry = previous + previous[:1]
        else:
            break
        out += entry
        if previous and len(table) < 4096:
            table.append(previous + entry[:1])
        previous = entry
        size = len(table) + early
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    return bytes(out)


def lzw_encode(data: bytes, early: int = 1) -> bytes:
    codes = {bytes([i]): i for i in range(256)}
    size = 258
    out, held, bits, width = bytearray(), 0, 0, 9

    def put(code: int) -> None:
        nonlocal held, bits
        held = held << width | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 0xFF)
        held &= (1 << bits) - 1

    put(256)
    run = b""
    for i in range(len(data)):
        longer = run + data[i : i + 1]
        if longer in codes:
            run = longer
            continue
        put(codes[run])
        codes[longer] = size
        size += 1
        reach = size - 1 + early
        width = 9 if reach < 512 else 10 if reach < 1024 else 11 if reach < 2048 else 12
        if size >= 4095:
            put(256)
            codes, size, width = {bytes([k]): k for k in range(256)}, 258, 9
        run = data[i : i + 1]
    if run:
        put(codes[run])
        # the decoder has made one more entry by now
        reach = size + early
        width = 9 if reach < 512 else 10 if reach < 1024 else 11 if reach < 2048 else 12
    put(257)
    if bits:
        out.append(held << (8 - bits) & 0xFF)
    return bytes(out)


def ascii_hex_decode(data: bytes) -> bytes:
    """Pairs of hex digits up to ``>``; other characters are skipped, a missing last digit counts as 0."""
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii"))


def ascii_hex_encode(data: bytes) -> bytes:
    return data.hex().upper().encode("ascii") + b">"


def ascii85_decode(data: bytes) -> bytes:
    """Groups of five characters up to ``~``; ``z`` stands for four zero bytes; others are skipped."""
    out, group = bytearray(), []
    for c in data.lstrip().removeprefix(b"<~").split(b"~")[0]:
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
        elif 0x21 <= c <= 0x75:
            group.append(c - 0x21)
            if len(group) == 5:
                out += _base85(group).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        out += _base85(group + [84] * (5 - len(group))).to_bytes(4, "big")[: len(group) - 1]
    return bytes(out)


def _base85(group: list[int]) -> int:
    value = 0
    for digit in group:
        value = value * 85 + digit
    return value & 0xFFFFFFFF


def ascii85_encode(data: bytes) -> bytes:
    out = bytearray()
    for i in range(0, len(data), 4):
        part = data[i : i + 4]
        if part == b"\0\0\0\0":
            out += b"z"
            continue
        value = int.from_bytes(part.ljust(4, b"\0"), "big")
        digits = [value // 85**k % 85 + 0x21 for k in (4, 3, 2, 1, 0)]
        out += bytes(digits[: len(part) + 1])
    return bytes(out) + b"~>"


def run_length_decode(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and data[i] != 128:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def run_length_encode(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        run = 1
        while run < 128 and i + run < len(data) and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes([257 - run, data[i]])
            i += run
            continue
        start = i
        while i < len(data) and i - start < 128 and not (i + 1 < len(data) and data[i + 1] == data[i]):
            i += 1
        out += bytes([i - start - 1]) + data[start:i]
    return bytes(out) + b"\x80"


def undo_predictor(data: bytes, predictor: int = 1, colors: int = 1, bits: int = 8, columns: int = 1) -> bytes:
    """Rows as they were before prediction: 2 for differences along a row, 10 and more for a filter type before each row."""
    if predictor < 2 or not data:
        return data
    step = max(1, colors * bits // 8)
    width = (colors * bits * columns + 7) // 8
    if predictor == 2:
        rows = np.frombuffer(data[: len(data) // width * width], np.uint8).reshape(-1, width)
        if bits == 8:
            return np.cumsum(rows.reshape(len(rows), -1, colors), axis=1, dtype=np.uint8).tobytes()
        if bits == 16:
            samples = rows.copy().view(">u2").reshape(len(rows), -1, colors).astype(np.uint16)
            return np.cumsum(samples, axis=1, dtype=np.uint16).astype(">u2").tobytes()
        flags = np.unpackbits(rows, axis=1)[:, : columns * colors * bits].reshape(len(rows), columns, colors, bits)
        values = (flags * (1 << np.arange(bits - 1, -1, -1))).sum(axis=3)
        values = np.cumsum(values, axis=1) % (1 << bits)
        back = (values[..., None] >> np.arange(bits - 1, -1, -1) & 1).astype(np.uint8).reshape(len(rows), -1)
        return np.packbits(back, axis=1).tobytes()
    out, above = bytearray(), bytearray(width)
    for at in range(0, len(data), width + 1):
        kind = data[at]
        row = bytearray(data[at + 1 : at + 1 + width].ljust(width, b"\0"))
        short = len(data) - at - 1
        if kind == 1:
            for i in range(step, width):
                row[i] = (row[i] + row[i - step]) & 0xFF
        elif kind == 2:
            row = bytearray((np.frombuffer(row, np.uint8) + np.frombuffer(above, np.uint8)).tobytes())
        elif kind == 3:
            for i in range(width):
                row[i] = (row[i] + ((row[i - step] if i >= step else 0) + above[i]) // 2) & 0xFF
        elif kind == 4:
            for i in range(width):
                left, up, corner = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
                guess = left + up - corner
                best = min((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner))[2]
                row[i] = (row[i] + best) & 0xFF
        out += row[: min(width, short)]
        above = row
    return bytes(out)


def decode(data: bytes, name: str, parameters: dict | None = None) -> bytes:
    """The data behind one filter; unknown filters raise ValueError."""
    name = ABBREVIATIONS.get(name, name)
    given = parameters or {}
    number = lambda key, default: int(v) if isinstance(v := given.get(key, default), (int, float)) else default
    if name in ("FlateDecode", "LZWDecode"):
        plain = flate_decode(data) if name == "FlateDecode" else lzw_decode(data, number("EarlyChange", 1))
        return undo_predictor(plain, number("Predictor", 1), number("Colors", 1), number("BitsPerComponent", 8), number("Columns", 1))
    if name == "ASCIIHexDecode":
        return ascii_hex_decode(data)
    if name == "ASCII85Decode":
        return ascii85_decode(data)
    if name == "RunLengthDecode":
        return run_length_decode(data)
    if name == "CCITTFaxDecode":
        return fax_decode(data, number("K", 0), number("Columns", 1728), number("Rows", 0), bool(given.get("BlackIs1")), bool(given.get("EncodedByteAlign")))
    if name in OPAQUE or name in ("Crypt", "Identity"):
        return data
    raise ValueError(f"unknown filter {name}")


_ENCODERS = {"FlateDecode": flate_encode, "LZWDecode": lzw_encode, "ASCIIHexDecode": ascii_hex_encode, "ASCII85Decode": ascii85_encode, "RunLengthDecode": run_length_encode}


def encode(data: bytes, name: str) -> bytes:
    name = ABBREVIATIONS.get(name, name)
    return _ENCODERS[name](data) if name in _ENCODERS else data


def decoded(data: Column, name: str, parameters: dict | None = None) -> Column:
    """Column function: the data behind a filter; null where they are null or the filter fails."""
    if ABBREVIATIONS.get(name, name) == "ASCIIHexDecode":  # stays in the JVM
        digits = F.regexp_replace(F.substring_index(F.decode(data, "ISO-8859-1"), ">", 1), "[^0-9A-Fa-f]", "")
        return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else decode(bytes(v), name, parameters))

    return run(data)


def encoded(data: Column, name: str) -> Column:
    """Column function: the data in a filter's form; null stays null."""

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else encode(bytes(v), name))

    return run(data)
