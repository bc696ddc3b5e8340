"""Decryption of files by the standard security handler: RC4 and AES with user or owner passwords."""

from __future__ import annotations

import hashlib
from typing import Any

_PADDING = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")  # fixed value


def rc4(key: bytes, data: bytes) -> bytes:
    box, j = list(range(256)), 0
    for i in range(256):
        j = (j + box[i] + key[i % len(key)]) & 0xFF
        box[i], box[j] = box[j], box[i]
    out, i, j = bytearray(), 0, 0
    for byte in data:
        i = (i + 1) & 0xFF
        j = (j + box[i]) & 0xFF
        box[i], box[j] = box[j], box[i]
        out.append(byte ^ box[(box[i] + box[j]) & 0xFF])
    return bytes(out)


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def _substitution() -> list[int]:
    box = [0] * 256
    p = q = 1
    while True:  # p runs through the powers of 3, q through their inverses
        p = p ^ (p << 1) & 0xFF ^ (0x1B if p & 0x80 else 0)
        q ^= q << 1
        q ^= q << 2
        q ^= q << 4
        q &= 0xFF
        if q & 0x80:
            q ^= 0x09
        box[p] = q ^ _turn(q, 1) ^ _turn(q, 2) ^ _turn(q, 3) ^ _turn(q, 4) ^ 0x63
        if p == 1:
            break
    box[0] = 0x63
    return box


def _turn(x: int, n: int) -> int:
    return (x << n | x >> (8 - n)) & 0xFF


_BOX = _substitution()
_BACK = [_BOX.index(i) for i in range(256)]
_BY = {n: [_times(i, n) for i in range(256)] for n in (2, 3, 9, 11, 13, 14)}


class Aes:
    """The block cipher for keys of 16 or 32 bytes, with chained blocks."""

    def __init__(self, key: bytes):
        n, rounds = len(key) // 4, len(key) // 4 + 6
        words = [list(key[4 * i : 4 * i + 4]) for i in range(n)]
        factor = 1
        for i in range(n, 4 * (rounds + 1)):
            word = words[-1][:]
            if i % n == 0:
                word = [_BOX[b] for b in word[1:] + word[:1]]
                word[0] ^= factor
                factor = _times(factor, 2)
            elif n > 6 and i % n == 4:
                word = [_BOX[b] for b in word]
            words.append([a ^ b for a, b in zip(words[i - n], word)])
        self.keys = [sum(words[4 * i : 4 * i + 4], []) for i in range(rounds + 1)]

    def _decrypt_block(self, block: bytes) -> list[int]:
        state = [a ^ b for a, b in zip(block, self.keys[-1])]
        m9, m11, m13, m14 = _BY[9], _BY[11], _BY[13], _BY[14]
        for k in range(len(self.keys) - 2, -1, -1):
            state = [_BACK[state[(i - 4 * (i % 4)) % 16]] for i in range(16)]
            state = [a ^ b for a, b in zip(state, self.keys[k])]
            if k:
                mixed = []
                for c in range(0, 16, 4):
                    a, b, d, e = state[c : c + 4]
                    mixed += [m14[a] ^ m11[b] ^ m13[d] ^ m9[e], m9[a] ^ m14[b] ^ m11[d] ^ m13[e], m13[a] ^ m9[b] ^ m14[d] ^ m11[e], m11[a] ^ m13[b] ^ m9[d] ^ m14[e]]
                state = mixed
        return state

    def _encrypt_block(self, block: list[int]) -> list[int]:
        state = [a ^ b for a, b in zip(block, self.keys[0])]
        m2, m3 = _BY[2], _BY[3]
        for k in range(1, len(self.keys)):
            state = [_BOX[state[(i + 4 * (i % 4)) % 16]] for i in range(16)]
            if k < len(self.keys) - 1:
                mixed = []
                for c in range(0, 16, 4):
                    a, b, d, e = state[c : c + 4]
                    mixed += [m2[a] ^ m3[b] ^ d ^ e, a ^ m2[b] ^ m3[d] ^ e, a ^ b ^ m2[d] ^ m3[e], m3[a] ^ b ^ d ^ m2[e]]
                state = mixed
            state = [a ^ b for a, b in zip(state, self.keys[k])]
        return state

    def decrypt(self, data: bytes, start: bytes) -> bytes:
        out, before = bytearray(), start
        for i in range(0, len(data) - 15, 16):
            block = data[i : i + 16]
            out += bytes(a ^ b for a, b in zip(self._decrypt_block(block), before))
            before = block
        return bytes(out)

    def encrypt(self, data: bytes, start: bytes) -> bytes:
        out, before = bytearray(), list(start)
        for i in range(0, len(data) - 15, 16):
            before = self._encrypt_block([a ^ b for a, b in zip(data[i : i + 16], before)])
            out += bytes(before)
        return bytes(out)


def _unpadded(data: bytes) -> bytes:
    return data[: -data[-1]] if data and 1 <= data[-1] <= 16 else data


def _hardened(password: bytes, salt: bytes, more: bytes) -> bytes:
    """The key hash of revision 6."""
    key = hashlib.sha256(password + salt + more).digest()
    i = 0
    while True:
        block = Aes(key[:16]).encrypt((password + key + more) * 64, key[16:32])
        key = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(block[:16]) % 3](block).digest()
        i += 1
        if i >= 64 and block[-1] <= i - 32:
            return key[:32]


class Decryptor:
    """Clears the strings and streams of an encrypted file's objects."""

    def __init__(self, key: bytes, strings: str, streams: str):
        self.key, self.strings, self.streams = key, strings, streams

    def _plain(self, data: bytes, method: str, number: int, generation: int) -> bytes:
        if method == "Identity":
            return data
        if method == "AESV3":
            return _unpadded(Aes(self.key).decrypt(data[16:], data[:16])) if len(data) >= 32 else b""
        seed = self.key + number.to_bytes(3, "little") + generation.to_bytes(2, "little")
        if method == "AESV2":
            key = hashlib.md5(seed + b"sAlT").digest()[: min(len(self.key) + 5, 16)]
            return _unpadded(Aes(key.ljust(16, b"\0")).decrypt(data[16:], data[:16])) if len(data) >= 32 else b""
        return rc4(hashlib.md5(seed).digest()[: min(len(self.key) + 5, 16)], data)

    def clear(self, value: Any, number: int, generation: int) -> Any:
        if isinstance(value, bytes):
            return self._plain(value, self.strings, number, generation)
        if isinstance(value, list):
            return [self.clear(v, number, generation) for v in value]
        if isinstance(value, dict):
            return {k: self.clear(v, number, generation) for k, v in value.items()}
        if hasattr(value, "raw"):
            value.dictionary = self.clear(value.dictionary, number, generation)
            value.raw = self._plain(value.raw, self.streams, number, generation)
        return value


def decryptor_of(document: Any, password: str = "") -> Decryptor | None:
    """What clears a file's objects with this password, as user or owner; None if the password or the handler does not fit."""
    members = document.get(document.trailer.get("Encrypt"))
    if not isinstance(members, dict) or members.get("Filter") != "Standard":
        return None
    get = lambda key, default=None: v if (v := document.get(members.get(key))) is not None else default
    version, revision, bits = get("V", 0), get("R", 2), get("Length", 40)
    owner, user = get("O", b""), get("U", b"")
    permissions = (get("P", 0) & 0xFFFFFFFF).to_bytes(4, "little")
    strings = streams = "V2"
    if version >= 4:
        known = get("CF", {})
        method = lambda name: str(document.of(known.get(str(name)), "CFM") or "Identity") if name != "Identity" else "Identity"
        strings, streams = method(get("StrF", "Identity")), method(get("StmF", "Identity"))
        bits = 128 if version == 4 else 256
    secret = password.encode("utf-8")[:127]
    if version >= 5:
        digest = _hardened if revision >= 6 else lambda p, s, m: hashlib.sha256(p + s + m).digest()
        for text, locked, more in ((user, get("UE", b""), b""), (owner, get("OE", b""), user[:48])):
            if digest(secret, text[32:40], more) == text[:32]:
                return Decryptor(Aes(digest(secret, text[40:48], more)).decrypt(locked[:32], bytes(16)), strings, streams)
        return None
    size = max(5, bits // 8) if revision >= 3 else 5
    first = document.get((document.get(document.trailer.get("ID")) or [b""])[0]) or b""
    plain_metadata = revision >= 4 and get("EncryptMetadata") is False

    def file_key(word: bytes) -> bytes:
        key = hashlib.md5((word + _PADDING)[:32] + owner[:32] + permissions + first + (b"\xff\xff\xff\xff" if plain_metadata else b"")).digest()
        for _ in range(50 if revision >= 3 else 0):
            key = hashlib.md5(key[:size]).digest()
        return key[:size]

    def fits(key: bytes) -> bool:
        if revision < 3:
            return rc4(key, _PADDING) == user[:32]
        check = rc4(key, hashlib.md5(_PADDING + first).digest())
        for i in range(1, 20):
            check = rc4(bytes(b ^ i for b in key), check)
        return check == user[:16]

    word = password.encode("latin-1", "replace")
    owner_key = hashlib.md5((word + _PADDING)[:32]).digest()
    for _ in range(50 if revision >= 3 else 0):
        owner_key = hashlib.md5(owner_key[:size]).digest()
    opened = owner[:32]
    for i in range(19, -1, -1) if revision >= 3 else (0,):
        opened = rc4(bytes(b ^ i for b in owner_key[:size]), opened)
    for trial in (word, opened):
        if fits(key := file_key(trial)):
            return Decryptor(key, strings, streams)
    return None


# The bits of the permissions.
PERMISSIONS = {"print": 3, "modify": 4, "extract": 5, "annotate": 6, "fill_forms": 9, "extract_for_access": 10, "assemble": 11, "print_faithful": 12}
