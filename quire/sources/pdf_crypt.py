"""The Standard security handler, revisions 2 to 6, without a crypto package.

AES works on all blocks of a message at once where the mode allows it
(decryption); its tables are computed, not listed. Encryption, of which revision
6 takes some 20,000 blocks for a hash, is done by the library that Python's
hashlib is linked to, where it has AES, and by the tables elsewhere. Passwords of revisions 2 to
4 are verified, and the owner's is tried as well; a document that neither opens
is locked. Revision 5 hashes once, revision 6 in rounds.
"""

from __future__ import annotations

import ctypes
import hashlib
import struct
from functools import lru_cache

import numpy as np

from quire.sources.pdf_syntax import Name, whole

# Fixed value: the padding of short passwords.
PAD = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")


def rc4(key: bytes, data: bytes) -> bytes:
    if not key:
        return data
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, x, y = bytearray(len(data)), 0, 0
    for n, c in enumerate(data):
        x = (x + 1) & 255
        a = s[x]
        y = (y + a) & 255
        b = s[y]
        s[x], s[y] = b, a
        out[n] = c ^ s[(a + b) & 255]
    return bytes(out)


def _double(x: int) -> int:
    return (x << 1) ^ (0x11B if x & 0x80 else 0)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """S-box, its inverse, and multiplication tables of the field."""
    power, log, x = [0] * 255, [0] * 256, 1
    for i in range(255):
        power[i], log[x] = x, i
        x ^= _double(x)
    box = np.zeros(256, np.uint8)
    for v in range(256):
        b = power[-log[v] % 255] if v else 0
        box[v] = 0x63 ^ b ^ ((b << 1 | b >> 7) & 255) ^ ((b << 2 | b >> 6) & 255) ^ ((b << 3 | b >> 5) & 255) ^ ((b << 4 | b >> 4) & 255)
    inverse = np.zeros(256, np.uint8)
    inverse[box] = np.arange(256, dtype=np.uint8)
    times = {m: np.array([power[(log[v] + log[m]) % 255] if v else 0 for v in range(256)], np.uint8) for m in (2, 3, 9, 11, 13, 14)}
    return box, inverse, times


@lru_cache(maxsize=64)
def _round_keys(key: bytes) -> np.ndarray:
    box, words, n = _tables()[0], [list(key[i : i + 4]) for i in range(0, len(key), 4)], len(key) // 4
    constant = 1
    for i in range(n, 4 * (n + 7)):
        t = words[-1]
        if i % n == 0:
            t = [int(box[b]) for b in t[1:] + t[:1]]
            t[0] ^= constant
            constant = _double(constant)
        elif n > 6 and i % n == 4:
            t = [int(box[b]) for b in t]
        words.append([a ^ b for a, b in zip(words[i - n], t)])
    return np.array(words, np.uint8).reshape(-1, 16)


_SHIFT = np.array([(i + 4 * (i % 4)) % 16 for i in range(16)])
_UNSHIFT = np.argsort(_SHIFT)


def _mixed(s: np.ndarray, factors: tuple[int, int, int, int]) -> np.ndarray:
    times = _tables()[2]
    c = s.reshape(-1, 4, 4)
    part = {f: c if f == 1 else times[f][c] for f in set(factors)}
    rows = [part[factors[0]][:, :, r] ^ part[factors[1]][:, :, (r + 1) % 4] ^ part[factors[2]][:, :, (r + 2) % 4] ^ part[factors[3]][:, :, (r + 3) % 4] for r in range(4)]
    return np.stack(rows, axis=2).reshape(-1, 16)


def aes_decrypt_blocks(key: bytes, data: bytes) -> np.ndarray:
    keys, inverse = _round_keys(key), _tables()[1]
    s = np.frombuffer(data, np.uint8).reshape(-1, 16) ^ keys[-1]
    for k in keys[-2:0:-1]:
        s = _mixed(inverse[s[:, _UNSHIFT]] ^ k, (14, 11, 13, 9))
    return inverse[s[:, _UNSHIFT]] ^ keys[0]


def cbc_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    before = np.frombuffer(iv + data[:-16], np.uint8).reshape(-1, 16)
    return (aes_decrypt_blocks(key, data) ^ before).tobytes() if data else b""


@lru_cache(maxsize=1)
def _columns() -> list[list[int]]:
    """What a byte in each row adds to a column after substitution and mixing, as a 32-bit word; last, the S-box."""
    box, times = _tables()[0].astype(int).tolist(), _tables()[2]
    by = {1: box, **{m: [int(times[m][v]) for v in box] for m in (2, 3)}}
    tables = [[by[f[0]][x] << 24 | by[f[1]][x] << 16 | by[f[2]][x] << 8 | by[f[3]][x] for x in range(256)] for f in ((2, 1, 1, 3), (3, 2, 1, 1), (1, 3, 2, 1), (1, 1, 3, 2))]
    return [*tables, box]


@lru_cache(maxsize=1)
def _openssl() -> ctypes.CDLL | None:
    """The library that Python's hashlib is linked to, if it is one with AES."""
    try:
        import _hashlib

        library = ctypes.CDLL(_hashlib.__file__)
        for name in ("EVP_CIPHER_CTX_new", "EVP_aes_128_cbc", "EVP_aes_256_cbc"):
            getattr(library, name).restype = ctypes.c_void_p
        return library if library.EVP_EncryptInit_ex and library.EVP_EncryptUpdate and library.EVP_CIPHER_CTX_free else None
    except (ImportError, OSError, AttributeError):
        return None


def _cbc_by_openssl(library: ctypes.CDLL, key: bytes, iv: bytes, data: bytes) -> bytes | None:
    """None if the library refuses; whole blocks come out at once, so there is no padding to end with."""
    pointer, done = ctypes.c_void_p, ctypes.c_int(0)
    cipher = {16: library.EVP_aes_128_cbc, 32: library.EVP_aes_256_cbc}.get(len(key))
    context, out = pointer(library.EVP_CIPHER_CTX_new()), ctypes.create_string_buffer(len(data) + 16)
    try:
        if not cipher or not context or library.EVP_EncryptInit_ex(context, pointer(cipher()), None, key, iv) != 1:
            return None
        if library.EVP_EncryptUpdate(context, out, ctypes.byref(done), data, len(data)) != 1 or done.value != len(data):
            return None
        return out.raw[: len(data)]
    finally:
        library.EVP_CIPHER_CTX_free(context)


def cbc_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """Whole blocks; by the library behind hashlib, or else by tables."""
    library = _openssl()
    coded = _cbc_by_openssl(library, key, iv, data) if library is not None and 0 < len(data) < 1 << 30 else None
    return cbc_by_tables(key, iv, data) if coded is None else coded


def cbc_by_tables(key: bytes, iv: bytes, data: bytes) -> bytes:
    """Each block depends on the one before, so this goes column by column of one block."""
    p, q, r, s, box = _columns()
    keys = struct.unpack(f">{4 * len(_round_keys(key))}I", _round_keys(key).tobytes())
    a, b, c, d = struct.unpack(">4I", iv)
    words, out = struct.unpack(f">{len(data) // 4}I", data), []
    for i in range(0, len(words), 4):
        a, b, c, d = (x ^ y ^ k for x, y, k in zip((a, b, c, d), words[i : i + 4], keys))
        for k in range(4, len(keys) - 4, 4):
            a, b, c, d = (
                p[a >> 24] ^ q[b >> 16 & 255] ^ r[c >> 8 & 255] ^ s[d & 255] ^ keys[k],
                p[b >> 24] ^ q[c >> 16 & 255] ^ r[d >> 8 & 255] ^ s[a & 255] ^ keys[k + 1],
                p[c >> 24] ^ q[d >> 16 & 255] ^ r[a >> 8 & 255] ^ s[b & 255] ^ keys[k + 2],
                p[d >> 24] ^ q[a >> 16 & 255] ^ r[b >> 8 & 255] ^ s[c & 255] ^ keys[k + 3],
            )
        last = ((a, b, c, d), (b, c, d, a), (c, d, a, b), (d, a, b, c))
        a, b, c, d = ((box[w >> 24] << 24 | box[x >> 16 & 255] << 16 | box[y >> 8 & 255] << 8 | box[z & 255]) ^ k for (w, x, y, z), k in zip(last, keys[-4:]))
        out += (a, b, c, d)
    return struct.pack(f">{len(out)}I", *out)


def aes_unwrap(key: bytes, data: bytes) -> bytes:
    """A string or stream: the IV first, padding cut where it is plausible."""
    if len(data) < 32 or len(data) % 16:
        return b""
    plain = cbc_decrypt(key, data[:16], data[16:])
    pad = plain[-1]
    return plain[:-pad] if 1 <= pad <= 16 else plain


def hash_2b(password: bytes, salt: bytes, extra: bytes, revision: int) -> bytes:
    k = hashlib.sha256(password + salt + extra).digest()
    if revision == 5:
        return k
    done = 0
    while True:
        e = cbc_encrypt(k[:16], k[16:32], (password + k + extra) * 64)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        done += 1
        if done >= 64 and e[-1] <= done - 32 or done > 257:
            return k[:32]


class Decryptor:
    """Decrypts the strings and streams of one document."""

    def __init__(self, key: bytes, streams: str, strings: str):
        self.key, self.streams, self.strings = key, streams, strings

    @classmethod
    def open(cls, info: dict, resolve, file_id: bytes, password: str = "") -> Decryptor | None:
        get = lambda key: resolve(info.get(key))
        raw = lambda key: v if isinstance(v := get(key), bytes) else b""
        if get("Filter") != "Standard":
            return None
        version, revision, bits = whole(get("V")), whole(get("R")), whole(get("Length"), 40)
        streams = strings = "none" if version >= 4 else "rc4"
        if version >= 4:
            filters = get("CF")
            for use in ("StmF", "StrF"):
                name = get(use)
                entry = resolve(filters.get(name)) if isinstance(filters, dict) and isinstance(name, Name) and name != "Identity" else None
                method = "none"
                if isinstance(entry, dict):
                    length = whole(resolve(entry.get("Length")))
                    if length > 0:
                        bits = length * 8 if length <= 64 else length  # bytes or bits, both are written
                    method = {"V2": "rc4", "AESV2": "aes128", "AESV3": "aes256"}.get(resolve(entry.get("CFM")), "none")
                streams, strings = (method, strings) if use == "StmF" else (streams, method)
        secret = password.encode("latin-1", "replace")
        if revision >= 5:
            key = _key_256(secret, raw("U"), raw("UE"), raw("O"), raw("OE"), revision)
            streams = strings = "aes256"
        else:
            meta = get("EncryptMetadata")
            key = _key_legacy(secret, raw("O"), raw("U"), whole(get("P"), -1), file_id, revision, bits, meta is not False)
        return None if key is None else cls(key, streams, strings)

    def _apply(self, how: str, data: bytes, number: int, generation: int) -> bytes:
        if how == "none":
            return data
        if how == "aes256":
            return aes_unwrap(self.key, data)
        salt = b"sAlT" if how == "aes128" else b""
        mixed = hashlib.md5(self.key + number.to_bytes(4, "little")[:3] + generation.to_bytes(4, "little")[:2] + salt).digest()
        key = mixed[: min(16, len(self.key) + 5)]
        return rc4(key, data) if how == "rc4" else aes_unwrap(key, data)

    def string(self, data: bytes, number: int, generation: int) -> bytes:
        return self._apply(self.strings, data, number, generation)

    def stream(self, data: bytes, number: int, generation: int) -> bytes:
        return self._apply(self.streams, data, number, generation)


def _padded(password: bytes) -> bytes:
    return (password + PAD)[:32]


def _key_legacy(password: bytes, owner: bytes, user: bytes, permissions: int, file_id: bytes, revision: int, bits: int, metadata: bool) -> bytes | None:
    size = 5 if revision == 2 else min(16, max(5, bits // 8))

    def file_key(secret: bytes) -> bytes:
        tail = b"" if metadata or revision < 4 else b"\xff" * 4
        k = hashlib.md5(_padded(secret) + owner + (permissions & 0xFFFFFFFF).to_bytes(4, "little") + file_id + tail).digest()
        for _ in range(50 if revision >= 3 else 0):
            k = hashlib.md5(k[:size]).digest()
        return k[:size]

    def opens(key: bytes) -> bool:
        if revision == 2:
            return rc4(key, PAD) == user[:32]
        check = hashlib.md5(PAD + file_id).digest()
        for i in range(20):
            check = rc4(bytes(b ^ i for b in key), check)
        return check == user[:16]

    def user_secret() -> bytes:
        k = hashlib.md5(_padded(password)).digest()
        for _ in range(50 if revision >= 3 else 0):
            k = hashlib.md5(k).digest()
        secret = owner[:32]
        for i in range(19, -1, -1) if revision >= 3 else (0,):
            secret = rc4(bytes(b ^ i for b in k[:size]), secret)
        return secret

    for secret in (password, user_secret()):
        key = file_key(secret)
        if opens(key):
            return key
    return None


def _key_256(password: bytes, u: bytes, ue: bytes, o: bytes, oe: bytes, revision: int) -> bytes | None:
    for entry, wrapped, extra in ((u, ue, b""), (o, oe, u[:48])):
        if len(entry) >= 48 and len(wrapped) >= 32 and hash_2b(password, entry[32:40], extra, revision) == entry[:32]:
            return cbc_decrypt(hash_2b(password, entry[40:48], extra, revision), bytes(16), wrapped[:32])
    return None
