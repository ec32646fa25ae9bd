"""PDF stream filters. Each takes and gives bytes and never raises; what can't be decoded is empty or cut short."""

from __future__ import annotations

import zlib

import numpy as np

from quire.sources.pdf_syntax import Name, whole

# Filters of encoded images, which hold no text.
IMAGE_FILTERS = {"DCTDecode", "DCT", "JPXDecode", "CCITTFaxDecode", "CCF", "JBIG2Decode"}


def flate(data: bytes) -> bytes:
    """Zlib; else raw deflate; else raw deflate behind a broken header. A complete stream may be followed by junk."""
    for skip, wbits in ((0, 15), (0, -15), (2, -15)):
        unzip = zlib.decompressobj(wbits)
        try:
            out = unzip.decompress(data[skip:])
        except zlib.error:
            continue
        if unzip.eof or out:
            return out
    return b""


def lzw(data: bytes, early: int = 1) -> bytes:
    out, table, width, previous = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 9, None
    bits = held = 0
    for byte in data:
        bits, held = (bits << 8 | byte) & 0xFFFFFF, held + 8
        if held < width:
            continue
        held -= width
        code = bits >> held & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, previous = 9, None
            continue
        if code < len(table):
            entry = table[code]
        elif previous is not None:
            entry = previous + previous[:1]
        else:
            break
        out += entry
        if previous is not None:
            table.append(previous + entry[:1])
        previous = entry
        if width < 12 and len(table) + early >= 1 << width:
            width += 1
    return bytes(out)


def ascii_hex(data: bytes) -> bytes:
    digits = bytes(c for c in data.partition(b">")[0] if c in b"0123456789abcdefABCDEF")
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def ascii85(data: bytes) -> bytes:
    data = data.removeprefix(b"<~").partition(b"~")[0]
    out, group = bytearray(), []
    for c in data:
        if c == 0x7A and not group:
            out += bytes(4)
        elif 0x21 <= c <= 0x75:
            group.append(c - 0x21)
            if len(group) == 5:
                out += _five(group)
                group = []
    if group:
        out += _five(group + [84] * (5 - len(group)))[: len(group) - 1]
    return bytes(out)


def _five(group: list[int]) -> bytes:
    value = 0
    for g in group:
        value = value * 85 + g
    return (value & 0xFFFFFFFF).to_bytes(4, "big")


def run_length(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and (n := data[i]) != 128:
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def unpredict(data: bytes, parms: dict, resolve) -> bytes:
    """Undo PNG (10 and up) or TIFF (2) prediction."""
    get = lambda key, otherwise: whole(resolve(parms.get(key)), otherwise)
    predictor, colors, bits, columns = get("Predictor", 1), get("Colors", 1), get("BitsPerComponent", 8), get("Columns", 1)
    row, step = -(-columns * colors * bits // 8), min(64, max(1, -(-colors * bits // 8)))
    if predictor <= 1 or row <= 0 or not data:
        return data
    if predictor == 2:
        if bits != 8:
            return data
        full = len(data) // row * row
        pixels = np.frombuffer(data[:full], np.uint8).reshape(-1, row)
        out = pixels.copy()
        for c in range(step):
            out[:, c::step] = np.cumsum(pixels[:, c::step], axis=1, dtype=np.uint8)
        return out.tobytes() + data[full:]
    out, above = bytearray(), bytes(row)
    for start in range(0, len(data) // (row + 1) * (row + 1), row + 1):
        kind, line = data[start], bytearray(data[start + 1 : start + 1 + row])
        if kind == 2:
            line = bytearray((np.frombuffer(bytes(line), np.uint8) + np.frombuffer(above, np.uint8)).astype(np.uint8).tobytes())
        elif kind in (1, 3, 4):
            for i in range(row):
                left, up, corner = (line[i - step], above[i], above[i - step]) if i >= step else (0, above[i], 0)
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + up) >> 1
                else:  # of left, up and corner the one nearest to left + up - corner
                    guess = min((abs(up - corner), 0, left), (abs(left - corner), 1, up), (abs(left + up - 2 * corner), 2, corner))[2]
                line[i] = (line[i] + guess) & 0xFF
        above = bytes(line)
        out += above
    return bytes(out)


def decode_stream(raw: bytes, info: dict, resolve=lambda v: v) -> bytes | None:
    """The stream's data after its filters; None for an encoded image. Unknown filters leave the data as it is."""

    def listed(key: str) -> list:
        value = resolve(info.get(key))
        return [resolve(v) for v in value] if isinstance(value, list) else [value]

    filters = [f for f in listed("Filter") if isinstance(f, Name)]
    parms = [p if isinstance(p, dict) else {} for p in listed("DecodeParms")]
    for i, name in enumerate(filters):
        p = parms[i] if i < len(parms) else {}
        if name in IMAGE_FILTERS:
            return None
        if name in ("FlateDecode", "Fl"):
            raw = unpredict(flate(raw), p, resolve)
        elif name in ("LZWDecode", "LZW"):
            raw = unpredict(lzw(raw, whole(resolve(p.get("EarlyChange")), 1)), p, resolve)
        elif name in ("ASCIIHexDecode", "AHx"):
            raw = ascii_hex(raw)
        elif name in ("ASCII85Decode", "A85"):
            raw = ascii85(raw)
        elif name in ("RunLengthDecode", "RL"):
            raw = run_length(raw)
    return raw
