"""Small PDF and font files made byte by byte, for the registered queries and the tests.

They take every way in that the readers know: filters, predictors, encryption,
object streams, damaged tables, character maps of each format, ligatures.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib

from quire.sources import pdf_crypt


def obj(n, body):
    return b"%d 0 obj\n%s\nendobj\n" % (n, body if isinstance(body, bytes) else body.encode("latin-1"))


def stream(n, data, extra="", length=None):
    return obj(n, b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data) if length is None else length, extra.encode("latin-1"), data))


def classic(objects, root=1, extra=""):
    """A file with a classic cross-reference table; ``objects``: number -> bytes of the whole object."""
    out, at = b"%PDF-1.4\n", {}
    for n, raw in objects.items():
        at[n] = len(out)
        out += raw
    start, size = len(out), max(objects) + 1
    out += b"xref\n0 %d\n0000000000 65535 f \n" % size
    for n in range(1, size):
        out += b"%010d 00000 %s \n" % (at.get(n, 0), b"n" if n in at else b"f")
    return out + b"trailer\n<< /Size %d /Root %d 0 R %s >>\nstartxref\n%d\n%%%%EOF\n" % (size, root, extra.encode("latin-1"), start)


def one_page(content, fonts="/F1 5 0 R", font="<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", extra=None, filters="", trailer=""):
    objects = {
        1: obj(1, "<< /Type /Catalog /Pages 2 0 R >>"),
        2: obj(2, f"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << {fonts} >> >> /MediaBox [0 0 612 792] >>"),
        3: obj(3, "<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>"),
        4: stream(4, content, filters),
        5: obj(5, font),
    }
    objects.update(extra or {})
    return classic(objects, extra=trailer)


def packed(content):
    """The same with an object stream and a cross-reference stream."""
    inner = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>", 5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"}
    head, body = b"", b""
    for n, raw in inner.items():
        head += b"%d %d " % (n, len(body))
        body += raw + b" "
    out, at = b"%PDF-1.5\n", {}
    at[4] = len(out)
    out += stream(4, zlib.compress(content), "/Filter /FlateDecode")
    at[6] = len(out)
    out += stream(6, zlib.compress(head + body), f"/Type /ObjStm /N {len(inner)} /First {len(head)} /Filter /FlateDecode")
    at[7] = len(out)
    rows = b""
    for n in range(8):
        if n in inner:
            rows += struct.pack(">BHB", 2, 6, list(inner).index(n))
        else:
            rows += struct.pack(">BHB", 1 if n in at else 0, at.get(n, 0), 0)
    coded = b"".join(b"\x02" + bytes((a - b) & 255 for a, b in zip(rows[i : i + 4], rows[i - 4 : i] if i else bytes(4))) for i in range(0, len(rows), 4))
    out += stream(7, zlib.compress(coded), "/Type /XRef /Size 8 /W [1 2 1] /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 4 >>")
    return out + b"startxref\n%d\n%%%%EOF\n" % at[7]


def table_font(tables):
    """An sfnt file of the given tables."""
    out, body, at = struct.pack(">IHHHH", 0x00010000, len(tables), 0, 0, 0), b"", 12 + 16 * len(tables)
    for tag in sorted(tables):
        data = tables[tag]
        out += tag.encode() + struct.pack(">III", 0, at + len(body), len(data))
        body += data + bytes(-len(data) % 4)
    return out + body


def cmap12(pairs):
    groups = b"".join(struct.pack(">III", c, c, g) for c, g in sorted(pairs.items()))
    return struct.pack(">HHHHI", 0, 1, 3, 10, 12) + struct.pack(">HHIII", 12, 0, 16 + len(groups), 0, len(pairs)) + groups


def gsub_ligatures(ligatures, feature=b"pres", script=b"beng"):
    """A GSUB with one ligature lookup: {(first, second, ...): glyph}."""
    by = {}
    for parts, g in ligatures.items():
        by.setdefault(parts[0], []).append((parts[1:], g))
    firsts = sorted(by)
    sets = []
    for f in firsts:
        ligs = [struct.pack(">HH", g, len(rest) + 1) + struct.pack(f">{len(rest)}H", *rest) for rest, g in by[f]]
        offs, at = b"", 2 + 2 * len(ligs)
        for lig in ligs:
            offs += struct.pack(">H", at)
            at += len(lig)
        sets.append(struct.pack(">H", len(ligs)) + offs + b"".join(ligs))
    head = 6 + 2 * len(sets)
    offs, at = b"", head
    for s in sets:
        offs += struct.pack(">H", at)
        at += len(s)
    sub = struct.pack(">HHH", 1, at, len(sets)) + offs + b"".join(sets) + struct.pack(">HH", 1, len(firsts)) + struct.pack(f">{len(firsts)}H", *firsts)
    lookup = struct.pack(">HHHH", 4, 0, 1, 8) + sub
    lookups = struct.pack(">HH", 1, 4) + lookup
    features = struct.pack(">H", 1) + feature + struct.pack(">H", 8) + struct.pack(">HHH", 0, 1, 0)
    scripts = struct.pack(">H", 1) + script + struct.pack(">H", 8) + struct.pack(">HH", 4, 0) + struct.pack(">HHHH", 0, 0xFFFF, 1, 0)
    a, b = 10 + len(scripts), 10 + len(scripts) + len(features)
    return struct.pack(">HHHHH", 1, 0, 10, a, b) + scripts + features + lookups


def simple_tables(glyphs=40, upem=1000):
    """head, hhea, hmtx, maxp for ``glyphs`` glyphs of width 500."""
    head = bytearray(54)
    struct.pack_into(">III", head, 0, 0x00010000, 0, 0)
    struct.pack_into(">I", head, 12, 0x5F0F3CF5)
    struct.pack_into(">H", head, 18, upem)
    hhea = bytearray(36)
    struct.pack_into(">Ihh", hhea, 0, 0x00010000, 800, -200)
    struct.pack_into(">H", hhea, 34, glyphs)
    return {"head": bytes(head), "hhea": bytes(hhea), "hmtx": struct.pack(">Hh", 500, 0) * glyphs, "maxp": struct.pack(">IH", 0x00010000, glyphs)}


def encode_lzw(data):
    """Codes of growing width, as a writer makes them."""
    table, bits, n = {bytes([i]): i for i in range(256)}, "100000000", 9
    word, size = b"", 258
    for c in data:
        if word + bytes([c]) in table:
            word += bytes([c])
            continue
        bits += f"{table[word]:0{n}b}"
        table[word + bytes([c])] = size
        size += 1
        if size in (512, 1024, 2048):
            n += 1
        if size == 4094:
            bits += f"{256:0{n}b}"
            table, n, size = {bytes([i]): i for i in range(256)}, 9, 258
        word = bytes([c])
    if word:
        bits += f"{table[word]:0{n}b}"
        n += size + 1 in (512, 1024, 2048)  # a reader adds an entry for the last word, too
    bits += f"{257:0{n}b}"
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def legacy_encrypted(content, revision, bits, aes=False, user=b"", owner=b"own"):
    file_id, permissions = b"0123456789abcdef", -4
    size = 5 if revision == 2 else bits // 8
    k = hashlib.md5((owner + pdf_crypt.PAD)[:32]).digest()
    for _ in range(50 if revision >= 3 else 0):
        k = hashlib.md5(k).digest()
    o = (user + pdf_crypt.PAD)[:32]
    for i in range(20 if revision >= 3 else 1):
        o = pdf_crypt.rc4(bytes(b ^ i for b in k[:size]), o)
    key = hashlib.md5((user + pdf_crypt.PAD)[:32] + o + struct.pack("<i", permissions) + file_id).digest()
    for _ in range(50 if revision >= 3 else 0):
        key = hashlib.md5(key[:size]).digest()
    key = key[:size]
    if revision == 2:
        u = pdf_crypt.rc4(key, pdf_crypt.PAD)
    else:
        u = hashlib.md5(pdf_crypt.PAD + file_id).digest()
        for i in range(20):
            u = pdf_crypt.rc4(bytes(b ^ i for b in key), u)
        u += bytes(16)

    def lock(n, data):
        mixed = hashlib.md5(key + n.to_bytes(3, "little") + bytes(2) + (b"sAlT" if aes else b"")).digest()[: min(16, size + 5)]
        if not aes:
            return pdf_crypt.rc4(mixed, data)
        pad = 16 - len(data) % 16
        return bytes(range(16)) + pdf_crypt.cbc_encrypt(mixed, bytes(range(16)), data + bytes([pad]) * pad)

    v = 4 if aes else 1 if revision == 2 else 2
    cf = "/CF << /StdCF << /CFM /AESV2 /Length 16 >> >> /StmF /StdCF /StrF /StdCF" if aes else ""
    encrypt = f"<< /Filter /Standard /V {v} /R {revision} /Length {bits} /P {permissions} /O <{o.hex()}> /U <{u.hex()}> {cf} >>"
    return one_page(lock(4, content), extra={9: obj(9, encrypt)}, trailer=f"/Encrypt 9 0 R /ID [<{file_id.hex()}> <00>]")


def modern_encrypted(content, revision, user=b"", owner=b"own"):
    key, salts = bytes(range(32)), (b"vsaltusr", b"ksaltusr", b"vsaltown", b"ksaltown")
    h = lambda *a: pdf_crypt.hash_2b(*a, revision)
    u = h(user, salts[0], b"") + salts[0] + salts[1]
    ue = pdf_crypt.cbc_encrypt(h(user, salts[1], b""), bytes(16), key)
    o = h(owner, salts[2], u) + salts[2] + salts[3]
    oe = pdf_crypt.cbc_encrypt(h(owner, salts[3], u), bytes(16), key)
    pad = 16 - len(content) % 16
    locked = bytes(16) + pdf_crypt.cbc_encrypt(key, bytes(16), content + bytes([pad]) * pad)
    encrypt = f"<< /Filter /Standard /V 5 /R {revision} /Length 256 /P -4 /O <{o.hex()}> /U <{u.hex()}> /OE <{oe.hex()}> /UE <{ue.hex()}> /CF << /StdCF << /CFM /AESV3 >> >> /StmF /StdCF /StrF /StdCF >>"
    return one_page(locked, extra={9: obj(9, encrypt)}, trailer="/Encrypt 9 0 R")


def png_rows(data: bytes, row: int) -> bytes:
    """PNG-predicted rows of ``row`` bytes, each of the next kind in turn; ``data`` fills whole rows."""
    out, above = bytearray(), bytes(row)
    for k, start in enumerate(range(0, len(data), row)):
        line, kind = data[start : start + row], k % 5
        out.append(kind)
        for i, v in enumerate(line):
            left, up, corner = line[i - 1] if i else 0, above[i], above[i - 1] if i else 0
            nearest = min((abs(up - corner), 0, left), (abs(left - corner), 1, up), (abs(left + up - 2 * corner), 2, corner))[2]
            out.append((v - (0, left, up, (left + up) // 2, nearest)[kind]) & 255)
        above = line
    return bytes(out)


def tiff_rows(data: bytes, row: int) -> bytes:
    """Differences to the byte before, within rows of ``row`` bytes."""
    out = bytearray(data)
    for start in range(0, len(data) // row * row, row):
        for i in range(row - 1, 0, -1):
            out[start + i] = (data[start + i] - data[start + i - 1]) & 255
    return bytes(out)


def run_lengths(data: bytes) -> bytes:
    """Runs of three and more as such, the rest as they are."""
    out, at = bytearray(), 0
    while at < len(data):
        same = 1
        while same < 128 and data[at + same : at + same + 1] == data[at : at + 1]:
            same += 1
        if same > 2:
            out += bytes([257 - same, data[at]])
            at += same
            continue
        end = at + 1
        while end < len(data) and end - at < 128 and data[end : end + 3] != data[end : end + 1] * 3:
            end += 1
        out += bytes([end - at - 1]) + data[at:end]
        at = end
    return bytes(out) + b"\x80"


PREDICTED_ROW = 64
#: Name, entries of the stream's dictionary and encoder of each way to write a stream.
WAYS = {
    "flate": ("/Filter /FlateDecode", zlib.compress),
    "hex": ("/Filter /AHx", lambda d: d.hex().encode() + b">"),
    "85": ("/Filter /ASCII85Decode", lambda d: base64.a85encode(d) + b"~>"),
    "runs": ("/Filter /RL", run_lengths),
    "lzw": ("/Filter /LZWDecode", encode_lzw),
    "png": (f"/Filter /FlateDecode /DecodeParms << /Predictor 15 /Columns {PREDICTED_ROW} >>", lambda d: zlib.compress(png_rows(d + b" " * (-len(d) % PREDICTED_ROW), PREDICTED_ROW))),
    "tiff": (f"/Filter /FlateDecode /DecodeParms << /Predictor 2 /Columns {PREDICTED_ROW} >>", lambda d: zlib.compress(tiff_rows(d, PREDICTED_ROW))),
    "chain": ("/Filter [/A85 /Fl] /DecodeParms [null null]", lambda d: base64.a85encode(zlib.compress(d)) + b"~>"),
    "image": ("/Filter /DCTDecode", lambda d: d),
}


def one_stream(data: bytes, way: str) -> bytes:
    """A file that holds ``data`` as its only stream, object 4."""
    extra, encode = WAYS[way]
    return classic({1: obj(1, "<< /Type /Catalog >>"), 4: stream(4, encode(data), extra)})


def escaped(text: str) -> bytes:
    """A text in Latin-1 as a literal string."""
    raw = text.encode("latin-1", "replace")
    for c in (b"\\", b"(", b")"):
        raw = raw.replace(c, b"\\" + c)
    return b"(" + raw + b")"


def updated(old: bytes, new: bytes) -> bytes:
    """A page of content ``old`` whose content an update replaced."""
    base = one_page(old)
    start = int(base[base.rindex(b"startxref") + 9 :].split()[0])
    at = len(base)
    out = base + stream(4, new)
    return out + b"xref\n4 1\n%010d 00000 n \ntrailer\n<< /Size 6 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (at, start, len(out))


def structured(text: str, how: int) -> bytes:
    """A page that shows ``text``, in one of six structures."""
    content = b"BT /F1 12 Tf 0 700 Td " + escaped(text) + b" Tj ET"
    plain = one_page(content)
    return (
        plain,
        packed(content),
        plain[: plain.rindex(b"startxref")] + b"startxref\n99999999\n%%EOF",
        updated(b"BT /F1 12 Tf 0 700 Td (replaced) Tj ET", content),
        plain.replace(b"/Length %d" % len(content), b"/Length 3"),
        plain.replace(b"/Root 1 0 R", b"/Boot 1 0 R"),
    )[how % 6]


def locked_page(text: str, how: int, user: bytes) -> bytes:
    """A page that shows ``text``, encrypted in one of five ways; the owner's password is ``own``."""
    content = b"BT /F1 12 Tf 0 700 Td " + escaped(text) + b" Tj ET"
    if how % 5 < 3:
        revision, bits, aes = ((2, 40, False), (3, 128, False), (4, 128, True))[how % 5]
        return legacy_encrypted(content, revision, bits, aes, user)
    return modern_encrypted(content, (5, 6)[how % 5 - 3], user)


def cmap(pairs: dict[int, int], kind: int) -> bytes:
    """A character map in format 0, 4, 6 or 12."""
    if kind == 12:
        return cmap12(pairs)
    if kind == 0:
        table = struct.pack(">HHH", 0, 262, 0) + bytes(pairs.get(c, 0) for c in range(256))
    elif kind == 6:
        first, last = min(pairs), max(pairs)
        table = struct.pack(">HHHHH", 6, 10 + 2 * (last - first + 1), 0, first, last - first + 1) + b"".join(struct.pack(">H", pairs.get(c, 0)) for c in range(first, last + 1))
    else:
        codes = sorted(pairs)
        n = len(codes) + 1
        column = lambda values: struct.pack(f">{n}H", *values)
        body = column([*codes, 0xFFFF]) + b"\0\0" + column([*codes, 0xFFFF]) + column([*((pairs[c] - c) & 0xFFFF for c in codes), 1]) + column([0] * n)
        table = struct.pack(">HHHHHHH", 4, 14 + len(body), 0, 2 * n, 0, 0, 0) + body
    return struct.pack(">HHHHI", 0, 1, *((1, 0) if kind == 0 else (3, 1)), 12) + table


def named(name: str) -> dict[str, bytes]:
    """A name table with the PostScript name alone."""
    raw = name.encode("utf-16-be")
    return {"name": struct.pack(">HHH", 0, 1, 18) + struct.pack(">HHHHHH", 3, 1, 0, 6, len(raw), 0) + raw}


def outlined_font(pairs: dict[int, int], glyphs: int, kind: int = 12, advance=lambda g: 500, extra: dict[str, bytes] = {}) -> bytes:  # noqa: B006
    """A font whose glyphs are one empty contour each, so that it can be cut down."""
    shape = struct.pack(">hhhhh", 1, 0, 0, 100, 100) + bytes(6)
    tables = simple_tables(glyphs) | {"cmap": cmap(pairs, kind), "glyf": shape * glyphs, "loca": struct.pack(f">{glyphs + 1}H", *(len(shape) // 2 * i for i in range(glyphs + 1)))}
    return table_font(tables | {"hmtx": b"".join(struct.pack(">Hh", advance(g), 0) for g in range(glyphs))} | extra)


def composite(font_bytes: bytes, content: bytes, cmap: bytes | None = None, base: str = "ABCDEF+Kalpurush", glyph_map: bytes | None = None) -> bytes:
    """A page in a composite font with an embedded font file, and a ToUnicode map if ``cmap`` is given."""
    unicode_ref = "/ToUnicode 8 0 R" if cmap is not None else ""
    to_gid = "/Identity" if glyph_map is None else "11 0 R"
    extra = {6: obj(6, f"<< /Type /Font /Subtype /CIDFontType2 /FontDescriptor 7 0 R /CIDToGIDMap {to_gid} >>"), 7: obj(7, "<< /Type /FontDescriptor /FontFile2 10 0 R >>"), 10: stream(10, font_bytes)}
    if cmap is not None:
        extra[8] = stream(8, cmap)
    if glyph_map is not None:
        extra[11] = stream(11, glyph_map)
    return one_page(content, font=f"<< /Type /Font /Subtype /Type0 /BaseFont /{base} /Encoding /Identity-H /DescendantFonts [6 0 R] {unicode_ref} >>", extra=extra)


def _coverage(glyphs: list[int]) -> bytes:
    return struct.pack(f">HH{len(glyphs)}H", 1, len(glyphs), *glyphs)


def gsub(lookups: list[tuple[int, bytes]], features: list[tuple[bytes, list[int]]], script: bytes = b"bng2") -> bytes:
    """A GSUB of lookups (kind, subtable) and features (tag, lookup numbers) of one script."""
    tables = [struct.pack(">HHHH", kind, 0, 1, 8) + sub for kind, sub in lookups]
    at, offsets = 2 + 2 * len(tables), []
    for t in tables:
        offsets.append(at)
        at += len(t)
    lookup_list = struct.pack(f">H{len(offsets)}H", len(offsets), *offsets) + b"".join(tables)
    held = [struct.pack(f">HH{len(numbers)}H", 0, len(numbers), *numbers) for _, numbers in features]
    at, records = 2 + 6 * len(features), b""
    for (tag, _), table in zip(features, held):
        records += tag + struct.pack(">H", at)
        at += len(table)
    feature_list = struct.pack(">H", len(features)) + records + b"".join(held)
    scripts = struct.pack(">H", 1) + script + struct.pack(">H", 8) + struct.pack(">HH", 4, 0) + struct.pack(f">HHH{len(features)}H", 0, 0xFFFF, len(features), *range(len(features)))
    a = 10 + len(scripts)
    return struct.pack(">HHHHH", 1, 0, 10, a, a + len(feature_list)) + scripts + feature_list + lookup_list


def single_by(delta: int, glyphs: list[int]) -> bytes:
    return struct.pack(">HHh", 1, 6, delta) + _coverage(glyphs)


def single_to(pairs: dict[int, int]) -> bytes:
    glyphs = sorted(pairs)
    return struct.pack(f">HHH{len(glyphs)}H", 2, 6 + 2 * len(glyphs), len(glyphs), *(pairs[g] for g in glyphs)) + _coverage(glyphs)


def several(kind_of: dict[int, list[int]]) -> bytes:
    """A multiple or an alternate substitution: glyph -> glyphs."""
    glyphs = sorted(kind_of)
    sets = [struct.pack(f">H{len(kind_of[g])}H", len(kind_of[g]), *kind_of[g]) for g in glyphs]
    at, offsets = 6 + 2 * len(glyphs), []
    for s in sets:
        offsets.append(at)
        at += len(s)
    return struct.pack(f">HHH{len(glyphs)}H", 1, at, len(glyphs), *offsets) + b"".join(sets) + _coverage(glyphs)


def ligature(parts: list[int], to: int) -> bytes:
    one = struct.pack(f">HH{len(parts) - 1}H", to, len(parts), *parts[1:])
    sets = struct.pack(">HH", 1, 4) + one
    return struct.pack(">HHHH", 1, 8 + len(sets), 1, 8) + sets + _coverage([parts[0]])


def extension(kind: int, sub: bytes) -> bytes:
    return struct.pack(">HHI", 1, kind, 8) + sub


def collection(font: bytes) -> bytes:
    """A font collection whose first and only face is ``font``, its table offsets moved on."""
    head = b"ttcf" + struct.pack(">IIII", 0x00010000, 1, 20, 0)
    n = struct.unpack(">H", font[4:6])[0]
    out = bytearray(font)
    for r in range(12, 12 + 16 * n, 16):
        at = struct.unpack(">I", out[r + 8 : r + 12])[0]
        out[r + 8 : r + 12] = struct.pack(">I", at + len(head))
    return head + bytes(out)


def picture(width: int, height: int, ink: int) -> bytes:
    """A grey map whose first ``ink`` columns are black."""
    return b"P5 %d %d 255\n" % (width, height) + (bytes(ink) + b"\xff" * (width - ink)) * height
