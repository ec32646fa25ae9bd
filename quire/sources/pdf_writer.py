"""Text to PDF files: shaped, wrapped and aligned lines with the fonts cut down to the glyphs drawn.

Each line carries its text as ActualText, and each font a ToUnicode map, so
that any reader gets the typed text back. ``render`` makes one file of one row of
text; ``Drawing`` puts texts on the pages of a file that is there, or of a new
one, and embeds each font once when it is saved.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.functions.shaping import Shaper, best_shaper, clusters
from quire.operators.layout import breakable, justify_shifts, segments, wrap
from quire.sources.opentype import OpenType
from quire.sources.pdf_file import PdfFile
from quire.sources.pdf_syntax import Name, Ref, Stream, is_number

# Tables that a reader of an embedded, already shaped font never uses.
DROPPED = {"GSUB", "GPOS", "GDEF", "hdmx", "VDMX", "LTSH", "gasp", "DSIG", "kern"}
MAX_CID = 0xFFFD
LINE_HEIGHT = 1.2


def components(font: OpenType, gid: int) -> list[int]:
    """Glyphs that a composite glyph draws."""
    loca, b, out = font.loca, font.b, []
    if loca is None or not 0 <= gid < len(loca) - 1 or loca[gid + 1] <= loca[gid]:
        return out
    at = font.at("glyf") + loca[gid]
    if b.i16(at) >= 0:
        return out
    at += 10
    while at + 4 <= len(font.data):
        flags = b.u(at)
        out.append(b.u(at + 2))
        at += 8 if flags & 1 else 6
        at += 2 if flags & 8 else 4 if flags & 0x40 else 8 if flags & 0x80 else 0
        if not flags & 0x20:
            break
    return out


def checksum(data: bytes) -> int:
    data += bytes(-len(data) % 4)
    return sum(struct.unpack(f">{len(data) // 4}I", data)) & 0xFFFFFFFF


def assemble_font(tables: dict[str, bytes]) -> bytes:
    """An sfnt file with checksums."""
    power = 1 << (len(tables).bit_length() - 1)
    out = struct.pack(">IHHHH", 0x00010000, len(tables), power * 16, power.bit_length() - 1, (len(tables) - power) * 16)
    at, body, head_at = 12 + 16 * len(tables), b"", None
    for tag in sorted(tables):
        data = tables[tag]
        if tag == "head" and len(data) >= 12:
            data, head_at = data[:8] + bytes(4) + data[12:], at + len(body)
        out += tag.encode("latin-1") + struct.pack(">III", checksum(data), at + len(body), len(data))
        body += data + bytes(-len(data) % 4)
    out += body
    if head_at is not None:
        out = out[: head_at + 8] + struct.pack(">I", (0xB1B0AFBA - checksum(out)) & 0xFFFFFFFF) + out[head_at + 12 :]
    return out


def subset_font(font: OpenType, used: set[int]) -> bytes | None:
    """The font with only the outlines of ``used`` and what they are composed of, glyph ids kept; None if it can't be cut."""
    loca = font.loca
    if loca is None or not font.glyph_count or font.tables["head"][1] < 54:
        return None
    keep, todo = set(), [0, *(g for g in used if 0 <= g < font.glyph_count)]
    while todo:
        gid = todo.pop()
        if gid not in keep:
            keep.add(gid)
            todo += [c for c in components(font, gid) if c < font.glyph_count]
    base, glyf, starts = font.at("glyf"), bytearray(), [0]
    for gid in range(font.glyph_count):
        if gid in keep and loca[gid + 1] > loca[gid]:
            if base + loca[gid + 1] > len(font.data):
                return None
            glyf += font.data[base + loca[gid] : base + loca[gid + 1]]
            glyf += bytes(-len(glyf) % 4)
        starts.append(len(glyf))
    wide = font.b.i16(font.at("head") + 50) != 0 or len(glyf) > 0x1FFFF
    tables = {t: font.data[o : o + n] for t, (o, n) in font.tables.items() if t not in DROPPED}
    tables["glyf"] = bytes(glyf)
    tables["loca"] = struct.pack(f">{len(starts)}I", *starts) if wide else struct.pack(f">{len(starts)}H", *(s // 2 for s in starts))
    if len(tables.get("post", b"")) > 32:
        tables["post"] = struct.pack(">I", 0x00030000) + tables["post"][4:32]
    tables["head"] = tables["head"][:50] + struct.pack(">h", wide) + tables["head"][52:]
    return assemble_font(tables)


def subset_tag(gids) -> str:
    h = 2166136261
    for g in gids:
        h = (h ^ g) * 16777619 & 0xFFFFFFFF
    return "".join(chr(65 + (h >> 5 * i) % 26) for i in range(6))


def hex_text(text: str) -> str:
    return text.encode("utf-16-be", "surrogatepass").hex().upper()


def number(value: float) -> str:
    """At most six decimals, without trailing zeros."""
    return (f"{value:.6f}".rstrip("0").rstrip(".")).replace("-0", "0", 1) if abs(value) < 5e-7 else f"{value:.6f}".rstrip("0").rstrip(".")


def _rounded(value: float) -> int:
    return math.floor(value + 0.5)


@dataclass
class CidFont:
    """Codes in order of first use, one for each (glyph, text, advance)."""

    font: OpenType
    codes: dict[tuple[int, str, int], int] = field(default_factory=lambda: {(0, "", 0): 0})

    def code(self, gid: int, text: str, advance: int) -> int:
        key = (gid, text, advance)
        if key not in self.codes:
            if len(self.codes) > MAX_CID:
                return 0
            self.codes[key] = len(self.codes)
        return self.codes[key]

    def to_unicode(self) -> bytes:
        rows = [f"<{c:04X}> <{hex_text(text or chr(0xFEFF))}>" for (_, text, _), c in self.codes.items() if c]
        out = ["/CIDInit /ProcSet findresource begin 12 dict begin begincmap", "/CIDSystemInfo << /Registry (Adobe) /Ordering (UCS) /Supplement 0 >> def", "/CMapName /Adobe-Identity-UCS def /CMapType 2 def", "1 begincodespacerange <0000> <FFFF> endcodespacerange"]
        for i in range(0, len(rows), 100):
            part = rows[i : i + 100]
            out += [f"{len(part)} beginbfchar", *part, "endbfchar"]
        return "\n".join([*out, "endcmap CMapName currentdict /CMap defineresource pop end end"]).encode()

    def objects(self, first: int) -> list[bytes]:
        """Font file, widths, glyph map, ToUnicode, descriptor, descendant and the font itself, numbered from ``first``."""
        f, gids = self.font, [g for g, _, _ in self.codes]
        program = subset_font(f, set(gids))
        name = (subset_tag(dict.fromkeys(gids)) + "+" if program is not None else "") + f.postscript_name
        program = f.data if program is None else program
        scaled = lambda v: _rounded(v * 1000 / f.upem)
        widths = " ".join(str(scaled(a)) for _, _, a in self.codes)
        box = " ".join(str(scaled(v)) for v in f.bounding_box)
        return [
            _stream(program, f"/Length1 {len(program)}"),
            f"[{widths}]".encode(),
            _stream(b"".join(struct.pack(">H", g) for g in gids)),
            _stream(self.to_unicode()),
            f"<< /Type /FontDescriptor /FontName /{name} /Flags 4 /FontBBox [{box}] /Ascent {scaled(f.ascender)} /Descent {scaled(f.descender)} /ItalicAngle 0 /CapHeight {scaled(f.ascender)} /StemV 80 /FontFile2 {first} 0 R >>".encode(),
            f"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /{name} /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /FontDescriptor {first + 4} 0 R /DW 1000 /W [0 {first + 1} 0 R] /CIDToGIDMap {first + 2} 0 R >>".encode(),
            f"<< /Type /Font /Subtype /Type0 /BaseFont /{name} /Encoding /Identity-H /DescendantFonts [{first + 5} 0 R] /ToUnicode {first + 3} 0 R >>".encode(),
        ]


def _stream(data: bytes, extra: str = "") -> bytes:
    packed = zlib.compress(data)
    return b"<< /Length %d /Filter /FlateDecode %s >>\nstream\n%s\nendstream" % (len(packed), extra.encode(), packed)


@dataclass
class Placed:
    font: int
    gid: int
    x: float
    y_offset: float
    advance: int
    text: str


@dataclass
class Line:
    glyphs: list[Placed]
    text: str
    width: float
    visual_width: float
    ends_paragraph: bool


def layout(text: str, fonts: list[OpenType], size: float, limit: float, shaper: Shaper | None = None, letter_spacing: float = 0.0) -> list[Line]:
    """Lines of placed glyphs: stretches of one font and script are shaped, measured, wrapped and set."""
    shaper = shaper or best_shaper()
    lines = []
    for paragraph in text.split("\n"):
        units = []
        for font, script, part in segments(paragraph, [lambda cp, f=f: cp in f.cmap for f in fonts]):
            glyphs, scale = shaper(fonts[font], part, script), size / fonts[font].upem
            for c in clusters(glyphs, part):
                own = glyphs[c.start : c.end]
                units.append((c.text, sum(g.x_advance for g in own) * scale + letter_spacing, font, own, c.glyph_texts))
        if not units:
            lines.append(Line([], paragraph, 0.0, 0.0, True))
        for a, b in wrap([(u[0], u[1]) for u in units], limit) if units else ():
            seen = b
            while seen > a and breakable(units[seen - 1][0]):
                seen -= 1
            pen = visual = 0.0
            placed = []
            for k in range(a, b):
                _, _, font, own, parts = units[k]
                scale = size / fonts[font].upem
                for g, part in zip(own, parts):
                    placed.append(Placed(font, g.gid, pen + g.x_offset * scale, g.y_offset * scale, g.x_advance, part))
                    pen += g.x_advance * scale
                pen += letter_spacing
                visual = pen if k < seen else visual
            lines.append(Line(placed, "".join(u[0] for u in units[a:b]), pen, visual, b == len(units)))
    return lines


def paint_line(line: Line, pens: list[tuple[str, CidFont]], size: float, x: float, y: float, shifts: list[float] | None, actual_text: bool = True) -> str:
    """The operators of a line: its text as ActualText, spacing glyphs by font, then marks one by one. ``pens``: resource name and codes of each font."""
    cids = [c for _, c in pens]
    shifted = [(g, x + g.x + (shifts[i] if shifts else 0.0)) for i, g in enumerate(line.glyphs)]
    mark = lambda g: g.advance == 0 and (g.x != 0 or g.y_offset != 0)
    spanned = actual_text and bool(line.text)
    out = [f"/Span << /ActualText <FEFF{hex_text(line.text)}> >> BDC"] if spanned else []
    shows: list[tuple[int, float, float, list[str]]] = []
    pen = 0.0
    for g, at in (p for p in shifted if not mark(p[0])):
        if not shows or shows[-1][0] != g.font:
            shows.append((g.font, at, y, []))
            pen = at
        kern = _rounded((pen - at) * 1000 / size)
        shows[-1][3].append(f"{kern} " * (kern != 0) + f"<{cids[g.font].code(g.gid, g.text, g.advance):04X}>")
        pen = at + g.advance * size / cids[g.font].font.upem
    shows += [(g.font, at, y + g.y_offset, [f"<{cids[g.font].code(g.gid, g.text, g.advance):04X}>"]) for g, at in shifted if mark(g)]
    out += [f"BT /{pens[font][0]} {number(size)} Tf 1 0 0 1 {number(at)} {number(up)} Tm [{''.join(codes)}] TJ ET" for font, at, up, codes in shows]
    return "\n".join([*out, "EMC"] if spanned else out)


def paint_block(lines: list[Line], pens: list[tuple[str, CidFont]], size: float, x: float, y: float, height: float, available: float, align: str, color: tuple[float, float, float] | None, alpha: str | None, actual_text: bool = True) -> bytes:
    """The operators of lines one below the other, the first on the base line ``y``."""
    out = ["q"] + ([f"{' '.join(map(number, color))} rg"] if color else []) + ([f"/{alpha} gs"] if alpha else [])
    for k, line in enumerate(lines):
        if line.glyphs:
            offset = (available - line.visual_width) * {"center": 0.5, "right": 1.0}.get(align, 0.0)
            shifts = justify_shifts([g.text for g in line.glyphs], line.visual_width, available, line.ends_paragraph) if align == "justify" else None
            out.append(paint_line(line, pens, size, x + offset, y - k * height, shifts, actual_text))
    return "\n".join([*out, "Q"]).encode()


@dataclass
class Drawn:
    """What was measured and drawn; ``last_baseline`` in points from the page's foot."""

    lines: list[Line]
    width: float
    height: float
    line_height: float
    last_baseline: float


def measure(text: str, fonts: list[OpenType], size: float = 12.0, max_width: float | None = None, line_height: float | None = None, letter_spacing: float = 0.0, shaper: Shaper | None = None, y: float = 0.0) -> Drawn:
    """A text's lines and extent, as ``Drawing.draw`` would draw them."""
    lines = layout(text, fonts, size, math.inf if max_width is None else max_width, shaper, letter_spacing)
    height = line_height or (fonts[0].ascender - fonts[0].descender) / fonts[0].upem * size * LINE_HEIGHT
    return Drawn(lines, max((ln.visual_width for ln in lines), default=0.0), len(lines) * height, height, y - max(0, len(lines) - 1) * height)


def written(value) -> bytes:
    """A PDF value in the file's syntax."""
    if isinstance(value, Name):
        return b"/" + re.sub(rb"[^!-~]|[#%()/<>\[\]{}]", lambda m: b"#%02X" % m[0][0], value.encode("latin-1", "replace"))
    if isinstance(value, bool) or value is None:
        return {True: b"true", False: b"false", None: b"null"}[value]
    if isinstance(value, bytes):
        return b"<" + value.hex().encode() + b">"
    if isinstance(value, Ref):
        return b"%d %d R" % (value.number, value.generation)
    if isinstance(value, Stream):
        return written({**value.dict, "Length": len(value.raw)}) + b"\nstream\n" + value.raw + b"\nendstream"
    if isinstance(value, list):
        return b"[" + b" ".join(map(written, value)) + b"]"
    if isinstance(value, dict):
        return b"<< " + b" ".join(written(Name(k)) + b" " + written(v) for k, v in value.items()) + b" >>"
    return number(value).encode() if is_number(value) else str(value).encode("latin-1", "replace")


class Drawing:
    """Draws texts on the pages of a file, or of a new one; ``save`` gives the file with each font embedded once."""

    def __init__(self, data: bytes | None = None):
        file = PdfFile(data) if data else None
        if file is not None and file.is_encrypted:
            raise ValueError("an encrypted file can't be drawn on")
        self.objects: dict[int, object] = {}
        self.pages: list[int] = []
        if file is not None:
            kept = ((n, file.object(n)) for n in file.numbers())
            self.objects = {n: o for n, o in kept if not (isinstance(o, Stream) and o.dict.get("Type") in ("ObjStm", "XRef"))}
            root = file.trailer.get("Root")
            self.root = root if isinstance(root, Ref) else self._add(root if isinstance(root, dict) else {"Type": Name("Catalog")})
            # what is drawn on gets its own resources, as inherited ones may be shared
            for n, page in file.numbered_pages():
                page = {k: v for k, v in page.items() if k != "Resources"} | {"Resources": file.resolve(page.get("Resources")) or {}}
                page["Resources"] = {k: file.resolve(v) if k in ("Font", "ExtGState") else v for k, v in page["Resources"].items()}
                n = self._add(page).number if n is None else n
                self.objects[n] = page
                self.pages.append(n)
        else:
            self.root = self._add({"Type": Name("Catalog"), "Pages": Ref(2)})
            self._add({"Type": Name("Pages"), "Kids": [], "Count": 0})
        self.pens: dict[int, tuple[str, CidFont]] = {}
        self.painted: dict[int, list[bytes]] = {}
        self.alphas: dict[float, str] = {}

    def _add(self, value) -> Ref:
        number = max(self.objects, default=0) + 1
        self.objects[number] = value
        return Ref(number)

    def add_page(self, width: float = 612.0, height: float = 792.0) -> int:
        """A new last page; gives its number, from 1."""
        tree = self.objects[self.root.number].get("Pages")
        page = {"Type": Name("Page"), "Parent": tree, "MediaBox": [0, 0, width, height], "Resources": {}}
        ref = self._add(page)
        node = self.objects[tree.number]
        node["Kids"] = [*node.get("Kids", []), ref]
        node["Count"] = node.get("Count", 0) + 1
        self.pages.append(ref.number)
        return len(self.pages)

    def draw(self, page: int, text: str, fonts: list[OpenType], x: float = 0.0, y: float = 0.0, size: float = 12.0, max_width: float | None = None, align: str = "left", line_height: float | None = None, letter_spacing: float = 0.0, color: tuple[float, float, float] | None = None, opacity: float = 1.0, shaper: Shaper | None = None) -> Drawn:
        """Draw ``text`` on page ``page`` (from 1), the first base line at (x, y). Without ``max_width`` lines are not broken and align in the widest."""
        out = measure(text, fonts, size, max_width, line_height, letter_spacing, shaper, y)
        for f in fonts:
            self.pens.setdefault(id(f), (f"Quire{len(self.pens)}", CidFont(f)))
        pens = [self.pens[id(f)] for f in fonts]
        alpha = self.alphas.setdefault(opacity, f"QuireA{len(self.alphas)}") if opacity < 1 else None
        available = out.width if max_width is None else max_width
        self.painted.setdefault(self.pages[page - 1], []).append(paint_block(out.lines, pens, size, x, y, out.line_height, available, align, color, alpha))
        return out

    def save(self) -> bytes:
        objects = dict(self.objects)
        at, names = max(objects, default=0), {}
        for name, cid in self.pens.values():
            for body in cid.objects(at + 1):
                at += 1
                objects[at] = body
            names[name] = Ref(at)
        alphas = {name: {"ca": opacity} for opacity, name in self.alphas.items()}
        for n, drawn in self.painted.items():
            page, resources = dict(objects[n]), dict(objects[n]["Resources"])
            resources["Font"] = dict(resources.get("Font") or {}) | names
            if alphas:
                resources["ExtGState"] = dict(resources.get("ExtGState") or {}) | alphas
            before = page.get("Contents")
            held = objects.get(before.number) if isinstance(before, Ref) else before
            before = held if isinstance(held, list) else [] if before is None else [before]
            # what is there is closed off, so that its state does not reach what is drawn
            at += 2
            objects[at - 1], objects[at] = _stream(b"q"), _stream(b"Q\n" + b"\n".join(drawn))
            objects[n] = page | {"Resources": resources, "Contents": [Ref(at - 1), *before, Ref(at)]}
        return _file({n: o if isinstance(o, bytes) and n not in self.objects else written(o) for n, o in objects.items()}, self.root.number)


def render_pdf(text: str, fonts: list[OpenType], size: float = 12.0, width: float = 468.0, align: str = "left", margin: float = 72.0, page: tuple[float, float] = (612.0, 792.0), shaper: Shaper | None = None, color: tuple[float, float, float] | None = None, opacity: float = 1.0, line_height: float | None = None, letter_spacing: float = 0.0, actual_text: bool = True) -> bytes:
    """A PDF file of ``text``, broken over pages; the first font is drawn with, the others where it has no glyph.

    Without ``actual_text`` readers have the fonts' character maps alone.
    """
    cids = [CidFont(f) for f in fonts]
    height = line_height or (fonts[0].ascender - fonts[0].descender) / fonts[0].upem * size * LINE_HEIGHT
    per_page = max(1, int((page[1] - 2 * margin) / height))
    lines = layout(text, fonts, size, width, shaper, letter_spacing)
    pens = [(f"F{i}", c) for i, c in enumerate(cids)]
    top = page[1] - margin - fonts[0].ascender / fonts[0].upem * size
    contents = [paint_block(lines[at : at + per_page], pens, size, margin, top, height, width, align, color, "A0" if opacity < 1 else None, actual_text) for at in range(0, len(lines), per_page)]
    bodies: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b""]
    names = []
    for i, c in enumerate(cids):
        bodies += c.objects(len(bodies) + 1)
        names.append(f"/F{i} {len(bodies)} 0 R")
    kids = []
    for content in contents:
        bodies.append(_stream(content))
        bodies.append(f"<< /Type /Page /Parent 2 0 R /Contents {len(bodies)} 0 R >>".encode())
        kids.append(f"{len(bodies)} 0 R")
    alpha = f"/ExtGState << /A0 << /ca {number(opacity)} >> >>" if opacity < 1 else ""
    bodies[1] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} /MediaBox [0 0 {number(page[0])} {number(page[1])}] /Resources << /Font << {' '.join(names)} >> {alpha} >> >>".encode()
    return _file(bodies)


def render(df: DataFrame, font_files: list[bytes], id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``<id>, content``: a PDF file per row; null texts give null. The fonts travel as one broadcast."""
    held = df.sparkSession.sparkContext.broadcast(font_files)
    rows = df.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fonts = [OpenType.parse(f) for f in held.value]
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if t is None else render_pdf(t, fonts, **options) for t in part.column(1).to_pylist()], pa.binary())], [id_col, "content"])

    return rows.mapInArrow(run, f"{id_col} {dict(rows.dtypes)[id_col]}, content binary")


def draw(df: DataFrame, font_files: list[bytes], id_col: str = "doc_id", content_col: str = "content", text_col: str = "text", page: int = 1, **options) -> DataFrame:
    """``<id>, content, width, height, last_baseline, error``: each row's text drawn on page ``page`` of its file.

    A row without file or text, and one whose file can't be drawn on, keeps its content and says why in ``error``.
    """
    held = df.sparkSession.sparkContext.broadcast(font_files)
    rows = df.select(id_col, content_col, text_col)
    types = pa.schema([("content", pa.binary()), ("width", pa.float64()), ("height", pa.float64()), ("last_baseline", pa.float64()), ("error", pa.string())])

    def one(fonts: list[OpenType], content: bytes | None, text: str | None) -> tuple:
        if content is None or text is None:
            return content, None, None, None, "no file" if content is None else "no text"
        try:
            drawing = Drawing(content)
            if not 1 <= page <= len(drawing.pages):
                return content, None, None, None, f"no page {page}"
            done = drawing.draw(page, text, fonts, **options)
            return drawing.save(), done.width, done.height, done.last_baseline, None
        except Exception as e:  # a damaged file must not fail its task
            return content, None, None, None, f"{type(e).__name__}: {e}"[:500]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fonts = [OpenType.parse(f) for f in held.value]
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                part = batch.slice(at, 50)
                done = [one(fonts, c, t) for c, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), f.type) for c, f in zip(zip(*done), types))], [id_col, *types.names])

    return rows.mapInArrow(run, f"{id_col} {dict(rows.dtypes)[id_col]}, content binary, width double, height double, last_baseline double, error string")


def plain_pdf(text: str, lines_per_page: int = 60) -> bytes:
    """A PDF file in a standard font, one show per line; characters beyond Latin-1 become '?'."""
    lines = text.split("\n")
    bodies = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    kids = []
    for start in range(0, len(lines), lines_per_page):
        shows = []
        for line in lines[start : start + lines_per_page]:
            raw = line.encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r")
            shows.append(b"(" + raw + b") Tj T*" if raw else b"T*")
        bodies.append(_stream(b"BT /F1 12 Tf 14 TL 36 780 Td\n" + b"\n".join(shows) + b"\nET"))
        bodies.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % len(bodies))
        kids.append(b"%d 0 R" % len(bodies))
    bodies[1] = b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> >>" % (b" ".join(kids), len(kids))
    return _file(bodies)


def _file(bodies: list[bytes] | dict[int, bytes], root: int = 1) -> bytes:
    """A file of numbered objects (a list: from 1 on) with its table of where they start."""
    bodies = bodies if isinstance(bodies, dict) else dict(enumerate(bodies, 1))
    out, starts = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"), {}
    for n, body in sorted(bodies.items()):
        starts[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    size, at = max(bodies, default=0) + 1, len(out)
    table = b"".join(b"%010d 00000 n \n" % starts[n] if n in starts else b"0000000000 65535 f \n" for n in range(1, size))
    return bytes(out) + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (size, table, size, root, at)


def render_plain(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, content``: ``plain_pdf`` of each row's text."""
    rows = df.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if t is None else plain_pdf(t) for t in part.column(1).to_pylist()], pa.binary())], [id_col, "content"])

    return rows.mapInArrow(run, f"{id_col} {dict(rows.dtypes)[id_col]}, content binary")
