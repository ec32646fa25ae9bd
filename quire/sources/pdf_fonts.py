"""Fonts of a PDF page: what their codes say, and whether to believe it."""

from __future__ import annotations

import re
from functools import cached_property

from quire.functions.bengali import decompose
from quire.functions.bijoy import font_name_hints
from quire.sources.opentype import GlyphText, OpenType
from quire.sources.pdf_file import PdfFile
from quire.sources.pdf_syntax import Keyword, Name, Scanner, Stream, is_number, utf16, whole

WORD_GAP = -1
# Parts of names of Bengali faces that, without Bengali coverage, are addressed by legacy codes.
NAME_PARTS = ("bangla", "bangali", "bengali", "lipi", "purush", "rupali", "nikosh", "sutonny", "tonny", "borno", "kalpurush")
LATIN1_DENSE = 60


def glyph_name_text(name: str) -> str | None:
    """uniXXXX and uXXXX[XX] names."""
    m = re.match("uni([0-9A-Fa-f]{1,4})", name) if len(name) >= 7 else None
    m = m or (re.match("u([0-9A-Fa-f]+)", name) if 5 <= len(name) <= 7 else None)
    return chr(int(m[1], 16) & 0xFFFF) if m else None


def parse_to_unicode(data: bytes) -> tuple[dict[int, str], bool]:
    """Code -> text of a ToUnicode CMap, and whether its codes have two bytes."""
    out: dict[int, str] = {}
    wide, held = False, []
    code = lambda v: int.from_bytes(v, "big") if isinstance(v, bytes) else -1
    text = lambda v: utf16(v) if isinstance(v, bytes) else ""
    for token in Scanner(data):
        if not isinstance(token, Keyword):
            held.append(token)
            if len(held) > 600:  # fixed value: what a map's section may hold before its end; of more, the last count
                del held[:-300]
            continue
        if token == "endcodespacerange":
            wide = wide or any(isinstance(v, bytes) and len(v) >= 2 for v in held)
        elif token == "endbfchar":
            out.update({code(a): text(b) for a, b in zip(held[::2], held[1::2]) if code(a) >= 0})
        elif token == "endbfrange":
            for low, high, to in zip(held[::3], held[1::3], held[2::3]):
                a, b = code(low), code(high)
                if a < 0 or not 0 <= b - a <= 0xFFFF:
                    continue
                if isinstance(to, list):
                    out.update({a + k: text(v) for k, v in enumerate(to[: b - a + 1])})
                elif base := text(to):
                    out.update({a + k: base[:-1] + chr((ord(base[-1]) + k) & 0xFFFF if ord(base[-1]) <= 0xFFFF else ord(base[-1]) + k) for k in range(b - a + 1)})
        if token in ("begincodespacerange", "beginbfchar", "beginbfrange", "endcodespacerange", "endbfchar", "endbfrange"):
            held = []
    return out, wide


class PdfFont:
    def __init__(self, file: PdfFile, info: dict, replay_factory=None):
        get = lambda d, key: file.resolve(d.get(key))
        name = get(info, "BaseFont")
        self.name = str(name) if isinstance(name, Name) else ""
        if len(self.name) > 7 and self.name[6] == "+":
            self.name = self.name[7:]
        self.subtype = str(get(info, "Subtype") or "")
        self.composite = self.subtype == "Type0"
        encoding, inner = get(info, "Encoding"), info
        if self.composite:
            below = get(info, "DescendantFonts")
            first = file.resolve(below[0]) if isinstance(below, list) and below else None
            inner = first if isinstance(first, dict) else info
        self.wide = self.composite and not (isinstance(encoding, Name) and "OneByte" in encoding)
        self.to_unicode: dict[int, str] = {}
        if isinstance(cmap := get(info, "ToUnicode"), Stream) and (data := file.decoded(cmap)) is not None:
            self.to_unicode, wide = parse_to_unicode(data)
            self.wide = self.wide or wide
        self.differences: dict[int, str] = {}
        if isinstance(encoding, dict):
            code = 0
            for item in map(file.resolve, get(encoding, "Differences") or []):
                if is_number(item):
                    code = whole(item)
                elif isinstance(item, Name):
                    self.differences[code] = str(item)
                    code += 1
        self.face: OpenType | None = None
        descriptor = get(inner, "FontDescriptor")
        for key in ("FontFile2", "FontFile3", "FontFile"):
            held = get(descriptor, key) if isinstance(descriptor, dict) else None
            if self.face is None and isinstance(held, Stream) and (data := file.decoded(held)):
                self.face = OpenType.parse(data)
        self.cid_to_gid: dict[int, int] = {}
        if isinstance(table := get(inner, "CIDToGIDMap"), Stream) and (data := file.decoded(table)):
            self.cid_to_gid = {k: g for k in range(len(data) // 2) if (g := int.from_bytes(data[2 * k : 2 * k + 2], "big"))}
        self.replay_factory = replay_factory

    @cached_property
    def is_bijoy(self) -> bool:
        """Whether codes are legacy Bengali codes; the first rule that applies decides."""
        face, name = self.face, self.name.lower()
        if face is not None and (face.covers_bengali or face.declares_bengali):
            return False
        if font_name_hints(self.name):
            return True
        if face is None or not face.cmap:
            return False
        return any(p in name for p in NAME_PARTS) or sum(0xA0 <= c <= 0xFF for c in face.cmap) >= LATIN1_DENSE

    @cached_property
    def contradicts(self) -> bool:
        """Whether the text claimed for Bengali glyphs disagrees with the font's own cmap: three times and one in ten."""
        if self.face is None or not self.to_unicode or self.is_bijoy or not self.composite:
            return False
        own: dict[int, list[int]] = {}
        for cp, gid in self.face.cmap.items():
            if 0x0980 <= cp <= 0x09FF:
                own.setdefault(gid, []).append(cp)
        agree = disagree = 0
        for code, text in self.to_unicode.items():
            if text and (cps := own.get(self.gid(code))):
                claimed = set(decompose(text))
                if any(set(decompose(chr(cp))) <= claimed for cp in cps):
                    agree += 1
                else:
                    disagree += 1
        return disagree >= 3 and disagree * 10 >= agree + disagree

    @property
    def untrusted(self) -> bool:
        return self.composite and (not (self.to_unicode or self.differences) or self.contradicts)

    @cached_property
    def glyph_text(self) -> GlyphText | None:
        if self.face is None or not self.untrusted:
            return None
        claims: dict[int, list[str]] = {}
        for code, text in self.to_unicode.items():
            if text:
                claims.setdefault(self.gid(code), []).append(text)
        replay = self.replay_factory(self.face) if self.replay_factory else None
        table = GlyphText(self.face, claims, replay)
        return table if table.text else None

    def gid(self, code: int) -> int:
        return self.cid_to_gid.get(code, code)

    def codes(self, raw: bytes) -> list[int]:
        """One or two bytes each; an odd last byte stands for itself."""
        if not self.wide:
            return list(raw)
        return [raw[i] << 8 | raw[i + 1] for i in range(0, len(raw) - 1, 2)] + list(raw[len(raw) & ~1 :])

    def shown(self, raw: bytes) -> list[int]:
        """Codes that draw glyphs; an odd last byte draws none, but a lone space is a word gap."""
        if self.wide and len(raw) % 2:
            return self.codes(raw)[:-1] + [WORD_GAP] * (raw[-1] == 0x20)
        return self.codes(raw)

    def width(self, codes: list[int]) -> float:
        return sum(self.face.advance(self.gid(c)) for c in codes if c >= 0) / self.face.upem if self.face else 0.0

    def text_of(self, code: int) -> str | None:
        """None where nothing is known; '' where the document says that there is nothing."""
        if code in self.to_unicode:
            return self.to_unicode[code]
        if self.wide:
            return None
        named = glyph_name_text(self.differences[code]) if code in self.differences else None
        return named if named is not None else chr(code) if 0x20 <= code < 0x100 else None

    def read_back(self, codes: list[int]) -> str | None:
        if self.glyph_text is None:
            return None
        return self.glyph_text.read([self.gid(c) for c in codes], lambda i: self.to_unicode.get(codes[i])) or None

    def read_run(self, codes: list[int]) -> str:
        """Words between gaps; a gap next to a drawn space is that space."""
        out, gap, word = "", False, []
        for code in [*codes, WORD_GAP]:
            if code >= 0:
                word.append(code)
                continue
            if word:
                text = self.read_back(word)
                if text is None:
                    text = "".join(self.text_of(c) or "" for c in word)
                out += " " * bool(gap and out and not out[-1].isspace() and not text[:1].isspace()) + text
                word, gap = [], False
            gap = True
        return out

    @cached_property
    def _by_byte(self) -> dict[int, str]:
        return {c: self.text_of(c) or "" for c in range(256)}

    def decode(self, raw: bytes) -> str:
        if not self.wide and not self.untrusted:
            return raw.decode("latin-1").translate(self._by_byte)
        if self.untrusted and (text := self.read_back(self.codes(raw))) is not None:
            return text
        return "".join(t for c in self.codes(raw) if (t := self.text_of(c)) is not None)


def page_fonts(file: PdfFile, page: dict, cache: dict, replay_factory=None) -> dict[str, PdfFont]:
    resources = file.resolve(page.get("Resources"))
    listed = file.resolve(resources.get("Font")) if isinstance(resources, dict) else None
    out = {}
    for key, value in listed.items() if isinstance(listed, dict) else ():
        info = file.resolve(value)
        if isinstance(info, dict):
            if id(info) not in cache:
                cache[id(info)] = PdfFont(file, info, replay_factory)
            out[str(key)] = cache[id(info)]
    return out
