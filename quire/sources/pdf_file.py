"""A PDF file as objects, pages and content, read by cross-references and by scanning.

References resolve by object number alone. Where a file is damaged the reader
degrades: a missing object is None, a missing page tree becomes all page
objects, a wrong stream length gives way to ``endstream``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from quire.sources.pdf_crypt import Decryptor
from quire.sources.pdf_filters import decode_stream
from quire.sources.pdf_syntax import END, Keyword, Name, Ref, Scanner, Stream, is_number, whole

_OBJECT = re.compile(rb"(?<![^ \n\r\t>\x00])(\d+)[ \r\n]+(\d+)[ \r\n]*obj")
INHERITED = ("Resources", "MediaBox", "CropBox", "Rotate")
MAX_PAGES = 20_000


def looks_like_pdf(data: bytes) -> bool:
    return len(data) >= 8 and b"%PDF-" in data[:1024]


class PdfFile:
    def __init__(self, data: bytes, password: str = ""):
        self.data = data
        self.offsets: dict[int, int] = {}
        self.packed: dict[int, int] = {}
        self.trailer: dict = {}
        self.cache: dict[int, object] = {}
        self.busy: set[int] = set()
        self.decryptor: Decryptor | None = None
        self.encrypt_number: int | None = None
        try:
            self._follow_xrefs()
        except (ValueError, OverflowError, TypeError):
            pass  # the scan below finds what can be found
        for m in _OBJECT.finditer(data):
            self.offsets[int(m[1])] = m.start()
        if "Root" not in self.trailer:
            root = next((n for n in list(self.offsets) if isinstance(o := self.object(n), dict) and o.get("Type") == "Catalog"), None)
            if root is not None:
                self.trailer["Root"] = Ref(root)
        self._open_lock(password)

    @property
    def is_encrypted(self) -> bool:
        return "Encrypt" in self.trailer

    @property
    def is_locked(self) -> bool:
        return self.is_encrypted and self.decryptor is None

    def _open_lock(self, password: str) -> None:
        entry = self.trailer.get("Encrypt")
        if isinstance(entry, Ref):
            self.encrypt_number = entry.number
        info = self.resolve(entry)
        if isinstance(info, dict):
            ids = self.resolve(self.trailer.get("ID"))
            first = self.resolve(ids[0]) if isinstance(ids, list) and ids else b""
            self.decryptor = Decryptor.open(info, self.resolve, first if isinstance(first, bytes) else b"", password)
            self.cache.clear()

    # --- cross-references ---

    def _follow_xrefs(self) -> None:
        mark = self.data.rfind(b"startxref", max(0, len(self.data) - 2048))
        todo, seen = [whole(Scanner(self.data, mark + 9).next())] if mark >= 0 else [], set()
        while todo:
            at = todo.pop(0)
            if 0 < at < len(self.data) and at not in seen:
                seen.add(at)
                section = self._xref_section(at)
                self.trailer = section | self.trailer
                todo = [whole(section[k]) for k in ("XRefStm", "Prev") if is_number(section.get(k))] + todo

    def _xref_section(self, at: int) -> dict:
        """Enter a section's objects (those entered before are newer) and give its trailer."""
        scan = Scanner(self.data, at)
        head = scan.next()
        if head == "xref" and isinstance(head, Keyword):
            while is_number(first := scan.next()):
                for number in range(whole(first), whole(first) + whole(scan.next())):
                    offset, _, kind = scan.next(), scan.next(), scan.next()
                    if not is_number(offset):
                        return {}
                    if kind == "n":
                        self.offsets.setdefault(number, whole(offset))
            trailer = scan.next() if first == "trailer" else None
            return trailer if isinstance(trailer, dict) else {}
        if is_number(head):
            scan.next()
            table = self._body(scan) if scan.next() == "obj" else None
            if isinstance(table, Stream):
                self._xref_stream(table)
                return table.dict
        return {}

    def _xref_stream(self, table: Stream) -> None:
        widths = [whole(self.resolve(w)) for w in self.resolve(table.dict.get("W")) or []]
        data = decode_stream(table.raw, table.dict, self.resolve)
        if len(widths) < 3 or sum(widths) <= 0 or data is None:
            return
        index = self.resolve(table.dict.get("Index"))
        bounds = index if isinstance(index, list) else [0, whole(self.resolve(table.dict.get("Size")))]
        numbers = (n for a, b in zip(bounds[::2], bounds[1::2]) if is_number(a) and is_number(b) for n in range(whole(a), whole(a) + whole(b)))
        a, b = widths[0], widths[0] + widths[1]
        for number, at in zip(numbers, range(0, len(data) - sum(widths) + 1, sum(widths))):
            row = data[at : at + sum(widths)]
            kind = int.from_bytes(row[:a], "big") if a else 1
            if kind == 1:
                self.offsets.setdefault(number, int.from_bytes(row[a:b], "big"))
            elif kind == 2:
                self.packed.setdefault(number, int.from_bytes(row[a:b], "big"))

    # --- objects ---

    def resolve(self, value):
        return self.object(value.number) if isinstance(value, Ref) else value

    def object(self, number: int):
        """The object of that number; None if there is none, or while it is being read."""
        if number in self.cache:
            return self.cache[number]
        if number in self.busy:
            return None
        self.busy.add(number)
        try:
            value = self._at(number)
            if value is None and number in self.packed:
                value = self._unpacked(number)
        finally:
            self.busy.discard(number)
        self.cache[number] = value
        return value

    def _at(self, number: int):
        at = self.offsets.get(number, -1)
        if not 0 <= at < len(self.data):
            return None
        scan = Scanner(self.data, at)
        if not is_number(found := scan.next()) or whole(found) != number:
            return None
        generation = whole(scan.next())
        if scan.next() != "obj":
            return None
        value = self._body(scan)
        return value if self.decryptor is None or number == self.encrypt_number else self._decrypted(value, number, generation)

    def _decrypted(self, value, number: int, generation: int):
        if isinstance(value, bytes):
            return self.decryptor.string(value, number, generation)
        if isinstance(value, list):
            return [self._decrypted(v, number, generation) for v in value]
        if isinstance(value, dict):
            return {k: self._decrypted(v, number, generation) for k, v in value.items()}
        if isinstance(value, Stream) and value.dict.get("Type") != "XRef":
            return Stream(self._decrypted(value.dict, number, generation), self.decryptor.stream(value.raw, number, generation))
        return value

    def _body(self, scan: Scanner):
        value = scan.next()
        if value is END or isinstance(value, Keyword):
            return None
        if not isinstance(value, dict):
            return value
        after = scan.at
        if scan.next() != "stream":
            scan.at = after
            return value
        start = scan.at + (2 if self.data.startswith(b"\r\n", scan.at) else self.data[scan.at : scan.at + 1] in (b"\r", b"\n"))
        length = self.resolve(value.get("Length"))
        end = start + whole(length) if is_number(length) and 0 <= length <= len(self.data) - start else -1
        mark = self.data.find(b"endstream", start)
        if mark >= 0 and (end < 0 or abs(mark - end) > 2):
            end = mark
            while end > start and self.data[end - 1] in b"\r\n":
                end -= 1
        return Stream(value, self.data[start : max(start, end)])

    def _unpacked(self, number: int):
        box = self.object(self.packed[number])
        data = self.decoded(box) if isinstance(box, Stream) else None
        if data is None:
            return None
        count, first = self.resolve(box.dict.get("N")), self.resolve(box.dict.get("First"))
        if not (is_number(count) and is_number(first)):
            return None
        head = Scanner(data)
        for _ in range(whole(count)):
            found, at = head.next(), head.next()
            if not (is_number(found) and is_number(at)):
                return None
            if whole(found) == number:
                value = Scanner(data, whole(first) + whole(at)).next() if 0 <= whole(first) + whole(at) < len(data) else None
                return None if value is END or isinstance(value, Keyword) else value
        return None

    def decoded(self, stream: Stream) -> bytes | None:
        return decode_stream(stream.raw, stream.dict, self.resolve)

    def numbers(self) -> list[int]:
        return sorted({*self.offsets, *self.packed})

    # --- pages ---

    def pages(self) -> list[dict]:
        """Page dictionaries in order, with inherited attributes; all page objects if the tree is of no use."""
        return [page for _, page in self.numbered_pages()]

    def numbered_pages(self) -> list[tuple[int | None, dict]]:
        """The same with each page's object number; None for one that stands in the tree itself."""
        root = self.resolve(self.trailer.get("Root"))
        tree = self.resolve(root.get("Pages")) if isinstance(root, dict) else None
        out = list(self._leaves(tree)) if isinstance(tree, dict) else []
        return out or [(n, o) for n in sorted(self.offsets) if isinstance(o := self.object(n), dict) and o.get("Type") == "Page"]

    def _leaves(self, tree: dict) -> Iterator[tuple[int | None, dict]]:
        seen, found = set(), 0
        todo: list[tuple[dict, dict, int | None]] = [(tree, {}, None)]
        while todo and found <= MAX_PAGES:
            node, above, number = todo.pop()
            here = above | {k: node[k] for k in INHERITED if k in node}
            kids = self.resolve(node.get("Kids"))
            if isinstance(kids, list):
                below = []
                for kid in kids:
                    if isinstance(kid, Ref):
                        if kid.number in seen:
                            continue
                        seen.add(kid.number)
                    if isinstance(child := self.resolve(kid), dict):
                        below.append((child, here, kid.number if isinstance(kid, Ref) else None))
                todo.extend(reversed(below))
            elif node.get("Type") != "Pages":
                found += 1
                yield number, here | node

    def content(self, page: dict) -> bytes:
        """The page's content streams, each followed by a line break; images and missing ones left out."""
        held = self.resolve(page.get("Contents"))
        parts = (self.resolve(c) for c in (held if isinstance(held, list) else [held]))
        return b"".join(data + b"\n" for p in parts if isinstance(p, Stream) and (data := self.decoded(p)) is not None)


def plain(value) -> object:
    """A value for JSON: names as "/name", strings as Latin-1, references as "n g R", streams as their dictionary."""
    if isinstance(value, Name):
        return f"/{value}"
    if isinstance(value, bytes):
        return value.decode("latin-1")
    if isinstance(value, Ref):
        return f"{value.number} {value.generation} R"
    if isinstance(value, Stream):
        return plain(value.dict)
    if isinstance(value, list):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    return value
