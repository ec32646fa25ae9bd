"""PDF syntax: one regular expression splits bytes into lexemes, a stack builds values.

Values are Python's own: None, bool, float or int, bytes (a string), list,
dict; plus Name, Keyword, Ref and Stream. Nothing here raises on bad input:
open containers close at the end of the data, stray closers are keywords.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


class Name(str):
    __slots__ = ()


class Keyword(str):
    __slots__ = ()


@dataclass(frozen=True)
class Ref:
    number: int
    generation: int = 0


@dataclass
class Stream:
    dict: dict
    raw: bytes


END = object()
_REGULAR = rb"[^\x00\t\n\f\r ()<>\[\]{}/%]"
_LEXEME = re.compile(
    rb"(?P<space>[\x00\t\n\f\r ]+|%[^\r\n]*)"
    rb"|(?P<ref>(\d+)[\x00\t\n\f\r ]+(\d+)[\x00\t\n\f\r ]+R(?!" + _REGULAR + rb"))"
    rb"|(?P<name>/(" + _REGULAR + rb"*))"
    rb"|(?P<open><<|\[)|(?P<close>>>|\])"
    rb"|(?P<hex><([^>]*)>?)"
    rb"|(?P<string>\()"
    rb"|(?P<word>" + _REGULAR + rb"+)"
    rb"|(?P<stray>[)>{}])"
)
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_ESCAPED_NAME = re.compile(rb"#([0-9A-Fa-f]{2})")
_IN_STRING = re.compile(rb"[()\\]")
_ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|(\r\n|\r|\n)|(.)|$)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_CONSTANTS = {b"true": True, b"false": False, b"null": None}


def unescape(raw: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        if m[1]:
            return bytes([int(m[1], 8) & 0xFF])
        return b"" if m[2] or not m[3] else _ESCAPES.get(m[3], m[3])

    return _ESCAPE.sub(one, raw) if b"\\" in raw else raw


def unhex(raw: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def latin1(raw: bytes) -> str:
    return raw.decode("latin-1")


def utf16(raw: bytes) -> str:
    """A text string: UTF-16BE less its byte order mark; a single byte stands for itself."""
    if len(raw) < 2:
        return latin1(raw)
    return raw[: len(raw) // 2 * 2].decode("utf-16-be", "surrogatepass").removeprefix(chr(0xFEFF))


class Scanner:
    """Reads values one after another; ``at`` is the offset of the next byte."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip_space(self) -> None:
        while (m := _LEXEME.match(self.data, self.at)) and m.lastgroup == "space":
            self.at = m.end()

    def _literal(self) -> bytes:
        start, depth = self.at, 1
        while m := _IN_STRING.search(self.data, self.at):
            self.at = m.end()
            if m[0] == b"\\":
                self.at += 1
            elif m[0] == b"(":
                depth += 1
            else:
                depth -= 1
                if not depth:
                    return unescape(self.data[start : m.start()])
        self.at = len(self.data)
        return unescape(self.data[start:])

    def next(self):
        """The next value or keyword, or END."""
        open_: list[tuple[list | dict, list]] = []  # containers with a waiting key
        while True:
            m = _LEXEME.match(self.data, self.at)
            if m is None:
                if not open_:
                    return END
                value = self._close(open_)
            else:
                self.at = m.end()
                kind = m.lastgroup
                if kind == "space":
                    continue
                if kind == "open":
                    open_.append(({}, []) if m[0] == b"<<" else ([], []))
                    continue
                if kind == "close":
                    if not open_:
                        return Keyword(latin1(m[0]))
                    value = self._close(open_)
                else:
                    value = self._value(kind, m)
            if not open_:
                return value
            box, key = open_[-1]
            if isinstance(box, list):
                box.append(value)
            elif key:
                box[key.pop()] = value
            elif isinstance(value, Name):
                key.append(value)  # anything else where a key must be is passed over

    @staticmethod
    def _close(open_):
        return open_.pop()[0]

    def _value(self, kind: str, m: re.Match):
        if kind == "ref":
            number, generation = m["ref"].split()[:2]
            return Ref(int(number), int(generation))
        if kind == "name":
            raw = m["name"][1:]
            return Name(latin1(_ESCAPED_NAME.sub(lambda h: bytes([int(h[1], 16)]), raw) if b"#" in raw else raw))
        if kind == "hex":
            return unhex(m["hex"][1:])
        if kind == "string":
            return self._literal()
        raw = m[0]
        if raw in _CONSTANTS:
            return _CONSTANTS[raw]
        if _NUMBER.fullmatch(raw):
            return float(raw) if b"." in raw else int(raw)
        return Keyword(latin1(raw))

    def __iter__(self):
        while (value := self.next()) is not END:
            yield value


def is_number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def whole(value, otherwise: int = 0) -> int:
    return int(value) if is_number(value) else otherwise
