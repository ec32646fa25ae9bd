"""Shaping: text to positioned glyphs, and which text each glyph stands for.

A shaper is a callable ``(font, text) -> [Glyph]``. ``simple_shaper`` maps each
character to its glyph; ``harfbuzz_shaper`` loads the system's HarfBuzz once
per worker if there is one. Clusters and glyph texts do not depend on which.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import re
import unicodedata
from collections import OrderedDict
from collections.abc import Callable
from functools import lru_cache, partial
from itertools import groupby
from typing import NamedTuple

from quire.sources.opentype import OpenType


class Glyph(NamedTuple):
    gid: int
    cluster: int  # first character of the cluster
    source: int  # the character that this glyph comes from
    x_advance: int
    x_offset: int = 0
    y_offset: int = 0


class Cluster(NamedTuple):
    start: int
    end: int
    text: str
    glyph_texts: list[str]


#: Called with a font, a text and, if known, the text's script (an ISO 15924 tag).
Shaper = Callable[..., list[Glyph]]


def simple_shaper(font: OpenType, text: str, script: str | None = None) -> list[Glyph]:
    """One glyph a character; combining marks join the cluster before them. The script changes nothing."""
    out: list[Glyph] = []
    for i, c in enumerate(text):
        gid = font.cmap.get(ord(c), 0)
        joins = out and unicodedata.category(c).startswith("M")
        out.append(Glyph(gid, out[-1].cluster if joins else i, i, font.advance(gid)))
    return out


def clusters(glyphs: list[Glyph], text: str) -> list[Cluster]:
    """Runs of equal cluster numbers with the text between them; one cluster for all where the numbers don't rise."""
    runs, at = [], 0
    for first, members in groupby(glyphs, key=lambda g: g.cluster):
        n = len(list(members))
        runs.append((first, at, at + n))
        at += n
    if any(b[0] <= a[0] for a, b in zip(runs, runs[1:])):
        runs = [(0, 0, len(glyphs))]
    ends = [r[0] for r in runs[1:]] + [len(text)]
    return [Cluster(a, b, text[first:end], glyph_texts(glyphs[a:b], first, end, text)) for (first, a, b), end in zip(runs, ends)]


_FORMAT_END = re.compile("[­؀-؅؜۝܏᠎​-‏‪-‮⁠-⁤⁦-⁯﻿]+$")


def glyph_texts(glyphs: list[Glyph], first: int, end: int, text: str) -> list[str]:
    """The part of a cluster's text on each glyph.

    Where the glyphs come from rising characters each has its own; a mark
    without advance gives its part to the spacing glyph before it, and
    invisible characters at the end of a part move to the next glyph. Else the
    first spacing glyph has all.
    """
    sources = [g.source for g in glyphs]
    spacing = [g.x_advance != 0 for g in glyphs]
    if len(glyphs) == 1:
        return [text[first:end]]
    if sources[0] != first or any(b <= a for a, b in zip(sources, sources[1:])):
        carrier = spacing.index(True) if True in spacing else 0
        return [text[first:end] if i == carrier else "" for i in range(len(glyphs))]
    out = [text[a:b] for a, b in zip(sources, [*sources[1:], end])]
    holder = None
    for i, wide in enumerate(spacing):
        if wide:
            holder = i
        elif holder is not None:
            out[holder], out[i] = out[holder] + out[i], ""
    for i in range(len(out) - 1):
        if m := _FORMAT_END.search(out[i]):
            out[i], out[i + 1] = out[i][: m.start()], m[0] + out[i + 1]
    return out


class _Info(ctypes.Structure):
    _fields_ = [("codepoint", ctypes.c_uint32), ("mask", ctypes.c_uint32), ("cluster", ctypes.c_uint32), ("v1", ctypes.c_uint32), ("v2", ctypes.c_uint32)]


class _Position(ctypes.Structure):
    _fields_ = [(n, ctypes.c_int32) for n in ("x_advance", "y_advance", "x_offset", "y_offset", "v")]


@lru_cache(maxsize=1)
def _harfbuzz():
    name = ctypes.util.find_library("harfbuzz")
    if name is None:
        return None
    lib = ctypes.CDLL(name)
    pointer = ctypes.c_void_p
    for f, result, args in (
        ("hb_blob_create", pointer, [ctypes.c_char_p, ctypes.c_uint, ctypes.c_int, pointer, pointer]),
        ("hb_face_create", pointer, [pointer, ctypes.c_uint]),
        ("hb_font_create", pointer, [pointer]),
        ("hb_font_set_scale", None, [pointer, ctypes.c_int, ctypes.c_int]),
        ("hb_buffer_create", pointer, []),
        ("hb_buffer_add_utf32", None, [pointer, pointer, ctypes.c_int, ctypes.c_uint, ctypes.c_int]),
        ("hb_buffer_set_cluster_level", None, [pointer, ctypes.c_int]),
        ("hb_buffer_set_direction", None, [pointer, ctypes.c_int]),
        ("hb_buffer_guess_segment_properties", None, [pointer]),
        ("hb_shape", None, [pointer, pointer, pointer, ctypes.c_uint]),
        ("hb_buffer_get_glyph_infos", ctypes.POINTER(_Info), [pointer, ctypes.POINTER(ctypes.c_uint)]),
        ("hb_buffer_get_glyph_positions", ctypes.POINTER(_Position), [pointer, ctypes.POINTER(ctypes.c_uint)]),
        ("hb_buffer_destroy", None, [pointer]),
        ("hb_buffer_set_script", None, [pointer, ctypes.c_uint32]),
        ("hb_script_from_string", ctypes.c_uint32, [ctypes.c_char_p, ctypes.c_int]),
        ("hb_buffer_set_language", None, [pointer, pointer]),
        ("hb_language_from_string", pointer, [ctypes.c_char_p, ctypes.c_int]),
        ("hb_font_destroy", None, [pointer]),
        ("hb_face_destroy", None, [pointer]),
        ("hb_blob_destroy", None, [pointer]),
    ):
        getattr(lib, f).restype, getattr(lib, f).argtypes = result, args
    return lib


def harfbuzz_available() -> bool:
    return _harfbuzz() is not None


class _Fonts:
    """The library's fonts of the font files used last; those that others push out are freed."""

    def __init__(self, most: int = 16):
        self.most, self.held = most, OrderedDict()

    def get(self, font: OpenType) -> int:
        key = (font.data, font.upem)
        if key not in self.held:
            lib = _harfbuzz()
            blob = lib.hb_blob_create(font.data, len(font.data), 0, None, None)  # copies the bytes
            face = lib.hb_face_create(blob, 0)
            made = lib.hb_font_create(face)
            lib.hb_font_set_scale(made, font.upem, font.upem)
            lib.hb_face_destroy(face)  # the font holds them on
            lib.hb_blob_destroy(blob)
            self.held[key] = made
            while len(self.held) > self.most:
                lib.hb_font_destroy(self.held.popitem(last=False)[1])
        self.held.move_to_end(key)
        return self.held[key]


_FONTS = _Fonts()
#: Scripts that a shaper is told of; the library guesses others from the text.
_TOLD = ("Beng", "Latn")


def _pass(font: OpenType, text: str, level: int, script: str | None = None, language: str | None = None) -> list[tuple]:
    lib, n = _harfbuzz(), ctypes.c_uint()
    buffer = lib.hb_buffer_create()
    raw = text.encode("utf-32-le", "surrogatepass")
    lib.hb_buffer_add_utf32(buffer, raw, len(text), 0, len(text))
    lib.hb_buffer_set_cluster_level(buffer, level)
    lib.hb_buffer_set_direction(buffer, 4)
    if script in _TOLD:
        lib.hb_buffer_set_script(buffer, lib.hb_script_from_string(script.encode(), -1))
    if language:
        lib.hb_buffer_set_language(buffer, lib.hb_language_from_string(language.encode(), -1))
    lib.hb_buffer_guess_segment_properties(buffer)  # what is not set
    lib.hb_shape(_FONTS.get(font), buffer, None, 0)
    infos = lib.hb_buffer_get_glyph_infos(buffer, ctypes.byref(n))
    places = lib.hb_buffer_get_glyph_positions(buffer, ctypes.byref(n))
    out = [(infos[i].codepoint, infos[i].cluster, places[i].x_advance, places[i].x_offset, places[i].y_offset) for i in range(n.value)]
    lib.hb_buffer_destroy(buffer)
    return out


def harfbuzz_shaper(font: OpenType, text: str, script: str | None = None, language: str | None = None) -> list[Glyph]:
    """Two passes: merged clusters for breaking lines, single characters for the glyphs' sources."""
    merged, single = (_pass(font, text, level, script, language) for level in (0, 2))
    sources = [s[1] for s in single] if len(single) == len(merged) else [m[1] for m in merged]
    return [Glyph(g, c, s, a, x, y) for (g, c, a, x, y), s in zip(merged, sources)]


def best_shaper(language: str | None = None) -> Shaper:
    """HarfBuzz where the system has it, for a language if one is given."""
    return partial(harfbuzz_shaper, language=language) if harfbuzz_available() else simple_shaper


def replay_factory(font: OpenType):
    """For reading glyphs back: text -> glyph ids, or None without a shaper."""
    return (lambda text: [g[0] for g in _pass(font, text, 0)]) if harfbuzz_available() else None
