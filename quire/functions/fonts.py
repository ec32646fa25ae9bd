"""Font files as measures: where they come from, and shapers that ``layout`` breaks lines with."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import SparkSession

from quire.functions.shaping import best_shaper, clusters
from quire.operators.layout import segments
from quire.sources.opentype import OpenType

#: The session's setting that names the font file to use where none is given.
DEFAULT_FONT = "spark.quire.defaultFont"


def load_font(spark: SparkSession, path: str | None = None) -> bytes:
    """The bytes of a font file that Spark can read; without ``path``, of the one that ``DEFAULT_FONT`` names."""
    path = path or spark.conf.get(DEFAULT_FONT, None)
    if not path:
        raise ValueError(f"no font: give a path, or set {DEFAULT_FONT}")
    held = spark.read.format("binaryFile").load(path).select("content").first()
    if held is None or OpenType.parse(bytes(held[0])) is None:
        raise ValueError(f"no font file at {path}")
    return bytes(held[0])


@lru_cache(maxsize=16)
def face(data: bytes) -> OpenType:
    """A parsed font; one per worker and file."""
    font = OpenType.parse(data)
    if font is None:
        raise ValueError("not a font file")
    return font


@dataclass(frozen=True)
class FontShaper:
    """A paragraph's clusters with their widths in points; the first font draws what it has glyphs for, the others what it lacks."""

    fonts: tuple[bytes, ...]
    size: float = 12.0
    letter_spacing: float = 0.0
    language: str | None = None

    def __call__(self, paragraph: str) -> list[tuple[str, float]]:
        faces, shape, out = [face(f) for f in self.fonts], best_shaper(self.language), []
        for k, script, part in segments(paragraph, [lambda cp, f=f: cp in f.cmap for f in faces]):
            glyphs, scale = shape(faces[k], part, script), self.size / faces[k].upem
            out += [(c.text, sum(g.x_advance for g in glyphs[c.start : c.end]) * scale + self.letter_spacing) for c in clusters(glyphs, part)]
        return out
