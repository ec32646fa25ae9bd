"""SQL names: scalar functions, table functions over file contents, and views of the files below a path."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import BinaryType

from quire.functions import bijoy
from quire.functions.fonts import face
from quire.functions.shaping import replay_factory
from quire.operators import measure
from quire.operators.layout import layout_text
from quire.sources import pdf, pdf_writer
from quire.sources.opentype import OpenType
from quire.sources.pdf_content import PageReader
from quire.sources.pdf_file import PdfFile, looks_like_pdf, plain
from quire.sources.pdf_fonts import page_fonts
from quire.sources.pdf_syntax import Keyword, Scanner, Stream


@udtf(returnType="seq int, kind string, value string")
class PdfTokens:
    """The tokens of PDF syntax in a byte string."""

    def eval(self, content: bytes):
        for i, value in enumerate(Scanner(bytes(content or b""))):
            yield i, "operator" if isinstance(value, Keyword) else type(value).__name__, json.dumps(plain(value), ensure_ascii=False)


@udtf(returnType="obj_num int, value string, raw binary")
class PdfObjects:
    """The numbered objects of a PDF file."""

    def eval(self, content: bytes, password: str = ""):
        if content and looks_like_pdf(content):
            file = PdfFile(bytes(content), password or "")
            for n in file.numbers():
                value = file.object(n)
                yield n, json.dumps(plain(value), ensure_ascii=False), file.decoded(value) if isinstance(value, Stream) else None


@udtf(returnType="code_point int, gid int, advance int")
class FontCmap:
    """The characters of a font with their glyphs and widths."""

    def eval(self, content: bytes):
        font = OpenType.parse(bytes(content or b""))
        for cp, gid in sorted(font.cmap.items()) if font else ():
            yield cp, gid, font.advance(gid)


@udtf(returnType="gid int, components array<int>, lookup int")
class FontSubstitutions:
    """The substitution rules of a font, inverted: which glyphs each glyph stands for."""

    def eval(self, content: bytes):
        font = OpenType.parse(bytes(content or b""))
        gsub = font.layout("GSUB") if font else None
        for number, out, parts in gsub.substitutions() if gsub else ():
            yield out, parts, number


@udtf(returnType="name string, units_per_em int, glyphs int, ascender int, descender int, characters int, declares_bengali boolean, covers_bengali boolean, has_outlines boolean")
class FontFacts:
    """What a font says of itself: one row, none for what is no font."""

    def eval(self, content: bytes):
        font = OpenType.parse(bytes(content or b""))
        if font is not None:
            yield font.postscript_name, font.upem, font.glyph_count, font.ascender, font.descender, len(font.cmap), font.declares_bengali, font.covers_bengali, font.has_outlines


@udtf(returnType="line_no int, text string, width double, ends_paragraph boolean")
class WrapLines:
    """A text broken into lines of so many characters."""

    def eval(self, text: str, limit: float):
        for i, (line, width, _, ends) in enumerate(layout_text(text or "", float(limit))):
            yield i, line, width, ends


@udtf(returnType="page_no int, run_seq int, text string, x double, y double, font_size double")
class PdfRuns:
    """The text runs of a PDF file."""

    def eval(self, content: bytes, password: str = ""):
        if content and looks_like_pdf(content):
            file, fonts = PdfFile(bytes(content), password or ""), {}
            for p, page in enumerate(file.pages(), 1):
                for i, r in enumerate(PageReader(page_fonts(file, page, fonts, replay_factory)).read(file.content(page)).runs):
                    yield p, i, r.text.encode("utf-16", "surrogatepass").decode("utf-16", "replace"), r.x, r.y, r.size


@F.pandas_udf(BinaryType())
def _render(text: pd.Series, font: pd.Series, size: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or f is None else pdf_writer.render_pdf(t, [face(bytes(f))], float(s), float(w)) for t, f, s, w in zip(text, font, size, width)])


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    bijoy.register(spark)
    letters, keys = _literal(bijoy.NOT_LETTERS), _literal(bijoy.not_keys())
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION bijoy_confidence(t STRING) RETURNS DOUBLE RETURN
      CASE WHEN length(t) = 0 OR t RLIKE '[ঀ-৿]' THEN 0D WHEN length(regexp_replace(t, {letters}, '')) > 0
      THEN least(1D, length(regexp_replace(t, {keys}, '')) / length(regexp_replace(t, {letters}, ''))) ELSE 0D END""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION looks_like_bijoy_font(name STRING) RETURNS BOOLEAN RETURN
      regexp_replace(lower(name), '[^a-z]', '') RLIKE {_literal("|".join(bijoy.FONT_HINTS))}""")
    spark.udf.register("render_pdf", _render)
    spark.udf.register("ink_overlap", measure.ink_overlap)
    for name, f in (("pdf_runs", PdfRuns), ("pdf_tokens", PdfTokens), ("pdf_objects", PdfObjects), ("font_cmap", FontCmap), ("font_facts", FontFacts), ("font_substitutions", FontSubstitutions), ("wrap_lines", WrapLines)):
        spark.udtf.register(name, f)


def register_files(spark: SparkSession, path: str, prefix: str = "pdf", password: str = "") -> None:
    """Views of the files below ``path``: ``<prefix>_documents``, ``_pages``, ``_fonts``, ``_objects`` and ``_operators``."""
    files = pdf.read_files(spark, path)
    only = pdf.only_pdfs(files)
    views = {"documents": pdf.extract_documents(files, password), "pages": pdf.pages(only, password), "fonts": pdf.fonts(only, password), "objects": pdf.objects(only, password), "operators": pdf.content_ops(only, password)}
    for name, df in views.items():
        df.createOrReplaceTempView(f"{prefix}_{name}")
