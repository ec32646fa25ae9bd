import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.functions import shaping
from quire.functions.shaping import Glyph, clusters
from quire.operators.layout import breakable
from quire.sources import pdf, pdf_writer
from quire.sources.opentype import GlyphText, OpenType
from quire.sources.pdf_content import PageReader
from quire.sources.pdf_file import PdfFile
from quire.sources.pdf_fonts import page_fonts
from tests import pdf_maker as make

LETTERS = "abcdefghij klmnopকতর"


def outline(n):
    return struct.pack(">hhhhh", 1, 0, 0, 100, n) + bytes(2 * n)


def face(post=b"\0\2\0\0" + bytes(60)):
    glyphs = [outline(3 + i % 5) for i in range(30)] + [struct.pack(">hhhhh", -1, 0, 0, 9, 9) + struct.pack(">HHbb", 0x22, 5, 0, 0) + struct.pack(">HHhh", 0x09, 6, 0, 0) + bytes(2)]
    glyphs = [g + bytes(len(g) % 2) for g in glyphs]
    starts = [0]
    for g in glyphs:
        starts.append(starts[-1] + len(g))
    tables = make.simple_tables(len(glyphs))
    name = "Test Face".encode("utf-16-be")
    tables |= {"cmap": make.cmap12({ord(c): i + 1 for i, c in enumerate(LETTERS)} | {0x2192: 30}), "glyf": b"".join(glyphs), "loca": struct.pack(f">{len(starts)}H", *(s // 2 for s in starts)), "post": post, "GSUB": bytes(20), "name": struct.pack(">HHH", 0, 1, 18) + struct.pack(">HHHHHH", 3, 1, 0, 6, len(name), 0) + name}
    return make.table_font(tables)


FONT = OpenType.parse(face())


def read(data, raw=False):
    file = PdfFile(data)
    out = []
    for p in file.pages():
        content = file.content(p)
        if raw:
            content = b"\n".join(x for x in content.split(b"\n") if not x.startswith(b"/Span") and x != b"EMC")
        out.append([r.text for r in PageReader(page_fonts(file, p, {})).read(content).runs])
    return out


def test_round_trip_by_both_ways():
    text = "abc def ghi\nকতর abcdefghij\n\nj"
    data = pdf_writer.render_pdf(text, [FONT], 10, 50, shaper=shaping.simple_shaper)
    want = ["abc def ", "ghi", "কতর ", "abcdefghij", "j"]
    assert read(data) == [want]
    assert read(data, raw=True) == [want]
    assert PdfFile(data).pages()[0]["MediaBox"] == [0, 0, 612, 792]


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet=LETTERS + "\n", max_size=80), st.sampled_from(["left", "right", "center", "justify"]))
def test_wrapping_loses_nothing(text, align):
    data = pdf_writer.render_pdf(text, [FONT], 12, 50, align, shaper=shaping.simple_shaper)
    assert "".join(t for page in read(data) for t in page) == text.replace("\n", "")
    lines = pdf_writer.layout(text, [FONT], 12, 50, shaping.simple_shaper)
    assert all(ln.visual_width <= 50 or sum(not breakable(g.text) for g in ln.glyphs) == 1 for ln in lines)


def test_state_options():
    data = pdf_writer.render_pdf("ab", [FONT], 12, 50, shaper=shaping.simple_shaper, color=(1, 0, 0.5), opacity=0.25, letter_spacing=2.0)
    file = PdfFile(data)
    assert b"1 0 0.5 rg\n/A0 gs" in file.content(file.pages()[0]) and file.pages()[0]["Resources"]["ExtGState"] == {"A0": {"ca": 0.25}}
    assert [ln.width for ln in pdf_writer.layout("ab", [FONT], 12, 50, shaping.simple_shaper, 2.0)] == [16.0] and read(data) == [["ab"]]


def test_fallback_fonts():
    other = OpenType.parse(make.table_font({"cmap": make.cmap12({ord("é"): 3}), **make.simple_tables()}))
    data = pdf_writer.render_pdf("aéb", [FONT, other], 12, 90, shaper=shaping.simple_shaper)
    assert read(data) == [["aéb"]] and "".join(read(data, raw=True)[0]) == "aéb"


def test_many_pages():
    assert [len(p) for p in read(pdf_writer.render_pdf("a\n" * 100, [FONT], 12, 50, shaper=shaping.simple_shaper))] == [45, 45, 10]


def test_drawing_on_pages(spark):
    base = pdf_writer.plain_pdf("there before\nsecond")
    drawing = pdf_writer.Drawing(base)
    one = drawing.draw(1, "abc def ghi", [FONT], 20, 300, 10, max_width=50, shaper=shaping.simple_shaper)
    assert [ln.text for ln in one.lines] == ["abc def ", "ghi"] and one.line_height == pytest.approx(12.0) and one.last_baseline == pytest.approx(288.0) and one.width == 35
    drawing.draw(1, "কত", [FONT], 20, 200, opacity=0.5, color=(1, 0, 0), shaper=shaping.simple_shaper)
    second = drawing.add_page()
    assert second == 2 and drawing.draw(second, "hij", [FONT], 5, 5, align="right", shaper=shaping.simple_shaper).last_baseline == 5
    data = drawing.save()
    assert read(data) == [["there before", "second", "abc def ", "ghi", "কত"], ["hij"]]
    file = PdfFile(data)
    assert len({n for n in file.numbers() if isinstance(o := file.object(n), dict) and o.get("Subtype") == "Type0"}) == 1  # embedded once
    again = pdf_writer.Drawing(data)
    again.draw(2, "abc", [FONT], 5, 50, shaper=shaping.simple_shaper)
    assert read(again.save())[1] == ["hij", "abc"] and read(again.save())[0][0] == "there before"
    fresh = pdf_writer.Drawing()
    fresh.draw(fresh.add_page(100, 100), "a", [FONT], shaper=shaping.simple_shaper)
    assert read(fresh.save()) == [["a"]] and PdfFile(fresh.save()).pages()[0]["MediaBox"] == [0, 0, 100, 100]
    assert read(pdf_writer.Drawing(make.packed(b"BT /F1 9 Tf (in streams) Tj ET")).save()) == [["in streams"]]


def test_drawing_as_rows(spark):
    base = pdf_writer.plain_pdf("x")
    rows = [(1, base, "abc"), (2, None, "abc"), (3, base, None), (4, b"%PDF-1.4 junk", "abc")]
    df = spark.createDataFrame(rows, "doc_id long, content binary, text string")
    got = {r["doc_id"]: r for r in pdf_writer.draw(df, [face()], x=10.0, y=100.0, size=10.0).collect()}
    assert read(bytes(got[1]["content"])) == [["x", "abc"]] and got[1]["last_baseline"] == 100 and got[1]["width"] == 15 and got[1]["error"] is None
    assert (got[2]["content"], got[2]["error"], got[3]["error"]) == (None, "no file", "no text") and bytes(got[3]["content"]) == base and got[4]["error"]


@pytest.mark.parametrize("value", [None, True, 3, -2.5, b"a(b)\\", "x"])
def test_values_are_written_as_they_are_read(value):
    from quire.sources.pdf_syntax import Name, Ref, Scanner

    for v in ([value] if not isinstance(value, str) else [Name("A B#/(")], {"K y": Ref(3, 1), "L": [value] if not isinstance(value, str) else [Name(value)]}):
        assert next(iter(Scanner(pdf_writer.written(v)))) == v


def test_subset():
    small = pdf_writer.subset_font(FONT, {30})
    cut = OpenType.parse(small)
    assert pdf_writer.components(FONT, 30) == [5, 6] and cut.glyph_count == FONT.glyph_count and cut.cmap == FONT.cmap
    size = [b - a for a, b in zip(cut.loca, cut.loca[1:])]
    assert [g for g, n in enumerate(size) if n] == [0, 5, 6, 30] and "GSUB" not in cut.tables and cut.tables["post"][1] == 32
    assert pdf_writer.checksum(small) == 0xB1B0AFBA
    for tag, (at, n) in cut.tables.items():
        if tag != "head":
            record = small[12:].index(tag.encode()) + 12
            assert struct.unpack(">I", small[record + 4 : record + 8])[0] == pdf_writer.checksum(small[at : at + n]), tag
    assert pdf_writer.subset_font(OpenType.parse(make.table_font({"cmap": make.cmap12({65: 1})})), {1}) is None
    assert FONT.postscript_name == "TestFace" and FONT.extents(1) == (0, 4)


def test_codes_and_maps():
    c = pdf_writer.CidFont(FONT)
    assert [c.code(5, "a", 500), c.code(6, "", 0), c.code(5, "a", 500), c.code(5, "b", 500)] == [1, 2, 1, 3]
    assert b"<0002> <FEFF>" in c.to_unicode() and b"3 beginbfchar" in c.to_unicode()
    assert [pdf_writer.number(x) for x in (1.5, 2.0, -0.0000001, -3.25)] == ["1.5", "2", "0", "-3.25"]


def test_glyph_texts():
    wide, mark = 500, 0
    assert clusters([Glyph(1, 0, 0, wide), Glyph(2, 1, 1, wide)], "ab")[1].text == "b"
    assert clusters([Glyph(1, 0, 1, wide), Glyph(2, 0, 0, wide)], "ab")[0].glyph_texts == ["ab", ""]
    assert clusters([Glyph(1, 0, 0, wide), Glyph(2, 0, 1, mark)], "ab")[0].glyph_texts == ["ab", ""]
    assert clusters([Glyph(1, 0, 2, mark), Glyph(2, 0, 0, wide)], "abc")[0].glyph_texts == ["", "abc"]
    assert clusters([Glyph(1, 0, 0, wide), Glyph(2, 0, 2, wide)], "a" + chr(0x200D) + "b")[0].glyph_texts == ["a", chr(0x200D) + "b"]
    assert clusters([Glyph(1, 1, 1, wide), Glyph(2, 0, 0, wide)], "ab")[0].text == "ab" and clusters([], "") == []


@pytest.mark.skipif(not shaping.harfbuzz_available(), reason="no HarfBuzz here")
def test_harfbuzz_agrees_on_plain_text():
    a, b = shaping.harfbuzz_shaper(FONT, "abc de"), shaping.simple_shaper(FONT, "abc de")
    assert [(g.gid, g.cluster, g.source, g.x_advance) for g in a] == [(g.gid, g.cluster, g.source, g.x_advance) for g in b]
    assert shaping.harfbuzz_shaper(FONT, "abc", "Latn", "bn") == a[:3] and shaping.best_shaper("bn")(FONT, "abc", "Zyyy") == a[:3]


@pytest.mark.skipif(not shaping.harfbuzz_available(), reason="no HarfBuzz here")
def test_harfbuzz_forms_bengali_conjuncts():
    """A ligature rule of the font applies, a vowel sign is drawn before its cluster, and the glyphs read back to the text."""
    ka, ta, virama, sign = 0x0995, 0x09A4, 0x09CD, 0x09BF
    font = make.table_font({"cmap": make.cmap12({ka: 1, ta: 2, sign: 3, 0x09B0: 4, virama: 5, 0x25CC: 8}), **make.simple_tables(), "GSUB": make.gsub_ligatures({(1, 5, 2): 20}, b"akhn", b"bng2")})
    face = OpenType.parse(font)
    text = chr(ka) + chr(virama) + chr(ta) + chr(sign)
    glyphs = shaping.harfbuzz_shaper(face, text, "Beng")
    assert [g.gid for g in glyphs] == [3, 20] and {g.cluster for g in glyphs} == {0}
    assert [c.text for c in clusters(glyphs, text)] == [text]
    back = GlyphText(face, replay=shaping.replay_factory(face))
    assert back.read([3, 20]) == text
    data = pdf_writer.render_pdf(text + " " + chr(ka), [face], 12, 200, shaper=shaping.harfbuzz_shaper)
    assert read(data) == [[text + " " + chr(ka)]]


@pytest.mark.skipif(not shaping.harfbuzz_available(), reason="no HarfBuzz here")
def test_fonts_of_the_library_are_freed():
    held = shaping._Fonts(2)
    fonts = [OpenType.parse(make.table_font({"cmap": make.cmap12({65: 1 + i}), **make.simple_tables()})) for i in range(5)]
    assert all(held.get(f) for f in fonts) and len(held.held) == 2 and held.get(fonts[-1]) == held.get(fonts[-1])


def test_written_files_are_read_by_the_source(spark, tmp_path):
    df = spark.createDataFrame([(1, "abc কত"), (2, None), (3, "hij")], "doc_id long, text string")
    made = pdf_writer.render(df, [face()], size=11.0, width=300.0).where("content is not null")
    files = made.selectExpr("cast(doc_id as string) as doc_id", "content")
    got = {r["doc_id"]: (r["text"], r["confidence"]) for r in pdf.extract_documents(files).collect()}
    assert got == {"1": ("abc কত", 1.0), "3": ("hij", 1.0)}
