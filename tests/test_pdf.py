import base64
import json
import random
import struct
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.sources import pdf, pdf_crypt, pdf_filters
from quire.sources.opentype import GlyphText, OpenType, logical_order, without_inserted_circles
from quire.sources.pdf_content import PageReader
from quire.sources.pdf_file import PdfFile, plain
from quire.sources.pdf_fonts import glyph_name_text, page_fonts, parse_to_unicode
from quire.sources.pdf_syntax import END, Keyword, Name, Ref, Scanner, Stream, utf16
from quire.streaming import ingest
from tests import pdf_maker as make

KA, TA, RA, V, I, AA, E = (chr(c) for c in (0x0995, 0x09A4, 0x09B0, 0x09CD, 0x09BF, 0x09BE, 0x09C7))


def texts(data, password=""):
    file = PdfFile(data, password)
    return [[r.text for r in PageReader(page_fonts(file, p, {})).read(file.content(p)).runs] for p in file.pages()]


def test_scanner():
    got = list(Scanner(b"<</A#20B [1 -2.5 .5 (a\\(b\\)(c)\\101\\\n) <4a4>]/C 12 0 R/D null>> % note\n true obj 3 4 (open"))
    assert got == [{"A B": [1, -2.5, 0.5, b"a(b)(c)A", b"J@"], "C": Ref(12, 0), "D": None}, True, Keyword("obj"), 3, 4, b"open"]
    assert isinstance(next(iter(Scanner(b"/x"))), Name) and Scanner(b"  ").next() is END
    assert list(Scanner(b"[1 2")) == [[1, 2]] and list(Scanner(b"<< 5 /A 1 >>")) == [{"A": 1}] and list(Scanner(b"1e5 --3 5R")) == ["1e5", "--3", "5R"]
    assert utf16(b"\xfe\xff\x09\x95") == KA and utf16(b"a") == "a"


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=200))
def test_scanner_never_fails(data):
    for _ in Scanner(data):
        pass


def test_filters():
    raw = bytes(random.Random(0).choice(b"abcab ") for _ in range(5000))
    assert pdf_filters.flate(zlib.compress(raw) + b"junk") == raw == pdf_filters.flate(zlib.compress(raw)[2:-4])
    assert pdf_filters.flate(b"xx" + zlib.compress(raw)[2:]) == raw and pdf_filters.flate(b"nonsense") == b""
    assert pdf_filters.ascii85(base64.a85encode(raw, adobe=True)) == raw and pdf_filters.ascii85(b"z") == bytes(4)
    assert pdf_filters.ascii_hex(b"48 65 6C6c 6F7>zz") == b"Hellop"
    assert pdf_filters.run_length(bytes([2]) + b"abc" + bytes([254]) + b"x" + bytes([128]) + b"no") == b"abcxxx"
    assert pdf_filters.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert pdf_filters.decode_stream(raw, {"Filter": Name("DCTDecode")}) is None
    assert pdf_filters.decode_stream(zlib.compress(raw).hex().encode(), {"Filter": [Name("AHx"), Name("Fl")]}) == raw


def test_lzw_widths():
    raw = random.Random(1).randbytes(3000)
    assert pdf_filters.lzw(make.encode_lzw(raw)) == raw


@pytest.mark.parametrize("near", [255, 767, 1791, 3837])
def test_lzw_that_ends_where_the_width_grows(near):
    raw = random.Random(1).randbytes(3900)
    for n in range(near - 40, near + 10):
        assert pdf_filters.lzw(make.encode_lzw(raw[:n])) == raw[:n], n


@pytest.mark.parametrize("kind", range(5))
def test_png_predictors(kind):
    rnd, row, bpp = random.Random(kind), 12, 3
    lines = [rnd.randbytes(row) for _ in range(5)]
    coded, above = b"", bytes(row)
    for line in lines:
        out = bytearray()
        for i, v in enumerate(line):
            a, b, c = (line[i - bpp], above[i], above[i - bpp]) if i >= bpp else (0, above[i], 0)
            p = a + b - c
            nearest = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out.append((v - (0, a, b, (a + b) // 2, nearest)[kind]) & 255)
        coded, above = coded + bytes([kind]) + out, line
    parms = {"Predictor": 15, "Colors": 3, "Columns": 4}
    assert pdf_filters.unpredict(coded, parms, lambda v: v) == b"".join(lines)
    tiff = b"".join(bytes((v - (line[i - bpp] if i >= bpp else 0)) & 255 for i, v in enumerate(line)) for line in lines)
    assert pdf_filters.unpredict(tiff, parms | {"Predictor": 2}, lambda v: v) == b"".join(lines)


def test_ciphers_by_published_vectors():
    key = bytes.fromhex("000102030405060708090a0b0c0d0e0f")
    block, coded = bytes.fromhex("00112233445566778899aabbccddeeff"), bytes.fromhex("69c4e0d86a7b0430d8cdb78070b4c55a")
    assert pdf_crypt.cbc_encrypt(key, bytes(16), block) == coded and pdf_crypt.cbc_decrypt(key, bytes(16), coded) == block
    long_key = key + bytes(range(16, 32))
    assert pdf_crypt.cbc_decrypt(long_key, bytes(16), bytes.fromhex("8ea2b7ca516745bfeafc49904b496089")) == block
    assert pdf_crypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    text = random.Random(2).randbytes(160)
    assert pdf_crypt.cbc_decrypt(long_key, key, pdf_crypt.cbc_encrypt(long_key, key, text)) == text


CONTENT = b"BT /F1 12 Tf 10 700 Td (Hello) Tj ( world) Tj 0 -20 Td [(Ne) -300 (xt) 50 (y)] TJ ET"


@pytest.mark.parametrize("data", [make.one_page(CONTENT), make.packed(CONTENT), make.one_page(zlib.compress(CONTENT), filters="/Filter /FlateDecode")])
def test_structures(data):
    want = [["Hello", " world", "Ne xty"]]
    assert texts(data) == want
    assert texts(data[: data.rindex(b"startxref")] + b"startxref\n99999\n%%EOF") in (want, [[]]) or b"ObjStm" in data
    assert texts(b"junk before\n" + data) == want or b"ObjStm" in data
    broken = data.replace(b"/Length %d" % len(CONTENT), b"/Length 3")
    assert texts(broken) == want


def test_later_definitions_win_and_trees_may_be_broken():
    data = make.one_page(CONTENT)
    assert texts(data + make.stream(4, b"BT /F1 9 Tf (Newer) Tj ET")) == [["Newer"]]
    assert texts(data.replace(b"/Kids [3 0 R]", b"/Kids [2 0 R]")) == [["Hello", " world", "Ne xty"]]
    assert PdfFile(data.replace(b"/Root 1 0 R", b"/Boot 1 0 R")).trailer["Root"] == Ref(1)
    assert PdfFile(make.obj(1, "<< /A 1 0 R /B 9 0 R >>") + b"%PDF-").object(9) is None


def test_encryption_is_the_same_without_the_library(monkeypatch):
    rnd = random.Random(5)
    for size in (16, 32):
        for blocks in (0, 1, 2, 300):
            key, iv, data = rnd.randbytes(size), rnd.randbytes(16), rnd.randbytes(16 * blocks)
            assert pdf_crypt.cbc_encrypt(key, iv, data) == pdf_crypt.cbc_by_tables(key, iv, data)
    hashed = pdf_crypt.hash_2b(b"secret", b"saltsalt", bytes(48), 6)
    monkeypatch.setattr(pdf_crypt, "_openssl", lambda: None)
    assert pdf_crypt.hash_2b(b"secret", b"saltsalt", bytes(48), 6) == hashed


@pytest.mark.skipif(pdf_crypt._openssl() is None, reason="hashlib is linked to no library with AES")
def test_a_hash_of_revision_6_takes_milliseconds():
    started = time.process_time()
    for n in range(20):
        pdf_crypt.hash_2b(b"secret", n.to_bytes(8, "big"), bytes(48), 6)
    assert time.process_time() - started < 2  # the tables take some 0.5 s for each


@pytest.mark.parametrize("how", [(2, 40), (3, 128), (4, 128, True)])
def test_legacy_encryption(how):
    want = [["Hello", " world", "Ne xty"]]
    assert texts(make.legacy_encrypted(CONTENT, *how)) == want
    locked = make.legacy_encrypted(CONTENT, *how, user=b"secret") if len(how) == 3 else make.legacy_encrypted(CONTENT, *how, False, b"secret")
    assert PdfFile(locked).is_locked and PdfFile(locked).is_encrypted
    assert texts(locked, "secret") == want and texts(locked, "own") == want


@pytest.mark.parametrize("revision", [5, 6])
def test_256_bit_encryption(revision):
    want = [["Hello", " world", "Ne xty"]]
    assert texts(make.modern_encrypted(CONTENT, revision)) == want
    locked = make.modern_encrypted(CONTENT, revision, b"secret")
    assert PdfFile(locked).is_locked and texts(locked, "secret") == want and texts(locked, "own") == want


def runs(content, fonts={}):
    return PageReader(fonts).read(content).runs


def test_content_machine():
    got = runs(b"q 2 0 0 2 10 20 cm BT 12 TL 5 7 Td (a) Tj T* (b) Tj (c) ' ET Q BT 1 0 0 1 3 4 Tm (d) Tj ET")
    assert [(r.text, r.x, r.y, r.object_index) for r in got] == [("a", 20, 34, 1), ("b", 20, 10, 1), ("c", 20, -14, 1), ("d", 3, 4, 2)]
    page = PageReader({}).read(b"/Span << /ActualText <FEFF00410042> >> BDC BT 9 9 Td (x) Tj (y) Tj ET EMC /Im Do BI /W 1 ID \x00(z) Tj EI BT (w) Tj ET")
    assert [(r.text, r.x) for r in page.runs] == [("AB", 9), ("w", 0)] and page.images == 2 and page.actual_text_used
    assert [r.text for r in runs(b"/S << /ActualText (zz) >> BDC EMC /P <</MCID 1>> BDC (t) Tj EMC EMC")] == [utf16(b"zz"), "t"]
    assert [r.text for r in runs(b"[(a) -119 (b) -120 (c)] TJ () Tj 5 Tj")] == ["ab c"]


CMAP = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0995> <0002> <> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<0061> <00620063>] endbfrange"


def test_to_unicode():
    table, wide = parse_to_unicode(CMAP)
    assert wide and table == {1: KA, 2: "", 0x10: "A", 0x11: "B", 0x12: "C", 0x20: "a", 0x21: "bc"}
    assert [glyph_name_text(n) for n in ("uni0995", "u0995", "A", "union")] == [KA, KA, None, None]


def face(extra={}, pairs=None):
    letters = {0x0995: 1, 0x09A4: 2, 0x09BF: 3, 0x09B0: 4, 0x09CD: 5, 0x09BE: 6, 0x20: 7, 0x25CC: 8, 0x09AF: 9}
    return make.table_font({"cmap": make.cmap12(letters if pairs is None else pairs), **make.simple_tables(), **extra})


def test_font_tables():
    f = OpenType.parse(face({"GSUB": make.gsub_ligatures({(1, 5, 2): 20})}))
    assert f.cmap[0x0995] == 1 and f.advance(3) == f.advance(99) == 500 and (f.ascender, f.descender, f.upem) == (800, -200, 1000)
    assert f.declares_bengali and not f.covers_bengali
    assert list(f.layout("GSUB").substitutions()) == [(0, 20, [1, 5, 2])]
    assert OpenType.parse(b"no font at all") is None and OpenType.parse(b"\0\1\0\0" + bytes(20)) is None
    seg = struct.pack(">HHHHHHH", 4, 40, 0, 4, 0, 0, 0) + struct.pack(">HH", 0xF042, 0xFFFF) + b"\0\0" + struct.pack(">HHHHHH", 0xF041, 0xFFFF, (5 - 0xF041) & 0xFFFF, 1, 0, 0)
    symbol = make.table_font({"cmap": struct.pack(">HHHHI", 0, 1, 3, 0, 12) + seg, **make.simple_tables()})
    assert OpenType.parse(symbol).cmap == {0xF041: 5, 0xF042: 6, 0x41: 5, 0x42: 6}


def test_glyphs_read_backwards():
    lig = {(1, 5, 2): 20, (3, 2): 21, (4, 5): 22}
    g = GlyphText(OpenType.parse(face({"GSUB": make.gsub_ligatures(lig)})))
    assert g.text[20] == KA + V + TA and g.text[21] == TA + I and g.coverage == 1
    assert g.read([3, 20]) == KA + V + TA + I
    assert g.read([1, 22]) == RA + V + KA and g.read([99, 1], lambda i: "?") == "?" + KA
    learned = GlyphText(OpenType.parse(face({"GSUB": make.gsub_ligatures({(1, 30): 31, (2, 30): 32})})), {31: [KA + "ৃ"], 32: [TA + "ৃ", RA + TA]})
    assert learned.text[30] == "ৃ" and learned.text[32] == TA + "ৃ"
    shaped = {KA + V + TA: [20], KA + TA + V: [1, 2, 5]}
    g.replay = lambda t: shaped.get(t, [])
    assert g.read([1, 2, 5]) == KA + TA + V


def test_reordering():
    assert logical_order([I, KA, V + TA, AA]) == KA + V + TA + I + AA
    assert logical_order([KA, RA + V + AA]) == RA + V + KA + AA
    assert logical_order(["a", " ", V + TA]) == "a" + V + TA and logical_order(["a", " ", I, KA]) == "a " + KA + I
    assert without_inserted_circles([KA, chr(0x25CC), AA]) == [KA, AA] and without_inserted_circles(["a", chr(0x25CC), AA]) == ["a", chr(0x25CC), AA]


def test_untrusted_fonts_are_read_back():
    content = b"BT /F1 10 Tf 0 0 Td <0003> Tj 5 0 Td <0001> Tj 20 0 Td <0002> Tj ( ) Tj <0001> Tj 0 -20 Td [<0001> -200 <0002>] TJ ET"
    want = [[KA + I + " " + TA + " " + KA, KA + " " + TA]]
    assert texts(make.composite(face(), content)) == want
    wrong = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 3 beginbfchar <0001> <09A4> <0002> <0995> <0003> <0041> endbfchar"
    bengali = face({"GSUB": make.gsub_ligatures({(1, 5, 2): 20})})
    assert texts(make.composite(bengali, content, wrong)) == want
    right = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0995> <0002> <09A4> endbfchar"
    assert texts(make.composite(bengali, b"BT /F1 10 Tf <00010002> Tj ET", right)) == [[KA + TA]]


def bijoy_page():
    high = {c: c - 0x9F for c in range(0xA0, 0x100)}
    return make.one_page(b"BT /F1 12 Tf 0 700 Td (Avgvi) Tj ET BT 30 700 Td (\\207mvbvi) Tj ET", font="<< /Type /Font /Subtype /TrueType /BaseFont /ABCDEF+SutonnyMJ /FontDescriptor 7 0 R >>", extra={7: make.obj(7, "<< /FontFile2 10 0 R >>"), 10: make.stream(10, face(pairs=high))})


def test_extraction(spark, tmp_path):
    files = {
        "plain.pdf": make.one_page(b"BT /F1 12 Tf 0 700 Td (Total) Tj ET BT 50 700 Td (:) Tj ET BT 60 700 Td (12) Tj ET BT 70 700 Td (.) Tj ET BT 72 700 Td (5) Tj ET BT 0 680 Td (end) Tj ET"),
        "bijoy.pdf": bijoy_page(),
        "bengali.pdf": make.composite(face(), b"BT /F1 10 Tf <00030001> Tj ET"),
        "scan.pdf": make.one_page(b"/Im1 Do"),
        "locked.pdf": make.legacy_encrypted(CONTENT, 3, 128, False, b"secret"),
        "not.pdf": b"just some text",
        "broken.pdf": b"%PDF-1.4\n" + b"1 0 obj << /Type /Catalog",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    read = pdf.read_files(spark, str(tmp_path))
    got = {r["doc_id"].rsplit("/", 1)[1]: r for r in pdf.extract_documents(read).collect()}
    assert set(got) == set(files)
    assert got["plain.pdf"]["text"] == "Total: 12.5\nend" and got["plain.pdf"]["encoding"] == "unicode" and got["plain.pdf"]["confidence"] == 1
    assert got["bijoy.pdf"]["encoding"] == "bijoy" and got["bijoy.pdf"]["text"].startswith("আমার") and got["bijoy.pdf"]["confidence"] == pytest.approx(0.85)
    assert got["bengali.pdf"]["text"] == KA + I and got["bengali.pdf"]["has_bangla"] and got["bengali.pdf"]["confidence"] == pytest.approx(0.75)
    assert (got["scan.pdf"]["text"], got["scan.pdf"]["encoding"], got["scan.pdf"]["pages"][0]["has_images"]) == ("", "none", True)
    assert got["locked.pdf"]["is_locked"] and got["locked.pdf"]["is_encrypted"]
    assert (got["not.pdf"]["text"], got["not.pdf"]["pages"], got["not.pdf"]["encoding"]) == ("", [], "none")
    opened = pdf.extract_documents(read, "secret").where("doc_id like '%locked.pdf'").first()
    assert opened["text"] == "Hello world\nNe xty" and opened["is_encrypted"] and not opened["is_locked"]

    objs = {(r["obj_num"], r["kind"]) for r in pdf.objects(read).where("doc_id like '%plain.pdf'").collect()}
    assert {(1, "dict"), (4, "stream")} <= objs
    ops = [r["operator"] for r in pdf.content_ops(read).where("doc_id like '%scan.pdf'").collect()]
    assert ops == ["Do"]
    fonts = {r["doc_id"].rsplit("/", 1)[1]: r for r in pdf.fonts(read).collect()}
    assert fonts["bijoy.pdf"]["is_bijoy"] and fonts["bengali.pdf"]["untrusted"] and fonts["bengali.pdf"]["base_font"] == "Kalpurush"

    query = ingest.ingest(ingest.file_stream(spark, str(tmp_path)), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    streamed = {r["doc_id"].rsplit("/", 1)[1]: r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert streamed == {n: r["text"] for n, r in got.items()}


def test_json_values():
    assert json.dumps(plain({"A": [Name("B"), b"c", Ref(1), Stream({"L": 1}, b"")]})) == '{"A": ["/B", "c", "1 0 R", {"L": 1}]}'


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 400), st.binary(min_size=1, max_size=6), st.sampled_from([0, 1, 2]))
def test_damaged_files_never_fail(at, junk, which):
    data = (make.one_page(CONTENT), make.packed(CONTENT), make.composite(face({"GSUB": make.gsub_ligatures({(1, 5, 2): 20})}), b"BT /F1 10 Tf <00030001> Tj ET"))[which]
    at = at * len(data) // 400
    texts(data[:at] + junk + data[at + len(junk) :])


def test_files_above_the_bound_give_an_error_row(spark, tmp_path):
    (tmp_path / "small.pdf").write_bytes(b"no pdf")
    (tmp_path / "large.pdf").write_bytes(b"%PDF-1.4 " + b"x" * 5000)
    files = pdf.read_files(spark, str(tmp_path), max_bytes=1000)
    read = {r["doc_id"].rsplit("/", 1)[1]: r for r in files.collect()}
    assert read["large.pdf"]["content"] is None and read["large.pdf"]["length"] == 5009 and "5009" in read["large.pdf"]["error"]
    assert bytes(read["small.pdf"]["content"]) == b"no pdf" and read["small.pdf"]["error"] is None
    docs = {r["doc_id"].rsplit("/", 1)[1]: r for r in pdf.extract_documents(files).collect()}
    assert len(docs) == 2 and "5009" in docs["large.pdf"]["error"] and docs["large.pdf"]["text"] == "" and docs["small.pdf"]["error"] is None
    runs = pdf.text_runs(pdf.pages(pdf.only_pdfs(files))).collect()
    assert [r["error"] for r in runs] == [read["large.pdf"]["error"]]
