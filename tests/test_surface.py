import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import bijoy
from quire.functions.fonts import FontShaper, load_font
from quire.functions.register import register, register_files
from quire.operators import layout, measure
from quire.sources import pdf_writer
from tests import pdf_maker as make


def pgm(pixels):
    return b"P5\n# made here\n%d %d\n255\n" % pixels.shape[::-1] + pixels.astype(np.uint8).tobytes()


def picture(dx=0, dy=0, size=12):
    p = np.full((size, size), 255)
    p[2 + dy : 6 + dy, 3 + dx : 5 + dx] = 0
    return p


def test_ink():
    assert measure.parse_pgm(pgm(picture())).tolist() == picture().tolist() and measure.parse_pgm(b"P6 1 1 255\n ") is None and measure.parse_pgm(b"P5 9 9 255\nx") is None
    assert measure.overlap(picture(), picture(3, 4)) == 1
    half = picture()
    half[4:6] = 255
    assert measure.overlap(picture(), half) == 0.5
    blank = np.full((5, 5), 255)
    assert (measure.overlap(blank, blank), measure.overlap(blank, picture())) == (1, 0)


def test_columns(spark):
    df = spark.createDataFrame([(pgm(picture()), pgm(picture(1))), (b"no", pgm(picture())), (None, None)], "a binary, b binary")
    assert [r[0] for r in df.select(measure.ink_overlap("a", "b")).collect()] == [1.0, None, None]
    cases = spark.createDataFrame([("x", "a\nb", "ab"), ("x", "a", "b"), ("y", None, "b")], "category string, got string, want string")
    got = {r["category"]: (r["cases"], r["exact"], r["rate"]) for r in measure.recovery_rate(cases, F.col("got"), F.col("want"), ["category"]).collect()}
    assert got == {"x": (2, 1, 0.5), "y": (1, 0, 0.0)}


def test_sql_surface(spark):
    register(spark)
    assert spark.sql("SELECT bijoy_to_unicode('wK') AS t").first()[0] == "কি"
    assert [tuple(r) for r in spark.sql("SELECT kind, value FROM pdf_tokens(CAST('BT (a) Tj' AS BINARY))").collect()] == [("operator", '"BT"'), ("bytes", '"a"'), ("operator", '"Tj"')]
    spark.createDataFrame([(make.one_page(b"BT ET"), make.table_font({"cmap": make.cmap12({65: 1, 32: 2}), **make.simple_tables()}))], "pdf binary, font binary").createOrReplaceTempView("held")
    assert spark.sql("SELECT obj_num FROM held, LATERAL pdf_objects(pdf, '')").count() == 5
    assert tuple(spark.sql("SELECT code_point, gid, advance FROM held, LATERAL font_cmap(font)").collect()[1]) == (65, 1, 500)
    texts = ["wK", "Avgvi ‡mvbvi", "কি", "", "abc 日本", None]
    spark.createDataFrame([(t,) for t in texts], "t string").createOrReplaceTempView("texts")
    got = {r["t"]: (r["c"], r["f"]) for r in spark.sql("SELECT t, bijoy_confidence(t) AS c, looks_like_bijoy_font(t) AS f FROM texts").collect()}
    assert all(got[t][0] == pytest.approx(bijoy.confidence_text(t)) for t in texts if t is not None) and got[None] == (None, None) or got[None][0] == 0
    assert spark.sql("SELECT looks_like_bijoy_font('AAAAAA+Sutonny-OMJ')").first()[0] is True and spark.sql("SELECT looks_like_bijoy_font('Arial')").first()[0] is False
    assert [tuple(r) for r in spark.sql("SELECT page_no, text FROM held, LATERAL pdf_runs(render_pdf('AA A', font, 12, 100), '')").collect()] == [(1, "AA A")]
    assert [r[0] for r in spark.sql("SELECT text FROM wrap_lines('ab cd', 4) ORDER BY line_no").collect()] == ["ab ", "cd"]


def test_views_of_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf_writer.plain_pdf("first line\nsecond"))
    (tmp_path / "b.txt").write_bytes(b"no file of this kind")
    register_files(spark, str(tmp_path), "held")
    got = {r["doc_id"].rsplit("/", 1)[1]: r["text"] for r in spark.sql("SELECT doc_id, text FROM held_documents").collect()}
    assert got == {"a.pdf": "first line\nsecond", "b.txt": ""}
    assert spark.sql("SELECT count(*) FROM held_operators WHERE operator = 'Tj'").first()[0] == 2
    assert spark.sql("SELECT base_font FROM held_fonts").first()[0] == "Helvetica" and spark.sql("SELECT * FROM held_pages").count() == 1


def test_fonts_as_measures(spark, tmp_path):
    font = make.table_font({"cmap": make.cmap12({ord(c): 1 + i for i, c in enumerate("abc de")}), **make.simple_tables()})
    (tmp_path / "f.ttf").write_bytes(font)
    assert load_font(spark, f"{tmp_path}/f.ttf") == font
    with pytest.raises(ValueError, match="no font"):
        load_font(spark)
    spark.conf.set("spark.quire.defaultFont", f"{tmp_path}/f.ttf")
    assert load_font(spark) == font
    spark.conf.unset("spark.quire.defaultFont")
    df = spark.createDataFrame([(1, "abc de abc"), (2, None)], "doc_id long, text string")
    lines = layout.wrap_lines(df, "doc_id", "text", 35.0, FontShaper((font,), 10.0)).orderBy("line_no").collect()
    assert [(r["text"], r["visual_width"]) for r in lines] == [("abc de ", 30.0), ("abc", 15.0)]  # half an em each


@pytest.mark.parametrize("name", ["entry", "queries", "oracle_sql"])
def test_entry_contract(spark, name):
    import __spark_entry__ as e

    if name == "entry":
        assert e.entry(spark).columns == ["lang", "docs", "mean_confidence", "max_confidence", "likely"]
    elif name == "queries":
        assert all(map(callable, e.queries().values())) and len(e.queries()) >= 30
    else:
        assert set(e.oracle_sql()) <= set(e.queries()) and all(isinstance(v, str) for v in e.oracle_sql().values())


def test_closure_never_returns_a_part(spark):
    from quire.operators.relational import closure

    edges = spark.createDataFrame([(i, i + 1) for i in range(4)], "src int, dst int")
    seeds = spark.createDataFrame([(0,)], "node int")
    assert {r["node"] for r in closure(edges, seeds).collect()} == set(range(5))
    assert closure(edges, seeds, rounds=4).count() == 5
    with pytest.raises(RuntimeError, match="after 2 rounds"):
        closure(edges, seeds, rounds=2)
