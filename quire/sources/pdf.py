"""PDF files as relations.

A file is one unit of work: it is parsed once per level asked for, in Arrow
batches, and everything after that (lines, pages, documents) is DataFrame
operations. A file that fails to parse gives a row with ``error`` instead of a
failed task; so does one above ``max_bytes``, whose bytes are not read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.shaping import replay_factory as system_replay
from quire.operators import assembly
from quire.sources.pdf_content import PageReader
from quire.sources.pdf_file import PdfFile, looks_like_pdf, plain
from quire.sources.pdf_fonts import page_fonts
from quire.sources.pdf_syntax import Keyword, Name, Ref, Scanner, Stream, is_number

MAX_BYTES = 512 << 20

_RUN = "struct<run_seq int, text string, font_key string, x double, y double, font_size double, object_index int, is_bijoy boolean, is_inferred boolean, is_unmapped boolean>"
PAGE_SCHEMA = f"doc_id string, page_no int, has_images boolean, actual_text_used boolean, is_encrypted boolean, is_locked boolean, error string, runs array<{_RUN}>"
OBJECT_SCHEMA = "doc_id string, obj_num int, kind string, value string, raw binary"
OP_SCHEMA = "doc_id string, page_no int, op_seq int, operator string, operands string"
FONT_SCHEMA = "doc_id string, page_no int, font_key string, base_font string, subtype string, two_byte boolean, is_bijoy boolean, untrusted boolean, coverage double, to_unicode map<int,string>, differences map<int,string>, cid_to_gid map<int,int>, embedded_glyphs int"


def read_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, glob: str = "*") -> DataFrame:
    """``doc_id`` (the path), ``length``, ``content`` and ``error`` of all files.

    The length bound is pushed into the scan; a file above it has null content and an error that names its length.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    fits = F.col("length") <= max_bytes
    read = files.where(fits).select(F.col("path").alias("doc_id"), "length", "content", F.lit(None).cast("string").alias("error"))
    error = F.concat(F.lit("file of "), F.col("length").cast("string"), F.lit(f" bytes exceeds the bound of {max_bytes}"))
    return read.unionByName(files.where(~fits).select(F.col("path").alias("doc_id"), "length", F.lit(None).cast("binary").alias("content"), error.alias("error")))


def has_header(content: str = "content") -> Column:
    """The header test, in the JVM."""
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    return (F.octet_length(content) >= 8) & (F.instr(head, "%PDF-") > 0)


def only_pdfs(files: DataFrame) -> DataFrame:
    """The files that pass the header test, before any byte reaches Python, and those that carry an error."""
    return files.where(has_header() | F.col("error").isNotNull() if "error" in files.columns else has_header())


def _batches(schema: pa.Schema, rows: Iterator[tuple], size: int = 2000, weight: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of up to ``size`` rows, fewer where their bytes, texts and lists are large."""
    held: list[tuple] = []
    heavy = 0
    for row in rows:
        held.append(row)
        heavy += sum(len(v) * (200 if isinstance(v, list) else 1) for v in row if isinstance(v, (bytes, str, list)))
        if len(held) >= size or heavy >= weight:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, heavy = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _mapped(files: DataFrame, schema: str, rows: Callable, password: str = "", on_error: Callable | None = None, on_other: Callable | None = None) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    extra = [c for c in ("password", "error") if c in files.columns]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                more = {k: batch.column(2 + j)[i].as_py() for j, k in enumerate(extra)}
                secret = more.get("password", password)
                if more.get("error") is not None:
                    yield from on_error(doc_id, more["error"]) if on_error else ()
                    continue
                if content is None or not looks_like_pdf(content):
                    yield from on_other(doc_id) if on_other else ()
                    continue
                try:
                    yield from rows(doc_id, PdfFile(content, secret or ""))
                except Exception as e:  # a damaged file must not fail its task; what was read of it stays
                    yield from on_error(doc_id, f"{type(e).__name__}: {e}"[:500]) if on_error else ()

    return files.select("doc_id", "content", *extra).mapInArrow(lambda batches: _batches(arrow, each(batches)), schema)


def _kind(value) -> str:
    for kind, types in (("null", type(None)), ("bool", bool), ("name", Name), ("ref", Ref), ("string", bytes), ("array", list), ("stream", Stream), ("dict", dict)):
        if isinstance(value, types):
            return kind
    return "number" if is_number(value) else "operator"


def objects(files: DataFrame, password: str = "") -> DataFrame:
    """Every numbered object: its kind, its value as JSON (variant-ready), the decoded bytes of streams."""

    def rows(doc_id, file):
        for n in file.numbers():
            value = file.object(n)
            raw = file.decoded(value) if isinstance(value, Stream) else None
            yield doc_id, n, _kind(value), json.dumps(plain(value), ensure_ascii=False), raw

    return _mapped(files, OBJECT_SCHEMA, rows, password)


def content_ops(files: DataFrame, password: str = "") -> DataFrame:
    """Every content operator with its operands as JSON."""

    def rows(doc_id, file):
        for p, page in enumerate(file.pages(), 1):
            seq, operands = 0, []
            for token in Scanner(file.content(page)):
                if isinstance(token, Keyword):
                    yield doc_id, p, seq, str(token), json.dumps([plain(v) for v in operands], ensure_ascii=False)
                    seq, operands = seq + 1, []
                else:
                    operands.append(token)

    return _mapped(files, OP_SCHEMA, rows, password)


def fonts(files: DataFrame, password: str = "") -> DataFrame:
    """The fonts of each page and what is known of their codes."""

    def rows(doc_id, file):
        cache: dict = {}
        for p, page in enumerate(file.pages(), 1):
            for key, f in page_fonts(file, page, cache).items():
                coverage = f.glyph_text.coverage if f.glyph_text else None
                yield doc_id, p, key, f.name, f.subtype, f.wide, f.is_bijoy, f.untrusted, coverage, f.to_unicode, f.differences, f.cid_to_gid, f.face.glyph_count if f.face else None

    return _mapped(files, FONT_SCHEMA, rows, password)


def pages(files: DataFrame, password: str = "", replay_factory=system_replay, keep_others: bool = False) -> DataFrame:
    """One row per page with its runs; a file without pages, and one that is damaged, gives a row with page_no null.

    So does a file that is no PDF, or whose content is null, with ``keep_others``.
    Text read back from glyphs is shaped again to verify it, where there is a
    system shaper; ``replay_factory`` gives another, or None for no such check.
    """

    def rows(doc_id, file):
        cache: dict = {}
        found = False
        for p, page in enumerate(file.pages(), 1):
            found = True
            read = PageReader(page_fonts(file, page, cache, replay_factory)).read(file.content(page))
            runs = []
            for i, r in enumerate(read.runs):
                f = r.font
                inferred = f is not None and f.untrusted and f.glyph_text is not None
                unmapped = f is None or (not f.to_unicode and f.composite)
                runs.append({"run_seq": i, "text": r.text.encode("utf-16", "surrogatepass").decode("utf-16", "replace"), "font_key": f.name if f else None, "x": r.x, "y": r.y, "font_size": r.size, "object_index": r.object_index, "is_bijoy": bool(f and f.is_bijoy), "is_inferred": inferred, "is_unmapped": unmapped})
            yield doc_id, p, read.images > 0, read.actual_text_used, file.is_encrypted, file.is_locked, None, runs
        if not found:
            yield doc_id, None, False, False, file.is_encrypted, file.is_locked, None, []

    def failed(doc_id, error=None):
        yield doc_id, None, False, False, False, False, error, []

    return _mapped(files, PAGE_SCHEMA, rows, password, failed, failed if keep_others else None)


def text_runs(parsed: DataFrame) -> DataFrame:
    """``pages`` unfolded: a row per run, and one with null text for a page without runs."""
    return parsed.select("doc_id", "page_no", "has_images", "actual_text_used", "is_encrypted", "is_locked", "error", F.explode_outer("runs").alias("r")).select("*", "r.*").drop("r")


def extract_documents(files: DataFrame, password: str = "", ocr=None, replay_factory=system_replay) -> DataFrame:
    """One row per file: ``doc_id, text, encoding, confidence, is_encrypted, is_locked, has_bangla, error, pages``.

    Files that are no PDFs get an empty result. ``ocr`` is a UDF of (doc_id,
    page_no, text), asked for pages without text, or with images and no letter.
    A ``password`` column of ``files`` overrides the argument.
    """
    carry = ["has_images", "actual_text_used", "is_encrypted", "is_locked", "error"]
    sent = files.withColumn("content", F.when(has_header(), F.col("content")))  # other files' bytes stay in the JVM
    # a page's runs are put together where they were read: only its text moves to its document
    assembled = assembly.assemble_pages(pages(sent, password, replay_factory, keep_others=True), carry)
    if ocr is not None:
        assembled = assembly.with_ocr(assembled, ocr)
    page = F.when(F.col("page_no").isNotNull(), F.struct(F.col("page_no").alias("number"), "text", "encoding", "has_images"))
    with_text = F.col("text") != ""
    assembled = assembled.withColumns({"_c": assembly.certainty(assembled), "_page": page})
    docs = assembled.groupBy("doc_id").agg(
        F.expr("listagg(CASE WHEN text <> '' THEN text END, '\\n\\n') WITHIN GROUP (ORDER BY page_no)").alias("joined"),
        F.bool_or("saw_unicode").alias("u"),
        F.bool_or("saw_bijoy").alias("b"),
        F.avg(F.when(with_text, F.col("_c"))).alias("confidence"),
        F.bool_or("is_encrypted").alias("is_encrypted"),
        F.bool_or("is_locked").alias("is_locked"),
        F.max("error").alias("error"),
        F.array_sort(F.collect_list("_page")).alias("pages"),
    )
    text = F.coalesce("joined", F.lit(""))
    false = F.lit(False)
    return docs.select(
        "doc_id",
        text.alias("text"),
        assembly.classify(F.coalesce("u", false), F.coalesce("b", false), text).alias("encoding"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.0)))).alias("confidence"),
        F.coalesce("is_encrypted", false).alias("is_encrypted"),
        F.coalesce("is_locked", false).alias("is_locked"),
        assembly.has_bengali(text).alias("has_bangla"),
        "error",
        "pages",
    )
