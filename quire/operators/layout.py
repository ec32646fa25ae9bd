"""Breaking text into lines and aligning them.

Line breaking is greedy and depends on where the last line ended, so a
paragraph is one step of work; paragraphs are independent and are processed in
Arrow batches, line widths and alignment are Columns.

The widths come from a shaper: any callable that turns a paragraph into
clusters ``(text, width)``. The default gives each character one unit; a
shaper over font files is ``quire.functions.fonts.FontShaper``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.bengali import SPACES, combining, script_of

Shaper = Callable[[str], list[tuple[str, float]]]


def unit_shaper(paragraph: str) -> list[tuple[str, float]]:
    return [(c, 1.0) for c in paragraph]


_WHITE = "".join(map(chr, [*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
_WHITE_CHAR = re.compile(f"[{_WHITE}]")


def breakable(cluster: str) -> bool:
    """White space only."""
    return bool(cluster) and not cluster.strip(_WHITE)


def wrap(clusters: list[tuple[str, float]], limit: float) -> list[tuple[int, int]]:
    """(start, end) of each line: as many clusters as fit, at least one, cut after the last white space if there is one."""
    out, start, n = [], 0, len(clusters)
    spaces = [breakable(text) for text, _ in clusters]
    while start < n:
        width, end, space = clusters[start][1], start + 1, start if spaces[start] else -1
        while end < n and width + clusters[end][1] <= limit:
            width += clusters[end][1]
            if spaces[end]:
                space = end
            end += 1
        if end < n and start <= space < end - 1:
            end = space + 1
        out.append((start, end))
        start = end
    return out


def unit_lines(paragraph: str, limit: float) -> Iterator[tuple[str, float, float, bool]]:
    """``wrap`` for one unit per character, where the arithmetic needs no loop over characters."""
    room, n, start = max(1, int(limit)), len(paragraph), 0
    white = [m.start() for m in _WHITE_CHAR.finditer(paragraph)]
    while start < n:
        end = min(n, start + room)
        if end < n and (k := bisect_left(white, end) - 1) >= 0 and start <= white[k] < end - 1:
            end = white[k] + 1
        line = paragraph[start:end]
        yield line, float(len(line)), float(len(line.rstrip(_WHITE))), end == n
        start = end


def layout_text(text: str, limit: float, shaper: Shaper = unit_shaper) -> list[tuple[str, float, float, bool]]:
    """(text, width, width without trailing white space, ends its paragraph) of each line."""
    lines = []
    for paragraph in text.split("\n"):
        if paragraph and shaper is unit_shaper:
            lines.extend(unit_lines(paragraph, limit))
            continue
        clusters = shaper(paragraph)
        if not clusters:
            lines.append((paragraph, 0.0, 0.0, True))
            continue
        cuts = wrap(clusters, limit)
        for a, b in cuts:
            seen = b
            while seen > a and breakable(clusters[seen - 1][0]):
                seen -= 1
            lines.append(("".join(t for t, _ in clusters[a:b]), sum(w for _, w in clusters[a:b]), float(sum(w for _, w in clusters[a:seen])), b == len(clusters)))
    return lines


def wrap_lines(df: DataFrame, id_col: str, text_col: str, limit: float, shaper: Shaper = unit_shaper) -> DataFrame:
    """One row per line: ``<id>, line_no, text, width, visual_width, ends_paragraph``. Null texts have no lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = [(key, i, *line) for key, text in zip(*(c.to_pylist() for c in part.columns)) if text is not None for i, line in enumerate(layout_text(text, limit, shaper))]
                columns = list(zip(*rows)) or [[]] * 6
                types = [part.schema.types[0], pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], [id_col, "line_no", "text", "width", "visual_width", "ends_paragraph"])

    rows = df.select(id_col, text_col)
    return rows.mapInArrow(run, f"{id_col} {dict(rows.dtypes)[id_col]}, line_no int, text string, width double, visual_width double, ends_paragraph boolean")


def align_offset(align: Column, available: Column, width: Column) -> Column:
    return F.when(align == "center", (available - width) / 2).when(align == "right", available - width).otherwise(0.0)


def justify_gap(text: Column, visual_width: Column, available: Column, ends_paragraph: Column) -> Column:
    """How much each inner space of a line widens to fill ``available``; null where the line stays as it is."""
    visible = F.regexp_replace(text, " +$", "")
    gaps = F.length(visible) - F.length(F.replace(visible, F.lit(" "), F.lit("")))
    slack = available - visual_width
    return F.when(~ends_paragraph & (slack > 0) & (gaps > 0), slack / gaps)


def justify_shifts(glyph_texts: list[str], visual_width: float, available: float, ends_paragraph: bool) -> list[float] | None:
    """Extra x of each glyph of a justified line, or None."""
    slack = available - visual_width
    last = max((i for i, t in enumerate(glyph_texts) if t != " "), default=-1)
    gaps = [i for i in range(last) if glyph_texts[i] == " "]
    if ends_paragraph or slack <= 0 or not gaps:
        return None
    per, passed, out = slack / len(gaps), 0, []
    inner = set(gaps)
    for i in range(len(glyph_texts)):
        out.append(passed * per)
        passed += i in inner
    return out


def segments(text: str, supports: list[Callable[[int], bool]]) -> list[tuple[int, str, str]]:
    """(font, script, text) of the longest stretches of one font and one script.

    The first font that has a character draws it, the first of all if none
    does; combining characters stay with the font before them, and characters
    common to scripts join their neighbour.
    """
    out: list[list] = []
    for ch in text:
        cp = ord(ch)
        script = script_of(cp)
        font = out[-1][0] if out and combining(cp) else next((i for i, has in enumerate(supports) if has(cp)), 0)
        if out and out[-1][0] == font and (script in ("Zyyy", out[-1][1]) or out[-1][1] == "Zyyy"):
            out[-1][2] += ch
            if out[-1][1] == "Zyyy":
                out[-1][1] = script
        else:
            out.append([font, script, ch])
    return [tuple(s) for s in out]


__all__ = ["SPACES", "align_offset", "breakable", "justify_gap", "justify_shifts", "layout_text", "segments", "unit_shaper", "wrap", "wrap_lines"]
