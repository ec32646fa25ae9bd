"""What the registered queries share: their register, tables, and fragments of DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.functions import bengali, bijoy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, with the SQL that gives the same rows if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SQL_MAP = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in bijoy.conversion_table().items()) + "}"


def substitute_sql(column: str) -> str:
    """The codes of a text column replaced, given the one-row table ``codes``."""
    return f"""array_to_string(list_transform(regexp_extract_all(translate({column}, {quoted(bijoy.ALIASES[0])}, {quoted(bijoy.ALIASES[1])}), {quoted(bijoy.substitution_pattern())}),
  lambda p: coalesce(codes.m[p], p)), '')"""


def replaced_sql(text: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        text = f"replace({text}, {quoted(a)}, {quoted(b)})"
    return text


_C, _V = bijoy.CONSONANT, bengali.VIRAMA
SQL_PRE_BASE = quoted(f"([{bengali.PRE_BASE}])([{_C}](?:[{bijoy.CLUSTER_TAIL}]|{_V}[{_C}])*)")
#: Stands for a ra that a virama precedes: such a one begins no reph.
_HELD = chr(0xE000)


def rephs_sql(text: str) -> str:
    """Each reph moved: the text is cut at its rephs and put together again, each going before the last cluster of what is there."""
    reph = "র" + _V
    hidden = replaced_sql(text, [(_V + reph, _V + _HELD + _V)] * 2)
    last_cluster = quoted(f"(?s)^(.*?)((?:[{_C}{_HELD}]{_V})*[{_C}{_HELD}])([^{_C}{_HELD}]*)$")
    moved = f"CASE WHEN regexp_matches(a, '[{_C}{_HELD}]') THEN regexp_replace(a, {last_cluster}, '\\1{reph}\\2\\3') ELSE '{reph}' || a END"
    return f"replace(list_reduce(string_split({hidden}, '{reph}'), lambda a, x: {moved} || x), '{_HELD}', 'র')"


def unicode_sql(column: str) -> str:
    """The whole conversion of a text column."""
    ordered = f"regexp_replace({substitute_sql(column)}, {SQL_PRE_BASE}, '\\2\\1', 'g')"
    return replaced_sql(rephs_sql(ordered), bijoy._PAIRS + bijoy._NUKTAS)


_WHITE = "\\x{0009}-\\x{000D}\\x{0020}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"


def wrap_sql(table_name: str, key: str, column: str, room: int) -> str:
    """``lines (id, n, line, seen, ends)``: a text's paragraphs broken greedily at ``room`` characters, after the last white space if there is one."""
    return f"""WITH RECURSIVE paragraphs AS (SELECT {key} AS id, parts[pos] AS p, pos FROM (SELECT {key}, parts, unnest(range(1, len(parts) + 1)) AS pos FROM (SELECT {key}, string_split({column}, chr(10)) AS parts FROM {table_name}))),
  cuts AS (SELECT id, pos, 0 AS k, p AS rest, '' AS line FROM paragraphs
    UNION ALL SELECT id, pos, k + 1, substr(rest, length(l) + 1), l FROM (SELECT id, pos, k, rest,
      CASE WHEN length(rest) > {room} AND length(white) BETWEEN 1 AND {room - 1} THEN white ELSE left(rest, {room}) END AS l
      FROM (SELECT *, regexp_extract(left(rest, {room}), '(?s)^.*[{_WHITE}]') AS white FROM cuts WHERE rest <> ''))),
  lines AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos, k) - 1 AS n, line, length(regexp_replace(line, '[{_WHITE}]+$', '')) AS seen, rest = '' AS ends
    FROM cuts JOIN paragraphs USING (id, pos) WHERE k > 0 OR p = '')"""
