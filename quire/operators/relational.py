"""Generic dataflow steps of document extraction, as DataFrame functions.

Each is a composition of joins, windows and pre-aggregated groupings that
Catalyst plans; none collects data to the driver.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.storage import cut


def islands(df: DataFrame, by: list[str], order: list[str], starts: Column, out: str = "island") -> DataFrame:
    """Number the runs of consecutive rows; ``starts`` (over lag expressions) marks a row that begins one."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_start", F.when(F.row_number().over(w) == 1, 1).otherwise(F.coalesce(starts, F.lit(False)).cast("int"))).withColumn(out, F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_start")


def first_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. The limit per key applies before the shuffle as well."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    return first_wins(df, key, [F.desc(c) for c in order])


def dictionary(df: DataFrame, key: list[str], seq: list[str], by: list[str] = [], out: str = "code") -> DataFrame:  # noqa: B006
    """Distinct keys, numbered from 1 in order of first appearance (within ``by``)."""
    first = df.groupBy(*by, *key).agg(F.min(F.struct(*seq)).alias("_first"))
    w = Window.partitionBy(*by).orderBy("_first", *key)
    return first.withColumn(out, F.row_number().over(w)).drop("_first")


def adopt_votes(df: DataFrame, subject: list[str], choice: str) -> DataFrame:
    """The choice with most votes of each subject if it has at least twice the others' votes and more than them."""
    votes = df.groupBy(*subject, choice).agg(F.count(F.lit(1)).alias("votes"))
    w = Window.partitionBy(*subject)
    ranked = votes.withColumns({"others": F.sum("votes").over(w) - F.col("votes"), "_rank": F.row_number().over(w.orderBy(F.desc("votes"), choice))})
    return ranked.where("_rank = 1 and votes >= 2 * others and votes > others").drop("_rank")


def contradictions(claims: DataFrame, truth: DataFrame, key: list[str], group: list[str], agrees: Column, least: int = 3, tenth: int = 10) -> DataFrame:
    """Groups whose claims disagree with the truth at least ``least`` times and in at least 1/``tenth`` of cases."""
    joined = claims.join(truth, key)
    out = joined.groupBy(*group).agg(F.count_if(agrees).alias("agree"), F.count_if(~agrees).alias("disagree"))
    return out.withColumn("contradicts", (F.col("disagree") >= least) & (F.col("disagree") * tenth >= F.col("agree") + F.col("disagree")))


def expand_ranges(df: DataFrame, low: str, high: str, out: str, most: int | None = None, chunk: int = 1 << 16) -> DataFrame:
    """One row for each value of [low, high]; empty ranges, and those of more than ``most`` values if given, give none.

    Turns a range join into an equi-join. A long range is first cut into chunks, so no row is unfolded at once.
    """
    fits = F.col(high) >= F.col(low)
    if most is not None:
        fits = fits & (F.col(high) - F.col(low) < most)
    starts = df.where(fits).withColumn("_from", F.explode(F.sequence(F.col(low).cast("long"), F.col(high).cast("long"), F.lit(chunk).cast("long"))))
    return starts.withColumn(out, F.explode(F.sequence("_from", F.least(F.col("_from") + (chunk - 1), F.col(high).cast("long"))))).drop("_from")


def inherited_tree(nodes: DataFrame, attributes: list[str]) -> DataFrame:
    """Walk (id, parent, ord, attributes) from the roots down; a child's own attribute overrides the inherited one.

    Gives ``id, level, path`` and the attributes. A round a level: the nodes
    found last are joined with their children and written out, until none
    follow; a path ends where it would meet a node again. Rows order by ``path``.
    """
    own = nodes.select(F.col("id").alias("_id"), F.col("parent").alias("_parent"), F.col("ord").alias("_ord"), *[F.col(a).alias(f"_own_{a}") for a in attributes])
    roots = nodes.where("parent IS NULL")
    level = cut(roots.select("id", F.lit(0).alias("level"), F.array("ord").alias("path"), F.array("id").alias("seen"), *attributes))
    levels = [level]
    for n in count(1):
        below = level.join(own, (F.col("id") == F.col("_parent")) & ~F.array_contains("seen", F.col("_id")))
        merged = [F.coalesce(F.col(f"_own_{a}"), F.col(a)).alias(a) for a in attributes]
        level = cut(below.select(F.col("_id").alias("id"), F.lit(n).alias("level"), F.array_append("path", F.col("_ord")).alias("path"), F.array_append("seen", F.col("_id")).alias("seen"), *merged))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels).drop("seen")
        levels.append(level)


def closure(edges: DataFrame, seeds: DataFrame, rounds: int | None = None) -> DataFrame:
    """All nodes reachable from ``seeds`` (node) along ``edges`` (src, dst), each once.

    A semi-naive loop: each round joins only the nodes found last, and is
    written out (reliable checkpoint). It ends when nothing new is found; where that takes more than ``rounds``, it raises.
    """
    found = seeds.select("node").distinct()
    frontier = found
    for n in count():
        reached = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = cut(reached.join(found, "node", "left_anti"))
        if frontier.isEmpty():
            return found
        if rounds is not None and n >= rounds:
            raise RuntimeError(f"closure: nodes are left after {rounds} rounds")
        found = cut(found.unionByName(frontier))


def fold_matrices(matrices: Column) -> Column:
    """Product of an array of ``[a, b, c, d, e, f]`` transforms, each applied before those so far (m x CTM)."""
    identity = F.array(*(F.lit(float(x)) for x in (1, 0, 0, 1, 0, 0)))

    def times(t, m):
        return F.array(
            m[0] * t[0] + m[1] * t[2],
            m[0] * t[1] + m[1] * t[3],
            m[2] * t[0] + m[3] * t[2],
            m[2] * t[1] + m[3] * t[3],
            m[4] * t[0] + m[5] * t[2] + t[4],
            m[4] * t[1] + m[5] * t[3] + t[5],
        )

    return F.aggregate(matrices, identity, times)


def ordered_choice(df: DataFrame, lookups: list[tuple[DataFrame, str]], key: str, out: str) -> DataFrame:
    """The value of the first look-up table (key, value column) that knows the key: left joins and a coalesce."""
    values = []
    for i, (table, column) in enumerate(lookups):
        df = df.join(table.select(key, F.col(column).alias(f"_choice{i}")), key, "left")
        values.append(f"_choice{i}")
    return df.withColumn(out, F.coalesce(*values)).drop(*values)


def utf16_hex(text: Column) -> Column:
    """UTF-16BE code units in upper-case hexadecimal."""
    return F.hex(F.encode(text, "UTF-16BE"))


def subset_tag(ids: Column) -> Column:
    """Six letters that name a set of glyph ids: an ordered 32-bit FNV-1a fold, five bits apart."""
    prime, mask = F.lit(16777619), F.lit(0xFFFFFFFF)
    seed = F.lit(2166136261).cast("long")
    h = F.aggregate(ids, seed, lambda acc, g: (acc.bitwiseXOR(g.cast("long")) * prime).bitwiseAND(mask))
    return F.concat(*[F.char(F.lit(65) + F.pmod(F.shiftright(h, 5 * i), F.lit(26)).cast("int")) for i in range(6)])
