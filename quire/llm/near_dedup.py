"""Near-duplicate classes by DartMinHash signatures and banded joining.

A document is the multiset of its shingles (five consecutive words, lower-cased
runs of word characters). DartMinHash throws darts: each unit of an element's
weight has its own Poisson process of hashed darts along a rank axis, the same
in every document that holds the unit. A document looks at the darts below the
rank at which about ``K * (ln K + 4)`` of them lie inside its weighted elements
and keeps the earliest dart of each of ``K`` coordinates; two documents agree
in a coordinate with probability equal to their weighted Jaccard similarity.
The cost is a hash for every unit and some work for every dart, however long
the document. A coordinate left empty sends the rank limit up until none is.

``BANDS`` bands of ``ROWS`` coordinates make buckets (a pair of similarity 0.8
meets in none with probability 6e-5). Documents with equal word sequences are
one node from the start. Within a bucket no pairs are listed: its nodes are
compared to one leader, exactly, on their shingles, and links at ``THRESHOLD``
or above join components. ``ROUNDS`` rounds with different leaders collapse
what is alike. Where a bucket still spans several components, its nodes
outside the largest one are compared to all its nodes of fitting size, exactly,
in blocks of bounded size whose only output are links; so no link is lost to the
choice of leaders. What is compared are 32 bits of each shingle's hash, which
moves a similarity by less than one in 10,000 for texts of up to 400,000 words.
Blocks are as many as a bucket's nodes of like size squared over ``BLOCK``
squared: texts of similarity s to each other meet in a band's bucket with
probability s ** ``ROWS``, 5 % at 0.6. Every other step is a join or an aggregation that combines before its
shuffle, and only counts come to the driver.

Defined results: a text of one to four words is one shingle of all of them; a
null text or one without words is a class of its own row. The smallest doc_id
of a class stays (nulls last; equal ids by the hash of their text); rows equal in id
and text count as copies, all marked alike, and ``near_dedup`` keeps one. Extra columns pass through ``near_dedup``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import BROADCAST_ROWS, drop, give_back, small, stage, trimmed
from quire.llm.splitting import WordCache

SHINGLE, THRESHOLD, BANDS, ROWS, ROUNDS = 5, 0.8, 32, 6, 2
K = BANDS * ROWS
#: Nodes on each side of a block, and shared units that its product holds at once.
BLOCK, _COLUMNS = 512, 4096
_WORD = re.compile(r"\w+")
_U = np.uint64
_FACTORS = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_HASHES = WordCache(lambda words: [xxhash.xxh3_64_intdigest(w) for w in words], 200_000)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def weighted_units(elements: np.ndarray) -> np.ndarray:
    """A hash for each unit of weight: the n-th occurrence of an element differs from the others."""
    e = np.sort(elements)
    again = np.flatnonzero(e[1:] == e[:-1]) + 1
    if len(again):
        at = np.arange(len(e))
        start = at.copy()
        start[again] = 0
        e = e + (at - np.maximum.accumulate(start)).astype(_U) * _FACTORS[0]
    return mix(e)


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.fill(words), words), _U, len(words))


def shingle_units(words: list[str]) -> np.ndarray:
    """The units of a document's shingles."""
    h = word_hashes(words)
    if not len(h):
        return h
    n = max(1, len(h) - SHINGLE + 1)
    s = np.zeros(n, _U)
    for k in range(min(SHINGLE, len(h))):
        s += h[k : k + n] * _FACTORS[k]
    return weighted_units(mix(s))


def dart_signature(units: np.ndarray, k: int = K) -> np.ndarray:
    """The earliest dart of each of ``k`` coordinates."""
    darts = k * (log(k) + 4)
    while True:
        limit = darts / len(units)
        unit, rank = units, np.zeros(len(units))
        ids: list[np.ndarray] = []
        ranks: list[np.ndarray] = []
        throw = 0
        # a few throws at a time for each unit that is still below the limit
        step = max(1, int(limit + 4 * sqrt(limit))) if limit > 3 else 1
        while len(unit):
            n = np.arange(throw + 1, throw + step + 1, dtype=_U) * _FACTORS[1]
            dart = mix(unit[:, None] + n)
            gap = -np.log(((mix(dart ^ _FACTORS[2]) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)
            at = rank[:, None] + np.cumsum(gap, axis=1)
            hit = at < limit
            ids.append(dart[hit])
            ranks.append(at[hit])
            live = hit[:, -1]
            unit, rank, throw = unit[live], at[live, -1], throw + step
        dart, at = np.concatenate(ids), np.concatenate(ranks)
        out = np.zeros(k, _U)
        filled = np.zeros(k, bool)
        order = np.argsort(-at, kind="stable")
        coordinate = (dart[order] % _U(k)).astype(np.int64)
        out[coordinate] = dart[order]  # the last written, the earliest dart, stays
        filled[coordinate] = True
        if filled.all():
            return out
        darts *= 2


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, ROWS)
    h = np.arange(BANDS, dtype=_U) * _FACTORS[3]
    for r in range(ROWS):
        h = mix(h * _FACTORS[4] + rows[:, r])
    return h.view(np.int64)


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two documents from their packed units."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    both = np.concatenate([x, y])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (len(both) - common)


def _content_key(words: list[str]) -> bytes | None:
    return xxhash.xxh3_128_digest(" ".join(words)) if words else None


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, copy, text) -> (doc_id, copy, key, total, bands)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            keys, totals, bands = [], [], []
            for text in part.column(2).to_pylist():
                words = words_of(text)
                units = shingle_units(words)
                keys.append(_content_key(words))
                totals.append(len(units))
                bands.append(band_keys(dart_signature(units)) if words else [])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array(totals, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "copy", "key", "total", "bands"])


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, key) -> (key, units): distinct, sorted, packed to 32 bits, of the rows whose text has that key."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            keys, units = [], []
            for text, key in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                words = words_of(text)
                if _content_key(words) == key:
                    keys.append(key)
                    units.append(np.unique((shingle_units(words) >> _U(32)).astype(np.uint32)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(units, pa.binary())], ["key", "units"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, units of a, units of b) -> the pairs at or above the threshold."""
    for batch in batches:
        keep = [similarity(x, y) >= THRESHOLD for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], ["a", "b"])


def _near_in_size(a: Column, b: Column) -> Column:
    """Necessary for the threshold: the weighted Jaccard similarity is at most the ratio of the totals."""
    return F.least(a, b) >= F.greatest(a, b) * THRESHOLD


def _verified(pairs: DataFrame, units: DataFrame) -> DataFrame:
    a = units.select(F.col("key").alias("a"), F.col("units").alias("ua"))
    b = units.select(F.col("key").alias("b"), F.col("units").alias("ub"))
    return stage(pairs.join(a, "a").join(b, "b").select("a", "b", "ua", "ub").mapInArrow(lambda batches: trimmed(_linked(batches)), "a binary, b binary"), "near-links")


def components(edges: DataFrame) -> DataFrame:
    """(u, label) of each node of ``edges`` (a, b): the least node of its component; a staged table.

    Label propagation with pointer jumping: rounds in the logarithm of the
    longest path, each a join and a pre-aggregated minimum, written out.
    """
    both = stage(edges.union(edges.select("b", "a")).distinct().toDF("u", "v"), "near-edges")
    labels = stage(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), "near-labels")
    hint = F.broadcast if labels.count() <= BROADCAST_ROWS else lambda df: df  # as many labels in every round
    while True:
        heard = both.join(hint(labels.select(F.col("u").alias("v"), "label")), "v").groupBy("u").agg(F.min("label").alias("heard"))
        better = heard.join(hint(labels.select("u", "label")), "u").select("u", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        up = hint(labels.select(F.col("u").alias("label"), F.col("label").alias("above")))
        jumped = better.join(up, "label", "left").select("u", "old", F.least("label", F.coalesce("above", "label")).alias("label"))
        held = stage(jumped, "near-labels")
        drop(labels)
        labels = held
        if held.where("old <> label").isEmpty():
            drop(both)
            return held


def _joined(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` (key, comp) after its components are joined along ``links`` (a, b)."""
    if links.isEmpty():
        return nodes
    hint = F.broadcast if nodes.count() <= BROADCAST_ROWS else lambda df: df
    a, b = hint(nodes.toDF("a", "ca")), hint(nodes.toDF("b", "cb"))
    edges = links.join(a, "a").join(b, "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    found = components(edges)
    comp = found.select(F.col("u").alias("comp"), F.col("label").alias("_new"))
    joined = stage(nodes.join(hint(comp), "comp", "left").select("key", F.coalesce("_new", "comp").alias("comp")), "near-nodes")
    drop(found, links, nodes)
    return joined


def _leader_pairs(members: DataFrame, turn: int) -> DataFrame:
    """Each member with the bucket's leader of this turn, if their components differ."""
    pick = F.min(F.struct(F.xxhash64("key", F.lit(turn)).alias("h"), F.col("key"), F.col("total"), F.col("comp"))).alias("lead")
    lead = members.groupBy("bucket").agg(pick, F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("bucket", "lead")
    pairs = members.join(lead, "bucket").where((F.col("comp") != F.col("lead.comp")) & _near_in_size(F.col("total"), F.col("lead.total")))
    return pairs.select(F.col("key").alias("a"), F.col("lead.key").alias("b")).distinct()


def _block_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the block's outsiders (side 0) and its members (side 1) of other components, one per pair of components.

    The common units of all pairs come from a product of two zero-one matrices,
    built for some thousand shared units at a time.
    """
    left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
    if not len(left) or not len(right):
        return pd.DataFrame({"a": [], "b": []})
    held = [np.frombuffer(u, np.uint32) for u in [*left["units"], *right["units"]]]
    size = np.array([len(u) for u in held], np.float64)
    owner = np.repeat(np.arange(len(held)), size.astype(np.int64))
    _, unit, uses = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
    shared = uses > 1
    number = np.cumsum(shared) - 1
    live = shared[unit]
    owner, column = owner[live], number[unit[live]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(left), len(right)), np.float64)
    for first in range(0, int(shared.sum()), _COLUMNS):
        a, b = np.searchsorted(column, [first, first + _COLUMNS])
        ones = np.zeros((len(held), _COLUMNS), np.float32)
        ones[owner[a:b], column[a:b] - first] = 1
        common += ones[: len(left)] @ ones[len(left) :].T
    every = size[: len(left), None] + size[None, len(left) :] - common
    x, y = left["comp"].to_numpy(), right["comp"].to_numpy()
    i, j = np.nonzero((common >= THRESHOLD * every - 1e-9) & (x[:, None] != y[None, :]))
    del held, common, every
    give_back()
    out = pd.DataFrame({"a": left["key"].to_numpy()[i], "b": right["key"].to_numpy()[j], "x": x[i], "y": y[j]})
    return out.drop_duplicates(["x", "y"])[["a", "b"]]


def _rest_links(members: DataFrame, units: DataFrame) -> DataFrame:
    """All links between components that share a bucket: its nodes outside the largest component against all its nodes.

    Both sides are cut into chunks of about ``BLOCK`` nodes and each pair of
    chunks is compared as a block; no pair is a row. In a bucket of several
    chunks, these hold nodes of like size, and as a link needs sizes within the
    threshold's ratio, a chunk meets those of its own and the next size classes.
    """
    of_size = F.floor(F.log("total") / -log(THRESHOLD)).cast("int")
    counts = stage(members.groupBy("bucket", "comp", of_size.alias("of_size")).agg(F.count(F.lit(1)).alias("n")), "near-counts")
    mixed = counts.groupBy("bucket", "comp").agg(F.sum("n").alias("n")).groupBy("bucket")
    mixed = mixed.agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    mixed = mixed.select("bucket", F.col("top.comp").alias("major"), (F.col("all") > BLOCK).alias("large"))
    size = F.when(F.col("large"), F.col("of_size")).otherwise(0)
    chunk = lambda n: F.ceil(F.sum(n) / BLOCK).cast("int")
    chunks = counts.join(mixed, "bucket").groupBy("bucket", "major", "large", size.alias("size"))
    chunks = chunks.agg(chunk(F.col("n")).alias("all"), chunk(F.when(F.col("comp") != F.col("major"), F.col("n")).otherwise(0)).alias("outside"))
    # a row for each size class of a bucket, some dozens
    chunks = stage(chunks.groupBy("bucket", "major", "large").agg(F.map_from_entries(F.collect_list(F.struct("size", F.struct("all", "outside")))).alias("chunks")), "near-chunks")
    rows = members.withColumn("of_size", of_size).join(small(chunks), "bucket").withColumns({"size": size, "out": F.col("comp") != F.col("major")}).join(units, "key")
    h = F.xxhash64("key")
    near = F.filter(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.col("size") + d), lambda c: F.map_contains_key("chunks", c))
    number = lambda c, kind: F.try_element_at(F.col("chunks"), c)[kind]
    upto = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda x: x < n)
    place = lambda a, i, b, j, side: F.struct(a.alias("a"), i.cast("int").alias("i"), b.alias("b"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    size = F.col("size")
    as_left = F.flatten(F.transform(near, lambda c: F.transform(upto(number(c, "all")), lambda j: place(size, F.pmod(h, number(size, "outside")), c, j, 0))))
    as_right = F.flatten(F.transform(near, lambda c: F.transform(upto(number(c, "outside")), lambda i: place(c, i, size, F.pmod(h, number(size, "all")), 1))))
    none = F.array().cast("array<struct<a:int,i:int,b:int,j:int,side:int>>")
    blocks = rows.select("bucket", "key", "comp", "units", F.explode(F.concat(F.when(F.col("out"), as_left).otherwise(none), as_right)).alias("p"))
    blocks = blocks.select("bucket", "p.*", "key", "comp", "units")
    return stage(blocks.groupBy("bucket", "a", "i", "b", "j").applyInPandas(_block_links, "a binary, b binary"), "near-links")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, class_id`` (smallest doc_id of its class), ``class_size, kept``."""
    return _classes(docs, id_col, text_col).drop("copy")


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    signed = stage(rows.mapInArrow(lambda batches: trimmed(_sign(batches)), f"doc_id {kind}, copy long, key binary, total long, bands array<long>"), "near-signed")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")
    nodes = signed.where("key is not null").groupBy("key").agg(F.min(order).alias("one"), F.first("total").alias("total"), F.first("bands").alias("bands"))
    members = nodes.select("key", "one", "total", F.explode("bands").alias("bucket"))
    shared = stage(members.groupBy("bucket").count().where("count > 1").select("bucket"), "near-shared")
    staged_members = members = stage(members.join(small(shared), "bucket"), "near-members")

    # a node's text is that of one row: (doc_id, copy), as many rows may share an id or have none
    wanted = stage(members.select("key", F.col("one.doc_id").alias("_id"), F.col("one.copy").alias("_copy")).distinct(), "near-wanted")
    texts = rows.join(small(wanted), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy"))).select("text", "key")
    units = stage(texts.mapInArrow(lambda batches: trimmed(_unit_rows(batches)), "key binary, units binary").dropDuplicates(["key"]), "near-units")
    held = stage(wanted.select("key", F.col("key").alias("comp")), "near-nodes")
    members = members.select("bucket", "key", "total")

    drop(shared, wanted)
    for turn in range(ROUNDS):
        held = _joined(held, _verified(_leader_pairs(members.join(small(held), "key"), turn), units))
    held = _joined(held, _rest_links(members.join(small(held), "key"), units))
    drop(staged_members, units)

    # the least (doc_id, copy) of a class tells the row that stays even where a doc_id occurs with several texts
    classes = signed.select("doc_id", "copy", "key").join(held, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    seen = classes.where("comp is not null")
    least = stage(seen.groupBy("comp").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("class_size")).where("class_size > 1"), "near-least")
    own = order == F.coalesce("least", order)  # a class of one row is not in the table
    marked = seen.join(small(least), "comp", "left").select("doc_id", "copy", F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), own.alias("kept"))
    alone = classes.where("comp is null").select("doc_id", "copy", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return marked.unionByName(alone)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each class, with its columns."""
    names = docs.columns
    marks = stage(_classes(docs, id_col, text_col), "near-classes")
    same = F.col(id_col).eqNullSafe(F.col("_qd_id")) & (F.xxhash64(text_col) == F.col("_qd_copy"))
    ids = [F.col("doc_id").alias("_qd_id"), F.col("copy").alias("_qd_copy")]
    drop = stage(marks.where("not kept").select(*ids).distinct(), "near-drop")
    rows = docs.join(small(drop), same, "left_anti")
    twice = stage(marks.where("kept and class_size > 1").groupBy(*ids).count().where("count > 1").drop("count"), "near-twice")
    if twice.isEmpty():
        return rows.select(*names)
    repeated = rows.join(small(twice), same, "left_semi").dropDuplicates([id_col, text_col])
    return rows.join(small(twice), same, "left_anti").select(*names).unionByName(repeated.select(*names))
