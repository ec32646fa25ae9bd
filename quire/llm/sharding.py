"""Sharding by vector bin packing.

Every group of equal texts is a vector of (bytes, tokens, rows). Groups are
taken largest first and each goes to the shard where the dot product of its
vector with the shard's residual capacity is highest, so that the three sums
grow together.

Scale: groups that hold more than ``LARGE_SHARE`` of a shard's bytes or rows
are few by definition (at most ``shards / LARGE_SHARE`` for each measure) and
are packed first, in one step, each whole among the shards that have room for
its bytes and rows. The one exception to whole groups: where no shard has that
room (a third of all rows, say, or a group when others have filled the shards),
the group is cut into even pieces of at most ``LARGE_SHARE``, as sizes could not
be near equal otherwise. All other groups are dealt by hash to blocks of about
``BLOCK_GROUPS`` groups, and each block packs its own into shares of what the
shards still lack, of tokens and rows no further from the share of bytes than
``APART``: even within each block, hence even in sum. No task ever sees more than a block.

Law: ``bytes`` - the shards' sizes (UTF-8 bytes of the text plus 8) are near
equal. Tokens are estimated: letters by up to eight, digits by up to three, signs
one by one, so that scripts without blanks count, too. Null texts count as empty
and form one group. Rows that share an id, or have none, are rows like others.
Other columns are not read. An empty table gives an empty result; with fewer
groups than shards some shards stay empty. With fewer than ``shards / LARGE_SHARE``
rows no group is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import GROUP_ROWS, cut, numbered, sized, stage

BLOCK_GROUPS = 40_000
#: A group above this share of a shard counts as large; a piece of a cut group has about this share.
LARGE_SHARE = 0.05
#: How far beyond a shard's capacity a whole group may go, in shares of it.
SLACK = 0.002
#: What bytes, tokens and rows weigh in the dot product: bytes are the law.
WEIGHTS = (64.0, 1.0, 1.0)
#: How far a shard's share of the remaining tokens and rows may lie from its share of the remaining bytes.
APART = 0.1
_TOKEN = r"[\p{L}\p{M}]{1,8}|\p{N}{1,3}|[^\s\p{L}\p{M}\p{N}]"


def pack(vectors: np.ndarray, capacity: np.ndarray, turn: int = 0, fits: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each row of ``vectors``, taken in the order given, and the residual capacity.

    ``capacity`` is (shards, measures) and may go below zero. Measures are
    scaled by the mean capacity and weighed first. Equal products go to the shard with
    most room, then to the first one counted from ``turn``. With ``fits``, only
    shards with room in these measures are asked; -1 where there is none.
    """
    scale = np.maximum(np.abs(capacity).mean(axis=0), 1e-9)
    weights = np.sqrt(np.array(WEIGHTS[: capacity.shape[1]]))
    room, items = np.roll(capacity / scale, -turn, axis=0) * weights, vectors / scale * weights
    out = np.empty(len(items), dtype=np.int64)
    for i, v in enumerate(items):
        product = np.round(room @ v, 9)  # equal but for rounding is equal
        if fits is not None:
            product[(room[:, fits] + SLACK < v[fits]).any(axis=1)] = -np.inf  # weighed alike on both sides
        k = int(np.argmax(product))
        if product[k] == -np.inf:
            out[i] = -1 - turn
            continue
        out[i] = k
        room[k] -= v
    out = np.where(out < 0, -1, (out + turn) % len(capacity))
    return out, np.roll(room, turn, axis=0) * scale / weights


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, size, tokens, text_crc32, shard, slot``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.regexp_count(text, F.lit(_TOKEN)).cast("long").alias("tokens"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("group"),
    )
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    measures = ["size", "tokens", "rows"]
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    total = rows.agg(*sums).first()
    n = total["rows"]
    whole = stage(rows.groupBy("group").agg(*sums), "shard-groups")
    is_large = (F.col("size") > LARGE_SHARE * (total["size"] or 0) / shards) | (F.col("rows") > LARGE_SHARE * n / shards)
    # at most 2 * shards / LARGE_SHARE groups are as large as this
    large = whole.where(is_large).toPandas()
    capacity = np.tile(np.array([float(total[k] or 0) for k in measures]) / shards, (shards, 1))
    per = np.maximum(capacity[0], 1.0)
    large["share"] = (large[["size", "rows"]] / per[[0, 2]]).max(axis=1)
    large = large.sort_values(["share", "group"], ascending=[False, True], ignore_index=True)
    cuts = n * LARGE_SHARE >= shards  # else a single row is more than that share
    large["shard"], room = pack(large[measures].to_numpy(float), capacity, fits=[0, 2] if cuts else None)
    kept, cut_up = large[large["shard"] >= 0], large[large["shard"] < 0]
    pieces = [(bytes(g), int(min(r, np.ceil(s / LARGE_SHARE)))) for g, r, s in zip(cut_up["group"], cut_up["rows"], cut_up["share"])]
    found = [(bytes(g), 0, 1, int(s)) for g, s in zip(kept["group"], kept["shard"])]
    if pieces:
        table = F.broadcast(spark.createDataFrame(pieces, "group binary, pieces int"))
        parts = rows.join(table, "group").withColumn("piece", _piece()).groupBy("group", "pieces", "piece").agg(*sums).toPandas()  # some 1 / LARGE_SHARE for each shard's worth
        parts = parts.sort_values(["size", "group", "piece"], ascending=[False, True, True], ignore_index=True)
        parts["shard"], room = pack(parts[measures].to_numpy(float), room)
        found += [(bytes(g), int(i), int(k), int(s)) for g, i, k, s in zip(parts["group"], parts["piece"], parts["pieces"], parts["shard"])]
    # each shard's share of the rest: what it lacks, of tokens and rows near what it lacks in bytes
    lacks = np.maximum(room, 0) / np.maximum(np.maximum(room, 0).sum(axis=0), 1e-9)
    lacks = np.clip(lacks, lacks[:, :1] * (1 - APART), lacks[:, :1] * (1 + APART))
    lacks = lacks / np.maximum(lacks.sum(axis=0), 1e-9)
    blocks = sized(n, BLOCK_GROUPS, 2)

    def pack_block(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "group"], ascending=[False, True])
        group["shard"] = pack(group[measures].to_numpy(float), lacks * group[measures].sum().to_numpy(float), int(group["block"].iloc[0]) * 7 % shards)[0].astype("int32")
        return group[["group", "shard"]]

    small_groups = whole.where(~is_large).withColumn("block", cut(F.col("group"), blocks))
    placed = stage(small_groups.groupBy("block").applyInPandas(pack_block, "group binary, shard int"), "shard-placed")

    known = spark.createDataFrame([(g, k) for g, k in {g: k for g, _, k, _ in found}.items()], "group binary, pieces int")
    first = spark.createDataFrame(found, "group binary, piece int, pieces int, shard int").drop("pieces")
    of_large = rows.join(F.broadcast(known), "group").withColumn("piece", _piece()).join(F.broadcast(first), ["group", "piece"])
    of_small = rows.join(F.broadcast(known), "group", "left_anti").join(placed, "group")
    columns = ["doc_id", "size", "tokens", "text_crc32", "shard", "row"]
    rows = of_large.select(*columns).unionByName(of_small.select(*columns))
    rows = rows.withColumn("part", cut(F.col("row"), sized(n, GROUP_ROWS)))
    return numbered(rows, ["shard"], ["row"], "part", "slot").select("doc_id", "size", "tokens", "text_crc32", "shard", "slot")


def _piece() -> Column:
    return F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int")
