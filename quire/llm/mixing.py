"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form a stream of blocks of ``block_bytes``. With weight
w, block k of a source is released at floor(k / w) and due at ceil((k + 1) / w);
slots go to the released block with the earliest deadline. On one sequence this
meets every deadline, so at any slot each source has been served its weight's
share to within less than one block.

Weights are taken as the exact ratios that they are. The driver runs through the
blocks (not the documents) and keeps slot, release and deadline of each; these
are joined to the documents in arrays of ``CHUNK`` blocks. Blocks have
``BLOCK_BYTES``, and in a corpus of more than ``BLOCKS`` of these a
``BLOCKS``-th of it, so the schedule's size has a bound: one deviates by less than
a millionth of the corpus then. It holds a row a source besides; sources are
meant to be up to some thousand. When a source runs out, a new phase begins with the weights of
those left; nothing is dropped or repeated. Only where a period L is asked for
are weights rounded to multiples of 1/L (largest remainders).

A document belongs to the block in which its first byte lies, in an order of
its source that is random (by hash) but fixed; one longer than a block leaves
the blocks that it covers empty, so shares are shares of bytes.

Defined results: other columns pass through ``mix``. A null source counts as ''; a null text has one byte, as every
document gets one for its end. Sources without a positive weight follow after
all others, by size. Rows equal in id are ordered by a hash of their text (``copy``, if at hand). An empty table gives
an empty result.
"""

from __future__ import annotations

import heapq
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import numbered, piece_sums, sized, small, stage

BLOCK_BYTES, BLOCKS, CHUNK = 1 << 16, 1 << 20, 1024
#: A source's documents are ordered in pieces; all sources together fill one with about this many rows.
PIECE_ROWS = 4096
#: Rows of the schedule up to this are broadcast (``CHUNK`` blocks each), more are joined by shuffle.
BROADCAST_CHUNKS = 10_000


@dataclass
class Phase:
    """Blocks ``first[s]`` up to ``first[s] + served[s]`` of each source, from slot ``base`` on.

    A source's weight is ``units[s] / period``; slots, releases and deadlines count from ``base``.
    """

    base: int
    period: int
    units: dict[str, int]
    slots: dict[str, array]
    releases: dict[str, array]
    deadlines: dict[str, array]
    first: dict[str, int]
    served: dict[str, int]

    def slot(self, source: str, block: int) -> int:
        return self.base + self.slots[source][block - self.first[source]]


def exact(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in the very ratios of the weights; their sum is the period."""
    ratios = {s: Fraction(w) for s, w in weights.items()}
    common = lcm(*(r.denominator for r in ratios.values()))
    return {s: int(r * common) for s, r in ratios.items()}


def rounded(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole units of 1/period for each weight, at least one each, ``period`` in all."""
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    units = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (units[s] - exact[s], s))
    while (left := period - sum(units.values())) > 0:
        for s in order[:left]:
            units[s] += 1
    while sum(units.values()) > period:
        units[max(units, key=lambda s: (units[s] - exact[s], units[s], s))] -= 1
    return units


def slots_of(units: dict[str, int], period: int) -> Iterator[tuple[str, int, int]]:
    """Source, release and deadline of the block in each slot: earliest deadline first among released blocks."""
    waiting = [(0, s, 0) for s in units]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    t = 0
    while True:
        while waiting and waiting[0][0] <= t:
            release, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // units[s]), s, k, release))
        deadline, s, k, release = heapq.heappop(ready)  # as the units fill the period, a block is ready in every slot
        yield s, release, deadline
        heapq.heappush(waiting, ((k + 1) * period // units[s], s, k + 1))
        t += 1


def one_period(units: dict[str, int], period: int) -> list[str]:
    """The source of each slot of a period."""
    return [s for _, (s, _, _) in zip(range(period), slots_of(units, period))]


def schedule(blocks: dict[str, int], weights: dict[str, float], period: int | None = None) -> list[Phase]:
    """Phases that serve all ``blocks``; each ends when a source runs out and names the sources that it serves."""
    given = exact({s: w for s, w in weights.items() if w > 0})
    by_size = {s: n for s, n in blocks.items() if n > 0}
    left, done = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0)
    base, phases = 0, []
    while left:
        live = {s: weights[s] for s in left if weights.get(s, 0) > 0} or {s: float(blocks[s]) for s in left}
        if period is None:
            units = {s: (given if s in given else by_size)[s] for s in live}
        else:
            units = rounded(live, max(period, 1 << (4 * len(live) - 1).bit_length()))
        length = sum(units.values())
        slots, releases, deadlines = (defaultdict(lambda: array("q")) for _ in range(3))
        end = 0
        for s, release, deadline in slots_of(units, length):
            if len(slots[s]) == left[s]:
                break  # its last block was served before
            slots[s].append(end)
            releases[s].append(release)
            deadlines[s].append(min(deadline, 1 << 62))
            end += 1
        served = {s: len(x) for s, x in slots.items()}
        phases.append(Phase(base, length, {s: units[s] for s in served}, slots, releases, deadlines, {s: done[s] for s in served}, served))
        base += end
        for s, n in served.items():
            done[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
    return phases


def target_weights(sizes: dict[str, int], temperature: float) -> dict[str, float]:
    """Weights in proportion to size ** temperature: 1 keeps the natural shares, 0 makes them equal."""
    powers = {s: max(n, 1) ** temperature for s, n in sizes.items()}
    return {s: p / sum(powers.values()) for s, p in powers.items()}


def text_bytes(text_col: str) -> Column:
    return (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long")


def with_slots(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, block_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None, copy: Column | None = None) -> DataFrame:
    """``docs`` with ``_qm_source, _qm_bytes, _qm_start, _qm_block, _qm_phase, _qm_release, _qm_deadline, _qm_slot``."""
    spark = docs.sparkSession
    size = text_bytes(text_col) if size is None else size
    rows = docs.withColumns({"_qm_source": F.coalesce(F.col(source_col).cast("string"), F.lit("")), "_qm_bytes": size, "_qm_order": F.xxhash64(id_col, F.lit(11)), "_qm_text": F.xxhash64(text_col) if copy is None else copy})
    rows = rows.withColumn("_qm_piece", F.pmod(F.xxhash64(id_col, "_qm_text"), F.lit(sized(docs.count(), PIECE_ROWS))))
    sums = piece_sums(rows, ["_qm_source"], "_qm_piece", F.col("_qm_bytes"))
    sizes = {r[0]: r[1] for r in sums.groupBy("_qm_source").agg(F.sum("_qn_s")).collect()}  # a row a source
    block_bytes = block_bytes or max(BLOCK_BYTES, sized(sum(sizes.values()), BLOCKS))
    rows = numbered(rows, ["_qm_source"], ["_qm_order", id_col, "_qm_text"], "_qm_piece", "_qm_start", F.col("_qm_bytes"), sums)
    rows = rows.withColumn("_qm_block", F.floor(F.col("_qm_start") / block_bytes))
    phases = schedule({s: -(-n // block_bytes) for s, n in sizes.items()}, target_weights(sizes, temperature) if weights is None else weights)
    plan, chunks = _plan(spark, phases)
    if chunks <= BROADCAST_CHUNKS:
        plan = F.broadcast(plan)
    on = (F.col("_qm_source") == F.col("_qp_source")) & (F.floor(F.col("_qm_block") / CHUNK) == F.col("_qp_chunk"))
    rows = rows.join(plan, on & (F.col("_qm_block") >= F.col("_qp_from")) & (F.col("_qm_block") < F.col("_qp_to")))
    at = "[cast(_qm_block - _qp_from as int)]"
    found = {f"_qm_{k}": F.expr(f"_qp_base + _qp_{k}{at}") for k in ("release", "deadline", "slot")}
    return rows.withColumns(found).drop("_qm_order", "_qm_piece", "_qm_text", *plan.columns[1:])


def _plan(spark: SparkSession, phases: list[Phase]) -> tuple[DataFrame, int]:
    """The schedule in rows of up to ``CHUNK`` blocks of one source and phase, and how many rows there are."""
    rows = []
    for i, p in enumerate(phases):
        for s, first in p.first.items():
            at, end = first, first + p.served[s]
            while at < end:
                to = min(end, (at // CHUNK + 1) * CHUNK)
                rows.append((i, s, at // CHUNK, at, to, p.base, *(x[s][at - first : to - first].tolist() for x in (p.releases, p.deadlines, p.slots))))
                at = to
    names = ["_qm_phase", "_qp_source", "_qp_chunk", "_qp_from", "_qp_to", "_qp_base", "_qp_release", "_qp_deadline", "_qp_slot"]
    types = [pa.int32(), pa.string(), *[pa.int64()] * 4, *[pa.list_(pa.int64())] * 3]
    columns = list(zip(*rows)) or [()] * len(names)
    return spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names)), len(rows)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, block_bytes: int | None = None, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """All of ``docs``, in the schedule's order: its partitions hold consecutive slots, sorted.

    ``keep`` names columns of ``with_slots`` to return as well; (``_qm_slot``, ``_qm_start``) is the order.
    """
    rows = with_slots(docs, weights, temperature, block_bytes)
    parts = max(2, sized(docs.count(), 10_000))
    return rows.repartitionByRange(parts, "_qm_slot").sortWithinPartitions("_qm_slot", "_qm_start").select(*docs.columns, *keep)


def mixture(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, block_bytes: int | None = None) -> DataFrame:
    """One row per document: ``doc_id, source, bytes, start, block, phase, release, deadline, slot``."""
    narrow = stage(docs.select("doc_id", "source", F.xxhash64("text").alias("text"), text_bytes("text").alias("n")), "mix-rows")
    rows = with_slots(narrow, weights, temperature, block_bytes, size=F.col("n"), copy=F.col("text"))
    return rows.select("doc_id", F.col("_qm_source").alias("source"), F.col("_qm_bytes").alias("bytes"), F.col("_qm_start").alias("start"), F.col("_qm_block").alias("block"), F.col("_qm_phase").alias("phase"), F.col("_qm_release").alias("release"), F.col("_qm_deadline").alias("deadline"), F.col("_qm_slot").alias("slot"))


def places(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, block_bytes: int | None = None) -> DataFrame:
    """``docs`` with ``_qm_slot, _qm_start``, their order in the mixture, without moving texts.

    The schedule is worked out on ids, hashes and sizes and joined to the
    documents: by broadcast where their count allows, else by a shuffle. Only
    rows equal in id and text, which a join could not tell apart, make it
    order the documents themselves.
    """
    keys = [F.col("doc_id").alias("_qm_id"), F.xxhash64("text").alias("_qm_copy")]
    narrow = docs.select(*keys, F.col("source").alias("_qm_of"), text_bytes("text").alias("_qm_n"))
    narrow = stage(narrow, "mix-rows")
    if not narrow.groupBy("_qm_id", "_qm_copy").count().where("count > 1").isEmpty():
        order = ["_qm_slot", "_qm_start"]
        return mix(docs, weights, temperature, block_bytes, keep=order)
    found = with_slots(narrow, weights, temperature, block_bytes, id_col="_qm_id", text_col="_qm_copy", source_col="_qm_of", size=F.col("_qm_n"), copy=F.col("_qm_copy"))
    found = stage(found.select("_qm_id", "_qm_copy", "_qm_slot", "_qm_start"), "mix-places")
    same = F.col("doc_id").eqNullSafe(F.col("_qm_id")) & (F.xxhash64("text") == F.col("_qm_copy"))
    return docs.join(small(found), same).select(*docs.columns, "_qm_slot", "_qm_start")
