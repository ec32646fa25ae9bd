import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import exact_dedup, sharding
from quire.llm.common import stage
from quire.llm.exact_dedup import duplicate_marks, filter_words, fold_ascii
from quire.llm.exact_dedup import exact_dedup as dedup
from quire.llm.queries import op5_exact_dedup, op9_sharding

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, n=500):
    rnd = random.Random(1)
    texts = [None, "", "Hot copy", "hOT cOPY", "É", "é"] + [f"text {i}" for i in range(150)]
    rows = [(i, texts[2] if i % 3 == 0 else rnd.choice(texts), "x", i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, keep_id string, _q int")


def test_marks_by_brute_force(spark):
    rows, docs = table(spark)
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").translate(FOLD)].append(i)
    got = duplicate_marks(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        g = next(g for g in groups.values() if r["doc_id"] in g)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(g), len(g), r["doc_id"] == max(g))
    left = dedup(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(max(g) for g in groups.values())


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
@pytest.mark.parametrize("words", [1, 1 << 10])
def test_false_positives_and_shuffled_tables_change_nothing(spark, monkeypatch, words, broadcast):
    monkeypatch.setattr(exact_dedup, "filter_words", lambda rows: words)
    monkeypatch.setattr(exact_dedup, "BROADCAST_WORDS", broadcast)
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", broadcast)
    rows, docs = table(spark, 200)
    assert len({r["keep_id"] for r in duplicate_marks(docs).collect()}) == len({(t or "").translate(FOLD) for _, t, *_ in rows}) == dedup(docs).count()


@pytest.mark.parametrize("rows", [2_000, 200_000])
def test_only_possible_repeats_shuffle(spark, rows):
    """The share of rows that the filter lets through follows the repeated ones at any size."""
    hashes = stage(spark.range(rows).select(F.xxhash64(F.col("id") % (rows - rows // 10)).alias("h")), "hashes")
    words = filter_words(rows)
    maybe = exact_dedup.possible_repeats(hashes, "h", stage(exact_dedup.repeated_bits(hashes, "h", words), "filter"), words)
    share = maybe.where("_qb_maybe").count() / rows
    assert 0.2 <= share < 0.21


def test_folding(spark):
    texts = ["ABC xyz [`{@", "É ABC", "İI", "ß K\u212a", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(fold_ascii(F.col("t"))).collect()]
    assert got == [(t or "").translate(FOLD) for t in texts]


def test_the_query_against_a_loop(spark, tmp_path):
    rows, docs = table(spark, 300)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    last = {}
    for i, t, *_ in rows:
        last[(t or "").translate(FOLD)] = i
    for r in op5_exact_dedup(spark, str(tmp_path)).collect():
        t = (rows[r["doc_id"]][1] or "").translate(FOLD)
        assert (r["keep_id"], r["text_sha256"]) == (last[t], hashlib.sha256(t.encode()).hexdigest())


def test_ties_and_nulls(spark):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "c"), (None, "c"), (5, None), (6, "")], schema)
    assert Counter((r["keep_id"], r["group_size"], r["kept"]) for r in duplicate_marks(docs).collect()) == Counter([(1, 3, True), (1, 3, False), (1, 3, False), (1, 1, True), (None, 2, True), (None, 2, False), (6, 2, True), (6, 2, False)])
    assert sorted((r["doc_id"] or 0, r["text"]) for r in dedup(docs).collect()) == [(0, "c"), (1, "a"), (1, "b"), (6, "")]
    assert duplicate_marks(docs.limit(0)).count() == dedup(docs.limit(0)).count() == 0
    assert filter_words(0) == exact_dedup.MIN_WORDS and filter_words(10**12) >= 10**12 // 2


def test_packing():
    rng = np.random.default_rng(0)
    items = np.sort(rng.integers(1, 100, (2000, 3)), axis=0)[::-1].astype(float)
    capacity = np.tile(items.sum(axis=0) / 8, (8, 1))
    where, room = sharding.pack(items, capacity)
    filled = np.array([items[where == k].sum(axis=0) for k in range(8)])
    assert np.allclose(filled + room, capacity) and (np.ptp(filled, axis=0) / filled.mean(axis=0) < 0.01).all()


def shard_table(spark, n=4000, hot="the hot text of a third of all rows"):
    rnd = random.Random(2)
    texts = [" ".join("w" * rnd.randint(1, 9) for _ in range(rnd.randint(0, 60))) for _ in range(1500)] + [None, "é" * 400]
    rows = [(i, hot if i % 3 == 0 else "some copies" if i % 40 == 1 else rnd.choice(texts), "s") for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, shard string")


@pytest.mark.parametrize("block", [1000, 40_000])
def test_shards(spark, monkeypatch, block):
    monkeypatch.setattr(sharding, "BLOCK_GROUPS", block)
    monkeypatch.setattr(sharding, "GROUP_ROWS", 300)
    rows, docs = shard_table(spark)
    got = sharding.shard_documents(docs, 24).collect()
    text = {i: (t or "").encode() for i, t, _ in rows}
    assert len(got) == len(rows) and all(r["size"] == len(text[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) for r in got)
    sizes, counts, where, slots = Counter(), Counter(), defaultdict(set), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        counts[r["shard"]] += 1
        where[text[r["doc_id"]]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert set(sizes) == set(range(24)) and max(sizes.values()) / min(sizes.values()) < 1.02 and max(counts.values()) / min(counts.values()) < 1.6
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # only the group that no shard could hold is cut; that of 2.5 % of all rows, over half a shard, is whole
    assert [t for t, s in where.items() if len(s) > 1] == [b"the hot text of a third of all rows"]


def by_hand(spark, rows, shards):
    """The packing as plain loops: shard of each text."""
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    signs = spark.createDataFrame([(t,) for t in groups], "t string").select("t", F.unhex(F.sha2("t", 256)).alias("g"), F.regexp_count("t", F.lit(sharding._TOKEN)).alias("k"))
    blocks = max(2, -(-len(rows) // sharding.BLOCK_GROUPS))
    info = {r["t"]: (bytes(r["g"]), r["k"], r["b"]) for r in signs.select("t", "g", "k", F.pmod(F.xxhash64("g"), F.lit(blocks)).alias("b")).collect()}
    vector = {t: [len(ids) * (len(t.encode()) + 8), len(ids) * info[t][1], len(ids)] for t, ids in groups.items()}
    total = [sum(v[m] for v in vector.values()) for m in range(3)]
    assert all(v[0] <= total[0] / shards * 0.05 and v[2] <= total[2] / shards * 0.05 for v in vector.values())
    out = {}
    for b in range(blocks):
        mine = sorted((t for t in vector if info[t][2] == b), key=lambda t: (-vector[t][0], info[t][0]))
        turn = b * 7 % shards
        order = [(turn + k) % shards for k in range(shards)]
        # room in units of the mean room, all alike at first
        mean = [sum(vector[t][m] for t in mine) / shards for m in range(3)]
        room = {k: [1.0, 1.0, 1.0] for k in order}
        for t in mine:
            v = [vector[t][m] / mean[m] for m in range(3)]
            best = max(order, key=lambda k: (round(sum(w * x * y for w, x, y in zip(sharding.WEIGHTS, room[k], v)), 9), -order.index(k)))
            out[t] = best
            room[best] = [x - y for x, y in zip(room[best], v)]
    return out


def test_placement_by_brute_force(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join("abcdefgh"[: rnd.randint(1, 8)] for _ in range(rnd.randint(1, 40)))) for i in range(3000)]
    want = by_hand(spark, rows, 4)
    text = dict(rows)
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sum(want[text[r["doc_id"]]] == r["shard"] for r in got) > 0.99 * len(rows)  # ties by rounding
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) / min(sizes.values()) < 1.01


def test_one_id_for_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUP_ROWS", 100)
    rows, _ = shard_table(spark, 2000)
    docs = spark.createDataFrame([(None if i % 3 == 0 else 5, t) for i, t, _ in rows], "doc_id long, text string")
    got = sharding.shard_documents(docs, 8).collect()
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert len(got) == 2000 and all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(sizes.values()) / min(sizes.values()) < 1.03


def test_the_shard_query(spark, tmp_path):
    shard_table(spark, 600)[1].write.parquet(f"{tmp_path}/documents.parquet")
    got = op9_sharding(spark, str(tmp_path)).collect()
    assert len({r["doc_id"] for r in got}) == 600 and {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None} and {r["shard"] for r in got} <= set(range(24))


def test_few_rows(spark):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(1, "a"), (2, None), (2, ""), (None, "b" * 10_000)], schema)
    got = sharding.shard_documents(docs, 24).collect()
    assert len(got) == 4 and len({r["shard"] for r in got if r["size"] == 8}) == 1
    assert sharding.shard_documents(docs.limit(0), 24).count() == 0
