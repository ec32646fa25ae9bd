import random

import pytest

from quire.llm.mixing import BLOCK_BYTES, mix, mixture, one_period, places, rounded, schedule, target_weights
from quire.llm.queries import op3_mixing


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1.0}, {str(i): 1 + i * i for i in range(30)}])
def test_less_than_one_block_off(weights):
    units = rounded(weights, 1024)
    assert sum(units.values()) == 1024 and min(units.values()) >= 1
    served = dict.fromkeys(units, 0)
    for t, s in enumerate(one_period(units, 1024)):
        k = served[s]
        assert k * 1024 // units[s] <= t < -(-(k + 1) * 1024 // units[s])
        served[s] += 1
        assert all(abs(served[x] - (t + 1) * units[x] / 1024) < 1 for x in units)
    assert served == units


@pytest.mark.parametrize("seed", range(5))
def test_every_block_has_its_own_slot(seed):
    rnd = random.Random(seed)
    blocks = {f"s{i}": rnd.randint(0, 3000) for i in range(8)}
    weights = {s: rnd.random() for s in list(blocks)[:6]}
    phases = schedule(blocks, weights, 256)
    taken = [p.slot(s, b) for p in phases for s in p.first for b in range(p.first[s], p.first[s] + p.served[s])]
    assert sorted(taken) == list(range(sum(blocks.values())))
    for p in phases:  # within a phase no source is ahead or behind by a block
        order = sorted((p.slot(s, b), s) for s in p.first for b in range(p.first[s], p.first[s] + p.served[s]))
        served = dict.fromkeys(p.first, 0)
        for n, (_, s) in enumerate(order, 1):
            served[s] += 1
            assert all(abs(served[x] - n * p.units[x] / p.period) < 1 for x in served)


def test_target_weights_hold_at_30_gb():
    sizes = {f"s{i}": int(1e9 * 1.3 ** (i - 10)) for i in range(20)} | {"tiny": 70_000}
    weights = target_weights(sizes, 0.5)
    weights["tiny"] = 1e-6
    blocks = {s: -(-n // BLOCK_BYTES) for s, n in sizes.items()}
    assert sum(blocks.values()) > 400_000
    p = schedule(blocks, weights)[0]
    live = sum(weights.values())  # every source is live in the first phase
    for s in p.first:
        w = weights[s] / live
        for k, slot in enumerate(p.slots[s]):  # before and after each of its blocks
            assert abs(k - slot * w) < 1 + 1e-6 and abs(k + 1 - (slot + 1) * w) < 1 + 1e-6
            assert p.releases[s][k] <= slot < p.deadlines[s][k]


def documents(spark, n=400):
    rnd = random.Random(0)
    rows = [(i, "w" * rnd.randint(0, 900) if i % 50 else None, rnd.choice(["a", "a", "a", "b", "c", None]), "x") for i in range(n)] + [(1, "same", "a", "y")] * 2 + [(None, "null", "b", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, slot string")


def test_documents_follow_the_schedule(spark):
    docs = documents(spark)
    weights = {"a": 0.2, "b": 0.5, "c": 0.3}
    got = mixture(docs, weights, block_bytes=1000).collect()
    assert len(got) == docs.count()
    sizes, by = {}, {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
    for s, rows in by.items():
        at = 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at and r["block"] == at // 1000 and r["release"] <= r["slot"] < r["deadline"]
            at += r["bytes"]
        sizes[s] = at
    phases = schedule({s: -(-n // 1000) for s, n in sizes.items()}, weights)
    for r in got:
        p = phases[r["phase"]]
        assert r["slot"] == p.slot(r["source"], r["block"])
    assert {r["phase"] for r in got if r["source"] == ""} == {max(r["phase"] for r in got)}


def test_the_schedule_is_bounded(spark, monkeypatch):
    monkeypatch.setattr("quire.llm.mixing.BLOCK_BYTES", 100)
    monkeypatch.setattr("quire.llm.mixing.BLOCKS", 50)
    got = mixture(documents(spark)).collect()
    total = sum(r["bytes"] for r in got)
    assert len(got) == 402 + 1 and max(r["slot"] for r in got) < 50 + 4 and all(r["block"] == r["start"] // -(-total // 50) for r in got)


def test_many_sources():
    rnd = random.Random(3)
    blocks = {f"s{i}": rnd.randint(1, 4) for i in range(800)}
    phases = schedule(blocks, target_weights(blocks, 0.5))
    taken = [p.slot(s, b) for p in phases for s in p.first for b in range(p.first[s], p.first[s] + p.served[s])]
    assert sorted(taken) == list(range(sum(blocks.values()))) and sum(len(p.first) for p in phases) <= sum(blocks.values())


@pytest.mark.parametrize("twice", [False, True])
def test_places_are_those_of_the_mixture(spark, monkeypatch, twice):
    monkeypatch.setattr("quire.llm.mixing.PIECE_ROWS", 40)
    docs = documents(spark) if twice else documents(spark).dropDuplicates(["doc_id", "text"])
    want = sorted((str(r["doc_id"]), r["text"] or "", r["_qm_slot"], r["_qm_start"]) for r in mix(docs, block_bytes=1000, keep=["_qm_slot", "_qm_start"]).collect())
    for most in (0, 500_000):
        monkeypatch.setattr("quire.llm.common.BROADCAST_ROWS", most)
        got = places(docs, block_bytes=1000)
        rows = sorted((str(r["doc_id"]), r["text"] or "", r["_qm_slot"], r["_qm_start"]) for r in got.collect())
        assert got.columns == [*docs.columns, "_qm_slot", "_qm_start"] and len(rows) == len(want)
        if not twice:  # the same blocks in the same slots; within a source the order is by hash either way
            assert rows == want
    assert places(docs.limit(0)).count() == 0


def test_the_query(spark, tmp_path):
    docs = documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op3_mixing(spark, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in docs.collect())


def test_mix_keeps_all_rows_in_order(spark):
    docs = documents(spark)
    slots = {(r["doc_id"], r["bytes"]): r["slot"] for r in mixture(docs, block_bytes=1000).collect()}
    out = mix(docs, block_bytes=1000).collect()
    assert sorted(map(str, out)) == sorted(map(str, docs.collect()))
    order = [slots[(r["doc_id"], len(r["text"] or "") + 1)] for r in out]
    assert order == sorted(order)
    assert mix(docs.limit(0)).count() == 0 and mixture(docs.limit(0)).count() == 0
