import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import ann
from quire.llm.queries import op8_nearest

SF = "/root/testdata/sf0.01"


def brute(rows, k, every):
    rows = sorted(rows.items())
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    out = {}
    for i, v in rows:
        if i % every == 0:
            d = np.sqrt(((x - np.array(v)) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), d[j]) for j in order]
    return out


def compare(got, want, k):
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(by) == set(want)
    hit = sum(len({i for i, _ in by[q]} & {i for i, _ in want[q]}) for q in want)
    for q, found in by.items():
        assert found == sorted(found, key=lambda x: (x[1], x[0])) and len(found) == len(want[q])
    return hit / sum(map(len, want.values()))


def test_quantile():
    x = (np.random.default_rng(0).standard_normal((200_000, ann.M)) ** 2).sum(axis=1)
    assert abs((x < ann.chi_square_quantile(0.99)).mean() - 0.99) < 0.002


def test_recall_on_the_table(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 64)
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = {r["vec_id"]: r["embedding"] for r in table.collect() if r["embedding"] is not None}
    got = ann.nearest(table, F.col("vec_id") % 10 == 0).collect()
    want = brute({i: v for i, v in rows.items() if np.isfinite(v).all() and np.any(v)}, 10, 10)
    assert compare(got, want, 10) >= 0.9


def test_recall_at_default_settings(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r["vec_id"]: r["embedding"] for r in table.collect() if r["embedding"] is not None}
    got = op8_nearest(spark, "/root/testdata/sf0.1").collect()
    want = brute({i: v for i, v in rows.items() if np.isfinite(v).all() and np.any(v)}, 10, 100)
    assert compare(got, want, 10) >= 0.9


def test_repeated_rows_take_one_place(spark):
    rng = np.random.default_rng(9)
    v = rng.standard_normal(8)
    rows = [(5, v)] * 12 + [(i, v) for i in range(6, 20)] + [(100, v + 0.01)] + [(i, rng.standard_normal(8) * 5) for i in range(200, 230)]
    rows += [(6, v + 9), (100, v)]  # an id with two vectors: the nearest counts; none of a query's own id does
    table = spark.createDataFrame([(i, x.tolist()) for i, x in rows], "vec_id long, embedding array<double>")
    got = ann.nearest(table, F.col("vec_id") == 100, 10).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(5, 15)) and [r["rank"] for r in got] == list(range(1, 11))


def test_each_length_is_a_space_of_its_own(spark):
    rows = [(i, [float(i + 1)] * (2 if i < 30 else 3)) for i in range(50)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(table, F.col("vec_id").isin(0, 40), 3).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {0: [1, 2, 3], 40: [39, 41, 38]}


@pytest.mark.parametrize("parts", [40, 1 << 15])
@pytest.mark.parametrize("cells", [50, 100_000])
def test_recall_with_many_copies(spark, monkeypatch, cells, parts):
    monkeypatch.setattr(ann, "PART_ROWS", parts)
    monkeypatch.setattr(ann, "CELL_ROWS", cells)
    monkeypatch.setattr(ann, "QUERY_ROWS", 7)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((5, 16)) * 4
    rows = {i: (centres[i % 5] + rng.standard_normal(16)).tolist() if i % 3 else [1.0] * 16 for i in range(600)}
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (None, [1.0] * 16), (1005, [float("inf")] + [0.0] * 15), (1006, [1.0, 2.0]), (1010, [])]
    table = spark.createDataFrame([(i, v, 1) for i, v in [*rows.items(), *odd]], "vec_id long, embedding array<double>, cell int")
    got = ann.nearest(table, F.col("vec_id") % 20 == 0).collect()
    assert compare(got, brute(rows, 10, 20), 10) >= 0.95


def test_small_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    one = spark.createDataFrame([(0, [1.0, 2.0]), (3, [1.0, 2.0]), (3, [1.0, 2.0]), (5, [4.0, 6.0])], schema)
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(one, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 3, 0.0), (0, 2, 5, 5.0)]
    assert ann.nearest(one.limit(0), F.col("vec_id") == 0).count() == 0
