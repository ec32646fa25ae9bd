import random
from collections import Counter

import numpy as np
import pytest

from quire.llm.near_dedup import THRESHOLD, components, dart_signature, near_dedup, near_duplicate_classes, shingle_units, words_of

from quire.llm.queries import op10_near_dedup


def weighted_jaccard(a, b):
    def shingles(t):
        w = words_of(t)
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    x, y = shingles(a), shingles(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def classes(texts):
    """Brute force: components of all pairs at the threshold."""
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if words_of(texts[i]) and weighted_jaccard(texts[i], texts[j]) >= THRESHOLD:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [find(i) for i in range(len(texts))]


def family(rnd, n, words, changes):
    base = [rnd.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rnd.randint(0, 40)) for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, changes)):
            w[rnd.randrange(words)] = f"new{rnd.random()}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("sizes", [(300, 240), (40, 8), (8, 40)])
def test_agreement_is_the_weighted_similarity(sizes):
    rnd = random.Random(5)
    common = [f"c{i}" for i in range(sizes[0])]
    a, b = (" ".join(common + [f"{k}{rnd.random()}" for _ in range(sizes[1] // 4)] + ["x"] * (9 if k == "p" else 30)) for k in "pq")
    x, y = (dart_signature(shingle_units(words_of(t)), 4000) for t in (a, b))
    assert abs(np.mean(x == y) - weighted_jaccard(a, b)) < 0.04


def test_equals_brute_force(spark):
    rnd = random.Random(1)
    texts = [t for _ in range(12) for t in family(rnd, 6, 120, 8)] + family(rnd, 25, 200, 5) + ["", None, "", "one two", "One, two!", "a b c d e", "a b c d e", "x"]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    want = classes([t or "" for t in texts])
    got = {r["doc_id"]: r for r in near_duplicate_classes(docs).collect()}
    assert [got[i]["class_id"] for i in range(len(texts))] == want
    assert all(got[i]["class_size"] == want.count(want[i]) and got[i]["kept"] == (want[i] == i) for i in got)
    left = near_dedup(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(set(want))


def test_large_group_and_gray_neighbours(spark):
    rnd = random.Random(2)
    texts = family(rnd, 150, 60, 3)  # many pairs just under the threshold
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_duplicate_classes(docs).collect()} == dict(enumerate(classes(texts)))


def test_rows_with_odd_ids(spark):
    schema = "doc_id long, text string, total string"
    t, u = " ".join(map(str, range(50))), " ".join(map(str, range(100, 150)))
    docs = spark.createDataFrame([(1, t, "a"), (1, t, "a"), (1, u, "b"), (None, u, "c"), (None, t, None), (2, None, "d")], schema)
    left = near_dedup(docs).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in left) == sorted([(1, t), (1, u), (2, "")])
    assert near_dedup(docs.limit(0)).count() == 0 and near_duplicate_classes(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4, 512])
def test_sizes_in_one_bucket(spark, monkeypatch, block):
    """Texts of many lengths over the same words: blocks of size classes lose no link."""
    monkeypatch.setattr("quire.llm.near_dedup.BLOCK", block)
    monkeypatch.setattr("quire.llm.near_dedup.ROUNDS", 0)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[: 20 + 3 * i]) for i in range(0, 60, 4)] + [" ".join(words[k : k + 90]) for k in range(0, 60, 5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_duplicate_classes(docs).collect()} == dict(enumerate(classes(texts)))


def test_many_rows_share_an_id(spark):
    """Each node's text is that of one row, so units are hashed once however many rows share an id or have none."""
    rnd = random.Random(4)
    texts = family(rnd, 40, 80, 3) * 5
    docs = spark.createDataFrame([(None if i % 2 else 7, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = classes(texts[:40])
    got = near_duplicate_classes(docs).collect()
    assert len(got) == 200 and {r["class_id"] for r in got} <= {7, None}
    assert sorted(r["class_size"] for r in got) == sorted(5 * want.count(c) for c in want for _ in range(5))
    assert near_dedup(docs).count() == len(set(want))


def test_the_query(spark, tmp_path):
    texts = family(random.Random(6), 30, 90, 4) + [None, ""]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, class_id string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["class_id"] for r in op10_near_dedup(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(classes([t or "" for t in texts])))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102), (200, 201)]
    got = {r["u"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200, 201: 200}
