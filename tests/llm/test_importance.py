import zlib

import numpy as np
import pytest

from quire.llm import importance
from quire.llm.importance import buckets, kth_largest, log_ratios, resample, weigh
from quire.llm.queries import op6_importance


def corpus(spark, n=400):
    rng, rows, labels = np.random.default_rng(0), [], []
    for i in range(n):
        good = i % 4 != 0
        words = rng.choice(["red", "green", "blue", "house", "tree"], 40)
        rows.append((i, " ".join(words) if good else " ".join(w + "!!" for w in words), "a"))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, kept string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_weights_by_brute_force(spark):
    docs, labels = corpus(spark, 120)
    ratios, share = importance.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    raw, target = np.zeros(importance.BUCKETS), np.zeros(importance.BUCKETS)
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 4 != 2]
    for i, t in texts.items():
        for b in buckets(t):
            raw[b] += 1
            target[b] += i in train and i % 4 != 0
    assert np.allclose(ratios, log_ratios(raw, target))
    assert share == sum(i % 4 != 0 for i in train) / len(train)
    for r in weigh(docs, ratios).collect():
        assert abs(r["log_weight"] - sum(ratios[b] for b in buckets(texts[r["doc_id"]]))) < 1e-9


def test_many_labels_give_the_same_model(spark, monkeypatch):
    docs, labels = corpus(spark, 200)
    docs = docs.unionByName(spark.createDataFrame([(None, "red", "x"), (1, "twice", "x")], docs.schema))
    one = importance.fit(docs, labels)
    monkeypatch.setattr("quire.llm.common.BROADCAST_LABELS", 0)
    monkeypatch.setattr("quire.llm.common.LABEL_WORDS", 2)
    two = importance.fit(docs, labels)
    assert np.allclose(one[0], two[0]) and one[1] == two[1]


def test_the_query(spark, tmp_path):
    docs, labels = corpus(spark, 80)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = op6_importance(spark, str(tmp_path)).collect()
    assert len(got) == 80 and sum(r["kept"] for r in got) == round(80 * sum(i % 4 != 0 for i in range(80) if zlib.crc32(str(i).encode()) % 4 != 2) / sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(80)))


def test_keeps_the_good(spark):
    docs, labels = corpus(spark)
    got = resample(docs, labels).collect()
    kept = [r["doc_id"] for r in got if r["kept"]]
    assert len(got) == 400 and np.mean([i % 4 != 0 for i in kept]) > 0.97 and abs(len(kept) - 300) < 20


@pytest.mark.parametrize("exact", [5, 10_000])
def test_kth_largest(spark, monkeypatch, exact):
    monkeypatch.setattr(importance, "EXACT_ROWS", exact)
    v = [float(x) for x in np.random.default_rng(1).standard_normal(300) * 1e3] + [7.0] * 40 + [1e9]
    df = spark.createDataFrame([(x,) for x in v], "key double")
    for k in (1, 2, 100, 341):
        assert kth_largest(df, "key", k) == sorted(v, reverse=True)[k - 1]


def test_gumbel_draws_in_proportion(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "case when id % 2 = 0 then 'a' else 'b' end as text")
    ratios = np.zeros(importance.BUCKETS)
    ratios[buckets("a")] = np.log(3)
    top = sorted(weigh(docs, ratios).collect(), key=lambda r: -r["key"])[:400]
    assert 0.68 < np.mean([r["doc_id"] % 2 == 0 for r in top]) < 0.82


def test_odd_rows(spark):
    docs, labels = corpus(spark, 60)
    odd = spark.createDataFrame([(None, None, "x"), (1, "", None), (2, "z" * 50_000, ""), (2, "z" * 50_000, "")], "doc_id long, text string, key string")
    assert resample(odd, labels).count() == 4 and resample(odd.limit(0), labels).count() == 0
    assert resample(docs, labels.limit(0)).where("kept").count() == 60
