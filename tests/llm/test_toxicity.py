import zlib

import numpy as np
from pyspark.sql import functions as F

from quire.llm import kneser_ney
from quire.llm.queries import op2_toxicity
from quire.llm.toxicity import fit, fold, score_documents, words_of


def brute(words, toxic, ordinary, word):
    """The model's definition, with dictionaries instead of hashed tables."""
    grams, H = {}, kneser_ney.HISTORY
    for w, t, o in zip(words, toxic, ordinary):
        s = "\x02" + w + "\x03"
        for i in range(1, len(s)):
            g = grams.setdefault((s[max(0, i - H) : i], s[i]), [0, 0])
            g[0] += t
            g[1] += o
    pairs = {}
    for h, c in grams:
        pairs.setdefault(h[-2:], {}).setdefault(c, 0)
        pairs[h[-2:]][c] += 1
    ends = {}
    for p in pairs:
        for c in pairs[p]:
            ends[c] = ends.get(c, 0) + 1
    kinds = sum(ends.values())
    out, s, D = 0.0, "\x02" + word + "\x03", kneser_ney.SHARED_DISCOUNT
    for i in range(1, len(s)):
        h, c = s[max(0, i - H) : i], s[i]
        low = (ends.get(c, 0) + 0.1) / (kinds + 0.1 * kneser_ney.CODES)
        after = pairs.get(h[-2:], {})
        q = (max(after.get(c, 0) - D, 0) + D * len(after) * low) / sum(after.values()) if after else low
        for k, sign in ((0, 1), (1, -1)):
            here = {d: n[k] for (g, d), n in grams.items() if g == h and n[k]}
            n = sum(here.values())
            lost = {d: kneser_ney.DISCOUNTS[min(3, m)] for d, m in here.items()}
            out += sign * np.log((here.get(c, 0) - lost.get(c, 0) + sum(lost.values()) * q) / n if n else q)
    return out


def test_models_follow_the_definition():
    words, toxic, ordinary = ["idiot", "idle", "the", "then", "scum"], np.array([4, 0, 3, 1, 2]), np.array([0, 3, 9, 2, 0])
    models = kneser_ney.Models(kneser_ney.count(words, toxic, ordinary))
    asked = ["idiot", "the", "unseen", "é", "x", "thenidiot"]
    assert np.allclose(models.ratios(asked), [brute(words, toxic, ordinary, w) for w in asked], atol=1e-3)


def test_every_ngram_keeps_its_own_count():
    rng = np.random.default_rng(1)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzäöüß"))
    words = sorted({"".join(rng.choice(letters, 9)) for _ in range(60_000)})
    toxic = (np.arange(len(words)) % 40 == 0) * 5
    rows = kneser_ney.count(words, toxic, 5 - toxic)
    distinct = {(("\x02" + w + "\x03")[max(0, i - kneser_ney.HISTORY) : i + 1]) for w in words for i in range(1, len(w) + 2)}
    assert len(rows["tri"]) == len(distinct)
    bad = [w for w, t in zip(words, toxic) if t]
    assert np.mean(kneser_ney.Models(rows).ratios(bad) > 5) == 1


def test_sliced_models_score_the_same(spark, monkeypatch):
    docs, labels = corpus(spark, 300)
    docs = docs.unionByName(spark.createDataFrame([(None, None, None), (900, "", "a"), (900, "é zurgon zurgon unseen", "a")], docs.schema))
    one = fit(docs, labels)
    monkeypatch.setattr("quire.llm.toxicity.BROADCAST_GRAMS", 15)
    monkeypatch.setattr("quire.llm.toxicity._HELD_WORDS", 5)
    two = fit(docs, labels)
    assert two.models.context_slices > 2 and two.models.tri_slices >= 2 and np.allclose(one.weights, two.weights, rtol=1e-3, atol=1e-3)
    a, b = (sorted((r["doc_id"] or -1, r["text"] or "", r["toxicity"]) for r in score_documents(docs, m).collect()) for m in (one, two))
    assert [x[:2] for x in a] == [x[:2] for x in b] and np.allclose([x[2] for x in a], [x[2] for x in b], atol=1e-3)


def corpus(spark, n=600):
    rows, labels, rng = [], [], np.random.default_rng(0)
    for i in range(n):
        words = list(rng.choice(["red", "green", "blue", "house", "tree", "walk", "run"], 30))
        bad = i % 5 == 0
        if bad:
            words[int(rng.integers(30))] = rng.choice(["zurgon", "zurgel", "zurgatz"])
        rows.append((i, " ".join(words), "x"))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxicity_note string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    got = score_documents(docs, fit(docs, labels)).where(fold() == 2).collect()
    assert got and all((r["toxicity"] >= 0.3) == (r["doc_id"] % 5 == 0) for r in got)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in got)


def test_all_rows_but_the_sample_are_counted(spark, monkeypatch):
    docs, labels = corpus(spark, 300)
    monkeypatch.setattr("quire.llm.toxicity.CALIBRATION_ROWS", 10)
    model = fit(docs, labels)
    rows = docs.select("text", fold().alias("fold"), F.xxhash64("doc_id").alias("h")).where("fold <> 2").collect()
    every = -(-len(rows) // 40)
    used = [r["text"] for r in rows if r["fold"] != 3 or r["h"] % every]
    assert every > 1 and len(used) > sum(r["fold"] != 3 for r in rows)
    assert sum(c[0].sum() for c in model.models.known.classes) == sum(len(w) + 1 for t in used for w in words_of(t))


def test_many_labels_give_the_same_model(spark, monkeypatch):
    docs, labels = corpus(spark, 200)
    one = fit(docs, labels)
    monkeypatch.setattr("quire.llm.common.BROADCAST_LABELS", 0)
    monkeypatch.setattr("quire.llm.common.LABEL_WORDS", 1)
    two = fit(docs, labels)
    assert np.allclose(one.weights, two.weights)


def test_held_out_quality_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = op2_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    caught = [r["predicted"] for r in got if r["toxic"]]
    alarms = [r["predicted"] for r in got if not r["toxic"]]
    assert len(caught) > 100 and np.mean(caught) >= 0.93 and np.mean(alarms) <= 0.015


def test_held_out_labels_are_never_read(spark):
    docs, labels = corpus(spark, 200)
    flipped = labels.withColumn("toxic", F.when(fold() == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r["doc_id"]: r["toxicity"] for r in score_documents(docs, fit(docs, x)).collect()} for x in (labels, flipped))
    assert a == b


def test_odd_rows(spark):
    docs, labels = corpus(spark, 200)
    odd = spark.createDataFrame([(None, None, None), (1, "", "a"), (1, "", "a"), (9, "w" * 100_000, None), (7, "!!! ???", None), (8, "zurgon " * 50_000, "")], "doc_id long, text string, label string")
    model = fit(docs, labels.unionByName(spark.createDataFrame([(None, None, 1), (5, None, None), (0, 1, 1)], labels.schema)))
    got = score_documents(odd, model).collect()
    assert len(got) == 6 and all(0 <= r["toxicity"] <= 1 for r in got)
    assert next(r for r in got if r["doc_id"] == 8)["toxicity"] > 0.3
    assert score_documents(docs.limit(0), model).count() == 0


def test_without_labels(spark):
    docs, labels = corpus(spark, 50)
    assert {round(r["toxicity"], 3) for r in score_documents(docs, fit(docs, labels.limit(0))).collect()} == {0.0}
    assert fit(docs.limit(0), labels).weights[1:] == [0, 0, 0]
    assert words_of(None) == []
