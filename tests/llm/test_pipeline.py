import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quire.llm.common import stage
from quire.llm.toxicity import fit, score_documents
from tests.llm.test_near_dedup import classes


def test_by_brute_force(spark, tmp_path):
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(160):
        words = list(rng.choice(vocabulary, 40))
        if i % 6 == 0:
            words[5:7] = ["zurgon", "zurgatz"]
        text = " ".join(words)
        if i % 10 == 3:
            text = rows[i - 1][1].upper()  # an exact copy
        if i % 10 == 7:
            w = rows[i - 2][1].split()
            w[-1] = "changed"
            text = " ".join(w)  # a near copy
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int("zurg" in text.lower())))
    rows += [(900, None, None, None, None), (901, "", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    toxic = {r["doc_id"] for r in score_documents(docs, fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))).collect() if r["toxicity"] >= 0.3}
    assert toxic >= {i for i, t, *_ in rows if "zurg" in (t or "").lower()} and 900 not in toxic
    left = {}
    for i, t, *_ in rows:
        if i not in toxic:
            left[(t or "").lower()] = (i, t or "")
    kept = sorted(left.values())
    leaders = classes([t for _, t in kept])
    kept = [kept[k] for k in sorted(set(leaders))]
    assert sorted(got) == [i for i, _ in kept]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in kept:
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == tokenizer.encode(t).ids
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_the_mixture_survives_rereading(spark, monkeypatch):
    monkeypatch.setattr("quire.llm.mixing.PIECE_ROWS", 60)
    rows = [(i, "w " * (i % 90 + 1) * (400 if i < 200 else 40), "en", f"s{i % 3 if i % 2 else 0}", 5) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mixing_stage(spark, docs, "")
    want = [r["doc_id"] for r in mixed.select("doc_id").collect()]
    reread = stage(mixed.repartition(6, "doc_id"), "several-files")
    assert len(reread.inputFiles()) > 1 and [r["doc_id"] for r in reread.collect()] != want
    got = stage(corpus_pipeline.encoding_stage(spark, reread, ""), "encoded").select("doc_id", "slot", "start").collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: (r["slot"], r["start"]))] == want
    assert len({r["slot"] for r in got}) > 20


def test_stages_keep_the_columns(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5), (2, "A b c", "en", None, 5)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, str(tmp_path)).columns == docs.columns
        assert step(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_stages_begin_with_heaps_given_back(spark, tmp_path):
    """On one machine the executor's heap is the driver's: its full collections are counted."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    old = [b for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName()]
    full = lambda: sum(b.getCollectionCount() for b in old)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5), (2, "A b c", "en", None, 5)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, step in corpus_pipeline.STAGES:
        before = full()
        step(spark, docs, str(tmp_path))
        assert full() > before, name
