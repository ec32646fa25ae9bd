import gzip
import os
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.common import shared_path
from quire.llm.queries import op4_warc
from quire.llm.warc import digest, make_record, page_key, page_record, parse_record, read_warc, records_in, write_warc


def reader(raw):
    return lambda at, n: raw[at : at + n]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=3000), min_size=1, max_size=12), st.integers(1, 900))
def test_ranges_find_each_record_once(payloads, split):
    raw = b"".join(page_record(i, "u", p, None, False, "d") for i, p in enumerate(payloads))
    found = [x for a in range(0, len(raw), split) for x in records_in(reader(raw), len(raw), a, a + split)]
    assert [f["warc-record-id"] for _, f, _, _ in found] == [f"<urn:quire:page:{i}>" for i in range(len(payloads))]
    assert [b.partition(b"\r\n\r\n")[2] for _, _, b, _ in found] == payloads


def listed(spark, raw, split, **more):
    """(offset, record id) of the records of an archive with these bytes."""
    folder = shared_path(spark, "warc-raw").removeprefix("file://")
    os.makedirs(folder)
    with open(f"{folder}/x.warc.gz", "wb") as f:
        f.write(raw)
    files = spark.createDataFrame([(f"file://{folder}/x.warc.gz", len(raw))], "file string, bytes long")
    return [(r["offset"], r["record_id"]) for r in read_warc(spark, files, split, **more).orderBy("offset").collect()]


def test_members_inside_payloads_are_not_records(spark):
    inner = b"".join(page_record(90 + i, None, b"inner" * i, None, False, "d") for i in range(4))
    noise = random.Random(1).randbytes(20_000)
    stored = [gzip.compress(gzip.decompress(page_record(i, None, noise + inner + noise[:9000], None, False, "d")), 0) for i in range(3)]
    raw = b"".join(stored) + b"".join(page_record(i, None, b"x", None, False, "d") for i in range(3, 30))
    assert raw.count(inner) == 3
    for split in (700, 5_000, 30_000, 1 << 20):
        assert [i for _, i in listed(spark, raw, split, payloads=False)] == [f"<urn:quire:page:{i}>" for i in range(30)]


def test_damaged_archives_read_alike_at_any_split(spark):
    member = [page_record(i, None, f"{i}".encode() * 50, None, False, "d") for i in range(6)]
    raw = member[0] + member[1] + b"8 bytes!" + member[2] + member[3][: len(member[3]) // 2] + member[4] + b"\x1f\x8b\x08" + member[5]
    whole = listed(spark, raw, len(raw))
    assert [i for _, i in whole] == [f"<urn:quire:page:{i}>" for i in (0, 1, 2, 4, 5)]
    assert all(listed(spark, raw, split) == whole for split in (40, 60, 100, 333, 1000))
    assert parse_record(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n") is None
    assert make_record("response", [], b"x")[:3] == b"\x1f\x8b\x08"


def test_a_task_for_each_range(spark):
    raw = b"".join(page_record(i, None, random.Random(i).randbytes(300), None, False, "d") for i in range(40))
    folder = shared_path(spark, "warc-raw").removeprefix("file://")
    os.makedirs(folder)
    with open(f"{folder}/x.warc.gz", "wb") as f:
        f.write(raw)
    got = read_warc(spark, spark.createDataFrame([(f"file://{folder}/x.warc.gz", len(raw))], "file string, bytes long"), len(raw) // 20 + 1)
    assert got.count() == 40 and len([f for f in got.inputFiles()]) >= 19  # a file a task that found records


def test_the_query_keeps_every_page(spark, tmp_path):
    rows = [(7, "u", "<p>a</p>", "x"), (3, None, "<p>a</p>", "y"), (None, "u", "<p>a</p>", "z"), (9, "u", None, ""), (8, "u", "", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string, payload string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in op4_warc(spark, str(tmp_path)).collect()}
    assert got == {3: (8, "response", None), 7: (8, "revisit", 3), None: (8, "revisit", 3), 8: (0, "response", None), 9: (0, "revisit", 8)}


def test_round_trip_by_brute_force(spark):
    rnd = random.Random(3)
    texts = [None, "", "<p>é</p>", "a" * 200_000, "\x1f\x8b\x08", *(rnd.choice("abc") * rnd.randint(1, 4) for _ in range(60))]
    rows = [(1000 - i, f"http://x/{i} \r\ny" if i % 4 else None, t, "z") for i, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha string")
    files = write_warc(pages, shared_path(spark, "warc"))
    got = read_warc(spark, files, 777).where("record_type <> 'warcinfo'").withColumn("id", page_key("record_id").cast("long")).withColumn("to", page_key("refers_to_id").try_cast("long")).collect()
    least = {}
    for i, _, t, _ in rows:
        least[t or ""] = min(i, least.get(t or "", i))
    assert len(got) == len(rows)
    for r in got:
        t = next(t or "" for i, _, t, _ in rows if i == r["id"]).encode()
        first = least[t.decode()]
        assert (r["payload_length"], r["payload_digest"]) == (len(t), digest(t))
        assert (r["record_type"], r["to"]) == (("response", None) if r["id"] == first else ("revisit", first))
        assert r["record_type"] == "revisit" or (bytes(r["payload"]) == t and r["digest_ok"])
    assert all("\n" not in (r["target_uri"] or "") for r in got)


def test_least_ties_nulls_and_empty(spark):
    schema = "page_id long, url string, html string"
    pages = spark.createDataFrame([(1, None, ""), (2, None, ""), (3, "u", "long enough"), (4, "u", "long enough"), (3, "u", "long enough"), (None, None, "long enough"), (None, "u", "only null"), (None, "u", "only null")], schema)
    got = read_warc(spark, write_warc(pages, shared_path(spark, "warc"), least=5)).where("record_type <> 'warcinfo'").select("record_type", page_key("refers_to_id").alias("to")).collect()
    assert sorted((r[0], r[1]) for r in got) == sorted([("response", "")] * 6 + [("revisit", "3")] * 2) or sorted((r[0], r[1] or "") for r in got) == sorted([("response", "")] * 6 + [("revisit", "3")] * 2)
    assert read_warc(spark, write_warc(pages.limit(0), shared_path(spark, "warc"))).count() == 0
