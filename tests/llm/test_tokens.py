import hashlib
import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm.bpe import byte_alphabet, byte_bpe, encode_decode
from quire.llm.common import shared_path
from quire.llm.queries import op1_token_files, op7_bpe
from quire.llm.splitting import BYTE_WORDS, LOWER_WORDS, plain
from quire.llm.token_files import BLOCK, TokenFile, TokenFileWriter, lower_word_encoder, pack_blocks, read_token_files, unpack_block, write_token_files

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
HARD = ["", " ", "a", "It's  we'll\n\n x", "<|endoftext|>a<|endoftext|>", "é ß ﬁ Σας İ ²³ ½ ª", "日本語 テスト 한국어", "🙂👍🏽 x", "a\x1cb\x85c d e", "x" * 3000, "ab" * 1500 + "!" * 700, "é nfd", "<|startoftext|> Hi", "՘౜", "1234567 890", "__init__ a_b", "\t\r\n \n"]


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)


def test_plain_characters_split_as_the_library_does(libraries):
    alphabet = {b: c for c, b in byte_alphabet().items()}
    word = lower_word_encoder(WORDS)
    for cp in range(0x2100):
        if not plain(chr(cp)) or cp > 0x2FF and not 0x2010 <= cp:
            continue
        s = "a" + chr(cp) + " " + chr(cp) + "1" + chr(cp) * 2 + "B"
        want = [w for w, _ in libraries[0].pre_tokenizer.pre_tokenize_str(s)]
        assert ["".join(alphabet[b] for b in w.encode()) for w in BYTE_WORDS.findall(s)] == want, hex(cp)
        assert np.frombuffer(word.encode([s])[0], "<u4").tolist() == libraries[1].encode(s, add_special_tokens=False).ids, hex(cp)


@pytest.mark.parametrize("text", HARD)
def test_encoders_equal_the_library(libraries, text):
    bpe = byte_bpe(BYTES)
    ids = libraries[0].encode(text, add_special_tokens=False).ids
    assert np.frombuffer(bpe.encode([text])[0], "<u4").tolist() == ids
    assert bpe.decode(bpe.encode([text])[0]) == libraries[0].decode(ids, skip_special_tokens=False)
    assert np.frombuffer(lower_word_encoder(WORDS).encode([text])[0], "<u4").tolist() == libraries[1].encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    a, b = Tokenizer.from_file(BYTES) if not hasattr(test_any_text, "held") else test_any_text.held, None
    test_any_text.held = a
    assert np.frombuffer(byte_bpe(BYTES).encode([text])[0], "<u4").tolist() == a.encode(text, add_special_tokens=False).ids


def test_long_and_short_words_agree():
    bpe = byte_bpe(BYTES)
    for w in (b"abcabcabc" * 20, b"the and ing" * 10, bytes(range(256))):
        assert bpe.word(w) == bpe._long([bpe.of_byte[x] for x in w])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), min_size=1, max_size=3000))
def test_blocks_round_trip(ids):
    blocks = pack_blocks(np.array(ids, np.uint32))
    assert np.concatenate([unpack_block(b) for b in blocks])[: len(ids)].tolist() == ids


def test_exceptions_keep_the_width_small():
    ids = np.full(BLOCK, 5, np.uint32)
    ids[::50] = 4_000_000_000
    assert len(pack_blocks(ids)[0]) < 200


def test_file_random_access():
    class Sink(io.BytesIO):
        def close(self):
            self.raw = self.getvalue()

    rng, sink = np.random.default_rng(1), Sink()
    docs = [rng.integers(0, 50_000, n).astype(np.uint32) for n in (0, 1, 1023, 1024, 1025, 700_000, 3)]
    w = TokenFileWriter(sink)
    for i, d in enumerate(docs):
        w.add(None if i == 3 else i, d)
    w.close()
    f = TokenFile(io.BytesIO(sink.raw), len(sink.raw))
    for i, d in enumerate(docs):
        assert f.document(i).tolist() == d.tolist()
    got = [ids for _, _, ids in f.batches()]
    assert np.concatenate(got).tolist() == np.concatenate(docs).tolist()


def test_files_by_brute_force(spark, libraries):
    texts = [*HARD, None, "plain text of some words"] * 3
    rows = [(i * 7 % 61, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    folder = shared_path(spark, "t")
    got = {r["doc_id"]: r for r in read_token_files(spark, folder, write_token_files(docs, folder, WORDS, 2, rows_per_file=9)).collect()}
    start = 0
    for d, t, _ in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = [*libraries[1].encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[d]["start"], got[d]["n_tokens"]) == (start, len(ids))
        assert zlib.crc32(bytes(got[d]["ids"])) == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    folder = shared_path(spark, "t")
    assert read_token_files(spark, folder, write_token_files(empty, folder, WORDS)).count() == 0
    assert encode_decode(empty, BYTES).count() == 0


def test_encode_decode_rows(spark, libraries):
    docs = spark.createDataFrame([(1, None, 3), (2, "Hi there", 4), (2, "Hi there", 4), (None, "x", 5)], "doc_id long, text string, ids int")
    got = encode_decode(docs, BYTES).collect()
    assert sorted((r["decoded"], r["n_tokens"]) for r in got) == sorted((t or "", len(libraries[0].encode(t or "").ids)) for _, t, _ in [(1, None, 0), (2, "Hi there", 0), (2, "Hi there", 0), (0, "x", 0)])
    assert hashlib.sha256(bytes(got[0]["ids"])).hexdigest()


def test_rows_of_one_id_fill_several_files(spark):
    docs = spark.createDataFrame([(None if i % 2 else 4, f"text {i}") for i in range(400)], "doc_id long, text string")
    folder = shared_path(spark, "t")
    files = write_token_files(docs, folder, WORDS, rows_per_file=40)
    got = sorted(read_token_files(spark, folder, files).collect(), key=lambda r: r["start"])
    assert len(files) >= 8 and max(n for _, n, _ in files) < 120
    assert [r["doc_id"] for r in got] == [None] * 200 + [4] * 200
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()


def test_the_queries(spark, tmp_path, libraries):
    texts = [*HARD, None]
    spark.createDataFrame([(3 * i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    one = {r["doc_id"]: r for r in op1_token_files(spark, str(tmp_path)).collect()}
    seven = {r["doc_id"]: r for r in op7_bpe(spark, str(tmp_path)).collect()}
    start = 0
    for i, t in enumerate(texts):
        words = np.array([*libraries[1].encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        ids = libraries[0].encode(t or "", add_special_tokens=False).ids
        assert one[3 * i].asDict() == {"doc_id": 3 * i, "start": start, "n_tokens": len(words), "ids_crc32": zlib.crc32(words.tobytes())}
        decoded = libraries[0].decode(ids, skip_special_tokens=False)
        assert (seven[3 * i]["n_tokens"], seven[3 * i]["ids_sha256"], seven[3 * i]["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        start += len(words)
