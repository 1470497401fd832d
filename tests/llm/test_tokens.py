"""Tokenizing operators against the libraries on whole texts, with hard cases."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
from pyspark.sql import functions as F

from pitchgrid.llm import bpe, token_counts, token_files, vocabularies

HARD = [
    "", " ", "\n", "a", "  two  spaces ", "tab\tand\nline \n next", "It's we'll 'S don't", "ÅÉß straße ñandú", "x" * 5000, "word " * 3000, "<|endoftext|> in <|startoftext|>text", "a\x1cb \x1d c\x85d\xa0e",
    "İstanbul ΣΑΣ ﬁ é", "日本語のテキスト 12345 ...!!! -- ''", "emoji 👩‍👩‍👧 ok", "a b", "same text", "same text", "1 2 3 4'5", " x 　y", None,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "extra") for k, t in enumerate(HARD)] + [(None, "null id", "extra"), (3, "a", "extra")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def test_counts(docs):
    path = vocabularies.public_path("byte_bpe_50k.json")
    encode = vocabularies.tokenizer(path).encode
    want = sorted((str(i), len(t.encode()), len(encode(t, add_special_tokens=False).ids)) for i, t in texts_of(docs))
    for keep in (400_000, 3):
        got = token_counts.count_tokens(docs, path, batch_bytes=64, keep=keep).collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0


def test_byte_bpe_round_trip(spark, docs):
    path = vocabularies.public_path("byte_bpe_multi_50k.tiktoken")
    library = vocabularies.byte_encoder(path, P.PATTERN)
    want = sorted((str(i), library.encode_ordinary(t), t.encode()) for i, t in texts_of(docs))
    tokens = bpe.token_table(spark, path)
    got = bpe.decode(bpe.encode(docs, path, P.PATTERN, chunk_bytes=6000), tokens).collect()
    assert sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["decoded"])) for r in got) == want
    assert all(r["n_tokens"] == len(r["ids"]) // 4 for r in got)
    at_once = bpe.encode(docs, path, P.PATTERN, chunk_bytes=6000, tokens=tokens).collect()
    assert sorted(map(str, at_once)) == sorted(map(str, got))
    assert bpe.decode(bpe.encode(docs.limit(0), path, P.PATTERN), tokens).count() == 0
    odd = spark.createDataFrame([(None, "x"), (bytes(), "x"), (b"\x05\0\0\0", "x")], "ids binary, decoded string")
    by_id = {r["id"]: bytes(r["bytes"]) for r in tokens.filter("id = 5").collect()}
    assert [r["decoded"] and bytes(r["decoded"]) for r in bpe.decode(odd.coalesce(1), tokens).collect()] == [None, bytearray(), by_id[5]]
    with pytest.raises(ValueError, match="too many"):
        bpe.decode(odd, tokens, max_tokens=10)


def test_a_chunk_asks_for_each_word_once(spark):
    path, ranks = vocabularies.public_path("byte_bpe_multi_50k.tiktoken"), vocabularies.ranks(vocabularies.public_path("byte_bpe_multi_50k.tiktoken"))
    chunk = bpe._Chunk(regex.compile(P.PATTERN).findall)
    for k in range(3):
        chunk.add([2 * k, 2 * k + 1], ["zqx1wv zqx2wv and the", "zqx1wv" * (k + 1)])
    asks = chunk.row(0, ranks, 4)[5]
    words = [w for a in asks for w in bpe.unpack_words(a["words"])]
    assert len(words) == len(set(words)) and not set(words) & set(ranks)
    assert all(zlib.crc32(w) % 4 == a["p"] for a in asks for w in bpe.unpack_words(a["words"])) and len({a["p"] for a in asks}) == len(asks)
    docs = spark.createDataFrame([(k, " ".join(f"zqx{j}wv" for j in range(k, k + 40))) for k in range(60)], "doc_id long, text string").repartition(6)
    assert bpe.encode(docs, path, P.PATTERN, chunk_bytes=100).filter("n_tokens >= 40").count() == 60


def test_number_and_word_packing():
    x = np.array([0, 1, 255, 256, 70_000, 2**31], np.int64)
    assert bpe.unpack_numbers(bpe.pack_numbers(x)).tolist() == x.tolist()
    assert bpe.unpack_words(bpe.pack_words([b"", b"ab", b"c"])) == [b"", b"ab", b"c"] and bpe.unpack_words(bpe.pack_words([])) == []


def test_files(spark, docs, tmp_path):
    path = vocabularies.public_path("word_bpe_49k.json")
    encode = vocabularies.tokenizer(path).encode
    order = sorted(texts_of(docs.filter("doc_id is not null and doc_id <> 3")))
    encoded = token_files.encode_ids(docs.filter("doc_id is not null and doc_id <> 3"), path, 1, keep=4, batch_bytes=100)
    sample = token_files.train_dictionary(encoded)
    token_files.write_files(encoded, str(tmp_path / "f"), 2, sample, block_bytes=500, n_shards=3)
    got = {r["doc_id"]: r for r in token_files.read_files(spark, str(tmp_path / "f")).collect()}
    start = 0
    for i, t in order:
        ids = [*encode(t, add_special_tokens=False).ids, 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids"], got[i]["ids_crc32"]) == (start, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.lookup(spark, str(tmp_path / "f"), [7])[7] == [got[7]["ids"]]
    everything = token_files.store_and_read(docs, path, 1).collect()
    assert len(everything) == docs.count() and min(r["start"] for r in everything) == 0
    assert token_files.store_and_read(docs.limit(0), path, 1).count() == 0


def test_shared_dictionary(spark, tmp_path):
    path = vocabularies.public_path("word_bpe_49k.json")
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("the same opening words of every text and then "), (F.col("id") * 7919 % 1000).cast("string")).alias("text"))
    encoded = token_files.encode_ids(docs, path, 1)
    d = token_files.train_dictionary(encoded)
    assert len(d) >= 256
    token_files.write_files(encoded, str(tmp_path / "g"), 2, d)
    names = {r["dict_sha256"] for r in spark.read.parquet(str(tmp_path / "g" / "blocks")).select("dict_sha256").collect()}
    assert names == {hashlib.sha256(d).hexdigest()}
    assert token_files.read_files(spark, str(tmp_path / "g")).filter(F.size("ids") != F.col("n_tokens")).count() == 0
