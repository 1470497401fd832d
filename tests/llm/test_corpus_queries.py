"""The registered queries over whole tables: against their SQL, the libraries on whole texts, or brute force."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from conftest import SF
from oracle import expected, rows_of

from pitchgrid.llm import queries, vocabularies
from pitchgrid.llm.common import table


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    assert rows_of(queries.QUERIES[name](spark, SF)) == expected(queries.ORACLES[name], SF)


def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").select("doc_id", "text").collect()}


def test_byte_bpe(spark):
    library = vocabularies.byte_encoder(vocabularies.public_path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    got = {r["doc_id"]: r for r in queries.op1_byte_bpe(spark, SF).collect()}
    for i, t in texts(spark).items():
        ids = np.array(library.encode_ordinary(t), "<u4").tobytes()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_token_counts(spark):
    encode = vocabularies.tokenizer(vocabularies.public_path("byte_bpe_50k.json")).encode
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op6_token_counts(spark, SF).collect()}
    for i, t in texts(spark).items():
        n = len(encode(t, add_special_tokens=False).ids)
        assert got[i] == (len(t.encode()), n, n > 512)


def test_token_files(spark):
    encode = vocabularies.tokenizer(vocabularies.public_path("word_bpe_49k.json")).encode
    got = {r["doc_id"]: r for r in queries.op10_token_files(spark, SF).collect()}
    start = 0
    for i, t in sorted(texts(spark).items()):
        ids = [*encode(t, add_special_tokens=False).ids, 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_search(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SF, "embeddings").select("vec_id", "embedding").collect()]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    place = {int(i): k for k, i in enumerate(ids)}
    found = {}
    for r in queries.op3_hilbert_search(spark, SF).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q, best in found.items():
        s = (x[place[q]] * x).sum(1)
        s[place[q]] = -np.inf
        hits += len({v for _, v, _ in best} & set(ids[np.argsort(-s, kind="stable")[:20]].tolist()))
        total += min(20, len(ids) - 1)
        assert all(score == s[place[v]] for _, v, score in best) and [v for _, v, _ in sorted(best)] == [v for _, v, _ in sorted(best, key=lambda b: (-b[2], b[1]))]
    assert set(found) == {int(i) for i in ids if i % 20 == 0} and hits / total >= 0.9
