"""The queries of this subpackage: each applies one operator to its whole table and returns the digest of its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchgrid.llm import bpe, hilbert_search, html_text, itq_dedup, mixing, ngram_join, suffix_dedup, token_counts, token_files, toxicity, vocabularies
from pitchgrid.llm.common import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = vocabularies.public_path("byte_bpe_multi_50k.tiktoken")
    decoded = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, tokens=bpe.token_table(spark, path))
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = (mixing.FADING, mixing.CONSTANT, mixing.RISING)
    planned = mixing.plan(table(spark, sf_dir, "documents"), lambda k, s: 1.0 + k % 3, lambda k, s: shapes[k % 3])
    return mixing.by_position(planned).select("doc_id", "size", "source_size", "target", "taken")


def op3_hilbert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabularies.public_path("byte_bpe_50k.json"))


def op7_itq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.store_and_read(table(spark, sf_dir, "documents"), vocabularies.public_path("word_bpe_49k.json"), end_id=1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_mix_sources": op2_mix_sources,
    "op3_hilbert_search": op3_hilbert_search,
    "op4_toxicity": op4_toxicity,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_itq_near_dedup": op7_itq_near_dedup,
    "op8_ngram_join": op8_ngram_join,
    "op9_html_text": op9_html_text,
    "op10_token_files": op10_token_files,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {}

#: Targets by filling up: sources in the order in which their cap is reached, the rest shared by weight from the first on
#: that its share doesn't cap.
ORACLES["op2_mix_sources"] = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, 1 + k % 3 AS w, 3 * source_size AS cap, sum(source_size) OVER () AS total, row_number() OVER (ORDER BY 3 * source_size / (1 + k % 3), k) AS i FROM s),
o AS (SELECT *, total - coalesce(sum(cap) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM w),
f AS (SELECT min(i) AS i FROM o WHERE rest * w <= cap * weights),
t AS (SELECT o.source, o.k, o.source_size, CASE WHEN o.i < f.i THEN o.cap::DOUBLE ELSE first.rest::DOUBLE * o.w / first.weights END AS target FROM o, f, o first WHERE first.i = f.i),
p AS (SELECT doc_id, size, source_size, target, floor(target + 0.5)::BIGINT AS aim,
        (sum(size) OVER (PARTITION BY k ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS place FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (greatest(0, least(aim - place, size)) + greatest(0, least(aim - source_size - place, size)) + greatest(0, least(aim - 2 * source_size - place, size)))::BIGINT AS taken FROM p
"""

ORACLES["op5_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
g AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
m AS (SELECT s, min(doc_id) AS first_doc FROM g GROUP BY s),
c AS (SELECT g.doc_id, g.i FROM g JOIN m USING (s) WHERE m.first_doc < g.doc_id),
k AS (SELECT *, sum(new_run) OVER (PARTITION BY doc_id ORDER BY i) AS run
      FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new_run FROM c)),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, run),
t AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last_b FROM r GROUP BY doc_id),
e AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS z FROM r
      UNION ALL SELECT d.doc_id, coalesce(t.last_b, 0), d.n FROM d LEFT JOIN t USING (doc_id)),
x AS (SELECT e.doc_id, string_agg(substr(d.h, 2 * f + 1, 2 * (z - f)), '' ORDER BY f) AS kept FROM e JOIN d USING (doc_id) GROUP BY e.doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(t.removed, 0)::BIGINT AS n_removed, coalesce(t.spans, 0) AS n_spans, sha256(unhex(x.kept)) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) JOIN x USING (doc_id)
"""

_REACH = """
link AS (SELECT a, b FROM pair UNION SELECT b, a FROM pair),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
comp AS (SELECT a AS id, least(a, min(b)) AS component FROM reach GROUP BY a)
"""

ORACLES["op7_itq_near_dedup"] = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
pair AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
{_REACH}
SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN comp ON id = vec_id
"""

ORACLES["op8_ngram_join"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
pair AS (SELECT a, b FROM both_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 75 * (p.n + q.n - i)),
{_REACH}
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, documents.doc_id) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN comp ON id = documents.doc_id
"""
