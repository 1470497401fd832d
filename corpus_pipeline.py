"""A training corpus from ``documents`` in five stages, each one operator of pitchgrid.llm.

Every stage works on all that its predecessor kept, as written to Parquet and read again; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from pitchgrid.llm import bpe, mixing, ngram_join, suffix_dedup, toxicity, vocabularies
from pitchgrid.llm.common import Scratch, table


def _whole(docs: DataFrame) -> Column:
    """All columns of a row as one, so that no name of theirs meets an operator's own."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")


def _columns(docs: DataFrame, **changed: Column) -> list[Column]:
    """The columns of ``docs`` out of ``_row``, some of them changed."""
    return [(changed[c] if c in changed else F.col("_row")[c]).alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labels, grades 1 or more go.

    A null text is graded as an empty one; rows without an id and repeated rows are graded like all others. Without
    labels of both kinds, or on an empty table, nothing goes. Other columns pass unchanged, whatever their names."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that link by shingle Jaccard, the one with the least id stays.

    Of rows that share an id, the one with the least hash stays; all rows without an id stay. Null and empty texts link
    with nothing. An empty table gives an empty one. Other columns pass unchanged, whatever their names."""
    scratch = Scratch(spark)
    groups = scratch.write(ngram_join.near_duplicates(docs.select("doc_id", "text")))
    gone = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    again = groups.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    kept = docs.select("doc_id", _whole(docs)).join(gone, "doc_id", "left_anti")
    if not again.isEmpty():
        hashed = [F.col("_row")[f.name] for f in docs.schema.fields if not isinstance(f.dataType, MapType)]
        once = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("_row", F.xxhash64(*hashed)).alias("_row"))
        kept = kept.join(again, "doc_id", "left_anti").unionByName(once)
    return kept.select(_columns(docs))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by 50-byte strings of documents with smaller ids are cut out; texts of which nothing is left go.

    Bytes of a character that was cut in part go too; n_chars is that of the text that is left. Null texts stay null and
    empty ones empty; rows without an id, and rows of one id among each other, lose nothing. An empty table gives an
    empty one. Other columns pass unchanged, whatever their names."""

    rows = docs.select("doc_id", "text", _whole(docs.drop("text")), F.col("text").isNull().alias("_none"))
    cut = suffix_dedup.remove_repeats(rows, carry=["_row", "_none"], whole_characters=True).filter("n_removed < n_bytes or n_bytes = 0")
    cut = cut.withColumn("_text", F.when(~F.col("_none"), F.col("kept").cast("string")))
    changed = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return cut.select(_columns(docs, **changed))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to weights 1, 2, 3, repeating, over a curriculum: documents that the mix doesn't take go,
    those that it takes more than once are repeated, and all are range-sorted by training position.

    Null and empty texts have no words and are never taken. Each row is taken or not on its own, also without an id or
    when repeated; rows are ordered by a hash of id and text, so reruns agree up to rows that are equal in both. An
    empty table gives an empty one. Other columns pass unchanged, whatever their names."""
    shapes = (mixing.FADING, mixing.CONSTANT, mixing.RISING)
    rows = docs.select("doc_id", "text", "source", _whole(docs))
    scratch = Scratch(spark)
    planned = mixing.plan(rows, lambda k, s: 1.0 + k % 3, lambda k, s: shapes[k % 3], whole=True, carry=["_row"], scratch=scratch)
    # written, as range-sorting reads its input twice
    taken = Scratch(spark).write(planned.select("doc_id", "_row", F.explode("copies").alias("_c")))
    scratch.drop()
    return taken.orderBy("_c.position", "doc_id", "_c.copy").select(_columns(docs))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row (little-endian unsigned 32-bit integers), their hash, and that of the decoded bytes.

    Null and empty texts have no ids; rows without an id and repeated rows each give a row; an empty table gives none.
    Other columns are left out."""
    import public_tokenizers

    path = vocabularies.public_path("byte_bpe_multi_50k.tiktoken")
    decoded = bpe.encode(docs, path, public_tokenizers.PATTERN, tokens=bpe.token_table(spark, path))
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", remove_repeats),
    ("mix", mix_sources),
    ("tokens", encode_tokens),
]

#: SQL can't express the model, the suffix removal and the tokens; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again before the next."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        found = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            found = scratch.write(found)
            scratch.release(docs)
        docs = found
    return docs
