"""The corpus pipeline: each stage takes what the one before it kept.

Stages, in order: toxic documents go; duplicate lines go; of each group of linked
documents the one of the smallest doc_id stays; documents that hold a benchmark item
go; what is left is encoded by byte-level BPE and decoded again.

Defined cases, of all stages: each row is judged by its own text, also where its
doc_id is null or that of other rows; rows with null or empty texts are clean, hold
nothing and stay; other columns are kept as they are; an empty table stays empty.
Where doc_ids repeat or are null, rows are told apart by numbers, of which the
smaller one goes before.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from voxstrata.llm import byte_bpe, decontaminate, line_dedup, ngram_join, toxicity
from voxstrata.llm.common import small_batches, table, with_key, written
from voxstrata.llm.components import sized


def drop_toxic(spark, docs, sf_dir):
    """Rows scored under 0.5 stay; learnt from the labels of documents that are still here and aren't held out."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark, docs, sf_dir):
    """Texts without their duplicate lines, n_chars (if there is one) with them; a row that loses all its lines but blank ones goes."""
    keyed, key = with_key(docs, "doc_id")
    out = line_dedup.without_duplicates(keyed, key)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def drop_copies(spark, docs, sf_dir):
    """Of rows linked by shared shingles of five words, at a similarity of 0.8, the one of the smallest doc_id stays."""
    keyed, key = with_key(docs, "doc_id")
    groups = ngram_join.link_documents(keyed, size=5, per_cent=80, doc_id=key)
    copies = written(groups.where("doc_id <> component_id").select(F.col("doc_id").alias(key)), "copies")
    return keyed.join(sized(copies, copies.count()), key, "left_anti").select(docs.columns)


def drop_leaks(spark, docs, sf_dir):
    """Rows that hold no benchmark item stay."""
    keyed, key = with_key(docs, "doc_id")
    return decontaminate.clean(keyed, table(spark, sf_dir, "benchmark"), key).select(docs.columns)


def encode(spark, docs, sf_dir):
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document that is left."""
    with small_batches(spark):  # written here: batches are cut when they are read
        return written(byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests_only=True), "encoded")


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("ngram_join", drop_copies), ("decontamination", drop_leaks), ("byte_bpe", encode)]

#: SQL expresses neither the classifier nor the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents, each written as Parquet and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
