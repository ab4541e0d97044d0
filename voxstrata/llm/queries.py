"""The operators' queries over the driver's tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame

from voxstrata.llm import byte_bpe, cover_tree, decontaminate, license_scan, line_dedup, lm_trie, ngram_join, periodic_runs, spelling, token_counts, toxicity, url_filter, warc
from voxstrata.llm.common import table


def op1_ngram_join(spark, sf_dir) -> DataFrame:
    return ngram_join.link_documents(table(spark, sf_dir, "documents"), size=3, per_cent=90).drop("n_links")


def op2_url_filter(spark, sf_dir) -> DataFrame:
    return url_filter.query(spark, sf_dir)


def op3_cover_tree(spark, sf_dir) -> DataFrame:
    return cover_tree.query(spark, sf_dir)


def op4_toxicity_crf(spark, sf_dir) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_lm_trie(spark, sf_dir) -> DataFrame:
    return lm_trie.score_documents(table(spark, sf_dir, "documents"))


def op6_warc(spark, sf_dir) -> DataFrame:
    return warc.roundtrip(table(spark, sf_dir, "pages")).drop("valid")


def op7_line_dedup(spark, sf_dir) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark, sf_dir) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_byte_bpe(spark, sf_dir) -> DataFrame:
    return byte_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests_only=True)


def op10_token_counts(spark, sf_dir) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_periodic_runs(spark, sf_dir) -> DataFrame:
    return periodic_runs.report(periodic_runs.periodic_runs(periodic_runs.planted(table(spark, sf_dir, "documents")), exponent=4, least=6))


def op12_spelling(spark, sf_dir) -> DataFrame:
    return spelling.variants(spelling.count_words(table(spark, sf_dir, "documents"), letters=7, least=2, change=spelling.dropped_letter))


def op13_license_scan(spark, sf_dir) -> DataFrame:
    return license_scan.report(license_scan.scan_licenses(table(spark, sf_dir, "documents")))


def queries():
    return {
        f.__name__: f
        for f in (
            op1_ngram_join,
            op2_url_filter,
            op3_cover_tree,
            op4_toxicity_crf,
            op5_lm_trie,
            op6_warc,
            op7_line_dedup,
            op8_decontaminate,
            op9_byte_bpe,
            op10_token_counts,
            op11_periodic_runs,
            op12_spelling,
            op13_license_scan,
        )
    }


def oracle_sql():
    return {"op1_ngram_join": ngram_join.ORACLE, "op2_url_filter": url_filter.ORACLE, "op3_cover_tree": cover_tree.ORACLE, "op6_warc": warc.ORACLE}
