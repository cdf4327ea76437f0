"""Queries opN_<name> over the driver's tables, each a thin layer over one operator."""

from __future__ import annotations

import public_tokenizers

import corpus_pipeline

from chartstone.llm import ann, bpe_automaton, langid, licenses, line_dedup, packing, quality, simhash, token_files, url_filter
from chartstone.llm.common import table

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def op1_url_filter(spark, sf_dir):
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), "page_id", "url")


def op2_token_files(spark, sf_dir):
    return token_files.token_table(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op3_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_language_id(spark, sf_dir):
    return langid.language_table(table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_bpe_automaton(spark, sf_dir):
    return bpe_automaton.encoding_table(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op10_line_dedup(spark, sf_dir):
    return line_dedup.line_table(table(spark, sf_dir, "documents"))


def op6_simhash(spark, sf_dir):
    return simhash.simhash_table(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark, sf_dir):
    return quality.quality_table(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_url_filter": op1_url_filter,
    "op2_token_files": op2_token_files,
    "op3_license_scan": op3_license_scan,
    "op4_language_id": op4_language_id,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op7_bpe_automaton": op7_bpe_automaton,
    "op10_line_dedup": op10_line_dedup,
    "op6_simhash": op6_simhash,
    "op9_quality_rules": op9_quality_rules,
    "op8_best_fit_packing": op8_best_fit_packing,
}
ORACLES = {
    **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}),
    "op1_url_filter": url_filter.oracle(),
    "op3_license_scan": licenses.oracle(),
    "op9_quality_rules": quality.oracle(),
    "op10_line_dedup": line_dedup.oracle(),
}
