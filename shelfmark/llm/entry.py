"""Queries of the training-data operators, as (spark, sf_dir) functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import bpe, chat, decontaminate, lexical, linededup, neardup, pii, prefixtrie, quality, substrings, suffixtree, urlfilter, warc
from shelfmark.llm.common import table


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.verdicts(table(spark, sf_dir, "documents"))


def op9_superkmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.verdicts(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.verdicts(table(spark, sf_dir, "documents"))


def op4_suffixtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.score_documents(table(spark, sf_dir, "documents"))


def op2_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"))


def op8_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolved_pages(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_preferences": op2_preferences,
    "op3_lines": op3_lines,
    "op4_suffixtree": op4_suffixtree,
    "op5_quality": op5_quality,
    "op7_pii": op7_pii,
    "op8_revisits": op8_revisits,
    "op9_superkmers": op9_superkmers,
    "op10_bpe": op10_bpe,
    "op6_decontaminate": op6_decontaminate,
    "op11_treaps": lexical.op11_treaps,
    "op12_prefixtrie": prefixtrie.op12_prefixtrie,
    "op13_urlfilter": urlfilter.op13_urlfilter,
}

ORACLES: dict[str, str] = {
    "op2_preferences": chat.FORMATTED_SQL,
    "op3_lines": linededup.VERDICTS_SQL,
    "op8_revisits": warc.RESOLVED_SQL,
    "op11_treaps": lexical.TREAPS_SQL,
    "op12_prefixtrie": prefixtrie.PREFIXTRIE_SQL,
    "op13_urlfilter": urlfilter.URLFILTER_SQL,
}
