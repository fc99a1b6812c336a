"""The queries of this subpackage: one opN_<name> for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from packsight.llm import decontam, langid, mixing, quality, search, simhash, substrings, tokens, toxicity, urls
from packsight.llm.common import table


def _docs(run: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(table(spark, sf_dir, "documents"))


def _labelled(run: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": _docs(mixing.mix_sources),
        "op2_decontaminate": lambda spark, sf_dir: decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
        "op3_token_ids": _docs(tokens.token_table),
        "op4_language_id": _docs(langid.identify),
        "op5_toxicity": _labelled(toxicity.score_toxicity),
        "op6_url_filter": lambda spark, sf_dir: urls.filter_urls(table(spark, sf_dir, "pages")),
        "op7_substrings": _docs(substrings.query),
        "op8_quality": _labelled(quality.score_quality),
        "op9_bm25_search": _docs(search.query),
        "op10_simhash": _docs(simhash.query),
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.SQL, "op6_url_filter": urls.SQL, "op7_substrings": substrings.SQL, "op9_bm25_search": search.SQL}
