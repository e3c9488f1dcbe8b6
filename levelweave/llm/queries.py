"""Queries of problems 5 to 7. None has an equivalent in SQL; tests/llm holds their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from levelweave.llm.leakage import leaked
from levelweave.llm.packing import TOKENIZERS, container_fill, pack
from levelweave.llm.toxicity import rates, score
from levelweave.tables import table


def p5_pack(spark: SparkSession, d: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return pack(table(spark, d, "documents"), tokenizers=tokenizers)


def p5_containers(spark: SparkSession, d: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return container_fill(pack(table(spark, d, "documents"), tokenizers=tokenizers))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return score(table(spark, d, "documents"), table(spark, d, "labels")).filter("toxic").select("doc_id").distinct()


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    return rates(score(table(spark, d, "documents"), table(spark, d, "labels")))


QUERIES = {q.__name__: q for q in (p5_pack, p5_containers, p6_found, p7_found, p7_rates)}
SQL: dict[str, str] = {}
