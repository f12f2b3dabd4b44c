"""The queries of this subpackage over a data folder, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seedloom.llm import format_copies, lookalike, mixing, near_copies, packing, pair_defects
from seedloom.llm.sql import ORACLES
from seedloom.session import cut, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return format_copies.example_copies(table(spark, d, "examples"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near_copies.near_examples(table(spark, d, "examples"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pair_defects.example_defects(table(spark, d, "examples"), table(spark, d, "documents"))


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "pack_spec"))


def p6_room(spark: SparkSession, d: str) -> DataFrame:
    return packing.room(p6_pack(spark, d))


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    return packing.check(cut(p6_pack(spark, d), "placed"), "doc_id")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, d, "documents"), "doc_id", "text", "source", table(spark, d, "mix_target"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    return mixing.check(*_mixed(spark, d), table(spark, d, "documents"), "doc_id", "source", 0.001)


def p8_form(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.one_form(table(spark, d, "documents"), "doc_id", "text")


def p2_collapsed(spark: SparkSession, d: str) -> DataFrame:
    rows = format_copies.positive_rows(table(spark, d, "examples"))
    return format_copies.collapse(rows, "example_id", ["input", "output", "explanation"], "input", "loaded_at")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_looks(table(spark, d, "documents"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_collapsed, p3_found, p4_found, p6_pack, p6_room, p6_check, p7_mix, p7_shares, p7_check, p8_found, p8_form)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
