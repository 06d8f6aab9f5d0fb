"""Queries of the llm subpackage, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import handwritten, leakage, mixing, reading, unparsable
from codestrata.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, sf_dir, "files"))


def p3_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.origins(table(spark, sf_dir, "files"))


def p3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the path rules alone say of each file."""
    files = table(spark, sf_dir, "files").where("file_id is not null")
    return files.select("file_id", *[rule.alias(name) for name, rule in handwritten.path_rules(F.col("path")).items()])


def p3_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents, but for line ends, of more than one file: how many files hold each."""
    keyed = table(spark, sf_dir, "files").select(handwritten.content_key().alias("content")).where("content is not null")
    return keyed.groupBy("content").agg(F.count("*").alias("files")).where("files > 1")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unparsable.unparsable_files(table(spark, sf_dir, "files"))


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unparsable.invalid_rates(table(spark, sf_dir, "files"), table(spark, sf_dir, "build_results"))


def p5_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What it takes to repair each file that is not valid, where, and why."""
    return unparsable.checked_files(table(spark, sf_dir, "files")).where("edit_cost > 0")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where in the original text of each document a passage stands."""
    return leakage.leaked_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks_per_item(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus: every document's columns, its shard and its place there, copies and all."""
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares_reached(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "level_labels")).select("doc_id", "level")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p3_found, p3_origins, p3_paths, p3_copies, p5_found, p5_rates, p5_repairs, p6_found, p6_spans, p6_items, p7_mixture, p7_shares, p8_found)}


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"coalesce(regexp_matches(path, {_quoted(pattern)}), false) as {name}" for name, pattern in handwritten.PATH_RULES.items())
    text = "trim(regexp_replace(source, '[ \\t]*(\\r\\n|\\r|\\n)', chr(10), 'g'), ' ')"
    return {
        "p3_paths": f"select file_id, {rules} from files where file_id is not null",
        "p3_copies": f"select sha256(t) as content, count(*) as files from (select regexp_replace({text}, '\\n+$', '') as t from files where source is not null) where trim(t, ' ') <> '' group by 1 having count(*) > 1",
    }
