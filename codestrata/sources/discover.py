"""Reading source trees and committed maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.ids import count_loc, glob_pattern, is_mappable, lang_of

MAP_SCHEMAS = {
    "symbols": "exported boolean, extends string, file string, id string, kind string, meta map<string,string>, name string, parent string, signature string, span array<int>, visibility string",
    "imports": "confidence string, `from` string, importKind string, kind string, specifier string, symbols array<string>, `to` string",
    "calls": "confidence string, `from` string, line int, `to` string",
    "references": "confidence string, `from` string, refKind string, symbols array<string>, `to` string",
}


def discover(spark: SparkSession, root: str, repo: str, include: list[str] | None = None, exclude: list[str] | None = None, languages: list[str] | None = None) -> DataFrame:
    """(repo, path, lang, sha256, loc, source) of the files under root; include, then exclude globs, mappable paths only.

    Paths are filtered before contents are used; dotfiles are seen, links are not followed.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file:")
    rows = found.withColumn("path", F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^\\Q{base}\\E/", ""))
    rows = rows.where(is_mappable(F.col("path")))
    if include:
        rows = rows.where(F.col("path").rlike("|".join(map(glob_pattern, include))))
    if exclude:
        rows = rows.where(~F.col("path").rlike("|".join(map(glob_pattern, exclude))))
    rows = rows.withColumn("lang", lang_of(F.col("path"))).where("lang is not null")
    if languages:
        rows = rows.where(F.col("lang").isin(*languages))
    text = F.decode("content", "UTF-8")
    return rows.select(F.lit(repo).alias("repo"), "path", "lang", F.sha2("content", 256).alias("sha256"), count_loc(text).cast("int").alias("loc"), text.alias("source"))


def read_map(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The committed JSONL tables under root/graph, by name; an absent table is empty; a broken line raises."""
    jvm = spark.sparkContext._jvm
    out = {}
    for name, schema in MAP_SCHEMAS.items():
        path = f"{root}/graph/{name}.jsonl"
        place = jvm.org.apache.hadoop.fs.Path(path)
        there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
        out[name] = spark.read.schema(schema).json(path, mode="FAILFAST") if there else spark.createDataFrame([], schema)
    return out
