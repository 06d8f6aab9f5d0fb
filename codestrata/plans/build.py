"""Queries that build the code map from sources, and that rebuild it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.engine import CodeMap
from codestrata.operators import incremental, snapshot
from codestrata.session import table
from codestrata.sources.extract import extract_facts


def current_sources(files: DataFrame) -> DataFrame:
    """(repo, path, source) of the newest scan of each path. Ids are reduced first; sources move once, to meet them."""
    newest = files.groupBy("repo", "path").agg(F.max("file_id").alias("file_id")).select("file_id")
    return files.join(newest, "file_id", "left_semi").select("repo", "path", "source")


def code_map(spark: SparkSession, sf_dir: str) -> CodeMap:
    modules = table(spark, sf_dir, "go_contexts").where("module_path is not null").select("repo", "module_path").distinct()
    return CodeMap(current_sources(table(spark, sf_dir, "files")), modules)


def build_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations extracted from the sources."""
    return code_map(spark, sf_dir).symbols


def build_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import edges resolved from the sources."""
    return code_map(spark, sf_dir).imports


def build_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_map(spark, sf_dir).exports


def build_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_map(spark, sf_dir).calls


def build_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_map(spark, sf_dir).references


def build_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many symbols of the table the extractor finds again, by kind (files it could read)."""
    m = code_map(spark, sf_dir)
    keys = ["repo", "file", "name", "kind"]
    listed = table(spark, sf_dir, "symbols").select(*keys).distinct().join(m.facts.where("fact <> 'unparsable'").select("repo", "file").distinct(), ["repo", "file"], "left_semi")
    found = m.facts.where("fact = 'decl'").select(*keys).distinct().withColumn("__there", F.lit(True))
    return listed.join(found, keys, "left").groupBy("kind").agg(F.count("*").alias("listed"), F.count("__there").alias("found"))


def build_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a rebuild of the newest scans parses and what it takes from a cache of the first scans."""
    files = table(spark, sf_dir, "files")
    oldest = files.groupBy("repo", "path").agg(F.min("file_id").alias("file_id")).select("file_id")
    plain = ~F.contains("path", F.lit("#"))
    _, cache, _ = snapshot.rebuild(files.join(oldest, "file_id", "left_semi").where(plain).select("repo", "path", "source"), extract_facts)
    return snapshot.rebuild(current_sources(files).where(plain), extract_facts, cache)[2]


def build_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of each repository in pages of 25."""
    paths = table(spark, sf_dir, "files").select("repo", "path").distinct()
    return snapshot.pages(paths, ["repo"], ["path"], 25).withColumn("page", F.col("page").cast("long"))


def build_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with effective changes, kept where they are indexed."""
    changes = table(spark, sf_dir, "file_changes")
    effective = incremental.effective_changes(changes).join(changes.select("change_id", "repo"), "change_id").select("repo", "path")
    indexed = table(spark, sf_dir, "files").select("repo", "path").distinct()
    return snapshot.keep_indexable(snapshot.dirty_paths(effective), indexed, indexed)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (build_symbols, build_imports, build_exports, build_calls, build_references, build_confirmed, build_cached, build_pages, build_dirty)}


def oracle_sql() -> dict[str, str]:
    return {
        "build_cached": """with k as (select repo, path, file_id, regexp_extract(path, '\\.[^.]*$') || sha256(source) as key from files where source is not null and not contains(path, '#')),
            a as (select distinct arg_min(key, file_id) as key from k group by repo, path), b as (select repo, path, arg_max(key, file_id) as key from k group by repo, path)
            select count(distinct key) filter (key not in (select key from a)) as parsed, count(*) filter (key in (select key from a)) as cached, count(*) as files from b""",
        "build_pages": "select repo, path, (row_number() over (partition by repo order by path) - 1) // 25 as page from (select distinct repo, path from files)",
        "build_dirty": """with numbered as (select *, row_number() over (partition by checkout_id, path, commit_sha order by arrived_at, change_id) as rn from file_changes),
            counting as (select *, lag(content_sha) over w as before, row_number() over w as n from numbered where commit_sha is null or rn = 1 window w as (partition by checkout_id, path order by arrived_at, change_id))
            select distinct repo, path from counting where (n = 1 or content_sha is distinct from before) and (repo, path) in (select repo, path from files)""",
    }
