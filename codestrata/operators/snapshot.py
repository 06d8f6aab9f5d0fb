"""Incremental rebuilding: what is dirty, what the parse cache still knows, which summaries are stale."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.ids import lang_of
from codestrata.operators.bucketed import running


def dirty_paths(*sources: DataFrame) -> DataFrame:
    """(repo, path): the union of everything that may have changed (queue, working tree, commits since), each once."""
    rows = None
    for source in sources:
        part = source.select("repo", "path")
        rows = part if rows is None else rows.unionByName(part)
    return rows.where("repo is not null and path is not null").distinct()


def keep_indexable(dirty: DataFrame, indexable: DataFrame, indexed: DataFrame) -> DataFrame:
    """Dirty paths that can be indexed now, or were indexed before and must be taken out."""
    return dirty.join(indexable.select("repo", "path").unionByName(indexed.select("repo", "path")).distinct(), ["repo", "path"], "left_semi")


def may_skip(states: DataFrame, heads: DataFrame, dirty: DataFrame) -> DataFrame:
    """(repo, skip): whether nothing has to be done: nothing dirty, the head indexed, the tree clean, the configuration equal.

    states is (repo, last_indexed_commit, tree_clean, config_hash), heads (repo, head, config_hash).
    """
    joined = heads.join(states.withColumnRenamed("config_hash", "__config"), "repo", "left").join(dirty.select("repo").distinct().withColumn("__dirty", F.lit(True)), "repo", "left")
    same = (F.col("head") == F.col("last_indexed_commit")) & F.col("tree_clean") & (F.col("config_hash") == F.col("__config")) & F.col("__dirty").isNull()
    return joined.select("repo", F.coalesce(same, F.lit(False)).alias("skip"))


def content_keys(files: DataFrame) -> DataFrame:
    """files with `key`, the language and hash that decide what a file's facts are, apart from its path."""
    return files.withColumn("key", F.concat_ws(":", lang_of(F.col("path")), F.sha2(F.encode("source", "UTF-8"), 256)))


def rebuild(files: DataFrame, extract: Callable[[DataFrame], DataFrame], cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, new cache, counts): facts of files (repo, path, source) from the cache where it knows the content.

    Only one file of each unknown content is parsed; its facts are stamped with every (repo, path) that holds it.
    Extraction must not depend on the path beyond its language (true for all extractors here but workflow,
    chart and manifest files, which should be passed to them directly). The new cache keeps used keys only;
    counts is one row (parsed, cached, files). The result equals a full extraction of all files.
    """
    keyed = content_keys(files.where("source is not null and path is not null"))
    wanted = keyed.select("key").distinct()
    known = cache.join(wanted, "key", "left_semi") if cache is not None else None
    missing = wanted if known is None else wanted.join(known.select("key").distinct(), "key", "left_anti")
    one = keyed.join(missing, "key", "left_semi").groupBy("key").agg(F.min_by(F.struct("repo", "path", "source"), F.struct("repo", "path")).alias("__f"))
    # the key travels in the repository column: extractors pass it through
    parsed = extract(one.select(F.col("key").alias("repo"), "__f.path", "__f.source"))
    parsed = parsed.withColumnRenamed("repo", "key").drop("file")
    # a file without facts still has a cache row, so that it isn't parsed again
    names = parsed.columns
    empty = one.select("key").join(parsed.select("key").distinct(), "key", "left_anti").select(*[F.col("key") if c == "key" else F.lit("none" if c == "fact" else None).cast(parsed.schema[c].dataType).alias(c) for c in names])
    fresh = parsed.unionByName(empty)
    store = fresh if known is None else known.unionByName(fresh)
    facts = keyed.select("key", "repo", F.col("path").alias("file")).join(store.where("fact <> 'none'"), "key").drop("key")
    counts = keyed.select("repo", "path", "key").distinct().join(missing.withColumn("__new", F.lit(True)), "key", "left").agg(F.countDistinct(F.when(F.col("__new"), F.col("key"))).alias("parsed"), F.count_if(F.col("__new").isNull()).alias("cached"), F.count("*").alias("files"))
    return facts, store, counts


def summary_states(files: DataFrame, summaries: DataFrame) -> DataFrame:
    """(repo, path, state, text): fresh, stale or none for each file (repo, path, sha256); summaries are
    (path, sha256, text, refreshed_at). The newest summary of a path counts, ties to the least hash; a stale one keeps its text."""
    order = Window.partitionBy("path").orderBy(F.desc("refreshed_at"), "sha256")
    newest = summaries.withColumn("__n", F.row_number().over(order)).where("__n = 1").select("path", F.col("sha256").alias("__old"), F.col("text").alias("__stale"))
    exact = summaries.groupBy("sha256").agg(F.max_by("text", F.struct("refreshed_at", "path")).alias("__fresh"))
    rows = files.select("repo", "path", "sha256").join(exact, "sha256", "left").join(newest, "path", "left")
    state = F.when(F.col("__fresh").isNotNull(), "fresh").when(F.col("__stale").isNotNull(), "stale").otherwise("none")
    return rows.select("repo", "path", state.alias("state"), F.coalesce("__fresh", "__stale").alias("text"))


def refresh_batches(states: DataFrame, size: int = 12) -> DataFrame:
    """(repo, path, batch): files whose summary isn't fresh, in path order, `size` to a batch of one repository."""
    rows = running(states.where("state <> 'fresh'").select("repo", "path"), ["repo"], ["path"], "__place")
    return rows.select("repo", "path", F.floor((F.col("__place") - 1) / size).cast("int").alias("batch"))


def largest_that_fits(rows: DataFrame, keys: list[str], order: list, text: str, budget: int) -> DataFrame:
    """Rows of each key in order, as long as the estimated tokens of `text` so far stay within the budget."""
    from codestrata.functions.ids import estimate_tokens

    return running(rows, keys, order, "__sum", estimate_tokens(F.col(text)).cast("long")).where(F.col("__sum") <= budget).drop("__sum")


def pages(rows: DataFrame, keys: list[str], order: list, cap: int = 25) -> DataFrame:
    """Rows with `page`: sorted rows of each key in chunks of `cap`."""
    return running(rows, keys, order, "__place").withColumn("page", F.floor((F.col("__place") - 1) / cap).cast("int")).drop("__place")


def next_route(path: Column) -> Column:
    """The route a file of a Next application serves, from its path: null for files that serve none.

    `app/(group)/a/[id]/page.tsx` -> `/a/[id]`; groups and slots leave no step; `pages/a/index.tsx` -> `/a`.
    """
    app = F.regexp_extract(path, r"(?:^|/)app/(.*?)/?(?:page|route)\.(?:tsx?|jsx?)$", 1)
    plain = F.array_join(F.filter(F.split(app, "/"), lambda s: (s != "") & ~s.rlike(r"^\(.*\)$") & ~s.startswith("@")), "/")
    page = F.regexp_replace(F.regexp_extract(path, r"(?:^|/)pages/(.*)\.(?:tsx?|jsx?)$", 1), r"(^|/)index$", "")
    return F.when(path.rlike(r"(^|/)app/(.*/)?(page|route)\.(tsx?|jsx?)$"), F.concat(F.lit("/"), plain)).when(path.rlike(r"(^|/)pages/(?!_).*\.(tsx?|jsx?)$"), F.concat(F.lit("/"), page))
