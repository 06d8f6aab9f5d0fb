"""Several repositories as one: workspace ids, cross edges, impact over all, and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.operators import compare, graph, resolve


def workspace_id(repo: Column, local: Column) -> Column:
    """`repo::local`."""
    return F.concat(repo, F.lit("::"), local)


def split_workspace_id(id_: Column) -> Column:
    """struct(repo, local) of a workspace id; null for any other."""
    at = F.instr(id_, "::")
    return F.when(at > 1, F.struct(F.substring_index(id_, "::", 1).alias("repo"), F.substring(id_, at + 2, F.length(id_)).alias("local")))


def cross_targets(cross: DataFrame, packages: DataFrame, files: DataFrame) -> DataFrame:
    """Cross edges (from_repo, from_path, to_repo, to_pkg, specifier) down to files: (from_repo, from_path, to_repo, to_path).

    The directory that the rest of the specifier names inside the package, if it holds files, else the package's
    own directory; every file in it is a target.
    """
    within = cross.join(packages.select(F.col("repo").alias("to_repo"), F.col("pkg").alias("to_pkg"), "dir"), ["to_repo", "to_pkg"])
    rest = F.expr("substring(specifier, length(to_pkg) + 2)")
    base = F.when(F.col("dir") == ".", "").otherwise(F.concat("dir", F.lit("/")))
    inner = F.when(rest == "", F.col("dir")).otherwise(F.concat(base, rest))
    held = files.select(F.col("repo").alias("to_repo"), F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(".").alias("__dir"), F.col("path").alias("to_path")).distinct()
    exact = within.withColumn("__dir", inner).join(held, ["to_repo", "__dir"])
    keys = ["from_repo", "from_path", "to_repo", "to_pkg", "specifier"]
    rest_of = within.join(exact.select(*keys).distinct(), keys, "left_anti").withColumn("__dir", F.col("dir")).join(held, ["to_repo", "__dir"])
    return exact.select("from_repo", "from_path", "to_repo", "to_path").unionByName(rest_of.select("from_repo", "from_path", "to_repo", "to_path")).distinct()


def workspace_pairs(pairs: DataFrame, crossing: DataFrame) -> DataFrame:
    """Edges (repo `*`, src, dst) over workspace ids: every repository's own pairs and the crossing ones."""
    own = pairs.select(F.lit("*").alias("repo"), workspace_id(F.col("repo"), F.col("src")).alias("src"), workspace_id(F.col("repo"), F.col("dst")).alias("dst"))
    far = crossing.select(F.lit("*").alias("repo"), workspace_id(F.col("from_repo"), F.col("from_path")).alias("src"), workspace_id(F.col("to_repo"), F.col("to_path")).alias("dst"))
    return own.unionByName(far).distinct()


def impact_across(pairs: DataFrame, crossing: DataFrame, targets: DataFrame, most_depth: int | None = None) -> DataFrame:
    """(target, node, depth) over all repositories; targets is (target), workspace ids."""
    found = graph.impact(workspace_pairs(pairs, crossing), targets.select(F.lit("*").alias("repo"), "target"), most_depth)
    return found.select("target", "node", "depth")


def repo_graph(cross: DataFrame) -> DataFrame:
    """(from_repo, to_repo, n): how many imports cross between two repositories."""
    return cross.groupBy("from_repo", "to_repo").agg(F.count("*").alias("n"))


def query_across(symbols: DataFrame, needle: str) -> DataFrame:
    """(id, tier): symbol search over all repositories, by workspace ids."""
    found = resolve.find_symbols(symbols, symbols.sparkSession.createDataFrame([(needle,)], "needle string"))
    return found.select(workspace_id(F.col("repo"), F.col("id")).alias("id"), "tier")


def verify_workspace(expected: DataFrame, found: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(repo, state, n): drift per repository; a repository without any rows is `unmapped`."""
    drift = compare.verify(expected, found, ["repo", *keys], value).groupBy("repo", "state").agg(F.count("*").alias("n"))
    absent = expected.select("repo").distinct().join(found.select("repo").distinct(), "repo", "left_anti")
    known = drift.join(absent, "repo", "left_anti")
    return known.unionByName(absent.select("repo", F.lit("unmapped").alias("state"), F.lit(0).cast("long").alias("n")))
