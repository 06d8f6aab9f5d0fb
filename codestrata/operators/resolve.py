"""Joins that resolve names to what they mean: unique or dropped, never guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.ids import ancestors, directory_of, glob_pattern, suffixes


def unique_or_none(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and `value` for those keys that have exactly one distinct value."""
    found = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("__most"))
    return found.where(F.col(value) == F.col("__most")).drop("__most")


def package_of(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(repo, path, pkg): the deepest package directory above each file. packages is (repo, pkg, dir), '.' the root.

    The longest-prefix join as an equi-join: every ancestor of a path against package directories.
    """
    above = files.select("repo", "path").distinct().select("repo", "path", F.explode(ancestors(F.col("path"))).alias("dir"))
    return above.join(packages, ["repo", "dir"]).groupBy("repo", "path").agg(F.max_by("pkg", F.when(F.col("dir") == ".", 0).otherwise(F.length("dir"))).alias("pkg"))


def package_metrics(files: DataFrame, packages: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, pkg, files, loc, deps, rdeps): packages without files keep zeros; lists are sorted and comma-joined.

    files is (repo, path, loc) with one row per path; edges are unexpanded import pairs (repo, src, dst).
    """
    owned = package_of(files, packages)
    sums = files.join(owned, ["repo", "path"]).groupBy("repo", "pkg").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))
    links = package_edges(files, packages, edges)
    deps = links.groupBy("repo", F.col("from_pkg").alias("pkg")).agg(F.array_join(F.array_sort(F.collect_set("to_pkg")), ",").alias("deps"))
    rdeps = links.groupBy("repo", F.col("to_pkg").alias("pkg")).agg(F.array_join(F.array_sort(F.collect_set("from_pkg")), ",").alias("rdeps"))
    joined = packages.select("repo", "pkg").distinct()
    for part in (sums, deps, rdeps):
        joined = joined.join(part, ["repo", "pkg"], "left")
    zero, none = F.lit(0).cast("long"), F.lit("")
    return joined.select("repo", "pkg", *[F.coalesce(c, zero).alias(c) for c in ("files", "loc")], *[F.coalesce(c, none).alias(c) for c in ("deps", "rdeps")])


def package_edges(files: DataFrame, packages: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, from_pkg, to_pkg, n): import pairs between different packages, counted as statements.

    A directory target belongs to the package of the directory itself.
    """
    ends = edges.select("repo", F.explode(F.array("src", "dst")).alias("path")).distinct()
    # a directory is looked up as if a file lay in it
    as_files = ends.select("repo", "path", F.when(F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"\.", 0) != "", F.col("path")).otherwise(F.concat(F.col("path"), F.lit("/."))).alias("probe"))
    owner = package_of(as_files.select("repo", F.col("probe").alias("path")), packages).toDF("repo", "probe", "pkg")
    of = as_files.join(owner, ["repo", "probe"]).select("repo", "path", "pkg")
    both = edges.join(of.toDF("repo", "src", "from_pkg"), ["repo", "src"]).join(of.toDF("repo", "dst", "to_pkg"), ["repo", "dst"])
    return both.where("from_pkg <> to_pkg").groupBy("repo", "from_pkg", "to_pkg").agg(F.count("*").alias("n"))


def probe(candidates: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """keys and path: of each key's ordered `candidates` (array column) the first that is a file (repo, path)."""
    tried = candidates.select("repo", *keys, F.posexplode("candidates").alias("place", "path"))
    found = tried.join(files.select("repo", "path").distinct(), ["repo", "path"])
    return found.groupBy("repo", *keys).agg(F.min_by("path", "place").alias("path"))


def by_unique_suffix(tokens: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, token, path): tokens that equal a path, or are the suffix of exactly one."""
    ends = files.select("repo", "path").distinct().select("repo", "path", F.explode(suffixes(F.col("path"))).alias("token"))
    rank = F.when(F.col("path") == F.col("token"), 0).otherwise(1)
    ranked = ends.withColumn("__rank", rank)
    best = ranked.groupBy("repo", "token").agg(F.min(F.struct("__rank", "path")).alias("__best"), F.count("*").alias("__n"))
    single = best.where("__n = 1 or __best.__rank = 0").select("repo", "token", F.col("__best.path").alias("path"))
    return tokens.select("repo", "token").distinct().join(single, ["repo", "token"])


def subset_matches(selectors: DataFrame, labelled: DataFrame) -> DataFrame:
    """(selector, item): selectors all of whose labels exactly one item carries. Labels are maps; empty selectors match none.

    Relational division: label pairs are exploded on both sides and counted.
    """
    wanted = selectors.where("size(labels) > 0").select("selector", F.size("labels").alias("__n"), F.explode("labels").alias("k", "v"))
    there = labelled.select("item", F.explode("labels").alias("k", "v"))
    full = wanted.join(there, ["k", "v"]).groupBy("selector", "item").agg(F.count("*").alias("__got"), F.first("__n").alias("__n")).where("__got = __n")
    return unique_or_none(full, ["selector"], "item")


def importers_of(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, path, importer): who imports each file, by its own id or that of its directory; itself excluded."""
    ids = files.select("repo", "path").distinct().select("repo", "path", F.explode(F.array(F.col("path"), directory_of(F.col("path")))).alias("to_id"))
    edges = imports.where("kind in ('import', 'reexport')").select("repo", "to_id", F.col("from_path").alias("importer")).distinct()
    return ids.join(edges, ["repo", "to_id"]).where("importer <> path").select("repo", "path", "importer").distinct()


def symbol_importers(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, id, importer): files whose import names an exported symbol or takes its whole file or directory."""
    wide = imports.where("kind in ('import', 'reexport') and from_path is not null").select("repo", "to_id", F.col("from_path").alias("importer"), F.explode("symbols").alias("taken")).distinct()
    keys = symbols.where("exported").select("repo", "id", "file", "name").distinct()
    by_file = keys.withColumn("to_id", F.col("file")).select("*", F.explode(F.array(F.col("name"), F.lit("*"))).alias("taken"))
    by_directory = keys.withColumn("to_id", directory_of(F.col("file"))).withColumn("taken", F.lit("*"))
    hits = by_file.unionByName(by_directory).join(wide, ["repo", "to_id", "taken"])
    return hits.where("importer <> file").select("repo", "id", "importer").distinct()


def callers(calls: DataFrame) -> DataFrame:
    """(repo, src, dst, line, confidence): call edges once per pair, with the first line and the better confidence."""
    best = F.when(F.bool_or(F.col("confidence") == "high"), "high").otherwise("med")
    return calls.groupBy("repo", "src", "dst").agg(F.min("line").alias("line"), best.alias("confidence"))


def find_symbols(symbols: DataFrame, needles: DataFrame) -> DataFrame:
    """(needle, tier, repo, id): exact id, else exact name, else a name that ends in `.needle`; the first tier that has any.

    Each symbol is keyed once per tier, so the search is an equi-join for any number of needles.
    """
    name = F.col("name")
    parts = F.split(name, r"\.")
    tails = F.filter(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), ".")), lambda t: t != "")
    keys = F.concat(
        F.array(F.struct(F.lit(1).alias("tier"), F.col("id").alias("needle")), F.struct(F.lit(2).alias("tier"), name.alias("needle"))),
        F.when(F.size(parts) > 1, F.transform(tails, lambda t: F.struct(F.lit(3).alias("tier"), t.alias("needle")))).otherwise(F.array().cast("array<struct<tier:int,needle:string>>")),
    )
    keyed = symbols.select("repo", "id", F.explode(keys).alias("__key")).select("repo", "id", "__key.tier", "__key.needle").distinct()
    hits = keyed.join(needles.where("needle <> ''").select("needle").distinct(), "needle")
    first = hits.groupBy("needle").agg(F.min("tier").alias("tier"))
    return hits.join(first, ["needle", "tier"]).select("needle", "tier", "repo", "id")


def nearest_ids(needle: str, symbols: DataFrame, most: int = 5) -> DataFrame:
    """The `most` closest names: those that contain the needle first, then by edit distance up to half its length (4 at least)."""
    cutoff = max(4, -(-len(needle) // 2))
    distance = F.levenshtein(F.lower("name"), F.lit(needle.lower()), cutoff)
    names = symbols.select("name").distinct().select("name", F.when(F.contains(F.lower("name"), F.lit(needle.lower())), 0).otherwise(1).alias("tier"), distance.alias("distance"))
    order = [F.col("tier"), F.when(F.col("tier") == 0, 0).otherwise(F.col("distance")), F.col("name")]
    return names.where("tier = 0 or distance >= 0").orderBy(*order).limit(most).select("name", "tier")


def cross_edges(imports: DataFrame, published: DataFrame) -> DataFrame:
    """(from_repo, from_path, to_repo, to_pkg, specifier): external imports that a sibling repository publishes.

    published is (repo, pkg). A specifier matches the longest published name that equals it or heads it on a '/'
    boundary; a name published by two siblings gives no edge.
    """
    outside = imports.where("to_id like 'ext:%' or to_id like 'unresolved:%'").select(F.col("repo").alias("from_repo"), "from_path", "specifier").distinct()
    heads = F.array_union(F.array(F.col("specifier")), F.filter(ancestors(F.col("specifier")), lambda d: d != "."))
    tried = outside.select("*", F.explode(heads).alias("to_pkg"))
    owners = unique_or_none(published.select(F.col("pkg").alias("to_pkg"), F.col("repo").alias("to_repo")), ["to_pkg"], "to_repo")
    hits = tried.join(owners, "to_pkg").where("from_repo <> to_repo")
    return hits.groupBy("from_repo", "from_path", "specifier").agg(F.max_by(F.struct("to_repo", "to_pkg"), F.length("to_pkg")).alias("__t")).select("from_repo", "from_path", F.col("__t.to_repo"), F.col("__t.to_pkg"), "specifier")


def excluding(path: Column, patterns: list[str]) -> Column:
    """The first of the ordered globs that matches a path, null where none does."""
    hit = F.lit(None).cast("string")
    for pattern in reversed(patterns):
        hit = F.when(path.rlike(glob_pattern(pattern)), pattern).otherwise(hit)
    return hit


def first_excluding(paths: DataFrame, patterns: list[str]) -> DataFrame:
    """(path, pattern): the first of the ordered globs that matches each path, null where none does."""
    return paths.select("path", excluding(F.col("path"), patterns).alias("pattern"))


def disambiguate(rows: DataFrame, keys: list[str], name: str, order: list[str], out: str) -> DataFrame:
    """`out`: the name for its first row in order, `name~2`, `name~3` for the next ones of the same keys."""
    place = F.row_number().over(Window.partitionBy(*keys, name).orderBy(*order))
    return rows.withColumn("__place", place).withColumn(out, F.when(F.col("__place") == 1, F.col(name)).otherwise(F.concat(name, F.lit("~"), "__place"))).drop("__place")
