"""Answers about files: denormalised descriptions, status, and the ladder of what a needle may mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.ids import ancestors, directory_of, is_node, lang_of, suffixes
from codestrata.operators import graph, resolve


def describe_files(files: DataFrame, imports: DataFrame, symbols: DataFrame, packages: DataFrame) -> DataFrame:
    """One row per file (repo, path, loc): its package, language, fan-in, fan-out, blast radius, exported names, nodes.

    exports is the sorted, comma-joined list of exported names; packages is (repo, pkg, dir).
    """
    paths = files.select("repo", "path").distinct()
    pairs = graph.expand_targets(imports, paths)
    names = symbols.select("repo", F.col("file").alias("path"), "name", "exported").distinct()
    exported = names.where("exported").groupBy("repo", "path").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("exports"))
    declared = names.groupBy("repo", "path").agg(F.countDistinct("name").alias("declared"))
    blast = graph.blast_radius(pairs, paths.toDF("repo", "node")).withColumnRenamed("node", "path")
    out = files.select("repo", "path", "loc").join(resolve.package_of(paths, packages), ["repo", "path"], "left")
    for part in (graph.fan_metrics(imports, paths), blast, exported, declared):
        out = out.join(part, ["repo", "path"], "left")
    zero = F.lit(0).cast("long")
    return out.select("repo", "path", "pkg", lang_of(F.col("path")).alias("lang"), "loc", "fan_in", "fan_out", "blast", F.coalesce("exports", F.lit("")).alias("exports"), F.coalesce("declared", zero).alias("declared"))


def status_of(asked: DataFrame, mapped: DataFrame, present: DataFrame, excludes: list[str]) -> DataFrame:
    """(repo, path, status): found, stale (content differs), excluded (and by which glob), unmapped or absent.

    mapped and present are (repo, path, sha256): what the map holds and what the tree holds.
    """
    rows = asked.select("repo", "path").distinct()
    a = mapped.select("repo", "path", F.coalesce("sha256", F.lit("")).alias("__m")).dropDuplicates(["repo", "path"])
    b = present.select("repo", "path", F.coalesce("sha256", F.lit("")).alias("__p")).dropDuplicates(["repo", "path"])
    pattern = resolve.first_excluding(rows.select("path").distinct(), excludes)
    joined = rows.join(a, ["repo", "path"], "left").join(b, ["repo", "path"], "left").join(pattern, "path", "left")
    status = (
        F.when(F.col("__p").isNull(), "absent")
        .when(F.col("pattern").isNotNull() & F.col("__m").isNull(), F.concat(F.lit("excluded: "), "pattern"))
        .when(F.col("__m").isNull(), "unmapped")
        .when(F.col("__m") != F.col("__p"), "stale")
        .otherwise("found")
    )
    return joined.select("repo", "path", status.alias("status"))


def ladder(needles: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(needle, step, repo, id): what each needle means, by the first step that answers.

    1 a file (path or unique suffix), 2 a node or symbol id, 3 a directory, 4 a symbol's name, 5 the end of one.
    """
    wanted = needles.where("needle <> ''").select("needle").distinct()
    paths = files.select("repo", "path").distinct()
    by_path = wanted.join(paths, F.col("needle") == F.col("path")).select("needle", F.lit(1).alias("step"), "repo", F.col("path").alias("id"))
    ends = paths.select("repo", "path", F.explode(suffixes(F.col("path"))).alias("needle")).join(wanted, "needle")  # each path's own ends
    one = resolve.unique_or_none(ends, ["repo", "needle"], "path")
    by_end = one.join(by_path.select("repo", "needle"), ["repo", "needle"], "left_anti").select("needle", F.lit(1).alias("step"), "repo", F.col("path").alias("id"))
    folders = paths.select("repo", directory_of(F.col("path")).alias("dir")).distinct()
    by_folder = wanted.join(folders, F.col("needle") == F.col("dir")).select("needle", F.lit(3).alias("step"), "repo", F.col("dir").alias("id"))
    found = resolve.find_symbols(symbols, wanted)
    by_name = found.select("needle", F.when(F.col("tier") == 1, 2).otherwise(F.col("tier") + 2).alias("step"), "repo", "id")
    every = by_path.unionByName(by_end).unionByName(by_folder).unionByName(by_name).distinct()
    first = every.groupBy("needle").agg(F.min("step").alias("step"))
    return every.join(first, ["needle", "step"])


def files_under(files: DataFrame) -> DataFrame:
    """(repo, dir, path): every file below every directory, '.' the root; join it with the directories asked for."""
    return files.select("repo", "path").distinct().select("repo", F.explode(ancestors(F.col("path"))).alias("dir"), "path")


def nodes_of(symbols: DataFrame) -> DataFrame:
    """(repo, file, place, id, kind): the nodes inside each file in order of their spans; repeated rows once."""
    rows = symbols.where(is_node(F.col("kind"), F.col("id"))).select("repo", "file", "id", "kind", "span.start_line", "span.end_line").distinct()
    place = F.row_number().over(Window.partitionBy("repo", "file").orderBy("start_line", "end_line", "id"))
    return rows.select("repo", "file", place.alias("place"), "id", "kind")


def references_at(references: DataFrame) -> DataFrame:
    """(repo, id, direction, other, ref_kind): every reference seen from both of its ends, `out` and `in`."""
    ends = F.explode(F.array(F.struct(F.col("from").alias("id"), F.lit("out").alias("direction"), F.col("to").alias("other")), F.struct(F.col("to").alias("id"), F.lit("in").alias("direction"), F.col("from").alias("other"))))
    return references.select("repo", "ref_kind", ends.alias("__e")).select("repo", "__e.*", "ref_kind").distinct()


def default_only(exports: DataFrame) -> DataFrame:
    """(repo, file, name): declarations that a file exports as its default and under no name of their own.

    exports are facts (repo, file, name, kind, signature = the local name).
    """
    rows = exports.where("fact = 'export'")
    named = rows.where("kind <> 'default'").select("repo", "file", "name")
    return rows.where("kind = 'default' and signature is not null").select("repo", "file", F.col("signature").alias("name")).distinct().join(named, ["repo", "file", "name"], "left_anti")


def directory_verdicts(present: DataFrame, mapped: DataFrame, excludes: list[str]) -> DataFrame:
    """(repo, dir, status, excluded_by): what is to be said of each directory of the tree.

    found if the map holds a file below it; else stale if it has a file the map could hold; else excluded, by the glob
    that keeps out the first of its files in order, or by `languages`. present and mapped are (repo, path).
    """
    tree = files_under(present)
    judged = tree.withColumn("__by", resolve.excluding(F.col("path"), excludes)).join(mapped.select("repo", "path").distinct().withColumn("__there", F.lit(True)), ["repo", "path"], "left")
    could = F.col("__by").isNull() & lang_of(F.col("path")).isNotNull()
    sums = judged.groupBy("repo", "dir").agg(F.count("__there").alias("__found"), F.count_if(could).alias("__could"), F.min_by("__by", F.when(F.col("__by").isNotNull(), F.col("path"))).alias("__first"))
    status = F.when(F.col("__found") > 0, "found").when(F.col("__could") > 0, "stale").otherwise("excluded")
    return sums.select("repo", "dir", status.alias("status"), F.when(status == "excluded", F.coalesce("__first", F.lit("languages"))).alias("excluded_by"))


def node_counts(symbols: DataFrame, owners: DataFrame) -> DataFrame:
    """(repo, pkg, nodes): how many nodes the files of each package hold; owners is (repo, path, pkg)."""
    nodes = nodes_of(symbols).select("repo", F.col("file").alias("path"), "id")
    return owners.join(nodes, ["repo", "path"], "left").groupBy("repo", "pkg").agg(F.count("id").alias("nodes"))


# Files whose presence tells that a repository uses a language, beside the files of the language.
MARKERS = {"go.mod": "go", "pyproject.toml": "python", "setup.py": "python", "Cargo.toml": "rust", "pom.xml": "java", "build.gradle": "java", "build.gradle.kts": "java", "Dockerfile": "dockerfile", "Containerfile": "dockerfile"}


def marked_languages(files: DataFrame) -> DataFrame:
    """(repo, lang): the languages that marker files, or endings that need no marker, tell of; files is (repo, path)."""
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    marker = F.try_element_at(F.create_map(*[F.lit(x) for kv in MARKERS.items() for x in kv]), base)
    ending = F.when(base.rlike(r"\.py$"), "python").when(base.rlike(r"\.java$"), "java").when(base.rlike(r"\.kts?$"), "kotlin").when(base.rlike(r"\.tf$"), "hcl").when(base.rlike(r"^Dockerfile\."), "dockerfile")
    found = files.select("repo", F.explode(F.array_distinct(F.array(marker, ending))).alias("lang"))
    return found.where("lang is not null").distinct()
