"""Packages and aliases declared by manifests: package.json, go.mod, Cargo.toml, pyproject.toml, tsconfig.json."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.ids import base_name, directory_of, normal_join
from codestrata.session import checkpointed

MANIFESTS = ("package.json", "go.mod", "Cargo.toml", "pyproject.toml", "tsconfig.json", "jsconfig.json")
MANIFEST_SCHEMA = "repo string, dir string, source string, name string, kind string, key string, value string, place int"
_COLUMNS = [p.split()[0] for p in MANIFEST_SCHEMA.split(", ")]


def parse_jsonc(text: str):
    """JSON with comments and trailing commas; None where it is broken."""
    strings_or_comments = re.compile(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', re.DOTALL)
    bare = strings_or_comments.sub(lambda m: m.group(1) or " ", text.lstrip("﻿"))
    bare = re.sub(r'("(?:[^"\\]|\\.)*")|,(\s*[}\]])', lambda m: m.group(1) or m.group(2), bare)
    try:
        return json.loads(bare)
    except ValueError:
        return None


def export_targets(value, conditions: tuple[str, ...] = ("source", "types", "import", "module", "require", "default", "node")) -> list[str]:
    """The ordered files a conditional `exports` value may mean; null blocks, so it gives none."""
    if isinstance(value, str):
        return [value]
    if isinstance(value, list):
        return [t for v in value for t in export_targets(v, conditions)]
    if isinstance(value, dict):
        return [t for c in conditions if c in value for t in export_targets(value[c], conditions)]
    return []


def manifest_rows(base: str, text: str) -> list[tuple]:
    """(source, name, kind, key, value, place): kind `package`, `entry` (subpath -> file), `path` (alias -> target) or `base`."""
    rows: list[tuple] = []
    if base == "package.json":
        data = parse_jsonc(text)
        if not isinstance(data, dict):
            return []
        name = data.get("name") if isinstance(data.get("name"), str) else None
        rows.append((base, name, "package", None, None, 0))
        exports = data.get("exports")
        table = exports if isinstance(exports, dict) and any(str(k).startswith(".") for k in exports) else {".": exports} if exports is not None else {}
        for key, value in table.items():
            targets = export_targets(value)
            rows += [(base, name, "entry", key, t.removeprefix("./"), i) for i, t in enumerate(targets)] or [(base, name, "blocked", key, None, 0)]
        if exports is None:
            rows += [(base, name, "entry", ".", data[f].removeprefix("./"), i) for i, f in enumerate(("source", "types", "module", "main")) if isinstance(data.get(f), str)]
    elif base == "go.mod":
        if match := re.search(r"^\s*module\s+(\S+)", text, re.MULTILINE):
            rows.append((base, match.group(1).strip('"'), "package", None, None, 0))
    elif base in ("Cargo.toml", "pyproject.toml"):
        try:
            data = tomllib.loads(text)
        except tomllib.TOMLDecodeError:
            return []
        part = data.get("package") or data.get("project") or data.get("tool", {}).get("poetry") or {}
        if isinstance(part.get("name"), str):
            rows.append((base, part["name"].replace("-", "_") if base == "Cargo.toml" else part["name"], "package", None, None, 0))
    else:
        data = parse_jsonc(text)
        bases = data.get("extends") if isinstance(data, dict) else None
        rows += [(base, None, "extends", None, b.strip(), i) for i, b in enumerate([bases] if isinstance(bases, str) else bases if isinstance(bases, list) else []) if isinstance(b, str) and b.strip().startswith(".")]
        options = data.get("compilerOptions") if isinstance(data, dict) else None
        if isinstance(options, dict):
            root = options.get("baseUrl")
            if isinstance(root, str):
                rows.append((base, None, "base", None, root.removeprefix("./") or ".", 0))
            for key, targets in (options.get("paths") or {}).items():
                rows += [(base, None, "path", key, t.removeprefix("./") if not isinstance(root, str) or root in (".", "./") else f"{root.removeprefix('./').rstrip('/')}/{t.removeprefix('./')}", i) for i, t in enumerate(targets if isinstance(targets, list) else [])]
    return rows


def _batches(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in rows:
        out = []
        for repo, folder, base, source in zip(*(batch[c].tolist() for c in ("repo", "dir", "base", "source"))):
            out += [(repo, folder, *row) for row in manifest_rows(base, source)]
        yield pd.DataFrame(out, columns=_COLUMNS)


def manifests(files: DataFrame) -> DataFrame:
    """What the manifests among files (repo, path, source) declare; broken or null ones declare nothing."""
    rows = files.where("source is not null").select("repo", directory_of(F.col("path")).alias("dir"), base_name(F.col("path")).alias("base"), "source")
    return rows.where(F.col("base").isin(*MANIFESTS) | F.col("base").rlike(r"^tsconfig\..*json$")).mapInPandas(_batches, MANIFEST_SCHEMA)


def effective_configs(declared: DataFrame) -> DataFrame:
    """(repo, dir, at, kind, key, value, place): the `path` and `base` options in force for the configuration of each
    directory, own or inherited through `extends`; `at` is the directory of the file that spells them.

    Of several bases the last that has an option wins. Chains have any length, one round a step; a file is taken once.
    """
    options = declared.where("kind in ('path', 'base')").select("repo", F.col("dir").alias("at"), F.col("source").alias("file"), "kind", "key", "value", "place")
    names = F.when(F.endswith("value", F.lit(".json")), F.col("value")).otherwise(F.concat("value", F.lit(".json")))
    target = normal_join(F.col("dir"), names)
    steps = checkpointed(declared.where("kind = 'extends'").select("repo", F.col("dir").alias("at"), F.col("source").alias("file"), directory_of(target).alias("to"), base_name(target).alias("to_file"), F.col("place").alias("nth")))
    reached = declared.where("source in ('tsconfig.json', 'jsconfig.json')").select("repo", "dir", F.col("dir").alias("at"), F.col("source").alias("file")).distinct()
    reached = frontier = checkpointed(reached.select("*", F.lit("").alias("rank"), F.lit(0).alias("depth")))
    where = ["repo", "dir", "at", "file"]
    while True:  # nearer files first, of one file's bases the last first
        further = frontier.join(steps, ["repo", "at", "file"]).select("repo", "dir", F.col("to").alias("at"), F.col("to_file").alias("file"), F.concat("rank", F.format_string("%06d", F.lit(999_999) - F.col("nth"))).alias("rank"), (F.col("depth") + 1).alias("depth"))
        further = further.groupBy(*where).agg(F.min("rank").alias("rank"), F.min("depth").alias("depth")).join(reached, where, "left_anti")
        frontier = checkpointed(further)
        if not frontier.limit(1).count():
            break
        reached = checkpointed(reached.unionByName(frontier))
    found = reached.join(options, ["repo", "at", "file"])
    # the first file in this order that has the option: a file before its bases, the last base's line before the others'
    best = found.groupBy("repo", "dir", "kind").agg(F.min(F.struct("rank", "at", "file")).alias("__b"))
    return found.join(best, ["repo", "dir", "kind"]).where("at = __b.at and file = __b.file").select("repo", "dir", "at", "kind", "key", "value", "place")


def detect_packages(declared: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, pkg, dir, source): package directories; package.json names before go.mod's before the others'.

    A repository always has a package at '.': its manifest's name, else `root`. A name two directories declare
    becomes `name (dir)` in all but the first.
    """
    rank = F.array_position(F.array(*[F.lit(m) for m in MANIFESTS]), F.col("source"))
    named = declared.where("kind = 'package' and name is not null").groupBy("repo", "dir").agg(F.min(F.struct(rank.alias("__r"), "name", "source")).alias("__p"))
    named = named.select("repo", "dir", F.col("__p.name").alias("name"), F.col("__p.source").alias("source"))
    roots = files.select("repo").distinct().select("repo", F.lit(".").alias("dir")).join(named.select("repo", "dir"), ["repo", "dir"], "left_anti")
    every = named.unionByName(roots.select("repo", "dir", F.lit("root").alias("name"), F.lit("none").alias("source")))
    first = every.groupBy("repo", "name").agg(F.min("dir").alias("__first"))
    return every.join(first, ["repo", "name"]).select("repo", F.when(F.col("dir") == F.col("__first"), F.col("name")).otherwise(F.concat("name", F.lit(" ("), "dir", F.lit(")"))).alias("pkg"), "dir", "source")


def alias_candidates(specifiers: DataFrame, declared: DataFrame) -> DataFrame:
    """(repo, file, specifier, base, rank): paths that bare script specifiers may mean by tsconfig paths or package entries.

    tsconfig: the nearest configuration above the file; an exact pattern beats a wildcard, a longer prefix a
    shorter one, and only the best pattern is tried; `baseUrl` comes after. Packages: the longest declared name
    that heads the specifier; its subpath by `exports`, where given, else below its directory. All equi-joins.
    """
    from codestrata.functions.ids import ancestors

    bare = specifiers.where(~F.col("specifier").rlike(r"^[./]")).select("repo", "file", "specifier").distinct()
    configs = checkpointed(effective_configs(declared))
    owners = declared.where("source in ('tsconfig.json', 'jsconfig.json')").select("repo", "dir").distinct()
    above = bare.select("repo", "file").distinct().select("repo", "file", F.posexplode(ancestors(F.col("file"))).alias("far", "dir")).join(owners, ["repo", "dir"])
    nearest = above.groupBy("repo", "file").agg(F.min_by("dir", "far").alias("dir"))
    mine = bare.join(nearest, ["repo", "file"])
    prefix, suffix = F.substring_index("key", "*", 1), F.regexp_extract("key", r"\*(.*)$", 1)
    tried = mine.join(configs.where("kind = 'path'"), ["repo", "dir"]).withColumn("wild", F.contains("key", F.lit("*")))
    fits = F.when(F.col("wild"), F.startswith("specifier", prefix) & F.endswith("specifier", suffix) & (F.length("specifier") >= F.length("key") - 1)).otherwise(F.col("specifier") == F.col("key"))
    star = F.expr("substring(specifier, length(substring_index(key, '*', 1)) + 1, length(specifier) - length(key) + 1)")
    hits = tried.where(fits).withColumn("__good", F.struct((~F.col("wild")).cast("int").alias("a"), F.length(prefix).alias("b"), "key"))
    best = hits.groupBy("repo", "file", "specifier").agg(F.max("__good").alias("__good"))
    within = lambda c: F.when(F.col("dir") == ".", c).otherwise(F.concat("dir", F.lit("/"), c))
    at = lambda c: F.when(F.col("at") == ".", c).otherwise(normal_join(F.col("at"), c))
    paths = hits.join(best, ["repo", "file", "specifier", "__good"]).select("repo", "file", "specifier", at(F.when(F.col("wild"), F.replace("value", F.lit("*"), star)).otherwise(F.col("value"))).alias("base"), F.col("place").alias("rank"))
    bases = mine.join(configs.where("kind = 'base'"), ["repo", "dir"]).select("repo", "file", "specifier", at(F.when(F.col("value") == ".", F.col("specifier")).otherwise(F.concat("value", F.lit("/"), "specifier"))).alias("base"), F.lit(1000).alias("rank"))
    heads = F.concat(F.array(F.col("specifier")), F.filter(ancestors(F.col("specifier")), lambda d: d != "."))
    package = bare.select("*", F.explode(heads).alias("name")).join(declared.where("kind = 'package' and source = 'package.json' and name is not null").select("repo", "name", "dir").distinct(), ["repo", "name"])
    owner = package.groupBy("repo", "file", "specifier").agg(F.max_by(F.struct("name", "dir"), F.length("name")).alias("__o")).select("repo", "file", "specifier", "__o.*")
    owner = owner.withColumn("key", F.concat(F.lit("."), F.expr("substring(specifier, length(name) + 1)")))
    listed = declared.where("kind in ('entry', 'blocked') and source = 'package.json'").select("repo", "dir", "key", "value", "place")
    exact = owner.join(listed, ["repo", "dir", "key"]).where("value is not null").select("repo", "file", "specifier", within(F.col("value")).alias("base"), (F.col("place") + 2000).alias("rank"))
    strict = declared.where("kind in ('entry', 'blocked') and key <> '.'").select("repo", "dir").distinct()
    loose = owner.join(strict, ["repo", "dir"], "left_anti").select("repo", "file", "specifier", within(F.regexp_replace(F.expr("substring(key, 3)"), "^$", "index")).alias("base"), F.lit(3000).alias("rank"))
    source = owner.join(strict, ["repo", "dir"], "left_anti").select("repo", "file", "specifier", within(F.concat(F.lit("src/"), F.regexp_replace(F.expr("substring(key, 3)"), "^$", "index"))).alias("base"), F.lit(3001).alias("rank"))
    return paths.unionByName(bases).unionByName(exact).unionByName(loose).unionByName(source)
