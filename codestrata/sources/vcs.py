"""Change capture from Git: candidate files, changed paths of the working tree, paths that commits touched.

Listings are made on the driver, one per repository, and handed over as DataFrames of paths; contents are read by the scans.
"""

from __future__ import annotations

import re
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "repo string, path string"
_COMMIT = re.compile(r"[0-9a-f]{7,64}")


class GitError(RuntimeError):
    """Git is missing, the folder is no repository, or a commit does not exist."""


def _git(root: str, *arguments: str) -> list[str]:
    try:
        done = subprocess.run(["git", "-C", root, *arguments], capture_output=True, check=True)
    except (OSError, subprocess.CalledProcessError) as error:
        raise GitError(f"git {arguments[0]} in {root}") from error
    return [x for x in done.stdout.decode("utf-8", "surrogateescape").split("\0") if x]


def _frame(spark: SparkSession, repo: str, paths: set[str]) -> DataFrame:
    return spark.createDataFrame([(repo, p) for p in sorted(paths)], SCHEMA)


def candidates(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """(repo, path): tracked files and untracked ones that no ignore rule names, as far as they exist on disk."""
    listed = _git(root, "ls-files", "--cached", "--others", "--exclude-standard", "-z")
    return _frame(spark, repo, {p for p in listed if (Path(root) / p).is_file()})


def working_tree_changes(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """(repo, path): paths that differ from the last commit: staged, unstaged, untracked, both ends of renames."""
    found: set[str] = set()
    entries = iter(_git(root, "status", "--porcelain", "-z", "--untracked-files=all"))
    for entry in entries:
        found.add(entry[3:])
        if entry[0] in "RC" or entry[1] in "RC":
            found.add(next(entries, entry[3:]))
    return _frame(spark, repo, found)


def committed_since(spark: SparkSession, root: str, repo: str, commit: str) -> DataFrame:
    """(repo, path): paths that the commits after `commit` touched.

    A commit that does not look like an object's name, or that the repository no longer has (a rebase, a shallow
    clone), is an error, so that the caller rebuilds instead of missing changes.
    """
    if not _COMMIT.fullmatch(commit or ""):
        raise GitError(f"no commit: {commit!r}")
    _git(root, "rev-parse", "--verify", "--quiet", f"{commit}^{{commit}}")
    return _frame(spark, repo, set(_git(root, "diff", "--name-only", "-z", f"{commit}..HEAD", "--")))
