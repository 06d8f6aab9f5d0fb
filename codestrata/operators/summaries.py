"""Summaries of files: reading answers that hold them, and carrying the cache on."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_candidates(answer: str) -> Iterator[object]:
    """Every JSON object or array that starts anywhere in a text, outermost first: fenced, bare or among prose."""
    decoder = json.JSONDecoder()
    at = 0
    while (start := min((i for i in (answer.find("{", at), answer.find("[", at)) if i >= 0), default=-1)) >= 0:
        try:
            value, end = decoder.raw_decode(answer, start)
        except (ValueError, RecursionError):
            at = start + 1
            continue
        yield value
        at = end


def summaries_in(answer: str | None, asked: set[str]) -> dict[str, str]:
    """{path: text} of the first candidate that answers any of the paths asked for: a map, or a list of path and text.

    Blank texts, other paths and other shapes are left out.
    """
    for value in json_candidates(answer or ""):
        pairs = value.items() if isinstance(value, dict) else [(v.get("path"), v.get("text") or v.get("summary")) for v in value if isinstance(v, dict)]
        found = {p: t.strip() for p, t in pairs if p in asked and isinstance(t, str) and t.strip()}
        if found:
            return found
    return {}


def parse_answers(answers: DataFrame) -> DataFrame:
    """answers (repo, batch, paths array, answer) -> (repo, path, text); a null or unreadable answer gives no rows."""

    def batches(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in rows:
            out = [(repo, p, t) for repo, paths, answer in zip(frame["repo"], frame["paths"], frame["answer"]) for p, t in summaries_in(answer if isinstance(answer, str) else None, set(paths)).items()]
            yield pd.DataFrame(out, columns=["repo", "path", "text"])

    return answers.where("paths is not null").select("repo", "paths", "answer").mapInPandas(batches, "repo string, path string, text string")


def next_cache(cache: DataFrame, fresh: DataFrame, files: DataFrame) -> DataFrame:
    """(sha256, path, text, refreshed_at, model): the cache with fresh entries over old ones of the same content.

    fresh has the cache's columns; entries whose content no file (sha256) has any more are dropped, null keys never kept.
    Of several entries of one content the latest `refreshed_at`, then the least path, stays.
    """
    columns = ["sha256", "path", "text", "refreshed_at", "model"]
    every = cache.select(*columns, F.lit(0).alias("__new")).unionByName(fresh.select(*columns, F.lit(1).alias("__new"))).where("sha256 is not null")
    best = every.groupBy("sha256").agg(F.max_by(F.struct(*columns[1:]), F.struct("__new", "refreshed_at")).alias("__e"))
    return best.join(files.where("sha256 is not null").select("sha256").distinct(), "sha256", "left_semi").select("sha256", "__e.*")


def call_lines(calls: DataFrame, files: DataFrame) -> DataFrame:
    """Call edges (repo, from, to, ...) both of whose ends lie in the files (repo, path) given."""
    known = files.select("repo", "path").distinct()
    ends = calls.withColumn("__a", F.substring_index("from", "#", 1)).withColumn("__b", F.substring_index("to", "#", 1))
    return ends.join(known.toDF("repo", "__a"), ["repo", "__a"], "left_semi").join(known.toDF("repo", "__b"), ["repo", "__b"], "left_semi").drop("__a", "__b")
