"""Comparisons: drift between snapshots, precision and recall, percentiles, win and loss, text differences."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def verify(expected: DataFrame, found: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and state of what differs: missing (only expected), extra (only found), changed (values differ, null a value)."""
    a = expected.select(*keys, F.struct(F.col(value).alias("v")).alias("__a"))
    b = found.select(*keys, F.struct(F.col(value).alias("v")).alias("__b"))
    state = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra").when(~F.col("__a.v").eqNullSafe(F.col("__b.v")), "changed")
    return a.join(b, keys, "full_outer").select(*keys, state.alias("state")).where("state is not null")


def score_sets(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 over distinct keys; a ratio over an empty set is 1."""
    p = predicted.select(*keys).distinct().withColumn("__p", F.lit(1))
    t = truth.select(*keys).distinct().withColumn("__t", F.lit(1))
    both = p.join(t, keys, "full_outer").agg(
        F.count_if(F.col("__p").isNotNull() & F.col("__t").isNotNull()).alias("tp"),
        F.count_if(F.col("__t").isNull()).alias("fp"),
        F.count_if(F.col("__p").isNull()).alias("fn"),
    )
    ratio = lambda a, b: F.when(b == 0, 1.0).otherwise(a / b)
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return both.select("*", precision.alias("precision"), recall.alias("recall")).select("*", f1.alias("f1"))


def jaccard(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: jaccard of two sets of keys, 1 where both are empty."""
    s = score_sets(left, right, keys)
    union = F.col("tp") + F.col("fp") + F.col("fn")
    return s.select(F.when(union == 0, 1.0).otherwise(F.col("tp") / union).alias("jaccard"))


def summarize(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key: n, mean, population std, least, most, midpoint median, nearest-rank p50 and p95."""
    v = F.col(value)
    return rows.where(v.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most"), F.median(v).alias("median"),
        F.expr(f"percentile_disc(0.5) within group (order by {value})").alias("p50"), F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95"),
    )


def win_loss_tie(left: DataFrame, right: DataFrame, keys: list[str], value: str, epsilon: float = 1e-9) -> DataFrame:
    """One row: tasks where left is better (larger), worse, or within epsilon, over keys both have."""
    d = F.col("__l") - F.col("__r")
    both = left.select(*keys, F.col(value).alias("__l")).join(right.select(*keys, F.col(value).alias("__r")), keys)
    return both.agg(F.count_if(d > epsilon).alias("wins"), F.count_if(d < -epsilon).alias("losses"), F.count_if(F.abs(d) <= epsilon).alias("ties"))


def line_delta(left: DataFrame, right: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, added, removed: lines as multisets between two versions of a text, for texts of any size, in the JVM."""

    def lines(df: DataFrame, name: str) -> DataFrame:
        line = F.explode(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n"), "\n")).alias("__line")
        return df.select(*keys, line).groupBy(*keys, "__line").agg(F.count("*").alias(name))

    n = F.coalesce("__new", F.lit(0)) - F.coalesce("__old", F.lit(0))
    both = lines(left, "__old").join(lines(right, "__new"), [*keys, "__line"], "full_outer")
    return both.groupBy(*keys).agg(F.sum(F.greatest(n, F.lit(0))).alias("added"), F.sum(F.greatest(-n, F.lit(0))).alias("removed"))


def unified_diffs(pairs: DataFrame, context: int = 3) -> DataFrame:
    """pairs (id, old, new) -> (id, diff, added, removed): unified diffs, nulls as empty texts."""

    def batches(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in rows:
            out = []
            for key, old, new in zip(batch["id"], batch["old"], batch["new"]):
                lines = list(difflib.unified_diff((old or "").splitlines(), (new or "").splitlines(), "old", "new", n=context, lineterm=""))
                added = sum(x.startswith("+") for x in lines[2:])
                removed = sum(x.startswith("-") for x in lines[2:])
                out.append((key, "\n".join(lines), added, removed))
            yield pd.DataFrame(out, columns=["id", "diff", "added", "removed"])

    return pairs.select("id", "old", "new").mapInPandas(batches, f"id {pairs.schema['id'].dataType.simpleString()}, diff string, added int, removed int")


def byte_delta(pairs: DataFrame) -> DataFrame:
    """pairs (id, old, new) -> (id, bytes): bytes left of the longer after their common head and tail are cut off."""

    def batches(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in rows:
            out = []
            for key, old, new in zip(batch["id"], batch["old"], batch["new"]):
                x, y = (old or "").encode(), (new or "").encode()
                n = min(len(x), len(y))
                head = next((i for i in range(n) if x[i] != y[i]), n)
                tail = next((i for i in range(n - head) if x[-1 - i] != y[-1 - i]), n - head)
                out.append((key, max(len(x), len(y)) - head - tail))
            yield pd.DataFrame(out, columns=["id", "bytes"])

    return pairs.select("id", "old", "new").mapInPandas(batches, f"id {pairs.schema['id'].dataType.simpleString()}, bytes long")


def score_against_truth(predicted: DataFrame, truth: DataFrame, keys: list[str], universe: DataFrame, ends: list[str]) -> DataFrame:
    """Per repository: tp, fp, fn, precision, recall of edges whose `ends` both lie in the universe (repo, path).

    Both sides are cut to the universe first, so that files only one side could read don't count.
    """
    known = universe.select("repo", "path").distinct()

    def cut(df: DataFrame) -> DataFrame:
        for end in ends:
            df = df.join(known.withColumnRenamed("path", end), ["repo", end], "left_semi")
        return df.select("repo", *keys).distinct()

    both = cut(predicted).withColumn("__p", F.lit(1)).join(cut(truth).withColumn("__t", F.lit(1)), ["repo", *keys], "full_outer")
    counts = both.groupBy("repo").agg(F.count_if(F.col("__p").isNotNull() & F.col("__t").isNotNull()).alias("tp"), F.count_if(F.col("__t").isNull()).alias("fp"), F.count_if(F.col("__p").isNull()).alias("fn"))
    ratio = lambda n: F.when(F.col("tp") + F.col(n) == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col(n)))
    return counts.select("*", ratio("fp").alias("precision"), ratio("fn").alias("recall"))


def lcs_ratio(pairs: DataFrame) -> DataFrame:
    """pairs (id, old, new) -> (id, ratio): 2 * longest common subsequence of words / words of both; 1 for two empty texts."""

    def batches(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in rows:
            out = []
            for key, old, new in zip(batch["id"], batch["old"], batch["new"]):
                a, b = (old or "").split(), (new or "").split()
                masks: dict[str, int] = {}
                for i, word in enumerate(a):
                    masks[word] = masks.get(word, 0) | 1 << i
                # bit-parallel: zeros of `row` mark the subsequence's length
                row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
                for word in b:
                    hit = row & masks.get(word, 0)
                    row = ((row + hit) | (row - hit)) & full
                length = len(a) - row.bit_count()
                out.append((key, 2 * length / (len(a) + len(b)) if a or b else 1.0))
            yield pd.DataFrame(out, columns=["id", "ratio"])

    return pairs.select("id", "old", "new").mapInPandas(batches, f"id {pairs.schema['id'].dataType.simpleString()}, ratio double")


def missed_targets(measured: DataFrame, targets: DataFrame) -> DataFrame:
    """(metric, value, most): measured metrics above their target; metrics without a target or a value are not judged."""
    return measured.join(targets, "metric").where("value > most").select("metric", "value", "most")


def sample_tasks(symbols: DataFrame, per_kind: int, seed: int = 0) -> DataFrame:
    """(repo, id, kind, place): `per_kind` symbols of each kind of a repository, the same ones for a seed wherever it runs.

    A sampling operator: the least hashes of seed and id are taken, after a first cut inside each slice of the hash.
    """
    order = F.xxhash64(F.lit(seed), "repo", "id")
    rows = symbols.select("repo", "id", "kind").distinct().withColumn("__h", order).withColumn("__slice", F.pmod("__h", F.lit(64)))
    near = Window.partitionBy("repo", "kind", "__slice").orderBy("__h", "id")
    few = rows.withColumn("__n", F.row_number().over(near)).where(F.col("__n") <= per_kind)
    last = Window.partitionBy("repo", "kind").orderBy("__h", "id")
    return few.withColumn("place", F.row_number().over(last)).where(F.col("place") <= per_kind).select("repo", "id", "kind", "place")


def inject_drift(expected: DataFrame, keys: list[str], value: str, one_in: int, seed: int = 0) -> DataFrame:
    """`expected` with drift to test a verifier: of the rows that a hash picks, one in `one_in`, a third each is lost,
    changed, or doubled under a new first key; `injected` names what verify has to say of each row (null: nothing)."""
    pick = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(3 * one_in))
    rows = expected.withColumn("injected", F.when(pick == 0, "missing").when(pick == 1, "changed").when(pick == 2, "extra"))
    changed = rows.withColumn(value, F.when(F.col("injected") == "changed", F.concat(F.lit("drift:"), F.coalesce(F.col(value).cast("string"), F.lit("")))).otherwise(F.col(value)))
    kept = changed.withColumn("injected", F.when(F.col("injected") == "extra", None).otherwise(F.col("injected")))
    return kept.unionByName(rows.where("injected = 'extra'").withColumn(keys[0], F.concat(F.lit("drift:"), F.col(keys[0]).cast("string"))))
