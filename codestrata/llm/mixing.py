"""Mixing sources to target weights.

Documents are hashed into blocks per source. A source's draws are its permuted blocks, over and over, numbered from 0;
its token quota fixes how many there are. A splitting tree deals these exact quotas to the output shards by
multivariate-hypergeometric draws, so that each shard takes one stretch of every source's draws, disjoint from all
others, and documents are shuffled inside their shard. The plan counts copies and never lists them.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.session import checkpointed, spread

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public byte-level BPE's splitting pattern.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _encoding(ranks: bytes) -> tiktoken.Encoding:
    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("mixing", pat_str=SPLIT, mergeable_ranks=merges, special_tokens={})


def clean_source(column: Column) -> Column:
    """A source's name without outer space, in lower case, with '-' for '_' and blanks."""
    return F.regexp_replace(F.lower(F.trim(column)), r"[\s_]+", "-")


def token_counts(documents: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, most_bytes: int = 64_000_000) -> DataFrame:
    """(doc_id, source, tokens) of every document; null and empty texts have 0 tokens.

    The tokenizer's file (`most_bytes` at most) is read on the driver and broadcast.
    """
    ranks = Path(tokenizer).read_bytes()
    if len(ranks) > most_bytes:
        raise ValueError(f"{tokenizer} is larger than {most_bytes} bytes")
    shared = documents.sparkSession.sparkContext.broadcast(ranks)

    def batches(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(shared.value)
        for batch in rows:
            counts = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch["text"].tolist()]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "tokens": counts})

    rows = spread(documents.where("doc_id is not null").select("doc_id", clean_source(F.col("source")).alias("source"), "text"))
    return rows.mapInPandas(batches, "doc_id long, source string, tokens long")


@dataclass
class Target:
    share: float
    most: float  # repeats; infinite for no cap


def clean_targets(targets: DataFrame) -> dict[str, Target]:
    """Targets by cleaned name: shares scaled to add up to 1, the strictest cap of a name that is listed twice.

    Names listed twice count once, with the mean of their shares; null names and shares, and shares of 0 or
    less, are left out. The table holds the mixture's parameters, one row a source, and is read on the driver.
    """
    rows = targets.select(clean_source(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0")
    found = rows.groupBy("source").agg(F.avg("target_share").alias("share"), F.min("max_repeats").alias("most")).orderBy("source").collect()
    total = sum(r.share for r in found)
    return {r.source: Target(r.share / total, float("inf") if r.most is None else max(0, r.most)) for r in found}


def quotas(targets: dict[str, Target], available: dict[str, int], size: float) -> dict[str, float]:
    """Tokens each source gives, `size` in all: its share, or its cap where that is less; what capped sources
    leave over goes to the others in proportion to their targets, until nothing can grow any more."""
    fixed: dict[str, float] = {}
    free = {s for s in targets if available.get(s, 0) > 0}
    fixed |= {s: 0.0 for s in targets if s not in free}
    while free:
        left = size - sum(fixed.values())
        weight = sum(targets[s].share for s in free)
        over = {s for s in free if left * targets[s].share / weight > targets[s].most * available[s]}
        if not over:
            return fixed | {s: left * targets[s].share / weight for s in free}
        fixed |= {s: targets[s].most * available[s] for s in over}
        free -= over
    return fixed


def split_quotas(counts: np.ndarray, shards: int, rng: np.random.Generator, first: int = 0, last: int | None = None, all_shards: int | None = None, total: int | None = None, leaves: int = 1) -> np.ndarray:
    """Deal `counts` (draws by source) to `shards`, whose sizes differ by one draw at most: a (shards, sources) array.

    A binary tree: each node gives its left half an exact number of draws, without replacement over sources. For a
    subtree, first and last are its shards among all_shards, which share `total` draws. With `leaves` above 1 the tree
    stops at nodes of so many shards, and a row stands for such a node.
    """
    last = shards if last is None else last
    total = int(counts.sum()) if total is None else total
    ends = lambda i: total * i // (all_shards or shards)
    out = []
    stack = [(first, last, counts.astype(np.int64))]
    while stack:
        lo, hi, own = stack.pop()
        if hi - lo <= leaves:
            out.append((lo, own))
            continue
        middle = lo + leaves * ((hi - lo) // leaves // 2 or 1)
        left = rng.multivariate_hypergeometric(own, ends(middle) - ends(lo), method="marginals") if own.sum() else own
        stack += [(lo, middle, left), (middle, hi, own - left)]
    return np.array([own for _, own in sorted(out, key=lambda x: x[0])]).reshape(-1, len(counts))


@dataclass
class Plan:
    draws: DataFrame  # source, block, pos (in the order of draws), last (its place in the last pass, or null), n_blocks, passes, width
    stretches: DataFrame  # source, shard, lo, hi: the draws lo..hi - 1 of the source; bucket: one row for each stretch of `width` draws they touch
    blocks: dict[str, int]  # number of blocks by source
    shards: int
    rows: int  # of the stretches, at most
    report: list[tuple]  # source, target_share, available, quota


def block_of(doc_id: Column, n_blocks: Column, seed: int) -> Column:
    """The block of a document within its source."""
    return F.pmod(F.xxhash64(F.lit(seed), doc_id), n_blocks)


def _order(wanted: dict[str, float], targets: dict[str, Target], seed: int):
    """A source's draws: as many whole passes over its permuted blocks as its quota and cap hold, then a part of one."""

    def order(group: pd.DataFrame) -> pd.DataFrame:
        source = group["source"].iloc[0]
        rng = np.random.default_rng([seed, zlib.crc32(source.encode())])
        sizes = dict(sorted(zip(group["block"].tolist(), group["tokens"].tolist())))
        permuted = rng.permutation(list(sizes)).tolist()
        quota, most = wanted[source], targets[source].most
        passes = int(min(quota // sum(sizes.values()), most))
        got, last = passes * sum(sizes.values()), {}
        if passes < most:
            for b in rng.permutation(list(sizes)).tolist():
                if abs(quota - got - sizes[b]) < quota - got:  # a block is taken if that comes nearer to the quota
                    last[b] = len(last)
                    got += sizes[b]
        rows = [(source, b, pos, last.get(b), len(sizes), passes, passes * len(sizes) + len(last), got) for pos, b in enumerate(permuted)]
        frame = pd.DataFrame(rows, columns=["source", "block", "pos", "last", "n_blocks", "passes", "draws", "tokens"])
        return frame.astype({"last": "Int64"})

    return order


def plan_mixture(
    counted: DataFrame, targets: dict[str, Target], shards: int | None = None, blocks: int = 1024, size: float | None = None, seed: int = 0, tokens_per_shard: int = 1_000_000, subtrees: int = 256
) -> Plan:
    """Which draws of which source go to which shard. `size` is the mixture's tokens, by default those of all documents.

    The plan has one row per source and block and one per source and shard, however often a source is repeated; both are
    made and kept on the executors. The driver holds a few numbers per source, and `subtrees` nodes of the splitting tree.
    """
    spark = counted.sparkSession
    totals = {r.source: (r.tokens, r.n) for r in counted.where(F.col("source").isin(*targets)).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()}
    if size is None:
        size = counted.agg(F.sum("tokens")).first()[0] or 0
    wanted = quotas(targets, {s: t for s, (t, _) in totals.items()}, size)
    number = {s: int(min(blocks, n)) for s, (_, n) in totals.items()}
    names = sorted(s for s in totals if number[s] and wanted[s] > 0)
    schema = "source string, block long, pos long, last long, n_blocks long, passes long, draws long, tokens long"
    drawn = spark.createDataFrame([], schema)
    if names:
        by_name = F.create_map(*[F.lit(x) for s in names for x in (s, number[s])])
        sums = counted.where(F.col("source").isin(*names)).withColumn("block", block_of(F.col("doc_id"), by_name[F.col("source")], seed))
        sums = sums.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
        drawn = checkpointed(sums.groupBy("source").applyInPandas(_order(wanted, targets, seed), schema))  # at most `blocks` rows each
    each = {r.source: (r.draws, r.tokens) for r in drawn.groupBy("source").agg(F.max("draws").alias("draws"), F.max("tokens").alias("tokens")).collect() if r.draws}
    names = sorted(each)
    if shards is None:
        shards = max(1, math.ceil(sum(t for _, t in each.values()) / tokens_per_shard))
    counts = np.array([each[s][0] for s in names], dtype=np.int64)
    total, leaves = int(counts.sum()), max(1, math.ceil(shards / subtrees))
    top = split_quotas(counts, shards, np.random.default_rng(seed), leaves=leaves) if names else np.zeros((0, 0), dtype=np.int64)
    starts = np.cumsum(top, axis=0) - top
    # split_quotas returns nodes in order of their shards; their bounds follow from the same halving
    bounds = _leaf_bounds(shards, leaves)
    rows = [(lo, hi, top[i].tolist(), starts[i].tolist()) for i, (lo, hi) in enumerate(bounds)] if names else []

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo, hi, own, base in zip(batch["lo"].tolist(), batch["hi"].tolist(), batch["own"].tolist(), batch["base"].tolist()):
                dealt = split_quotas(np.array(own, dtype=np.int64), hi - lo, np.random.default_rng([seed, lo]), lo, hi, shards, total)
                to = np.cumsum(dealt, axis=0) + np.array(base, dtype=np.int64)
                shard, k = np.nonzero(dealt)
                if not len(k):
                    continue
                yield pd.DataFrame({"source": [names[i] for i in k], "shard": shard + lo, "lo": to[shard, k] - dealt[shard, k], "hi": to[shard, k]})

    nodes = spark.createDataFrame(rows, "lo long, hi long, own array<long>, base array<long>")
    stretches = nodes.repartition(max(1, min(len(rows), 64))).mapInPandas(finish, "source string, shard long, lo long, hi long")
    width = F.greatest(F.lit(1), F.ceil(F.col("draws") / shards))
    widths = drawn.groupBy("source").agg(F.max("draws").alias("draws")).select("source", width.alias("width"))
    stretches = stretches.join(widths, "source").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / F.col("width")), F.floor((F.col("hi") - 1) / F.col("width"))))).drop("width")
    report = [(s, targets[s].share, totals.get(s, (0, 0))[0], float(wanted[s])) for s in sorted(targets)]
    return Plan(drawn.withColumn("width", width).drop("draws", "tokens"), stretches, number, shards, 2 * len(names) * shards, report)


def _leaf_bounds(shards: int, leaves: int) -> list[tuple[int, int]]:
    out, stack = [], [(0, shards)]
    while stack:
        lo, hi = stack.pop()
        if hi - lo <= leaves:
            out.append((lo, hi))
        else:
            middle = lo + leaves * ((hi - lo) // leaves // 2 or 1)
            stack += [(lo, middle), (middle, hi)]
    return sorted(out)


def mixture(documents: DataFrame, targets: DataFrame, shards: int | None = None, blocks: int = 1024, seed: int = 0, tokenizer: str = DEFAULT_TOKENIZER, tokens_per_shard: int = 1_000_000) -> DataFrame:
    """The mixed corpus: documents' columns with source cleaned, plus copy, shard and place (the order in the shard);
    columns of the documents that have one of these three names are replaced.

    Shards have about `tokens_per_shard` tokens unless their number is given. Documents are ordered in their shard by a
    hash that differs between copies. Documents of sources without target are left out.
    """
    counted = checkpointed(token_counts(documents, tokenizer))
    plan = plan_mixture(counted, clean_targets(targets), shards, blocks, seed=seed, tokens_per_shard=tokens_per_shard)
    return _deal(documents, plan, seed)


def _deal(documents: DataFrame, plan: Plan, seed: int, most_partitions: int = 20_000, most_broadcast: int = 200_000) -> DataFrame:
    """The documents of the plan's draws in their shards. Up to `most_broadcast` rows (about 10 MB) the stretches are
    broadcast, so that texts move once; beyond it they are joined by source and stretch of draws. Beyond `most_partitions` several shards share a partition, one behind the other."""
    kept = [c for c in documents.columns if c not in ("copy", "shard", "place")]
    documents = documents.select(*kept)
    if not plan.blocks:
        return documents.limit(0).select("*", F.lit(0).alias("copy"), F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("place"))
    number = F.create_map(*[F.lit(x) for s, n in plan.blocks.items() for x in (s, n)])
    mine = documents.where("doc_id is not null").withColumn("source", clean_source(F.col("source")))
    mine = mine.withColumn("__block", block_of(F.col("doc_id"), number[F.col("source")], seed))
    draws = plan.draws.select("source", *[F.col(c).alias(f"__{c}") for c in ("block", "pos", "last", "n_blocks", "passes", "width")])
    copies = F.col("__passes") + F.col("__last").isNotNull().cast("long")
    every = mine.join(draws, ["source", "__block"]).where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    place_of_draw = F.col("copy") * F.col("__n_blocks") + F.when(F.col("copy") < F.col("__passes"), F.col("__pos")).otherwise(F.col("__last"))
    every = every.withColumn("__t", place_of_draw).withColumn("__bucket", F.floor(F.col("__t") / F.col("__width")))
    stretches = plan.stretches.select("source", F.col("bucket").alias("__bucket"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), "shard")
    stretches = F.broadcast(stretches) if plan.rows <= most_broadcast else stretches
    dealt = every.join(stretches, ["source", "__bucket"]).where("__lo <= __t and __t < __hi").withColumn("copy", F.col("copy").cast("int"))
    place = F.xxhash64(F.lit(seed + 1), "doc_id", "copy", "shard").alias("place")
    partitions = min(plan.shards, most_partitions)
    return dealt.select(*kept, "copy", "shard", place).repartitionById(partitions, F.expr(f"cast(shard % {partitions} as int)")).sortWithinPartitions("shard", "place")


def shares_reached(documents: DataFrame, targets: DataFrame, shards: int | None = None, blocks: int = 1024, seed: int = 0, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(source, target_share, available_tokens, quota_tokens, tokens, actual_share, copies) of each target source.

    target_share is scaled so that all add up to 1; copies is how many times its documents are used at most.
    tokens are counted on the dealt documents themselves, not taken from the plan.
    """
    spark: SparkSession = documents.sparkSession
    counted = checkpointed(token_counts(documents, tokenizer))
    plan = plan_mixture(counted, clean_targets(targets), shards, blocks, seed=seed)
    got = _deal(counted, plan, seed).groupBy("source").agg(F.sum("tokens").alias("tokens"), (F.max("copy") + 1).alias("copies"))
    total = got.agg(F.sum("tokens")).first()[0] or 1
    base = spark.createDataFrame(plan.report, "source string, target_share double, available_tokens long, quota_tokens double")
    tokens = F.coalesce("tokens", F.lit(0))
    return base.join(got, "source", "left").select(
        *base.columns, tokens.alias("tokens"), (tokens / F.lit(total)).alias("actual_share"), F.coalesce("copies", F.lit(0)).alias("copies")
    )
