import random

import numpy as np
import pytest

from codestrata.llm import mixing as M

DOCS = "doc_id long, source string, text string, shard string, tokens int"
TARGETS = "source string, target_share double, max_repeats int, note string"


def documents(spark):
    rng = random.Random(1)
    rows = [(i, ["Big", "mid_dle ", "small", "unused", None][min(4, i % 7)] if i % 7 < 5 else "big", " ".join(["word"] * rng.randrange(5, 60)), "clash", 1) for i in range(400)]
    return spark.createDataFrame([*rows, (1000, "big", None, "clash", 1), (1001, "big", "", "clash", 1)], DOCS)


def test_quotas_respect_caps_and_fill_up():
    t = {"a": M.Target(0.5, 1), "b": M.Target(0.3, float("inf")), "c": M.Target(0.2, 2), "d": M.Target(0.1, 3)}
    q = M.quotas(t, {"a": 100, "b": 50, "c": 1000}, 1000)
    assert q["a"] == 100 and q["d"] == 0 and sum(q.values()) == pytest.approx(1000) and q["b"] / q["c"] == pytest.approx(1.5)
    assert sum(M.quotas({"a": M.Target(1.0, 2)}, {"a": 10}, 1000).values()) == 20
    assert M.quotas(t, {}, 10) == dict.fromkeys("abcd", 0.0)


def test_splitting_tree_is_exact_and_fair():
    counts = np.array([50, 7, 0, 300])
    totals = np.zeros((8, 4))
    for seed in range(300):
        out = M.split_quotas(counts, 8, np.random.default_rng(seed))
        assert (out.sum(axis=0) == counts).all() and out.sum(axis=1).max() - out.sum(axis=1).min() <= 1 and (out >= 0).all()
        totals += out
    assert np.allclose(totals / 300, counts / 8, rtol=0.15, atol=0.15)


def test_subtrees_deal_the_same_exact_quotas():
    counts = np.array([50, 7, 0, 300])
    for shards, leaves in ((8, 3), (37, 4), (5, 9)):
        top = M.split_quotas(counts, shards, np.random.default_rng(1), leaves=leaves)
        bounds = M._leaf_bounds(shards, leaves)
        assert len(bounds) == len(top) and [b[0] for b in bounds[1:]] == [b[1] for b in bounds[:-1]]
        out = np.concatenate([M.split_quotas(own, hi - lo, np.random.default_rng(lo), lo, hi, shards, 357) for own, (lo, hi) in zip(top, bounds)])
        assert out.shape == (shards, 4) and (out.sum(axis=0) == counts).all() and np.ptp(out.sum(axis=1)) <= 1


def test_a_tiny_source_without_cap_keeps_the_plan_small(spark):
    rows = [(i, "big", "word " * 50, "x", 1) for i in range(200)] + [(1000, "tiny", "word " * 3, "x", 1), (1001, "tiny", "word " * 4, "x", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("big", 0.5, 1, "x"), ("tiny", 0.5, None, "x")], TARGETS)
    plan = M.plan_mixture(M.token_counts(docs), M.clean_targets(targets), shards=4, blocks=16)
    assert plan.draws.count() <= 16 + 2
    assert plan.stretches.select("source", "shard").distinct().count() <= 2 * 4
    shares = {r.source: r for r in M.shares_reached(docs, targets, shards=4, blocks=16).collect()}
    assert shares["tiny"].copies > 500 and shares["tiny"].tokens == pytest.approx(shares["tiny"].quota_tokens, abs=8)


def test_mixture_meets_shares_and_caps(spark):
    docs = documents(spark)
    targets = spark.createDataFrame([("BIG", 0.4, 1, "x"), ("big ", 0.4, 2, "x"), ("mid-dle", 0.3, None, "x"), ("small", 0.3, 2, "x"), ("gone", 0.2, 1, "x"), ("zero", 0.0, 1, "x"), (None, 0.5, 1, "x"), ("null", None, 1, "x")], TARGETS)
    shares = {r.source: r for r in M.shares_reached(docs, targets, shards=5, blocks=64).collect()}
    assert set(shares) == {"big", "mid-dle", "small", "gone"}
    assert sum(r.target_share for r in shares.values()) == pytest.approx(1)
    assert shares["gone"].tokens == 0 and shares["big"].copies <= 1 and shares["small"].copies <= 2
    for r in shares.values():
        assert r.tokens == pytest.approx(r.quota_tokens, rel=0.1, abs=60)
    mixed = M.mixture(docs, targets, shards=5, blocks=64)
    assert mixed.columns == ["doc_id", "source", "text", "tokens", "copy", "shard", "place"]
    rows = mixed.collect()
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows)  # draws are disjoint
    assert {r.shard for r in rows} == set(range(5))
    again = M.mixture(docs.repartition(7), targets, shards=5, blocks=64).collect()
    assert sorted((r.doc_id, r.copy, r.shard, r.place) for r in rows) == sorted((r.doc_id, r.copy, r.shard, r.place) for r in again)


def test_empty_tables_and_long_text(spark):
    docs = documents(spark)
    targets = spark.createDataFrame([("big", 1.0, 1, "x")], TARGETS)
    assert M.mixture(docs.limit(0), targets).collect() == M.mixture(docs, targets.limit(0)).collect() == []
    long = spark.createDataFrame([(1, "big", "word " * 200_000, "clash", 1)], DOCS)
    assert M.shares_reached(long, targets, shards=2).first().tokens > 100_000
