import datetime as dt
import random

import pytest

from codestrata.operators import incremental as inc
from codestrata.operators.bucketed import first_after, previous_row
from pyspark.sql import functions as F

DAY = dt.datetime(2026, 1, 1)


def at(hours):
    return DAY + dt.timedelta(hours=hours)


CHANGES = "change_id long, checkout_id long, path string, commit_sha string, content_sha string, arrived_at timestamp, run_id string, lo int"
RUNS = "run_id long, checkout_id long, started_at timestamp, ms int"
STATES = "state_id long, run_id long, last_indexed_commit string, tree_clean boolean"


def found(spark, changes, runs, states):
    tables = (spark.createDataFrame([(*c, "clash", 0) for c in changes], CHANGES), spark.createDataFrame(runs, RUNS), spark.createDataFrame(states, STATES))
    return sorted(map(tuple, inc.changes_per_run(*tables).collect()))


def test_rules(spark):
    changes = [
        (1, 1, "a", "c1", "x", at(0)), (2, 1, "a", "c1", "y", at(1)),  # delivered again
        (3, 1, "a", None, "x", at(2)),  # the same content: no change
        (4, 1, "a", None, None, at(3)), (5, 1, "a", None, None, at(4)),  # deleted, deleted again
        (6, 1, None, None, "n", at(5)), (7, 1, "b", "c1", "x", at(30)), (8, 1, "b", "c9", "z", at(900)),
        (9, None, "b", "c1", "x", at(1)), (10, 1, "b", "c1", "x", None),
    ]
    runs = [(1, 1, at(2), 5), (1, 1, at(2), 5), (2, 1, at(4), None), (3, 1, at(10), 1), (4, 1, at(30), 1), (5, 1, at(600), 1), (6, 2, at(1), 1), (7, None, at(1), 1), (8, 1, None, 1)]
    states = [(1, 1, "s", True), (2, 1, "s", True), (3, 2, "", True), (4, 3, "s", True), (5, 4, "s", True), (6, 5, "s", True), (7, 6, "s", False), (8, 7, "s", None), (9, 8, "s", True), (10, 2, None, True)]
    assert found(spark, changes, runs, states) == [(1, 1), (3, 4), (3, 6), (5, 7)]


def test_empty(spark):
    assert found(spark, [], [], []) == []
    assert found(spark, [(1, 1, "a", None, "x", at(0))], [], []) == []


def test_against_brute_force(spark):
    rng = random.Random(5)
    changes = [(i, rng.choice([1, 1, 1, 2]), rng.choice("ab"), rng.choice([None, "c1", "c2", "c3"]), rng.choice([None, "x", "y"]), at(rng.randrange(0, 400))) for i in range(300)]
    runs = [(i, rng.choice([1, 2]), at(rng.randrange(0, 500)), 1) for i in range(40)]
    states = [(i, i, rng.choice(["s", "s", "", None]), rng.choice([True, True, False, None])) for i in range(40)]
    good = {r for _, r, c, t in states if c and t}
    seen, last, expected = set(), {}, []
    for i, checkout, path, commit, content, when in sorted(changes, key=lambda c: (c[5], c[0])):
        if commit is not None and (checkout, path, commit) in seen:
            continue
        seen.add((checkout, path, commit))
        if last.get((checkout, path), "-") == content:
            continue
        last[checkout, path] = content
        later = [(start, r) for r, c, start, _ in runs if r in good and c == checkout and start > when]
        if later:
            expected.append((min(later)[1], i))
    assert found(spark, changes, runs, states) == sorted(expected)


def test_intervals(spark):
    make = lambda rows: spark.createDataFrame(rows, "k string, lo long, hi long")
    merged = inc.merge_intervals(make([("a", 1, 3), ("a", 3, 5), ("a", 4, 4), ("a", 8, 9), ("a", 8, 9), ("b", 2, 1), ("a", 2, 4)]), ["k"])
    assert sorted(map(tuple, merged.collect())) == [("a", 1, 5), ("a", 8, 9)]
    rest = inc.subtract_intervals(make([("a", 0, 10), ("b", 0, 2)]), make([("a", 2, 4), ("a", 3, 6), ("c", 0, 1), ("a", 9, 20)]), ["k"])
    assert sorted(map(tuple, rest.collect())) == [("a", 0, 2), ("a", 6, 9), ("b", 0, 2)]
    rng = random.Random(8)
    many = [("a", x, x + rng.randrange(0, 9)) for x in (rng.randrange(300) for _ in range(60))]
    points = {p for _, x, y in many for p in range(x, y)}
    merged = sorted(map(tuple, inc.merge_intervals(make(many), ["k"], bucket=10).collect()))
    assert {p for _, x, y in merged for p in range(x, y)} == points
    assert all(a[2] < b[1] for a, b in zip(merged, merged[1:]))
    assert inc.subtract_intervals(make([]), make([("a", 1, 2)]), ["k"]).collect() == []


def test_ledger_takes_late_rows_and_survives_dead_runs(spark, tmp_path):
    ledger = inc.IncrementalLedger(spark, str(tmp_path / "l"), ["k"], "seq")
    rows = lambda *xs: spark.createDataFrame([("a", x) for x in xs], "k string, seq long")
    covered = lambda *xs: spark.createDataFrame([("a", x, x + 1) for x in xs], "k string, lo long, hi long")
    assert ledger.pending(rows(1, 2, 5)).count() == 3
    ledger.commit(rows(1, 2, 5), covered(1, 2, 5))
    rows(3, 9).write.parquet(str(tmp_path / "l" / "output" / "dead"))  # a run that died before its manifest
    assert sorted(r.seq for r in ledger.pending(rows(1, 2, 3, 5, 9)).collect()) == [3, 9]
    ledger.commit(rows(3, 9), covered(3, 9))
    assert sorted(r.seq for r in ledger.output().collect()) == [1, 2, 3, 5, 9]
    assert sorted((r.lo, r.hi) for r in ledger.intervals().collect()) == [(1, 4), (5, 6), (9, 10)]
    assert ledger.pending(rows(1, 2, 3, 5, 9)).count() == 0


def test_runs_that_the_ledger_holds_are_not_handled_again(spark, tmp_path):
    root = str(tmp_path / "l")
    changes = [(i, 1, f"p{i}", None, "x", at(i)) for i in range(6)]
    states = [(i, i, "s", True) for i in range(3)]
    table = lambda n: spark.createDataFrame([(*c, "clash", 0) for c in changes[:n]], CHANGES)
    runs = [(0, 1, at(2), 1), (1, 1, at(4), 1), (2, 1, at(9), 1)]
    make = lambda n: (spark.createDataFrame(runs[:n], RUNS), spark.createDataFrame(states[:n], STATES))
    assert inc.changes_per_run(table(4), *make(2), root).count() == 4
    spark.createDataFrame([(9, 9)], "run_id long, change_id long").write.parquet(f"{root}/output/dead")  # died between output and manifest
    assert sorted(map(tuple, inc.changes_per_run(table(6), *make(3), root).collect())) == [(0, 0), (0, 1), (1, 2), (1, 3), (2, 4), (2, 5)]


def test_a_claim_left_by_a_dead_writer_is_taken_over(spark, tmp_path):
    ledger = inc.IncrementalLedger(spark, str(tmp_path / "l"), ["k"], "seq")
    (tmp_path / "l" / "manifest").mkdir(parents=True)
    (tmp_path / "l" / "manifest" / "1.claim").write_text("")
    one, covered = spark.createDataFrame([("a", 1)], "k string, seq long"), spark.createDataFrame([("a", 1, 2)], "k string, lo long, hi long")
    with pytest.raises(inc.ConcurrentCommit):
        ledger.commit(one, covered)
    ledger.stale_ms = -1
    assert ledger.commit(one, covered) == 1


def test_concurrent_commit_is_refused(spark, tmp_path):
    ledger = inc.IncrementalLedger(spark, str(tmp_path / "l"), ["k"], "seq")
    one = spark.createDataFrame([("a", 1)], "k string, seq long")
    covered = spark.createDataFrame([("a", 1, 2)], "k string, lo long, hi long")
    ledger.commit(one, covered)
    stale = inc.IncrementalLedger(spark, str(tmp_path / "l"), ["k"], "seq")
    stale.version = lambda: 0
    with pytest.raises(inc.ConcurrentCommit):
        stale.commit(one, covered)


def test_bucketed_windows_equal_plain_ones(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["k", "k", None]), rng.randrange(500), i) for i in range(200)]
    df = spark.createDataFrame([(k, at(h), i) for k, h, i in rows], "k string, t timestamp, i long")
    got = {r.i: r.p and r.p.i for r in previous_row(df, ["k"], ["t", "i"], F.date_trunc("day", "t"), ["i"], "p").collect()}
    for key in ("k", None):
        ordered = sorted((h, i) for k, h, i in rows if k == key)
        for (_, before), (_, i) in zip([(None, None), *ordered], ordered):
            assert got[i] == before
    marks = spark.createDataFrame([("k", at(h), h) for h in range(0, 500, 37)] + [("k", None, 1)], "k string, m timestamp, v long")
    for r in first_after(df.where("k is not null"), marks, ["k"], "t", "m", ["v"], "hit").collect():
        hour = (r.t - DAY).total_seconds() / 3600
        later = [h for h in range(0, 500, 37) if h > hour]
        assert (r.hit.v if r.hit else None) == (min(later) if later else None)
