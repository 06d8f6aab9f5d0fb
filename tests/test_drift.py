import datetime as dt
import json
import random

from codestrata.operators import drift

SCHEMA = "record_id long, file_name string, line_no int, suite string, runner string, written_at timestamp, payload string, fields string, kind string"


def table(spark, files):
    rows, n = [], 0
    for day, (name, suite, payloads) in enumerate(files):
        for i, p in enumerate(payloads, 1):
            n += 1
            rows.append((n, name, i, suite, "r", dt.datetime(2026, 1, 1) + dt.timedelta(days=day), p if p is None or isinstance(p, str) else json.dumps(p), "clash", "clash"))
    return spark.createDataFrame(rows, SCHEMA)


def changes(spark, files):
    return sorted(map(tuple, drift.field_changes(table(spark, files)).collect()))


def test_kinds_of_change(spark):
    files = [
        ("a", "s", [{"gate": {"passed": True, "missed": []}, "n": 1, "x": "1", "old": 5}]),
        ("b", "s", [{"gate": {"ok": True, "missed": [{"q": 1}]}, "n": "1", "x": "1", "p": True, "q": 2, "old": 5}, None, "{broken"]),
        ("c", "s", [{"gate": "passed", "n": "1", "x": "1", "fresh": 7, "p": True, "q": 2}]),
    ]
    assert changes(spark, files) == [
        ("b", "added", "", "gate.missed.q"),
        ("b", "added", "", "p"),
        ("b", "added", "", "q"),
        ("b", "renamed", "gate.passed", "gate.ok"),
        ("b", "retyped", "n", "n"),
        ("c", "renamed", "old", "fresh"),
        ("c", "retyped", "gate", "gate"),
    ]


def test_series_nulls_repeats_and_empty(spark):
    assert changes(spark, [("a", "s", [{"x": 1}]), ("b", "t", [{"y": 1}])]) == []
    assert changes(spark, [("a", "s", [{"x": 1, "z": None}]), ("b", "s", [{"x": 2}, {"x": 2}])]) == []
    assert drift.field_changes(table(spark, []) if False else spark.createDataFrame([], SCHEMA)).collect() == []
    nulls = spark.createDataFrame([(None, None, None, None, None, None, None, None, None)], SCHEMA)
    assert drift.field_changes(nulls).collect() == []


def brute(old, new):
    def rec(parent):
        level = lambda f: {p for p in f if p.rpartition(".")[0] == parent and p}
        went, came = level(old) - level(new), level(new) - level(old)
        if len(went) == len(came) == 1 and old[min(went)] == new[min(came)]:
            out = [("renamed", min(went), min(came))]
        else:
            out = [("removed", p, "") for p in went] + [("added", "", p) for p in came]
        for p in level(old) & level(new):
            out += [("retyped", p, p)] if old[p] != new[p] else rec(p)
        return out

    return sorted(rec(""))


def test_flooding_agrees_with_the_definition():
    rng = random.Random(3)

    def schema(names):
        out = {}
        for n in names:
            out[n] = rng.choice(["string", "number", "object"])
            if out[n] == "object":
                for c in rng.sample("uvwxy", 2):
                    out[f"{n}.{c}"] = rng.choice(["string", "array"])
        return out

    for _ in range(300):
        old = schema(rng.sample("abcdef", 4))
        new = dict(old) if rng.random() < 0.3 else schema(rng.sample("abcdef", 4))
        for p in [p for p in new if rng.random() < 0.15]:
            new = {q: k for q, k in new.items() if q != p and not q.startswith(p + ".")}
        assert drift.schema_changes(old, new) == brute(old, new)


def test_scores_decide_where_several_fields_go_and_come():
    old = {"b_cpu": "number", "a_mem": "number", "p": "object", "p.u": "string", "p.v": "string", "q": "object", "q.w": "string", "s.t": "number"}
    new = {"cpu_x": "number", "mem_y": "number", "r": "object", "r.w": "string", "z": "object", "z.u": "string", "z.v": "string", "k.t": "number"}
    old |= {"s": "object", "k": "object"}
    new |= {"s": "object", "k": "object"}
    right = {"b_cpu": "cpu_x", "a_mem": "mem_y", "p": "z", "p.u": "z.u", "p.v": "z.v", "q": "r", "q.w": "r.w", "s": "s", "k": "k", "s.t": "k.t"}
    assert drift.correspondences(old, new) == right
    told = drift.matched_changes(old, new, right)
    assert sorted(told) == [("moved", "s.t", "k.t"), ("renamed", "a_mem", "mem_y"), ("renamed", "b_cpu", "cpu_x"), ("renamed", "p", "z"), ("renamed", "q", "r")]
    flat = dict.fromkeys(drift.flood(old, new), 0.0)
    assert drift.correspondences(old, new, flat) != right  # without the scores the choice is another
    rng = random.Random(2)
    assert any(drift.correspondences(old, new, {p: rng.random() for p in flat}) != right for _ in range(5))
    assert ("removed", "p", "") in drift.schema_changes(old, new)  # the report's exact check splits what is not single


def test_names_are_unified_per_series_and_never_within_a_record(spark):
    files = [("a", "s", [{"x": 1, "k": 5}]), ("b", "s", [{"y": 2, "k": 5}]), ("c", "t", [{"y": 3, "k": 5}]), ("d", "u", [{"x": 1}]), ("e", "u", [{"y": 1}]), ("f", "u", [{"x": 1, "y": 2}])]
    got = {(r.record_id, r.field, r.text) for r in drift.consistent_table(table(spark, files)).collect()}
    assert got == {(1, "x", "1"), (1, "k", "5"), (2, "x", "2"), (2, "k", "5"), (3, "y", "3"), (3, "k", "5"), (4, "x", "1"), (5, "y", "1"), (6, "x", "1"), (6, "y", "2")}
    wide = {r.record_id: (r.x, r.y, r.k) for r in drift.wide_table(drift.consistent_table(table(spark, files))).collect()}
    assert wide[2] == (2.0, None, 5.0) and wide[6] == (1.0, 2.0, None)
    twice = table(spark, files[:1]).unionByName(table(spark, files[:1]).selectExpr("record_id + 100 as record_id", "* except (record_id)"))
    assert {r.record_id for r in drift.consistent_table(twice).collect()} == {1}


def test_consistent_table_unifies_names_and_keeps_text(spark):
    files = [("a", "s", [{"gate": {"passed": "7"}}]), ("b", "s", [{"gate": {"ok": "8"}}]), ("c", "s", [{"gate": {"ok": True}}])]
    rows = {(r.record_id, r.field, r.text, r.number, r.flag) for r in drift.consistent_table(table(spark, files)).collect()}
    assert rows == {(1, "gate.passed", "7", 7.0, None), (2, "gate.passed", "8", 8.0, None), (3, "gate.passed", "true", None, True)}


def test_deep_and_long_payloads(spark):
    deep = "[" * 400 + "1" + "]" * 400
    long = json.dumps({"t": "x" * 2_000_000, "d": json.loads(deep)})
    assert changes(spark, [("a", "s", [long]), ("b", "s", [{"t": "y", "d": []}])]) == []
