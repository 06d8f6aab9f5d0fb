import json

from codestrata.operators import shred

SCHEMA = "record_id long, file_name string, line_no int, payload string, node string, kind string"


def raw(spark, rows):
    return spark.createDataFrame([(i, f, n, p if p is None or isinstance(p, str) else json.dumps(p), "clash", "clash") for i, f, n, p in rows], SCHEMA)


def children(spark, rows):
    return sorted(map(tuple, shred.nested_children(raw(spark, rows)).collect()))


FENCE = {"file": "M.md", "index": 1, "nodeCount": 3, "problems": [{"code": "E1", "at": {"line": 1, "col": 2}}, {"code": "E1"}]}
EXPECTED = [("cpu", "", 0, 1), ("fence", "M.md", 1, 0), ("problem", "M.md", 1, 1), ("problem", "M.md", 1, 2)]


def test_every_shape(spark):
    rows = [
        (1, "f", 1, {"diagrams": {"byFence": [FENCE]}, "machine": {"cpu": "X"}}),
        (2, "f", 2, {"diagrams": {"byFence": FENCE}, "machine": {"cpuModel": {"model": "X"}}}),
        (3, "f", 3, {"diagrams": {"byFence": [{"file": "M.md", "fences": [{k: v for k, v in FENCE.items() if k != "file"}]}]}, "machine": {"processor": ["X"]}}),
        (4, "f", 4, {"diagrams": json.dumps({"byFence": [FENCE]}), "machine": {"cpu": [{"model": "X", "slot": 0}, {"model": "Y", "slot": 1}]}}),
    ]
    expected = [(i, *e) for i in (1, 2, 3, 4) for e in EXPECTED] + [(4, "cpu", "", 0, 2)]
    assert children(spark, rows) == sorted(expected)


def test_repeats_broken_nulls_and_empty(spark):
    good = {"machine": {"cpu": "X"}}
    rows = [(5, "f", 1, good), (4, "f", 1, good), (3, "f", 1, "{broken"), (6, None, None, good), (7, None, None, good), (8, "f", 2, None), (9, "f", 3, "[1]"), (None, "f", 4, good)]
    assert [r[0] for r in children(spark, rows)] == [4, 6, 7]
    assert children(spark, rows[:2] * 2) == [(4, "cpu", "", 0, 1)]
    assert shred.nested_children(spark.createDataFrame([], SCHEMA)).collect() == []


def test_adjacency_and_flat_tables(spark):
    rows = raw(spark, [(1, "f", 1, {"diagrams": {"byFence": [FENCE, {"file": "N.md", "index": 2, "node_count": 9}]}, "machine": {"cpu": {"model": "X", "speed": 2.5}}})])
    nodes = shred.shred(rows)
    whole = {(r.node, r.parent, r.label, r.ordinal, r.scalar) for r in nodes.where("label in ('byFence', 'index')").collect()}
    assert any(label == "byFence" and ordinal == 2 for _, _, label, ordinal, _ in whole)
    fences = shred.fences(nodes)
    assert sorted((r.file, r.fence_index, r.node_count) for r in fences.collect()) == [("M.md", 1, 3), ("N.md", 2, 9)]
    assert sorted((r.item_no, r.code, r.line) for r in shred.problems(nodes, fences).collect()) == [(1, "E1", 1), (2, "E1", None)]
    assert [(r.model, r.speed) for r in shred.cpus(nodes).collect()] == [("X", 2.5)]


def test_deep_nesting(spark):
    deep = '{"a":' * 300 + "1" + "}" * 300
    assert shred.shred(raw(spark, [(1, "f", 1, deep)])).count() == 301
