import random

from codestrata.operators import graph


def edges(spark, pairs):
    return spark.createDataFrame([("r", a, b) for a, b in pairs], "repo string, src string, dst string")


def reach(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    found = set()
    for start in {x for p in pairs for x in p}:
        todo, seen = list(out.get(start, ())), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        found |= {(start, x) for x in seen}
    return found


def test_closure_components_and_blast_against_brute_force(spark):
    rng = random.Random(1)
    for size in (6, 12):
        pairs = [(f"n{rng.randrange(size)}", f"n{rng.randrange(size)}") for _ in range(size + 2)]
        want = reach(pairs)
        got = {(r.src, r.dst) for r in graph.closure(edges(spark, pairs + pairs)).collect()}
        assert got == want
        plain = reach([p for p in pairs if p[0] != p[1]])
        nodes = {x for p in pairs for x in p}
        scc = {n: min([n] + [m for m in nodes if (n, m) in plain and (m, n) in plain]) for n in nodes}
        groups = {n: c for n, c in scc.items() if sum(v == c for v in scc.values()) > 1}
        for size_of_block in (graph.BLOCK_EDGES, 3):  # one block, and many
            assert {r.node: r.component for r in graph.components(edges(spark, pairs), size_of_block).collect()} == groups
        table = spark.createDataFrame([("r", n) for n in sorted(nodes) + ["alone"]], "repo string, node string")
        for blocks in ((graph.BLOCK_EDGES, graph.BLOCK_SOURCES), (3, 2)):
            blast = {r.node: r.blast for r in graph.blast_radius(edges(spark, pairs), table, *blocks).collect()}
            assert blast == {n: sum(a != n for a, b in want if b == n) for n in nodes} | {"alone": 0}


def test_impact_depth_nulls_and_empty(spark):
    chain = edges(spark, [("b", "a"), ("c", "b"), ("d", "c"), ("a", "d"), ("e", "a")])
    target = spark.createDataFrame([("r", "a"), ("r", None)], "repo string, target string")
    for size_of_block in (graph.BLOCK_EDGES, 1):
        assert sorted((r.depth, r.node) for r in graph.impact(chain, target, block_edges=size_of_block).collect()) == [(1, "b"), (1, "e"), (2, "c"), (3, "d")]
        assert sorted(r.node for r in graph.impact(chain, target, most_depth=1, block_edges=size_of_block).collect()) == ["b", "e"]
    none = spark.createDataFrame([], "repo string, src string, dst string")
    assert graph.closure(none).count() == graph.components(none).count() == graph.impact(none, target).count() == 0


def test_impact_queries_have_no_depth_limit(spark, tmp_path):
    from codestrata.plans import codemap

    names = [f"n{i:02}.ts" for i in range(41)]
    steps = list(zip(names[1:], names)) + [(names[0], names[40]), ("m/x.go", names[3]), (names[7], "m")]  # a cycle of 41, and a directory
    spark.createDataFrame([(i, "r", p, 1) for i, p in enumerate([*names, "m/x.go"])], "file_id long, repo string, path string, loc int").write.parquet(f"{tmp_path}/files.parquet")
    rows = [("r", a, b, "import", "static", ["x"], b) for a, b in steps]
    spark.createDataFrame(rows, "repo string, from_path string, to_id string, kind string, import_kind string, symbols array<string>, specifier string").write.parquet(f"{tmp_path}/imports.parquet")
    spark.createDataFrame([], "repo string").write.parquet(f"{tmp_path}/symbols.parquet")
    after = {}
    for a, b in steps:
        after.setdefault("m/x.go" if b == "m" else b, set()).add(a)
    want = set()
    for target in after:
        seen, frontier, depth = {target}, {target}, 0
        while frontier:
            depth += 1
            frontier = {x for n in frontier for x in after.get(n, ())} - seen
            seen |= frontier
            want |= {(target, n, depth) for n in frontier}
    assert max(d for *_, d in want) > 25
    assert {(r.target, r.node, r.depth) for r in codemap.map_impact(spark, str(tmp_path)).collect()} == {w for w in want if w[0] == names[0]}
    found = [(r.target, r.node, r.depth) for r in codemap.map_impact_all(spark, str(tmp_path)).collect()]
    assert len(found) == len(want) and set(found) == want
    pairs = edges(spark, [(a, "m/x.go" if b == "m" else b) for a, b in steps])
    for size_of_block in (graph.BLOCK_EDGES, 20):  # one block of edges, and several
        found = [(r.target, r.node, r.depth) for r in graph.impact(pairs, pairs.selectExpr("repo", "dst as target"), block_edges=size_of_block, block_targets=7).collect()]
        assert len(found) == len(want) and set(found) == want


def test_a_node_with_more_edges_than_a_block(spark):
    pairs = [(f"u{i:03}", "hub") for i in range(60)] + [("hub", "base"), ("x", "u007")]
    table = spark.createDataFrame([("r", "hub"), ("r", "base"), ("r", "u007")], "repo string, node string")
    assert {r.node: r.blast for r in graph.blast_radius(edges(spark, pairs), table, 10, 16).collect()} == {"hub": 61, "base": 62, "u007": 1}
    found = graph.impact(edges(spark, pairs), spark.createDataFrame([("r", "base")], "repo string, target string"), block_edges=10).collect()
    assert len(found) == 62 and {r.node: r.depth for r in found}["x"] == 3


def test_front_doors_references_nodes_and_verdicts(spark):
    from codestrata.operators import answers

    files = spark.createDataFrame([("r", p) for p in ("a/main.ts", "a/b.ts", "a/c.ts", "d.ts", "api/x.ts", "docs/y.md")], "repo string, path string")
    row = "repo string, file string, id string, name string, kind string, parent string, exported boolean, signature string, span struct<start_line int, end_line int>"
    symbols = spark.createDataFrame(
        [("r", "a/c.ts", "a/c.ts#handler", "handler", "const", None, True, "export const handler = async () =>", (1, 2)), ("r", "d.ts", "d.ts#fetch", "fetch", "const", None, True, "export const fetch = 3", (1, 1)),
         ("r", "a/b.ts", "a/b.ts#route.x", "route.x", "route", None, True, "", (9, 9)), ("r", "a/b.ts", "a/b.ts#route.w", "route.w", "route", None, True, "", (2, 3)), ("r", "a/b.ts", "a/b.ts#route.w", "route.w", "route", None, True, "", (2, 3))], row
    )
    assert sorted(r.path for r in graph.front_doors(files, symbols).collect()) == ["a/c.ts", "a/main.ts"]
    imports = spark.createDataFrame([("r", "a/main.ts", "a/b.ts", "import"), ("r", "a/c.ts", "a/main.ts", "import")], "repo string, from_path string, to_id string, kind string")
    owner = files.selectExpr("repo", "path", "'p' as pkg")
    assert [(r.path, r.reach, r.place) for r in graph.entry_points(imports, files, owner, doors=graph.front_doors(files, symbols)).collect()] == [("a/c.ts", 2, 1)]
    assert [(r.id, r.place) for r in answers.nodes_of(symbols).orderBy("place").collect()] == [("a/b.ts#route.w", 1), ("a/b.ts#route.x", 2)]
    refs = spark.createDataFrame([("r", "a/b.ts#route.x", "d.ts", "route-handler"), ("r", "d.ts", "d.ts", "x")], "repo string, `from` string, `to` string, ref_kind string")
    assert ("d.ts", "in", "a/b.ts#route.x") in {(r.id, r.direction, r.other) for r in answers.references_at(refs).collect()}
    both = graph.impact_pairs(edges(spark, [("a/main.ts", "a/b.ts"), ("d.ts", "a/c.ts")]), refs)
    found = graph.impact(both, spark.createDataFrame([("r", "a/c.ts")], "repo string, target string")).collect()
    assert {(r.node, r.depth) for r in found} == {("d.ts", 1), ("a/b.ts#route.x", 2)}
    verdicts = {r.dir: (r.status, r.excluded_by) for r in answers.directory_verdicts(files, files.where("path = 'a/b.ts'"), ["api/**"]).collect()}
    assert verdicts == {".": ("found", None), "a": ("found", None), "api": ("excluded", "api/**"), "docs": ("excluded", "languages")}
    loop = spark.createDataFrame([("r", "p", "q"), ("r", "q", "p"), ("r", "q", "s")], "repo string, from_pkg string, to_pkg string")
    assert [r.line for r in graph.package_cycles(loop).collect()] == ["p → q → p"]


def test_directory_targets(spark):
    files = spark.createDataFrame([("r", p) for p in ("m/a.go", "m/b.go", "main.go", "x.go")], "repo string, path string")
    rows = [("main.go", "m", "import"), ("main.go", "m", "import"), ("main.go", "ext:fmt", "import"), ("x.go", "main.go", "reexport"), ("m/a.go", "m", "import"), ("x.go", ".", "call")]
    imports = spark.createDataFrame([("r", *x) for x in rows], "repo string, from_path string, to_id string, kind string")
    pairs = sorted((r.src, r.dst) for r in graph.expand_targets(imports, files).collect())
    assert pairs == [("m/a.go", "m/b.go"), ("main.go", "m/a.go"), ("main.go", "m/a.go"), ("main.go", "m/b.go"), ("main.go", "m/b.go"), ("x.go", "main.go")]
    fan = {r.path: (r.fan_in, r.fan_out) for r in graph.fan_metrics(imports, files).collect()}
    assert fan == {"m/a.go": (1, 1), "m/b.go": (2, 0), "main.go": (1, 1), "x.go": (0, 1)}
