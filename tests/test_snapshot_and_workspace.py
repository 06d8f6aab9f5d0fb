from pyspark.sql import functions as F

from codestrata import workspace as W
from codestrata.operators import snapshot as S
from codestrata.sources.extract import extract_facts

ONE = "export function f() { g(); }\nfunction g() {}\n"


def files(spark, rows):
    return spark.createDataFrame([("r", p, s) for p, s in rows], "repo string, path string, source string")


def comparable(facts):
    return sorted(repr(tuple(r[c] for c in sorted(facts.columns))) for r in facts.collect())


def test_incremental_rebuild_equals_full_extraction(spark):
    first = files(spark, [("a.ts", ONE), ("b.ts", ONE), ("c.py", "def f():\n    return g()\n"), ("empty.ts", ""), ("bad.ts", "function ("), ("n.ts", None)])
    facts, cache, counts = S.rebuild(first, extract_facts)
    assert comparable(facts) == comparable(extract_facts(first))
    assert tuple(counts.first()) == (4, 0, 5)  # a.ts and b.ts are parsed once
    second = files(spark, [("a.ts", ONE), ("moved.ts", ONE), ("c.py", "def h():\n    pass\n"), ("empty.ts", "")])
    facts, cache, counts = S.rebuild(second, extract_facts, cache)
    assert comparable(facts) == comparable(extract_facts(second))
    assert tuple(counts.first()) == (1, 3, 4)
    assert cache.select("key").distinct().count() == 3  # keys that nobody uses any more are gone


def test_dirty_skip_and_indexable(spark):
    make = lambda rows: spark.createDataFrame(rows, "repo string, path string")
    dirty = S.dirty_paths(make([("r", "a"), ("r", "a"), (None, "x")]), make([("r", "b"), ("q", "c")]))
    assert {tuple(r) for r in S.keep_indexable(dirty, make([("r", "a")]), make([("q", "c")])).collect()} == {("r", "a"), ("q", "c")}
    states = spark.createDataFrame([("r", "h1", True, "c"), ("q", "h1", True, "c"), ("s", "h0", True, "c"), ("t", "h1", None, "c")], "repo string, last_indexed_commit string, tree_clean boolean, config_hash string")
    heads = spark.createDataFrame([(x, "h1", "c") for x in "rqstu"], "repo string, head string, config_hash string")
    assert {r.repo: r.skip for r in S.may_skip(states, heads, make([("q", "c")])).collect()} == {"r": True, "q": False, "s": False, "t": False, "u": False}


def test_summaries_batches_budget_and_pages(spark):
    rows = spark.createDataFrame([("r", f"p{i:02d}", f"s{i}") for i in range(30)], "repo string, path string, sha256 string")
    summaries = spark.createDataFrame([("p00", "s0", "new", 2), ("p00", "old", "older", 1), ("p01", "x", "stale text", 1), ("p01", "w", "tie", 1)], "path string, sha256 string, text string, refreshed_at int")
    states = S.summary_states(rows, summaries)
    got = {r.path: (r.state, r.text) for r in states.collect()}
    assert got["p00"] == ("fresh", "new") and got["p01"] == ("stale", "tie") and got["p02"] == ("none", None)
    assert [r["n"] for r in S.refresh_batches(states).groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()] == [12, 12, 5]
    assert S.largest_that_fits(rows, ["repo"], ["path"], "path", 5).count() == 5  # each path is one token
    assert S.pages(rows, ["repo"], ["path"], 25).agg(F.max("page")).first()[0] == 1


def test_next_routes(spark):
    paths = {"web/app/(shop)/a/[id]/page.tsx": "/a/[id]", "app/page.tsx": "/", "app/@modal/b/route.ts": "/b", "pages/c/index.tsx": "/c", "pages/index.js": "/", "pages/_app.tsx": None, "src/x.ts": None}
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", S.next_route(F.col("p")).alias("route"))
    assert {r.p: r.route for r in df.collect()} == paths


def test_workspace(spark):
    pairs = spark.createDataFrame([("a", "x.go", "y.go"), ("b", "p/u.go", "p/v.go")], "repo string, src string, dst string")
    cross = spark.createDataFrame([("a", "y.go", "b", "h/b", "h/b/p"), ("a", "z.go", "b", "h/b", "h/b/none")], "from_repo string, from_path string, to_repo string, to_pkg string, specifier string")
    packages = spark.createDataFrame([("b", "h/b", ".")], "repo string, pkg string, dir string")
    held = spark.createDataFrame([("b", "p/u.go"), ("b", "p/v.go"), ("b", "root.go")], "repo string, path string")
    crossing = W.cross_targets(cross, packages, held)
    assert {(r.from_path, r.to_path) for r in crossing.collect()} == {("y.go", "p/u.go"), ("y.go", "p/v.go"), ("z.go", "root.go")}
    targets = spark.createDataFrame([("b::p/v.go",)], "target string")
    assert {(r.node, r.depth) for r in W.impact_across(pairs, crossing, targets).collect()} == {("b::p/u.go", 1), ("a::y.go", 1), ("a::x.go", 2)}
    assert [tuple(r) for r in W.repo_graph(cross).collect()] == [("a", "b", 2)]
    ids = spark.createDataFrame([("a::b#c",), ("plain",)], "i string").select(W.split_workspace_id(F.col("i")).alias("s"))
    assert [tuple(r.s) if r.s else None for r in ids.collect()] == [("a", "b#c"), None]
    symbols = spark.createDataFrame([("a", "f#m", "m"), ("b", "g#K.m", "K.m")], "repo string, id string, name string")
    assert [tuple(r) for r in W.query_across(symbols, "m").collect()] == [("a::f#m", 2)]
    rows = lambda x: spark.createDataFrame(x, "repo string, path string, sha string")
    state = W.verify_workspace(rows([("a", "x", "1"), ("b", "y", "1")]), rows([("a", "x", "2")]), ["path"], "sha")
    assert {tuple(r) for r in state.collect()} == {("a", "changed", 1), ("b", "unmapped", 0)}
