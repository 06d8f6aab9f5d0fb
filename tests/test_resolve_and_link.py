from pyspark.sql import functions as F

from codestrata.engine import CodeMap
from codestrata.functions import ids
from codestrata.operators import compare, resolve


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"`{k}` string" for k in values))
    return row.select(column.alias("x")).first().x


def test_scalar_functions(spark):
    p = F.col("p")
    for path, lang in [("a/b.ts", "ts"), ("Dockerfile", "dockerfile"), ("x/Dockerfile.dev", "dockerfile"), (".ts", None), ("a.b/c", None), ("k.tfvars", "hcl")]:
        assert one(spark, ids.lang_of(p), p=path) == lang
    assert [one(spark, ids.directory_of(p), p=x) for x in ("a/b/c", "c")] == ["a/b", "."]
    assert one(spark, ids.ancestors(p), p="a/b/c") == ["a/b", "a", "."]
    assert one(spark, ids.suffixes(p), p="a/b/c") == ["a/b/c", "b/c", "c"]
    assert [one(spark, ids.normal_join(F.col("d"), p), d="a/b", p=x) for x in ("../c", "./d/./e", "../../..", "../..")] == ["a/c", "a/b/d/e", None, "."]
    assert [one(spark, ids.count_loc(p), p=x) for x in ("", "a", "a\n", "a\nb", "\n\n")] == [0, 1, 1, 2, 2]
    assert one(spark, ids.package_slug(p), p="@scope/na me") == "scope__na-me"
    assert one(spark, ids.estimate_tokens(p), p="ab😀") == 2
    assert tuple(one(spark, ids.node_parts(p), p="f.tf#resource.a.b")) == ("f.tf", "resource", "a.b")
    assert one(spark, ids.node_parts(p), p="f.ts#Foo.bar") is None
    assert [one(spark, ids.package_of_specifier(p), p=x) for x in ("@a/b/c", "d/e", "./f")] == ["@a/b", "d", None]
    assert one(spark, ids.last_segment(p), p="a/b.ts#c") == "c"


def test_package_prefix_probe_suffix_and_division(spark):
    files = spark.createDataFrame([("r", p) for p in ("a/b/x.ts", "a/y.ts", "z.ts", "q/y.ts")], "repo string, path string")
    packages = spark.createDataFrame([("r", "ab", "a/b"), ("r", "a", "a"), ("r", "root", ".")], "repo string, pkg string, dir string")
    assert {r.path: r.pkg for r in resolve.package_of(files, packages).collect()} == {"a/b/x.ts": "ab", "a/y.ts": "a", "z.ts": "root", "q/y.ts": "root"}
    tokens = spark.createDataFrame([("r", t) for t in ("x.ts", "y.ts", "z.ts", "b/x.ts", "none")], "repo string, token string")
    assert {r.token: r.path for r in resolve.by_unique_suffix(tokens, files).collect()} == {"x.ts": "a/b/x.ts", "z.ts": "z.ts", "b/x.ts": "a/b/x.ts"}
    tried = spark.createDataFrame([("r", "k", ["no.ts", "z.ts", "a/y.ts"])], "repo string, k string, candidates array<string>")
    assert resolve.probe(tried, files, ["k"]).first().path == "z.ts"
    selectors = spark.createDataFrame([("s1", {"app": "x"}), ("s2", {"app": "x", "t": "1"}), ("s3", {})], "selector string, labels map<string,string>")
    pods = spark.createDataFrame([("p1", {"app": "x", "t": "1"}), ("p2", {"app": "x"})], "item string, labels map<string,string>")
    assert [tuple(r) for r in resolve.subset_matches(selectors, pods).collect()] == [("s2", "p1")]


def test_symbol_tiers_and_cross_edges(spark):
    rows = [("f#foo", "foo"), ("f#A.foo", "A.foo"), ("g#A.bar", "A.bar"), ("g#rebar", "rebar")]
    symbols = spark.createDataFrame([("r", *x) for x in rows], "repo string, id string, name string")
    needles = spark.createDataFrame([("foo",), ("bar",), ("f#A.foo",), ("",), ("none",)], "needle string")
    assert sorted((r.needle, r.tier, r.id) for r in resolve.find_symbols(symbols, needles).collect()) == [("bar", 3, "g#A.bar"), ("f#A.foo", 1, "f#A.foo"), ("foo", 2, "f#foo")]
    imports = spark.createDataFrame([("a", "x.go", "ext:m", "h/b/sub/p"), ("a", "y.ts", "ext:@s/p", "@s/p/q"), ("b", "z.go", "ext:m", "h/b/sub")], "repo string, from_path string, to_id string, specifier string")
    published = spark.createDataFrame([("b", "h/b"), ("b", "h/b/sub"), ("c", "@s/p"), ("d", "@s/p")], "repo string, pkg string")
    assert [(r.from_path, r.to_repo, r.to_pkg) for r in resolve.cross_edges(imports, published).collect()] == [("x.go", "b", "h/b/sub")]


SOURCES = {
    "src/a.ts": 'import { make as build, Shape } from "./lib";\nimport * as util from "./util";\nexport function run(n: number) {\n  build(n);\n  util.help();\n  inner();\n  Shape.of(1);\n  unknown();\n}\nfunction inner() {}\nexport class Box {\n  put() { this.take(); }\n  take() {}\n}\n',
    "src/lib/index.ts": 'export { make } from "./make";\nexport * from "./shape";\nexport * from "./other";\n',
    "src/lib/make.ts": "export const make = (n) => { return n; };\nexport const both = 1;\n",
    "src/lib/shape.ts": "export class Shape {\n  static of(n) { return n; }\n}\nexport const twice = 1;\n",
    "src/lib/other.ts": "export const twice = 2;\n",
    "src/util.ts": "export function help() {}\nexport default help;\n",
    "pkg/m.py": "from .n import go\nimport os\nclass C:\n    def f(self):\n        self.g()\n        go()\n    def g(self):\n        pass\n",
    "pkg/n.py": "def go():\n    return 1\n",
    "cmd/main.go": 'package main\n\nimport "ex.test/r/store"\n\nfunc main() { store.Open() }\n',
    "store/s.go": "package store\n\nfunc Open() error { return nil }\n\nfunc (s *S) Close() {}\n\ntype S struct { x int }\n",
    "J.java": "package p;\nimport p.q.K;\npublic class J {\n  public static final int N = 1;\n  public void f() { g(); }\n  private int g() { return 1; }\n}\n",
    "l.rs": "use crate::m::{a, b as c};\npub struct P { x: u8 }\nimpl P {\n    pub fn new() -> P { P { x: 1 } }\n}\n",
    "t.tf": 'variable "n" {\n  default = 1\n}\nresource "a" "b" {\n  x = var.n\n  y = "k-${local.z}"\n}\nlocals {\n  z = 2\n}\n',
    "bad.ts": "function x( {",
}


def test_engine_from_sources_to_edges(spark):
    files = spark.createDataFrame([("r", p, s) for p, s in SOURCES.items()] + [("r", "null.ts", None), ("r", "a#b.ts", "let x = 1;")], "repo string, path string, source string")
    m = CodeMap(files, spark.createDataFrame([("r", "ex.test/r"), ("r", None)], "repo string, module_path string"))
    names = {(r.file, r.name, r.kind) for r in m.symbols.collect()}
    assert {("src/a.ts", "Box.put", "method"), ("pkg/m.py", "C.f", "method"), ("store/s.go", "S.Close", "method"), ("store/s.go", "S", "struct"), ("J.java", "J.N", "const"), ("l.rs", "P.new", "method"), ("t.tf", "resource.a.b", "resource"), ("t.tf", "local.z", "local")} <= names
    assert [r.file for r in m.unparsable().collect()] == ["bad.ts"]
    to = {(r["from"], r.specifier): r.to for r in m.imports.collect()}
    assert to["src/a.ts", "./lib"] == "src/lib/index.ts" and to["src/a.ts", "./util"] == "src/util.ts"
    assert to["pkg/m.py", ".n"] == "pkg/n.py" and to["pkg/m.py", "os"] == "ext:os" and to["cmd/main.go", "ex.test/r/store"] == "store"
    index = {(r.file, r.name): (r.target_file, r.target_symbol, r.hops) for r in m.exports.collect()}
    assert index["src/lib/index.ts", "make"] == ("src/lib/make.ts", "make", 1)
    assert index["src/lib/index.ts", "Shape"] == ("src/lib/shape.ts", "Shape", 1)
    assert ("src/lib/index.ts", "twice") not in index  # two stars, two declarations
    calls = {(r["from"], r.to, r.confidence) for r in m.calls.collect()}
    assert calls == {
        ("src/a.ts#run", "src/a.ts#inner", "high"), ("src/a.ts#run", "src/lib/make.ts#make", "med"), ("src/a.ts#run", "src/util.ts#help", "high"),
        ("src/a.ts#run", "src/lib/shape.ts#Shape.of", "med"), ("src/a.ts#Box.put", "src/a.ts#Box.take", "high"),
        ("pkg/m.py#C.f", "pkg/m.py#C.g", "high"), ("pkg/m.py#C.f", "pkg/n.py#go", "high"), ("cmd/main.go#main", "store/s.go#Open", "high"),
    }
    assert {(r["from"], r.to) for r in m.references.collect()} == {("t.tf#resource.a.b", "t.tf#variable.n"), ("t.tf#resource.a.b", "t.tf#local.z")}
    assert sorted(r.node for r in m.impact("r", "src/lib/make.ts").collect()) == ["src/a.ts", "src/lib/index.ts"]
    assert m.query("take").first().id == "src/a.ts#Box.take"
    assert m.verify(m.imports).count() == 0


def test_long_chains_of_reexports_and_cycles(spark):
    from codestrata.operators import link

    exports, edges = [("f00", "x", "named", None, "x"), ("g", "y", "named", None, "y"), ("h", "y", "named", None, "y")], []

    def passes(file, name, kind, source):
        exports.append((file, name, kind, source, name))
        edges.append((file, source, source))

    for i in range(1, 26):  # x by name, y by stars
        passes(f"f{i:02}", "x", "named", f"f{i - 1:02}")
        passes(f"s{i:02}", None, "star", f"s{i - 1:02}" if i > 1 else "h")
    passes("s01", None, "star", "s25")  # a cycle
    passes("both", None, "star", "g")
    passes("both", None, "star", "s25")
    facts = spark.createDataFrame([("r", "export", *e) for e in exports], "repo string, fact string, file string, name string, kind string, specifier string, signature string")
    linked = spark.createDataFrame([("r", "reexport", *e) for e in set(edges)], "repo string, kind string, from string, specifier string, to string")
    declared = spark.createDataFrame([("r", "decl", "f00", "x", None), ("r", "decl", "g", "y", None), ("r", "decl", "h", "y", None)], "repo string, fact string, file string, name string, parent string")
    found = {(r.file, r.name): (r.target_file, r.hops) for r in link.export_index(facts, linked, declared).collect()}
    assert found[("f25", "x")] == ("f00", 25) and found[("s25", "y")] == ("h", 25)
    assert ("both", "y") not in found  # two declarations, one of them 26 steps away
    assert len(found) == 26 + 25 + 2


def test_compare(spark):
    make = lambda rows: spark.createDataFrame(rows, "k string, v string")
    states = compare.verify(make([("a", "1"), ("b", "2"), ("c", None), ("e", None)]), make([("b", "3"), ("c", None), ("d", "4"), ("e", "5")]), ["k"], "v")
    assert {r.k: r.state for r in states.collect()} == {"a": "missing", "b": "changed", "d": "extra", "e": "changed"}
    s = compare.score_sets(make([("a", ""), ("b", ""), ("b", "")]), make([("b", ""), ("c", "")]), ["k"]).first()
    assert (s.tp, s.fp, s.fn, s.precision, s.recall, s.f1) == (1, 1, 1, 0.5, 0.5, 0.5)
    assert compare.jaccard(make([]), make([]), ["k"]).first().jaccard == 1.0
    delta = compare.line_delta(make([("a", "x\ny\ny")]), make([("a", "y\nz")]), ["k"], "v").first()
    assert (delta.added, delta.removed) == (1, 2)
    pairs = spark.createDataFrame([(1, "abc", "axc"), (2, None, None), (3, "aa", "aaa")], "id int, old string, new string")
    assert {r.id: r.bytes for r in compare.byte_delta(pairs).collect()} == {1: 1, 2: 0, 3: 1}
    assert {r.id: (r.added, r.removed) for r in compare.unified_diffs(pairs).collect()} == {1: (1, 1), 2: (0, 0), 3: (1, 1)}
    texts = spark.createDataFrame([(1, "a b c d", "b x d"), (2, None, ""), (3, "a", None)], "id int, old string, new string")
    assert {r.id: round(r.ratio, 3) for r in compare.lcs_ratio(texts).collect()} == {1: round(4 / 7, 3), 2: 1.0, 3: 0.0}
    e = lambda rows: spark.createDataFrame([("r", *x) for x in rows], "repo string, src string, dst string")
    universe = spark.createDataFrame([("r", x) for x in "abc"], "repo string, path string")
    t = compare.score_against_truth(e([("a", "b"), ("a", "c"), ("a", "z")]), e([("a", "b"), ("z", "b"), ("c", "a")]), ["src", "dst"], universe, ["src", "dst"]).first()
    assert (t.tp, t.fp, t.fn, t.precision, t.recall) == (1, 1, 1, 0.5, 0.5)
    m = compare.missed_targets(spark.createDataFrame([("p50", 3.0), ("p95", 1.0), ("rss", None)], "metric string, value double"), spark.createDataFrame([("p50", 2.0), ("p95", 2.0), ("rss", 1.0)], "metric string, most double"))
    assert [r.metric for r in m.collect()] == ["p50"]
    n = spark.createDataFrame([("a", i) for i in (1, 2, 3, 4)], "k string, v int")
    r = compare.summarize(n, ["k"], "v").first()
    assert (r.p50, r.p95, r["median"], r.mean) == (2, 4, 2.5, 2.5)
    w = compare.win_loss_tie(n.select(F.col("v").alias("k"), F.lit(1.0).alias("x")), n.select(F.col("v").alias("k"), (F.col("v") / 2).alias("x")), ["k"], "x").first()
    assert (w.wins, w.losses, w.ties) == (1, 2, 1)


KOTLIN = """package a.b

import c.d.E
import c.d.F as G

@Ann(1) data class P(val x: Int) : Q()

class Box<T> private constructor(val y: Int) {
    companion object { const val N = 1; fun make(): Box<Int> { return build() } }
    private var z = 2
    fun put(t: T) = take(t)
    internal fun take(t: T) { println(t) }
}

fun String.shout(): String = this.uppercase()
fun main() { Box.make() }
typealias A = List<Int>
private object Hidden
"""


def test_kotlin_facts():
    from codestrata.sources.extract import facts_of

    facts = facts_of("r", "a.kt", "kotlin", KOTLIN)
    decls = {(f["name"], f["kind"], f["exported"]) for f in facts if f["fact"] == "decl"}
    assert decls == {
        ("P", "record", True), ("Box", "class", True), ("Box.Companion", "class", True), ("Box.Companion.N", "const", True), ("Box.Companion.make", "method", True), ("Box.z", "var", False),
        ("Box.put", "method", True), ("Box.take", "method", False), ("String.shout", "method", True), ("main", "function", True), ("A", "type", True), ("Hidden", "class", False),
    }
    assert {(f["specifier"], f["locals"][0]) for f in facts if f["fact"] == "import"} == {("c.d.E", "E"), ("c.d.F", "G")}
    assert ("main", "Box.make") in {(f["caller"], f["callee"]) for f in facts if f["fact"] == "call"}


def test_answers(spark):
    from codestrata.operators import answers

    files = spark.createDataFrame([("r", "a/x.ts"), ("r", "b/y.ts"), ("q", "a/x.ts")], "repo string, path string")
    symbols = spark.createDataFrame([("r", "a/x.ts#K.m", "K.m"), ("r", "b/y.ts#z", "z")], "repo string, id string, name string")
    needles = spark.createDataFrame([(n,) for n in ("y.ts", "a/x.ts", "a", "z", "m", "b/y.ts#z", "none", "")], "needle string")
    got = {(r.needle, r.step, r.repo, r.id) for r in answers.ladder(needles, files, symbols).collect()}
    assert got == {("y.ts", 1, "r", "b/y.ts"), ("a/x.ts", 1, "r", "a/x.ts"), ("a/x.ts", 1, "q", "a/x.ts"), ("a", 3, "r", "a"), ("a", 3, "q", "a"), ("z", 4, "r", "b/y.ts#z"), ("m", 5, "r", "a/x.ts#K.m"), ("b/y.ts#z", 2, "r", "b/y.ts#z")}
    make = lambda rows: spark.createDataFrame(rows, "repo string, path string, sha256 string")
    asked = make([("r", p, None) for p in ("f", "s", "v/vendor/x", "u", "gone")])
    status = answers.status_of(asked, make([("r", "f", "1"), ("r", "s", "1"), ("r", "gone", "1")]), make([("r", "f", "1"), ("r", "s", "2"), ("r", "v/vendor/x", "1"), ("r", "u", None)]), ["**/vendor/**"])
    assert {r.path: r.status for r in status.collect()} == {"f": "found", "s": "stale", "v/vendor/x": "excluded: **/vendor/**", "u": "unmapped", "gone": "absent"}
