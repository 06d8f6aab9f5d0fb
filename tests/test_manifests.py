from codestrata.engine import CodeMap
from codestrata.sources import manifests as M

SOURCES = {
    "package.json": '{"name": "root-pkg", // c\n "workspaces": ["p/*"],}',
    "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"], "@/special": ["src/other.ts"], "@/deep/*": ["deep/*", "src/*"]}}}',
    "src/a.ts": 'import { x } from "@/b";\nimport "@/special";\nimport "@/deep/q";\nimport { y } from "@s/lib";\nimport { z } from "@s/lib/sub";\nimport "@s/lib/hidden";\nimport "plain";\nimport "src/b";\n',
    "src/b.ts": "export const x = 1;\n", "src/other.ts": "", "src/q.ts": "",
    "p/lib/package.json": '{"name": "@s/lib", "exports": {".": {"types": "./missing.d.ts", "import": "./main.js"}, "./sub": "./sub/index.ts", "./hidden": null}}',
    "p/lib/main.ts": "export const y = 1;\n", "p/lib/main.js": "", "p/lib/sub/index.ts": "export const z = 1;\n", "p/lib/hidden.ts": "",
    "svc/go.mod": "module ex.test/svc\n\ngo 1.22\n", "svc/m.go": "package m\n",
    "k/Cargo.toml": '[package]\nname = "k-crate"\n', "k/src/l.rs": "",
    "py/pyproject.toml": "[project]\nname = 'pkg'\n", "bad/package.json": "{",
    "j/src/c/d/E.java": "package c.d;\npublic class E {}\n", "j/src/F.java": "import c.d.E;\nimport java.util.List;\nclass F {}\n",
}


def test_jsonc_and_conditions():
    assert M.parse_jsonc('{"a": "x // y", /* c */ "b": [1, 2,],}') == {"a": "x // y", "b": [1, 2]}
    assert M.parse_jsonc("{") is None
    assert M.export_targets({"import": {"types": "./t", "default": "./d"}, "require": None, "default": ["./e"]}) == ["./t", "./d", "./e"]


def test_packages_and_aliases(spark):
    files = spark.createDataFrame([("r", p, s) for p, s in SOURCES.items()] + [("q", "x.ts", None)], "repo string, path string, source string")
    m = CodeMap(files)
    found = {(r.repo, r.dir): r.pkg for r in M.detect_packages(m.declared, files).collect()}
    assert found == {("r", "."): "root-pkg", ("r", "p/lib"): "@s/lib", ("r", "svc"): "ex.test/svc", ("r", "k"): "k_crate", ("r", "py"): "pkg", ("q", "."): "root"}
    assert {r.path: r.pkg for r in m.owners.where("path in ('svc/m.go', 'src/a.ts')").collect()} == {"svc/m.go": "ex.test/svc", "src/a.ts": "root-pkg"}
    to = {r.specifier: r.to for r in m.imports.where("`from` in ('src/a.ts', 'j/src/F.java')").collect()}
    assert to == {
        "@/b": "src/b.ts", "@/special": "src/other.ts", "@/deep/q": "src/q.ts", "@s/lib": "p/lib/main.js", "@s/lib/sub": "p/lib/sub/index.ts", "@s/lib/hidden": "ext:@s/lib",
        "plain": "ext:plain", "src/b": "src/b.ts", "c.d.E": "j/src/c/d/E.java", "java.util.List": "ext:java",
    }


def test_extends_of_any_length_python_roots_and_kotlin_packages(spark):
    tree = {
        "configs/tsconfig.base.json": '{"compilerOptions": {"paths": {"@base/*": ["../lib/*"], "@both/*": ["../lib/*"]}}}',
        "configs/tsconfig.mid.json": '{"extends": "./tsconfig.base"}',
        "app/tsconfig.json": '{"extends": ["./missing.json", "../configs/tsconfig.mid.json"], "compilerOptions": {"strict": true}}',
        "own/tsconfig.json": '{"extends": "../configs/tsconfig.mid.json", "compilerOptions": {"paths": {"@both/*": ["./*"]}}}',
        "loop/tsconfig.json": '{"extends": "./tsconfig.json"}',
        "lib/x.ts": "export const x = 1;\n", "own/x.ts": "export const x = 2;\n", "loop/y.ts": 'import "@base/x";\n',
        "app/a.ts": 'import { x } from "@base/x";\n', "own/b.ts": 'import { x } from "@both/x";\nimport "@base/x";\n',
        "svc/pyproject.toml": "[project]\nname = 'svc'\n", "svc/src/core/m.py": "def f():\n    pass\n", "core/m.py": "", "svc/run.py": "from core.m import f\nimport os\n",
        "k/A.kt": "package one.two\n\nclass Box\n\nfun open() {}\n", "k/B.kt": "package one.two\n\nfun twice() {}\n", "k/C.kt": "package one.two\n\nfun twice() {}\n",
        "z/M.kt": "package z\n\nimport one.two.Box\nimport one.two.Box.make\nimport one.two.twice\nimport java.util.List\n",
    }
    m = CodeMap(spark.createDataFrame([("r", p, s) for p, s in tree.items()], "repo string, path string, source string"))
    to = {(r["from"], r.specifier): r.to for r in m.imports.collect()}
    assert to["app/a.ts", "@base/x"] == "lib/x.ts"
    assert to["own/b.ts", "@both/x"] == "own/x.ts" and to["own/b.ts", "@base/x"].startswith("ext:")  # a file's own paths replace inherited ones
    assert to["loop/y.ts", "@base/x"].startswith("ext:")
    assert to["svc/run.py", "core.m"] == "svc/src/core/m.py" and to["svc/run.py", "os"] == "ext:os"
    assert to["z/M.kt", "one.two.Box"] == "k/A.kt" and to["z/M.kt", "one.two.twice"] == "ext:one"
