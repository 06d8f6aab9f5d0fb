from codestrata.llm import handwritten as H

SCHEMA = "file_id long, path string, source string, content string, notice string"
CODE = "export function f(a) {\n  // both sides\n  return a + 1;\n}\n\nexport class C {\n  m() { return f(2); }\n}\n"


def flags(spark, rows):
    df = spark.createDataFrame([(i, p, s, "clash", "clash") for i, p, s in rows], SCHEMA)
    names = ("generated", "minified", "vendored", "data", "copied")
    return {r.file_id: "".join(n[0] for n in names if r[n]) for r in H.origins(df).collect()}


def test_notices_head_tail_and_decoys():
    yes = ["// Code generated by x v1. DO NOT EDIT.", "# @generated by y", "/* <auto-generated> z </auto-generated> */", "// Licence text\n//\n// !! machine made !! run `make s`"]
    no = ["// Not generated: keep it readable by hand.", "// Helpers for reading files that were generated by other tools.", "// The writer puts a DO NOT EDIT line on top of its output; this module only calls it."]
    assert all(H.notices(f"{y}\n\n{CODE}")[0] for y in yes)
    assert H.notices(CODE + "\n// Code generated by x v1. DO NOT EDIT.\n")[0]
    assert not any(H.notices(f"{n}\n\n{CODE}")[0] for n in no)
    assert not H.notices(CODE.replace("both sides", "@generated") + 'const s = "Code generated by";\n')[0]
    assert H.notices("// lib v1.2.3\n// (c) 2020 the lib developers\n// Released under the MIT license\n" + CODE)[1]
    assert H.notices("// Bundled dependency: lib@1.2\n" + CODE)[1]
    assert not H.notices("// Copyright 2026 the own contributors. Licensed under the terms in LICENSE.\n" + CODE)[1]
    assert not H.notices("// Replaces the vendored parser we used to carry.\n" + CODE)[1]


def test_shapes():
    mini = "!function(){" + "".join(f"var a{i}=b||{{}};if(c!==1)throw Error(d);" for i in range(40)) + "}();"
    table = "export const t = [\n" + "".join("  " + ", ".join(str(n * 37 % 9999) for n in range(i, i + 16)) + ",\n" for i in range(30)) + "];\n"
    stubs = "\n\n".join(f"def get_{i:03d}(m):\n    return m.get({i}, 0)" for i in range(20))
    assert H.shape(mini)[0] and not H.shape(mini)[1]
    assert H.shape(table)[1] and not H.shape(table)[0]
    assert H.shape(stubs)[2]
    assert H.shape(CODE * 30)[:2] == (False, False)
    assert H.shape("") == H.shape("\n \n") == (False, False, False)


def test_paths_copies_nulls_and_repeats(spark):
    lib = CODE + "// theirs\n"
    rows = [
        (1, "vendor/lib/a.ts", lib), (2, "src/a.ts", lib.replace("\n", "\r\n")[:-2]), (3, "src/b.ts", CODE), (4, "src/vendors/c.ts", CODE + "1;\n"),
        (5, "api/x.pb.go", CODE), (6, "web/y-min.js", CODE), (7, "go.sum", "x"), (8, None, CODE + "2;"), (9, "a.ts", None), (10, "b.ts", ""), (11, "vendor/e.ts", ""),
        (3, "src/b.ts", CODE), (None, "vendor/q.ts", "x"),
    ]
    assert flags(spark, rows) == {1: "v", 2: "c", 3: "", 4: "", 5: "g", 6: "m", 7: "g", 8: "", 9: "", 10: "", 11: "v"}
    assert flags(spark, []) == {}


def test_very_long_source(spark):
    assert flags(spark, [(1, "a.ts", CODE * 20_000)]) == {1: ""}


def test_notices_by_their_place_in_the_sentence():
    generated = [
        "// Code generated by mockgen: helpers for the store package. DO NOT EDIT.\n", "/* eslint-disable */\n// This file was automatically generated by foo. Do not modify.\n", "# Generated by Django 4.2 on 2024\n",
        "// Produced by `tool --out .` from a.json\n", "# Written by the exporter.\n# DO NOT EDIT\n", "<!-- <auto-generated> x </auto-generated> -->\n", "/* AUTO-GENERATED FILE - changes will be lost */\n",
    ]
    by_hand = [
        "# Local patches: see wiki\n", "// Keep in step with upstream API when you change this client.\n", "# report produced by `make report` lands in out/\n", "// Produced by the billing team.\n",
        "// Generated reports land in out/\n", "// This file is not generated.\n", "# Parses headers of generated files.\n", "// Replaces the vendored 1.2 parser.\n", "# Never do not edit lines away.\n", "# imported lazily, see PEP 690\n",
    ]
    assert [t for t in generated if not H.notices(t)[0]] == []
    assert [t for t in by_hand if any(H.notices(t))] == []
    assert [H.notices(f"// {t}\n")[1] for t in ("Vendored from https://example.test/x", "bundled dependency: x@1.2", "This is a snapshot of x 3.1")] == [True] * 3
    assert H.notices("f();\n" + "// filler\n" * 40 + "// @generated by x\n" + "// filler\n" * 40)[0]  # a closing comment is read whole
