"""Small trees of our own with every edge known: counts, confidences, fan-in, fan-out and blast radius."""

from codestrata.engine import CodeMap
from codestrata.operators import graph

SCRIPTS = {
    "package.json": '{"name": "mini", "private": true, "workspaces": ["parts/*", "app"]}',
    "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@mini/*": ["parts/*/src/index.ts"]}}}',
    "parts/base/package.json": '{"name": "@mini/base", "exports": {".": "./src/index.ts"}}',
    "parts/io/package.json": '{"name": "@mini/io", "exports": {".": "./src/index.ts"}}',
    "app/package.json": '{"name": "app"}',
    "parts/base/src/kinds.ts": "export enum Level { Calm, Loud }\nexport type Hook = (word: string) => void;\nexport const EDITION = 'one';\n",
    "parts/base/src/again.ts": "export const TRIES = 3;\nexport interface Options { tries?: number }\nexport async function again<T>(step: () => Promise<T>, o: Options = {}): Promise<T> {\n  let left = o.tries ?? TRIES;\n  while (left-- > 1) { try { return await step(); } catch (e) { continue; } }\n  return step();\n}\n",
    "parts/base/src/line.ts": "import type { Level } from './kinds';\nexport interface Item { key: string; level: Level }\nexport type Reply = { ok: boolean };\nexport interface Line { put(x: string): Promise<Reply>; take(n: number): AsyncIterable<Item> }\n",
    "parts/base/src/hub.ts": "import { label } from './signal';\nimport type { Hook } from './kinds';\nexport class Hub {\n  private hooks: Hook[] = [];\n  on(hook: Hook): void { this.hooks.push(hook); }\n  send(word: string): void {\n    const text = label(word);\n    for (const hook of this.hooks) hook(text);\n  }\n}\n",
    "parts/base/src/signal.ts": "import { Hub } from './hub';\nexport function label(word: string): string { return `<${word}>`; }\nexport function makeHub(): Hub { return new Hub(); }\n",
    "parts/base/src/desk.ts": "import type { Line } from './line';\nimport { again } from './again';\nimport { Hub } from './hub';\nexport class Desk {\n  private lines = new Map<string, Line>();\n  private hub = new Hub();\n  add(name: string, line: Line): void { this.lines.set(name, line); this.hub.send(name); }\n  async all(word: string): Promise<number> {\n    for (const line of this.lines.values()) await again(() => line.put(word));\n    return this.lines.size;\n  }\n  get(name: string): Line | undefined { return this.lines.get(name); }\n}\nexport function makeDesk(): Desk { return new Desk(); }\n",
    "parts/base/src/index.ts": "export * from './desk';\nexport { again, TRIES } from './again';\nexport type { Line, Reply, Item } from './line';\nexport { Level } from './kinds';\n",
    "parts/io/src/index.ts": "export { Wire, makeWire } from './wire';\nexport type { WireOptions } from './wire';\nexport { Shelf } from './shelf';\n",
    "parts/io/src/shelf.ts": "import type { Line, Reply, Item } from '@mini/base';\nexport class Shelf implements Line {\n  private items: Item[] = [];\n  async put(x: string): Promise<Reply> {\n    const { Level } = await import('@mini/base');\n    this.items.push({ key: x, level: Level.Calm });\n    return { ok: true };\n  }\n  async *take(n: number): AsyncIterable<Item> { yield* this.items.slice(0, n); }\n}\n",
    "parts/io/src/wire.ts": "import { again, Level } from '@mini/base';\nimport type { Line, Reply, Item } from '@mini/base';\nimport { Client, Send } from '@vendor/wire/client';\nexport interface WireOptions { at: string }\nexport class Wire implements Line {\n  private client: Client;\n  constructor(private o: WireOptions) { this.client = new Client(o.at); }\n  async put(x: string): Promise<Reply> {\n    await again(() => this.client.run(new Send(x)));\n    return { ok: true };\n  }\n  async *take(n: number): AsyncIterable<Item> { yield { key: '', level: Level.Loud }; }\n}\nexport function makeWire(o: WireOptions): Wire { return new Wire(o); }\n",
    "app/src/settings.ts": "export interface Settings { at: string }\nexport function load(): Settings { return { at: process.env.AT ?? 'here' }; }\n",
    "app/src/start.ts": "import { makeDesk } from '@mini/base';\nimport { makeWire, Shelf } from '@mini/io';\nimport { load } from './settings';\nexport async function start(): Promise<void> {\n  const settings = load();\n  const desk = makeDesk();\n  desk.add('wire', makeWire(settings));\n  desk.add('shelf', new Shelf());\n  console.log(await desk.all('hi'));\n}\nstart();\n",
}

GO = {
    "go.mod": "module example.test/mini\n",
    "tool/go.mod": "module example.test/mini/tool\n",
    "tool/part/x.go": "package part\n\nfunc Run() {}\n",
    "cmd/main.go": 'package main\n\nimport (\n\t"fmt"\n\n\t"example.test/mini/lib/box"\n\tagain "example.test/mini/lib/retry"\n\t"example.test/mini/tool/part"\n)\n\nfunc main() {\n\tb := box.Make("x")\n\terr := again.Try(2, func() error {\n\t\treturn b.Put("k")\n\t})\n\tpart.Run()\n\tfmt.Println(b.Name, err)\n}\n',
    "lib/retry/retry.go": 'package retry\n\nimport "time"\n\ntype Pause struct{ D time.Duration }\n\nfunc (p *Pause) Wait() { time.Sleep(p.D) }\n\nfunc Try(n int, op func() error) error {\n\treturn op()\n}\n',
    "lib/box/box.go": 'package box\n\nimport "example.test/mini/lib/retry"\n\ntype Putter interface {\n\tPut(k string) error\n}\n\ntype Box struct{ Name string }\n\nfunc Make(name string) *Box {\n\treturn &Box{Name: name}\n}\n\nfunc (b *Box) Put(k string) error {\n\treturn retry.Try(1, func() error {\n\t\tb.set(k)\n\t\treturn nil\n\t})\n}\n\nfunc (b *Box) set(k string) {}\n',
    "lib/box/more.go": "package box\n\nfunc Default() *Box {\n\treturn Make(\"d\")\n}\n\nfunc shadow(retry Box, p Putter) {\n\tretry.Try()\n\tretry.set(\"\")\n\tp.Put(\"\")\n}\n",
}


def code_map(spark, repo, tree):
    return CodeMap(spark.createDataFrame([(repo, p, s) for p, s in tree.items()], "repo string, path string, source string"))


def test_script_tree(spark):
    m = code_map(spark, "mini", SCRIPTS)
    assert m.imports.count() == 22 and m.symbols.count() == 31
    edges = {(r["from"], r["to"], r.kind, r.import_kind, r["names"]) for r in m.imports.collect()}
    assert ("parts/io/src/shelf.ts", "parts/base/src/index.ts", "import", "dynamic", "Level") in edges
    assert ("parts/base/src/index.ts", "parts/base/src/desk.ts", "reexport", "static", "*") in edges
    assert {e[1] for e in edges if e[1].startswith(("ext:", "unresolved:"))} == {"ext:@vendor/wire"}
    calls = {(r["from"].replace("/src", ""), r["to"].replace("/src", "")): r.confidence for r in m.calls.collect()}
    assert calls == {
        ("app/start.ts", "app/start.ts#start"): "high", ("app/start.ts#start", "app/settings.ts#load"): "high", ("app/start.ts#start", "parts/io/shelf.ts#Shelf"): "med",
        ("app/start.ts#start", "parts/io/wire.ts#makeWire"): "med", ("app/start.ts#start", "parts/base/desk.ts#makeDesk"): "med", ("parts/io/wire.ts#Wire.put", "parts/base/again.ts#again"): "med",
        ("parts/io/wire.ts#makeWire", "parts/io/wire.ts#Wire"): "high", ("parts/base/hub.ts#Hub.send", "parts/base/signal.ts#label"): "high", ("parts/base/signal.ts#makeHub", "parts/base/hub.ts#Hub"): "high",
        ("parts/base/desk.ts#Desk", "parts/base/hub.ts#Hub"): "high", ("parts/base/desk.ts#Desk.all", "parts/base/again.ts#again"): "high", ("parts/base/desk.ts#makeDesk", "parts/base/desk.ts#Desk"): "high",
    }
    names = {r.name for r in m.exports.where("file = 'parts/base/src/index.ts'").collect()}
    assert names == {"Desk", "makeDesk", "again", "TRIES", "Line", "Reply", "Item", "Level"}
    fan = graph.fan_metrics(m.imports.selectExpr("repo", "`from` as from_path", "`to` as to_id", "kind"), m.paths)
    table = {r.path.replace("/src", ""): (r.fan_in, r.fan_out, r.blast) for r in fan.join(m.blast().withColumnRenamed("node", "path"), ["repo", "path"]).collect() if r.path.endswith(".ts")}
    assert table == {
        "app/settings.ts": (1, 0, 1), "app/start.ts": (0, 3, 0), "parts/io/index.ts": (1, 2, 1), "parts/io/shelf.ts": (1, 1, 2), "parts/io/wire.ts": (1, 1, 2), "parts/base/hub.ts": (2, 2, 7),
        "parts/base/signal.ts": (1, 1, 7), "parts/base/index.ts": (3, 4, 4), "parts/base/line.ts": (2, 1, 6), "parts/base/desk.ts": (1, 3, 5), "parts/base/again.ts": (2, 0, 6), "parts/base/kinds.ts": (3, 0, 9),
    }
    assert [(r.size, r.line) for r in m.cycles().collect()] == [(2, "parts/base/src/hub.ts → parts/base/src/signal.ts → parts/base/src/hub.ts")]
    assert [(r.node, r.depth) for r in m.impact("mini", "app/src/settings.ts").collect()] == [("app/src/start.ts", 1)]


def test_go_tree(spark):
    m = code_map(spark, "go", GO)
    to = {(r["from"], r["to"]) for r in m.imports.collect()}
    assert {("cmd/main.go", "lib/box"), ("cmd/main.go", "lib/retry"), ("cmd/main.go", "tool/part"), ("cmd/main.go", "ext:fmt"), ("lib/box/box.go", "lib/retry")} <= to
    calls = {(r["from"], r["to"], r.confidence) for r in m.calls.collect()}
    assert calls == {
        ("cmd/main.go#main", "lib/box/box.go#Make", "high"), ("cmd/main.go#main", "lib/box/box.go#Box.Put", "high"), ("cmd/main.go#main", "lib/retry/retry.go#Try", "high"), ("cmd/main.go#main", "tool/part/x.go#Run", "high"),
        ("lib/box/box.go#Box.Put", "lib/retry/retry.go#Try", "high"), ("lib/box/box.go#Box.Put", "lib/box/box.go#Box.set", "high"), ("lib/box/more.go#Default", "lib/box/box.go#Make", "high"), ("lib/box/more.go#shadow", "lib/box/box.go#Box.set", "high"),
    }


def test_inherited_members(spark):
    tree = {
        "a.ts": "export class A {\n  one() {}\n  two() {}\n  five = 1;\n}\n",
        "b.ts": "import { A } from './c';\nexport class B extends A {\n  two() { super.two(); }\n  one = 3;\n}\n",
        "c.ts": "export { A } from './a';\n",
        "d.ts": "import * as bees from './b';\nimport { Far } from 'ext';\nclass D extends bees.B {\n  go() { this.two(); this.one(); this.none(); this.go(); }\n}\nclass E extends Far { go() { this.one(); } }\nclass F extends A { go() { this.one(); } }\nclass A extends F {}\n",
    }
    calls = {(r["from"], r["to"]) for r in code_map(spark, "r", tree).calls.collect()}
    assert calls == {("b.ts#B.two", "a.ts#A.two"), ("d.ts#D.go", "b.ts#B.two"), ("d.ts#D.go", "d.ts#D.go")}


def test_go_promotes_methods_of_embedded_types(spark):
    tree = {
        "go.mod": "module ex.test/m\n",
        "lib/a.go": "package lib\n\ntype Base struct{ Size int }\n\nfunc (b *Base) Run() {}\n\nfunc (b *Base) Stop() {}\n\nfunc (b *Base) Size2() {}\n",
        "m.go": 'package main\n\nimport "ex.test/m/lib"\n\ntype Other struct{}\n\nfunc (o Other) Stop() {}\n\ntype Mid struct {\n\t*lib.Base `json:"b"`\n}\n\ntype Top struct {\n\tMid\n\tname, Run2 string\n}\n\ntype Two struct {\n\tlib.Base\n\tOther\n}\n\ntype Hides struct {\n\tlib.Base\n\tRun func()\n}\n\n'
        "func f(t *Top, w Two, h Hides) {\n\tt.Run()\n\tt.Run2()\n\tw.Run()\n\tw.Stop()\n\th.Run()\n\th.Stop()\n}\n",
    }
    calls = {(r["from"], r["to"]): r.line for r in code_map(spark, "r", tree).calls.collect()}
    assert set(calls) == {("m.go#f", "lib/a.go#Base.Run"), ("m.go#f", "lib/a.go#Base.Stop")}
