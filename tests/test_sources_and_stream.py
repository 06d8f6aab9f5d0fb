import datetime as dt

from codestrata.sources import sinks
from codestrata.sources.discover import discover, read_map
from codestrata.streaming import feed


def test_discover_filters_before_reading(spark, tmp_path):
    for name, text in {"a/x.ts": "let a;\n", "a/x.min.js": "1", "b/.env": "no", "b/c#d.ts": "no", "Dockerfile": "FROM x"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    rows = {r.path: (r.lang, r.loc) for r in discover(spark, str(tmp_path), "r", exclude=["**/*.min.js"]).collect()}
    assert rows == {"a/x.ts": ("ts", 1), "Dockerfile": ("dockerfile", 1)}


def test_json_lines_do_not_depend_on_row_order(spark, tmp_path):
    rows = [("b", 2, None), ("a", 1, "x"), ("a", 0, "y")]
    texts = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "z string, n int, m string").repartition(3)
        sinks.write_json_lines(df, ["z", "n"], str(tmp_path / "out"), single=True)
        texts.append("".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))))
    assert texts[0] == texts[1] == '{"m":"y","n":0,"z":"a"}\n{"m":"x","n":1,"z":"a"}\n{"n":2,"z":"b"}\n'


def test_read_map_of_absent_tables(spark, tmp_path):
    (tmp_path / "graph").mkdir()
    (tmp_path / "graph" / "calls.jsonl").write_text('{"confidence":"high","from":"a","line":3,"to":"b"}\n')
    tables = read_map(spark, str(tmp_path))
    assert tables["calls"].first().line == 3 and tables["imports"].count() == 0


def test_write_changed_rewrites_and_prunes(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "path string, text string")
    store = str(tmp_path / "store")
    assert sinks.write_changed(make([("a", "1"), ("b", "2")]), store).count() == 2
    assert {r.path: r.state for r in sinks.write_changed(make([("a", "1"), ("c", "3")]), store).collect()} == {"b": "extra", "c": "missing"}
    assert sinks.write_changed(make([("a", "1"), ("c", "3")]), store).count() == 0


def test_markdown_and_mermaid(spark):
    edges = spark.createDataFrame([("a", "b", 2), ("b", "a", 1)], "from_pkg string, to_pkg string, n long")
    assert sinks.mermaid(edges).splitlines() == ["graph LR", '  n0["a"]', '  n1["b"]', "  n0 -->|2| n1", "  n1 --> n0"]


def test_tree_and_links():
    assert sinks.render_tree(["b.ts", "a/x.ts", "a/c/y.ts"]).splitlines() == ["├── a/", "│   ├── c/", "│   │   └── y.ts", "│   └── x.ts", "└── b.ts"]
    assert sinks.render_tree([]) == ""
    assert [sinks.relative_link(a, b) for a, b in [("p/a.md", "p/b.md"), ("p/q/a.md", "x.md"), ("a.md", "p/b.md")]] == ["b.md", "../../x.md", "p/b.md"]


def test_stream_publishes_every_change_once(spark, tmp_path):
    schema = "change_id long, checkout_id long, path string, content_sha string, change_kind string, repo string, arrived_at timestamp"
    folder, ledger, checkpoint = (str(tmp_path / x) for x in ("in", "ledger", "checkpoint"))

    def deliver(ids):
        rows = [(i, 1, f"p{i % 2}", f"s{i}", "edit", "r", dt.datetime(2026, 1, 1) + dt.timedelta(hours=i)) for i in ids]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)

    def run(at):
        feed.process_stream(feed.read_changes(spark, folder, schema), ledger, at).awaitTermination()

    deliver([1, 2, 5])
    run(checkpoint)
    deliver([2, 3, 9])
    run(checkpoint)
    run(checkpoint + "-lost")  # the checkpoint is lost: everything is read again, nothing is published again
    out = feed.IncrementalLedger(spark, ledger, ["checkout_id"], "change_id").output()
    assert sorted(r.change_id for r in out.collect()) == [1, 2, 3, 5, 9]
    assert {r.path: r.content_sha for r in feed.latest_state(spark, ledger).collect()} == {"p0": "s2", "p1": "s9"}


def test_diagrams_keep_every_edge_in_pages(spark):
    edges = spark.createDataFrame([(f"p{i:02}", f"q{i:02}", i) for i in range(1, 61)], "from_pkg string, to_pkg string, n long")
    pages = sinks.mermaid_pages(edges, 25).orderBy("page").collect()
    assert [r.page for r in pages] == [0, 1, 2] and sum(r.text.count("-->") for r in pages) == 60
    assert "|60|" in pages[0].text and "|60|" not in pages[1].text


def test_running_numbers_equal_a_plain_window(spark):
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from codestrata.operators.bucketed import running

    rng = random.Random(6)
    df = spark.createDataFrame([(rng.choice(["k", "k", "k", "l", None]), rng.randrange(50), i, rng.randrange(9)) for i in range(400)], "k string, a int, i long, v long").repartition(5)
    plain = Window.partitionBy("k").orderBy("a", "i").rowsBetween(Window.unboundedPreceding, 0)
    want = {(r.i, r.s) for r in df.withColumn("s", F.sum("v").over(plain)).collect()}
    assert {(r.i, r.s) for r in running(df, ["k"], ["a", "i"], "s", F.col("v")).collect()} == want
    assert running(df.limit(0), ["k"], ["a", "i"], "s").count() == 0
