import json
import subprocess

import pytest

from codestrata.functions import ids
from codestrata.operators import compare, summaries
from codestrata.sources import config, vcs
from pyspark.sql import functions as F


def git(root, *arguments):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *arguments], check=True, capture_output=True)


def test_git_candidates_and_changes(spark, tmp_path):
    git(tmp_path.parent, "init", "-q", str(tmp_path))
    for name, text in {"a.py": "x", "b.py": "y", "old name.py": "z" * 50, "gone.py": "g", ".gitignore": "*.log\n"}.items():
        (tmp_path / name).write_text(text)
    git(tmp_path, "add", "-A")
    git(tmp_path, "commit", "-qm", "one")
    first = subprocess.run(["git", "-C", str(tmp_path), "rev-parse", "HEAD"], capture_output=True, text=True).stdout.strip()
    (tmp_path / "a.py").write_text("changed")
    git(tmp_path, "commit", "-qam", "two")
    git(tmp_path, "mv", "old name.py", "new name.py")
    (tmp_path / "gone.py").unlink()
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "é.py").write_text("n")
    (tmp_path / "x.log").write_text("n")
    paths = lambda df: sorted(r.path for r in df.collect())
    assert paths(vcs.candidates(spark, str(tmp_path), "r")) == [".gitignore", "a.py", "b.py", "d/é.py", "new name.py"]
    assert paths(vcs.working_tree_changes(spark, str(tmp_path), "r")) == ["d/é.py", "gone.py", "new name.py", "old name.py"]
    assert paths(vcs.committed_since(spark, str(tmp_path), "r", first)) == ["a.py"]
    for bad in ("--upload-pack=x", "f" * 40, "", None):
        with pytest.raises(vcs.GitError):
            vcs.committed_since(spark, str(tmp_path), "r", bad)


def test_config(tmp_path):
    assert config.load(str(tmp_path / "none.json")) == config.Config() == config.validate(None)
    (tmp_path / "c.json").write_bytes(b"\xef\xbb\xbf" + json.dumps({"languages": ["go"], "diagram_nodes": 5, "other": 1}).encode())
    assert config.load(str(tmp_path / "c.json")).languages == ["go"]
    for bad in ([], {"include": "x"}, {"exclude": [1]}, {"languages": ["cobol"]}, {"diagram_nodes": 0}, {"diagram_nodes": True}):
        with pytest.raises(config.ConfigError):
            config.validate(bad)
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(config.ConfigError):
        config.load(str(tmp_path / "bad.json"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "link").symlink_to(tmp_path)
    assert config.contained(str(tmp_path / "in"), "a/b.md").endswith("/in/a/b.md")
    for bad in ("../x", "/etc/x", "", ".", "link/x"):
        with pytest.raises(config.ConfigError):
            config.contained(str(tmp_path / "in"), bad)


def test_summary_answers_and_cache(spark):
    asked = {"a", "b"}
    assert summaries.summaries_in('Sure: {"note": 1} then ```json\n{"a": " x ", "b": "", "c": "y"}\n```', asked) == {"a": "x"}
    assert summaries.summaries_in('[{"path": "b", "text": "t"}, {"path": "z", "text": "u"}, 3]', asked) == {"b": "t"}
    assert summaries.summaries_in("{ no json [1,", asked) == summaries.summaries_in(None, asked) == {}
    answers = spark.createDataFrame([("r", 1, ["a"], '{"a": "x"}'), ("r", 2, ["b"], None), ("r", 3, None, "{}")], "repo string, batch int, paths array<string>, answer string")
    assert [tuple(r) for r in summaries.parse_answers(answers).collect()] == [("r", "a", "x")]
    entry = "sha256 string, path string, text string, refreshed_at string, model string"
    cache = spark.createDataFrame([("1", "a", "old", "2026-01-01", "m"), ("2", "b", "keep", "2026-01-01", "m"), ("3", "c", "gone", "2026-01-01", "m"), (None, "d", "x", "2026-01-01", "m")], entry)
    fresh = spark.createDataFrame([("1", "a", "new", "2026-01-01", "m"), ("9", "z", "unknown", "2026-01-01", "m")], entry)
    files = spark.createDataFrame([("1",), ("2",), ("2",), (None,)], "sha256 string")
    assert {(r.sha256, r.text) for r in summaries.next_cache(cache, fresh, files).collect()} == {("1", "new"), ("2", "keep")}
    calls = spark.createDataFrame([("r", "a#f", "b#g"), ("r", "a#f", "c#h"), ("q", "a#f", "b#g")], "repo string, `from` string, `to` string")
    assert summaries.call_lines(calls, spark.createDataFrame([("r", "a"), ("r", "b")], "repo string, path string")).count() == 1


def test_sampling_and_drift(spark):
    symbols = spark.createDataFrame([("r", f"id{i}", "function" if i % 3 else "class") for i in range(300)] * 2, "repo string, id string, kind string")
    one = {tuple(r) for r in compare.sample_tasks(symbols, 5, 1).collect()}
    assert len(one) == 10 and one == {tuple(r) for r in compare.sample_tasks(symbols.repartition(7), 5, 1).collect()} and one != {tuple(r) for r in compare.sample_tasks(symbols, 5, 2).collect()}
    old = spark.createDataFrame([(f"k{i}", str(i)) for i in range(300)], "k string, v string")
    drifted = compare.inject_drift(old, ["k"], "v", 4)
    told = {(r.k, r.state) for r in compare.verify(old, drifted.where("injected is null or injected <> 'missing'"), ["k"], "v").collect()}
    assert told == {(r.k, r.injected) for r in drifted.where("injected is not null").collect()} and {s for _, s in told} == {"missing", "changed", "extra"}
    tokens = spark.createDataFrame([("a/b",), ("x.ts",), ("Dockerfile",), ("name",), ("a/b#c",)], "t string")
    assert [r[0] for r in tokens.select(ids.looks_like_path(F.col("t"))).collect()] == [True, True, True, False, False]
    assert spark.range(1).select(ids.shortened(F.array(*map(F.lit, "abcd")), 2), ids.shortened(F.array(F.lit("a")), 2)).first()[:] == ("a, b and 2 more", "a")
