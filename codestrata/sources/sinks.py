"""Writing maps: sorted JSON lines, Markdown reports, and only what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.operators.bucketed import running


def json_lines(table: DataFrame, order: list[str]) -> DataFrame:
    """One column `value`: each row as JSON with sorted keys and without nulls, in the given total order."""
    columns = sorted(table.columns)
    return table.orderBy(*order).select(F.to_json(F.struct(*columns)).alias("value"))


def write_json_lines(table: DataFrame, order: list[str], path: str, single: bool = False) -> None:
    """Sorted JSON lines under path; one file with single=True (small, golden outputs), else range-partitioned parts."""
    lines = json_lines(table, order)
    (lines.coalesce(1) if single else lines).write.mode("overwrite").text(path)


def write_changed(expected: DataFrame, path: str) -> DataFrame:
    """Write artifacts (path, text) into a parquet store partitioned by shard, rewriting only shards that differ.

    Returns (path, state) of what was changed, added or pruned. The shard is a hash of the path.
    """
    from codestrata.operators.compare import verify
    from codestrata.session import checkpointed

    spark = expected.sparkSession
    rows = expected.select("path", "text", F.sha2("text", 256).alias("sha"), F.pmod(F.xxhash64("path"), F.lit(256)).alias("shard"))
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        rows.write.partitionBy("shard").parquet(path)
        return rows.select("path", F.lit("missing").alias("state"))
    before = spark.read.schema("path string, text string, sha string, shard int").parquet(path)
    states = checkpointed(verify(rows, before, ["path"], "sha"))  # read again after its inputs are overwritten
    shards = [r.shard for r in states.select(F.pmod(F.xxhash64("path"), F.lit(256)).cast("int").alias("shard")).distinct().collect()]  # 256 at most
    if shards:
        rows.where(F.col("shard").isin(shards)).write.partitionBy("shard").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        left = {r.shard for r in rows.where(F.col("shard").isin(shards)).select("shard").distinct().collect()}
        for shard in set(shards) - left:
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={shard}"), True)
    return states


def diagram_edges(edges: DataFrame, per_page: int = 25) -> DataFrame:
    """(page, from_pkg, to_pkg, n): package edges summed, heaviest first, `per_page` to a page; none is left out."""
    sums = edges.groupBy("from_pkg", "to_pkg").agg(F.sum("n").alias("n"))
    placed = running(sums.withColumn("__heavy", -F.col("n")), [], ["__heavy", "from_pkg", "to_pkg"], "__place")
    return placed.select(F.floor((F.col("__place") - 1) / per_page).cast("int").alias("page"), "from_pkg", "to_pkg", "n")


def mermaid_pages(edges: DataFrame, per_page: int = 25) -> DataFrame:
    """(page, text): flow charts of package edges (from_pkg, to_pkg, n), `per_page` edges each; labels only above 1."""
    rows = F.array_sort(F.collect_list(F.struct("from_pkg", "to_pkg", "n")))
    grouped = diagram_edges(edges, per_page).groupBy("page").agg(rows.alias("rows"))
    names = F.array_sort(F.array_distinct(F.flatten(F.transform("rows", lambda r: F.array(r["from_pkg"], r["to_pkg"])))))
    grouped = grouped.withColumn("names", names)
    ident = lambda name: F.concat(F.lit("n"), F.array_position(F.col("names"), name) - 1)
    nodes = F.transform("names", lambda n: F.concat(F.lit("  "), ident(n), F.lit('["'), F.replace(n, F.lit('"'), F.lit("#quot;")), F.lit('"]')))
    label = lambda n: F.when(n > 1, F.concat(F.lit("|"), n, F.lit("|"))).otherwise("")
    arrows = F.transform("rows", lambda r: F.concat(F.lit("  "), ident(r["from_pkg"]), F.lit(" -->"), label(r["n"]), F.lit(" "), ident(r["to_pkg"])))
    return grouped.select("page", F.array_join(F.concat(F.array(F.lit("graph LR")), nodes, arrows), "\n").alias("text"))


def mermaid(edges: DataFrame, per_page: int = 25) -> str:
    """The pages of a repository's flow chart as one text, every edge in it; for writing many, take mermaid_pages."""
    return "\n\n".join(r.text for r in mermaid_pages(edges, per_page).orderBy("page").toLocalIterator())


def hotspots_markdown(metrics: DataFrame, k: int = 10) -> str:
    """The k most imported files as a Markdown table."""
    rows = metrics.orderBy(F.desc("fan_in"), "repo", "path").limit(k).collect()
    return "\n".join(["| repo | path | fan-in |", "|---|---|---|", *[f"| {r.repo} | {r.path} | {r.fan_in} |" for r in rows]])


def render_tree(paths: list[str]) -> str:
    """An ASCII tree of paths, directories first, each level in order; for a bounded list such as a page of files."""
    root: dict = {}
    for path in paths:
        node = root
        for part in path.split("/"):
            node = node.setdefault(part, {})
    lines: list[str] = []
    def level(node: dict, prefix: str) -> list[tuple]:
        names = sorted(node, key=lambda n: (not node[n], n))
        return [(node[n], n, prefix, i == len(names) - 1) for i, n in enumerate(names)]

    todo = level(root, "")[::-1]
    while todo:
        node, name, prefix, last = todo.pop()
        lines.append(f"{prefix}{'└── ' if last else '├── '}{name}{'/' if node else ''}")
        todo += level(node, prefix + ("    " if last else "│   "))[::-1]
    return "\n".join(lines)


def relative_link(source: str, target: str) -> str:
    """The link from one artifact's path to another's."""
    a, b = source.split("/")[:-1], target.split("/")
    same = 0
    while same < min(len(a), len(b) - 1) and a[same] == b[same]:
        same += 1
    return "/".join([".."] * (len(a) - same) + b[same:])
