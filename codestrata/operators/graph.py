"""Graph operators over edge tables (repo, src, dst): closure, components, blast radius, impact, package graph.

Searches run in rounds over blocks of edges: a repository's edges are dealt into blocks of bounded size (the edges of
one node stay together unless they alone fill more), each round a block carries what reached it as far as its own edges
lead, and what stands at nodes with edges in other blocks is passed on. A small repository is one block and needs one
round; a large one, or a node with very many edges, is many blocks and more rounds of the same. Rounds are checkpointed,
so lineage and lost executors don't grow into recomputation. All keys carry the repository.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.session import checkpointed, discard

BLOCK_EDGES = 50_000  # edges that one task holds
BLOCK_SOURCES = 8_192  # nodes whose reach one task carries along, as bits
BLOCK_TARGETS = 128  # targets that one task searches from


def _edges(edges: DataFrame) -> DataFrame:
    """Distinct edges without nulls."""
    return edges.where("repo is not null and src is not null and dst is not null").select("repo", "src", "dst").distinct()


def closure(edges: DataFrame) -> DataFrame:
    """Transitive closure by path doubling: (repo, src, dst) for every path of one edge or more.

    A node on a cycle reaches itself. Rounds: the logarithm of the longest shortest path.
    """
    reached = checkpointed(_edges(edges))
    size = reached.count()
    while True:
        left = reached.toDF("repo", "src", "mid")
        right = reached.toDF("repo", "mid", "dst")
        reached = checkpointed(reached.unionByName(left.join(right, ["repo", "mid"]).select("repo", "src", "dst")).distinct())
        grown = reached.count()
        if grown == size:
            return reached
        size = grown


def _tarjan(pairs: list[tuple[str, str]]) -> list[list[str]]:
    """Strongly connected components in reverse topological order, without recursion."""
    after: dict[str, list[str]] = defaultdict(list)
    for a, b in pairs:
        after[a].append(b)
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    on: set[str] = set()
    out: list[list[str]] = []
    for root in sorted({x for p in pairs for x in p}):
        if root in number:
            continue
        work = [(root, iter(after[root]))]
        number[root] = low[root] = len(number)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for far in rest:
                if far not in number:
                    number[far] = low[far] = len(number)
                    stack.append(far)
                    on.add(far)
                    work.append((far, iter(after[far])))
                    break
                if far in on:
                    low[node] = min(low[node], number[far])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    part = []
                    while not part or part[-1] != node:
                        part.append(stack.pop())
                        on.discard(part[-1])
                    out.append(part)
    return out


def _dealt(steps: DataFrame, block_edges: int) -> DataFrame:
    """steps (repo, node, next) with their block; a node's edges share one, unless the node has more than fit in one."""
    degree = steps.groupBy("repo", "node").agg(F.count("*").alias("__n"))
    parts = degree.select("repo", "node", F.ceil(F.col("__n") / block_edges).alias("__parts"))
    blocks = degree.groupBy("repo").agg(F.ceil(F.sum("__n") / block_edges).alias("__blocks"))
    block = F.pmod(F.xxhash64("node") + F.pmod(F.xxhash64("next"), F.col("__parts")), F.col("__blocks"))
    return steps.join(parts, ["repo", "node"]).join(blocks, "repo").select("repo", "node", "next", block.alias("block"))


def _border(moved: DataFrame, homes: DataFrame) -> DataFrame:
    """The rows of `moved` at nodes that have edges in a block other than the one that found them."""
    ends = homes.groupBy("repo", "node").agg(F.min("block").alias("__first"), F.max("block").alias("__last"))
    return moved.join(ends, ["repo", "node"]).where("__first <> __last or __first <> block").drop("__first", "__last")


def _anew(df: DataFrame) -> DataFrame:
    """The same rows as columns of their own, for a frame that meets its own descendants."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _components_of_block(group: pd.DataFrame) -> pd.DataFrame:
    found = _tarjan(list(zip(group["src"], group["dst"])))
    rows = [(group["repo"].iloc[0], node, min(part)) for part in found if len(part) > 1 for node in part]
    return pd.DataFrame(rows, columns=["repo", "node", "component"])


def components(edges: DataFrame, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """(repo, node, component): strongly connected components of two nodes or more; component is its least node.

    Components inside a block of nodes are found there (Tarjan) and contracted; what is left of repositories of more
    than one block is coloured forward and backward in rounds, linear in edges each. A loop edge is no cycle.
    """
    plain = checkpointed(_edges(edges).where("src <> dst"))
    blocks = plain.groupBy("repo").agg(F.ceil(F.count("*") / block_edges).alias("__blocks"))
    placed = plain.join(blocks, "repo").withColumn("block", F.pmod(F.xxhash64("src"), "__blocks"))
    inner = placed.where(F.col("block") == F.pmod(F.xxhash64("dst"), "__blocks")).select("repo", "block", "src", "dst")
    local = checkpointed(inner.groupBy("repo", "block").applyInPandas(_components_of_block, "repo string, node string, component string"))
    wide = placed.where("__blocks > 1").select("repo", "src", "dst")  # a repository of one block is done
    for end in ("src", "dst"):
        wide = wide.join(local.toDF("repo", end, f"__{end}"), ["repo", end], "left").withColumn(end, F.coalesce(f"__{end}", end)).drop(f"__{end}")
    far = _coloured(checkpointed(wide.where("src <> dst").select("repo", "src", "dst").distinct()))
    near = local.join(far.toDF("repo", "component", "__far"), ["repo", "component"], "left").select("repo", "node", F.coalesce("__far", "component").alias("component"))
    return near.unionByName(far.join(local, ["repo", "node"], "left_anti").select("repo", "node", "component"))


def _coloured(rest: DataFrame) -> DataFrame:
    """Components by forward-backward colouring: every node takes the least node that reaches it as colour; nodes of a
    colour that reach the colour's node are its component; they leave, and it repeats. Nodes that no edge enters or
    leaves within the rest are trimmed first."""
    empty = rest.limit(0).select("repo", F.col("src").alias("node"), F.col("dst").alias("component"))
    found: DataFrame | None = None
    while True:
        size = rest.count()
        while size:  # trim: only nodes with edges both ways can lie on a cycle
            inner = rest.select("repo", F.col("src").alias("node")).distinct().join(rest.select("repo", F.col("dst").alias("node")).distinct(), ["repo", "node"])
            inner, old = checkpointed(inner), rest
            rest = checkpointed(rest.join(inner.toDF("repo", "src"), ["repo", "src"], "left_semi").join(inner.toDF("repo", "dst"), ["repo", "dst"], "left_semi"))
            discard(old, inner)
            size, before = rest.count(), size
            if size == before:
                break
        if not size:
            break
        nodes = rest.select("repo", F.col("src").alias("node")).distinct()
        colour = checkpointed(nodes.select("*", F.col("node").alias("colour")))
        while True:  # the least node that reaches each node
            passed = rest.join(colour.toDF("repo", "src", "colour"), ["repo", "src"]).select("repo", F.col("dst").alias("node"), "colour")
            after = checkpointed(colour.unionByName(passed).groupBy("repo", "node").agg(F.min("colour").alias("colour")))
            moved = after.join(colour.toDF("repo", "node", "old"), ["repo", "node"]).where("colour <> old").limit(1).count()
            discard(colour)
            colour = after
            if not moved:
                break
        inside = rest.join(colour.toDF("repo", "src", "colour"), ["repo", "src"]).join(colour.toDF("repo", "dst", "other"), ["repo", "dst"]).where("colour = other")
        inside = checkpointed(inside.select("repo", "colour", "src", "dst"))
        members = checkpointed(colour.where("node = colour").select("repo", "colour", "node"))
        frontier = members
        while True:  # backwards from each colour's node
            back = inside.join(frontier.toDF("repo", "colour", "dst"), ["repo", "colour", "dst"]).select("repo", "colour", F.col("src").alias("node")).distinct()
            frontier = checkpointed(back.join(members, ["repo", "colour", "node"], "left_anti"))
            if not frontier.limit(1).count():
                break
            members = checkpointed(members.unionByName(frontier))
        part = members.select("repo", "node", F.col("colour").alias("component"))
        found = part if found is None else found.unionByName(part)
        gone = members.select("repo", "node")
        old = rest
        rest = checkpointed(rest.join(gone.toDF("repo", "src"), ["repo", "src"], "left_anti").join(gone.toDF("repo", "dst"), ["repo", "dst"], "left_anti"))
        discard(old, inside)
    if found is None:
        return empty
    large = found.groupBy("repo", "component").count().where("count > 1").select("repo", "component")
    return checkpointed(found.join(large, ["repo", "component"], "left_semi").select("repo", "node", "component"))


def cycles(edges: DataFrame) -> DataFrame:
    """(repo, component, size, line): each import cycle with its members in order, as `a → b → a`."""
    members = components(edges).groupBy("repo", "component").agg(F.array_sort(F.collect_list("node")).alias("members"))
    line = F.array_join(F.concat("members", F.slice("members", 1, 1)), " → ")
    return members.select("repo", "component", F.size("members").alias("size"), line.alias("line"))


_WORD = (1 << 64) - 1


def _reach_in_block(key, steps: pd.DataFrame, arrived: pd.DataFrame) -> pd.DataFrame:
    """What arrived at the block's nodes, as bits, carried to all nodes its edges lead to."""
    bits: dict[str, int] = defaultdict(int)
    for node, word, value in zip(arrived["node"], arrived["word"], arrived["bits"]):
        bits[node] |= (int(value) & _WORD) << (64 * int(word))
    pairs = [(a, b) for a, b in zip(steps["next"], steps["node"])]
    before: dict[str, set[str]] = defaultdict(set)
    for far, node in pairs:
        before[far].add(node)
    rows = []
    for part in _tarjan(pairs):  # along reversed edges, so what leads to a component comes before it
        own = 0
        for node in part:
            own |= bits[node]
            for far in before[node]:
                own |= bits[far]
        for node in part:
            new = own & ~bits[node]
            bits[node] = own
            word = 0
            while new:
                if low := new & _WORD:
                    rows.append((key[0], key[2], node, word, low - (1 << 64) if low >> 63 else low, key[1]))
                new >>= 64
                word += 1
    return pd.DataFrame(rows, columns=["repo", "part", "node", "word", "bits", "block"])


def reach_counts(edges: DataFrame, block_edges: int = BLOCK_EDGES, block_sources: int = BLOCK_SOURCES) -> DataFrame:
    """(repo, node, n): how many other nodes reach each node that any edge enters or leaves; no pairs are made.

    The sources are dealt into parts of about `block_sources`; a part's reach travels as 64-bit words along the blocks.
    """
    steps = checkpointed(_dealt(_edges(edges).where("src <> dst").toDF("repo", "node", "next"), block_edges))
    homes = checkpointed(steps.select("repo", "node", "block").distinct())
    sources = homes.select("repo", "node").distinct()
    parts = sources.groupBy("repo").agg(F.ceil(F.count("*") / block_sources).alias("__parts"))
    numbered = sources.join(parts, "repo").select("repo", "node", F.pmod(F.xxhash64("node", F.lit(1)), "__parts").alias("part"))
    place = F.row_number().over(Window.partitionBy("repo", "part").orderBy("node")) - 1
    word, bit = F.floor(F.col("__place") / 64).cast("int"), F.expr("shiftleft(1L, cast(__place % 64 as int))")
    known = checkpointed(numbered.withColumn("__place", place).select("repo", "part", "node", word.alias("word"), bit.alias("bits")))
    used = steps.join(parts, "repo").select("repo", "block", "node", "next", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1)).alias("part"))
    frontier = known.join(homes, ["repo", "node"])
    own = ["repo", "part", "node", "word"]
    merged = lambda rows: rows.groupBy(*own).agg(F.bit_or("bits").alias("bits"))
    without = lambda bits, old: F.col(bits).bitwiseAND(F.bitwise_not(F.coalesce(old, F.lit(0).cast("long"))))
    while True:
        moved = used.groupBy("repo", "block", "part").cogroup(_anew(frontier).groupBy("repo", "block", "part")).applyInPandas(_reach_in_block, "repo string, part long, node string, word int, bits long, block long")
        moved = checkpointed(moved)
        border = checkpointed(_border(moved, homes))
        if border.limit(1).count():
            new = merged(border).join(merged(known).withColumnRenamed("bits", "__old"), own, "left").select(*own, without("bits", "__old").alias("bits")).where("bits <> 0")
            # what a block found it has carried on already; other blocks with edges of the node have not
            done = border.select(*own, "block", F.col("bits").alias("__done"))
            frontier = new.join(homes, ["repo", "node"]).join(done, [*own, "block"], "left")
            frontier = checkpointed(frontier.select(*own, "block", without("bits", "__done").alias("bits")).where("bits <> 0"))
        known = known.unionByName(moved.drop("block"))
        if not border.limit(1).count() or not frontier.limit(1).count():
            break
        known = checkpointed(merged(known))
        discard(moved, border)
    known = merged(known)
    counts = known.groupBy("repo", "node").agg(F.sum(F.bit_count("bits")).alias("__n"))
    # a source's own bit is no other node
    itself = sources.withColumn("__own", F.lit(1))
    return counts.join(itself, ["repo", "node"], "left").select("repo", "node", (F.col("__n") - F.coalesce("__own", F.lit(0))).alias("n"))


def blast_radius(edges: DataFrame, nodes: DataFrame, block_edges: int = BLOCK_EDGES, block_sources: int = BLOCK_SOURCES) -> DataFrame:
    """(repo, node, blast): how many other nodes reach each node of `nodes` (repo, node); 0 where none does."""
    counts = reach_counts(edges, block_edges, block_sources).withColumnRenamed("n", "blast")
    return nodes.distinct().join(counts, ["repo", "node"], "left").select("repo", "node", F.coalesce("blast", F.lit(0).cast("long")).alias("blast"))


def _impact_in_block(most_depth: int | None):
    def search(key, steps: pd.DataFrame, arrived: pd.DataFrame) -> pd.DataFrame:
        after: dict[str, list[str]] = defaultdict(list)
        for a, b in zip(steps["node"], steps["next"]):
            after[a].append(b)
        starts: dict[str, list[tuple[int, str]]] = defaultdict(list)
        for target, node, depth in zip(arrived["target"], arrived["node"], arrived["depth"]):
            starts[target].append((int(depth), node))
        rows = []
        for target, begun in starts.items():
            best = {node: depth for depth, node in sorted(begun, reverse=True)}
            given = dict(best)
            waiting: dict[int, list[str]] = defaultdict(list)
            for node, depth in best.items():
                waiting[depth].append(node)
            while waiting:
                depth = min(waiting)
                for node in waiting.pop(depth):
                    if best[node] < depth or most_depth is not None and depth >= most_depth:
                        continue
                    for far in after[node]:
                        if depth + 1 < best.get(far, depth + 2):
                            best[far] = depth + 1
                            waiting[depth + 1].append(far)
            rows += [(key[0], key[2], target, node, depth, key[1]) for node, depth in best.items() if given.get(node) != depth]
        return pd.DataFrame(rows, columns=["repo", "part", "target", "node", "depth", "block"])

    return search


def impact(edges: DataFrame, targets: DataFrame, most_depth: int | None = None, reverse: bool = True, block_edges: int = BLOCK_EDGES, block_targets: int = BLOCK_TARGETS) -> DataFrame:
    """(repo, target, node, depth): what is affected by each target (repo, target), at its least depth.

    Over reversed edges (forward with reverse=False), without limit unless `most_depth` is given; a target never
    lists itself. The targets of a repository are dealt into parts of about `block_targets`.
    """
    steps = _edges(edges).toDF("repo", "node", "next") if not reverse else _edges(edges).select("repo", F.col("dst").alias("node"), F.col("src").alias("next"))
    steps = checkpointed(_dealt(steps, block_edges))
    homes = checkpointed(steps.select("repo", "node", "block").distinct())
    wanted = targets.where("repo is not null and target is not null").select("repo", "target").distinct()
    parts = checkpointed(wanted.groupBy("repo").agg(F.ceil(F.count("*") / block_targets).alias("__parts")))
    known = wanted.join(parts, "repo").select("repo", F.pmod(F.xxhash64("target"), "__parts").alias("part"), "target", F.col("target").alias("node"), F.lit(0).alias("depth"))
    known = checkpointed(known)
    used = steps.join(parts, "repo").select("repo", "block", "node", "next", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1)).alias("part"))
    frontier = known.join(homes, ["repo", "node"])
    own = ["repo", "part", "target", "node"]
    merged = lambda rows: rows.groupBy(*own).agg(F.min("depth").alias("depth"))
    search = _impact_in_block(most_depth)
    while True:
        moved = used.groupBy("repo", "block", "part").cogroup(_anew(frontier).groupBy("repo", "block", "part")).applyInPandas(search, "repo string, part long, target string, node string, depth int, block long")
        moved = checkpointed(moved)
        border = checkpointed(_border(moved, homes))
        if border.limit(1).count():
            new = merged(border).join(merged(known).withColumnRenamed("depth", "__old"), own, "left").where("__old is null or depth < __old").drop("__old")
            # a block that found the least depth has searched on from there; other blocks with edges of the node have not
            done = border.select(*own, "block", "depth")
            frontier = checkpointed(new.join(homes, ["repo", "node"]).join(done, [*own, "block", "depth"], "left_anti"))
        known = known.unionByName(moved.drop("block"))
        if not border.limit(1).count() or not frontier.limit(1).count():
            break
        known = checkpointed(merged(known))
        discard(moved, border)
    known = merged(known)
    return known.where("depth > 0").select("repo", "target", "node", "depth")


def expand_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, src, dst) pairs behind import edges (repo, from_path, to_id, kind): a file target as it is, a directory
    target as each file in it, others none. Self-pairs are dropped, duplicates kept. `files` is (repo, path).
    """
    known = files.select("repo", "path").distinct()
    edges = imports.where("kind in ('import', 'reexport')").select("repo", F.col("from_path").alias("src"), F.col("to_id").alias("to"))
    edges = edges.join(known.toDF("repo", "src"), ["repo", "src"], "left_semi")
    # a target is a file or a directory, never both: one join against files under either key
    keys = known.select("repo", "path", F.explode(F.array(F.col("path"), _directory(F.col("path")))).alias("to"))
    return edges.join(keys, ["repo", "to"]).where("src <> path").select("repo", "src", F.col("path").alias("dst"))


def counted_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, src, dst): import edges whose target is a file or a directory with files, not expanded; duplicates kept."""
    known = files.select("repo", "path").distinct()
    ids = known.select("repo", F.explode(F.array(F.col("path"), _directory(F.col("path")))).alias("dst")).distinct()
    edges = imports.where("kind in ('import', 'reexport') and from_path <> to_id").select("repo", F.col("from_path").alias("src"), F.col("to_id").alias("dst"))
    return edges.join(known.toDF("repo", "src"), ["repo", "src"], "left_semi").join(ids, ["repo", "dst"], "left_semi").select("repo", "src", "dst")


def _directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def fan_metrics(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, path, fan_in, fan_out): distinct importing files over expanded targets, distinct targets unexpanded."""
    fan_in = expand_targets(imports, files).groupBy("repo", F.col("dst").alias("path")).agg(F.countDistinct("src").alias("fan_in"))
    fan_out = counted_targets(imports, files).groupBy("repo", F.col("src").alias("path")).agg(F.countDistinct("dst").alias("fan_out"))
    zero = F.lit(0).cast("long")
    return (
        files.select("repo", "path").distinct()
        .join(fan_in, ["repo", "path"], "left").join(fan_out, ["repo", "path"], "left")
        .select("repo", "path", F.coalesce("fan_in", zero).alias("fan_in"), F.coalesce("fan_out", zero).alias("fan_out"))
    )


def top_k(metrics: DataFrame, by: str, k: int, keys: list[str]) -> DataFrame:
    """The k largest rows by `by`, ties in key order; a top-k, so no global sort."""
    return metrics.orderBy(F.desc(by), *keys).limit(k)


# Base names of files that a runtime starts, and exported names that it calls.
FRONT_DOOR = r"^(main|index|server|app|cli|worker|handler)\."
FRONT_NAMES = ("main", "handler", "fetch")


def front_doors(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, path): files with a front door's base name, or that export a front door's name as something callable."""
    paths = files.select("repo", "path").distinct()
    named = paths.where(F.regexp_extract("path", r"([^/]*)$", 1).rlike(FRONT_DOOR))
    called = (F.col("kind") == "function") | F.col("kind").isin("const", "let") & (F.contains("signature", F.lit("=>")) | F.col("signature").rlike(r"(^|[^A-Za-z0-9_$])function[\s*(<]"))
    exporting = symbols.where(F.col("exported") & F.col("parent").isNull() & F.col("name").isin(*FRONT_NAMES) & F.coalesce(called, F.lit(False)))
    return named.unionByName(paths.join(exporting.select("repo", F.col("file").alias("path")), ["repo", "path"], "left_semi")).distinct()


def impact_pairs(pairs: DataFrame, references: DataFrame) -> DataFrame:
    """Import pairs (repo, src, dst) and reference edges (repo, from, to) as one graph over files, nodes and `ext:` ids.

    Both point from what depends to what it depends on, so impact and blast radius mix files and nodes. References are
    taken as they are; distinct edges, without loops and nulls.
    """
    edges = references.select("repo", F.col("from").alias("src"), F.col("to").alias("dst"))
    return _edges(pairs.select("repo", "src", "dst").unionByName(edges)).where("src <> dst")


def package_cycles(edges: DataFrame) -> DataFrame:
    """(repo, component, size, line): cycles of the package graph (repo, from_pkg, to_pkg)."""
    return cycles(edges.select("repo", F.col("from_pkg").alias("src"), F.col("to_pkg").alias("dst")))


def entry_points(imports: DataFrame, files: DataFrame, packages: DataFrame, per_package: int = 5, doors: DataFrame | None = None) -> DataFrame:
    """(repo, pkg, path, reach, place): files nobody imports, by how much they reach, the first few of each package.

    `packages` is (repo, path, pkg), the package that owns each file; `doors` (repo, path), where given, the only
    candidates, then also those that reach nothing.
    """
    edges = checkpointed(expand_targets(imports, files).distinct())
    back = edges.select("repo", F.col("dst").alias("src"), F.col("src").alias("dst"))
    reach = reach_counts(back).where("n > 0").select("repo", F.col("node").alias("path"), F.col("n").alias("reach"))
    open_files = files.select("repo", "path").distinct().join(edges.select("repo", F.col("dst").alias("path")).distinct(), ["repo", "path"], "left_anti")
    if doors is not None:
        open_files = open_files.join(doors, ["repo", "path"], "left_semi")
    rows = open_files.join(reach, ["repo", "path"], "inner" if doors is None else "left").withColumn("reach", F.coalesce("reach", F.lit(0).cast("long"))).join(packages, ["repo", "path"])
    order = Window.partitionBy("repo", "pkg").orderBy(F.desc("reach"), "path")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_package).select("repo", "pkg", "path", "reach", "place")
