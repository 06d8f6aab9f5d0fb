"""Schemas that drift between files: one consistent table and a report of every change.

Each file's schema is a graph of fields (names, kinds, nesting). The schemas of neighbouring
files of a series are matched by similarity flooding: candidate pairs start with the similarity
of their names and kinds, scores flow along the nesting until they converge, and a one-to-one
set of consistent correspondences is chosen. Records are then read under canonical names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.operators.bucketed import previous_row
from codestrata.operators.jsontree import kind_of, parse_record, scalar_text
from codestrata.operators.shred import valid_records
from codestrata.session import checkpointed, spread

KINDS = ("string", "number", "boolean", "object", "array")


def record_fields(record: dict) -> set[tuple[str, str]]:
    """(dotted path, kind) of a record's fields; arrays add no step, nulls are no field, a string is a string."""
    found: set[tuple[str, str]] = set()
    stack: list[tuple[str, object]] = [("", record)]
    while stack:
        path, value = stack.pop()
        if isinstance(value, dict):
            for key, child in value.items():
                if child is not None:
                    below = f"{path}.{key}" if path else key
                    found.add((below, kind_of(child)))
                    stack.append((below, child))
        elif isinstance(value, list):
            stack.extend((path, child) for child in value)
    return found


def _field_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        shapes: dict[frozenset, list] = {}  # most lines of a batch share their shape
        seen: set[tuple[str, frozenset]] = set()
        for name, payload in zip(batch["file_name"].tolist(), batch["payload"].tolist()):
            record = parse_record(payload)
            if record is not None:
                shape = frozenset(record_fields(record))
                shapes.setdefault(shape, [{"path": path, "kind": kind} for path, kind in shape])
                seen.add((name, shape))
        yield pd.DataFrame([(name, shapes[shape]) for name, shape in seen], columns=["file_name", "shape"])


def file_schemas(raw: DataFrame) -> DataFrame:
    """One row per file: file_name, suite, runner, written_at and `fields`, its sorted (path, kinds) pairs.

    Lines are read once and reduced to the distinct shapes of a file before they are shuffled. A file without a
    valid line has no fields. Rows with a null file_name are left out.
    """
    rows = raw.where("file_name is not null")
    files = rows.groupBy("file_name").agg(F.min("suite").alias("suite"), F.min("runner").alias("runner"), F.min("written_at").alias("written_at"))
    parsed = spread(rows.where("payload is not null").select("file_name", "payload")).mapInPandas(_field_batches, "file_name string, shape array<struct<path:string,kind:string>>")
    every = parsed.groupBy("file_name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("shape")))).alias("pairs"))
    paths = F.array_distinct(F.transform("pairs", lambda f: f["path"]))
    kinds = lambda p: F.array_join(F.transform(F.filter("pairs", lambda f: f["path"] == p), lambda f: f["kind"]), "+")
    fields = every.select("file_name", F.transform(paths, lambda p: F.struct(p.alias("path"), kinds(p).alias("kinds"))).alias("fields"))
    empty = F.array().cast("array<struct<path:string,kinds:string>>")
    return files.join(fields, "file_name", "left").withColumn("fields", F.coalesce("fields", empty))


def _trigrams(name: str) -> set[str]:
    padded = f"  {name.lower().replace('_', '').replace('-', '')} "
    return {padded[i : i + 3] for i in range(len(padded) - 2)}


def name_similarity(a: str, b: str) -> float:
    """Dice coefficient of the names' trigrams, 0 to 1."""
    left, right = _trigrams(a), _trigrams(b)
    return 2 * len(left & right) / (len(left) + len(right))


def _parent(path: str) -> str:
    return path.rpartition(".")[0]


def _leaf(path: str) -> str:
    return path.rpartition(".")[2]


def flood(old: dict[str, str], new: dict[str, str], rounds: int = 50, residual: float = 1e-3) -> dict[tuple[str, str], float]:
    """Similarity flooding between two schemas ({path: kinds}); scores of candidate pairs, 1 at most.

    Pairs of the connectivity graph: fields with the same path (anchors), fields that only one side has
    under the same parent, and all pairs of children below such a pair. Edges are the nesting; a pair
    passes its score to its neighbours in equal shares, both ways, on top of its initial similarity.
    """
    children: tuple[dict, dict] = (defaultdict(list), defaultdict(list))
    for side, fields in zip(children, (old, new)):
        for path in fields:
            side[_parent(path)].append(path)
    initial: dict[tuple[str, str], float] = {}
    edges: dict[tuple[str, str], list[tuple[str, str]]] = defaultdict(list)
    todo: list[tuple[str, str]] = [("", "")]
    while todo:
        a, b = pair = todo.pop()
        initial[pair] = 1.0 if a == b else 0.5 * name_similarity(_leaf(a), _leaf(b)) + 0.5 * (old[a] == new[b])
        left, right = children[0][a], children[1][b]
        names_left, names_right = {_leaf(x) for x in left}, {_leaf(x) for x in right}
        for x in left:
            for y in right:
                both = _leaf(x) == _leaf(y)
                alone = _leaf(x) not in names_right and _leaf(y) not in names_left
                if both or alone:
                    edges[pair].append((x, y))
                    edges[(x, y)].append(pair)
                    todo.append((x, y))
    score = dict(initial)
    for _ in range(rounds):
        flow = dict(initial)
        for pair, near in edges.items():
            share = score[pair] / len(near)
            for other in near:
                flow[other] += share
        top = max(flow.values())
        flow = {pair: value / top for pair, value in flow.items()}
        change = max(abs(flow[pair] - score[pair]) for pair in flow)
        score = flow
        if change < residual:
            break
    return score


def correspondences(old: dict[str, str], new: dict[str, str], scores: dict[tuple[str, str], float] | None = None) -> dict[str, str]:
    """A consistent one-to-one choice of the flooded pairs, best score first: {old path: new path}.

    A pair is consistent if its parents were chosen for each other and its kinds agree (or its path is unchanged).
    Fields left over on both sides are matched last where they keep name and kind under another parent (moves), the
    pair with the most similar parents first.
    """
    scores = flood(old, new) if scores is None else scores
    chosen: dict[str, str] = {"": ""}
    taken: set[str] = {""}
    by_depth = sorted((p for p in scores if p != ("", "")), key=lambda p: (p[0].count("."), -scores[p], p))
    for a, b in by_depth:
        if a in chosen or b in taken or chosen.get(_parent(a)) != _parent(b):
            continue
        if a == b or _leaf(a) == _leaf(b) or old[a] == new[b]:
            chosen[a] = b
            taken.add(b)
    left: dict[tuple[str, str], list[str]] = defaultdict(list)
    for b in new:
        if b not in taken:
            left[_leaf(b), new[b]].append(b)
    moves = [(-name_similarity(_parent(a), _parent(b)), a, b) for a in old if a not in chosen for b in left[_leaf(a), old[a]]]
    for _, a, b in sorted(moves):
        if a not in chosen and b not in taken:
            chosen[a] = b
            taken.add(b)
    del chosen[""]
    return chosen


def _below(path: str, reported) -> bool:
    while path := _parent(path):
        if path in reported:
            return True
    return False


def _goes_along(a: str, b: str, chosen: dict[str, str]) -> bool:
    """Whether the fields stand under parents that correspond."""
    return _parent(b) == (chosen.get(_parent(a)) if _parent(a) else "")


def matched_changes(old: dict[str, str], new: dict[str, str], chosen: dict[str, str]) -> list[tuple[str, str, str]]:
    """(change, old_field, new_field) that the correspondences tell: a field without one is removed or added, one whose
    name or parent's correspondence differs is renamed or moved, one whose kinds differ retyped."""
    to = set(chosen.values())
    out = [("removed", a, "") for a in old if a not in chosen] + [("added", "", b) for b in new if b not in to]
    for a, b in chosen.items():
        if a != b and _goes_along(a, b, chosen):
            if _leaf(a) != _leaf(b):
                out.append(("renamed", a, b))
        elif a != b:
            out.append(("moved", a, b))
        if old[a] != new[b]:
            out.append(("retyped", a, b))
    return out


def schema_changes(old: dict[str, str], new: dict[str, str]) -> list[tuple[str, str, str]]:
    """(change, old_field, new_field) between two schemas: what the correspondences tell, after an exact check.

    The check: a rename counts only if it is the only field that went and the only one that came under its parent, with
    equal kinds; other renames and moves become a removal and an addition. Nothing below a reported field is reported.
    """
    went, came = defaultdict(int), defaultdict(int)
    for path in old.keys() - new.keys():
        went[_parent(path)] += 1
    for path in new.keys() - old.keys():
        came[_parent(path)] += 1
    found: set[tuple[str, str, str]] = set()
    for change, a, b in matched_changes(old, new, correspondences(old, new)):
        single = _parent(a) == _parent(b) and went[_parent(a)] == came[_parent(a)] == 1 and old.get(a) == new.get(b)
        if change in ("added", "removed") or change == "renamed" and single or change == "retyped" and a == b:
            found.add((change, a, b))
        elif a != b:
            found |= {("removed", a, ""), ("added", "", b)}
    # a pair below renamed parents keeps its leaf: to the report it went and came with them, below what is reported
    gone = {a for change, a, _ in found if a}
    fresh = {b for change, _, b in found if b}
    return sorted((c, a, b) for c, a, b in found if not (a and _below(a, gone)) and not (b and _below(b, fresh)))


def _change_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        known: dict[tuple, list] = {}  # within a batch, equal pairs of schemas are matched once
        out = []
        for name, now, before in zip(batch["file_name"].tolist(), batch["fields"].tolist(), batch["before"].tolist()):
            new = {f["path"]: f["kinds"] for f in now}
            old = {f["path"]: f["kinds"] for f in before}
            key = (tuple(old.items()), tuple(new.items()))
            if key not in known:
                known[key] = schema_changes(old, new)
            out += [(name, *change) for change in known[key]]
        yield pd.DataFrame(out, columns=["file_name", "change", "old_field", "new_field"])


def _neighbours(schemas: DataFrame) -> DataFrame:
    """(suite, runner, file_name, fields, before): files whose fields differ from those of the file before in the series.

    The previous file is found with a look-back split by day, so that a hot series is not one task.
    """
    pairs = previous_row(schemas, ["suite", "runner"], ["written_at", "file_name"], F.date_trunc("day", "written_at"), ["fields"], "__before")
    return pairs.where("__before is not null").select("suite", "runner", "file_name", "fields", F.col("__before.fields").alias("before")).where("fields <> before")


def field_changes(raw: DataFrame) -> DataFrame:
    """(file_name, change, old_field, new_field): every change against the file before in its series.

    A series is (suite, runner) in order of written_at, then file_name.
    """
    differing = _neighbours(checkpointed(file_schemas(raw))).select("file_name", "fields", "before")
    return differing.mapInPandas(_change_batches, "file_name string, change string, old_field string, new_field string")


def _match_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for suite, runner, name, now, before in zip(*(batch[c].tolist() for c in ("suite", "runner", "file_name", "fields", "before"))):
            new, old = ({f["path"]: f["kinds"] for f in fields} for fields in (now, before))
            chosen = correspondences(old, new)
            out += [(suite, runner, name, *change) for change in matched_changes(old, new, chosen)]
            out += [(suite, runner, name, "below", a, b) for a, b in chosen.items() if a != b and _leaf(a) == _leaf(b) and _goes_along(a, b, chosen)]
        yield pd.DataFrame(out, columns=["suite", "runner", "file_name", "change", "old_field", "new_field"])


def correspondence_changes(schemas: DataFrame) -> DataFrame:
    """(suite, runner, file_name, change, old_field, new_field) as flooding matches the fields: also renames where several
    fields go and come at once, below renamed parents, and moves. `below` marks fields that went along with a renamed or moved
    parent. schemas is what file_schemas gives."""
    return _neighbours(schemas).mapInPandas(_match_batches, "suite string, runner string, file_name string, change string, old_field string, new_field string")


def unified_names(pairs: set[tuple[str, str]], schemas: list[set[str]]) -> dict[str, str]:
    """{path: field} for all paths of a series' schemas: names that were renamed or moved into each other, and never
    stand side by side in one file, are one field, called by its first name (one that nothing was renamed to), of
    several by the one that most schemas use."""
    group = {path: path for schema in schemas for path in schema}
    members = {path: {path} for path in group}
    together = {frozenset((a, b)) for schema in schemas for a, b in pairs if a in schema and b in schema}

    def root(name: str) -> str:
        while group[name] != name:
            name = group[name]
        return name

    for a, b in sorted(pairs):
        x, y = root(a), root(b)
        if x == y or frozenset((a, b)) in together or any(p in schema and q in schema for schema in schemas for p in members[x] for q in members[y]):
            continue
        group[x] = y
        members[y] |= members.pop(x)
    later = {b for _, b in pairs}
    used = {path: sum(path in schema for schema in schemas) for path in group}
    return {path: min(members[root(path)], key=lambda p: (p in later, -used[p], p)) for path in group}


def _series_names(key, changes: pd.DataFrame, shapes: pd.DataFrame) -> pd.DataFrame:
    schemas = [{f["path"] for f in fields} for fields in shapes["fields"]]
    names = unified_names(set(zip(changes["old_field"], changes["new_field"])), schemas)
    return pd.DataFrame([(*key, path, field) for path, field in names.items()], columns=["suite", "runner", "path", "field"])


def consistent_names(schemas: DataFrame) -> DataFrame:
    """(suite, runner, path, field): the field of the consistent table that each path of a series belongs to.

    One task holds a series' distinct schemas and renames, not its files or records.
    """
    renames = correspondence_changes(schemas).where("change in ('renamed', 'moved', 'below')").select("suite", "runner", "old_field", "new_field").distinct()
    shapes = schemas.where("size(fields) > 0").select("suite", "runner", "fields").distinct()
    return renames.groupBy("suite", "runner").cogroup(shapes.groupBy("suite", "runner")).applyInPandas(_series_names, "suite string, runner string, path string, field string")


def _value_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for record_id, name, payload in zip(batch["record_id"].tolist(), batch["file_name"].tolist(), batch["payload"].tolist()):
            record = parse_record(payload)
            if record is None:
                continue
            items: dict[str, int] = defaultdict(int)
            stack: list[tuple[str, object]] = [("", record)]
            while stack:
                path, value = stack.pop()
                if isinstance(value, dict):
                    stack.extend((f"{path}.{k}" if path else k, v) for k, v in reversed(value.items()))
                elif isinstance(value, list):
                    stack.extend((path, v) for v in reversed(value))
                elif value is not None:
                    items[path] += 1
                    out.append((record_id, name, path, items[path], kind_of(value), scalar_text(value)))
        yield pd.DataFrame(out, columns=["record_id", "file_name", "path", "item", "kind", "text"])


def consistent_table(raw: DataFrame) -> DataFrame:
    """All valid lines under consistent field names: record_id, file_name, field, item, kind, text, number, flag.

    One row per scalar; `item` is its place among the record's values of that field. Of lines delivered again the lowest
    record_id stays. Names that were renamed or moved along a series are one field of that series. Values are cast to
    number and flag (boolean) where they can be; the text is always kept, so a change of type loses nothing.
    """
    schemas = checkpointed(file_schemas(raw))
    names = consistent_names(schemas)
    series = schemas.select("file_name", "suite", "runner")
    rows = spread(valid_records(raw).select("record_id", "file_name", "payload"))
    flat = rows.mapInPandas(_value_batches, "record_id long, file_name string, path string, item int, kind string, text string")
    of = series.join(names, (series["suite"].eqNullSafe(names["suite"])) & (series["runner"].eqNullSafe(names["runner"]))).select("file_name", "path", "field")
    named = flat.join(of, ["file_name", "path"], "left").withColumn("field", F.coalesce("field", "path")).drop("path")
    return named.select("record_id", "file_name", "field", "item", "kind", "text", F.col("text").try_cast("double").alias("number"), F.col("text").try_cast("boolean").alias("flag"))


def wide_table(table: DataFrame) -> DataFrame:
    """The consistent table with a column for each field: of doubles or booleans where all its values are, else of texts,
    an array where a record has several. The driver gets the fields' names and kinds, no records."""
    kinds = table.groupBy("field").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.max("item").alias("most")).orderBy("field").collect()
    columns = []
    for row in kinds:
        value = F.col({("number",): "number", ("boolean",): "flag"}.get(tuple(row.kinds), "text"))
        mine = F.when(F.col("field") == row.field, F.struct("item", value.alias("v")))
        columns.append((F.transform(F.array_sort(F.collect_list(mine)), lambda x: x["v"]) if row.most > 1 else F.max(mine)["v"]).alias(row.field))
    return table.groupBy("record_id", "file_name").agg(*columns) if columns else table.select("record_id", "file_name").distinct()
