"""Deeply nested records into related flat tables by adjacency-table shredding.

`shred` turns every JSON record into rows of one adjacency table (node, parent, label, ordinal,
scalar). Entity tables are made from it by joining object nodes with their scalar children,
pivoted into columns; the links parent -> child stay as keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.operators.jsontree import kind_of, parse_embedded, parse_record, scalar_text
from codestrata.session import checkpointed, spread

NODE_SCHEMA = (
    "record_id long, node int, parent int, owner int, label string, owner_label string, ordinal int, depth int, kind string, scalar string"
)
_COLUMNS = [part.split()[0] for part in NODE_SCHEMA.split(", ")]


def _walk(record_id: int, record: dict, out: list[tuple]) -> None:
    """Append the record's nodes in document order, without recursion (nesting may be deep)."""
    number = 0
    # (value, parent, owner, label, owner_label, ordinal, depth)
    stack = [(record, None, None, "", "", 0, 0)]
    while stack:
        value, parent, owner, label, owner_label, ordinal, depth = stack.pop()
        node, number = number, number + 1
        kind = kind_of(value)
        inner = value
        if kind == "string":
            inner = parse_embedded(value)
            if inner is not None:
                kind = kind_of(inner)
        out.append((record_id, node, parent, owner, label, owner_label, ordinal, depth, kind, scalar_text(value)))
        if kind == "object":
            for place, (key, child) in reversed(list(enumerate(inner.items(), 1))):
                stack.append((child, node, node, key, label, place, depth + 1))
        elif kind == "array":
            for place, child in reversed(list(enumerate(inner, 1))):
                stack.append((child, node, owner, label, owner_label, place, depth + 1))


def _shred_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out: list[tuple] = []
        for record_id, payload in zip(batch["record_id"].tolist(), batch["payload"].tolist()):
            record = parse_record(payload)
            if record is not None:
                _walk(record_id, record, out)
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=_COLUMNS)
                out = []
        frame = pd.DataFrame(out, columns=_COLUMNS)
        for name in ("parent", "owner"):
            frame[name] = frame[name].astype("Int32")
        yield frame


def _valid_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        good = [parse_record(x) is not None for x in batch["payload"].tolist()]
        yield batch.loc[good, ["record_id", "file_name", "line_no"]]


def valid_records(raw: DataFrame) -> DataFrame:
    """Rows (record_id, file_name, line_no, payload) of valid JSON objects, re-delivered lines once.

    Of valid rows with the same file_name and line_no the lowest record_id stays. A row with a null
    file_name or line_no is its own group. Rows with a null record_id or an invalid payload are left out.
    """
    rows = spread(raw.select("record_id", "file_name", "line_no", "payload").where("record_id is not null and payload is not null"))
    lines = rows.mapInPandas(_valid_batches, "record_id long, file_name string, line_no int")
    own = F.when(F.col("file_name").isNull() | F.col("line_no").isNull(), F.col("record_id"))
    keep = lines.groupBy("file_name", "line_no", own.alias("__own")).agg(F.min("record_id").alias("record_id")).select("record_id")
    return rows.join(keep, "record_id", "left_semi")


def first_deliveries(raw: DataFrame, valid: DataFrame) -> DataFrame:
    """(record_id): of the rows of raw whose record_id is in `valid`, the lowest of each file_name and line_no.

    A row with a null file_name or line_no is its own group. Payloads are not read.
    """
    lines = raw.select("record_id", "file_name", "line_no").join(valid.select("record_id").distinct(), "record_id", "left_semi")
    own = F.when(F.col("file_name").isNull() | F.col("line_no").isNull(), F.col("record_id"))
    return lines.groupBy("file_name", "line_no", own.alias("__own")).agg(F.min("record_id").alias("record_id")).select("record_id")


def valid_nodes(raw: DataFrame) -> DataFrame:
    """The adjacency table of the valid records, re-delivered lines once. Payloads are parsed once, and the table is
    checkpointed, as its entity tables read it several times."""
    rows = spread(raw.select("record_id", "payload").where("record_id is not null and payload is not null"))
    nodes = checkpointed(shred(rows))
    return nodes.join(first_deliveries(raw, nodes.where("node = 0")), "record_id", "left_semi")


def shred(records: DataFrame) -> DataFrame:
    """The adjacency table of records (record_id, payload): one row per JSON value.

    node numbers a record's values from 0 in document order; parent is the containing value, owner the
    nearest enclosing object and owner_label the label that holds it; an array's items keep the array's
    label, ordinal is the place from 1 within the parent. A string that itself holds an object or array
    is a node of that kind with its text as scalar. Invalid payloads give no rows.
    """
    return records.select("record_id", "payload").mapInPandas(_shred_batches, NODE_SCHEMA)


def entities(nodes: DataFrame, scalars: dict[str, str], also: Column | None = None) -> DataFrame:
    """Object nodes joined with their scalar children, pivoted to one column per entry of `scalars`.

    `scalars` maps a child's label to its column's type; `also` names further nodes that get a row of
    their own. Columns: record_id, node, owner, label, owner_label, ordinal, in_array, kind and the
    pivoted ones. An object's row is keyed by itself and a scalar's by its owner, so join and pivot
    are one aggregation over one scan and one shuffle, pre-aggregated before it.
    """
    own_row = F.col("kind") == "object"
    own_row = own_row if also is None else own_row | also
    own = F.struct("owner", "label", "owner_label", "ordinal", (~F.col("parent").eqNullSafe(F.col("owner"))).alias("in_array"), "kind")
    is_scalar = F.col("kind").isin("string", "number", "boolean") & (F.col("parent") == F.col("owner"))
    rows = nodes.where(own_row | (is_scalar & F.col("label").isin(*scalars))).select(
        "record_id",
        F.when(own_row, F.col("node")).otherwise(F.col("owner")).alias("node"),
        F.when(own_row, own).alias("__own"),
        F.when(~own_row, F.col("label")).alias("__label"),
        F.when(~own_row, F.col("scalar")).alias("__scalar"),
    )
    pivoted = [F.max(F.when(F.col("__label") == k, F.col("__scalar"))).try_cast(t).alias(k) for k, t in scalars.items()]
    joined = rows.groupBy("record_id", "node").agg(F.max("__own").alias("__own"), *pivoted)
    return joined.where("__own is not null").select("record_id", "node", "__own.*", *scalars)


def fences(nodes: DataFrame) -> DataFrame:
    """The fence table: record_id, node, file, fence_index and the fence's scalars.

    A fence is an object below `diagrams` with an index; its file is its own or, where fences are
    grouped under a file, that of the object around it. Counts are read under each of their names.
    """
    names = ["nodeCount", "node_count", "nNodes", "nodes"]
    found = entities(nodes, {"file": "string", "index": "int", "checker": "string", "ok": "boolean", **{n: "int" for n in names}})
    groups = found.where("file is not null").select("record_id", F.col("node").alias("owner"), F.col("file").alias("__group_file"))
    joined = found.where("`index` is not null").join(groups, ["record_id", "owner"], "left")
    return joined.where("coalesce(file, __group_file) is not null").select(
        "record_id", "node", F.coalesce("file", "__group_file").alias("file"), F.col("index").alias("fence_index"), "checker", "ok",
        F.coalesce(*names).alias("node_count"),
    )


def _is_cpu_label(label: Column) -> Column:
    return F.lower(label).rlike("^(cpu|processor)")


def problems(nodes: DataFrame, fence_table: DataFrame) -> DataFrame:
    """The problem table, linked to its fence: record_id, fence_node, file, fence_index, item_no, code, line, col."""
    found = entities(nodes, {"code": "string", "line": "int", "col": "int"})
    fence = fence_table.select("record_id", F.col("node").alias("__fence"), "file", "fence_index")
    at = found.where("label = 'at'").select("record_id", F.col("owner").alias("node"), F.col("line").alias("__line"), F.col("col").alias("__col"))
    mine = found.where("code is not null").withColumn("item_no", F.when(F.col("in_array"), F.col("ordinal")).otherwise(1))
    linked = mine.join(fence, (mine["record_id"] == fence["record_id"]) & (mine["owner"] == fence["__fence"])).drop(fence["record_id"])
    return linked.join(at, ["record_id", "node"], "left").select(
        "record_id", F.col("__fence").alias("fence_node"), "file", "fence_index", "item_no", "code",
        F.coalesce("line", "__line").alias("line"), F.coalesce("col", "__col").alias("col"),
    )


def cpus(nodes: DataFrame) -> DataFrame:
    """The CPU table: record_id, item_no, model, speed; a bare string, one object or a list of either."""
    node = nodes.where((F.col("owner_label") == "machine") & _is_cpu_label(F.col("label")) & (F.col("kind") != "array") & (F.col("kind") != "null"))
    in_array = F.col("parent") != F.col("owner")
    items = node.select("record_id", "node", F.when(in_array, F.col("ordinal")).otherwise(1).alias("item_no"), F.when(F.col("kind") != "object", F.col("scalar")).alias("__model"))
    parts = entities(nodes, {"model": "string", "speed": "double"}).select("record_id", "node", "model", "speed")
    return items.join(parts, ["record_id", "node"], "left").select("record_id", "item_no", F.coalesce("model", "__model").alias("model"), "speed")


def nested_children(raw: DataFrame) -> DataFrame:
    """(record_id, child, file, fence_index, item_no): one row per fence, problem and CPU of each valid record.

    The pivoted objects (no texts, a small part of the adjacency table) are checkpointed, so that the
    payloads are parsed once although objects are looked up from their children.
    """
    is_cpu = (F.col("owner_label") == "machine") & _is_cpu_label(F.col("label")) & ~F.col("kind").isin("array", "null")
    rows = spread(raw.select("record_id", "payload").where("record_id is not null and payload is not null"))
    found = entities(shred(rows), {"file": "string", "index": "int", "code": "string"}, also=is_cpu)
    found = checkpointed(found.where(F.expr("node = 0 or file is not null or `index` is not null or code is not null") | is_cpu))
    found = found.join(first_deliveries(raw, found.where("node = 0")), "record_id", "left_semi")
    place = F.when(F.col("in_array"), F.col("ordinal")).otherwise(1).alias("item_no")
    up = found.select("record_id", F.col("node").alias("owner"), F.col("owner").alias("__up"), F.col("file").alias("__up_file"), F.col("index").alias("__up_index"))
    top = found.where("file is not null").select("record_id", F.col("node").alias("__up"), F.col("file").alias("__top_file"))
    around = found.where("`index` is not null or code is not null").join(up, ["record_id", "owner"], "left").join(top, ["record_id", "__up"], "left")
    child = (
        F.when(F.col("index").isNotNull(), F.struct(F.lit("fence").alias("child"), F.coalesce("file", "__up_file").alias("file"), F.col("index").alias("fence_index"), F.lit(0).alias("item_no")))
        .when(F.col("__up_index").isNotNull(), F.struct(F.lit("problem").alias("child"), F.coalesce("__up_file", "__top_file").alias("file"), F.col("__up_index").alias("fence_index"), place))
        .alias("__child")
    )
    inside = around.select("record_id", child).where("__child.file is not null").select("record_id", "__child.*")
    machine = found.where(is_cpu).select("record_id", F.lit("cpu").alias("child"), F.lit("").alias("file"), F.lit(0).alias("fence_index"), place)
    return inside.unionByName(machine).distinct()
