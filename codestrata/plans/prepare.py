"""Queries of the general data-preparation operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators import drift, incremental, shred
from codestrata.session import checkpointed, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.field_changes(table(spark, sf_dir, "bench_raw"))


def p1_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change as flooding matches the fields: also renames of several fields at once, and moves."""
    schemas = checkpointed(drift.file_schemas(table(spark, sf_dir, "bench_raw")))
    return drift.correspondence_changes(schemas).where("change <> 'below'").drop("suite", "runner")


def p1_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.consistent_table(table(spark, sf_dir, "bench_raw"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred.nested_children(table(spark, sf_dir, "bench_raw"))


def p2_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fences of each record, with what is said of them."""
    return shred.fences(shred.valid_nodes(table(spark, sf_dir, "bench_raw"))).drop("node")


def p2_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The problems of each fence, linked to it by record, file and index."""
    nodes = shred.valid_nodes(table(spark, sf_dir, "bench_raw"))
    return shred.problems(nodes, shred.fences(nodes)).drop("fence_node")


def p2_cpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred.cpus(shred.valid_nodes(table(spark, sf_dir, "bench_raw")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.changes_per_run(*[table(spark, sf_dir, n) for n in ("file_changes", "update_runs", "sync_states")])


def p4_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that no successful run has handled yet."""
    changes, runs, states = (table(spark, sf_dir, n) for n in ("file_changes", "update_runs", "sync_states"))
    gaps = incremental.run_gaps(incremental.successful_runs(runs, states))
    processed = incremental.merge_intervals(gaps, ["checkout_id"], bucket=incremental.DAY).withColumn("there", F.lit(True))
    rows = incremental.effective_changes(changes).withColumn("__at", F.unix_micros(F.col("arrived_at").cast("timestamp")))
    found = incremental.in_intervals(rows, processed, ["checkout_id"], "__at", ["there"], incremental.DAY, "__done")
    return found.where("__done is null").select("checkout_id", "change_id", "path")


_P4 = """
with ok as (
  select distinct run_id, checkout_id, started_at from update_runs
  where run_id in (select run_id from sync_states where last_indexed_commit <> '' and tree_clean)
), numbered as (
  select *, row_number() over (partition by checkout_id, path, commit_sha order by arrived_at, change_id) as rn from file_changes
), counting as (
  select *, lag(content_sha) over w as before, row_number() over w as n from numbered where commit_sha is null or rn = 1
  window w as (partition by checkout_id, path order by arrived_at, change_id)
), changed as (
  select * from counting where n = 1 or content_sha is distinct from before
), assigned as (
  select change_id, arg_min(run_id, (started_at, run_id)) as run_id
  from changed join ok using (checkout_id) where started_at > arrived_at group by change_id
)
"""


_P2_BASE = """
with v as (
  select min(record_id) as record_id from bench_raw where json_valid(payload) and json_type(payload) = 'OBJECT' group by file_name, line_no
), r as (
  select record_id, payload::json as j from bench_raw where record_id in (select record_id from v)
), d as (
  select record_id, j -> 'machine' as m, case when json_type(j -> 'diagrams') = 'VARCHAR' then (j ->> 'diagrams')::json else j -> 'diagrams' end as dg from r
), g as (
  select record_id, unnest(case json_type(dg -> 'byFence') when 'OBJECT' then [dg -> 'byFence'] when 'ARRAY' then from_json(dg -> 'byFence', '["json"]') end) as x from d
), h as (
  select record_id, x ->> 'file' as file, unnest(case when json_type(x -> 'fences') = 'ARRAY' then from_json(x -> 'fences', '["json"]') else [x] end) as y from g
), q as (
  select record_id, file, (y ->> 'index')::int as fence_index, case when json_type(y -> 'problems') = 'ARRAY' then from_json(y -> 'problems', '["json"]') else [] end as zs from h
), z as (
  select record_id, file, fence_index, unnest(zs) as z, unnest(range(1, len(zs) + 1))::int as item_no from q
), c as (
  select record_id, unnest([m -> 'cpu', m -> 'cpuModel', m -> 'processor']) as x from d
), u as (
  select record_id, case json_type(x) when 'ARRAY' then from_json(x, '["json"]') else [x] end as xs from c where x is not null and json_type(x) <> 'NULL'
), w as (
  select record_id, unnest(xs) as x, unnest(range(1, len(xs) + 1))::int as item_no from u
)
"""
_P2_FENCES = _P2_BASE + """
select record_id, file, (y ->> 'index')::int as fence_index, y ->> 'checker' as checker, (y ->> 'ok')::boolean as ok,
  coalesce(y ->> 'nodeCount', y ->> 'node_count', y ->> 'nNodes', y ->> 'nodes')::int as node_count from h
"""
_P2_PROBLEMS = _P2_BASE + """
select record_id, file, fence_index, item_no, z ->> 'code' as code, coalesce(z ->> 'line', z -> 'at' ->> 'line')::int as line, coalesce(z ->> 'col', z -> 'at' ->> 'col')::int as col from z
"""
_P2_CPUS = _P2_BASE + """
select record_id, item_no, case when json_type(x) = 'OBJECT' then x ->> 'model' else x ->> '$' end as model, case when json_type(x) = 'OBJECT' then try_cast(x ->> 'speed' as double) end as speed from w
"""
_P2 = _P2_BASE + """, p as (select record_id, file, fence_index, len(zs)::int as n from q), k as (select record_id, len(xs)::int as n from u)
select record_id, 'fence' as child, file, fence_index, 0 as item_no from p
union all select record_id, 'problem', file, fence_index, unnest(range(1, n + 1))::int from p
union all select record_id, 'cpu', '', 0, unnest(range(1, n + 1))::int from k
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_matches, p1_consistent, p2_found, p2_fences, p2_problems, p2_cpus, p4_found, p4_pending)}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _P2,
        "p2_fences": _P2_FENCES,
        "p2_problems": _P2_PROBLEMS,
        "p2_cpus": _P2_CPUS,
        "p4_found": _P4 + "select run_id, change_id from assigned",
        "p4_pending": _P4 + "select checkout_id, change_id, path from changed where change_id not in (select change_id from assigned)",
    }
