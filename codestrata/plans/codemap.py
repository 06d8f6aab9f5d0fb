"""Queries over the code map (files, symbols, imports, builds), each with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import ids
from codestrata.operators import answers, compare, graph, link, resolve
from codestrata.session import table

_PACKAGE = r"^((?:packages|apps|services)/[^/]+)/"
EXCLUDES = ["**/vendor/**", "node_modules/**", "**/*.min.js", "third_party/**", "**/dist/**"]
TARGETS_SQL = "select repo, min(to_id) as target from imports where to_id like '%.%' and to_id not like 'ext:%' and to_id not like 'unresolved:%' group by repo"


class Map:
    """The tables of a directory as the operators read them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.files = table(spark, sf_dir, "files")
        self.symbols = table(spark, sf_dir, "symbols")
        self.raw_imports = table(spark, sf_dir, "imports")
        # the newest scan of each path
        self.current = self.files.groupBy("repo", "path").agg(F.max_by(F.coalesce("loc", F.lit(0)).cast("long"), "file_id").alias("loc"))
        self.paths = self.current.select("repo", "path")
        owner = F.regexp_extract("path", _PACKAGE, 1)
        self.packages = self.paths.select("repo", F.when(owner == "", ".").otherwise(owner).alias("dir")).distinct().select("repo", "dir", F.when(F.col("dir") == ".", "root").otherwise(F.col("dir")).alias("pkg"))
        self.imports = self.raw_imports.groupBy("repo", "from_path", "to_id", "kind", "import_kind", F.array_join("symbols", ",").alias("names")).agg(F.min("specifier").alias("specifier"))

    def pairs(self) -> DataFrame:
        return graph.expand_targets(self.imports, self.paths)


_BASE = """
with f as (select repo, path, arg_max(coalesce(loc, 0), file_id) as loc from files group by repo, path),
d as (select repo, path, loc, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '.' end as dir from f),
k as (select repo, path, path as id from d union select repo, path, dir from d),
i as (select repo, from_path, to_id, kind, import_kind, array_to_string(symbols, ',') as names, min(specifier) as specifier from imports group by all),
e as (select i.repo, i.from_path as src, k.path as dst from i join k on k.repo = i.repo and k.id = i.to_id
      join f on f.repo = i.repo and f.path = i.from_path where i.kind in ('import', 'reexport') and i.from_path <> k.path),
u as (select i.repo, i.from_path as src, i.to_id as dst from i join f on f.repo = i.repo and f.path = i.from_path
      where i.kind in ('import', 'reexport') and i.from_path <> i.to_id and (i.repo, i.to_id) in (select repo, id from k)),
o as (select repo, path, loc, case when regexp_matches(path, '^(packages|apps|services)/[^/]+/') then regexp_extract(path, '^((packages|apps|services)/[^/]+)/', 1) else 'root' end as pkg from f)
"""
_CLOSURE = _BASE.replace("with f as", "with recursive f as") + ", c as (select repo, src, dst from e union select c.repo, c.src, e.dst from c join e on e.repo = c.repo and e.src = c.dst)"

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(sql: str | None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = (f, sql)
        return f

    return register


@_query(
    """select file_id, case when regexp_extract(path, '[^/]+(\\.[^./]*)$', 1) = '.py' then 'python' when regexp_extract(path, '[^/]+(\\.[^./]*)$', 1) = '.rs' then 'rust'
    when regexp_extract(path, '[^/]+(\\.[^./]*)$', 1) = '.tf' then 'hcl' else nullif(substr(regexp_extract(path, '[^/]+(\\.[^./]*)$', 1), 2), '') end as lang, not contains(path, '#') as mappable from files"""
)
def map_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every file's path, and whether the path can be an id."""
    return Map(spark, sf_dir).files.select("file_id", ids.lang_of(F.col("path")).alias("lang"), ids.is_mappable(F.col("path")).alias("mappable"))


@_query(
    """select file_id, case when source = '' then 0 else length(source) - length(replace(source, chr(10), '')) + case when source like '%' || chr(10) then 0 else 1 end end as loc, sha256(source) as sha
    from files where source is not null"""
)
def map_loc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and content hash of every source, counted anew."""
    rows = Map(spark, sf_dir).files.where("source is not null")
    return rows.select("file_id", ids.count_loc(F.col("source")).cast("long").alias("loc"), ids.sha256_hex(F.encode("source", "UTF-8")).alias("sha"))


@_query("select sha, n from (select sha256(source) as sha, count(distinct (repo, path)) as n from files where source is not null group by 1) where n > 1")
def map_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that several paths share: parsed once, stamped many times."""
    rows = Map(spark, sf_dir).files.where("source is not null").select(F.sha2(F.encode("source", "UTF-8"), 256).alias("sha"), "repo", "path").distinct()
    return rows.groupBy("sha").agg(F.count("*").alias("n")).where("n > 1")


@_query(
    "select repo, \"from\", \"to\", kind, import_kind, names, specifier from (select repo, from_path as \"from\", to_id as \"to\", kind, import_kind, array_to_string(symbols, ',') as names, min(specifier) as specifier "
    "from imports where from_path is distinct from to_id group by all)"
)
def map_link_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import edges once per (from, to, kind, symbols, import kind), with the least specifier; self-edges dropped."""
    return Map(spark, sf_dir).imports.where(~F.col("from_path").eqNullSafe(F.col("to_id"))).withColumnsRenamed({"from_path": "from", "to_id": "to"})


@_query(
    _BASE
    + """select f.repo, f.path, coalesce(a.n, 0) as fan_in, coalesce(b.n, 0) as fan_out from f
    left join (select repo, dst, count(distinct src) as n from e group by all) a on a.repo = f.repo and a.dst = f.path
    left join (select repo, src, count(distinct dst) as n from u group by all) b on b.repo = f.repo and b.src = f.path"""
)
def map_fan(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Map(spark, sf_dir)
    return graph.fan_metrics(m.imports, m.paths)


@_query(
    _BASE
    + """select f.repo, f.path, coalesce(a.n, 0) as fan_in from f left join (select repo, dst, count(distinct src) as n from e group by all) a on a.repo = f.repo and a.dst = f.path
    order by fan_in desc, repo, path limit 20"""
)
def map_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files most others import: a top-k report."""
    m = Map(spark, sf_dir)
    return graph.top_k(graph.fan_metrics(m.imports, m.paths).drop("fan_out"), "fan_in", 20, ["repo", "path"])


@_query(
    _CLOSURE + "select f.repo, f.path as node, coalesce(n, 0) as blast from f left join (select repo, dst, count(*) as n from c where src <> dst group by all) b on b.repo = f.repo and b.dst = f.path"
)
def map_blast(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Map(spark, sf_dir)
    return graph.blast_radius(m.pairs(), m.paths.toDF("repo", "node"))


@_query(_CLOSURE + "select a.repo, a.src as node, min(a.dst) as component from c a join c b on b.repo = a.repo and b.src = a.dst and b.dst = a.src where a.src <> a.dst or true group by a.repo, a.src having count(distinct a.dst) > 1")
def map_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files on import cycles, with the least file of their cycle."""
    return graph.components(Map(spark, sf_dir).pairs())


@_query(
    _CLOSURE
    + """, s as (select a.repo, a.src as node, min(a.dst) as component from c a join c b on b.repo = a.repo and b.src = a.dst and b.dst = a.src group by a.repo, a.src having count(distinct a.dst) > 1)
    select repo, component, count(*) as size, string_agg(node, ' → ' order by node) || ' → ' || min(node) as line from s group by repo, component"""
)
def map_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.cycles(Map(spark, sf_dir).pairs())
    return found.withColumn("size", F.col("size").cast("long"))


_REACHED = """, b(repo, target, node, depth) using key (repo, target, node) as (select repo, target, target, 0 from t union
    select b.repo, b.target, e.src, b.depth + 1 from b join e on e.repo = b.repo and e.dst = b.node left join recurring.b r on r.repo = b.repo and r.target = b.target and r.node = e.src where r.depth is null or r.depth > b.depth + 1)
    select repo, target, node, depth from b where depth > 0"""


@_query(_BASE.replace("with f as", "with recursive f as") + f", t as ({TARGETS_SQL})" + _REACHED)
def map_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is affected, and how far away, by the first imported file of each repository."""
    m = Map(spark, sf_dir)
    file_like = (F.instr("to_id", ".") > 0) & ids.is_file_id(F.col("to_id"))
    targets = m.raw_imports.where(file_like).groupBy("repo").agg(F.min("to_id").alias("target"))
    return graph.impact(m.pairs(), targets).withColumn("depth", F.col("depth").cast("long"))


@_query(_BASE.replace("with f as", "with recursive f as") + ", t as (select distinct repo, dst as target from e)" + _REACHED)
def map_impact_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is affected, and how far away, by every imported file."""
    pairs = Map(spark, sf_dir).pairs()
    return graph.impact(pairs, pairs.select("repo", F.col("dst").alias("target"))).withColumn("depth", F.col("depth").cast("long"))


@_query(
    _BASE
    + """, l as (select a.repo, a.pkg as from_pkg, coalesce(b.pkg, g.pkg) as to_pkg from u join o a on a.repo = u.repo and a.path = u.src left join o b on b.repo = u.repo and b.path = u.dst
    left join (select distinct repo, dir, case when regexp_matches(dir || '/', '^(packages|apps|services)/[^/]+/') then regexp_extract(dir || '/', '^((packages|apps|services)/[^/]+)/', 1) else 'root' end as pkg from d) g
    on g.repo = u.repo and g.dir = u.dst)
    select repo, from_pkg, to_pkg, count(*) as n from l where from_pkg <> to_pkg group by all"""
)
def map_package_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Map(spark, sf_dir)
    return resolve.package_edges(m.paths, m.packages, graph.counted_targets(m.imports, m.paths))


_PACKAGE_EDGES = """, l as (select a.repo, a.pkg as from_pkg, coalesce(b.pkg, g.pkg) as to_pkg from u join o a on a.repo = u.repo and a.path = u.src left join o b on b.repo = u.repo and b.path = u.dst
    left join (select distinct repo, dir, case when regexp_matches(dir || '/', '^(packages|apps|services)/[^/]+/') then regexp_extract(dir || '/', '^((packages|apps|services)/[^/]+)/', 1) else 'root' end as pkg from d) g
    on g.repo = u.repo and g.dir = u.dst), pe as (select distinct repo, from_pkg, to_pkg from l where from_pkg <> to_pkg)"""


@_query(
    _BASE
    + _PACKAGE_EDGES
    + """, n as (select repo, pkg, count(*) as files, sum(loc)::bigint as loc from o group by all union all select distinct repo, 'none', 0, 0 from f)
    select n.repo, n.pkg, n.files, n.loc, coalesce((select string_agg(to_pkg, ',' order by to_pkg) from pe where pe.repo = n.repo and pe.from_pkg = n.pkg), '') as deps,
    coalesce((select string_agg(from_pkg, ',' order by from_pkg) from pe where pe.repo = n.repo and pe.to_pkg = n.pkg), '') as rdeps from n"""
)
def map_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages with sizes and dependencies; a package without files (one is added to each repository) keeps zeros."""
    m = Map(spark, sf_dir)
    packages = m.packages.unionByName(m.paths.select("repo").distinct().select("repo", F.lit("no/such/dir").alias("dir"), F.lit("none").alias("pkg")))
    return resolve.package_metrics(m.current, packages, graph.counted_targets(m.imports, m.paths))


@_query(_BASE + "select repo, pkg, sum(loc)::bigint as loc from o group by all order by loc desc, repo, pkg limit 10")
def map_top_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten packages with most lines: a top-k report."""
    m = Map(spark, sf_dir)
    sizes = resolve.package_metrics(m.current, m.packages, graph.counted_targets(m.imports, m.paths)).select("repo", "pkg", "loc")
    return graph.top_k(sizes, "loc", 10, ["repo", "pkg"])


@_query(
    _BASE.replace("with f as", "with recursive f as")
    + _PACKAGE_EDGES
    + """, c as (select repo, from_pkg as src, to_pkg as dst from pe union select c.repo, c.src, pe.to_pkg from c join pe on pe.repo = c.repo and pe.from_pkg = c.dst),
    s as (select a.repo, a.src as node, min(a.dst) as component from c a join c b on b.repo = a.repo and b.src = a.dst and b.dst = a.src group by a.repo, a.src)
    select repo, component, count(*) as size, string_agg(node, ' → ' order by node) || ' → ' || min(node) as line from s group by repo, component"""
)
def map_package_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Map(spark, sf_dir)
    edges = resolve.package_edges(m.paths, m.packages, graph.counted_targets(m.imports, m.paths))
    return graph.package_cycles(edges).withColumn("size", F.col("size").cast("long"))


@_query(
    _BASE
    + """, t as (select repo, path, unnest(range(0, len(string_split(path, '/')))) as n from f), a as (select repo, path, case when n = 0 then '.' else array_to_string(string_split(path, '/')[1:n], '/') end as dir from t)
    select repo, dir, count(*) as files from a group by all"""
)
def map_files_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files lie below each directory."""
    return answers.files_under(Map(spark, sf_dir).paths).groupBy("repo", "dir").agg(F.count("*").alias("files"))


@_query(
    """select repo, file, row_number() over (partition by repo, file order by start_line, end_line, id) as place, id, kind from (select distinct repo, file, id, kind, span.start_line as start_line, span.end_line as end_line from symbols
    where kind in ('resource','data','variable','output','provider','module','local','job','step','stage','image','component','route','handler','task')
    and regexp_matches(id, '^[^#]*#(resource|data|variable|output|provider|module|local|job|step|stage|image|component|route|handler|task)\\..+$'))"""
)
def map_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes inside each file, in order of their spans."""
    return answers.nodes_of(Map(spark, sf_dir).symbols).withColumn("place", F.col("place").cast("long"))


_VERDICT_EXCLUDES = ["**/api/**", *EXCLUDES]


@_query(
    """with p as (select distinct repo, path from files), b as (select repo, path, case when regexp_matches(path, '^(.*/)?api/.*$') then '**/api/**' when regexp_matches(path, '^(.*/)?vendor/.*$') then '**/vendor/**' when regexp_matches(path, '^node_modules/.*$') then 'node_modules/**'
      when regexp_matches(path, '^(.*/)?[^/]*\\.min\\.js$') then '**/*.min.js' when regexp_matches(path, '^third_party/.*$') then 'third_party/**' when regexp_matches(path, '^(.*/)?dist/.*$') then '**/dist/**' end as pattern from p),
    t as (select *, unnest(range(0, len(string_split(path, '/')))) as n from b), a as (select repo, path, pattern, case when n = 0 then '.' else array_to_string(string_split(path, '/')[1:n], '/') end as dir from t),
    g as (select repo, dir, count(*) filter (pattern is null and path in (select file from symbols s where s.repo = a.repo)) as found, count(*) filter (pattern is null) as could, arg_min(pattern, path) filter (pattern is not null) as first_one from a group by all)
    select repo, dir, case when found > 0 then 'found' when could > 0 then 'stale' else 'excluded' end as status, case when found = 0 and could = 0 then coalesce(first_one, 'languages') end as excluded_by from g"""
)
def map_directory_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories of the tree against a map of the files that have symbols, where everything below `api` is kept out."""
    m = Map(spark, sf_dir)
    outside = resolve.excluding(F.col("path"), _VERDICT_EXCLUDES).isNull()
    mapped = m.symbols.select("repo", F.col("file").alias("path")).distinct().join(m.paths, ["repo", "path"], "left_semi").where(outside)
    return answers.directory_verdicts(m.paths, mapped, _VERDICT_EXCLUDES)


@_query(
    _CLOSURE
    + """, r as (select c.repo, c.src as path, count(*) as reach from c where src <> dst group by all)
    select * from (select o.repo, o.pkg, o.path, r.reach, row_number() over (partition by o.repo, o.pkg order by r.reach desc, o.path) as place from o join r on r.repo = o.repo and r.path = o.path
    where (o.repo, o.path) not in (select repo, dst from e)) where place <= 5"""
)
def map_entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files nobody imports, the five of each package that reach most."""
    m = Map(spark, sf_dir)
    found = graph.entry_points(m.imports, m.paths, resolve.package_of(m.paths, m.packages))
    return found.withColumn("place", F.col("place").cast("long"))


@_query(_BASE + "select distinct k.repo, k.path, i.from_path as importer from k join i on i.repo = k.repo and i.to_id = k.id where i.kind in ('import', 'reexport') and i.from_path <> k.path")
def map_importers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Map(spark, sf_dir)
    return resolve.importers_of(m.imports, m.paths)


@_query(
    """with s as (select distinct repo, id, file, name, case when contains(file, '/') then regexp_replace(file, '/[^/]*$', '') else '.' end as dir from symbols where exported),
    w as (select distinct repo, to_id, from_path, unnest(symbols) as taken from imports where kind in ('import', 'reexport'))
    select distinct s.repo, s.id, w.from_path as importer from s join w on w.repo = s.repo and ((w.to_id = s.file and w.taken in (s.name, '*')) or (w.to_id = s.dir and w.taken = '*')) where w.from_path <> s.file"""
)
def map_symbol_importers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Map(spark, sf_dir)
    return resolve.symbol_importers(m.raw_imports, m.symbols)


@_query(
    """with n as (select distinct regexp_extract(name, '[^.]+$') as needle from symbols where kind = 'method'),
    h as (select n.needle, case when s.id = n.needle then 1 when s.name = n.needle then 2 else 3 end as tier, s.repo, s.id from n join symbols s on s.name = n.needle or s.name like '%.' || n.needle or s.id = n.needle
      where s.name = n.needle or s.id = n.needle or right(s.name, length(n.needle) + 1) = '.' || n.needle)
    select distinct h.needle, h.tier, h.repo, h.id from h join (select needle, min(tier) as tier from h group by all) b using (needle, tier)"""
)
def map_find_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every method's bare name looked up in three tiers."""
    m = Map(spark, sf_dir)
    needles = m.symbols.where("kind = 'method'").select(F.regexp_extract("name", "[^.]+$", 0).alias("needle"))
    return resolve.find_symbols(m.symbols, needles)


@_query(
    """select repo, file, name, kind from (select *, row_number() over (partition by repo, file, name order by span.start_line, id, kind) as rn from symbols
    where parent is null and kind <> 'method' and not (kind in ('resource','data','variable','output','provider','module','local','job','step','stage','image','component','route','handler','task')
    and regexp_matches(id, '#(resource|data|variable|output|provider|module|local|job|step|stage|image|component|route|handler|task)\\..+$'))) where rn = 1"""
)
def map_top_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-level declarations: no parent, no method, no node; the first of a name wins."""
    rows = Map(spark, sf_dir).symbols.where("parent is null and kind <> 'method'").where(~ids.is_node(F.col("kind"), F.col("id")))
    return rows.groupBy("repo", "file", "name").agg(F.min_by("kind", F.struct("span.start_line", "id", "kind")).alias("kind"))


@_query("select repo, id, n, id || case when n = 1 then '' else '~' || n end as unique_id from (select repo, id, row_number() over (partition by repo, id order by span.start_line, span.end_line, signature nulls first, kind) as n from symbols)")
def map_disambiguate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated ids take ~2, ~3 in order of their spans."""
    rows = Map(spark, sf_dir).symbols.select("repo", "id", "span.start_line", "span.end_line", "signature", "kind")
    found = resolve.disambiguate(rows, ["repo"], "id", ["start_line", "end_line", "signature", "kind"], "unique_id")
    place = F.when(F.col("unique_id") == F.col("id"), 1).otherwise(F.regexp_extract("unique_id", r"~(\d+)$", 1).cast("long"))
    return found.select("repo", "id", place.alias("n"), "unique_id")


@_query(
    """with p as (select distinct repo, path from files), x as (select repo, path, array_to_string(string_split(path, '/')[n:], '/') as token from p, range(1, 40) t(n) where n <= length(string_split(path, '/')))
    select repo, token, min(path) as path from x where token not like '%/%' group by repo, token having count(*) = 1 or bool_or(path = token)"""
)
def map_unique_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names that stand for exactly one path of their repository."""
    m = Map(spark, sf_dir)
    return resolve.by_unique_suffix(m.paths.select("repo", ids.base_name(F.col("path")).alias("token")), m.paths)


@_query(
    """with c as (select distinct repo, specifier, from_path, unnest([1, 2, 3, 4, 5]) as place from imports where specifier like './%' or specifier like '../%'),
    p as (select distinct repo, path from files), q as (select *, len(string_split(from_path, '/')) - 1 as depth, (length(specifier) - length(replace(specifier, '../', ''))) // 3 as ups,
      regexp_replace(specifier, '^(\\.\\.?/)+', '') as rest from c),
    r as (select repo, from_path, specifier, place, case when ups > depth then null else array_to_string(list_concat(string_split(from_path, '/')[1:depth - ups], [rest]), '/') end as base from q),
    s as (select repo, from_path, specifier, place, base || case place when 1 then '' when 2 then '.ts' when 3 then '.tsx' when 4 then '.js' else '/index.ts' end as path from r)
    select s.repo, s.from_path, s.specifier, arg_min(s.path, place) as path from s join p on p.repo = s.repo and p.path = s.path group by all"""
)
def map_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative specifiers to files: the first existing candidate wins."""
    m = Map(spark, sf_dir)
    relative = m.raw_imports.where("specifier like './%' or specifier like '../%'").select("repo", "from_path", "specifier").distinct()
    base = ids.normal_join(ids.directory_of(F.col("from_path")), F.col("specifier"))
    tried = relative.withColumn("candidates", F.transform(F.array(*[F.lit(x) for x in ("", ".ts", ".tsx", ".js", "/index.ts")]), lambda end: F.concat(base, end)))
    return resolve.probe(tried, m.paths, ["from_path", "specifier"])


@_query(
    """with o as (select module_path as pkg, min(repo) || '-mirror' as to_repo from go_contexts where module_path is not null group by module_path having count(distinct repo) = 1),
    s as (select distinct repo, from_path, specifier from imports where to_id like 'ext:%' or to_id like 'unresolved:%'),
    h as (select s.repo as from_repo, s.from_path, s.specifier, o.to_repo, o.pkg as to_pkg from s join o on s.specifier = o.pkg or starts_with(s.specifier, o.pkg || '/') where o.to_repo <> s.repo)
    select from_repo, from_path, arg_max(to_repo, length(to_pkg)) as to_repo, arg_max(to_pkg, length(to_pkg)) as to_pkg, specifier from h group by from_repo, from_path, specifier"""
)
def map_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports that a repository cannot resolve itself but its mirror, which publishes the same modules, answers."""
    m = Map(spark, sf_dir)
    published = table(spark, sf_dir, "go_contexts").where("module_path is not null").select(F.concat("repo", F.lit("-mirror")).alias("repo"), F.col("module_path").alias("pkg")).distinct()
    return resolve.cross_edges(m.raw_imports, published)


@_query(
    "with p as (select distinct repo, path from files) select repo, path, case "
    "when regexp_matches(path, '^(.*/)?vendor/.*$') then '**/vendor/**' when regexp_matches(path, '^node_modules/.*$') then 'node_modules/**' when regexp_matches(path, '^(.*/)?[^/]*\\.min\\.js$') then '**/*.min.js' "
    "when regexp_matches(path, '^third_party/.*$') then 'third_party/**' when regexp_matches(path, '^(.*/)?dist/.*$') then '**/dist/**' end as pattern from p"
)
def map_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a path is left out: the first of the exclude globs that matches."""
    return Map(spark, sf_dir).paths.select("repo", "path", resolve.excluding(F.col("path"), EXCLUDES).alias("pattern"))


_TREE = "(select repo, path, arg_max(coalesce(content_sha, ''), (arrived_at, change_id)) as sha from file_changes group by all)"


def _map_and_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(repo, path, sha) of the newest scans (the map) and of the newest queued contents (the tree, without deletions)."""
    files, changes = Map(spark, sf_dir).files, table(spark, sf_dir, "file_changes")
    old = files.groupBy("repo", "path").agg(F.max_by(F.coalesce("sha256", F.lit("")), "file_id").alias("sha"))
    new = changes.groupBy("repo", "path").agg(F.max_by(F.coalesce("content_sha", F.lit("")), F.struct("arrived_at", "change_id")).alias("sha"))
    return old, new.where("sha <> ''")


_MAP_AND_TREE = f"with o as (select repo, path, arg_max(coalesce(sha256, ''), file_id) as sha from files group by all), n as (select * from {_TREE} where sha <> '')"


@_query(
    _MAP_AND_TREE
    + """ select coalesce(o.repo, n.repo) as repo, coalesce(o.path, n.path) as path, case when n.repo is null then 'missing' when o.repo is null then 'extra' else 'changed' end as state
    from o full join n on o.repo = n.repo and o.path = n.path where o.sha is distinct from n.sha"""
)
def map_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest scans against the newest queued contents: what is missing, extra or changed."""
    return compare.verify(*_map_and_tree(spark, sf_dir), ["repo", "path"], "sha")


@_query(
    _BASE
    + """, t as (select distinct repo, src, dst from e), p as (select distinct repo, from_path as src, to_id as dst from imports where confidence = 'high'),
    n as (select (select count(*) from p join t using (repo, src, dst)) as tp, (select count(*) from p) as np, (select count(*) from t) as nt)
    select tp, np - tp as fp, nt - tp as fn, round(tp / np, 6) as precision, round(tp / nt, 6) as recall, round(2 * (tp / np) * (tp / nt) / (tp / np + tp / nt), 6) as f1 from n"""
)
def map_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of high confidence against the resolved file pairs: precision, recall and F1."""
    m = Map(spark, sf_dir)
    predicted = m.raw_imports.where("confidence = 'high'").select("repo", F.col("from_path").alias("src"), F.col("to_id").alias("dst"))
    found = compare.score_sets(predicted, m.pairs(), ["repo", "src", "dst"])
    return found.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@_query(
    """select mode, count(*) as n, round(avg(ms), 6) as mean, round(stddev_pop(ms), 6) as std, min(ms) as least, max(ms) as most, round(median(ms), 6) as median, quantile_disc(ms, 0.5) as p50, quantile_disc(ms, 0.95) as p95
    from (select distinct * from update_runs) where ms is not null group by mode"""
)
def map_run_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of update runs by mode: mean, spread, nearest-rank percentiles."""
    runs = table(spark, sf_dir, "update_runs").distinct()
    found = compare.summarize(runs, ["mode"], "ms")
    whole = {c: F.col(c).cast("int").alias(c) for c in ("p50", "p95")}
    return found.select("mode", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "least", "most", F.round("median", 6).alias("median"), *whole.values())


@_query(
    """with d as (select distinct repo, build_id, warnings, skipped from build_results) select repo, count(*) as builds, sum(coalesce(length(skipped), 0))::bigint as skipped, sum(coalesce(length(warnings), 0))::bigint as warnings from d group by repo"""
)
def map_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builds per repository, exact repeats once, with what they skipped and warned about."""
    rows = table(spark, sf_dir, "build_results").select("repo", "build_id", "warnings", "skipped").distinct()
    length = lambda c: F.sum(F.when(F.col(c).isNull(), 0).otherwise(F.size(c))).cast("long").alias(c)
    return rows.groupBy("repo").agg(F.count("*").alias("builds"), length("skipped"), length("warnings"))


@_query(
    _CLOSURE
    + """, b as (select repo, dst, count(*) as n from c where src <> dst group by all), x as (select repo, file, string_agg(distinct name, ',' order by name) as exports from symbols where exported group by all),
    n as (select repo, file, count(distinct name) as declared from symbols group by all)
    select o.repo, o.path, o.pkg, o.loc, coalesce(i1.n, 0) as fan_in, coalesce(u1.n, 0) as fan_out, coalesce(b.n, 0) as blast, coalesce(x.exports, '') as exports, coalesce(n.declared, 0) as declared from o
    left join (select repo, dst, count(distinct src) as n from e group by all) i1 on i1.repo = o.repo and i1.dst = o.path left join (select repo, src, count(distinct dst) as n from u group by all) u1 on u1.repo = o.repo and u1.src = o.path
    left join b on b.repo = o.repo and b.dst = o.path left join x on x.repo = o.repo and x.file = o.path left join n on n.repo = o.repo and n.file = o.path"""
)
def map_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each file, in one row."""
    m = Map(spark, sf_dir)
    return answers.describe_files(m.current, m.imports, m.symbols, m.packages).drop("lang")


@_query(
    _MAP_AND_TREE
    + """, a as (select repo, path from o union select repo, path from n union select repo, 'no/such/' || path from o)
    select a.repo, a.path, case when n.sha is null then 'absent' when o.sha is null then 'unmapped' when o.sha <> n.sha then 'stale' else 'found' end as status
    from a left join o on o.repo = a.repo and o.path = a.path left join n on n.repo = a.repo and n.path = a.path"""
)
def map_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned, queued and unknown paths: what the map knows of them, given the queued contents as the tree."""
    old, new = ((df.withColumnRenamed("sha", "sha256")) for df in _map_and_tree(spark, sf_dir))
    asked = old.select("repo", "path").unionByName(new.select("repo", "path")).unionByName(old.select("repo", F.concat(F.lit("no/such/"), "path").alias("path")))
    return answers.status_of(asked, old, new, [])


@_query("select repo, lang, count(*) as n, sum(coalesce(loc, 0))::bigint as loc from files group by all")
def map_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Map(spark, sf_dir).files.groupBy("repo", "lang").agg(F.count("*").alias("n"), F.sum(F.coalesce("loc", F.lit(0))).alias("loc"))


@_query("select repo, regexp_extract(to_id, '^ext:(.*)$', 1) as external, count(distinct from_path) as users from imports where to_id like 'ext:%' group by all")
def map_externals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External packages per repository and how many files use each."""
    rows = Map(spark, sf_dir).raw_imports.where("to_id like 'ext:%'")
    return rows.groupBy("repo", F.regexp_replace("to_id", "^ext:", "").alias("external")).agg(F.countDistinct("from_path").alias("users"))


@_query(
    _BASE
    + """, n as (select distinct repo, file, id from symbols where kind in ('resource','data','variable','output','provider','module','local','job','step','stage','image','component','route','handler','task')
    and regexp_matches(id, '^[^#]*#(resource|data|variable|output|provider|module|local|job|step|stage|image|component|route|handler|task)\\..+$'))
    select o.repo, o.pkg, count(n.id) as nodes from o left join n on n.repo = o.repo and n.file = o.path group by all"""
)
def map_node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes the files of each package hold."""
    m = Map(spark, sf_dir)
    return answers.node_counts(m.symbols, resolve.package_of(m.paths, m.packages))


@_query(
    """select distinct repo, case when path like '%.py' then 'python' when path like '%.java' then 'java' when path like '%.tf' then 'hcl' end as lang from files where path like '%.py' or path like '%.java' or path like '%.tf'"""
)
def map_marked_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages that marker files and telling endings show, by repository."""
    return answers.marked_languages(Map(spark, sf_dir).paths)


@_query(
    """with o as (select repo, path, arg_max(coalesce(sha256, ''), file_id) as sha from files group by all) select 1 as one, count(*) as files from o"""
)
def map_drift_caught(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files whose state verify tells as it was injected, or rightly does not tell: every file there is."""
    files = Map(spark, sf_dir).files
    old = files.groupBy("repo", "path").agg(F.max_by(F.coalesce("sha256", F.lit("")), "file_id").alias("sha"))
    drifted = compare.inject_drift(old, ["path", "repo"], "sha", 5)
    told = compare.verify(old, drifted.where("injected is null or injected <> 'missing'"), ["repo", "path"], "sha")
    want = drifted.where("injected is not null").select("repo", "path", F.col("injected").alias("__w"))
    both = told.join(want, ["repo", "path"], "full_outer")
    wrong = both.where(~F.col("state").eqNullSafe(F.col("__w"))).select(F.lit(-1).cast("long").alias("n"))
    return old.select(F.lit(1).cast("long").alias("n")).unionByName(wrong).agg(F.sum("n").alias("files")).select(F.lit(1).alias("one"), "files")


@_query(
    """with d as (select repo, file, name, min(kind) as kind, min(parent) as parent from symbols group by all), g as (select *, file like '%.go' as go, case when contains(file, '/') then regexp_replace(file, '/[^/]*$', '') else '.' end as dir from d),
    site as (select repo, file, dir, go, name as caller, regexp_extract(name, '[^.]*$') as bare, kind, regexp_replace(name, '\\.[^.]*$', '') as cls from g where kind in ('function', 'method')),
    pk as (select repo, dir, name, count(distinct file) as n, min(file) as one, list(distinct file) as files from g where go and kind = 'function' and parent is null group by all),
    firsts as (select repo, dir, min(name) as name from pk group by all),
    a as (select s.repo, s.file, s.caller, s.file as target_file, s.caller as target from site s where not go and kind = 'function' and contains(s.caller, '.') = false
      union select s.repo, s.file, s.caller, s.file, s.cls || '.' || s.bare from site s where not go and kind = 'method' and contains(s.caller, '.')
      union select s.repo, s.file, s.caller, case when p.n = 1 then p.one when list_contains(p.files, s.file) then s.file end, p.name from site s join firsts f on f.repo = s.repo and f.dir = s.dir join pk p on p.repo = f.repo and p.dir = f.dir and p.name = f.name where go)
    select distinct a.repo, a.file || '#' || a.caller as "from", a.target_file || '#' || a.target as "to", 'high' as confidence, 1 as line from a where a.target_file is not null
      and exists (select 1 from d where d.repo = a.repo and d.file = a.target_file and d.name = a.target and d.kind not in ('interface', 'type') and (d.kind = 'method' or d.parent is null))"""
)
def map_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call edges of made-up call sites over the real symbols: functions call themselves, methods themselves through
    `this`, and Go functions and methods the first function of their package."""
    m = Map(spark, sf_dir)
    none = F.lit(None)
    decl = m.symbols.select("repo", "file", F.lit("decl").alias("fact"), "name", "kind", "parent", "signature", none.cast("string").alias("extends"), none.cast("string").alias("caller"), none.cast("string").alias("callee"), none.cast("int").alias("line"))
    go = F.col("file").like("%.go")
    sites = m.symbols.where("kind in ('function', 'method')").select("repo", "file", ids.directory_of(F.col("file")).alias("dir"), "name", "kind").distinct()
    firsts = m.symbols.where(go & (F.col("kind") == "function") & F.col("parent").isNull()).groupBy("repo", ids.directory_of(F.col("file")).alias("dir")).agg(F.min("name").alias("callee"))
    bare = F.regexp_extract("name", "[^.]*$", 0)
    own = sites.where(~go).select("repo", "file", "name", F.when(F.col("kind") == "method", F.concat(F.lit("this."), bare)).otherwise(bare).alias("callee"))
    calls = own.unionByName(sites.where(go).join(firsts, ["repo", "dir"]).select("repo", "file", "name", "callee"))
    calls = calls.select("repo", "file", F.lit("call").alias("fact"), none.cast("string").alias("name"), none.cast("string").alias("kind"), none.cast("string").alias("parent"), none.cast("string").alias("signature"), none.cast("string").alias("extends"), F.col("name").alias("caller"), "callee", F.lit(1).alias("line"))
    facts = decl.unionByName(calls).select("*", none.cast("string").alias("specifier"), none.cast("string").alias("import_kind"), none.cast("boolean").alias("reexport"), none.cast("array<string>").alias("symbols"), none.cast("array<string>").alias("locals"))
    edges = spark.createDataFrame([], "repo string, `from` string, `to` string, kind string, specifier string")
    index = spark.createDataFrame([], "repo string, file string, name string, target_file string, target_symbol string, hops int")
    return link.link_calls(facts, edges, index)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
