"""From extracted facts to edges: import resolution, the export index and call edges.

Every step is a join: candidates are exploded with their place and the first that exists wins; names
with two different meanings give no edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.ids import directory_of, lang_of, normal_join, package_of_specifier
from codestrata.operators.resolve import by_unique_suffix, probe
from codestrata.session import checkpointed
from codestrata.sources.manifests import alias_candidates

EMBED_LEVELS = 3  # of embedded Go types that are searched, as the rule has it
SCRIPT_ENDS = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"]


def _each(base: Column, ends: list[str]) -> Column:
    return F.transform(F.array(*[F.lit(e) for e in ends]), lambda e: F.concat(base, e))


def candidates(lang: Column, file: Column, specifier: Column) -> Column:
    """Ordered paths a specifier may mean, by the importing file's language; an empty array for external ones."""
    here = directory_of(file)
    joined = normal_join(here, specifier)
    # a script may name its compiled file
    source = F.regexp_replace(joined, r"\.(m|c)?js(x?)$", ".$1ts$2")
    script = F.when(specifier.rlike(r"^\.\.?(/|$)"), F.concat(_each(joined, SCRIPT_ENDS), F.array(source)))
    dots = F.length(F.regexp_extract(specifier, r"^(\.*)", 1))
    rest = F.regexp_replace(F.regexp_replace(specifier, r"^\.+", ""), r"\.", "/")
    up = normal_join(here, F.concat(F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), rest))
    python = _each(F.when(dots > 0, up).otherwise(rest), [".py", "/__init__.py", ".pyi"])
    crate = F.regexp_replace(F.regexp_replace(specifier, "^crate::", ""), "::", "/")
    above = F.regexp_replace(crate, "/[^/]+$", "")
    rust = F.when(F.startswith(specifier, F.lit("crate::")), F.flatten(F.array(*[_each(F.concat(F.lit(root), p), [".rs", "/mod.rs"]) for p in (crate, above) for root in ("src/", "")])))
    rust = rust.when(F.startswith(specifier, F.lit("mod ")), _each(normal_join(here, F.regexp_replace(specifier, "^mod ", "")), [".rs", "/mod.rs"]))
    none = F.array().cast("array<string>")
    return F.coalesce(F.when(lang.isin("ts", "tsx", "js", "jsx"), script).when(lang == "python", python).when(lang == "rust", rust), none)


def link_imports(imports: DataFrame, files: DataFrame, modules: DataFrame | None = None, declared: DataFrame | None = None) -> DataFrame:
    """Import facts (repo, file, specifier, import_kind, symbols, reexport) -> edges (repo, from, to, kind, import_kind, names, specifier).

    to is a file, a directory (Go packages, local Terraform modules), `ext:<package>` or `unresolved:<specifier>`;
    self-edges are dropped; edges that differ in the specifier only come once, with the least. modules
    (repo, module_path) are the Go modules whose packages are directories of the repository; declared is what
    the manifests say (sources/manifests.py): tsconfig paths and packages of the repository. Java names resolve to
    the one file whose path ends in them.
    """
    lang = lang_of(F.col("file"))
    wanted = imports.where("fact = 'import'").select("repo", "file", "specifier").distinct()
    tried = wanted.withColumn("candidates", candidates(lang, F.col("file"), F.col("specifier")))
    hits = probe(tried.where("size(candidates) > 0"), files, ["file", "specifier"])
    directories = files.select("repo", directory_of(F.col("path")).alias("path")).distinct()
    local = wanted.where(lang == "hcl").where("specifier like './%' or specifier like '../%'").select("repo", "file", "specifier", normal_join(directory_of(F.col("file")), F.col("specifier")).alias("path"))
    # of several rules that find something the first one wins
    hits = hits.select("repo", "file", "specifier", "path", F.lit(0).alias("rule")).unionByName(local.join(directories, ["repo", "path"], "left_semi").select("repo", "file", "specifier", "path", F.lit(1).alias("rule")))
    if declared is not None:
        script = wanted.where(lang.isin("ts", "tsx", "js", "jsx"))
        named = alias_candidates(script, declared)
        ends = named.select("repo", "file", "specifier", F.posexplode(_each(F.col("base"), SCRIPT_ENDS)).alias("place", "path"), "rank")
        aliased = ends.join(files.select("repo", "path").distinct(), ["repo", "path"]).groupBy("repo", "file", "specifier").agg(F.min_by("path", F.struct("rank", "place")).alias("path"))
        hits = hits.unionByName(aliased.select("repo", "file", "specifier", "path", F.lit(2).alias("rule")))
    java = wanted.where(lang == "java").withColumn("token", F.concat(F.regexp_replace(F.regexp_replace("specifier", r"\.\*$", ""), r"\.", "/"), F.lit(".java")))
    one = by_unique_suffix(java.select("repo", "token"), files.where(F.col("path").like("%.java")))
    hits = hits.unionByName(java.join(one, ["repo", "token"]).select("repo", "file", "specifier", "path", F.lit(3).alias("rule")))
    kotlin = wanted.where(lang == "kotlin")
    packages = imports.where("fact = 'package'").select("repo", "file", F.col("name").alias("pkg"))
    top = imports.where("fact = 'decl' and parent is null").where(lang == "kotlin").select("repo", "file", F.col("name").alias("symbol")).distinct()
    declared_in = top.join(packages, ["repo", "file"]).groupBy("repo", F.concat("pkg", F.lit("."), "symbol").alias("full")).agg(F.min("file").alias("path"), F.max("file").alias("__most")).where("path = __most").drop("__most")
    # a declaration, or a member of one
    meant = kotlin.select("*", F.posexplode(F.array(F.col("specifier"), F.regexp_replace("specifier", r"\.[^.]+$", ""))).alias("place", "full"))
    meant = meant.join(declared_in, ["repo", "full"]).groupBy("repo", "file", "specifier").agg(F.min_by("path", "place").alias("path"))
    hits = hits.unionByName(meant.withColumn("rule", F.lit(5)))
    if declared is not None:
        # Python's import roots: directories with a project file and their src, the deepest first, before the repository's root
        roots = declared.where("source = 'pyproject.toml'").select("repo", "dir").distinct()
        roots = roots.select("repo", F.explode(F.array("dir", F.when(F.col("dir") == ".", "src").otherwise(F.concat("dir", F.lit("/src"))))).alias("root"))
        absolute = wanted.where((lang == "python") & ~F.startswith("specifier", F.lit("."))).join(roots, "repo")
        base = F.when(F.col("root") == ".", F.replace("specifier", F.lit("."), F.lit("/"))).otherwise(F.concat("root", F.lit("/"), F.replace("specifier", F.lit("."), F.lit("/"))))
        ends = absolute.select("repo", "file", "specifier", "root", F.posexplode(_each(base, [".py", "/__init__.py", ".pyi"])).alias("place", "path"))
        below = ends.join(files.select("repo", "path").distinct(), ["repo", "path"]).groupBy("repo", "file", "specifier").agg(F.min_by("path", F.struct((-F.size(F.split("root", "/"))).alias("d"), "root", "place")).alias("path"))
        hits = hits.unionByName(below.withColumn("rule", F.lit(-1)))
    if modules is not None:
        go = wanted.where(lang == "go").join(modules.where("module_path is not null").select("repo", "module_path").distinct(), "repo")
        inside = go.where((F.col("specifier") == F.col("module_path")) | F.startswith("specifier", F.concat("module_path", F.lit("/"))))
        rest = F.expr("substring(specifier, length(module_path) + 2)")
        target = inside.select("repo", "file", "specifier", F.when(rest == "", ".").otherwise(rest).alias("path"), F.length("module_path").alias("__length"))
        target = target.join(directories, ["repo", "path"], "left_semi").groupBy("repo", "file", "specifier").agg(F.max_by("path", "__length").alias("path"))
        hits = hits.unionByName(target.withColumn("rule", F.lit(4)))
    hits = hits.groupBy("repo", "file", "specifier").agg(F.min_by("path", F.struct("rule", "path")).alias("to"))
    relative = F.col("specifier").rlike(r"^\.|^crate::|^mod ")
    package = F.when(lang.isin("python", "java", "kotlin"), F.regexp_extract("specifier", r"^([^.]+)", 1)).when(lang == "rust", F.regexp_extract("specifier", r"^([^:]+)", 1)).when(lang == "go", F.col("specifier")).otherwise(package_of_specifier(F.col("specifier")))
    missed = F.when(relative, F.concat(F.lit("unresolved:"), "specifier")).otherwise(F.concat(F.lit("ext:"), package))
    rows = imports.where("fact = 'import'").join(hits, ["repo", "file", "specifier"], "left").withColumn("to", F.coalesce("to", missed))
    kind = F.when(F.col("reexport"), "reexport").otherwise("import")
    rows = rows.where("file <> to").select("repo", F.col("file").alias("from"), "to", kind.alias("kind"), "import_kind", F.array_join(F.array_sort("symbols"), ",").alias("names"), "specifier")
    return rows.groupBy("repo", "from", "to", "kind", "import_kind", "names").agg(F.min("specifier").alias("specifier"))


def export_index(exports: DataFrame, edges: DataFrame, declarations: DataFrame) -> DataFrame:
    """(repo, file, name, target_file, target_symbol, hops): what every exported name means, if it means one thing.

    exports are facts (repo, file, name, kind named/default/star, specifier, signature = the local or foreign
    name); edges from link_imports say which file a re-export's specifier is. An own export shadows a star; a
    name that two stars bring from different declarations is dropped; a diamond to one declaration keeps the
    fewest hops; `default` never passes a star. Chains have any length: the rounds end when none finds a new meaning.
    """
    target = edges.where("kind = 'reexport'").select("repo", F.col("from").alias("file"), "specifier", F.col("to").alias("source")).distinct()
    rows = exports.where("fact = 'export'").select("repo", "file", "name", "kind", "specifier", F.col("signature").alias("local"))
    own = rows.where("specifier is null")
    top = declarations.where("fact = 'decl' and parent is null").select("repo", "file", F.col("name").alias("local")).distinct()
    pinned = own.join(top, ["repo", "file", "local"]).select("repo", "file", "name", F.col("file").alias("target_file"), F.col("local").alias("target_symbol"), F.lit(0).alias("hops")).distinct()
    passed = checkpointed(rows.where("specifier is not null").join(target, ["repo", "file", "specifier"]).select("repo", "file", "name", "kind", "local", "source").distinct())
    explicit = rows.where("kind <> 'star'").select("repo", "file", "name").distinct()
    known = checkpointed(pinned)
    while True:
        there = known.select("repo", F.col("file").alias("source"), F.col("name").alias("local"), "target_file", "target_symbol", "hops")
        named = passed.where("kind = 'named'").join(there, ["repo", "source", "local"])
        star = passed.where("kind = 'star'").drop("name", "local").join(there.withColumn("name", F.col("local")), ["repo", "source"]).where("name <> 'default'")
        star = star.join(explicit, ["repo", "file", "name"], "left_anti")
        columns = ["repo", "file", "name", "target_file", "target_symbol"]
        more = named.select(*columns, (F.col("hops") + 1).alias("hops")).unionByName(star.select(*columns, (F.col("hops") + 1).alias("hops")))
        merged = checkpointed(known.unionByName(more).groupBy(*columns).agg(F.min("hops").alias("hops")))
        if not merged.join(known.select(*columns), columns, "left_anti").limit(1).count():
            known = merged
            break
        known = merged
    one = known.groupBy("repo", "file", "name").agg(F.countDistinct("target_file", "target_symbol").alias("__n"))
    return known.join(one.where("__n = 1").drop("__n"), ["repo", "file", "name"], "left_semi")


def import_bindings(imports: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, file, local, source, symbol): what a local name was imported as; value imports only, the first line wins."""
    facts = imports.where("fact = 'import' and import_kind in ('static', 'dynamic') and not reexport")
    pairs = facts.select("repo", "file", "specifier", "line", F.posexplode(F.arrays_zip("symbols", "locals")).alias("place", "pair"))
    named = pairs.where("pair.locals is not null").select("repo", "file", "specifier", F.col("pair.locals").alias("local"), F.col("pair.symbols").alias("symbol"), "line", "place")
    to = edges.where("kind = 'import'").select("repo", F.col("from").alias("file"), "specifier", F.col("to").alias("source")).distinct()
    first = named.join(to, ["repo", "file", "specifier"]).groupBy("repo", "file", "local").agg(F.min(F.struct("line", "place", "source", "symbol")).alias("__b"))
    return first.select("repo", "file", "local", "__b.source", "__b.symbol")


def link_calls(facts: DataFrame, edges: DataFrame, index: DataFrame) -> DataFrame:
    """(repo, from, to, confidence, line): call edges once per pair; high beats med, the first line is kept.

    A bare name is a top-level declaration of its file, else what it was imported as; `this.m` a method of the
    caller's class or of the nearest base that has it, `super.m` of the nearest base; `space.m` an export of a namespace
    import; `Class.m` a method of a class of the file or imported. Through re-exports the edge is med. Go has its own
    rules (_go_calls). Whatever is external, ambiguous, unknown or no function or class gives none.
    """
    calls = facts.where("fact = 'call'").select("repo", "file", "caller", F.regexp_replace("callee", "^new ", "").alias("callee"), "line")
    calls = calls.withColumn("owner", F.substring_index("callee", ".", 1)).withColumn("member", F.when(F.contains("callee", F.lit(".")), F.regexp_extract("callee", r"\.(.*)$", 1)))
    calls = checkpointed(calls.withColumn("__go", F.coalesce(lang_of(F.col("file")) == "go", F.lit(False))))
    decls = checkpointed(facts.where("fact = 'decl'").groupBy("repo", "file", "name").agg(F.min("kind").alias("kind"), F.min("parent").alias("parent"), F.min("extends").alias("extends"), F.min("signature").alias("signature")))
    bindings = checkpointed(import_bindings(facts, edges))
    go = _go_calls(calls.where("__go"), facts, decls, bindings)
    calls = calls.where("not __go")
    callable_ = decls.where("kind not in ('interface', 'type')")
    top = callable_.where("parent is null").select("repo", "file", F.col("name").alias("owner"), "kind")
    names = callable_.select("repo", "file", "name")
    high, med = F.lit("high"), F.lit("med")
    out = ["repo", "file", "caller", "line", "target_file", "target_symbol", "confidence"]

    bare = calls.where("member is null")
    local = bare.join(top, ["repo", "file", "owner"]).select("repo", "file", "caller", "line", F.col("file").alias("target_file"), F.col("owner").alias("target_symbol"), high.alias("confidence"))
    far = calls.join(top.drop("kind"), ["repo", "file", "owner"], "left_anti").join(bindings.withColumnRenamed("local", "owner"), ["repo", "file", "owner"])
    found = index.select("repo", F.col("file").alias("source"), F.col("name").alias("symbol"), "target_file", "target_symbol", "hops")
    sure = F.when(F.col("hops") == 0, high).otherwise(med).alias("confidence")
    targets = names.toDF("repo", "target_file", "target_symbol")
    imported = far.where("member is null").join(found, ["repo", "source", "symbol"]).select(*out[:6], sure)
    spaced = far.where("symbol = '*' and member is not null").drop("symbol").withColumnRenamed("member", "symbol").join(found, ["repo", "source", "symbol"]).select(*out[:6], sure)
    cls = far.where("symbol <> '*' and member is not null").join(found, ["repo", "source", "symbol"])
    static = cls.select("repo", "file", "caller", "line", "target_file", F.concat("target_symbol", F.lit("."), "member").alias("target_symbol"), sure)
    mine = calls.where("member is not null").join(top.where("kind = 'class'"), ["repo", "file", "owner"]).select("repo", "file", "caller", "line", F.col("file").alias("target_file"), F.col("callee").alias("target_symbol"), high.alias("confidence"))
    named = local.select(*out).unionByName(imported.select(*out)).unionByName(spaced.select(*out)).unionByName(static.select(*out)).unionByName(mine.select(*out))
    every = named.join(targets, ["repo", "target_file", "target_symbol"], "left_semi").select(*out)
    every = every.unionByName(_member_calls(calls, facts, decls, bindings, found).select(*out)).unionByName(go.select(*out))
    source = F.when(F.col("caller").isNull(), F.col("file")).otherwise(F.concat("file", F.lit("#"), "caller"))
    edges_ = every.select("repo", source.alias("from"), F.concat("target_file", F.lit("#"), "target_symbol").alias("to"), "confidence", "line")
    return edges_.groupBy("repo", "from", "to").agg(F.min("confidence").alias("confidence"), F.min("line").alias("line"))


def class_bases(decls: DataFrame, bindings: DataFrame, found: DataFrame) -> DataFrame:
    """(repo, file, cls, base_file, base): the one class that a class's `extends` names: of the file, imported, or a
    member of a namespace import. A base that is external or not one class is left out."""
    classes = decls.where("kind = 'class'").select("repo", "file", F.col("name").alias("cls"))
    heirs = decls.where("kind = 'class' and extends is not null").select("repo", "file", F.col("name").alias("cls"), F.col("extends").alias("written"), F.substring_index("extends", ".", 1).alias("local"), F.regexp_extract("extends", r"\.([^.]+)$", 1).alias("inner"))
    own = heirs.where("inner = ''").join(decls.where("parent is null").select("repo", "file", F.col("name").alias("written")), ["repo", "file", "written"]).select("repo", "file", "cls", F.col("file").alias("base_file"), F.col("written").alias("base"))
    far = heirs.join(own, ["repo", "file", "cls"], "left_anti").join(bindings, ["repo", "file", "local"]).where("(symbol = '*') = (inner <> '')")
    far = far.withColumn("symbol", F.when(F.col("inner") != "", F.col("inner")).otherwise(F.col("symbol"))).join(found, ["repo", "source", "symbol"])
    pairs = own.unionByName(far.select("repo", "file", "cls", F.col("target_file").alias("base_file"), F.col("target_symbol").alias("base")))
    return pairs.where("file <> base_file or cls <> base").join(classes.toDF("repo", "base_file", "base"), ["repo", "base_file", "base"], "left_semi")


def _member_calls(calls: DataFrame, facts: DataFrame, decls: DataFrame, bindings: DataFrame, found: DataFrame) -> DataFrame:
    """this.m and super.m: the nearest class that declares the member; a field of that name on the way hides it.

    One round a level of the hierarchy, for all calls at once, until none climbs on.
    """
    bases = checkpointed(class_bases(decls, bindings, found))
    methods = decls.where("kind = 'method'").select("repo", F.col("file").alias("target_file"), F.col("name").alias("target_symbol"))
    fields = facts.where("fact = 'member'").select("repo", F.col("file").alias("target_file"), F.concat("parent", F.lit("."), "name").alias("target_symbol")).distinct()
    inside = calls.where("owner in ('this', 'super') and caller is not null").withColumn("cls", F.regexp_replace("caller", r"\.[^.]*$", ""))
    climb = lambda rows: rows.join(bases.withColumnsRenamed({"file": "at", "base_file": "__file", "base": "__base"}), ["repo", "at", "cls"]).drop("at", "cls").withColumnsRenamed({"__file": "at", "__base": "cls"})
    wanted = inside.select("repo", "file", "caller", "line", "owner", "member", F.col("file").alias("at"), "cls")
    frontier = checkpointed(wanted.where("owner = 'this'").unionByName(climb(wanted.where("owner = 'super'"))).drop("owner"))
    seen, hits = frontier, None
    while True:
        tried = frontier.withColumn("target_file", F.col("at")).withColumn("target_symbol", F.concat("cls", F.lit("."), "member"))
        hit = tried.join(methods, ["repo", "target_file", "target_symbol"], "left_semi").select("repo", "file", "caller", "line", "target_file", "target_symbol", F.lit("high").alias("confidence"))
        hits = hit if hits is None else hits.unionByName(hit)
        missed = tried.join(methods.unionByName(fields), ["repo", "target_file", "target_symbol"], "left_anti").drop("target_file", "target_symbol")
        further = climb(missed).select(*frontier.columns).distinct()
        frontier = checkpointed(further.join(seen, frontier.columns, "left_anti"))
        if not frontier.limit(1).count():
            return checkpointed(hits)
        seen = checkpointed(seen.unionByName(frontier))


def _go_calls(calls: DataFrame, facts: DataFrame, decls: DataFrame, bindings: DataFrame) -> DataFrame:
    """Calls of Go files by Go's scopes; all edges are high.

    A bare name is a function of the package, that is of the directory; `x.m` a method of the type of the local x, as
    written or as the result of the function it was bound to; `pkg.F` a function of the imported directory; `r.m` a
    method of the receiver's type. A local hides a package. A name that several files of a directory declare is that
    of the caller's own file, or none.
    """
    is_go = lang_of(F.col("file")) == "go"
    own = decls.where(is_go & F.col("kind").isin("function", "method")).select("repo", directory_of(F.col("file")).alias("dir"), "name", "file", "kind", "signature")
    result = F.regexp_extract("signature", r"\)\s*(?:\(\s*(?:\w+\s+)?)?\*?([A-Za-z_][\w.]*)[^()]*\)?$", 1)
    declared = own.groupBy("repo", "dir", "name", "kind").agg(F.sort_array(F.collect_set("file")).alias("files"), F.min(result).alias("result"), F.max(result).alias("__most"))
    declared = checkpointed(declared.withColumn("result", F.when(F.col("result") == F.col("__most"), F.nullif("result", F.lit("")))).drop("__most"))
    file = F.when(F.size("files") == 1, F.get("files", F.lit(0))).when(F.array_contains("files", F.col("file")), F.col("file"))
    out = ["repo", "file", "caller", "line"]
    bound = bindings.select("repo", "file", F.col("local").alias("alias"), F.col("source").alias("alias_dir"))
    calls = calls.withColumn("dir", directory_of(F.col("file")))

    def at(rows: DataFrame, name: Column, kind: str) -> DataFrame:
        """The declaration `name` of kind in `target_dir`."""
        hits = rows.withColumn("__name", name).join(declared.where(F.col("kind") == kind).select("repo", F.col("dir").alias("target_dir"), F.col("name").alias("__name"), "files"), ["repo", "target_dir", "__name"])
        return hits.withColumn("target_file", file).where("target_file is not null").select(*out, "target_file", F.col("__name").alias("target_symbol"), F.lit("high").alias("confidence"))

    def typed(rows: DataFrame, written: str) -> DataFrame:
        """target_dir and type of the type `written` in `file`: of its package or of an imported one."""
        near = rows.where(~F.contains(written, F.lit("."))).withColumn("target_dir", directory_of(F.col("file"))).withColumn("type", F.col(written))
        far = rows.where(F.contains(written, F.lit("."))).withColumn("alias", F.substring_index(written, ".", 1)).join(bound, ["repo", "file", "alias"])
        return near.unionByName(far.withColumn("target_dir", F.col("alias_dir")).withColumn("type", F.substring_index(written, ".", -1)).drop("alias", "alias_dir"))

    bare = at(calls.where("member is null").withColumn("target_dir", F.col("dir")), F.col("owner"), "function")
    # a name bound twice in a function to different things is of no known type
    locals_ = facts.where("fact = 'local'").groupBy("repo", "file", "caller", F.col("name").alias("owner")).agg(F.min(F.struct("kind", "callee")).alias("__a"), F.max(F.struct("kind", "callee")).alias("__b"))
    locals_ = checkpointed(locals_.select("repo", "file", "caller", "owner", F.when(F.col("__a") == F.col("__b"), F.col("__a.kind")).alias("how"), F.when(F.col("__a") == F.col("__b"), F.col("__a.callee")).alias("text")))
    dotted = calls.where("member is not null")
    on_local = dotted.join(locals_, ["repo", "file", "caller", "owner"])
    free = checkpointed(dotted.join(locals_.select("repo", "file", "caller", "owner"), ["repo", "file", "caller", "owner"], "left_anti"))
    by_type = typed(on_local.where("how = 'type'").select(*out, "member", "text"), "text")
    made = typed(on_local.where("how = 'call'").select(*out, "member", "text"), "text")  # the function, by its package and name
    made = made.join(declared.where("kind = 'function' and size(files) = 1 and result is not null").select("repo", F.col("dir").alias("target_dir"), F.col("name").alias("type"), F.get("files", F.lit(0)).alias("__in"), F.col("result").alias("__result")), ["repo", "target_dir", "type"])
    made = typed(made.select("repo", F.col("file").alias("__file"), "caller", "line", "member", F.col("__in").alias("file"), "__result"), "__result").withColumn("file", F.col("__file"))
    values = by_type.select(*out, "member", "target_dir", "type").unionByName(made.select(*out, "member", "target_dir", "type"))
    through = free.withColumnRenamed("owner", "alias").join(bound, ["repo", "file", "alias"]).withColumn("target_dir", F.col("alias_dir"))
    receivers = decls.where(is_go & (F.col("kind") == "method")).select("repo", "file", F.col("name").alias("caller"), F.regexp_extract("signature", r"^func\s*\(\s*(\w+)\s", 1).alias("owner"))
    on_self = free.join(receivers, ["repo", "file", "caller", "owner"]).withColumn("target_dir", F.col("dir")).withColumn("type", F.substring_index("caller", ".", 1))
    methods = checkpointed(values.unionByName(on_self.select(*out, "member", "target_dir", "type")).distinct())
    own_methods = declared.where("kind = 'method'").select("repo", F.col("dir").alias("target_dir"), F.col("name").alias("__name"))
    hits = bare.unionByName(at(through, F.col("member"), "function")).unionByName(at(methods, F.concat("type", F.lit("."), "member"), "method"))

    # promoted through embedded types: the shallowest level that has the member decides; a field of the name, or two
    # methods on one level, end the search, as does the third level
    embeds = facts.where("fact = 'embed'").select("repo", "file", "parent", "callee")
    embeds = typed(embeds, "callee").select("repo", directory_of(F.col("file")).alias("at_dir"), F.col("parent").alias("at_type"), "target_dir", "type").distinct()
    fields = facts.where("fact = 'member'").where(is_go).select("repo", directory_of(F.col("file")).alias("target_dir"), F.col("parent").alias("type"), F.col("name").alias("member")).distinct()
    call = [*out, "member"]
    level = methods.join(own_methods, (methods["repo"] == own_methods["repo"]) & (methods["target_dir"] == own_methods["target_dir"]) & (F.concat(methods["type"], F.lit("."), methods["member"]) == own_methods["__name"]), "left_anti")
    level = level.join(fields, ["repo", "target_dir", "type", "member"], "left_anti")
    for _ in range(EMBED_LEVELS):
        level = level.withColumnsRenamed({"target_dir": "at_dir", "type": "at_type"}).join(embeds, ["repo", "at_dir", "at_type"]).select(*call, "target_dir", "type").distinct()
        level = checkpointed(level.join(level.join(fields, ["repo", "target_dir", "type", "member"], "left_semi").select(*call), [c for c in call if c != "caller"], "left_anti"))
        there = at(level, F.concat("type", F.lit("."), "member"), "method").withColumn("member", F.regexp_replace("target_symbol", r"^.*\.", ""))
        single = there.groupBy(*call).agg(F.countDistinct("target_file", "target_symbol").alias("__n"), F.first(F.struct("target_file", "target_symbol")).alias("__t"))
        single = checkpointed(single)
        hits = hits.unionByName(single.where("__n = 1").select(*out, "__t.*", F.lit("high").alias("confidence")))
        level = level.join(single.select(*[c for c in call if c != "caller"]), [c for c in call if c != "caller"], "left_anti")
    return hits


def link_references(facts: DataFrame) -> DataFrame:
    """(repo, from, to, ref_kind): Terraform references to declarations of the same directory; unresolved ones are dropped."""
    refs = facts.where("fact = 'ref'").select("repo", "file", directory_of(F.col("file")).alias("dir"), "caller", "callee", F.col("kind").alias("ref_kind"))
    parts = F.split("callee", r"\.")
    first = F.element_at(parts, 1)
    name = F.when(first == "var", F.concat(F.lit("variable."), F.get(parts, 1))).when(first.isin("local", "module"), F.concat(first, F.lit("."), F.get(parts, 1))).when(first == "data", F.concat(F.lit("data."), F.get(parts, 1), F.lit("."), F.get(parts, 2))).otherwise(F.concat(F.lit("resource."), first, F.lit("."), F.get(parts, 1)))
    decls = facts.where("fact = 'decl'").select("repo", directory_of(F.col("file")).alias("dir"), F.col("file").alias("to_file"), F.col("name").alias("__name"))
    one = decls.withColumn("__n", F.count("*").over(Window.partitionBy("repo", "dir", "__name"))).where("__n = 1").drop("__n")
    hits = refs.withColumn("__name", name).join(one, ["repo", "dir", "__name"])
    source = F.when(F.col("caller").isNull(), F.col("file")).otherwise(F.concat("file", F.lit("#"), "caller"))
    rows = hits.select("repo", source.alias("from"), F.concat("to_file", F.lit("#"), "__name").alias("to"), "ref_kind").distinct()
    return rows.where(F.col("from") != F.col("to"))
