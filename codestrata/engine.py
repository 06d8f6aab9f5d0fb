"""The code map as one object: build it from files, then ask it."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.ids import is_node
from codestrata.operators import answers, compare, graph, link, references, resolve
from codestrata.session import checkpointed
from codestrata.sources.extract import extract_facts
from codestrata.sources.infra import infra_facts
from codestrata.sources.manifests import detect_packages, manifests


@dataclass
class CodeMap:
    """Lazily chained tables over files (repo, path, source); `modules` (repo, module_path) are Go modules and
    `packages` (repo, pkg, dir) package directories known from elsewhere, by default those of the manifests."""

    files: DataFrame
    modules: DataFrame | None = None
    packages: DataFrame | None = None
    _: dict = field(default_factory=dict, repr=False)

    @property
    def spark(self) -> SparkSession:
        return self.files.sparkSession

    @cached_property
    def facts(self) -> DataFrame:
        """Extracted once and checkpointed: every other table selects from it."""
        return checkpointed(extract_facts(self.files).unionByName(infra_facts(self.files)))

    @cached_property
    def declared(self) -> DataFrame:
        return checkpointed(manifests(self.files))

    @cached_property
    def paths(self) -> DataFrame:
        return self.files.select("repo", "path").distinct()

    @cached_property
    def owners(self) -> DataFrame:
        roots = self.packages if self.packages is not None else detect_packages(self.declared, self.files)
        return resolve.package_of(self.paths, roots.select("repo", "pkg", "dir"))

    @property
    def _modules(self) -> DataFrame:
        own = self.declared.where("kind = 'package' and source = 'go.mod' and dir = '.'").select("repo", F.col("name").alias("module_path"))
        return own if self.modules is None else own.unionByName(self.modules.select("repo", "module_path"))

    @cached_property
    def imports(self) -> DataFrame:
        return checkpointed(link.link_imports(self.facts, self.paths, self._modules, self.declared))

    @cached_property
    def symbols(self) -> DataFrame:
        rows = self.facts.where("fact = 'decl'").withColumn("id", F.concat("file", F.lit("#"), "name"))
        rows = resolve.disambiguate(rows, ["repo"], "id", ["start_line", "end_line", "kind"], "unique_id")
        return rows.select("repo", F.col("unique_id").alias("id"), "file", "name", "kind", "signature", "exported", "start_line", "end_line", "parent", "extends")

    @cached_property
    def exports(self) -> DataFrame:
        return link.export_index(self.facts, self.imports, self.facts)

    @cached_property
    def calls(self) -> DataFrame:
        return link.link_calls(self.facts, self.imports, self.exports)

    @cached_property
    def references(self) -> DataFrame:
        return references.link_references(self.facts, self.paths)

    @cached_property
    def pairs(self) -> DataFrame:
        edges = self.imports.select("repo", F.col("from").alias("from_path"), F.col("to").alias("to_id"), "kind")
        return checkpointed(graph.expand_targets(edges, self.paths))

    def unparsable(self) -> DataFrame:
        return self.facts.where("fact = 'unparsable'").select("repo", "file")

    def query(self, needle: str) -> DataFrame:
        return resolve.find_symbols(self.symbols, self.spark.createDataFrame([(needle,)], "needle string"))

    def suggest(self, needle: str) -> DataFrame:
        return resolve.nearest_ids(needle, self.symbols)

    @cached_property
    def impact_pairs(self) -> DataFrame:
        """Imports and references as one graph of files and nodes."""
        return checkpointed(graph.impact_pairs(self.pairs, self.references))

    def impact(self, repo: str, target: str, most_depth: int | None = None) -> DataFrame:
        """What a file or node affects, through imports and references."""
        wanted = self.spark.createDataFrame([(repo, target)], "repo string, target string")
        return graph.impact(self.impact_pairs, wanted, most_depth)

    def node_blast(self) -> DataFrame:
        """(repo, node, blast) of every node inside a file, over imports and references."""
        ids = self.symbols.select("repo", F.col("id").alias("node"), "kind").where(is_node(F.col("kind"), F.col("node"))).select("repo", "node")
        return graph.blast_radius(self.impact_pairs, ids)

    def references_at(self) -> DataFrame:
        return answers.references_at(self.references)

    def blast(self) -> DataFrame:
        return graph.blast_radius(self.pairs, self.paths.toDF("repo", "node"))

    def cycles(self) -> DataFrame:
        return graph.cycles(self.pairs)

    def verify(self, imports: DataFrame) -> DataFrame:
        """Import edges that differ from committed ones (repo, from, to, kind, import_kind, names, specifier)."""
        return compare.verify(self.imports, imports, ["repo", "from", "to", "kind", "import_kind", "names"], "specifier")
