"""Column functions over paths, ids, text and maps; all of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by extension and by file name, and the kinds that name a thing inside a file.
LANG_BY_EXTENSION = {
    ".ts": "ts", ".mts": "ts", ".cts": "ts", ".tsx": "tsx", ".js": "js", ".mjs": "js", ".cjs": "js", ".jsx": "jsx",
    ".go": "go", ".py": "python", ".pyi": "python", ".rs": "rust", ".java": "java", ".kt": "kotlin", ".kts": "kotlin",
    ".tf": "hcl", ".tfvars": "hcl", ".hcl": "hcl", ".yaml": "yaml", ".yml": "yaml",
}
LANG_BY_NAME = {"Dockerfile": "dockerfile", "Containerfile": "dockerfile"}
NODE_KINDS = (
    "resource", "data", "variable", "output", "provider", "module", "local", "job", "step", "stage", "image", "component", "route", "handler", "task",
)


def base_name(path: Column) -> Column:
    """The part behind the last slash."""
    return F.element_at(F.split(path, "/"), -1)


def lang_of(path: Column) -> Column:
    """The language of a path: by file name, then `Dockerfile.` prefix, then extension; null for others and dotfiles."""
    base = base_name(path)
    by_name = reduce(lambda c, kv: c.when(base == kv[0], kv[1]), LANG_BY_NAME.items(), F.when(base.rlike(r"^Dockerfile\..+"), "dockerfile"))
    extension = F.regexp_extract(base, r"^.+(\.[^.]*)$", 1)
    table = F.create_map(*[F.lit(x) for kv in LANG_BY_EXTENSION.items() for x in kv])
    return by_name.otherwise(F.try_element_at(table, extension))


def is_mappable(path: Column) -> Column:
    """Paths with '#', a line break or NUL can't be ids."""
    return ~path.rlike(r"[#\n\x00]")


def is_file_id(id_: Column) -> Column:
    """Ids of files: no symbol, package, external or unresolved id."""
    return ~F.contains(id_, F.lit("#")) & ~id_.rlike("^(pkg|ext|unresolved):")


def node_parts(id_: Column) -> Column:
    """struct(file, kind, name) of a node id, null for any other id."""
    pattern = rf"(?s)^([^#]*)#({'|'.join(NODE_KINDS)})\.(.+)$"
    parts = F.struct(*[F.regexp_extract(id_, pattern, i).alias(n) for i, n in enumerate(("file", "kind", "name"), 1)])
    return F.when(id_.rlike(pattern), parts)


def is_node(kind: Column, id_: Column) -> Column:
    """A node needs both a node kind and a node-shaped id."""
    return kind.isin(*NODE_KINDS) & node_parts(id_).isNotNull()


def symbol_id(file: Column, path: Column) -> Column:
    return F.concat(file, F.lit("#"), path)


def node_id(file: Column, kind: Column, name: Column) -> Column:
    """`file#kind.name`; a name that can't be part of an id raises."""
    good = F.concat(file, F.lit("#"), kind, F.lit("."), name)
    return F.when(is_mappable(name), good).otherwise(F.raise_error(F.concat(F.lit("no node name: "), name)).cast("string"))


def directory_of(path: Column) -> Column:
    """The directory of a path, '.' at the root."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def file_of(id_: Column) -> Column:
    """An id up to '#'."""
    return F.substring_index(id_, "#", 1)


def last_segment(id_: Column) -> Column:
    """What follows the last '/' or '#'."""
    return F.regexp_extract(id_, r"([^/#]*)$", 1)


def ancestors(path: Column) -> Column:
    """Every directory above a path, nearest first, ending in '.'."""
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(F.size(parts) > 1, F.concat(prefixes, F.array(F.lit(".")))).otherwise(F.array(F.lit(".")))


def suffixes(path: Column) -> Column:
    """A path and every suffix of it that starts behind a slash."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))


def normal_join(directory: Column, relative: Column) -> Column:
    """`directory/relative` with '.' and '..' resolved; null where it leaves the root."""
    parts = F.filter(F.split(F.concat_ws("/", directory, relative), "/"), lambda p: (p != "") & (p != "."))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(True).alias("ok"))

    def step(state: Column, part: Column) -> Column:
        out, up = state["out"], part == ".."
        shorter = F.when(F.size(out) > 0, F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(out)
        kept = F.when(up, shorter).otherwise(F.concat(out, F.array(part)))
        return F.struct(kept.alias("out"), (state["ok"] & (~up | (F.size(out) > 0))).alias("ok"))

    return F.aggregate(parts, start, step, lambda s: F.when(s["ok"], F.when(F.size(s["out"]) == 0, ".").otherwise(F.array_join(s["out"], "/"))))


def package_of_specifier(specifier: Column) -> Column:
    """The npm package of a bare specifier, with its scope; null for relative ones."""
    return F.when(~specifier.rlike(r"^[./]"), F.regexp_extract(specifier, r"^(@[^/]+/[^/]+|[^/]+)", 1))


def package_slug(name: Column) -> Column:
    """A package's name as part of an artifact path."""
    bare = F.regexp_replace(F.regexp_replace(name, "^@", ""), "/", "__")
    return F.regexp_replace(bare, "[^A-Za-z0-9._-]", "-")


def count_loc(text: Column) -> Column:
    """Lines: line ends, plus one where the last line has none; 0 for an empty text."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.length(text) == 0, 0).otherwise(ends + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1))


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def estimate_tokens(text: Column) -> Column:
    """ceil(UTF-16 units / 3.5)."""
    astral = F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))
    return F.ceil((F.length(text) + astral) / F.lit(3.5))


def sorted_meta(meta: Column) -> Column:
    """A map by sorted keys, without null values."""
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(meta, lambda k, v: v.isNotNull()))))


def label_text(labels: Column) -> Column:
    """Canonical `k=v,k=v` text of a label map."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def signature_text(header: Column, most: int = 200) -> Column:
    """A declaration's header with single spaces, cut at `most` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(header, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def cycle_line(members: Column) -> Column:
    """`a → b → a`."""
    return F.array_join(F.concat(members, F.slice(members, 1, 1)), " → ")


def glob_pattern(glob: str) -> str:
    """A glob as an anchored regular expression: `**` over directories, `*` and `?` inside one."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + glob[i] if glob[i] in r"\.+()[]{}^$|" else glob[i]), i + 1
    return f"^{out}$"


def looks_like_path(token: Column) -> Column:
    """Whether a token reads as a file's path and not as a symbol's name: a slash or a language's file name, and no '#'."""
    return ~F.contains(token, F.lit("#")) & (F.contains(token, F.lit("/")) | lang_of(token).isNotNull())


def shortened(items: Column, most: int) -> Column:
    """A list as text: its first `most` items, and how many more there are."""
    more = F.size(items) - most
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" and "), more, F.lit(" more"))).otherwise(""))
