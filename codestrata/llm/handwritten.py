"""Generated, minified, vendored and data files among source files.

Notices in the comments that head or end a file are matched by one Aho-Corasick automaton; path rules
name vendored folders, lockfiles and the suffixes of generated and minified files; the content itself
shows minified text, pure data and numbered repetition. Copies of third-party files are found by a
join on the content's hash without line ends.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.session import checkpointed, spread

# The words notices are made of, lower case. What counts is their place in the sentence: a notice says of
# its own file, at the head of a clause, how it came about.
MADE = (  # enough on their own
    "@generated", "<auto-generated", "<autogenerated", "autogenerated", "auto-generated", "auto generated", "automatically generated", "machine generated", "machine-generated",
    "machine made", "machine-made", "machine written", "machine-written", "created automatically", "automatically created", "generated automatically", "generated",
)
MADE_BY = ("produced", "created", "emitted", "written", "rendered", "compiled", "transpiled", "built")  # only with a tool or a ban beside them
BANS = (
    "do not edit", "don't edit", "do not modify", "don't modify", "do not change", "not edit by hand", "manual changes", "manual edits", "hand edits", "changes are overwritten", "changes will be",
    "edits will be", "edits are", "regenerate",
)
TAKEN = ("bundled", "vendored", "copied", "copy of", "snapshot of", "imported", "mirrored", "mirror of", "taken", "@license", "@preserve", "third-party", "third party")
_ROLES = {"made": MADE, "made_by": MADE_BY, "ban": BANS, "taken": TAKEN}
# words that may stand before the participle, in a sentence about the file itself
SUBJECT = (
    "this", "the", "file", "code", "source", "module", "script", "class", "package", "header", "whole", "is", "was", "are", "has", "been", "a", "an", "all", "contents", "content", "here", "note", "warning", "attention",
)

_VENDOR_PATH = r"(^|/)(node_modules|vendor|third_party|third-party|thirdparty|_vendor|vendored|bower_components|jspm_packages|Godeps|Pods|site-packages)/|^(external|deps)/"
_GENERATED_PATH = (
    r"(\.pb\.(go|rs|js|ts|cc|h)|\.pb\.gw\.go|_pb2(_grpc)?\.pyi?|_pb\.(js|d\.ts|ts)|_grpc_pb\.(js|ts)|\.gen\.[a-z]+|\.generated\.[a-z]+|_generated\.[a-z]+|\.g\.(dart|cs)|OuterClass\.java)$"
    r"|(^|/)zz_generated[^/]*$|(^|/)__generated__/"
)
_MINIFIED_PATH = r"([.-]min\.(js|css|mjs)|\.bundle\.(js|mjs)|/(dist|static|public|build|assets)/(.*/)?chunk-[0-9a-f]{6,}\.js)$"
_LOCKFILE_PATH = r"(^|/)(package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|bun\.lockb?|Cargo\.lock|go\.sum|poetry\.lock|uv\.lock|Pipfile\.lock|composer\.lock|Gemfile\.lock|gradle\.lockfile|\.terraform\.lock\.hcl)$"

_COMMENT_HEAD = re.compile(r"(?:\s|//[^\n]*|#(?!include|define|\[)[^\n]*|/\*.*?\*/|<!--.*?-->|(?:\"\"\".*?\"\"\"|'''.*?'''))*", re.DOTALL)
_COMMENT_LINE = re.compile(r"^\s*(?://|#|\*|/\*|<!--|--|;)")
_RELEASE_LINE = re.compile(r"^\W*([a-z][\w.-]*) v?\d+\.\d+(?:\.\d+)?\s*$")
_OWNER_LINE = re.compile(r"^\W*(?:\(c\)|copyright|©)")
_LICENCE_LINE = re.compile(r"^\W*(?:released|licensed|distributed) under the .*licen[sc]e")


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for role, wordings in _ROLES.items():
        for wording in wordings:
            automaton.add_word(wording, (role, wording))
    automaton.make_automaton()
    return automaton


def comments_around(source: str) -> list[str]:
    """The lines of the comments before the first code and after the last."""
    head = _COMMENT_HEAD.match(source)
    end = head.end() if head else 0
    tail: list[str] = []
    stop = len(source.rstrip())
    while stop > end:
        start = max(end, source.rfind("\n", end, stop) + 1)
        if not _COMMENT_LINE.match(source[start:stop]):
            break
        tail.append(source[start:stop])
        stop = start - 1
    return source[:end].splitlines() + tail[::-1]


_DECORATION = re.compile(r"^[\s/#*!;<>=\-\"']+|^\(c\)\s*")
_VERSION = re.compile(r"(?<![\w.])v?\d+\.\d+|@v?\d+(?:\.\d+)?")
_SOURCE_OF_COPY = re.compile(r"\bfrom\s+(?:https?://|upstream\b|[\w-]+(?:\.[\w-]+)+/)")
_AFTER_MADE = re.compile(r"\s*(?:$|[-!<>*.,;:(]|(?:by|from|with|using|via|on|at|for|file|code|source|header|module|output|stub|do)\b)(?!\s*hand\b)")
_TOOL = re.compile(r"\s*(?:automatically\s+)?(?:by|with|using|via)\s+(?:the\s+)?(?:`[^`]+`|[\w./-]+\s+v?\d+\.\d|[\w./-]*(?:generator|compiler|gen)\b)|\s*(?:automatically\s+)?from\s+[\w./-]+\.\w+")


def _heads_a_clause(line: str, at: int) -> bool:
    """Whether nothing but words for the file itself stands between the start of the clause and `at`."""
    before = line[:at]
    clause = before
    for match in re.finditer(r"[.;:!]+\s+|\s[-\u2013\u2014]+\s|,\s+|\(", before):
        clause = before[match.end() :]
    return all(word in SUBJECT for word in re.findall(r"[^\s/#*!<>=\"'-]+", clause))


def notices(source: str) -> tuple[bool, bool]:
    """(generated, vendored) as the comments around the code declare it.

    One automaton finds the words of notices in a line. They count where they head a clause, so that text about other
    generated files, and denials ("not generated", "replaces the vendored ..."), are no notices. What was produced or
    written needs the tool that did it, or a ban on edits, in the same comment; a copy needs its version or its source.
    """
    generated = vendored = weak = ban = False
    release = ""
    for line in comments_around(source):
        line = _DECORATION.sub("", line.lower()) if "<" not in line[:8] else line.lower().lstrip(" /#*")
        for end, (role, wording) in _automaton().iter(line):
            start = end - len(wording) + 1
            if start and line[start - 1].isalnum() or not _heads_a_clause(line, start):
                continue
            rest = line[end + 1 :]
            if rest[:1].isalnum() and role != "ban":
                continue
            if role == "made":
                generated = generated or wording[0] in "@<" or bool(_AFTER_MADE.match(rest)) and (wording != "generated" or bool(re.match(r"\s*(?:by|from|with|using|via|on|at)\b", rest)))
            elif role == "made_by":
                generated = generated or bool(_TOOL.match(rest))
                weak = weak or bool(re.match(r"\s*(?:automatically\s+)?(?:by|from|with|using)\b", rest))
            elif role == "ban":
                ban = True
            else:
                vendored = vendored or bool(_VERSION.search(rest) or _SOURCE_OF_COPY.search(rest))
        if match := _RELEASE_LINE.match(line):
            release = match.group(1)
        elif release and (_OWNER_LINE.match(line) and release in line or _LICENCE_LINE.match(line)):
            vendored = True
    return generated or weak and ban, vendored


_NUMBER = re.compile(r"\d+")
# a comment (group 1) or a literal; read in one pass, so that marks inside either are not taken for the other
_PIECE = re.compile(r"(//[^\n]*|(?m:^[ \t]*#[^\n]*)|/\*.*?\*/)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`|\b0[xX][0-9a-fA-F_]+\b|\b\d[\d_.eE]*\b", re.DOTALL)
_SOLID = re.compile(r"[^\s,]")


def shape(source: str) -> tuple[bool, bool, bool]:
    """(minified, data, repetition): what the text itself looks like.

    minified: lines far longer than anyone writes, hardly any white space, and code in them. data: literals
    make up nearly everything and are more than a screen of text. repetition: most blocks are the same
    text but for running numbers.
    """
    lines = [x for x in source.splitlines() if x.strip()]
    if not lines:
        return False, False, False
    size = sum(map(len, lines))
    space = sum(x.count(" ") + x.count("\t") for x in lines)
    data = False
    if size >= 600:
        literal = comment = 0
        for piece in _PIECE.finditer(source):
            length = len(_SOLID.findall(piece.group()))
            if piece.group(1):
                comment += length
            else:
                literal += length
        data = literal >= 0.8 * max(1, len(_SOLID.findall(source)) - comment)
    binary = any(c in source for c in "\x00\x01\x02\x03�")
    minified = not data and not binary and size / len(lines) > 120 and space / size < 0.12 and size > 300
    repetition = False
    blocks = [b for b in re.split(r"\n\s*\n", source.replace("\r\n", "\n")) if b.strip()]
    if len(blocks) >= 8:
        shapes = Counter(_NUMBER.sub("0", b) for b in {b.strip() for b in blocks})  # the numbers must differ
        times = shapes.most_common(1)[0][1]
        repetition = times >= 8 and times >= 0.7 * len(blocks)
    return minified, data, repetition


def _batches(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in rows:
        facts = []
        for source in batch["source"].tolist():
            facts.append((False,) * 5 if not source else (*notices(source), *shape(source)))
        out = pd.DataFrame(facts, columns=["notice", "declared", "minified", "data", "repetition"])
        out.insert(0, "file_id", batch["file_id"].tolist())
        out["path"] = batch["path"].tolist()
        out["content"] = batch["content"].tolist()
        yield out


def content_key() -> Column:
    """A hash of the source without its line ends and outer white space; null for blank sources."""
    text = F.trim(F.regexp_replace("source", r"[ \t]*(\r\n|\r|\n)", "\n"))
    text = F.regexp_replace(text, r"\n+$", "")
    return F.when(F.length(F.trim(text)) > 0, F.sha2(text, 256))


PATH_RULES = {"generated": _GENERATED_PATH, "lockfile": _LOCKFILE_PATH, "minified": _MINIFIED_PATH, "vendored": _VENDOR_PATH}


def path_rules(path: Column) -> dict[str, Column]:
    """What a path alone says of a file: generated, lockfile, minified, vendored; false for a null path."""
    return {name: F.coalesce(path.rlike(pattern), F.lit(False)) for name, pattern in PATH_RULES.items()}


def origins(files: DataFrame) -> DataFrame:
    """(file_id, generated, minified, vendored, data, copied): why a file isn't hand-written; all false if it is.

    files needs file_id, path and source; other columns are ignored. A null source is judged by its path
    alone, a null path by its source alone; rows with a null file_id are left out, exact repeats come once.
    copied marks files equal to a vendored one but for line ends, wherever it is stored.
    """
    rows = files.where("file_id is not null").select("file_id", "path", "source", content_key().alias("content"))
    schema = "file_id long, notice boolean, declared boolean, minified boolean, data boolean, repetition boolean, path string, content string"
    facts = spread(rows).mapInPandas(_batches, schema)
    rules = path_rules(F.col("path"))
    flags = facts.select(
        "file_id",
        (F.col("notice") | F.col("repetition") | rules["generated"] | rules["lockfile"]).alias("generated"),
        (F.col("minified") | rules["minified"]).alias("minified"),
        (F.col("declared") | rules["vendored"]).alias("vendored"),
        "data",
        "content",
    )
    flags = checkpointed(flags)  # read twice below, so the sources are read once
    # one row per content, pre-aggregated: whether any of its holders is vendored
    holders = flags.where("content is not null").groupBy("content").agg(F.bool_or("vendored").alias("copied")).where("copied")
    return (
        flags.join(holders, "content", "left")
        .select("file_id", "generated", "minified", "vendored", "data", (F.coalesce("copied", F.lit(False)) & ~F.col("vendored")).alias("copied"))
        .distinct()
    )


def not_handwritten(files: DataFrame) -> DataFrame:
    """(file_id): files that were not written by hand in their repository."""
    return origins(files).where("generated or minified or vendored or data or copied").select("file_id")
