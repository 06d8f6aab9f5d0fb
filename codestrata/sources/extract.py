"""Facts of source files: declarations, imports, exports, calls and references, one row each.

`extract_facts` reads every file once, in Arrow batches; the tables of the code map are selections of
its rows. Python is read by the standard parser, the other languages from their tokens. A file that
can't be read gives one `unparsable` row instead of guesses.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.ids import lang_of
from codestrata.session import spread
from codestrata.sources.lexers import LEXERS

FACT_SCHEMA = (
    "repo string, file string, fact string, name string, kind string, parent string, signature string, exported boolean, start_line int, end_line int, "
    "specifier string, import_kind string, symbols array<string>, locals array<string>, reexport boolean, caller string, callee string, line int, extends string"
)
_COLUMNS = [part.split()[0] for part in FACT_SCHEMA.split(", ")]
_DTYPES = dict.fromkeys(("start_line", "end_line", "line"), "Int32") | dict.fromkeys(("exported", "reexport"), "boolean")
_LEXER_OF = {"ts": "ts", "tsx": "tsx", "jsx": "tsx", "js": "js", "go": "go", "java": "java", "rust": "rs", "hcl": "tf", "kotlin": "kt"}
_IDENT = re.compile(r"[\w$]+(?:-[\w-]+)?")
_PLAIN = re.compile(r"[\w$]+")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_NO_CALL = frozenset("if for while switch catch function return typeof await new super import func match fn with synchronized throw".split())


def _signature(text: str) -> str:
    flat = " ".join(text.split())
    return flat if len(flat) <= 200 else flat[:200] + "…"


class _Reader:
    """Tokens of one file with texts, lines and matching brackets; the facts found so far."""

    def __init__(self, repo: str, file: str, lang: str, text: str):
        self.repo, self.file, self.lang, self.text = repo, file, lang, text
        lexer = _LEXER_OF[lang]
        tokens = LEXERS[lexer].tokens(text)
        self.kinds = [t.terminal[1] if isinstance(t.terminal, tuple) else t.terminal for t in tokens]
        self.words = [t.terminal[0] if isinstance(t.terminal, tuple) else t.terminal for t in tokens]
        self.at = [t.at for t in tokens]
        self.fresh = [t.fresh for t in tokens]
        self.size = len(tokens)
        self._ends = [m.start() for m in re.finditer("\n", text)]
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for i, kind in enumerate(self.kinds):
            if kind in _OPEN:
                stack.append(i)
            elif kind in _CLOSE and stack:
                self.match[stack.pop()] = i
        self.broken = bool(stack) or "ERR" in self.kinds
        self.facts: list[dict] = []
        self.scopes: list[tuple[int, int, str]] = []  # token range and symbol path of functions and classes
        self.typed: list[tuple[int, int]] = []  # token ranges that hold types only, so no calls

    def line(self, i: int) -> int:
        at = self.at[i] if i < self.size else len(self.text)
        return bisect.bisect_left(self._ends, at) + 1

    def word(self, i: int) -> str:
        """The text of an identifier or string token."""
        if not 0 <= i < self.size:
            return ""
        if self.kinds[i] == "STR":
            quote = re.match(r"[A-Za-z#]*(\"\"\"|'''|\"|'|`)", self.text[self.at[i] : self.at[i] + 8])
            mark = quote.group(1) if quote else '"'
            start = self.at[i] + (quote.end() if quote else 1)
            return self.text[start : self.text.find(mark, start)]
        found = (_IDENT if self.lang == "hcl" else _PLAIN).match(self.text, self.at[i])
        return found.group() if found else ""

    def find(self, i: int, kinds: tuple[str, ...], stop: int) -> int:
        """The next token of `kinds` at this depth, or stop."""
        while i < stop:
            if self.kinds[i] in kinds:
                return i
            i = self.match.get(i, i) + 1
        return stop

    def end_of_statement(self, i: int, stop: int) -> int:
        """The token behind a statement that ends with ';' or, in scripts, at a fresh line that can't go on."""
        while i < stop:
            if self.kinds[i] == ";":
                return i + 1
            i = self.match.get(i, i) + 1
            if i < stop and self.fresh[i] and self.lang in ("ts", "tsx", "js", "jsx") and self.kinds[i] not in (".", "?", ":", "=", "+", "=>", "?.", "&&", "||", "??", "(", "["):
                if self.kinds[i - 1] not in ("=", ",", "=>", "+", ":", "?", "&&", "||", "??", "("):
                    return i
        return stop

    def add(self, fact: str, **values) -> None:
        self.facts.append({"repo": self.repo, "file": self.file, "fact": fact} | values)

    def declare(self, name: str, kind: str, first: int, head: int, last: int, exported: bool, parent: str | None = None, **more) -> None:
        """A declaration whose header ends before token `head` and whose text ends with token `last`."""
        text = self.text[self.at[first] : self.at[head] if head < self.size else len(self.text)]
        self.add("decl", name=f"{parent}.{name}" if parent else name, kind=kind, parent=parent, signature=_signature(text.rstrip(" {;=\n\t")), exported=exported, start_line=self.line(first), end_line=self.line(min(last, self.size - 1)), **more)

    def calls(self) -> None:
        """Call sites: name(…), object.name(…) and new Name(…), with the innermost function around them."""
        declared = {start for start, _, _ in self.scopes}
        for i in range(1, self.size):
            if self.kinds[i] not in ("(", "TEMPLATE") or self.kinds[i - 1] != "ID" or i - 1 in declared or self.words[i - 1] in _NO_CALL:
                continue
            start, parts = i - 1, [self.word(i - 1)]
            while start >= 2 and self.kinds[start - 1] in (".", "?.", "::") and self.kinds[start - 2] in ("ID", "this", "super", "self"):
                parts.insert(0, self.word(start - 2))
                start -= 2
            if any(a <= i <= b for a, b in self.typed):
                continue
            if start and self.kinds[start - 1] in (".", "?.", "::", "function", "func", "fn", "class"):
                continue  # a member of something that is no plain name, or a declaration
            callee = ".".join("this" if p == "self" else p for p in parts[-2:])
            if len(parts) > 2:
                continue
            if start and self.kinds[start - 1] == "new":
                callee = f"new {callee}"
            around = [s for s in self.scopes if s[0] <= i <= s[1]]
            caller = max(around, key=lambda s: s[0])[2] if around else None
            self.add("call", caller=caller, callee=callee, line=self.line(i - 1))


def _scope(r: _Reader, name: str, head: int, stop: int) -> None:
    r.scopes.append((head, stop, name))


def _script_imports(r: _Reader, i: int, stop: int) -> None:
    """import … from '…' and its kinds, from token i (import or export) to stop."""
    reexport = r.words[i] == "export"
    strings = [k for k in range(i, stop) if r.kinds[k] == "STR"]
    if not strings:
        return
    type_only = i + 1 < stop and r.words[i + 1] == "type" and r.kinds[i + 2] != "from"
    names, locals_ = [], []
    k = i + 1 + type_only
    if r.kinds[k] == "STR":
        r.add("import", specifier=r.word(k), import_kind="side-effect", symbols=[], locals=[], reexport=False, line=r.line(i))
        return
    while k < strings[-1] and r.words[k] != "from":
        if r.kinds[k] == "*":
            names.append("*")
            locals_.append(r.word(k + 2) if r.words[k + 1] == "as" else "*")
            k += 3 if r.words[k + 1] == "as" else 1
        elif r.kinds[k] == "{":
            close = r.match.get(k, strings[-1])
            part = k + 1
            while part < close:
                if r.words[part] == "type" and r.kinds[part + 1] not in (",", "}") and r.words[part + 1] != "as":
                    part += 1
                name = r.word(part)
                local = r.word(part + 2) if r.words[part + 1] == "as" else name
                names.append(name)
                locals_.append(local)
                part = r.find(part, (",",), close) + 1
            k = close + 1
        elif r.kinds[k] == "ID":
            names.append("default")
            locals_.append(r.word(k))
            k += 1
        else:
            k += 1
    r.add("import", specifier=r.word(strings[-1]), import_kind="type" if type_only else "static", symbols=names, locals=locals_, reexport=reexport, line=r.line(i))
    if reexport:
        for name, local in zip(names, locals_):
            star = name == "*" and local == "*"
            r.add("export", name="*" if star else local, kind="star" if star else "named", specifier=r.word(strings[-1]), signature=name)


def _script(r: _Reader, i: int = 0, stop: int | None = None, parent: str | None = None) -> None:
    stop = r.size if stop is None else stop
    while i < stop:
        first, exported, default = i, False, False
        if r.words[i] == "import" and r.kinds[i + 1 : i + 2] not in (["("], ["."]):
            end = r.end_of_statement(i, stop)
            _script_imports(r, i, end)
            i = end
            continue
        if r.words[i] == "export":
            exported, i = True, i + 1
            if r.words[i] == "default":
                default, i = True, i + 1
            elif r.kinds[i] in ("{", "*") or r.words[i] == "type" and r.kinds[i + 1] in ("{", "*"):
                end = r.end_of_statement(i, stop)
                if any(r.words[k] == "from" for k in range(i, end)):
                    _script_imports(r, first, end)
                else:
                    open_ = r.find(i, ("{",), end) if r.kinds[i] != "{" else i
                    part = open_ + 1
                    while part < r.match.get(open_, open_):
                        local = r.word(part)
                        r.add("export", name=r.word(part + 2) if r.words[part + 1] == "as" else local, kind="named", signature=local)
                        part = r.find(part, (",",), r.match[open_]) + 1
                i = end
                continue
        while i < stop and r.words[i] in ("declare", "abstract", "async") and r.kinds[i + 1 : i + 2] not in (["="], ["("], ["."]):
            i += 1
        if i >= stop:
            return
        word = r.words[i]
        if word == "const" and r.words[i + 1 : i + 2] == ["enum"]:
            i, word = i + 1, "enum"
        name = None
        if word == "function":
            k = i + 1 + (r.kinds[i + 1 : i + 2] == ["*"])
            name = r.word(k) if r.kinds[k : k + 1] == ["ID"] else "default"
            body = r.find(k, ("{",), stop)
            last = r.match.get(body, body)
            path = f"{parent}.{name}" if parent else name
            component = r.lang in ("tsx", "jsx") and name[:1].isupper() and "JSX_LT" in r.kinds[body:last]
            r.declare(name, "component" if component else "function", first, body, last, exported, parent)
            _scope(r, path, k, last)
            i = last + 1
        elif word == "class":
            name = r.word(i + 1) if r.kinds[i + 1 : i + 2] == ["ID"] else "default"
            body = r.find(i + 1, ("{",), stop)
            last = r.match.get(body, body)
            base = next((r.word(k + 1) + (f".{r.word(k + 3)}" if r.kinds[k + 2] == "." else "") for k in range(i, body) if r.words[k] == "extends"), None)
            r.declare(name, "class", first, body, last, exported, parent, extends=base)
            _scope(r, f"{parent}.{name}" if parent else name, body, last)
            _members(r, body + 1, last, f"{parent}.{name}" if parent else name)
            i = last + 1
        elif word in ("interface", "enum", "namespace", "module") and r.kinds[i + 1 : i + 2] == ["ID"]:
            name = r.word(i + 1)
            body = r.find(i + 1, ("{",), stop)
            last = r.match.get(body, body)
            r.declare(name, "namespace" if word in ("namespace", "module") else word, first, body, last, exported, parent)
            if word == "interface":
                r.typed.append((body, last))
            if word in ("namespace", "module"):
                _script(r, body + 1, last, f"{parent}.{name}" if parent else name)
            i = last + 1
        elif word == "type" and r.kinds[i + 1 : i + 2] == ["ID"]:
            name, end = r.word(i + 1), r.end_of_statement(i, stop)
            r.declare(name, "type", first, r.find(i, ("=",), end), end - 1, exported, parent)
            r.typed.append((i, end - 1))
            i = end
        elif word in ("const", "let", "var"):
            end = r.end_of_statement(i, stop)
            k = i + 1
            while k < end:
                if r.kinds[k] == "ID":
                    name = r.word(k)
                    r.declare(name, word, first, min(end, r.find(k, ("=", ",", ";"), end)), end - 1, exported, parent)
                    arrow = next((j for j in range(k, end) if r.kinds[j] == "=>"), None)
                    if arrow is not None or any(r.words[j] == "function" for j in range(k, end)):
                        _scope(r, f"{parent}.{name}" if parent else name, k, end)
                    if exported and not parent:
                        r.add("export", name=name, kind="named", signature=name)
                k = r.find(k, (",",), end) + 1
            i, name = end, None
        elif default:
            end = r.end_of_statement(i, stop)
            r.add("export", name="default", kind="default", signature=r.word(i) if r.kinds[i] == "ID" else None)
            i, default = end, False
        else:
            i = r.end_of_statement(i, stop) if r.kinds[i] not in _OPEN else r.match.get(i, i) + 1
            i = max(i, first + 1)
        if exported and not parent and name:
            r.add("export", name="default" if default else name, kind="default" if default else "named", signature=name)
        i = max(i, first + 1)


def _members(r: _Reader, i: int, stop: int, parent: str) -> None:
    """Methods (and function-valued fields) of a script class."""
    while i < stop:
        first = i
        while i < stop and (r.words[i] in ("static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "accessor", "declare") and r.kinds[i + 1] not in ("(", "=", ";", ":") or r.kinds[i] == "*"):
            i += 1
        if i < stop and r.kinds[i] in ("ID", "PRIV") or i < stop and r.kinds[i + 1 : i + 2] == ["("]:
            name = r.word(i) or "#" + r.word(i + 1)
            seen = {r.words[k] for k in range(first, i)}
            k = r.find(i + 1, ("(", "=", ";", ":"), stop)
            body = r.find(k, ("{", ";"), stop)
            if k < stop and r.kinds[k] == "(":
                last = r.match.get(body, body)
                r.declare(name, "method", first, body, last, False, parent, extends=None)
                r.facts[-1]["import_kind"] = next((v for v in ("private", "protected") if v in seen), "public")
                _scope(r, f"{parent}.{name}", i, last)
                i = last + 1
                continue
            r.add("member", name=name, parent=parent)  # a field: it hides what a base declares
            i = r.end_of_statement(i, stop)
        else:
            i = (r.match.get(i, i) if r.kinds[i] in _OPEN else i) + 1 if i < stop else stop
        i = max(i, first + 1)


def _go(r: _Reader) -> None:
    i = 0
    upper = lambda n: n[:1].isupper()
    while i < r.size:
        word, first = r.words[i], i
        if word == "import":
            stop = r.match.get(i + 1, i) if r.kinds[i + 1] == "(" else r.find(i, (";",), r.size)
            for k in range(i, stop):
                if r.kinds[k] == "STR":
                    spec = r.word(k)
                    alias = r.word(k - 1) if r.kinds[k - 1] == "ID" else "." if r.kinds[k - 1] == "." else spec.rpartition("/")[2]
                    r.add("import", specifier=spec, import_kind="side-effect" if alias == "_" else "static", symbols=["*"], locals=[alias], reexport=False, line=r.line(k))
            i = stop + 1
        elif word == "func":
            k, owner = i + 1, None
            if r.kinds[k] == "(":
                close = r.match.get(k, k)
                owner = next((r.word(j) for j in range(close - 1, k, -1) if r.kinds[j] == "ID"), None)
                k = close + 1
            name = r.word(k)
            body = r.find(k + 1, ("{", ";"), r.size)
            last = r.match.get(body, body)
            r.declare(name, "method" if owner else "function", first, body, last, upper(name), owner)
            _scope(r, f"{owner}.{name}" if owner else name, k, last)
            _go_locals(r, k + 1, body, last, f"{owner}.{name}" if owner else name)
            if not owner and upper(name):
                r.add("export", name=name, kind="named", signature=name)
            i = last + 1
        elif word in ("type", "const", "var"):
            grouped = r.kinds[i + 1] == "("
            stop = r.match.get(i + 1, i) if grouped else r.find(i, (";",), r.size)
            k = i + 1 + grouped
            while k < stop:
                if r.kinds[k] == "ID":
                    name = r.word(k)
                    end = r.find(k, (";",), stop)
                    kind = next((w for w in ("struct", "interface") if w in r.words[k:end]), "type") if word == "type" else word
                    if kind == "interface":
                        r.typed.append((k, end))
                    elif kind == "struct" and r.kinds[k + 2 : k + 3] == ["{"]:
                        _go_fields(r, k + 3, r.match.get(k + 2, end), name)
                    r.declare(name, kind, k if grouped else first, r.find(k, ("{", "=", ";"), end), end - 1, upper(name))
                    if upper(name):
                        r.add("export", name=name, kind="named", signature=name)
                    k = end + 1
                else:
                    k += 1
            i = stop + 1
        else:
            i = r.match.get(i, i) + 1


def _go_fields(r: _Reader, i: int, stop: int, owner: str) -> None:
    """The fields of a struct, and the types it embeds, whose fields and methods it promotes."""
    while i < stop:
        end = r.find(i, (";",), stop)
        k = i + (r.kinds[i] == "*")
        last = k + 2 if r.kinds[k + 1 : k + 2] == ["."] else k
        if r.kinds[k] == "ID" and (last + 1 >= end or r.kinds[last + 1] == "STR"):
            r.add("embed", parent=owner, callee=".".join(r.word(j) for j in range(k, last + 1, 2)))
            r.add("member", name=r.word(last), parent=owner)
        else:
            while k < end and r.kinds[k] == "ID":
                r.add("member", name=r.word(k), parent=owner)
                if r.kinds[k + 1] != ",":
                    break
                k += 2
        i = end + 1


def _go_locals(r: _Reader, i: int, body: int, last: int, caller: str) -> None:
    """Names that a Go function binds, with `type T` or `call f` where that is written down; they hide package names."""
    note = lambda name, kind, text: r.add("local", caller=caller, name=name, kind=kind, callee=text and "".join(text.split()).lstrip("*&"))
    close = r.match.get(i, i)
    k, waiting = i + 1, []
    while k < close:
        end = r.find(k, (",",), close)
        if r.kinds[k] == "ID":
            if end - k == 1:
                waiting.append(r.word(k))
            else:
                text = r.text[r.at[k + 1] : r.at[end]]
                for name in [*waiting, r.word(k)]:
                    note(name, "type", text)
                waiting = []
        k = end + 1
    for j in range(body, last):
        if r.kinds[j] == ":=":
            names, k = [], j - 1
            while k > body and r.kinds[k] == "ID":
                names.insert(0, r.word(k))
                k -= 2 if r.kinds[k - 1] == "," else 1
                if r.kinds[k + 1] != ",":
                    break
            k = j + 1 + (r.kinds[j + 1] == "&")
            end = k + 2 if r.kinds[k + 1 : k + 2] == ["."] else k
            what = {"(": "call", "{": "type"}.get(r.kinds[end + 1]) if r.kinds[k] == "ID" and r.kinds[end] == "ID" else None
            for place, name in enumerate(names):
                note(name, what if place == 0 else None, r.text[r.at[k] : r.at[end + 1]] if what and place == 0 else None)
        elif r.words[j] == "var" and r.kinds[j + 1] == "ID":
            end = r.find(j, ("=", ";"), last)
            note(r.word(j + 1), "type" if end > j + 2 else None, r.text[r.at[j + 2] : r.at[end]] if end > j + 2 else None)


def _java(r: _Reader, i: int = 0, stop: int | None = None, parent: str | None = None, open_: bool = True) -> None:
    stop = r.size if stop is None else stop
    modifiers = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default sealed".split())
    while i < stop:
        first = i
        if r.words[i] in ("import", "package"):
            end = r.find(i, (";",), stop)
            if r.words[i] == "import":
                static = r.words[i + 1] == "static"
                spec = "".join(r.text[r.at[i + 1 + static] : r.at[end]].split())
                name = "*" if spec.endswith("*") else spec.rpartition(".")[2]
                r.add("import", specifier=spec, import_kind="static", symbols=[name], locals=[name], reexport=False, line=r.line(i))
            i = end + 1
            continue
        seen = set()
        while i < stop and (r.words[i] in modifiers or r.kinds[i] == "@" and r.words[i + 1] != "interface"):
            if r.kinds[i] == "@":
                i += 2
                while i < stop and r.kinds[i] == ".":
                    i += 2
                if i < stop and r.kinds[i] == "(":
                    i = r.match.get(i, i) + 1
            else:
                seen.add(r.words[i])
                i += 1
        if i >= stop:
            return
        public = open_ and "public" in seen
        word = r.words[i]
        if r.kinds[i] == "@":
            i, word = i + 1, "interface"
        if word in ("class", "interface", "enum", "record") and r.kinds[i + 1 : i + 2] == ["ID"]:
            name = r.word(i + 1)
            body = r.find(i + 1, ("{", ";"), stop)
            last = r.match.get(body, body)
            base = next((r.word(k + 1) for k in range(i, body) if r.words[k] == "extends"), None)
            r.declare(name, word, first, body, last, public, parent, extends=base)
            if public:
                r.add("export", name=f"{parent}.{name}" if parent else name, kind="named", signature=name)
            _java(r, body + 1, last, f"{parent}.{name}" if parent else name, public)
            i = last + 1
            continue
        end = r.find(i, (";", "{"), stop)
        call = r.find(i, ("(",), end)
        equal = r.find(i, ("=",), end)
        if parent and call < min(end, equal) and r.kinds[call - 1] == "ID":
            name, last = r.word(call - 1), r.match.get(end, end)
            r.declare(name, "method", first, end, last, public, parent)
            _scope(r, f"{parent}.{name}", call - 1, last)
            i = last + 1
        elif parent and r.kinds[i] not in _OPEN and end < stop:
            end = r.find(i, (";",), stop)
            place = min(equal, end) - 1
            if r.kinds[place] == "ID":
                r.declare(r.word(place), "const" if {"static", "final"} <= seen else "var", first, place + 1, end, public, parent)
            i = end + 1
        else:
            i = r.match.get(i, i) + 1
        i = max(i, first + 1)


def _kotlin(r: _Reader, i: int = 0, stop: int | None = None, parent: str | None = None, open_: bool = True) -> None:
    """Kotlin: public unless private or internal; extensions are `Receiver.name`, companions `Outer.Companion`."""
    stop = r.size if stop is None else stop
    modifiers = frozenset("public private protected internal open abstract final sealed data enum annotation override suspend inline operator infix const lateinit inner companion tailrec external vararg".split())
    while i < stop:
        first = i
        if r.words[i] in ("import", "package") and not parent and r.kinds[i + 1 : i + 2] == ["ID"]:
            end = i + 1
            while end + 2 < stop + 1 and r.kinds[end + 1 : end + 2] == ["."]:
                end += 2
            if r.words[i] == "package":
                r.add("package", name=".".join(r.word(k) for k in range(i + 1, end + 1, 2)))
            if r.words[i] == "import":
                spec = "".join(r.text[r.at[i + 1] : r.at[end + 1] if end + 1 < r.size else len(r.text)].split())
                local = r.word(end + 2) if r.words[end + 1 : end + 2] == ["as"] else spec.rpartition(".")[2]
                spec = spec.removesuffix("as" + local) if r.words[end + 1 : end + 2] == ["as"] else spec
                name = spec.rpartition(".")[2]
                r.add("import", specifier=spec, import_kind="static", symbols=[name], locals=[local], reexport=False, line=r.line(i))
                end += 2 * (r.words[end + 1 : end + 2] == ["as"])
            i = end + 1
            continue
        seen = set()
        while i < stop and (r.words[i] in modifiers and r.kinds[i + 1] not in ("=", ".", "(", ":") or r.kinds[i] == "@"):
            if r.kinds[i] == "@":
                i += 2
                i = r.match.get(i, i) + 1 if i < stop and r.kinds[i] == "(" else i
            else:
                seen.add(r.words[i])
                i += 1
        if i >= stop:
            return
        word = r.words[i]
        public = open_ and not seen & {"private", "internal"}
        if word in ("class", "interface", "object") and (r.kinds[i + 1 : i + 2] == ["ID"] or "companion" in seen):
            name = r.word(i + 1) if r.kinds[i + 1 : i + 2] == ["ID"] else "Companion"
            body = r.find(i + 1, ("{",), stop)
            fresh = next((k for k in range(i + 2, body) if r.fresh[k] and r.kinds[k] not in (":", ",", "(", ")", "<") and r.kinds[k - 1] not in (":", ",", "(")), None)
            bare = body >= stop or fresh is not None and r.words[fresh] in modifiers | {"class", "fun", "val", "var", "interface", "object", "typealias"}
            last = (fresh or stop) - 1 if bare else r.match.get(body, body)
            kind = "enum" if "enum" in seen else "record" if "data" in seen else "class" if word == "object" else word
            r.declare(name, kind, first, last + 1 if bare else body, last, public, parent)
            path = f"{parent}.{name}" if parent else name
            if public:
                r.add("export", name=path, kind="named", signature=name)
            if not bare:
                _kotlin(r, body + 1, last, path, public)
            i = last + 1
        elif word == "fun":
            k = r.find(i + 1, ("(",), stop)
            name = r.word(k - 1)
            owner = r.word(k - 3) if r.kinds[k - 2 : k - 1] == ["."] and k - 3 > i else parent
            after = r.match.get(k, k) + 1
            body = next((j for j in range(after, stop) if r.kinds[j] in ("{", "=") or r.fresh[j] and r.kinds[j] != ":"), stop)
            last = r.match.get(body, body) if body < stop and r.kinds[body] == "{" else next((j - 1 for j in range(body + 1, stop) if r.fresh[j] and r.kinds[j] not in (".", "?.", "?:")), stop - 1) if body < stop and r.kinds[body] == "=" else body - 1
            r.declare(name, "method" if owner else "function", first, body, last, public, owner)
            _scope(r, f"{owner}.{name}" if owner else name, k - 1, last)
            if public and not owner:
                r.add("export", name=name, kind="named", signature=name)
            i = last + 1
        elif word in ("val", "var", "typealias") and r.kinds[i + 1 : i + 2] == ["ID"]:
            name = r.word(i + 1)
            last = next((j - 1 for j in range(i + 2, stop) if r.kinds[j] == ";" or r.fresh[j] and r.kinds[j] not in (".", "?.", "?:", ":", "=")), stop - 1)
            r.declare(name, {"val": "const", "var": "var"}.get(word, "type"), first, min(r.find(i + 2, ("=",), last + 1), last + 1), last, public, parent)
            if public and not parent:
                r.add("export", name=name, kind="named", signature=name)
            i = last + 1
        else:
            i = r.match.get(i, i) + 1
        i = max(i, first + 1)


def _rust(r: _Reader, i: int = 0, stop: int | None = None, parent: str | None = None, module: str = "") -> None:
    stop = r.size if stop is None else stop
    kinds = {"struct": "struct", "union": "struct", "enum": "enum", "trait": "trait", "type": "type", "const": "const", "static": "var", "mod": "module", "fn": "function"}
    while i < stop:
        first = i
        while i < stop and r.kinds[i] == "#":
            i = r.match.get(i + 1 + (r.kinds[i + 1] == "!"), i) + 1
        exported = i < stop and r.words[i] == "pub"
        if exported:
            i += 1
            if r.kinds[i] == "(":
                i = r.match.get(i, i) + 1
        while i < stop and r.words[i] in ("async", "unsafe", "extern", "default") or i < stop and r.words[i] == "const" and r.words[i + 1] in ("fn", "unsafe", "async") or i < stop and r.kinds[i] == "STR":
            i += 1
        if i >= stop:
            return
        word = r.words[i]
        path = lambda n: f"{module}::{n}" if module else n
        if word == "use":
            end = r.find(i, (";",), stop)
            for spec, name, local in _use_tree(r, i + 1, end, ""):
                r.add("import", specifier=spec, import_kind="static", symbols=[name], locals=[local], reexport=exported, line=r.line(i))
                if exported:
                    r.add("export", name="*" if name == "*" else local, kind="star" if name == "*" else "named", specifier=spec, signature=name)
            i = end + 1
        elif word == "impl":
            body = r.find(i, ("{",), stop)
            names = [k for k in range(i + 1, body) if r.kinds[k] == "ID"]
            split = next((k for k in range(i, body) if r.words[k] == "for"), None)
            names = [k for k in names if split is None or k > split]
            _rust(r, body + 1, r.match.get(body, body), r.word(names[0]) if names else None, module)
            i = r.match.get(body, body) + 1
        elif word in kinds and r.kinds[i + 1 : i + 2] == ["ID"]:
            name = r.word(i + 1)
            end = r.find(i + 1, ("{", ";", "=") if word in ("const", "static", "type") else ("{", ";"), stop)
            last = r.match.get(end, end) if r.kinds[end : end + 1] != ["="] else r.find(end, (";",), stop)
            kind = "method" if word == "fn" and parent else kinds[word]
            r.declare(path(name), kind, first, end, last, exported, parent)
            if word == "fn":
                _scope(r, f"{parent}.{name}" if parent else path(name), i + 1, last)
            elif word == "mod" and r.kinds[end] == "{":
                _rust(r, end + 1, last, None, path(name))
            elif word == "mod":
                r.add("import", specifier=f"mod {name}", import_kind="static", symbols=[], locals=[], reexport=False, line=r.line(i))
            if exported and not parent:
                r.add("export", name=path(name), kind="named", signature=name)
            i = last + 1
        else:
            i = r.match.get(i, i) + 1
        i = max(i, first + 1)


def _use_tree(r: _Reader, i: int, stop: int, prefix: str) -> list[tuple[str, str, str]]:
    parts = [prefix] if prefix else []
    while i < stop:
        if r.kinds[i] == "{":
            out, part, close = [], i + 1, r.match.get(i, stop)
            while part < close:
                end = r.find(part, (",",), close)
                out += _use_tree(r, part, end, "::".join(parts))
                part = end + 1
            return out
        if r.kinds[i] == "*":
            return [("::".join([*parts, "*"]), "*", "*")]
        if r.kinds[i] != "::":
            parts.append(r.word(i))
            if r.words[i + 1 : i + 2] == ["as"] and i + 2 < stop:
                return [("::".join(parts), parts[-1], r.word(i + 2))]
        i += 1
    return [("::".join(parts), parts[-1], parts[-1])] if parts else []


def _hcl(r: _Reader) -> None:
    i = 0
    while i < r.size:
        if r.kinds[i] != "ID":
            i = r.match.get(i, i) + 1
            continue
        first, word = i, r.word(i)
        labels = []
        while r.kinds[i + 1 : i + 2] in (["STR"], ["ID"]):
            labels.append(r.word(i + 1))
            i += 1
        if r.kinds[i + 1 : i + 2] != ["{"]:
            i = r.find(first, ("NL",), r.size) + 1
            continue
        last = r.match.get(i + 1, r.size - 1)
        kind = {"resource": "resource", "data": "data", "variable": "variable", "output": "output", "module": "module", "provider": "provider"}.get(word)
        if kind and labels:
            name = f"{kind}.{'.'.join(labels)}"
            r.declare(name, kind, first, i + 1, last, kind in ("output", "variable"))
            if kind in ("output", "variable"):
                r.add("export", name=name, kind="named", signature=name)
        elif word == "locals":
            k = i + 2
            while k < last:
                if r.kinds[k] == "ID" and r.kinds[k + 1] == "=":
                    name = f"local.{r.word(k)}"
                    end = r.find(k, ("NL",), last)
                    r.declare(name, "local", k, k + 1, end - 1, False)
                k = r.find(k, ("NL",), last) + 1
            name = None
        else:
            name = None
        for k in range(i + 2, last):
            if kind == "module" and r.kinds[k] == "ID" and r.word(k) == "source" and r.kinds[k + 1 : k + 3] == ["=", "STR"]:
                r.add("import", specifier=r.word(k + 2), import_kind="static", symbols=[], locals=[], reexport=False, line=r.line(k))
            if r.kinds[k] == "STR":
                for ref in re.finditer(r"\$\{\s*((?:var|local|module|data|[a-z]\w*)(?:\.[A-Za-z_][\w-]*)+)", r.word(k)):
                    r.add("ref", caller=name, callee=ref.group(1), kind="hcl-ref", line=r.line(k))
            elif r.kinds[k] == "ID" and r.kinds[k + 1 : k + 2] == ["."] and r.kinds[k - 1] != "." and r.word(k) not in ("each", "count", "self", "path", "terraform"):
                end = k
                while r.kinds[end + 1 : end + 3] == [".", "ID"]:
                    end += 2
                r.add("ref", caller=name, callee=".".join(r.word(j) for j in range(k, end + 1, 2)), kind="hcl-ref", line=r.line(k))
        i = last + 1


def _dynamic(r: _Reader) -> None:
    """import('…') and require('…') with a literal argument."""
    for i in range(r.size - 2):
        if r.kinds[i + 1] == "(" and r.kinds[i + 2] == "STR" and r.kinds[i + 3 : i + 4] == [")"]:
            if r.words[i] == "import":
                names = _taken_apart(r, i)
                r.add("import", specifier=r.word(i + 2), import_kind="dynamic", symbols=names or ["*"], locals=names, reexport=False, line=r.line(i))
            elif r.kinds[i] == "ID" and r.word(i) == "require":
                r.add("import", specifier=r.word(i + 2), import_kind="static", symbols=["*"], locals=[], reexport=False, line=r.line(i))


def _taken_apart(r: _Reader, i: int) -> list[str]:
    """The names of `const { a, b } = await import(…)`, where token i is the import."""
    k = i - 1 - (r.words[i - 1] == "await")
    if k < 1 or r.kinds[k] != "=" or r.kinds[k - 1] != "}":
        return []
    open_ = next((a for a, b in r.match.items() if b == k - 1), k)
    return [r.word(j) for j in range(open_ + 1, k - 1) if r.kinds[j] == "ID" and r.kinds[j - 1] in ("{", ",")]


class _PythonFacts(ast.NodeVisitor):
    def __init__(self, repo: str, file: str, text: str, tree: ast.Module):
        self.repo, self.file, self.lines, self.facts = repo, file, text.splitlines(), []
        self.stack: list[tuple[str, str]] = []
        self.named = next((set(ast.literal_eval(n.value)) for n in tree.body if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets) and isinstance(n.value, (ast.List, ast.Tuple)) and all(isinstance(e, ast.Constant) for e in n.value.elts)), None)
        self.typing = 0

    def add(self, fact: str, **values) -> None:
        self.facts.append({"repo": self.repo, "file": self.file, "fact": fact} | values)

    def open_name(self, name: str) -> bool:
        return name in self.named if self.named is not None else not name.startswith("_")

    def declare(self, node: ast.AST, name: str, kind: str, **more) -> None:
        parent = self.stack[-1][1] if self.stack else None
        full = f"{parent}.{name}" if parent else name
        exported = not self.stack and self.open_name(name)
        body = getattr(node, "body", None)
        stop = body[0].lineno - 1 if isinstance(body, list) and body[0].lineno > node.lineno else node.lineno
        head = " ".join(self.lines[node.lineno - 1 : max(stop, node.lineno)]).split("#")[0]
        self.add("decl", name=full, kind=kind, parent=parent, signature=_signature(head.rstrip().rstrip(":")), exported=exported, start_line=min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))]), end_line=node.end_lineno, **more)
        if exported:
            self.add("export", name=name, kind="named", signature=name)

    def visit_FunctionDef(self, node) -> None:  # noqa: N802
        inside = self.stack and self.stack[-1][0] == "function"
        if not inside:
            self.declare(node, node.name, "method" if self.stack else "function")
        self.stack.append(("function", self.stack[-1][1] if inside else f"{self.stack[-1][1]}.{node.name}" if self.stack else node.name))
        self.generic_visit(node)
        self.stack.pop()

    visit_AsyncFunctionDef = visit_FunctionDef  # noqa: N815

    def visit_ClassDef(self, node) -> None:  # noqa: N802
        if self.stack and self.stack[-1][0] == "function":
            return
        base = next((ast.unparse(b) for b in node.bases), None)
        self.declare(node, node.name, "class", extends=base)
        self.stack.append(("class", f"{self.stack[-1][1]}.{node.name}" if self.stack else node.name))
        self.generic_visit(node)
        self.stack.pop()

    def visit_Assign(self, node) -> None:  # noqa: N802
        if not self.stack:
            for target in node.targets:
                if isinstance(target, ast.Name) and target.id != "__all__":
                    self.declare(node, target.id, "const" if target.id.isupper() else "var")
        self.generic_visit(node)

    def visit_If(self, node) -> None:  # noqa: N802
        typing = isinstance(node.test, (ast.Name, ast.Attribute)) and ast.unparse(node.test).endswith("TYPE_CHECKING")
        self.typing += typing
        for child in node.body:
            self.visit(child)
        self.typing -= typing
        for child in node.orelse:
            self.visit(child)
        self.visit(node.test)

    def visit_Import(self, node) -> None:  # noqa: N802
        for alias in node.names:
            self.add("import", specifier=alias.name, import_kind="type" if self.typing else "static", symbols=["*"], locals=[alias.asname or alias.name.split(".")[0]], reexport=False, line=node.lineno)

    def visit_ImportFrom(self, node) -> None:  # noqa: N802
        spec = "." * node.level + (node.module or "")
        kind = "type" if self.typing or spec == "__future__" else "static"
        self.add("import", specifier=spec, import_kind=kind, symbols=[a.name for a in node.names], locals=[a.asname or a.name for a in node.names], reexport=False, line=node.lineno)

    def visit_Call(self, node) -> None:  # noqa: N802
        f = node.func
        callee = f.id if isinstance(f, ast.Name) else f"{'this' if f.value.id == 'self' else f.value.id}.{f.attr}" if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) else None
        if callee:
            self.add("call", caller=self.stack[-1][1] if self.stack else None, callee=callee, line=node.lineno)
        self.generic_visit(node)


def facts_of(repo: str | None, file: str, lang: str, text: str) -> list[dict]:
    """The facts of one file; a single `unparsable` fact where it can't be read."""
    if lang == "python":
        try:
            tree = ast.parse(text)
            visitor = _PythonFacts(repo, file, text, tree)
            visitor.visit(tree)
            return visitor.facts
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return [{"repo": repo, "file": file, "fact": "unparsable"}]
    r = _Reader(repo, file, lang, text)
    if r.broken:
        return [{"repo": repo, "file": file, "fact": "unparsable"}]
    try:
        {"go": _go, "java": _java, "rust": _rust, "hcl": _hcl, "kotlin": _kotlin}.get(lang, _script)(r)
        if lang in ("ts", "tsx", "js", "jsx"):
            _dynamic(r)
        if lang != "hcl":
            r.calls()
    except IndexError:  # the tokens end inside a declaration
        return [{"repo": repo, "file": file, "fact": "unparsable"}]
    return r.facts


def _batches(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import warnings

    warnings.simplefilter("ignore", SyntaxWarning)
    for batch in rows:
        found = []
        for repo, path, lang, source in zip(*(batch[c].tolist() for c in ("repo", "path", "lang", "source"))):
            found += facts_of(repo, path, lang, source)
        yield pd.DataFrame({c: pd.Series([f.get(c) for f in found], dtype=_DTYPES.get(c, object)) for c in _COLUMNS})


def extract_facts(files: DataFrame) -> DataFrame:
    """All facts of files (repo, path, source); the language comes from the path. Null sources, mappable paths only.

    Equal sources under equal paths are read once per row given; pass one row per path. Files of other
    languages, null sources and paths that can't be ids give no rows.
    """
    rows = files.where(F.col("source").isNotNull() & ~F.col("path").rlike(r"[#\n\x00]")).select("repo", "path", lang_of(F.col("path")).alias("lang"), "source")
    return spread(rows.where(F.col("lang").isin("python", *_LEXER_OF))).mapInPandas(_batches, FACT_SCHEMA)
