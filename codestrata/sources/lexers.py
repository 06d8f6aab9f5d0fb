"""Lexers: source text to (terminal, offset, newline-before) tokens.

A terminal is the text of a keyword or mark, or a class (ID, NUM, STR ...). A contextual keyword is a
tuple (keyword, "ID"). Text that is no token of the language, such as a string without its end, becomes ERR.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    terminal: str | tuple[str, str]
    at: int
    fresh: bool  # the first token of its line


_NUMBER = r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)"


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


# The reserved and the contextual words of each language.
JS_RESERVED = _words(
    "break case catch class const continue debugger default delete do else export extends false finally for function if import in "
    "instanceof new null return super switch this throw true try typeof var void while with enum"
)
JS_CONTEXT = _words("accessor as async await from get let of set static using yield")
TS_CONTEXT = JS_CONTEXT | _words(
    "abstract asserts declare global implements infer interface is keyof module namespace out override private protected public readonly require satisfies type unique"
)
GO_RESERVED = _words(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"
)
JAVA_RESERVED = _words(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements "
    "import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw "
    "throws transient try void volatile while true false null"
)
JAVA_CONTEXT = _words("record sealed permits yield var when module exports requires opens uses provides with to transitive open")
RUST_RESERVED = _words(
    "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static "
    "struct super trait true type unsafe use where while"
)
RUST_CONTEXT = _words("union auto default macro_rules")
PYTHON_RESERVED = _words(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"
)
PYTHON_CONTEXT = _words("match case type")
KOTLIN_RESERVED = _words(
    "as break class continue do else false for fun if in interface is null object package return super this throw true try typealias val var when while"
)
KOTLIN_CONTEXT = _words(
    "import enum data sealed open abstract final private protected internal public override companion suspend inline operator infix const lateinit inner annotation tailrec external by get set init constructor vararg"
)
HCL_RESERVED = _words("for in if true false null")


class Simple:
    """A lexer of one master pattern, with named groups: skip, bad, str, char, num, id, op and more."""

    def __init__(self, pattern: str, reserved: frozenset[str], context: frozenset[str] = frozenset()):
        self.pattern = re.compile(pattern, re.VERBOSE | re.DOTALL)
        self.map: dict[str, str | tuple[str, str]] = {w: w for w in reserved} | {w: (w, "ID") for w in context}

    def tokens(self, text: str) -> list[Token]:
        out: list[Token] = []
        fresh, at = True, 0
        for match in self.pattern.finditer(text):
            kind = match.lastgroup
            if match.start() != at:
                out.append(Token("ERR", at, fresh))
                fresh = False
            at = match.end()
            if kind == "skip":
                fresh = fresh or "\n" in match.group()
                continue
            if kind == "id":
                word = match.group()
                terminal = self.map.get(word, "ID")
            elif kind == "op":
                terminal = match.group()
            elif kind == "bad":
                terminal = "ERR"
            else:
                terminal = kind.upper()
            out.append(Token(terminal, match.start(), fresh))
            fresh = False
        if at != len(text):
            out.append(Token("ERR", at, fresh))
        return out


class Go(Simple):
    """Go inserts a semicolon at the end of a line whose last token can end a statement."""

    ENDS = _words("ID NUM STR CHAR break continue fallthrough return ++ -- ) ] }")

    def tokens(self, text: str) -> list[Token]:
        out: list[Token] = []
        for token in super().tokens(text):
            if token.fresh and out and out[-1].terminal in self.ENDS:
                out.append(Token(";", token.at, False))
            out.append(token)
        if out and out[-1].terminal in self.ENDS:
            out.append(Token(";", len(text), False))
        return out


class Hcl(Simple):
    """HCL ends attributes with a newline, outside brackets; blocks and object braces keep theirs."""

    _HEREDOC = re.compile(r"<<-?\s*([A-Za-z_]\w*)[ \t]*\r?\n")

    def tokens(self, text: str) -> list[Token]:
        out: list[Token] = []
        depth: list[str] = []
        text = self._blank_heredocs(text)
        for token in super().tokens(text):
            if token.fresh and out and out[-1].terminal != "NL" and (not depth or depth[-1] == "{"):
                out.append(Token("NL", token.at, False))
            if token.terminal in ("(", "[", "{"):
                depth.append(token.terminal)
            elif token.terminal in (")", "]", "}") and depth:
                depth.pop()
            out.append(token)
        out.append(Token("NL", len(text), False))
        return out

    def _blank_heredocs(self, text: str) -> str:
        """Heredocs become strings of the same length, so that their text isn't read as code."""
        at = 0
        while match := self._HEREDOC.search(text, at):
            line = text[text.rfind("\n", 0, match.start()) + 1 : match.start()]
            if not re.search(r"[=(,\[?:{]\s*$", line) or line.count('"') % 2 or line.lstrip().startswith(("#", "//")):
                at = match.end()
                continue
            end = re.compile(rf"^[ \t]*{match.group(1)}[ \t]*\r?$", re.MULTILINE).search(text, match.end())
            if not end:
                at = match.end()
                continue
            stop = end.end() - (text[end.end() - 1] == "\r")
            text = text[: match.start()] + '"' + "_" * (stop - match.start() - 2) + '"' + text[stop:]
            at = stop
        return text


class Python:
    """Python lines with NEWLINE, INDENT and DEDENT."""

    _TOKEN = re.compile(
        rf"""
        (?P<skip>[ \t\f]+|\\\r?\n|\#[^\r\n]*)
      | (?P<str>(?:[rRbBuUfFtT]{{1,2}})?(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|(?!\"\"\"|''')(?:"(?:[^"\\\r\n]|\\(?:\r\n|.))*"|'(?:[^'\\\r\n]|\\(?:\r\n|.))*')))
      | (?P<num>{_NUMBER}[jJ]?(?![A-Za-z0-9_]))
      | (?P<id>[^\W\d]\w*)
      | (?P<op>->|:=|\.\.\.|\*\*=|//=|>>=|<<=|!=|<=|>=|==|\*\*|//|<<|>>|[-+*/%@&|^]=|[-+*/%@&|^~<>()\[\]{{}},:.;=])
      | (?P<line>\r?\n|\r)
      | (?P<bad>.)
        """,
        re.VERBOSE | re.DOTALL,
    )

    def tokens(self, text: str) -> list[Token]:
        out: list[Token] = []
        indents = [0]
        depth = 0
        words: dict[str, str | tuple[str, str]] = {w: w for w in PYTHON_RESERVED} | {w: (w, "ID") for w in PYTHON_CONTEXT}
        start, fresh = 0, True
        at = 1 if text.startswith("\ufeff") else 0
        for match in self._TOKEN.finditer(text, at):
            kind = match.lastgroup
            if kind == "skip":
                continue
            if kind == "line":
                if not depth:
                    if not fresh:
                        out.append(Token("NEWLINE", match.start(), False))
                    fresh = True
                start = match.end()
                continue
            if fresh and not depth:
                width = len(text[start : match.start()].expandtabs(8))
                if width > indents[-1]:
                    indents.append(width)
                    out.append(Token("INDENT", match.start(), True))
                while width < indents[-1]:
                    indents.pop()
                    out.append(Token("DEDENT" if width >= indents[-1] or width in indents else "ERR", match.start(), True))
                    if width > indents[-1]:
                        out.append(Token("ERR", match.start(), True))
                        break
            if kind == "op":
                terminal: str | tuple[str, str] = match.group()
                depth += (terminal in ("(", "[", "{")) - (terminal in (")", "]", "}") and depth > 0)
            elif kind == "id":
                terminal = words.get(match.group(), "ID")
            else:
                terminal = "ERR" if kind == "bad" else kind.upper()
            out.append(Token(terminal, match.start(), fresh))
            fresh = False
        if not fresh:
            out.append(Token("NEWLINE", len(text), False))
        out += [Token("DEDENT", len(text), True) for _ in indents[1:]]
        return out


class Script:
    """JavaScript and TypeScript: regular expressions, templates, and JSX where the language has it."""

    _TOKEN = re.compile(
        rf"""
        (?P<skip>[\s\ufeff]+|//[^\n\r]*|/\*.*?\*/)
      | (?P<bad>/\*)
      | (?P<str>"(?:[^"\\\r\n]|\\(?:\r\n|.))*"|'(?:[^'\\\r\n]|\\(?:\r\n|.))*')
      | (?P<num>{_NUMBER}n?(?![A-Za-z0-9_$]))
      | (?P<id>[^\W\d][\w$]*|\$[\w$]*)
      | (?P<priv>\#[A-Za-z_$][\w$]*)
      | (?P<op>=>|\.\.\.|\?\?=|\?\?|\?\.(?!\d)|===|!==|==|!=|<=|<<=|<<|\*\*=|\*\*|\+\+|--|&&=|&&|\|\|=|\|\||[-+*%&|^]=|[-+*%&|^~!?:;,.()\[\]{{}}<>=@])
        """,
        re.VERBOSE | re.DOTALL,
    )
    _REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\r\n]|\\.|\[(?:[^\]\\\r\n]|\\.)*\])+/[A-Za-z]*")
    _TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.DOTALL)
    _JSX_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")
    _GENERIC = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\b|=)")
    _VALUE = _words("ID NUM STR REGEX TEMPLATE TEMPLATE_TAIL PRIV ) ] } this super null true false JSX_GT ++ --")

    def __init__(self, context: frozenset[str], jsx: bool):
        self.map: dict[str, str | tuple[str, str]] = {w: w for w in JS_RESERVED} | {w: (w, "ID") for w in context}
        self.jsx = jsx

    def tokens(self, text: str) -> list[Token]:
        out: list[Token] = []
        at, fresh, size = 0, True, len(text)
        if text.startswith("#!"):
            at = (text.find("\n") + 1) or size
        # what an inner closing mark returns to: "{" code, "`" template, "tag" and "kids" of JSX
        modes: list[str] = []

        def emit(terminal, where: int) -> None:
            nonlocal fresh
            out.append(Token(terminal, where, fresh))
            fresh = False

        def template(where: int, first: bool) -> int:
            end = self._TEMPLATE.match(text, where + 1).end()
            if end >= size:
                emit("ERR", where)
                return size
            if text[end] == "`":
                emit("TEMPLATE" if first else "TEMPLATE_TAIL", where)
                return end + 1
            emit("TEMPLATE_HEAD" if first else "TEMPLATE_MID", where)
            modes.append("`")
            return end + 2

        while at < size:
            mode = modes[-1] if modes else ""
            char = text[at]
            if mode == "kids":
                end = at
                while end < size and text[end] not in "<{":
                    end += 1
                if end > at:
                    emit("JSX_TEXT", at)
                elif char == "{":
                    emit("{", at)
                    modes.append("{")
                    end = at + 1
                elif text.startswith("</", at):
                    modes.pop()
                    emit("JSX_CLOSE", at)
                    modes.append("closing")
                    end = at + 2
                else:
                    emit("JSX_LT", at)
                    modes.append("tag")
                    end = at + 1
                at = end
                continue
            if mode in ("tag", "closing"):
                if char.isspace():
                    at += 1
                elif char == ">":
                    emit("JSX_GT", at)
                    modes.pop()
                    if mode == "tag":
                        modes.append("kids")
                    at += 1
                elif text.startswith("/>", at):
                    emit("JSX_END", at)
                    modes.pop()
                    at += 2
                elif char == "{":
                    emit("{", at)
                    modes.append("{")
                    at += 1
                elif char == "=":
                    emit("=", at)
                    at += 1
                elif char in "\"'" and (end := text.find(char, at + 1)) > 0:
                    emit("STR", at)
                    at = end + 1
                elif name := self._JSX_NAME.match(text, at):
                    emit("JSX_NAME", at)
                    at = name.end()
                else:
                    emit("ERR", at)
                    at += 1
                continue
            if char == "`":
                at = template(at, True)
                continue
            if char == "}" and mode == "`":
                modes.pop()
                at = template(at, False)
                continue
            before = out[-1].terminal if out else ""
            value = isinstance(before, tuple) or before in self._VALUE
            if char == "/" and text[at : at + 2] not in ("//", "/*"):
                regex = None if value else self._REGEX.match(text, at)
                if regex:
                    emit("REGEX", at)
                    at = regex.end()
                else:
                    wide = text[at : at + 2] == "/="
                    emit("/=" if wide else "/", at)
                    at += 1 + wide
                continue
            starts = not value or isinstance(before, tuple) and before[0] in ("await", "yield")
            if char == "<" and self.jsx and starts and not self._GENERIC.match(text, at) and re.match(r"<\s*(?:[A-Za-z_$]|>)", text[at : at + 40]):
                emit("JSX_LT", at)
                modes.append("tag")
                at += 1
                continue
            match = self._TOKEN.match(text, at)
            if not match:
                emit("ERR", at)
                at += 1
                continue
            kind = match.lastgroup
            if kind == "skip":
                fresh = fresh or "\n" in match.group() or "\r" in match.group()
            elif kind == "id":
                emit(self.map.get(match.group(), "ID"), at)
            elif kind == "op":
                mark = match.group()
                if mark == "{":
                    modes.append("{")
                elif mark == "}" and mode == "{":
                    modes.pop()
                emit(mark, at)
            else:
                emit("ERR" if kind == "bad" else kind.upper(), at)
            at = match.end()
        if modes:
            emit("ERR", size)
        return out


_C_SKIP = r"(?P<skip>[\s\ufeff]+|//[^\n]*|/\*.*?\*/)|(?P<bad>/\*)"
_GO = rf"""{_C_SKIP}
  | (?P<str>`[^`]*`|"(?:[^"\\\n]|\\.)*")
  | (?P<char>'(?:[^'\\\n]|\\(?:[abfnrtv\\'"]|x..|u....|U........|[0-7]{{3}}))')
  | (?P<num>{_NUMBER}i?(?![A-Za-z0-9_]))
  | (?P<id>[^\W\d]\w*)
  | (?P<op>\.\.\.|<<=|>>=|&\^=|&\^|<-|:=|\+\+|--|&&|\|\||<<|>>|==|!=|<=|>=|[-+*/%&|^]=|[-+*/%&|^!<>=()\[\]{{}},:.;~])"""
_JAVA = rf"""{_C_SKIP}
  | (?P<str>\"\"\"[ \t]*\r?\n(?:[^\\]|\\.)*?\"\"\"|"(?!\"\")(?:[^"\\\r\n]|\\.)*")
  | (?P<char>'(?:[^'\\\r\n]|\\(?:u+[\da-fA-F]{{4}}|[0-7]{{1,3}}|.))')
  | (?P<num>{_NUMBER}[lLfFdD]?(?![A-Za-z0-9_]))
  | (?P<id>[^\W\d][\w$]*|\$[\w$]*)
  | (?P<op>\.\.\.|->|::|\+\+|--|&&|\|\||<<=|<<|==|!=|<=|[-+*/%&|^]=|[-+*/%&|^!~?:;,.()\[\]{{}}<>=@])"""
_KOTLIN = rf"""(?P<skip>[\s\ufeff]+|//[^\n]*|/\*.*?\*/)|(?P<bad>/\*)
  | (?P<str>\"\"\".*?\"\"\"+|"(?!\"\")(?:[^"\\\r\n]|\\.)*")
  | (?P<char>'(?:[^'\\\r\n]|\\(?:u[\da-fA-F]{{4}}|.))')
  | (?P<num>{_NUMBER}[uUlLfF]{{0,2}}(?![A-Za-z0-9_]))
  | (?P<id>[^\W\d]\w*|`[^`\n]+`)
  | (?P<op>\.\.<?|->|::|\?\.|\?:|!!|\+\+|--|&&|\|\||===|!==|==|!=|<=|[-+*/%]=|[-+*/%!?:;,.()\[\]{{}}<>=@\#])"""
_RUST = rf"""(?P<skip>[\s\ufeff]+|//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/)|(?P<bad>/\*)
  | (?P<str>[bc]?r(?P<h>\#*)".*?"(?P=h)|[bc]?"(?:[^"\\]|\\.)*")
  | (?P<char>b?'(?:[^'\\\r\n]|\\(?:x[\da-fA-F]{{2}}|u\{{[\da-fA-F_]+\}}|.))')
  | (?P<life>'[A-Za-z_]\w*)
  | (?P<num>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:[iu](?:8|16|32|64|128|size)|f32|f64)?(?![A-Za-z0-9_]))
  | (?P<id>(?:r\#)?[^\W\d]\w*)
  | (?P<op>\.\.=|\.\.\.|\.\.|=>|->|::|&&|\|\||<<=|<<|==|!=|<=|[-+*/%&|^]=|[-+*/%&|^!~?:;,.()\[\]{{}}<>=@\#$])"""
_HCL = rf"""(?P<skip>[\s\ufeff]+|//[^\n]*|\#[^\n]*|/\*.*?\*/)|(?P<bad>/\*)
  | (?P<str>"(?:[^"\\\n$%]|\\.|[$%](?!\{{)|[$%]\{{(?:[^{{}}"\n]|"(?:[^"\\\n]|\\.)*"|\{{[^{{}}]*\}})*\}})*")
  | (?P<num>{_NUMBER}(?![A-Za-z0-9_]))
  | (?P<id>[^\W\d][\w-]*)
  | (?P<op>\.\.\.|=>|&&|\|\||==|!=|<=|>=|[-+*/%!?:,.()\[\]{{}}<>=])"""

LEXERS = {
    "js": Script(JS_CONTEXT, jsx=False),
    "ts": Script(TS_CONTEXT, jsx=False),
    "tsx": Script(TS_CONTEXT, jsx=True),
    "py": Python(),
    "go": Go(_GO, GO_RESERVED),
    "java": Simple(_JAVA, JAVA_RESERVED, JAVA_CONTEXT),
    "kt": Simple(_KOTLIN, KOTLIN_RESERVED, KOTLIN_CONTEXT),
    "rs": Simple(_RUST, RUST_RESERVED, RUST_CONTEXT),
    "tf": Hcl(_HCL, HCL_RESERVED),
}
