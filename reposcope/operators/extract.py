"""Symbols, calls, imports, type bindings and type relations of source files.

Python goes through the standard parser; if that fails, and for the languages with braces, a scanner
cuts the text into tokens and pairs brackets, which no syntax error stops. Definitions are recognised
by the tokens around a name, and calls belong to the innermost definition around them. Each file is
handled by itself in Arrow batches; a file that fails gives an error row, not a failed job.

Where no syntax tree is needed to tell, more is found than a walk over one would name: C++ methods
defined outside their class belong to it, aliases and groups of Rust's ``use`` are taken apart, and
Python's annotated parameters and ``x = Type()`` bind types. Structs of C count where they have a body.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Brackets within each other, beyond which a file is read in part only.
MOST_DEPTH = 400
BODY_LINES = 40
#: Files that one task takes where rows are spread before sources are made of them: some seconds of work.
FILES_A_TASK = 10_000
#: Facts that leave a task together; few enough to hold, enough that batches cost little.
ROWS_A_BATCH = 2_000

_C_LIKE = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_STRING = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_NAME = r"[^\W\d][\w$]*|\$[\w$]*"
_REST = r"\d[\w.]*|=>|->|::|\?\.|\.\.\.|[^\s\w]"
_LEXERS = {
    "javascript": re.compile(rf"(?P<skip>{_C_LIKE})|(?P<string>{_STRING})|(?P<name>#?(?:{_NAME}))|(?P<sign>{_REST})", re.S),
    "rust": re.compile(rf"(?P<skip>{_C_LIKE})|(?P<string>r#*\".*?\"#*|b?\"(?:\\.|[^\"\\])*\"|'(?:\\.[^']*|[^'\\\n])')|(?P<name>{_NAME})|(?P<sign>'\w+|{_REST})", re.S),
    "go": re.compile(rf"(?P<skip>{_C_LIKE})|(?P<string>{_STRING}|`[^`]*`?)|(?P<name>{_NAME})|(?P<sign>{_REST})", re.S),
    "c": re.compile(rf"(?P<include>\#[ \t]*include[ \t]*\"[^\"\n]*\")|(?P<skip>{_C_LIKE}|\#[^\n]*(?:\\\n[^\n]*)*)|(?P<string>{_STRING})|(?P<name>{_NAME})|(?P<sign>{_REST})", re.S),
    "java": re.compile(rf"(?P<skip>{_C_LIKE})|(?P<string>\"\"\".*?(?:\"\"\"|\Z)|{_STRING})|(?P<name>{_NAME})|(?P<sign>{_REST})", re.S),
}
_LEXERS |= {"typescript": _LEXERS["javascript"], "tsx": _LEXERS["javascript"], "cpp": _LEXERS["c"]}
_CLOSES = {")": "(", "]": "[", "}": "{"}
_SCRIPTS = frozenset({"typescript", "tsx", "javascript"})
_MODIFIERS = frozenset("public private protected static readonly abstract override async get set declare accessor final synchronized native default strictfp transient volatile pub unsafe const extern inline virtual".split())
_NOT_CALLED = {
    "script": frozenset("if for while switch catch return function typeof instanceof new await yield throw delete void in of do else case super import with constructor class interface as satisfies".split()),
    "rust": frozenset("if for while match loop return fn struct impl in else move as where let mut ref unsafe pub crate self super dyn use mod trait enum type const static await".split()),
    "c": frozenset("if for while switch catch return new delete throw else case do sizeof alignof decltype static_assert alignas noexcept typeof __attribute__ operator defined co_await co_return class struct typedef using".split()),
    "java": frozenset("if for while switch catch return new throw else case do synchronized try assert this super instanceof yield class interface enum record".split()),
    "go": frozenset("if for switch return func go defer range select case else interface struct map chan type var const import package".split()),
}
#: What a scan is asked for if nothing else is said.
_EVERY = frozenset({"symbol", "call", "import", "type", "relation"})
_RUST_IMPORTS = frozenset({"mod", "use"})
_RUST_STARTS = _RUST_IMPORTS | {"impl", "struct", "fn"}
_STARTS = frozenset("const let var function class interface export import return if for while switch throw try type enum async abstract".split())


@dataclass
class Facts:
    file: str
    symbols: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    types: list[dict] = field(default_factory=list)
    relations: list[dict] = field(default_factory=list)
    truncated: bool = False

    def symbol(self, name, kind, container, line, column, end_line, size):
        owner = container if kind == "method" else None
        made = f"{self.file}#{owner + '.' if owner else ''}{name}@{line + 1}:{column + 1}"
        self.symbols.append({"id": made, "name": name, "kind": kind, "container": owner, "start_line": line, "end_line": end_line, "tokens": max(1, -(-size // 4))})
        return made


_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:\\.|(?!\$\{)[^`\\])*(`|\$\{|\Z)", re.S)
#: Tokens after which a slash divides.
_VALUES = re.compile(r"[\w$)\]\"'`}]$")
#: Signs after which a script's text may be no token, and braces, by which its templates are told.
_TURNS = frozenset("/`{}")
_BRACKETS = frozenset("()[]{}")


def tokens(language: str, source: str):
    """(kind, text, start) of a source; in scripts regular expressions are strings, and so are templates
    up to and after what is put into them."""
    lexer = _LEXERS[language]
    if language not in _SCRIPTS:
        yield from [(m.lastgroup, m[0], m.start()) for m in lexer.finditer(source)]
        return
    at, last, depth, templates = 0, "", 0, []
    ahead = lexer.finditer(source)
    while m := next(ahead, None):
        kind, text = m.lastgroup, m[0]
        if kind != "sign" or text not in _TURNS:
            yield kind, text, m.start()
            if kind != "skip":
                last = text
            continue
        at = m.end()
        if text == "/" and (not _VALUES.search(last) or last in ("return", "typeof", "case", "in", "of")) and (r := _REGEX.match(source, m.start())):
            kind, text, at = "string", r[0], r.end()
        elif text == "`" or text == "}" and templates and templates[-1] == depth:
            if text == "}":
                templates.pop()
                depth -= 1
                yield "sign", "}", m.start()
            r = _TEMPLATE.match(source, at)
            kind, text, at = "string", source[m.start() + (text == "}") : r.end()], r.end()
            if r[1] == "${":
                yield kind, text[:-1], m.start()
                kind, text, depth = "sign", "{", depth + 1
                templates.append(depth)
                yield kind, text, at - 1
                ahead, last = lexer.finditer(source, at), text
                continue
        elif text != "/":
            depth += 1 if text == "{" else -1
        yield kind, text, m.start()
        last = text
        if at != m.end():
            ahead = lexer.finditer(source, at)


class _Texts(dict):
    """Texts of tokens by their number; empty before the first and after the last."""

    def __missing__(self, i: int) -> str:
        return ""


class Scanner:
    """Tokens of one file with paired brackets, and what they say of the kinds of facts that are wanted."""

    def __init__(self, file: str, language: str, source: str, wanted: frozenset[str] = _EVERY):
        self.out, self.language, self.source = Facts(file), language, source
        self.wanted, self.typed = wanted, "type" in wanted
        self.not_called = _NOT_CALLED["script" if language in _SCRIPTS else "c" if language == "cpp" else language]
        self.lines = [0, *(m.end() for m in re.finditer("\n", source))]
        self.pair, self.inside = {}, []
        told = [x for x in tokens(language, source) if x[0] != "skip"]
        self.kind, self.text, self.at = (list(c) for c in zip(*told, strict=True)) if told else ([], [], [])
        open_: list[int] = []
        around = -1
        for i in [i for i, text in enumerate(self.text) if text in _BRACKETS]:
            if self.kind[i] != "sign":
                continue
            text = self.text[i]
            self.inside += [around] * (i - len(self.inside))
            if text in _CLOSES:
                back = next((k for k in range(len(open_) - 1, max(-1, len(open_) - 4), -1) if self.text[open_[k]] == _CLOSES[text]), None)
                if back is not None:  # brackets left open between the two end here
                    self.pair[open_[back]] = i
                    self.pair[i] = open_[back]
                    del open_[back:]
                around = open_[-1] if open_ else -1
                self.inside.append(around)
                continue
            self.inside.append(around)
            if len(open_) >= MOST_DEPTH:
                self.out.truncated = True
            open_.append(i)
            around = i
        self.n = len(self.text)
        self.inside += [around] * (self.n - len(self.inside))
        #: The text of a token, empty outside; whether a token is a name.
        self.t = _Texts(enumerate(self.text)).__getitem__
        self.names = [i for i, k in enumerate(self.kind) if k == "name"]
        self.is_name = set(self.names).__contains__
        #: (first token, last token, id) of definitions; (first token, last token, name) of classes by their start.
        self.spans: list[tuple[int, int, str]] = []
        self.classes: list[tuple[int, int, str]] = []
        self.passed, self.asked, self.around = 0, -1, []
        self.named: set[int] = set()
        #: Braces that open classes, with the class's name.
        self.bodies: dict[int, str] = {}

    # --- reading tokens ----------------------------------------------------------------------------
    def close(self, i: int) -> int:
        return self.pair.get(i, self.n - 1)

    def end(self, i: int) -> int:
        return self.at[i] + len(self.text[i])

    def line(self, i: int) -> int:
        return bisect_right(self.lines, self.at[i]) - 1

    def generic(self, i: int) -> int:
        """The token after <...> that starts at i; i if none does."""
        if self.t(i) != "<":
            return i
        depth = 0
        for k in range(i, min(self.n, i + 200)):
            depth += (self.t(k) == "<") - (self.t(k) == ">")
            if not depth:
                return k + 1
            if self.t(k) in (";", "{") and self.kind[k] == "sign" and self.t(k) == ";":
                break
        return i

    def first_of(self, i: int) -> int:
        """Back over modifiers before i."""
        while self.t(i - 1) in _MODIFIERS and self.is_name(i - 1):
            i -= 1
        return i

    def define(self, name: int, kind: str, start: int, end: int, container: str | None = None) -> str:
        row = self.line(start)
        made = self.out.symbol(self.t(name), kind, container, row, self.at[start] - self.lines[row], bisect_right(self.lines, max(self.at[start], self.end(end) - 1)) - 1, self.end(end) - self.at[start])
        self.spans.append((start, end, made))
        if kind == "class":
            self.classes.append((start, end, self.t(name)))
        self.named.add(name)
        return made

    def owner(self, i: int) -> str | None:
        """The innermost class around a token, also through functions. Asked in the order of tokens, it
        looks at each class once."""
        if i < self.asked:
            self.passed, self.around = 0, []
        self.asked = i
        while self.passed < len(self.classes) and self.classes[self.passed][0] <= i:
            self.around.append(self.classes[self.passed])
            self.passed += 1
        while self.around and self.around[-1][1] < i:
            self.around.pop()
        return self.around[-1][2] if self.around else None

    def super_types(self, name: int, body: int) -> None:
        """extends and implements between a class's name and its body."""
        if "relation" not in self.wanted:
            return
        i, kind = self.generic(name + 1), None
        while i < body:
            if self.t(i) in ("extends", "implements"):
                kind = self.t(i)
            elif kind and self.is_name(i):
                last = i
                while self.t(last + 1) == "." and self.is_name(last + 2):
                    last += 2
                self.out.relations.append({"subtype": self.t(name), "supertype": self.t(last), "kind": kind})
                i = self.generic(last + 1)
                if self.t(i) == "(":
                    i = self.close(i) + 1
                continue
            i += 1

    def body_after(self, i: int) -> int:
        """The brace that opens what is declared at i, before any semicolon; n if there is none."""
        while i < self.n and self.t(i) not in ("{", ";", "}"):
            i = self.close(i) + 1 if self.t(i) in ("(", "[") and self.kind[i] == "sign" else i + 1
        return i if self.t(i) == "{" else self.n

    def receiver(self, name: int) -> tuple[str | None, int]:
        """Text before the dot of ``x.name``, and the token at which the whole expression starts."""
        if self.t(name - 1) not in (".", "?."):
            return None, name
        i = name - 2
        while i >= 0:
            if self.t(i) == "!":
                i -= 1
            if self.t(i) in (")", "]") and i in self.pair:
                i = self.pair[i] - 1
                if self.is_name(i) and self.t(i) not in self.not_called or self.t(i) in (")", "]"):
                    continue
                i += 1
                break
            if not (self.is_name(i) or self.kind[i] == "string"):
                i += 1
                break
            if self.t(i - 1) not in (".", "?."):
                break
            i -= 2
        i = max(i, 0)
        return self.source[self.at[i] : self.end(name - 2)], i

    # --- scripts -----------------------------------------------------------------------------------
    def value_end(self, i: int) -> int:
        """The last token of the expression that starts at i."""
        while i < self.n:
            if self.t(i) in ("(", "[", "{") and self.kind[i] == "sign":
                i = self.close(i)
            elif self.t(i) in (";", ",", ")", "]", "}") and self.kind[i] == "sign" or self.t(i) in _STARTS and self.line(i) > self.line(i - 1) and self.t(i - 1) not in ("=>", "=", ":", "?"):
                return i - 1
            i += 1
        return self.n - 1

    def function_value(self, i: int) -> int | None:
        """The last token of the function that is the value at i, if it is one."""
        if self.t(i) == "async":
            i += 1
        if self.t(i) == "function":
            return self.close(self.body_after(i))
        after = self.generic(i)
        if self.t(after) == "(":
            after = self.close(after) + 1
            if self.t(after) == ":":
                while after < self.n and self.t(after) not in ("=>", ";", "{") or self.t(after) == "{" and self.t(self.close(after) + 1) == "=>":
                    after = self.close(after) + 1 if self.t(after) in ("(", "[", "{") else after + 1
        elif self.is_name(i):
            after = i + 1
        if self.t(after) != "=>":
            return None
        return self.close(after + 1) if self.t(after + 1) == "{" else self.value_end(after + 1)

    def annotation(self, i: int) -> str | None:
        """The first name after a colon at i."""
        if self.t(i) != ":":
            return None
        i += 1
        while i < self.n and not self.is_name(i) and self.t(i) in ("(", "[", "{", "|", "&"):
            i += 1
        return self.t(i) if self.is_name(i) else None

    def constructed(self, i: int) -> str | None:
        """What ``new`` at i makes."""
        if self.t(i) != "new" or not self.is_name(i + 1):
            return None
        last = i + 1
        while self.t(last + 1) == "." and self.is_name(last + 2):
            last += 2
        return self.source[self.at[i + 1] : self.end(last)]

    def parameters(self, open_: int, container: str | None) -> None:
        if not self.typed:
            return
        i, close = open_ + 1, self.close(open_)
        while i < close:
            while self.t(i) == "@":
                i += 2
                if self.t(i) == "(":
                    i = self.close(i) + 1
            i = next(k for k in range(i, close + 1) if not (self.t(k) in _MODIFIERS and self.is_name(k + 1)))
            if self.is_name(i):
                colon = i + 1 + (self.t(i + 1) == "?")
                bound = self.annotation(colon) or (self.constructed(colon + 1) if self.t(colon) == "=" else None)
                if bound:
                    self.out.types.append({"name": self.t(i), "type": bound, "container": container})
            while i < close and self.t(i) != ",":
                i = self.close(i) + 1 if self.t(i) in ("(", "[", "{") and self.kind[i] == "sign" else self.generic(i) if self.generic(i) > i else i + 1
            i += 1

    def scripts(self) -> None:
        bodies = self.bodies
        for i in self.names:
            text = self.t(i)
            if self.t(i - 1) in (".", "?."):
                continue
            if text in ("class", "interface") and self.is_name(i + 1) and self.t(i - 1) not in ("=", "(", ",", "return", ":", "abstract", "=>"):
                body = self.body_after(i + 2)
                if body < self.n and self.t(i + 1) not in ("extends", "implements"):
                    self.define(i + 1, "class", i, self.close(body))
                    self.super_types(i + 1, body)
                    bodies[body] = self.t(i + 1) if text == "class" else ""
                    if text == "interface":
                        del bodies[body]
            elif text == "class" or text == "abstract" and self.t(i + 1) == "class":
                body = self.body_after(i + 1)
                if body < self.n:
                    bodies.setdefault(body, "")
            elif text == "function":
                name = i + 1 + (self.t(i + 1) == "*")
                start = i - (self.t(i - 1) == "async")
                body = self.body_after(name)
                if self.is_name(name) and body < self.n and self.t(start - 1) in ("", ";", "}", "{", "export", "default", ")", "*/") or self.is_name(name) and body < self.n and self.line(start) > self.line(start - 1) and self.t(start - 1) not in ("=", "(", ",", ":", "?", "=>", "return"):
                    self.define(name, "function", start, self.close(body))
                if self.t(name if not self.is_name(name) else self.generic(name + 1)) == "(":
                    self.parameters(name if not self.is_name(name) else self.generic(name + 1), self.owner(i))
            elif text in ("const", "let", "var"):
                self.declarators(i + 1, self.owner(i))
            elif text not in self.not_called or text in ("constructor", "delete", "of", "in", "with"):
                in_class = self.inside[i] in bodies
                if self.t(i + 1) in ("(", "<") or in_class and self.t(i + 1) in (":", "=", "?", "!", ";"):
                    self.member(i, self.owner(i), in_class)
        for i, text in enumerate(self.text if self.typed else ()):
            if text == "(" and self.kind[i] == "sign" and self.t(self.close(i) + 1) in ("=>", ":") and self.t(i - 1) not in ("function", "catch", "if", "while", "for", "switch") and i - 1 not in self.named:
                after = self.close(i) + 1
                while self.t(after) == ":" or after < self.n and self.t(after) not in ("=>", ";", ",", ")", "{", "}", "=") and self.t(self.close(i) + 1) == ":":
                    after += 1
                if self.t(after) == "=>":
                    self.parameters(i, self.owner(i))

    def declarators(self, i: int, container: str | None) -> None:
        while self.is_name(i):
            after, bound = i + 1, self.annotation(i + 1)
            while after < self.n and self.t(after) not in ("=", ";", ",", "of", "in") and (self.line(after) == self.line(i) or bound):
                after = self.close(after) + 1 if self.t(after) in ("(", "[", "{") else self.generic(after) if self.generic(after) > after else after + 1
            if self.t(after) == "=":
                last = self.function_value(after + 1)
                if last is not None:
                    self.define(i, "function", i, last)
                bound = bound or self.constructed(after + 1)
                after = (last if last is not None else self.value_end(after + 1)) + 1
            if bound:
                self.out.types.append({"name": self.t(i), "type": bound, "container": container})
            if self.t(after) != ",":
                break
            i = after + 1

    def member(self, i: int, container: str | None, in_class: bool) -> None:
        """A method or field whose name is at i, if it is one."""
        start = self.first_of(i)
        if self.t(start - 1) == "*":
            start = self.first_of(start - 1)
        before = self.t(start - 1)
        after = self.generic(i + 1)
        if self.t(after) == "(" and (before in ("{", ",") or in_class and (before in (";", "}", ")", ">") or self.line(start) > self.line(start - 1))) and (in_class or self.t(self.inside[i]) == "{"):
            close = self.close(after)
            body = self.body_after(close + 1) if self.t(close + 1) in (":", "{") else self.n
            if body < self.n and (in_class or self.t(close + 1) == "{" or self.t(close + 1) == ":"):
                self.define(i, "method", start, self.close(body), container)
                self.parameters(after, container)
        elif in_class and self.t(i + 1) in (":", "=", "?", "!", ";") and (before in ("{", ";", "}") or self.line(start) > self.line(start - 1)):
            after = i + 1 + (self.t(i + 1) in ("?", "!"))
            bound = self.annotation(after)
            while after < self.n and self.t(after) not in ("=", ";", "}") and (self.t(after) in (":", "?", "!") or self.line(after) == self.line(i)):
                after = self.close(after) + 1 if self.t(after) in ("(", "[", "{") else self.generic(after) if self.generic(after) > after else after + 1
            if self.t(after) == "=":
                last = self.function_value(after + 1)
                if last is not None:
                    self.define(i, "method", start, last, container)
                bound = bound or self.constructed(after + 1)
            if bound:
                self.out.types.append({"name": self.t(i), "type": bound, "container": container})

    def script_imports(self) -> None:
        for i in self.names:
            if self.t(i) == "import" and self.inside[i] < 0 and self.t(i + 1) not in ("(", "."):
                names, k = [], i + 1
                while k < self.n and self.kind[k] != "string" and self.t(k) != ";" and k - i < 2000:
                    if self.is_name(k) and self.t(k) not in ("from", "type", "as") or self.t(k) == "from" and self.t(k - 1) in ("{", ",") or self.t(k) == "type" and self.t(k + 1) in (",", "}", "from"):
                        if self.t(k - 1) == "as" and self.t(k - 2) != "*":
                            names.pop()
                        names.append(self.t(k))
                    k += 1
                if k < self.n and self.kind[k] == "string":
                    self.out.imports += [{"source": self.t(k)[1:-1], "local": x} for x in names]

    def elements(self) -> None:
        """Components in markup: <Name and <ns.Name where an expression may start."""
        for i in range(self.n):
            if self.t(i) == "<" and self.is_name(i + 1) and self.at[i + 1] == self.at[i] + 1 and not (self.is_name(i - 1) and self.t(i - 1) not in ("return", "default", "case")) and self.t(i - 1) not in (")", "]"):
                last = i + 1
                while self.t(last + 1) == "." and self.is_name(last + 2):
                    last += 2
                if self.t(last)[0].isupper() and self.t(last)[0].isascii() and (self.t(last + 1) in (">", "/", "{") or self.is_name(last + 1) and self.t(last + 1) != "extends"):
                    self.call(last, i + 1, self.t(i + 1) if last > i + 1 else None, i)

    # --- calls -------------------------------------------------------------------------------------
    def call(self, name: int, start: int, receiver: str | None, line_of: int | None = None) -> None:
        self.out.calls.append({"at": start, "name": self.t(name), "receiver": receiver, "line": self.line(start if line_of is None else line_of)})

    def find_calls(self) -> None:
        native = self.language in ("rust", "c", "cpp")
        skip_to = -1
        for i in range(self.n) if self.language == "rust" else self.names:
            if i < skip_to:
                continue
            if self.language == "rust" and (self.t(i) == "#" and self.t(i + 1) in ("[", "!") or self.t(i) == "!" and self.is_name(i - 1) and self.t(i + 1) in ("(", "[", "{")):
                skip_to = self.close(i + 1 if self.t(i + 1) != "!" else i + 2)  # attributes and macros hold no syntax
                continue
            if self.t(i + 1) not in ("(", "<") or not self.is_name(i) or i in self.named or self.t(i) in self.not_called:
                continue
            after = self.generic(i + 1) if self.language in ("typescript", "tsx") else i + 1
            if self.t(after) != "(" or after > i + 1 and self.t(i + 1) != "<":
                continue
            before = self.t(i - 1)
            if self.inside[i] in self.bodies and (before in ("{", "}", ";", ")", ":", "~") or before in _MODIFIERS):
                continue  # a constructor or a signature
            if before in ("new", "@", "fn", "func", "function", "::") or before == "->" and native:
                continue
            if native:
                if before == "." or self.is_name(i - 1) and before not in self.not_called or before == ">" or not self.in_function(i):
                    continue
                self.call(i, i, None)
                continue
            if self.language == "java" and (self.is_name(i - 1) and before not in ("return", "else", "do", "case", "throw", "assert", "yield") or before in (">", "]")):
                continue
            if self.language == "go" and self.is_name(i - 1) and before not in ("return", "go", "defer", "case", "range", "if", "for", "switch"):
                continue
            receiver, start = self.receiver(i)
            if self.t(start - 1) == "new" and receiver is not None:
                continue
            self.call(i, start, receiver)

    def in_function(self, i: int) -> bool:
        """Whether the token is in a function, or in what a name at the top is set to."""
        k = bisect_right(self.starts, i) - 1
        return k >= 0 and self.reach[k] >= i or self.t(i - 1) == "="

    # --- languages with types before names ---------------------------------------------------------
    def go(self) -> None:
        grouped = -1
        for i in range(self.n) if self.wanted - {"import"} else ():
            if self.t(i) == "type" and self.inside[i] < 0 and self.t(i + 1) == "(":
                grouped = i + 1
            starts = self.t(i - 1) == "type" and self.is_name(i) or grouped >= 0 and self.inside[i] == grouped and self.is_name(i) and self.line(i) > self.line(i - 1)
            if starts and self.t(i + 1) != "=":
                body = next((k for k in range(i + 1, self.n) if self.t(k) == "{" or self.line(k) > self.line(i)), self.n)
                self.define(i, "class", i, self.close(body) if self.t(body) == "{" else max(i, body - 1))
            if self.t(i) != "func" or self.inside[i] >= 0:
                continue
            name, owner = i + 1, None
            if self.t(name) == "(":
                close = self.close(name)
                parts = [k for k in range(name + 1, close) if self.is_name(k) and self.t(k - 1) not in ("[", ",")]
                owner = self.t(parts[-1]) if parts else None
                name = close + 1
            if self.is_name(name):
                end = self.go_body(name)
                self.define(name, "method" if self.t(i + 1) == "(" else "function", i, end, owner)
        for i in self.names if "import" in self.wanted else ():
            if self.t(i) == "import" and self.inside[i] < 0:
                for k in range(i + 1, self.close(i + 1) if self.t(i + 1) == "(" else min(i + 3, self.n)):
                    if self.kind[k] == "string" and (self.is_name(k - 1) and self.t(k - 1) != "import" or self.t(k - 1) == "."):
                        self.out.imports.append({"source": self.t(k)[1:-1], "local": self.t(k - 1)})

    def go_body(self, name: int) -> int:
        """The end of a function: results may hold braces of their own (interface{}, struct{})."""
        i = name + 1
        while i < self.n and (self.t(i) != "{" or self.t(i - 1) in ("interface", "struct")):
            if self.line(i) > self.line(i - 1) and self.t(i) not in (")", ",") and self.inside[i] < 0:
                return i - 1
            i = self.close(i) + 1 if self.t(i) in ("(", "[", "{") else i + 1
        return self.close(i) if i < self.n else self.n - 1

    def rust(self) -> None:
        owners: list[tuple[int, int, str]] = []
        asked = _RUST_STARTS if self.wanted - {"import"} else _RUST_IMPORTS
        for i in self.names:
            if self.t(i) not in asked:
                continue
            start = self.first_of(i)
            if self.t(start - 1) == ")" and self.t(self.close(start - 1) - 1) == "pub":
                start = self.close(start - 1) - 1
            if self.t(i) == "impl" and self.t(i - 1) in ("", ";", "}", "{", "]", "unsafe"):
                body = self.body_after(i + 1)
                begin = next((k + 1 for k in range(self.generic(i + 1), min(body, self.n)) if self.t(k) == "for"), self.generic(i + 1))
                stop = next((k for k in range(begin, min(body, self.n)) if self.t(k) == "where"), body)
                if body < self.n and stop > begin:
                    owners.append((body, self.close(body), self.source[self.at[begin] : self.end(stop - 1)]))
            elif self.t(i) == "struct" and self.is_name(i + 1):
                last = i + 2
                while last < self.n and self.t(last) not in (";", "{"):
                    last = self.close(last) + 1 if self.t(last) == "(" else last + 1
                self.define(i + 1, "class", start, self.close(last) if self.t(last) == "{" else min(last, self.n - 1))
            elif self.t(i) == "fn" and self.is_name(i + 1):
                body = self.body_after(i + 2)
                owner = next((o for s, e, o in reversed(owners) if s < i < e), None)
                if body < self.n:
                    self.define(i + 1, "method" if owner else "function", start, self.close(body), owner)
            elif self.t(i) == "mod" and self.is_name(i + 1) and "import" in self.wanted:
                self.out.imports.append({"source": f"./{self.t(i + 1)}", "local": self.t(i + 1)})
            elif self.t(i) == "use" and "import" in self.wanted and self.t(i - 1) in ("", ";", "}", "{", "pub", ")", "]"):
                end = next((k for k in range(i, self.n) if self.t(k) == ";"), self.n)
                self.use(i + 1, end, "")

    def use(self, i: int, end: int, before: str) -> None:
        """One path of a use declaration, or each of a group's."""
        path = before
        while i < end:
            if self.t(i) == "{":
                k, close = i + 1, self.close(i)
                while k < close:
                    stop = k
                    while stop < close and self.t(stop) != ",":
                        stop = self.close(stop) + 1 if self.t(stop) == "{" else stop + 1
                    self.use(k, stop, path)
                    k = stop + 1
                return
            if self.t(i) == "as":
                self.out.imports.append({"source": path, "local": self.t(i + 1)})
                return
            path += self.t(i)
            i += 1
        local = path.rpartition("::")[2]
        if local not in ("", "*"):
            self.out.imports.append({"source": path, "local": path[: -len("::self")].rpartition("::")[2] if local == "self" else local})

    def declaration_start(self, i: int) -> int:
        while i > 0 and self.t(i - 1) not in (";", "{", "}", ":") and self.kind[i - 1] != "include" and not (self.t(i - 1) == ">" and self.opens_template(i - 1)):
            i -= 1
        return i

    def opens_template(self, i: int) -> bool:
        depth = 0
        while i >= 0:
            depth += (self.t(i) == ">") - (self.t(i) == "<")
            if not depth:
                return self.t(i - 1) == "template"
            i -= 1
        return False

    def c(self) -> None:
        bodies = self.bodies
        for i in range(self.n) if self.wanted - {"import"} else [i for i, k in enumerate(self.kind) if k == "include"]:
            if self.kind[i] == "include":
                source = self.t(i).partition('"')[2][:-1]
                local = re.sub(r"\.[^.]+$", "", source.rpartition("/")[2])
                if local:
                    self.out.imports.append({"source": source if source.startswith(".") else f"./{source}", "local": local})
            elif self.t(i) in ("class", "struct") and self.is_name(i + 1) and self.t(i - 1) not in ("enum", "<", ","):
                body = self.body_after(i + 2)
                if body < self.n and not {"(", ")", "=", "*", "&"} & set(self.text[i + 2 : body]):
                    self.define(i + 1, "class", i, self.close(body))
                    bodies[body] = self.t(i + 1)
            elif self.t(i) == "(" and self.is_name(i - 1) and self.t(i - 1) not in self.not_called:
                around = self.inside[i - 1]
                in_class = around in bodies
                namespace = around >= 0 and not in_class and (self.t(around - 1) == "namespace" or self.t(around - 2) == "namespace" or self.kind[around - 1] == "string")
                if around >= 0 and not in_class and not namespace:
                    continue
                after = self.close(i) + 1
                while self.t(after) in ("const", "override", "noexcept", "final", "&"):
                    after += 1
                if self.t(after) in (":", "->"):
                    after = self.body_after(after)
                if self.t(after) != "{" or self.t(self.close(i) + 1) == ";":
                    continue
                outer = self.t(i - 3) if self.t(i - 2) == "::" else None
                owner = bodies.get(around) or outer
                if self.t(i - 2) == "~" or (owner and self.t(i - 1) == owner):
                    continue
                self.define(i - 1, "method" if owner else "function", self.declaration_start(i - 1), self.close(after), owner)

    def java(self) -> None:
        bodies = self.bodies
        for i in self.names if self.wanted - {"import"} else [i for i in self.names if self.t(i) == "import"]:
            if self.t(i) in ("class", "interface") and self.is_name(i + 1) and self.t(i - 1) not in (".", "@"):
                body = self.body_after(i + 2)
                if body < self.n:
                    self.define(i + 1, "class", self.annotated(self.first_of(i)), self.close(body))
                    self.super_types(i + 1, body)
                    bodies[body] = self.t(i + 1)
            elif self.t(i) in ("enum", "record") and self.is_name(i + 1):
                body = self.body_after(i + 2)
                if body < self.n:
                    bodies[body] = self.owner(i) or ""
            elif self.t(i) == "import" and self.inside[i] < 0:
                k = i + 1 + (self.t(i + 1) == "static")
                end = next((j for j in range(k, self.n) if self.t(j) == ";"), self.n)
                source = "".join(self.text[k:end]).removesuffix(".*")
                if source and self.t(end - 1) != "*":
                    self.out.imports.append({"source": source, "local": source.rpartition(".")[2]})
            elif self.is_name(i) and self.inside[i] in bodies and self.t(i) not in _MODIFIERS:
                start = self.annotated(self.declaration_start(i))
                owner = bodies[self.inside[i]] or None
                typed = self.is_name(i - 1) and self.t(i - 1) not in _MODIFIERS | {"class", "interface", "extends", "implements", "throws", "new"} or self.t(i - 1) in (">", "]")
                if not typed or self.t(i - 1) == "@" or "=" in self.text[start:i]:
                    continue
                if self.t(i + 1) == "(":
                    body = self.body_after(self.close(i + 1) + 1)
                    end = self.close(body) if body < self.n else next((k for k in range(i, self.n) if self.t(k) == ";"), i)
                    self.define(i, "method", start, end, owner)
                    self.java_parameters(i + 1, owner)
                elif self.typed and self.t(i + 1) in ("=", ";", ","):
                    begin = start
                    while begin < i and (self.t(begin) in _MODIFIERS or self.t(begin) == "@"):
                        begin = (self.close(begin + 2) + 1 if self.t(begin + 2) == "(" else begin + 2) if self.t(begin) == "@" else begin + 1
                    self.out.types.append({"name": self.t(i), "type": self.source[self.at[begin] : self.end(i - 1)], "container": owner})

    def annotated(self, i: int) -> int:
        """Back over annotations and modifiers before i."""
        while True:
            k = i
            if self.t(i - 1) == ")" and self.t(self.close(i - 1) - 2) == "@":
                k = self.close(i - 1) - 2
            elif self.is_name(i - 1) and self.t(i - 2) == "@":
                k = i - 2
            elif self.t(i - 1) in _MODIFIERS:
                k = i - 1
            if k == i:
                return i
            i = k

    def java_parameters(self, open_: int, owner: str | None) -> None:
        if not self.typed:
            return
        i, close = open_ + 1, self.close(open_)
        while i < close:
            stop = i
            while stop < close and self.t(stop) != ",":
                stop = self.generic(stop) if self.generic(stop) > stop else self.close(stop) + 1 if self.t(stop) == "(" else stop + 1
            begin = i
            while self.t(begin) in ("final", "@"):
                begin += 2 if self.t(begin) == "@" else 1
            if stop - 1 > begin and self.is_name(stop - 1):
                self.out.types.append({"name": self.t(stop - 1), "type": self.source[self.at[begin] : self.end(stop - 2)], "container": owner})
            i = stop + 1

    def run(self) -> Facts:
        if not self.n:
            return self.out
        if self.language in _SCRIPTS:
            if self.wanted - {"import"}:
                self.scripts()
            if "import" in self.wanted:
                self.script_imports()
        else:
            {"go": self.go, "rust": self.rust, "c": self.c, "cpp": self.c, "java": self.java}[self.language]()
        order = sorted(range(len(self.spans)), key=lambda k: (self.spans[k][0], -self.spans[k][1]))
        if "call" in self.wanted:
            self.all_calls([self.spans[k] for k in order])
        self.out.symbols = [self.out.symbols[k] for k in order]
        return self.out

    def all_calls(self, ordered: list[tuple[int, int, str]]) -> None:
        """Calls in their order, each with the innermost of the definitions ``ordered`` by their start around it."""
        kinds = {s["id"]: s["kind"] for s in self.out.symbols}
        functions = sorted(s[:2] for s in self.spans if kinds[s[2]] != "class")
        self.starts, self.reach = [f[0] for f in functions], list(accumulate((f[1] for f in functions), max))
        self.find_calls()
        if self.language in ("tsx", "javascript"):
            self.elements()
        stack, at = [], 0
        for call in sorted(self.out.calls, key=lambda c: c["at"]):
            while at < len(ordered) and ordered[at][0] <= call["at"]:
                stack.append(ordered[at])
                at += 1
            while stack and stack[-1][1] < call["at"]:
                stack.pop()
            around = [s for s in stack if s[1] >= call["at"]]
            call["symbol"] = around[-1][2] if around else None
        self.out.calls.sort(key=lambda c: c["at"])


#: Nodes that tell something, and nodes that do not and have none below that do.
_TOLD = frozenset({ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.arg, ast.AnnAssign, ast.Assign, ast.Call, ast.ImportFrom})
_BARE = frozenset({ast.Name, ast.Constant, ast.Load, ast.Store, ast.Del, ast.alias, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal, ast.Import, *ast.operator.__subclasses__(), *ast.unaryop.__subclasses__(), *ast.boolop.__subclasses__(), *ast.cmpop.__subclasses__()})


#: Facts of statements alone, and the fields that hold statements, from the last.
_OF_STATEMENTS = frozenset({"symbol", "import", "relation"})
_STATEMENTS_BACK = ("cases", "finalbody", "orelse", "handlers", "body")


def python_facts_of(file: str, source: str, wanted: frozenset[str] = _EVERY) -> Facts:
    """By the standard parser. Columns count characters, as those of the scanner do. If only facts of statements
    are wanted, expressions are not visited."""
    plainly, related = wanted <= _OF_STATEMENTS, "relation" in wanted
    out, raw = Facts(file), source.encode().split(b"\n")

    def column(node) -> int:
        return len(raw[node.lineno - 1][: node.col_offset].decode("utf-8", "replace"))

    def text(node) -> str:
        lines = raw[node.lineno - 1 : node.end_lineno]
        lines[-1] = lines[-1][: node.end_col_offset]
        lines[0] = lines[0][node.col_offset :]
        return b"\n".join(lines).decode("utf-8", "replace")

    def terminal(node) -> str:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name):
            return node.attr
        return ast.unparse(node).split("[")[0].split("(")[0].rpartition(".")[2]

    def bind(name, annotation, container):
        found = re.search(r"[^\W\d]\w*", annotation.id if isinstance(annotation, ast.Name) else ast.unparse(annotation).strip("'\"")) if annotation is not None else None
        if found:
            out.types.append({"name": name, "type": found[0], "container": container})

    todo: list[tuple[ast.AST, str | None, str | None, int]] = [(ast.parse(source), None, None, 0)]
    while todo:
        node, inside, owner, depth = todo.pop()
        if depth > MOST_DEPTH:
            out.truncated = True
            continue
        outer, within = inside, owner
        if type(node) not in _TOLD:
            pass
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "method" if owner else "function"
            inside = out.symbol(node.name, kind, owner, node.lineno - 1, column(node), node.end_lineno - 1, len(text(node)))
            if kind == "class":
                owner = node.name
                out.relations += [] if not related else [{"subtype": node.name, "supertype": terminal(b), "kind": "extends"} for b in node.bases if not isinstance(b, ast.Starred)]
        elif isinstance(node, ast.arg):
            bind(node.arg, node.annotation, owner)
        elif isinstance(node, ast.AnnAssign) and isinstance(node.target, (ast.Name, ast.Attribute)):
            bind(ast.unparse(node.target), node.annotation, owner)
        elif isinstance(node, ast.Assign) and isinstance(node.value, ast.Call) and isinstance(node.value.func, (ast.Name, ast.Attribute)) and terminal(node.value.func)[:1].isupper():
            for target in node.targets:
                if isinstance(target, (ast.Name, ast.Attribute)):
                    out.types.append({"name": ast.unparse(target).removeprefix("self."), "type": terminal(node.value.func), "container": owner})
        elif isinstance(node, ast.Call) and isinstance(node.func, (ast.Name, ast.Attribute)):
            name, receiver = (node.func.id, None) if isinstance(node.func, ast.Name) else (node.func.attr, text(node.func.value))
            out.calls.append({"at": (node.lineno, node.col_offset, node.end_lineno, node.end_col_offset), "name": name, "receiver": receiver, "line": node.lineno - 1, "symbol": inside})
        elif isinstance(node, ast.ImportFrom):
            out.imports += [{"source": "." * node.level + (node.module or ""), "local": a.asname or a.name} for a in node.names if a.name != "*"]
        decorators = getattr(node, "decorator_list", [])
        plain = depth + 2 < MOST_DEPTH  # no name or constant below is so deep that it counts
        if plainly:
            for name in _STATEMENTS_BACK:
                if below := getattr(node, name, None):
                    todo += [(child, inside, owner, depth + 1) for child in reversed(below)]
            continue
        for name in reversed(node._fields):
            below = getattr(node, name, None)
            for child in reversed(below) if isinstance(below, list) else (below,):
                if isinstance(child, ast.AST) and not (plain and type(child) in _BARE):
                    todo.append((child, outer, within, depth + 1) if child in decorators else (child, inside, owner, depth + 1))
    return out


_PY_LINE = re.compile(r"^([ \t]*)(?:(?:async[ \t]+)?def[ \t]+(\w+)|class[ \t]+(\w+)[ \t]*(?:\(([^)]*)\))?)", re.M)


def python_lines_of(file: str, source: str) -> Facts:
    """What lines alone say of a source that the parser refuses: definitions by their indent, imports."""
    out, lines = Facts(file), source.split("\n")
    widths = [len(x) - len(x.lstrip()) if x.strip() else None for x in lines]
    classes: list[tuple[int, str, int]] = []
    for m in _PY_LINE.finditer(source):
        row, indent = source.count("\n", 0, m.start()), len(m[1])
        end = next((k for k in range(row + 1, len(lines)) if widths[k] is not None and widths[k] <= indent), len(lines)) - 1
        classes = [c for c in classes if c[0] < indent and row <= c[2]]
        owner = classes[-1][1] if classes else None
        kind = "class" if m[3] else "method" if owner else "function"
        out.symbol(m[3] or m[2], kind, owner, row, indent, max(row, end), len("\n".join(lines[row : end + 1])))
        if m[3]:
            classes.append((indent, m[3], end))
            out.relations += [{"subtype": m[3], "supertype": b.split("[")[0].strip().rpartition(".")[2], "kind": "extends"} for b in (m[4] or "").split(",") if b.strip() and "=" not in b and not b.strip().startswith("*")]
    for m in re.finditer(r"^[ \t]*from[ \t]+([.\w]+)[ \t]+import[ \t]+\(?([\w \t,]+)", source, re.M):
        out.imports += [{"source": m[1], "local": part.split()[-1]} for part in m[2].split(",") if part.split()]
    return out


def extract(file: str, language: str, source: str, wanted: frozenset[str] = _EVERY) -> tuple[Facts, str | None]:
    """The wanted facts of one file, and the name of the error that made them partial, if one did."""
    if language != "python":
        return Scanner(file, language, source, wanted).run(), None
    try:
        return python_facts_of(file, source, wanted), None
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return python_lines_of(file, source), type(e).__name__


_NAMES = ["file", "fact", "ord", "id", "name", "kind", "container", "other", "line", "end_line", "tokens"]
_KINDS = [pa.string(), pa.string(), pa.int32(), *[pa.string()] * 5, pa.int32(), pa.int32(), pa.int32()]
SCHEMA = "file string, fact string, ord int, id string, name string, kind string, container string, other string, line int, end_line int, tokens int"


def rows_of(file: str, language: str, source: str, kinds: tuple[str, ...] = ()) -> list[tuple]:
    """Rows of one file's facts. With ``kinds`` only these need be there; they are all looked for, whatever is asked,
    if errors or cuts are asked for as well, as any of them may fail."""
    made, error = extract(file, language, source, frozenset(kinds) if kinds and _EVERY.issuperset(kinds) else _EVERY)
    rows = [("symbol", s["id"], s["name"], s["kind"], s["container"], None, s["start_line"], s["end_line"], s["tokens"]) for s in made.symbols]
    rows += [("call", c["symbol"], c["name"], None, None, c["receiver"], c["line"], None, None) for c in made.calls]
    rows += [("import", None, i["local"], None, None, i["source"], None, None, None) for i in made.imports]
    rows += [("type", None, t["name"], None, t["container"], t["type"], None, None, None) for t in made.types]
    rows += [("relation", None, r["subtype"], r["kind"], None, r["supertype"], None, None, None) for r in made.relations]
    rows += [("error", None, error, None, None, None, None, None, None)] if error else []
    rows += [("truncated", None, None, None, None, None, None, None, None)] if made.truncated else []
    return [(file, r[0], i, *r[1:]) for i, r in enumerate(rows)]


def spread(rows: DataFrame, files_each: int = 1) -> DataFrame:
    """Rows that sources are made of, ``files_each`` of every row, dealt to tasks of about FILES_A_TASK files: a
    small table is few splits, or one, however much work its files are."""
    return rows.repartition(max(1, -(-rows.count() * files_each // FILES_A_TASK)))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)


def facts(files: DataFrame, *kinds: str) -> DataFrame:
    """Rows of ``SCHEMA`` for ``files(file, language, source)``: fact is symbol, call (id: the calling symbol,
    other: the receiver), import (name: the local name, other: the module), type (other), relation
    (name: the subtype, other: the supertype), error (what is there comes from lines alone) or
    truncated. Files without a known language or source give none; one file never fails the rest.
    With ``kinds`` only rows of these facts leave the tasks, and no others are looked for unless errors or
    what was truncated are among them; ord then counts the facts that were looked for."""

    def run(batches):
        rows: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for file, language, source in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    if source is None or language != "python" and language not in _LEXERS:
                        continue
                    try:
                        found = rows_of(file, language, source, kinds)
                    except Exception as e:  # noqa: BLE001: what one file does must not end the scan
                        found = [(file, "error", 0, None, type(e).__name__, *[None] * 6)]
                    rows += (r for r in found if r[1] in kinds) if kinds else found
                if len(rows) >= ROWS_A_BATCH:
                    yield _batch(rows)
                    rows = []
        yield _batch(rows)

    return files.select("file", "language", "source").mapInArrow(run, SCHEMA)


def relations(found: DataFrame) -> dict[str, DataFrame]:
    """The relations of ``facts`` as resolution takes them: symbols, calls (top-level ones left out),
    imports (specifiers not yet resolved), types, type_relations."""
    def of(fact):
        return found.where(F.col("fact") == fact)

    return {
        "symbols": of("symbol").select("id", "name", "kind", "container", "file", F.col("line").alias("start"), F.col("end_line").alias("end"), "tokens"),
        "calls": of("call").where("id is not null").select(F.concat_ws("#", "file", "ord").alias("call"), F.col("id").alias("caller"), F.col("file").alias("caller_file"), "name", F.col("other").alias("receiver"), "line"),
        "imports": of("import").select("file", F.col("name").alias("local"), F.col("other").alias("specifier"), "ord"),
        "types": of("type").select("file", "name", F.col("other").alias("type"), "container", "ord"),
        "type_relations": of("relation").select("file", F.col("name").alias("subtype"), F.col("other").alias("supertype"), "kind"),
    }


def health(found: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files parsed, files that failed or were read in part, and whether a graph made of them
    can be relied upon: not if nothing was parsed or more files failed than were."""
    def with_fact(fact):
        return F.count_distinct(F.when(F.col("fact") == fact, F.col("file")))

    told = found.agg(with_fact("error").alias("failed"), with_fact("truncated").alias("truncated"))  # files are read once for both
    counted = files.agg(F.count("*").alias("files")).crossJoin(F.broadcast(told))  # one row each
    parsed = F.col("files") - F.col("failed")
    return counted.select("files", parsed.alias("parsed"), "failed", "truncated", ((parsed > 0) & (F.col("failed") <= parsed)).alias("reliable"))


def bodies(symbols: DataFrame, files: DataFrame, lines: int = BODY_LINES) -> DataFrame:
    """Adds body: the first lines of each symbol of ``files(file, source)``."""
    split = files.select(F.col("file").alias("_f"), F.split("source", "\n", -1).alias("_lines"))
    count = F.least(F.col("end") - F.col("start") + 1, F.lit(lines))
    return symbols.join(split, F.col("file") == F.col("_f")).withColumn("body", F.array_join(F.slice("_lines", F.col("start") + 1, count), "\n")).drop("_f", "_lines")
