"""Code symbols from source text, by language. A file is read whole, so this needs Python: one Arrow batch at a time.

A file becomes tokens, without comments and literals, and its brackets are paired. Symbols are read off the grammar: a
name before a parameter list is a definition if a body follows the list, a declaration if the statement ends there and
something like a type stands before the name, and else a call. Template arguments are stepped over as one bracket.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

# Symbols of a file at most, the worth of a kind, languages by file extension, and names that are no symbols.
MOST_SYMBOLS = 80
WORTH = {"function": 6, "method": 5, "declaration": 4, "type": 3, "macro": 3, "constant": 2, "call": 1}
LANGUAGES = {"go": "go", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "cs": "csharp", "java": "java", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python"}
NOISE = set("if for while switch return sizeof typeof new delete main printf sprintf malloc free memcpy memset assert operator template typename constexpr noexcept".split())
NOISE_OF = {
    "python": set("print len range open super".split()),
    "javascript": set("constructor require include define if for while switch catch function class return get set".split()),
    "java": set("if for while switch catch return new class interface enum record void int long boolean String".split()),
}


def norm(name: str) -> str:
    name = name.strip().removesuffix("()")
    return re.sub(r"\s+", "", name).lower()


def tail(name: str) -> str:
    """What follows the last qualifier."""
    for sep in ("::", ".", "#"):
        if sep in name:
            return name.rpartition(sep)[2]
    return name


# ---------------------------------------------------------------- tokens


class Token(NamedTuple):
    """A word, mark or directive. column is 0 for what begins a line unindented, first tells whether it begins one."""

    text: str
    line: int
    column: int
    first: bool
    word: bool


QUOTED = r'"(?:\\.|[^"\\\n])*"?|' + r"'(?:\\.|[^'\\\n])*'?"
REST = r"(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<number>\d[\w.']*)|(?P<mark>::|->|=>|\S)|(?P<line>\n)|(?P<space>[^\S\n]+)"
BRACED = re.compile(rf'(?P<skip>//[^\n]*|/\*.*?(?:\*/|\Z)|R"\((?:.*?)\)"|`(?:\\.|[^`\\])*`?|{QUOTED})|(?P<directive>^[ \t]*\#(?:[^\n\\]|\\.)*)|{REST}', re.S | re.M)
INDENTED = re.compile(rf'(?P<skip>\#[^\n]*|""".*?(?:"""|\Z)|' + rf"'''.*?(?:'''|\Z)|{QUOTED})|(?P<directive>(?!))|{REST}", re.S | re.M)
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
#: Template arguments hold types, numbers and these marks, and at most so many tokens.
IN_ANGLES, MOST_ANGLES = set("< > , : :: * & . ? [ ] ( ) = ->".split()), 400


class Source:
    """The tokens of a file, with the partner of each bracket."""

    def __init__(self, text: str, language: str) -> None:
        self.tokens: list[Token] = []
        self.partner: dict[int, int] = {}
        line, begins, start = 1, True, 0
        for m in (INDENTED if language == "python" else BRACED).finditer(text):
            kind, part = m.lastgroup, m.group()
            if kind == "line":
                line, begins, start = line + 1, True, m.end()
                continue
            if kind in ("word", "mark", "directive"):
                self.tokens.append(Token(part, line, m.start() - start, begins, kind == "word"))
            elif kind == "number":
                self.tokens.append(Token("0", line, m.start() - start, begins, False))
            if kind != "space":
                begins = False
            if "\n" in part:
                line, start = line + part.count("\n"), m.start() + part.rfind("\n") + 1
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.text in OPEN:
                stack.append(i)
            elif t.text in CLOSE:
                while stack and self.tokens[stack[-1]].text != CLOSE[t.text]:
                    stack.pop()  # a bracket without a partner
                if stack:
                    self.partner[i], self.partner[stack[-1]] = stack[-1], i
                    stack.pop()

    def at(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].word

    def past(self, i: int) -> int:
        """The place after the bracket at i and all that is in it; i + 1 if it has no partner."""
        return self.partner.get(i, i) + 1

    def past_angles(self, i: int) -> int:
        """The place after the template arguments that begin at i; i if they are none (a comparison, say)."""
        if self.at(i) != "<":
            return i
        depth = 0
        for j in range(i, min(len(self.tokens), i + MOST_ANGLES)):
            t = self.tokens[j]
            depth += (t.text == "<") - (t.text == ">")
            if not depth:
                return j + 1
            if not t.word and t.text != "0" and t.text not in IN_ANGLES:
                return i
        return i

    def name(self, i: int, joins: tuple[str, ...] = ("::",)) -> tuple[str, int]:
        """The qualified name that begins at i, and the place after it."""
        parts = [self.at(i)]
        i += 1
        while self.at(i) in joins and (self.word(i + 1) or self.at(i + 1) == "~" and self.word(i + 2)):
            parts.append(self.at(i))
            i += 1
            if not self.word(i):
                parts.append(self.at(i))
                i += 1
            parts.append(self.at(i))
            i += 1
        return "".join(parts), i


Found = Iterator[tuple[str, str, Token]]  # (name, kind, the name's token)

# ---------------------------------------------------------------- languages


def go_symbols(s: Source) -> Found:
    """func Name, and func (receiver) Name."""
    for i, t in enumerate(s.tokens):
        if t.text == "func" and t.column == 0 and t.first:
            method = s.at(i + 1) == "(" and s.partner.get(i + 1, 0) > i + 2
            j = s.past(i + 1) if s.at(i + 1) == "(" else i + 1
            after = s.past(j + 1) if s.at(j + 1) == "[" else j + 1  # type parameters
            if s.word(j) and s.at(after) == "(":
                yield s.at(j), "method" if method else "function", s.tokens[j]


def python_symbols(s: Source) -> Found:
    """class and def; an indented def is a method."""
    for i, t in enumerate(s.tokens):
        begins = t.first or s.at(i - 1) == "async" and s.tokens[i - 1].first
        if begins and t.text == "class" and s.word(i + 1) and s.at(i + 2) in (":", "("):
            yield s.at(i + 1), "type", s.tokens[i + 1]
        elif begins and t.text == "def" and s.word(i + 1) and s.at(i + 2) == "(":
            head = t if t.first else s.tokens[i - 1]
            yield s.at(i + 1), "method" if head.column else "function", s.tokens[i + 1]


def script_symbols(s: Source) -> Found:
    """JavaScript and TypeScript: classes, functions, names bound to functions, and methods, which have bodies."""
    for i, t in enumerate(s.tokens):
        if not t.first:
            continue
        j = i
        while s.at(j) in ("export", "default", "async", "abstract", "declare"):
            j += 1
        if s.at(j) == "class" and s.word(j + 1):
            yield s.at(j + 1), "type", s.tokens[j + 1]
        elif s.at(j) == "function":
            k = j + 1 + (s.at(j + 1) == "*")
            if s.word(k) and s.at(s.past_angles(k + 1)) == "(":
                yield s.at(k), "function", s.tokens[k]
        elif s.at(j) in ("const", "let", "var") and s.word(j + 1) and s.at(j + 2) == "=":
            k = j + 3 + (s.at(j + 3) == "async")
            if s.at(k) == "function" or s.at(k) == "(" and s.at(typed(s, s.past(k))) == "=>":
                yield s.at(j + 1), "function", s.tokens[j + 1]
        else:
            while s.at(j) in ("public", "private", "protected", "static", "override", "readonly", "*") and s.at(j + 1) != "(":
                j += 1
            k = s.past_angles(j + 1)
            if s.word(j) and s.at(k) == "(" and s.at(typed(s, s.past(k))) == "{":
                yield s.at(j), "method", s.tokens[j]


def typed(s: Source, i: int) -> int:
    """The place after a type annotation that may stand at i."""
    if s.at(i) != ":":
        return i
    i += 1
    while s.word(i) or s.at(i) in (".", "|", "&", "[", "<"):
        i = s.past(i) if s.at(i) == "[" else max(i + 1, s.past_angles(i))
    return i


#: Words that begin a class member or type, by language, and those that name a type's kind.
MODIFIERS = {
    "java": set("public protected private static final synchronized native abstract default strictfp sealed".split()),
    "csharp": set("public protected private internal static virtual override abstract async sealed extern new partial readonly unsafe".split()),
}
KINDS = {"class", "interface", "enum", "record", "struct"}
#: Words that begin a statement or expression, so that no member is declared there.
STATEMENTS = set("return new throw else case goto delete await yield using if for while switch do try catch typedef assert co_return".split())


def member_symbols(s: Source, language: str) -> Found:
    """Java and C#: types, methods (which have bodies), and in Java declarations, which have none."""
    for i, t in enumerate(s.tokens):
        if not t.first or not t.word:
            continue
        j = i
        while s.at(j) in MODIFIERS[language] and s.word(j + 1):
            j += 1
        if s.at(j) in KINDS and s.word(j + 1):
            yield s.at(j + 1), "type", s.tokens[j + 1]
            continue
        if s.at(j) in STATEMENTS:
            continue
        k = s.past_angles(j)  # a generic method's own parameters
        last = -1
        while s.word(k) or s.at(k) in (".", "[", "?"):  # the type, then the name
            last = k if s.word(k) else last
            k = s.past(k) if s.at(k) == "[" else max(k + 1, s.past_angles(k + 1))
        if s.at(k) != "(" or k in s.partner and last < k - 1 and s.at(k - 1) != ">" or last <= j:
            continue
        end = s.past(k)
        if s.at(end) in ("throws", "where"):
            while end < len(s.tokens) and s.at(end) not in ("{", ";"):
                end += 1
        if s.at(end) in ("{", "=>") and (j > i or language == "java"):
            yield s.at(last), "method", s.tokens[last]
        elif s.at(end) == ";" and language == "java":
            yield s.at(last), "declaration", s.tokens[last]


def native_symbols(s: Source) -> Found:
    """C and C++: what begins a line unindented is at the level of a file or namespace, and may define something."""
    for i, t in enumerate(s.tokens):
        if not t.first or t.column:
            continue
        j = s.past_angles(i + 1) if t.text == "template" else i
        if s.at(j) in ("class", "struct", "union", "enum", "interface"):
            k = j + 1 + (s.at(j) == "enum" and s.at(j + 1) in ("class", "struct"))
            if s.word(k):
                yield s.at(k), "type", s.tokens[k]
        elif s.at(j) == "using" and s.word(j + 1) and s.at(j + 2) == "=":
            yield s.at(j + 1), "type", s.tokens[j + 1]
        elif s.at(j) == "typedef":
            end = next((k for k in range(j, len(s.tokens)) if s.at(k) in (";", "{", "(")), 0)
            if s.at(end) == ";" and s.word(end - 1) and end - 1 > j:
                yield s.at(end - 1), "type", s.tokens[end - 1]
        if s.word(j) and s.at(j) not in STATEMENTS and s.at(j) not in NOISE - {"constexpr"}:
            yield from declared(s, j)


def declared(s: Source, i: int) -> Found:
    """The function or constant that the statement at i declares."""
    k, fixed, seen = i, False, 0
    while k < len(s.tokens):
        if s.word(k):
            name, end = s.name(k)
            fixed |= name in ("const", "constexpr")
            after = s.past_angles(end)
            if s.at(after) == "(":
                body = trailer(s, s.past(after))
                if s.at(body) == "{" and (seen or "::" in name):
                    yield name, "method" if "::" in name else "function", s.tokens[k]
                elif s.at(body) == ";" and seen:
                    yield name, "declaration", s.tokens[k]
                return
            if s.at(after) == "=" and fixed and seen and len(name) > 2 and name[0].isalpha() and re.fullmatch("[A-Z0-9_]+", name):
                yield name, "constant", s.tokens[k]
            if s.at(after) == "::":  # template arguments within a qualified name
                name_end = after + 1
                after = name_end if s.word(name_end) else after
            seen, k = seen + 1, after
        elif s.at(k) in ("*", "&"):
            k += 1
        elif s.at(k) == "[" and s.at(k + 1) == "[":
            k = s.past(k)
        else:
            return


def trailer(s: Source, i: int) -> int:
    """The place after what may stand between a parameter list and a body: qualifiers, a trailing type, initialisers."""
    while True:
        if s.at(i) in ("const", "override", "final", "volatile", "try", "&"):
            i += 1
        elif s.at(i) == "noexcept":
            i = s.past(i + 1) if s.at(i + 1) == "(" else i + 1
        elif s.at(i) == "->":
            i += 1
            while s.word(i) or s.at(i) in ("::", "*", "&", "<"):
                i = max(i + 1, s.past_angles(i))
        elif s.at(i) == ":":
            while i < len(s.tokens) and s.at(i) not in ("{", ";"):
                i = s.past(i)
        else:
            return i


def directives(s: Source) -> Found:
    """Macros."""
    for t in s.tokens:
        if t.column == 0 and (m := re.match(r"#\s*define\s+([^\W\d]\w*)", t.text)):
            yield m.group(1), "macro", t


def calls(s: Source) -> Found:
    """Names before an argument list: the last two parts of qualified and member names, and names in Pascal case."""
    for i in range(len(s.tokens)):
        if s.word(i) and s.at(i + 1) == "(":
            if s.at(i - 1) in ("::", ".") and s.word(i - 2):
                yield s.at(i - 2) + s.at(i - 1) + s.at(i), "call", s.tokens[i - 2]
            name = s.at(i)
            if name.isalnum() and name.isascii() and name[0].isupper() and any(c.isupper() for c in name[3:]):
                yield name, "call", s.tokens[i]


def found_in(s: Source, language: str) -> Found:
    if language == "go":
        yield from go_symbols(s)
    elif language == "python":
        yield from python_symbols(s)
    elif language in ("javascript", "typescript"):
        yield from script_symbols(s)
    elif language == "java":
        yield from member_symbols(s, language)
    else:
        if language == "csharp":
            yield from member_symbols(s, language)
        else:
            yield from native_symbols(s)
        yield from directives(s)
        yield from calls(s)


def symbols_of(path: str, text: str) -> list[tuple[str, str, str, str, int]]:
    """(name, kind, language, signature, line) of a file's symbols: the best kind of each name, the best ones if many."""
    base = path.rpartition("/")[2]
    language = LANGUAGES.get(base.rpartition(".")[2].lower() if "." in base else "")
    if not language:
        return []
    lines, family = text.split("\n"), "javascript" if language == "typescript" else language
    everything = [(n, k, t) for n, k, t in found_in(Source(text, language), language) if len(n) > 1 and tail(n).lower() not in NOISE and tail(n) not in NOISE_OF.get(family, ())]
    defined = {norm(x) for n, k, _ in everything if k in ("function", "method") for x in (n, tail(n))}
    everything = [x for x in everything if x[1] not in ("declaration", "call") or norm(x[0]) not in defined and norm(tail(x[0])) not in defined]
    declared_too = {norm(n) for n, k, _ in everything if k == "declaration"}
    everything = [x for x in everything if x[1] != "call" or norm(x[0]) not in declared_too and norm(tail(x[0])) not in declared_too]
    everything.sort(key=lambda x: -WORTH[x[1]])  # stable: by place within a worth
    best: dict[str, tuple[str, str, str, str, int]] = {}
    for name, kind, t in everything[:MOST_SYMBOLS]:
        best.setdefault(norm(name), (name, kind, language, f"{name}()" if kind == "call" else lines[t.line - 1].strip(), t.line))
    return sorted(best.values(), key=lambda x: x[4])


def extract(files: DataFrame, *keys: str) -> DataFrame:
    """The columns of keys (path alone if none) with name, kind, language, signature and line, for all files (path, text)."""
    keys = keys or ("path",)
    fields = [files.schema[k] for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, texts = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("path", "text"))
            rows = [(i, *s) for i, (p, t) in enumerate(zip(paths, texts, strict=True)) if p and t for s in symbols_of(p, t)]
            at, *columns = zip(*rows, strict=True) if rows else [[]] * 6
            kept = [b.column(b.schema.get_field_index(k)).take(pa.array(at, pa.int32())) for k in keys]
            made = [pa.array(c, k) for c, k in zip(columns, [pa.string()] * 4 + [pa.int32()], strict=True)]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[*keys, "name", "kind", "language", "signature", "line"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "name string, kind string, language string, signature string, line int"])
    return files.select(*dict.fromkeys([*keys, "path", "text"])).mapInArrow(run, schema)


INCLUDE = re.compile(r"^#\s*include\s*[<\"]([^>\"]+)[>\"]", re.M)


def includes(text: str) -> list[str]:
    return [f'#include "{x}"' for x in INCLUDE.findall(text)]


def api_token(token: str) -> bool:
    """Whether a word of a text reads as an API name."""
    t = token.strip("`,.;()<>\"'")
    return len(t) >= 3 and ("::" in t or "." in t or "_" in t or (any(c.isupper() for c in t) and any(c.islower() for c in t)))
