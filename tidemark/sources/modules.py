"""Module facts from tokens: declarations, what they use, exports, imports, what runs on load.

A file is cut into tokens and top-level statements. Names are matched by spelling: an identifier
counts as a use of the declaration or import of that name, even where a parameter hides it, so
uses are never missed. CommonJS exports count where they are plain assignments. A file whose shape cannot be
told (unbalanced brackets, computed imports, other uses of the exports object, ``eval``,
namespaces, decorators) gives None: it is one opaque unit.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from tidemark.functions.types import erased

TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')"
    r"|(?P<name>[A-Za-z_$#ª-￿][\w$ª-￿]*)|(?P<number>\d[\w.]*)"
    r"|(?P<sign>=>|\.\.\.|\?\.(?!\d)|\*\*=|>>>=|<<=|>>=|&&=|\|\|=|\?\?=|===|!==|==|!=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\+\+|--|&&|\|\||\?\?|.)",
    re.S,
)
REGEX = re.compile(r"/(?![*/>])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
BEFORE_REGEX = set("(,=:[!&|?{};+-*%~^<") | {"=>", "&&", "||", "??", "return", "typeof", "case", "=="}
NO_END = set("=,+-*/%&|^<.?:([{!~") | {"=>", "&&", "||", "??", "==", "===", "!=", "!==", "?.", "...", "+=", "-=", "extends", "default", "const", "let", "var", "new", "return", "typeof", "await", "async", "import", "export", "from", "as", "in", "of", "instanceof", "function", "class"}
NO_START = set("=,+*/%&|^<>.?:)]}([") | {"=>", "&&", "||", "??", "==", "===", "!=", "!==", "?.", "+=", "-=", "extends", "instanceof", "in", "of", "as", "else", "catch", "finally", "while_"}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "&=", "|=", "^=", "<<=", ">>=", ">>>=", "&&=", "||=", "??=", "++", "--"}
DECLARES = {"const", "let", "var", "function", "class", "enum", "async", "abstract"}
#: Words and names that an expression may hold without running anything or failing.
PLAIN_WORDS = frozenset("undefined null true false NaN Infinity typeof void".split())
# Calls that only make a value, by source and name.
PURE = frozenset({("react", "memo"), ("react", "forwardRef"), ("react", "createContext"), ("react", "lazy")})


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int
    line_before: bool
    depth: int = 0


class Opaque(Exception):
    pass


@dataclass
class Use:
    """An import that something uses: export name, or None for the whole module; the member of the
    export's value that alone is read, or None for all of it."""

    source: int
    name: str | None
    member: str | None = None


@dataclass
class Member:
    """A property of an object literal that is only ever read by its properties' names. Its span
    reaches from the line or comma before it to its own end of line or comma."""

    name: str
    start: int
    end: int
    tokens: list[Token]
    receiver: bool  # calling it may read the whole object
    refs: list[int] = field(default_factory=list)
    imports: list[Use] = field(default_factory=list)
    member_refs: list[tuple[int, str]] = field(default_factory=list)
    written_by: list[int] = field(default_factory=list)


@dataclass
class Decl:
    names: list[str]
    start: int
    end: int
    runs: bool = False
    fixed: bool = False  # nothing can write to it
    plain: bool = False  # a number or string: only assignments change it
    refs: list[int] = field(default_factory=list)
    imports: list[Use] = field(default_factory=list)
    writes: list[int] = field(default_factory=list)
    written_by: list[int] = field(default_factory=list)  # who may write to what it uses
    member_refs: list[tuple[int, str]] = field(default_factory=list)  # objects of which one member is used
    members: list[Member] = field(default_factory=list)

    @property
    def needs(self) -> set[int]:
        """All declarations that it uses in some way."""
        return {*self.refs, *self.written_by, *(o for o, _ in self.member_refs)}


@dataclass
class Piece:
    """One top-level statement: what it declares, exports and imports."""

    tokens: list[Token]
    key: tuple
    decls: list[int]
    exports: list[str]
    imported: list[str]
    sources: list[int]
    star: bool

    @property
    def start(self) -> int:
        return self.tokens[0].start

    @property
    def end(self) -> int:
        return self.tokens[-1].end

    @property
    def bare(self) -> bool:
        """Whether it only runs: it declares, exports and imports nothing."""
        return self.key[0] == "runs"


@dataclass
class Module:
    sources: list[str] = field(default_factory=list)
    bare: set[int] = field(default_factory=set)
    decls: list[Decl] = field(default_factory=list)
    exports: list[tuple[str, str, int, str | None, int, int]] = field(default_factory=list)  # name, kind, decl or source, source name, span
    stars: list[int] = field(default_factory=list)
    init_decls: set[int] = field(default_factory=set)
    init_imports: list[Use] = field(default_factory=list)
    reads_on_load: list[int] = field(default_factory=list)
    import_spans: list[tuple[int, int, list[int]]] = field(default_factory=list)


def tokens(text: str) -> list[Token]:
    out: list[Token] = []
    at, line = 0, True
    stack: list[str] = []
    while at < len(text):
        last = out[-1] if out else None
        if text[at] == "/" and text[at + 1 : at + 2] not in ("/", "*") and (last is None or last.text in BEFORE_REGEX) and (m := REGEX.match(text, at)):
            out.append(Token("regex", m[0], at, m.end(), line, len(stack)))
            at, line = m.end(), False
            continue
        if text[at] == "`":
            end = _template_end(text, at)
            out.append(Token("template", text[at:end], at, end, line, len(stack)))
            at, line = end, False
            continue
        m = TOKEN.match(text, at)
        kind = m.lastgroup
        at = m.end()
        if kind in ("space", "comment"):
            line |= "\n" in m[0]
            continue
        if m[0] in ")]}":
            if not stack or stack.pop() != m[0]:
                raise Opaque("brackets")
        out.append(Token(kind, m[0], m.start(), m.end(), line, len(stack)))
        if m[0] in "([{" and kind == "sign":
            stack.append({"(": ")", "[": "]", "{": "}"}[m[0]])
        line = False
    if stack:
        raise Opaque("brackets")
    return out


def _template_end(text: str, at: int) -> int:
    i, depth = at + 1, 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if not depth and c == "`":
            return i + 1
        if text.startswith("${", i):
            depth += 1
            i += 2
            continue
        if depth:
            if c == "`":
                i = _template_end(text, i)
                continue
            depth += (c == "{") - (c == "}")
        i += 1
    raise Opaque("template")


def statements(toks: list[Token]) -> list[list[Token]]:
    """Runs of tokens at the top level, by semicolons, blocks and line ends that end a statement."""
    out: list[list[Token]] = []
    now: list[Token] = []

    def close() -> None:
        nonlocal now
        if now and not all(t.text == ";" for t in now):
            out.append(now)
        now = []

    for t in toks:
        if now and t.depth == 0:
            last = now[-1]
            ended_block = last.text == "}" and _is_block(now)
            if t.line_before and last.depth == 0 and (ended_block or last.text not in NO_END and t.text not in NO_START) or ended_block and t.text not in NO_START and not _goes_on(now, t):
                close()
        now.append(t)
        if t.depth == 0 and t.text == ";":
            close()
    close()
    return out


def _head(s: list[Token]) -> list[str]:
    words = [t.text for t in s[:5]]
    while words and words[0] in ("export", "default", "async", "abstract"):
        words = words[1:]
    return words


def _is_block(s: list[Token]) -> bool:
    head = _head(s)
    if s[0].text == "export" and head[:1] == ["{"]:
        return False
    return bool(head) and head[0] in ("function", "class", "enum", "if", "for", "while", "try", "switch", "do", "{") or head[:2] == ["const", "enum"]


def _goes_on(s: list[Token], t: Token) -> bool:
    return t.text in ("else", "catch", "finally") or _head(s)[:1] == ["do"] and t.text == "while"


def _text(t: Token) -> str:
    return t.text[1:-1]


class _Reader:
    def __init__(self, text: str, pure: frozenset[tuple[str, str]] = PURE):
        self.text, self.m, self.pure = text, Module(), pure
        self.bindings: dict[str, tuple[int, str | None]] = {}  # local name -> source, export name (None: namespace)
        self.named: dict[str, int] = {}
        self.hoisted: dict[int, bool] = {}
        self.late: dict[int, bool] = {}
        self.import_statements: list[tuple[int, int, list[str]]] = []
        self.pending: list[tuple[str, str, int, int]] = []
        self.bodies: list[tuple[int | None, list[Token]]] = []
        self.mentions = 0
        self.assigned_exports: list[tuple[str, str, int, str | None, int, int]] = []
        self.pieces: list[Piece] = []
        self.objects: dict[int, list[Member]] = {}
        self.used_whole: set[int] = set()
        self.values: dict[int, list[Token]] = {}  # of a declaration that has one, not taken apart
        self.quiet: dict[str, int] = {}  # local functions that are proven to run nothing

    def source(self, spec: str) -> int:
        if spec not in self.m.sources:
            self.m.sources.append(spec)
        return self.m.sources.index(spec)

    def read(self) -> Module:
        toks = tokens(self.text)
        words = {t.text for t in toks if t.kind == "name"}
        if words & {"eval", "with"} or any(t.text == "@" for t in toks):
            raise Opaque("shape")
        self.toks = toks
        for s in statements(toks):
            self.piece(s)
        # every mention of the exports object has to be one of the plain assignments
        mentions = sum(t.kind == "name" and t.text in ("exports", "module") for t in toks)
        if mentions != self.mentions or mentions and (self.m.exports or self.pending or self.m.stars or self.import_statements):
            raise Opaque("exports")
        self.m.exports += self.assigned_exports
        if len({e[0] for e in self.assigned_exports}) < len(self.assigned_exports):
            raise Opaque("exports")
        for name, local, a, b in self.pending:
            if local in self.named:
                self.m.exports.append((name, "local", self.named[local], None, a, b))
            elif local in self.bindings:
                source, export = self.bindings[local]
                self.m.exports.append((name, "all" if export is None else "reexport", source, export, a, b))
            else:
                raise Opaque("export")
        self.prove_helpers()
        for owner, body in self.bodies:
            self.uses(owner, body)
        self.settle()
        return self.m

    # --- statements

    def piece(self, s: list[Token]) -> None:
        """Read a statement and note what came of it."""
        m = self.m
        marks = [len(x) for x in (m.decls, m.exports, self.pending, self.assigned_exports, self.import_statements, m.stars)]
        bare = set(m.bare)
        self.statement(s)
        decls = list(range(marks[0], len(m.decls)))
        exports = [e[0] for e in m.exports[marks[1] :]] + [e[0] for e in self.pending[marks[2] :]] + [e[0] for e in self.assigned_exports[marks[3] :]]
        imported = [n for i in self.import_statements[marks[4] :] for n in i[2]]
        star = len(m.stars) > marks[5]
        w = [t.text for t in s]
        asked = w[0] == "import" and w[1:2] not in (["("], ["."]) or w[0] == "export" and "from" in w and not decls
        where = next((t.text for t in reversed(s) if t.kind == "string"), "") if asked else ""
        if decls:
            key = ("declares", *[n for d in decls for n in m.decls[d].names])
        elif asked:
            key = (w[0], "star" if star else "names", where)
        elif exports:
            key = ("exports",)
        else:
            key = ("runs",)
        sources = [m.sources.index(where[1:-1])] if asked and where[1:-1] in m.sources else []
        self.pieces.append(Piece(s, key, decls, exports, imported, sources if sources or not m.bare - bare else sorted(m.bare - bare), star))

    def statement(self, s: list[Token]) -> None:
        w = [t.text for t in s]
        if w[-1] == ";":
            s, w = s[:-1], w[:-1]
        if not w:
            return
        if w[0] == "import" and w[1:2] not in (["("], ["."]):
            return self.imports(s, w)
        if w[0] == "export":
            return self.exported(s, w)
        if w[0] in DECLARES and not (w[0] == "async" and w[1:2] != ["function"]):
            self.declared(s, w)
        elif w[0] in ("namespace", "module", "global") and len(w) > 2 and w[2] == "{":
            raise Opaque("namespace")
        elif not self.commonjs(s, w):
            self.bodies.append((None, s))

    def commonjs(self, s: list[Token], w: list[str]) -> bool:
        """``exports.a = exports.b = value``, ``module.exports = { a, b: value }``, a defined property."""
        names, i, seen = [], 0, 0
        while True:
            if w[i : i + 2] == ["exports", "."] and w[i + 3 : i + 4] == ["="]:
                names.append(w[i + 2])
                i, seen = i + 4, seen + 1
            elif w[i : i + 4] == ["module", ".", "exports", "."] and w[i + 5 : i + 6] == ["="]:
                names.append(w[i + 4])
                i, seen = i + 6, seen + 2
            else:
                break
        if names:
            self.mentions += seen
            if w[i:] != ["void", "0"]:
                self.assigned_export(names, s, s[i:])
            return True
        if w[:5] == ["module", ".", "exports", "=", "{"] and s[-1].text == "}" and s[-1].depth == s[4].depth:
            self.mentions += 2
            part: list[Token] = []
            for t in s[5:]:
                if t.text == "," and t.depth == s[4].depth + 1 or t is s[-1]:
                    if part:
                        if part[0].text in ("...", "[", "get", "set") and part[1:2] and part[1].text not in (":", "("):
                            raise Opaque("exports")
                        name = part[0].text.strip("'\"")
                        self.assigned_export([name], part, part[2:] if part[1:2] and part[1].text == ":" else part)
                    part = []
                else:
                    part.append(t)
            return True
        if w[:5] == ["Object", ".", "defineProperty", "(", "exports"] and len(s) > 7 and s[6].kind == "string":
            self.mentions += 1
            if _text(s[6]) != "__esModule":
                self.assigned_export([_text(s[6])], s, s[8:-1])
            return True
        return False

    def assigned_export(self, names: list[str], s: list[Token], value: list[Token]) -> None:
        method = len(value) > 1 and value[0].kind == "name" and value[1].text == "(" and value[-1].text == "}"
        d = self.add([f"exports.{n}" for n in names], s, not method and self.expression_runs(value))
        self.bodies.append((d, value))
        self.assigned_exports += [(n, "local", d, None, s[0].start, s[-1].end) for n in names]

    def imports(self, s: list[Token], w: list[str]) -> None:
        if s[-1].kind != "string" and "from" not in w and s[1].kind != "string":
            raise Opaque("import")
        if s[1].kind == "string":
            self.m.bare.add(self.source(_text(s[1])))
            return
        at = len(w) - 1 - w[::-1].index("from")
        if s[at + 1].kind != "string":
            raise Opaque("import")
        source, clause, names = self.source(_text(s[at + 1])), w[1:at], []
        i = 0
        while i < len(clause):
            if clause[i] == "*":
                self.bindings[clause[i + 2]] = (source, None)
                names.append(clause[i + 2])
                i += 3
            elif clause[i] == "{":
                end = clause.index("}", i)
                for part in " ".join(clause[i + 1 : end]).split(","):
                    p = part.split()
                    if not p or p[0] == "type" and len(p) > 1 and p[1] != "as":
                        continue
                    export, local = p[0].strip("'\""), p[-1]
                    self.bindings[local] = (source, export)
                    names.append(local)
                i = end + 1
            elif clause[i] == ",":
                i += 1
            else:
                self.bindings[clause[i]] = (source, "default")
                names.append(clause[i])
                i += 1
        self.import_statements.append((s[0].start, s[-1].end, names))

    def exported(self, s: list[Token], w: list[str]) -> None:
        a, b = s[0].start, s[-1].end
        if w[1] == "*":
            source = self.source(_text(s[-1] if s[-1].kind == "string" else s[w.index("from") + 1]))
            if w[2] == "as":
                self.m.exports.append((w[3].strip("'\""), "all", source, None, a, b))
            else:
                self.m.stars.append(source)
        elif w[1] == "{":
            end = w.index("}")
            source = self.source(_text(s[end + 2])) if w[end + 1 : end + 2] == ["from"] else None
            part: list[Token] = []
            for t in [*s[2:end], s[end]]:
                if t.text not in (",", "}"):
                    part.append(t)
                    continue
                if part and not (part[0].text == "type" and len(part) > 1 and part[1].text != "as"):
                    local, name = part[0].text.strip("'\""), part[-1].text.strip("'\"")
                    if source is None:
                        self.pending.append((name, local, part[0].start, part[-1].end))
                    else:
                        self.m.exports.append((name, "reexport", source, local, part[0].start, part[-1].end))
                part = []
        elif w[1] == "default":
            head = w[2:5]
            if head[:1] == ["function"] or head[:2] == ["async", "function"] or head[:1] == ["class"] or head[:2] == ["abstract", "class"]:
                body = s[2:]
                k = next(i for i, t in enumerate(body) if t.text in ("function", "class")) + 1
                k += body[k].text == "*"
                name = [body[k].text] if body[k].kind == "name" and body[k].text != "extends" else []
                d = self.add(["default", *name], s, runs="class" in head and self.class_runs(body), fixed=True)
                self.bodies.append((d, body))
            elif len(w) == 3 and s[2].kind == "name" and w[2] not in ("null", "true", "false", "undefined"):
                self.pending.append(("default", w[2], a, b))
                return
            else:
                d = self.add(["default"], s, runs=self.expression_runs(s[2:]))
                self.bodies.append((d, s[2:]))
            self.m.exports.append(("default", "local", d, None, a, b))
        elif w[1] in DECLARES:
            for d in self.declared(s[1:], w[1:], a):
                for name in self.m.decls[d].names:
                    self.m.exports.append((name, "local", d, None, self.m.decls[d].start, self.m.decls[d].end))
        else:
            raise Opaque("export")

    def add(self, names: list[str], s: list[Token], runs: bool = False, fixed: bool = False, start: int | None = None) -> int:
        self.m.decls.append(Decl(names, s[0].start if start is None else start, s[-1].end, runs, fixed))
        d = len(self.m.decls) - 1
        self.hoisted[d] = fixed and any(t.text == "function" for t in s[:4])
        self.late[d] = fixed and not runs
        for n in names:
            self.named[n] = d
        return d

    def declared(self, s: list[Token], w: list[str], start: int | None = None) -> list[int]:
        if w[0] in ("function", "async", "class", "abstract", "enum") or w[:2] == ["const", "enum"]:
            k = next(i for i, x in enumerate(w) if x in ("function", "class", "enum")) + 1
            k += w[k] == "*"
            d = self.add([w[k]], s, runs=w[k - 1] == "class" and self.class_runs(s) or w[k - 1] == "enum" and "(" in w, fixed=w[k - 1] != "enum", start=start)
            self.bodies.append((d, s))
            return [d]
        out, part = [], []
        base = s[0].depth
        angle = 0
        for t in [*s[1:], None]:
            if t is not None and t.depth == base:
                angle += (t.text == "<") - (t.text == ">") if part and part[-1].text != "=" else 0
            if t is None or t.text == "," and t.depth == base and angle <= 0:
                if part:
                    out.append(self.declarator(w[0], part, start if not out else None, s))
                part = []
            else:
                part.append(t)
        return out

    def declarator(self, kind: str, part: list[Token], start: int | None, s: list[Token]) -> int:
        base = part[0].depth
        eq = next((i for i, t in enumerate(part) if t.text == "=" and t.depth == base), None)
        target = part[:eq] if eq is not None else part
        value = part[eq + 1 :] if eq is not None else []
        if target[0].kind == "name":
            names, pattern = [target[0].text], False
        else:
            inside = [t for i, t in enumerate(target) if t.kind == "name" and target[i + 1 : i + 2] and target[i + 1].text != ":"]
            names, pattern = [t.text for t in inside], True
            if not names:
                names = ["_"]
        runs = bool(value) and (pattern or self.expression_runs(value))
        simple = len(value) == 1 and value[0].kind in ("string", "number", "regex") or bool(value) and self.is_function(value)
        d = self.add(names, part, runs, kind == "const" and simple and (not value or value[0].kind != "regex"), s[0].start if start is None and part is not None and part[0] is s[1] else start)
        self.m.decls[d].plain = not pattern and len(value) == 1 and value[0].kind in ("string", "number") and all(
            after.kind in ("string", "number") and beyond.text in (";", "}", ")")
            for t, eq_, after, beyond in zip(self.toks, self.toks[1:], self.toks[2:], [*self.toks[3:], Token("sign", ";", 0, 0, False)], strict=False)
            if t.text == names[0] and eq_.text == "=" and t is not target[0]
        )
        self.bodies.append((d, part))
        if not pattern and value:
            self.values[d] = value
        if kind == "const" and not pattern and len(names) == 1 and not runs and (members := self.object_members(value)):
            self.objects[d] = members
        return d

    def object_members(self, v: list[Token]) -> list[Member] | None:
        """The properties of a plain object literal; None if some cannot be told apart: spread or
        computed ones, accessors, generators, names that come twice, a prototype."""
        if len(v) < 3 or v[0].text != "{" or v[-1].text != "}" or any(t.text == "}" and t.depth == v[0].depth for t in v[:-1]):
            return None
        inner, part, parts = v[0].depth + 1, [], []
        for t in v[1:]:
            if t is v[-1] or t.text == "," and t.depth == inner:
                if part:
                    parts.append((part, t))
                part = []
            else:
                part.append(t)
        out, at = [], self._line_end(v[0].end, parts[0][0][0].start) if parts else 0
        for n, (part, stop) in enumerate(parts):
            end = v[-1].start if n + 1 == len(parts) else self._line_end(stop.end, parts[n + 1][0][0].start)
            key, after = part[0], part[1].text if len(part) > 1 else ""
            if key.text == "async" and len(part) > 2 and part[1].kind == "name" and part[2].text == "(":
                key, value = part[1], part[2:]
            elif key.kind not in ("name", "string") or key.text in ("get", "set", "async", "static") and after not in ("", ":", "("):
                return None
            elif after == ":":
                value = part[2:]
            elif after == "(" and part[-1].text == "}":
                value = part[1:]
            elif not after and key.kind == "name":
                value = part
            else:
                return None
            name = _text(key) if key.kind == "string" else key.text
            if not value or name == "__proto__" or not re.fullmatch(r"[A-Za-z_$][\w$]*", name) or any(m.name == name for m in out):
                return None
            out.append(Member(name, at, end, value, self.may_read_receiver(value, after == "(")))
            at = end
        return out

    def _line_end(self, at: int, before: int) -> int:
        """Behind the first line end after ``at``, if there is one before the next token."""
        end = self.text.find("\n", at, before)
        return end + 1 if end >= 0 else before

    @staticmethod
    def says_this(v: list[Token]) -> bool:
        return any(t.text in ("this", "super", "arguments", "eval", "class") or t.kind == "template" and "this" in t.text for t in v)

    def may_read_receiver(self, v: list[Token], method: bool) -> bool:
        """Whether calling the member may read the object that it is called on."""
        if self.says_this(v):
            return True
        if method or self.is_function(v) or v[0].text in ("{", "[") and v[-1].text in ("}", "]") and not any(t.depth == v[0].depth for t in v[1:-1]):
            return False
        return not (len(v) == 1 and (v[0].kind in ("string", "number", "template", "regex") or v[0].text in ("true", "false", "null", "undefined")))

    # --- what runs

    def prove_helpers(self) -> None:
        """Calls of local functions that are proven to run nothing are no reason for a value to
        run. Leaves are proven first; what calls itself never is. A helper may only be called
        behind everything that it reads and that is not hoisted."""
        functions = {}
        for owner, body in self.bodies:
            value = self.values.get(owner) if owner in self.values else body
            if owner is not None and self.m.decls[owner].fixed and not self.m.decls[owner].runs and len(self.m.decls[owner].names) == 1 and value and self.is_function(value):
                functions[self.m.decls[owner].names[0]] = owner, value
        while new := {n: o for n, (o, v) in functions.items() if n not in self.quiet and self.named.get(n) == o and self.quiet_function(v)}:
            self.quiet |= new
        if not self.quiet:
            return
        said = {o: {self.named[t.text] for t in body if t.kind == "name" and t.text in self.named} for o, body in self.bodies if o is not None}

        def ready(d: int) -> bool:
            seen, queue = set(), [d]
            while queue:
                for r in said.get(queue.pop(), set()) - seen - {d}:
                    seen.add(r)
                    if not self.hoisted[r] and r > d:
                        return False
                    if r in self.quiet.values():
                        queue.append(r)
            return True

        for d, value in self.values.items():
            if self.m.decls[d].runs and self.surely_quiet(value, set()) and ready(d):
                self.m.decls[d].runs = False

    def surely_quiet(self, v: list[Token], local: set[str]) -> bool:
        """Whether evaluating runs nothing and cannot fail either: no property is read, which may
        run an accessor or fail, and no name that this module does not know."""
        if self.expression_runs(v):
            return False
        if v and self.is_function(v):
            return True
        skip, i = self.function_parts(v), 0
        while i < len(v):
            if i in skip:
                i = skip[i]
                continue
            t, last, nxt = v[i], v[i - 1] if i else None, v[i + 1].text if i + 1 < len(v) else ""
            if t.text in (".", "?.") or t.text == "[" and last is not None and (last.kind == "name" or last.text in (")", "]", "}")):
                return False
            key = nxt == ":" and last is not None and last.text in ("{", ",")
            if t.kind == "name" and not key and nxt != "=>" and t.text not in local and t.text not in self.named and t.text not in self.bindings and t.text not in PLAIN_WORDS:
                return False
            i += 1
        return True

    def quiet_function(self, v: list[Token]) -> bool:
        """Whether calling it surely runs nothing: plain parameters, and a body of constants and
        results whose expressions run nothing."""
        i = 0
        if v[0].text == "function":
            i = 2 if v[1].kind == "name" else 1
        if v[i].text == "(":
            close = next(k for k in range(i + 1, len(v)) if v[k].text == ")" and v[k].depth == v[i].depth)
            params, rest = v[i + 1 : close], v[close + 1 :]
        elif v[i].kind == "name" and v[i].text != "async":
            params, rest = [v[i]], v[i + 1 :]
        else:
            return False
        if any(t.kind == "sign" and t.text not in (",", "?", ":", "|", "[", "]", ".") for t in params) or any(t.text in ("[", "...") and (k == 0 or params[k - 1].text == ",") for k, t in enumerate(params)):
            return False
        if any(t.text in ("this", "super", "arguments", "async", "await", "yield", "throw", "delete") for t in v):
            return False
        local = {t.text for k, t in enumerate(params) if t.kind == "name" and (k == 0 or params[k - 1].text == ",")}
        if v[0].text != "function":
            if not rest or rest[0].text != "=>":
                return False
            rest = rest[1:]
            if rest and rest[0].text != "{":
                return not local & (self.quiet.keys() | self.bindings.keys()) and self.surely_quiet(rest, local)
        if not rest or rest[0].text != "{" or rest[-1].text != "}":
            return False
        base = rest[0].depth + 1
        for s in statements([Token(t.kind, t.text, t.start, t.end, t.line_before, t.depth - base) for t in rest[1:-1]]):
            s = s[:-1] if s[-1].text == ";" else s
            if s[0].text == "const" and len(s) > 3 and s[1].kind == "name" and s[2].text == "=" and not any(t.text == "," and t.depth == 0 for t in s):
                local.add(s[1].text)
                value = s[3:]
            elif s[0].text == "return":
                value = s[1:]
            else:
                return False
            if not self.surely_quiet(value, local):
                return False
        # a parameter or constant of the name of what is trusted is something else
        return not local & (self.quiet.keys() | self.bindings.keys())

    @staticmethod
    def is_function(v: list[Token]) -> bool:
        i = 1 if v[0].text == "async" and len(v) > 1 else 0
        if v[i].text == "function":
            return v[-1].text == "}" and sum(t.text == "}" and t.depth == v[0].depth for t in v) == 1
        base = v[0].depth
        arrow = next((k for k, t in enumerate(v) if t.text == "=>" and t.depth == base), None)
        if arrow is None:
            return False
        return v[i].text == "(" or v[i].kind == "name" and arrow == i + 1 or v[i].text == "<"

    def class_runs(self, s: list[Token]) -> bool:
        """A class runs something on load by static parts, computed names or what it extends."""
        words = [t.text for t in s]
        body = words.index("{") if "{" in words else len(words)
        return "static" in words[body:] or "(" in words[:body] or any(t.text == "[" and t.depth == s[0].depth + 1 for t in s)

    def expression_runs(self, v: list[Token]) -> bool:
        """Whether evaluating may do anything: calls, new, await, tags, assignments, JSX."""
        if not v:
            return False
        if self.is_function(v):
            return False
        i = 0
        skip = self.function_parts(v)
        while i < len(v):
            if i in skip:
                i = skip[i]
                continue
            t, nxt, last = v[i], v[i + 1] if i + 1 < len(v) else None, v[i - 1] if i else None
            if t.text in ("new", "await", "yield", "delete", "class", "import") or t.kind == "sign" and t.text in ASSIGN or t.kind == "template" and (last is not None and last.kind == "name" or "${" in t.text):
                return True
            if t.text == "(" and last is not None and (last.kind == "name" and last.text not in ("return", "typeof", "in", "of") or last.text in (")", "]", "}", ">", "?.")) and not self.pure_call(v, i):
                return True
            if t.text == "<" and nxt is not None and (nxt.kind == "name" or nxt.text == ">") and (last is None or last.text in ("(", "=", ",", "?", ":", "&&", "||", "[", "{", "return", "=>")):
                return True
            if t.text == "...":
                return True
            i += 1
        return False

    def pure_call(self, v: list[Token], paren: int) -> bool:
        before = self.text[max(0, v[0].start - 40) : v[0].start]
        if re.search(r"/\*\s*[#@]__PURE__\s*\*/\s*$", before) and v[0].kind == "name":
            return True
        name = v[paren - 1].text
        if paren >= 3 and v[paren - 2].text == ".":
            holder = self.bindings.get(v[paren - 3].text)
            if holder is None or paren >= 4 and v[paren - 4].text == ".":
                return False
            at = holder[1] or "*"
            return (self.m.sources[holder[0]], f"{at}.{name}") in self.pure or at in ("*", "default") and (self.m.sources[holder[0]], name) in self.pure
        if name in self.quiet and (paren < 2 or v[paren - 2].text not in (".", "?.", "new")):
            return True
        holder = self.bindings.get(name)
        return holder is not None and holder[1] is not None and (paren < 2 or v[paren - 2].text not in (".", "?.")) and (self.m.sources[holder[0]], holder[1]) in self.pure

    @staticmethod
    def function_parts(v: list[Token]) -> dict[int, int]:
        """Where function bodies inside an expression start, and where they end."""
        out = {}
        for i, t in enumerate(v):
            if t.text == "=>":
                j = i + 1
                if j < len(v) and v[j].text == "{":
                    end = next((k for k in range(j + 1, len(v)) if v[k].text == "}" and v[k].depth == v[j].depth), len(v) - 1)
                    out[j] = end + 1
                else:
                    end = next((k for k in range(j, len(v)) if v[k].depth < t.depth or v[k].depth == t.depth and v[k].text in (",", ";", ")", "]", "}")), len(v))
                    out[j] = end
            elif t.text == "function" or t.kind == "name" and i + 1 < len(v) and v[i + 1].text == "(" and i and v[i - 1].text in ("{", ",", "get", "set", "async", "*") and t.text not in ("if", "for", "while", "switch", "return"):
                paren = next((k for k in range(i + 1, len(v)) if v[k].text == "("), None)
                close = next((k for k in range(paren + 1, len(v)) if v[k].text == ")" and v[k].depth == v[paren].depth), None) if paren is not None else None
                brace = close + 1 if close is not None else None
                while brace is not None and brace < len(v) and t.text != "function" and v[brace].text == ":":
                    brace = next((k for k in range(brace, len(v)) if v[k].text == "{" and v[k].depth == t.depth), None)
                if t.text == "function":
                    brace = next((k for k in range((close or i), len(v)) if v[k].text == "{" and v[k].depth == t.depth), None)
                if brace is not None and brace < len(v) and v[brace].text == "{":
                    end = next((k for k in range(brace + 1, len(v)) if v[k].text == "}" and v[k].depth == v[brace].depth), len(v) - 1)
                    out[i if t.text == "function" else i] = end + 1
        return out

    # --- uses

    def uses(self, owner: int | None, body: list[Token]) -> None:
        refs, imports, writes, parts = self.read_uses(owner, body)
        if owner is None:
            self.m.init_decls |= refs.keys() | writes.keys()
            self.m.init_imports += [u for u in imports if u not in self.m.init_imports]
            self.init_writes = getattr(self, "init_writes", set()) | writes.keys()
            return
        own = self.m.decls[owner]
        own.refs = [r for r in refs if r != owner]
        own.imports = imports
        own.writes = [x for x in writes if x != owner]
        own.member_refs = [p for p in parts if p[0] != owner]
        if own.runs:
            self.m.init_decls.add(owner)
        for m in self.objects.get(owner, ()):
            # a shorthand's name is a use; the parts of the object itself are told one by one
            refs, m.imports, _, parts = self.read_uses(None, m.tokens)
            m.refs, m.member_refs = [r for r in refs if r != owner], list(parts)

    def read_uses(self, owner: int | None, body: list[Token]) -> tuple[dict[int, None], list[Use], dict[int, None], dict[tuple[int, str], None]]:
        """(declarations, imports, declarations that may be written to, (object, member) read) of a body."""
        refs: dict[int, None] = {}
        imports: dict[tuple[int, str | None, str | None], None] = {}
        writes: dict[int, None] = {}
        parts: dict[tuple[int, str], None] = {}
        own = self.m.decls[owner] if owner is not None else None
        for i, t in enumerate(body):
            if t.kind == "template" or t.kind == "string" and "{" in t.text:
                inner = t.text if t.kind == "string" else "".join(re.findall(r"\$\{(.*?)\}(?=[^}]|$)", t.text, re.S)) or (t.text if "${" in t.text else "")
                for n in re.findall(r"(?<![.\w$])[A-Za-z_$][\w$]*", inner):
                    self.use(n, None, None, refs, imports)
                    if n in self.named:
                        self.used_whole.add(self.named[n])
                        if not self.m.decls[self.named[n]].fixed:
                            writes[self.named[n]] = None
                continue
            if t.kind != "name":
                continue
            last, nxt = body[i - 1].text if i else "", body[i + 1].text if i + 1 < len(body) else ""
            if t.text == "import" and nxt == "(" or t.text == "require" and nxt == "(":
                if i + 2 < len(body) and body[i + 2].kind == "string":
                    imports[(self.source(_text(body[i + 2])), self.asked_of_call(body, i), None)] = None
                    continue
                raise Opaque("computed import")
            if t.text == "URL" and last == "new" and i + 2 < len(body) and body[i + 2].kind == "string" and _text(body[i + 2]).startswith("."):
                imports[(self.source(_text(body[i + 2])), None, None)] = None
            if last in (".", "?.") and not (i > 1 and body[i - 2].text == "."):
                continue
            if nxt == ":" and last in ("{", ",") and t.depth > body[0].depth:
                continue  # a key
            if own is not None and t.text in own.names and i == 0 and not own.names[0].startswith("exports."):
                continue
            member = body[i + 2].text if nxt in (".", "?.") and i + 2 < len(body) and body[i + 2].kind == "name" else None
            part = member if last not in ("delete", "++", "--", "<", "</", "...") and not (i + 3 < len(body) and body[i + 3].text in ASSIGN) else None
            self.use(t.text, member, part, refs, imports)
            d = self.named.get(t.text)
            if d is None:
                continue
            written = not self.m.decls[d].fixed and (self.assigned(body, i) if self.m.decls[d].plain else self.writes(body, i))
            if written:
                writes[d] = None
            reads = d in self.objects and part is not None and any(m.name == part for m in self.objects[d])
            # calling a member is no write of an object whose members are told apart
            called = reads and i + 3 < len(body) and body[i + 3].text == "("
            if not reads or written and not called:
                self.used_whole.add(d)
            else:
                parts[(d, part)] = None
                if called:
                    writes.pop(d, None)
        return refs, [Use(*k) for k in imports], writes, parts

    @staticmethod
    def asked_of_call(body: list[Token], i: int) -> str | None:
        """The one name that is read of what ``require`` or an awaited ``import`` gives: the member
        that follows, if it is not written to or called with the module as its object."""
        close = i + 3
        if close >= len(body) or body[close].text != ")":
            return None
        if body[i].text == "import":
            if i < 2 or body[i - 1].text != "await" or body[i - 2].text != "(" or close + 1 >= len(body) or body[close + 1].text != ")":
                return None
            close += 1
        if close + 2 < len(body) and body[close + 1].text == "." and body[close + 2].kind == "name":
            after = body[close + 3].text if close + 3 < len(body) else ""
            return None if after in ASSIGN or after == "(" else body[close + 2].text
        return None

    def use(self, name: str, member: str | None, part: str | None, refs: dict, imports: dict) -> None:
        if name in self.named:
            refs[self.named[name]] = None
        elif name in self.bindings:
            source, export = self.bindings[name]
            imports[(source, member, None) if export is None else (source, export, part)] = None

    @staticmethod
    def assigned(body: list[Token], i: int) -> bool:
        return body[i - 1].text in ("++", "--") and i > 0 or i + 1 < len(body) and body[i + 1].text in ASSIGN or any(t.text in ("[", "{") and t.depth < body[i].depth for t in body[:i]) and body[i - 1].text in ("[", "{", ",", ":") and any(t.text == "=" and u.text in ("]", "}") for u, t in zip(body[i:], body[i + 1 :], strict=False))

    @staticmethod
    def writes(body: list[Token], i: int) -> bool:
        """Whether this use may change the value: assigned, called on, indexed, or handed on."""
        j = i + 1
        nxt = body[j].text if j < len(body) else ""
        last = body[i - 1].text if i else ""
        if last in ("++", "--", "delete", "...") or nxt in ASSIGN and nxt != "=" or nxt == "=" and not (j + 1 < len(body) and body[j + 1].text == "=="):
            return True
        if nxt == "(" or last in ("<", "</") and nxt != ".":
            return False  # calling it, rendering it
        if last == "<":
            return True  # a part of it is rendered, which may set it for what is inside
        if nxt in (".", "?."):
            k = j
            while k + 1 < len(body) and body[k].text in (".", "?.") and body[k + 1].kind == "name":
                k += 2
            after = body[k].text if k < len(body) else ""
            handed_on = body[k - 1].text != "length" and after in (")", ",", "}", ";", "", "]") and (last in ("(", ",", "=", "[", "return", "...", ":") or last == "{" and i > 1 and body[i - 2].text == "=")
            return after in ASSIGN or after in ("(", "[") or after == "?." or handed_on
        if nxt == "[":
            return True
        return last not in ("typeof",) and nxt not in ("===", "!==", "==", "!=", "<", ">", "+", "-", "*", "/", "%", "?", "&&", "||", "}") or last in ("=", "(", ",", "return", ":", "=>")

    def settle(self) -> None:
        m = self.m
        for i, d in enumerate(m.decls):
            # reading what is declared below, as it loads, may throw
            if not d.runs and not d.fixed and any(r > i and not self.hoisted[r] for r in d.refs):
                d.runs = True
                m.init_decls.add(i)
        for a, b, names in self.import_statements:
            users = [i for i, d in enumerate(m.decls) if any(u.source == self.bindings[n][0] and (self.bindings[n][1] is None or u.name == self.bindings[n][1]) for n in names for u in d.imports)]
            if users:
                m.import_spans.append((a, b, users))
        # who reads a value also depends on who writes it
        readers: dict[int, list[int]] = {}
        for i, d in enumerate(m.decls):
            for r in d.refs:
                readers.setdefault(r, []).append(i)
        self.writers = {o: [w for w, d in enumerate(m.decls) if o in d.writes] for o in range(len(m.decls))}
        for o, ws in self.writers.items():
            for u in readers.get(o, []):
                for w in ws:
                    if w != u and w not in m.decls[u].refs and w not in m.decls[u].written_by:
                        m.decls[u].written_by.append(w)
        for members in self.objects.values():
            for x in members:
                x.written_by = [w for r in x.refs for w in self.writers[r] if w not in x.refs]
        # values that read an import as they load, themselves or through what they use
        reading = {i for i, d in enumerate(m.decls) if d.imports}
        while more := {i for i, d in enumerate(m.decls) if i not in reading and reading & set(d.refs)}:
            reading |= more
        m.reads_on_load = sorted(i for i in reading if not self.late[i])
        grown = set(m.init_decls)
        while grown:
            new = {r for d in grown for r in m.decls[d].needs} - m.init_decls
            m.init_decls |= new
            grown = new
        self.settle_objects()

    def settle_objects(self) -> None:
        """Objects of which only members are read keep their members; whoever reads one of them
        needs that member instead of the object."""
        m = self.m
        apart = {d for d in self.objects if d not in self.used_whole and not m.decls[d].runs and not self.writers[d]}
        bodies = {owner: body for owner, body in self.bodies if owner is not None}
        for d in apart:
            m.decls[d].members = self.objects[d]
            for x in self.objects[d]:
                # a function of this module that nothing can replace, which never says ``this``
                named = self.named.get(x.tokens[0].text) if len(x.tokens) == 1 else None
                if x.receiver and named is not None and m.decls[named].fixed and not m.decls[named].runs:
                    x.receiver = self.says_this(bodies[named])
        for user in [*m.decls, *(x for d in apart for x in self.objects[d])]:
            user.member_refs = [p for p in user.member_refs if p[0] in apart]
            told = {o for o, _ in user.member_refs}
            user.refs = [r for r in user.refs if r not in told]


def read_pieces(text: str, include_types: bool = False, pure: frozenset[tuple[str, str]] = PURE) -> tuple[_Reader, str] | None:
    """The reader after reading, with the text it read; None if the module must stay one unit."""
    shown = text if include_types else erased(text)
    try:
        reader = _Reader(shown, pure)
        reader.read()
        return reader, shown
    except (Opaque, IndexError, ValueError, KeyError, StopIteration, RecursionError):
        return None


def read_module(text: str, include_types: bool = False, pure: frozenset[tuple[str, str]] = PURE) -> tuple[Module, dict[int, list[int]]] | None:
    """The module and, by declaration, who may write to it; None if it must stay one unit.

    ``pure``: (source, name) of calls that only make a value.
    """
    read = read_pieces(text, include_types, pure)
    return (read[0].m, read[0].writers) if read else None
