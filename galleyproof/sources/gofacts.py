"""Go source as fact rows: a lexer and a declaration parser in Python, all judgement left to relational operators.

Facts (path, kind, name, line, ord, owner, attrs): ``import``; ``func`` (attrs: open and close line, exported, doc, returns one plain
value); ``param``, ``result``, ``short``, ``var``, ``const``, ``type`` declarations; ``branch`` (decision points of a function);
``number`` (literals outside constants); ``call`` (selector calls); ``depth`` (deepest block of a function); ``else`` (first exit
statement in an else block); ``field`` (function-typed struct fields); ``local`` (a name declared in a body: attrs ``fn``, ``pos``, and
``scope`` to ``until``, the token range of the scope it stands in) and ``signature`` (receiver, parameter and result names of a body).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, kind string, name string, line int, ord int, owner string, attrs map<string,string>"
TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>`[^`]*`|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])+')|(?P<number>\d(?:[eEpP][+-]|[\w.])*|\.\d[\w.]*)|(?P<ident>[^\W\d]\w*)"""
    r"""|(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|[-+*/%&|^]=|<<|>>|&\^|[^\s\w])|(?P<line>\n)|(?P<space>[ \t\r]+)""",
    re.S,
)
EXITS = ("return", "panic", "for", "break", "continue", "goto", "fallthrough")


def lex(source: str) -> tuple[list[tuple[str, str, int]], dict[int, list[str]]]:
    """Tokens (kind, text, line) with semicolons where a line's end makes one, and comments by the line they end on."""
    out: list[tuple[str, str, int]] = []
    comments: dict[int, list[str]] = {}
    line = 1
    for m in TOKEN.finditer(source):
        kind, text = m.lastgroup, m[0]
        if kind == "comment":
            end = line + text.count("\n")
            comments.setdefault(end, []).append(text)
            line = end
            continue
        if kind == "line":
            if out and (out[-1][0] in ("ident", "number", "string") and out[-1][1] not in _OPEN_WORDS or out[-1][1] in (")", "]", "}", "++", "--")):
                out.append(("op", ";", line))
            line += 1
            continue
        if kind != "space":
            out.append((kind, text, line))
            line += text.count("\n")
    return out, comments


_OPEN_WORDS = frozenset("package import func var const type struct interface map chan if else for range switch select case default go defer".split())


class Parser:
    def __init__(self, path: str, source: str):
        self.t, self.comments = lex(source)
        self.path, self.rows = path, []

    def add(self, kind: str, name: str, line: int, owner: str = "", **attrs) -> None:
        self.rows.append((self.path, kind, name, line, len(self.rows), owner, {k: str(v) for k, v in attrs.items()}))

    def close(self, i: int) -> int:
        """Index of the bracket that closes the one at ``i``."""
        depth = 0
        for k in range(i, len(self.t)):
            x = self.t[k][1] if self.t[k][0] == "op" else ""
            depth += x in ("(", "[", "{")
            depth -= x in (")", "]", "}")
            if depth == 0:
                return k
        return len(self.t) - 1

    def doc(self, line: int) -> str:
        out: list[str] = []
        k = line - 1
        while k in self.comments:
            out = self.comments[k] + out
            k -= self.comments[k][-1].count("\n") + 1
        return "\n".join(c.removeprefix("//").removeprefix("/*").removesuffix("*/").strip() for c in out)

    def fields(self, a: int, b: int) -> list[tuple[str, str]]:
        """(name or '', type text) of a parameter list between two brackets."""
        parts, depth, at = [], 0, a + 1
        for k in range(a + 1, b + 1):
            x = self.t[k][1] if self.t[k][0] == "op" else ""
            if depth == 0 and (x == "," or k == b):
                if k > at:
                    parts.append(self.t[at:k])
                at = k + 1
            depth += x in ("(", "[", "{")
            depth -= x in (")", "]", "}")
        text = lambda p: " ".join(x[1] for x in p)
        named = any(len(p) > 1 and p[0][0] == "ident" and (p[1][0] == "ident" or p[1][1] in ("*", "[", "(", "...", "<-") and not (p[1][1] == "[" and len(p) > 3 and p[-1][1] == "]")) and p[0][1] not in ("func", "map", "chan", "struct", "interface") for p in parts)
        if not named:
            return [("", text(p)) for p in parts]
        out, kind = [], ""
        for p in reversed(parts):
            if len(p) > 1:
                kind = text(p[1:])
            out.append((p[0][1], kind))
        return out[::-1]

    def run(self) -> list[tuple]:
        i, t = 0, self.t
        while i < len(t):
            word = t[i][1] if t[i][0] == "ident" else ""
            if word == "import":
                i = self.imports(i)
            elif word == "func" and i + 1 < len(t):
                i = self.func(i)
            elif word in ("var", "const", "type"):
                i = self.spec(i, "")
            else:
                i += 1
        return self.rows

    def imports(self, i: int) -> int:
        if i + 1 < len(self.t) and self.t[i + 1][1] == "(":
            end = self.close(i + 1)
        else:
            end = next((k for k in range(i, len(self.t)) if self.t[k][1] == ";"), len(self.t) - 1)
        for kind, text, line in self.t[i : end + 1]:
            if kind == "string":
                self.add("import", text[1:-1], line)
        return end + 1

    def spec(self, i: int, owner: str) -> int:
        kind, t = self.t[i][1], self.t
        grouped = i + 1 < len(t) and t[i + 1][1] == "("
        end = self.close(i + 1) if grouped else self.statement_end(i)
        k, fresh = i + 1 + grouped, True
        while k < end:
            if fresh and t[k][0] == "ident":
                while True:
                    self.add(kind, t[k][1], t[k][2], owner, type=t[k + 1][1] if k + 1 < len(t) and t[k + 1][0] == "ident" else "")
                    if k + 2 < end and t[k + 1][1] == "," and t[k + 2][0] == "ident":
                        k += 2
                    else:
                        break
                fresh = False
            elif t[k][0] == "op" and t[k][1] in ("(", "[", "{"):
                stop = self.close(k)
                if kind == "type" and t[k][1] == "{":
                    self.members(k, stop, t[k - 1][1])
                k = stop
            elif t[k][1] == ";":
                fresh = True
            k += 1
        if kind == "var":
            self.numbers(i, end, owner)
        return end + 1

    def members(self, a: int, b: int, what: str) -> None:
        """Function-typed fields of a struct, result lists of an interface's methods."""
        t, k = self.t, a + 1
        while k < b:
            if t[k][0] == "ident" and k + 1 < b:
                if what == "struct" and [x[1] for x in t[k + 1 : k + 7]] == ["func", "(", ")", "time", ".", "Time"]:
                    self.add("field", t[k][1], t[k][2], "", type="func() time.Time")
                if what == "interface" and t[k + 1][1] == "(":
                    stop = self.close(k + 1)
                    if stop + 1 < b and t[stop + 1][1] == "(":
                        end = self.close(stop + 1)
                        for name, kind in self.fields(stop + 1, end):
                            self.add("result", name, t[k][2], t[k][1], type=kind)
            while k < b and t[k][1] != ";":
                k = self.close(k) if t[k][0] == "op" and t[k][1] in ("(", "[", "{") else k
                k += 1
            k += 1

    def statement_end(self, i: int) -> int:
        k = i
        while k < len(self.t):
            x = self.t[k][1] if self.t[k][0] == "op" else ""
            if x in ("(", "[", "{"):
                k = self.close(k)
            elif x in (";", "}", ")"):
                return k
            k += 1
        return len(self.t) - 1

    def numbers(self, a: int, b: int, owner: str) -> None:
        for k in range(a, b):
            if self.t[k][0] == "number":
                self.add("number", self.t[k][1], self.t[k][2], owner)

    def func(self, i: int) -> int:
        t, k = self.t, i + 1
        receiver = ""
        if t[k][1] == "(":
            end = self.close(k)
            receiver = t[end - 1][1]
            k = end + 1
        if k >= len(t) or t[k][0] != "ident":
            return i + 1
        name, line = t[k][1], t[i][2]
        owner = f"{receiver}.{name}" if receiver else name
        k += 1
        if k < len(t) and t[k][1] == "[":
            k = self.close(k) + 1
        if k >= len(t) or t[k][1] != "(":
            return k
        end = self.close(k)
        signature = self.fields(k, end)
        for p, kind in signature:
            self.add("param", p, line, owner, type=kind)
        k = end + 1
        if k < len(t) and t[k][1] == "(":
            end = self.close(k)
            results = self.fields(k, end)
            signature = signature + results
            for p, kind in results:
                self.add("result", p, line, owner, type=kind)
            k = end + 1
        else:
            start = k
            while k < len(t) and t[k][1] not in ("{", ";"):
                k = self.close(k) + 1 if t[k][1] in ("(", "[") else k + 2 if t[k][1] in ("struct", "interface") and k + 1 < len(t) and t[k + 1][1] == "{" else k + 1
            if k > start:
                self.add("result", "", line, owner, type=" ".join(x[1] for x in t[start:k]))
        if k >= len(t) or t[k][1] != "{":
            self.add("func", name, line, owner, open=line, close=line, doc=self.doc(line), plain=False)
            return k
        end = self.close(k)
        inner = [x for x in t[k + 1 : end] if x[1] != ";"]
        plain = bool(inner) and inner[0][1] == "return" and 2 <= len(inner) and all(x[0] in ("ident", "number", "string") or x[1] == "." for x in inner[1:]) and sum(x[1] == "return" for x in inner) == 1
        self.add("func", name, line, owner, open=t[k][2], close=t[end][2], doc=self.doc(line), plain=plain)
        for x in [*(self.fields(i + 1, self.close(i + 1)) if receiver else []), *signature]:
            if x[0] not in ("", "_"):
                self.add("signature", x[0], line, owner, fn=k)
        self.body(k, end, owner)
        self.locals(k, end, owner)
        return end + 1

    def header_end(self, k: int, b: int) -> int | None:
        """Index of the brace that opens the body behind a control keyword; a literal's brace is followed by more of the header."""
        j = k + 1
        while j < b:
            if self.t[j][0] == "op" and self.t[j][1] in ("(", "[", "{"):
                stop = self.close(j)
                if self.t[j][1] == "{" and (stop + 1 >= b or self.t[stop + 1][1] in (";", "else", "}")):
                    return j
                j = stop
            j += 1
        return None

    def clauses(self, a: int, b: int) -> dict[int, int]:
        """Start and end of the clauses between two braces."""
        starts, k = [], a + 1
        while k < b:
            if self.t[k][0] == "op" and self.t[k][1] in ("(", "[", "{"):
                k = self.close(k)
            elif self.t[k][0] == "ident" and self.t[k][1] in ("case", "default"):
                starts.append(k)
            k += 1
        return dict(zip(starts, [*starts[1:], b], strict=True))

    def locals(self, a: int, b: int, owner: str) -> None:
        """Declarations of a body with their scopes; function literals and other braces are skipped whole."""
        t, k = self.t, a + 1
        scopes = [(a, b)]
        blocks: set[int] = set()
        bodies: set[int] = set()  # of switch and select: their clauses are the scopes
        clauses: dict[int, int] = {}
        while k < b:
            while len(scopes) > 1 and scopes[-1][1] <= k:
                scopes.pop()
            kind, text, _ = t[k]
            starts = t[k - 1][1] in (";", "{", "}", ":")
            declared: list[tuple[str, int]] = []
            if k in clauses:
                scopes.append((k, clauses[k]))
            elif kind == "ident" and text in ("if", "for", "switch", "select"):
                if (j := self.header_end(k, b)) is not None:
                    stop = self.close(j)
                    (bodies if text in ("switch", "select") else blocks).add(j)
                    while stop + 2 < b and t[stop + 1][1] == "else":
                        at = stop + 2 if t[stop + 2][1] == "{" else self.header_end(stop + 2, b)
                        if at is None:
                            break
                        blocks.add(at)
                        stop = self.close(at)
                    scopes.append((k, stop))
            elif text == "{" and kind == "op":
                if k in bodies:
                    clauses |= self.clauses(k, self.close(k))
                elif k in blocks or starts:
                    scopes.append((k, self.close(k)))
                else:
                    k = self.close(k)
            elif kind == "ident" and text in ("const", "var", "type") and starts:
                before = len(self.rows)
                self.spec(k, owner)
                declared = [(r[2], r[3]) for r in self.rows[before:] if r[1] in ("const", "var", "type")]
                del self.rows[before:]
            elif text == ":=":
                j = k - 1
                while j > a and t[j][0] == "ident":
                    declared.insert(0, (t[j][1], t[j][2]))
                    if t[j - 1][1] != ",":
                        break
                    j -= 2
            for n, (name, line) in enumerate(declared):
                if name != "_":
                    self.add("local", name, line, owner, fn=a, pos=k * 1000 + n, scope=scopes[-1][0], until=scopes[-1][1] * 1000)
            k += 1

    def body(self, a: int, b: int, owner: str) -> None:
        t = self.t
        depth = deepest = 0
        literals: list[int] = []  # ends of function literals
        blocks: list[int] = []
        exempt: set[int] = set()
        k = a + 1
        while k < b:
            kind, text, line = t[k]
            literals = [e for e in literals if e >= k]
            while blocks and blocks[-1] < k:
                blocks.pop()
                depth -= 1
            if kind == "ident" and text == "func":
                brace = next((j for j in range(k, b) if t[j][1] == "{"), b)
                literals.append(self.close(brace) if brace < b else b)
            if kind == "ident" and text in ("if", "for", "case", "select", "switch") or text in ("&&", "||"):
                if text in ("if", "for", "case", "&&", "||"):
                    self.add("branch", text, line, owner)
                if text in ("if", "for", "switch", "select") and not literals:
                    j = k + 1
                    while j < b and t[j][1] != "{":
                        j = self.close(j) + 1 if t[j][1] in ("(", "[") else j + 1
                    if j < b:
                        depth += 1
                        blocks.append(self.close(j))
                        deepest = max(deepest, depth)
            elif kind == "ident" and text == "else" and k + 1 < b and t[k + 1][1] == "{":
                stop = self.close(k + 1)
                first = next(((t[j][1], t[j][2]) for j in range(k + 2, stop) if t[j][0] == "ident" and t[j][1] in EXITS and t[j - 1][1] in ("{", ";", "}")), None)
                if first:
                    self.add("else", first[0], first[1], owner)
            elif kind == "ident" and text in ("const", "var", "type") and t[k - 1][1] in (";", "{", "}"):
                if text == "const":
                    k = self.spec(k, owner)
                    continue
                before = len(self.rows)
                self.spec(k, owner)
                del self.rows[before + sum(r[1] in ("var", "type") for r in self.rows[before:]) :]
            elif text == ":=":
                j = k - 1
                names = []
                while j > a and t[j][0] == "ident":
                    names.append(t[j])
                    if t[j - 1][1] != ",":
                        break
                    j -= 2
                for x in reversed(names):
                    self.add("short", x[1], x[2], owner)
            elif kind == "number":
                self.add("number", text, line, owner, exempt=k in exempt)
            elif kind == "ident" and k + 3 < b and t[k + 1][1] == "." and t[k + 2][0] == "ident" and t[k + 3][1] == "(":
                self.add("call", f"{text}.{t[k + 2][1]}", line, owner)
                if text == "strconv" and t[k + 2][1] in ("ParseInt", "ParseUint", "ParseFloat"):
                    exempt.add(self.close(k + 3) - 1)  # the bit size, if it is a literal
            k += 1
        self.add("depth", str(deepest), t[a][2], owner)


def facts_of(path: str, source: str) -> list[tuple]:
    return Parser(path, source or "").run()


def go_facts(files: DataFrame) -> DataFrame:
    """Fact rows of the .go files of a files table; a file is a unit of work."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            rows = [r for p, c in zip(pdf["path"], pdf["content"], strict=True) for r in facts_of(p, c)]
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "line", "ord", "owner", "attrs"])

    kept = files.filter((F.lower("ext") == ".go") & F.col("content").isNotNull()).select("path", "content")
    return kept.mapInPandas(run, SCHEMA)
