"""Facts from TypeScript and JavaScript text: imports, exports, rule hits.

A tokenizer, not a parser: comments, strings, templates and regular expressions are told apart, brackets are matched,
and statements are read from the tokens. Whether `import("x")` stands in a type is judged by the tokens around it.
Rules are token patterns (see RuleMatcher); a rule that needs a syntax tree beyond `contains` can't be expressed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEXEME = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<str>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)"""
    r"""|(?P<num>\d[\w.]*|\.\d[\w]*)|(?P<id>[#@]?[A-Za-z_$\u0080-\uffff][\w$\u0080-\uffff]*)|(?P<punct>=>|\?\.(?!\d)|\?\?=?|\.\.\.|&&=?|\|\|=?|[=!]==?|\*\*=?|\+\+|--|.)""",
    re.S,
)
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
BEFORE_REGEX = {"(", ",", "=", ":", "[", "!", "&", "|", "?", "{", "}", ";", "=>", "&&", "||", "??", "===", "!==", "==", "!=", "+", "-", "*", "%", "<", ">", "return", "typeof", "case", "in", "of", "do", "else", "void", "delete", "throw", "await", "yield", ""}


class Token(NamedTuple):
    kind: str  # id, str, num, punct, regex, tmpl
    text: str
    line: int


def tokens(source: str) -> list[Token]:
    """Without space and comments. A template's text is one token; the code in it follows, in the template's place."""
    out: list[Token] = []
    _lex(source, 0, 1, out, False)
    return out


def _lex(s: str, at: int, line: int, out: list[Token], inner: bool) -> tuple[int, int]:
    depth = 0
    while at < len(s):
        c = s[at]
        if c == "`":
            at, line = _template(s, at, line, out)
            continue
        if c == "/" and (not out or out[-1].text in BEFORE_REGEX) and (m := REGEX.match(s, at)):
            out.append(Token("regex", m[0], line))
            at = m.end()
            continue
        m = LEXEME.match(s, at)
        kind, text = m.lastgroup, m[0]
        if kind == "punct" and inner:
            if text == "{":
                depth += 1
            elif text == "}":
                if not depth:
                    return m.end(), line
                depth -= 1
        if kind not in ("space", "comment"):
            out.append(Token(kind, text, line))
        line += text.count("\n")
        at = m.end()
    return at, line


def _template(s: str, at: int, line: int, out: list[Token]) -> tuple[int, int]:
    place, start = len(out), line
    out.append(Token("tmpl", "", start))
    begin = at
    at += 1
    while at < len(s) and s[at] != "`":
        if s[at] == "\\":
            line += s[at + 1 : at + 2] == "\n"
            at += 2
        elif s.startswith("${", at):
            at, line = _lex(s, at + 2, line, out, True)
        else:
            line += s[at] == "\n"
            at += 1
    out[place] = Token("tmpl", s[begin : at + 1], start)
    return at + 1, line


def closing(t: list[Token], i: int) -> int:
    """Index of the token that closes the bracket at i; the last one if none does."""
    pairs = {"(": ")", "[": "]", "{": "}"}
    depth = 0
    for j in range(i, len(t)):
        if t[j].kind == "punct":
            if t[j].text in pairs:
                depth += 1
            elif t[j].text in pairs.values():
                depth -= 1
                if not depth:
                    return j
    return len(t) - 1


def _unquote(text: str) -> str:
    return text.strip("\"'`")


def _specifiers(t: list[Token], i: int, j: int) -> list[tuple[str, str, bool]]:
    """(name, alias, typed) of the list between the braces at i and j."""
    out, own = [], []
    for k in range(i + 1, j + 1):
        if t[k].text == "," or k == j:
            if own:
                typed = len(own) > 1 and own[0] == "type" and own[1] != "as" or own[:2] == ["type", "as"] and len(own) == 4
                rest = own[1:] if typed else own
                out.append((_unquote(rest[0]), _unquote(rest[2]) if len(rest) > 2 else _unquote(rest[0]), typed))
            own = []
        else:
            own.append(t[k].text)
    return out


TYPE_BEFORE = {"typeof", "as", "satisfies", "|", "&", "<", "keyof", "extends", "infer", "is"}


def _in_type(t: list[Token], i: int) -> bool:
    """Whether the `import(` at i is part of a type."""
    before = t[i - 1].text if i else ""
    if before in TYPE_BEFORE:
        return True
    end = closing(t, i + 1)
    name = t[end + 1].text == "." and t[end + 2].text[:1].isupper() if end + 2 < len(t) else False
    if before == ":":
        return name
    if before in ("=", ",", "("):
        k = i - 1
        while k >= 0 and t[k].text not in (";", "{", "}"):
            if t[k].text == "type" and k + 1 < len(t) and t[k + 1].kind == "id" and before == "=":
                return True
            k -= 1
        return before == "," and name and any(x.text == "<" for x in t[max(0, i - 6) : i])
    return False


@dataclass
class Facts:
    imports: list[tuple[str, str, int, list[str]]]  # specifier, kind, line, names
    exports: list[tuple[str, str, int, bool]]  # name, kind, line, is_async
    hits: list[tuple[str, int, str]]  # rule, line, snippet
    lines: int


DECLARED = {"function": "function", "class": "class", "interface": "interface", "type": "type", "enum": "enum", "namespace": "namespace", "module": "namespace", "const": "const", "let": "const", "var": "const"}


def _statement(t: list[Token], i: int, imports: list, exports: list) -> None:
    """The import or export statement that begins at i."""
    word, line = t[i].text, t[i].line
    j, typed_word, other, named = i + 1, False, False, None
    if j < len(t) and t[j].text == "type" and j + 1 < len(t) and t[j + 1].text not in ("from", ",", "="):
        typed_word, j = True, j + 1
    start = j
    if word == "export" and typed_word and t[j].kind == "id":
        exports.append((t[j].text, "type", line, False))
        return
    while j < len(t):
        x = t[j]
        if x.text == "{":
            end = closing(t, j)
            named = _specifiers(t, j, end)
            j = end + 1
        elif x.text == "*":
            other, j = True, j + 1
            if j + 1 < len(t) and t[j].text == "as":
                j += 2
        elif x.kind == "id" and x.text == "from":
            j += 1
            break
        elif word == "import" and (x.kind == "id" or x.text == ","):
            other, j = other or x.kind == "id", j + 1
        elif x.kind == "str" and word == "import" and j == start:
            break
        else:
            j = -1
            break
    if 0 < j < len(t) and t[j].kind == "str":
        typed = typed_word or bool(named) and all(x[2] for x in named) and not other
        imports.append((_unquote(t[j].text), "type" if typed else "value" if word == "import" else "reexport", line, [x[0] for x in named or []]))
    elif word == "export":
        if start < len(t) and t[start].text == "{":
            exports.extend((alias, "reexport", line, False) for _, alias, _ in named or [])
        else:
            _export(t, i + 1, line, exports)


def _export(t: list[Token], j: int, line: int, exports: list) -> None:
    if j < len(t) and t[j].text == "default":
        exports.append(("default", "default", line, False))
        return
    is_async = False
    while j < len(t) and t[j].text in ("declare", "abstract", "async") or j + 1 < len(t) and t[j].text == "const" and t[j + 1].text == "enum":
        is_async |= t[j].text == "async"
        j += 1
    kind = DECLARED.get(t[j].text) if j < len(t) else None
    if kind is None:
        return
    j += 1
    if kind == "function" and j < len(t) and t[j].text == "*":
        j += 1
    if kind != "const":
        if j < len(t):
            exports.append((_unquote(t[j].text), kind, line, is_async))
        return
    while j < len(t):  # declarators
        name = t[j]
        if name.text in ("{", "["):
            j = closing(t, j)
        depth, value = 0, None
        j += 1
        while j < len(t):
            x = t[j].text
            if not depth and (x == ";" or x == ","):
                break
            if not depth and value is None and x == "=":
                value = j + 1
            if not depth and value is not None and j > value and t[j].line > t[j - 1].line and t[j].kind == "id" and t[j].text in (*DECLARED, "export", "import", "async") and t[j - 1].text not in ("=>", "=", "async"):
                break
            depth += (x in "([{" if len(x) == 1 else 0) - (x in ")]}" if len(x) == 1 else 0)
            if depth < 0:
                break
            j += 1
        fn, own_async = _function_value(t, value)
        if name.kind == "id":
            exports.append((name.text, "function" if fn else "const", line, fn and own_async))
        if j >= len(t) or t[j].text != ",":
            return
        j += 1


def _function_value(t: list[Token], v: int | None) -> tuple[bool, bool]:
    if v is None or v >= len(t):
        return False, False
    own_async = t[v].text == "async"
    v += own_async
    if v >= len(t):
        return False, False
    if t[v].text == "function":
        return True, own_async
    if t[v].text == "<":  # type parameters
        while v < len(t) and t[v].text != "(":
            v += 1
    if v < len(t) and t[v].kind == "id" and v + 1 < len(t) and t[v + 1].text == "=>":
        return True, own_async
    if v < len(t) and t[v].text == "(":
        end = closing(t, v) + 1
        if end < len(t) and t[end].text == ":":  # a return type
            k = end + 1
            while k < len(t) and t[k].text not in ("=>", ";", "="):
                k = closing(t, k) + 1 if t[k].text in ("(", "[", "{") else k + 1
            return k < len(t) and t[k].text == "=>", own_async
        return end < len(t) and t[end].text == "=>", own_async
    return False, False


class RuleMatcher:
    """Rules of (id, query, tsx_only, contains). A query is a list of token patterns, separated by blanks; `a|b` is a
    choice, `*` any token, `@id @str @num @tmpl @regex` a token of that kind, `/re/` an identifier that the expression
    matches. `contains` names a keyword that must occur in the block that follows the match, outside nested functions;
    the hit is then reported there."""

    def __init__(self, rules: list[tuple[str, str, bool, str | None]]):
        self.rules = []
        for rule, query, tsx_only, contains in rules:
            parts = [self._part(p) for p in query.split()]
            if not parts:
                raise ValueError(f"rule {rule}: empty query")
            self.rules.append((rule, parts, tsx_only, contains))

    @staticmethod
    def _part(p: str):
        if p == "*":
            return lambda x: True
        if p[0] == "@" and len(p) > 1:
            return lambda x: x.kind == p[1:]
        if len(p) > 2 and p[0] == p[-1] == "/":
            found = re.compile(p[1:-1])
            return lambda x: x.kind == "id" and bool(found.search(x.text))
        choice = set(p.split("|")) if p.strip("|") else {p}
        return lambda x: x.text in choice and x.kind in ("id", "punct", "num")

    def hits(self, t: list[Token], lines: list[str], tsx: bool) -> list[tuple[str, int, str]]:
        out = {}
        for rule, parts, tsx_only, contains in self.rules:
            if tsx_only and not tsx:
                continue
            n = len(parts)
            for i in range(len(t) - n + 1):
                if all(p(x) for p, x in zip(parts, t[i : i + n], strict=True)):
                    line = t[i].line if contains is None else self._inside(t, i + n - 1, contains)
                    if line is not None:
                        out.setdefault((rule, line), None)
        found = sorted(out, key=lambda x: x[1])
        return [(rule, line, _snippet(lines[line - 1])) for rule, line in found]

    @staticmethod
    def _inside(t: list[Token], i: int, word: str) -> int | None:
        k = i
        while k < len(t) and t[k].text != "{":
            k = closing(t, k) + 1 if t[k].text == "(" else k + 1
        if k >= len(t):
            return None
        end, j = closing(t, k), k + 1
        while j < end:
            if t[j].text == word:
                return t[j].line
            if t[j].text == "=>" or t[j].text == "function":
                while j < end and t[j].text != "{" and t[j].text not in (";", ","):
                    j = closing(t, j) + 1 if t[j].text == "(" else j + 1
                j = closing(t, j) if j < end and t[j].text == "{" else j
            j += 1
        return None


def _snippet(line: str) -> str:
    line = line.strip()
    return line[:110] + "…" if len(line) > 110 else line


def analyse(rel: str, content: str, matcher: RuleMatcher | None = None) -> Facts:
    t = tokens(content)
    imports, exports = [], []
    for i, x in enumerate(t):
        before = t[i - 1].text if i else ""
        after = t[i + 1] if i + 1 < len(t) else Token("punct", "", 0)
        if x.kind != "id" or before in (".", "?."):
            continue
        if x.text in ("import", "require") and after.text == "(":
            if i + 2 < len(t) and t[i + 2].kind == "str":
                kind = "require" if x.text == "require" else "type" if _in_type(t, i) else "dynamic"
                imports.append((_unquote(t[i + 2].text), kind, x.line, []))
        elif x.text in ("import", "export") and after.text not in (".", ":", "=", ",", ")", "?"):
            _statement(t, i, imports, exports)
    lines = content.split("\n")
    hits = matcher.hits(t, lines, rel.endswith((".tsx", ".jsx"))) if matcher else []
    return Facts(imports, exports, hits, len(lines) - (content.endswith("\n") or content == ""))


FACTS = (
    "rel string, lines long, imports array<struct<ord: int, specifier: string, kind: string, line: long, names: array<string>>>, "
    "exports array<struct<name: string, kind: string, line: long, is_async: boolean>>, hits array<struct<rule: string, line: long, snippet: string>>"
)


def extract(files: DataFrame, rules: list[tuple[str, str, bool, str | None]] | None = None) -> DataFrame:
    """A row of facts for each file (rel, content). Rules are checked here, on the driver; a bad one raises."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    matcher, schema = RuleMatcher(rules or []), to_arrow_schema(_parse_datatype_string(FACTS))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for rel, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = analyse(rel, content or "", matcher)
                rows.append({
                    "rel": rel,
                    "lines": f.lines,
                    "imports": [{"ord": i, "specifier": s, "kind": k, "line": n, "names": x} for i, (s, k, n, x) in enumerate(f.imports)],
                    "exports": [{"name": n, "kind": k, "line": x, "is_async": a} for n, k, x, a in f.exports],
                    "hits": [{"rule": r, "line": n, "snippet": s} for r, n, s in f.hits],
                })
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("rel", "content").mapInArrow(run, FACTS)


def imports_of(facts: DataFrame) -> DataFrame:
    return facts.select("rel", F.inline("imports"))


def exports_of(facts: DataFrame) -> DataFrame:
    return facts.select("rel", F.inline("exports"))


def hits_of(facts: DataFrame) -> DataFrame:
    return facts.select("rel", F.inline("hits")).dropDuplicates(["rel", "rule", "line"])
