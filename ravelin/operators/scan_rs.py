"""Public items and module declarations from Rust text, by tokens."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

LEXEME = re.compile(
    r"""(?P<space>\s+|//[^\n]*)|(?P<comment>/\*)|(?P<str>b?r(?P<h>#*)".*?"(?P=h)|b?"(?:\\.|[^"\\])*")|(?P<char>b?'(?:\\.[^']*|[^'\\])')|(?P<life>'\w+)"""
    r"""|(?P<id>r\#[A-Za-z_]\w*|[A-Za-z_]\w*)|(?P<num>\d[\w.]*)|(?P<punct>::|->|=>|.)""",
    re.S,
)
KINDS = {"fn": "fn", "struct": "struct", "enum": "enum", "trait": "trait", "type": "type", "const": "const", "static": "static", "mod": "mod", "union": "struct"}


def tokens(source: str) -> list[tuple[str, str, int]]:
    out, at, line = [], 0, 1
    while at < len(source):
        m = LEXEME.match(source, at)
        kind, text = m.lastgroup if m.lastgroup != "h" else "str", m[0]
        if kind == "comment":  # they nest
            depth, end = 1, m.end()
            while depth and end < len(source):
                step = source[end : end + 2]
                depth += (step == "/*") - (step == "*/")
                end += 2 if step in ("/*", "*/") else 1
            text = source[at:end]
        elif kind != "space":
            out.append((kind, text, line))
        line += text.count("\n")
        at += len(text)
    return out


def _close(t, i):
    pairs, depth = {"(": ")", "[": "]", "{": "}"}, 0
    for j in range(i, len(t)):
        depth += (t[j][1] in pairs) - (t[j][1] in pairs.values())
        if not depth:
            return j
    return len(t) - 1


def _plain(name: str) -> str:
    return name.removeprefix("r#")


def use_names(t, i, end) -> list[str]:
    """Names that the use tree between i and end brings in: aliases, else last parts; globs and self bring none."""
    out, last = [], None
    while i < end:
        text = t[i][1]
        if text == "{":
            close, start = _close(t, i), i + 1
            depth = 0
            for k in range(i + 1, close + 1):
                depth += (t[k][1] == "{") - (t[k][1] == "}" and k != close)
                if k == close or (t[k][1] == "," and not depth):
                    out += use_names(t, start, k)
                    start = k + 1
            return out
        if text == "as":
            return [_plain(t[i + 1][1])] if t[i + 1][1] != "_" else []
        if t[i][0] == "id" or text == "*":
            last = text
        i += 1
    return [_plain(last)] if last and last not in ("*", "self") else []


def items(source: str) -> list[tuple[str, str, int]]:
    """(name, kind, line) of what a file offers: top-level public items, macros, public uses, and public methods of
    inherent impls as Type::method."""
    t = tokens(source)
    out: list[tuple[str, str, int]] = []
    _collect(t, 0, len(t), None, out)
    return out


def _skip_item(t, i, end):
    while i < end and t[i][1] not in (";", "{"):
        i = _close(t, i) + 1 if t[i][1] in ("(", "[") else i + 1
    if i < end and t[i][1] == "{":
        return _close(t, i) + 1
    return i + 1


def _collect(t, i, end, owner, out):
    while i < end:
        text, line = t[i][1], t[i][2]
        if text == "#":
            i += 1 + (t[i + 1][1] == "!") if i + 1 < end else 1
            i = _close(t, i) + 1
            continue
        public = text == "pub"
        if public:
            i += 1
            if i < end and t[i][1] == "(":
                i = _close(t, i) + 1
        while i + 1 < end and (t[i][1] in ("async", "unsafe", "extern", "default") or t[i][0] == "str" or t[i][1] == "const" and t[i + 1][1] in ("fn", "async", "unsafe", "extern")):
            i += 1
        if i >= end:
            return
        word = t[i][1]
        if word == "use" and public and owner is None:
            stop = next((k for k in range(i, end) if t[k][1] == ";"), end)
            out += [(n, "use", line) for n in use_names(t, i + 1, stop)]
            i = stop + 1
        elif word == "macro_rules" and owner is None:
            out.append((_plain(t[i + 2][1]), "macro", line))
            i = _skip_item(t, i + 2, end)
        elif word == "impl" and owner is None:
            k = i + 1
            while k < end and t[k][1] != "{":
                k += 1
            head = [x[1] for x in t[i + 1 : k]]
            depth = 0
            if head and head[0] == "<":
                for n, x in enumerate(head):
                    depth += (x == "<") - (x == ">")
                    if not depth:
                        head = head[n + 1 :]
                        break
            close = _close(t, k) if k < end else end
            if "for" not in head:
                name = next((x for n, x in enumerate(head) if re.match(r"\w", x) and (n + 1 == len(head) or head[n + 1] != "::")), None)
                _collect(t, k + 1, close, name, out)
            i = close + 1
        elif word in KINDS and i + 1 < end and t[i + 1][0] == "id":
            name = t[i + 2][1] if t[i + 1][1] == "mut" else t[i + 1][1]
            if public and (owner is None or word == "fn"):
                out.append((f"{owner}::{_plain(name)}" if owner else _plain(name), "method" if owner else KINDS[word], line))
            i = _skip_item(t, i + 1, end)
        else:
            i = _skip_item(t, i, end)


def declared_modules(source: str) -> list[str]:
    t, out, i = tokens(source), [], 0
    while i < len(t):
        if t[i][1] == "mod" and i + 1 < len(t) and t[i + 1][0] == "id":
            out.append(_plain(t[i + 1][1]))
        i = _close(t, i) + 1 if t[i][1] in ("{", "(", "[") else i + 1
    return out


def extract_items(files: DataFrame) -> DataFrame:
    """path, name, kind, line of every item of files (path, content)."""
    return _each(files, items, "path string, name string, kind string, line long")


def extract_modules(files: DataFrame) -> DataFrame:
    return _each(files, lambda s: [(m,) for m in declared_modules(s)], "path string, module string")


def _each(files, parse, ddl):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(ddl))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(p, *r) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in parse(c or "")]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    return files.select("path", "content").mapInArrow(run, ddl)
