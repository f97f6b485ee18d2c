"""Paths: normal form, directories, target files and modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ravelin.functions.names import snake


def normal(path: Column) -> Column:
    """Without empty and `.` parts, `..` applied; the root is the empty string."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.lit([]).cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.when(path.rlike(r"(^|/)\.{0,2}(/|$)"), F.array_join(kept, "/")).otherwise(path)  # few are not yet


def normal_root(path: Column) -> Column:
    """normal(), with `.` for the root."""
    n = normal(path)
    return F.when(n == "", ".").otherwise(n)


def directory(path: Column) -> Column:
    return F.regexp_replace(F.when(F.instr(path, "/") > 0, path).otherwise(F.lit("")), r"/[^/]*$", "")


def join(base: Column, path: Column) -> Column:
    return normal(F.concat_ws("/", base, path))


def extension(path: Column) -> Column:
    return F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"\.([^.]*)$", 1)


def line_count(text: Column) -> Column:
    """Lines of a text; a line feed at the end starts no further line."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, "\n", -1)) - F.when(text.endswith("\n"), 1).otherwise(0))


def clip(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def snippet(text: Column, line: Column) -> Column:
    """A line of a text (from 1), trimmed and cut at 110 characters."""
    return clip(F.trim(F.get(F.split(text, "\n", -1), line - 1)), 110)


def blob_id(content: Column) -> Column:
    """The id under which version control stores a file's content."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8"), F.unhex(F.lit("00")), F.encode(content, "UTF-8")))


def target_file(rel: Column, package_dir: Column, short_name: Column, primary: Column, route: Column | None = None) -> Column:
    """Where a source file's counterpart goes: `src/` and the extension go, every part is snake case, an index file
    becomes its directory's mod.rs (lib.rs at the top); packages other than the primary one get a directory."""
    inner = F.when(F.length(package_dir) > 0, F.substr(rel, F.length(package_dir) + 2)).otherwise(rel)
    inner = F.regexp_replace(F.regexp_replace(inner, r"^src/", ""), r"\.[^./]*$", "")
    parts = F.transform(F.split(inner, "/"), snake)
    parts = F.when(primary, parts).otherwise(F.concat(F.array(snake(short_name)), parts))
    last, head = F.element_at(parts, -1), F.slice(parts, 1, F.size(parts) - 1)
    head_path = F.array_join(head, "/")
    at_index = F.when(F.size(head) == 0, F.lit("lib.rs")).otherwise(F.concat(head_path, F.lit("/mod.rs")))
    found = F.when(last == "index", at_index).otherwise(F.concat(F.array_join(parts, "/"), F.lit(".rs")))
    return F.coalesce(route, found) if route is not None else found


def module_of(target: Column) -> Column:
    """`a::b` of a/b.rs or a/b/mod.rs; the empty string at the top."""
    s = F.regexp_replace(F.regexp_replace(target, r"(^|/)(mod|lib)\.rs$", ""), r"\.rs$", "")
    return F.replace(s, F.lit("/"), F.lit("::"))


def glob_regex(pattern: str) -> str:
    """A regular expression over whole paths: ** crosses directories, * and ? don't, {a,b} and [..] as usual."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "[":
            end = pattern.find("]", i + 1)
            if end < 0:
                raise ValueError(f"glob {pattern!r}: unclosed [")
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]", end
        else:
            out += "\\" + c if c in r".^$+()|\\" else c
        i += 1
    if depth:
        raise ValueError(f"glob {pattern!r}: unclosed {{")
    return f"^{out}$"
