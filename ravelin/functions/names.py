"""Names: snake case, export names, module specifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names that the target language reserves.
KEYWORDS = (
    "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut "
    "pub ref return self static struct super trait true type unsafe use where while yield"
).split()


def snake(name: Column) -> Column:
    """Snake case; separators become underscores, keywords get one at the end."""
    s = F.regexp_replace(name, r"[-. ]", "_")
    s = F.regexp_replace(s, r"(?<=[\p{Ll}0-9])(?=\p{Lu})", "_")
    s = F.regexp_replace(s, r"(?<=[^_])(?=\p{Lu}\p{Ll})", "_")
    s = F.lower(s)
    return F.when(s.isin(KEYWORDS), F.concat(s, F.lit("_"))).otherwise(s)


def export_name(name: Column, kind: Column) -> Column:
    """Types keep their name, constants in capitals too; anything else is snake case."""
    constant = (kind == "const") & (F.upper(name) == name)
    return F.when(kind.isin("class", "interface", "type", "enum") | constant, name).otherwise(snake(name))


def package_of(spec: Column) -> Column:
    """`@scope/name` or `name` of a bare specifier; a scope alone is returned as it is."""
    found = F.regexp_extract(spec, r"^(@[^/]+/[^/]+|[^@/][^/]*)(?:/(.*))?$", 1)
    return F.when(found == "", spec).otherwise(found)


def subpath_of(spec: Column) -> Column:
    found = F.regexp_extract(spec, r"^(@[^/]+/[^/]+|[^@/][^/]*)(?:/(.*))?$", 2)
    return F.when(found == "", F.lit(None)).otherwise(found)


def without_version(alias: Column) -> Column:
    """The name of an `npm:` alias: everything before its last @, unless that one comes first."""
    return F.regexp_replace(F.regexp_replace(alias, r"^npm:", ""), r"(?<!^)@[^@]*$", "")
