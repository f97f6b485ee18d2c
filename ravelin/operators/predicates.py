"""Row predicates: sources, tests, status of ledger entries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ravelin.functions.paths import extension, glob_regex

DONE = ("ported", "verified", "replaced", "skipped")


def is_source(rel: Column, extensions: list[str]) -> Column:
    return ~rel.endswith(".d.ts") & extension(rel).isin(extensions)


def has_marker(rel: Column, markers: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (rel.contains(m) for m in markers), F.lit(False))


def is_test_case(rel: Column) -> Column:
    return rel.contains(".test.") | rel.contains(".spec.")


def excluded(rel: Column, globs: list[str]) -> Column:
    """Whether a path matches one of the patterns, as one regular expression. A bad pattern raises."""
    return rel.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)) if globs else F.lit(False)


def is_done(status: Column) -> Column:
    return F.coalesce(status != "in_progress", F.lit(False))


def has_target(status: Column) -> Column:
    return F.coalesce(status.isin("ported", "verified"), F.lit(False))


def is_tracked(status: Column, target: Column) -> Column:
    return has_target(status) | F.coalesce((status == "in_progress") & target.isNotNull(), F.lit(False))


def mentions(text: Column, query: str) -> Column:
    """The query or its snake form, ignoring case."""
    from ravelin.functions.names import snake

    low = F.lower(text)
    return low.contains(F.lower(F.lit(query))) | low.contains(snake(F.lit(query)))


def safe_name(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9_-][A-Za-z0-9._-]*$")
