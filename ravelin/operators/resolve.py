"""Resolving import specifiers to files, packages or externals, as joins with priorities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.common import settle
from ravelin.functions.names import package_of, subpath_of, without_version
from ravelin.functions.paths import directory, join, normal

# The runtime's own modules, by their whole specifier; and the conditions of export maps, first wins.
BUILTINS = (
    "assert async_hooks buffer child_process crypto dns events fs fs/promises http https module net os path perf_hooks process "
    "readline stream stream/promises string_decoder timers timers/promises tty url util v8 vm worker_threads zlib"
).split()
CONDITIONS = ("bun", "source", "default", "import", "require", "types")
SCRIPTS = (".js", ".mjs", ".cjs", ".jsx")


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def owners(files: DataFrame, packages: DataFrame) -> DataFrame:
    """files (rel) with the package of the longest directory above them; null without one. packages (name, dir).

    The prefixes of a path are exploded and joined on equality, so neither side needs to be broadcast."""
    parts = F.split("rel", "/")
    up = files.select("rel", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("dir"))
    best = up.join(packages.select("dir", "name"), "dir").groupBy("rel").agg(F.max_by("name", F.length("dir")).alias("package"))
    return files.join(best, "rel", "left")


def source_candidates(target: Column) -> Column:
    """Array of the files that a target may stand for, in order. A compiled target (below dist/) stands for its source, and
    never for itself."""
    none = F.array().cast("array<string>")

    def of(t: Column, stem: Column) -> Column:
        typed = F.array(*[F.concat(stem, F.lit(e)) for e in (".ts", ".tsx", "/index.ts", "/index.tsx")])
        itself = F.when(~t.startswith("dist/") & (stem != t), F.array(t)).otherwise(none)
        scripts = F.array(*[F.concat(stem, F.lit(way + e)) for e in SCRIPTS for way in ("", "/index")])
        return F.when(stem.rlike(r"\.tsx?$"), F.array(stem)).otherwise(F.array_distinct(F.concat(typed, itself, scripts)))

    return _once(F.regexp_replace(target, r"^(\./)+", ""), lambda t: _once(_stem(t), lambda stem: of(t, stem)))


def _stem(target: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(target, "^dist/", "src/"), r"(\.d\.ts|\.js|\.mjs|\.cjs|\.jsx)$", "")


def _base(path: Column) -> Column:
    """What the candidates of a target have in common: nearly always all of them one base."""
    return F.regexp_replace(path, r"(/index)*(\.d)?\.(ts|tsx|js|mjs|cjs|jsx)$", "")


def source_bases(target: Column) -> Column:
    """The bases of source_candidates(): those that the stem has with either ending, and that of the target itself."""
    of = lambda t, stem: F.array_distinct(F.transform(F.array(stem, F.concat(stem, F.lit(".ts")), F.concat(stem, F.lit("/index.ts")), t), _base))
    return _once(F.regexp_replace(target, r"^(\./)+", ""), lambda t: _once(_stem(t), lambda stem: of(t, stem)))


def relative_candidates(rel: Column, spec: Column) -> Column:
    return source_candidates(join(directory(rel), spec))


def _condition_targets(entry: Column, star: Column) -> Column:
    """Of one entry of an export map, as JSON: a string itself, or the strings of the known conditions, with the wildcard's
    text filled in. Anything else gives none."""
    fill = lambda v: F.when(star.isNull(), v).otherwise(F.replace(v, F.lit("*"), F.coalesce(star, F.lit(""))))
    plain = lambda v: v.isNotNull() & ~v.rlike(r"^\s*[\[{]")
    known = _once(F.from_json(entry, "map<string,string>"), lambda found: F.filter(F.array(*[found[c] for c in CONDITIONS]), plain))
    return F.when(entry.rlike(r"^\s*\{"), F.transform(known, fill)).when(plain(entry), F.array(fill(entry))).otherwise(F.array().cast("array<string>"))


def export_targets(packages: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (package, key) with `targets`: what the package's export map gives for the key, in order.

    The exact key, even if its entry gives nothing; else the first key with a wildcard, in the order of keys, that fits.
    An export map that is a string is that of `.`; one without keys for paths gives nothing.
    """
    entries = F.array_sort(F.map_entries(F.from_json("exports", "map<string,string>")))
    head, tail = (lambda e: F.substring_index(e["key"], "*", 1)), (lambda e: F.substr(e["key"], F.instr(e["key"], "*") + 1))
    fits = lambda e: e["key"].contains("*") & F.col("key").startswith(head(e)) & F.col("key").endswith(tail(e)) & (F.length("key") >= F.length(head(e)) + F.length(tail(e)))
    exact, wild = F.get(F.filter("_entries", lambda e: e["key"] == F.col("key")), F.lit(0)), F.get(F.filter("_entries", fits), F.lit(0))
    star = F.substr("key", F.length(head(F.col("_wild"))) + 1, F.length("key") - F.length(head(F.col("_wild"))) - F.length(tail(F.col("_wild"))))
    text = F.get(F.from_json(F.concat(F.lit("["), F.col("exports"), F.lit("]")), "array<string>"), F.lit(0))
    out = asked.join(packages.select(F.col("name").alias("package"), "exports", entries.alias("_entries")), "package", "left")
    out = out.withColumn("_exact", exact).withColumn("_wild", wild)
    none = F.array().cast("array<string>")
    targets = (
        F.when(F.col("exports").isNull(), none)
        .when(F.col("exports").rlike(r"^\s*\""), F.when(F.col("key") == ".", F.array(text)).otherwise(none))
        .when(F.col("_exact").isNotNull(), _condition_targets(F.col("_exact.value"), F.lit(None).cast("string")))
        .when(F.col("_wild").isNotNull(), _condition_targets(F.col("_wild.value"), star))
        .otherwise(none)
    )
    return out.withColumn("targets", targets).drop("exports", "_entries", "_exact", "_wild")


def package_candidates(packages: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (package, sub: null for the package itself) with `candidates`, whole paths in order."""
    keyed = asked.withColumn("key", F.when(F.col("sub").isNull(), ".").otherwise(F.concat(F.lit("./"), F.col("sub"))))
    found = export_targets(packages, keyed).join(packages.select(F.col("name").alias("package"), "dir", "main"), "package", "left")
    plain = F.when(F.col("sub").isNull(), F.coalesce("main", F.lit("src/index.ts"))).otherwise(F.concat(F.lit("src/"), F.col("sub")))
    targets = F.when(F.size("targets") > 0, F.col("targets")).otherwise(F.array(plain))
    under = F.transform(F.flatten(F.transform(targets, source_candidates)), lambda p: normal(F.concat_ws("/", F.col("dir"), p)))
    return found.select(*asked.columns, F.array_distinct(under).alias("candidates"))


def first_candidate(asked: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """key and `file`: of asked (key, candidates) the first candidate that files (rel) has; null if none. The key may have
    a column rel of its own. Candidates meet the few files of their base, so there is no row for each candidate. asked may
    have the bases of its candidates, as `bases`."""
    near = files.select("rel").where("rel is not null").distinct().groupBy(_base(F.col("rel")).alias("_base")).agg(F.collect_list("rel").alias("_rels"))
    each = asked.select(*key, "candidates", F.explode("bases" if "bases" in asked.columns else F.array_distinct(F.transform("candidates", _base))).alias("_base")).join(near, "_base")
    found = F.get(F.filter(F.transform("candidates", lambda c, i: F.struct(i.alias("ord"), c.alias("candidate"))), lambda x: F.array_contains("_rels", x["candidate"])), F.lit(0))
    best = each.select(*key, found.alias("_found")).groupBy(*key).agg(F.min_by("_found.candidate", "_found.ord").alias("file"))
    return asked.select(*key).distinct().join(best, key, "left")


def links(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """imports (rel, specifier, package: the importer's) with `link_kind` and `link`: workspace or npm, by what the
    importer declares for the name: `workspace:` a known package, `npm:` the aliased name. What is declared otherwise, or
    not at all, is the npm package of that name."""
    declared = packages.select(F.col("name").alias("package"), F.explode("deps").alias("_dep", "_spec"))
    known = packages.select(F.col("name").alias("_known")).distinct()
    out = imports.withColumn("_dep", package_of(F.col("specifier"))).join(declared, ["package", "_dep"], "left").join(known, F.col("_dep") == F.col("_known"), "left")
    own = F.coalesce(F.col("_spec").startswith("workspace:") & F.col("_known").isNotNull(), F.lit(False))
    alias = F.coalesce(F.col("_spec").startswith("npm:"), F.lit(False))
    out = out.withColumn("link_kind", F.when(own, "workspace").otherwise("npm"))
    return out.withColumn("link", F.when(alias, without_version(F.col("_spec"))).otherwise(F.col("_dep"))).drop("_known", "_spec", "_dep")


def local_package(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """imports (specifier, package: the importer's) with `local`: the workspace package of the specifier's name, however
    the importer declares it, unless as an alias (`npm:`)."""
    declared = packages.select(F.col("name").alias("package"), F.explode("deps").alias("_dep", "_spec")).where("_spec like 'npm:%'")
    out = imports.withColumn("_dep", package_of(F.col("specifier"))).join(declared, ["package", "_dep"], "left")
    out = out.join(packages.select(F.col("name").alias("_known")).distinct(), F.col("_dep") == F.col("_known"), "left")
    return out.withColumn("local", F.when(F.col("_spec").isNull(), F.col("_known"))).drop("_dep", "_spec", "_known")


def resolve(imports: DataFrame, files: DataFrame, packages: DataFrame, external_packages: list[str]) -> DataFrame:
    """imports (rel, specifier, package: the importer's, or null) with `tag` (file, external, unresolved) and `value`.

    In this order: JSON assets, relative paths, built-ins, workspace packages (external ones by name), npm packages.
    files (rel): those that count as sources."""
    spec = F.col("specifier")
    linked = settle(links(imports, packages).withColumn("_sub", F.coalesce(subpath_of(spec), F.lit(""))))  # read three times
    here = linked.where(spec.startswith(".")).select("rel", "specifier").distinct().withColumn("_at", join(directory(F.col("rel")), spec))
    here = here.select("rel", "specifier", source_candidates(F.col("_at")).alias("candidates"), source_bases(F.col("_at")).alias("bases"))
    there = linked.where("link_kind = 'workspace'").select(F.col("link").alias("package"), "_sub").distinct()
    there = package_candidates(packages, there.withColumn("sub", F.when(F.col("_sub") != "", F.col("_sub"))))
    local = first_candidate(here, files, ["rel", "specifier"])
    inner = first_candidate(there, files, ["package", "_sub"]).select(F.col("package").alias("link"), "_sub", F.col("file").alias("_inner"))
    out = linked.join(local, ["rel", "specifier"], "left").join(inner, ["link", "_sub"], "left")
    builtin = spec.startswith("node:") | spec.isin(BUILTINS)
    outside = (F.col("link_kind") == "workspace") & F.col("link").isin(external_packages) if external_packages else F.lit(False)
    value = (
        F.when(spec.endswith(".json"), F.lit("json-asset"))
        .when(spec.startswith("."), F.col("file"))
        .when(builtin, F.concat(F.lit("node:"), F.regexp_replace(spec, "^node:", "")))
        .when(outside, F.col("link"))
        .when(F.col("link_kind") == "workspace", F.col("_inner"))
        .otherwise(F.col("link"))
    )
    at_file = ~spec.endswith(".json") & (spec.startswith(".") | (~builtin & (F.col("link_kind") == "workspace") & ~outside))
    tag = F.when(value.isNull(), "unresolved").when(at_file, "file").otherwise("external")
    return out.select(*imports.columns, tag.alias("tag"), F.coalesce(value, spec).alias("value"))


def package_rule(externals: DataFrame, rules: DataFrame) -> DataFrame:
    """externals (name) with the rule (npm, rust) of that name, or else of `node:` and that name; null without one."""
    a = rules.select(F.col("npm").alias("name"), F.col("rust").alias("_exact"))
    b = rules.where("npm like 'node:%'").select(F.substring("npm", 6, 1 << 20).alias("name"), F.col("rust").alias("_bare"))
    return externals.join(a, "name", "left").join(b, "name", "left").withColumn("rust", F.coalesce("_exact", "_bare")).drop("_exact", "_bare")


def map_exports(exports: DataFrame, items: DataFrame, explicit: DataFrame, previous: DataFrame) -> DataFrame:
    """exports (rel, name, kind) with `item`: the explicit mapping, else the name, its snake form or it in capitals among
    the items (rel, item), else the previous mapping (not for re-exports and defaults); null: unmapped."""
    from ravelin.functions.names import snake

    n = F.col("name")
    tries = exports.select("rel", "name", F.posexplode(F.array(n, snake(n), F.upper(n))).alias("ord", "item")).join(items, ["rel", "item"], "left_semi")
    found = tries.groupBy("rel", "name").agg(F.min_by("item", "ord").alias("found"))
    out = exports.join(found, ["rel", "name"], "left").join(explicit.select("rel", "name", F.col("item").alias("told")), ["rel", "name"], "left").join(previous.select("rel", "name", F.col("item").alias("old")), ["rel", "name"], "left")
    return out.withColumn("item", F.coalesce("told", "found", F.when(~F.col("kind").isin("reexport", "default"), F.col("old")))).drop("told", "found", "old")
