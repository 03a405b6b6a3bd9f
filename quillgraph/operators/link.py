"""Resolving module specifiers to files and names to symbols, all rows at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.storage import settled, written

# What a path may end with, in order of preference.
ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.mjs"]


def normalised(path: Column) -> Column:
    """A lexically normalised relative path: no ``.`` or empty part, ``x/..`` folded however often; ``..`` stays where nothing is left to fold."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    last = lambda done: F.try_element_at(done, F.lit(-1))
    fold = lambda done, p: F.when((p == "..") & (F.coalesce(last(done), F.lit("..")) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), fold), "/")


def specifier_kind(specifier: Column) -> Column:
    """Precedence of resolution: empty, dynamic, relative, absolute, else a package or alias."""
    return (
        F.when(F.coalesce(F.trim(specifier), F.lit("")) == "", "empty")
        .when(specifier.rlike(r"[`$]"), "dynamic")
        .when(specifier.rlike(r"^\.\.?(/|$)"), "relative")
        .when(specifier.startswith("/"), "absolute")
        .otherwise("package")
    )


def matched_alias(pattern: Column, specifier: Column) -> Column:
    """What the one ``*`` of an alias pattern stands for in a specifier; null if it does not fit."""
    head, tail = F.substring_index(pattern, "*", 1), F.substring_index(pattern, "*", -1)
    one = (F.length(pattern) - F.length(F.replace(pattern, F.lit("*"), F.lit("")))) == 1
    fits = one & F.startswith(specifier, head) & F.endswith(specifier, tail) & (F.length(specifier) >= F.length(head) + F.length(tail))
    return F.when(fits, F.substring(specifier, F.length(head) + 1, F.length(specifier) - F.length(head) - F.length(tail)))


def alias_matches(specifiers: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows of ``specifiers`` with each (pattern, target) that fits and what its ``*`` stands for, by an equi-join on heads."""
    head = F.substring_index("pattern", "*", 1)
    known = aliases.select("pattern", "target", head.alias("head")).where("pattern like '%*%'").distinct()
    # only lengths that some head has: one small row, however many patterns there are
    lengths = F.broadcast(known.agg(F.coalesce(F.collect_set(F.length("head")), F.array().cast("array<int>")).alias("lengths")))
    asked = specifiers.join(lengths, F.lit(True)).withColumn("n", F.explode("lengths")).where(F.col("n") <= F.length("specifier"))
    asked = asked.withColumn("head", F.substring(F.col("specifier"), F.lit(1), F.col("n"))).drop("lengths", "n")
    star = matched_alias(F.col("pattern"), F.col("specifier"))
    return asked.join(known, "head").withColumn("star", star).where("star is not null").drop("head")


def wanted_paths(imports: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Imports (file_id, rel_path, specifier) with kind and the path, apart from its ending, that they ask for; null for packages."""
    kind = specifier_kind(F.col("specifier"))
    base = F.regexp_extract("rel_path", r"^(.*/)?[^/]*$", 1)
    wanted = F.when(kind == "relative", normalised(F.concat(base, "specifier"))).when(kind == "absolute", normalised(F.col("specifier")))
    rows = imports.withColumn("kind", kind).withColumn("wanted", wanted)
    if aliases is not None:
        mapped = alias_matches(rows.where("kind = 'package'").select("file_id", "specifier").distinct(), aliases)
        best = mapped.groupBy("file_id", "specifier").agg(F.min_by(F.struct(F.replace("target", F.lit("*"), "star").alias("path")), F.struct(-F.length("pattern"), "pattern")).alias("m"))
        rows = rows.join(best, ["file_id", "specifier"], "left").withColumn("kind", F.when(F.col("m").isNotNull(), "alias").otherwise(F.col("kind"))).withColumn("wanted", F.coalesce("wanted", "m.path")).drop("m")
    return rows


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Imports (file_id, rel_path, specifier) with kind, target_file_id, confidence and status.

    Every import names its candidate paths in order of preference; one equi-join with
    the files and one minimum decide.  ``aliases`` has (pattern, target), however many:
    an import names every head that a pattern could have and meets those of one ``*``.
    Ambiguous imports have no target.
    """
    rows = imports if "wanted" in imports.columns else wanted_paths(imports, aliases)
    asked = rows.where("wanted is not null").select("wanted").distinct()
    probes = asked.select("wanted", F.posexplode(F.transform(F.array(*map(F.lit, ENDINGS)), lambda e: F.concat("wanted", e))).alias("order", "path"))
    there = probes.join(files.select(F.col("rel_path").alias("path"), F.col("file_id").alias("target_file_id"), F.col("root_id").alias("target_root")), "path")
    first = there.groupBy("wanted").agg(F.min("order").alias("order"))
    hits = there.join(first, ["wanted", "order"]).groupBy("wanted").agg(F.min("target_file_id").alias("target_file_id"), F.min("target_root").alias("target_root"), F.count_distinct("target_file_id").alias("n"))
    out = rows.join(hits, "wanted", "left")
    status = F.when(F.col("kind").isin("empty", "dynamic"), F.col("kind")).when(F.col("n") > 1, "ambiguous").when(F.col("n") == 1, "resolved").when(F.col("kind") == "package", "external").otherwise("missing")
    confidence = F.when(status == "ambiguous", 0.4).when((status == "resolved") & (F.col("target_root") != F.col("root_id")), 0.9).when(status == "resolved", 1.0).otherwise(0.0)
    out = out.withColumn("status", status).withColumn("confidence", confidence).drop("n", "target_root")
    return out.withColumn("target_file_id", F.when(F.col("status") != "ambiguous", F.col("target_file_id")))


def package_of(specifier: Column) -> tuple[Column, Column]:
    """Package name (scoped ones have two parts) and the path inside it."""
    pattern = r"^(@[^/]+/[^/]+|[^/@][^/]*)(?:/(.*))?$"
    return F.regexp_extract(specifier, pattern, 1), F.regexp_extract(specifier, pattern, 2)


def resolve_packages(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """Imports of workspace packages (name, root_path) with the path that they reach."""
    name, inner = package_of(F.col("specifier"))
    return imports.withColumn("name", name).withColumn("inner", inner).join(packages, "name").withColumn("path", F.concat_ws("/", "root_path", F.when(F.col("inner") == "", "index").otherwise(F.col("inner"))))


def resolve_names(uses: DataFrame, symbols: DataFrame, imported: DataFrame) -> DataFrame:
    """Uses (use_id, file_id, name) with symbol_id, status and reason.

    The ladder: one symbol of that name in the file; several there stop it; one among the
    files that the file imports (exported); several there stop it; one in the workspace.
    ``imported`` has (file_id, target_file_id).  Names are counted once each, not per use.
    """
    known = symbols.select("name", "symbol_id", F.col("file_id").alias("owner"), "exported")
    local = known.groupBy("name", "owner").agg(F.count("*").alias("n1"), F.min("symbol_id").alias("s1"))
    near = imported.select("file_id", "target_file_id").distinct().join(known.where("exported"), F.col("target_file_id") == F.col("owner")).groupBy("file_id", "name").agg(F.count_distinct("symbol_id").alias("n2"), F.min("symbol_id").alias("s2"))
    everywhere = known.groupBy("name").agg(F.count("*").alias("n3"), F.min("symbol_id").alias("s3"))
    out = uses.join(local.withColumnRenamed("owner", "file_id"), ["file_id", "name"], "left").join(near, ["file_id", "name"], "left").join(everywhere, "name", "left")
    return out.withColumn("r", ladder()).select(*uses.columns, "r.symbol_id", "r.status", "r.reason")


def binding_candidates(uses: DataFrame, symbols: DataFrame, bindings: DataFrame) -> DataFrame:
    """(use_id, symbol_id): exported symbols that the bindings of a use's file may mean by its name.

    ``uses`` has (use_id, file_id, name, qualified), ``bindings`` (file_id, local_name,
    imported_name, target_file_id).  A binding of the name leads to the imported name in
    its target (to the local one for default and unnamed imports, and to ``default``); a
    name of exactly two parts whose first is a namespace binding (``*``) to the second.
    """
    known = symbols.where("exported").select(F.col("file_id").alias("target_file_id"), F.col("name").alias("wanted"), "symbol_id")
    direct = uses.join(bindings.where("imported_name is null or imported_name != '*'"), ["file_id"]).where("name = local_name")
    named = F.when(F.coalesce("imported_name", F.lit("default")) == "default", F.array_distinct(F.array("local_name", F.lit("default")))).otherwise(F.array("imported_name"))
    named = F.when(F.col("imported_name").isNull(), F.array("local_name")).otherwise(named)
    asked = direct.select("use_id", "target_file_id", F.explode(named).alias("wanted"))
    two = uses.where(F.col("qualified").rlike(r"^[^.]+\.[^.]+$"))
    two = two.withColumn("local_name", F.split_part("qualified", F.lit("."), F.lit(1))).withColumn("wanted", F.split_part("qualified", F.lit("."), F.lit(2)))
    spaces = two.join(bindings.where("imported_name = '*'"), ["file_id", "local_name"]).select("use_id", "target_file_id", "wanted")
    return asked.unionByName(spaces).join(known, ["target_file_id", "wanted"]).select("use_id", "symbol_id").distinct()


def resolve_uses(uses: DataFrame, symbols: DataFrame, bindings: DataFrame) -> DataFrame:
    """Uses (use_id, file_id, name, qualified) with symbol_id, status, reason and the number of candidates, by bindings instead of whole imported files."""
    # what a name means in a file is asked once, however often it is used there
    qualified = F.coalesce("qualified", F.lit(""))
    asked = uses.select("file_id", "name", qualified.alias("qualified")).distinct().withColumn("use_id", F.struct("file_id", "name", "qualified"))
    known = symbols.select("name", "symbol_id", F.col("file_id").alias("owner"))
    local = known.groupBy("name", F.col("owner").alias("file_id")).agg(F.count("*").alias("n1"), F.min("symbol_id").alias("s1"))
    near = binding_candidates(asked, symbols, bindings).groupBy("use_id").agg(F.count("*").alias("n2"), F.min("symbol_id").alias("s2"))
    everywhere = known.groupBy("name").agg(F.count("*").alias("n3"), F.min("symbol_id").alias("s3"))
    told = asked.join(local, ["file_id", "name"], "left").join(near, "use_id", "left").join(everywhere, "name", "left")
    told = told.select("file_id", "name", F.col("qualified").alias("__q"), ladder().alias("r"))
    out = uses.withColumn("__q", qualified).join(told, ["file_id", "name", "__q"])
    return out.select(*uses.columns, "r.symbol_id", "r.status", "r.reason", F.coalesce("r.candidates", F.lit(0)).alias("candidates"))


def ladder() -> Column:
    """The first of n1, n2, n3 that is not null decides: one candidate resolves, several stop the search."""
    none = F.lit(None).cast("bigint")
    rung = lambda symbol, status, reason, n: F.struct(symbol.alias("symbol_id"), F.lit(status).alias("status"), F.lit(reason).alias("reason"), n.cast("bigint").alias("candidates"))
    step = F
    for n, symbol, where in (("n1", "s1", "local"), ("n2", "s2", "imported"), ("n3", "s3", "workspace")):
        step = step.when(F.col(n) == 1, rung(F.col(symbol), "resolved", where, F.col(n))).when(F.col(n) > 1, rung(none, "unresolved", f"{where}_ambiguous", F.col(n)))
    return step.otherwise(rung(none, "unresolved", "missing", none))


def link_imports(resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges of imports (file_id, specifier, imported_name, is_reexport, line, status, target_file_id): to the file, or to themselves where nothing was found.

    The one exported symbol of the imported name in the target is told in the payload.
    """
    exported = symbols.where("exported").groupBy(F.col("file_id").alias("target_file_id"), F.col("name").alias("imported_name")).agg(F.count("*").alias("n"), F.min("symbol_id").alias("s"))
    out = resolved.join(exported, ["target_file_id", "imported_name"], "left").withColumn("symbol_id", F.when(F.col("n") == 1, F.col("s")))
    found = F.col("target_file_id").isNotNull()
    reason = F.when(found, "resolved_path_matched_indexed_file").when(F.col("status") == "external", "external_dependency").otherwise(F.col("status"))
    told = F.to_json(F.struct("specifier", "imported_name", F.when(found, "linked").otherwise("unresolved").alias("status"), reason.alias("reason"), F.col("target_file_id").alias("resolved_file_id"), F.col("symbol_id").alias("resolved_symbol_id")))
    origin = [F.col("origin")] if "origin" in resolved.columns else []
    return out.select(
        *origin, F.when(F.col("is_reexport"), "re_exports").otherwise("imports").alias("kind"), F.lit("file").alias("from_kind"), F.col("file_id").alias("from_id"),
        F.lit("file").alias("to_kind"), F.coalesce("target_file_id", "file_id").alias("to_id"), F.when(found, "resolved").otherwise("unresolved").alias("resolution"),
        F.when(found, "direct").otherwise("best_effort").alias("confidence"), "line", told.alias("payload_json"),
    )


def link_uses(uses: DataFrame, symbols: DataFrame, bindings: DataFrame) -> DataFrame:
    """Edges of uses (kind, file_id, caller_id, name, qualified, line): from the symbol around them, or the file, to what the ladder finds, else to where they are."""
    out = resolve_uses(uses, symbols, bindings)
    source_kind, source = F.when(F.col("caller_id").isNotNull(), "symbol").otherwise("file"), F.coalesce("caller_id", "file_id")
    found = F.col("symbol_id").isNotNull()
    told = F.to_json(F.struct("name", "qualified", "status", "reason", "candidates"))
    return out.select(
        "origin", "kind", source_kind.alias("from_kind"), source.alias("from_id"), F.when(found, "symbol").otherwise(source_kind).alias("to_kind"), F.coalesce("symbol_id", source).alias("to_id"),
        F.when(found, "resolved").otherwise("unresolved").alias("resolution"), F.when(found, "direct").otherwise("best_effort").alias("confidence"), "line", told.alias("payload_json"),
    )


#: What a use asks; all uses of a file that ask the same have one answer.
ASKED = ["file_id", "name", "qualified"]


def with_origins(imports: DataFrame, calls: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Imports, and calls and references as one table with their kind, each row with the name of its origin: an import, or what uses of a file ask."""
    text = lambda *columns: [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    told = text("file_id", "line", "specifier", "local_name", "imported_name", "is_reexport")
    uses = calls.withColumn("kind", F.lit("calls")).unionByName(references.withColumn("kind", F.lit("references")))
    return imports.withColumn("origin", F.concat_ws("\n", *told)), uses.withColumn("origin", F.concat_ws("\n", F.lit("use"), *text(*ASKED)))


def linked(files: DataFrame, symbols: DataFrame, imports: DataFrame, uses: DataFrame, aliases: DataFrame | None = None, of: DataFrame | None = None) -> DataFrame:
    """Edges with the origin of each, of imports and uses as ``with_origins`` gives them; ``of`` (origin) are the imports whose edges are wanted, if not all."""
    # each of these is read several times
    files, symbols = settled(files.select("file_id", "rel_path", "root_id")), settled(symbols.select("symbol_id", "file_id", "name", "exported"))
    placed = settled(wanted_paths(imports.join(files, "file_id"), aliases))
    resolved = settled(resolve_imports(placed, files))
    bindings = resolved.where("target_file_id is not null and local_name is not null").select("file_id", "local_name", "imported_name", "target_file_id")
    own = resolved if of is None else resolved.join(of.select("origin").distinct(), "origin", "left_semi")
    return link_imports(own, symbols).unionByName(link_uses(uses, symbols, bindings))


def link_workspace(files: DataFrame, symbols: DataFrame, imports: DataFrame, calls: DataFrame, references: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """All edges of a workspace in one job.

    ``imports`` has (file_id, specifier, local_name, imported_name, is_reexport, line),
    ``calls`` and ``references`` (use_id, file_id, caller_id, name, qualified, line).
    """
    return linked(files, symbols, *with_origins(imports, calls, references), aliases).drop("origin")


def waiting(files: DataFrame, imports: DataFrame, uses: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(key, origin): the paths, names and bindings that the edges of an import or of uses depend on, there or not.

    Imports wait for every path that they could reach and for the name that they import; uses for their name, for the names
    that bindings of their file make of it, and for these bindings, once for all that ask the same.
    """
    asked = wanted_paths(imports.join(files.select("file_id", "rel_path"), "file_id"), aliases).where("wanted is not null")
    paths = asked.select(F.explode(F.transform(F.array(*map(F.lit, ENDINGS)), lambda e: F.concat(F.lit("path:"), "wanted", e))).alias("key"), "origin")
    name = lambda c: F.concat(F.lit("name:"), c)
    out = paths.unionByName(imports.where("imported_name is not null").select(name("imported_name").alias("key"), "origin"))
    uses = uses.select("origin", *ASKED).distinct()
    head, second = F.split_part("qualified", F.lit("."), F.lit(1)), F.split_part("qualified", F.lit("."), F.lit(2))
    parts = F.array_distinct(F.array_compact(F.array("name", F.when(F.col("qualified").contains("."), head))))
    own = uses.select("origin", F.explode(F.array_compact(F.array(F.col("name"), F.when(F.col("qualified").contains("."), second)))).alias("n")).select(name("n").alias("key"), "origin")
    bound = uses.select("origin", "file_id", F.explode(parts).alias("local_name"))
    bind = bound.select(F.concat_ws(":", F.lit("bind"), "file_id", "local_name").alias("key"), "origin")
    known = imports.where("local_name is not null").select("file_id", "local_name", F.explode(F.array(F.coalesce("imported_name", F.lit("default")), F.lit("default"))).alias("n")).distinct()
    through = bound.join(known, ["file_id", "local_name"]).select(name("n").alias("key"), "origin")
    return out.unionByName(own).unionByName(bind).unionByName(through)


def relinked(edges: DataFrame, before: dict[str, DataFrame], now: dict[str, DataFrame], changed: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """The edges (with origins) after files changed: only those are linked again whose paths, names or bindings the change touches.

    ``before`` and ``now`` hold files, symbols, imports and uses (the last two ``with_origins``); ``changed`` has the file_id of each
    file that came, went or was read again.  All other edges stay as they are.
    """
    changed = settled(changed.select("file_id").distinct())
    of = lambda rows: rows.join(changed, "file_id", "left_semi")
    path = lambda t: t["files"].select("file_id", F.concat(F.lit("path:"), "rel_path").alias("key"))
    moved = of(path(before)).select("key").unionByName(of(path(now)).select("key"))
    names = of(before["symbols"]).select("name").unionByName(of(now["symbols"]).select("name")).select(F.concat(F.lit("name:"), "name").alias("key"))
    touched = settled(moved.unionByName(names).distinct())
    waits = written(waiting(now["files"], now["imports"], now["uses"], aliases), "waits")
    hit = waits.join(touched, "key", "left_semi").select("origin")
    turned = written(now["imports"].join(hit.unionByName(of(now["imports"]).select("origin")).distinct(), "origin", "left_semi"), "imports")
    bound = turned.unionByName(of(before["imports"])).where("local_name is not null").select(F.concat_ws(":", F.lit("bind"), "file_id", "local_name").alias("key")).distinct()
    hit = waits.join(touched.unionByName(bound).distinct(), "key", "left_semi").select("origin")
    asked = settled(hit.unionByName(of(now["uses"].select("origin", "file_id").distinct()).select("origin")).distinct())
    again = written(now["uses"].join(asked, "origin", "left_semi"), "uses")
    gone = of(before["imports"]).select("origin").unionByName(of(before["uses"].select("origin", "file_id").distinct()).select("origin"))
    left = gone.unionByName(turned.select("origin")).unionByName(asked)
    kept = edges.join(left, "origin", "left_anti")
    # names of a file are read through all of its imports
    homes = turned.select("file_id").unionByName(again.select("file_id")).distinct()
    near = now["imports"].join(homes, "file_id", "left_semi")
    return kept.unionByName(linked(now["files"], now["symbols"], near, again, aliases, turned))


def payload(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumn("payload_json", F.to_json(F.struct(*columns)))


def relink(edges: DataFrame, symbols: DataFrame, imported: DataFrame) -> DataFrame:
    """Only unresolved edges (edge_id, file_id, status, payload_json with name) are resolved again; others stay."""
    keep = edges.where("status = 'resolved'")
    again = edges.where("status != 'resolved'").select(F.col("edge_id").alias("use_id"), "file_id", F.get_json_object("payload_json", "$.name").alias("name"))
    found = resolve_names(again, symbols, imported)
    return keep.select("edge_id", "file_id", "symbol_id", "status").unionByName(found.select(F.col("use_id").alias("edge_id"), "file_id", "symbol_id", "status"))


def read_configs(files: DataFrame, path: str = "rel_path", text: str = "content") -> DataFrame:
    """(config, extends, pattern, target) of configuration texts: comments and trailing commas are left out; a config without aliases has one row of nulls, as has one that is no JSON."""
    bare = F.regexp_replace(F.col(text), r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*[\s\S]*?\*/', "$1")
    bare = F.regexp_replace(bare, r",(\s*[}\]])", "$1")
    parsed = F.from_json(bare, "extends string, compilerOptions struct<baseUrl: string, paths: map<string, array<string>>>")
    rows = files.select(F.col(path).alias("config"), parsed.alias("c"))
    base = F.regexp_extract("config", r"^(.*/)?[^/]*$", 1)
    above = F.when(F.col("c.extends").isNotNull(), normalised(F.concat(base, F.when(F.col("c.extends").endswith(".json"), F.col("c.extends")).otherwise(F.concat("c.extends", F.lit(".json"))))))
    flat = rows.select("config", above.alias("extends"), base.alias("base"), F.col("c.compilerOptions.baseUrl").alias("url"), F.explode_outer("c.compilerOptions.paths").alias("pattern", "targets"))
    target = F.when(F.size("targets") > 0, normalised(F.concat("base", F.coalesce("url", F.lit(".")), F.lit("/"), F.col("targets")[0])))
    return flat.select("config", "extends", "pattern", target.alias("target"))


def inherited_aliases(configs: DataFrame, depth: int = 8) -> DataFrame:
    """(config, pattern, target): aliases of each configuration and of those that it extends; the nearest wins.

    ``configs`` has (config, extends, pattern, target), one row an alias.
    """
    chain = configs.select("config", F.col("config").alias("at"), "extends").distinct().withColumn("far", F.lit(0))
    above = configs.select(F.col("config").alias("next"), F.col("extends").alias("beyond")).distinct()
    step = chain
    for far in range(1, depth + 1):
        step = step.where("extends is not null").join(above, F.col("extends") == F.col("next")).select("config", F.col("next").alias("at"), F.col("beyond").alias("extends"), F.lit(far).alias("far"))
        chain = chain.unionByName(step)
    own = configs.select(F.col("config").alias("at"), "pattern", "target").where("pattern is not null")
    return chain.join(own, "at").groupBy("config", "pattern").agg(F.min_by("target", "far").alias("target"))
