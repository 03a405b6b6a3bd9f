"""Traversal of typed graphs: deduplicating frontier loops over edge tables.

A node is a (kind, id) pair and always joined as such.  Loops run hop by hop: the
frontier joins the edges, what was seen before is removed by an anti-join, and the
result of a hop is checkpointed, so a walk never grows with the number of paths and a
lost executor costs one hop.  Every seed keeps its own visited set, so a batch of seeds
is one job.  The steps of a walk are stored once as lists of neighbours, which are
shuffled whole and opened where their nodes are compared; the last hop of a walk, which
is most of it, is neither checkpointed nor sorted.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.storage import many, settled, written

NODE = ["node_kind", "node_id"]
#: After so many hops what was seen is written into one table.
REWRITE = 16
#: Neighbours in a list at most.
LIST = 1024
#: Nodes met by a seed in a hop, repeats included, that are compared as one array at most.
ARRAY = 500_000


def hydrated(edges: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Edges with two more for each symbol of a live file: the file contains it, it is defined in the file."""
    live = symbols.join(files.where("deleted_at_unix_ms is null").select("file_id"), "file_id")
    sides = lambda kind, a, ka, b, kb: live.select(F.lit(kind).alias("kind"), F.lit(ka).alias("from_kind"), F.col(a).alias("from_id"), F.lit(kb).alias("to_kind"), F.col(b).alias("to_id"), F.lit("resolved").alias("resolution"), F.col("line_start").cast("int").alias("line"))
    return edges.unionByName(sides("contains", "file_id", "file", "symbol_id", "symbol")).unionByName(sides("definition", "symbol_id", "symbol", "file_id", "file"))


def hydration_stats(edges: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """One row: nodes, persisted and synthetic edges."""
    live = symbols.join(files.where("deleted_at_unix_ms is null").select("file_id"), "file_id").agg((2 * F.count("*")).alias("synthetic_edges"))
    nodes = files.agg(F.count("*").alias("files")).join(symbols.agg(F.count("*").alias("symbols")), F.lit(True))
    kept = edges.agg(F.count("*").alias("persisted_edges"))
    # every side is one row of an aggregate
    return nodes.join(kept, F.lit(True)).join(live, F.lit(True)).select((F.col("files") + F.col("symbols")).alias("nodes"), "persisted_edges", "synthetic_edges")


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """(a_kind, a_id, b_kind, b_id, kind): steps from a to b; direction: outgoing, incoming or both; others give none."""
    out = edges.select(F.col("from_kind").alias("a_kind"), F.col("from_id").alias("a_id"), F.col("to_kind").alias("b_kind"), F.col("to_id").alias("b_id"), "kind")
    back = edges.select(F.col("to_kind").alias("a_kind"), F.col("to_id").alias("a_id"), F.col("from_kind").alias("b_kind"), F.col("from_id").alias("b_id"), "kind")
    if direction == "outgoing":
        return out
    if direction == "incoming":
        return back
    return out.unionByName(back) if direction == "both" else out.where(F.lit(False))


def adjacency(edges: DataFrame, direction: str) -> DataFrame:
    """(a_kind, a_id, b_kind, b_ids): the different nodes one step from each node in lists of ``LIST`` at most, stored."""
    steps = directed(edges, direction).select("a_kind", "a_id", "b_kind", "b_id").where("a_kind is not null and a_id is not null")
    # ids go first: rows are sorted by numbers, and by names of kinds only where these are equal
    w = Window.partitionBy("a_id", "a_kind").orderBy("b_id", "b_kind")
    again = F.col("b_id").eqNullSafe(F.lag("b_id").over(w)) & F.col("b_kind").eqNullSafe(F.lag("b_kind").over(w)) & (F.row_number().over(w) > 1)
    own = steps.repartition("a_id", "a_kind").withColumn("again", again).withColumn("part", F.when(F.col("b_id").isNotNull(), F.floor(F.row_number().over(w) / LIST)))
    lists = own.where(~F.col("again")).groupBy("a_id", "a_kind", "b_kind", "part").agg(F.collect_list("b_id").alias("b_ids"))
    # a null id is a node too, which no list collects
    ids = F.when(F.col("part").isNull(), F.array(F.lit(None).cast("bigint"))).otherwise(F.col("b_ids"))
    return written(lists.select("a_kind", "a_id", "b_kind", ids.alias("b_ids")), "steps")


def opened(rows: DataFrame, owner: str, by_owner: bool) -> DataFrame:
    """Rows with a list of nodes (node_kind, ids) as one row a node.

    By owner, lists are shuffled whole to a task that gets all of an owner, where later groups by owner and node are made;
    with few owners they are opened first, so that the nodes of one are dealt over all tasks.
    """
    rows = rows.repartition(owner) if by_owner else rows
    return rows.withColumn("node_id", F.explode("ids")).drop("ids")


def met_lists(front: DataFrame, steps: DataFrame, *columns: str) -> DataFrame:
    """Lists of nodes (node_kind, ids) one step from a front, with columns of the front."""
    met = front.join(steps, (F.col("node_id") == F.col("a_id")) & (F.col("node_kind") == F.col("a_kind")))
    return met.select(*columns, F.col("b_kind").alias("node_kind"), F.col("b_ids").alias("ids"))


def frontier(edges: DataFrame, seeds: DataFrame, max_hops: int | None, direction: str = "outgoing") -> DataFrame:
    """(seed, node_kind, node_id, depth): nodes within ``max_hops`` (None: any number) of each seed with their least depth, the seed at 0.

    ``seeds`` has (seed, node_kind, node_id).  Stops when a hop finds nothing new.  The
    last of a given number of hops is not stored: it is computed where the rows are read.
    """
    steps = adjacency(edges, direction)
    seen = settled(seeds.select("seed", *NODE).distinct().withColumn("depth", F.lit(0)))
    by_owner = many(seen.sparkSession, seen.select("seed").distinct().count())
    front = seen
    for hop in count(1) if max_hops is None else range(1, max_hops + 1):
        new = unseen(met_lists(front, steps, "seed"), seen, by_owner).withColumn("depth", F.lit(hop))
        if hop == max_hops:
            return seen.unionByName(new)
        front = settled(new)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if hop % REWRITE == 0:  # one table instead of as many as hops
            seen = settled(seen)
    return seen


def unseen(near: DataFrame, seen: DataFrame, by_seed: bool) -> DataFrame:
    """(seed, node_kind, node_id): the different nodes of the lists ``near`` (seed, node_kind, ids) that the seed has not seen.

    With many seeds the lists of a seed meet in its task: as two arrays of a kind, or, where they hold more than ``ARRAY``
    nodes, node by node, as with few seeds.
    """
    told = near.withColumn("new", F.lit(True)).unionByName(seen.select("seed", "node_kind", F.array("node_id").alias("ids"), F.lit(False).alias("new")))
    one_by_one = lambda rows: rows.withColumn("node_id", F.explode("ids")).groupBy("seed", *NODE).agg(F.min("new").alias("new")).where("new").drop("new")
    if not by_seed:
        return one_by_one(told)
    told = told.repartition("seed").withColumn("n", F.sum(F.size("ids")).over(Window.partitionBy("seed")))
    lists = lambda new: F.flatten(F.collect_list(F.when(F.col("new") == new, F.col("ids"))))
    arrays = told.where(F.col("n") <= ARRAY).groupBy("seed", "node_kind").agg(F.array_except(lists(True), lists(False)).alias("ids"))
    return arrays.select("seed", "node_kind", F.explode("ids").alias("node_id")).unionByName(one_by_one(told.where(F.col("n") > ARRAY)))


def neighbourhood(edges: DataFrame, seeds: DataFrame, max_hops: int, limit: int, direction: str = "both", kind: str | None = None) -> DataFrame:
    """The nearest ``limit`` nodes of each seed, of one kind if asked; ties by kind and id."""
    near = frontier(edges, seeds, max_hops, direction)
    near = near if kind is None else near.where(F.col("node_kind") == kind)
    w = Window.partitionBy("seed").orderBy("depth", *NODE)
    return near.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= limit).drop("__k")


def bounded_neighbourhood(edges: DataFrame, seeds: DataFrame, max_hops: int, limit: int, each: int = 256) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and state of each seed's outgoing neighbourhood over the first ``each`` edges of a node.

    Nodes: the nearest ``limit``.  Edges: those of kept nodes before the last hop, once for
    ends and kind.  State (seed, nodes, edges, truncated): whether a bound was met, the
    last hop included.
    """
    order = Window.partitionBy("from_kind", "from_id").orderBy("kind", "to_kind", "to_id")
    kept = settled(edges.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= each).drop("__k"))
    every = settled(frontier(kept, seeds, max_hops))
    w = Window.partitionBy("seed").orderBy("depth", *NODE)
    ranked = every.withColumn("__k", F.row_number().over(w))
    nodes = settled(ranked.where(F.col("__k") <= limit).drop("__k"))
    near = nodes.where(F.col("depth") < max_hops).select("seed", F.col("node_kind").alias("from_kind"), F.col("node_id").alias("from_id"))
    found = near.join(kept, ["from_kind", "from_id"]).select("seed", "kind", "from_kind", "from_id", "to_kind", "to_id").distinct()
    state = every.groupBy("seed").agg(F.count("*").alias("all"), F.max("depth").alias("far")).join(found.groupBy("seed").agg(F.count("*").alias("edges")), "seed", "left")
    state = state.select("seed", F.least("all", F.lit(limit)).alias("nodes"), F.coalesce("edges", F.lit(0)).alias("edges"), ((F.col("all") >= limit) | (F.col("far") == max_hops)).alias("truncated"))
    return nodes, found, state


def find_references(edges: DataFrame, symbols: DataFrame, files: DataFrame, asked: DataFrame, limit: int, include_tests: bool = False) -> tuple[DataFrame, DataFrame]:
    """References of each (question_id, symbol_id or name), the first symbol of the name, up to the limit; and (question_id, answer_state, n).

    Insufficient without a symbol or a reference, partial where the limit is met, else grounded.
    """
    first = symbols.groupBy("name").agg(F.min("symbol_id").alias("__first"))
    found = asked.join(first, "name", "left").select("question_id", F.coalesce("symbol_id", "__first").alias("symbol_id"))
    rows = found.join(references(edges, symbols, files, include_tests), F.col("symbol_id") == F.col("to_id"))
    w = Window.partitionBy("question_id").orderBy("rel_path", "line", "from_id")
    kept = rows.withColumn("seq", F.row_number().over(w)).where(F.col("seq") <= limit).select("question_id", "seq", "symbol_id", "from_id", "from_name", "rel_path", "line")
    counts = kept.groupBy("question_id").agg(F.count("*").alias("n"))
    state = F.when(F.col("n").isNull(), "insufficient").when(F.col("n") >= limit, "partial").otherwise("grounded")
    return kept, found.join(counts, "question_id", "left").select("question_id", state.alias("answer_state"), F.coalesce("n", F.lit(0)).alias("n"))


def call_hierarchy(edges: DataFrame, seeds: DataFrame, max_depth: int, limit: int) -> DataFrame:
    """(seed, side, seq, node_id, depth): callers and callees of each seed, the nearest ``limit`` of either side."""
    out = None
    for side, way in (("callers", "incoming"), ("callees", "outgoing")):
        one = call_closure(edges, seeds, max_depth, way).select("seed", F.lit(side).alias("side"), "node_id", "depth")
        out = one if out is None else out.unionByName(one)
    w = Window.partitionBy("seed", "side").orderBy("depth", "node_id")
    return out.withColumn("seq", F.row_number().over(w)).where(F.col("seq") <= limit)


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int) -> DataFrame:
    """(pair, hops, path): a shortest outgoing path of each (pair, from node, to node); of several the one whose nodes come first by name.

    Both ends search towards each other a hop at a time, so neither reaches more than half
    as far; each reached node keeps the first of its paths, so walks are never enumerated.
    A path of length n has one node that is half of n from the one end and the rest from
    the other, where the two halves meet.
    """
    steps = [adjacency(edges, "outgoing"), adjacency(edges, "incoming")]
    name = F.concat_ws(":", *NODE)
    side = lambda end: pairs.select("pair", F.col(f"{end}_kind").alias("node_kind"), F.col(f"{end}_id").alias("node_id")).distinct().withColumn("path", F.array(name))
    fronts = [settled(side("from")), settled(side("to"))]
    by_owner = many(pairs.sparkSession, fronts[0].select("pair").distinct().count())
    seen, reached = list(fronts), None
    for hops in range(max_hops + 1):
        if hops:
            back = 1 - hops % 2  # odd lengths move the start's half, even ones the end's
            alive = fronts[back].join(reached.select("pair"), "pair", "left_anti")
            if hops == max_hops:
                return reached.unionByName(joined_halves(alive, fronts[1 - back], steps[back], back, by_owner).select("pair", F.lit(hops).alias("hops"), "path"))
            near = opened(met_lists(alive, steps[back], "pair", "path"), "pair", by_owner)
            longer = F.concat(F.array(name), "path") if back else F.concat("path", F.array(name))
            new = near.groupBy("pair", *NODE).agg(F.min("path").alias("path")).withColumn("path", longer)
            fronts[back] = settled(new.join(seen[back].select("pair", *NODE), ["pair", *NODE], "left_anti"))
            if fronts[back].isEmpty():
                break
            seen[back] = seen[back].unionByName(fronts[back])
        halves = fronts[0].join(fronts[1].withColumnRenamed("path", "rest"), ["pair", *NODE])
        whole = halves.groupBy("pair").agg(F.min(F.concat("path", F.slice("rest", F.lit(2), F.size("rest")))).alias("path"))
        whole = settled(whole.select("pair", F.lit(hops).alias("hops"), "path"))
        reached = whole if reached is None else reached.unionByName(whole)
    return reached


def joined_halves(front: DataFrame, other: DataFrame, steps: DataFrame, back: int, by_owner: bool) -> DataFrame:
    """(pair, path): the first of the paths over one more step of ``front``, the end's half where ``back``, that meet the ``other`` half.

    Paths are told by their rank among those of a pair, so the many nodes of this step carry a number each and no path; only
    those met get their paths.
    """
    w = Window.partitionBy("pair").orderBy("path")
    ranked = settled(front.withColumn("rank", F.row_number().over(w)))
    there = other.select("pair", F.lit(None).cast("int").alias("rank"), "node_kind", F.array("node_id").alias("ids"), F.lit(1).alias("there"))
    near = met_lists(ranked, steps, "pair", "rank").withColumn("there", F.lit(None).cast("int"))
    both = opened(near.unionByName(there), "pair", by_owner).groupBy("pair", *NODE).agg(F.min("rank").alias("rank"), F.max("there").alias("there"))
    met = settled(both.where("rank is not null and there is not null and node_id is not null").drop("there"))
    met = met.join(other.withColumnRenamed("path", "rest"), ["pair", *NODE]).join(ranked.select("pair", "rank", "path"), ["pair", "rank"])
    whole = F.concat("rest", "path") if back else F.concat("path", "rest")
    return settled(met.groupBy("pair").agg(F.min(whole).alias("path")))


def trace_paths(edges: DataFrame, symbols: DataFrame, asked: DataFrame, max_hops: int) -> DataFrame:
    """(pair, from_id, to_id, hops, path) of (pair, from_name, to_name): the first symbol of either name and a shortest path between them, nulls where there is none."""
    first = symbols.groupBy("name").agg(F.min("symbol_id").alias("id"))
    ends = asked.join(first.withColumnRenamed("id", "from_id"), F.col("from_name") == F.col("name"), "left").drop("name")
    ends = ends.join(first.withColumnRenamed("id", "to_id"), F.col("to_name") == F.col("name"), "left").select("pair", "from_id", "to_id")
    whole = ends.where("from_id is not null and to_id is not null")
    pairs = whole.select("pair", F.lit("symbol").alias("from_kind"), "from_id", F.lit("symbol").alias("to_kind"), "to_id")
    return settled(ends.join(shortest_paths(edges, pairs, max_hops), "pair", "left"))


def trace_hops(paths: DataFrame, edges: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(pair, hop, from_label, to_label, from_file, to_file, edge_kind, resolution, line, confidence): a row a step of each path.

    Of several edges between two nodes the first resolved one by kind stands for the step.
    """
    steps = paths.where("hops > 0").select("pair", F.explode(F.sequence(F.lit(0), F.col("hops") - 1)).alias("hop"), "path")
    end = lambda at, side: [F.split_part(F.col("path")[at], F.lit(":"), F.lit(1)).alias(f"{side}_kind"), F.split_part(F.col("path")[at], F.lit(":"), F.lit(2)).cast("bigint").alias(f"{side}_id")]
    steps = steps.select("pair", "hop", *end(F.col("hop"), "from"), *end(F.col("hop") + 1, "to"))
    key = ["from_kind", "from_id", "to_kind", "to_id"]
    best = edges.join(steps.select(*key).distinct(), key).groupBy(*key).agg(F.min(F.struct((F.col("resolution") != "resolved").alias("weak"), "kind", "resolution", "line")).alias("e"))
    named = symbols.join(files.select("file_id", "rel_path"), "file_id", "left")
    own = named.select(F.lit("symbol").alias("kind"), F.col("symbol_id").alias("id"), F.col("qualified_name").alias("label"), F.col("rel_path").alias("file"))
    own = own.unionByName(files.select(F.lit("file").alias("kind"), F.col("file_id").alias("id"), F.col("rel_path").alias("label"), F.col("rel_path").alias("file")))
    out = steps.join(best, key)
    for side in ("from", "to"):
        told = own.select(F.col("kind").alias(f"{side}_kind"), F.col("id").alias(f"{side}_id"), F.col("label").alias(f"{side}_label"), F.col("file").alias(f"{side}_file"))
        out = out.join(told, [f"{side}_kind", f"{side}_id"], "left").withColumn(f"{side}_label", F.coalesce(f"{side}_label", F.concat_ws(":", f"{side}_kind", f"{side}_id")))
    confidence = F.when(F.col("e.resolution") == "resolved", "grounded").otherwise("partial")
    return out.select("pair", "hop", "from_label", "to_label", "from_file", "to_file", F.col("e.kind").alias("edge_kind"), F.col("e.resolution").alias("resolution"), F.col("e.line").alias("line"), confidence.alias("confidence"))


def trace_states(paths: DataFrame, hops: DataFrame) -> DataFrame:
    """(pair, answer_state, stop_reason, hop_count): partial with an unresolved step, insufficient without both ends or a path."""
    weak = hops.groupBy("pair").agg(F.count_if(F.col("confidence") == "partial").alias("weak"))
    ends = F.col("from_id").isNotNull() & F.col("to_id").isNotNull()
    state = F.when(~ends | F.col("hops").isNull(), "insufficient").when(F.col("weak") > 0, "partial").otherwise("grounded")
    stop = F.when(~ends, "missing_endpoint").when(F.col("hops").isNull(), "path_not_found")
    return paths.join(weak, "pair", "left").select("pair", state.alias("answer_state"), stop.alias("stop_reason"), F.coalesce("hops", F.lit(0)).alias("hop_count"))


def direct_edges(edges: DataFrame, symbols: DataFrame, nodes: DataFrame, limit: int, direction: str = "outgoing") -> DataFrame:
    """Of each (node_kind, node_id) its stored edges in order, then the synthetic ones with the symbols or file that belong to it, up to the limit.

    Columns: node_kind, node_id, seq, kind, other_kind, other_id, resolution.  Nodes of
    other kinds than file and symbol have none.
    """
    near, far = ("from", "to") if direction == "outgoing" else ("to", "from")
    stored = edges.select(F.col(f"{near}_kind").alias("node_kind"), F.col(f"{near}_id").alias("node_id"), F.lit(0).alias("late"), "kind", F.col(f"{far}_kind").alias("other_kind"), F.col(f"{far}_id").alias("other_id"), "resolution")
    own = lambda here, there, kind: symbols.select(F.lit(here).alias("node_kind"), F.col(f"{here}_id").alias("node_id"), F.lit(1).alias("late"), F.lit(kind).alias("kind"), F.lit(there).alias("other_kind"), F.col(f"{there}_id").alias("other_id"), F.lit("resolved").alias("resolution"))
    kinds = ("contains", "definition") if direction == "outgoing" else ("definition", "contains")
    every = stored.unionByName(own("file", "symbol", kinds[0])).unionByName(own("symbol", "file", kinds[1]))
    met = every.join(nodes.select(*NODE).where(F.col("node_kind").isin("file", "symbol")).distinct(), NODE)
    w = Window.partitionBy(*NODE).orderBy("late", "kind", "other_kind", "other_id")
    return met.withColumn("seq", F.row_number().over(w)).where(F.col("seq") <= limit).drop("late")


def neighbours(edges: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """Of each node: outgoing and incoming edges up to the limit, and whether either reached it."""
    out = nodes.join(edges, (F.col("node_kind") == F.col("from_kind")) & (F.col("node_id") == F.col("from_id")), "left").groupBy(*NODE).agg(F.count("kind").alias("n_out"))
    into = nodes.join(edges, (F.col("node_kind") == F.col("to_kind")) & (F.col("node_id") == F.col("to_id")), "left").groupBy(*NODE).agg(F.count("kind").alias("n_in"))
    both = out.join(into, NODE)
    return both.select(*NODE, F.least("n_out", F.lit(limit)).alias("n_out"), F.least("n_in", F.lit(limit)).alias("n_in"), ((F.col("n_out") >= limit) | (F.col("n_in") >= limit)).alias("truncated"))


def call_closure(edges: DataFrame, seeds: DataFrame, max_depth: int, direction: str) -> DataFrame:
    """Callers (incoming) or callees (outgoing) of each seed over ``calls`` edges, the seed left out."""
    return frontier(edges.where("kind = 'calls'"), seeds, max_depth, direction).where("depth > 0")


def entry_points(callers: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Callers that are API routes, command-line commands or event handlers, by path and name."""
    named = callers.join(symbols.select(F.col("symbol_id").alias("node_id"), "file_id", "qualified_name", "name"), "node_id").join(files.select("file_id", "rel_path"), "file_id")
    kind = (
        F.when(F.col("rel_path").contains("api/") | F.col("rel_path").contains("routes/"), "api_route")
        .when(F.col("name").startswith("cli_") | F.col("name").endswith("_cmd"), "cli_command")
        .when(F.col("name").endswith("_handler"), "event_handler")
    )
    return named.withColumn("entry_kind", kind).where("entry_kind is not null")


def impact(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Members of the undirected neighbourhood: direct up to one hop (the seed too), else transitive at distance 2."""
    return frontier(edges, seeds, hops, "both").withColumn("category", F.when(F.col("depth") <= 1, "direct").otherwise("transitive")).withColumn("distance", F.when(F.col("depth") <= 1, 1).otherwise(2))


def dependents(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, file_id): importers of files, and files of symbols that reference the symbols; ``targets`` has (node_kind, node_id)."""
    into = targets.join(edges, (F.col("node_kind") == F.col("to_kind")) & (F.col("node_id") == F.col("to_id")))
    return into.where(((F.col("node_kind") == "file") & F.col("kind").isin("imports", "re_exports")) | ((F.col("node_kind") == "symbol") & (F.col("kind") == "references"))).select(*NODE, "from_kind", "from_id").distinct()


def dependencies(edges: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Outgoing imports of files with the label of what they reach."""
    out = edges.where("kind in ('imports', 're_exports') and from_kind = 'file'")
    f = files.select(F.col("file_id").alias("to_id"), F.col("rel_path").alias("path"), F.lit("file").alias("to_kind"))
    s = symbols.select(F.col("symbol_id").alias("to_id"), F.col("qualified_name").alias("qname"), F.lit("symbol").alias("to_kind"))
    return out.join(f, ["to_kind", "to_id"], "left").join(s, ["to_kind", "to_id"], "left").withColumn("label", F.coalesce("path", "qname", "resolution"))


def references(edges: DataFrame, symbols: DataFrame, files: DataFrame, include_tests: bool = False) -> DataFrame:
    """Incoming references of every symbol with the symbol and file that they come from."""
    source = symbols.select(F.col("symbol_id").alias("from_id"), "file_id", F.col("qualified_name").alias("from_name")).join(files.select("file_id", "rel_path"), "file_id")
    out = edges.where("kind = 'references'").join(source, "from_id")
    return out if include_tests else out.where(~F.lower("rel_path").contains("test"))


def expand_results(results: DataFrame, edges: DataFrame, symbols: DataFrame, top: int = 5, each: int = 2, score: float = 0.62) -> DataFrame:
    """The best results' files, their first outgoing edges, and the files these reach with their first symbol."""
    best = results.orderBy(F.desc("score"), "file_id").limit(top).select("file_id")
    w = Window.partitionBy("from_id").orderBy("kind", "to_id")
    out = best.join(edges.where("from_kind = 'file' and to_kind = 'file'"), F.col("file_id") == F.col("from_id")).withColumn("k", F.row_number().over(w)).where(F.col("k") <= each)
    first = symbols.groupBy(F.col("file_id").alias("to_id")).agg(F.min("symbol_id").alias("symbol_id"))
    return out.join(first, "to_id", "left").select(F.col("to_id").alias("file_id"), "symbol_id", F.lit(score).alias("score")).distinct()


def layers(items: DataFrame, needs: DataFrame) -> DataFrame:
    """(item, layer): items by the layer in which all that they need is done; null for cycles and missing needs.

    ``items`` has (item), ``needs`` (item, needs).
    """
    left, done, k = settled(items.select("item").distinct()), None, 0
    pending = settled(needs.select("item", "needs").distinct())
    while True:
        ready = settled(left.join(pending, "item", "left_anti").withColumn("layer", F.lit(k)))
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        if k % REWRITE == REWRITE - 1:
            done = settled(done)
        left = settled(left.join(ready, "item", "left_anti"))
        pending = settled(pending.join(ready.select(F.col("item").alias("needs")), "needs", "left_anti"))
        k += 1
    rest = left.withColumn("layer", F.lit(None).cast("int"))
    return rest if done is None else done.unionByName(rest)


def planned(items: DataFrame, needs: DataFrame) -> DataFrame:
    """(item, state, reason, layer, batch) of pending items: ready, waiting or blocked, the layer in which they can run, and what runs together there.

    ``items`` has (item, status, parallel, batch), ``needs`` (item, needs).  Needs that are done, under way or blocked hold
    nothing up; a need that is no item blocks (``missing_need``), and so does a cycle (``cycle``).  Items of a layer that may run
    in parallel run with those of their batch, or alone without one; all others run alone.
    """
    pending = items.where("status = 'pending'")
    own = needs.select("item", "needs").distinct().join(pending.select("item"), "item", "left_semi")
    lost = settled(own.join(items.select(F.col("item").alias("needs")), "needs", "left_anti").select("item").distinct())
    able = settled(pending.join(lost, "item", "left_anti"))
    open_ = own.join(able.select("item"), "item", "left_semi").join(able.select(F.col("item").alias("needs")), "needs", "left_semi")
    placed = layers(able.select("item"), open_)
    batch = F.when(F.col("parallel"), F.coalesce("batch", F.concat(F.lit("solo:"), "item"))).otherwise(F.concat(F.lit("serial:"), "item"))
    free = able.withColumn("batch", batch).select("item", "batch").join(placed, "item")
    state = F.when(F.col("layer").isNull(), "blocked").when(F.col("layer") == 0, "ready").otherwise("waiting")
    out = free.select("item", state.alias("state"), F.when(F.col("layer").isNull(), "cycle").alias("reason"), "layer", F.when(F.col("layer").isNotNull(), F.col("batch")).alias("batch"))
    none = F.lit(None)
    return out.unionByName(lost.select("item", F.lit("blocked").alias("state"), F.lit("missing_need").alias("reason"), none.cast("int").alias("layer"), none.cast("string").alias("batch")))
