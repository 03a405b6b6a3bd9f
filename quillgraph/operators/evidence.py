"""Evidence packets: candidates, dedupe, caps, hybrid scores, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import snippet
from quillgraph.storage import dealt

# Weight of each source of evidence, and the extra for grounded rows.
WEIGHTS = [("graph", 0.40), ("query", 0.40), ("storage", 0.35), ("semantic", 0.25)]
GROUNDED_EXTRA = 0.10

# Budgets (usual, most).
BUDGETS = {"files": (5, 20), "symbols": (8, 32), "snippets": (8, 32)}

def budget(name: str, asked: int | None = None) -> int:
    usual, most = BUDGETS[name]
    return min(asked if asked and asked > 0 else usual, most)


def hybrid_score(source: Column, score: Column, confidence: Column) -> Column:
    weight = F
    for name, w in WEIGHTS:
        weight = weight.when(source == name, w)
    return F.round(F.coalesce(weight.otherwise(0.0), F.lit(0.0)) * score + F.when(confidence == "grounded", GROUNDED_EXTRA).otherwise(0.0), 6)


def capped(candidates: DataFrame, key: list[str], order: list, most: int, by: str = "question_id") -> DataFrame:
    """The first row of each key, then the first ``most`` of a question, all by ``order``: rows beyond are never considered."""
    once = Window.partitionBy(by, *key).orderBy(*order)
    rows = candidates.withColumn("__k", F.row_number().over(once)).where("__k = 1")
    first = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("__k", F.row_number().over(first)).where(F.col("__k") <= most).withColumnRenamed("__k", "seq")


def ranked(rows: DataFrame, by: str = "question_id") -> DataFrame:
    """Rows with hybrid score and rank; ties by insertion."""
    scored = rows.withColumn("hybrid", hybrid_score(F.col("source"), F.col("score"), F.col("confidence")))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("hybrid"), "seq")))


def verdicts(questions: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """(question_id, state, n): unsupported, insufficient, partial or grounded."""
    counted = rows.groupBy("question_id").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") != "grounded").alias("weak"))
    out = questions.select("question_id", "unsupported").join(counted, "question_id", "left").fillna(0, ["n", "weak"])
    state = F.when(F.col("unsupported").isNotNull(), "unsupported").when(F.col("n") == 0, "insufficient").when((F.col("weak") > 0) | (F.col("n") >= most), "partial").otherwise("grounded")
    return out.select("question_id", state.alias("state"), "n")


def packets(questions: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """One nested packet a question: state, evidence by rank, gaps."""
    entry = F.struct("rank", "source", "file_id", "hybrid", snippet(F.col("content")).alias("snippet"))
    listed = rows.groupBy("question_id").agg(F.array_sort(F.collect_list(entry)).alias("evidence"))
    out = verdicts(questions, rows, most).join(listed, "question_id", "left")
    gaps = F.when(F.col("state") == "insufficient", F.array(F.lit("no evidence"))).when(F.col("n") >= most, F.array(F.lit("limit reached"))).otherwise(F.array().cast("array<string>"))
    return out.select("question_id", F.col("state").alias("answer_state"), F.coalesce("evidence", F.array().cast("array<struct<rank:int,source:string,file_id:bigint,hybrid:double,snippet:string>>")).alias("evidence"), gaps.alias("gaps"))


def search_entries(hits: DataFrame, mode: str, most: int = 20) -> DataFrame:
    """The first ``most`` hits (question_id, rank, score, ...) of each question as evidence: symbols are definitions, grounded from 0.9 on; other modes give chunks, never grounded."""
    symbol = mode == "symbol"
    confidence = F.when(F.lit(symbol) & (F.col("score") >= 0.9), "grounded").otherwise("partial")
    kind, source = ("definition", "storage") if symbol else ("chunk", "query")
    return hits.where(F.col("rank") <= most).withColumns({"kind": F.lit(kind), "source": F.lit(source), "confidence": confidence})


def search_states(questions: DataFrame, entries: DataFrame, mode: str) -> DataFrame:
    """(question_id, answer_state, entries, gap): insufficient without a hit; only searches for symbols can be grounded, and only if every entry is."""
    counted = entries.groupBy("question_id").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") != "grounded").alias("weak"))
    out = questions.select("question_id").join(counted, "question_id", "left").fillna(0, ["n", "weak"])
    state = F.when(F.col("n") == 0, "insufficient").when(F.lit(mode != "symbol") | (F.col("weak") > 0), "partial").otherwise("grounded")
    gap = F.when(F.col("n") == 0, "no_matches").when(F.lit(mode != "symbol"), "retrieval_only").when(F.col("weak") > 0, "lower_confidence")
    return out.select("question_id", state.alias("answer_state"), F.col("n").alias("entries"), gap.alias("gap"))


def target_candidates(targets: DataFrame, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """(question_id, target_seq, source_seq, row_seq, source, key, score, confidence): what each source has for each target, in the order of both.

    ``targets`` has (question_id, target_seq, target); a source is a name and rows of
    (target, row_seq, key, score, confidence).
    """
    out = None
    for at, (name, rows) in enumerate(sources):
        own = targets.join(rows, "target").select("question_id", "target_seq", F.lit(at).alias("source_seq"), "row_seq", F.lit(name).alias("source"), "key", "score", "confidence")
        out = own if out is None else out.unionByName(own)
    return out


def built(questions: DataFrame, candidates: DataFrame, files: int, snippets: int) -> tuple[DataFrame, DataFrame]:
    """Ranked evidence and a verdict for each (question_id, intent, unsupported, targets): guards first, then dedupe by key, the cap of files times snippets, and the hybrid order.

    A question without targets is insufficient; intents other than ``explain``, and
    unsupported classes, are unsupported; none of these gets evidence.
    """
    asks = questions.where((F.col("targets") > 0) & (F.col("intent") == "explain") & F.col("unsupported").isNull()).select("question_id")
    most = files * snippets
    # a target that many ask is one key of the join before this: its rows leave that task unsorted
    rows = ranked(capped(dealt(candidates, "question_id").join(asks, "question_id", "left_semi"), ["key"], ["target_seq", "source_seq", "row_seq"], most))
    counted = rows.groupBy("question_id").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") != "grounded").alias("weak"))
    return rows, told(questions, counted, most)


def told(questions: DataFrame, counted: DataFrame, most: int | None = None) -> DataFrame:
    """(question_id, answer_state, evidence) of each (question_id, intent, unsupported, targets) by how much evidence it has, ``n``, and how much of that is ``weak``; a budget ``most`` that is reached makes it partial."""
    out = questions.join(counted, "question_id", "left").fillna(0, ["n", "weak"])
    part = F.col("weak") > 0
    state = (
        F.when(F.col("targets") == 0, "insufficient")
        .when((F.col("intent") != "explain") | F.col("unsupported").isNotNull(), "unsupported")
        .when(F.col("n") == 0, "insufficient")
        .when(part if most is None else part | (F.col("n") >= most), "partial")
        .otherwise("grounded")
    )
    return out.select("question_id", state.alias("answer_state"), F.col("n").alias("evidence"))


def judged(questions: DataFrame, targets: DataFrame, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """The verdicts of ``built`` without a budget: all that the sources have for the targets counts, each key of a question once.

    Keys that only one target has are counted by target before questions come in, so many questions for a target with
    many candidates make no row for each two of them; keys that several targets share are met with the questions.
    """
    asks = questions.where((F.col("targets") > 0) & (F.col("intent") == "explain") & F.col("unsupported").isNull()).select("question_id")
    asked = targets.join(asks, "question_id", "left_semi").groupBy("question_id", "target").agg(F.min("target_seq").alias("target_seq"))
    weak = (F.col("first.confidence") != "grounded").alias("weak")
    rows = None
    for at, (_, one) in enumerate(sources):
        own = one.where("target is not null").select("target", "key", F.struct(F.lit(at).alias("source_seq"), "row_seq", "confidence").alias("first"))
        rows = own if rows is None else rows.unionByName(own)
    first = rows.groupBy("target", "key").agg(F.min("first").alias("first"))
    # of a key that one target has, the least values are its only ones
    keys = first.groupBy("key").agg(F.count("*").alias("holders"), F.min("target").alias("target"), F.min("first").alias("first"))
    sizes = keys.where("holders = 1").groupBy("target").agg(F.count("*").alias("n"), F.count_if(weak).alias("weak"))
    several = keys.where("holders > 1").select(F.col("key").alias("k"))
    shared = first.join(several, F.col("key").eqNullSafe(F.col("k")), "left_semi")
    met = asked.join(shared, "target").groupBy("question_id", "key").agg(F.min(F.struct("target_seq", "first")).alias("f")).select("question_id", "f.first")
    counted = asked.join(sizes, "target").select("question_id", "n", "weak").unionByName(met.select("question_id", F.lit(1).cast("bigint").alias("n"), F.coalesce(weak.cast("bigint"), F.lit(0)).alias("weak")))
    return told(questions, counted.groupBy("question_id").agg(F.sum("n").alias("n"), F.sum("weak").alias("weak")))


def capability_matrix(spark) -> DataFrame:
    """(language, capability, state) for each language and capability."""
    rows = []
    for language in ("typescript", "tsx", "javascript", "jsx", "python", "go", "rust", "unknown"):
        for capability in ("parsing", "definitions", "references", "imports", "calls", "entry_points", "impact", "trace", "search", "embedding"):
            script = language in ("typescript", "tsx", "javascript", "jsx")
            if language == "unknown":
                state = "best_effort" if capability in ("search", "embedding") else "unsupported"
            elif capability == "trace":
                state = "unsupported"
            elif script:
                state = "supported"
            else:
                state = "supported" if capability in ("parsing", "definitions", "search", "embedding") else "partial"
            rows.append((language, capability, state))
    return spark.createDataFrame(rows, "language string, capability string, state string")


# What names a file in a question, and the entry that a mention makes.
MENTION = r"[A-Za-z0-9_.\-/]+\.[A-Za-z0-9]+"
MENTIONED = {"line_start": 1, "line_end": 80, "score": 1.0, "source": "file_mention"}


def file_mentions(questions: DataFrame, files: DataFrame) -> DataFrame:
    """(question_id, path, line_start, line_end, score, source, order) of files that a (question_id, question) names by their path, in the order of the words."""
    named = questions.select("question_id", F.posexplode(F.regexp_extract_all("question", F.lit(MENTION), F.lit(0))).alias("order", "word"))
    # one dot and one slash in front do not count
    named = named.withColumn("path", F.regexp_replace("word", r"^\.?/", ""))
    met = named.join(files.select(F.col("rel_path").alias("path")).distinct(), "path")
    return met.select("question_id", "path", *[F.lit(v).alias(k) for k, v in MENTIONED.items()], F.col("order").cast("long").alias("order"))


def ledger(candidates: DataFrame, mode: str, mentions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Entries of a mode's budget, and (question_id, entries, skipped, warnings): what the ledger lacks.

    Candidates have (question_id, path, line_start, line_end, source, score, order); mentions, as ``file_mentions`` gives them, come
    behind them.  The best scores go first, then the order, then the path; of entries with the same path, lines and source the
    first stays.  Modes: ``small`` 4 entries, ``usual`` 12, ``large`` 24.
    """
    most = {"small": 4, "usual": 12, "large": 24}[mode]
    columns = ["question_id", "path", "line_start", "line_end", "source", "score", "order"]
    rows = candidates.select(*columns, F.lit(0).alias("behind"))
    if mentions is not None:
        rows = rows.unionByName(mentions.select(*columns, F.lit(1).alias("behind")))
    rows = dealt(rows, "question_id")
    key = ["path", "line_start", "line_end", "source"]
    kept = capped(rows, key, [F.desc("score"), "behind", "order", "path"], most).drop("behind")
    all_ = rows.groupBy("question_id").agg(F.count_distinct(*key).alias("there"), F.count_distinct("source").alias("sources"), F.count_if(F.col("behind") == 0).alias("found"))
    have = kept.groupBy("question_id").agg(F.count("*").alias("entries"), F.count_distinct("source").alias("kept_sources"))
    both = all_.join(have, "question_id")
    warn = F.filter(F.array(F.when(F.col("there") > F.col("entries"), "budget_reached"), F.when(F.col("sources") > F.col("kept_sources"), "source_missing"), F.when(F.col("kept_sources") == 1, "single_source")), lambda x: x.isNotNull())
    return kept, both.select("question_id", "entries", F.greatest(F.col("found") - F.col("entries"), F.lit(0)).alias("skipped"), warn.alias("warnings"))


def routed(servers: DataFrame, lane: str, role: str, wanted: Column, capabilities: list[str], versions: list[str], most: int = 4) -> DataFrame:
    """Every server with its first reject reason, or its score and rank and whether it is among the best ``most``.

    ``servers`` has (server_id, version, entry, lanes, roles, capabilities, priority, tags).
    """
    need = F.array(*map(F.lit, capabilities)) if capabilities else F.array().cast("array<string>")
    reason = (
        F.when(~F.col("version").isin(versions), "contract_version_mismatch")
        .when(F.coalesce("entry", F.lit("")) == "", "entry_missing")
        .when(~F.array_contains("lanes", lane), "lane_mismatch")
        .when(~F.array_contains("roles", role), "role_mismatch")
        .when(F.size(F.array_except(need, "capabilities")) > 0, "capability_denied")
    )
    score = F.when(reason.isNull(), F.col("priority") + F.when(F.arrays_overlap("tags", wanted), 20).otherwise(-25))
    told = servers.select("server_id", reason.alias("reason"), score.alias("score"))
    # servers are a registry: a few rows
    rank = F.row_number().over(Window.partitionBy(F.col("reason").isNull()).orderBy(F.desc("score"), "server_id"))
    return told.withColumn("rank", F.when(F.col("reason").isNull(), rank)).withColumn("selected", F.coalesce(F.col("rank") <= most, F.lit(False)))


def route(servers: DataFrame, wanted: Column, most: int = 4) -> DataFrame:
    """Eligible servers by score (priority, more with a wanted tag, less without), then id; the best ``most``.

    ``servers`` has (server_id, enabled, priority, tags).
    """
    score = F.col("priority") + F.when(F.arrays_overlap("tags", wanted), 20).otherwise(-25)
    return servers.where("enabled").withColumn("score", score).orderBy(F.desc("score"), "server_id").limit(most)
