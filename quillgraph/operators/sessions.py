"""Sessions: audit snapshots, timelines, compaction, export, fork, diffs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import redacted


def timeline(parts: list[DataFrame], limit: int) -> DataFrame:
    """All kinds together, latest first; ties by kind and id."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.desc("timestamp"), "kind", "id").limit(limit)


def audit_snapshot(parts: dict[str, DataFrame], domains: dict[tuple[str, str], list[str]], limit: int) -> DataFrame:
    """(measure, value, n): the sizes of the latest ``limit`` rows of each kind, and how often each value of a domain occurs among them, zero included.

    ``parts`` has rows (id, timestamp, ...) by kind, ``domains`` the values by kind and column.
    """
    spark = next(iter(parts.values())).sparkSession
    latest = {k: rows.orderBy(F.desc("timestamp"), "id").limit(limit) for k, rows in parts.items()}
    out = None
    for kind, rows in latest.items():
        size = rows.agg(F.lit("size").alias("measure"), F.lit(kind).alias("value"), F.count("*").alias("n"))
        out = size if out is None else out.unionByName(size)
    for (kind, column), values in domains.items():
        known = spark.createDataFrame([(x,) for x in values], "value string")
        counts = latest[kind].groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
        out = out.unionByName(known.join(counts, "value", "left").select(F.lit(f"{kind}.{column}").alias("measure"), "value", F.coalesce("n", F.lit(0)).alias("n")))
    return out


def shown(sessions: DataFrame, parts: dict[str, DataFrame], summaries: DataFrame) -> DataFrame:
    """Counts of each part and the latest summary (updated, text) of every session."""
    last = summaries.groupBy("session_id").agg(F.max_by("text", F.struct("updated", "text")).alias("summary"))
    return session_counts(sessions, parts).join(last, "session_id", "left")


def session_counts(sessions: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """One row a session with how many rows of each part it has."""
    out = sessions.select("session_id").distinct()
    for name, rows in parts.items():
        out = out.join(rows.groupBy("session_id").agg(F.count("*").alias(name)), "session_id", "left")
    return out.fillna(0, list(parts))


def compacted(entries: DataFrame, most: int = 12, max_bytes: int = 24_000, events: DataFrame | None = None, most_events: int = 64) -> DataFrame:
    """One row a session (session_id, seq, line): whether its summary overflows, the tail that stays, the first blockers.

    Of ``events`` (session_id, seq, event) the last ``most_events`` add their bytes as JSON.
    """
    if events is not None:
        latest = events.withColumn("__k", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("seq")))).where(F.col("__k") <= most_events)
        extra = latest.groupBy("session_id").agg(F.sum(F.octet_length(F.to_json(F.struct("seq", "event")))).alias("__extra"))
        base = compacted(entries, most, 2**62)
        bytes_ = entries.groupBy("session_id").agg(F.sum(F.octet_length("line")).alias("__bytes"))
        both = base.join(bytes_, "session_id").join(extra, "session_id", "left")
        over = (F.col("entries") > most) | (F.col("__bytes") + F.coalesce("__extra", F.lit(0)) > max_bytes)
        keep = max(4, most // 2)
        dropped = F.when(over, F.greatest(F.col("entries") - keep, F.lit(0))).otherwise(0)
        return both.withColumn("overflow", over).withColumn("dropped", dropped).select(*base.columns)
    last = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    numbered = entries.withColumn("from_end", F.row_number().over(last))
    keep = max(4, most // 2)
    listed = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["line"])
    item = F.struct("seq", "line")
    out = numbered.groupBy("session_id").agg(
        F.count("*").alias("entries"),
        F.sum(F.octet_length("line")).alias("bytes"),
        listed(F.when(F.col("from_end") <= keep, item)).alias("tail"),
        F.slice(listed(F.when(F.lower("line").contains("blocker"), item)), 1, 8).alias("blockers"),
    )
    overflow = (F.col("entries") > most) | (F.col("bytes") > max_bytes)
    return out.select("session_id", "entries", overflow.alias("overflow"), F.when(overflow, F.greatest(F.col("entries") - keep, F.lit(0))).otherwise(0).alias("dropped"), "tail", "blockers")


def exported(messages: DataFrame, roots: list[str], size: int = 1000) -> DataFrame:
    """Nested documents of each session, numbered parts of at most ``size`` messages, values redacted; ``messages`` has (session_id, seq, key, value)."""
    clean = messages.withColumn("value", redacted(F.col("key"), F.col("value"), roots))
    order = Window.partitionBy("session_id").orderBy("seq", "key")
    placed = clean.withColumn("part", F.floor((F.row_number().over(order) - 1) / size).cast("int"))
    return placed.groupBy("session_id", "part").agg(F.array_sort(F.collect_list(F.struct("seq", "key", "value"))).alias("messages"))


def imported(documents: DataFrame) -> DataFrame:
    return documents.select("session_id", F.explode("messages").alias("m")).select("session_id", "m.*")


def forked(messages: DataFrame, session_id: str, new_id: str) -> DataFrame:
    """A session's rows under another id, mentions of the old id in its values included, but not of longer ids that contain it."""
    own = messages.where(F.col("session_id") == session_id)
    whole = r"(?<![\w-])" + re.escape(session_id) + r"(?![\w-])"
    return own.withColumn("session_id", F.lit(new_id)).withColumn("value", F.regexp_replace("value", whole, F.lit(new_id.replace("\\", "\\\\").replace("$", "\\$"))))


def without_session(messages: DataFrame, session_id: str) -> DataFrame:
    return messages.where(F.col("session_id") != session_id)


def line_diff(before: Column, after: Column) -> tuple[Column, Column]:
    """(additions, deletions) of lines between the common head and tail of two texts."""
    a, b = F.split(before, "\n"), F.split(after, "\n")
    least = F.least(F.size(a), F.size(b))
    # the first place where they differ, from either end
    first = F.coalesce(F.array_position(F.zip_with(F.slice(a, 1, least), F.slice(b, 1, least), lambda p, q: p == q), False), F.lit(0)).cast("int")
    head = F.when(first == 0, least).otherwise(first - 1)
    ra, rb = F.slice(F.reverse(a), F.lit(1), least - head), F.slice(F.reverse(b), F.lit(1), least - head)
    last = F.array_position(F.zip_with(ra, rb, lambda p, q: p == q), False).cast("int")
    tail = F.when(least - head == 0, 0).when(last == 0, least - head).otherwise(last - 1)
    return F.size(b) - head - tail, F.size(a) - head - tail


def gate_counts(rows: DataFrame, column: str = "status") -> DataFrame:
    states = ["pass", "fail", "not_run", "unavailable", "not_configured"]
    return rows.agg(*[F.count_if(F.col(column) == s).alias(s) for s in states])


def first_block(decisions: DataFrame) -> DataFrame:
    """Of each pipeline (run_id, seq, hook, decision): the first hook that blocks, and how many ran until then."""
    blocked = F.when(F.col("decision") == "block", F.col("seq"))
    out = decisions.groupBy("run_id").agg(F.min(blocked).alias("at"), F.max("seq").alias("last"), F.min_by("hook", F.when(F.col("decision") == "block", F.col("seq"))).alias("hook"))
    return out.select("run_id", F.when(F.col("at").isNotNull(), "block").otherwise("allow").alias("decision"), F.when(F.col("at").isNotNull(), F.col("hook")).alias("hook"), F.coalesce("at", "last").alias("ran"))


def valid_steps(history: DataFrame, stages: list[str]) -> DataFrame:
    """Stage rows (session_id, seq, stage, gate): whether each follows the one before it and its gate passed."""
    place = F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))
    before = F.lag(place).over(Window.partitionBy("session_id").orderBy("seq"))
    ok = F.when(before.isNull(), place == 1).otherwise((place == before + 1) & F.lag("gate").over(Window.partitionBy("session_id").orderBy("seq")).isin("pass", "waived"))
    return history.withColumn("valid", ok)


def combined_diffs(rows: DataFrame, by: str = "session_id") -> DataFrame:
    """Different paths and summed lines of each session's diffs (path, additions, deletions)."""
    return rows.groupBy(by).agg(F.count_distinct("path").alias("files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
