"""JSON documents of any depth as rows: taken apart into (path, value), changed, and put together again.

Each level is one step over all documents: containers are exploded as VARIANT values until only
scalars are left, and containers are put together from the deepest level up.  A container's
elements are grouped by its own path, so a group is no larger than one container.

Defined results: text that is no JSON is null; empty containers are values; keys of objects
come in the order of VARIANT, by name; numbers, booleans and nulls stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillgraph.functions.text import redacted
from quillgraph.storage import settled

_STEP = "struct<key: string, pos: int>"


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    seen = Observation()
    return settled(df.observe(seen, F.count("*").alias("n"))), seen.get["n"]


def taken_apart(rows: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, text, string): the scalars and empty containers of each document; ``string`` only of strings, ``text`` as JSON."""
    spark, out = rows.sparkSession, None
    level, n = counted(rows.select(key, F.array().cast(f"array<{_STEP}>").alias("path"), F.try_parse_json(json).alias("v")).where("v is not null"))
    while n:
        kind, text = F.schema_of_variant("v"), F.to_json("v")
        holds = (kind.startswith("OBJECT") | kind.startswith("ARRAY")) & ~text.isin("{}", "[]")
        flat = level.where(~holds).select(key, "path", text.alias("text"), F.when(kind == "STRING", F.variant_get("v", "$", "string")).alias("string"))
        out = flat if out is None else out.unionByName(flat)
        inner = level.where(holds).lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("pos"), F.col("key").alias("__k"), F.col("value").alias("__v")))
        step = F.array(F.struct(F.col("__k").alias("key"), F.col("pos")).cast(_STEP))
        level, n = counted(inner.select(key, F.concat("path", step).alias("path"), F.col("__v").alias("v")))
    return out if out is not None else rows.where("false").select(key, F.array().cast(f"array<{_STEP}>").alias("path"), F.lit("").alias("text"), F.lit("").alias("string"))


def put_together(leaves: DataFrame, key: str) -> DataFrame:
    """(key, json) of (key, path, text) rows."""
    rest = settled(leaves.select(key, "path", "text"))
    depth = rest.agg(F.max(F.size("path"))).first()[0] or 0
    done = rest.where(F.size("path") == depth)
    for d in range(depth, 0, -1):
        last = F.element_at("path", -1)
        own = F.when(last["key"].isNotNull(), F.concat(quoted(last["key"]), F.lit(":"), "text")).otherwise(F.col("text"))
        one = done.select(key, F.slice("path", 1, d - 1).alias("path"), last["key"].isNotNull().alias("object"), F.struct(last["pos"].alias("pos"), own.alias("text")).alias("item"))
        put = one.groupBy(key, "path").agg(F.first("object").alias("object"), F.array_join(F.transform(F.array_sort(F.collect_list("item")), lambda x: x["text"]), ",").alias("inner"))
        text = F.when(F.col("object"), F.concat(F.lit("{"), "inner", F.lit("}"))).otherwise(F.concat(F.lit("["), "inner", F.lit("]")))
        done = put.select(key, "path", text.alias("text")).unionByName(rest.where(F.size("path") == d - 1))
        if d % 8 == 0:
            done = settled(done)
    return done.select(key, F.col("text").alias("json"))


def quoted(value: Column) -> Column:
    """A string as JSON text."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def name_of(path: Column) -> Column:
    """The nearest key above a value: elements of a list have the list's."""
    named = F.filter(path, lambda s: s["key"].isNotNull())
    return F.coalesce(F.try_element_at(named, F.lit(-1))["key"], F.lit(""))


def redacted_json(rows: DataFrame, roots: list[str], key: str = "id", json: str = "json") -> DataFrame:
    """(key, json): documents whose strings are redacted by the key above them and by themselves, at any depth."""
    leaves = taken_apart(rows, key, json)
    clean = F.when(F.col("string").isNull(), F.col("text")).otherwise(quoted(redacted(name_of(F.col("path")), F.col("string"), roots)))
    return put_together(leaves.withColumn("text", clean), key)


def renamed_ids(rows: DataFrame, names: DataFrame, key: str = "id", json: str = "json") -> DataFrame:
    """(key, json): documents in which every string that is a whole ``old`` name of (old, new) is the new one; longer strings that contain it stay."""
    leaves = taken_apart(rows, key, json)
    met = leaves.join(names.select(F.col("old").alias("string"), "new"), "string", "left")
    return put_together(met.withColumn("text", F.when(F.col("new").isNotNull(), quoted(F.col("new"))).otherwise(F.col("text"))), key)


def forked(sessions: DataFrame, events: DataFrame, summaries: DataFrame, checkpoints: DataFrame, reverts: DataFrame, forks: DataFrame) -> dict[str, DataFrame]:
    """The rows that forks (source, target) add to each table.

    Sessions (session_id, status, latest_summary_id, latest_checkpoint_id) begin anew, in progress and without latest rows; rows
    of the other tables (id, session_id, ...) come along with new ids, made of the old one and the fork; JSON payloads of
    events name the new session where they named the old one; reverts (checkpoint_id, previous_checkpoint_id)
    point at the copies of the checkpoints that were copied and else where they pointed.
    """
    both = forks.select(F.col("source").alias("session_id"), "target")

    def copied(table: DataFrame) -> DataFrame:
        fresh = F.concat("id", F.lit("@"), "target")
        return table.join(both, "session_id").select(F.col("id").alias("old_id"), fresh.alias("id"), F.col("target").alias("session_id"), *[c for c in table.columns if c not in ("id", "session_id")])

    nothing = F.lit(None).cast("string")
    begun = sessions.join(both, "session_id").select(F.col("target").alias("session_id"), F.lit("in_progress").alias("status"), nothing.alias("latest_summary_id"), nothing.alias("latest_checkpoint_id"))
    own = settled(copied(events))
    told = renamed_ids(own.select("id", "payload"), forks.select(F.col("source").alias("old"), F.col("target").alias("new")), "id", "payload")
    points = copied(checkpoints)
    new_of = points.select("session_id", F.col("old_id"), F.col("id").alias("new_id"))
    turned = copied(reverts)
    for column in ("checkpoint_id", "previous_checkpoint_id"):
        turned = turned.join(new_of.withColumnRenamed("old_id", column), ["session_id", column], "left").withColumn(column, F.coalesce("new_id", column)).drop("new_id")
    return {
        "sessions": begun,
        "events": own.select("id", "session_id").join(told, "id", "left").select("id", "session_id", F.col("json").alias("payload")),
        "summaries": copied(summaries).drop("old_id"),
        "checkpoints": points.drop("old_id"),
        "reverts": turned.select("id", "session_id", "checkpoint_id", "previous_checkpoint_id"),
    }
