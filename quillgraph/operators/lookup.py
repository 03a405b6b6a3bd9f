"""Symbol, path and log lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import is_test_path

CURRENT = ["refreshed_current", "retained_current"]


def by_keys(rows: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by whole keys (an id, a path, a root and a path) for a batch of questions (question_id and the keys); null where there is none."""
    return asked.join(rows, keys, "left")


def find_symbols(symbols: DataFrame, name: str, limit: int) -> DataFrame:
    """Symbols of that name or qualified name; exported first, then by id."""
    return symbols.where((F.col("name") == name) | (F.col("qualified_name") == name)).orderBy(F.desc("exported"), "symbol_id").limit(limit)


def refine_symbols(found: DataFrame, files: DataFrame, kinds: list[str] | None = None, path_hint: str | None = None, name_hint: str | None = None) -> DataFrame:
    """Refinements that apply after the limit, so fewer rows may come than there are."""
    out = found.join(files.select("file_id", "rel_path"), "file_id")
    if kinds is not None:
        out = out.where(F.col("kind").isin(kinds) if kinds else F.lit(False))
    if path_hint:
        out = out.where(F.lower("rel_path").contains(path_hint.lower()))
    if name_hint:
        out = out.where(F.lower("qualified_name").contains(name_hint.lower()))
    return out


def goto_definition(symbols: DataFrame, files: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The first of the eight best symbols, in the file of that path (apart from case) if one is given."""
    found = find_symbols(symbols, name, 8).join(files.select("file_id", "rel_path"), "file_id")
    if path is not None:
        found = found.where(F.lower("rel_path") == path.lower())
    return found.orderBy(F.desc("exported"), "symbol_id").limit(1)


def find_paths(files: DataFrame, part: str, limit: int = 20) -> DataFrame:
    return files.where(F.lower("rel_path").contains(part.lower())).orderBy("rel_path", "file_id").limit(min(limit, 20)).withColumn("score", F.lit(0.9))


def without_tests(rows: DataFrame, include: bool = False) -> DataFrame:
    return rows if include else rows.where(~is_test_path(F.col("rel_path")))


def is_current(state: Column) -> Column:
    return state.isin(CURRENT)


def by_seed(rows: DataFrame, text: str, terms: list[str], order: str, prefix: bool, top: float, step: float, most: int = 8) -> DataFrame:
    """The first rows, in input order, whose text contains (or begins with) a term; scores fall with the place."""
    low = F.lower(text)
    hit = reduce(lambda a, b: a | b, [low.startswith(t) if prefix else low.contains(t) for t in terms], F.lit(False))
    found = rows.where(hit).orderBy(order).limit(most)
    place = F.row_number().over(Window.orderBy(order)) - 1
    return found.withColumn("score", F.round(F.lit(top) - F.lit(step) * place, 6))


def seed_files(files: DataFrame, terms: list[str], most: int = 8, fallback: int = 5) -> DataFrame:
    """Files whose path has a term, or else the first few."""
    low = F.lower("rel_path")
    hit = reduce(lambda a, b: a | b, [low.contains(t) for t in terms], F.lit(False))
    marked = files.withColumn("hit", hit).orderBy(F.desc("hit"), "file_id").limit(most)
    place = F.row_number().over(Window.orderBy(F.desc("hit"), "file_id"))
    any_hit = F.max(F.col("hit")).over(Window.partitionBy())
    kept = marked.withColumn("place", place).withColumn("any_hit", any_hit).where(F.col("hit") | (~F.col("any_hit") & (F.col("place") <= fallback)))
    return kept.withColumn("score", F.round(F.greatest(F.lit(0.3), 0.95 - 0.08 * (F.col("place") - 1)), 6)).drop("place", "any_hit", "hit")


def audit_filter(rows: DataFrame, session: int | None = None, role: str | None = None, envelope: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows that meet every condition that is given; timestamps are compared as text."""
    asked = [("session_id", session), ("role", role), ("envelope_id", envelope)]
    conditions = [F.col(c) == v for c, v in asked if v is not None]
    conditions += [F.col("timestamp") >= since] * (since is not None) + [F.col("timestamp") <= until] * (until is not None)
    return rows.where(reduce(lambda a, b: a & b, conditions)) if conditions else rows


def audit_limit(asked: int | None, usual: int = 25, most: int = 100) -> int:
    return usual if not asked or asked <= 0 else min(asked, most)


def in_window(rows: DataFrame, since: str | None = None, until: str | None = None, column: str = "timestamp") -> DataFrame:
    """Rows of a valid time inside the bounds, both included."""
    at = F.try_to_timestamp(F.col(column))
    out = rows.where(at.isNotNull())
    if since is not None:
        out = out.where(at >= F.to_timestamp(F.lit(since)))
    return out if until is None else out.where(at <= F.to_timestamp(F.lit(until)))


def of_kinds(edges: DataFrame, kinds: list[str] | None) -> DataFrame:
    """Edges of the kinds; None: all, an empty list: none; ``call`` also means ``calls``."""
    if kinds is None:
        return edges
    wanted = sorted({*kinds, *(["calls"] if "call" in kinds else [])})
    return edges.where(F.col("kind").isin(wanted) if wanted else F.lit(False))
