"""From a question to the lazy DataFrame that answers it."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import graph, lookup

# Intents by words, in order, and the tools that each needs.
INTENTS = [
    ("trace_flow", r"\b(trace|flow|path from)\b"),
    ("impact_analysis", r"\b(impact|break|affect)\b"),
    ("bug_investigation", r"\b(bug|error|fail|crash|fix)\b"),
    ("find_references", r"\b(reference|usage|used by|who uses)\w*\b"),
    ("find_dependencies", r"\b(depend|import)\w*\b"),
    ("find_definition", r"\b(where is|define|definition|declared)\w*\b"),
    ("explain_module", r"\b(explain|module|how does)\b"),
]
FALLBACK = "broad_codebase_question"
TOOLS = {
    "trace_flow": ["trace"],
    "impact_analysis": ["references", "dependents"],
    "bug_investigation": ["search", "references"],
    "find_references": ["references"],
    "find_dependencies": ["dependencies", "dependents"],
    "find_definition": ["definition"],
    "explain_module": ["definition", "dependencies"],
    FALLBACK: ["search"],
}


def intent_of(question: Column) -> Column:
    low, out = F.lower(question), F
    for name, pattern in INTENTS:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise(FALLBACK)


def tools_of(intent: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in TOOLS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), intent)


@dataclass
class Tables:
    files: DataFrame
    symbols: DataFrame
    edges: DataFrame


def answer(question: str, t: Tables, limit: int = 20) -> DataFrame:
    """(kind, label, detail): what a question about one symbol or file asks for.

    The subject is the last word in backquotes or quotes, else the last word.
    """
    named = re.findall(r"[`'\"]([^`'\"]+)[`'\"]", question) or re.findall(r"[\w./-]+", question)
    subject = named[-1] if named else ""
    low = question.lower()
    intent = next((k for k, p in INTENTS if re.search(p, low)), FALLBACK)
    own = t.files.where(F.col("rel_path") == subject).select(F.lit("file").alias("node_kind"), F.col("file_id").alias("node_id"))
    symbol = lookup.find_symbols(t.symbols, subject, 1).select(F.lit("symbol").alias("node_kind"), F.col("symbol_id").alias("node_id"))
    target = own.unionByName(symbol)
    if intent == "find_dependencies" and "depend on" not in low and "dependents" not in low:
        deps = graph.dependencies(t.edges, t.files, t.symbols).join(own, F.col("from_id") == F.col("node_id"), "left_semi")
        return deps.select("kind", "label", F.col("resolution").alias("detail")).orderBy("label").limit(limit)
    if intent in ("find_dependencies", "impact_analysis"):
        found = graph.dependents(t.edges, target).select(F.col("from_kind").alias("node_kind"), F.col("from_id").alias("node_id"))
        return labelled(found, t, "dependent").limit(limit)
    if intent == "find_references":
        refs = graph.references(t.edges, t.symbols, t.files, True).join(symbol, F.col("to_id") == F.col("node_id"), "left_semi")
        return refs.select("kind", F.col("from_name").alias("label"), F.col("rel_path").alias("detail")).orderBy("label", "detail").limit(limit)
    found = lookup.goto_definition(t.symbols, t.files, subject)
    return found.select(F.lit("definition").alias("kind"), F.col("qualified_name").alias("label"), F.concat_ws(":", "rel_path", "line_start").alias("detail"))


def labelled(nodes: DataFrame, t: Tables, kind: str) -> DataFrame:
    from quillgraph.operators.joins import labelled_nodes

    return labelled_nodes(nodes.distinct(), t.files, t.symbols).select(F.lit(kind).alias("kind"), "label", F.concat_ws(":", "node_kind", "node_id").alias("detail")).orderBy("label")
