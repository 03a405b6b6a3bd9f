"""The logical tables: fixed schemas (as DDL) and value domains, enforced on read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


FILES = (
    "workspace_id bigint, root_id bigint, file_id bigint, rel_path string, language string, size_bytes bigint, mtime_unix_ms bigint,"
    "content_hash string, structure_hash string, public_api_hash string, parse_status string, freshness_state string, deleted_at_unix_ms bigint"
)
SYMBOLS = (
    "symbol_id bigint, file_id bigint, parent_symbol_id bigint, kind string, name string, qualified_name string, exported boolean,"
    "line_start int, line_end int"
)
EDGES = "kind string, from_kind string, from_id bigint, to_kind string, to_id bigint, resolution string, line int"
CHUNKS = "chunk_id bigint, file_id bigint, symbol_id bigint, kind string, title string, content string, content_hash string, line_start int, line_end int"
EMBEDDINGS = "chunk_id bigint, model string, dimensions int, content_hash string, vector array<float>"
TELEMETRY = "kind string, timestamp string, metrics struct<durationMs:double,totalTokens:bigint,chunksEmbedded:bigint,strategy:string>"

# The domains that decoders accept.
LANGUAGES = ["typescript", "tsx", "javascript", "jsx", "python", "go", "rust", "unknown"]
PARSE_STATUS = ["pending", "parsed", "parsed_with_errors", "failed", "skipped"]
FRESHNESS = ["refreshed_current", "retained_current", "degraded_partial", "not_current", "deleted"]
EDGE_KINDS = ["contains", "definition", "imports", "re_exports", "exports", "calls", "references", "type_references", "extends", "implements", "tests"]
NODE_KINDS = ["file", "symbol", "chunk"]
ANSWER_STATES = ["grounded", "partial", "insufficient", "unsupported"]


def decoded(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """``rows``, failing on a value of ``column`` outside ``domain`` (null passes)."""
    bad = F.col(column).isNotNull() & ~F.col(column).isin(domain)
    told = F.concat(F.lit(f"invalid value for {column}: "), F.col(column))
    return rows.withColumn(column, F.when(bad, F.raise_error(told)).otherwise(F.col(column)))


def enforced(rows: DataFrame, schema: str) -> DataFrame:
    """``rows`` cast to ``schema``; columns that it lacks are null."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema).fields])
