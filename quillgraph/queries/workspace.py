"""Files of a workspace: hashes of their contents, nested ignore files, entries of packages."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import views as v
from quillgraph.operators import contenthash, ignores, packages
from quillgraph.registry import query
from quillgraph.sources import versions
from quillgraph.storage import place


@query()
def blake3_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Every document's BLAKE3; long texts go in pieces of 16 KiB here, so that both ways are taken."""
    docs = v.table(spark, d, "documents").select("doc_id", "text")
    return contenthash.blake3_hashes(docs, "doc_id", "text", 1 << 14)


#: Ignore files by folder.
IGNORE_FILES = [
    (".gitignore", "# built\n\n*.rs\n!test_*.rs\n/src1/\nsrc2/**/doc_*\nen\\*\n"),
    ("src3/.gitignore", "!*.rs\nen/\n"),
    ("src3/en/.gitignore", "!*\n"),
    ("src4/.gitignore", "fr/*\n!fr/test_[0-9]*.*\n"),
    ("src5/de/.gitignore", "/doc_?.ts\n**/doc_?.js\n"),
]


@query(v.with_(v.FILES_SQL) + """
, p AS (SELECT file_id, rel_path, split_part(rel_path, '/', 1) AS source, split_part(rel_path, '/', 2) AS lang, split_part(rel_path, '/', 3) AS base FROM files)
SELECT rel_path, CASE WHEN source = 'src1' THEN true WHEN source = 'src2' AND starts_with(base, 'doc_') THEN true WHEN source = 'src3' THEN lang = 'en'
    WHEN source = 'src4' AND lang = 'fr' THEN NOT starts_with(base, 'test_') WHEN source = 'src5' AND lang = 'de' AND regexp_full_match(base, 'doc_.\\.(ts|js)') THEN true ELSE ends_with(base, '.rs') AND NOT starts_with(base, 'test_') END AS ignored FROM p""")
def ignored_paths(spark: SparkSession, d: str) -> DataFrame:
    """The documents' paths under ignore files of the root and of folders, one of them inside an ignored folder."""
    files = spark.createDataFrame(IGNORE_FILES, "rel_path string, content string")
    return ignores.ignored_paths(v.files(spark, d).select("rel_path"), files)


def manifest(k: int) -> str:
    """Manifests by kind: conditions and patterns, entry fields, a blocked and an unsafe target, broken text."""
    exports = {
        ".": {"browser": "./no.ts", "node": {"require": "./doc_{id}.ts", "default": "./never.ts"}},
        "./feature/*": {"types": None, "default": "./gone/*.ts"}, "./feature/deep/*.js": "./doc_*.js", "./hidden": None, "./away": "../doc_{id}.ts", "./list": [{"other": "./x.ts"}, "./doc_{id}"], "./dir/": "./",
    }
    return json.dumps([{"exports": exports}, {"module": "gone.js", "main": "./doc_{id}"}][k]) if k < 2 else "{broken"


PACKAGES_SQL = """
p AS (SELECT file_id, '@w/p' || file_id AS name, file_id % 4 AS ext, CAST(floor(file_id / 4) AS BIGINT) % 3 AS m, CASE WHEN file_id % 9 = 0 THEN 'test_' ELSE 'doc_' END = 'doc_' AS named, rel_path FROM files),
asks AS (SELECT *, unnest(range(0, 8)) AS ask FROM p),
told AS (
    SELECT file_id * 10 + ask AS import_id, ask, rel_path, file_id,
        CASE WHEN m = 2 THEN 'invalid' WHEN m = 1 THEN CASE WHEN ask = 0 THEN CASE WHEN named AND ext < 2 THEN 'resolved' ELSE 'missing' END WHEN ask = 6 THEN CASE WHEN named THEN 'resolved' ELSE 'missing' END ELSE 'missing' END
        ELSE CASE ask WHEN 0 THEN CASE WHEN named AND ext = 0 THEN 'resolved' ELSE 'missing' END WHEN 1 THEN CASE WHEN named AND ext = 1 THEN 'resolved' ELSE 'missing' END WHEN 2 THEN 'blocked' WHEN 3 THEN 'blocked' WHEN 4 THEN 'unsafe'
            WHEN 5 THEN CASE WHEN named AND ext < 2 THEN 'resolved' ELSE 'missing' END WHEN 6 THEN 'not_exported' ELSE CASE WHEN named THEN 'resolved' ELSE 'missing' END END END AS status
    FROM asks)
SELECT import_id, status, CASE WHEN status = 'resolved' THEN rel_path END AS path, CASE WHEN status = 'resolved' THEN file_id END AS target_file_id FROM told"""


@query(v.with_(v.FILES_SQL, PACKAGES_SQL))
def package_exports(spark: SparkSession, d: str) -> DataFrame:
    """A package around every file: its entry, a pattern, a hidden path, a type only, a target outside, a list, a path of its own, a folder."""
    files = v.files(spark, d).select("file_id", "rel_path", "ext")
    kind = F.floor(F.col("file_id") / 4) % 3
    texts = [F.replace(F.lit(manifest(k)), F.lit("{id}"), F.col("file_id").cast("string")) for k in range(3)]
    folder = F.regexp_extract("rel_path", r"^(.*)/[^/]*$", 1)
    name = F.concat(F.lit("@w/p"), "file_id")
    known = files.select(name.alias("name"), folder.alias("folder"), F.when(kind == 0, texts[0]).when(kind == 1, texts[1]).otherwise(texts[2]).alias("manifest"))
    base = F.concat(F.lit("doc_"), "file_id", F.lit("."), "ext")
    inner = F.array(F.lit(""), F.concat(F.lit("/feature/deep/"), "file_id", F.lit(".js")), F.lit("/hidden"), F.lit("/feature/x"), F.lit("/away"), F.lit("/list"), F.concat(F.lit("/"), base), F.concat(F.lit("/dir/"), base))
    asks = files.select("file_id", name.alias("name"), F.posexplode(inner).alias("ask", "inner")).select((F.col("file_id") * 10 + F.col("ask")).alias("import_id"), F.concat("name", "inner").alias("specifier"))
    return packages.resolve_exports(asks, known, files, ["require", "node", "types", "default"]).select("import_id", "status", "path", "target_file_id")


@query(v.with_(v.FILES_SQL, v.CHUNKS_SQL, v.EMBEDDINGS_SQL) + """
, f AS (SELECT file_id, CASE WHEN file_id % 20 = 3 THEN 'new' ELSE content_hash END AS mark FROM files WHERE file_id % 20 <> 13),
c AS (SELECT chunk_id, file_id, CASE WHEN file_id % 20 = 3 THEN 'new' ELSE sha256(content) END AS mark FROM chunks WHERE file_id % 20 <> 13),
e AS (SELECT chunk_id AS file_id, model AS mark FROM vecs WHERE chunk_id % 20 NOT IN (3, 13))
SELECT 'files' AS kind, count(*) AS n, count_if(mark = 'new') AS fresh, CAST(sum(file_id) AS BIGINT) AS total, min(mark) AS least FROM f
UNION ALL SELECT 'chunks', count(*), count_if(mark = 'new'), CAST(sum(chunk_id) AS BIGINT), min(mark) FROM c UNION ALL SELECT 'embeddings', count(*), 0, CAST(sum(file_id) AS BIGINT), min(mark) FROM e""")
def replaced_versions(spark: SparkSession, d: str) -> DataFrame:
    """Files, chunks and vectors in one store: of every tenth file half get new facts and lose their vectors, half go, in one version."""
    files = v.files(spark, d).select("file_id", F.col("content_hash").alias("mark"))
    chunks = v.chunks(spark, d).select("file_id", "chunk_id", F.sha2("content", 256).alias("mark"))
    vectors = v.embeddings(spark, d).select(F.col("chunk_id").alias("file_id"), F.col("model").alias("mark"))
    root = place(spark, "versions")
    versions.begin(spark, root, {"files": files, "chunks": chunks, "embeddings": vectors})
    fresh = F.col("file_id") % 20 == 3
    new = {"files": files.where(fresh).withColumn("mark", F.lit("new")), "chunks": chunks.where(fresh).withColumn("mark", F.lit("new")), "embeddings": vectors.where("false")}
    changed = files.where("file_id % 10 = 3").select("file_id").unionByName(vectors.where("file_id % 10 = 3").select("file_id"))
    now = versions.replace(spark, root, new, changed)
    out = None
    for name, key in (("files", "file_id"), ("chunks", "chunk_id"), ("embeddings", "file_id")):
        rows = versions.read(spark, root, name, now)
        one = rows.agg(F.count("*").alias("n"), F.count_if(F.col("mark") == "new").alias("fresh"), F.sum(key).alias("total"), F.min("mark").alias("least")).select(F.lit(name).alias("kind"), "n", "fresh", "total", "least")
        out = one if out is None else out.unionByName(one)
    return out
