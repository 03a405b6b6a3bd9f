"""Facts from source text, ledgers, exports and diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import views as v
from quillgraph.functions import text as tx
from quillgraph.operators import aggregates, evidence, extract, link, nested, sessions
from quillgraph.registry import query

LANGUAGE = ["typescript", "python", "go", "rust"]


def sources(spark: SparkSession, d: str) -> DataFrame:
    """One small source file of each part, in one of four languages."""
    word = F.substring_index("p_name", " ", 1)
    other = F.substring_index("p_name", " ", -1)
    k = F.col("p_partkey") % 4
    code = (
        F.when(k == 0, F.concat(F.lit("import { "), other, F.lit(" } from './"), other, F.lit("'\nexport function "), word, F.lit("(x) {\n  return api."), other, F.lit("(x)\n}\nconst y = "), other, F.lit("(1)")))
        .when(k == 1, F.concat(F.lit("from "), other, F.lit(" import z\n\nclass "), word, F.lit(":\n    def _"), other, F.lit("(self):\n        return "), word, F.lit("(1)")))
        .when(k == 2, F.concat(F.lit('package p\nimport "'), other, F.lit('"\nfunc '), word, F.lit("() { "), other, F.lit(".Run() }")))
        .otherwise(F.concat(F.lit("use "), other, F.lit("::x;\npub struct "), word, F.lit(";\nfn "), other, F.lit("() { "), word, F.lit("(2) }")))
    )
    return v.table(spark, d, "part").select(F.col("p_partkey").alias("file_id"), F.element_at(F.array(*map(F.lit, LANGUAGE)), (k + 1).cast("int")).alias("language"), code.alias("content"))


def scripts(spark: SparkSession, d: str) -> DataFrame:
    """A script of each part with imports of all forms, a class and exports; every tenth has a brace too many, every tenth one too few."""
    word, other, k = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1), F.col("p_partkey") % 10
    parts = [
        "import base, { helper as h_", word, " } from './", other, "'\nimport * as ns from 'pkg-", other, "'\nexport { ", word, " as ", other, "2 } from './re'\nexport class C_", word,
        " extends base {\n  size: number = 1\n  run(x) {\n    return ns.", other, "('}', x) // }\n  }\n}\nmodule.exports = C_", word, "\n",
    ]
    code = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.when(k == 0, "}\n").when(k == 1, "function open() {\n").otherwise(""))
    language = F.when(k == 2, "cobol").when(k == 3, "python").otherwise("typescript")
    return v.table(spark, d, "part").select(F.col("p_partkey").alias("file_id"), language.alias("language"), code.alias("content"))


SCRIPTS_SQL = "x AS (SELECT p_partkey AS file_id, p_partkey % 10 AS k, split_part(p_name, ' ', 1) AS word, split_part(p_name, ' ', -1) AS other FROM part), s AS (SELECT * FROM x WHERE k NOT IN (2, 3))"


@query(v.with_(SCRIPTS_SQL) + """
SELECT file_id, 'class' AS kind, 'C_' || word AS name, 'C_' || word AS qualified_name, NULL AS parent, 4 AS line_start, 9 AS line_end, true AS exported FROM s
UNION ALL SELECT file_id, 'field', 'size', 'C_' || word || '.size', 'C_' || word, 5, 5, false FROM s
UNION ALL SELECT file_id, 'method', 'run', 'C_' || word || '.run', 'C_' || word, 6, 8, false FROM s
UNION ALL SELECT file_id, 'function', 'open', 'open', NULL, 11, 12, false FROM s WHERE k = 1""")
def scoped_symbols(spark: SparkSession, d: str) -> DataFrame:
    return extract.scoped_symbols(scripts(spark, d))


@query(v.with_(SCRIPTS_SQL) + """
SELECT file_id, 1 AS line, './' || other AS specifier, 'base' AS local_name, 'default' AS imported_name, false AS is_reexport FROM s
UNION ALL SELECT file_id, 1, './' || other, 'h_' || word, 'helper', false FROM s
UNION ALL SELECT file_id, 2, 'pkg-' || other, 'ns', '*', false FROM s
UNION ALL SELECT file_id, 3, './re', other || '2', word, true FROM s""")
def import_bindings(spark: SparkSession, d: str) -> DataFrame:
    return extract.bindings(scripts(spark, d)).drop("type_only")


@query(v.with_(SCRIPTS_SQL) + """
SELECT file_id, 3 AS line, 'list' AS kind, other || '2' AS name, word AS local_name FROM s UNION ALL SELECT file_id, 4, 'named', 'C_' || word, 'C_' || word FROM s
UNION ALL SELECT file_id, 10, 'commonjs_default', 'default', 'C_' || word FROM s""")
def exported_names(spark: SparkSession, d: str) -> DataFrame:
    return extract.exports(scripts(spark, d)).drop("specifier", "type_only")


@query(v.with_(SCRIPTS_SQL) + """
SELECT file_id, CASE k WHEN 2 THEN 'skipped' WHEN 0 THEN 'parsed_with_errors' WHEN 1 THEN 'parsed_with_errors' WHEN 3 THEN 'parsed_with_errors' ELSE 'parsed' END AS status,
CASE k WHEN 0 THEN 'unexpected } in line 11' WHEN 1 THEN '1 blocks not closed' WHEN 2 THEN NULL WHEN 3 THEN 'unexpected } in line 9' ELSE '' END AS diagnostics FROM x""")
def parse_status(spark: SparkSession, d: str) -> DataFrame:
    return extract.parse_status(scripts(spark, d))


def modules(spark: SparkSession, d: str) -> DataFrame:
    """A module of each part whose templates, comments, strings and regular expressions hold what looks like code, whose statements take several lines or share one; every fifth is cut off inside a template."""
    word, other, k = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1), F.col("p_partkey") % 5
    parts = [
        "import {\n  a as w_", word, ",\n  type T_", other, ",\n} from './", other, "'; import side, * as all from 'pkg-", word, "'\n",
        "/* function never() {\n import x from 'never' */ const text = `\nfunction inside_", word, "() { ${ [1].map((n) => `in ${ n } }`) }\n`\n",
        "export default class extends a {\n  static kind: T_", other, " = make()\n  go(n: number): { left: number } {\n    if (n) return new w_", word, "('}').run({ key: n })\n    return /[/{]/.test(n) ? other : text\n  }\n}\n",
        "export const one = (v) => { count += v }, two = 2\nconst lazy = one ? require('maybe-", other, "') : import(two)\n", "export { one as uno_", word, " }; export * from './all-", other, "'\n",
    ]
    code = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.when(k == 0, "const open = `${ {").otherwise(""))
    return v.table(spark, d, "part").select(F.col("p_partkey").alias("file_id"), F.lit("typescript").alias("language"), code.alias("content"))


MODULES_SQL = "m AS (SELECT p_partkey AS file_id, p_partkey % 5 AS k, 'w_' || split_part(p_name, ' ', 1) AS w, 'T_' || split_part(p_name, ' ', -1) AS t, split_part(p_name, ' ', 1) AS word, split_part(p_name, ' ', -1) AS other FROM part)"


@query(v.with_(MODULES_SQL) + """
SELECT file_id, unnest(['constant', 'field', 'method', 'constant', 'constant', 'constant']) AS kind, unnest(['text', 'kind', 'go', 'one', 'two', 'lazy']) AS name,
unnest([6, 10, 11, 16, 16, 17]) AS line_start, unnest([8, 10, 14, 16, 16, 17]) AS line_end, unnest([false, false, false, true, true, false]) AS exported FROM m
UNION ALL SELECT file_id, 'constant', 'open', 19, 19, false FROM m WHERE k = 0""")
def module_symbols(spark: SparkSession, d: str) -> DataFrame:
    return extract.scoped_symbols(modules(spark, d)).drop("qualified_name", "parent")


@query(v.with_(MODULES_SQL) + """
SELECT file_id, unnest(['esm', 'esm', 'conditional_require', 'dynamic', 'reexport']) AS kind, unnest(['./' || other, 'pkg-' || word, 'maybe-' || other, '<dynamic-expression>', './all-' || other]) AS specifier, unnest([1, 4, 17, 17, 18]) AS line FROM m""")
def module_imports(spark: SparkSession, d: str) -> DataFrame:
    return extract.imports(modules(spark, d))


@query(v.with_(MODULES_SQL) + """
SELECT file_id, unnest(['./' || other, './' || other, 'pkg-' || word, 'pkg-' || word, './all-' || other]) AS specifier, unnest([w, t, 'side', 'all', NULL]) AS local_name,
unnest(['a', t, 'default', '*', '*']) AS imported_name, unnest([false, false, false, false, true]) AS is_reexport, unnest([false, true, false, false, false]) AS type_only FROM m""")
def module_bindings(spark: SparkSession, d: str) -> DataFrame:
    return extract.bindings(modules(spark, d)).drop("line")


@query(v.with_(MODULES_SQL) + """
SELECT file_id, unnest(['default', 'named', 'named', 'list', 'all']) AS kind, unnest(['default', 'one', 'two', 'uno_' || word, '*']) AS name, unnest([NULL, 'one', 'two', 'one', NULL]) AS local_name,
unnest([NULL, NULL, NULL, NULL, './all-' || other]) AS specifier, unnest([9, 16, 16, 18, 18]) AS line FROM m""")
def module_exports(spark: SparkSession, d: str) -> DataFrame:
    return extract.exports(modules(spark, d)).drop("type_only")


@query(v.with_(MODULES_SQL) + """
SELECT file_id, unnest(['map', 'make', w, 'run', 'test', 'require', 'import']) AS name, unnest(['[1].map', 'make', w, w || '(}).run', '/[/{]/.test', 'require', 'import']) AS callee,
unnest(['method', 'direct', 'constructor', 'method', 'method', 'direct', 'direct']) AS call_kind, unnest(['text', 'kind', 'go', 'go', 'go', 'lazy', 'lazy']) AS caller, unnest([7, 10, 12, 12, 13, 17, 17]) AS line FROM m""")
def module_calls(spark: SparkSession, d: str) -> DataFrame:
    return extract.calls(modules(spark, d))


@query(v.with_(MODULES_SQL) + """
, r AS (SELECT file_id, unnest([2, 2, 3, 4, 4, 6, 7, 7, 7, 9, 10, 10, 10, 11, 11, 11, 12, 12, 12, 12, 13, 13, 13, 13, 16, 16, 16, 16, 16, 17, 17, 17, 17, 18, 18]) AS line,
    unnest(['a', w, t, 'side', 'all', 'text', 'map', 'n', 'n', 'a', 'kind', t, 'make', 'go', 'n', 'left', 'n', w, 'run', 'n', 'test', 'n', 'other', 'text', 'one', 'v', 'count', 'v', 'two', 'lazy', 'one', 'require', 'two', 'one', 'uno_' || word]) AS name,
    unnest(['write', 'read', 'write', 'read', 'read', 'write', 'read', 'read', 'read', 'type', 'write', 'type', 'read', 'write', 'read', 'type', 'read', 'read', 'read', 'read', 'read', 'read', 'read', 'read', 'write', 'read', 'write', 'read', 'write', 'write', 'read', 'read', 'read', 'write', 'read']) AS reference_kind,
    unnest([NULL, NULL, NULL, NULL, NULL, 'text', 'text', 'text', 'text', NULL, 'kind', 'kind', 'kind', 'go', 'go', 'go', 'go', 'go', 'go', 'go', 'go', 'go', 'go', 'go', 'one', 'one', 'one', 'one', 'two', 'lazy', 'lazy', 'lazy', 'lazy', NULL, NULL]) AS scope FROM m
    UNION ALL SELECT file_id, 19, 'open', 'write', 'open' FROM m WHERE k = 0)
SELECT *, CASE reference_kind WHEN 'type' THEN 0.7 WHEN 'write' THEN 0.65 ELSE 0.5 END AS confidence FROM r""")
def module_references(spark: SparkSession, d: str) -> DataFrame:
    return extract.references(modules(spark, d))


@query(v.with_(MODULES_SQL) + """
SELECT file_id, CASE k WHEN 0 THEN 'parsed_with_errors' ELSE 'parsed' END AS status, CASE k WHEN 0 THEN '2 blocks not closed' ELSE '' END AS diagnostics FROM m""")
def module_status(spark: SparkSession, d: str) -> DataFrame:
    return extract.parse_status(modules(spark, d))


WORDS_SQL = "w AS (SELECT p_partkey AS file_id, p_partkey % 4 AS k, split_part(p_name, ' ', 1) AS word, split_part(p_name, ' ', -1) AS other FROM part)"


@query(v.with_(WORDS_SQL) + """
SELECT file_id, 'function' AS kind, word AS name, 2 AS line_start, 5 AS line_end, true AS exported FROM w WHERE k = 0
UNION ALL SELECT file_id, 'variable', 'y', 5, 5, false FROM w WHERE k = 0
UNION ALL SELECT file_id, 'class', word, 3, 5, true FROM w WHERE k = 1
UNION ALL SELECT file_id, 'function', '_' || other, 4, 5, false FROM w WHERE k = 1
UNION ALL SELECT file_id, 'function', word, 3, 3, false FROM w WHERE k = 2
UNION ALL SELECT file_id, 'struct', word, 2, 3, true FROM w WHERE k = 3
UNION ALL SELECT file_id, 'function', other, 3, 3, false FROM w WHERE k = 3""")
def extracted_symbols(spark: SparkSession, d: str) -> DataFrame:
    return extract.symbols(sources(spark, d)).drop("language")


@query(v.with_(WORDS_SQL) + """
SELECT file_id, (['esm', 'from', 'import', 'use'])[k + 1] AS kind, (['./' || other, other, other, other || '::x'])[k + 1] AS specifier, CASE WHEN k = 2 THEN 2 ELSE 1 END AS line FROM w""")
def extracted_imports(spark: SparkSession, d: str) -> DataFrame:
    return extract.imports(sources(spark, d))


@query(v.with_(WORDS_SQL) + """
SELECT * FROM (SELECT file_id, 3 AS line, other AS name, 'method' AS call_kind FROM w WHERE k = 0 UNION ALL SELECT file_id, 5, other, 'direct' FROM w WHERE k = 0
UNION ALL SELECT file_id, 5, word, 'direct' FROM w WHERE k = 1 UNION ALL SELECT file_id, 3, 'Run', 'method' FROM w WHERE k = 2 UNION ALL SELECT file_id, 3, word, 'direct' FROM w WHERE k = 3) WHERE name <> 'new' OR file_id % 4 <> 0""")
def extracted_calls(spark: SparkSession, d: str) -> DataFrame:
    return extract.calls(sources(spark, d)).select("file_id", "line", "name", "call_kind")


@query(v.with_(WORDS_SQL) + """
SELECT file_id, line, name, CASE WHEN k = 0 AND (name = 'y' OR line = 1 OR (line = 2 AND name = word)) THEN 'write' ELSE 'read' END AS reference_kind FROM (
    SELECT file_id, k, word, unnest([1, 2, 2, 3, 3, 3, 5, 5]) AS line, unnest([other, word, 'x', 'api', other, 'x', 'y', other]) AS name FROM w WHERE k = 0
    UNION ALL SELECT file_id, k, word, unnest([1, 1, 3, 4, 4, 5]), unnest([other, 'z', word, '_' || other, 'self', word]) FROM w WHERE k = 1
    UNION ALL SELECT file_id, k, word, unnest([1, 3, 3, 3]), unnest(['p', word, other, 'Run']) FROM w WHERE k = 2
    UNION ALL SELECT file_id, k, word, unnest([1, 1, 2, 3, 3]), unnest([other, 'x', word, other, word]) FROM w WHERE k = 3)
WHERE name <> 'new' OR k <> 0""")
def extracted_references(spark: SparkSession, d: str) -> DataFrame:
    return extract.references(sources(spark, d)).select("file_id", "line", "name", "reference_kind")


@query(v.with_(v.SYMBOLS_SQL) + "SELECT symbol_id // 8 AS parent_symbol_id, string_agg(name, ', ' ORDER BY name) AS content FROM symbols GROUP BY 1")
def class_summaries(spark: SparkSession, d: str) -> DataFrame:
    return extract.class_summaries(v.symbols(spark, d).withColumn("parent_symbol_id", F.floor(F.col("symbol_id") / 8)))


@query("""
WITH l AS (SELECT doc_id AS file_id, string_split_regex(text, '\\r?\\n') AS lines FROM documents), s AS (SELECT *, least(4, len(lines)) AS e FROM l),
r AS (SELECT file_id, lines, NULL AS symbol_id, 1 AS line_start, 1 AS line_end FROM s
      UNION ALL SELECT file_id, lines, file_id, 2, e FROM s WHERE e >= 2 UNION ALL SELECT file_id, lines, NULL, e + 1, len(lines) FROM s WHERE len(lines) > e)
SELECT file_id, symbol_id, line_start, line_end, sha256(array_to_string(list_slice(lines, line_start, line_end), chr(10))) AS hash FROM r
WHERE regexp_replace(array_to_string(list_slice(lines, line_start, line_end), ''), '\\s', '', 'g') <> ''""")
def symbol_chunks(spark: SparkSession, d: str) -> DataFrame:
    """A symbol from line 2 to 4 of every document, what comes before it and what follows."""
    docs = v.table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("content"))
    symbols = docs.select("file_id", F.col("file_id").alias("symbol_id"), F.lit(2).alias("line_start"), F.lit(4).alias("line_end"))
    return extract.symbol_chunks(docs, symbols).select("file_id", "symbol_id", "line_start", "line_end", F.sha2("content", 256).alias("hash"))


@query("""
WITH l AS (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS lines FROM documents)
SELECT doc_id AS file_id, sha256(array_to_string(CASE WHEN doc_id % 3 = 0 THEN list_slice(lines, 1, 2) ELSE list_slice(lines, 1, 12) END, chr(10))) AS hash FROM l""")
def header_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every third document has a symbol at line 3; the others have none."""
    docs = v.table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("content"))
    symbols = docs.where("file_id % 3 = 0").select("file_id", F.lit(3).alias("line_start"))
    return extract.header_chunks(docs, symbols).select("file_id", F.sha2("content", 256).alias("hash"))


@query(v.with_(v.FILES_SQL) + """
, l AS (SELECT rel_path, string_split_regex(text, '\\r?\\n') AS lines FROM documents JOIN files ON doc_id = file_id WHERE ends_with(rel_path, '.ts')),
h AS (SELECT rel_path, i AS line, lines[i] AS text FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM l) WHERE regexp_matches(lines[i], '(?i)the of'))
SELECT rel_path, CAST(line AS INTEGER) AS line, sha256(text) AS text, (SELECT count(*) FROM h) > 40 AS truncated FROM h ORDER BY rel_path, line LIMIT 40""")
def grep_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = v.table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("content")).join(v.files(spark, d).select("file_id", "rel_path"), "file_id")
    return extract.grep(docs, "THE OF", "**/*.ts", 40).withColumn("text", F.sha2("text", 256))


@query(v.with_(v.LINKS_SQL) + "SELECT page_id, seq, CASE WHEN starts_with(href, '/') AND ends_with(href, 'n') AND length(href) >= 2 THEN substr(href, 2, length(href) - 2) END AS star FROM links")
def alias_matches(spark: SparkSession, d: str) -> DataFrame:
    return v.links(spark, d).select("page_id", "seq", link.matched_alias(F.lit("/*n"), F.col("href")).alias("star"))


@query("SELECT l_suppkey AS session_id, count(DISTINCT l_partkey) AS files, sum(CAST(l_quantity AS BIGINT)) AS additions, sum(l_linenumber) AS deletions FROM lineitem GROUP BY l_suppkey")
def combined_diffs(spark: SparkSession, d: str) -> DataFrame:
    rows = v.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("session_id"), F.col("l_partkey").alias("path"), F.col("l_quantity").cast("bigint").alias("additions"), F.col("l_linenumber").alias("deletions"))
    return sessions.combined_diffs(rows)


@query(v.with_(v.TELEMETRY_SQL) + """
, e AS (SELECT session_id AS question_id, kind || ':' || (k % 10) AS path, strategy AS source, max((event_id % 17) / 10.0) AS score, min_by(event_id, struct_pack(a := -((event_id % 17) / 10.0), b := event_id)) AS o FROM telemetry GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, o) AS seq FROM e)
SELECT question_id, path, source, seq FROM r WHERE seq <= 12""")
def context_ledger(spark: SparkSession, d: str) -> DataFrame:
    rows = v.telemetry(spark, d).select(F.col("session_id").alias("question_id"), F.concat("kind", F.lit(":"), F.col("k") % 10).alias("path"), F.col("strategy").alias("source"), (F.col("event_id") % 17 / F.lit(10.0)).alias("score"), F.col("event_id").alias("o"))
    return evidence.capped(rows, ["path", "source"], [F.desc("score"), "o"], 12).select("question_id", "path", "source", "seq")


@query("""
SELECT 'c' || conv_id AS session_id, turn AS seq, role AS key, CASE WHEN role = 'system' THEN '[REDACTED_COMMAND]' WHEN regexp_matches(text, '(?i)bearer\\s+[a-z0-9._:-]+|sk-[a-z0-9._:-]+') THEN '[REDACTED_SECRET]' ELSE sha256(text) END AS value FROM conversations""")
def session_export(spark: SparkSession, d: str) -> DataFrame:
    """Export to nested documents and import again."""
    key = F.when(F.col("role") == "system", "command").otherwise(F.col("role"))
    rows = v.table(spark, d, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("session_id"), F.col("turn").alias("seq"), key.alias("key"), F.col("text").alias("value"))
    out = sessions.imported(sessions.exported(rows, ["/home/"]))
    return out.select("session_id", "seq", F.when(F.col("key") == "command", "system").otherwise(F.col("key")).alias("key"), F.when(F.col("value").startswith("[REDACTED_"), F.col("value")).otherwise(F.sha2("value", 256)).alias("value"))


@query("""
SELECT 'c' || conv_id || '.' || turn AS id, CASE WHEN turn % 3 = 0 THEN '[REDACTED_SECRET]' ELSE v END AS secret, CASE WHEN regexp_matches(text, '(?i)bearer\\s+[a-z0-9._:-]+|sk-[a-z0-9._:-]+') THEN '[REDACTED_SECRET]' ELSE '[REDACTED_COMMAND]' END AS command,
v AS plain, CASE WHEN regexp_matches(role, '^(user|a)') THEN '[REDACTED_PATH]' ELSE '/work/' || role END AS path, CAST(turn AS VARCHAR) AS n
FROM (SELECT *, CASE WHEN regexp_matches(text, '(?i)bearer\\s+[a-z0-9._:-]+|sk-[a-z0-9._:-]+') THEN '[REDACTED_SECRET]' ELSE sha256(text) END AS v FROM conversations)""")
def redacted_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every turn as a document with lists in lists: secrets by key and by value, commands, paths, numbers."""
    key = F.when(F.col("turn") % 3 == 0, "authToken").otherwise("note")
    root = F.when(F.col("role").rlike("^(user|a)"), "/home/").otherwise("/work/")
    text = F.col("text")
    json = F.concat(
        F.lit('{"deep": [[{'), nested.quoted(key), F.lit(': ["head", ['), nested.quoted(text), F.lit(']], "turn": '), F.col("turn").cast("string"),
        F.lit('}]], "run": {"shellCmd": {"args": 1}, "cmd": ['), nested.quoted(text), F.lit('], "list": [null, true, {"plain": '), nested.quoted(text), F.lit(', "at": '), nested.quoted(F.concat(root, "role")), F.lit("}]}}"),
    )
    rows = v.table(spark, d, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("."), "turn").alias("id"), json.alias("json"))
    out = nested.redacted_json(rows, ["/home/"])
    get = lambda path: F.get_json_object("json", path)
    shown = lambda c: F.when(c.startswith("[REDACTED_"), c).otherwise(F.sha2(c, 256))
    secret = F.coalesce(get("$.deep[0][0].authToken[1][0]"), get("$.deep[0][0].note[1][0]"))
    return out.select("id", shown(secret).alias("secret"), get("$.run.cmd[0]").alias("command"), shown(get("$.run.list[2].plain")).alias("plain"), get("$.run.list[2].at").alias("path"), get("$.deep[0][0].turn").alias("n"))


@query("""
WITH b AS (SELECT DISTINCT 'conv-' || conv_id AS s FROM conversations WHERE conv_id % 5 = 1)
SELECT 'event' AS kind, 'e' || turn || '@' || s || '/fork' AS id, s || '/fork' AS session_id, s || '/fork' AS a, s || '0' AS b FROM conversations JOIN b ON 'conv-' || conv_id = s
UNION ALL SELECT 'checkpoint', 'p' || turn || '@' || s || '/fork', s || '/fork', NULL, NULL FROM conversations JOIN b ON 'conv-' || conv_id = s WHERE turn % 2 = 0
UNION ALL SELECT 'revert', 'r' || turn || '@' || s || '/fork', s || '/fork', 'p' || turn || CASE WHEN turn % 2 = 0 THEN '@' || s || '/fork' ELSE '' END, CASE WHEN turn > 0 THEN 'p' || (turn - 1) || CASE WHEN turn % 2 = 1 THEN '@' || s || '/fork' ELSE '' END END FROM conversations JOIN b ON 'conv-' || conv_id = s
UNION ALL SELECT 'session', s || '/fork', s || '/fork', 'in_progress', NULL FROM b""")
def forked_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth conversation forked: events name it inside lists beside a longer name, every second turn is a checkpoint, reverts point at them."""
    turns = v.table(spark, d, "conversations").select(F.concat(F.lit("conv-"), "conv_id").alias("session_id"), "conv_id", "turn")
    payload = F.concat(F.lit('{"a": [{"id": "'), "session_id", F.lit('"}], "b": ["'), "session_id", F.lit('0"]}'))
    named = lambda c, n: F.concat(F.lit(c), n)
    sessions_ = turns.select("session_id", F.lit("done").alias("status"), F.lit("m").alias("latest_summary_id"), F.lit("p0").alias("latest_checkpoint_id")).distinct()
    events = turns.select(named("e", F.col("turn")).alias("id"), "session_id", payload.alias("payload"))
    points = turns.where("turn % 2 = 0").select(named("p", F.col("turn")).alias("id"), "session_id")
    reverts = turns.select(named("r", F.col("turn")).alias("id"), "session_id", named("p", F.col("turn")).alias("checkpoint_id"), F.when(F.col("turn") > 0, named("p", F.col("turn") - 1)).alias("previous_checkpoint_id"))
    forks = turns.where("conv_id % 5 = 1").select(F.col("session_id").alias("source"), F.concat("session_id", F.lit("/fork")).alias("target")).distinct()
    out = nested.forked(sessions_, events, events.select("id", "session_id"), points, reverts, forks)
    none = F.lit(None).cast("string")
    get = lambda path: F.get_json_object("payload", path)
    rows = out["events"].select(F.lit("event").alias("kind"), "id", "session_id", get("$.a[0].id").alias("a"), get("$.b[0]").alias("b"))
    rows = rows.unionByName(out["checkpoints"].select(F.lit("checkpoint").alias("kind"), "id", "session_id", none.alias("a"), none.alias("b")))
    rows = rows.unionByName(out["reverts"].select(F.lit("revert").alias("kind"), "id", "session_id", F.col("checkpoint_id").alias("a"), F.col("previous_checkpoint_id").alias("b")))
    return rows.unionByName(out["sessions"].select(F.lit("session").alias("kind"), F.col("session_id").alias("id"), "session_id", F.col("status").alias("a"), none.alias("b")))


@query("SELECT 'fork' AS session_id, turn AS seq, role AS key, 'fork/' || turn AS value FROM conversations WHERE conv_id = 3")
def session_fork(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("conv-"), "conv_id", F.lit("-end"))
    rows = v.table(spark, d, "conversations").select(name.alias("session_id"), F.col("turn").alias("seq"), F.col("role").alias("key"), F.concat(name, F.lit("/"), "turn").alias("value"))
    return sessions.forked(rows, "conv-3-end", "fork")


@query("""
SELECT event_id, CASE WHEN event_type IN ('error') THEN false WHEN user_id % 3 = 0 THEN event_type = 'click' ELSE (400 + event_id % 200) IN (408, 409, 425, 429) OR 400 + event_id % 200 BETWEEN 500 AND 599 END AS retry FROM events""")
def retry_rules(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "semantic").when(F.col("event_type") == "click", "network").otherwise("other")
    status = F.when(F.col("user_id") % 3 != 0, 400 + F.col("event_id") % 200)
    return v.table(spark, d, "events").select("event_id", tx.retryable(kind, status).alias("retry"))


@query(v.with_(v.FILES_SQL) + """
SELECT root_id, count(*) AS n, count_if(freshness_state IN ('refreshed_current', 'retained_current')) AS current FROM files GROUP BY root_id""")
def index_report(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.current_share(v.files(spark, d), "root_id")


@query("""
WITH RECURSIVE c AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey > 4 THEN n_nationkey - 5 END AS parent, n_nationkey % 4 AS own FROM nation),
up(id, place, far) AS (SELECT id, id, 0 FROM c UNION ALL SELECT up.id, c.parent, far + 1 FROM up JOIN c ON up.place = c.id WHERE c.parent IS NOT NULL AND far < 8)
SELECT CAST(up.id AS BIGINT) AS config, '@' || own || '/*' AS pattern, 'src' || min_by(c.id, far) || '/*' AS target FROM up JOIN c ON up.place = c.id GROUP BY up.id, own""")
def config_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Nations as configuration files: each has one alias and extends the one five places before it."""
    own = v.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("config"), F.when(F.col("n_nationkey") > 4, F.col("n_nationkey") - 5).cast("bigint").alias("extends"), F.concat(F.lit("@"), F.col("n_nationkey") % 4, F.lit("/*")).alias("pattern"), F.concat(F.lit("src"), "n_nationkey", F.lit("/*")).alias("target"))
    return link.inherited_aliases(own).select("config", "pattern", "target")
