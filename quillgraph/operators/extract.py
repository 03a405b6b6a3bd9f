"""Extraction from source text: symbols, imports, exports, calls and references by tokens; an outline and chunks with native expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import lexer, syntax
from quillgraph.storage import spread

# the two modules travel with the function that uses them, so that workers need no copy of the package
cloudpickle.register_pickle_by_value(lexer)
cloudpickle.register_pickle_by_value(syntax)

#: Languages whose texts are read.
LANGUAGES = [*sorted(lexer.SCRIPT), "python", "go", "rust"]
#: Facts of one Arrow batch.
FACT_ROWS = 20_000
#: Texts of at most so many characters are walked once a task where they repeat; what is remembered (characters and values) is bounded.
SAME_CHARS, SAME_HELD = 1 << 16, 4_000_000
_TYPES = {"seq": pa.int64(), "flag": pa.bool_(), "type_only": pa.bool_(), "start": pa.int64(), "stop": pa.int64(), "line": pa.int32(), "line_end": pa.int32(), "confidence": pa.float64()}
_NAMES = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.float64(): "double", pa.string(): "string"}

# What each language's declarations look like (languages, kind, pattern whose first group is the name).
_SCRIPT = ["typescript", "tsx", "javascript", "jsx"]
DECLARATIONS = [
    (_SCRIPT, "function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+([A-Za-z_$][\w$]*)"),
    (_SCRIPT, "class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"),
    (_SCRIPT, "interface", r"^\s*(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)"),
    (_SCRIPT, "type", r"^\s*(?:export\s+)?type\s+([A-Za-z_$][\w$]*)\s*(?:<[^=]*>)?\s*="),
    (_SCRIPT, "enum", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+([A-Za-z_$][\w$]*)"),
    (_SCRIPT, "variable", r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)"),
    (["python"], "class", r"^\s*class\s+([A-Za-z_]\w*)"),
    (["python"], "function", r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)"),
    (["go"], "function", r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)"),
    (["go"], "type", r"^type\s+([A-Za-z_]\w*)"),
    (["rust"], "function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+([A-Za-z_]\w*)"),
    (["rust"], "struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+([A-Za-z_]\w*)"),
    (["rust"], "enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+([A-Za-z_]\w*)"),
    (["rust"], "trait", r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+([A-Za-z_]\w*)"),
    (["rust"], "module", r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+([A-Za-z_]\w*)"),
    (["rust"], "type", r"^\s*(?:pub(?:\([^)]*\))?\s+)?type\s+([A-Za-z_]\w*)"),
]
def lines(files: DataFrame, text: str = "content") -> DataFrame:
    """Files with one row a line: ``line`` from 1 and ``code``."""
    return files.select(*[c for c in files.columns if c != text], F.posexplode(F.split(text, r"\r?\n")).alias("at", "code")).withColumn("line", F.col("at") + 1).drop("at")


def _first(rules: list, language: Column, code: Column) -> Column:
    """Struct (kind, name) of the first rule that fits."""
    out = F
    for languages, kind, pattern in rules:
        out = out.when(language.isin(languages) & code.rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(code, pattern, 1).alias("name")))
    return out


def symbols(files: DataFrame) -> DataFrame:
    """(file_id, kind, name, line_start, line_end, exported): declarations by line; the end is eight lines on, inside the file."""
    split = lines(files)
    ends = split.groupBy("file_id").agg(F.max("line").alias("n"))
    found = split.withColumn("s", _first(DECLARATIONS, F.col("language"), F.col("code"))).where("s is not null")
    exported = F.when(F.col("language").isin(_SCRIPT), F.col("code").rlike(r"^\s*export\b")).when(F.col("language") == "go", F.col("s.name").rlike("^[A-Z]")).when(F.col("language") == "rust", F.col("code").rlike(r"^\s*pub\b")).otherwise(~F.col("s.name").startswith("_"))
    out = found.join(ends, "file_id").select("file_id", "language", F.col("s.kind").alias("kind"), F.col("s.name").alias("name"), F.col("line").alias("line_start"), F.least(F.col("line") + 8, F.col("n")).alias("line_end"), exported.alias("exported"))
    return out.dropDuplicates(["file_id", "name", "kind", "line_start"])


def facts(files: DataFrame, *wanted: str, text: str = "content") -> DataFrame:
    """(file_id, fact, ...) of files in a known language, one walk over the tokens of each: see ``syntax.FIELDS``.

    Facts are of the wanted kinds: symbol, import, binding, export, call, reference, status.  ``start`` and ``stop`` are
    places in characters.  A walk is linear in the text, and a file is one row, so a generated file
    of any length costs its length; copies in one task share a walk.  Texts that are null or hold NUL characters, and other languages, give none.
    """
    known = files.where(F.col("language").isin(LANGUAGES) & F.col(text).isNotNull() & ~F.col(text).contains("\0"))
    kind, asked = known.schema["file_id"].dataType.simpleString(), frozenset(wanted)

    most_chars, most_held, fact_rows = SAME_CHARS, SAME_HELD, FACT_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[str, str], tuple[int, list[list]]] = {}
        held = 0

        def columns(text: str, language: str) -> tuple[int, list[list]]:
            """How many facts a text has, and their values by field."""
            nonlocal held
            own = kept.get((language, text))
            if own is None:
                found = syntax.facts(text, language, asked)
                own = len(found), [[r.get(f) for r in found] for f in syntax.FIELDS]
                if len(text) <= most_chars:
                    held += len(text) + len(syntax.FIELDS) * len(found)
                    if held > most_held:
                        kept.clear()
                        held = len(text) + len(syntax.FIELDS) * len(found)
                    kept[language, text] = own
            return own

        for batch in batches:
            ids: list[int] = []
            cols: list[list] = [[] for _ in syntax.FIELDS]
            for k in range(batch.num_rows):
                n, own = columns(batch.column(2)[k].as_py(), batch.column(1)[k].as_py())
                ids += [k] * n
                for c, x in zip(cols, own, strict=True):
                    c += x
                if len(ids) >= fact_rows or k + 1 == batch.num_rows:
                    for at in range(0, len(ids), fact_rows):
                        data = [pa.array(c[at : at + fact_rows], _TYPES.get(f, pa.string())) for f, c in zip(syntax.FIELDS, cols, strict=True)]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids[at : at + fact_rows])), *data], names=["file_id", *syntax.FIELDS])
                    ids, cols = [], [[] for _ in syntax.FIELDS]

    schema = ", ".join([f"file_id {kind}", *[f"{f} {_NAMES[_TYPES.get(f, pa.string())]}" for f in syntax.FIELDS]])
    return spread(known.select("file_id", "language", text)).mapInArrow(run, schema)


def scoped_symbols(files: DataFrame) -> DataFrame:
    """(file_id, kind, name, qualified_name, parent, line_start, line_end, exported): declarations with their spans and what they stand in.

    Scripts: classes and their methods and fields, functions, methods of object literals, interfaces, types, enums,
    constants and variables; Python: classes, methods, functions; Go: functions, methods by receiver, types; Rust:
    functions, methods by impl or trait, structs, enums, traits, types, modules.
    """
    return facts(files, "symbol").select("file_id", "kind", "name", "qualified_name", "parent", F.col("line").alias("line_start"), "line_end", F.col("flag").alias("exported"))


def bindings(files: DataFrame) -> DataFrame:
    """(file_id, line, specifier, local_name, imported_name, is_reexport, type_only): each name that an import brings in, ``default``, ``*`` or its own; none for bare imports."""
    return facts(files, "binding").select("file_id", "line", "specifier", "local_name", "imported_name", F.col("flag").alias("is_reexport"), "type_only")


def exports(files: DataFrame) -> DataFrame:
    """(file_id, line, kind, name, local_name, specifier, type_only): exported names of scripts, CommonJS included; the name of a default export is ``default``."""
    return facts(files, "export").select("file_id", "line", "kind", "name", "local_name", "specifier", F.coalesce("type_only", F.lit(False)).alias("type_only"))


def parse_status(files: DataFrame, text: str = "content") -> DataFrame:
    """(file_id, status, diagnostics): parsed, parsed_with_errors (brackets, strings, templates or comments that are not closed or not open; the first five are told), or skipped (no text, NUL characters, or an unknown language)."""
    found = facts(files, "status", text=text).select("file_id", F.col("seq").alias("wrong"), F.col("name").alias("told"))
    skip = F.col("wrong").isNull()
    status = F.when(skip, "skipped").when(F.col("wrong") > 0, "parsed_with_errors").otherwise("parsed")
    # scripts, Go and Rust tell of no error with an empty text
    told = F.when((F.col("told") != "") | (F.col("language") != "python"), F.col("told"))
    return files.select("file_id", "language").join(found, "file_id", "left").select("file_id", status.alias("status"), told.alias("diagnostics"))


def imports(files: DataFrame) -> DataFrame:
    """(file_id, kind, specifier, line): import statements, however many lines they take; modules that are computed are ``<dynamic-expression>``."""
    return facts(files, "import").select("file_id", "kind", "specifier", "line")


def calls(files: DataFrame) -> DataFrame:
    """(file_id, line, callee, name, call_kind, caller): call sites; the name is the last part of the callee, the caller the innermost declaration around."""
    return facts(files, "call").select("file_id", "line", F.col("specifier").alias("callee"), "name", F.col("kind").alias("call_kind"), F.col("parent").alias("caller"))


def references(files: DataFrame) -> DataFrame:
    """(file_id, line, name, reference_kind, confidence, scope): identifiers apart from reserved words and keys of object literals.

    In scripts names in places of types count as types, declared, assigned and counted ones as written; all others
    are read.  The scope is the innermost declaration around.
    """
    return facts(files, "reference").select("file_id", "line", "name", F.col("kind").alias("reference_kind"), "confidence", F.col("parent").alias("scope"))


def window_chunks(files: DataFrame, window: int = 60, overlap: int = 8, text: str = "content", also: tuple[str, ...] = ()) -> DataFrame:
    """(file_id, ``also`` of the file, seq, line_start, line_end, content): windows of lines that overlap; blank ones are dropped."""
    step = window - overlap
    split = files.select("file_id", *also, F.split(text, r"\r?\n").alias("lines"))
    many = F.ceil(F.greatest(F.size("lines") - window, F.lit(0)) / step).cast("int")
    cut = split.select("file_id", *also, "lines", F.explode(F.sequence(F.lit(0), many)).alias("k"))
    content = F.array_join(F.slice("lines", F.col("k") * step + 1, F.lit(window)), "\n")
    return cut.select(
        "file_id",
        *also,
        F.col("k").alias("seq"),
        (F.col("k") * step + 1).alias("line_start"),
        F.least(F.col("k") * step + window, F.size("lines")).alias("line_end"),
        content.alias("content"),
    ).where(F.col("content").rlike(r"\S"))


def symbol_chunks(files: DataFrame, symbols: DataFrame, text: str = "content") -> DataFrame:
    """(file_id, symbol_id, line_start, line_end, content): each symbol, the gaps before them, and what follows the last."""
    split = files.select("file_id", F.split(text, r"\r?\n").alias("lines")).withColumn("n", F.size("lines"))
    own = symbols.select("file_id", "symbol_id", "line_start", "line_end").join(split.select("file_id", "n"), "file_id").withColumn("line_end", F.least("line_end", "n"))
    w = Window.partitionBy("file_id").orderBy("line_start", "symbol_id")
    placed = own.withColumn("before", F.coalesce(F.lag("line_end").over(w), F.lit(0)))
    gaps = placed.select("file_id", F.lit(None).cast("bigint").alias("symbol_id"), (F.col("before") + 1).alias("line_start"), (F.col("line_start") - 1).alias("line_end")).where("line_start <= line_end")
    last = split.join(placed.groupBy("file_id").agg(F.max_by("line_end", F.struct("line_start", "symbol_id")).alias("end")), "file_id", "left")
    tail = last.select("file_id", F.lit(None).cast("bigint").alias("symbol_id"), (F.coalesce("end", F.lit(0)) + 1).alias("line_start"), F.col("n").alias("line_end")).where("line_start <= line_end")
    ranges = placed.select("file_id", "symbol_id", "line_start", "line_end").unionByName(gaps).unionByName(tail).where("line_start <= line_end")
    content = F.array_join(F.slice("lines", F.col("line_start"), F.col("line_end") - F.col("line_start") + 1), "\n")
    return ranges.join(split, "file_id").withColumn("content", content).where(F.regexp_replace("content", r"\s", "") != "").select("file_id", "symbol_id", "line_start", "line_end", "content")


def header_chunks(files: DataFrame, symbols: DataFrame, text: str = "content", least: int = 12) -> DataFrame:
    """(file_id, content): what comes before the first symbol, or the first lines where that is blank."""
    split = files.select("file_id", F.split(text, r"\r?\n").alias("lines"))
    first = symbols.groupBy("file_id").agg(F.min("line_start").alias("first"))
    head = F.array_join(F.slice("lines", F.lit(1), F.greatest(F.coalesce(F.col("first"), F.lit(1)) - 1, F.lit(0))), "\n")
    blank = F.regexp_replace(head, r"\s", "") == ""
    return split.join(first, "file_id", "left").select("file_id", F.when(blank, F.array_join(F.slice("lines", 1, least), "\n")).otherwise(head).alias("content"))


def class_summaries(symbols: DataFrame) -> DataFrame:
    """(parent_symbol_id, content): sorted names of each container's members."""
    return symbols.where("parent_symbol_id is not null").groupBy("parent_symbol_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("content"))


def deduped(chunks: DataFrame, by: str = "content_hash", order: str = "chunk_id") -> DataFrame:
    """The first chunk of each content; a partial aggregate, so a hot content costs one row a task."""
    first = chunks.groupBy(by).agg(F.min(order).alias(order), F.count("*").alias("copies"))
    return first


def grep(files: DataFrame, pattern: str, glob: str | None = None, limit: int = 100, text: str = "content") -> DataFrame:
    """Matching lines of files without NUL bytes, apart from case, by path and line; ``truncated`` if there are more."""
    from quillgraph.functions.text import glob_pattern

    own = files.where(~F.col(text).contains("\0"))
    if glob:
        own = own.where(F.col("rel_path").rlike(glob_pattern(glob)))
    hits = lines(own.select("rel_path", text), text).where(F.col("code").rlike("(?i)" + pattern)).orderBy("rel_path", "line").limit(limit + 1)
    w = Window.orderBy("rel_path", "line")
    ranked = hits.withColumn("k", F.row_number().over(w)).withColumn("truncated", F.count("*").over(Window.partitionBy()) > limit)
    return ranked.where(F.col("k") <= limit).select("rel_path", "line", F.col("code").alias("text"), "truncated")
