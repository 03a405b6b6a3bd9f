"""Paths, tokens, snippets, guards: native column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that name no subject.
STOP_WORDS = ["how", "does", "this", "that", "with", "work", "works", "project", "repo", "codebase", "the", "and", "for", "from", "what"]

# Suffix, language.
SUFFIXES = [
    (".ts", "typescript"),
    (".tsx", "tsx"),
    (".js", "javascript"),
    (".jsx", "jsx"),
    (".py", "python"),
    (".go", "go"),
    (".rs", "rust"),
]

# What a scan keeps besides source files, and the folders that it leaves out.
CONFIG_NAMES = r"(^|/)(tsconfig[^/]*\.json|jsconfig\.json|cargo\.toml|go\.mod)$"
SKIPPED_FOLDERS = [".git", "node_modules", "dist", "build", "target", ".next", "coverage"]

# Shell commands that always pass, and the rules for the others (category, pattern).
ALLOWED_COMMANDS = ["git", "npm", "pnpm", "yarn", "bun", "node", "npx", "docker", "make", "cargo", "go", "python", "pip", "pytest", "vitest", "tsc", "eslint"]
COMMAND_RULES = [
    ("content-search", r"\bgrep\b"),
    ("file-read", r"(?i)\bcat\b\s+.+\.(ts|tsx|js|jsx|go|py|rs)\b"),
    ("file-discovery", r"\bfind\b\s+.*-name\b"),
    ("file-edit", r"\b(sed|awk)\b"),
    ("partial-read", r"\b(head|tail)\b"),
    ("count", r"\bwc\b"),
]

# Intents that need evidence from a tool (pattern, tools of which one must have run).
EVIDENCE_RULES = [
    (r"(?i)\b(who calls|what calls|call hierarchy|callers?|callees?)\b", ["call-hierarchy"]),
    (r"(?i)\b(depends on|depend on|imports|dependencies)\b", ["find-dependencies", "find-dependents"]),
    (r"(?i)\b(references|used by|usages?)\b", ["find-references"]),
    (r"(?i)\b(refactor|rename|impact analysis|breaking change)\b", ["find-references", "find-dependents"]),
]

# What redaction looks for.
SECRET_KEY = r"(?i)api[_-]?key|token|authorization|secret|password"
SECRET_VALUE = r"(?i)bearer\s+[a-z0-9._:-]+|sk-[a-z0-9._:-]+"
COMMAND_KEY = r"(?i)command|cmd|shell"
CONTENT_KEY = r"(?i)content|fileContent|body"

# Requests that evidence cannot answer (class, words of which one occurs), in order.
UNSUPPORTED = [
    ("runtime_trace", ["trace"]),
    ("impact_analysis", ["impact", "could break", "what would break"]),
    ("call_hierarchy", ["call hierarchy", "call_hierarchy", "call-hierarchy"]),
    ("multi_hop", ["multi-hop"]),
    ("unbounded_scope", ["entire subsystem", "everything", "all behavior"]),
]


def glob_pattern(glob: str) -> str:
    """The anchored regular expression of a glob of ``**/``, ``**``, ``*`` and ``?``."""
    parts = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    pieces = re.split(r"(\*\*/|\*\*|\*|\?)", glob)
    return "^" + "".join(parts.get(p, re.escape(p)) for p in pieces) + "$"


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether the lines of an ignore file leave a relative path out: the last line that fits decides, ``!`` takes back, a slash inside anchors, one at the end means folders."""
    out = F
    for line in reversed([x.strip() for x in lines]):
        if not line or line.startswith("#"):
            continue
        keep, line = line.startswith("!"), line.removeprefix("!")
        body = glob_pattern(line.strip("/"))[1:-1]
        start = "^" if "/" in line.rstrip("/") else "^(?:.*/)?"
        out = out.when(path.rlike(start + body + ("/.*$" if line.endswith("/") else "(?:/.*)?$")), not keep)
    return F.lit(False) if out is F else out.otherwise(False)


def language_of(path: Column) -> Column:
    """Language by suffix; null for others."""
    low = F.lower(path)
    out = F
    for suffix, language in SUFFIXES:
        out = out.when(low.endswith(suffix), language)
    return out


def scanned_language(path: Column) -> Column:
    """Language of a path that a scan keeps (configuration files are ``unknown``); null for what it skips."""
    inside = path.rlike("(^|/)(" + "|".join(re.escape(x) for x in SKIPPED_FOLDERS) + ")/")
    kept = F.coalesce(language_of(path), F.when(F.lower(path).rlike(CONFIG_NAMES), "unknown"))
    return F.when(~inside, kept)


def is_test_path(path: Column) -> Column:
    return F.lower(path).contains("test")


def tokens_by_chars(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("int")


def tokens_by_bytes(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.octet_length(text) / 4)).cast("int")


def tokens_by_words(text: Column) -> Column:
    return F.greatest(F.lit(1), F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")))


def snippet(text: Column, chars: int = 240) -> Column:
    """White space collapsed, the first ``chars`` characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, chars)


def subject_terms(question: Column) -> Column:
    """Terms of at least three bytes that are no stop words, the first of each spelling apart from case."""
    terms = F.filter(F.split(question, r"[^\p{L}\p{N}_./-]+"), lambda t: (F.octet_length(t) >= 3) & ~F.lower(t).isin(STOP_WORDS))
    lowered = F.transform(terms, F.lower)
    return F.filter(terms, lambda t, i: F.array_position(lowered, F.lower(t)) == i + 1)


def seed_terms(question: Column, most: int = 8) -> Column:
    return F.slice(F.filter(F.split(F.lower(question), r"\s+"), lambda t: F.length(t) > 2), 1, most)


def unsupported_class(question: Column) -> Column:
    low, out = F.lower(question), F
    for name, words in UNSUPPORTED:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = out.when(hit, name)
    return out


def command_category(command: Column) -> Column:
    """Category of the first rule that a command breaks; null if it may run."""
    trimmed = F.trim(command)
    first = F.regexp_extract(F.trim(F.regexp_extract(trimmed, r"^(.*?)(?:&&|;|\||$)", 1)), r"^(\S*)", 1)
    out = F.when((trimmed == "") | first.isin(ALLOWED_COMMANDS), F.lit(None).cast("string"))
    for name, pattern in COMMAND_RULES:
        out = out.when(trimmed.rlike(pattern), name)
    return out


def evidence_allowed(question: Column, tools: Column, score: Column, threshold: float = 0.5) -> Column:
    """Whether a structural claim has the tool and score that its intent asks for."""
    lowered, out = F.transform(tools, F.lower), F
    for pattern, needed in EVIDENCE_RULES:
        out = out.when(question.rlike(pattern), F.arrays_overlap(lowered, F.array(*map(F.lit, needed))) & (score >= threshold))
    return out.otherwise(True)


def redacted(key: Column, value: Column, roots: list[str]) -> Column:
    """A value with secrets, commands, file contents and paths below ``roots`` replaced."""
    below = F.lit(False)
    for r in roots:
        below = below | value.startswith(r)
    return (
        F.when(key.rlike(SECRET_KEY) | value.rlike(SECRET_VALUE), "[REDACTED_SECRET]")
        .when(key.rlike(COMMAND_KEY), "[REDACTED_COMMAND]")
        .when(key.rlike(CONTENT_KEY), "[REDACTED_FILE_CONTENT]")
        .when(below, "[REDACTED_PATH]")
        .otherwise(value)
    )


def retry_delay(attempt: Column, base: int = 500, most: int = 8000, after_ms: Column | None = None, after: Column | None = None, now: Column | None = None) -> Column:
    """Milliseconds to wait: what the answer asks for (``after_ms`` above 0; else ``after``, seconds or an HTTP date, against ``now``), or doubled with every attempt; ``most`` at most."""
    usual = F.least(F.lit(base) * F.pow(F.lit(2.0), F.greatest(attempt, F.lit(1)) - 1), F.lit(most)).cast("bigint")
    out = F
    if after_ms is not None:
        out = out.when(after_ms > 0, F.least(F.floor(after_ms), F.lit(most)).cast("bigint"))
    if after is not None:
        told = F.trim(after)
        seconds = F.when(told.rlike(r"^[0-9.eE+-]+$"), told.try_cast("double"))
        dated = F.regexp_extract(told, r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1)
        date = F.when(dated != "", F.try_to_timestamp(dated, F.lit("dd MMM yyyy HH:mm:ss")))
        wait = F.when(seconds >= 0, F.floor(seconds * 1000)).when(date.isNotNull(), F.greatest((F.unix_timestamp(date) - F.unix_timestamp(F.current_timestamp() if now is None else now)) * 1000, F.lit(0)))
        out = out.when(wait.isNotNull(), F.least(wait, F.lit(most)).cast("bigint"))
    return usual if out is F else out.otherwise(usual)


def retryable(kind: Column, status: Column, flagged: Column | None = None) -> Column:
    """Whether an error of a kind and status (null: none) may be tried again; one that is flagged so always may."""
    by_status = status.isin(408, 409, 425, 429) | status.between(500, 599)
    out = F.when(kind.isin("semantic", "overflow"), False).when(status.isNull(), kind.isin("network", "rate_limit", "transient")).otherwise(by_status)
    return out if flagged is None else F.when(flagged, True).otherwise(out)


def stable_id(*parts: Column) -> Column:
    """A positive 63-bit id of a row's identity; 0 becomes 1."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(str(2**63)).cast("decimal(20,0)")
    return F.when(h == 0, 1).otherwise(h).cast("bigint")
