"""URL filters: host-suffix and path-prefix expressions joined by hash prefix.

Native: DataFrame functions only.  Each distinct (host, path) expands into the
expressions that a rule could be written as (its last k host labels followed by
the first n characters of its path, for the k and n that occur among the rules),
the expressions are hashed, joined to the rules of the same four-byte prefix of the
digest and to nothing else, confirmed on the full digest, and the longest confirmed
rule wins.  Addresses without a host need no join and get the default verdict at once.

Defined results: a null url, or one without ``://``, has empty host and path; an
empty rule table, or no fitting rule, gives the default verdict and a null rule; rules
without a host, and urls with an empty host, fit nothing; urls of any length are read
whole; an empty table gives no row;
of equally long rules ``block`` wins, then the smaller rule text; repeated rows
each get a row; other columns of the input do not take part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rule tables of at most so many rows are sent to every executor (under 200 bytes a row).
BROADCAST_RULES = 50_000
#: Hexadecimal digits of a digest that the equi-join uses: four bytes.
PREFIX_DIGITS = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lowered; path: then up to ``?``, ``#`` or end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules (host, path, action) with the digest of their expression."""
    rule = F.concat("host", "path")
    return (
        rules.where((F.col("host") != "") & F.col("path").isNotNull() & F.col("action").isNotNull())
        .select(
            rule.alias("rule"),
            "action",
            F.size(F.split("host", r"\.")).alias("labels"),
            F.length("path").alias("path_len"),
            F.sha2(rule, 256).alias("digest"),
        )
        .distinct()
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict (existing columns of these names are replaced)."""
    host, path = host_and_path(F.col(url))
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"))
    known = rule_table(rules)
    # which numbers of labels and characters occur: one small row, however many rules there are
    shape = known.agg(
        F.count("*").alias("n"),
        F.sort_array(F.collect_set("labels")).alias("labels"),
        F.sort_array(F.collect_set("path_len")).alias("lens"),
    ).first()
    # the rules of a prefix are few: only digests that begin alike share one
    side = known.groupBy("prefix").agg(F.collect_list(F.struct("digest", "rule", "action")).alias("known"))
    if shape["n"] <= BROADCAST_RULES:
        side = F.broadcast(side)
    label_counts = F.array(*[F.lit(k) for k in shape["labels"]]) if shape["n"] else F.array().cast("array<int>")
    lens = F.array(*[F.lit(k) for k in shape["lens"]]) if shape["n"] else F.array().cast("array<int>")

    parts = F.split("host", r"\.")
    hosts = F.transform(
        F.filter(label_counts, lambda k: k <= F.size(parts)),
        lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."),
    )
    paths = F.transform(
        F.filter(lens, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)
    )
    expressions = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.sha2(F.concat(h, p), 256))))

    # each distinct address is judged once, so a hot host or page costs one row
    named = F.col("host") != ""
    confirmed = F.filter("known", lambda r: r["digest"] == F.col("full"))
    hits = (
        rows.where(named)
        .select("host", "path")
        .distinct()
        .select("host", "path", F.explode(expressions).alias("full"))
        .withColumn("prefix", F.substring("full", 1, PREFIX_DIGITS))
        .join(side, "prefix")
        .select("host", "path", F.inline(confirmed).alias("digest", "rule", "action"))
        .groupBy("host", "path")
        .agg(
            F.max_by(
                F.struct("rule", "action"),
                F.struct(F.length("rule"), (F.col("action") == "block"), F.transform(F.split("rule", ""), lambda c: -F.ascii(c))),
            ).alias("__won")
        )
    )
    out = rows.where(named).join(hits, ["host", "path"], "left").select(*[F.col(f"`{c}`") for c in kept], "host", "path", "__won")
    return out.unionByName(rows.where(~named), allowMissingColumns=True).select(
        *[F.col(f"`{c}`") for c in kept],
        "host",
        "path",
        F.col("__won.rule").alias("rule"),
        F.coalesce("__won.action", F.lit(default)).alias("verdict"),
    )
