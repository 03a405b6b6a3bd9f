"""Which paths nested ignore files leave out.

Every folder may have an ignore file whose rules hold below it.  Of the rules that fit a path the last one of the
deepest file decides; a path below an ignored folder is ignored whatever other rules say.
"""

from __future__ import annotations

import re
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# what runs in tasks travels by value, so that workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: So many folders with ignore files may be sent to every executor; more are shuffled.
BROADCAST_FOLDERS = 20_000


def pattern_of(line: str | None) -> tuple[str, bool, bool] | None:
    """(regular expression on a path relative to the rule's folder, whether it keeps, whether it is for folders only) of a line; None for blank lines and comments."""
    line = re.sub(r"(?<!\\)\s+$", "", line or "")
    if not line or line.startswith("#"):
        return None
    keep, line = line.startswith("!"), line.removeprefix("!")
    folder, line = line.endswith("/"), line.rstrip("/")
    anchored, line = "/" in line, line.removeprefix("/")
    if not line:
        return None
    out, k = "" if anchored else "(?:.*/)?", 0
    while k < len(line):
        if line[k : k + 3] == "**/" and (k == 0 or line[k - 1] == "/"):
            out, k = out + "(?:.*/)?", k + 3
        elif line[k : k + 2] == "**" and k + 2 == len(line) and (k == 0 or line[k - 1] == "/"):
            out, k = out + ".+", k + 2
        elif line[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif line[k] == "?":
            out, k = out + "[^/]", k + 1
        elif line[k] == "[" and (end := line.find("]", k + 2)) > 0:
            inner = line[k + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out, k = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        else:
            k += line[k] == "\\" and k + 1 < len(line)
            out, k = out + (line[k] if line[k].isalnum() or line[k] in "_/" else "\\" + line[k]), k + 1
    return "^" + out + "$", keep, folder


def rules_of(files: DataFrame, path: str = "rel_path", text: str = "content") -> DataFrame:
    """(dir, rules) of ignore files: each folder's rules in order, its files in the order of their paths."""

    @F.udf("array<struct<pattern: string, keep: boolean, folder: boolean>>")
    def read(content: str | None) -> list:
        return [p for line in (content or "").split("\n") if (p := pattern_of(line.rstrip("\r")))]

    folder = F.regexp_extract(path, r"^(?:(.*)/)?[^/]*$", 1)
    rows = files.select(folder.alias("dir"), F.col(path).alias("at"), read(text).alias("rules"))
    return rows.groupBy("dir").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "rules"))), lambda x: x["rules"])).alias("rules"))


def ignored_paths(paths: DataFrame, ignore_files: DataFrame, path: str = "rel_path") -> DataFrame:
    """(path, ignored) of each different path; ``ignore_files`` has (rel_path, content).

    A path and the folders above it are asked for in every folder above them that has rules: an equi-join by folder.
    """
    parts = F.split(path, "/")
    upto = lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    own = paths.select(path).distinct().withColumn("n", F.size(parts))
    each = own.select(path, "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k")).withColumn("node", upto(F.col("k"))).withColumn("folder", F.col("k") < F.col("n"))
    nodes = each.select("node", "folder").distinct()
    steps = F.split("node", "/")
    asked = nodes.select("node", "folder", F.explode(F.sequence(F.lit(0), F.size(steps) - 1)).alias("depth"))
    asked = asked.withColumn("dir", F.array_join(F.slice(steps, F.lit(1), F.col("depth")), "/")).withColumn("rest", F.array_join(F.slice(steps, F.col("depth") + 1, F.size(steps)), "/"))
    rules = rules_of(ignore_files)
    rules = F.broadcast(rules) if rules.count() <= BROADCAST_FOLDERS else rules
    fits = F.filter("rules", lambda r: (~r["folder"] | F.col("folder")) & F.rlike(F.col("rest"), r["pattern"]))
    last = F.try_element_at(fits, F.lit(-1))["keep"]
    told = asked.join(rules, "dir").select("node", "folder", "depth", last.alias("keep")).where("keep is not null")
    out = told.groupBy("node", "folder").agg((~F.max_by("keep", "depth")).alias("gone")).where("gone")
    gone = each.join(out, ["node", "folder"], "left_semi").select(path).distinct().withColumn("ignored", F.lit(True))
    return own.select(path).join(gone, path, "left").select(path, F.coalesce("ignored", F.lit(False)).alias("ignored"))
