"""Conventions of a code base: how files are named and imported, where tests lie, how commits and branches are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import base_name, naming_style

#: The types of the public convention for commit messages.
TYPES = ("build", "chore", "ci", "docs", "feat", "fix", "perf", "refactor", "revert", "style", "test")
_TYPE, _SCOPE = f"(?:{'|'.join(TYPES)})", r"\([^()\n]+\)"
#: Own rules for the style of a commit message.
COMMIT_STYLES = {
    "conventional": rf"^{_TYPE}(?:{_SCOPE})?!?: +\S",
    "scoped": rf"^{_TYPE}{_SCOPE}!?: +\S",
    "emoji": r"^(?::\w+:|[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}])",
    "ticket": r"^\[?[A-Z][A-Z0-9]+-[0-9]+\b",
}
#: Own table: kinds of branches by what stands before the first slash.
BRANCHES = {
    "feature": ("feature", "feat"), "fix": ("fix", "bugfix", "bug"), "hotfix": ("hotfix",), "release": ("release", "rel"), "docs": ("docs", "doc"), "test": ("test", "tests"),
    "refactor": ("refactor",), "chore": ("chore", "task"), "ci": ("ci", "build"), "experiment": ("experiment", "spike", "poc"),
}
#: Fixed value: share of commits, in per cent, that a style needs.
LEAST_SHARE = 30


def naming(files: DataFrame) -> DataFrame:
    """extension, style and number of files, by the name before its first dot; names without a style count as unknown."""
    stem = F.split_part(base_name(F.col("path")), F.lit("."), F.lit(1))
    df = files.where(~F.coalesce("is_dir", F.lit(False)))
    return df.groupBy("extension", naming_style(stem).alias("style")).agg(F.count(F.lit(1)).alias("files"))


def dominant(counts: DataFrame, key: str, value: str, n: str = "files") -> DataFrame:
    """The most frequent value of each key and its number; of equals the first by name. Unknown values don't count."""
    known = counts.where(F.col(value) != "unknown")
    first = Window.partitionBy(key).orderBy(F.desc(n), value)
    return known.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(key, value, n)


def tests(files: DataFrame) -> DataFrame:
    """extension, and how many files are tests by their suffix, lie in a folder of tests, or both."""
    name, path = base_name(F.col("path")), F.col("path")
    suffix = name.rlike(r"(?:_test|\.test|\.spec)\.[a-z]+$|^test_")
    folder = path.rlike(r"/(?:tests?|__tests__|spec)/")
    df = files.where(~F.coalesce("is_dir", F.lit(False)))
    return df.groupBy("extension").agg(F.count_if(suffix).alias("suffixed"), F.count_if(folder).alias("in_folder"), F.count_if(suffix & folder).alias("both"), F.count(F.lit(1)).alias("files"))


def imports(src: DataFrame) -> DataFrame:
    """extension and how many imports are relative, by alias, or of packages; counted over all imports of all files."""
    pattern = {".js": r"from '([^']+)'", ".ts": r"from '([^']+)'", ".py": r"(?m)^(?:import|from) ([\w.]+)", ".java": r"(?m)^import ([\w.]+);", ".rs": r"(?m)^use ([\w:]+);", ".c": r"#include [<\"]([^>\"]+)[>\"]", ".go": r"(?m)^import \"([^\"]+)\""}
    every = F.lit(None).cast("array<string>")
    for ext, p in pattern.items():
        every = F.when(F.col("extension") == ext, F.regexp_extract_all("content", F.lit(p), F.lit(1))).otherwise(every)
    df = src.select("extension", F.explode(every).alias("name"))
    relative, alias = F.col("name").startswith("."), F.col("name").rlike("^[@~]/")
    return df.groupBy("extension").agg(F.count(F.lit(1)).alias("imports"), F.count_if(relative).alias("relative"), F.count_if(alias).alias("aliased"), F.countDistinct("name").alias("names"))


def commits(messages: DataFrame, styles: dict[str, str] = COMMIT_STYLES) -> DataFrame:
    """style and number of commits whose first line is written so, of styles that reach LEAST_SHARE; at least one commit."""
    first = F.split_part(F.col("message"), F.lit("\n"), F.lit(1))
    met = F.array_compact(F.array(*[F.when(first.rlike(p), F.lit(s)) for s, p in styles.items()]))
    total = messages.agg(F.count(F.lit(1))).scalar()
    counts = messages.select(F.explode(met).alias("style")).groupBy("style").agg(F.count(F.lit(1)).alias("commits"))
    return counts.where(F.col("commits") * 100 >= total * LEAST_SHARE)


def commit_parts(messages: DataFrame) -> DataFrame:
    """type, scope and number of commits of messages such as ``fix(parser): ...``; scope empty where there is none."""
    header = r"^([a-z]+)(?:\(([^()\n]+)\))?!?: +\S"
    df = messages.select(F.regexp_extract("message", header, 1).alias("type"), F.regexp_extract("message", header, 2).alias("scope"))
    return df.where(F.col("type").isin(*TYPES)).groupBy("type", "scope").agg(F.count(F.lit(1)).alias("commits"))


def branch_kind(name: Column, kinds: dict = BRANCHES) -> Column:
    """The kind of a branch by its prefix, in any case; null without a known prefix."""
    table = F.create_map(*[F.lit(x) for kind, words in kinds.items() for w in words for x in (w, kind)])
    local = F.regexp_replace(name, "^(?:refs/heads/|refs/remotes/)?(?:origin/)?", "")
    return F.when(F.contains(local, F.lit("/")), F.try_element_at(table, F.lower(F.split_part(local, F.lit("/"), F.lit(1)))))
